"""Node and edge tables of the heterogeneous document graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions.text import HEDGE_CUES, NEGATION_CUES, duration_days, has_cue


def passage_nodes(passages: DataFrame) -> DataFrame:
    """(doc_id, sent_idx, x): length and three zeros."""
    zero = F.lit(0.0)
    return passages.select("doc_id", "sent_idx", F.array(F.char_length("sent").cast("double"), zero, zero, zero).alias("x"))


def topic_nodes(topics: DataFrame, doc_scores: DataFrame) -> DataFrame:
    """(doc_id, cid, is_core, desc_len, y): y is whether the document's probability reaches 0.5."""
    return doc_scores.join(topics, "cid").select("doc_id", "cid", F.col("is_core").cast("int").alias("is_core"), (F.char_length("text") / 100).alias("desc_len"), (F.coalesce("prob", F.lit(0.0)) >= 0.5).cast("int").alias("y"))


def supports_edges(scores: DataFrame, passages: DataFrame) -> DataFrame:
    """(doc_id, sent_idx, cid, attrs, label): logit, prob, negation, hedge, days, relative position.

    ``n_passages`` of ``passages`` is the number in the document; without the column
    they are counted. Cues are looked for in scored passages only."""
    if "n_passages" not in passages.columns:
        passages = passages.withColumn("n_passages", F.count("*").over(Window.partitionBy("doc_id")))
    place = F.round(F.when(F.col("n_passages") > 1, F.col("sent_idx") / (F.col("n_passages") - 1)).otherwise(0.0), 6)
    cues = {"neg": has_cue(F.col("sent"), NEGATION_CUES), "hedge": has_cue(F.col("sent"), HEDGE_CUES), "days": F.coalesce(duration_days(F.col("sent")), F.lit(0)), "pos": place}
    met = passages.select("doc_id", "sent_idx", "sent", "n_passages").join(scores, ["doc_id", "sent_idx"]).withColumns(cues)
    attrs = F.array(*[F.col(c).cast("double") for c in ("logit", "prob", "neg", "hedge", "days", "pos")])
    return met.select("doc_id", "sent_idx", "cid", attrs.alias("attrs"), (F.col("prob") >= 0.5).cast("int").alias("label"))


def next_edges(rows: DataFrame, by: str, order: str) -> DataFrame:
    """(by, src, dst) of neighbours in order."""
    nxt = F.lead(order).over(Window.partitionBy(by).orderBy(order))
    return rows.select(by, F.col(order).alias("src"), nxt.alias("dst")).where("dst IS NOT NULL")


def contains_edges(passages: DataFrame) -> DataFrame:
    return passages.select(F.col("doc_id").alias("src"), F.col("doc_id"), F.col("sent_idx").alias("dst"))


def matches_edges(doc_scores: DataFrame, truth: DataFrame) -> DataFrame:
    """(doc_id, cid, logit, prob_cal, label) with missing truth as 0."""
    t = truth.select("doc_id", "cid", F.col("label").alias("_y"))
    return doc_scores.join(t, ["doc_id", "cid"], "left").select("doc_id", "cid", "logit", "prob_cal", F.coalesce("_y", F.lit(0)).alias("label"))


def near_edges(rows: DataFrame, by: str, order: str, k: int) -> DataFrame:
    """(by, src, dst) of rows at most k places apart, by k leads and no self-join."""
    w = Window.partitionBy(by).orderBy(order)
    leads = rows.select(by, F.col(order).alias("src"), F.array(*[F.lead(order, i).over(w) for i in range(1, k + 1)]).alias("leads"))
    return leads.select(by, "src", F.explode("leads").alias("dst")).where("dst IS NOT NULL")


def cooccurrence(present: DataFrame, by: str = "doc_id", item: str = "cid") -> DataFrame:
    """(cid1, cid2, pmi, cofreq) of items that share a group."""
    p = present.select(by, item).distinct()
    n = p.select(by).distinct().count()
    one = p.groupBy(item).agg(F.count("*").alias("c"))
    # Items of a group as one array: pairs need no self-join.
    sets = p.groupBy(by).agg(F.array_sort(F.collect_set(item)).alias("s"))
    pairs = sets.select(F.explode(F.flatten(F.transform("s", lambda a, i: F.transform(F.slice("s", i + 2, F.size("s")), lambda b: F.struct(a.alias("cid1"), b.alias("cid2")))))).alias("x")).select("x.*")
    co = pairs.groupBy("cid1", "cid2").agg(F.count("*").alias("cofreq"))
    a, b = one.select(F.col(item).alias("cid1"), F.col("c").alias("c1")), one.select(F.col(item).alias("cid2"), F.col("c").alias("c2"))
    return co.join(a, "cid1").join(b, "cid2").select("cid1", "cid2", F.round(F.log(F.col("cofreq") * F.lit(n) / (F.col("c1") * F.col("c2"))), 9).alias("pmi"), "cofreq")


def neighbour_mean(nodes: DataFrame, edges: DataFrame, value: str) -> DataFrame:
    """One hop of fixed-weight message passing: (dst, value) means over sources."""
    return edges.join(nodes.select(F.col("id").alias("src"), value), "src").groupBy("dst").agg(F.round(F.avg(value), 9).alias(value))


def edge_attention(queries: DataFrame, keys: DataFrame, edges: DataFrame, scale: float = 1.0) -> DataFrame:
    """(dst, relation, head, value): attention of every node over its incoming edges.

    ``queries`` (dst, relation, head, q), ``keys`` (src, relation, head, k, v) with
    vectors that given weights have made, and ``edges`` (src, dst, relation). An
    edge's weight is the softmax, over all edges into dst of its relation and head,
    of scale * (q . k); the value is the weighted mean of v. A node without edges
    of a relation has no row there.

    Edges meet their two ends by joins, and sums come from two aggregates: greatest
    scores first, then sums of exponentials by component. Both add up in each task
    before they are shuffled, so a hub's edges don't meet in one task there; Spark
    splits a hub's rows in the joins.
    """
    at = ["relation", "head"]
    dot = F.aggregate(F.zip_with("q", "k", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda a, x: a + x)
    scored = edges.join(keys, ["src", "relation"]).join(queries, ["dst", *at]).select("dst", *at, (dot * scale).alias("s"), "v")
    top = scored.groupBy("dst", *at).agg(F.max("s").alias("top"))
    weighed = scored.join(top, ["dst", *at]).select("dst", *at, F.exp(F.col("s") - F.col("top")).alias("w"), "v")
    parts = weighed.select("dst", *at, "w", F.posexplode("v").alias("i", "x")).groupBy("dst", *at, "i").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("x"))
    return parts.groupBy("dst", *at).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda c: F.round(c["x"], 9)).alias("value"))
