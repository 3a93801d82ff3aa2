"""One record a document: its heterogeneous graph with local node numbers.

Nodes are the document itself (0), its passages, numbered from 0 in their order,
and all topics, numbered from 0 in the order of their ids. A relation is a struct
of parallel arrays: src and dst are node numbers, and where edges have them,
attrs and label. All tables meet by document, and a record holds what one
document has; the topics are few by nature, as each record has a label for every
one of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.operators.splits import positions

RELATIONS = ("next", "contains", "supports", "matches")


def numbered_topics(topics: DataFrame) -> DataFrame:
    """(cid, node): topics numbered from 0 in the order of their ids."""
    return positions(topics.select("cid").distinct(), "cid").select("cid", F.col("pos").cast("int").alias("node"))


def numbered_passages(passages: DataFrame) -> DataFrame:
    """``passages`` with ``node``, from 0 in each document."""
    return passages.withColumn("node", (F.row_number().over(Window.partitionBy("doc_id").orderBy("sent_idx")) - 1).cast("int"))


def _columns(edges: Column, *names: str) -> Column:
    """Parallel arrays from an array of edge structs."""
    return F.struct(*[F.transform(edges, _field(n)).alias(n) for n in names])


def _field(name: str):
    return lambda e: e[name]


def _edges(rows: DataFrame, name: str) -> DataFrame:
    """(doc_id, name): the edges of each document as one array, by dst, then src."""
    return rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("dst", "src", "attrs", "label"))).alias(name))


def document_graphs(passages: DataFrame, topics: DataFrame, supports: DataFrame, matches: DataFrame, truth: DataFrame) -> DataFrame:
    """(doc_id, n_passages, n_topics, passage, topic, next, contains, supports, matches).

    ``passages`` (doc_id, sent_idx, x), ``topics`` (cid, ...), ``supports``
    (doc_id, sent_idx, cid, attrs, label), ``matches`` (doc_id, cid, attrs, label)
    and ``truth`` (doc_id, cid, label). passage is a struct of sent_idx and x by
    node; topic has y, the truth of each topic, 0 where there is none.

    Edges to a passage or topic that isn't there are left out, and so are
    documents without passages. A document without edges of a relation has empty
    arrays. Repeated edges stay.
    """
    p, t = numbered_passages(passages), numbered_topics(topics)
    place = p.select("doc_id", "sent_idx", F.col("node").alias("src"))
    topic = t.select("cid", F.col("node").alias("dst"))
    sup = _edges(supports.join(place, ["doc_id", "sent_idx"]).join(topic, "cid"), "_sup")
    mat = _edges(matches.join(topic, "cid").withColumn("src", F.lit(0)), "_mat")
    yes = truth.where("label = 1").join(topic, "cid").groupBy("doc_id").agg(F.collect_set("dst").alias("_yes"))
    n_topics = t.agg(F.count("*").cast("int").alias("n_topics"))  # one row

    nodes = p.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("node", "sent_idx", "x"))).alias("_p"))
    joined = nodes.join(sup, "doc_id", "left").join(mat, "doc_id", "left").join(yes, "doc_id", "left").crossJoin(F.broadcast(n_topics))
    n = F.size("_p")
    upto = lambda lo, hi: F.when(hi >= lo, F.sequence(F.lit(lo), hi)).otherwise(F.array().cast("array<int>"))
    or_none = lambda c, like: F.coalesce(F.col(c), F.array().cast(like.schema[c].dataType))
    wanted = F.coalesce(F.col("_yes"), F.array().cast("array<int>"))
    return joined.select(
        "doc_id",
        n.alias("n_passages"),
        "n_topics",
        _columns(F.col("_p"), "sent_idx", "x").alias("passage"),
        F.struct(F.transform(upto(0, F.col("n_topics") - 1), lambda i: F.array_contains(wanted, i).cast("int")).alias("y")).alias("topic"),
        F.struct(upto(0, n - 2).alias("src"), upto(1, n - 1).alias("dst")).alias("next"),
        F.struct(F.array_repeat(F.lit(0), n).alias("src"), upto(0, n - 1).alias("dst")).alias("contains"),
        _columns(or_none("_sup", sup), "src", "dst", "attrs", "label").alias("supports"),
        _columns(or_none("_mat", mat), "src", "dst", "attrs", "label").alias("matches"),
    )


def scored_graphs(passages: DataFrame, topics: DataFrame, scores: DataFrame, doc_scores: DataFrame) -> DataFrame:
    """Records of the first kind: every score is an edge, with the attributes and
    labels of ``graph.supports_edges``; matches have [logit, prob]; a label, and a
    topic's y, is whether the probability reaches 0.5.

    ``passages`` (doc_id, sent_idx, sent), ``scores`` (doc_id, sent_idx, cid,
    logit, prob), ``doc_scores`` (doc_id, cid, logit, prob).
    """
    from quillspark.operators import graph

    label = (F.coalesce(F.col("prob"), F.lit(0.0)) >= 0.5).cast("int")
    attrs = F.array(F.col("logit").cast("double"), F.col("prob").cast("double"))
    matches = doc_scores.select("doc_id", "cid", attrs.alias("attrs"), label.alias("label"))
    return document_graphs(graph.passage_nodes(passages), topics, graph.supports_edges(scores, passages), matches, matches)


def retrieved_graphs(passages: DataFrame, topics: DataFrame, scores: DataFrame, doc_scores: DataFrame, truth: DataFrame, k: int = 15) -> DataFrame:
    """Records of the second kind: the k best passages of each pair by calibrated
    probability (``assembly.support_edges``), labelled by the prediction's label;
    matches have [logit, prob_cal], labelled by the truth, 0 where there is none.

    ``passages`` (doc_id, sent_idx, x) with any vectors, ``scores`` (doc_id,
    sent_idx, cid, label, logit, prob_cal, dense, dense_rank, sparse_rank),
    ``doc_scores`` (doc_id, cid, logit, prob_cal), ``truth`` (doc_id, cid, label).
    """
    from quillspark.operators import assembly, graph

    once = truth.groupBy("doc_id", "cid").agg(F.max("label").alias("label"))
    edges = graph.matches_edges(doc_scores, once)
    matches = edges.select("doc_id", "cid", F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("logit", "prob_cal")]).alias("attrs"), "label")
    return document_graphs(passages, topics, assembly.support_edges(scores, k, label="label"), matches, once)


def edge_rows(records: DataFrame, relation: str) -> DataFrame:
    """(doc_id, src, dst, and attrs and label where the relation has them), a row an edge."""
    if relation not in RELATIONS:
        raise ValueError(f"unknown relation {relation}")
    names = [f.name for f in records.schema[relation].dataType]
    zipped = F.explode(F.arrays_zip(*[F.col(relation)[n].alias(n) for n in names])).alias("e")
    return records.select("doc_id", zipped).select("doc_id", *[F.col("e")[n].alias(n) for n in names])
