"""Queries of tables put together for scorers and graphs, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions.text import passage_table
from quillspark.operators import assembly, graph, matching, splits
from quillspark.plans.base import SQL as PARTS
from quillspark.plans.base import documents, gold, label_rows, predictions, topics, with_sql, words_sql
from quillspark.plans.table_queries import ADAM, AT_HALF, BIN, CHUNKS, PRED, RECURSIVE, WHOLE
from quillspark.session import table

Q, SQL = {}, {}
DESCRIBED = [("quality", "text of good quality", True), ("toxic", "harmful text", False)]
DESCRIBED_SQL = "described AS (SELECT * FROM (VALUES ('quality', 'text of good quality', true), ('toxic', 'harmful text', false)) v(cid, text, is_core))"


def query(sql: str | None = None):
    def add(fn):
        Q[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def _described(spark, n=2):
    return spark.createDataFrame(DESCRIBED[:n], "cid string, text string, is_core boolean")


@query(PRED + ", o AS (SELECT doc_id, row_number() OVER (ORDER BY md5('7|' || doc_id), doc_id) - 1 AS pos, count(*) OVER () AS n FROM documents) SELECT doc_id, cid, label FROM pred JOIN o USING (doc_id) WHERE pos < floor(n * 0.8)")
def split_mask(spark, sf):
    """The label rows of the training split."""
    parts = splits.ratio_split(documents(spark, sf), 0.8, 0.1, 7)
    return assembly.of_split(predictions(spark, sf), parts, "train").select("doc_id", "cid", "label")


@query(PRED + " SELECT doc_id, cid, coalesce(CASE WHEN fold > 1 THEN prob_cal END, CASE WHEN fold > 0 THEN prob END, 0) AS p, 0::DOUBLE AS none FROM pred")
def prob_fallback(spark, sf):
    """The calibrated probability where there is one, else the raw one, else 0."""
    p = predictions(spark, sf).withColumn("prob_cal", F.when(F.col("fold") > 1, F.col("prob_cal"))).withColumn("prob", F.when(F.col("fold") > 0, F.col("prob")))
    return p.select("doc_id", "cid", assembly.probability(p.columns, "prob_cal").alias("p"), assembly.probability(["doc_id"], "prob_cal").alias("none"))


@query(
    with_sql("passages", "topics", "post", "terms", "bm25", "gold")
    + """, c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, cid ORDER BY score DESC, sent_idx)::INT AS rank FROM bm25) WHERE rank <= 1)
 SELECT c.doc_id, c.cid, c.sent_idx, c.rank, length(p.sent) AS n_sent, length(t.text) AS n_topic, (g.doc_id IS NOT NULL)::INT AS label FROM c JOIN passages p USING (doc_id, sent_idx) JOIN benchmark t ON t.item_id = c.cid
 LEFT JOIN (SELECT DISTINCT * FROM gold) g ON g.doc_id = c.doc_id AND g.cid = c.cid AND g.sent_idx = c.sent_idx"""
)
def candidate_attach(spark, sf):
    t = matching.topic_matrix(topics(spark, sf))
    words = matching.document_words(documents(spark, sf), gold(spark, sf), sents=True)
    rows = matching.candidate_rows(words, t, matching.bm25_model(words, t), topics(spark, sf), 1)
    return rows.select("doc_id", "cid", "sent_idx", "rank", F.length("sent").alias("n_sent"), F.length("topic").alias("n_topic"), "label")


@query(
    with_sql("passages", "label_rows")
    + """, c AS (SELECT doc_id, cid, (n_chars // 100)::INT AS sent_idx FROM label_rows JOIN documents USING (doc_id))
 SELECT 'passage' AS missing, count(*) AS n FROM c ANTI JOIN passages USING (doc_id, sent_idx) UNION ALL SELECT 'topic', count(*) FROM c WHERE cid <> 'quality'"""
)
def candidate_unattached(spark, sf):
    """Candidates that point past their document, or to a topic that isn't described."""
    d = documents(spark, sf)
    c = label_rows(spark, sf).join(d, "doc_id").select("doc_id", "cid", F.floor(F.col("n_chars") / 100).cast("int").alias("sent_idx"), F.lit(1).alias("rank"))
    return assembly.unattached(c, passage_table(d), _described(spark, 1), 1)


@query(
    with_sql("label_rows")
    + ", "
    + DESCRIBED_SQL
    + """, j AS (SELECT l.doc_id, l.cid, l.label, d.text, t.text AS topic, d.doc_id IS NOT NULL AS has_doc, t.cid IS NOT NULL AS has_topic FROM label_rows l
  LEFT JOIN (SELECT * FROM documents WHERE lang = 'en') d USING (doc_id) LEFT JOIN (SELECT * FROM described WHERE is_core) t ON t.cid = l.cid)
 SELECT way, doc_id, cid, length(coalesce(text, '')) AS n_text, coalesce(topic, '') AS topic, label FROM j CROSS JOIN (SELECT unnest(['drop', 'empty', 'drop_doc']) AS way)
 WHERE way = 'empty' OR (has_doc AND (has_topic OR way = 'drop_doc'))"""
)
def pair_attach(spark, sf):
    """Label pairs with English texts and one described topic, in the three ways to treat what is missing."""
    d = documents(spark, sf).where("lang = 'en'")
    parts = [assembly.attach_pairs(label_rows(spark, sf), d, _described(spark, 1), way).select(F.lit(way).alias("way"), "doc_id", "cid", F.length("text").alias("n_text"), "topic", "label") for way in ("drop", "empty", "drop_doc")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    with_sql("passages", "topics", "post", "terms", "sparse")
    + """, c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, cid ORDER BY score DESC, sent_idx)::INT AS rank FROM sparse) WHERE rank <= 1)
 SELECT doc_id, cid, sent_idx, score, rank FROM c UNION ALL
 SELECT p.doc_id, t.cid, p.sent_idx, 0::DOUBLE, p.sent_idx + 1 FROM passages p CROSS JOIN topics t WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.doc_id = p.doc_id AND c.cid = t.cid)"""
)
def whole_document_fallback(spark, sf):
    t = matching.topic_matrix(topics(spark, sf))
    return matching.top_or_all(matching.document_words(documents(spark, sf)), t, matching.Cosine(t), 1)


@query(f"WITH {CHUNKS}, {DESCRIBED_SQL} SELECT doc_id, cid, (row_number() OVER (PARTITION BY doc_id, cid ORDER BY start) - 1)::INT AS chunk_id, n_words, text AS topic FROM sc CROSS JOIN described")
def chunk_topic_pairs(spark, sf):
    rows = assembly.chunk_pairs(documents(spark, sf), _described(spark), 64, 16)
    return rows.select("doc_id", "cid", "chunk_id", F.size("words").alias("n_words"), "topic")


@query(f"""WITH {CHUNKS}, t AS (SELECT item_id AS cid, list_distinct({words_sql("text")}) AS t FROM benchmark),
 s AS (SELECT cs.doc_id, cid, start, round(len(list_intersect(list_distinct(c), t))::DOUBLE / greatest(len(t), 1) * 8 - 4, 6) AS logit FROM cs CROSS JOIN t),
 p AS (SELECT *, round(1 / (1 + exp(-logit)), 9) AS prob FROM s)
 SELECT doc_id, cid, count(*) AS n_chunks, max(prob) AS prob_max, round(list_sum(list_sort(list(prob), 'DESC')[1:2]) / 2, 9) AS prob_top FROM p GROUP BY ALL""")
def chunk_topic_scores(spark, sf):
    """Every window of a document scored against every topic, then the document's
    score for the topic by maximum and by the mean of its two best."""
    return matching.chunk_shares(documents(spark, sf), topics(spark, sf), 64, 16)


@query(with_sql("label_rows") + " SELECT d.doc_id, coalesce(string_agg(cid || '=' || label, ',' ORDER BY cid), '') AS by_topic FROM documents d LEFT JOIN label_rows USING (doc_id) GROUP BY d.doc_id")
def topic_lookup(spark, sf):
    rows = assembly.topic_map(label_rows(spark, sf), documents(spark, sf))
    entries = F.transform(F.array_sort(F.map_entries("by_topic")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return rows.select("doc_id", F.array_join(entries, ",").alias("by_topic"))


@query(
    """SELECT 'first' AS kind, conv_id AS doc_id, NULL AS cid, turn // 2 AS sent_idx, length(min_by(text, turn)) AS n FROM conversations GROUP BY ALL
 UNION ALL SELECT 'last', conv_id, role, turn // 2, length(max_by(text, turn)) FROM conversations GROUP BY ALL"""
)
def annotation_lookup(spark, sf):
    """Turns stand for notes: the first text of a place, and the last of a place and role."""
    c = table(spark, sf, "conversations")
    notes = c.select(F.col("conv_id").alias("doc_id"), F.col("role").alias("cid"), F.expr("turn div 2").alias("sent_idx"), "text", F.col("turn").alias("at"))
    first, last = assembly.annotation_maps(notes)
    cols = lambda kind, df: df.select(F.lit(kind).alias("kind"), "doc_id", (F.col("cid") if kind == "last" else F.lit(None).cast("string")).alias("cid"), "sent_idx", F.length("text").alias("n"))
    return cols("first", first).unionByName(cols("last", last))


@query(with_sql("topics", "terms") + " SELECT cid, term, round(qtf / sqrt(sum(qtf * qtf) OVER (PARTITION BY cid)), 9) AS w FROM terms")
def sparse_encoding(spark, sf):
    """The default sparse encoder over all topic texts, a row a word."""
    return topics(spark, sf).select("cid", F.explode(assembly.term_weights(F.col("text"))).alias("term", "w")).withColumn("w", F.round("w", 9))


@query(PRED + " SELECT doc_id, cid, fold, round(1 / (1 + exp(-(logit + fold))), 9) AS prob FROM pred")
def fold_scorers(spark, sf):
    """Every row scored by the model of its fold."""
    import numpy as np

    scorers = {k: (lambda rows, k=k: 1 / (1 + np.exp(-(rows["logit"] + k)))) for k in range(5)}
    return assembly.fold_scores(predictions(spark, sf).select("doc_id", "cid", "fold", "logit"), scorers).select("doc_id", "cid", "fold", F.round("prob", 9).alias("prob"))


@query("SELECT (i // 100)::BIGINT AS batch, count(*)::INT AS n, string_agg(c_custkey, ',' ORDER BY i) AS ids FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS i FROM customer) GROUP BY batch")
def collated_batches(spark, sf):
    rows = assembly.batches(table(spark, sf, "customer"), 100, ["c_custkey"], "c_acctbal", "c_custkey")
    return rows.select("batch", "n", F.array_join(F.transform("c_custkey", lambda x: x.cast("string")), ",").alias("ids"))


_AREA = """SELECT scope, cid, round(sum(p / pos * tp / (tp + fp)), 9) AS a FROM (SELECT scope, cid, p::DOUBLE AS p, sum(p) OVER (PARTITION BY scope, cid)::DOUBLE AS pos,
  sum(p) OVER (PARTITION BY scope, cid ORDER BY x DESC ROWS UNBOUNDED PRECEDING)::DOUBLE AS tp, sum(n) OVER (PARTITION BY scope, cid ORDER BY x DESC ROWS UNBOUNDED PRECEDING)::DOUBLE AS fp
  FROM (SELECT scope, cid, {p} AS x, sum(label) AS p, sum(1 - label) AS n FROM e GROUP BY ALL)) GROUP BY scope, cid"""
_ECE = "SELECT scope, cid, round(sum(n * abs(acc - conf)) / sum(n), 9) AS v FROM (SELECT scope, cid, {bin} AS bin, count(*) AS n, avg(label) AS acc, avg({p}) AS conf FROM e GROUP BY ALL) GROUP BY scope, cid"


@query(
    PRED
    + f""", e AS (SELECT 'topic' AS scope, cid, label, prob, prob_cal FROM pred UNION ALL SELECT 'overall', 'all', label, prob, prob_cal FROM pred),
 s AS (SELECT scope, cid, count(*) AS n, sum(label)::BIGINT AS n_pos FROM e GROUP BY ALL),
 a AS ({_AREA.format(p="prob")}), b AS ({_AREA.format(p="prob_cal")}),
 k AS (SELECT scope, cid, x, round(2 * tp / (tp + fp + pos)::DOUBLE, 9) AS f1 FROM (SELECT scope, cid, x, sum(p) OVER (PARTITION BY scope, cid) AS pos,
   sum(p) OVER (PARTITION BY scope, cid ORDER BY x DESC ROWS UNBOUNDED PRECEDING) AS tp, sum(n) OVER (PARTITION BY scope, cid ORDER BY x DESC ROWS UNBOUNDED PRECEDING) AS fp
   FROM (SELECT scope, cid, prob_cal AS x, sum(label) AS p, sum(1 - label) AS n FROM e GROUP BY ALL))),
 t AS (SELECT scope, cid, x AS threshold, f1 FROM (SELECT *, row_number() OVER (PARTITION BY scope, cid ORDER BY f1 DESC, x) AS i FROM k) WHERE i = 1),
 h AS (SELECT scope, cid, {AT_HALF.replace("prob", "prob_cal")} FROM e GROUP BY scope, cid),
 u AS ({_ECE.format(bin=BIN.format(p="prob", b=10), p="prob")}), w AS ({_ECE.format(bin=BIN.format(p="prob_cal", b=10), p="prob_cal")})
 SELECT scope, cid, n, n_pos, CASE WHEN n_pos > 0 AND n_pos < n THEN a.a END AS auprc, CASE WHEN n_pos > 0 AND n_pos < n THEN b.a END AS auprc_cal, threshold, f1,
  round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END, 9) AS precision_half, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END, 9) AS recall_half,
  round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn)::DOUBLE ELSE 0 END, 9) AS f1_half, u.v AS ece_before, w.v AS ece_after
 FROM s JOIN a USING (scope, cid) JOIN b USING (scope, cid) JOIN t USING (scope, cid) JOIN h USING (scope, cid) JOIN u USING (scope, cid) JOIN w USING (scope, cid)"""
)
def evidence_bundle(spark, sf):
    return assembly.evidence_bundle(predictions(spark, sf)).drop("precision_best", "recall_best")


_STEPS = """SELECT cid, x, sum(p) OVER (PARTITION BY cid)::DOUBLE AS pos, sum(p + n) OVER (PARTITION BY cid) AS rows, p::DOUBLE AS p, sum(p) OVER down::DOUBLE AS tp, sum(n) OVER down::DOUBLE AS fp
  FROM (SELECT cid, {x} AS x, sum(label) AS p, sum(1 - label) AS n FROM few GROUP BY ALL) WINDOW down AS (PARTITION BY cid ORDER BY x DESC ROWS UNBOUNDED PRECEDING)"""


@query(
    PRED
    + f""", few AS (SELECT doc_id, cid, label, prob, prob_cal FROM pred UNION ALL SELECT doc_id, 'never', 0, prob, prob_cal FROM pred WHERE label = 0),
 a AS ({_STEPS.format(x="prob")}), b AS ({_STEPS.format(x="prob_cal")}),
 u AS (SELECT cid, CASE WHEN any_value(pos) BETWEEN 1 AND any_value(rows) - 1 THEN round(sum(p / pos * tp / (tp + fp)), 9) END AS v FROM a GROUP BY cid),
 w AS (SELECT cid, CASE WHEN any_value(pos) BETWEEN 1 AND any_value(rows) - 1 THEN round(sum(p / pos * tp / (tp + fp)), 9) END AS v FROM b GROUP BY cid),
 f AS (SELECT cid, tp / (tp + fp) AS pr, CASE WHEN pos > 0 THEN tp / pos ELSE 0 END AS re, round(2 * tp / (tp + fp + pos), 9) AS f1, x FROM b),
 o AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY cid ORDER BY f1 DESC, x) = 1),
 c AS (SELECT cid, {AT_HALF.replace("prob", "prob_cal")} FROM few GROUP BY cid),
 h AS (SELECT cid, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END AS pr, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END AS re, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn)::DOUBLE ELSE 0 END AS f1 FROM c)
 SELECT count(*) AS topics, round(avg(u.v), 6) AS auprc, round(avg(w.v), 6) AS auprc_cal, round(avg(o.f1), 6) AS f1, round(avg(o.pr), 6) AS precision_best, round(avg(o.re), 6) AS recall_best,
  round(avg(h.f1), 6) AS f1_half, round(avg(h.pr), 6) AS precision_half, round(avg(h.re), 6) AS recall_half FROM u JOIN w USING (cid) JOIN o USING (cid) JOIN h USING (cid)"""
)
def macro_report(spark, sf):
    """Means over topics, one of which, the negatives of all, never occurs and has no area."""
    p = predictions(spark, sf).select("doc_id", "cid", "label", "prob", "prob_cal")
    never = p.where("label = 0").withColumn("cid", F.lit("never"))
    return assembly.macro_report(assembly.evidence_bundle(p.unionByName(never)))


@query(
    RECURSIVE
    + ADAM.format(k="cid", whole=WHOLE)
    + f""", r AS (SELECT cid, label, t, 1 / (1 + exp(-logit)) AS raw, 1 / (1 + exp(-logit / greatest(t, 1e-4))) AS cal FROM pred JOIN fitted ON k = cid),
 a AS (SELECT cid, round(sum(n * abs(acc - conf)) / sum(n), 9) AS e FROM (SELECT cid, {BIN.format(p="raw", b=10)} AS bin, count(*) AS n, avg(label) AS acc, avg(raw) AS conf FROM r GROUP BY ALL) GROUP BY cid),
 b AS (SELECT cid, round(sum(n * abs(acc - conf)) / sum(n), 9) AS e FROM (SELECT cid, {BIN.format(p="cal", b=10)} AS bin, count(*) AS n, avg(label) AS acc, avg(cal) AS conf FROM r GROUP BY ALL) GROUP BY cid)
 SELECT cid, round(t, 6) AS temperature, round(a.e, 6) AS ece_before, round(b.e, 6) AS ece_after, round(CASE WHEN a.e > 0 THEN (a.e - b.e) / a.e * 100 ELSE 0 END, 4) AS gain_pct FROM fitted JOIN a ON a.cid = k JOIN b USING (cid)"""
)
def calibration_fit(spark, sf):
    r = lambda c, n=6: F.round(c, n).alias(c)
    return assembly.calibrated_rows(predictions(spark, sf)).select("cid", r("temperature"), r("ece_before"), r("ece_after"), r("gain_pct", 4))


@query(RECURSIVE + ADAM.format(k="cid || '|' || fold", whole="") + " SELECT split_part(k, '|', 1) AS cid, round(avg(t), 5) AS mean, round(stddev_pop(t), 5) AS std, count(*) AS folds FROM fitted GROUP BY ALL")
def fold_temperatures(spark, sf):
    return assembly.temperature_spread(predictions(spark, sf)).select("cid", F.round("mean", 5).alias("mean"), F.round("std", 5).alias("std"), "folds")


@query(
    """WITH s AS (SELECT conv_id AS doc_id, turn AS sent_idx, role AS cid, round(length(text) / 100.0::DOUBLE, 6) AS logit FROM conversations),
 r AS (SELECT *, round(1 / (1 + exp(-logit)), 9) AS prob_cal FROM s), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, cid ORDER BY prob_cal DESC, sent_idx) AS i FROM r)
 SELECT doc_id, sent_idx, cid, [round(logit, 9), prob_cal, 0.0::DOUBLE, round(1 / (sent_idx + 1)::DOUBLE, 9), 0.0::DOUBLE] AS attrs FROM k WHERE i <= 2"""
)
def graph_support_topk(spark, sf):
    """Turns stand for passages, roles for topics; the two best of each pair."""
    s = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("sent_idx"), F.col("role").alias("cid"), F.round(F.length("text") / 100.0, 6).alias("logit"))
    s = s.withColumns({"prob_cal": F.round(1 / (1 + F.exp(-F.col("logit"))), 9), "dense": F.lit(None).cast("double"), "dense_rank": F.col("sent_idx"), "sparse_rank": F.lit(None).cast("int")})
    return assembly.support_edges(s, 2)


@query(with_sql("label_rows") + ", " + DESCRIBED_SQL + ", e AS (SELECT DISTINCT doc_id, cid FROM label_rows WHERE label = 1) SELECT doc_id, cid FROM e UNION ALL SELECT d.doc_id, t.cid FROM documents d CROSS JOIN described t WHERE d.doc_id NOT IN (SELECT doc_id FROM e)")
def graph_completed_pairs(spark, sf):
    return assembly.completed_pairs(documents(spark, sf), label_rows(spark, sf).where("label = 1"), _described(spark))


@query(
    """WITH e AS (SELECT conv_id * 1000 + turn AS src, conv_id * 1000 + lead(turn) OVER w AS dst, 'next' AS relation FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
  UNION ALL SELECT conv_id * 1000 + turn, conv_id * 1000 + min(turn) OVER (PARTITION BY conv_id), 'first' FROM conversations),
 n AS (SELECT conv_id * 1000 + turn AS id, length(text)::DOUBLE / 100 AS x, turn::DOUBLE AS y FROM conversations), h AS (SELECT unnest([1, 2]) AS head),
 s AS (SELECT dst, relation, head, 0.5 * (q.x * k.x * head + q.y * k.y) AS s, k.x, k.y FROM e JOIN n k ON k.id = e.src JOIN n q ON q.id = e.dst CROSS JOIN h),
 w AS (SELECT *, exp(s - max(s) OVER (PARTITION BY dst, relation, head)) AS w FROM s)
 SELECT dst, relation, head, round(sum(w * x) / sum(w), 6) AS x, round(sum(w * y) / sum(w), 6) AS y FROM w GROUP BY ALL"""
)
def graph_edge_attention(spark, sf):
    """Turns attend to the turn before, and first turns to all of their conversation, with two heads."""
    c = table(spark, sf, "conversations")
    at = lambda t: F.col("conv_id") * 1000 + F.col(t)
    first = c.join(c.groupBy("conv_id").agg(F.min("turn").alias("dst")), "conv_id").select(at("turn").alias("src"), at("dst").alias("dst"), F.lit("first").alias("relation"))
    edges = graph.next_edges(c, "conv_id", "turn").select(at("src").alias("src"), at("dst").alias("dst"), F.lit("next").alias("relation")).unionByName(first)
    x, y = F.length("text").cast("double") / 100, F.col("turn").cast("double")
    ends = c.select(at("turn").alias("id"), x.alias("x"), y.alias("y"), F.explode(F.array(F.lit(1), F.lit(2))).alias("head")).withColumn("relation", F.explode(F.array(F.lit("next"), F.lit("first"))))
    queries = ends.select(F.col("id").alias("dst"), "relation", "head", F.array(F.col("x") * F.col("head"), F.col("y")).alias("q"))
    keys = ends.select(F.col("id").alias("src"), "relation", "head", F.array("x", "y").alias("k"), F.array("x", "y").alias("v"))
    out = graph.edge_attention(queries, keys, edges, 0.5)
    return out.select("dst", "relation", "head", F.round(F.col("value")[0], 6).alias("x"), F.round(F.col("value")[1], 6).alias("y"))


@query(with_sql("passages") + " SELECT DISTINCT doc_id, [1.0::DOUBLE, 1.0, 1.0, 1.0] AS x FROM passages")
def graph_document_nodes(spark, sf):
    return assembly.document_nodes(passage_table(documents(spark, sf)))


@query(PRED + ", " + DESCRIBED_SQL + " SELECT doc_id, cid, is_core::INT AS is_core, length(text) / 100.0::DOUBLE AS desc_len, (prob >= 0.5)::INT AS y FROM pred JOIN described USING (cid)")
def graph_topic_nodes(spark, sf):
    return graph.topic_nodes(_described(spark), predictions(spark, sf))
