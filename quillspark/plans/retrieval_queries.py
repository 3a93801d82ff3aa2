"""Retrieval, fusion and ranking-metric queries over whole tables, with their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from quillspark.operators import calibration, classification, fusion, gates, matching, ranking, retrieval, splits
from quillspark.plans.base import SQL as PARTS
from quillspark.plans.base import documents, gold, label_rows, predictions, topics, vectors, with_sql, words_sql
from quillspark.scratch import Scratch

Q, SQL = {}, {}
KS = [1, 3, 5, 10, 20]


def query(sql: str | None = None):
    def add(fn):
        Q[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def _bm25(spark, sf, gold=None):
    """(words, topics, model): what ``matching`` asks for, of all documents, with their gold where it is given."""
    words, t = matching.document_words(documents(spark, sf), gold), matching.topic_matrix(topics(spark, sf))
    return words, t, matching.bm25_model(words, t)


def _with_gold(spark, sf):
    return _bm25(spark, sf, gold(spark, sf))


RETR = ("passages", "topics", "post", "terms")


@query(with_sql(*RETR, "bm25") + " SELECT doc_id, cid, sent_idx, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, cid ORDER BY score DESC, sent_idx) AS rank FROM bm25) WHERE rank <= 5")
def bm25_topk(spark, sf):
    words, t, model = _bm25(spark, sf)
    return matching.top(words, t, model, 5)


@query(
    with_sql(*RETR, "bm25")
    + """ SELECT doc_id, cid, sent_idx, score, rank FROM (
  SELECT p.doc_id, t.cid, p.sent_idx, coalesce(b.score, 0.0::DOUBLE) AS score,
         row_number() OVER (PARTITION BY p.doc_id, t.cid ORDER BY coalesce(b.score, 0.0::DOUBLE) DESC, p.sent_idx) AS rank
  FROM passages p CROSS JOIN topics t LEFT JOIN bm25 b ON b.doc_id = p.doc_id AND b.cid = t.cid AND b.sent_idx = p.sent_idx) WHERE rank <= 3"""
)
def bm25_zero_fill(spark, sf):
    words, t, model = _bm25(spark, sf)
    return matching.top(words, t, model, 3, fill=True)


@query(with_sql(*RETR, "sparse") + " SELECT doc_id, cid, sent_idx, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, cid ORDER BY score DESC, sent_idx) AS rank FROM sparse) WHERE rank <= 5")
def sparse_topk(spark, sf):
    t = matching.topic_matrix(topics(spark, sf))
    return matching.top(matching.document_words(documents(spark, sf)), t, matching.Cosine(t), 5)


def _grams(col: str) -> str:
    one = f"list_filter({words_sql(col)}, lambda x: length(x) >= 2)"
    return f"list_concat({one}, list_transform(range(1, len({one})), lambda i: ({one})[i] || ' ' || ({one})[i + 1]))"


VOCAB = f""" one AS (SELECT 0 AS src, doc_id, sent_idx, list_filter({words_sql("sent")}, lambda x: length(x) >= 2) AS w FROM passages
  UNION ALL SELECT 1, cid, 0, list_filter({words_sql("text")}, lambda x: length(x) >= 2) FROM topics),
 grams AS (SELECT src, doc_id, sent_idx, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM one),
 tf AS (SELECT src, doc_id, sent_idx, term, count(*) AS tf FROM grams GROUP BY ALL),
 vocab AS (SELECT term, "count", df, ln((1 + (SELECT count(*) FROM one))::DOUBLE / (1 + df)) + 1 AS idf FROM (SELECT term, sum(tf)::BIGINT AS "count", count(*) AS df FROM tf GROUP BY term ORDER BY sum(tf) DESC, term LIMIT 2048))"""


@query(with_sql("passages", "topics") + "," + VOCAB + ' SELECT term, "count", df, round(idf, 9) AS idf FROM vocab')
def ngram_vocab(spark, sf):
    return retrieval.tfidf_vocabulary(documents(spark, sf), topics(spark, sf)).withColumn("idf", F.round("idf", 9))


@query(
    with_sql("passages", "topics")
    + ","
    + VOCAB
    + """, x AS (SELECT src, doc_id, sent_idx, term, tf * idf AS x FROM tf JOIN vocab USING (term)),
 u AS (SELECT src, doc_id, sent_idx, term, x / (sqrt(sum(x * x) OVER (PARTITION BY src, doc_id, sent_idx)) + 1e-8) AS x FROM x),
 s AS (SELECT p.doc_id, q.doc_id AS cid, p.sent_idx, round(sum(p.x * q.x), 6) AS score FROM u p JOIN u q ON p.src = 0 AND q.src = 1 AND p.term = q.term GROUP BY ALL)
 SELECT doc_id, cid, sent_idx, score FROM s"""
)
def tfidf_cosine(spark, sf):
    return matching.tfidf_cosine(documents(spark, sf), topics(spark, sf))


DENSE = """ s AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: a.embedding[i]::DOUBLE * b.embedding[i]::DOUBLE)), 6) AS score
  FROM embeddings a JOIN embeddings b ON a.vec_id // 100 = b.vec_id // 100 AND a.vec_id <> b.vec_id),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)"""


@query("WITH" + DENSE + " SELECT query_id, vec_id, score, rank FROM r WHERE rank <= 5")
def dense_topk(spark, sf):
    """Hundred vectors stand for a document's passages: search stays within it."""
    v = vectors(spark, sf).withColumn("doc", F.floor(F.col("vec_id") / 100))
    return retrieval.top_k(retrieval.dense_scores(v, v, "doc"), 5, ("query_id",), "vec_id")


RANKS = (
    with_sql(*RETR, "bm25", "sparse")
    + """, dense AS (SELECT b.doc_id, b.cid, b.sent_idx, round(b.score * 0.1 + s.score, 6) AS score FROM bm25 b JOIN sparse s USING (doc_id, cid, sent_idx)),
 ranks AS (SELECT doc_id, cid, channel, sent_idx, rank FROM (
   SELECT *, row_number() OVER (PARTITION BY channel, doc_id, cid ORDER BY score DESC, sent_idx) AS rank FROM (
     SELECT 'bm25' AS channel, * FROM bm25 UNION ALL SELECT 'sparse', * FROM sparse UNION ALL SELECT 'dense', * FROM dense)) WHERE rank <= 10)"""
)


def _blend(cells):
    """The dense scores blend the two lexical ones, as no encoder is at hand."""
    return np.where(cells["bm25"] > -np.inf, matching.rounded(cells["bm25"] * 0.1 + cells["sparse"]), -np.inf)


FUSED = """ fused AS (SELECT {m} doc_id, cid, sent_idx, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, min(rank) FILTER (WHERE channel = 'dense') AS d, min(rank) FILTER (WHERE channel = 'sparse') AS s, min(rank) FILTER (WHERE channel = 'bm25') AS b FROM {t} GROUP BY {m} doc_id, cid, sent_idx),
 member AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {m} doc_id, cid ORDER BY score DESC, coalesce(d, 1000000000), coalesce(s, 1000000000), coalesce(b, 1000000000), sent_idx) AS i FROM fused) WHERE i <= 5),
 final AS (SELECT *, row_number() OVER (PARTITION BY {m} doc_id, cid ORDER BY score DESC, sent_idx) AS rank FROM member)"""


@query(RANKS + "," + FUSED.format(m="", t="ranks") + " SELECT doc_id, cid, sent_idx, score, rank FROM final")
def rrf_three_way(spark, sf):
    words, t, model = _bm25(spark, sf)
    modes = {"three_way_rrf": fusion.MODES["three_way_rrf"]}
    return matching.fused(words, t, {"bm25": model, "sparse": matching.Cosine(t)}, _blend, modes, 10, 60, 5).select("doc_id", "cid", "sent_idx", "score", "rank")


@query(
    RANKS
    + """, modes AS (SELECT * FROM (VALUES ('dense_only', 'dense'), ('native_hybrid', 'dense'), ('native_hybrid', 'sparse'), ('two_way_rrf', 'dense'), ('two_way_rrf', 'bm25'), ('three_way_rrf', 'dense'), ('three_way_rrf', 'sparse'), ('three_way_rrf', 'bm25')) v(mode, channel)),
 long AS (SELECT * FROM ranks JOIN modes USING (channel)),"""
    + FUSED.format(m="mode,", t="long")
    + ", "
    + with_sql("gold")[5:]
    + """, hit AS (SELECT f.mode, g.doc_id, g.cid, max((f.sent_idx IS NOT NULL)::INT) AS hit FROM gold g LEFT JOIN final f ON f.doc_id = g.doc_id AND f.cid = g.cid AND f.sent_idx = g.sent_idx WHERE f.mode IS NOT NULL GROUP BY ALL),
 n AS (SELECT count(*) AS n_gold FROM (SELECT DISTINCT doc_id, cid FROM gold)),
 m AS (SELECT mode, count(DISTINCT (doc_id, cid)) AS matched FROM final SEMI JOIN gold USING (doc_id, cid) GROUP BY mode)
 SELECT m.mode, matched, n_gold, round(coalesce((SELECT sum(hit) FROM hit WHERE hit.mode = m.mode), 0)::DOUBLE / matched, 9) AS recall, round(coalesce((SELECT sum(hit) FROM hit WHERE hit.mode = m.mode), 0)::DOUBLE / n_gold, 9) AS coverage FROM m, n"""
)
def rrf_modes_ablation(spark, sf):
    """Recall over the gold pairs that a mode retrieved anything for, coverage over all gold pairs."""
    words, t, model = _with_gold(spark, sf)
    final = matching.fused(words.where("gold IS NOT NULL"), t, {"bm25": model, "sparse": matching.Cosine(t)}, _blend, fusion.MODES, 10, 60, 5, of_gold=True)
    g = gold(spark, sf).distinct()
    pairs = g.select("doc_id", "cid").distinct()
    near = final.join(g.withColumn("_g", F.lit(1)), ["doc_id", "cid", "sent_idx"], "left")
    hit = near.groupBy("mode", "doc_id", "cid").agg(F.max(F.coalesce("_g", F.lit(0))).alias("hit"))
    n = pairs.agg(F.count("*").alias("n_gold")).withColumn("_j", F.lit(1))
    out = hit.groupBy("mode").agg(F.count("*").alias("matched"), F.sum("hit").alias("hits")).withColumn("_j", F.lit(1)).join(F.broadcast(n), "_j")
    return out.select("mode", "matched", "n_gold", F.round(F.col("hits") / F.col("matched"), 9).alias("recall"), F.round(F.col("hits") / F.col("n_gold"), 9).alias("coverage"))


@query(with_sql(*RETR, "bm25") + " SELECT doc_id, cid, sent_idx, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, cid ORDER BY score DESC, sent_idx) AS rank FROM bm25) WHERE rank <= CASE WHEN cid % 3 = 0 THEN greatest(3, 6) ELSE 3 END")
def dynamic_k_boost(spark, sf):
    """Every third topic is listed for a boost from 3 to 6."""
    listed = topics(spark, sf).select("cid", F.when(F.col("cid") % 3 == 0, 6).alias("boost"))
    ks = listed.select("cid", fusion.boosted_k(F.lit(3), F.col("boost")).alias("k"))
    words, t, model = _bm25(spark, sf)
    return matching.top(words, t, model, ks.agg(F.max("k")).first()[0] or 0).join(ks, "cid").where("rank <= k").select("doc_id", "cid", "sent_idx", "rank")


@query("""SELECT item_id AS cid, coalesce(CASE WHEN item_id % 7 = 0 THEN 0 END, nullif(item_id % 5, 0), nullif(item_id % 3, 0), 20)::BIGINT AS k FROM benchmark""")
def k_precedence(spark, sf):
    t = topics(spark, sf)
    c = F.col("cid")
    null = F.lit(None).cast("long")
    return t.select("cid", fusion.effective_k(F.when(c % 7 == 0, F.lit(0).cast("long")), c % 5, c % 3, F.lit(20).cast("long"), null).alias("k"))


def _ranked(spark, sf):
    """The first 20 passages, labelled, of every pair that has gold, for figures that sum over gold."""
    words, t, model = _with_gold(spark, sf)
    return matching.labelled_top(words.where("gold IS NOT NULL"), t, model, 20, of_gold=True)


CAND = with_sql(*RETR, "bm25", "gold") + ", cand AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, cid ORDER BY score DESC, sent_idx) AS rank FROM bm25) WHERE rank <= 20)"
PAIRS = """, g AS (SELECT DISTINCT doc_id, cid, sent_idx FROM gold),
 ks AS (SELECT unnest([1, 3, 5, 10, 20]) AS k),
 pm AS (SELECT doc_id, cid, k, count(*) AS n_gold, max(coalesce(rank <= k, false)::INT) AS hit, sum(coalesce(rank <= k, false)::INT)::DOUBLE / count(*) AS recall,
   coalesce(max(CASE WHEN rank <= k THEN 1.0::DOUBLE / rank END), 0.0) AS mrr,
   round(coalesce(sum(CASE WHEN rank <= k THEN 1 / log2(rank + 1.0) END), 0) / list_sum(list_transform(range(1, least(count(*), k) + 1), lambda i: 1 / log2(i + 1.0))), 9) AS ndcg
  FROM (SELECT g.doc_id, g.cid, k, c.rank FROM g CROSS JOIN ks LEFT JOIN cand c ON c.doc_id = g.doc_id AND c.cid = g.cid AND c.sent_idx = g.sent_idx) GROUP BY doc_id, cid, k)"""


@query(CAND + PAIRS + " SELECT doc_id, cid, k, n_gold, hit, recall, mrr, ndcg FROM pm")
def hit_mrr_ndcg_at_k(spark, sf):
    return ranking.pair_metrics(_ranked(spark, sf), gold(spark, sf), KS)


SWEEP = """, sw AS (SELECT 'overall' AS scope, NULL::BIGINT AS cid, k, round(avg(hit), 9) AS recall_at_k, round(avg((recall > 0)::INT), 9) AS coverage_at_k, round(avg(ndcg), 6) AS ndcg FROM pm GROUP BY k
 UNION ALL SELECT 'topic', cid, k, round(avg(hit), 9), round(avg((recall > 0)::INT), 9), round(avg(ndcg), 6) FROM pm GROUP BY cid, k)"""


def _sweep(spark, sf):
    r = lambda c, d=9: F.round(c, d).alias(c)
    return ranking.sweep(_ranked(spark, sf), gold(spark, sf), KS).select("scope", "cid", "k", r("recall_at_k"), r("coverage_at_k"), r("ndcg", 6))


@query(CAND + PAIRS + SWEEP + " SELECT * FROM sw")
def sweep_k(spark, sf):
    return _sweep(spark, sf)


@query(
    CAND
    + PAIRS
    + SWEEP
    + """ SELECT scope, cid, coalesce(min(k) FILTER (WHERE recall_at_k >= 0.9 AND coverage_at_k >= 0.9), arg_min(k, (-recall_at_k, k))) AS k,
  bool_or(recall_at_k >= 0.9 AND coverage_at_k >= 0.9) AS passed, NOT bool_or(recall_at_k >= 0.9 AND coverage_at_k >= 0.9) AS needs_help FROM sw GROUP BY scope, cid"""
)
def select_k(spark, sf):
    return gates.select_k(_sweep(spark, sf), 0.9, 0.9)


@query(CAND + """, g AS (SELECT DISTINCT doc_id, cid, sent_idx FROM gold), x AS (SELECT g.cid, c.sent_idx IS NOT NULL AS r FROM g LEFT JOIN cand c USING (doc_id, cid, sent_idx))
 SELECT CASE WHEN grouping(cid) = 1 THEN 'overall' ELSE 'topic' END AS scope, cid, count(*) FILTER (WHERE r) AS retrieved, count(*) AS gold, count(*) FILTER (WHERE r) / count(*)::DOUBLE AS recall FROM x GROUP BY GROUPING SETS ((), (cid))""")
def retrieval_recall(spark, sf):
    return ranking.set_recall(_ranked(spark, sf), gold(spark, sf)).select("scope", "cid", "retrieved", "gold", "recall")


LABELLED = CAND + ", lab AS (SELECT c.doc_id, c.cid, c.sent_idx, c.score, c.rank, (g.doc_id IS NOT NULL)::INT AS label FROM cand c LEFT JOIN (SELECT DISTINCT doc_id, cid, sent_idx FROM gold) g ON g.doc_id = c.doc_id AND g.cid = c.cid AND g.sent_idx = c.sent_idx)"


@query(LABELLED + " SELECT k, sum(CASE WHEN rank <= k THEN label ELSE 0 END) / sum(label)::DOUBLE AS recall FROM lab CROSS JOIN (SELECT unnest([1, 5, 20]) AS k) GROUP BY k")
def recall_at_k_grouped(spark, sf):
    return ranking.pooled_at_k(_ranked(spark, sf), [1, 5, 20], "score")


@query(LABELLED + ", b AS (SELECT * FROM lab ORDER BY score DESC, doc_id, cid, sent_idx LIMIT 100) SELECT 100 AS k, avg(label) AS precision, sum(label) / (SELECT sum(label) FROM lab)::DOUBLE AS coverage FROM b")
def precision_at_k_global(spark, sf):
    """The report of the best 100 rows over all groups."""
    words, t, model = _with_gold(spark, sf)
    rows = matching.labelled_top(words, t, model, 20, reduce=matching.first_rows(100))
    return ranking.global_precision(Scratch(spark, "best").keep(rows), 100, "score", ["doc_id", "cid", "sent_idx"])


@query(CAND + ", g AS (SELECT DISTINCT doc_id, cid, sent_idx FROM gold) SELECT doc_id, cid, count(c.rank) / 5.0::DOUBLE AS precision, (count(c.rank) > 0)::INT AS covered FROM g LEFT JOIN (SELECT * FROM cand WHERE rank <= 5) c USING (doc_id, cid, sent_idx) GROUP BY doc_id, cid")
def set_precision_at_k(spark, sf):
    return ranking.set_precision(_ranked(spark, sf), gold(spark, sf), 5)


@query(CAND + """, p AS (SELECT doc_id, cid FROM cand SEMI JOIN gold USING (doc_id, cid) GROUP BY ALL)
 SELECT c.doc_id, c.cid, c.sent_idx, (g.doc_id IS NOT NULL)::INT AS label FROM cand c LEFT JOIN (SELECT DISTINCT doc_id, cid, sent_idx FROM gold) g ON g.doc_id = c.doc_id AND g.cid = c.cid AND g.sent_idx = c.sent_idx
 UNION ALL SELECT doc_id, cid, sent_idx, 0 FROM cand ANTI JOIN gold USING (doc_id, cid) WHERE rank <= 5""")
def pair_mining(spark, sf):
    return matching.mined_pairs(*_with_gold(spark, sf), 20)


@query("SELECT event_type, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95, count(value) AS n FROM events GROUP BY event_type")
def latency_percentiles(spark, sf):
    from quillspark.session import table

    return ranking.latency(table(spark, sf, "events"), "value", "event_type")


@query("WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) SELECT event_type, q, value FROM r CROSS JOIN (SELECT unnest([0.5::DOUBLE, 0.95::DOUBLE]) AS q) WHERE i = floor(q * (n - 1))")
def latency_floor_percentiles(spark, sf):
    from quillspark.session import table

    return ranking.floor_percentiles(table(spark, sf, "events"), "value", "event_type", [0.5, 0.95])


@query(CAND + """, x AS (SELECT label, k FROM (SELECT c.rank, (g.doc_id IS NOT NULL)::INT AS label FROM cand c LEFT JOIN (SELECT DISTINCT doc_id, cid, sent_idx FROM gold) g ON g.doc_id = c.doc_id AND g.cid = c.cid AND g.sent_idx = c.sent_idx) CROSS JOIN (SELECT unnest([1, 3, 5, 10, 20]) AS k) WHERE rank <= k),
 f AS (SELECT k, round(2 * sum(label) / (count(*) + (SELECT count(*) FROM (SELECT DISTINCT doc_id, cid, sent_idx FROM gold)))::DOUBLE, 9) AS f1 FROM x GROUP BY k)
 SELECT min(k) AS k, (SELECT max(f1) FROM f) AS best FROM f WHERE (SELECT max(f1) FROM f) - f1 <= 0.005""")
def k_sensitivity(spark, sf):
    """F1 of taking the first k candidates of every pair; the smallest k near the best."""
    n = gold(spark, sf).distinct().count()
    rows = matching.rank_counts(*_with_gold(spark, sf), 20).withColumn("k", F.explode(F.array(*[F.lit(k) for k in KS]))).where("rank <= k")
    f = rows.groupBy("k").agg(F.round(2 * F.sum("hits") / (F.sum("n") + F.lit(n)), 9).alias("f1"))
    return gates.smallest_sufficient_k(f)


@query(
    with_sql("label_rows", "pred")
    + """, kept AS (SELECT doc_id, cid, fold AS sent_idx, prob AS score, row_number() OVER (PARTITION BY doc_id, cid ORDER BY prob DESC, fold) AS rank FROM pred WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en') AND cid = 'quality')
 SELECT doc_id, cid, sent_idx, score, rank FROM kept WHERE rank <= 3"""
)
def fold_retrieval_filter(spark, sf):
    rows = predictions(spark, sf).select("doc_id", "cid", F.col("fold").alias("sent_idx"), F.col("prob").alias("score"), F.lit(0).alias("ordinal"))
    english = documents(spark, sf).where("lang = 'en'").select("doc_id")
    return fusion.fold_filter(rows, english, 3, ["quality"]).select("doc_id", "cid", "sent_idx", "score", "rank")


GATES_SQL = """(VALUES ('retrieval_recall@20_overall', 'recall@20', 0.95, 'gte'), ('retrieval_recall@20_per_criterion', 'recall@20_min', 0.9, 'gte'),
  ('evidence_auprc', 'auprc', 0.75, 'gte'), ('evidence_f1', 'f1', 0.7, 'gte'), ('evidence_precision@5', 'precision@5', 0.85, 'gte'),
  ('evidence_coverage@5', 'coverage@5', 0.8, 'gte'), ('evidence_ece', 'ece', 0.1, 'lte'), ('calibration_improvement', 'improvement_pct', 20, 'gte')) v(name, metric, threshold, comparison)"""
ECE_SQL = "(SELECT round(sum(n * abs(acc - conf)) / sum(n), 9) AS e FROM (SELECT count(*) AS n, avg(label) AS acc, avg({p}) AS conf FROM pred GROUP BY least(greatest(floor({p} * 10), 0), 9)))"


@query(
    CAND
    + PAIRS
    + SWEEP
    + ", "
    + PARTS["label_rows"]
    + ", "
    + PARTS["pred"]
    + f""", steps AS (SELECT prob, sum(label)::DOUBLE AS p, count(*)::DOUBLE AS n FROM pred GROUP BY prob),
 c AS (SELECT p, sum(p) OVER down AS tp, sum(n) OVER down AS k FROM steps WINDOW down AS (ORDER BY prob DESC ROWS UNBOUNDED PRECEDING)),
 best AS (SELECT label FROM pred ORDER BY prob DESC, doc_id, cid LIMIT 5), b AS (SELECT e FROM {ECE_SQL.format(p="prob")}), a AS (SELECT e FROM {ECE_SQL.format(p="prob_cal")}),
 np AS (SELECT doc_id, sum(label)::BIGINT AS n_pos FROM label_rows GROUP BY doc_id),
 fo AS (SELECT doc_id, ((row_number() OVER (ORDER BY n_pos, doc_id) - 1) % 5)::INT AS fold FROM np),
 m AS (SELECT 'recall@20' AS metric, recall_at_k AS value FROM sw WHERE scope = 'overall' AND k = 20
  UNION ALL SELECT 'recall@20_min', min(recall_at_k) FROM sw WHERE scope = 'topic' AND k = 20
  UNION ALL SELECT 'auprc', round(sum(p * tp / k) / sum(p), 9) FROM c
  UNION ALL SELECT 'f1', 2 * count(*) FILTER (WHERE prob >= 0.5 AND label = 1) / (count(*) FILTER (WHERE prob >= 0.5) + sum(label))::DOUBLE FROM pred
  UNION ALL SELECT 'precision@5', avg(label) FROM best
  UNION ALL SELECT 'coverage@5', sum(label) / (SELECT sum(label) FROM pred)::DOUBLE FROM best
  UNION ALL SELECT 'ece', e FROM a UNION ALL SELECT 'initial_ece', e FROM b
  UNION ALL SELECT 'improvement_pct', round((b.e - a.e) / b.e * 100, 6) FROM a, b)
 SELECT name, coalesce(value, 0) AS value, threshold::DOUBLE AS threshold, CASE comparison WHEN 'gte' THEN coalesce(value, 0) >= threshold ELSE coalesce(value, 0) <= threshold END AS passed
 FROM {GATES_SQL} LEFT JOIN m USING (metric) WHERE metric <> 'improvement_pct' OR (SELECT e FROM b) > 0.05
 UNION ALL SELECT 'data_leakage_fold' || h.fold, count(t.doc_id)::DOUBLE, 0::DOUBLE, count(t.doc_id) = 0
  FROM (SELECT DISTINCT fold FROM fo) h LEFT JOIN fo t ON t.fold = h.fold AND t.doc_id IN (SELECT doc_id FROM fo x WHERE x.fold <> h.fold) GROUP BY h.fold"""
)
def quality_gates(spark, sf):
    """Every gate on the figures of the queries above and of the predictions."""
    p = predictions(spark, sf)
    as_metric = lambda df, value, name: df.select(F.lit(name).alias("metric"), F.col(value).cast("double").alias("value"))
    best = ranking.global_precision(p, 5, "prob", ["doc_id", "cid"])
    before, after = calibration.ece(p, []), calibration.ece(p, [], prob="prob_cal")
    gain = before.select(F.lit(1).alias("_j"), F.col("ece").alias("before")).join(after.select(F.lit(1).alias("_j"), F.col("ece").alias("after")), "_j")
    parts = [
        gates.sweep_to_gates(_sweep(spark, sf), 20),
        as_metric(classification.curve_areas(p.withColumn("all", F.lit(0)), ["all"]), "average_precision", "auprc"),
        as_metric(classification.prf(p, []), "f1", "f1"),
        as_metric(best, "precision", "precision@5"),
        as_metric(best, "coverage", "coverage@5"),
        as_metric(after, "ece", "ece"),
        as_metric(before, "ece", "initial_ece"),
        as_metric(gain.select(F.round(calibration.improvement(F.col("before"), F.col("after")), 6).alias("x")), "x", "improvement_pct"),
    ]
    metrics = parts[0]
    for part in parts[1:]:
        metrics = metrics.unionByName(part)
    folds = splits.round_robin_folds(label_rows(spark, sf).groupBy("doc_id").agg(F.sum("label").alias("n_pos")), 5)
    return gates.check_gates(metrics, gates.gate_table(spark)).unionByName(gates.leakage_gates(splits.leakage(splits.dev_tail(folds), folds)))
