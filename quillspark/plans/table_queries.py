"""Metric, calibration, split, sampling, graph and text queries over whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions import text as T
from quillspark.operators import calibration, classification, graph, groundtruth, matching, ranking, sampling, scoring, splits
from quillspark.plans.base import documents, gold, label_rows, predictions, topics, vectors, with_sql, words_sql
from quillspark.scratch import Scratch, build_side
from quillspark.session import table

Q, SQL = {}, {}
PRED = with_sql("label_rows", "pred")


def query(sql: str | None = None):
    def add(fn):
        Q[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


# --- classification ---------------------------------------------------------

COUNTS = "count(*) FILTER (WHERE {p} >= {t} AND label = 1) AS tp, count(*) FILTER (WHERE {p} >= {t} AND label = 0) AS fp, count(*) FILTER (WHERE {p} < {t} AND label = 1) AS fn, count(*) FILTER (WHERE {p} < {t} AND label = 0) AS tn"
PRF = "CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn)::DOUBLE ELSE 0 END AS f1, (tp + tn) / (tp + fp + fn + tn)::DOUBLE AS accuracy"
AT_HALF = COUNTS.format(p="prob", t="0.5")


@query(PRED + f", c AS (SELECT cid, fold, {AT_HALF} FROM pred GROUP BY GROUPING SETS ((), (cid), (fold))) SELECT cid, fold, tp, fp, fn, tn, {PRF} FROM c")
def prf_overall_topic_fold(spark, sf):
    return classification.prf_sets(predictions(spark, sf), [[], ["cid"], ["fold"]]).drop("gid")


@query(PRED + f", c AS (SELECT cid, {AT_HALF} FROM pred GROUP BY cid), p AS (SELECT *, {PRF} FROM c) SELECT avg(f1) AS macro_f1, 2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn))::DOUBLE AS micro_f1 FROM p")
def f1_macro_micro(spark, sf):
    return classification.macro_micro(predictions(spark, sf), "cid")


CURVE = """, g AS (SELECT cid, prob AS threshold, sum(label) AS p, sum(1 - label) AS n FROM pred GROUP BY cid, prob),
 c AS (SELECT cid, threshold, sum(p) OVER down AS tp, sum(n) OVER down AS fp, sum(p) OVER (PARTITION BY cid) AS pos, sum(n) OVER (PARTITION BY cid) AS neg, p, n FROM g
  WINDOW down AS (PARTITION BY cid ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING)),
 k AS (SELECT cid, threshold, tp::DOUBLE AS tp, fp::DOUBLE AS fp, pos::DOUBLE AS pos, neg::DOUBLE AS neg, (tp - p)::DOUBLE AS ptp, (fp - n)::DOUBLE AS pfp FROM c)"""


@query(
    PRED
    + CURVE
    + """ SELECT cid, round(sum((tp - ptp) / pos * tp / (tp + fp)), 9) AS average_precision, round(sum((fp - pfp) * (tp + ptp) / 2 / neg / pos), 9) AS auroc,
 round(sum((tp - ptp) / pos * (tp / (tp + fp) + CASE WHEN ptp + pfp > 0 THEN ptp / (ptp + pfp) ELSE 1 END) / 2), 9) AS pr_auc FROM k GROUP BY cid"""
)
def curve_areas(spark, sf):
    return classification.curve_areas(predictions(spark, sf), ["cid"])


@query(PRED + CURVE + " SELECT cid, threshold, tp::BIGINT AS tp, fp::BIGINT AS fp, pos::BIGINT AS pos, neg::BIGINT AS neg FROM k")
def pr_roc_points(spark, sf):
    return classification.curve(predictions(spark, sf), ["cid"]).select("cid", "threshold", "tp", "fp", "pos", "neg")


@query(PRED + " SELECT cid, label, (prob >= 0.5)::INT AS predicted, count(*) AS n FROM pred GROUP BY ALL")
def confusion_matrix(spark, sf):
    return classification.confusion(predictions(spark, sf), ["cid"])


@query(
    PRED
    + f""", x AS (SELECT label, (prob >= 0.5)::INT AS hat, c FROM pred CROSS JOIN (SELECT unnest([0, 1]) AS c)),
 n AS (SELECT c, count(*) FILTER (WHERE label = c AND hat = c) AS tp, count(*) FILTER (WHERE label <> c AND hat = c) AS fp, count(*) FILTER (WHERE label = c AND hat <> c) AS fn, count(*) FILTER (WHERE label <> c AND hat <> c) AS tn, count(*) FILTER (WHERE label = c) AS support FROM x GROUP BY c),
 p AS (SELECT c, support, {PRF} FROM n)
 SELECT c::VARCHAR AS class, precision, recall, f1, support FROM p UNION ALL SELECT 'macro', avg(precision), avg(recall), avg(f1), sum(support)::BIGINT FROM p
 UNION ALL SELECT 'weighted', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support)::BIGINT FROM p"""
)
def classification_report(spark, sf):
    return classification.report(predictions(spark, sf))


@query(PRED + " SELECT cid, round(avg(-(label * ln(greatest(least(prob, 1 - 1e-8), 1e-8)) + (1 - label) * ln(1 - greatest(least(prob, 1 - 1e-8), 1e-8)))), 9) AS bce, round(avg(CASE WHEN label = 1 THEN -0.25 * (1 - prob) ** 2 * ln(prob) ELSE -0.75 * prob ** 2 * ln(1 - prob) END), 9) AS focal FROM pred GROUP BY cid")
def losses(spark, sf):
    p, y = F.col("prob"), F.col("label")
    return predictions(spark, sf).groupBy("cid").agg(F.round(F.avg(classification.bce(p, y)), 9).alias("bce"), F.round(F.avg(classification.focal_loss(p, y)), 9).alias("focal"))


@query(PRED + f", t AS (SELECT *, CASE cid WHEN 'quality' THEN 0.6 ELSE 0.5 END AS thr FROM pred) SELECT doc_id, cid, label, prob, (prob >= thr)::INT AS predicted FROM t")
def apply_thresholds(spark, sf):
    t = spark.createDataFrame([("quality", 0.6)], "cid string, threshold double")
    return calibration.apply_thresholds(predictions(spark, sf).select("doc_id", "cid", "label", "prob"), t)


THR = """, f AS (SELECT cid, threshold, pos, neg, round(%s, 12) AS f1 FROM (SELECT *, tp / (tp + fp) AS pr, CASE WHEN pos > 0 THEN tp / pos ELSE 0 END AS re FROM k)),
 b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY f1 DESC, threshold) AS i FROM f) WHERE i = 1)"""
PLAIN = "CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END"


@query(PRED + CURVE + THR % PLAIN + " SELECT cid, CASE WHEN pos = 0 OR pos + neg < 10 THEN 0.5 ELSE threshold END AS threshold, round(f1, 9) AS f1 FROM b")
def per_class_threshold_opt(spark, sf):
    return calibration.best_thresholds(predictions(spark, sf), ["cid"], "optimizer")


@query(PRED + CURVE + THR % PLAIN + " SELECT cid, CASE WHEN pos = 0 THEN 1.0 WHEN neg = 0 THEN 0.0 ELSE threshold END AS threshold, round(f1, 9) AS f1 FROM b")
def per_class_threshold_cv(spark, sf):
    return calibration.best_thresholds(predictions(spark, sf), ["cid"], "crossval")


@query(PRED + CURVE + THR % PLAIN + " SELECT cid, CASE WHEN f1 <= 0 THEN 1.0 ELSE threshold END AS threshold, round(f1, 9) AS f1 FROM b")
def per_class_threshold_endpoint(spark, sf):
    return calibration.best_thresholds(predictions(spark, sf), ["cid"], "endpoint")


@query(PRED + CURVE + THR % "2 * pr * re / (pr + re + 1e-10)" + " SELECT cid, CASE WHEN f1 <= 0 THEN 0.5 ELSE threshold END AS threshold, round(f1, 9) AS f1 FROM b")
def per_class_threshold_eval(spark, sf):
    return calibration.best_thresholds(predictions(spark, sf), ["cid"], "report")


# --- calibration --------------------------------------------------------------

BIN = "least(greatest(floor({p} * {b}), 0), {b} - 1)::INT"


@query(
    PRED
    + f""", e AS (SELECT cid, 'raw' AS kind, {BIN.format(p="prob", b=10)} AS bin, count(*) AS n, avg(label) AS acc, avg(prob) AS conf FROM pred GROUP BY ALL
 UNION ALL SELECT cid, 'calibrated', {BIN.format(p="prob_cal", b=10)}, count(*), avg(label), avg(prob_cal) FROM pred GROUP BY ALL
 UNION ALL SELECT cid, 'swapped', {BIN.format(p="label", b=15)}, count(*), avg(prob), avg(label) FROM pred GROUP BY ALL)
 SELECT cid, kind, round(sum(n * abs(acc - conf)) / sum(n), 9) AS ece FROM e GROUP BY cid, kind"""
)
def ece(spark, sf):
    p = predictions(spark, sf)
    parts = [calibration.ece(p, ["cid"]).withColumn("kind", F.lit("raw")), calibration.ece(p, ["cid"], prob="prob_cal").withColumn("kind", F.lit("calibrated")), calibration.ece(p, ["cid"], 15, "label", "prob").withColumn("kind", F.lit("swapped"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(PRED + f", e AS (SELECT cid, {BIN.format(p='prob', b=10)} AS bin, count(*) AS n, avg(label) AS acc, avg(prob) AS conf FROM pred GROUP BY ALL), g AS (SELECT DISTINCT cid, b::INT AS bin FROM pred CROSS JOIN range(10) r(b)) SELECT cid, bin, coalesce(n, 0) AS n, round(coalesce(acc, 0), 9) AS acc, round(coalesce(conf, 0), 9) AS conf FROM g LEFT JOIN e USING (cid, bin)")
def reliability_bins(spark, sf):
    return calibration.reliability(predictions(spark, sf), ["cid"])


@query(PRED + ", x AS (SELECT cid, label, greatest(least(1 / (1 + exp(-logit / 1.5)), 1 - 1e-8), 1e-8) AS p FROM pred) SELECT cid, round(avg(-(label * ln(p) + (1 - label) * ln(1 - p))), 9) AS nll FROM x GROUP BY cid")
def nll(spark, sf):
    return calibration.nll(predictions(spark, sf), ["cid"], 1.5)


@query(
    PRED
    + f""", e AS (SELECT cid, {BIN.format(p="prob", b=10)} AS bin, count(*) AS n, avg(label) AS acc, avg(prob) AS conf FROM pred GROUP BY ALL),
 a AS (SELECT cid, round(sum(n * abs(acc - conf)) / sum(n), 9) AS before FROM e GROUP BY cid),
 f AS (SELECT cid, {BIN.format(p="prob_cal", b=10)} AS bin, count(*) AS n, avg(label) AS acc, avg(prob_cal) AS conf FROM pred GROUP BY ALL),
 b AS (SELECT cid, round(sum(n * abs(acc - conf)) / sum(n), 9) AS after FROM f GROUP BY cid)
 SELECT cid, before, after, round(before - after, 9) AS gain, round(CASE WHEN before > 0 THEN (before - after) / before * 100 ELSE 0 END, 6) AS gain_pct FROM a JOIN b USING (cid)"""
)
def calibration_comparison(spark, sf):
    p = predictions(spark, sf)
    a, b = calibration.ece(p, ["cid"]).withColumnRenamed("ece", "before"), calibration.ece(p, ["cid"], prob="prob_cal").withColumnRenamed("ece", "after")
    return a.join(b, "cid").select("cid", "before", "after", F.round(F.col("before") - F.col("after"), 9).alias("gain"), F.round(calibration.improvement(F.col("before"), F.col("after")), 6).alias("gain_pct"))


# Adam's steps as a recursion over groups: k is a group, i a step.
ADAM = """, cells AS (SELECT {k} AS k, round(logit, 4) AS x, sum(label)::DOUBLE AS pos, count(*)::DOUBLE AS n FROM pred GROUP BY ALL{whole}),
 adam AS (SELECT DISTINCT k, 0 AS i, 1.0::DOUBLE AS t, 0.0::DOUBLE AS m, 0.0::DOUBLE AS v FROM cells
  UNION ALL SELECT k, i, greatest(1e-3, t - 0.01 * (m / (1 - pow(0.9::DOUBLE, i))) / (sqrt(v / (1 - pow(0.999::DOUBLE, i))) + 1e-8)) AS t, m, v FROM (
   SELECT k, i + 1 AS i, t, 0.9 * m + 0.1 * g AS m, 0.999 * v + 0.001 * g * g AS v FROM (
    SELECT adam.k, i, t, m, v, sum((n / (1 + exp(-x / t)) - pos) * -x) / sum(n) / (t * t) AS g FROM adam JOIN cells ON cells.k = adam.k WHERE i < 200 GROUP BY adam.k, i, t, m, v))),
 fitted AS (SELECT k, t FROM adam WHERE i = 200)"""
RECURSIVE = PRED.replace("WITH", "WITH RECURSIVE", 1)
WHOLE = " UNION ALL SELECT '*', round(logit, 4), sum(label)::DOUBLE, count(*)::DOUBLE FROM pred GROUP BY round(logit, 4)"


@query(RECURSIVE + ADAM.format(k="cid", whole=WHOLE) + " SELECT nullif(k, '*') AS cid, round(t, 6) AS temperature FROM fitted")
def temperature_fit(spark, sf):
    return calibration.temperatures(predictions(spark, sf), "cid").select("cid", F.round("temperature", 6).alias("temperature"))


@query(PRED + " SELECT cid, round(avg(prob), 9) AS mean, round(stddev_pop(prob), 9) AS std FROM (SELECT cid, fold, avg(prob) AS prob FROM pred GROUP BY cid, fold) GROUP BY cid")
def fold_summary(spark, sf):
    f = predictions(spark, sf).groupBy("cid", "fold").agg(F.avg("prob").alias("prob"))
    return f.groupBy("cid").agg(F.round(F.avg("prob"), 9).alias("mean"), F.round(F.stddev_pop("prob"), 9).alias("std"))


@query(PRED + " SELECT cid, count(*) AS n, round(avg(logit), 6) AS mean, quantile_cont(logit, 0.5) AS median, round(stddev_samp(logit), 6) AS stdev, min(logit) AS least, max(logit) AS most, quantile_cont(logit, 0.5) FILTER (WHERE label = 1) AS median_pos, quantile_cont(logit, 0.5) FILTER (WHERE label = 0) AS median_neg, round(avg(prob_cal - prob), 6) AS shift FROM pred GROUP BY cid")
def status_report(spark, sf):
    rows = predictions(spark, sf)
    medians = ranking.percentiles(rows, ["cid"], "logit", {"median": (0.5, None), "median_pos": (0.5, F.col("label") == 1), "median_neg": (0.5, F.col("label") == 0)})
    moments = rows.groupBy("cid").agg(F.count("*").alias("n"), F.round(F.avg("logit"), 6).alias("mean"), F.round(F.stddev_samp("logit"), 6).alias("stdev"), F.min("logit").alias("least"), F.max("logit").alias("most"), F.round(F.avg(F.col("prob_cal") - F.col("prob")), 6).alias("shift"))
    return moments.join(medians, "cid").select("cid", "n", "mean", "median", "stdev", "least", "most", "median_pos", "median_neg", "shift")


# --- scoring and aggregation --------------------------------------------------

CHUNKS = f"""w AS (SELECT doc_id, {words_sql("text")} AS w FROM documents),
 ch AS (SELECT doc_id, unnest(range(0, (ceil(greatest(len(w) - 64, 0) / 48.0) * 48)::BIGINT + 1, 48))::INT AS start, w FROM w),
 cs AS (SELECT doc_id, start, w[start + 1:start + 64] AS c FROM ch),
 sc AS (SELECT doc_id, start, len(c)::INT AS n_words, len(c) / 64.0::DOUBLE * 0.5 + (start % 7)::DOUBLE / 14.0 AS prob FROM cs)"""


def _chunk_scores(spark, sf):
    c = documents(spark, sf).select("doc_id", F.explode(T.chunks(T.tokens(F.col("text")), 64, 16)).alias("c")).select("doc_id", "c.start", F.size("c.words").alias("n_words"))
    return c.withColumn("prob", F.col("n_words") / 64.0 * 0.5 + (F.col("start") % 7) / 14.0)


@query(f"WITH {CHUNKS} SELECT doc_id, start, n_words FROM sc")
def chunk_windows(spark, sf):
    return _chunk_scores(spark, sf).select("doc_id", "start", "n_words")


@query(f"WITH {CHUNKS} SELECT doc_id, max(prob) AS prob FROM sc GROUP BY doc_id")
def chunk_agg_max(spark, sf):
    return scoring.aggregate_chunks(_chunk_scores(spark, sf), ["doc_id"], "max")


@query(f"WITH {CHUNKS} SELECT doc_id, round(list_sum(list_sort(list(prob), 'DESC')[1:3]) / 3, 9) AS prob FROM sc GROUP BY doc_id")
def chunk_agg_topm(spark, sf):
    return scoring.aggregate_chunks(_chunk_scores(spark, sf), ["doc_id"], "topm", 3)


@query(f"WITH {CHUNKS}, m AS (SELECT doc_id, max(prob) AS m FROM sc GROUP BY doc_id) SELECT doc_id, round(any_value(m) + ln(sum(exp(prob - m))), 9) AS prob FROM sc JOIN m USING (doc_id) GROUP BY doc_id")
def chunk_agg_logsumexp(spark, sf):
    return scoring.aggregate_chunks(_chunk_scores(spark, sf), ["doc_id"], "logsumexp")


@query(PRED + ", e AS (SELECT doc_id, round(avg(prob), 9) AS prob, round(avg(logit), 9) AS logit FROM pred GROUP BY doc_id), c AS (SELECT *, round(1 / (1 + exp(-logit / 1.3)), 9) AS prob_cal FROM e) SELECT doc_id, prob, logit, prob_cal, (prob_cal >= 0.5)::INT AS predicted FROM c")
def fold_ensemble(spark, sf):
    return scoring.ensemble(predictions(spark, sf), ["doc_id"], 1.3)


@query(PRED + " SELECT doc_id, cid, round(CASE WHEN logit <> 0 THEN (logit - (SELECT avg(logit) FROM pred)) / (SELECT stddev_pop(logit) FROM pred) ELSE 0 END, 6) AS z FROM pred")
def score_standardise(spark, sf):
    return scoring.standardised(predictions(spark, sf).select("doc_id", "cid", "logit"), "logit", "z").select("doc_id", "cid", "z")


@query("SELECT label, list(x ORDER BY i) AS embedding FROM (SELECT label, i, round(avg(x), 6) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i) GROUP BY label")
def post_embedding_mean(spark, sf):
    return scoring.mean_vector(vectors(spark, sf), "label", "embedding")


@query(PRED + ", e AS (SELECT cid, max(prob) AS edge FROM pred GROUP BY cid), n AS (SELECT cid, avg(prob_cal) AS prob FROM pred GROUP BY cid) SELECT round(avg(greatest(abs(edge - prob) - 0.1, 0)), 9) AS penalty FROM e JOIN n USING (cid)")
def consistency_penalty(spark, sf):
    p = predictions(spark, sf)
    return scoring.consistency_penalty(p, p.groupBy("cid").agg(F.avg("prob_cal").alias("prob")), ["cid"], 0.1)


@query(f"WITH w AS (SELECT list_distinct({words_sql('b.text')}) AS b, list_distinct({words_sql('d.text')}) AS d, item_id, doc_id FROM documents d CROSS JOIN benchmark b) SELECT doc_id, item_id AS cid, round(len(list_intersect(d, b))::DOUBLE / greatest(len(b), 1) * 8 - 4, 6) AS logit FROM w")
def lexical_scores(spark, sf):
    """The default scorer on all pairs of documents and topics."""
    return matching.text_shares(documents(spark, sf), topics(spark, sf))


# --- splits and sampling ------------------------------------------------------

POS = with_sql("label_rows") + ", np AS (SELECT doc_id, sum(label)::BIGINT AS n_pos FROM label_rows GROUP BY doc_id), fo AS (SELECT doc_id, ((row_number() OVER (ORDER BY n_pos, doc_id) - 1) % 5)::INT AS fold FROM np)"


def _folds(spark, sf):
    return splits.round_robin_folds(label_rows(spark, sf).groupBy("doc_id").agg(F.sum("label").alias("n_pos")), 5)


@query(POS + " SELECT doc_id, fold FROM fo")
def fold_round_robin(spark, sf):
    return _folds(spark, sf)


@query(POS + ", t AS (SELECT h.fold, f.doc_id FROM fo f JOIN (SELECT DISTINCT fold FROM fo) h ON f.fold <> h.fold) SELECT fold, doc_id, CASE WHEN row_number() OVER (PARTITION BY fold ORDER BY doc_id DESC) <= greatest(1, count(*) OVER (PARTITION BY fold) // 10) THEN 'dev' ELSE 'train' END AS part FROM t")
def dev_tail(spark, sf):
    return splits.dev_tail(_folds(spark, sf))


@query("WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY md5('7|' || doc_id), doc_id) - 1 AS pos, count(*) OVER () AS n FROM documents) SELECT doc_id, CASE WHEN pos < floor(n * 0.8) THEN 'train' WHEN pos < floor(n * 0.8) + floor(n * 0.1) THEN 'dev' ELSE 'test' END AS split FROM o")
def ratio_split(spark, sf):
    return splits.ratio_split(documents(spark, sf), 0.8, 0.1, 7)


@query(with_sql("label_rows") + ", p AS (SELECT doc_id, string_agg(label, '' ORDER BY label) AS pattern FROM label_rows GROUP BY doc_id) SELECT doc_id, pattern, ((row_number() OVER (PARTITION BY pattern ORDER BY md5('0|' || doc_id), doc_id) - 1) % 5)::INT AS fold FROM p")
def stratified_folds(spark, sf):
    return splits.stratified_folds(splits.label_patterns(label_rows(spark, sf)), 5)


@query(POS + ", tr AS (SELECT h.fold, f.doc_id FROM fo f JOIN (SELECT DISTINCT fold FROM fo) h ON f.fold <> h.fold) SELECT h.fold, count(tr.doc_id) AS leaked FROM (SELECT DISTINCT fold FROM fo) h LEFT JOIN fo f ON f.fold = h.fold LEFT JOIN tr ON tr.fold = f.fold AND tr.doc_id = f.doc_id GROUP BY h.fold")
def leakage(spark, sf):
    f = _folds(spark, sf)
    return splits.leakage(splits.dev_tail(f), f)


@query(PRED + " SELECT fold, cid, count(*) AS n, sum(label)::BIGINT AS n_pos FROM pred GROUP BY ALL")
def fold_diagnostics(spark, sf):
    return predictions(spark, sf).groupBy("fold", "cid").agg(F.count("*").alias("n"), F.sum("label").alias("n_pos"))


G = with_sql("passages", "topics", "gold") + ", pos AS (SELECT DISTINCT doc_id, cid, sent_idx FROM gold), q AS (SELECT doc_id, cid, count(*) AS n_pos, count(*) * 6 AS n_neg FROM pos GROUP BY ALL)"


@query(G + " SELECT doc_id, cid, n_pos, n_neg, floor(n_neg * 0.8)::BIGINT AS n_hard, least(floor(n_neg * 0.1), floor(n_neg * 0.2))::BIGINT AS n_cross, (floor(n_neg * 0.1) + floor(n_neg * 0.1) - least(floor(n_neg * 0.1), floor(n_neg * 0.2)))::BIGINT AS n_random FROM q")
def neg_sampling_quota(spark, sf):
    return sampling.quotas(gold(spark, sf).distinct()).select("doc_id", "cid", "n_pos", "n_neg", "n_hard", "n_cross", "n_random")


@query(G + ", pool AS (SELECT q.doc_id, q.cid, p.sent_idx, n_neg FROM q JOIN passages p USING (doc_id) ANTI JOIN pos USING (doc_id, cid, sent_idx)) SELECT doc_id, cid, sent_idx, 'random' AS source FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, cid ORDER BY md5('3|' || doc_id || '|' || cid || '|' || sent_idx), sent_idx) AS i FROM pool) WHERE i <= n_neg")
def random_negatives(spark, sf):
    g = gold(spark, sf).distinct()
    pool = sampling.random_pool(T.passage_table(documents(spark, sf)), g)
    return sampling.take(pool, sampling.quotas(g), "n_neg", "random", 3)


@query(with_sql("passages", "topics", "post", "terms", "bm25", "gold") + " SELECT doc_id, cid, sent_idx FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, cid ORDER BY score DESC, sent_idx) AS rank FROM bm25) ANTI JOIN gold USING (doc_id, cid, sent_idx) WHERE rank <= 10")
def hard_pool_anti(spark, sf):
    words, t = matching.document_words(documents(spark, sf), gold(spark, sf)), matching.topic_matrix(topics(spark, sf))
    return matching.hard_pool(words, t, matching.bm25_model(words, t), 10)


@query(
    with_sql("passages", "label_rows")
    + """, lim AS (SELECT doc_id, cid, floor(30 * count(*) * 0.1)::BIGINT AS n_cross FROM label_rows WHERE label = 1 GROUP BY ALL),
 ring AS (SELECT other_id, cid, row_number() OVER (PARTITION BY cid ORDER BY md5('0|' || other_id), other_id) - 1 AS place, count(*) OVER (PARTITION BY cid) AS size
  FROM (SELECT DISTINCT doc_id AS other_id, cid FROM label_rows WHERE label = 0 AND doc_id IN (SELECT doc_id FROM passages))),
 want AS (SELECT doc_id, cid, n_cross, size, unnest(range(0, least(n_cross, size) + 1)) AS step, ('0x' || substr(md5('0|' || doc_id || '|' || cid), 1, 12))::BIGINT % size AS start FROM lim JOIN (SELECT DISTINCT cid, size FROM ring) USING (cid)),
 hit AS (SELECT w.doc_id, w.cid, w.n_cross, r.other_id, row_number() OVER (PARTITION BY w.doc_id, w.cid ORDER BY step) AS i FROM want w JOIN ring r ON r.cid = w.cid AND r.place = (w.start + w.step) % w.size WHERE w.doc_id <> r.other_id),
 pool AS (SELECT DISTINCT doc_id, cid, n_cross, other_id FROM hit WHERE i <= n_cross)
 SELECT doc_id, cid, other_id, sent_idx FROM (SELECT p.doc_id, p.cid, p.other_id, s.sent_idx, n_cross, row_number() OVER (PARTITION BY p.doc_id, p.cid ORDER BY md5('0|' || p.doc_id || '|' || p.cid || '|' || p.other_id || '|' || s.sent_idx), p.other_id, s.sent_idx) AS j
  FROM pool p JOIN passages s ON s.doc_id = p.other_id) WHERE j <= n_cross"""
)
def xpost_negatives(spark, sf):
    """Passages of other documents with label 0 for each document's topics, by hashed rings."""
    rows = label_rows(spark, sf)
    limits = sampling.quotas(rows.where("label = 1").withColumn("sent_idx", F.lit(0)), per_pos=30)
    return sampling.cross_take(limits, rows.where("label = 0"), T.passage_table(documents(spark, sf))).drop("source")


def _examples_sql(seed: str) -> str:
    """The rows of sampling.examples from gold, bm25 and passages."""

    def take(n: str, pool: str) -> str:
        order = f"md5('{seed}|' || x.doc_id || '|' || x.cid || '|' || x.sent_idx), x.sent_idx"
        placed = f"SELECT x.doc_id, x.cid, x.sent_idx, n_{n}, row_number() OVER (PARTITION BY x.doc_id, x.cid ORDER BY {order}) AS i FROM {pool} x JOIN q ON q.doc_id = x.doc_id AND q.cid = x.cid"
        return f"SELECT doc_id, cid, doc_id, sent_idx, '{n}' FROM ({placed}) WHERE i <= n_{n}"

    return f""", pos AS (SELECT DISTINCT doc_id, cid, sent_idx FROM gold), ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, cid ORDER BY score DESC, sent_idx) AS rank FROM bm25) WHERE rank <= 100),
 q AS (SELECT *, floor(n_neg * 0.8) AS n_hard, least(floor(n_neg * 0.1), floor(n_neg * 0.2)) AS n_cross, floor(n_neg * 0.1) + floor(n_neg * 0.1) - least(floor(n_neg * 0.1), floor(n_neg * 0.2)) AS n_random FROM (SELECT doc_id, cid, count(*) * 6 AS n_neg FROM pos GROUP BY ALL)),
 hard AS (SELECT doc_id, cid, sent_idx FROM ranked ANTI JOIN pos USING (doc_id, cid, sent_idx)), other AS (SELECT q.doc_id, q.cid, p.sent_idx FROM q JOIN passages p USING (doc_id) ANTI JOIN pos USING (doc_id, cid, sent_idx)),
 ring AS (SELECT other_id, cid, row_number() OVER (PARTITION BY cid ORDER BY md5('{seed}|' || other_id), other_id) - 1 AS place, count(*) OVER (PARTITION BY cid) AS size
  FROM (SELECT d.doc_id AS other_id, c.cid FROM (SELECT DISTINCT doc_id FROM passages) d CROSS JOIN (SELECT DISTINCT cid FROM pos) c) r WHERE NOT EXISTS (SELECT 1 FROM pos WHERE pos.doc_id = r.other_id AND pos.cid = r.cid)),
 want AS (SELECT doc_id, cid, n_cross, size, unnest(range(0, least(n_cross, size)::BIGINT + 1)) AS step, ('0x' || substr(md5('{seed}|' || doc_id || '|' || cid), 1, 12))::BIGINT % size AS start FROM q JOIN (SELECT DISTINCT cid, size FROM ring) USING (cid) WHERE n_cross > 0),
 met AS (SELECT w.doc_id, w.cid, w.n_cross, r.other_id, row_number() OVER (PARTITION BY w.doc_id, w.cid ORDER BY step) AS i FROM want w JOIN ring r ON r.cid = w.cid AND r.place = (w.start + w.step) % w.size WHERE w.doc_id <> r.other_id),
 far AS (SELECT p.doc_id, p.cid, p.other_id, s.sent_idx, n_cross, row_number() OVER (PARTITION BY p.doc_id, p.cid ORDER BY md5('{seed}|' || p.doc_id || '|' || p.cid || '|' || p.other_id || '|' || s.sent_idx), p.other_id, s.sent_idx) AS j
  FROM (SELECT DISTINCT doc_id, cid, n_cross, other_id FROM met WHERE i <= n_cross) p JOIN passages s ON s.doc_id = p.other_id),
 every AS (SELECT doc_id, cid, doc_id AS other_id, sent_idx, 'gold' AS source FROM pos UNION ALL {take("random", "other")} UNION ALL {take("hard", "hard")} UNION ALL SELECT doc_id, cid, other_id, sent_idx, 'cross' FROM far WHERE j <= n_cross)
 SELECT *, (source = 'gold')::INT AS label FROM every"""


@query(with_sql("passages", "topics", "post", "terms", "bm25", "gold") + _examples_sql("0"))
def negative_examples(spark, sf):
    """Gold passages with their hard, random and cross-document negatives."""
    docs, g = documents(spark, sf), Scratch(spark, "gold").keep(gold(spark, sf).distinct())
    words, t = matching.document_words(docs, g), matching.topic_matrix(topics(spark, sf))
    # Quotas are by pairs with gold, so that only these need candidates.
    ranked = matching.labelled_top(words.where("gold IS NOT NULL"), t, matching.bm25_model(words, t), 100, of_gold=True)
    return sampling.examples(g, ranked, T.passage_table(docs))


# --- ground truth and text ----------------------------------------------------


@query(with_sql("passages", "topics", "gold") + " SELECT d.doc_id, t.cid, (g.doc_id IS NOT NULL)::INT AS label FROM documents d CROSS JOIN topics t LEFT JOIN (SELECT DISTINCT doc_id, cid FROM gold) g ON g.doc_id = d.doc_id AND g.cid = t.cid")
def gt_cross_join(spark, sf):
    return groundtruth.document_truth(documents(spark, sf), topics(spark, sf), gold(spark, sf))


@query(
    with_sql("passages", "topics", "gold")
    + """, ann AS (SELECT DISTINCT doc_id, sent_idx + 1 AS sent_idx, cid, (sent_idx % 2 = 0)::INT AS status, 'note ' || (sent_idx + 1) AS text FROM gold),
 notes AS (SELECT doc_id, sent_idx, min(text) AS note FROM ann GROUP BY ALL),
 last AS (SELECT doc_id, max(sent_idx) AS last FROM (SELECT doc_id, sent_idx FROM passages WHERE doc_id IN (SELECT doc_id FROM ann) UNION ALL SELECT doc_id, sent_idx FROM notes) GROUP BY doc_id),
 grid AS (SELECT doc_id, unnest(range(0, last + 1)) AS sent_idx FROM last),
 pool AS (SELECT DISTINCT cid FROM ann)
 SELECT g.doc_id, g.sent_idx, t.cid, coalesce(p.sent, n.note, '') AS sent, (a.doc_id IS NOT NULL)::INT AS label FROM grid g LEFT JOIN passages p USING (doc_id, sent_idx) LEFT JOIN notes n USING (doc_id, sent_idx) CROSS JOIN pool t
 LEFT JOIN (SELECT DISTINCT doc_id, sent_idx, cid FROM ann WHERE status = 1) a ON a.doc_id = g.doc_id AND a.sent_idx = g.sent_idx AND a.cid = t.cid"""
)
def gt_sentence_padded(spark, sf):
    """Annotations stand one place after each gold passage, so that some fall beyond the text."""
    g = Scratch(spark, "gold").keep(gold(spark, sf).distinct())
    ann = g.select("doc_id", (F.col("sent_idx") + 1).alias("sent_idx"), "cid", (F.col("sent_idx") % 2 == 0).cast("int").alias("status"), F.concat(F.lit("note "), (F.col("sent_idx") + 1).cast("string")).alias("text"))
    return groundtruth.document_passage_truth(documents(spark, sf), ann.select("cid").distinct(), ann)


@query(
    with_sql("passages", "topics", "gold")
    + """, ev AS (SELECT DISTINCT g.doc_id, g.cid, g.sent_idx, p.sent FROM gold g JOIN passages p USING (doc_id, sent_idx))
 SELECT doc_id, cid, sent_idx, (instr(text, sent) - 1)::INT AS start, (instr(text, sent) - 1 + length(sent))::INT AS "end" FROM ev JOIN documents USING (doc_id) WHERE instr(text, sent) > 0"""
)
def span_resolution(spark, sf):
    """Spans found by text only: no offsets are given."""
    p = T.passage_table(documents(spark, sf))
    ev = gold(spark, sf).distinct().join(p, ["doc_id", "sent_idx"]).select("doc_id", "cid", "sent_idx", F.col("sent").alias("text"), F.lit(1).alias("status"))
    none = spark.createDataFrame([], "doc_id long, sent_idx int, start int, end int")
    return groundtruth.answer_spans(documents(spark, sf), none, ev)


OFFSETS = """x AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?]+\\s+)', '\\1' || chr(1), 'g'), chr(1)) AS l FROM documents),
 y AS (SELECT doc_id, unnest(l) AS piece, generate_subscripts(l, 1) AS i FROM x),
 z AS (SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place, regexp_replace(piece, '^\\s+|\\s+$', '', 'g') AS sent FROM y),
 off AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS sent_idx, (place + length(piece) - length(regexp_replace(piece, '^\\s+', '')))::INT AS start, (place + length(piece))::INT AS stop FROM z WHERE sent <> '')"""


@query(
    with_sql("passages", "topics", "gold")
    + ", "
    + OFFSETS
    + """, ev AS (SELECT DISTINCT g.doc_id, g.cid, g.sent_idx, p.sent FROM gold g JOIN passages p USING (doc_id, sent_idx))
 SELECT ev.doc_id, cid, ev.sent_idx, coalesce(off.start, instr(text, sent) - 1)::INT AS start, coalesce(off.stop, instr(text, sent) - 1 + length(sent))::INT AS "end"
 FROM ev JOIN documents d ON d.doc_id = ev.doc_id LEFT JOIN off ON off.doc_id = ev.doc_id AND off.sent_idx = ev.sent_idx AND ev.sent_idx % 2 = 0 WHERE off.start IS NOT NULL OR instr(text, sent) > 0"""
)
def span_by_index(spark, sf):
    """Spans by the place of the passage where its number is even, the others by text."""
    docs = documents(spark, sf)
    ev = gold(spark, sf).distinct().join(T.passage_table(docs), ["doc_id", "sent_idx"]).select("doc_id", "cid", "sent_idx", F.col("sent").alias("text"), F.lit(1).alias("status"))
    return groundtruth.answer_spans(docs, passage_offsets(spark, sf).where("sent_idx % 2 = 0"), ev)


@query(PRED + ", y AS (SELECT doc_id, cid, label FROM label_rows UNION ALL SELECT doc_id, cid, 1 - label FROM label_rows WHERE doc_id % 3 = 0) SELECT pred.doc_id, pred.cid, prob, y.label AS truth FROM pred JOIN y ON y.doc_id = pred.doc_id AND y.cid = pred.cid")
def prediction_merge(spark, sf):
    """Predictions beside every label of their key, some of which come twice."""
    y = label_rows(spark, sf)
    twice = y.unionByName(y.where("doc_id % 3 = 0").withColumn("label", 1 - F.col("label")))
    return groundtruth.merged(predictions(spark, sf).select("doc_id", "cid", "prob"), twice, ["doc_id", "cid"])


@query(f"""WITH x AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?]+\\s+)', '\\1' || chr(1), 'g'), chr(1)) AS l FROM documents),
 y AS (SELECT doc_id, unnest(l) AS piece, generate_subscripts(l, 1) AS i FROM x),
 z AS (SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place, regexp_replace(piece, '^\\s+|\\s+$', '', 'g') AS sent FROM y)
 SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS sent_idx, (place + length(piece) - length(regexp_replace(piece, '^\\s+', '')))::INT AS start, (place + length(piece))::INT AS "end" FROM z WHERE sent <> ''""")
def passage_offsets(spark, sf):
    return documents(spark, sf).select("doc_id", F.posexplode(T.passage_offsets(F.col("text"))).alias("sent_idx", "p")).select("doc_id", "sent_idx", "p.start", "p.end")


NEGATION = "['not', 'no', 'never', 'without', 'denies']"
HEDGE = "['maybe', 'perhaps', 'possible', 'appears', 'seems']"
CUE = "len(list_filter(list_filter(string_split_regex(lower(sent), '\\s+'), lambda x: x <> ''), lambda x: list_contains({c}, x)))"


@query(with_sql("passages") + f", c AS (SELECT doc_id, sent_idx, {CUE.format(c=NEGATION)} AS neg, {CUE.format(c=HEDGE)} AS hedge FROM passages) SELECT doc_id, sent_idx, neg AS n_neg, hedge AS n_hedge, (neg > 0)::INT AS neg, (hedge > 0)::INT AS hedge FROM c")
def cue_features(spark, sf):
    count = lambda cues: F.aggregate(T.cue_flags(F.col("sent"), cues), F.lit(0).cast("long"), lambda a, x: a + x)
    return T.passage_table(documents(spark, sf)).select("doc_id", "sent_idx", count(T.NEGATION_CUES).alias("n_neg"), count(T.HEDGE_CUES).alias("n_hedge"), T.has_cue(F.col("sent"), T.NEGATION_CUES).alias("neg"), T.has_cue(F.col("sent"), T.HEDGE_CUES).alias("hedge"))


@query("""WITH t AS (SELECT event_id, 'for ' || (event_id % 13) || CASE event_id % 4 WHEN 0 THEN ' days' WHEN 1 THEN 'weeks' WHEN 2 THEN ' month' ELSE ' years' END AS s FROM events)
 SELECT event_id, try_cast(nullif(regexp_extract(s, '(\\d+)\\s*(day|week|month)s?', 1), '') AS BIGINT) * CASE regexp_extract(s, '(\\d+)\\s*(day|week|month)s?', 2) WHEN 'day' THEN 1 WHEN 'week' THEN 7 WHEN 'month' THEN 30 END AS days FROM t""")
def duration_days(spark, sf):
    e = F.col("event_id")
    unit = F.when(e % 4 == 0, " days").when(e % 4 == 1, "weeks").when(e % 4 == 2, " month").otherwise(" years")
    return table(spark, sf, "events").select("event_id", T.duration_days(F.concat(F.lit("for "), (e % 13).cast("string"), unit)).alias("days"))


@query("SELECT conv_id, turn, concat_ws(' [SEP] ', nullif(trim(lag(text) OVER w, ' '), ''), nullif(trim(text, ' '), ''), nullif(trim(lead(text) OVER w, ' '), '')) AS context FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def neighbor_context(spark, sf):
    return groundtruth.with_context(table(spark, sf, "conversations"), "conv_id", "turn", "text").select("conv_id", "turn", "context")


@query(with_sql("passages") + " SELECT doc_id, string_agg(sent, ' ' ORDER BY sent_idx::VARCHAR) AS text FROM passages GROUP BY doc_id")
def rebuilt_texts(spark, sf):
    return groundtruth.rebuilt_text(T.passage_table(documents(spark, sf)))


@query(PRED + " SELECT doc_id, cid, max_by(label, prob) AS label FROM (SELECT * FROM pred UNION ALL SELECT doc_id, cid, 1 - label, logit, prob - 1, prob_cal, fold FROM pred) GROUP BY ALL")
def last_label_wins(spark, sf):
    p = predictions(spark, sf)
    other = p.select("doc_id", "cid", (1 - F.col("label")).alias("label"), (F.col("prob") - 1).alias("prob"))
    return groundtruth.last_label(p.select("doc_id", "cid", "label", "prob").unionByName(other), ["doc_id", "cid"], "prob")


@query(PRED + ", x AS (SELECT doc_id, cid, label, prob FROM pred UNION ALL SELECT doc_id, cid, 2, prob + 1 FROM pred WHERE fold = 0) SELECT 'label' AS rule, count(*) FILTER (WHERE label NOT IN (0, 1)) AS n FROM x UNION ALL SELECT 'prob', count(*) FILTER (WHERE prob NOT BETWEEN 0 AND 1) FROM x UNION ALL SELECT 'key', count(*) FROM (SELECT 1 FROM x GROUP BY doc_id, cid HAVING count(*) > 1)")
def constraint_violations(spark, sf):
    p = predictions(spark, sf)
    bad = p.where("fold = 0").select("doc_id", "cid", F.lit(2).alias("label"), (F.col("prob") + 1).alias("prob"))
    return groundtruth.violations(p.select("doc_id", "cid", "label", "prob").unionByName(bad))


@query("SELECT page_id, CASE WHEN regexp_full_match('A.' || (page_id % 12), 'A\\.\\d+') AND page_id % 12 BETWEEN 1 AND 9 THEN 'c' || (page_id % 12) END AS code, coalesce(CASE url WHEN '' THEN 'none' END, url) AS name FROM pages")
def code_mapping(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.short_code(F.concat(F.lit("A."), (F.col("page_id") % 12).cast("string"))).alias("code"), T.mapped(F.col("url"), {"": "none"}).alias("name"))


# --- graphs and gates ---------------------------------------------------------


@query("SELECT * FROM (SELECT conv_id, turn AS src, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS dst FROM conversations) WHERE dst IS NOT NULL")
def graph_next_edges(spark, sf):
    return graph.next_edges(table(spark, sf, "conversations"), "conv_id", "turn")


@query("WITH r AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations) SELECT a.conv_id, a.turn AS src, b.turn AS dst FROM r a JOIN r b ON a.conv_id = b.conv_id AND b.i - a.i BETWEEN 1 AND 2")
def graph_near_edges(spark, sf):
    return graph.near_edges(table(spark, sf, "conversations"), "conv_id", "turn", 2)


@query(
    with_sql("passages", "topics", "gold")
    + f""", s AS (SELECT DISTINCT doc_id, sent_idx, cid, round((sent_idx % 10)::DOUBLE / 2 - 2, 6) AS logit, round(1 / (1 + exp(-((sent_idx % 10)::DOUBLE / 2 - 2))), 6) AS prob FROM gold),
 f AS (SELECT doc_id, sent_idx, ({CUE.format(c=NEGATION)} > 0)::INT AS neg, ({CUE.format(c=HEDGE)} > 0)::INT AS hedge,
  coalesce(try_cast(nullif(regexp_extract(lower(sent), '(\\d+)\\s*(day|week|month)s?', 1), '') AS BIGINT) * CASE regexp_extract(lower(sent), '(\\d+)\\s*(day|week|month)s?', 2) WHEN 'day' THEN 1 WHEN 'week' THEN 7 WHEN 'month' THEN 30 END, 0) AS days,
  round(CASE WHEN count(*) OVER w > 1 THEN sent_idx::DOUBLE / (count(*) OVER w - 1) ELSE 0 END, 6) AS p FROM passages WINDOW w AS (PARTITION BY doc_id))
 SELECT doc_id, sent_idx, cid, [logit, prob, neg::DOUBLE, hedge::DOUBLE, days::DOUBLE, p] AS attrs, (prob >= 0.5)::INT AS label FROM s JOIN f USING (doc_id, sent_idx)"""
)
def graph_supports_edges(spark, sf):
    logit = F.round((F.col("sent_idx") % 10) / 2 - 2, 6)
    g = Scratch(spark, "gold").keep(gold(spark, sf).distinct())
    s = g.withColumn("logit", logit).withColumn("prob", F.round(T.sigmoid(F.col("logit")), 6))
    # Only documents with edges are cut, each in its row, with the number of its passages.
    own = documents(spark, sf).select("doc_id", "text").join(build_side(g.select("doc_id").distinct()), "doc_id", "left_semi")
    passages = own.select("doc_id", T.passages(F.col("text")).alias("sents")).select("doc_id", F.size("sents").alias("n_passages"), F.posexplode("sents").alias("sent_idx", "sent"))
    return graph.supports_edges(build_side(s), passages)


@query(with_sql("passages") + " SELECT doc_id, sent_idx, [length(sent)::DOUBLE, 0.0, 0.0, 0.0] AS x FROM passages")
def graph_passage_nodes(spark, sf):
    return graph.passage_nodes(T.passage_table(documents(spark, sf)))


@query(PRED + ", s AS (SELECT * FROM pred) SELECT s.doc_id, s.cid, logit, prob_cal, coalesce(q.label, 0) AS label FROM s LEFT JOIN (SELECT * FROM label_rows WHERE label = 1) q USING (doc_id, cid)")
def graph_matches_edges(spark, sf):
    return graph.matches_edges(predictions(spark, sf), label_rows(spark, sf).where("label = 1"))


@query(
    """WITH p AS (SELECT DISTINCT conv_id, role FROM conversations), o AS (SELECT role, count(*) AS c FROM p GROUP BY role)
 SELECT a.role AS cid1, b.role AS cid2, round(ln(count(*) * (SELECT count(DISTINCT conv_id) FROM p)::DOUBLE / (any_value(x.c) * any_value(y.c))), 9) AS pmi, count(*) AS cofreq FROM p a JOIN p b ON a.conv_id = b.conv_id AND a.role < b.role JOIN o x ON x.role = a.role JOIN o y ON y.role = b.role GROUP BY ALL"""
)
def topic_cooccurrence(spark, sf):
    """Roles that share a conversation stand for topics that share a document."""
    return graph.cooccurrence(table(spark, sf, "conversations"), "conv_id", "role")


@query("WITH e AS (SELECT conv_id, turn AS src, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS dst FROM conversations) SELECT dst, round(avg(x), 9) AS x FROM (SELECT conv_id * 1000 + src AS src, conv_id * 1000 + dst AS dst FROM e WHERE dst IS NOT NULL) e JOIN (SELECT conv_id * 1000 + turn AS src, length(text)::DOUBLE AS x FROM conversations) USING (src) GROUP BY dst")
def graph_neighbour_mean(spark, sf):
    c = table(spark, sf, "conversations")
    at = lambda t: F.col("conv_id") * 1000 + F.col(t)
    e = graph.next_edges(c, "conv_id", "turn").select(at("src").alias("src"), at("dst").alias("dst"))
    return graph.neighbour_mean(c.select(at("turn").alias("id"), F.length("text").cast("double").alias("x")), e, "x")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice, rank FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS rank FROM lineitem) WHERE rank <= 2")
def grouped_topk(spark, sf):
    w = Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_linenumber")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", F.row_number().over(w).alias("rank")).where("rank <= 2")


@query("SELECT lang, count(*) AS n_docs, count(DISTINCT source) AS n_sources, sum(n_chars)::BIGINT AS n_chars FROM documents GROUP BY lang")
def dataset_statistics(spark, sf):
    return documents(spark, sf).groupBy("lang").agg(F.count("*").alias("n_docs"), F.countDistinct("source").alias("n_sources"), F.sum("n_chars").alias("n_chars"))


