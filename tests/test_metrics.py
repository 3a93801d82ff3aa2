"""Hand-computed expectations of ranking, classification, calibration and threshold operators."""

import math

import pytest
from pyspark.sql import functions as F

from quillspark.operators import calibration, classification, fusion, gates, ranking


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_rrf_multi_channel_boost(spark):
    ranks = spark.createDataFrame([("d", "c", "dense", 1, 1), ("d", "c", "dense", 2, 2), ("d", "c", "sparse", 2, 1)], "doc_id string, cid string, channel string, sent_idx int, rank int")
    got = fusion.rrf(ranks, 1, 2).orderBy("rank").collect()
    assert [r.sent_idx for r in got] == [2, 1]
    assert got[0].rank_sparse == 1
    assert got[0].score == pytest.approx(1 / 3 + 1 / 2)


def test_rrf_tie_falls_to_id(spark):
    ranks = spark.createDataFrame([("d", "c", "dense", 1, 1), ("d", "c", "sparse", 2, 1)], "doc_id string, cid string, channel string, sent_idx int, rank int")
    assert [r.sent_idx for r in fusion.rrf(ranks, 0, 2).orderBy("rank").collect()] == [1, 2]


def test_rrf_does_not_depend_on_row_order(spark):
    data = [("d", "c", ch, s, 1 + (s * k) % 7) for k, ch in enumerate(("dense", "sparse", "bm25"), 1) for s in range(7)]
    schema = "doc_id string, cid string, channel string, sent_idx int, rank int"
    a = rows(fusion.rrf(spark.createDataFrame(data, schema), 60, 4), "sent_idx", "rank", "score")
    b = rows(fusion.rrf(spark.createDataFrame(data[::-1], schema).repartition(3), 60, 4), "sent_idx", "rank", "score")
    assert a == b and len(a) == 4


def test_modes_drop_channels(spark):
    ranks = spark.createDataFrame([("dense",), ("sparse",), ("bm25",)], "channel string")
    assert {r.channel for r in fusion.in_mode(ranks, "two_way_rrf").collect()} == {"dense", "bm25"}


def test_effective_k_precedence(spark):
    df = spark.createDataFrame([(0, 5, 7, 9, 11), (None, 0, 7, 9, 11), (None, None, 0, 9, 11), (None, None, None, None, None)], "o int, t int, d int, f int, r int")
    got = [r[0] for r in df.select(fusion.effective_k(*[F.col(c) for c in "otdfr"])).collect()]
    assert got == [0, 7, 9, 50]


def test_normalised_candidates(spark):
    raw = '[["s1", 0.5], ["s2", 0.25, {"rank_d": 1}], {"sent_id": "s3", "score": 1.5}]'
    got = spark.createDataFrame([(raw,)], "raw string").select(fusion.normalised_candidates(F.col("raw")).alias("c")).first().c
    assert [(x.sent_id, x.score, x.meta) for x in got] == [("s1", 0.5, "{}"), ("s2", 0.25, '{"rank_d":1}'), ("s3", 1.5, "{}")]


def test_pair_metrics(spark):
    cand = spark.createDataFrame([("d", 1, s, r) for r, s in enumerate([5, 6, 7], 1)], "doc_id string, cid int, sent_idx int, rank int")
    gold = spark.createDataFrame([("d", 1, 6), ("d", 1, 9), ("e", 1, 0)], "doc_id string, cid int, sent_idx int")
    got = {(r.doc_id, r.k): r for r in ranking.pair_metrics(cand, gold, [1, 3]).collect()}
    assert got["d", 1].hit == 0 and got["d", 1].ndcg == 0
    assert (got["d", 3].hit, got["d", 3].recall, got["d", 3].mrr) == (1, 0.5, 0.5)
    assert got["d", 3].ndcg == pytest.approx((1 / math.log2(3)) / (1 + 1 / math.log2(3)))
    assert got["e", 3].recall == 0


def test_sweep_two_thirds(spark):
    gold = spark.createDataFrame([("a", "c1", 1), ("b", "c1", 2), ("a", "c2", 3)], "doc_id string, cid string, sent_idx int")
    cand = spark.createDataFrame([("a", "c1", 1, 1), ("b", "c1", 9, 1), ("a", "c2", 3, 1)], "doc_id string, cid string, sent_idx int, rank int")
    got = {(r.scope, r.cid): r.recall_at_k for r in ranking.sweep(cand, gold, [1]).collect()}
    assert got["overall", None] == pytest.approx(2 / 3) and got["topic", "c1"] == 0.5 and got["topic", "c2"] == 1.0


def test_set_recall_partial_with_external_gold(spark):
    pred = spark.createDataFrame([("p", s, c, 1) for s, c in ((1, "A"), (2, "A"), (3, "B"))], "doc_id string, sent_idx int, cid string, label int")
    gold = spark.createDataFrame([("p", s, c) for s, c in ((1, "A"), (2, "A"), (4, "A"), (3, "B"), (5, "B"))], "doc_id string, sent_idx int, cid string")
    got = {r.cid: r.recall for r in ranking.set_recall(pred, gold).collect()}
    assert got[None] == 0.6 and got["A"] == pytest.approx(2 / 3) and got["B"] == 0.5
    assert ranking.set_recall(pred).where("scope = 'overall'").first().recall == 1.0


def test_pooled_recall_at_k(spark):
    data = [("p", "A", i, int(i in (0, 1, 3)), 1 - i / 10) for i in range(4)]
    df = spark.createDataFrame(data, "doc_id string, cid string, sent_idx int, label int, prob double")
    assert rows(ranking.pooled_at_k(df, [1, 2, 4]), "k", "recall") == [(1, pytest.approx(1 / 3)), (2, pytest.approx(2 / 3)), (4, 1.0)]


def test_curves_with_ties(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.5), (0, 0.1)], "label int, prob double").withColumn("cid", F.lit("a"))
    got = classification.curve_areas(df, ["cid"]).first()
    assert got.auroc == pytest.approx(0.625)
    assert got.average_precision == pytest.approx(0.5 * 0.5 + 0.5 * 2 / 3)


def test_one_class_has_no_areas(spark):
    df = spark.createDataFrame([("a", 1, 0.9), ("a", 1, 0.2)], "cid string, label int, prob double")
    got = classification.curve_areas(df, ["cid"]).first()
    assert got.auroc is None and got.average_precision is None


def test_prf_with_empty_denominators(spark):
    df = spark.createDataFrame([("a", 0, 0.1)], "cid string, label int, prob double")
    r = classification.prf(df, ["cid"]).first()
    assert (r.precision, r.recall, r.f1, r.accuracy) == (0, 0, 0, 1)


def test_ece_bounds_and_value(spark):
    df = spark.createDataFrame([(1, 0.95), (1, 0.85), (0, 0.05), (1, 1.0)], "label int, prob double").withColumn("cid", F.lit(1))
    assert calibration.ece(df, ["cid"]).first().ece == pytest.approx((0.05 + 2 * 0.0 + 0.15 + 0.05 - 0.0) / 4, abs=0.02)
    assert sum(r.n for r in calibration.reliability(df, [], 5).collect()) == 4
    assert calibration.reliability(df, ["cid"], 5).count() == 5


def test_temperature_is_positive_and_helps(spark):
    data = [("a", 4.0, 1), ("a", 3.0, 0), ("a", -2.0, 0), ("a", -3.0, 1), ("a", 2.0, 1)] * 4 + [("b", 1.0, 1)]
    df = spark.createDataFrame(data, "cid string, logit double, label int")
    t = {r.cid: r.temperature for r in calibration.temperatures(df, "cid").collect()}
    assert t["a"] > 1 and t["b"] == t[None]
    a = df.where("cid = 'a'")
    assert calibration.nll(a, ["cid"], t["a"]).first().nll <= calibration.nll(a, ["cid"]).first().nll


def thresholds(spark, data, variant):
    df = spark.createDataFrame(data, "cid string, label int, prob double")
    return {r.cid: r.threshold for r in calibration.best_thresholds(df, ["cid"], variant).collect()}


def test_threshold_variants(spark):
    good = [("a", 1, 0.8)] * 20 + [("a", 0, 0.3)] * 20
    none = [("b", 0, 0.4)] * 20
    few = [("c", 1, 0.9)] * 5
    assert thresholds(spark, good + none + few, "optimizer") == {"a": 0.8, "b": 0.5, "c": 0.5}
    assert thresholds(spark, good + none + few, "crossval") == {"a": 0.8, "b": 1.0, "c": 0.0}
    assert thresholds(spark, none, "endpoint") == {"b": 1.0}
    assert thresholds(spark, none, "report") == {"b": 0.5}
    with pytest.raises(ValueError):
        thresholds(spark, none, "other")


def test_apply_thresholds(spark):
    df = spark.createDataFrame([("A", 0.6), ("A", 0.5), ("B", 0.8), ("B", 0.7), ("C", 0.5)], "cid string, prob double")
    t = spark.createDataFrame([("A", 0.6), ("B", 0.75)], "cid string, threshold double")
    assert rows(calibration.apply_thresholds(df, t), "cid", "prob", "predicted") == [("A", 0.5, 0), ("A", 0.6, 1), ("B", 0.7, 0), ("B", 0.8, 1), ("C", 0.5, 1)]
    with pytest.raises(Exception, match="cid is missing"):
        calibration.apply_thresholds(spark.createDataFrame([(None, 0.1)], "cid string, prob double"), t).collect()


def test_optimizer_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 0.8)] * 20 + [("a", 0, 0.3)] * 20, "cid string, label int, prob double")
    opt = calibration.ThresholdOptimizer().fit(df)
    opt.save(str(tmp_path / "t"))
    again = calibration.ThresholdOptimizer().load(spark, str(tmp_path / "t"))
    assert again.predict(df).where("predicted <> label").count() == 0
    with pytest.raises(ValueError):
        calibration.ThresholdOptimizer().predict(df)


def test_select_k(spark):
    data = [("overall", None, 5, 0.8, 0.8), ("overall", None, 10, 0.96, 0.96), ("overall", None, 20, 0.97, 0.97), ("topic", "c1", 5, 0.96, 0.96), ("topic", "c1", 10, 0.97, 0.97), ("topic", "c2", 5, 0.1, 0.1), ("topic", "c2", 10, 0.3, 0.3), ("topic", "c2", 20, 0.3, 0.3)]
    sw = spark.createDataFrame(data, "scope string, cid string, k int, recall_at_k double, coverage_at_k double")
    got = {(r.scope, r.cid): (r.k, r.needs_help) for r in gates.select_k(sw, 0.95, 0.9).collect()}
    assert got == {("overall", None): (10, False), ("topic", "c1"): (5, False), ("topic", "c2"): (10, True)}
    kept = {r.cid: r.k for r in gates.select_k(sw, 0.95, 0.9, prefer_min=False).collect()}
    assert kept["c1"] == 10 and kept["c2"] == 10
    assert {r.cid: r.k for r in gates.select_k(sw, 0.95, 0.9, sensitive=["c2"], sensitive_cap=7).collect()}["c2"] == 7


def test_gates(spark):
    m = spark.createDataFrame([("f1", 0.7), ("ece", 0.2), ("initial_ece", 0.3), ("improvement_pct", 19.9), ("recall@20", 0.95), ("recall@20_min", 0.9)], "metric string, value double")
    got = {r.name: r.passed for r in gates.check_gates(m, gates.gate_table(spark)).collect()}
    assert got["evidence_f1"] and not got["evidence_ece"] and not got["evidence_auprc"] and not got["calibration_improvement"]
    assert got["retrieval_recall@20_overall"] and got["retrieval_recall@20_per_criterion"]
    v = gates.verdict(gates.check_gates(m, gates.gate_table(spark)).unionByName(gates.leakage_gates(spark.createDataFrame([(0, 0)], "fold int, leaked long")))).first()
    assert (v.n_gates, v.n_passed, v.accepted) == (9, 4, False)


def test_best_trial_prunes(spark):
    t = spark.createDataFrame([(1, 0.9, 0.7), (2, 0.5, 0.9)], "trial int, macro_f1 double, precision_at_5 double")
    assert gates.best_trial(t).first().trial == 2


def test_percentiles_between_neighbours(spark):
    """Ties, a null group, groups of one value or none, and conditions, against numpy."""
    import numpy as np

    rng = np.random.default_rng(4)
    data = [(g, int(i % 3 == 0), float(x)) for g in ("a", None, "b") for i, x in enumerate(rng.integers(-5, 5, 41) / 4)]
    data += [("one", 1, 2.5), ("one", 0, None), ("none", 1, None)]
    df = spark.createDataFrame(data, "g string, label int, x double")
    wanted = {"low": (0.0, None), "mid": (0.5, None), "high": (0.95, None), "top": (1.0, None), "some": (0.3, F.col("label") == 1)}
    got = {r.g: r for r in ranking.percentiles(df, ["g"], "x", wanted).collect()}
    assert got.keys() == {g for g, _, _ in data}
    for g in got:
        for name, (q, c) in wanted.items():
            x = [v for h, y, v in data if h == g and v is not None and (c is None or y == 1)]
            assert got[g][name] == (pytest.approx(np.quantile(x, q)) if x else None)
    x = [v for _, _, v in data if v is not None]
    assert tuple(ranking.latency(df, "x").first()) == (pytest.approx(np.quantile(x, 0.5)), pytest.approx(np.quantile(x, 0.95)), len(x))
    by = {r.g: (r.p95, r.n) for r in ranking.latency(df, "x", "g").collect()}
    assert by["one"] == (2.5, 1) and by["none"] == (None, 0) and by[None][1] == 41
    assert ranking.percentiles(df.limit(0), ["g"], "x", wanted).count() == 0 and ranking.latency(df.limit(0), "x").first().n == 0
