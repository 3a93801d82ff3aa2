"""Assembled tables, cue words and gates on small fixtures."""

import math

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import assembly, calibration, gates, retrieval, splits
from quillspark.scratch import Scratch, restrict


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_every_cue_word_counts(spark):
    for cues, words in ((T.NEGATION_CUES, "not no never without denies"), (T.HEDGE_CUES, "maybe perhaps possible appears seems")):
        found = spark.createDataFrame([(f"a {words.upper()} none might could possibly no, seems.",)], "t string").select(T.cue_flags(F.col("t"), cues).alias("f")).first().f
        assert found == [0, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0]


def test_improvement_gate_is_asked_above_the_first_error(spark):
    table = gates.gate_table(spark)
    for first, asked in ((0.05, False), (0.06, True), (None, False)):
        m = [("improvement_pct", 25.0), ("ece", 0.1), ("f1", 0.69)] + ([("initial_ece", first)] if first is not None else [])
        got = {r.name: (r.value, r.passed) for r in gates.check_gates(spark.createDataFrame(m, "metric string, value double"), table).collect()}
        assert ("calibration_improvement" in got) == asked
        assert got["evidence_ece"] == (0.1, True) and got["evidence_f1"] == (0.69, False) and got["evidence_auprc"] == (0.0, False)
    leaks = gates.leakage_gates(spark.createDataFrame([(0, 0), (1, 2)], "fold int, leaked long"))
    assert rows(leaks.select("name", "passed")) == [("data_leakage_fold0", True), ("data_leakage_fold1", False)]


def test_pairs_with_missing_sides(spark):
    labels = spark.createDataFrame([(1, "a", 1), (1, "x", 0), (2, "a", 1), (2, "x", 0)], "doc_id int, cid string, label int")
    docs, topics = spark.createDataFrame([(1, "d")], "doc_id int, text string"), spark.createDataFrame([("a", "t")], "cid string, text string")
    get = lambda way: rows(assembly.attach_pairs(labels, docs, topics, way))
    assert get("drop") == [(1, "a", "d", "t", 1)]
    assert get("drop_doc") == [(1, "a", "d", "t", 1), (1, "x", "d", "", 0)]
    assert get("empty") == [(1, "a", "d", "t", 1), (1, "x", "d", "", 0), (2, "a", "", "t", 1), (2, "x", "", "", 0)]
    with pytest.raises(ValueError):
        assembly.attach_pairs(labels, docs, topics, "other")


def test_candidates_without_retrieval_are_whole_documents(spark):
    passages = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "doc_id int, sent_idx int")
    topics = spark.createDataFrame([("a", "t"), ("b", "u")], "cid string, text string")
    found = spark.createDataFrame([(1, "a", 1, 0.5, 1)], "doc_id int, cid string, sent_idx int, score double, rank int")
    assert rows(assembly.whole_document_candidates(found, passages, topics)) == [(1, "a", 1, 0.5, 1), (1, "b", 0, 0.0, 1), (1, "b", 1, 0.0, 2), (2, "a", 0, 0.0, 1), (2, "b", 0, 0.0, 1)]


def test_lookup_maps_keep_all_documents(spark):
    labels = spark.createDataFrame([(1, "b", 1), (1, "a", 0)], "doc_id int, cid string, label int")
    docs = spark.createDataFrame([(1,), (2,)], "doc_id int")
    assert {r.doc_id: r.by_topic for r in assembly.topic_map(labels, docs).collect()} == {1: {"a": 0, "b": 1}, 2: {}}


def test_term_weights(spark):
    texts = [("B a b, b c",), ("",), (None,)]
    got = [r.w for r in spark.createDataFrame(texts, "t string").select(assembly.term_weights(F.col("t")).alias("w")).collect()]
    assert got[0] == pytest.approx({"a": 1 / math.sqrt(11), "b": 3 / math.sqrt(11), "c": 1 / math.sqrt(11)}) and got[1:] == [{}, {}]


def test_probability_chain_and_templates(spark):
    df = spark.createDataFrame([(0.1, 0.2), (None, 0.3), (None, None)], "prob_cal double, prob double")
    assert [r.p for r in df.select(assembly.probability(df.columns, "prob_cal").alias("p")).collect()] == [0.1, 0.3, 0.0]
    assert [r.p for r in df.select(assembly.probability(df.columns, "absent").alias("p")).collect()] == [0.2, 0.3, 0.0]
    assert assembly.path_of("out/${EXP}/x-${EXP}", EXP="ci") == "out/ci/x-ci"
    ratio = df.limit(1).select(assembly.improvement_ratio(F.lit(0.0), F.lit(0.3)).alias("a"), assembly.improvement_ratio(F.lit(0.4), F.lit(0.3)).alias("b")).first()
    assert ratio.a == 1.0 and ratio.b == pytest.approx(0.25)


def test_fold_scorers_and_batches(spark):
    df = spark.createDataFrame([(i, i % 2) for i in range(25)], "id long, fold int")
    got = assembly.fold_scores(df, {0: lambda r: r["id"] * 0.0, 1: lambda r: r["id"] * 0.0 + 1}).collect()
    assert all(r.prob == r.fold for r in got)
    packed = sorted(assembly.batches(df, 10, ["fold", "id"], "id").collect())
    assert [(r.batch, r.n) for r in packed] == [(0, 10), (1, 10), (2, 5)] and packed[2].id == [20, 21, 22, 23, 24] and packed[2].fold == [0, 1, 0, 1, 0]


def test_bundle_has_null_areas_for_one_class(spark):
    data = [("a", 1, 0.9, 0.8), ("a", 0, 0.4, 0.3), ("b", 1, 0.7, 0.6), ("b", 1, 0.2, 0.1)]
    got = {(r.scope, r.cid): r for r in assembly.evidence_bundle(spark.createDataFrame(data, "cid string, label int, prob double, prob_cal double")).collect()}
    assert got["topic", "b"].auprc is None and got["topic", "a"].auprc == 1.0 and got["overall", "all"].n == 4
    assert (got["topic", "a"].threshold, got["topic", "a"].f1) == (0.8, 1.0) and got["topic", "b"].f1_half == pytest.approx(2 / 3)


def test_calibration_fit_against_a_plain_loop(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    data = [("a" if i % 2 else "b", int(rng.random() < 1 / (1 + math.exp(-x / 2))), float(round(x, 4))) for i, x in enumerate(rng.normal(0, 3, 400))]
    df = spark.createDataFrame(data, "cid string, label int, logit double").withColumn("fold", F.lit(0))
    got = {r.cid: r for r in assembly.calibrated_rows(df).collect()}
    for cid in "ab":
        x, y = (np.array([r[k] for r in data if r[0] == cid], float) for k in (2, 1))
        t = calibration.fit_temperature(x, y)
        assert got[cid].temperature == pytest.approx(t, abs=1e-6)
        for p, value in ((1 / (1 + np.exp(-x)), got[cid].ece_before), (1 / (1 + np.exp(-x / t)), got[cid].ece_after)):
            b = np.minimum(9, (p * 10).astype(int))
            assert value == pytest.approx(sum((b == k).sum() * abs(y[b == k].mean() - p[b == k].mean()) for k in set(b)) / len(x), abs=1e-6)
    spread = {r.cid: r for r in assembly.temperature_spread(df).collect()}
    assert spread["a"].std == 0 and spread["a"].folds == 1 and spread["a"].mean == pytest.approx(got["a"].temperature, abs=1e-5)


def test_positions_within_groups(spark):
    df = spark.createDataFrame([(g, i) for g in ("a", "b", None) for i in range(40 if g == "a" else 7)], "g string, i int")
    got = splits.positions_within(df, "g", F.desc("i")).collect()
    assert all(r.pos == r["size"] - 1 - r.i and r["size"] == (40 if r.g == "a" else 7) for r in got) and len(got) == 54


def test_bm25_of_pairs_equals_the_whole(spark):
    docs = spark.createDataFrame([(i, f"alpha beta. gamma {w} delta! {w}") for i, w in enumerate("alpha gamma zeta".split())] + [(9, None), (10, "")], "doc_id long, text string")
    topics = spark.createDataFrame([("t", "alpha gamma"), ("u", "zeta delta")], "cid string, text string")
    pairs = spark.createDataFrame([(0, "t"), (2, "u"), (2, "u"), (7, "t")], "doc_id long, cid string")
    whole = rows(retrieval.bm25(docs, topics))
    assert rows(retrieval.bm25(docs, topics, pairs=pairs)) == [r for r in whole if r[:2] in ((0, "t"), (2, "u"))] != []


def test_kept_tables_can_go(spark):
    scratch = Scratch(spark, "t")
    kept = scratch.keep(spark.range(5).toDF("id"), "x")
    assert rows(restrict(spark.range(9).toDF("id"), kept, "id", "left_anti")) == [(5,), (6,), (7,), (8,)]
    assert rows(restrict(spark.range(9).toDF("id"), kept, "id", limit=2)) == [(0,), (1,), (2,), (3,), (4,)]
    import os

    folder = kept.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
    assert os.path.isdir(folder)
    scratch.drop(kept)
    assert not os.path.isdir(folder)


def test_configs_and_jobs(spark, tmp_path):
    import json

    from quillspark.sources import config

    for name in ("run.json", "run.yaml"):
        path = f"{tmp_path}/{name}"
        config.save_config({"a": {"b": 1}}, path)
        got = config.update_runtime_config(path, {"k_infer_default": 20, "k_infer_overrides": {"c1": 5}})
        assert config.load_config(path) == got
        assert (config.cfg_get(got, "a.b"), config.cfg_get(got, "retrieval.k_infer_overrides.c1"), config.cfg_get(got, "a.x.y", "none")) == (1, 5, "none")
    docs = spark.range(20).toDF("post_id")
    assert {r.split: r["count"] for r in config.materialise_splits(docs, f"{tmp_path}/splits").groupBy("split").count().collect()} == {"train": 16, "dev": 2, "test": 2}
    schema = "doc_id string, cid string, sent_idx int, score double, ordinal int"
    lines = [{"doc_id": d, "cid": "c", "sent_idx": i, "score": i / 10, "ordinal": 0} for d in "ab" for i in range(4)]
    (tmp_path / "cand.jsonl").write_text("\n".join(map(json.dumps, lines)))
    (tmp_path / "ids.json").write_text('["a"]')
    (tmp_path / "none.json").write_text("[]")
    job = lambda ids="ids.json", cand="cand.jsonl", cfg={}: config.fold_filter_job(spark, cfg, f"{tmp_path}/{ids}", f"{tmp_path}/{cand}", schema, f"{tmp_path}/out", 2)  # noqa: E731, B006
    assert sorted((r.doc_id, r.sent_idx, r["rank"]) for r in job().collect()) == [("a", 2, 2), ("a", 3, 1)]
    assert spark.read.json(f"{tmp_path}/out").count() == 2 and job(ids="none.json") is None
    with pytest.raises(ValueError):
        job(cfg={"retrieval": {"scope": "all"}})
    with pytest.raises(FileNotFoundError):
        job(cand="absent.jsonl")
