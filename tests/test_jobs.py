"""Runs from raw files, temperatures without Python workers, side counts in one pass."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from quillspark.operators import assembly, calibration, sampling
from quillspark.plans import jobs
from quillspark.sources import io


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


TOPICS = {"c1": "feeling sad and empty", "c2": "sleeping too little at night", "c3": "loss of energy"}


@pytest.fixture
def raw(tmp_path):
    rng = random.Random(4)
    posts, sents, labels = [], [], []
    for p in range(12):
        posts.append({"post_id": f"p{p}", "text": "x", "subreddit": "s"})
        for i in range(rng.randrange(2, 6)):
            cid = rng.choice([None, *TOPICS])
            text = f"{TOPICS[cid]} since {i} days" if cid else f"nothing here about {rng.choice(['cats', 'dogs', 'night'])}"
            sents.append({"post_id": f"p{p}", "sent_id": f"s{i}", "text": text})
            if cid:
                labels.append({"post_id": f"p{p}", "sent_id": f"s{i}", "cid": cid, "label": 1})
    at = tmp_path / "raw"
    at.mkdir()
    for name, lines in {"posts": posts, "sentences": sents, "labels_sc": labels, "labels_pc": [{"post_id": "p0", "cid": "c1", "label": 1}]}.items():
        (at / f"{name}.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n\nnot json\n")
    (at / "criteria.json").write_text(json.dumps([{"cid": c, "name": c, "is_core": True, "desc": d} for c, d in TOPICS.items()]))
    return at


def test_from_raw_files_to_gates(spark, raw, tmp_path):
    out, ran = jobs.evidence_run(spark, str(raw), f"{tmp_path}/run", k=3)
    names = [s.name for s in jobs.evidence_stages("x")]
    assert ran == names and sorted(out) == sorted(names)
    gold = {(g.doc_id, g.cid, g.sent_idx) for g in out["gold"].collect()}
    found = {(r.doc_id, r.cid, r.sent_idx) for r in out["candidates"].collect()}
    # Passages of a topic share all its words, so three candidates hold most gold.
    assert gold and len(gold & found) / len(gold) > 0.9
    scored = out["calibrated"].collect()
    assert {(r.doc_id, r.cid, r.sent_idx) for r in scored if r.label} == gold & found and all(0 < r.prob_cal < 1 for r in scored)
    metric = {r.metric: r.value for r in out["metrics"].collect()}
    assert metric["auprc"] > 0.95 and metric["ece"] <= metric["initial_ece"] and set(metric) == {"recall@3", "recall@3_min", "auprc", "f1", "ece", "initial_ece", "improvement_pct", "precision@5", "coverage@5"}
    gate = {r.name: r.passed for r in out["gates"].collect()}
    assert gate["evidence_auprc"] and gate["data_leakage_fold0"] and gate["data_leakage_fold1"] and not gate["retrieval_recall@20_overall"]

    again, ran = jobs.evidence_run(spark, str(raw), f"{tmp_path}/run", k=3)
    assert ran == [] and rows(again["gates"]) == rows(out["gates"])
    before = rows(out["passages"])
    _, ran = jobs.evidence_run(spark, str(raw), f"{tmp_path}/run", k=2)
    assert ran == ["candidates", "attached", "scores", "calibrated", "metrics", "gates"]
    with (raw / "sentences.jsonl").open("a") as f:
        f.write(json.dumps({"post_id": "p0", "sent_id": "s9", "text": "loss of energy"}) + "\n")
    more, ran = jobs.evidence_run(spark, str(raw), f"{tmp_path}/run", k=2)
    assert ran == names and len(rows(more["passages"])) == len(before) + 1


def test_a_stage_cut_off_runs_again(spark, tmp_path):
    calls = []

    def flaky(spark, inputs):
        calls.append(1)
        if len(calls) == 1:
            return spark.range(3).select(F.raise_error(F.lit("lost")).cast("long").alias("id"))
        return spark.range(3)

    stages = [jobs.Stage("a", flaky), jobs.Stage("b", lambda s, i: i["a"].select((F.col("id") + 1).alias("id")), ["a"])]
    with pytest.raises(Exception, match="lost"):
        jobs.run_stages(spark, stages, str(tmp_path))
    out, ran = jobs.run_stages(spark, stages, str(tmp_path))
    assert ran == ["a", "b"] and rows(out["b"]) == [(1,), (2,), (3,)]
    assert jobs.run_stages(spark, stages, str(tmp_path))[1] == [] and len(calls) == 2
    for bad in ([stages[1]], [stages[0], stages[0]]):
        with pytest.raises(ValueError):
            jobs.run_stages(spark, bad, str(tmp_path))


def test_temperatures_are_plain_expressions(spark):
    rng = np.random.default_rng(0)
    data = [("ab"[i % 2], int(rng.random() < 1 / (1 + math.exp(-x / 2))), float(round(x, 4))) for i, x in enumerate(rng.normal(0, 3, 500))]
    data += [("few", 1, 0.5)] * 3 + [("sure", 1, 9.0)] * 20
    df = spark.createDataFrame(data, "cid string, label int, logit double")
    fitted = calibration.temperatures(df, "cid")
    assert not any(w in fitted._jdf.queryExecution().executedPlan().toString() for w in ("Python", "Pandas", "Arrow"))
    got = {r.cid: r.temperature for r in fitted.collect()}
    fit = lambda part: calibration.fit_temperature(np.array([r[2] for r in part]), np.array([r[1] for r in part], float))
    for cid in ("a", "b", "sure"):
        assert got[cid] == pytest.approx(fit([r for r in data if r[0] == cid]), abs=1e-6)
    assert got["few"] == pytest.approx(fit(data), abs=1e-6) == got[None]
    assert calibration.temperatures(df.limit(0), "cid").count() == 0


def test_bad_lines_are_counted_with_the_rows(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n  \nbroken\n{"a": 2}\n{"a"\n')
    seen = Observation("bad")
    df = io.read_jsonl(spark, f"{tmp_path}/x.jsonl", "a int", observation=seen)
    assert rows(df) == [(1,), (2,)] and seen.get == {"lines": 4, "malformed": 2}
    assert rows(io.read_jsonl(spark, f"{tmp_path}/x.jsonl", "a int")) == [(1,), (2,)]


def test_missing_sides_are_counted_with_the_rows(spark):
    c = spark.createDataFrame([(1, "a", 0, 1), (1, "a", 5, 1), (1, "x", 0, 1), (1, "x", 7, 2), (1, "a", 9, 3)], "doc_id int, cid string, sent_idx int, rank int")
    p, t = spark.createDataFrame([(1, 0, "s")], "doc_id int, sent_idx int, sent string"), spark.createDataFrame([("a", "t")], "cid string, text string")
    g = spark.createDataFrame([(1, "a", 0)], "doc_id int, cid string, sent_idx int")
    seen = Observation("missing")
    out = assembly.candidate_rows(c, p, t, g, 2, observation=seen)
    assert rows(out) == [(1, "a", 0, 1, "s", "t", 1)] and seen.get == {"candidates": 4, "no_passage": 2, "no_topic": 2}
    assert rows(assembly.candidate_rows(c, p, t, g, 2)) == rows(out)
    assert rows(assembly.unattached(c, p, t, 2)) == [("passage", 2), ("topic", 2)]


def test_epochs_draw_other_negatives(spark):
    passages = spark.createDataFrame([(d, i, f"p {i}") for d in (1, 2, 3) for i in range(40)], "doc_id long, sent_idx int, sent string")
    gold = spark.createDataFrame([(1, "a", 0), (1, "a", 1)], "doc_id long, cid string, sent_idx int")
    ranked = spark.createDataFrame([(1, "a", i, i + 1) for i in range(30)], "doc_id long, cid string, sent_idx int, rank int")
    zero = spark.createDataFrame([(2, "a", 0), (3, "a", 0)], "doc_id long, cid string, label int")
    draw = lambda epoch: rows(sampling.examples(gold, ranked, passages, zero, epoch=epoch))
    first, again, second = draw(0), draw(0), draw(1)
    assert first == again != second and len(first) == len(second)
    assert [r for r in first if r[4] == "gold"] == [r for r in second if r[4] == "gold"]
