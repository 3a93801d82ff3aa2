"""Text functions, sources, splits, sampling, ground truth, graphs and streams."""

import json

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import graph, groundtruth, retrieval, sampling, scoring, splits
from quillspark.sources import io, schemas


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "x string").select(fn(F.col("x")).alias("y")).first().y


def test_passages_and_tokens(spark):
    assert one(spark, "One two. Three!  Four? \n\n Five", T.passages) == ["One two.", "Three!", "Four?", "Five"]
    assert one(spark, "", T.passages) == []
    assert one(spark, "Étion ça_1, x-Y", T.tokens) == ["étion", "ça_1", "x", "y"]


def test_offsets_point_into_the_text(spark):
    text = "  One two. Three!  Four"
    got = one(spark, text, T.passage_offsets)
    assert [(text[p.start : p.end].strip(), p.sent) for p in got] == [(p.sent, p.sent) for p in got]
    assert [p.sent for p in got] == ["One two.", "Three!", "Four"]


def test_chunk_starts(spark):
    words = " ".join(f"w{i}" for i in range(30))
    chunk = lambda c: T.chunks(F.split(c, " "), 10, 5)
    got = one(spark, words, chunk)
    assert [c.start for c in got] == [0, 5, 10, 15, 20] and got[-1].words[-1] == "w29"
    with pytest.raises(ValueError):
        T.chunks(F.col("x"), 10, 10)
    empty = spark.range(1).select(T.chunks(F.array().cast("array<string>"), 10, 5).alias("y")).first().y
    assert [(c.start, c.words) for c in empty] == [(0, [])]


def test_cues_durations_codes(spark):
    assert one(spark, "I do not, never not", lambda c: T.cue_flags(c, T.NEGATION_CUES)) == [0, 0, 0, 1, 1]
    assert [one(spark, s, T.duration_days) for s in ("for 2 weeks", "3days", "1 month", "none", "2 years")] == [14, 3, 30, None, None]
    assert [one(spark, s, T.short_code) for s in ("A.1", "A.9", "A.10", "x")] == ["c1", "c9", None, None]
    assert [one(spark, s, T.annotation_index) for s in ("s_1270_9_6", "s_1", "s_1_2_x")] == [6, None, None]
    assert one(spark, "k", lambda c: T.mapped(c, {"k": "v"})) == "v" and one(spark, "z", lambda c: T.mapped(c, {"k": "v"})) == "z"


def test_locate_span(spark):
    find = lambda needle: one(spark, "ab cd. ef", lambda c: T.locate_span(c, F.lit(needle)))
    assert tuple(find("cd.")) == (3, 6) and tuple(find("cd!")) == (3, 5) and find("zz") is None


def test_simple_encode(spark):
    r = one(spark, " ".join(["w"] * 40), lambda c: T.simple_encode(c, F.lit("a b c d e"), 15))
    assert len(r.ids) == len(r.types) == len(r.mask) == 15 and sum(r.mask) == 15
    assert r.ids[0] == 1 and r.ids.count(2) == 2 and sum(r.types) == 6


def test_bm25_ranks_the_match_first_and_keeps_documents_apart(spark):
    docs = spark.createDataFrame([(1, "Filler text here. Banana split now."), (2, "Banana again.")], "doc_id long, text string")
    topics = spark.createDataFrame([(7, "banana")], "cid long, text string")
    got = retrieval.top_k(retrieval.bm25(docs, topics), 2).collect()
    assert {(r.doc_id, r.sent_idx, r.rank) for r in got} == {(1, 1, 1), (2, 0, 1)}
    full = retrieval.zero_filled(retrieval.bm25(docs, topics), docs, topics, 2).collect()
    assert {(r.doc_id, r.sent_idx, r.rank) for r in full} == {(1, 1, 1), (1, 0, 2), (2, 0, 1)}


def test_chunk_aggregation(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.8), (2, 0.5)], "d int, prob double")
    get = lambda m: {r.d: r.prob for r in scoring.aggregate_chunks(df, ["d"], m, 3).collect()}
    assert get("max") == {1: 0.8, 2: 0.5}
    assert get("topm") == {1: pytest.approx(1 / 3), 2: pytest.approx(0.5 / 3)}
    assert get("logsumexp")[2] == pytest.approx(0.5)
    with pytest.raises(ValueError):
        get("mean")


def test_scorer_seam(spark):
    score = scoring.vector_scorer(lambda t, c: t.str.len() - c.str.len())
    assert spark.createDataFrame([("abc", "x")], "a string, b string").select(score("a", "b").alias("s")).first().s == 2.0


def test_split_sizes_and_determinism(spark):
    docs = spark.range(103).withColumnRenamed("id", "doc_id")
    a = {r.doc_id: r.split for r in splits.ratio_split(docs, 0.8, 0.1, 3).collect()}
    b = {r.doc_id: r.split for r in splits.ratio_split(docs.repartition(7), 0.8, 0.1, 3).collect()}
    assert a == b and [list(a.values()).count(s) for s in ("train", "dev", "test")] == [82, 10, 11]


def test_folds_are_disjoint(spark):
    counts = spark.range(50).select(F.col("id").alias("doc_id"), (F.col("id") % 4).alias("n_pos"))
    f = splits.round_robin_folds(counts, 5)
    assert [r["count"] for r in f.groupBy("fold").count().orderBy("fold").collect()] == [10] * 5
    parts = splits.dev_tail(f)
    assert parts.where("part = 'dev'").groupBy("fold").count().where("count = 4").count() == 5
    assert splits.leakage(parts, f).agg(F.sum("leaked")).first()[0] == 0
    assert splits.leakage(f, f).agg(F.sum("leaked")).first()[0] == 50


def test_sampling_quotas_and_pools(spark):
    pos = spark.createDataFrame([(1, "a", 0), (1, "a", 1)], "doc_id long, cid string, sent_idx int")
    q = sampling.quotas(pos).first()
    assert (q.n_pos, q.n_neg, q.n_hard, q.n_random, q.n_cross) == (2, 12, 9, 1, 1)
    passages = spark.createDataFrame([(d, i) for d in (1, 2) for i in range(5)], "doc_id long, sent_idx int")
    pool = sampling.random_pool(passages, pos)
    assert {r.sent_idx for r in pool.collect()} == {2, 3, 4}
    assert sampling.take(pool, sampling.quotas(pos), "n_random", "random", 1).count() == 1
    neg = spark.createDataFrame([(2, "a"), (3, "b"), (1, "a")], "doc_id long, cid string")
    assert {(r.other_id, r.sent_idx) for r in sampling.cross_pool(passages, pos, neg).collect()} == {(2, i) for i in range(5)}
    assert [r.other_id for r in sampling.cross_limits(sampling.quotas(pos), neg).collect()] == [2]
    cand = spark.createDataFrame([(1, "a", s, r) for r, s in enumerate((0, 2), 1)], "doc_id long, cid string, sent_idx int, rank int")
    got = sampling.top_up(cand, pos, passages, 2, 1).collect()
    assert {(r.sent_idx, r.priority) for r in got} >= {(2, 0)} and len(got) == 2


def test_ground_truth_padding(spark):
    passages = spark.createDataFrame([(1, 0, "x"), (1, 1, "y"), (2, 0, "z")], "doc_id long, sent_idx int, sent string")
    topics = spark.createDataFrame([("a",), ("b",)], "cid string")
    ann = spark.createDataFrame([(1, 3, "a", 1, "note"), (1, 0, "b", 0, "x")], "doc_id long, sent_idx int, cid string, status int, text string")
    got = groundtruth.passage_truth(passages, topics, ann).collect()
    assert len(got) == 8 and {r.doc_id for r in got} == {1}
    assert [(r.sent_idx, r.cid, r.sent) for r in got if r.label] == [(3, "a", "note")]
    assert {r.sent for r in got if r.sent_idx == 2} == {""}


def test_context_and_rebuild(spark):
    df = spark.createDataFrame([(1, 0, "a"), (1, 1, ""), (1, 2, "c")], "d long, i int, t string")
    assert {r.i: r.context for r in groundtruth.with_context(df, "d", "i", "t").collect()} == {0: "a", 1: "a [SEP] c", 2: "c"}
    p = spark.createDataFrame([(1, 2, "two"), (1, 10, "ten")], "doc_id long, sent_idx int, sent string")
    assert groundtruth.rebuilt_text(p).first().text == "ten two"


def test_supports_edges_have_six_attributes(spark):
    p = spark.createDataFrame([(1, 0, "never 2 weeks"), (1, 1, "maybe")], "doc_id long, sent_idx int, sent string")
    s = spark.createDataFrame([(1, 0, "c", 1.0, 0.7)], "doc_id long, sent_idx int, cid string, logit double, prob double")
    e = graph.supports_edges(s, p).first()
    assert e.attrs == [1.0, 0.7, 1.0, 0.0, 14.0, 0.0] and e.label == 1


def test_cooccurrence(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "b"), (3, "a"), (4, "c")], "doc_id long, cid string")
    r = graph.cooccurrence(df).collect()
    assert [(x.cid1, x.cid2, x.cofreq) for x in r] == [("a", "b", 2)]


def test_jsonl_skips_and_strict(spark, tmp_path):
    f = tmp_path / "a.jsonl"
    f.write_text('{"post_id": "p", "cid": "c", "label": 1}\n\nnot json\n{"post_id": "q", "cid": "c", "label": 3}\n')
    assert io.read_jsonl(spark, str(f), schemas.LABEL_PC).count() == 2
    with pytest.raises(Exception):
        io.load_models(spark, str(f), schemas.LABEL_PC).collect()
    with pytest.raises(Exception, match="label breaks"):
        io.checked(io.read_jsonl(spark, str(f), schemas.LABEL_PC)).collect()
    with pytest.raises(ValueError):
        io.guarded_path("../x", str(tmp_path))
    assert io.read_optional(spark, str(tmp_path / "none"), schemas.LABEL_PC).count() == 0


def test_id_lists_and_manifest(spark, tmp_path):
    f = tmp_path / "ids"
    for body in ('["a", {"post_id": "b"}]', '{"posts": ["a", "b"]}', '{"post_id": "a"}\n{"id": "b"}', "a\nb\n"):
        f.write_text(body)
        assert {r.post_id for r in io.read_post_ids(spark, str(f)).collect()} == {"a", "b"}
    many = tmp_path / "a folder"
    many.mkdir()
    bodies = ['[\n "a",\n {"post_id": "b"}\n]', '{\n "posts": ["c",\n "d"]\n}', '{\n "post_id": "e"\n}', '\n  f \n\n"g"\n{"id": "h"}\n{"x": 1}\n', "", '["i"]']
    for i, body in enumerate(bodies):
        (many / f"{i}.txt").write_text(body)
    assert sorted(r.post_id for r in io.read_post_ids(spark, str(many)).collect()) == list("abcdefghi")
    (many / "broken").write_text('[ "z",\n')
    assert sorted(r.post_id for r in io.read_post_ids(spark, str(many)).collect()) == list("abcdefghi")
    plan = io.read_post_ids(spark, str(f))._jdf.queryExecution().toString()
    assert "wholetext" not in plan.lower()
    f.write_text('{"post_id": "a"}\n{"id": "b"}\nbad\n')
    assert {r.post_id for r in io.read_manifest(spark, str(f)).collect()} == {"a", "b"}


def test_folds_csv_topics_metrics(spark, tmp_path):
    for i in range(2):
        (tmp_path / f"fold_{i}_predictions.jsonl").write_text(json.dumps({"post_id": "p", "sent_id": "s", "cid": "c", "label": 1, "prob": 0.5}))
    assert {r.fold for r in io.read_folds(spark, str(tmp_path)).collect()} == {0, 1}
    with pytest.raises(FileNotFoundError):
        io.read_folds(spark, str(tmp_path / "none"))
    df = spark.createDataFrame([("a", 'x "y"\nz')], "id string, t string")
    io.write_csv(df, str(tmp_path / "csv"))
    assert io.read_csv(spark, str(tmp_path / "csv"), "id string, t string").collect() == df.collect()
    (tmp_path / "m.json").write_text(json.dumps({"diagnosis": "d", "criteria": [{"id": f"A.{i}", "text": "t"} for i in (1, 9, 10)]}, indent=1))
    assert {r.cid for r in io.read_topics_document(spark, str(tmp_path / "m.json")).collect()} == {"c1", "c9"}
    io.write_metrics(spark.createDataFrame([("overall", "f1", 0.5)], "scope string, metric string, value double"), str(tmp_path / "o" / "m.json"))
    assert json.loads((tmp_path / "o" / "m.json").read_text()) == {"overall": {"f1": 0.5}}
    assert io.flatten({"a": {"b": 1}, "c": 2}) == {"a.b": 1, "c": 2}


def test_stream_ingest_is_replayable(spark, tmp_path, sf):
    from quillspark.streaming import ingest

    src = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    src.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    ingest.append_postings(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).agg(F.sum("tf")).first()[0] == src.select(F.explode(T.passages(F.col("text"))).alias("s")).agg(F.sum(F.size(T.tokens(F.col("s"))))).first()[0]


def test_cross_document_negatives_are_passages(spark):
    passages = spark.createDataFrame([(d, i) for d in range(1, 6) for i in range(10)], "doc_id long, sent_idx int")
    pos = spark.createDataFrame([(1, 7, i) for i in range(4)] + [(2, 8, 0)], "doc_id long, cid long, sent_idx int")
    neg = spark.createDataFrame([(d, 7) for d in (1, 3, 4, 99)] + [(5, 8)], "doc_id long, cid long")
    limits = sampling.quotas(pos, per_pos=30)
    cross = [tuple(r) for r in sampling.cross_take(limits, neg, passages).drop("source").collect()]
    pool = {tuple(r) for r in sampling.cross_pool(passages, pos, neg).collect()}
    assert len(cross) == len(set(cross)) == 12 + 3 and set(cross) <= pool
    cand = spark.createDataFrame([(1, 7, i, i + 1) for i in range(10)] + [(2, 9, 0, 1)], "doc_id long, cid long, sent_idx int, rank int")
    got = sampling.examples(pos, cand, passages, neg, per_pos=5).collect()
    n = {s: sum(r.source == s and r.doc_id == 1 for r in got) for s in ("gold", "hard", "random", "cross")}
    assert n == {"gold": 4, "hard": 6, "random": 2, "cross": 2}
    assert all((r.label == 1) == (r.source == "gold") and (r.other_id == r.doc_id) == (r.source != "cross") for r in got)
