"""Running sums, graph records, vectorisers and indexes that are written and read back."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quillspark.operators import assembly, calibration, classification, graph_records, retrieval, splits
from quillspark.operators.vectoriser import Vectoriser, sparse_dot
from quillspark.sources import graphs, indexes


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- running sums -------------------------------------------------------------


def test_running_sums_against_a_loop(spark):
    rng = random.Random(3)
    data = [(rng.choice(["a", "b", None]), rng.choice([1, 2]), i, rng.randrange(5), rng.randrange(3)) for i in range(700)]
    data += [("hot", 1, i, 1, 0) for i in range(900)]
    df = spark.createDataFrame(data, "g string, h int, o int, v long, u long").repartition(5)
    for by in ([], ["g"], ["g", "h"]):
        got = {r.o if r.g != "hot" else r.o + 10_000: (r.run_v, r.run_u, r.all_v, r.all_u) for r in splits.running_sums(df, by, [F.desc("o"), F.desc("g")], ["v", "u"], parts=7).collect()}
        key = lambda r: tuple({"g": r[0], "h": r[1]}[c] for c in by)  # noqa: E731, B023
        run, want = defaultdict(lambda: [0, 0]), {}
        for r in sorted(data, key=lambda r: (r[2], r[0] is not None, r[0] or ""), reverse=True):
            s = run[key(r)]
            s[0] += r[3]
            s[1] += r[4]
            want[r[2] if r[0] != "hot" else r[2] + 10_000] = (s[0], s[1], key(r))
        assert got == {o: (a, b, *run[k]) for o, (a, b, k) in want.items()}
    assert splits.running_sums(df.limit(0), ["g"], ["o"], ["v"]).count() == 0 and splits.running_sums(df.limit(0), [], ["o"], ["v"]).count() == 0


def test_no_class_stands_in_one_task(spark):
    """One class with many scores is spread over tasks in every query on curves."""
    df = spark.range(4000).select(F.lit("a").alias("cid"), (F.col("id") % 2).cast("int").alias("label"), (F.col("id") / 4000).alias("prob"))
    for out in (classification.curve(df, ["cid"]), classification.curve_areas(df, ["cid"]), calibration.best_thresholds(df, ["cid"])):
        assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
    spread = splits.running_sums(df.withColumn("one", F.lit(1).cast("long")), ["cid"], ["prob"], ["one"], parts=8)
    assert sorted(r.run_one for r in spread.collect()) == list(range(1, 4001))


def test_bundle_from_one_curve(spark):
    """Every figure of the bundle against plain sums, with optimal thresholds and macro means."""
    rng = random.Random(8)
    data = [(c, int(rng.random() < 0.4) if c != "none" else 0, round(rng.random(), 2), round(rng.random(), 2)) for c in ["a"] * 60 + ["b"] * 40 + ["none"] * 15]
    df = spark.createDataFrame(data, "cid string, label int, prob double, prob_cal double")
    got = {(r.scope, r.cid): r for r in assembly.evidence_bundle(df).collect()}

    def figures(part):
        y, cal = [r[1] for r in part], [r[3] for r in part]
        prf = lambda t: (lambda tp, fp, fn: (tp / (tp + fp) if tp + fp else 0, tp / (tp + fn) if tp + fn else 0, 2 * tp / (2 * tp + fp + fn) if 2 * tp + fp + fn else 0))(
            sum(a for a, p in zip(y, cal, strict=True) if p >= t), sum(1 - a for a, p in zip(y, cal, strict=True) if p >= t), sum(a for a, p in zip(y, cal, strict=True) if p < t))
        best = max(sorted(set(cal)), key=lambda t: (round(prf(t)[2], 9), -t))
        ap = lambda k: sum((sum(a for a, r in zip(y, part, strict=True) if r[k] == t) / sum(y)) * (sum(a for a, r in zip(y, part, strict=True) if r[k] >= t) / sum(r[k] >= t for r in part)) for t in {r[k] for r in part}) if 0 < sum(y) < len(y) else None
        def ece(k):
            bins = defaultdict(list)
            for r in part:
                bins[min(9, int(r[k] * 10))].append(r)
            return sum(abs(sum(r[1] for r in b) - sum(r[k] for r in b)) for b in bins.values()) / len(part)

        return (len(part), sum(y), ap(2), ap(3), best, prf(best)[2], *prf(best)[:2], *prf(0.5), ece(2), ece(3))

    for scope, cid, part in [("overall", "all", data)] + [("topic", c, [r for r in data if r[0] == c]) for c in ("a", "b", "none")]:
        r = got[scope, cid]
        mine = (r.n, r.n_pos, r.auprc, r.auprc_cal, r.threshold, r.f1, r.precision_best, r.recall_best, r.precision_half, r.recall_half, r.f1_half, r.ece_before, r.ece_after)
        assert [x if x is None else pytest.approx(x, abs=1e-6) for x in mine] == list(figures(part)), (scope, cid)
    macro = assembly.macro_report(assembly.evidence_bundle(df)).first()
    of = [figures([r for r in data if r[0] == c]) for c in ("a", "b", "none")]
    assert macro.topics == 3 and macro.auprc == pytest.approx((of[0][2] + of[1][2]) / 2, abs=1e-6)
    assert macro.f1 == pytest.approx(sum(f[5] for f in of) / 3, abs=1e-6) and macro.precision_half == pytest.approx(sum(f[8] for f in of) / 3, abs=1e-6)


# --- graph records ------------------------------------------------------------

PASSAGES = [(1, 0, "It is not a week"), (1, 4, "perhaps 3 days"), (1, 9, "c"), (2, 0, "only one"), (5, 0, "no scores"), (5, 1, "here")]
SCORES = [(1, 4, "b", 1.0, 0.8), (1, 0, "b", -1.0, 0.2), (1, 9, "a", 0.0, 0.5), (1, 7, "a", 0.0, 0.5), (1, 0, "gone", 0.0, 0.9), (2, 0, "a", 2.0, 0.9), (3, 0, "a", 2.0, 0.9)]


def _graphs(spark):
    p = spark.createDataFrame(PASSAGES, "doc_id long, sent_idx int, sent string")
    t = spark.createDataFrame([("b", "x" * 50, True), ("a", "y", False), ("c", "z", False)], "cid string, text string, is_core boolean")
    s = spark.createDataFrame(SCORES, "doc_id long, sent_idx int, cid string, logit double, prob double")
    d = spark.createDataFrame([(1, "b", 0.5, 0.6), (1, "a", -0.5, 0.4), (2, "c", 3.0, 0.9), (3, "a", 1.0, 0.7), (1, "gone", 1.0, 0.9)], "doc_id long, cid string, logit double, prob double")
    return p, t, s, d


def test_scored_records(spark):
    """Node numbers are local, edges to what isn't there go, documents without passages, too."""
    got = {r.doc_id: r for r in graph_records.scored_graphs(*_graphs(spark)).collect()}
    assert sorted(got) == [1, 2, 5]
    one, two, five = got[1], got[2], got[5]
    assert (one.n_passages, one.n_topics, one.passage.sent_idx, [x[0] for x in one.passage.x]) == (3, 3, [0, 4, 9], [16.0, 14.0, 1.0])
    assert (one.supports.src, one.supports.dst, one.supports.label) == ([2, 0, 1], [0, 1, 1], [1, 0, 1])
    assert one.supports.attrs[1] == [-1.0, 0.2, 1.0, 0.0, 0.0, 0.0] and one.supports.attrs[2] == [1.0, 0.8, 0.0, 1.0, 3.0, 2.0]
    assert (one.next.src, one.next.dst, one.contains.src, one.contains.dst) == ([0, 1], [1, 2], [0, 0, 0], [0, 1, 2])
    assert (one.matches.src, one.matches.dst, one.matches.attrs, one.matches.label, one.topic.y) == ([0, 0], [0, 1], [[-0.5, 0.4], [0.5, 0.6]], [0, 1], [0, 1, 0])
    assert (two.next.src, two.supports.src, two.topic.y) == ([], [0], [0, 0, 1])
    assert five.supports.src == five.matches.dst == [] and five.topic.y == [0, 0, 0]


def test_retrieved_records(spark):
    p, t, s, d = _graphs(spark)
    s = s.withColumnRenamed("prob", "prob_cal").withColumns({"label": F.when(F.col("logit") > 0, 1).otherwise(0), "dense": F.lit(0.25), "dense_rank": F.lit(1), "sparse_rank": F.lit(None).cast("int")})
    truth = spark.createDataFrame([(1, "a", 1), (1, "a", 0), (2, "a", 1), (1, "c", 0)], "doc_id long, cid string, label int")
    nodes = p.select("doc_id", "sent_idx", F.array(F.lit(0.5), F.lit(1.5)).alias("x"))
    got = {r.doc_id: r for r in graph_records.retrieved_graphs(nodes, t, s, d.withColumnRenamed("prob", "prob_cal"), truth, k=1).collect()}
    assert sorted(got) == [1, 2, 5] and got[1].passage.x[0] == [0.5, 1.5]
    # Of topic a the best passage, 7, isn't there; the tie went to the smaller place.
    assert (got[1].supports.src, got[1].supports.dst, got[1].supports.label, got[1].supports.attrs) == ([1], [1], [1], [[1.0, 0.8, 0.25, 0.5, 0.0]])
    assert (got[1].matches.dst, got[1].matches.label, got[1].topic.y) == ([0, 1], [1, 0], [1, 0, 0])
    assert got[2].topic.y == [1, 0, 0] and got[2].matches.label == [0]


def test_records_of_single_documents(spark, tmp_path):
    records = graph_records.scored_graphs(*_graphs(spark))
    graphs.write_graph_records(records, str(tmp_path), shards=5, k=15)
    meta = graphs.graph_metadata(spark, str(tmp_path))
    assert (meta["n_graphs"], meta["n_passages"], meta["n_topics"], meta["n_supports"], meta["n_next"], meta["top_k"]) == (3, 6, 3, 4, 3, 15)
    whole = {r.doc_id: r for r in records.collect()}
    assert {r.doc_id: r for r in graphs.read_graph_records(spark, str(tmp_path)).collect()} == whole
    assert graphs.graph_of(spark, str(tmp_path), 2) == whole[2]
    some = graphs.read_graph_records(spark, str(tmp_path), 1, 5)
    assert sorted(r.doc_id for r in some.collect()) == [1, 5]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*shard", plan)
    with pytest.raises(IndexError):
        graphs.graph_of(spark, str(tmp_path), 3)
    edges = {rel: sorted(tuple(r)[:3] for r in graph_records.edge_rows(records, rel).collect()) for rel in graph_records.RELATIONS}
    assert edges["supports"] == [(1, 0, 1), (1, 1, 1), (1, 2, 0), (2, 0, 0)] and edges["next"] == [(1, 0, 1), (1, 1, 2), (5, 0, 1)]
    with pytest.raises(ValueError):
        graph_records.edge_rows(records, "other")


def test_no_graphs(spark, tmp_path):
    p, t, s, d = _graphs(spark)
    none = graph_records.scored_graphs(p.limit(0), t, s, d)
    graphs.write_graph_records(none, str(tmp_path))
    assert graphs.graph_metadata(spark, str(tmp_path))["n_graphs"] == 0


# --- vectoriser ---------------------------------------------------------------


def _grams(text):
    w = [x for x in re.findall(r"\w+", (text or "").lower()) if len(x) >= 2]
    return w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]


def test_vectoriser_round_trip(spark, tmp_path):
    fit = [(1, 0, "alpha beta alpha"), (1, 1, "beta gamma"), (2, 0, "delta")]
    passages = spark.createDataFrame(fit, "doc_id long, sent_idx int, sent string")
    topics = spark.createDataFrame([("t", "alpha delta")], "cid string, text string")
    model = Vectoriser.fit(passages, topics, 5)
    model.save(f"{tmp_path}/v")
    again = Vectoriser.load(spark, f"{tmp_path}/v")
    new = spark.createDataFrame([(7, "Alpha alpha beta unseen"), (8, "nothing known"), (9, None), (10, "")], "id long, text string").withColumn("term", F.lit("x"))
    got = {r.id: r.vector for r in again.transform(new, ["id"], "text").collect()}
    assert rows(model.transform(new, ["id"], "text")) == rows(again.transform(new, ["id"], "text"))

    texts = [x[2] for x in fit] + ["alpha delta"]
    count, df = Counter(g for t in texts for g in _grams(t)), Counter(g for t in texts for g in set(_grams(t)))
    vocab = sorted(sorted(count, key=lambda g: (-count[g], g))[:5])
    idf = {g: math.log((1 + len(texts)) / (1 + df[g])) + 1 for g in vocab}
    x = {vocab.index(g): n * idf[g] for g, n in Counter(_grams("Alpha alpha beta unseen")).items() if g in idf}
    norm = math.sqrt(sum(v * v for v in x.values())) + 1e-8
    assert got[7].idx == sorted(x) and got[7].w == pytest.approx([x[i] / norm for i in sorted(x)])
    assert all(got[i].idx == [] == got[i].w for i in (8, 9, 10))
    near = sparse_dot(again.transform(new, ["id"], "text"), again.transform(topics, ["cid"], "text"), ["id"], ["cid"]).collect()
    assert [(r.id, r.cid) for r in near] == [(7, "t")] and 0 < near[0].score < 1


def test_vectoriser_backends(spark, tmp_path):
    model = Vectoriser.of_model(spark, "letters")
    model.save(f"{tmp_path}/m")
    again = Vectoriser.load(spark, f"{tmp_path}/m")
    assert (again.backend, again.model_name) == ("model", "letters")
    rows_ = spark.createDataFrame([(1, "ab"), (2, "aaab"), (3, None)], "id long, text string")

    def letters():
        return lambda texts: [[float(t.count("a")), float(t.count("b"))] for t in texts]

    got = {r.id: r.vector for r in again.transform(rows_, ["id"], "text", {"letters": letters}).collect()}
    assert got[1] == pytest.approx([2**-0.5, 2**-0.5], abs=1e-6) and got[2] == pytest.approx([0.9486833, 0.3162278], abs=1e-6) and got[3] == [0.0, 0.0]
    with pytest.raises(ValueError):
        again.transform(rows_, ["id"], "text")
    for bad in (("other", None), ("model", None)):
        with pytest.raises(ValueError):
            Vectoriser(model.vocabulary, *bad)


# --- model seam ---------------------------------------------------------------


def test_models_are_set_up_once_a_task(spark):
    from quillspark.operators import scoring

    loads, sizes = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    df = spark.range(1000).select("id", F.repeat(F.lit("w "), (F.col("id") * 37 % 101).cast("int")).alias("text"), F.lit("t").alias("topic")).repartition(3)

    def setup(weights):
        loads.add(1)

        def predict(texts, topics):
            sizes.add(1)
            assert len(texts) <= 16 and (len(texts) == 1 or len(texts) * (max(map(len, texts)) + 1) <= 400)
            return [len(t) * weights["scale"] + len(c) for t, c in zip(texts, topics, strict=True)]

        return predict

    out = scoring.scored(df, "text", "topic", "logit", setup, weights={"scale": 2.0}, batch=16, max_chars=400)
    got = out.collect()
    assert all(r.logit == 2 * len(r.text) + 1 for r in got) and len(got) == 1000
    assert loads.value == 3 and sizes.value >= 1000 // 16
    other = scoring.scored(df, "text", "topic", "logit", lambda: lambda a, b: [len(x) * 2.0 + len(y) for x, y in zip(a, b, strict=True)], batch=1000, max_chars=10**9)
    assert rows(other) == rows(out)


# --- stored indexes -----------------------------------------------------------


def test_stored_lexical_index(spark, tmp_path):
    texts = ["alpha beta. gamma alpha alpha! beta", "gamma zeta", None, "", "!!! ... ???", "alpha. alpha beta gamma."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    topics = spark.createDataFrame([("t", "alpha gamma gamma"), ("u", "zeta beta"), ("v", "absent")], "cid string, text string")
    indexes.build_lexical_index(docs, f"{tmp_path}/i", buckets=3)
    index = indexes.open_lexical_index(spark, f"{tmp_path}/i")
    found = indexes.search_bm25(index, topics, 2)
    assert rows(found) == rows(retrieval.top_k(retrieval.bm25(docs, topics), 2)) != []
    assert rows(indexes.search_sparse(index, topics, 2)) == rows(retrieval.top_k(retrieval.sparse_cosine(docs, topics), 2))
    for search in (found, indexes.search_sparse(index, topics, 2)):
        plan = search._jdf.queryExecution().executedPlan().toString()
        assert "Bucketed: true" in plan and not re.search(r"(?<!Broadcast)Exchange", plan), plan


def test_stored_dense_index(spark, tmp_path):
    rng = random.Random(2)
    v = spark.createDataFrame([(i // 10, i, [rng.random() for _ in range(4)]) for i in range(60)], "doc_id long, vec_id long, embedding array<double>")
    indexes.build_dense_index(v, f"{tmp_path}/d", buckets=4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = indexes.search_dense(indexes.read_bucketed(spark, f"{tmp_path}/d"), indexes.read_bucketed(spark, f"{tmp_path}/d"), 3)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan, plan
        want = retrieval.top_k(retrieval.dense_scores(v, v, "doc_id", group_first=True), 3, ("doc_id", "query_id"), "vec_id")
        assert rows(out) == rows(want) and out.count() == 180
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_curves_with_many_classes(spark):
    """Classes, null among them, that lie across range partitions."""
    rng = random.Random(1)
    data = [(c, int(rng.random() < 0.5), rng.randrange(6) / 6) for c in ["a", "b", None, "d"] for _ in range(25)]
    got = {(r.cid, round(r.threshold, 6)): (r.tp, r.fp, r.pos, r.neg) for r in classification.curve(spark.createDataFrame(data, "cid string, label int, prob double"), ["cid"]).collect()}
    want = {}
    for c in {r[0] for r in data}:
        mine = [r for r in data if r[0] == c]
        for t in {r[2] for r in mine}:
            want[c, round(t, 6)] = (sum(r[1] for r in mine if r[2] >= t), sum(1 - r[1] for r in mine if r[2] >= t), sum(r[1] for r in mine), sum(1 - r[1] for r in mine))
    assert got == want


def test_attention_against_a_loop(spark):
    """Two relations and heads, a hub with most edges, repeated edges, and nodes without any."""
    import numpy as np

    from quillspark.operators import graph

    rng = np.random.default_rng(3)
    q, k, v = ({(n, r, h): rng.normal(size=3).round(3) for n in range(30) for r in ("x", "y") for h in (0, 1)} for _ in range(3))
    edges = [(int(s), 0, "x") for s in rng.integers(0, 30, 200)] + [(int(a), int(b), "xy"[i % 2]) for i, (a, b) in enumerate(rng.integers(0, 25, (60, 2)))] + [(99, 1, "x")]
    queries = spark.createDataFrame([(n, r, h, x.tolist()) for (n, r, h), x in q.items()], "dst int, relation string, head int, q array<double>")
    keys = spark.createDataFrame([(n, r, h, x.tolist(), v[n, r, h].tolist()) for (n, r, h), x in k.items()], "src int, relation string, head int, k array<double>, v array<double>")
    out = graph.edge_attention(queries, keys, spark.createDataFrame(edges, "src int, dst int, relation string"), 3**-0.5)
    got = {(r.dst, r.relation, r.head): r.value for r in out.collect()}
    want = {}
    for d in range(30):
        for r in ("x", "y"):
            src = [a for a, b, rel in edges if b == d and rel == r and a < 30]
            for h in (0, 1) if src else ():
                s = np.array([q[d, r, h] @ k[a, r, h] for a in src]) * 3**-0.5
                w = np.exp(s - s.max())
                want[d, r, h] = (w / w.sum()) @ np.array([v[a, r, h] for a in src])
    assert got.keys() == want.keys() and all(got[x] == pytest.approx(want[x].tolist(), abs=1e-8) for x in want)


def test_merge_keeps_repeats(spark):
    from quillspark.operators import groundtruth

    p = spark.createDataFrame([(1, "a", 0.5), (1, "a", 0.6), (2, "a", 0.7)], "doc_id int, cid string, prob double")
    y = spark.createDataFrame([(1, "a", 1, 0), (1, "a", 0, 1), (3, "a", 1, 0)], "doc_id int, cid string, label int, ordinal int")
    keys = ["doc_id", "cid"]
    assert rows(groundtruth.merged(p, y, keys)) == [(1, "a", 0.5, 0), (1, "a", 0.5, 1), (1, "a", 0.6, 0), (1, "a", 0.6, 1)]
    assert rows(groundtruth.merged(p, y, keys, "last")) == [(1, "a", 0.5, 0), (1, "a", 0.6, 0)]
    with pytest.raises(ValueError):
        groundtruth.merged(p, y, keys, "first")
