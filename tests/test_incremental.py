"""An index kept up by batches of changes against one built anew."""

import random
import re

import pytest

from quillspark.sources import indexes
from quillspark.streaming.index import IncrementalIndex, index_stream

SCHEMA = "doc_id long, version long, text string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def same_as_rebuilt(spark, index, now: dict, folder: str):
    """Postings, frequencies, totals and searches are those of the present texts."""
    fresh = indexes.build_lexical_index(spark.createDataFrame(list(now.items()), "doc_id long, text string"), folder, buckets=3)
    got = index.open()
    keys = ["doc_id", "sent_idx", "term", "tf", "dl", "norm", "lead"]
    assert rows(got.postings.select(keys)) == rows(fresh.postings.select(keys))
    assert rows(got.terms.select("term", "df")) == rows(fresh.terms.select("term", "df"))
    (one,), (other,) = rows(got.stats), rows(fresh.stats)
    assert one[0] == other[0] and one[1] == (pytest.approx(other[1]) if other[1] is not None else None)
    topics = spark.createDataFrame([("t", "w1 w2 w2 w30"), ("u", "w3 absent")], "cid string, text string")
    for search in (indexes.search_bm25, indexes.search_sparse):
        assert rows(search(got, topics, 2)) == rows(search(fresh, topics, 2))


def random_text(rng):
    return " ".join(f"w{int(rng.paretovariate(0.7)) % 40}" + rng.choice(["", "", ".", "!"]) for _ in range(rng.randrange(12)))


def test_three_batches_equal_a_rebuild(spark, tmp_path):
    rng = random.Random(5)
    index, held = IncrementalIndex(spark, f"{tmp_path}/i"), {}
    for epoch in range(3):
        batch = [(rng.randrange(25), rng.randrange(6), rng.choice([None, "", "?! ...", *[random_text(rng) for _ in range(9)]])) for _ in range(20)]
        for doc in {d for d, _, _ in batch}:
            version, _, text = max((v, t is not None, t or "") for d, v, t in batch if d == doc)
            is_text = any(t is not None for d, v, t in batch if d == doc and v == version)
            if doc not in held or version > held[doc][0]:
                held[doc] = (version, text if is_text else None)
        index.apply(spark.createDataFrame(batch, SCHEMA), epoch)
        same_as_rebuilt(spark, index, {d: t for d, (_, t) in held.items()}, f"{tmp_path}/r{epoch}")
    now = {d: t for d, (_, t) in held.items()}
    # A batch that runs again after a lost driver, and one that stopped half-way.
    index.apply(spark.createDataFrame(batch, SCHEMA), 2)
    spark.range(3).write.parquet(f"{tmp_path}/i/batch-3/postings")
    same_as_rebuilt(spark, index, now, f"{tmp_path}/r3")
    index.apply(spark.createDataFrame([(99, 1, "w1 w1. w2"), (0, 9, None)], SCHEMA), 3)
    same_as_rebuilt(spark, index, now | {99: "w1 w1. w2", 0: None}, f"{tmp_path}/r4")


def test_compaction_keeps_versions_and_buckets(spark, tmp_path):
    index = IncrementalIndex(spark, f"{tmp_path}/i")
    index.compact()
    index.apply(spark.createDataFrame([(1, 1, "w1 w2. w3"), (2, 1, "w2"), (3, 5, "w9 w9")], SCHEMA), 0)
    index.apply(spark.createDataFrame([(1, 2, "w3 w4"), (3, 6, None)], SCHEMA), 1)
    index.compact(buckets=3)
    index.compact(buckets=3)
    now = {1: "w3 w4", 2: "w2"}
    same_as_rebuilt(spark, index, now, f"{tmp_path}/r0")
    found = indexes.search_bm25(index.open(), spark.createDataFrame([("t", "w3 w2")], "cid string, text string"), 2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and not re.search(r"(?<!Broadcast)Exchange", plan), plan
    # A batch from before is not taken in twice; a document that went keeps its version.
    index.apply(spark.createDataFrame([(7, 1, "w7")], SCHEMA), 1)
    index.apply(spark.createDataFrame([(3, 6, "late"), (2, 3, "w5. w6 w2")], SCHEMA), 2)
    now[2] = "w5. w6 w2"
    same_as_rebuilt(spark, index, now, f"{tmp_path}/r1")
    index.apply(spark.createDataFrame([(3, 7, "w9")], SCHEMA), 3)
    index.compact(buckets=2)
    same_as_rebuilt(spark, index, now | {3: "w9"}, f"{tmp_path}/r2")


def test_odd_batches(spark, tmp_path):
    index = IncrementalIndex(spark, f"{tmp_path}/i")
    assert index.open().postings.count() == 0 and rows(index.open().stats) == [(0, None)]
    index.apply(spark.createDataFrame([], SCHEMA), 0)
    assert index.open().terms.count() == 0 and rows(index.open().stats) == [(0, None)]
    odd = [(None, 1, "w1", 0), (1, None, "w1", 0), (2, 1, "w1 " * 200_000, 0), (2, 1, "a", 1), (2, 1, "w1 " * 200_000, 1), (3, 1, None, 0), (3, 1, "", 0)]
    index.apply(spark.createDataFrame(odd, SCHEMA + ", term int"), 1)
    same_as_rebuilt(spark, index, {2: "w1 " * 200_000, 3: ""}, f"{tmp_path}/r")


def test_stream_of_changes(spark, tmp_path):
    waves = [[(1, 1, "w1. w2 w3"), (2, 1, "w2")], [(1, 2, "w3 w1"), (4, 1, "w1 w30")], [(2, 2, None), (1, 1, "late")]]
    for i, wave in enumerate(waves):
        spark.createDataFrame(wave, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/wave={i}")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
        index_stream(stream, f"{tmp_path}/i", f"{tmp_path}/ck", compact_every=2).awaitTermination()
    same_as_rebuilt(spark, IncrementalIndex(spark, f"{tmp_path}/i"), {1: "w3 w1", 4: "w1 w30"}, f"{tmp_path}/r")
