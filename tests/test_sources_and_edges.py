"""Sources, sinks, encodings, edges and streams on small fixtures."""

import json
import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import graph, scoring
from quillspark.sources import io, schemas
from quillspark.streaming import ingest


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_json_lines_go_out_and_come_back(spark, tmp_path):
    df = spark.createDataFrame([("p1", "c1", 1), ("p2", "c1", 0)], schemas.LABEL_PC)
    for single in (False, True):
        path = f"{tmp_path}/out{single}"
        io.write_jsonl(df, path, single)
        assert rows(io.read_jsonl(spark, path, schemas.LABEL_PC)) == rows(io.load_models(spark, path, schemas.LABEL_PC)) == rows(df)
    assert len(list((tmp_path / "outTrue").glob("part-*"))) == 1


@pytest.fixture
def raw(tmp_path):
    tables = {
        "posts": [{"post_id": p, "text": f"text {p}"} for p in ("p1", "p2")],
        "sentences": [{"post_id": p, "sent_id": f"{p}_0", "text": "text", "char_span": [0, 4]} for p in ("p1", "p2")],
        "labels_sc": [{"post_id": "p1", "sent_id": "p1_0", "cid": "c1", "label": 1}],
        "labels_pc": [{"post_id": "p1", "cid": "c1", "label": 1}, {"post_id": "p2", "cid": "c1", "label": 0}],
    }
    for name, lines in tables.items():
        (tmp_path / f"{name}.jsonl").write_text("\n".join(map(json.dumps, lines)))
    (tmp_path / "criteria.json").write_text(json.dumps([{"cid": "c1", "name": "one", "is_core": True, "desc": "first"}]))
    return str(tmp_path)


def test_raw_dataset_and_its_restriction(spark, raw):
    data = io.load_raw_dataset(spark, raw)
    assert [t.count() for t in (data.posts, data.sentences, data.labels_sc, data.labels_pc, data.criteria)] == [2, 2, 1, 2, 1]
    some = io.filter_dataset(data, spark.createDataFrame([("p2",), ("p2",)], "post_id string"))
    assert [t.count() for t in (some.posts, some.sentences, some.labels_sc, some.labels_pc, some.criteria)] == [1, 1, 0, 1, 1]
    assert io.filter_dataset(data, None) is data and io.filter_dataset(data, spark.createDataFrame([], "post_id string")) is data


def test_index_and_graph_tables(spark, tmp_path):
    df = spark.createDataFrame([("p1", "w", 2), ("p2", "w", 1), ("p1", "v", 1)], "post_id string, term string, tf int")
    io.write_index(df, f"{tmp_path}/index", files=3)
    assert rows(io.read_index(spark, f"{tmp_path}/index")) == rows(df)
    io.write_graph({"nodes": df, "edges": df.limit(1)}, f"{tmp_path}/graph")
    assert dict(rows(spark.read.parquet(f"{tmp_path}/graph/metadata"))) == {"nodes": 3, "edges": 1}
    assert io.capture_env(spark).first().spark == spark.version


def test_encodings(spark):
    df = spark.createDataFrame([("a", "b", [3.0, 4.0], 4), ("a", None, [0.0, 0.0], None)], "x string, y string, v array<double>, r int")
    got = df.select(T.pair_text(F.col("x"), F.col("y")).alias("p"), T.l2_normalised(F.col("v")).alias("v"), T.inverse_rank(F.col("r")).alias("r")).collect()
    assert got[0].p == "a [SEP] b" and got[0].v == pytest.approx([0.6, 0.8]) and got[0].r == 0.2
    assert got[1].v == [0.0, 0.0] and got[1].r == 0.0
    encode = scoring.vector_encoder(lambda texts: pd.Series([[float(len(t)), 1.0] for t in texts]))
    assert df.select(encode(F.col("x")).alias("e")).first().e == [1.0, 1.0]
    assert df.limit(1).select(scoring.lexical_logit(F.lit("A b. c"), F.lit("b c d d")).alias("l")).first().l == pytest.approx(2 / 3 * 8 - 4)


def test_edges(spark):
    p = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "c")], "doc_id int, sent_idx int, sent string")
    assert rows(graph.contains_edges(p).select("src", "dst")) == [(1, 0), (1, 1), (2, 0)]
    co = {(r.cid1, r.cid2): (r.pmi, r.cofreq) for r in graph.cooccurrence(spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "b"), (2, "c"), (3, "c")], "doc_id int, cid string")).collect()}
    assert co["a", "b"] == (pytest.approx(math.log(2 * 3 / 4)), 2) and co["a", "c"] == (pytest.approx(math.log(3 / 4)), 1)


def test_event_rates(spark, tmp_path):
    events = spark.createDataFrame([("2026-01-01 00:10:00", "a", 1.0), ("2026-01-01 00:50:00", "a", 3.0), ("2026-01-01 01:10:00", "b", 5.0)], "ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    want = [("a", 2, 2.0), ("b", 1, 5.0)]
    assert rows(ingest.event_rates(events).drop("start")) == want
    events.write.parquet(f"{tmp_path}/in")
    stream = ingest.event_rates(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in"))
    run = stream.writeStream.format("memory").queryName("rates").outputMode("complete").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert rows(spark.table("rates").drop("start")) == want
