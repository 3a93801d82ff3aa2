"""Runs of named stages that write tables, and skip what hasn't changed.

A stage names the stages and files it reads; its table and a fingerprint are
written below the run's folder. The fingerprint is a hash of the stage's name,
version and parameters, of the files it reads (path, length, time of change) and
of the fingerprints of the stages before it. A stage whose fingerprint is on
disk is read back, not run; only its one-row fingerprint is opened for that.
A fingerprint is written after its table, so a run that was cut off is resumed.

``evidence_run`` is the whole way from raw files to gates.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import assembly, calibration, gates, groundtruth, ranking, retrieval, scoring, splits
from quillspark.sources import indexes, io


@dataclass(frozen=True)
class Stage:
    """``run(spark, inputs)`` gives the stage's table from those of the stages in
    ``after`` and the paths in ``files``, by name. ``version`` changes with the code."""

    name: str
    run: Callable[[SparkSession, Mapping], DataFrame]
    after: Sequence[str] = ()
    files: Mapping[str, str] = field(default_factory=dict)
    params: Mapping[str, object] = field(default_factory=dict)
    version: int = 1


def _listing(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(path, length, time) of a file, or of all below a folder."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    files, found = at.getFileSystem(conf).listFiles(at, True), []
    while files.hasNext():
        one = files.next()
        found.append((one.getPath().toString(), one.getLen(), one.getModificationTime()))
    return sorted(found)


def _stored(spark: SparkSession, path: str) -> str | None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(f"{path}/fingerprint/_SUCCESS")
    return spark.read.parquet(f"{path}/fingerprint").first().fingerprint if at.getFileSystem(conf).exists(at) else None


def run_stages(spark: SparkSession, stages: Sequence[Stage], folder: str) -> tuple[dict[str, DataFrame], list[str]]:
    """The tables of all stages, by name, and the names of those that ran. A name
    that comes twice, or a stage before what it reads, is an error."""
    tables: dict[str, DataFrame] = {}
    prints: dict[str, str] = {}
    ran = []
    for stage in stages:
        if stage.name in tables or any(name not in tables for name in stage.after):
            raise ValueError(f"stage {stage.name} is out of order")
        known = [stage.name, stage.version, dict(stage.params), {k: _listing(spark, p) for k, p in stage.files.items()}, [prints[n] for n in stage.after]]
        prints[stage.name] = hashlib.sha256(json.dumps(known, sort_keys=True, default=str).encode()).hexdigest()
        path = f"{folder}/{stage.name}"
        if _stored(spark, path) != prints[stage.name]:
            # The old mark goes first, so that a table half written is never taken for whole.
            spark.range(1).select(F.lit("").alias("fingerprint")).write.mode("overwrite").parquet(f"{path}/fingerprint")
            out = stage.run(spark, {n: tables[n] for n in stage.after} | dict(stage.files))
            out.write.mode("overwrite").parquet(f"{path}/table")
            spark.range(1).select(F.lit(prints[stage.name]).alias("fingerprint")).write.mode("overwrite").parquet(f"{path}/fingerprint")
            ran.append(stage.name)
        tables[stage.name] = spark.read.parquet(f"{path}/table")
    return tables, ran


# --- from raw files to gates --------------------------------------------------


def _load(spark, inputs):
    """Passages with their documents, numbered in the order of their ids."""
    data = io.load_raw_dataset(spark, inputs["raw"])
    rows = data.sentences.join(data.posts.select("post_id"), "post_id", "left_semi")
    placed = splits.positions_within(rows.withColumn("_key", F.col("post_id")), "_key", "sent_id", "text").drop("_key", "size")
    return placed.select(F.col("post_id").alias("doc_id"), "sent_id", F.col("pos").cast("int").alias("sent_idx"), F.col("text").alias("sent"))


def _topics(spark, inputs):
    return io.load_raw_dataset(spark, inputs["raw"]).criteria.select("cid", F.col("desc").alias("text"), "is_core")


def _gold(spark, inputs):
    labels = io.load_raw_dataset(spark, inputs["raw"]).labels_sc.where("label = 1").select(F.col("post_id").alias("doc_id"), "sent_id", "cid")
    return labels.join(inputs["passages"].select("doc_id", "sent_id", "sent_idx"), ["doc_id", "sent_id"]).select("doc_id", "cid", "sent_idx").distinct()


def _folds(spark, inputs):
    """(doc_id, fold) by round robin over the number of positives."""
    docs = inputs["passages"].select("doc_id").distinct()
    counts = docs.join(inputs["gold"].groupBy("doc_id").agg(F.count("*").alias("n_pos")), "doc_id", "left").withColumn("n_pos", F.coalesce("n_pos", F.lit(0)))
    return splits.round_robin_folds(counts, 2)


def _retrieve(k: int):
    def run(spark, inputs):
        post = retrieval.counted_terms(retrieval.passage_terms(inputs["passages"].select("doc_id", "sent_idx", "sent")))
        frequencies = post.where("term IS NOT NULL").groupBy("term").agg(F.count("*").alias("df"))
        weights = retrieval.term_weights(inputs["topics"], frequencies, retrieval.totals(post))
        found = retrieval.top_k(retrieval.bm25_scores(post.where("term IS NOT NULL"), weights), k)
        return assembly.whole_document_candidates(found, inputs["passages"], inputs["topics"]).where(F.col("rank") <= k)

    return run


def _attach(spark, inputs):
    return assembly.candidate_rows(inputs["candidates"], inputs["passages"], inputs["topics"], inputs["gold"], 1 << 30)


def _score(spark, inputs):
    """The default scorer's logit; a row goes with its document's fold."""
    rows = inputs["attached"].join(inputs["folds"], "doc_id")
    logit = F.round(scoring.lexical_logit(F.col("sent"), F.col("topic")), 6)
    return rows.select("doc_id", "cid", "sent_idx", "rank", "label", "fold", logit.alias("logit")).withColumn("prob", F.round(1 / (1 + F.exp(-F.col("logit"))), 9))


def _calibrate(spark, inputs):
    """One temperature from all folds' rows; prob_cal of every row."""
    rows = inputs["scores"]
    whole = calibration.temperatures(rows.withColumn("every", F.lit("all")), "every").where("every = 'all'").select("temperature")
    return rows.join(whole).withColumn("prob_cal", F.round(1 / (1 + F.exp(-F.col("logit") / F.greatest("temperature", F.lit(1e-4)))), 9))


def _evaluate(k: int):
    def run(spark, inputs):
        rows = inputs["calibrated"]
        bundle = assembly.evidence_bundle(rows).where("scope = 'overall'").first()  # one row
        sweep = gates.sweep_to_gates(ranking.sweep(inputs["candidates"].select("doc_id", "cid", "sent_idx", "score", "rank"), inputs["gold"], [k]), k)
        best = ranking.global_precision(rows, 5, "prob_cal", ["doc_id", "cid", "sent_idx"])
        gain = 0.0 if not bundle.ece_before else (bundle.ece_before - bundle.ece_after) / bundle.ece_before * 100
        named = {"auprc": bundle.auprc_cal, "f1": bundle.f1, "ece": bundle.ece_after, "initial_ece": bundle.ece_before, "improvement_pct": gain}
        found = spark.createDataFrame([(m, None if v is None else float(v)) for m, v in named.items()], "metric string, value double")
        out = sweep.unionByName(found)
        for metric, column in (("precision@5", "precision"), ("coverage@5", "coverage")):
            out = out.unionByName(best.select(F.lit(metric).alias("metric"), F.col(column).cast("double").alias("value")))
        return out

    return run


def _gate(spark, inputs):
    folds = inputs["folds"]
    others = folds.select(F.col("fold").alias("held")).distinct()
    train = folds.join(others, F.col("fold") != F.col("held")).select(F.col("held").alias("fold"), "doc_id")
    return gates.check_gates(inputs["metrics"], gates.gate_table(spark)).unionByName(gates.leakage_gates(splits.leakage(train, folds)))


def evidence_stages(raw: str, k: int = 20) -> list[Stage]:
    """The way from the raw files in ``raw`` to gates, K candidates a pair."""
    files = {"raw": raw}
    return [
        Stage("passages", _load, files=files),
        Stage("topics", _topics, files=files),
        Stage("gold", _gold, ["passages"], files),
        Stage("folds", _folds, ["passages", "gold"]),
        Stage("candidates", _retrieve(k), ["passages", "topics"], params={"k": k}),
        Stage("attached", _attach, ["candidates", "passages", "topics", "gold"]),
        Stage("scores", _score, ["attached", "folds"]),
        Stage("calibrated", _calibrate, ["scores"]),
        Stage("metrics", _evaluate(k), ["calibrated", "candidates", "gold"], params={"k": k}),
        Stage("gates", _gate, ["metrics", "folds"]),
    ]


def evidence_run(spark: SparkSession, raw: str, folder: str, k: int = 20) -> tuple[dict[str, DataFrame], list[str]]:
    """The tables of all stages and the names of those that ran."""
    return run_stages(spark, evidence_stages(raw, k), folder)
