"""Acceptance gates, choice of K, K sensitivity and trial selection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Name, metric, threshold, comparison.
GATES = [
    ("retrieval_recall@20_overall", "recall@20", 0.95, "gte"),
    ("retrieval_recall@20_per_criterion", "recall@20_min", 0.90, "gte"),
    ("evidence_auprc", "auprc", 0.75, "gte"),
    ("evidence_f1", "f1", 0.70, "gte"),
    ("evidence_precision@5", "precision@5", 0.85, "gte"),
    ("evidence_coverage@5", "coverage@5", 0.80, "gte"),
    ("evidence_ece", "ece", 0.10, "lte"),
    ("calibration_improvement", "improvement_pct", 20.0, "gte"),
]
# Fixed value: the improvement gate is asked only above this first calibration error.
INITIAL_ECE = 0.05


def gate_table(spark, gates=GATES) -> DataFrame:
    return spark.createDataFrame(gates, "name string, metric string, threshold double, comparison string")


def check_gates(metrics: DataFrame, gates: DataFrame) -> DataFrame:
    """(name, value, threshold, passed) of every gate over (metric, value).

    A missing metric counts as 0. The gate on improvement_pct is left out unless
    the metric initial_ece exceeds INITIAL_ECE.
    """
    m = metrics.select("metric", "value")
    asked = gates.withColumn("first", F.when(F.col("metric") == "improvement_pct", F.lit("initial_ece")))
    asked = asked.join(m.select(F.col("metric").alias("first"), F.col("value").alias("at_first")), "first", "left")
    asked = asked.where(F.col("first").isNull() | (F.col("at_first") > INITIAL_ECE))
    value = F.coalesce("value", F.lit(0.0))
    passed = F.when(F.col("comparison") == "gte", value >= F.col("threshold")).otherwise(value <= F.col("threshold"))
    return asked.join(m, "metric", "left").select("name", value.alias("value"), "threshold", passed.alias("passed"))


def leakage_gates(leaks: DataFrame) -> DataFrame:
    """The same columns for (fold, leaked): a fold passes without leaked ids."""
    return leaks.select(F.concat(F.lit("data_leakage_fold"), F.col("fold").cast("string")).alias("name"), F.col("leaked").cast("double").alias("value"), F.lit(0.0).alias("threshold"), (F.col("leaked") == 0).alias("passed"))


def verdict(results: DataFrame) -> DataFrame:
    return results.agg(F.count("*").alias("n_gates"), F.count_if("passed").alias("n_passed"), F.bool_and("passed").alias("accepted"))


def sweep_to_gates(sweep: DataFrame, k: int) -> DataFrame:
    """(metric, value): a sweep's figures at k under the gates' names."""
    at = sweep.where(F.col("k") == k)
    every = at.where("scope = 'overall'").select(F.lit(f"recall@{k}").alias("metric"), F.col("recall_at_k").alias("value"))
    least = at.where("scope = 'topic'").agg(F.min("recall_at_k").alias("value")).select(F.lit(f"recall@{k}_min").alias("metric"), "value")
    return every.unionByName(least)


def select_k(sweep: DataFrame, recall: float, coverage: float, prefer_min: bool = True, sensitive: list[str] | None = None, sensitive_cap: int | None = None) -> DataFrame:
    """(scope, cid, k, passed, needs_help): the smallest K that meets the gates,
    else the best recall at the lowest K; with ``prefer_min`` false a topic whose
    overall K passes keeps it. Sensitive topics are capped."""
    ok = (F.col("recall_at_k") >= recall) & (F.col("coverage_at_k") >= coverage)
    keys = ["scope", "cid"]
    small = sweep.where(ok).groupBy(*keys).agg(F.min("k").alias("k_ok"))
    best = sweep.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("recall_at_k"), "k"))).where("_i = 1").select(*keys, F.col("k").alias("k_best"))
    same = best["scope"].eqNullSafe(small["scope"]) & best["cid"].eqNullSafe(small["cid"])
    out = best.join(small, same, "left").select(best["scope"], best["cid"], F.coalesce("k_ok", "k_best").alias("k"), F.col("k_ok").isNotNull().alias("passed"))
    if not prefer_min:
        default = out.where("scope = 'overall'").select(F.col("k").alias("k_all"), F.lit(1).alias("_j"))
        at = sweep.where(ok & (F.col("scope") == "topic")).select("cid", F.col("k").alias("k_all"), F.lit(True).alias("ok_all"))
        out = out.withColumn("_j", F.lit(1)).join(F.broadcast(default), "_j").drop("_j").join(at, ["cid", "k_all"], "left")
        out = out.withColumn("k", F.when(F.col("ok_all"), F.col("k_all")).otherwise(F.col("k"))).select("scope", "cid", "k", "passed")
    if sensitive and sensitive_cap:
        out = out.withColumn("k", F.when(F.col("cid").cast("string").isin(sensitive), F.least("k", F.lit(sensitive_cap))).otherwise(F.col("k")))
    return out.withColumn("needs_help", ~F.col("passed"))


def smallest_sufficient_k(scores: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """(k, best): the smallest k whose f1 is within ``tolerance`` of the best of (k, f1)."""
    top = scores.agg(F.max("f1").alias("best")).withColumn("_j", F.lit(1))
    return scores.withColumn("_j", F.lit(1)).join(F.broadcast(top), "_j").where(F.col("best") - F.col("f1") <= tolerance).groupBy("best").agg(F.min("k").alias("k")).select("k", "best")


def best_trial(trials: DataFrame, floor: float = 0.8) -> DataFrame:
    """The trial with the best objective; one under the precision floor counts as 0."""
    return trials.withColumn("objective", F.when(F.col("precision_at_5") < floor, 0.0).otherwise(F.col("macro_f1"))).orderBy(F.desc("objective"), "trial").limit(1)
