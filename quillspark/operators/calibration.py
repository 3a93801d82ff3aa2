"""Calibration error, reliability tables, temperatures and thresholds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import let
from quillspark.operators.classification import bce, curve


def bin_of(prob: Column, bins: int) -> Column:
    return F.least(F.greatest(F.floor(prob * bins), F.lit(0)), F.lit(bins - 1)).cast("int")


def reliability(rows: DataFrame, by: list[str], bins: int = 10, prob: str = "prob", label: str = "label") -> DataFrame:
    """(by, bin, n, acc, conf) with a row of zeros for every empty bin."""
    full = rows.groupBy(*by, bin_of(F.col(prob), bins).alias("bin")).agg(F.count("*").alias("n"), F.avg(F.col(label).cast("double")).alias("acc"), F.avg(prob).alias("conf"))
    grid = rows.select(*by).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))) if by else rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return grid.join(full, [*by, "bin"], "left").select(*by, "bin", zero("n"), F.round(F.coalesce("acc", F.lit(0.0)), 9).alias("acc"), F.round(F.coalesce("conf", F.lit(0.0)), 9).alias("conf"))


def ece(rows: DataFrame, by: list[str], bins: int = 10, prob: str = "prob", label: str = "label") -> DataFrame:
    """(by, ece). With prob and label exchanged it gives the swapped variant."""
    per = rows.groupBy(*by, bin_of(F.col(prob), bins).alias("bin")).agg(F.count("*").alias("n"), F.avg(F.col(label).cast("double")).alias("acc"), F.avg(F.col(prob).cast("double")).alias("conf"))
    return per.groupBy(*by).agg(F.round(F.sum(F.col("n") * F.abs(F.col("acc") - F.col("conf"))) / F.sum("n"), 9).alias("ece"))


def nll(rows: DataFrame, by: list[str], temperature: float = 1.0, logit: str = "logit") -> DataFrame:
    p = 1 / (1 + F.exp(-F.col(logit) / temperature))
    return rows.groupBy(*by).agg(F.round(F.avg(bce(p, F.col("label"))), 9).alias("nll"))


def improvement(before: Column, after: Column) -> Column:
    """Relative improvement in percent, 0 without a positive start."""
    return F.when(before > 0, (before - after) / before * 100).otherwise(0.0)


def fit_temperature(logit: np.ndarray, label: np.ndarray, steps: int = 200, rate: float = 0.01) -> float:
    """Adam on the mean negative log-likelihood from T = 1, held above 1e-3."""
    t, m, v = 1.0, 0.0, 0.0
    for i in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(logit / t, -500, 500)))
        g = float(((p - label) * -logit).mean() / (t * t))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        t = max(1e-3, t - rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-8))
    return t


def temperatures(rows: DataFrame, by: str, min_samples: int = 10, digits: int = 4, logit: str = "logit", steps: int = 200, rate: float = 0.01) -> DataFrame:
    """(by, temperature): one fit a group, the overall fit for smaller ones.

    The steps of Adam on the mean negative log-likelihood, from T = 1 and held above
    1e-3, are a fold over the sums of a group's logits, in built-in functions.
    Logits are rounded to ``digits`` and counted first: a fit then sees at most the
    distinct values, however many rows a group has. The overall fit has a null
    ``by``. A null logit or label takes no part.
    """
    known = rows.where(F.col(logit).isNotNull() & F.col("label").isNotNull())
    cells = known.groupBy(by, F.round(logit, digits).alias("x")).agg(F.sum("label").cast("double").alias("pos"), F.count("*").cast("double").alias("n"))
    every = cells.groupBy("x").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n")).select(F.lit(None).cast(rows.schema[by].dataType).alias(by), "x", "pos", "n")
    packed = cells.where(F.col(by).isNotNull()).unionByName(every).groupBy(by).agg(F.sort_array(F.collect_list(F.struct("x", "pos", "n"))).alias("c"), F.sum("n").alias("rows"))

    def slope(t: Column) -> Column:
        miss = lambda e: e["n"] / (1 + F.exp(-F.greatest(F.least(e["x"] / t, F.lit(500.0)), F.lit(-500.0)))) - e["pos"]
        return F.aggregate("c", F.lit(0.0), lambda a, e: a - miss(e) * e["x"]) / F.col("rows") / (t * t)

    def moved(s: Column, i: Column, m: Column, v: Column) -> Column:
        by_step = rate * (m / (1 - F.pow(F.lit(0.9), i))) / (F.sqrt(v / (1 - F.pow(F.lit(0.999), i))) + 1e-8)
        return F.struct(F.greatest(F.lit(1e-3), s["t"] - by_step).alias("t"), m.alias("m"), v.alias("v"))

    def step(s: Column, i: Column) -> Column:
        return let(slope(s["t"]), lambda g: moved(s, i, 0.9 * s["m"] + 0.1 * g, 0.999 * s["v"] + 0.001 * g * g))

    begin = F.struct(F.lit(1.0).alias("t"), F.lit(0.0).alias("m"), F.lit(0.0).alias("v"))
    fitted = packed.where("rows > 0").select(by, "rows", F.aggregate(F.sequence(F.lit(1), F.lit(steps)), begin, step)["t"].alias("t"))
    whole = fitted.where(F.col(by).isNull()).select(F.col("t").alias("_t"))  # one row
    return fitted.join(F.broadcast(whole)).select(by, F.when(F.col("rows") >= min_samples, F.col("t")).otherwise(F.col("_t")).alias("temperature"))


VARIANTS = ("optimizer", "crossval", "endpoint", "report")


def best_thresholds(rows: DataFrame, by: list[str], variant: str = "optimizer", min_samples: int = 10, prob: str = "prob") -> DataFrame:
    """(by, threshold, f1): the threshold of the best F1, the lowest on ties.

    optimizer: 0.5 without positives or with fewer than ``min_samples`` rows.
    crossval: 1.0 for a group without positives, 0.0 for one without negatives.
    endpoint: as crossval's candidates, but 1.0 if no threshold beats F1 0.
    report: F1 with 1e-10 in the denominator, 0.5 if none beats 0.
    """
    if variant not in VARIANTS:
        raise ValueError(f"variant must be one of {VARIANTS}")
    c = curve(rows, by, prob)
    p, r = F.col("tp") / (F.col("tp") + F.col("fp")), F.when(F.col("pos") > 0, F.col("tp") / F.col("pos")).otherwise(0.0)
    f1 = 2 * p * r / (p + r + 1e-10) if variant == "report" else F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    c = c.withColumn("f1", F.round(f1, 12))
    # A partial maximum a task instead of a sort of each class.
    best = c.groupBy(*by).agg(F.max_by(F.struct("threshold", "f1", "pos", "neg"), F.struct("f1", -F.col("threshold"))).alias("_b")).select(*by, "_b.*")
    t, rows_n = F.col("threshold"), F.col("pos") + F.col("neg")
    t = {
        "optimizer": F.when((F.col("pos") == 0) | (rows_n < min_samples), 0.5).otherwise(t),
        "crossval": F.when(F.col("pos") == 0, 1.0).when(F.col("neg") == 0, 0.0).otherwise(t),
        "endpoint": F.when(F.col("f1") <= 0, 1.0).otherwise(t),
        "report": F.when(F.col("f1") <= 0, 0.5).otherwise(t),
    }[variant]
    return best.select(*by, t.alias("threshold"), F.round("f1", 9).alias("f1"))


def apply_thresholds(rows: DataFrame, thresholds: DataFrame, by: str = "cid", prob: str = "prob", default: float = 0.5) -> DataFrame:
    """``rows`` with ``predicted``; unknown classes take ``default``, a null class is an error."""
    t = thresholds.select(by, F.col("threshold").alias("_t"))
    key = F.coalesce(F.col(by), F.raise_error(F.lit(f"{by} is missing")).cast(rows.schema[by].dataType))
    return rows.withColumn(by, key).join(t, by, "left").withColumn("predicted", (F.col(prob) >= F.coalesce("_t", F.lit(default))).cast("int")).drop("_t")


class ThresholdOptimizer:
    """fit, predict, save and load of per-class thresholds."""

    def __init__(self, by: str = "cid", variant: str = "optimizer", min_samples: int = 10, default: float = 0.5):
        self.by, self.variant, self.min_samples, self.default = by, variant, min_samples, default
        self.table: DataFrame | None = None

    def fit(self, rows: DataFrame, prob: str = "prob") -> ThresholdOptimizer:
        self.table = best_thresholds(rows, [self.by], self.variant, self.min_samples, prob).select(self.by, "threshold")
        return self

    def predict(self, rows: DataFrame, prob: str = "prob") -> DataFrame:
        if self.table is None:
            raise ValueError("fit or load first")
        return apply_thresholds(rows, self.table, self.by, prob, self.default)

    def save(self, path: str) -> None:
        if self.table is None:
            raise ValueError("fit or load first")
        self.table.write.mode("overwrite").parquet(path)

    def load(self, spark, path: str) -> ThresholdOptimizer:
        self.table = spark.read.parquet(path)
        return self
