"""Classification metrics as conditional sums and tie-aware cumulative curves.

Curves first sum the rows of every distinct score, so that the running sums
over scores see one row a score and group (with ``bins``, rounded scores), and
then run over range partitions of all groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators.splits import running_sums


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def counts_at(threshold: Column | float, prob: str = "prob", label: str = "label") -> list[Column]:
    """tp, fp, fn, tn of prob >= threshold."""
    hit = F.col(prob) >= threshold
    y = F.col(label) == 1
    return [F.count_if(hit & y).alias("tp"), F.count_if(hit & ~y).alias("fp"), F.count_if(~hit & y).alias("fn"), F.count_if(~hit & ~y).alias("tn")]


def with_prf(df: DataFrame) -> DataFrame:
    """precision, recall, f1 and accuracy beside tp, fp, fn, tn; 0 for empty denominators."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return df.withColumns({"precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn), "f1": _ratio(2 * tp, 2 * tp + fp + fn), "accuracy": _ratio(tp + tn, tp + fp + fn + tn)})


def prf(rows: DataFrame, by: list[str], threshold: Column | float = 0.5, prob: str = "prob") -> DataFrame:
    return with_prf(rows.groupBy(*by).agg(*counts_at(threshold, prob)))


def prf_sets(rows: DataFrame, sets: list[list[str]], threshold: float = 0.5, prob: str = "prob") -> DataFrame:
    """The same over several groupings in one pass; absent columns are null."""
    names = list(dict.fromkeys(c for s in sets for c in s))
    out = rows.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in names]).agg(F.grouping_id().alias("gid"), *counts_at(threshold, prob))
    return with_prf(out)


def macro_micro(rows: DataFrame, by: str, threshold: float = 0.5, prob: str = "prob") -> DataFrame:
    """One row (macro_f1, micro_f1) over the classes ``by``."""
    per = prf(rows, [by], threshold, prob)
    s = per.agg(F.avg("f1").alias("macro_f1"), F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    return s.select("macro_f1", _ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("micro_f1"))


def curve(rows: DataFrame, by: list[str], prob: str = "prob", bins: int | None = None) -> DataFrame:
    """Points (by, threshold, tp, fp, pos, neg, prev_tp, prev_fp) at distinct scores, descending.

    Running sums go over range partitions of (by, threshold), so no task holds a class.
    """
    score = F.col(prob) if bins is None else F.round(F.col(prob) * bins) / bins
    grouped = rows.select(*by, score.alias("threshold"), "label").groupBy(*by, "threshold").agg(F.sum("label").cast("long").alias("p"), F.sum(1 - F.col("label")).cast("long").alias("n"))
    return points(grouped, by)


def points(grouped: DataFrame, by: list[str]) -> DataFrame:
    """The curve of rows (by, threshold, p, n): positives and negatives of each score."""
    out = running_sums(grouped, by, [F.desc("threshold")], ["p", "n"])
    named = {"run_p": "tp", "run_n": "fp", "all_p": "pos", "all_n": "neg"}
    return out.withColumnsRenamed(named).withColumns({"prev_tp": F.col("tp") - F.col("p"), "prev_fp": F.col("fp") - F.col("n")}).drop("p", "n")


def curve_areas(rows: DataFrame, by: list[str], prob: str = "prob", bins: int | None = None) -> DataFrame:
    """(by, average_precision, auroc, pr_auc); null where a class is missing."""
    c = curve(rows, by, prob, bins)
    prec = F.col("tp") / (F.col("tp") + F.col("fp"))
    before = F.when(F.col("prev_tp") + F.col("prev_fp") > 0, F.col("prev_tp") / (F.col("prev_tp") + F.col("prev_fp"))).otherwise(1.0)
    pos, neg = F.nullif(F.col("pos"), F.lit(0)), F.nullif(F.col("neg"), F.lit(0))
    gain = (F.col("tp") - F.col("prev_tp")) / pos
    a = c.groupBy(*by).agg(
        F.sum(gain * prec).alias("ap"), F.sum((F.col("fp") - F.col("prev_fp")) * (F.col("tp") + F.col("prev_tp")) / 2 / neg / pos).alias("roc"),
        F.sum(gain * (prec + before) / 2).alias("pr"), F.first("pos").alias("pos"), F.first("neg").alias("neg"),
    )
    both = (F.col("pos") > 0) & (F.col("neg") > 0)
    return a.select(*by, *[F.when(both, F.round(x, 9)).alias(n) for x, n in (("ap", "average_precision"), ("roc", "auroc"), ("pr", "pr_auc"))])


def confusion(rows: DataFrame, by: list[str], threshold: float = 0.5, prob: str = "prob") -> DataFrame:
    """(by, label, predicted, n)."""
    return rows.groupBy(*by, "label", (F.col(prob) >= threshold).cast("int").alias("predicted")).agg(F.count("*").alias("n"))


def report(rows: DataFrame, threshold: float = 0.5, prob: str = "prob") -> DataFrame:
    """(class, precision, recall, f1, support) of 0, 1, macro and weighted."""
    one = rows.select("label", (F.col(prob) >= threshold).cast("int").alias("hat")).withColumn("class", F.explode(F.array(F.lit(0), F.lit(1))))
    is_y, is_hat = F.col("label") == F.col("class"), F.col("hat") == F.col("class")
    per = one.groupBy("class").agg(F.count_if(is_y & is_hat).alias("tp"), F.count_if(~is_y & is_hat).alias("fp"), F.count_if(is_y & ~is_hat).alias("fn"), F.count_if(~is_y & ~is_hat).alias("tn"), F.count_if(is_y).alias("support"))
    per = with_prf(per).select(F.col("class").cast("string").alias("class"), "precision", "recall", "f1", "support")
    w = lambda c: (F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c)
    macro = per.agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "f1")], F.sum("support").alias("support")).select(F.lit("macro").alias("class"), "precision", "recall", "f1", "support")
    weighted = per.agg(w("precision"), w("recall"), w("f1"), F.sum("support").alias("support")).select(F.lit("weighted").alias("class"), "precision", "recall", "f1", "support")
    return per.unionByName(macro).unionByName(weighted)


def focal_loss(prob: Column, label: Column, gamma: float = 2.0, alpha: float = 0.25) -> Column:
    p = F.least(F.greatest(prob, F.lit(1e-8)), F.lit(1 - 1e-8))
    pt = F.when(label == 1, p).otherwise(1 - p)
    return -F.when(label == 1, alpha).otherwise(1 - alpha) * F.pow(1 - pt, F.lit(gamma)) * F.log(pt)


def bce(prob: Column, label: Column) -> Column:
    p = F.least(F.greatest(prob, F.lit(1e-8)), F.lit(1 - 1e-8))
    return -(label * F.log(p) + (1 - label) * F.log(1 - p))
