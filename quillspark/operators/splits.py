"""Folds, splits and leakage checks by document. Pseudo-random orders are md5 orders."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.scratch import Scratch


def md5_order(seed: int | str, *cols: Column | str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols]))


def _ranged(df: DataFrame, order: list[Column | str], parts: int | None) -> DataFrame:
    """``df`` in numbered range partitions (_p) of ``order``, as many as the session
    shuffles to. Written once: a range partitioning computed anew could place rows
    otherwise."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return Scratch(df.sparkSession, "ranges").keep(df.repartitionByRange(parts, *order).withColumn("_p", F.spark_partition_id()))


def _before(totals: list[tuple[int, int]]) -> Column:
    """What lies before the partition _p, from (partition, total) in their order."""
    entries, total = [], 0
    for part, n in totals:
        entries += [F.lit(part), F.lit(total)]
        total += n
    return F.element_at(F.create_map(*entries), F.col("_p")).cast("long") if entries else F.lit(0).cast("long")


def positions(df: DataFrame, *order: Column | str, parts: int | None = None) -> DataFrame:
    """``df`` with ``pos`` (from 0) in a total order, without one task seeing all
    rows: range partitions are numbered and their sizes added up."""
    ranged = _ranged(df, list(order), parts)
    sizes = ranged.groupBy("_p").count().orderBy("_p").collect()  # a row a partition
    skip = _before([(r["_p"], r["count"]) for r in sizes])
    return ranged.withColumn("pos", F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1 + skip).drop("_p")


def running_sums(df: DataFrame, by: list[str], order: list[Column | str], values: list[str], parts: int | None = None) -> DataFrame:
    """``df`` with run_<v> and all_<v> for each v of ``values``, columns of integers
    of 0 or more: the sum of v over the rows of the group ``by`` up to this one in
    ``order``, itself included, and over the whole group. Null keys are groups.

    No task holds a group: all rows stand in one order of (by, order) in range
    partitions. A first pass adds each partition up, a second sums within it and
    adds what lies before; a group's sums are those less what lies before the
    group. Rows with equal keys and order come in any order.
    """
    keys = [*[F.col(c) for c in by], *order]
    ranged = _ranged(df, keys, parts)
    totals = ranged.groupBy("_p").agg(*[F.sum(v).alias(v) for v in values]).orderBy("_p").collect()  # a row a partition
    within = Window.partitionBy("_p").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    runs = {f"run_{v}": F.sum(v).over(within) + _before([(r["_p"], r[v] or 0) for r in totals]) for v in values}
    if not by:
        return ranged.withColumns(runs | {f"all_{v}": F.lit(sum(r[v] or 0 for r in totals)).cast("long") for v in values}).drop("_p")
    summed = Scratch(df.sparkSession, "sums").keep(ranged.withColumns(runs).drop("_p"), "runs")
    groups = summed.groupBy(*[F.col(c).alias(f"_by_{c}") for c in by]).agg(*[F.min(F.col(f"run_{v}") - F.col(v)).alias(f"_first_{v}") for v in values], *[F.sum(v).alias(f"all_{v}") for v in values])
    same = functools.reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by])
    out = summed.join(groups, same).withColumns({f"run_{v}": F.col(f"run_{v}") - F.col(f"_first_{v}") for v in values})
    return out.select(*df.columns, *[f"run_{v}" for v in values], *[f"all_{v}" for v in values])


def positions_within(df: DataFrame, by: str, *order: Column | str) -> DataFrame:
    """``df`` with ``pos`` (from 0) and ``size`` of its group ``by``, in that order,
    without one task a group: places in the order of all rows less the group's first."""
    whole = positions(df, by, *order)
    first = whole.groupBy(by).agg(F.min("pos").alias("_first"), F.count("*").alias("size")).withColumnRenamed(by, "_by")
    return whole.join(first, F.col(by).eqNullSafe(F.col("_by"))).withColumn("pos", F.col("pos") - F.col("_first")).drop("_by", "_first")


def ratio_split(docs: DataFrame, train: float, dev: float, seed: int = 0, id_col: str = "doc_id") -> DataFrame:
    """(id, split): the first floor(n * train) of a hashed order, then floor(n * dev), then the rest."""
    ids = docs.select(id_col).distinct().withColumn("_o", md5_order(seed, id_col))
    n = ids.count()
    a = int(n * train)
    b = a + int(n * dev)
    placed = positions(ids, "_o", id_col)
    return placed.select(id_col, F.when(F.col("pos") < a, "train").when(F.col("pos") < b, "dev").otherwise("test").alias("split"))


def round_robin_folds(counts: DataFrame, n: int, id_col: str = "doc_id", by: str = "n_pos") -> DataFrame:
    """(id, fold): documents by positives, then id, dealt in turn."""
    return positions(counts, by, id_col).select(id_col, (F.col("pos") % n).cast("int").alias("fold"))


def stratified_folds(patterns: DataFrame, n: int, seed: int = 0, id_col: str = "doc_id", by: str = "pattern") -> DataFrame:
    """(id, pattern, fold): dealt in turn within each label pattern, in a hashed order."""
    placed = positions_within(patterns.withColumn("_o", md5_order(seed, id_col)), by, "_o", id_col)
    return placed.select(id_col, by, (F.col("pos") % n).cast("int").alias("fold"))


def label_patterns(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return labels.groupBy(id_col).agg(F.array_join(F.array_sort(F.collect_list(F.col("label").cast("string"))), "").alias("pattern"))


def dev_tail(folds: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(fold, id, part): of each fold's training ids the last max(1, n // 10) are dev."""
    n_folds = folds.select("fold").distinct().withColumnRenamed("fold", "held")
    train = folds.join(n_folds, F.col("fold") != F.col("held")).select(F.col("held").alias("fold"), id_col)
    placed = positions_within(train, "fold", F.desc(id_col))
    return placed.select("fold", id_col, F.when(F.col("pos") < F.greatest(F.lit(1), F.floor(F.col("size") / 10)), "dev").otherwise("train").alias("part"))


def leakage(train: DataFrame, test: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(fold, leaked): ids on both sides of a fold."""
    both = train.select("fold", id_col).intersect(test.select("fold", id_col))
    return test.select("fold").distinct().join(both.groupBy("fold").agg(F.count("*").alias("leaked")), "fold", "left").select("fold", F.coalesce("leaked", F.lit(0)).alias("leaked"))
