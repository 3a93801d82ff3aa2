"""Mixing sources to target weights by repeating documents.

Tokens are summed per source, a water-filling of the weights gives each source
a target, target / size is its repetition rate, and every document is taken
floor(rate) times plus once more with probability equal to the fraction. The
draw is a hash of (seed, id), so that reruns and retries agree. A source of few
documents can miss its target by chance; ``nearest_seeds`` gives each source the
seed, of TRIES, whose draws come nearest.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.llm import textbuf as tb
from quillspark.scratch import Scratch

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
TRIES = 16


def _sizes(batches):
    for batch in batches:
        data, offsets = tb.buffers(batch.column("text"))
        sizes = []
        for _, _, part, offs in tb.chunks(data, offsets):
            first = tb.words(part, offs)[2]
            sizes += (first[1:] - first[:-1]).tolist()
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(sizes, pa.int64())], ["doc_id", "source", "size"])


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size): the words of every text, whole at any length, 0 for
    null; a row a row, repeats and null ids among them. An empty table gives none."""
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(_sizes, "doc_id long, source string, size long")


def source_targets(spark: SparkSession, sizes: DataFrame, scratch: Scratch, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target, rate) for every source.

    Sources in code point order, null last, take ``weights`` in turn and share
    ``share`` of all sizes; a target stops at ``most`` times its source's size
    and the excess is shared again by weight. Ordinals come from a range
    partitioning, so no task sees all sources; each round of sharing is one
    aggregate that brings one row to the driver. A source without words has
    target and rate 0. An empty table gives no rows.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranged = by_source.withColumn("last", F.col("source").isNull()).repartitionByRange("last", "source").withColumn("part", F.spark_partition_id())
    ranged = scratch.keep(ranged, "sources")
    before, offsets = 0, []
    for row in ranged.groupBy("part").count().orderBy("part").collect():  # one row a partition
        offsets.append((row["part"], before))
        before += row["count"]
    if not offsets:
        return ranged.select("source", "source_size", F.lit(0.0).alias("target"), F.lit(0.0).alias("rate"))
    skip = F.element_at(F.create_map(*[F.lit(x) for pair in offsets for x in pair]), F.col("part"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("last", "source")) - 1 + skip
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (place % len(weights) + 1).cast("int"))
    placed = scratch.keep(ranged.select("source", "source_size", weight.cast("long").alias("weight"), (F.col("source_size") * most).alias("cap")), "weights")

    total, weighing = placed.agg(F.sum("source_size"), F.sum("weight")).first()
    whole = share * total
    rest, level = whole, whole / weighing
    while True:
        over = F.col("cap") < F.lit(level) * F.col("weight")
        row = placed.agg(F.sum(F.when(over, F.col("cap"))).alias("cap"), F.sum(F.when(~over, F.col("weight"))).alias("weight")).first()
        if row.weight is None or (whole - (row.cap or 0), row.weight) == (rest, weighing):
            break
        rest, weighing = whole - (row.cap or 0), row.weight
        level = rest / weighing
    over = F.col("cap") < F.lit(level) * F.col("weight")
    target = F.when(over, F.col("cap").cast("double")).otherwise(F.lit(float(rest)) * F.col("weight") / F.lit(float(weighing)))
    return placed.select("source", "source_size", target.alias("target")).withColumn("rate", F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0))


def draw(id_col: Column, seed: int | Column) -> Column:
    """A number in [0, 1) fixed by the id and the seed."""
    seed = F.lit(seed) if isinstance(seed, int) else seed
    text = F.concat(seed.cast("string"), F.lit("|"), F.coalesce(id_col.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def _copies(id_col: Column, rate: Column, seed: int | Column) -> Column:
    return (F.floor(rate) + (draw(id_col, seed) < rate - F.floor(rate)).cast("int")).cast("int")


def nearest_seeds(sizes: DataFrame, targets: DataFrame, tries: int = TRIES) -> DataFrame:
    """``targets`` with the ``seed`` of each source, from 0 to ``tries`` - 1,
    whose copies take the number of words nearest to its target (ties: the
    smaller seed). One aggregate over (doc_id, source, size)."""
    t = targets.select(F.col("source").alias("of_source"), "target", "rate")
    rows = sizes.join(t, F.col("source").eqNullSafe(F.col("of_source")))
    taken = [F.sum(F.col("size") * _copies(F.col("doc_id"), F.col("rate"), k)).alias(f"t{k}") for k in range(tries)]
    sums = rows.groupBy("of_source").agg(F.first("target").alias("goal"), *taken)
    best = F.array_min(F.array(*[F.struct(F.abs(F.col(f"t{k}") - F.col("goal")).alias("off"), F.lit(k).alias("seed")) for k in range(tries)]))
    picked = sums.select("of_source", best["seed"].alias("seed"))
    return targets.join(picked, F.col("source").eqNullSafe(F.col("of_source")), "left").drop("of_source").withColumn("seed", F.coalesce("seed", F.lit(0)))


def _free(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def with_copies(docs: DataFrame, targets: DataFrame, seed: int = 0, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """``docs`` with source_size, target, rate and ``copies`` (0 or more), in
    place of columns of these names. Targets with a ``seed`` have each its own.

    The join on the source is null-safe; Spark broadcasts the source table
    where its written size allows and splits hot sources elsewhere. Rows that
    repeat an id share its draw, and so do null ids; a source without a target
    has null copies. Of all other columns nothing is assumed.
    """
    docs = docs.drop("source_size", "target", "rate", "copies")
    own, mine = _free(docs, "of_source"), _free(docs, "of_seed")
    t = targets.withColumnRenamed("source", own)
    t = t.withColumnRenamed("seed", mine) if "seed" in t.columns else t.withColumn(mine, F.lit(seed))
    joined = docs.join(t, docs[source_col].eqNullSafe(t[own]), "left").drop(own)
    return joined.withColumn("copies", _copies(F.col(id_col), F.col("rate"), F.col(mine))).drop(mine)


def emit_copies(mixed: DataFrame) -> DataFrame:
    """One row for each copy taken, with the columns of ``mixed``."""
    own = _free(mixed, "copy")
    return mixed.where("copies > 0").withColumn(own, F.explode(F.sequence(F.lit(1), F.col("copies")))).drop(own)
