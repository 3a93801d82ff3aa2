"""Graph records on disk, read back document by document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shard_of(doc_id: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(shards)).cast("int")


def write_graph_records(records: DataFrame, path: str, shards: int = 64, k: int | None = None) -> None:
    """Records below ``path``/graphs in folders by a hash of their document, and
    one row of figures in ``path``/metadata."""
    placed = records.withColumn("shard", shard_of(F.col("doc_id"), shards))
    # Each folder is written by one task, which has whole documents only.
    placed.repartition("shard").sortWithinPartitions("shard", "doc_id").write.mode("overwrite").partitionBy("shard").parquet(f"{path}/graphs")
    kept = records.sparkSession.read.schema(placed.schema).parquet(f"{path}/graphs")
    edges = [F.sum(F.size(F.col(r)["src"])).alias(f"n_{r}") for r in ("next", "contains", "supports", "matches")]
    figures = kept.agg(F.count("*").alias("n_graphs"), F.sum("n_passages").alias("n_passages"), F.max("n_topics").alias("n_topics"), *edges)
    figures.select("*", F.lit(shards).alias("shards"), F.lit(k).cast("int").alias("top_k")).write.mode("overwrite").parquet(f"{path}/metadata")


def graph_metadata(spark: SparkSession, path: str) -> dict:
    """The figures of a folder of records."""
    return spark.read.parquet(f"{path}/metadata").first().asDict()


def read_graph_records(spark: SparkSession, path: str, *doc_ids) -> DataFrame:
    """All records, or those of some documents: then only their folders are read,
    and of these only row groups whose range of ids can hold them."""
    records = spark.read.parquet(f"{path}/graphs")
    if doc_ids:
        shards, kind = graph_metadata(spark, path)["shards"], records.schema["doc_id"].dataType
        ids = [F.lit(i).cast(kind) for i in doc_ids]
        records = records.where(F.col("shard").isin(*[shard_of(i, shards) for i in ids]) & F.col("doc_id").isin(*ids))
    return records.drop("shard")


def graph_of(spark: SparkSession, path: str, doc_id):
    """The record of one document as a Row; none is an error."""
    found = read_graph_records(spark, path, doc_id).first()
    if found is None:
        raise IndexError(f"no graph of {doc_id} in {path}")
    return found
