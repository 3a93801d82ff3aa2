"""Reciprocal-rank fusion of candidate channels, modes and K policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MODES = {"dense_only": ["dense"], "native_hybrid": ["dense", "sparse"], "two_way_rrf": ["dense", "bm25"], "three_way_rrf": ["dense", "sparse", "bm25"]}
UNRANKED = 10**9


def channel_ranks(scores: DataFrame, channel: str, k: int | Column) -> DataFrame:
    """Long rank table (doc_id, cid, channel, sent_idx, rank) of one channel."""
    order = Window.partitionBy("doc_id", "cid").orderBy(F.desc("score"), "sent_idx")
    ranked = scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("doc_id", "cid", F.lit(channel).alias("channel"), "sent_idx", "rank")


def in_mode(ranks: DataFrame, mode: str) -> DataFrame:
    return ranks.where(F.col("channel").isin(MODES[mode]))


def rrf(ranks: DataFrame, rrf_k: int, final_k: int | Column, ties: tuple[str, ...] = ("dense", "sparse", "bm25"), keys: tuple[str, ...] = ("doc_id", "cid")) -> DataFrame:
    """Fused candidates (keys, sent_idx, score, rank_dense, ..., rank).

    Scores sum 1 / (rrf_k + rank) over channels. The tie order of channels
    decides who is among the first ``final_k``; their final order is by score,
    then sent_idx. One grouping instead of outer joins of the channels.
    """
    by = [F.min(F.when(F.col("channel") == c, F.col("rank"))).alias(f"rank_{c}") for c in ("dense", "sparse", "bm25")]
    fused = ranks.groupBy(*keys, "sent_idx").agg(F.round(F.sum(1 / (F.lit(rrf_k) + F.col("rank"))), 9).alias("score"), *by)
    tie = [F.coalesce(f"rank_{c}", F.lit(UNRANKED)) for c in ties]
    inside = Window.partitionBy(*keys).orderBy(F.desc("score"), *tie, "sent_idx")
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "sent_idx")
    member = fused.withColumn("_m", F.row_number().over(inside)).where(F.col("_m") <= final_k).drop("_m")
    return member.withColumn("rank", F.row_number().over(order))


def effective_k(override: Column, per_topic: Column, default: Column, fusion: Column, retrieve: Column) -> Column:
    """An override counts even as 0; the others count as unset when null or 0."""
    unset = lambda c: F.nullif(c, F.lit(0))
    return F.coalesce(override, unset(per_topic), unset(default), unset(fusion), unset(retrieve), F.lit(50))


def boosted_k(base: Column, boosted: Column) -> Column:
    """A channel's K for a topic: the boost can only raise it."""
    return F.greatest(base, F.coalesce(boosted, base))


def normalised_candidates(raw: Column) -> Column:
    """JSON candidates as pairs, triples or objects: (sent_id, score, meta) structs."""
    items = F.from_json(raw, "array<string>")

    def one(x: Column) -> Column:
        obj = F.from_json(x, "struct<sent_id:string,score:double,meta:string>")
        arr = F.from_json(x, "array<string>")
        is_obj = F.ltrim(x).startswith("{")
        return F.struct(
            F.when(is_obj, obj["sent_id"]).otherwise(F.get(arr, 0)).alias("sent_id"),
            F.when(is_obj, obj["score"]).otherwise(F.get(arr, 1).try_cast("double")).alias("score"),
            F.coalesce(F.when(is_obj, obj["meta"]).otherwise(F.get(arr, 2)), F.lit("{}")).alias("meta"),
        )

    return F.transform(items, one)


def fold_filter(retrieval: DataFrame, doc_ids: DataFrame, k: int, cids: list[str] | None = None, ordinal: str = "ordinal") -> DataFrame:
    """Retrieval rows (doc_id, cid, sent_idx, score, ordinal) of some documents
    and topics, the k best of each; of records that repeat a key the last counts."""
    kept = retrieval.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi")
    if cids:
        kept = kept.where(F.col("cid").isin(cids))
    last = F.max(ordinal).over(Window.partitionBy("doc_id", "cid"))
    kept = kept.withColumn("_last", last).where(F.col(ordinal) == F.col("_last")).drop("_last")
    order = Window.partitionBy("doc_id", "cid").orderBy(F.desc("score"), "sent_idx")
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
