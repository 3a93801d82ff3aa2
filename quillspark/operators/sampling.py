"""Negative sampling with quotas; membership by hashed order, so reruns agree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.operators.splits import md5_order, positions, positions_within, running_sums
from quillspark.scratch import Scratch

KEYS = ["doc_id", "cid"]


def quotas(positives: DataFrame, per_pos: int = 6, hard: float = 0.8, random: float = 0.1, cross: float = 0.1, cap: float = 0.2) -> DataFrame:
    """(doc_id, cid, n_pos, n_neg, n_hard, n_random, n_cross); what the cap
    takes from cross goes to random."""
    n = F.col("n_neg")
    want, most = F.floor(n * cross), F.floor(n * cap)
    out = positives.groupBy(*KEYS).agg(F.count("*").alias("n_pos")).withColumn("n_neg", F.col("n_pos") * per_pos)
    return out.withColumns({"n_hard": F.floor(n * hard), "n_cross": F.least(want, most), "n_random": F.floor(n * random) + want - F.least(want, most)})


def take(pool: DataFrame, limits: DataFrame, limit: str, source: str, seed: int | str, item: str = "sent_idx") -> DataFrame:
    """The first ``limit`` rows of each key's pool in hashed order."""
    order = Window.partitionBy(*KEYS).orderBy(md5_order(seed, *KEYS, *([item] if item in pool.columns else [])), *pool.columns)
    return pool.join(limits.select(*KEYS, limit), KEYS).withColumn("_i", F.row_number().over(order)).where(F.col("_i") <= F.col(limit)).select(*pool.columns, F.lit(source).alias("source"))


def hard_pool(candidates: DataFrame, positives: DataFrame, k: int = 100) -> DataFrame:
    """Candidates among the first k that are no positives."""
    return candidates.where(F.col("rank") <= k).select(*KEYS, "sent_idx").join(positives, [*KEYS, "sent_idx"], "left_anti")


def random_pool(passages: DataFrame, positives: DataFrame) -> DataFrame:
    """All other passages of the document, for keys with a positive."""
    return passages.select("doc_id", "sent_idx").join(positives.select(*KEYS).distinct(), "doc_id").select(*KEYS, "sent_idx").join(positives, [*KEYS, "sent_idx"], "left_anti")


def cross_pool(passages: DataFrame, keys: DataFrame, negatives: DataFrame) -> DataFrame:
    """(doc_id, cid, other_id, sent_idx): passages of other documents whose label for the topic is 0."""
    other = negatives.select(F.col("doc_id").alias("other_id"), "cid").distinct()
    pairs = keys.select(*KEYS).distinct().join(other, "cid").where("doc_id <> other_id")
    return pairs.join(passages.select(F.col("doc_id").alias("other_id"), "sent_idx"), "other_id").select(*KEYS, "other_id", "sent_idx")


def cross_limits(limits: DataFrame, negatives: DataFrame, seed: int | str = 0) -> DataFrame:
    """(doc_id, cid, other_id): for each key, n_cross other documents with label
    0, found by stepping from the key's hashed place through the topic's ring of
    such documents. No pool of pairs is made."""
    ring = negatives.select(F.col("doc_id").alias("other_id"), "cid").distinct()
    ring = positions_within(ring.withColumn("_o", md5_order(seed, "other_id")), "cid", "_o", "other_id").select("other_id", "cid", "size", F.col("pos").alias("at"))
    size = ring.groupBy("cid").agg(F.max("size").alias("size"))
    start = F.pmod(F.conv(F.substring(md5_order(seed, *KEYS), 1, 12), 16, 10).cast("long"), F.col("size"))
    want = limits.where("n_cross > 0").join(size, "cid").withColumn("step", F.explode(F.sequence(F.lit(0), F.least("n_cross", "size"))))
    want = want.withColumn("at", (start + F.col("step")) % F.col("size"))
    found = want.join(ring.drop("size"), ["cid", "at"]).where("doc_id <> other_id")
    order = Window.partitionBy(*KEYS).orderBy("step")
    return found.withColumn("_i", F.row_number().over(order)).where("_i <= n_cross").select(*KEYS, "other_id").distinct()


def complement_limits(limits: DataFrame, positives: DataFrame, ids: DataFrame, seed: int | str = 0) -> DataFrame:
    """``cross_limits`` where a topic's ring is every document of ``ids`` without a
    positive for it. Rings are not made: the document at a place is found in the one
    order of all documents by the number of the topic's positives before it."""
    order = ids.select(F.col("doc_id").alias("other_id")).distinct().withColumn("_o", md5_order(seed, "other_id"))
    placed = Scratch(ids.sparkSession, "ring").keep(positions(order, "_o", "other_id").select("other_id", F.col("pos").alias("place")))
    taken = positives.select(F.col("doc_id").alias("other_id"), "cid").distinct().join(placed, "other_id")
    # A positive at place a with i others before it comes before the ring's places from a - i on.
    keys = positions_within(taken, "cid", "place").select("cid", (F.col("place") - F.col("pos")).alias("at"), F.lit(0).alias("kind"), F.lit(1).cast("long").alias("n"), "size")
    size = keys.groupBy("cid").agg((F.lit(placed.count()) - F.max("size")).alias("size"))
    sized = limits.where("n_cross > 0").join(size, "cid").where("size > 0")
    start = F.pmod(F.conv(F.substring(md5_order(seed, *KEYS), 1, 12), 16, 10).cast("long"), F.col("size"))
    want = sized.withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), F.least("n_cross", "size"))))
    want = want.select(*KEYS, "n_cross", "step", ((start + F.col("step")) % F.col("size")).alias("at"), F.lit(1).alias("kind"), F.lit(0).cast("long").alias("n"))
    both = want.unionByName(keys.drop("size"), allowMissingColumns=True)
    met = running_sums(both, ["cid"], ["at", "kind"], ["n"]).where("kind = 1").withColumn("place", F.col("at") + F.col("run_n"))
    inside = Window.partitionBy(*KEYS).orderBy("step")
    found = met.join(placed, "place").where("doc_id <> other_id").withColumn("_i", F.row_number().over(inside))
    return found.where("_i <= n_cross").select(*KEYS, "other_id").distinct()


def _cross_passages(found: DataFrame, limits: DataFrame, passages: DataFrame, seed: int | str) -> DataFrame:
    sents = passages.select(F.col("doc_id").alias("other_id"), "sent_idx")
    pool = found.join(sents, "other_id").select(*KEYS, "other_id", "sent_idx")
    order = Window.partitionBy(*KEYS).orderBy(md5_order(seed, *KEYS, "other_id", "sent_idx"), "other_id", "sent_idx")
    return pool.join(limits.select(*KEYS, "n_cross"), KEYS).withColumn("_i", F.row_number().over(order)).where("_i <= n_cross").select(*KEYS, "other_id", "sent_idx", F.lit("cross").alias("source"))


def cross_take(limits: DataFrame, negatives: DataFrame, passages: DataFrame, seed: int | str = 0) -> DataFrame:
    """(doc_id, cid, other_id, sent_idx, source): for each key, n_cross passages
    in hashed order of the documents that its ring gives. Documents without a
    passage stand in no ring; a small ring gives several passages a document."""
    ring = negatives.join(passages.select("doc_id").distinct(), "doc_id", "left_semi")
    return _cross_passages(cross_limits(limits, ring, seed), limits, passages, seed)


def examples(positives: DataFrame, candidates: DataFrame, passages: DataFrame, negatives: DataFrame | None = None, k: int = 100, per_pos: int = 6, seed: int | str = 0, epoch: int = 0) -> DataFrame:
    """(doc_id, cid, other_id, sent_idx, source, label): the positives and their
    hard, random and cross-document negatives by quota; other_id is the
    passage's document. Hard and random parts may share a passage. Each ``epoch``
    draws other negatives, and the same ones whenever it is asked for. Without
    ``negatives`` every document is one for the topics it has no positive for."""
    seed = f"{seed}.{epoch}" if epoch else seed
    limits = quotas(positives, per_pos)
    hard = take(hard_pool(candidates, positives, k).join(limits.select(*KEYS), KEYS, "left_semi"), limits, "n_hard", "hard", seed)
    same = take(random_pool(passages, positives), limits, "n_random", "random", seed).unionByName(hard)
    found = positives.select(*KEYS, "sent_idx", F.lit("gold").alias("source")).unionByName(same).withColumn("other_id", F.col("doc_id"))
    if negatives is None:
        ids = passages.select("doc_id").distinct()
        cross = _cross_passages(complement_limits(limits, positives, ids, seed), limits, passages, seed)
    else:
        cross = cross_take(limits, negatives, passages, seed)
    out = found.unionByName(cross)
    return out.select(*KEYS, "other_id", "sent_idx", "source", (F.col("source") == "gold").cast("int").alias("label"))


def top_up(candidates: DataFrame, positives: DataFrame, passages: DataFrame, k: int, per_pos: int, seed: int | str = 0) -> DataFrame:
    """Reranker negatives: hashed top-k candidates that are no gold, topped up
    from the same document without repeats, per_pos * max(n_gold, 1) of them."""
    keys = candidates.select(*KEYS).distinct()
    n_gold = positives.groupBy(*KEYS).agg(F.count("*").alias("n"))
    limit = keys.join(n_gold, KEYS, "left").select(*KEYS, (F.greatest(F.coalesce("n", F.lit(0)), F.lit(1)) * per_pos).alias("limit"))
    first = hard_pool(candidates, positives, k).withColumn("priority", F.lit(0))
    rest = passages.select("doc_id", "sent_idx").join(keys, "doc_id").select(*KEYS, "sent_idx").join(positives, [*KEYS, "sent_idx"], "left_anti").join(first, [*KEYS, "sent_idx"], "left_anti").withColumn("priority", F.lit(1))
    order = Window.partitionBy(*KEYS).orderBy("priority", md5_order(seed, *KEYS, "sent_idx"), "sent_idx")
    return first.unionByName(rest).join(limit, KEYS).withColumn("_i", F.row_number().over(order)).where(F.col("_i") <= F.col("limit")).select(*KEYS, "sent_idx", "priority")


def mined_pairs(candidates: DataFrame, gold: DataFrame, extra: int = 5) -> DataFrame:
    """(doc_id, cid, sent_idx, label): all candidates labelled; groups without
    gold give their first ``extra`` once more as negatives."""
    g = gold.select(*KEYS, "sent_idx").distinct().withColumn("_g", F.lit(1))
    labelled = candidates.join(g, [*KEYS, "sent_idx"], "left").select(*KEYS, "sent_idx", F.coalesce("_g", F.lit(0)).alias("label"))
    bare = candidates.where(F.col("rank") <= extra).join(gold.select(*KEYS).distinct(), KEYS, "left_anti").select(*KEYS, "sent_idx", F.lit(0).alias("label"))
    return labelled.unionByName(bare)
