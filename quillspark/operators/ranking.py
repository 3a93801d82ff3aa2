"""Ranking metrics of candidate lists, overall and per topic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.operators.splits import positions_within, running_sums

KEYS = ("doc_id", "cid")


def ranked_by(rows: DataFrame, prob: str, keys: tuple[str, ...] = KEYS, tie: str = "sent_idx") -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(prob), tie)))


def scoped(rows: DataFrame, by: str, *aggs: Column) -> DataFrame:
    """One aggregation for all rows (scope 'overall') and for each value of ``by``."""
    both = rows.groupingSets([[], [F.col(by)]], F.col(by)).agg(F.grouping(by).alias("_all"), *aggs)
    return both.withColumn("scope", F.when(F.col("_all") == 1, "overall").otherwise("topic")).drop("_all")


def pair_metrics(candidates: DataFrame, gold: DataFrame, ks: list[int], keys: tuple[str, ...] = KEYS, item: str = "sent_idx") -> DataFrame:
    """(keys, k, hit, recall, mrr, ndcg) of every gold group for every k; a
    group without candidates scores 0. ndcg has binary gains."""
    hits = candidates.join(gold.select(*keys, item).distinct(), [*keys, item], "left_semi").select(*keys, "rank")
    ranks = hits.groupBy(*keys).agg(F.array_sort(F.collect_set("rank")).alias("ranks"))  # at most the candidate list
    groups = gold.groupBy(*keys).agg(F.countDistinct(item).alias("n_gold")).join(ranks, list(keys), "left")
    rows = groups.withColumn("ranks", F.coalesce("ranks", F.array().cast("array<int>"))).withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    within = F.filter("ranks", lambda r: r <= F.col("k"))
    gain = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, r: a + 1 / F.log2(r + F.lit(1.0)))
    ideal = F.sequence(F.lit(1), F.least("n_gold", "k").cast("int"))
    return rows.select(
        *keys, "k", "n_gold", (F.size(within) > 0).cast("int").alias("hit"), (F.size(within) / F.col("n_gold")).alias("recall"),
        F.when(F.size(within) > 0, 1 / F.element_at("ranks", 1)).otherwise(0.0).alias("mrr"), F.round(gain(within) / gain(ideal), 9).alias("ndcg"),
    )


def sweep(candidates: DataFrame, gold: DataFrame, ks: list[int], keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(scope, cid, k, recall_at_k, coverage_at_k, ndcg): recall is a hit rate,
    so coverage equals it."""
    m = pair_metrics(candidates, gold, ks, keys)
    aggs = [F.avg("hit").alias("recall_at_k"), F.avg(F.col("recall").cast("boolean").cast("int")).alias("coverage_at_k"), F.avg("ndcg").alias("ndcg")]
    every = m.groupBy("k").agg(*aggs).select(F.lit("overall").alias("scope"), F.lit(None).cast(m.schema["cid"].dataType).alias("cid"), "k", "recall_at_k", "coverage_at_k", "ndcg")
    return every.unionByName(m.groupBy("cid", "k").agg(*aggs).select(F.lit("topic").alias("scope"), "cid", "k", "recall_at_k", "coverage_at_k", "ndcg"))


def set_recall(rows: DataFrame, gold: DataFrame | None = None, item: str = "sent_idx") -> DataFrame:
    """(scope, cid, retrieved, gold, recall): distinct retrieved positives over
    distinct gold; without external ``gold`` the rows' own positives are gold."""
    keys = ["doc_id", "cid", item]
    positive = rows.where("label = 1").select(*keys).distinct()
    wanted = (gold.select(*keys).distinct() if gold is not None else positive).withColumn("_g", F.lit(1))
    found = positive.withColumn("_r", F.lit(1))
    both = wanted.join(found, keys, "left")
    n = scoped(both, "cid", F.count("_r").alias("retrieved"), F.count("*").alias("gold"))
    return n.withColumn("recall", F.when(F.col("gold") > 0, F.col("retrieved") / F.col("gold")).otherwise(0.0))


def pooled_at_k(rows: DataFrame, ks: list[int], prob: str = "prob", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(k, recall): positives among the first k of all groups over all positives."""
    r = ranked_by(rows, prob, keys)
    out = r.agg(F.sum("label").alias("n"), *[F.sum(F.when(F.col("rank") <= k, F.col("label")).otherwise(0)).alias(f"k{k}") for k in ks])
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"k{k}").alias("v")) for k in ks]))
    return out.select("n", pairs.alias("x")).select("x.k", F.when(F.col("n") > 0, F.col("x.v") / F.col("n")).otherwise(0.0).alias("recall"))


def global_precision(rows: DataFrame, k: int, prob: str, ties: list[str]) -> DataFrame:
    """(k, precision, coverage) of the k best rows of all."""
    total = rows.agg(F.sum("label").alias("n"))
    best = rows.orderBy(F.desc(prob), *ties).limit(k).agg(F.avg("label").alias("p"), F.sum("label").alias("s"))
    one = F.lit(1)
    return best.withColumn("_j", one).join(total.withColumn("_j", one), "_j").select(F.lit(k).alias("k"), F.col("p").alias("precision"), F.try_divide("s", "n").alias("coverage"))


def set_precision(candidates: DataFrame, gold: DataFrame, k: int, keys: tuple[str, ...] = KEYS, item: str = "sent_idx") -> DataFrame:
    """(keys, precision, covered): hits among the first k over k; 1 if any."""
    hit = candidates.where(F.col("rank") <= k).join(gold.select(*keys, item).distinct(), [*keys, item], "left_semi").groupBy(*keys).agg(F.count("*").alias("h"))
    return gold.select(*keys).distinct().join(hit, list(keys), "left").select(*keys, (F.coalesce("h", F.lit(0)) / k).alias("precision"), (F.coalesce("h", F.lit(0)) > 0).cast("int").alias("covered"))


def percentiles(rows: DataFrame, by: list[str], value: str, wanted: dict[str, tuple[float, Column | None]]) -> DataFrame:
    """(by, a column for each name of ``wanted``): the exact percentile q, linear
    between neighbours, of the values that aren't null, of rows that meet the
    condition where one is given. Null keys are groups; without values the result
    is null. Rows of equal value are counted first, and running sums of the counts
    tell where a percentile falls, so that no task holds a group's values."""
    names = list(wanted)
    hit = {n: F.col(value).isNotNull() & (F.lit(True) if c is None else c) for n, (_, c) in wanted.items()}
    cells = rows.groupBy(*by, F.col(value).alias("_v")).agg(*[F.count(F.when(hit[n], 1)).alias(f"_n_{n}") for n in names])
    runs = running_sums(cells, by, ["_v"], [f"_n_{n}" for n in names])

    def at(name: str, edge) -> Column:
        n, run, total = F.col(f"_n_{name}"), F.col(f"run__n_{name}"), F.col(f"all__n_{name}")
        place = edge(F.lit(wanted[name][0]) * (total - 1))
        return F.max(F.when((place >= run - n) & (place < run), F.col("_v")))

    def rest(name: str) -> Column:
        place = F.lit(wanted[name][0]) * (F.max(f"all__n_{name}") - 1)
        return place - F.floor(place)

    parts = [c for n in names for c in (at(n, F.floor).alias(f"_lo_{n}"), at(n, F.ceil).alias(f"_hi_{n}"), rest(n).alias(f"_at_{n}"))]
    found = runs.groupBy(*by).agg(*parts)
    return found.select(*by, *[(F.col(f"_lo_{n}") * (1 - F.col(f"_at_{n}")) + F.col(f"_hi_{n}") * F.col(f"_at_{n}")).alias(n) for n in names])


def latency(rows: DataFrame, value: str, by: str | None = None) -> DataFrame:
    """Exact p50 and p95, linear between neighbours."""
    keys = [by] if by else []
    found = percentiles(rows, keys, value, {"p50": (0.5, None), "p95": (0.95, None)})
    if not by:
        return found.join(rows.agg(F.count(value).alias("n")))
    counts = rows.groupBy(F.col(by).alias("_by")).agg(F.count(value).alias("n"))
    return found.join(counts, F.col(by).eqNullSafe(F.col("_by"))).drop("_by")


def floor_percentiles(rows: DataFrame, value: str, by: str, qs: list[float]) -> DataFrame:
    """(by, q, value) at index floor(q * (n - 1)) of a group's order, without lists."""
    r = positions_within(rows.where(F.col(value).isNotNull()).select(by, value), by, value)
    r = r.withColumn("q", F.explode(F.array(*[F.lit(q) for q in qs])))
    return r.where(F.col("pos") == F.floor(F.col("q") * (F.col("size") - 1))).select(by, "q", F.col(value).alias("value"))
