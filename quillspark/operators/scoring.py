"""Scorer seam, chunk aggregation, ensembles and standardising."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quillspark.functions.text import tokens


def distinct_words(text: Column) -> Column:
    return F.array_distinct(tokens(text))


def share_logit(words: Column, wanted: Column) -> Column:
    """The share of the distinct words ``wanted`` among ``words``, as a logit in [-4, 4]."""
    return F.size(F.array_intersect(words, wanted)) / F.greatest(F.size(wanted), F.lit(1)) * 8 - 4


def lexical_logit(text: Column, topic: Column) -> Column:
    """Default scorer: share of the topic's words that the text holds."""
    return share_logit(distinct_words(text), distinct_words(topic))


def vector_scorer(fn: Callable[[pd.Series, pd.Series], pd.Series]):
    """Wraps a batch scorer (texts, topics) -> logits that needs no setting up as a column function."""

    def score(text: pd.Series, topic: pd.Series) -> pd.Series:
        return fn(text, topic).astype("float64")

    score.__annotations__ = {"text": pd.Series, "topic": pd.Series, "return": pd.Series}
    return F.pandas_udf(score, "double")


def vector_encoder(fn: Callable[[pd.Series], pd.Series]):
    """The same for a batch encoder texts -> float lists."""

    def encode(text: pd.Series) -> pd.Series:
        return fn(text)

    encode.__annotations__ = {"text": pd.Series, "return": pd.Series}
    return F.pandas_udf(encode, "array<float>")


def _runs(sizes: Sequence[int], batch: int, max_chars: int) -> Iterator[list[int]]:
    """Places by size, in runs of at most ``batch`` whose padded size, the number
    times the longest, is at most ``max_chars``; a longer one is a run of its own."""
    run: list[int] = []
    for i in sorted(range(len(sizes)), key=sizes.__getitem__):
        if run and (len(run) == batch or (len(run) + 1) * sizes[i] > max_chars):
            yield run
            run = []
        run.append(i)
    if run:
        yield run


def _applied(rows: DataFrame, inputs: list[str], out: str, kind: T.DataType, setup: Callable, weights, batch: int, max_chars: int, finish: Callable) -> DataFrame:
    rows = rows.drop(out)
    shared = None if weights is None else rows.sparkSession.sparkContext.broadcast(weights)
    arrow = pa.list_(pa.float64()) if isinstance(kind, T.ArrayType) else pa.float64()

    def run(batches):
        model = setup() if shared is None else setup(shared.value)  # once a task
        for part in batches:
            columns = [part.column(c).fill_null("").to_pylist() for c in inputs]
            results = [None] * len(part)
            for places in _runs([sum(map(len, values)) for values in zip(*columns, strict=True)], batch, max_chars):
                found = model(*[[column[i] for i in places] for column in columns])
                for i, value in zip(places, found, strict=True):
                    results[i] = finish(value)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(results, arrow)], [*part.schema.names, out])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(out, kind)]))


def scored(rows: DataFrame, text: str, topic: str, out: str, setup: Callable, weights=None, batch: int = 32, max_chars: int = 1 << 16) -> DataFrame:
    """``rows`` with the column ``out``, a model's logit of each (text, topic).

    ``setup()`` makes the model, a function of two lists of texts, once in each
    task; with ``weights``, which are broadcast once, it is ``setup(weights)``.
    Texts go to it by length, in runs of at most ``batch`` and of a bounded padded
    size, and come back in their rows, so results don't depend on either. A null
    is an empty text.
    """
    return _applied(rows, [text, topic], out, T.DoubleType(), setup, weights, batch, max_chars, float)


def encoded(rows: DataFrame, text: str, out: str, setup: Callable, weights=None, batch: int = 32, max_chars: int = 1 << 16) -> DataFrame:
    """The same with a model of one list of texts that gives vectors; ``out`` has
    them at unit length (the norm counts 1e-8 more)."""

    def unit(vector):
        norm = math.sqrt(sum(float(x) * float(x) for x in vector)) + 1e-8
        return [float(x) / norm for x in vector]

    return _applied(rows, [text], out, T.ArrayType(T.DoubleType()), setup, weights, batch, max_chars, unit)


def aggregate_chunks(rows: DataFrame, by: list[str], method: str, m: int = 2, value: str = "prob") -> DataFrame:
    """(by, prob) of chunk scores: max, mean of the top m (always over m) or log-sum-exp."""
    v = F.col(value)
    if method == "max":
        return rows.groupBy(*by).agg(F.coalesce(F.max(v), F.lit(0.0)).alias("prob"))
    if method == "topm":
        first = rows.withColumn("_i", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(value)))).where(F.col("_i") <= m)
        return first.groupBy(*by).agg(F.round(F.sum(v) / m, 9).alias("prob"))
    if method == "logsumexp":
        # Chunks of equal score first, then the maximum beside them: neither the rows nor their texts are read twice.
        cells = rows.groupBy(*by, v.alias("_v")).agg(F.count("*").alias("_n"))
        top = cells.groupBy(*by).agg(F.max("_v").alias("_m"), F.collect_list(F.struct("_v", "_n")).alias("_c"))
        total = F.aggregate("_c", F.lit(0.0), lambda a, c: a + c["_n"] * F.exp(c["_v"] - F.col("_m")))
        return top.select(*by, F.round(F.col("_m") + F.log(total), 9).alias("prob"))
    raise ValueError(f"unknown method {method}")


def ensemble(rows: DataFrame, by: list[str], temperature: float = 1.0, threshold: float = 0.5) -> DataFrame:
    """(by, prob, logit, prob_cal, predicted): means over folds; the mean logit is scaled."""
    a = rows.groupBy(*by).agg(F.round(F.avg("prob"), 9).alias("prob"), F.round(F.avg("logit"), 9).alias("logit"))
    cal = F.round(1 / (1 + F.exp(-F.col("logit") / max(temperature, 1e-4))), 9)
    return a.withColumn("prob_cal", cal).withColumn("predicted", (F.col("prob_cal") >= threshold).cast("int"))


def standardised(rows: DataFrame, value: str, out: str) -> DataFrame:
    """Population z-scores; 0 passes untouched. The moments are one row."""
    s = rows.agg(F.avg(value).alias("mu"), F.stddev_pop(value).alias("sd")).first()
    mu, sd = float(s.mu or 0.0), float(s.sd or 0.0) or 1.0
    return rows.withColumn(out, F.when(F.col(value) != 0, F.round((F.col(value) - mu) / sd, 6)).otherwise(F.lit(0.0)))


def mean_vector(rows: DataFrame, by: str, vector: str) -> DataFrame:
    """(by, vector): the mean by component, summed before the shuffle."""
    flat = rows.select(by, F.posexplode(vector).alias("i", "x")).groupBy(by, "i").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("x"))
    return flat.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias(vector))


def consistency_penalty(edges: DataFrame, nodes: DataFrame, by: list[str], margin: float = 0.0, reduce: str = "mean") -> DataFrame:
    """(penalty): how far each node's probability is from its best edge's, beyond a margin."""
    best = edges.groupBy(*by).agg(F.max("prob").alias("edge"))
    diff = F.greatest(F.abs(F.col("edge") - F.col("prob")) - margin, F.lit(0.0))
    fn = F.avg if reduce == "mean" else F.sum
    return nodes.join(best, by).agg(F.round(fn(diff), 9).alias("penalty"))
