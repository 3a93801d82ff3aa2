"""A vectoriser that is fitted once, saved, loaded and applied to texts it hasn't seen.

Two backends stand behind one interface. ``tfidf`` weighs words and pairs of
words of a fitted vocabulary and gives sorted sparse unit vectors, passage by
passage (``grams``); the vocabulary has ``size`` rows at most and travels with the tasks.
``model`` hands texts to an encoder that is set up once a task
(``scoring.model_encoder``) and keeps its name beside the empty vocabulary, so
that a loaded vectoriser knows which encoder it needs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.operators import retrieval
from quillspark.operators.grams import gram_vectors

VOCABULARY = "term string, idx int, idf double"
VECTOR = "struct<idx:array<int>,w:array<double>>"


class Vectoriser:
    """``vocabulary`` (term, idx, idf), or the name of a model."""

    def __init__(self, vocabulary: DataFrame, backend: str = "tfidf", model_name: str | None = None):
        if backend not in ("tfidf", "model"):
            raise ValueError(f"unknown backend {backend}")
        if backend == "model" and not model_name:
            raise ValueError("the model backend needs a name")
        self.vocabulary, self.backend, self.model_name = vocabulary, backend, model_name

    @classmethod
    def fit(cls, passages: DataFrame, topics: DataFrame, size: int = 2048) -> Vectoriser:
        """The ``size`` most frequent terms of passages (doc_id, sent_idx, sent)
        and topics (cid, text), numbered in their own order."""
        terms = retrieval.vocabulary_of(passages, topics, size)
        # ``size`` rows are numbered in one task.
        return cls(terms.select("term", (F.row_number().over(Window.orderBy("term")) - 1).cast("int").alias("idx"), "idf"))

    @classmethod
    def of_model(cls, spark: SparkSession, name: str) -> Vectoriser:
        return cls(spark.createDataFrame([], VOCABULARY), "model", name)

    def save(self, path: str) -> None:
        """``path``/vocabulary and one row in ``path``/meta."""
        self.vocabulary.write.mode("overwrite").parquet(f"{path}/vocabulary")
        meta = self.vocabulary.sparkSession.range(1).select(F.lit(self.backend).alias("backend"), F.lit(self.model_name).cast("string").alias("model_name"))
        meta.write.mode("overwrite").parquet(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Vectoriser:
        meta = spark.read.parquet(f"{path}/meta").first()
        return cls(spark.read.schema(VOCABULARY).parquet(f"{path}/vocabulary"), meta.backend, meta.model_name)

    def transform(self, rows: DataFrame, keys: list[str], text: str, encoders: dict[str, Callable] | None = None, **batching) -> DataFrame:
        """(keys, vector) of every row; ``keys`` tell the rows apart.

        tfidf: a struct of ascending idx and their weights, of unit length (the
        norm counts 1e-8 more); a null or empty text, or one without known terms,
        has empty arrays. model: array<float> of unit length from
        ``encoders[model_name]``, a function that sets up an encoder of lists of
        texts; ``batching`` goes to ``scoring.encoded``.
        """
        if self.backend == "model":
            from quillspark.operators.scoring import encoded

            setup = (encoders or {}).get(self.model_name)
            if setup is None:
                raise ValueError(f"no encoder given for {self.model_name}")
            return encoded(rows.select(*keys, F.col(text).alias("_text")), "_text", "vector", setup, **batching).drop("_text")
        return gram_vectors(rows, keys, text, self.vocabulary.select("term", "idx", "idf").toArrow())  # ``size`` rows


def sparse_dot(left: DataFrame, right: DataFrame, left_keys: list[str], right_keys: list[str]) -> DataFrame:
    """(left_keys, right_keys, score): inner products of the sparse vectors of all
    pairs that share a term. ``right`` is the small side by nature (topics)."""
    flat = lambda df, keys, w: df.select(*keys, F.explode(F.arrays_zip(F.col("vector.idx").alias("idx"), F.col("vector.w").alias("w"))).alias("e")).select(*keys, F.col("e.idx").alias("idx"), F.col("e.w").alias(w))
    met = flat(left, left_keys, "x").join(flat(right, right_keys, "y"), "idx")
    return met.groupBy(*left_keys, *right_keys).agg(F.round(F.sum(F.col("x") * F.col("y")), 6).alias("score"))
