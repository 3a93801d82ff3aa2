"""Search indexes on disk, bucketed by document, that searches read without a shuffle.

A lexical index is three tables: the words of every passage, one row a document,
the document frequency of every term, and one row of totals. A dense index is one
table of vectors. Words and vectors are bucketed by document, so that scores and
top-k by document run on the buckets as they were read; the cells of a document are
made and ranked in its task (``matching``).

Bucketed tables need a name in the session's catalog; a folder is registered
under a fresh one whenever it is opened, so that any session can read it.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.text import passages, tokens
from quillspark.operators import matching, retrieval
from quillspark.scratch import Scratch, restrict


def write_bucketed(df: DataFrame, path: str, by: str, buckets: int, dealt: bool = False) -> None:
    """``df`` below ``path``, bucketed by ``by``; the number of buckets stands beside it.
    ``dealt``: its rows come from ``repartition(buckets, by)`` already."""
    spark, name = df.sparkSession, f"quillspark_{uuid.uuid4().hex}"
    # One task a bucket writes one file: with a writer held open no row is sorted.
    writers = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(writers)
    spark.conf.set(writers, "1")
    try:
        (df if dealt else df.repartition(buckets, by)).write.mode("overwrite").bucketBy(buckets, by).option("path", f"{path}/rows").format("parquet").saveAsTable(name)
    finally:
        spark.conf.set(writers, before)
    spark.sql(f"DROP TABLE {name}")
    spark.range(1).select(F.lit(by).alias("by"), F.lit(buckets).alias("buckets")).write.mode("overwrite").parquet(f"{path}/layout")


def read_bucketed(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_bucketed`` wrote, with its buckets known to the planner. Spark would
    read a table by blocks of files where no later step asks for its buckets; from
    here on this session reads bucketed tables by bucket."""
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    layout, schema = spark.read.parquet(f"{path}/layout").first(), spark.read.parquet(f"{path}/rows").schema
    name = f"quillspark_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{layout.by}`) INTO {layout.buckets} BUCKETS LOCATION '{path}/rows'")
    return spark.table(name)


@dataclass(frozen=True)
class LexicalIndex:
    """``words`` (doc_id, words: an array of words a passage), ``terms`` (term, df),
    ``stats`` (one row: n, avgdl)."""

    words: DataFrame
    terms: DataFrame
    stats: DataFrame

    @property
    def postings(self) -> DataFrame:
        """(doc_id, sent_idx, term, tf, dl, norm, lead) of every term."""
        one = self.words.select("doc_id", F.posexplode("words").alias("sent_idx", "w"))
        rows = one.select("doc_id", "sent_idx", F.greatest(F.size("w"), F.lit(1)).alias("dl"), F.posexplode_outer("w").alias("at", "term"))
        return retrieval.with_norms(rows).where("term IS NOT NULL")


def cut(text: Column) -> Column:
    """The words of each passage of a text; null has none."""
    return F.coalesce(F.transform(passages(text), tokens), F.array().cast("array<array<string>>"))


def document_length(words: Column) -> Column:
    """The lengths of a document's passages, 1 at least each, added up."""
    return F.aggregate(words, F.lit(0).cast("long"), lambda a, w: a + F.greatest(F.size(w), F.lit(1)))


def passage_counts(words: DataFrame, *keep: str) -> DataFrame:
    """(keep, term): a row for each distinct word of each passage."""
    return words.select(*keep, F.explode("words").alias("w")).select(*keep, F.explode(F.array_distinct("w")).alias("term"))


def _write_words(docs: DataFrame, path: str, buckets: int) -> None:
    """(doc_id, words) in buckets; the passages of documents of one id are put together by place."""
    rows = docs.select("doc_id", "text").repartition(buckets, "doc_id").select("doc_id", cut(F.col("text")).alias("words"))
    repeated = Scratch(docs.sparkSession, "repeated").keep(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    if repeated.isEmpty():
        return write_bucketed(rows, path, "doc_id", buckets, dealt=True)
    several = restrict(rows, repeated, "doc_id").groupBy("doc_id").agg(F.collect_list("words").alias("all"))
    last = F.array_max(F.transform("all", F.size)) - 1
    places = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    joined = F.transform(places, lambda i: F.flatten(F.transform("all", lambda w: F.coalesce(F.get(w, i), F.array().cast("array<string>")))))
    write_bucketed(restrict(rows, repeated, "doc_id", "left_anti").unionByName(several.select("doc_id", joined.alias("words"))), path, "doc_id", buckets)


def build_lexical_index(docs: DataFrame, path: str, buckets: int | None = None) -> LexicalIndex:
    """Cuts all texts once and writes the index; null and empty texts have no
    passages. Documents of one id are one document."""
    spark = docs.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    _write_words(docs, f"{path}/words", buckets)
    kept = spark.read.parquet(f"{path}/words/rows")
    passage_counts(kept).groupBy("term").agg(F.count("*").alias("df")).write.mode("overwrite").parquet(f"{path}/terms")
    sums = kept.agg(F.coalesce(F.sum(F.size("words")), F.lit(0)).alias("n"), F.sum(document_length(F.col("words"))).alias("dl"))
    sums.select("n", F.when(F.col("n") > 0, F.col("dl") / F.col("n")).alias("avgdl")).write.mode("overwrite").parquet(f"{path}/stats")
    return open_lexical_index(spark, path)


def open_lexical_index(spark: SparkSession, path: str) -> LexicalIndex:
    return LexicalIndex(read_bucketed(spark, f"{path}/words"), spark.read.parquet(f"{path}/terms"), spark.read.parquet(f"{path}/stats"))


def search_bm25(index: LexicalIndex, topics: DataFrame, k: int, k1: float = retrieval.K1, b: float = retrieval.B) -> DataFrame:
    """The k best passages of every document and topic. Only the terms of the
    topics travel, with their frequencies."""
    t = matching.topic_matrix(topics)
    asked = retrieval.topic_terms(topics).select("term").distinct()
    found = {r["term"]: r["df"] for r in index.terms.join(F.broadcast(asked), "term").select("term", "df").collect()}  # a row a term of the topics
    stats = index.stats.first()
    df = np.array([found.get(x, 0) for x in t.terms.to_pylist()], dtype=float)
    return matching.top(index.words, t, matching.Bm25(t, df, stats["n"], stats["avgdl"] or 1.0, k1, b), k)


def search_sparse(index: LexicalIndex, topics: DataFrame, k: int) -> DataFrame:
    """The same by the cosine of term frequencies."""
    t = matching.topic_matrix(topics)
    return matching.top(index.words, t, matching.Cosine(t), k)


def build_dense_index(vectors: DataFrame, path: str, by: str = "doc_id", buckets: int | None = None) -> DataFrame:
    """``vectors`` (by, vec_id, embedding) on disk, bucketed by their document."""
    buckets = buckets or int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    write_bucketed(vectors.select(by, "vec_id", "embedding"), path, by, buckets)
    return read_bucketed(vectors.sparkSession, path)


def search_dense(index: DataFrame, queries: DataFrame, k: int, by: str = "doc_id") -> DataFrame:
    """The k best other vectors of the same document for every query vector. With
    ``queries`` from an index of as many buckets, no side is shuffled by document."""
    return retrieval.top_k(retrieval.dense_scores(queries, index, by, group_first=True), k, (by, "query_id"), "vec_id")
