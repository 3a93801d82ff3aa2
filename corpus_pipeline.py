"""A training-corpus pipeline of five stages over the table of documents.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes
each result as Parquet to the shared folder and gives it to the next stage. All
but the last return the columns of documents.

All stages keep to these rules. Rows with nulls in any column, and rows that
repeat others, are rows like all others. Empty tables give empty tables. Whole
texts count, of whatever length. Columns beside those of documents are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import mixing, pii
from quillspark.llm.classifier import quality_scores
from quillspark.llm.jaccard import jaccard_components
from quillspark.llm.unigram import Vocabulary, encode
from quillspark.scratch import Scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. A null or empty text has
    the score of a text without words; without labels to learn from every row
    has their smoothed share of label 1."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_scores(spark, docs, labels).where("predicted = 1").select(COLUMNS)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id
    (five-word shingles, a Jaccard similarity of 0.8 or more). A document
    without an id is its own group; of rows that repeat an id all stay or go."""
    groups = jaccard_components(spark, docs, size=5, percent=80)
    gone = groups.where("id <> component_id").select(F.col("id").alias("doc_id")).distinct()
    return docs.join(gone, "doc_id", "left_anti").select(COLUMNS)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by the name of its kind; n_chars follows the text.
    A row without any, such as one with a null text, stays as it is."""
    found = pii.find_pii(docs.select(COLUMNS))
    text = pii.redacted(F.col("text"), F.col("pii"))
    changed = F.size("pii") > 0
    return found.withColumn("redacted", F.when(changed, text).otherwise(F.col("text"))).select("doc_id", F.col("redacted").alias("text"), "lang", "source", F.when(changed, F.length("redacted").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, 0 to 2 times. A null
    source is a source; rows that repeat an id, and null ids, share a draw; a
    text without words comes as often as its source's rate says."""
    scratch = Scratch(spark, "pipeline-mix")
    sizes = scratch.keep(mixing.sized(docs), "sizes")
    targets = mixing.source_targets(spark, sizes, scratch)
    return mixing.emit_copies(mixing.with_copies(docs, targets)).select(COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_pieces, piece_ids) of every row; a null or empty
    text has no pieces."""
    coded = encode(docs.select("doc_id", "lang", "source", "text"), Vocabulary.load())
    return coded.select("doc_id", "lang", "source", F.size("piece_ids").cast("long").alias("n_pieces"), "piece_ids")


STAGES = [
    ("quality_classifier", classify),
    ("ngram_jaccard_dedup", deduplicate),
    ("pii_redaction", redact),
    ("source_mixing", mix),
    ("sentencepiece_encoding", tokenize),
]

# The classifier and the encoder are no SQL; tests hold the stages against
# brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return docs
