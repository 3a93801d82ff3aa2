"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import sql
from quillspark.scratch import Scratch
from quillspark.session import table


def op1_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.host_rules import host_rules

    return host_rules(spark, table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.classifier import quality_scores

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_scores(spark, docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op3_voronoi_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.voronoi import top_k

    return top_k(spark, table(spark, sf_dir, "embeddings"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.mixing import nearest_seeds, sized, source_targets, with_copies

    scratch = Scratch(spark, "mixing")
    sizes = scratch.keep(sized(table(spark, sf_dir, "documents")), "sizes")
    targets = scratch.keep(nearest_seeds(sizes, source_targets(spark, sizes, scratch)), "targets")
    mixed = with_copies(sizes, targets)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.suffixes import remove_repeats

    return remove_repeats(spark, table(spark, sf_dir, "documents")).drop("kept")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.unigram import Vocabulary, encoding_digests

    return encoding_digests(spark, table(spark, sf_dir, "documents"), Vocabulary.load())


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.licenses import scan_licenses

    return scan_licenses(spark, table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm import pii

    found = pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "pii")
    spans = F.col("pii")
    counts = [pii.count_of(spans, k).alias(f"n_{k}") for k in pii.KINDS[: pii.BASE]]
    return found.select("doc_id", *counts, F.sha2(pii.digest(pii.base_spans(spans)), 256).alias("base_sha256"), pii.digest(spans).alias("spans"), F.array_join(F.transform(spans, lambda s: s["score"].cast("string")), ",").alias("scores"))


def op9_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.lm import lm_scores

    return lm_scores(spark, table(spark, sf_dir, "documents"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.jaccard import jaccard_components

    docs = table(spark, sf_dir, "documents")
    return jaccard_components(spark, docs, size=4, percent=85).withColumnRenamed("id", "doc_id")


def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.phrases import mine_phrases

    return mine_phrases(spark, table(spark, sf_dir, "documents"))


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.url_filters import filter_urls

    return filter_urls(spark, table(spark, sf_dir, "pages"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.importance import resample

    drawn = resample(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {
    "op1_host_rules": op1_host_rules,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_voronoi_topk": op3_voronoi_topk,
    "op4_source_mixing": op4_source_mixing,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_pii": op7_pii,
    "op8_license_scan": op8_license_scan,
    "op9_recurrent_lm": op9_recurrent_lm,
    "op10_ngram_jaccard": op10_ngram_jaccard,
    "op11_phrase_mining": op11_phrase_mining,
    "op12_url_filters": op12_url_filters,
    "op13_importance_resampling": op13_importance_resampling,
}
ORACLES: dict[str, str] = sql.ORACLES
