"""Ground-truth tables: documents and passages crossed with topics, and answer spans.

Topics are few and fixed; Spark broadcasts them while their size allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions.text import let, locate_span
from quillspark.functions.text import passages as passages_of
from quillspark.scratch import Scratch, build_side


def document_truth(docs: DataFrame, topics: DataFrame, positives: DataFrame) -> DataFrame:
    """(doc_id, cid, label) of every document and topic."""
    y = positives.select("doc_id", "cid").distinct().withColumn("_y", F.lit(1))
    return docs.select("doc_id").crossJoin(topics.select("cid")).join(y, ["doc_id", "cid"], "left").select("doc_id", "cid", F.coalesce("_y", F.lit(0)).alias("label"))


def passage_truth(passages: DataFrame, topics: DataFrame, annotations: DataFrame) -> DataFrame:
    """(doc_id, sent_idx, cid, sent, label) for documents with annotations;
    annotated places beyond the passages are padded with the annotation's text.

    ``annotations``: (doc_id, sent_idx, cid, status, text). A place takes its
    passage, else the first text annotated there.
    """
    notes = annotations.groupBy("doc_id", "sent_idx").agg(F.min("text").alias("note"))
    seen = annotations.select("doc_id").distinct()
    last = passages.join(seen, "doc_id", "left_semi").select("doc_id", "sent_idx").unionByName(notes.select("doc_id", "sent_idx")).groupBy("doc_id").agg(F.max("sent_idx").alias("last"))
    grid = last.select("doc_id", F.explode(F.sequence(F.lit(0), "last")).alias("sent_idx"))
    text = grid.join(passages, ["doc_id", "sent_idx"], "left").join(notes, ["doc_id", "sent_idx"], "left").select("doc_id", "sent_idx", F.coalesce("sent", "note", F.lit("")).alias("sent"))
    y = annotations.where("status = 1").select("doc_id", "sent_idx", "cid").distinct().withColumn("_y", F.lit(1))
    return text.crossJoin(topics.select("cid")).join(y, ["doc_id", "sent_idx", "cid"], "left").select("doc_id", "sent_idx", "cid", "sent", F.coalesce("_y", F.lit(0)).alias("label"))


def document_passage_truth(docs: DataFrame, topics: DataFrame, annotations: DataFrame) -> DataFrame:
    """``passage_truth`` of the passages of ``docs`` (doc_id, text). A document's row
    meets its annotations once, and its text is cut, padded and labelled there: no
    passage is dealt or sorted. ``annotations`` are read twice."""
    scratch = Scratch(docs.sparkSession, "annotations")
    notes = annotations.groupBy("doc_id", "sent_idx").agg(F.min("text").alias("note"), F.collect_set(F.when(F.col("status") == 1, F.col("cid"))).alias("yes"))
    own = scratch.keep(notes.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("sent_idx", F.struct("note", "yes").alias("v")))).alias("notes"), F.max("sent_idx").alias("last")))
    without = own.join(docs.select("doc_id"), "doc_id", "left_anti").withColumn("text", F.lit(None).cast("string"))
    rows = docs.select("doc_id", "text").join(build_side(own, 100_000), "doc_id").unionByName(without)

    def places(sents: Column) -> Column:
        def one(i: Column) -> Column:
            v = F.try_element_at(F.col("notes"), i)
            return F.struct(i.alias("sent_idx"), F.coalesce(F.get(sents, i), v["note"], F.lit("")).alias("sent"), v["yes"].alias("yes"))

        return F.transform(F.sequence(F.lit(0), F.greatest(F.size(sents) - 1, F.col("last"))), one)

    cut = rows.select("doc_id", F.inline(let(passages_of(F.col("text")), places)))
    label = F.coalesce(F.array_contains("yes", F.col("cid")), F.lit(False)).cast("int")
    return cut.crossJoin(F.broadcast(topics.select("cid"))).select("doc_id", "sent_idx", "cid", "sent", label.alias("label"))


def answer_spans(docs: DataFrame, offsets: DataFrame, evidence: DataFrame) -> DataFrame:
    """(doc_id, cid, sent_idx, start, end) of evidence (doc_id, cid, sent_idx, text):
    by index, else by finding the text, else without its closing marks; unresolved rows go."""
    e = evidence.where("status = 1").select("doc_id", "cid", "sent_idx", "text").distinct()
    by_index = e.join(offsets.select("doc_id", "sent_idx", F.struct("start", "end").alias("_i")), ["doc_id", "sent_idx"], "left")
    found = by_index.join(docs.select("doc_id", F.col("text").alias("_t")), "doc_id").withColumn("_s", F.coalesce("_i", locate_span(F.col("_t"), F.col("text"))))
    return found.where("_s IS NOT NULL").select("doc_id", "cid", "sent_idx", "_s.start", "_s.end")


def merged(predictions: DataFrame, truth: DataFrame, keys: list[str], on_repeats: str = "keep") -> DataFrame:
    """``predictions`` with the ``truth`` label of their keys, both on either side.

    ``keep`` pairs every row with every label of its key, as a merge of tables does;
    ``last`` takes one label a key, of repeats the one with the greatest ``ordinal``.
    """
    if on_repeats not in ("keep", "last"):
        raise ValueError(f"unknown way {on_repeats}")
    labels = truth.select(*keys, F.col("label").alias("truth")) if on_repeats == "keep" else last_label(truth, keys, "ordinal").withColumnRenamed("label", "truth")
    return predictions.join(labels, keys)


def rebuilt_text(passages: DataFrame) -> DataFrame:
    """(doc_id, text): passages joined by spaces in the order of their ids as strings."""
    s = F.array_sort(F.collect_list(F.struct(F.col("sent_idx").cast("string").alias("i"), "sent")))
    return passages.groupBy("doc_id").agg(F.array_join(F.transform(s, lambda x: x["sent"]), " ").alias("text"))


def with_context(rows: DataFrame, by: str, order: str, text: str) -> DataFrame:
    """``context``: the row's text between its neighbours', joined by [SEP]; missing and empty ones are left out."""
    w = Window.partitionBy(by).orderBy(order)
    part = lambda c: F.nullif(F.trim(c), F.lit(""))
    return rows.withColumn("context", F.concat_ws(" [SEP] ", part(F.lag(text).over(w)), part(F.col(text)), part(F.lead(text).over(w))))


def last_label(labels: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """One label a key: of repeats the last by ``ordinal``."""
    return labels.groupBy(*keys).agg(F.max_by("label", ordinal).alias("label"))


def violations(rows: DataFrame) -> DataFrame:
    """(rule, n): label outside 0 and 1, prob outside [0, 1], repeated keys."""
    bad = rows.agg(F.count_if(~F.col("label").isin(0, 1) | F.col("label").isNull()).alias("label"), F.count_if(~F.col("prob").between(0, 1) | F.col("prob").isNull()).alias("prob"))
    dup = rows.groupBy("doc_id", "cid").count().agg(F.count_if(F.col("count") > 1).alias("key"))
    long = bad.unpivot([], ["label", "prob"], "rule", "n")
    return long.unionByName(dup.select(F.lit("key").alias("rule"), F.col("key").alias("n")))
