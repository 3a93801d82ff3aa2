"""Tables put together for scorers and graphs: attached texts, pairs, batches, bundles.

Topic tables are small sides by nature; Spark broadcasts them by measured size.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions.text import chunks, let, rounded, tokens
from quillspark.operators import calibration, classification
from quillspark.operators.splits import positions

KEYS = ["doc_id", "cid"]


def of_split(rows: DataFrame, splits: DataFrame, split: str, id_col: str = "doc_id") -> DataFrame:
    """The rows whose id stands in ``split`` of (id, split)."""
    return rows.join(splits.where(F.col("split") == split).select(id_col), id_col, "left_semi")


def probability(row_columns: list[str], key: str) -> Column:
    """The column ``key``, else prob, else 0, of a table with these columns."""
    return F.coalesce(*[F.col(c).cast("double") for c in dict.fromkeys([key, "prob"]) if c in row_columns], F.lit(0.0))


def _with_sides(candidates: DataFrame, passages: DataFrame, topics: DataFrame, k: int) -> DataFrame:
    """The first k candidates with their passage and topic, and whether there is one."""
    first = candidates.where(F.col("rank") <= k).select(*KEYS, "sent_idx", "rank")
    sent = passages.select("doc_id", "sent_idx", "sent", F.lit(True).alias("_has_p"))
    topic = topics.select("cid", F.col("text").alias("topic"), F.lit(True).alias("_has_t"))
    return first.join(sent, ["doc_id", "sent_idx"], "left").join(topic, "cid", "left")


def _missing() -> list[Column]:
    absent = lambda c: F.count_if(F.col(c).isNull())
    return [F.count(F.lit(1)).alias("candidates"), absent("_has_p").alias("no_passage"), absent("_has_t").alias("no_topic")]


def candidate_rows(candidates: DataFrame, passages: DataFrame, topics: DataFrame, gold: DataFrame, k: int, observation: Observation | None = None) -> DataFrame:
    """(doc_id, cid, sent_idx, rank, sent, topic, label) of the first k candidates; a
    candidate without its passage or topic is left out. With an ``observation`` the
    pass that makes the rows also counts ``candidates`` and those with ``no_passage``
    and ``no_topic``."""
    rows = _with_sides(candidates, passages, topics, k)
    if observation is not None:
        rows = rows.observe(observation, *_missing())
    marked = gold.select(*KEYS, "sent_idx").distinct().withColumn("label", F.lit(1))
    rows = rows.where("_has_p AND _has_t").join(marked, [*KEYS, "sent_idx"], "left")
    return rows.select(*KEYS, "sent_idx", "rank", "sent", "topic", F.coalesce("label", F.lit(0)).alias("label"))


def unattached(candidates: DataFrame, passages: DataFrame, topics: DataFrame, k: int) -> DataFrame:
    """(missing, n): how many of the first k candidates lack a passage, and a topic; one pass."""
    found = _with_sides(candidates, passages, topics, k).agg(*_missing())
    return found.select(F.inline(F.array(F.struct(F.lit("passage").alias("missing"), F.col("no_passage").alias("n")), F.struct(F.lit("topic").alias("missing"), F.col("no_topic").alias("n")))))


def attach_pairs(labels: DataFrame, docs: DataFrame, topics: DataFrame, missing: str = "drop") -> DataFrame:
    """(doc_id, cid, text, topic, label). Of pairs without a document or topic
    ``drop`` keeps none, ``empty`` all with empty texts, ``drop_doc`` those with a document."""
    if missing not in ("drop", "empty", "drop_doc"):
        raise ValueError(f"unknown way {missing}")
    rows = labels.join(docs.select("doc_id", "text"), "doc_id", "left" if missing == "empty" else "inner")
    rows = rows.join(topics.select("cid", F.col("text").alias("topic")), "cid", "inner" if missing == "drop" else "left")
    return rows.select(*KEYS, F.coalesce("text", F.lit("")).alias("text"), F.coalesce("topic", F.lit("")).alias("topic"), "label")


def whole_document_candidates(candidates: DataFrame, passages: DataFrame, topics: DataFrame) -> DataFrame:
    """``candidates`` and, for each pair of a document and a topic without any,
    all passages of the document with score 0 in their order."""
    pairs = passages.select("doc_id").distinct().crossJoin(topics.select("cid")).join(candidates.select(*KEYS).distinct(), KEYS, "left_anti")
    rest = pairs.join(passages.select("doc_id", "sent_idx"), "doc_id")
    rest = rest.select(*KEYS, "sent_idx", F.lit(0.0).alias("score"), (F.col("sent_idx") + 1).cast("int").alias("rank"))
    return candidates.select(*KEYS, "sent_idx", "score", "rank").unionByName(rest)


def chunk_pairs(docs: DataFrame, topics: DataFrame, max_len: int = 512, stride: int = 128) -> DataFrame:
    """(doc_id, chunk_id, cid, words, topic): every window of a document with every topic."""
    cut = docs.select("doc_id", F.posexplode(chunks(tokens(F.col("text")), max_len, stride)).alias("chunk_id", "c")).select("doc_id", "chunk_id", "c.words")
    return cut.crossJoin(topics.select("cid", F.col("text").alias("topic")))


def topic_map(labels: DataFrame, docs: DataFrame, value: str = "label") -> DataFrame:
    """(doc_id, by_topic): every document with the map of its topics' values, empty without any."""
    entry = F.map_from_entries(F.sort_array(F.collect_list(F.struct("cid", value)))).alias("by_topic")  # a row a topic
    maps = labels.select("doc_id", "cid", value).dropDuplicates(KEYS).groupBy("doc_id").agg(entry)
    return docs.select("doc_id").join(maps, "doc_id", "left").withColumn("by_topic", F.coalesce("by_topic", F.create_map().cast(maps.schema["by_topic"].dataType)))


def annotation_maps(notes: DataFrame, order: str = "at") -> tuple[DataFrame, DataFrame]:
    """First text by (doc_id, sent_idx) and last text by (doc_id, cid, sent_idx), in the order of ``order``."""
    first = notes.groupBy("doc_id", "sent_idx").agg(F.min_by("text", order).alias("text"))
    return first, notes.groupBy(*KEYS, "sent_idx").agg(F.max_by("text", order).alias("text"))


def term_weights(text: Column) -> Column:
    """Map of each word to its frequency over the norm of all: the sparse encoder's default."""

    def over(w: Column) -> Column:
        # Runs of equal words in sorted order, so that long texts stay linear but for the sort.
        ends = F.filter(F.sequence(F.lit(1), F.size(w)), lambda i: (i == F.size(w)) | (F.get(w, i) != F.get(w, i - 1)))
        counts = let(ends, lambda e: F.transform(e, lambda i, k: F.struct(F.get(w, i - 1).alias("term"), (i - F.coalesce(F.get(e, k - 1), F.lit(0))).cast("double").alias("n"))))

        def scaled(c: Column) -> Column:
            norm = F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x["n"] * x["n"]))
            return let(norm, lambda d: F.map_from_entries(F.transform(c, lambda x: F.struct(x["term"], (x["n"] / d).alias("w")))))

        return F.when(F.size(w) == 0, F.create_map().cast("map<string,double>")).otherwise(let(counts, scaled))

    return let(F.sort_array(tokens(F.coalesce(text, F.lit("")))), over)


def fold_scores(rows: DataFrame, scorers: dict[int, Callable[[pd.DataFrame], pd.Series]], fold: str = "fold") -> DataFrame:
    """``rows`` with ``prob`` by the scorer of each row's fold; a fold without a scorer fails."""
    from pyspark.sql import types as T

    rows = rows.drop("prob")

    def run(frames):
        for frame in frames:
            prob = pd.Series(0.0, index=frame.index)
            for k, part in frame.groupby(fold):
                prob[part.index] = scorers[int(k)](part)
            yield frame.assign(prob=prob)

    return rows.mapInPandas(run, T.StructType([*rows.schema.fields, T.StructField("prob", T.DoubleType())]))


def batches(rows: DataFrame, size: int, columns: list[str], *order: str) -> DataFrame:
    """(batch, n, columns as arrays): runs of ``size`` rows in an order, padded by nothing."""
    placed = positions(rows.select(*dict.fromkeys([*order, *columns])), *order)
    packed = F.sort_array(F.collect_list(F.struct("pos", *columns)))  # ``size`` rows
    out = placed.groupBy(F.floor(F.col("pos") / size).alias("batch")).agg(packed.alias("_r"))
    return out.select("batch", F.size("_r").alias("n"), *[F.col("_r")[c].alias(c) for c in columns])


def evidence_bundle(rows: DataFrame, prob: str = "prob", calibrated: str = "prob_cal", by: str = "cid", bins: int = 10) -> DataFrame:
    """(scope, by, n, n_pos, auprc, auprc_cal, threshold, f1, precision_best,
    recall_best, precision_half, recall_half, f1_half, ece_before, ece_after): one
    row a topic and one over all. Figures at the threshold of the best F1 (the
    smaller one of ties) and at 0.5 are of the calibrated scores. Areas of
    one-class groups are null, so that means leave them out.

    Rows are read once, as counts of each distinct score by topic and over all;
    every figure comes from the running sums over these counts.
    """
    sides = F.inline(F.array(F.struct(F.lit("raw").alias("side"), F.col(prob).alias("threshold")), F.struct(F.lit("cal").alias("side"), F.col(calibrated).alias("threshold"))))
    flat = rows.select(F.col(by).cast("string").alias("_k"), "label", sides)
    k, side, x = F.col("_k"), F.col("side"), F.col("threshold")
    counts = flat.groupingSets([[k, side, x], [side, x]], k, side, x).agg(F.grouping("_k").alias("whole"), F.sum("label").cast("long").alias("p"), F.sum(1 - F.col("label")).cast("long").alias("n"))
    named = counts.select(F.when(F.col("whole") == 1, "overall").otherwise("topic").alias("scope"), F.when(F.col("whole") == 1, "all").otherwise(k).alias("_k"), "side", "threshold", "p", "n")
    c = classification.points(named, ["scope", "_k", "side"])
    tp, fp, pos = F.col("tp"), F.col("fp"), F.col("pos")
    p, n = tp - F.col("prev_tp"), fp - F.col("prev_fp")
    precision, recall = tp / (tp + fp), F.coalesce(tp / F.nullif(pos, F.lit(0)), F.lit(0.0))
    best = F.struct(F.round(2 * tp / (tp + fp + pos), 9).alias("f1"), (-x).alias("_down"), x.alias("threshold"), F.round(precision, 9).alias("precision"), F.round(recall, 9).alias("recall"))
    half = x >= 0.5
    binned = c.groupBy("scope", "_k", "side", calibration.bin_of(x, bins).alias("bin")).agg(
        F.sum(p / F.nullif(pos, F.lit(0)) * precision).alias("area"), F.max(best).alias("best"), F.max("pos").alias("pos"), F.max("neg").alias("neg"),
        F.sum(F.when(half, p).otherwise(0)).alias("hit"), F.sum(F.when(half, n).otherwise(0)).alias("false"),
        F.sum(p + n).alias("rows"), F.abs(F.sum(p) - F.sum(x * (p + n))).alias("gap"),
    )
    of = lambda name, value: F.when(F.col("side") == name, F.col(value))
    area = lambda name: F.round(F.sum(of(name, "area")), 9)
    error = lambda name: F.round(F.sum(of(name, "gap")) / F.sum(of(name, "rows")), 9)
    one = binned.groupBy("scope", "_k").agg(
        F.max(F.col("pos") + F.col("neg")).alias("n"), F.max("pos").alias("n_pos"), area("raw").alias("auprc"), area("cal").alias("auprc_cal"), F.max(of("cal", "best")).alias("best"),
        F.sum(of("cal", "hit")).alias("tp"), F.sum(of("cal", "false")).alias("fp"), error("raw").alias("ece_before"), error("cal").alias("ece_after"),
    )
    one = classification.with_prf(one.withColumns({"fn": F.col("n_pos") - F.col("tp"), "tn": F.col("n") - F.col("n_pos") - F.col("fp")}))
    both = (F.col("n_pos") > 0) & (F.col("n_pos") < F.col("n"))
    return one.select(
        "scope", F.col("_k").alias(by), "n", "n_pos", *[F.when(both, F.col(a)).alias(a) for a in ("auprc", "auprc_cal")], "best.threshold", "best.f1", F.col("best.precision").alias("precision_best"),
        F.col("best.recall").alias("recall_best"), *[F.round(m, 9).alias(f"{m}_half") for m in ("precision", "recall", "f1")], "ece_before", "ece_after",
    )


def macro_report(bundle: DataFrame) -> DataFrame:
    """One row: the number of topics of an ``evidence_bundle`` and the means of their
    figures; a mean leaves nulls out, and is null where all are."""
    names = ["auprc", "auprc_cal", "f1", "precision_best", "recall_best", "f1_half", "precision_half", "recall_half"]
    return bundle.where("scope = 'topic'").agg(F.count("*").alias("topics"), *[F.round(F.avg(c), 6).alias(c) for c in names])


def calibrated_rows(rows: DataFrame, by: str = "cid", bins: int = 10) -> DataFrame:
    """(by, temperature, ece_before, ece_after, gain_pct): a temperature a group and what it does."""
    fitted = calibration.temperatures(rows, by)
    scaled = rows.join(fitted, by).withColumn("_p", 1 / (1 + F.exp(-F.col("logit") / F.greatest("temperature", F.lit(1e-4)))))
    raw = rows.withColumn("_p", 1 / (1 + F.exp(-F.col("logit"))))
    before, after = (calibration.ece(x, [by], bins, "_p").withColumnRenamed("ece", n) for x, n in ((raw, "ece_before"), (scaled, "ece_after")))
    return fitted.join(before, by).join(after, by).select(by, "temperature", "ece_before", "ece_after", F.round(calibration.improvement(F.col("ece_before"), F.col("ece_after")), 6).alias("gain_pct"))


def temperature_spread(rows: DataFrame, by: str = "cid", fold: str = "fold") -> DataFrame:
    """(by, mean, std, folds): mean and population deviation of the temperatures fitted fold by fold."""
    key = F.concat_ws("|", F.col(by).cast("string"), F.col(fold).cast("string"))
    fitted = calibration.temperatures(rows.withColumn("_k", key), "_k", digits=4)
    return fitted.where("_k IS NOT NULL").groupBy(F.split("_k", r"\|")[0].alias(by)).agg(F.round(F.avg("temperature"), 6).alias("mean"), F.round(F.stddev_pop("temperature"), 6).alias("std"), F.count("*").alias("folds"))


def support_edges(scores: DataFrame, k: int = 15, label: str | None = None) -> DataFrame:
    """The k best passages of each pair by calibrated probability, with the
    attributes [logit, prob_cal, dense, 1/(1 + dense rank), 1/(1 + sparse rank)]
    and, with ``label``, whether that column is 1."""
    order = Window.partitionBy(*KEYS).orderBy(F.desc("prob_cal"), "sent_idx")
    inverse = lambda c: F.coalesce(1 / (F.col(c) + 1), F.lit(0.0))
    x = F.array(*[rounded(F.coalesce(v.cast("double"), F.lit(0.0)), 9) for v in (F.col("logit"), F.col("prob_cal"), F.col("dense"), inverse("dense_rank"), inverse("sparse_rank"))])
    return scores.withColumn("_i", F.row_number().over(order)).where(F.col("_i") <= k).select("doc_id", "sent_idx", "cid", x.alias("attrs"), *([F.coalesce((F.col(label) == 1).cast("int"), F.lit(0)).alias("label")] if label else []))


def completed_pairs(nodes: DataFrame, edges: DataFrame, topics: DataFrame) -> DataFrame:
    """(doc_id, cid): the edges of each graph (a document), and every topic for
    a document without any."""
    bare = nodes.select("doc_id").distinct().join(edges.select("doc_id"), "doc_id", "left_anti")
    return edges.select(*KEYS).distinct().unionByName(bare.crossJoin(topics.select("cid").distinct()))


def document_nodes(passages: DataFrame) -> DataFrame:
    """(doc_id, x): four ones for every document with a passage."""
    return passages.select("doc_id").distinct().withColumn("x", F.array(*[F.lit(1.0)] * 4))


def improvement_ratio(before: Column, after: Column) -> Column:
    """Relative gain; a start below 1e-8 counts as fully improved."""
    return F.when(before < 1e-8, 1.0).otherwise((before - after) / before)


def path_of(template: str, **names: str) -> str:
    """``template`` with every ${NAME} replaced."""
    for name, value in names.items():
        template = template.replace("${" + name + "}", value)
    return template
