"""Quality rules on documents and on their hosts, with built-in functions only.

Document rules give counts and a verdict each; failures are summed per host
(``source``), each host's failure rate is shrunk towards the corpus by a beta
prior fitted to all hosts by moments, and the verdict on the host is joined
back to its documents. The per-document figures are written once to the shared
folder, since both the sums and the join need them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.native import let, total, words_of
from quillspark.scratch import Scratch

WINDOW = 8
WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
MAX_HOST_RATE = 0.5
MAX_PRECISION = 1e6


def _covered(positions: Column) -> Column:
    """Words covered by the windows that begin at the ascending ``positions``."""
    return total(F.transform(positions, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(positions, i + 1) - p, F.lit(WINDOW)))))


def _repeated(words: Column) -> Column:
    """Words inside windows of eight words that occur twice or more.

    Windows are compared by 64-bit hashes of their words. Only a text whose
    windows are not all distinct is sorted to find which ones recur.
    """
    starts = F.when(F.size(words) >= WINDOW, F.sequence(F.lit(1), F.size(words) - (WINDOW - 1))).otherwise(F.array().cast("array<int>"))

    def of_hashes(h: Column) -> Column:
        return let(F.transform(starts, lambda i: F.xxhash64(F.slice(h, i, WINDOW))), of_windows)

    def of_windows(w: Column) -> Column:
        ordered = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))

        def again(s: Column) -> Column:
            same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
            marked = F.transform(s, lambda x, i: F.when(same(x, F.get(s, i - 1)) | same(x, F.get(s, i + 1)), x["p"]))
            return let(F.sort_array(F.filter(marked, lambda p: p.isNotNull())), _covered)

        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(let(ordered, again))

    return let(F.transform(words, lambda x: F.xxhash64(x)), of_hashes)


def document_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(id, host, counts, base_failed, failed) of every row; a null text has no words."""
    text = F.coalesce(F.col(text_col), F.lit(""))

    def counts(w: Column) -> Column:
        lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, WHITE, "")) > 0)
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.translate(text, WHITE, "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
            let(lines, lambda x: F.size(x).cast("long")).alias("n_lines"),
            _repeated(w).alias("n_repeat_words"),
        )

    found = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), let(words_of(F.col(text_col)), counts).alias("c")).select("doc_id", "host", "c.*")
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    extra = (10 * F.col("n_symbols") > F.col("word_chars")) | (10 * F.col("n_dup_lines") > 3 * F.col("n_lines"))
    return found.withColumn("base_failed", base).withColumn("failed", F.col("base_failed") | extra)


def host_verdicts(rules: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """(host, host_docs, host_rate, host_ok): rates shrunk by the fitted prior.

    With p the pooled rate and v the variance of host rates beyond chance
    (weighted by documents), the prior is Beta(p m, (1-p) m) with
    m = p(1-p)/v - 1, held between 1 and a million. A null host is a host.
    """
    hosts = rules.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("failed").cast("long")).alias("k"))
    # One row, whatever the number of hosts.
    s = hosts.agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.count("*").alias("hosts"), F.sum(F.col("k") * F.col("k") / F.col("n")).alias("q")).first()
    n, k = float(s.n or 0), float(s.k or 0)
    p = k / n if n else 0.0
    spread = (float(s.q) - k * k / n) / n - p * (1 - p) * s.hosts / n if n else 0.0
    m = min(MAX_PRECISION, max(1.0, p * (1 - p) / spread - 1)) if spread > 0 else MAX_PRECISION
    rate = F.round((F.col("k") + F.lit(p * m)) / (F.col("n") + F.lit(m)), 6)
    return hosts.select("host", F.col("n").alias("host_docs"), rate.alias("host_rate"), (rate <= max_rate).alias("host_ok"))


def host_rules(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """Every row's figures, its host's shrunk failure rate and ``kept``.

    Null or blank text: no words, so base_failed. Null id: kept as a row. Null
    host: one host of its own. Repeated rows each count. Extra columns of
    ``docs`` are ignored. Empty input: no rows. Texts of any length count whole,
    in time that grows with a text as sorting its words does.
    """
    scratch = Scratch(spark, "host-rules")
    rules = scratch.keep(document_rules(docs, id_col, text_col, host_col), "rules")
    hosts = host_verdicts(rules, max_rate).withColumnRenamed("host", "h")
    joined = rules.join(hosts, F.col("host").eqNullSafe(F.col("h")), "left")
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.col("host_ok")).alias("kept"), "host_rate")
