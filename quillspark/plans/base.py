"""How the driver's tables stand for documents, topics, labels, scores and gold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.text import passages, tokens
from quillspark.scratch import Scratch, build_side
from quillspark.session import table


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def topics(spark: SparkSession, sf: str) -> DataFrame:
    """All benchmark items as topics."""
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("cid"), "text", F.col("item_id").cast("string").alias("name"), (F.col("item_id") % 2 == 0).alias("is_core"))


def label_rows(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, cid, label): labels unpivoted."""
    return table(spark, sf, "labels").unpivot("doc_id", ["quality", "toxic"], "cid", "label")


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, cid, label, logit, prob, prob_cal, fold): deterministic scores of all labels."""
    d = documents(spark, sf).select("doc_id", "n_chars")
    x = label_rows(spark, sf).join(d, "doc_id")
    x = x.withColumn("logit", F.round(((F.col("n_chars") * 7919 + F.col("doc_id") * 31) % 1000) / 250.0 - 2.0 + 1.2 * F.col("label"), 6))
    p = lambda t: F.round(1 / (1 + F.exp(-F.col("logit") / t)), 6)
    return x.select("doc_id", "cid", "label", "logit", p(1.0).alias("prob"), p(1.5).alias("prob_cal"), (F.col("doc_id") % 5).cast("int").alias("fold"))


def gold(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, cid, sent_idx): passages equal to a topic's passage, of four words or more.
    The few topics' passages are held in each task: no text is dealt by its passages,
    of which a common one would fill a task."""
    t = topics(spark, sf).select("cid", F.explode(passages(F.col("text"))).alias("sent")).where(F.size(tokens(F.col("sent"))) >= 4).distinct()
    cut = documents(spark, sf).select("doc_id", F.posexplode(passages(F.col("text"))).alias("sent_idx", "sent"))
    return cut.join(build_side(Scratch(spark, "topics").keep(t)), "sent").select("doc_id", "cid", "sent_idx")


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings")


_SPLIT = r"list_filter(list_transform(string_split(regexp_replace({0}, '([.!?]+)\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"
_WORDS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+')"

#: Common table expressions of the same names as the functions above.
SQL = {
    "passages": f"passages AS (SELECT doc_id, unnest(l) AS sent, (generate_subscripts(l, 1) - 1)::INT AS sent_idx FROM (SELECT doc_id, {_SPLIT.format('text')} AS l FROM documents))",
    "topics": "topics AS (SELECT item_id AS cid, text, item_id % 2 = 0 AS is_core FROM benchmark)",
    "post": f"post AS (SELECT doc_id, sent_idx, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, sent_idx, greatest(len(w), 1) AS dl, unnest(w) AS term FROM (SELECT doc_id, sent_idx, {_WORDS.format('sent')} AS w FROM passages)) GROUP BY doc_id, sent_idx, term)",
    "terms": f"terms AS (SELECT cid, term, count(*) AS qtf FROM (SELECT cid, unnest({_WORDS.format('text')}) AS term FROM topics) GROUP BY cid, term)",
    "bm25": f"""stats AS (SELECT count(*)::DOUBLE AS n, avg(greatest(len({_WORDS.format('sent')}), 1)) AS avgdl FROM passages),
 dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
 bm25 AS (SELECT doc_id, cid, sent_idx, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf::DOUBLE * 2.5 / greatest(tf::DOUBLE + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl), 1e-6) * qtf), 6) AS score
  FROM post JOIN terms USING (term) JOIN dfs USING (term), stats GROUP BY doc_id, cid, sent_idx)""",
    "sparse": """sparse AS (SELECT doc_id, cid, sent_idx, round(sum(tf / pn * qtf / qn), 6) AS score
  FROM (SELECT *, sqrt(sum(tf * tf) OVER (PARTITION BY doc_id, sent_idx)) AS pn FROM post)
  JOIN (SELECT *, sqrt(sum(qtf * qtf) OVER (PARTITION BY cid)) AS qn FROM terms) USING (term) GROUP BY doc_id, cid, sent_idx)""",
    "label_rows": "label_rows AS (SELECT doc_id, 'quality' AS cid, quality AS label FROM labels UNION ALL SELECT doc_id, 'toxic', toxic FROM labels)",
    "pred": """pred AS (SELECT doc_id, cid, label, logit, round(1 / (1 + exp(-logit)), 6) AS prob, round(1 / (1 + exp(-logit / 1.5)), 6) AS prob_cal, (doc_id % 5)::INT AS fold
  FROM (SELECT doc_id, cid, label, round(((n_chars * 7919 + doc_id * 31) % 1000)::DOUBLE / 250.0 - 2.0 + 1.2::DOUBLE * label, 6) AS logit FROM label_rows JOIN documents USING (doc_id)))""",
    "gold": f"gold AS (SELECT doc_id, cid, sent_idx FROM passages JOIN (SELECT DISTINCT cid, unnest({_SPLIT.format('text')}) AS sent FROM topics) USING (sent) WHERE len({_WORDS.format('sent')}) >= 4)",
}


def words_sql(column: str) -> str:
    return _WORDS.format(column)


def split_sql(column: str) -> str:
    return _SPLIT.format(column)


def with_sql(*names: str) -> str:
    """WITH of the named expressions."""
    return "WITH " + ",\n ".join(SQL[n] for n in names)
