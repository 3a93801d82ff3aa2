"""Queries over things written and read back: graph records, vectorisers and search indexes."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import graph_records, splits
from quillspark.operators.vectoriser import Vectoriser
from quillspark.plans.assembly_queries import DESCRIBED_SQL, _described
from quillspark.plans.base import documents, gold, predictions, topics, vectors, with_sql, words_sql
from quillspark.plans.retrieval_queries import DENSE, RETR
from quillspark.plans.table_queries import CUE, HEDGE, NEGATION
from quillspark.scratch import Scratch, restrict
from quillspark.sources import graphs, indexes
from quillspark.streaming.index import IncrementalIndex

Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(fn):
        Q[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def _folder(spark, name: str) -> str:
    return Scratch(spark, name).root


# --- graph records ------------------------------------------------------------

# With passages p, edges s and m as tables of (doc_id, src, dst, a, y) and truth yes (doc_id, dst).
RECORD = """ n AS (SELECT doc_id, count(*)::INT AS n_passages, list(sent_idx ORDER BY sent_idx) AS sent_idx, list(x ORDER BY sent_idx) AS x FROM p GROUP BY doc_id),
 sup AS (SELECT doc_id, list(src ORDER BY dst, src) AS src, list(dst ORDER BY dst, src) AS dst, flatten(list(a ORDER BY dst, src)) AS a, list(y ORDER BY dst, src) AS y FROM s GROUP BY doc_id),
 mat AS (SELECT doc_id, list(dst ORDER BY dst) AS dst, flatten(list(a ORDER BY dst)) AS a, list(y ORDER BY dst) AS y FROM m GROUP BY doc_id),
 yl AS (SELECT n.doc_id, list((yes.dst IS NOT NULL)::INT ORDER BY t.node) AS y FROM n CROSS JOIN t LEFT JOIN yes ON yes.doc_id = n.doc_id AND yes.dst = t.node GROUP BY n.doc_id)
 SELECT doc_id, n_passages, (SELECT count(*) FROM t)::INT AS n_topics, sent_idx, x AS passage_x, yl.y AS topic_y, range(0, n_passages - 1)::INT[] AS next_src, range(1, n_passages)::INT[] AS next_dst, range(0, n_passages)::INT[] AS contains_dst,
  coalesce(sup.src, []::INT[]) AS supports_src, coalesce(sup.dst, []::INT[]) AS supports_dst, coalesce(sup.a, []::DOUBLE[]) AS supports_attrs, coalesce(sup.y, []::INT[]) AS supports_label,
  coalesce(mat.dst, []::INT[]) AS matches_dst, coalesce(mat.a, []::DOUBLE[]) AS matches_attrs, coalesce(mat.y, []::INT[]) AS matches_label
 FROM n JOIN yl USING (doc_id) LEFT JOIN sup USING (doc_id) LEFT JOIN mat USING (doc_id)"""


def _flat(records):
    """The nested arrays as columns."""
    c = F.col
    return records.select(
        "doc_id", "n_passages", "n_topics", c("passage.sent_idx").alias("sent_idx"), F.transform("passage.x", lambda x: x[0]).alias("passage_x"), c("topic.y").alias("topic_y"),
        c("next.src").alias("next_src"), c("next.dst").alias("next_dst"), c("contains.dst").alias("contains_dst"),
        c("supports.src").alias("supports_src"), c("supports.dst").alias("supports_dst"), F.flatten("supports.attrs").alias("supports_attrs"), c("supports.label").alias("supports_label"),
        c("matches.dst").alias("matches_dst"), F.flatten("matches.attrs").alias("matches_attrs"), c("matches.label").alias("matches_label"),
    )


def _read_back(spark, records, k=None):
    """Written, and read again."""
    folder = _folder(spark, "graphs")
    graphs.write_graph_records(records, folder, shards=8, k=k)
    return _flat(graphs.read_graph_records(spark, folder))


@query(
    with_sql("passages", "topics", "gold")
    + f""", t AS (SELECT cid, (row_number() OVER (ORDER BY cid) - 1)::INT AS node FROM topics),
 p AS (SELECT doc_id, sent_idx, (row_number() OVER (PARTITION BY doc_id ORDER BY sent_idx) - 1)::INT AS node, length(sent)::DOUBLE AS x FROM passages),
 g AS (SELECT DISTINCT doc_id, sent_idx, cid, round((sent_idx % 10)::DOUBLE / 2 - 2, 6) AS logit, round(1 / (1 + exp(-((sent_idx % 10)::DOUBLE / 2 - 2))), 6) AS prob FROM gold),
 f AS (SELECT doc_id, sent_idx, ({CUE.format(c=NEGATION)} > 0)::INT::DOUBLE AS neg, ({CUE.format(c=HEDGE)} > 0)::INT::DOUBLE AS hedge,
  coalesce(try_cast(nullif(regexp_extract(lower(sent), '(\\d+)\\s*(day|week|month)s?', 1), '') AS BIGINT) * CASE regexp_extract(lower(sent), '(\\d+)\\s*(day|week|month)s?', 2) WHEN 'day' THEN 1 WHEN 'week' THEN 7 WHEN 'month' THEN 30 END, 0)::DOUBLE AS days,
  round(CASE WHEN count(*) OVER w > 1 THEN sent_idx::DOUBLE / (count(*) OVER w - 1) ELSE 0 END, 6) AS place FROM passages WINDOW w AS (PARTITION BY doc_id)),
 s AS (SELECT g.doc_id, p.node AS src, t.node AS dst, [logit, prob, neg, hedge, days, place] AS a, (prob >= 0.5)::INT AS y FROM g JOIN f USING (doc_id, sent_idx) JOIN p USING (doc_id, sent_idx) JOIN t USING (cid)),
 m AS (SELECT doc_id, node AS dst, [max(logit), max(prob)] AS a, (max(prob) >= 0.5)::INT AS y FROM g JOIN t USING (cid) GROUP BY doc_id, node),
 yes AS (SELECT doc_id, dst FROM m WHERE y = 1),"""
    + RECORD
)
def graph_records_scored(spark, sf):
    """A record a document, labelled by probabilities; gold passages stand for
    scored pairs, and a document's best passage for its score."""
    logit = F.round((F.col("sent_idx") % 10) / 2 - 2, 6)
    scores = gold(spark, sf).distinct().withColumn("logit", logit).withColumn("prob", F.round(T.sigmoid(F.col("logit")), 6))
    best = scores.groupBy("doc_id", "cid").agg(F.max("logit").alias("logit"), F.max("prob").alias("prob"))
    return _read_back(spark, graph_records.scored_graphs(T.passage_table(documents(spark, sf)), topics(spark, sf), scores, best))


@query(
    with_sql("passages", "label_rows", "pred")
    + ", "
    + DESCRIBED_SQL
    + """, t AS (SELECT cid, (row_number() OVER (ORDER BY cid) - 1)::INT AS node FROM described),
 p AS (SELECT doc_id, sent_idx, (row_number() OVER (PARTITION BY doc_id ORDER BY sent_idx) - 1)::INT AS node, length(sent)::DOUBLE AS x FROM passages),
 z AS (SELECT r.doc_id, r.cid, r.label, p.sent_idx, p.node AS src, round(r.logit + (p.x % 100) / 50 - 1, 6) AS logit, round(1 / (1 + exp(-(r.logit + (p.x % 100) / 50 - 1))), 6) AS prob_cal FROM pred r JOIN p USING (doc_id)),
 k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, cid ORDER BY prob_cal DESC, sent_idx) AS i FROM z),
 s AS (SELECT doc_id, src, node AS dst, [round(logit, 9), round(prob_cal, 9), 0.0::DOUBLE, round(1 / (sent_idx + 1)::DOUBLE, 9), 0.0::DOUBLE] AS a, (label = 1)::INT AS y FROM k JOIN t USING (cid) WHERE i <= 3),
 yes AS (SELECT DISTINCT doc_id, node AS dst FROM label_rows JOIN t USING (cid) WHERE label = 1),
 m AS (SELECT q.doc_id, t.node AS dst, [logit, prob_cal] AS a, (yes.dst IS NOT NULL)::INT AS y FROM pred q JOIN t USING (cid) LEFT JOIN yes ON yes.doc_id = q.doc_id AND yes.dst = t.node),"""
    + RECORD
)
def graph_records_retrieved(spark, sf):
    """A record a document, labelled by the truth: of each pair with a prediction,
    the three best passages, scored by the prediction and the passage's length."""
    passages, pred = T.passage_table(documents(spark, sf)), predictions(spark, sf)
    logit = F.col("logit") + (F.length("sent").cast("double") % 100) / 50 - 1
    scored = pred.select("doc_id", "cid", "label", "logit").join(passages, "doc_id").withColumns({"prob_cal": F.round(1 / (1 + F.exp(-logit)), 6), "logit": T.rounded(logit, 6)})
    scored = scored.withColumns({"dense": F.lit(None).cast("double"), "dense_rank": F.col("sent_idx"), "sparse_rank": F.lit(None).cast("int")})
    nodes = passages.select("doc_id", "sent_idx", F.array(F.length("sent").cast("double")).alias("x"))
    truth = pred.select("doc_id", "cid", "label")
    return _read_back(spark, graph_records.retrieved_graphs(nodes, _described(spark), scored, pred, truth, 3), 3)


# --- vectoriser ---------------------------------------------------------------


@query(
    with_sql("passages", "topics")
    + f""", o AS (SELECT doc_id, row_number() OVER (ORDER BY md5('7|' || doc_id), doc_id) - 1 AS pos, count(*) OVER () AS n FROM documents),
 train AS (SELECT doc_id FROM o WHERE pos < floor(n * 0.8)), one AS (
  SELECT 'fit' AS part, doc_id, sent_idx, list_filter({words_sql("sent")}, lambda x: length(x) >= 2) AS w FROM passages SEMI JOIN train USING (doc_id)
  UNION ALL SELECT 'topic', cid, 0, list_filter({words_sql("text")}, lambda x: length(x) >= 2) FROM topics
  UNION ALL SELECT 'held', doc_id, sent_idx, list_filter({words_sql("sent")}, lambda x: length(x) >= 2) FROM passages ANTI JOIN train USING (doc_id)),
 grams AS (SELECT part, doc_id, sent_idx, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM one),
 tf AS (SELECT part, doc_id, sent_idx, term, count(*) AS tf FROM grams GROUP BY ALL),
 top AS (SELECT term, count(*) AS df FROM tf WHERE part <> 'held' GROUP BY term ORDER BY sum(tf) DESC, term LIMIT 2048),
 vocab AS (SELECT term, (row_number() OVER (ORDER BY term) - 1)::INT AS idx, ln((1 + (SELECT count(*) FROM one WHERE part <> 'held'))::DOUBLE / (1 + df)) + 1 AS idf FROM top),
 x AS (SELECT doc_id, sent_idx, idx, tf * idf AS x FROM tf JOIN vocab USING (term) WHERE part = 'held'),
 u AS (SELECT doc_id, sent_idx, idx, round(x / (sqrt(sum(x * x) OVER (PARTITION BY doc_id, sent_idx)) + 1e-8), 6) AS w FROM x),
 v AS (SELECT doc_id, sent_idx, list(idx ORDER BY idx) AS idx, list(w ORDER BY idx) AS w FROM u GROUP BY ALL)
 SELECT p.doc_id, p.sent_idx, coalesce(idx, []::INT[]) AS idx, coalesce(w, []::DOUBLE[]) AS w FROM passages p ANTI JOIN train USING (doc_id) LEFT JOIN v USING (doc_id, sent_idx)"""
)
def vectorised_heldout(spark, sf):
    """Fitted on the passages of the training documents and the topics, saved, loaded,
    and applied to the passages of the other documents."""
    docs = documents(spark, sf)
    train = Scratch(spark, "train").keep(splits.ratio_split(docs, 0.8, 0.1, 7).where("split = 'train'").select("doc_id"))
    folder = _folder(spark, "vectoriser")
    # Documents are chosen before their texts are cut.
    Vectoriser.fit(T.passage_table(restrict(docs, train, "doc_id")), topics(spark, sf)).save(folder)
    held = T.passage_table(restrict(docs, train, "doc_id", "left_anti"))
    out = Vectoriser.load(spark, folder).transform(held, ["doc_id", "sent_idx"], "sent")
    return out.select("doc_id", "sent_idx", F.col("vector.idx").alias("idx"), F.transform("vector.w", lambda w: F.round(w, 6)).alias("w"))


# --- stored indexes -----------------------------------------------------------

_TOP = " SELECT doc_id, cid, sent_idx, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, cid ORDER BY score DESC, sent_idx) AS rank FROM {t}) WHERE rank <= 5"


def _lexical(spark, sf):
    folder = _folder(spark, "lexical")
    indexes.build_lexical_index(documents(spark, sf), folder)
    return indexes.open_lexical_index(spark, folder)


@query(with_sql(*RETR, "bm25") + _TOP.format(t="bm25"))
def stored_bm25_topk(spark, sf):
    """BM25 from an index on disk: its postings are not shuffled."""
    return indexes.search_bm25(_lexical(spark, sf), topics(spark, sf), 5)


@query(with_sql(*RETR, "sparse") + _TOP.format(t="sparse"))
def stored_sparse_topk(spark, sf):
    return indexes.search_sparse(_lexical(spark, sf), topics(spark, sf), 5)


@query("WITH" + DENSE + " SELECT query_id // 100 AS doc_id, query_id, vec_id, score, rank FROM r WHERE rank <= 5")
def stored_dense_topk(spark, sf):
    """Hundred vectors stand for a document's passages, as in dense_topk."""
    folder = _folder(spark, "dense")
    indexes.build_dense_index(vectors(spark, sf).withColumn("doc_id", F.expr("vec_id div 100")), folder)
    return indexes.search_dense(indexes.read_bucketed(spark, folder), indexes.read_bucketed(spark, folder), 5)


@query(with_sql(*RETR, "bm25") + _TOP.format(t="bm25"))
def incremental_bm25_topk(spark, sf):
    """BM25 from an index that three batches made: all documents, those in English
    with a text that is out of date; the English ones as they are; and once more
    the old texts, which come too late to count. The same rows as an index built anew."""
    now = documents(spark, sf).select("doc_id", F.lit(2).alias("version"), "text", "lang")
    english = now.where("lang = 'en'")
    old = english.select("doc_id", F.lit(1).alias("version"), F.concat(F.lit("Replaced words. "), F.upper("text")).alias("text"))
    index = IncrementalIndex(spark, _folder(spark, "incremental"))
    index.apply(old.unionByName(now.where("lang IS NULL OR lang <> 'en'").drop("lang")), 0)
    index.apply(english.drop("lang"), 1)
    index.apply(old, 2)
    return indexes.search_bm25(index.open(), topics(spark, sf), 5)
