"""Cells made document by document agree with the joins, and nothing of their size is shuffled."""

import pytest
from pyspark.sql import functions as F

from quillspark.functions.text import passage_table
from quillspark.operators import assembly, fusion, matching, retrieval, sampling, scoring

TEXTS = [
    (1, "Red fox runs. A red red dog sleeps! Blue sky? Nothing here."),
    (2, "Fox and dog. " * 30 + "Red."),
    (3, ""),
    (4, None),
    (5, "... !!! none of it."),
    (6, "Sky. Sky. Sky. Dog fox red blue."),
]
TOPICS = [(10, "red fox"), (11, "dog sleeps dog"), (12, "absent words"), (13, ""), (14, "blue sky")]
GOLD = [(1, 10, 0), (1, 14, 2), (2, 10, 30), (6, 14, 1), (6, 14, 2), (6, 99, 0)]


@pytest.fixture(scope="module")
def tables(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, text string"), spark.createDataFrame(TOPICS, "cid long, text string"), spark.createDataFrame(GOLD, "doc_id long, cid long, sent_idx int")


def rows(df):
    return sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.collect())


@pytest.fixture(params=[1 << 20, 7])
def cells(request, monkeypatch):
    """One run for all documents, and a run a document with several products each."""
    monkeypatch.setattr(matching, "CELLS", request.param)


def test_ranked_cells_agree_with_joins(tables, cells):
    docs, topics, gold = tables
    t, words = matching.topic_matrix(topics), matching.document_words(docs, gold)
    model, cosine = matching.bm25_model(words, t), matching.Cosine(t)
    bm25, sparse = retrieval.bm25(docs, topics), retrieval.sparse_cosine(docs, topics)
    order = ["doc_id", "cid", "sent_idx", "score", "rank"]
    assert rows(matching.top(words, t, model, 3)) == rows(retrieval.top_k(bm25, 3).select(order))
    assert rows(matching.top(words, t, cosine, 3)) == rows(retrieval.top_k(sparse, 3).select(order))
    assert rows(matching.top(words, t, model, 3, fill=True)) == rows(retrieval.zero_filled(bm25, docs, topics, 3))
    assert rows(matching.top_or_all(words, t, cosine, 1)) == rows(assembly.whole_document_candidates(retrieval.top_k(sparse, 1), passage_table(docs), topics))
    assert rows(matching.mined_pairs(words, t, model, 20)) == rows(sampling.mined_pairs(retrieval.top_k(bm25, 20), gold))
    assert rows(matching.hard_pool(words, t, model, 4)) == rows(sampling.hard_pool(retrieval.top_k(bm25, 4), gold, 4))
    assert rows(matching.tfidf_cosine(docs, topics, 12)) == rows(retrieval.tfidf_cosine(docs, topics, 12))


def test_fused_cells_agree_with_joins(tables, cells):
    docs, topics, gold = tables
    t, words = matching.topic_matrix(topics), matching.document_words(docs, gold)
    bm25, sparse = retrieval.bm25(docs, topics), retrieval.sparse_cosine(docs, topics)
    dense = bm25.withColumnRenamed("score", "x").join(sparse.withColumnRenamed("score", "y"), ["doc_id", "cid", "sent_idx"]).withColumn("score", F.round(F.col("x") * 0.1 + F.col("y"), 6))
    ranks = [fusion.channel_ranks(s, c, 4) for c, s in (("bm25", bm25), ("sparse", sparse), ("dense", dense))]
    long = ranks[0].unionByName(ranks[1]).unionByName(ranks[2])
    from quillspark.plans.retrieval_queries import _blend

    out = matching.fused(words, t, {"bm25": matching.bm25_model(words, t), "sparse": matching.Cosine(t)}, _blend, fusion.MODES, 4, 60, 3)
    for mode in fusion.MODES:
        wanted = fusion.rrf(fusion.in_mode(long, mode), 60, 3).select("doc_id", "cid", "sent_idx", "score", "rank")
        assert rows(out.where(F.col("mode") == mode).select(wanted.columns)) == rows(wanted)


def test_shares_agree_with_all_pairs(spark, tables, cells):
    docs, topics, _ = tables
    topics = topics.unionByName(spark.createDataFrame([(15, None)], "cid long, text string"))
    d, t = docs.select("doc_id", scoring.distinct_words(F.col("text")).alias("d")), topics.select("cid", scoring.distinct_words(F.col("text")).alias("t"))
    wanted = d.crossJoin(t).select("doc_id", "cid", F.round(scoring.share_logit(F.col("d"), F.col("t")), 6))
    key = lambda r: (r[0], r[1])
    got = [tuple(r) for r in matching.text_shares(docs, topics).collect()]
    assert sorted(got, key=key) == sorted((tuple(r) for r in wanted.collect()), key=key)
    n = {r.doc_id: r.n for r in assembly.chunk_pairs(docs, topics.limit(1), 8, 2).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    found = matching.chunk_shares(docs, topics, 8, 2).collect()
    assert len(found) == 6 * len(n) and {r.doc_id: r.n_chunks for r in found} == n
    assert all((r.prob_max is None) == (r.prob_top is None) == (r.cid == 15 or r.doc_id == 4) for r in found)


def test_first_rows_keep_gold_and_the_first(tables, cells):
    docs, topics, gold = tables
    t, words = matching.topic_matrix(topics), matching.document_words(docs, gold)
    model = matching.bm25_model(words, t)
    whole = matching.labelled_top(words, t, model, 20).collect()
    few = matching.labelled_top(words, t, model, 20, reduce=matching.first_rows(2)).collect()
    first = lambda rs: sorted(rs, key=lambda r: (-r.score, r.doc_id, r.cid, r.sent_idx))[:2]
    assert first(few) == first(whole) and sum(r.label for r in few) == sum(r.label for r in whole) > 0
    counts = {r["rank"]: (r.n, r.hits) for r in matching.rank_counts(words, t, model, 20).collect()}
    assert counts == {k: (sum(r["rank"] == k for r in whole), sum(r.label for r in whole if r["rank"] == k)) for k in {r["rank"] for r in whole}}


def test_plan_shuffles_no_cells(spark, sf):
    """The only exchange deals documents; a join of postings with topics would add more."""
    from quillspark.plans.registry import QUERIES

    for name in ("bm25_topk", "bm25_zero_fill", "pair_mining", "rrf_three_way", "hard_pool_anti", "lexical_scores", "chunk_topic_scores", "tfidf_cosine", "whole_document_fallback"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "hashpartitioning" not in plan and "Sort" not in plan, name


def test_tfidf_writes_words_once_and_no_pairs(tables, cells, monkeypatch):
    """N-grams are three times their words; on disk stand words, counts and the vocabulary."""
    docs, topics, _ = tables
    kept, keep = [], matching.Scratch.keep

    def record(self, df, *names, **more):
        kept.append(keep(self, df, *names, **more))
        return kept[-1]

    monkeypatch.setattr(matching.Scratch, "keep", record)
    got = rows(matching.tfidf_cosine(docs, topics, 500))
    lists = [df for df in kept if "array" in str(df.schema.simpleString())]
    assert len(lists) == 1 and len(kept) == 3
    words = {w for r in lists[0].collect() for p in r.words or [] for w in p}
    assert "red" in words and "a" not in words and not any(" " in w for w in words)
    assert got == rows(retrieval.tfidf_cosine(docs, topics, 500)) and got


def test_attached_candidates_agree_with_joins(tables, cells):
    docs, topics, gold = tables
    t, words = matching.topic_matrix(topics), matching.document_words(docs, gold, sents=True)
    wanted = assembly.candidate_rows(retrieval.top_k(retrieval.bm25(docs, topics), 2), passage_table(docs), topics, gold, 2)
    assert rows(matching.candidate_rows(words, t, matching.bm25_model(words, t), topics, 2).select(wanted.columns)) == rows(wanted)


def test_complement_rings_agree_with_written_rings(spark):
    ids = spark.range(1, 13).withColumnRenamed("id", "doc_id")
    positives = spark.createDataFrame([(d, c, 0) for c, ds in ((1, [1, 2, 7]), (2, range(1, 13)), (3, range(1, 12)), (4, [5])) for d in ds], "doc_id long, cid long, sent_idx int")
    limits = sampling.quotas(positives, 30)
    negatives = ids.crossJoin(positives.select("cid").distinct()).join(positives, ["doc_id", "cid"], "left_anti")
    for seed in (0, "0.1"):
        wanted = rows(sampling.cross_limits(limits, negatives, seed))
        assert wanted and rows(sampling.complement_limits(limits, positives, ids, seed)) == wanted


def test_stored_searches_make_cells_by_document(spark, tmp_path):
    """From an index, of batches too, no row a cell is grouped or sorted; documents of one id are one."""
    from quillspark.sources import indexes
    from quillspark.streaming.index import IncrementalIndex

    docs, topics = spark.createDataFrame(TEXTS, "doc_id long, text string"), spark.createDataFrame(TOPICS, "cid long, text string")
    built = indexes.build_lexical_index(docs, f"{tmp_path}/i", 3)
    index = IncrementalIndex(spark, f"{tmp_path}/b")
    index.apply(docs.withColumn("version", F.lit(1)), 0)
    for found in (built, index.open()):
        for search, scores in ((indexes.search_bm25, retrieval.bm25), (indexes.search_sparse, retrieval.sparse_cosine)):
            got = search(found, topics, 3)
            plan = got._jdf.queryExecution().executedPlan().toString()
            assert "MapInArrow" in plan and "Aggregate" not in plan and "Sort" not in plan
            assert rows(got) == rows(retrieval.top_k(scores(docs, topics), 3).select(got.columns))
    twice = indexes.build_lexical_index(spark.createDataFrame([(1, "Red fox. Dog."), (1, "Blue."), (2, "Red.")], "doc_id long, text string"), f"{tmp_path}/t", 2)
    assert rows(twice.postings.select("doc_id", "sent_idx", "term", "tf")) == [(1, 0, "blue", 1), (1, 0, "fox", 1), (1, 0, "red", 1), (1, 1, "dog", 1), (2, 0, "red", 1)]
    assert rows(twice.terms) == [("blue", 1), ("dog", 1), ("fox", 1), ("red", 2)] and twice.stats.first()["n"] == 3


def test_grams_are_counted_by_passage(spark):
    """No n-gram of a passage is a row of its own; the counts and vectors are those of all n-grams."""
    from collections import Counter

    from quillspark.functions.text import tokens
    from quillspark.operators.vectoriser import Vectoriser

    texts = ["red fox red fox red", "a fox", "", None, "dog", "red red red", "... x y"]
    p = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "doc_id long, sent_idx int, sent string")
    topics = spark.createDataFrame([(1, "red fox"), (2, None)], "cid long, text string")
    grams = [r.g or [] for t in (p.select(retrieval.ngrams(tokens(F.col("sent"))).alias("g")), topics.select(retrieval.ngrams(tokens(F.col("text"))).alias("g"))) for r in t.collect()]
    found = retrieval.vocabulary_of(p, topics, 100)
    count, df = Counter(x for g in grams for x in g), Counter(x for g in grams for x in set(g))
    assert {r.term: (r["count"], r.df) for r in found.collect()} == {x: (n, df[x]) for x, n in count.items()} != {}
    for size in (1, 2, 3, 5):  # pairs of rarer words are left out, the first terms stay
        first = sorted(count, key=lambda x: (-count[x], x))[:size]
        assert {r.term: (r["count"], r.df) for r in retrieval.vocabulary_of(p, topics, size).collect()} == {x: (count[x], df[x]) for x in first}
    model = Vectoriser.fit(p, topics, 100)
    out = model.transform(p, ["doc_id", "sent_idx"], "sent")
    idx = {r.term: r.idx for r in model.vocabulary.collect()}
    assert {r.doc_id: r.vector.idx for r in out.collect()} == {i: sorted(idx[x] for x in set(g)) for i, g in enumerate(grams[: len(texts)])}
    for made in (found, out):
        assert "Generate" not in made._jdf.queryExecution().executedPlan().toString()


def test_gold_deals_no_passage(spark, sf):
    """A common passage's rows don't meet in one task, and texts aren't sorted."""
    from quillspark.plans.base import gold

    plan = gold(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan


def test_padded_truth_by_document(spark, tables):
    """``document_passage_truth`` agrees with ``passage_truth``; the query sorts no passage."""
    from quillspark.operators import groundtruth
    from quillspark.plans.registry import QUERIES

    docs, topics, _ = tables
    notes = [(1, 0, 10, 1, "b"), (1, 0, 11, 0, "a"), (1, 6, 10, 1, "far"), (1, 6, 10, 1, "far"), (3, 1, 14, 1, "empty"), (4, 0, 10, 0, "null"), (77, 1, 11, 1, "gone")]
    ann = spark.createDataFrame(notes, "doc_id long, sent_idx int, cid long, status int, text string")
    wanted = rows(groundtruth.passage_truth(passage_table(docs), topics, ann))
    assert rows(groundtruth.document_passage_truth(docs, topics, ann)) == wanted and sum(r[-1] for r in wanted) == 4
    plan = QUERIES["gt_sentence_padded"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning(sent" not in plan and "sent_idx" in plan


def test_support_edges_of_scored_documents(spark, tables, sf):
    """With the number of passages given nothing is counted over windows; the edges are the same."""
    from quillspark.operators import graph
    from quillspark.plans.registry import QUERIES

    docs, _, gold = tables
    scores = gold.withColumns({"logit": F.lit(1.5), "prob": F.lit(0.4)})
    p = passage_table(docs)
    sized = p.join(p.groupBy("doc_id").agg(F.count("*").alias("n_passages")), "doc_id")
    key = lambda df: sorted((r.doc_id, r.sent_idx, r.cid, *r.attrs, r.label) for r in df.collect())
    assert key(graph.supports_edges(scores, sized)) == key(graph.supports_edges(scores, p)) != []
    plan = QUERIES["graph_supports_edges"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan
