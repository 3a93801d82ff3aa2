"""The pipeline's stages on a small table and on awkward ones."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from quillspark.llm import pii
from quillspark.llm.classifier import quality_scores
from quillspark.llm.unigram import Vocabulary, decode

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def awkward(spark):
    text = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, text, "en", "a", 62), (2, text, "en", "a", 62), (2, text, "en", "a", 62), (3, None, None, None, None), (4, "", "en", "b", 0), (None, "call +1 202 555 0143 now", "en", "b", 24)]
    return spark.createDataFrame(rows, COLUMNS)


def test_stage_order():
    assert [n for n, _ in cp.STAGES] == ["quality_classifier", "ngram_jaccard_dedup", "pii_redaction", "source_mixing", "sentencepiece_encoding"]


def test_dedup_keeps_one_of_each_group(spark, awkward, sf):
    got = cp.deduplicate(spark, awkward, sf).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == [(False, 1), (False, 3), (False, 4), (True, 0)]


def test_redaction_changes_only_what_it_finds(spark, awkward, sf):
    got = {(r.doc_id, r.text, r.n_chars) for r in cp.redact(spark, awkward, sf).collect()}
    assert (None, "call <phone> now", 16) in got and (3, None, None) in got and (4, "", 0) in got
    assert cp.redact(spark, cp.redact(spark, awkward, sf), sf).where("text LIKE '%555%'").count() == 0


def test_stages_keep_the_columns_on_awkward_and_empty_tables(spark, awkward, sf):
    for docs in (awkward, awkward.limit(0)):
        for name, stage in cp.STAGES:
            out = stage(spark, docs, sf)
            if name != cp.STAGES[-1][0]:
                assert out.columns == cp.COLUMNS
            assert out.count() >= 0
            if docs.isEmpty():
                assert out.count() == 0


def test_stages_ignore_extra_columns_and_take_long_texts(spark, awkward, sf):
    long = " ".join(f"word{i % 1999}" for i in range(60_000)) + " mail me@ex.org"
    more = awkward.union(spark.createDataFrame([(9, long, "en", "a", len(long))], COLUMNS))
    names = ["score", "pii", "copies", "_copy", "_source", "id", "n", "grp", "piece_ids", "held_out"]
    wide = more.select("*", *[F.lit("x").alias(n) for n in names])
    for name, stage in cp.STAGES:
        plain, extra = (sorted(map(repr, stage(spark, df, sf).collect())) for df in (more, wide))
        assert plain == extra and plain
    red = {r.doc_id: r.text for r in cp.redact(spark, more, sf).collect()}
    assert red[9] == long.replace("me@ex.org", "<email>")


def test_run_carries_every_decision(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = cp.run(spark, sf)
    kept = {r.doc_id for r in out.select("doc_id").distinct().collect()}
    good = cp.classify(spark, docs, sf)
    unique = {r.doc_id for r in cp.deduplicate(spark, good, sf).select("doc_id").collect()}
    assert kept and kept <= unique
    assert out.where("n_pieces <> size(piece_ids)").count() == 0
    assert pii.find_pii(cp.redact(spark, docs, sf)).where("exists(pii, s -> s.kind = 0)").count() == 0


def test_run_against_plain_python(spark, tmp_path):
    """run()'s rows against the stages in plain Python. The network's decisions
    are taken from quality_scores, and piece ids are compared by what they
    decode to (their segmentation has its own test)."""
    rng = random.Random(12)
    docs = []
    for i in range(300):
        words = ["good", "fine", "nice", "well"] if i % 3 else ["bad", "poor", "ugly", "sad"]
        docs.append((i, " ".join(rng.choice(words) + str(rng.randrange(30)) for _ in range(rng.randrange(10, 60))) + (f" mail u{i}@ex.org now" if i % 7 == 0 else ""), "en", None if i % 10 == 9 else f"s{i % 4}"))
    for i in range(300, 340):  # exact and near copies
        words = docs[i - 200][1].split()
        words[-1] = words[-1] if i % 2 else "changed"
        docs.append((i, " ".join(words), "de", f"s{i % 4}"))
    rng.shuffle(docs)
    rows = [(d, t, lang, s, len(t)) for d, t, lang, s in docs]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d, int(d % 3 > 0), 0) for d in range(0, 300, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    table, labels = (spark.read.parquet(f"{tmp_path}/{n}.parquet") for n in ("documents", "labels"))
    good = {r.doc_id for r in quality_scores(spark, table, labels).collect() if r.score >= 0.7}
    docs = sorted(x for x in docs if x[0] in good)
    assert 100 < len(docs) < 340

    grams = {d: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for d, w in ((d, t.split()) for d, t, _, _ in docs)}
    group = {d: d for d in grams}
    for a in grams:
        for b in grams:
            if a < b and 100 * len(grams[a] & grams[b]) >= 80 * len(grams[a] | grams[b]):
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = {d: new if g == old else g for d, g in group.items()}
    docs = [x for x in docs if group[x[0]] == x[0]]
    assert len(docs) < len(grams)

    docs = [(d, re.sub(r"u[0-9]+@ex\.org", "<email>", t), lang, s) for d, t, lang, s in docs]

    size = Counter()
    for _, t, _, s in docs:
        size[s] += len(t.split())
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    capped, whole = set(), 1.5 * sum(size.values())
    while True:
        free = [s for s in names if s not in capped]
        level = (whole - sum(2 * size[s] for s in capped)) / sum(weight[s] for s in free) if free else 0.0
        more = {s for s in free if 2 * size[s] < level * weight[s]}
        if not more:
            break
        capped |= more
    want = Counter()
    for d, t, lang, s in docs:
        rate = 2.0 if s in capped else level * weight[s] / size[s]
        draw = int(hashlib.md5(f"0|{d}".encode()).hexdigest()[:13], 16) / (1 << 52)
        want[(d, lang, s, t)] += int(rate) + (draw < rate - int(rate))

    out = cp.run(spark, str(tmp_path))
    assert out.where("n_pieces <> size(piece_ids)").count() == 0
    got = Counter((r.doc_id, r.lang, r.source, r.text) for r in decode(out, Vocabulary.load()).collect())
    assert got == +want
