"""Phrase mining, url filters and importance resampling against brute force; short texts in all chunked operators."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quillspark.llm import importance, jaccard, phrases, textbuf, url_filters

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, piece string, m long, f int, rank string"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    words = "the of And to\tin É日本 a=b x9 foo-bar z".split(" ")
    made = [" ".join(rng.choice(words) + rng.choice(["", "", "", ".", ",", "\n", "  "]) for _ in range(rng.randrange(1, 120))) for _ in range(120)]
    return [*made, *made[:30], None, "", " .,\n ", "one", "the of", "the of the of the of", "w" * 3000 + " b c", "the of and " * 400]


@pytest.fixture(scope="module")
def docs(spark, texts):
    langs = ["en", "de", None]
    return spark.createDataFrame([(i, t, langs[i % 3], "s", 1, "p", 2, 3, "r") for i, t in enumerate(texts)], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_phrases(rows, least, longest, top, inside=50):
    f, n = Counter(), Counter()
    for lang, t in rows:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower(t)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    cand = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    gone = {(p[0], *p[i : i + k]) for p, a in cand.items() for k in range(2, len(p) - 1) for i in range(1, len(p) - k + 1) if 100 * a >= inside * cand[(p[0], *p[i : i + k])]}
    out = []
    for p, a in cand.items():
        if p not in gone:
            cuts = [(1_000_000 * a * a // (f[p[: k + 1]] * f[(p[0], *p[k + 1 :])]), k, f[p[: k + 1]], f[(p[0], *p[k + 1 :])]) for k in range(1, len(p) - 1)]
            score, _, le, r = min(cuts)
            out.append((p[0], -score, -a, " ".join(p[1:]).encode(), le, r))
    ranked, seen = [], Counter()
    for lang, s, a, p, le, r in sorted(out):
        seen[lang] += 1
        if seen[lang] <= top:
            ranked.append((lang, seen[lang], p.decode(), -a, le, r, n[lang], -s))
    return ranked


@pytest.mark.parametrize(("least", "longest", "top"), [(10, 3, 2000), (3, 5, 7)])
def test_phrases(spark, docs, texts, least, longest, top):
    got = sorted(tuple(r) for r in phrases.mine_phrases(spark, docs, least=least, longest=longest, top=top).collect())
    assert got == brute_phrases([(["en", "de", "und"][i % 3], t) for i, t in enumerate(texts)], least, longest, top)


def test_phrases_of_awkward_tables(spark, empty):
    assert phrases.mine_phrases(spark, empty).count() == 0
    rows = [(None, "Hot dog hot dog", None, None, None, None, None, None, None)] * 10 + [(1, None, "en", None, None, None, None, None, None)]
    got = [tuple(r) for r in phrases.mine_phrases(spark, spark.createDataFrame(rows, SCHEMA)).collect()]
    assert got == brute_phrases([("und", r[1]) for r in rows[:10]] + [("en", None)], 10, 3, 2000) and got


def test_phrases_in_windows(spark, texts, monkeypatch):
    """Pieces longer than a window of words lose no phrase and count none twice."""
    monkeypatch.setattr(phrases, "WINDOW_WORDS", 5)
    rng = random.Random(1)
    pieces = ["".join(rng.choice("abc") + " " for _ in range(n)) for n in (1, 2, 3, 4, 5, 6, 7, 11, 40)]
    m = np.arange(1, 10)
    got = Counter()
    for t, w, _ in phrases.weighted_ngrams(pa.array(pieces), m, 3):
        got.update(dict(zip(t.to_pylist(), w.tolist(), strict=True)))
    want = Counter()
    for p, k in zip(pieces, m.tolist(), strict=True):
        w = p.split()
        for n in (1, 2, 3):
            for i in range(len(w) - n + 1):
                want[" ".join(w[i : i + n]) + " "] += k
    assert got == want


def test_a_copied_piece_is_one_row(spark):
    df = spark.createDataFrame([(i, "same words here. own " + str(i % 2), "en") for i in range(50)], "doc_id long, text string, lang string")
    assert {(r.piece, r.m) for r in phrases.distinct_pieces(df).collect()} == {("same words here ", 50), ("own 0 ", 25), ("own 1 ", 25)}


def test_large_products_are_exact(spark):
    big = 9_876_543_210_987
    rows = [("en", 1, "a", big + 5), ("en", 1, "b", big + 11), ("en", 2, "a b", big)]
    got = phrases.scored(spark.createDataFrame(rows, "lang string, words int, phrase string, f long")).collect()
    assert [(r.phrase, r.score) for r in got] == [("a b", 1_000_000 * big * big // ((big + 5) * (big + 11)))]


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def brute_url(url, lines=url_filters.PATTERNS):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        host = lower(host)
    fits = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    low, hits = lower(url), []
    for line in lines if url else []:
        body = lower(line.removeprefix("@@"))
        left = r"[a-z][a-z0-9+.-]*://([^/?#]*\.)?" if body.startswith("||") else ""
        inner = re.escape(body.lstrip("|").removesuffix("|")).replace(r"\*", ".*").replace(r"\^", r"([^a-z0-9_.%-]|\Z)")
        found = (re.match if body.startswith("|") else re.search)(left + inner + (r"\Z" if body.endswith("|") else ""), low, re.S)
        if found:
            hits.append(line)
    blocked, excepted = sorted(x for x in hits if x[:2] != "@@"), [x for x in hits if x[:2] == "@@"]
    verdict = max(fits)[2] if fits else "block" if blocked and not excepted else "allow"
    return host, path, max(fits)[1] if fits else None, verdict, blocked[0] if blocked else None


URLS = [
    "http://example.net/en/1", "https://A.Example.NET/en", "https://a.example.net/en/x?y", "http://net/", "http://net", "http://xnet/", "http://.net/", "ftp://b.org/fr/", "http://b.org/FR/", "http://b.org/fr",
    "http://example.com/de/?a=b", "http://example.com?x=/de/", "http://example.com#/de/", "http://example.com:80/de/", "no scheme", "", None, "://", "http://", "mailto:x@ads.net", "http://x/ads/1", "http://x/ADS/1",
    "http://x/pads/1", "http://docs.x/ads/", "http://x/cart", "http://x/cart/", "http://x/cart-1", "http://x/cart?y", "http://ads.x/", "http://x.ads.y/robots.txt", "http://x/robots.txt?ads.", "http://x/a.exe", "http://x/a.exe?b",
    "http://x/?sessionid=1&sessionid=2", "http://x/\nads/\n/ads/", "http://é.net/ü", "http://x/日本/login", "http://y.ads-track.com/", "http://ads-track.com", "http://x/" + "long/" * 50_000 + "ads/",
]


def test_urls(spark):
    rng = random.Random(2)
    parts = ["http://", "ads", "net", "org", "example", "com", ".", "/", "?", "#", "en", "fr", "de", "login", "^", "docs", "cart", "-", "sessionid=", "&"]
    urls = URLS + ["http://" * rng.randrange(2) + "".join(rng.choice(parts) for _ in range(rng.randrange(1, 12))) for _ in range(400)]
    rows = [(i, u, "x", "y", "z") for i, u in enumerate(urls)] + [(0, urls[0], "a", "b", "c"), (None, urls[0], None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, rule string, token string")
    got = sorted((tuple(r) for r in url_filters.filter_urls(spark, pages).collect()), key=repr)
    assert got == sorted(((i, *brute_url(u)) for i, u, *_ in rows), key=repr)
    assert url_filters.filter_urls(spark, pages.limit(0)).count() == 0


def test_url_wildcards_and_filing(spark):
    """A part of a token files no rule; the rarest token does."""
    lines = ["/a*b/c/", "|http://x/", "||pix*.com^", "x^y", "*track/img*"]
    rules = url_filters.patterns(spark, lines)
    tokens = {r.rule: r.tokens for r in rules.collect()}
    assert tokens == {"/a*b/c/": ["c"], "|http://x/": ["http", "x"], "||pix*.com^": ["com"], "x^y": [], "*track/img*": []}
    urls = ["http://x/c", "http://q/aXb/c/", "http://q/a/b/c/", "http://pix9.com", "http://pix9.com/", "http://a.pixel.com:1", "http://spix.com/", "https://x/"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    usable = rules.where(F.size("tokens") > 0)
    index = url_filters.rule_index(df, usable)
    assert {r.rule: r.token for r in index.collect()} == {"/a*b/c/": "c", "|http://x/": "x", "||pix*.com^": "com"}
    got = {r.url: r.blocked for r in url_filters.matches(df, index).collect()}
    assert got == {u: b for u in urls if (b := brute_url(u, lines[:3])[4])}
    with pytest.raises(PySparkException, match="without a literal token"):
        url_filters.rule_index(df, rules).collect()


def test_urls_use_no_python_worker(spark, sf):
    plan = url_filters.filter_urls(spark, spark.read.parquet(f"{sf}/pages.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|RDD", plan) and "html" not in plan


def brute_features(t):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(t))
    return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def brute_resample(rows, target):
    found = [(i, *brute_features(t)) for i, t in rows]
    source, aim = Counter(b for _, _, f in found for b in f), Counter(b for t in target for b in brute_features(t)[1])
    s, t = sum(source.values()), sum(aim.values())
    gain = [math.floor(1000 * math.log((aim[b] + 1) * (s + 10_000) / ((source[b] + 1) * (t + 10_000)))) for b in range(10_000)]
    out = []
    for i, n, f in found:
        h = int(hashlib.sha256(f"42:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] for b in f)
        out.append([i, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    best = sorted((x for x in out if x[5] >= 20), key=lambda x: (-x[3], x[0] is None, x[0] or 0, x[1]))
    for k, x in enumerate(best[: 5 * len(best) // 100]):
        x[4] = k + 1
    return sorted((tuple(x[:5]) for x in out), key=repr)


def test_resampling(spark, docs, texts, empty):
    rows = list(enumerate(texts)) + [(3, texts[3]), (None, texts[4]), (None, None)]
    extra = spark.createDataFrame([(i, t, *[None] * 7) for i, t in rows[len(texts) :]], SCHEMA)
    target = spark.createDataFrame([("the of and É日本 x9",), (None,), ("foo bar z z z",)], "text string")
    cols = ["doc_id", "n_features", "weight", "score", "rank"]
    got = importance.resample(spark, docs.unionByName(extra), target).select(cols).collect()
    want = brute_resample(rows, [r.text for r in target.collect()])
    assert sorted((tuple(r) for r in got), key=repr) == want and sum(x[4] is not None for x in want) > 4
    assert importance.resample(spark, empty, target).count() == 0
    none = importance.resample(spark, docs, target.limit(0)).select(cols).collect()
    assert sorted((tuple(r) for r in none), key=repr) == brute_resample(list(enumerate(texts)), [])


def test_crc_of_every_word_length():
    words = ["a" * n + chr(98 + n % 20) * (n % 7) for n in range(1, 130)] + ["é" * 40, "日本" * 30]
    rng = random.Random(4)
    text = " ".join(rng.choice(words) for _ in range(600))
    (_, _, first, whose, found), = importance.hashed_ngrams(pa.array([text]))
    assert sorted(found.tolist()) == sorted(brute_features(text)[1]) and first.tolist() == [0, 600] and not whose.any()


def test_matrix_rows_are_documents(spark, docs, texts):
    from quillspark.scratch import Scratch

    blocks = importance.count_matrix(docs, Scratch(spark, "t")).toArrow().to_batches()
    got = {}
    for row in (b.slice(k, 1) for b in blocks for k in range(len(b))):
        indptr, indices, counts = (x.tolist() for x in importance.csr(row, importance.BUCKETS))
        for k, i in enumerate(row.column("ids").flatten().to_pylist()):
            lo, hi = indptr[k], indptr[k + 1]
            got[i] = Counter(dict(zip(indices[lo:hi], counts[lo:hi], strict=True)))
    assert got == {i: Counter(brute_features(t)[1]) for i, t in enumerate(texts)}


def _set_size(t, size):
    w = re.findall("[^ \x09-\x0d]+", lower(t))
    return len({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} or ({tuple(w)} if w else set()))


@pytest.mark.parametrize("size", range(1, 7))
def test_every_small_word_count_in_a_chunk(size):
    """Texts of 0 to 8 words alone in a chunk, together, and after a text that fills one."""
    long = " ".join(f"w{i % 999}" for i in range(1 + textbuf.CHUNK_BYTES // 4))
    for n in range(9):
        t = " ".join(f"t{k}" for k in range(n))
        for column in ([t], [t, ""], [None, t, t], [long, t], [t, long, t, None]):
            got = [len(s) for s in jaccard.shingle_sets(pa.array(column), size)]
            assert got == [_set_size(x, size) if x != long else got[column.index(long)] for x in column]
            if long in column:
                assert got[column.index(long)] >= 990


def test_short_texts_after_long_ones_in_spark(spark, sf):
    """Every operator that cuts texts in chunks takes a short rest of one."""
    from quillspark.llm import classifier, licenses, lm, mixing, suffixes, unigram

    long = " ".join(f"w{i % 999}" for i in range(300_000))
    rows = [(0, long, "en", "s")] + [(i, " ".join("xyz"[:i]), "en", "s") for i in range(1, 4)] + [(9, "a b", "en", "s"), (10, "a b", "en", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(11)], "doc_id long, quality int, toxic int")
    groups = {r.id: r.component_id for r in jaccard.jaccard_components(spark, df, size=5, percent=80).collect()}
    assert groups == {0: 0, 1: 1, 2: 2, 3: 3, 9: 9, 10: 9}
    assert [r["size"] for r in mixing.sized(df).orderBy("doc_id").collect()] == [300_000, 1, 2, 3, 2, 2]
    assert {r.doc_id: r.n_removed for r in suffixes.remove_repeats(spark, df).collect()}[9] == 0
    for out in (classifier.quality_scores(spark, df, labels), licenses.scan_licenses(spark, df), lm.lm_scores(spark, df), unigram.encoding_digests(spark, df, unigram.Vocabulary.load())):
        assert out.count() == len(rows)
