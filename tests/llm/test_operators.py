"""Each operator against a brute-force version and on awkward tables."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.llm import classifier, components, host_rules, jaccard, licenses, lm, mixing, pii, suffixes, unigram, voronoi
from quillspark.scratch import Scratch

WORD = re.compile("[^\x20\x09-\x0d]+")
LONG = " ".join(f"word{i % 97}" for i in range(30_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, size string, id string, n int, rate string"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = [" ".join(rng.choice("ab cd ef gh the of and to in".split()) + str(rng.randrange(40)) for _ in range(rng.randrange(1, 90))) for _ in range(40)]
    near = []
    for t in base[:15]:
        w = t.split()
        w[rng.randrange(len(w))] = "changed"
        near.append(" ".join(w))
    odd = [None, "", " \n\t ", "one", "two words", "one two three", LONG, LONG + " tail", "É ü ß 日本語 😀 É ü ß", "a b c d\na b c d\n\nx", "x" * 5000, "card 4111 1111 1111 1111 call +1 (202) 555-0143 or a.b@c.d.e 10.0.0.256 10.0.0.255"]
    return base + near + base[:5] + odd


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", None if i % 11 == 0 else f"s{i % 3}", 1, "k", "s", "i", 7, "r") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def odd(spark):
    """Repeated rows and null ids, and nulls in every column."""
    rows = [(1, "same text here twice", None, None, None, None, None, None, None, None)] * 2 + [(None, "same text here twice", "en", "s", 1, "k", "s", "i", 1, "r"), (None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(500, i) for i in range(501, 600)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


def test_host_rules(spark, docs, texts, odd, empty):
    got = {r.doc_id: r for r in host_rules.host_rules(spark, docs).collect()}
    for i, t in enumerate(texts):
        w = WORD.findall(t or "")
        seen = Counter(tuple(w[j : j + 8]) for j in range(len(w) - 7))
        inside = {p for j in range(len(w) - 7) if seen[tuple(w[j : j + 8])] > 1 for p in range(j, j + 8)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(map(len, w)), len(inside))
        assert (r.n_symbols, r.n_dup_lines) == (sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)))
        assert r.base_failed == (len(w) < 20 or 100 * len(inside) > 30 * len(w))
        assert r.base_failed or r.kept == (r.host_rate <= host_rules.MAX_HOST_RATE)
        assert not (r.base_failed and r.kept)
    assert host_rules.host_rules(spark, odd).count() == 4 and host_rules.host_rules(spark, empty).count() == 0


def test_bad_host_loses_its_good_documents(spark):
    good = " ".join(f"w{i}" for i in range(50))
    rows = [(i, good if i % 10 == 0 else "bad", "spam") for i in range(100)] + [(100 + i, good, f"fine{i % 4}") for i in range(400)]
    got = host_rules.host_rules(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert got.where("doc_id < 100 AND kept").count() == 0 and got.where("doc_id >= 100 AND kept").count() == 400


def test_classifier_learns_and_holds_out(spark, odd, empty):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["good", "fine", "nice", "well"] if i % 3 else ["bad", "poor", "ugly", "sad"]) + str(rng.randrange(5)) for _ in range(40))) for i in range(600)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(600)], "doc_id long, quality int")
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, score string")
    got = classifier.quality_scores(spark, docs, labels).collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([r.predicted == (r.doc_id % 3 > 0) for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    again = {r.doc_id: r.score for r in classifier.quality_scores(spark, docs.repartition(5), labels).collect()}
    assert all(again[r.doc_id] == pytest.approx(r.score, abs=1e-9) for r in got)
    assert all(r.score is not None for r in classifier.quality_scores(spark, odd, labels).collect())
    assert classifier.quality_scores(spark, empty, labels.limit(0)).count() == 0
    assert classifier.quality_scores(spark, odd, labels.limit(0)).count() == 4


def _word_codes(w):
    """What the classifier makes of a word: bucket, places and signs of its index vector."""
    raw = np.frombuffer(lower(w).encode(), np.uint8)
    first, bucket, place, sign, _ = classifier._word_parts(raw, np.array([0, len(raw)]))
    assert first.tolist() == [0, 1]
    return int(bucket[0]), list(zip(place[0].tolist(), sign[0].tolist()))


AWKWARD = ["Some words repeat, some WORDS do not 12", "", None, "one", "a a a b", "Tab\tand\n\nline É é!", "x " * 300]


def test_context_vectors_in_plain_loops(spark, monkeypatch):
    monkeypatch.setattr(classifier.tb, "CHUNK_BYTES", 64)  # texts on both sides of a chunk's edge
    df = spark.createDataFrame([(t,) for t in AWKWARD * 2], "text string").repartition(2)
    want = np.zeros((classifier.BUCKETS, classifier.DIM))
    for t in AWKWARD * 2:
        codes = [_word_codes(w) for w in WORD.findall(t or "")]
        for a, b in [*zip(codes, codes[1:]), *zip(codes[1:], codes)]:
            for place, sign in b[1]:
                want[a[0], place] += sign
    want /= np.maximum(1e-6, np.sqrt((want**2).sum(1, keepdims=True)))
    assert classifier.context_vectors(df) == pytest.approx(want, abs=1e-6)


def test_features_in_plain_loops():
    rng = np.random.default_rng(0)
    contexts = rng.normal(0, 1, (classifier.BUCKETS, classifier.DIM)).astype(np.float32)
    got = classifier.features(pa.array(AWKWARD), contexts)
    for t, x in zip(AWKWARD, got):
        raw = (t or "").encode()
        words = WORD.findall(t or "")
        pooled, index, n = np.zeros(classifier.DIM), np.zeros(classifier.DIM), max(1, len(words))
        for w in words:
            bucket, parts = _word_codes(w)
            pooled += contexts[bucket]
            for place, sign in parts:
                index[place] += sign
        pooled, index, low = pooled / n, index / n, [lower(w) for w in words]
        kinds = [sum(65 <= c <= 90 for c in raw), sum(48 <= c <= 57 for c in raw), sum(33 <= c < 127 and not chr(c).isalnum() for c in raw), raw.count(b"\n")]
        rest = [np.sqrt((pooled**2).sum()), np.sqrt((index**2).sum()), math.log1p(len(words)), max(1, len(raw)) / n / 8, len(set(low)) / n, sum(a == b for a, b in zip(low, low[1:])) / n, *(k / max(1, len(raw)) for k in kinds)]
        assert x == pytest.approx([*pooled, *index, *rest], abs=1e-4)
    cut = [classifier.features(pa.array([t], pa.string()), contexts)[0] for t in AWKWARD]
    assert np.abs(got - np.array(cut)).max() < 1e-6


def test_network_gradient_and_temperature():
    rng = np.random.default_rng(1)
    z, y, w = rng.normal(0, 1, (20, 5)), rng.integers(0, 2, 20).astype(float), rng.random(20) + 0.1
    p = [rng.normal(0, 0.5, s) for s in ((5, 4), (4,), (4,), (1,))]

    def loss():
        logit = np.tanh(z @ p[0] + p[1]) @ p[2] + p[3]
        return float((w * np.logaddexp(0, np.where(y == 1, -logit, logit))).sum() / w.sum() + 5e-5 * (p[0] ** 2).sum())

    for k, g in enumerate(classifier.Network.gradients(p, z, y, w)):
        for at in np.ndindex(p[k].shape):
            keep, p[k][at] = p[k][at], p[k][at] + 1e-5
            up = loss()
            p[k][at] = keep - 1e-5
            down, p[k][at] = loss(), keep
            assert g[at] == pytest.approx((up - down) / 2e-5, abs=1e-7)
    # Labels drawn from known probabilities: the temperature minimises the held-out loss on its grid.
    x = rng.normal(0, 1, (3000, 3))
    y = (rng.random(3000) < 1 / (1 + np.exp(-1.5 * x[:, 0]))).astype(float)
    net = classifier.Network().fit(x, y, np.ones(3000), np.arange(3000) % 3 == 0, epochs=10)
    held, sign = net.logits(x[::3]), np.where(y[::3] == 1, -1, 1)
    losses = {t: np.logaddexp(0, sign * held / t).sum() for t in np.exp(np.linspace(-1.5, 2.5, 161))}
    assert net.temperature == min(losses, key=losses.get)
    prob = net.predict(x[1::3])
    for lo in np.arange(0.1, 0.9, 0.2):  # calibrated: shares of label 1 near the probabilities
        some = (prob >= lo) & (prob < lo + 0.2)
        assert some.sum() < 30 or abs(y[1::3][some].mean() - prob[some].mean()) < 0.12


def test_voronoi(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 1, (5, 8))
    v = [(i, (centres[i % 5] + rng.normal(0, 0.1, 8)).astype("float32").tolist(), "x") for i in range(400)]
    v += [(400 + i, v[7][1], "copy") for i in range(30)]
    v += [(430, None, "x"), (431, [1.0, None] + [0.0] * 6, "x"), (432, [float("nan")] * 8, "x"), (433, [float("inf")] * 8, "x"), (450, [1.0, 2.0], "x"), (451, [2.0, 1.0], "x"), (None, [0.0] * 8, "x"), (500, [300.0] * 8, "x"), (7, v[7][1], "again")]
    df = spark.createDataFrame(v, "vec_id long, embedding array<float>, score string").repartition(4)
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in voronoi.top_k(spark, df, every=10, pivots=12).collect()}
    ok = {i: [math.floor(256 * float(x)) for x in e] for i, e, _ in v if i is not None and e and all(x is not None and math.isfinite(x) for x in e)}
    want = {}
    for q in ok:
        if q % 10 == 0:
            s = sorted(((-sum(a * b for a, b in zip(ok[q], ok[c])), c) for c in ok if c != q and len(ok[c]) == len(ok[q])))[:5]
            want |= {(q, k): (c, -x) for k, (x, c) in enumerate(s, 1)}
    assert got == want
    assert voronoi.top_k(spark, df.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["clusters", "one_cell", "huge"])
def test_voronoi_many_groups_and_chunks(spark, monkeypatch, kind):
    """Many groups and chunks; all vectors but a few in one cell; products beyond doubles."""
    monkeypatch.setattr(voronoi, "GROUP", 8)
    monkeypatch.setattr(voronoi, "CHUNK", 32)
    rng = np.random.default_rng(5)
    x = rng.normal(0, 0.05, (300, 4)) + rng.normal(0, 8, (12, 4))[np.arange(300) % 12]
    if kind == "one_cell":
        x = np.concatenate([rng.normal(0, 1e-2, (280, 4)) + 3, rng.normal(0, 50, (20, 4))])
    if kind == "huge":
        x[::7] *= 1e160
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    q = [[math.floor(256 * a) for a in r] for r in x.tolist()]
    want = {}
    for i in range(0, 300, 3):
        s = sorted((-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(q[i], q[j])))), j) for j in range(300) if j != i)[:5]
        want |= {(i, n): (j, -v) for n, (v, j) in enumerate(s, 1)}
    for pivots in (None, 3, 40):
        got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in voronoi.top_k(spark, df, every=3, pivots=pivots).collect()}
        assert got == want


def test_mixing(spark, docs, texts, odd, empty):
    scratch = Scratch(spark, "t")
    sizes = scratch.keep(mixing.sized(docs))
    targets = {r.source: r for r in mixing.source_targets(spark, sizes, scratch).collect()}
    want = defaultdict(int)
    for i, t in enumerate(texts):
        want[None if i % 11 == 0 else f"s{i % 3}"] += len(WORD.findall(t or ""))
    assert {k: r.source_size for k, r in targets.items()} == want
    weight = dict(zip(["s0", "s1", "s2", None], [3, 1, 2, 3]))
    level, capped, whole = None, set(), 1.5 * sum(want.values())
    while True:
        rest = whole - sum(2 * want[s] for s in capped)
        level = rest / sum(weight[s] for s in want if s not in capped)
        more = {s for s in want if s not in capped and 2 * want[s] < level * weight[s]}
        if not more:
            break
        capped |= more
    for s, r in targets.items():
        assert r.target == pytest.approx(2 * want[s] if s in capped else level * weight[s]) and r.target <= 2 * want[s] + 1e-6
    mixed = mixing.with_copies(docs, mixing.source_targets(spark, sizes, scratch))
    a = sorted((r.doc_id, r.copies) for r in mixed.collect())
    assert a == sorted((r.doc_id, r.copies) for r in mixing.with_copies(docs.repartition(5), mixing.source_targets(spark, sizes, scratch)).collect())
    assert all(0 <= c <= 2 for _, c in a)
    assert mixing.emit_copies(mixed).count() == sum(c for _, c in a)
    for df in (odd, empty):
        s = scratch.keep(mixing.sized(df))
        assert mixing.with_copies(df, mixing.source_targets(spark, s, scratch)).count() == df.count()


def test_mixing_comes_near_its_targets(spark):
    rows = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), (F.col("id") % 3)).alias("source"), F.lit("a b c d").alias("text"))
    scratch = Scratch(spark, "t")
    mixed = mixing.with_copies(rows, mixing.source_targets(spark, scratch.keep(mixing.sized(rows)), scratch))
    for r in mixed.groupBy("source").agg(F.sum(F.col("copies") * 4).alias("taken"), F.first("target").alias("target")).collect():
        assert abs(r.taken / r.target - 1) < 0.06


def brute_spans(rows):
    first, out = {}, {}
    for d, t in sorted(rows):
        for p in range(len(t) - 49):
            first.setdefault(t[p : p + 50], d)
    for d, t in rows:
        keep = bytearray(b"\1" * len(t))
        for p in range(len(t) - 49):
            if first[t[p : p + 50]] < d:
                keep[p : p + 50] = b"\0" * 50
        kept = bytes(b for b, k in zip(t, keep) if k)
        out[d] = (len(t), len(t) - len(kept), len(re.findall(b"\0+", bytes(keep))), hashlib.sha256(kept).hexdigest())
    return out


def test_suffixes(spark, odd, empty):
    rng = random.Random(4)
    texts = []
    for i in range(70):
        t = "".join(rng.choice("ab é") for _ in range(rng.randrange(0, 260)))
        if i % 4 == 0:
            t = "a" * rng.randrange(40, 160) + t
        if i % 3 == 0 and texts:
            t += rng.choice(texts)[rng.randrange(20) :]
        texts.append(t)
    texts += ["", "x" * 49, "x" * 50, "x" * 51, texts[3] + texts[5]]
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)] + [(900, None, "k")], "doc_id long, text string, key string").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.remove_repeats(spark, df).collect()}
    assert got == brute_spans([(i, t.encode()) for i, t in enumerate(texts)] + [(900, b"")])
    assert sum(r.n_removed for r in suffixes.remove_repeats(spark, odd).collect()) == 0
    assert suffixes.remove_repeats(spark, empty).count() == 0


def test_suffixes_joined_by_key(spark, monkeypatch):
    """The path for large span tables, small buckets and short fragments; texts over a chunk's edge."""
    monkeypatch.setattr(suffixes, "SMALL", -1)
    monkeypatch.setattr(suffixes, "BUCKET_BYTES", 4000)
    monkeypatch.setattr(suffixes, "FRAGMENT", 16)
    rng = random.Random(14)
    word = lambda: "".join(rng.choice("abcde") for _ in range(6))
    passages = [" ".join(word() for _ in range(20)) for _ in range(6)]
    texts = [" ".join([word() for _ in range(rng.randrange(30))] + [rng.choice(passages)] + [word() for _ in range(rng.randrange(30))]) for _ in range(60)]
    texts += texts[:10] + ["y" * 300, "y" * 300, "y" * 120, "z" * 49, "z" * 49]
    rng.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.remove_repeats(spark, df).collect()}
    assert got == brute_spans([(i, t.encode()) for i, t in enumerate(texts)])


def _suffix_order(raw, depth=None):
    n = len(raw)
    at = np.arange(n)
    ends = np.minimum(n, at + depth) if depth else np.full(n, n)
    order, equal = suffixes.HashedSuffixes(np.frombuffer(raw, np.uint8), at, ends).order()
    want = sorted(range(n), key=lambda i: raw[i : ends[i]])
    assert order.tolist() == want
    assert equal.tolist() == [k > 0 and raw[want[k] : ends[want[k]]] == raw[want[k - 1] : ends[want[k - 1]]] for k in range(n)]


def test_suffix_order():
    rng = random.Random(15)
    for s in (b"banana bandana", b"aaaaaaa", b"", b"x", b"mississippi" * 30, b"\0\0a\0\0", b"a\0" * 40):
        _suffix_order(s)
        _suffix_order(s, 5)
    for _ in range(30):
        raw = bytes(rng.choice(b"ab\xff") for _ in range(rng.randrange(400))) * rng.randrange(1, 4)
        _suffix_order(raw)
        _suffix_order(raw, rng.randrange(1, 60))


def test_only_suffixes_that_others_hold_are_sorted(monkeypatch):
    """Fragments of one minimiser, most of which differ, and one hot string in many texts."""
    sizes, order = [], suffixes.HashedSuffixes.order
    monkeypatch.setattr(suffixes.HashedSuffixes, "order", lambda self: sizes.append(len(self.at)) or order(self))
    monkeypatch.setattr(suffixes, "WINDOWS", 400)
    rng = random.Random(33)
    hot, others = "".join(rng.choice("abcdef") for _ in range(90)), [rng.choice("abcdef") for _ in range(1 << 16)]
    texts = ["".join(rng.choices(others, k=40)) + (hot if i % 2 else hot[:16]) + "".join(rng.choices(others, k=60)) for i in range(200)]
    raw = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    own, count = np.arange(200) // 2 * 7, np.array([len(t) - 49 for t in raw])
    found = np.zeros((200, count.max()), bool)
    for f, lo, hi in zip(*suffixes._hit_runs(np.concatenate(raw), own, count), strict=True):
        found[f, lo:hi] = True
    least = {}
    for t, d in zip(texts, own.tolist(), strict=True):
        for p in range(len(t) - 49):
            least.setdefault(t[p : p + 50], d)
    want = [[p < n and least[t[p : p + 50]] < d for p in range(count.max())] for t, d, n in zip(texts, own.tolist(), count, strict=True)]
    assert found.tolist() == want
    twins = sum(map(sum, want))
    assert twins <= sum(sizes) < 1.5 * twins < 0.6 * count.sum()
    assert len(sizes) > 5 and max(sizes) < 3 * 400


def test_a_very_common_string_takes_bounded_memory(monkeypatch):
    """One minimiser in hundreds of texts: never more than some windows' bytes are hashed at once."""
    rng = random.Random(44)
    others, hot = "abcdefgh", "".join(rng.choice("xyz") for _ in range(60))
    texts = [("".join(rng.choices(others, k=30)) if i % 3 else "=" * 30) + hot + "".join(rng.choices(others, k=rng.randrange(20))) for i in range(600)]
    raw = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    own, count = np.arange(600)[::-1] // 2, np.array([len(t) - 49 for t in raw])
    whole = list(zip(*suffixes._hit_runs(np.concatenate(raw), own, count), strict=True))
    seen, init = [], suffixes.HashedSuffixes.__init__
    monkeypatch.setattr(suffixes.HashedSuffixes, "__init__", lambda self, data, *a: seen.append(len(data)) or init(self, data, *a))
    monkeypatch.setattr(suffixes, "WINDOWS", 500)
    found = list(zip(*suffixes._hit_runs(np.concatenate(raw), own, count), strict=True))
    assert sorted(found) == sorted(whole) and len(whole) > 500
    assert max(seen) <= 500 * suffixes.WINDOW_BYTES < sum(map(len, raw)) / 10
    # A hash that all windows share changes nothing.
    monkeypatch.setattr(suffixes.HashedSuffixes, "hashes", lambda self: np.full(len(self.at), 7, np.uint64))
    assert sorted(zip(*suffixes._hit_runs(np.concatenate(raw[:90]), own[:90], count[:90]), strict=True)) == sorted(_brute_runs(texts[:90], own[:90]))


def _brute_runs(texts, own):
    least = {}
    for t, d in zip(texts, own.tolist(), strict=True):
        for p in range(len(t) - 49):
            least[t[p : p + 50]] = min(d, least.get(t[p : p + 50], d))
    for i, (t, d) in enumerate(zip(texts, own.tolist(), strict=True)):
        hit = "".join("x" if least[t[p : p + 50]] < d else " " for p in range(len(t) - 49))
        yield from ((i, m.start(), m.end()) for m in re.finditer("x+", hit))


def test_blobs_are_deleted_and_texts_unsorted(spark, monkeypatch):
    """The suffixes' blobs are gone before texts are shuffled for a large span table."""
    monkeypatch.setattr(suffixes, "SMALL", -1)
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        found = disk.getAllBlocks()
        return {x for x in (found.apply(i).name() for i in range(found.size())) if x.startswith("shuffle_")}

    df = spark.createDataFrame([(i, "common words that stand in every text, " * 2 + str(i) * 60) for i in range(40)], "doc_id long, text string")
    rows = df.select("doc_id", F.xxhash64("doc_id").alias("key"), "text")
    kept, left = suffixes.Scratch.keep, []

    def keep(self, table, *names, **more):
        before = shuffles()
        out = kept(self, table, *names, **more)
        for _ in range(50):
            if not shuffles() - before:
                break
            time.sleep(0.1)
        left.append(shuffles() - before)
        return out

    monkeypatch.setattr(suffixes.Scratch, "keep", keep)
    assert suffixes.repeated_spans(spark, rows, suffixes.Scratch(spark, "t"), 6000).count() == 39 and left == [set()]
    plan = suffixes.remove_repeats(spark, df)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan


def test_equal_suffixes_are_merged_as_one(monkeypatch):
    """Many texts that go on in two ways behind one string, in turns."""
    merged, merge = [], suffixes.HashedSuffixes._merge
    monkeypatch.setattr(suffixes.HashedSuffixes, "_merge", lambda self, order, fresh, falls: merged.append(len(order)) or merge(self, order, fresh, falls))
    raw = b"".join(b"0123456789abcdefghijklmn" + (b"yes", b"nay")[k % 2] for k in range(500))
    at = np.arange(0, len(raw), 27)
    order, equal = suffixes.HashedSuffixes(np.frombuffer(raw, np.uint8), at, at + 27).order()
    assert order.tolist() == [*range(1, 500, 2), *range(0, 500, 2)] and (~equal).sum() == 2
    assert merged == [2]


def test_blobs_stay_few_and_heads_whole():
    """Numbers of buckets by size, and the numbers that a blob holds."""
    head = np.random.default_rng(3).integers(0, 1 << 32, (4, 77), dtype=np.uint32)
    planes = suffixes._planes(head)
    assert (suffixes._rows(np.frombuffer(planes.tobytes(), np.uint8), 4) == head).all()
    gb = 1 << 30
    assert [suffixes.bucket_count(x) for x in (0, 1, gb // 5, gb, 2 * gb, 4 * gb, 10 * gb)] == [1, 1, 103, 512, 512, 512, 1280]


def test_suffix_order_survives_a_hash_collision():
    """Thue-Morse strings of 2048 letters and their complements have one polynomial hash modulo 2**64, whatever the odd base."""
    morse = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    other = morse.translate(str.maketrans("ab", "ba"))
    raw = (morse + other).encode()
    at, ends = np.array([2048, 0]), np.array([4096, 2048])
    found = suffixes.HashedSuffixes(np.frombuffer(raw, np.uint8), at, ends)
    assert found.common(np.array([0]), np.array([2048]), np.array([2048])).tolist() == [2048]
    order, equal = found.order()
    assert order.tolist() == [1, 0] and not equal.any()


def test_sentencepiece(spark, docs, texts, odd, empty):
    pieces = [("<unk>", 0.0, "control")] + [(f"<0x{b:02X}>", 0.0, "byte") for b in range(256)]
    rng = random.Random(6)
    words = sorted({"".join(rng.choice("abcdetho▁") for _ in range(rng.randrange(1, 5))) for _ in range(300)} | {"▁", "▁▁", "é", "日本"})
    pieces += [(w, -1.0 - rng.random() * 9, "piece") for w in words]
    vocab = unigram.Vocabulary(pieces)
    table = {b: s for b, (_, s, k) in zip(vocab.bytes_of, pieces) if k == "piece" and vocab.score[vocab.bytes_of.index(b)] < 0 and b in _usable(vocab, pieces)}

    def best(t):
        t = b" " + t.encode()
        score = [0.0] + [-math.inf] * len(t)
        for i in range(len(t)):
            for n in range(1, min(12, len(t) - i) + 1):
                s = table.get(t[i : i + n], vocab.fallback if n == 1 else None)
                if s is not None:
                    score[i + n] = max(score[i + n], score[i] + s)
        return score[-1]

    coded = unigram.encode(docs, vocab)
    ids = {r.doc_id: r.piece_ids for r in coded.collect()}
    for i, t in enumerate(texts):
        if not t:
            assert ids[i] == []
        elif len(t) < 6000:
            assert sum(vocab.score[x] for x in ids[i]) == pytest.approx(best(t))
    back = {r.doc_id: r.text for r in unigram.decode(coded, vocab).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(texts))
    digests = unigram.encoding_digests(spark, docs, vocab).collect()
    assert all(r.round_trip and r.n_pieces == len(ids[r.doc_id]) for r in digests)
    assert unigram.encode(odd, vocab).count() == 4 and unigram.encode(empty, vocab).count() == 0


def _usable(vocab, pieces):
    return {vocab.bytes_of[i] for i, (w, _, k) in enumerate(pieces) if k == "piece" and "▁" not in w.lstrip("▁")}


def test_sentencepiece_exact_bytes():
    vocab = unigram.Vocabulary([(f"<0x{b:02X}>", 0.0, "byte") for b in range(256)] + [("▁a", -1.0, "piece"), ("a", -2.0, "piece")])
    odd = ["▁", " ▁ a", "a\r\n\n a", "  ", "\x00", "😀a", ""]
    ids, at = vocab.encode_column(pa.array(odd))
    raw, b = vocab.decode_flat(ids, at)
    assert [raw[b[i] : b[i + 1]].tobytes().decode() for i in range(len(odd))] == odd


def test_sentencepiece_long_texts_in_blocks(monkeypatch):
    rng = random.Random(13)
    words = ["▁", "▁▁"] + sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 6))) for _ in range(60)} | {"▁ab", "▁c"})
    vocab = unigram.Vocabulary([(f"<0x{b:02X}>", 0.0, "byte") for b in range(256)] + [(w, -1.0 - rng.random() * 9, "piece") for w in words])
    long = ["".join(rng.choice("abcd") for _ in range(n)) for n in (700, 3000, 9000)]
    texts = ["short ab", long[0], None, " ".join(long), "a b\n" * 2500 + long[2], "é" * 2000, "", " " * 900 + "\n" * 900, "ab " * 3000]
    whole, bounds = vocab.encode_column(pa.array(texts))
    monkeypatch.setattr(unigram, "CHUNK", 512)
    monkeypatch.setattr(unigram, "LONG", 128)
    monkeypatch.setattr(unigram, "NARROW", 1 << 30)
    ids, at = vocab.encode_column(pa.array(texts))
    assert at.tolist() == bounds.tolist() and ids.tolist() == whole.tolist()
    for i, t in enumerate(texts):
        raw = np.frombuffer((t or "").encode(), np.uint8)
        assert vocab.decodes_to(ids[at[i] : at[i + 1]], raw)
        assert not len(raw) or not vocab.decodes_to(ids[at[i] : at[i + 1]], raw[:-1])


def luhn(d):
    s = [int(c) for c in reversed(d)]
    return (sum(s[::2]) + sum(sum(divmod(2 * x, 10)) for x in s[1::2])) % 10 == 0


def brute_pii(t):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def test_pii(spark, docs, texts, odd, empty):
    rng = random.Random(8)
    more = ["".join(rng.choice(["a", "b.", "@", "_", "1", "23", "4", ".", "-", " ", "+", "(", "4111111111111111", "x@y.z", "1.2.3.4", "\n", "é😀"]) for _ in range(rng.randrange(60))) for _ in range(400)]
    more += ["1" * 3000, "a." * 3000 + "@", "a@" + "b." * 3000 + "c", "+1" + " 2" * 3000, "IBAN GB82 WEST 1234 5698 7654 32 ok", "ssn 123-45-6789", "nothing 123-45-6789"]
    rows = [(i, t) for i, t in enumerate(texts + more)]
    got = {r.doc_id: r.pii for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        assert [(s.start, s.kind, s.end) for s in got[i] if s.kind < pii.BASE] == brute_pii(t or ""), t
    extra = [[pii.KINDS[s.kind] for s in got[len(rows) - k]] for k in (3, 2, 1)]
    assert extra == [["iban"], ["ssn"], []]
    red = spark.createDataFrame([("mail a@b.c or 10.0.0.1 x",)], "text string")
    assert pii.find_pii(red).select(pii.redacted(F.col("text"), F.col("pii")).alias("t")).first().t == "mail <email> or <ip> x"
    assert pii.find_pii(odd).count() == 4 and pii.find_pii(empty).count() == 0


def test_licenses(spark, docs, odd, empty):
    def grams(t):
        w = re.findall("[a-z0-9]+", t.lower())
        return set(zip(w, w[1:]))

    lines = ["Licensed under the Apache License, Version 2.0.", "Released under the MIT License", "released under the mit licence.", "Nothing to see here at all", dict(licenses.TEMPLATES)["BSD-2-Clause"]]
    rows = [(i, f"Some text.\n{x}\nmore text here") for i, x in enumerate(lines)] + [(10, lines[0] + "\n\n" + lines[1])]
    got = {r.doc_id: r for r in licenses.scan_licenses(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, x in enumerate(lines):
        best = max((2 * len(grams(x) & grams(t)) / (len(grams(x)) + len(grams(t))), n) for n, t in licenses.TEMPLATES)
        assert got[i].license_id == (best[1] if best[0] >= licenses.THRESHOLD else None)
        assert best[0] < licenses.THRESHOLD or got[i].dice == pytest.approx(best[0])
    assert got[10].licenses == "Apache-2.0,MIT"
    assert licenses.scan_licenses(spark, docs).where("license_id IS NOT NULL").count() == 0
    assert licenses.scan_licenses(spark, odd).count() == 4 and licenses.scan_licenses(spark, empty).count() == 0


def test_lm(spark, docs, texts, odd, empty):
    got = {r.doc_id: r for r in lm.lm_scores(spark, docs).collect()}
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    c = Counter()
    for i, t in enumerate(texts):
        if fold(i) != 1:
            c.update(WORD.findall(lower(t or "")))
            c[None] += 1
    n, v = sum(c.values()), len(c)
    for i, t in enumerate(texts):
        toks = WORD.findall(lower(t or "")) + [None]
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (fold(i) == 1, len(toks), sum(c[x] > 0 for x in toks), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in toks))
        assert math.isfinite(r.score) and r.score < 0
    rows = lm.lm_scores(spark, odd).collect()
    assert len(rows) == 4 and len({r.score for r in rows if r.n_tokens == 5}) == 1
    assert lm.lm_scores(spark, empty).count() == 0


def test_lm_counts_words_outside_the_tables(spark, docs, texts, monkeypatch):
    """Words beyond the shortlist and the counted words meet in buckets; the scores are the same."""
    want = {r.doc_id: r for r in lm.lm_scores(spark, docs).collect()}
    monkeypatch.setattr(lm, "shortlist_size", lambda types: 30)
    small = {r.doc_id: r for r in lm.lm_scores(spark, docs).collect()}
    monkeypatch.setattr(lm, "COUNTED", 60)
    monkeypatch.setattr(lm, "BLOB_BYTES", 2000)
    got = {r.doc_id: r for r in lm.lm_scores(spark, docs).collect()}
    for i in want:
        assert (got[i].n_known, got[i].n_tokens) == (small[i].n_known, small[i].n_tokens) == (want[i].n_known, want[i].n_tokens)
        assert got[i].base_score == pytest.approx(want[i].base_score) == small[i].base_score
        assert got[i].score == pytest.approx(small[i].score, rel=1e-6)


def _plain_score(model, ids):
    """The model's log-probability of one text, word by word in plain loops."""
    w, k = {n: a.astype(float) for n, a in model.w.items()}, lm.HIDDEN
    h, prev, total = [0.0] * k, lm.END, 0.0
    sig = lambda x: 1 / (1 + math.exp(-x))
    for word in ids:
        x = w["e"][prev]
        gx = [sum(x[a] * w["x"][a][b] for a in range(k)) + w["b"][b] for b in range(3 * k)]
        gh = [sum(h[a] * w["u"][a][b] for a in range(k)) for b in range(3 * k)]
        z, r = [sig(gx[b] + gh[b]) for b in range(k)], [sig(gx[k + b] + gh[k + b]) for b in range(k)]
        n = [math.tanh(gx[2 * k + b] + r[b] * gh[2 * k + b]) for b in range(k)]
        h = [(1 - z[b]) * n[b] + z[b] * h[b] for b in range(k)]
        cls = next(c for c in range(model.classes) if model.edge[c] <= word < model.edge[c + 1])
        logit = lambda row: sum(h[j] * row[j] for j in range(k)) + row[k]
        a = [logit(w["c"][c]) for c in range(model.classes)]
        b = [logit(w["o"][i]) for i in range(model.edge[cls], model.edge[cls + 1])]
        for logits, at in ((a, cls), (b, int(word) - model.edge[cls])):
            total += logits[at] - math.log(sum(math.exp(v) for v in logits))
        prev = word
    return total


def test_lm_score_in_plain_loops():
    rng = np.random.default_rng(4)
    model = lm.Gru(1000.0 / np.arange(1, 61), seed=3)
    texts = [np.append(rng.integers(1, 60, n), lm.END) for n in (0, 1, 5, 70, 33)]
    model.train(texts, steps=40)
    model.freeze()
    got = model.score(np.concatenate(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
    assert got == pytest.approx([_plain_score(model, t) for t in texts], rel=1e-4)


@pytest.mark.parametrize("small", [True, False])
def test_lm_gradient_by_finite_differences(monkeypatch, small):
    """All weights, with texts that begin inside a window and words of no weight."""
    rng = np.random.default_rng(8)
    model = lm.Gru(1000.0 / np.arange(1, 31), seed=2)
    model.w = {n: a.astype(np.float64) for n, a in model.w.items()}
    model.small = small
    prev, ids = rng.integers(0, 30, (2, 3, 5))
    begin, weight, h0 = rng.random((3, 5)) < 0.3, rng.random((3, 5)) < 0.8, rng.normal(0, 0.3, (3, lm.HIDDEN))
    grads = {}
    monkeypatch.setattr(model, "_update", lambda g, rate, step: grads.update(g))
    model._learn(prev, ids, begin, weight, h0, 0.1, 1)

    def loss():
        h, total = h0, 0.0
        for t in range(5):
            h = np.where(begin[:, t, None], 0, h)
            h, _ = model.step(model.w["e"][prev[:, t]] @ model.w["x"] + model.w["b"], h)
            total -= (model.log_probs(h, ids[:, t])[0] * weight[:, t]).sum()
        return total / weight.sum()

    for name, a in model.w.items():
        dense = np.zeros_like(a)
        for at, d in grads[name]:
            dense[at] += d
        for place in [tuple(rng.integers(0, n) for n in a.shape) for _ in range(30)] + [np.unravel_index(np.abs(dense).argmax(), a.shape)]:
            held = a[place]
            a[place] = held + 1e-5
            up = loss()
            a[place] = held - 1e-5
            slope, a[place] = (up - loss()) / 2e-5, held
            assert dense[place] == pytest.approx(slope, rel=1e-3, abs=1e-6), (name, place)


def test_a_buffer_fills_all_streams(monkeypatch):
    """A run of BUFFER words is learned in STREAMS streams, and each word once."""
    model, shapes = lm.Gru(1000.0 / np.arange(1, 41)), []
    monkeypatch.setattr(model, "_learn", lambda prev, ids, begin, weight, h, rate, step: shapes.append((len(ids), int(weight.sum()))) or h)
    assert model.learn_all([[np.full(lm.BUFFER // 8, 3)] * 8]) == lm.BUFFER
    assert {n for n, _ in shapes} == {lm.STREAMS} and sum(n for _, n in shapes) == lm.BUFFER


def test_texts_are_cut_into_words_once_for_all_sums():
    """The pass that scores also gives the words outside the tables, with their texts."""
    texts, held = ["a b zz", "zz yy a", "b", None], [False, True, False, False]
    h = {w: next(lm._hashes(pa.array([w])))[2][0] for w in ("a", "b", "yy", "zz")}
    top = np.sort(np.array([h["a"], h["b"]], np.uint64))
    model = lm.Gru(np.array([4.0, 2.0, 2.0, 2.0])).freeze()
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4]), pa.array(texts), pa.array(held)], ["doc_id", "text", "held_out"])
    run = lm._model_scores(model, top, np.array([2, 3]), np.zeros(4), np.array([True, False, True, True]), np.zeros(0, np.uint64), np.zeros(0), 1)
    sums, blob = run([batch])
    assert sums.column("n_tokens").to_pylist() == [4, 4, 2, 1] and sums.column("n_other").to_pylist() == [1, 2, 0, 0] and sums.column("bucket").null_count == 4
    found = {c: blob.column(c)[0].as_py() for c in lm.BLOB}
    keys = np.frombuffer(found["keys"], np.uint64)[np.frombuffer(found["d"], np.uint16)]
    key = sums.column("key").to_numpy().view(np.uint64)
    assert set(zip(np.frombuffer(found["h"], np.uint64), keys)) == {(h["zz"], key[0]), (h["zz"], key[1]), (h["yy"], key[1])}
    assert np.unpackbits(np.frombuffer(found["train"], np.uint8))[:2].tolist() == [1, 0] and blob.column("key").null_count == 1


def test_lm_update_is_adam_and_classes_cover_all_words():
    model = lm.Gru(np.array([5.0, 1.0, 50.0, 30.0, 10.0]))
    w, m, v = model.w["e"].astype(float), 0, 0
    for step in range(1, 4):
        d = np.random.default_rng(step).normal(0, 3, w.shape)
        model._update({"e": [(np.arange(5), d.astype(np.float32))]}, 0.1, step)
        d /= np.sqrt((d * d).sum())
        m, v = 0.9 * m + 0.1 * d, 0.99 * v + 0.01 * d * d
        w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    assert model.w["e"] == pytest.approx(w, abs=1e-4)
    for n in (2, 3, 50, 5000):
        for p in (np.full(n, 1 / n), 1 / np.arange(1, n + 1), np.array([1.0] + [1e-9] * (n - 1))):
            edge = lm.class_edges(p / p.sum())
            assert edge[0] == 0 and edge[-1] == n and (np.diff(edge) > 0).all()


def test_lm_is_a_distribution_and_learns():
    model = lm.Gru(np.array([5.0, 1.0, 50.0, 30.0, 10.0]))
    rng = np.random.default_rng(0)
    texts = [np.array([2 + (k + i) % 3 for k in range(20)] + [0]) for i in rng.integers(0, 3, 200)]
    ids, offs = np.concatenate(texts), np.arange(201) * 21
    before = model.freeze().score(ids, offs).sum()
    fresh = lm.Gru(np.array([5.0, 1.0, 50.0, 30.0, 10.0]))
    fresh.train(texts, steps=150)
    fresh.freeze()
    assert fresh.score(ids, offs).sum() > 0.5 * before
    h = rng.normal(size=(3, lm.HIDDEN)).astype("float32")
    total = sum(np.exp(fresh.log_probs(h, np.full(3, k))[0]) for k in range(5))
    assert total == pytest.approx(np.ones(3), abs=1e-4)
    one = [fresh.score(t, np.array([0, len(t)]))[0] for t in texts[:5]]
    assert fresh.score(np.concatenate(texts[:5]), np.arange(6) * 21) == pytest.approx(one, abs=1e-3)


def brute_components(rows, size, percent):
    sets = {}
    for i, t in rows:
        w = WORD.findall(lower(t or ""))
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} or ({tuple(w)} if w else set())
    parent = {i: i for i in sets}
    find = lambda x: x if parent[x] == x else find(parent[x])
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_jaccard(spark, docs, texts, odd, empty):
    got = {r.id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(spark, docs, size=4, percent=85).collect()}
    assert got == brute_components(list(enumerate(texts)), 4, 85)
    assert sorted((r.id, r.component_id) for r in jaccard.jaccard_components(spark, odd).where("id IS NOT NULL").collect()) == [(1, 1), (1, 1)]
    assert jaccard.jaccard_components(spark, odd).count() == 4 and jaccard.jaccard_components(spark, empty).count() == 0


def test_jaccard_chains_in_one_family(spark, monkeypatch):
    """Members that link only through others, in tiles smaller than the family."""
    monkeypatch.setattr(jaccard, "TILE_BYTES", 1500)
    monkeypatch.setattr(jaccard, "NEAR", 4)
    rng = random.Random(9)
    base = [f"t{i}" for i in range(60)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randrange(3)):
            w[rng.randrange(60)] = f"z{rng.randrange(9)}"
        rows.append((i, " ".join(w)))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(spark, df, size=4, percent=85).collect()}
    assert got == brute_components(rows, 4, 85)


def test_jaccard_sizes_across_bands(spark, monkeypatch):
    """A family whose sizes grow step by step, over several bands and tiles."""
    monkeypatch.setattr(jaccard, "TILE_BYTES", 2000)
    monkeypatch.setattr(jaccard, "NEAR", 6)
    rng = random.Random(10)
    long = [f"t{i}" for i in range(400)]
    rows = [(i, " ".join(long[: 40 + 5 * rng.randrange(70)])) for i in range(70)] + [(100 + i, " ".join(rng.choice(long) for _ in range(60))) for i in range(20)]
    rng.shuffle(rows)
    got = {r.id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(spark, spark.createDataFrame(rows, "doc_id long, text string"), size=4, percent=85).collect()}
    assert got == brute_components(rows, 4, 85)
    assert len({c for _, c in got.values()}) > 15


def _random_sets(rng):
    sets = []
    for n in rng.integers(1, 700, 60):
        s = np.unique(rng.integers(0, 2000, n).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        sets += [s, np.unique(np.append(s[: int(len(s) * rng.uniform(0.6, 1))], rng.integers(0, 1 << 60, len(s) // 9).astype(np.uint64)))]
    return [s for s in sorted(sets, key=len) if len(s)]


def test_bitmap_bound_never_loses_a_link():
    sets = _random_sets(np.random.default_rng(1))
    n = np.array([len(s) for s in sets])
    i, j = np.triu_indices(len(sets), 1)
    common = np.array([len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j)])
    for per in (jaccard.COARSE, jaccard.FINE):
        bits = jaccard.Bitmaps(n, [jaccard._bitmap(s, per) for s in sets])
        for percent in (30, 60, 85):
            linked = 100 * common >= percent * (n[i] + n[j] - common)
            room = bits.room(i, j, percent)
            assert room[linked].all() and room.sum() < len(room)
    exact = jaccard.Sets(n, np.concatenate(sets), np.concatenate([[0], np.cumsum(n)]))
    assert (exact.room(i, j, 60) == (100 * common >= 60 * (n[i] + n[j] - common))).all()


def test_tiles_return_no_more_rows_than_members():
    """Families of texts that all link give a row a member, not a row a pair."""
    rng = np.random.default_rng(2)
    base = np.unique(rng.integers(0, 1 << 60, 300).astype(np.uint64))
    sets = [np.sort(np.append(base[rng.permutation(len(base))[:290]], rng.integers(0, 1 << 60, 4).astype(np.uint64))) for _ in range(200)]
    sets = [np.unique(s) for s in sets]
    sets.sort(key=len)
    ids, n = rng.permutation(200), [len(s) for s in sets]
    at = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
    for extra in (0, 200):
        # Two tiles with the same members, the second small.
        rows = list(range(200)) + list(range(20))
        cols = {"grp": [1] * 200 + [2] * 20, "band": [0] * 220, "slot": [0] * 220, "part": [0] * 220, "side": [0] * 220, "id": ids[rows], "comp": ids[rows], "n": np.array(n)[rows]}
        if extra:
            cols["bits"] = pa.array([jaccard._bitmap(sets[r], jaccard.COARSE) for r in rows], pa.binary())
        else:
            cols["s"] = pa.array([sets[r].view(np.int64).tolist() for r in rows], pa.list_(pa.int64()))
        out = pa.Table.from_batches(jaccard._tiles(80)([pa.record_batch(cols)])).to_pylist()
        parent = {}
        find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
        for r in out:
            parent[max(find(r["a"]), find(r["b"]))] = min(find(r["a"]), find(r["b"]))
        assert len(out) <= 220 and len({find(x) for x in ids.tolist()}) == 1


def test_lm_learns_from_every_text(spark):
    """The first text in hash order alone has more words than START_WORDS."""
    ids = spark.range(400).select("id", F.xxhash64("id").alias("h")).orderBy("h").collect()
    first = next(r.id for r in ids if zlib.crc32(str(r.id).encode()) % 5 != 1)
    rows = [(r.id, " ".join(["junk"] * 70_000) if r.id == first else " ".join("pqrstuvwxyz"[(k + r.id) % 11] for k in range(300))) for r in ids]
    got = lm.lm_scores(spark, spark.createDataFrame(rows, "doc_id long, text string")).where("held_out").collect()
    assert sum(r.score for r in got) > 0.4 * sum(r.base_score for r in got)


def test_lm_shortlist_grows_with_the_vocabulary(spark):
    assert lm.shortlist_size(100) == 1022 and lm.shortlist_size(404_216) > 5000 and lm.shortlist_size(10**8) > 200_000
    counts = [(i - 50, 1 + i % 7) for i in range(100)]
    h, c = lm._shortlist(spark.createDataFrame(counts, "h long, c long"), 37)
    assert list(zip(h.view(np.int64).tolist(), c.tolist())) == sorted(counts, key=lambda x: (-x[1], x[0]))[:37]


def test_whole_and_embedded_licenses(spark):
    whole = dict(licenses.WHOLE)
    prose = " ".join(f"word{i} and" for i in range(300))
    wrap = lambda t, n: "\n".join(" ".join(t.split()[i : i + n]) for i in range(0, len(t.split()), n))
    rows, want = [], []
    for name in sorted(whole):
        one = " ".join(whole[name].split())
        for text in (one, f"The {name} text\n\nCopyright (c) 2020 A. Body\n\n{whole[name]}", f"{prose}.\n{wrap(one, 11)}\n{prose}", f"{prose}. {one} {prose}."):
            rows.append((len(rows), text))
            want.append(name)
    rows += [(len(rows), f"{prose}. Released under the MIT License. See the notes below. {prose}"), (len(rows) + 1, prose)]
    got = {r.doc_id: r for r in licenses.scan_licenses(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, name in enumerate(want):
        assert name in (got[i].licenses or "").split(","), (name, i % 4, got[i])
    assert (got[len(want)].license_id, got[len(want)].n_units) == ("MIT", 1)
    assert got[len(want) + 1].license_id is None


def test_license_paragraphs_with_any_blank_lines(spark):
    mit = dict(licenses.WHOLE)["MIT"]
    parts = [" ".join(p.split()) for p in mit.split("\n\n") if p.strip()]
    rows = [(i, blank.join(["Some words before it.", *parts, "And some after."])) for i, blank in enumerate(["\n\n", "\r\n\r\n", "\n  \t\n", "\n\n\n"])]
    rows += [(10 + i, t.replace("\n", "\r\n")) for i, (_, t) in enumerate(rows[:1])]
    got = {r.doc_id: r for r in licenses.scan_licenses(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(r.license_id == "MIT" and r.dice > 0.8 for r in got.values())
    assert len({(round(got[i].dice, 6), got[i].n_units) for i in (0, 1, 2, 3, 10)}) == 1


def test_pii_in_long_texts_and_blocks(spark):
    """Many matches over several blocks and parts; context reaches over neighbouring matches."""
    rng = random.Random(16)
    words = ["x@y.zz", "10.0.0.7", "é😀", "ssn", "123-45-6789", "call", "+1 202 555 0143", "\n", "prose " * 9, "4111111111111111"]
    texts = [" ".join(rng.choice(words) for _ in range(2000)), " ".join(["a@b.cc"] * 700), "😀" * 5000 + " a@b.cc", "a@b.cc " + "é" * 9000 + " 10.0.0.7"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.find_pii(df).withColumn("red", pii.redacted(F.col("text"), F.col("pii"))).collect():
        assert [(s.start, s.kind, s.end) for s in r.pii if s.kind < pii.BASE] == brute_pii(r.text)
        ssn = [m for m in re.finditer(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r.text) if re.search(r"\b(?:ssn|social|security)", r.text[max(0, m.start() - pii.CONTEXT) : m.start()].lower())]
        assert [(s.start, s.end) for s in r.pii if pii.KINDS[s.kind] == "ssn"] == [m.span() for m in ssn]
        out, at = [], 0
        for s in r.pii:
            if s.start >= at:
                out.append(r.text[at : s.start] + f"<{pii.KINDS[s.kind]}>")
            at = max(at, s.end)
        assert r.red == "".join(out) + r.text[at:]


def test_each_source_has_the_seed_nearest_to_its_target(spark):
    rng = random.Random(17)
    rows = [(i, f"s{i % 5}" if i % 5 else None, rng.randrange(1, 400)) for i in range(60)]
    sizes, scratch = spark.createDataFrame(rows, "doc_id long, source string, size long"), Scratch(spark, "t")
    targets = mixing.source_targets(spark, sizes, scratch)
    with_seeds = mixing.nearest_seeds(sizes, targets)
    rate = {r.source: r.rate for r in targets.collect()}
    got = {r.source: r for r in with_seeds.collect()}

    def copies(i, x, seed):
        return int(x) + (int(hashlib.md5(f"{seed}|{i}".encode()).hexdigest()[:13], 16) / (1 << 52) < x - int(x))

    for s, r in got.items():
        off = [abs(sum(n * copies(i, rate[s], k) for i, o, n in rows if o == s) - r.target) for k in range(mixing.TRIES)]
        assert r.seed == off.index(min(off))
    for r in mixing.with_copies(sizes, with_seeds).collect():
        assert r.copies == copies(r.doc_id, rate[r.source], got[r.source].seed)


def test_mixing_with_clashing_columns(spark):
    df = spark.createDataFrame([(i, "a b", f"s{i % 2}", 1, 2, 3, 4) for i in range(20)], "doc_id long, text string, source string, _copy int, of_source int, copy int, Copies int")
    scratch = Scratch(spark, "t")
    targets = mixing.source_targets(spark, scratch.keep(mixing.sized(df)), scratch)
    mixed = mixing.emit_copies(mixing.with_copies(df.withColumn("_source", F.lit("x")), targets))
    assert mixed.columns[:7] == ["doc_id", "text", "source", "_copy", "of_source", "copy", "_source"]
    assert all((r["_copy"], r["of_source"], r["copy"], r["_source"]) == (1, 2, 3, "x") for r in mixed.collect())


def test_account_numbers_before_upper_case_words(spark):
    def number(country, rest):
        digits = "".join(str(int(c, 36)) for c in rest + country + "00")
        return f"{country}{98 - int(digits) % 97:02d}{rest}"

    plain = [number(c, ("53900754703412345678901234567")[: n - 4]) for c, n in (("BE", 16), ("AT", 20), ("ES", 24), ("DE", 22), ("NO", 15), ("PL", 28), ("ZZ", 20))]
    spaced = [" ".join(x[i : i + 4] for i in range(0, len(x), 4)) for x in plain]
    words = [" BIC: KREDBEBB", " USD", " EURO", " BANK BIC", "", ".", " GB82 WEST 1234 5698 7654 32"]
    rows = [(i, x, w) for i, (x, w) in enumerate((x, w) for x in plain + spaced for w in words if x.replace(" ", "")[:2] != "ZZ" or "GB82" not in w)]
    df = spark.createDataFrame([(i, f"pay {x}{w}") for i, x, w in rows] + [(-1, "pay BE68 5390 0754 7034 BIC: KREDBEBB"), (-2, "pay BE69 5390 0754 7034 BIC")], "doc_id long, text string")
    got = {r.doc_id: [(s.start, s.end) for s in r.pii if pii.KINDS[s.kind] == "iban"] for r in pii.find_pii(df).collect()}
    for i, x, w in rows:
        first = (4, 4 + len(x))
        assert got[i] == [first, (first[1] + 1, first[1] + len(w))][: 2 if "GB82" in w else 1], (x, w)
    assert got[-1] == [(4, 23)] and got[-2] == []
