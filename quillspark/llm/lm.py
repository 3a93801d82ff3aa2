"""Log-likelihood of whole texts under a gated recurrent language model.

Counts of all training tokens are exact and distributed. The model's output
vocabulary is the most frequent words, the end and one symbol for any other
word. It grows with the counted vocabulary (``shortlist_size``) and is factored
into classes by the roots of the frequencies (``class_edges``), so that a token
costs one softmax over classes and one within its class. Output biases start at the corpus
frequencies. START texts give all shards the same first weights; then every
training text is learned once, in ROUNDS rounds: shards of whole texts learn by
truncated backpropagation, each from the same weights, and their weights are
averaged by words. A word outside the shortlist has the model's probability of
"other" times its share of the smoothed unigram mass of all others, so the
model is a distribution over all words. When scoring, the hidden state passes
from window to window to the end of each text.

Words outside the shortlist need corpus counts. Those of the COUNTED most
frequent words travel with the tasks; all others, each of which is at most one
token in COUNTED, are packed by hash bucket into one blob a batch and bucket, so
that neither a vocabulary nor a row for each (word, text) has to fit anywhere
and no bucket is filled by one word.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import textbuf as tb
from quillspark.scratch import Scratch

CLASSES = 32  # at least
END, OTHER = 0, 1
HIDDEN = 16
START = 600
START_WORDS = 60_000
STEPS = 500
ROUNDS = 2
SHARD_WORDS = 1_000_000
BUFFER = 1 << 19
STREAMS = 512  # a buffer fills them with 1024 words each
BLOCK = 1 << 12
COUNTED = 1 << 20
RATE = 0.014
CLASS_COST = 3
BOUND_STEPS = 64
PIECE = 1 << 14
WINDOW = 256
GROUP = 1024
BLOB_BYTES = 64 << 20
LN10 = np.log(10.0)
SUMS = {"key": pa.int64(), "doc_id": pa.int64(), "held_out": pa.bool_(), **dict.fromkeys(("n_tokens", "n_other", "n_short"), pa.int64()), **dict.fromkeys(("base", "logp", "counted"), pa.float64())}
BLOB = {"bucket": pa.int32(), **dict.fromkeys(("h", "d", "keys", "train"), pa.binary())}


def shortlist_size(types: int) -> int:
    """Words of the output vocabulary, about types ** (2/3)."""
    return max(CLASSES, int(np.ceil(types ** (1 / 3)))) ** 2 - 2


def _hashes(column: pa.Array):
    """(first text, offsets into words, word hashes) of runs of texts, A-Z lower-cased."""
    data, offsets = tb.buffers(column)
    for i, _, part, offs in tb.chunks(data, offsets):
        part = tb.LOWER[part]
        starts, ends, first = tb.words(part, offs)
        yield i, first, tb.span_hash(tb.prefix_hash(part), starts, ends)


def _counts(batches):
    for batch in batches:
        found = [h for _, _, h in _hashes(batch.column("text"))]
        if found:
            h, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(tb.signed(h)), pa.array(n.astype(np.int64))], ["h", "c"])


def class_edges(p: np.ndarray) -> np.ndarray:
    """Bounds of the classes of words with probabilities ``p``, most frequent
    first: each class holds an equal share of the roots of the probabilities,
    which makes few classes of a frequent word's few neighbours. Of some numbers
    of classes, the one with the least work a word: a class costs every window
    about CLASS_COST logits, a word those of its class."""
    upto = np.cumsum(np.sqrt(p))
    best, least = None, np.inf
    for k in np.unique(np.geomspace(2, max(2, len(p) / 2), 24).astype(int)):
        edge = np.unique(np.concatenate([[0], np.searchsorted(upto, upto[-1] * np.arange(1, k) / k, "right"), [len(p)]]))
        size = np.diff(edge)
        cost = CLASS_COST * len(size) + float((np.add.reduceat(p, edge[:-1]) * size).sum())
        if cost < least:
            best, least = edge, cost
    return best


class Gru:
    """Embedding, one gated layer, class-factored softmax; weights in float32.
    The last column of the output tables "c" (classes) and "o" (words) is a bias."""

    def __init__(self, counts: np.ndarray, seed: int = 0):
        """counts: of END, OTHER and the shortlist, most frequent first."""
        rng, v = np.random.default_rng(seed), len(counts)
        p = (counts + 0.5) / (counts + 0.5).sum()
        self.v, self.edge = v, class_edges(p)
        self.classes = len(self.edge) - 1
        self.cls = np.repeat(np.arange(self.classes, dtype=np.uint16 if self.classes < 65536 else np.int64), np.diff(self.edge))
        bc = np.log(np.add.reduceat(p, self.edge[:-1]))
        r = lambda *s: rng.normal(0, 0.3 / np.sqrt(s[0]), s)
        self.w = {"e": rng.normal(0, 0.3, (v, HIDDEN)), "x": r(HIDDEN, 3 * HIDDEN), "u": r(HIDDEN, 3 * HIDDEN), "b": np.zeros(3 * HIDDEN), "c": np.column_stack([r(HIDDEN, self.classes).T * 0.1, bc]), "o": np.column_stack([rng.normal(0, 0.02, (v, HIDDEN)), np.log(p) - bc[self.cls]])}
        self.w = {k: np.ascontiguousarray(a, np.float32) for k, a in self.w.items()}
        self.adam: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        self._bound()

    def _bound(self) -> None:
        """Whether exp() of every logit is far from the ends of float32, now and for
        BOUND_STEPS updates: states are within 1, and an update moves a weight by
        hardly more than its rate. Then no row needs its maximum taken off."""
        self.small = all(float(np.abs(self.w[k]).sum(1).max()) < 45 for k in ("c", "o"))

    def step(self, gx: np.ndarray, h: np.ndarray):
        k, gh = HIDDEN, h @ self.w["u"]
        zr = gx[:, : 2 * k] + gh[:, : 2 * k]
        np.negative(zr, out=zr)
        np.exp(zr, out=zr)
        zr += 1
        np.reciprocal(zr, out=zr)
        z, r, gn = zr[:, :k], zr[:, k:], gh[:, 2 * k :]
        n = r * gn
        n += gx[:, 2 * k :]
        np.tanh(n, out=n)
        new = h - n
        new *= z
        new += n
        return new, (z, r, n, gn)

    def _softmax(self, x: np.ndarray, table: np.ndarray, target: np.ndarray, weight: np.ndarray | None):
        """(log-probability of the target row of ``table`` after each state; the
        weighted loss's gradient for the logits, but for a factor of each state;
        that factor)."""
        logit = x @ table.T
        if not self.small:
            logit -= logit.max(1, keepdims=True)
        flat, at = logit.reshape(-1), np.arange(len(x)) * len(table) + target
        own = flat[at]
        np.exp(logit, out=logit)
        total = logit @ np.ones(len(table), np.float32)
        if weight is None:
            return own - np.log(total), None, None
        flat[at] -= total
        return own - np.log(total), logit, (weight / total)[:, None]

    def log_probs(self, hs: np.ndarray, targets: np.ndarray, grads: dict | None = None, weight: np.ndarray | None = None):
        """Natural log-probability of each target after each state; with
        ``grads``, also the gradient of the loss, a mean by ``weight``, for the
        states. Gradients come as a list of (rows, gradient) a table."""
        c, o, cls = self.w["c"], self.w["o"], self.cls[targets]
        order = np.argsort(cls, kind="stable")
        hs = np.concatenate([hs, np.ones((len(hs), 1), np.float32)], 1)[order]
        cls, inner = cls[order], targets[order] - self.edge[cls[order]]
        weight = None if grads is None else weight[order]
        found, back = np.empty(len(hs), hs.dtype), None
        if grads is not None:
            back, total = np.empty((len(hs), HIDDEN), hs.dtype), np.zeros_like(c)
            grads["c"], grads["o"] = [(slice(None), total)], []
        for lo in range(0, len(hs), BLOCK):  # logits of a block stay in the processor's cache
            rows = slice(lo, lo + BLOCK)
            found[rows], d, by = self._softmax(hs[rows], c, cls[rows], None if grads is None else weight[rows])
            if grads is not None:
                back[rows] = by * (d @ c[:, :HIDDEN])
                total += d.T @ (hs[rows] * by)
        begin = np.searchsorted(cls, np.arange(self.classes + 1))
        for k in np.flatnonzero((np.diff(begin) > 0) & (np.diff(self.edge) > 1)).tolist():  # a class of one word is certain
            rows, words = slice(begin[k], begin[k + 1]), slice(self.edge[k], self.edge[k + 1])
            got, d, by = self._softmax(hs[rows], o[words], inner[rows], None if grads is None else weight[rows])
            found[rows] += got
            if grads is not None:
                back[rows] += by * (d @ o[words, :HIDDEN])
                grads["o"].append((words, d.T @ (hs[rows] * by)))
        out = np.empty_like(found)
        out[order] = found
        if grads is not None:
            placed = np.empty_like(back)
            placed[order] = back
            back = placed
        return out, back

    def _update(self, g: dict, rate: float, step: int) -> None:
        """Adam, with the gradient's length cut at 1, on the rows that have a gradient."""
        # The averages are kept as sums, m ten times and v a hundred times as large.
        root = np.sqrt(1 - 0.99**step)
        cut = min(1.0, 1.0 / (np.sqrt(sum(float(np.vdot(d, d)) for parts in g.values() for _, d in parts)) + 1e-9))
        for k, parts in g.items():
            if k not in self.adam:
                self.adam[k] = (np.zeros_like(self.w[k]), np.zeros_like(self.w[k]))
            for at, d in parts:
                # Slices are views; a class's rows stay in the processor's cache.
                w, m, v = (a[at] for a in (self.w[k], *self.adam[k]))
                if cut < 1:
                    d *= cut
                m *= 0.9
                m += d
                d *= d
                v *= 0.99
                v += d
                np.sqrt(v, out=d)
                d += 1e-7 * root
                np.divide(m, d, out=d)
                d *= rate * root / (1 - 0.9**step)
                w -= d
                if not isinstance(at, slice):
                    self.w[k][at], self.adam[k][0][at], self.adam[k][1][at] = w, m, v
        if step % BOUND_STEPS == 0:
            self._bound()

    def _learn(self, prev: np.ndarray, ids: np.ndarray, begin: np.ndarray, weight: np.ndarray, h: np.ndarray, rate: float, step: int) -> np.ndarray:
        """One update from a window of (streams, length); the states after it.
        Only rows and classes that the window touches are updated."""
        w, (streams, length), k = self.w, ids.shape, HIDDEN
        flat = prev.T.ravel()
        x = w["e"][flat]
        gx = (x @ w["x"] + w["b"]).reshape(length, streams, 3 * k)
        before, states, z, r, n, gn = np.empty((6, length, streams, k), x.dtype)
        new = begin.any(0).tolist()
        for t in range(length):
            before[t] = h
            if new[t]:
                before[t, begin[:, t]] = 0
            h, (z[t], r[t], n[t], gn[t]) = self.step(gx[t], before[t])
            states[t] = h
        g: dict = {}
        part = weight.T.ravel().astype(np.float32)
        _, back = self.log_probs(states.reshape(-1, k), ids.T.ravel(), g, part / part.sum())
        back = back.reshape(length, streams, k)
        # What a state's gradient is multiplied by at its gates, for all places at once.
        rest = 1 - z
        by_n, by_z, by_r = rest * (1 - n * n), (before - n) * z * rest, gn * r * (1 - r)
        dn, dgh = np.empty_like(n), np.empty_like(gx)
        ut, carry = np.ascontiguousarray(w["u"].T), np.zeros((streams, k), x.dtype)
        for t in range(length - 1, -1, -1):
            d, dg = back[t], dgh[t]
            d += carry
            np.multiply(d, by_n[t], out=dn[t])
            np.multiply(d, by_z[t], out=dg[:, :k])
            np.multiply(dn[t], by_r[t], out=dg[:, k : 2 * k])
            np.multiply(dn[t], r[t], out=dg[:, 2 * k :])
            carry = dg @ ut
            d *= z[t]
            carry += d
            if new[t]:
                carry[begin[:, t]] = 0
        dgx, dgh = dgh.reshape(-1, 3 * k).copy(), dgh.reshape(-1, 3 * k)
        dgx[:, 2 * k :] = dn.reshape(-1, k)
        for name, d in (("u", before.reshape(-1, k).T @ dgh), ("x", x.T @ dgx), ("b", dgx.sum(0))):
            g[name] = [(slice(None), d)]
        order = np.argsort(flat, kind="stable")
        rows, edge = np.unique(flat[order], return_index=True)
        g["e"] = [(rows, np.add.reduceat((dgx @ w["x"].T)[order], edge, axis=0))]
        self._update(g, rate, step)
        return h

    @staticmethod
    def _streams(texts: list[np.ndarray], streams: int):
        """(previous ids, ids, text begins, weights) of all words in equal
        streams; only the places past the last word have no weight."""
        ids = np.concatenate(texts)
        begin = np.zeros(len(ids), bool)
        begin[np.cumsum([0] + [len(t) for t in texts[:-1]])] = True
        prev = np.where(begin, END, np.concatenate([[END], ids[:-1]]))
        per = -(-len(ids) // streams)
        fill = lambda a: np.append(a, np.zeros(streams * per - len(ids), a.dtype)).reshape(streams, per)
        return fill(prev), fill(ids), fill(begin), fill(np.ones(len(ids), bool))

    def train(self, texts: list[np.ndarray], steps: int = STEPS, streams: int = 32, length: int = 16, seed: int = 0) -> None:
        """Adam on streams of whole texts; a text begins with a zero state."""
        texts = [t for t in texts if len(t)]
        size = sum(map(len, texts))
        if not size:
            return
        data, at = self._streams(texts, max(1, min(streams, size // length))), 0
        h = zero = np.zeros((len(data[0]), HIDDEN), np.float32)
        for step in range(1, steps + 1):
            if at >= data[0].shape[1]:
                h, at = zero, 0
            h = self._learn(*(a[:, at : at + length] for a in data), h, 0.01 * (1 - step / (steps + 1)), step)
            at += length
        self.adam = {}

    def learn_all(self, runs, length: int = 16) -> int:
        """One pass over every word of the texts that ``runs`` yields, a run at
        a time; the number of words."""
        step = n = 0
        for texts in runs:
            size = sum(map(len, texts))
            data = self._streams(texts, max(1, min(STREAMS, size // (64 * length))))
            h = np.zeros((len(data[0]), HIDDEN), np.float32)
            for at in range(0, data[0].shape[1], length):
                step += 1
                h = self._learn(*(a[:, at : at + length] for a in data), h, RATE, step)
            n += int(data[3].sum())
        self.adam = {}
        return n

    def flat(self) -> np.ndarray:
        return np.concatenate([self.w[k].ravel() for k in sorted(self.w)])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for k in sorted(self.w):
            a = self.w[k]
            self.w[k] = flat[at : at + a.size].reshape(a.shape).astype(np.float32)
            at += a.size
        self._bound()

    def freeze(self) -> Gru:
        self._bound()
        self.table = self.w["e"] @ self.w["x"] + self.w["b"]
        return self

    def score(self, ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Natural log-probability of every text; ids end with END in each."""
        size = offsets[1:] - offsets[:-1]
        order, out = np.argsort(-size, kind="stable"), np.zeros(len(size))
        window = max(4, min(WINDOW, WINDOW * CLASSES // self.classes))
        for lo in range(0, len(order), GROUP):
            docs = order[lo : lo + GROUP]
            left, begin = size[docs], offsets[docs]
            h = np.zeros((len(docs), HIDDEN), np.float32)
            for t0 in range(0, int(left[0]) if len(left) else 0, window):
                states, targets, who = [], [], []
                for t in range(t0, min(t0 + window, int(left[0]))):
                    n = int(np.searchsorted(-left, -t, "left"))  # texts longer than t
                    prev = ids[begin[:n] + t - 1] if t else np.full(n, END)
                    h[:n] = self.step(self.table[prev], h[:n])[0]
                    states.append(h[:n].copy())
                    targets.append(ids[begin[:n] + t])
                    who.append(np.arange(n))
                got = self.log_probs(np.concatenate(states), np.concatenate(targets))[0]
                out[docs] += np.bincount(np.concatenate(who), got, len(docs))
        return out


def _at(h: np.ndarray, sorted_h: np.ndarray) -> np.ndarray:
    """The place of each hash in ``sorted_h``, -1 where it isn't."""
    if not len(sorted_h):
        return np.full(len(h), -1)
    at = np.minimum(np.searchsorted(sorted_h, h), len(sorted_h) - 1)
    return np.where(sorted_h[at] == h, at, -1)


def _encode(h: np.ndarray, sorted_h: np.ndarray, code: np.ndarray) -> np.ndarray:
    at = _at(h, sorted_h)
    return np.where(at >= 0, code[at], OTHER) if len(code) else np.full(len(h), OTHER, np.int64)


def _texts(column: pa.Array, sorted_h: np.ndarray, code: np.ndarray):
    """For runs of texts: (first text, ids with an END after each text, their
    offsets, hashes of other words, their texts)."""
    for i, first, h in _hashes(column):
        ids = _encode(h, sorted_h, code)
        docs = len(first) - 1
        doc = np.repeat(np.arange(docs), np.diff(first))
        out = np.full(len(ids) + docs, END, np.int64)
        out[np.arange(len(ids)) + doc] = ids
        other = ids == OTHER
        yield i, out, first + np.arange(docs + 1), h[other], doc[other]


def _keys(batch) -> np.ndarray:
    """A key of every row from its id and text; equal rows share it."""
    data, offsets = tb.buffers(batch.column("text"))
    ids = batch.column("doc_id").fill_null(0).to_numpy().view(np.uint64)
    null = batch.column("doc_id").is_null().to_numpy(zero_copy_only=False).astype(np.uint64)
    out = []
    for i, j, part, offs in tb.chunks(data, offsets):
        prefix = tb.prefix_hash(part)
        out.append(tb.mix(tb.mix(ids[i:j] + null[i:j]) ^ tb.span_hash(prefix, offs[:-1], offs[1:])))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _blobs(h: np.ndarray, d: np.ndarray, key: np.ndarray, train: np.ndarray, buckets: int) -> pa.RecordBatch:
    """The words ``h`` of the texts ``d`` of a batch, by bucket."""
    bucket = ((h >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((h, bucket))
    h, d, bucket = h[order], d[order].astype(np.int32), bucket[order]
    edge = np.searchsorted(bucket, np.arange(buckets + 1))
    rows = [(b, h[edge[b] : edge[b + 1]].tobytes(), d[edge[b] : edge[b + 1]]) for b in range(buckets) if edge[b] < edge[b + 1]]
    uses = [np.unique(x[2], return_inverse=True) for x in rows]
    return pa.RecordBatch.from_arrays(
        [pa.array([x[0] for x in rows], pa.int32()), pa.array([x[1] for x in rows], pa.binary()), pa.array([i.astype(np.uint16 if len(u) < 65536 else np.uint32).tobytes() for u, i in uses], pa.binary()), pa.array([key[u].tobytes() for u, _ in uses], pa.binary()), pa.array([np.packbits(train[u]).tobytes() for u, _ in uses], pa.binary())],
        [*BLOB],
    )


def _tail(parts: int):
    """Sums over one bucket's words for each text, log10(c + 0.5) and known
    words, packed by part of the keys: a row a part, not one a text."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        hs, ds, keys, trains, n = [], [], [], [], 0
        for h, d, key, train in zip(pdf.h, pdf.d, pdf["keys"], pdf.train, strict=True):
            h, key = np.frombuffer(h, np.uint64), np.frombuffer(key, np.uint64)
            hs.append(h)
            ds.append(np.frombuffer(d, np.uint16 if len(d) == 2 * len(h) else np.uint32).astype(np.int64) + n)
            keys.append(key)
            trains.append(np.unpackbits(np.frombuffer(train, np.uint8))[: len(key)])
            n += len(key)
        h, d, key, train = np.concatenate(hs), np.concatenate(ds), np.concatenate(keys), np.concatenate(trains)
        _, word = np.unique(h, return_inverse=True)
        c = np.bincount(word, train[d])[word]
        own, who = np.unique(key, return_inverse=True)
        tail, known = np.bincount(who[d], np.log10(c + 0.5), len(own)), np.bincount(who[d], c > 0, len(own)).astype(np.int64)
        part = (own % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        edge = np.searchsorted(part[order], np.arange(parts + 1))
        some = [(p, order[edge[p] : edge[p + 1]]) for p in range(parts) if edge[p] < edge[p + 1]]
        return pd.DataFrame({"part": np.array([p for p, _ in some], np.int32), "key": [own[i].tobytes() for _, i in some], "tail": [tail[i].tobytes() for _, i in some], "known": [known[i].tobytes() for _, i in some]})

    return run


def _sum_tails(pdf: pd.DataFrame) -> pd.DataFrame:
    """One row a text of a part."""
    key, tail, known = (np.concatenate([np.frombuffer(b, t) for b in pdf[c]]) for c, t in (("key", np.uint64), ("tail", np.float64), ("known", np.int64)))
    own, who = np.unique(key, return_inverse=True)
    return pd.DataFrame({"key": tb.signed(own), "tail": np.bincount(who, tail, len(own)), "known": np.bincount(who, known, len(own)).astype(np.int64)})


def _model_scores(model: Gru, sorted_h, code, log_c: np.ndarray, seen: np.ndarray, counted_h, counted_log, buckets: int):
    """Rows of two kinds: a text's sums over the words of the tables, and the
    blobs of the words outside them. A text is cut into words once for both."""

    def wide(found: pa.RecordBatch) -> pa.RecordBatch:
        have = dict(zip(found.schema.names, found.columns, strict=True))
        return pa.RecordBatch.from_arrays([have[c] if c in have else pa.nulls(len(found), t) for c, t in (SUMS | BLOB).items()], [*SUMS, *BLOB])

    def run(batches):
        for batch in batches:
            key, n = _keys(batch), len(batch)
            size, others, base, known, logp, tail = (np.zeros(n) for _ in range(6))
            ids, offs, rare, where = [], [0], [], []
            for i, part, o, h, doc in _texts(batch.column("text"), sorted_h, code):
                ids.append(part)
                offs += (o[1:] + offs[-1]).tolist()
                at = _at(h, counted_h)
                rare.append(h[at < 0])
                where.append(doc[at < 0] + i)
                doc = doc[at >= 0] + i
                tail += np.bincount(doc, counted_log[at[at >= 0]], n)
                known += np.bincount(doc, minlength=n)
            if n:
                flat, offs = np.concatenate(ids), np.array(offs)
                doc = np.repeat(np.arange(n), np.diff(offs))
                size = np.diff(offs)
                others = np.bincount(doc, flat == OTHER, n)
                base = np.bincount(doc, log_c[flat], n)
                known += np.bincount(doc, seen[flat], n)
                logp = model.score(flat, offs) / LN10
            yield wide(pa.RecordBatch.from_arrays([pa.array(tb.signed(key)), batch.column("doc_id"), batch.column("held_out"), *(pa.array(a.astype(np.int64)) for a in (size, others, known)), *(pa.array(a) for a in (base, logp, tail))], [*SUMS]))
            if sum(map(len, rare)):
                yield wide(_blobs(np.concatenate(rare), np.concatenate(where), key, ~batch.column("held_out").to_numpy(zero_copy_only=False), buckets))

    return run


def _shard(model: Gru, sorted_h, code):
    """The weights after one pass over all texts of a partition, times their
    words, in pieces."""

    def runs(batches):
        texts, have = [], 0
        for batch in batches:
            for _, ids, offs, _, _ in _texts(batch.column("text"), sorted_h, code):
                for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
                    texts.append(ids[a:b])
                    have += b - a
                    if have >= BUFFER:
                        yield texts
                        texts, have = [], 0
        if texts:
            yield texts

    def run(batches):
        n = model.learn_all(runs(batches))
        if n:
            flat = model.flat()
            for i in range(0, len(flat), PIECE):
                yield pa.RecordBatch.from_arrays([pa.array([i // PIECE], pa.int32()), pa.array([n], pa.int64()), pa.array([flat[i : i + PIECE].tobytes()], pa.binary())], ["piece", "n", "w"])

    return run


def _average(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["n", "w"])  # the sum must not follow the order of the shuffle
    total = sum(np.frombuffer(w, np.float32).astype(float) * n for w, n in zip(pdf.w, pdf.n, strict=True))
    n = int(pdf.n.sum())
    return pd.DataFrame({"piece": pdf.piece[:1], "n": [n], "w": [(total / max(n, 1)).astype(np.float32).tobytes()]})


def fit(train: DataFrame, model: Gru, sorted_h, code, words: int) -> int:
    """Every text of ``train`` once, in ROUNDS rounds of shards whose weights
    are averaged; the number of words (and ends) learned."""
    learned, size = 0, len(model.flat())
    shards = max(1, -(-words // (ROUNDS * max(SHARD_WORDS, 4 * size))))
    for k in range(ROUNDS):
        part = train.where(F.pmod(F.xxhash64("text"), F.lit(ROUNDS)) == k).select("text").coalesce(shards)
        got = part.mapInArrow(_shard(model, sorted_h, code), "piece int, n long, w binary").groupBy("piece").applyInPandas(_average, "piece int, n long, w binary").toArrow().sort_by("piece")
        if got.num_rows:
            model.load(np.frombuffer(b"".join(got.column("w").to_pylist()), np.float32))
            learned += got.column("n")[0].as_py()
    return learned


def _shortlist(counts: DataFrame, short: int, most: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of the most frequent words, by count and hash: all those
    above a count that at most ``most`` words exceed, and with equal counts as
    many as make ``short`` words."""
    most = max(short, most)
    steps = counts.groupBy("c").agg(F.count("*").alias("k")).toArrow().sort_by([("c", "descending")])
    c, upto = steps.column("c").to_numpy(), np.cumsum(steps.column("k").to_numpy())
    whole = int(np.searchsorted(upto, most, "right"))
    got, have = counts if whole == len(c) else counts.where(F.col("c") > int(c[whole])), int(upto[whole - 1]) if whole else 0
    if whole < len(c) and have < short:
        got = got.union(counts.where(F.col("c") == int(c[whole])).orderBy("h").limit(short - have))
    top = got.toArrow()
    h, n = top.column("h").to_numpy(), top.column("c").to_numpy()
    order = np.lexsort((h, -n))
    return h[order].view(np.uint64), n[order]


def lm_scores(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held: int = 1, folds: int = 5) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score).

    Learns from rows whose crc32(id as text) mod ``folds`` is not ``held``. A
    null or blank text is just the end. A null id is a training row. Repeated
    rows count each and score alike. Without training rows every token is
    unknown and has the smoothed probability of one unseen word. Extra columns
    are ignored. Texts of any length are learned and scored whole; a long one is
    taken alone. An empty table gives no rows.
    """
    scratch = Scratch(spark, "lm")
    fold = F.crc32(F.col(id_col).cast("string").cast("binary")) % folds
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.coalesce(fold == held, F.lit(False)).alias("held_out"))
    train = base.where("NOT held_out")
    counts = scratch.keep(train.select("text").mapInArrow(_counts, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")), "counts")
    ends = train.count()
    words, types = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    total, types = words + ends, types + (ends > 0)
    norm = np.log10(total + 0.5 * (types + 1))

    most = shortlist_size(types)
    counted_h, counted_c = _shortlist(counts, most, COUNTED)
    top_h, top_c, counted_h, counted_c = counted_h[:most], counted_c[:most], counted_h[most:], counted_c[most:]
    order = np.argsort(counted_h)
    counted_h, counted_log = counted_h[order], np.log10(counted_c[order] + 0.5)
    left = words - int(top_c.sum()) - int(counted_c.sum())
    order = np.argsort(top_h)
    sorted_h, code = top_h[order], order + 2
    rest = words - int(top_c.sum())
    # By frequency; END and OTHER keep the ids 0 and 1.
    freq = np.concatenate([[ends, rest], top_c]).astype(float)
    log_c, seen = np.log10(freq + 0.5), freq > 0
    log_c[OTHER], seen[OTHER] = 0, False

    # First weights: START texts in hash order, START_WORDS words of them at most.
    picked = train.where("doc_id IS NOT NULL").select("doc_id", "text").withColumn("place", F.xxhash64("doc_id")).orderBy("place", "doc_id").limit(START).toArrow()
    texts, have = [], 0
    for i in range(picked.num_rows):
        if have < START_WORDS:
            for _, ids, _, _, _ in _texts(picked.column("text").slice(i, 1), sorted_h, code):
                texts.append(ids[: START_WORDS - have])
                have += len(texts[-1])
    model = Gru(freq)
    model.train(texts)
    learned = fit(train, model, sorted_h, code, total)
    if learned != total:
        raise RuntimeError(f"learned {learned} of {total} training words")
    model.freeze()

    # 12 bytes a token: training tokens, a fourth of that held out, and new words.
    buckets = max(1, -(-12 * (left + words // 4 + 1) // BLOB_BYTES))
    schema = "key long, doc_id long, held_out boolean, n_tokens long, n_other long, n_short long, base double, logp double, counted double, bucket int, h binary, d binary, keys binary, train binary"
    kept = scratch.keep(base.mapInArrow(_model_scores(model, sorted_h, code, log_c, seen, counted_h, counted_log, buckets), schema), "model")
    scored, blobs = kept.where("bucket IS NULL").select(*SUMS), kept.where("bucket IS NOT NULL").select(*BLOB)
    tail = blobs.groupBy("bucket").applyInPandas(_tail(buckets), "part int, key binary, tail binary, known binary").groupBy("part").applyInPandas(_sum_tails, "key long, tail double, known long")
    same = scored.groupBy("key").agg(F.count("*").alias("rows"))
    sums = tail.join(same, "key").select("key", (F.col("tail") / F.col("rows")).alias("tail"), (F.col("known") / F.col("rows")).cast("long").alias("known"))
    mass = max(1e-12, 1 - float(((np.delete(freq, OTHER) + 0.5) / (total + 0.5 * (types + 1))).sum()))
    tail_sum = F.col("counted") + F.coalesce("tail", F.lit(0.0))
    return scored.join(sums, "key", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_short") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + tail_sum - F.lit(float(norm)) * F.col("n_tokens")).alias("base_score"),
        (F.col("logp") + tail_sum - F.lit(float(norm + np.log10(mass))) * F.col("n_other")).alias("score"),
    )
