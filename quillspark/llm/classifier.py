"""Quality classifier: random-indexing word vectors, pooled, under a small network.

Every word has a sparse ternary index vector fixed by its hash. The context
vector of a word bucket is the sum of the index vectors of all neighbours that
its words have in the whole corpus (integers, so that the order of summing
can't matter). A text is the mean of its words' normalised context vectors and
of their index vectors, with the pooled norms, its length and character class
shares beside them. A network of two layers is fitted in numpy to a bounded sample of
labelled texts, and a temperature fitted on the part held back from it
calibrates the probabilities.

BUCKETS x DIM bounds what is broadcast; SAMPLE bounds the labelled texts, taken
for each label in the order of a hash and weighted back to the label's share.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import textbuf as tb

BUCKETS = 1 << 13
DIM = 32
SAMPLE = 8000
HIDDEN = 32
THRESHOLD = 0.7

_KIND = np.full(256, 4, np.uint8)
_KIND[65:91] = 0  # capitals
_KIND[48:58] = 1  # digits
_KIND[[c for c in range(33, 127) if not chr(c).isalnum()]] = 2
_KIND[10] = 3


def _word_parts(part: np.ndarray, offs: np.ndarray):
    """(first, bucket, index places (n, 2), signs (n, 2), hash) of the words."""
    starts, ends, first = tb.words(part, offs)
    h = tb.span_hash(tb.prefix_hash(tb.LOWER[part]), starts, ends)
    bucket = (h & np.uint64(BUCKETS - 1)).astype(np.int64)
    place = np.stack([(h >> np.uint64(20)) % np.uint64(DIM), (h >> np.uint64(36)) % np.uint64(DIM)], 1).astype(np.int64)
    sign = (1 - 2 * (np.stack([h >> np.uint64(60), h >> np.uint64(61)], 1) & np.uint64(1)).astype(np.int64))
    return first, bucket, place, sign, h


def _contexts(batches):
    total = np.zeros(BUCKETS * DIM, np.int64)
    for batch in batches:
        data, offsets = tb.buffers(batch.column("text"))
        for _, _, part, offs in tb.chunks(data, offsets):
            first, bucket, place, sign, _ = _word_parts(part, offs)
            n = len(bucket)
            if n < 2:
                continue
            joined = np.ones(n - 1, bool)
            inner = first[(first > 0) & (first < n)]
            joined[inner - 1] = False  # texts don't meet
            i = np.flatnonzero(joined)
            for a, b in ((i, i + 1), (i + 1, i)):
                for k in range(2):
                    total += np.bincount(bucket[a] * DIM + place[b, k], sign[b, k], BUCKETS * DIM).astype(np.int64)
    hit = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(total[hit])], ["at", "v"])


def context_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """(BUCKETS, DIM) unit rows from all texts; at most BUCKETS x DIM sums reach the driver."""
    t = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_contexts, "at long, v long").groupBy("at").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(BUCKETS * DIM, np.float32)
    out[t.column("at").to_numpy()] = t.column("v").to_numpy()
    out = out.reshape(BUCKETS, DIM)
    return out / np.maximum(1e-6, np.sqrt((out * out).sum(1, keepdims=True)))


def features(column: pa.Array, contexts: np.ndarray) -> np.ndarray:
    """A row for every text; a text without words has finite features, too."""
    return np.concatenate([np.zeros((0, 2 * DIM + 10), np.float32), *(x for _, _, x in feature_slices(column, contexts))])


def feature_slices(column: pa.Array, contexts: np.ndarray):
    """(first text, past the last, features) of runs of texts that bound the memory."""
    data, offsets = tb.buffers(column)
    for i, j, part, offs in tb.chunks(data, offsets):
        first, bucket, place, sign, h = _word_parts(part, offs)
        docs, n = len(offs) - 1, (first[1:] - first[:-1])
        doc = np.repeat(np.arange(docs), n)
        pooled = np.zeros((docs, DIM), np.float32)
        full = np.flatnonzero(n)
        for lo in range(0, len(full), 256):
            some = full[lo : lo + 256]
            a, b = first[some[0]], first[some[-1] + 1]
            pooled[some] = np.add.reduceat(contexts[bucket[a:b]], first[some] - a, axis=0)
        index = sum(np.bincount(doc * DIM + place[:, k], sign[:, k], docs * DIM) for k in range(2)).reshape(docs, DIM)
        size = np.maximum(1, n)[:, None]
        pooled, index = pooled / size, index / size
        order = np.lexsort((h, doc))
        new = np.ones(len(h), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
        distinct = np.bincount(doc[order][new], minlength=docs)[:, None] / size
        again = np.bincount(doc[1:][(h[1:] == h[:-1]) & (doc[1:] == doc[:-1])], minlength=docs)[:, None] / size if len(h) else np.zeros((docs, 1))
        chars = np.maximum(1, offs[1:] - offs[:-1])[:, None]
        kind, kinds = _KIND[part], np.zeros((docs, 4))
        for k in range(4):
            at = np.searchsorted(np.flatnonzero(kind == k), offs)
            kinds[:, k] = at[1:] - at[:-1]
        kinds /= chars
        norms = np.stack([np.sqrt((pooled**2).sum(1)), np.sqrt((index**2).sum(1))], 1)
        yield i, j, np.concatenate([pooled, index, norms, np.log1p(n)[:, None], chars / size / 8, distinct, again, kinds], 1).astype(np.float32)


class Network:
    """Two layers under a temperature; fit() is deterministic."""

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, held: np.ndarray, epochs: int = 30, seed: int = 0) -> Network:
        self.prior = float((y * weight).sum() + 1) / float(weight.sum() + 2)
        self.w1 = None
        if min(y[~held].sum(), (1 - y[~held]).sum()) < 5:
            return self
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x[~held].mean(0), x[~held].std(0) + 1e-3
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        d = z.shape[1]
        p = [rng.normal(0, 1 / np.sqrt(d), (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
        train = np.flatnonzero(~held)
        for epoch in range(epochs):
            for rows in np.array_split(rng.permutation(train), max(1, len(train) // 128)):
                grads = self.gradients(p, z[rows], y[rows], weight[rows])
                step += 1
                rate = 0.005 * (1 - epoch / epochs) + 1e-4
                for k, g in enumerate(grads):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        self.w1, self.b1, self.w2, self.b2 = p
        self.temperature = 1.0
        if held.any():
            logit = self.logits(x[held])
            loss = lambda t: float((weight[held] * np.logaddexp(0, np.where(y[held] == 1, -1, 1) * logit / t)).sum())
            self.temperature = min(np.exp(np.linspace(-1.5, 2.5, 161)), key=loss)
        return self

    @staticmethod
    def gradients(p: list[np.ndarray], z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        """Of the weighted mean of log losses plus 0.00005 times the squares of the first weights."""
        hid = np.tanh(z @ p[0] + p[1])
        err = (1 / (1 + np.exp(-(hid @ p[2] + p[3]))) - y) * weight / weight.sum()
        back = np.outer(err, p[2]) * (1 - hid * hid)
        return [z.T @ back + 1e-4 * p[0], back.sum(0), hid.T @ err, err.sum(keepdims=True)]

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.tanh(z @ self.w1 + self.b1) @ self.w2 + self.b2

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.w1 is None:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -500, 500)))


def fold_of(id_col: str) -> F.Column:
    """crc32 of the id as text, modulo 4; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, contexts: np.ndarray, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Network:
    """A network from labelled texts outside the held-out fold (2): of each label
    the first ``sample`` ids by hash, about 2 x sample x labels of which reach
    the driver. An id with both labels counts as label 1."""
    clean = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where("id IS NOT NULL AND y IN (0, 1)").groupBy("id").agg(F.max("y").alias("y"))
    clean = clean.withColumn("fold", fold_of("id")).where("fold <> 2")
    totals = {r.y: r["count"] for r in clean.groupBy("y").count().collect()}
    # By hash: a threshold that some 2 x sample ids of a label pass, then the
    # first of these. With sample + 6 sqrt(sample) expected or more, too few
    # pass about once in 10**9 times; the weights below allow for it.
    space, x = 1 << 40, F.pmod(F.xxhash64("id"), F.lit(1 << 40))
    likely = F.lit(False)
    for label, n in totals.items():
        likely |= (F.col("y") == label) & (x < F.lit(min(space, 2 * sample * space // n)))
    near = clean.where(likely).select("id", "y", "fold", x.alias("x")).toPandas().sort_values(["y", "x", "id"])
    near = near[near.groupby("y").cumcount() < sample]
    picked = spark.createDataFrame(pa.Table.from_pandas(near[["id", "y", "fold"]].astype({"y": "int32"}), preserve_index=False))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = texts.join(F.broadcast(picked), "id")  # at most 2 x sample ids

    def run(batches):
        for batch in batches:
            x = features(batch.column("text"), contexts)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y"), batch.column("fold"), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32()))], ["id", "y", "fold", "x"])

    t = rows.mapInArrow(run, "id long, y int, fold long, x array<float>").toArrow().combine_chunks().sort_by("id")
    y = t.column("y").to_numpy().astype(float)
    x = t.column("x").combine_chunks().values.to_numpy().reshape(len(y), -1).astype(float) if len(y) else np.zeros((0, 2 * DIM + 10))
    have = {c: max(1, int((y == c).sum())) for c in (0, 1)}
    weight = np.where(y == 1, totals.get(1, 0) / have[1], totals.get(0, 0) / have[0])
    return Network().fit(x, y, weight, t.column("fold").to_numpy() == 3)


def quality_scores(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with held_out, score and predicted after its own columns.

    A null or empty text is scored as a text without words. With too few
    labels of either kind every score is the smoothed share of label 1. A null
    id is in no fold: not held out. Repeated rows get equal scores. Columns of
    ``docs`` named like the added ones are replaced. An empty table gives no
    rows. Whole texts count; memory grows with the longest one, some 100 bytes
    a byte of it.
    """
    contexts = context_vectors(docs, text_col)
    net = fit(spark, docs, labels, contexts, id_col, text_col)
    docs = docs.drop("held_out", "score", "predicted")
    at, names = docs.columns.index(text_col), [*docs.columns, "score"]

    def run(batches):
        for batch in batches:
            for i, j, x in feature_slices(batch.column(at).cast(pa.string()), contexts):
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in batch.columns), pa.array(net.predict(x.astype(float)))], names)

    from pyspark.sql import types as T

    scored = docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))
    return scored.withColumn("held_out", F.coalesce(fold_of(id_col) == 2, F.lit(False))).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
