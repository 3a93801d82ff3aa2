"""Importance resampling towards a target: hashed n-gram features, log ratios, a draw without replacement.

Every text's word n-grams are hashed to buckets and the counts kept as a sparse
document-by-bucket matrix, written as CSR blocks (a row a block: ids, word
counts, indptr, indices, counts). Column sums of the blocks are the corpus's
distribution, those of the target texts the target's; a bucket's gain is the
floored, scaled log ratio of the two. The product of the blocks with the vector
of gains is each document's weight, and the greatest weights with Gumbel noise
from a hash of the id are drawn.

Only vectors of one number a bucket (BUCKETS, whatever the corpus) reach the
driver and the tasks. Blocks hold about a megabyte of text; a longer text is a
block of its own, with memory in proportion to it while it is hashed.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import textbuf as tb
from quillspark.operators.splits import positions
from quillspark.scratch import Scratch

BUCKETS = 10_000
NGRAMS = 3
SCALE = 1000
MIN_WORDS, PERCENT, SEED = 20, 5, 42
LONG_WORD = 48
BLOCK_TEXTS = 1000
BLOCKS = "ids array<long>, n_words array<long>, indptr array<int>, indices binary, counts binary"

# Words are letters a-z, digits and everything beyond ASCII.
BETWEEN = np.ones(256, bool)
BETWEEN[0x30:0x3A] = BETWEEN[0x61:0x7B] = BETWEEN[0x80:] = False

_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, np.uint32(0xEDB88320) ^ (_CRC >> 1), _CRC >> 1).astype(np.uint32)
_ONES = np.uint32(0xFFFFFFFF)


def _feed(state: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC registers ``state``, each after the bytes of its own span: a byte of
    all spans at a time. Spans over LONG_WORD bytes go through zlib."""
    order = np.argsort(-lengths, kind="stable")
    out, at, left = state[order], starts[order], lengths[order]
    lo = int(np.searchsorted(-left, -LONG_WORD, "left"))
    for i in range(lo):
        out[i] = np.uint32(zlib.crc32(data[at[i] : at[i] + left[i]].tobytes(), int(out[i] ^ _ONES))) ^ _ONES
    for p in range(int(left[lo]) if lo < len(left) else 0):
        hi = int(np.searchsorted(-left, -p, "left"))
        now = out[lo:hi]
        out[lo:hi] = _CRC[(now ^ data[at[lo:hi] + p]) & np.uint32(255)] ^ (now >> np.uint32(8))
    back = np.empty_like(out)
    back[order] = out
    return back


def hashed_ngrams(column: pa.Array, buckets: int = BUCKETS, most: int = NGRAMS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each run of texts: (first, past the last, first word of each text,
    text of each feature, bucket of each feature)."""
    data, offsets = tb.buffers(column)
    for i, j, part, offs in tb.chunks(data, offsets):
        part = tb.LOWER[part]
        starts, ends, first = tb.words(part, offs, BETWEEN)
        owner = np.repeat(np.arange(j - i), np.diff(first))
        at = np.arange(len(starts))  # words that begin a feature
        state = np.full(len(starts), _ONES, np.uint32)
        whose, found = [], []
        for n in range(most):
            if n:
                goes_on = at + n < len(owner)
                goes_on[goes_on] = owner[at[goes_on]] == owner[at[goes_on] + n]
                at, state = at[goes_on], state[goes_on]
                state = _CRC[(state ^ np.uint32(32)) & np.uint32(255)] ^ (state >> np.uint32(8))
            state = _feed(state, part, starts[at + n], (ends - starts)[at + n])
            whose.append(owner[at])
            found.append((state ^ _ONES) % np.uint32(buckets))
        yield i, j, first, np.concatenate(whose), np.concatenate(found).astype(np.int64)


def _packed(values: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(values, np.uint32), codec="zstd", asbytes=True)


def _unpacked(packed: pa.Scalar, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(packed.as_buffer(), 4 * n, codec="zstd"), np.uint32).astype(np.int64)


def csr(row: pa.RecordBatch, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(indptr, indices, counts) of a block. Its indices are stored as gaps in the
    order of (row, bucket), which compress to about a byte a cell."""
    indptr = row.column("indptr").flatten().to_numpy()
    n = int(indptr[-1])
    return indptr, np.cumsum(_unpacked(row.column("indices")[0], n)) % buckets, _unpacked(row.column("counts")[0], n)


def _blocks(buckets: int, most: int):
    def run(batches):
        for batch in batches:
            for lo in range(0, len(batch), BLOCK_TEXTS):
                rows = batch.slice(lo, BLOCK_TEXTS)
                for i, j, first, whose, found in hashed_ngrams(rows.column("text"), buckets, most):
                    cells, counts = np.unique(whose * buckets + found, return_counts=True)
                    at = np.searchsorted(cells, np.arange(j - i + 1) * buckets)
                    one = lambda values, kind: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values if isinstance(values, pa.Array) else pa.array(values, kind))
                    ids = rows.column("doc_id").slice(i, j - i)
                    packed = [pa.array([_packed(x)], pa.binary()) for x in (np.diff(cells, prepend=0), counts)]
                    yield pa.RecordBatch.from_arrays([one(ids, None), one(np.diff(first), pa.int64()), one(at, pa.int32()), *packed], ["ids", "n_words", "indptr", "indices", "counts"])

    return run


def count_matrix(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, most: int = NGRAMS) -> DataFrame:
    """The CSR blocks of all rows of ``docs``, written to the shared folder."""
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return scratch.keep(narrow.mapInArrow(_blocks(buckets, most), BLOCKS), "csr")


def _sums(buckets: int):
    def run(batches):
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            for b in range(len(batch)):
                _, indices, counts = csr(batch.slice(b, 1), buckets)
                np.add.at(sums, indices, counts)
        hit = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int32()), pa.array(sums[hit])], ["bucket", "n"])

    return run


def column_sums(blocks: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket: a partial sum a task, ``buckets`` numbers in all."""
    rows = blocks.select("indptr", "indices", "counts").mapInArrow(_sums(buckets), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    sums = np.zeros(buckets, np.int64)
    for row in rows:  # ``buckets`` rows at most
        sums[row.bucket] = row.n
    return sums


def gains(source: np.ndarray, target: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * ln of (smoothed target share / smoothed source share)) of every bucket."""
    b = len(source)
    s, t = float(source.sum() + b), float(target.sum() + b)
    return np.array([math.floor(scale * math.log((float(y) + 1) * s / ((float(x) + 1) * t))) for x, y in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def _products(gain: np.ndarray):
    def run(batches):
        for batch in batches:
            for b in range(len(batch)):
                row = batch.slice(b, 1)
                indptr, indices, counts = csr(row, len(gain))
                summed = lambda x: pa.array(np.diff(np.append(0, np.cumsum(x))[indptr]), pa.int64())  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([row.column("ids").flatten(), row.column("n_words").flatten(), summed(counts), summed(counts * gain[indices])], ["doc_id", "n_words", "n_features", "weight"])

    return run


def weights(blocks: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the matrix times the gains."""
    return blocks.mapInArrow(_products(gain), "doc_id long, n_words long, n_features long, weight long")


def noise(id_col: Column, seed: int = SEED, scale: int = SCALE) -> Column:
    """floor(scale * Gumbel noise) of a hash of the id; a null id hashes as ``null``."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("null"))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-F.lit(float(scale)) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(spark: SparkSession, docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row of ``docs``.

    ``rank`` counts the draw: floor(percent / 100 of the rows with ``min_words``
    words) greatest scores, ties to the smaller id (null last), then to fewer
    features; null for the rest. A null or empty text has no features and weight
    0. Rows that repeat an id each count and share its noise. Empty ``docs``
    give no rows; an empty ``target`` has the even distribution. Other columns
    are ignored, and texts of any length count whole. Ranks come from range
    partitions, so no task sees all rows.
    """
    scratch = Scratch(spark, "importance")
    blocks = count_matrix(docs, scratch, id_col, text_col)
    aim = count_matrix(target.select(F.lit(0).alias("doc_id"), F.col(target_col).alias("text")), scratch)
    gain = gains(column_sums(blocks), column_sums(aim))
    rows = scratch.keep(weights(blocks, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "weights")
    scratch.drop(blocks, aim)
    long_enough = F.col("n_words") >= min_words
    drawn = rows.where(long_enough).count() * percent // 100
    placed = positions(rows.where(long_enough), F.desc("score"), F.asc_nulls_last("doc_id"), "n_features")
    ranked = placed.withColumn("rank", F.when(F.col("pos") < drawn, F.col("pos") + 1).cast("long")).drop("pos")
    return ranked.unionByName(rows.where(~long_enough).withColumn("rank", F.lit(None).cast("long")))
