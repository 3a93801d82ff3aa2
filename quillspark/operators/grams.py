"""Words and pairs of neighbouring words, counted passage by passage.

A row of every n-gram of every passage would be hashed by passage and term. Here a
task counts the n-grams of a run of passages by their word numbers, and Spark only
adds up one row a term and run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from quillspark.functions.text import tokens
from quillspark.scratch import Scratch

WORDS = 1 << 20


def gram_words(text: Column) -> Column:
    """The words of two characters or more."""
    return F.filter(tokens(text), lambda x: F.length(x) >= 2)


def _numbered(words: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct words, their numbers, passage of each word, numbers of pairs, passage of each pair)."""
    length = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
    flat = words.flatten().dictionary_encode()
    ids, place = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(length)), length)
    same = place[1:] == place[:-1]
    return flat.dictionary, ids, place, (ids[:-1] * len(flat.dictionary) + ids[1:])[same], place[1:][same]


def _counts(keys: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, occurrences, passages that have them)."""
    found, at = np.unique(keys, return_inverse=True)
    held = np.unique(place * max(len(found), 1) + at) % max(len(found), 1)
    return found, np.bincount(at, minlength=len(found)), np.bincount(held, minlength=len(found))


def _joined(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.Array]:
    """The lists of words of several batches, of about WORDS words (a longer passage is taken whole)."""
    held, total = [], 0
    for part in parts:
        held.append(part.column(0))
        total += len(held[-1].flatten())
        if total >= WORDS:
            yield pa.concat_arrays(held)
            held, total = [], 0
    if held:
        yield pa.concat_arrays(held)


def _partial(words: DataFrame, among: pa.Array | None, pairs: bool) -> DataFrame:
    """(term, count, df) of the words, or of the pairs of words (both ``among`` some, if
    given), a row for each term of each run of passages."""

    def count(parts):
        for lists in _joined(parts):
            words, ids, place, keys, where = _numbered(lists)
            if pairs and among is not None:
                able = pc.is_in(words, value_set=among).to_numpy(zero_copy_only=False)
                kept = able[keys // max(len(words), 1)] & able[keys % max(len(words), 1)] if len(words) else np.zeros(0, bool)
                keys, where = keys[kept], where[kept]
            found, n, df = _counts(keys, where) if pairs else _counts(ids, place)
            if pairs:
                first, second = (words.take(pa.array(x, pa.int64())) for x in (found // max(len(words), 1), found % max(len(words), 1)))
                terms = pc.binary_join_element_wise(first, second, " ")
            else:
                terms = words.take(pa.array(found, pa.int64()))
            yield pa.RecordBatch.from_arrays([terms, pa.array(n, pa.int64()), pa.array(df, pa.int64())], ["term", "count", "df"])

    return words.mapInArrow(count, "term string, count long, df long").groupBy("term").agg(F.sum("count").alias("count"), F.sum("df").alias("df"))


def frequent_grams(texts: DataFrame, size: int) -> DataFrame:
    """(term, count, df) among which are the ``size`` n-grams that most often occur in
    ``texts`` (text), ties to the lesser term: the count and the number of texts.

    A pair occurs no more often than either of its words. So where ``size`` words
    occur at least n times, pairs with a rarer word can't be among the first and
    aren't counted, however many different ones there are."""
    words = Scratch(texts.sparkSession, "grams").keep(texts.select(gram_words(F.col("text")).alias("w")).where("w IS NOT NULL"), "words")
    return grams_of_words(words, size)


def grams_of_words(words: DataFrame, size: int) -> DataFrame:
    """``frequent_grams`` of texts that are cut already: (w), the ``gram_words`` of each."""
    ones = Scratch(words.sparkSession, "grams").keep(_partial(words, None, False), "ones", spent=True)
    first = ones.select("count").orderBy(F.desc("count")).limit(size).agg(F.count("*").alias("n"), F.min("count").alias("least")).first()
    least = first["least"] if first["n"] == size else 1
    often = ones.where(F.col("count") >= least)
    few = often.select("term").limit(16 * size + 1).toArrow().column("term").combine_chunks()
    # Many words that all occur as often, as in small texts: every pair is counted.
    return often.unionByName(_partial(words, few if len(few) <= 16 * size else None, True))


class Known:
    """Finds the words and pairs of some ``names`` in lists of words."""

    def __init__(self, names: pa.Array):
        cut = [x.split(" ") for x in names.to_pylist()]
        self.width = max(len(cut), 1)
        self.single, self.double = (np.array([i for i, x in enumerate(cut) if len(x) == n], np.int64) for n in (1, 2))
        self.ones = pa.array([cut[i][0] for i in self.single], pa.string())
        self.left, self.right = (pa.array([cut[i][side] for i in self.double], pa.string()) for side in (0, 1))

    def __call__(self, lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(list, number of the name, occurrences), in order."""
        words, ids, place, pairs, where = _numbered(lists)
        known = pc.fill_null(pc.index_in(words, value_set=self.ones), -1).to_numpy(zero_copy_only=False)[ids] if len(words) else ids
        a, b = (pc.fill_null(pc.index_in(x, value_set=words), -1).to_numpy(zero_copy_only=False).astype(np.int64) for x in (self.left, self.right))
        met = (a >= 0) & (b >= 0)
        wanted, target = (a * len(words) + b)[met], self.double[met]
        by = np.argsort(wanted)
        wanted, target = wanted[by], target[by]
        at = np.searchsorted(wanted, pairs)
        hit = at < len(wanted)
        hit[hit] = wanted[at[hit]] == pairs[hit]
        cell = np.concatenate([place[known >= 0] * self.width + self.single[known[known >= 0]], where[hit] * self.width + target[at[hit]]])
        cell, tf = np.unique(cell, return_counts=True)
        return cell // self.width, cell % self.width, tf


def gram_vectors(rows: DataFrame, keys: list[str], text: str, vocabulary: pa.Table) -> DataFrame:
    """(keys, vector): ascending idx and TF-IDF weights of unit length (the norm counts
    1e-8 more) of every row; ``vocabulary`` (term, idx, idf) travels with the tasks."""
    order = np.argsort(vocabulary.column("idx").to_numpy())
    names = vocabulary.column("term").combine_chunks().take(pa.array(order))
    idx, idf = vocabulary.column("idx").to_numpy()[order], vocabulary.column("idf").to_numpy()[order]
    find = Known(names)
    kinds = StructType([*[rows.schema[k] for k in keys], *StructType.fromDDL("vector struct<idx:array<int>,w:array<double>>").fields])
    kind = to_arrow_type(kinds["vector"].dataType)

    def apply(parts):
        for part in parts:
            row, term, tf = find(part.column("_words"))
            x = tf * idf[term]
            norm = np.sqrt(np.bincount(row, x * x, len(part))) + 1e-8
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(part)))]), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(v, t)) for v, t in ((idx[term], pa.int32()), (x / norm[row], pa.float64()))]
            vector = pa.StructArray.from_arrays(lists, ["idx", "w"]).cast(kind)
            yield pa.RecordBatch.from_arrays([*[part.column(k) for k in keys], vector], kinds.names)

    return rows.select(*keys, gram_words(F.col(text)).alias("_words")).mapInArrow(apply, kinds)
