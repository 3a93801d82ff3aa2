"""N-gram Jaccard join: which texts share almost all of their word shingles.

Method. A text's set is its distinct word shingles as 64-bit hashes. Equal
sets collapse into one representative. A Jaccard bound t forces two linked
sets to share one of the first n - ceil(t n) + 1 elements of any common order;
the order used puts elements of rarely hit hash buckets first (counted over
all texts), so these prefixes avoid common passages. Then twice the same join
in size-banded tiles (``_joined``):

1. The sets that share a prefix element are a group. Hashed bitmaps, as wide as
   a set needs, bound the overlap of two sets from above (every bit set on one
   side alone is an element that the other lacks). Pairs with room for a link
   connect; a tile returns only who belongs together, a row a member at most.
2. What stage 1 connects is a group, so that every set travels once. Wider
   bitmaps bound the overlap again, and pairs that pass are intersected exactly.

Two sets that are connected already need no check, as it can't change a
component, and so a family of near copies costs about a comparison a member. No
other pair is skipped: the components are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import textbuf as tb
from quillspark.llm.components import connected_components
from quillspark.scratch import Scratch, restrict

BUCKETS = 1 << 16
COARSE, FINE = 2, 8  # bits an element, at least
TILE_BYTES = 4 << 20
NEAR = 48
_MUL = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0xC2B2AE3D27D4EB4F], np.uint64)


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """For each text, its sorted distinct shingle hashes (A-Z lower-cased).

    Fewer words than ``size``: the whole sequence as one. No words or null:
    empty.
    """
    data, offsets = tb.buffers(column)
    for _, _, part, offs in tb.chunks(data, offsets):
        starts, ends, first = tb.words(part := tb.LOWER[part], offs)
        if len(starts) == 0:
            for _ in range(len(offs) - 1):
                yield np.zeros(0, np.uint64)
            continue
        h = tb.span_hash(tb.prefix_hash(part), starts, ends)
        long = np.zeros(len(h), np.uint64)
        for k in range(min(size, len(h))):  # all texts of a chunk together may have fewer words
            long[: len(h) - k] += h[k:] * _MUL[k % 8] * np.uint64(2 * (k // 8) + 1)
        long = tb.mix(long)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= size:
                yield np.unique(long[a : b - size + 1])
            elif b == a:
                yield np.zeros(0, np.uint64)
            else:
                rest = h[a:b] * _MUL[: b - a] if b - a <= 8 else h[a:b] * tb.powers(b - a + 1)[1:]
                yield tb.mix(np.array([rest.sum(dtype=np.uint64) + np.uint64(b - a)], np.uint64))


def _need(n: np.ndarray | int, percent: int):
    """The least overlap of two sets, of n elements together, that link."""
    return -(-percent * n // (100 + percent))


def _counts(size: int):
    def run(batches):
        counts = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            fresh = []
            for s in shingle_sets(batch.column("text"), size):
                fresh.append(s)
                if len(fresh) == 500:
                    counts += np.bincount((np.concatenate(fresh) & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
                    fresh = []
            if fresh:
                counts += np.bincount((np.concatenate(fresh) & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
        hit = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(counts[hit])], ["bucket", "n"])

    return run


def _width(n: int, per: int) -> int:
    """Bits of the bitmap of n elements: the power of two from per * n on."""
    return max(256, 1 << int(per * n - 1).bit_length())


def _bitmap(s: np.ndarray, per: int) -> bytes:
    width = _width(len(s), per)
    bits = np.zeros(width, bool)
    bits[((s >> np.uint64(20)) & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def _signatures(size: int, percent: int, rank: np.ndarray):
    """(id, n, f1, f2, keys, bits): f1 and f2 tell sets apart, keys are the prefix."""

    def run(batches):
        for batch in batches:
            for i, part in enumerate(_slices(batch)):
                n, f1, f2, keys, bits = [], [], [], [], []
                for s in shingle_sets(part.column("text"), size):
                    n.append(len(s))
                    f1.append(s.sum(dtype=np.uint64))
                    f2.append(np.bitwise_xor.reduce(tb.mix(s + np.uint64(0x51ED27))) if len(s) else 0)
                    take = len(s) - (-(-percent * len(s) // 100)) + 1 if len(s) else 0
                    keys.append(s[np.argsort(rank[(s & np.uint64(BUCKETS - 1)).astype(np.int64)], kind="stable")[:take]])
                    bits.append(_bitmap(s, COARSE))
                at = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
                flat = pa.array(tb.signed(np.concatenate([np.zeros(0, np.uint64), *keys])))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(n, pa.int64()), *(pa.array(np.array(f, np.uint64).view(np.int64)) for f in (f1, f2)), pa.ListArray.from_arrays(pa.array(at), flat), pa.array(bits, pa.binary())], ["id", "n", "f1", "f2", "keys", "bits"])

    return run


def _slices(batch, rows: int = 1000):
    for lo in range(0, len(batch), rows):
        yield batch.slice(lo, rows)


def _arrays(size: int):
    def run(batches):
        for batch in batches:
            for part in _slices(batch):
                sets = list(shingle_sets(part.column("text"), size))
                at = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                flat = pa.array(tb.signed(np.concatenate([np.zeros(0, np.uint64), *sets])))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(np.diff(at).astype(np.int64)), pa.ListArray.from_arrays(pa.array(at), flat)], ["id", "n", "s"])

    return run


class Bitmaps:
    """Bitmaps of the rows of a table, compared at the smaller width of a pair."""

    def __init__(self, n: np.ndarray, bits: list[bytes]):
        self.n, self.width = n, np.array([8 * len(b) for b in bits], np.int64)
        self.place = np.zeros(len(n), np.int64)
        self.rows: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for w in np.unique(self.width).tolist():
            own = np.flatnonzero(self.width == w)
            self.place[own] = np.arange(len(own))
            m = np.frombuffer(b"".join(bits[i] for i in own.tolist()), np.uint64).reshape(len(own), -1)
            self.rows[w, w] = m, np.bitwise_count(m).sum(1, dtype=np.int64)

    def _folded(self, w: int, to: int):
        if (w, to) not in self.rows:
            m = self._folded(w, 2 * to)[0]
            m = m[:, : m.shape[1] // 2] | m[:, m.shape[1] // 2 :]
            self.rows[w, to] = m, np.bitwise_count(m).sum(1, dtype=np.int64)
        return self.rows[w, to]

    def room(self, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
        """Whether the bitmaps of the rows i[k] and j[k] leave room for a link."""
        out = np.zeros(len(i), bool)
        pair = self.width[i] << 32 | self.width[j]
        for p in np.unique(pair).tolist():
            at = np.flatnonzero(pair == p)
            w, v = p >> 32, p & 0xFFFFFFFF
            (x, ones_x), (y, ones_y) = self._folded(w, min(w, v)), self._folded(v, min(w, v))
            step = max(1, (1 << 23) // x.shape[1])
            for lo in range(0, len(at), step):
                some = at[lo : lo + step]
                a, b, na, nb = self.place[i[some]], self.place[j[some]], self.n[i[some]], self.n[j[some]]
                both = np.bitwise_count(x[a] & y[b]).sum(1, dtype=np.int64)
                out[some] = np.minimum(na - ones_x[a], nb - ones_y[b]) + both >= _need(na + nb, percent)
        return out


class Sets:
    """Sorted sets of the rows of a table; bitmaps first, then intersections."""

    def __init__(self, n: np.ndarray, flat: np.ndarray, at: np.ndarray):
        self.n, self.flat, self.at = n, flat, at
        self.bits = Bitmaps(n, [_bitmap(flat[a:b], FINE) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)])

    def room(self, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
        out = self.bits.room(i, j, percent)
        for k in np.flatnonzero(out).tolist():
            a, b = self.flat[self.at[i[k]] : self.at[i[k] + 1]], self.flat[self.at[j[k]] : self.at[j[k] + 1]]
            at = np.minimum(np.searchsorted(a, b), len(a) - 1)
            common = int((a[at] == b).sum())
            out[k] = 100 * common >= percent * (len(a) + len(b) - common)
        return out


def _merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each the place of a row with that label) after joining the rows a[k] and b[k]."""
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            return label
        low = np.minimum(x, y)
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while not np.array_equal(label, up := label[label]):
            label = up


def connect(test, n: np.ndarray, label: np.ndarray, side: np.ndarray, lo: np.ndarray, hi: np.ndarray, percent: int) -> np.ndarray:
    """Labels of the rows of the groups [lo, hi), each sorted by side and then n,
    after joining all pairs that pass ``test``: all pairs of rows of side 0, and
    pairs of a row of side 1 with one of side 2."""
    size = hi - lo
    two = side[lo] > 0
    past = np.repeat(hi, size)
    small = np.repeat((size <= NEAR) & ~two, size)
    top = 100 * n // percent  # the largest size that can link
    i = np.flatnonzero(small)
    for d in range(1, NEAR):
        i = i[i + d < past[i]]
        i = i[n[i + d] <= top[i]]  # sizes rise within a group
        if not len(i):
            break
        at = i[label[i] != label[i + d]]
        at = at[test(at, at + d, percent)] if len(at) else at
        if len(at):
            label = _merged(label, at, at + d)
    for a, b, cross in zip(lo.tolist(), hi.tolist(), two.tolist(), strict=True):
        if b - a <= NEAR and not cross:
            continue
        cut = a + int(np.searchsorted(side[a:b], 2))
        for i in range(a, cut if cross else b):
            # Of one side the later rows; of two, all that the size allows.
            first = i + 1 if not cross else cut + int(np.searchsorted(n[cut:b], -(-percent * n[i] // 100)))
            last = (cut if cross else a) + int(np.searchsorted(n[cut:b] if cross else n[a:b], top[i], "right"))
            for at in range(first, last, 4096):
                j = np.arange(at, min(last, at + 4096))
                j = j[label[j] != label[i]]
                if len(j):
                    j = j[test(np.full(len(j), i), j, percent)]
                    if len(j):
                        label = _merged(label, np.full(len(j), i), j)
    return label


def _whole_groups(batches, columns: list[str]):
    """Tables whose groups (runs of equal ``columns``) are whole; what is held
    back between them is one group, which tiles bound."""
    held = []
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        table = pa.Table.from_batches(held)
        marks = np.stack([table.column(c).to_numpy() for c in columns])
        cut = np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(0))
        if len(cut):
            yield table.slice(0, int(cut[-1]) + 1), marks[:, : cut[-1] + 1]
            held = table.slice(int(cut[-1]) + 1).combine_chunks().to_batches()
    if held:
        table = pa.Table.from_batches(held)
        yield table, np.stack([table.column(c).to_numpy() for c in columns])


_TILE = ["grp", "band", "slot", "part"]


def _tiles(percent: int):
    """Who belongs together, of rows sorted by (tile, side, n): (a, b) with the
    least component of those that a tile connects and each other one."""

    def run(batches):
        for table, marks in _whole_groups(batches, _TILE):
            n, comp, side = (table.column(c).to_numpy().astype(np.int64) for c in ("n", "comp", "side"))
            if "bits" in table.column_names:
                test = Bitmaps(n, table.column("bits").to_pylist())
            else:
                s = table.column("s").combine_chunks()
                at = s.offsets.to_numpy().astype(np.int64)
                test = Sets(n, s.values.to_numpy().view(np.uint64)[at[0] : at[-1]], at - at[0])
            edge = np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(0)) + 1
            lo, hi = np.concatenate([[0], edge]), np.concatenate([edge, [len(n)]])
            # Rows of one component in one tile share a label from the start.
            tile = np.repeat(np.arange(len(lo)), hi - lo)
            order = np.lexsort((np.arange(len(n)), comp, tile))
            new = np.ones(len(n), bool)
            new[1:] = (tile[order][1:] != tile[order][:-1]) | (comp[order][1:] != comp[order][:-1])
            label = np.empty(len(n), np.int64)
            label[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
            label = connect(test.room, n, label, side, lo, hi, percent)
            least = np.full(len(n), np.iinfo(np.int64).max)
            np.minimum.at(least, label, comp)
            pairs = np.stack([least[label], comp], 1)
            pairs = np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return run


def _joined(scratch: Scratch, rows: DataFrame, payload: DataFrame, weight: F.Column, percent: int, name: str) -> DataFrame:
    """Connected ids (a, b) among the rows (grp, id, n) that share a group.

    ``payload`` holds (id, n, bits or s), some ``weight`` bytes each. A group up
    to TILE_BYTES is one tile. A larger one is cut into bands of sizes, so that
    links stay within a band or reach the next, and bands into slots by hash; a
    row first meets its tile and the group's least id, and then rows outside
    the group's largest component meet the tiles of their own and the next bands.
    """
    tiles = lambda w: F.greatest(F.lit(1), F.ceil(w / F.lit(TILE_BYTES))).cast("int")
    ends = rows.groupBy("grp").agg(F.min("id").alias("hub"), F.max("id").alias("top")).where("hub <> top").drop("top")
    live = scratch.keep(rows.join(ends, "grp"), f"{name}-live")
    scratch.release()
    # Groups of the same members (by 128 bits of hash) are one.
    marks = [F.bit_xor(F.xxhash64(*x)).alias(c) for c, x in (("x", ["id"]), ("y", [F.lit(1), F.col("id")]))]
    sums = live.groupBy("grp").agg(F.min("hub").alias("hub"), F.count("*").alias("k"), F.sum(weight).alias("w"), *marks)
    kinds = sums.groupBy("hub", "k", "w", "x", "y").agg(F.min("grp").alias("grp")).select("grp", (F.col("w") > TILE_BYTES).alias("hot"))
    placed = scratch.keep(live.join(kinds, "grp"), f"{name}-rows")
    scratch.release()
    scratch.drop(live)
    none = F.lit(0)
    first = placed.where("NOT hot").select("grp", none.alias("band"), none.alias("slot"), "id")
    hot = not placed.where("hot").isEmpty()
    if hot:
        # A little wider than the ratio of sizes that link, whatever the rounding.
        band = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(1.001 * np.log(max(100 / percent, 1.01))))).cast("int")
        large = placed.where("hot").withColumn("band", band).withColumn("w", weight)
        bands = scratch.keep(large.groupBy("grp", "band").agg(F.min("hub").alias("hub"), tiles(F.sum("w")).alias("slots")), f"{name}-bands")
        dealt = large.drop("hub").join(bands, ["grp", "band"]).withColumn("slot", F.pmod(F.xxhash64("id"), "slots").cast("int")).select("grp", "band", "slot", "slots", "id", "w")
        dealt = scratch.keep(dealt, f"{name}-dealt")
        hubs = bands.select("grp", "band", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"), F.col("hub").alias("id"))
        first = first.union(dealt.select("grp", "band", "slot", "id")).union(hubs)

    def solved(tiled: DataFrame) -> DataFrame:
        held = tiled.join(payload, "id").repartition(*_TILE).sortWithinPartitions(*_TILE, "side", "n", "id")
        out = scratch.keep(held.mapInArrow(_tiles(percent), "a long, b long").distinct(), f"{name}-links")
        scratch.release()
        return out

    links = solved(first.select("grp", "band", "slot", none.alias("part"), none.alias("side"), "id", F.col("id").alias("comp")))
    if not hot:
        scratch.drop(placed)
        return links
    comps = connected_components(links, scratch).select(F.col("node").alias("id"), "component")
    known = scratch.keep(dealt.join(comps, "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component"), f"{name}-known")
    most = known.groupBy("grp", "comp").agg(F.sum("w").alias("w")).groupBy("grp").agg(F.max_by("comp", F.struct("w", "comp")).alias("main"))
    apart = scratch.keep(known.join(most, "grp").where("comp <> main").select("grp", F.col("band").alias("own"), "id", "comp", "w"), f"{name}-apart")
    if apart.isEmpty():
        return links
    asked = apart.join(bands.select("grp", "band", "slots"), "grp").where("abs(own - band) <= 1")
    parts = asked.groupBy("grp", "band").agg(tiles(F.sum("w")).alias("parts"))
    left = asked.join(parts, ["grp", "band"]).select("grp", "band", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"), F.pmod(F.xxhash64("id", F.lit(1)), "parts").cast("int").alias("part"), F.lit(1).alias("side"), "id", "comp")
    right = known.join(parts, ["grp", "band"]).select("grp", "band", "slot", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(2).alias("side"), "id", "comp")
    return links.union(solved(left.union(right)))


def jaccard_components(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: (id, n_shingles, component_id).

    Two texts link when 100 * intersection >= ``percent`` * union of their
    sets; component_id is the smallest id reachable. Texts that are null or
    without words link with nothing and are their own component. A null id
    gets a null component. Rows that repeat an id belong to one component.
    An empty table gives no rows. Memory grows with the longest text, some 100
    bytes a byte of it. Other columns of ``docs`` are ignored.
    """
    scratch = Scratch(spark, "jaccard")
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # At most BUCKETS rows, whatever the input.
    counts = np.zeros(BUCKETS, np.int64)
    found = base.select("text").mapInArrow(_counts(size), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    rank = np.empty(BUCKETS, np.uint16)
    rank[np.lexsort((np.arange(BUCKETS), counts))] = np.arange(BUCKETS)

    signed = scratch.keep(base.mapInArrow(_signatures(size, percent, rank), "id long, n long, f1 long, f2 long, keys array<long>, bits binary"), "signatures")
    sets, full = scratch.keep(signed.select("id", "n"), "sets"), signed.where("n > 0 AND id IS NOT NULL")
    classes = full.groupBy("f1", "f2", "n").agg(F.min("id").alias("rep"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    copies = scratch.keep(full.select("id", "f1", "f2", "n").join(classes, ["f1", "f2", "n"]).where("id <> rep").distinct(), "copies")
    reps = scratch.keep(restrict(full, copies.drop("rep"), ["id", "f1", "f2", "n"], "left_anti").drop("f1", "f2"), "classes")
    scratch.release()
    scratch.drop(signed)

    keyed = reps.select(F.explode("keys").alias("grp"), "id", "n")
    bits = reps.select("id", "n", "bits")
    likely = connected_components(_joined(scratch, keyed, bits, F.col("n") / 2 + 100, percent, "likely"), scratch).withColumnsRenamed({"node": "id", "component": "grp"})
    near = restrict(base, likely.select("id"), "id")
    whole = scratch.keep(near.mapInArrow(_arrays(size), "id long, n long, s array<long>").where("n > 0"), "whole")
    scratch.release()
    scratch.drop(reps)
    rows = likely.join(whole.select("id", "n"), "id").select("grp", "id", "n")
    links = _joined(scratch, rows, whole, 8 * F.col("n") + 100, percent, "exact").union(copies.select(F.col("id").alias("a"), F.col("rep").alias("b")))
    final = connected_components(links, scratch)
    scratch.drop(whole, links)
    return sets.select("id", F.col("n").alias("n_shingles")).join(final.withColumnRenamed("node", "id"), "id", "left").select("id", "n_shingles", F.coalesce("component", "id").alias("component_id"))
