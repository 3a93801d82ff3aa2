"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

The driver reads the vocabulary file once; the trie (arrays of the size of the
vocabulary) travels with the tasks. A space is the whitespace marker: it is
prepended to a text and kept as one byte inside pieces, so that no text is
rewritten. As no piece has a marker after another character, and none crosses
a line feed, the best segmentation of a text is that of its space-led stretches
one by one; every distinct stretch of a batch is solved once, all of them side
by side: the trie is walked from all bytes at once, then edges are relaxed in
the order of their offsets. A byte that no piece covers falls back to its byte
piece at a penalty. Decoding gives back the text's exact bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm import textbuf as tb

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
PENALTY = 10.0
MARKER = "▁"
CHUNK = 1 << 19
LONG = 1 << 15  # bytes of a stretch that is solved alone
NARROW = 48  # edges an offset, below which numpy's cost a call outweighs a plain loop


class DoubleArray:
    """A trie of byte strings: child = base[state] + byte where check[child] is state."""

    def __init__(self, keys: list[bytes], values: list[int]):
        tree: list[dict[int, int]] = [{}]
        value = [-1]
        for key, v in zip(keys, values, strict=True):
            at = 0
            for b in key:
                if b not in tree[at]:
                    tree[at][b] = len(tree)
                    tree.append({})
                    value.append(-1)
                at = tree[at][b]
            value[at] = v
        size = 2 * len(tree) + 1024
        used = np.zeros(size, bool)
        used[0] = True
        self.base, self.check, self.value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        place, low = {0: 0}, 1
        todo = [0]
        for node in todo:
            kids = tree[node]
            if not kids:
                continue
            codes = np.array(sorted(kids))
            if len(codes) > 1:
                at = low
                while True:
                    free = at + np.flatnonzero(~used[at : at + 4096])
                    b = free[free >= codes[0]] - codes[0]
                    if len(b):
                        if b[-1] + 256 >= len(used):
                            grow = len(used)
                            used = np.concatenate([used, np.zeros(grow, bool)])
                            self.base, self.check, self.value = (np.concatenate([a, np.full(grow, f, np.int32)]) for a, f in ((self.base, 0), (self.check, -1), (self.value, -1)))
                        ok = np.flatnonzero(~used[b[:, None] + codes[None, :]].any(1))
                        if len(ok):
                            base = int(b[ok[0]])
                            break
                    at += 4096
            else:
                free = low + np.flatnonzero(~used[low : low + 65536])
                base = int(free[free >= codes[0]][0] - codes[0])
            here = place[node]
            self.base[here] = base
            for c, child in kids.items():
                spot = base + c
                used[spot] = True
                self.check[spot] = here
                self.value[spot] = value[child]
                place[child] = spot
                todo.append(child)
            while used[low]:
                low += 1
            if low + 70_000 > len(used):
                grow = len(used)
                used = np.concatenate([used, np.zeros(grow, bool)])
                self.base, self.check, self.value = (np.concatenate([a, np.full(grow, f, np.int32)]) for a, f in ((self.base, 0), (self.check, -1), (self.value, -1)))
        last = int(np.flatnonzero(used)[-1]) + 257
        self.base, self.check, self.value = self.base[:last], self.check[:last], self.value[:last]


class Vocabulary:
    """Pieces with log scores. ``pieces``: (text, score, kind) by id, where
    kind is 'piece', 'byte' (text like <0x0A>) or 'control'. Pieces with a marker
    after another character, a space or a line feed are ``left_out``."""

    def __init__(self, pieces: list[tuple[str, float, str]]):
        self.bytes_of: list[bytes] = []
        self.byte_id = np.full(256, -1, np.int32)
        self.left_out: list[int] = []
        keys, ids = [], []
        self.score = np.zeros(len(pieces), np.float64)
        for i, (text, score, kind) in enumerate(pieces):
            raw = b""
            if kind == "byte":
                self.byte_id[int(text[3:5], 16)] = i
                raw = bytes([int(text[3:5], 16)])
            elif kind == "piece":
                body = text.lstrip(MARKER)
                raw = text.replace(MARKER, " ").encode()
                if MARKER in body or "\n" in text or " " in text:
                    self.left_out.append(i)  # it would join two stretches
                elif raw:
                    keys.append(raw)
                    ids.append(i)
                    self.score[i] = score
            self.bytes_of.append(raw)
        if (self.byte_id < 0).any():
            raise ValueError("the vocabulary needs all 256 byte pieces")
        self.fallback = float(self.score.min()) - PENALTY
        self.score[self.byte_id] = self.fallback
        self.trie = DoubleArray(keys, ids)
        self.longest = max(map(len, keys), default=1)
        self.flat = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.at = np.concatenate([[0], np.cumsum([len(b) for b in self.bytes_of])]).astype(np.int64)
        self.is_byte = np.zeros(len(pieces), bool)
        self.is_byte[self.byte_id] = True

    @classmethod
    def load(cls, path: str = MODEL) -> Vocabulary:
        """From a SentencePiece model file. A merge-ranked vocabulary has ranks
        instead of log scores; those become the logs of a Zipf law over ranks."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        kind = ["byte" if sp.is_byte(i) else "control" if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) else "piece" for i in range(n)]
        score = np.array([sp.get_score(i) for i in range(n)])
        normal = np.array([k == "piece" for k in kind])
        if (score[normal] == np.round(score[normal])).all():
            weight = 1 / (10 - score)
            score = np.log(weight / weight[normal].sum())
        found = cls([(sp.id_to_piece(i), float(score[i]), kind[i]) for i in range(n)])
        if found.left_out:
            raise ValueError(f"{len(found.left_out)} pieces of {path} join space-led stretches, which are solved one by one")
        return found

    def _matches(self, data: np.ndarray, n: int, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, lengths, ids) of all pieces that begin at one of the first n
        bytes and end by ``end``; byte pieces first, then by length."""
        pos, state, depth = np.arange(n), np.zeros(n, np.int64), 0
        starts, lengths, ids = [], [], []
        plain = np.ones(n, bool)
        trie = self.trie
        while len(pos):
            nxt = trie.base[state] + data[pos + depth].astype(np.int64)
            ok = trie.check[nxt] == state
            pos, state = pos[ok], nxt[ok]
            depth += 1
            v = trie.value[state]
            hit = v >= 0
            starts.append(pos[hit])
            lengths.append(np.full(int(hit.sum()), depth))
            ids.append(v[hit])
            if depth == 1:
                plain[pos[hit]] = False
            more = (pos + depth < end[pos]) & (trie.base[state] > 0)
            pos, state = pos[more], state[more]
        bare = np.flatnonzero(plain)
        return np.concatenate([bare, *starts]), np.concatenate([np.ones(len(bare), np.int64), *lengths]), np.concatenate([self.byte_id[data[bare]], *ids])

    def _long(self, data: np.ndarray) -> np.ndarray:
        """The best pieces of one long stretch, of which only scores and back
        pointers are held whole."""
        n = len(data)
        best, back, step = np.full(n + self.longest + 1, -np.inf), np.zeros(n + self.longest + 1, np.int32), np.zeros(n + self.longest + 1, np.int32)
        best[0] = 0
        for lo in range(0, n, LONG):
            m, to = min(LONG, n - lo), min(n, lo + LONG + self.longest)
            starts, lengths, ids = self._matches(data[lo:to], m, np.full(m, to - lo))
            order = np.argsort(starts, kind="stable")
            at = slice(lo, lo + LONG + self.longest + 1)
            self._relax(starts[order], lengths[order], ids[order], best[at], back[at], step[at])
        pieces, at = [], n
        for hi in range(n, 0, -LONG):
            lo = max(0, hi - LONG)
            b, s = back[lo : hi + 1].tolist(), step[lo : hi + 1].tolist()
            while at > lo:
                pieces.append(b[at - lo])
                at -= s[at - lo]
        return np.array(pieces[::-1], np.int32)

    def _viterbi(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of the best pieces of each stretch data[offs[i]:offs[i+1]]."""
        n, segs = len(data), len(offs) - 1
        size = np.diff(offs)
        seg = np.repeat(np.arange(segs), size)
        starts, lengths, ids = self._matches(data, n, offs[1:][seg])
        offset = (starts - offs[:-1][seg[starts]]).astype(np.int32)
        order = np.argsort(offset, kind="stable")
        starts, lengths, ids = starts[order] + seg[starts[order]], lengths[order], ids[order]
        score = self.score[ids]
        edge = np.searchsorted(offset[order], np.arange(int(size.max()) + 1 if segs else 1))
        best = np.full(n + segs, -np.inf)
        best[offs[:-1] + np.arange(segs)] = 0
        back = np.zeros(n + segs, np.int32)
        step = np.zeros(n + segs, np.int32)
        for k, (a, b) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)):
            if k >= 64 and b - a < NARROW:
                self._relax(starts[a:], lengths[a:], ids[a:], best, back, step)
                break
            to = starts[a:b] + lengths[a:b]
            cand = best[starts[a:b]] + score[a:b]
            better = np.flatnonzero(cand > best[to])
            to = to[better]
            best[to], back[to], step[to] = cand[better], ids[a:b][better], lengths[a:b][better]
        alive = np.flatnonzero(size)
        cur, first = offs[1:][alive] + alive, offs[:-1][alive] + alive
        trail, count, tails = [], np.zeros(segs, np.int64), []
        while len(alive):
            if len(alive) < NARROW and len(trail) >= 64:
                tails = self._walk(alive, cur, first, back, step)
                for who, got in tails:
                    count[who] += len(got)
                break
            trail.append((alive, back[cur]))
            count[alive] += 1
            cur = cur - step[cur]
            on = cur > first
            alive, cur, first = alive[on], cur[on], first[on]
        at = np.concatenate([[0], np.cumsum(count)])
        out = np.zeros(at[-1], np.int32)
        for k, (who, got) in enumerate(trail):
            out[at[1:][who] - 1 - k] = got
        for who, got in tails:
            out[at[who] : at[who] + len(got)] = got
        return out, at

    def _relax(self, starts, lengths, ids, best, back, step) -> None:
        """The edges of the few longest stretches, one by one in their order."""
        held, prev, took = best.tolist(), {}, {}
        for a, n, i, x in zip(starts.tolist(), lengths.tolist(), ids.tolist(), self.score[ids].tolist(), strict=True):
            if held[a] + x > held[a + n]:
                held[a + n] = held[a] + x
                prev[a + n], took[a + n] = i, n
        best[:] = held
        at = np.fromiter(prev, np.int64, len(prev))
        back[at] = np.fromiter(prev.values(), np.int32, len(prev))
        step[at] = np.fromiter(took.values(), np.int32, len(took))

    @staticmethod
    def _walk(alive, cur, first, back, step) -> list[tuple[int, list[int]]]:
        """The pieces still to come of the few longest stretches, from their begins."""
        out = []
        for who, at, begin in zip(alive.tolist(), cur.tolist(), first.tolist(), strict=True):
            got, b, s = [], back[begin : at + 1].tolist(), step[begin : at + 1].tolist()
            at -= begin
            while at > 0:
                got.append(b[at])
                at -= s[at]
            out.append((who, got[::-1]))
        return out

    def encode_slices(self, column: pa.Array):
        """(first text, past the last, ids, offsets) of runs of whole texts; null
        and empty texts have no pieces. A run holds about CHUNK bytes; a longer
        text is a run of its own that is solved block by block, as a cut before
        a space or around a line feed changes no piece."""
        data, offsets = tb.buffers(column)
        for i, j, part, offs in tb.chunks(data, offsets, CHUNK):
            if len(part) <= 2 * CHUNK:
                yield i, j, *self._encode(part, offs, True)
                continue
            found, lo = [], 0
            while lo < len(part):
                hi = min(lo + CHUNK, len(part))
                if hi < len(part):
                    at = self._cuts(part, lo + 1, hi)
                    while not len(at) and hi < len(part):  # one stretch longer than a block
                        at, hi = self._cuts(part, hi, hi + CHUNK)[:1], min(hi + CHUNK, len(part))
                    hi = int(at[-1]) if len(at) else len(part)
                block = part[lo:hi]
                if hi - lo > CHUNK:
                    found.append(self._long(block if lo else np.concatenate([np.array([0x20], np.uint8), block])))
                else:  # the marker stands before a text, not before its later blocks
                    found.append(self._encode(block, np.array([0, hi - lo]), lo == 0)[0])
                lo = hi
            ids = np.concatenate(found)
            yield i, j, ids, np.array([0, len(ids)])

    @staticmethod
    def _cuts(part: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """Places in [lo, hi) where a stretch begins (not all of those at a line feed)."""
        here, before = part[lo:hi], part[lo - 1 : min(hi, len(part)) - 1]
        return lo + np.flatnonzero((here == 0x0A) | ((here == 0x20) & (before != 0x20)))

    def _encode(self, part: np.ndarray, offs: np.ndarray, mark: bool) -> tuple[np.ndarray, np.ndarray]:
        docs, size = len(offs) - 1, np.diff(offs)
        full = (size > 0) & mark
        lead = np.cumsum(full)
        text = np.full(len(part) + int(full.sum()), 0x20, np.uint8)
        text[np.arange(len(part)) + np.repeat(lead, size)] = part
        begin = offs[:-1] + lead - full  # where a text's marker stands
        cut = np.zeros(len(text) + 1, bool)
        space, line = text == 0x20, text == 0x0A
        cut[1:-1] = space[1:] & ~space[:-1]
        cut[:-1] |= line
        cut[1:] |= line
        cut[begin[size > 0]] = True
        starts = np.flatnonzero(cut[:-1])
        ends = np.append(starts[1:], len(text))
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(docs + 1, np.int64)
        h = tb.span_hash(tb.prefix_hash(text), starts, ends)
        _, one, which = np.unique(h, return_index=True, return_inverse=True)
        size1 = (ends - starts)[one]
        big = np.flatnonzero(size1 > LONG)
        short = np.where(size1 > LONG, 0, size1)
        soff = np.concatenate([[0], np.cumsum(short)])
        flat = text[np.arange(soff[-1]) + np.repeat(starts[one] - soff[:-1], short)]
        ids, at = self._viterbi(flat, soff)
        for k in big.tolist():
            own = self._long(text[starts[one[k]] : ends[one[k]]])
            ids = np.concatenate([ids[: at[k]], own, ids[at[k] :]])
            at[k + 1 :] += len(own)
        n = np.diff(at)[which]
        total = np.concatenate([[0], np.cumsum(n)])
        ids = ids[np.arange(total[-1]) + np.repeat(at[:-1][which] - total[:-1], n)]
        return ids, total[np.searchsorted(starts, np.append(begin, len(text)))]

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of all texts together."""
        parts, bounds = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
        for _, _, ids, at in self.encode_slices(column):
            parts.append(ids)
            bounds.append(at[1:] + bounds[-1][-1])
        return np.concatenate(parts), np.concatenate(bounds)

    def decode_flat(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, offsets) of the texts of id runs, without their leading marker."""
        size = self.at[1:][ids] - self.at[ids]
        total = np.concatenate([[0], np.cumsum(size)])
        raw = self.flat[np.arange(total[-1]) + np.repeat(self.at[ids] - total[:-1], size)]
        bounds = total[offsets]
        full = bounds[1:] > bounds[:-1]
        lead = bounds[:-1][full]
        keep = np.ones(len(raw), bool)
        keep[lead[raw[lead] == 0x20]] = False
        gone = np.concatenate([[0], np.cumsum(~keep)])
        return raw[keep], bounds - gone[bounds]

    def decodes_to(self, ids: np.ndarray, raw: np.ndarray) -> bool:
        """Whether the ids of one text decode to the bytes ``raw``."""
        at = 0
        for lo in range(0, len(ids), LONG):
            some = ids[lo : lo + LONG]
            size = self.at[1:][some] - self.at[some]
            total = np.concatenate([[0], np.cumsum(size)])
            got = self.flat[np.arange(total[-1]) + np.repeat(self.at[some] - total[:-1], size)]
            got = got[1:] if lo == 0 and len(got) and got[0] == 0x20 else got
            if not np.array_equal(got, raw[at : at + len(got)]):
                return False
            at += len(got)
        return at == len(raw)


def encode(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text", out: str = "piece_ids") -> DataFrame:
    """``docs`` without its text and with the array ``out`` of piece ids.

    Null and empty texts have empty arrays. Every row is encoded on its own, so
    repeated rows, null ids and empty tables need no rule; all other columns
    stay (one named like ``out`` is replaced). Of segmentations with one score
    that whose last piece begins first counts, from the end on. Texts of any
    length are solved in blocks, and so is one unbroken word.
    """
    docs = docs.drop(out)
    at = docs.columns.index(text_col)
    rest = [i for i in range(len(docs.columns)) if i != at]
    fields = [docs.schema.fields[i] for i in rest]
    names = [f.name for f in fields] + [out]

    def run(batches):
        for batch in batches:
            for i, j, ids, offsets in vocabulary.encode_slices(batch.column(at).cast(pa.string())):
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in rest), lists], names)

    return docs.mapInArrow(run, T.StructType([*fields, T.StructField(out, T.ArrayType(T.IntegerType()))]))


def decode(rows: DataFrame, vocabulary: Vocabulary, ids_col: str = "piece_ids", out: str = "text") -> DataFrame:
    """``rows`` with the text ``out`` of their piece ids in place of these; null ids: null."""
    rows = rows.drop(out)
    at = rows.columns.index(ids_col)
    rest = [i for i in range(len(rows.columns)) if i != at]
    fields = [rows.schema.fields[i] for i in rest]

    def run(batches):
        for batch in batches:
            col = batch.column(at)
            offs = col.offsets.to_numpy().astype(np.int64)
            raw, bounds = vocabulary.decode_flat(col.values.to_numpy()[offs[0] : offs[-1]], offs - offs[0])
            texts = pa.StringArray.from_buffers(len(col), pa.py_buffer(bounds.astype(np.int32).tobytes()), pa.py_buffer(raw.tobytes()))
            texts = pa.compute.if_else(col.is_valid(), texts, None)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in rest), texts], [*(f.name for f in fields), out])

    return rows.mapInArrow(run, T.StructType([*fields, T.StructField(out, T.StringType())]))


def encoding_digests(spark: SparkSession, docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_pieces, n_byte_pieces, ids_sha256, round_trip) of every row;
    ids as little-endian 32-bit integers, round_trip: decoding gives the bytes back.
    A null text is empty, and an empty one has no pieces; rows with a null id and
    repeated rows each give a row. An empty table gives none."""
    import hashlib

    def run(batches):
        for batch in batches:
            text = batch.column("text").cast(pa.string())
            data, offsets = tb.buffers(text)
            for first, past, ids, at in vocabulary.encode_slices(text):
                sha, same, byte = [], [], []
                for i in range(past - first):
                    own, raw = ids[at[i] : at[i + 1]], data[offsets[first + i] : offsets[first + i + 1]]
                    sha.append(hashlib.sha256(own).hexdigest())
                    byte.append(int(vocabulary.is_byte[own].sum()))
                    same.append(vocabulary.decodes_to(own, raw))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(first, past - first), pa.array(np.diff(at)), pa.array(byte, pa.int64()), pa.array(sha, pa.string()), pa.array(same, pa.bool_())], ["id", "n_pieces", "n_byte_pieces", "ids_sha256", "round_trip"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, n_pieces long, n_byte_pieces long, ids_sha256 string, round_trip boolean").withColumnRenamed("id", id_col)
