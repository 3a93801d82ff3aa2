"""Phrase mining: weighted n-gram counts per hash bucket, scored against their parts.

1. Texts are cut into pieces at punctuation and line ends; identical pieces of a
   language become one row with a multiplicity, so that a passage copied many
   times is cut into n-grams once.
2. Every few megabytes of pieces are counted in their task, on exact word
   numbers, and the sums packed by hash bucket of (language, phrase): a row a
   bucket, compressed. The shuffle brings a bucket's packs together, where
   duckdb sums them out of core: it spills to a folder of the task, which is
   gone with it. Phrases below the least count end there, all others are written.
3. A candidate needs the counts of its parts, which lie in other buckets: for
   each cut it sends a request by (language, part), the join answers it, and
   answers meet again by candidate. So do the counts that longer candidates
   send to the phrases inside them. Spark splits hot parts of these joins.

Counts are exact: hashes only choose buckets. Products are decimals of 38 digits.
"""

from __future__ import annotations

import tempfile
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.llm import textbuf as tb
from quillspark.scratch import Scratch

LEAST, LONGEST, TOP = 10, 3, 2000
INSIDE_PERCENT = 50
SCALE = 1_000_000
WINDOW_WORDS = 1 << 20
PACK_BYTES = 6 << 20
DUCKDB_MEMORY = "256MB"
BUCKETS_A_PARTITION = 4
INSERT_ROWS = 1 << 18
SALTS = 32
_STEP = np.uint64(0x9E3779B97F4A7C15)
COUNT = "decimal(15,0)"  # a count; scale * count * count has at most 38 digits

ENDS = np.zeros(256, bool)
ENDS[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
GAPS = ENDS.copy()
GAPS[[0x20, 0x09]] = True


def cut_pieces(column: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """For each run of texts, their pieces and the text of each. A piece is its
    words, A-Z lower-cased, each followed by one space."""
    data, offsets = tb.buffers(column)
    for i, j, part, offs in tb.chunks(data, offsets):
        n = j - i
        raw = np.full(len(part) + n, 10, np.uint8)  # a line end after each text
        raw[np.arange(len(part)) + np.repeat(np.arange(n), np.diff(offs))] = tb.LOWER[part]
        inside = ~GAPS[raw]
        after = np.zeros(len(raw), bool)
        after[1:] = inside[:-1] & ~inside[1:]
        starts = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
        if not len(starts):
            continue
        ends_before = np.cumsum(ENDS[raw])[starts]
        heads = np.flatnonzero(np.concatenate([[True], np.diff(ends_before) > 0]))
        keep = inside | after
        place = np.cumsum(keep) - 1
        words = np.where(inside, raw, 32)[keep].astype(np.uint8)
        bounds = np.append(place[starts[heads]], len(words)).astype(np.int32)
        text_of = np.searchsorted(offs + np.arange(n + 1), starts[heads], "right") - 1
        yield pa.StringArray.from_buffers(len(heads), pa.py_buffer(bounds), pa.py_buffer(words)), i + text_of


def _pieces(batches):
    for batch in batches:
        for pieces, text_of in cut_pieces(batch.column("text")):
            rows = pa.table([batch.column("lang").take(pa.array(text_of)), pieces], ["lang", "piece"])
            counted = rows.group_by(["lang", "piece"]).aggregate([([], "count_all")]).rename_columns(["lang", "piece", "m"])
            yield from counted.combine_chunks().to_batches()


def distinct_pieces(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, piece, m): the distinct pieces of each language, with their number."""
    narrow = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(_pieces, "lang string, piece string, m long").groupBy("lang", "piece").agg(F.sum("m").alias("m"))


def _joined(a: pa.Array, b: pa.Array | pa.Scalar, between: str) -> pa.Array:
    return pc.binary_join_element_wise(a, b, pa.scalar(between, pa.large_string()))


def weighted_ngrams(pieces: pa.Array, m: np.ndarray, longest: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(phrases, weights, hashes) of 1 to ``longest`` words, summed within runs
    of WINDOW_WORDS words; a run goes on for ``longest`` - 1 words that begin no
    phrase, so that a longer piece loses none."""
    data, offsets = tb.buffers(pieces)
    ends = np.flatnonzero(data == 32) + 1
    starts = np.append(0, ends[:-1]) if len(ends) else ends
    piece = np.searchsorted(offsets, starts, "right") - 1
    words = pa.LargeStringArray.from_buffers(len(ends), pa.py_buffer(np.append(0, ends).astype(np.int64)), pa.py_buffer(data))
    for lo in range(0, len(ends), WINDOW_WORDS):
        hi = min(len(ends), lo + WINDOW_WORDS + longest - 1)
        coded = words.slice(lo, hi - lo).dictionary_encode()
        ids = coded.indices.to_numpy().astype(np.int64)
        known = coded.dictionary
        raw, bounds = tb.buffers(known)
        hashes = tb.span_hash(tb.prefix_hash(raw), bounds[:-1], bounds[1:])
        own = piece[lo:hi]
        at = np.arange(min(len(ids), WINDOW_WORDS))
        of, texts, sums_of = ids[at], known, hashes  # gram of each place; its text and hash
        for n in range(1, longest + 1):
            if n > 1:
                goes_on = at + n - 1 < len(own)
                goes_on[goes_on] = own[at[goes_on]] == own[at[goes_on] + n - 1]
                at, of = at[goes_on], of[goes_on]
                pairs, first, inverse = np.unique(of * len(known) + ids[at + n - 1], return_index=True, return_inverse=True)
                left, right = of[first], ids[at[first] + n - 1]
                texts = _joined(texts.take(pa.array(left)), known.take(pa.array(right)), "")
                sums_of, of = tb.mix(sums_of[left] * _STEP + hashes[right]), inverse
            if not len(at):
                break
            order = np.argsort(of, kind="stable")
            head = np.flatnonzero(np.append(True, np.diff(of[order]) > 0))
            seen = of[order][head]
            yield texts if len(seen) == len(texts) else texts.take(pa.array(seen)), np.add.reduceat(m[own[at]][order], head), sums_of[seen]


def _n_words(part: pa.Table) -> int:
    data, offsets = tb.buffers(part.column("piece"))
    return int((np.diff(np.append(0, np.cumsum(data == 32))[offsets]) * part.column("m").to_numpy()).sum())


def _packs(buckets: int, longest: int):
    """Rows (bucket, langs, runs, size, phrases, weights): phrases that end in line
    ends, ``size`` bytes before compression, their weights, and how many in turn
    are of which language. A row without phrases has the number of all words of
    its language in ``size``."""
    kinds = pa.schema([("bucket", pa.int32()), ("langs", pa.list_(pa.string())), ("runs", pa.list_(pa.int32())), ("size", pa.int64()), ("phrases", pa.binary()), ("weights", pa.binary())])

    def of(rows: pa.Table):
        codec = pa.Codec("zstd", 3)
        rows = rows.sort_by("lang").combine_chunks()
        runs = pc.run_end_encode(rows.column("lang").combine_chunks())
        langs, out, lo = runs.values.to_pylist(), [], 0
        texts, weights, buckets_of, lang_of = [], [], [], []
        for k, (hi, lang) in enumerate(zip(runs.run_ends.to_pylist(), langs, strict=True)):
            part, salt = rows.slice(lo, hi - lo), zlib.crc32(lang.encode())
            lo = hi
            out.append((salt % buckets, [lang], [0], _n_words(part), None, None))
            for t, w, h in weighted_ngrams(part.column("piece").combine_chunks(), part.column("m").combine_chunks().to_numpy(), longest):
                texts.append(t)
                weights.append(w)
                buckets_of.append((tb.mix(h + np.uint64(salt)) % np.uint64(buckets)).astype(np.int32))
                lang_of.append(np.full(len(w), k, np.int32))
        if texts:
            bucket, of_lang = np.concatenate(buckets_of), np.concatenate(lang_of)
            order = np.argsort(bucket, kind="stable")  # languages stay in turn within a bucket
            whole = _joined(pa.chunked_array(texts).combine_chunks(), pa.scalar("", pa.large_string()), "\n")
            data, offs = tb.buffers(whole.take(pa.array(order)))
            weight, bucket, of_lang = np.concatenate(weights)[order], bucket[order], of_lang[order]
            head = np.flatnonzero(np.append(True, np.diff(bucket) > 0))
            for a, b in zip(head.tolist(), [*head[1:].tolist(), len(bucket)], strict=True):
                which, n = np.unique(of_lang[a:b], return_counts=True)
                packed = codec.compress(pa.py_buffer(data[offs[a] : offs[b]]), asbytes=True)
                out.append((int(bucket[a]), [langs[k] for k in which.tolist()], n.tolist(), int(offs[b] - offs[a]), packed, codec.compress(pa.py_buffer(weight[a:b]), asbytes=True)))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds.types, strict=True)], schema=kinds)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= PACK_BYTES:
                yield from of(pa.Table.from_batches(held))
                held, size = [], 0
        if held:
            yield from of(pa.Table.from_batches(held))

    return run


def _count(least: int):
    """Sums of the packs of a bucket, bucket by bucket (they come in their order);
    (lang, 0, null, number of words) beside the phrases of ``least`` or more."""
    kinds = pa.schema([("lang", pa.string()), ("words", pa.int32()), ("phrase", pa.string()), ("f", pa.int64())])

    def run(batches):
        import duckdb

        codec, totals = pa.Codec("zstd"), Counter()

        def unpacked(langs, runs, size, phrases, weights):
            n = sum(runs)
            raw = np.frombuffer(codec.decompress(phrases, size), np.uint8)
            bounds = np.append(0, np.flatnonzero(raw == 10) + 1).astype(np.int64)
            f = np.frombuffer(codec.decompress(weights, 8 * n), np.int64)
            return pa.table([pa.array(langs).take(pa.array(np.repeat(np.arange(len(runs)), runs))), pa.LargeStringArray.from_buffers(n, pa.py_buffer(bounds), pa.py_buffer(raw)), pa.array(f)], ["lang", "phrase", "f"])

        def insert(held):
            db.register("given", pa.concat_tables(held))
            db.execute("INSERT INTO grams SELECT * FROM given")
            db.unregister("given")
            held.clear()

        def counted():
            # Every word of a phrase is followed by a space, the last one by a line end, too.
            words = "(length(phrase) - length(replace(phrase, ' ', '')))::INTEGER"
            found = db.sql(f"SELECT lang, {words} AS words, rtrim(phrase, ' ' || chr(10)) AS phrase, sum(f)::BIGINT AS f FROM grams GROUP BY lang, grams.phrase HAVING sum(f) >= {least:d}")
            for part in found.to_arrow_reader(100_000):
                yield part.cast(kinds)

        with tempfile.TemporaryDirectory() as folder, duckdb.connect(config={"threads": 1, "memory_limit": DUCKDB_MEMORY, "temp_directory": folder, "preserve_insertion_order": False}) as db:
            held, rows, now = [], 0, None
            for batch in batches:
                for bucket, langs, runs, size, phrases, weights in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if bucket != now:
                        if held:
                            insert(held)
                        if now is not None:
                            yield from counted()
                        db.execute("CREATE OR REPLACE TABLE grams (lang VARCHAR, phrase VARCHAR, f BIGINT)")
                        rows, now = 0, bucket
                    if phrases is None:
                        totals[langs[0]] += size
                        continue
                    held.append(unpacked(langs, runs, size, phrases, weights))
                    rows += sum(runs)
                    if rows >= INSERT_ROWS:
                        insert(held)
                        rows = 0
            if held:
                insert(held)
            if now is not None:
                yield from counted()
            yield pa.RecordBatch.from_arrays([pa.array(totals.keys(), pa.string()), pa.array([0] * len(totals), pa.int32()), pa.nulls(len(totals), pa.string()), pa.array(totals.values(), pa.int64())], schema=kinds)

    return run


def phrase_counts(spark: SparkSession, docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """(lang, words, phrase, f): every phrase of up to ``longest`` words that
    occurs ``least`` times or more, and rows with words = 0 and a null phrase,
    whose f sums to all words of the language."""
    buckets = BUCKETS_A_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    packs = distinct_pieces(docs, text_col, lang_col).mapInArrow(_packs(buckets, longest), "bucket int, langs array<string>, runs array<int>, size long, phrases binary, weights binary")
    return packs.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_count(least), "lang string, words int, phrase string, f long")


def scored(counts: DataFrame, longest: int = LONGEST, inside_percent: int = INSIDE_PERCENT, scale: int = SCALE) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the candidates that no longer one absorbs."""
    known = counts.where("words > 0").select("lang", "words", "phrase", "f")
    cand = known.where("words > 1").withColumn("w", F.split("phrase", " "))
    own = cand.select("lang", "phrase", F.col("f").alias("a"))

    cut = cand.select("lang", "phrase", "w", "words", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    ask = lambda side, lo, n: F.struct(F.lit(side).alias("side"), F.array_join(F.slice("w", lo, n), " ").alias("part"))
    requests = cut.select("lang", "phrase", "k", F.inline(F.array(ask("l", 1, F.col("k")), ask("r", F.col("k") + 1, F.col("words") - F.col("k")))))
    answers = requests.join(known.select("lang", F.col("phrase").alias("part"), F.col("f").alias("answer")), ["lang", "part"]).select("lang", "phrase", "k", "side", "answer")

    sizes = cand.where("words > 2").select("lang", "f", "w", "words", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("size"))
    inner = sizes.select("lang", "f", "w", "size", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)).alias("at"))
    absorbing = inner.select("lang", F.array_join(F.slice("w", F.col("at"), F.col("size")), " ").alias("phrase"), F.col("f").alias("longer"))

    met = own.unionByName(answers, allowMissingColumns=True).unionByName(absorbing, allowMissingColumns=True)
    sides = [F.max(F.when((F.col("k") == k) & (F.col("side") == s), F.col("answer"))).alias(f"{s}{k}") for k in range(1, longest) for s in "lr"]
    flat = met.groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.max("longer").alias("longer"), *sides)
    exact = lambda x: F.col(x).cast(COUNT)
    ratio = lambda k: F.call_function("div", F.lit(scale).cast("decimal(7,0)") * exact("a") * exact("a"), exact(f"l{k}") * exact(f"r{k}"))
    cuts = [F.when(F.col(f"l{k}").isNotNull(), F.struct(ratio(k).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))) for k in range(1, longest)]
    absorbed = F.coalesce(100 * F.col("longer") >= inside_percent * F.col("a"), F.lit(False))
    best = flat.where(~absorbed).select("lang", "phrase", "a", F.array_min(F.array(*cuts)).alias("c"))
    return best.select("lang", "phrase", "a", "c.l", "c.r", "c.score")


def mine_phrases(spark: SparkSession, docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST, top: int = TOP, inside_percent: int = INSIDE_PERCENT, scale: int = SCALE) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of
    2 to ``longest`` words by score, a, and text.

    A null text is empty, a null language is ``und``; repeated rows count as
    often as they come, and ids are not read. Texts and pieces of any length
    count whole. Empty tables, or none but rare phrases, give no rows. Other
    columns are ignored. Ranks are taken within SALTS shares of a language
    first, so the last task of a language sees that many times ``top`` rows.
    """
    scratch = Scratch(spark, "phrases")
    counts = scratch.keep(phrase_counts(spark, docs, text_col, lang_col, least, longest), "counts")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    place = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    salted = scored(counts, longest, inside_percent, scale).withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    few = salted.withColumn("rank", place("lang", "salt")).where(F.col("rank") <= top)
    first = few.withColumn("rank", place("lang").cast("long")).where(F.col("rank") <= top)
    totals = counts.where("words = 0").groupBy("lang").agg(F.sum("f").alias("n"))
    return first.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
