"""Column functions over texts: tokens, passages, chunks, cues, spans, pairs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The cue words of the negation and hedge features.
NEGATION_CUES = ["not", "no", "never", "without", "denies"]
HEDGE_CUES = ["maybe", "perhaps", "possible", "appears", "seems"]
DAYS_OF = {"day": 1, "week": 7, "month": 30}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once a row, although ``body``
    may use it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


BLOCK = 256


def scan(items: Column, state: Column, step: Callable[[Column, Column], Column], each: Callable[[Column, Column], Column], kind: str) -> Column:
    """``each(state, x)`` (of the SQL type ``kind``) for every x of ``items``,
    where step(state, x) is the state before the next. Results are appended in
    blocks, since an append copies the array it extends."""

    def inside(block: Column, begin: Column) -> Column:
        zero = F.struct(begin.alias("s"), F.array().cast(f"array<{kind}>").alias("out"))
        return F.aggregate(block, zero, lambda a, x: F.struct(step(a["s"], x).alias("s"), F.array_append(a["out"], each(a["s"], x)).alias("out")))

    def over(held: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(held) - 1) / BLOCK).cast("int"))), lambda i: F.slice(held, i * BLOCK + 1, BLOCK))
        zero = F.struct(state.alias("s"), F.array().cast(f"array<array<{kind}>>").alias("out"))
        return F.aggregate(blocks, zero, lambda a, b: let(inside(b, a["s"]), lambda r: F.struct(r["s"].alias("s"), F.array_append(a["out"], r["out"]).alias("out"))), lambda a: F.flatten(a["out"]))

    return let(items, over)


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores; null: null."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def _strip(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def passages(text: Column) -> Column:
    """Non-empty trimmed passages; a passage ends with . ! or ? before white space."""
    marked = F.regexp_replace(text, r"([.!?]+)\s+", "$1\u0001")
    return F.filter(F.transform(F.split(marked, "\u0001"), _strip), lambda x: x != "")


def passage_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, sent_idx, sent): documents dealt once by id, so that later
    groupings and windows by document need no further shuffle."""
    dealt = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).repartition("doc_id")
    return dealt.select("doc_id", F.posexplode(passages(F.col("text"))).alias("sent_idx", "sent"))


def passage_offsets(text: Column) -> Column:
    """(idx, start, end, passage) with code point offsets of the trimmed
    passage's start and of the untrimmed end."""
    marked = F.split(F.regexp_replace(text, r"([.!?]+\s+)", "$1\u0001"), "\u0001")

    def piece(s: Column, x: Column) -> Column:
        lead = F.length(x) - F.length(F.regexp_replace(x, r"^\s+", ""))
        return F.struct((s["at"] + lead).cast("int").alias("start"), (s["at"] + F.length(x)).cast("int").alias("end"), _strip(x).alias("sent"))

    found = scan(marked, F.struct(F.lit(0).alias("at")), lambda s, x: F.struct((s["at"] + F.length(x)).alias("at")), piece, "struct<start:int,end:int,sent:string>")
    return F.filter(found, lambda p: p["sent"] != "")


def chunk_starts(n: Column, max_len: int, stride: int) -> Column:
    """Starts of windows of ``max_len`` that overlap by ``stride``; the last
    window is the first to reach the end, no tokens give one empty window."""
    if not 0 <= stride < max_len:
        raise ValueError("stride must be non-negative and smaller than max_len")
    step = max_len - stride
    last = F.ceil(F.greatest(n - max_len, F.lit(0)) / step) * step
    return F.sequence(F.lit(0).cast("long"), last.cast("long"), F.lit(step).cast("long"))


def chunks(words: Column, max_len: int = 512, stride: int = 128) -> Column:
    """(start, words) windows over an array of words."""
    def cut(w: Column) -> Column:
        return F.transform(chunk_starts(F.size(w), max_len, stride), lambda s: F.struct(s.cast("int").alias("start"), F.slice(w, s.cast("int") + 1, max_len).alias("words")))

    return let(words, cut)


def white_words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"\s+"), lambda x: x != "")


def cue_flags(text: Column, cues: Sequence[str]) -> Column:
    """1 for each white-space token that is a cue; attached punctuation defeats the match."""
    known = F.array(*[F.lit(c) for c in cues])
    return F.transform(white_words(text), lambda x: F.array_contains(known, x).cast("int"))


def has_cue(text: Column, cues: Sequence[str]) -> Column:
    return F.arrays_overlap(white_words(text), F.array(*[F.lit(c) for c in cues])).cast("int")


def duration_days(text: Column) -> Column:
    """The first duration in a text as days; null without one."""
    pattern = r"(\d+)\s*(day|week|month)s?"
    low = F.lower(text)
    unit = F.regexp_extract(low, pattern, 2)
    number = F.expr("1").cast("long") * F.regexp_extract(low, pattern, 1).try_cast("long")
    scale = F.coalesce(*[F.when(unit == u, F.lit(d)) for u, d in DAYS_OF.items()])
    return (number * scale).cast("long")


def pair_text(text: Column, topic: Column) -> Column:
    return F.concat(text, F.lit(" [SEP] "), topic)


def short_code(code: Column, last: int = 9) -> Column:
    """A.n to cn for n up to ``last``; anything else is null."""
    n = F.regexp_extract(code, r"^A\.(\d+)$", 1).try_cast("int")
    return F.when(n.between(1, last), F.concat(F.lit("c"), n.cast("string")))


def mapped(value: Column, names: dict[str, str]) -> Column:
    """A name's replacement, itself where there is none."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair]) if names else F.create_map()
    return F.coalesce(F.try_element_at(table, value), value) if names else value


def annotation_index(code: Column) -> Column:
    """The last number of ids like s_1270_9_6; null with fewer than four parts or no number."""
    parts = F.split(code, "_")
    return F.when(F.size(parts) >= 4, F.element_at(parts, -1).try_cast("int"))


def locate_span(text: Column, needle: Column) -> Column:
    """(start, end) of ``needle``, else of it without closing .!?, else null."""
    bare = F.regexp_replace(needle, r"[.!?]+$", "")
    whole, short = F.instr(text, needle), F.instr(text, bare)
    found = lambda at, x: F.struct((at - 1).cast("int").alias("start"), (at - 1 + F.length(x)).cast("int").alias("end"))
    return F.when((whole > 0) & (needle != ""), found(whole, needle)).when((short > 0) & (bare != ""), found(short, bare))


def simple_encode(text: Column, topic: Column, max_length: int, vocab: int = 30_000) -> Column:
    """(ids, types, mask) of [CLS] text [SEP] topic [SEP], the text cut to fit, padded."""
    code = lambda x: F.lit(3) + F.pmod(F.xxhash64(x), F.lit(vocab - 3)).cast("int")
    second = F.transform(F.slice(white_words(topic), 1, max_length - 3), code)
    first = F.transform(F.slice(white_words(text), F.lit(1), F.greatest(F.lit(0), F.lit(max_length - 3) - F.size(second))), code)
    ids = F.concat(F.array(F.lit(1)), first, F.array(F.lit(2)), second, F.array(F.lit(2)))
    fill = lambda v, n: F.array_repeat(F.lit(v), n)
    pad = F.lit(max_length) - F.size(ids)
    return F.struct(F.concat(ids, fill(0, pad)).alias("ids"), F.concat(fill(0, F.size(first) + 2), fill(1, F.size(second) + 1), fill(0, pad)).alias("types"), F.concat(fill(1, F.size(ids)), fill(0, pad)).alias("mask"))


def sigmoid(logit: Column, temperature: Column | float = 1.0) -> Column:
    t = F.greatest(F.lit(temperature) if isinstance(temperature, (int, float)) else temperature, F.lit(1e-4))
    return 1 / (1 + F.exp(-logit / t))


def l2_normalised(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: x.cast("double") / (norm + 1e-8))


def rounded(x: Column, digits: int) -> Column:
    """``x`` rounded half away from zero; what rounds to zero keeps its sign, as in SQL on doubles."""
    r = F.round(x, digits)
    return F.when(r == 0, x * 0.0).otherwise(r)


def inverse_rank(rank: Column) -> Column:
    return F.coalesce(1 / (rank + 1), F.lit(0.0))
