"""Personal data in texts, with built-in functions only.

Regular expressions propose spans, checksums (Luhn, mod 97) and digit counts
confirm them, and words just before a span adjust its score. The four base
kinds stay whatever their score; the two added kinds (iban, ssn) are kept from
MIN_SCORE on.

The expressions below match what the plain forms in their comments match, but
in linear time: a run is entered only at its first character (or where the
last match ended), and quantifiers that can't profit from giving back are
possessive.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.native import let, scan

MIN_SCORE = 0.5
CONTEXT = 40
PART = 4096

# [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
# [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
# [0-9]([\x20-]?[0-9])+ of 14 digits or more
CARD = r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){13,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Lengths that the registry of account numbers fixes; other codes: any length.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH CR HR LI LV",
    22: "BG BH DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban(length: int, codes: str) -> str:
    whole, rest = divmod(length - 4, 4)
    return rf"(?:{codes.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{{whole}}}" + (rf"\x20?[A-Z0-9]{{{rest}}}" if rest else "")


_ANY_IBAN = r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?"
IBAN = rf"(?<![A-Z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{'|'.join([_iban(n, c) for n, c in IBAN_LENGTHS.items()] + [_ANY_IBAN])})(?![A-Z0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"

KINDS = ["email", "ip", "card", "phone", "iban", "ssn"]
BASE = 4


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn checksum."""

    def check(r: Column) -> Column:
        def step(a: Column, i: Column) -> Column:
            d = r.substr(i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
            return a + F.when(d > 9, d - 9).otherwise(d)

        return F.aggregate(F.sequence(F.lit(1), F.length(r)), F.lit(0), step) % 10 == 0

    return let(F.reverse(digits), check)


def mod97(m: Column) -> Column:
    """Whether an account number of 15 to 34 letters and digits leaves 1 modulo 97."""

    def check(c: Column) -> Column:
        turned = F.concat(c.substr(F.lit(5), F.length(c)), F.substring(c, 1, 4))

        def step(a: Column, x: Column) -> Column:
            code = F.ascii(x)
            return F.when(code < 58, (a * 10 + code - 48) % 97).otherwise((a * 100 + code - 55) % 97)

        return F.length(c).between(15, 34) & (F.aggregate(F.filter(F.split(turned, ""), lambda x: x != ""), F.lit(0), step) == 1)

    return let(F.regexp_replace(m, " ", ""), check)


def _account(m: Column) -> Column:
    """A match without the last space-led groups that keep it from its checksum."""
    tries = F.array(m, *[F.regexp_replace(m, rf"(?:\x20[A-Z0-9]{{1,4}}){{{k}}}$", "") for k in range(1, 8)])
    return F.coalesce(F.get(F.filter(tries, mod97), F.lit(0)), m)


def _octets(m: Column) -> Column:
    return F.forall(F.split(m, r"\."), lambda x: x.rlike("^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"))


# kind: pattern, what a text must hold for a match, validator, score before
# and after validation, words that add 0.3 when they stand just before
RULES: list[tuple[str, str, Callable[[Column], Column], Callable[[Column], Column], float, str]] = [
    (EMAIL, "email", lambda t: t.contains("@"), lambda m: F.lit(True), 0.7, "mail|contact|write"),
    (IP, "ip", lambda t: t.contains("."), _octets, 0.6, "ip|address|host|server"),
    (CARD, "card", lambda t: F.lit(True), lambda m: let(_digits(m), lambda d: F.length(d).between(14, 19) & luhn(d)), 0.7, "card|visa|credit|debit|amex|payment"),
    (PHONE, "phone", lambda t: t.contains("+"), lambda m: F.length(_digits(m)).between(10, 15), 0.6, "phone|tel|call|mobile|fax|cell"),
    (IBAN, "iban", lambda t: F.lit(True), mod97, 0.7, "iban|account|bank|konto|compte|cuenta"),
    (SSN, "ssn", lambda t: t.contains("-"), lambda m: ~m.rlike("^(?:000|666|9..)|-00-|-0000$"), 0.3, "ssn|social|security"),
]


def _spans(text: Column, index: int) -> Column:
    """Confirmed spans of one kind: (start, kind index, end, score) by start."""
    pattern, _, may, valid, score, context = RULES[index]
    hits = F.when(may(text), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))

    def place(h: Column) -> Column:
        # The text between the matches gives their places and what stands before them.
        def pairs(gaps: Column) -> Column:
            return F.transform(h, lambda m, i: F.struct(F.get(gaps, i).alias("gap"), m.alias("m")))

        before = lambda s, x: F.right(F.concat(s["tail"], F.right(x["gap"], F.lit(CONTEXT))), F.lit(CONTEXT))

        def step(s: Column, x: Column) -> Column:
            tail = F.right(F.concat(before(s, x), F.right(x["m"], F.lit(CONTEXT))), F.lit(CONTEXT))
            return F.struct((s["at"] + F.length(x["gap"]) + F.length(x["m"])).alias("at"), tail.alias("tail"))

        def each(s: Column, x: Column) -> Column:
            return F.struct((s["at"] + F.length(x["gap"])).alias("start"), before(s, x).alias("before"), (_account(x["m"]) if KINDS[index] == "iban" else x["m"]).alias("m"))

        zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("tail"))
        return let(F.split(text, pattern, -1), lambda g: scan(pairs(g), zero, step, each, "struct<start:int,before:string,m:string>"))

    def judge(s: Column) -> Column:
        lift = F.when(F.lower(s["before"]).rlike(rf"\b(?:{context})"), 0.3).otherwise(0.0)
        return F.struct(s["start"].alias("start"), F.lit(index).alias("kind"), (s["start"] + F.length(s["m"])).alias("end"), F.round(F.lit(score) + lift, 2).alias("score"))

    none = F.array().cast("array<struct<start:int,kind:int,end:int,score:double>>")
    found = let(hits, lambda h: F.when(F.size(h) == 0, none).otherwise(F.transform(F.filter(place(h), lambda s: valid(s["m"])), judge)))
    return found if index < BASE else F.filter(found, lambda s: s["score"] >= MIN_SCORE)


def find_pii(docs: DataFrame, text_col: str = "text", out: str = "pii") -> DataFrame:
    """``docs`` with the array ``out`` of (start, kind, end, score), by start
    and then kind; offsets are code points, ends exclusive.

    A null text is empty; spans of different kinds may overlap, and of spans
    with one start the kind listed first comes first. Rows are independent:
    repeated rows, null ids and empty tables need no rule; a column named like
    ``out`` is replaced. Time and memory grow in proportion to a text's length,
    whatever its number of matches.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumn(out, F.sort_array(F.concat(*[_spans(text, i) for i in range(len(RULES))])))


def digest(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat(F.get(names, s["kind"]), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def base_spans(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["kind"] < BASE)


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with every span replaced by its kind in angle brackets; of
    overlapping spans the first names the replaced stretch."""
    names = F.array(*[F.lit(f"<{k}>") for k in KINDS])

    def over(parts: Column) -> Column:
        # A substring is sought in the blocks that hold it, not from the text's begin.
        def piece(at: Column, length: Column) -> Column:
            first = F.floor(at / PART).cast("int")
            held = F.array_join(F.slice(parts, first + 1, F.floor((at + length) / PART).cast("int") - first + 1), "")
            return held.substr(at - first * PART + 1, length)

        ends = F.concat(spans, F.array(F.struct(F.length(text).alias("start"), F.lit(None).cast("int").alias("kind"), F.length(text).alias("end"), F.lit(0.0).alias("score"))))
        each = lambda s, x: F.when(x["start"] >= s["at"], F.concat(piece(s["at"], x["start"] - s["at"]), F.coalesce(F.get(names, x["kind"]), F.lit("")))).otherwise("")
        return F.array_join(scan(ends, F.struct(F.lit(0).alias("at")), lambda s, x: F.struct(F.greatest(s["at"], x["end"]).alias("at")), each, "string"), "")

    return F.when(F.size(spans) == 0, text).otherwise(let(F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{PART}}}"), F.lit(0)), over))
