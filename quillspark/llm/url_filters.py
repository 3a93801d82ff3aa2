"""Url filters: host rules and url patterns, indexed by their rarest literal token.

A rule's text has literal tokens, runs of ``[a-z0-9]`` that something other than
such a character bounds on both sides, so that a url which fits the rule has the
token among its own. Urls are counted by token, each rule is filed under the
rarest of its tokens, the tokens of a url fetch the rules filed under them, and
only these run their regular expression. All of it is DataFrame functions;
rules are rows too, so that a list of any length is joined, not looped over.

Patterns are written as in public block lists: ``*`` is any run of characters,
``^`` a separator (no letter, digit, ``_``, ``.``, ``%`` or ``-``) or the end,
``|`` an end of the url, ``||`` the beginning of its host or of any label in it,
and ``@@`` makes an exception. They see the url with A-Z lower-cased.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.scratch import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Rules of host and path that the contract names.
HOST_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
PATTERNS = (
    "||ads-track.", "||free-bets.", "||ads.", "||adserver.", "||casino.", "||poker.", "/ads/", "/adclick/", "/banners/", "/wp-login.php", "/cgi-bin/",
    "/login^", "/signup^", "/cart^", "/checkout^", "/porn/", "?sessionid=", "&sessionid=", ".exe|", ".zip|", ".apk|", "@@||docs.", "@@/robots.txt|",
)


def lowered(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A-Z lower-cased, and the path; both empty for null and without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return lowered(F.coalesce(host, F.lit(""))), F.coalesce(path, F.lit(""))


def tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(text, "[^a-z0-9]+"), lambda t: t != ""))


def _quoted(text: Column) -> Column:
    """Literal text as part of a regular expression."""
    return F.regexp_replace(text, r"[\\.+?$(){}\[\]|]", r"\\$0")


def _values(spark: SparkSession, rows: Sequence[tuple], names: Sequence[str]) -> DataFrame:
    """Rows given in the program, as a DataFrame made by the JVM."""
    made = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row, strict=True)]) for row in rows]
    if not made:
        return spark.range(0).select(*[F.lit("").alias(n) for n in names])
    return spark.range(1).select(F.inline(F.array(*made)))


def host_rules(spark: SparkSession, rules: Sequence[tuple[str, str, str]] = HOST_RULES) -> DataFrame:
    """(kind, rule, verdict, regex, tokens) of rules (host, path, verdict). The
    regular expression is for host and path put together."""
    rows = _values(spark, rules, ["host", "path", "verdict"])
    text = F.concat("host", "path")
    bounded = F.filter(F.split(F.regexp_replace(lowered(text), r"[a-z0-9]+$", ""), "[^a-z0-9]+"), lambda t: t != "")
    return rows.select(F.lit("host").alias("kind"), text.alias("rule"), "verdict", F.concat(F.lit(r"^([^/]*\.)?"), _quoted(text)).alias("regex"), bounded.alias("tokens"))


def patterns(spark: SparkSession, lines: Sequence[str] = PATTERNS) -> DataFrame:
    """The same of url patterns; the verdict of an exception is allow."""
    p = _values(spark, [(x,) for x in lines], ["rule"])
    body = lowered(F.regexp_replace("rule", r"^@@", ""))
    label, begins, ends = body.startswith("||"), body.startswith("|"), body.endswith("|")
    inner = F.regexp_replace(body, r"^\|{1,2}|\|$", "")
    regex = F.regexp_replace(F.regexp_replace(_quoted(inner), r"\*", ".*"), r"\^", "(?:[^a-z0-9_.%-]|\\\\z)")
    start = F.when(label, r"^[a-z][a-z0-9+.-]*://(?:[^/?#]*\.)?").when(begins, "^").otherwise("")
    whole = F.concat(F.lit("(?s)"), start, regex, F.when(ends, r"\z").otherwise(""))
    # A run that touches a wildcard or an open end may be a part of a token only.
    open_left, open_right = F.when(begins, "/").otherwise("*"), F.when(ends, "/").otherwise("*")
    closed = F.regexp_replace(F.concat(open_left, inner, open_right), r"[a-z0-9]*\*[a-z0-9]*", " ")
    return p.select(F.lit("pattern").alias("kind"), "rule", F.when(p["rule"].startswith("@@"), "allow").otherwise("block").alias("verdict"), whole.alias("regex"), F.filter(F.split(closed, "[^a-z0-9]+"), lambda t: t != "").alias("tokens"))


def rule_index(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``rules`` filed under (token): each one's rarest over ``urls`` (url), ties
    to the smaller token. A rule without a token raises an error when run, as no
    url could fetch it."""
    filed = rules.withColumn("token", F.explode_outer("tokens"))
    wanted = filed.select("token").distinct()
    counts = urls.select(F.explode(tokens(lowered(F.col("url")))).alias("token")).join(wanted, "token").groupBy("token").agg(F.count("*").alias("n"))
    none = F.raise_error(F.concat(F.lit("rule without a literal token: "), F.col("rule"))).cast("string")
    held = filed.join(counts, "token", "left").withColumn("token", F.coalesce("token", none))
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))["token"]
    return held.groupBy("kind", "rule", "verdict", "regex").agg(rarest.alias("token"))


def matches(urls: DataFrame, index: DataFrame) -> DataFrame:
    """(url, rule, rule_verdict, blocked, excepted) of the distinct ``urls`` that
    some rule fits; ``rule`` is the longest host rule."""
    host, path = host_and_path(F.col("url"))
    known = urls.select("url", F.concat(host, path).alias("_place"), lowered(F.col("url")).alias("_low"))
    fetched = known.withColumn("token", F.explode(tokens(F.col("_low")))).join(index, "token")
    of_host = F.col("kind") == "host"
    fits = fetched.where(F.when(of_host, F.expr("_place RLIKE regex")).otherwise(F.expr("_low RLIKE regex")))
    best = F.max(F.when(of_host, F.struct(F.length("rule").alias("n"), F.col("rule"), F.col("verdict"))))
    hit = lambda v: F.min(F.when(~of_host & (F.col("verdict") == v), F.col("rule")))
    return fits.groupBy("url").agg(best.alias("best"), hit("block").alias("blocked"), hit("allow").alias("excepted")).select("url", "best.rule", F.col("best.verdict").alias("rule_verdict"), "blocked", "excepted")


def filter_urls(spark: SparkSession, pages: DataFrame, rules: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, pattern) of every row.

    The longest host rule that fits decides (equal lengths: the greater text,
    and block before allow); else a url that a pattern fits is blocked, but for
    exceptions. ``pattern`` is the first such pattern that fits, in the order of
    text, whatever decides. ``rules`` are rows of ``host_rules`` and ``patterns``.

    A null or empty url, or one without ``://``, has an empty host and path and
    can fit patterns only. Rows with a null id, and repeated rows, each give a
    row; each distinct url is judged once, so that a very common one is not
    judged again, and one of any length is a row like others. An empty table
    gives no rows. Other columns are ignored.
    """
    scratch = Scratch(spark, "url-filters")
    rules = host_rules(spark).unionByName(patterns(spark)) if rules is None else rules
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    urls = scratch.keep(rows.where("url IS NOT NULL").select("url").distinct(), "urls")
    index = scratch.keep(rule_index(urls, rules), "index")
    found = scratch.keep(matches(urls, index), "matches")
    host, path = host_and_path(F.col("url"))
    by_pattern = F.when(F.col("blocked").isNotNull() & F.col("excepted").isNull(), "block").otherwise("allow")
    return rows.join(found, "url", "left").select("page_id", host.alias("host"), path.alias("path"), "rule", F.coalesce("rule_verdict", by_pattern).alias("verdict"), F.col("blocked").alias("pattern"))
