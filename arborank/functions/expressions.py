"""Expressions on vectors, hashes, ids, text and dates; all but composed() stay inside the JVM."""

from __future__ import annotations

from unicodedata import normalize

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def r6(c: Column) -> Column:
    return F.round(c, 6)


def hash_unit(*parts: Column | str) -> Column:
    """A number in [0, 1) from the md5 of the parts joined by ":"; the same in any engine."""
    h = F.md5(F.concat_ws(":", *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts]))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def doubles(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    return F.when(norm(v) > 0, F.transform(v, lambda x: x / norm(v))).otherwise(v)


def cosine(a: Column, b: Column) -> Column:
    """0 where either is a zero vector."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


#: Texts that stand for "no id".
SENTINELS = ("N/A", "N/A (Format Error)", "NO_COMMENT")


def clean_id(c: Column) -> Column:
    """CLN-1, CLN-2: numeric text as an integer's digits, "" and "nan" in any letters as null, other text as it is."""
    c = c.cast("string")
    number = F.trim(c).try_cast("double").try_cast("bigint").cast("string")
    return F.when((c == "") | (F.lower(c) == "nan"), None).otherwise(F.coalesce(number, c))


def real_id(c: Column) -> Column:
    """CLN-3: clean_id() without the texts that stand for no user."""
    c = clean_id(c)
    return F.when(c.isin(*SENTINELS), None).otherwise(c)


def non_negative(c: Column) -> Column:
    """A number from text, 0 where it is none, at least 0."""
    return F.greatest(F.coalesce(c.cast("string").try_cast("double"), F.lit(0.0)), F.lit(0.0))


def plain_url(c: Column) -> Column:
    """Without query, fragment and closing slashes."""
    return F.regexp_replace(F.regexp_replace(c, r"[?#].*$", ""), "/+$", "")


#: How the news site writes times.
HOURS_AGO = r"(\d+)h trước"
MINUTES_AGO = r"(\d+)p trước"
CLOCK = r"(\d{1,2}):(\d{1,2})\s+(\d{1,2})/(\d{1,2})"


def relative_date(c: Column, now: Column) -> Column:
    """The first "Nh trước" or "Np trước" in a text, as the news site writes times ago, or the first "HH:MM d/m" in it, in the year of `now`, or
    the year before where that would be later than `now`; null for other texts and for days that the year doesn't have."""
    hours = F.regexp_extract(c, HOURS_AGO, 1).try_cast("int")
    minutes = F.regexp_extract(c, MINUTES_AGO, 1).try_cast("int")
    part = [F.regexp_extract(c, UNICODE + CLOCK, k).try_cast("int") for k in (1, 2, 3, 4)]

    def at(year: Column) -> Column:
        return F.try_make_timestamp(year, part[3], part[2], part[0], part[1], F.lit(0))

    this, last = at(F.year(now)), at(F.year(now) - 1)
    ago = lambda h, m: now - F.make_dt_interval(F.lit(0), h, m, F.lit(0))
    zero = F.lit(0)
    return F.when(hours.isNotNull(), ago(F.coalesce(hours, zero), zero)).when(minutes.isNotNull(), ago(zero, F.coalesce(minutes, zero))).otherwise(F.when(this > now, last).otherwise(this))


def day_in_text(c: Column) -> Column:
    """The first dd/mm/yyyy in the text as a date."""
    return F.try_to_timestamp(F.regexp_extract(c, r"(\d{1,2}/\d{1,2}/\d{4})", 1), F.lit("d/M/yyyy")).cast("date")


#: What text cleaning takes out, in this order.
TAGS = r"<[^>]+>"
URLS = r"https?://\S+|www\.\S+|[a-zA-Z0-9.-]+\.(com|vn|net|org|edu|gov)\S*"
PUNCTUATION = r"""[!"#$%&\'()*+,-./:;<=>?@\[\]\\^_`{|}~""''…–—]"""
NUMBERS = r"\b\d+\.?\d*\b"
#: What makes \b, \d and \s mean Unicode's letters, digits and blanks.
UNICODE = "(?U)"


@F.arrow_udf(StringType())
def composed(text: pa.Array) -> pa.Array:
    """TXT-1: Unicode in composed form (NFC), for which Spark has no function; plain ASCII stays as it is."""
    return pa.array([t if t is None or t.isascii() else normalize("NFC", t) for t in text.to_pylist()], pa.string())


def simple_clean(text: Column) -> Column:
    """TXT-4: small letters without tags and signs, single spaces."""
    text = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"<[^>]+>", " ")
    text = F.regexp_replace(text, r"[^\p{L}\p{N}_\s]", " ")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def assembled(url: Column, *parts: Column) -> Column:
    """CLN-10: the parts that have a text joined by spaces; where none has, the words of the address."""
    text = F.concat_ws(" ", *[F.nullif(F.trim(p), F.lit("")) for p in parts])
    slug = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^.*/|\.html?$", ""), "[-_]+", " "))
    return F.when(text != "", text).otherwise(slug)


def cleaned(text: Column, tags: bool = True, urls: bool = True, punctuation: bool = True, numbers: bool = False, lower: bool = True) -> Column:
    for on, pattern in ((tags, TAGS), (urls, URLS), (punctuation, PUNCTUATION), (numbers, NUMBERS)):
        if on:
            text = F.regexp_replace(text, UNICODE + pattern, " ")
    return F.lower(text) if lower else text


def tokens(text: Column, stopwords: list[str] | None = None, least: int = 1, most: int = 50) -> Column:
    """Words between white space of `least` to `most` characters that are not stop words."""
    words = F.filter(F.split(text, r"[ \t\n\r\f\x0b]+"), lambda w: F.length(w).between(least, most))
    return F.filter(words, lambda w: ~w.isin(stopwords)) if stopwords else words


def ngrams(words: Column, n: int) -> Column:
    at = F.sequence(F.lit(0), F.size(words) - n)
    return F.when(F.size(words) >= n, F.transform(at, lambda i: F.concat_ws(" ", *[F.get(words, i + k) for k in range(n)]))).otherwise(F.array().cast("array<string>"))
