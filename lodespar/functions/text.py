"""Text as native columns: HTML to text, headers, dates, strata, slices, string likeness.

Only HTML's character references (over two thousand names, and any number) are decoded outside of Spark's own
functions, a batch of texts at a time.
"""

from __future__ import annotations

import html as markup

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lodespar.functions.vocabulary import MONTHS

LONG_POST = 1200


@F.arrow_udf(StringType())
def _decoded(texts: pa.Array) -> pa.Array:
    return pa.array([t if t is None or "&" not in t else markup.unescape(t) for t in texts.to_pylist()], pa.string())


def html_to_text(html: Column) -> Column:
    """Paragraph marks become blank lines, other tags go, character references of any kind are decoded (once),
    ends are trimmed."""
    text = F.regexp_replace(F.replace(F.coalesce(html, F.lit("")), F.lit("<p>"), F.lit("\n\n")), "<[^>]+>", "")
    return F.regexp_replace(_decoded(text), r"(?U)^\s+|\s+$", "")


def header(text: Column) -> Column:
    """The first line that is not blank, trimmed; empty if there is none."""
    return F.regexp_extract(F.coalesce(text, F.lit("")), r"(?m)^[^\S\n]*(\S[^\n]*?)[^\S\n]*$", 1)


def slots(text: Column) -> Column:
    """The non-blank parts of a piped header."""
    h = header(text)
    return F.when(h.contains("|"), F.filter(F.transform(F.split(h, r"\|"), F.trim), lambda p: p != "")).otherwise(F.array().cast("array<string>"))


def thread_date(title: Column) -> Column:
    """The month of a title like "... (July 2026)" as its first day; null if there is none."""
    name, year = (F.regexp_extract(title, r"\(([A-Za-z]+)\s+(\d{4})\)", i) for i in (1, 2))
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(name))
    return F.when(month > 0, F.make_date(year.try_cast("int"), month.cast("int"), F.lit(1)))


def is_piped(text: Column) -> Column:
    return F.regexp_count(header(text), F.lit(r"\|")) >= 2


def is_long(text: Column) -> Column:
    return F.char_length(text) > LONG_POST


def stratum(text: Column, has_salary: Column) -> Column:
    """format/salary/length of a post, joined by slashes."""
    return F.concat_ws("/", F.when(is_piped(text), "pipe").otherwise("prose"), F.when(has_salary, "has_salary").otherwise("no_salary"), F.when(is_long(text), "long").otherwise("short"))


def slice_name(text: Column) -> Column:
    return F.when(is_piped(text), "pipe").when(is_long(text), "long_prose").otherwise("prose")


def shared_bigrams(a: Column, b: Column) -> Column:
    """How many character bigrams two strings share, repeats counted: one pass over the sorted bigrams of both."""
    none = F.array().cast("array<struct<x:string,mine:int>>")
    pairs = lambda s, mine: F.when(F.char_length(s) >= 2, F.transform(F.sequence(F.lit(1), F.char_length(s) - 1), lambda i: F.struct(F.substring(s, i, F.lit(2)).alias("x"), F.lit(mine).alias("mine")))).otherwise(none)
    start = F.struct(F.lit("").alias("x"), F.lit(0).alias("b"), F.lit(0).alias("n"))

    def step(s: Column, p: Column) -> Column:
        # Sorted, a run's bigrams of b come before those of a: each of a's takes one of b's.
        b_left = F.when(s["x"] == p["x"], s["b"]).otherwise(0)
        mine = p["mine"] == 1
        return F.struct(p["x"].alias("x"), F.when(mine, F.greatest(b_left - 1, F.lit(0))).otherwise(b_left + 1).alias("b"), F.when(mine & (b_left > 0), s["n"] + 1).otherwise(s["n"]).alias("n"))

    return F.aggregate(F.sort_array(F.concat(pairs(a, 1), pairs(b, 0))), start, step)["n"]


def dice(a: Column, b: Column) -> Column:
    """Dice coefficient of character bigrams after trimming and lower-casing: 1 for equal strings, 0
    if either is shorter than two."""
    a, b = (F.lower(F.trim(F.coalesce(x, F.lit("")))) for x in (a, b))
    return F.when(a == b, F.lit(1.0)).when((F.char_length(a) < 2) | (F.char_length(b) < 2), F.lit(0.0)).otherwise(2.0 * shared_bigrams(a, b) / (F.char_length(a) + F.char_length(b) - 2))


def same_location(a: Column, b: Column, threshold: float = 0.9) -> Column:
    return dice(a, b) >= threshold


def run_date(ts: Column, zone: str = "America/Toronto") -> Column:
    """The local date of a UTC timestamp."""
    return F.date_format(F.from_utc_timestamp(ts.cast("timestamp"), zone), "yyyy-MM-dd")


def local_time(ts: Column, zone: str = "America/Toronto") -> Column:
    """Local date and time of a UTC timestamp, as "2026-07-01, 09:30:00"."""
    return F.date_format(F.from_utc_timestamp(ts.cast("timestamp"), zone), "yyyy-MM-dd, HH:mm:ss")


def share_text(n: Column, total: Column) -> Column:
    """A share as "12.5%"; a dash without a total."""
    return F.when(F.coalesce(total, F.lit(0)) == 0, "—").otherwise(percent(n / total))


def short_hash(text: Column, length: int = 8) -> Column:
    return F.substring(F.sha2(text, 256), 1, length)


def percent(x: Column, digits: int = 1) -> Column:
    return F.concat(F.format_number(x * 100, digits), F.lit("%"))


def salary_text(low: Column, high: Column, currency: Column) -> Column:
    """"USD 180,000-230,000", an open end as "+" or "up to"; null without figures."""
    c = F.coalesce(currency, F.lit("USD"))
    money = lambda x: F.format_number(x, 0)
    return (
        F.when(low.isNotNull() & high.isNotNull() & (low != high), F.concat(c, F.lit(" "), money(low), F.lit("-"), money(high)))
        .when(low.isNotNull() & high.isNotNull(), F.concat(c, F.lit(" "), money(low)))
        .when(low.isNotNull(), F.concat(c, F.lit(" "), money(low), F.lit("+")))
        .when(high.isNotNull(), F.concat(c, F.lit(" up to "), money(high)))
    )
