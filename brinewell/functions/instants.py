"""Timestamps in mixed notations, precisions and zones to one instant in epoch nanoseconds.

Every notation is one branch of a single regular expression with named groups. It runs once a value: a replacement by the
group references turns the text into a delimited record of components. The rest is integer arithmetic inside
whole-stage codegen: calendar ranges are validated and days are counted from the civil date.

Defined results: null for null, blank, words, incomplete or impossible dates, unknown zones, and instants outside the range
of a 64-bit nanosecond count. A local time that a clock change skips is read with the offset before the change, one that
occurs twice as its first occurrence.
"""

from __future__ import annotations

from functools import lru_cache
from zoneinfo import available_timezones

from pyspark.sql import Column
from pyspark.sql import functions as F

# UTC offsets in minutes of the abbreviations in American and European use.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120,
    "EET": 120, "EEST": 180, "MSK": 180, "NST": -210, "NDT": -150, "AST": -240, "ADT": -180, "EST": -300, "EDT": -240,
    "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
}

_MONTHS = "jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"
_MONTH = (
    "jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?"
)
_DATE = "|".join(
    (
        r"(?<y1>\d{4})-(?<m1>\d{1,2})-(?<d1>\d{1,2})",
        r"(?<y2>\d{4})(?<m2>\d{2})(?<d2>\d{2})",
        r"(?<m3>\d{1,2})/(?<d3>\d{1,2})/(?<y3>\d{4})",
        r"(?<d4>\d{1,2})\.(?<m4>\d{1,2})\.(?<y4>\d{4})",
        rf"(?:[a-z]{{3,9}},?\s+)?(?<d5>\d{{1,2}})(?:st|nd|rd|th)?[\s-]+(?<m5>{_MONTH})\.?,?[\s-]+(?<y5>\d{{4}})",
        rf"(?:[a-z]{{3,9}},?\s+)?(?<m6>{_MONTH})\.?\s+(?<d6>\d{{1,2}})(?:st|nd|rd|th)?,?\s+(?<y6>\d{{4}})",
        r"(?<y7>\d{4})/(?<m7>\d{1,2})/(?<d7>\d{1,2})",
    )
)
_TIME = (
    r"(?:(?<h1>\d{1,2}):(?<i1>\d{2})(?::(?<s1>\d{2})(?:[.,](?<f1>\d+))?)?|(?<h2>\d{2})(?<i2>\d{2})(?:(?<s2>\d{2})(?:[.,](?<f2>\d+))?)?)"
    r"\s*(?<half>[ap]\.?m\.?(?![a-z]))?"
)
_ZONE = r"(?:\s*(?:utc|gmt|z))?\s*(?<sign>[+-])(?<oh>\d{1,2}):?(?<om>\d{2})?|\s*(?<word>[a-z]{1,5})(?![a-z/])"
_REGION = r"\s*\[?(?<region>[a-z]+(?:/[a-z0-9_+-]+)+|(?<inner>utc|gmt|z))\]?"
PATTERN = (
    rf"(?si)\A\s*(?:(?<n>[+-]?\d{{9,19}})(?:\.(?<nf>\d+))?"
    rf"|(?:{_DATE})(?:(?:\s*t\s*|,?\s+(?:at\s+)?){_TIME}(?:{_ZONE})?(?:{_REGION})?)?(?:\s*\([^()]*\))?)\s*\z|\A.*\z"
)
_FIELDS = {
    "n": "${n}", "nf": "${nf}", "y": "".join(f"${{y{k}}}" for k in range(1, 8)), "m": "".join(f"${{m{k}}}" for k in range(1, 8)),
    "d": "".join(f"${{d{k}}}" for k in range(1, 8)), "h": "${h1}${h2}", "i": "${i1}${i2}", "s": "${s1}${s2}", "f": "${f1}${f2}",
    "half": "${half}", "abbr": "${word}", "sign": "${sign}", "oh": "${oh}", "om": "${om}", "region": "${region}",
}

NORMAL_TEXT = r"\A\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z\z"
NANOS = 1_000_000_000


@lru_cache(maxsize=1)
def _regions() -> tuple[str, ...]:
    return tuple(sorted(z for z in available_timezones() if "/" in z))


def epoch_ns(value: Column) -> Column:
    """Nanoseconds of an epoch number whose unit shows in its size; null for null, 0 and what 64 bits can't hold."""
    v = value.cast("bigint")
    size = F.abs(F.greatest(v, F.lit(-(2**63) + 1)))  # the least number of 64 bits has no absolute value
    scale = F.when(size < 10**11, F.lit(NANOS)).when(size < 10**14, F.lit(10**6)).when(size < 10**17, F.lit(1000)).otherwise(F.lit(1))
    return F.when(v != 0, F.try_multiply(v, scale.cast("bigint")))


def roomy(ns: Column) -> Column:
    """Whether an instant leaves room for sums of a few days before 64 bits overflow: it lies in 1677 to 2262, a week from the ends."""
    room = 7 * 86_400 * NANOS
    return ns.between(-(2**63) + room, 2**63 - 1 - room)


def days_from_civil(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a proleptic Gregorian date with a year of 0 or more, by integer arithmetic alone."""
    shifted = F.when(m <= 2, y - 1).otherwise(y)
    of_year = ((153 * F.when(m > 2, m - 3).otherwise(m + 9) + 2) / 5).cast("int") + d - 1
    era_years = shifted * 365 + F.floor(shifted / 4) - F.floor(shifted / 100) + F.floor(shifted / 400)
    return (era_years + of_year - 719_468).cast("bigint")


def last_day(y: Column, m: Column) -> Column:
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    return F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)


def instant_columns(df, source: str, out: str):
    """df with the bigint column out: the instant that the text column source denotes, or null.

    The steps are kept apart by one-element generators. The optimizer would otherwise copy the whole expression into every filter
    above and into every use; so it runs once a row, inside generated code.
    """
    part, num, month, hour, local, whole = (f"__{out}_{k}" for k in ("part", "num", "month", "hour", "local", "whole"))
    names = list(_FIELDS)

    def text(name: str) -> Column:
        return F.get(F.col(part), F.lit(names.index(name)))

    def number(name: str) -> Column:
        return F.get(F.col(num), F.lit(names.index(name)))

    once = lambda c: F.explode(F.array(c))
    df = df.withColumn(part, once(F.split(F.regexp_replace(F.col(source), F.lit(PATTERN), F.lit("\x01".join(_FIELDS.values()))), "\x01")))
    df = df.withColumn(num, once(F.expr(f"try_cast({part} as array<int>)"))).withColumn(whole, F.expr(f"try_cast(get({part}, {names.index('n')}) as bigint)"))
    half = F.lower(F.substring(text("half"), 1, 1))
    named = ((F.instr(F.lit(_MONTHS.replace("|", "")), F.lower(F.substring(text("m"), 1, 3))) + 2) / 3).cast("int")
    df = df.withColumn(month, F.coalesce(number("m"), named)).withColumn(
        hour,
        F.when(half == "", F.coalesce(number("h"), F.lit(0))).when(
            number("h").between(1, 12), number("h") % 12 + F.when(half == "p", 12).otherwise(0)
        ),
    )
    y, m, d, h = number("y"), F.col(month), number("d"), F.col(hour)
    minute, second, oh, om = (F.coalesce(number(k), F.lit(0)) for k in ("i", "s", "oh", "om"))
    valid = (
        y.between(1678, 2261) & m.between(1, 12) & (d >= 1) & (d <= last_day(y, m)) & h.between(0, 23) & minute.between(0, 59)
        & second.between(0, 59) & (oh <= 18) & (om <= 59)
    )
    df = df.withColumn(local, once(F.when(valid, days_from_civil(y, m, d) * 86_400 + h * 3600 + minute * 60 + second)))
    at, region = F.col(local), text("region")
    minutes = F.create_map(*[x for k, v in ABBREVIATIONS.items() for x in (F.lit(k), F.lit(v))])
    seconds = (
        F.when(text("sign") != "", at - F.when(text("sign") == "-", -60).otherwise(60) * (oh * 60 + om))
        .when(text("abbr") != "", at - 60 * F.try_element_at(minutes, F.upper(text("abbr"))))
        .when((region == "") | F.upper(region).isin("UTC", "GMT", "Z"), at)
        .when(region.isin(*_regions()), F.unix_seconds(F.to_utc_timestamp(F.timestamp_seconds(at), region)))
    )
    nine = lambda k: F.coalesce(F.rpad(F.substring(text(k), 1, 9), 9, "0").try_cast("bigint"), F.lit(0))
    size = F.abs(F.greatest(F.col(whole), F.lit(-(2**63) + 1)))
    shift = F.when(size < 10**11, 1).when(size < 10**14, 1000).when(size < 10**17, 10**6).otherwise(10**9).cast("bigint")
    numeric = F.try_add(epoch_ns(F.col(whole)), F.signum(F.col(whole)).cast("bigint") * F.floor(nine("nf") / shift).cast("bigint"))
    df = df.withColumn(out, once(F.when(F.col(whole).isNotNull(), numeric).otherwise(F.try_add(F.try_multiply(seconds, F.lit(NANOS).cast("bigint")), nine("f")))))
    return df.drop(part, num, month, hour, local, whole)
