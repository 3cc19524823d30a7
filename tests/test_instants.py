from datetime import datetime, timezone
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from brinewell.functions.instants import days_from_civil, epoch_ns, instant_columns

CASES = {
    "2018-06-14T16:00:00Z": datetime(2018, 6, 14, 16, tzinfo=timezone.utc),
    "  2018-06-14t16:00:00z ": datetime(2018, 6, 14, 16, tzinfo=timezone.utc),
    "24.04.2018 01:00 CEST": datetime(2018, 4, 23, 23, tzinfo=timezone.utc),
    "08/24/2018 4:30 PM EDT": datetime(2018, 8, 24, 20, 30, tzinfo=timezone.utc),
    "07/07/2018 12:00 AM EDT": datetime(2018, 7, 7, 4, tzinfo=timezone.utc),
    "2018-11-20 00:59:00 Europe/Berlin": datetime(2018, 11, 20, 0, 59, tzinfo=ZoneInfo("Europe/Berlin")),
    "2018-08-07T04:30:00[Asia/Kolkata]": datetime(2018, 8, 7, 4, 30, tzinfo=ZoneInfo("Asia/Kolkata")),
    "20181026T043059Z": datetime(2018, 10, 26, 4, 30, 59, tzinfo=timezone.utc),
    "Sun, 22 Apr 2018 22:00:59 +0530": datetime(2018, 4, 22, 16, 30, 59, tzinfo=timezone.utc),
    "2018-07-24T17:59:59-0700": datetime(2018, 7, 25, 0, 59, 59, tzinfo=timezone.utc),
    "2018-03-04T02:00Z": datetime(2018, 3, 4, 2, tzinfo=timezone.utc),
    "2018-10-22": datetime(2018, 10, 22, tzinfo=timezone.utc),
    "Oct 31, 2018": datetime(2018, 10, 31, tzinfo=timezone.utc),
    "22 April 2018": datetime(2018, 4, 22, tzinfo=timezone.utc),
    "1526857200": datetime.fromtimestamp(1526857200, timezone.utc),
    "1540422059000": datetime.fromtimestamp(1540422059, timezone.utc),
    "2016-02-29T00:00:00Z": datetime(2016, 2, 29, tzinfo=timezone.utc),
    # what the clock skips is read with the offset before, what comes twice as its first time
    "2018-03-11 02:30:00 America/New_York": datetime(2018, 3, 11, 7, 30, tzinfo=timezone.utc),
    "2018-11-04 01:30:00 America/New_York": datetime(2018, 11, 4, 5, 30, tzinfo=timezone.utc),
}
NOTHING = [
    None, "", " ", "soon", "n/a", "2018-??", "4/2018?", "0000-00-00", "2018-13-08", "2018-02-30T12:00:00Z", "2018-02-29", "2018-04-21T25:00:00Z", "2018-04-21T12:61:00Z",
    "2018-04-21T12:00:00 XYZ", "2018-04-21 12:00:00 Nowhere/City", "99/99/2018 4:30 PM EDT", "13:00", "9999999999999999999", "x" * 100_000,
]


def read(spark, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, written string")
    return [r.at for r in instant_columns(rows, "written", "at").orderBy("i").collect()]


def test_notations(spark):
    got = read(spark, list(CASES))
    assert got == [int(v.timestamp()) * 10**9 for v in CASES.values()]


def test_no_instant(spark):
    assert read(spark, NOTHING) == [None] * len(NOTHING)


def test_all_digits_count(spark):
    assert read(spark, ["2018-10-31T04:30:00.123036041Z", "1526857200.25", "2018-10-31T04:30:00.1234567891Z"]) == [
        1540960200123036041, 1526857200250000000, 1540960200123456789
    ]


@pytest.mark.parametrize("year", [1700, 1900, 1970, 2000, 2018, 2100])
def test_days(spark, year):
    from datetime import date, timedelta

    days = [date(year, 1, 1) + timedelta(k) for k in range(0, 366, 5)]
    rows = spark.createDataFrame([(d.year, d.month, d.day, d.toordinal() - 719163) for d in days], "y int, m int, d int, n int")
    assert rows.where(days_from_civil(F.col("y"), F.col("m"), F.col("d")) != F.col("n")).count() == 0


def test_numbers(spark):
    given = [0, None, 1520121666, 1520121602901, 1520121615628000, 1520121600000000123, -1520121666]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(given)], "i int, v bigint")
    got = [r.n for r in rows.select("i", epoch_ns(F.col("v")).alias("n")).orderBy("i").collect()]
    assert got == [None, None, 1520121666 * 10**9, 1520121602901 * 10**6, 1520121615628000 * 1000, 1520121600000000123, -1520121666 * 10**9]


def test_epoch_numbers_at_the_ends_of_64_bits(spark):
    rows = spark.createDataFrame([(-(2**63),), (2**63 - 1,), (-(2**63) + 1,), (10**16,), (0,), (None,)], "v bigint")
    assert [r[0] for r in rows.select(epoch_ns(F.col("v"))).collect()] == [-(2**63), 2**63 - 1, -(2**63) + 1, None, None, None]
