"""Scalar functions against hand-derived values (FIXTURES §2)."""
from pyspark.sql import functions as F

from cyclewise.functions import (calendar_epoch, elapsed_calendar_approx, format_days,
                                 format_hms, format_hms_floor, ipl_date_label, is_datetime,
                                 julian_to_date, normalize_time, dataset_name, short_host)


def _one(spark, col_expr, rows, schema):
    df = spark.createDataFrame(rows, schema)
    return [r[0] for r in df.select(col_expr).collect()]


def test_julian_to_date(spark):
    got = _one(spark, julian_to_date("j").cast("string"),
               [("2024060",), ("22279",), ("2023366",), ("null",), (None,), ("2024001",)], "j string")
    assert got == ["2024-02-29", "2022-10-06", None, None, None, "2024-01-01"]


def test_normalize_time(spark):
    got = _one(spark, normalize_time("t"), [("03:14:15.92",), ("03141592",), (None,)], "t string")
    assert got == ["03:14:15", "03:14:15", None]


def test_is_datetime(spark):
    rows = [("2022-1-5 01:02:03",), ("2022-1-5 1:2:3",), ("2022-02-30 01:02:03",),
            ("22-01-05 00:00:00",), ("",), (None,), ("2022-1-5 01:02:03 ",),
            ("2022-1-5  01:02:03",)]
    got = _one(spark, is_datetime("s"), rows, "s string")
    assert got == [True, True, False, False, False, False, False, True]


def test_calendar_approx(spark):
    df = spark.createDataFrame([("2022-01-31 00:00:00", "2022-02-01 00:00:00")], "a string, b string")
    df = df.select(F.to_timestamp("a").alias("a"), F.to_timestamp("b").alias("b"))
    got = df.select(elapsed_calendar_approx("a", "b")).first()[0]
    assert got == 37800
    assert df.select(calendar_epoch("a")).first()[0] == 52 * 31557600 + 2629800 + 31 * 86400


def test_format_hms(spark):
    rows = [(59,), (86400,), (90061,), (360000,), (-5,), (0,), (None,)]
    got = _one(spark, format_hms("n"), rows, "n bigint")
    assert got == ["00:00:59", "24:00:00", "25:01:01", "100:00:00", "00:00:-5", "00:00:00", None]


def test_format_hms_floor(spark):
    got = _one(spark, format_hms_floor("n"), [(-5,), (90061,)], "n bigint")
    assert got == ["-1:59:55", "25:01:01"]


def test_format_days(spark):
    got = _one(spark, format_days("n"), [(90061,), (59,)], "n bigint")
    assert got == ["[ 1 day(s), 1 hour(s), 1 minute(s), 1 second(s) ]",
                   "[ 0 day(s), 0 hour(s), 0 minute(s), 59 second(s) ]"]


def test_ipl_date_label(spark):
    df = spark.createDataFrame([("2023-01-12 10:00:00",)], "a string").select(F.to_timestamp("a").alias("a"))
    assert df.select(ipl_date_label("a")).first()[0] == "Jan 12, 2023"


def test_names(spark):
    df = spark.createDataFrame([("ZT1", "SYSLOG.D1.CSV", "Host01.Example.com")], "s string, f string, h string")
    r = df.select(dataset_name("s", "f"), short_host("h")).first()
    assert r[0] == "ZT1_SYSLOG.D1" and r[1] == "host01"
