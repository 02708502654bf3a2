"""Reports (C12-C15, D12, H3) and the pattern loader."""
from cyclewise.functions.catalogue import MESSAGE_PATTERNS, prefilter_regex
from cyclewise.operators import reports as R
from cyclewise.session import shared_path
from cyclewise.sources.syslog import load_patterns


def _done(spark):
    rows = [("zt1", "Jan 05, 2024", "ZT1.A", "2024-1-5 01:00:00", "2024-1-5 02:00:00", "2024-1-5 03:00:00",
             "2024-1-9 08:00:00", None, None, "01:00:00", "01:00:00", "101:00:00", "103:00:00"),
            ("zt2", "Jan 06, 2024", "ZT2.B", "2024-1-6 01:00:00", "2024-1-6 02:00:00", "2024-1-6 03:00:00",
             "2024-1-6 04:00:00", "2024-1-6 00:30:00", None, "01:00:00", "01:00:00", "01:00:00", "03:00:00")]
    cols = ["sysname", "ipl_date", "log_dataset", "shutdown_begin", "shutdown_end", "ipl_begin", "ipl_end",
            "pre_ipl", "pos_ipl", "shutdown_duration", "poweroff_duration", "load_ipl", "total_duration"]
    from cyclewise.schemas import DONE
    assert cols == DONE.fieldNames()
    return spark.createDataFrame(rows, DONE)


def test_report_format_keeps_long_durations(spark):
    got = {r["log_dataset"]: r for r in R.report_format(R.report_done(_done(spark))).collect()}
    a = got["ZT1.A"]
    assert a["sysname"] == "ZT1" and a["ipl_end"] == "08:00:00" and a["pre_ipl"] == ""
    assert a["load_ipl"] == "101:00:00"          # not cut to 8 characters


def test_search_and_page(spark):
    d = R.report_done(_done(spark))
    assert [r["log_dataset"] for r in R.report_search(d, "zt2\\.b").collect()] == ["ZT2.B"]
    assert [r["log_dataset"] for r in R.page(d, ["sysname", "log_dataset"], 1).collect()] == ["ZT1.A"]
    after = ("zt1", "ZT1.A")
    assert [r["log_dataset"] for r in R.page(d, ["sysname", "log_dataset"], 5, after).collect()] == ["ZT2.B"]


def test_load_patterns(spark):
    path = shared_path(spark, "test-patterns")
    spark.createDataFrame([(p,) for p in MESSAGE_PATTERNS], "value string").coalesce(1).write.text(path)
    got = load_patterns(spark, path)
    assert sorted(got.split("|")) == sorted(MESSAGE_PATTERNS)
    assert load_patterns(spark) == prefilter_regex()
