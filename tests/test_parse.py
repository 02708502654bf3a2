"""Record layouts and classes (FIXTURES §2)."""
from cyclewise.operators.parse import parse_lines

SAMPLES = [
    ("N 4000000 ZT1 2022279 03:14:15.92 DSI039I ENDED", "SHUTDOWN BEGIN", "2022-10-06 03:14:15", 1),
    ("D C000000 045 SYSTEM IPLED AT 03.14.15 ON 10/05/2022", "SYSTEM IPLED", None, 2),
    ("N ZT1 22279 03:14:15.92 IEA371I X", "IPL BEGIN", "2022-10-06 03:14:15", 3),
    ("N 2022279 03141592 X R=1 IXC371D", "END OF SHUTDOWN", "2022-10-06 03:14:15", 4),
    ("N 2022279 03141592 HZS0103I X", "IPL END", "2022-10-06 03:14:15", 5),
    ("N 2022279 IPLTRK01I X", "PRE IPL", None, 6),
    ("N A 2022279 03141592 IPLTRK02I", "POST IPL", "2022-10-06 03:14:15", 7),
    ("N 4000000 ZT1 2022279 03:14:15.92 DSI039I Z EOD", "SHUTDOWN BEGIN", "2022-10-06 03:14:15", 1),
    ("N 4000000 ZT1 2022279 03:14:15.92 JES3 X IEF404I", "END OF SHUTDOWN", "2022-10-06 03:14:15", 1),
]


def _parse(spark, lines, sysname="ZT1", prefilter=False):
    rows = [("D1", sysname, i + 1, l) for i, l in enumerate(lines)]
    df = spark.createDataFrame(rows, "log_dataset string, sysname string, line_no bigint, line string")
    return parse_lines(df, prefilter=prefilter).orderBy("log_id").collect()


def test_layouts_and_classes(spark):
    got = _parse(spark, [s[0] for s in SAMPLES])
    assert len(got) == len(SAMPLES)
    for row, (line, typ, ts, layout) in zip(got, SAMPLES):
        assert row["type"] == typ, line
        assert row["layout"] == layout, line
        assert (row["event_ts"].strftime("%Y-%m-%d %H:%M:%S") if row["event_ts"] else None) == ts, line
        assert row["msg"] == line


def test_ipled_last_ipl(spark):
    got = _parse(spark, ["D C000000 045 SYSTEM IPLED AT 03.14.15 ON 10/05/2022"])
    assert got[0]["last_ipl_ts"].strftime("%Y-%m-%d %H:%M:%S") == "2022-10-05 03:14:15"


def test_other_system_dropped(spark):
    got = _parse(spark, ["N 4000000 ZZ9 2022279 03:14:15.92 DSI039I ENDED"])
    assert got == []


def test_error_flag_and_layout8(spark):
    got = _parse(spark, ["N 4000000 ZT1 2022279 03:14:15.92 HASP ABEND", "HASP text only"])
    assert got[0]["type"] is None and got[0]["error"] == "y"
    assert got[1]["layout"] == 8 and got[1]["type"] is None and got[1]["error"] is None


def test_prefilter(spark):
    got = _parse(spark, ["N 2022279 03141592 S SSHD", "N 2022279 03141592 S SSHD TN3270",
                         "N 2022279 03141592 Z EOD"], prefilter=True)
    # S SSHD alone is not in the message patterns; Z*EOD is the regex 'EOD'
    assert [r["log_id"] for r in got] == [2, 3]
    assert got[0]["type"] == "IPL END"


def test_unknown_system_is_rejected(spark):
    line = "N 4000000 ZT1 2022279 03:14:15.92 DSI039I ENDED"
    assert _parse(spark, [line], sysname=None) == []
    assert len(_parse(spark, [line])) == 1


def test_loaded_patterns(spark):
    rows = [("D1", "ZT1", 1, "N 2022279 03141592 Z EOD"), ("D1", "ZT1", 2, "N 2022279 03141592 IEA371I X")]
    df = spark.createDataFrame(rows, "log_dataset string, sysname string, line_no bigint, line string")
    assert [r["log_id"] for r in parse_lines(df, patterns="IEA371I|NONE").collect()] == [2]
