"""Text scan with distributed line numbering (A1/G2), listing top-n (G3),
inventory merges (E4-E6)."""
from pyspark.sql import functions as F

from cyclewise.operators import inventory as INV
from cyclewise.session import shared_path
import pytest

from cyclewise.schemas import RESUME
from cyclewise.sinks import append_table, import_json_rows, name_files, write_detail, write_resume
from cyclewise.sources.resume import discover_resume_csv, read_detail, read_parquet, read_resume_csv
from cyclewise.sources.syslog import first_n_per_key, latest_n_per_key, load_patterns, scan_syslog


def test_scan_numbers_across_splits(spark):
    # a file larger than the split size: several splits, numbering must stay
    # the original line positions (blank lines are not numbered)
    path = shared_path(spark, "test-syslog")
    n = 20000
    rows = [(f"line {i} " + "x" * 40,) for i in range(1, n + 1)]
    spark.createDataFrame(rows, "value string").coalesce(1).write.text(f"{path}/log_dataset=A")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        got = scan_syslog(spark, path).select("line_no", "line").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == n
    assert all(r["line"].startswith(f"line {r['line_no']} ") for r in got)


def test_latest_n(spark):
    df = spark.createDataFrame([("q", i, f"n{i}") for i in range(10)] + [("r", 1, "x")],
                               "qualifier string, list_pos int, name string")
    got = sorted((r[0], r[1]) for r in latest_n_per_key(df, "qualifier", "list_pos", 3).collect())
    assert got == [("q", 7), ("q", 8), ("q", 9), ("r", 1)]


def test_inventory_ops(spark):
    lp = spark.createDataFrame([(1, "L1", "h1", "d", "u", 0, "s"), (2, "L2", "h2", "d", "u", 1, "s")],
                               "id long, lpar string, hostname string, dataset string, username string, enable int, schedule string")
    new = spark.createDataFrame([(3, "L3", "h2", "d", "u", 0, "s"), (5, "L5", "h9", "d", "u", 0, "s"),
                                 (4, "L4", "h9", "d", "u", 0, "s")], lp.schema)
    ins = {r["id"]: r["enable"] for r in INV.insert_if_absent(lp, new).collect()}
    assert ins == {1: 0, 2: 1, 4: 1}
    upd = INV.update_rows(lp, spark.createDataFrame([(1, "ops")], "id long, username string"))
    assert {r["id"]: r["username"] for r in upd.collect()} == {1: "ops", 2: "u"}
    twice = spark.createDataFrame([(1, "a"), (1, "b")], "id long, username string")
    with pytest.raises(Exception, match="repeated id"):
        INV.update_rows(lp, twice).collect()
    assert [r["id"] for r in INV.delete_by_key(lp, lp.filter(F.col("id") == 1)).collect()] == [2]


def test_first_n(spark):
    df = spark.createDataFrame([("q", i, f"n{i}") for i in range(10)], "qualifier string, list_pos int, name string")
    assert sorted(r[1] for r in first_n_per_key(df, "qualifier", "list_pos", 2).collect()) == [0, 1]


def test_logs_of_one_name_stay_apart(spark, tmp_path):
    for system in ("s1", "s2"):
        (tmp_path / system).mkdir()
        (tmp_path / system / "LOG1").write_text("".join(f"{system} line {i}\n\n" for i in (1, 2)))
    got = {(r["sysname"], r["log_dataset"], r["line_no"], r["line"])
           for r in scan_syslog(spark, f"file://{tmp_path}", dataset_from="file").collect()}
    assert got == {(s, f"{s}_LOG1", i, f"{s} line {i}") for s in ("s1", "s2") for i in (1, 2)}
    named = {r["log_dataset"] for r in scan_syslog(spark, f"file://{tmp_path}", "SYS9", "file").collect()}
    assert named == {"SYS9_s1.LOG1", "SYS9_s2.LOG1"}


def test_part_files_are_read_in_task_order(spark, tmp_path):
    folder = tmp_path / "log_dataset=0042"
    folder.mkdir()
    (folder / "part-99999-x.txt").write_text("first\n")
    (folder / "part-100000-x.txt").write_text("second\n")
    got = sorted((r["line_no"], r["line"], r["log_dataset"]) for r in scan_syslog(spark, f"file://{tmp_path}").collect())
    assert got == [(1, "first", "0042"), (2, "second", "0042")]


def _resume(spark, *names, system="A"):
    return spark.createDataFrame([(system, n) + (None,) * 13 for n in names], RESUME)


def test_discovery_by_file_name(spark, tmp_path):
    root = f"file://{tmp_path}/my_resume_folder"
    write_resume(_resume(spark, "old"), f"{root}/run1")
    write_resume(_resume(spark, "new"), f"{root}/run2/nested")
    for f in (f"{root}/run1", f"{root}/run2/nested"):
        name_files(spark, f, "_resume.CSV")
    write_resume(_resume(spark, "other", system="B"), f"{root}/x")
    name_files(spark, f"{root}/x", "_detail.CSV")
    got = [(r["log_dataset"], r["source_file"]) for r in discover_resume_csv(spark, root).collect()]
    assert got == [("new", "A_resume.CSV")]


def test_naming_goes_on_where_it_ended(spark, tmp_path):
    """A run that died half-way and its repeat give the names of one whole run; a third run changes nothing."""
    for run in ("whole", "halted"):
        for system in ("A", "B", "part-7"):
            folder = tmp_path / run / f"system={system}"
            folder.mkdir(parents=True)
            for k in range(3):
                (folder / f"part-0000{k}-x.csv").write_text(f"{system} {k}")
        (tmp_path / run / "_SUCCESS").write_text("")
    halted = tmp_path / "halted" / "system=A"
    (halted / "part-00000-x.csv").rename(halted / "A_resume.CSV")
    (halted / "part-00001-x.csv").rename(halted / "A.1_resume.CSV")
    assert name_files(spark, f"file://{tmp_path}/whole", "_resume.CSV") == 9
    assert name_files(spark, f"file://{tmp_path}/halted", "_resume.CSV") == 7
    assert name_files(spark, f"file://{tmp_path}/halted", "_resume.CSV") == 0
    held = {run: {str(f.relative_to(tmp_path / run)): f.read_text() for f in (tmp_path / run).rglob("*.CSV")} for run in ("whole", "halted")}
    assert held["whole"] == held["halted"] and len(held["whole"]) == 9
    assert held["whole"]["system=A/A.2_resume.CSV"] == "A 2" and held["whole"]["system=part-7/part-7_resume.CSV"] == "part-7 0"


def test_small_files_and_wrong_headers(spark, tmp_path):
    path = f"file://{tmp_path}/r"
    write_resume(_resume(spark, "one"), path)
    assert read_resume_csv(spark, f"{path}/system=A").count() == 1
    (tmp_path / "bad.csv").write_text("a;b\n1;2\n")
    with pytest.raises(Exception):
        read_resume_csv(spark, f"file://{tmp_path}/bad.csv").collect()


def test_detail_text_is_unchanged_and_one_file_a_dataset(spark, tmp_path):
    from cyclewise.operators.parse import parse_lines
    lines = [(f"D{d}", "ZT1", i, f'N 4000000 ZT1 2022279 03:14:1{i}.92  IEA371I "a;b"  x{d} ') for d in range(25) for i in range(8)]
    df = spark.createDataFrame(lines, "log_dataset string, sysname string, line_no bigint, line string").repartition(8)
    detail = parse_lines(df)
    write_detail(detail, f"file://{tmp_path}/d")
    files = list((tmp_path / "d").glob("dataset=*/part-*.csv"))
    assert len(files) == 25
    back = read_detail(spark, f"file://{tmp_path}/d")
    cols = ["log_dataset", "sysname", "log_id", "type", "event_ts", "msg"]
    assert sorted(map(tuple, back.select(*cols).collect())) == sorted(map(tuple, detail.select(*cols).collect()))


def test_schema_on_read(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    assert read_parquet(spark, path, RESUME).count() == 0
    (tmp_path / "t").mkdir()
    assert read_parquet(spark, path, RESUME).count() == 0


def test_bad_json_is_refused(spark, tmp_path):
    path = f"file://{tmp_path}/j"
    for bad in ("{not json", "", None):
        rows = spark.createDataFrame([('{"sysname": "A"}',), (bad,)], "value string")
        with pytest.raises(Exception):
            import_json_rows(spark, rows, RESUME, path)
    assert read_parquet(spark, path, RESUME).count() == 0


def test_catalog_table(spark, tmp_path):
    name = "t_" + tmp_path.name.replace("-", "_")
    append_table(_resume(spark, "a"), name, f"file://{tmp_path}/cat")
    append_table(_resume(spark, "b"), name)
    assert sorted(r["log_dataset"] for r in spark.table(name).collect()) == ["a", "b"]


def test_pattern_file_is_bounded(spark, tmp_path):
    (tmp_path / "p").write_text("A\n\n B \n")
    assert load_patterns(spark, f"file://{tmp_path}/p") == "A|B"
    (tmp_path / "none").write_text("\n")
    with pytest.raises(ValueError):
        load_patterns(spark, f"file://{tmp_path}/none")
