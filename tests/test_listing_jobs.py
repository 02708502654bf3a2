"""Listings that prune scans (A1-A3, M1, K1), part lists (I1), the stored inventory (E4-E6), pages (H3, M4)."""
import os

import pytest
from pyspark.sql import functions as F

from cyclewise.operators import boundaries as B
from cyclewise.operators import inventory as INV
from cyclewise.operators import reports as R
from cyclewise.operators.parse import matches
from cyclewise.plans import jobs as J
from cyclewise.schemas import RESUME, RESUME_COLUMNS
from cyclewise.session import shared_path
from cyclewise.sources import listing as L
from cyclewise.sources import resume as RS
from cyclewise.sources import syslog as SY
from cyclewise.streaming.ingest import ingest_landing
from tests.test_routing_ingest import FULL, _row


def _logs(spark, root, names, n=400, by_system=False):
    rows = spark.range(n).crossJoin(spark.createDataFrame([(x,) for x in names], "log_dataset string"))
    line = F.when(F.col("id") % 7 == 0, F.lit("N 4000000 SYS1 2024010 10:00:00.00 IEA371I PARMLIB")) \
        .when(F.col("id") % 5 == 0, F.lit("")).otherwise(F.lit("nothing"))
    rows = rows.select(F.lit("SYS1").alias("sysname"), "log_dataset", F.col("id").alias("line_no"), line.alias("line"))
    return SY.write_syslog_text(rows, root, by_system)


def _leaf(df):
    """Metrics of the text scan of a plan that has run."""
    leaf = [x for x in _walk(df._jdf.queryExecution().executedPlan()) if "FileScan text" in x.toString()][0]
    return {k: leaf.metrics().apply(k).value() for k in ("numFiles", "numOutputRows")}


def _walk(plan):
    leaves = plan.collectLeaves()
    return [leaves.apply(k) for k in range(leaves.size())]


@pytest.fixture
def plain(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.enabled", "true")


NAMES = ["A.LOG1", "A.LOG2", "A.LOG3", "A.INDEX", "B.LOG 9+%é", "B.IN-CAT.LOG", "C.x"]


def test_listing_reads_no_file(spark):
    root = _logs(spark, shared_path(spark, "t"), NAMES)
    got = {(r.qualifier, r.list_pos, r.name) for r in SY.list_log_datasets(spark, root).collect()}
    assert got == {("A", 1, "A.INDEX"), ("A", 2, "A.LOG1"), ("A", 3, "A.LOG2"), ("A", 4, "A.LOG3"), ("B", 1, "B.LOG 9+%é"),
                   ("B.IN-CAT", 1, "B.IN-CAT.LOG"), ("C", 1, "C.x")}
    assert "content" not in SY.list_log_datasets(spark, root)._jdf.queryExecution().executedPlan().toString()


def test_chosen_datasets_prune_the_scan(spark, plain):
    root = _logs(spark, shared_path(spark, "t"), NAMES)
    chosen = SY.select_log_datasets(SY.list_log_datasets(spark, root), 2).select("key")
    df = SY._text_lines(spark, root, None, "partition", chosen)
    assert {r[0] for r in df.select("log_dataset").distinct().collect()} == {"A.LOG2", "A.LOG3", "B.LOG 9+%é"}
    all_files = sum(f.startswith("part-") for _, _, fs in os.walk(root.removeprefix("file:")) for f in fs)
    df = SY._text_lines(spark, root, None, "partition", chosen)
    df.collect()
    assert _leaf(df)["numFiles"] <= all_files // 2


def test_chosen_files_prune_the_scan(spark, tmp_path, plain):
    for system in ("S1", "S2"):
        os.makedirs(tmp_path / system)
        for k in range(4):
            (tmp_path / system / f"LOG{k}").write_text(f"a\n\n{system} IEA371I {k}\n")
    chosen = SY.select_log_datasets(SY.list_log_datasets(spark, f"file://{tmp_path}", "file"), 1).select("key")
    got = SY.scan_matching(spark, f"file://{tmp_path}", "IEA371I", dataset_from="file", datasets=chosen).collect()
    assert {(r.log_dataset, r.line_no, r.line) for r in got} == {(f"{s}_LOG3", 2, f"{s} IEA371I 3") for s in ("S1", "S2")}
    df = SY._text_lines(spark, f"file://{tmp_path}", None, "file", chosen)
    df.collect()
    assert _leaf(df)["numFiles"] == 2


def test_matching_lines_keep_their_numbers(spark, monkeypatch):
    root = _logs(spark, shared_path(spark, "t"), NAMES[:3], n=3000)
    want = {tuple(r) for r in SY.scan_syslog(spark, root).where(F.col("line").contains("IEA371I")).collect()}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    monkeypatch.setattr(SY, "LINES_A_ROW", 16)
    try:
        got = [tuple(r) for r in SY.scan_matching(spark, root, "IEA371I|Z*EOD").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert set(got) == want and len(got) == len(want) == 3 * 429


def test_one_text_scan_in_parse_logs(spark, monkeypatch):
    """Over every table the job writes and what it returns."""
    from cyclewise.sinks import _csv
    import cyclewise.sinks as sinks
    plans = []
    for module in (SY, J):
        write = module.written
        monkeypatch.setattr(module, "written", lambda df, name, w=write: (plans.append(df), w(df, name))[1])
    monkeypatch.setattr(sinks, "_csv", lambda df, *a, **k: (plans.append(df), _csv(df, *a, **k))[1])
    root = _logs(spark, shared_path(spark, "t"), ["SYS1.LOG1", "SYS1.LOG2", "SYS2.LOG1"], by_system=True)
    out = J.parse_logs(spark, root, shared_path(spark, "detail"))
    assert out.count() == 3 * 58 and {r[0] for r in out.select("log_dataset").distinct().collect()} == {f"SYS1_{x}" for x in ("SYS1.LOG1", "SYS1.LOG2", "SYS2.LOG1")}
    scans = [d._jdf.queryExecution().executedPlan().toString().count("FileScan text") for d in [*plans, out]]
    assert sum(scans) == 1 and len(scans) >= 4


def test_words_and_expressions_of_a_pattern(spark):
    df = spark.createDataFrame([("IEA371I x",), ("ZZEOD",), ("EOD",), ("none",), (None,), ("a(b)",)], "line string")
    for pattern in ("IEA371I|Z*EOD", "IEA371I", "Z*EOD", "a\\(b\\)|IEA3", "[E]OD|none"):
        assert df.where(matches(F.col("line"), pattern)).collect() == df.where(F.col("line").rlike(pattern)).collect()


def test_part_lists(spark):
    lists = spark.createDataFrame([(1, "a|b|c"), (2, " d | a|d "), (3, "|"), (4, ""), (5, "e"), (6, "a|c"), (7, None)], "list_no int, parts string")
    got = sorted((r.group_name, r.part_no, r.log_dataset) for r in B.parts_of_lists(lists).collect())
    assert got == [("a", 0, "a"), ("a", 1, "c"), ("d", 0, "d"), ("d", 1, "a"), ("d", 2, "d"), ("e", 0, "e")]


def _land(path, rows):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write("\n".join([";".join(RESUME_COLUMNS), *(";".join(x or "" for x in r) for r in rows)]) + "\n")


def test_discovery_reads_winners_only(spark, tmp_path, plain):
    for run, name in (("r1", "old"), ("r2", "new")):
        _land(f"{tmp_path}/{run}/S_resume.CSV", [_row(name, *FULL)])
    _land(f"{tmp_path}/r1/T_resume.CSV", [_row("t", *FULL)])
    _land(f"{tmp_path}/r1/T_detail.CSV", [_row("no", *FULL)])
    root = f"file://{tmp_path}"
    assert sorted((r.log_dataset, r.source_file) for r in RS.discover_resume_csv(spark, root).collect()) == [("new", "S_resume.CSV"), ("t", "T_resume.CSV")]
    df = RS.discover_resume_csv(spark, root)
    df.collect()
    leaf = [x for x in _walk(df._jdf.queryExecution().executedPlan()) if "FileScan csv" in x.toString()][0]
    assert leaf.metrics().apply("numFiles").value() == 2


def test_a_rewritten_file_is_ingested_once_more(spark, tmp_path):
    store, memory, root = shared_path(spark, "store"), shared_path(spark, "memory"), f"file://{tmp_path}"
    count = lambda: J.result_table(spark, store, "raw_results").count()
    _land(f"{tmp_path}/S_resume.CSV", [_row("a", *FULL)])
    assert ingest_landing(spark, root, store, memory) == 1 and count() == 1
    assert ingest_landing(spark, root, store, memory) == 0 and count() == 1
    _land(f"{tmp_path}/S_resume.CSV", [_row("a"), _row("b", *FULL)])
    assert ingest_landing(spark, root, store, memory) == 1 and count() == 2
    assert ingest_landing(spark, root, store, memory) == 0


def test_a_longer_selection_is_joined(spark, monkeypatch):
    monkeypatch.setattr(L, "MAX_LISTED", 2)
    df = spark.range(10).select(F.col("id").cast("string").alias("k"))
    out = L.only(df, F.col("k"), df.where("k < 5"))
    assert out.count() == 5 and "LeftSemi" in out._jdf.queryExecution().optimizedPlan().toString()


LPAR = "id long, lpar string, hostname string, dataset string, username string, enable int, schedule string"


def test_stored_inventory_rewrites_what_it_touches(spark, tmp_path):
    path = f"file://{tmp_path}/inv"
    rows = [(k, f"LP{k}", f"h{k}", "d", "u", 0, None) for k in range(200)]
    INV.write_inventory(spark.createDataFrame(rows, LPAR), path)

    def files():
        return {os.path.join(d, f) for d, _, fs in os.walk(tmp_path / "inv") for f in fs if f.endswith(".parquet")}
    before = files()
    assert INV.insert_stored(spark, path, spark.createDataFrame([(900, "L", "h3", "d", "u", 0, None), (901, "L", "new", "d", "u", 0, None),
                                                                 (902, "L", "new", "d", "u", 0, None)], LPAR)) == 1
    assert before < files() and len(files()) == len(before) + 1
    INV.update_stored(spark, path, spark.createDataFrame([(5, "ops")], "id long, username string"))
    assert len(before - files()) == 1
    before = files()
    INV.delete_stored(spark, path, spark.createDataFrame([(7,), (12345,)], "id long"))
    assert len(before - files()) <= 2
    got = {r.id: (r.username, r.enable) for r in INV.stored_inventory(spark, path).collect()}
    assert got == {k: ("ops" if k == 5 else "u", 0) for k in range(200) if k != 7} | {901: ("u", 1)}
    INV.delete_stored(spark, path, spark.createDataFrame([(k,) for k in range(1000)], "id long"))
    assert files() == set()


def test_pages_with_nulls(spark):
    rows = [(a, b) for a in (None, "x", "y") for b in (None, "1", "2", "3")]
    df, keys, after, seen = spark.createDataFrame(rows[::-1], "a string, b string"), ["a", "b"], None, []
    while page := R.page(df, keys, 5, after).collect():
        seen += [tuple(r) for r in page]
        after = tuple(page[-1])
    assert seen == rows


def test_report_pages_over_a_stored_table(spark):
    store = shared_path(spark, "store")
    rows = [_row(f"d{k:02d}", *FULL, sysname="SYS1" if k % 2 else "SYS2") for k in range(11)]
    J.ingest_results(spark, spark.createDataFrame(rows, RESUME), store)
    order, after, seen = ["pre_ipl", "log_dataset"], None, []
    while True:
        page = J.report_view(spark, store, "done", search="^sys1 ", order=order, page_size=2, after=after).collect()
        seen.append([r.log_dataset for r in page])
        after = J.page_key(spark, store, "done", order, 2, "^sys1 ", after)
        if after is None:
            break
    assert seen == [["d01", "d03"], ["d05", "d07"], ["d09"], []]
