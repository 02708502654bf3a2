"""Routing partition (Q6), idempotent ingest (M3), streaming ingest (K1)."""
from pyspark.sql import functions as F

from cyclewise.operators import routing as RT
from cyclewise.plans import jobs as J
from cyclewise.plans.jobs import BUCKET, TABLES, ingest_results, lookup, result_table, stored
from cyclewise.schemas import RESUME, RESUME_COLUMNS
from cyclewise.session import shared_path
from cyclewise.sinks import name_files, write_resume
from cyclewise.streaming.ingest import incremental_ingest

OK = "2024-1-5 01:02:03"


def _row(name, sb=None, se=None, ib=None, ie=None, last=None, sysname="SYS1"):
    vals = dict.fromkeys(RESUME_COLUMNS)
    vals.update(sysname=sysname, log_dataset=name, shutdown_begin=sb, shutdown_end=se,
                ipl_begin=ib, ipl_end=ie, last_ipl=last)
    return tuple(vals[c] for c in RESUME_COLUMNS)


def _frame(spark):
    rows = [_row("done", OK, "2024-1-5 02:00:00", "2024-1-5 03:00:00", "2024-1-5 04:00:00"),
            _row("partial", OK, None, None, None),
            _row("unparsable", OK, "2024-02-30 01:00:00", OK, OK),
            _row("last_only", last="2024-01-05 03:14:15"),
            _row("garbage"),
            _row("garbage_bad_last", last="20n--0 nu:ll:")]
    return spark.createDataFrame(rows, RESUME)


def test_unified_route_is_partition(spark):
    got = {r["log_dataset"]: r["route"] for r in RT.route(_frame(spark)).collect()}
    assert got == {"done": "done", "partial": "fail", "unparsable": "fail",
                   "last_only": "last_ipl", "garbage": "garbage", "garbage_bad_last": "garbage"}


def test_rule_variants(spark):
    df = _frame(spark)
    assert {r[1] for r in RT.fail_rows(df, "pandas").collect()} == \
        {"partial", "unparsable", "last_only", "garbage", "garbage_bad_last"}
    assert {r[1] for r in RT.fail_rows(df, "spark").collect()} == \
        {"partial", "unparsable", "garbage", "garbage_bad_last"}
    assert {r[1] for r in RT.garbage_rows(df, "refactor").collect()} == \
        {"last_only", "garbage", "garbage_bad_last"}
    assert {r[1] for r in RT.last_ipl_rows(df, "spark").collect()} == {"last_only"}


def test_done_durations(spark):
    r = RT.done_rows(_frame(spark)).first()
    assert (r["ipl_date"], r["shutdown_duration"], r["poweroff_duration"], r["load_ipl"],
            r["total_duration"]) == ("Jan 05, 2024", "00:57:57", "01:00:00", "01:00:00", "02:57:57")
    assert r["pos_ipl"] is None


def test_unseen_rows_dedupes(spark):
    df = _frame(spark)
    new = RT.unseen_rows(df.unionByName(df), df.filter(F.col("log_dataset") == "done"))
    assert sorted(r["log_dataset"] for r in new.collect()) == \
        ["garbage", "garbage_bad_last", "last_only", "partial", "unparsable"]


def _counts(spark, store):
    return {t: result_table(spark, store, t).count()
            for t in ["raw_results", "results_done", "results_fail", "results_garb", "results_last_ipl"]}


def test_ingest_idempotent(spark):
    store = shared_path(spark, "test-store")
    df = _frame(spark)
    ingest_results(spark, df, store)
    first = _counts(spark, store)
    ingest_results(spark, df, store)
    assert _counts(spark, store) == first == {"raw_results": 6, "results_done": 1, "results_fail": 2,
                                             "results_garb": 2, "results_last_ipl": 1}


def _names(spark, store, table="results_done"):
    return sorted((r["sysname"], r["log_dataset"]) for r in result_table(spark, store, table).collect())


FULL = (OK, "2024-1-5 02:00:00", "2024-1-5 03:00:00", "2024-1-5 04:00:00")


def test_a_run_that_died_is_made_good(spark):
    """Raw rows are stored and no result: the next run with the system finds them."""
    store, other = shared_path(spark, "test-store"), shared_path(spark, "test-store")
    df = _frame(spark)
    ingest_results(spark, df, other)
    stored(spark, other, "raw_results").write.partitionBy(BUCKET).parquet(f"{store}/raw_results")
    late = spark.createDataFrame([_row("late", *FULL)], RESUME)
    ingest_results(spark, late, store)
    assert _names(spark, store) == [("SYS1", "done"), ("SYS1", "late")]
    assert _counts(spark, store)["results_garb"] == 2


def _everything(spark, store):
    return {t: sorted(map(str, result_table(spark, store, t).collect())) for t in TABLES}


def test_a_changed_row_of_a_known_dataset_changes_nothing(spark):
    """The first result owns the dataset, in every table."""
    store = shared_path(spark, "test-store")
    bad = spark.createDataFrame([_row("d", OK, "2024-02-30 01:00:00", OK, OK), _row("other")], RESUME)
    good = spark.createDataFrame([_row("d", *FULL), _row("other", *FULL), _row("new", *FULL)], RESUME)
    ingest_results(spark, bad, store)
    first = _everything(spark, store)
    ingest_results(spark, good, store)
    second = _everything(spark, store)
    assert _names(spark, store) == [("SYS1", "new")] and _names(spark, store, "results_fail") == [("SYS1", "d")]
    assert [x for x in second["raw_results"] if "log_dataset='new'" not in x] == first["raw_results"]
    assert second["results_fail"] == first["results_fail"] and second["results_garb"] == first["results_garb"]


def test_a_dataset_that_only_a_sink_holds(spark):
    """Its row comes into raw if it routes to that sink, else nothing changes."""
    store, other = shared_path(spark, "test-store"), shared_path(spark, "test-store")
    bad = spark.createDataFrame([_row("d", OK, None, OK, OK), _row("e", OK, None, OK, OK)], RESUME)
    ingest_results(spark, bad, other)
    stored(spark, other, "results_fail").write.partitionBy(BUCKET).parquet(f"{store}/results_fail")
    again = spark.createDataFrame([_row("d", *FULL), _row("e", OK, None, OK, OK)], RESUME)
    for _ in range(2):
        ingest_results(spark, again, store)
        assert _names(spark, store, "raw_results") == [("SYS1", "e")]
        assert _names(spark, store, "results_fail") == [("SYS1", "d"), ("SYS1", "e")] and _names(spark, store) == []


def test_rows_of_one_dataset_stay_together(spark):
    """Several different rows of one dataset in one batch are all stored; a later one is not."""
    store = shared_path(spark, "test-store")
    two = spark.createDataFrame([_row("d", *FULL), _row("d", OK), _row("d", *FULL)], RESUME)
    for df in (two, two, spark.createDataFrame([_row("d")], RESUME)):
        ingest_results(spark, df, store)
        assert _counts(spark, store) == {"raw_results": 2, "results_done": 1, "results_fail": 1, "results_garb": 0, "results_last_ipl": 0}


def test_a_small_batch_reads_no_more_of_a_longer_history(spark):
    """Bloom filters: rows read by a lookup do not grow with the history of the same system."""
    def read(store, names):
        df = lookup(spark, store, "raw_results", list(range(64)), names)
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        try:
            df = lookup(spark, store, "raw_results", list(range(64)), names)
            df.collect()
            leaf = df._jdf.queryExecution().executedPlan().collectLeaves().head()
            return leaf.metrics().apply("numOutputRows").value()
        finally:
            spark.conf.set("spark.sql.adaptive.enabled", "true")

    def grow(runs):
        store = shared_path(spark, "test-store")
        for k in range(runs):
            rows = spark.range(2000).select(*[F.lit(OK if c in RT.FOUR else None).cast("string").alias(c) for c in RESUME_COLUMNS])
            rows = rows.withColumn("log_dataset", F.concat(F.lit(f"R{k:02d}."), F.xxhash64(F.rand(k)).cast("string")))
            J._append(rows.withColumn("sysname", F.lit("SYS1")).select(*RESUME_COLUMNS), store, "raw_results")
        return store
    spark.conf.set(J.IN_THRESHOLD, str(J.LOOKUP))
    names = [f"Q{k}" for k in range(40)] + ["R00.no", "R09.no", "R01.5", "R05.x"]
    one, ten = grow(1), grow(10)
    assert read(one, None) == 2000 and read(ten, None) == 20_000
    assert read(one, names) == read(ten, names) == 0
    assert lookup(spark, ten, "raw_results", list(range(64)), [None, "R01.x"]).count() == 0


def test_empty_first_batch(spark):
    store = shared_path(spark, "test-store")
    ingest_results(spark, _frame(spark).limit(0), store)
    assert set(_counts(spark, store).values()) == {0}
    ingest_results(spark, _frame(spark), store)
    assert _counts(spark, store)["results_done"] == 1


def test_odd_system_names_are_kept(spark):
    store = shared_path(spark, "test-store")
    names = [None, "", "0042", "A", "a/b=c"]
    df = spark.createDataFrame([_row(f"d{i}", *FULL, sysname=n) for i, n in enumerate(names)], RESUME)
    for _ in range(2):
        ingest_results(spark, df, store)
    for table in ("raw_results", "results_done"):
        got = {(r["sysname"], r["log_dataset"]) for r in result_table(spark, store, table).collect()}
        assert got == {(n, f"d{i}") for i, n in enumerate(names)}
        assert result_table(spark, store, table).count() == len(names)


def test_runs_read_their_systems_only(spark):
    store = shared_path(spark, "test-store")
    ingest_results(spark, _frame(spark), store)
    for table in ("raw_results", "results_done"):
        df = stored(spark, store, table).where(F.col(BUCKET).isin([3]))
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert BUCKET in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_incremental_stream(spark):
    landing = shared_path(spark, "test-landing")
    store = shared_path(spark, "test-stream-store")
    ckpt = shared_path(spark, "test-stream-ckpt")
    df = _frame(spark)

    def land(d, path, suffix="_resume.CSV"):
        write_resume(d, path)
        name_files(spark, path, suffix)
    land(df.filter(F.col("log_dataset").isin("done", "partial")), f"{landing}/run1/host")
    land(df.withColumn("log_dataset", F.lit("not this")), f"{landing}/run1/resume", "_detail.CSV")
    incremental_ingest(spark, landing, store, ckpt)
    assert _counts(spark, store)["raw_results"] == 2
    land(df, f"{landing}/run2")
    incremental_ingest(spark, landing, store, ckpt)
    incremental_ingest(spark, landing, store, ckpt)   # nothing new: no change
    assert _counts(spark, store)["raw_results"] == 6


def test_header_only_landing(spark):
    landing, store = shared_path(spark, "test-landing"), shared_path(spark, "test-store")
    header = spark.createDataFrame([(";".join(RESUME_COLUMNS),)], "value string").coalesce(1)
    header.write.text(f"{landing}/host=x")
    name_files(spark, landing, "_resume.CSV")
    incremental_ingest(spark, landing, store, shared_path(spark, "test-ckpt"))
    assert set(_counts(spark, store).values()) == {0}
