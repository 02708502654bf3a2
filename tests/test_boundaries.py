"""Running-accept reduction (F1-F3): fixtures, and the chunked scan against a
row-by-row fold on random logs (out-of-order times included)."""
import datetime as dt
import operator
import random

import pytest
from pyspark.sql import functions as F

from cyclewise.operators import boundaries as B
from cyclewise.operators.boundaries import cycle_boundaries, dataset_spans, first_last_boundaries, running_boundaries

SB, SE, IB, IE = "SHUTDOWN BEGIN", "END OF SHUTDOWN", "IPL BEGIN", "IPL END"
PRE, POST, IPLED = "PRE IPL", "POST IPL", "SYSTEM IPLED"
DAY = dt.datetime(2022, 10, 6)

# class -> (class whose kept time it must exceed, which of two times is better)
FOLD = {SB: (None, operator.lt), SE: (SB, operator.lt), IB: (SE, operator.lt), IE: (IB, operator.gt),
        PRE: (None, operator.lt), POST: (None, operator.gt)}


def fold(rows):
    """SURVEY F1: a time is kept if it is later than what its predecessor class
    holds at that row (nothing: any time) and better than what its class holds."""
    kept, last = {}, None
    for cls, ts, ipled in rows:
        if cls == IPLED:
            last = ipled if ipled is not None else last
        elif ts is not None:
            before, better = FOLD[cls]
            if before in kept and not ts > kept[before]:
                continue
            if cls not in kept or better(ts, kept[cls]):
                kept[cls] = ts
    return tuple(kept.get(c) for c in (PRE, SB, SE, IB, IE, POST)) + (last,)


def _frame(spark, datasets):
    rows = []
    for name, evs in datasets.items():
        for i, (typ, ts, lip) in enumerate(evs):
            rows.append((name, "SYS", i + 1, typ, ts, lip))
    return spark.createDataFrame(
        rows, "log_dataset string, sysname string, log_id bigint, type string, "
              "event_ts timestamp, last_ipl_ts timestamp")


def _run(spark, datasets, **kw):
    got = cycle_boundaries(_frame(spark, datasets), **kw).collect()
    return {r["log_dataset"]: tuple(r[c] for c in (
        "pre_ipl_ts", "shutdown_begin_ts", "shutdown_end_ts", "ipl_begin_ts",
        "ipl_end_ts", "post_ipl_ts", "last_ipl_ts")) for r in got}


def h(x):
    return DAY + dt.timedelta(hours=x)


FIXTURE_CASES = {
    "ordinary": [(SB, h(10), None), (SE, h(11), None), (IB, h(12), None), (IE, h(13), None), (IE, h(14), None)],
    "se_before_sb": [(SE, h(9), None), (SB, h(10), None), (SE, h(11), None)],
    "rejected_not_revisited": [(SB, h(10), None), (SE, h(9), None), (SB, h(8), None)],
    "ipled_last": [(IPLED, None, h(1)), (IPLED, None, h(0))],
}
EXPECTED = {
    "ordinary": (None, h(10), h(11), h(12), h(14), None, None),
    "se_before_sb": (None, h(10), h(9), None, None, None, None),
    "rejected_not_revisited": (None, h(8), None, None, None, None, None),
    "ipled_last": (None, None, None, None, None, None, h(0)),
}


@pytest.mark.parametrize("chunk", [2, 1 << 13])
def test_fixture_cases(spark, chunk):
    assert _run(spark, FIXTURE_CASES, chunk_rows=chunk) == EXPECTED


def _random_logs(seed, n_sets=40):
    rnd = random.Random(seed)
    out = {}
    for d in range(n_sets):
        n = rnd.randint(1, 40)
        evs = []
        for _ in range(n):
            typ = rnd.choice([SB, SE, IB, IE, PRE, POST, IPLED, SB, SE, IB, IE])
            ts = None if rnd.random() < 0.05 else h(rnd.randint(0, 30))
            lip = h(rnd.randint(0, 30)) if typ == IPLED else None
            evs.append((typ, None if typ == IPLED else ts, lip))
        out[f"D{d}"] = evs
    return out


@pytest.mark.parametrize("chunk", [3, 7, 1 << 13])
def test_matches_fold(spark, chunk):
    logs = _random_logs(7 + chunk)
    got = _run(spark, logs, chunk_rows=chunk)
    for name, evs in logs.items():
        assert got[name] == fold(evs), name


def test_spans_need_no_fold(spark):
    logs = _random_logs(3)
    got = {r["log_dataset"]: (r["pre_ipl_ts"], r["post_ipl_ts"], r["last_ipl_ts"])
           for r in dataset_spans(_frame(spark, logs)).collect()}
    for name, evs in logs.items():
        f = fold(evs)
        assert got[name] == (f[0], f[5], f[6])


def test_second_call_sees_new_rows_and_nothing_is_cached(spark, tmp_path):
    path = f"file://{tmp_path}/detail"
    _frame(spark, {"a": FIXTURE_CASES["ordinary"]}).write.parquet(path)
    assert cycle_boundaries(spark.read.parquet(path)).count() == 1
    _frame(spark, {"b": FIXTURE_CASES["ordinary"]}).write.mode("append").parquet(path)
    assert cycle_boundaries(spark.read.parquet(path)).count() == 2
    assert spark.sparkContext._jsc.getPersistentRDDs().isEmpty()


def _steps(monkeypatch):
    """Plans of the tables that the scan writes, and (of a test's own) of what it returns."""
    plans, write = [], B.written

    def recorded(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)
    monkeypatch.setattr(B, "written", recorded)
    return plans


def _row_exchanges(plan):
    """Exchanges that class rows go through: with their columns, or gathered to arrays.
    Those of counts come right after a partial HashAggregate."""
    lines = [x.strip(" :+-*()0123456789") for x in plan.split("\n")]
    out = [(a, b) for a, b in zip(lines, lines[1:]) if a.startswith(("Exchange", "BroadcastExchange"))]
    rows = [a for a, b in out if "partial_collect_list" in b]
    return rows + [a for a, b in out if a.startswith("Exchange") and "ggregate" not in b and ("event_ts" in b or "events" in b)]


@pytest.mark.parametrize("chunk", [5, 1 << 13])
def test_class_rows_are_shuffled_once(spark, monkeypatch, chunk):
    """Over all steps of cycle_boundaries, with and without carries."""
    plans = _steps(monkeypatch)
    out = cycle_boundaries(_frame(spark, _random_logs(5)), chunk_rows=chunk)
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert sum(len(_row_exchanges(p)) for p in plans) == 1
    assert len(plans) > 6 if chunk == 5 else len(plans) == 2


@pytest.mark.parametrize("spread", [10_000, 1])
def test_chunks_are_bounded_by_rows(spark, spread):
    """200,000 class rows, one each 10,000 lines or side by side, and a crowd at the end of a sparse log."""
    n, size = 200_000, 1 << 13
    rows = spark.range(n).select(F.lit("a").alias("log_dataset"), (F.col("id") * spread + 7).alias("_pos"))
    crowd = spark.range(n).select(F.lit("b").alias("log_dataset"), F.when(F.col("id") < 1000, F.col("id") * 10_000_000)
                                  .otherwise(F.col("id") + 10_000_000_000).alias("_pos"))
    few = spark.range(40).select(F.lit("c").alias("log_dataset"), F.shiftleft("id", 40).alias("_pos"))
    cut, _ = B.with_chunks(B.written(rows.unionByName(crowd).unionByName(few), "t"), size)
    by = cut.groupBy("log_dataset", "_chunk").agg(F.count("*").alias("n"), F.min("_pos").alias("lo"), F.max("_pos").alias("hi")).collect()
    assert sum(r.n for r in by) == 2 * n + 40 and max(r.n for r in by) <= size
    for name in "abc":
        mine = sorted((r for r in by if r.log_dataset == name), key=lambda r: r["_chunk"])
        assert len(mine) <= max(1, sum(r.n for r in mine) // 1000)
        assert all(x.hi < y.lo for x, y in zip(mine, mine[1:]))
        assert all(x["_chunk"] <= x.lo for x in mine)


def test_scan_tree_of_many_chunks(spark):
    """More chunks than share a window: groups of groups of chunks carry the values."""
    rnd = random.Random(11)
    logs = {"big": [(rnd.choice([SB, SE, IB, IE]), h(rnd.randint(0, 4000)), None) for _ in range(1500)], "one": [(SB, h(1), None)]}
    frame = _frame(spark, logs)
    assert {r["log_dataset"]: tuple(r[c] for c in ("pre_ipl_ts", "shutdown_begin_ts", "shutdown_end_ts", "ipl_begin_ts", "ipl_end_ts"))
            for r in cycle_boundaries(frame, chunk_rows=12).collect()} == {k: fold(v)[:5] for k, v in logs.items()}
    keys = B.written(spark.range(1500).select(F.lit("d").alias("log_dataset"), (F.col("id") * 64).alias("_chunk")), "t")
    assert len(B._chunk_tree(keys, 16)) >= 3


@pytest.mark.parametrize("chunk", [3, 1 << 13])
def test_running_values_at_every_row(spark, chunk):
    logs = _random_logs(21, 12)
    got = {}
    for r in running_boundaries(_frame(spark, logs), chunk_rows=chunk).collect():
        got[r["log_dataset"], r["log_id"]] = (r["_sb"], r["_se"], r["_ib"])
    for name, evs in logs.items():
        for k in range(len(evs)):
            assert got[name, k + 1] == fold(evs[:k + 1])[1:4]


def test_first_last(spark):
    logs = {"x": [(SB, h(10), None), (SB, h(8), None), (SE, h(11), None), (SE, h(12), None),
                  (IB, h(13), None), (IE, h(14), None), (IE, h(9), None)]}
    r = first_last_boundaries(_frame(spark, logs)).first()
    assert (r["shutdown_begin_ts"], r["shutdown_end_ts"], r["ipl_begin_ts"], r["ipl_end_ts"]) == \
        (h(10), h(12), h(13), h(14))
