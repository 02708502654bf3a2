"""Per-dataset reduction of detail rows to cycle boundaries.

F1 is an ordered fold: in log order, keep

* shutdown_begin = min of SHUTDOWN BEGIN times;
* shutdown_end   = min of END OF SHUTDOWN times later than the *running*
  shutdown_begin at that row (an unset predecessor accepts anything);
* ipl_begin      = min of IPL BEGIN times later than the running shutdown_end;
* ipl_end        = max of IPL END times later than the running ipl_begin.

Each level is a prefix scan whose filter depends on the previous level's
running value at the same row.  A window partitioned by dataset would put a
whole log dataset into one task, so the scan goes over chunks, always:

1. the class rows (nothing else takes part) are written once, as they come;
2. chunks of at most ``chunk_rows`` rows are found from counts (``with_chunks``):
   ranges of positions whose width follows the density of the rows, so neither
   sparse nor crowded stretches make many or large chunks;
3. rows are brought together by chunk, the one shuffle of class rows: a chunk is then one row
   with an array in log order, and a fold over it gives the four running values
   at its end from those at its start;
4. a level's values at the start of every chunk (its carry) are the minima of all earlier
   chunks, by a scan over the chunks' own table, a tree of scans where
   a dataset has more than ``chunk_rows`` chunks.  Level after level, the fold runs
   on the carries found so far.

Where no dataset has more than one chunk, no carry exists and step 3 is all.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import catalogue as cat
from ..session import written

# Class rows of one dataset that are folded in one array, and chunks that share a window.
DEFAULT_CHUNK_ROWS = 1 << 13
# Position of a line inside a multi-part log: part number in the high bits.
PART_SHIFT = 1 << 40
# Up to so many chunks (some 64 MB of carries) their table is broadcast; beyond, Spark joins by size.
_BROADCAST_CHUNKS = 1 << 20
# Rounds of halving crowded ranges; the last takes ranges of ``chunk_rows`` positions.
_ROUNDS = 3

_KEY = ["log_dataset", "_chunk"]
# (class, running value), each filtered by the one before
_LEVELS = [(cat.SHUTDOWN_BEGIN, "_sb"), (cat.END_OF_SHUTDOWN, "_se"), (cat.IPL_BEGIN, "_ib"), (cat.IPL_END, "_ie")]
_RUNNING = [name for _, name in _LEVELS]


def with_position(detail: DataFrame) -> DataFrame:
    """Add ``_pos``: the log order."""
    pos = F.col("log_id").cast("bigint")
    if "part_no" in detail.columns:
        pos = F.col("part_no").cast("bigint") * F.lit(PART_SHIFT) + pos
    return detail.withColumn("_pos", pos)


def with_chunks(rows: DataFrame, chunk_rows: int = DEFAULT_CHUNK_ROWS, position: str = "_pos",
                chunk: str = "_chunk") -> tuple[DataFrame, int]:
    """``rows`` (a written table) plus ``chunk``, the first position of the row's chunk, and the
    number of rounds that cut datasets (0: every dataset is one chunk).

    A dataset of up to ``chunk_rows`` rows is one chunk.  A larger one is cut into ranges of 2^k
    positions, k by its density so that a range holds about a quarter of ``chunk_rows``; ranges that
    hold more are cut again by their own density, and at last into ranges of ``chunk_rows`` positions.  The table of
    what is cut has at most one row for every ``chunk_rows`` rows; AQE broadcasts it when it measures small.
    """
    least = max(chunk_rows.bit_length() - 1, 0)
    pos, key = F.col(position), ["log_dataset", chunk]
    # NULL stands for a dataset's whole range, and is a group of its own here
    out = rows.withColumn(chunk, F.lit(None).cast("bigint"))
    for round_ in range(_ROUNDS):
        n = F.count(F.lit(1))
        span = F.max(pos) - F.min(pos) + 1
        fit = F.floor(F.log2(F.greatest(span * F.lit(max(chunk_rows / 4.0, 2.0)) / n, F.lit(1.0))))
        width = F.lit(least) if round_ == _ROUNDS - 1 else F.greatest(fit, F.lit(least))
        heavy = out.groupBy(*key).agg(n.alias("_n"), width.cast("int").alias("_k"), span.alias("_span"))
        heavy = heavy.where((F.col("_n") > chunk_rows) & (F.col("_span") > F.shiftleft(F.lit(1).cast("bigint"), least)))
        if heavy.isEmpty():
            return out.withColumn(chunk, F.coalesce(chunk, F.lit(-(1 << 62)))), round_
        heavy = written(heavy.select("log_dataset", F.col(chunk).alias("_cut"), "_k"), "chunk-cuts")
        on = (out["log_dataset"].eqNullSafe(heavy["log_dataset"])) & (out[chunk].eqNullSafe(heavy["_cut"]))
        finer = F.when(F.col("_k").isNotNull(), F.expr(f"shiftleft(shiftright({position}, _k), _k)")).otherwise(F.col(chunk))
        kept = [out[c] for c in rows.columns]
        out = out.join(heavy, on, "left").select(*kept, finer.alias(chunk))
    return out.withColumn(chunk, F.coalesce(chunk, F.lit(-(1 << 62)))), _ROUNDS


def _ts_of(type_name: str) -> Column:
    return F.when((F.col("type") == type_name) & F.col("event_ts").isNotNull(),
                  F.col("event_ts"))


def _fold(events: str, carries: list[Column]) -> Column:
    """Running values (a struct of ``_RUNNING``) after the rows of an array of (pos, level,
    ts), from those before it."""
    known = [*carries, *[F.lit(None).cast("timestamp")] * (len(_LEVELS) - len(carries))]
    start = F.struct(*[c.alias(name) for c, name in zip(known, _RUNNING)])

    def step(acc: Column, row: Column) -> Column:
        out, before = [], None
        for level, name in enumerate(_RUNNING):
            taken = row["level"] == level
            if before is not None:
                taken = taken & (acc[before].isNull() | (row["ts"] > acc[before]))
            better = F.greatest if name == "_ie" else F.least
            out.append(F.when(taken, better(acc[name], row["ts"])).otherwise(acc[name]).alias(name))
            before = name
        return F.struct(*out)

    return F.aggregate(F.col(events), start, step)


def _chunk_tree(chunks: DataFrame, fan: int) -> list[DataFrame]:
    """Tables (log_dataset, _chunk, _up): chunks, their groups, the groups' groups ..., until
    no dataset has more than ``fan`` in the last, whose ``_up`` is one for all."""
    tree, rows = [], chunks.select(*_KEY)
    while True:
        cut, rounds = with_chunks(rows, fan, "_chunk", "_up")
        tree.append(cut if rounds == 0 else written(cut, "chunk-tree"))
        if rounds == 0:
            return tree
        up = written(tree[-1].select("log_dataset", F.col("_up").alias("_chunk")).distinct(), "chunk-tree")
        if up.count() >= rows.count():  # equal positions cannot be cut: leave them together
            return [*tree[:-1], cut.withColumn("_up", F.lit(0).cast("bigint"))]
        rows = up


def _earlier_minima(values: DataFrame, tree: list[DataFrame], name: str) -> DataFrame:
    """(log_dataset, _chunk, ``name``): the least value of all earlier chunks of the dataset, from
    ``values`` (log_dataset, _chunk, _m).  Up the tree by minima, down by a window a group."""
    groups, sums = [], values
    for table in tree:
        sums = sums.join(table, _KEY)
        groups.append(sums)
        sums = sums.groupBy("log_dataset", F.col("_up").alias("_chunk")).agg(F.min("_m").alias("_m"))
    carry = None
    for group in reversed(groups):
        earlier = (Window.partitionBy("log_dataset", "_up").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1))
        mine = F.min("_m").over(earlier)
        if carry is None:
            carry = group.select(*_KEY, mine.alias(name))
        else:
            above = carry.select("log_dataset", F.col("_chunk").alias("_up"), F.col(name).alias("_c"))
            carry = group.select(*_KEY, "_up", mine.alias("_l")).join(above, ["log_dataset", "_up"]).select(
                *_KEY, F.least("_c", "_l").alias(name))
    return carry


def _carries(chunks: DataFrame, chunk_rows: int) -> DataFrame:
    """(log_dataset, _chunk, _sb_c, _se_c, _ib_c): running values at the start of every chunk
    of ``chunks``, a written table (log_dataset, _chunk, events ...)."""
    tree = _chunk_tree(chunks, chunk_rows)
    held = tree[0].select(*_KEY)
    small = held.count() <= _BROADCAST_CHUNKS
    for level, name in enumerate(_RUNNING[:-1]):
        found = [f"{n}_c" for n in _RUNNING[:level]]
        ends = chunks.select(*_KEY, "events").join(F.broadcast(held) if small else held, _KEY).select(*_KEY, _fold("events", [F.col(c) for c in found])[name].alias("_m"))
        held = written(held.join(_earlier_minima(ends, tree, f"{name}_c"), _KEY).select(*_KEY, *found, f"{name}_c"), "chunk-carries")
    return F.broadcast(held) if small else held


def _plain() -> dict[str, Column]:
    """F2, F3 and the D11 flag: plain aggregates of class rows with ``_pos``."""
    ipled = F.when((F.col("type") == cat.SYSTEM_IPLED) & F.col("last_ipl_ts").isNotNull(), F.col("_pos"))
    return {"sysname": F.max("sysname"), "pre_ipl_ts": F.min(_ts_of(cat.PRE_IPL)),
            "post_ipl_ts": F.max(_ts_of(cat.POST_IPL)), "last_ipl_ts": F.max_by("last_ipl_ts", ipled),
            "has_ipl": F.max(F.col("type").rlike(cat.DATASET_KEEP_TYPE_PATTERN))}


def _events() -> Column:
    """The rows of the four classes with a time, in log order."""
    level = reduce(lambda out, k: F.when(F.col("type") == _LEVELS[k][0], k).otherwise(out), range(len(_LEVELS)), F.lit(None).cast("int"))
    row = F.struct("_pos", level.alias("level"), F.col("event_ts").alias("ts"))
    return F.sort_array(F.collect_list(F.when(level.isNotNull() & F.col("event_ts").isNotNull(), row))).alias("events")


def running_boundaries(detail: DataFrame, chunk_rows: int = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """G1: every row of ``detail`` with the accepted candidates of each level.

    Adds ``_sb_x``, ``_se_x``, ``_ib_x``, ``_ie_x`` (the row's time when the
    row is of that class *and* accepted by the running-accept rule, else
    NULL) and the running values ``_sb``, ``_se``, ``_ib`` at the row.
    """
    rows, rounds = with_chunks(written(with_position(detail), "class-rows"), chunk_rows)
    if rounds:
        rows = written(rows, "class-rows")
        carries = _carries(written(rows.groupBy(*_KEY).agg(_events()), "chunks"), chunk_rows)
        rows = rows.join(carries, _KEY)
    window = (Window.partitionBy(*_KEY).orderBy("_pos")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    prev = None
    for cls, name in _LEVELS:
        cand = _ts_of(cls)
        if prev is not None:
            cand = F.when(cand.isNotNull() & (F.col(prev).isNull() | (F.col("event_ts") > F.col(prev))),
                          F.col("event_ts"))
        rows = rows.withColumn(f"{name}_x", cand)
        if name != _RUNNING[-1]:
            here = F.min(f"{name}_x").over(window)
            rows = rows.withColumn(name, F.least(f"{name}_c", here) if rounds else here)
        prev = name
    return rows.drop(*[f"{n}_c" for n in _RUNNING])


BOUNDARY_COLUMNS = ["pre_ipl_ts", "shutdown_begin_ts", "shutdown_end_ts",
                    "ipl_begin_ts", "ipl_end_ts", "post_ipl_ts", "last_ipl_ts"]
_FOLDED = dict(zip(_RUNNING, BOUNDARY_COLUMNS[1:5]))


def _class_rows(detail: DataFrame) -> DataFrame:
    return detail.filter(F.col("type").isNotNull()).select(
        "log_dataset", "sysname", "log_id", *(["part_no"] if "part_no" in detail.columns else []),
        "type", "event_ts", "last_ipl_ts")


def dataset_spans(detail: DataFrame) -> DataFrame:
    """F2 + F3 + D11 flag without the fold: sysname, log_dataset, pre_ipl_ts,
    post_ipl_ts, last_ipl_ts (the last SYSTEM IPLED time in log order), has_ipl."""
    rows = with_position(_class_rows(detail))
    return rows.groupBy("log_dataset").agg(*[v.alias(k) for k, v in _plain().items()])


def cycle_boundaries(detail: DataFrame, chunk_rows: int = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """F1 + F2 + F3 (+ D11 flag): one row per log dataset.

    Columns: sysname, log_dataset, pre_ipl_ts, shutdown_begin_ts,
    shutdown_end_ts, ipl_begin_ts, ipl_end_ts, post_ipl_ts, last_ipl_ts, has_ipl.
    Only class rows take part (rows without a type are dropped before the
    first shuffle, so they never reach the scan).
    """
    rows, rounds = with_chunks(written(with_position(_class_rows(detail)), "class-rows"), chunk_rows)
    plain = {k: v.alias(k) for k, v in _plain().items()}
    if not rounds:
        ends = rows.groupBy("log_dataset").agg(_events(), *plain.values()).withColumn("_f", _fold("events", []))
        return ends.select("sysname", "log_dataset", *_shown({n: F.col("_f")[n] for n in _RUNNING}), "has_ipl")
    # the place of a chunk's last SYSTEM IPLED orders them between chunks
    ipled = F.max(F.when((F.col("type") == cat.SYSTEM_IPLED) & F.col("last_ipl_ts").isNotNull(), F.col("_pos"))).alias("_last")
    chunks = written(rows.groupBy(*_KEY).agg(_events(), ipled, *plain.values()), "chunks")
    ends = chunks.join(_carries(chunks, chunk_rows), _KEY).withColumn("_f", _fold("events", [F.col(f"{n}_c") for n in _RUNNING[:-1]]))
    merged = {"sysname": F.max("sysname"), "pre_ipl_ts": F.min("pre_ipl_ts"), "post_ipl_ts": F.max("post_ipl_ts"),
              "last_ipl_ts": F.max_by("last_ipl_ts", "_last"), "has_ipl": F.max("has_ipl")}
    folded = {_FOLDED[n]: (F.max if n == "_ie" else F.min)(F.col("_f")[n]) for n in _RUNNING}
    return ends.groupBy("log_dataset").agg(*[v.alias(k) for k, v in (merged | folded).items()]).select(
        "sysname", "log_dataset", *BOUNDARY_COLUMNS, "has_ipl")


def _shown(folded: dict[str, Column]) -> list[Column]:
    by = {_FOLDED[n]: c for n, c in folded.items()}
    return [by[c].alias(c) if c in by else F.col(c) for c in BOUNDARY_COLUMNS]


def datasets_with_ipl(boundaries: DataFrame) -> DataFrame:
    """Drop datasets whose detail never shows an IPL-type row."""
    return boundaries.filter(F.col("has_ipl"))


def detail_with_ipl(detail: DataFrame) -> DataFrame:
    """D11 on detail rows: those of datasets that show an IPL-type row."""
    kept = detail.filter(F.col("type").rlike(cat.DATASET_KEEP_TYPE_PATTERN)).select("log_dataset").distinct()
    return detail.join(kept, "log_dataset", "left_semi")


def first_last_boundaries(detail: DataFrame) -> DataFrame:
    """interactive variant: first SHUTDOWN BEGIN, last END OF SHUTDOWN,
    first IPL BEGIN, first IPL END, by file order, no ordering checks."""
    rows = with_position(detail.filter(F.col("type").isNotNull()))

    def pos_of(t):
        return F.when(_ts_of(t).isNotNull(), F.col("_pos"))

    return rows.groupBy("log_dataset").agg(
        F.max("sysname").alias("sysname"),
        F.min_by("event_ts", pos_of(cat.SHUTDOWN_BEGIN)).alias("shutdown_begin_ts"),
        F.max_by("event_ts", pos_of(cat.END_OF_SHUTDOWN)).alias("shutdown_end_ts"),
        F.min_by("event_ts", pos_of(cat.IPL_BEGIN)).alias("ipl_begin_ts"),
        F.min_by("event_ts", pos_of(cat.IPL_END)).alias("ipl_end_ts"),
    ).select("sysname", "log_dataset", "shutdown_begin_ts", "shutdown_end_ts",
             "ipl_begin_ts", "ipl_end_ts")


def lines_processed(detail: DataFrame) -> DataFrame:
    """number of the last line in each dataset's detail output."""
    return detail.groupBy("log_dataset").agg(
        F.max(F.col("log_id").cast("bigint")).alias("lines_processed"))


def union_log_parts(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """Join several log datasets into one, in part order.

    ``rows`` are detail rows (parsed before they are joined: class rows are few,
    raw lines are not).  ``parts`` maps ``log_dataset`` -> ``(group_name,
    part_no)``; the joined log is named after its first part (``group_name``)
    and ordered by ``(part_no, line number)``.  Line numbers restart in every
    part, as each part is numbered on its own.  A dataset may be a part of several
    logs, or several times of one; the join is left to AQE (broadcast when its measured size is small).
    """
    return (rows.join(parts, "log_dataset")
            .drop("log_dataset")
            .withColumnRenamed("group_name", "log_dataset"))


def parts_of_lists(lists: DataFrame) -> DataFrame:
    """Part lists as they are typed, ``(list_no, parts)`` with parts ``a|b|c``, to the ``parts`` that
    ``union_log_parts`` takes.  A dataset may stand in several lists, and several times in one; the
    output is named after the first part, and of lists that start alike the last one counts.  Blanks
    around names and empty names are ignored."""
    names = F.filter(F.transform(F.split("parts", "[|]"), lambda x: F.trim(x)), lambda x: x != "")
    named = lists.select("list_no", names.alias("_names")).where(F.size("_names") > 0)
    named = named.select("list_no", F.col("_names")[0].alias("group_name"), "_names")
    last = named.groupBy("group_name").agg(F.max_by("_names", "list_no").alias("_names"))
    return last.select("group_name", F.posexplode("_names").alias("part_no", "log_dataset"))
