"""Log line parsing: prefilter, tokenize, record layout, classification.

Input is a syslog-lines DataFrame ``(log_dataset, sysname, line_no, line)``
(optionally ``part_no``); output is the detail (event) table, one row per
kept line.  One narrow projection: every step is a built-in expression, so
the whole parse runs inside a single whole-stage-codegen span right after
the scan, and the prefilter drops lines before any split happens.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import catalogue as cat
from ..functions.timefmt import event_timestamp, ipled_timestamp, julian_to_date, normalize_time

DIGITS = "^[0-9]+$"


def _sq(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _any_contains(col: str, tokens) -> str:
    return "(" + " OR ".join(f"contains({col}, {_sq(t)})" for t in tokens) + ")"


def _word(words: str, i: int) -> str:
    """Word ``i`` (0-based) of the line, '' when missing (as awk fields)."""
    return f"coalesce(get({words}, {i}), '')"


def message_prefilter(lines: DataFrame, line_col: str = "line", patterns: str | None = None) -> DataFrame:
    """Keep lines matching any of the patterns (``patterns``: one regex, as
    ``load_patterns`` returns it; else the fixed catalogue)."""
    return lines.filter(matches(F.col(line_col), patterns or cat.prefilter_regex()))


def matches(line: Column, patterns: str) -> Column:
    """Whether ``line`` matches the regular expression.  Alternatives that are plain words are
    looked for as such, which takes a tenth of the time of one large expression."""
    if re.search(r"[()\[\]{}\\]", patterns):
        return line.rlike(patterns)
    parts = patterns.split("|")
    words = [p for p in parts if re.fullmatch("[A-Za-z0-9 ]+", p)]
    others = [p for p in parts if p not in words]
    tests = [line.contains(w) for w in words] + ([line.rlike("|".join(others))] if others else [])
    return reduce(lambda a, b: a | b, tests)


def tokenize(line: Column) -> Column:
    """blank/tab separated words, leading blanks ignored."""
    return F.split(F.regexp_replace(line, "^[ \\t]+", ""), "[ \\t]+")


def classify_sql(line: str = "line", words: str = "_w") -> str:
    """C4 as a SQL expression: first matching class wins; NULL when none."""
    jes3 = (f"(contains({line}, {_sq(cat.END_OF_SHUTDOWN_JES3)}) AND "
            f"contains({_word(words, 7)}, {_sq(cat.END_OF_SHUTDOWN_JES3_WORD8)}))")
    branches = [
        (_any_contains(line, cat.SHUTDOWN_BEGIN_TOKENS), cat.SHUTDOWN_BEGIN),
        (f"({_any_contains(line, cat.END_OF_SHUTDOWN_TOKENS)} OR {jes3})", cat.END_OF_SHUTDOWN),
        (_any_contains(line, cat.IPL_BEGIN_TOKENS), cat.IPL_BEGIN),
        (_any_contains(line, cat.IPL_END_TOKENS), cat.IPL_END),
        (_any_contains(line, cat.PRE_IPL_TOKENS), cat.PRE_IPL),
        (_any_contains(line, cat.POST_IPL_TOKENS), cat.POST_IPL),
    ]
    return "CASE " + " ".join(f"WHEN {c} THEN {_sq(t)}" for c, t in branches) + " END"


def record_layout_sql(line: str = "line", words: str = "_w") -> str:
    """C2 as a SQL expression: number (1-8) of the first matching layout."""
    w = lambda i: _word(words, i)
    d = lambda i: f"{w(i)} RLIKE '{DIGITS}'"
    return (f"CASE WHEN contains({w(4)}, ':') THEN 1 "
            f"WHEN contains({line}, {_sq(cat.SYSTEM_IPLED_TOKEN)}) THEN 2 "
            f"WHEN contains({w(3)}, ':') THEN 3 "
            f"WHEN contains({w(4)}, 'R=') THEN 4 "
            f"WHEN {d(1)} AND {d(2)} THEN 5 "
            f"WHEN {d(1)} THEN 6 "
            f"WHEN {d(2)} AND {d(3)} THEN 7 ELSE 8 END")


_W = "_w"
SYSTEM_OK_SQL = (f"CASE WHEN layout = 1 THEN contains({_word(_W, 2)}, sysname) "
                 f"WHEN layout = 3 THEN contains({_word(_W, 1)}, sysname) ELSE true END")
DATE_RAW_SQL = (f"CASE WHEN layout = 1 THEN {_word(_W, 3)} WHEN layout = 3 THEN {_word(_W, 2)} "
                f"WHEN layout IN (4, 5, 6) THEN {_word(_W, 1)} WHEN layout = 7 THEN {_word(_W, 2)} END")
TIME_RAW_SQL = (f"CASE WHEN layout = 1 THEN {_word(_W, 4)} WHEN layout = 3 THEN {_word(_W, 3)} "
                f"WHEN layout IN (4, 5) THEN {_word(_W, 2)} WHEN layout = 7 THEN {_word(_W, 3)} END")
TYPE_SQL = f"CASE WHEN layout = 2 THEN {_sq(cat.SYSTEM_IPLED)} WHEN layout <> 8 THEN {classify_sql()} END"
ERROR_SQL = f"CASE WHEN type IS NULL AND layout <> 8 AND {_any_contains('line', cat.ERROR_TOKENS)} THEN 'y' END"


def parse_lines(lines: DataFrame, prefilter: bool = True, patterns: str | None = None) -> DataFrame:
    """Syslog lines -> detail rows.

    Columns out: log_dataset, sysname, log_id, [part_no], layout, date_raw,
    time_raw, event_date, event_time, event_ts, type, error, last_ipl_ts, msg.
    Layouts 1 and 3 carry a system word that must contain the dataset's
    system name (C3); lines failing it, or of an unknown system, produce no row.  Four projections of
    built-in expressions, all inside one whole-stage-codegen span.
    """
    src = message_prefilter(lines, patterns=patterns) if prefilter else lines
    extra = [c for c in ("part_no",) if c in lines.columns]
    # Words come out of a one-row generator: a filter on them (C3) cannot be
    # pushed below it, so Catalyst does not inline the split into every word
    # reference (which would re-split each line once per reference).
    staged = src.select("log_dataset", "sysname", "line_no", "line", *extra,
                        F.inline(F.array(F.struct(tokenize(F.col("line")).alias(_W)))))
    staged = staged.select("*", F.expr(record_layout_sql()).alias("layout")) \
        .filter(F.expr(SYSTEM_OK_SQL))
    typed = staged.select(
        "log_dataset", "sysname", F.col("line_no").alias("log_id"), *extra, "layout", "line",
        F.expr(DATE_RAW_SQL).alias("date_raw"), F.expr(TIME_RAW_SQL).alias("time_raw"),
        F.expr(TYPE_SQL).alias("type"),
        F.when(F.col("layout") == 2, ipled_timestamp(F.expr(_word(_W, 6)), F.expr(_word(_W, 8)))).alias("last_ipl_ts"))
    dated = typed.select(
        "*", julian_to_date(F.col("date_raw")).alias("event_date"),
        normalize_time(F.col("time_raw")).alias("event_time"),
        F.expr(ERROR_SQL).alias("error"))
    return dated.select(
        "log_dataset", "sysname", "log_id", *extra, "layout", "date_raw", "time_raw",
        "event_date", "event_time",
        event_timestamp(F.col("event_date"), F.col("event_time")).alias("event_ts"),
        "type", "error", "last_ipl_ts", F.col("line").alias("msg"))


def error_lines(detail: DataFrame) -> DataFrame:
    """Detail rows flagged as errors."""
    return detail.filter(F.col("error") == "y")


def jes_level(lines: DataFrame, single_dataset: bool = False) -> DataFrame:
    """JES level words from allocation messages of the syslog.

    Multi-part form: lines with IEF237I, JES, ALLOCATED and SYSLOG -> 10th
    awk field (word 8).  Single-dataset form: JES and SYSLOG -> 9th field of
    the unnumbered line (word 8).  Distinct per dataset.
    """
    line = F.col("line")
    words = tokenize(line)
    if single_dataset:
        cond = line.contains("JES") & line.contains("SYSLOG")
    else:
        cond = (line.contains("IEF237I") & line.contains("JES")
                & line.contains("ALLOCATED") & line.contains("SYSLOG"))
    return (lines.filter(cond)
            .select("log_dataset", F.coalesce(F.get(words, 8), F.lit("")).alias("jes_level"))
            .distinct())
