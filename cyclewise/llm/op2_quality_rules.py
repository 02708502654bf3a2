"""Quality rules: base rules and cross-document line frequency [DataFrame functions only].

Base figures of a document come from its own text: words, word characters, symbols, repeated
lines, and words inside 8-word windows that occur twice or more.

Across documents, each line is normalised (A-Z lowered, separators collapsed) and hashed
(128 bits); for every host (``source``) the distinct documents that hold the line are
counted, where documents of equal text count once, so that copies do not turn
their own text into boilerplate.  A line in more than ``LINE_SHARE`` per cent of
the host's documents is removed, on hosts of any size; only lines in up to ``LINE_DOCUMENTS`` of
them, too few to tell boilerplate by, stay on the smallest hosts.  A
document that keeps under ``KEPT_SHARE`` per cent of its words is depleted and rejected.

Texts are read once and only hashes are shuffled, in two steps: plain counts (with map-side
sums) leave the few lines that can pass the limit at all, and distinct texts are counted for those
alone.  A host's frequent lines are a short array (see ``frequent_lines``) that joins its rows.

Cases: a null or empty text has no words, fails the base rules and has no lines; lines without a word do not count;
a null host is a host of its own; rows repeated exactly are judged each, and alike; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cyclewise.llm.common import (
    SEP_REGEX, SEPARATORS, WORD_REGEX, ascii_lower, materialise, n_words, read_table, scratch, words,
)

WINDOW = 8
MIN_WORDS = 20
REPEAT_SHARE = 30
LINE_SHARE = 5
LINE_DOCUMENTS = 5
KEPT_SHARE = 30
SYMBOLS = "#*$%&|<>"


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once for a row."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(w: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more in the array ``w``.

    Most texts have no such window, and that is seen from the distinct hashes alone. Else windows
    are sorted by (hash, place); those equal to a neighbour are repeated, and
    their places, sorted, cover min(WINDOW, step to the next place) words each."""
    def windows(hw: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(hw) - WINDOW),
                           lambda i: F.xxhash64(*[hw[i + k] for k in range(WINDOW)]))

    def places(s: Column) -> Column:
        def twice(x: Column, k: Column) -> Column:
            before = F.when(k > 0, s[k - 1]["h"] == x["h"]).otherwise(False)
            after = F.when(k + 1 < F.size(s), s[k + 1]["h"] == x["h"]).otherwise(False)
            return before | after
        return F.sort_array(F.transform(F.filter(s, twice), lambda x: x["i"]))

    def covered(p: Column) -> Column:
        return F.aggregate(p, F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")), lambda acc, i: F.struct(
            (acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n"), i.alias("last")))["n"]

    def repeated(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(
            _let(pairs, lambda s: _let(places(s), covered)))

    return F.when(F.size(w) < WINDOW, F.lit(0)).otherwise(
        _let(F.transform(w, lambda x: F.xxhash64(x)), lambda hw: _let(windows(hw), repeated)))


def base_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = F.coalesce(F.col(text).cast("string"), F.lit(""))
    kept = docs.columns
    one = _let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"),
                                               _repeat_words(w).cast("long").alias("n_repeat_words")))
    two = _let(_lines(text), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    out = docs.select(
        *kept, one.alias("_w"), F.length(F.translate(text, SEPARATORS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        two.alias("n_dup_lines"))
    failed = (F.col("_w.n_words") < MIN_WORDS) | (100 * F.col("_w.n_repeat_words") > REPEAT_SHARE * F.col("_w.n_words"))
    return out.select(*kept, F.col("_w.n_words").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines",
                      F.col("_w.n_repeat_words").alias("n_repeat_words"), failed.alias("base_failed"))


def _lines(text: Column) -> Column:
    """Lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD_REGEX))


def _normalised(line: Column) -> Column:
    return F.trim(F.regexp_replace(ascii_lower(line), SEP_REGEX, " "))


def _key(line: Column) -> Column:
    """128-bit key of a line."""
    return _let(_normalised(line), lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b")))


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, text, host, no_host and the text's hash t."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", text.alias("text"), *_host(), F.xxhash64(F.lit(7), text).alias("t"))


def _host() -> list[Column]:
    return [F.coalesce(F.col("source").cast("string"), F.lit("")).alias("host"), F.col("source").isNull().alias("no_host")]


def line_keys(text: str = "text") -> Column:
    """array<struct<k, n>>: key and words of each line of a document that holds a word."""
    return F.transform(_lines(F.col(text)), lambda x: F.struct(
        _key(x).alias("k"), F.regexp_count(x, F.lit(WORD_REGEX)).alias("n")))


def frequent_lines(rows: DataFrame, share: int = LINE_SHARE, least: int = LINE_DOCUMENTS) -> DataFrame:
    """host, no_host, frequent: the keys of each host's lines above the limit.

    ``rows`` has host, no_host, t and lines (``line_keys``).  A host's array is bounded: each of its lines
    stands in over ``share`` per cent of its documents, so there are fewer than 100 / share times
    the lines of a mean document."""
    host = ["host", "no_host"]
    hosts = rows.select(*host, "t").distinct().groupBy(*host).agg(F.count(F.lit(1)).alias("n_docs"))
    keys = rows.select(*host, "t", F.explode(F.array_distinct(F.transform("lines", lambda x: x["k"]))).alias("k"))
    keys = keys.select(*host, "t", "k.a", "k.b")
    over = lambda c: (F.col(c) > least) & (100 * F.col(c) > share * F.col("n_docs"))
    often = keys.groupBy(*host, "a", "b").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > least)
    often = materialise(often.join(hosts, host).where(over("c")).select(*host, "a", "b", "n_docs"), "often-lines")
    exact = keys.join(often, [*host, "a", "b"]).distinct().groupBy(*host, "a", "b", "n_docs").agg(
        F.count(F.lit(1)).alias("d"))
    found = exact.where(over("d")).groupBy(*host).agg(F.collect_list(F.struct("a", "b")).alias("frequent"))
    return materialise(found, "frequent-lines")


def _removed_words(lines: Column, frequent: Column) -> Column:
    return F.when(frequent.isNull(), F.lit(0)).otherwise(F.aggregate(
        lines, F.lit(0), lambda acc, x: acc + F.when(F.array_contains(frequent, x["k"]), x["n"]).otherwise(0))).cast("long")


def _depleted(n_words: str, removed: str) -> Column:
    return 100 * (F.col(n_words) - F.col(removed)) < KEPT_SHARE * F.col(n_words)


def judge(docs: DataFrame, share: int = LINE_SHARE, least: int = LINE_DOCUMENTS) -> DataFrame:
    """One row per row of ``docs``: the base figures, base_failed,
    n_line_words_removed, depleted, kept.  The texts are read once."""
    rows = base_rules(identified(docs).withColumn("lines", line_keys())).drop("text")
    rows = materialise(rows, "line-keys")
    out = rows.join(frequent_lines(rows, share, least), ["host", "no_host"], "left")
    out = out.withColumn("n_line_words_removed", _removed_words(F.col("lines"), F.col("frequent")))
    out = out.withColumn("depleted", _depleted("n_words", "n_line_words_removed"))
    out = out.withColumn("kept", ~F.col("base_failed") & ~F.col("depleted"))
    return out.drop("lines", "frequent", "host", "no_host", "t")


def clean(docs: DataFrame, share: int = LINE_SHARE, least: int = LINE_DOCUMENTS) -> DataFrame:
    """The kept rows of ``docs``, without the lines above the limit; texts are not shuffled
    but for the join with the hosts where their table is large."""
    names = docs.columns
    with scratch(docs.sparkSession) as keep:
        lines = materialise(identified(docs).select("host", "no_host", "t", line_keys().alias("lines")), "line-keys")
        frequent = keep(frequent_lines(lines, share, least), "frequent")
    plain = docs.select(*[F.col(c).alias(f"c_{c}") for c in names], *_host())
    rows = base_rules(plain.join(frequent, ["host", "no_host"], "left"), "c_text")
    rows = rows.where(~F.col("base_failed"))
    text = F.coalesce(F.col("c_text").cast("string"), F.lit(""))
    left = F.when(F.col("frequent").isNull(), text).otherwise(F.array_join(F.filter(
        F.split(text, "\n"), lambda x: ~(x.rlike(WORD_REGEX) & F.array_contains(F.col("frequent"), _key(x)))), "\n"))
    rows = rows.withColumn("left", left).withColumn("removed", F.col("n_words") - n_words(F.col("left")))
    rows = rows.where(~_depleted("n_words", "removed"))
    changed = F.col("removed") > 0
    value = {c: F.col(f"c_{c}") for c in names}
    value["text"] = F.when(changed, F.col("left")).otherwise(F.col("c_text"))
    if "n_chars" in value:
        value["n_chars"] = F.when(changed, F.length("left")).otherwise(value["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return rows.select(*[value[c].alias(c) for c in names])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_line_words_removed", "depleted")


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, source IS NULL AS no_host, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, host, no_host, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
win AS (SELECT doc_id, i, array_to_string(w[i:i+7], ' ') AS g
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w)),
rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, range(0, 8) AS r(k) GROUP BY doc_id),
ln AS (SELECT doc_id, host, no_host, md5(text) AS t, line,
              array_to_string(regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                 '[^\x20\x09-\x0D]+'), ' ') AS norm,
              len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n
       FROM (SELECT *, unnest(string_split(text, chr(10))) AS line FROM d)
       WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM ln GROUP BY doc_id),
hosts AS (SELECT host, no_host, count(DISTINCT md5(text)) AS n_docs FROM d GROUP BY ALL),
freq AS (SELECT host, no_host, norm FROM ln JOIN hosts USING (host, no_host) GROUP BY host, no_host, norm, n_docs
         HAVING count(DISTINCT t) > 5 AND 100 * count(DISTINCT t) > 5 * n_docs),
gone AS (SELECT doc_id, sum(n) AS n FROM ln JOIN freq USING (host, no_host, norm) GROUP BY doc_id),
m AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
             length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols FROM w)
SELECT doc_id, n_words, CAST(word_chars AS BIGINT) AS word_chars, n_symbols, coalesce(dup.n, 0) AS n_dup_lines,
       coalesce(cov.n, 0) AS n_repeat_words,
       n_words < 20 OR 100 * coalesce(cov.n, 0) > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * coalesce(cov.n, 0) > 30 * n_words)
         AND NOT 100 * (n_words - coalesce(gone.n, 0)) < 30 * n_words AS kept,
       CAST(coalesce(gone.n, 0) AS BIGINT) AS n_line_words_removed,
       100 * (n_words - coalesce(gone.n, 0)) < 30 * n_words AS depleted
FROM m LEFT JOIN dup USING (doc_id) LEFT JOIN cov USING (doc_id) LEFT JOIN gone USING (doc_id)
"""
