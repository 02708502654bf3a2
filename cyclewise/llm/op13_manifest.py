"""Merkle dataset manifest: hash trees by sibling-shift self-joins.

Each row is a leaf, the hash of its fields.  Leaves of a group (language) stand in the order of the key; every
``FAN`` consecutive nodes become one parent, level by level, to the group's root; the groups' roots, in the order of
the groups, likewise make the root of the data set.

A level is a self-join of its nodes: the nodes of slot 0 equijoin, for each offset k, the nodes whose
index less k is theirs (the node k places on, if the last run has one), and these slot-zero rows emit the parents.
All joins of a level have one key, so its nodes are shuffled once.  Going down again, each run's
row joins its parent's path to the root and deals it to its nodes: a proof comes from one join for each row.

Leaves are dealt by ranges of (group, key), so one group may hold all rows and still spread; the driver sees two
numbers (the largest group, the number of groups).  A path grows with the logarithm of the rows.

Cases: a null field hashes as ``-``; a null group comes first, apart from the empty one; null keys come first; rows of
one key are ordered by their leaves, repeated rows get leaves of their own, alike and side by side; very long texts
are hashed whole; a null key is never tampered with; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cyclewise.llm.common import ascii_lower, materialise, read_table
from cyclewise.llm.ranks import ranked

FAN = 8
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def field(value: Column) -> Column:
    """``-`` for null, else UTF-8 byte count, ``:``, value."""
    s = value.cast("string")
    return F.when(s.isNull(), "-").otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the parts' concatenation."""
    return F.sha2(F.concat(*parts), 256)


def _group_key(group: Column) -> Column:
    """A text without nulls in the order of the groups, null first."""
    return F.when(group.isNull(), "-").otherwise(F.concat(F.lit("="), group.cast("string")))


def _levels(nodes: DataFrame, largest: int, name: str) -> list[DataFrame]:
    """Runs of each level, (g, idx, n, h, kids): place and hash of the parent, number of
    parents in its group, hashes of its nodes.  ``nodes`` is a table of (g, idx, n, h)."""
    levels, cur = [], nodes
    while largest > 1:
        def slot(k: int) -> DataFrame:
            return cur.where((F.col("n") > 1) & (F.col("idx") % FAN == k))
        runs = slot(0).select("g", F.col("idx").alias("first"), "n", F.col("h").alias("h0"))
        for k in range(1, FAN):
            runs = runs.join(slot(k).select("g", (F.col("idx") - k).alias("first"), F.col("h").alias(f"h{k}")), ["g", "first"], "left")
        kids = F.array_compact(F.array(*[f"h{k}" for k in range(FAN)]))
        runs = runs.select("g", F.expr(f"first div {FAN}").alias("idx"), F.expr(f"(n + {FAN - 1}) div {FAN}").alias("n"), kids.alias("kids"))
        cur = materialise(runs.withColumn("h", F.sha2(F.array_join("kids", ""), 256)), f"{name}-level")
        levels.append(cur)
        largest = -(-largest // FAN)
    return levels


def _tops(nodes: DataFrame, levels: list[DataFrame]) -> list[DataFrame]:
    """For each level, nodes that are the root of their group: (g, idx, h)."""
    return [t.where("n = 1").select("g", "idx", "h") for t in (nodes, *levels)]


#: Siblings to the left and right of a node among its run's ``kids``, as texts.
def _sides(slot: Column) -> Column:
    return F.struct(F.array_join(F.slice("kids", F.lit(1), slot), "").alias("left"),
                    F.array_join(F.slice("kids", slot + 2, F.lit(FAN)), "").alias("right"))


def _paths(nodes: DataFrame, levels: list[DataFrame], seeds: DataFrame) -> DataFrame:
    """sides at every level above a node, for the parents of the lowest runs and for groups of one
    node: (g, idx, path, root).  ``seeds`` has each group's path and root above its own root node."""
    tops = _tops(nodes, levels)
    above = None
    for k in range(len(levels), 0, -1):
        seeded = tops[k].join(seeds, "g").select("g", "idx", "path", "root")
        here = seeded if above is None else above.unionByName(seeded)
        if k == 1:
            return here
        runs = levels[k - 1].select("g", "idx", "kids").join(here, ["g", "idx"])
        kid = runs.select("g", "idx", "path", "root", "kids", F.posexplode("kids").alias("slot", "_"))
        above = kid.select("g", (F.col("idx") * FAN + F.col("slot")).alias("idx"),
                           F.concat(F.array(_sides(F.col("slot"))), F.col("path")).alias("path"), "root")
    return None


def _proved(nodes: DataFrame, levels: list[DataFrame], seeds: DataFrame) -> DataFrame:
    """``nodes`` plus path (from the node's own run up) and root."""
    lone = nodes.where("n = 1").join(seeds, "g")
    if not levels:
        return lone
    parents = levels[0].select("g", "idx", "kids").join(_paths(nodes, levels, seeds), ["g", "idx"])
    parents = parents.withColumnRenamed("idx", "parent")
    many = nodes.where("n > 1").withColumn("parent", F.expr(f"idx div {FAN}")).join(parents, ["g", "parent"])
    slot = (F.col("idx") % FAN).cast("int")
    many = many.withColumn("path", F.concat(F.array(_sides(slot)), F.col("path"))).drop("kids", "parent")
    return many.unionByName(lone.select(*many.columns))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path give."""
    return F.aggregate(path, leaf, lambda acc, x: F.sha2(F.concat(x["left"], acc, x["right"]), 256))


def manifest(leaves: DataFrame, carried: list[str] | None = None) -> DataFrame:
    """key, leaf, group (as given), columns named in ``carried``, subroot, path, root of every row of
    ``leaves``, a table of (key, group, leaf, carried ...)."""
    carried = carried or []
    rows = leaves.select("key", "group", "leaf", *carried, _group_key(F.col("group")).alias("g"))
    nodes = ranked(rows, "g", ["key", "leaf"], "manifest-leaves").withColumnRenamed("leaf", "h")
    nodes = materialise(nodes.withColumn("slot", (F.col("idx") % FAN).cast("int")), "manifest-nodes").drop("slot")
    largest = nodes.agg(F.max("n")).first()[0] or 0
    levels = _levels(nodes, largest, "manifest")
    roots = functools.reduce(DataFrame.unionByName, _tops(nodes, levels))
    roots = materialise(roots.select("g", F.col("h").alias("subroot"), F.lit("").alias("all")), "manifest-roots")
    upper = ranked(roots, "all", ["g"], "manifest-groups").select(F.col("all").alias("g"), "idx", "n", F.col("subroot").alias("h"),
                                                                  F.col("g").alias("of"))
    upper = materialise(upper, "manifest-upper")
    top_levels = _levels(upper, upper.agg(F.max("n")).first()[0] or 0, "manifest-top")
    root = functools.reduce(DataFrame.unionByName, _tops(upper, top_levels)).select("g", F.col("h").alias("root"))
    empty = F.array().cast("array<struct<left:string,right:string>>")
    seeds = materialise(_proved(upper, top_levels, root.withColumn("path", empty)).select(
        F.col("of").alias("g"), F.col("h").alias("subroot"), "path", "root"), "manifest-seeds")
    proved = _proved(nodes, levels, seeds.select("g", "path", "root"))
    return proved.join(seeds.select("g", "subroot"), "g").select(
        "key", "group", F.col("h").alias("leaf"), *carried, "subroot", "path", "root")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    parts = {c: field(F.col(c)) for c in FIELDS}
    key = F.col("doc_id").cast("long")
    hit = F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 0, F.lit(False))
    shown = digest(*(parts | {"text": field(ascii_lower(F.col("text")))}).values())
    leaves = docs.select(key.alias("key"), F.col("lang").cast("string").alias("group"), digest(*parts.values()).alias("leaf"),
                         F.when(hit, shown).alias("tampered"))
    out = manifest(materialise(leaves, "manifest-rows"), ["tampered"])
    sides = F.flatten(F.transform("path", lambda x: F.array(x["left"], x["right"])))
    out = out.withColumn("folded_root", fold(F.coalesce("tampered", "leaf"), F.col("path")))
    return out.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", F.sha2(F.array_join(sides, ""), 256).alias("proof_sha256"),
                      "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


# ---------------------------------------------------------------- DuckDB
def _sql_field(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE CAST(octet_length(encode(CAST({c} AS VARCHAR))) AS VARCHAR) || ':' || CAST({c} AS VARCHAR) END"


def _sql_leaf(text: str) -> str:
    return "sha256(" + " || ".join(_sql_field(text if c == "text" else c) for c in FIELDS) + ")"


def _sql_tree(name: str, source: str, levels: int) -> str:
    """CTEs ``name``0 .. ``name``<levels>: (id, g, idx, h, cur, fold, n, proof) one row a starting
    node, ``cur`` its ancestor's hash at that level."""
    out = [f"{name}0 AS ({source})"]
    for k in range(levels):
        out.append(f"""{name}{k}n AS (SELECT DISTINCT g, n, idx, cur FROM {name}{k}),
{name}{k}r AS (SELECT g, idx // {FAN} AS p, string_agg(cur, '' ORDER BY idx) AS run FROM {name}{k}n GROUP BY 1, 2),
{name}{k + 1} AS (SELECT id, g, idx // {FAN} AS idx, (n + {FAN - 1}) // {FAN} AS n, h,
  CASE WHEN n > 1 THEN sha256(run) ELSE cur END AS cur,
  CASE WHEN n > 1 THEN sha256(run[:64 * (idx % {FAN})] || fold || run[64 * (idx % {FAN}) + 65:]) ELSE fold END AS fold,
  CASE WHEN n > 1 THEN proof || run[:64 * (idx % {FAN})] || run[64 * (idx % {FAN}) + 65:] ELSE proof END AS proof
  FROM {name}{k} JOIN {name}{k}r USING (g) WHERE p = idx // {FAN})""")
    return ",\n".join(out)


def _sql_climb(levels: int) -> str:
    """CTEs c1 ..: the leaves' folds and proofs go on through the upper tree."""
    sides = [f"run[:64 * (b.idx % {FAN})]", f"run[64 * (b.idx % {FAN}) + 65:]"]
    return ",\n".join(f"""c{k + 1} AS (SELECT c.g, c.h, subroot, CASE WHEN n > 1 THEN sha256({sides[0]} || c.fold || {sides[1]}) ELSE c.fold END AS fold,
  CASE WHEN n > 1 THEN c.proof || {sides[0]} || {sides[1]} ELSE c.proof END AS proof
  FROM c{k} c JOIN b{k} b ON b.id = c.g JOIN b{k}r r ON r.p = b.idx // {FAN})""" for k in range(levels))


_CRC_STEP = "xor(xor(c, e) >> 1, CASE WHEN xor(c, e) & 1 = 1 THEN 3988292384 ELSE 0 END)"
_CRC = f"""xor(list_reduce(list_concat([4294967295::BIGINT], flatten([[ord(ch)::BIGINT, 0, 0, 0, 0, 0, 0, 0]
  for ch in string_split(CAST(doc_id AS VARCHAR), '')])), lambda c, e: {_CRC_STEP}), 4294967295)"""
_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE_SQL = f"""WITH leaf AS (
  SELECT doc_id, CASE WHEN lang IS NULL THEN '-' ELSE '=' || lang END AS g, {_sql_leaf('text')} AS h,
    CASE WHEN {_CRC} % 3 = 0 THEN {_sql_leaf(_LOW)} END AS bad FROM documents),
{_sql_tree('a', '''SELECT row_number() OVER () AS id, g, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS idx,
    count(*) OVER (PARTITION BY g) AS n, struct_pack(doc_id := doc_id, leaf := h) AS h, h AS cur, coalesce(bad, h) AS fold, '' AS proof FROM leaf''', 8)},
tops AS (SELECT DISTINCT g, cur FROM a8),
{_sql_tree('b', '''SELECT g AS id, 'all' AS g, row_number() OVER (ORDER BY g) - 1 AS idx, count(*) OVER () AS n, cur AS h, cur,
    cur AS fold, '' AS proof FROM tops''', 4)},
c0 AS (SELECT g, h, cur AS subroot, fold, proof FROM a8),
{_sql_climb(4)}
SELECT h.doc_id AS doc_id, h.leaf AS leaf, subroot, root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = root AS verified
FROM c4, (SELECT DISTINCT cur AS root FROM b4)"""
