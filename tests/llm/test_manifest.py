"""The manifest against a tree built node by node, on every awkward row."""
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from cyclewise.llm import op13_manifest as M
from tests.llm.cases import documents, frame, prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def brute_leaf(i, t, lang, source, n):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, t)))


def brute_tree(nodes):
    """Root, and for each node the (left, right) siblings of every level."""
    paths, groups = [[] for _ in nodes], [[k] for k in range(len(nodes))]
    while len(nodes) > 1:
        runs = [nodes[k:k + 8] for k in range(0, len(nodes), 8)]
        above = []
        for r, run in enumerate(runs):
            for s in range(len(run)):
                for leaf in groups[8 * r + s]:
                    paths[leaf].append(("".join(run[:s]), "".join(run[s + 1:])))
            above.append([x for g in groups[8 * r:8 * r + 8] for x in g])
        nodes, groups = [sha("".join(run)) for run in runs], above
    return nodes[0], paths


def brute(rows):
    out, by = [], {}
    for r in rows:
        by.setdefault(r[2], []).append((r[0] is not None, r[0], brute_leaf(*r), r))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        by[lang].sort(key=lambda x: x[:3])
        trees[lang] = brute_tree([x[2] for x in by[lang]])
    root, above = brute_tree([trees[x][0] for x in langs]) if langs else (None, [])
    for lang, up in zip(langs, above):
        sub, paths = trees[lang]
        for (_, _, leaf, r), path in zip(by[lang], paths):
            path = path + up
            cur = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                cur = brute_leaf(r[0], r[1] if r[1] is None else r[1].translate(LOWER), *r[2:])
            for a, b in path:
                cur = sha(a + cur + b)
            out.append((r[0], leaf, sub, root, sha("".join(a + b for a, b in path)), cur, cur == root))
    return sorted(map(str, out))


def many_rows():
    rng = random.Random(2)
    rows = [(k, prose(rng, 12), "hot", "s", k) for k in range(0, 1300, 2)]
    rows += documents(4) + documents(4)[:9] + documents(4)[:2]          # repeated rows
    rows += [(5, "Other text", "hot", "s", 1), (5, None, "hot", None, None), (None, "No Id", "hot", "s", 3), (None, None, None, None, None)]
    return rows + [(7_000 + k, f"Lone {k}", f"lang{k}é", "s", k) for k in range(20)] + [(1, "E", "", "s", 1)]


@pytest.mark.parametrize("rows", [many_rows(), many_rows()[:1], many_rows()[:8], many_rows()[:9], []], ids=["many", "one", "run", "nine", "none"])
def test_query_matches_brute_force(spark, tmp_path, rows):
    frame(spark, rows, extra=True).write.parquet(f"file://{tmp_path}/documents.parquet")
    got = M.query(spark, f"file://{tmp_path}")
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    got = sorted(str(tuple(r)) for r in got.collect())
    assert got == brute(rows)
    if len(rows) > 9:
        assert any("True" in r for r in got) and any("False" in r for r in got)


def test_a_change_anywhere_changes_the_root(spark):
    """General form: own key, own leaf; one changed leaf gives another root and fails its proof only."""
    df = spark.range(300).select(F.col("id").alias("key"), (F.col("id") % 3).cast("string").alias("group"),
                                 F.sha2(F.col("id").cast("string"), 256).alias("leaf"))
    from cyclewise.llm.common import materialise
    one = M.manifest(materialise(df, "t")).collect()
    two = M.manifest(materialise(df.withColumn("leaf", F.when(F.col("key") == 77, F.sha2(F.lit("x"), 256)).otherwise(F.col("leaf"))), "t"))
    assert len({r.root for r in one}) == 1 and len({r.subroot for r in one}) == 3
    by = {r.key: r for r in two.collect()}
    assert one[0].root != by[0].root
    assert sum(r.subroot != by[r.key].subroot for r in one) == 100 == sum(r.key % 3 == 77 % 3 for r in one)
