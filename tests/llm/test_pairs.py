"""Jaccard join and substring dedup against brute force, on every awkward row."""
import hashlib
import random
from itertools import combinations

import duckdb
import numpy as np
import pytest
import zstandard

from cyclewise.llm import op1_jaccard_join as J, op6_substring_dedup as S
from cyclewise.llm.components import components
from tests.llm.cases import SCHEMA, documents, edited, frame, prose


def shingles(text, n):
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[k:k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)])


def brute_components(rows, n, percent):
    sets = {i: shingles(t, n) for i, t, *_ in rows}
    root = {i: i for i in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a
    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {(i, len(s), find(i)) for i, s in sets.items()}


def brute_cut(rows):
    first, words = {}, {}
    for i, t, *_ in rows:
        words[i] = w = (t or "").encode().split()
        for k in range(len(w) - 12):
            g = tuple(w[k:k + 13])
            first[g] = min(first.get(g, i), i)
    out = set()
    for i, w in words.items():
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if first[tuple(w[k:k + 13])] < i:
                gone[k:k + 13] = [True] * 13
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.add((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def cut_rows(df):
    return {(r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in df.collect()}


@pytest.mark.parametrize("n,percent", [(4, 85), (5, 80)])
def test_components_match_brute_force(spark, n, percent):
    rows = documents(seed=n)
    got = J.jaccard_join(frame(spark, rows, extra=True), n, percent)[0]
    assert {tuple(r) for r in got.collect()} == brute_components(rows, n, percent)


def test_links_off_the_pivot_are_found(spark):
    """A chain of edits: most links are not with the region's pivot document."""
    rng = random.Random(3)
    texts, t = [], prose(rng, 300)
    for _ in range(24):
        texts.append(t)
        t = edited(rng, t, 0.008)
    rng.shuffle(texts)
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)]
    got = {tuple(r) for r in J.jaccard_join(frame(spark, rows), 4, 85)[0].collect()}
    assert got == brute_components(rows, 4, 85)


def brute_links(rows, n, percent):
    """Links between different sets, each by its smallest id."""
    first = {}
    for i, t, *_ in rows:
        s = shingles(t, n)
        if s:
            first[s] = min(first.get(s, i), i)
    return {(min(first[x], first[y]), max(first[x], first[y])) for x, y in combinations(first, 2)
            if 100 * len(x & y) >= percent * len(x | y)}, first


@pytest.mark.parametrize("block", [2, 5, 128])
def test_no_link_is_missed(spark, monkeypatch, block):
    """Also those between two documents that both link with a third, and across blocks."""
    monkeypatch.setattr(J, "BLOCK", block)
    rng = random.Random(7)
    base = prose(rng, 300)
    rows = documents(seed=6) + [(5000 + i, edited(rng, base, 0.004), None, None, None) for i in range(12)]
    want, first = brute_links(rows, 4, 85)
    assert {(b, c) for a, b in want for x, c in want if a == x and b < c} & want
    got = J.jaccard_join(frame(spark, rows, extra=True), 4, 85)[1].collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    counts = {r.doc_id: r.n_links for r in J.linked_documents(frame(spark, rows + rows[:9]), 4, 85).collect()}
    number = {x: sum(x in p for p in want) for x in first.values()}
    assert counts == {i: number.get(first.get(shingles(t, 4)), 0) for i, t, *_ in rows}


def test_link_counts_stand_in_the_query(spark, tmp_path):
    frame(spark, documents(seed=6)).write.parquet(f"file://{tmp_path}/documents.parquet")
    assert J.query(spark, f"file://{tmp_path}").columns == ["doc_id", "n_shingles", "component_id", "n_links"]
    assert J.linked_documents(frame(spark, [])).count() == 0


def test_repeated_rows_and_first_of_group(spark):
    rows = documents(seed=9, n=10)
    twice = rows + rows[::2] + [(None, "no id", None, None, None)]
    want = brute_components(rows, 5, 80)
    out = J.keep_first(frame(spark, twice, extra=True), 5, 80)
    kept = [r.doc_id for r in out.collect()]
    assert sorted(x for x in kept if x is not None) == sorted(i for i, _, c in want if i == c)
    assert None in kept and out.columns == frame(spark, twice, extra=True).columns


def test_empty_tables(spark):
    empty = frame(spark, [])
    assert J.jaccard_join(empty)[0].count() == 0
    assert S.dedup_documents(empty).count() == 0
    assert J.jaccard_join(frame(spark, [(1, None, None, None, None)]))[0].collect()[0][:] == (1, 0, 1)


def test_components(spark):
    rng = random.Random(2)
    edges = [(a, a + 1) for a in range(30)] + [(100, 100 + k) for k in range(1, 40)] + [
        tuple(rng.sample(range(200, 260), 2)) for _ in range(40)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == root


def test_cuts_match_brute_force(spark):
    for seed in (1, 2):
        rows = documents(seed=seed)
        assert cut_rows(S.dedup_documents(frame(spark, rows, extra=True))) == brute_cut(rows)


def test_cuts_across_chunks_and_repeated_rows(spark, monkeypatch):
    rows = documents(seed=5)
    df = frame(spark, rows + rows[:7]).repartition(7)
    assert cut_rows(S.dedup_documents(df)) == brute_cut(rows)
    assert S.dedup_documents(df).count() == len(rows) + 7
    kept = S.clean(frame(spark, rows, extra=True))
    want = {i for i, n, gone, _ in brute_cut(rows) if n == 0 or gone < n}
    assert {r.doc_id for r in kept.collect()} == want


def test_hot_minimisers_change_nothing(spark, monkeypatch):
    """With a low limit many windows go by their own hash; the result is the same."""
    rows = documents(seed=4)
    monkeypatch.setattr(S, "HOT", 3)
    assert len(S.hot_minimisers(frame(spark, [r for r in rows if r[1] is not None]))[0])
    assert cut_rows(S.dedup_documents(frame(spark, rows))) == brute_cut(rows)


def test_chunks_settle_their_own_copies():
    """Of equal super-k-mers a chunk sends those of the smallest document, the rest as removed."""
    rng = random.Random(1)
    text = prose(rng, 50)
    chunk = S._Chunk(4, np.zeros(0, np.uint64), 0)
    for i in (7, 3, 5):
        chunk.add(i, text)
    sent, gone = [], set()
    for bucket, payload in chunk.rows():
        if bucket >= 0:
            sent += S._unpacked(payload)[1].tolist()
        else:
            gone |= set(np.frombuffer(zstandard.ZstdDecompressor().decompress(payload), "<i8").reshape(3, -1)[0].tolist())
    assert set(sent) == {3} and gone == {5, 7}


def test_schema_is_stable(spark):
    assert J.jaccard_join(spark.createDataFrame([], SCHEMA))[0].columns == ["doc_id", "n_shingles", "component_id"]


def by_row_cut(rows):
    """The contract row by row: a word goes if a window over it starts in a row of a smaller id."""
    least = {}
    for i, t, *_ in rows:
        w = (t or "").encode().split()
        for k in range(len(w) - 12):
            if i is not None:
                g = tuple(w[k:k + 13])
                least[g] = min(least.get(g, i), i)
    out = []
    for i, t, *_ in rows:
        w = (t or "").encode().split()
        gone = {k + j for k in range(len(w) - 12) if i is not None and least[tuple(w[k:k + 13])] < i for j in range(13)}
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    return sorted(out, key=str)


def test_substring_query_with_repeated_ids(spark, tmp_path):
    """Rows under one id lose each its own windows, none to the other; null ids take no part."""
    rng = random.Random(31)
    p, a, b = prose(rng, 40), prose(rng, 40), prose(rng, 40)
    rows = [(1, p), (2, a), (2, p + " tail"), (2, a), (3, a + " " + b), (5, b), (5, b + " more " + p), (None, p), (None, None), (7, None), (8, ""), (-4, b)]
    rows = [(i, t, None, "s", None) for i, t in rows] + documents(3)
    frame(spark, rows, extra=True).coalesce(1).write.parquet(f"file://{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in S.query(spark, f"file://{tmp_path}").select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=str)
    assert got == by_row_cut(rows)
    with_id = [r for r in rows if r[0] is not None]
    frame(spark, with_id).coalesce(1).write.parquet(f"file://{tmp_path}/ids/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/ids/documents.parquet/*.parquet')")
    assert sorted((tuple(r) for r in con.execute(S.ORACLE_SQL).fetchall()), key=str) == by_row_cut(with_id)


def test_what_is_kept_stays_laid_out(spark):
    rng = random.Random(8)
    p = prose(rng, 30).replace(" ", "\n")
    rows = [(1, p), (2, f"First  line\n\tsecond\n{p} last\n\nline  "), (3, f"{p}\nother\n\n end  "), (4, f" Begin  here\n then \n {p}")]
    got = {r.doc_id: r.text for r in S.clean(frame(spark, [(i, t, None, "s", None) for i, t in rows])).collect()}
    assert got == {1: p, 2: "First  line\n\tsecond\nlast\n\nline  ", 3: "other\n\n end  ", 4: " Begin  here\n then \n "}
