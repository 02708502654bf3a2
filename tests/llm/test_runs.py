"""Periodic runs against brute force: every sequence, and the query on every awkward row."""
import hashlib
import random
import zlib

import numpy as np
from hypothesis import given, settings, strategies as st

from cyclewise.llm import op11_runs as R
from cyclewise.llm.lyndon import lyndon_lengths, runs
from tests.llm.cases import documents, frame, prose


def brute_runs(x, least):
    """Every period, every stretch that keeps it and cannot be extended, no smaller period."""
    out = []
    for p in range(1, len(x) // 2 + 1):
        s = 0
        while s + p < len(x):
            e = s
            while e + p < len(x) and x[e] == x[e + p]:
                e += 1
            n = e - s + p
            if n >= max(2 * p, least) and all(any(x[k] != x[k + q] for k in range(s, s + n - q)) for q in range(1, p)):
                out.append((s, n, p))
            s = max(s, e) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_words(i, t):
    w = (t or "").encode().split()
    h = zlib.crc32(str(i).encode()) if i is not None else 1
    if h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
    return w


def brute_row(i, t):
    w = brute_words(i, t)
    found = brute_runs(w, 12)
    gone = {k for s, n, p in found for k in range(s + p, s + n)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (i, len(found), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4),
            sha("".join(f"{s},{n},{p}\n" for s, n, p in found).encode()),
            sha(b" ".join(x for k, x in enumerate(w) if k not in gone)))


@st.composite
def sequences(draw):
    """Short periods, a few changed places, repeated blocks."""
    size = draw(st.integers(1, 4))
    unit = draw(st.lists(st.integers(0, size - 1), min_size=1, max_size=9))
    x = (unit * 30)[:draw(st.integers(1, 60))] + draw(st.lists(st.integers(0, size - 1), max_size=20))
    for k in draw(st.lists(st.integers(0, len(x) - 1), max_size=3)):
        x[k] = draw(st.integers(0, size - 1))
    return x


@settings(max_examples=400, deadline=None)
@given(sequences(), st.sampled_from([2, 12]))
def test_runs_are_those_of_brute_force(x, least):
    values = sorted(set(x))
    y = np.array([values.index(v) for v in x])
    assert [tuple(r) for r in runs(y, least).tolist()] == brute_runs(x, least)


@settings(max_examples=200, deadline=None)
@given(sequences())
def test_lyndon_lengths(x):
    values = sorted(set(x))
    y = [values.index(v) for v in x]
    want = []
    for i in range(len(y)):
        j = i + 1
        while j < len(y) and y[i:] < y[j:]:
            j += 1
        want.append(j - i)
    assert lyndon_lengths(y, len(values)) == want


def rich_rows():
    rng = random.Random(5)
    rows = documents(seed=3)
    rows += [(50_000 + k, " ".join((prose(rng, 3 + k % 17).split() * 9)[:11 + 3 * k]) + " " + prose(rng, 30), None, "s", None)
             for k in range(30)]
    rows += [(60_000, prose(rng, 40) + " x y" * 400 + " z" * 90, None, "s", None), (None, "one two " * 20, None, None, None)]
    return [r if r[1] is None or len(r[1].split()) < 1500 else (r[0], " ".join(r[1].split()[:1500]), *r[2:]) for r in rows]


def test_query_matches_brute_force(spark, tmp_path):
    rows = rich_rows() + rich_rows()[:4]
    frame(spark, rows, extra=True).write.parquet(f"file://{tmp_path}/documents.parquet")
    got = R.query(spark, f"file://{tmp_path}")
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    want = [brute_row(r[0], r[1]) for r in rows]
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))
    assert sum(w[1] > 0 for w in want) > 30 and any(w[1] > 1 for w in want)


def test_long_text_has_its_run(spark):
    """A run over 200,000 words, and a text that is one run of a long period."""
    rng = random.Random(9)
    unit = [f"w{rng.randrange(3000)}" for _ in range(700)]
    text = " ".join([f"v{k}" for k in range(50_000)] + unit * 286)
    got = R.word_runs(text.encode().split()).tolist()
    assert [50_000, 286 * 700, 700] in got
    assert R.word_runs(b"a " .join([b""] * 100_001).split()).tolist() == [[0, 100_000, 1]]


def test_general_forms_and_edges(spark):
    rows = rich_rows()
    found = {r.doc_id: [tuple(x) for x in r.runs] for r in R.find_runs(frame(spark, rows, extra=True)).collect()}
    assert found == {i: brute_runs((t or "").encode().split(), 12) for i, t, *_ in rows}
    df = frame(spark, rows, extra=True)
    cut = R.collapse(df)
    assert cut.columns == df.columns
    for r in cut.collect():
        old = next(t for i, t, *_ in rows if i == r.doc_id)
        if not found[r.doc_id]:
            assert r.text == old
        else:
            gone = {k for s, n, p in found[r.doc_id] for k in range(s + p, s + n)}
            assert r.text == " ".join(x for k, x in enumerate(old.encode().decode().split()) if k not in gone) or "\xa0" in old
    assert R.find_runs(frame(spark, [])).count() == 0
