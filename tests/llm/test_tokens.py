"""Token blocks and packing: exact round trips and bounds."""
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from cyclewise.llm import op8_packing as P, op10_token_blocks as B, pfor
from cyclewise.llm.tokens import default_vocabulary, encoder
from tests.llm.cases import documents, frame, prose


@pytest.fixture(scope="module")
def ids():
    slow = encoder(default_vocabulary()).slow
    return lambda t: slow.encode(t or "", add_special_tokens=False).ids + [2]


def crc(x):
    return zlib.crc32(np.array(x, "<u4").tobytes())


def test_ids_are_those_of_the_tokenizers_library():
    e, rng = encoder(default_vocabulary()), random.Random(4)
    texts = ["", " ", "\n\n  a", "it's we'll 12345 ½ 汉字 🙂🏽 \u00a0x", "<|endoftext|>", "tab\tand\r\nline  "]
    texts += [prose(rng, 400) for _ in range(20)]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xA0, 0x2FF), rng.randrange(0x4E00, 0x4F00), 10]))
                      for _ in range(200)) for _ in range(50)]
    for t in texts:
        assert e.ids(t).tolist() == e.slow.encode(t, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=400), st.sampled_from([1, 200, 50257, 2**32 - 1]))
def test_blocks_round_trip(values, top):
    x = np.array([v % (top + 1) for v in values], np.uint32)
    doc_ids, counts, back = pfor.decode(pfor.encode(np.array([-5, 2**40]), np.array([len(x), 0]), x))
    assert back.tolist() == x.tolist() and doc_ids.tolist() == [-5, 2**40] and counts.tolist() == [len(x), 0]


def test_outliers_go_to_the_exception_list():
    x = np.full(pfor.BLOCK, 7, np.uint32)
    x[5] = 2**31
    image = pfor.encode(np.array([1]), np.array([len(x)]), x)
    assert len(image) < 120 and pfor.decode(image)[2].tolist() == x.tolist()


def test_token_files(spark, ids, tmp_path):
    rows = documents(seed=3)
    for name, segment in (("one", B.SEGMENT_IDS), ("many", 700)):
        path = f"file://{tmp_path}/{name}"
        B.write_token_files(frame(spark, rows, extra=True), path, segment_ids=segment)
        want, at = set(), 0
        for i, t, *_ in sorted(rows):
            x = ids(t)
            want.add((i, at, len(x), crc(x)))
            at += len(x)
        assert {tuple(r) for r in B.read_token_files(spark, path).collect()} == want
    B.write_token_files(frame(spark, []), f"file://{tmp_path}/none")
    assert B.read_token_files(spark, f"file://{tmp_path}/none").count() == 0


def check_layout(rows, capacity):
    """Sequences are gapless from 0 and within capacity; returns their number."""
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing(spark, ids):
    rows = documents(seed=6)
    got = P.pack_documents(frame(spark, rows + rows[:3], extra=True)).collect()
    want = []
    for i, t, *_ in rows + rows[:3]:
        x = ids(t)
        cuts = list(range(len(x) % 1024 or 1024, len(x) + 1, 1024))
        for k, (a, b) in enumerate(zip([0, *cuts], cuts)):
            want.append((i, k, a, b - a, crc(x[a:b])))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    total = sum(w[3] for w in want)
    n = check_layout(got, 1024)
    assert -(-total // 1024) <= n <= total // 1024 + 3
    assert P.pack_documents(frame(spark, [])).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), max_size=30))
def test_plan_uses_every_piece(counts):
    used = {}
    for pattern, m in P.plan(counts, 64):
        assert sum(pattern) <= 64 and m > 0
        for x in pattern:
            used[x] = used.get(x, 0) + m
    assert used == counts


def test_plan_fills_exactly():
    """Complements by one, two and three lengths; then best fit."""
    assert P.plan({60: 2, 4: 2}, 64) == [((60, 4), 2)]
    assert P.plan({50: 1, 10: 1, 4: 1}, 64) == [((50, 10, 4), 1)]
    assert P.plan({40: 1, 12: 1, 7: 1, 5: 1}, 64) == [((40, 12, 7, 5), 1)]
    assert P.plan({32: 5}, 64) == [((32, 32), 2), ((32,), 1)]
    rng = random.Random(0)
    lengths = [rng.randint(1, 900) for _ in range(5000)]
    n = sum(m for _, m in P.plan({x: lengths.count(x) for x in set(lengths)}))
    assert n <= sum(lengths) / 1024 * 1.01 + 1


def test_rows_without_an_id_come_back_without_one(spark, tmp_path, ids):
    """They come first, and the least long is an id like others."""
    rows = [(None, "b two", None, "s", None), (-2**63, "least", None, "s", None), (None, None, None, "s", None), (0, "zero", None, "s", None)]
    B.write_token_files(frame(spark, rows, extra=True), f"file://{tmp_path}/t", segment_ids=3)
    got = sorted(B.read_token_files(spark, f"file://{tmp_path}/t").collect(), key=lambda r: r.start)
    want, at = [], 0
    for i, t in ((None, None), (None, "b two"), (-2**63, "least"), (0, "zero")):
        x = ids(t)
        want.append((i, at, len(x), crc(x)))
        at += len(x)
    assert [tuple(r) for r in got] == want
