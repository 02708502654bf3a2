"""Quality rules, mixing, sharding: against brute force, on every awkward row."""
import math
import random
import zlib
from collections import Counter

import duckdb
import pytest
import xxhash

from cyclewise.llm import op2_quality_rules as Q, op4_mixing as M, op9_sharding as H
from tests.llm.cases import documents, frame, prose


def words(t):
    return [w for w in (t or "").encode().split()]


def brute_base(t):
    w = words(t)
    windows = Counter(tuple(w[k:k + 8]) for k in range(len(w) - 7))
    hit = {k + j for k in range(len(w) - 7) if windows[tuple(w[k:k + 8])] > 1 for j in range(8)}
    lines = [x for x in (t or "").split("\n") if words(x)]
    failed = len(w) < 20 or 100 * len(hit) > 30 * len(w)
    return (len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)),
            len(hit), failed)


def brute_rules(rows, share, least):
    norm = lambda x: b" ".join(words(x)).lower()
    texts, held = {}, {}
    for _, t, _, s, _ in rows:
        texts.setdefault(s, set()).add(t or "")
        for x in (t or "").split("\n"):
            if words(x):
                held.setdefault((s, norm(x)), set()).add(t)
    often = {k for k, v in held.items() if len(v) > least and 100 * len(v) > share * len(texts[k[0]])}
    out = {}
    for i, t, _, s, _ in rows:
        base = brute_base(t)
        gone = sum(len(words(x)) for x in (t or "").split("\n") if (s, norm(x)) in often)
        depleted = 100 * (base[0] - gone) < 30 * base[0]
        out[i] = (*base, gone, depleted, not base[5] and not depleted)
    return out, often


def with_lines(seed):
    rng = random.Random(seed)
    rows = []
    for i, t, lang, s, n in documents(seed):
        if t is not None and i % 2:
            t = f"{t}\nALL rights  reserved by the house\n" + ("Share this page now with friends and all\n" * (12 if i % 5 == 0 else 1))
        rows.append((i, t, lang, s, n))
    rows += [(10_000 + k, f"All Rights reserved by the house {k}\nall rights\treserved by the house\n" + prose(rng, 30),
              None, "hot", None) for k in range(5)]
    return rows


def test_rules_match_brute_force(spark):
    rows = with_lines(2)
    want, often = brute_rules(rows, 10, 3)
    assert often
    df = frame(spark, rows + rows[:5], extra=True)
    got = Q.judge(df, 10, 3).collect()
    assert len(got) == len(rows) + 5
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed,
                       r.n_line_words_removed, r.depleted, r.kept) for r in got} == want
    assert any(w[6] for w in want.values()) and any(w[7] and w[0] for w in want.values())
    clean = Q.clean(frame(spark, rows, extra=True), 10, 3)
    assert clean.columns == df.columns
    by = {r.doc_id: r.text for r in clean.collect()}
    assert set(by) == {i for i, w in want.items() if w[-1]}
    for i, t in by.items():
        assert len(words(t)) == want[i][0] - want[i][6]
    assert Q.judge(frame(spark, [])).count() == 0 and Q.clean(frame(spark, [])).count() == 0


def test_rules_match_the_oracle(spark, tmp_path):
    frame(spark, documents(4)).coalesce(1).write.parquet(f"file://{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    cur = con.execute(Q.ORACLE_SQL)
    names = [d[0] for d in cur.description]
    got = Q.query(spark, f"file://{tmp_path}").select(*names).collect()
    assert sorted(tuple(r) for r in got) == sorted(cur.fetchall())


def test_the_limit_holds_on_small_and_large_hosts(spark):
    """A line in a tenth of the documents goes from a host of 60 and from one of 2,000; one in up to 5 stays."""
    rng = random.Random(7)
    rows = [(1000 * h + i, prose(rng, 25) + ("\nthe same line everywhere" if i % 10 == 0 else "") + ("\nrare line" if i < 5 else ""), None, f"h{h}", None)
            for h, n in ((1, 60), (5, 2000)) for i in range(n)]
    rows += [(90_000 + i, prose(rng, 25) + "\nin all of a tiny host", None, "tiny", None) for i in range(6)]
    rows += [(91_000 + i, prose(rng, 25) + "\nin all of a tinier host", None, "tinier", None) for i in range(5)]
    got = {r.doc_id: r.n_line_words_removed for r in Q.judge(frame(spark, rows)).collect()}
    assert all(n == (4 if "same line" in t else 6 if "tiny host" in t else 0) for (i, t, *_), n in ((r, got[r[0]]) for r in rows))


def test_copies_do_not_make_boilerplate(spark):
    """A line that only copies of one text share is not removed."""
    rng = random.Random(1)
    text = prose(rng, 100)
    rows = [(i, text, None, "s", None) for i in range(40)] + [(100 + i, prose(rng, 60), None, "s", None) for i in range(20)]
    assert all(r.kept for r in Q.judge(frame(spark, rows), 10, 3).collect())


def sources(rows):
    out = Counter()
    for _, t, _, s, _ in rows:
        out[s] += len(words(t))
    return out


def spark_hash(*values):
    """Spark's xxhash64 of (number, bytes) pairs, unsigned."""
    seed = 42
    for v, size in values:
        seed = xxhash.xxh64(v.to_bytes(size, "little", signed=True), seed=seed).intdigest()
    return seed


def brute_mix(rows, target):
    """(doc_id, pass, block) to (weight, order), by closed forms and one sorted walk a source."""
    tokens = sources(rows)
    live = [t for t in tokens.values() if t]
    most, least, total = max(live), min(live), sum(live)

    def flat_enough(a):
        z = sum((t / total) ** a for t in live)
        if target.entropy is not None:
            return -sum((t / total) ** a / z * math.log((t / total) ** a / z) for t in live) < target.entropy
        return (most / least) ** (1 - a) <= target.max_repeat

    lo, hi = 0.0, 1.0
    for _ in range(4 * M.STEPS):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if flat_enough(mid) else (mid, hi)
    z, out = sum(t ** hi for t in live), {}
    for s, t in tokens.items():
        reads = (most / t) ** (1 - hi) if t else 1.0
        reads = round(reads) if abs(reads - round(reads)) < 1e-9 else reads
        whole, weight = int(reads), t ** hi / z if t else 0.0
        left, mine = int((reads - whole) * t), [(r[0], len(words(r[1]))) for r in rows if r[3] == s]
        takes = {i: whole for i, _ in mine}
        walk = sorted(mine, key=lambda x: spark_hash((M.SEED, 4), (whole, 8), (x[0], 8))) if left else []
        for i, n in walk:
            left -= n
            if left < 0:
                break
            takes[i] += 1
        for i, passes in takes.items():
            for k in range(passes):
                h = spark_hash((M.SEED, 4), (k, 8), (i, 8))
                out[i, k, h >> 54] = (weight, (k + (h >> 11) / 2**53) / reads)
    return out


@pytest.mark.parametrize("target", [M.Target(max_repeat=1.5), M.Target(max_repeat=3.7), M.Target(entropy=1.5), M.Target(max_repeat=1.0)])
def test_mixing_matches_brute_force(spark, target):
    rows = documents(12, n=150) + [(10_000 + i, t, None, "no words", None) for i, t in enumerate([None, "", " \n"])]
    want = brute_mix(rows, target)
    got = M.mix(frame(spark, rows, extra=True), ["doc_id"], target).collect()
    assert len(got) == len(want)
    for r in got:
        weight, order = want[r.doc_id, r.mix_pass, r.mix_block]
        assert abs(r.mix_weight - weight) < 1e-9 and abs(r.mix_order - order) < 1e-9


def brute_shards(rows, shards):
    """doc_id to (shard, slot): one sort by fractional rank, cut into equal parts."""
    order = []
    for s in {r[3] for r in rows}:
        mine = sorted((spark_hash((H.SEED, 4), (r[0], 8)), r[0]) for r in rows if r[3] == s)
        order += [((2 * k + 1) / (2 * len(mine)), (s or "").encode(), s is None, h - (h >> 63 << 64), i) for k, (h, i) in enumerate(mine)]
    cuts = [-(-k * len(order) // shards) for k in range(shards + 1)]
    place = {x[-1]: k for k, x in enumerate(sorted(order))}
    return {i: next((k, p - cuts[k]) for k in range(shards) if cuts[k] <= p < cuts[k + 1]) for i, p in place.items()}


@pytest.mark.parametrize("n,shards,rows_each", [(200, 16, H.BUCKET_ROWS), (3, 16, H.BUCKET_ROWS), (90, 7, H.BUCKET_ROWS), (200, 16, 0.01)])
def test_shards_match_brute_force(spark, monkeypatch, n, shards, rows_each):
    from pyspark.sql import functions as F
    monkeypatch.setattr(H, "_bits", lambda n: max(H.MIN_BITS, int(n // rows_each).bit_length()))
    rows = documents(6, n=200)[:n]
    got = H.shard(frame(spark, rows, extra=True), F.col("source"), ["doc_id"], shards).collect()
    assert {r.doc_id: (r.shard, r.slot) for r in got} == brute_shards(rows, shards) and len(got) == len(rows)


def test_mixing_meets_its_weights(spark):
    rows = documents(8, n=150)
    tokens = sources(rows)
    target = M.Target(max_repeat=1.5)
    got = M.mix(frame(spark, rows, extra=True), ["doc_id"], target).collect()
    read, weight, times = Counter(), {}, Counter()
    for r in got:
        read[r.source] += r.mix_tokens
        weight[r.source] = r.mix_weight
        times[r.doc_id] += 1
    assert set(times) == {r[0] for r in rows}  # every document at least once
    assert abs(sum(weight.values()) - 1) < 1e-6
    longest = max(len(words(r[1])) for r in rows)
    budget = max(t / weight[s] for s, t in tokens.items())
    for s, t in tokens.items():
        assert budget * weight[s] - longest <= read[s] <= budget * weight[s] + 1
        assert budget * weight[s] / t <= 1.5 + 1e-6
    # as flat as the limit allows
    assert max(budget * weight[s] / t for s, t in tokens.items()) > 1.499
    for s in tokens:
        n = [times[r[0]] for r in rows if r[3] == s]
        assert max(n) - min(n) <= 1


def test_mixing_meets_an_entropy(spark):
    rows = documents(8, n=150)
    tokens = sources(rows)
    p = [t / sum(tokens.values()) for t in tokens.values()]
    found = -sum(x * math.log(x) for x in p)
    want = (found + math.log(len(p))) / 2
    got = M.mix(frame(spark, rows), ["doc_id"], M.Target(entropy=want)).collect()
    w = {r.source: r.mix_weight for r in got}
    assert abs(-sum(x * math.log(x) for x in w.values()) - want) < 1e-4


def test_mixing_edge_cases(spark):
    assert M.mix(frame(spark, []), ["doc_id"]).count() == 0
    assert M.mix(frame(spark, [(1, None, None, None, None), (2, "", None, "a", None)]), ["doc_id"]).count() == 2
    one = [(i, "a b c", None, "s", None) for i in range(9)]
    assert M.mix(frame(spark, one + one), ["doc_id"]).count() == 18
    half = M.mix(frame(spark, one), ["doc_id"], budget=14).collect()
    assert sum(r.mix_tokens for r in half) == 12  # whole documents within 14 tokens


def test_buckets_follow_the_rows():
    assert [H._bits(n) for n in (0, 10**6, 10**9, 2**30 - 1, 2**30, 5 * 10**10)] == [10, 10, 10, 10, 11, 16]
    assert all(n / 2 ** H._bits(n) <= H.BUCKET_ROWS for n in (10**9, 10**11, 10**13))


def test_shards_with_null_keys(spark):
    rows = [(None if i % 4 == 0 else i, f"text {i}", None, "s" if i % 2 else None, None) for i in range(40)]
    from pyspark.sql import functions as F
    got = H.shard(frame(spark, rows + rows[:4]), F.col("source"), ["doc_id"], 16).collect()
    assert Counter(r.text for r in got) == Counter(r[1] for r in rows + rows[:4])
    assert len({(r.shard, r.slot) for r in got}) == 44 and {r.shard for r in got} == set(range(16))


def test_shards(spark):
    rows = documents(3, n=200)
    table = frame(spark, rows + rows[:9], extra=True)
    from pyspark.sql import functions as F
    data = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    df = table.withColumn("size", F.octet_length(data) + 1).withColumn("crc", F.crc32(data))
    got = H.shard(df, F.col("source"), ["doc_id", "size", "crc"], 16).collect()
    assert len(got) == len(rows) + 9
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
        if r.doc_id == rows[0][0]:
            assert r.crc == zlib.crc32((rows[0][1] or "").encode())
    sizes = [len(x) for x in by.values()]
    assert set(by) == set(range(16)) and max(sizes) - min(sizes) <= 1
    all_sources = Counter(r.source for r in got)
    for part in by.values():
        assert sorted(r.slot for r in part) == list(range(len(part)))
        mix = Counter(r.source for r in part)
        for s, n in all_sources.items():
            assert abs(mix[s] - n / 16) <= 2
    assert H.shard(df.limit(0), F.col("source"), ["doc_id"], 16).count() == 0
    few = H.shard(df.limit(3), F.col("source"), ["doc_id"], 16).collect()
    assert len(few) == 3 and all(r.slot == 0 for r in few)
