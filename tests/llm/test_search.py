"""Top-k search, URL filter, HTML rendering."""
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cyclewise.llm import op3_html as X, op5_topk as K, op7_url_filter as U
from cyclewise.llm.htmltree import render


def brute_top(rows, every, k):
    v = {i: [math.floor(64 * float(x)) for x in e] for i, e in rows}
    out = set()
    for q in v:
        if q % every == 0:
            s = sorted(((-sum(a * b for a, b in zip(v[q], v[i])), i) for i in v if i != q and len(v[i]) == len(v[q])))[:k]
            out |= {(q, n + 1, i, -x) for n, (x, i) in enumerate(s)}
    return out


@pytest.mark.parametrize("blocks", [(8192, 2048), (50, 7)])
def test_top_k(spark, monkeypatch, blocks):
    monkeypatch.setattr(K, "DATA_BLOCK", blocks[0])
    monkeypatch.setattr(K, "QUERY_BLOCK", blocks[1])
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=8) * (0.1 if i % 3 else 2)).astype(np.float32).tolist()) for i in range(400)]
    rows += [(400 + i, [0.5] * 8) for i in range(80)] + [(1000, [1.0, 2.0]), (1005, [2.0, 1.0])]
    bad = [(None, [1.0] * 8), (2001, None), (2002, [None] * 8), (2003, [float("nan")] * 8), (2000, [float("inf")] * 8), (2006, [])]
    df = spark.createDataFrame(rows + rows[:5] + bad, "vec_id long, embedding array<float>").withColumn("score", F.lit("x")).withColumn("v", F.lit(1))
    got = {tuple(r) for r in K.top_k(df, F.expr("vec_id % 20 = 0"), k=7).collect()}
    assert got == brute_top(rows, 20, 7)


def test_top_k_of_large_components_and_few_rows(spark):
    df = spark.createDataFrame([(0, [1e30, -1.0]), (1, [1e5, 1.0]), (20, [-1e30, 0.0])], "vec_id long, embedding array<double>")
    got = [tuple(r) for r in K.top_k(df, F.expr("vec_id % 20 = 0")).orderBy("query_id", "rank").collect()]
    assert [(q, r, i) for q, r, i, _ in got] == [(0, 1, 1), (0, 2, 20), (20, 1, 1), (20, 2, 0)]
    assert K.top_k(df.limit(0), F.expr("vec_id % 20 = 0")).count() == 0
    assert K.top_k(df.where("vec_id = 0"), F.expr("vec_id % 20 = 0")).count() == 0


def test_scores_are_exact_and_every_row_counts(spark):
    """Large components, their sums above doubles' whole numbers; several vectors under one id."""
    rows = [(0, [2e7, 1.0]), (1, [1.0, 0.0]), (1, [3.0, 0.0]), (2, [2e7 + 1, 0.0]), (3, [2e7, 5.0]), (3, [2e7, 5.0]), (20, [0.0, 1.0]), (20, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in K.top_k(df, F.expr("vec_id % 20 = 0"), k=20).collect())
    whole = {(i, tuple(math.floor(64 * x) for x in v)) for i, v in rows}
    want = []
    for q in whole:
        if q[0] % 20 == 0:
            s = sorted((-sum(a * b for a, b in zip(q[1], d[1])), d[0]) for d in whole if d != q)
            want += [(q[0], n + 1, i, -x) for n, (x, i) in enumerate(s)]
    assert got == sorted(want) and max(x[3] for x in got) > 2**53


def test_trees_prune(monkeypatch):
    """Groups far apart: most leaf pairs are never multiplied."""
    monkeypatch.setattr(K, "LEAF", 32)
    rng = np.random.default_rng(1)
    v = np.concatenate([np.floor(rng.normal(size=(300, 16)) * 5 + 400 * np.eye(16)[g]) for g in range(16)])
    seen = []

    class Counted(K.Search):
        def leaves(self, a, b):
            seen.append(len(a) * len(b))
            super().leaves(a, b)
    ids = np.arange(len(v))
    s = Counted(v[::20], ids[::20], v, ids, 5)
    assert sum(seen) < 0.3 * len(v) * len(v[::20])
    dots = v[::20] @ v.T
    for k, q in enumerate(ids[::20]):
        dots[k, q] = -np.inf
        assert sorted(s.score[k].tolist(), reverse=True) == sorted(dots[k], reverse=True)[:5]


URLS = [
    (1, "http://WWW.Example.com/en/1", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
    (2, "https://a.example.com/en/x?y#z", "a.example.com", "/en/x", "example.com/en/", "block"),
    (3, "https://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
    (4, "ftp://b.net/es/", "b.net", "/es/", "net/es/", "block"),
    (5, "ftp://net/fr/q", "net", "/fr/q", "net/fr/", "block"),
    (6, "http://x.com", "x.com", "", None, None),
    (7, "http://x.com?u=http://y.net/es/", "x.com", "", None, None),
    (8, None, "", "", None, None),
    (9, "no scheme.com/a", "", "", None, None),
    (10, "", "", "", None, None),
    (11, "://", "", "", None, None),
    (12, "http://b.net#/es/", "b.net", "", None, None),
    (13, "http://b.net/ES/", "b.net", "/ES/", None, None),
    (14, "x://Ünïc.NET/fr/" + "9" * 5000, "Ünïc.net", "/fr/" + "9" * 5000, "net/fr/", "block"),
]


def test_rules(spark):
    rng = random.Random(1)
    more = [(100 + i, f"http://h{rng.randrange(30)}.{rng.choice(['com/a', 'net/es', 'net/fr', 'net/de', 'org/fr'])}/{i}") for i in range(400)]
    df = spark.createDataFrame([u[:2] for u in URLS] + more + more[:4], "page_id long, url string").withColumn("label", F.lit("x"))
    got = U.filter_urls(df).collect()
    assert len(got) == len(URLS) + 404
    by = {r.page_id: r for r in got}
    for i, _, host, path, rule, verdict in URLS:
        r = by[i]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")
        assert (r.score is None) == (rule is not None)


def test_rules_match_their_sql(spark, tmp_path):
    more = [(100 + i, f"{scheme}{host}{tail}") for i, (scheme, host, tail) in enumerate(
        (a, b, c) for a in ("http://", "HTTPS://", "://", "//", "x:") for b in ("Example.COM", "www.example.com", "a.net", "net", "xnet", "")
        for c in ("", "/", "/en/x", "/es/?a=/fr/", "/fr/#x", "?/es/", "/EN/", "://b.net/fr/"))]
    rows = [u[:2] for u in URLS] + more + [(9000, None), (9001, ""), (9002, "http://é.net/es/" + "ü" * 5000)]
    spark.createDataFrame(rows, "page_id long, url string").coalesce(1).write.parquet(f"file://{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    cur = con.execute(U.RULES_SQL)
    names = [d[0] for d in cur.description]
    key = lambda r: tuple((x is None, x) for x in r)
    got = [tuple(r) for r in U.rules_query(spark, f"file://{tmp_path}").select(*names).collect()]
    assert sorted(got, key=key) == sorted(cur.fetchall(), key=key) and len(got) == len(rows)


def test_held_out_accuracy(spark):
    """Spam-like urls outside the rules are told from plain ones."""
    rng = random.Random(7)

    def url(spam, tld):
        if spam:
            return f"http://{''.join(rng.choice('abcdefghij0123456789-') for _ in range(25))}.{tld}/x{rng.randrange(10**9)}/?a={rng.randrange(9)}&b=2&c={rng.randrange(10**6)}"
        return f"https://{rng.choice(['news', 'blog', 'shop'])}.{tld}/{rng.choice(['about', 'story'])}/{rng.choice('abc')}"
    rows, truth = [], {}
    for i in range(3000):
        spam = rng.random() < 0.5
        tld = rng.choice(["bad", "org"]) if spam else rng.choice(["good", "org"])
        rows.append((i, url(spam, tld)))
        truth[i] = "block" if spam else "allow"
    df = spark.createDataFrame(rows, "page_id long, url string")
    got = U.filter_urls(df, rules=[("allow", "good/"), ("block", "bad/")], sample_rows=800).where("rule is null").collect()
    assert len(got) > 1000 and sum(r.verdict == truth[r.page_id] for r in got) > 0.95 * len(got)


def test_no_training_row_sees_its_own_label(spark):
    """The shares of a labelled row count other folds only, those of other rows count all."""
    rng = random.Random(3)
    rows = [(i, f"http://h{rng.randrange(40)}.{rng.choice(['com', 'net'])}/{rng.choice(['es', 'de'])}/{i}.html") for i in range(600)]
    df = spark.createDataFrame(rows + [(900, None), (901, "http://new.org/es/x.html")], "page_id long, url string")
    full = U._rows(df, "page_id", U.RULES)
    labelled = full.where("label is not null")
    got = U._with_rates(full, labelled, 0.25).collect()
    seen = [r for r in got if r.label is not None]
    assert {r.fold for r in seen} == set(range(U.FOLDS)) and len({(r.host, r.fold) for r in seen}) == len({r.host for r in seen})
    for r in got:
        for s in U.SUFFIXES:
            mine = [x.label for x in seen if x[s] == r[s] and (r.fold is None or x.fold != r.fold)]
            assert abs(r["r_" + s] - (sum(mine) + 0.25 * U.SMOOTH) / (len(mine) + U.SMOOTH)) < 1e-9


def test_held_out_hosts(spark):
    """Hosts that the trees never saw are judged well where their urls tell, and no better than a guess where they do not."""
    rng = random.Random(9)
    rows = []
    for i in range(3000):
        tail = f"{rng.randrange(10**9)}?a=1&b=2&c={rng.randrange(99)}" if i % 2 else rng.choice(["about", "story"])
        rows.append((i, f"http://h{i % 200}.{'bad' if i % 2 else 'good'}.org/{tail}"))
    df = spark.createDataFrame(rows, "page_id long, url string")
    told = U.held_out(df, rules=[("allow", "good.org/"), ("block", "bad.org/")])
    assert told["n_urls"] > 300 and told["accuracy"] > 0.95 and sum(v > 0 for v in told["importance"].values()) > 4
    noise = df.withColumn("url", F.concat(F.lit("http://h"), F.col("page_id") % 200, F.lit(".org/"), F.when(F.rand(4) < 0.5, "x").otherwise("y")))
    half = [("block" if i % 2 else "allow", f"h{i}.org/") for i in range(200)]
    assert U.held_out(noise, rules=half)["accuracy"] < 0.75


def test_url_filter_with_one_label_or_none(spark):
    df = spark.createDataFrame([(1, "http://a.com/"), (2, "http://b.org/")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in U.filter_urls(df).collect()} == {1: "allow", 2: "allow"}
    assert {r.verdict for r in U.filter_urls(df, rules=[("block", "com/")]).collect()} == {"block"}
    assert {r.verdict for r in U.filter_urls(df, rules=[]).collect()} == {"allow"}
    assert U.filter_urls(df.limit(0)).count() == 0


PAGES = [
    ("", ""), ("plain &amp; simple", "plain & simple"), ("<p>a<p>b", "a\n\nb"), ("a<br>b<br><br>c", "a\nb\n\nc"),
    ("<ul><li>x<li>y<ul><li>z</ul><li>w</ul>", "- x\n- y\n  - z\n- w"),
    ("<ol start=9><li>x<li><p>y</p><p>z</p></ol>", "9. x\n10. y\n\n    z"),
    ("<table><tr><th>name<th>n<tr><td>apple<td>3<tr><td>fig<td>12</table>", "name   n\napple  3\nfig    12"),
    ("<table><tr><td colspan=2>wide<td>x<tr><td>aaaa<td>b<td>c</table>", "wide     x\naaaa  b  c"),
    ("<table><thead><tr><th>h</thead><tfoot><tr><td>f</tfoot><tbody><tr><td>b</table>", "h\nb\nf"),
    ("x<script>if (a<b) '</p>'</script>y<!-- no <p> -->z<style>p{}</style>", "xyz"),
    ("<head><title>t</title><meta x></head>body", "body"), ("<title>t</title><p>q", "q"),
    ("<div hidden>a</div><p style='color:red; display : none'>b</p><i style='visibility:hidden'>c</i>d", "d"),
    ("<pre> a\n   b </pre>c", " a\n   b\n\nc"), ("<p>a  \n b\t<b> c</b> <i>d</i></p>", "a b c d"),
    ("<dl><dt>t<dd>d<dt>u<dd>e</dl>", "t\n  d\nu\n  e"), ("<blockquote>q<p>r</blockquote>", "  q\n\n  r"),
    ("a < b and <3 <- c", "a < b and <3 <- c"), ("<p a='x>y'>q</p>", "q"), ("</p></div>x</b>", "x"),
    ("<details><summary>s</summary>hidden</details>", "s"), ("<select><option>a<option>b</select>", "a\nb"),
    ("<input value=v><input type=hidden value=h><button>ok</button>", "vok"), ("&nbsp;&copy;&#65;&bogus;", " ©A&bogus;"),
    ("<div>a<div>b</div>c</div>", "a\nb\nc"), ("<h1>t</h1>x<hr>y", "t\n\nx\n\ny"), ("<unknown>a</unknown>", "a"),
    ("<script>never ends", ""), ("<!-- never ends", ""), ("<p", ""), ("x<", "x<"), ("\x00a", "\x00a"),
]


#: Quotes and comment ends as browsers read them.
BROKEN = [
    ('<a href="x"">one</a><p class="y">two</p>', "one\n\ntwo"), ("<p title=it's>Visible words. You don't see me</p>", "Visible words. You don't see me"),
    ("x<!--> kept <p>all the rest", "x kept\n\nall the rest"), ("x<!---> kept", "x kept"), ("x<!-- gone --!> kept", "x kept"),
    ("x<!-- a > b -- c -->y", "xy"), ("<p title=a'hidden>q</p>it's", "q\n\nit's"), ("<p a='x>y' b = \"z>\">q</p>", "q"),
    ("<p a=>q</p>", "q"), ('<p "a>q" b</p>', 'q" b'), ("<p a=b\"c>q</p><p d='>'>r", "q\n\nr"), ("<a href=/x/>q</a>", "q"),
    ("<p x='1'hidden>q</p>r", "r"), ("<p =x' y>q</p>", "q"),
]


#: Misnested tags, strays of tables and visibility as browsers read them.
MISNESTED = [
    ("<b><p>x</b>y</p>", "xy"), ("<a><div>x</a>y</div>", "xy"), ("<b><div><p>x</b>y</p>z</div>", "xy\n\nz"),
    ("<span><p>x</span>y</p>", "xy"), ("<b hidden><p>x</b>y</p>z", "y\n\nz"), ("<i><b><p>x</b></i>y</p>", "xy"),
    ("<b><i>x</b>y</i>", "xy"), ("<b>x<table><tr><td>y</b>z</table>", "x\n\nyz"),
    ("abc<table>x<tr><td>1<td>2</table>", "abcx\n\n1  2"), ("q<table><tr><div>stray</div><td>1</table>r", "q\nstray\n\n1\n\nr"),
    ("<tr><td>x</td><td>y</td></tr>", "xy"), ("<table><td>a<td>b<tr><td>c</table>", "a  b\nc"),
    ("<table><table><tr><td>1</table>2", "1\n\n2"), ("<table><tr><td>a<div><td>b</table>", "a  b"),
    ("<table><tr><td>a<caption>c</table>", "c\na"),
    ("<p style='visibility:hidden'>a<b style='visibility: visible'>b</b>c</p>d", "b\n\nd"),
    ("<p style='visibility:visible;visibility:hidden'>a</p>b", "b"), ("<div style='visibility:hidden'><q>a</q><input value=v></div>b", "b"),
    ("<ol><li style='visibility:hidden'>a<li>b</ol>", "2. b"),
    ("<p style='display:none'>a<b style='visibility:visible'>b</b></p>c", "c"),
    ("<table><tr><td style='visibility:hidden'>aaa<td>b<tr><td>c<td>d</table>", "   b\nc  d"),
]


@pytest.mark.parametrize("source,text", MISNESTED)
def test_misnested_tags_and_visibility(source, text):
    assert render(source) == text


TABLES = [
    ("<table><tr><td rowspan=2>a<td>b<tr><td>c<td>d</table>", "a  b\n   c  d"),
    ("<table><tr><td rowspan=2>a<br>b<br>c<td>d<tr><td>e</table>", "a  d\nb  e\nc"),
    ("<table><tr><td rowspan=9>a<td>b<tbody><tr><td>c<td>d</table>", "a  b\nc  d"),
    ("<table><tr><td>a<td rowspan=0>b<td>c<tr><td>d<td>e<tr><td>f<td>g</table>", "a  b  c\nd     e\nf     g"),
    ("<table><tr><td colspan=2>long heading<td>x<tr><td>a<td>b<td>c</table>", "long heading  x\na  b          c"),
]


@pytest.mark.parametrize("source,text", TABLES)
def test_spans(source, text):
    assert render(source) == text


def test_cells_of_random_tables_are_aligned():
    """Cells of one column begin at one place, right of all that stands to their left, whatever spans and lengths there are."""
    rng = random.Random(5)
    for _ in range(200):
        rows, cols, taken, parts, place, n = rng.randrange(1, 6), rng.randrange(1, 5), set(), ["<table>"], {}, 0
        for r in range(rows):
            parts.append("<tr>")
            for c in range(cols):
                if (r, c) in taken:
                    continue
                down = rng.randrange(1, rows - r + 1) if rng.random() < 0.3 else 1
                wide = 1
                while c + wide < cols and (r, c + wide) not in taken and rng.random() < 0.2:
                    wide += 1
                taken |= {(r + i, c + j) for i in range(down) for j in range(wide)}
                words = [f"w{n + k}{'x' * rng.randrange(9)}w" for k in range(rng.choice([1, 1, 2, 50]))]
                n += len(words)
                place[words[0]] = (c, c + wide, words)
                parts.append(f"<td rowspan={down} colspan={wide}>{' '.join(words)}")
        lines = render("".join(parts) + "</table>").split("\n")
        found = {w: (k, m) for k, line in enumerate(lines) for w, m in [(x, line.index(x)) for x in line.split()]}
        assert len(found) == n
        starts = {}
        for first, (c, end, words) in place.items():
            starts.setdefault(c, set()).add(found[first][1])
            assert sorted(words, key=lambda w: found[w]) == words
        assert all(len(v) == 1 for v in starts.values())
        at = {c: v.pop() for c, v in starts.items()}
        for c, end, words in place.values():
            right = min((x for k, x in at.items() if k >= end), default=10**9)
            assert all(found[w][1] >= at[c] and found[w][1] + len(w) + 2 <= right for w in words)


@pytest.mark.parametrize("source,text", BROKEN)
def test_quotes_and_comment_ends(source, text):
    assert render(source) == text


@pytest.mark.parametrize("source,text", PAGES)
def test_rendering(source, text):
    assert render(source).replace("\u00a0", " ").strip("\n") == text


def test_pages(spark):
    deep, long = "<div>" * 30_000 + "deep", "<p>" + "word " * 200_000
    rows = [(i, s) for i, (s, _) in enumerate(PAGES)] + [(500, None), (501, deep), (502, long), (503, "<table>" * 500 + "x")]
    df = spark.createDataFrame(rows + rows[:2], "page_id long, html string").withColumn("text", F.lit("clash")).withColumn("n_lines", F.lit(0))
    got = X.extract(df).collect()
    assert len(got) == len(rows) + 2
    by = {r.page_id: r.text for r in got}
    assert by[500] == "" and by[501] == "deep" and by[502].count("word") == 200_000 and by[503].strip() == "x"
    assert X.extract(df.limit(0)).count() == 0


def test_every_visible_word_is_kept():
    """Random nesting of any tags: text outside hidden elements survives, in order or table order."""
    rng = random.Random(11)
    tags = "p div ul ol li table tr td th b i span h1 blockquote pre dl dt dd section a tbody br option".split()
    for _ in range(300):
        parts, n = [], 0
        for _ in range(60):
            kind = rng.random()
            if kind < 0.4:
                parts.append(f" w{n}w ")
                n += 1
            else:
                parts.append(f"<{'/' if kind > 0.75 else ''}{rng.choice(tags)}>")
        text = render("".join(parts))
        for k in range(n):
            assert text.count(f"w{k}w") == 1
