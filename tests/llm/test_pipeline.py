"""The pipeline's stages on every awkward row, and the registered queries."""
import random

import corpus_pipeline as C
import __spark_entry__ as E
from cyclewise.llm import op2_quality_rules as Q, queries as llm
from tests.llm.cases import documents, frame, prose
from tests.llm.test_pairs import brute_components, brute_cut
from tests.llm.test_rows import brute_rules, words
from tests.llm.test_tokens import check_layout


def test_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in llm.QUERIES) == list(range(1, len(llm.QUERIES) + 1))
    assert {*llm.QUERIES, "pipeline"} <= set(E.queries())


def test_stages_against_brute_force(spark):
    rows = documents(seed=12) + [(9000, "", None, None, 0)]
    df = frame(spark, rows)
    by = {name: f for name, f in C.STAGES}
    assert list(by) == ["quality_rules", "jaccard_join", "substring_dedup", "mixing", "packing"]

    one = by["quality_rules"](spark, df, "")
    kept = {i for i, w in brute_rules(rows, Q.LINE_SHARE, Q.LINE_DOCUMENTS)[0].items() if w[-1]}
    assert {r.doc_id for r in one.collect()} == kept and one.columns == df.columns
    rows = [r for r in rows if r[0] in kept]

    two = by["jaccard_join"](spark, frame(spark, rows), "")
    first = {i for i, _, c in brute_components(rows, 5, 80) if i == c}
    assert {r.doc_id for r in two.collect()} == first and two.columns == df.columns
    rows = [r for r in rows if r[0] in first]

    three = by["substring_dedup"](spark, frame(spark, rows), "")
    cut = {i: n - gone for i, n, gone, _ in brute_cut(rows)}
    got = {r.doc_id: r for r in three.collect()}
    assert {i: len(words(r.text)) for i, r in got.items()} == {i: n for i, n in cut.items() if n}
    assert three.columns == df.columns

    four = by["mixing"](spark, three, "")
    assert {r.doc_id for r in four.collect()} == set(got) and four.columns == df.columns

    five = by["packing"](spark, four, "").collect()
    assert {r.doc_id for r in five} == set(got)
    check_layout(five, 1024)


def test_texts_under_one_id_are_documents(spark):
    """Different texts under one id stay, and lose only what their own text shares with a smaller id."""
    rng = random.Random(4)
    a, b, c, d, passage = (prose(rng, 60) for _ in range(5))
    e = passage + " " + c
    rows = [(1, passage, None, "s", None), (7, a, None, "s", None), (7, a, None, "s", None), (7, b, None, "s", None),
            (7, e, None, "s", None), (9, b, None, "s", None), (9, d, None, "s", None), (None, "no id", None, "s", None)]
    by = dict(C.STAGES)
    two = by["jaccard_join"](spark, frame(spark, rows, extra=True), "")
    want = [(1, passage), (7, a), (7, b), (7, e), (9, d), (None, "no id")]
    assert sorted(((r.doc_id, r.text) for r in two.collect()), key=str) == sorted(want, key=str)
    assert two.columns == frame(spark, rows, extra=True).columns
    three = by["substring_dedup"](spark, frame(spark, [(i, t, None, "s", None) for i, t in want if i]), "")
    cut = {(i, " ".join(t.split())) for i, t in want if i} - {(7, " ".join(e.split()))} | {(7, " ".join(c.split()))}
    assert {(r.doc_id, " ".join(r.text.split())) for r in three.collect()} == cut


def test_run_on_an_empty_table(spark, tmp_path):
    frame(spark, []).write.parquet(f"file://{tmp_path}/documents.parquet")
    assert C.run(spark, f"file://{tmp_path}").count() == 0


def test_run_on_rows(spark, tmp_path):
    """The whole pipeline: the documents that brute force keeps, packed, each at least once."""
    rows = documents(seed=14)
    frame(spark, rows).write.parquet(f"file://{tmp_path}/documents.parquet")
    got = C.run(spark, f"file://{tmp_path}").collect()
    judged, often = brute_rules(rows, Q.LINE_SHARE, Q.LINE_DOCUMENTS)
    norm = lambda x: b" ".join(words(x)).lower()
    left = [(i, "\n".join(x for x in t.split("\n") if (s, norm(x)) not in often), lang, s, n)
            for i, t, lang, s, n in rows if judged[i][-1]]
    first = {i for i, _, c in brute_components(left, 5, 80) if i == c}
    kept = {i for i, n, gone, _ in brute_cut([r for r in left if r[0] in first]) if n > gone}
    assert {r.doc_id for r in got} == kept and len(kept) > 20
    check_layout(got, 1024)
