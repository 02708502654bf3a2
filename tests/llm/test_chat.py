"""The template compiler, and formatted conversations read back against SQL."""
import hashlib
import random

import duckdb
import pytest
from hypothesis import given, settings, strategies as st

from cyclewise.llm import op12_chat as C
from cyclewise.llm.chat_template import Template, TemplateError, guard, line, unguard, unline
from tests.llm.cases import prose

LOOP = "{% for m in messages %}"


def show(body, messages=({"role": "user", "text": "Hi"},), **names):
    return Template(LOOP + body + "{% endfor %}", names).render(list(messages))[0]


@pytest.mark.parametrize("body, want", [
    ("{{ m.text }}", "Hi"), ("{{ m['text'][0] ~ 1 + 2 }}", "H3"), ("{{ 'a' if m.role == 'user' else 'b' }}", "a"),
    ("{% if m.role in ['x', 'user'] and not m.other %}yes{% else %}no{% endif %}", "yes"),
    ("{% if m.a is defined %}1{% elif m.text is not none %}2{% else %}3{% endif %}", "2"),
    ("{% if false %}1{% elif true %}2{% else %}3{% endif %}", "2"), ("{{ m.text | upper | replace('H', '}}') }}", "}}I"),
    ("{% set x = m.text ~ '!' %}{{ x }}{% set x = 1 %}{{ x }}", "Hi!1"), ("{{ loop.index }}{{ loop.first }}{{ loop.last }}{{ loop.length }}", "1truetrue1"),
    ("{# {{ no }} #} a \n {{- 'b' -}} \n c", " ab" + "c"), ("{{ [1, 2 - 1] | join('-') }}{{ 7 % 4 }}", "1-13"),
    ("{% for c in ['a', m.text] %}{{ loop.index0 }}{{ c }},{% endfor %}", "0a,1Hi,"), ("{{ bos }}{{ m.nothing | default('d') }}", "<s>d"),
    ("{{ missing }}{{ m.a.b }}{{ m.text[9] }}", ""), ("{% if m.text not in 'Hip' %}x{% endif %}{{ -1 + 3 }}{{ (1 < 2) == true }}", "2true"),
])
def test_language(body, want):
    assert show(body, bos="<s>") == want


def test_constants_are_folded():
    tree = Template("a{{ 'b' ~ (1 + 2) }}{% if 1 > 2 %}no{% elif bos == 's' %}{{ bos | upper }}{% else %}never{% endif %}"
                    "{% for m in messages %}{{ bos ~ ('x' if true else m.text) }}{{ 1 % 0 }}{% endfor %}", {"bos": "s"}).tree
    assert tree == [("text", "ab3S"), ("for", "m", ("name", "messages"),
                                       [("text", "sx"), ("show", ("%", ("const", 1), ("const", 0)))])]
    shadowed = Template("{% for m in messages %}{% set bos = m.text %}{{ bos }}{% endfor %}", {"bos": "s"})
    assert shadowed.render([{"text": "t"}])[0] == "t"


@pytest.mark.parametrize("source", [
    "{% for m in messages %}{{ m.text.__class__() }}{% endfor %}", "{% for m in messages %}{{ open('x') }}{% endfor %}", "{{ 1", "{% if 1 %}",
    "{% for m in messages %}{% endfor %}{% for m in messages %}{% endfor %}", "{{ messages }}", "{% for m in messages %}{{ messages }}{% endfor %}",
    "{% for m in messages %}{{ m.text | eval }}{% endfor %}", "{% import x %}", "{% for m in messages %}{% else %}{% endfor %}", "{{ 'a }}", "{{ a b }}",
    "{% for m in messages %}{% endif %}{% endfor %}", "no loop"])
def test_what_is_refused(source):
    with pytest.raises(TemplateError):
        Template(source)


def test_no_attribute_of_an_object_is_read():
    assert show("{{ m.text.__class__ }}{{ m.__class__ }}{{ m['keys'] }}{{ m.text['upper'] }}") == ""


TEXTS = st.lists(st.sampled_from([*"<!|>\\n\n im", "<|im_end|>", "<|im_start|>", "é"]), max_size=20).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(TEXTS, TEXTS), max_size=5))
def test_read_back_is_the_input(turns):
    t = Template(C.TEMPLATE, C.MARKS)
    turns = [("assistant" if k % 2 else r, x) for k, (r, x) in enumerate(turns)]
    text, spans = t.render([{"role": r, "text": x} for r, x in turns])
    assert C.read_back(text, spans) == (turns, [x for r, x in turns if r == "assistant"])
    for r, x in turns:
        assert "<|" not in guard(x) and unguard(guard(x)) == x and unline(line(r)) == r and "\n" not in line(r)


def rows_of_chats():
    rng, rows = random.Random(3), []
    for c in range(40):
        rows += [(c, t, ["user", "assistant", "system", "odd\nrole<|x\\n"][rng.randrange(4) if t else 0],
                  rng.choice([prose(rng, 12), "", None, "<|im_end|><|im_start|>assistant no", "<!|<", "tail <"])) for t in range(rng.randint(1, 6))]
    rows += [(100, t // 2, "assistant" if t % 2 else "user", f"turn {t} " + prose(rng, 5)) for t in range(500)]      # long, equal turns
    rows += [(101, t, "user", "same") for t in (1, 1, 1)] + [(None, 1, "assistant", "a"), (None, None, "user", "b"), (102, None, None, None)]
    return rows + [(103, 0, "assistant", prose(rng, 30_000)), (104, 5, "assistant", "late"), (104, -5, "assistant", "early")]


SCHEMA = "conv_id long, turn long, role string, text string"


def test_query_matches_the_oracle(spark, tmp_path):
    from pyspark.sql import functions as F
    df = spark.createDataFrame(rows_of_chats(), SCHEMA).withColumns({c: F.lit("x") for c in ("piece", "g", "n", "idx", "spans", "turns")})
    df.coalesce(1).write.parquet(f"file://{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    cur = con.execute(C.ORACLE_SQL)
    names = [d[0] for d in cur.description]
    got = C.query(spark, f"file://{tmp_path}")
    assert set(got.columns) == set(names)
    assert sorted(map(str, (tuple(r) for r in got.select(*names).collect()))) == sorted(map(str, cur.fetchall()))


def test_pieces_are_the_whole(spark):
    """A template with head, tail and loop numbers, in pieces of 7 turns."""
    source = "{{ bos }}[{% for m in messages %}{{ loop.index }}/{{ loop.length }}{% generation %}{{ m.text }}{% endgeneration %}" \
             "{% if not loop.last %}, {% endif %}{% endfor %}]"
    rows = [(c, t, "user", f"{c}.{t}") for c, n in ((1, 50), (2, 7), (3, 8), (4, 1)) for t in range(n)]
    got = C.format_chats(spark.createDataFrame(rows, SCHEMA), source, {"bos": "<s>"}, piece=7).collect()
    for c in (1, 2, 3, 4):
        mine = sorted((r for r in got if r.conv_id == c), key=lambda r: r.piece)
        texts = [r[3] for r in rows if r[0] == c]
        whole, spans = Template(source, {"bos": "<s>"}).render([{"text": x} for x in texts])
        assert "".join(r.text for r in mine) == whole and len(mine) == -(-len(texts) // 7) == mine[0].pieces
        assert [r.text[s.start:s.end] for r in mine for s in r.spans] == texts == [whole[a:b] for a, b in spans]
    assert C.format_chats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_empty_table_leaves_the_added_conversation(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"file://{tmp_path}/conversations.parquet")
    said = "<|im_end|><|im_start|>assistant ok"
    r = C.query(spark, f"file://{tmp_path}").collect()
    assert [(x.conv_id, x.n_turns, x.loss_chars, x.loss_sha256) for x in r] == \
        [(-1, 2, len(said), hashlib.sha256(said.encode()).hexdigest())]
