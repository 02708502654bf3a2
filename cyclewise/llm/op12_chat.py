"""Chat formatting: a template compiler over conversations.

``chat_template`` compiles a sandboxed template to closures; ``format_chats`` renders every conversation with it
to its text and the spans under the loss mask (generation blocks).  Control strings inside texts are escaped
reversibly by the template's own filters, and ``read_back`` splits formatted text into turns again.

A conversation is rendered where its turns are gathered, at most ``PIECE`` turns to a task's group: the turns of
longer ones are first numbered by ranges (``ranks``) and rendered in pieces of that many, which follow each other in the
text, so no conversation, however long, stands in one group or one cell.  Digests over the pieces of
a long conversation are fed in order from sorted rows, one piece in memory at a time.

Cases: null text and null role are empty; turns with equal number come in the order of (role, text), null numbers first;
repeated rows are turns of their own; rows of null conv_id make one conversation of null id; very long texts are
whole; an empty table gives conversation -1 alone in the query, no row in ``format_chats``; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from cyclewise.llm.chat_template import Output, Template, unguard, unline
from cyclewise.llm.common import materialise, read_table
from cyclewise.llm.ranks import ranked

#: Most turns rendered in one group.
PIECE = 64
START, END = "<|im_start|>", "<|im_end|>"
TEMPLATE = """{%- for message in messages -%}
{{ start ~ (message.role | line | guard) ~ '\\n' }}
{%- if message.role == 'assistant' -%}
{% generation %}{{ message.text | guard }}{% endgeneration %}
{%- else -%}
{{ message.text | guard }}
{%- endif -%}
{{ end ~ '\\n' }}
{%- endfor -%}"""
MARKS = {"start": START, "end": END}

_TURNS = "array<struct<turn:long,role:string,text:string>>"
_FORMATTED = "conv_id long, piece long, pieces long, text string, spans array<struct<start:long,end:long>>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _gathered(turns: DataFrame, piece: int) -> DataFrame:
    """conv_id, piece, pieces, first (place of the piece's first turn), total, turns (in order)."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # a key without nulls, so that it joins and groups alike
    rows = rows.withColumn("g", F.coalesce(F.col("conv_id").cast("string"), F.lit("-")))
    long_ones = rows.groupBy("g").agg(F.count(F.lit(1)).alias("turns")).where(F.col("turns") > piece).select("g")
    long_ones = materialise(long_ones, "chat-long")
    short = rows.join(long_ones, "g", "left_anti").withColumns({"piece": F.lit(0).cast("long"), "n": F.lit(None).cast("long")})
    split = ranked(materialise(rows.join(long_ones, "g", "left_semi"), "chat-turns"), "g", ["turn", "role", "text"], "chat-ranked")
    split = split.withColumn("piece", F.expr(f"idx div {piece}"))
    every = short.unionByName(split.select(*short.columns))
    out = every.groupBy("g", "piece").agg(F.first("conv_id").alias("conv_id"), F.max("n").alias("n"),
                                          F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    total = F.coalesce("n", F.size("turns").cast("long"))
    return out.select("conv_id", "piece", F.expr("coalesce((n + {0} - 1) div {0}, 1L)".format(piece)).alias("pieces"),
                      (F.col("piece") * piece).alias("first"), total.alias("total"), "turns")


def format_chats(turns: DataFrame, source: str = TEMPLATE, given: dict | None = None, piece: int = PIECE) -> DataFrame:
    """conv_id, piece, pieces, text, spans: the formatted text of each conversation of ``turns`` (conv_id,
    turn, role, text), in one piece or, beyond ``piece`` turns, in several that follow each other; spans are (start, end) in
    code points of the piece's text."""
    given = MARKS if given is None else given
    Template(source, given)  # a wrong template fails here, not in the tasks

    def rows(batches):
        template = Template(source, given)
        for batch in batches:
            texts, spans = [], []
            for at in range(batch.num_rows):
                pieces, first, total = (batch.column(c)[at].as_py() for c in ("pieces", "first", "total"))
                out = Output()
                if first == 0:
                    template.head(out)
                part = batch.column("turns")[at].as_py()
                for k, m in enumerate(part):
                    template.turn(m, first + k, total, out)
                if first + len(part) == total:
                    template.tail(out)
                texts.append(out.text())
                spans.append([{"start": a, "end": b} for a, b in out.spans])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("conv_id", "piece", "pieces")],
                                              pa.array(texts, pa.string()), pa.array(spans, _SPANS)],
                                             names=["conv_id", "piece", "pieces", "text", "spans"])
    return _gathered(turns, piece).mapInArrow(rows, _FORMATTED)


_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + "\n", re.S)


def read_back(text: str, spans: list[tuple[int, int]]) -> tuple[list[tuple[str, str]], list[str]]:
    """Turns (role, text) of a formatted piece, and the texts under its loss mask, unescaped."""
    turns, at = [], 0
    while at < len(text):
        m = _TURN.match(text, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        turns.append((unline(unguard(m[1])), unguard(m[2])))
        at = m.end()
    return turns, [unguard(text[a:b]) for a, b in spans]


_DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digests(batches):
    """Digests of conversations from their pieces in order; a conversation's pieces stand side by side."""
    names = [c.split(" ")[0] for c in _DIGESTS.split(", ")]
    kinds = [pa.string() if c.endswith("sha256") else pa.int64() for c in names]
    held = None

    def row(h):
        return (h["conv"], h["turns"], h["all"].hexdigest(), h["chars"], h["loss"].hexdigest(), h["formatted"])

    def packed(out):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kinds[k]) for k in range(len(names))], names=names)

    for batch in batches:
        out = []
        for at in range(batch.num_rows):
            conv, piece, text, spans = (batch.column(c)[at].as_py() for c in ("conv_id", "piece", "text", "spans"))
            if piece == 0:
                if held:
                    out.append(row(held))
                held = {"conv": conv, "turns": 0, "all": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "formatted": 0}
            turns, loss = read_back(text, [(s["start"], s["end"]) for s in spans])
            held["turns"] += len(turns)
            held["formatted"] += len(text)
            held["all"].update("".join(f"{r}\n{t}\n" for r, t in turns).encode())
            held["chars"] += sum(map(len, loss))
            held["loss"].update("".join(loss).encode())
        yield packed(out)
    if held:
        yield packed([row(held)])


def digests(formatted: DataFrame) -> DataFrame:
    """One row a conversation of a table that ``format_chats`` made, read back from it: conv_id, n_turns,
    turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    columns = ["conv_id", "piece", "text", "spans"]
    whole = formatted.where("pieces = 1").select(*columns).mapInArrow(_digests, _DIGESTS)
    parts = formatted.where("pieces > 1").select(*columns).repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    return whole.unionByName(parts.mapInArrow(_digests, _DIGESTS))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read_table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    said = f"{END}{START}assistant ok"
    added = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.inline(F.array(
        *[F.struct(F.lit(k).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(said).alias("text"))
          for k, r in enumerate(("user", "assistant"))])))
    return digests(materialise(format_chats(table.unionByName(added)), "chats"))


_RAW = """SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'"""
ORACLE_SQL = f"""WITH t AS ({_RAW}),
e AS (SELECT *, regexp_replace(text, '<(!*)\\|', '<!\\1|', 'g') AS shown,
  regexp_replace(replace(replace(role, chr(92), chr(92) || chr(92)), chr(10), chr(92) || 'n'), '<(!*)\\|', '<!\\1|', 'g') AS shown_role FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('{START}') + length(shown_role) + 1 + length(shown) + length('{END}') + 1) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id"""
