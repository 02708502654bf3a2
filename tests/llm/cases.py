"""Small tables with every awkward row."""
import random

WORDS = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "Re", "tü", "so") for b in ("n", "r", "s", "t") for c in ("a", "e", "o", "ing", "é")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside themselves.
CLASHING = ["n", "rep", "h", "b", "k", "z", "rank", "length", "host", "t", "cuts", "x_source", "mix_pass", "hit", "frequent",
            "n_words", "kept_text", "position", "bucket", "c_text", "label", "v", "dim"]


def prose(rng, n):
    out = []
    for k in range(n):
        out.append(rng.choice(WORDS))
        if rng.random() < 0.08:
            out[-1] += rng.choice([".", ",", ".\n", "\n", "\t", "  "])
    return " ".join(out)


def edited(rng, text, share):
    return " ".join(rng.choice(WORDS) + "x" if rng.random() < share else w for w in text.split(" "))


def documents(seed=1, n=60):
    """(doc_id, text, lang, source, n_chars): copies, near copies at all
    distances, a shared passage, repeated windows, null and empty texts, one long text."""
    rng = random.Random(seed)
    base, passage = prose(rng, 120), prose(rng, 60)
    texts = [prose(rng, rng.choice([3, 12, 13, 14, 40, 90, 200])) for _ in range(n)]
    texts += [base] * 4 + [edited(rng, base, rng.choice([0.002, 0.01, 0.02, 0.04, 0.1])) for _ in range(25)]
    texts += [prose(rng, 20) + " " + passage + " " + prose(rng, 25) for _ in range(8)]
    texts += [None, "", "  \n\t ", "one", "Two words", " ".join(["again"] * 50), prose(rng, 30) * 3, "a b c\n" * 40,
              prose(rng, 9000), "<|endoftext|> and\x0b\x0cmore \u00a0 space " + prose(rng, 20), "x" * 5000]
    texts += [base.upper(), base.replace(" ", "\n")]
    rng.shuffle(texts)
    rows = []
    for i, t in enumerate(texts):
        source = None if i % 11 == 0 else "hot" if i % 3 == 0 else f"s{i % 5}"
        rows.append((3 * i + 1, t, None if i % 7 == 0 else "en", source, None if t is None else len(t)))
    return rows


def frame(spark, rows, extra=False, schema=SCHEMA):
    df = spark.createDataFrame(rows, schema)
    if extra:
        from pyspark.sql import functions as F
        df = df.withColumns({c: F.lit(None).cast("string") if i % 2 else F.lit(i)
                             for i, c in enumerate(CLASHING) if c not in df.columns})
    return df
