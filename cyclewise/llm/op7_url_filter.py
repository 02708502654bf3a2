"""URL filter: rules first, then gradient-boosted trees on lexical features.

A rule is a host with its subdomains and a path prefix; the longest that fits a url
judges it.  Urls that a rule judges are the labelled ones: they give the suffix
statistics (smoothed share of blocked urls by last host label, registered
name, first path part and file ending) and the training rows of the
trees, which judge all other urls.  Statistics count every labelled row, but a training row sees
those of other folds only: hosts are dealt to ``FOLDS`` folds by hash, so no row's own label
is in its features.  The trees are fitted on a hash sample of about ``SAMPLE_ROWS`` labelled rows,
the one bound in this operator; each split chooses among a third of the features.  ``held_out``
fits without one fold and tells how well its hosts are judged.

Cases: a null url, or one without ``://``, has an empty host and path and is judged by the
trees like any other; very long urls are read whole; repeated rows are judged alike; if all labelled rows carry one
label (or there are none) that label (or allow) is the verdict; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cyclewise.llm.common import LOWER, UPPER, ascii_lower, materialise, read_table

#: (verdict, host and path) of the production rules.
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"),
         ("block", "net/es/"), ("block", "net/fr/")]
SAMPLE_ROWS = 20_000
TREES, DEPTH, SEED = 20, 4, 13
SMOOTH = 20.0
FOLDS = 4
LEXICAL = ["f_len", "f_depth", "f_digits", "f_entropy", "f_params", "f_labels", "f_host_len", "f_path_len",
           "f_hyphens", "f_fragment", "f_secure", "f_sub"]
SUFFIXES = ["s_tld", "s_name", "s_part", "s_ending"]


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url."""
    u = F.coalesce(url, F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise("")
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    tail = F.substring(rest, F.length(raw) + 1, F.length(rest) + 1)
    return ascii_lower(raw), F.regexp_extract(tail, r"^[^?#]*", 0)


def judge(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    out = None
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def _features(df: DataFrame) -> DataFrame:
    url, host, path = F.coalesce("url", F.lit("")), F.col("host"), F.col("path")
    n = F.greatest(F.length(url), F.lit(1)).cast("double")
    count = lambda c, cls: F.regexp_count(c, F.lit(cls)).cast("double")
    entropy = F.aggregate(
        F.array_distinct(F.split(url, "")), F.lit(0.0),
        lambda acc, ch: acc - F.when(ch == "", 0.0).otherwise(
            (F.length(url) - F.length(F.replace(url, ch, F.lit("")))) / n
            * F.log2((F.length(url) - F.length(F.replace(url, ch, F.lit("")))) / n)))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return df.withColumns({
        "f_len": n, "f_depth": count(path, "/"), "f_digits": count(url, "[0-9]") / n, "f_entropy": entropy,
        "f_params": count(query, "[^&]+"), "f_labels": count(host, r"[^.]+"), "f_host_len": F.length(host).cast("double"),
        "f_path_len": F.length(path).cast("double"), "f_hyphens": count(url, "[-_]"),
        "f_fragment": F.instr(url, "#").cast("boolean").cast("double"),
        "f_secure": url.startswith("https").cast("double"), "f_sub": host.startswith("www.").cast("double"),
        "s_tld": F.substring_index(host, ".", -1), "s_name": F.substring_index(host, ".", -2),
        "s_part": F.regexp_extract(path, r"^/([^/]*)", 1), "s_ending": F.regexp_extract(path, r"\.([A-Za-z0-9]{1,8})$", 1),
    })


def _with_rates(df: DataFrame, labelled: DataFrame, prior: float) -> DataFrame:
    """``df`` plus the smoothed share of blocked rows by each suffix, without the row's own fold."""
    for s in SUFFIXES:
        of = [F.col("fold") == k for k in range(FOLDS)]
        stats = labelled.groupBy(s).agg(
            F.count(F.lit(1)).alias("n"), F.sum("label").alias("p"),
            F.array(*[F.count(F.when(c, 1)) for c in of]).alias("n_of"),
            F.array(*[F.coalesce(F.sum(F.when(c, F.col("label"))), F.lit(0.0)) for c in of]).alias("p_of"))
        own = lambda c: F.coalesce(F.get(c, F.col("fold")), F.lit(0))
        rate = (F.col("p") - own("p_of") + prior * SMOOTH) / (F.col("n") - own("n_of") + SMOOTH)
        df = df.join(stats, s, "left").withColumn(f"r_{s}", F.coalesce(rate, F.lit(prior))).drop("n", "p", "n_of", "p_of")
    return df


def _ready(df: DataFrame, labelled: DataFrame, prior: float) -> DataFrame:
    columns = LEXICAL + [f"r_{s}" for s in SUFFIXES]
    return VectorAssembler(inputCols=columns, outputCol="features").transform(_with_rates(df, labelled, prior))


def _rows(pages: DataFrame, key: str, rules: list[tuple[str, str]]) -> DataFrame:
    """Every row with its rule, features, fold and place in the sample; the url itself goes no further."""
    host, path = split_url(F.col("url"))
    rows = pages.select(F.col(key).alias("page_id"), F.col("url").cast("string").alias("url"), host.alias("host"),
                        path.alias("path"))
    rows = rows.withColumn("j", judge(F.col("host"), F.col("path"), rules))
    rows = _features(rows).withColumn("label", (F.col("j.verdict") == "block").cast("double"))
    rows = rows.withColumn("pick", F.xxhash64(F.lit(SEED), "url", "page_id")).withColumn(
        "fold", F.when(F.col("label").isNotNull(), F.pmod(F.xxhash64(F.lit(SEED), "host"), F.lit(FOLDS)).cast("int")))
    return materialise(rows.drop("url"), "url-features")


def _sample(labelled: DataFrame, total: int, sample_rows: int) -> DataFrame:
    share = min(1.0, sample_rows / total)
    return labelled.where(F.pmod("pick", F.lit(1 << 30)) < int(share * (1 << 30))).select(
        "pick", "fold", "label", *LEXICAL, *SUFFIXES)


def _fit(sample: DataFrame, labelled: DataFrame, prior: float) -> GBTClassificationModel:
    train = _ready(sample, labelled, prior).select("pick", "features", "label")
    # dealt and ordered by the rows' hash, so that a repeated fit adds up alike
    train = train.repartition(8, "pick").sortWithinPartitions("pick").select("features", "label")
    return GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=SEED, maxBins=32, featureSubsetStrategy="onethird").fit(train)


def _counts(labelled: DataFrame) -> dict[float, int]:
    return {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}


def filter_urls(pages: DataFrame, key: str = "page_id", rules: list[tuple[str, str]] | None = None,
                sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """page_id, host, path, rule, verdict, score (share of trees' belief in
    block; null where a rule judged) of every row."""
    rows = _rows(pages, key, RULES if rules is None else rules)
    labelled = rows.where("label is not null")
    seen = _counts(labelled)
    keep = ["page_id", "host", "path", F.col("j.rule").alias("rule")]
    if len(seen) < 2:
        only = "block" if seen.get(1.0) else "allow"
        return rows.select(*keep, F.coalesce("j.verdict", F.lit(only)).alias("verdict"), F.lit(None).cast("double").alias("score"))
    total = sum(seen.values())
    prior = seen[1.0] / total
    model = _fit(_sample(labelled, total, sample_rows), labelled, prior)
    scored = model.transform(_ready(rows.where("label is null"), labelled, prior).select("page_id", "host", "path", "j", "features"))
    score = vector_to_array("probability")[1]
    judged = labelled.select(*keep, F.col("j.verdict").alias("verdict"), F.lit(None).cast("double").alias("score"))
    return judged.unionByName(scored.select(
        *keep, F.when(score >= 0.5, "block").otherwise("allow").alias("verdict"), score.alias("score")))


def held_out(pages: DataFrame, key: str = "page_id", rules: list[tuple[str, str]] | None = None,
             sample_rows: int = SAMPLE_ROWS, fold: int = 0) -> dict:
    """How the urls of one fold's hosts are judged by statistics and trees of the other folds: n_urls, accuracy, base
    (share of the commoner label) and the importance of each feature.  None of the hosts is in the training rows."""
    rows = _rows(pages, key, RULES if rules is None else rules).where("label is not null")
    rest, out = rows.where(F.col("fold") != fold), rows.where(F.col("fold") == fold)
    seen = _counts(rest)
    if len(seen) < 2:
        raise ValueError("the other folds hold one label only")
    total = sum(seen.values())
    prior = seen[1.0] / total
    model = _fit(_sample(rest, total, sample_rows), rest, prior)
    scored = model.transform(_ready(out, rest, prior).select("label", "features"))
    got = scored.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy"),
                     F.avg("label").alias("block")).first()
    names = LEXICAL + [f"r_{s}" for s in SUFFIXES]
    return {"n_urls": got["n"], "accuracy": got["accuracy"], "base": None if got["block"] is None else max(got["block"], 1 - got["block"]),
            "importance": dict(zip(names, map(float, model.featureImportances.toArray())))}


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(read_table(spark, sf_dir, "pages"))


def rules_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule and the rule's verdict (null where none fits) of every page: what the trees have no part in."""
    host, path = split_url(F.col("url"))
    rows = read_table(spark, sf_dir, "pages").select("page_id", host.alias("host"), path.alias("path"))
    return rows.withColumn("j", judge(F.col("host"), F.col("path"), RULES)).select("page_id", "host", "path", "j.rule", "j.verdict")


def _rule_case(value: str) -> str:
    """CASE over the rules, longest first; ``value`` is 'rule' or 'verdict'."""
    whens = []
    for verdict, rule in sorted(RULES, key=lambda r: -len(r[1])):
        name, _, rest = rule.partition("/")
        whens.append(f"WHEN (host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '/{rest}') "
                     f"THEN '{rule if value == 'rule' else verdict}'")
    return "CASE " + " ".join(whens) + " END"


#: DuckDB SQL for the rows of ``rules_query``.
RULES_SQL = f"""
WITH cut AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, regexp_extract(rest, '^([^/?#]*)', 1) AS raw, rest FROM cut
), split AS (
  SELECT page_id, translate(raw, '{UPPER}', '{LOWER}') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^([^?#]*)', 1) AS path FROM parts
)
SELECT page_id, host, path, {_rule_case('rule')} AS rule, {_rule_case('verdict')} AS verdict FROM split
"""
