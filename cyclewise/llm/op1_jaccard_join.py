"""N-gram Jaccard join: exact links and components of documents by their word shingles.

Sets and metric.  A document is its set of distinct n-word shingles (64-bit hashes).  Sets are compared by
the size of their symmetric difference, a metric: x and y link (100 |x & y| >= T |x u y|)
only if it is at most (100 - T) (|x| + |y|) / (100 + T).

Regions and windows.  This is prefix filtering, in place of dealt Voronoi regions: documents that have nothing in common
all lie far apart alike, so regions around sampled documents hold much of the table (figures in the README).  The pivots are therefore the shingles
themselves in one common order, rarest first: the prefixes of that order are nested sets, and a document's distances to them are its
ranks.  A document's home region is that of its first shingle; the triangle inequality
lets a partner lack at most (100 - T) % of its shingles, so it is replicated to the
regions of its next shingles just that far, and every linked pair meets in the region
of its first common shingle.  There, with r_x and r_y shingles before it, the pair needs
slack(x) + slack(y) >= 0, where slack(x) = (100 - T) |x| - (100 + T) r_x.

Recursion.  Each region's pivot document is the one with the fewest shingles before it; all others
are first compared with it alone.  What links makes components.  Only regions that still hold several components go on:
their documents outside the pivot's component are joined with the region's inner ring (slack 0 and
more) and, from the inner ring only, with its outer ring, as far as the triangle inequality lets them,
and never inside one component.  Documents that share a passage meet in a region for each of its shingles; a
pair that shares one of the ``BEFORE`` mixed regions just before this one has met there, under a weaker bound, and is
not made again.  So a group of
copies costs its size, not its square, and no link between different components is missed.

Links.  These steps give the components; every link lies inside one.  A component's representatives are dealt by a hash
into blocks of about ``BLOCK`` sets, small components share a group, and every pair of blocks is a group of
its own, in which all pairs are verified on the whole sets.  So each pair is tested once, and no link between different sets is missed.
A component of m sets costs m * m / 2 tests and sends each set m / ``BLOCK`` times; links are counted
inside the groups, so the query holds no row for each link.

Between the two, the counts of shingles in 256 fixed parts of the universe (256 more pivot
sets) bound the symmetric difference from below and drop most candidates, their parities already inside the last join.  What is left is verified on the whole sets.

Documents of equal sets are one representative throughout.  Very common shingles come last in the
order by their counts, which cover all documents (counts below two in a chunk are left out);
at most ``COMMON`` of them are broadcast.  The order decides cost alone: any order gives the same links.

Cases: null or empty text, or no word: an empty set, linked with nothing; fewer than n words: the whole sequence is one
shingle; rows that repeat an id with its text count once; if texts differ under one id,
each row has its own set, and the rows may share their links; rows without an id are left out;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType

from cyclewise.llm import idfilter
from cyclewise.llm.common import materialise, read_table, scratch, with_own_id
from cyclewise.llm.components import components
from cyclewise.llm.wordhash import combine, mix, word_hashes

SHINGLE, PERCENT = 4, 85
COMMON = 500_000
COUNT_CHUNK = 2_000_000
PARTS = 256
#: Sets and shingles of a block of a component, about.
BLOCK, BLOCK_SHINGLES = 128, 1_000_000
#: Earlier regions beside an entry, to see that a pair has met before.
BEFORE = 16
PARITY = [f"p{k}" for k in range(PARTS // 64)]
SET_SCHEMA = "doc_id long, n long, d1 long, d2 long, sketch binary, " + "".join(f"{p} long, " for p in PARITY) + "win array<long>"


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text, A-Z lowered."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = word_hashes(words)
    if len(words) < n:
        # the whole sequence: its length goes in, so that it equals no other's
        x = np.uint64(len(words))
        for v in h:
            x = mix(np.array([x], np.uint64) * np.uint64(0x9E3779B97F4A7C15) + v)[0]
        return np.array([x], np.uint64)
    return np.unique(combine(h, n))


def _counts(n: int):
    """(h, c) of the shingles that stand in two or more documents of a chunk."""
    def run(batches):
        held, size = [], 0

        def counted():
            value, count = np.unique(np.concatenate(held), return_counts=True)
            keep = count > 1
            return pa.RecordBatch.from_arrays([pa.array(value[keep].view(np.int64)), pa.array(count[keep])], names=["h", "c"])

        for batch in batches:
            for text in batch.column(0):
                s = shingle_set(text.as_py(), n)
                held.append(s)
                size += len(s)
                if size >= COUNT_CHUNK:
                    yield counted()
                    held, size = [], 0
        if held:
            yield counted()
    return run


def common_shingles(docs: DataFrame, n: int, most: int = COMMON):
    """Hashes (sorted) and counts of the most common shingles, at most ``most``."""
    counts = docs.select("text").mapInArrow(_counts(n), "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))
    counts = materialise(counts, "shingle-counts")
    # counts by eighths of powers of two: a bounded histogram that fixes the cut
    level = F.floor(F.log2("c") * 8).cast("int")
    hist = counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()
    cut, total = 0, 0
    for row in sorted(hist, key=lambda r: -r["level"]):
        if total + row["n"] > most:
            cut = row["level"] + 1
            break
        total += row["n"]
    rows = counts.where(level >= cut).toPandas()
    h = rows["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], rows["c"].to_numpy(np.int64)[order]


def _sets(n: int, percent: int, common):
    def run(batches):
        h, c = common.value
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                s = shingle_set(text.as_py(), n)
                d1, d2 = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64).tolist()
                counts = np.bincount((s >> np.uint64(56)).astype(np.int64), minlength=PARTS)
                reach = len(s) * (100 - percent) // 100 + 1
                at = np.minimum(np.searchsorted(h, s), max(len(h) - 1, 0))
                often = h[at] == s if len(h) else np.zeros(len(s), bool)
                win = s[~often][:reach]
                if len(win) < reach:
                    rest = np.flatnonzero(often)
                    rest = rest[np.argsort(c[at[rest]], kind="stable")]
                    win = np.concatenate([win, s[rest[:reach - len(win)]]])
                parity = np.packbits((counts & 1).astype(np.uint8)).view(np.int64).tolist()
                rows.append((doc_id.as_py(), len(s), d1, d2, np.minimum(counts, 255).astype(np.uint8).tobytes(), *parity, win.view(np.int64)))
            if rows:
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(x, pa.int64()) for x in cols[:4]), pa.array(cols[4], pa.binary()),
                     *(pa.array(x, pa.int64()) for x in cols[5:-1]),
                     pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, cols[-1])]), pa.int32()),
                                              pa.array(np.concatenate(cols[-1])))],
                    names=["doc_id", "n", "d1", "d2", "sketch", *PARITY, "win"])
    return run


@pandas_udf(LongType())
def _apart(a: pd.Series, b: pd.Series) -> pd.Series:
    """A lower bound of the symmetric difference of two sets, from their sketches."""
    x, y = (np.frombuffer(b"".join(s), np.uint8).reshape(-1, PARTS).astype(np.int16) for s in (a, b))
    return pd.Series(np.abs(x - y).sum(axis=1, dtype=np.int64))


def _chosen_sets(n: int, bits):
    """(rep, s): sets of the documents whose id may be wanted."""
    def run(batches):
        for batch in batches:
            hit = np.flatnonzero(idfilter.hits(bits.value, batch.column(2).to_numpy())).tolist()
            sets = [shingle_set(batch.column(1)[k].as_py(), n).view(np.int64) for k in hit]
            if hit:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(hit)),
                     pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()),
                                              pa.array(np.concatenate(sets)))], names=["rep", "s"])
    return run


def _linked(percent: int, counted: bool):
    """Links (a, b) inside the components of one group, or their number by representative (rep, k)."""
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("root", "ascending"), ("block", "ascending")])
        root, block, rep = (table.column(c).to_numpy() for c in ("root", "block", "rep"))
        cross = table.column("lo")[0].as_py() != table.column("hi")[0].as_py()
        s = table.column("s").combine_chunks()
        size = s.value_lengths().to_numpy().astype(np.int64)
        at = np.concatenate([[0], np.cumsum(size)])
        value, x = np.unique(s.flatten().to_numpy(), return_inverse=True)
        flag = np.zeros(len(value), bool)
        upto = np.searchsorted(root, root, side="right")
        first = np.searchsorted(block, table.column("hi")[0].as_py()) if cross else 0
        pairs = [np.zeros((0, 2), np.int64)]
        for k in range(first if cross else len(rep)):
            # the rows after this one in its component; of two blocks, those of the other
            lo, hi = first if cross else k + 1, upto[k]
            if lo >= hi:
                continue
            flag[x[at[k]:at[k + 1]]] = True
            common = np.add.reduceat(flag[x[at[lo]:at[hi]]], at[lo:hi] - at[lo], dtype=np.int64)
            flag[x[at[k]:at[k + 1]]] = False
            other = rep[lo:hi][100 * common >= percent * (size[k] + size[lo:hi] - common)]
            other = other[other != rep[k]]
            pairs.append(np.stack([np.minimum(other, rep[k]), np.maximum(other, rep[k])], axis=1))
        pairs = np.unique(np.concatenate(pairs), axis=0)
        if counted:
            return pa.table(dict(zip(("rep", "k"), map(pa.array, np.unique(pairs, return_counts=True)))))
        return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})
    return run


class _Join:
    """The steps over one table, each written before the next."""

    def __init__(self, docs: DataFrame, n: int, percent: int):
        self.n, self.near, self.far = n, 100 - percent, 100 + percent
        self.percent = percent
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        self.docs = self.docs.where("doc_id is not null")
        common = docs.sparkSession.sparkContext.broadcast(common_shingles(self.docs, n))
        self.sets = materialise(self.docs.mapInArrow(_sets(n, percent, common), SET_SCHEMA), "sets")
        groups = self.sets.where("n > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("k"))
        self.groups = materialise(groups, "set-groups")
        reps = self.sets.where("n > 0").join(
            self.groups.select(F.col("rep").alias("doc_id"), F.col("d1").alias("g1"), F.col("d2").alias("g2"), "k"), "doc_id")
        reps = reps.where("d1 = g1 and d2 = g2").select(F.col("doc_id").alias("rep"), "n", "sketch", *PARITY, "win", "k")
        # rows that repeat an id with its text stand twice here; groups of one row (nearly all) do not need the check
        single = reps.where("k = 1").drop("k")
        several = reps.where("k > 1").drop("k").dropDuplicates(["rep", "win"])
        self.reps = materialise(single.unionByName(several), "set-reps")

    def entries(self) -> DataFrame:
        """z, rep, n, slack, r of the regions that hold two representatives or more."""
        e = self.reps.select("rep", "n", F.posexplode("win").alias("r", "z"))
        shared = materialise(e.groupBy("z").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("z"), "regions")
        slack = self.near * F.col("n") - self.far * F.col("r")
        return materialise(e.join(shared, "z").select("z", "rep", "n", slack.alias("slack")), "region-entries")

    def _may(self, a: str, b: str):
        n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
        return (F.col(f"{a}.slack") + F.col(f"{b}.slack") >= 0) & (100 * F.least(n, m) >= self.percent * F.greatest(n, m))

    def _near(self, a: str, b: str):
        """Parts of the universe whose counts differ in parity differ by a shingle at least."""
        odd = sum(F.bit_count(F.col(f"{a}.{p}").bitwiseXOR(F.col(f"{b}.{p}"))) for p in PARITY)
        return self.far * odd <= self.near * (F.col(f"{a}.n") + F.col(f"{b}.n"))

    @staticmethod
    def _pairs(rows: DataFrame, a: str, b: str) -> DataFrame:
        x, y = F.col(f"{a}.rep"), F.col(f"{b}.rep")
        return rows.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).where("a <> b").distinct()

    def star(self, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Each region's pivot document, and the pairs it makes with the others."""
        pivots = entries.groupBy("z").agg(F.max(F.struct("slack", F.negative("rep").alias("m"), "n")).alias("p"))
        pivots = materialise(pivots.select("z", (-F.col("p.m")).alias("rep"), F.col("p.n").alias("n"),
                                           F.col("p.slack").alias("slack")), "pivots")
        met = entries.alias("x").join(pivots.alias("p"), "z").where(self._may("x", "p"))
        return pivots, self._pairs(met, "x", "p")

    def across(self, entries: DataFrame, pivots: DataFrame, labels: DataFrame) -> DataFrame:
        """Pairs of different components that still may link, from the regions
        that hold several components."""
        c = labels.select(F.col("node").alias("rep"), "root")
        e = entries.join(c, "rep", "left").withColumn("c", F.coalesce("root", "rep")).drop("root")
        e = materialise(e, "labelled-entries")
        mixed = e.groupBy("z").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("z")
        home = pivots.select("z", "rep").join(mixed, "z").join(c, "rep", "left").select("z", F.coalesce("root", "rep").alias("home"))
        home = materialise(home, "mixed-regions")
        # a document's mixed regions in order (slack falls), and beside each the ones just before it
        held = F.sort_array(F.collect_list(F.struct(F.negative("slack").alias("o"), "z", "home"))).alias("held")
        e = e.join(home, "z").groupBy("rep", "n", "c").agg(held).join(self.reps.select("rep", *PARITY), "rep")
        e = e.select("rep", "n", "c", *PARITY, "held", F.posexplode("held").alias("k", "e"))
        before = F.transform(F.slice("held", F.greatest(F.col("k") - BEFORE + 1, F.lit(1)), F.least("k", F.lit(BEFORE))), lambda x: x["z"])
        # inner ring: slack 0 and more; a document of the outer ring has no partner there
        inner = (F.col("slack") >= 0).cast("int")
        e = e.select("rep", "n", "c", *PARITY, "e.z", "e.home", F.negative("e.o").alias("slack"), before.alias("before"))
        e = materialise(e.withColumn("ring", inner), "mixed-entries")
        out = e.where("c <> home").withColumn("ring", F.explode(F.sequence(1 - inner, F.lit(1))))
        met = out.alias("x").join(e.alias("y"), ["z", "ring"]).where(
            (F.col("x.c") != F.col("y.c")) & ((F.col("y.c") == F.col("y.home")) | (F.col("x.rep") < F.col("y.rep")))
            & self._may("x", "y") & self._near("x", "y") & ~F.arrays_overlap("x.before", "y.before"))
        return self._pairs(met, "x", "y")

    def links(self, pairs: DataFrame, name: str) -> DataFrame:
        """The pairs that link, by their sketches and then by their whole sets."""
        pairs = materialise(pairs, f"{name}-candidates")
        s = self.reps.select("rep", "n", "sketch")
        one = pairs.join(s.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa")), "a")
        two = one.join(s.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb")), "b")
        near = two.where(self.far * _apart("sa", "sb") <= self.near * (F.col("na") + F.col("nb"))).select("a", "b", "na", "nb")
        near = materialise(near.distinct(), f"{name}-near")
        ids = materialise(near.select(F.col("a").alias("rep")).union(near.select("b")).distinct(), f"{name}-ids")
        bits = idfilter.bitmap(ids, "rep")
        wanted = self.docs.select("doc_id", "text", idfilter.place("doc_id").alias("p")).mapInArrow(
            _chosen_sets(self.n, bits), "rep long, s array<long>")
        wanted = materialise(wanted.join(ids, "rep", "left_semi").dropDuplicates(["rep", "s"]), f"{name}-sets")
        both = near.join(wanted.select(F.col("rep").alias("a"), F.col("s").alias("x")), "a").join(
            wanted.select(F.col("rep").alias("b"), F.col("s").alias("y")), "b")
        common = F.size(F.array_intersect("x", "y"))
        union = F.size("x") + F.size("y") - common
        return materialise(both.where((100 * common >= self.percent * union) & (union > 0)).select("a", "b").distinct(),
                           f"{name}-links")

    def labels(self) -> DataFrame:
        """node, root of the representatives that link with another."""
        entries = self.entries()
        pivots, pairs = self.star(entries)
        near = self.links(pairs, "star")
        labels = components(near, "star")
        far = self.links(self.across(entries, pivots, labels), "across")
        return labels if far.isEmpty() else components(near.unionByName(far), "all")

    def inside(self, labels: DataFrame, counted: bool) -> DataFrame:
        """All links (a < b) inside the components, or their number k by rep."""
        nodes = self.reps.select("rep", "n").join(labels.select(F.col("node").alias("rep"), "root"), "rep")
        nodes = materialise(nodes.groupBy("rep", "root").agg(F.max("n").alias("n")), "linked-reps")
        sizes = nodes.groupBy("root").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("w"))
        parts = F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("w") / BLOCK_SHINGLES)).cast("int")
        sizes = materialise(sizes.select("root", "m", "w", parts.alias("parts")), "component-sizes")
        small = sizes.where("parts = 1").agg(F.sum("m").alias("m"), F.sum("w").alias("w")).first()
        buckets = max(1, -(-(small["m"] or 0) // BLOCK), -(-(small["w"] or 0) // BLOCK_SHINGLES))
        block = F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")
        dealt = materialise(nodes.join(sizes.select("root", "parts"), "root").select("rep", "root", "parts", block.alias("block")),
                            "dealt-reps")
        bits = idfilter.bitmap(dealt, "rep")
        sets = self.docs.select("doc_id", "text", idfilter.place("doc_id").alias("p")).mapInArrow(
            _chosen_sets(self.n, bits), "rep long, s array<long>").where(F.size("s") > 0)
        # one group a pair of blocks; components of one block share groups
        sets = sets.join(dealt, "rep").dropDuplicates(["rep", "s"]).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        group = F.when(F.col("parts") > 1, F.col("root")).otherwise(F.pmod(F.xxhash64("root"), F.lit(buckets)))
        sets = sets.select(group.alias("g"), (F.col("parts") > 1).alias("dense"), F.least("block", "j").alias("lo"),
                           F.greatest("block", "j").alias("hi"), "root", "block", "rep", "s")
        found = sets.groupBy("g", "dense", "lo", "hi").applyInArrow(
            _linked(self.percent, counted), "rep long, k long" if counted else "a long, b long")
        return found.groupBy("rep").agg(F.sum("k").alias("k")) if counted else found

    def documents(self, labels: DataFrame, counts: DataFrame | None = None) -> DataFrame:
        """doc_id, n_shingles, component_id and, with ``counts``, n_links of every row."""
        info = labels.select(F.col("node").alias("rep"), "root")
        if counts is not None:
            info = materialise(info.join(counts, "rep", "left"), "link-counts")
        copies = self.groups.where("k > 1").select("d1", "d2", "rep")
        rows = self.sets.select("doc_id", "n", "d1", "d2").join(copies, ["d1", "d2"], "left")
        rows = rows.withColumn("rep", F.when(F.col("n") > 0, F.coalesce("rep", "doc_id")).otherwise(F.col("doc_id")))
        rows = rows.join(info, "rep", "left")
        n_links = [] if counts is None else [F.when(F.col("n") > 0, F.coalesce("k", F.lit(0))).otherwise(0).cast("long").alias("n_links")]
        return rows.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "rep").alias("component_id"), *n_links)


def jaccard_join(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(documents, links): doc_id, n_shingles and component_id of every row of ``docs``
    (doc_id, text); and all links between representatives (a < b)."""
    with scratch(docs.sparkSession) as keep:
        j = _Join(docs, n, percent)
        labels = j.labels()
        return keep(j.documents(labels), "components"), keep(j.inside(labels, False), "links")


def linked_documents(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and n_links of every row of ``docs``: n_links is the number of
    different sets that the row's set links with (rows of equal sets are one set, and no link)."""
    with scratch(docs.sparkSession) as keep:
        j = _Join(docs, n, percent)
        labels = j.labels()
        return keep(j.documents(labels, j.inside(labels, True)), "linked-documents")


def _components(docs: DataFrame, n: int, percent: int) -> DataFrame:
    with scratch(docs.sparkSession) as keep:
        j = _Join(docs, n, percent)
        return keep(j.documents(j.labels()), "components")


def keep_first(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component; of rows that
    repeat an id with its text, one (rows without an id stay).  Different texts under one id are documents of their
    own, which link or not by their own sets.  Only rows whose id may be among those that go, or repeats, are shuffled whole
    (all, where an id stands over several texts)."""
    names = docs.columns
    docs = with_own_id(docs.select(*[F.col(c).alias(f"c_{c}") for c in names], "doc_id", "text"), "id")
    found = _components(docs.select(F.col("id").alias("doc_id"), "text"), n, percent)
    marked = found.groupBy("doc_id").agg(F.min("component_id").alias("c"), F.count(F.lit(1)).alias("k"))
    marked = materialise(marked.where("c <> doc_id or k > 1"), "copies")
    bits = idfilter.bitmap(marked, "doc_id")
    rows = docs.select(*[f"c_{c}" for c in names], "id")
    rows = rows.withColumn("hit", idfilter.hit(bits, F.coalesce("id", F.lit(0).cast("long"))))
    rest = rows.where("hit").join(marked.withColumnRenamed("doc_id", "id"), "id", "left").where("c is null or c = id")
    rest = rest.where("k is null or k = 1").unionByName(rest.where("k > 1").dropDuplicates(["id"]))
    kept = rows.where("not hit").unionByName(rest.select(*rows.columns))
    return kept.select(*[F.col(f"c_{c}").alias(c) for c in names])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_documents(read_table(spark, sf_dir, "documents"))
