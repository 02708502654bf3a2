"""Exact top-k by inner product with two cover trees.

Vectors are integers floor(64 x).  Data and queries are dealt by a hash of the id into blocks of
about ``DATA_BLOCK`` and ``QUERY_BLOCK`` rows, and every pair of blocks is one group: both
blocks are indexed as cover trees, and pairs of nodes are searched together, best bound first.
For nodes with centres q, p and covering radii r, s no product exceeds

    <q, p> + |q| s + |p| r + r s;

a pair of nodes whose bound lies below the worst k-th score of the query node's
queries is pruned.  The k best of each block are merged by a top-k window per query.

Cases: null vectors, vectors with a null or non-finite component and null ids take no part; vectors
of different length are never compared; rows that repeat an id with its vector count as one, different vectors under
one id are rows of their own, each a query and each a candidate; ties go to the
smaller id; fewer than k candidates give them all; products are exact at any size of the components, and a
score beyond a long is given as the nearest one, and ranked by its double; other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from cyclewise.llm.common import materialise, read_table

K = 20
EVERY = 20
DATA_BLOCK, QUERY_BLOCK = 8192, 2048
FAN, LEAF = 16, 512


class Node:
    """A cover-tree node: its rows, centre, covering radius and children."""
    __slots__ = ("rows", "centre", "norm", "radius", "children")

    def __init__(self, v: np.ndarray, rows: np.ndarray, centre: int):
        self.rows, self.centre = rows, v[centre]
        self.norm = float(np.linalg.norm(self.centre))
        far = np.linalg.norm(v[rows] - self.centre, axis=1)
        self.radius = float(far.max()) * (1 + 1e-12)
        self.children: list[Node] = []
        if len(rows) <= LEAF or self.radius == 0:
            return
        # farthest-first centres, until half the radius covers all or FAN are found
        centres, near, label = [centre], far, np.zeros(len(rows), np.int64)
        while len(centres) < FAN and near.max() > self.radius / 2:
            centres.append(int(rows[near.argmax()]))
            d = np.linalg.norm(v[rows] - v[centres[-1]], axis=1)
            label[d < near] = len(centres) - 1
            near = np.minimum(near, d)
        for k, c in enumerate(centres):
            part = rows[label == k]
            if len(part):
                self.children.append(Node(v, part, c))


def tree(v: np.ndarray) -> Node:
    return Node(v, np.arange(len(v)), 0)


class Search:
    """The k best data rows of each query row of one pair of blocks, in ``score``
    and ``vec_id`` (row by row; ``found`` tells which are filled).

    Data rows stand in the order of their ids, so score * M - place, with M over the number of
    rows, orders rows by score and then by id in one number; ``best`` holds the k greatest."""

    def __init__(self, q: np.ndarray, q_ids: np.ndarray, v: np.ndarray, ids: np.ndarray, k: int):
        order = np.argsort(ids, kind="stable")
        self.q, self.q_ids, self.v, self.ids, self.k = q, q_ids, v[order], ids[order], k
        self.m = 1 << max(1, len(ids)).bit_length()
        # the largest sum of products; beyond the exact integers of a double the numbers are Python's
        self.top = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * max(q.shape[1], 1)
        self.exact = self.top * self.m < 2.0**52
        self.best = np.full((len(q), k), -np.inf, dtype=np.float64 if self.exact else object)
        if len(q) and len(v):
            self.run(tree(q), tree(self.v))
        self.found = self.best != -np.inf
        key = np.where(self.found, self.best, 0)
        key = key.astype(np.int64) if self.exact else key
        score = -(-key // self.m)
        place = (score * self.m - key).astype(np.int64)
        # ordered by ``approx``, then ``score``: doubles rise with the exact numbers
        most = 2.0**1000
        self.approx = score.astype(np.float64) if self.exact else np.vectorize(
            lambda x: float(min(max(x, -int(most)), int(most))), otypes=[float])(score)
        self.score = score if self.exact else np.clip(score, -2**63, 2**63 - 1).astype(np.int64)
        self.vec_id = self.ids[place] if len(v) else np.zeros(key.shape, np.int64)

    def bound(self, a: Node, b: Node) -> float:
        x = float(a.centre @ b.centre) + a.norm * b.radius + b.norm * a.radius + a.radius * b.radius
        return x + 1e-9 * abs(x) + 1e-6

    def run(self, a: Node, b: Node) -> None:
        """Pairs of nodes, greatest bound first; the wider node of a pair is opened."""
        heap, n = [(-self.bound(a, b), 0, a, b)], 0
        while heap:
            bound, _, a, b = heapq.heappop(heap)
            if (-bound + 1) * self.m < self.best[a.rows].min():
                continue
            if not a.children and not b.children:
                self.leaves(a.rows, b.rows)
                continue
            open_data = b.children and (not a.children or b.radius >= a.radius)
            for x, y in [(a, c) for c in b.children] if open_data else [(c, b) for c in a.children]:
                n += 1
                heapq.heappush(heap, (-self.bound(x, y), n, x, y))

    def leaves(self, a: np.ndarray, b: np.ndarray) -> None:
        if self.exact:
            key = (self.q[a] @ self.v[b].T) * self.m - b
        elif self.top < 2.0**62:
            key = (self.q[a].astype(np.int64) @ self.v[b].T.astype(np.int64)).astype(object) * self.m - b
        else:
            whole = np.vectorize(int, otypes=[object])
            key = whole(self.q[a]).dot(whole(self.v[b]).T) * self.m - b
        # a query's own row: the same id and the same vector
        for i, j in np.argwhere(self.q_ids[a][:, None] == self.ids[b][None, :]).tolist():
            if np.array_equal(self.q[a[i]], self.v[b[j]]):
                key[i, j] = -np.inf
        key = np.concatenate([self.best[a], key], axis=1)
        key = np.partition(key, key.shape[1] - self.k, axis=1) if self.exact else np.sort(key, axis=1)
        self.best[a] = key[:, -self.k:]


def _encoded(batches):
    """Vectors as bytes of whole doubles."""
    for batch in batches:
        rows = []
        for vec_id, x in zip(batch.column(0), batch.column(1)):
            x = np.floor(64 * np.asarray(x.values.to_numpy(zero_copy_only=False), np.float64))
            if np.isfinite(x).all():
                rows.append((vec_id.as_py(), len(x), (x + 0.0).astype("<f8").tobytes()))
        if rows:
            a, b, c = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int32()), pa.array(c, pa.binary())],
                                             names=["vec_id", "dim", "v"])


def _matrix(p: pd.DataFrame) -> np.ndarray:
    dim = int(p["dim"].iloc[0])
    return np.frombuffer(b"".join(p["v"]), "<f8").reshape(len(p), dim)


def _searched(k: int):
    def run(queries: pd.DataFrame, data: pd.DataFrame) -> pd.DataFrame:
        names = ["query_id", "query", "vec_id", "score"]
        if not len(queries) or not len(data):
            return pd.DataFrame({c: np.zeros(0, np.int64) for c in names} | {"approx": np.zeros(0)})
        q_ids, asked = queries["vec_id"].to_numpy(), queries["h"].to_numpy()
        s = Search(_matrix(queries), q_ids, _matrix(data), data["vec_id"].to_numpy(), k)
        return pd.DataFrame({"query_id": np.broadcast_to(q_ids[:, None], s.found.shape)[s.found],
                             "query": np.broadcast_to(asked[:, None], s.found.shape)[s.found],
                             "vec_id": s.vec_id[s.found], "score": s.score[s.found], "approx": s.approx[s.found]})
    return run


def top_k(vectors: DataFrame, queries, key: str = "vec_id", vector: str = "embedding", k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: for the rows of ``vectors`` that the condition
    ``queries`` on ``vec_id`` picks, the k best other rows."""
    v = F.col(vector).cast("array<double>")
    bad = F.exists("x", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), v.alias("x"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull()).where(~F.coalesce(bad, F.lit(True)))
    rows = rows.mapInArrow(_encoded, "vec_id long, dim int, v binary")
    rows = materialise(rows.distinct().withColumn("h", F.xxhash64("v")), "vectors")
    asked = rows.where(queries)
    n = rows.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(queries, 1)).alias("q")).first()
    data_blocks, query_blocks = -(-n["n"] // DATA_BLOCK) or 1, -(-n["q"] // QUERY_BLOCK) or 1
    h = F.xxhash64("vec_id")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    a = asked.withColumn("qb", F.pmod(h, F.lit(query_blocks)).cast("int")).withColumn("db", every(data_blocks))
    b = rows.withColumn("db", F.pmod(h, F.lit(data_blocks)).cast("int")).withColumn("qb", every(query_blocks))
    group = ["dim", "qb", "db"]
    best = a.groupBy(*group).cogroup(b.groupBy(*group)).applyInPandas(
        _searched(k), "query_id long, query long, vec_id long, score long, approx double")
    w = W.partitionBy("query_id", "query").orderBy(F.desc("approx"), F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read_table(spark, sf_dir, "embeddings"), F.expr(f"vec_id % {EVERY} = 0"))


ORACLE_SQL = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v
           FROM embeddings WHERE embedding IS NOT NULL),
s AS (SELECT q.vec_id AS query_id, d.vec_id, CAST(list_dot_product(q.v, d.v) AS BIGINT) AS score
      FROM v q JOIN v d ON q.vec_id % {EVERY} = 0 AND d.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= {K}
"""
