"""Approximate nearest neighbours by learned partitions.

A bounded sample (``SAMPLE`` rows of the smallest hash of vec_id) is joined to a
graph of nearest neighbours, which recursive bisection cuts into parts of equal
size, about as many as the square root of the number of rows (a power of two, at
most one for each ``LEAST`` rows of the sample): each cut is at the median of the
graph's second eigenvector and then refined by swaps. A small network learns, from a vector's direction, the
parts of its neighbours. Every row of the table is indexed in its likeliest
part; a query looks through as many of its likeliest parts as reached
``RECALL`` on rows of the sample that were held out, and all it finds there is
ranked by the exact inner product of the original vectors in double precision.

Parts are split into blocks by a hash of vec_id, so that no task holds more than
``BLOCK`` rows however many rows are alike. A query's vector travels once to each
block that it looks through, so one copy is shuffled for up to ``BLOCK`` inner
products; what a query costs is the share of the table in its parts, which the
README states.

Vectors that are null, zero, of another length than most, or that hold null or
non-finite components take no part; so do rows without a vec_id. Ties go to the
smaller vec_id; repeated rows of a vec_id are one candidate, and a query is never
its own. With fewer candidates than asked for all are returned that were found.
An empty table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved

SAMPLE, LEAST, NEAR, HIDDEN = 8_000, 16, 12, 128
RECALL, BLOCK = 0.93, 20_000
EPOCHS, BATCH, RATE = 25, 256, 2e-3


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-300)


def nearest(queries: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k rows of the largest inner product, for each query."""
    out = []
    for at in range(0, len(queries), 1024):
        score = queries[at : at + 1024] @ rows.T
        out.append(np.argpartition(-score, min(k, score.shape[1] - 1), axis=1)[:, :k])
    return np.concatenate(out)


def bisected(nodes: np.ndarray, a: np.ndarray, b: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Two halves of nodes with few of the edges a-b between them."""
    n = len(nodes)
    place = np.full(int(max(nodes.max(), a.max(initial=0), b.max(initial=0))) + 1, -1)
    place[nodes] = np.arange(n)
    use = (place[a] >= 0) & (place[b] >= 0)
    a, b = place[a[use]], place[b[use]]
    degree = np.bincount(a, minlength=n) + 1.0
    root = np.sqrt(degree)
    x = np.random.default_rng(seed).standard_normal(n)
    for _ in range(80):  # power steps on the normalised adjacency, without its first eigenvector
        x -= root * (x @ root) / (root @ root)
        x /= max(np.linalg.norm(x), 1e-300)
        y = x / root
        x = 0.5 * x + 0.5 * (np.bincount(a, y[b], n) + y) / root
    side = np.zeros(n, bool)
    side[np.argsort(x / root, kind="stable")[n // 2 :]] = True
    for _ in range(10):  # swap the nodes that gain most, as many from each side
        same = np.bincount(a, side[a] == side[b], n)
        gain = np.bincount(a, minlength=n) - 2 * same
        left, right = (np.flatnonzero((side == s) & (gain > 0)) for s in (False, True))
        m = min(len(left), len(right)) // 2
        if not m:
            break
        side[left[np.argsort(-gain[left], kind="stable")[:m]]] = True
        side[right[np.argsort(-gain[right], kind="stable")[:m]]] = False
    return nodes[~side], nodes[side]


def balanced_parts(near: np.ndarray, parts: int) -> np.ndarray:
    """The part of each node of a neighbour graph (rows of neighbours); parts is a power of two."""
    n = len(near)
    a = np.repeat(np.arange(n), near.shape[1])
    a, b = np.concatenate([a, near.ravel()]), np.concatenate([near.ravel(), a])
    groups = [np.arange(n)]
    while len(groups) < parts:
        groups = [half for k, g in enumerate(groups) for half in (bisected(g, a, b, len(groups) + k) if len(g) > 1 else (g, g[:0]))]
    out = np.zeros(n, np.int64)
    for k, g in enumerate(groups):
        out[g] = k
    return out


@dataclass
class Router:
    """A network of one hidden layer from a direction to parts."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int = 1

    @property
    def length(self) -> int:
        return self.w1.shape[0]

    def scores(self, vectors: np.ndarray) -> np.ndarray:
        return np.maximum(unit(vectors) @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def likeliest(self, vectors: np.ndarray, n: int) -> np.ndarray:
        return np.argsort(-self.scores(vectors), axis=1, kind="stable")[:, :n]


def fit_router(x: np.ndarray, target: np.ndarray, seed: int = 7) -> Router:
    """Cross-entropy by Adam; target: a distribution over parts for each row of x."""
    rng = np.random.default_rng(seed)
    d, parts = x.shape[1], target.shape[1]
    p = [rng.standard_normal((d, HIDDEN)) * np.sqrt(2 / d), np.zeros(HIDDEN), rng.standard_normal((HIDDEN, parts)) * np.sqrt(1 / HIDDEN), np.zeros(parts)]
    p[0] *= np.sqrt(d)  # directions have components of about 1 / sqrt(d)
    m, v, step = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p], 0
    x = unit(x)
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for at in range(0, len(x), BATCH):
            rows = order[at : at + BATCH]
            h = np.maximum(x[rows] @ p[0] + p[1], 0)
            z = h @ p[2] + p[3]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            g = (z / z.sum(axis=1, keepdims=True) - target[rows]) / len(rows)
            gh = (g @ p[2].T) * (h > 0)
            step += 1
            for k, grad in enumerate((x[rows].T @ gh, gh.sum(axis=0), h.T @ g, g.sum(axis=0))):
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad * grad
                p[k] -= RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return Router(*p)


def parts_for(rows: int) -> int:
    """The power of two next to the square root of the number of rows."""
    return 1 << max(0, round(np.log2(max(rows, 1)) / 2))


def fit(sample: np.ndarray, parts: int, recall: float = RECALL, k: int = 20) -> Router:
    """Parts, network and number of probes from a sample of vectors."""
    directions = unit(sample)
    while parts > 1 and parts * LEAST > len(sample):
        parts //= 2
    near = nearest(directions, directions, min(NEAR + 1, len(sample)))  # a row is among its own neighbours
    part = balanced_parts(near, parts)
    rest = np.arange(len(sample)) % 5 == 0
    fitted = np.flatnonzero(~rest) if (~rest).any() else np.arange(len(sample))
    target = np.zeros((len(sample), parts))
    np.add.at(target, (np.repeat(np.arange(len(sample)), near.shape[1]), part[near].ravel()), 1 / near.shape[1])
    router = fit_router(sample[fitted], target[fitted])
    held = np.flatnonzero(rest)
    home = router.likeliest(sample, 1)[:, 0]
    score = sample[held] @ sample.T
    score[np.arange(len(held)), held] = -np.inf
    best = np.argsort(-score, axis=1)[:, : min(k, len(sample) - 1)]
    order = router.likeliest(sample[held], parts)
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(parts)[None, :].repeat(len(held), 0), axis=1)
    needed = np.sort(np.take_along_axis(rank, home[best], axis=1).ravel())  # the probe that finds each true neighbour
    router.probes = int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) + 1 if len(needed) else parts
    return router


def valid(table: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """vec_id and vector (array of double) of the rows that take part."""
    v = F.col("vector")
    rows = table.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("vector"))
    fine = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = rows.where(F.col("vec_id").isNotNull() & v.isNotNull()).where(fine)
    length = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("vector") == (length["n"] if length else 0))


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(len(column), -1)


def build_index(rows: DataFrame, parts: int | None = None, recall: float = RECALL) -> tuple[DataFrame, Router | None]:
    """The index (part, vec_id, vector) of all rows, in the shared folder, and its router; rows as ``valid`` gives them."""
    rows = saved(rows, "neighbours-rows")
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()
    if not sample.num_rows:
        return rows.select(F.lit(0).alias("part"), "vec_id", "vector"), None
    router = fit(_matrix(sample["vector"]), parts or parts_for(rows.count()), recall)
    sent = rows.sparkSession.sparkContext.broadcast(router)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                part = sent.value.likeliest(_matrix(batch["vector"]), 1)[:, 0].astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(part), batch["vec_id"], batch["vector"]], names=["part", "vec_id", "vector"])

    return saved(rows.mapInArrow(place, "part int, vec_id long, vector array<double>"), "neighbours-index"), router


def _ranked(ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """The k best of candidates: largest score, then smallest id, each id once."""
    order = np.lexsort((ids, -score))
    _, first = np.unique(ids[order], return_index=True)
    return order[np.sort(first)[:k]]


def search(index: DataFrame, router: Router | None, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found for rows vec_id, vector of queries.

    A query goes down its ranking for the router's number of probes, and on until
    the parts hold k others besides.
    """
    spark = index.sparkSession
    out = "query_id long, vec_id long, score double"
    if router is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sent = spark.sparkContext.broadcast(router)
    blocks = {r.part: -(-r["count"] // BLOCK) for r in index.groupBy("part").count().collect()}  # one row for each part
    ids = index.groupBy("vec_id").agg(F.min("part").alias("part")).groupBy("part").count().collect()  # an id in several parts counts in one
    held_ids = np.zeros(sent.value.b2.shape[0], np.int64)
    held_ids[[r.part for r in ids]] = [r["count"] for r in ids]
    of = F.create_map(*[F.lit(x) for pair in blocks.items() for x in pair])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                parts = sent.value.likeliest(_matrix(batch["vector"]), len(held_ids))
                short = np.cumsum(held_ids[parts], axis=1) - held_ids[parts] <= k  # the parts before hold fewer than k and the query
                probed = short | (np.arange(len(held_ids)) < sent.value.probes)
                at = pa.array(np.nonzero(probed)[0])
                yield pa.RecordBatch.from_arrays([pa.array(parts[probed].astype(np.int32)), batch["vec_id"].take(at), batch["vector"].take(at)], names=["part", "vec_id", "vector"])

    def scan(asked: pa.Table, held: pa.Table) -> pa.Table:
        found: list[list] = [[], [], []]
        if asked.num_rows and held.num_rows:
            q, x = _matrix(asked["vector"]), _matrix(held["vector"])
            q_ids, ids = asked["vec_id"].to_numpy(), held["vec_id"].to_numpy()
            for at in range(0, len(q), 256):
                score = q[at : at + 256] @ x.T
                slack = 1e-9 * np.maximum(1, np.abs(score).max(axis=1))
                for i, row in enumerate(score):
                    row[ids == q_ids[at + i]] = -np.inf
                    kth = np.partition(row, -k)[-k] if len(row) > k else -np.inf
                    near = np.flatnonzero((row >= kth - slack[i]) & (row > -np.inf))
                    if len(np.unique(ids[near])) < min(k, len(np.unique(ids[row > -np.inf]))):  # repeats took places
                        near = np.flatnonzero(row > -np.inf)
                    exact = (x[near] * q[at + i]).sum(axis=1)
                    best = _ranked(ids[near], exact, k)
                    for c, v in zip(found, (np.full(len(best), q_ids[at + i]), ids[near[best]], exact[best])):
                        c.append(v)
        cols = [np.concatenate(c) if c else np.zeros(0) for c in found]
        return pa.table({"query_id": pa.array(cols[0].astype(np.int64)), "vec_id": pa.array(cols[1].astype(np.int64)), "score": pa.array(cols[2].astype(np.float64))})

    salted = index.withColumn("block", F.pmod(F.xxhash64("vec_id"), of[F.col("part")]))
    asked = queries.dropDuplicates(["vec_id"]).mapInArrow(route, "part int, vec_id long, vector array<double>").where(of[F.col("part")].isNotNull())
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), (of[F.col("part")] - 1).cast("long"))))
    found = asked.groupBy("part", "block").cogroup(salted.groupBy("part", "block")).applyInArrow(scan, out)
    # an id's repeats may hold other vectors; the best counts
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = valid(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
    index, router = build_index(rows)
    return search(index, router, index.where(F.pmod("vec_id", F.lit(20)) == 0), 20)


SQL: dict[str, str] = {}
