"""Operator 6: nearest neighbours by multi-index hashing.

A rotation learned on a bounded sample (principal axes, then iterative quantisation) turns each
vector into a code of ``BITS`` bits. Codes are split into ``PARTS`` substrings, each with an index of
its own. Two codes that differ in at most R bits differ in at most R / PARTS bits in some substring,
so probing every index with that smaller radius retrieves every code within R; the candidates are then
reranked by the distance of their original vectors.

R is learned too: the sample's own nearest neighbours lie within it but for ``MISS`` of them. More
rows only bring neighbours nearer, so the whole table's lie within it at least as often. A query with
fewer than k candidates within R is searched again with R = BITS, which is exact.

Queries go out in blocks of ``BLOCK``, so what is broadcast has a fixed size; every task indexes its
own rows and returns k rows a query, which meet in one window over the query.

Defined results: a vector that is null or zero, has null or non-finite components, or another number
of components than most, takes no part, as query or candidate; ties go to the smaller id; copies of
the query's vector under other ids are neighbours at distance 0; rows repeated with one id are one
neighbour; fewer than k candidates are all returned; an empty table gives no rows; further columns, of
whatever name, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, smallest, table

BITS, PARTS = 64, 4
SAMPLE = 4_000
MISS = 0.03
BLOCK = 8_192
ROWS = 20_000  # indexed together in a task
OUT = "query_id long, vec_id long, score double"


def valid(vectors: list, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(which of the vectors take part, their components)."""
    good = np.array([v is not None and len(v) == dim for v in vectors], bool)
    x = np.array([v for v, g in zip(vectors, good) if g], object if not good.any() else float).reshape(-1, dim).astype(float)
    fine = np.isfinite(x).all(1) & (x != 0).any(1)
    good[good] = fine
    return good, x[fine]


def columns(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a batch that take part."""
    batch = batch.filter(pa.array(np.array(pa.compute.list_value_length(batch.column(1)).fill_null(-1)) == dim))
    batch = batch.filter(pa.compute.is_valid(batch.column(0)))
    x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)
    fine = np.isfinite(x).all(1) & (x != 0).any(1)
    return batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)[fine], x[fine]


class Coder:
    """Codes by the signs of rotated vectors."""

    def __init__(self, x: np.ndarray, bits: int = BITS, rounds: int = 40):
        rng = np.random.default_rng(7)
        self.mean = x.mean(0)
        centred = x - self.mean
        axes = np.linalg.svd(centred, full_matrices=False)[2][:bits]
        blocks, have = [], 0
        while have < bits:  # fewer components than bits: further rotations of them
            v = centred @ axes.T
            r = np.linalg.qr(rng.normal(size=(axes.shape[0],) * 2))[0]
            for _ in range(rounds):
                u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
                r = (u @ w).T
            blocks.append(axes.T @ r)
            have += axes.shape[0]
        self.matrix = np.concatenate(blocks, 1)[:, :bits]

    def codes(self, x: np.ndarray) -> np.ndarray:
        bits = (x - self.mean) @ self.matrix >= 0
        return np.packbits(bits, axis=1).view(np.uint64)[:, 0] if len(x) else np.empty(0, np.uint64)


class Index:
    """Rows of one task: for each substring, the rows in the order of its values."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, codes: np.ndarray):
        self.ids, self.x, self.codes = ids, x, codes
        self.norm = (x * x).sum(1)
        self.tables = []
        for part in codes.view(np.uint16).reshape(-1, PARTS).T:
            order = np.argsort(part, kind="stable")
            values, start = np.unique(part[order], return_index=True)
            self.tables.append((values, np.append(start, len(order)), order))

    def within(self, code: np.uint64, radius: int) -> np.ndarray:
        """Rows whose codes differ from ``code`` in at most ``radius`` bits."""
        hit = np.zeros(len(self.codes), bool)
        for (values, start, order), own in zip(self.tables, np.array([code]).view(np.uint16)):
            near = np.flatnonzero(np.bitwise_count(values ^ own) <= radius // PARTS)
            begin, size = start[near], start[near + 1] - start[near]
            at = np.arange(size.sum()) + np.repeat(begin - (np.cumsum(size) - size), size)
            hit[order[at]] = True
        rows = np.flatnonzero(hit)
        return rows[np.bitwise_count(self.codes[rows] ^ code) <= radius]

    def nearest(self, own: int, q: np.ndarray, code: np.uint64, radius: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, distances) of the k nearest candidates, ties to the smaller id."""
        rows = self.within(code, radius)
        rows = rows[self.ids[rows] != own]
        if len(rows) > k:
            d = self.norm[rows] - 2 * (self.x[rows] @ q)
            slack = 1e-9 * (1 + float(q @ q) + float(self.norm[rows].max()))
            # the k-th nearest of distinct ids: rows of one id, which needn't be equal, count once
            by = np.lexsort((d, self.ids[rows]))
            named = self.ids[rows][by]
            nearest = d[by][np.append(True, named[1:] != named[:-1])]
            if len(nearest) > k:
                rows = rows[d <= np.partition(nearest, k - 1)[k - 1] + slack]
        d = np.sqrt(((self.x[rows] - q) ** 2).sum(1))
        near = np.lexsort((d, self.ids[rows]))
        rows, d = rows[near], d[near]
        ids, first = np.unique(self.ids[rows], return_index=True)
        order = np.lexsort((ids, d[first]))[:k]
        return ids[order], d[first][order]


def learn(vectors: DataFrame, dim: int, k: int) -> tuple[Coder, int] | None:
    """Rotation and radius from the ``SAMPLE`` rows with the smallest hash of the id."""
    rows = smallest(vectors.withColumn("all", F.lit(0)), "all", "vec_id", SAMPLE).orderBy(F.xxhash64("vec_id"), "vec_id").collect()
    _, x = valid([r["embedding"] for r in rows], dim)
    if len(x) < 2:
        return None
    coder = Coder(x)
    codes = coder.codes(x)
    probes = np.arange(0, len(x), max(1, len(x) // 200))
    d = (x * x).sum(1)[None] - 2 * x[probes] @ x.T
    d[np.arange(len(probes)), probes] = np.inf
    near = np.argsort(d, 1)[:, : min(k, len(x) - 1)]
    bits = np.sort(np.bitwise_count(codes[probes][:, None] ^ codes[near]).ravel())
    return coder, int(bits[min(len(bits) - 1, int(np.ceil((1 - MISS) * len(bits))))])


def probe(vectors: DataFrame, queries: list, coder: Coder, radius: int, dim: int, k: int) -> DataFrame:
    """k rows a query and task: query_id, vec_id, score."""
    ids = np.array([r["vec_id"] for r in queries], np.int64)
    good, x = valid([r["embedding"] for r in queries], dim)
    shared = vectors.sparkSession.sparkContext.broadcast((ids[good], x, coder.codes(x)))  # BLOCK rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, q, q_codes = shared.value

        def search(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            ids, x = (np.concatenate(c) for c in zip(*held))
            index = Index(ids, x, coder.codes(x))
            found = [index.nearest(*one, radius, k) for one in zip(q_ids, q, q_codes)]
            size = [len(i) for i, _ in found]
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids, size)), pa.array(np.concatenate([i for i, _ in found])), pa.array(np.concatenate([d for _, d in found]))], ["query_id", "vec_id", "score"])

        held, n = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                held.append(columns(batch.slice(at, ROWS), dim))
                n += len(held[-1][0])
                if n >= ROWS:
                    yield search(held)
                    held, n = [], 0
        if n and len(q_ids):
            yield search(held)

    return vectors.mapInArrow(run, OUT) if len(x) else vectors.sparkSession.createDataFrame([], OUT)


def best(hits: DataFrame, k: int) -> DataFrame:
    """Ranks; a row of one id in several tasks counts once."""
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    once = hits.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(vectors: DataFrame, is_query: Column, k: int = 10, exact: bool = False) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of every row for which ``is_query`` holds;
    ``exact`` probes within R = BITS, so that none is missed."""
    spark = vectors.sparkSession
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    sizes = vectors.where("embedding is not null").groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if sizes:  # the others take no part, and are left out of the sample too
        bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        vectors = vectors.where((F.size("embedding") == sizes["dim"]) & ~bad & F.exists("embedding", lambda x: x != 0))
    learned = sizes and sizes["dim"] and learn(vectors, sizes["dim"], k)
    if not learned:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, (coder, radius) = sizes["dim"], learned
    radius = BITS if exact else radius
    queries = vectors.where(is_query).groupBy("vec_id").agg(F.min_by("embedding", F.xxhash64("embedding")).alias("embedding"))
    blocks = -(-queries.count() // (BLOCK // 2)) or 1  # dealt by a hash: half full on average
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks))
    found = None
    for b in range(blocks):
        part = probe(vectors, queries.where(block == b).collect(), coder, radius, dim, k)
        found = part if found is None else found.unionByName(part)
    hits = materialise(best(found, k), "neighbours")
    short = queries.join(hits.groupBy("query_id").count().where(F.col("count") >= k), F.col("vec_id") == F.col("query_id"), "left_anti").select("vec_id", "embedding")
    rest = short.collect() if short.count() <= BLOCK else None
    if rest is None:  # far queries by the thousand: again in blocks
        n = -(-short.count() // (BLOCK // 2))
        again = None
        for b in range(n):
            part = probe(vectors, short.where(F.pmod(F.xxhash64("vec_id"), F.lit(n)) == b).collect(), coder, BITS, dim, k)
            again = part if again is None else again.unionByName(part)
    else:
        again = probe(vectors, rest, coder, BITS, dim, k)
    enough = hits.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").select("query_id", "rank", "vec_id", "score")
    return enough.unionByName(best(again, k))


def op6_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
