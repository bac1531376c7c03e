"""Shared pieces of the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds)).cast("int")


#: DuckDB: the same checksum of the ASCII text ``{x}``.
CRC_SQL = """list_reduce(list_transform(range(1, length({x}) + 1), lambda i: CAST(ascii(substr({x}, i, 1)) AS BIGINT)), lambda c, b:
  list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, xor(c, b)), 4294967295)"""
CRC_SQL = f"xor({CRC_SQL}, 4294967295)"


def scratch_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where none is set, in local mode, as in tests."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="spark-tidewright-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", shared)
    return shared


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back: later passes start from the
    files, whichever executors have gone meanwhile."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def smallest(rows: DataFrame, group: str, key: str, n: int) -> DataFrame:
    """The ``n`` rows a group with the smallest hash of the key. A histogram of the hash's upper bits
    says where to cut, so the window that ranks them gets little more than ``n`` rows a group."""
    bits = F.shiftrightunsigned(F.xxhash64(key), 1)
    part = F.shiftright(bits, 51).cast("int")  # 4096 parts
    seen: dict = {}
    for r in rows.groupBy(group, part.alias("part")).count().collect():  # parts a group
        seen.setdefault(r[0], []).append((r["part"], r["count"]))
    cuts = []
    for g, parts in seen.items():
        left = n
        for k, count in sorted(parts):
            left -= count
            if left <= 0:
                break
        cuts.append((g, k))
    if not cuts:
        return rows.limit(0)
    cut = rows.sparkSession.createDataFrame(cuts, f"{group} {rows.schema[group].dataType.simpleString()}, cut int")
    by = Window.partitionBy(group).orderBy(bits, key)
    near = rows.join(F.broadcast(cut), group).where(part <= F.col("cut")).drop("cut")
    return near.withColumn("nth", F.row_number().over(by)).where(F.col("nth") <= n).drop("nth")


def slices(batches: Iterable[pa.RecordBatch], max_bytes: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Batches cut so that one slice holds about ``max_bytes``, or a single larger row. Workers serve
    many tasks; after the last slice the memory of this one goes back to the system."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        step = max(1, min(n, int(n * max_bytes / max(1, batch.nbytes))))
        for at in range(0, n, step):
            yield batch.slice(at, step)
    release()


def release() -> None:
    """Give unused memory of this process back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


STEP = np.uint64(0x9E3779B97F4A7C15)  # an odd number, so that its powers have inverses
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def distinct_spans(a: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of spans that cover the bytes ``a`` or parts of them: (number of its distinct content, by
    span; the first span with it, by distinct content). Grouped by a rolling hash; all bytes are then
    compared, so equal numbers do mean equal bytes."""
    import pandas as pd

    n = len(a)
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    if len(_POWERS[0]) <= n:
        inverse = np.uint64(pow(int(STEP), -1, 1 << 64))
        _POWERS[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, x)])) for x in (STEP, inverse)]
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((a.astype(np.uint64) + np.uint64(1)) * _POWERS[0][:n], out=sums[1:])
    keys = (sums[starts + lengths] - sums[starts]) * _POWERS[1][starts] + lengths.astype(np.uint64)
    codes, _ = pd.factorize(keys)
    first = np.full(codes.max() + 1, -1, np.int64)
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    own, other = starts, starts[first[codes]]
    at = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    if not np.array_equal(lengths, lengths[first[codes]]) or not np.array_equal(a[np.repeat(own, lengths) + at], a[np.repeat(other, lengths) + at]):
        return np.arange(len(starts)), np.arange(len(starts))  # a collision: nothing is grouped
    return codes, first


def span_hashes(a: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of the bytes ``a``."""
    n = len(a)
    if len(_POWERS[0]) <= n:
        distinct_spans(a, np.zeros(1, np.int64), np.ones(1, np.int64))  # lengthens the powers
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((a.astype(np.uint64) + np.uint64(1)) * _POWERS[0][:n], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * _POWERS[1][starts] + (ends - starts).astype(np.uint64))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))
