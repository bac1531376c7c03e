"""Operator 7: packing of token pieces into sequences by dominance reduction and best fit.

Sizes are whole numbers up to the sequence length, so the instance is its histogram: how many
pieces there are of each size. The histogram has at most ``capacity`` rows whatever the corpus, and
only it reaches the driver. Martello and Toth's dominance criterion fixes small sets that some best
packing must hold, in all their copies at once; best fit decreasing packs what is left. The outcome
is a list of bin patterns with multiplicities. Each piece finds its bin by its rank among the pieces
of its size; ranks are taken in salted groups, so a frequent size spreads over many tasks.

Defined results: a null or empty text is one piece, the closing id alone; a very long text is cut into
full pieces after the remainder; repeated rows are pieces of their own; pieces of one size, which any
packing may exchange, are ranked by doc_id, piece and checksum; an empty table gives no rows; further
columns of the input, of whatever name, are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import Encoder, mapped
from .common import materialise, table

CAPACITY = 2048
END = b"\0\0\0\0"
Pattern = tuple[tuple[int, int], ...]  # (size, how many) in the order of their places


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and a closing 0, cut only if they
    exceed ``capacity``; the first piece takes the remainder."""

    def rows(doc_id: pa.Array, encoded: list[bytes], enc: Encoder) -> pa.RecordBatch:
        row, piece, start, length, crc = [], [], [], [], []
        for i, ids in enumerate(encoded):
            ids += END
            n, at = len(ids) // 4, 0
            cut = (n - 1) % capacity + 1
            for k in range((n - 1) // capacity + 1):
                row.append(i), piece.append(k), start.append(at), length.append(cut - at)
                crc.append(zlib.crc32(ids[4 * at : 4 * cut]))
                at, cut = cut, cut + capacity
        return pa.RecordBatch.from_arrays([doc_id.take(pa.array(row, pa.int32())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return mapped(docs, path, rows, "piece int, start long, length long, ids_crc32 long")


def best_pair(sizes: np.ndarray, counts: np.ndarray, room: int) -> int:
    """The largest sum up to ``room`` of two items of the given sizes, or 0."""
    most, high = 0, len(sizes) - 1
    for low, a in enumerate(sizes.tolist()):
        while high > low and a + sizes[high] > room:
            high -= 1
        if high > low:
            most = max(most, a + int(sizes[high]))
        if 2 * a <= room and counts[a] > 1:
            most = max(most, 2 * a)
    return most


def companions(others: np.ndarray, room: int) -> list[int] | None:
    """The items that go with one that leaves ``room``, if their set dominates: the items of any other
    set that fits can be dealt to the members of this one so that none gets more than its own size."""
    sizes = np.flatnonzero(others[: room + 1])
    if not len(sizes):
        return []
    a = int(sizes[-1])
    least = [int(s) for s in sizes[:3] for _ in range(min(3, int(others[s])))][:3]
    if a == room or len(least) < 2 or least[0] + least[1] > room:
        return [a]
    if len(least) == 3 and sum(least) <= room:
        return None  # sets of four and more aren't looked at
    if a >= best_pair(sizes, others, room):
        return [a]
    second = [s for s in sizes[sizes <= room - a].tolist() if others[s] > (s == a)]
    if second and a >= best_pair(sizes[sizes > second[-1]], others, room):
        return [a, second[-1]]
    return None


def reduce_instance(left: np.ndarray, capacity: int) -> list[tuple[Pattern, int]]:
    """For each item, the largest first: the set of up to three that dominates all others with it, if
    there is one, fixed in as many copies as there are and taken out of ``left`` (counts by size)."""
    fixed: list[tuple[Pattern, int]] = []
    for j in range(capacity, 0, -1):
        while left[j]:
            left[j] -= 1  # the other items
            found = companions(left, capacity - j)
            left[j] += 1
            if found is None:
                break
            need = Counter([j, *found])
            copies = min(int(left[s]) // n for s, n in need.items())  # what is proven stays so as items go
            fixed.append((tuple(sorted(need.items(), reverse=True)), copies))
            for s, n in need.items():
                left[s] -= n * copies
    return fixed


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[Pattern, int]]:
    """Best fit decreasing over counts: bins with one content are handled together."""
    open_bins: dict[int, list[tuple[Pattern, int]]] = {}
    for s in range(capacity, 0, -1):
        n = int(left[s])
        left[s] = 0
        for room in sorted(r for r in open_bins if r >= s):
            if not n:
                break
            each, groups = room // s, open_bins.pop(room)
            while groups and n:
                pattern, bins = groups.pop()
                full = min(bins, n // each)
                n -= full * each
                if full:
                    open_bins.setdefault(room - each * s, []).append(((*pattern, (s, each)), full))
                if full < bins and n:  # fewer than `each` are left
                    open_bins.setdefault(room - n * s, []).append(((*pattern, (s, n)), 1))
                    full, n = full + 1, 0
                if full < bins:
                    groups.append((pattern, bins - full))
            if groups:
                open_bins.setdefault(room, []).extend(groups)
        each = capacity // s
        if full := n // each:
            open_bins.setdefault(capacity - each * s, []).append((((s, each),), full))
        if rest := n % each:
            open_bins.setdefault(capacity - rest * s, []).append((((s, rest),), 1))
    return [g for groups in open_bins.values() for g in groups]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (size, first rank, first sequence, how many a sequence, offset), by size and rank."""
    left = np.zeros(capacity + 1, np.int64)
    for size, n in histogram.items():
        left[size] = n
    rows, used, sequence = [], np.zeros(capacity + 1, np.int64), 0
    fixed = reduce_instance(left, capacity)
    for pattern, bins in fixed + best_fit(left, capacity):
        at = 0
        for size, each in pattern:
            rows.append((size, used[size], sequence, each, at))
            used[size] += each * bins
            at += size * each
        sequence += bins
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to rows with a ``length`` of 1 to ``capacity``. ``cut`` is read
    twice, so it should be a table that has been written."""
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # one row a size
    rows = plan(histogram, capacity)
    salt = max(16, sum(histogram.values()) // 1_000_000)
    shift = 1 << 40
    keys = rows[:, 0] * shift + rows[:, 1]

    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salt)).cast("int"))
    before = salted.groupBy("length", "salt").count().select("length", "salt", (F.sum("count").over(Window.partitionBy("length").orderBy("salt")) - F.col("count")).alias("before"))
    ranked = salted.withColumn("nth", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1).join(before, ["length", "salt"])
    ranked = ranked.select(*cut.columns, (F.col("before") + F.col("nth")).alias("rank"))
    names = [*cut.columns, "sequence_id", "offset"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            size, first, sequence, each, at = rows[np.searchsorted(keys, length * shift + rank, "right") - 1].T
            nth = rank - first
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names[:-2]), pa.array(sequence + nth // each), pa.array(at + nth % each * size)], names)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema)
    return ranked.mapInArrow(place, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    return pack(materialise(pieces(docs, path, capacity), "pieces"), capacity)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
