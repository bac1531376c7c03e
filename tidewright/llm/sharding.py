"""Operator 1: sharding by a k-d tree over metadata, with DataFrame functions only.

Equal texts are one group, an item of the tree with the bytes of all its rows and the metadata of its
smallest id, so they land in one shard. A group above ``PIECE`` of a shard's share, which may be any
part of the table, is dealt by the id's hash into pieces of about that size, items of their own.

The items are split recursively along the widest dimension at the weighted quantile that leaves each
side the bytes of its shards, until every leaf is one shard. All nodes of a level are split in the
same passes: a pass sums bytes by (node, bin of the node's key range), and the next one looks into
the bin that holds the quantile, until the cut lies between two items. The driver sees ``BINS`` sums
a node and pass, never rows.

A dimension's key is a long: 24 bits of the dimension's value and 38 bits of the item's hash, which
parts ties in a dimension.

Defined results: a null text has no bytes, its checksum is 0, and it is of the group of the empty ones;
null dimensions are a value of their own; very long texts are items like others; repeated rows of one id
in a group stay together, each with a slot of its own; an empty table gives no rows; columns other than
the named ones are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table

BINS = 1024
VALUE_BITS = 24
PIECE = 1 / 8  # of a shard's share of the bytes
ROW_OVERHEAD = 8


@dataclass
class Node:
    shards: int
    first: int  # its first shard
    dim: int = -1
    cut: int = 0  # keys below it go left
    left: Node | None = None
    right: Node | None = None
    weight: int = 0
    low: int = 0
    high: int = 0
    before: int = 0
    open: bool = field(default=False)


def leaf_value(node: Node, dims: int, at: dict[int, Column], other: Column) -> Column:
    """``at`` by a leaf's first shard, through one nested CASE that follows the tree."""
    if node.left is None:
        return at.get(node.first, other)
    return F.when(F.col(f"key{node.dim}") < F.lit(node.cut), leaf_value(node.left, dims, at, other)).otherwise(leaf_value(node.right, dims, at, other))


def leaves(node: Node) -> list[Node]:
    return [node] if node.left is None else leaves(node.left) + leaves(node.right)


def grow(rows: DataFrame, dims: int, shards: int) -> Node:
    """The tree over rows with size, key0, key1, ... ; about log2(shards) levels of a few passes."""
    root = Node(shards, 0)
    none = F.lit(None).cast("int")
    whole: list[int] = []
    while todo := [n for n in leaves(root) if n.shards > 1 and n.dim != -2]:
        node = leaf_value(root, dims, {n.first: F.lit(n.first) for n in todo}, none)
        spans = [f(F.shiftright(f"key{d}", 62 - VALUE_BITS)) for d in range(dims) for f in (F.min, F.max)]
        ends = [f(f"key{d}") for d in range(dims) for f in (F.min, F.max)]
        found = {r[0]: r[1:] for r in rows.groupBy(node.alias("node")).agg(F.sum("size"), *spans, *ends).where("node is not null").collect()}
        for n in todo:
            if n.first not in found:  # no rows
                n.dim = -2
                continue
            n.weight, got = int(found[n.first][0] or 0), found[n.first][1:]
            width = [got[2 * d + 1] - got[2 * d] for d in range(dims)]
            whole = whole or [max(1, w) for w in width]
            n.dim = max(range(dims), key=lambda d: (width[d] / whole[d], -d))
            n.low, n.high, n.before, n.open = got[2 * dims + 2 * n.dim], got[2 * dims + 2 * n.dim + 1] + 1, 0, True
        todo = [n for n in todo if n.dim != -2]
        while seek := [n for n in todo if n.open]:
            step = {n.first: -(-(n.high - n.low) // BINS) for n in seek}
            cell = {n.first: F.when(F.col(f"key{n.dim}").between(n.low, n.high - 1), F.struct(F.lit(n.first).alias("node"), F.expr(f"cast((key{n.dim} - {n.low}L) div {step[n.first]}L as int)").alias("bin"))) for n in seek}
            sums: dict[int, list] = {n.first: [] for n in seek}
            for r in rows.groupBy(leaf_value(root, dims, cell, F.lit(None).cast("struct<node: int, bin: int>")).alias("cell")).agg(F.sum("size"), F.count("*")).where("cell is not null").collect():
                sums[r[0][0]].append((r[0][1], int(r[1] or 0), r[2]))
            for n in seek:
                aim, below = n.weight * (n.shards // 2) / n.shards - n.before, 0
                for k, size, count in sorted(sums[n.first]):
                    if below + size >= aim:
                        break
                    below += size
                start, width = n.low + k * step[n.first], step[n.first]
                if count == 1 or width == 1:
                    n.cut, n.open = (start if aim - below <= below + size - aim else start + width), False
                else:
                    n.low, n.high, n.before = start, min(n.high, start + width), n.before + below
        for n in todo:
            half = n.shards // 2
            n.left, n.right = Node(half, n.first), Node(n.shards - half, n.first + half)
    return root


def key(value: Column, tie: Column) -> Column:
    """24 bits of a value and 38 of the item's hash."""
    low = tie.bitwiseAND(F.lit((1 << 62 - VALUE_BITS) - 1))
    return F.shiftleft(value.cast("long"), 62 - VALUE_BITS).bitwiseOR(low)


def category(column: Column) -> Column:
    """Equal values next to each other; null is 0."""
    return F.when(column.isNull(), F.lit(0)).otherwise(F.shiftrightunsigned(F.xxhash64(column), 64 - VALUE_BITS))


def magnitude(column: Column) -> Column:
    """By the logarithm; null is 0."""
    return F.least(F.lit((1 << VALUE_BITS) - 1), F.log2(1 + F.greatest(F.coalesce(column.cast("double"), F.lit(0.0)), F.lit(0.0))) * (1 << 18))


def shard(docs: DataFrame, shards: int | None = None, target_bytes: int = 256 << 20, categories: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot. Without ``shards`` there are as many as leaves of
    ``target_bytes`` need."""
    bytes_ = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    crc = F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long")
    own = docs.select("doc_id", (bytes_ + ROW_OVERHEAD).alias("size"), crc.alias("text_crc32"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), *(F.col(c).alias(f"v{i}") for i, c in enumerate(categories)))
    rows = materialise(own, "shard-rows")
    n, total = rows.agg(F.count("*"), F.sum("size")).first()
    shards = shards or max(1, -(-int(total or 0) // target_bytes))
    piece = max(1.0, (total or 0) / shards * PIECE)

    # Items: a text's rows, or an equal share of them where they are too many for one item. Most texts
    # occur once, so what is joined back is only the groups that need several pieces.
    text = ["text_hash", "size", "text_crc32"]
    many = rows.groupBy(*text).agg(F.sum("size").alias("bytes")).where(F.col("bytes") > piece).select(*text, F.ceil(F.col("bytes") / piece).cast("long").alias("pieces"))
    placed = rows.join(many, text, "left").withColumn("piece", F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("pieces")), F.lit(0))).drop("pieces")
    placed = materialise(placed.withColumn("item", F.xxhash64(*text, "piece")), "shard-rows")
    first = F.min(F.struct("doc_id", *(f"v{i}" for i in range(len(categories))))).alias("first")
    items = placed.groupBy("item").agg(F.sum("size").alias("weight"), F.max("size").alias("size"), first)
    values = [magnitude(F.col("size")), *(category(F.col(f"first.v{i}")) for i in range(len(categories)))]
    items = materialise(items.select("item", F.col("weight").alias("size"), *(key(v, F.col("item")).alias(f"key{d}") for d, v in enumerate(values))), "shard-items")
    root = grow(items, len(values), shards)
    of = items.select("item", leaf_value(root, len(values), {x.first: F.lit(x.first) for x in leaves(root)}, F.lit(0)).alias("shard"))
    dealt = placed.select("doc_id", "size", "text_crc32", "item").join(of, "item").drop("item")

    # Slots without a task that holds a shard: rank in salted groups, plus the rows of those before.
    salt = max(16, n // shards // 200_000)
    dealt = dealt.withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(salt)).cast("int"))
    before = dealt.groupBy("shard", "salt").count().select("shard", "salt", (F.sum("count").over(Window.partitionBy("shard").orderBy("salt")) - F.col("count")).alias("before"))
    nth = F.row_number().over(Window.partitionBy("shard", "salt").orderBy("doc_id", "text_crc32")) - 1
    return dealt.withColumn("nth", nth).join(before, ["shard", "salt"]).select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("nth")).cast("long").alias("slot"))


def op1_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents"), shards=24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
