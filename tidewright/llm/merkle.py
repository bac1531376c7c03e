"""Operator 12: a Merkle manifest of a dataset, by levels held as concatenated hex strings.

A row is a leaf: the hash of its fields, each with its length. Within a tree leaves stand in order, and
runs of ``ARITY`` nodes become their hash until one is left. ``WIDTH`` = 3^5 consecutive nodes of a tree
are a block, a row that keeps each of its levels as one hex string: parents are hashes of its
substrings of fixed width, and a node's siblings are the substrings beside it. Blocks are aligned, so no
run crosses them; the blocks' top nodes are the leaves of the next round, which has ``WIDTH`` times fewer
nodes, until each tree is one block. Then the trees' roots are the leaves of one tree more.

A hot source is many blocks like any other; its leaves get their places by range partitions
(``placing.placed``). The driver sees the size of the largest tree, a number a round.

Defined results: any column may be null (its mark is ``-``), a null source is a tree of its own, the first
one; a null doc_id comes first and counts as the empty text where ids are hashed; empty texts are leaves
like others; very long texts are hashed whole; rows of one doc_id, repeated ones too, are leaves each,
ordered by their hash; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CRC_SQL, materialise, table
from .placing import matched, placed

ARITY, HEIGHT = 3, 5
WIDTH = ARITY**HEIGHT
HEX = 64  # characters of a hash
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def digest(c: Column) -> Column:
    return F.sha2(c, 256)


def leaf(fields: list[Column]) -> Column:
    """Hash of the fields' values, each with its bytes before it; ``-`` for a null."""
    one = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return digest(F.concat(*(one(c.cast("string")) for c in fields)))


def parents(level: Column) -> Column:
    runs = F.sequence(F.lit(0), F.ceil(F.length(level) / (ARITY * HEX)).cast("int") - 1)
    return F.array_join(F.transform(runs, lambda r: digest(F.substring(level, r * (ARITY * HEX) + 1, F.lit(ARITY * HEX)))), "")


def levels(lowest: Column, n: Column) -> Column:
    """A block's levels, as long as its tree of ``n`` nodes has more than one on the level."""
    more = lambda done, k: F.ceil(n / F.pow(F.lit(ARITY), k)) > 1
    return F.aggregate(F.sequence(F.lit(0), F.lit(HEIGHT - 1)), F.array(lowest), lambda done, k: F.when(more(done, k), F.concat(done, F.array(parents(F.element_at(done, -1))))).otherwise(done))


def flanks(levels: Column, at: Column) -> Column:
    """(left, right) siblings of the block's node ``at``, and of its parents, level by level."""

    def beside(k: Column) -> Column:
        level, own = F.get(levels, k), F.floor(at / F.pow(F.lit(ARITY), k)).cast("int")
        first = own - own % ARITY
        return F.struct(F.substring(level, first * HEX + 1, (own - first) * HEX).alias("left"), F.substring(level, (own + 1) * HEX + 1, (first + ARITY - 1 - own) * HEX).alias("right"))

    none = F.array().cast("array<struct<left: string, right: string>>")
    return F.when(F.size(levels) > 1, F.transform(F.sequence(F.lit(0), F.size(levels) - 2), beside)).otherwise(none)


def rooted(nodes: DataFrame, keep: list[str], most: int) -> DataFrame:
    """tree, pos, node, ``keep``, root and path (siblings up to the root) of nodes (tree, n, pos, node,
    ``keep``); ``most``: the largest n."""
    items = F.array_sort(F.collect_list(F.struct("pos", "node", *keep)))  # WIDTH at most
    blocks = nodes.groupBy("tree", "n", F.floor(F.col("pos") / WIDTH).alias("block")).agg(items.alias("items"))
    blocks = blocks.withColumn("levels", levels(F.array_join("items.node", ""), F.col("n")))
    if most > WIDTH:
        blocks = materialise(blocks, "blocks")  # read for its tops and for its paths
    top = F.element_at("levels", -1)
    if most > WIDTH:
        upper = rooted(blocks.select("tree", F.ceil(F.col("n") / WIDTH).alias("n"), F.col("block").alias("pos"), top.alias("node")), [], -(-most // WIDTH))
        upper = upper.select("tree", F.col("pos").alias("block"), F.col("path").alias("above"), "root")
        blocks = matched(blocks, upper, ["tree", "block"])
    else:
        blocks = blocks.withColumn("above", F.array().cast("array<struct<left: string, right: string>>")).withColumn("root", top)
    found = F.transform("items", lambda x: F.struct(x.alias("item"), flanks(F.col("levels"), (x["pos"] % WIDTH).cast("int")).alias("path")))
    rows = blocks.select("tree", "above", "root", F.explode(found).alias("x"))
    return rows.select("tree", "x.item.*", "root", F.concat("x.path", "above").alias("path"))


def most_nodes(nodes: DataFrame) -> int:
    return nodes.agg(F.max("n")).first()[0] or 0


def proof(path: Column) -> Column:
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""))


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path give."""
    return F.aggregate(path, start, lambda node, s: digest(F.concat(s["left"], node, s["right"])))


def manifest(docs: DataFrame, fields: list[str], tree: str, order: str, other: Column | None = None) -> DataFrame:
    """``order``, tree, leaf, subroot, root, path of every row; with ``other``, a leaf of other content,
    also that, as ``other``."""
    own = docs.select(F.col(tree).alias("tree"), F.col(order).alias("id"), leaf([F.col(c) for c in fields]).alias("node"), *([other.alias("other")] if other is not None else []))
    keep = ["id", *(["other"] if other is not None else [])]
    leaves = placed(materialise(own, "leaves"), ["tree"], ["id", "node"])
    leaves = materialise(leaves, "leaves")
    rows = rooted(leaves, keep, most_nodes(leaves)).withColumnRenamed("root", "subroot").withColumnRenamed("path", "below")

    roots = materialise(rows.where("pos = 0").select("tree", "subroot"), "subroots")  # a row a tree
    tops = placed(roots.select(F.lit(0).alias("forest"), "tree", "subroot"), ["forest"], ["tree"])
    tops = tops.select(F.col("forest").alias("tree"), "n", "pos", F.col("subroot").alias("node"), F.col("tree").alias("of"))
    tops = materialise(rooted(tops, ["of"], most_nodes(tops)).select(F.col("of").alias("tree"), "root", F.col("path").alias("above")), "roots")
    return matched(rows, tops, ["tree"]).select("tree", *keep, F.col("node").alias("leaf"), "subroot", "root", F.concat("below", "above").alias("path"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    cut = docs.withColumn("text", F.replace("text", F.lit("\n"), F.lit("")))
    even = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 2 == 0
    other = F.when(even, leaf([F.replace("text", F.lit("\n"), F.lit("")) if c == "text" else F.col(c) for c in FIELDS]))
    rows = manifest(docs, FIELDS, "source", "doc_id", other)
    rows = rows.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), folded(F.coalesce("other", "leaf"), F.col("path")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def field_sql(c: str, value: str | None = None) -> str:
    v = value or f"CAST({c} AS VARCHAR)"
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({v}) || ':' || {v} END"


LEAF_SQL = " || ".join(map(field_sql, FIELDS))
OTHER_SQL = " || ".join(field_sql(c, "replace(text, chr(10), '')" if c == "text" else None) for c in FIELDS)

#: ``nodes``: every node of every level of the sources' trees; ``tops``: of the tree above them.
ORACLE = f"""WITH RECURSIVE d AS (SELECT doc_id, source, sha256({LEAF_SQL}) AS leaf, CASE WHEN {CRC_SQL.format(x="CAST(doc_id AS VARCHAR)")} % 2 = 0 THEN sha256({OTHER_SQL}) END AS other FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM d),
nodes AS (SELECT source AS tree, n, CAST(0 AS BIGINT) AS level, pos, leaf AS node FROM p
  UNION ALL SELECT tree, (n + 2) // 3, level + 1, pos // 3, sha256(string_agg(node, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY tree, n, level, pos // 3),
subs AS (SELECT tree, node, level, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (SELECT n, CAST(0 AS BIGINT) AS level, pos, node FROM subs
  UNION ALL SELECT (n + 2) // 3, level + 1, pos // 3, sha256(string_agg(node, '' ORDER BY pos)) FROM tops WHERE n > 1 GROUP BY n, level, pos // 3),
steps AS (SELECT tree, n, level, pos, node, CAST(NULL AS BIGINT) AS sub FROM nodes UNION ALL SELECT s.tree, t.n, s.level + t.level, t.pos, t.node, s.level FROM tops t, subs s),
beside AS (SELECT p.source, p.pos AS leaf_pos, s.level,
    coalesce(string_agg(s.node, '' ORDER BY s.pos) FILTER (s.pos < own), '') AS l, coalesce(string_agg(s.node, '' ORDER BY s.pos) FILTER (s.pos > own), '') AS r
  FROM (SELECT p.*, b.level AS sub_level, b.pos AS sub_pos FROM p JOIN subs b ON b.tree IS NOT DISTINCT FROM p.source) p JOIN steps s ON s.tree IS NOT DISTINCT FROM p.source AND s.n > 1 AND s.pos // 3 = (CASE WHEN s.sub IS NULL THEN p.pos // CAST(3 ** s.level AS BIGINT) ELSE p.sub_pos // CAST(3 ** (s.level - s.sub) AS BIGINT) END) // 3,
    LATERAL (SELECT CASE WHEN s.sub IS NULL THEN p.pos // CAST(3 ** s.level AS BIGINT) ELSE p.sub_pos // CAST(3 ** (s.level - s.sub) AS BIGINT) END AS own) o
  GROUP BY p.source, p.pos, s.level),
path AS (SELECT source, leaf_pos, level, l, r FROM beside),
fold AS (SELECT source, pos, CAST(0 AS BIGINT) AS level, coalesce(other, leaf) AS node FROM p
  UNION ALL SELECT f.source, f.pos, f.level + 1, sha256(l || node || r) FROM fold f JOIN path ON path.source IS NOT DISTINCT FROM f.source AND path.leaf_pos = f.pos AND path.level = f.level),
ends AS (SELECT source, pos, max_by(node, level) AS folded_root FROM fold GROUP BY 1, 2),
proofs AS (SELECT source, leaf_pos, sha256(string_agg(l || r, '' ORDER BY level)) AS proof FROM path GROUP BY 1, 2)
SELECT p.doc_id, p.leaf, s.node AS subroot, t.node AS root, coalesce(q.proof, sha256('')) AS proof_sha256, e.folded_root, e.folded_root = t.node AS verified
FROM p JOIN subs s ON s.tree IS NOT DISTINCT FROM p.source JOIN tops t ON t.n = 1 LEFT JOIN proofs q ON q.source IS NOT DISTINCT FROM p.source AND q.leaf_pos = p.pos
JOIN ends e ON e.source IS NOT DISTINCT FROM p.source AND e.pos = p.pos"""
