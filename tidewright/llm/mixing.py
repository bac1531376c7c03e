"""Operator 13: mixing sources to target weights, with DataFrame functions only.

*Targets.* Sources share the words of all documents by weight; none takes more than ``REPEATS`` times its
own words, and what is over goes to the others by weight. The level at which that ends is found from
the sources in order of their bound, one row a source.

*Blocks.* A source's documents, in an order drawn by hash, are one stream of words, cut into blocks of
``BLOCK`` words; a long document is part of several. An epoch passes over all blocks in an order of its
own (a step prime to their number). The source gives whole epochs and then the first blocks of one more,
the last one in part, so it gives its target to a word.

*Splitting tree.* The blocks that each source gives are its quota. The output shards are halved again and
again; a node's quotas are divided between its halves by draws of the multivariate hypergeometric
distribution, so quotas stay exact, every shard gets its number of blocks, and any division is as
likely as if all blocks were shuffled at random. Each draw inverts the distribution from its mode
outwards, as far as a random double can reach. A shard takes its quota of a source as the next blocks in
the source's order, so shards are disjoint, and shuffles them on its own.

Only the sources' table (a row each) and the tree (a row a shard, with a number a source) are gathered.
Documents get their place in the stream by range partitions, so a hot source is spread over tasks. All
is drawn by hashes of ids and of the seed: reruns agree.

Defined results: a null text, an empty one or one of white space only has no words, and is taken 0
times; a null source is one of its own, the last in order; a null doc_id counts as the empty text where
ids are hashed; a very long document is cut by blocks; repeated rows of one id are documents each; ties of
the drawn order go by id, size and text; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table
from .placing import matched, placed

WEIGHTS = (5, 2, 1)
REPEATS = 3
BLOCK = 1024
SHARDS = 64
SEED = 13
#: Primes; those that don't divide a source's number of blocks step through all of them.
STEPS = (1048573, 1048571, 1048559, 1048549, 1048517)
WORD = r"[^\x20\x09-\x0D]+"
SPREAD = 9.0  # standard deviations that a draw looks at; beyond is less than a random double resolves


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def hashed(parts: list[Column]) -> Column:
    return F.md5(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """Adds nth, weight and target to sources (source, source_size)."""
    every = Window.partitionBy(F.lit(0))  # a row a source
    out = sources.withColumn("nth", F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1)
    out = out.withColumn("weight", F.get(F.array(*map(F.lit, weights)), F.col("nth") % len(weights)).cast("double")).withColumn("most", (F.col("source_size") * repeats).cast("double"))
    by = every.orderBy(F.col("most") / F.col("weight"), "nth")
    bounded, rest = F.sum("most").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.sum("weight").over(by.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    out = out.withColumn("level", (F.sum("source_size").over(every) - F.coalesce(bounded, F.lit(0.0))) / rest)
    out = out.withColumn("full", F.col("most") <= F.col("weight") * F.col("level"))
    level = F.min_by(F.when(~F.col("full"), F.col("level")), F.when(~F.col("full"), F.col("most") / F.col("weight"))).over(every)
    return out.withColumn("target", F.when(F.col("full"), F.col("most")).otherwise(F.col("weight") * level)).drop("most", "level", "full")


def quotas(shared: DataFrame, block: int, seed: int) -> DataFrame:
    """Adds what a source gives to (source, source_size, nth, target): ``want`` words, in ``epochs`` whole
    epochs of ``blocks`` blocks and ``rest`` words more, and its ``quota`` of blocks in all."""
    size, want, blocks, rest, last = (F.col(c) for c in ("source_size", "want", "blocks", "rest", "last"))
    out = shared.withColumn("want", F.floor(F.col("target") + 0.5)).withColumn("blocks", F.ceil(size / block))
    out = out.withColumn("epochs", F.when(size > 0, F.floor(want / size)).otherwise(0)).withColumn("rest", F.when(size > 0, want % size).otherwise(0))
    out = out.withColumn("steps", F.filter(F.array(*(F.lit(p).cast("long") for p in STEPS)), lambda p: F.col("blocks") % p != 0))
    shifts = F.array(*(F.conv(F.substring(hashed([F.lit(seed), F.col("source"), F.lit(e)]), 1, 8), 16, 10).cast("long") for e in range(REPEATS + 1)))
    out = out.withColumn("shifts", shifts)
    # the short block at the end of the stream comes at place ``last`` of the epoch that is not whole
    out = out.withColumn("short", block * blocks - size).withColumn("last", F.when(blocks > 0, place(blocks - 1, F.col("epochs"))).otherwise(0))
    some = F.ceil(rest / block)
    some = F.when(some > last, F.ceil((rest + F.col("short")) / block)).otherwise(some)
    return out.withColumn("quota", F.col("epochs") * blocks + some)


def place(b: Column, epoch: Column) -> Column:
    """Place of a source's block in the epoch's order."""
    return (b * F.get("steps", (epoch % F.size("steps")).cast("int")) + F.get("shifts", epoch.cast("int"))) % F.col("blocks")


def hypergeometric(n: Column, k: Column, m: Column, u: Column) -> Column:
    """How many of ``m`` drawn from ``n`` are among ``k`` marked ones, for a random ``u`` below 1."""
    lo, hi = F.greatest(F.lit(0).cast("long"), m - (n - k)), F.least(k, m)
    share = k.cast("double") / F.greatest(n, F.lit(1))
    wide = (SPREAD * F.sqrt(m * share * (1 - share)) + 9).cast("long")

    def around(mode: Column) -> Column:
        w, s = lambda a: a["w"], lambda a: a["s"]
        state = lambda weight, total, x: F.struct(weight.alias("w"), total.alias("s"), x.alias("x"))
        # relative weight of the next number up and down, 1 at the mode
        rise = lambda x: (k - x + 1).cast("double") * (m - x + 1) / (x.cast("double") * (n - k - m + x))
        fall = lambda x: (x + 1).cast("double") * (n - k - m + x + 1) / ((k - x).cast("double") * (m - x))
        up = F.when(mode < hi, F.sequence(mode + 1, F.least(hi, mode + wide))).otherwise(F.array().cast("array<long>"))
        down = F.when(mode > lo, F.sequence(mode - 1, F.greatest(lo, mode - wide), F.lit(-1).cast("long"))).otherwise(F.array().cast("array<long>"))
        none = F.lit(None).cast("long")
        summed = lambda xs, ratio: F.aggregate(xs, state(F.lit(1.0), F.lit(0.0), none), lambda a, x: let(w(a) * ratio(x), lambda v: state(v, s(a) + v, none)))["s"]
        found = lambda xs, ratio, goal: F.aggregate(xs, state(F.lit(1.0), F.lit(0.0), none), lambda a, x: let(w(a) * ratio(x), lambda v: state(v, s(a) + v, F.coalesce(a["x"], F.when(s(a) + v > goal, x)))))["x"]

        def draw(above: Column) -> Column:
            goal = u * (1 + above + summed(down, fall))
            return let(goal, lambda g: F.when(g < 1, mode).when(g < 1 + above, F.coalesce(found(up, rise, g - 1), mode)).otherwise(F.coalesce(found(down, fall, g - 1 - above), mode)))

        return let(summed(up, rise), draw)

    mode = F.floor((m + 1).cast("double") * (k + 1) / (n + 2)).cast("long")
    return F.when(lo == hi, lo).otherwise(let(F.least(hi, F.greatest(lo, mode)), around))


def halved(node: Column, seed: int) -> Column:
    """A node (first, shards, total, before, counts) of the tree as its two halves; ``before`` and
    ``total`` say where its blocks stand among those of all shards."""
    left = F.floor(node["shards"] / 2).cast("int")
    number = lambda salt: F.conv(F.substring(hashed([F.lit(seed), node["first"], node["shards"], salt]), 1, 13), 16, 10).cast("double") / float(1 << 52)

    def step(acc: Column, i: Column) -> Column:
        k = F.get(node["counts"], i)
        x = hypergeometric(acc["n"], k, acc["m"], number(i))
        return let(x, lambda x: F.struct((acc["n"] - k).alias("n"), (acc["m"] - x).alias("m"), F.array_append(acc["out"], x).alias("out")))

    def parts(size: Column) -> Column:
        start = F.struct(F.aggregate(node["counts"], F.lit(0).cast("long"), lambda s, x: s + x).alias("n"), size.alias("m"), F.array().cast("array<long>").alias("out"))
        drawn = F.aggregate(F.sequence(F.lit(0), F.size(node["counts"]) - 1), start, step)["out"]
        one = lambda first, shards, counts: F.struct(first.alias("first"), shards.alias("shards"), counts.alias("counts"))
        return let(drawn, lambda d: F.array(one(node["first"], left, d), one(node["first"] + left, node["shards"] - left, F.zip_with(node["counts"], d, lambda a, b: a - b))))

    share = lambda shard: F.floor(node["all"] * shard / node["of"]).cast("long")
    return let(share(node["first"] + left) - share(node["first"]), parts)


def tree(given: DataFrame, shards: int, seed: int) -> DataFrame:
    """nth, ends: for each source (nth, quota) the number of its blocks that shards up to each one take."""
    counts = F.transform(F.array_sort(F.collect_list(F.struct("nth", "quota"))), lambda x: x["quota"])  # a number a source
    nodes = given.agg(counts.alias("counts"), F.sum("quota").alias("all")).where("all is not null")
    nodes = nodes.select("all", F.lit(0).alias("first"), F.lit(shards).alias("shards"), "counts")
    size = shards
    while size > 1:
        node = F.struct("all", F.lit(shards).alias("of"), "first", "shards", "counts")
        split = F.when(F.col("shards") > 1, halved(node, seed)).otherwise(F.array(F.struct("first", "shards", "counts")))
        nodes = nodes.select("all", F.explode(split).alias("node")).select("all", "node.*")
        size = -(-size // 2)
    each = nodes.select("first", F.posexplode("counts").alias("nth", "n"))
    rows = F.array_sort(F.collect_list(F.struct("first", "n")))  # a number a shard
    sums = F.aggregate(rows, F.array().cast("array<long>"), lambda acc, x: F.array_append(acc, F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + x["n"]))
    return each.groupBy("nth").agg(sums.alias("ends"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, block: int = BLOCK, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, content (a hash of the text), source_size, target and ``draws`` of every row: what the mix takes of it, as
    an array of (shard, epoch, block, draw, first, words): ``words`` of its words from number ``first``
    on."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sized = docs.select("doc_id", "source", size.alias("size"), F.xxhash64("text").alias("content"))
    sized = materialise(sized.withColumn("drawn", hashed([F.lit(seed), F.col("doc_id")])), "sized")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    given = materialise(quotas(targets(sources, weights, repeats), block, seed), "quotas")  # a row a source
    given = materialise(given.join(tree(given, shards, seed), "nth", "left"), "quotas")
    rows = matched(placed(sized, ["source"], ["drawn", "doc_id", "size", "content"], "size").drop("drawn", "pos", "n", "total"), given, ["source"])

    start, size, epochs, blocks = F.col("before"), F.col("size"), F.col("epochs"), F.col("blocks")
    width = F.lit(block).cast("long")

    def piece(b: Column, e: Column) -> Column:
        def at(i: Column) -> Column:
            long = F.least(width, F.col("source_size") - b * width)
            earlier = i * width - F.when(i > F.col("last"), F.col("short")).otherwise(0)
            open_ = F.when(e < epochs, long).otherwise(F.greatest(F.lit(0).cast("long"), F.least(long, F.col("rest") - earlier)))
            first = F.greatest(start, b * width)
            words = F.least(start + size, b * width + open_) - first
            draw = e * blocks + i
            shard = F.size(F.filter("ends", lambda x: x <= draw))
            return F.struct(shard.alias("shard"), e.alias("epoch"), b.alias("block"), draw.alias("draw"), (first - start).alias("first"), words.alias("words"))

        return let(place(b, e), at)

    span = F.sequence(F.floor(start / width), F.floor((start + size - 1) / width))
    every = F.flatten(F.transform(span, lambda b: F.transform(F.sequence(F.lit(0).cast("long"), epochs), lambda e: piece(b, e))))
    draws = F.when(size > 0, F.filter(every, lambda x: x["words"] > 0))
    kind = "array<struct<shard: int, epoch: bigint, block: bigint, draw: bigint, first: bigint, words: bigint>>"
    return rows.select("doc_id", "source", "size", "content", "source_size", "target", F.coalesce(draws, F.array().cast(kind)).alias("draws"))


def write_mix(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED, **options) -> None:
    """The mixed texts, a folder a shard, in the shard's own order: doc_id, epoch, words, text (of a
    document that blocks cut, its words with blanks between)."""
    pieces = mix(docs, shards=shards, seed=seed, **options).select("doc_id", "source", "size", "content", F.explode("draws").alias("d")).select("doc_id", "source", "size", "content", "d.*")
    texts = docs.select("doc_id", "source", F.xxhash64("text").alias("content"), "text").where("text is not null").dropDuplicates(["doc_id", "source", "content"])
    part = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), (F.col("first") + 1).cast("int"), F.col("words").cast("int")), " ")
    rows = matched(pieces, texts, ["doc_id", "source", "content"]).withColumn("text", F.when(F.col("words") == F.col("size"), F.col("text")).otherwise(part))
    key = hashed([F.lit(seed), F.col("shard"), F.col("draw"), F.col("source")])
    rows.withColumn("key", key).repartition("shard").sortWithinPartitions("shard", "key", "doc_id", "first").select("shard", "doc_id", "epoch", "words", "text").write.partitionBy("shard").mode("overwrite").parquet(path)


def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mix(table(spark, sf_dir, "documents"))
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda s, d: s + d["words"])
    return rows.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), taken.alias("taken"), F.size("draws").cast("long").alias("pieces"))


_PRIMES = ", ".join(map(str, STEPS))
#: The shares are found by giving out what is over again and again, the words by adding up blocks.
ORACLE = rf"""WITH RECURSIVE d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size, md5('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS drawn FROM documents),
z AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST([{", ".join(map(str, WEIGHTS))}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1] AS DOUBLE) AS weight, CAST({REPEATS} * source_size AS DOUBLE) AS most FROM z),
share AS (SELECT 0 AS round, source, weight, most, CAST(NULL AS DOUBLE) AS fixed FROM w
  UNION ALL SELECT round + 1, source, weight, most, coalesce(fixed, CASE WHEN weight * level >= most THEN most END) FROM (SELECT *, ((SELECT sum(source_size) FROM z) - coalesce(sum(fixed) OVER (), 0)) / nullif(sum(CASE WHEN fixed IS NULL THEN weight END) OVER (), 0) AS level FROM share)
  WHERE round <= (SELECT count(*) FROM z)),
final AS (SELECT source, coalesce(fixed, weight * ((SELECT sum(source_size) FROM z) - coalesce(sum(fixed) OVER (), 0)) / sum(CASE WHEN fixed IS NULL THEN weight END) OVER ()) AS target FROM share WHERE round = (SELECT max(round) FROM share)),
q AS (SELECT z.*, target, CAST(floor(target + 0.5) AS BIGINT) AS want, (source_size + {BLOCK - 1}) // {BLOCK} AS blocks FROM z JOIN final USING (source) UNION ALL SELECT z.*, target, CAST(floor(target + 0.5) AS BIGINT), (source_size + {BLOCK - 1}) // {BLOCK} FROM z, final WHERE z.source IS NULL AND final.source IS NULL),
b AS (SELECT q.*, b, e, list_filter([{_PRIMES}], lambda p: blocks % p <> 0) AS steps, CAST('0x' || substr(md5('{SEED}|' || coalesce(source, '') || '|' || e), 1, 8) AS BIGINT) AS shift FROM q, LATERAL (SELECT unnest(range(blocks)) AS b) x, LATERAL (SELECT unnest(range({REPEATS + 1})) AS e) y),
o AS (SELECT source, b, least({BLOCK}, source_size - b * {BLOCK}) AS long, coalesce(sum(least({BLOCK}, source_size - b * {BLOCK})) OVER (PARTITION BY source ORDER BY e, (b * steps[e % len(steps) + 1] + shift) % blocks ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier, want FROM b),
open AS (SELECT source, b, greatest(0, least(long, want - earlier)) AS words FROM o WHERE earlier < want),
s AS (SELECT *, row_number() OVER (ORDER BY source, drawn, doc_id, size) AS k, sum(size) OVER (PARTITION BY source ORDER BY drawn, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS start FROM d),
t AS (SELECT k, sum(greatest(0, least(start + size, b * {BLOCK} + words) - greatest(start, b * {BLOCK}))) AS taken, count(*) FILTER (least(start + size, b * {BLOCK} + words) > greatest(start, b * {BLOCK})) AS pieces
  FROM s JOIN open ON open.source IS NOT DISTINCT FROM s.source AND b BETWEEN start // {BLOCK} AND (start + size - 1) // {BLOCK} GROUP BY k)
SELECT doc_id, CAST(s.size AS BIGINT) AS size, q.source_size, round(q.target, 6) AS target, CAST(coalesce(taken, 0) AS BIGINT) AS taken, CAST(coalesce(pieces, 0) AS BIGINT) AS pieces FROM s JOIN q ON q.source IS NOT DISTINCT FROM s.source LEFT JOIN t USING (k)"""
