"""Greedy choice of unlike word sets within keys of any size.

In order, a set is kept unless one kept before it in its key is like it (Jaccard similarity of ``threshold``
or more). Keys with up to ``FEW`` sets are folded, each in one row. In larger ones like sets are found by a
prefix index: they share a word of both prefixes, the rarest words that one of them cannot do without.

* Equal sets of a key are one; only the first of them can be kept.
* While words are crowded (more than ``CROWD`` comparisons a place), rounds look at the first set of each
  (key, word) alone: a set that is first under all its prefix words has none like it before it and is kept,
  each of the others is compared with that one set, and those like it go. A round costs the length of the
  prefixes, and crowds of like sets melt away.
* What is left is compared by pairs that share a prefix word and may be alike by their lengths and by the
  place of the word, once. A key's like pairs, in order of their second set, are streamed through one task
  that holds the sets gone so far; keys with more than ``MANY`` pairs are decided in rounds by all tasks: sets
  with no undecided like one before them are kept, those like them go, and the rest meets again.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions.text import jaccard
from tidewright.sources.tables import staged

FEW = 64  # sets a key that are folded in one row
WORTH = 0.1  # share of the undecided that a round of firsts must decide
CROWD = 32  # comparisons a place in the index
MANY = 4_000_000  # like pairs of a key


def folded(items: DataFrame, threshold: float) -> DataFrame:
    """id of the items that go, of keys with few: items (key, at, id, words)."""
    rows = F.array_sort(F.collect_list(F.struct("at", "id", "words")))  # FEW at most
    kind = items.schema["id"].dataType.simpleString()
    empty = F.struct(F.array().cast("array<array<string>>").alias("kept"), F.array().cast(f"array<{kind}>").alias("gone"))
    like = lambda acc, x: F.exists(acc["kept"], lambda k: jaccard(x["words"], k) >= threshold)
    step = lambda acc, x: F.when(like(acc, x), F.struct(acc["kept"].alias("kept"), F.array_append(acc["gone"], x["id"]).alias("gone"))).otherwise(F.struct(F.array_append(acc["kept"], x["words"]).alias("kept"), acc["gone"].alias("gone")))
    return items.groupBy("key").agg(F.aggregate(rows, empty, step)["gone"].alias("gone")).select(F.explode("gone").alias("id"))


def with_prefix(sets: DataFrame, threshold: float) -> DataFrame:
    """sets with their words ordered from rare to frequent and ``prefix``, the first words of which a like
    set must have one."""
    each = sets.select("key", "at", "id", F.explode("words").alias("word"))
    often = each.groupBy("word").agg(F.count("*").alias("often"))
    by = each.join(often, "word").groupBy("key", "at", "id").agg(F.transform(F.array_sort(F.collect_list(F.struct("often", "word"))), lambda x: x["word"]).alias("words"))
    n = F.size("words")
    return by.withColumn("prefix", F.slice("words", F.lit(1), n - F.ceil(n * threshold - 1e-9).cast("int") + 1))


def places(sets: DataFrame, name: str) -> DataFrame:
    """A row a prefix word: key, word, and the set's at, id, words and the word's place, with a suffix."""
    out = sets.select("key", "at", "id", "words", F.posexplode("prefix").alias("place", "word"))
    return out.withColumnsRenamed({c: f"{c}_{name}" for c in ("at", "id", "words", "place")})


def may(threshold: float) -> Column:
    """Whether two sets, of which a is the first, may be alike by what is left of them from a common word on."""
    n, m = F.size("words_a"), F.size("words_b")
    rest = F.least(n - F.col("place_a"), m - F.col("place_b"))
    return (F.col("at_a") < F.col("at_b")) & (rest >= (n + m) * (threshold / (1 + threshold)) - 1e-9)


def like_pairs(firsts: DataFrame, others: DataFrame, threshold: float) -> DataFrame:
    """key, a, b, at (of b): like pairs with a before b, of (places of a, places of b)."""
    met = firsts.join(others, F.col("key_a").eqNullSafe(F.col("key_b")) & (F.col("word_a") == F.col("word_b"))).where(may(threshold))
    like = met.where(jaccard(F.col("words_a"), F.col("words_b")) >= threshold)
    return like.groupBy(F.col("id_a").alias("a"), F.col("id_b").alias("b")).agg(F.first("key_b").alias("key"), F.first("at_b").alias("at"))


def sided(sets: DataFrame, name: str) -> DataFrame:
    return places(sets, name).withColumnsRenamed({"key": f"key_{name}", "word": f"word_{name}"})


def crowded(sets: DataFrame) -> bool:
    n = F.col("count").cast("double")
    places, meetings = sets.select("key", F.explode("prefix").alias("word")).groupBy("key", "word").count().agg(F.sum(n), F.sum(n * (n - 1) / 2)).first()
    return (meetings or 0) > CROWD * (places or 0)


def streamed(pairs: DataFrame) -> DataFrame:
    """id of those that go, by a key's pairs in order: when a pair comes, its first set is decided."""
    kind = pairs.schema["b"].dataType.simpleString()
    rows = pairs.select(F.hash("key").alias("part"), "key", "at", "a", "b").repartition("part").sortWithinPartitions("key", "at", "b").select(F.xxhash64("key").alias("key"), "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, gone = None, set()
        for batch in batches:
            out = []
            for k, a, b in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if k != key:
                    key, gone = k, set()
                if a not in gone and b not in gone:
                    gone.add(b)
                    out.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(out, batch.schema.field(2).type)], ["id"])

    return rows.mapInArrow(run, f"id {kind}")


def decided(pairs: DataFrame) -> list[DataFrame]:
    """id of those that go, in rounds of all pairs."""
    gone = []
    pairs = pairs.select("a", "b")
    while not pairs.isEmpty():
        later = pairs.select(F.col("b").alias("id")).distinct()
        kept = pairs.select(F.col("a").alias("id")).distinct().join(later, "id", "left_anti")
        out = staged(pairs.join(kept.select(F.col("id").alias("a")), "a").select(F.col("b").alias("id")).distinct(), "gone")
        gone.append(out)
        left = pairs.join(out.select(F.col("id").alias("a")), "a", "left_anti").join(out.select(F.col("id").alias("b")), "b", "left_anti")
        pairs = staged(left.select("a", "b"), "pairs")
    return gone


def of_any_size(items: DataFrame, threshold: float) -> DataFrame:
    """id of the items that go, of keys of any size."""
    first = items.groupBy("key", F.array_sort("words").alias("words")).agg(F.min(F.struct("at", "id")).alias("low"))
    sets = staged(with_prefix(first.select("key", "words", "low.*"), threshold), "sets")
    gone = [items.select("id").join(sets.select("id"), "id", "left_anti")]
    left = sets
    while crowded(left):
        mine = left.select("id", "key", "at", F.explode("prefix").alias("word"))
        lead = mine.groupBy(F.col("key").alias("lead_key"), F.col("word").alias("lead_word")).agg(F.min("at").alias("lead"))
        led = mine.join(lead, F.col("key").eqNullSafe(F.col("lead_key")) & (F.col("word") == F.col("lead_word"))).where("at > lead").select("id")
        kept = staged(left.join(led.distinct(), "id", "left_anti"), "kept")
        out = staged(like_pairs(sided(kept, "a"), sided(left, "b"), threshold).select(F.col("b").alias("id")).distinct(), "gone")
        gone.append(out)
        before = left.count()
        left = staged(left.join(kept.select("id").unionByName(out), "id", "left_anti"), "left")
        if left.count() > (1 - WORTH) * before:
            break
    pairs = staged(like_pairs(sided(left, "a"), sided(left, "b"), threshold), "pairs")
    many = staged(pairs.groupBy(F.col("key").alias("many")).agg(F.count("*").alias("n")).where(F.col("n") > MANY), "many")
    if many.isEmpty():
        gone.append(streamed(pairs))
    else:
        large = F.col("key").eqNullSafe(F.col("many"))
        gone.append(streamed(pairs.join(many, large, "left_anti")))
        gone += decided(pairs.join(many, large, "left_semi"))
    return reduce(DataFrame.unionByName, gone)


def greedy(items: DataFrame, threshold: float, few: int = FEW) -> DataFrame:
    """id of the items (key, at, id, words) that are like one kept before them in their key. ``at`` orders a
    key's items without ties; words are distinct; items without words are neither kept nor gone. A null
    key is a key."""
    items = items.where(F.size("words") > 0)
    large = staged(items.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > few).select(F.col("key").alias("large")), "large-keys")
    if large.isEmpty():
        return folded(items, threshold)
    is_large = F.col("key").eqNullSafe(F.col("large"))
    return folded(items.join(large, is_large, "left_anti"), threshold).unionByName(of_any_size(items.join(large, is_large, "left_semi"), threshold))
