"""Operator 5: near duplicates by consistent weighted sampling of TF-IDF shingles.

A text's shingles are its runs of five words (letters and digits, lower case; a shorter text is one
shingle), weighted by term frequency times inverse document frequency. Document frequencies of all
shingles of all texts are counted in a sketch of ``COUNTERS`` counters, a fixed size. The weight of a
shingle in up to the square root of all texts is 1 + ``SPREAD``, whatever the sketch's noise, falling
to 1 for one that all texts have. (An undamped IDF would make the few words that differ outweigh the
many that a large group of copies shares.)

Improved consistent weighted sampling draws ``BANDS`` x ``ROWS`` samples a text, banded into
buckets. Equal texts are one class and are sampled and compared once. In a bucket each class is
compared with the bucket's first, its leader, so a bucket costs its size, not its square. Those of other
groups than the leader's are dealt again under a leader of their own, ``ROUNDS`` times in all. Then
groups are known but for links between them, and those are found exactly: two alike share one of
their rarest shingles, so of the classes still in question all pairs of different groups are compared
but those that a bound on the common weight rules out. Of a leader's group only those are in question
that may be as near to another group by the triangle inequality. Compared pairs are links if their exact
weighted Jaccard similarity is ``SIMILAR`` or more; groups are the connected components of the links.

Defined results: a null text is a group of its own; empty texts, or other texts without a word, are
grouped only with equal ones; very long texts are compared whole; rows with one doc_id and
text are one document, texts of one doc_id are documents each; a null doc_id stays ungrouped (group_id null); ties go to the smallest doc_id; an empty table
gives no rows; further columns, of whatever name, are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, mixed, slices, span_hashes, table

SHINGLE = 5
SIMILAR = 0.8
BANDS, ROWS = 16, 3
ROUNDS = 3
COUNTERS = 1 << 18
EDGES = 25_000  # edges that a task takes, from 8 tasks on
SPREAD = 0.25
SLACK = 1e-6  # of rounding in sums of weights
SLICE = 1_000_000  # bytes of texts in arrays at a time
GOLD = np.uint64(0x9E3779B97F4A7C15)


FOLD = np.full(256, 32, np.uint8)  # bytes of words in lower case, others blank
for _b in (*range(48, 58), *range(97, 123), *range(128, 256)):
    FOLD[_b] = _b
FOLD[65:91] = np.arange(97, 123)


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, how often), distinct in each text, texts in order."""
    data = [t.encode() for t in texts]
    size = np.fromiter(map(len, data), np.int64, len(data))
    a = FOLD[np.frombuffer(b"".join(data), np.uint8)]
    text = np.repeat(np.arange(len(data)), size)
    word = a != 32
    fresh = np.ones(len(a), bool)
    fresh[1:] = text[1:] != text[:-1]
    begin, stop = word.copy(), word.copy()
    begin[1:] &= ~word[:-1] | fresh[1:]
    stop[:-1] &= ~word[1:] | fresh[1:]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    words, of = span_hashes(a, starts, ends), text[starts]
    n = np.bincount(of, minlength=len(data))
    first = np.cumsum(n) - n
    h = np.zeros(len(words), np.uint64)
    for k in range(SHINGLE):
        later = np.zeros(len(words), np.uint64)
        later[: max(0, len(words) - k)] = words[k:]
        if k:
            later[np.arange(len(words)) + k >= (first + n)[of]] = 0  # words of the next text
        h = mixed(h + later + GOLD)
    whole = (np.arange(len(words)) + SHINGLE <= (first + n)[of]) | (np.arange(len(words)) == first[of])
    h, of = h[whole], of[whole]
    import pandas as pd

    codes, _ = pd.factorize(h ^ mixed(of.astype(np.uint64) + GOLD))
    at = np.full(codes.max() + 1, -1, np.int64)
    at[codes[::-1]] = np.arange(len(codes))[::-1]
    return of[at], h[at], np.bincount(codes)


class Weights:
    """TF-IDF from the sketch of document frequencies."""

    def __init__(self, counters: np.ndarray, n: int):
        self.seen = counters.astype(np.int64)
        rare = max(1.0, float(counters.mean()))  # what unrelated shingles add to a counter
        df = np.clip(counters - rare, 1.0, max(1.0, n))
        self.idf = (1 + SPREAD * np.minimum(1, 2 * np.log(max(n, 2) / df) / np.log(max(n, 2)))).astype(np.float32)

    def of(self, shingle: np.ndarray, often: np.ndarray) -> np.ndarray:
        return often * self.idf[(shingle >> np.uint64(46)).astype(np.int64)]


def similarity(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two (sorted shingles, weights)."""
    at = np.searchsorted(y[0], x[0])
    at[at == len(y[0])] = 0
    both = y[0][at] == x[0] if len(y[0]) else np.zeros(len(x[0]), bool)
    common = np.minimum(x[1][both], y[1][at[both]]).sum()
    return float(common / max(1e-12, x[1].sum() + y[1].sum() - common))


def prefixes(texts: list[str], w: Weights, similar: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, the text's weight, weight of this and all later shingles) of each text's prefix, in
    one order of all shingles, by their counters and so with shared passages last. What two texts have in common is no more than the
    weight from the first shared shingle on, and at least ``similar`` of either text if they are alike:
    they share a shingle of both prefixes."""
    text, shingle, often = shingles(texts)
    if not len(text):
        return text, shingle, np.empty(0), np.empty(0)
    order = np.lexsort((shingle, w.seen[(shingle >> np.uint64(46)).astype(np.int64)], text))
    text, shingle, weight = text[order], shingle[order], w.of(shingle, often)[order].astype(float)
    starts = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
    size = np.diff(np.append(starts, len(text)))
    total = np.repeat(np.add.reduceat(weight, starts), size)
    upto = np.cumsum(weight) - weight
    rest = total - (upto - np.repeat(upto[starts], size))
    early = rest >= similar * total * (1 - SLACK)
    return text[early], shingle[early], total[early], rest[early]


def random_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Draws of the sampling scheme, looked up by 16 bits of a hash each: r and ln c of Gamma(2, 1),
    beta uniform."""
    rng = np.random.default_rng(11)
    r = np.sort(rng.gamma(2.0, 1.0, 1 << 16)).astype(np.float32)
    c = np.sort(np.log(rng.gamma(2.0, 1.0, 1 << 16))).astype(np.float32)
    return r, c, ((np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.float32)


R, LN_C, BETA = random_tables()
SEEDS = mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * GOLD)
LOW16 = np.uint64(0xFFFF)


def sampled(text: np.ndarray, shingle: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(texts that have shingles, BANDS bucket values of each)."""
    starts = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
    size = np.diff(np.append(starts, len(text)))
    ln_w = np.log(weight.astype(np.float32))
    row = np.repeat(np.arange(len(starts)), size)
    bands = np.zeros((len(starts), BANDS), np.uint64)
    for j, seed in enumerate(SEEDS):
        g = (shingle ^ seed) * np.uint64(0xD6E8FEB86659FD93)
        g ^= g >> np.uint64(32)
        r = R[(g & LOW16).astype(np.uint16)]
        beta = BETA[((g >> np.uint64(16)) & LOW16).astype(np.uint16)]
        t = np.floor(ln_w / r + beta)
        ln_a = LN_C[((g >> np.uint64(32)) & LOW16).astype(np.uint16)] - r * (t - beta + 1)
        low = np.minimum.reduceat(ln_a, starts)
        at = np.flatnonzero(ln_a == low[row])
        own = mixed(shingle[at] + t[at].astype(np.int64).astype(np.uint64) * GOLD)
        of = row[at]
        sample = np.minimum.reduceat(own, np.flatnonzero(np.append(True, of[1:] != of[:-1])))
        bands[:, j // ROWS] = mixed(bands[:, j // ROWS] + sample + np.uint64(j + 1))
    return text[starts], bands


def frequency_sketch(docs: DataFrame) -> Weights:
    """Weights from one pass over all texts."""
    piece = COUNTERS // 64

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros(COUNTERS, np.int64), 0
        for part in slices(batches, SLICE):
            texts = [t for t in part.column("text").to_pylist() if t]
            n += len(texts)
            sums += np.bincount((shingles(texts)[1] >> np.uint64(46)).astype(np.int64), minlength=COUNTERS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(64), pa.int64()), pa.array([n] * 64, pa.int64()), pa.array([x.tobytes() for x in sums.reshape(64, piece)], pa.binary())], ["piece", "n", "counts"])

    def add(t: pa.Table) -> pa.Table:
        total = np.zeros(piece, np.int64)
        for x in t.column("counts").to_pylist():
            total += np.frombuffer(x, np.int64)
        return pa.table({"piece": t.column("piece").slice(0, 1), "n": pa.array([sum(t.column("n").to_pylist())], pa.int64()), "counts": pa.array([total.tobytes()], pa.binary())})

    parts = docs.select("text").mapInArrow(count, "piece long, n long, counts binary")
    # sums of up to 64 tasks at a time: no task meets the counters of all
    parts = parts.withColumn("deal", F.spark_partition_id() % 64).groupBy("piece", "deal").applyInArrow(add, "piece long, n long, counts binary")
    rows = parts.groupBy("piece").applyInArrow(add, "piece long, n long, counts binary").collect()  # COUNTERS numbers
    counters = np.zeros(COUNTERS, np.int64)
    for r in rows:
        counters[r["piece"] * piece : (r["piece"] + 1) * piece] = np.frombuffer(r["counts"], np.int64)
    return Weights(counters, max((r["n"] for r in rows), default=0))


def components(links: DataFrame) -> DataFrame:
    """node, root of every linked node: the smallest id of its component, by alternating large-star
    and small-star steps, each written so that no step depends on executors of an earlier one."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v")
    state = lambda: edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    now, mark = state(), None
    tasks = max(8, now[0] // EDGES)  # a small graph takes few tasks, whatever the session's partitions
    if now[0]:
        edges = materialise(edges.coalesce(tasks), "edges")
    while now[0] and now != mark:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = materialise(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(tasks), "edges")
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u").coalesce(tasks)
        small = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = materialise(small.where("u != v").distinct().coalesce(tasks), "edges")
        mark, now = now, state()
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))


def rest_links(left: DataFrame, named: DataFrame, texts: DataFrame, weights, compared: Callable[[DataFrame], DataFrame], similar: float) -> DataFrame:
    """a, b: roots of groups so far that have a link between them, of their members among ``left``.
    Groups meet by the shingles of prefixes, then those of their members that may be alike."""
    kind = texts.schema["class_id"].dataType.simpleString()

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, SLICE):
            text, shingle, total, rest = prefixes([t or "" for t in part.column("text").to_pylist()], weights.value, similar)
            yield pa.RecordBatch.from_arrays([part.column("class_id").take(pa.array(text)), pa.array(shingle.astype(np.int64)), pa.array(total), pa.array(rest)], ["class_id", "shingle", "total", "rest"])

    mine = texts.join(left, "class_id", "left_semi").mapInArrow(emit, f"class_id {kind}, shingle long, total double, rest double")
    every = materialise(mine.join(named.select("class_id", "root"), "class_id"), "prefixes")
    several = every.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("shingle")
    places = materialise(every.join(several, "shingle"), "prefixes")

    # x and y have common weight of similar / (1 + similar) of both weights' sum, or are unlike
    share = similar / (1 + similar) * (1 - SLACK)
    most = places.groupBy("shingle", "root").agg(F.max("rest").alias("rest"), F.min("total").alias("total"))
    side = lambda rows, k: rows.select("shingle", *(F.col(c).alias(f"{c}_{k}") for c in rows.columns if c != "shingle"))
    may = (F.least("rest_a", "rest_b") >= share * (F.col("total_a") + F.col("total_b"))) & (F.col("root_a") < F.col("root_b"))
    meet = side(most, "a").join(side(most, "b"), "shingle").where(may).select("shingle", "root_a", "root_b")
    pairs = meet.join(side(places, "a"), ["shingle", "root_a"]).join(side(places, "b"), ["shingle", "root_b"]).where(may)
    pairs = materialise(pairs.select(F.col("class_id_a").alias("a"), F.col("class_id_b").alias("b"), "root_a", "root_b").distinct(), "pairs")
    if pairs.isEmpty():
        return pairs.select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))
    like = compared(pairs.select("a", "b")).where(F.col("similarity") >= similar)
    return like.join(pairs, ["a", "b"]).select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).distinct()


def named_classes(docs: DataFrame, similar: float = SIMILAR) -> tuple[DataFrame, DataFrame]:
    """(doc_id and text's key of every row with an id; key, class_id and group_id of every distinct text).
    A class is named by its smallest id; where several texts have one smallest id, all are named by
    (id, hash of the text)."""
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    weights = docs.sparkSession.sparkContext.broadcast(frequency_sketch(docs))  # COUNTERS floats

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, SLICE):
            texts = [t or "" for t in part.column("text").to_pylist()]
            text, shingle, often = shingles(texts)
            bands: list = [None] * len(texts)
            if len(text):
                for i, b in zip(*sampled(text, shingle, weights.value.of(shingle, often))):
                    bands[i] = b.astype(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "key", "bands"])

    keyed = docs.where("doc_id is not null").withColumn("key", F.sha2("text", 256))
    signed = materialise(keyed.mapInArrow(sign, f"doc_id {kind}, key string, bands array<long>"), "signatures")
    classes = materialise(signed.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("class_id"), F.first("bands").alias("bands")), "classes")
    first_id = F.col("class_id")
    if not classes.groupBy("class_id").count().where("count > 1").isEmpty():  # texts of one id: classes are named by both
        classes = materialise(classes.withColumn("class_id", F.struct("class_id", F.xxhash64("key").alias("text"))), "classes")
        kind, first_id = classes.schema["class_id"].dataType.simpleString(), F.col("class_id.class_id")

    places = classes.where("bands is not null").select("class_id", F.posexplode("bands").alias("band", "value"))
    lead = places.groupBy("band", "value").agg(F.min("class_id").alias("lead"), F.count("*").alias("n")).where("n > 1").drop("n")
    led = materialise(places.join(lead, ["band", "value"]), "buckets")
    members = led.select("class_id").distinct().join(classes.select("class_id", "key"), "class_id")
    texts = docs.join(members, F.col("doc_id") == first_id).where(F.sha2("text", 256) == F.col("key"))
    texts = materialise(texts.dropDuplicates(["class_id"]).select("class_id", "text"), "candidates")
    led = led.where("class_id > lead")

    def weighed(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        of, s, n = shingles(texts)
        order = np.lexsort((s, of))
        of, s, w = of[order], s[order], weights.value.of(s, n)[order].astype(float)
        at = np.searchsorted(of, np.arange(len(texts) + 1))
        return [(s[i:j], w[i:j]) for i, j in zip(at, at[1:])]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, SLICE):
            a, x, y = (part.column(c).to_pylist() for c in ("a", "x", "y"))
            fresh = [i for i in range(len(a)) if not i or a[i] != a[i - 1]]  # rows of one leader come together
            xs, ys = weighed([x[i] for i in fresh]), weighed(y)
            nth = np.searchsorted(fresh, np.arange(len(a)), "right") - 1
            out = [similarity(xs[k], one) for k, one in zip(nth, ys)]
            yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(out, pa.float64())], ["a", "b", "similarity"])

    def compared(pairs: DataFrame) -> DataFrame:
        met = pairs.join(texts.select(F.col("class_id").alias("b"), F.col("text").alias("y")), "b").join(texts.select(F.col("class_id").alias("a"), F.col("text").alias("x")), "a")
        return materialise(met.select("a", "b", "x", "y").mapInArrow(compare, f"a {kind}, b {kind}, similarity double"), "compared")

    seen = near = roots = late = None
    for _ in range(ROUNDS):
        pairs = led.select(F.col("lead").alias("a"), F.col("class_id").alias("b")).distinct()
        fresh = compared(pairs if seen is None else pairs.join(seen.select("a", "b"), ["a", "b"], "left_anti"))
        seen = fresh if seen is None else seen.unionByName(fresh)
        if roots is None:
            roots = materialise(components(seen.where(F.col("similarity") >= similar)), "roots")
        near = seen.join(roots.select(F.col("node").alias("a"), F.col("root").alias("p")), "a", "left").join(roots.select(F.col("node").alias("b"), F.col("root").alias("q")), "b", "left")
        far = (F.col("similarity") < similar) & (F.coalesce("p", "a") != F.coalesce("q", "b"))
        known = led.join(near.select(F.col("a").alias("lead"), F.col("b").alias("class_id"), "similarity", far.alias("far")), ["lead", "class_id"])
        # 1 - similarity is a metric: one of the leader's group can be like one of another group only if
        # it is as far from the leader as the nearest of those, less 1 - similar.
        others = known.where("far").groupBy("band", "value").agg(F.max("similarity").alias("nearest"))
        left = materialise(known.join(others, ["band", "value"]).where(F.col("far") | (F.col("similarity") <= F.col("nearest") + (1 - similar))).select("class_id", "band", "value", "far"), "left")
        ids = left.select("class_id")
        late = ids if late is None else late.unionByName(ids)
        led = left.where("far").drop("far")
        led = led.join(led.groupBy("band", "value").agg(F.min("class_id").alias("lead"), F.count("*").alias("n")).where("n > 1").drop("n"), ["band", "value"])
        led = materialise(led.where("class_id > lead"), "buckets")
        if led.isEmpty():
            break
    links = seen.where(F.col("similarity") >= similar).select("a", "b")
    roots = materialise(components(links), "roots")
    named = classes.select("key", "class_id").join(roots, F.col("class_id") == F.col("node"), "left").select("key", "class_id", F.coalesce("root", "class_id").alias("root"))
    found = rest_links(late.distinct(), named, texts, weights, compared, similar)
    joined = materialise(components(found), "roots")
    named = named.join(joined.select(F.col("node").alias("root"), F.col("root").alias("low")), "root", "left").select("key", "class_id", F.coalesce("low", "root").alias("group_id"))
    return signed.select("doc_id", "key"), named


def groups(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """doc_id, class_id, group_id: a row for each row of ``docs``. class_id is the smallest id with an
    equal text, group_id the smallest id of the near-duplicate group."""
    rows, named = named_classes(docs, similar)
    if not isinstance(named.schema["class_id"].dataType, type(docs.schema["doc_id"].dataType)):
        named = named.select("key", F.col("class_id.class_id").alias("class_id"), F.col("group_id.class_id").alias("group_id"))
    rows = rows.unionByName(docs.where("doc_id is null").select("doc_id", F.lit(None).cast("string").alias("key")))
    return rows.join(named, "key", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("group_id", "doc_id").alias("group_id"))


def keep_one(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """One row of each group, that of its smallest id; of repeated rows with one id and text one stays.
    Rows with a null id all stay, as do those of a null text, one an id."""
    _, named = named_classes(docs, similar)
    lead = F.col("class_id") if isinstance(named.schema["class_id"].dataType, type(docs.schema["doc_id"].dataType)) else F.col("class_id.class_id")
    heads = named.where("class_id = group_id").select(F.col("key").alias("_key"), lead.alias("_head"))
    keyed = docs.withColumn("_key", F.sha2("text", 256))
    own = keyed.where("doc_id is not null and text is not null").join(heads.withColumnRenamed("_key", "_of"), (F.col("_key") == F.col("_of")) & (F.col("doc_id") == F.col("_head")), "left_semi")
    mute = keyed.where("doc_id is not null and text is null")
    return own.dropDuplicates(["doc_id", "_key"]).unionByName(mute.dropDuplicates(["doc_id"])).select(*docs.columns).unionByName(docs.where("doc_id is null"))


def op5_weighted_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"))
