"""Train and validation by whole documents, and the leakage gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.text import DOMAIN_WORDS, STOPWORDS, normalize, top_dir, words
from tidewright.sources.tables import staged

HARD = ("shared_docs", "shared_chunks", "shared_questions")


def draw(seed: int, column: str):
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(column).cast("string")))


def validation_documents(pairs: DataFrame, val_frac: float, seed: int, area=None) -> DataFrame:
    """doc_id of the validation side. Per area, documents in drawn order are taken until the area's
    budget of pairs is met; one that would exceed twice the budget is passed over once something is
    taken.

    Only a document with more pairs than the whole budget can be passed over, and an area has fewer
    than 1 / val_frac of those: they alone are folded in order. All others are taken as long as the
    running sum before them, with the large ones taken so far, is below the budget; that sum comes from
    those of ``draw``'s first three digits and of the documents of one such bin, so no task meets an area."""
    docs = pairs.groupBy("doc_id").agg(F.count("*").alias("n")).withColumn("area", top_dir(F.col("doc_id").cast("string")) if area is None else area)
    docs = docs.withColumn("area", F.struct("area"))  # compares as equal where null
    docs = docs.withColumn("draw", draw(seed, "doc_id")).withColumn("bin", F.substring("draw", 1, 3))
    budget = docs.groupBy("area").agg((F.sum("n") * F.lit(float(val_frac))).alias("target")).where("target > 0")
    docs = staged(docs.join(budget, "area").withColumn("large", F.col("n") > F.col("target")), "split-documents")
    small = F.when(~F.col("large"), F.col("n")).otherwise(0)
    bins = docs.groupBy("area", "bin").agg(F.sum(small).alias("of"))  # 4096 an area
    bins = bins.select("area", "bin", (F.sum("of").over(Window.partitionBy("area").orderBy("bin")) - F.col("of")).alias("upto"))
    inside = F.sum(small).over(Window.partitionBy("area", "bin").orderBy("draw", "doc_id").rowsBetween(Window.unboundedPreceding, -1))
    placed = docs.withColumn("inside", F.coalesce(inside, F.lit(0))).join(bins, ["area", "bin"])
    placed = staged(placed.select("area", "doc_id", "n", "draw", "large", "target", (F.col("upto") + F.col("inside")).alias("before")), "split-documents")

    place = F.struct("draw", "doc_id")
    one = F.struct("draw", "doc_id", "n", "before")
    kind = placed.schema["doc_id"].dataType.simpleString()
    start = F.array().cast(f"array<struct<draw: string, doc_id: {kind}, upto: bigint>>")
    taken = lambda acc: F.coalesce(F.get(acc, F.size(acc) - 1)["upto"], F.lit(0))  # noqa: E731  pairs of large ones so far
    large = placed.where("large").groupBy("area").agg(F.array_sort(F.collect_list(one)).alias("all"), F.first("target").alias("goal"))
    folded = F.aggregate(
        "all", start,
        lambda acc, d: F.when((d["before"] + taken(acc) >= F.col("goal")) | ((d["before"] + taken(acc) > 0) & (d["before"] + taken(acc) + d["n"] > F.col("goal") * 2)), acc)
        .otherwise(F.array_append(acc, F.struct(d["draw"].alias("draw"), d["doc_id"].alias("doc_id"), (taken(acc) + d["n"]).alias("upto")))),
    )
    large = large.select("area", folded.alias("picked"))
    joined = placed.join(large, "area", "left").withColumn("picked", F.coalesce("picked", start))
    earlier = F.filter("picked", lambda x: F.struct(x["draw"], x["doc_id"]) < place)
    rest = F.col("before") + F.coalesce(F.array_max(F.transform(earlier, lambda x: x["upto"])), F.lit(0)) < F.col("target")
    return joined.where(F.when(F.col("large"), F.exists("picked", lambda x: x["doc_id"] == F.col("doc_id"))).otherwise(rest)).select("doc_id")


def split(pairs: DataFrame, val_frac: float = 0.1, seed: int = 42, area=None) -> DataFrame:
    """Adds ``split``; every pair gets one, a pair without a document too. Write with ``write_split``."""
    val = validation_documents(pairs, val_frac, seed, area).select(F.col("doc_id").alias("_doc"))
    return pairs.join(val, F.col("doc_id").eqNullSafe(F.col("_doc")), "left").withColumn("split", F.when(F.col("_doc").isNotNull(), "val").otherwise("train")).drop("_doc")


def describe(rows: DataFrame, area=None) -> DataFrame:
    """Per side: pairs, documents, share with code, upper median and longest answer, four largest areas."""
    area = top_dir(F.col("doc_id").cast("string")) if area is None else area
    length = F.length("answer")
    base = rows.groupBy("split").agg(F.count("*").alias("pairs"), F.countDistinct("doc_id").alias("docs"), F.round(F.avg(F.contains("answer", F.lit("```")).cast("int")), 6).alias("with_code"), F.max(length).alias("longest"))
    by_length = rows.groupBy("split", length.alias("len")).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("split").orderBy("len"))
    total = F.sum("n").over(Window.partitionBy("split"))
    middle = by_length.select("split", "len", upto.alias("upto"), total.alias("total")).where(F.col("upto") > F.floor(F.col("total") / 2)).groupBy("split").agg(F.min("len").alias("median_answer"))
    areas = rows.groupBy("split", area.cast("string").alias("area")).agg(F.count("*").alias("n"))
    top = areas.withColumn("k", F.row_number().over(Window.partitionBy("split").orderBy(F.desc("n"), "area"))).where("k <= 4")
    top = top.groupBy("split").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "area", "n"))), lambda x: F.concat(x["area"], F.lit(":"), x["n"].cast("string"))), ",").alias("top_areas"))
    return base.join(middle, "split").join(top, "split").withColumn("share", F.round(F.col("pairs") / F.sum("pairs").over(Window.partitionBy(F.lit(1))), 6))


def coverages(rows: DataFrame) -> DataFrame:
    """qa_id, coverage: share of a validation question's content words that training questions have. A
    word's hit is joined by key; the vocabulary is not broadcast."""
    stop = F.array(*map(F.lit, [*STOPWORDS, *DOMAIN_WORDS]))
    own = F.array_except(F.array_distinct(words(normalize(F.col("question")))), stop)
    each = rows.select("split", "qa_id", F.explode(own).alias("word"))
    vocabulary = each.where("split = 'train'").select("word").distinct().withColumn("hit", F.lit(1.0))
    return each.where("split = 'val'").join(vocabulary, "word", "left").groupBy("qa_id").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("coverage"))


def leakage(rows: DataFrame) -> DataFrame:
    """One row: what both sides share (must be 0), median coverage, share of high coverage. All keys are
    grouped together, once, with a row of each side and key; with coverage's two that is three passes over
    ``rows``: pass a written split."""
    keys = {"shared_docs": F.col("doc_id").cast("string"), "shared_chunks": F.col("gold_chunk_id").cast("string"), "shared_questions": normalize(F.col("question"))}
    each = rows.select("split", F.explode(F.array(*(F.struct(F.lit(kind).alias("kind"), key.alias("key")) for kind, key in keys.items()))).alias("k"))
    sides = each.groupBy("k.kind", "k.key").agg(F.min("split").alias("low"), F.max("split").alias("high"))
    hard = sides.agg(*(F.count_if((F.col("kind") == kind) & (F.col("low") < F.col("high"))).alias(kind) for kind in keys))
    soft = coverages(rows).agg(F.coalesce(F.round(F.median("coverage"), 6), F.lit(0.0)).alias("median_vocab_coverage"), F.coalesce(F.round(F.avg((F.col("coverage") > 0.9).cast("double")), 6), F.lit(0.0)).alias("high_coverage_frac"))
    return hard.crossJoin(soft)


def write_split(rows: DataFrame, path: str, seed: int = 42) -> None:
    """JSON lines by side, each in an order drawn by the seed, only if nothing hard is shared. The rows are
    written once, and gate and output read that."""
    rows = staged(rows, "split")
    found = leakage(rows).first()
    if any(found[c] for c in HARD):
        raise ValueError("the split leaks: " + ", ".join(f"{c}={found[c]}" for c in HARD))
    order = ["split", draw(seed, "qa_id"), F.col("qa_id")]  # a side in order over its files, many tasks to a side
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy("split").mode("overwrite").json(path)
