"""Question/answer pairs: sampling, requests, response parsing, validation, deduplication, reports."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.text import content_words, normalize, strip, words
from tidewright.operators import redundancy
from tidewright.sources.tables import SLICE, staged

# Phrases by which a question gives its source away, in order of precedence.
BANNED = [
    "this document", "the document", "this passage", "the passage", "this section", "the section", "the above", "mentioned above",
    "according to the", "in the text", "this chunk", "the excerpt", "as described", "the following text", "this page", "the tutorial above",
]
SOURCED = ["the passage", "this document", "the above", "the section states"]
REFUSED = ["i don't know", "not specified", "unclear from", "cannot be determined"]
MAX_OVERLAP, REDUNDANT = 0.6, 0.45
PARSED = "struct<suitable: boolean, questions: array<struct<question: string, answer: string>>>"


def sample_chunks(chunks: DataFrame, max_chunks: int | None, max_per_doc: int, seed: int) -> DataFrame:
    """At most ``max_per_doc`` chunks a document, those with code first, then ``max_chunks`` in an order
    that depends on the seed alone; sample_ord numbers them from 0. All of them without ``max_chunks``."""
    first, second = (F.md5(F.concat_ws("|", F.lit(str(seed + k)), F.col("chunk_id").cast("string"))) for k in (0, 1))
    by = Window.partitionBy("doc_id").orderBy(F.desc("has_code"), first, "chunk_id")
    picked = chunks.withColumn("nth", F.row_number().over(by)).where(F.col("nth") <= max_per_doc).drop("nth").withColumn("draw", second)
    if max_chunks is not None:
        picked = picked.orderBy("draw", "chunk_id").limit(max_chunks)
    return numbered(picked, ["draw", "chunk_id"], "sample_ord").drop("draw")


def numbered(df: DataFrame, order: list[str], name: str, partitions: int = 64) -> DataFrame:
    """A gapless number from 0 in the given order: range partitions are numbered on their own and
    shifted by the rows before them, so no task sees all rows. The parts are written once: bounds of a
    second evaluation may differ, and its counts would not fit the ranks of the first. Columns of the
    frame keep their names, whatever they are."""
    part, nth, before, n = (f"_{name}_{x}" for x in ("part", "nth", "before", "n"))
    ranged = staged(df.repartitionByRange(partitions, *order).withColumn(part, F.spark_partition_id()), "ranged")
    counts = ranged.groupBy(part).agg(F.count("*").alias(n))
    shift = counts.select(part, (F.sum(n).over(Window.orderBy(part)) - F.col(n)).alias(before))  # one row a partition
    own = F.row_number().over(Window.partitionBy(part).orderBy(*order)) - 1
    return ranged.withColumn(nth, own).join(F.broadcast(shift), part).withColumn(name, (F.col(before) + F.col(nth)).cast("long")).drop(part, nth, before)


def cache_key(chunk_id: Column, model: str, n: int) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", chunk_id.cast("string"), F.lit(model), F.lit(str(n))), 256), 1, 20)


def requests(chunks: DataFrame, system: str, model: str, n: int) -> DataFrame:
    """One generation request a sampled chunk."""
    user = F.concat(F.lit("Documentation section: "), "breadcrumb", F.lit("\n\n--- PASSAGE START ---\n"), "content", F.lit(f"\n--- PASSAGE END ---\n\nWrite {n} question-answer pairs following the rules. JSON only."))
    return chunks.select(cache_key(F.col("chunk_id"), model, n).alias("cache_key"), "chunk_id", "sample_ord", F.lit(system).alias("system"), user.alias("user"), F.lit(model).alias("model"), F.lit(n).alias("n"))


def unanswered(asked: DataFrame, responses: DataFrame) -> DataFrame:
    return asked.join(responses.select("cache_key").distinct(), "cache_key", "left_anti")


def answered(asked: DataFrame, responses: DataFrame, latest: str | None = None) -> DataFrame:
    """Requests with their response. Of several responses of one key that with the greatest ``latest``
    counts, and of those, or without it, the least text."""
    one = F.min("raw") if latest is None else F.max_by("raw", F.struct(latest, F.hex("raw")))
    return asked.join(responses.groupBy("cache_key").agg(one.alias("raw")), "cache_key")


def tolerant(raw: str | None) -> tuple[bool, list[tuple[str, str]]] | None:
    """(suitable, pairs) of a response; None if it isn't an object or is empty. A fence around it or
    text before and after the outermost braces is let pass."""
    text = re.sub(r"\s*```$", "", re.sub(r"^```(?:json)?\s*", "", (raw or "").strip()))
    got = None
    for candidate in (text, text[text.find("{") : text.rfind("}") + 1] if "{" in text else ""):
        try:
            got = json.loads(candidate)
            break
        except ValueError:
            continue
    if not isinstance(got, dict) or not got:
        return None
    pairs = got.get("questions")
    items = [x if isinstance(x, dict) else {} for x in pairs] if isinstance(pairs, list) else []
    return bool(got.get("suitable", True)), [(str(x.get("question", "")), str(x.get("answer", ""))) for x in items]


def parse_responses(responses: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds ``parsed``; null where the response is of no use. A task parses a slice of its responses at a time."""

    def parsed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), SLICE):
                got = [tolerant(x) for x in batch.iloc[at : at + SLICE]]
                yield pd.DataFrame({"suitable": pd.array([None if g is None else g[0] for g in got], dtype="boolean"), "questions": [None if g is None else [{"question": q, "answer": a} for q, a in g[1]] for g in got]})

    parsed = F.pandas_udf(parsed, PARSED)
    return responses.withColumn("p", parsed(raw)).withColumn("parsed", F.when(F.col("p.suitable").isNotNull(), F.col("p"))).drop("p")


def explode_pairs(parsed: DataFrame) -> DataFrame:
    """One row a generated pair of a suitable chunk, with its place in the response; one row with an
    ``outcome`` instead for a response that can't be parsed or finds its chunk unsuitable."""
    outcome = F.when(F.col("parsed").isNull(), "unparseable_response").when(~F.col("parsed.suitable"), "unsuitable_chunk")
    marked = parsed.withColumn("outcome", outcome).withColumn("pairs", F.when(F.col("outcome").isNull(), F.col("parsed.questions"))).drop("parsed")
    rows = marked.select("*", F.posexplode_outer("pairs").alias("item_idx", "pair")).where("outcome is not null or pair is not null")
    return rows.select("*", "pair.question", "pair.answer").drop("pairs", "pair")


def generated(asked: DataFrame, responses: DataFrame, chunks: DataFrame, latest: str | None = None) -> DataFrame:
    """Pairs of the responses to ``asked``, each with its request's sample_ord and its source chunk's
    columns; see explode_pairs."""
    raw = answered(asked.select("cache_key", "chunk_id", "sample_ord", "model"), responses, latest)
    rows = explode_pairs(parse_responses(raw)).drop("raw", "cache_key")
    return rows.join(chunks.drop("sample_ord", "model"), "chunk_id").withColumnRenamed("chunk_id", "gold_chunk_id")


def qa_pairs(gated: DataFrame, provider: str) -> DataFrame:
    """The accepted pairs of ``gated`` as the table of pairs, numbered through in order of the sample and
    of the response: qa_id is the chunk's id with the pair's number."""
    ok = numbered(gated.where("reason is null"), ["sample_ord", "item_idx", "gold_chunk_id"], "ordinal")
    qa_id = F.concat(F.col("gold_chunk_id").cast("string"), F.lit("::q"), F.col("ordinal").cast("string"))
    return ok.select(qa_id.alias("qa_id"), strip(F.col("question")).alias("question"), strip(F.col("answer")).alias("answer"), *(F.col(c).cast("string").alias(c) for c in ("gold_chunk_id", "doc_id", "breadcrumb", "url")), F.lit(provider).alias("provider"), "model")


def longest_run(answer: str | None, content: str | None) -> float:
    """Longest run of the answer's words that the content has too, by the answer's words; 1 if it has
    none. Extends, at each content word, the runs that end at the word before."""
    a, c = (re.sub(r"[^a-z0-9 ]", "", (t or "").lower()).split() for t in (answer, content))
    if not a:
        return 1.0
    places: dict[str, list[int]] = {}
    for i, w in enumerate(a):
        places.setdefault(w, []).append(i)
    best, ends = 0, {}
    for w in c:
        ends = {i: ends.get(i - 1, 0) + 1 for i in places.get(w, ())}
        best = max(best, max(ends.values(), default=0))
    return best / len(a)


def overlap_ratio(answer: Column, content: Column) -> Column:
    @F.pandas_udf("double")
    def ratio(a: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([longest_run(x, y) for x, y in zip(a, c)], dtype=float)

    return ratio(answer, content)


def extracted(own: Column, within: Column, max_overlap: float = MAX_OVERLAP) -> Column:
    """Whether more than ``max_overlap`` of the words ``own`` are one run of the text ``within`` (words with a
    space before and after each); true if there are none and ``max_overlap`` is under 1. Both are best
    columns, as each is read several times.

    A run of more than half of the words has the middle ones in it, whatever its start: most pairs are
    settled by one search for those."""
    n = F.size(own)
    low = F.floor(n * F.lit(max_overlap)).cast("int")
    least = F.when(low / n > max_overlap, low).when((low + 1) / n > max_overlap, low + 1).otherwise(low + 2)
    run = lambda start, length: F.contains(within, F.concat(F.lit(" "), F.array_join(F.slice(own, start, length), " "), F.lit(" ")))
    middle = F.when(2 * least > n, run(n - least + 1, 2 * least - n)).otherwise(True)
    return F.when(n == 0, F.lit(max_overlap < 1)).when((least > n) | ~middle, False).otherwise(F.exists(F.sequence(F.lit(1), n - least + 1), lambda i: run(i, least)))


def any_of(c: Column, phrases: list[str]) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(c, F.lit(p))
    return out


def rejection(q: Column, a: Column, lower_q: Column, lower_a: Column, extract: Column) -> Column:
    """The first reason to reject a pair, or null. ``q`` and ``a`` are without white space at either end, also
    in lower case; best columns, as each is read several times. ``extract``: see extracted."""
    banned = F.coalesce(*(F.when(F.contains(lower_q, F.lit(p)), p) for p in BANNED))
    return (
        F.when(F.length(q) < 15, "question_too_short").when(F.length(q) > 400, "question_too_long").when(~q.endswith("?"), "question_not_a_question").when(F.length(a) < 30, "answer_too_short")
        .when(banned.isNotNull(), F.concat(F.lit("meta_reference:"), banned)).when(any_of(lower_a, SOURCED), "answer_references_source").when(any_of(lower_a, REFUSED), "answer_is_refusal")
        .when(extract, "answer_is_extraction")
    )


def validate(pairs: DataFrame, max_overlap: float = MAX_OVERLAP) -> DataFrame:
    """Adds reason to (question, answer, content). A null answer or content counts as empty. Whole texts are
    compared in the JVM; how long the run is, ``overlap_ratio`` tells."""
    blank = F.lit("")
    bare = pairs.withColumns({"_bare_q": strip(F.col("question")), "_bare_a": strip(F.col("answer"))})
    within = F.concat(F.lit(" "), F.array_join(words(normalize(F.coalesce("content", blank))), " "), F.lit(" "))
    read = bare.withColumns({"_bare_lower_q": F.lower("_bare_q"), "_bare_lower_a": F.lower("_bare_a"), "_bare_own_words": words(normalize(F.coalesce("_bare_a", blank))), "_bare_in_words": within})
    own = [F.col(c) for c in ("_bare_q", "_bare_a", "_bare_lower_q", "_bare_lower_a")]
    reason = rejection(*own, extracted(F.col("_bare_own_words"), F.col("_bare_in_words"), max_overlap))
    return read.withColumn("reason", reason).drop(*(set(read.columns) - set(pairs.columns)))


def first_questions(valid: DataFrame, order: list[str], among: Column | None = None) -> DataFrame:
    """Adds ``first``: whether a pair is the first with its normalised question, of the pairs for which
    ``among`` holds, if given; others are left out. The first is found by partial aggregation, so a very common
    question costs its tasks a row each. The pairs are written once: they are read twice, and a filter on what
    validation computes would be pushed below it, with a copy of its patterns for each use."""
    keyed = valid.withColumn("norm_q", normalize(F.col("question"))).withColumn("_among", F.lit(True) if among is None else among)
    keyed = staged(keyed, "questions").where("_among").drop("_among")
    low = keyed.groupBy("norm_q").agg(F.min(F.struct(*order)).alias("low"))
    return keyed.join(low, "norm_q").withColumn("first", F.struct(*order) == F.col("low")).drop("low")


def redundant_rows(rows: DataFrame, key: str, order: str, threshold: float = REDUNDANT) -> DataFrame:
    """_row of the redundant among written ``rows`` (_row, answer, key, order)."""
    at = F.struct(F.col(order), F.xxhash64("answer"), F.col("_row"))
    items = rows.select(F.col(key).alias("key"), at.alias("at"), F.col("_row").alias("id"), content_words(F.col("answer")).alias("words"))
    return redundancy.greedy(items, threshold).select(F.col("id").alias("_row"), F.lit(True).alias("_gone"))


def redundant(pairs: DataFrame, key: str, order: str, threshold: float = REDUNDANT) -> DataFrame:
    """Adds ``redundant``: whether an answer's content words are like those of an answer kept before it
    in the same chunk (a null key is a chunk too). Ties of the order go by the answer. See
    ``redundancy.greedy`` for chunks of any size."""
    rows = staged(pairs.withColumn("_row", F.monotonically_increasing_id()), "pairs")
    marks = redundant_rows(rows, key, order, threshold)
    return rows.join(marks, "_row", "left").withColumn("redundant", F.coalesce("_gone", F.lit(False))).drop("_row", "_gone")


def gate(pairs: DataFrame, order: list[str], key: str = "gold_chunk_id", item: str = "item_idx", max_overlap: float = MAX_OVERLAP) -> DataFrame:
    """All gates in order, with one ``reason`` column: an outcome that the pairs bring along, validation,
    first question, redundant answer. Pairs are validated once and written; the gates then only add to
    the reason. ``order``: of all pairs, by which the first of equal questions is found."""
    names = [c for c in pairs.columns if c != "outcome"]
    brought = F.col("outcome") if "outcome" in pairs.columns else F.lit(None).cast("string")
    checked = validate(pairs, max_overlap).withColumn("reason", F.coalesce(brought, F.col("reason"))).withColumn("_norm", normalize(F.col("question")))
    checked = staged(checked.select(*names, "_norm", "reason", F.monotonically_increasing_id().alias("_row")), "checked")
    low = checked.where("reason is null").groupBy("_norm").agg(F.min(F.struct(*order, "_row")).alias("_low"))
    later = F.col("reason").isNull() & (F.struct(*order, "_row") > F.col("_low"))
    once = checked.join(low, "_norm", "left").withColumn("reason", F.when(later, "duplicate_question").otherwise(F.col("reason"))).drop("_low", "_norm")
    marks = redundant_rows(staged(once.where("reason is null").select("_row", "answer", *{key, item}), "firsts"), key, item)
    again = F.when(F.col("reason").isNull() & F.col("_gone"), "redundant_answer_same_chunk")
    return once.join(marks, "_row", "left").withColumn("reason", F.coalesce("reason", again)).select(*names, "reason")


def reject_report(gated: DataFrame) -> DataFrame:
    """Rows by outcome, most first, with their share of all attempts. An unsuitable chunk is an outcome
    but no attempt."""
    counts = gated.groupBy(F.coalesce("reason", F.lit("accepted")).alias("outcome")).agg(F.count("*").alias("n"))
    tried = F.when(F.col("outcome") != "unsuitable_chunk", F.col("n"))
    total = F.sum(tried).over(Window.partitionBy(F.lit(1)))  # one row an outcome
    return counts.withColumn("share", F.round(tried / total, 6)).orderBy(F.desc("n"), "outcome")


def coverage(gated: DataFrame) -> DataFrame:
    """One row: attempts, accepted pairs, unsuitable and unparseable responses, documents and chunks."""
    ok = F.col("reason").isNull()
    unfit = F.coalesce(F.col("reason") == "unsuitable_chunk", F.lit(False))
    return gated.agg(
        F.count_if(~unfit).alias("attempted"), F.count_if(ok).alias("accepted"), F.count_if(unfit).alias("unsuitable"), F.count_if(F.col("reason") == "unparseable_response").alias("unparseable"),
        F.countDistinct(F.when(ok, F.col("doc_id"))).alias("docs"), F.countDistinct(F.when(ok, F.col("gold_chunk_id"))).alias("chunks"),
    )


def sample_report(chunks: DataFrame, sample: DataFrame, n: int) -> DataFrame:
    """One row: chunks and documents of the corpus and of the sample, and the pairs to be asked for."""
    of = lambda df, name: df.agg(F.count("*").alias(f"{name}_chunks"), F.countDistinct("doc_id").alias(f"{name}_docs"))
    return of(chunks, "corpus").crossJoin(of(sample, "sample")).withColumn("target_pairs", F.col("sample_chunks") * n)
