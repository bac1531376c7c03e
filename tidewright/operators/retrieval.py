"""Exact similarity search over vectors, contexts and prompts, and retrieval metrics."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidewright.functions.text import DOMAIN_WORDS, STOPWORDS, content_words, covered, dot, norm
from tidewright.sources.tables import staged

QUERY_PREFIX = "Represent this sentence for searching relevant passages: "  # fixed: the encoder was trained with it
BLOCK = 4_096  # queries that are broadcast at most
TILE, ROWS = 1 << 20, 1_024  # scores that are held at once, and vectors of the index they are with
PAIRS = 32  # tasks at least, where blocks meet
JOINT = "\n\n---\n\n"
GROUNDED = "Answer from the numbered excerpts. Copy commands, names and paths exactly. Where the excerpts do not cover the question, say so first."
PLAIN = "Answer questions about the documentation precisely."


def hashed_words(dim: int = 256) -> Callable[[list[str]], np.ndarray]:
    """A deterministic stand-in for a neural encoder: signed hashed words, unit length."""
    import zlib

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for row, t in zip(out, texts):
            for w in (t or "").lower().split():
                h = zlib.crc32(w.encode())
                row[h % dim] += 1 if h >> 31 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return encode


_LOADED: dict = {}


def loaded(factory: Callable[[], Callable[[list[str]], np.ndarray]]) -> Callable[[list[str]], np.ndarray]:
    """The factory's encoder, made once in this worker process, whatever the number of its tasks."""
    key = getattr(factory, "key", None) or (factory.__module__, factory.__qualname__)
    if key not in _LOADED:
        _LOADED[key] = factory()
    return _LOADED[key]


def batches_of(texts: list[str], budget: int) -> Iterator[list[str]]:
    """Runs of texts of up to ``budget`` tokens as an encoder pads them: rows by the longest row."""
    held: list[str] = []
    longest = 0
    for t in texts:
        longest = max(longest, len(t) // 4 + 1)
        if held and longest * (len(held) + 1) > budget:
            yield held
            held, longest = [], len(t) // 4 + 1
        held.append(t)
    if held:
        yield held


def embed(df: DataFrame, text: Column, encoder: Callable[[list[str]], np.ndarray] | None = None, factory: Callable[[], Callable] | None = None, budget: int = 16_384) -> DataFrame:
    """Adds ``embedding``. Rows of a partition are sorted by length first, and go to the encoder in batches of
    ``budget`` tokens as padded, so batches are even and their memory is bounded. ``factory``, a module's function
    without arguments (or with an attribute ``key``), makes the encoder once a worker process: for models
    that take long to load; ``encoder`` is sent along with each task."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = loaded(factory) if factory else encoder
        for s in batches:
            out: list = []
            for part in batches_of(s.fillna("").tolist(), budget):
                out += list(encode(part))
            yield pd.Series(out)

    vector = F.pandas_udf(run, "array<float>")
    return df.withColumn("_own", text).sortWithinPartitions(F.length("_own")).withColumn("embedding", vector("_own")).drop("_own")


def embed_queries(df: DataFrame, question: str, encoder, model: str, index_model: str, factory=None) -> DataFrame:
    if model != index_model:
        raise ValueError(f"the index was encoded with {index_model}, the queries would be with {model}")
    return embed(df, F.concat(F.lit(QUERY_PREFIX), F.col(question)), encoder, factory)


def best_matches(q: np.ndarray, batches, k: int, digits: int) -> tuple[np.ndarray, np.ndarray] | None:
    """(scores, keys), k a query, of all (key, vector) batches; None without a vector of that length. Memory is that
    of TILE scores, whatever the number of queries and vectors. Single precision finds what may be among the best,
    with the bound of its error; those are scored in double precision. A score that is no number comes first, as in SQL."""
    rough_q = q.astype(np.float32, copy=False)
    slack = (q.shape[1] + 8) * 2.0**-23 * np.sqrt(np.einsum("ij,ij->i", q, q, dtype=float))
    score, owners, seen = np.empty((len(q), 0)), None, 0
    for batch in batches:
        batch = batch.filter(pa.compute.equal(pa.compute.list_value_length(batch.column(1)), q.shape[1]))
        for at in range(0, batch.num_rows, ROWS):
            ids, vectors = (batch.column(i).slice(at, ROWS) for i in (0, 1))
            ids = ids.to_numpy(zero_copy_only=False)
            x = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
            rough_x = x.astype(np.float32, copy=False).T
            margin = slack * np.sqrt(np.einsum("ij,ij->i", x, x, dtype=float)).max() + 10.0**-digits
            width, seen = min(k, seen + len(ids)), seen + len(ids)
            new_score, new_owners = (score, owners) if score.shape[1] == k else (np.empty((len(q), width)), np.empty((len(q), width), ids.dtype))
            for a in range(0, len(q), TILE // ROWS):
                own = slice(a, a + TILE // ROWS)
                rough = rough_q[own] @ rough_x
                if score.shape[1] == k:
                    low = score[own, -1] - margin[own]
                else:
                    least = min(k, len(ids))
                    low = np.partition(rough, len(ids) - least, axis=1)[:, len(ids) - least] - 2 * margin[own]
                row, col = np.divmod(np.flatnonzero(~(rough < low[:, None].astype(np.float32))), len(ids))
                if not len(row):
                    continue
                found = np.empty(len(row))
                for i in range(0, len(row), step := max(1, TILE // q.shape[1])):
                    found[i : i + step] = np.einsum("ij,ij->i", q[own][row[i : i + step]].astype(float), x[col[i : i + step]].astype(float))
                changed = np.unique(row)
                held = score.shape[1]
                rows = np.concatenate([np.repeat(changed, held), row])
                scores = np.concatenate([score[own][changed].ravel(), np.round(found, digits)])
                keys = np.concatenate([owners[own][changed].ravel(), ids[col]]) if held else ids[col]
                order = np.lexsort((keys, -scores, ~np.isnan(scores), rows))
                first = np.searchsorted(rows[order], changed)
                best = order[first[:, None] + np.arange(width)]
                new_score[a + changed], new_owners[a + changed] = scores[best], keys[best]
            score, owners = new_score, new_owners
    return (score, owners) if seen else None


def blocks_of(n_queries: int, n_vectors: int, dim: int, block: int = BLOCK) -> tuple[int, int]:
    """How many blocks queries and index are dealt into. Each side is sent once for each block of the other, so
    blocks are as large as a task may hold: eight times ``block`` rows, and 8 million numbers."""
    rows = max(1, min(8 * block, 8 * TILE // dim))
    n_q = max(1, -(-n_queries // rows))
    return n_q, max(1, -(-n_vectors // rows), min(-(-PAIRS // n_q), -(-n_vectors // ROWS)))


def top_k(index: DataFrame, queries: DataFrame, k: int, key: str = "chunk_id", query_key: str = "query_id", digits: int = 6, block: int = BLOCK) -> DataFrame:
    """query_id, rank, score, chunk: exact, by dot product; ties by key. Up to ``block`` queries are
    broadcast to the index. More of them are dealt into blocks of up to eight times as many, as is the index, and
    each block of the one meets each of the other in a task, so neither the driver nor a task sees all. A task
    returns k rows a query, which meet in one window over the query. Query vectors that are null, hold nulls or
    differ from most in length have no hits, and vectors of the index that are null, hold nulls or differ from the
    queries' in length are none."""
    q_type, key_type = (to_arrow_type(df.schema[c].dataType) for df, c in ((queries, query_key), (index, key)))
    full = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull())
    dim = queries.where(full).groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    queries = queries.where(full & (F.size("embedding") == (dim["dim"] if dim else 0))).select(query_key, "embedding")
    index = index.where(full).select(key, "embedding")
    kinds = f"{query_key} {queries.schema[query_key].dataType.simpleString()}, {key} {index.schema[key].dataType.simpleString()}, score double"

    def rows_of(q_ids, best: tuple | None) -> dict[str, pa.Array]:
        score, owners = best if best is not None else (np.empty((0, 0)), np.empty((0, 0)))
        many = np.repeat(q_ids, score.shape[1]) if best is not None else []
        return {query_key: pa.array(many, q_type), key: pa.array(owners.ravel(), key_type), "score": pa.array(score.ravel(), pa.float64())}

    if not dim or not dim["dim"]:
        found = queries.select(query_key).join(index.select(key).limit(0)).withColumn("score", F.lit(0.0)).limit(0)
    elif dim["n"] <= block:
        rows = queries.collect()
        shared = index.sparkSession.sparkContext.broadcast((np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)))

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q_ids, q = shared.value
            best = best_matches(q, batches, k, digits)
            if best is not None:
                yield pa.RecordBatch.from_pydict(rows_of(q_ids, best))

        found = index.mapInArrow(part, kinds)
    else:
        # written once, so a lost task meets the same blocks again
        dealt, held = (staged(df.withColumn("row", F.monotonically_increasing_id()), name) for df, name in ((queries, "queries"), (index, "index")))
        n_q, n_i = blocks_of(dealt.count(), held.count(), dim["dim"], block)

        def meet(own: pa.Table, others: pa.Table) -> pa.Table:
            if not own.num_rows or not others.num_rows:
                return pa.table(rows_of([], None))
            own = own.combine_chunks()
            q = own.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(own.num_rows, -1)
            best = best_matches(q, others.select([key, "embedding"]).to_batches(), k, digits)
            return pa.table(rows_of(own.column(query_key).to_numpy(), best))

        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        left = dealt.select(query_key, "embedding", F.pmod("row", F.lit(n_q)).cast("int").alias("q_block"), every(n_i).alias("i_block"))
        right = held.select(key, "embedding", F.pmod("row", F.lit(n_i)).cast("int").alias("i_block"), every(n_q).alias("q_block"))
        found = left.groupBy("q_block", "i_block").cogroup(right.groupBy("q_block", "i_block")).applyInArrow(meet, kinds)
    order = Window.partitionBy(query_key).orderBy(F.desc("score"), key)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def verify_index(index: DataFrame) -> DataFrame:
    """One row: rows, dimension, null vectors, other dimensions, not finite, not of unit length."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    first = index.agg(F.max(F.size("embedding")).alias("dim"))
    return index.crossJoin(first).agg(
        F.count("*").alias("n"), F.max("dim").alias("dim"), F.count_if(F.col("embedding").isNull()).alias("null_vectors"), F.count_if(F.size("embedding") != F.col("dim")).alias("other_dim"),
        F.count_if(bad).alias("not_finite"), F.count_if(F.abs(norm(F.col("embedding")) - 1) > 1e-3).alias("not_unit"),
    )


def self_probe(index: DataFrame, probes: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Each probe's best match among all, with both scores; is_self also if a copy ties."""
    best = top_k(index, probes.select(F.col(key).alias("query_id"), "embedding"), 1, key)
    own = probes.select(F.col(key).alias("query_id"), F.round(dot(F.col("embedding"), F.col("embedding")), 6).alias("own_score"))
    return best.join(own, "query_id").select("query_id", F.col(key).alias("best"), F.col("score").alias("best_score"), "own_score", (F.col(key) == F.col("query_id")).alias("is_self"))


def near_first(index: DataFrame, key: str = "chunk_id", limit: float = 0.9999) -> DataFrame:
    """How many other vectors are all but equal to the first."""
    first = index.agg(F.min_by("embedding", key).alias("v0"), F.min(key).alias("k0"))
    sim = index.crossJoin(F.broadcast(first)).where(F.col(key) != F.col("k0")).withColumn("sim", dot(F.col("embedding"), F.col("v0")))
    return sim.agg(F.count_if(F.col("sim") > limit).alias("near_first"), F.round(F.max("sim"), 6).alias("max_sim"))


def with_text(hits: DataFrame, chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Hits with their chunk's columns; null where it is unknown."""
    return hits.join(chunks, key, "left")


def contexts(hits: DataFrame, max_chars: int = 6000, query_key: str = "query_id") -> DataFrame:
    """query, context, n_blocks, sources: numbered blocks in rank order, up to the first that exceeds
    the budget; the first block always stays."""
    block = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.coalesce("breadcrumb", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")))
    upto = Window.partitionBy(query_key).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    kept = hits.withColumn("block", block).withColumn("used", F.sum(F.length("block")).over(upto)).where((F.col("used") <= max_chars) | (F.col("rank") == 1))
    rows = F.array_sort(F.collect_list(F.struct("rank", F.round("score", 4).alias("score"), "breadcrumb", "chunk_id", "block")))
    out = kept.groupBy(query_key).agg(rows.alias("rows"), F.count("*").alias("n_blocks"))
    return out.select(query_key, F.array_join(F.transform("rows", lambda x: x["block"]), JOINT).alias("context"), "n_blocks", F.transform("rows", lambda x: F.struct(x["rank"], x["score"], x["breadcrumb"], x["chunk_id"])).alias("sources"))


def messages(question: Column, context: Column, grounded: str = GROUNDED, plain: str = PLAIN) -> Column:
    def said(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    user = F.concat(F.lit("Documentation excerpts:\n\n"), context, F.lit("\n\n---\n\nQuestion: "), question)
    return F.when(F.coalesce(context, F.lit("")) != "", F.array(said("system", F.lit(grounded)), said("user", user))).otherwise(F.array(said("system", F.lit(plain)), said("user", question)))


def body(text: Column) -> Column:
    """What follows the first blank line."""
    return F.regexp_replace(text, r"(?s)\A.*?\n\n", "")


def pivot_answers(answers: DataFrame, by: str, mode: str, modes: list[str], *columns: str) -> DataFrame:
    return answers.groupBy(by).pivot(mode, modes).agg(*(F.first(c).alias(c) for c in columns))


def first_pairs(qa: DataFrame, n: int | None, key: str = "qa_id") -> DataFrame:
    """The first ``n`` pairs by key, for a trial evaluation; all without ``n``."""
    return qa if n is None else qa.orderBy(key).limit(n)


def gold_ranks(qa: DataFrame, hits: DataFrame, qa_key: str = "qa_id", gold: str = "gold_chunk_id", key: str = "chunk_id") -> DataFrame:
    """``qa`` with the rank of its gold chunk among its hits; null if missed."""
    found = hits.select(F.col("query_id").alias(qa_key), F.col(key).alias(gold), "rank").groupBy(qa_key, gold).agg(F.min("rank").alias("rank"))
    return qa.join(found, [qa_key, gold], "left")


def metrics(ranks: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10), n_chunks: int | Column | None = None) -> DataFrame:
    """One row: hit@k, MRR cut at the largest k, share found, median rank of the found, chance, lift."""
    r = F.when(F.col("rank") <= max(ks), F.col("rank"))
    hit = [F.round(F.avg(F.coalesce((r <= k).cast("double"), F.lit(0.0))), 6).alias(f"hit_{k}") for k in ks]
    out = ranks.agg(F.count("*").alias("n"), *hit, F.round(F.avg(F.coalesce(1 / r, F.lit(0.0))), 6).alias("mrr"), F.round(F.avg(r.isNotNull().cast("double")), 6).alias("found_frac"), F.median(r).alias("median_rank"))
    if n_chunks is None:
        return out
    chance = F.lit(max(ks)) / n_chunks
    return out.withColumn("chance", F.round(chance, 6)).withColumn("lift", F.round(F.col(f"hit_{max(ks)}") / chance, 4))


def hit_rate(k: int = 5) -> Column:
    return F.round(F.avg(F.coalesce((F.col("rank") <= k).cast("double"), F.lit(0.0))), 6)


def by_area(ranks: DataFrame, area: Column, k: int = 5) -> DataFrame:
    return ranks.groupBy(area.alias("area")).agg(hit_rate(k).alias("hit_5"), F.count("*").alias("n")).orderBy("hit_5", "area")


def question_overlap(question: Column, own: Column) -> Column:
    """Share of a question's content words that its own breadcrumb and answer have."""
    stop = [*STOPWORDS, *DOMAIN_WORDS]
    return covered(content_words(question, stop, glue=False), content_words(own, stop, glue=False))


def overlap_gap(ranks: DataFrame, overlap: str = "overlap", low: float = 0.3, high: float = 0.5, k: int = 5) -> DataFrame:
    """hit@k of questions with little and with much lexical overlap, and the gap; null if a side is
    empty."""
    hit = F.coalesce((F.col("rank") <= k).cast("double"), F.lit(0.0))
    few, much = F.col(overlap) < low, F.col(overlap) >= high
    out = ranks.agg(F.count_if(few).alias("n_low"), F.count_if(much).alias("n_high"), F.avg(F.when(few, hit)).alias("l"), F.avg(F.when(much, hit)).alias("h"))
    return out.select("n_low", "n_high", F.round("l", 6).alias("hit_low"), F.round("h", 6).alias("hit_high"), F.round(F.col("h") - F.col("l"), 6).alias("gap"))


def orphans(qa: DataFrame, index: DataFrame, gold: str = "gold_chunk_id", key: str = "chunk_id") -> DataFrame:
    return qa.join(index.select(F.col(key).alias(gold)).distinct(), gold, "left_anti")
