"""Operator 3: language-model scores by prediction by partial matching over bytes.

The model is a trie of byte contexts up to ``ORDER``, counted over the learning folds. A symbol is
coded in its longest context that has been seen; where it hasn't followed that context, an escape
(method C: as many counts as there are symbols in the context) goes to the next shorter one, in which
the symbols of the longer one are excluded. Below order 0 the symbols not seen at all are equally
likely. A text's score is log10 of the product over its bytes, A-Z in lower case, and its end.

Neither the trie nor the vocabulary is broadcast: both grow with the corpus. Texts are dealt into
blocks of about ``BLOCK_BYTES``. A block lists its distinct words and byte grams with their counts in
its learning texts; the lists are summed by key; the trie's subtrees below the last two bytes turn
counts into log probabilities, each subtree in one task; and every block gets back the values for
its own list, to score its texts. Only order 1 and below, at most 257 x 257 counts, go to all tasks.

Words are runs of bytes other than space and 9 to 13; each text ends with one more token. Words are
keyed by 63-bit hashes, below 0; grams are keyed by themselves.

Defined results: a null text is scored as the empty one, whose only token and symbol is the end;
without learning texts all symbols are equally likely; repeated rows stay repeated and count each; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, materialise, release, span_hashes, table

ORDER = 5
BLOCK_BYTES = 28_000_000
CHUNK_BYTES = 500_000  # of a block's texts, in arrays at a time
SYMBOLS = 257  # the bytes, and the end, which also stands before the first byte
EDGE = 256
BITS = 9
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
BLANK = np.isin(np.arange(256), [32, *range(9, 14)])
SIGN = np.uint64(1 << 63)
END_KEY = -(1 << 63)  # of the token that ends a text


def chunks(texts: pa.ChunkedArray) -> Iterator[tuple[int, list[str | None]]]:
    """(number of the first, texts) of about CHUNK_BYTES, or a single longer one."""
    size = pa.compute.binary_length(texts).fill_null(0).to_numpy().astype(np.int64)
    at = 0
    while at < len(size):
        n = max(1, int(np.searchsorted(np.cumsum(size[at : at + 100_000]), CHUNK_BYTES, "right")))
        yield at, texts.slice(at, n).to_pylist()
        at += n


class Chunk:
    """The words and grams of some texts, in arrays over all of them."""

    def __init__(self, texts: list[str | None]):
        data = [(t or "").encode().translate(LOWER) for t in texts]
        size = np.fromiter(map(len, data), np.int64, len(data))
        a = np.frombuffer(b"".join(data), np.uint8)
        text = np.repeat(np.arange(len(data)), size)  # of each byte

        word = ~BLANK[a]
        fresh = np.ones(len(a), bool)
        fresh[1:] = text[1:] != text[:-1]
        begin, stop = word.copy(), word.copy()
        begin[1:] &= ~word[:-1] | fresh[1:]
        stop[:-1] &= ~word[1:] | fresh[1:]
        starts = np.flatnonzero(begin)
        hashes = span_hashes(a, starts, np.flatnonzero(stop) + 1) >> np.uint64(1)
        self.words = (np.maximum(hashes, np.uint64(1)) | SIGN).astype(np.int64)
        self.word_text = text[starts]

        # ORDER edges before each text and one after it
        gap = ORDER + 1
        s = np.full(len(a) + gap * len(data), EDGE, np.uint64)
        s[np.arange(len(a)) + gap * text + ORDER] = a
        code = np.zeros(max(0, len(s) - ORDER), np.uint64)
        for k in range(gap):
            code = (code << np.uint64(BITS)) | s[k : len(s) - ORDER + k]
        at = np.arange(len(a) + len(data)) + ORDER * np.repeat(np.arange(len(data)), size + 1)
        self.grams = code[at].astype(np.int64)
        self.gram_text = np.repeat(np.arange(len(data)), size + 1)


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    key, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key)
    key, n = key[order], n[order]
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[at], np.add.reduceat(n, at)


def listed(block: int, texts: pa.ChunkedArray, learn: np.ndarray) -> pa.Table:
    """block, key, n: the block's distinct words and grams with their counts in learning texts."""
    keys, counts, held = [np.array([END_KEY])], [np.array([int(learn.sum())])], 0
    for first, some in chunks(texts):
        b, own = Chunk(some), learn[first : first + len(some)]
        for k, of in ((b.words, b.word_text), (b.grams, b.gram_text)):
            learned = own[of]
            for part, weight in ((k[learned], 1), (k[~learned], 0)):
                distinct, n = np.unique(part, return_counts=True)
                keys.append(distinct)
                counts.append(n * weight)
                held += len(distinct)
        if held > 1_500_000:
            key, n = summed(keys, counts)
            keys, counts, held = [key], [n], 0
    key, n = summed(keys, counts)
    return pa.table({"block": pa.array(np.full(len(key), block, np.int32)), "key": pa.array(key), "n": pa.array(n)})


def levels(grams: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of order k: sorted (context, symbol) keys, their counts, sorted contexts, context of each key."""
    keys, at = np.unique(grams & ((1 << BITS * (k + 1)) - 1), return_inverse=True)
    contexts, of = np.unique(keys >> BITS, return_inverse=True)
    return keys, np.bincount(at, weights=counts, minlength=len(keys)), contexts, of


def find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of ``wanted`` in sorted ``keys``, -1 where it is not."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def code_lengths(grams: np.ndarray, counts: np.ndarray, pairs: np.ndarray, order: int = ORDER) -> np.ndarray:
    """log10 probabilities of grams that share their last two context symbols; ``counts`` are 0 for
    those not in the learning texts; ``pairs`` has the counts of (symbol, next symbol) of all texts."""
    seen = counts > 0
    left = np.ones(len(grams), bool)
    out = np.zeros(len(grams))
    above: tuple | None = None  # (sorted contexts, symbols of each, its symbols' counts one order below)
    for k in range(order, -1, -1):
        if k >= 2:
            keys, n, contexts, of = levels(grams[seen], counts[seen], k)
        else:
            table = pairs if k == 1 else pairs.sum(0, keepdims=True)
            row, symbol = np.nonzero(table)
            keys, n = (row << BITS) | symbol, table[row, symbol].astype(float)
            contexts, of = np.unique(row, return_inverse=True)
        total = np.bincount(of, weights=n, minlength=len(contexts))
        kinds = np.bincount(of, minlength=len(contexts)).astype(float)
        own = grams & ((1 << BITS * (k + 1)) - 1)
        c, e = find(contexts, own >> BITS), find(keys, own)
        known = left & (c >= 0)
        weight, escape = np.where(c >= 0, total[c] if len(total) else 0.0, 0.0), np.where(c >= 0, kinds[c] if len(kinds) else 0.0, 0.0)
        if above is not None:
            up_keys, up_contexts, up_of = above
            below = n[find(keys, up_keys & ((1 << BITS * (k + 1)) - 1))] if len(up_keys) else np.empty(0)
            excluded = np.bincount(up_of, weights=below, minlength=len(up_contexts))
            met = np.bincount(up_of, minlength=len(up_contexts))
            u = find(up_contexts, (grams >> BITS) & ((1 << BITS * (k + 1)) - 1))
            weight = weight - np.where(u >= 0, excluded[u] if len(excluded) else 0.0, 0.0)
            escape = escape - np.where(u >= 0, met[u] if len(met) else 0.0, 0.0)
        hit = known & (e >= 0)
        out[hit] += np.log10(n[e[hit]] / (weight[hit] + escape[hit]))
        miss = known & (e < 0) & (escape > 0)
        out[miss] += np.log10(escape[miss] / (weight[miss] + escape[miss]))
        left &= ~hit
        above = (keys, contexts, of)
    if left.any():
        out[left] -= np.log10(SYMBOLS - np.count_nonzero(pairs.sum(0)))
    return out


def score(docs: DataFrame, learn=None) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score; ``learn`` is the condition on rows
    to learn from, every row by default."""
    learn = F.lit(True) if learn is None else learn
    docs = docs.select("doc_id", "text", F.coalesce(learn, F.lit(False)).alias("learn"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(6, -(-n_bytes // BLOCK_BYTES))
    dealt = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(blocks)).cast("int"))

    def lists(t: pa.Table) -> pa.Table:
        out = listed(t.column("block")[0].as_py(), t.column("text"), t.column("learn").to_numpy(zero_copy_only=False).astype(bool))
        release()
        return out

    wanted = materialise(dealt.select("block", "text", "learn").groupBy("block").applyInArrow(lists, "block int, key long, n long"), "ppm-lists")
    totals = materialise(wanted.groupBy("key").agg(F.sum("n").alias("n")), "ppm-totals")
    total, vocabulary = totals.where("key < 0").agg(F.sum("n"), F.count_if(F.col("n") > 0)).first()
    total = total or 0
    floor = total + 0.5 * (vocabulary + 1)

    pair = F.col("key").bitwiseAND(F.lit((1 << 2 * BITS) - 1))
    pairs = np.zeros((SYMBOLS, SYMBOLS))
    for r in totals.where("key >= 0 and n > 0").groupBy(pair.alias("pair")).agg(F.sum("n").alias("n")).collect():  # SYMBOLS squared
        pairs[r["pair"] >> BITS, r["pair"] & ((1 << BITS) - 1)] = r["n"]
    shared = docs.sparkSession.sparkContext.broadcast(pairs)

    def subtree(t: pa.Table) -> pa.Table:
        g, n = t.column("key").to_numpy(), t.column("n").to_numpy().astype(float)
        return pa.table({"key": pa.array(g), "n": pa.nulls(len(g), pa.int64()), "value": pa.array(code_lengths(g, n, shared.value).astype(np.float32))})

    last_two = F.shiftright("key", BITS).bitwiseAND(F.lit((1 << 2 * BITS) - 1))
    lengths = totals.where("key >= 0").withColumn("suffix", last_two).groupBy("suffix").applyInArrow(subtree, "key long, n long, value float")
    values = totals.where("key < 0").select("key", "n", F.lit(None).cast("float").alias("value")).unionByName(lengths)
    answers = wanted.select("block", "key").join(values, "key").select("block", "key", "n", "value")

    def scored(texts: pa.Table, values: pa.Table) -> pa.Table:
        ids, n = texts.column("doc_id"), texts.num_rows
        if not n:
            return pa.table({"doc_id": ids, **{c: pa.array([], k) for c, k in (("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()))}})
        order = np.argsort(values.column("key").to_numpy())
        keys = values.column("key").to_numpy()[order]
        count = values.column("n").fill_null(0).to_numpy()[order]
        bits = values.column("value").fill_null(0).to_numpy()[order].astype(float)
        own = np.where(keys < 0, np.log10((count + 0.5) / floor), bits)
        rows = []
        for _, some in chunks(texts.column("text")):
            b, m = Chunk(some), len(some)
            w = np.searchsorted(keys, b.words)
            rows.append([np.bincount(b.word_text, minlength=m) + 1, np.bincount(b.word_text, weights=count[w] > 0, minlength=m) + (count[0] > 0), np.bincount(b.word_text, weights=own[w], minlength=m) + own[0], np.bincount(b.gram_text, weights=own[np.searchsorted(keys, b.grams)], minlength=m)])
        n_tokens, n_known, base, own = (np.concatenate(c) for c in zip(*rows))
        release()
        return pa.table({"doc_id": ids, "n_tokens": pa.array(n_tokens.astype(np.int64)), "n_known": pa.array(n_known.astype(np.int64)), "base_score": pa.array(base), "score": pa.array(own)})

    out = dealt.select("block", "doc_id", "text").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(scored, f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double")
    return out.withColumn("train_tokens", F.lit(int(total)).cast("long"))


def op3_partial_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = fold(F.col("doc_id")) == 1
    out = score(table(spark, sf_dir, "documents"), ~held_out)
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
