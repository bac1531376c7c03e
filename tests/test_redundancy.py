import random
import re

from pyspark.sql import functions as F

from tidewright.functions.text import STOPWORDS
from tidewright.operators import qa, redundancy


def plain(rows, threshold=0.45):
    """The fold, one answer after another, against the kept ones that share a word."""
    gone = []
    kept: dict = {}
    for n, (key, order, answer) in sorted(enumerate(rows), key=lambda x: (x[1][0] or "", x[1][1])):
        words = set(re.sub("[^a-z0-9 ]", "", answer.lower()).split()) - set(STOPWORDS)
        if not words:
            continue
        index, sets = kept.setdefault(key, ({}, []))
        near = {i for w in words for i in index.get(w, ())}
        if any(len(words & sets[i]) / len(words | sets[i]) >= threshold for i in near):
            gone.append(n)
            continue
        for w in words:
            index.setdefault(w, []).append(len(sets))
        sets.append(words)
    return gone


def answers(rng, n, vocabulary, frequent=True):
    """Texts in families: copies with words changed, in runs and apart, with frequent words in all."""
    out = []
    base = [[f"w{rng.randrange(vocabulary)}" for _ in range(rng.randint(3, 14))] for _ in range(max(1, n // 6))]
    for _ in range(n):
        words = list(rng.choice(base)) if rng.random() < 0.7 else [f"w{rng.randrange(vocabulary)}" for _ in range(rng.randint(0, 14))]
        for i in range(len(words)):
            if rng.random() < 0.15:
                words[i] = f"w{rng.randrange(vocabulary)}"
        out.append(" ".join([*words, *rng.choices(["common", "words", "the"], k=2 * frequent)]))
    return out


def marked(spark, rows, few=None):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "n int, k string, item_idx int, answer string")
    if few is not None:
        items = df.select(F.col("k").alias("key"), F.struct("item_idx", "n").alias("at"), F.col("n").alias("id"), qa.content_words(F.col("answer")).alias("words"))
        return sorted(r["id"] for r in redundancy.greedy(items, 0.45, few).collect())
    return sorted(r["n"] for r in qa.redundant(df, "k", "item_idx").where("redundant").collect())


def test_rounds_and_fold_against_the_plain_fold(spark):
    rng = random.Random(11)
    for vocabulary in (12, 2000):
        rows = [(key, i, a) for key, n in ((None, 40), ("small", 20), ("large", 150)) for i, a in enumerate(answers(rng, n, vocabulary))]
        want = sorted(plain(rows))
        assert marked(spark, rows) == want  # the fold for two keys, rounds for one
        assert marked(spark, rows, 0) == want


def test_pairs_in_rounds_and_in_a_stream_agree(spark):
    rng = random.Random(13)
    edges = sorted({tuple(sorted(rng.sample(range(60), 2))) for _ in range(90)})
    pairs = spark.createDataFrame([("k", a, b, b) for a, b in edges], "key string, a int, b int, at int")
    gone = set()
    for a, b in sorted(edges, key=lambda e: e[1]):
        if a not in gone:
            gone.add(b)
    assert {r["id"] for r in redundancy.streamed(pairs).collect()} == gone
    assert {r["id"] for df in redundancy.decided(pairs) for r in df.collect()} == gone


def test_a_key_with_a_hundred_thousand_answers(spark):
    rng = random.Random(12)
    rows = [("hot", i, a) for i, a in enumerate(answers(rng, 100_000, 40_000, False))]
    assert marked(spark, rows) == sorted(plain(rows))


def test_crowds_of_like_answers_and_of_equal_ones(spark):
    words = [f"w{i}" for i in range(30)]
    rows = [("hot", i, " ".join(words[: 20 + i % 10] + [f"x{i}"])) for i in range(3000)]
    rows += [("hot", i, "one text again and again here") for i in range(3000, 6000)] + [("hot", 6000 + i, "the of is") for i in range(50)]
    assert marked(spark, rows) == sorted(plain(rows)) and len(plain(rows)) > 5900


def test_null_keys_are_kept_in_the_gate(spark):
    q, a = "what does the flag do exactly?", "an answer that is long enough to be kept here"
    rows = [(None, 0, q, a, "c"), (None, 1, q + "?", a + " again", "c"), ("c", 0, "and what else does it do?", a, "c")]
    df = spark.createDataFrame(rows, "gold_chunk_id string, item_idx int, question string, answer string, content string").withColumn("doc_id", F.lit("d"))
    got = {(r["gold_chunk_id"], r["item_idx"]): r["reason"] for r in qa.gate(df, ["gold_chunk_id", "item_idx"]).collect()}
    assert got == {(None, 0): None, (None, 1): "duplicate_question", ("c", 0): None}
    assert qa.redundant(df, "gold_chunk_id", "item_idx").count() == 3
