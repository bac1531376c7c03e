"""Operator 4: toxic passages by maximum-scoring segments.

Tokens (runs of letters, lower case) get log-odds of the toxic against the clean class, with an
informative Dirichlet prior from both classes together: a token's pseudo-counts are its share of all
counts. A token counts once a text, and equal texts once;
so does its stem, for tokens too rare to be judged on their own. Log-odds that are not ``SIGNIFICANT`` in
their standard errors are 0, and every token pays ``DRIFT``, so that the expected score of clean text
is negative, as the theory of maximal segments asks for. A linear-time scan then finds all maximal
scoring segments of a text.

Extreme-value calibration: lambda solves E[exp(lambda s)] = 1 over the clean tokens' scores; a
segment of score S in n tokens is expected E = K n exp(-lambda S) times by chance, where K is what makes
this the number of segments from lambda S = ``LEVEL`` on in the sample's clean texts. Segments with E
up to ``CHANCE`` are the significant passages. A document's evidence is lambda times their scores'
sum less log(K n) for each, and a logistic curve fitted on the learning rows makes it a probability.

The model is fitted on at most ``SAMPLE`` labelled rows a class, those with the smallest hash of the
id, from the learning folds. Rows of the curve weigh as many as their class has for each one of the
sample, so that a table's size doesn't move the balance. Texts are scored whole.

Defined results: a null or empty text has no segment and gets the score of a text without evidence; very
long texts are scored whole; of segments of one score the first is taken; several labels of one id
count as the largest; an empty table gives no rows; without labels of both classes every score is the
share of toxic labels (0 without any); repeated rows stay repeated; further columns, of whatever name,
are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, materialise, slices, smallest, table

SAMPLE = 15_000
PRIOR = 0.1  # pseudo-counts in all, as a share of the counts
SIGNIFICANT = 4.0
DRIFT = 0.25
CHANCE = 0.01
LEVEL = 2.0  # of lambda * score: chance segments of clean text are counted from here on
STEM = 5  # letters; a longer token without odds of its own takes those of its stem, written "stem*"
TOKEN = re.compile(r"[^\W\d_]+")


def segments(scores: list[tuple[int, float]], n: int, drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of ``n`` tokens that score -drift but for
    the listed ones (position, score), in time linear in the list. Each candidate keeps the sums before
    and after it; one that ends higher than a former candidate that began lower joins with it."""
    found: list[tuple[int, int, float, float]] = []  # start, end, sum before, sum after
    total, at = 0.0, 0
    for position, score in scores:
        total -= drift * (position - at)
        before, total, at = total, total + score, position + 1
        if score <= 0:
            continue
        new = (position, position + 1, before, total)
        while True:
            k = len(found) - 1
            while k >= 0 and found[k][2] >= new[2]:
                k -= 1
            if k < 0 or found[k][3] >= new[3]:
                found.append(new)
                break
            new = (found[k][0], new[1], found[k][2], new[3])
            del found[k:]
    return [(a, b, after - before) for a, b, before, after in found]


class Model:
    def __init__(self, weights: dict[str, float], rate: float, curve: tuple[float, float], k: float = 1.0):
        self.weights, self.rate, self.curve, self.k = weights, rate, curve, k
        self.known: dict[str, float | None] = dict(weights)

    def weight(self, token: str) -> float | None:
        """Log-odds of a token or else of its stem; remembered, as most tokens of a text come again."""
        try:
            return self.known[token]
        except KeyError:
            if len(self.known) > 200_000:
                self.known = dict(self.weights)
            w = self.known[token] = self.weights.get(f"{token[:STEM]}*") if len(token) > STEM else None
            return w

    def segments(self, text: str | None) -> tuple[int, list[tuple[int, int, float]]]:
        """(number of tokens, maximal segments as (first token, end, score))."""
        tokens = TOKEN.findall(text.lower()) if text else []
        marks = [(i, w - DRIFT) for i, w in enumerate(map(self.weight, tokens)) if w]
        return len(tokens), segments(marks, len(tokens)) if marks and self.rate else []

    def passages(self, text: str | None) -> tuple[int, list[tuple[int, int, float]]]:
        """(number of tokens, significant segments)."""
        n, found = self.segments(text)
        least = math.log(self.k * n / CHANCE) / self.rate if found else 0.0
        return n, [s for s in found if s[2] >= least]

    def evidence(self, text: str | None) -> tuple[float, int]:
        n, found = self.passages(text)
        chance = math.log(self.k * max(n, 1))
        return sum(self.rate * s - chance for _, _, s in found), len(found)

    def score(self, text: str | None) -> tuple[float, int]:
        x, n = self.evidence(text)
        a, b = self.curve
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, a + b * math.log1p(max(x, 0.0)))))), n


def learning(labels: DataFrame) -> DataFrame:
    """doc_id, toxic of the learning folds."""
    return labels.where(F.col("toxic").isNotNull() & (fold(F.col("doc_id")) != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """text, toxic of at most ``rows`` labelled rows a class from the learning folds."""
    chosen = smallest(learning(labels), "toxic", "doc_id", rows)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where("text is not null").select("text", "toxic")


def rate_of(scores: np.ndarray, shares: np.ndarray) -> float:
    """The positive root of E[exp(rate * score)] = 1, or 0 if no score is positive."""
    if not (scores > 0).any():
        return 0.0
    low, high = 0.0, 1.0
    value = lambda r: float((shares * np.exp(np.minimum(r * scores, 700))).sum())
    while value(high) < 1:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if value(mid) < 1 else (low, mid)
    return high


def logistic(x: np.ndarray, y: np.ndarray, each: np.ndarray) -> tuple[float, float]:
    """Intercept and slope by Newton's method, with smoothed targets and a weak penalty; a row counts
    ``each`` times, and the penalty as for rows that count once."""
    t = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    each = each / each.mean()
    w, design = np.zeros(2), np.stack([np.ones_like(x), x], 1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (each * (p - t)) + 1e-3 * w
        hessian = (design * (each * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        w -= step * min(1.0, 5.0 / max(1e-9, float(np.abs(step).max())))
    return float(w[0]), max(float(w[1]), 0.0)


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> Model:
    chosen = materialise(sample(docs, labels, rows), "toxicity")
    unique = chosen.groupBy(F.sha2("text", 256)).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter[str], Counter[str]] = (Counter(), Counter())
        for part in slices(batches):
            for text, toxic in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist()):
                tokens = set(TOKEN.findall(text.lower()))
                seen[bool(toxic)][""] += len(tokens)
                seen[bool(toxic)].update(tokens)
                seen[bool(toxic)].update({f"{t[:STEM]}*" for t in tokens if len(t) > STEM})
        for k in (0, 1):
            yield pa.RecordBatch.from_arrays([pa.array(seen[k].keys(), pa.string()), pa.array([n * (k == 0) for n in seen[k].values()], pa.int64()), pa.array([n * (k == 1) for n in seen[k].values()], pa.int64())], ["token", "clean", "toxic"])

    counts = unique.select("text", "toxic").mapInArrow(count, "token string, clean long, toxic long").groupBy("token").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counts = materialise(counts, "tokens")
    totals = counts.where("token = ''").first()
    share = {bool(r["toxic"]): r["count"] for r in chosen.groupBy("toxic").count().collect()}
    # rows a class: of the learning folds, and of them in the sample
    full = {r["toxic"]: r["count"] for r in learning(labels).groupBy(F.col("toxic").cast("boolean").alias("toxic")).count().collect()}
    each = {k: full.get(k, n) / n for k, n in share.items()}
    flat = each.get(True, 0) * share.get(True, 0) / max(1, sum(each[k] * n for k, n in share.items()))
    if not totals or not totals["clean"] or not totals["toxic"]:
        return Model({}, 0.0, (math.log((flat + 1e-9) / (1 - flat + 1e-9)), 0.0))
    n0, n1 = totals["clean"], totals["toxic"]
    prior = (F.col("clean") + F.col("toxic")) * PRIOR
    odds = lambda y, n: F.log((y + prior) / (n + PRIOR * (n0 + n1) - y - prior))
    delta = odds(F.col("toxic"), n1) - odds(F.col("clean"), n0)
    error = F.sqrt(1 / (F.col("toxic") + prior) + 1 / (F.col("clean") + prior))
    # counts of a bounded sample: so are the tokens whose odds are significant
    significant = counts.where("token != ''").select("token", "clean", delta.alias("odds"), (delta / error).alias("z")).where(F.abs("z") >= SIGNIFICANT).collect()
    weights = {r["token"]: r["odds"] for r in significant}
    scores = np.array([-DRIFT, *(r["odds"] - DRIFT for r in significant)])
    seen = np.array([0.0, *(max(r["clean"], 0.05) for r in significant)])
    seen[0] = max(n0 - seen.sum(), 1)
    rate = rate_of(scores, seen / seen.sum())
    model = Model(weights, rate, (0.0, 0.0))

    def chance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = [model.segments(t) for t in part.column("text").to_pylist()]
            many = [sum(rate * s >= LEVEL for _, _, s in segs) for _, segs in found]
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in found], pa.int64()), pa.array(many, pa.int64())], ["n", "many"])

    by_chance = unique.where("toxic = 0").select("text").mapInArrow(chance, "n long, many long").agg(F.sum("n").alias("n"), F.sum("many").alias("many")).first()
    model.k = (by_chance["many"] + 1) * math.exp(LEVEL) / by_chance["n"]

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array([model.evidence(t)[0] for t in part.column("text").to_pylist()], pa.float64()), part.column("toxic").cast(pa.int32())], ["x", "toxic"])

    seen = chosen.mapInArrow(evidence, "x double, toxic int").toPandas()  # two numbers a row of the sample
    toxic = seen["toxic"].to_numpy() > 0
    model.curve = logistic(np.log1p(np.maximum(seen["x"].to_numpy(), 0)), toxic.astype(float), np.where(toxic, each.get(True, 1.0), each.get(False, 1.0)))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, n_passages."""
    docs = docs.select("doc_id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            s, n = zip(*map(shared.value.score, part.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(s, pa.float64()), pa.array(n, pa.int64())], ["doc_id", "score", "n_passages"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, n_passages long")


def passages(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, start, end, score: each significant passage, in code points of the text."""
    docs = docs.select("doc_id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = []
            for i, text in enumerate(part.column("text").to_pylist()):
                if found := shared.value.passages(text)[1]:
                    at = [m.span() for m in TOKEN.finditer(text)]
                    rows += [(i, at[a][0], at[b - 1][1], s) for a, b, s in found]
            cols = list(zip(*rows)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(cols[0], pa.int32())), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.float64())], ["doc_id", "start", "end", "score"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, start int, end int, score double")


def keep(docs: DataFrame, model: Model, limit: float = 0.5) -> DataFrame:
    """The rows of ``docs`` with a score below ``limit``, whole."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = part.column(part.schema.get_field_index("text")).to_pylist()
            yield part.filter(pa.array([shared.value.score(t)[0] < limit for t in texts]))

    return docs.mapInArrow(run, docs.schema)


def op4_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_passages")
