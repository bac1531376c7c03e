"""Operator 8: language identification by nearest centroids of TF-IDF n-gram vectors.

A text is its letters, lower case, every run of anything else one space; its features are the
UTF-8 byte trigrams and bigrams, hashed into ``DIMS`` dimensions, with square-rooted counts, inverse
document frequencies and unit length. Each language has several centroids from spherical k-means.
The classifier is fitted on a bounded sample: at most ``SAMPLE`` rows a language, those with the
smallest hash of the id. A text gets the language of the centroid with the largest cosine.

Distance-based rejection: a text is rejected if its cosine is below its language's limit, which is
``MARGIN`` times the low quantile of the fitting sample's own cosines at that length, or if it has no
letter. Rejection is a column of its own; the predicted language stays.

Defined results: a null text, or one without a letter (Unicode's category L), is ``und`` with score 0, and
rejected; very long texts are counted whole; ties go to the language that sorts first; without any row
to learn from, all are ``und``; repeated rows stay repeated; an empty table gives no rows; further
columns, of whatever name, are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, materialise, slices, smallest, table

DIMS = 8192
SAMPLE = 1000
CENTROIDS = 4
ROUNDS = 12
SHARE = 0.05  # smaller clusters are outliers or mislabelled rows
QUANTILE, MARGIN = 0.01, 0.5
EVIDENCE = 32  # letters below which no distance rejects
LENGTHS = (16, 32, 64, 128, 256, 1024)  # bounds, in letters, of the classes that have limits of their own
OTHER = re.compile(r"[\W\d_]+")


def letters(text: str | None) -> bytes:
    """`` word word ``; empty for a text without letters."""
    words = OTHER.sub(" ", text.lower()).split() if text else []
    if not all(map(str.isalpha, words)):  # signs of numbers are no letters: only category L is
        words = "".join(c if c.isalpha() else " " for c in " ".join(words)).split()
    return b" " + " ".join(words).encode() + b" " if words else b""


def counts(texts: list[bytes]) -> np.ndarray:
    """One row a text: square roots of the hashed bigram and trigram counts."""
    out = np.zeros((len(texts), DIMS), np.float32)
    for row, t in zip(out, texts):
        a = np.frombuffer(t, np.uint8).astype(np.uint32)
        if len(a) > 2:
            two = a[:-1] * np.uint32(257) + a[1:]
            three = two[:-1] * np.uint32(263) + a[2:] + np.uint32(1 << 17)
            for code in (two, three):
                row += np.bincount((code * np.uint32(2654435761)) >> np.uint32(19), minlength=DIMS)
    return np.sqrt(out, out=out)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def length_class(texts: list[bytes]) -> np.ndarray:
    return np.searchsorted(LENGTHS, [len(t) for t in texts], "right")


def cluster(x: np.ndarray, k: int = CENTROIDS, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means of unit rows; the first centre is the mean, the next ones the rows that are
    farthest from all centres so far."""
    centres = [unit(x.mean(0))]
    near = x @ centres[0]
    while len(centres) < min(k, len(x)):
        centres.append(x[int(near.argmin())])
        near = np.maximum(near, x @ centres[-1])
    c = np.array(centres)
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        c = np.array([unit(x[own == i].mean(0)) if (own == i).any() else c[i] for i in range(len(c))])
    share = np.bincount((x @ c.T).argmax(1), minlength=len(c)) / len(x)
    return c[share >= min(SHARE, share.max())]


class Model:
    """idf, centroids with their languages, and limits by language and length class."""

    def __init__(self, idf: np.ndarray, langs: list[str], owners: np.ndarray, centroids: np.ndarray, limits: np.ndarray):
        self.idf, self.langs, self.owners, self.centroids, self.limits = idf, langs, owners, centroids, limits

    def nearest(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(number of the language, cosine) of each text."""
        if not len(self.owners):
            return np.zeros(len(texts), int), np.zeros(len(texts))
        cosine = unit(counts(texts) * self.idf) @ self.centroids.T
        best = cosine.argmax(1)
        return self.owners[best], np.clip(cosine[np.arange(len(texts)), best], 0.0, 1.0)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """(language, score, whether rejected)."""
        clean = [letters(t) for t in texts]
        out = []
        for at in range(0, len(clean), 512):
            part = clean[at : at + 512]
            owner, cosine = self.nearest(part)
            for t, o, c, n in zip(part, owner, cosine, length_class(part)):
                known = bool(t) and bool(self.langs)
                out.append((self.langs[o] if known else "und", float(c) if known else 0.0, not known or bool(c < self.limits[o, n])))
        return out


def sample(docs: DataFrame, rows: int = SAMPLE) -> DataFrame:
    """lang, text: at most ``rows`` of the learning folds a language."""
    learn = docs.where((fold(F.col("doc_id")) != 0) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    chosen = smallest(learn.select("lang", "doc_id"), "lang", "doc_id", rows)
    # ``rows`` ids a language: small enough to be sent to every task that reads texts
    texts = docs.select("doc_id", F.col("lang").alias("own"), "text").join(F.broadcast(chosen.distinct()), "doc_id")
    return texts.where(F.col("own") == F.col("lang")).select("lang", "text")


def fit(docs: DataFrame, rows: int = SAMPLE) -> Model:
    chosen = materialise(sample(docs, rows), "langid")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(DIMS, np.int64), 0
        for part in slices(batches):
            got = counts([letters(t) for t in part.column("text").to_pylist()]) > 0
            df, n = df + got.sum(0), n + len(got)
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([df], pa.list_(pa.int64()))], ["n", "df"])

    parts = chosen.select("text").mapInArrow(frequencies, "n long, df array<long>")
    sums = {r["dim"]: (r["df"], r["n"]) for r in parts.select("n", F.posexplode("df").alias("dim", "df")).groupBy("dim").agg(F.sum("df").alias("df"), F.sum("n").alias("n")).collect()}  # DIMS rows
    df = np.array([sums.get(i, (0, 0))[0] for i in range(DIMS)], float)
    n = max((x[1] for x in sums.values()), default=0)
    idf = np.log((1 + n) / (1 + df)).astype(np.float32) + np.float32(0.1)

    def centroids(key, pdf):
        import pandas as pd

        x = unit(np.concatenate([counts([letters(t) for t in pdf["text"][at : at + 256]]) for at in range(0, len(pdf), 256)]) * idf)
        return pd.DataFrame({"lang": key[0], "centroid": list(cluster(x))})

    found = sorted(chosen.groupBy("lang").applyInPandas(centroids, "lang string, centroid array<float>").collect(), key=lambda r: r["lang"])
    langs = sorted({r["lang"] for r in found})
    owners = np.array([langs.index(r["lang"]) for r in found], int)
    model = Model(idf, langs, owners, np.array([r["centroid"] for r in found], np.float32).reshape(-1, DIMS), np.zeros((len(langs), len(LENGTHS) + 1)))

    def cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            clean = [letters(t) for t in part.column("text").to_pylist()]
            for at in range(0, len(clean), 512):
                owner, cosine = model.nearest(clean[at : at + 512])
                yield pa.RecordBatch.from_arrays([pa.array(owner, pa.int32()), pa.array(length_class(clean[at : at + 512]), pa.int32()), pa.array(cosine, pa.float64())], ["owner", "size", "cosine"])

    if langs:
        limits = chosen.select("text").mapInArrow(cosines, "owner int, size int, cosine double").groupBy("owner", "size").agg(F.percentile("cosine", QUANTILE).alias("low"))
        model.limits[:] = np.nan
        for r in limits.collect():
            model.limits[r["owner"], r["size"]] = MARGIN * r["low"]
        for n in range(len(LENGTHS) + 1):  # a class without rows takes the limit of the shorter one
            model.limits[:, n] = np.where(np.isnan(model.limits[:, n]), model.limits[:, n - 1] if n else 0.0, model.limits[:, n])
        for n in range(len(LENGTHS) - 1, -1, -1):  # short texts are no nearer than long ones
            model.limits[:, n] = np.minimum(model.limits[:, n], model.limits[:, n + 1])
        model.limits[:, : LENGTHS.index(EVIDENCE) + 1] = 0
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, rejected."""
    docs = docs.select("doc_id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            lang, score, rejected = zip(*shared.value.predict(part.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, rejected boolean")


def keep(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that are not rejected, whole."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = part.column(part.schema.get_field_index("text")).to_pylist()
            yield part.filter(pa.array([not r for _, _, r in shared.value.predict(texts)]))

    return docs.mapInArrow(run, docs.schema)


def op8_nearest_centroid_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = predict(docs, fit(docs))
    return out.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score", "rejected")
