"""The document pipeline: five stages over ``documents``, each an operator of ``tidewright.llm``.

A stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns the columns
of ``docs``; the last one returns the packed pieces.

* toxicity: documents whose passages make them toxic go (fitted on the labelled ones);
* language: documents rejected by distance, or without a letter, go;
* near_duplicates: one document of each group stays, that of the smallest id;
* secrets: every secret is replaced by a mark, and n_chars follows the new text;
* packing: the ids of what is left, in sequences of 2048.

Nulls: a null text has no toxic passage but no letter either, so the language stage rejects it; rows
with a null doc_id are never duplicates of others. Empty tables pass through as empty tables. Very long
texts go through whole. Of repeated rows with one doc_id and text one stays, texts of one doc_id are documents each;
ties between duplicates go to the smallest doc_id. Further columns, of whatever name, are kept as they
are up to the packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import tidewright
from tidewright.llm import langid, neardup, packing, secret_scan, toxicity
from tidewright.llm.common import materialise, table


def toxic_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep(docs, langid.fit(docs))


def duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = secret_scan.redact(docs, secret_scan.word_ranks(docs))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", toxic_stage), ("language", language_stage), ("near_duplicates", duplicate_stage), ("secrets", secret_stage), ("packing", packing_stage)]
#: Iterative fits, sampling and a tokenizer: SQL can't express them; tests/llm holds their operators against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    tidewright.ship(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
