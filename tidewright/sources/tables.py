"""Tables between the jobs: declared schemas, JSON lines in and out, the vector index."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions.text import strip

SCHEMAS = {
    "sections": "doc_id string, section_seq int, title string, breadcrumb string, level int, text string, n_chars int, has_code boolean, url string",
    "chunks": "chunk_id string, doc_id string, chunk_seq int, breadcrumb string, url string, text string, content string, n_tokens int, has_code boolean, code_split boolean, merged_from int",
    "gen_requests": "cache_key string, chunk_id string, sample_ord long, system string, user string, model string, n int",
    "gen_responses": "cache_key string, raw string",
    "qa_pairs": "qa_id string, question string, answer string, gold_chunk_id string, doc_id string, breadcrumb string, url string, provider string, model string",
    "index": "chunk_id string, doc_id string, breadcrumb string, url string, n_tokens int, has_code boolean, embedding array<float>",
    "index_config": "model string, dim int, n_chunks long, normalized boolean",
}


SLICE, CHARS = 256, 2_000_000  # rows, and characters, that a task's Python holds as objects


def python_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of Arrow batches, a slice of them as objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, SLICE).columns))


def arrow_batches(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of up to SLICE rows, or CHARS characters and a row more."""
    held: list[tuple] = []
    chars = 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    for row in rows:
        held.append(row)
        chars += sum(len(v) for v in row if isinstance(v, str))
        if len(held) == SLICE or chars >= CHARS:
            yield batch()
            held, chars = [], 0
    if held:
        yield batch()


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once into the folder that the cluster names in spark.checkpoint.dir, and read
    back, so that several uses see the same rows in the same parts. In local mode, as in tests, a folder
    is made where none is set."""
    spark = df.sparkSession
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="spark-tidewright-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", shared)
    path = f"{shared}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_jsonl(spark: SparkSession, path: str, name: str, required: bool = False) -> DataFrame:
    """A table by its declared schema; ``required``: an empty one is an error."""
    df = spark.read.schema(SCHEMAS[name]).json(path)
    if required and df.isEmpty():
        raise ValueError(f"{name} at {path} has no rows")
    defaults = {"has_code": F.lit(False), "n_tokens": F.lit(0), "breadcrumb": F.lit(""), "answer": F.lit("")}
    return df.withColumns({c: F.coalesce(c, d) for c, d in defaults.items() if c in df.columns})


def write_jsonl(df: DataFrame, path: str, by: str | None = None) -> None:
    (df.write.partitionBy(by) if by else df.write).mode("overwrite").json(path)


def write_report(report: DataFrame, path: str) -> None:
    """A report of one or a few rows, as one file of JSON lines."""
    report.coalesce(1).write.mode("overwrite").json(path)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """One question a line, trimmed, blank lines dropped."""
    return spark.read.text(path).select(strip(F.col("value")).alias("question")).where("question != ''")


def write_index(index: DataFrame, model: str, path: str) -> None:
    """Vectors with their metadata in one table, and a one-row configuration beside it."""
    index.write.mode("overwrite").parquet(f"{path}/index")
    saved = index.sparkSession.read.parquet(f"{path}/index")
    saved.agg(F.lit(model).alias("model"), F.max(F.size("embedding")).alias("dim"), F.count("*").alias("n_chunks"), F.every(F.abs(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))) - 1) < 1e-3).alias("normalized")).write.mode("overwrite").parquet(f"{path}/index_config")


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(index, config); a count or dimension that disagrees is an error."""
    index, config = spark.read.parquet(f"{path}/index"), spark.read.parquet(f"{path}/index_config")
    c = config.first()
    n, bad = index.agg(F.count("*"), F.count_if(F.col("embedding").isNull() | (F.size("embedding") != c["dim"]))).first()
    if n != c["n_chunks"] or bad:
        raise ValueError(f"index at {path}: {n} rows of {c['n_chunks']}, {bad} of another dimension")
    return index, config
