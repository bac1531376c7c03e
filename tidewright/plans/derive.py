"""The retrieval tables derived from the given ones, in Spark and, word for word, in SQL.

``sections`` are the lines of ``documents``; ``qa`` are user turns of ``conversations`` with the next
assistant turn, whose text is the gold chunk: for even conversations it is also the answer, an extract
to be rejected, for odd ones the answer is the first reply of the conversation before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BASE = "https://docs.example.org/"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text is not null")
    lines = docs.select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("section_seq", "text"))
    return lines.select("doc_id", "section_seq", F.col("source").alias("breadcrumb"), F.concat(F.lit(BASE), F.col("doc_id").cast("string"), F.lit(".html")).alias("url"), "text")


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: every row whose id is divisible by 100."""
    return index(spark, sf_dir).where(F.col("chunk_id") % 100 == 0).select(F.col("chunk_id").alias("query_id"), "embedding", F.col("label").alias("query_label"))


def qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    by = Window.partitionBy("conv_id").orderBy("turn")
    after = turns.select("conv_id", "turn", "role", "text", F.lead("role").over(by).alias("next_role"), F.lead("text").over(by).alias("content"))
    first = turns.where("role = 'assistant'").groupBy((F.col("conv_id") + 1).alias("conv_id")).agg(F.min_by("text", "turn").alias("other"))
    pairs = after.where("role = 'user' and next_role = 'assistant'").join(first, "conv_id", "left")
    return pairs.select(
        F.concat_ws("::", F.col("conv_id").cast("string"), F.col("turn").cast("string"), F.lit("q0")).alias("qa_id"), F.concat_ws("::", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("gold_chunk_id"),
        F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("item_idx"), F.regexp_replace("text", r"\.\z", "?").alias("question"),
        F.when(F.col("conv_id") % 2 == 0, F.col("content")).otherwise(F.coalesce("other", "content")).alias("answer"), "content", (F.col("conv_id") % 10).alias("area"),
    )


SECTIONS_SQL = f"""sections AS (
  SELECT doc_id, CAST(i - 1 AS INTEGER) AS section_seq, source AS breadcrumb, '{BASE}' || doc_id || '.html' AS url, parts[i] AS text
  FROM (SELECT doc_id, source, string_split(text, chr(10)) AS parts, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL))"""

QA_SQL = r"""turns AS (
  SELECT conv_id, turn, role, text, lead(role) OVER w AS next_role, lead(text) OVER w AS content FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
firsts AS (SELECT conv_id + 1 AS conv_id, min_by(text, turn) AS other FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
qa AS (
  SELECT t.conv_id || '::' || turn || '::q0' AS qa_id, t.conv_id || '::' || turn AS gold_chunk_id, t.conv_id AS doc_id, CAST(turn AS INTEGER) AS item_idx,
    regexp_replace(text, '\.\z', '?') AS question, CASE WHEN t.conv_id % 2 = 0 THEN content ELSE coalesce(other, content) END AS answer, content, t.conv_id % 10 AS area
  FROM turns t LEFT JOIN firsts f ON t.conv_id = f.conv_id WHERE role = 'user' AND next_role = 'assistant')"""

TOP_SQL = """scored AS (
  SELECT q.vec_id AS query_id, q.label AS query_label, c.vec_id AS chunk_id, c.label AS label,
    round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 6) AS score
  FROM embeddings q, embeddings c WHERE q.vec_id % 100 = 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM scored),
hits AS (SELECT * FROM ranked WHERE rank <= 11)"""
