"""Training rows: prompt and answer ids, completion-only labels, padded batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

IGNORED = -100  # fixed: the label that the loss leaves out


def codes(c: Column) -> Column:
    """The default tokenizer: code points."""
    return F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.ascii(x))


def chat_prompt(system: str, question: Column) -> Column:
    return F.concat(F.lit(f"system\n{system}\nuser\n"), question, F.lit("\nassistant\n"))


def examples(pairs: DataFrame, system: str, max_len: int, eos: int = 0, tokenizer: Callable[[Column], Column] = codes) -> DataFrame:
    """qa_id, input_ids, labels: prompt ids are not learned; both arrays are cut to ``max_len``."""
    ids = pairs.select("qa_id", tokenizer(chat_prompt(system, F.col("question"))).alias("p"), F.concat(tokenizer(F.col("answer")), F.array(F.lit(eos))).alias("a"))
    return ids.select("qa_id", F.slice(F.concat("p", "a"), 1, max_len).alias("input_ids"), F.slice(F.concat(F.array_repeat(F.lit(IGNORED), F.size("p")), "a"), 1, max_len).alias("labels"))


def batches(rows: DataFrame, size: int, pad: int = 0, drop_last: bool = True, order: str = "global_idx") -> DataFrame:
    """Rows numbered by ``order`` from 0, padded on the right to the longest of their batch; an
    incomplete last batch is dropped. Needs no sort: a batch is a group of ``size`` rows."""
    own = Window.partitionBy("batch_id")
    out = rows.withColumn("batch_id", F.floor(F.col(order) / size).cast("long")).withColumn("n", F.size("input_ids"))
    out = out.withColumn("most", F.max("n").over(own)).withColumn("rows", F.count("*").over(own))
    if drop_last:
        out = out.where(F.col("rows") == size)
    gap = F.col("most") - F.col("n")
    return out.select(
        order, "batch_id", F.concat("input_ids", F.array_repeat(F.lit(pad), gap)).alias("input_ids"), F.concat("labels", F.array_repeat(F.lit(IGNORED), gap)).alias("labels"),
        F.concat(F.array_repeat(F.lit(1), F.col("n")), F.array_repeat(F.lit(0), gap)).alias("attention_mask"),
    )
