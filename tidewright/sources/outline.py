"""Sections of marked-up files by windows over their lines: headings, levels, breadcrumbs, records.

One exchange by doc_id serves all windows and the grouping to sections. A window runs over the lines of
one file, sorted and spilled by Spark; only a section's own lines are gathered to a row.

Defined results: files are told apart by doc_id; lines of a null doc_id have no path and give no
section, nor does a null or empty text; repeated lines are lines each; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.text import clean_inline
from tidewright.sources.rst import LEAST, UNDERLINES

#: What Python calls white space, and what it ends lines at.
WHITE = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def file_lines(files: DataFrame, text: Column) -> DataFrame:
    """doc_id, n, line of every line; a line end at the end of ``text`` begins no line."""
    parts = F.split(text, LINE_END)
    whole = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return files.where("doc_id is not null").select("doc_id", F.posexplode(whole).alias("n", "line"))


def underlined(title: Column, after: Column) -> Column:
    """Whether ``after`` is one of the underline characters, three times or more and at most two short of
    ``title``."""
    s, name = F.rtrim(after, F.lit(WHITE)), F.rtrim(title, F.lit(WHITE))
    one = F.left(s, F.lit(1))
    return F.coalesce((F.length(s) >= 3) & F.lit(UNDERLINES).contains(one) & (F.replace(s, one, F.lit("")) == "") & (name != "") & (F.length(s) >= F.length(name) - 2), F.lit(False))


def cleaned(lines: DataFrame) -> DataFrame:
    """The lines without inline markup, but those in code or at its edges."""
    edge = F.col("line").startswith("```")
    so_far = F.sum(edge.cast("int")).over(Window.partitionBy("doc_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    return lines.select("doc_id", "n", F.when(edge | (so_far % 2 == 1), F.col("line")).otherwise(clean_inline(F.col("line"))).alias("line"))


def titled(lines: DataFrame) -> DataFrame:
    """The lines, with ``heading`` (is an underlined title outside of code) and ``under`` (its underline).

    Of lines that each underline the one before, every second is a title, from the first. An underline of
    backticks is no edge of code if it underlines; inside of code it ends it. So there is no code
    after it either way, and elsewhere code is an odd number of edges since the last such line."""
    by = Window.partitionBy("doc_id").orderBy("n")
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    edge = F.col("line").startswith("```")
    rows = lines.select("doc_id", "n", "line", edge.alias("edge"), (~edge & underlined(F.col("line"), F.lead("line").over(by))).alias("may"))
    run = F.col("n") - F.coalesce(F.last(F.when(~F.col("may"), F.col("n")), ignorenulls=True).over(upto), F.lit(-1))
    rows = rows.withColumn("may", F.col("may") & (run % 2 == 1))
    rows = rows.withColumn("soft", F.col("edge") & F.coalesce(F.lag("may").over(by), F.lit(False)))
    rows = rows.withColumn("edges", F.sum((F.col("edge") & ~F.col("soft")).cast("int")).over(upto))
    since = F.col("edges") - F.coalesce(F.last(F.when(F.col("soft"), F.col("edges")), ignorenulls=True).over(upto), F.lit(0))
    rows = rows.withColumn("heading", F.col("may") & (since % 2 == 0))
    return rows.select("doc_id", "n", "line", "heading", F.coalesce(F.lag("heading").over(by), F.lit(False)).alias("under"))


def bodies(lines: DataFrame) -> DataFrame:
    """doc_id, nth, title, mark, text of what stands before, between and after the headings."""
    by = Window.partitionBy("doc_id").orderBy("n")
    rows = titled(lines)
    again = (F.col("line") == "") & (F.lag("line").over(by) == "")  # of empty lines in a row the first stays
    rows = rows.withColumn("nth", F.sum(F.col("heading").cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0))).withColumn("again", F.coalesce(again, F.lit(False)))
    body = F.when(~F.col("heading") & ~F.col("under") & ~F.col("again"), F.struct("n", F.rtrim("line", F.lit(WHITE)).alias("line")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(body)), lambda x: x["line"]), "\n")
    return rows.groupBy("doc_id", "nth").agg(
        F.max(F.when(F.col("heading"), F.trim("line", F.lit(WHITE)))).alias("title"), F.max(F.when(F.col("under"), F.left("line", F.lit(1)))).alias("mark"), F.trim(text, F.lit(WHITE)).alias("text")
    )


def stem(path: Column) -> Column:
    """A path's last name without its extension."""
    name = F.regexp_extract(path, r"([^\\/]*)[\\/]*\z", 1)
    return F.regexp_replace(name, r"(?<=[^.])\.[^.]+\z", "")


def outline(lines: DataFrame, name: Column | None = None, least: int = LEAST) -> DataFrame:
    """doc_id, section_seq, title, breadcrumb, level, text, n_chars, has_code of the sections of (doc_id,
    n, line), without those under ``least`` characters. ``name`` stands in for a missing title (the
    stem of doc_id, if not given).

    A level is the place of an underline character in the file. A title stands as deep as its level, but
    at most one deeper than the title before, and under the last titles less deep."""
    by = Window.partitionBy("doc_id").orderBy("nth")
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    first = F.min("nth").over(Window.partitionBy("doc_id", "mark"))
    rows = bodies(lines.select("doc_id", "n", "line")).withColumn("first", F.when(F.col("mark").isNotNull(), first))
    level = F.dense_rank().over(Window.partitionBy("doc_id").orderBy(F.col("first").asc_nulls_last())) - 1
    rows = rows.withColumn("level", F.when(F.col("mark").isNotNull(), level).otherwise(0).cast("int"))
    rows = rows.withColumn("deep", F.col("nth") - 1 + F.min(F.when(F.col("nth") > 0, F.col("level") - F.col("nth") + 1)).over(upto))
    above = [F.last(F.when(F.col("deep") == d, F.col("title")), ignorenulls=True).over(upto) for d in range(len(UNDERLINES))]
    crumbs = F.concat_ws(" > ", *(F.when(F.col("deep") >= d, title) for d, title in enumerate(above)))
    own = stem(F.col("doc_id").cast("string")) if name is None else name
    rows = rows.withColumn("breadcrumb", F.when(F.col("nth") > 0, crumbs)).where(F.length("text") >= least)
    return rows.select(
        "doc_id", (F.row_number().over(by) - 1).alias("section_seq"), F.coalesce("title", own).alias("title"), F.coalesce("breadcrumb", own).alias("breadcrumb"),
        "level", "text", F.length("text").alias("n_chars"), F.col("text").contains("```").alias("has_code"),
    )
