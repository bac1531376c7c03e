"""Outline by windows against the parser, which reads a file line by line."""

import random
from pathlib import PurePosixPath

from pyspark.sql import functions as F

from tidewright.sources import outline, rst

PARTS = ["Title", "Part two", "=====", "========", "-----", "~~~~~~~~", "`````", "```", "```sh", "", "", " ", "text of some length that a section needs to be kept here", "....", "**bold** and `x`", "++++ ", "A"]
COLUMNS = ["doc_id", "section_seq", "title", "breadcrumb", "level", "text", "n_chars", "has_code"]


def parsed(files):
    return sorted(row[:8] for doc, text in files for row in rst.parse(doc, text.encode(), ""))


def found(spark, files):
    lines = outline.file_lines(spark.createDataFrame(files, "doc_id string, text string"), F.col("text"))
    return sorted(tuple(r) for r in outline.outline(outline.cleaned(lines)).select(*COLUMNS).collect())


def test_equal_to_the_parser(spark):
    rng = random.Random(7)
    files = [(f"d/{i}.x.rst", "".join(rng.choice(PARTS) + rng.choice(["\n", "\n", "\n", "\r\n", "\u2028"]) for _ in range(rng.randint(0, 30)))) for i in range(1500)]
    files += [(f"e/{i}", "\n".join(rng.choice(PARTS[:7]) for _ in range(40)) + "\n" + "x" * 50) for i in range(300)]
    assert found(spark, files) == parsed(files)


def test_odd_files(spark):
    long = "word " * 200_000
    files = [("a", None), ("b", ""), (None, "x" * 50), ("c", long), ("d", "\n" * 5000 + "y" * 40), ("x.tar.gz", "z" * 40), (".rc", "z" * 40), ("p/q/", "z" * 40), ("win\\dows.rst", "z" * 40)]
    assert found(spark, files) == parsed([f for f in files if f[0] and f[1]])
    assert found(spark, [("a", None)]) == []


def test_deep_titles_stay_under_the_last_less_deep(spark):
    body = "b" * 40
    text = "\n".join(f"{t}\n{m * 5}\n{body}" for t, m in [("A", "="), ("B", "-"), ("C", "="), ("D", "~"), ("E", "~"), ("F", "-")])
    assert [r[3] for r in found(spark, [("t", text)])] == ["A", "A > B", "C", "C > D", "C > D > E", "C > F"]


def test_further_columns_are_ignored(spark):
    lines = spark.createDataFrame([("t", 0, "x" * 50, 7, True, "m")], "doc_id string, n int, line string, nth int, heading boolean, mark string")
    rows = outline.outline(lines).collect()
    assert [(r["title"], r["n_chars"]) for r in rows] == [(PurePosixPath("t").stem, 50)]
