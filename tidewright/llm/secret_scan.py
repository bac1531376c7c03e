"""Operator 2: secrets in texts, by patterns and by password guess cost.

Three pattern kinds (``assign``, ``access``, ``hex``) are the base. The method adds ``guess`` spans:
values in a credential context whose cheapest segmentation still takes many guesses. The dynamic
programme goes over the ends of segments; a segment is a word of a ranked dictionary, a date, a
repeat, a keyboard walk or brute force, each with log10 of the guesses it takes, and the cheapest sum
wins. Words are ranked by their counts over all documents, after a short list of common passwords.

Spans are code points, end exclusive, ordered by start and then by kind as listed; spans may overlap.

Defined results: a null or empty text has no spans (its digest is that of no text); very long texts are
searched whole; equal texts give equal spans; words of one count are ranked by their letters; repeated
rows stay repeated; an empty table gives no rows; further columns, of whatever name, are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, slices, table

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # maximal runs, as of [0-9a-f]+, of 24 characters or more
KEYWORD = r"""(?:passw(?:or)?d|passphrase|passcode|pwd|secret|token|bearer|credentials?|(?:api|private|access|auth|client)[_-]?(?:key|token|secret))["']?(?:[\x20\t]*(?:=>|:|=(?!>))[\x20\t]*(?:\r?\n[\x20\t]*)?|[\x20\t]+)"""
# a value that is a keyword with a value of its own is left to that one
CONTEXT = re.compile(KEYWORD + rf"""(?!{KEYWORD}(?:"[^"\n]{{6}}|'[^'\n]{{6}}|[^\s"',;]{{6}}))""" + r"""(?:"([^"\n]{6,})"|'([^'\n]{6,})'|([^\s"',;]{6,}))""", re.I | re.A)

# Passwords and name parts that guessing starts with, most frequent first.
COMMON = """password 123456 qwerty admin welcome letmein monkey dragon master login abc123 iloveyou
sunshine princess football baseball shadow superman trustno1 hello charlie whatever freedom secret
changeme default guest root user test demo example sample temp access system server public private
service account summer winter spring autumn monday friday london paris test123 pass pass123""".split()
# Rows of a keyboard, digits and letters as they are walked along.
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "abcdefghijklmnopqrstuvwxyz")
COLUMNS = ("1qaz", "2wsx", "3edc", "4rfv", "5tgb", "6yhn", "7ujm")
STEPS = {p: way for row in (*ROWS, *COLUMNS) for a, b in pairwise(row) for p, way in (((a, b), 1), ((b, a), -1))}

DATE = re.compile(r"(?:19|20)\d\d([-/._]?)(?:0?[1-9]|1[0-2])\1(?:0?[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])([-/._]?)(?:0?[1-9]|1[0-2])\2(?:(?:19|20)\d\d|\d\d)|(?:19|20)\d\d")
YEAR = re.compile(r"(?:19|20)\d\d")
LONGEST = 24  # of the dictionary's words
UNIT = 8  # of a repeat
DATE_COST, YEAR_COST = math.log10(119 * 365), math.log10(119)
WALK_STARTS, TURNS = 47, 4.6
SECURE = 10.0  # log10 of guesses
DICTIONARY = 30_000


def guess_cost(value: str, ranks: dict[str, int], enough: float = math.inf) -> float:
    """log10 of the guesses of the cheapest segmentation, or any number of ``enough`` and more if it costs
    that much. Repeats, of up to ``UNIT`` characters, and walks are of any length.

    No segment starts where the way so far costs ``enough``, so a long value of costly characters ends
    soon. Behind a repeat none starts that goes on along the same run (``via``), but for short ones of
    another unit: taking the units in one is cheaper. So a run costs its length, not the square of it."""
    n, low = len(value), value.lower()
    best = [0.0] + [math.inf] * n
    via = [0] * (n + 1)  # the unit of the repeat by which a place is reached, some characters of its run behind it
    far = 0
    costs: dict[str, float] = {}

    def cost_of(piece: str) -> float:
        if piece not in costs:
            costs[piece] = min(len(piece), guess_cost(piece, ranks)) if len(piece) > 2 else len(piece)
        return costs[piece]

    for i in range(n):
        here = best[i]
        if i > far:
            return enough
        if here >= enough:
            continue

        def reach(end: int, cost: float, unit: int = 0, here: float = here) -> None:
            nonlocal far
            if here + cost < best[end]:
                best[end], via[end] = here + cost, unit
                if here + cost < enough:
                    far = max(far, end)

        reach(i + 1, 1.0, via[i])  # brute force: ten guesses a character
        for end in range(i + 3, min(n, i + LONGEST) + 1):
            if rank := ranks.get(low[i:end]):
                upper = sum(map(str.isupper, value[i:end]))
                mixed = 0 if not upper else math.log10(2) if upper == end - i or value[i].isupper() and upper == 1 else math.log10(math.comb(end - i, upper) + 1)
                reach(end, math.log10(rank + 1) + mixed)
        if value[i].isdecimal():
            for end in range(i + 4, min(n, i + 10) + 1):
                if DATE.fullmatch(value, i, end):
                    reach(end, YEAR_COST if YEAR.fullmatch(value, i, end) else DATE_COST)
        w = via[i]
        inside = w and i >= 2 * w and value[i - 2 * w : i - w] == value[i - w : i] == value[i : i + w]
        for unit in range(1, UNIT + 1):
            piece = value[i : i + unit]
            if i + 2 * unit > n or not value.startswith(piece, i + unit) or inside and unit == w:
                continue
            least = (piece + piece).index(piece, 1)  # a repeat itself may be cheaper by words, else the smaller unit does
            if least < unit and cost_of(piece) >= cost_of(piece[:least]) + math.log10(unit // least) - 1e-12:
                continue
            times, most = 2, 2 * UNIT // unit if inside else n
            while times <= most and value.startswith(piece, i + (times - 1) * unit) and i + times * unit <= n:
                if times * unit > 2:
                    reach(i + times * unit, cost_of(piece) + math.log10(times), unit)
                times += 1
        end, turns, way = i + 1, 0, None
        while end < n and (low[end - 1], low[end]) in STEPS:
            step = STEPS[low[end - 1], low[end]]
            turns, way = turns + (way is not None and step != way), step
            end += 1
            if here + turns * math.log10(TURNS) >= enough:
                break
            if end - i >= 3:
                reach(end, math.log10(WALK_STARTS * (end - i)) + turns * math.log10(TURNS))
    return min(best[n], max(enough, 0.0)) if math.isinf(best[n]) else best[n]


def find(text: str | None, ranks: dict[str, int], secure: float = SECURE) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of all spans, in order."""
    if not text:
        return []
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    for m in CONTEXT.finditer(text):
        a, b = m.span(m.lastindex)
        value = m[m.lastindex]
        if m.lastindex == 3:
            b -= len(value) - len(value := value.rstrip(".:!?)]}>"))
        # one kind of letter only is prose, unless it is quoted, assigned or in a column of its own
        assigned = any(c in ":=\t" for c in text[m.start() : a])
        plain = m.lastindex == 3 and not assigned and value.isalpha() and (value.islower() or value.istitle())
        if b - a >= 6 and not plain and guess_cost(value, ranks, secure) >= secure:
            spans.append((a, 3, b))
    return sorted(set(spans))


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def word_ranks(docs: DataFrame, size: int = DICTIONARY) -> dict[str, int]:
    """Ranks of the common passwords and of the most frequent words of all documents, as many whole
    steps of frequency as ``size`` words hold."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["word", "n"])

        for part in slices(batches):
            for text in part.column(0).to_pylist():
                seen.update(text.lower().split())
            if len(seen) > 250_000:
                yield rows()
                seen.clear()
        yield rows()

    counts = docs.select("text").where("text is not null").mapInArrow(count, "word string, n long")
    word = F.regexp_extract("word", r"^[^\p{L}]*(\p{L}{3,20})[^\p{L}]*$", 1)
    words = materialise(counts.select(word.alias("word"), "n").where("word != ''").groupBy("word").agg(F.sum("n").alias("n")), "words")
    # A histogram of the counts' logarithms says which of them the most frequent words have, so that
    # no task sends more of them than there are in all.
    level, cut, left = F.floor(F.log2("n") * 16).cast("int"), None, size
    for r in words.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():  # 16 a doubling
        left -= r["count"]
        if left < 0:
            break
        cut = r["level"]
    ranks = {w: i for i, w in enumerate(COMMON, 1)}
    if cut is not None:
        for r in sorted(words.where(level >= cut).collect(), key=lambda r: (-r["n"], r["word"])):
            ranks.setdefault(r["word"], len(ranks) + 1)
    return ranks


def scan(docs: DataFrame, ranks: dict[str, int], secure: float = SECURE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_guess, base_sha256, spans."""
    docs = docs.select("doc_id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(ranks)  # DICTIONARY words at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for part in slices(batches):
            rows = []
            for text in part.column("text").to_pylist():
                spans = find(text, words, secure)
                base = [s for s in spans if s[1] < 3]
                n = Counter(k for _, k, _ in spans)
                rows.append((n[0], n[1], n[2], n[3], hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans)))
            types = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*rows), types))], ["doc_id", "n_assign", "n_access", "n_hex", "n_guess", "base_sha256", "spans"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string")


def redact(docs: DataFrame, ranks: dict[str, int], secure: float = SECURE, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span, overlapping ones as one, replaced by ``mark``; other columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def cleaned(text: str | None) -> str | None:
        out, at = [], 0
        for a, _, b in find(text, shared.value, secure):
            if a >= at:
                out += [text[at:a], mark]
            at = max(at, b)
        return "".join(out) + text[at:] if out else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            at = part.schema.get_field_index("text")
            new = pa.array([cleaned(t) for t in part.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([new if i == at else c for i, c in enumerate(part.columns)], part.schema.names)

    return docs.mapInArrow(run, docs.schema)


def op2_guess_cost_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan(docs, word_ranks(docs))
