"""Operator 11: repair of the structure of conversations by iterative-deepening A*.

A conversation is its rows in order of turn. The first fault of a row counts: blank, duplicate (role and
text seen earlier in it) or truncated (no end mark). The cheapest edits are sought after which the roles'
initials read ``(s?(ua)+)?``: keep a row (free), give it the role user or assistant (3), delete it (4; blank
and duplicate rows must be), insert an empty turn of either role (3); a truncated row that stays costs 3
more. Of equally cheap edits the first in ASCII order is taken.

*Search* (``search``). Depth first over (row, state of the grammar), edits tried in ASCII order, cut where the
cost so far and a lower bound of the rest (forced deletions, truncated rows) exceed the bound; if none is
accepted, the bound is raised to the least cost that exceeded it. A table keeps the budget that failed at
each (row, state), for all later bounds. The first accepting path is the answer.

*Scale.* Rows are placed by range partitions over hashes of their texts, and cut into segments of
``SEGMENT`` rows; a segment is searched from every state to every state, and neighbours are joined pairwise
in rounds. That gives the same edits: two equally cheap edit lists of one segment have the same cost of their
letters, so neither begins with the other, and the order of wholes is the order of the first differing
segment. So a conversation of any length is spread over tasks. Texts move once, to the task that
hashes their conversation's repaired lines as they come (SHA-256 has no parallel form), in memory of a row.

Defined results: null ids, turns, roles and texts are one space wherever they are read, a null turn comes
first and doesn't count in gaps; a null conv_id is a conversation; rows of one turn are ordered by role and a
hash of role and text; repeated rows are duplicates; very long texts are streamed like others; a
conversation without rows after damage has zeros, an empty audit and the hash of the empty string; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CRC_SQL, materialise, slices, table
from .placing import placed

RENAME, DELETE, INSERT, CUT = 3, 4, 3, 3
SEGMENT = 32
FANIN = 16
#: States of the grammar: nothing yet, after s, after u, after a; what each initial leads to.
NEXT = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
ACCEPTING = (0, 3)
ENDS = ".!?"
ROLE = {"u": "user", "a": "assistant"}
MOST = 1 << 60


# -- the search -----------------------------------------------------------------------------------


def options(row: str, state: int) -> Iterator[tuple[str, int, int, int]]:
    """(edit, cost, rows consumed, next state) at a row, in ASCII order of the edits; upper case: to or of
    user, lower case: of assistant. A row is its initial, lower case if sound, upper case if truncated; ``-``:
    must be deleted; none at the end."""
    if row:
        yield "D", DELETE, 1, state
    for role, edit in (("u", "I"), ("a", "i")):
        if role in NEXT[state]:
            yield edit, INSERT, 0, NEXT[state][role]
    if row and row != "-":
        stays = CUT if row.isupper() else 0
        own = row.lower()
        if own in NEXT[state]:
            yield "K", stays, 1, NEXT[state][own]
        for role, edit in (("u", "R"), ("a", "r")):
            if role != own and role in NEXT[state]:
                yield edit, RENAME + stays, 1, NEXT[state][role]


def search(rows: str, start: int, ends: tuple[int, ...]) -> tuple[int, str] | None:
    """(cost, edits) of the first cheapest path over all rows that begins in ``start`` and ends in one of
    ``ends``; None if there is none."""
    n = len(rows)
    forced = [0] * (n + 1)  # what the rows from here on cost at least
    for i in range(n - 1, -1, -1):
        forced[i] = forced[i + 1] + (DELETE if rows[i] == "-" else CUT if rows[i].isupper() else 0)
    failed: dict[tuple[int, int], int] = {}  # what the rest costs at least, of states that a bound has failed at

    def descend(i: int, state: int, left: int) -> str | None:
        if i == n and state in ends:
            return ""
        needed = MOST
        for edit, cost, step, to in options(rows[i : i + 1], state):
            rest = failed.get((i + step, to), forced[i + step])
            if rest <= left - cost:
                path = descend(i + step, to, left - cost)
                if path is not None:
                    return edit + path
                rest = failed[i + step, to]
            needed = min(needed, cost + rest)
        failed[i, state] = needed
        return None

    bound = forced[0]
    while bound <= DELETE * n + 3 * INSERT:  # deleting all and inserting leads wherever a path leads
        path = descend(0, start, bound)
        if path is not None:
            return bound, path
        bound = failed[0, start]
    return None


@lru_cache(1 << 16)
def ways(rows: str, first: bool, last: bool) -> tuple[tuple[int, int, int, str], ...]:
    """(start, end, cost, edits) of a segment: from every state to every state, of which the conversation's
    first segment begins in one, and its last ends in an accepting one (0)."""
    found = []
    for start in (0,) if first else range(len(NEXT)):
        for ends in (ACCEPTING,) if last else ((q,) for q in range(len(NEXT))):
            path = search(rows, start, ends)
            if path:
                found.append((start, ends[0], *path))
    return tuple(found)


def better(a: tuple[int, str], b: tuple[int, str] | None) -> bool:
    return b is None or (a[0], a[1].upper()) < (b[0], b[1].upper())


def joined(parts: list[list[tuple[int, int, int, str]]]) -> list[tuple[int, int, int, str]]:
    """The ways over neighbouring segments, one after another."""
    so_far = {(s, e): (c, m) for s, e, c, m in parts[0]}
    for part in parts[1:]:
        longer: dict[tuple[int, int], tuple[int, str]] = {}
        for (s, mid), (c, m) in so_far.items():
            for s2, e, c2, m2 in part:
                if s2 == mid and better((c + c2, m + m2), longer.get((s, e))):
                    longer[s, e] = (c + c2, m + m2)
        so_far = longer
    return [(s, e, c, m) for (s, e), (c, m) in so_far.items()]


WAYS = "array<struct<start: int, end: int, cost: bigint, moves: string>>"


def ways_of(pattern: Column, first: Column, last: Column) -> Column:
    @F.pandas_udf(WAYS)
    def found(p: pd.Series, f: pd.Series, l: pd.Series) -> pd.Series:  # noqa: E741
        return pd.Series([[dict(zip(("start", "end", "cost", "moves"), w)) for w in ways(*x)] for x in zip(p, f, l)])

    return found(pattern, first, last)


def joined_ways(parts: Column) -> Column:
    @F.pandas_udf(WAYS)
    def found(s: pd.Series) -> pd.Series:
        out = [joined([[(w["start"], w["end"], w["cost"], w["moves"]) for w in part["ways"]] for part in parts]) for parts in s]
        return pd.Series([[dict(zip(("start", "end", "cost", "moves"), w)) for w in one] for one in out])

    return found(parts)


# -- the rows -------------------------------------------------------------------------------------


def spaced(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(" "))


def trimmed(text: Column) -> Column:
    return F.rtrim(text, F.lit(" \t\n\x0b\x0c\r"))


def damaged(turns: DataFrame) -> DataFrame:
    """conv, turn, role, text, key and how many ``copies`` of each row the stated damage leaves."""
    what = F.crc32(F.concat(spaced(F.col("conv_id")), F.lit(":"), spaced(F.col("turn"))).cast("binary")) % 20
    text, role = spaced(F.col("text")), spaced(F.col("role"))
    out = turns.select(
        spaced(F.col("conv_id")).alias("conv"), F.col("turn").cast("long").alias("turn"), F.when(what == 4, "user").otherwise(role).alias("role"),
        F.when(what == 1, "").when(what == 2, F.regexp_replace(text, f"[{ENDS}]", "")).otherwise(text).alias("text"), F.when(what == 0, 0).when(what == 3, 2).otherwise(1).alias("copies"),
    )
    return with_key(out).where("copies > 0")


def with_key(rows: DataFrame) -> DataFrame:
    return rows.withColumn("key", F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256))


def faults(rows: DataFrame) -> DataFrame:
    """conv, pos, n, turn, role, key, initial and fault of rows (conv, turn, role, text, key, copies)."""
    body = trimmed(F.col("text"))
    sound = F.when(body == "", "blank").when(~F.right(body, F.lit(1)).isin(*ENDS), "truncated")
    slim = rows.select("conv", "turn", "role", "key", sound.alias("sound"), F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("_")).drop("_")
    rows = materialise(placed(materialise(slim, "turns"), ["conv"], ["turn", "role", "key"]), "turns")
    first = rows.groupBy("conv", "key").agg(F.min("pos").alias("first"))
    again = F.when(F.col("pos") > F.col("first"), "duplicate")
    blank = F.when(F.col("sound") == "blank", "blank")
    return rows.join(first, ["conv", "key"]).withColumn("fault", F.coalesce(blank, again, "sound")).withColumn("initial", F.substring("role", 1, 1)).drop("sound", "first")


def segments(rows: DataFrame) -> DataFrame:
    """conv, seg, n, rows (pos, turn, role, key), pattern and counts of faults and illegal neighbours."""
    seg = F.floor(F.col("pos") / SEGMENT)
    # a segment also sees the first row of the next one, for the pair at the joint
    both = F.when((F.col("pos") % SEGMENT == 0) & (F.col("pos") > 0), F.array(seg, seg - 1)).otherwise(F.array(seg))
    item = F.struct("pos", "turn", "role", "key", "initial", "fault")
    grouped = rows.select("conv", "n", F.explode(both).alias("seg"), item.alias("item")).groupBy("conv", "n", "seg").agg(F.array_sort(F.collect_list("item")).alias("seen"))  # SEGMENT + 1 at most
    own = F.filter("seen", lambda x: F.floor(x["pos"] / SEGMENT) == F.col("seg"))
    letter = lambda x: F.when(x["fault"].isin("blank", "duplicate"), "-").otherwise(F.when(x["initial"].isin("s", "u", "a"), x["initial"]).otherwise("x"))
    shown = lambda x: F.when(x["fault"] == "truncated", F.upper(letter(x))).otherwise(letter(x))
    pairs = F.zip_with(F.slice("seen", F.lit(1), F.size("seen") - 1), F.slice("seen", F.lit(2), F.size("seen")), lambda a, b: F.concat(a["initial"], b["initial"]))
    counted = lambda k: F.size(F.filter("rows", lambda x: x["fault"] == k)).cast("long").alias(k)
    counts = [counted(k) for k in ("blank", "duplicate", "truncated")]
    illegal = F.size(F.filter(F.when(F.size("seen") > 1, pairs).otherwise(F.array().cast("array<string>")), lambda p: ~p.isin("su", "ua", "au"))).cast("long").alias("illegal")
    return grouped.withColumn("rows", own).select("conv", "seg", "n", "rows", F.array_join(F.transform("rows", shown), "").alias("pattern"), *counts, illegal)


def cheapest(parts: DataFrame) -> DataFrame:
    """conv, cost, moves of the segments' conversations."""
    last = F.ceil(F.col("n") / SEGMENT) - 1
    found = materialise(parts.select("conv", "seg", ways_of(F.col("pattern"), F.col("seg") == 0, F.col("seg") == last).alias("ways")), "ways")
    most = found.agg(F.max("seg")).first()[0] or 0
    while most > 0:
        grouped = found.groupBy("conv", F.floor(F.col("seg") / FANIN).alias("seg")).agg(F.array_sort(F.collect_list(F.struct("seg", "ways"))).alias("parts"))  # FANIN at most
        found = materialise(grouped.select("conv", "seg", joined_ways(F.col("parts")).alias("ways")), "ways")
        most //= FANIN
    return found.select("conv", F.get("ways", F.lit(0)).alias("way")).select("conv", "way.cost", "way.moves")


def edits(parts: DataFrame, best: DataFrame) -> DataFrame:
    """conv, turn, role, key, pos, edit of all rows but those that are simply deleted."""
    of = F.regexp_extract_all("moves", F.lit(rf"(?:[Ii]*[DKRr]){{1,{SEGMENT}}}(?:[Ii]+\z)?"), F.lit(0))
    pieces = best.select("conv", F.posexplode(of).alias("seg", "piece"))
    each = F.regexp_extract_all("piece", F.lit(r"[Ii]*[DKRr](?:[Ii]+\z)?"), F.lit(0))
    met = parts.select("conv", "seg", "rows").join(pieces, ["conv", "seg"])
    rows = met.select("conv", F.explode(F.arrays_zip("rows", each.alias("edits"))).alias("x"))
    return rows.select("conv", "x.rows.turn", "x.rows.role", "x.rows.key", "x.rows.pos", F.col("x.edits").alias("edit")).where("edit != 'D'")


def repaired(texts: DataFrame, edited: DataFrame) -> DataFrame:
    """conv, repaired_sha256: texts and edits of a conversation meet in its order; rows of one key come
    together, edits before their text."""
    texts = texts.select("conv", "turn", "role", "key", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("pos"), F.lit("").alias("edit"), "text")
    edited = edited.select("conv", "turn", "role", "key", F.lit(0).alias("kind"), "pos", "edit", F.lit(None).cast("string").alias("text"))
    rows = texts.unionByName(edited).repartition("conv").sortWithinPartitions("conv", "turn", "role", "key", "kind", "pos")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = lambda c, h: pa.RecordBatch.from_pydict({"conv": [c], "repaired_sha256": [h.hexdigest()]})
        conv, h, begun, waiting = None, None, False, []
        for part in slices(batches):
            for c, role, edit, text in zip(*(part.column(k).to_pylist() for k in ("conv", "role", "edit", "text"))):
                if c != conv:
                    if h is not None:
                        yield out(conv, h)
                    conv, h, begun, waiting = c, hashlib.sha256(), False, []
                if text is None:
                    waiting.append(edit)
                    continue
                for e in "".join(waiting):
                    if e != "D":
                        h.update(b"\n" if begun else b"")
                        h.update((role if e == "K" else ROLE["u" if e.isupper() else "a"]).encode() + b":")
                        h.update(text.encode() if e in "KRr" else b"")
                        begun = True
                waiting = []
        if h is not None:
            yield out(conv, h)

    return rows.mapInArrow(hashed, "conv string, repaired_sha256 string")


def repair(turns: DataFrame, damage: bool = True) -> DataFrame:
    """One row a conversation of ``turns`` (conv_id, turn, role, text): conv_id, gaps, blank, duplicate,
    truncated, illegal, cost, audit, repaired_sha256."""
    plain = lambda t: with_key(t.select(spaced(F.col("conv_id")).alias("conv"), F.col("turn").cast("long").alias("turn"), spaced(F.col("role")).alias("role"), spaced(F.col("text")).alias("text"), F.lit(1).alias("copies")))
    rows = (damaged if damage else plain)(turns)
    marked = faults(rows)
    parts = materialise(segments(marked), "segments")
    best = materialise(cheapest(parts), "repairs")
    hashes = repaired(rows, edits(parts, best))
    span = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps")
    gaps = rows.select("conv", "turn").distinct().groupBy("conv").agg(span)
    counts = parts.groupBy("conv").agg(*(F.sum(k).alias(k) for k in ("blank", "duplicate", "truncated", "illegal")))
    ids = turns.select("conv_id", spaced(F.col("conv_id")).alias("conv")).distinct()
    out = ids.join(gaps, "conv", "left").join(counts, "conv", "left").join(best, "conv", "left").join(hashes, "conv", "left")
    zero = [F.coalesce(k, F.lit(0)).cast("long").alias(k) for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zero, F.coalesce(F.upper("moves"), F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(table(spark, sf_dir, "conversations"))


#: Values of (state, letters inserted, state after them), and of the grammar's steps.
_INSERTS = "(0,'',0),(0,'I',2),(0,'Ii',3),(1,'',1),(1,'I',2),(1,'Ii',3),(2,'',2),(2,'i',3),(2,'iI',2),(3,'',3),(3,'I',2),(3,'Ii',3)"
_STEPS = "(0,'s',1),(0,'u',2),(1,'u',2),(2,'a',3),(3,'u',2)"
_BODY = r"regexp_replace(text, '[\x20\x09-\x0D]+$', '')"
#: Cheapest edits by dynamic programming from the last row to the first, not by search.
ORACLE = rf"""WITH RECURSIVE src AS (SELECT conv_id, coalesce(CAST(conv_id AS VARCHAR), ' ') AS conv, CAST(turn AS BIGINT) AS turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS id FROM conversations),
crc AS (SELECT *, @CRC@ % 20 AS what FROM src),
dam AS (SELECT conv, turn, CASE what WHEN 4 THEN 'user' ELSE role END AS role, CASE what WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM crc, LATERAL (SELECT unnest(range(CASE what WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy) c),
pos AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, sha256(strlen(role) || ':' || role || text)) - 1 AS pos, count(*) OVER (PARTITION BY conv) AS n, {_BODY} AS body FROM dam),
fault AS (SELECT *, substr(role, 1, 1) AS initial, lag(substr(role, 1, 1)) OVER (PARTITION BY conv ORDER BY pos) || substr(role, 1, 1) AS pair,
  CASE WHEN body = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY pos) > 1 THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault FROM pos),
ins AS (SELECT * FROM (VALUES {_INSERTS}) v(q, put, mid)),
steps AS (SELECT * FROM (VALUES {_STEPS}) v(q, c, q2)),
dp AS (SELECT DISTINCT conv, n AS i, q, cost, moves FROM fault, (VALUES (0, 0, ''), (1, 6, 'Ii'), (2, 3, 'i'), (3, 0, '')) e(q, cost, moves)
  UNION ALL SELECT conv, i, q, cost, moves FROM (SELECT dp.conv, dp.i - 1 AS i, ins.q, o.cost + dp.cost + {INSERT} * length(put) AS cost, put || o.edit || dp.moves AS moves
    FROM dp JOIN fault f ON f.conv = dp.conv AND f.pos = dp.i - 1, ins,
    LATERAL (SELECT 'D' AS edit, {DELETE} AS cost WHERE ins.mid = dp.q UNION ALL
      SELECT CASE WHEN c = f.initial THEN 'K' WHEN c = 'u' THEN 'R' ELSE 'r' END, CASE WHEN c = f.initial THEN 0 ELSE {RENAME} END + CASE WHEN f.fault = 'truncated' THEN {CUT} ELSE 0 END FROM steps
      WHERE steps.q = ins.mid AND q2 = dp.q AND (c = f.initial OR c <> 's') AND coalesce(f.fault, '') NOT IN ('blank', 'duplicate')) o) z
  QUALIFY row_number() OVER (PARTITION BY conv, q ORDER BY cost, upper(moves)) = 1),
best AS (SELECT conv, cost, moves FROM dp WHERE i = 0 AND q = 0),
edit AS (SELECT f.*, regexp_extract_all(moves, '[Ii]*[DKRr](?:[Ii]+$)?')[f.pos + 1] AS edit FROM fault f JOIN best USING (conv)),
line AS (SELECT conv, pos, k, CASE substr(edit, k, 1) WHEN 'I' THEN 'user:' WHEN 'i' THEN 'assistant:' WHEN 'K' THEN role || ':' || text WHEN 'R' THEN 'user:' || text WHEN 'r' THEN 'assistant:' || text END AS line FROM edit, LATERAL (SELECT unnest(range(1, length(edit) + 1)) AS k) x),
body AS (SELECT conv, sha256(string_agg(line, chr(10) ORDER BY pos, k)) AS repaired FROM line WHERE line IS NOT NULL GROUP BY conv),
stat AS (SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM fault GROUP BY conv)
SELECT s.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(upper(moves), '') AS audit, coalesce(repaired, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, conv FROM src) s LEFT JOIN stat USING (conv) LEFT JOIN best USING (conv) LEFT JOIN body USING (conv)""".replace("@CRC@", CRC_SQL.format(x="id"))
