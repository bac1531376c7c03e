import hashlib
import heapq
import math
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from tidewright.llm import merkle, mixing, repair

TURNS = "conv_id long, turn long, role string, text string"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(df, places=6):
    return sorted((tuple(round(v, places) if isinstance(v, float) else v for v in (r[c] for c in sorted(df.columns))) for r in df.collect()), key=repr)


def by_sql(sql, name, df):
    con = duckdb.connect()
    con.register(name, df.toArrow())
    got = con.sql(sql)
    order = [got.columns.index(c) for c in sorted(got.columns)]
    return sorted((tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order) for r in got.fetchall()), key=repr)


# -- conversation repair --------------------------------------------------------------------------


def cheapest_first(rows, start, ends):
    """All paths by cost, then by letters."""
    heap = [(0, "", "", 0, start)]
    while heap:
        cost, shown, path, i, state = heapq.heappop(heap)
        if cost > 4 * len(rows) + 9:
            return None
        if i == len(rows) and state in ends:
            return cost, path
        for edit, more, step, to in repair.options(rows[i : i + 1], state):
            heapq.heappush(heap, (cost + more, shown + edit.upper(), path + edit, i + step, to))


def test_search_against_all_paths_by_cost():
    rng = random.Random(1)
    for _ in range(400):
        rows = "".join(rng.choice("suaxSUAX-") for _ in range(rng.randint(0, 5)))
        for start, ends in [(0, (0, 3)), (0, (1,)), (2, (2,)), (3, (1,)), (1, (3,))]:
            assert repair.search(rows, start, ends) == cheapest_first(rows, start, ends), (rows, start, ends)


def test_ways_of_segments_join_to_the_whole():
    rng = random.Random(2)
    for _ in range(150):
        rows = "".join(rng.choice("suuuaaaUA-x") for _ in range(rng.randint(4, 14)))
        cuts = sorted(rng.sample(range(1, len(rows)), 2))
        parts = [rows[: cuts[0]], rows[cuts[0] : cuts[1]], rows[cuts[1] :]]
        (got,) = repair.joined([repair.ways(p, k == 0, k == 2) for k, p in enumerate(parts)])
        assert got[2:] == repair.search(rows, 0, (0, 3))


def test_search_of_bad_segments_is_bounded():
    for rows in ("-" * 32, "x" * 32, "uu" * 16, "aU" * 16, "sS" * 16, "XA-u" * 8):
        assert all(len(w[3]) >= 32 for w in repair.ways(rows, False, False))


def odd_turns():
    rng = random.Random(3)
    said = ["Yes.", "No!", "why", "", "  \n", "Well?", "a.b", None, "long " * 3000 + "."]
    rows = [(c, t, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), rng.choice(said)) for c in range(60) for t in range(rng.randint(1, 9))]
    rows += [(100, t, "user" if t % 2 == 0 else "assistant", f"text {t % 300}.") for t in range(700)]  # a long one
    rows += [(101, 5, "user", "Same.")] * 90  # one row again and again
    rows += [(None, 1, "user", "Hi."), (None, None, "assistant", "Yes."), (102, None, "user", None), (103, 7, "user", "x."), (103, 7, "assistant", "y."), (103, 7, "user", "z.")]
    return rows


def test_repair_against_dynamic_programming_in_sql(spark):
    df = spark.createDataFrame(odd_turns(), TURNS).repartition(5)
    assert rows_of(repair.repair(df.withColumn("conv", F.lit("x")).withColumn("pos", F.lit(1)))) == by_sql(repair.ORACLE, "conversations", df)


def test_repair_of_rows_as_they_are(spark):
    df = spark.createDataFrame([(1, 0, "system", "Be brief."), (1, 1, "user", "Hi?"), (1, 2, "assistant", "Hi."), (1, 3, "assistant", "More."), (2, 0, "assistant", "No."), (3, 1, "user", "One."), (3, 5, "user", "Two.")], TURNS)
    got = {r["conv_id"]: r for r in repair.repair(df, damage=False).collect()}
    assert (got[1]["cost"], got[1]["audit"], got[1]["illegal"]) == (3, "KKKIK", 1)
    assert got[1]["repaired_sha256"] == hashlib.sha256(b"system:Be brief.\nuser:Hi?\nassistant:Hi.\nuser:\nassistant:More.").hexdigest()
    assert (got[2]["cost"], got[2]["audit"]) == (3, "IK") and (got[3]["cost"], got[3]["audit"], got[3]["gaps"]) == (3, "KR", 3)
    assert got[3]["repaired_sha256"] == hashlib.sha256(b"user:One.\nassistant:Two.").hexdigest()


def test_repair_of_nothing(spark):
    assert repair.repair(spark.createDataFrame([], TURNS)).collect() == []
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    (r,) = repair.repair(spark.createDataFrame([(dropped, 0, "user", "Hi.")], TURNS)).collect()
    assert tuple(r)[1:8] == (0, 0, 0, 0, 0, 0, "") and r["repaired_sha256"] == hashlib.sha256(b"").hexdigest()


# -- Merkle manifest ------------------------------------------------------------------------------


def plain_tree(nodes):
    """(root, siblings of each leaf by level)."""
    sides = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        for leaf, k in enumerate(at):
            run = nodes[k // 3 * 3 : k // 3 * 3 + 3]
            sides[leaf].append(("".join(run[: k % 3]), "".join(run[k % 3 + 1 :])))
        nodes = [hashlib.sha256("".join(nodes[i : i + 3]).encode()).hexdigest() for i in range(0, len(nodes), 3)]
        at = [k // 3 for k in at]
    return nodes[0], sides


def plain_manifest(rows):
    one = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda d, text, lang, source, n: hashlib.sha256("".join(map(one, (d, source, lang, n, text))).encode()).hexdigest()
    out, subs, of = [], [], {}
    for source in sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode())):
        own = sorted(((r[0], leaf(*r), r) for r in rows if r[3] == source), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        of[source] = (own, *plain_tree([x[1] for x in own]))
        subs.append(of[source][1])
    root, tops = plain_tree(subs)
    for (own, sub, sides), top in zip(of.values(), tops):
        for (d, node, (_, text, lang, source, n)), side in zip(own, sides):
            path = side + top
            if zlib.crc32(str(d if d is not None else "").encode()) % 2 == 0:
                text = text and text.replace("\n", "")
            folded = leaf(d, text, lang, source, n)
            for left, right in path:
                folded = hashlib.sha256((left + folded + right).encode()).hexdigest()
            out.append((d, folded, node, hashlib.sha256("".join(a + b for a, b in path).encode()).hexdigest(), root, sub, folded == root))
    return sorted(out, key=repr)


def test_manifest_against_a_plain_tree(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a\nb", "word " * rng.randint(0, 9), "", None, "é\n" * 5]), rng.choice(["en", None]), "hot", i) for i in range(900)]
    rows += [(rng.randint(0, 50), f"t{i}\n", "de", rng.choice(["x", "ü", "", None]), None) for i in range(40)] + [(None, "a\nb", "en", "x", 3), (7, "lone", "en", "one", 4), (7, "same\n", "en", "x", 5), (7, "same\n", "en", "x", 5), (8, "y\n" * 200_000, "en", "one", 9)]
    df = spark.createDataFrame(rows, DOCS).repartition(7).withColumn("tree", F.lit("clash")).withColumn("pos", F.lit(1)).withColumn("node", F.lit("z"))
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = merkle.op12_merkle_manifest(spark, str(tmp_path))
    assert rows_of(got) == plain_manifest(rows)


def test_manifest_of_many_sources_and_of_nothing(spark, tmp_path):
    rows = [(i, f"t{i}", "en", f"s{i % 600:03d}", i) for i in range(700)]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "a" / "documents.parquet"))
    assert rows_of(merkle.op12_merkle_manifest(spark, str(tmp_path / "a"))) == plain_manifest(rows)
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "b" / "documents.parquet"))
    assert merkle.op12_merkle_manifest(spark, str(tmp_path / "b")).collect() == []


# -- mixing ---------------------------------------------------------------------------------------


def plain_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while len(fixed) < len(names):
        level = (total - sum(fixed.values())) / sum(weight[s] for s in names if s not in fixed)
        over = [s for s in names if s not in fixed and weight[s] * level > 3 * sizes[s]]
        if not over:
            return fixed | {s: weight[s] * level for s in names if s not in fixed}
        fixed |= {s: 3.0 * sizes[s] for s in over}
    return fixed


def odd_documents():
    rng = random.Random(5)
    rows = [(i, " ".join("w" * rng.randint(1, 6) for _ in range(int(rng.paretovariate(0.7)) % 4000)), "en", rng.choice(["hot"] * 4 + ["b", "c", "ü", None]), 0) for i in range(300)]
    rows += [(1000, "one two\tthree\n", "en", "tiny", 0), (1001, None, "en", "void", 0), (1002, " \n ", "en", "void", 0), (1003, "word " * 40_000, "en", "giant", 0)]
    return rows + [(5, "other text here", "en", "hot", 0), (5, "other text here", "en", "hot", 0), (5, "other text there", "en", "hot", 0), (None, "no id", "en", None, 0)]


def test_mix_against_sums_of_blocks_in_sql(spark, tmp_path):
    rows = odd_documents()
    df = spark.createDataFrame(rows, DOCS)
    df.withColumn("size", F.lit("clash")).withColumn("shard", F.lit(3)).write.parquet(str(tmp_path / "documents.parquet"))
    got = mixing.op13_source_mix(spark, str(tmp_path))
    assert rows_of(got, 4) == [tuple(round(v, 4) if isinstance(v, float) else v for v in r) for r in by_sql(mixing.ORACLE, "documents", df)]
    sizes, taken = {}, {}
    for r, (_, text, _, source, _) in ((None, x) for x in rows):
        sizes[source] = sizes.get(source, 0) + len([w for w in (text or "").replace("\t", " ").replace("\n", " ").split(" ") if w])
    want = plain_targets(sizes)
    for r in mixing.mix(df).collect():
        words = sum(d["words"] for d in r["draws"])
        assert words <= 3 * r["size"] and math.isclose(r["target"], want[r["source"]], rel_tol=1e-9, abs_tol=1e-9)
        taken[r["source"]] = taken.get(r["source"], 0) + words
    assert all(abs(taken[s] - want[s]) <= 0.5 + 1e-6 for s in want)


def test_shards_take_their_blocks_once(spark):
    df = spark.createDataFrame(odd_documents(), DOCS)
    pieces = [(r["source"], d) for n in (1, 6) for r in mixing.mix(df.repartition(n), shards=12, block=256).collect() for d in r["draws"]]
    half = len(pieces) // 2
    assert sorted(map(repr, pieces[:half])) == sorted(map(repr, pieces[half:]))  # reruns agree
    blocks = {(s, d["draw"]): d["shard"] for s, d in pieces}
    assert all(blocks[s, d["draw"]] == d["shard"] for s, d in pieces) and {*blocks.values()} == {*range(12)}
    held = [sum(v == k for v in blocks.values()) for k in range(12)]
    assert max(held) - min(held) <= 1  # every shard has its number of blocks
    for s in {s for s, _ in blocks}:
        draws = sorted(d for s2, d in blocks if s2 == s)
        assert draws == list(range(len(draws))) and [blocks[s, d] for d in draws] == sorted(blocks[s, d] for d in draws)


def test_draws_follow_the_hypergeometric_distribution(spark):
    cases = [(10, 4, 5), (50, 20, 7), (7, 7, 3), (9, 0, 4), (1000, 600, 500), (12, 5, 12)]
    for n, k, m in cases:
        u = spark.range(4000).select(((F.col("id") + 0.5) / 4000).alias("u"))
        lit = lambda x: F.lit(x).cast("long")
        got = {r["x"]: r["count"] for r in u.select(mixing.hypergeometric(lit(n), lit(k), lit(m), F.col("u")).alias("x")).groupBy("x").count().collect()}
        for x in range(max(0, m - n + k), min(k, m) + 1):
            share = math.comb(k, x) * math.comb(n - k, m - x) / math.comb(n, m)
            assert abs(got.get(x, 0) / 4000 - share) <= 0.0006, (n, k, m, x)
        assert sum(got.values()) == 4000 and min(got) >= max(0, m - n + k) and max(got) <= min(k, m)


def test_written_mix_has_the_words_and_the_order(spark, tmp_path):
    df = spark.createDataFrame(odd_documents(), DOCS)
    mixing.write_mix(df, str(tmp_path / "mix"), shards=4, block=128)
    out = spark.read.parquet(str(tmp_path / "mix"))
    n = out.agg(F.sum("words"), F.sum(F.regexp_count("text", F.lit(mixing.WORD)))).first()
    want = mixing.mix(df, shards=4, block=128).agg(F.sum(F.aggregate("draws", F.lit(0).cast("long"), lambda s, d: s + d["words"]))).first()[0]
    assert n[0] == n[1] == want and {r["shard"] for r in out.select("shard").distinct().collect()} == {0, 1, 2, 3}


def test_mix_of_nothing(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    assert mixing.op13_source_mix(spark, str(tmp_path)).collect() == []
    assert [r["draws"] for r in mixing.mix(spark.createDataFrame([(1, None, None, None, None)], DOCS)).collect()] == [[]]


@pytest.mark.parametrize("name,op", [("conversations", repair), ("documents", merkle), ("documents", mixing)])
def test_contract_columns(spark, name, op):
    query = {repair: repair.op11_conversation_repair, merkle: merkle.op12_merkle_manifest, mixing: mixing.op13_source_mix}[op]
    kinds = {
        repair: dict(conv_id="bigint", gaps="bigint", blank="bigint", duplicate="bigint", truncated="bigint", illegal="bigint", cost="bigint", audit="string", repaired_sha256="string"),
        merkle: dict(doc_id="bigint", leaf="string", subroot="string", root="string", proof_sha256="string", folded_root="string", verified="boolean"),
        mixing: dict(doc_id="bigint", size="bigint", source_size="bigint", target="double", taken="bigint", pieces="bigint"),
    }[op]
    df = query(spark, "/root/testdata/sf0.001")
    assert dict(df.dtypes) == kinds
    assert rows_of(df) == by_sql(op.ORACLE, name, spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet"))
