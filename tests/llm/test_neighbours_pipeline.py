import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.llm import neighbours
from tidewright.llm import queries as llm


def test_recall_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 32))
    x = np.concatenate([(centres[rng.integers(0, 20, 1500)] + 0.4 * rng.normal(size=(1500, 32))), np.repeat(centres[:1], 40, 0)]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(9000, None), (9100, [0.0] * 32), (9200, [float("nan")] * 32), (9300, [1.0] * 3), (9400, [None] + [1.0] * 31), (None, [1.0] * 32)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    got = {}
    for r in neighbours.search(df.repartition(6), F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 1540, 100))
    recall = []
    for q, found in got.items():
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(len(d)), d))[:10]
        recall.append(len({v for v, _ in found} & set(want.tolist())) / 10)
        assert len(found) == 10 and [s for _, s in found] == pytest.approx([d[v] for v, _ in found])
        assert [v for v, _ in found] == [v for v, _ in sorted(found, key=lambda f: (round(f[1], 12), f[0]))]
    assert np.mean(recall) >= 0.9
    few = neighbours.search(df.where("vec_id < 5"), F.col("vec_id") % 100 == 0)
    assert few.count() == 4
    assert neighbours.search(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_three_valid_vectors_among_ten_thousand(spark):
    bad = [None, [0.0, 0.0], [float("nan"), 1.0], [float("inf"), 1.0], [None, 1.0]]
    rows = [(i, bad[i % 5]) for i in range(1, 10_000) if i not in (100, 4321, 7777)] + [(100, [1.0, 0.0]), (4321, [0.5, 0.5]), (7777, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash")).withColumn("block", F.lit(1))
    got = [tuple(r) for r in neighbours.search(df, F.col("vec_id") % 100 == 0).orderBy("rank").collect()]
    assert [r[:3] for r in got] == [(100, 1, 4321), (100, 2, 7777)] and got[1][3] == 2.0
    assert neighbours.search(df.where("vec_id not in (100, 4321, 7777)"), F.col("vec_id") % 100 == 0).count() == 0


def test_repeated_rows_are_one_neighbour(spark):
    x = np.random.default_rng(3).normal(size=(300, 16)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    once, often = (neighbours.search(d.coalesce(1), F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect() for d in (df, df.union(df).union(df)))
    got = {}
    for r in often:
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert {q: len(set(v)) for q, v in got.items()} == {0: 10, 100: 10, 200: 10}
    # the radius learned on the sample differs, so the index is compared on one radius
    codes = neighbours.Coder(x.astype(float)).codes(x.astype(float))
    plain = neighbours.Index(np.arange(300), x.astype(float), codes)
    thrice = neighbours.Index(np.tile(np.arange(300), 3), np.tile(x.astype(float), (3, 1)), np.tile(codes, 3))
    for q in range(0, 300, 50):
        a, b = (i.nearest(q, x[q].astype(float), codes[q], neighbours.BITS, 10) for i in (plain, thrice))
        assert a[0].tolist() == b[0].tolist() and a[1] == pytest.approx(b[1])
    assert len(once) == 30


def test_radius_finds_every_code():
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 1 << 63, 500).astype(np.uint64)
    index = neighbours.Index(np.arange(500), rng.normal(size=(500, 4)), codes)
    for radius in (0, 7, 22, 30):
        for c in codes[:20] ^ np.uint64(5):
            assert set(index.within(c, radius)) == set(np.flatnonzero(np.bitwise_count(codes ^ c) <= radius))


def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs.count()
    for name, stage in cp.STAGES[:-1]:
        out = cp.materialise(stage(spark, docs, sf), name)
        assert out.columns == docs.columns and 0.7 * before < out.count() <= docs.count()
        docs = out
    packed = cp.STAGES[-1][1](spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == docs.count()
    assert docs.where(F.col("text").rlike("AKIA[A-Z0-9]{16,}|[0-9a-f]{24,}")).count() == 0


def test_pipeline_with_odd_rows(spark):
    import corpus_pipeline as cp

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("key", F.lit("k")).withColumn("bands", F.lit(1)).withColumn("item", F.lit(None).cast("string"))
    first = docs.where("doc_id = 1")
    odd = docs.limit(1).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in docs.schema))
    empty = odd.withColumn("doc_id", F.lit(-1).cast(docs.schema["doc_id"].dataType)).withColumn("text", F.lit(""))
    long = first.withColumn("doc_id", F.lit(-2).cast(docs.schema["doc_id"].dataType)).withColumn("text", F.concat(F.lit("once upon a time "), F.repeat(F.concat(F.col("text"), F.lit(" ")), 1_200_000 // 100)))
    mixed = docs.unionByName(first).unionByName(first).unionByName(odd).unionByName(empty).unionByName(long)
    for name, stage in cp.STAGES[:-1]:
        out = cp.materialise(stage(spark, mixed, sf), name)
        assert out.columns == docs.columns
        mixed = out
    ids = [r["doc_id"] for r in mixed.select("doc_id").collect()]
    assert ids.count(1) == 1 and -1 not in ids and None not in ids
    packed = cp.STAGES[-1][1](spark, mixed, sf)
    assert packed.select("doc_id").distinct().count() == len(ids)
    none = docs.limit(0)
    for name, stage in cp.STAGES:
        none = cp.materialise(stage(spark, none, sf), name)
        assert none.count() == 0


@pytest.mark.parametrize("name", sorted(llm.QUERIES))
def test_queries_run(spark, name):
    out = llm.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert out.count() > 0
