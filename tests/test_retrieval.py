import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.operators import retrieval as R
from tidewright.operators import training
from tidewright.sources import tables


def vectors(n=300, d=16, seed=5):
    x = np.random.default_rng(seed).normal(size=(n, d))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def index_of(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "chunk_id long, embedding array<float>")


def test_top_k_against_numpy(spark):
    x = vectors()
    x[7] = x[3]
    index = index_of(spark, x)
    queries = index.where("chunk_id < 10").select(F.col("chunk_id").alias("query_id"), "embedding")
    want = {}
    s = np.round(x[:10].astype(float) @ x.astype(float).T, 6)
    for q in range(10):
        want[q] = sorted(range(len(x)), key=lambda i: (-s[q, i], i))[:5]
    for parts in (1, 7):
        got = {}
        for r in R.top_k(index.repartition(parts), queries, 5).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append(r["chunk_id"])
        assert got == want
    assert R.top_k(index.where("chunk_id < 3"), queries, 5).groupBy("query_id").count().where("count != 3").count() == 0
    assert R.top_k(index, queries.limit(0), 5).count() == 0


def test_verify_and_probe(spark):
    index = index_of(spark, vectors(60))
    bad = spark.createDataFrame([(100, None), (101, [1.0] * 3), (102, [float("nan")] + [0.0] * 15)], index.schema)
    v = R.verify_index(index.unionByName(bad)).first()
    assert (v["n"], v["dim"], v["null_vectors"], v["other_dim"], v["not_finite"]) == (63, 16, 1, 1, 1)
    assert R.self_probe(index, index.where("chunk_id % 10 = 0")).where("not is_self").count() == 0
    assert R.near_first(index_of(spark, np.repeat(vectors(1), 3, 0))).first()["near_first"] == 2


def test_context_keeps_first_block_and_stops(spark):
    hits = spark.createDataFrame([(1, k, 0.5, "b", str(k), "x" * n) for k, n in ((1, 90), (2, 10), (3, 10))] + [(2, 1, 0.5, "b", "9", "x" * 500)], "query_id int, rank int, score double, breadcrumb string, chunk_id string, text string")
    got = {r["query_id"]: r for r in R.contexts(hits, 115).collect()}
    assert got[1]["n_blocks"] == 2 and got[1]["context"].startswith("[1] b\nxxx") and R.JOINT in got[1]["context"]
    assert got[2]["n_blocks"] == 1


def test_metrics(spark):
    ranks = spark.createDataFrame([(1, "a", 1), (2, "a", 4), (3, "b", None), (4, "b", 12)], "q int, area string, rank int")
    m = R.metrics(ranks, n_chunks=100).first()
    assert (m["hit_1"], m["hit_5"], m["hit_10"], m["mrr"], m["median_rank"], m["found_frac"]) == (0.25, 0.5, 0.5, 0.3125, 2.5, 0.5)
    assert [tuple(r) for r in R.by_area(ranks, F.col("area")).collect()] == [("b", 0.0, 2), ("a", 1.0, 2)]
    gap = R.overlap_gap(spark.createDataFrame([(0.1, 1), (0.4, 1), (0.6, None)], "overlap double, rank int")).first()
    assert (gap["n_low"], gap["n_high"], gap["gap"]) == (1, 1, -1.0)


def test_body_and_messages(spark):
    row = spark.createDataFrame([("crumb\n\none\n\ntwo", "q", "")], "t string, q string, c string").select(R.body(F.col("t")).alias("b"), R.messages(F.col("q"), F.col("c")).alias("m")).first()
    assert row["b"] == "one\n\ntwo" and [m["role"] for m in row["m"]] == ["system", "user"] and row["m"][1]["content"] == "q"


def test_odd_query_vectors_have_no_hits(spark):
    index = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "chunk_id int, embedding array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0]), (4, [None, 1.0]), (5, [0.0, 1.0])], "query_id int, embedding array<double>")
    assert {(r["query_id"], r["chunk_id"]) for r in R.top_k(index, asked, 1).collect()} == {(1, 1), (5, 2)}


def test_encoder_prefix_and_model(spark):
    df = spark.createDataFrame([("how is it built?",)], "question string")
    seen = R.embed_queries(df, "question", R.hashed_words(16), "m", "m").first()["embedding"]
    assert seen == R.hashed_words(16)([R.QUERY_PREFIX + "how is it built?"])[0].tolist()
    with pytest.raises(ValueError):
        R.embed_queries(df, "question", R.hashed_words(16), "m", "other")


def test_training_rows(spark):
    pairs = spark.createDataFrame([(str(i), "q" * i, "abc") for i in range(5)], "qa_id string, question string, answer string")
    ex = training.examples(pairs, "s", 30).withColumn("global_idx", F.col("qa_id").cast("long"))
    for r in ex.collect():
        assert len(r["input_ids"]) == len(r["labels"]) <= 30
        assert all(a == -100 or a == b for a, b in zip(r["labels"], r["input_ids"]))
    out = training.batches(ex, 2).collect()
    assert len(out) == 4 and all(len({len(r["input_ids"]) for r in out if r["batch_id"] == b}) == 1 for b in (0, 1))
    assert all(sum(r["attention_mask"]) == sum(1 for _ in r["attention_mask"]) - r["attention_mask"].count(0) for r in out)


def test_index_round_trip(spark, tmp_path):
    x = vectors(20)
    index = index_of(spark, x).select(F.col("chunk_id").cast("string").alias("chunk_id"), "embedding")
    tables.write_index(index, "m", str(tmp_path))
    got, config = tables.read_index(spark, str(tmp_path))
    assert got.count() == 20 and config.first()["normalized"] and config.first()["dim"] == 16
    index.limit(5).write.mode("overwrite").parquet(f"{tmp_path}/index")
    with pytest.raises(ValueError):
        tables.read_index(spark, str(tmp_path))


def test_questions_and_jsonl(spark, tmp_path):
    (tmp_path / "q.txt").write_text("  one?\n\n\t\ntwo?  \n")
    assert [r[0] for r in tables.read_questions(spark, str(tmp_path / "q.txt")).collect()] == ["one?", "two?"]
    tables.write_jsonl(spark.createDataFrame([("k", "é")], "cache_key string, raw string"), str(tmp_path / "j"))
    assert [tuple(r) for r in tables.read_jsonl(spark, str(tmp_path / "j"), "gen_responses").collect()] == [("k", "é")]
    with pytest.raises(ValueError):
        tables.read_jsonl(spark, str(tmp_path / "j"), "gen_responses").limit(0).write.mode("overwrite").json(str(tmp_path / "e"))
        tables.read_jsonl(spark, str(tmp_path / "e"), "gen_responses", required=True)


def test_blocks_of_queries_meet_all_blocks_of_the_index(spark):
    rng = np.random.default_rng(3)
    own = rng.integers(-3, 4, (150, 4)).astype(float)  # many ties
    index = spark.createDataFrame([(f"c{i:03}", v.tolist()) for i, v in enumerate(own)] + [("none", None), ("short", [1.0])], "chunk_id string, embedding array<float>")
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(own[:53])] + [(99, None)], "query_id int, embedding array<float>")
    got = {}
    for block in (16, 1000):
        got[block] = sorted(tuple(r) for r in R.top_k(index, asked, 7, block=block).select("query_id", "rank", "chunk_id", "score").collect())
    want = []
    for i in range(53):
        best = sorted((-float(own[i] @ v), f"c{j:03}") for j, v in enumerate(own))[:7]
        want += [(i, n + 1, c, -s) for n, (s, c) in enumerate(best)]
    assert got[16] == got[1000] == sorted(want)


def slow_encoder():
    """Loads as a model would: says so in a folder named in the environment."""
    import os
    import uuid

    open(os.path.join("/tmp", f"tidewright-loads-{os.environ.get('LOADS', 'x')}", f"{os.getpid()}-{uuid.uuid4().hex}"), "w").close()
    sizes = []

    def encode(texts):
        sizes.append(len(texts) * (max(map(len, texts)) // 4 + 1))
        assert sizes[-1] <= 64 or len(texts) == 1
        return R.hashed_words()(texts)

    return encode


def test_an_encoder_is_loaded_once_a_worker(spark, monkeypatch):
    import os

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(__import__("sys").modules[__name__])
    monkeypatch.setenv("LOADS", "x")
    folder = "/tmp/tidewright-loads-x"
    os.makedirs(folder, exist_ok=True)
    before = set(os.listdir(folder))
    df = spark.range(400).select("id", F.concat(F.lit("text number "), F.col("id").cast("string")).alias("text")).repartition(40)
    got = R.embed(df, F.col("text"), factory=slow_encoder)
    want = {r["id"]: r["embedding"] for r in R.embed(df, F.col("text"), R.hashed_words()).collect()}
    assert {r["id"]: r["embedding"] for r in got.collect()} == want
    fresh = [f for f in os.listdir(folder) if f not in before]
    assert fresh and len(fresh) == len({f.split("-")[0] for f in fresh})  # 40 tasks, one load a process


def test_gold_ranks_of_encoded_questions_against_all_pairs(spark):
    import duckdb

    chunks = spark.createDataFrame([(i, f"alpha w{i % 7} w{i} beta w{i * 3}") for i in range(60)], "chunk_id long, content string")
    asked = spark.createDataFrame([(i, f"w{i} beta" if i % 4 else "nothing known", i) for i in range(0, 60, 2)], "qa_id long, question string, gold_chunk_id long")
    index = R.embed(chunks, F.col("content"), R.hashed_words())
    queries = R.embed(asked.select(F.col("qa_id").alias("query_id"), "question"), F.col("question"), R.hashed_words())
    got = sorted((r["qa_id"], r["rank"]) for r in R.gold_ranks(asked, R.top_k(index, queries, 10)).collect())
    con = duckdb.connect()
    for name, df in (("i", index), ("q", queries), ("a", asked)):
        con.register(name, df.toArrow())
    want = con.sql("""WITH s AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(i.embedding AS DOUBLE[])), 6) DESC, chunk_id) AS rank FROM q, i)
      SELECT qa_id, CASE WHEN rank <= 10 THEN rank END FROM a JOIN s ON query_id = qa_id AND chunk_id = gold_chunk_id""").fetchall()
    assert got == sorted(want)


def test_blocks_are_sent_few_times_and_fit_a_task():
    for n in (20_000, 114_000, 684_000):
        n_q, n_i = R.blocks_of(n, n, 256)
        assert n / n_q * 256 <= 8 * R.TILE and n / n_i * 256 <= 8 * R.TILE
        assert (n_q * n + n_i * n) * 256 * 4 < 32e9  # bytes; 4,096 rows a block would be 234e9 of the largest
    assert R.blocks_of(6_150, 615_000, 64) == (1, 32) and R.blocks_of(10, 10, 1) == (1, 1)


def test_vectors_with_nulls_are_none_and_no_number_comes_first_in_any_parts(spark):
    index = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(9)] + [(9, [float("nan"), 1.0]), (10, [None, 99.0]), (11, None)], "chunk_id int, embedding array<double>")
    asked = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 0.0])], "query_id int, embedding array<double>")
    for parts in (1, 5):
        for block in (1, 10):
            got = R.top_k(index.repartition(parts), asked, 2, block=block)
            assert {(r["query_id"], r["rank"], r["chunk_id"]) for r in got.collect()} == {(1, 1, 9), (1, 2, 8), (2, 1, 9), (2, 2, 0)}


def test_memory_of_a_search_does_not_grow_with_its_queries():
    import tracemalloc

    import pyarrow as pa

    x = vectors(10_000, 16)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(x))), pa.array(list(x))], names=["chunk_id", "embedding"])
    tracemalloc.start()
    score, owners = R.best_matches(x[:3000].astype(float), [batch], 5, 6)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6 and (owners[:, 0] == np.arange(3000)).all()  # all scores of the batch at once are 240 MB, several times over


def test_memory_of_a_search_is_the_same_for_more_queries_and_vectors():
    import tracemalloc

    import pyarrow as pa

    peaks = []
    for n_queries, n in ((1_000, 4_000), (4_000, 16_000)):
        x = vectors(n, 64)
        found = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(list(x))], names=["chunk_id", "embedding"])
        tracemalloc.start()
        score, owners = R.best_matches(x[:n_queries], [found.slice(0, 3_000), found.slice(3_000)], 11, 6)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert score.shape == (n_queries, 11) and (owners[:, 0] == np.arange(n_queries)).all()
    assert peaks[1] < 1.5 * peaks[0] < 45e6  # 16 times the scores


def test_memory_of_a_search_among_copies_is_that_of_a_tile():
    import tracemalloc

    import pyarrow as pa

    x = np.full((4_000, 64), 0.125, np.float32)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(x))), pa.array(list(x))], names=["chunk_id", "embedding"])
    tracemalloc.start()
    score, owners = R.best_matches(x[:3_000], [batch], 11, 6)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120e6 and (owners == np.arange(11)).all() and (score == 1).all()
