import random

from pyspark.sql import functions as F

from tidewright.operators import qa, splitting
from tidewright.functions import text as T

LONG = "an answer that is long enough to be kept here"


def reasons(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, question string, answer string, content string")
    return [r["reason"] for r in qa.validate(df).orderBy("i").collect()]


def test_validation_order_and_bounds(spark):
    q = "what does the flag do exactly?"
    rows = [
        ("x" * 13 + "?", LONG, "c"), ("x" * 14 + "?", LONG, "c"), ("x" * 400 + "?", LONG, "c"), ("x" * 20, LONG, "c"), (q, "a" * 29, "c"),
        ("what is in this section or the above?", LONG, "c"), (q, "as the passage says, it is all about things", "c"), (q, "I don't know what that flag does at all", "c"),
        (q, LONG, LONG), (q, "!" * 40, "c"), (f" {q}\n", LONG, "c"),
    ]
    assert reasons(spark, rows) == ["question_too_short", None, "question_too_long", "question_not_a_question", "answer_too_short", "meta_reference:this section", "answer_references_source", "answer_is_refusal", "answer_is_extraction", "answer_is_extraction", None]


def test_longest_run_against_plain_search():
    rng = random.Random(4)
    for _ in range(300):
        a, c = ([rng.choice("abc") for _ in range(rng.randint(0, 9))] for _ in range(2))
        best = max((k for i in range(len(a)) for k in range(len(a) - i + 1) if k and any(a[i : i + k] == c[j : j + k] for j in range(len(c)))), default=0)
        assert qa.longest_run(" ".join(a), " ".join(c)) == (best / len(a) if a else 1.0)


def test_extracts_against_the_longest_run(spark):
    rng = random.Random(8)
    some = lambda n, of="abc": [rng.choice(of) for _ in range(n)]
    pairs = [(" ".join(some(rng.randint(0, 9))), " ".join(some(rng.randint(0, 14)))) for _ in range(1500)]
    for n in range(1, 41):  # runs of just the limit, and one more and less, at any start
        a = [f"w{i}" for i in range(n)]
        for k in {int(0.6 * n) + d for d in (-1, 0, 1, 2)} & set(range(n + 1)):
            s = rng.randint(0, n - k)
            pairs.append((" ".join(a), " ".join([*some(3), *a[s : s + k], "and", *some(3)])))
    pairs += [("", ""), (None, "a"), ("a", None), ("!?", "a"), ("ab c", "xab c"), ("Wörld-wide  \n words", "wrldwide words"), ("a b", "a\nb")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, answer string, content string")
    df = df.withColumns({"own": T.words(T.normalize(F.coalesce("answer", F.lit("")))), "within": F.concat(F.lit(" "), F.array_join(T.words(T.normalize(F.coalesce("content", F.lit("")))), " "), F.lit(" "))})
    for limit in (0.0, 0.3, 0.5, 0.6, 0.7, 1.0):
        got = {r["i"]: r["x"] for r in df.select("i", qa.extracted(F.col("own"), F.col("within"), limit).alias("x")).collect()}
        assert got == {i: qa.longest_run(*p) > limit for i, p in enumerate(pairs)}


def test_validation_stays_in_the_jvm_and_takes_odd_rows(spark):
    q, long = "what does the flag do exactly?", " ".join(f"word{i}" for i in range(30_000))
    rows = [(q, None, "c"), (None, LONG, "c"), (q, LONG, None), (q, long, long[:100]), (q, long, "x " + long[200:])]
    assert reasons(spark, rows) == ["answer_is_extraction", None, None, None, "answer_is_extraction"]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "question string, answer string, content string, overlap int, _in int")
    out = qa.validate(df)
    assert out.columns == [*df.columns, "reason"] and "Python" not in out._jdf.queryExecution().executedPlan().toString()
    assert qa.validate(df.limit(0)).count() == 0


def test_tolerant_responses():
    ok = '{"suitable": true, "questions": [{"question": "q", "answer": null}]}'
    assert qa.tolerant(ok) == (True, [("q", "None")])
    assert qa.tolerant("```json\n" + ok + "\n```") == qa.tolerant("Sure: " + ok + " Done.") == qa.tolerant(ok)
    for bad in (None, "", "{}", "[]", "null", ok[:20], "no braces"):
        assert qa.tolerant(bad) is None
    assert qa.tolerant('{"questions": []}') == (True, []) and qa.tolerant('{"suitable": null, "questions": null}') == (False, [])


def test_redundant_answers_fold(spark):
    rows = [("c", 0, "alpha beta gamma delta"), ("c", 1, "alpha beta gamma other"), ("c", 2, "the of"), ("c", 3, "quite different words"), ("d", 0, "alpha beta gamma delta")]
    df = spark.createDataFrame(rows, "k string, item_idx int, answer string")
    got = {(r["k"], r["item_idx"]): r["redundant"] for r in qa.redundant(df, "k", "item_idx").collect()}
    assert got == {("c", 0): False, ("c", 1): True, ("c", 2): False, ("c", 3): False, ("d", 0): False}


def test_numbering_of_many_rows_with_all_columns(spark):
    df = spark.range(200_000).select((F.col("id") * 7919 % 200_000).alias("x"), F.concat(F.lit("row "), F.col("id").cast("string")).alias("text"))
    got = qa.numbered(df, ["x"], "n").agg(F.count("*"), F.countDistinct("n"), F.min("n"), F.max("n"), F.count_if(F.col("n") != F.col("x")), F.countDistinct("text")).first()
    assert tuple(got) == (200_000, 200_000, 0, 199_999, 0, 200_000)


def plain_validation(docs, frac, seed):
    """The fold over all documents of one area, one by one."""
    import hashlib

    target, taken, out = sum(docs.values()) * frac, 0, set()
    for d in sorted(docs, key=lambda d: (hashlib.md5(f"{seed}|{d}".encode()).hexdigest(), d)):
        if taken >= target or (taken > 0 and taken + docs[d] > 2 * target):
            continue
        taken += docs[d]
        out.add(d)
    return out


def test_validation_documents_against_the_fold(spark):
    rng = random.Random(6)
    areas = [{f"a{a}/{d}": rng.choice([1, 1, 2, 3, rng.randint(1, 60)]) for d in range(rng.choice([1, 2, 5, 30]))} for a in range(40)]
    rows = [(d, i) for docs in areas for d, n in docs.items() for i in range(n)]
    pairs = spark.createDataFrame(rows, "doc_id string, i int")
    for frac, seed in ((0.1, 1), (0.3, 2)):
        got = {r["doc_id"] for r in splitting.validation_documents(pairs, frac, seed).collect()}
        assert got == set().union(*(plain_validation(docs, frac, seed) for docs in areas))


def test_responses_to_outcomes(spark):
    chunks = spark.createDataFrame([(f"d::{i}", "d", "crumb", f"text {i}") for i in range(6)], "chunk_id string, doc_id string, breadcrumb string, content string")
    asked = qa.requests(chunks.withColumn("sample_ord", F.substring_index("chunk_id", "::", -1).cast("long")), "s", "m", 2)
    pair = '{"question": "What does the tool %d do here?", "answer": "It builds every package of the workspace in order."}'
    raw = ['{"questions": [' + pair % 0 + ", " + pair % 1 + "]}", "no json", '{"suitable": false, "questions": []}', '{"questions": []}', '{"questions": [' + pair % 0 + "]}"]
    keys = {r["chunk_id"]: r["cache_key"] for r in asked.collect()}
    responses = spark.createDataFrame([(keys[f"d::{i}"], x) for i, x in enumerate(raw)], "cache_key string, raw string")
    rows = qa.generated(asked, responses, chunks)
    got = {(r["gold_chunk_id"], r["item_idx"], r["reason"]) for r in qa.gate(rows, ["gold_chunk_id", "item_idx"]).collect()}
    assert got == {("d::0", 0, None), ("d::0", 1, "redundant_answer_same_chunk"), ("d::1", None, "unparseable_response"), ("d::2", None, "unsuitable_chunk"), ("d::4", 0, "duplicate_question")}
    gated = qa.gate(rows, ["gold_chunk_id", "item_idx"])
    assert qa.coverage(gated).first().asDict() == {"attempted": 4, "accepted": 1, "unsuitable": 1, "unparseable": 1, "docs": 1, "chunks": 1}
    assert {r["outcome"]: r["share"] for r in qa.reject_report(gated).collect()}["unsuitable_chunk"] is None
    assert qa.sample_report(chunks, chunks.limit(2), 3).first().asDict() == {"corpus_chunks": 6, "corpus_docs": 1, "sample_chunks": 2, "sample_docs": 1, "target_pairs": 6}


def test_pairs_of_responses_in_sample_order(spark):
    chunks = spark.createDataFrame([(f"d{i % 3}::{i}", f"d{i % 3}", "A > B", "u", f"text {i}", i % 2 == 0) for i in range(9)], "chunk_id string, doc_id string, breadcrumb string, url string, content string, has_code boolean")
    sample = qa.sample_chunks(chunks, None, 9, 4)
    assert sorted(r["sample_ord"] for r in sample.collect()) == list(range(9))
    order = {r["chunk_id"]: r["sample_ord"] for r in sample.collect()}
    asked = qa.requests(sample, "s", "m", 2)
    said = '{"questions": [{"question": " What does number %s do in here?  ", "answer": "\\tIt is the step that builds part %s of all."}, {"question": "What is the common question of all?", "answer": "Each chunk %s answers it in words of its own, %s."}]}'
    raw = [(r["cache_key"], said % ((r["chunk_id"],) * 4), v) for r in asked.collect() for v in (1,)]
    raw += [(raw[0][0], "not the latest", 0), (raw[1][0], "zzz", None)]
    responses = spark.createDataFrame(raw, "cache_key string, raw string, at int")
    rows = qa.generated(asked, responses, chunks, latest="at")
    out = qa.qa_pairs(qa.gate(rows.repartition(5), ["sample_ord", "item_idx"]), "p").collect()
    first = min(order, key=order.get)
    assert len(out) == 10 and {r["provider"] for r in out} == {"p"} and {r["model"] for r in out} == {"m"}
    by = sorted(out, key=lambda r: int(r["qa_id"].rpartition("::q")[2]))
    assert [int(r["qa_id"].rpartition("::q")[2]) for r in by] == list(range(10)) and all(r["qa_id"].startswith(r["gold_chunk_id"] + "::q") for r in by)
    assert [order[r["gold_chunk_id"]] for r in by] == sorted(order[r["gold_chunk_id"]] for r in by)
    assert [r["gold_chunk_id"] for r in by if "common" in r["question"]] == [first]
    assert all(r["question"] == r["question"].strip() and r["answer"] == r["answer"].strip() for r in by)
    # as the split's tests on these rows
    split = splitting.split(spark.createDataFrame(out), 0.3, 1).collect()
    assert len(split) == 10 == len({r["qa_id"] for r in split})
    assert {(r["qa_id"], r["split"]) for r in splitting.split(spark.createDataFrame(out), 0.3, 1).collect()} == {(r["qa_id"], r["split"]) for r in split}


def test_without_a_latest_the_response_is_still_one(spark):
    asked = spark.createDataFrame([("k",)], "cache_key string")
    responses = spark.createDataFrame([("k", x) for x in "cab"], "cache_key string, raw string")
    assert {qa.answered(asked, responses.repartition(n)).first()["raw"] for n in (1, 2, 3)} == {"a"}


def test_numbering_leaves_other_columns_alone(spark):
    df = spark.range(500).select("id", *(F.col("id").alias(c) for c in ("part", "nth", "before", "count")))
    rows = qa.numbered(df, ["id"], "n").collect()
    assert all(r["n"] == r["id"] == r["part"] == r["nth"] == r["before"] == r["count"] for r in rows) and len(rows) == 500


def test_split_is_written_in_order(spark, tmp_path):
    rows = splitting.split(make(spark, 40, 3, 4), 0.2, 1)
    splitting.write_split(rows, str(tmp_path / "out"), 5)
    got = spark.read.json(str(tmp_path / "out"))
    assert got.count() == 120 and {r[0] for r in got.select("split").distinct().collect()} == {"train", "val"}


def test_numbering_is_gapless(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"))
    assert [(r["x"], r["n"]) for r in qa.numbered(df, ["x"], "n").orderBy("n").collect()] == [(i, i) for i in range(1000)]


def make(spark, docs, per, dirs=1):
    rows = [(f"Dir-{d % dirs}\\Page-{d}.rst", f"{d}::{c}", f"{d}::{c}::0", f"question {d} {c}?", "a" * 50) for d in range(docs) for c in range(per)]
    return spark.createDataFrame(rows, "doc_id string, gold_chunk_id string, qa_id string, question string, answer string")


def test_split_invariants(spark):
    pairs = make(spark, 40, 3, 4)
    rows = splitting.split(pairs, 0.2, 1).collect()
    sides = {}
    for r in rows:
        sides.setdefault(r["doc_id"], set()).add(r["split"])
    assert len(rows) == 120 == len({r["qa_id"] for r in rows}) and all(len(s) == 1 for s in sides.values())
    assert {r["split"] for r in rows} == {"train", "val"}
    assert {(r["qa_id"], r["split"]) for r in splitting.split(pairs.repartition(7), 0.2, 1).collect()} == {(r["qa_id"], r["split"]) for r in rows}
    leak = splitting.leakage(splitting.split(pairs, 0.2, 1)).first()
    assert leak["shared_docs"] == leak["shared_chunks"] == leak["shared_questions"] == 0
    assert splitting.split(pairs, 0.0, 1).where("split = 'val'").count() == 0


def test_leaking_split_is_not_written(spark, tmp_path):
    import pytest

    rows = splitting.split(make(spark, 8, 2), 0.5, 3).withColumn("question", F.lit("the same question?"))
    with pytest.raises(ValueError, match="shared_questions"):
        splitting.write_split(rows, str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()


def test_top_dir_and_words(spark):
    df = spark.createDataFrame([("Get-Started\\Installation\\x.rst",), ("Get-Started/Installation/x.rst",)], "p string")
    assert [r[0] for r in df.select(T.top_dir(F.col("p"))).collect()] == ["Get-Started"] * 2
    one = spark.createDataFrame([("How do I\nuse-it now",)], "t string").select(T.normalize(F.col("t")).alias("n"), T.content_words(F.col("t"), glue=False).alias("w")).first()
    assert one["n"] == "how do iuseit now" and one["w"] == ["now"]


def test_first_questions_validate_once(spark):
    rows = [("a", 1, "What does the tool build in here?", "x"), ("b", 0, "what does the tool build in here?", None), ("c", 0, "Is this the only one of its kind?", None), ("d", 0, "what does the tool build in here?", None)]
    pairs = spark.createDataFrame(rows, "doc_id string, item_idx int, question string, reason string").withColumn("reason", F.regexp_replace("reason", "x", "y"))
    got = qa.first_questions(pairs, ["doc_id", "item_idx"], F.col("reason").isNull())
    assert {(r["doc_id"], r["first"]) for r in got.collect()} == {("b", True), ("c", True), ("d", False)}
    assert "regexp_replace" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_responses_are_parsed_in_slices(spark, monkeypatch):
    import pandas as pd

    seen = {}
    monkeypatch.setattr(qa.F, "pandas_udf", lambda f, *a: seen.setdefault("f", f) and (lambda c: F.lit(None).cast(qa.PARSED)))
    qa.parse_responses(spark.createDataFrame([("x",)], "raw string"))
    raw = pd.Series([f'{{"questions": [{{"question": "q{i}", "answer": "a"}}]}}' if i % 3 else "none" for i in range(1000)])
    parts = list(seen["f"](iter([raw, raw[:0]])))
    assert max(map(len, parts)) <= 256 and sum(map(len, parts)) == 1000
    assert [q and q[0]["question"] for p in parts for q in p["questions"]] == [f"q{i}" if i % 3 else None for i in range(1000)]
