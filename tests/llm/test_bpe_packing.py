import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.llm import bpe, packing

P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, bands string, key string"


def reference(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def odd_texts():
    rng = random.Random(1)
    kinds = ["ab c\n\t'sé  .1 x", "abcde", "the in er", "éa", "a    b à", "  \n"]
    texts = ["".join(rng.choice(rng.choice(kinds)) for _ in range(rng.randint(0, 120))) for _ in range(600)]
    return [*texts, "", None, "x" * 30_000, "word " * 9_000, "a <|endoftext|> b", "'" * 500 + "s", "日本語テキスト" * 300]


def test_tree_is_the_librarys_encoding(monkeypatch):
    texts = odd_texts()
    want = reference(texts)
    for leaf, window in ((8, 1), (64, 4), (8192, 64)):
        monkeypatch.setattr(bpe, "LEAF_BYTES", leaf)
        monkeypatch.setattr(bpe, "WINDOW_BYTES", window)
        enc = bpe.Encoder(PATH)
        got = [np.frombuffer(enc.encode(t), np.uint32) for t in texts]
        assert [x.tolist() for x in got] == want
        assert [enc.decode(x) for x in got] == [t or "" for t in texts]


def test_every_token_is_the_encoding_of_its_own_bytes():
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(PATH).model
    tokens = [t for t in Tokenizer.from_file(PATH).get_vocab(with_added_tokens=False) if t != "<|endoftext|>"]
    assert len(tokens) == 50_256 and all(len(model.tokenize(t)) == 1 for t in tokens)


def test_all_code_points_are_of_the_librarys_classes():
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c}1{c}." for c in points[at : at + 2000]) for at in range(0, len(points), 2000)]
    enc = bpe.encoder(PATH)
    assert [enc._leaf(t).tolist() for t in texts] == reference(texts)


def test_other_ids_than_ranks(tmp_path):
    import json

    spec = json.load(open(PATH))
    n = len(spec["model"]["vocab"])
    spec["model"]["vocab"] = {t: n - 1 - i for t, i in spec["model"]["vocab"].items()}
    (tmp_path / "t.json").write_text(json.dumps(spec))
    got = np.frombuffer(bpe.Encoder(str(tmp_path / "t.json")).encode("some words, 12"), np.uint32)
    assert got.tolist() == [n - 1 - i for i in reference(["some words, 12"])[0]]
    spec["pre_tokenizer"] = None
    (tmp_path / "u.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        bpe.Encoder(str(tmp_path / "u.json"))


def test_segments_of_very_long_texts(spark):
    texts = [t for t in odd_texts() if t is None or len(t) < 200][:40] + ["tree leaf " * 700, "tree leaf " * 700, "a <|endoftext|> b" + " y" * 2000, "<|endoftext|>" + "z" * 1490 + "<|endoftext|>" * 3 + " y" * 900 + "<|endoftext|>", "q" * 5000]
    df = spark.createDataFrame([(i, t, None, "x", "y") for i, t in enumerate(texts)], SCHEMA)
    got = {r["doc_id"]: r for r in bpe.digests(df, PATH, split_chars=1500).collect()}
    assert len(got) == len(texts)
    for i, ids in enumerate(reference(texts)):
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((texts[i] or "").encode()).hexdigest()
    assert bpe.digests(df.limit(0), PATH).count() == 0


def test_encode_rows(spark):
    df = spark.createDataFrame([(1, "some words"), (2, None)], "doc_id long, text string")
    assert {r["doc_id"]: r["ids"] for r in bpe.encode(df, PATH).collect()} == dict(zip((1, 2), reference(["some words", None])))


def least_bins(sizes, capacity):
    best, sizes = [len(sizes)], sorted(sizes, reverse=True)

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + sizes[i] <= capacity:
                bins[k] += sizes[i]
                go(i + 1, bins)
                bins[k] -= sizes[i]
        bins.append(sizes[i])
        go(i + 1, bins)
        bins.pop()

    go(0, [])
    return best[0]


def test_reduction_keeps_the_optimum():
    rng = np.random.default_rng(2)
    for _ in range(300):
        capacity = int(rng.integers(8, 40))
        sizes = [int(x) for x in rng.integers(rng.integers(1, capacity // 2), capacity + 1, rng.integers(4, 10))]
        left = np.bincount(sizes, minlength=capacity + 1)
        fixed = packing.reduce_instance(left, capacity)
        rest = [s for s in range(capacity + 1) for _ in range(left[s])]
        assert sum(m for _, m in fixed) + least_bins(rest, capacity) == least_bins(sizes, capacity)


def test_packing_is_gapless_and_tight(spark):
    rng = random.Random(3)
    texts = [" ".join("w" for _ in range(rng.choice([0, 3, 50, 500, 2047, 2048, 5000]))) for _ in range(300)] + [None]
    df = spark.createDataFrame([(i % 290, t, None, "x", "y") for i, t in enumerate(texts)], SCHEMA)
    rows = packing.pack_documents(df, PATH).toPandas()
    lengths = [len(ids) + 1 for ids in reference(texts)]
    assert len(rows) == sum(-(-n // 2048) for n in lengths) and rows["length"].sum() == sum(lengths)
    for _, g in rows.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g["offset"].tolist() == [0, *g["length"].cumsum()[:-1]] and g["length"].sum() <= 2048
    assert rows["sequence_id"].nunique() <= 1.05 * -(-sum(lengths) // 2048) + 1
    assert (rows[rows["piece"] > 0]["length"] == 2048).all()
    assert packing.pack_documents(df.limit(0), PATH).count() == 0
