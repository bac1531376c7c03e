import functools
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidewright.llm import langid, media, neardup, ppm, secret_scan, sharding, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, score string, key string"
ODD = [None, "", " ", "\n", "!!!", "x", "x" * 20_000, "日本語 " * 50]


def frame(spark, texts, lang="en"):
    return spark.createDataFrame([(i, t, lang, "s", "a", "b") for i, t in enumerate(texts)], SCHEMA)


def words(rng, n, pool=200):
    return " ".join(f"w{rng.randint(0, pool)}" for _ in range(n))


def test_kd_shards(spark):
    rng = random.Random(1)
    texts = [words(rng, rng.randint(1, 60)) for _ in range(400)] + ["same text here"] * 200 + ODD
    df = frame(spark, texts)
    rows = sharding.shard(df.repartition(5), 7).toPandas()
    assert len(rows) == len(texts) and set(rows["shard"]) == set(range(7))
    by_id = dict(zip(rows["doc_id"], rows["size"]))
    assert all(by_id[i] == len((t or "").encode()) + 8 for i, t in enumerate(texts))
    crc = dict(zip(rows["doc_id"], rows["text_crc32"]))
    assert all(crc[i] == zlib.crc32((t or "").encode()) for i, t in enumerate(texts))
    for _, g in rows.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    small = rows[rows["size"] < 5000].groupby("shard")["size"].sum()
    assert rows.groupby("shard")["size"].sum().max() < rows["size"].sum() / 7 + 40_000 and len(small) >= 1
    even = sharding.shard(frame(spark, [words(rng, rng.randint(5, 60)) for _ in range(600)]), 8).toPandas().groupby("shard")["size"].sum()
    assert even.min() > 0.95 * even.mean() and even.max() < 1.05 * even.mean()
    pairs = [words(rng, rng.randint(5, 60)) for _ in range(300)]
    both = sharding.shard(frame(spark, pairs + pairs + [None, "", ""]), 5).toPandas()
    assert both.groupby(["text_crc32", "size"])["shard"].nunique().max() == 1  # copies stay together
    hot = sharding.shard(frame(spark, pairs + [pairs[0]] * 900), 5).toPandas().groupby("shard")["size"].sum()
    assert hot.min() > 0.9 * hot.mean() and hot.max() < 1.1 * hot.mean()  # unless there are too many
    assert sharding.shard(df.limit(0), 24).count() == 0
    assert sharding.shard(df.union(df).union(df.limit(1)), 3).count() == 2 * len(texts) + 1


def plain_spans(text):
    out = []
    for k, p in enumerate((secret_scan.ASSIGN, re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+"))):
        for m in p.finditer(text or ""):
            if (k == 0 and len(m[2]) >= 6) or (k == 1 and len(m[0]) >= 20) or (k == 2 and len(m[0]) >= 24):
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_secret_base_spans_stay():
    rng = random.Random(2)
    bits = ["token = \"", "passwd:", "api_key=", "APIKEY: '", "Secret", "AKIA", "ABCDEFGH12", "deadbeef00", "0f", " ", "\"", "é", "tok", "=", ":", "xY9+/_.=-", "ſecret:"]
    for _ in range(3000):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        got = [s for s in secret_scan.find(t, {}) if s[1] < 3]
        assert got == plain_spans(t)
    for t in ODD:
        assert [s for s in secret_scan.find(t, {}) if s[1] < 3] == plain_spans(t)


def piece_cost(v, ranks):
    """The cheapest way to guess ``v`` as one segment, each kind by its definition."""
    costs, low = [float(len(v))], v.lower()
    if low in ranks:
        upper = sum(c.isupper() for c in v)
        cases = 1 if not upper else 2 if upper == len(v) or (upper == 1 and v[0].isupper()) else math.comb(len(v), upper) + 1
        costs.append(math.log10((ranks[low] + 1) * cases))
    for y, m, d in itertools.permutations(range(3)) if any(c.isdigit() for c in v) else ():
        if (y, m, d) not in ((0, 1, 2), (2, 1, 0)):  # year first, or day first
            continue
        for sep in ("", "-", "/", ".", "_"):
            for parts in ([v.split(sep)] if sep else [[v[:i], v[i:j], v[j:]] for i in range(1, len(v)) for j in range(i + 1, len(v))]):
                if len(parts) == 3 and all(p.isdigit() for p in parts):
                    year, month, day = parts[y], parts[m], parts[d]
                    years = re.fullmatch(r"(19|20)\d\d", year) or (y == 2 and len(year) == 2)
                    if years and 1 <= int(month) <= 12 and 1 <= int(day) <= 31 and len(month) <= 2 and len(day) <= 2:
                        costs.append(math.log10(119 * 365))
    if re.fullmatch(r"(19|20)\d\d", v):
        costs.append(math.log10(119))
    for unit in range(1, len(v) // 2 + 1):
        if len(v) % unit == 0 and len(v) > 2 and v == v[:unit] * (len(v) // unit):
            costs.append(min(unit, cheapest(v[:unit], ranks) if unit > 2 else unit) + math.log10(len(v) // unit))
    lines = [*secret_scan.ROWS, *secret_scan.COLUMNS]
    ways = [next((1 if a + b in x else -1 for x in lines if a + b in x or b + a in x), 0) for a, b in itertools.pairwise(low)]
    if len(v) >= 3 and all(ways):
        turns = sum(x != y for x, y in itertools.pairwise(ways))
        costs.append(math.log10(47 * len(v)) + turns * math.log10(4.6))
    return min(costs)


@functools.cache
def cheapest_of(value, ranks):
    return min((piece_cost(value[:n], dict(ranks)) + cheapest_of(value[n:], ranks) for n in range(1, len(value) + 1)), default=0.0)


def cheapest(value, ranks):
    """Brute force over all segmentations."""
    return cheapest_of(value, tuple(sorted(ranks.items())))


def test_guess_cost():
    rng = random.Random(3)
    ranks = {"cat": 5, "cats": 30, "house": 100, "sho": 900}
    for _ in range(200):
        v = "".join(rng.sample(["cat", "s", "house", "k#", "zv", "CATS", "Sho", "1987", "12.05.99", "2001-1-31", "qwer", "4rfv", "poi", "xx", "ababab", "catcat", "777"], rng.randint(0, 4)))
        assert secret_scan.guess_cost(v, ranks) == pytest.approx(cheapest(v, ranks)), v
    cost = lambda v: secret_scan.guess_cost(v, {"password": 1})
    assert cost("password") < cost("Password") < cost("1987-06-05") < cost("xK9#mQ2$vL")
    assert cost("qwertyuiop") < 5 and cost("abcabcabcabc") < 5 and cost("a" * 20) < 3
    assert secret_scan.guess_cost("q8Zk" * 50_000, {}, 10.0) == pytest.approx(4 + math.log10(50_000))
    assert secret_scan.guess_cost("".join(rng.choice("q8Zk7!x") for _ in range(200_000)), {}, 10.0) >= 10
    assert all(cost("*" * k) < 10 for k in (6, 40, 120, 5000, 100_000))  # masked values of any length


def test_guess_cost_of_repeats_and_walks_that_run_into_others():
    rng = random.Random(5)
    ranks = {"admin": 2, "banana": 4, "nan": 9, "qwe": 11}
    assert secret_scan.guess_cost("aaaaaadmin", ranks) == pytest.approx(cheapest("aaaaaadmin", ranks))
    for _ in range(300):
        pieces = [c * rng.randint(1, 7) for c in "a*n"] + [u * rng.randint(2, 4) for u in ("na", "abc", "q8Zk")] + ["admin", "banana", "qwerty", "asdfdsa", "1", "xk"]
        v = "".join(rng.sample(pieces, rng.randint(1, 4)))[:22]
        assert secret_scan.guess_cost(v, ranks) == pytest.approx(cheapest(v, ranks)), v
        assert (secret_scan.guess_cost(v, ranks, 5.0) >= 5.0) == (cheapest(v, ranks) >= 5.0 - 1e-9), v


def test_secret_rows_and_redaction(spark):
    texts = ['pwd: "xK9#mQ2$vLp!w" ok', "token = abcdef012345 end", "plain prose about a secret place", *ODD]
    df = frame(spark, texts)
    ranks = secret_scan.word_ranks(df)
    got = {r["doc_id"]: r for r in secret_scan.scan(df, ranks).collect()}
    assert got[0]["spans"] == "guess:6:19" and got[0]["n_guess"] == 1 and got[1]["n_assign"] == 1 and got[2]["spans"] == ""
    clean = {r["doc_id"]: r["text"] for r in secret_scan.redact(df, ranks).collect()}
    assert clean[0] == 'pwd: "[SECRET]" ok' and clean[1] == "[SECRET] end" and clean[2] == texts[2] and clean[3] is None
    assert secret_scan.scan(df.limit(0), ranks).count() == 0


@pytest.mark.parametrize("before", ["credentials: password: ", "secret token: ", "secret password:", "pwd=", "passphrase: ", "access_key=", "password\t", "secret:\t", "api_key =\n  "])
@pytest.mark.parametrize("value", ["P@ssw0rd!x9Q$Lm7", "K$9zQ!mW2#vTr8", "qzxvkjwhtbnmplkj"])
def test_secret_values_after_keywords(before, value):
    ranks = {w: i for i, w in enumerate(secret_scan.COMMON, 1)}
    assert (len(before), 3, len(before) + len(value)) in secret_scan.find(before + value + " end", ranks)
    assert not secret_scan.find("the secret qzxvkjwhtbnmplkj", ranks) and not secret_scan.find("password: " + "*" * 120, ranks)


def plain_ppm(train, text, order):
    low = lambda t: [256] * order + list((t or "").encode().translate(ppm.LOWER)) + [256]
    counts = defaultdict(Counter)
    for t in train:
        s = low(t)
        for i in range(order, len(s)):
            for k in range(order + 1):
                counts[tuple(s[i - k : i])][s[i]] += 1
    s, total = low(text), 0.0
    for i in range(order, len(s)):
        out = set()
        for k in range(order, -1, -1):
            c = {x: n for x, n in counts.get(tuple(s[i - k : i]), {}).items() if x not in out}
            if not c:
                continue
            if s[i] in c:
                total += math.log10(c[s[i]] / (sum(c.values()) + len(c)))
                break
            total += math.log10(len(c) / (sum(c.values()) + len(c)))
            out |= set(c)
        else:
            total -= math.log10(257 - len(out))
    return total


def test_ppm_against_plain(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("abc  dé\nÀQ") for _ in range(rng.randint(0, 80))) for _ in range(60)] + [x for x in ODD if not x or len(x) < 500]
    df = frame(spark, texts)
    rows = {r["doc_id"]: r for r in ppm.score(df.repartition(4), df["doc_id"] % 3 != 0).collect()}
    train = [t for i, t in enumerate(texts) if i % 3]
    token = lambda t: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(ppm.LOWER)) + [b" "]
    c = Counter(w for t in train for w in token(t))
    n, v = sum(c.values()), len(c)
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        r, own = rows[i], token(t)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(w in c for w in own), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own))
        assert r["score"] == pytest.approx(plain_ppm(train, t, ppm.ORDER), rel=1e-5)
    assert ppm.score(df.limit(0)).count() == 0
    assert ppm.score(df.limit(3), df["doc_id"] < 0).count() == 3


def maximal(scores):
    def go(a, b):
        best = None
        for i in range(a, b):
            t = 0
            for j in range(i, b):
                t += scores[j]
                if t > 1e-12 and (best is None or t > best[2] + 1e-12 or (abs(t - best[2]) <= 1e-12 and j + 1 - i < best[1] - best[0])):
                    best = (i, j + 1, t)
        return [*go(a, best[0]), best, *go(best[1], b)] if best else []

    return go(0, len(scores))


def test_maximal_segments():
    rng = random.Random(5)
    for _ in range(1500):
        s = [rng.choice([-0.25, -0.25, -0.25, rng.randint(-30, 40) / 8 + 0.013 * k]) for k in range(rng.randint(0, 14))]
        got = toxicity.segments([(i, x) for i, x in enumerate(s) if x != -0.25], len(s))
        assert [x[:2] for x in got] == [x[:2] for x in maximal(s)]


def test_toxicity_held_out(spark):
    rng = random.Random(6)
    texts, labels = [], []
    for i in range(900):
        bad = i % 6 == 0
        w = words(rng, 60, 800).split()
        if bad:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["vile", "scum", "trash"]))
        texts.append(" ".join(w))
        labels.append((i, int(bad)))
    df = frame(spark, texts + ODD)
    model = toxicity.fit(df, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(df, model).collect()}
    assert len(got) == len(texts) + len(ODD) and all(0 <= s <= 1 for s in got.values())
    assert np.mean([(got[i] >= 0.5) == bool(y) for i, y in labels]) > 0.97
    assert all(got[len(texts) + k] < 0.5 for k in range(len(ODD)))
    spans = toxicity.passages(df, model).collect()
    assert spans and all(re.search("vile|scum|trash", texts[r["doc_id"]][r["start"] : r["end"]]) for r in spans)
    assert toxicity.keep(df, model).columns == df.columns
    empty = toxicity.fit(df, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r["score"] for r in toxicity.score(df, empty).collect()} != {None}


def test_toxicity_curve_has_the_balance_of_all_labels(spark):
    rng = random.Random(13)
    bad = [i % 10 == 0 for i in range(4000)]
    texts = [f"{words(rng, 20, 300)} {'vile scum' if (b and rng.random() < 0.8) or rng.random() < 0.04 else ''}" for b in bad]
    df = frame(spark, texts)
    labels = spark.createDataFrame([(i, int(b)) for i, b in enumerate(bad)], "doc_id long, toxic int")
    for rows in (15_000, 300):
        model = toxicity.fit(df, labels, rows)
        assert abs(np.mean([model.score(t)[0] for t in texts]) - 0.1) < 0.03
    none = toxicity.fit(df.where("length(text) < 0"), labels, 300)
    assert none.score("w1")[0] < 0.5


def plain_groups(texts, w):
    sh = {}
    for i, t in enumerate(texts):
        if t:
            _, h, n = neardup.shingles([t])
            o = np.argsort(h)
            sh[i] = (h[o], w.of(h, n)[o].astype(float))
    parent = list(range(len(texts)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            same = texts[a] is not None and texts[a] == texts[b]
            if same or (a in sh and b in sh and len(sh[a][0]) and len(sh[b][0]) and neardup.similarity(sh[a], sh[b]) >= neardup.SIMILAR):
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    return {i: top(i) for i in range(len(texts))}


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(7)
    shared = words(rng, 40, 5000)
    texts = []
    for k in range(25):
        base = words(rng, rng.randint(80, 200), 5000).split()
        for _ in range(rng.choice([1, 2, 5])):
            copy = base[:]
            for _ in range(rng.choice([0, 1, 2, 6])):
                copy[rng.randrange(len(copy))] = "edit" + str(rng.random())
            texts.append(" ".join(copy) + (" " + shared if k % 3 == 0 else ""))
    texts += [texts[0]] * 3 + ["two words", "two words", "Two  words!", *ODD, "", None]
    df = frame(spark, texts)
    rows = {r["doc_id"]: r for r in neardup.groups(df.repartition(5)).collect()}
    want = plain_groups(texts, neardup.frequency_sketch(df))
    assert {i: r["group_id"] for i, r in rows.items()} == want
    kept = neardup.keep_one(df)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values())) and kept.columns == df.columns
    assert neardup.groups(df.limit(0)).count() == 0
    assert neardup.groups(df.union(df)).count() == 2 * len(texts)


def test_near_duplicates_in_crowded_buckets(spark):
    rng = random.Random(12)
    passage = words(rng, 140, 100_000)
    texts = []
    for _ in range(200):
        own = [words(rng, 10, 10_000_000) for _ in range(3)]
        texts += [f"{passage} {own[0]} {own[1]}", f"{passage} {own[0]} {own[2]}"]
    rng.shuffle(texts)
    df = frame(spark, texts)
    want = plain_groups(texts, neardup.frequency_sketch(df))
    assert len(set(want.values())) == 200
    assert {r["doc_id"]: r["group_id"] for r in neardup.groups(df.repartition(5)).collect()} == want


def test_two_texts_of_one_id_both_survive(spark):
    rng = random.Random(13)
    a, b = words(rng, 60, 5000), words(rng, 60, 5000)
    rows = [(1, a), (5, a + " more"), (5, b), (5, b), (7, b + " more"), (None, a), (9, None), (9, a)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(((r["doc_id"], r["text"]) for r in neardup.keep_one(df).collect()), key=repr)
    assert kept == sorted([(1, a), (5, b), (9, None), (None, a)], key=repr)
    groups = sorted((r["doc_id"], r["group_id"]) for r in neardup.groups(df.where("doc_id is not null and text is not null")).collect())
    assert groups == [(1, 1), (5, 1), (5, 5), (5, 5), (7, 5), (9, 1)]


def test_a_shared_passage_is_no_reason_to_compare(spark):
    rng = random.Random(14)
    passage = words(rng, 60, 100_000)
    texts = [words(rng, 80, 10_000_000) for _ in range(1500)] + [f"{passage} {words(rng, 70, 10_000_000)}" for _ in range(60)]
    w = neardup.frequency_sketch(frame(spark, texts))
    text, shingle, _, _ = neardup.prefixes(texts, w, neardup.SIMILAR)
    met = Counter(shingle.tolist())
    assert sum(n * (n - 1) // 2 for n in met.values()) <= 20  # of 1,770 pairs with the passage


def test_components_of_chains_stars_and_repeated_links(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 400)] + [(7, 8), (8, 7), (500, 500), (601, 600)]
    want = {k: 0 for k in range(41)} | {k: 100 for k in range(100, 400)} | {600: 600, 601: 600}
    found = neardup.components(spark.createDataFrame(links, "a long, b long").repartition(5)).collect()
    assert {r["node"]: r["root"] for r in found} | {0: 0, 100: 100, 600: 600} == want
    assert neardup.components(spark.createDataFrame([(3, 3)], "a long, b long")).count() == 0


def test_sampling_estimates_weighted_jaccard():
    rng = np.random.default_rng(8)
    a = rng.integers(1, 1 << 62, 400).astype(np.uint64)
    wa, wb = rng.uniform(0.5, 2, 400), rng.uniform(0.5, 2, 400)
    true = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    hits = []
    for k in range(60):
        salt = np.uint64(k * 7919 + 1)
        x, y = (neardup.sampled(np.zeros(400, np.int64), neardup.mixed(a + salt), w)[1] for w in (wa, wb))
        hits.append((x == y).mean())
    assert abs(np.mean(hits) - true**neardup.ROWS) < 0.06


def test_language_held_out(spark):
    rng = random.Random(9)
    kinds = {"aa": ["the", "ing", "ation", "er"], "bb": ["le", "eux", "que", "é"], "cc": ["sch", "keit", "der", "ü"]}
    rows = []
    for i in range(400):
        lang = rng.choice(list(kinds))
        rows.append((i, " ".join("".join(rng.choice(kinds[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(5, 40))), lang, "s", "a", "b"))
    df = spark.createDataFrame(rows + [(1000 + k, t, None, "s", "a", "b") for k, t in enumerate(ODD)], SCHEMA)
    model = langid.fit(df)
    got = {r["doc_id"]: r for r in langid.predict(df, model).collect()}
    assert np.mean([got[r[0]]["lang_pred"] == r[2] for r in rows]) > 0.98
    assert all(got[1000 + k]["lang_pred"] == "und" and got[1000 + k]["score"] == 0 and got[1000 + k]["rejected"] for k in range(5))
    assert got[1007]["rejected"] and got[1007]["lang_pred"] in kinds
    assert not any(got[r[0]]["rejected"] for r in rows)
    assert langid.keep(df, model).count() == sum(not r["rejected"] for r in got.values())
    nothing = langid.fit(df.limit(0))
    assert {r["lang_pred"] for r in langid.predict(df, nothing).collect()} == {"und"}


def test_containers_round_trip(spark):
    rng = random.Random(10)
    for n in (0, 1, 63, 64, 65, 4096, 4097, 8192, 100_000):
        data = media.padded(rng.randbytes(n))
        blob = media.wrap(data)
        (t,) = media.tracks(blob)
        assert media.samples(blob, t) == data and t["ticks"] == t["duration"] == len(data)
        for k, at in zip(t["keys"], t["starts"][t["keys"]]):
            assert blob[at : at + media.UNIT] == data[k * media.UNIT : (k + 1) * media.UNIT]
    good = media.wrap(media.padded(b"x" * 200))
    df = spark.createDataFrame([(1, bytearray(good)), (2, bytearray(good[:-10])), (3, bytearray(b"junk")), (4, None), (5, bytearray(good[:100]))], "doc_id long, media binary")
    got = {r["doc_id"]: r for r in media.describe(df).collect()}
    assert got[1]["codec"] == "raw " and got[1]["n_samples"] == 4 and got[1]["error"] is None and len(got[1]["keyframes"]) == 1
    assert all(got[k]["error"] for k in (2, 3, 4, 5))
    texts = frame(spark, ODD)
    assert media.describe(media.wrap_texts(texts)).where("error is null").count() == len(ODD)


def test_media_query_columns(spark):
    import hashlib

    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = media.op9_media_columns(spark, sf).collect()
    assert len(rows) == len(texts)
    same = defaultdict(set)
    for r in rows:
        own = texts[r["doc_id"]]
        payload = own + b"\0" * (max(64, -(-len(own) // 64) * 64) - len(own))
        assert (r["n_bytes"], r["payload_bytes"]) == (len(own), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])
        assert r["media_bytes"] > len(payload) and len(r["media_sha256"]) == 64 and r["feature"]
        same[own].add((r["media_bytes"], r["media_sha256"], r["feature"]))
    assert all(len(v) == 1 for v in same.values())
