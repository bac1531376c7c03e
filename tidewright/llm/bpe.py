"""Operator 10: byte-level BPE encoding and decoding by tree concatenation.

A text longer than a leaf is halved until its parts are leaves; the leaves are encoded on their own
and joined pairwise. A join re-encodes a window around the cut and doubles it until its first token
is the left half's there and its last one the right half's, so that all outside the window is known
to stand. A window begins and ends

* at *breaks*, where a text has any: white space after a character that is none always begins a
  pre-token, whatever stands around it;
* at tokens, inside one unbroken pre-token: byte-pair encodings whose neighbouring tokens all agree
  pairwise are the encoding of the whole.

Texts above ``split_chars`` are dealt out as segments, encoded by different tasks and then joined.
Special tokens' strings are cut out first; what stands between them goes through the tree.

Leaves are encoded by ranks: of all neighbouring tokens whose concatenation is a token, the one of
the lowest rank merges first. That is what the file's list of merges says as long as every token is
the encoding of its own bytes, as it is in files made by training; tests check it.

Defined results: a null or empty text has no ids (both digests are those of no bytes); equal texts
give equal rows, ties don't arise; repeated rows stay repeated; very long texts are encoded whole;
the special token's string in a text is that token, as in the library's default; an empty table gives
no rows; further columns of the input, of whatever name, are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, slices, table

LEAF_BYTES = 8_192
WINDOW_BYTES = 64
SPLIT_CHARS = 1_000_000
_ENCODERS: dict[str, Encoder] = {}
# Fixed value: the pre-tokens of byte-level BPE.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# ASCII white space after a character that is none, in UTF-8
BREAK = re.compile(rb"(?<=[\x00-\xff])(?<![\t-\r\x1c-\x20])(?<!\xc2[\x85\xa0])(?<!\xe1\x9a\x80)(?<!\xe2\x80[\x80-\x8a\xa8\xa9\xaf])(?<!\xe2\x81\x9f)(?<!\xe3\x80\x80)[\t-\r ]")


def break_before(data: bytes, at: int) -> int:
    """The last break up to ``at``, or 0."""
    step = 4 * WINDOW_BYTES
    while at > 0:
        low = max(0, at - step)
        if found := [m.start() for m in BREAK.finditer(data, low, at + 1)]:
            return found[-1]
        if not low:
            break
        step *= 2
    return 0


def break_after(data: bytes, at: int) -> int:
    """The first break from ``at`` on, or the end."""
    found = BREAK.search(data, at)
    return found.start() if found else len(data)


@dataclass
class Part:
    """An encoded stretch of text."""

    data: bytes
    ids: np.ndarray


class Encoder:
    """One tokenizer file in a worker."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, before = spec["model"], spec["pre_tokenizer"] or {}
        if model["type"] != "BPE" or spec["normalizer"] or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
            raise ValueError(f"{path} is no byte-level BPE")
        # the byte-level alphabet: printable bytes stand for themselves, others for 256, 257, ...
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        code = {b: b for b in plain} | {b: 256 + i for i, b in enumerate(sorted({*range(256)} - {*plain}))}
        back = {chr(c): b for b, c in code.items()}
        vocabulary = {bytes(back[c] for c in token): i for token, i in model["vocab"].items() if token not in {t["content"] for t in spec["added_tokens"]}}
        merges = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        ranks = {bytes([b]): r for r, b in enumerate(sorted(range(256), key=lambda b: vocabulary[bytes([b])]))}
        ranks |= {bytes(back[c] for c in a + b): 256 + r for r, (a, b) in enumerate(merges)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pieces = [b""] * (1 + max(*vocabulary.values(), *self.special.values(), 0))
        for piece, i in [*vocabulary.items(), *((s.encode(), i) for s, i in self.special.items())]:
            self.pieces[i] = piece
        self.sizes = np.fromiter(map(len, self.pieces), np.int64, len(self.pieces))
        self.cut = re.compile("|".join(f"({re.escape(s)})" for s in sorted(self.special, key=len, reverse=True)) or r"(?!)")
        # ids by rank, where they are not the same
        ids = np.fromiter((vocabulary[p] for p in ranks), np.uint32, len(ranks))
        self.by_rank = None if np.array_equal(ids, np.arange(len(ids))) else ids
        self.leaves = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    # -- encoding -------------------------------------------------------------------------------

    def _leaf(self, text: str) -> np.ndarray:
        ids = np.array(self.leaves.encode_ordinary(text), np.uint32)
        return ids if self.by_rank is None else self.by_rank[ids]

    def _tokens(self, ids: np.ndarray, size: int) -> int:
        """How many of the first ids make up ``size`` bytes."""
        return int(np.searchsorted(np.cumsum(self.sizes[ids[:size]]), size)) + 1 if size else 0

    def join(self, left: Part, right: Part) -> Part:
        """The encoding of the concatenation, from those of its halves."""
        width, data = WINDOW_BYTES, left.data + right.data
        while True:
            a, b = break_before(left.data, len(left.data) - width), break_after(right.data, min(width, len(right.data)))
            window = self._stretch(left.data[a:] + right.data[:b])
            n, m = self._tokens(left.ids[::-1], len(left.data) - a), self._tokens(right.ids, b)
            if (a == 0 or window[0] == left.ids[len(left.ids) - n]) and (b == len(right.data) or window[-1] == right.ids[m - 1]):
                return Part(data, np.concatenate([left.ids[: len(left.ids) - n], window, right.ids[m:]]))
            width *= 2

    def joined(self, parts: list[Part]) -> Part:
        while len(parts) > 1:
            parts = [self.join(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0]

    def tree(self, data: bytes) -> Part:
        if len(data) <= LEAF_BYTES:
            return Part(data, self._leaf(data.decode()))
        half = len(data) // 2
        while data[half] & 0xC0 == 0x80:  # cut between characters
            half += 1
        return self.join(self.tree(data[:half]), self.tree(data[half:]))

    def _stretch(self, data: bytes) -> np.ndarray:
        """A window; one longer than two leaves has no break inside: pre-token by pre-token."""
        if len(data) <= 2 * LEAF_BYTES:
            return self._leaf(data.decode())
        from tokenizers.pre_tokenizers import ByteLevel

        text = data.decode()
        return np.concatenate([self._unbroken(text[a:b]) for _, (a, b) in ByteLevel(add_prefix_space=False).pre_tokenize_str(text)])

    def _unbroken(self, run: str) -> np.ndarray:
        """One pre-token of any length."""
        if len(run) <= LEAF_BYTES // 2:
            return self._leaf(run)
        half = len(run) // 2
        left, right, width = self._unbroken(run[:half]), self._unbroken(run[half:]), 4
        while True:
            a, b = max(0, len(left) - width), min(len(right), width)
            while a and not self._whole(left[a]):
                a -= 1
            while b < len(right) and not self._whole(right[b]):
                b += 1
            window = self._leaf(self.decode(np.concatenate([left[a:], right[:b]])))
            if (a == 0 or window[0] == left[a]) and (b == len(right) or window[-1] == right[b - 1]):
                return np.concatenate([left[:a], window, right[b:]])
            width *= 2

    def _whole(self, token: int) -> bool:
        """Whether a token begins with a whole character."""
        return self.pieces[token][0] & 0xC0 != 0x80

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if len(text) * 4 <= LEAF_BYTES and self.by_rank is None and not self.cut.search(text):
            return array("I", self.leaves.encode_ordinary(text)).tobytes()
        out, at = [], 0
        for m in [*self.cut.finditer(text), None]:
            if between := text[at : m.start() if m else len(text)]:
                out.append(self.tree(between.encode()).ids.tobytes())
            if m:
                out.append(array("I", [self.special[m[0]]]).tobytes())
                at = m.end()
        return b"".join(out)

    # -- decoding -------------------------------------------------------------------------------

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids.tolist()))

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def mapped(docs: DataFrame, path: str, finish: Callable[[pa.Array, list[bytes], Encoder], pa.RecordBatch], fields: str, split_chars: int = SPLIT_CHARS) -> DataFrame:
    """Rows of doc_id and ``fields`` that ``finish`` makes of ids of documents and those of their texts,
    where they are encoded, so that no ids need to be moved."""
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, {fields}"

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for part in slices(batches):
            yield finish(part.column("doc_id"), list(map(enc.encode, part.column("text").to_pylist())), enc)

    # Very long texts: each distinct one is dealt out in segments, between special tokens, and the
    # segments of one text meet again for the joins.
    out = docs.where(F.coalesce(F.length("text"), F.lit(0)) <= split_chars).mapInArrow(short, schema)
    long = materialise(docs.where(F.length("text") > split_chars).select("doc_id", "text", F.sha2("text", 256).alias("key")), "long-texts")
    if long.isEmpty():
        return out
    marks = "|".join(f"\\Q{s}\\E" for s in sorted(encoder(path).special, key=len, reverse=True))
    parts = long.dropDuplicates(["key"])
    if marks:
        parts = parts.select("key", F.posexplode(F.split("text", marks, -1)).alias("part", "between"), F.regexp_extract_all("text", F.lit(marks), F.lit(0)).alias("marks"))
        parts = parts.select("key", "part", "between", F.get("marks", F.col("part")).alias("mark"))
    else:
        parts = parts.select("key", F.lit(0).alias("part"), F.col("text").alias("between"), F.lit(None).cast("string").alias("mark"))
    last = F.greatest(F.lit(1), F.ceil(F.length("between") / split_chars).cast("int")) - 1
    segments = parts.select("key", "part", "mark", "between", F.explode(F.sequence(F.lit(0), last)).alias("seg"))
    segments = segments.select("key", "part", "mark", "seg", F.expr(f"substring(between, seg * {split_chars} + 1, {split_chars})").alias("text"))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for part in slices(batches):
            done = [enc.tree(t.encode()) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array([p.data for p in done], pa.binary()), pa.array([p.ids.tobytes() for p in done], pa.binary())], ["key", "part", "mark", "seg", "data", "ids"])

    def whole(t: pa.Table) -> pa.Table:
        enc = encoder(path)
        ids, run = [], []
        t = t.sort_by([("part", "ascending"), ("seg", "ascending")])
        for part, mark, data, own in zip(*(t.column(c).to_pylist() for c in ("part", "mark", "data", "ids")), strict=True):
            if run and run[0][0] != part:
                ids.append(enc.joined([p for _, p in run]).ids.tobytes())
                if last_mark is not None:
                    ids.append(array("I", [enc.special[last_mark]]).tobytes())
                run = []
            run.append((part, Part(data, np.frombuffer(own, np.uint32))))
            last_mark = mark
        ids.append(enc.joined([p for _, p in run]).ids.tobytes())
        return pa.table({"key": t.column("key").slice(0, 1), "ids": pa.array([b"".join(ids)], pa.binary())})

    def closing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield finish(part.column("doc_id"), part.column("ids").to_pylist(), encoder(path))

    shape = "key string, part int, mark string, seg int, data binary, ids binary"
    found = segments.repartition("key", "part", "seg").mapInArrow(encoded, shape).groupBy("key").applyInArrow(whole, "key string, ids binary")
    return out.unionByName(long.select("doc_id", "key").join(found, "key").select("doc_id", "ids").mapInArrow(closing, schema))


def encode(docs: DataFrame, path: str, split_chars: int = SPLIT_CHARS) -> DataFrame:
    """doc_id, ids array<int>: one row per document."""

    def rows(doc_id: pa.Array, ids: list[bytes], enc: Encoder) -> pa.RecordBatch:
        offsets = np.cumsum([0, *(len(x) // 4 for x in ids)], dtype=np.int32)
        return pa.RecordBatch.from_arrays([doc_id, pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), np.int32)))], ["doc_id", "ids"])

    return mapped(docs, path, rows, "ids array<int>", split_chars)


def digests(docs: DataFrame, path: str, split_chars: int = SPLIT_CHARS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""

    def row(enc: Encoder, ids: bytes) -> tuple[int, str, str]:
        back = enc.decode_bytes(np.frombuffer(ids, np.uint32))
        try:
            back.decode("utf-8")
        except UnicodeDecodeError:
            back = back.decode("utf-8", "replace").encode()
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest()

    def rows(doc_id: pa.Array, ids: list[bytes], enc: Encoder) -> pa.RecordBatch:
        n, a, b = zip(*(row(enc, x) for x in ids))
        return pa.RecordBatch.from_arrays([doc_id, pa.array(n, pa.int64()), pa.array(a), pa.array(b)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return mapped(docs, path, rows, "n_tokens long, ids_sha256 string, decoded_sha256 string", split_chars)


def op10_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
