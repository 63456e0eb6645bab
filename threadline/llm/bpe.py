"""Byte-level BPE encoding and decoding.

Each match of the split pattern is merged on its own. Of at most ``SHORT`` bytes
the ranks of neighbouring pairs are a list whose least is looked up for each
merge. Of a longer match a segment tree over its
byte positions holds, at leaf i, the rank of the pair that starts at i and the
position itself; the root is the leftmost pair of least rank. A merge changes
three leaves (the pair, its swallowed right part and the left neighbour), each
with one walk to the root, so a match of n bytes takes O(n log n) however long
it is.

Defined results: null text is empty text; an empty text has no ids; decoding
an empty or null list gives empty bytes; ids unknown to the vocabulary raise; an
empty table gives no rows.
Rows are independent, so hot keys, ties and repeated rows need no care. Only
``doc_id`` and ``text`` are read; other columns may have any name.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadline.llm.common import SLICE, slices

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Matches kept with their ids in one Python worker; the memory is bounded, the result does not depend on it.
MEMO = 300_000
#: Bytes of a match up to which a look through all its pairs for each merge is cheaper than a tree.
SHORT = 64
_NONE = 1 << 62


@lru_cache(maxsize=2)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one match of the pattern."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    return merge_short(piece, ranks) if len(piece) <= SHORT else merge_long(piece, ranks)


def merge_short(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    rank = ranks.get
    cuts = list(range(len(piece) + 1))
    pairs = [rank(piece[i : i + 2], _NONE) for i in range(len(piece) - 1)]
    while pairs and (least := min(pairs)) != _NONE:
        i = pairs.index(least)
        del pairs[i], cuts[i + 1]
        if i < len(pairs):
            pairs[i] = rank(piece[cuts[i] : cuts[i + 2]], _NONE)
        if i:
            pairs[i - 1] = rank(piece[cuts[i - 1] : cuts[i + 1]], _NONE)
    return [ranks[piece[a:b]] for a, b in zip(cuts, cuts[1:], strict=False)]


def merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    n = len(piece)
    size = 1 << (n - 1).bit_length()
    tree = [_NONE] * (2 * size)
    rank = ranks.get
    for i in range(n - 1):
        r = rank(piece[i : i + 2])
        if r is not None:
            tree[size + i] = r << 32 | i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    end = list(range(1, n + 1))
    before = list(range(-1, n))

    def put(at: int, key: bytes | None) -> None:
        """Set the leaf at a place to the rank of a pair, and the nodes above it."""
        r = rank(key)
        value = _NONE if r is None else r << 32 | at
        k = size + at
        while k and tree[k] != value:
            tree[k] = value
            other = tree[k ^ 1]
            if other < value:
                value = other
            k >>= 1

    while (top := tree[1]) != _NONE:
        i = top & 0xFFFFFFFF
        j = end[i]
        e = end[i] = end[j]
        before[e] = i
        put(j, None)
        put(i, piece[i : end[e]] if e < n else None)
        if i:
            p = before[i]
            put(p, piece[p:e])
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = end[i]
    return ids


class Memo(dict):
    """Match of the pattern -> its ids as packed 32-bit integers.

    When half of ``MEMO`` are held, they become the former half; what is asked
    for again moves on, so frequent matches stay however many rare ones pass.
    """

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks
        self.former: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= MEMO // 2:
            self.former = dict(self)
            self.clear()
        packed = self.former.get(piece)
        if packed is None:
            packed = array("i", merge(piece.encode(), self.ranks)).tobytes()
        self[piece] = packed
        return packed


@lru_cache(maxsize=2)
def _encoder(path: str) -> tuple:
    memo = Memo(load_ranks(path))
    return regex.compile(public_tokenizers.PATTERN).findall, memo.__getitem__


@lru_cache(maxsize=2)
def _decoder(path: str) -> list[bytes]:
    ranks = load_ranks(path)
    table = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        table[i] = token
    return table


def encode_text(text: str, path: str = VOCABULARY) -> list[int]:
    find, ids = _encoder(path)
    return np.frombuffer(b"".join(map(ids, find(text))), np.int32).tolist()


def _ids(texts: list[str | None], path: str) -> pa.ListArray:
    find, ids = _encoder(path)
    packed = [b"".join(map(ids, find(t))) if t else b"" for t in texts]
    offsets = np.zeros(len(packed) + 1, np.int32)
    np.cumsum([len(p) // 4 for p in packed], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), np.int32)))


def _bytes(ids: pa.ListArray, path: str) -> pa.Array:
    table = _decoder(path).__getitem__
    return pa.array([b"".join(map(table, x.values.to_numpy(zero_copy_only=False).tolist())) if x.is_valid else b"" for x in ids], pa.binary())


def _id_type(df: DataFrame) -> str:
    return df.schema["doc_id"].dataType.simpleString()


def encode(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, ids array<int> of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in slices(b, 1)):
            yield pa.RecordBatch.from_arrays([part.column(0), _ids(part.column(1).to_pylist(), path)], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {_id_type(docs)}, ids array<int>")


def decode(encoded: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, ids, decoded binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE)):
            yield pa.RecordBatch.from_arrays([*part.columns, _bytes(part.column(1), path)], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {_id_type(encoded)}, ids array<int>, decoded binary")


def round_trip(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """decode(encode(docs)) by one worker for each task instead of two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in slices(b, 1)):
            ids = _ids(part.column(1).to_pylist(), path)
            yield pa.RecordBatch.from_arrays([part.column(0), ids, _bytes(ids, path)], ["doc_id", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {_id_type(docs)}, ids array<int>, decoded binary")


def op6(docs: DataFrame) -> DataFrame:
    """Digests of the ids and of the decoded bytes of every document."""
    return round_trip(docs).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
