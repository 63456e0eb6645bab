"""SimHash near-duplicates, compared bit-sliced.

Documents become 64-bit fingerprints; equal ones are one row from there on, so
thousands of copies cost no comparison. By the pigeonhole principle two
fingerprints within the radius agree in ``blocks - radius`` of the blocks into
which the bits are cut: each distinct fingerprint goes to a bucket for every
choice of that many blocks, and buckets are compared exactly. The number of
blocks is the least that keeps buckets small on average, which changes the work
and never the result; buckets beyond ``TILE`` rows are cut into chunks, and each
pair of chunks is a bucket of its own, so one task holds 2 * TILE rows at most.

Inside a task bit planes are stored vertically: plane b holds bit b of 64
fingerprints in each machine word. A query XORs with all planes in turn;
carry-save counters add the differing bits of all lanes at once, and a block of
lanes is left as soon as all of them exceed the radius. A bucket gives a
spanning forest of its links, never all pairs.

Defined results: text without words (or null) has fingerprint zero and is
linked like any other; a null doc_id gets its group's least other id, or null
where the group has none. Rows of one doc_id count each, equal rows too. Whole
texts count, however long; a task has one slice of texts, bounded in bytes, as
Python objects. An empty table gives no rows. Only ``doc_id`` and ``text`` are
read, so other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadline.llm.common import cut, fresh, slices
from threadline.llm.graph import components

RADIUS = 4
SHINGLE = 4
SEED = 42
TILE = 8192
#: Mean rows of a bucket from which one more block is used.
FULL_BUCKET = 2048
#: Rows of a pack of buckets (a larger bucket is one by itself), and packs compared at once.
PACK, SIDE_BY_SIDE = 256, 8
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None) -> int:
    """A bit is 1 if set in over half the hashes of the 4-word shingles."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    k = min(SHINGLE, len(words))
    starts = [0, *(ends[: len(words) - k] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(starts, ends[k - 1 :].tolist(), strict=True)], np.uint64)
    bits = np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, *also: str) -> DataFrame:
    """doc_id, other columns, fingerprint as a signed long, of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in slices(b, 1)):
            found = [fingerprint(t) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), *part.columns[2:], pa.array(found, pa.int64())], [*part.schema.names[:1], *part.schema.names[2:], "fingerprint"])

    more = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in also)
    return docs.select("doc_id", "text", *also).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}{more}, fingerprint long")


def planes(prints: np.ndarray) -> np.ndarray:
    """64 planes of one bit of 64 fingerprints a word."""
    padded = np.zeros(-len(prints) % 64 + len(prints), np.uint64)
    padded[: len(prints)] = prints
    bits = np.unpackbits(padded.view(np.uint8), bitorder="little").reshape(len(padded), 64)
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def exceed(over: np.ndarray, counters: tuple, radius: int) -> np.ndarray:
    """Lanes whose count, in three counter planes and an overflow, is above the radius (0 to 7)."""
    above, equal = np.zeros_like(over), np.full_like(over, ONES)
    for weight, c in zip((4, 2, 1), counters, strict=True):
        if radius & weight:
            equal &= c
        else:
            above |= equal & c
            equal &= ~c
    return above | over


def within(table: np.ndarray, flip: np.ndarray, over: np.ndarray, radius: int) -> np.ndarray | None:
    """Lanes within the radius, bit by bit, or None as soon as all exceed it.

    table: for each bit its plane over the lanes; flip: for each bit all ones
    where a query has it; over: lanes not to compare. Two bits are added at a
    time by a carry-save adder.
    """
    c1, c2, c4 = (np.zeros_like(over) for _ in range(3))
    dead = over
    for b in range(0, 64, 2):
        d, e = table[b] ^ flip[b], table[b + 1] ^ flip[b + 1]
        x = c1 ^ d
        carry = (c1 & d) | (x & e)
        c1 = x ^ e
        high = c2 & carry
        c2 ^= carry
        over |= c4 & high
        c4 ^= high
        if b % 8 == 6 and b > 8 and (dead := exceed(over, (c4, c2, c1), radius)).min() == ONES:
            return None
    return ~dead


def _spread(prints: np.ndarray) -> np.ndarray:
    """For each of 64 bits all ones where a fingerprint has it."""
    return (prints >> np.arange(64, dtype=np.uint64).reshape(-1, *[1] * prints.ndim) & np.uint64(1)) * ONES


def _packed(marks: np.ndarray) -> np.ndarray:
    """Marks of lanes as words; lanes beyond the last are marked."""
    full = np.ones((*marks.shape[:-1], -marks.shape[-1] % 64 + marks.shape[-1]), np.uint8)
    full[..., : marks.shape[-1]] = marks
    return np.packbits(full, axis=-1, bitorder="little").view(np.uint64)


def _places(alive: np.ndarray) -> tuple[np.ndarray, ...]:
    """Indices of set lanes, the last being the lane."""
    at = np.nonzero(alive)
    k, lane = np.nonzero(np.unpackbits(alive[at].view(np.uint8), bitorder="little").reshape(-1, 64))
    return (*(i[k] for i in at[:-1]), at[-1][k] * 64 + lane)


def near(queries: np.ndarray, lanes: np.ndarray, radius: int = RADIUS, passed: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Places (query, lane) of all pairs within the radius, without those that ``passed`` marks (queries x lanes)."""
    marks = np.zeros((len(queries), len(lanes)), bool) if passed is None else passed
    alive = within(planes(lanes), _spread(queries)[..., None], _packed(marks), radius)
    return (np.empty(0, np.int64),) * 2 if alive is None else _places(alive)


def near_in_packs(packs: list[np.ndarray], radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (pack, i, j), i < j, within the radius; small packs are compared side by side."""
    n = max(map(len, packs))
    n += -n % 64
    prints = np.zeros((len(packs), n), np.uint64)
    for row, pack in zip(prints, packs, strict=True):
        row[: len(pack)] = pack
    bits = np.unpackbits(prints.view(np.uint8), axis=1, bitorder="little").reshape(len(packs), n, 64)
    table = np.packbits(np.ascontiguousarray(bits.transpose(2, 0, 1)), axis=2, bitorder="little").view(np.uint64)[:, :, None, :]
    place = np.arange(n)
    size = np.array([len(p) for p in packs])[:, None, None]
    over = _packed((place[None, None, :] <= place[None, :, None]) | (place[None, None, :] >= size))
    alive = within(table, _spread(prints)[..., None], over, radius)
    return (np.empty(0, np.int64),) * 3 if alive is None else _places(alive)


class Roots:
    """Union of places; joined() says whether a link is new."""

    def __init__(self, n: int):
        self.root = list(range(n))

    def top(self, i: int) -> int:
        root = self.root
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def joined(self, x: int, y: int) -> bool:
        a, b = self.top(x), self.top(y)
        self.root[b] = a
        return a != b


def spanning(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of links i < j between n places as few as connect the same places.

    Every place keeps its link to the least other; where trees of those meet,
    one link for each two trees is looked at.
    """
    tree = np.arange(n)
    np.minimum.at(tree, j, i)
    keep = tree[j] == i
    while not np.array_equal(up := tree[tree], tree):
        tree = up
    a, b = tree[i], tree[j]
    other = np.flatnonzero(a != b)
    other = other[np.unique(np.minimum(a, b)[other] * n + np.maximum(a, b)[other], return_index=True)[1]]
    roots = Roots(n)
    keep[[k for k in other.tolist() if roots.joined(int(a[k]), int(b[k]))]] = True
    return i[keep], j[keep]


def forest(prints: np.ndarray, radius: int = RADIUS, lanes: int = 4096, queries: int = 256) -> Iterator[tuple[int, int]]:
    """Links that span each group of linked fingerprints, as pairs of places."""
    roots = Roots(len(prints))
    for at in range(0, len(prints), lanes):
        block = prints[at : at + lanes]
        for q in range(0, at + len(block), queries):
            some = prints[q : q + queries]
            # Only later lanes are compared: the rest, each query itself among them, would keep its block from being left.
            ahead = None if q + len(some) <= at else np.arange(at, at + len(block))[None, :] <= np.arange(q, q + len(some))[:, None]
            i, j = near(some, block, radius, ahead)
            i, j = spanning(i + q, j + at, len(prints))
            for x, y in zip(i.tolist(), j.tolist(), strict=True):
                if roots.joined(x, y):
                    yield x, y


def forests(packs: list[np.ndarray], radius: int) -> Iterator[tuple[int, int]]:
    """Links that span the groups of each pack, as pairs of fingerprints."""
    small = [p for p in packs if len(p) <= 2 * PACK]
    if small:
        begin = np.cumsum([0, *map(len, small)])
        every = np.concatenate(small)
        pack, i, j = near_in_packs(small, radius)
        i, j = spanning(begin[pack] + i, begin[pack] + j, len(every))
        yield from zip(every[i].tolist(), every[j].tolist(), strict=True)
    for pack in packs:
        if len(pack) > 2 * PACK:
            yield from ((int(pack[x]), int(pack[y])) for x, y in forest(pack, radius))


def block_keys(fingerprint: Column, blocks: int, radius: int) -> Column:
    """One key for each choice of ``blocks - radius`` blocks: the choice's number and those bits."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    part = [
        F.shiftrightunsigned(fingerprint, edges[i]).bitwiseAND(F.lit((1 << (edges[i + 1] - edges[i])) - 1))
        for i in range(blocks)
    ]
    return F.array(*(F.xxhash64(F.lit(n), *(part[i] for i in some)) for n, some in enumerate(combinations(range(blocks), blocks - radius))))


def _tiled(keyed: DataFrame, tile: int) -> DataFrame:
    """bucket, fingerprint of keyed (bucket, fingerprint): buckets beyond ``tile`` rows become one bucket for each pair of chunks."""
    full = keyed.groupBy("bucket").count().filter(F.col("count") > tile).select("bucket", F.ceil(2 * F.col("count") / tile).cast("int").alias("chunks"))
    known = keyed.join(full, "bucket", "left")
    mine = F.pmod(F.xxhash64("fingerprint", F.lit(1)), F.col("chunks")).cast("int")
    others = F.transform(F.filter(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: j != mine), lambda j: F.xxhash64("bucket", F.least(mine, j), F.greatest(mine, j)))
    return known.select(F.explode(F.when(F.col("chunks").isNull(), F.array("bucket")).otherwise(others)).alias("bucket"), "fingerprint")


def links(prints: DataFrame, radius: int = RADIUS, tile: int = TILE, full_bucket: int = FULL_BUCKET) -> DataFrame:
    """a, b: links that connect all distinct fingerprints within the radius of each other, directly or over others."""
    if not 0 <= radius <= 7:
        raise ValueError("three counter planes hold distances up to 7")
    n = prints.count()
    blocks = radius + 1
    while blocks < 2 * radius + 1 and n / 2 ** (64 * (blocks - radius) / blocks) > full_bucket:
        blocks += 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(packs: list[np.ndarray]) -> pa.RecordBatch:
            pairs = np.array(list(forests([p.view(np.uint64) for p in packs], radius)), np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        held: list[np.ndarray] = [np.empty(0, np.int64)] * 2
        packs: list[np.ndarray] = []
        for batch in batches:
            keys, values = (np.concatenate([h, c.to_numpy()]) for h, c in zip(held, batch.columns, strict=True))
            # Whole buckets go together while they fit into a pack: links between buckets are links too.
            ends = (np.flatnonzero(np.diff(keys)) + 1).tolist()
            start = 0
            for end, following in zip(ends, [*ends[1:], len(keys)], strict=True):
                if following - start > PACK:
                    packs.append(values[start:end])
                    start = end
                    if len(packs) == SIDE_BY_SIDE:
                        yield found(packs)
                        packs = []
            held = [keys[start:], values[start:]]
        if len(held[0]):
            packs.append(held[1])
        if packs:
            yield found(packs)

    keyed = prints.select(F.explode(block_keys(F.col("fingerprint"), blocks, radius)).alias("bucket"), "fingerprint")
    return _tiled(keyed, tile).repartition("bucket").sortWithinPartitions("bucket", "fingerprint").mapInArrow(run, "a long, b long")


def classes(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """distinct (fingerprint and more) with component, the least fingerprint of those linked with it."""
    of = components(links(distinct.select("fingerprint"), radius, tile)).withColumnRenamed("node", "fingerprint")
    return distinct.join(of, "fingerprint", "left").withColumn("component", F.coalesce("component", "fingerprint"))


def groups(prints: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """doc_id, fingerprint, component_id of prints (doc_id, fingerprint)."""
    labelled = classes(cut(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least_id"))), radius, tile)
    least = labelled.groupBy("component").agg(F.min("least_id").alias("component_id"))
    ids = cut(labelled.join(least, "component").select("fingerprint", "component_id"))
    return prints.join(ids, "fingerprint").select("doc_id", "fingerprint", "component_id")


def op7(docs: DataFrame) -> DataFrame:
    return groups(cut(fingerprints(docs))).select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group: that of the least doc_id, once even where its row repeats. Rows without an id stay.

    Of texts of one group that share the least doc_id, the one of least hash
    stays; a text that has no near-duplicate stays, whatever other texts its
    doc_id has.
    """
    text_hash = F.xxhash64("text")
    (h,) = fresh(docs, "text_hash")
    prints = cut(fingerprints(docs.filter("doc_id is not null").select("doc_id", "text", text_hash.alias(h)), h))
    labelled = classes(cut(prints.groupBy("fingerprint").agg(F.min(F.struct("doc_id", h)).alias("first"))))
    kept = cut(labelled.groupBy("component").agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias("doc_id"), F.col(f"first.{h}").alias(h)))
    known = docs.withColumn(h, text_hash).join(kept, ["doc_id", h], "left_semi").dropDuplicates(["doc_id", h])
    return known.select(docs.columns).unionByName(docs.filter("doc_id is null"))
