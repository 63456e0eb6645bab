"""Periodic runs of words by the tandem-repeat method of Gusfield and Stoye, and their collapse.

A run is a stretch of words with smallest period q that no neighbouring word
extends; those of at least ``EXPONENT`` periods and ``SHORTEST`` words count.
Each document is searched by itself, so nothing is shuffled:

1. A stretch that can have such a run is one in which each three neighbouring
   words come at least three times. This follows from the two bounds (a run of
   length 4q has 4q - 2 of them, q different ones at most), so no run is lost.
   All documents of a slice are reduced at once by counts of hashes, first of
   buckets, then of the hashes themselves until nothing goes.
2. The suffix tree of a stretch is built from left to right. It gives the blocks
   of the Lempel-Ziv factorisation, and common extensions around each block give
   a square for each leftmost one (a covering set).
3. The squares are marked in the tree, where a chain of nodes shares its first
   leaf, and walks by suffix links complete the vocabulary: from aXaX to XaXa
   until such a word does not occur or is marked already.
4. Squares of a primitive root are located at the leaves below their marks
   (n log n places at most); places of one root length that follow each other
   merge into a run.

All but the last step is linear in the stretch. A document's words, its tree and
places are in one task; documents are taken by slices of bounded bytes. A stretch's
tree takes a few hundred bytes a word while it is searched.

Defined results: null or empty text, or one without words, has no run and empty
collapsed text; equal words are the same words, whatever the case. Repeated rows
and ids give their rows each; a null id is not rewritten by the query. An empty
table gives no rows. Only ``doc_id`` and ``text`` are read, so other columns may
have any name.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadline.llm.common import slices, words_of

#: A run's least number of periods and of words; step 1 rests on these two.
EXPONENT, SHORTEST = 4, 6
#: Buckets in which a slice's triples of words are counted first.
_BITS = 22
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)

_unlike_split = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]").search

Run = tuple[int, int, int]


class SuffixTree:
    """The suffix tree of a list of numbers, the last of which comes once.

    Node 0 is the root. ``start``: where the edge above a node stands in the list; ``depth``: length of the node's
    word; ``first``: its first place; ``lo``, ``hi``: its part of ``leaves``, the places of all suffixes.
    """

    def __init__(self, s: list[int]):
        self.s = s
        self._build()
        self._number()

    def _build(self) -> None:
        s, n = self.s, len(self.s)
        start, end, link, kids, suffix = [0], [0], [0], [{}], [-1]
        node = at = length = waiting = 0
        for i, c in enumerate(s):
            inner = 0
            waiting += 1
            while waiting:
                if not length:
                    at = i
                kid = kids[node].get(s[at])
                if kid is None:
                    kids[node][s[at]] = len(start)
                    start.append(i), end.append(n), link.append(0), kids.append(None), suffix.append(i - waiting + 1)
                    if inner:
                        link[inner] = node
                        inner = 0
                else:
                    size = end[kid] - start[kid]
                    if length >= size:
                        at += size
                        length -= size
                        node = kid
                        continue
                    part = start[kid] + length
                    if s[part] == c:
                        length += 1
                        if inner:
                            link[inner] = node
                        break
                    middle = kids[node][s[at]] = len(start)
                    start.append(start[kid]), end.append(part), link.append(0), kids.append({s[part]: kid, c: middle + 1}), suffix.append(-1)
                    start.append(i), end.append(n), link.append(0), kids.append(None), suffix.append(i - waiting + 1)
                    start[kid] = part
                    if inner:
                        link[inner] = middle
                    inner = middle
                waiting -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    at = i - waiting + 1
        self.start, self.link, self.kids, self._end, self._suffix = start, link, kids, end, suffix

    def _number(self) -> None:
        start, end, kids, suffix = self.start, self._end, self.kids, self._suffix
        size, n = len(start), len(self.s)
        parent, depth, first = [0] * size, [0] * size, [n] * size
        lo, hi, leaf, leaves, order = [0] * size, [0] * size, [0] * n, [], []
        stack = [0]
        while stack:
            v = stack.pop()
            order.append(v)
            lo[v] = len(leaves)
            below = kids[v]
            if below is None:
                first[v] = suffix[v]
                leaf[suffix[v]] = v
                leaves.append(suffix[v])
                hi[v] = len(leaves)
            else:
                d = depth[v]
                for kid in below.values():
                    parent[kid] = v
                    depth[kid] = d + end[kid] - start[kid]
                    stack.append(kid)
        for v in reversed(order):
            p = parent[v]
            if first[v] < first[p]:
                first[p] = first[v]
            if hi[v] > hi[p]:
                hi[p] = hi[v]
        self.parent, self.depth, self.first, self.lo, self.hi, self.leaf, self.order = parent, depth, first, lo, hi, leaf, order
        self.leaves = np.array(leaves, np.int64)


def blocks(tree: SuffixTree) -> list[int]:
    """Where the blocks begin, and the end: a block is the longest word from there that also begins before, or one new symbol."""
    s, kids, first, depth = tree.s, tree.kids, tree.first, tree.depth
    n, h, found = len(s), 0, []
    while h < n:
        found.append(h)
        node = 0
        while kids[node] is not None:
            kid = kids[node][s[h + depth[node]]]
            if first[kid] >= h:
                break
            node = kid
        h += max(1, depth[node])
    return [*found, n]


def _common(a: list[int]) -> list[int]:
    """For each place, how far the list agrees with its own begin from there on."""
    n = len(a)
    z, left, right = [0] * n, 0, 0
    for i in range(1, n):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and a[k] == a[i + k]:
            k += 1
        z[i] = k
        left, right = i, i + k
    return z


def covering(tree: SuffixTree) -> dict[int, list[int]]:
    """Begin -> half lengths of squares, such that the first occurrence of each square lies in a row of squares that begins there."""
    s = tree.s
    n, found = len(s), {}
    starts = blocks(tree)
    starts.append(n)
    for h, h1, h2 in zip(starts, starts[1:], starts[2:], strict=False):
        size = h1 - h
        # centre in the block, end after it
        if h1 < n:
            ahead = s[h1 : h1 + size]
            forward = _common([*ahead, -2, *s[h : h1 + size]])[len(ahead) + 1 :]
            backward = _common([*s[h:h1][::-1], -2, *s[max(0, h1 - 2 * size) : h1][::-1]])[size + 1 :]
            for k in range(1, size + 1):
                k1 = forward[size - k]
                if k1:
                    k2 = backward[k] if k < len(backward) else 0
                    if k1 + k2 >= k:
                        found.setdefault(h1 - k - min(k2, k - 1), []).append(k)
        # begin before the block, centre in it
        if h:
            most = h2 - h
            forward = _common(s[h : h + 2 * most])
            low, high = max(0, h - most), min(n, h + most)
            backward = _common([*s[low:h][::-1], -2, *s[low:high][::-1]])[h - low + 1 :]
            for k in range(1, min(most, len(forward) - 1, high - h) + 1):
                k1 = forward[k]
                if k1:
                    k2 = backward[high - h - k]
                    if k2 and k1 + k2 >= k:
                        begin = h - min(k2, k - 1)
                        if begin + k <= h1:
                            found.setdefault(begin, []).append(k)
    return found


def vocabulary(tree: SuffixTree) -> dict[int, set[int]]:
    """Node -> lengths of the squares that end on the edge above it: all squares of the list, each once."""
    s, kids, first, depth, parent, link, start = tree.s, tree.kids, tree.first, tree.depth, tree.parent, tree.link, tree.start
    marked: dict[int, set[int]] = {}
    begun = []
    for i, halves in covering(tree).items():
        v = tree.leaf[i]
        for size in sorted({2 * k for k in halves}, reverse=True):
            while v and first[v] == i and depth[parent[v]] >= size:
                v = parent[v]
            if not v or first[v] != i:
                break
            sizes = marked.setdefault(v, set())
            if size not in sizes:
                sizes.add(size)
                begun.append((v, size))
    for v, size in begun:
        while True:
            i = first[v]
            a = s[i]
            w = link[parent[v]]
            d, kid = depth[w], 0
            while d < size - 1:
                kid = kids[w][s[i + 1 + d]]
                if depth[kid] >= size:
                    break
                w, d = kid, depth[kid]
            if d == size - 1:
                kid = kids[w].get(a) if kids[w] is not None else None
                if kid is None:
                    break
            elif s[start[kid] + size - 1 - d] != a:
                break
            sizes = marked.setdefault(kid, set())
            if size in sizes:
                break
            sizes.add(size)
            v = kid
    return marked


class _Periods:
    """Up to where the list keeps a period from a place on; each maximal stretch is measured once."""

    def __init__(self, s: list[int]):
        self.s = s
        self.known: dict[int, list[tuple[int, int]]] = {}

    def end(self, i: int, p: int) -> int:
        s, known = self.s, self.known.setdefault(p, [])
        k = bisect_right(known, (i, len(s))) - 1
        if k < 0 or known[k][1] <= i:
            low = high = i
            while high + p < len(s) and s[high] == s[high + p]:
                high += 1
            while low and s[low - 1] == s[low - 1 + p]:
                low -= 1
            known.insert(k + 1, (low, high))
            k += 1
        return known[k][1] + p


def primitive_squares(tree: SuffixTree) -> Iterator[tuple[int, np.ndarray]]:
    """Root length and all places of each square whose root is no power."""
    marked, periods = vocabulary(tree), _Periods(tree.s)
    roots: list[tuple[int, ...]] = [()] * len(tree.start)
    for v in tree.order:
        above = roots[tree.parent[v]]
        for size in sorted(marked.get(v, ())):
            q, i = size // 2, tree.first[v]
            if any(q % p == 0 and periods.end(i, p) >= i + size for p in above):
                continue
            above = (*above, q)
            yield q, tree.leaves[tree.lo[v] : tree.hi[v]]
        roots[v] = above


def runs_of(symbols: list[int], shortest: int = SHORTEST, exponent: int = EXPONENT) -> list[Run]:
    """start, length, period of the runs of a list of numbers from 0 on, by start, then period."""
    n = len(symbols)
    keys = [q * (n + 1) + places for q, places in primitive_squares(SuffixTree([*symbols, -1]))] if n > 1 else []
    if not keys:
        return []
    at = np.sort(np.concatenate(keys))
    begins = np.flatnonzero(np.diff(at, prepend=-2) != 1)
    q, first = np.divmod(at[begins], n + 1)
    length = np.diff(begins, append=len(at)) - 1 + 2 * q
    some = np.flatnonzero((length >= shortest) & (length >= exponent * q))
    return sorted(zip(first[some].tolist(), length[some].tolist(), q[some].tolist(), strict=True))


def _triples(hashes: np.ndarray, group: np.ndarray) -> np.ndarray:
    key = hashes[:-2] * _MIX[0] + (hashes[1:-1] ^ (hashes[1:-1] >> np.uint64(29))) * _MIX[1] + (hashes[2:] ^ (hashes[2:] >> np.uint64(31))) * _MIX[2]
    key ^= group[:-2].astype(np.uint64) * _MIX[3]
    key ^= key >> np.uint64(32)
    return key * _MIX[0]


def _stretches(good: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends (in words) of the stretches of good triples inside a group that can have a run."""
    good = good & (group[:-2] == group[2:])
    edge = np.diff(good.astype(np.int8), prepend=0, append=0)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + 2
    # stretches of two neighbouring groups don't touch: the triples across their border are not good
    some = end - begin >= SHORTEST
    return begin[some], end[some]


def candidates(hashes: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the stretches of words that can have a run; group is the number of each word's document."""
    if len(hashes) < SHORTEST:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    bucket = (_triples(hashes, group) >> np.uint64(64 - _BITS)).astype(np.int64)
    begin, end = _stretches(np.bincount(bucket, minlength=1 << _BITS)[bucket] >= 3, group)
    before = -1
    while len(begin) and (total := int((end - begin).sum())) != before:
        before = total
        size = end - begin
        part = np.repeat(np.arange(len(begin)), size)
        place = np.arange(total) + np.repeat(begin - (np.cumsum(size) - size), size)
        key = _triples(hashes[place], part)
        _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        b, e = _stretches(count[inverse] >= 3, part)
        begin, end = place[b], place[e - 1] + 1
    return begin, end


def split_words(text: str) -> list[str]:
    return words_of(text) if _unlike_split(text) else text.split()


def runs_of_texts(lists: list[list[str]]) -> list[list[Run]]:
    """The runs of each list of words."""
    sizes = [len(ws) for ws in lists]
    hashes = np.fromiter((h for ws in lists for h in map(hash, ws)), np.int64, sum(sizes)).astype(np.uint64)
    found: list[list[Run]] = [[] for _ in lists]
    ends = np.cumsum(sizes, dtype=np.int64)
    for begin, end in zip(*candidates(hashes, np.repeat(np.arange(len(lists)), sizes)), strict=True):
        k = int(np.searchsorted(ends, begin, side="right"))
        low = int(begin - ends[k] + sizes[k])
        number: dict[str, int] = {}
        symbols = [number.setdefault(w, len(number)) for w in lists[k][low : low + int(end - begin)]]
        found[k] += [(low + start, length, period) for start, length, period in runs_of(symbols)]
    return [sorted(r) for r in found]


def collapse(words: list[str], runs: list[Run]) -> list[str]:
    """The words that no run has after its first period."""
    if not runs:
        return words
    keep = bytearray(b"\x01") * len(words)
    for start, length, period in runs:
        keep[start + period : start + length] = bytes(length - period)
    return list(compress(words, keep))


def find(docs: DataFrame, rewrite: Callable[[object, list[str]], list[str]] | None = None) -> DataFrame:
    """doc_id, runs (start, length, period by start, then period) and the collapsed text; rewrite may change a document's words first."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in slices(b, 1)):
            lists = [split_words(t) if t else [] for t in part.column(1).to_pylist()]
            if rewrite is not None:
                lists = [rewrite(i, ws) for i, ws in zip(part.column(0).to_pylist(), lists, strict=True)]
            runs = runs_of_texts(lists)
            texts = pa.array([" ".join(collapse(ws, r)) for ws, r in zip(lists, runs, strict=True)], pa.string())
            as_rows = pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in rs] for rs in runs], run_type)
            yield pa.RecordBatch.from_arrays([part.column(0), as_rows, texts], ["doc_id", "runs", "collapsed"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def periodic(doc_id: object, words: list[str]) -> list[str]:
    """The query's words: in a tenth of the documents the rest from some word on repeats its own begin."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def op11(docs: DataFrame) -> DataFrame:
    """The number of runs of every document, its longest run, and digests of its runs and of its collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return find(docs, periodic).withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
