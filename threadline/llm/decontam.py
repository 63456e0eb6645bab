"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact verification.

Texts are sequences of lower-cased words. An item of n words is found in a
document where some passage has a word edit distance of at most a fifth of n (a
similarity of 0.8); items under six words must match exactly. Items under
``MIN_WORDS`` words are found too, but common phrases may be such items: a
document is dropped for one of them only where it is the document's whole text.

Items over ``WHOLE`` words are searched by pieces of up to ``PIECE`` words: if
every piece had more than a fifth of its words in edits, so would the item, so at
least one piece of each match is within its own share. Pieces give candidates
only; the whole item is verified.

1. Windows as long as an item or piece (item lengths are rounded down to few classes, and
   the item's beginning of that length is compared) are taken at every word that
   passes the q-gram lemma: a passage within d edits of n words shares at least
   n - 2 - 3d of its word triples, so any window with fewer triples from the
   items is no match. This drops work, never a match.
2. CGK embedding: a random walk over a window repeats or takes each word by a
   random bit of (step, word), which turns edits into Hamming differences.
   ``WALKS`` walks are each sampled at ``SAMPLES`` sets of ``SAMPLED``
   places; a window and an item whose samples agree are a candidate. On passages
   at the full edit distance this reaches a recall over 0.95 (see the tests).
3. Each candidate is verified by the exact edit distance of the item to the best
   passage around the window (bit-parallel, any length).

The items go to the tasks in blocks of ``BLOCK_ITEMS``, a proven bound: a larger
benchmark takes one pass over the documents for each block. Documents are never
shuffled, so hot sources and copies make no hot task.

Defined results: null or empty texts and items, and those without a word, match
nothing; repeated rows give repeated results; null ids are ids like others; an
empty table on either side gives none. Of several places of one item in a
document the nearest, then the first counts. Whole texts count, however long; a
task has one slice of texts, bounded in bytes, as Python objects, and what is
found does not depend on how texts are sliced. Only doc_id and text, item_id and
text are read, so other columns may have any names.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadline.llm.common import Hashes, filter_texts, slices

SIMILARITY = 0.8
MIN_WORDS = 5
WALKS, SAMPLES, SAMPLED = 6, 6, 3
WHOLE, PIECE = 60, 50
BLOCK_ITEMS = 10_000
WORDS = re.compile(r"\w+")
_FILTER_BITS = 22
_SEPARATOR = 0x5EED_0F_5EED


def allowed(n: int) -> int:
    """Edits that an item of n words may have."""
    return int(n * (1 - SIMILARITY) + 1e-9) if n >= 6 else 0


def pieces(n: int) -> list[tuple[int, int]]:
    """Offset and length of the pieces by which an item of n words is searched."""
    if n <= WHOLE:
        return [(0, n)]
    k = -(-n // PIECE)
    cuts = [n * i // k for i in range(k + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def distances(pattern: list[int], text: list[int]) -> list[int]:
    """For each end in text the least edit distance of pattern to a passage that ends there (bit-parallel, after Myers)."""
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    peq: dict[int, int] = defaultdict(int)
    for i, w in enumerate(pattern):
        peq[w] |= 1 << i
    pv, mv, score, out = full, 0, m, []
    for w in text:
        eq = peq.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (~(xh | pv) & full), pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = ph << 1 & full, mh << 1 & full
        pv, mv = mh | (~(xv | ph) & full), ph & xv
        out.append(score)
    return out


def best_passage(item: list[int], text: list[int]) -> tuple[int, int, int]:
    """distance, start, end of the nearest passage; the first of equals."""
    found = distances(item, text)
    least = min(found)
    end = found.index(least) + 1
    # Backwards from that end the whole passage is read, so its start is where the reversed item ends.
    back = _prefix_distances(item[::-1], text[:end][::-1], least)
    return least, end - back, end


def _prefix_distances(item: list[int], text: list[int], least: int) -> int:
    """Length of the shortest prefix of text whose edit distance to item is ``least``."""
    row = list(range(len(item) + 1))
    for n, w in enumerate(text[: len(item) + least], 1):
        new = [n]
        for i, x in enumerate(item):
            new.append(min(row[i] + (x != w), row[i + 1] + 1, new[i] + 1))
        row = new
        if row[-1] == least:
            return n
    return 0


class Index:
    """Items prepared for scanning in one worker."""

    def __init__(self, texts: list[str], seed: int = 11):
        self.hashes = Hashes()
        self.items = [self.words(t) for t in texts]
        self.short = self._short()
        used = [i for i, x in enumerate(self.items) if len(x) >= MIN_WORDS]
        #: Item, offset and length of each piece; classes name pieces.
        self.pieces = [(i, offset, n) for i in used for offset, n in pieces(len(self.items[i]))]
        self.classes: dict[int, list[int]] = defaultdict(list)
        lengths, n = [], MIN_WORDS
        longest = max((n for *_, n in self.pieces), default=0)
        while n <= longest:
            lengths.append(n)
            n = max(n + 1, int(n * 1.15))
        for k, (_, _, size) in enumerate(self.pieces):
            self.classes[max(x for x in lengths if x <= size)].append(k)
        triples = [self.triples(np.array(self.items[i], np.int64)) for i in used]
        self.grams = np.unique(np.concatenate(triples)) if triples else np.empty(0, np.uint64)
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[self.grams >> np.uint64(64 - _FILTER_BITS)] = True
        # A class has its own seed, so its walks don't depend on what other items a block has.
        rngs = {m: np.random.default_rng([seed, m]) for m in self.classes}
        self.walks = {m: [self._walk(rngs[m], m) for _ in range(WALKS)] for m in self.classes}
        self.keys = {m: self._keys(m) for m in self.classes}

    def words(self, text: str) -> list[int]:
        """Hashes of the words of a text, as signed numbers."""
        return np.fromiter(map(self.hashes.__getitem__, WORDS.findall(text.lower())), np.uint64).view(np.int64).tolist()

    def _short(self) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """For each length under MIN_WORDS the items' keys, ascending, and the items."""
        of: dict[int, list[int]] = defaultdict(list)
        for i, x in enumerate(self.items):
            if 0 < len(x) < MIN_WORDS:
                of[len(x)].append(i)
        out = {}
        for n, some in of.items():
            keys = np.array([self.runs(np.array(self.items[i], np.int64), n)[0] for i in some])
            order = np.argsort(keys, kind="stable")
            out[n] = keys[order], np.array(some)[order]
        return out

    @staticmethod
    def runs(ids: np.ndarray, n: int) -> np.ndarray:
        """A key of the n words from each place on."""
        h = np.zeros(len(ids) - n + 1, np.uint64)
        for i in range(n):
            h = (h ^ ids[i : i + len(h)].view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return h

    def short_matches(self, x: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """The first place in each text of each item under MIN_WORDS words."""
        out: dict[tuple[int, int], tuple[int, int, int, int, int]] = {}
        for n, (keys, items) in self.short.items():
            if len(x) < n:
                continue
            h = self.runs(x, n)
            low = np.searchsorted(keys, h)
            at = np.flatnonzero(keys[np.minimum(low, len(keys) - 1)] == h)
            docs = np.searchsorted(bounds, at, side="right")
            # The first place of each key in a text.
            first = np.unique(np.stack([docs, low[at]], axis=1), axis=0, return_index=True)[1] if len(at) else []
            for k in sorted(first):
                p, doc = int(at[k]), int(docs[k])
                begin = int(bounds[doc - 1]) if doc else 0
                for i in items[low[p] : np.searchsorted(keys, h[p], side="right")].tolist():
                    if x[p : p + n].tolist() == self.items[i]:
                        out.setdefault((doc, i), (doc, i, p - begin, p - begin + n, 0))
        return list(out.values())

    @staticmethod
    def triples(ids: np.ndarray) -> np.ndarray:
        x = ids.view(np.uint64)
        h = x[:-2] * np.uint64(0x9E3779B97F4A7C15) + x[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + x[2:] * np.uint64(0x165667B19E3779F9)
        return (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)

    @staticmethod
    def _walk(rng: np.random.Generator, m: int) -> tuple[np.ndarray, np.ndarray]:
        steps = 2 * m
        places = np.array([np.sort(rng.choice(steps, SAMPLED, replace=False)) for _ in range(SAMPLES)])
        return rng.integers(0, 1 << 63, steps, np.int64).view(np.uint64) | np.uint64(1), places

    @staticmethod
    def sampled(ids: np.ndarray, starts: np.ndarray, m: int, walk: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """One key for each start and sample set; ids must have m words from every start."""
        odd, places = walk
        x = ids.view(np.uint64)
        at = np.zeros(len(starts), np.int64)
        keys = np.zeros((len(places), len(starts)), np.uint64)
        for step in range(places.max() + 1):
            word = np.where(at < m, x[starts + np.minimum(at, m - 1)], np.uint64(_SEPARATOR))
            for k in np.flatnonzero((places == step).any(axis=1)):
                keys[k] = (keys[k] ^ word) * np.uint64(0x9E3779B97F4A7C15)
                keys[k] ^= keys[k] >> np.uint64(31)
            at += ((word * odd[step]) >> np.uint64(63)).astype(np.int64)
        return keys

    def _keys(self, m: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each walk and sample set the pieces' keys, ascending, and the pieces."""
        which = np.array(self.classes[m])
        ids = np.array([w for i, offset, _ in map(self.pieces.__getitem__, which) for w in self.items[i][offset : offset + m]], np.int64)
        out = []
        for walk in self.walks[m]:
            for keys in self.sampled(ids, np.arange(len(which)) * m, m, walk):
                order = np.argsort(keys, kind="stable")
                out.append((keys[order], which[order]))
        return out

    def windows(self, hits: np.ndarray, m: int, n: int, size: int) -> np.ndarray:
        """Starts of windows of m words in which an item of n words can begin, by the q-gram lemma over ``hits``."""
        d = allowed(n)
        least, span = max(1, n - 2 - 3 * d), n + d
        if len(hits) < least:
            return np.empty(0, np.int64)
        first, last = hits[: len(hits) - least + 1], hits[least - 1 :]
        near = last - first <= span - 3
        low, high = np.maximum(last[near] - span + 3, 0), np.minimum(first[near], size - m) + 1
        # Both ends ascend, so the union of these ranges is read off by where each passes the former ones.
        low = np.maximum(low, np.concatenate([[0], np.maximum.accumulate(high)[:-1]])[: len(low)])
        n_of = np.maximum(high - low, 0)
        return np.repeat(low - np.cumsum(n_of) + n_of, n_of) + np.arange(n_of.sum())

    def counts(self, item: int, text: str, start: int, end: int) -> bool:
        """Whether a match makes a document one to drop: a short item must be all of it."""
        return len(self.items[item]) >= MIN_WORDS or (start == 0 and end == len(WORDS.findall(text)))

    def scan(self, texts: list[str | None]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, start word, end word, distance) of every match."""
        ids: list[int] = []
        ends = []
        for t in texts:
            if t:
                ids.extend(map(self.hashes.__getitem__, WORDS.findall(t.lower())))
            ids.append(_SEPARATOR)
            ends.append(len(ids))
        # A window of the last text may reach beyond its end, as windows of others do.
        ids.extend([_SEPARATOR] * max(self.classes, default=0))
        x = np.array(ids, np.uint64).view(np.int64)
        short = self.short_matches(x, np.array(ends)) if self.short else []
        return sorted(short + self.long_matches(x, ends))

    def long_matches(self, x: np.ndarray, ends: list[int]) -> list[tuple[int, int, int, int, int]]:
        if len(x) < 3 or not len(self.grams):
            return []
        h = self.triples(x)
        hits = np.flatnonzero(self.filter[h >> np.uint64(64 - _FILTER_BITS)])
        at = np.minimum(np.searchsorted(self.grams, h[hits]), len(self.grams) - 1)
        hits = hits[self.grams[at] == h[hits]]
        if not len(hits):
            return []
        bounds = np.array(ends)
        found: dict[tuple[int, int], set[int]] = defaultdict(set)
        for m in self.classes:
            lengths = {self.pieces[k][2] for k in self.classes[m]}
            starts = np.unique(np.concatenate([self.windows(hits, m, n, len(x)) for n in lengths]))
            if not len(starts):
                continue
            tables = iter(self.keys[m])
            for walk in self.walks[m]:
                for keys in self.sampled(x, starts, m, walk):
                    known, items = next(tables)
                    low = np.searchsorted(known, keys)
                    same = np.flatnonzero(known[np.minimum(low, len(known) - 1)] == keys)
                    high = np.searchsorted(known, keys[same], side="right")
                    docs = np.searchsorted(bounds, starts[same], side="right")
                    for doc, p, i, j in zip(docs.tolist(), starts[same].tolist(), low[same].tolist(), high.tolist(), strict=True):
                        for k in items[i:j].tolist():
                            item, offset, _ = self.pieces[k]
                            found[doc, item].add(p - offset)
        out = []
        for (doc, i), places in found.items():
            item, d = self.items[i], allowed(len(self.items[i]))
            first, end = (ends[doc - 1] if doc else 0), ends[doc] - 1
            best: tuple[int, int, int] | None = None
            # Candidates that lie near each other are verified as one stretch of text.
            stretch: list[list[int]] = []
            for p in sorted(places):
                # Edits before and within a piece move the item's beginning, so pieces are given more room than whole items.
                before, after = (2 * d, 3 * d) if len(item) > WHOLE else (d, d)
                low, high = max(first, p - before), min(end, p + len(item) + after)
                if stretch and low <= stretch[-1][1]:
                    stretch[-1][1] = max(high, stretch[-1][1])
                elif low < high:
                    stretch.append([low, high])
            for low, high in stretch:
                text = x[low:high].tolist()
                if min(distances(item, text)) <= d:
                    distance, a, b = best_passage(item, text)
                    if best is None or distance < best[0]:
                        best = distance, a + low - first, b + low - first
            if best:
                out.append((doc, i, best[1], best[2], best[0]))
        return out


def _blocks(benchmark: DataFrame, block_items: int) -> Iterator[list]:
    """The items in blocks of about block_items rows."""
    items = benchmark.filter("text is not null").select("item_id", "text")
    n = -(-items.count() // block_items)
    for k in range(n):
        yield items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()


def find(docs: DataFrame, benchmark: DataFrame, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """doc_id, item_id, start_word, end_word (exclusive), distance, similarity of every item in every whole text."""
    doc_type, item_type = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {doc_type}, item_id {item_type}, start_word int, end_word int, distance int, similarity double"
    found = docs.sparkSession.createDataFrame([], schema)
    for items in _blocks(benchmark, block_items):
        shared = docs.sparkSession.sparkContext.broadcast([(r["item_id"], r["text"]) for r in items])

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names = pa.array([i for i, _ in shared.value])
            index = Index([t for _, t in shared.value])
            for part in (p for b in batches for p in slices(b, 1)):
                rows = np.array(index.scan(part.column(1).to_pylist()), np.int32).reshape(-1, 5)
                if len(rows):
                    n = np.array([len(index.items[i]) for i in rows[:, 1]])
                    columns = [part.column(0).take(pa.array(rows[:, 0])), names.take(pa.array(rows[:, 1]))]
                    columns += [pa.array(rows[:, k]) for k in (2, 3, 4)] + [pa.array(1 - rows[:, 4] / n)]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "start_word", "end_word", "distance", "similarity"])

        found = found.unionByName(docs.select("doc_id", "text").mapInArrow(run, schema))
    return found


def _clean(docs: DataFrame, shared: Broadcast) -> DataFrame:
    """The documents in which no item of shared is found."""

    def start():
        index = Index(shared.value)

        def passes(texts: list[str | None]) -> list[bool]:
            found = {doc for doc, item, start, end, _ in index.scan(texts) if index.counts(item, texts[doc], start, end)}
            return [i not in found for i in range(len(texts))]

        return passes

    return filter_texts(docs, start)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """The documents in which no item of MIN_WORDS words or more is found, and that are no shorter item; all columns stay as they are."""
    for items in _blocks(benchmark, block_items):
        docs = _clean(docs, docs.sparkSession.sparkContext.broadcast([r["text"] for r in items]))
    return docs


def op3(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return find(docs, benchmark)
