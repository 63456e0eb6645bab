"""LM scoring by context-tree weighting over bytes.

A byte is eight binary decisions, most significant bit first; the decisions made
so far are a node (1 to 255) of the byte's own tree. Every node has a context
tree over the last ``DEPTH`` bytes. A context of each depth has a
Krichevsky-Trofimov estimate of its bits, and its weighted probability mixes,
half and half, that estimate with the product of its longer contexts; so the
code length of a bit mixes the estimates of all depths along its context.

Counts cover every training text. Counting, the sums from long contexts to short
ones and the mixing down again are Spark aggregations and joins keyed by
(context, node). What goes to the tasks is bounded whatever the corpus: one row
of 256 log probabilities for each byte context of 0 to 2 bytes seen, and for the
most frequent ones of 3 bytes, ``MAX_CONTEXTS`` at most. Where a corpus has more, each
document's symbols after rarer contexts are counted and joined to the table of
those, which has what their own bits add to the mixture of 2.

The base score is a unigram model over all training tokens. Its counts are an
unbounded table, so only the most frequent words, ``HOT_WORDS`` at most, travel to
the tasks; each document's other words meet their counts in a join.

Defined results: null text is empty text, which has the end symbol only; a null
doc_id is scored and not learned from; without training texts every probability
of a bit is a half. Rows are scored one by one, repeated doc_ids and rows too.
Whole texts count, however long; a task has one slice of texts, bounded in bytes,
as Python objects. An empty table gives no rows. Only ``doc_id`` and ``text`` are
read, so other columns may have any names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadline.llm.common import crc_mod, cut, slices

DEPTH = 3
MAX_CONTEXTS = 16_384
HOT_WORDS = 200_000
#: A byte that UTF-8 never has: it ends a text, and stands before it.
END = 0xFF


def symbols(text: str | None) -> np.ndarray:
    """Three times END, the bytes with A-Z in lower case, END."""
    return np.frombuffer(b"\xff\xff\xff" + (text or "").encode().lower() + b"\xff", np.uint8).astype(np.uint32)


def contexts(s: np.ndarray) -> np.ndarray:
    """The three bytes before each symbol, the latest lowest."""
    return s[:-3] << 16 | s[1:-2] << 8 | s[2:-1]


def gram_counts(texts: DataFrame) -> DataFrame:
    """code (three bytes of context and the symbol), n: over every text."""

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        codes, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return codes, np.bincount(at, np.concatenate([p[1] for p in parts]), len(codes)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for part in (p for b in batches for p in slices(b, 0)):
            codes = [contexts(s) << 8 | s[3:] for s in map(symbols, part.column(0).to_pylist())]
            held.append(np.unique(np.concatenate(codes), return_counts=True))
            if len(held) == 16:
                held = [merged(held)]
        if held:
            codes, n = merged(held)
            yield pa.RecordBatch.from_arrays([pa.array(codes.astype(np.int64)), pa.array(n)], ["code", "n"])

    return texts.select("text").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def _lgamma(x: Column) -> Column:
    """Stirling's series at x + 8, brought back to x."""
    y = x + 8
    s = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    for i in range(8):
        s = s - F.log(x + i)
    return s


def _kt() -> Column:
    """Log of the estimated probability of all bits of a context."""
    return _lgamma(F.col("n0") + 0.5) + _lgamma(F.col("n1") + 0.5) - _lgamma(F.col("n0") + F.col("n1") + 1.0) - 2 * math.lgamma(0.5)


def _bits(symbol: Column) -> Column:
    """The node and bit of each decision of a symbol."""
    return F.array(*(
        F.struct(
            (F.lit(1 << k) + F.shiftright(symbol, 8 - k)).cast("int").alias("node"),
            F.shiftright(symbol, 7 - k).bitwiseAND(F.lit(1)).alias("bit"),
        )
        for k in range(8)
    ))


def levels(grams: DataFrame) -> list[DataFrame]:
    """For depths 0 to 3: context, node, estimate (of a 1) and stays (the weight of a context's own estimate)."""
    rows = grams.select(F.shiftright("code", 8).alias("context"), "n", F.explode(_bits(F.col("code") % 256)).alias("x"))
    level = rows.groupBy("context", F.col("x.node").alias("node")).agg(
        F.sum(F.when(F.col("x.bit") == 0, F.col("n")).otherwise(0)).cast("double").alias("n0"),
        F.sum(F.when(F.col("x.bit") == 1, F.col("n")).otherwise(0)).cast("double").alias("n1"),
    )
    level = cut(level.withColumn("weighted", _kt()).withColumn("longer", F.lit(0.0)).withColumn("own", F.col("weighted")))
    found = [level]
    for depth in range(DEPTH - 1, -1, -1):
        shorter = F.col("context").bitwiseAND(F.lit((1 << 8 * depth) - 1))
        level = level.groupBy(shorter.alias("context"), "node").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("weighted").alias("longer"))
        level = level.withColumn("own", _kt())
        most = F.greatest("own", "longer")
        level = cut(level.withColumn("weighted", most + F.log1p(F.exp(F.least("own", "longer") - most)) - math.log(2)))
        found.insert(0, level)
    stays = 1 / (1 + F.exp(F.col("longer") - F.col("own")))
    return [
        x.select("context", "node", ((F.col("n1") + 0.5) / (F.col("n0") + F.col("n1") + 1)).alias("estimate"), (F.lit(1.0) if d == DEPTH else stays).alias("stays"))
        for d, x in enumerate(found)
    ]


def mixed(level: list[DataFrame], depth: int) -> DataFrame:
    """context, node, p: the probability of a 1 where the context is known to this depth and no further."""
    own = F.col("estimate") * F.col("stays") + 0.5 * (1 - F.col("stays")) if depth < DEPTH else F.col("estimate")
    rows = level[depth].select("context", "node", own.alias("p"))
    for d in range(depth - 1, -1, -1):
        up = level[d].withColumnRenamed("context", "c")
        rows = rows.withColumn("c", F.col("context").bitwiseAND(F.lit((1 << 8 * d) - 1))).join(up, ["c", "node"])
        rows = rows.select("context", "node", (F.col("stays") * F.col("estimate") + (1 - F.col("stays")) * F.col("p")).alias("p"))
    return rows


@dataclass
class Tree:
    """rows: log10 probabilities of 256 symbols; at[d]: contexts of d bytes, ascending, whose rows follow each other from first[d]."""

    rows: np.ndarray
    at: list[np.ndarray]
    first: list[int]

    def row_of_context(self) -> np.ndarray:
        """For each of the 2^24 contexts the row of its longest known one."""
        known = np.zeros(1, np.int32)
        for d in range(1, DEPTH + 1):
            known = np.tile(known, 256)
            known[self.at[d]] = self.first[d] + np.arange(len(self.at[d]), dtype=np.int32)
        return known


def _paths() -> tuple[np.ndarray, np.ndarray]:
    s = np.arange(256)[:, None]
    k = np.arange(8)[None, :]
    return (1 << k) | (s >> (8 - k)), (s >> (7 - k)) & 1


def build(grams: DataFrame, max_contexts: int = MAX_CONTEXTS) -> Tree:
    return grow(grams, max_contexts)[0]


def most_frequent(counts: DataFrame, n: str, most: int) -> DataFrame:
    """The rows of counts with the greatest n, as many as there are from a power of two on but ``most`` at most.

    A histogram of powers finds the limit, so no task sorts or gathers rows.
    """
    sizes = {r["k"]: r["count"] for r in counts.groupBy(F.floor(F.log2(n)).alias("k")).count().collect()}
    total, least = 0, max(sizes, default=0) + 1
    while least > 0 and total + sizes.get(least - 1, 0) <= most:
        least -= 1
        total += sizes.get(least, 0)
    return counts.filter(F.floor(F.log2(n)) >= least)


def _rare(level: list[DataFrame], kept: DataFrame) -> DataFrame:
    """context, node, zero, one: what a bit of a context of full depth that is not kept adds to its log probability by the next shorter one.

    A node that a context has had, its shorter contexts have had too.
    """
    long = mixed(level, DEPTH).join(F.broadcast(kept), "context", "left_anti").withColumn("c", F.col("context").bitwiseAND(F.lit((1 << 8 * (DEPTH - 1)) - 1)))
    both = long.join(mixed(level, DEPTH - 1).select(F.col("context").alias("c"), "node", F.col("p").alias("q")), ["c", "node"])
    return both.select("context", "node", (F.log10(1 - F.col("p")) - F.log10(1 - F.col("q"))).alias("zero"), (F.log10("p") - F.log10("q")).alias("one"))


def grow(grams: DataFrame, max_contexts: int = MAX_CONTEXTS) -> tuple[Tree, DataFrame | None]:
    """The tree that goes to the tasks, and a table of the contexts it has no room for, if any."""
    level = levels(grams)
    by_context = grams.groupBy(F.shiftright("code", 8).alias("context")).agg(F.sum("n").alias("n"))
    kept = cut(most_frequent(by_context, "n", max_contexts).select("context"))
    rare = cut(_rare(level, kept)) if by_context.count() > max_contexts else None
    nodes, bits = _paths()
    rows, at, first, inherited = [], [], [], np.full((1, 256), 0.5)
    known = np.zeros(1, np.int64)
    for d in range(DEPTH + 1):
        part = mixed(level, d)
        if d == DEPTH:
            part = part.join(F.broadcast(kept), "context")
        table = part.toArrow()
        context, node, p = (table.column(c).to_numpy() for c in ("context", "node", "p"))
        own, place = np.unique(context, return_inverse=True)
        own = own.astype(np.int64)
        if d == 0:
            probability = inherited.copy()
            own = np.zeros(1, np.int64)
            place = np.zeros(len(context), np.int64)
        else:
            # A node that a context never had is as in the next shorter context, which has been seen.
            probability = inherited[np.searchsorted(known, own & ((1 << 8 * (d - 1)) - 1))]
        probability[place, node] = p
        logs = np.zeros(probability.shape, np.float32)
        for k in range(0, len(logs), 512):
            chosen = probability[k : k + 512, nodes]
            logs[k : k + 512] = np.log10(np.where(bits, chosen, 1 - chosen)).sum(axis=2)
        first.append(sum(map(len, rows)))
        rows.append(logs)
        at.append(own)
        known, inherited = own, probability
    return Tree(np.concatenate(rows), at, first), rare


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in (p for b in batches for p in slices(b, 0, 10_000, 1 << 25)):
        counts: Counter = Counter()
        for text in part.column(0).to_pylist():
            counts.update((text or "").encode().lower().split())
        yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], ["word", "c"])


@dataclass
class Model:
    tree: Tree
    rare: DataFrame | None
    counts: DataFrame
    hot: dict[bytes, int]
    n: int
    v: int
    ends: int


def fit(texts: DataFrame, hot_words: int = HOT_WORDS, max_contexts: int = MAX_CONTEXTS) -> Model:
    """Learn from every text of texts."""
    counts = cut(texts.select("text").mapInArrow(_word_counts, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")))
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    ends = texts.count()
    hot = most_frequent(counts, "c", hot_words).toArrow()
    words = dict(zip(hot.column("word").to_pylist(), hot.column("c").to_pylist(), strict=True))
    return Model(*grow(cut(gram_counts(texts)), max_contexts), counts, words, n + ends, v + (ends > 0), ends)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score, n_bytes of every whole text; n_bytes counts the end."""
    shared = docs.sparkSession.sparkContext.broadcast((model.tree, model.hot))
    below = math.log10(model.n + model.v + 1)
    end = math.log10(model.ends + 1) - below, int(model.ends > 0)
    has_rare = model.rare is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, hot = shared.value
        row_of = tree.row_of_context()
        logs = {w: math.log10(c + 1) - below for w, c in hot.items()}
        for part in (p for b in batches for p in slices(b, 1)):
            out: list[tuple] = []
            for text in part.column(1).to_pylist():
                s = symbols(text)
                words = (text or "").encode().lower().split()
                known = [logs[w] for w in words if w in logs]
                cold = Counter(w for w in words if w not in logs) if len(known) < len(words) else {}
                before = contexts(s)
                at_row = row_of[before]
                total = float(tree.rows[at_row, s[3:]].sum(dtype=np.float64))
                rare: list[tuple[int, int]] = []
                if has_rare:
                    some = at_row < tree.first[DEPTH]
                    codes, k = np.unique(before[some] << 8 | s[3:][some], return_counts=True)
                    rare = list(zip(codes.tolist(), k.tolist(), strict=True))
                out.append((len(s) - 3, len(words) + 1, len(known) + end[1], math.fsum(known) + end[0], total, list(cold.items()), rare))
            types = pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.struct([("word", pa.binary()), ("k", pa.int64())])), pa.list_(pa.struct([("code", pa.int64()), ("k", pa.int64())]))
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["doc_id", "n_bytes", "n_tokens", "hot_known", "hot_score", "score", "cold", "rare"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {id_type}, n_bytes long, n_tokens long, hot_known long, hot_score double, score double, cold array<struct<word:binary,k:long>>, rare array<struct<code:long,k:long>>"
    )
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    cold = rows.select("row", F.explode("cold").alias("x")).select("row", "x.word", "x.k")
    met = cold.join(model.counts, "word", "left").groupBy("row").agg(
        F.sum(F.col("k") * (F.log10(F.coalesce("c", F.lit(0)) + 1) - below)).alias("cold_score"),
        F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("cold_known"),
    )
    scored = rows.drop("cold", "rare").join(met, "row", "left")
    if has_rare:
        counted = rows.select("row", F.explode("rare").alias("x")).select("row", "x.k", F.shiftright("x.code", 8).alias("context"), F.explode(_bits(F.col("x.code") % 256)).alias("y"))
        added = counted.select("row", "k", "context", "y.node", "y.bit").join(model.rare, ["context", "node"]).groupBy("row").agg(
            F.sum(F.col("k") * F.when(F.col("bit") == 1, F.col("one")).otherwise(F.col("zero"))).alias("rare_score")
        )
        scored = scored.join(added, "row", "left").withColumn("score", F.col("score") + F.coalesce("rare_score", F.lit(0.0)))
    return scored.select(
        "doc_id",
        "n_tokens",
        (F.col("hot_known") + F.coalesce("cold_known", F.lit(0))).alias("n_known"),
        F.lit(int(model.n)).cast("long").alias("train_tokens"),
        (F.col("hot_score") + F.coalesce("cold_score", F.lit(0.0))).alias("base_score"),
        "score",
        "n_bytes",
    )


def op9(docs: DataFrame) -> DataFrame:
    model = fit(docs.filter(crc_mod("doc_id", 7) != 2).select("text"))
    scored = score(docs, model)
    bits = -F.col("score") / math.log10(2)
    return scored.select(
        "doc_id", F.coalesce(crc_mod("doc_id", 7) == 2, F.lit(False)).alias("held_out"),
        "n_tokens", "n_known", "train_tokens", "base_score", "score", bits.alias("code_bits"), (bits / F.col("n_bytes")).alias("bits_per_byte"),
    )
