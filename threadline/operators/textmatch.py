"""Weighted text similarity as joins: n-grams, TF-IDF, cosine; counts of equal texts; classifier scores."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadline.functions.columns import c, let
from threadline.operators.asof import running_sum
from threadline.functions.text import TOKEN, normalise
from threadline.functions.text import words as tokens_of
from threadline.sources.stage import staged

#: Characters of the pairs of a block, texts that are Python objects at once, and grams that a task counts before it hands them on.
BLOCK, TEXTS, HELD = 1 << 20, 200, 1 << 19


def word_runs(words: Column | str, longest: int = 2) -> Column:
    """Words and runs of words, repeats included."""
    def runs(words: Column, n: int) -> Column:
        place = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(place, lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))

    return let(c(words), lambda w: F.concat(w, *(runs(w, n) for n in range(2, longest + 1))))


def word_grams(text: Column | str, longest: int = 2) -> Column:
    """Words and runs of words of a normalised text, repeats included."""
    return word_runs(tokens_of(text), longest)


def char_runs(normalised: Column | str, *sizes: int) -> Column:
    """Runs of so many characters inside the words of a normalised text, words padded by a space on both sides."""

    def of_size(words: Column, n: int) -> Column:
        def cut(padded: Column) -> Column:
            size = F.char_length(padded)
            return F.when(size >= n, F.transform(F.sequence(F.lit(1), size - (n - 1)), lambda i: F.substr(padded, i, F.lit(n)))).otherwise(F.array(padded))

        return F.transform(words, lambda w: let(F.concat(F.lit(" "), w, F.lit(" ")), cut))

    return let(F.filter(F.split(c(normalised), " "), lambda w: w != ""), lambda words: F.flatten(F.concat(*(of_size(words, n) for n in sizes))))


def char_grams(text: Column | str, n: int) -> Column:
    """Runs of n characters inside words, words padded by a space on both sides."""
    return char_runs(normalise(text), n)


def tfidf(texts: DataFrame, row_id: str, grams: Column, min_df: int = 1) -> DataFrame:
    """row_id, gram, weight: (1 + ln tf) (ln((1 + n) / (1 + df)) + 1), scaled to length 1.

    Rows are dealt by their id before they become grams, so that counting
    within rows moves texts and not grams. Document frequencies are a grouped
    count with map-side sums; a frequent gram is one row of the frequency
    table, and the join to it may be split.
    """
    n = texts.select(row_id).count()
    dealt = texts.repartition(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), row_id)
    tf = dealt.select(F.col(row_id), F.explode(grams).alias("gram")).groupBy(row_id, "gram").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") >= min_df)
    raw = tf.join(df, "gram").withColumn("w", (1 + F.log("tf")) * (F.log((1.0 + n) / (1.0 + F.col("df"))) + 1))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(row_id)))
    return raw.select(row_id, "gram", (F.col("w") / length).alias("weight"))


def cosine(pairs: DataFrame, weights: DataFrame, left: str, right: str, row_id: str) -> DataFrame:
    """pairs with cosine: shared grams meet within each pair, so no all-pairs product is made."""
    a = weights.select(F.col(row_id).alias(left), "gram", F.col("weight").alias("wa"))
    b = weights.select(F.col(row_id).alias(right), "gram", F.col("weight").alias("wb"))
    keys = pairs.select(left, right).distinct()
    dots = keys.join(a, left).join(b, [right, "gram"]).groupBy(left, right).agg(F.sum(F.col("wa") * F.col("wb")).alias("cosine"))
    return pairs.join(dots, [left, right], "left").withColumn("cosine", F.coalesce("cosine", F.lit(0.0)))


class CharRuns:
    """What ``char_runs`` gives, of Python's texts: units that repeat, and the grams of a unit."""

    def __init__(self, *sizes: int):
        self.sizes = sizes

    def units(self, text: str) -> list[str]:
        return [w for w in text.split(" ") if w]

    def grams(self, unit: str) -> list[str]:
        x = f" {unit} "
        return [g for n in self.sizes for g in ([x[i : i + n] for i in range(len(x) - n + 1)] if len(x) >= n else [x])]


class WordRuns:
    """What ``word_runs`` gives of the tokens of a normalised text; each run is a unit."""

    def __init__(self, longest: int):
        self.longest = longest

    def units(self, text: str) -> list[str]:
        words = re.findall(TOKEN, text)
        return [" ".join(words[i : i + n]) for n in range(1, self.longest + 1) for i in range(len(words) - n + 1)]

    def grams(self, unit: str) -> list[str]:
        return [unit]


Kinds = dict[str, tuple[CharRuns | WordRuns, int]]


def _gram_set(kind: CharRuns | WordRuns, texts: list[str]) -> set[str]:
    return {g for u in {u for x in texts for u in kind.units(x)} for g in kind.grams(u)}


def _lists(batch: pa.RecordBatch, *columns: int) -> Iterator[tuple]:
    """Values of some columns row by row, of which few are Python objects at once."""
    for k in range(0, batch.num_rows, TEXTS):
        yield from zip(*(batch.column(c).slice(k, TEXTS).to_pylist() for c in columns), strict=True)


def _frequencies(rows: DataFrame, kinds: Kinds) -> DataFrame:
    """kind, gram, df: in how many rows (texts) a gram is, if in enough of them and in two at least; counted in the tasks before it moves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def counted() -> pa.RecordBatch:
            names, grams = zip(*found, strict=True)
            out = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(grams, pa.string()), pa.array(list(found.values()), pa.int64())], ["kind", "gram", "n"])
            found.clear()
            return out

        for batch in batches:
            for (texts,) in _lists(batch, 0):
                for name, (kind, _) in kinds.items():
                    found.update((name, g) for g in _gram_set(kind, texts))
                if len(found) >= HELD:
                    yield counted()
        if found:
            yield counted()

    counts = rows.select("texts").mapInArrow(run, "kind string, gram string, n long").groupBy("kind", "gram").agg(F.sum("n").alias("df"))
    least = F.create_map(*(F.lit(x) for name, (_, min_df) in kinds.items() for x in (name, max(min_df, 2))))
    return counts.filter(F.col("df") >= least[F.col("kind")])


def _block_grams(blocked: DataFrame, left: str, right: str, kinds: Kinds) -> DataFrame:
    """block, kind, gram: the grams of each block's texts. A block that two tasks read may have some twice, which the join keeps: the last number of a gram counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last, found = None, None, {name: set() for name in kinds}

        def parts() -> Iterator[pa.RecordBatch]:
            for name, grams in found.items():
                if grams:
                    yield pa.RecordBatch.from_arrays([pa.array([now] * len(grams), pa.int64()), pa.array([name] * len(grams)), pa.array(list(grams))], ["block", "kind", "gram"])
                    grams.clear()

        for batch in batches:
            for block, i, j, left, right in _lists(batch, 0, 1, 2, 3, 4):
                if block != now:
                    yield from parts()
                    now, last = block, None
                texts = right if i == last else left + right
                last = j
                for name, (kind, _) in kinds.items():
                    found[name] |= _gram_set(kind, texts)
        yield from parts()

    return blocked.select("block", left, right, "left_texts", "right_texts").mapInArrow(run, "block long, kind string, gram string")


class _Weights:
    """Weights of the grams of texts, of one kind, by the frequencies of a block's grams; those without one are in one row."""

    def __init__(self, kind: CharRuns | WordRuns, min_df: int, grams: list[str], df: np.ndarray, n: int):
        self.kind, self.once, self.at = kind, min_df <= 1, dict(zip(grams, range(1, len(grams) + 1), strict=True))
        # Numbers beyond these are of grams in one row; the first value is theirs.
        self.idf = np.log((1.0 + n) / (1.0 + np.concatenate([[1], df]))) + 1
        self.known: dict[str, np.ndarray] = {}
        self.new = count(len(self.idf))

    def ids(self, unit: str) -> np.ndarray:
        if (out := self.known.get(unit)) is None:
            grams = self.kind.grams(unit)
            ids = [self.at.setdefault(g, next(self.new)) for g in grams] if self.once else [i for g in grams if (i := self.at.get(g))]
            out = self.known[unit] = np.array(ids, np.int64)
        return out

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the grams, ascending, and their weights, of length 1."""
        units = Counter(u for x in texts for u in self.kind.units(x))
        parts = [self.ids(u) for u in units]
        if not sum(map(len, parts)):
            return np.empty(0, np.int64), np.empty(0)
        times = np.repeat(np.fromiter(units.values(), np.int64, len(units)), [len(p) for p in parts])
        grams, at = np.unique(np.concatenate(parts), return_inverse=True)
        w = (1 + np.log(np.bincount(at, times))) * self.idf[np.where(grams < len(self.idf), grams, 0)]
        return grams, w / np.sqrt((w * w).sum())

    def cosines(self, pairs: Iterator[tuple]) -> Iterator[float]:
        """Of pairs (left id, right id, their texts); a row that was the right of one pair and is the left of the next is taken once."""
        last, b = None, None
        for i, j, left, right in pairs:
            a = b if i == last else self.of(left)
            last, b = j, self.of(right)
            _, x, y = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
            yield float(a[1][x] @ b[1][y])


def cosines(pairs: DataFrame, texts: DataFrame, left: str, right: str, row_id: str, text: str, kinds: Kinds, near: Column | None = None) -> DataFrame:
    """pairs with a column for each of kinds (name: grams, least frequency): the cosine that ``cosine`` of ``tfidf`` gives.

    Texts move, and grams don't: a block of pairs, of about ``BLOCK`` characters,
    has both texts of each, and each gram of the block is looked up once for the
    whole block. What is written grows with the texts and with the different
    grams of blocks, not with the grams of rows; a task holds one block. Pairs
    that agree in ``near`` share a block: few of them must, and it's best if they
    have rows in common.
    """
    n = texts.select(row_id).count()
    rows = staged(texts.groupBy(row_id).agg(F.collect_list(text).alias("texts")), True)
    size = F.aggregate("texts", F.lit(0).cast("long"), lambda a, x: a + F.char_length(x))
    n_blocks = 2 * (rows.agg(F.sum(size)).first()[0] or 0) // BLOCK + 1
    sides = [rows.select(F.col(row_id).alias(side), F.col("texts").alias(f"{name}_texts")) for side, name in ((left, "left"), (right, "right"))]
    met = pairs.select(left, right).distinct().join(sides[0], left).join(sides[1], right)
    block = F.pmod(F.xxhash64(left, right) if near is None else F.xxhash64(near), F.lit(n_blocks))
    blocked = staged(met.withColumn("block", block).repartition("block").sortWithinPartitions("block", left, right), True)
    known = _block_grams(blocked, left, right, kinds).join(_frequencies(rows, kinds), ["kind", "gram"])

    def run(some: pa.Table, grams: pa.Table) -> pa.Table:
        columns = {}
        for name, (kind, min_df) in kinds.items():
            mine = grams.filter(pc.equal(grams["kind"], name))
            weights = _Weights(kind, min_df, mine["gram"].to_pylist(), mine["df"].to_numpy(), n)
            of = (row for b in some.to_batches() for row in _lists(b, *map(b.schema.get_field_index, (left, right, "left_texts", "right_texts"))))
            columns[name] = pa.array(list(weights.cosines(of)), pa.float64())
        return pa.table({left: some[left], right: some[right], **columns})

    ids = [f"{side} {met.schema[side].dataType.simpleString()}" for side in (left, right)]
    out = blocked.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(run, ", ".join([*ids, *(f"{name} double" for name in kinds)]))
    return pairs.join(out, [left, right], "left").withColumns({name: F.coalesce(name, F.lit(0.0)) for name in kinds})


def repeated_texts(df: DataFrame, text: Column, least: int = 2) -> DataFrame:
    """Digest and count of normalised texts that occur at least so often."""
    return df.groupBy(F.sha2(text, 256).alias("digest")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the ROC curve from the rank sum, ties at their mean rank, over scores in ranges."""
    counted = df.groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))
    won = running_sum(counted, "s", "neg", "below").withColumn("won", F.col("pos") * (F.col("below") + F.col("neg") / 2))
    return won.agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.try_divide(F.sum("won"), (F.sum("pos") * F.sum("neg")).cast("double")).alias("auc"))


def average_precision(df: DataFrame, score: str, label: str) -> DataFrame:
    """n, average precision (each score's gain in recall at its precision; equal scores are one step) and the Brier score."""
    counted = df.groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count(F.lit(1)).alias("n"))
    below = running_sum(counted, "s", "pos", "pos_below").select("s", "pos", "n", "pos_below").join(running_sum(counted, "s", "n", "n_below").select("s", "n_below"), "s")
    all_ = df.agg(F.count_if(F.col(label) == 1).alias("all_pos"), F.count(F.lit(1)).alias("all_n"), F.avg(F.pow(F.col(score) - F.col(label), F.lit(2))).alias("brier")).withColumn("one", F.lit(1))
    steps = below.withColumn("one", F.lit(1)).join(F.broadcast(all_), "one")
    gain = F.col("pos") / F.col("all_pos") * (F.col("all_pos") - F.col("pos_below")) / (F.col("all_n") - F.col("n_below"))
    return steps.agg(F.max("all_n").alias("n"), F.sum(gain).alias("average_precision"), F.max("brier").alias("brier"))


def signed_rank(df: DataFrame, contrast: str) -> DataFrame:
    """n, rank sum of positive contrasts and its z: zeros are left out, equal sizes share their mean rank."""
    sizes = df.filter(F.col(contrast) != 0).groupBy(F.abs(contrast).alias("a")).agg(F.count(F.lit(1)).alias("t"), F.count_if(F.col(contrast) > 0).alias("up"))
    ranked = running_sum(sizes, "a", "t", "below")
    n, t = F.col("n").cast("double"), F.col("t").cast("double")
    sums = ranked.agg(F.sum("t").alias("n"), F.sum(F.col("up") * (F.col("below") + (t + 1) / 2)).alias("w_plus"), F.sum(t * t * t - t).alias("tied"))
    spread = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("tied") / 48)
    return sums.select("n", "w_plus", F.try_divide(F.col("w_plus") - n * (n + 1) / 4, spread).alias("z"))


def precision_recall(df: DataFrame, score: str, label: str, thresholds: list[float]) -> DataFrame:
    each = df.withColumn("threshold", F.explode(F.array(*(F.lit(float(x)) for x in thresholds))))
    hit, true = F.col(score) >= F.col("threshold"), F.col(label) == 1
    return each.groupBy("threshold").agg(
        F.count_if(hit & true).alias("tp"), F.count_if(hit & ~true).alias("fp"), F.count_if(~hit & true).alias("fn"),
        F.try_divide(F.count_if(hit & true).cast("double"), F.count_if(hit).cast("double")).alias("precision"),
        F.try_divide(F.count_if(hit & true).cast("double"), F.count_if(true).cast("double")).alias("recall"),
    )


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """Observed agreement, agreement by chance and Cohen's kappa of two labellings."""
    cells = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    every = Window.partitionBy(F.lit(0))
    total = cells.select("a", "b", (F.col("n") / F.sum("n").over(every)).alias("p"))
    rows = total.groupBy(F.col("a").alias("k")).agg(F.sum("p").alias("pa"))
    columns = total.groupBy(F.col("b").alias("k")).agg(F.sum("p").alias("pb"))
    chance = rows.join(columns, "k").agg(F.coalesce(F.sum(F.col("pa") * F.col("pb")), F.lit(0.0)).alias("chance"))
    seen = total.agg(F.coalesce(F.sum(F.when(F.col("a") == F.col("b"), F.col("p"))), F.lit(0.0)).alias("observed"))
    return seen.crossJoin(chance).withColumn("kappa", F.try_divide(F.col("observed") - F.col("chance"), 1 - F.col("chance")))


def blend(parts: dict[str, float]) -> Column:
    """Weighted sum of score columns."""
    return sum((c(k) * w for k, w in parts.items()), F.lit(0.0))
