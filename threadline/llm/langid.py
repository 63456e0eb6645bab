"""Language ID by words first, then by ever shorter character n-grams.

Training counts words per language over a bounded sample of labelled rows: of
each language about ``max_train_docs`` distinct texts, those of least hash. All
their words, and all n-grams of 5 to 1 characters of these, are the model: the
sample bounds it, and nothing of it is cut. A word that the model knows adds its
log frequency in each language. An unseen word falls back: the mean log frequency
of its known 5-grams, or where none is known of its 4-grams, and so on; a word
without one known n-gram adds nothing. Scores are kept sparsely: a default for
each language, and what was seen beyond it; so the model grows with what was
learned, not with words times languages, and over ``MAX_ENTRIES`` of them raise.

Defined results: ``und`` with score 0 for null text, text without a letter (a
character of Unicode category L: digits, fractions and circled numbers are none),
or where nothing was learned; ties go to the language that sorts first. Null
labels and null doc_ids are not learned from; equal texts of a language count
once. Labels, source and doc_id never enter a prediction. Rows are predicted one
by one, repeated ones too, over whole texts however long; a task has one slice of
texts, bounded in bytes, as Python objects. An empty table gives no rows. Only
doc_id, text and lang are read, so other columns may have any names.
Score: the posterior over languages, log frequencies divided by the square root
of the number of words, since words of a text are not independent.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadline.llm.common import crc_mod, cut, filter_texts, slices

#: Distinct texts of each language that are learned from.
MAX_TRAIN_DOCS = 1_000
#: Languages, and entries (words or grams by language) that a model may have: it is held by the driver and by each worker. More raise.
MAX_LANGS, MAX_ENTRIES = 2_000, 50_000_000
ORDERS = (5, 4, 3, 2, 1)
#: A word: a letter, with the letters and marks that follow.
WORDS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
#: Unseen words kept with their scores in one worker, and numbers added up at once.
MEMO, AT_ONCE = 50_000, 1 << 22


def grams(word: str, n: int) -> list[str]:
    w = f"^{word}$"
    return [w[i : i + n] for i in range(len(w) - n + 1)]


class Scores:
    """Rows of scores by language: a default for each language, and what a row has beyond it where it has been seen.

    Row i has the entries ``at[i]`` to ``at[i + 1]``: a language's number and what it adds. So memory follows what was
    seen, not rows times languages. Where a full table takes about as much (few languages, whose words are shared), a
    worker makes one, as its sums are faster.
    """

    def __init__(self, default: np.ndarray, at: np.ndarray, lang: np.ndarray, extra: np.ndarray):
        self.default, self.at, self.lang, self.extra = default, at, lang, extra
        self.table: np.ndarray | None = None

    def __reduce__(self):
        return Scores, (self.default, self.at, self.lang, self.extra)

    def full(self) -> np.ndarray | None:
        rows, langs = len(self), len(self.default)
        if self.table is None and rows and rows * langs <= 4 * len(self.extra):
            self.table = np.tile(self.default, (rows, 1))
            self.table[np.repeat(np.arange(rows), np.diff(self.at)), self.lang] += self.extra
        return self.table

    @staticmethod
    def of(table: np.ndarray) -> Scores:
        """A full table."""
        rows, langs = table.shape
        return Scores(np.zeros(langs), np.arange(rows + 1) * langs, np.tile(np.arange(langs, dtype=np.int32), rows), table.reshape(-1).astype(float))

    def __len__(self) -> int:
        return len(self.at) - 1

    def sums(self, rows: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
        """Sums of the scores of rows in each group (a number for each row, ascending)."""
        if (table := self.full()) is not None:
            return _summed(table, rows, group, groups)
        n = self.at[rows + 1] - self.at[rows]
        entry = np.arange(n.sum()) + np.repeat(self.at[rows] - np.cumsum(n) + n, n)
        langs = len(self.default)
        added = np.bincount(np.repeat(group, n) * langs + self.lang[entry], weights=self.extra[entry], minlength=groups * langs)
        return added.reshape(groups, langs) + np.bincount(group, minlength=groups)[:, None] * self.default

    def mean(self, rows: list[int]) -> np.ndarray:
        if (table := self.full()) is not None:
            return table[rows].mean(axis=0)
        return self.sums(np.array(rows), np.zeros(len(rows), np.int64), 1)[0] / len(rows)


def _summed(table: np.ndarray, rows: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """Sums of a table's rows in each group, whose numbers ascend; so many numbers at once."""
    sums = np.zeros((groups, table.shape[1]))
    step = max(1, AT_ONCE // table.shape[1])
    for i in range(0, len(rows), step):
        first = np.flatnonzero(np.diff(group[i : i + step], prepend=-1))
        sums[group[i + first]] += np.add.reduceat(table[rows[i : i + step]], first, axis=0)
    return sums


class Model(dict):
    """Word -> its row of scores: rows of known words, then those of unseen words, which are worked out when met."""

    def __init__(self, langs: list[str], words: dict[str, int] | None = None, grams: dict[str, int] | None = None, word_scores: Scores | np.ndarray | None = None, gram_scores: Scores | np.ndarray | None = None):
        super().__init__(words or {})
        self.langs, self.grams = langs, grams or {}
        none = np.zeros((0, len(langs)))
        self.word_scores, self.gram_scores = (x if isinstance(x, Scores) else Scores.of(none if x is None else x) for x in (word_scores, gram_scores))
        self.memo: list[str] = []
        self.memo_scores = np.zeros((1024, len(langs)))
        #: Unseen words that are kept, so that their rows stay within bounds however many languages there are.
        self.most = max(1024, min(MEMO, AT_ONCE // max(len(langs), 1)))

    def __reduce__(self):
        return Model, (self.langs, {w: i for w, i in self.items() if i < len(self.word_scores)}, self.grams, self.word_scores, self.gram_scores)

    def unseen(self, word: str) -> np.ndarray:
        for n in ORDERS:
            found = [g for g in map(self.grams.get, grams(word, n)) if g is not None]
            if found:
                return self.gram_scores.mean(found)
        return np.zeros(len(self.langs))

    def __missing__(self, word: str) -> int:
        k = len(self.memo)
        if k == len(self.memo_scores):
            self.memo_scores = np.concatenate([self.memo_scores, np.zeros_like(self.memo_scores)])
        self.memo_scores[k] = self.unseen(word)
        self.memo.append(word)
        self[word] = len(self.word_scores) + k
        return self[word]

    def totals(self, rows: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Sums of the scores of rows from each of ``begins`` on."""
        group = np.repeat(np.arange(len(begins)), np.diff(begins, append=len(rows)))
        known = rows < len(self.word_scores)
        new = ~known
        return self.word_scores.sums(rows[known], group[known], len(begins)) + _summed(self.memo_scores, rows[new] - len(self.word_scores), group[new], len(begins))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and score of each text."""
        out = [("und", 0.0)] * len(texts)
        if not self.langs or not len(self.word_scores):
            return out
        for begin in range(0, len(texts), max(1, AT_ONCE // len(self.langs))):
            self._predict(texts[begin : begin + max(1, AT_ONCE // len(self.langs))], begin, out)
        return out

    def _rows(self, text: str) -> np.ndarray:
        if len(self.memo) > self.most:
            for w in self.memo:
                del self[w]
            self.memo = []
        return np.fromiter(map(self.__getitem__, WORDS.findall(text.lower())), np.int64)

    def _predict(self, texts: list[str | None], begin: int, out: list[tuple[str, float]]) -> None:
        sums, sizes, some = [], [], []
        held: list[np.ndarray] = []
        n_held = 0

        def add() -> None:
            if held:
                n = np.array([len(r) for r in held])
                sums.append(self.totals(np.concatenate(held), np.cumsum(n) - n))
                held.clear()

        for i, t in enumerate(texts):
            # words' rows are numbers of this memory, so they are added up before it may be emptied
            if len(self.memo) > self.most or n_held > AT_ONCE // 4:
                add()
                n_held = 0
            rows = self._rows(t) if t else ()
            if len(rows):
                some.append(begin + i)
                sizes.append(len(rows))
                held.append(rows)
                n_held += len(rows)
        add()
        if some:
            found = np.concatenate(sums)
            best = found.argmax(axis=1)
            odds = np.exp((found - found.max(axis=1)[:, None]) / np.sqrt(sizes)[:, None])
            for i, k, p in zip(some, best.tolist(), (1 / odds.sum(axis=1)).tolist(), strict=True):
                out[i] = self.langs[k], p


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in (p for b in batches for p in slices(b, 1)):
        counts: dict[str, Counter] = {}
        for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
            counts.setdefault(lang, Counter()).update(WORDS.findall(text.lower()))
        rows = [(lang, w, n) for lang, c in counts.items() for w, n in c.items()]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else ((), (), ()), (pa.string(), pa.string(), pa.int64()), strict=True)], ["lang", "gram", "n"])


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: Counter = Counter()
        for lang, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for k in ORDERS:
                for g in grams(word, k):
                    counts[lang, g] += n
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.string()), pa.array(counts.values(), pa.int64())], ["lang", "gram", "n"]
        )


def _table(counts: DataFrame, langs: list[str], most: int) -> tuple[dict[str, int], Scores]:
    """Rows of the grams, and the log share that each has of a language; a gram that a language lacks has the language's default."""
    if counts.limit(most + 1).count() > most:
        raise ValueError(f"over {most} words or grams by language: learn from fewer texts of each language")
    table = counts.toArrow()
    gram = pc.dictionary_encode(table.column("gram")).combine_chunks()
    lang = pc.index_in(table.column("lang"), pa.array(langs, pa.string())).to_numpy().astype(np.int32)
    row, n = gram.indices.to_numpy(), table.column("n").to_numpy().astype(float)
    rows = len(gram.dictionary)
    size = np.bincount(lang, weights=n, minlength=len(langs)) + 0.5 * rows + 1
    order = np.argsort(row, kind="stable")
    scores = Scores(np.log(0.5 / size), np.concatenate([[0], np.cumsum(np.bincount(row, minlength=rows))]), lang[order], np.log((n[order] + 0.5) / 0.5))
    return {g: i for i, g in enumerate(gram.dictionary.to_pylist())}, scores


def train_sample(labelled: DataFrame, max_train_docs: int = MAX_TRAIN_DOCS) -> DataFrame:
    """lang, text: of each language about max_train_docs distinct texts, those of least hash; all of a language that has fewer."""
    labelled = labelled.filter("lang is not null and text is not null").select("lang", "text", F.pmod(F.xxhash64("text"), F.lit(1 << 40)).alias("h"))
    shares = labelled.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")).select("lang", F.least(F.lit(1.0), F.lit(float(max_train_docs)) / F.greatest("n", F.lit(1))).alias("share"))
    # One row for each language, as the model has a column for each: texts are not shuffled by language.
    drawn = labelled.join(F.broadcast(shares), "lang").filter((F.col("share") == 1) | (F.col("h") < F.col("share") * float(1 << 40)))
    return drawn.dropDuplicates(["lang", "text"]).select("lang", "text")


def fit(labelled: DataFrame, max_train_docs: int = MAX_TRAIN_DOCS) -> Model:
    """labelled: lang, text."""
    words = cut(train_sample(labelled, max_train_docs).mapInArrow(_count_words, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    langs = sorted(r["lang"] for r in words.select("lang").distinct().limit(MAX_LANGS + 1).collect())
    if len(langs) > MAX_LANGS:
        raise ValueError(f"over {MAX_LANGS} languages")
    if not langs:
        return Model([])
    grams_of = words.repartition("gram").mapInArrow(_count_grams, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    known, scores = _table(words, langs, MAX_ENTRIES)
    known_grams, gram_scores = _table(cut(grams_of), langs, MAX_ENTRIES)
    return Model(langs, known, known_grams, scores, gram_scores)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for part in (p for b in batches for p in slices(b, 1)):
            found = m.predict(part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def learnable(docs: DataFrame) -> DataFrame:
    """The rows that the contract lets a model learn from; a null doc_id is not one of them."""
    return docs.filter(crc_mod("doc_id", 3) != 1)


def op1(docs: DataFrame) -> DataFrame:
    model = fit(learnable(docs))
    return predict(docs, model).select("doc_id", F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents that have a language; those for which it is ``und`` go. All columns stay as they are."""
    model = docs.sparkSession.sparkContext.broadcast(fit(learnable(docs)))

    def start():
        m = model.value
        return lambda texts: [x[0] != "und" for x in m.predict(texts)]

    return filter_texts(docs, start)
