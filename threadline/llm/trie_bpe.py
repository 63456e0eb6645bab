"""BPE over words with ends: encoding by a traversal of a trie, and decoding.

A text is split into chunks at white space; a chunk is normalised and split into
words, the last byte of which has a symbol of its own. The distinct new words of
a slice of texts are inserted into a trie of whole edges, which is walked depth
first. A place on the path from the root has one value: the last token of the
encoding of the prefix that ends there. It follows from the places above it
alone: it is the only token t that ends the prefix and may follow the last token
of what is before t. So the prefix that many words share is encoded once, and a
word's ids are read backwards along its path.

Why that is right: part of an encoding is the encoding of its part, and tokens
each pair of which stays apart when merged alone stay apart together. Two tokens
are merged across their border if a symbol at the end of the first and one at
the start of the second form a pair of a lower rank than the merges that use
either up (``_Model.apart``). It needs merges in order of training: those that
make a pair's parts come before it. Any other file is refused.

Defined results: null text is empty text; an empty text, or one of white space,
has no ids and decodes to empty text; the strings of special tokens in a text
are these tokens; ids unknown to the vocabulary raise. Rows are independent, so
hot keys, ties and repeated rows need no care; an empty table gives no rows. Only
``doc_id`` and ``text`` are read; other columns may have any name. A chunk of a
megabyte is a path of as many places, a few bytes each.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, normalizers, pre_tokenizers

from threadline.llm.common import SLICE, slices

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
#: Chunks, and pairs of tokens, kept with their results in one Python worker; longer chunks than KEPT are not. Bounds on memory, not on results.
MEMO, KEPT = 500_000, 200
_NEVER = 1 << 30
#: Bytes by which the tokens that may end a prefix are looked up.
END = 3
#: Fixed values of the format: white space, the split pattern, the end of a word.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"

_chunks = regex.compile(f"[^{SPACE}]+").findall
_split = pre_tokenizers.Split(Regex(SPLIT), "removed", invert=True)
_words, _words_at = regex.compile(SPLIT).findall, regex.compile(SPLIT).finditer
#: Composed, and lower case letter by letter (str.lower() has a final sigma).
_normalise = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()]).normalize_str
#: str.split() also splits at these four.
_separators = regex.compile("[\x1c-\x1f]").search


def chunks_of(text: str) -> list[str]:
    return _chunks(text) if _separators(text) else text.split()


@lru_cache(maxsize=100_000)
def _stand_in(char: str) -> str:
    """A letter, digit or mark for a character that is too new for some version of Unicode: the library's decides."""
    parts = _split.pre_tokenize_str(f"a{char}{char}")
    return "a" if len(parts) == 1 else "1" if len(parts) == 3 else "!"


def words_of_chunk(chunk: str) -> list[bytes]:
    """The words of a chunk after normalising."""
    if chunk.isascii():
        return [w.encode() for w in _words(chunk.lower())]
    chunk = _normalise(chunk)
    shape = "".join([_stand_in(c) if unicodedata.category(c) == "Cn" else c for c in chunk])
    return [chunk[m.start() : m.end()].encode() for m in _words_at(shape)]


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the file: itself if it can be seen, else the next letter from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(seen)]
    return {chr(b): b for b in seen} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Node:
    """A node of the trie: the first ``depth`` bytes of ``word``; ``ends`` are the words that have one more byte."""

    __slots__ = ("word", "depth", "kids", "ends")

    def __init__(self, word: bytes, depth: int):
        self.word, self.depth, self.kids, self.ends = word, depth, [], []


def trie_of(words: Iterable[bytes]) -> Node:
    """The trie of distinct words without their last bytes; a node stands only where words end or part."""
    root = Node(b"", 0)
    stack, before = [root], b""
    for word in sorted(words):
        stop, k = len(word) - 1, 0
        most = min(stop, stack[-1].depth)
        if word[:most] == before[:most]:
            k = most
        else:
            while word[k] == before[k]:
                k += 1
        below = None
        while stack[-1].depth > k:
            below = stack.pop()
        node = stack[-1]
        if node.depth < k:
            middle = node.kids[-1] = Node(word, k)
            middle.kids.append(below)
            stack.append(middle)
            node = middle
        if k < stop:
            leaf = Node(word, stop)
            node.kids.append(leaf)
            stack.append(leaf)
            node = leaf
        node.ends.append(word)
        before = word
    return root


class _Model:
    """A vocabulary file: tokens, merges, and for each token the symbols at its borders while it is made."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, letters = file["model"], byte_letters()
        vocab: dict[str, int] = model["vocab"]
        self.specials = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.find_specials = regex.compile("|".join(map(regex.escape, self.specials))).finditer if self.specials else None
        top = max([*vocab.values(), *self.specials.values()]) + 1
        self.shown: list[str | None] = [None] * top
        for t, i in (vocab | self.specials).items():
            self.shown[i] = t
        self.length = [0] * top
        self.inner: dict[bytes, int] = {}
        self.final: dict[bytes, int] = {}
        self.rank: dict[tuple[int, int], int] = {}
        # Token -> (symbol, rank of the merge that uses it up) along its right and its left border, the token itself first.
        self.right: list[list[tuple[int, int]]] = [[] for _ in range(top)]
        self.left: list[list[tuple[int, int]]] = [[] for _ in range(top)]
        self.pairs: dict[int, bool] = {}
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        made = {vocab[x + y]: r for r, (x, y) in enumerate(merges)}
        if len(made) < len(merges):
            raise ValueError("two merges make the same token")
        self.rank = {(vocab[x], vocab[y]): r for r, (x, y) in enumerate(merges)}
        for t, i in vocab.items():
            if i not in made:
                self._add(t, i, letters)
        for (x, y), r in self.rank.items():
            if made.get(x, -1) >= r or made.get(y, -1) >= r:
                raise ValueError("merges are not in order of training")
            token = self.shown[x] + self.shown[y]
            z = vocab[token]
            # A token that its own bytes don't make can't come up anywhere.
            own = self.length[x] and self.length[y] and self._first_across(x, y) == r
            self.right[z] = [(z, _NEVER), (y, r), *self.right[y][1:]]
            self.left[z] = [(z, _NEVER), (x, r), *self.left[x][1:]]
            if own:
                self._add(token, z, letters)
        self.inner_sizes, self.final_sizes = _sizes(self.inner), _sizes(self.final)

    def _add(self, token: str, i: int, letters: dict[str, int]) -> None:
        ends = token.endswith(WORD_END) and len(token) > len(WORD_END)
        as_bytes = bytes(letters[c] for c in (token.removesuffix(WORD_END) if ends else token))
        (self.final if ends else self.inner)[as_bytes] = i
        self.length[i] = len(as_bytes)
        self.right[i] = self.right[i] or [(i, _NEVER)]
        self.left[i] = self.left[i] or [(i, _NEVER)]

    def _first_across(self, x: int, y: int) -> int:
        """The least rank of a merge across the border of two tokens; of equal ranks the left one comes first."""
        rank, least = self.rank.get, _NEVER
        for a, a_used in self.right[x]:
            for b, b_used in self.left[y]:
                r = rank((a, b), _NEVER)
                if r < a_used and r <= b_used and r < least:
                    least = r
        return least

    def apart(self, x: int, y: int) -> bool:
        key = x << 32 | y
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= MEMO:
                self.pairs.clear()
            found = self.pairs[key] = self._first_across(x, y) == _NEVER
        return found

    def _last(self, tokens: dict[bytes, int], sizes: dict[bytes, tuple[int, ...]], word: bytes, n: int, last: array) -> int:
        """The last token of the encoding of the first n bytes of a word, given those of all shorter prefixes."""
        for k in sizes.get(word[n - END : n], (2, 1)) if n >= END else range(n, 0, -1):
            if k <= n:
                t = tokens.get(word[n - k : n])
                if t is not None and (k == n or self.apart(last[n - k - 1], t)):
                    return t
        raise ValueError("the vocabulary lacks a byte")

    def encode(self, words: Iterable[bytes]) -> dict[bytes, bytes]:
        """Word -> its ids as packed 32-bit integers, of all words at once."""
        found: dict[bytes, bytes] = {}
        last, length = array("i"), self.length
        stack = [(trie_of(words), 0)]
        while stack:
            node, above = stack.pop()
            del last[above:]
            depth = node.depth
            for n in range(above + 1, depth + 1):
                last.append(self._last(self.inner, self.inner_sizes, node.word, n, last))
            for word in node.ends:
                t = self._last(self.final, self.final_sizes, word, depth + 1, last)
                ids, at = [t], depth + 1 - length[t]
                while at:
                    t = last[at - 1]
                    ids.append(t)
                    at -= length[t]
                found[word] = array("i", ids[::-1]).tobytes()
            stack += [(kid, depth) for kid in node.kids]
        return found


def _sizes(tokens: dict[bytes, int]) -> dict[bytes, tuple[int, ...]]:
    """Last END bytes -> the sizes of tokens that end so, the longest first, and the sizes below END."""
    found: dict[bytes, set[int]] = {}
    for t in tokens:
        if len(t) >= END:
            found.setdefault(t[-END:], set(range(1, END))).add(len(t))
    return {end: tuple(sorted(sizes, reverse=True)) for end, sizes in found.items()}


@lru_cache(maxsize=2)
def load(path: str) -> _Model:
    return _Model(path)


class Halves(dict):
    """A dict in two halves: when one is full the other goes, and what is asked for again moves on, so frequent keys stay however many rare ones pass."""

    def __init__(self):
        super().__init__()
        self.former: dict = {}

    def known(self, keys: Iterable) -> tuple[dict, list]:
        """The values of keys that are known, and the other keys."""
        if len(self) >= MEMO // 2:
            self.former = dict(self)
            self.clear()
        found, new = {}, []
        for k in keys:
            value = self.get(k)
            if value is None:
                value = self.former.get(k)
                if value is None:
                    new.append(k)
                    continue
                self[k] = value
            found[k] = value
        return found, new

    def learn(self, values: dict) -> None:
        self.update((k, v) for k, v in values.items() if len(k) <= KEPT)


class Memo:
    """Packed ids of the chunks and words of a worker's texts."""

    def __init__(self, model: _Model):
        self.model, self.chunks, self.words = model, Halves(), Halves()

    def ids(self, chunks: set[str]) -> dict[str, bytes]:
        """Chunk -> its ids; the new words of all of them make one trie."""
        found, new = self.chunks.known(chunks)
        words = [words_of_chunk(c) for c in new]
        ids_of, unknown = self.words.known({w for ws in words for w in ws})
        first = self.model.encode(unknown)
        self.words.learn(first)
        ids_of |= first
        made = {c: b"".join([ids_of[w] for w in ws]) for c, ws in zip(new, words, strict=True)}
        self.chunks.learn(made)
        return found | made


@lru_cache(maxsize=2)
def _memo(path: str) -> Memo:
    return Memo(load(path))


def _parts(text: str, model: _Model) -> Iterator[tuple[list[str], bytes]]:
    """The chunks before each special token, and that token."""
    at = 0
    if model.find_specials and "<" in text:
        for m in model.find_specials(text):
            yield chunks_of(text[at : m.start()]), array("i", [model.specials[m.group()]]).tobytes()
            at = m.end()
    yield chunks_of(text[at:] if at else text), b""


def encode_texts(texts: list[str | None], path: str = VOCABULARY) -> list[bytes]:
    """Packed ids of whole texts."""
    model = load(path)
    parts = [list(_parts(t, model)) if t else [] for t in texts]
    ids = _memo(path).ids({c for ps in parts for chunks, _ in ps for c in chunks}).__getitem__
    return [b"".join([x for chunks, special in ps for x in (*map(ids, chunks), special)]) for ps in parts]


def decode_ids(ids: list[int], path: str = VOCABULARY) -> str:
    """The tokens as the file writes them, joined by spaces, as the file names no decoder."""
    shown = load(path).shown
    if ids and (min(ids) < 0 or max(ids) >= len(shown)):
        raise ValueError("an id is not in the vocabulary")
    return " ".join([shown[i] for i in ids])


def _ids(texts: list[str | None], path: str) -> pa.ListArray:
    packed = encode_texts(texts, path)
    offsets = np.zeros(len(packed) + 1, np.int32)
    np.cumsum([len(p) // 4 for p in packed], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), np.int32)))


def _texts(ids: pa.ListArray, path: str) -> pa.Array:
    return pa.array([decode_ids(x.values.to_numpy(zero_copy_only=False).tolist(), path) if x.is_valid else "" for x in ids], pa.string())


def _id_type(df: DataFrame) -> str:
    return df.schema["doc_id"].dataType.simpleString()


def encode(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, ids array<int> of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in slices(b, 1)):
            yield pa.RecordBatch.from_arrays([part.column(0), _ids(part.column(1).to_pylist(), path)], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {_id_type(docs)}, ids array<int>")


def decode(encoded: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, ids, decoded string; null ids decode to empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE)):
            yield pa.RecordBatch.from_arrays([*part.columns, _texts(part.column(1), path)], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {_id_type(encoded)}, ids array<int>, decoded string")


def round_trip(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """decode(encode(docs)) by one worker for each task instead of two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in slices(b, 1)):
            ids = _ids(part.column(1).to_pylist(), path)
            yield pa.RecordBatch.from_arrays([part.column(0), ids, _texts(ids, path)], ["doc_id", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {_id_type(docs)}, ids array<int>, decoded string")


def op12(docs: DataFrame) -> DataFrame:
    """Digests of the ids and of the decoded text of every document."""
    return round_trip(docs).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
