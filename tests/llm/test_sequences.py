"""Periodic runs, word BPE and centroid clustering: against brute force, the tokenizer library and plain loops."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.fixtures import WORD, awkward, empty, frame
from threadline.llm import kmeans, queries, runs, trie_bpe


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- periodic runs


def all_runs(s, shortest, exponent):
    """Each period's maximal stretches; a stretch keeps its smallest period."""
    seen = {}
    for q in range(1, len(s) // 2 + 1):
        i = 0
        while i + q < len(s):
            j = i
            while j + q < len(s) and s[j] == s[j + q]:
                j += 1
            if j - i >= q:
                seen.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((a, b - a, q) for (a, b), q in seen.items() if b - a >= max(shortest, exponent * q))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60))
def test_runs_of_any_list(s):
    assert runs.runs_of(s, 2, 2) == all_runs(s, 2, 2)
    assert runs.runs_of_texts([list(map(str, s))]) == [all_runs(s, 6, 4)]


def test_runs_of_words_with_high_run_counts():
    a, b = [0], [0, 1]
    while len(b) < 600:
        a, b = b, b + a
    assert runs.runs_of(b, 2, 2) == all_runs(b, 2, 2)
    bits = [bin(i).count("1") % 2 for i in range(512)]
    assert runs.runs_of(bits, 2, 2) == all_runs(bits, 2, 2)
    assert runs.runs_of([0] * 5000) == [(0, 5000, 1)]


def test_blocks_and_squares_of_a_tree():
    tree = runs.SuffixTree([*b"abaabaabb", -1])
    assert runs.blocks(tree) == [0, 1, 2, 3, 8, 9, 10]
    text = b"abaabaabb"
    marked = {bytes(text[tree.first[v] : tree.first[v] + n]) for v, sizes in runs.vocabulary(tree).items() for n in sizes}
    assert marked == {text[i : i + 2 * k] for k in range(1, 5) for i in range(len(text) - 2 * k + 1) if text[i : i + k] == text[i + k : i + 2 * k]}


def test_candidates_lose_no_run():
    rng = random.Random(5)
    for _ in range(60):
        lists = []
        for _ in range(rng.randrange(1, 6)):
            s = [str(int(rng.expovariate(0.1))) for _ in range(rng.randrange(300))]
            for _ in range(rng.randrange(4)):
                if s:
                    a, p, m = rng.randrange(len(s)), rng.randrange(1, 20), rng.randrange(len(s))
                    s[a : a + m] = (s[a : a + p] * 300)[: len(s[a : a + m])]
            lists.append(s)
        assert runs.runs_of_texts(lists) == [all_runs(s, 6, 4) for s in lists]


def digests(doc_id, text):
    """The contract, word by word."""
    words = WORD.findall(text or "")
    if doc_id is not None and words:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g, n, old = h // 10, len(words), words
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [old[i] if i < a else old[a + (i - a) % p] for i in range(n)]
    found = all_runs(words, 6, 4)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(((-n, s, q) for s, n, q in found), default=None)
    first = (None,) * 4 if best is None else (best[1], -best[0], best[2], 1000 * -best[0] // best[2])
    return (doc_id, len(found), *first, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_op11_by_brute_force(spark):
    rows = [(i, t[:3000] if t else t) for i, t in awkward(7)]
    rows += [(500 + i, "a b c " * i + "x y " * (3 * i)) for i in range(8)] + [(600, "la " * 700), (601, "é 漢 é\x0b漢 " * 9), (602, "a\xa0b a\x1cb " * 7)]
    order = "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256".split()
    got = runs.op11(frame(spark, rows)).select(*order).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(digests(i, t)) for i, t in rows)
    assert runs.op11(empty(spark)).collect() == []
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows) > 3


def test_collapsed_text_of_a_long_document(spark):
    """A megabyte of one passage, and one without any run."""
    passage = [f"p{i}" for i in range(40_000)]
    rows = [(1, " ".join(passage * 5)), (2, " ".join(f"q{i}" for i in range(200_000)))]
    got = {r.doc_id: r for r in runs.find(frame(spark, rows)).collect()}
    assert [tuple(r) for r in got[1].runs] == [(0, 200_000, 40_000)] and got[1].collapsed == " ".join(passage)
    assert got[2].runs == [] and got[2].collapsed == rows[1][1]


# --- word BPE


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(trie_bpe.VOCABULARY)
    t.no_truncation()
    t.no_padding()
    return t


def same(library, texts):
    own = [np.frombuffer(b, np.int32).tolist() for b in trie_bpe.encode_texts(texts)]
    for text, ids, e in zip(texts, own, library.encode_batch([t or "" for t in texts], add_special_tokens=False), strict=True):
        assert ids == e.ids, text
        assert trie_bpe.decode_ids(ids) == library.decode(e.ids, skip_special_tokens=False)


PIECES = ["a", "aa", "the", "in", "é", "é", "Σ", "ς", " ", "'s", "'T", "!!", "<|endoftext|>", "<|startoftext|>", "<|", "|>", "9", "漢字", "\n", "\x1c", "\x85", "​", "İ", "ﬁ", "hello", "ing", "👍🏽", "\U00010d50", "՘"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=30))
def test_words_as_the_library(library, pieces):
    same(library, ["".join(pieces)])


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text_as_the_library(library, text):
    same(library, [text])


def test_repeated_letters_and_many_words_as_the_library(library):
    rng = random.Random(2)
    same(library, ["a" * k for k in range(120)] + ["ab" * k for k in range(60)] + ["!" * k for k in range(80)])
    same(library, ["".join(rng.choice("abcdeinorst") for _ in range(rng.randrange(1, 40))) for _ in range(5000)])
    same(library, [None, "", " \n", "x" * 100_000, "ab " * 50_000])


def test_every_letter_as_the_library(library):
    same(library, [f"a{chr(c)}b {chr(c)}" for c in range(1, 0x20000) if not 0xD800 <= c < 0xE000])


def test_trie_shares_prefixes():
    root = trie_bpe.trie_of([b"carts", b"car", b"card", b"do", b"carton"])
    assert [(k.word[: k.depth], sorted(k.ends)) for k in root.kids] == [(b"ca", [b"car"]), (b"d", [b"do"])]
    car = root.kids[0].kids[0]
    assert (car.word[: car.depth], car.ends, [k.word[: k.depth] for k in car.kids]) == (b"car", [b"card"], [b"cart"])
    assert [k.word[: k.depth] for k in car.kids[0].kids] == [b"carto"]


def test_memory_of_words_does_not_change_ids(library, monkeypatch):
    monkeypatch.setattr(trie_bpe, "MEMO", 8)
    rng = random.Random(4)
    for _ in range(20):
        same(library, ["".join(rng.choice(PIECES) for _ in range(20)) for _ in range(5)])


def test_op12_as_the_library(spark, library):
    rows = awkward(3) + [(700, "<|endoftext|>x<|ENDOFTEXT|>"), (701, "ΑΣ Σ ΌΣΟΣ")]
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    got = trie_bpe.op12(frame(spark, rows)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert trie_bpe.op12(empty(spark)).collect() == []


def test_decoding_of_null_and_unknown_ids(spark):
    df = spark.createDataFrame([(1, [320, 49407]), (2, []), (3, None)], "doc_id long, ids array<int>")
    assert {r.doc_id: r.decoded for r in trie_bpe.decode(df).collect()} == {1: "a</w> <|endoftext|>", 2: "", 3: ""}
    with pytest.raises(ValueError):
        trie_bpe.decode_ids([60_000])


# --- centroid clustering

VECTORS = "vec_id long, embedding array<float>, x string, cluster int, label int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", 7, None) for i, v in rows], VECTORS)


def plain_lloyd(rows):
    """The contract with Python integers."""
    import math

    kept = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    centroids = [v for _, v in sorted((sha(f"1:{i}"), v) for i, v in kept if i is not None)[:16]]
    centroids = [list(c) for c in centroids]

    def at(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))

    for _ in range(3 if centroids else 0):
        own = [at(v)[1] for _, v in kept]
        for j in range(len(centroids)):
            mine = [v for (_, v), k in zip(kept, own, strict=True) if k == j]
            if mine:
                centroids[j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    if not centroids:
        return [(i, None, None, None, None, None) for i, _ in kept]
    found = [(i, *at(v)[::-1]) for i, v in kept]
    return [(i, j, d, sum(y for _, k, y in found if k == j), sum(y for *_, y in found), sha(",".join(map(str, centroids[j])))) for i, j, d in found]


def table(seed, n, same_every=0):
    rng = np.random.default_rng(seed)
    v = rng.normal(0, 0.4, (n, 64)).astype(np.float32).tolist()
    if same_every:
        v = [v[0] if i % same_every else x for i, x in enumerate(v)]
    return list(enumerate(v))


BAD = [(9001, None), (9002, []), (9003, [1.0] * 63), (9004, [1.0] * 65), (9005, [None, *[1.0] * 63]), (9006, [float("nan"), *[1.0] * 63]), (9007, [float("inf"), *[1.0] * 63])]


@pytest.mark.parametrize(
    "rows",
    [
        table(1, 200) + BAD,
        table(2, 7),
        table(3, 150, same_every=3) + [(3, table(4, 1)[0][1]), (3, table(5, 1)[0][1]), (None, table(6, 1)[0][1])],
        [(None, v) for _, v in table(7, 5)],
        [(i, [1000.0 if i == 3 else -0.001] * 64) for i in range(40)],
        BAD,
        [],
    ],
)
def test_op13_by_plain_loops(spark, tmp_path, rows):
    df = vectors(spark, rows)
    order = "vec_id cluster distance cluster_inertia inertia centroid_sha256".split()
    got = kmeans.op13(df.repartition(5)).select(*order).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, plain_lloyd(rows)))
    if any(i is not None for i, _ in rows):
        df.write.parquet(f"{tmp_path}/v.parquet")
        duck = duckdb.connect()
        duck.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/v.parquet/*.parquet'")
        want = duck.sql(kmeans.oracle()).select(*order).fetchall()
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_op13_on_a_whole_table(spark):
    duck = duckdb.connect()
    duck.sql("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.001/embeddings.parquet'")
    order = "vec_id cluster distance cluster_inertia inertia centroid_sha256".split()
    got = queries.queries()["op13_centroid_clustering"](spark, "/root/testdata/sf0.001").select(*order).collect()
    assert sorted(map(tuple, got)) == sorted(duck.sql(queries.oracle_sql()["op13_centroid_clustering"]).select(*order).fetchall())


def test_large_components_raise(spark):
    with pytest.raises(Exception, match="2\\^27"):
        kmeans.op13(vectors(spark, [(1, [1e9] * 64)]))


def test_first_of_equally_near_centroids():
    x = np.array([[0, 0], [2, 0]])
    assert [a.tolist() for a in kmeans.nearest(x, np.array([[1, 0], [1, 0], [-1, 0]]))] == [[0, 0], [1, 1]]
