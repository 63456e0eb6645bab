"""Small documents with every awkward case, and brute-force helpers."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Names that operators use inside, to clash with.
EXTRA = "word string, key string, fingerprint long, component string, size int, shard int, slot int, spans string, n long, bucket int, line string, gram string, twin int, row int, ids string, place string, text_id string, b string, stay int, _gone string, score double"
N_EXTRA = EXTRA.count(",") + 1
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"


def frame(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, lang)."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src0", len(r[1]) if r[1] is not None else None, *[None] * N_EXTRA) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def empty(spark):
    return frame(spark, [])


def awkward(seed=0, vocabulary=400, n=60):
    """Null, empty, blank, very long, repeated and nearly equal texts, null and repeated ids."""
    rng = random.Random(seed)
    words = ["the", "of", "and", "der", "la", "que", "é", "漢字", "token=abcdefgh", "AKIA1234567890ABCD", "x" * 60] + [f"w{i}" for i in range(vocabulary)]

    def text(k):
        return "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\n", ". ", "\t"]) for _ in range(k))

    base = [text(rng.randrange(5, 120)) for _ in range(n)]
    rows = [(10 + i, t) for i, t in enumerate(base)]
    rows += [(200 + i, base[i]) for i in range(8)]
    for i in range(8, 16):
        w = base[i].split(" ")
        w[rng.randrange(len(w))] = "changed"
        rows.append((200 + i, " ".join(w)))
    rows += [(1, None), (2, ""), (3, " \n\t\r "), (4, text(6000)), (5, "one"), (None, base[0]), (None, None), (300, base[3]), (300, base[3]), (301, base[4]), (301, base[5])]
    rng.shuffle(rows)
    return rows
