"""Both ways to merge a match of the pattern give the same ids."""

import random

from threadline.llm import bpe


def test_short_and_long_merges_agree():
    rng = random.Random(4)
    ranks = bpe.load_ranks(bpe.VOCABULARY)
    for size in [1, 2, 3, *rng.choices(range(4, 2 * bpe.SHORT), k=300)]:
        for alphabet in (b"ab", b"thein ", bytes(range(256))):
            piece = bytes(rng.choice(alphabet) for _ in range(size))
            assert bpe.merge_short(piece, ranks) == bpe.merge_long(piece, ranks)
            assert bpe.merge(piece, ranks) == ([ranks[piece]] if piece in ranks else bpe.merge_long(piece, ranks))
