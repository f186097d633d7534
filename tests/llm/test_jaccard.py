"""The Jaccard join against comparing all pairs in plain Python."""

import random
import re

import numpy as np
import pytest
from test_operators import LOWER, SCHEMA, empty, lowest, odd, odd_rows  # noqa: F401

from docsieve.llm import grams, jaccard, queries


def word_sets(rows, k):
    found = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        found.append(frozenset(tuple(words[a : a + k]) for a in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)] if words else []))
    return found


def by_hand(rows, k=3, percent=90):
    sets, above = word_sets(rows, k), {}

    def root(x):
        while above.setdefault(x, x) != x:
            x = above[x]
        return x

    for a, (i, _) in enumerate(rows):
        for b, (j, _) in enumerate(rows[:a]):
            if sets[a] and sets[b] and (i == j or 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])):
                x, y = root(i), root(j)
                if x != y:
                    above[max(x, y, key=lowest)] = min(x, y, key=lowest)
    return sorted(((i, len(s), root(i) if s else i) for (i, _), s in zip(rows, sets)), key=lambda r: (lowest(r[0]), r[1]))


def found(docs, k=3, percent=90):
    rows = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs, k, percent).collect()]
    return sorted(rows, key=lambda r: (lowest(r[0]), r[1]))


def test_registered_query_is_that_of_all_pairs(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    out = queries.QUERIES["op11_jaccard_join"](spark, sf_dir)
    assert out.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, out.collect())) == by_hand(rows)


def test_odd_rows_and_empty_table(odd, empty):  # noqa: F811
    assert found(odd) == by_hand(odd_rows())
    assert found(empty) == []


def variants():
    """Chains whose ends aren't alike, an original among variants that only it links, and a passage that many unlike texts share."""
    draw = random.Random(11)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(6))
    texts = []
    chain = [word() for _ in range(120)]
    for _ in range(30):
        chain[draw.randrange(120)] = word()
        texts.append(" ".join(chain))
    original = [word() for _ in range(400)]
    for _ in range(40):
        copy = list(original)
        for _ in range(draw.choice((2, 7, 9))):
            copy[draw.randrange(400)] = word()
        texts.append(" ".join(copy))
    texts.append(" ".join(original))
    passage = " ".join(word() for _ in range(60))
    texts += [passage + " " + " ".join(word() for _ in range(draw.choice((3, 4, 12, 60)))) for _ in range(60)]
    texts += [" ".join(word() for _ in range(n)) for n in range(1, 30) for _ in range(2)]
    texts += [texts[0].upper(), texts[5], texts[5] + " end"]
    order = list(range(len(texts)))
    draw.shuffle(order)
    return [(1000 + i, texts[at]) for i, at in enumerate(order)]


@pytest.mark.parametrize("tile", [4, 512])
@pytest.mark.parametrize("ids", [0, 2_000_000])
def test_links_beyond_the_hub(spark, monkeypatch, tile, ids):
    monkeypatch.setattr(jaccard, "TILE_ROWS", tile)
    monkeypatch.setattr(jaccard, "BROADCAST_IDS", ids)
    rows = variants()
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)) == by_hand(rows)
    if tile == 4 and ids == 0:
        assert found(spark.createDataFrame(rows, "doc_id long, text string"), 2, 70) == by_hand(rows, 2, 70)


@pytest.mark.parametrize("percent", [90, 75])
def test_linked_sets_share_a_part_and_bits_bound_the_overlap(percent):
    draw = np.random.default_rng(percent)
    for size in [2, 5, 9, 10, 11, 19, 20, 50, 133, 400, 1500]:
        for _ in range(20):
            base = np.unique(draw.integers(0, 1 << 63, size).astype(np.uint64) * np.uint64(2))
            lost = draw.integers(0, size * (100 - percent) // 100 + 1)
            new = draw.integers(0, 1 << 63, draw.integers(0, max(1, size * (100 - percent) // 100 - lost + 1))).astype(np.uint64)
            other = np.unique(np.concatenate([draw.permutation(base)[lost:], new]))
            both = len(np.intersect1d(base, other))
            union = len(base) + len(other) - both
            owner = np.repeat([0, 1], [len(base), len(other)])
            hashes = np.concatenate([base, other])
            bits = jaccard.bitmaps(owner, hashes, 2)
            differ = int(np.bitwise_count(bits[0] ^ bits[1]).sum())
            assert differ <= union - both
            sizes = np.array([len(base), len(other)])
            if 100 * both >= percent * union and both < union:
                assert jaccard.may_link(sizes[:1], sizes[1:], np.array([differ]), percent).all()
                keys = [set(), set()]
                for cuts, spare in jaccard.parts_of(sizes, percent):
                    for row, key in zip(*jaccard.part_keys(owner, hashes, cuts, spare)):
                        keys[row].add(int(key))
                assert keys[0] & keys[1]


def test_short_and_long_words_make_sets_of_their_own():
    texts = ["a b", "b a", "a", "a b c", "A  B\tc", "a b c d", "", " \n"]
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, raw)])
    owner, hashes = jaccard.shingle_sets(np.frombuffer(b"".join(raw), np.uint8), offsets, 3)
    sets = [tuple(hashes[owner == i]) for i in range(len(texts))]
    assert [len(s) for s in sets] == [1, 1, 1, 1, 1, 2, 0, 0]
    assert sets[3] == sets[4] and len({sets[i] for i in range(4)}) == 4
    assert grams.U64 is np.uint64
