"""Words that a polynomial hash modulo 2 ** 64 takes for one another."""

import numpy as np
import pytest

from docsieve.llm import grams, near_dedup, substring_dedup


def twins(letters: int = 2048) -> tuple[str, str]:
    """A word of two letters that turns with the number of ones of its places, and the same with the letters swapped."""
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(letters))
    return one, one.translate(str.maketrans("ab", "ba"))


def test_words_have_hashes_of_their_own():
    texts = [*twins(1024), *twins(), "a" * 70, "a" * 71, "a" * 64 + "b", "b" + "a" * 64, "ab", "ba", "a", "b", "é"]
    raw = " ".join(texts).encode()
    found, _ = grams.words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    assert len(set(found.ids.tolist())) == len(texts)
    again, _ = grams.words(np.frombuffer(b"ba " + raw, np.uint8), np.array([0, len(raw) + 3]))
    assert again.ids[1:].tolist() == found.ids.tolist()  # the place in the text doesn't matter
    assert again.ids[0] == found.ids[texts.index("ba")]


@pytest.mark.parametrize("letters", [1024, 2048])
def test_unlike_long_words_are_no_copies(spark, letters):
    tail = " ".join(f"w{i}" for i in range(12))
    one, other = twins(letters)
    alone = spark.createDataFrame([(1, one), (2, other)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(alone, 4, 80).collect()} == {1: 1, 2: 2}
    rows = spark.createDataFrame([(1, f"{one} {tail}"), (2, f"{other} {tail}"), (3, f"{one} {tail}")], "doc_id long, text string")
    found = {r.doc_id: r.n_removed for r in substring_dedup.drop_repeated_passages(rows).collect()}
    assert found == {1: 0, 2: 0, 3: 13}
