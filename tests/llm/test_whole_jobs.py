"""Whole jobs: results against the tools and definitions that they stand for."""

import collections
import random

import pytest
from test_operators import scores_by_hand

from docsieve.llm import lm_score, mixing, pieces


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.read_vocabulary(pieces.MODEL)


# -- pieces


def test_pieces_are_those_of_sentencepiece(spark, sf_dir, vocabulary):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("text IS NOT NULL AND NOT contains(text, '▁')")
    for row in pieces.encode_pieces(docs).select("doc.text", "n_pieces", "piece_ids").collect():
        assert row.piece_ids == model.encode(row.text) and row.n_pieces == len(row.piece_ids)
    draw = random.Random(5)
    ordinary = [p.decode().replace("▁", " ") for p, k in zip(vocabulary.pieces, vocabulary.kinds) if k == 0]
    texts = ["the women", "", "a\tb\nc\x00", "日本語 🙂 é", "x" * 3000, "日本語" * 500, *(" " * n + "women" + " " * n for n in range(70))]
    texts += ["".join(draw.choice(ordinary) for _ in range(draw.randint(1, 30))) for _ in range(2000)]
    texts += ["".join(draw.choice("aabeinrst  \né日🙂0") for _ in range(draw.randint(1, 200))) for _ in range(2000)]
    found = pieces.Encoder(vocabulary, vocabulary.splits is not None).encode([t.encode() for t in texts])
    assert found == [model.encode(t) for t in texts]


@pytest.mark.parametrize("merges", [False, True])
def test_long_words_stand_alone(vocabulary, merges, monkeypatch):
    encoder, cells = pieces.Encoder(vocabulary, merges), []
    segment = encoder.automaton.segment

    def watched(words):
        cells.append((max(map(len, words)) + 1) * len(words) if len(words) > 1 else 0)
        assert cells[-1] <= pieces.TOGETHER
        return segment(words)

    monkeypatch.setattr(encoder.automaton, "segment", watched)
    draw = random.Random(7)
    texts = ["x" * 60_000, " ".join(f"{k:09d}" for k in range(20_000)), "\t".join(draw.choice("abc") * 9 for _ in range(3000))]
    found = encoder.encode([t.encode() for t in texts])
    assert [pieces.decode(vocabulary, ids) for ids in found] == [t.encode() for t in texts]
    assert max(cells) > 0 and max(map(len, encoder.known)) <= pieces.LONG


# -- scores


def test_registered_scores_look_at_two_words_of_context(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((r.n_words, round(r.log_score, 4)) for r in lm_score.op6(spark, sf_dir).collect())
    want = scores_by_hand(rows, 3)
    assert [n for n, _ in got] == [n for n, _ in want] and [s for _, s in got] == pytest.approx([s for _, s in want], abs=2e-4)


# -- mixing


def test_documents_without_words_stay_in_the_mix(spark):
    rows = [(1, None, "a"), (2, "", "a"), (2, "", "a"), (3, " \t\n", "b"), (4, "x y z", "b"), (5, None, "empty"), (None, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = collections.Counter(tuple(r) for r in mixing.mix(docs).select("doc.*").collect())
    assert {r: n for r, n in got.items() if not (r[1] or "").split()} == {r: n for r, n in collections.Counter(rows).items() if not (r[1] or "").split()}


def test_repeated_rows_share_the_copies(spark):
    rows = [(1, "x y", "a", str(k % 4)) for k in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, note string").repartition(3)
    plan = mixing.plan_mix(docs, whole=True).collect()
    taken = [tuple(r) for r in mixing.mix(docs).select("doc.*", "position").collect()]
    assert sum(r.taken for r in plan) == 30 and len(taken) == 15  # half as many words again as there are
    assert sorted(r[-1] for r in taken) == [r[-1] for r in taken] == sorted(t for r in plan for t in r.times)
    assert max(collections.Counter(r[3] for r in taken).values()) <= 6
    nulls = spark.createDataFrame([(None, "x y", None)] * 4 + [(2, "z", None)], "doc_id long, text string, source string")
    assert [tuple(r) for r in mixing.mix(nulls).collect()] == [tuple(r) for r in mixing.mix(nulls.repartition(4)).collect()]
    assert len(mixing.mix(nulls.limit(0)).collect()) == 0
