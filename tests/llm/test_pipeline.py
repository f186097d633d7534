"""The pipeline's stages, one after another, against plain Python."""

import collections
import os

import corpus_pipeline
import pytest
from test_operators import lines_by_hand, near_by_hand, odd_rows, targets_by_hand

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """What each stage was given and what it returned."""
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        folder = str(tmp_path_factory.mktemp(name) / "rows")
        stage(spark, docs, sf_dir).write.parquet(folder)
        given, docs = docs, spark.read.parquet(folder)
        out.append((name, given.collect(), docs.collect(), docs.columns))
    return {name: rest for name, *rest in out}


def test_all_but_the_last_hand_documents_on(stages):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "near_dedup", "mixing", "sentence_pieces"]
    assert all(stages[n][2] == COLUMNS for n in names[:-1])


def test_toxic_documents_go(stages, spark, sf_dir):
    given, kept, _ = stages["toxicity"]
    gone = {r.doc_id for r in given} - {r.doc_id for r in kept}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert {tuple(r) for r in kept} <= {tuple(r) for r in given}
    assert sum(labels.get(i) == 0 for i in gone) <= 0.1 * sum(v == 0 for v in labels.values())


def test_lines_go(stages):
    given, kept, _ = stages["line_dedup"]
    want = lines_by_hand([(r.doc_id, r.text) for r in given])
    assert collections.Counter((k[0], k[3]) for k in want.elements()) == collections.Counter((r.doc_id, r.text) for r in kept)


def test_one_of_each_group_stays(stages):
    given, kept, _ = stages["near_dedup"]
    want = {k[0] for k in near_by_hand([(r.doc_id, r.text) for r in given], 5) if k[3]}
    assert {r.doc_id for r in kept} == want and len(kept) == len(want)


def test_sources_are_mixed(stages):
    given, kept, _ = stages["mixing"]
    sizes, taken, largest = collections.Counter(), collections.Counter(), collections.Counter()
    for r in given:
        n = len((r.text or "").encode().split())
        sizes[r.source] += n
        largest[r.source] = max(largest[r.source], n)
    for r in kept:
        taken[r.source] += len((r.text or "").encode().split())
    assert all(abs(taken[s] - t) <= largest[s] for s, t in targets_by_hand(sizes).items())
    assert {tuple(r) for r in kept} <= {tuple(r) for r in given}


def test_pieces_come_with_the_documents(stages):
    given, kept, columns = stages["sentence_pieces"]
    assert columns == [*COLUMNS, "n_pieces", "piece_ids", "round_trip"] and len(given) == len(kept)
    assert all(r.round_trip for r in kept)


def test_stages_take_odd_rows(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, size int, kept string, id int, doc string"
    rows = [(i, t, None, ["a", None, "b"][k % 3], None, k, "x", None, "d") for k, (i, t) in enumerate(odd_rows())]
    labels = spark.createDataFrame([(200 + i, int(i < 10)) for i in range(30)] + [(None, 1), (1, None)], "doc_id long, toxic int")
    for name, given in (("odd", rows), ("none", [])):
        folder = str(tmp_path / name)
        os.makedirs(folder)
        spark.createDataFrame(given, schema).write.parquet(f"{folder}/documents.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, folder).write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
        assert set(schema_names(schema)) <= set(docs.columns) and (docs.count() > 0) == bool(given)


def schema_names(schema):
    return [f.split()[0] for f in schema.split(", ")]
