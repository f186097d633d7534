"""Toxicity: a logistic model whose score may not change when group names are swapped."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsieve.llm import grams
from docsieve.llm.common import table
from docsieve.session import cut_lineage

U64 = grams.U64
#: Places into which words and their beginnings are hashed, and lengths (bytes) of the beginnings.
WIDTH_BITS, BEGINNINGS = 20, (4, 5, 6)
#: Names of groups in lower case, whose mention alone says nothing about a text. A parameter: extend it by language.
IDENTITY_TERMS = (
    "women", "men", "muslims", "christians", "jews", "immigrants", "gay", "straight", "black", "white", "disabled", "elderly",
    "femmes", "hommes", "musulmans", "frauen", "männer", "muslime", "mujeres", "hombres", "musulmanes",
)


class Model(NamedTuple):
    weights: np.ndarray  # one for each hashed place
    bias: float


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, place) of every text's words and word beginnings, with repetitions. Words are runs of letters, A-Z lowered."""
    w, sums = grams.words(data, offsets, lower=True, blank=grams.NON_LETTER)
    owner = np.repeat(np.arange(len(offsets) - 1), w.counts)
    owners, places = [owner], [w.ids >> U64(64 - WIDTH_BITS)]
    for k in BEGINNINGS:
        long = np.flatnonzero(w.ends - w.starts > k)
        owners.append(owner[long])
        places.append(grams.mix64(sums.hash(w.starts[long], w.starts[long] + k) + U64(k)) >> U64(64 - WIDTH_BITS))
    return np.concatenate(owners), np.concatenate(places).astype(np.int64)


def _presence(data: np.ndarray, offsets: np.ndarray, chosen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, place), each once. With ``chosen`` only those places."""
    owner, places = features(data, offsets)
    if chosen is not None:
        some = chosen[places]
        owner, places = owner[some], places[some]
    both = np.unique((owner << WIDTH_BITS) | places)
    return both >> WIDTH_BITS, both & ((1 << WIDTH_BITS) - 1)


def term_features(terms: Sequence[str]) -> list[np.ndarray]:
    out = []
    for term in terms:
        raw = np.frombuffer(term.encode(), np.uint8)
        out.append(_presence(raw, np.array([0, len(raw)]))[1])
    return out


def _support(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many of a task's toxic and other texts hold each place."""
    counts = np.zeros((2, 1 << WIDTH_BITS), np.int64)
    for batch in batches:
        for rows, data, offsets in grams.pieces(batch, "text"):
            toxic = rows.column("toxic").to_numpy(zero_copy_only=False)
            owner, places = _presence(data, offsets)
            for y in (0, 1):
                counts[y] += np.bincount(places[toxic[owner] == y], minlength=1 << WIDTH_BITS)
    at = np.flatnonzero(counts.sum(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[0, at]), pa.array(counts[1, at])], names=["place", "clean", "toxic"])


def _rows_of(chosen: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each labelled text's chosen places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = _wanted(chosen)
        for batch in batches:
            for rows, data, offsets in grams.pieces(batch, "text"):
                owner, places = _presence(data, offsets, wanted)
                cuts = np.searchsorted(owner, np.arange(rows.num_rows + 1))
                lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(places.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([rows.column("toxic"), lists], names=["toxic", "places"])

    return run


def _wanted(chosen: np.ndarray) -> np.ndarray:
    wanted = np.zeros(1 << WIDTH_BITS, bool)
    wanted[chosen] = True
    return wanted


def swapped_sentences(data: np.ndarray, offsets: np.ndarray, terms: Sequence[str], wanted: np.ndarray) -> Iterator[tuple[list[int], list[int]]]:
    """(lost, gained) wanted places of each sentence that names a group when the name, wherever the sentence has it, is
    swapped for each other name, and for none. A sentence ends at a line's end, '.', '!' or '?', and with its text."""
    ids = grams.words(*_joined(terms), lower=True, blank=grams.NON_LETTER)[0].ids
    w, _ = grams.words(data, offsets, lower=True, blank=grams.NON_LETTER)
    named = np.flatnonzero(np.isin(w.ids, ids))
    if not len(named):
        return
    stops = np.zeros(256, np.int64)
    stops[[10, 33, 46, 63]] = 1
    sentence = np.cumsum(stops[data])[w.starts] + np.repeat(np.arange(len(offsets) - 1), w.counts)
    names = [set(places[wanted[places]].tolist()) for places in term_features(terms)] + [set()]
    for first, term in sorted(set(zip(np.searchsorted(sentence, sentence[named]).tolist(), w.ids[named].tolist()))):
        last = int(np.searchsorted(sentence, sentence[first], side="right")) - 1
        raw = data[w.starts[first] : w.ends[last]].copy()
        for k in np.flatnonzero(w.ids[first : last + 1] == U64(term)) + first:
            raw[w.starts[k] - w.starts[first] : w.ends[k] - w.starts[first]] = 32
        rest = set(_presence(raw, np.array([0, len(raw)]), wanted)[1].tolist())
        here = int(np.flatnonzero(ids == U64(term))[0])
        for other, places in enumerate(names):
            if other != here:
                yield sorted(names[here] - rest - places), sorted(places - rest - names[here])


def _swaps(chosen: np.ndarray, terms: Sequence[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = _wanted(chosen)
        for batch in batches:
            for _, data, offsets in grams.pieces(batch, "text"):
                found = list(swapped_sentences(data, offsets, terms, wanted))
                kind = pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], kind), pa.array([f[1] for f in found], kind)], names=["lost", "gained"])

    return run


class Problem(NamedTuple):
    """What is minimised, over one weight a chosen place and a bias. ``rows`` and ``places`` are the pairs of text and place;
    ``swaps``, ``moved`` and ``signs`` the places that a swap takes (-1) or brings (1); ``often`` is each swap's weight."""

    toxic: np.ndarray
    each: np.ndarray
    rows: np.ndarray
    places: np.ndarray
    swaps: np.ndarray
    moved: np.ndarray
    signs: np.ndarray
    often: np.ndarray
    ridge: float


def objective(problem: Problem, w: np.ndarray, bias: float) -> tuple[float, np.ndarray]:
    """The loss and its gradient (the bias last): weighted log loss, ridge, and the squared change of score of each swap."""
    q = problem
    score = bias + np.bincount(q.rows, w[q.places], minlength=len(q.toxic))
    error = q.each * (1 / (1 + np.exp(-score)) - q.toxic)
    change = np.bincount(q.swaps, q.signs * w[q.moved], minlength=len(q.often))
    loss = q.each @ (np.logaddexp(0, score) - q.toxic * score) + q.ridge / 2 * (w @ w) + q.often @ change**2
    pull = np.bincount(q.moved, 2 * q.signs * (q.often * change)[q.swaps], minlength=len(w))
    return float(loss), np.append(np.bincount(q.places, error[q.rows], minlength=len(w)) + q.ridge * w + pull, error.sum())


def _joined(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def fit(
    labelled: DataFrame,
    identity_terms: Sequence[str] = IDENTITY_TERMS,
    max_features: int = 4096,
    min_surprise: float = 25.0,
    penalty: float = 50.0,
    ridge: float = 0.02,
    steps: int = 600,
) -> Model:
    """Fits on (text, toxic), a bounded number of rows; each identity term is one word.

    Places are chosen by how unevenly toxic and other texts hold them (twice the log likelihood ratio); the terms' own places
    always take part. The loss is the mean log loss, with both labels weighing alike once half of the imbalance is
    taken out, plus the squared change of score of swapped sentences: every labelled sentence that names a group is
    written anew with each other name, and without one. Equal changes are counted, so the driver gets each once. Each name
    standing alone counts as a sentence too, so names that no text holds are held alike. No rows give one score for all.
    """
    support = labelled.mapInArrow(_support, "place long, clean long, toxic long").groupBy("place").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in labelled.groupBy("toxic").count().collect()}
    if len(sizes) < 2:  # nothing to tell apart: the share of toxic texts is every text's score
        share = (sizes.get(1, 0) + 0.5) / (sum(sizes.values()) + 1)
        return Model(np.zeros(1 << WIDTH_BITS), math.log(share / (1 - share)))
    share = sizes[1] / (sizes[0] + sizes[1])
    both = F.col("toxic") + F.col("clean")
    part = lambda n, p: F.when(F.col(n) > 0, F.col(n) * F.log(F.col(n) / (both * p))).otherwise(0.0)
    held = support.withColumn("surprise", 2 * (part("toxic", share) + part("clean", 1 - share)))
    best = held.filter(F.col("surprise") >= min_surprise).orderBy(F.desc("surprise"), "place").limit(max_features)
    terms = term_features(identity_terms)
    chosen = np.unique(np.concatenate([np.array([r["place"] for r in best.select("place").collect()], np.int64), *terms]))

    rows = labelled.mapInArrow(_rows_of(chosen), "toxic int, places array<int>").toArrow()
    y = rows.column("toxic").to_numpy().astype(float)
    places = rows.column("places").combine_chunks()
    each = np.where(y == 1, math.sqrt(sizes[0] / sizes[1]), 1.0)
    found = labelled.select("text").mapInArrow(_swaps(chosen, identity_terms), "lost array<int>, gained array<int>")
    changes = [(r["lost"], r["gained"], r["n"]) for r in found.groupBy("lost", "gained").agg(F.count(F.lit(1)).alias("n")).collect()]
    changes += [(lost, gained, 1) for term in identity_terms for lost, gained in swapped_sentences(*_joined([term]), identity_terms, _wanted(chosen))]
    often = np.array([n for _, _, n in changes], float)
    moved = [len(lost) + len(gained) for lost, gained, _ in changes]
    problem = Problem(
        toxic=y,
        each=each / each.sum(),
        rows=np.repeat(np.arange(len(y)), places.value_lengths().to_numpy()),
        places=np.searchsorted(chosen, places.flatten().to_numpy()),
        swaps=np.repeat(np.arange(len(changes)), moved),
        moved=np.searchsorted(chosen, np.array([f for lost, gained, _ in changes for f in (*lost, *gained)], np.int64)),
        signs=np.array([s for lost, gained, _ in changes for s in (*[-1.0] * len(lost), *[1.0] * len(gained))]),
        often=often * (penalty / max(often.sum(), 1)),
        ridge=ridge / len(y),
    )
    w, bias = np.zeros(len(chosen)), math.log(sizes[1] / sizes[0])
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, steps + 1):
        _, gradient = objective(problem, w, bias)
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        move = 0.1 * (1 - step / (steps + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-12)
        w, bias = w - move[:-1], bias - move[-1]
    weights = np.zeros(1 << WIDTH_BITS)
    weights[chosen] = w
    return Model(weights, float(bias))


def _scores(model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = model.value
        some = weights != 0
        for batch in batches:
            for rows, data, offsets in grams.pieces(batch, "text"):
                owner, places = _presence(data, offsets, some)
                score = 1 / (1 + np.exp(-np.clip(bias + np.bincount(owner, weights[places], minlength=rows.num_rows), -30, 30)))
                columns = [rows.column(c) for c in rows.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(score)], names=[*(c for c in rows.schema.names if c != "text"), "score"])

    return run


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from. A row without an id belongs to them."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, **options) -> Model:
    """Fits on the labelled documents that aren't held out: ``max_rows`` of them at most, drawn by a hash of their ids.

    Labels of one id count once (the larger one); null labels and ids take no part. Documents of one id are learned from
    each. The drawn labels, of bounded number, go to where the texts are. Empty tables give one score for all.
    """
    usable = labels.filter("doc_id is not null and toxic is not null").filter(~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).cast("int").alias("toxic"))
    drawn = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("text", "toxic")
    return fit(cut_lineage(rows), **options)  # read several times


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """doc (the row's columns), score. Any text has a score: an empty or null one that of a text without known words."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))
    rows = docs.select(F.struct("*").alias("doc"), "text")
    return rows.mapInArrow(_scores(shared), T.StructType([rows.schema["doc"], T.StructField("score", T.DoubleType())]))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, table(spark, sf_dir, "labels"))
    scored = score_toxicity(docs, model)
    return scored.select(
        "doc.doc_id", held_out(F.col("doc.doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )
