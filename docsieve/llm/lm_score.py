"""Stupid-backoff scores of documents, from counts of their own corpus without the scored document."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsieve.llm import grams
from docsieve.llm.common import table, text_key, text_of

U64 = grams.U64
NO_ID = -(1 << 63)
#: Factor for each step back, bytes of text in a chunk, and sketch cells for each n-gram of the corpus.
BACKOFF, CHUNK_BYTES, LOAD = 0.4, 12 << 20, 16

#: What chunks and buckets of hashes tell each other. A chunk's distinct n-grams of a bucket always come in the order of
#: their hashes, so answers need no names.
SKETCH, MARKS = "chunk int, bucket int, cells binary", "chunk int, bucket int, marks binary"
ASK, ANSWER = "chunk int, bucket int, rests binary", "chunk int, bucket int, marks binary, counts binary"


def _pack(values: np.ndarray) -> bytes:
    """Byte by byte of equal weight, compressed."""
    size = values.dtype.itemsize
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, size).T).tobytes())


def _unpack(blob: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(size, -1).T).view(kind).ravel()


class Grams:
    """All n-grams of some texts, by order: at each word the hash of the n-gram that ends there (of shorter ones at a
    text's beginning there is none)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, order: int):
        w, _ = grams.words(data, offsets, lower=True)
        self.words, self.owner = w, np.repeat(np.arange(len(offsets) - 1), w.counts)
        self.hashes = [np.zeros(len(w.ids), U64) for _ in range(order)]
        self.exists = [np.zeros(len(w.ids), bool) for _ in range(order)]
        for k in range(1, order + 1):
            places, found = grams.runs(w, k)
            self.hashes[k - 1][places + k - 1] = found
            self.exists[k - 1][places + k - 1] = True

    def all(self) -> np.ndarray:
        return np.concatenate([h[e] for h, e in zip(self.hashes, self.exists)])


def _both(one: np.ndarray, two: np.ndarray) -> bytes:
    first = _pack(one)
    return len(first).to_bytes(8, "little") + first + _pack(two)


def _unboth(blob: bytes, one, two) -> tuple[np.ndarray, np.ndarray]:
    size = int.from_bytes(blob[:8], "little")
    return _unpack(blob[8 : 8 + size], one), _unpack(blob[8 + size :], two)


def _parsed(texts: pa.Table, order: int) -> list[tuple[pa.RecordBatch, Grams]]:
    return [(rows, Grams(data, offsets, order)) for batch in texts.combine_chunks().to_batches() for rows, data, offsets in grams.pieces(batch, "text")]


def _distinct(texts: pa.Table, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The chunk's n-grams in the order of their hashes, and how often it holds each."""
    held = [np.zeros(0, U64)]
    for batch in texts.combine_chunks().to_batches():
        held.extend(Grams(data, offsets, order).all() for _, data, offsets in grams.pieces(batch, "text"))
    return np.unique(np.concatenate(held), return_counts=True)


def _cells(hashes: np.ndarray, bits: int) -> np.ndarray:
    return hashes >> U64(64 - bits)


def _cuts(cells: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    """Where each bucket, an equal range of cells, begins and ends in sorted cells."""
    return np.searchsorted(cells, np.array([(b << bits) // buckets for b in range(buckets + 1)], U64))


def _table(schema: str, *columns: list) -> pa.Table:
    kinds = {"int": pa.int32(), "binary": pa.binary()}
    fields = [field.split() for field in schema.split(", ")]
    return pa.table({name: pa.array(column, kinds[kind]) for (name, kind), column in zip(fields, columns)})


def _sketch(order: int, bits: int, buckets: int) -> Callable[[tuple, pa.Table], pa.Table]:
    """Explodes a chunk's texts into n-grams and deals the cells of the distinct ones out, with a mark where the chunk holds
    the n-gram more than once."""

    def run(key: tuple, texts: pa.Table) -> pa.Table:
        hashes, counts = _distinct(texts, order)
        cells = _cells(hashes, bits)
        cuts = _cuts(cells, bits, buckets)
        some = np.flatnonzero(np.diff(cuts)).tolist()
        packed = [_both(np.diff(cells[cuts[b] : cuts[b + 1]], prepend=U64(0)), (counts[cuts[b] : cuts[b + 1]] > 1).view(np.uint8)) for b in some]
        return _table(SKETCH, [key[0].as_py()] * len(some), some, packed)

    return run


def _marked(sketches: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(chunk, cells, marks) of a bucket: a mark where all chunks together fill the cell more than once. Only an n-gram that
    the corpus holds once can be without one."""
    chunks = sketches.column("chunk").to_pylist()
    sent = []
    for blob in sketches.column("cells").to_pylist():
        gaps, more = _unboth(blob, U64, np.uint8)
        sent.append((np.cumsum(gaps, dtype=U64), more > 0))
    every = np.sort(np.concatenate([np.zeros(0, U64), *(c for c, _ in sent), *(c[m] for c, m in sent)]))
    many = np.unique(every[1:][every[1:] == every[:-1]])
    for chunk, (cells, _) in zip(chunks, sent):
        at = np.searchsorted(many, cells)
        yield chunk, cells, np.concatenate([many, [~U64(0)]])[at] == cells


def _mark(sketches: pa.Table) -> pa.Table:
    found = [(chunk, _pack(np.packbits(marks))) for chunk, _, marks in _marked(sketches)]
    return _table(MARKS, [c for c, _ in found], sketches.column("bucket").to_pylist(), [m for _, m in found])


def _read_marks(answers: pa.Table, cuts: np.ndarray) -> np.ndarray:
    marks = np.zeros(cuts[-1], bool)
    for b, blob in zip(answers.column("bucket").to_pylist(), answers.column("marks").to_pylist()):
        marks[cuts[b] : cuts[b + 1]] = np.unpackbits(_unpack(blob, np.uint8), count=cuts[b + 1] - cuts[b])
    return marks


def _ask(order: int, bits: int, buckets: int) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    """Deals out what the cells leave open of the marked n-grams' hashes, and their counts."""

    def run(key: tuple, texts: pa.Table, answers: pa.Table) -> pa.Table:
        hashes, counts = _distinct(texts, order)
        cuts = _cuts(_cells(hashes, bits), bits, buckets)
        marks = _read_marks(answers, cuts)
        rests, counts = hashes & U64((1 << (64 - bits)) - 1), counts.astype(np.uint32)
        chosen = [(b, slice(cuts[b], cuts[b + 1])) for b in np.flatnonzero(np.diff(cuts)).tolist()]
        chosen = [(b, s) for b, s in chosen if marks[s].any()]
        packed = [_both(rests[s][marks[s]], counts[s][marks[s]]) for _, s in chosen]
        return _table(ASK, [key[0].as_py()] * len(chosen), [b for b, _ in chosen], packed)

    return run


def _answer(bits: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The count table of a bucket: adds the marked n-grams of all chunks up and joins the sums back to what each asked."""

    def run(sketches: pa.Table, asks: pa.Table) -> pa.Table:
        asked = dict(zip(asks.column("chunk").to_pylist(), asks.column("rests").to_pylist()))
        parts, rows = [], []
        for chunk, cells, marks in _marked(sketches):
            if chunk in asked:
                rests, counts = _unboth(asked[chunk], U64, np.uint32)
                parts.append(((cells[marks] << U64(64 - bits)) | rests, counts))
                rows.append((chunk, _pack(np.packbits(marks))))
        if not rows:
            return _table(ANSWER, [], [], [], [])
        hashes = np.concatenate([h for h, _ in parts])
        by = np.argsort(hashes)
        hashes, counts = hashes[by], np.concatenate([c for _, c in parts])[by].astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
        hashes, counts = hashes[first], np.add.reduceat(counts, first)
        found = [_pack(counts[np.searchsorted(hashes, h)]) for h, _ in parts]
        return _table(ANSWER, [c for c, _ in rows], [asks.column("bucket")[0].as_py()] * len(rows), [m for _, m in rows], found)

    return run


def _others(parts: list[tuple[pa.RecordBatch, Grams]], answers: pa.Table, bits: int, buckets: int) -> np.ndarray:
    """How often other documents hold each n-gram, in the order of ``Grams.all`` over the parts."""
    every = np.concatenate([g.all() for _, g in parts])
    before = np.cumsum([0, *(rows.num_rows for rows, _ in parts)])
    owner = np.concatenate([g.owner[e].astype(np.int32) + np.int32(at) for at, (_, g) in zip(before, parts) for e in g.exists])
    by = np.argsort(every, kind="stable")  # equal n-grams stay in the order of their texts
    every, owner = every[by], owner[by]
    fresh = np.ones(len(every), bool)
    fresh[1:] = every[1:] != every[:-1]
    cuts = _cuts(_cells(every[fresh], bits), bits, buckets)
    marks = _read_marks(answers, cuts)
    total = np.zeros(len(marks), np.int64)
    for b, blob in zip(answers.column("bucket").to_pylist(), answers.column("counts").to_pylist()):
        here = total[cuts[b] : cuts[b + 1]]
        here[marks[cuts[b] : cuts[b + 1]]] = _unpack(blob, np.int64)
    which = np.cumsum(fresh, dtype=np.int32) - 1
    fresh[1:] |= owner[1:] != owner[:-1]
    first = np.flatnonzero(fresh)
    left = np.where(marks[which[first]], total[which[first]] - np.diff(first, append=len(every)), 0)
    others = np.zeros(len(every))
    others[by] = left[np.cumsum(fresh, dtype=np.int32) - 1]
    return others


def _score(order: int, backoff: float, total: int, bits: int, buckets: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    schema = pa.schema([("id", pa.int64()), ("text_key", pa.int64()), ("n_words", pa.int64()), ("log_score", pa.float64())])

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        parts = _parsed(texts, order)
        if not parts:
            return schema.empty_table()
        others, at, out = _others(parts, answers, bits, buckets), 0, []
        for rows, g in parts:
            by_order = []
            for e in g.exists:
                held = int(e.sum())
                by_order.append(np.zeros(len(e)))
                by_order[-1][e] = others[at : at + held]
                at += held
            out.append(one(rows, g, by_order))
        return pa.concat_tables(out)

    def one(rows: pa.RecordBatch, g: Grams, others: list[np.ndarray]) -> pa.Table:
        sizes = g.words.counts
        rest = np.maximum(total - sizes[g.owner], 1)
        score = np.log(np.maximum(others[0], 0.5) / rest) + (order - 1) * math.log(backoff)
        for k in range(2, order + 1):  # longer n-grams win where others hold them
            context = np.zeros(len(g.owner))
            context[1:] = others[k - 2][:-1]
            seen = others[k - 1] > 0
            score = np.where(seen, np.log(np.maximum(others[k - 1], 1) / np.maximum(context, 1)) + (order - k) * math.log(backoff), score)
        sums = np.bincount(g.owner, score, minlength=rows.num_rows)
        return pa.table([rows.column("id"), rows.column("text_key"), pa.array(sizes), pa.array(sums)], schema=schema)

    return run


def backoff_scores(docs: DataFrame, order: int = 2, backoff: float = BACKOFF) -> DataFrame:
    """doc_id, text_key, n_words, log_score, per_word of every row.

    A word's score is c(n-gram) / c(context) for the longest n-gram up to ``order`` that other documents hold, times
    ``backoff`` for each order stepped back from; a word alone has c(word) / words, and one that no other document
    holds counts as half an occurrence. Counts are those of all documents less the scored one's own, or else every n-gram
    would be known. Words are in lower case (A-Z).

    Documents are dealt to chunks by hash, one partition for each of them. A chunk explodes its texts and sends the first
    bits of each distinct n-gram's hash, its cell, to the bucket of that range of cells. A bucket marks the cells that the
    corpus fills more than once; an n-gram without a mark occurs once in all, so no other document holds it. Of the marked
    ones the chunk sends the rest of the hash and the count; the bucket's table adds the counts up and is joined to what
    each chunk asked; scores are summed per document where the texts are. A frequent n-gram is sent once a chunk, so no
    key is hot. Cells grow with the corpus (``LOAD`` for each n-gram), so few marks are idle at any size. A text
    longer than a chunk is read by one task.

    Null, empty and blank texts have no words, log_score 0 and per_word null. Repeated rows and rows of one id are
    documents of their own, and know each other's n-grams. A null id is kept. An empty table gives no rows.
    """
    rows = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), text_key(text_of(F.col("text"))).alias("text_key"), text_of(F.col("text")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("bytes"), F.sum(F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))).alias("words")).first()
    spark = docs.sparkSession
    parts = max(1, (size["bytes"] or 0) // CHUNK_BYTES)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), parts)
    bits = min(60, max(8, (LOAD * order * (size["words"] or 1)).bit_length()))
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("id", "text_key"), F.lit(parts)).cast("int")).repartition(buckets, "chunk")
    sketches = dealt.groupBy("chunk").applyInArrow(_sketch(order, bits, buckets), SKETCH).repartition(buckets, "bucket")
    marks = sketches.groupBy("bucket").applyInArrow(_mark, MARKS)
    asks = dealt.groupBy("chunk").cogroup(marks.groupBy("chunk")).applyInArrow(_ask(order, bits, buckets), ASK)
    answers = sketches.groupBy("bucket").cogroup(asks.groupBy("bucket")).applyInArrow(_answer(bits), ANSWER)
    scored = dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        _score(order, backoff, size["words"] or 0, bits, buckets), "id long, text_key long, n_words long, log_score double"
    )
    return scored.select(
        F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "text_key", "n_words", "log_score",
        F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")).alias("per_word"),
    )


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff_scores(table(spark, sf_dir, "documents"), order=3).select("doc_id", "n_words", "log_score", "per_word")
