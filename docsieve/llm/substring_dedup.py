"""Repeated passages: a count-min prefilter over windows of words, then exact groups of what it finds repeated."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsieve.llm import grams
from docsieve.llm.common import table, text_key, text_of

U64 = grams.U64
NO_ID = -(1 << 63)
#: Rows of the sketch; cells of a row at most (two bits while counting, one when merged); cells of a block.
DEPTH, MOST_CELLS, BLOCK_BITS = 2, 28, 20
#: Windows that a task handles at once.
CHUNK = 1_000_000
_CELL_OF = (0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F)


def _cells(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    return ((hashes * U64(_CELL_OF[row] | 1)) >> U64(64 - bits)).astype(np.uint32)


def _pack(sorted_cells: np.ndarray) -> bytes:
    """Gaps, byte by byte of equal weight, compressed."""
    if not len(sorted_cells):
        return b""
    gaps = np.diff(sorted_cells, prepend=np.uint32(0)).astype(np.uint32)
    return zstandard.ZstdCompressor(level=1).compress(gaps.view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpack(blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, np.uint32)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint32).ravel(), dtype=np.uint32)


def _distinct_windows(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, second hash) of every text's distinct windows, sorted by hash."""
    w, _ = grams.words(data, offsets)
    places, hashes = grams.runs(w, k)
    _, second = grams.runs(w, k, grams.RUN_R2)
    owner = grams.text_of_word(w, places)
    order = np.argsort(hashes, kind="stable")  # texts stay in order among equal windows
    owner, hashes, second = owner[order], hashes[order], second[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
    return owner[new], hashes[new], second[new]


def _partial_sketches(k: int, bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts (once, more often) of the cells that a task's windows fall into; a document counts a window once."""

    def flush(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        hashes = np.concatenate(held)
        for row in range(DEPTH):
            cells = np.sort(_cells(hashes, row, bits))
            new = np.ones(len(cells), bool)
            new[1:] = cells[1:] != cells[:-1]
            at = np.flatnonzero(new)
            cells, more = cells[at], np.diff(at, append=len(cells)) > 1
            cuts = np.searchsorted(cells, np.arange(0, (1 << bits) + 1, 1 << min(bits, BLOCK_BITS), dtype=np.uint64))
            blocks = np.flatnonzero(np.diff(cuts))
            local = cells & np.uint32((1 << min(bits, BLOCK_BITS)) - 1)
            one = [_pack(local[cuts[b] : cuts[b + 1]]) for b in blocks]
            two = [_pack(local[cuts[b] : cuts[b + 1]][more[cuts[b] : cuts[b + 1]]]) for b in blocks]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(blocks), row, np.int32)), pa.array(blocks.astype(np.int32)), pa.array(one, pa.binary()), pa.array(two, pa.binary())],
                names=["row", "block", "one", "two"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for _, data, offsets in grams.pieces(batch, "text"):
                held.append(_distinct_windows(data, offsets, k)[1])
                n += len(held[-1])
                if n >= CHUNK:
                    yield from flush(held)
                    held, n = [], 0
        if n:
            yield from flush(held)

    return run


def _merged(bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds up the counts of each block, which come one after another, and tells the cells with two or more."""
    size = 1 << min(bits, BLOCK_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, once, twice = None, np.zeros(size, bool), np.zeros(size, bool)

        def done() -> pa.RecordBatch:
            blob = zstandard.ZstdCompressor(level=1).compress(np.packbits(twice, bitorder="little").tobytes())
            return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int32()), pa.array([blob], pa.binary())], names=["row", "block", "bits"])

        for batch in batches:
            for row, block, one, two in zip(*(batch.column(c).to_pylist() for c in ("row", "block", "one", "two"))):
                if (row, block) != at:
                    if at is not None:
                        yield done()
                    at = (row, block)
                    once[:], twice[:] = False, False
                cells = _unpack(one)
                twice[cells[once[cells]]] = True
                once[cells] = True
                twice[_unpack(two)] = True
        if at is not None:
            yield done()

    return run


def window_sketch(texts: DataFrame, k: int, bits: int) -> list[np.ndarray]:
    """The merged sketch: for every cell of every row, one bit that tells whether it counts two or more.

    Tasks count their own windows, equal cells of all tasks meet and are added, and the result, DEPTH * 2 ** bits bits
    whatever the input, comes to the driver block by block.
    """
    partial = texts.select("text").mapInArrow(_partial_sketches(k, bits), "row int, block int, one binary, two binary")
    merged = partial.repartition("row", "block").sortWithinPartitions("row", "block").mapInArrow(_merged(bits), "row int, block int, bits binary")
    sketch = [np.zeros((1 << bits) // 8, np.uint8) for _ in range(DEPTH)]
    size = (1 << min(bits, BLOCK_BITS)) // 8
    for row in merged.toLocalIterator():
        sketch[row["row"]][row["block"] * size : (row["block"] + 1) * size] = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(row["bits"])), np.uint8)
    return sketch


def _repeated(sketch: list[np.ndarray], hashes: np.ndarray, bits: int) -> np.ndarray:
    """False only for windows that one document alone holds."""
    found = np.ones(len(hashes), bool)
    for row in range(DEPTH):
        at = np.flatnonzero(found)
        cells = _cells(hashes[at], row, bits)
        found[at] = (sketch[row][cells >> np.uint32(3)] >> (cells & np.uint32(7)).astype(np.uint8)) & 1 > 0
    return found


def _candidates(k: int, bits: int, sketch, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Windows that the sketch finds repeated, by bucket of their hash.

    Of documents in one chunk only the smallest id that holds a window has to ask other tasks; the others know already
    that they lose it. So a passage that everybody holds is sent once a chunk.
    """

    def flush(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        ids, hashes, second = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((ids, second, hashes))
        ids, hashes, second = ids[order], hashes[order], second[order]
        new = np.ones(len(ids), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (second[1:] != second[:-1])
        first = ids[np.flatnonzero(new)[np.cumsum(new) - 1]]
        lost = ids > first
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(int(lost.sum()), -1, np.int32)), pa.array(ids[lost]), pa.array(grams.signed(hashes[lost])), pa.nulls(int(lost.sum()), pa.binary())],
            names=["bucket", "id", "window", "packed"],
        )
        ids, hashes, second = ids[new], hashes[new], second[new]
        bucket = (second >> U64(32)) % U64(buckets)
        order = np.argsort(bucket, kind="stable")  # hashes stay sorted in a bucket
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=U64))
        some = np.flatnonzero(np.diff(cuts))
        blobs = []
        for b in some:
            these = order[cuts[b] : cuts[b + 1]]
            near, place = np.unique(ids[these], return_inverse=True)
            gaps = np.diff(hashes[these], prepend=U64(0))
            planes = [x.reshape(len(these), -1).T.tobytes() for x in (gaps.view(np.uint8), second[these].astype(np.uint32).view(np.uint8), place.astype(np.uint32).view(np.uint8))]
            head = np.array([len(these), len(near)], np.int64).tobytes()
            blobs.append(zstandard.ZstdCompressor(level=1).compress(head + near.tobytes() + b"".join(planes)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(some.astype(np.int32)), pa.nulls(len(some), pa.int64()), pa.nulls(len(some), pa.int64()), pa.array(blobs, pa.binary())],
            names=["bucket", "id", "window", "packed"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for rows, data, offsets in grams.pieces(batch, "text"):
                owner, hashes, second = _distinct_windows(data, offsets, k)
                at = np.flatnonzero(_repeated(sketch.value, hashes, bits))
                held.append((rows.column("id").to_numpy()[owner[at]], hashes[at], second[at]))
                n += len(at)
                if n >= CHUNK:
                    yield from flush(held)
                    held, n = [], 0
        if n:
            yield from flush(held)

    return run


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups a bucket's windows exactly; all ids of a group but the smallest lose the window."""

    def rows(ids: np.ndarray, windows: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(grams.signed(windows))], names=["id", "window"])

    def group(blobs: list[bytes]) -> pa.RecordBatch:
        ids, hashes, second = [], [], []
        for blob in blobs:
            data = zstandard.ZstdDecompressor().decompress(blob)
            n, m = np.frombuffer(data, np.int64, 2)
            near = np.frombuffer(data, np.int64, m, 16)
            at = 16 + 8 * m

            def plane(width: int, kind, at: int) -> np.ndarray:
                return np.ascontiguousarray(np.frombuffer(data, np.uint8, n * width, at).reshape(width, n).T).view(kind).ravel()

            hashes.append(np.cumsum(plane(8, U64, at), dtype=U64))
            second.append(plane(4, np.uint32, at + 8 * n))
            ids.append(near[plane(4, np.uint32, at + 12 * n)])
        ids, hashes, second = np.concatenate(ids), np.concatenate(hashes), np.concatenate(second)
        order = np.lexsort((ids, second, hashes))
        ids, hashes, second = ids[order], hashes[order], second[order]
        new = np.ones(len(ids), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (second[1:] != second[:-1])
        lost = ids > ids[np.flatnonzero(new)[np.cumsum(new) - 1]]
        return rows(ids[lost], hashes[lost])

    bucket, held = None, []
    for batch in batches:
        for b, i, w, blob in zip(*(batch.column(c).to_pylist() for c in ("bucket", "id", "window", "packed"))):
            if b != bucket and held:
                yield group(held)
                held = []
            bucket = b
            held.append(blob)
    if held:
        yield group(held)


def _decide_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hands on what chunks have decided (bucket -1, which comes first) and decides the rest."""

    def open_ones() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            settled = pc.less(batch.column("bucket"), 0)
            done.append(batch.filter(settled).select(["id", "window"]))
            yield batch.filter(pc.invert(settled))

    done: list[pa.RecordBatch] = []
    for found in _decide(open_ones()):
        yield found
        while done:
            yield done.pop()
    yield from done


def _apply(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in grams.pieces(batch, "text"):
                w, _ = grams.words(data, offsets)
                places, hashes = grams.runs(w, k)
                owner = grams.text_of_word(w, places)
                keep = np.ones(len(w.ids), bool)
                gone = rows.column("lost")
                marks = np.zeros(len(w.ids) + 1, np.int64)
                cuts = np.searchsorted(owner, np.arange(rows.num_rows + 1))
                for i in np.flatnonzero(gone.is_valid().to_numpy(zero_copy_only=False)):
                    lost = gone[int(i)].values.to_numpy().view(U64)
                    mine = slice(cuts[i], cuts[i + 1])
                    hit = places[mine][np.isin(hashes[mine], lost)]
                    np.add.at(marks, hit, 1)
                    np.add.at(marks, hit + k, -1)
                keep = np.cumsum(marks[:-1]) == 0
                texts, removed = [], np.zeros(rows.num_rows, np.int64)
                raw = data.tobytes()
                for i in range(rows.num_rows):
                    mine = keep[w.bounds[i] : w.bounds[i + 1]]
                    parts = raw[offsets[i] : offsets[i + 1]].split()
                    if not mine.all():
                        removed[i] = len(mine) - int(mine.sum())
                        parts = [p for p, stays in zip(parts, mine.tolist()) if stays]
                    texts.append(b" ".join(parts))
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column("id"), rows.column("text_key"), pa.array(w.counts), pa.array(removed),
                        pa.array([hashlib.sha256(t).hexdigest() for t in texts]), pa.array(texts, pa.binary()).cast(pa.string()),
                    ],
                    names=["id", "text_key", "n_words", "n_removed", "kept_sha256", "kept_text"],
                )

    return run


def drop_repeated_passages(docs: DataFrame, window: int = 13) -> DataFrame:
    """doc_id, text_key, n_words, n_removed, kept_sha256, kept_text of every row.

    A word goes if a window of ``window`` words that covers it also starts in a document with a smaller id. A first pass
    adds the windows of all documents up in a count-min sketch; a cell counts a document once and never too low, so a
    window whose smallest cell is below two is in no other document. A second pass groups the others by 96 bits of hash.
    The sketch has a cell for two bytes of text, 2 ** 28 at most (32 MB a row, broadcast): beyond, more windows go
    through the exact groups, none are lost.

    Null, empty and short texts lose nothing; kept words are joined by one space. A null id counts as the smallest. Rows
    of one id are one document: they take nothing from each other. An empty table gives no rows.
    """
    text = text_of(F.col("text"))
    rows = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), text_key(text).alias("text_key"), text.alias("text"))
    spark = docs.sparkSession
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 1
    bits = min(MOST_CELLS, max(12, int(size // 2).bit_length()))
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size >> 24)
    sketch = spark.sparkContext.broadcast(window_sketch(rows, window, bits))

    asked = rows.select("id", "text").mapInArrow(_candidates(window, bits, sketch, buckets), "bucket int, id long, window long, packed binary")
    spread = F.when(F.col("bucket") < 0, F.xxhash64("id", "window")).otherwise(F.xxhash64("bucket"))
    dealt = asked.repartition(buckets, spread).sortWithinPartitions("bucket")
    lost = dealt.mapInArrow(_decide_all, "id long, window long")
    lists = lost.groupBy("id").agg(F.collect_list("window").alias("lost"))
    found = rows.join(lists, "id", "left").mapInArrow(
        _apply(window), "id long, text_key long, n_words long, n_removed long, kept_sha256 string, kept_text string"
    )
    return found.withColumn("id", F.when(F.col("id") != NO_ID, F.col("id"))).withColumnRenamed("id", "doc_id")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_passages(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")
