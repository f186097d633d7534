"""Near duplicates: a multi-index Hamming join of b-bit minwise signatures, confirmed on the full sets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsieve.llm import grams
from docsieve.llm.common import table, text_key, text_of
from docsieve.llm.components import components
from docsieve.session import cut_lineage

U64 = grams.U64
#: Symbols of a signature, bits of a symbol, symbols of a chunk, errors allowed in a chunk.
SYMBOLS, BITS, CHUNK, ERRORS = 30, 32, 3, 1
#: By pigeonhole, signatures that differ in at most this many symbols agree in some chunk but for ERRORS symbols. At
#: similarity 0.8, 20 or more of 30 symbols differ with a probability of 4e-8.
DISTANCE = (SYMBOLS // CHUNK) * (ERRORS + 1) - 1
#: Symbols of the wide signature (a byte each) by which found pairs are sifted, and those that may differ: at similarity 0.8
#: 51 of 256 do on average, and more than 88 with a probability of 1e-8.
WIDE, FAR = 256, 88
#: Rows of a block, where members of a crowded key are compared block against block.
BLOCK = 1000
#: Stands for a null id: smaller than any other.
NO_ID = -(1 << 63)

_rng = np.random.default_rng(20240607)
_MULTIPLY = _rng.integers(0, 1 << 63, SYMBOLS, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_ADD = _rng.integers(0, 1 << 63, SYMBOLS, dtype=np.int64).astype(U64)
_WIDE_MULTIPLY = _rng.integers(0, 1 << 63, WIDE // 2, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_WIDE_ADD = _rng.integers(0, 1 << 63, WIDE // 2, dtype=np.int64).astype(U64)

SETS = "id long, text_key long, n long, c binary, sig binary, wide binary"


def shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct shingles of every text, sorted. A text of fewer than ``k`` words has its whole sequence."""
    w, _ = grams.words(data, offsets, lower=True)
    places, hashes = grams.runs(w, k)
    owner = grams.text_of_word(w, places)
    few = np.flatnonzero((w.counts > 0) & (w.counts < k))
    for n in np.unique(w.counts[few]):
        these = few[w.counts[few] == n]
        first = w.bounds[these]
        h = np.zeros(len(these), U64)
        for j in range(n):
            h = h * U64(grams.RUN_R) + w.ids[first + j]
        owner, hashes = np.concatenate([owner, these]), np.concatenate([hashes, grams.mix64(h + U64(n))])
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
    return owner[new], hashes[new]


def _signatures(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in grams.pieces(batch, "text"):
                owner, hashes = shingles(data, offsets, k)
                n = np.bincount(owner, minlength=rows.num_rows)
                some = np.flatnonzero(n)
                sig = np.zeros((rows.num_rows, SYMBOLS), np.uint32)
                wide = np.zeros((rows.num_rows, WIDE), np.uint8)
                whole = np.zeros((rows.num_rows, 2), U64)
                if len(some):
                    at = np.searchsorted(owner, some)
                    for j in range(SYMBOLS):
                        sig[some, j] = (grams.mix64(np.minimum.reduceat(hashes * _MULTIPLY[j] + _ADD[j], at)) >> U64(64 - BITS)).astype(np.uint32)
                    for j in range(WIDE // 2):  # both halves of a product serve as a hash
                        halves = (hashes * _WIDE_MULTIPLY[j] + _WIDE_ADD[j]).view(np.uint32).reshape(-1, 2)
                        least = np.minimum.reduceat(halves, at, axis=0) * np.uint32(0x9E3779B1)
                        wide[some, 2 * j : 2 * j + 2] = (least >> np.uint32(24)).astype(np.uint8)
                    whole[some, 0] = grams.mix64(np.add.reduceat(grams.mix64(hashes + U64(1)), at) + n[some].astype(U64))
                    whole[some, 1] = grams.mix64(np.add.reduceat(grams.mix64(hashes ^ U64(grams.RUN_R2)), at))
                ends = np.arange(rows.num_rows + 1)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("id"), rows.column("text_key"), pa.array(n.astype(np.int64)), grams.binaries(whole.ravel(), ends * 2), grams.binaries(sig.ravel(), ends * SYMBOLS), grams.binaries(wide.ravel(), ends * WIDE)],
                    names=["id", "text_key", "n", "c", "sig", "wide"],
                )

    return run


def _chunk_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each chunk of a signature and each set of ERRORS (1) symbols that may be wrong there: the others, hashed."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column("id").to_numpy(zero_copy_only=False)
        sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(-1, SYMBOLS).astype(U64)
        keys = np.empty((len(ids), SYMBOLS), U64)
        for j in range(SYMBOLS):  # symbol j is the wrong one
            first = j - j % CHUNK
            h = np.full(len(ids), j + 1, U64)
            for i in range(first, first + CHUNK):
                if i != j:
                    h = grams.mix64(h * U64(grams.RUN_R) + sig[:, i])
            keys[:, j] = h
        yield pa.RecordBatch.from_arrays([pa.array(grams.signed(keys.ravel())), pa.array(np.repeat(ids, SYMBOLS))], names=["key", "id"])


def _alike(k: int, percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Keeps the pairs whose full sets are alike enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"])
            keep = np.zeros(batch.num_rows, bool)
            at = 0
            for rows, left, cuts in grams.pieces(batch, "left"):
                these = rows.column("right")
                _, right, right_cuts = next(grams.pieces(pa.RecordBatch.from_arrays([these], names=["right"]), "right", 1 << 62))
                o1, h1 = shingles(left, cuts, k)
                o2, h2 = shingles(right, right_cuts, k)
                owner, hashes = np.concatenate([o1, o2]), np.concatenate([h1, h2])
                order = np.lexsort((hashes, owner))
                owner, hashes = owner[order], hashes[order]
                both = np.bincount(owner[1:][(owner[1:] == owner[:-1]) & (hashes[1:] == hashes[:-1])], minlength=rows.num_rows)
                union = np.bincount(owner, minlength=rows.num_rows) - both
                keep[at : at + rows.num_rows] = (both * 100 >= union * percent) & (both > 0)
                at += rows.num_rows
            yield pair.filter(pa.array(keep))

    return run


def _confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    left = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("left")), "a")
    both = left.join(texts.select(F.col("id").alias("b"), F.col("text").alias("right")), "b").select("a", "b", "left", "right")
    return both.mapInArrow(_alike(k, percent), "a long, b long")


def _wide(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, WIDE)


def _sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps the pairs whose wide signatures are near enough."""
    for batch in batches:
        near = (_wide(batch.column("left")) != _wide(batch.column("right"))).sum(axis=1) <= FAR
        yield batch.select(["a", "b"]).filter(pa.array(near))


def _sets(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in grams.pieces(batch, "text"):
                owner, hashes = shingles(data, offsets, k)
                cuts = np.searchsorted(owner, np.arange(rows.num_rows + 1))
                yield pa.RecordBatch.from_arrays([rows.column("id"), grams.binaries(hashes, cuts)], names=["id", "shingles"])

    return run


def _links_across(percent: int) -> Callable[[pa.Table], pa.Table]:
    """Of one block against another (or itself): which components are linked, by their labels. Wide signatures sift, full
    sets decide, and what has been joined isn't compared again, so few links stand for many."""

    def run(part: pa.Table) -> pa.Table:
        ids = part.column("id").to_numpy()
        joined = dict(zip(part.column("label").to_pylist(), part.column("label").to_pylist()))

        def root(label: int) -> int:
            while joined[label] != label:
                joined[label] = joined[joined[label]]
                label = joined[label]
            return label

        given = labels = part.column("label").to_numpy()
        block, one, other = (part.column(c).to_numpy() for c in ("block", "one", "other"))
        wide = _wide(part.column("wide"))
        sets = [np.frombuffer(x, U64) for x in part.column("shingles").to_pylist()]
        sizes = np.array([len(x) for x in sets])
        left, right = np.flatnonzero(block == one), np.flatnonzero(block == other)
        lows, highs = [], []
        for i in left:
            near = right[(labels[right] != labels[i]) & ((ids[right] > ids[i]) | (one[0] != other[0]))]
            near = near[(sizes[near] * 100 >= sizes[i] * percent) & (sizes[i] * 100 >= sizes[near] * percent)]
            near = near[(wide[near] != wide[i]).sum(axis=1) <= FAR]
            if not len(near):
                continue
            every = np.concatenate([sets[j] for j in near])
            at = np.minimum(np.searchsorted(sets[i], every), sizes[i] - 1)
            both = np.add.reduceat((sets[i][at] == every).astype(np.int64), np.cumsum([0, *sizes[near][:-1]]))
            for j in near[both * 100 >= (sizes[near] + sizes[i] - both) * percent]:
                x, y = root(labels[i]), root(labels[j])
                if x != y:
                    joined[max(x, y)] = min(x, y)
                    lows.append(min(given[i], given[j]))
                    highs.append(max(given[i], given[j]))
            if len(lows) and len(lows) % 64 == 0:
                labels = np.array([root(x) for x in labels.tolist()])
        return pa.table({"a": np.array(lows, np.int64), "b": np.array(highs, np.int64)})

    return run


def grouped(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """id (NO_ID for null), text_key, n, component of every row.

    Rows with equal shingle sets are one class, named by its smallest id. Signatures of classes meet under chunk keys, so
    every pair within DISTANCE shares one. In a key's group each class is first compared with one of them, the hub: the one
    that meets others most often, as an original does among its copies. What is alike forms components. Only where the
    groups of a hub then still hold several components are their members compared across components, block against block;
    only links leave such a task. So a group of n near copies costs n comparisons of texts, no link between components is
    lost, and no table of pairs grows with the square of a group. Every comparison ends on the full sets of both texts.
    """
    rows = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), text_key(text_of(F.col("text"))).alias("text_key"), text_of(F.col("text")).alias("text"))
    members = cut_lineage(rows.mapInArrow(_signatures(words), SETS))
    some = members.filter("n > 0")
    classes = cut_lineage(some.groupBy("c", "sig", "wide").agg(F.min("id").alias("id")))
    wides = classes.select("id", "wide")

    keys = classes.mapInArrow(_chunk_keys, "key long, id long").distinct()
    shared = keys.groupBy("key").agg((F.count(F.lit(1)) - 1).alias("others")).filter("others > 0")
    meeting = cut_lineage(keys.join(shared, "key"))
    ranked = meeting.join(meeting.groupBy("id").agg(F.sum("others").alias("met")), "id").select("key", "id", "met")
    hubs = ranked.groupBy("key").agg(F.max(F.struct("met", F.bitwise_not("id").alias("turned"))).alias("_hub")).select("key", F.bitwise_not("_hub.turned").alias("hub"))
    stars = cut_lineage(meeting.join(hubs, "key").select("hub", "id").distinct())

    found = stars.select("id").distinct()  # a hub is a member of its own star
    texts = cut_lineage(rows.select("id", "text").join(found, "id", "left_semi"))
    sifted = stars.filter("hub <> id").select(F.least("hub", "id").alias("a"), F.greatest("hub", "id").alias("b")).distinct()
    sifted = sifted.join(wides.select(F.col("id").alias("a"), F.col("wide").alias("left")), "a")
    sifted = sifted.join(wides.select(F.col("id").alias("b"), F.col("wide").alias("right")), "b").mapInArrow(_sift, "a long, b long").distinct()
    links = cut_lineage(_confirmed(sifted, texts, words, percent))
    labels = components(links)

    named = stars.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    mixed = named.groupBy("hub").agg(F.min("label").alias("_lo"), F.max("label").alias("_hi"), F.count(F.lit(1)).alias("_n")).filter("_lo < _hi")
    blocks = F.ceil(F.col("_n") / BLOCK).cast("int")
    crowd = named.join(mixed, "hub").withColumns({"_blocks": blocks, "block": F.pmod(F.xxhash64("id"), blocks).cast("int")})
    crowd = crowd.select("hub", "id", "label", "block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_with"))
    crowd = crowd.select("hub", "id", "label", "block", F.least("block", "_with").alias("one"), F.greatest("block", "_with").alias("other"))
    crowd = crowd.join(wides, "id").join(texts.mapInArrow(_sets(words), "id long, shingles binary"), "id")
    across = crowd.groupBy("hub", "one", "other").applyInArrow(_links_across(percent), "a long, b long")

    of_class = some.join(classes.select("c", F.col("id").alias("class_id")), "c")  # sets are told apart by 128 bits
    named = of_class.join(labels.withColumnRenamed("id", "class_id"), "class_id", "left").select("id", F.coalesce("label", "class_id").alias("label"))
    twice = named.groupBy("id").agg(F.min("label").alias("a"), F.max("label").alias("b")).filter("a < b")
    twice = named.join(twice.select("id", "a"), "id").filter("a < label").select("a", F.col("label").alias("b"))
    joined = components(across.union(twice)).toDF("label", "_joined")  # components of components
    first = labels.join(joined, "label", "left").select(F.col("id").alias("class_id"), F.coalesce("_joined", "label").alias("label"))
    alone = joined.select(F.col("label").alias("class_id"), F.col("_joined").alias("label"))  # had no link before
    labels = first.union(alone.join(labels.select(F.col("id").alias("class_id")), "class_id", "left_anti"))

    found = members.join(classes.select("c", F.col("id").alias("class_id")), "c", "left").join(labels, "class_id", "left")
    return found.select("id", "text_key", "n", F.when(F.col("n") == 0, F.col("id")).otherwise(F.coalesce("label", "class_id", "id")).alias("component"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id, kept of every row.

    Two texts are linked if the sets of their distinct shingles of ``words`` words (A-Z in lower case; a text of fewer words
    has its whole sequence) share ``percent`` of their union. A component is what links connect, named by its smallest id.

    Null, empty and blank texts have no shingles and are linked with nothing. Rows of one id are one document, so what
    either is linked with is linked. A null id counts as the smallest. ``kept`` is true where the id is its component's
    smallest. An empty table gives no rows.
    """
    named = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return grouped(docs, words, percent).select(
        named("id").alias("doc_id"), "text_key", F.col("n").alias("n_shingles"), named("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept")
    )


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component, and of repeated rows, in the struct ``doc``."""
    rows = docs.select(F.struct("*").alias("doc"), F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), text_key(text_of(F.col("text"))).alias("text_key"))
    kept = grouped(docs.select("doc_id", "text"), words, percent).filter("id = component").select("id", "text_key")
    return rows.join(kept, ["id", "text_key"], "left_semi").dropDuplicates(["id", "text_key"]).select("doc")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80).select("doc_id", "n_shingles", "component_id", "kept")
