"""N-gram Jaccard join: size-banded tiles, hashed bitmaps whose bit counts bound the overlap, sorted arrays that decide."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsieve.llm import grams
from docsieve.llm.common import table, text_key, text_of
from docsieve.llm.components import components
from docsieve.session import cut_lineage

U64 = grams.U64
#: Bits of a bitmap signature, rows and shingles of a tile at most (one row at least).
BITS, TILE_ROWS, TILE_SHINGLES = 2048, 512, 2_000_000
#: Ids that may be broadcast to pick the texts of candidates; more of them are joined by a shuffle.
BROADCAST_IDS = 2_000_000
#: Stands for a null id: smaller than any other.
NO_ID = -(1 << 63)

_BIT_R, _CLASS_R, _PART_R = U64(0x9FB21C651E98DF25), U64(0xA24BAED4963EE407), U64(0xC2B2AE3D27D4EB4F)
MEMBERS = "id long, text_key long, n long, c1 long, c2 long, bits binary, keys binary"


# --- sizes -----------------------------------------------------------------------------------------------------------


def edges(percent: int, largest: int) -> np.ndarray:
    """First size of each band. What a set of band b can be linked with lies in bands b - 1, b and b + 1."""
    found = [1]
    while found[-1] <= largest:
        found.append(found[-1] * 100 // percent + 1)
    return np.array([*found, found[-1] * 100 // percent + 1, (found[-1] * 100 // percent + 1) * 100 // percent + 1], np.int64)


@cache
def _grid() -> np.ndarray:
    """Numbers of parts that are used, half as many again from one to the next."""
    found = [1]
    while found[-1] < 1 << 40:
        found.append(max(found[-1] + 1, found[-1] * 3 // 2))
    return np.array(found, np.int64)


def parts_of(sizes: np.ndarray, percent: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """How often sets of these sizes are cut in parts: twice (parts, parts that may be left out), zero where not at all.

    Linked sets of a band, or of neighbouring bands b and b + 1, differ in at most D(b) shingles, so of more than D(b) parts
    one is the same in both. A set meets its own band and the next in P(b) parts, the band before in P(b - 1), where P(b)
    is the next number of the grid above D(b): one cut serves where both are equal. Each set may leave out half of the parts
    beyond D(b) + 1; a pair still has one that neither left out. Sets that can't differ are equal, so need no part.
    """
    at = edges(percent, int(sizes.max(initial=1)))
    differ = 2 * (at[2:] - 1) * (100 - percent) // (100 + percent)  # D(b): both sets as large as band b + 1 allows
    cut = np.where(differ > 0, _grid()[np.searchsorted(_grid(), differ + 1)], 0)
    band = np.searchsorted(at, sizes, side="right") - 1
    before = np.maximum(band - 1, 0)
    spare = lambda b: np.maximum(cut[b] - differ[b] - 1, 0) // 2
    other = np.where((band > 0) & (cut[before] != cut[band]), cut[before], 0)
    return [(cut[band], spare(band)), (other, spare(before))]


# --- sets ------------------------------------------------------------------------------------------------------------


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct shingles of every text, sorted. Fewer than ``k`` words are one shingle."""
    w, _ = grams.words(data, offsets, lower=True)
    places, hashes = grams.runs(w, k)
    owner = grams.text_of_word(w, places)
    for n in range(1, k):
        few = np.flatnonzero(w.counts == n)
        if len(few):
            short = grams.mix64(sum((w.ids[w.bounds[few] + j] * U64(pow(grams.RUN_R, j + 1, 1 << 64)) for j in range(n)), U64(n)))
            owner, hashes = np.concatenate([owner, few]), np.concatenate([hashes, short])
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
    return owner[new], hashes[new]


def bitmaps(owner: np.ndarray, hashes: np.ndarray, rows: int) -> np.ndarray:
    """One bitmap a row: every shingle turns over the bit that it hashes to. So two bitmaps differ in no more bits than
    their sets differ in shingles."""
    bit = (grams.mix64(hashes * _BIT_R) & U64(BITS - 1)).astype(np.int64)
    odd = np.bincount(owner * BITS + bit, minlength=rows * BITS).astype(np.uint8) & np.uint8(1)
    return np.packbits(odd.reshape(rows, BITS), axis=1)


def part_keys(owner: np.ndarray, hashes: np.ndarray, cuts: np.ndarray, spare: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of the parts of every row's set but for the ``spare`` smallest ones, ``cuts`` parts in all.

    A shingle's part is a range of its hash, so the parts of a sorted set are stretches of it. A key tells the number of
    parts, the part and the shingles in it.
    """
    starts = np.cumsum(cuts) - cuts
    use = cuts[owner] > 0
    owner, hashes = owner[use], hashes[use]
    part = ((hashes >> U64(32)) * cuts[owner].astype(U64) >> U64(32)).astype(np.int64)
    slot = starts[owner] + part
    total = int(cuts.sum())
    filled = np.bincount(slot, minlength=total)
    sums = np.zeros(len(hashes) + 1, U64)
    np.cumsum(grams.mix64(hashes ^ _PART_R), out=sums[1:])
    ends = np.cumsum(filled)  # slots come in the order of the sorted sets
    content = sums[ends] - sums[ends - filled]
    row = np.repeat(np.arange(len(cuts)), cuts)
    number = np.arange(total) - starts[row]
    order = np.lexsort((filled, row))  # smallest parts first
    kept = order[(np.arange(total) - starts[row[order]]) >= spare[row[order]]]
    key = grams.mix64(content[kept] + grams.mix64(number[kept].astype(U64) * _PART_R + cuts[row[kept]].astype(U64) * _CLASS_R))
    return row[kept], key


def _members(k: int, percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in grams.pieces(batch, "text"):
                owner, hashes = shingle_sets(data, offsets, k)
                n = np.bincount(owner, minlength=rows.num_rows)
                ends = np.cumsum(n)
                halves = []
                for turn in (_CLASS_R, _PART_R):
                    sums = np.zeros(len(hashes) + 1, U64)
                    np.cumsum(grams.mix64(hashes * turn + U64(1)), out=sums[1:])
                    halves.append(grams.mix64(sums[ends] - sums[ends - n] + n.astype(U64)))
                bits = np.concatenate([bitmaps(owner[a:b] - low, hashes[a:b], min(256, rows.num_rows - low)) for low in range(0, rows.num_rows, 256) for a, b in [np.searchsorted(owner, (low, low + 256))]])
                found = [part_keys(owner, hashes, cuts, spare) for cuts, spare in parts_of(n, percent)]
                row, key = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
                order = np.argsort(row, kind="stable")
                cuts = np.searchsorted(row[order], np.arange(rows.num_rows + 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column("id"), rows.column("text_key"), pa.array(n.astype(np.int64)), *[pa.array(grams.signed(h)) for h in halves],
                        grams.binaries(bits.ravel(), np.arange(rows.num_rows + 1) * (BITS // 8)), grams.binaries(key[order], cuts),
                    ],
                    names=["id", "text_key", "n", "c1", "c2", "bits", "keys"],
                )

    return run


def _each_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = batch.column("keys").to_pylist()
        count = np.array([len(x) // 8 for x in raw], np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(raw), np.int64)), pa.array(np.repeat(batch.column("c1").to_numpy(), count))], names=["key", "c"])


def _sets(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in grams.pieces(batch, "text"):
                owner, hashes = shingle_sets(data, offsets, k)
                yield pa.RecordBatch.from_arrays([rows.column("c"), grams.binaries(hashes, np.searchsorted(owner, np.arange(rows.num_rows + 1)))], names=["c", "shingles"])

    return run


# --- comparing -------------------------------------------------------------------------------------------------------


def may_link(n: np.ndarray, m: np.ndarray, differ: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of ``n`` and ``m`` shingles whose bitmaps differ in ``differ`` bits can be linked: the overlap is at most
    half of what is left of both sizes."""
    return ((n + m - differ) // 2) * (100 + percent) >= percent * (n + m)


def linked(n: np.ndarray, m: np.ndarray, both: np.ndarray, percent: int) -> np.ndarray:
    return both * 100 >= percent * (n + m - both)


def _bits(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), U64).reshape(-1, BITS // 64)


def _sift(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Keeps the pairs that bit counts don't exclude."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                differ = np.bitwise_count(_bits(batch.column("left")) ^ _bits(batch.column("right"))).sum(axis=1, dtype=np.int64)
                near = may_link(batch.column("n").to_numpy(), batch.column("m").to_numpy(), differ, percent)
                yield batch.select(["a", "b"]).filter(pa.array(near))

    return run


def _overlap(one: np.ndarray, other: np.ndarray) -> int:
    """Common values of two sorted arrays."""
    both = np.sort(np.concatenate([one, other]), kind="stable")  # merges the two sorted runs
    return int((both[1:] == both[:-1]).sum())


def _decide(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Keeps the pairs whose whole sets are alike enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for one, other in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist()):
                one, other = np.frombuffer(one, U64), np.frombuffer(other, U64)
                keep.append(bool(linked(len(one), len(other), _overlap(one, other), percent)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _near_in_tiles(part: pa.Table, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """Of two tiles (or one with itself): each row of the first and the rows of the second that bit counts don't exclude and
    that aren't known to be connected."""
    tile, one, other, label, n = (part.column(c).to_numpy() for c in ("tile", "one", "other", "label", "n"))
    bits = _bits(part.column("bits"))
    left, right = np.flatnonzero(tile == one), np.flatnonzero(tile == other)
    for at, i in enumerate(left):
        rest = right[at + 1 :] if one[0] == other[0] else right
        rest = rest[label[rest] != label[i]]
        rest = rest[may_link(n[rest], n[i], np.abs(n[rest] - n[i]), percent)]
        differ = np.bitwise_count(bits[rest] ^ bits[i]).sum(axis=1, dtype=np.int64)
        rest = rest[may_link(n[rest], n[i], differ, percent)]
        if len(rest):
            yield i, rest


def _sift_tiles(percent: int) -> Callable[[pa.Table], pa.Table]:
    """The rows of a pair of tiles whose sets have to be looked at."""

    def run(part: pa.Table) -> pa.Table:
        wanted = np.zeros(part.num_rows, bool)
        for i, rest in _near_in_tiles(part, percent):
            wanted[i] = wanted[rest] = True
        return part.filter(pa.array(wanted))

    return run


def _decide_tiles(percent: int) -> Callable[[pa.Table], pa.Table]:
    """Which labels are linked between two tiles. What has been joined isn't compared again, so few links stand for many."""

    def run(part: pa.Table) -> pa.Table:
        sets = [np.frombuffer(x, U64) for x in part.column("shingles").to_pylist()]
        labels = part.column("label").to_pylist()
        joined = {x: x for x in labels}

        def root(x: int) -> int:
            while joined[x] != x:
                joined[x] = joined[joined[x]]
                x = joined[x]
            return x

        found = []
        for i, rest in _near_in_tiles(part, percent):
            for j in rest.tolist():
                x, y = root(labels[i]), root(labels[j])
                if x != y and linked(len(sets[i]), len(sets[j]), _overlap(sets[i], sets[j]), percent):
                    joined[max(x, y)] = min(x, y)
                    found.append((labels[i], labels[j]))
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return run


def _tile_pairs(crowd: DataFrame, percent: int) -> DataFrame:
    """Rows (hub, c, n, ...) once for each pair of tiles that they take part in, as ``tile``, ``one``, ``other``.

    A hub's rows are dealt by size band, and a band's by hash into as many tiles as their number and shingles ask for. Tiles
    meet those of their own and of the next band; what lies further apart in size can't be linked.
    """
    largest = crowd.agg(F.max("n")).first()[0] or 1
    first = edges(percent, largest).tolist()
    band = F.aggregate(F.array(*[F.lit(e) for e in first[1:]]), F.lit(0), lambda a, e: a + (F.col("n") >= e).cast("int"))
    banded = crowd.withColumn("band", band)
    tiles = F.greatest(F.ceil(F.count(F.lit(1)) / TILE_ROWS), F.ceil(F.sum("n") / TILE_SHINGLES)).cast("int")
    counts = cut_lineage(banded.groupBy("hub", "band").agg(tiles.alias("own")))
    neighbour = lambda step, name: counts.select("hub", (F.col("band") - step).alias("band"), F.col("own").alias(name))
    counts = counts.join(neighbour(1, "next"), ["hub", "band"], "left").join(neighbour(-1, "last"), ["hub", "band"], "left").fillna(0, ["next", "last"])
    dealt = banded.join(counts, ["hub", "band"])
    number = lambda b, t: F.shiftleft(b.cast("long"), 40) + t
    tile = F.pmod(F.xxhash64("c"), F.col("own"))
    mine = number(F.col("band"), tile)

    def others(count: str, step: int) -> Column:
        ids = F.when(F.col(count) > 0, F.sequence(F.lit(0), F.col(count) - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(ids, lambda t: number(F.col("band") + step, t))

    met = F.concat(others("own", 0), others("next", 1), others("last", -1))
    rows = dealt.withColumn("tile", mine).withColumn("_with", F.explode(met))
    return rows.withColumns({"one": F.least("tile", "_with"), "other": F.greatest("tile", "_with")}).drop("_with", "band", "own", "next", "last")


def _pairs_with(pairs: DataFrame, side: DataFrame, end: str, names: dict[str, str]) -> DataFrame:
    return pairs.join(side.select(F.col("c").alias(end), *[F.col(c).alias(n) for c, n in names.items()]), end)


def jaccard_links(members: DataFrame, rows: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) between classes that connect what linked pairs connect.

    Sets that share a part meet under its key. In a key's group all are first compared with one of them, the hub: the one
    that meets most, as an original does among its copies. What is alike forms components, and only where a hub's group
    then holds several of them are its members compared across components, tile against tile.
    """
    some = members.filter("n > 0")
    keys = some.mapInArrow(_each_key, "key long, c long")
    shared = keys.groupBy("key").agg(F.min("c").alias("_lo"), F.max("c").alias("_hi")).filter("_lo < _hi").select("key")
    meeting = cut_lineage(keys.join(shared, "key").groupBy("key", "c").agg(F.lit(1).alias("one")).select("key", "c"))
    ranked = meeting.join(meeting.groupBy("c").agg(F.count(F.lit(1)).alias("met")), "c")
    hubs = ranked.groupBy("key").agg(F.max_by("c", F.struct("met", "c")).alias("hub"))
    stars = cut_lineage(meeting.join(hubs, "key").select("hub", "c").distinct())

    found = stars.select("c").distinct()
    faces = cut_lineage(some.join(found.withColumnRenamed("c", "c1"), "c1", "left_semi").groupBy("c1").agg(F.min(F.struct("id", "text_key")).alias("r"), F.first("n").alias("n"), F.first("bits").alias("bits")).select(F.col("c1").alias("c"), "r.*", "n", "bits"))
    picked = faces.select("id", "text_key", "c")
    picked = F.broadcast(picked) if picked.count() <= BROADCAST_IDS else picked
    sets = cut_lineage(rows.join(picked, ["id", "text_key"]).select("c", "text").mapInArrow(_sets(words), "c long, shingles binary"))

    star = stars.filter("hub <> c").select(F.least("hub", "c").alias("a"), F.greatest("hub", "c").alias("b")).distinct()
    star = _pairs_with(_pairs_with(star, faces, "a", {"n": "n", "bits": "left"}), faces, "b", {"n": "m", "bits": "right"})
    near = star.mapInArrow(_sift(percent), "a long, b long")
    near = _pairs_with(_pairs_with(near, sets, "a", {"shingles": "left"}), sets, "b", {"shingles": "right"})
    links = cut_lineage(near.mapInArrow(_decide(percent), "a long, b long").distinct())

    labels = components(links).select(F.col("id").alias("c"), "label")
    named = stars.join(labels, "c", "left").withColumn("label", F.coalesce("label", "c"))
    mixed = named.groupBy("hub").agg(F.min("label").alias("_lo"), F.max("label").alias("_hi")).filter("_lo < _hi").select("hub")
    crowd = cut_lineage(named.join(mixed, "hub").filter("hub <> c").join(faces.select("c", "n"), "c"))  # the hub has met all
    meets = _tile_pairs(crowd, percent).join(faces.select("c", "bits"), "c").select("hub", "c", "label", "n", "tile", "one", "other", "bits")
    open_ = cut_lineage(meets.groupBy("hub", "one", "other").applyInArrow(_sift_tiles(percent), meets.schema))
    across = open_.join(sets, "c").groupBy("hub", "one", "other").applyInArrow(_decide_tiles(percent), "a long, b long")
    return links.union(across.distinct())


def jaccard_components(docs: DataFrame, words: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id of every row.

    A document's set is that of its distinct shingles of ``words`` words (A-Z in lower case); fewer words are one shingle.
    Two documents link when they share ``percent`` of the union of their sets; a component is what links connect, named by its
    smallest id. No link between different texts is lost: parts, bitmaps and sizes exclude only what can't be linked.

    Null, empty and blank texts have no shingles and are linked with nothing. Rows of one id are one document, so what
    either is linked with is linked. A null id counts as the smallest. Repeated rows get equal answers. An empty table gives
    no rows. Shingles are told apart by 64 bits, equal sets by 128.
    """
    rows = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), text_key(text_of(F.col("text"))).alias("text_key"), text_of(F.col("text")).alias("text"))
    members = cut_lineage(rows.mapInArrow(_members(words, percent), MEMBERS))
    links = cut_lineage(jaccard_links(members, rows, words, percent))
    # nodes are ids: a class's smallest stands for it, the other ids of a class are linked to that one
    some = members.filter("n > 0").select("id", "c1", "c2").distinct()
    classes = cut_lineage(some.groupBy("c1", "c2").agg(F.min("id").alias("first")))
    ends = classes.groupBy("c1").agg(F.min("first").alias("first"))
    named = links.join(ends.toDF("a", "x"), "a").join(ends.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    within = some.join(classes, ["c1", "c2"]).select(F.col("first").alias("a"), F.col("id").alias("b")).filter("a <> b")
    labels = components(named.union(within))
    known = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    joined = members.select("id", "text_key", "n").join(labels, "id", "left")
    joined = joined.withColumn("component", F.when(F.col("n") == 0, F.col("id")).otherwise(F.coalesce("label", "id")))
    return joined.select(known("id").alias("doc_id"), "text_key", F.col("n").alias("n_shingles"), known("component").alias("component_id"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), words=3, percent=90).select("doc_id", "n_shingles", "component_id")
