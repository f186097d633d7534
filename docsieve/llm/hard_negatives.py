"""Hard negatives: angles to reference directions bound scores, and only windows that may matter are scored."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docsieve.llm.common import table
from docsieve.llm.whitening import EXACT, exact_product, finite_vectors, on_grid
from docsieve.session import cut_lineage

#: Reference directions, and the rows (first by hash of the id) from which they are chosen.
REFERENCES, SAMPLE = 24, 4096
#: Rows of a shard (what a task holds), of a window (what is scored or passed over together), anchors of a block.
SHARD, WINDOW, BLOCK = 16_384, 64, 2048
#: Radians by which an angle's rounding may be wrong: stored in single precision, taken from an arc cosine.
SLACK = 2e-6

ROWS = "vec_id long, label int, grid array<long>, norm double, angles array<float>, near int"


def references(sample: np.ndarray, count: int = REFERENCES) -> np.ndarray:
    """Unit directions that lie far from one another: each is the sampled one whose nearest direction so far is farthest."""
    norms = np.sqrt((sample.astype(np.float64) ** 2).sum(axis=1))
    unit = sample[norms > 0] / norms[norms > 0, None]
    if not len(unit):
        return np.eye(sample.shape[1])[:1]
    chosen = [0]
    nearest = unit @ unit[0]
    while len(chosen) < min(count, len(unit)):
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, unit @ unit[chosen[-1]])
    return unit[chosen]


def _measured(directions: np.ndarray, scale: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Puts vectors on the grid, with norms, angles to all references and the nearest reference."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dim = directions.shape[1]
        for batch in batches:
            grid = on_grid(batch.column("vector"), dim, scale, 0)
            doubles = grid.astype(np.float64)
            norms = np.sqrt((doubles**2).sum(axis=1))
            angles = np.arccos(np.clip(doubles @ directions.T / np.where(norms > 0, norms, 1.0)[:, None], -1.0, 1.0)).astype(np.float32)
            cuts = np.arange(len(grid) + 1, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id"), batch.column("label"), pa.ListArray.from_arrays(cuts * dim, grid.ravel()), pa.array(norms),
                    pa.ListArray.from_arrays(cuts * directions.shape[0], angles.ravel()), pa.array(angles.argmin(axis=1).astype(np.int32)),
                ],
                names=["vec_id", "label", "grid", "norm", "angles", "near"],
            )

    return run


def _matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


class Vectors(NamedTuple):
    ids: np.ndarray
    labels: np.ndarray
    grid: np.ndarray
    norms: np.ndarray
    angles: np.ndarray

    @classmethod
    def of(cls, part: pa.Table) -> Vectors:
        n = part.num_rows
        return cls(part.column("vec_id").to_numpy(), part.column("label").to_numpy(), _matrix(part.column("grid"), n), part.column("norm").to_numpy(), _matrix(part.column("angles"), n).astype(np.float64))

    def take(self, at: np.ndarray | slice) -> Vectors:
        return Vectors(*(column[at] for column in self))


def windows(rows: Vectors, near: np.ndarray, size: int = WINDOW) -> list[Vectors]:
    """Rows of one label and one nearest reference, neighbours by their angle to it; within a window by id."""
    order = np.lexsort((rows.ids, rows.angles[np.arange(len(near)), near], near, rows.labels))
    near, rows = near[order], rows.take(order)
    turns = np.flatnonzero((np.diff(rows.labels) != 0) | (np.diff(near) != 0)) + 1
    found = []
    for low, high in zip([0, *turns], [*turns, len(near)]):
        for at in range(low, high, size):
            here = rows.take(slice(at, min(at + size, high)))
            found.append(here.take(np.argsort(here.ids, kind="stable")))
    return found


def bounds(anchors: Vectors, window: Vectors) -> tuple[np.ndarray, np.ndarray]:
    """(least, greatest) score that any row of the window can have with each anchor.

    By the triangle inequality of angles, an anchor at angle p to a reference and rows at angles a ... b to it are at least
    max(a - p, p - b) and at most min(p + b, 2 pi - p - a) apart; the tightest reference counts. The cosines of that interval,
    times the norms, bound the score; angles and products are widened by more than their rounding.
    """
    low, high = window.angles.min(axis=0), window.angles.max(axis=0)
    apart = np.maximum(np.maximum(low - anchors.angles, anchors.angles - high).max(axis=1) - SLACK, 0.0)
    reach = np.minimum(np.minimum(anchors.angles + high, 2 * np.pi - anchors.angles - low).min(axis=1) + SLACK, np.pi)
    longest, shortest = window.norms.max(), window.norms.min()
    best, worst = np.cos(apart), np.cos(np.maximum(reach, apart))
    rounding = anchors.norms * longest * 1e-9 + 1e-6
    return (
        anchors.norms * worst * np.where(worst > 0, shortest, longest) - rounding,
        anchors.norms * best * np.where(best > 0, longest, shortest) + rounding,
    )


def scores(anchors: Vectors, window: Vectors) -> np.ndarray:
    """Integer inner products. Partial sums never exceed the product of the norms, so small ones are exact as doubles."""
    if anchors.norms.max() * window.norms.max() * (1 + 1e-9) < EXACT:
        return (anchors.grid.astype(np.float64) @ window.grid.T.astype(np.float64)).astype(np.int64)
    exact = exact_product(anchors.grid, window.grid.T)
    if exact.dtype == object and abs(exact).max() >= 1 << 63:
        raise OverflowError("an inner product doesn't fit a long")
    return exact.astype(np.int64)


class Best:
    """The first ``k`` (higher score, then smaller id) of each group, kept while candidates come in."""

    def __init__(self, k: int, room: int = 1 << 20):
        self.k, self.room, self.held = k, room, 0
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def offer(self, groups: np.ndarray, allowed: np.ndarray, found: np.ndarray, ids: np.ndarray) -> None:
        """Rows of ``found`` are groups; ``ids`` rise, so a stable sort leaves ties to the smaller id."""
        some = np.flatnonzero(allowed.any(axis=1))
        if not len(some):
            return
        least = np.iinfo(np.int64).min
        masked = np.where(allowed[some], found[some], least)
        order = np.argsort(-masked.astype(np.float64) if np.abs(found).max() < EXACT else np.where(masked == least, np.iinfo(np.int64).max, -masked), axis=1, kind="stable")[:, : self.k]
        valid = np.take_along_axis(allowed[some], order, axis=1)
        at = np.broadcast_to(groups[some][:, None], order.shape)[valid]
        self.parts.append((at, np.take_along_axis(masked, order, axis=1)[valid], ids[order][valid]))
        self.held += len(at)
        if self.held > self.room:
            self.parts = [self.best()]
            self.held = len(self.parts[0][0])
            self.room = max(self.room, 2 * self.held)

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        groups, found, ids = (np.concatenate(c) for c in zip(*self.parts))
        order = np.lexsort((ids, -found, groups))
        groups, found, ids = groups[order], found[order], ids[order]
        first = np.searchsorted(groups, groups)
        keep = np.arange(len(groups)) - first < self.k
        return groups[keep], found[keep], ids[keep]


_SCORED = pa.schema([("anchor_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _positives(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The best rows of a shard with the label of each anchor of a block."""

    def run(asked: pa.Table, rows: pa.Table) -> pa.Table:
        if not asked.num_rows or not rows.num_rows:
            return _SCORED.empty_table()
        anchors, found = Vectors.of(asked), Best(k)
        near = rows.column("near").to_numpy()
        for label in np.unique(anchors.labels):
            mine = np.flatnonzero(anchors.labels == label)
            these = anchors.take(mine)
            same = np.flatnonzero(rows.column("label").to_numpy() == label)
            if not len(same):
                continue
            parts = windows(Vectors.of(rows.take(pa.array(same))), near[same])
            most = np.stack([bounds(these, w)[1] for w in parts], axis=1)
            enough = np.full(len(mine), -np.inf)  # the k-th best score so far
            top = np.full((len(mine), k), -np.inf)
            for at in np.argsort(-most.max(axis=0), kind="stable"):
                open_ = np.flatnonzero(most[:, at] >= enough)
                if not len(open_):
                    continue
                got, w = scores(these.take(open_), parts[at]), parts[at]
                other = w.ids[None, :] != these.ids[open_, None]
                wanted = other & (got >= enough[open_, None])
                found.offer(mine[open_], wanted, got, w.ids)
                merged = np.concatenate([top[open_], np.where(other, got.astype(np.float64) * (1 - 1e-15) - 1, -np.inf)], axis=1)
                top[open_] = -np.partition(-merged, k - 1, axis=1)[:, :k]
                enough[open_] = top[open_, k - 1]
        groups, got, ids = found.best()
        return pa.table([anchors.ids[groups], ids, got], schema=_SCORED)

    return run


_MINED = pa.schema([("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("positive_score", pa.int64()), ("negative_id", pa.int64()), ("negative_score", pa.int64())])


def _within(low: int, high: int, positive: np.ndarray, got: np.ndarray) -> np.ndarray:
    """low * positive <= 100 * score <= high * positive, in whole numbers."""
    if max(np.abs(positive).max(), np.abs(got).max()) < 1 << 55:
        return (low * positive <= 100 * got) & (100 * got <= high * positive)
    positive, got = positive.astype(object), got.astype(object)
    return ((low * positive <= 100 * got) & (100 * got <= high * positive)).astype(bool)


def _negatives(k: int, low: int, high: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """For each positive of each anchor of a block: the best rows of a shard, of other labels, within its score window."""

    def run(asked: pa.Table, rows: pa.Table) -> pa.Table:
        if not asked.num_rows or not rows.num_rows:
            return _MINED.empty_table()
        anchors = Vectors.of(asked)
        lists = asked.column("positives").combine_chunks()
        owner = np.repeat(np.arange(len(anchors.ids)), np.diff(lists.offsets.to_numpy()))
        flat = lists.flatten()
        positive, wish = flat.field("vec_id").to_numpy(), flat.field("score").to_numpy()
        floor, ceiling = low * wish.astype(np.float64) / 100, high * wish.astype(np.float64) / 100
        slack = np.abs(wish) * 1e-9 + 1e-6
        found = Best(k)
        for w in windows(Vectors.of(rows), rows.column("near").to_numpy()):
            least, most = bounds(anchors, w)
            meets = (least[owner] <= ceiling + slack) & (most[owner] >= floor - slack) & (anchors.labels[owner] != w.labels[0])
            pairs = np.flatnonzero(meets)
            if not len(pairs):
                continue
            some, place = np.unique(owner[pairs], return_inverse=True)
            got = scores(anchors.take(some), w)[place]
            found.offer(pairs, _within(low, high, wish[pairs][:, None], got), got, w.ids)
        groups, got, ids = found.best()
        return pa.table([anchors.ids[owner[groups]], positive[groups], wish[groups], ids, got], schema=_MINED)

    return run


def _ranked(rows: DataFrame, keys: list[str], score: str, name: str, k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc(score), name)
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _meet(asked: DataFrame, rows: DataFrame, blocks: int, shards: int, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """Every block of anchors with every shard, each in a task that holds one of both."""
    names = [f"a_{c}" for c in asked.columns]
    left = asked.select(*[F.col(c).alias(n) for c, n in zip(asked.columns, names)]).withColumn("a_shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    right = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def meet(block: pa.Table, shard: pa.Table) -> pa.Table:
        return run(block.rename_columns([c.removeprefix("a_") for c in block.column_names]), shard)

    return left.groupBy("a_shard", "a_block").cogroup(right.groupBy("shard", "block")).applyInArrow(meet, schema)


def mine_hard_negatives(
    vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: float = 256.0
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors`` has vec_id, embedding, label; ``anchor`` says of a row whether it is one. Entries become floor(scale * entry),
    a score is the inner product of two rows, higher scores come first, ties by smaller id. An anchor's positives are its
    first other rows of the same label; for each, the first rows of other labels with low % of its score <= score <=
    high % of it are returned (none if there are none; for a negative positive's score no window is open).

    Rows are range-partitioned by label, nearest reference direction and angle to it, so a shard is a few stretches of
    neighbours however many rows have one label or lie together. The references are fitted on ``SAMPLE`` rows; every row
    is indexed, and what the angles can't exclude is scored.

    Null ids, labels and vectors, empty vectors and such as hold null or non-finite entries take no part; zero vectors do.
    Vectors of another length than the commonest (the longer of equally common ones) take no part. An id stands for one
    row: of rows that repeat an id the one with the smallest label, then vector, is taken. Empty tables give no rows.
    Scores beyond a long are an error.
    """
    spark = vectors.sparkSession
    named = vectors.select("vec_id", "embedding", F.col("label").cast("int").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    named = named.filter("vec_id is not null and label is not null")
    usable = finite_vectors(named.select(F.struct("vec_id", "label", "anchor").alias("vec_id"), "embedding")).select("vec_id.*", "vector")
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    lengths = usable.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if lengths is None:
        return spark.createDataFrame([], schema)
    usable = usable.filter(F.size("vector") == lengths["dim"])
    one = usable.groupBy("vec_id").agg(F.min(F.struct("label", "vector", "anchor")).alias("r")).select("vec_id", "r.*")
    sample = usable.select("vec_id", "vector").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()
    directions = references(on_grid(sample.column("vector"), lengths["dim"], scale, 0))

    measured = one.select("vec_id", "label", "vector").mapInArrow(_measured(directions, scale), ROWS)
    stretch = ["label", "near", F.get("angles", F.col("near")), "vec_id"]
    placed = measured.repartitionByRange(max(1, -(-lengths["count"] // SHARD)), *stretch)
    rows = cut_lineage(placed.withColumn("shard", F.spark_partition_id()))  # where a row lies is read many times
    shards = rows.agg(F.max("shard")).first()[0] + 1

    marked = one.filter("anchor").select("vec_id")
    anchors = cut_lineage(rows.drop("shard").join(marked, "vec_id", "left_semi"))
    blocks = max(1, -(-anchors.count() // BLOCK))
    anchors = anchors.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))

    near = _meet(anchors, rows, blocks, shards, _positives(positives), "anchor_id long, vec_id long, score long")
    near = _ranked(near, ["anchor_id"], "score", "vec_id", positives)
    near = near.groupBy("anchor_id").agg(F.collect_list(F.struct("vec_id", "score")).alias("positives"))
    asked = cut_lineage(anchors.join(near, F.col("vec_id") == F.col("anchor_id")).drop("anchor_id"))

    mined = _meet(asked, rows, blocks, shards, _negatives(negatives, low, high), "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    mined = _ranked(mined, ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives)
    return mined.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    turned = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", turned), F.col("vec_id") % 100 == 0)
