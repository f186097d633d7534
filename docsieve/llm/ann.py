"""Approximate nearest neighbours: robust-pruned directed graphs in shards, searched by beam."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsieve.llm.common import table
from docsieve.session import cut_lineage

#: Vectors of a shard, edges of a node, beam while building and while searching, relaxation of the pruning, points that
#: are inserted together, queries of a block.
SHARD, EDGES, BUILD_BEAM, BEAM, ALPHA, BATCH, QUERIES = 8192, 32, 48, 96, 1.2, 256, 4096


def _beam_search(unit: np.ndarray, edges: np.ndarray, queries: np.ndarray, start: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """For all queries at once: the ``beam`` nearest nodes found (-1 where there are fewer) and their squared distances.

    Each step expands every query's nearest node that wasn't expanded yet; it ends when no beam has one left.
    """
    q = len(queries)
    ids = np.full((q, beam), -1, np.int64)
    far = np.full((q, beam), np.inf, np.float32)
    done = np.ones((q, beam), bool)
    ids[:, 0], far[:, 0], done[:, 0] = start, ((queries - unit[start]) ** 2).sum(axis=1), False
    seen = np.zeros((q, len(unit)), bool)
    seen[:, start] = True
    while True:
        open_far = np.where(done, np.inf, far)
        pick = open_far.argmin(axis=1)
        live = np.flatnonzero(open_far[np.arange(q), pick] < np.inf)
        if not len(live):
            return ids, far
        done[live, pick[live]] = True
        next_ids = edges[ids[live, pick[live]]]
        known = next_ids >= 0
        fresh = known & ~seen[live[:, None], next_ids]
        seen[np.repeat(live, next_ids.shape[1])[known.ravel()], next_ids[known]] = True
        dist = 2 - 2 * np.einsum("qed,qd->qe", unit[next_ids], queries[live])
        dist = np.where(fresh, dist, np.inf).astype(np.float32)
        all_far = np.concatenate([far[live], dist], axis=1)
        all_ids = np.concatenate([ids[live], np.where(fresh, next_ids, -1)], axis=1)
        all_done = np.concatenate([done[live], ~fresh], axis=1)
        best = np.argpartition(all_far, beam - 1, axis=1)[:, :beam]
        far[live], ids[live], done[live] = (np.take_along_axis(x, best, axis=1) for x in (all_far, all_ids, all_done))


def _robust_prune(unit: np.ndarray, points: np.ndarray, candidates: np.ndarray, alpha: float, edges: int) -> np.ndarray:
    """For all points at once: nearest candidate first, dropping those that a chosen one is closer to by ``alpha``."""
    p, c = candidates.shape
    vectors = unit[candidates]
    far = 2 - 2 * np.einsum("pcd,pd->pc", vectors, unit[points])
    usable = (candidates >= 0) & (candidates != points[:, None])
    order = np.argsort(np.where(usable, candidates, -1), axis=1, kind="stable")  # each candidate once
    ranked = np.take_along_axis(candidates, order, axis=1)
    again = np.zeros_like(usable)
    np.put_along_axis(again, order[:, 1:], (ranked[:, 1:] == ranked[:, :-1]), axis=1)
    far = np.where(usable & ~again, far, np.inf)
    between = 2 - 2 * np.matmul(vectors, vectors.transpose(0, 2, 1))
    out = np.full((p, edges), -1, np.int64)
    rows = np.arange(p)
    for e in range(edges):
        best = far.argmin(axis=1)
        live = far[rows, best] < np.inf
        if not live.any():
            break
        out[live, e] = candidates[live, best[live]]
        covered = alpha * alpha * between[rows, best] <= far  # squared distances
        far = np.where(covered & live[:, None], np.inf, far)
        far[rows, best] = np.inf
    return out


def build_graph(unit: np.ndarray, edges: int = EDGES, beam: int = BUILD_BEAM, alpha: float = ALPHA, batch: int = BATCH) -> tuple[np.ndarray, int]:
    """Edges (-1: none) of every node, and the node where searches start: the one nearest to the middle.

    Points come in batches, in an order without meaning. A greedy search over the graph so far proposes neighbours, robust
    pruning keeps diverse ones, and their back edges are pruned in the same way. A second round refines the first.
    """
    n = len(unit)
    graph = np.full((n, edges), -1, np.int64)
    start = int((unit @ unit.mean(axis=0)).argmax())
    order = np.random.default_rng(n).permutation(n)
    order = np.concatenate([[start], order[order != start]])
    for turn, relax in enumerate((1.0, alpha)):
        at = 1 if turn == 0 else 0
        while at < n:
            size = batch if turn else min(batch, max(1, at))  # the first batches are as small as the graph
            points = order[at : at + size]
            at += len(points)
            found, _ = _beam_search(unit, graph, unit[points], start, beam)
            graph[points] = _robust_prune(unit, points, np.concatenate([found, graph[points]], axis=1), relax, edges)
            to = graph[points].ravel()
            back = np.repeat(points, edges)[to >= 0]
            to = to[to >= 0]
            by = np.argsort(to, kind="stable")
            to, back = to[by], back[by]
            nodes, first, count = np.unique(to, return_index=True, return_counts=True)
            for low in range(0, len(nodes), 2 * batch):
                part = slice(low, low + 2 * batch)
                width = int(count[part].max())
                extra = np.full((len(nodes[part]), width), -1, np.int64)
                for j in range(width):
                    has = count[part] > j
                    extra[has, j] = back[first[part][has] + j]
                graph[nodes[part]] = _robust_prune(unit, nodes[part], np.concatenate([graph[nodes[part]], extra], axis=1), relax, edges)
    return graph, start


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # no overflow of squares
    return (scaled / np.sqrt((scaled**2).sum(axis=1, keepdims=True))).astype(np.float32)


def _index_shard(part: pa.Table) -> pa.Table:
    dim = part.column("dim")[0].as_py()
    graph, start = build_graph(_unit(_matrix(part.column("vector"), dim)))
    edges = pa.array(list(graph.astype(np.int32)), pa.list_(pa.int32()))
    at = np.arange(len(graph), dtype=np.int32)
    return part.append_column("node", pa.array(at)).append_column("edges", edges).append_column("start", pa.array(np.full(len(graph), start, np.int32)))


def build_index(vectors: DataFrame, keep_ids: int, shard: int = SHARD) -> DataFrame:
    """One row for each distinct (vec_id, vector): dim, shard, node, vector, its smallest ``keep_ids`` ids, edges, start.

    Equal vectors are one node, so that thousands of copies don't fill each other's edges; as many of their ids are kept as
    a result may hold. Shards hold ``shard`` nodes or so, dealt by hash, of one length of vectors each.
    """
    first = Window.partitionBy("vector").orderBy("vec_id")
    ranked = vectors.select("vec_id", "vector").distinct().withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= keep_ids)
    nodes = ranked.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("dim", F.size("vector"))
    nodes = cut_lineage(nodes)
    sizes = nodes.groupBy("dim").count()  # one row for each length
    shards = sizes.select("dim", F.ceil(F.col("count") / shard).cast("int").alias("_shards"))
    dealt = nodes.join(F.broadcast(shards), "dim").withColumn("shard", F.pmod(F.xxhash64("vector"), F.col("_shards")).cast("int"))
    dealt = dealt.select("dim", "shard", "vector", "ids")
    graph = T.StructType([T.StructField("node", T.IntegerType()), T.StructField("edges", T.ArrayType(T.IntegerType())), T.StructField("start", T.IntegerType())])
    return cut_lineage(dealt.groupBy("dim", "shard").applyInArrow(_index_shard, T.StructType(dealt.schema.fields + graph.fields)))


def _search_block(k: int, beam: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(asked: pa.Table, nodes: pa.Table) -> pa.Table:
        if not asked.num_rows or not nodes.num_rows:
            return schema.empty_table()
        nodes = nodes.sort_by("node")
        dim = nodes.column("dim")[0].as_py()
        vectors, queries = _matrix(nodes.column("vector"), dim), _matrix(asked.column("vector"), dim)
        edges = nodes.column("edges").combine_chunks().flatten().to_numpy().reshape(len(vectors), -1).astype(np.int64)
        ids, names = nodes.column("ids").to_pylist(), asked.column("vec_id").to_numpy()
        unit, start = _unit(vectors), nodes.column("start")[0].as_py()
        out_q, out_v, out_s = [], [], []
        for low in range(0, len(queries), BATCH):
            block = queries[low : low + BATCH]
            found, _ = _beam_search(unit, edges, _unit(block), start, beam)
            for q, near, own in zip(block, found, names[low : low + BATCH].tolist()):
                near = near[near >= 0]
                score = cosine(q, vectors[near])
                rows = sorted((-s, i) for s, at in zip(score.tolist(), near.tolist()) for i in ids[at] if i != own)[:k]
                out_q += [own] * len(rows)
                out_v += [i for _, i in rows]
                out_s += [-s for s, _ in rows]
        return pa.table([out_q, out_v, out_s], schema=schema)

    return run


def cosine(query: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Cosines in double precision."""
    dot = (others * query).sum(axis=1)
    return dot / (np.sqrt((query * query).sum()) * np.sqrt((others * others).sum(axis=1)))


def usable_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, vector (doubles) of the rows that take part: those with an id and finite components, not all zero."""
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    return rows.filter(F.col("vec_id").isNotNull() & (F.size("vector") > 0) & finite & F.exists("vector", lambda x: x != 0))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, beam: int = BEAM) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of every query, nearest first, ties to the smaller id.

    Each shard's graph is searched by blocks of queries; a query's own id is no neighbour of it, and vectors of another
    length aren't either. Scores are cosines of the original vectors in double precision. Vectors (and ids) that are null,
    zero, or hold a null or non-finite component take no part. Rows that repeat id and vector count once; rows that
    repeat an id with other vectors are found and ask under that id. Empty tables give no rows.
    """
    index = build_index(usable_vectors(vectors), k + 1)
    asked = cut_lineage(usable_vectors(queries).distinct().withColumn("dim", F.size("vector")))
    blocks = max(1, -(-asked.count() // QUERIES))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id", "vector"), F.lit(blocks)).cast("int"))
    shards = index.select("dim", "shard").distinct()  # one row for SHARD vectors
    left = asked.join(shards, "dim").select("dim", "shard", "block", "vec_id", "vector").toDF("q_dim", "q_shard", "q_block", "vec_id", "vector")
    right = index.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    meeting = left.groupBy("q_dim", "q_shard", "q_block").cogroup(right.groupBy("dim", "shard", "block"))
    found = meeting.applyInArrow(_search_block(k, beam), "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.filter("vec_id % 50 = 0"), k=5)
