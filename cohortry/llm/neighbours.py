"""Approximate nearest neighbours by learned partitions.

A sample's exact neighbour graph is cut into parts of nearly equal size with few neighbours across the
cuts. A small network learns to which parts a vector's neighbours belong. Every row is stored in its most
probable part; a query is sent to its several most probable ones and reranked there by the exact inner
product. How many parts it takes is found on the sample. Parts are dealt in blocks by a hash, and so are
the queries of a part, so neither a large part nor many equal vectors meet in one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortry.llm.words import lean
from cohortry.sources.workspace import materialise

SAMPLE_ROWS = 8192
PART_ROWS = 16_000
MAX_PARTS = 128
GRAPH = 20
SLACK = 0.1
HIDDEN = 64
TARGET = 0.95
BLOCK_ROWS = 16_384


def _exact(queries: np.ndarray, rows: np.ndarray, k: int, own: np.ndarray | None = None) -> np.ndarray:
    """Places of the k rows of largest inner product; ``own``: the place of each query itself."""
    out = np.empty((len(queries), k), np.int64)
    for i in range(0, len(queries), 1024):
        scores = queries[i : i + 1024] @ rows.T
        if own is not None:
            scores[np.arange(len(scores)), own[i : i + 1024]] = -np.inf
        out[i : i + 1024] = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    return out


def cut_graph(vectors: np.ndarray, graph: np.ndarray, parts: int, slack: float = SLACK, rounds: int = 10) -> np.ndarray:
    """A part for each vertex: medians along main directions first, then vertices move to where their neighbours are while there is room."""
    n = len(vectors)
    part = np.zeros(n, np.int64)
    groups, ways = [np.arange(n)], [parts]
    number = 0
    while groups:
        members, k = groups.pop(), ways.pop()
        if k == 1:
            part[members] = number
            number += 1
            continue
        centred = vectors[members] - vectors[members].mean(0)
        _, axes = np.linalg.eigh(centred.T @ centred)
        order = members[np.argsort(centred @ axes[:, -1], kind="stable")]
        cut = len(order) * (k // 2) // k
        groups += [order[:cut], order[cut:]]
        ways += [k // 2, k - k // 2]
    room = math.ceil((1 + slack) * n / parts)
    source = np.repeat(np.arange(n), graph.shape[1])
    ends = np.concatenate([source, graph.ravel()]), np.concatenate([graph.ravel(), source])
    for _ in range(rounds):
        pull = np.zeros((n, parts), np.int32)
        np.add.at(pull, (ends[0], part[ends[1]]), 1)
        best = pull.argmax(1)
        gain = pull[np.arange(n), best] - pull[np.arange(n), part]
        sizes, moved = np.bincount(part, minlength=parts), 0
        for v in np.argsort(-gain, kind="stable"):
            if gain[v] <= 0:
                break
            if sizes[best[v]] < room:
                sizes[part[v]] -= 1
                sizes[best[v]] += 1
                part[v] = best[v]
                moved += 1
        if not moved:
            break
    return part


@dataclass
class Router:
    """A network with one hidden layer over vectors of unit length; ``probes`` parts are searched."""

    weights: list[np.ndarray]
    size: int
    parts: int
    probes: int = 1

    def logits(self, vectors: np.ndarray) -> np.ndarray:
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        a, b, c, d = self.weights
        return np.maximum(unit @ a + b, 0) @ c + d


def _trained(vectors: np.ndarray, target: np.ndarray, hidden: int, steps: int = 200, rate: float = 0.01) -> list[np.ndarray]:
    """Weights that minimise the cross entropy to the target shares (Adam on the whole sample)."""
    rng = np.random.default_rng(0)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    sizes = [(unit.shape[1], hidden), (hidden,), (hidden, target.shape[1]), (target.shape[1],)]
    weights = [rng.normal(0, 1 / math.sqrt(s[0]), s) if len(s) == 2 else np.zeros(s) for s in sizes]
    first, second = [np.zeros(s) for s in sizes], [np.zeros(s) for s in sizes]
    for step in range(1, steps + 1):
        inner = np.maximum(unit @ weights[0] + weights[1], 0)
        out = inner @ weights[2] + weights[3]
        out = np.exp(out - out.max(1, keepdims=True))
        error = (out / out.sum(1, keepdims=True) - target) / len(unit)
        back = (error @ weights[2].T) * (inner > 0)
        for k, slope in enumerate([unit.T @ back, back.sum(0), inner.T @ error, error.sum(0)]):
            first[k] = 0.9 * first[k] + 0.1 * slope
            second[k] = 0.999 * second[k] + 0.001 * slope * slope
            weights[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return weights


def train(vectors: np.ndarray, parts: int, *, nearest: int = 20, target: float = TARGET, hidden: int = HIDDEN) -> Router:
    """Cut the sample's neighbour graph, learn to route, and take as many probes as find ``target`` of the sample's own neighbours."""
    n = len(vectors)
    parts = max(1, min(parts, n // 32))
    if parts == 1:
        size = vectors.shape[1] if n else 0
        return Router([np.zeros((size, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1)], size, 1)
    graph = _exact(vectors, vectors, min(GRAPH, n - 1), np.arange(n))
    part = cut_graph(vectors, graph, parts)
    share = np.zeros((n, parts))
    np.add.at(share, (np.repeat(np.arange(n), graph.shape[1] + 1), part[np.column_stack([np.arange(n), graph])].ravel()), 1)
    router = Router(_trained(vectors, share / share.sum(1, keepdims=True), hidden), vectors.shape[1], parts)
    logits = router.logits(vectors)
    stored, order = logits.argmax(1), np.argsort(-logits, axis=1)
    k = min(nearest, n - 1)
    true = stored[_exact(vectors, vectors, k, np.arange(n))]
    rank = np.empty_like(order)
    rank[np.arange(n)[:, None], order] = np.arange(parts)
    found = np.sort(rank[np.arange(n)[:, None], true].ravel())
    router.probes = int(found[min(len(found) - 1, math.ceil(target * len(found)) - 1)]) + 1
    return router


def usable(vector: str) -> Column:
    """Neither null nor zero, and every component a finite number."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0)


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _best(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per query its k best rows and their scores; equal scores by smaller id."""
    for i in range(0, len(queries), 256):
        rough = queries[i : i + 256] @ rows.T
        rough[query_ids[i : i + 256, None] == ids[None, :]] = -np.inf
        floor = np.partition(rough, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) > k else np.full(len(rough), -np.inf)
        for q, (scores, least) in enumerate(zip(rough, floor, strict=True)):
            slack = 1e-9 * (1 + abs(least)) if np.isfinite(least) else 0
            at = np.flatnonzero((scores >= least - slack) & (scores > -np.inf))
            exact = (rows[at] * queries[i + q]).sum(1)  # the same for equal vectors, wherever they stand
            order = np.lexsort((ids[at], -exact))[:k]
            yield i + q, ids[at[order]], exact[order]


def search(
    rows: DataFrame, queries: Column, id: str = "vec_id", vector: str = "embedding", *, k: int = 20,
    sample_rows: int = SAMPLE_ROWS, parts: int | None = None, probes: int | None = None, target: float = TARGET, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The k nearest found of every row that ``queries`` selects: ``query_id``, ``rank``, ``vec_id`` and ``score``.

    Near is a large inner product in double precision; a row is no neighbour of its own id. Vectors
    that are null, zero or not finite take no part, nor do those of another length than most of the
    sample. A repeated id is a candidate once a row and one query, answered by the best of its rows.
    Ties go to the smaller id. Further columns are ignored. The network is fitted to at most ``sample_rows`` vectors;
    every row is indexed.
    """
    own = rows.select(F.col(id).cast("long").alias("__id"), F.col(vector).cast("array<double>").alias("__v"), queries.alias("__q")).filter(usable("__v") & F.col("__id").isNotNull())
    drawn = own.select("__id", "__v").orderBy(F.xxhash64("__id"), "__id").limit(sample_rows).collect()
    lengths = [len(r["__v"]) for r in drawn]
    size = max(set(lengths), key=lengths.count) if lengths else 0
    same = [r["__v"] for r in drawn if len(r["__v"]) == size]
    sample = np.array(same, float).reshape(len(same), size)
    router = train(sample, parts or min(MAX_PARTS, max(8, math.ceil(own.count() / PART_ROWS))), nearest=k, target=target)
    router.probes = min(router.parts, probes or router.probes)
    shared = rows.sparkSession.sparkContext.broadcast(router)  # of a size set by HIDDEN and MAX_PARTS

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                order = np.argsort(-shared.value.logits(_matrix(batch.column("__v"))), axis=1, kind="stable")[:, : shared.value.probes]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(order.astype(np.int32)), pa.list_(pa.int32()))], ["__id", "__v", "__q", "__parts"])

    placed = own.filter(F.size("__v") == size).mapInArrow(lean(routed), "__id long, __v array<double>, __q boolean, __parts array<int>")
    placed = materialise(placed, "routed")
    stored = placed.select("__id", "__v", F.col("__parts")[0].alias("part"))
    asked = placed.filter("__q").select("__id", "__v", F.explode("__parts").alias("part"))
    sizes = {s: {r["part"]: math.ceil(r["n"] / block_rows) for r in d.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()} for s, d in (("rows", stored), ("queries", asked))}

    def blocks(side: str) -> Column:
        known = [x for p, n in sizes[side].items() for x in (F.lit(p), F.lit(n))]
        return F.coalesce(F.element_at(F.create_map(*known), F.col("part")), F.lit(1)) if known else F.lit(1)

    def dealt(side: DataFrame, mine: str, other: str) -> DataFrame:
        return side.withColumn(mine, F.pmod(F.xxhash64("__id"), blocks(mine)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), blocks(other) - 1)))

    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[int, np.ndarray, np.ndarray]] = []
        if left.num_rows and right.num_rows:
            asked_ids, ids = (t.column("__id").to_numpy() for t in (left, right))
            found = [(asked_ids[q], near, scores) for q, near, scores in _best(asked_ids, _matrix(left.column("__v")), ids, _matrix(right.column("__v")), k)]
        return pa.table({
            "query_id": pa.array(np.repeat([f[0] for f in found], [len(f[1]) for f in found]).astype(np.int64) if found else [], pa.int64()),
            "vec_id": pa.array(np.concatenate([f[1] for f in found]) if found else [], pa.int64()),
            "score": pa.array(np.concatenate([f[2] for f in found]) if found else [], pa.float64())})

    keys = ["part", "rows", "queries"]
    pairs = dealt(asked, "queries", "rows").groupBy(*keys).cogroup(dealt(stored, "rows", "queries").groupBy(*keys)).applyInArrow(lean(nearest), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
