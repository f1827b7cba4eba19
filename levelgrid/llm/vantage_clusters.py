"""Centroid clustering with a vantage-point tree over the centroids.

Vectors are turned to whole numbers, so that distances and means are exact. In every round a vantage-point tree is
built over the centroids and sent to every task. A vector searches it best first: of the branches still open it
enters the one with the smallest lower bound, and it closes those whose bound lies beyond its best distance so far.
The bound is inclusive (a branch that may hold an equal distance is entered), so the smaller number wins every tie.
Many vectors walk the tree at once, each with branches of its own. Each task adds up the vectors of a cluster; only
these sums are shuffled. Vectors never are.

Defined cases: vectors that are null, of another length, or hold a null or a number that is not finite are left out;
fewer vectors than asked-for centroids give fewer centroids; none give no rows; repeated rows count as often as they
stand; a null id is hashed as the text ''; equal ids as seeds are ordered by their components. A component
beyond +-2^26 after scaling is an error, since squared distances would not fit into 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from levelgrid.llm import text as T
from levelgrid.session import settle

DIMENSIONS = 64
CENTROIDS = 16
ROUNDS = 3
SCALE = 64
# Centroids in a leaf of the tree, and the largest component.
LEAF = 3
LARGEST = 1 << 26
# Rounding of a square root and a sum is far below this share; a bound that close is entered.
SLACK = 1e-9


@dataclass
class Node:
    """A vantage centroid with up to two branches and the range of distances in each, or a leaf of centroids."""

    members: np.ndarray
    vantage: int = -1
    branches: tuple[int, ...] = ()
    ranges: tuple[tuple[float, float], ...] = ()


def squared(vectors: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Exact squared distances of whole-number vectors to one centre."""
    apart = vectors - centre
    return np.einsum("ij,ij->i", apart, apart)


def build(centroids: np.ndarray, leaf: int = LEAF) -> list[Node]:
    """The tree as a list of nodes, the root first. The vantage centroid is the one farthest from the middle."""
    nodes: list[Node] = []

    def add(members: np.ndarray) -> int:
        at = len(nodes)
        nodes.append(Node(members))
        if len(members) <= leaf:
            return at
        spread = squared(centroids[members], centroids[members].sum(0) // len(members))
        vantage = int(members[np.argmax(spread)])
        rest = members[members != vantage]
        far = squared(centroids[rest], centroids[vantage])
        order = np.argsort(far, kind="stable")
        halves = [h for h in (order[: len(order) // 2], order[len(order) // 2 :]) if len(h)]
        reach = tuple((float(np.sqrt(far[h[0]])), float(np.sqrt(far[h[-1]]))) for h in halves)
        nodes[at] = Node(np.array([vantage]), vantage, tuple(add(rest[h]) for h in halves), reach)
        return at

    if len(centroids):
        add(np.arange(len(centroids)))
    return nodes


def search(vectors: np.ndarray, centroids: np.ndarray, tree: list[Node]) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid of every vector (ties: the smaller number), its squared distance, and the distances measured."""
    n = len(vectors)
    best, far, measured = np.full(n, -1), np.full(n, np.iinfo(np.int64).max), 0
    bounds = np.full((n, len(tree)), np.inf)
    bounds[:, 0] = 0.0
    active = np.arange(n)
    while len(active):
        own = bounds[active]
        nearest = own.argmin(1)
        low = own[np.arange(len(active)), nearest]
        # The best branch that is left decides: if even it lies beyond the best distance, the search is over.
        open_ = low <= np.sqrt(far[active].astype(float)) * (1 + SLACK) + SLACK
        open_ &= np.isfinite(low)
        active, nearest = active[open_], nearest[open_]
        for at in np.unique(nearest):
            rows = active[nearest == at]
            node = tree[at]
            bounds[rows, at] = np.inf
            for number in node.members:
                found = squared(vectors[rows], centroids[number])
                measured += len(rows)
                nearer = (found < far[rows]) | ((found == far[rows]) & (number < best[rows]))
                best[rows[nearer]], far[rows[nearer]] = number, found[nearer]
            if node.vantage >= 0:
                away = np.sqrt(found.astype(float))
                for branch, (low_, high) in zip(node.branches, node.ranges):
                    bounds[rows, branch] = np.maximum(0.0, np.maximum(low_ - away, away - high))
    return best, far, measured


def whole_vectors(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """vec_id and x: the vectors that count, as whole numbers floor(scale * component)."""
    e = F.col("embedding").cast("array<double>")
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform(e, lambda x: F.floor(x * F.lit(float(scale))))
    fits = F.forall(e, lambda x: F.abs(x * F.lit(float(scale))) <= F.lit(float(LARGEST)))
    checked = F.when(fits, whole).otherwise(F.raise_error(F.lit("a component is too large for exact 64-bit distances")).cast("array<bigint>"))
    kept = vectors.filter(F.col("embedding").isNotNull() & (F.size("embedding") == dimensions)).filter(~bad)
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), checked.alias("x"))


def _seed_hash() -> Column:
    return F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)


def seeds(whole: DataFrame, count: int = CENTROIDS) -> np.ndarray:
    """The components of the `count` vectors with the smallest hash of their id."""
    hashed = whole.withColumn("_h", _seed_hash())
    last = [r["_h"] for r in hashed.select("_h").orderBy("_h").limit(count).collect()]
    if not last:
        return np.zeros((0, 0), np.int64)
    # The hashes alone found the bound; the few vectors under it are read in a second pass.
    rows = hashed.filter(F.col("_h") <= last[-1]).orderBy("_h", "x").limit(count).collect()
    return np.array([r["x"] for r in rows], np.int64)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _assigned(batches: Iterator[pa.RecordBatch], sent) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    centroids, tree = sent.value
    for batch in batches:
        if batch.num_rows:
            x = _matrix(batch.column(1))
            best, far, _ = search(x, centroids, tree)
            yield batch, x, best, far


def moved(whole: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after one round: the exact floored mean of the vectors that are nearest to each."""
    sent = whole.sparkSession.sparkContext.broadcast((centroids, build(centroids)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(centroids_shape, np.int64), np.zeros(centroids_shape[0], np.int64)
        for _, x, best, _ in _assigned(batches, sent):
            np.add.at(sums, best, x)
            counts += np.bincount(best, minlength=len(counts))
        used = np.flatnonzero(counts)
        cells = np.repeat(used, sums.shape[1]), np.tile(np.arange(sums.shape[1]), len(used))
        yield pa.RecordBatch.from_arrays([pa.array(cells[0]), pa.array(cells[1]), pa.array(sums[used].ravel()), pa.array(counts[cells[0]])], ["cluster", "part", "total", "rows"])

    centroids_shape = centroids.shape
    parts = whole.mapInArrow(run, "cluster long, part long, total long, rows long")
    out = centroids.copy()
    # At most centroids x dimensions rows.
    for r in parts.groupBy("cluster", "part").agg(F.sum("total").alias("total"), F.sum("rows").alias("rows")).collect():
        out[r["cluster"], r["part"]] = r["total"] // r["rows"]
    return out


def cluster(vectors: DataFrame, count: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector that counts."""
    spark = vectors.sparkSession
    T.bound_batches(spark)
    whole = settle(whole_vectors(vectors, dimensions, scale))
    centroids = seeds(whole, count)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(whole, centroids)
    sent = spark.sparkContext.broadcast((centroids, build(centroids)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, best, far in _assigned(batches, sent):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.int32()), pa.array(far, pa.int64())], ["vec_id", "cluster", "distance"])

    found = settle(whole.mapInArrow(run, "vec_id long, cluster int, distance long"))
    # One row a centroid: a side of at most `count` rows.
    inertia = {r["cluster"]: int(r["i"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("i")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    side = spark.createDataFrame(
        [(k, inertia[k], sum(inertia.values()), digest[k]) for k in sorted(inertia)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    )
    return found.join(F.broadcast(side), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
