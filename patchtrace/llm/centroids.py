"""Centroid clustering in exact integers, filtered by n-simplex projection.

A few vectors are pivots. They span a simplex; from a point's distances to the pivots alone
follow its coordinates over that simplex: the apex, whose last coordinate is the altitude. Apexes are
computed once for each vector and kept with it. For two points the Euclidean distance of
their apexes is a lower bound of the true distance, and the distance with one altitude
turned to the other side an upper bound. A centroid whose lower bound is above the least upper
bound can't be the nearest; the distances to the others are computed in integers.

The base simplex takes pivots one by one, the point farthest from the span of those before, and stops
when no candidate is off that span; so repeated vectors do no harm.

Each round is one pass of the kept table, with the centroids in the task, a sum for each
cluster and task, and one Spark aggregation of these sums. The driver sees ``n_clusters``
rows of components.

Defined results: kept are vectors with exactly ``dim`` components, none null, non-finite or
of magnitude 2**20 or more (beyond, squared distances leave 64 bits); all others get no row.
Repeated rows are clustered each for itself; a null id counts as the empty text in the start
order; equal ids are ordered by their components. With fewer kept vectors than clusters there
are fewer clusters; an empty table gives an empty result. An inertia beyond 64 bits is null.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchtrace.llm.common import pick, write_stage

N_CLUSTERS, ROUNDS, DIM, PIVOTS = 16, 3, 64, 8
#: Components are whole multiples of 1 / SCALE.
SCALE = 64
LIMIT = float(1 << 20)
#: Rounding of the bounds, relative to the squared lengths that they are made of.
SLACK = 1e-9


@dataclass
class Simplex:
    """Pivots and the inverse of their base: row i of the base is pivot i + 1 seen from pivot 0."""

    pivots: np.ndarray
    square: np.ndarray
    inverse: np.ndarray

    @classmethod
    def build(cls, candidates: np.ndarray, n: int) -> Simplex:
        """At most ``n`` pivots from the rows of ``candidates``, each the farthest from the span so far."""
        c = candidates.astype(np.float64)
        rest = c - c[0]
        chosen = [0]
        limit = 1e-6 * max(1.0, (rest ** 2).sum(1).max())
        while len(chosen) < n:
            far = (rest ** 2).sum(1)
            i = int(far.argmax())
            if far[i] <= limit:
                break
            chosen.append(i)
            unit = rest[i] / np.sqrt(far[i])
            rest = rest - np.outer(rest @ unit, unit)
        p = c[chosen]
        gram = (p[1:] - p[0]) @ (p[1:] - p[0]).T
        base = np.linalg.cholesky(gram) if len(chosen) > 1 else np.zeros((0, 0))
        return cls(candidates[chosen], (base ** 2).sum(1), np.linalg.inv(base) if len(chosen) > 1 else base)

    def distances(self, points: np.ndarray) -> np.ndarray:
        """Squared distance of each point to each pivot."""
        return np.stack([((points - p).astype(np.float64) ** 2).sum(1) for p in self.pivots], axis=1)

    def apex(self, squared: np.ndarray) -> np.ndarray:
        """Apex coordinates from squared distances to the pivots; the last one is the altitude."""
        flat = (squared[:, :1] + self.square[None, :] - squared[:, 1:]) / 2 @ self.inverse.T
        up = np.sqrt(np.maximum(squared[:, 0] - (flat ** 2).sum(1), 0))
        return np.concatenate([flat, up[:, None]], axis=1)


def bounds(points: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared lower and upper bounds between apexes (points x centers), widened for rounding."""
    a, b = (points ** 2).sum(1)[:, None], (centers ** 2).sum(1)[None, :]
    low = a + b - 2 * points @ centers.T
    slack = SLACK * (a + b) + 1e-6
    return low - slack, low + 4 * np.outer(points[:, -1], centers[:, -1]) + slack


def nearest(vectors: np.ndarray, apexes: np.ndarray, centers: np.ndarray, center_apexes: np.ndarray):
    """(cluster, squared distance) of each vector: bounds first, exact integers for what is left."""
    low, high = bounds(apexes, center_apexes)
    row, c = np.nonzero(low <= high.min(1, keepdims=True))
    d = np.empty(len(row), np.int64)
    for k in range(len(centers)):  # one centroid at a time, so no copy of the batch for each
        at = np.flatnonzero(c == k)
        gap = vectors[row[at]] - centers[k]
        d[at] = np.einsum("ij,ij->i", gap, gap)
    order = np.lexsort((c, d, row))
    first = np.flatnonzero(np.diff(row[order], prepend=-1))
    best = order[first]
    return c[best], d[best]


def _matrix(column: pa.ListArray, kind) -> np.ndarray:
    """Rows of a list column whose lists have one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    return flat.reshape(len(column), -1)


def _lists(m: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    n, dim = m.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * dim), pa.array(m.ravel(), kind))


def kept_vectors(vectors: DataFrame, id_col: str, vector_col: str, dim: int = DIM) -> DataFrame:
    """(id, v): the usable vectors as integers."""
    src = pick(vectors, id=id_col, x=vector_col)
    good = (F.size("x") == dim) & F.forall("x", lambda e: F.coalesce(F.abs(e.cast("double")) < LIMIT, F.lit(False)))
    return src.where(good).select(
        "id", F.transform("x", lambda e: F.floor(e.cast("double") * SCALE).cast("int")).alias("v"))


def cluster(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", n_clusters: int = N_CLUSTERS,
            rounds: int = ROUNDS, dim: int = DIM, n_pivots: int = PIVOTS, seed: str = "1:") -> DataFrame:
    """id_col, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each kept vector."""
    kept = kept_vectors(vectors, id_col, vector_col, dim)
    kind = kept.schema["id"].dataType.simpleString()
    sha = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    start = kept.select(sha.alias("sha"), "v").orderBy("sha", "v").limit(n_clusters).collect()
    result = (f"{id_col} {kind}, cluster int, distance long, cluster_inertia long, inertia long, "
              "centroid_sha256 string")
    if not start:
        return vectors.sparkSession.createDataFrame([], result)
    centers = np.array([r["v"] for r in start], np.int64)
    simplex = Simplex.build(centers, n_pivots)

    def project(batches):
        for b in batches:
            if b.num_rows:
                v = _matrix(b.column("v"), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [b.column("id"), b.column("v"), _lists(simplex.apex(simplex.distances(v)), pa.float64())],
                    names=["id", "v", "apex"])

    table = write_stage(kept.mapInArrow(project, f"id {kind}, v array<int>, apex array<double>"))

    def assigned(batches, now):
        tops = simplex.apex(simplex.distances(now))
        for b in batches:
            if b.num_rows:
                v = _matrix(b.column("v"), np.int64)
                yield b, v, *nearest(v, _matrix(b.column("apex"), np.float64), now, tops)

    for _ in range(rounds):
        def sums(batches, now=centers):
            n, total = np.zeros(len(now), np.int64), np.zeros(now.shape, np.int64)
            for _, v, c, _ in assigned(batches, now):
                n += np.bincount(c, minlength=len(now))
                order = np.argsort(c, kind="stable")
                some, at = np.unique(c[order], return_index=True)
                total[some] += np.add.reduceat(v[order], at, axis=0)
            some = np.flatnonzero(n)
            if len(some):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some, pa.int32()), pa.array(n[some]), _lists(total[some], pa.int64())],
                    names=["c", "n", "total"])

        parts = table.select("v", "apex").mapInArrow(sums, "c int, n long, total array<long>")
        rows = (parts.select("c", "n", F.posexplode("total").alias("i", "s")).groupBy("c", "i")
                .agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect())
        centers = centers.copy()
        for r in rows:  # n_clusters times dim rows
            centers[r["c"], r["i"]] = int(r["s"]) // r["n"]

    def final(batches):
        for b, _, c, d in assigned(batches, centers):
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(c, pa.int32()), pa.array(d)],
                                             names=["id", "cluster", "distance"])

    names = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centers]
    rows = write_stage(table.mapInArrow(final, f"id {kind}, cluster int, distance long"))
    by_cluster = {r["cluster"]: int(r["s"]) for r in rows.groupBy("cluster")
                  .agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}

    def in_64_bits(n: int) -> int | None:
        return n if n < 1 << 63 else None

    whole = in_64_bits(sum(by_cluster.values()))
    facts = vectors.sparkSession.createDataFrame(  # one row a cluster
        [(c, in_64_bits(by_cluster.get(c, 0)), whole, names[c]) for c in range(len(centers))],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(facts), "cluster").select(
        F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
