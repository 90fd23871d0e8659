"""Centroid clustering with Ptolemaic pivots.

Vectors of a fixed number of components are scaled to integers and assigned to the
nearest of k centroids, by squared Euclidean distance, over a fixed number of rounds.
The first k vectors in order of a hash of their id are the first centroids and, for
all rounds, the pivots. Each vector's distances to the pivots are computed once and
stored with it. For pivots p, s, Ptolemy's inequality gives

    d(x, c) >= |d(x, p) d(c, s) - d(x, s) d(c, p)| / d(p, s),

so the distances from the k centroids of a round to the pivots bound all of its
distances from below. The bound is lowered by more than its rounding error; a
centroid whose bound is above the nearest distance known so far is left out, and the
rest are compared exactly, in integers.

A round is one pass over the stored vectors. A task hands on one row a cluster (count
and sums as decimal digits, so no sum can overflow); the driver sees k rows a round.
"""
from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written

COMPONENTS = 64
SCALE = 64
CLUSTERS = 16
ROUNDS = 3
#: Pairs of pivots whose bounds are taken, the farthest apart first, each pivot at
#: most ``PER_PIVOT`` times. More pairs leave fewer distances to compute.
PAIRS = 12
PER_PIVOT = 3
#: Components up to this size are compared in 64-bit integers (64 squares of twice
#: as much stay below 2^62), larger ones in Python's.
SMALL = 1 << 27
#: Relative error allowed for in a bound: a distance to a pivot is rounded twice, a
#: product once more, and each division, all by 2^-53.
EPS = 16 * 2.0 ** -53


def integers(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of doubles: int64 where all are ``SMALL``, else Python
    integers."""
    y = np.floor(x * scale)
    if not y.size or np.abs(y).max() <= SMALL:
        return y.astype(np.int64)
    # A product that overflows a double is taken exactly.
    exact = [int(b) if math.isfinite(b) else int(a) * scale for a, b in zip(x.ravel().tolist(), y.ravel().tolist())]
    return np.array(exact, object).reshape(x.shape)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of a and b, pair by pair."""
    d = a - b
    if d.dtype == object:
        return (d * d).sum(axis=1) if d.shape[0] else np.zeros(0, object)
    return np.einsum("ij,ij->i", d, d)


def _float(d: np.ndarray) -> np.ndarray:
    if d.dtype != object:
        return d.astype(np.float64)
    return np.array([float(v) if v < 1 << 1000 else math.inf for v in d.tolist()], np.float64)


def _roots(d: np.ndarray) -> np.ndarray:
    if d.dtype != object:
        return np.sqrt(d.astype(np.float64))
    root = [math.isqrt(int(v)) for v in d]
    # Beyond the range of a double nothing is bounded: see ``lower_bounds``.
    return np.array([math.sqrt(int(v)) if v < 1 << 1000 else float(r) if r < 1 << 1000 else math.inf for v, r in zip(d, root)])


def pivot_pairs(pivots: np.ndarray, pairs: int = PAIRS, per_pivot: int = PER_PIVOT) -> list[tuple[int, int, float]]:
    """(p, s, distance) of the pairs of pivots that bounds are taken from."""
    every = []
    for p in range(len(pivots)):
        for s in range(p):
            d = float(_roots(squared(pivots[p:p + 1], pivots[s:s + 1]))[0])
            if 0 < d < math.inf:
                every.append((d, s, p))
    out: list[tuple[int, int, float]] = []
    used = [0] * len(pivots)
    for d, s, p in sorted(every, key=lambda t: (-t[0], t[1:])):
        if len(out) < pairs and used[s] < per_pivot and used[p] < per_pivot:
            out.append((s, p, d))
            used[s] += 1
            used[p] += 1
    return out


def lower_bounds(x: np.ndarray, c: np.ndarray, pairs: list[tuple[int, int, float]]) -> np.ndarray:
    """Squared Ptolemaic bounds, a row a vector and a column a centroid, from the
    distances of both to the pivots; never above the squared distance."""
    low = np.zeros((len(x), len(c)))
    for p, s, apart in pairs:
        a = x[:, p, None] * c[None, :, s]
        b = x[:, s, None] * c[None, :, p]
        with np.errstate(invalid="ignore", over="ignore"):
            bound = (np.abs(a - b) - EPS * (a + b)) / apart
        low = np.fmax(low, bound)  # a bound that is not a number is none
    with np.errstate(over="ignore"):
        out = low * low * (1 - EPS)
    return np.where(np.isfinite(out), out, 0.0)


def nearest(x: np.ndarray, to_pivots: np.ndarray, centroids: np.ndarray, centroid_pivots: np.ndarray,
            pairs: list[tuple[int, int, float]]) -> tuple[np.ndarray, np.ndarray, int]:
    """(number of the nearest centroid, ties to the smaller; squared distance, exact;
    number of distances computed) of each vector."""
    if x.dtype != centroids.dtype:
        x, centroids = x.astype(object), centroids.astype(object)
    low = lower_bounds(to_pivots, centroid_pivots, pairs)
    rows = np.arange(len(x))
    guess = low.argmin(axis=1)
    best = squared(x, centroids[guess])
    who = guess.copy()
    done = len(x)
    for j in range(len(centroids)):
        near = _float(best) * (1 + EPS)  # the known distance, rounded up
        todo = rows[(low[:, j] <= near) & (guess != j)]
        if not len(todo):
            continue
        done += len(todo)
        d = squared(x[todo], np.broadcast_to(centroids[j], (len(todo), centroids.shape[1])))
        closer = (d < best[todo]) | ((d == best[todo]) & (j < who[todo]))
        best[todo[closer]], who[todo[closer]] = d[closer], j
    return who, best, done


@dataclass
class Model:
    """Centroids and pivots of a round, sent to the tasks: 2 k vectors."""

    pivots: np.ndarray
    centroids: np.ndarray
    pairs: list[tuple[int, int, float]]

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Distances to the pivots, rounded, a row a vector."""
        pivots = self.pivots
        if x.dtype != pivots.dtype:
            x, pivots = x.astype(object), pivots.astype(object)
        return np.stack([_roots(squared(x, np.broadcast_to(p, x.shape))) for p in pivots], axis=1)

    @property
    def centroid_pivots(self) -> np.ndarray:
        return self.distances(self.centroids)


def _matrix(column, components: int) -> np.ndarray:
    """An Arrow column of lists without nulls as rows of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, components)


def _small(x: np.ndarray, scale: int) -> np.ndarray:
    """Rows whose integers are all ``SMALL``."""
    return np.abs(np.floor(x * scale)).max(axis=1, initial=0) <= SMALL


def _uniform(vectors: list[list[int]]) -> np.ndarray:
    """Rows of integers, in 64 bits if all are small enough."""
    flat = max((abs(v) for r in vectors for v in r), default=0)
    return np.array(vectors, np.int64 if flat <= SMALL else object).reshape(len(vectors), -1)


def _assigned(batch, model: Model, centroid_pivots: np.ndarray, scale: int):
    """Clusters and distances of a batch (columns v and cached), and the integers
    with their clusters; rows of large components, which need Python's integers,
    apart from the others."""
    x = _matrix(batch["v"], model.pivots.shape[1])
    cached = np.frombuffer(b"".join(batch["cached"].to_pylist()), np.float64).reshape(len(x), -1)
    small = _small(x, scale)
    who, dist = np.zeros(len(x), np.int32), np.zeros(len(x), object)
    parts = []
    for part in (small, ~small):
        if part.any():
            y = integers(x[part], scale)
            who[part], dist[part], _ = nearest(y, cached[part], model.centroids, centroid_pivots, model.pairs)
            parts.append((who[part], y))
    return who, dist, parts


def cluster(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE, clusters: int = CLUSTERS,
            rounds: int = ROUNDS, seed: str = "1") -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for
    every row of ``vectors`` (vec_id, embedding) that is kept, and the final
    centroids.

    Kept are vectors with exactly ``components`` components, none null or not
    finite. The first centroids are the kept rows of least lower-case hex SHA-256 of
    ``seed:vec_id``, ties by components, null ids last; of fewer rows than
    ``clusters`` each is a centroid, and of none the result is empty. Repeated rows
    count each; equal centroids leave all but the first of them empty. An empty
    cluster keeps its centroid. A distance or sum of distances beyond a long is
    null; assignment and centroids are exact at any size. Other columns are not
    looked at.
    """
    spark = vectors.sparkSession
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    kept = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).where(
        (F.size("v") == components) & F.forall("v", finite))
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    begin = (kept.select(order.alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(clusters).collect())
    out = T.StructType([vectors.schema["vec_id"], T.StructField("cluster", T.IntegerType()),
                        T.StructField("distance", T.LongType()), T.StructField("cluster_inertia", T.LongType()),
                        T.StructField("inertia", T.LongType()), T.StructField("centroid_sha256", T.StringType())])
    if not begin:
        return spark.createDataFrame([], out), []
    first = integers(np.array([r.v for r in begin], np.float64).reshape(len(begin), components), scale)
    model = Model(first, first, pivot_pairs(first))
    shared = spark.sparkContext.broadcast(model)

    def prepare(batches):
        import pyarrow as pa
        m = shared.value
        for b in batches:
            x = _matrix(b["v"], components)
            small = _small(x, scale)
            cached = np.zeros((len(x), len(m.pivots)))
            for part in (small, ~small):
                if part.any():
                    cached[part] = m.distances(integers(x[part], scale))
            yield pa.RecordBatch.from_arrays([b["vec_id"], b["v"], pa.array([r.tobytes() for r in cached], pa.binary())],
                                             names=["vec_id", "v", "cached"])

    ready = written(kept.mapInArrow(prepare, T.StructType([*kept.schema.fields, T.StructField("cached", T.BinaryType())])),
                    "pivots")

    def step(now: Model) -> DataFrame:
        """Per task and cluster: count, sum of distances, sums of components."""
        sent = spark.sparkContext.broadcast(now)

        def run(batches):
            import pyarrow as pa
            m = sent.value
            at = m.centroid_pivots
            total: list = [None] * len(m.centroids)
            for b in batches:
                for who, y in _assigned(b, m, at, scale)[2]:
                    for j in np.unique(who).tolist():
                        rows = y[who == j]
                        n, old = total[j] or (0, [0] * components)
                        total[j] = n + len(rows), [s + int(v) for s, v in zip(old, rows.sum(axis=0))]
            some = [(j, t[0], [str(v) for v in t[1]]) for j, t in enumerate(total) if t]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in some], pa.int32()), pa.array([r[1] for r in some], pa.int64()),
                 pa.array([r[2] for r in some], pa.list_(pa.string()))], names=["cluster", "n", "sums"])

        def merge(key, frame):
            sums = [0] * components
            for row in frame["sums"]:
                sums = [a + int(b) for a, b in zip(sums, row)]
            return pd.DataFrame([(key[0], int(frame["n"].sum()), [str(v) for v in sums])], columns=["cluster", "n", "sums"])

        kind = "cluster int, n long, sums array<string>"
        return ready.select("v", "cached").mapInArrow(run, kind).groupBy("cluster").applyInPandas(merge, kind)

    for _ in range(rounds):
        rows = [[int(v) for v in r] for r in model.centroids]
        for r in step(model).collect():
            rows[r.cluster] = [int(v) // r.n for v in r.sums]
        model = Model(model.pivots, _uniform(rows), model.pairs)
    last = spark.sparkContext.broadcast(model)

    def assign(batches):
        import pyarrow as pa
        m = last.value
        at = m.centroid_pivots
        for b in batches:
            who, dist, _ = _assigned(b, m, at, scale)
            yield pa.RecordBatch.from_arrays([b["vec_id"], pa.array(who), pa.array([str(d) for d in dist], pa.string())],
                                             names=["vec_id", "cluster", "exact"])

    kind = T.StructType([vectors.schema["vec_id"], T.StructField("cluster", T.IntegerType()), T.StructField("exact", T.StringType())])
    final = written(ready.mapInArrow(assign, kind), "clusters").withColumn("distance", F.expr("try_cast(exact as long)"))
    # A distance beyond a long leaves the sums it is part of without a value.
    each = {r.cluster: r for r in final.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("total"), F.count("*").alias("n"),
        F.count("distance").alias("known")).collect()}
    as_long = lambda v: v if v is not None and v < 1 << 63 else None
    sums = {j: int(r.total) if r.n == r.known else None for j, r in each.items()}
    inertia = None if None in sums.values() else sum(sums.values())
    centroids = [[int(v) for v in r] for r in model.centroids]
    hexed = [hashlib.sha256(",".join(map(str, r)).encode()).hexdigest() for r in centroids]
    table = [(j, as_long(sums.get(j)), hexed[j]) for j in range(len(centroids))]
    pick = lambda i, t: F.element_at(F.array(*[F.lit(r[i]).cast(t) for r in table]), F.col("cluster") + 1)
    return final.select("vec_id", "cluster", "distance", pick(1, "long").alias("cluster_inertia"),
                        F.lit(as_long(inertia)).cast("long").alias("inertia"), pick(2, "string").alias("centroid_sha256")), centroids
