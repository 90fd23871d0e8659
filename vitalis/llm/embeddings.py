"""Near-duplicate vectors by PCA-ordered tiled comparison.

Vectors are scaled to length one and rotated to the principal axes of a bounded
sample, which leaves all inner products as they are and puts most of them into
the leading dimensions. Equal vectors of a label become one class with a count.
The classes are sorted by label and first axis and cut into tiles. A pair of
tiles is compared only if the boxes around their leading axes are near enough;
inside, inner products are accumulated over leading dimensions first, and a pair
is dropped as soon as what it has plus the product of the norms of what is left
cannot reach the threshold. What remains is decided by the exact cosine of the
original vectors in double precision.

A tile pair hands on, per class, the number of vectors it links to, and spanning
edges of its links: never the links themselves.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Links, components, written

THRESHOLD = 0.93
TILE = 2048
#: Bounds of the sample the axes are fitted on, a documented parameter. The axes
#: decide the speed only, never the result.
SAMPLE = 5000
STEPS = (8, 24)
BOX = 4
SLACK = 1e-9


def _axes(rows: list[list[float]], n: int) -> np.ndarray:
    """Orthogonal matrix whose columns are the principal axes of the sample."""
    x = np.array([r for r in rows if len(r) == n], np.float64)
    if not len(x):
        return np.eye(n)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    value, vector = np.linalg.eigh(x.T @ x)
    return vector[:, np.argsort(-value)]


def _unit(frame: pd.DataFrame) -> np.ndarray:
    x = np.stack(frame["embedding"].to_numpy()).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


TILES = ("label string, n_dims int, tile string, n int, ids binary, counts binary, rotated binary, exact binary, "
         "low array<double>, high array<double>")


def _tiles(axes: dict[int, np.ndarray], tile: int):
    """Sorted classes to tiles, one row each."""

    def row(part: int, k: int, frame: pd.DataFrame) -> dict:
        n_dims = int(frame["n_dims"].iloc[0])
        exact = np.stack(frame["embedding"].to_numpy()).astype(np.float64)
        rotated = _unit(frame) @ axes.get(n_dims, np.eye(n_dims))
        box = rotated[:, :BOX]
        return {"label": frame["label"].iloc[0], "n_dims": n_dims, "tile": f"{part:08d}-{k:08d}", "n": len(frame),
                "ids": frame["cls"].to_numpy(np.int64).tobytes(), "counts": frame["copies"].to_numpy(np.int64).tobytes(),
                "rotated": rotated.tobytes(), "exact": exact.tobytes(),
                "low": box.min(axis=0).tolist(), "high": box.max(axis=0).tolist()}

    def run(batches):
        from pyspark import TaskContext
        part, k, held = TaskContext.get().partitionId(), 0, None
        for f in batches:
            held = f if held is None or not len(held) else pd.concat([held, f], ignore_index=True)
            while len(held):
                same = ((held["label"] == held["label"].iloc[0]) & (held["n_dims"] == held["n_dims"].iloc[0])).to_numpy()
                n = min(tile, len(same) if same.all() else int(same.argmin()))
                if n == len(held) and n < tile:
                    break
                yield pd.DataFrame([row(part, k, held.iloc[:n])])
                k, held = k + 1, held.iloc[n:].reset_index(drop=True)
        if held is not None and len(held):
            yield pd.DataFrame([row(part, k, held)])

    return run


def _suffix(x: np.ndarray, at: int) -> np.ndarray:
    return np.sqrt(np.maximum((x[:, at:] ** 2).sum(axis=1), 0.0))


def compare_tiles(a: dict, b: dict, same: bool, threshold: float):
    """Numbers (i, j) of the linked rows of two tiles (i < j in one tile)."""
    x, y = a["rotated"], b["rotated"]
    n_dims = x.shape[1]
    steps = [s for s in STEPS if s < n_dims]
    found_i, found_j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    goal = threshold - SLACK
    first = steps[0] if steps else n_dims
    rest_x, rest_y = _suffix(x, first), _suffix(y, first)
    for lo in range(0, len(x), 512):
        dots = x[lo:lo + 512, :first] @ y[:, :first].T
        i, j = np.nonzero(dots + rest_x[lo:lo + 512, None] * rest_y[None, :] >= goal)
        got = dots[i, j]
        i = i + lo
        if same:
            up = i < j
            i, j, got = i[up], j[up], got[up]
        # Survivors in pieces of bounded size.
        for s in range(0, len(i), 1 << 16):
            p, q, sums = i[s:s + (1 << 16)], j[s:s + (1 << 16)], got[s:s + (1 << 16)]
            for begin, end in zip(steps, steps[1:]):
                sums = sums + np.einsum("ij,ij->i", x[p, begin:end], y[q, begin:end])
                go = sums + a["rest"][end][p] * b["rest"][end][q] >= goal
                p, q, sums = p[go], q[go], sums[go]
            u, v = a["exact"][p], b["exact"][q]
            cos = np.einsum("ij,ij->i", u, v) / (a["norm"][p] * b["norm"][q])
            hit = cos >= threshold
            found_i.append(p[hit])
            found_j.append(q[hit])
    return np.concatenate(found_i), np.concatenate(found_j)


def _open(prefix: str, r) -> dict:
    n_dims = int(r["n_dims"])
    get = lambda k, t=np.float64: np.frombuffer(r[f"{prefix}_{k}"], t)
    t = {"ids": get("ids", np.int64), "counts": get("counts", np.int64),
         "rotated": get("rotated").reshape(-1, n_dims), "exact": get("exact").reshape(-1, n_dims)}
    t["norm"] = np.sqrt(np.einsum("ij,ij->i", t["exact"], t["exact"]))
    t["rest"] = {s: _suffix(t["rotated"], s) for s in STEPS if s < n_dims}
    return t


def _compare(threshold: float):
    def run(batches):
        links = Links()
        for f in batches:
            for r in f.to_dict("records"):
                a, b = _open("a", r), _open("b", r)
                i, j = compare_tiles(a, b, r["same"], threshold)
                links.add(a["ids"][i], b["ids"][j])
                if len(i):
                    # Vectors that each class links to, in this pair of tiles.
                    na = np.bincount(i, b["counts"][j], len(a["ids"])).astype(np.int64)
                    nb = np.bincount(j, a["counts"][i], len(b["ids"])).astype(np.int64)
                    yield pd.DataFrame({"a": np.concatenate([a["ids"][na > 0], b["ids"][nb > 0]]), "b": pd.NA,
                                        "n": np.concatenate([na[na > 0], nb[nb > 0]])}).astype({"b": "Int64"})
                for e in links.overflow():
                    yield e.assign(n=0)
        for e in links.frames():
            yield e.assign(n=0)

    return run


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE, sample: int = SAMPLE) -> DataFrame:
    """One row per vector of ``vectors`` (vec_id, embedding, label): vec_id,
    n_links (other vectors linked directly), component_id (smallest vec_id
    reachable, itself included) and kept (vec_id = component_id).

    Vectors are linked only with vectors of the same label (not null) and of
    as many dimensions. A vector that is null, empty, zero, or has a null or
    non-finite component links with nothing, as does one with a null label.
    Rows with a null vec_id take part; they name no component and are not kept.
    Repeated rows are vectors of their own. Other columns are not looked at.
    """
    spark = vectors.sparkSession
    e = F.col("embedding")
    finite = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    good = F.coalesce(F.col("label").isNotNull() & e.isNotNull() & finite & F.exists(e, lambda v: v != 0), F.lit(False))
    rows = vectors.select("vec_id", e.cast("array<double>").alias("embedding"), F.col("label").cast("string").alias("label"))
    # Classes of equal vectors of a label: a 128-bit key, numbered once written.
    key = [F.when(good, F.xxhash64("label", "embedding")).alias("k1"),
           F.when(good, F.xxhash64(F.lit(1), "embedding", "label")).alias("k2")]
    member = written(rows.select("vec_id", *key), "members")
    classes = (rows.where(good).select("vec_id", "embedding", "label", *key).groupBy("k1", "k2")
               .agg(F.first("label").alias("label"), F.first("embedding").alias("embedding"),
                    F.min("vec_id").alias("low"), F.count("*").alias("copies"))
               .withColumn("cls", F.monotonically_increasing_id()).withColumn("n_dims", F.size("embedding")))
    classes = written(classes, "classes")

    axes = {}
    for r in classes.groupBy("n_dims").count().collect():  # one row a dimension
        some = classes.where(F.col("n_dims") == r[0]).orderBy(F.xxhash64("k1", "k2")).limit(sample)
        axes[r[0]] = _axes([x[0] for x in some.select("embedding").collect()], r[0])
    shared = spark.sparkContext.broadcast(axes)

    def first_axis(batches):
        for f in batches:
            out = np.zeros(len(f))
            for n, at in f.groupby("n_dims").indices.items():
                out[at] = (_unit(f.iloc[at]) @ shared.value.get(n, np.eye(n)))[:, 0]
            yield f.assign(first=out)

    def cut(batches):
        yield from _tiles(shared.value, tile)(batches)

    order = ["label", "n_dims", "first", "cls"]
    tiles = written(classes.select("label", "n_dims", "cls", "copies", "embedding")
                    .mapInPandas(first_axis, "label string, n_dims int, cls long, copies long, embedding array<double>, first double")
                    .repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(cut, TILES), "tiles")

    # Pairs of tiles whose boxes come within the distance the threshold allows.
    reach = 2 - 2 * threshold + SLACK
    head = tiles.select("label", "n_dims", "tile", "low", "high")
    left, right = (head.select(F.col("label"), "n_dims", *[F.col(c).alias(f"{p}_{c}") for c in ("tile", "low", "high")])
                   for p in "ab")
    gap = F.aggregate(F.arrays_zip("a_low", "a_high", "b_low", "b_high"), F.lit(0.0), lambda acc, z: acc + F.pow(
        F.greatest(F.lit(0.0), z["a_low"] - z["b_high"], z["b_low"] - z["a_high"]), F.lit(2)))
    pairs = (left.join(right, ["label", "n_dims"]).where(F.col("a_tile") <= F.col("b_tile")).where(gap <= reach)
             .select("a_tile", "b_tile", (F.col("a_tile") == F.col("b_tile")).alias("same")))
    body = ["ids", "counts", "rotated", "exact"]
    loaded = (pairs.join(tiles.select(F.col("tile").alias("a_tile"), "n_dims", *[F.col(c).alias(f"a_{c}") for c in body]), "a_tile")
              .join(tiles.select(F.col("tile").alias("b_tile"), *[F.col(c).alias(f"b_{c}") for c in body]), "b_tile"))
    # A row is two whole tiles: few of them to an Arrow batch.
    rows_a_batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(rows_a_batch)
    spark.conf.set(rows_a_batch, "4")
    try:
        found = written(loaded.mapInPandas(_compare(threshold), "a long, b long, n long"), "links")
    finally:
        spark.conf.set(rows_a_batch, before)
    comp = components(found.where("b is not null").select("a", "b"))
    degree = found.where("b is null").groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("others"))
    info = (classes.select("cls", "k1", "k2", "low", "copies").join(degree, "cls", "left")
            .join(comp.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls")))
    lowest = info.groupBy("root").agg(F.min("low").alias("component_id"))
    info = (info.join(lowest, "root")
            .select("k1", "k2", "component_id", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    out = member.join(info, ["k1", "k2"], "left")
    comp_id = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp_id.alias("component_id"),
                      F.coalesce(F.col("vec_id") == comp_id, F.lit(False)).alias("kept"))
