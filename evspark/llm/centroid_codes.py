"""Clustering of vectors around centroids with dictionaries of subvectors, in exact integer arithmetic.

The dimensions are cut into blocks. In groups of vectors, each block is encoded without loss as codes into the distinct
subvectors that occur there. A round computes, once for each distinct subvector, its squared distance to that block of
every centroid; a vector's distance is the sum of those of its codes. Sums over a cluster come from the same
dictionaries, as counts of codes times subvectors.

A group is a row of a table that is written once and read in each round. Only sums of clusters leave a task, so a
round moves a few rows for each task, whatever the number of vectors, and equal or near-equal vectors cost nothing
extra. A dictionary belongs to its group, not to the whole table: the number of distinct subvectors has no bound, so one
dictionary for all could be neither broadcast nor held.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evspark.llm.common import column, written

#: Components beyond this could take a squared distance past a long.
MOST = 1 << 27
GROUPS = "ids array<long>, codes array<binary>, subvectors array<binary>"


def usable(vector: Column, dims: int) -> Column:
    """Whether a vector has exactly ``dims`` components, none of them null or not finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(vector) == dims) & finite, F.lit(False))


def _whole(values: np.ndarray, scale: float) -> np.ndarray:
    x = np.floor(values.astype(np.float64) * scale)
    if len(x) and np.abs(x).max() > MOST:
        raise ValueError(f"components beyond {MOST} after scaling")
    return x.astype(np.int64)


def _distinct(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of a block and each row's place among them."""
    low = block.min(0)
    span = block.max(0) - low + 1
    if np.prod(span.astype(np.float64)) < 2.0**62:
        key = np.zeros(len(block), np.int64)
        for j in range(block.shape[1]):
            key = key * span[j] + (block[:, j] - low[j])
        _, first, code = np.unique(key, return_index=True, return_inverse=True)
        return block[first], code
    rows, code = np.unique(block, axis=0, return_inverse=True)
    return rows, code.reshape(-1)


def encode(vectors: DataFrame, id_col: str, vector_col: str, *, dims: int, scale: float, width: int, group: int) -> DataFrame:
    """One row for each group of up to ``group`` vectors of a partition: ids, codes and subvectors of each block."""

    def run(batches):
        import pyarrow as pa

        def grouped(ids, parts):
            x = np.concatenate(parts)
            codes, subvectors = [], []
            for lo in range(0, dims, width):
                rows, code = _distinct(x[:, lo : lo + width])
                codes.append(code.astype(np.uint16 if len(rows) <= 1 << 16 else np.uint32).tobytes())
                subvectors.append(rows.astype("<i4").tobytes())
            return pa.RecordBatch.from_arrays(
                [pa.array([ids], pa.list_(pa.int64())), pa.array([codes], pa.list_(pa.binary())), pa.array([subvectors], pa.list_(pa.binary()))],
                ["ids", "codes", "subvectors"],
            )

        ids, parts, held = [], [], 0
        for batch in batches:
            for lo in range(0, batch.num_rows, group):
                part = batch.slice(lo, group)
                values = column(part, vector_col).flatten().to_numpy(zero_copy_only=False)
                ids += column(part, id_col).to_pylist()
                parts.append(_whole(values.reshape(-1, dims), scale))
                held += part.num_rows
                if held >= group:
                    yield grouped(ids, parts)
                    ids, parts, held = [], [], 0
        if held:
            yield grouped(ids, parts)

    kept = vectors.where(usable(F.col(vector_col), dims)).select(F.col(id_col).cast("long").alias(id_col), vector_col)
    return written(kept.mapInArrow(run, GROUPS))


def _assigned(codes: list[bytes], subvectors: list[bytes], n: int, centroids: np.ndarray, width: int):
    """(nearest centroid, squared distance, codes, subvectors) of a group's vectors; ties go to the smaller number."""
    dims = centroids.shape[1]
    total = np.zeros((n, len(centroids)), np.int64)
    read, rows_of = [], []
    for b, (code, sub) in enumerate(zip(codes, subvectors, strict=True)):
        lo = b * width
        w = min(width, dims - lo)
        rows = np.frombuffer(sub, "<i4").reshape(-1, w).astype(np.int64)
        at = np.frombuffer(code, np.uint16 if len(rows) <= 1 << 16 else np.uint32)
        apart = np.zeros((len(rows), len(centroids)), np.int64)
        for j in range(w):
            apart += (rows[:, j, None] - centroids[None, :, lo + j]) ** 2
        total += apart[at]
        read.append(at)
        rows_of.append(rows)
    nearest = total.argmin(1)
    return nearest, total[np.arange(n), nearest], read, rows_of


def _moved(groups: DataFrame, centroids: list[list[int]], width: int) -> list[list[int]]:
    """The floor of the mean of each centroid's vectors; a centroid without vectors stays."""
    k, dims = len(centroids), len(centroids[0])

    def run(batches):
        import pyarrow as pa

        at, counts, sums = np.array(centroids, np.int64), np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            for ids, codes, subvectors in zip(*(batch.column(i) for i in range(3)), strict=True):
                nearest, _, read, rows_of = _assigned(codes.as_py(), subvectors.as_py(), len(ids), at, width)
                counts += np.bincount(nearest, minlength=k)
                for b, (code, rows) in enumerate(zip(read, rows_of, strict=True)):
                    often = np.bincount(nearest * len(rows) + code, minlength=k * len(rows)).reshape(k, len(rows))
                    sums[:, b * width : b * width + rows.shape[1]] += often @ rows
        full = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(full, pa.int32()), pa.array(counts[full], pa.int64()), pa.array(sums[full].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "total"]
        )

    parts = groups.mapInArrow(run, "cluster int, n long, total array<long>")
    exact = [F.sum(F.col("total")[j].cast("decimal(38,0)")).alias(f"t{j}") for j in range(dims)]
    found = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *exact).collect()  # at most a row for each centroid
    out = list(centroids)
    for r in found:
        out[r["cluster"]] = [int(r[f"t{j}"]) // r["n"] for j in range(dims)]
    return out


def first_centroids(vectors: DataFrame, id_col: str, vector_col: str, k: int, dims: int, scale: float, salt: str) -> list[list[int]]:
    """The vectors with the k smallest hashes of salt and id, in that order; a null id comes last, then the smaller vector."""
    hashed = vectors.where(usable(F.col(vector_col), dims)).select(
        F.sha2(F.concat(F.lit(salt), F.col(id_col).cast("long").cast("string")).cast("binary"), 256).alias("h"),
        F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale)).alias("v"),
    )
    return [list(r["v"]) for r in hashed.orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()]


def cluster(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    *,
    dims: int = 64,
    k: int = 16,
    rounds: int = 3,
    scale: float = 64.0,
    salt: str = "1:",
    width: int = 2,
    group: int = 32_768,
) -> tuple[DataFrame, list[list[int]]]:
    """(one row for each usable vector, the final centroids).

    A row has the id, cluster, distance (squared), cluster_inertia and inertia (sums of distances). Vectors of another
    length, null, or with a null or non-finite component are left out; those that repeat, also under one id, count each
    time; a null id is kept and is the last to start a centroid; fewer than k vectors start fewer centroids; none give no
    rows; other columns are ignored. A component beyond 2**27 after scaling is an error, as sums could pass a long.
    """
    name = "__id"
    given = vectors.select(F.col(id_col).alias(name), F.col(vector_col).alias("__vector"))
    centroids = first_centroids(given, name, "__vector", k, dims, scale, salt)
    schema = f"`{id_col}` long, cluster int, distance long"
    if not centroids:
        return vectors.sparkSession.createDataFrame([], schema + ", cluster_inertia long, inertia long"), []
    groups = encode(given, name, "__vector", dims=dims, scale=scale, width=width, group=group)
    for _ in range(rounds):
        centroids = _moved(groups, centroids, width)

    def run(batches):
        import pyarrow as pa

        at = np.array(centroids, np.int64)
        for batch in batches:
            for ids, codes, subvectors in zip(*(batch.column(i) for i in range(3)), strict=True):
                nearest, distance, _, _ = _assigned(codes.as_py(), subvectors.as_py(), len(ids), at, width)
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(nearest, pa.int32()), pa.array(distance, pa.int64())], [id_col, "cluster", "distance"])

    rows = written(groups.mapInArrow(run, schema))
    sums = rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()  # at most a row for each centroid
    inertia = {r["cluster"]: r["s"] for r in sums}
    of_cluster = F.element_at(F.create_map(*[F.lit(x) for pair in inertia.items() for x in pair]), F.col("cluster"))
    return rows.withColumn("cluster_inertia", of_cluster).withColumn("inertia", F.lit(sum(inertia.values())).cast("long")), centroids


def with_digest(rows: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """rows with centroid_sha256: the hash of the components of its cluster's centroid, joined by commas."""
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return rows.withColumn("centroid_sha256", F.element_at(F.array(*map(F.lit, digests)), F.col("cluster") + 1) if digests else F.lit(None).cast("string"))
