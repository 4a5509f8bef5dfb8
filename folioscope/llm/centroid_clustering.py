"""Centroid clustering by dimension-sharded Lloyd rounds, in exact integers.

Vectors are cut into BLOCKS of columns and written once as shards: a shard holds one block of at most GROUP vectors. In a round each
shard computes its block's exact partial distances to the centroids' slices; these are added up by group, as reduceByKey
would, and the nearest centroid, the smaller number among equals, is taken. The assignments go back to the shards, and each shard sums its own columns by
centroid; a task's sums are added before the shuffle. The driver holds the centroids only: clusters x components numbers, both parameters.
No task holds more than one group's partial distances, whatever the number of vectors or how many of them are equal.

Defined results: vectors that haven't exactly `components` components or hold null or non-finite ones aren't kept and have no row. Components are floor(scale * x), x as
double; vectors with one so large that a distance could exceed 64 bits (2^27 for 64 components) aren't kept either. The first centroids are the kept
vectors with the smallest hash of the key; a null key comes after all others, equal keys go by their components. With fewer vectors than clusters each is a centroid.
An empty table gives an empty result. Repeated rows count each. Extra columns don't matter, as only key and vector are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.common import dropped, packed, table, unpacked, written

CLUSTERS, ROUNDS, COMPONENTS, SCALE, SEED = 40, 5, 64, 256, 2
BLOCKS, GROUP = 4, 256


def integer_vectors(vectors: DataFrame, key: str, vector: str, components: int, scale: int) -> DataFrame:
    """(id, x): key and integer components of the rows that are kept."""
    rows = vectors.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    most = float((1 << (61 - components.bit_length()) // 2) - 1)
    fits = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (x * float(scale)).between(-most, most))
    return rows.where(F.col("v").isNotNull() & (F.size("v") == components) & fits).select("id", F.transform("v", lambda x: F.floor(x * float(scale))).alias("x"))


def column_cuts(components: int) -> list[int]:
    return np.linspace(0, components, min(BLOCKS, components) + 1).astype(int).tolist()


def shards(rows: DataFrame, components: int) -> DataFrame:
    """(g, b, ids, part): columns of block b of the vectors of group g, row by row; block 0 has the ids. Groups are cut within tasks, without a shuffle."""
    kind = rows.schema["id"].dataType.simpleString()
    cuts = column_cuts(components)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        g = TaskContext.get().partitionId() << 33
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, components)
            for s in range(0, batch.num_rows, GROUP):
                ids = batch.column("id").slice(s, GROUP)
                parts = [packed(x[s : s + GROUP, a:e]) for a, e in zip(cuts[:-1], cuts[1:], strict=True)]
                lists = pa.array([ids.to_pylist()] + [None] * (len(parts) - 1), pa.list_(ids.type))
                yield pa.RecordBatch.from_arrays([pa.array([g] * len(parts), pa.int64()), pa.array(range(len(parts)), pa.int32()), lists, pa.array(parts, pa.binary())], ["g", "b", "ids", "part"])
                g += 1

    return rows.mapInArrow(run, f"g long, b int, ids array<{kind}>, part binary")


def partial_distances(part: np.ndarray, slices: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row to each centroid slice."""
    most = max(np.abs(part).max(initial=0), np.abs(slices).max(initial=0))
    if 4 * part.shape[1] * int(most) ** 2 < 1 << 53:  # doubles hold all sums exactly
        part, slices = part.astype(np.float64), slices.astype(np.float64)
    return ((part * part).sum(1)[:, None] + (slices * slices).sum(1) - 2 * (part @ slices.T)).astype(np.int64)


def nearest(parts: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(g, near, far): the nearest centroid of each vector of a group and the squared distance to it."""
    cuts, k = column_cuts(centroids.shape[1]), len(centroids)
    shared = parts.sparkSession.sparkContext.broadcast(centroids)  # clusters x components numbers

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g, b, part in zip(batch.column("g").to_pylist(), batch.column("b").to_pylist(), batch.column("part").to_pylist(), strict=True):
                own = shared.value[:, cuts[b] : cuts[b + 1]]
                d = packed(partial_distances(unpacked(part).reshape(-1, own.shape[1]), own))
                yield pa.RecordBatch.from_arrays([pa.array([g], pa.int64()), pa.array([d], pa.binary())], ["g", "d"])

    def add(t: pa.Table) -> pa.Table:
        total = sum(unpacked(d).reshape(-1, k) for d in t["d"].to_pylist())
        near = total.argmin(1)  # the first of equals
        return pa.table({"g": t["g"].slice(0, 1), "near": pa.array([packed(near)], pa.binary()), "far": pa.array([packed(total[np.arange(len(total)), near])], pa.binary())})

    return parts.select("g", "b", "part").mapInArrow(partial, "g long, d binary").groupBy("g").applyInArrow(add, "g long, near binary, far binary")


def moved(parts: DataFrame, found: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after each shard has summed its own columns by centroid; one without vectors stays."""
    cuts, k = column_cuts(centroids.shape[1]), len(centroids)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((k, e - a + 1), np.int64) for a, e in zip(cuts[:-1], cuts[1:], strict=True)]  # the last column counts
        for batch in batches:
            for b, part, near in zip(batch.column("b").to_pylist(), batch.column("part").to_pylist(), batch.column("near").to_pylist(), strict=True):
                x = unpacked(part).reshape(-1, cuts[b + 1] - cuts[b])
                np.add.at(total[b], unpacked(near), np.column_stack([x, np.ones(len(x), np.int64)]))
        for b, t in enumerate(total):
            c = np.flatnonzero(t[:, -1])
            yield pa.RecordBatch.from_arrays([pa.array([b] * len(c), pa.int32()), pa.array(c, pa.int32()), pa.array(t[c].tolist(), pa.list_(pa.int64()))], ["b", "c", "sums"])

    by_task = parts.select("g", "b", "part").join(found.select("g", "near"), "g").select("b", "part", "near").mapInArrow(sums, "b int, c int, sums array<long>")
    totals = by_task.select("b", "c", F.posexplode("sums")).groupBy("b", "c", "pos").agg(F.sum(F.col("col").cast("decimal(38,0)")).alias("total"))
    out = centroids.copy()
    rows = {(r["b"], r["c"], r["pos"]): int(r["total"]) for r in totals.collect()}  # clusters x (components + blocks) numbers
    for (b, c, pos), total in rows.items():
        if pos < cuts[b + 1] - cuts[b]:
            out[c, cuts[b] + pos] = total // rows[b, c, cuts[b + 1] - cuts[b]]
    return out


def cluster(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, components: int = COMPONENTS, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """The centroids, and one row for each kept vector: key, cluster, distance (squared), cluster_inertia and inertia (distances summed over its cluster and over all),
    centroid_sha256 (of the centroid's components in decimal, joined by commas)."""
    spark = vectors.sparkSession
    rows = integer_vectors(vectors, key, vector, components, scale)
    kind = rows.schema["id"].dataType.simpleString()
    first = rows.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).asc_nulls_last(), "x").limit(clusters).collect()
    centroids = np.array([r["x"] for r in first], np.int64).reshape(len(first), components)
    parts = written(shards(rows, components), "shards")
    for _ in range(rounds if len(first) else 0):
        found = written(nearest(parts, centroids), "nearest")
        centroids = moved(parts, found, centroids)
        dropped(found)

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (near, far) in enumerate(zip(batch.column("near").to_pylist(), batch.column("far").to_pylist(), strict=True)):
                ids = batch.column("ids").slice(i, 1).flatten()
                yield pa.RecordBatch.from_arrays([ids, pa.array(unpacked(near), pa.int32()), pa.array(unpacked(far), pa.int64())], ["id", "cluster", "distance"])

    found = nearest(parts, centroids) if len(first) else parts.where("false").select("g", F.lit(None).cast("binary").alias("near"), F.lit(None).cast("binary").alias("far"))
    result = written(parts.where("b = 0").select("g", "ids").join(found, "g").select("ids", "near", "far").mapInArrow(rows_of, f"id {kind}, cluster int, distance long"), "clustered")
    dropped(parts)
    inertia = {r["cluster"]: int(r["d"]) for r in result.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}  # one number for each cluster
    digest = [(c, d, sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, d in inertia.items()]
    about = spark.createDataFrame(digest, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = result.join(F.broadcast(about), "cluster").select(F.col("id").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    return out, centroids


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))[0]


def _rounds_sql() -> str:
    """Each round: all vectors to their nearest centroid, then the floored means."""
    far = "list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))"
    out = ""
    for r in range(ROUNDS + 1):
        out += f""",
a{r} AS MATERIALIZED (SELECT vec_id, c, d FROM (SELECT v.vec_id, c.c, {far} AS d FROM vectors v, c{r} c) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1)"""
        if r < ROUNDS:
            out += f""",
s{r} AS (SELECT c, i, sum(x[i]) AS s, count(*) AS n FROM a{r} JOIN vectors USING (vec_id), range(1, 65) t(i) GROUP BY c, i),
m{r} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM s{r} GROUP BY c),
c{r + 1} AS MATERIALIZED (SELECT c, coalesce(m{r}.x, c{r}.x) AS x FROM c{r} LEFT JOIN m{r} USING (c))"""
    return out


OP13_SQL = f"""
WITH vectors AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = {COMPONENTS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {COMPONENTS}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, x FROM (SELECT sha256('{SEED}:' || vec_id) AS h, x FROM vectors ORDER BY h LIMIT {CLUSTERS})){_rounds_sql()}
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(x, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN c{ROUNDS} USING (c)"""
