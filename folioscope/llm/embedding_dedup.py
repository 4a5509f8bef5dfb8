"""Embedding near-dedup by product quantisation.

Coarse centroids and, for the residuals, one codebook for each of PARTS subspaces are fitted on at most SAMPLE vectors (by a
hash of the key); there is a list for every 400 vectors, LISTS at most. Every vector is then put into the inverted list of its nearest centroid, with its code. Each vector is
also a query: it probes its own list, and any other whose centroid is nearly as close, x.c1 - x.c <= TURN / sqrt(d) * |c1 - c|. A vector at cosine 0.9 that turns from x in a random direction of d dimensions
moves by 0.48 / sqrt(d) of |c1 - c| in the mean square; recall is measured in the tests. There is no cap on probes. A pair that only one of the two vectors
finds counts for both: the asking block adds the other's link where the other doesn't probe the asker's list. In a
list, distances of all codes come from the query's table of subspace products; since a vector's distance from its code is kept, a pair
is passed over only if its cosine can't reach the threshold; the rest get their exact cosine in double precision.

Equal vectors are compared once, with their number as weight. A list goes in blocks of about BLOCK vectors, queries and members
alike, so that a list with a third of all vectors is many small tasks. A block gives link counts and a spanning forest of its links,
not its pairs. There is no cap on links or candidates.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link with nothing: n_links 0, their own component.
Vectors of different lengths don't link; each length is joined by itself. Rows with a null key likewise (component null). A repeated key keeps its rows: each counts as a vector. Only key and vector are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.common import materialize, table
from folioscope.llm.graph import components, local_roots

THRESHOLD, SAMPLE, LISTS, PARTS, CODES, TURN, BLOCK, SLICE = 0.9, 40_000, 4096, 8, 64, 0.64, 2048, 2048
#: Bytes of the sample on the driver, vectors of many components being fewer.
SAMPLE_BYTES = 96 << 20


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The nearest of c to each row; SLICE rows at a time, so that no matrix of all distances is made."""
    half = 0.5 * (c * c).sum(1)
    return np.concatenate([(x[s : s + SLICE] @ c.T - half).argmax(1) for s in range(0, len(x), SLICE)] or [np.zeros(0, np.int64)])


def _kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        at = _nearest(x, c)
        n = np.bincount(at, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


class Quantiser:
    """Coarse centroids of length one, and codebooks of the residuals."""

    def __init__(self, sample: np.ndarray, lists: int) -> None:
        c = _kmeans(sample, lists, 10, 1)
        self.centroids = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        self.turn = TURN / np.sqrt(sample.shape[1])
        rest = sample - self.centroids[_nearest(sample, self.centroids)]
        self.cuts = np.linspace(0, sample.shape[1], min(PARTS, sample.shape[1]) + 1).astype(int)
        self.books = [_kmeans(rest[:, s:e], CODES, 8, 2 + i) for i, (s, e) in enumerate(zip(self.cuts[:-1], self.cuts[1:], strict=True))]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        """Nearest list, code, distance from the coded point, and probed lists of each unit vector."""
        dots = x @ self.centroids.T
        at = dots.argmax(1)
        rest = x - self.centroids[at]
        codes = np.empty((len(x), len(self.books)), np.uint8)
        lost = np.zeros(len(x))
        for m, (s, e) in enumerate(zip(self.cuts[:-1], self.cuts[1:], strict=True)):
            book = self.books[m]
            codes[:, m] = (rest[:, s:e] @ book.T - 0.5 * (book * book).sum(1)).argmax(1)
            lost += ((rest[:, s:e] - book[codes[:, m]]) ** 2).sum(1)
        probes = []
        for s in range(0, len(x), SLICE // 8):  # the gaps of a few rows' own centroids at a time
            own = at[s : s + SLICE // 8]
            gaps = self.turn * np.sqrt(np.maximum(0, 2 - 2 * self.centroids[own] @ self.centroids.T))
            near = dots[s : s + SLICE // 8]
            probes += [np.flatnonzero(row) for row in near[np.arange(len(own)), own][:, None] - near <= gaps]
        return at, codes, np.sqrt(lost), probes

    def estimate(self, x: np.ndarray, which: int, codes: np.ndarray) -> np.ndarray:
        """Estimated dot products of queries with the members of one list, by table look-up."""
        out = np.repeat((x @ self.centroids[which])[:, None].astype(np.float32), len(codes), 1)
        for m, (s, e) in enumerate(zip(self.cuts[:-1], self.cuts[1:], strict=True)):
            out += (x[:, s:e] @ self.books[m].T).astype(np.float32)[:, codes[:, m]]
        return out


def unit(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have a direction, and these rows as unit vectors in double precision; all of one length."""
    lengths = pa.compute.list_value_length(vectors).to_numpy(zero_copy_only=False)
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), int(lengths[0]) if len(lengths) else 0)
    scale = np.abs(x).max(1, initial=0)
    ok = np.isfinite(scale) & (scale > 0)
    x = x[ok] / scale[ok, None]
    return ok, x / np.linalg.norm(x, axis=1, keepdims=True)


def fit(points: DataFrame, n: int, sample: int = SAMPLE) -> Quantiser:
    """points: key, v. At most `sample` vectors and SAMPLE_BYTES come to the driver."""
    sample = max(1, min(sample, SAMPLE_BYTES // (8 * points.select(F.size("v")).first()[0])))
    share = min(1.0, 1.2 * sample / max(1, n))
    some = points.where(F.pmod(F.xxhash64("rep"), F.lit(1 << 20)) < share * (1 << 20)).orderBy(F.xxhash64("rep")).limit(sample).select("v").toArrow()
    x = unit(some["v"].combine_chunks())[1]
    return Quantiser(x, int(min(LISTS, max(8, n // 400), max(1, len(x) // 10))))


def near_links(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each of vectors: key, n_links, component_id, kept."""
    kind = "array<float>" if vectors.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast(kind).alias("v"))
    finite = F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    lengths = [r["d"] for r in rows.where(finite).groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").collect()]
    out = rows.where(~F.coalesce(finite, F.lit(False))).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    for d in lengths:  # vectors link with others of their length only; most tables have one
        out = out.unionByName(_links_of_one_length(rows.where(finite & (F.size("v") == d)), kind, threshold))
    return out.select(F.col("id").alias(key), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _links_of_one_length(rows: DataFrame, kind: str, threshold: float) -> DataFrame:
    """(id, n_links, component_id) of rows (id, v), all of one length and with a direction."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.ascontiguousarray(b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).astype(np.float64)) + 0.0  # -0 counts as 0
            yield pa.RecordBatch.from_pydict({"id": b.column("id"), "same": pa.array([hashlib.md5(r.tobytes()).hexdigest() for r in x]), "v": b.column("v")})

    valid = materialize(rows.mapInArrow(digest, f"id long, same string, v {kind}"))
    groups = valid.groupBy("same").agg(F.min("id").alias("rep"), F.count("*").alias("weight"))
    points = materialize(valid.select("id", "same", "v").join(groups, "same").where("id = rep").dropDuplicates(["rep"]).select("rep", "weight", "v"))
    n = points.count()
    shared = rows.sparkSession.sparkContext.broadcast(fit(points, n))  # at most LISTS centroids

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, codes, lost, probes = shared.value.encode(unit(b.column("v"))[1])
            yield pa.RecordBatch.from_pydict({"rep": b.column("rep"), "weight": b.column("weight"), "v": b.column("v"), "list": pa.array(at, pa.int32()), "code": pa.array([c.tobytes() for c in codes], pa.binary()), "lost": pa.array(lost), "probes": pa.array([p.astype(np.int32) for p in probes], pa.list_(pa.int32()))})

    coded = materialize(points.mapInArrow(encode, f"rep long, weight long, v {kind}, list int, code binary, lost double, probes array<int>"))
    queries = coded.select("rep", "weight", "v", F.col("list").alias("home"), F.explode("probes").alias("list"))
    blocks = coded.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("mb")).join(queries.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("qb")), "list")
    spread = F.xxhash64("rep", F.lit(7))
    members = coded.join(blocks, "list").select("rep", "weight", "v", "list", F.col("list").alias("home"), "probes", "code", "lost", F.pmod(spread, "mb").cast("int").alias("m"), F.explode(F.sequence(F.lit(0), F.col("qb") - 1)).alias("q"))
    asking = queries.join(blocks, "list").select("rep", "weight", "v", "list", "home", F.lit(None).cast("array<int>").alias("probes"), F.lit(None).cast("binary").alias("code"), F.lit(None).cast("double").alias("lost"), F.explode(F.sequence(F.lit(0), F.col("mb") - 1)).alias("m"), F.pmod(spread, "qb").cast("int").alias("q"))

    def compare(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        is_member = t["code"].is_valid().to_numpy(zero_copy_only=False)
        if is_member.all() or not is_member.any():
            return pa.table({"a": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        x = unit(t["v"].combine_chunks())[1]
        ids, weight = t["rep"].to_numpy(), t["weight"].to_numpy()
        q, m = np.flatnonzero(~is_member), np.flatnonzero(is_member)
        codes = np.frombuffer(b"".join(t["code"].filter(pa.array(is_member)).to_pylist()), np.uint8).reshape(len(m), -1)
        lost = t["lost"].to_numpy(zero_copy_only=False)[m]
        i, j = np.nonzero(shared.value.estimate(x[q], t["list"][0].as_py(), codes) >= threshold - lost - 1e-5)
        keep = ids[q[i]] != ids[m[j]]
        i, j = q[i[keep]], m[j[keep]]
        good = np.concatenate([np.einsum("ij,ij->i", x[i[s : s + 65536]], x[j[s : s + 65536]]) >= threshold for s in range(0, len(i), 65536)] or [np.zeros(0, bool)])
        i, j = i[good], j[good]
        home, probes, lists = t["home"].to_numpy().astype(np.int64), t["probes"].combine_chunks(), len(shared.value.centroids)
        asked = np.repeat(np.arange(len(ids)), pa.compute.fill_null(pa.compute.list_value_length(probes), 0).to_numpy(zero_copy_only=False)) * lists + probes.flatten().to_numpy()
        alone = ~np.isin(j * lists + home[i], asked)  # j doesn't probe the list of i
        links = (np.bincount(i, weights=weight[j], minlength=len(ids)) + np.bincount(j[alone], weights=weight[i[alone]], minlength=len(ids))).astype(np.int64)
        uniq, inverse = np.unique(ids, return_inverse=True)
        root = uniq[local_roots(inverse[i], inverse[j], len(uniq))][inverse]
        out = np.flatnonzero((links > 0) | (root != ids))
        return pa.table({"a": pa.array(ids[out]), "n": pa.array(links[out]), "b": pa.array(root[out])})

    found = materialize(members.unionByName(asking).groupBy("list", "m", "q").applyInArrow(compare, "a long, n long, b long"))
    counts = found.groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    parts = components(found.select("a", "b"))
    results = groups.join(counts, "rep", "left").join(parts, F.col("rep") == F.col("node"), "left").select("same", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    return valid.select("id", "same").join(results, "same").select("id", "n_links", "component_id")


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_links(table(spark, sf_dir, "embeddings"))
