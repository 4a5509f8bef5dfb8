"""Connected components of a link table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import materialize


def local_roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest of n points that each is connected with under the links a[i]-b[i]."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def contracted(edges: DataFrame) -> DataFrame:
    """(u, v): of each batch of edges (a, b) the star of each of its components, each node u with the smallest one v. The same components
    with fewer edges; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            nodes, at = np.unique(np.concatenate([x.column("a").to_numpy(), x.column("b").to_numpy()]), return_inverse=True)
            v = nodes[local_roots(at[: x.num_rows], at[x.num_rows :], len(nodes))]
            yield pa.RecordBatch.from_pydict({"u": pa.array(nodes[v < nodes]), "v": pa.array(v[v < nodes])})

    return edges.mapInArrow(run, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): for each node of edges (a, b) the smallest node it is connected with.

    After a contraction within batches, alternates large-star and small-star steps (each a min by node, which combines before the shuffle, and a join that
    Spark can split where a node is hot) until the table stops changing; each round is written to the checkpoint folder.
    """
    now = materialize(contracted(edges.where("a != b").select("a", "b")).distinct())
    state = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").selectExpr("inline(array(struct(v as u, m as v), struct(u as u, m as v)))").where("u != v").distinct()
        now = materialize(small)
        then, state = state, now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if then == state:
            break
    return now.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u as node", "m as component").unionByName(now.select("v", F.col("v").alias("m")).distinct().toDF("node", "component"))
