"""Vector code compression: one codebook for each part of a vector, its nearest entry found by a GNAT over the entries.

A node of the tree has split points and, for each split point and child, the range of distances between them. A query takes its distances to the split points; a child
goes when for some split point the range lies strictly outside of what could hold an entry as near as the best one so far. Square roots are
rounded so that a child is never dropped for rounding, and squared distances are integers, so that ties are seen exactly and go to the lower index. Vectors of
a batch go through the tree together, each only into the children that it can't exclude.

Each round is one pass over the table: a task codes its vectors, adds up its parts by entry, and sends parts x entries sums; there is
no other shuffle. The driver holds the codebooks only, whose size the parameters fix.

Defined results: rows whose vector is null or holds null or non-finite components are dropped. The vectors' length is that of the smallest key's kept vector of a length that `parts` divides;
vectors of other lengths, and those with a component so large that an error could exceed 64 bits, keep their row with null code and error and don't count in codebooks. Components are floor(scale * x), x as double. Null
keys come after all others; equal keys go by their components. With fewer vectors than entries there are as many entries as vectors. label_error adds the errors of equal labels,
nulls together. An empty table gives an empty result. Extra columns don't matter, as only key, vector and label are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.common import dropped, table, written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Children of a GNAT node, and entries up to which a node is a leaf.
ARITY, LEAF = 4, 3
#: Labels that are broadcast with their sums; more are joined by a shuffle.
FEW_LABELS = 100_000


def root_down(n: np.ndarray) -> np.ndarray:
    """Floor of the square roots of integers."""
    r = np.sqrt(n.astype(np.float64)).astype(np.int64)
    r -= r * r > n
    return r + ((r + 1) * (r + 1) <= n)


def root_up(n: np.ndarray) -> np.ndarray:
    """Ceiling of the square roots of integers."""
    r = root_down(n)
    return r + (r * r < n)


def squared(x: np.ndarray, point: np.ndarray) -> np.ndarray:
    d = x - point
    return (d * d).sum(1)


@dataclass
class Node:
    """A leaf has entries only. Else low[i, j] and high[i, j] bound the distance of split point i from all entries of child j, itself split point j's side."""

    entries: np.ndarray
    children: list[Node | None] = field(default_factory=list)
    low: np.ndarray | None = None
    high: np.ndarray | None = None


class Gnat:
    def __init__(self, entries: np.ndarray, arity: int = ARITY, leaf: int = LEAF) -> None:
        self.points, self.arity, self.leaf = entries.astype(np.int64), max(2, arity), max(1, leaf)
        self.root = self._build(np.arange(len(entries)))

    def _build(self, at: np.ndarray) -> Node:
        if len(at) <= max(self.leaf, self.arity):
            return Node(at)
        splits = [0]
        far = squared(self.points[at], self.points[at[0]])
        while len(splits) < self.arity:  # each next split point is the one farthest from those before
            splits.append(int(far.argmax()))
            far = np.minimum(far, squared(self.points[at], self.points[at[splits[-1]]]))
        splits = np.unique(splits)  # equal entries may leave fewer
        if len(splits) == 1:
            return Node(at)
        d = np.stack([squared(self.points[at], self.points[at[s]]) for s in splits])
        side = d.argmin(0)
        side[splits] = np.arange(len(splits))
        rest = np.ones(len(at), bool)
        rest[splits] = False
        low, high, children = np.zeros((len(splits), len(splits)), np.int64), np.zeros((len(splits), len(splits)), np.int64), []
        for j in range(len(splits)):
            own = np.flatnonzero((side == j) & rest)
            children.append(self._build(at[own]) if len(own) else None)
            if len(own):
                low[:, j], high[:, j] = root_down(d[:, own].min(1)), root_up(d[:, own].max(1))
        return Node(at[splits], children, low, high)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Index of and squared distance to the nearest entry of each row, the lower index among equals; and how many distances were computed."""
        best = np.full(len(x), np.iinfo(np.int64).max)
        index = np.full(len(x), len(self.points))
        computed = 0

        def look(node: Node, rows: np.ndarray) -> None:
            nonlocal computed
            seen = []
            for e in node.entries.tolist():
                d = squared(x[rows], self.points[e])
                computed += len(rows)
                better = (d < best[rows]) | ((d == best[rows]) & (e < index[rows]))
                best[rows[better]], index[rows[better]] = d[better], e
                seen.append(d)
            if not node.children:
                return
            down, up = [root_down(d) for d in seen], [root_up(d) for d in seen]
            for j, child in enumerate(node.children):
                if child is None:
                    continue
                reach = root_up(best[rows])
                may = np.ones(len(rows), bool)
                for i in range(len(seen)):
                    may &= (down[i] - reach <= node.high[i, j]) & (up[i] + reach >= node.low[i, j])
                if may.any():
                    look(child, rows[may])

        if len(x) and len(self.points):
            look(self.root, np.arange(len(x)))
        return index, best, computed


class Codebooks:
    """Codebooks of all parts with their trees: books is parts x entries x width."""

    def __init__(self, books: np.ndarray) -> None:
        self.books, self.width = books, books.shape[2]
        self.trees = [Gnat(b) for b in books]

    def code(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes (rows x parts) and squared errors of integer vectors."""
        codes, error = np.zeros((len(x), len(self.trees)), np.int64), np.zeros(len(x), np.int64)
        for p, tree in enumerate(self.trees):
            codes[:, p], d, _ = tree.nearest(x[:, p * self.width : (p + 1) * self.width])
            error += d
        return codes, error

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([self.books[p, codes[:, p]] for p in range(len(self.books))], 1)

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.reshape(-1).tolist())).encode()).hexdigest()


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def moved(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round; unused entries stay."""
    parts, entries, width = books.shape
    shared = rows.sparkSession.sparkContext.broadcast(Codebooks(books))  # parts x entries x width numbers

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, entries, width + 1), np.int64)  # the last column counts
        for b in batches:
            x = _matrix(b.column("x"), parts * width)
            codes, _ = shared.value.code(x)
            for p in range(parts):
                np.add.at(total[p], codes[:, p], np.column_stack([x[:, p * width : (p + 1) * width], np.ones(len(x), np.int64)]))
        p, e = np.nonzero(total[:, :, -1])
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(total[p, e].tolist(), pa.list_(pa.int64()))], ["p", "e", "sums"])

    by_task = rows.select("x").mapInArrow(sums, "p int, e int, sums array<long>")
    totals = by_task.select("p", "e", F.posexplode("sums")).groupBy("p", "e", "pos").agg(F.sum(F.col("col").cast("decimal(38,0)")).alias("total"))
    found = {(r["p"], r["e"], r["pos"]): int(r["total"]) for r in totals.collect()}  # parts x entries x (width + 1) numbers
    out = books.copy()
    for (p, e, pos), total in found.items():
        if pos < width:
            out[p, e, pos] = total // found[p, e, width]
    return out


def vector_codes(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, Codebooks | None]:
    """The codebooks (None without vectors), and one row for each kept vector: key, code (two hex digits a part), error (squared, summed over parts), label_error, codebooks_sha256."""
    if not 1 <= entries <= 256:
        raise ValueError("entries must be 1 to 256, as an index is two hex digits")
    given = vectors.select(F.col(key).alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    kept = given.where(F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    most = float((1 << 24) - 1)  # errors of up to 2^13 components then stay below 2^63
    fits = F.forall("v", lambda x: (x * float(scale)).between(-most, most))
    numbers = kept.select("id", "label", F.when(fits & (F.size("v") > 0) & (F.size("v") % parts == 0), F.transform("v", lambda x: F.floor(x * float(scale)))).alias("x"))
    kinds = f"id {numbers.schema['id'].dataType.simpleString()}, label {numbers.schema['label'].dataType.simpleString()}"
    stored = rows = written(numbers, "integer-vectors")
    lead = rows.where("x is not null").orderBy(F.col("id").asc_nulls_last(), "x").select(F.size("x").alias("d")).first()
    if lead is None:
        return rows.select(F.col("id").alias(key), F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"), F.lit(None).cast("long").alias("label_error"), F.lit(None).cast("string").alias("codebooks_sha256")), None
    width = lead["d"] // parts
    rows = rows.withColumn("x", F.when(F.size("x") == lead["d"], F.col("x")))
    coded = rows.where("x is not null")
    first = coded.orderBy(F.col("id").asc_nulls_last(), "x").limit(entries).collect()
    books = np.array([r["x"] for r in first], np.int64).reshape(len(first), parts, width).transpose(1, 0, 2)
    for _ in range(rounds):
        books = moved(coded, books)
    final = Codebooks(books)
    shared = vectors.sparkSession.sparkContext.broadcast(final)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            has = b.column("x").is_valid()
            codes, error = shared.value.code(_matrix(b.column("x").filter(has), parts * width))
            at = np.cumsum(has.to_numpy(zero_copy_only=False)) - 1
            hexes = [c.tobytes().hex() for c in codes.astype(np.uint8)]
            valid = has.to_pylist()
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array([hexes[i] if ok else None for i, ok in zip(at, valid, strict=True)], pa.string()), pa.array([int(error[i]) if ok else None for i, ok in zip(at, valid, strict=True)], pa.int64())], ["id", "label", "code", "error"])

    result = written(rows.mapInArrow(code, f"{kinds}, code string, error long"), "codes")
    dropped(stored)
    by_label = written(result.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error")).withColumnRenamed("label", "of"), "label-errors")
    sums = F.broadcast(by_label) if by_label.count() <= FEW_LABELS else by_label
    out = result.join(sums, F.col("label").eqNullSafe(F.col("of")), "left")
    return out.select(F.col("id").alias(key), "code", "error", "label_error", F.lit(final.sha256()).alias("codebooks_sha256")), final


def decoded(codes: DataFrame, books: Codebooks, key: str = "vec_id", scale: int = SCALE) -> DataFrame:
    """(key, vector): the vectors that codes stand for, each component the middle of its integer's interval; null for a null code."""
    kind = codes.schema[key].dataType.simpleString()
    shared = codes.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [None if c is None else ((shared.value.decode(np.frombuffer(bytes.fromhex(c), np.uint8)[None])[0] + 0.5) / scale) for c in b.column("code").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("k"), pa.array(out, pa.list_(pa.float64()))], [key, "vector"])

    return codes.select(F.col(key).alias("k"), "code").mapInArrow(run, f"`{key}` {kind}, vector array<double>")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings"))[0]


def _rounds_sql() -> str:
    """Each round: all parts to their nearest entry, then the floored means."""
    far = "list_sum(list_transform(range(1, len(v.x) + 1), lambda i: (v.x[i] - b.x[i]) * (v.x[i] - b.x[i])))"
    out = ""
    for r in range(ROUNDS + 1):
        out += f""",
a{r} AS MATERIALIZED (SELECT vec_id, p, e, d FROM (SELECT v.vec_id, v.p, b.e, {far} AS d FROM parts v JOIN b{r} b USING (p)) QUALIFY row_number() OVER (PARTITION BY vec_id, p ORDER BY d, e) = 1)"""
        if r < ROUNDS:
            out += f""",
s{r} AS (SELECT p, e, i, sum(x[i]) AS s, count(*) AS n FROM a{r} JOIN parts USING (vec_id, p), range(1, 9) t(i) GROUP BY p, e, i),
m{r} AS (SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM s{r} GROUP BY p, e),
b{r + 1} AS MATERIALIZED (SELECT p, e, coalesce(m{r}.x, b{r}.x) AS x FROM b{r} LEFT JOIN m{r} USING (p, e))"""
    return out


#: For vectors of 64 components.
OP11_SQL = f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
parts AS MATERIALIZED (SELECT vec_id, p, x[p * 8 + 1 : p * 8 + 8] AS x FROM kept, range({PARTS}) t(p)),
b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x FROM parts QUALIFY row_number() OVER (PARTITION BY p ORDER BY vec_id) <= {ENTRIES}){_rounds_sql()},
codes AS (SELECT vec_id, string_agg(printf('%02x', CAST(e AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY vec_id),
digest AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM codes JOIN kept USING (vec_id), digest"""
