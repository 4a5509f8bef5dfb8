"""Similar titles without comparing all: blocks of titles whose lengths allow the ratio, compared by their character counts.

The matcher's ratio is 2 M / (a + b) for M characters that both titles have in blocks, of a and b in all. M is at most the overlap of the two multisets of
characters. For a ratio of r two titles need an overlap of r (a + b) / 2, so neither is shorter than r / (2 - r) of the other: titles fall into bands of lengths, and a
band meets itself and the two beside it. A band is cut into blocks of about BLOCK titles; each two blocks are one group of one task, which adds up the overlaps of all
its pairs in arrays, 37 counts a title, and gives those that reach the bound. Each two titles meet in one group only; what has too small an
overlap goes before the matcher sees it. Nothing is missed, as no bound is below the ratio.

Long titles of one language have nearly the same characters, so that most of them reach that bound. M is also at most the length of the longest common subsequence, as the matcher's blocks stand
in one order in both. Where the matcher is asked next, titles travel with their blocks and that bound is applied there, so that hardly any other pair leaves the group; else texts don't travel.
"""

from __future__ import annotations

import difflib
import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from folioscope.checkpoints import materialized

#: What normalised titles are made of.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789 "
#: Titles in a block, about, and how many of them are compared with another block at once.
BLOCK, SLICE = 1024, 64
_CODES = np.frombuffer(ALPHABET.encode(), np.uint8)


@F.pandas_udf(DoubleType())
def title_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """The matcher's ratio, 0 to 1; 0 where either is empty. Not symmetric: the incoming title goes left."""

    def one(a: str, b: str) -> float:
        if not a or not b:
            return 0.0
        return 1.0 if a == b else difflib.SequenceMatcher(None, a, b).ratio()

    return pd.Series([one(a, b) for a, b in zip(left, right, strict=True)], dtype=float)


def _places(t: str) -> dict[str, int]:
    """Where each character stands, as bits."""
    out: dict[str, int] = {}
    for i, c in enumerate(t):
        out[c] = out.get(c, 0) | 1 << i
    return out


def may_reach(a: str, b: str, minimum: float, places: dict[str, int] | None = None) -> bool:
    """Whether the longest common subsequence of two titles allows a ratio of `minimum`. `places`: _places(b). A subsequence so long lacks few characters of either, so that
    half of a has its share of it near the same half of b: most pairs end there."""
    places = _places(b) if places is None else places
    n, m = len(a), len(b)
    least = math.ceil(minimum * (n + m) / 2 - 1e-9)
    if least > min(n, m):
        return False
    for i, j in ((n // 2, min(m, n // 2 + m - least)), (n, m)):
        left = whole = (1 << j) - 1  # bits of b that no step of the subsequence ends at
        for c in a[:i]:
            x = left & places.get(c, 0)
            left = (left + x | left - x) & whole
        if j - left.bit_count() < least - (n - i):
            return False
    return True


def _counts(c: str) -> Column:
    """How often each character of ALPHABET is in a title, as 32-bit integers."""

    def run(s: pa.Array) -> pa.Array:
        return pa.array([np.bincount(np.frombuffer(v.as_buffer(), np.uint8), minlength=256)[_CODES].astype("<i4").tobytes() for v in s], pa.binary())

    return F.arrow_udf(run, "binary")(c)


def _overlaps(minimum: float, within: list[str], left: list[str], right: list[str], ordered: bool, matched: bool):
    """What a group of two blocks does: the pairs whose overlap reaches the bound, `matched`: and whose longest common subsequence does."""
    shortest = minimum / (2 - minimum)

    def side(rows: pa.Table, value: bool) -> tuple[pa.Table, np.ndarray, np.ndarray]:
        own = rows.filter(pc.equal(rows["__left"], value)).sort_by("__size").combine_chunks()
        return own, own["__size"].to_numpy(), np.frombuffer(b"".join(own["__counts"].to_pylist()), "<i4").reshape(-1, len(ALPHABET))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches))  # two blocks
        (a, a_size, a_counts), (b, b_size, b_counts) = side(rows, True), side(rows, False)
        if not len(a_size) or not len(b_size):
            return
        number = np.int16 if min(a_size[-1], b_size[-1]) < 2**15 and max(a_counts.max(), b_counts.max()) < 2**15 else np.int32
        a_counts, b_counts = a_counts.astype(number), np.ascontiguousarray(b_counts.T, number)
        used = np.flatnonzero(a_counts.any(axis=0) & b_counts.any(axis=1)).tolist()
        a_id, b_id = a["l"].to_numpy(), b["r"].to_numpy()
        a_t, b_t = (x["t"].to_pylist() if matched else [] for x in (a, b))
        places = cache(lambda j: _places(b_t[j]))
        for s in range(0, len(a_size), SLICE):
            e = min(s + SLICE, len(a_size))
            low, high = np.searchsorted(b_size, a_size[s] * shortest - 0.5), np.searchsorted(b_size, a_size[e - 1] / shortest + 0.5, side="right")
            overlap = np.zeros((e - s, high - low), number)
            for c in used:
                overlap += np.minimum(a_counts[s:e, c, None], b_counts[None, c, low:high])
            fits = overlap >= (a_size[s:e, None] + b_size[None, low:high]) * (minimum / 2) - 1e-9
            if ordered:
                fits &= a_id[s:e, None] < b_id[None, low:high]
            i, j = np.nonzero(fits)
            if matched:
                kept = np.array([may_reach(a_t[x + s], b_t[y + low], minimum, places(y + low)) for x, y in zip(i.tolist(), j.tolist(), strict=True)], bool)
                i, j = i[kept], j[kept]
            if len(i):
                mine, theirs = pa.array(i + s), pa.array(j + low)
                found = [a[c].combine_chunks().take(mine) for c in [*within, *left]] + [b[c].combine_chunks().take(theirs) for c in right]
                yield pa.RecordBatch.from_arrays([*found, pa.array(overlap[i, j].astype(np.int32))], [*within, *left, *right, "overlap"])

    return run


def overlapping(left: DataFrame, right: DataFrame, minimum: float = 0.9, within: list[str] | None = None, ordered: bool = False, matched: bool = False) -> DataFrame:
    """(within, l, ..., r, ..., overlap) for the titles t of left (within, l, t, ...) and of right (within, r, t, ...), l and r being numbers, each once in its table, whose
    characters' overlap allows a ratio of `minimum`; further columns stay beside their numbers. ordered: only pairs of l < r, for a table that meets itself. matched: only such
    whose longest common subsequence allows it as well. Empty titles and nulls pair with nothing. Both tables are read several times."""
    if not 0 < minimum <= 1:
        raise ValueError("minimum must be above 0 and at most 1")
    within = within or []
    shortest = minimum / (2 - minimum)
    beside = 1 if shortest < 1 else 0  # equal lengths alone
    band = F.floor(F.log("__size") / (-math.log(shortest) * (1 + 1e-9))) if beside else F.col("__size").cast("long")

    def sized(df: DataFrame) -> DataFrame:
        return df.where(" and ".join(["t <> ''", *[f"`{w}` is not null" for w in within]])).withColumn("__size", F.length("t")).withColumn("__band", band)

    def cells(df: DataFrame, name: str, at: str) -> DataFrame:
        return df.groupBy(*within, F.col("__band").alias(at)).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))

    a, b = sized(left), sized(right)
    near = F.explode(F.sequence(F.col("__band") - beside, F.col("__band") + beside))

    def blocks(df: DataFrame, number: str, own: tuple[str, str], other: tuple[str, str], others: DataFrame, is_left: bool) -> DataFrame:
        """One row for each block of the other table that a title meets."""
        counted = df.withColumn("__counts", _counts("t"))
        work = (counted if matched else counted.drop("t")).join(cells(df, "__n", "__band"), [*within, "__band"])
        work = work.withColumns({own[0]: F.col("__band"), own[1]: F.pmod(F.xxhash64(number), F.col("__n")).cast("int"), other[0]: near})
        met = work.join(cells(others, "__blocks", other[0]), [*within, other[0]]).withColumn(other[1], F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
        return met.drop("__n", "__blocks", "__band").withColumn("__left", F.lit(is_left))

    at_l, at_r = ("__lband", "__lblock"), ("__rband", "__rblock")
    key = [*within, *at_l, *at_r]
    met = blocks(a, "l", at_l, at_r, b, True).unionByName(blocks(b, "r", at_r, at_l, a, False), allowMissingColumns=True)
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few rows, but each with much to work out
    mine, theirs = ([c for c in df.columns if c not in (*within, "t")] for df in (left, right))
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for df, names in ((left, [*within, *mine]), (right, theirs)) for f in (df.schema[n] for n in names)], "overlap int"])
    return met.repartition(parts, *key).groupBy(*key).applyInArrow(_overlaps(minimum, within, mine, theirs, ordered, matched), schema)


def bounded_pairs(left: DataFrame, right: DataFrame, minimum: float = 0.9, within: list[str] | None = None, matched: bool = False) -> DataFrame:
    """(within, l, r, overlap) for the titles l of left (within, l) and r of right (within, r), each once in its table, whose characters' overlap allows a ratio of `minimum`,
    matched: and whose longest common subsequence does. Empty titles and nulls pair with nothing."""
    within = within or []
    left, right = (materialized(df.where(f"{n} <> ''").withColumn(f"__{n}", F.monotonically_increasing_id())) for df, n in ((left, "l"), (right, "r")))
    asked = lambda df, n: df.select(*within, F.col(f"__{n}").alias(n), F.col(n).alias("t"))
    met = overlapping(asked(left, "l"), asked(right, "r"), minimum, within, matched=matched).withColumnsRenamed({"l": "__l", "r": "__r"})
    return met.join(left.select("__l", "l"), "__l").join(right.select("__r", "r"), "__r").select(*within, "l", "r", "overlap")


def best_titles(asks: DataFrame, known: DataFrame, minimum: float = 0.9, within: list[str] | None = None) -> DataFrame:
    """(within, t, best, n, key) for the titles t of asks (within, t) that some of known (within, t, key) reaches `minimum` with: the best ratio, how many known rows have
    it, and the smallest key among them. Equal titles are compared once, each two titles by one evaluation of the matcher."""
    within = within or []
    right = known.groupBy(*within, F.col("t").alias("r")).agg(F.count("*").alias("n"), F.min("key").alias("key"))
    pairs = bounded_pairs(asks.select(*within, F.col("t").alias("l")).distinct(), right.select(*within, "r"), minimum, within, matched=True)
    scored = pairs.withColumn("s", title_ratio("l", "r")).where(F.col("s") >= minimum)
    counted = scored.join(right, [*within, "r"]).groupBy(*within, "l", "s").agg(F.sum("n").alias("n"), F.min("key").alias("key"))
    return counted.groupBy(*within, F.col("l").alias("t")).agg(F.max(F.struct("s", "n", "key")).alias("x")).select(*within, "t", F.col("x.s").alias("best"), "x.n", "x.key")
