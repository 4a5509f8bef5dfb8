"""Benchmark decontamination by greedy string tiling with running Karp-Rabin matching.

Words (`[0-9a-z\x80-]+` of the lower-cased text) of a document and of a benchmark item that share a seed, MIN_MATCH
consecutive words, are tiled: search for the longest common runs of unmarked words, beginning at INITIAL words by rolling
window hashes and going on with the found length where it is more than twice as long; mark the longest ones that don't overlap; halve the length; stop at
MIN_MATCH. The tiles' share of the item's words is its coverage. As tiles may come in any order and place, reordered and
interleaved passages count in full. A document is contaminated by the items with a coverage of at least COVERAGE.

Items go to the executors in blocks of about BLOCK_WORDS words whatever the benchmark's size, one pass over the documents for each block;
a usual benchmark is one block. Of several, each block's matches are written before the next block is sent, so that the driver never holds more than one. Seeds are joined inside the scan, so documents without one are never shuffled.

Defined results: null and empty texts, and those of fewer than MIN_MATCH words, match nothing; so do items of fewer than
MIN_MATCH words. Items with the same text are all reported. Repeated rows of a key give one row with the largest coverage.
Only keys and texts are read. Rows with a null document key are looked at and reported as such; items with a null key are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.common import PUNCT, doc_words, shingle_hashes, slices, table, written

MIN_MATCH, INITIAL, COVERAGE, BLOCK_WORDS = 5, 20, 0.6, 1_000_000


def _free(marked: np.ndarray, s: int) -> np.ndarray:
    """True where s words from here are unmarked."""
    total = np.concatenate([[0], np.cumsum(marked)])
    return total[s:] == total[:-s]


def tiles(item: np.ndarray, doc: np.ndarray, min_match: int = MIN_MATCH, initial: int = INITIAL) -> list[tuple[int, int, int]]:
    """(item start, document start, length) of the tiles; item and doc are word hashes."""
    in_item, in_doc = np.zeros(len(item), bool), np.zeros(len(doc), bool)
    out, s = [], max(min_match, initial)
    while True:
        found: list[tuple[int, int, int]] = []
        longest = 0
        if s <= min(len(item), len(doc)):
            hi, hd = shingle_hashes(item, s), shingle_hashes(doc, s)
            i_at = np.flatnonzero(_free(in_item, s))
            d_at = np.flatnonzero(_free(in_doc, s))
            d_at = d_at[np.isin(hd[d_at], hi[i_at])]
            by_hash: dict[int, list[int]] = {}
            for i in i_at.tolist():
                by_hash.setdefault(int(hi[i]), []).append(i)
            reached: dict[int, int] = {}
            for j in d_at.tolist():
                for i in by_hash[int(hd[j])]:
                    if reached.get(j - i, -1) > j:
                        continue  # within a match that is already found on this diagonal
                    most = min(len(item) - i, len(doc) - j)
                    stop = (item[i : i + most] != doc[j : j + most]) | in_item[i : i + most] | in_doc[j : j + most]
                    k = int(stop.argmax()) if stop.any() else most
                    if k >= s:
                        reached[j - i] = j + k
                        longest = max(longest, k)
                        found.append((k, i, j))
        if longest > 2 * s:
            s = longest
            continue
        added = 0
        for k, i, j in sorted(found, key=lambda x: (-x[0], x[1], x[2])):
            if not (in_item[i : i + k].any() or in_doc[j : j + k].any()):
                in_item[i : i + k] = in_doc[j : j + k] = True
                out.append((i, j, k))
                added += 1
        if added < len(found) and added:
            continue  # what is left of the occluded matches may still be long enough
        if s <= min_match:
            return out
        s = max(min_match, s // 2)


class Items:
    """One block of benchmark items and its seeds."""

    def __init__(self, ids: list[int], words: list[np.ndarray], min_match: int) -> None:
        self.ids, self.words = ids, words
        seeds = [shingle_hashes(w, min_match) for w in words]
        owner = np.repeat(np.arange(len(ids)), [len(x) for x in seeds])
        flat = np.concatenate(seeds) if seeds else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.seeds, self.owner = flat[order], owner[order]

    def sharing(self, grams: np.ndarray) -> list[int]:
        """The items that have one of the seeds."""
        if not len(self.seeds) or not len(grams):
            return []
        at = np.minimum(np.searchsorted(self.seeds, grams), len(self.seeds) - 1)
        hit = np.unique(grams[self.seeds[at] == grams])
        low, high = np.searchsorted(self.seeds, hit), np.searchsorted(self.seeds, hit, side="right")
        return sorted({int(x) for s, e in zip(low, high, strict=True) for x in self.owner[s:e]})


def _items(benchmark: DataFrame, key: str, text: str, min_match: int) -> Items:
    rows = benchmark.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).where("k is not null").orderBy("k").toArrow()
    ids, words = [], []
    for b in slices(rows.to_batches(), "t"):
        _, _, _, hashed, first = doc_words(b, PUNCT, "t")
        for k, s, e in zip(b.column("k").to_pylist(), first[:-1], first[1:], strict=True):
            if e - s >= min_match:
                ids.append(k)
                words.append(hashed[s:e])
    return Items(ids, words, min_match)


def matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", min_match: int = MIN_MATCH, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(key, item, coverage, tiles) for each document and item that share a seed; tiles: array of (item_start, doc_start, length) in words."""
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, item long, coverage double, tiles array<struct<item_start:int,doc_start:int,length:int>>"
    chars = benchmark.agg(F.sum(F.length(item_text))).first()[0] or 0
    blocks = max(1, -(-chars // (6 * block_words)))
    shape = pa.list_(pa.struct([("item_start", pa.int32()), ("doc_start", pa.int32()), ("length", pa.int32())]))

    def scan(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items: Items = shared.value
            for b in slices(batches, "t"):
                _, _, _, words, first = doc_words(b, PUNCT, "t")
                grams = shingle_hashes(words, min_match)
                if not len(grams) or not len(items.seeds):
                    continue
                at = np.minimum(np.searchsorted(items.seeds, grams), len(items.seeds) - 1)
                hits = np.flatnonzero(items.seeds[at] == grams)
                row, item, coverage, where = [], [], [], []
                for x in np.unique(np.searchsorted(first, hits, side="right") - 1).tolist():
                    own = words[first[x] : first[x + 1]]
                    for i in items.sharing(shingle_hashes(own, min_match)):
                        found = tiles(items.words[i], own, min_match)
                        row.append(x)
                        item.append(items.ids[i])
                        coverage.append(sum(k for _, _, k in found) / len(items.words[i]))
                        where.append([{"item_start": p, "doc_start": q, "length": k} for p, q, k in sorted(found)])
                if row:
                    yield pa.RecordBatch.from_pydict({key: b.column("k").take(pa.array(row)), "item": pa.array(item, pa.int64()), "coverage": pa.array(coverage), "tiles": pa.array(where, shape)})

        return run

    out = None
    source = docs.select(docs[key].alias("k"), docs[text].alias("t"))
    for block in range(blocks):
        part = benchmark if blocks == 1 else benchmark.where(F.pmod(F.xxhash64(item_key), F.lit(blocks)) == block)
        shared = docs.sparkSession.sparkContext.broadcast(_items(part, item_key, item_text, min_match))  # about block_words words
        found = source.mapInArrow(scan(shared), schema)
        if blocks > 1:
            found = written(found, "matches")
            shared.destroy()
        out = found if out is None else out.unionByName(found)
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, key: str = "doc_id", **names) -> DataFrame:
    """One row for each contaminated document: key, n_items, item_ids (sorted array), coverage (the largest)."""
    hits = matches(docs, benchmark, key=key, **names).where(F.col("coverage") >= coverage)
    return hits.groupBy(key).agg(F.array_sort(F.collect_set("item")).alias("item_ids"), F.max("coverage").alias("coverage")).select(key, F.size("item_ids").cast("long").alias("n_items"), "item_ids", "coverage")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
