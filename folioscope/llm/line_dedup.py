"""Line dedup over hashes of line windows.

A document is the sequence of its lines' hashes (split at newlines; surrounding spaces don't count; blank lines are left out
and never removed by themselves). Every window of RUN consecutive lines is a fingerprint, keyed by its hash, so that a very common line
alone joins nothing. None is left out by winnowing: with windows of two lines selecting saves little, and each repeated window must be found. Each key's first
position (lowest document, then line) is found by a min that combines before the shuffle and joined with all its other positions; a match is then
extended both ways over whatever windows follow on the same diagonal, and the later repeated run goes. As every
repeated window has a key of its own, the lines that go are exactly those in some run of RUN lines that has occurred
before (in an earlier document, or earlier in the same one without overlapping it at the same place).

A run also counts by its words: with `words`, a single line of that many words or more is a fingerprint of its own besides the windows. That holds for
`dedup_lines`, the pipeline's stage; `repeated_runs` and op6_line_dedup, whose SQL knows windows only, leave such lines out unless asked.

Defined results: null and empty texts stay as they are. A document all whose lines go is dropped where `dedup_lines` is
asked for text; `repeated_runs` lists its runs all the same. Copies of a document of fewer than RUN lines stay where no line has `words` words. Rows of
a repeated key are told apart by a hash of the text; rows with the same key and text count as one document and are treated alike. A null key sorts
first. Extra columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.common import mix, slices, table

RUN, WORDS = 2, 50


def line_hashes(text: str | None) -> tuple[list[int], np.ndarray]:
    """Numbers of the lines that aren't blank, and their hashes."""
    import xxhash

    at, hashes = [], []
    for i, line in enumerate((text or "").split("\n")):
        line = line.strip(" \t\r")
        if line:
            at.append(i)
            hashes.append(xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass")))
    return at, np.array(hashes, np.uint64)


def fingerprints(hashes: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray]:
    """Window starts and their keys."""
    n = len(hashes) - run + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    windows = np.lib.stride_tricks.sliding_window_view(hashes, run)
    chosen = run - 1 - windows[:, ::-1].argmin(1)
    whole = np.zeros(n, np.uint64)
    for j in range(run):
        whole = mix(whole * np.uint64(0x9E3779B97F4A7C15) + windows[:, j])
    return np.arange(n), mix(whole + chosen.astype(np.uint64))


def long_lines(text: str | None, words: int) -> np.ndarray:
    """Numbers, among the lines that aren't blank, of those of at least `words` words."""
    at, _ = line_hashes(text)
    lines = (text or "").split("\n")
    return np.array([i for i, x in enumerate(at) if len(lines[x]) >= 2 * words - 1 and len(lines[x].split()) >= words], np.int64)


def _identity(key: str, text: str):
    """What tells documents apart, in their order: the key, then a hash of the text."""
    return F.struct(F.col(key).alias("k"), F.xxhash64(F.col(text)).alias("h"))


def window_keys(docs: DataFrame, run: int, where: str, words: int | None = None) -> DataFrame:
    """(key, doc, start, lines) of all windows, and of single lines of at least `words` words; docs has doc and t."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "t"):
            counts, starts, keys, lines = [], [], [], []
            for t in b.column("t").to_pylist():
                h = line_hashes(t)[1]
                s, k = fingerprints(h, run)
                one = long_lines(t, words) if words is not None and run > 1 else np.zeros(0, np.int64)
                counts.append(len(s) + len(one))
                starts += [s, one]
                keys += [k, mix(h[one] + np.uint64(0x9E3779B97F4A7C15))]
                lines += [np.full(len(s), run), np.ones(len(one), np.int64)]
            at = np.repeat(np.arange(b.num_rows), counts)
            yield pa.RecordBatch.from_pydict({"key": pa.array(np.concatenate(keys).view(np.int64)), "doc": b.column("doc").take(pa.array(at)), "start": pa.array(np.concatenate(starts), pa.int32()), "lines": pa.array(np.concatenate(lines), pa.int32())})

    return docs.mapInArrow(find, f"key long, doc {where}, start int, lines int")


def repeated_windows(docs: DataFrame, run: int = RUN, key: str = "doc_id", text: str = "text", words: int | None = None) -> DataFrame:
    """(doc, start, lines, first_doc, first_start): each window that occurred before, with its first position; doc is struct(k, h)."""
    kind = f"struct<k:{docs.schema[key].dataType.simpleString()},h:bigint>"
    keys = window_keys(docs.select(_identity(key, text).alias("doc"), F.col(text).alias("t")), run, kind, words)
    first = keys.groupBy("key").agg(F.min(F.struct("doc", "start")).alias("f"), F.count("*").alias("n")).where("n > 1").select("key", "f")
    return keys.join(first, "key").where("struct(doc, start) != f").select("doc", "start", "lines", F.col("f.doc").alias("first_doc"), F.col("f.start").alias("first_start"))


def repeated_runs(docs: DataFrame, run: int = RUN, key: str = "doc_id", text: str = "text", words: int | None = None) -> DataFrame:
    """One row for each document with later repeats: key, text_hash and `runs`, an array of (start, lines, first_doc, first_start) over its
    lines that aren't blank: seeds on one diagonal that touch, extended both ways to one run."""
    kind = docs.schema[key].dataType.simpleString()
    seeds = repeated_windows(docs, run, key, text, words)
    by_doc = seeds.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("start", "first_doc", "first_start", "lines"))).alias("seeds"))  # at most a document's own lines

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shape = pa.list_(pa.struct([("start", pa.int32()), ("lines", pa.int32()), ("first_doc", b.column("k").type), ("first_start", pa.int32())]))
            rows = []
            for found in b.column("seeds").to_pylist():
                runs: list[dict] = []
                open_runs: dict = {}
                for x in found:
                    diagonal = (x["first_doc"]["k"], x["first_doc"]["h"], x["first_start"] - x["start"])
                    last = open_runs.get(diagonal)
                    if last is not None and x["start"] <= last["start"] + last["lines"]:
                        last["lines"] = max(last["lines"], x["start"] + x["lines"] - last["start"])
                    else:
                        open_runs[diagonal] = last = {"start": x["start"], "lines": x["lines"], "first_doc": x["first_doc"]["k"], "first_start": x["first_start"]}
                        runs.append(last)
                rows.append(runs)
            yield pa.RecordBatch.from_pydict({key: b.column("k"), "text_hash": b.column("h"), "runs": pa.array(rows, shape)})

    return by_doc.select("doc.k", "doc.h", "seeds").mapInArrow(extend, f"`{key}` {kind}, text_hash long, runs array<struct<start:int,lines:int,first_doc:{kind},first_start:int>>")


def dedup_lines(docs: DataFrame, run: int = RUN, key: str = "doc_id", text: str = "text", words: int | None = WORDS) -> DataFrame:
    """docs without the lines of later repeated runs, all columns kept (`n_chars` counted anew where there is one);
    documents of which nothing but blank lines is left go."""
    runs = repeated_runs(docs, run, key, text, words).toDF("__key", "__hash", "__runs")
    joined = docs.join(runs, F.col(key).eqNullSafe(F.col("__key")) & (F.xxhash64(F.col(text)) == F.col("__hash")), "left").drop("__key", "__hash")
    order = docs.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, keep, counted = [], [], []
            for t, found in zip(b.column(text).to_pylist(), b.column("__runs").to_pylist(), strict=True):
                if found:
                    lines = t.split("\n")
                    at, _ = line_hashes(t)
                    gone = {at[i] for r in found for i in range(r["start"], min(r["start"] + r["lines"], len(at)))}
                    left = [x for i, x in enumerate(lines) if i not in gone]
                    t = "\n".join(left)
                    keep.append(any(x.strip(" \t\r") for x in left))
                else:
                    keep.append(True)
                texts.append(t)
                counted.append(len(t) if t is not None else None)
            columns = {c: b.column(c) for c in order}
            columns[text] = pa.array(texts, pa.string())
            if "n_chars" in columns:
                changed = pa.array([bool(x) for x in b.column("__runs").to_pylist()])
                columns["n_chars"] = pa.compute.if_else(changed, pa.array(counted, columns["n_chars"].type), columns["n_chars"])
            yield pa.RecordBatch.from_pydict(columns).filter(pa.array(keep, pa.bool_()))

    return joined.mapInArrow(cut, kinds)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with later repeats: how many of their lines go and in how many runs."""
    runs = repeated_runs(table(spark, sf_dir, "documents"))
    lines = F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(r["start"], r["start"] + r["lines"] - 1))))
    return runs.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.size(lines).cast("long").alias("n_lines"), F.array_min("runs.first_doc").alias("first_doc"))


#: n_runs counts what extends on one diagonal; n_lines and first_doc follow from the windows alone.
OP6_SQL = r"""
WITH split AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS raw, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents
), lines AS (
  SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS p
  FROM (SELECT doc_id, i, trim(raw, ' ' || chr(9) || chr(13)) AS line FROM split) WHERE line <> ''
), pairs AS (
  SELECT doc_id, p, line, lead(line) OVER (PARTITION BY doc_id ORDER BY p) AS following FROM lines
), ranked AS (
  SELECT doc_id, p, first_value(doc_id) OVER w AS first_doc, first_value(p) OVER w AS first_p
  FROM pairs WHERE following IS NOT NULL WINDOW w AS (PARTITION BY line, following ORDER BY doc_id, p)
), later AS (
  SELECT *, CASE WHEN lag(p) OVER (PARTITION BY doc_id, first_doc, first_p - p ORDER BY p) >= p - 2 THEN 0 ELSE 1 END AS opens
  FROM ranked WHERE doc_id <> first_doc OR p <> first_p
), gone AS (
  SELECT DISTINCT doc_id, q FROM (SELECT doc_id, unnest([p, p + 1]) AS q FROM later)
), counted AS (SELECT doc_id, count(*) AS n_lines FROM gone GROUP BY doc_id)
SELECT l.doc_id, CAST(sum(opens) AS BIGINT) AS n_runs, max(n_lines) AS n_lines, min(first_doc) AS first_doc
FROM later l JOIN counted USING (doc_id) GROUP BY l.doc_id
"""
