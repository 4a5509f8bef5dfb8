"""Helpers shared by the operators: reading tables, bounded slices of Arrow batches, vectorised word hashes."""

from __future__ import annotations

import gc
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from folioscope.checkpoints import checkpoint_dir, materialized

#: Bytes of text that one vectorised step handles at once; one text may be longer.
SLICE_BYTES = 1 << 21

#: Byte classes of the word rules. SPACE: words are `[^\x20\x09-\x0D]+`. PUNCT: words are `[0-9a-z\x80-]+` after lower-casing.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
PUNCT = np.ones(256, bool)
PUNCT[0x30:0x3A] = PUNCT[0x41:0x5B] = PUNCT[0x61:0x7B] = PUNCT[0x80:] = False

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def bounded_batches(spark: SparkSession) -> None:
    """Rows of an Arrow batch, unless the session says otherwise: a batch holds whole texts, on both sides of the pipe to Python."""
    key, usual = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"
    if spark.conf.get(key, usual) == usual:
        spark.conf.set(key, "2000")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder, its lineage cut."""
    spark = df.sparkSession
    out = materialized(df)
    del df
    release(spark)
    return out


_released = [0.0]


def release(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of steps whose results have been written; else they stay until the driver's JVM collects garbage.
    At most every few seconds: steps that short leave little."""
    if time.monotonic() - _released[0] < 3:
        return
    for _ in range(2):  # what Python has let go reaches the JVM with the next call only
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.1)
    _released[0] = time.monotonic()


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(33)
    h *= _M1
    h ^= h >> np.uint64(33)
    h *= _M2
    h ^= h >> np.uint64(33)
    return h


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32  # A-Z count as a-z
_FIRST = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)  # the first bytes of eight


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of each batch, of at most `limit` bytes of text together or one row."""
    for b in batches:
        if not b.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield b.slice(at, to - at)
            at = to


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, null as empty, and where each row starts and the last ends."""
    column = pc.fill_null(column, "")
    _, offsets, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if offsets else np.zeros(len(column) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data else np.zeros(0, np.uint8)
    return raw, off - off[0]


def spans(raw: np.ndarray, off: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the first word of each row (one entry more than rows)."""
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(off), np.int64)
    word = ~separators[raw]
    joined = np.zeros(len(raw) + 1, bool)  # joined[i]: bytes i-1 and i are of one word
    joined[1:-1] = word[1:] & word[:-1]
    joined[off[off < len(raw)]] = False
    starts = np.flatnonzero(word & ~joined[:-1])
    ends = np.flatnonzero(word & ~joined[1:]) + 1
    return starts, ends, np.searchsorted(starts, off)


def hash_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words, A-Z counted as a-z; eight bytes of all words at a time."""
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[: len(raw)] = _LOWER[raw]
    eight = np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))
    left = ends - starts
    out = left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    live, at = np.arange(len(starts)), starts
    while len(live):
        h = out[live] ^ (eight[at] & _FIRST[np.minimum(left, 8)])
        h *= _M1
        out[live] = h ^ (h >> np.uint64(29))
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    return mix(out)


def shingle_hashes(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Hash of each k consecutive words, len(words) - k + 1 of them; over several rows: those across a border too."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h += words[j : j + n]
        h *= _M1
        h ^= h >> np.uint64(29)
    return mix(h)


def short_hash(words: np.ndarray) -> np.uint64:
    """Hash of a whole sequence of fewer words than a shingle has."""
    h = np.array([len(words) + 0x51], np.uint64)
    for w in words:
        h = (h + w) * _M2
        h ^= h >> np.uint64(29)
    return mix(h)[0]


def doc_words(b: pa.RecordBatch, separators: np.ndarray = SPACE, text: str = "text"):
    """raw bytes, word starts, word ends, word hashes, first word of each row."""
    raw, off = utf8(b.column(text))
    starts, ends, first = spans(raw, off, separators)
    return raw, starts, ends, hash_words(raw, starts, ends), first


def whole_runs(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """Rows sorted by keys, cut anew so that all rows of one key come together; only the last key's rows are held back."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        opens = np.zeros(b.num_rows, bool)
        for k in keys:
            column = b.column(k).to_numpy(zero_copy_only=False)
            opens[1:] |= column[1:] != column[:-1]
        if held and any(held[-1].column(k)[-1] != b.column(k)[0] for k in keys):
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        at = np.flatnonzero(opens)
        if len(at):
            yield pa.Table.from_batches([*held, b.slice(0, at[-1])]).combine_chunks()
            held = [b.slice(at[-1])]
        else:
            held.append(b)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def written(df: DataFrame, name: str) -> DataFrame:
    """df as Parquet in a folder of its own beside the checkpoints, read again."""
    import uuid

    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    schema = df.schema
    del df
    release(spark)
    out = spark.read.schema(schema).parquet(path)
    out._written_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that written() made, when nothing reads them any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._written_at)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def packed(x: np.ndarray) -> bytes:
    """Integers as bytes: their width, then each in the fewest of 2, 4 or 8 bytes that hold all."""
    most = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
    width = 2 if most < 1 << 15 else 4 if most < 1 << 31 else 8
    return bytes([width]) + np.ascontiguousarray(x, f"<i{width}").tobytes()


def unpacked(b: bytes) -> np.ndarray:
    return np.frombuffer(b, f"<i{b[0]}", offset=1).astype(np.int64)
