"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The merges of one pre-token are taken from buckets, one for each merge rank, that hold positions in a linked list of
symbols. A bitmap of three levels (64 children to a word) says which buckets have entries; find-first-set on each level
gives the lowest rank. Entries whose pair has changed meanwhile are stale and skipped. Each step costs the same however
long the pre-token is, so a pre-token of n bytes takes O(n log n) instead of O(n^2).

Defined results: a null or empty text has no tokens, an empty id list and the digest of nothing; repeated rows each give
their row; other columns, whatever their names, don't matter, as only the key and the text are read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from folioscope.llm.common import slices, table

VOCABULARY = "byte_bpe_50k.tiktoken"
#: public_tokenizers.PATTERN, and the same for texts without the characters of BEYOND_PLAIN, in the standard library's classes.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PLAIN_PATTERN = r" ?[^\W\d_]+|'(?:[stmd]|re|ve|ll)| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
BEYOND_PLAIN = "[^\t\n\r -~\u00a1-\u00b1\u00b4-\u00b8\u00ba\u00bb\u00bf-\u024f]"
#: Pre-tokens whose ids a task keeps; when full, it starts anew. Bounds memory only.
CACHE = 300_000


class RankQueue:
    """Buckets of positions by rank under a bitmap of three levels with 64 children each; the lowest rank comes first."""

    __slots__ = ("buckets", "l0", "l1", "l2")

    def __init__(self) -> None:
        self.buckets: dict[int, list[int]] = {}
        self.l0: dict[int, int] = {}
        self.l1: dict[int, int] = {}
        self.l2 = 0

    def add(self, rank: int, positions: list[int]) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket += positions
            return
        self.buckets[rank] = positions
        a, b = rank >> 6, rank >> 12
        self.l0[a] = self.l0.get(a, 0) | 1 << (rank & 63)
        self.l1[b] = self.l1.get(b, 0) | 1 << (a & 63)
        self.l2 |= 1 << b

    def pop(self) -> tuple[int, list[int]]:
        """The lowest rank with its positions, taken out; -1 when nothing is left."""
        if not self.l2:
            return -1, []
        b = (self.l2 & -self.l2).bit_length() - 1
        x = self.l1[b]
        a = b << 6 | (x & -x).bit_length() - 1
        y = self.l0[a]
        rank = a << 6 | (y & -y).bit_length() - 1
        self.l0[a] = y = y & y - 1
        if not y:
            self.l1[b] = x = x & x - 1
            if not x:
                self.l2 &= self.l2 - 1
        return rank, self.buckets.pop(rank)


class Coder:
    """Encodes as the ranks say, each match of the pattern separately, and decodes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import re

        import regex

        self.ranks = ranks
        self.words = {str(v): k for k, v in ranks.items()}
        self.find_any = regex.compile(pattern).findall
        #: Over these characters alone the standard library's classes agree with the pattern's, and it is faster.
        self.find_plain = re.compile(PLAIN_PATTERN).findall if pattern == PATTERN else None
        self.beyond_plain = re.compile(BEYOND_PLAIN).search
        self.cache: dict[str, str] = {}
        self.symbol = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.keys = np.array(sorted(pairs), np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], np.int64)

    def find(self, text: str) -> list[str]:
        return self.find_any(text) if self.find_plain is None or self.beyond_plain(text) else self.find_plain(text)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each concatenation, -1 where it is none or either is no symbol."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.values[at], -1)

    def merge(self, pieces: list[bytes], singly: bool = False) -> list[list[int]]:
        """The ids of each pre-token. All are merged by one queue: a bar before and after each takes part in no pair, so
        each one's merges come in its own order, lowest rank and then leftmost first. The positions of a bucket go together,
        as in a trained vocabulary no merge makes a pair of a lower rank; should one do so, all goes again position by position."""
        if not pieces:
            return []
        raw = np.frombuffer(b"\0" + b"\0".join(pieces) + b"\0", np.uint8)
        bars = np.append(0, np.cumsum([len(p) + 1 for p in pieces]))
        sym = self.symbol[raw]
        sym[bars] = -2
        n = len(raw)
        rank_at = np.full(n, -1, np.int64)  # of the pair that begins at each live symbol
        rank_at[:-1] = self.pair_ranks(sym[:-1], sym[1:])
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        at = np.flatnonzero(rank_at >= 0)
        at = at[np.argsort(rank_at[at], kind="stable")]
        queue = RankQueue()
        if len(at):
            for part in np.split(at, np.flatnonzero(np.diff(rank_at[at])) + 1):
                queue.add(int(rank_at[part[0]]), part.tolist())
        add, buckets = queue.add, queue.buckets
        while True:
            rank, bucket = queue.pop()
            if rank < 0:
                break
            i = np.unique(np.array(bucket))
            i = i[rank_at[i] == rank]  # the others are stale: their pair has changed
            if not len(i):
                continue
            j = after[i]
            if len(i) > 1 and (joined := j[:-1] == i[1:]).any():  # as in aaa: the left one goes first, and the next is stale
                x = np.arange(len(i))
                start = np.maximum.accumulate(np.where(np.append(True, ~joined), x, 0))
                even = (x - start) % 2 == 0
                i, j = i[even], j[even]
            if singly and len(i) > 1:
                add(rank, i[1:].tolist())
                i, j = i[:1], j[:1]
            sym[i], sym[j], rank_at[j] = rank, -1, -1
            k = after[j]
            after[i] = k
            before[k] = i
            changed = np.concatenate([i, before[i]])
            new = self.pair_ranks(sym[changed], sym[after[changed]])
            rank_at[changed] = new
            ok = new >= 0
            if len(i) > 1 and (new[ok] < rank).any():
                return self.merge(pieces, singly=True)
            for r, x in zip(new[ok].tolist(), changed[ok].tolist(), strict=True):
                if r in buckets:
                    buckets[r].append(x)
                else:
                    add(r, [x])
        kept = sym[sym != -1]
        cuts = np.flatnonzero(kept == -2)
        ids = kept.tolist()
        return [ids[s + 1 : e] for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    def encode(self, texts: list[str]) -> list[str]:
        """The ids of each text, joined by spaces."""
        found = [self.find(t) for t in texts]
        if len(self.cache) > CACHE:
            self.cache.clear()
        cache = self.cache
        new = list({p for pieces in found for p in pieces if p not in cache})
        coded = [p.encode() for p in new]
        whole = [self.ranks.get(p) for p in coded]
        merged = iter(self.merge([p for p, r in zip(coded, whole, strict=True) if r is None]))
        known = {p: str(r) if r is not None else " ".join(map(str, next(merged))) for p, r in zip(new, whole, strict=True)}
        cache.update(known)
        out = [" ".join(map(cache.__getitem__, pieces)) for pieces in found]
        for p in new:
            if len(p) > 64:
                del cache[p]
        return out

    def decode(self, ids: list[str]) -> bytes:
        return b"".join(map(self.words.__getitem__, ids))


@lru_cache(maxsize=2)
def coder(path: str, pattern: str) -> Coder:
    with open(path, "rb") as f:  # a vocabulary file that every executor has installed, not a table
        return Coder({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)


def bpe(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row for each of docs: key, n_tokens, ids_sha256, decoded_sha256 and decoded_ok (the round trip gives the text's
    bytes); with_ids adds the ids themselves as an array."""
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string, decoded_ok boolean" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers as public

        code = coder(vocabulary or public.path(VOCABULARY), public.PATTERN)
        for b in slices(batches, "t"):
            n, ids_sha, out_sha, ok, all_ids = [], [], [], [], []
            texts = [t or "" for t in b.column("t").to_pylist()]
            for t, joined in zip(texts, code.encode(texts), strict=True):
                ids = joined.split(" ") if joined else []
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(joined.encode()).hexdigest())
                decoded = code.decode(ids)
                out_sha.append(hashlib.sha256(decoded).hexdigest())
                ok.append(decoded == t.encode())
                if with_ids:
                    all_ids.append(list(map(int, ids)))
            columns = {key: b.column("k"), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(out_sha, pa.string()), "decoded_ok": pa.array(ok, pa.bool_())}
            if with_ids:
                columns["ids"] = pa.array(all_ids, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(columns)

    return docs.select(docs[key].alias("k"), docs[text].alias("t")).mapInArrow(run, schema)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe(table(spark, sf_dir, "documents")).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
