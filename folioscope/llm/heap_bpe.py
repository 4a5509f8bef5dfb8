"""BPE encoding and decoding with a priority queue of merge ranks over a doubly linked symbol list.

A text is cut at the tokenizer's added tokens, the rest into pre-tokens. The symbols of a pre-token stand in a list linked
both ways; a heap holds one entry, rank and place, for each pair that a merge knows. The lowest rank goes first, the
leftmost place among equals; a merge takes its right symbol out of the list and enters the two new pairs. An entry whose
pair has changed since is stale and skipped. A pre-token of n bytes takes O(n log n). Decoding concatenates the vocabulary's strings and turns their
characters into bytes; bytes that are no UTF-8 become U+FFFD.

Texts are independent of each other, so the work is one pass over the rows without a shuffle; a worker keeps the ids of at most 2 * CACHE pre-tokens.

Defined results: a null or empty text has no ids, and both digests are those of nothing; repeated rows each give their row; only key and text are read,
so other columns don't matter, whatever their names. Vocabularies that aren't byte-level BPE raise a ValueError. Null ids arrays decode to null, null or unknown ids in one raise a KeyError.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.byte_bpe import BEYOND_PLAIN, PLAIN_PATTERN
from folioscope.llm.common import slices, table

VOCABULARY = "byte_bpe_50k.json"
#: Letters and numbers that came after the Unicode version of the tokenizers library; there they are neither.
NEWER = (
    r"\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d"
    r"\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb"
    r"\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3"
    r"\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191"
    r"\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96"
    r"\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4"
    r"\U0001e6fe-\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
#: The split rule of byte-level BPE.
LETTER, NUMBER = rf"[\p{{L}}--[{NEWER}]]", rf"[\p{{N}}--[{NEWER}]]"
SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?{LETTER}+| ?{NUMBER}+| ?[^\s{LETTER}{NUMBER}]+|\s+(?!\S)|\s+"
#: Pre-tokens whose ids a worker keeps: CACHE recent ones and the CACHE before them. Longer ones than LONG bytes aren't kept. Both bound memory only.
CACHE, LONG = 400_000, 64


def byte_characters() -> dict[str, int]:
    """The character that stands for each byte in vocabulary strings: itself where it prints, else the next one from 256 on."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return {chr(b if b in prints else next(rest)): b for b in range(256)}


class HeapCoder:
    """Encodes and decodes by a vocabulary of strings with ids and a list of merges."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], added: dict[str, int]) -> None:
        import re

        import regex

        byte_of = byte_characters()
        strings = {i: bytes(byte_of[c] for c in s) if all(c in byte_of for c in s) else s.encode() for s, i in (vocabulary | added).items()}
        lengths = np.array([len(strings.get(i, b"")) for i in range(max(strings) + 1)], np.int64)
        self.known = np.array([i in strings for i in range(len(lengths))])
        self.blob, self.starts, self.lengths = np.frombuffer(b"".join(strings.get(i, b"") for i in range(len(lengths))), np.uint8), np.cumsum(lengths) - lengths, lengths
        self.symbol = [0] * 256
        for c, b in byte_of.items():
            self.symbol[b] = vocabulary[c]
        self.rank_of = {vocabulary[a] << 32 | vocabulary[b]: rank for rank, (a, b) in enumerate(merges)}
        self.made = [vocabulary[a + b] for a, b in merges]
        self.byte_ranks = [self.rank_of.get(a << 32 | b, -1) for a in self.symbol for b in self.symbol]
        self.added = {s: np.array([i], "<u4").tobytes() for s, i in added.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")").split if added else None
        self.find_any = regex.compile(SPLIT, regex.V1).findall
        #: Over texts without the characters of BEYOND_PLAIN the standard library's classes say the same, faster.
        self.find_plain, self.beyond_plain = re.compile(PLAIN_PATTERN).findall, re.compile(BEYOND_PLAIN).search
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one pre-token."""
        n, byte_ranks, find, made = len(piece), self.byte_ranks, self.rank_of.get, self.made
        symbols = list(map(self.symbol.__getitem__, piece))
        ranks = [byte_ranks[a << 8 | b] for a, b in zip(piece, piece[1:], strict=False)]  # of the pair that begins at each place
        bits = 14 if n < 1 << 14 else 40  # of an entry, for the place; the rank stands above
        heap = [r << bits | i for i, r in enumerate(ranks) if r >= 0]
        if not heap:
            return symbols
        heapify(heap)
        ranks.append(-1)
        after, before, mask = list(range(1, n + 1)), list(range(-1, n)), (1 << bits) - 1
        while heap:
            entry = heappop(heap)
            i, rank = entry & mask, entry >> bits
            if ranks[i] != rank:
                continue  # stale
            j = after[i]
            k = after[i] = after[j]
            before[k] = i
            symbols[i] = new = made[rank]
            symbols[j] = ranks[j] = ranks[i] = -1
            if k < n:
                ranks[i] = r = find(new << 32 | symbols[k], -1)
                if r >= 0:
                    heappush(heap, r << bits | i)
            h = before[i]
            if h >= 0:
                ranks[h] = r = find(symbols[h] << 32 | new, -1)
                if r >= 0:
                    heappush(heap, r << bits | h)
        return [s for s in symbols if s >= 0]

    def _ids(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            raw = piece.encode()
            ids = array("I", self.merge(raw)).tobytes()
            if len(raw) > LONG:
                return ids
        if len(self.recent) >= CACHE:
            self.older, self.recent = self.recent, {}
        self.recent[piece] = ids
        return ids

    def _plain(self, text: str) -> bytes:
        find = self.find_any if self.beyond_plain(text) else self.find_plain
        known = self.recent.get
        return b"".join([known(p) or self._ids(p) for p in find(text)])

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if self.cut is None:
            return self._plain(text)
        return b"".join([self.added[part] if at % 2 else self._plain(part) for at, part in enumerate(self.cut(text))])

    def decode(self, ids: np.ndarray) -> bytes:
        """The UTF-8 of the decoded text."""
        if not len(ids):
            return b""
        if int(ids.min()) < 0 or int(ids.max()) >= len(self.known) or not self.known[ids].all():
            raise KeyError("an id that the vocabulary doesn't have")
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        raw = self.blob[np.repeat(self.starts[ids] - ends + lengths, lengths) + np.arange(ends[-1])].tobytes()
        try:
            raw.decode()
        except UnicodeDecodeError:
            return raw.decode(errors="replace").encode()
        return raw


@lru_cache(maxsize=2)
def coder(path: str) -> HeapCoder:
    with open(path, encoding="utf-8") as f:  # a vocabulary file that every executor has installed, not a table
        t = json.load(f)
    model, split = t["model"], t.get("pre_tokenizer") or {}
    odd = [k for k in ("unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges") if model.get(k)]
    if model.get("type") != "BPE" or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or t.get("normalizer") or odd:
        raise ValueError(f"{path} is no byte-level BPE without normalizer")
    if any(a["normalized"] or a["single_word"] or a["lstrip"] or a["rstrip"] for a in t["added_tokens"]):
        raise ValueError(f"{path} has added tokens that depend on what stands beside them")
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    return HeapCoder(model["vocab"], merges, {a["content"]: a["id"] for a in t["added_tokens"]})


def _path(vocabulary: str | None) -> str:
    import public_tokenizers

    return vocabulary or public_tokenizers.path(VOCABULARY)


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row for each of docs: key, n_tokens, ids_sha256, decoded_sha256 and decoded_ok (decoding gives the text's bytes); with_ids adds the ids as an array."""
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string, decoded_ok boolean" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(_path(vocabulary))
        for b in slices(batches, "t"):
            n, ids_sha, out_sha, ok, all_ids = [], [], [], [], []
            for t in b.column("t").to_pylist():
                packed = code.encode(t or "")
                ids = np.frombuffer(packed, "<u4")
                decoded = code.decode(ids)
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(packed).hexdigest())
                out_sha.append(hashlib.sha256(decoded).hexdigest())
                ok.append(decoded == (t or "").encode())
                if with_ids:
                    all_ids.append(ids.astype(np.int32))
            columns = [b.column("k"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(out_sha, pa.string()), pa.array(ok, pa.bool_())]
            if with_ids:
                columns.append(pa.array(all_ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, [key, "n_tokens", "ids_sha256", "decoded_sha256", "decoded_ok", "ids"][: len(columns)])

    return docs.select(docs[key].alias("k"), docs[text].alias("t")).mapInArrow(run, schema)


def decode(tokens: DataFrame, key: str = "doc_id", ids: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """One row for each of tokens: key and the text that its ids stand for."""
    schema = f"`{key}` {tokens.schema[key].dataType.simpleString()}, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(_path(vocabulary))
        for b in batches:
            texts = [None if x is None else code.decode(np.array([-1 if i is None else i for i in x], np.int64)).decode() for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("k"), pa.array(texts, pa.string())], [key, "text"])

    return tokens.select(F.col(key).alias("k"), F.col(ids).cast("array<long>").alias("ids")).mapInArrow(run, schema)


def op12_heap_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents")).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
