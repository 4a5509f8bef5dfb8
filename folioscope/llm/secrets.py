"""Secret scan: pattern rules, and a token-efficiency test for random strings.

A random string takes more tokens for its length than prose does: under a byte-level BPE vocabulary it gets few characters
to a token. Candidate runs are `[A-Za-z0-9+/_=-]{20,}` (wide enough for keys in hex, base64 or URL-safe form), of letters or
digits alone too. Excluded before the test are known digests and identifiers: whole-run hex of 32, 40, 56, 64, 96 or 128
digits (MD5, SHA-1, SHA-2), UUIDs, and runs that are nothing but words (letters that are one token or have more than
MAX_CHARS_PER_TOKEN characters a token by themselves) and numbers of fewer than 20 digits, split at signs; where there are signs, also between
letters and digits, so that timestamps and names with versions are no secrets; hex parts of 20 digits or more with letters and digits stay whole, and only those of a
digest's length are excluded. Digits alone have three characters to a token under most vocabularies and are then not found.
A candidate of at most MAX_CHARS_PER_TOKEN characters a token is reported as kind `random`; what the
pattern rules find is reported as `assign`, `access` and `hex` in any case.

Defined results: a null or empty text has no spans: zero counts, empty `spans`, and `base_sha256` of the empty string.
Spans are in code points, end exclusive. Repeated rows each give their row. Only the key and the text are read.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.common import slices, table

KINDS = ("assign", "access", "hex", "random")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # runs are taken whole, so this is [0-9a-f]+ of 32 or more
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})", re.I)
HEX_PART = re.compile(r"(?=[0-9]*[a-f])(?=[a-f]*[0-9])[0-9a-f]{20,}", re.I)
UUID = re.compile(r"[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}", re.I)
MAX_CHARS_PER_TOKEN = 2.2


@lru_cache(maxsize=2)
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def excluded(run: str, count_tokens, threshold: float = MAX_CHARS_PER_TOKEN) -> bool:
    """Known digests, identifiers and joined words."""
    if DIGEST.fullmatch(run) or UUID.fullmatch(run):
        return True
    parts = re.split(r"[_/+=-]", run)
    if len(parts) > 1:  # timestamps and names with versions: letters and digits apart
        if any(HEX_PART.fullmatch(p) and not DIGEST.fullmatch(p) for p in parts):
            return False
        parts = [p for part in parts if not DIGEST.fullmatch(part) for p in re.findall(r"[A-Za-z]+|[0-9]+", part)]
    return all(not part or part.isdigit() and len(part) < 20 or part.isalpha() and ((n := count_tokens(part)) == 1 or len(part) > threshold * n) for part in parts)


def find(text: str, count_tokens, threshold: float = MAX_CHARS_PER_TOKEN) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of all spans, in order."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    for m in CANDIDATE.finditer(text):
        run = m.group()
        if len(run) <= threshold * count_tokens(run) and not excluded(run, count_tokens, threshold):
            out.append((m.start(), 3, m.end()))
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    out.sort()
    return out


def secret_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = MAX_CHARS_PER_TOKEN, vocabulary: str | None = None) -> DataFrame:
    """One row for each of docs: key and `spans`, an array of (kind, start, end) by start, then kind as in KINDS."""
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, spans array<struct<kind:string,start:long,end:long>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers as public

        encoding = _encoding(vocabulary or public.path("byte_bpe_50k.tiktoken"), public.PATTERN)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for b in slices(batches, "t"):
            rows = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in find(t, lambda x: len(encoding.encode_ordinary(x)), threshold)] if t else [] for t in b.column("t").to_pylist()]
            yield pa.RecordBatch.from_pydict({key: b.column("k"), "spans": pa.array(rows, kind)})

    return docs.select(docs[key].alias("k"), docs[text].alias("t")).mapInArrow(run, schema)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(table(spark, sf_dir, "documents"))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def count(kind: str):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")

    base = F.filter("spans", lambda x: x["kind"] != "random")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        count("random").alias("n_random"),
    )
