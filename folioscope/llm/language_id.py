"""Language identification by error-correcting output codes.

Each learned language gets a codeword; for each bit a binary n-gram classifier tells the languages with a 1 from those with
a 0 by log-odds of hashed byte n-grams (1 to 3 bytes, A-Z as a-z) and gives a margin: the mean log-odds of the text's
n-grams over its standard deviation among languages. Decoding is loss-weighted: the language whose codeword has the lowest
sum of log(1 + exp(-margin * bit)), each bit weighted by how well its classifier separates the languages, wins; the second
best codeword close by flags ambiguity. Up to seven languages the code is exhaustive (2^(L-1) - 1 bits); beyond, it has
ceil(10 log2 L) bits drawn from a fixed seed.

The classifiers are linear in n-gram counts, so training is one aggregation over all training rows: BUCKETS counters for
each language, a table whose size depends on the number of languages alone.

Defined results: null texts and texts without a letter are `und` with score 0; so is all when there's nothing to learn
from. Ties between codewords go to the language that sorts first. Repeated rows each give their row and count each in
training. Only key, text and label are read.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.common import mix, slices, table, utf8

BUCKETS = 1 << 14
#: Added to each counter of a language with an average share of n-grams.
SMOOTHING = 0.5
#: Two codewords whose probabilities differ by less are ambiguous.
AMBIGUOUS = 0.2

_LETTER = re.compile(r"[^\W\d_]")
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[0x41:0x5B] += 32
_FOLD[[0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0x20
_FOLD[0x30:0x3A] = 0x30
_BIGRAM = (mix(np.arange(1 << 16, dtype=np.uint64)) % np.uint64(BUCKETS)).astype(np.uint16)


def ngrams(raw: np.ndarray, off: np.ndarray) -> Iterator[np.ndarray]:
    """The hashed n-grams of each text."""
    b = _FOLD[raw]
    two = b[:-1] << 8 | b[1:]
    three = ((two[:-1] << 8 | b[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(18)
    two = _BIGRAM[two]
    for s, e in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        yield np.concatenate([b[s:e], two[s : max(s, e - 1)], three[s : max(s, e - 2)]])


def ngram_counts(rows: DataFrame, label: str, text: str) -> DataFrame:
    """(label, bucket, n): n-gram counts of all rows by label. A label has at most BUCKETS rows from each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in slices(batches, "t"):
            raw, off = utf8(b.column("t"))
            for name, grams in zip(b.column("y").to_pylist(), ngrams(raw, off), strict=True):
                counts = total.setdefault(name, np.zeros(BUCKETS, np.int64))
                counts += np.bincount(grams, minlength=BUCKETS)
        for name, counts in total.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_pydict({"y": pa.array([name] * len(at), pa.string()), "bucket": pa.array(at, pa.int32()), "n": pa.array(counts[at])})

    seen = rows.select(F.col(label).cast("string").alias("y"), F.col(text).alias("t")).where("y is not null and t is not null")
    return seen.mapInArrow(run, "y string, bucket int, n long").groupBy("y", "bucket").agg(F.sum("n").alias("n"))


def code_matrix(n: int) -> np.ndarray:
    """n codewords of -1 and 1, no bit the same for all and no two bits alike or opposite."""
    if n < 2:
        return np.ones((n, 1))
    if n <= 7:
        bits = [(1, *rest) for rest in itertools.product((1, -1), repeat=n - 1) if -1 in rest]
        return np.array(bits, float).T
    rng = np.random.default_rng(7)
    tries = (np.where(rng.random((n, math.ceil(10 * math.log2(n)))) < 0.5, -1.0, 1.0) for _ in range(50))
    return max(tries, key=lambda m: (np.abs(m.sum(0)).max() < n, -max(np.abs(m @ m.T - np.diag(np.diag(m @ m.T))).max(), 0)))


class Model:
    """Languages, their codewords, and the bits' classifiers."""

    def __init__(self, counts: dict[str, np.ndarray]) -> None:
        self.langs = sorted(counts)
        self.code = code_matrix(len(self.langs))
        if not self.langs:
            return
        share = np.array([counts[x] for x in self.langs], float)
        share = (share + SMOOTHING) / (share + SMOOTHING).sum(1, keepdims=True)
        weights = []
        for bit in self.code.T:
            yes = share[bit > 0].mean(0)
            no = share[bit < 0].mean(0) if (bit < 0).any() else yes
            weights.append(np.log(yes) - np.log(no))
        self.weights = np.array(weights).T  # BUCKETS x bits
        means = share @ self.weights  # what a language's average n-gram gives each bit
        self.middle = np.array([(m[b > 0].min() + m[b < 0].max()) / 2 if (b < 0).any() else 0.0 for m, b in zip(means.T, self.code.T, strict=True)])
        gap = np.array([m[b > 0].min() - m[b < 0].max() if (b < 0).any() else 1.0 for m, b in zip(means.T, self.code.T, strict=True)])
        self.scale = 4 / np.maximum(gap, 1e-3)
        self.bit_weight = np.maximum(gap, 1e-3) / np.maximum(gap, 1e-3).sum()

    def decode(self, mean: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language, its probability and the second's, for rows of mean log-odds."""
        margin = np.clip((mean - self.middle) * self.scale, -30, 30)
        loss = sum(w * np.log1p(np.exp(-margin[:, [k]] * self.code[:, k])) for k, w in enumerate(self.bit_weight))
        best = loss.argmin(1)
        p = np.exp(-4 * (loss - loss.min(1, keepdims=True)))
        p /= p.sum(1, keepdims=True)
        top = np.sort(p, 1)
        return best, top[:, -1], top[:, -2] if p.shape[1] > 1 else np.zeros(len(p))


def fit(rows: DataFrame, label: str = "lang", text: str = "text") -> Model:
    """Learns from all rows with a label; what comes to the driver has BUCKETS counters a language."""
    counts: dict[str, np.ndarray] = {}
    for y, bucket, n in ngram_counts(rows, label, text).collect():
        counts.setdefault(y, np.zeros(BUCKETS, np.int64))[bucket] = n
    return Model(counts)


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each of docs: key, lang_pred, score, ambiguous."""
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, lang_pred string, score double, ambiguous boolean"

    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x bits numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in slices(batches, "t"):
            known = np.array([bool(m.langs and t and _LETTER.search(t)) for t in b.column("t").to_pylist()])
            names, scores, flags = np.full(len(known), "und", object), np.zeros(len(known)), np.zeros(len(known), bool)
            if known.any():
                raw, off = utf8(b.column("t"))
                mean = np.array([np.bincount(g, minlength=BUCKETS) @ m.weights / len(g) if len(g) else np.zeros(m.weights.shape[1]) for g in ngrams(raw, off)])
                best, first, second = m.decode(mean)
                names = np.where(known, np.array(m.langs, object)[best], "und")
                scores, flags = np.where(known, first, 0.0), known & (first - second < AMBIGUOUS)
            yield pa.RecordBatch.from_pydict({key: b.column("k"), "lang_pred": pa.array(names.tolist(), pa.string()), "score": pa.array(scores), "ambiguous": pa.array(flags)})

    return docs.select(docs[key].alias("k"), docs[text].alias("t")).mapInArrow(run, schema)


def held_out(key: Column, of: int, rest: int) -> Column:
    """True for rows kept out of learning; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % of == rest


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out(F.col("doc_id"), 4, 2)))
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score", "ambiguous")
