"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Learning uses labelled rows only, at most EXAMPLES of each class, taken by a hash of the key. Terms are lower-cased words
and word stems (the first 5, 6 and 7 letters). Prose shares most of its words with any other prose, so cosine over all terms
finds nearest examples by topic; the vocabulary is therefore the TERMS terms that tell toxic examples best from others (log-odds z-score of at least MIN_Z). Document frequencies are counted over
all documents. A text's vector is (1 + log tf) * idf * z over that vocabulary, of length one.

The index keeps for each term its postings in blocks of BLOCK examples and each block's largest weight. A query adds these
to an upper bound for each block and scores the block of the highest bound; blocks whose bound is below its K-th best score are
skipped: the K nearest are exact, ties to the earlier example. Their cosine-weighted vote is turned into a probability by
a monotone map learned from each example's vote by all others, with classes weighted as among all labels. The three
nearest examples are returned as evidence.

Defined results: a text without terms of the vocabulary, empty and null included, gets the share of toxic labels among
examples without any, and no evidence. Without labels of both classes all scores are 0. A key with several labels is toxic if
one says so, and its texts count together as one example; null labels and labels of missing documents don't count. Repeated rows each give their row.
Keys of labels are whole numbers.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.common import slices, table
from folioscope.llm.language_id import held_out

EXAMPLES, TERMS, MIN_Z, BLOCK, K = 3000, 1024, 3.5, 64, 25
THRESHOLD = 0.7
_WORDS = re.compile(r"[^\W\d_]+")


def terms(text: str | None) -> Counter:
    """Words and stems with their counts."""
    out: Counter = Counter()
    for word, n in Counter(_WORDS.findall((text or "").lower())).items():
        out[word] += n
        for k in (5, 6, 7):
            if len(word) > k:
                out[word[:k] + "*"] += n
    return out


class Vocabulary:
    """Numbers of the vocabulary's terms that a word gives: itself and its stems."""

    def __init__(self, names: list[str]) -> None:
        self.words = {t: i for i, t in enumerate(names) if t[-1:] != "*"}
        self.stems = {t[:-1]: i for i, t in enumerate(names) if t[-1:] == "*"}
        self.known: dict[str, tuple[int, ...]] = {}

    def of(self, word: str) -> tuple[int, ...]:
        got = [self.words[word]] if word in self.words else []
        got += [self.stems[word[:k]] for k in (5, 6, 7) if len(word) > k and word[:k] in self.stems]
        if len(self.known) > 100_000:  # bounds memory only
            self.known.clear()
        self.known[word] = out = tuple(got)
        return out

    def bag(self, text: str | None) -> dict[int, int]:
        out: dict[int, int] = {}
        known = self.known
        for w in _WORDS.findall((text or "").lower()):
            for i in known[w] if w in known else self.of(w):
                out[i] = out.get(i, 0) + 1
        return out


class Index:
    """Block-max inverted index of the examples, and what turns votes into scores."""

    def __init__(self, vocabulary: list[str], weight: np.ndarray, ids: list[int], labels: list[int], bags: list[dict[int, int]], class_weight: tuple[float, float]) -> None:
        self.vocabulary = Vocabulary(vocabulary)
        self.weight, self.ids, self.labels = weight, np.array(ids, np.int64), np.array(labels, float)
        self.vote = np.where(self.labels > 0, class_weight[1], class_weight[0])
        self.blocks = max(1, -(-len(ids) // BLOCK))
        lists: list[list[tuple[int, float]]] = [[] for _ in vocabulary]
        for x, bag in enumerate(bags):
            for t, v in zip(*self.vector(bag), strict=True):
                lists[t].append((x, v))
        self.docs = [np.array([x for x, _ in one], np.int64) for one in lists]
        self.values = [np.array([v for _, v in one]) for one in lists]
        self.cuts = [np.searchsorted(d, np.arange(self.blocks + 1) * BLOCK).tolist() for d in self.docs]
        self.most = np.zeros((len(vocabulary), self.blocks))
        for t, (d, v) in enumerate(zip(self.docs, self.values, strict=True)):
            np.maximum.at(self.most[t], d // BLOCK, v)
        self.bounds, self.scores, self.empty = np.zeros(0), np.zeros(0), 0.0
        self.bags = list(bags)

    def vector(self, bag: dict[int, int]) -> tuple[list[int], np.ndarray]:
        at = sorted(bag)
        v = np.array([(1 + math.log(bag[t])) * self.weight[t] for t in at])
        return at, v / np.linalg.norm(v) if len(at) else v

    def nearest(self, bag: dict[int, int], without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Positions and cosines of the K nearest examples with a common term, best first.

        The block of the highest bound is scored first; its K-th best score rules out all blocks of a lower bound at once,
        and the postings of the others are added term by term."""
        at, v = self.vector(bag)
        if not at:
            return np.zeros(0, np.int64), np.zeros(0)
        bound = v @ self.most[at]
        top = int(bound.argmax())
        first = np.zeros(BLOCK)
        for t, w in zip(at, v.tolist(), strict=True):
            s, e = self.cuts[t][top], self.cuts[t][top + 1]
            if s < e:
                first[self.docs[t][s:e] - top * BLOCK] += w * self.values[t][s:e]
        if 0 <= without - top * BLOCK < BLOCK:
            first[without - top * BLOCK] = 0.0
        least = np.partition(first, -K)[-K] if BLOCK > K else 0.0
        left = bound >= max(least - 1e-12, 1e-12)
        score = np.zeros(self.blocks * BLOCK)
        whole = left.mean() > 0.25
        for t, w in zip(at, v.tolist(), strict=True):
            d, x = self.docs[t], self.values[t]
            if not whole:
                own = left[d // BLOCK]
                d, x = d[own], x[own]
            score[d] += w * x
        if without >= 0:
            score[without] = 0.0
        x = np.flatnonzero(score >= max(least, 1e-12))
        order = np.lexsort((x, -score[x]))[:K]
        return x[order], score[x[order]]

    def votes(self, x: np.ndarray, s: np.ndarray) -> float:
        w = s * self.vote[x]
        return float((w * self.labels[x]).sum() / w.sum()) if len(x) else -1.0

    def score(self, vote: float) -> float:
        return self.empty if vote < 0 else float(np.interp(vote, self.bounds, self.scores)) if len(self.bounds) else 0.0

    def calibrate(self, votes: np.ndarray) -> None:
        """votes: each example's by all others, -1 where it has no term. Pools neighbours until shares rise with votes."""
        none = votes < 0
        y, w = self.labels, self.vote
        self.empty = float((w * y)[none].sum() / w[none].sum()) if none.any() else 0.0
        order = np.argsort(votes[~none], kind="stable")
        pools: list[list[float]] = []
        for v, yy, ww in zip(votes[~none][order], y[~none][order], w[~none][order], strict=True):
            pools.append([v * ww, yy * ww, ww])
            while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
                last = pools.pop()
                pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
        self.bounds = np.array([p[0] / p[2] for p in pools])
        self.scores = np.array([p[1] / p[2] for p in pools])


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", examples: int = EXAMPLES) -> Index | None:
    """Learns from labels (key, label) joined with docs. To the driver come at most 2 * examples keys with their bags over
    the vocabulary, TERMS terms and as many counts."""
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.max((F.col(label) > 0).cast("int")).alias("y"))
    size = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    if len(size) < 2:
        return None
    chosen = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("k"), "k").limit(examples)
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(chosen), "k")  # 2 * examples rows at most

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "t"):
            for k, y, t in zip(*(b.column(c).to_pylist() for c in ("k", "y", "t")), strict=True):
                counts = terms(t)
                n = len(counts)
                yield pa.RecordBatch.from_pydict({"k": pa.array([k] * n, pa.int64()), "y": pa.array([y] * n, pa.int32()), "term": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.int64())})

    all_bags = rows.mapInArrow(bags, "k long, y int, term string, n long").persist()
    found = rows.select("k", "y").distinct().orderBy("k").collect()
    n1 = sum(r["y"] for r in found)
    n0 = len(found) - n1
    if not n0 or not n1:
        all_bags.unpersist()
        return None
    counted = all_bags.groupBy("term").agg(F.countDistinct(F.when(F.col("y") == 1, F.col("k"))).alias("a"), F.countDistinct(F.when(F.col("y") == 0, F.col("k"))).alias("b"))
    odds = f"(ln((a + 0.5) / ({n1} - a + 0.5)) - ln((b + 0.5) / ({n0} - b + 0.5))) / sqrt(1 / (a + 0.5) + 1 / (b + 0.5) + 1 / ({n1} - a + 0.5) + 1 / ({n0} - b + 0.5))"
    picked = counted.where("a + b >= 3").selectExpr("term", f"{odds} as z").where(f"abs(z) >= {MIN_Z}").orderBy(F.desc(F.abs("z")), "term").limit(TERMS).collect()
    vocabulary = [r["term"] for r in picked]
    place = {r["k"]: i for i, r in enumerate(found)}
    mine = all_bags.join(F.broadcast(docs.sparkSession.createDataFrame([(t, i) for i, t in enumerate(vocabulary)], "term string, i int")), "term")
    at = mine.groupBy("k", "i").agg(F.sum("n").alias("n")).toArrow()
    bags_of: list[dict[int, int]] = [{} for _ in found]
    for k, i, n in zip(*(at[c].to_numpy() for c in ("k", "i", "n")), strict=True):
        bags_of[place[int(k)]][int(i)] = int(n)
    del at
    all_bags.unpersist()
    n_docs, df = document_frequency(docs, vocabulary, text)
    weight = np.array([(math.log((n_docs + 1) / (d + 1)) + 1) * abs(r["z"]) for d, r in zip(df, picked, strict=True)])
    index = Index(vocabulary, weight, [r["k"] for r in found], [r["y"] for r in found], bags_of, (size[0] / n0, size[1] / n1))
    bags_of.clear()
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column("i").to_pylist()
            got = [shared.value.votes(*shared.value.nearest(shared.value.bags[i], i)) for i in own]
            yield pa.RecordBatch.from_pydict({"i": pa.array(own, pa.int32()), "v": pa.array(got, pa.float64())})

    out = np.full(len(found), -1.0)
    numbers = docs.sparkSession.range(0, len(found), 1, 24).select(F.col("id").cast("int").alias("i"))
    voted = numbers.mapInArrow(others, "i int, v double").toArrow()
    out[voted["i"].to_numpy()] = voted["v"].to_numpy()
    shared.destroy()
    index.bags = []  # needed for these votes only
    index.calibrate(out)
    return index


def document_frequency(docs: DataFrame, vocabulary: list[str], text: str) -> tuple[int, list[int]]:
    """Number of all documents, and of those with each term."""
    size = len(vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(vocabulary))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + 1, np.int64)
        for b in slices(batches, "t"):
            total[-1] += b.num_rows
            for t in b.column("t").to_pylist():
                total[list(shared.value.bag(t))] += 1
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(len(total)), pa.int32()), "n": pa.array(total)})

    total = [0] * (size + 1)
    for r in docs.select(F.col(text).alias("t")).mapInArrow(count, "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).collect():
        total[r["i"]] = r["n"]
    return total[-1], total[:-1]


def score_texts(texts: list[str | None], x: Index | None) -> tuple[list[float], list[list[int]]]:
    """Scores, and the keys of the three nearest examples."""
    scores, evidence = [], []
    for t in texts:
        if x is None:
            scores.append(0.0)
            evidence.append([])
            continue
        at, s = x.nearest(x.vocabulary.bag(t))
        scores.append(x.score(x.votes(at, s)))
        evidence.append(x.ids[at[:3]].tolist())
    return scores, evidence


def toxicity(docs: DataFrame, index: Index | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each of docs: key, score, evidence (keys of the three nearest examples)."""
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, score double, evidence array<long>"
    shared = docs.sparkSession.sparkContext.broadcast(index)  # at most 2 * EXAMPLES vectors over TERMS terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "t"):
            scores, evidence = score_texts(b.column("t").to_pylist(), shared.value)
            yield pa.RecordBatch.from_pydict({key: b.column("k"), "score": pa.array(scores, pa.float64()), "evidence": pa.array(evidence, pa.list_(pa.int64()))})

    return docs.select(docs[key].alias("k"), docs[text].alias("t")).mapInArrow(run, schema)


def without_toxic(docs: DataFrame, index: Index | None, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs, all columns kept, without the rows that score at least `threshold`; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text):
            scores, _ = score_texts(b.column(text).to_pylist(), shared.value)
            yield b.filter(pa.array(np.array(scores) < threshold))

    return docs.mapInArrow(run, docs.schema)


def fit_held_out(docs: DataFrame, labels: DataFrame) -> Index | None:
    """Learns from the labels of keys that aren't held out."""
    return fit(docs, labels.where(~held_out(F.col("doc_id"), 3, 1)))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    index = fit_held_out(docs, table(spark, sf_dir, "labels"))
    return toxicity(docs, index).select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence")
