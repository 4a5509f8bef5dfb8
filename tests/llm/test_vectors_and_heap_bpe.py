"""Vector codes, centroid clustering and heap BPE against plain restatements and the tokenizers library."""

import hashlib
import math

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from folioscope.llm import centroid_clustering, heap_bpe, vector_codes
from folioscope.llm.common import packed, unpacked

SCHEMA = "vec_id long, embedding array<double>, label int, id long, x string, g int, cluster string, code int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, lab, 1, "clash", 2, "clash", 3) for i, v, lab in rows], SCHEMA).repartition(3)


def sample(n, d, seed=5):
    """Vectors with ties, copies and both signs."""
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, d)), 2)
    x[n // 2 :: 3] = x[0]
    x[1::7] = -x[1::7]
    return [(int(i), [float(c) for c in v], int(i) % 3 if i % 5 else None) for i, v in zip(rng.permutation(n), x, strict=True)]


def nearest(v, entries):
    return min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), i) for i, e in enumerate(entries))


def lloyd(points, centers, rounds):
    for _ in range(rounds):
        groups = {}
        for v in points:
            groups.setdefault(nearest(v, centers)[1], []).append(v)
        centers = [[sum(c) // len(groups[i]) for c in zip(*groups[i], strict=True)] if i in groups else e for i, e in enumerate(centers)]
    return centers


def text_sha(numbers):
    return hashlib.sha256(",".join(map(str, numbers)).encode()).hexdigest()


def test_vector_codes_against_brute_force(spark):
    data = sample(90, 16)
    got = {r["vec_id"]: r for r in vector_codes.vector_codes(frame(spark, data), parts=4, entries=6, rounds=3)[0].collect()}
    ints = {i: [math.floor(4096 * c) for c in v] for i, v, _ in data}
    books = []
    for p in range(4):
        cut = {i: v[4 * p : 4 * p + 4] for i, v in ints.items()}
        books.append(lloyd([cut[i] for i in sorted(cut)], [cut[i] for i in sorted(cut)[:6]], 3))
    want = {i: [nearest(v[4 * p : 4 * p + 4], books[p]) for p in range(4)] for i, v in ints.items()}
    of = {i: lab for i, _, lab in data}
    sums = {}
    for i, w in want.items():
        sums[of[i]] = sums.get(of[i], 0) + sum(d for d, _ in w)
    sha = text_sha(c for b in books for e in b for c in e)
    assert len(got) == 90
    for i, w in want.items():
        assert got[i]["code"] == "".join(f"{e:02x}" for _, e in w) and got[i]["error"] == sum(d for d, _ in w)
        assert got[i]["label_error"] == sums[of[i]] and got[i]["codebooks_sha256"] == sha


def test_gnat_is_exact_and_prunes():
    rng = np.random.default_rng(3)
    for entries in (rng.integers(-3, 4, (40, 3)), np.concatenate([c + rng.integers(-20, 20, (32, 8)) for c in rng.integers(-4000, 4000, (8, 8))]), np.zeros((9, 4), np.int64), rng.integers(0, 9, (1, 2)), 5 * np.ones((2, 2), np.int64)):
        x = np.concatenate([entries[rng.integers(0, len(entries), 300)] + rng.integers(-2, 3, (300, entries.shape[1])), entries])
        index, best, computed = vector_codes.Gnat(entries).nearest(x)
        d = ((x[:, None] - entries[None]) ** 2).sum(2)
        assert (index == d.argmin(1)).all() and (best == d.min(1)).all()
        if len(entries) == 256:
            assert computed < 0.5 * len(x) * 256
    n = np.array([0, 1, 2, 3, 4, 8, 9, 10, (1 << 52) - 1, 1 << 52, (94906265 + 1) ** 2 - 1])
    assert vector_codes.root_down(n).tolist() == [math.isqrt(i) for i in n.tolist()]
    assert vector_codes.root_up(n).tolist() == [math.isqrt(i - 1) + 1 if i else 0 for i in n.tolist()]


def test_vector_codes_of_odd_rows(spark):
    v = [float(i) / 7 for i in range(8)]
    rows = [(3, v, 1), (3, v, 1), (None, [-c for c in v], None), (4, None, 1), (5, [], 2), (6, [None, *v[1:]], 1), (7, [float("nan"), *v[1:]], 1), (8, [float("inf"), *v[1:]], 1), (9, v[:5], 1), (10, [1e30, *v[1:]], 7), (11, v * 2, None)]
    out, books = vector_codes.vector_codes(frame(spark, rows), entries=16)
    got = sorted(((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in out.collect()), key=repr)
    assert [g[0] for g in got] == [10, 11, 3, 3, 5, 9, None]
    assert {g[0]: g[1:] for g in got if g[0] in (5, 9, 10)} == {5: (None, None, None), 9: (None, None, 0), 10: (None, None, None)}
    assert {g[1:] for g in got if g[0] == 3} == {("00" * 8, 0, 0)}  # both copies stand in the codebook, the first wins
    assert [g for g in got if g[0] == 11] == [(11, None, None, 0)] and books.books.shape == (8, 3, 1)
    back = {r["vec_id"]: r["vector"] for r in vector_codes.decoded(out, books).collect()}
    assert back[9] is None and max(abs(a - b) for a, b in zip(back[3], v, strict=True)) <= 0.5 / 4096
    none, no_books = vector_codes.vector_codes(frame(spark, []))
    assert none.count() == 0 and no_books is None
    assert vector_codes.vector_codes(frame(spark, [(1, None, 1), (2, [1.0], 1)]))[0].collect()[0]["code"] is None
    with pytest.raises(ValueError):
        vector_codes.vector_codes(frame(spark, rows), entries=257)


def test_clustering_against_brute_force(spark):
    data = sample(120, 10, 8)
    out, centroids = centroid_clustering.cluster(frame(spark, data), clusters=7, rounds=4, components=10, seed=9)
    got = {r["vec_id"]: r for r in out.collect()}
    ints = {i: [math.floor(256 * c) for c in v] for i, v, _ in data}
    first = sorted(ints, key=lambda i: hashlib.sha256(f"9:{i}".encode()).hexdigest())[:7]
    centers = lloyd(list(ints.values()), [ints[i] for i in first], 4)
    assert centroids.tolist() == centers and len(got) == 120
    want = {i: nearest(v, centers) for i, v in ints.items()}
    for i, (d, c) in want.items():
        r = got[i]
        assert (r["cluster"], r["distance"]) == (c, d)
        assert r["cluster_inertia"] == sum(e for e, k in want.values() if k == c) and r["inertia"] == sum(e for e, _ in want.values())
        assert r["centroid_sha256"] == text_sha(centers[c])


def test_clustering_of_odd_rows(spark):
    v = [float(i) for i in range(8)]
    rows = [(3, v, 1), (3, v, 1), (None, [-c for c in v], None), (4, None, 1), (5, [], 2), (6, [None, *v[1:]], 1), (7, [float("nan"), *v[1:]], 1), (8, [float("-inf"), *v[1:]], 1), (9, v[:5], 1), (10, [1e30, *v[1:]], 7)]
    got = sorted(((r["vec_id"], r["cluster"], r["distance"], r["inertia"]) for r in centroid_clustering.cluster(frame(spark, rows), components=8)[0].collect()), key=repr)
    assert got == [(3, 0, 0, 0), (3, 0, 0, 0), (None, 2, 0, 0)]  # the copy's own centroid stays empty
    assert centroid_clustering.cluster(frame(spark, []))[0].count() == 0
    big = [(i, [float(i * 300_000), 0.0], 1) for i in range(5)]
    assert {r["distance"] for r in centroid_clustering.cluster(frame(spark, big), clusters=1, rounds=2, components=2)[0].collect()} == {(256 * 300_000 * (i - 2)) ** 2 for i in range(5)}


def test_partial_distances_are_exact_for_large_numbers():
    x, c = np.array([[(1 << 25) - 1, -(1 << 25)], [3, 4]]), np.array([[-(1 << 25), (1 << 25) - 1], [0, 0]])
    assert centroid_clustering.partial_distances(x, c).tolist() == [[sum((int(a) - int(b)) ** 2 for a, b in zip(r, e, strict=True)) for e in c] for r in x]
    for a in ([], [0, -5], [40000], [1 << 40, -1]):
        assert unpacked(packed(np.array(a, np.int64))).tolist() == a


@pytest.fixture(scope="module")
def library():
    import public_tokenizers as public
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public.path(heap_bpe.VOCABULARY))


ODD = [
    None, "", " ", "aaaaaaaaaaaaaaaaaaa", "a" * 5000 + "b" * 3001, "日本語 テキスト\x00\x1f", "²³½ Ⅷ १२ ª_º", "I'll  we've\n\n x's'", "   tab\t\tend ", "<|endoftext|>", "a <|endoftext|><|endoftext|> b", "<|endoftext", "x<|endoftext|>\n\n",
    "".join(chr(0x3400 + i) for i in range(20000)), "a࢏b \U00016ea0\U00016ea0 1\U00011de0", "  x ﻿", "é ‍\U0001f469‍\U0001f52c", " " * 4000, "0123456789" * 900,
]


def test_heap_bpe_is_the_library(spark, sf_dir, library):
    t = pq.read_table(f"{sf_dir}/documents.parquet").to_pydict()
    texts = dict(zip(t["doc_id"], t["text"], strict=True)) | {-1 - i: s for i, s in enumerate(ODD)}
    docs = spark.createDataFrame([(i, s, 1, "clash") for i, s in texts.items()], "doc_id long, text string, k int, t string").repartition(5)
    got = {r["doc_id"]: r for r in heap_bpe.encode(docs, with_ids=True).collect()}
    assert len(got) == len(texts)
    for i, s in texts.items():
        ids = library.encode(s or "", add_special_tokens=False).ids
        assert got[i]["ids"] == ids and got[i]["n_tokens"] == len(ids), s
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest() and got[i]["decoded_ok"]
    back = {r["doc_id"]: r["text"] for r in heap_bpe.decode(spark.createDataFrame([(i, r["ids"]) for i, r in got.items()] + [(10**9, None)], "doc_id long, ids array<int>")).collect()}
    assert back == {i: s or "" for i, s in texts.items()} | {10**9: None}


def test_heap_bpe_decodes_broken_text_as_the_library(spark, library):
    rng = np.random.default_rng(1)
    rows = [(i, [int(x) for x in rng.integers(0, 50257, 40)]) for i in range(200)] + [(300, library.encode("日本").ids[:-1]), (301, [])]
    got = {r["doc_id"]: r["text"] for r in heap_bpe.decode(spark.createDataFrame(rows, "doc_id long, ids array<int>")).collect()}
    assert got == {i: library.decode(ids, skip_special_tokens=False) for i, ids in rows}


def test_heap_bpe_of_nothing_and_other_vocabularies(spark):
    import public_tokenizers as public

    none = spark.createDataFrame([], "doc_id string, text string")
    assert heap_bpe.encode(none).count() == 0 and heap_bpe.encode(none).schema["doc_id"].dataType.simpleString() == "string"
    row = heap_bpe.encode(spark.createDataFrame([(None, None)], "doc_id string, text string")).first()
    assert row["n_tokens"] == 0 and row["ids_sha256"] == row["decoded_sha256"] == hashlib.sha256(b"").hexdigest()
    with pytest.raises(ValueError):
        heap_bpe.coder(public.path("word_bpe_49k.json"))


def test_a_small_cache_changes_nothing(monkeypatch, library):
    import public_tokenizers as public

    monkeypatch.setattr(heap_bpe, "CACHE", 3)
    code = heap_bpe.coder.__wrapped__(public.path(heap_bpe.VOCABULARY))
    text = "one two three one four five six two one seven three"
    for _ in range(3):
        assert np.frombuffer(code.encode(text), "<u4").tolist() == library.encode(text).ids


def test_queries_are_whole_tables(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("embedding is not null").count()
    assert vector_codes.op11_vector_codes(spark, sf_dir).agg(F.count("*"), F.count_distinct("vec_id")).first()[:] == (n, n)
    assert centroid_clustering.op13_centroid_clustering(spark, sf_dir).count() == n
