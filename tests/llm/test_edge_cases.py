"""Nulls in any column, empty and very long texts, ties and repeated rows, empty tables, extra columns with clashing names."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.llm import byte_bpe, decontaminate, embedding_dedup, language_id, licenses, line_dedup, ngram_join, secrets, substring_dedup, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k long, t string, n int, key long, node long, list string, score double, spans string"
PROSE = " ".join(f"word{i % 97}x{i % 13}" for i in range(400))


def rows(*texts):
    return [(i, t, "en" if i % 2 else None, None, None, i, "clash", 1, 2, 3, "x", 0.5, "s") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(f"w{i * 7919 % 10007}" for i in range(60000))
    data = rows(None, "", "   \n\t ", "one", "A b C d", PROSE, PROSE, PROSE + " more", long, "x" * 50000, "\n\n\n", "é" * 10 + "   ﬁn", "123 !!! ???", "line a\nline b\nline c", "line a\nline b\nline c")
    return spark.createDataFrame([*data, data[5], (None, PROSE, *data[0][2:])], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, " ".join(PROSE.split()[10:60]), "z"), (2, None, "z"), (None, "a b c d e f g", "z"), (3, "", "z")], "item_id long, text string, t string")


def labels(spark, data):
    return spark.createDataFrame(data, "doc_id long, toxic int, quality int")


def test_per_row_operators(spark, odd, none, bench):
    n = odd.count()
    model = language_id.fit(odd)
    for make in (secrets.secret_spans, licenses.license_labels, byte_bpe.bpe, lambda d: language_id.predict(d, model), lambda d: toxicity.toxicity(d, None)):
        assert make(odd).count() == n
        assert make(none).count() == 0


def test_byte_bpe_of_nothing(odd):
    got = {r["doc_id"]: r for r in byte_bpe.bpe(odd).where("doc_id < 2").collect()}
    for r in got.values():
        assert r["n_tokens"] == 0
        assert r["ids_sha256"] == r["decoded_sha256"] == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def test_language_of_nothing_and_without_letters(odd):
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.predict(odd, language_id.fit(odd)).collect()}
    assert {got[i] for i in (0, 1, 2, 10, 12)} == {"und"}
    assert got[5] == "en"


def test_ngram_join(odd, none):
    got = {r["doc_id"]: r for r in ngram_join.ngram_join(odd.where("doc_id is not null")).collect()}
    assert [got[i]["n_shingles"] for i in (0, 1, 2, 3, 4, 10)] == [0, 0, 0, 1, 1, 0]
    assert all(got[i]["component_id"] == i for i in (0, 1, 2, 3, 4, 8, 9, 10))
    assert {got[i]["component_id"] for i in (5, 6, 7)} == {5}
    assert got[14]["component_id"] == 13
    assert ngram_join.ngram_join(odd).where("doc_id is null and component_id is null").count() == 1
    assert ngram_join.ngram_join(none).count() == 0


def test_line_dedup(odd, none):
    runs = {r["doc_id"]: r["runs"] for r in line_dedup.repeated_runs(odd.dropDuplicates(["doc_id"])).collect()}
    assert [tuple(x) for x in runs[14]] == [(0, 3, 13, 0)] and set(runs) == {14}
    twice = odd.where("doc_id = 14").withColumn("text", F.lit("own\nline a\nline b\nrest"))
    left = {r["text"] for r in line_dedup.dedup_lines(odd.where("doc_id in (13, 14)").unionByName(twice)).where("doc_id = 14").collect()}
    assert left == {"own\nrest"}
    out = line_dedup.dedup_lines(odd)
    assert out.columns == odd.columns and out.where("doc_id = 14").count() == 0
    assert out.where("doc_id is null").count() == 1 and out.where("text is null").count() == 1
    assert line_dedup.dedup_lines(none).count() == 0 and line_dedup.repeated_runs(none).count() == 0


def test_decontaminate(odd, none, bench):
    got = {r["doc_id"]: r for r in decontaminate.contaminated(odd, bench).collect()}
    assert set(got) == {None, 5, 6, 7} and got[5]["item_ids"] == [1] and got[5]["coverage"] == 1.0
    assert decontaminate.contaminated(none, bench).count() == 0
    assert decontaminate.contaminated(odd, bench.limit(0)).count() == 0


def test_substring_dedup(odd, none):
    pairs = {(r["doc_id"], r["other"]) for r in substring_dedup.repeated_passages(odd.dropDuplicates(["doc_id"])).collect()}
    assert {x for p in pairs for x in p} == {5, 6, 7} and all(a > b for a, b in pairs)
    assert substring_dedup.repeated_passages(none).count() == 0


def test_toxicity_without_labels(spark, odd, none):
    assert toxicity.fit(odd, labels(spark, [])) is None
    assert toxicity.fit(odd, labels(spark, [(1, 1, 0), (2, None, 0), (None, 0, 1)])) is None
    assert toxicity.fit(none, labels(spark, [(1, 1, 0), (2, 0, 0)])) is None
    assert toxicity.without_toxic(odd, None).columns == odd.columns


def test_embeddings(spark):
    v = [float(x) for x in np.random.default_rng(1).normal(size=8)]
    near = [x + 0.01 for x in v]
    data = [(1, v), (2, v), (3, near), (4, None), (5, []), (6, [0.0] * 8), (7, [float("nan")] + v[1:]), (8, [float("inf")] + v[1:]), (9, [None] + v[1:]), (10, v[:4]), (11, [-x for x in v]), (None, v), (12, [1e300 * x for x in v])]
    got = {r["vec_id"]: r for r in embedding_dedup.near_links(spark.createDataFrame([(a, b, 1, 2) for a, b in data], "vec_id long, embedding array<double>, rep int, list int")).collect()}
    assert len(got) == len(data)
    assert [got[i]["n_links"] for i in (1, 2, 3, 12)] == [3, 3, 3, 3] and {got[i]["component_id"] for i in (1, 2, 3, 12)} == {1}
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i in (4, 5, 6, 7, 8, 9, 10, 11))
    assert embedding_dedup.near_links(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert embedding_dedup.near_links(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")).first()["kept"]


def test_clashing_names_do_not_matter(spark, odd):
    wide = odd.withColumnsRenamed({"k": "spans2"}).withColumn("__key", F.lit(1)).withColumn("runs", F.lit(2)).withColumn("bucket", F.lit(3))
    assert secrets.secret_spans(wide).count() == wide.count()
    assert line_dedup.dedup_lines(wide.drop("__key")).columns == wide.drop("__key").columns
