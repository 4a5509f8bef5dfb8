import re

import corpus_pipeline
from pyspark.sql import functions as F

from folioscope.llm import decontaminate, ngram_join


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "ngram_join", "decontaminate", "byte_bpe"]
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir).persist()
        assert out.columns == docs.columns
        n = out.count()
        assert 0 < n <= before
        if name == "ngram_join":
            assert ngram_join.ngram_join(out).where("doc_id <> component_id").count() == 0
        if name == "decontaminate":
            assert decontaminate.contaminated(out, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).count() == 0
        docs, before = out, n
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert last.count() == before and last.where(~F.col("decoded_ok")).count() == 0


def _tables(spark, path, docs, extra=""):
    """A folder of tables with these documents (doc_id, text), and labels and a benchmark that go with them."""
    full = [(i, t, "en", None, len(t) if t is not None else None, 1, "clash") for i, t in docs]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, node long, `key` string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 0, int("grubmel" in (t or ""))) for i, t in docs if i is not None], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(f"bench{i}" for i in range(30))), (2, None), (None, "a b c d e f")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_stages_on_nulls_repeated_rows_and_clashing_names(spark, tmp_path):
    prose = lambda n, seed: " ".join(f"w{(i * 7919 + seed * 104729) % 5003}" for i in range(n))
    docs = [(None, None), (None, prose(40, 1)), (1, None), (2, ""), (3, "   \n \t"), (4, "one"), (5, prose(200, 2)), (6, prose(200, 2)), (5, prose(200, 2)), (7, prose(200, 2) + " end"), (8, prose(60000, 3))]
    docs += [(9, "x " + " ".join(f"bench{i}" for i in range(30)) + " y"), (10, "first line here\nsecond line there\nown ten"), (11, "first line here\nsecond line there\nown eleven")]
    d = _tables(spark, tmp_path, docs)
    names = set(spark.read.parquet(f"{d}/documents.parquet").columns)
    got = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, spark.read.parquet(f"{d}/documents.parquet"), d)
        assert set(out.columns) == names
        got[name] = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    assert got["toxicity"] == sorted(docs, key=str)
    assert (11, "own eleven") in got["line_dedup"] and (10, docs[-2][1]) in got["line_dedup"] and 6 not in {i for i, _ in got["line_dedup"]}
    assert {i for i, _ in got["ngram_join"]} == {None, 1, 2, 3, 4, 5, 8, 9, 10, 11} and sum(i == 5 for i, _ in got["ngram_join"]) == 2
    assert got["decontaminate"] == sorted((x for x in docs if x[0] != 9), key=str)
    out = corpus_pipeline.tokenize(spark, spark.read.parquet(f"{d}/documents.parquet"), d).collect()
    assert len(out) == len(docs)
    assert corpus_pipeline.run(spark, d).count() == len(docs) - 3  # without 6, 7 and 9


def test_stages_on_empty_tables(spark, tmp_path):
    d = _tables(spark, tmp_path, [])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.read.parquet(f"{d}/documents.parquet"), d).count() == 0
    assert corpus_pipeline.run(spark, d).count() == 0


def test_stages_against_brute_force(spark, sf_dir):
    """Each filtering stage on the documents: what goes is what plain Python says."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t.lower() if t.isascii() else t.translate({i: i + 32 for i in range(65, 91)}))
    sets = {}
    for i, t in texts.items():
        w = words(t)
        sets[i] = {tuple(w[x : x + 5]) for x in range(len(w) - 4)} or ({tuple(w)} if w else set())
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    assert {r["doc_id"] for r in corpus_pipeline.dedup_near(spark, docs, sf_dir).collect()} == {i for i in ids if find(i) == i}

    seen, gone = set(), {}
    for i in ids:  # lines that stand in a pair of lines, or a line of 50 words, that occurred before
        lines = [x.strip(" \t\r") for x in texts[i].split("\n")]
        at = [x for x, line in enumerate(lines) if line]
        bad = set()
        for x, y in enumerate(at):
            keys = [(lines[y],)] if len(lines[y].split()) >= 50 else []
            keys += [(lines[y], lines[at[x + 1]])] if x + 1 < len(at) else []
            for k in keys:
                if k in seen:
                    bad |= {y} if len(k) == 1 else {y, at[x + 1]}
                seen.add(k)
        gone[i] = bad
    want = {}
    for i in ids:
        lines = texts[i].split("\n")
        left = [x for n, x in enumerate(lines) if n not in gone[i]]
        if not gone[i] or any(x.strip(" \t\r") for x in left):
            want[i] = "\n".join(left)
    assert {r["doc_id"]: r["text"] for r in corpus_pipeline.dedup_lines(spark, docs, sf_dir).collect()} == want


def test_run_is_the_stages(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir)
    assert 0 < got.count() and got.columns[0] == "doc_id"
