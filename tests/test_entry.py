import __spark_entry__ as e


def test_entry_and_registry(spark):
    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_queries_match_their_sql(spark, sf_dir):
    import glob
    import os

    import duckdb

    from folioscope.plans.registry import QUERIES, SQL

    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")

    def plain(rows):
        return sorted(tuple("" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in rows)

    for name in SQL:
        df = QUERIES[name](spark, sf_dir)
        names = sorted(df.columns)
        got = plain(df.select(*names).collect())
        quoted = ", ".join(f'"{n}"' for n in names)
        assert got == plain(con.execute(f"SELECT {quoted} FROM ({SQL[name]})").fetchall()), name


def test_the_rest_works_without_the_training_data_operators(tmp_path):
    import pathlib
    import shutil
    import subprocess
    import sys

    root = pathlib.Path(e.__file__).parent
    for gone in (("folioscope/llm",), ("folioscope/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)):
        copy = tmp_path / "-".join(g.replace("/", "_") for g in gone)
        shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "tests"))
        for g in gone:
            if (copy / g).exists():
                shutil.rmtree(copy / g) if (copy / g).is_dir() else (copy / g).unlink()
        said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(*sorted(set(e.queries()) | set(e.oracle_sql())))"], cwd=copy, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin"})
        assert said.returncode == 0, said.stderr
        names = said.stdout.split()
        assert "pipeline" not in names and "trend_changes" in names
        if "folioscope/llm" in gone:
            assert not any(n.startswith("op") for n in names)
