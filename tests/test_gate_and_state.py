"""Readiness and gate, state in partitions, single ids, page accounts."""

import json
import os

import pytest
from pyspark.sql import functions as F

from folioscope.operators import enrich as E
from folioscope.operators import gate as J
from folioscope.operators import routing as W
from folioscope.operators import state as Z
from folioscope.sources import pages
from folioscope.streaming.upserts import keyed_sink


def metrics(spark, **values):
    return spark.createDataFrame([(k, str(v)) for k, v in values.items()], "metric string, value string")


def test_readiness(spark):
    sample = spark.createDataFrame([("1", "causal", "x", "research", "a"), ("2", " ", "x", "research", ""), ("3", "other", None, "comment_reply", None)], "article_id string, manual_label string, validation_category string, article_scope string, abstract string")
    batches = spark.createDataFrame([("B2", "0", "3"), ("B1", "2", "0"), ("B3", "1", "1")], "batch_id string, completed_manual_labels string, remaining_manual_labels string")
    drift = spark.createDataFrame([("1", "title"), ("1", "doi")], "article_id string, field string")
    got = dict(map(tuple, J.readiness(sample, drift, batches).collect()))
    assert got == {
        "sample_rows": "3", "completed_manual_labels": "2", "remaining_manual_labels": "1", "sample_missing_abstract_rows": "2", "sample_validation_category_x": "2", "sample_validation_category_": "1", "sample_article_scope_research": "2", "sample_article_scope_comment_reply": "1",
        "drifted_articles": "1", "drifted_cells": "2", "reviewer_batches": "3", "completed_reviewer_batches": "1", "started_reviewer_batches": "2", "next_incomplete_batch": "B2", "ready_for_blind_review": "no",
    }
    assert dict(map(tuple, J.readiness(sample, drift.limit(0), batches).collect()))["ready_for_blind_review"] == "yes"
    none = dict(map(tuple, J.readiness(sample.limit(0), drift.limit(0), batches.limit(0)).collect()))
    assert none["sample_rows"] == "0" and none["ready_for_blind_review"] == "no" and none["next_incomplete_batch"] == "" and none["reviewer_batches"] == "0"


def test_gate_names_what_blocks_first(spark):
    ready, whole = metrics(spark, ready_for_blind_review="yes", drifted_articles=0, sample_rows=4), metrics(spark, total_rows=4, completed_manual_labels=4, remaining_manual_labels=0)
    calibration, overlap = metrics(spark, calibration_rows=2, completed_calibration_labels=5, completed_calibration_rows=2), metrics(spark, overlap_rows=0)
    asked, go = spark.createDataFrame([("causal",), ("other",)], "adjudicated_label string"), spark.createDataFrame([("proceed",)], "recommendation string")
    run = lambda *a: J.validation_checks(*a)
    checks = run(ready, whole, calibration, overlap, asked, go)
    assert [(r["check"], r["status"]) for r in checks.orderBy("ord").collect()] == list(zip(J.CHECKS, ["pass", "pass", "pass", "not_applicable", "pass", "pass"], strict=True))
    assert tuple(J.gate(checks).first()) == ("proceed", "", 0)
    none = metrics(spark, x=1).limit(0)
    blocked = {r["check"]: r["status"] for r in run(none, none, none, none, asked.limit(0), go.limit(0)).collect()}
    assert blocked == {c: "not_applicable" if c == "adjudication" else "block" for c in J.CHECKS}
    some = run(ready, none, metrics(spark, calibration_rows=3, completed_calibration_labels=2), metrics(spark, overlap_rows=2, completed_overlap_labels=1), asked.unionByName(spark.createDataFrame([("",)], "adjudicated_label string")), spark.createDataFrame([("pause",)], "recommendation string"))
    got = {r["check"]: (r["status"], r["observed"]) for r in some.collect()}
    assert got["calibration"] == ("block", "completed_calibration_rows=2; completed_calibration_labels=2; calibration_rows=3")
    assert got["manual_validation"] == ("block", "completed_manual_labels=0; total_rows=4; remaining_manual_labels=4") and got["adjudication"][0] == "block"
    assert tuple(J.gate(some).first()) == ("blocked_calibration", "calibration", 5)


SCHEMA = "article_id string, enrichment_status string, enriched_abstract string, attempted_sources string"


def files(root):
    return {(d, f): os.path.getmtime(f"{d}/{f}") for d, _, names in os.walk(f"{root}/state") for f in names if f.endswith(".parquet")}


def test_a_batch_touches_its_partitions_once(spark, tmp_path):
    root = str(tmp_path / "s")
    row = lambda i, s, t="x": (str(i), s, t, "a")
    first = spark.createDataFrame([row(i, "not_found") for i in range(40)], SCHEMA)
    second = spark.createDataFrame([row(3, "enriched", "text"), row(99, "error")], SCHEMA)
    assert Z.read_state(spark, root, SCHEMA).count() == 0 and Z.batches(spark, root).count() == 0
    assert Z.apply_batch(root, first, 1, E.upsert_enrichment, SCHEMA, partitions=8)
    before = files(root)
    assert Z.apply_batch(root, second, 2, E.upsert_enrichment, SCHEMA, partitions=8)
    after = files(root)
    parts = {r[0] for r in second.select(F.pmod(F.xxhash64("article_id"), F.lit(8))).collect()}
    changed = {d for d, _ in set(before) ^ set(after)}
    assert {int(d.rsplit("=", 1)[1]) for d in changed} == parts and all(before[k] == after[k] for k in set(before) & set(after))
    want = E.upsert_enrichment(first, second).select("article_id", "enrichment_status", "enriched_abstract", "attempted_sources")
    state = lambda: sorted(map(tuple, Z.read_state(spark, root, SCHEMA).collect()))
    assert state() == sorted(map(tuple, want.collect()))
    assert not Z.apply_batch(root, second, 2, E.upsert_enrichment, SCHEMA, partitions=8) and files(root) == after
    assert Z.apply_batch(root, second, "again, as if the ledger had missed it", E.upsert_enrichment, SCHEMA, partitions=8) and state() == sorted(map(tuple, want.collect()))
    assert Z.apply_batch(root, second.limit(0), 4, E.upsert_enrichment, SCHEMA, partitions=8)
    assert {(r["batch_id"], r["rows"]) for r in Z.batches(spark, root).collect()} == {("1", 40), ("2", 2), ("again, as if the ledger had missed it", 2), ("4", 0)}
    keyed_sink(root, [F.desc("enrichment_status")], SCHEMA, 8)(second.unionByName(spark.createDataFrame([row(99, "pdf_candidate")], SCHEMA)), 5)
    assert dict((r[0], r[1]) for r in state())["99"] == "pdf_candidate"


def test_log_by_batches(spark, tmp_path):
    root, schema = str(tmp_path / "log"), "article_id string, note string"
    rows = spark.createDataFrame([("1", "a"), ("1", "a"), ("2", "b")], schema)
    Z.apply_batch(root, rows, "x", E.append_log, schema, partitions=4)
    Z.apply_batch(root, rows.where("article_id = '1'").unionByName(spark.createDataFrame([("1", "c")], schema)), "y", E.append_log, schema, partitions=4)
    assert sorted(map(tuple, Z.read_state(spark, root, schema).collect())) == [("1", "a"), ("1", "c"), ("2", "b")]


def test_a_duplicate_id_stops_the_job(spark):
    batch = spark.createDataFrame([("1", "R1"), ("2", "R1")], "article_id string, recovery_batch string")
    context = spark.createDataFrame([("1", "w"), ("1", "w2")], "article_id string, row_status string")
    good = W.batch_with_context(batch, context, context.select("article_id", F.col("row_status").alias("article_scope")), context.select("article_id", F.col("row_status").alias("seen")))
    assert good.count() == 2 and good.where("article_id = '1'").first()["row_status"] == "w"
    twice = W.batch_with_context(batch.unionByName(batch.limit(1)), context, context, context)
    with pytest.raises(Exception, match="duplicate article_id after merge"):
        twice.collect()
    with pytest.raises(Exception, match="duplicate article_id after merge"):
        twice.select("recovery_batch").count()


def test_page_accounts(spark, tmp_path):
    page = {"metadata": {"journal_short": "aer"}, "response": {"message": {"items": [{"DOI": "10.1/a", "title": ["T"]}, {"DOI": "10.1/b", "title": ["U"]}]}}}
    texts = {"x_page_1.json": json.dumps(page), "x_page_2.json": json.dumps(page)[:-20], "x_page_3.json": "{}", "x_page_4_error.json": '{"status": 500}', "x_page_5.json": json.dumps({"response": {"message": {"items": []}}}), "x_page_6.json": '{"response": 7}'}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    accounts = pages.page_accounts(spark, str(tmp_path))
    got = {r["source_file"].rsplit("/", 1)[1]: (r["page_status"], r["items"]) for r in accounts.collect()}
    assert got == {"x_page_1.json": ("ok", 2), "x_page_2.json": ("malformed", 0), "x_page_3.json": ("no_items", 0), "x_page_4_error.json": ("error_page", 0), "x_page_5.json": ("ok", 0), "x_page_6.json": ("malformed", 0)}
    assert {r["source_file"].rsplit("/", 1)[1]: bool(r["unread_text"]) for r in pages.quarantined(accounts).collect()} == {"x_page_2.json": True, "x_page_3.json": False, "x_page_6.json": True}
    assert pages.crossref_records(spark, str(tmp_path), 1975, 2025).count() == accounts.agg(F.sum("items")).first()[0]
    assert pages.page_accounts(spark, str(tmp_path), "openalex").where("page_status = 'ok'").count() == 0


def test_pages_held_as_text(spark):
    whole = '{"metadata":{"journal_short":"aer"},"response":{"message":{"items":[{"DOI":"10.1/A","title":["","T"],"issued":{"date-parts":[[2001]]}},{"DOI":null,"title":[]}]}}}'
    raw = spark.createDataFrame([("a.json", whole), ("b.json", whole[:70]), ("c.json", '{"response":{"message":{}}}'), ("d.json", ""), ("e.json", None), ("f_error.json", whole), ("g.json", "[]"), ("h.json", '{"response":{"message":{"items":[]}}}')], "source_file string, body string")
    read = pages.parsed_pages(raw)
    got = {r["source_file"]: (r["page_status"], r["items"]) for r in pages.parsed_page_accounts(read).collect()}
    assert got.pop("g.json")[1] == 0
    assert got == {"a.json": ("ok", 2), "b.json": ("malformed", 0), "c.json": ("no_items", 0), "d.json": ("no_items", 0), "e.json": ("no_items", 0), "f_error.json": ("error_page", 0), "h.json": ("ok", 0)}
    rows = pages.crossref_items(read.where("source_file = 'a.json'"), 1990, 2010).orderBy("item_no").collect()
    assert [(r["doi"], r["title"], r["publication_date"], r["abstract"]) for r in rows] == [("10.1/a", "T", "2001-01-01", ""), ("", "", "", "")]
    assert pages.parsed_page_accounts(pages.parsed_pages(raw.limit(0), "openalex"), "openalex").count() == 0
