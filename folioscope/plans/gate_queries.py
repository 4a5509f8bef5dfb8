"""Queries over labels as a validation sample: readiness, checks and gate; the enrichment state kept by key; records checked for single ids."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from folioscope.checkpoints import checkpoint_dir
from folioscope.functions import text as T
from folioscope.operators import enrich as E
from folioscope.operators import gate as J
from folioscope.operators import labels as L
from folioscope.operators import state as Z
from folioscope.plans import record_queries as RQ
from folioscope.plans.bindings import SQL as B
from folioscope.plans.bindings import articles, table, validation


def _sample(spark, sf_dir):
    a = articles(spark, sf_dir).select("article_id", "abstract", "article_scope", F.col("journal_short").alias("batch_id"), F.col("article_type").alias("validation_category"))
    return validation(spark, sf_dir).join(a, "article_id")


def _readiness(spark, sf_dir):
    sample = _sample(spark, sf_dir)
    done = T.present("manual_label")
    batches = sample.groupBy("batch_id").agg(F.count_if(done).alias("completed_manual_labels"), F.count_if(~done).alias("remaining_manual_labels"))
    now = articles(spark, sf_dir).select("article_id", F.when(F.length("title") % 50 == 0, "changed").otherwise(F.col("article_scope")).alias("article_scope"))
    return J.readiness(sample, L.drift(sample.select("validation_id", "article_id", "article_scope"), now, ["article_scope"]), batches)


def readiness(spark, sf_dir):
    return _readiness(spark, sf_dir)


def validation_checks(spark, sf_dir):
    sample, talks, given = _sample(spark, sf_dir), table(spark, sf_dir, "conversations"), table(spark, sf_dir, "labels")
    done = T.present("manual_label")
    completion = J.counted(sample, {"total_rows": F.lit(True), "completed_manual_labels": done, "remaining_manual_labels": ~done})
    calibration = J.counted(talks, {"calibration_rows": F.col("turn") == 0, "completed_calibration_labels": F.length("text") % 2 == 0})
    overlap = J.counted(given, {"overlap_rows": F.col("quality") == 1, "completed_overlap_labels": (F.col("quality") == 1) & (F.col("toxic") == 0)})
    wanted = given.agg(F.when(F.avg("quality") > 0.5, "proceed").otherwise("pause").alias("recommendation"))
    return J.validation_checks(_readiness(spark, sf_dir), completion, calibration, overlap, validation(spark, sf_dir).where("adjudicated_label <> ''"), wanted)


def validation_gate(spark, sf_dir):
    return J.gate(validation_checks(spark, sf_dir))


def upsert_by_batches(spark, sf_dir):
    """upsert_enrichment with the state kept in partitions: one batch for each side, the second handed in twice."""
    root = f"{checkpoint_dir(spark)}/state-{uuid.uuid4().hex}"
    first, second = RQ._state(spark, sf_dir, 1), RQ._state(spark, sf_dir, 2)
    schema = ", ".join(f"{c} string" for c in second.columns)
    for n, rows in (("0", first), ("1", second), ("1", second)):
        Z.apply_batch(root, rows, n, E.upsert_enrichment, schema, partitions=16)
    return Z.read_state(spark, root, schema).drop("enrichment_detail", "article_scope_reason").withColumn("enriched_abstract", F.md5(F.col("enriched_abstract").cast("binary")))


QUERIES = {f.__name__: f for f in (readiness, validation_checks, validation_gate, upsert_by_batches)}

_READY = f"""WITH {B["articles"]}, {B["validation"]}, sample AS (SELECT v.*, a.abstract, a.article_scope, a.title, a.journal_short AS batch_id, a.article_type AS validation_category, manual_label <> '' AS done FROM validation v JOIN articles a USING (article_id)),
drifted AS (SELECT article_id FROM sample WHERE length(title) % 50 = 0 AND article_scope <> 'changed'),
per AS (SELECT batch_id, count(*) FILTER (done) AS d, count(*) FILTER (NOT done) AS l FROM sample GROUP BY 1),
ready AS (SELECT 'sample_rows' AS metric, CAST(count(*) AS VARCHAR) AS value FROM sample UNION ALL SELECT 'completed_manual_labels', CAST(count(*) FILTER (done) AS VARCHAR) FROM sample UNION ALL SELECT 'remaining_manual_labels', CAST(count(*) FILTER (NOT done) AS VARCHAR) FROM sample
 UNION ALL SELECT 'sample_missing_abstract_rows', CAST(count(*) FILTER (regexp_matches(abstract, '^\\s*$')) AS VARCHAR) FROM sample
 UNION ALL SELECT 'sample_validation_category_' || coalesce(validation_category, ''), CAST(count(*) AS VARCHAR) FROM sample GROUP BY 1 UNION ALL SELECT 'sample_article_scope_' || article_scope, CAST(count(*) AS VARCHAR) FROM sample GROUP BY 1
 UNION ALL SELECT 'drifted_articles', CAST(count(DISTINCT article_id) AS VARCHAR) FROM drifted UNION ALL SELECT 'drifted_cells', CAST(count(*) AS VARCHAR) FROM drifted
 UNION ALL SELECT 'reviewer_batches', CAST(count(*) AS VARCHAR) FROM per UNION ALL SELECT 'completed_reviewer_batches', CAST(count(*) FILTER (l = 0) AS VARCHAR) FROM per UNION ALL SELECT 'started_reviewer_batches', CAST(count(*) FILTER (d > 0) AS VARCHAR) FROM per
 UNION ALL SELECT 'next_incomplete_batch', coalesce(min(batch_id) FILTER (l > 0), '') FROM per UNION ALL SELECT 'ready_for_blind_review', CASE WHEN (SELECT count(*) FROM sample) > 0 AND (SELECT count(*) FROM drifted) = 0 THEN 'yes' ELSE 'no' END)"""
_CHECKS = f"""{_READY}, n AS (SELECT (SELECT count(*) FROM sample) AS total, (SELECT count(*) FROM sample WHERE done) AS done, (SELECT count(DISTINCT article_id) FROM drifted) AS dr, (SELECT count(*) FROM conversations WHERE turn = 0) AS cr, (SELECT count(*) FROM conversations WHERE length(text) % 2 = 0) AS cl,
 (SELECT count(*) FROM labels WHERE quality = 1) AS o, (SELECT count(*) FROM labels WHERE quality = 1 AND toxic = 0) AS ol, (SELECT count(*) FROM validation WHERE adjudicated_label <> '') AS a, (SELECT CASE WHEN avg(quality) > 0.5 THEN 'proceed' ELSE 'pause' END FROM labels) AS rec, (SELECT value FROM ready WHERE metric = 'ready_for_blind_review') AS rd),
checks AS (SELECT 0 AS ord, 'sample_readiness' AS "check", CASE WHEN rd = 'yes' AND dr = 0 THEN 'pass' ELSE 'block' END AS status, 'ready_for_blind_review=' || rd || '; drifted_articles=' || dr AS observed FROM n
 UNION ALL SELECT 1, 'calibration', CASE WHEN cr > 0 AND cl >= cr THEN 'pass' ELSE 'block' END, 'completed_calibration_rows=' || cl || '; completed_calibration_labels=' || cl || '; calibration_rows=' || cr FROM n
 UNION ALL SELECT 2, 'manual_validation', CASE WHEN total > 0 AND done >= total THEN 'pass' ELSE 'block' END, 'completed_manual_labels=' || done || '; total_rows=' || total || '; remaining_manual_labels=' || (total - done) FROM n
 UNION ALL SELECT 3, 'overlap_review', CASE WHEN o <= 0 THEN 'not_applicable' WHEN ol >= o THEN 'pass' ELSE 'block' END, 'completed_overlap_labels=' || ol || '; overlap_rows=' || o FROM n
 UNION ALL SELECT 4, 'adjudication', CASE WHEN a = 0 THEN 'not_applicable' ELSE 'pass' END, 'completed_adjudications=' || a || '; pending_adjudication_rows=' || a FROM n
 UNION ALL SELECT 5, 'classification_recommendation', CASE WHEN rec = 'proceed' THEN 'pass' ELSE 'block' END, 'recommendation=' || rec FROM n)"""

SQL = {
    "readiness": f"{_READY} SELECT * FROM ready",
    "validation_checks": f"{_CHECKS} SELECT * FROM checks",
    "validation_gate": f"""{_CHECKS} SELECT coalesce('blocked_' || arg_min("check", ord) FILTER (status = 'block'), 'proceed') AS validation_gate, coalesce(arg_min("check", ord) FILTER (status = 'block'), '') AS first_blocking_check, count(*) FILTER (status = 'block') AS blocking_checks FROM checks""",
    "upsert_by_batches": RQ.SQL["upsert_enrichment"],
}
