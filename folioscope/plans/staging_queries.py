"""Queries over reviewers' exports: staging, progress, the rows to begin with. Documents are the exports, their text the one handed in."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.operators import staging as G
from folioscope.plans import sqltext as Q
from folioscope.plans.bindings import articles, table
from folioscope.plans.recovery_queries import _SPLIT, _split_rows

_TIERS = "'tier_a_formal_abstract', 'tier_b_source_description', '', 'tier_d_title_only_triage', 'tier_a_formal_abstract'"


def _exports(spark, sf_dir):
    """Every document as a row of one file, every labelled one as a row of a second."""
    a = articles(spark, sf_dir).selectExpr(
        "'a.csv' as source_file", "cast(article_id as long) + 2 as row_number", "article_id", "if(cast(article_id as long) % 11 = 0, 'ready_manual_metadata', '') as split_group",
        "case cast(article_id as long) % 7 when 0 then '' when 1 then concat(abstract, ' more') when 2 then concat('so ', abstract) when 3 then abstract else title end as abstract",
        "if(cast(article_id as long) % 3 = 0, '', 'econlit') as source", "'' as source_url", "if(cast(article_id as long) % 4 = 0, concat('r', article_id), '') as source_record_id", f"element_at(array({_TIERS}), cast(cast(article_id as long) % 5 as int) + 1) as evidence_tier", "'' as notes",
    )
    b = table(spark, sf_dir, "labels").selectExpr("'b.csv' as source_file", "cast(doc_id as long) + 2 as row_number", "cast(doc_id as string) as article_id", "'' as split_group", "repeat('Handed in once more. ', 500) as abstract", "'library' as source", "'https://example.org/b' as source_url", "'' as source_record_id", "'tier_a_formal_abstract' as evidence_tier", "'seen' as notes")
    return a.unionByName(b)


def _checked(spark, sf_dir, texts=True):
    base = _split_rows(spark, sf_dir).withColumn("current_abstract_chars", F.col("current_text_chars"))
    imported = table(spark, sf_dir, "conversations").selectExpr("cast(conv_id as string) as article_id")
    return G.check_exports(base, _exports(spark, sf_dir), imported, texts=texts)


def export_check(spark, sf_dir):
    return _checked(spark, sf_dir).select("source_file", "row_number", "article_id", "split_group", "outcome", "error", "staged_fields", F.md5(F.col("abstract").cast("binary")).alias("abstract_md5"))


def _packet(spark, sf_dir):
    return articles(spark, sf_dir).selectExpr(
        "article_id", "cast(cast(article_id as long) * 7 % 1009 as string) as review_rank", "journal_short as action_group", f"element_at(array({', '.join(repr(t) for t in [*G.KICKOFF_TIERS, ''])}), cast(length(title) % 6 as int) + 1) as quick_win_tier",
        "if(length(title) % 4 = 0, '', cast(length(title) % 9 as string)) as cell_target_rank", "element_at(array('critical', 'high', ''), cast(length(title) % 3 as int) + 1) as cell_target_level", "cast(length(title) % 5 as string) as cell_recoveries_to_target_share", "title",
    )


def _progress(spark, sf_dir):
    checked = _checked(spark, sf_dir, False)
    failed = table(spark, sf_dir, "labels").where("toxic = 1").selectExpr("cast(doc_id as string) as article_id")
    return G.action_progress(_packet(spark, sf_dir), _exports(spark, sf_dir), checked.where("outcome = 'staged'"), checked.where("outcome = 'error' and source_file = 'a.csv'"), failed)


def action_progress(spark, sf_dir):
    return _progress(spark, sf_dir).select("article_id", "export_row_count", "exported_files", "duplicate_export_rows", "exported_has_abstract", "exported_source_ready", "exported_importable_evidence_tier", "exported_ready_candidate", "staged", "stage_error_rows", "preflight_error_rows", "import_ready", "next_status")


def action_summary(spark, sf_dir):
    return G.progress_summary(_progress(spark, sf_dir))


def action_metrics(spark, sf_dir):
    return G.progress_metrics(G.progress_summary(_progress(spark, sf_dir)))


def kickoff(spark, sf_dir):
    return G.kickoff(_progress(spark, sf_dir), _packet(spark, sf_dir), 20).select("kickoff_rank", "article_id", "action_group", "quick_win_tier")


QUERIES = {f.__name__: f for f in (export_check, action_progress, action_summary, action_metrics, kickoff)}

_C = {c: Q.clean(c) for c in G.EDITABLE}
_EXPORTS = f"""{_SPLIT}, exports AS (SELECT 'a.csv' AS source_file, CAST(article_id AS BIGINT) + 2 AS row_number, article_id, CASE WHEN CAST(article_id AS BIGINT) % 11 = 0 THEN 'ready_manual_metadata' ELSE '' END AS split_group,
  CASE CAST(article_id AS BIGINT) % 7 WHEN 0 THEN '' WHEN 1 THEN abstract || ' more' WHEN 2 THEN 'so ' || abstract WHEN 3 THEN abstract ELSE title END AS abstract, CASE WHEN CAST(article_id AS BIGINT) % 3 = 0 THEN '' ELSE 'econlit' END AS source, '' AS source_url,
  CASE WHEN CAST(article_id AS BIGINT) % 4 = 0 THEN 'r' || article_id ELSE '' END AS source_record_id, [{_TIERS}][CAST(article_id AS BIGINT) % 5 + 1] AS evidence_tier, '' AS notes FROM articles
  UNION ALL SELECT 'b.csv', CAST(doc_id AS BIGINT) + 2, CAST(doc_id AS VARCHAR), '', repeat('Handed in once more. ', 500), 'library', 'https://example.org/b', '', 'tier_a_formal_abstract', 'seen' FROM labels),
base AS (SELECT article_id AS id, split_group AS g, {Q.clean("abstract")} AS now_, chars, {Q.clean("filled")} AS b_abstract, filled_source AS b_source, article_url AS b_source_url, '' AS b_source_record_id, {Q.clean("tier")} AS b_evidence_tier, '' AS b_notes FROM split),
given AS (SELECT source_file, row_number AS rn, article_id, split_group, {", ".join(f"{v} AS {c}" for c, v in _C.items())} FROM exports),
new AS (SELECT *, {", ".join(f"CASE WHEN {c} <> '' THEN {c} ELSE coalesce(b_{c}, '') END AS n_{c}" for c in G.EDITABLE)} FROM given LEFT JOIN base ON id = article_id),
facts AS (SELECT *, g = 'ready_partial_text_extension' AS part, n_source <> '' AND (n_source_url <> '' OR n_source_record_id <> '') AS named, article_id IN (SELECT CAST(conv_id AS VARCHAR) FROM conversations) AS done FROM new),
judged AS (SELECT *, CASE WHEN done THEN '-' WHEN id IS NULL THEN 'tiered_row_not_in_ready_split' WHEN g = 'other_manual_review' THEN 'tiered_row_not_stageable' WHEN split_group <> '' AND split_group <> g THEN 'tiered_split_group_mismatch'
  WHEN part AND abstract <> '' AND abstract = now_ THEN '-' WHEN NOT (named OR abstract <> '' AND (part AND abstract <> now_ OR abstract <> b_abstract) OR source || source_url || source_record_id <> '') THEN '-' WHEN n_abstract = '' THEN 'missing_staged_abstract' WHEN NOT named THEN 'missing_staged_source_provenance'
  WHEN n_evidence_tier = '' THEN 'missing_evidence_tier' WHEN n_evidence_tier IN ('tier_d_title_only_triage', 'tier_e_blocked') THEN 'unimportable_evidence_tier' WHEN n_evidence_tier NOT IN ('tier_a_formal_abstract', 'tier_b_source_description', 'tier_c_first_page_abstract_or_intro') THEN 'invalid_evidence_tier'
  WHEN part AND (now_ <> '' AND n_abstract = now_ OR chars <> 0 AND length(n_abstract) <= chars) THEN 'partial_text_not_extended' ELSE '' END AS e FROM facts),
placed AS (SELECT *, count(*) FILTER (e = '') OVER (PARTITION BY article_id ORDER BY source_file, rn) AS k FROM judged),
checked AS (SELECT source_file, rn AS row_number, article_id, coalesce(g, split_group) AS split_group, CASE WHEN e = '-' THEN 'skipped' WHEN e <> '' OR k > 1 THEN 'error' ELSE 'staged' END AS outcome, CASE WHEN e = '-' THEN '' WHEN e = '' AND k > 1 THEN 'duplicate_completed_tiered_row' ELSE e END AS error,
  CASE WHEN e = '' AND k = 1 THEN array_to_string(list_filter([{", ".join(f"CASE WHEN n_{c} <> b_{c} THEN '{c}' END" for c in G.EDITABLE)}], lambda v: v IS NOT NULL), '|') ELSE '' END AS staged_fields, md5(CASE WHEN e = '' AND k = 1 THEN n_abstract ELSE '' END) AS abstract_md5 FROM placed)"""
_PROGRESS = f"""{_EXPORTS}, packet AS (SELECT article_id, CAST(article_id AS BIGINT) * 7 % 1009 AS rr, journal_short AS action_group, [{', '.join(repr(t) for t in [*G.KICKOFF_TIERS, ''])}][length(title) % 6 + 1] AS quick_win_tier, CASE WHEN length(title) % 4 = 0 THEN NULL ELSE length(title) % 9 END AS ctr, length(title) % 3 = 0 AS critical, length(title) % 5 AS need FROM articles),
flagged AS (SELECT *, {Q.collapse("abstract")} <> '' AS f1, source <> '' AND (source_url <> '' OR source_record_id <> '') AS f2, evidence_tier IN ('tier_a_formal_abstract', 'tier_b_source_description', 'tier_c_first_page_abstract_or_intro') AS f3 FROM exports),
handed AS (SELECT article_id, count(*) AS n, string_agg(DISTINCT source_file, '|' ORDER BY source_file) AS files, bool_or(f1) AS f1, bool_or(f2) AS f2, bool_or(f3) AS f3, bool_or(f1 AND f2 AND f3) AS f4 FROM flagged GROUP BY 1),
detail AS (SELECT p.*, coalesce(n, 0) AS n, coalesce(files, '') AS files, coalesce(f1, false) AS f1, coalesce(f2, false) AS f2, coalesce(f3, false) AS f3, coalesce(f4, false) AS f4, (SELECT count(*) FROM checked c WHERE c.article_id = p.article_id AND outcome = 'staged') > 0 AS st,
  (SELECT count(*) FROM checked c WHERE c.article_id = p.article_id AND outcome = 'error' AND source_file = 'a.csv') AS se, (SELECT count(*) FROM labels WHERE toxic = 1 AND CAST(doc_id AS VARCHAR) = p.article_id) AS pe FROM packet p LEFT JOIN handed USING (article_id)),
progress AS (SELECT *, CASE WHEN se > 0 THEN 'fix_stage_errors' WHEN pe > 0 THEN 'fix_preflight_errors' WHEN st THEN 'ready_to_import' WHEN f4 THEN 'run_stage_and_preflight' WHEN n > 0 THEN 'complete_export_fields' ELSE 'not_started' END AS next_status FROM detail),
ordered AS (SELECT *, list_position([{', '.join(repr(s) for s in G.STATUSES)}], next_status) AS o FROM progress),
groups AS (SELECT action_group, count(*) AS rows_total, count(*) FILTER (need > 0) AS priority_cell_rows, count(*) FILTER (critical) AS critical_cell_rows, CAST(min(ctr) AS INTEGER) AS top_cell_target_rank, count(*) FILTER (n > 0) AS exported_rows, count(*) FILTER (f4) AS exported_ready_candidates, count(*) FILTER (st) AS staged_rows, count(*) FILTER (next_status = 'ready_to_import') AS import_ready_rows,
  CAST(sum(se) AS BIGINT) AS stage_error_rows, CAST(sum(pe) AS BIGINT) AS preflight_error_rows, CAST(sum(greatest(n - 1, 0)) AS BIGINT) AS duplicate_export_rows, count(*) FILTER (n = 0) AS remaining_unexported_rows, count(*) FILTER (next_status <> 'ready_to_import') AS remaining_not_import_ready_rows, CAST(min(rr) AS INTEGER) AS first_review_rank, [{', '.join(repr(s) for s in G.STATUSES)}][min(o)] AS next_status FROM ordered GROUP BY 1)"""
_ADDED = ["rows_total", "priority_cell_rows", "critical_cell_rows", "exported_rows", "import_ready_rows", "remaining_not_import_ready_rows", "stage_error_rows", "preflight_error_rows", "duplicate_export_rows"]

SQL = {
    "export_check": f"{_EXPORTS} SELECT * FROM checked",
    "action_progress": f"""{_PROGRESS} SELECT article_id, n AS export_row_count, files AS exported_files, greatest(n - 1, 0) AS duplicate_export_rows, f1 AS exported_has_abstract, f2 AS exported_source_ready, f3 AS exported_importable_evidence_tier, f4 AS exported_ready_candidate, st AS staged,
 se AS stage_error_rows, pe AS preflight_error_rows, next_status = 'ready_to_import' AS import_ready, next_status FROM progress""",
    "action_summary": f"{_PROGRESS} SELECT * FROM groups",
    "action_metrics": f"""{_PROGRESS} SELECT 'action_groups' AS metric, CAST(count(*) AS VARCHAR) AS value FROM groups {" ".join(f"UNION ALL SELECT '{c}', CAST(CAST(sum({c}) AS BIGINT) AS VARCHAR) FROM groups" for c in _ADDED)}
 UNION ALL SELECT 'next_status', [{', '.join(repr(s) for s in G.STATUSES)}][min(list_position([{', '.join(repr(s) for s in G.STATUSES)}], next_status))] FROM groups""",
    "kickoff": f"""{_PROGRESS} SELECT CAST(row_number() OVER (ORDER BY o, se DESC, pe DESC, coalesce(list_position([{', '.join(repr(t) for t in G.KICKOFF_TIERS)}], quick_win_tier), 99), need <= 0, coalesce(ctr, 999999), rr, article_id) AS INTEGER) AS kickoff_rank, article_id, action_group, quick_win_tier FROM ordered ORDER BY 1 LIMIT 20""",
}
