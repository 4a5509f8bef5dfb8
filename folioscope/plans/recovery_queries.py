"""Queries over the recovery queue, scopes and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions import page as P
from folioscope.functions import text as T
from folioscope.operators import packets as K
from folioscope.operators import recovery as V
from folioscope.operators import routing as R
from folioscope.operators import scope as O
from folioscope.operators import shares as S
from folioscope.operators import staging as G
from folioscope.operators.attempts import FAILED
from folioscope.plans import sqltext as Q
from folioscope.plans.article_queries import SQL as A
from folioscope.plans.article_queries import classified
from folioscope.plans.bindings import SQL as B
from folioscope.plans.bindings import RULES, articles, records, table
from folioscope.plans.record_queries import PRIOR, attempts

PATTERNS = [("comment_reply", r"^the\b"), ("review_erratum_paratext", r"\band\b.*\bof\b"), ("lecture_address", r"^a\b")]


def _queue(spark, sf_dir):
    return V.recovery_queue(classified(spark, sf_dir))


def expansion_plan(spark, sf_dir):
    return R.expansion_plan(R.prepared(_queue(spark, sf_dir)))


def lane_overview(spark, sf_dir):
    return R.lane_overview(R.prepared(_queue(spark, sf_dir)))


def prefix_plan(spark, sf_dir):
    return R.prefix_plan(R.prepared(_queue(spark, sf_dir)), attempts(spark, sf_dir))


def decision_plan(spark, sf_dir):
    return R.decision_plan(R.prepared(_queue(spark, sf_dir)), attempts(spark, sf_dir))


def _routes(spark, sf_dir, queue=None):
    """Pages as probes of the decisions."""
    probes = table(spark, sf_dir, "pages").selectExpr(f"element_at(array({', '.join(repr(u) for u in _PROBED)}), cast(page_id % {len(_PROBED)} as int) + 1) as decision_unit", "element_at(array('not_found', 'http_error', 'abstract_found'), cast(length(html) % 3 as int) + 1) as outcome")
    return R.route_matrix(R.decision_plan(R.prepared(queue or _queue(spark, sf_dir)), attempts(spark, sf_dir)), probes.where("decision_unit <> '10.1086' or outcome <> 'abstract_found'"))


_PROBED = ["10.1257", "10.1086", "10.1111", "oa_pdf_review"]


def route_matrix(spark, sf_dir):
    return _routes(spark, sf_dir).select("decision_unit", "unit_type", "decision", "probe_rows", "probe_abstract_found_rows", "current_route_status")


def workplan(spark, sf_dir):
    """Status and split group of each queue row, with the route of its DOI prefix or else of its action."""
    q = _queue(spark, sf_dir).withColumn("n", T.number("article_id").cast("long"))
    scope = F.when(F.col("n") % 5 == 1, "comment_reply").otherwise("")
    pdf = F.element_at(F.array(F.lit("extracted"), F.lit("too_short"), F.lit("")), (F.col("n") % 3 + 1).cast("int"))
    decided = F.element_at(F.array(F.lit(""), F.lit("exclude_nonresearch"), F.lit("unsure"), F.lit(""), F.lit("keep"), F.lit("")), (F.col("n") % 6 + 1).cast("int"))
    work = G.with_route(q, _routes(spark, sf_dir, q)).withColumn("row_status", R.row_workflow(decided, scope, F.lit(False), F.col("recovery_action"), pdf, T.text("current_route_status"), F.col("oa_pdf_url")))
    return work.select("article_id", F.coalesce("current_route_status", F.lit("")).alias("route_status"), "row_status", R.split_group("row_status").alias("split_group"))


def _split_rows(spark, sf_dir):
    """Documents as split rows: what follows the title line is the text that is there, and for some also the one that was filled in."""
    group = "element_at(array('ready_partial_text_extension', 'ready_manual_metadata', 'other_manual_review'), cast(cast(article_id as long) % 3 as int) + 1)"
    return articles(spark, sf_dir).selectExpr(
        "cast(article_id as long) as row_number", "article_id", "title", "doi", "journal_short", "publication_year", f"{group} as split_group", "concat('R00', cast(article_id as long) % 4) as recovery_batch",
        "if(cast(article_id as long) % 4 = 1, 'pdf_route_blocked_use_manual_metadata', 'manual_extend_partial_text') as row_status", "cast(length(abstract) as string) as current_text_chars", "abstract as current_abstract", "abstract_source as current_abstract_source",
        "if(cast(article_id as long) % 5 = 2, abstract, '') as abstract", "if(cast(article_id as long) % 5 = 2, 'crossref', '') as source", "article_url as source_url", "'' as source_record_id", "text_enrichment_evidence_tier as evidence_tier", "text_enrichment_status", "'' as has_usable_classification_text", "article_id as recovery_rank",
    )


def review_queue(spark, sf_dir):
    return R.review_queue(_split_rows(spark, sf_dir), texts=False).select("review_rank", "article_id", "completion_status", "review_stage", "quick_win_tier", "source_route_family", "chars_needed_to_threshold", "current_text_quality_flag")


def automation_rows(spark, sf_dir):
    """Review rows with the route of their DOI or family and their automation status."""
    q = G.with_review_route(R.review_queue(_split_rows(spark, sf_dir), texts=False), _routes(spark, sf_dir))
    status = R.automation_status(F.col("completion_status"), F.col("quick_win_tier"), F.col("current_text_quality_flag"), F.col("source_route_family"), F.col("row_status"), T.text("current_route_status"), T.text("decision"))
    return q.withColumn("automation_status", status)


def automation(spark, sf_dir):
    return automation_rows(spark, sf_dir).select("article_id", T.text("current_route_status").alias("route_status"), "automation_status")


def import_preflight(spark, sf_dir):
    return R.import_preflight(_split_rows(spark, sf_dir), articles(spark, sf_dir))[0]


def action_rows(spark, sf_dir, whole=True):
    """Evidence rows with what stands beside them; not whole: without cells and automation, which are worked out for all of the queue."""
    q = R.review_queue(_split_rows(spark, sf_dir), texts=False).withColumn("decade", T.decade("publication_year"))
    beside = (cell_targets(spark, sf_dir), automation(spark, sf_dir)) if whole else ()
    return R.action_packet(_evidence(spark, sf_dir), q, *beside)


def action_packet(spark, sf_dir):
    return action_rows(spark, sf_dir).select("article_id", "cached_evidence_status", "evidence_tier_suggestion", "quick_win_tier", "cell_target_rank", "action_group")


def candidate_urls(spark, sf_dir):
    a = articles(spark, sf_dir).withColumn("url", F.concat(F.lit("https://"), F.element_at(F.array(F.lit("econpapers.example/"), F.lit("www.aeaweb.org/articles?id="), F.lit("example.org/")), (F.length("title") % 3 + 1).cast("int")), F.col("article_id")))
    return a.select("article_id", F.array_join(T.repec_urls("url", "doi", F.lit("JPE")), "|").alias("index_urls"), F.array_join(T.publisher_urls("url", "doi"), "|").alias("publisher_urls"))


def _histories(spark, sf_dir):
    """Imports and errors of batches by file name: attempts that found something, and those that failed."""
    name = "if(event_id % 2 = 0, concat('x/insufficient_text_recovery_batch_R00', event_id % 5, '_done.csv'), concat('recovery_R00', event_id % 5, '.csv')) as import_source_file"
    rows = attempts(spark, sf_dir).selectExpr(name, "attempt_status")
    return rows.where("attempt_status = 'found'"), rows.where("attempt_status = 'error'")


def batch_progress(spark, sf_dir):
    return R.batch_progress(_split_rows(spark, sf_dir), *_histories(spark, sf_dir))


def progress_overview(spark, sf_dir):
    rows, (imported, errors) = _split_rows(spark, sf_dir), _histories(spark, sf_dir)
    return R.progress_overview(R.batch_progress(rows, imported, errors), rows.withColumn("recovery_rank", F.col("row_number")), imported, errors)


def review_summary(spark, sf_dir):
    return K.queue_summary(R.review_queue(_split_rows(spark, sf_dir), texts=False), ["recovery_batch", "review_stage", "quick_win_tier", "split_group", "row_status"])


def tier_summary(spark, sf_dir):
    return R.ranked_summary(R.review_queue(_split_rows(spark, sf_dir), texts=False), ["source_route_family"], ["quick_win_tier"])


def review_guide(spark, sf_dir):
    return K.review_guide(articles(spark, sf_dir), RULES).select("article_id", "abstract_chars", "guide_text_chars", "text_status", "cue_profile", "review_difficulty", "causal_cue_terms", "predictive_cue_terms")


def cell_targets(spark, sf_dir):
    c = classified(spark, sf_dir)
    wide = c.withColumn("causal_predictive_category", F.when(F.length("abstract") < 2000, "insufficient_text").otherwise(F.col("causal_predictive_category")))
    queue = V.recovery_queue(wide)
    return V.cell_targets(S.insufficient_profile(wide), queue, queue.where("oa_pdf_url <> ''").withColumn("review_rank", F.col("recovery_rank")), 3).drop("first_recovery_rank", "first_ready_review_rank")


def packet_rows(spark, sf_dir):
    return R.packets(V.recovery_queue(classified(spark, sf_dir), None, 10)).select("recovery_batch", "packet_row", "article_id")


def scope_candidates(spark, sf_dir):
    return O.scope_candidates({"articles": articles(spark, sf_dir)}, {"es": "lecture_address"}, PATTERNS).select("article_id", "current_scope", "proposed_scope", "proposed_reason", "decade")


def scope_summary(spark, sf_dir):
    return O.candidate_summary(O.scope_candidates({"articles": articles(spark, sf_dir)}, {"es": "lecture_address"}, PATTERNS))


def scope_decisions(spark, sf_dir):
    a = articles(spark, sf_dir)
    packet = O.scope_candidates({"articles": a}, {"es": "lecture_address"}, PATTERNS).selectExpr("article_id", "proposed_scope", "element_at(array('exclude_from_research_scope', 'keep_as_research', 'unsure', 'maybe'), cast(cast(article_id as int) % 4 as int) + 1) as scope_decision", "'r1' as reviewer_id", "'2024-01-05' as review_date")
    return O.apply_decisions(a, packet, O.validate_decisions(packet, a))[1]


def _evidence(spark, sf_dir):
    r = records(spark, sf_dir).withColumn("record_order", F.col("source_record_id").cast("long") * 2 + (F.col("source") == "openalex").cast("int"))
    queue = records(spark, sf_dir).where("source = 'crossref'").selectExpr("source_record_id as article_id", "doi", "title", "journal_short", "publication_year", "cast(length(abstract) as string) as current_text_chars")
    return R.local_evidence(queue, r, 250)


def local_evidence(spark, sf_dir):
    return _evidence(spark, sf_dir)


def page_outcomes(spark, sf_dir):
    p = table(spark, sf_dir, "pages").withColumn("p", P.read_page("html", "url"))
    return p.select("page_id", P.page_outcome("html", F.lit(200), P.usable_abstract(F.col("p.abstract")), F.col("p.pdf_url")).alias("outcome"), "p.title", "p.pdf_url")


QUERIES = {f.__name__: f for f in (expansion_plan, lane_overview, prefix_plan, decision_plan, route_matrix, workplan, review_queue, automation, import_preflight, action_packet, candidate_urls, batch_progress, progress_overview, review_summary, tier_summary, review_guide, cell_targets, packet_rows, scope_candidates, scope_summary, scope_decisions, local_evidence, page_outcomes)}

_W = f"WITH {Q.CLASSIFIED}"
_QUEUE = A["recovery_queue"].rsplit("SELECT k AS recovery_rank", 1)[0].replace("coalesce(suggested, '') AS sg", "'' AS sg").replace(" LEFT JOIN triage USING (article_id) WHERE", " WHERE")
_SCOPES = f"""WITH {B["articles"]}, s AS (SELECT *, lower(trim(title)) AS lt FROM articles), k AS (SELECT *, CASE WHEN article_type = 'es' THEN 'lecture_address' WHEN lt = '' THEN 'unknown' WHEN regexp_matches(lt, '^the\\b') THEN 'comment_reply' WHEN regexp_matches(lt, '\\band\\b.*\\bof\\b') THEN 'review_erratum_paratext' WHEN regexp_matches(lt, '^a\\b') THEN 'lecture_address' ELSE 'research' END AS proposed_scope,
 CASE WHEN article_type = 'es' THEN 'article_type:es' WHEN lt = '' THEN 'missing_title' WHEN regexp_matches(lt, '^the\\b') THEN 'title_pattern:^the\\b' WHEN regexp_matches(lt, '\\band\\b.*\\bof\\b') THEN 'title_pattern:\\band\\b.*\\bof\\b' WHEN regexp_matches(lt, '^a\\b') THEN 'title_pattern:^a\\b' ELSE '' END AS proposed_reason FROM s),
c AS (SELECT * FROM k WHERE proposed_scope IN ('review_erratum_paratext', 'comment_reply', 'lecture_address') AND article_scope NOT IN ('review_erratum_paratext', 'comment_reply', 'lecture_address'))"""
_PRIOR_COLUMNS = ["prior_attempted_articles", "prior_found_articles", *[f"prior_{x}_attempts" for x in FAILED]]
_LANES = f"""{_QUEUE}, y AS (SELECT *, CASE WHEN s >= 16 THEN 'high' WHEN s >= 10 THEN 'medium' ELSE 'low' END AS pr, CAST(y // 10 * 10 AS VARCHAR) AS decade, CASE WHEN doi = '' THEN '' WHEN doi LIKE '10.1093/%' THEN split_part(doi, '.', 1) || '.' || split_part(doi, '.', 2) ELSE split_part(doi, '/', 1) END AS doi_prefix,
 CASE WHEN oa_pdf_url <> '' THEN 'review_oa_pdf_or_first_pages' WHEN part THEN 'extend_existing_short_abstract' WHEN doi <> '' THEN 'recover_abstract_from_doi_or_publisher' WHEN openalex_id <> '' THEN 'review_openalex_or_title_match' WHEN article_url <> '' THEN 'review_article_landing_page' ELSE 'manual_title_year_search' END AS recovery_action FROM r),
x AS (SELECT *, CASE recovery_action WHEN 'review_oa_pdf_or_first_pages' THEN 'oa_pdf_review' WHEN 'extend_existing_short_abstract' THEN 'partial_short_text_extension' WHEN 'review_openalex_or_title_match' THEN 'openalex_or_title_search' WHEN 'review_article_landing_page' THEN 'article_landing_page_review' WHEN 'manual_title_year_search' THEN recovery_action
 ELSE CASE split_part(doi, '/', 1) WHEN '10.1257' THEN 'aea_publisher_metadata_10_1257' WHEN '10.7916' THEN 'academic_commons_metadata_10_7916' WHEN '10.1086' THEN 'jpe_chicago_or_repec_10_1086' WHEN '10.3982' THEN 'econometric_society_10_3982' WHEN '10.2307' THEN 'jstor_or_legacy_metadata_10_2307' WHEN '10.1111' THEN 'wiley_or_society_metadata_10_1111' ELSE 'doi_publisher_metadata_other' END END AS expansion_lane FROM y),
l AS (SELECT *, CASE WHEN recovery_action = 'recover_abstract_from_doi_or_publisher' THEN 'targeted_source_pass' WHEN expansion_lane = 'oa_pdf_review' THEN 'pdf_or_ocr_review' ELSE 'manual_recovery' END AS lane_type FROM x)"""
_COUNTS = "count(*) AS row_count, count(*) FILTER (pr = 'high') AS high_priority_rows, count(*) FILTER (pr = 'medium') AS medium_priority_rows, count(*) FILTER (pr = 'low') AS low_priority_rows, min(k) AS min_recovery_rank"
_OVERVIEW = f"""cells3 AS (SELECT expansion_lane, journal_short || ' ' || decade || ' (' || count(*) || ')' AS s, row_number() OVER (PARTITION BY expansion_lane ORDER BY count(*) DESC, journal_short, decade) AS n FROM l GROUP BY expansion_lane, journal_short, decade),
overview AS (SELECT expansion_lane, lane_type, {_COUNTS}, (SELECT string_agg(s, '; ' ORDER BY n) FROM cells3 c WHERE n <= 3 AND c.expansion_lane = l.expansion_lane) AS top_journal_decades FROM l GROUP BY 1, 2)"""


def _first_five(value: str) -> str:
    all_ = f"list_sort(list(DISTINCT {value}))"
    return f"array_to_string({all_}[1:5], '; ') || CASE WHEN count(DISTINCT {value}) > 5 THEN '; +' || (count(DISTINCT {value}) - 5) || ' more' ELSE '' END"


_PREFIX_PLAN = f"""{PRIOR}, own AS (SELECT doi_prefix, {_COUNTS}, {_first_five("expansion_lane")} AS expansion_lanes, {_first_five("journal_short || ' ' || decade")} AS journal_decades FROM l WHERE doi_prefix <> '' GROUP BY 1),
plan AS (SELECT own.*, {", ".join(f"coalesce({c}, 0) AS {c}" for c in _PRIOR_COLUMNS)}, doi_prefix IN ('10.1257', '10.7916', '10.1086', '10.3982', '10.2307') AS supported FROM own LEFT JOIN prior USING (doi_prefix))"""
_FAILED = " + ".join(_PRIOR_COLUMNS[2:])
_DECISIONS = f"""decisions AS (SELECT doi_prefix AS decision_unit, 'doi_prefix' AS unit_type, row_count, high_priority_rows, min_recovery_rank, prior_attempted_articles, prior_found_articles, {_FAILED} AS prior_failed_attempts, coalesce(best_prior_source, '') AS best_prior_source, coalesce(top_failure_source, '') AS top_failure_source,
 CASE WHEN doi_prefix = '10.2307' THEN 'bounded_scienceon_recovery' WHEN NOT supported THEN CASE WHEN row_count >= 50 THEN 'new_source_template_or_manual_recovery' ELSE 'low_volume_manual_recovery' END WHEN prior_attempted_articles = 0 THEN 'bounded_source_pass'
 WHEN prior_found_articles > 0 THEN CASE WHEN {_FAILED} > greatest(2 * prior_found_articles, 25) THEN 'source_specific_investigation_before_rerun' ELSE 'bounded_rerun_only_if_logic_changed' END WHEN {_FAILED} > 0 THEN 'do_not_rerun_unchanged_logic' ELSE 'inspect_before_rerun' END AS decision FROM plan LEFT JOIN context USING (doi_prefix)
 UNION ALL SELECT expansion_lane, 'expansion_lane', row_count, high_priority_rows, min_recovery_rank, 0, 0, 0, '', '', CASE expansion_lane WHEN 'oa_pdf_review' THEN 'inspect_pdf_blockers' WHEN 'partial_short_text_extension' THEN 'manual_abstract_extension' WHEN 'openalex_or_title_search' THEN 'manual_index_search' WHEN 'manual_title_year_search' THEN 'manual_low_yield_search' ELSE CASE WHEN lane_type = 'targeted_source_pass' THEN 'see_doi_prefix_decisions' ELSE 'inspect_lane' END END FROM overview)"""
_ROUTES = f"""probes AS (SELECT * FROM (SELECT [{', '.join(repr(u) for u in _PROBED)}][page_id % {len(_PROBED)} + 1] AS decision_unit, ['not_found', 'http_error', 'abstract_found'][length(html) % 3 + 1] AS outcome FROM pages) WHERE decision_unit <> '10.1086' OR outcome <> 'abstract_found'),
seen AS (SELECT decision_unit, count(*) AS probe_rows, count(*) FILTER (outcome = 'abstract_found') AS found FROM probes GROUP BY 1), both_ AS (SELECT d.*, coalesce(probe_rows, 0) AS probe_rows, coalesce(found, 0) AS probe_abstract_found_rows FROM decisions d LEFT JOIN seen USING (decision_unit)),
routes AS (SELECT *, CASE WHEN unit_type = 'expansion_lane' THEN CASE decision WHEN 'inspect_pdf_blockers' THEN 'manual_pdf_blocker_review' WHEN 'manual_abstract_extension' THEN 'manual_partial_abstract_extension' WHEN 'manual_index_search' THEN decision ELSE 'lane_decision_reference' END
 WHEN decision = 'new_source_template_or_manual_recovery' THEN CASE WHEN probe_abstract_found_rows > 0 THEN 'candidate_public_route_found' ELSE 'unsupported_existing_route' END WHEN decision = 'bounded_scienceon_recovery' THEN 'scienceon_bounded_recovery'
 WHEN decision = 'source_specific_investigation_before_rerun' THEN CASE WHEN probe_abstract_found_rows > 0 THEN 'candidate_route_requires_parser_or_url_update' WHEN probe_rows > 0 THEN 'do_not_rerun_landing_pages' ELSE 'source_specific_probe_needed' END
 WHEN decision = 'bounded_source_pass' THEN 'ready_bounded_source_pass' WHEN decision = 'bounded_rerun_only_if_logic_changed' THEN 'rerun_only_after_logic_or_cache_change' WHEN decision IN ('do_not_rerun_unchanged_logic', 'low_volume_manual_recovery') THEN 'manual_or_new_template_only' ELSE 'inspect_decision' END AS current_route_status FROM both_)"""
_SPLIT = f"""WITH {B["articles"]}, split AS (SELECT *, CAST(article_id AS BIGINT) AS i, ['ready_partial_text_extension', 'ready_manual_metadata', 'other_manual_review'][CAST(article_id AS BIGINT) % 3 + 1] AS split_group, 'R00' || (CAST(article_id AS BIGINT) % 4) AS batch,
 CASE WHEN CAST(article_id AS BIGINT) % 5 = 2 THEN abstract ELSE '' END AS filled, CASE WHEN CAST(article_id AS BIGINT) % 5 = 2 THEN 'crossref' ELSE '' END AS filled_source, text_enrichment_evidence_tier AS tier, length(abstract) AS chars FROM articles)"""
_REVIEW = f"""{_SPLIT}, rv AS (SELECT *, CASE WHEN {Q.collapse("filled")} = '' THEN 'needs_abstract_recovery' WHEN article_url <> '' THEN 'ready_to_import' ELSE 'needs_source_metadata' END AS state, greatest(250 - chars, 0) AS need, {Q.flags("abstract")} AS fl FROM split WHERE NOT (text_enrichment_status = 'enriched' AND chars >= 250)),
tiered AS (SELECT *, CASE WHEN state = 'needs_source_metadata' THEN 'source_metadata_fix' WHEN state = 'ready_to_import' THEN 'completed_ready_for_preflight' WHEN split_group = 'ready_partial_text_extension' THEN CASE WHEN fl <> '' THEN 'tier_2_partial_replace_suspect_text' WHEN need <= 75 THEN 'tier_1_partial_near_threshold' ELSE 'tier_3_partial_extension' END
 WHEN i % 4 = 1 THEN 'tier_5_manual_metadata_pdf_blocked' WHEN chars > 0 OR abstract_source <> '' THEN 'tier_4_manual_metadata_has_context' ELSE 'tier_6_manual_metadata_sparse' END AS quick_win_tier FROM rv),
family AS (SELECT *, CASE WHEN quick_win_tier = 'source_metadata_fix' THEN quick_win_tier WHEN split_group = 'ready_partial_text_extension' THEN 'partial_text_extension' WHEN i % 4 = 1 THEN 'pdf_blocker_metadata' WHEN doi LIKE '10.2307/%' THEN 'jstor_or_legacy_doi' WHEN doi LIKE '10.1086/%' THEN 'jpe_chicago_or_repec' WHEN doi LIKE '10.1257/%' THEN 'aea_publisher_metadata'
 WHEN doi LIKE '10.1111/%' THEN 'wiley_or_society_metadata' WHEN doi LIKE '10.3982/%' THEN 'econometric_society_metadata' WHEN doi <> '' THEN 'doi_or_publisher_metadata' ELSE 'title_index_search' END AS family FROM tiered)"""
_PROGRESS = f"""{_SPLIT}, hist AS (SELECT CASE WHEN event_id % 2 = 0 THEN 'R00' || (event_id % 5) ELSE '' END AS hb, event_id % 5 AS st FROM events), imported AS (SELECT * FROM hist WHERE st = 0), failed AS (SELECT * FROM hist WHERE st = 2),
progress AS (SELECT batch AS recovery_batch, count(*) AS total_rows, count(*) FILTER ({Q.collapse("filled")} <> '') AS completed_backfill_abstracts, count(*) FILTER ({Q.collapse("filled")} = '') AS remaining_backfill_abstracts, (SELECT count(*) FROM imported WHERE hb = batch) AS history_imported_rows, (SELECT count(*) FROM failed WHERE hb = batch) AS history_error_rows,
 round(count(*) FILTER ({Q.collapse("filled")} <> '') / count(*), 6) AS completed_backfill_share FROM split GROUP BY batch)"""
_CELLS = f"""{_W}, w AS (SELECT *, length(abstract) < 2000 OR category = 'insufficient_text' AS sh, CAST(CAST(publication_year AS INTEGER) // 10 * 10 AS VARCHAR) AS decade FROM classified),
pr AS (SELECT journal_short, decade, count(*) AS n, count(*) FILTER (sh) AS ir, count(*) FILTER (sh AND oa_pdf_url <> '') AS ready, count(*) FILTER (sh AND text_enrichment_status = 'partial_short_text') AS part, count(*) FILTER (sh AND {Q.collapse("abstract")} = '') AS miss FROM w GROUP BY 1, 2 HAVING count(*) FILTER (sh) >= 3),
sc AS (SELECT *, round(ir / n, 6) AS rate, greatest(0, ir - CAST(floor(CAST(0.2 AS DOUBLE) * n) AS BIGINT)) AS need, greatest(0, ir - CAST(floor(CAST(0.1 AS DOUBLE) * n) AS BIGINT)) AS need2 FROM pr), st AS (SELECT *, CAST(ir + round_even(rate * 100, 0) + least(ready * 5, 50) + least(part, 50) AS INTEGER) AS score FROM sc),
cells AS (SELECT row_number() OVER (ORDER BY score DESC, ir DESC, rate DESC, journal_short, decade) AS target_rank, journal_short, decade, n AS cell_rows, ir AS insufficient_rows, rate AS insufficient_share, CASE WHEN ir >= 250 OR rate >= 0.45 THEN 'critical' WHEN ir >= 100 OR rate >= 0.25 THEN 'high' WHEN ir >= 50 OR rate >= 0.15 THEN 'medium' ELSE 'low' END AS target_level, score AS target_score,
 need AS recoveries_to_target_share, need2 AS recoveries_to_stretch_share, round(greatest(ir - ready, 0) / n, 6) AS projected_share_after_ready, CASE WHEN need > 0 THEN round(least(ready / need, 1.0), 4) ELSE 1.0 END AS ready_target_coverage, CASE WHEN need > 0 THEN round(least(ir / need, 1.0), 4) ELSE 1.0 END AS queue_target_coverage, ir AS queue_rows, ready AS ready_rows, part AS partial_short_text_rows, miss AS missing_abstract_rows, ready AS oa_pdf_rows FROM st ORDER BY 1 LIMIT 20)"""
_ACTION = "CASE cached_evidence_status " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in R.ACTION_GROUPS.items()) + " ELSE 'manual_review' END"
_EVIDENCE = f"""{B["records"]}, er AS (SELECT *, {Q.title_key("title")} || '|' || lower(journal_short) || '|' || publication_year AS k, {Q.strip("abstract")} AS ct, {Q.flags("abstract")} AS cf, CAST(source_record_id AS BIGINT) * 2 + CASE WHEN source = 'openalex' THEN 1 ELSE 0 END AS o FROM records),
eq AS (SELECT source_record_id AS article_id, doi AS d, k AS kk, length(abstract) AS now_, length({Q.clean("title")}) AS tl FROM er WHERE source = 'crossref'), em AS (SELECT article_id, now_, tl, 'source_records_exact_doi' AS mb, er.* FROM eq JOIN er ON d <> '' AND d = doi WHERE ct <> '' UNION ALL SELECT article_id, now_, tl, 'source_records_exact_title_year', er.* FROM eq JOIN er ON d = '' AND kk = k WHERE ct <> ''),
ec AS (SELECT *, length(ct) + CASE WHEN tl > 0 THEN tl + 1 ELSE 0 END AS tc FROM em), eb AS (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY (cf = '' AND tc >= 250) DESC, (cf = '') DESC, tc DESC, o) AS n, count(*) OVER (PARTITION BY article_id) AS candidates FROM ec),
es AS (SELECT eq.article_id, CAST(eq.now_ AS INTEGER) AS current_text_chars, coalesce(candidates, 0) AS candidates, coalesce(mb, '') AS matched_by, coalesce(source, '') AS source, CAST(coalesce(tc, 0) AS INTEGER) AS candidate_text_chars,
 CASE WHEN ct IS NULL THEN 'no_cached_text_candidate' WHEN cf <> '' THEN 'cached_suspect_text_only' WHEN tc >= 250 THEN 'cached_import_candidate' WHEN tc > eq.now_ THEN 'cached_partial_extension_candidate' WHEN length(ct) < 80 THEN 'cached_fragment_only' ELSE 'cached_current_text_only' END AS cached_evidence_status FROM eq LEFT JOIN eb ON eb.article_id = eq.article_id AND n = 1),
evidence AS (SELECT *, CASE cached_evidence_status WHEN 'cached_import_candidate' THEN 'review_required_tier_a_or_b' WHEN 'cached_partial_extension_candidate' THEN 'review_context_only' WHEN 'cached_current_text_only' THEN 'review_context_only' WHEN 'cached_fragment_only' THEN 'review_context_only' ELSE 'not_importable_from_cache' END AS evidence_tier_suggestion FROM es)"""
SQL = {
    "expansion_plan": f"""{_LANES} SELECT expansion_lane, lane_type, recovery_action, journal_short, decade, {_COUNTS}, max(k) AS max_recovery_rank, count(*) FILTER (doi <> '') AS doi_rows, count(*) FILTER (openalex_id <> '') AS openalex_rows, count(*) FILTER (oa_pdf_url <> '') AS oa_pdf_rows, count(*) FILTER (text_enrichment_status = 'partial_short_text') AS partial_short_text_rows FROM l GROUP BY 1, 2, 3, 4, 5""",
    "lane_overview": f"{_LANES}, {_OVERVIEW} SELECT * FROM overview",
    "prefix_plan": f"{_LANES}, {_PREFIX_PLAN} SELECT * FROM plan",
    "decision_plan": f"{_LANES}, {_OVERVIEW}, {_PREFIX_PLAN}, {_DECISIONS} SELECT * FROM decisions",
    "route_matrix": f"{_LANES}, {_OVERVIEW}, {_PREFIX_PLAN}, {_DECISIONS}, {_ROUTES} SELECT decision_unit, unit_type, decision, probe_rows, probe_abstract_found_rows, current_route_status FROM routes",
    "workplan": f"""{_LANES}, {_OVERVIEW}, {_PREFIX_PLAN}, {_DECISIONS}, {_ROUTES}, wl AS (SELECT l.*, CASE WHEN r1.decision_unit IS NOT NULL THEN r1.current_route_status ELSE coalesce(r2.current_route_status, '') END AS rs, CAST(l.article_id AS BIGINT) AS i FROM l LEFT JOIN routes r1 ON r1.decision_unit = doi_prefix AND doi_prefix <> '' LEFT JOIN routes r2 ON r2.decision_unit = CASE recovery_action WHEN 'extend_existing_short_abstract' THEN 'partial_short_text_extension' WHEN 'review_openalex_or_title_match' THEN 'openalex_or_title_search' WHEN 'review_oa_pdf_or_first_pages' THEN 'oa_pdf_review' END),
w AS (SELECT article_id, rs AS route_status, CASE WHEN i % 6 = 1 THEN 'scope_review_excluded_nonresearch' WHEN i % 6 = 2 THEN 'scope_review_unsure_before_recovery' WHEN i % 5 = 1 THEN 'scope_review_before_recovery'
 WHEN recovery_action = 'review_oa_pdf_or_first_pages' THEN CASE i % 3 WHEN 0 THEN 'autofill_pdf_text' WHEN 1 THEN 'pdf_route_blocked_use_manual_metadata' ELSE 'try_public_pdf_once' END WHEN recovery_action = 'extend_existing_short_abstract' THEN 'manual_extend_partial_text'
 WHEN recovery_action = 'recover_abstract_from_doi_or_publisher' THEN CASE WHEN rs IN ('unsupported_existing_route', 'do_not_rerun_landing_pages', 'manual_or_new_template_only') THEN 'manual_index_or_new_template' WHEN rs IN ('ready_bounded_source_pass', 'source_specific_probe_needed', 'candidate_route_requires_parser_or_url_update') THEN 'source_specific_followup' WHEN rs = 'scienceon_bounded_recovery' THEN rs ELSE 'manual_doi_metadata_review' END
 WHEN recovery_action = 'review_openalex_or_title_match' THEN 'manual_index_title_match' ELSE 'manual_review' END AS row_status FROM wl)
SELECT *, CASE WHEN row_status = 'manual_extend_partial_text' THEN 'ready_partial_text_extension' WHEN row_status IN ('autofill_pdf_text', 'completed_backfill') THEN 'ready_autofill_or_completed' WHEN row_status IN ('scope_review_before_recovery', 'scope_review_unsure_before_recovery') THEN 'waiting_scope_review' WHEN row_status = 'scope_review_excluded_nonresearch' THEN 'excluded_nonresearch' WHEN row_status = 'manual_review' THEN 'other_manual_review' ELSE 'ready_manual_metadata' END AS split_group FROM w""",
    "review_queue": f"{_REVIEW} SELECT row_number() OVER (ORDER BY list_position([{', '.join(repr(t) for t in R.TIERS)}], quick_win_tier), need, i, journal_short, publication_year, title, article_id) AS review_rank, article_id, state AS completion_status, CASE state WHEN 'needs_source_metadata' THEN 'source_metadata_fix' WHEN 'ready_to_import' THEN state ELSE 'recover_abstract' END AS review_stage, quick_win_tier, family AS source_route_family, CAST(need AS INTEGER) AS chars_needed_to_threshold, fl AS current_text_quality_flag FROM family",
    "automation": f"""{_LANES}, {_OVERVIEW}, {_PREFIX_PLAN}, {_DECISIONS}, {_ROUTES}, {_REVIEW.removeprefix("WITH ").replace(B["articles"] + ", ", "")},
au AS (SELECT family.*, CASE {" ".join(f"WHEN doi LIKE '{p}%' THEN '{p}'" for p in G.ROUTE_DOIS)} ELSE CASE family {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in G.ROUTE_UNITS.items())} ELSE family END END AS unit FROM family),
ar AS (SELECT au.*, coalesce(current_route_status, '') AS rs, coalesce(decision, '') AS rd FROM au LEFT JOIN routes ON decision_unit = unit)
SELECT article_id, rs AS route_status, CASE WHEN state = 'ready_to_import' THEN 'ready_for_preflight' WHEN state = 'needs_source_metadata' THEN 'source_metadata_incomplete' WHEN fl <> '' THEN 'manual_replace_boilerplate' WHEN family = 'pdf_blocker_metadata' OR i % 4 = 1 THEN 'manual_metadata_after_pdf_block'
 WHEN quick_win_tier = 'tier_1_partial_near_threshold' THEN 'manual_near_threshold_extension' WHEN quick_win_tier = 'tier_3_partial_extension' THEN 'manual_partial_extension' WHEN rs IN ('unsupported_existing_route', 'do_not_rerun_landing_pages') OR rd = 'new_source_template_or_manual_recovery' THEN 'manual_index_or_template_spike_required'
 WHEN quick_win_tier = 'tier_4_manual_metadata_has_context' THEN 'manual_metadata_recovery' ELSE 'manual_review_required' END AS automation_status FROM ar""",
    "import_preflight": f"""{_SPLIT}, c AS (SELECT *, {Q.collapse("filled")} <> '' AS has, article_url <> '' AS named, {Q.collapse("tier")} AS t FROM split), x AS (SELECT *, has AND named AND t IN ('tier_a_formal_abstract', 'tier_b_source_description', 'tier_c_first_page_abstract_or_intro') AS good FROM c),
p AS (SELECT batch AS recovery_batch, split_group, count(*) AS total_rows, count(*) FILTER (NOT has) AS skipped_empty_abstract_rows, count(*) FILTER (has) AS candidate_rows_after_skip, count(*) FILTER (has AND named) AS source_ready_backfill_abstracts, count(*) FILTER (has AND NOT named) AS source_incomplete_backfill_abstracts, count(*) FILTER (good) AS import_ready_rows, count(*) FILTER (has AND NOT good) AS error_rows FROM x GROUP BY 1, 2)
SELECT *, CASE WHEN error_rows > 0 THEN 'blocked_errors' WHEN candidate_rows_after_skip = 0 THEN 'pass_empty' ELSE 'pass_ready' END AS preflight_status FROM p""",
    "candidate_urls": f"""WITH {B["articles"]}, u AS (SELECT *, 'https://' || ['econpapers.example/', 'www.aeaweb.org/articles?id=', 'example.org/'][length(title) % 3 + 1] || article_id AS url FROM articles)
SELECT article_id, array_to_string(list_filter([CASE WHEN length(title) % 3 = 0 THEN url END, CASE WHEN doi LIKE '10.1086/%' THEN 'https://ideas.repec.org/a/ucp/jpolec/doi' || replace(doi, '/', '-') || '.html' END], lambda v: v IS NOT NULL), '|') AS index_urls,
array_to_string(list_filter([CASE WHEN length(title) % 3 = 1 THEN url END, CASE WHEN doi LIKE '10.1257/%' THEN 'https://www.aeaweb.org/articles?id=' || doi WHEN doi LIKE '10.7916/%' THEN 'https://academiccommons.columbia.edu/doi/' || upper(doi) WHEN doi LIKE '10.3982/%' THEN 'https://www.econometricsociety.org/doi/' || upper(doi) END], lambda v: v IS NOT NULL), '|') AS publisher_urls FROM u""",
    "batch_progress": f"{_PROGRESS} SELECT * FROM progress",
    "progress_overview": f"""{_PROGRESS}, o AS (SELECT (SELECT count(DISTINCT batch) FROM split) AS nb, (SELECT count(*) FROM split) AS n, (SELECT sum(completed_backfill_abstracts) FROM progress) AS f, (SELECT count(*) FROM imported) AS im, (SELECT count(*) FROM failed) AS er, (SELECT arg_min(batch, i) FROM split) AS nx)
SELECT unnest(['recovery_batches', 'recovery_rows', 'current_recovery_queue_rows', 'completed_backfill_abstracts', 'current_packet_completed_backfill_abstracts', 'cumulative_imported_recovery_rows', 'remaining_backfill_abstracts', 'next_recovery_batch', 'next_recovery_batch_remaining', 'import_history_rows', 'import_error_history_rows']) AS metric,
unnest([CAST(nb AS VARCHAR), CAST(CAST(n + greatest(f, im) AS BIGINT) AS VARCHAR), CAST(n AS VARCHAR), CAST(CAST(greatest(f, im) AS BIGINT) AS VARCHAR), CAST(CAST(f AS BIGINT) AS VARCHAR), CAST(im AS VARCHAR), CAST(n AS VARCHAR), nx, CAST((SELECT count(*) FROM split WHERE batch = nx) AS VARCHAR), CAST(im AS VARCHAR), CAST(er AS VARCHAR)]) AS value FROM o""",
    "review_summary": f"""{_REVIEW} SELECT batch AS recovery_batch, CASE state WHEN 'needs_source_metadata' THEN 'source_metadata_fix' WHEN 'ready_to_import' THEN state ELSE 'recover_abstract' END AS review_stage, quick_win_tier, split_group, CASE WHEN i % 4 = 1 THEN 'pdf_route_blocked_use_manual_metadata' ELSE 'manual_extend_partial_text' END AS row_status, count(*) AS rows, CAST(round_even(median(need), 0) AS INTEGER) AS median_chars_needed_to_threshold FROM family GROUP BY 1, 2, 3, 4, 5""",
    "tier_summary": f"""{_REVIEW}, ranked AS (SELECT *, row_number() OVER (ORDER BY list_position([{', '.join(repr(t) for t in R.TIERS)}], quick_win_tier), need, i, journal_short, publication_year, title, article_id) AS rr FROM family), tiers AS (SELECT family, quick_win_tier, min(rr) AS m, count(*) AS n FROM ranked GROUP BY 1, 2)
SELECT family AS source_route_family, CAST(sum(n) AS BIGINT) AS rows, min(m) AS first_review_rank, string_agg(quick_win_tier, '|' ORDER BY m) AS quick_win_tiers FROM tiers GROUP BY 1""",
    "review_guide": f"""WITH {B["articles"]}, a AS (SELECT *, {Q.matching(Q.strip("title"))} AS mt, {Q.matching(Q.strip("abstract"))} AS ma FROM articles), j AS (SELECT *, array_to_string(list_filter([mt, ma], lambda v: v <> ''), ' ') AS t, length(trim(abstract)) AS n FROM a), {Q.scored("j", "t", "g")},
s AS (SELECT *, CASE WHEN n = 0 THEN 'no_abstract' WHEN length(t) < 250 THEN 'short_text' ELSE 'usable_text' END AS text_status, CASE WHEN c > 0 AND p > 0 THEN 'causal_and_predictive_cues' WHEN c > 0 THEN 'causal_cues' WHEN p > 0 THEN 'predictive_cues' ELSE 'no_keyword_cues' END AS cue_profile FROM g)
SELECT article_id, CAST(n AS INTEGER) AS abstract_chars, CAST(length(t) AS INTEGER) AS guide_text_chars, text_status, cue_profile, CASE WHEN text_status = 'no_abstract' OR cue_profile = 'causal_and_predictive_cues' THEN 'high' WHEN text_status = 'short_text' THEN 'medium' ELSE 'routine' END AS review_difficulty, array_to_string(ct, '|') AS causal_cue_terms, array_to_string(pt, '|') AS predictive_cue_terms FROM s""",
    "cell_targets": f"{_CELLS} SELECT * FROM cells",
    "action_packet": f"""{_CELLS}, {_EVIDENCE}, {_REVIEW.removeprefix("WITH ").replace(B["articles"] + ", ", "")}
SELECT e.article_id, cached_evidence_status, evidence_tier_suggestion, quick_win_tier, target_rank AS cell_target_rank, CASE WHEN cached_evidence_status = 'cached_current_text_only' AND quick_win_tier = 'tier_1_partial_near_threshold' THEN 'find_external_extension' ELSE {_ACTION} END AS action_group
FROM evidence e LEFT JOIN family f USING (article_id) LEFT JOIN cells t ON t.journal_short = f.journal_short AND t.decade = CAST(CAST(f.publication_year AS INTEGER) // 10 * 10 AS VARCHAR)""",
    "packet_rows": f"{_QUEUE} SELECT 'R' || lpad(CAST((k - 1) // 10 + 1 AS VARCHAR), 3, '0') AS recovery_batch, lpad(CAST((k - 1) % 10 + 1 AS VARCHAR), 3, '0') AS packet_row, article_id FROM r",
    "scope_candidates": f"{_SCOPES} SELECT article_id, article_scope AS current_scope, proposed_scope, proposed_reason, CAST(CAST(publication_year AS INTEGER) // 10 * 10 AS VARCHAR) AS decade FROM c",
    "scope_summary": f"""{_SCOPES}, f AS (SELECT *, lower(proposed_reason || ' ' || title) AS b FROM c), g AS (SELECT *, CASE WHEN regexp_matches(b, 'errat|corrig|correction') THEN 'erratum_correction' WHEN regexp_matches(b, 'comment|reply|rejoinder') THEN 'comment_reply' WHEN regexp_matches(b, 'lecture|address|nobel') THEN 'lecture_address' WHEN regexp_matches(b, 'front matter|back matter|contents|editorial|minutes|report of') THEN 'front_matter' WHEN regexp_matches(b, 'review') THEN 'book_review' ELSE 'other_pattern' END AS pattern_family FROM f)
SELECT 'articles' AS dataset, proposed_scope, pattern_family, count(*) AS rows, count(DISTINCT article_id) AS articles FROM g GROUP BY 2, 3""",
    "scope_decisions": f"""{_SCOPES}, d AS (SELECT *, ['exclude_from_research_scope', 'keep_as_research', 'unsure', 'maybe'][CAST(article_id AS INTEGER) % 4 + 1] AS scope_decision FROM c), n AS (SELECT *, CASE scope_decision WHEN 'exclude_from_research_scope' THEN proposed_scope WHEN 'keep_as_research' THEN 'research' ELSE article_scope END AS new_scope FROM d WHERE scope_decision <> 'maybe')
SELECT article_id, scope_decision, article_scope AS old_scope, new_scope, article_scope <> new_scope AS changed FROM n""",
    "local_evidence": f"WITH {_EVIDENCE} SELECT * FROM evidence",
}
