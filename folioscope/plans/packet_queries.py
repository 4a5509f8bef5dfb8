"""Queries over packets for reviewers and what comes back from them: summaries, edits, readiness, model answers, samples, errors."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.operators import attempts as A
from folioscope.operators import classify as C
from folioscope.operators import enrich as E
from folioscope.operators import labels as L
from folioscope.operators import packets as K
from folioscope.operators import rank as N
from folioscope.operators import recovery as V
from folioscope.operators import routing as R
from folioscope.operators import sample as M
from folioscope.operators import scope as O
from folioscope.plans import recovery_queries as Y
from folioscope.plans import sqltext as Q
from folioscope.plans.article_queries import classified
from folioscope.plans.bindings import SQL as B
from folioscope.plans.bindings import articles, records, validation


def _numbered(spark, sf_dir):
    """Articles with their number."""
    return articles(spark, sf_dir).withColumn("i", F.col("article_id").cast("long"))


def evidence_summary(spark, sf_dir):
    return R.evidence_summary(Y.action_rows(spark, sf_dir, False))


def action_summary(spark, sf_dir):
    return R.action_summary(Y.action_rows(spark, sf_dir, False))


def automation_summary(spark, sf_dir):
    return R.automation_summary(Y.automation_rows(spark, sf_dir))


def filled_rows(spark, sf_dir):
    rows = _numbered(spark, sf_dir).selectExpr("article_id", "if(i % 3 = 0, '', ' ') as abstract", "if(i % 4 = 1, title, '') as backfill_abstract")
    kept, skipped = E.filter_empty(rows, ["abstract", "backfill_abstract"])
    return kept.select("article_id", F.lit(0).cast("long").alias("skipped")).unionByName(skipped.select(F.lit("").alias("article_id"), "skipped"))


_TIERS = ["", "tier_a_formal_abstract", " tier_c_first_page_abstract_or_intro ", "tier_d_title_only_triage", "tier_x"]


def import_readiness(spark, sf_dir):
    rows = _numbered(spark, sf_dir).selectExpr("article_id", "if(i % 3 = 0, '', abstract) as abstract", "abstract_source as source", "article_url as source_url", "openalex_id as source_record_id", f"element_at(array({', '.join(map(repr, _TIERS))}), cast(i % 5 as int) + 1) as evidence_tier")
    names = ("source", "source_url", "source_record_id")
    return rows.select("article_id", E.completion("abstract", *names).alias("completion_status"), E.source_error(*names, "evidence_tier").alias("source_error"), E.tier_error("evidence_tier").alias("tier_error"))


def unseen_rows(spark, sf_dir):
    a = _numbered(spark, sf_dir)
    return K.unseen_rows(a, ["10.1257", "10.2307/EN", "10.1093"], a.where("i % 4 = 0"), a.where("i % 5 = 0")).select("article_id", "doi")


#: What a model may answer: good (plain, nested), of a wrong category, of a wrong confidence, without a reason, without a key, no JSON, nothing.
_ANSWERS = [
    '{"output_text":"{\\"category\\":\\"causal\\",\\"confidence\\":\\"high\\",\\"reason\\":\\"r\\"}"}',
    '{"output":[{"content":[{"text":"{\\"category\\":\\"other\\","},{"text":"\\"confidence\\":\\"low\\",\\"reason\\":\\"r\\"}"}]}]}',
    '{"output_text":"{\\"category\\":\\"both\\",\\"confidence\\":\\"high\\",\\"reason\\":\\"r\\"}"}',
    '{"output_text":"{\\"category\\":\\"causal\\",\\"confidence\\":\\"sure\\",\\"reason\\":\\"r\\"}"}',
    '{"output_text":"{\\"category\\":\\"causal\\",\\"confidence\\":\\"high\\",\\"reason\\":\\" \\"}"}',
    '{"output_text":"{\\"category\\":\\"causal\\",\\"confidence\\":\\"high\\"}"}',
    '{"output_text":"causal, high"}',
    '{"output_text":""}',
]


def hybrid_labels(spark, sf_dir):
    """Rule labels with a model's answers by cache key; every ninth article has none."""
    c = classified(spark, sf_dir).withColumn("i", F.col("article_id").cast("long"))
    key = T.payload_key(article_id="article_id", prompt_version=F.lit("p1"), model=F.lit("m1"), title="title", abstract="abstract")
    answers = c.where("i % 9 < 8").select(key.alias("cache_key"), F.element_at(F.array(*[F.lit(x) for x in _ANSWERS]), (F.col("i") % 9 + 1).cast("int")).alias("response"))
    return C.merge_model_results(c, answers, "p1", "m1").select("article_id", "causal_predictive_category", "classification_confidence", "classification_method", "llm_status", "llm_error")


def inferred_tiers(spark, sf_dir):
    rows = _numbered(spark, sf_dir).selectExpr(
        "article_id", "if(i % 7 = 0, 'tier_b_source_description', '') as evidence_tier", "if(i % 3 = 1, 'not_found', 'enriched') as enrichment_status", "abstract as enriched_abstract", "oa_pdf_url",
        "element_at(array('openalex', 'oa_pdf_first_pages', 'web', 'crossref'), cast(i % 4 as int) + 1) as enrichment_source", "if(i % 5 = 0, 'x; Source_Text_Type=first_pages', '') as enrichment_detail", "element_at(array('found', 'not_cached', 'found', 'rate_limited', 'error'), cast(i % 5 as int) + 1) as looked_up",
    )
    status = E.result_status(F.col("looked_up"), F.col("enriched_abstract"), F.col("oa_pdf_url"), F.length("enriched_abstract"))
    return rows.select("article_id", E.evidence_tier(rows).alias("evidence_tier"), status.alias("result_status"))


def document_text(spark, sf_dir):
    a = _numbered(spark, sf_dir)
    known = a.select("article_id", F.col("text_enrichment_status").alias("enrichment_status"), F.lit("web").alias("enrichment_source"), F.col("title").alias("enriched_abstract"))
    docs = a.selectExpr("article_id", "abstract as pdf_text", "if(i % 2 = 0, 'abstract_section', 'first_pages') as pdf_text_type").unionByName(a.where("i % 3 = 0").selectExpr("article_id", "title as pdf_text", "'abstract_section' as pdf_text_type"))
    return E.merge_document_text(known, docs).select("article_id", "enrichment_status", "enrichment_source", F.md5(F.col("enriched_abstract").cast("binary")).alias("text_md5"))


def carried_edits(spark, sf_dir):
    a = _numbered(spark, sf_dir)
    queue = a.selectExpr("article_id", "'' as backfill_abstract", "abstract_source as source", "'' as source_url", "'' as source_record_id", "text_enrichment_evidence_tier as evidence_tier", "'suggested_action=x' as notes")
    few = a.where("i % 2 = 0").selectExpr("article_id", "title as backfill_abstract", "'s1' as source", "'' as source_url", "'' as source_record_id", "'' as evidence_tier", "'suggested_action=y' as notes")
    many = a.where("i % 3 = 0").selectExpr("article_id", "'' as backfill_abstract", "'s2' as source", "'u' as source_url", "'r' as source_record_id", "'' as evidence_tier", "'mine' as notes")
    return R.carry_edits(queue, few.unionByName(many)).select("article_id", *R.EDIT_COLUMNS)


def autofilled(spark, sf_dir):
    a = _numbered(spark, sf_dir)
    batch = a.selectExpr("article_id", "if(i % 4 = 0, 'own', ' ') as backfill_abstract", "if(i % 3 = 0, 'n', '') as notes", "'' as source", "'' as evidence_tier")
    found = lambda where, source: a.where(where).selectExpr("article_id", "if(i % 5 = 0, 'not_found', 'enriched') as enrichment_status", f"concat(abstract, '{source}') as enriched_abstract", f"'{source}' as enrichment_source", "text_enrichment_evidence_tier as evidence_tier")
    out = R.autofill(batch, found("i % 2 = 0", "openalex").unionByName(found("i % 6 < 3", "crossref")))
    return out.select("article_id", F.md5(F.col("backfill_abstract").cast("binary")).alias("backfill_md5"), "notes", "source", "evidence_tier")


def batch_context(spark, sf_dir):
    """Articles with their workplan and the first by name of their attempts' statuses; an article twice would stop the job."""
    a = articles(spark, sf_dir)
    seen = Y.attempts(spark, sf_dir).select("article_id", "attempt_status")
    out = R.batch_with_context(a.select("article_id"), Y.workplan(spark, sf_dir), a.select("article_id", "journal_short", "doi"), seen)
    return out.select("article_id", "row_status", "split_group", "journal_short", "doi", "attempt_status")


def snapshots(spark, sf_dir):
    c = classified(spark, sf_dir).withColumn("i", F.col("article_id").cast("long"))
    history = c.where("i % 2 = 0").selectExpr("article_id", "explode(array(1, 2)) as import_row").withColumn("import_source_file", F.concat(F.lit("f"), "import_row"))
    return K.snapshot(c, "after", c.where("i % 3 = 0"), c.where("i % 5 = 0"), history)


def second_review(spark, sf_dir):
    v = validation(spark, sf_dir)
    other = v.withColumn("manual_label", F.when(F.col("manual_confidence") == "low", "other").otherwise(F.col("manual_label")))
    return L.overlap_agreement(v, other)


_ROUTES = {"es": "lecture_address"}


def scope_packet(spark, sf_dir):
    a = _numbered(spark, sf_dir)
    decided = a.where("i % 4 = 0").selectExpr("article_id", "'keep_as_research' as scope_decision", "'r1' as reviewer_id", "'2024-01-05' as review_date", "'' as review_notes")
    found = O.scope_candidates({"articles": a, "older": a.where("publication_year < '2000'")}, _ROUTES, Y.PATTERNS)
    return O.review_packet(found, decided).select("scope_review_id", "article_id", "dataset", "current_scope", "proposed_scope", "proposed_reason", "scope_decision", "reviewer_id", "review_lane")


def packet_profile(spark, sf_dir):
    return K.profile(classified(spark, sf_dir))


_DECIDED = ["", "exclude_from_research_scope", "keep_as_research", "unsure", "maybe"]


def scope_errors(spark, sf_dir):
    a = _numbered(spark, sf_dir)
    packet = a.selectExpr("if(i % 23 = 0, '', article_id) as article_id", f"element_at(array({', '.join(map(repr, _DECIDED))}), cast(i % 5 as int) + 1) as scope_decision", "if(i % 2 = 0, 'research', '') as proposed_scope", "if(i % 3 = 0, '', 'r1') as reviewer_id", "if(i % 7 = 0, '', '2024-01-05') as review_date")
    again = packet.where("article_id <> '' and cast(article_id as long) % 11 = 1")
    return O.validate_decisions(packet.unionByName(again), a.where("i % 13 <> 2"))


def adjudication_errors(spark, sf_dir):
    v = validation(spark, sf_dir).withColumn("i", F.col("article_id").cast("long"))
    packet = v.selectExpr("validation_id", "article_id", "element_at(array('', 'causal', 'both'), cast(i % 3 as int) + 1) as adjudicated_label", "if(i % 2 = 0, 'n', '') as adjudication_notes", "if(i % 5 = 0, '', 'a1') as adjudicator_id", "if(i % 7 = 0, '', '2024-01-05') as adjudication_date", "i")
    packet = packet.unionByName(packet.where("i % 10 = 3")).drop("i")
    return K.validate_adjudications(packet, v.where("i % 9 <> 4"))


def _packet(spark, sf_dir):
    """Labelled articles as a packet with some ids missing, doubled or changed."""
    v = validation(spark, sf_dir).withColumn("i", F.col("article_id").cast("long"))
    p = v.selectExpr("case when i % 11 = 0 then '' when i % 13 = 0 then 'CAL0' else concat('CAL', i) end as calibration_id", "if(i % 17 = 1, 'VALX', validation_id) as validation_id", "if(i % 19 = 1, 'other', article_id) as article_id")
    return v, p


def packet_errors(spark, sf_dir):
    v, p = _packet(spark, sf_dir)
    return K.packet_errors(v, p, "calibration_id", 7)


def _reviews(spark, sf_dir):
    """Turns of conversations as reviews of calibration items, some by one reviewer twice."""
    turns = Y.table(spark, sf_dir, "conversations")
    return turns.selectExpr("concat('CAL', conv_id) as calibration_id", "concat('r', turn % 3) as reviewer_id", "if(length(text) % 4 = 0, '', 'causal') as manual_label")


def submission_errors(spark, sf_dir):
    return K.submission_errors(_packet(spark, sf_dir)[1], _reviews(spark, sf_dir), "calibration_id")


def row_progress(spark, sf_dir):
    packet = validation(spark, sf_dir).select(F.concat(F.lit("CAL"), "article_id").alias("calibration_id")).distinct()
    done = _reviews(spark, sf_dir)
    return K.row_progress(packet, done, K.submission_errors(packet, done.where("reviewer_id <> 'r2'"), "calibration_id"), "calibration_id")


def priority_ranks(spark, sf_dir):
    c = E.candidates(classified(spark, sf_dir))
    return N.global_rank(c, E.priority_order(c), "priority_rank").select("priority_rank", "article_id", "current_text_chars", "current_abstract_chars", "has_current_abstract")


def filtered_candidates(spark, sf_dir):
    return E.filter_candidates(articles(spark, sf_dir), ["10.1257", "10.2307/F"], ["WEB", "src0", "src1", "src2"], 1980, 2010).select("article_id", "doi", "journal_short", "publication_year")


def cell_rows(spark, sf_dir):
    q = V.recovery_queue(classified(spark, sf_dir)).withColumn("decade", T.decade("publication_year"))
    return V.cell_queue(Y.cell_targets(spark, sf_dir), q, 3).select("journal_short", "decade", "target_rank", "cell_row", "article_id")


def probe_urls(spark, sf_dir):
    packet = _numbered(spark, sf_dir).selectExpr("i as row_number", "journal_short as unit", "oa_pdf_url", "if(i % 2 = 0, article_url, 'https://example.org/same') as page_url")
    return A.url_candidates(packet, "unit", ["oa_pdf_url", "page_url"], 5)


def recent_triage(spark, sf_dir):
    c = classified(spark, sf_dir)
    waiting = c.where("cast(article_id as long) % 3 = 0")
    return R.recent_triage(V.recovery_queue(c), waiting, 1990).select("triage_rank", "article_id", "lane")


def first_records(spark, sf_dir):
    r = records(spark, sf_dir).where("doi <> ''")
    return N.first_by(r, ["doi"], [F.col("source_record_id").cast("long"), F.asc("source")]).select("doi", "source_record_id", "source")


def _strata(spark, sf_dir):
    return M.with_strata(classified(spark, sf_dir))


def calibration_packet(spark, sf_dir):
    return M.calibration_packet(_strata(spark, sf_dir), 40).select("calibration_id", "article_id", "stratum_category", "is_ambiguous")


def overlap_packet(spark, sf_dir):
    return M.overlap_packet(_strata(spark, sf_dir), 40).select("article_id", "stratum_category")


def blind_packet(spark, sf_dir):
    packet = M.reviewer_packet(_strata(spark, sf_dir), "blind")
    return packet.withColumns({c: F.md5(F.col(c).cast("binary")) for c in ("title", "abstract")})


QUERIES = {f.__name__: f for f in (
    evidence_summary, action_summary, automation_summary, filled_rows, import_readiness, unseen_rows, hybrid_labels, inferred_tiers, document_text, carried_edits, autofilled, batch_context, snapshots, second_review, scope_packet, packet_profile,
    scope_errors, adjudication_errors, packet_errors, submission_errors, row_progress, priority_ranks, filtered_candidates, cell_rows, probe_urls, recent_triage, first_records, calibration_packet, overlap_packet, blind_packet,
)}

_A = f"WITH {B['articles']}, n AS (SELECT *, CAST(article_id AS BIGINT) AS i FROM articles)"
_V = f"WITH {B['validation']}, v AS (SELECT *, CAST(article_id AS BIGINT) AS i FROM validation)"
_C = f"WITH {Q.CLASSIFIED}, n AS (SELECT *, CAST(article_id AS BIGINT) AS i FROM classified)"
_RANKS = f"row_number() OVER (ORDER BY list_position([{', '.join(repr(t) for t in R.TIERS)}], quick_win_tier), need, i, journal_short, publication_year, title, article_id) AS rr"
_ROWS = f"""WITH {Y._EVIDENCE}, {Y._REVIEW.removeprefix("WITH ")}, fr AS (SELECT *, {_RANKS} FROM family),
ap AS (SELECT e.source, cached_evidence_status, coalesce(quick_win_tier, '') AS tier, coalesce(rr, {R.UNRANKED}) AS rk, CASE WHEN cached_evidence_status = 'cached_current_text_only' AND quick_win_tier = 'tier_1_partial_near_threshold' THEN 'find_external_extension' ELSE {Y._ACTION} END AS action_group FROM evidence e LEFT JOIN fr USING (article_id))"""
_STATUS = Y.SQL["automation"].replace("SELECT article_id, rs AS route_status, CASE", "SELECT article_id, quick_win_tier, family, need, i, journal_short, publication_year, title, CASE")


def _list(values: list[str]) -> str:
    return "[" + ", ".join(Q.lit(v) for v in values) + "]"


def _errors(source: str, keys: str, checks: list[tuple[str, str, str, str]]) -> str:
    return " UNION ALL ".join(f"SELECT {keys}, '{field}' AS field, {value} AS value, '{error}' AS error FROM {source} WHERE {bad}" for field, value, bad, error in checks)


_SECTION = "CASE WHEN i % 7 = 0 THEN 'tier_b_source_description' WHEN i % 3 = 1 OR abstract = '' THEN '' WHEN i % 4 = 1 OR i % 5 = 0 THEN 'tier_c_first_page_abstract_or_intro' WHEN i % 4 IN (0, 3) THEN 'tier_a_formal_abstract' ELSE '' END"
_SCOPE = Y._SCOPES.rsplit("c AS (", 1)[0] + """c AS (SELECT *, CAST(article_id AS BIGINT) AS i, CASE WHEN publication_year >= '2010' THEN 'recent' ELSE 'older' END AS lane FROM k WHERE proposed_scope IN ('review_erratum_paratext', 'comment_reply', 'lecture_address') AND article_scope NOT IN ('review_erratum_paratext', 'comment_reply', 'lecture_address'))"""
_PACKET = f"""{_V}, p AS (SELECT CASE WHEN i % 11 = 0 THEN '' WHEN i % 13 = 0 THEN 'CAL0' ELSE 'CAL' || i END AS calibration_id, CASE WHEN i % 17 = 1 THEN 'VALX' ELSE validation_id END AS validation_id, CASE WHEN i % 19 = 1 THEN 'other' ELSE article_id END AS article_id FROM v)"""
_REVIEWS = "s AS (SELECT 'CAL' || conv_id AS calibration_id, 'r' || (turn % 3) AS reviewer_id, CASE WHEN length(text) % 4 = 0 THEN '' ELSE 'causal' END AS manual_label FROM conversations)"
_DRAWN = "WITH {c}, w AS (SELECT article_id, category, (c > 0 AND p > 0) OR confidence = 'low' AS amb, md5('{seed}|' || article_id) AS d FROM classified)"
_NEEDS = """CASE WHEN {source} = '' THEN 'missing_source' WHEN article_url = '' AND openalex_id = '' THEN 'missing_source_locator' ELSE tier_error END"""
_RANKED = f"{Y._QUEUE} SELECT k AS recovery_rank, article_id FROM r"
SQL = {
    "evidence_summary": f"""{_ROWS}, src AS (SELECT cached_evidence_status AS s, tier AS t, source, min(rk) AS m FROM ap WHERE source <> '' GROUP BY 1, 2, 3)
SELECT cached_evidence_status, tier AS quick_win_tier, count(*) AS rows, min(rk) AS first_review_rank, coalesce((SELECT string_agg(source, '|' ORDER BY m, source) FROM src WHERE s = cached_evidence_status AND t = tier), '') AS candidate_sources FROM ap GROUP BY 1, 2""",
    "action_summary": f"{_ROWS} SELECT action_group, tier AS quick_win_tier, count(*) AS rows, min(rk) AS first_review_rank FROM ap GROUP BY 1, 2",
    "automation_summary": f"""WITH au AS ({_STATUS}), rk AS (SELECT *, {_RANKS} FROM au), t AS (SELECT automation_status AS s, quick_win_tier AS x, min(rr) AS m FROM rk GROUP BY 1, 2), f AS (SELECT automation_status AS s, family AS x, min(rr) AS m FROM rk GROUP BY 1, 2)
SELECT automation_status, count(*) AS rows, min(rr) AS first_review_rank, (SELECT string_agg(x, '|' ORDER BY m) FROM t WHERE s = automation_status) AS quick_win_tiers, (SELECT string_agg(x, '|' ORDER BY m) FROM f WHERE s = automation_status) AS source_route_families FROM rk GROUP BY 1""",
    "filled_rows": f"{_A} SELECT article_id, CAST(0 AS BIGINT) AS skipped FROM n WHERE i % 4 = 1 AND {Q.collapse('title')} <> '' UNION ALL SELECT '', count(*) FROM n WHERE NOT (i % 4 = 1 AND {Q.collapse('title')} <> '')",
    "import_readiness": f"""{_A}, t AS (SELECT *, CASE i % 5 WHEN 0 THEN 'missing_evidence_tier' WHEN 3 THEN 'unimportable_evidence_tier' WHEN 4 THEN 'invalid_evidence_tier' ELSE '' END AS tier_error FROM n)
SELECT article_id, CASE WHEN i % 3 = 0 OR {Q.collapse("abstract")} = '' THEN 'needs_abstract_recovery' WHEN abstract_source <> '' AND (article_url <> '' OR openalex_id <> '') THEN 'ready_to_import' ELSE 'needs_source_metadata' END AS completion_status, {_NEEDS.format(source="abstract_source")} AS source_error, tier_error FROM t""",
    "unseen_rows": f"{_A} SELECT article_id, doi FROM n WHERE (doi LIKE '10.1257%' OR doi LIKE '10.2307/en%' OR doi LIKE '10.1093%') AND i % 4 <> 0 AND i % 5 <> 0",
    "hybrid_labels": f"""{_C}, s AS (SELECT *, i % 9 AS k, CASE WHEN chars < 250 THEN 'skipped_insufficient_text' WHEN i % 9 = 8 THEN 'not_cached' WHEN i % 9 < 2 THEN 'ok' ELSE 'error' END AS st FROM n)
SELECT article_id, CASE WHEN st <> 'ok' THEN category WHEN k = 0 THEN 'causal' ELSE 'other' END AS causal_predictive_category, CASE WHEN st <> 'ok' THEN confidence WHEN k = 0 THEN 'high' ELSE 'low' END AS classification_confidence, CASE WHEN st = 'ok' THEN 'hybrid' ELSE 'rule_based' END AS classification_method, st AS llm_status,
CASE WHEN st = 'error' THEN ['invalid_category', 'invalid_confidence', 'empty_reason', 'missing_keys', 'invalid_json', 'no_output_text'][k - 1] ELSE '' END AS llm_error FROM s""",
    "inferred_tiers": f"""{_A}, m AS (SELECT *, {Q.collapse("abstract")} = '' AS none FROM n) SELECT article_id, {_SECTION.replace("abstract = ''", "none")} AS evidence_tier,
CASE WHEN i % 5 = 1 THEN 'not_cached' WHEN i % 5 = 3 THEN 'rate_limited' WHEN oa_pdf_url <> '' AND abstract = '' THEN 'pdf_candidate' WHEN abstract = '' THEN 'not_found' WHEN length(abstract) >= 250 THEN 'enriched' ELSE 'partial_short_text' END AS result_status FROM m""",
    "document_text": f"""{_A}, d AS (SELECT article_id, abstract AS x, CASE WHEN i % 2 = 0 THEN 'oa_pdf' ELSE 'oa_pdf_first_pages' END AS src FROM n UNION ALL SELECT article_id, title, 'oa_pdf' FROM n WHERE i % 3 = 0), b AS (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY length(x) DESC, x) AS r FROM d WHERE length(x) >= 250),
m AS (SELECT n.*, x, src, text_enrichment_status <> 'enriched' AND x IS NOT NULL AS take FROM n LEFT JOIN b ON b.article_id = n.article_id AND r = 1)
SELECT article_id, CASE WHEN take THEN 'enriched' ELSE text_enrichment_status END AS enrichment_status, CASE WHEN take THEN src ELSE 'web' END AS enrichment_source, md5(CASE WHEN take THEN x ELSE title END) AS text_md5 FROM m""",
    "carried_edits": f"""{_A} SELECT article_id, CASE WHEN i % 6 IN (2, 4) THEN title ELSE '' END AS backfill_abstract, CASE WHEN i % 3 = 0 THEN 's2' WHEN i % 2 = 0 THEN 's1' ELSE abstract_source END AS source, CASE WHEN i % 3 = 0 THEN 'u' ELSE '' END AS source_url, CASE WHEN i % 3 = 0 THEN 'r' ELSE '' END AS source_record_id,
text_enrichment_evidence_tier AS evidence_tier, CASE WHEN i % 3 = 0 THEN 'mine' ELSE 'suggested_action=x' END AS notes FROM n""",
    "autofilled": f"""{_A}, m AS (SELECT *, i % 5 <> 0 AND (i % 2 = 0 OR i % 6 < 3) AND i % 4 <> 0 AS take, CASE WHEN i % 6 < 3 THEN 'crossref' ELSE 'openalex' END AS src FROM n)
SELECT article_id, md5(CASE WHEN take THEN abstract || src WHEN i % 4 = 0 THEN 'own' ELSE ' ' END) AS backfill_md5, CASE WHEN NOT take THEN CASE WHEN i % 3 = 0 THEN 'n' ELSE '' END WHEN i % 3 = 0 THEN 'n;autofilled_from=' || src ELSE 'autofilled_from=' || src END AS notes, CASE WHEN take THEN src ELSE '' END AS source, CASE WHEN take THEN text_enrichment_evidence_tier ELSE '' END AS evidence_tier FROM m""",
    "batch_context": f"""{_A}, w AS ({Y.SQL["workplan"]}), e AS (SELECT CAST(user_id AS VARCHAR) AS article_id, min(['found', 'not_found', 'error', 'rate_limited', 'skipped'][event_id % 5 + 1]) AS attempt_status FROM events GROUP BY 1)
SELECT n.article_id, row_status, split_group, journal_short, doi, attempt_status FROM n LEFT JOIN w ON w.article_id = n.article_id LEFT JOIN e ON e.article_id = n.article_id""",
    "snapshots": f"""{_C} SELECT 'after' AS snapshot_label, article_id, journal_short, CAST(CAST(publication_year AS INTEGER) // 10 * 10 AS VARCHAR) AS decade, category, CAST(chars AS INTEGER) AS chars, CASE WHEN i % 2 = 0 THEN 'f2' ELSE '' END AS import_source FROM n WHERE i % 3 = 0 OR i % 5 = 0""",
    "second_review": f"""{_V}, x AS (SELECT manual_label AS a, CASE WHEN manual_confidence = 'low' THEN 'other' ELSE manual_label END AS b FROM v), s AS (SELECT count(*) AS overlap_rows, count(*) FILTER (b <> '') AS completed_rows, count(*) FILTER (a <> '' AND b <> '') AS comparable_rows, count(*) FILTER (a <> '' AND a = b) AS agreement_rows FROM x)
SELECT *, CASE WHEN comparable_rows > 0 THEN round(agreement_rows / comparable_rows, 4) END AS agreement_rate FROM s""",
    "scope_packet": f"""{_SCOPE} SELECT 'SR' || CASE WHEN length(CAST(k AS VARCHAR)) >= 4 THEN CAST(k AS VARCHAR) ELSE lpad(CAST(k AS VARCHAR), 4, '0') END AS scope_review_id, * EXCLUDE (k) FROM (SELECT row_number() OVER (ORDER BY lane DESC, journal_short, publication_year DESC, title, article_id) AS k, article_id, CASE WHEN publication_year < '2000' THEN 'articles|older' ELSE 'articles' END AS dataset,
article_scope AS current_scope, proposed_scope, proposed_reason, CASE WHEN i % 4 = 0 THEN 'keep_as_research' ELSE '' END AS scope_decision, CASE WHEN i % 4 = 0 THEN 'r1' ELSE '' END AS reviewer_id, lane AS review_lane FROM c)""",
    "packet_profile": f"""{_C}, x AS (SELECT chars, {Q.collapse("abstract")} <> '' AS has FROM n) SELECT count(*) AS rows, count(*) FILTER (has) AS with_abstract, count(*) FILTER (NOT has) AS without_abstract, CAST(min(chars) AS INTEGER) AS min_chars, CAST(trunc(quantile_cont(chars, 0.5)) AS INTEGER) AS median_chars, CAST(max(chars) AS INTEGER) AS max_chars FROM x""",
    "scope_errors": f"""{_A}, p0 AS (SELECT CASE WHEN i % 23 = 0 THEN '' ELSE article_id END AS article_id, i, {_list(_DECIDED)}[i % 5 + 1] AS sd, CASE WHEN i % 2 = 0 THEN 'research' ELSE '' END AS ps, CASE WHEN i % 3 = 0 THEN '' ELSE 'r1' END AS rv, CASE WHEN i % 7 = 0 THEN '' ELSE '2024-01-05' END AS rd FROM n),
p1 AS (SELECT * FROM p0 UNION ALL SELECT * FROM p0 WHERE article_id <> '' AND i % 11 = 1), p AS (SELECT *, count(*) OVER (PARTITION BY article_id) AS same FROM p1)
{_errors("p", "article_id", [("article_id", "article_id", "article_id = ''", "missing_article_id"), ("article_id", "article_id", "article_id <> '' AND same > 1", "duplicate_article_id"), ("article_id", "article_id", "article_id <> '' AND i % 13 = 2", "unknown_article_id"), ("scope_decision", "sd", "sd = 'maybe'", "invalid_scope_decision"),
 ("proposed_scope", "ps", "sd = 'exclude_from_research_scope' AND ps = ''", "missing_proposed_scope"), ("reviewer_id", "rv", "sd <> '' AND rv = ''", "missing_reviewer_id"), ("review_date", "rd", "sd <> '' AND rd = ''", "missing_review_date")])}""",
    "adjudication_errors": f"""{_V}, p0 AS (SELECT validation_id, article_id, i, ['', 'causal', 'both'][i % 3 + 1] AS al, CASE WHEN i % 2 = 0 THEN 'n' ELSE '' END AS an, CASE WHEN i % 5 = 0 THEN '' ELSE 'a1' END AS ai, CASE WHEN i % 7 = 0 THEN '' ELSE '2024-01-05' END AS ad FROM v),
p1 AS (SELECT * FROM p0 UNION ALL SELECT * FROM p0 WHERE i % 10 = 3), p AS (SELECT *, count(*) OVER (PARTITION BY validation_id, article_id) AS same FROM p1)
{_errors("p", "validation_id, article_id", [("validation_id", "validation_id", "same > 1", "duplicate_key"), ("validation_id", "validation_id", "i % 9 = 4", "unknown_key"), ("adjudicated_label", "al", "al = 'both'", "invalid_adjudicated_label"), ("adjudication_notes", "an", "al <> '' AND an = ''", "missing_adjudication_notes"),
 ("adjudicator_id", "ai", "al <> '' AND ai = ''", "missing_adjudicator_id"), ("adjudication_date", "ad", "al <> '' AND ad = ''", "missing_adjudication_date")])}""",
    "packet_errors": f"""{_PACKET}, q AS (SELECT *, count(*) OVER (PARTITION BY calibration_id) AS same, count(*) OVER (PARTITION BY validation_id, article_id) AS keys, EXISTS (SELECT 1 FROM v WHERE v.validation_id = p.validation_id AND v.article_id = p.article_id) AS known, EXISTS (SELECT 1 FROM v WHERE v.validation_id = p.validation_id) AS id FROM p)
{_errors("q", "validation_id, article_id", [("calibration_id", "calibration_id", "calibration_id = ''", "missing_packet_id"), ("calibration_id", "calibration_id", "calibration_id <> '' AND same > 1", "duplicate_packet_id"), ("validation_id", "validation_id", "keys > 1", "duplicate_packet_key"),
 ("article_id", "article_id", "NOT known AND id", "stale_packet_row"), ("validation_id", "validation_id", "NOT id", "unknown_packet_row")])} UNION ALL SELECT '', '', 'packet_rows', CAST(count(*) AS VARCHAR), 'packet_row_count_mismatch' FROM p HAVING count(*) <> 7""",
    "submission_errors": f"""{_PACKET}, {_REVIEWS}, q AS (SELECT *, count(*) OVER (PARTITION BY calibration_id, reviewer_id) AS same, calibration_id IN (SELECT calibration_id FROM p) AS known FROM s)
{_errors("q", "calibration_id", [("calibration_id", "calibration_id", "NOT known", "unknown_submission_row"), ("reviewer_id", "reviewer_id", "same > 1", "duplicate_reviewer_row")])}""",
    "row_progress": f"""WITH {_REVIEWS}, p AS (SELECT DISTINCT 'CAL' || doc_id AS calibration_id FROM labels), d AS (SELECT calibration_id, count(DISTINCT reviewer_id) AS reviews FROM s WHERE manual_label <> '' GROUP BY 1), q AS (SELECT *, count(*) OVER (PARTITION BY calibration_id, reviewer_id) AS same FROM s WHERE reviewer_id <> 'r2'),
e AS (SELECT calibration_id, count(*) AS errors FROM q WHERE same > 1 GROUP BY 1), m AS (SELECT calibration_id, coalesce(reviews, 0) AS reviews, coalesce(errors, 0) AS errors FROM p LEFT JOIN d USING (calibration_id) LEFT JOIN e USING (calibration_id))
SELECT *, CASE WHEN errors > 0 THEN 'has_errors' WHEN reviews >= 2 THEN 'complete' WHEN reviews > 0 THEN 'partial' ELSE 'not_started' END AS progress_status FROM m""",
    "priority_ranks": f"""{_C}, x AS (SELECT *, length({Q.clean("abstract")}) AS ac FROM n WHERE category = 'insufficient_text' OR chars < 250)
SELECT row_number() OVER (ORDER BY (doi <> '') DESC, ({Q.collapse("title")} <> '') DESC, CAST(publication_year AS INTEGER) DESC, chars DESC, article_id) AS priority_rank, article_id, CAST(chars AS INTEGER) AS current_text_chars, CAST(ac AS INTEGER) AS current_abstract_chars, ac > 0 AS has_current_abstract FROM x""",
    "filtered_candidates": f"{_A} SELECT article_id, doi, journal_short, publication_year FROM n WHERE (doi LIKE '10.1257%' OR doi LIKE '10.2307/f%') AND lower(journal_short) IN ('web', 'src0', 'src1', 'src2') AND CAST(publication_year AS INTEGER) BETWEEN 1980 AND 2010",
    "cell_rows": f"""{_A}, q AS ({_RANKED}), t AS ({Y.SQL["cell_targets"]}), x AS (SELECT n.journal_short, CAST(CAST(n.publication_year AS INTEGER) // 10 * 10 AS VARCHAR) AS decade, recovery_rank, n.article_id FROM n JOIN q ON q.article_id = n.article_id),
y AS (SELECT x.journal_short, x.decade, target_rank, row_number() OVER (PARTITION BY x.journal_short, x.decade ORDER BY recovery_rank, article_id) AS cell_row, article_id FROM x JOIN t ON t.journal_short = x.journal_short AND t.decade = x.decade) SELECT * FROM y WHERE cell_row <= 3""",
    "probe_urls": f"""{_A}, u AS (SELECT journal_short AS unit, i, 0 AS c, oa_pdf_url AS url FROM n UNION ALL SELECT journal_short, i, 1, CASE WHEN i % 2 = 0 THEN article_url ELSE 'https://example.org/same' END FROM n), f AS (SELECT unit, url, min(i * 2 + c) AS place FROM u WHERE url <> '' GROUP BY 1, 2),
r AS (SELECT unit, url, row_number() OVER (PARTITION BY unit ORDER BY place, url) AS probe_row FROM f) SELECT * FROM r WHERE probe_row <= 5""",
    "recent_triage": f"""{_A}, q AS ({_RANKED}), x AS (SELECT n.article_id, recovery_rank, CASE WHEN i % 3 = 0 THEN 'scope_review_first' ELSE 'recover_text' END AS lane FROM n JOIN q ON q.article_id = n.article_id WHERE CAST(publication_year AS INTEGER) >= 1990)
SELECT row_number() OVER (ORDER BY lane, recovery_rank, article_id) AS triage_rank, article_id, lane FROM x""",
    "first_records": f"WITH {B['records']}, r AS (SELECT *, row_number() OVER (PARTITION BY doi ORDER BY CAST(source_record_id AS BIGINT), source) AS k FROM records WHERE doi <> '') SELECT doi, source_record_id, source FROM r WHERE k = 1",
    "calibration_packet": f"""{_DRAWN.format(c=Q.CLASSIFIED, seed="calibration-1")}, e AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY d, article_id) AS k, row_number() OVER (PARTITION BY amb ORDER BY d, article_id) AS ka, row_number() OVER (ORDER BY d, article_id) AS kf FROM w),
g AS (SELECT *, CASE WHEN k <= 10 THEN 0 WHEN amb AND ka <= 10 THEN 1 ELSE 9 END AS part FROM e WHERE k <= 10 OR amb AND ka <= 10 OR kf <= 40), h AS (SELECT * FROM g ORDER BY part, d, article_id LIMIT 40)
SELECT 'CAL' || lpad(CAST(row_number() OVER (ORDER BY d, article_id) AS VARCHAR), 3, '0') AS calibration_id, article_id, category AS stratum_category, amb AS is_ambiguous FROM h""",
    "overlap_packet": f"""{_DRAWN.format(c=Q.CLASSIFIED, seed="overlap-1")}, e AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY d, article_id) AS k, row_number() OVER (ORDER BY d, article_id) AS kf FROM w)
SELECT article_id, category AS stratum_category FROM (SELECT * FROM e WHERE k <= 5 OR kf <= 40 ORDER BY CASE WHEN k <= 5 THEN 0 ELSE 9 END, d, article_id LIMIT 40)""",
    "blind_packet": f"{_A} SELECT '' AS validation_id, '' AS batch_id, article_id, journal_short, publication_year, md5(title) AS title, md5(abstract) AS abstract, '' AS manual_label, '' AS manual_confidence, '' AS manual_notes, '' AS reviewer_id, '' AS review_date FROM n",
}
