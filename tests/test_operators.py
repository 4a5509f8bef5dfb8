"""Operators on small tables, and properties: shares sum to one, results don't depend on partitions."""

import json

from pyspark.sql import functions as F

from folioscope.operators import enrich as E
from folioscope.operators import labels as L
from folioscope.operators import link as K
from folioscope.operators import rank as R
from folioscope.operators import recovery as V
from folioscope.operators import routing as W
from folioscope.operators import sample as M
from folioscope.operators import scope as O
from folioscope.operators import shares as S
from folioscope.plans.bindings import RULES, articles, records
from folioscope.plans.registry import QUERIES, SQL
from folioscope.sources import pages, tables


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def test_every_query_has_sql_but_those_that_cannot():
    assert set(QUERIES) - set(SQL) == {"backfill_match", "page_outcomes"} and set(SQL) <= set(QUERIES)


def test_linkage(spark):
    cols = "source string, source_record_id string, journal_short string, title string, abstract string, publication_year string, doi string, volume string, article_type string, jel_codes string"
    data = [("crossref", "1", "aer", "A title", "", "2001", "10.1/A", "1", "journal-article", ""), ("openalex", "2", "aer", "A Title!", "The abstract", "2001", "https://doi.org/10.1/a", "2", "article", ""), ("crossref", "3", "jpe", "Other", "x", "1999", "", "", "report", "")]
    got = {r["duplicate_resolution_rule"]: r for r in K.link_articles(spark.createDataFrame(data, cols), ["source", "source_record_id"]).collect()}
    a, b = got["doi"], got["title_journal_year"]
    assert a["abstract"] == "The abstract" and a["abstract_source"] == "openalex" and a["title_source"] == "crossref" and a["source_record_count"] == 2
    assert a["metadata_warning"] == "conflicting_doi;conflicting_volume;missing_jel_codes"
    assert b["metadata_warning"] == "missing_doi;missing_jel_codes;nonstandard_article_type"


def test_linkage_does_not_depend_on_partitions(spark, sf_dir):
    r = records(spark, sf_dir)
    link = lambda d: rows(K.link_articles(d, ["source", "source_record_id"]))
    assert link(r) == link(r.repartition(7, "title")) == link(r.orderBy(F.desc("doi")).coalesce(1))


def test_shares_sum_to_one(spark, sf_dir):
    for name in ("category_shares", "confidence_distribution", "sensitivity_shares", "tier_sensitivity_shares"):
        df = QUERIES[name](spark, sf_dir)
        share = "confidence_share" if name == "confidence_distribution" else "category_share"
        groups = [c for c in df.columns if c in ("scenario", "journal_short", "publication_year")]
        assert df.groupBy(*groups).agg(F.abs(F.sum(share) - 1).alias("e")).where("e > 1e-5").count() == 0


def test_trend_of_an_absent_category(spark):
    t = spark.createDataFrame([("b", "2000", "other", 8, 10, 0.8), ("b", "2000", "causal", 2, 10, 0.2), ("b", "2010", "other", 5, 10, 0.5), ("b", "2010", "causal", 4, 10, 0.4), ("b", "2010", "predictive", 1, 10, 0.1)], "scenario string, publication_year string, category string, article_count int, group_total int, category_share double")
    got = {r["category"]: r for r in S.trend_changes(t, 2000, 2010).collect()}
    assert got["causal"]["share_change"] == 0.2 and got["predictive"]["start_share"] == 0 and got["predictive"]["start_group_total"] == 10


def test_global_rank(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    ranked = R.global_rank(spark.range(1000).mapInArrow(count, "id long"), [F.desc("id")])
    assert ranked.where("rank = 1000 - id").count() == 1000 and ranked.count() == 1000 and seen.value <= 2000  # the range bounds' sample, and once more
    df = spark.range(1000).select(F.col("id"), (F.col("id") * 7919 % 97).alias("v")).repartition(9)
    got = R.global_rank(df, [F.desc("v"), F.asc("id")]).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 1001)) and [(-r["v"], r["id"]) for r in got] == sorted((-r["v"], r["id"]) for r in got)
    assert R.global_rank(df.limit(0), [F.asc("id")]).count() == 0


def test_upsert(spark):
    cols = "article_id string, enrichment_status string, enrichment_source string, enriched_abstract string, oa_pdf_url string, article_scope string, article_scope_reason string, attempted_sources string"
    old = spark.createDataFrame([("1", "enriched", "semantic_scholar", "x", "", "", "", "semantic_scholar"), ("2", "enriched", "s", "x", "", "", "", ""), ("3", "not_found", "", "", "", "", "", "")], cols)
    new = spark.createDataFrame([("1", "pdf_candidate", "", "", "u.pdf", "research", "r", "openalex"), ("2", "skipped_nonresearch_scope", "", "", "", "comment_reply", "p", ""), ("4", "enriched", "openalex", "y", "", "", "", "openalex")], cols)
    got = {r["article_id"]: r for r in E.upsert_enrichment(old, new).collect()}
    assert (got["1"]["enrichment_status"], got["1"]["oa_pdf_url"], got["1"]["attempted_sources"], got["1"]["article_scope"]) == ("enriched", "u.pdf", "semantic_scholar|openalex", "research")
    assert got["2"]["enrichment_status"] == "skipped_nonresearch_scope" and set(got) == {"1", "2", "3", "4"} and got["4"]["evidence_tier"] == "tier_a_formal_abstract"
    again = E.upsert_enrichment(E.upsert_enrichment(old, new), new)
    assert rows(again.select(cols.replace(" string", "").split(", "))) == rows(E.upsert_enrichment(old, new).select(cols.replace(" string", "").split(", ")))


def test_first_found_stops_at_a_rate_limit(spark):
    cols = "article_id string, source string, status string, abstract string, oa_pdf_url string"
    data = [("1", "a", "not_found", "", "p1"), ("1", "b", "found", "B", ""), ("2", "a", "rate_limited", "", ""), ("2", "b", "found", "B", ""), ("3", "a", "skipped", "", ""), ("3", "b", "not_cached", "", ""), ("4", "b", "not_found", "", "p4")]
    got = {r["article_id"]: (r["status"], r["abstract"], r["oa_pdf_url"]) for r in E.first_found(spark.createDataFrame(data, cols), ["a", "b"]).collect()}
    assert got == {"1": ("found", "B", "p1"), "2": ("rate_limited", "", ""), "3": ("not_cached", "", ""), "4": ("not_found", "", "p4")}


def test_backfill_cascade(spark):
    a = spark.createDataFrame([("a1", "10.1/x", "Alpha beta gamma", "2000"), ("a2", "10.1/d", "Delta", "2001"), ("a3", "10.1/d", "Delta two", "2001")], "article_id string, doi string, title string, publication_year string")
    b = spark.createDataFrame([(1, "a1", "", "Wrong", "2000", "t"), (2, "a1", "", "Alpha beta gamma", "2000", "t"), (3, "", "10.1/X", "Alpha beta gamma", "2000", "t"), (4, "", "10.1/d", "", "", "t"), (5, "zz", "", "", "", "t"), (6, "a2", "", "Delta", "", ""), (7, "", "", "alpha beta  gamma", "2000", "t"), (8, "", "10.9/n", "", "", "t")], "row_number long, article_id string, doi string, title string, publication_year string, abstract string")
    got = {r["row_number"]: (r["error"], r["matched_by"]) for r in E.match_backfill(b, a).collect()}
    assert got == {1: ("title_mismatch", "article_id"), 2: ("", "article_id"), 3: ("duplicate_backfill_article_id", "doi"), 4: ("unmatched_article", "ambiguous_doi"), 5: ("unmatched_article", "unknown_article_id"), 6: ("missing_abstract", "article_id"), 7: ("duplicate_backfill_article_id", "title_year"), 8: ("unmatched_article", "unknown_doi")}


def test_labels_are_all_or_nothing(spark):
    cols = "validation_id string, article_id string, manual_label string, manual_confidence string, manual_notes string, reviewer_id string, review_date string"
    sample = spark.createDataFrame([("V1", "1", "", "", "", "", ""), ("V2", "2", "", "", "", "", "")], cols)
    good = spark.createDataFrame([("V1", "1", "causal", "high", "", "r", "2024-01-05")], cols)
    bad = spark.createDataFrame([("V1", "1", "causal", "high", "", "r", "2024-01-05"), ("V9", "9", "zzz", "", "", "", "5 May")], cols)
    assert [r["manual_label"] for r in L.merge_labels(sample, good).orderBy("validation_id").collect()] == ["causal", ""]
    assert [r["manual_label"] for r in L.merge_labels(sample, bad).orderBy("validation_id").collect()] == ["", ""]
    assert {r["error"] for r in L.validate_labels(bad, sample).collect()} == {"invalid_manual_label", "missing_manual_confidence", "missing_reviewer_id", "invalid_review_date", "unknown_key"}


def test_gate_names_the_first_blocker(spark):
    c = spark.createDataFrame([(1, "a", True, ""), (2, "b", False, "x"), (3, "c", False, "y")], "ord int, check string, passed boolean, detail string")
    assert tuple(L.gate(c).first()) == ("blocked", "b", 1, 3)


def test_samples_are_reproducible(spark, sf_dir):
    from folioscope.operators.classify import classify

    c = classify(articles(spark, sf_dir), RULES)
    one = M.sample_rows(c, 40, 3)
    assert rows(one.select("article_id")) == rows(M.sample_rows(c.repartition(5, "title"), 40, 3).select("article_id")) and one.count() == 40
    assert rows(one.select("article_id")) != rows(M.sample_rows(c, 40, 4).select("article_id"))
    assert one.where("stratum_category = 'insufficient_text'").count() <= 8
    assert M.calibration_packet(one, 12).count() == 12 and M.overlap_packet(one, 8).count() == 8
    t = M.label_template(one, 3, 10)
    assert t.where("validation_id = 'VAL0040' and batch_id = 'B004'").count() == 1
    assert "causal_predictive_category" not in M.reviewer_packet(t).columns and "stratum" in M.reviewer_packet(t, "audit").columns


def test_scope_review(spark):
    a = spark.createDataFrame([("1", "A comment", "", "research", "aer", "2015"), ("2", "Plain", "", "research", "aer", "2015"), ("3", "Another comment", "", "comment_reply", "aer", "1990")], "article_id string, title string, article_type string, article_scope string, journal_short string, publication_year string")
    c = O.scope_candidates({"x": a, "y": a}, {}, [("comment_reply", "comment")])
    p = O.review_packet(c)
    assert [(r["article_id"], r["dataset"], r["scope_review_id"]) for r in p.collect()] == [("1", "x|y", "SR0001")]
    decided = p.withColumn("scope_decision", F.lit("exclude_from_research_scope")).withColumn("reviewer_id", F.lit("r")).withColumn("review_date", F.lit("2024-01-05"))
    out, log = O.apply_decisions(a, decided, O.validate_decisions(decided, a))
    assert {r["article_id"]: r["article_scope"] for r in out.collect()} == {"1": "comment_reply", "2": "research", "3": "comment_reply"} and log.first()["changed"]


def test_edits_and_autofill(spark):
    q = spark.createDataFrame([("1", "", "suggested_action=x"), ("2", "", "")], "article_id string, backfill_abstract string, notes string")
    e = spark.createDataFrame([("1", "text", "s", "", "", "", "suggested_action=x"), ("1", "", "", "", "", "", "mine")], "article_id string, backfill_abstract string, source string, source_url string, source_record_id string, evidence_tier string, notes string")
    got = {r["article_id"]: r for r in W.carry_edits(q, e).collect()}
    assert got["1"]["backfill_abstract"] == "text" and got["1"]["notes"] == "suggested_action=x"
    filled = W.autofill(W.carry_edits(q, e), spark.createDataFrame([("1", "enriched", "new", "openalex", "t"), ("2", "enriched", "new", "openalex", "t")], "article_id string, enrichment_status string, enriched_abstract string, enrichment_source string, evidence_tier string"))
    assert {r["article_id"]: r["backfill_abstract"] for r in filled.collect()} == {"1": "text", "2": "new"}


def one_row(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_cells(spark):
    level = lambda n, share: V.target_level(F.lit(n), F.lit(share))
    got = one_row(spark, a=level(250, 0.1), b=level(10, 0.45), c=level(100, 0.1), d=level(10, 0.25), e=level(50, 0.1), f=level(10, 0.15), g=level(49, 0.1499))
    assert tuple(got) == ("critical", "critical", "high", "high", "medium", "medium", "low")
    got = one_row(spark, a=V.recoveries_needed(F.lit(100), F.lit(204), 0.2), b=V.recoveries_needed(F.lit(5), F.lit(0), 0.2), c=V.projected_share(F.lit(100), F.lit(200), F.lit(40)), d=V.coverage_ratio(F.lit(6), F.lit(60)), e=V.coverage_ratio(F.lit(90), F.lit(60)), f=V.coverage_ratio(F.lit(0), F.lit(0)))
    assert tuple(got) == (60, 0, 0.3, 0.1, 1.0, 1.0)
    assert one_row(spark, a=V.target_score(F.lit(100), F.lit(0.305), F.lit(20), F.lit(7)))["a"] == 100 + 30 + 50 + 7
    profile = spark.createDataFrame([("aer", "1990", 100, 60, 0.6, 5, 40, 3), ("jpe", "1990", 100, 30, 0.3, 0, 30, 0), ("qje", "2000", 50, 3, 0.06, 0, 3, 0)], "journal_short string, decade string, rows long, insufficient_rows long, insufficient_share double, partial_short_text_rows long, missing_abstract_rows long, has_oa_pdf_rows long")
    queue = spark.createDataFrame([("1", "aer", "1990", 4), ("2", "jpe", "1990", 2)], "article_id string, journal_short string, decade string, recovery_rank int")
    got = V.cell_targets(profile, queue, queue.where("article_id = '2'").withColumn("review_rank", F.lit(9))).orderBy("target_rank").collect()
    assert [(r["journal_short"], r["target_level"], r["target_score"], r["recoveries_to_target_share"], r["ready_rows"], r["first_ready_review_rank"]) for r in got] == [("aer", "critical", 125, 40, 0, None), ("jpe", "high", 65, 10, 1, 9)]


def test_lanes_and_decisions(spark):
    lane = lambda action, doi="": W.expansion_lane(F.lit(action), F.lit(doi))
    got = one_row(spark, a=lane("review_oa_pdf_or_first_pages"), b=lane(W.DOI_ACTION, "https://doi.org/10.1086/x"), c=lane(W.DOI_ACTION, "10.5555/x"), d=lane("review_openalex_or_title_match", "10.1086/x"), e=lane("?"))
    assert tuple(got) == ("oa_pdf_review", "jpe_chicago_or_repec_10_1086", "doi_publisher_metadata_other", "openalex_or_title_search", "unassigned_review")
    got = one_row(spark, **{f"x{i}": W.lane_type(F.lit(x)) for i, x in enumerate(("wiley_or_society_metadata_10_1111", "oa_pdf_review", "manual_title_year_search", "unassigned_review"))})
    assert tuple(got) == ("targeted_source_pass", "pdf_or_ocr_review", "manual_recovery", "review")
    cols = "doi_prefix string, row_count int, prior_attempted_articles int, prior_found_articles int, prior_error_attempts int, prior_not_found_attempts int, prior_skipped_attempts int, prior_not_cached_attempts int, prior_rate_limited_attempts int, supported boolean"
    data = [
        ("10.2307", 9, 0, 0, 0, 0, 0, 0, 0, True), ("10.1111", 50, 9, 1, 0, 0, 0, 0, 0, False), ("10.1111", 49, 9, 1, 0, 0, 0, 0, 0, False), ("10.1086", 5, 0, 0, 0, 0, 0, 0, 0, True),
        ("10.1086", 5, 40, 5, 20, 6, 0, 0, 0, True), ("10.1086", 5, 40, 5, 20, 5, 0, 0, 0, True), ("10.1086", 5, 40, 0, 0, 0, 0, 0, 1, True), ("10.1086", 5, 40, 0, 0, 0, 0, 0, 0, True),
    ]
    got = [r["d"] for r in spark.createDataFrame(data, cols).coalesce(1).select(W.prefix_decision().alias("d")).collect()]
    assert got == ["bounded_scienceon_recovery", "new_source_template_or_manual_recovery", "low_volume_manual_recovery", "bounded_source_pass", "source_specific_investigation_before_rerun", "bounded_rerun_only_if_logic_changed", "do_not_rerun_unchanged_logic", "inspect_before_rerun"]


def test_routes(spark):
    d = spark.createDataFrame([("u1", "doi_prefix", "bounded_source_pass"), ("u2", "doi_prefix", "source_specific_investigation_before_rerun"), ("u3", "doi_prefix", "source_specific_investigation_before_rerun"), ("u4", "doi_prefix", "source_specific_investigation_before_rerun"), ("u5", "doi_prefix", "new_source_template_or_manual_recovery"), ("oa_pdf_review", "expansion_lane", "inspect_pdf_blockers")], "decision_unit string, unit_type string, decision string")
    p = spark.createDataFrame([("u2", "access_challenge"), ("u3", "abstract_found"), ("u3", "not_found")], "decision_unit string, outcome string")
    got = {r["decision_unit"]: r["current_route_status"] for r in W.route_matrix(d, p).collect()}
    assert got == {"u1": "ready_bounded_source_pass", "u2": "do_not_rerun_landing_pages", "u3": "candidate_route_requires_parser_or_url_update", "u4": "source_specific_probe_needed", "u5": "unsupported_existing_route", "oa_pdf_review": "manual_pdf_blocker_review"}


def test_workflow_and_split_groups(spark):
    cols = "d string, s string, f boolean, a string, p string, r string, u string"
    pdf, doi = "review_oa_pdf_or_first_pages", W.DOI_ACTION
    cases = [
        (("exclude_nonresearch", "", False, pdf, "", "", ""), "scope_review_excluded_nonresearch", "excluded_nonresearch"), (("unsure", "", True, pdf, "", "", ""), "scope_review_unsure_before_recovery", "waiting_scope_review"),
        (("", "comment_reply", True, pdf, "", "", ""), "scope_review_before_recovery", "waiting_scope_review"), (("", "", True, pdf, "", "", ""), "completed_backfill", "ready_autofill_or_completed"),
        (("", "", False, pdf, "extracted", "", "x/referee.pdf"), "autofill_pdf_text", "ready_autofill_or_completed"), (("", "", False, pdf, "too_short", "", "x/Referee.pdf"), "suspect_pdf_url_use_manual_metadata", "ready_manual_metadata"),
        (("", "", False, pdf, "too_short", "", ""), "pdf_route_blocked_use_manual_metadata", "ready_manual_metadata"), (("", "", False, pdf, "", "", ""), "try_public_pdf_once", "ready_manual_metadata"),
        (("", "", False, "extend_existing_short_abstract", "", "", ""), "manual_extend_partial_text", "ready_partial_text_extension"), (("", "", False, doi, "", "do_not_rerun_landing_pages", ""), "manual_index_or_new_template", "ready_manual_metadata"),
        (("", "", False, doi, "", "source_specific_probe_needed", ""), "source_specific_followup", "ready_manual_metadata"), (("", "", False, doi, "", "", ""), "manual_doi_metadata_review", "ready_manual_metadata"), (("", "", False, "?", "", "", ""), "manual_review", "other_manual_review"),
    ]
    status = W.row_workflow(*[F.col(c) for c in "dsfapru"])
    got = spark.createDataFrame([c[0] for c in cases], cols).coalesce(1).select(status.alias("x")).select("x", W.split_group("x").alias("g")).collect()
    assert [tuple(r) for r in got] == [c[1:] for c in cases]


def test_review_tiers(spark):
    cols = "article_id string, split_group string, row_status string, abstract string, source string, source_url string, source_record_id string, current_text_chars string, current_abstract string, current_abstract_source string, recovery_rank string, doi string, journal_short string, publication_year string, title string, text_enrichment_status string"
    part, notice = "ready_partial_text_extension", "All use subject to https://about.jstor.org/terms"
    data = [
        ("fix", part, "", "Recovered.", "econlit", "", "", "210", "", "", "3", "", "a", "1", "t", ""), ("near", part, "", "", "", "", "", "175", "x", "s", "2", "", "a", "1", "t", ""), ("notice", part, "", "", "", "", "", "245", notice, "s", "6", "", "a", "1", "t", ""),
        ("long", part, "", "", "", "", "", "174", "x", "s", "1", "", "a", "1", "t", ""), ("blocked", "ready_manual_metadata", "pdf_route_blocked_use_manual_metadata", "", "", "", "", "0", "", "", "5", "10.1086/x", "a", "1", "t", ""), ("some", "ready_manual_metadata", "", "", "", "", "", "9", "x", "", "7", "10.1093/restud/9", "a", "1", "t", ""),
        ("none", "ready_manual_metadata", "", "", "", "", "", "0", "", "", "8", "", "a", "1", "t", ""), ("done", part, "", "Text.", "econlit", "u", "", "0", "", "", "9", "", "a", "1", "t", ""), ("usable", part, "", "", "", "", "", "300", "", "", "4", "", "a", "1", "t", "enriched"),
    ]
    got = W.review_queue(spark.createDataFrame(data, cols)).orderBy("review_rank").collect()
    assert [(r["article_id"], r["quick_win_tier"]) for r in got] == list(zip(["fix", "near", "notice", "long", "some", "blocked", "none", "done"], W.TIERS, strict=True))
    assert [r["source_route_family"] for r in got] == ["source_metadata_fix", *["partial_text_extension"] * 3, "oup_journal_metadata", "pdf_blocker_metadata", "title_index_search", "partial_text_extension"]


def test_evidence_and_tiers(spark):
    status = lambda a, t, now, flags="", fallback="", pdf="": W.evidence_status(F.lit(a), F.lit(t), F.lit(now), F.lit(flags), F.lit(fallback), F.lit(pdf))
    got = one_row(spark, a=status(300, 320, 0, "x"), b=status(240, 250, 0), c=status(100, 120, 90), d=status(79, 90, 90), e=status(80, 90, 90), f=status(0, 0, 0, pdf="u"), g=status(0, 0, 0, fallback="rate_limited"), h=status(0, 0, 0, fallback="not_cached"), i=status(0, 0, 0))
    assert tuple(got) == ("cached_suspect_text_only", "cached_import_candidate", "cached_partial_extension_candidate", "cached_fragment_only", "cached_current_text_only", "cached_pdf_candidate_only", "cached_prior_rate_limited_only", "no_cached_response", "no_cached_text_candidate")
    group = lambda s, t: W.action_group(F.lit(s), F.lit(t))
    assert tuple(one_row(spark, a=group("cached_current_text_only", "tier_1_partial_near_threshold"), b=group("cached_current_text_only", ""), c=group("?", ""))) == ("find_external_extension", "do_not_rerun_cached_source", "manual_review")
    errors = [E.tier_error(F.lit(t)) for t in ("tier_b_source_description", " ", "tier_d_title_only_triage", "tier_e_blocked", "tier_b_verified_summary")]
    assert tuple(one_row(spark, **{f"x{i}": c for i, c in enumerate(errors)})) == ("", "missing_evidence_tier", "unimportable_evidence_tier", "unimportable_evidence_tier", "invalid_evidence_tier")


def test_preflight(spark):
    a = spark.createDataFrame([("a1", "10.1/x", "Alpha beta gamma", "2000"), ("a2", "10.1/d", "Delta", "2001")], "article_id string, doi string, title string, publication_year string")
    cols = "row_number int, recovery_batch string, split_group string, article_id string, doi string, title string, publication_year string, abstract string, source string, source_url string, source_record_id string, evidence_tier string"
    tier = "tier_a_formal_abstract"
    rows_ = [(1, "R1", "g", "a1", "", "", "", "text", "s", "u", "", tier), (2, "R1", "g", "a2", "", "", "", "", "", "", "", ""), (3, "R1", "h", "a2", "", "", "", "text", "s", "", "", tier), (4, "R2", "g", "a2", "", "", "", "", "", "", "", ""), (5, "R2", "h", "a1", "", "", "", "text", "s", "u", "", "tier_e_blocked")]
    summary, errors = W.import_preflight(spark.createDataFrame(rows_, cols), a)
    got = {(r["recovery_batch"], r["split_group"]): (r["preflight_status"], r["total_rows"], r["skipped_empty_abstract_rows"], r["import_ready_rows"], r["error_rows"]) for r in summary.collect()}
    assert got == {("R1", "g"): ("pass_ready", 2, 1, 1, 0), ("R1", "h"): ("blocked_errors", 1, 0, 0, 1), ("R2", "g"): ("pass_empty", 1, 1, 0, 0), ("R2", "h"): ("blocked_errors", 1, 0, 0, 1)}
    assert {r["row_number"]: r["error"] for r in errors.collect()} == {3: "missing_source_locator", 5: "unimportable_evidence_tier"}


def test_top_values_count_before_they_cut(spark):
    from folioscope.operators import attempts as A

    long = "x" * 150
    df = spark.createDataFrame([("k", long + "1"), ("k", long + "2"), ("k", "short"), ("k", "short")], "k string, v string")
    assert A.top_values(df, ["k"], "v", 2, "top").first()["top"] == f"short (2); {'x' * 137}... (1)"


def test_json_pages(spark, tmp_path):
    page = {"metadata": {"journal_short": "aer", "journal": "A", "query_url": "u"}, "response": {"message": {"items": [{"DOI": "10.1/A", "title": ["T &amp; U"], "issued": {"date-parts": [[2001, 5]]}, "page": "1-9", "type": "journal-article", "author": [{"given": "Ann", "family": "Lee", "affiliation": [{"name": "X"}]}]}, {"DOI": "10.1/B", "title": [], "issued": {"date-parts": [[1950]]}}, {"DOI": "10.1/C"}]}}}
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x_page_1.json").write_text(json.dumps(page))
    (tmp_path / "a" / "x_page_2_error.json").write_text("{}")
    got = {r["doi"]: r for r in pages.crossref_records(spark, str(tmp_path / "a"), 1975, 2025).collect()}
    assert set(got) == {"10.1/a", "10.1/c"} and got["10.1/a"]["title"] == "T & U" and got["10.1/a"]["publication_date"] == "2001-05-01" and got["10.1/a"]["author_names"] == "Ann Lee" and got["10.1/a"]["last_page"] == "9"
    other = {"metadata": {"journal_short": "aer"}, "response": {"results": [{"id": "W1", "doi": "https://doi.org/10.1/A", "title": "T", "publication_year": 2001, "abstract_inverted_index": {"b": [1], "a": [0]}, "keywords": [{"display_name": "k"}], "topics": [{"display_name": "j"}], "authorships": [{"author": {"display_name": "Ann Lee"}, "institutions": [{"display_name": "X"}]}]}]}}
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "y_page_1.json").write_text(json.dumps(other))
    r = pages.openalex_records(spark, str(tmp_path / "b"), 1975, 2025).first()
    assert (r["abstract"], r["keywords"], r["author_names"], r["doi"]) == ("a b", "j|k", "Ann Lee", "10.1/a")


def test_string_tables(spark, tmp_path):
    df = spark.createDataFrame([("1", 'a "quoted", text\nline', ["x", "y"])], "id string, t string, l array<string>")
    tables.write_strings(df, str(tmp_path / "t"))
    assert [tuple(r) for r in tables.read_strings(spark, str(tmp_path / "t"), ["id", "t", "l"]).collect()] == [("1", 'a "quoted", text\nline', "x|y")]
    assert tables.read_strings(spark, str(tmp_path / "none"), ["id"]).count() == 0
    tables.write_packets(df.select("id", F.lit("B001").alias("batch_id")), str(tmp_path / "p"))
    assert (tmp_path / "p" / "batch_id=B001").exists()


def test_local_evidence_joins_one_row_a_key(spark):
    """Of a DOI or title that many records have, queue rows meet its best record and count alone."""
    from folioscope.operators import routing as R

    texts = ["", "short", "x " * 200, "All rights reserved. " + "y " * 300, "z " * 150, "z " * 150]
    records = [(f"10.1/{i % 2}" if i % 3 else "", f"Title {i % 2}", "aer", "2001", texts[i % 6], "s" + str(i % 4), i) for i in range(40)]
    queue = [(str(i), f"10.1/{i % 3}" if i % 4 else "", f"Title {i % 2}" if i % 5 else "", "aer", "2001", "300") for i in range(30)]
    r = spark.createDataFrame(records, "doi string, title string, journal_short string, publication_year string, abstract string, source string, record_order long")
    q = spark.createDataFrame(queue, "article_id string, doi string, title string, journal_short string, publication_year string, current_text_chars string")
    out = R.local_evidence(q, r)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") >= 3  # each key's records are one row before the join
    got = {x["article_id"]: (x["candidates"], x["source"], x["candidate_text_chars"]) for x in out.collect()}
    want = {}
    for article, doi, title, *_ in queue:
        met = [x for x in records if x[4] and ((x[0] == doi) if doi else x[1] == title)]
        ranked = []
        for x in met:
            bare = " ".join(x[4].replace("All rights reserved", " ").split()).removeprefix(". ").strip()
            size, flagged = len(bare) + (2 if x[4].startswith("All") else 0), x[4].startswith("All")
            chars = size + (len(title) + 1 if title else 0)
            ranked.append((not flagged and chars >= 250, not flagged, chars, -x[6], x[5]))
        want[article] = (len(met), max(ranked)[4], max(ranked)[2]) if met else (0, "", 0)
    assert got == want


def test_prefixes_are_worked_out_for_counted_attempts(spark):
    """Attempts of a DOI, article and source are counted before anything is asked of the DOI; distinct articles and errors as before."""
    from folioscope.operators import attempts as A

    rows = [(str(i % 7), f" HTTPS://doi.org/10.1257/x{i % 5}" if i % 6 else "", f"s{i % 2}", ["found", "error", None, "weird", "not_found"][i % 5], f"e {i % 3}" if i % 5 == 1 else "") for i in range(300)]
    df = spark.createDataFrame(rows, "article_id string, doi string, attempt_source string, attempt_status string, attempt_error string")
    plan = A.by_prefix(df)._jdf.queryExecution().optimizedPlan().toString()
    lowest = [line for line in plan.splitlines() if "Aggregate" in line][-1]
    assert "regexp_replace" not in plan[plan.index(lowest) + len(lowest) :]
    kept = [r for r in rows if r[1]]
    got = A.by_prefix(df).first()
    assert (got["prior_attempted_articles"], got["prior_found_articles"], got["prior_error_attempts"]) == (len({r[0] for r in kept}), len({r[0] for r in kept if r[3] == "found"}), sum(r[3] == "error" for r in kept))
    for r in A.by_prefix_source(df).collect():
        mine = [x for x in kept if x[2] == r["attempt_source"]]
        errors = {e: sum(x[4] == e for x in mine if x[3] == "error") for e in ("e 0", "e 1", "e 2")}
        best = sorted(((-n, e) for e, n in errors.items() if n))[:2]
        assert (r["attempt_rows"], r["attempted_articles"], r["other_attempts"]) == (len(mine), len({x[0] for x in mine}), sum(x[3] in (None, "weird") for x in mine))
        assert r["top_errors"] == "; ".join(f"{e} ({-n})" for n, e in best)


def test_review_queue_ranks_without_texts(spark):
    """Flags and states are made of the texts; ranking need not write and sort them."""
    from folioscope.operators import routing as R

    rows = [(str(i), "t", "10.1/x", "aer", "2001", "ready_partial_text_extension", "", "9", "All rights reserved." if i % 2 else "Text", "", "", "", "", str(i)) for i in range(6)]
    names = "article_id title doi journal_short publication_year split_group row_status current_text_chars current_abstract abstract source source_url source_record_id recovery_rank".split()
    df = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
    whole, bare = R.review_queue(df), R.review_queue(df, texts=False)
    assert {"current_abstract", "abstract"} & set(bare.columns) == set()
    assert sorted(map(tuple, whole.select(*bare.columns).collect())) == sorted(map(tuple, bare.collect()))


def test_attempts_are_counted_once_for_all_summaries(spark):
    from folioscope.operators import attempts as A

    rows = [("10.1257/x", f"a{i % 4}", f"s{i % 3}", ["found", "error", "other", None][i % 4], "e") for i in range(40)] + [("", "a9", "s1", "found", "")]
    df = spark.createDataFrame(rows, "doi string, article_id string, attempt_source string, attempt_status string, attempt_error string")
    known = A.counted_attempts(df)
    assert sorted(map(tuple, A.by_prefix(df, known).collect())) == sorted(map(tuple, A.by_prefix(df).collect()))
    whole = A.by_prefix_source(df)
    assert sorted(map(tuple, A.by_prefix_source(df, known).collect())) == sorted(map(tuple, whole.collect()))
    assert sorted(map(tuple, A.by_prefix_source(df, known, errors=False).collect())) == sorted(map(tuple, whole.drop("top_errors").collect()))


def test_equal_attempts_of_a_batch_are_put_together_before_they_are_sorted(spark):
    from folioscope.operators import routing as R

    one = spark.createDataFrame([("1",), ("2",)], "article_id string")
    seen = spark.createDataFrame([("1", "b"), ("1", "a"), ("1", "a"), ("3", "a")] * 50, "article_id string, attempt_status string")
    out = R.batch_with_context(one, one.selectExpr("article_id", "'w' as row_status"), one.selectExpr("article_id", "'j' as journal_short"), seen)
    assert sorted(map(tuple, out.select("article_id", "row_status", "journal_short", "attempt_status").collect())) == [("1", "w", "j", "a"), ("2", "w", "j", None)]
    assert "Aggregate [article_id" in out._jdf.queryExecution().optimizedPlan().toString()


def test_dashes_are_read_as_hyphens():
    from folioscope.functions.features import plain_dashes

    assert plain_dashes("a‐b‑c‒d–e—f-g é") == "a-b-c-d-e-f-g é" and plain_dashes("plain") == "plain"
