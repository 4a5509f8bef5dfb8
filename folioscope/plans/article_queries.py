"""Queries over documents as articles: classification, shares, scenarios, trends, labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import features as FT
from folioscope.functions import text as T
from folioscope.operators import classify as C
from folioscope.operators import rank as R
from folioscope.operators import recovery as V
from folioscope.operators import shares as S
from folioscope.plans import sqltext as Q
from folioscope.plans.bindings import RULES, articles, validation
from folioscope.plans.bindings import SQL as B


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.classify(articles(spark, sf_dir), RULES)


def _triage(spark, sf_dir):
    return C.title_triage(C.classify(articles(spark, sf_dir), RULES, titles=True), RULES)


def text_cleaning(spark, sf_dir):
    a = articles(spark, sf_dir)
    return a.select("article_id", F.md5(T.clean("abstract").cast("binary")).alias("clean_md5"), F.md5(T.strip_boilerplate("abstract").cast("binary")).alias("stripped_md5"), T.quality_flags("title", "abstract").alias("flags"), F.length(T.classification_text(["title", "abstract"])).alias("chars"))


def text_features(spark, sf_dir):
    a = articles(spark, sf_dir)
    known = FT.feature_table(a.select("abstract"))
    return FT.with_text_features(a.select("article_id", "abstract"), "abstract", "abstract", known).select("article_id", "abstract_clean_chars", "abstract_stripped_chars", "abstract_flags")


def keys(spark, sf_dir):
    a = articles(spark, sf_dir)
    rule, key = T.link_key("doi", "journal_short", "publication_year", "title")
    return a.select("article_id", T.doi(F.concat(F.lit(" HTTPS://doi.org/"), "doi")).alias("doi"), T.title_key("title").alias("title_key"), T.article_id("doi", "journal_short", "publication_year", "title").alias("key_id"), rule.alias("rule"), key.alias("link_key"), T.decade("publication_year").alias("decade"), T.stable_key("article_id", "title").alias("stable"))


def classify_rules(spark, sf_dir):
    return classified(spark, sf_dir).select("article_id", "causal_predictive_category", "classification_confidence", "causal_language_indicator", "predictive_language_indicator", "causal_language_terms", "predictive_language_terms", "classification_text_chars", "classification_text_quality_flags")


def title_triage(spark, sf_dir):
    return _triage(spark, sf_dir).select("article_id", "title_only_suggested_category", "title_only_confidence")


def category_shares(spark, sf_dir):
    return S.category_shares(classified(spark, sf_dir), ["journal_short", "publication_year"])


def confidence_distribution(spark, sf_dir):
    return S.confidence_distribution(classified(spark, sf_dir), ["journal_short"])


def insufficient_rates(spark, sf_dir):
    return S.insufficient_rates(classified(spark, sf_dir), ["journal_short"])


def abstract_coverage(spark, sf_dir):
    return S.abstract_coverage(articles(spark, sf_dir), ["journal_short"])


def _suggested(spark, sf_dir):
    """Classified rows with what their titles suggest, from one pass over the texts."""
    return C.with_title_suggestion(C.classify(articles(spark, sf_dir), RULES, titles=True), RULES)


def sensitivity_shares(spark, sf_dir):
    return S.sensitivity_shares(_suggested(spark, sf_dir), ["journal_short"])


def tier_shares(spark, sf_dir):
    return S.tier_shares(classified(spark, sf_dir))


def tier_sensitivity_shares(spark, sf_dir):
    return S.tier_sensitivity_shares(classified(spark, sf_dir), ["journal_short"])


def tier_sensitivity_summary(spark, sf_dir):
    return S.tier_sensitivity_summary(classified(spark, sf_dir))


def insufficient_profile(spark, sf_dir):
    return S.insufficient_profile(classified(spark, sf_dir))


def trend_changes(spark, sf_dir):
    rows, _ = S.scope_filter(classified(spark, sf_dir))
    trend = S.category_shares(S.year_window(rows, 1980, 2020), ["publication_year"]).withColumn("scenario", F.lit("baseline"))
    return S.trend_changes(trend, 1980, 2020)


def scope_counts(spark, sf_dir):
    return S.scope_filter(articles(spark, sf_dir))[1]


def _labelled(spark, sf_dir):
    return S.labelled(classified(spark, sf_dir), validation(spark, sf_dir))


def confusion(spark, sf_dir):
    return S.confusion(_labelled(spark, sf_dir))


def category_metrics(spark, sf_dir):
    return S.category_metrics(_labelled(spark, sf_dir))


def agreement_summary(spark, sf_dir):
    return S.agreement_summary(_labelled(spark, sf_dir))


def disagreements(spark, sf_dir):
    return S.disagreements(_labelled(spark, sf_dir)).select("validation_id", "article_id", "manual_label", "predicted_label", "predicted_confidence", "adjudicated_label")


def expansion_gate(spark, sf_dir):
    c = classified(spark, sf_dir)
    return S.expansion_gate(c, S.agreement_summary(S.labelled(c, validation(spark, sf_dir))))


def recovery_queue(spark, sf_dir):
    return V.recovery_queue(_suggested(spark, sf_dir)).select("recovery_rank", "recovery_batch", "recovery_priority", "recovery_priority_score", "recovery_action", "recovery_reason", "article_id", "decade")


def global_rank(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice")
    return R.global_rank(orders, [F.desc("o_totalprice"), F.asc("o_orderkey")]).withColumn("batch", R.batch_id("rank"))


QUERIES = {f.__name__: f for f in (text_cleaning, text_features, keys, classify_rules, title_triage, category_shares, confidence_distribution, insufficient_rates, abstract_coverage, sensitivity_shares, tier_shares, tier_sensitivity_shares, tier_sensitivity_summary, insufficient_profile, trend_changes, scope_counts, confusion, category_metrics, agreement_summary, disagreements, expansion_gate, recovery_queue, global_rank)}

_W = f"WITH {Q.CLASSIFIED}"
_LABELLED = f"""{_W}, {B["validation"]},
labelled AS (SELECT v.validation_id, v.article_id, v.adjudicated_label, CASE WHEN v.adjudicated_label <> '' THEN v.adjudicated_label ELSE v.manual_label END AS m, c.category AS p, c.confidence AS pc
 FROM validation v LEFT JOIN classified c USING (article_id) WHERE v.adjudicated_label <> '' OR v.manual_label <> '')"""
_TIERS = """tiers AS (SELECT *, unnest([{'s': 'baseline_current_labels', 'd': FALSE}, {'s': 'formal_abstract_only', 'd': text_enrichment_evidence_tier NOT IN ('', 'tier_a_formal_abstract')}, {'s': 'no_recovered_text', 'd': text_enrichment_evidence_tier <> ''}]) AS x FROM classified)"""


def _shares(source: str, groups: str, value: str, out: str) -> str:
    g = f"{groups}, " if groups else ""
    part = f"PARTITION BY {groups}" if groups else ""
    return f"SELECT {g}{value} AS {out}, count(*) AS article_count, CAST(sum(count(*)) OVER ({part}) AS BIGINT) AS group_total, round(count(*) / sum(count(*)) OVER ({part}), 6) AS {out}_share FROM {source} GROUP BY {g}{value}"


SQL = {
    "text_features": f"WITH {B['articles']} SELECT article_id, CAST(length({Q.clean('abstract')}) AS INTEGER) AS abstract_clean_chars, CAST(length({Q.strip('abstract')}) AS INTEGER) AS abstract_stripped_chars, {Q.flags('abstract')} AS abstract_flags FROM articles",
    "text_cleaning": f"WITH {B['articles']} SELECT article_id, md5({Q.clean('abstract')}) AS clean_md5, md5({Q.strip('abstract')}) AS stripped_md5, {Q.flags('title', 'abstract')} AS flags, CAST(length(array_to_string(list_filter([{Q.matching(Q.strip('title'))}, {Q.matching(Q.strip('abstract'))}], lambda v: v <> ''), ' ')) AS INTEGER) AS chars FROM articles",
    "keys": f"""WITH {B["articles"]}, k AS (SELECT *, {Q.title_key("title")} AS tk FROM articles)
SELECT article_id, lower(doi) AS doi, tk AS title_key, 'art_' || substr(sha1(CASE WHEN doi <> '' THEN 'doi:' || lower(doi) ELSE 'title:' || journal_short || ':' || publication_year || ':' || tk END), 1, 16) AS key_id,
CASE WHEN doi <> '' THEN 'doi' ELSE 'title_journal_year' END AS rule, CASE WHEN doi <> '' THEN lower(doi) ELSE journal_short || '|' || publication_year || '|' || tk END AS link_key,
CAST(CAST(publication_year AS INTEGER) // 10 * 10 AS VARCHAR) AS decade, substr(sha1(article_id || '|' || {Q.clean("title")}), 1, 24) AS stable FROM k""",
    "classify_rules": f"{_W} SELECT article_id, category AS causal_predictive_category, confidence AS classification_confidence, CAST(c AS INTEGER) AS causal_language_indicator, CAST(p AS INTEGER) AS predictive_language_indicator, array_to_string(ct, '|') AS causal_language_terms, array_to_string(pt, '|') AS predictive_language_terms, CAST(chars AS INTEGER) AS classification_text_chars, flags AS classification_text_quality_flags FROM classified",
    "title_triage": f"{_W} SELECT article_id, suggested AS title_only_suggested_category, title_confidence AS title_only_confidence FROM triage",
    "category_shares": f"{_W} {_shares('classified', 'journal_short, publication_year', 'category', 'category')}",
    "confidence_distribution": f"{_W} {_shares('classified', 'journal_short', 'confidence', 'confidence')}",
    "insufficient_rates": f"{_W} SELECT journal_short, count(*) FILTER (category = 'insufficient_text') AS insufficient_text_count, count(*) AS group_total, round(count(*) FILTER (category = 'insufficient_text') / count(*), 6) AS insufficient_text_share FROM classified GROUP BY 1",
    "abstract_coverage": f"WITH {B['articles']} SELECT journal_short, count(*) FILTER ({Q.collapse('abstract')} <> '') AS abstract_count, count(*) AS group_total, round(count(*) FILTER ({Q.collapse('abstract')} <> '') / count(*), 6) AS abstract_share FROM articles GROUP BY 1",
    "sensitivity_shares": f"""{_W}, cases AS (SELECT c.journal_short, category = 'insufficient_text' AS short, category, suggested FROM classified c LEFT JOIN triage USING (article_id)),
rows_ AS (SELECT 'baseline' AS scenario, journal_short, category FROM cases UNION ALL SELECT 'exclude_insufficient_text', journal_short, category FROM cases WHERE NOT short
 UNION ALL SELECT 'insufficient_text_as_other', journal_short, CASE WHEN short THEN 'other' ELSE category END FROM cases
 UNION ALL SELECT 'title_triage_non_other', journal_short, CASE WHEN short AND suggested IN ('causal', 'predictive') THEN suggested ELSE category END FROM cases
 UNION ALL SELECT 'title_triage_all_suggestions', journal_short, CASE WHEN short AND suggested IN ('causal', 'predictive', 'other') THEN suggested ELSE category END FROM cases)
{_shares("rows_", "scenario, journal_short", "category", "category")}""",
    "tier_shares": f"{_W}, t AS (SELECT category, CASE WHEN text_enrichment_evidence_tier <> '' THEN text_enrichment_evidence_tier WHEN text_enrichment_status = 'enriched' THEN 'missing_recovered_text_tier' ELSE 'no_recovered_text_tier' END AS evidence_tier FROM classified) {_shares('t', 'evidence_tier', 'category', 'category')}",
    "tier_sensitivity_shares": f"{_W}, {_TIERS}, t AS (SELECT x.s AS scenario, journal_short, CASE WHEN x.d THEN 'insufficient_text' ELSE category END AS category FROM tiers) {_shares('t', 'scenario, journal_short', 'category', 'category')}",
    "tier_sensitivity_summary": f"{_W}, {_TIERS}, t AS (SELECT x.s AS scenario, x.d AS d, text_enrichment_evidence_tier <> '' AS r, CASE WHEN x.d THEN 'insufficient_text' ELSE category END AS category FROM tiers) SELECT scenario, count(*) AS rows, count(*) FILTER (r) AS rows_with_recovered_text_tier, count(*) FILTER (d) AS rows_demoted_to_insufficient_text, "
    + ", ".join(f"count(*) FILTER (category = '{c}') AS {c}_count, round(count(*) FILTER (category = '{c}') / count(*), 6) AS {c}_share" for c in ("causal", "predictive", "other", "insufficient_text")) + " FROM t GROUP BY 1",
    "insufficient_profile": f"""{_W}, x AS (SELECT *, category = 'insufficient_text' AS s, CAST(CAST(publication_year AS INTEGER) // 10 * 10 AS VARCHAR) AS decade FROM classified)
SELECT journal_short, decade, count(*) AS rows, count(*) FILTER (s) AS insufficient_rows, count(*) FILTER (s AND doi <> '') AS has_doi_rows, count(*) FILTER (s AND openalex_id <> '') AS has_openalex_rows, count(*) FILTER (s AND oa_pdf_url <> '') AS has_oa_pdf_rows,
count(*) FILTER (s AND {Q.collapse("abstract")} = '') AS missing_abstract_rows, count(*) FILTER (s AND text_enrichment_status = 'partial_short_text') AS partial_short_text_rows, round(count(*) FILTER (s) / count(*), 6) AS insufficient_share FROM x GROUP BY 1, 2""",
    "trend_changes": f"""{_W}, kept AS (SELECT publication_year AS y, category FROM classified WHERE article_scope NOT IN ('review_erratum_paratext', 'comment_reply', 'lecture_address') AND publication_year IN ('1980', '2020')),
n AS (SELECT y, category, count(*) AS n FROM kept GROUP BY ALL), t AS (SELECT y, sum(n) AS t FROM n GROUP BY 1), cats AS (SELECT DISTINCT category FROM n),
s AS (SELECT category, coalesce(a.n, 0) AS an, coalesce(b.n, 0) AS bn, coalesce(ta.t, 0) AS ta_, coalesce(tb.t, 0) AS tb_ FROM cats LEFT JOIN (SELECT * FROM n WHERE y = '1980') a USING (category) LEFT JOIN (SELECT * FROM n WHERE y = '2020') b USING (category) LEFT JOIN t ta ON ta.y = '1980' LEFT JOIN t tb ON tb.y = '2020')
SELECT 'baseline' AS scenario, category, 1980 AS start_year, 2020 AS end_year, CASE WHEN an = 0 THEN 0 ELSE round(an / ta_, 6) END AS start_share, CASE WHEN bn = 0 THEN 0 ELSE round(bn / tb_, 6) END AS end_share,
round((CASE WHEN bn = 0 THEN 0 ELSE round(bn / tb_, 6) END) - (CASE WHEN an = 0 THEN 0 ELSE round(an / ta_, 6) END), 6) AS share_change, CAST(an AS BIGINT) AS start_article_count, CAST(bn AS BIGINT) AS end_article_count, CAST(ta_ AS BIGINT) AS start_group_total, CAST(tb_ AS BIGINT) AS end_group_total FROM s""",
    "scope_counts": f"WITH {B['articles']} SELECT CASE WHEN article_scope = '' THEN 'missing' ELSE article_scope END AS scope, count(*) AS rows, article_scope NOT IN ('review_erratum_paratext', 'comment_reply', 'lecture_address') AS included_in_analysis, CASE WHEN article_scope IN ('review_erratum_paratext', 'comment_reply', 'lecture_address') THEN 'excluded_nonresearch_scope' ELSE '' END AS reason FROM articles GROUP BY ALL",
    "confusion": f"{_LABELLED} SELECT m AS manual_label, " + ", ".join(f"count(*) FILTER (p = '{c}') AS {c}" for c in ("causal", "predictive", "other", "insufficient_text")) + " FROM labelled GROUP BY 1",
    "category_metrics": f"""{_LABELLED}, l AS (SELECT DISTINCT unnest([m, p]) AS label FROM labelled),
k AS (SELECT label, count(*) FILTER (m = label AND p = label) AS tp, count(*) FILTER (p = label) AS pc, count(*) FILTER (m = label) AS mc FROM l, labelled GROUP BY 1),
r AS (SELECT *, CASE WHEN pc > 0 THEN round(tp / pc, 6) END AS pr, CASE WHEN mc > 0 THEN round(tp / mc, 6) END AS re FROM k)
SELECT label, tp AS true_positive, pc AS predicted_count, mc AS manual_count, pr AS precision, re AS recall, CASE WHEN pr + re > 0 THEN round(2 * pr * re / (pr + re), 6) END AS f1 FROM r""",
    "agreement_summary": f"{_LABELLED} SELECT 'available' AS validation_status, count(*) AS labeled_count, round(avg(CAST(m = p AS DOUBLE)), 6) AS agreement_rate, count(*) FILTER (pc = 'high') AS high_confidence_labeled_count, round(avg(CAST(m = p AS DOUBLE)) FILTER (pc = 'high'), 6) AS high_confidence_agreement_rate FROM labelled",
    "disagreements": f"{_LABELLED} SELECT validation_id, article_id, m AS manual_label, p AS predicted_label, pc AS predicted_confidence, adjudicated_label FROM labelled WHERE m <> p",
    "expansion_gate": f"""{_LABELLED}, a AS (SELECT round(avg(CAST({Q.collapse("abstract")} <> '' AS DOUBLE)), 6) AS overall_abstract_share, round(avg(CAST(category = 'insufficient_text' AS DOUBLE)), 6) AS insufficient_text_share FROM classified),
j AS (SELECT min(s) AS min_journal_abstract_share FROM (SELECT round(avg(CAST({Q.collapse("abstract")} <> '' AS DOUBLE)), 6) AS s FROM classified GROUP BY journal_short)), v AS (SELECT round(avg(CAST(m = p AS DOUBLE)) FILTER (pc = 'high'), 6) AS h FROM labelled)
SELECT CASE WHEN overall_abstract_share < 0.8 OR min_journal_abstract_share < 0.6 OR insufficient_text_share > 0.2 THEN 'pause_for_metadata_enrichment' WHEN h < 0.85 THEN 'pause_for_classifier_revision' ELSE 'proceed' END AS recommendation,
array_to_string(list_filter([CASE WHEN overall_abstract_share < 0.8 THEN 'overall_abstract_coverage' END, CASE WHEN min_journal_abstract_share < 0.6 THEN 'journal_abstract_coverage' END, CASE WHEN insufficient_text_share > 0.2 THEN 'insufficient_text_share' END, CASE WHEN h < 0.85 THEN 'high_confidence_agreement' END], lambda v: v IS NOT NULL), '|') AS reasons,
overall_abstract_share, min_journal_abstract_share, insufficient_text_share FROM a, j, v""",
    "recovery_queue": f"""{_W}, q AS (SELECT c.*, coalesce(suggested, '') AS sg, CAST(publication_year AS INTEGER) AS y, (text_enrichment_status = 'partial_short_text' OR abstract_source <> '') AS part FROM classified c LEFT JOIN triage USING (article_id) WHERE category = 'insufficient_text'),
z AS (SELECT *, CASE WHEN y < 1990 THEN 6 WHEN y < 2000 THEN 5 WHEN y < 2010 THEN 3 ELSE 1 END + CASE WHEN part THEN 4 ELSE 3 END + CASE WHEN oa_pdf_url <> '' THEN 5 ELSE 0 END + CASE WHEN doi <> '' THEN 4 ELSE 0 END + CASE WHEN openalex_id <> '' THEN 2 ELSE 0 END + CASE WHEN article_url <> '' THEN 1 ELSE 0 END + CASE WHEN sg IN ('causal', 'predictive') THEN 2 ELSE 0 END AS s FROM q),
r AS (SELECT *, row_number() OVER (ORDER BY s DESC, journal_short, publication_year, title, article_id) AS k FROM z)
SELECT k AS recovery_rank, 'R' || lpad(CAST((k - 1) // 100 + 1 AS VARCHAR), 3, '0') AS recovery_batch, CASE WHEN s >= 16 THEN 'high' WHEN s >= 10 THEN 'medium' ELSE 'low' END AS recovery_priority, CAST(s AS INTEGER) AS recovery_priority_score,
CASE WHEN oa_pdf_url <> '' THEN 'review_oa_pdf_or_first_pages' WHEN part THEN 'extend_existing_short_abstract' WHEN doi <> '' THEN 'recover_abstract_from_doi_or_publisher' WHEN openalex_id <> '' THEN 'review_openalex_or_title_match' WHEN article_url <> '' THEN 'review_article_landing_page' ELSE 'manual_title_year_search' END AS recovery_action,
array_to_string(list_filter([CASE WHEN y < 1990 THEN 'pre_1990_high_missingness' WHEN y < 2000 THEN '1990s_high_missingness' WHEN y < 2010 THEN 'pre_2010_missingness' ELSE 'recent_missingness' END, CASE WHEN part THEN 'partial_text_can_be_extended' ELSE 'missing_abstract' END, CASE WHEN oa_pdf_url <> '' THEN 'oa_pdf_available' END, CASE WHEN doi <> '' THEN 'doi_available' END, CASE WHEN openalex_id <> '' THEN 'openalex_id_available' END, CASE WHEN article_url <> '' THEN 'article_landing_url_available' END, CASE WHEN sg IN ('causal', 'predictive') THEN 'title_triage_' || sg END], lambda v: v IS NOT NULL), '|') AS recovery_reason,
article_id, CAST(y // 10 * 10 AS VARCHAR) AS decade FROM r""",
    "global_rank": "SELECT o_orderkey, o_totalprice, r AS rank, 'R' || CASE WHEN length(CAST((r - 1) // 100 + 1 AS VARCHAR)) >= 3 THEN CAST((r - 1) // 100 + 1 AS VARCHAR) ELSE lpad(CAST((r - 1) // 100 + 1 AS VARCHAR), 3, '0') END AS batch FROM (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders)",
}
