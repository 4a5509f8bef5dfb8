"""Queries over source records, attempts, labels and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.operators import attempts as A
from folioscope.operators import enrich as E
from folioscope.operators import labels as L
from folioscope.operators import link as K
from folioscope.operators import rank as N
from folioscope.operators import sample as M
from folioscope.operators import shares as S
from folioscope.operators import titles as Y
from folioscope.plans import sqltext as Q
from folioscope.plans.article_queries import classified
from folioscope.plans.bindings import SQL as B
from folioscope.plans.bindings import articles, records, table, validation


def link_articles(spark, sf_dir):
    out = K.link_articles(records(spark, sf_dir), ["source", "source_record_id"])
    return out.select("article_id", "title", "volume", "article_type", "publication_year", F.md5(F.col("abstract").cast("binary")).alias("abstract_md5"), "abstract_source", "title_source", "article_type_source", "primary_source", "source_record_count", "duplicate_resolution_rule", "metadata_warning")


def source_overlap(spark, sf_dir):
    return K.source_overlap(records(spark, sf_dir))


def duplicate_dois(spark, sf_dir):
    return K.duplicate_dois(records(spark, sf_dir))


def coverage_by_source(spark, sf_dir):
    return K.coverage_by_source(records(spark, sf_dir))


def missingness(spark, sf_dir):
    return K.missingness(articles(spark, sf_dir))


def article_counts(spark, sf_dir):
    return K.article_counts(articles(spark, sf_dir))


def source_totals(spark, sf_dir):
    return K.source_totals(records(spark, sf_dir))


def validation_errors(spark, sf_dir):
    return L.validate_labels(validation(spark, sf_dir))


def merge_labels(spark, sf_dir):
    v = validation(spark, sf_dir)
    return L.merge_labels(v.withColumn("manual_label", F.lit("")), v.where("review_date = '2024-01-05' and manual_label <> ''")).select("validation_id", "article_id", "manual_label", "manual_confidence", "reviewer_id")


def label_drift(spark, sf_dir):
    a = articles(spark, sf_dir).select("article_id", "title", "doi", "journal_short")
    sample = a.withColumns({"doi": F.when(F.col("article_id").endswith("3"), "").otherwise(F.col("doi")), "journal_short": F.when(F.col("article_id").endswith("7"), "x").otherwise(F.col("journal_short"))})
    return L.drift(sample, a.where("not endswith(article_id, '9')"), ["title", "doi", "journal_short"])


def label_completion(spark, sf_dir):
    return L.completion(validation(spark, sf_dir), ["manual_confidence"])


def _submissions(spark, sf_dir):
    return table(spark, sf_dir, "conversations").selectExpr("cast(conv_id as string) as item", "concat(role, turn) as reviewer_id", "element_at(array('causal', 'predictive', 'other', ''), length(text) % 4 + 1) as manual_label")


def reviewer_agreement(spark, sf_dir):
    return L.reviewer_agreement(_submissions(spark, sf_dir), ["item"])


def disagreement_packet(spark, sf_dir):
    return L.disagreement_packet(_submissions(spark, sf_dir), ["item"])


_PREFIXES = "'10.1257', '10.1086', '10.2307', '10.1111', '10.3982', '10.7916', '10.5555'"


def attempts(spark, sf_dir):
    """Events as attempts to look up texts."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id", "cast(user_id as string) as article_id", "event_type as attempt_source", f"concat(element_at(array({_PREFIXES}), cast(user_id % 7 as int) + 1), '/x', user_id) as doi",
        "element_at(array('found', 'not_found', 'error', 'rate_limited', 'skipped'), cast(event_id % 5 as int) + 1) as attempt_status",
        "if(event_id % 5 = 2, concat('http_', 400 + event_id % 4), '') as attempt_error", "if(event_id % 5 = 0, concat('abstract ', event_id), '') as abstract", "if(event_id % 6 = 0, concat('https://example.org/', event_id, '.pdf'), '') as oa_pdf_url",
    )


def attempts_by_prefix_source(spark, sf_dir):
    return A.by_prefix_source(attempts(spark, sf_dir))


def attempts_by_prefix(spark, sf_dir):
    return A.by_prefix(attempts(spark, sf_dir))


def best_and_worst_source(spark, sf_dir):
    return A.source_context(A.by_prefix_source(attempts(spark, sf_dir)))


def attempt_context(spark, sf_dir):
    return A.article_context(attempts(spark, sf_dir), "event_id")


def attempt_sample(spark, sf_dir):
    return A.sample_attempts(attempts(spark, sf_dir), 5, [F.asc("event_id")]).select("event_id", "attempt_source", "attempt_status", "sample_row")


def first_found(spark, sf_dir):
    """One attempt a source and article, then the first abstract found in order of sources."""
    one = attempts(spark, sf_dir).groupBy("article_id", "attempt_source").agg(F.min(F.struct("event_id", "attempt_status", "abstract", "oa_pdf_url")).alias("x"))
    rows = one.select("article_id", F.col("attempt_source").alias("source"), F.col("x.attempt_status").alias("status"), F.col("x.abstract").alias("abstract"), F.col("x.oa_pdf_url").alias("oa_pdf_url"))
    return E.first_found(rows, ["purchase", "view", "click", "signup", "error"])


def enrichment_candidates(spark, sf_dir):
    return E.filter_candidates(E.candidates(classified(spark, sf_dir), 400), start=1980, end=2010).select("article_id", "current_text_chars", "current_abstract_chars", "has_current_abstract")


def _state(spark, sf_dir, shift):
    """Enrichment rows of documents: those with a label, by their whole text (1), or all, by what follows the title line (2)."""
    docs = table(spark, sf_dir, "documents")
    docs = docs.join(table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_semi") if shift == 1 else docs
    return docs.selectExpr(
        "cast(doc_id as string) as article_id", f"element_at(array('enriched', 'not_found', 'partial_short_text', 'skipped_nonresearch_scope'), cast((doc_id + {shift}) % 4 as int) + 1) as enrichment_status",
        f"element_at(array('openalex', 'crossref', 'oa_pdf_first_pages'), cast((doc_id + {shift}) % 3 as int) + 1) as enrichment_source", f"{'text' if shift == 1 else _REST} as enriched_abstract", "'' as evidence_tier", "'' as enrichment_detail",
        f"if(doc_id % 5 = {shift}, concat('https://example.org/', doc_id, '.pdf'), '') as oa_pdf_url", f"if(doc_id % 3 = {shift}, 'comment_reply', '') as article_scope", "'' as article_scope_reason", f"if(doc_id % 2 = 0, 'openalex|crossref', 'crossref|s{shift}') as attempted_sources",
    )


_REST = "if(instr(text, '\n') > 0, substring(text, instr(text, '\n') + 1), '')"


def upsert_enrichment(spark, sf_dir):
    return E.upsert_enrichment(_state(spark, sf_dir, 1), _state(spark, sf_dir, 2)).drop("enrichment_detail", "article_scope_reason").withColumn("enriched_abstract", F.md5(F.col("enriched_abstract").cast("binary")))


def apply_enrichment(spark, sf_dir):
    out = E.apply_enrichment(articles(spark, sf_dir), _state(spark, sf_dir, 1), 60)
    return out.select("article_id", "text_enrichment_status", "text_enrichment_source", "text_enrichment_evidence_tier", "text_enrichment_chars", "abstract_source", F.md5(F.col("abstract").cast("binary")).alias("abstract_md5"))


def append_log(spark, sf_dir):
    a = attempts(spark, sf_dir).select("article_id", "attempt_source", "attempt_status")
    return E.append_log(a.where("attempt_status <> 'found'"), a, "new.csv")


def backfill_match(spark, sf_dir):
    """Every document as a backfill row: the long ones by id, others by DOI where they have one, else by title."""
    a = articles(spark, sf_dir)
    rows = a.selectExpr("cast(article_id as long) as row_number", "if(length(abstract) > 1000, article_id, '') as article_id", "if(length(abstract) > 1000, '', doi) as doi", "title", "publication_year", "'recovered' as abstract")
    return E.match_backfill(rows, a)


def title_bound_pairs(spark, sf_dir):
    """Titles of one year whose characters allow a ratio of 0.9."""
    t = N.global_rank(articles(spark, sf_dir).select("publication_year", T.title_key("title").alias("t")).distinct(), [F.asc("t"), F.asc("publication_year")], "n")
    side = lambda n: t.select("publication_year", F.col("n").alias(n), "t", F.md5(F.col("t").cast("binary")).alias(f"{n}_md5"))
    return Y.overlapping(side("l"), side("r"), 0.9, ["publication_year"], ordered=True).select("publication_year", "l_md5", "r_md5", "overlap")


def strata(spark, sf_dir):
    return M.with_strata(classified(spark, sf_dir)).groupBy("stratum", "is_ambiguous").agg(F.count("*").alias("n"))


def validation_sample(spark, sf_dir):
    return M.sample_rows(classified(spark, sf_dir), 200).select("article_id", "stratum_category", "stratum_decade", "is_ambiguous")


def impact_summary(spark, sf_dir):
    c = classified(spark, sf_dir).select("article_id", "journal_short", T.decade("publication_year").alias("decade"), F.col("causal_predictive_category").alias("category"), F.col("classification_text_chars").alias("chars"))
    after = c.withColumn("category", F.when(F.col("article_id").endswith("2"), F.when(F.col("category") == "other", "insufficient_text").otherwise("other")).otherwise(F.col("category")))
    return A.impact_summary(A.impact(c, after), ["journal_short", "decade", "before_category"])


def tier_counts(spark, sf_dir):
    return S.shares(articles(spark, sf_dir), ["journal_short"], "text_enrichment_status")


QUERIES = {f.__name__: f for f in (link_articles, source_overlap, duplicate_dois, coverage_by_source, missingness, article_counts, source_totals, validation_errors, merge_labels, label_drift, label_completion, reviewer_agreement, disagreement_packet, attempts_by_prefix_source, attempts_by_prefix, best_and_worst_source, attempt_context, attempt_sample, first_found, enrichment_candidates, upsert_enrichment, apply_enrichment, append_log, backfill_match, title_bound_pairs, strata, validation_sample, impact_summary, tier_counts)}

_R = f"WITH {B['records']}, keyed AS (SELECT *, {Q.title_key('title')} AS tk, CASE WHEN doi <> '' THEN 'doi' ELSE 'title_journal_year' END AS rule, CASE WHEN doi <> '' THEN lower(doi) ELSE journal_short || '|' || publication_year || '|' || {Q.title_key('title')} END AS link_key FROM records)"


def _pick(field: str, first: str) -> str:
    return f"first(STRUCT_PACK(v := {field}, s := source) ORDER BY CASE WHEN source = '{first}' THEN 0 ELSE 1 END, source, source_record_id) FILTER ({Q.collapse(field)} <> '')"


def _normal(field: str) -> str:
    if field == "title":
        return "tk"
    if field == "article_type":
        return "CASE WHEN article_type IN ('article', 'journal-article') THEN 'article' ELSE article_type END"
    return f"lower({field})"


_SUBMISSIONS = "WITH s AS (SELECT CAST(conv_id AS VARCHAR) AS item, role || turn AS reviewer_id, ['causal', 'predictive', 'other', ''][length(text) % 4 + 1] AS manual_label FROM conversations), i AS (SELECT item, count(*) AS n, count(DISTINCT reviewer_id) AS r, count(DISTINCT manual_label) AS l, array_to_string(list_sort(list(DISTINCT reviewer_id || '=' || manual_label)), '|') AS reviewer_labels FROM s WHERE manual_label <> '' GROUP BY 1)"
_ATTEMPTS = f"""WITH a AS (SELECT event_id, CAST(user_id AS VARCHAR) AS article_id, event_type AS attempt_source, [{_PREFIXES}][user_id % 7 + 1] AS doi_prefix, ['found', 'not_found', 'error', 'rate_limited', 'skipped'][event_id % 5 + 1] AS attempt_status,
 CASE WHEN event_id % 5 = 2 THEN 'http_' || (400 + event_id % 4) ELSE '' END AS attempt_error, CASE WHEN event_id % 5 = 0 THEN 'abstract ' || event_id ELSE '' END AS abstract, CASE WHEN event_id % 6 = 0 THEN 'https://example.org/' || event_id || '.pdf' ELSE '' END AS oa_pdf_url FROM events)"""
_BY = f"""{_ATTEMPTS}, n AS (SELECT doi_prefix, attempt_source, count(*) AS attempt_rows, count(DISTINCT article_id) AS attempted_articles, count(DISTINCT CASE WHEN attempt_status = 'found' THEN article_id END) AS found_articles,
 {", ".join(f"count(*) FILTER (attempt_status = '{s}') AS {s}_attempts" for s in A.STATUSES)}, CAST(0 AS BIGINT) AS other_attempts FROM a GROUP BY 1, 2),
e AS (SELECT doi_prefix, attempt_source, attempt_error, count(*) AS c FROM a WHERE attempt_error <> '' GROUP BY 1, 2, 3), t AS (SELECT *, row_number() OVER (PARTITION BY doi_prefix, attempt_source ORDER BY c DESC, attempt_error) AS k FROM e),
s AS (SELECT doi_prefix, attempt_source, string_agg(attempt_error || ' (' || c || ')', '; ' ORDER BY k) AS top_errors FROM t WHERE k <= 2 GROUP BY 1, 2),
summary AS (SELECT n.*, coalesce(top_errors, '') AS top_errors FROM n LEFT JOIN s USING (doi_prefix, attempt_source))"""
#: For queries that have other tables in WITH: prior attempts by prefix, best and worst source.
PRIOR = f"""{_BY.removeprefix("WITH ")}, prior AS (SELECT doi_prefix, count(DISTINCT article_id) AS prior_attempted_articles, count(DISTINCT CASE WHEN attempt_status = 'found' THEN article_id END) AS prior_found_articles, {", ".join(f"count(*) FILTER (attempt_status = '{s}') AS prior_{s}_attempts" for s in A.FAILED)} FROM a GROUP BY 1),
tried AS (SELECT *, {" + ".join(f"{s}_attempts" for s in A.FAILED)} AS failed FROM summary), ranked AS (SELECT *, row_number() OVER (PARTITION BY doi_prefix ORDER BY found_articles DESC, found_attempts DESC, attempt_rows DESC, attempt_source) AS b, row_number() OVER (PARTITION BY doi_prefix ORDER BY failed DESC, attempt_rows DESC, attempt_source) AS w FROM tried),
context AS (SELECT x.doi_prefix, x.attempt_source AS best_prior_source, x.found_articles AS best_prior_source_found_articles, y.attempt_source AS top_failure_source, y.failed AS top_failure_attempts FROM ranked x JOIN ranked y ON x.doi_prefix = y.doi_prefix AND x.b = 1 AND y.w = 1)"""


def _state_sql(shift: int) -> str:
    return f"""(SELECT CAST(doc_id AS VARCHAR) AS article_id, ['enriched', 'not_found', 'partial_short_text', 'skipped_nonresearch_scope'][(doc_id + {shift}) % 4 + 1] AS st, ['openalex', 'crossref', 'oa_pdf_first_pages'][(doc_id + {shift}) % 3 + 1] AS so,
 {"text" if shift == 1 else "CASE WHEN instr(text, chr(10)) > 0 THEN substr(text, instr(text, chr(10)) + 1) ELSE '' END"} AS ab, CASE WHEN doc_id % 5 = {shift} THEN 'https://example.org/' || doc_id || '.pdf' ELSE '' END AS pdf, CASE WHEN doc_id % 3 = {shift} THEN 'comment_reply' ELSE '' END AS sc, CASE WHEN doc_id % 2 = 0 THEN ['openalex', 'crossref'] ELSE ['crossref', 's{shift}'] END AS att FROM documents{" WHERE doc_id IN (SELECT doc_id FROM labels)" if shift == 1 else ""})"""


_TIER = "CASE WHEN st <> 'enriched' THEN '' WHEN so = 'oa_pdf_first_pages' THEN 'tier_c_first_page_abstract_or_intro' ELSE 'tier_a_formal_abstract' END"
_C = f"WITH {Q.CLASSIFIED}"
SQL = {
    "title_bound_pairs": f"""WITH {B['articles']}, t AS (SELECT DISTINCT publication_year, {Q.title_key('title')} AS t FROM articles), n AS (SELECT *, list_transform(string_split({Q.lit(Y.ALPHABET)}, ''), lambda c: length(t) - length(replace(t, c, ''))) AS n FROM t WHERE t <> ''),
p AS (SELECT l.publication_year, md5(l.t) AS l_md5, md5(r.t) AS r_md5, length(l.t) + length(r.t) AS size, list_sum(list_transform(range(1, {len(Y.ALPHABET) + 1}), lambda i: least(l.n[i], r.n[i]))) AS overlap FROM n l JOIN n r ON l.publication_year = r.publication_year AND l.t < r.t)
SELECT publication_year, l_md5, r_md5, CAST(overlap AS INTEGER) AS overlap FROM p WHERE overlap >= ceil(size * 0.45 - 1e-9)""",
    "link_articles": f"""{_R}, g AS (SELECT rule, link_key, {_pick("title", "crossref")} AS ti, {_pick("volume", "crossref")} AS vo, {_pick("article_type", "crossref")} AS ty, {_pick("publication_year", "crossref")} AS ye, {_pick("abstract", "openalex")} AS ab, {_pick("doi", "crossref")} AS dd, {_pick("journal_short", "crossref")} AS jo,
 bool_or(source = 'crossref') AS cr, count(*) AS n, {", ".join(f"count(DISTINCT {_normal(f)}) FILTER ({Q.collapse(f)} <> '') > 1 AS d_{f}" for f in ("doi", "title", "publication_year", "volume", "article_type"))} FROM keyed GROUP BY 1, 2)
SELECT 'art_' || substr(sha1(CASE WHEN dd.v IS NOT NULL THEN 'doi:' || lower(dd.v) ELSE 'title:' || jo.v || ':' || ye.v || ':' || split_part(link_key, '|', 3) END), 1, 16) AS article_id, coalesce(ti.v, '') AS title, coalesce(vo.v, '') AS volume, coalesce(ty.v, '') AS article_type, CAST(ye.v AS INTEGER) AS publication_year, md5(coalesce(ab.v, '')) AS abstract_md5,
 coalesce(ab.s, '') AS abstract_source, coalesce(ti.s, '') AS title_source, coalesce(ty.s, '') AS article_type_source, CASE WHEN cr THEN 'crossref' ELSE 'openalex' END AS primary_source, n AS source_record_count, rule AS duplicate_resolution_rule,
 array_to_string(list_sort(list_filter([{", ".join(f"CASE WHEN d_{f} THEN 'conflicting_{f}' END" for f in ("doi", "title", "publication_year", "volume", "article_type"))}, CASE WHEN ab.v IS NULL THEN 'missing_abstract' END, CASE WHEN dd.v IS NULL THEN 'missing_doi' END, 'missing_jel_codes', CASE WHEN ty.v NOT IN ('article', 'journal-article') THEN 'nonstandard_article_type' END], lambda v: v IS NOT NULL)), ';') AS metadata_warning FROM g""",
    "source_overlap": f"{_R} SELECT rule, link_key, array_to_string(list_sort(list(DISTINCT source)), '|') AS sources, count(*) AS record_count FROM keyed GROUP BY 1, 2",
    "duplicate_dois": f"{_R} SELECT source, journal_short, doi, count(*) AS record_count FROM keyed WHERE doi <> '' GROUP BY 1, 2, 3 HAVING count(*) > 1",
    "coverage_by_source": f"{_R} SELECT source, journal_short, publication_year, count(*) AS record_count, {', '.join(f'round(avg(CAST({Q.collapse(f)} <> {chr(39)}{chr(39)} AS DOUBLE)), 4) AS {f}_share' for f in ('title', 'publication_year', 'doi', 'abstract', 'jel_codes', 'volume'))} FROM records GROUP BY 1, 2, 3",
    "missingness": f"WITH {B['articles']} " + " UNION ALL ".join(f"SELECT '{c}' AS variable, count(*) FILTER ({Q.collapse(c)} = '') AS missing_count, round(count(*) FILTER ({Q.collapse(c)} = '') / count(*), 4) AS missing_share FROM articles" for c in ("article_id", "title", "abstract", "journal_short", "publication_year", "article_type", "doi", "openalex_id", "oa_pdf_url", "article_url", "text_enrichment_status", "text_enrichment_evidence_tier", "article_scope", "abstract_source")),
    "article_counts": f"WITH {B['articles']} SELECT journal_short, publication_year, count(*) AS article_count FROM articles GROUP BY 1, 2",
    "source_totals": f"{_R} SELECT source, count(*) AS record_count FROM keyed GROUP BY 1",
    "validation_errors": f"WITH {B['validation']} SELECT validation_id, article_id, 'review_date' AS field, review_date AS value, 'invalid_review_date' AS error FROM validation WHERE NOT regexp_matches(review_date, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$')",
    "merge_labels": f"WITH {B['validation']} SELECT validation_id, article_id, CASE WHEN review_date = '2024-01-05' THEN manual_label ELSE '' END AS manual_label, manual_confidence, reviewer_id FROM validation",
    "label_drift": f"""WITH {B["articles"]}, s AS (SELECT article_id, title, CASE WHEN article_id LIKE '%3' THEN '' ELSE doi END AS doi, doi AS d2, CASE WHEN article_id LIKE '%7' THEN 'x' ELSE journal_short END AS j, journal_short AS j2 FROM articles)
SELECT article_id, 'article_id' AS "column", article_id AS sample_value, '' AS current_value, 'missing_in_current' AS issue FROM s WHERE article_id LIKE '%9' UNION ALL SELECT article_id, 'doi', doi, d2, 'value_changed' FROM s WHERE article_id NOT LIKE '%9' AND doi <> d2 UNION ALL SELECT article_id, 'journal_short', j, j2, 'value_changed' FROM s WHERE article_id NOT LIKE '%9' AND j <> j2""",
    "label_completion": f"WITH {B['validation']} SELECT manual_confidence, count(*) AS rows, count(*) FILTER (manual_label <> '') AS completed_rows, count(*) FILTER (manual_label = '') AS remaining_rows, count(*) FILTER (manual_label NOT IN ('', 'causal', 'predictive', 'other', 'insufficient_text')) AS invalid_labels, count(*) FILTER (manual_label <> '' AND manual_confidence = '') AS missing_confidence, count(DISTINCT reviewer_id) FILTER (manual_label <> '') AS reviewers, max(review_date) FILTER (manual_label <> '') AS latest_review_date FROM validation GROUP BY 1",
    "reviewer_agreement": f"{_SUBMISSIONS} SELECT CAST(sum(n) AS BIGINT) AS completed_labels, count(*) AS labeled_items, count(*) FILTER (n >= 2 OR r >= 2) AS comparable_items, count(*) FILTER ((n >= 2 OR r >= 2) AND l = 1) AS unanimous_items, count(*) FILTER ((n >= 2 OR r >= 2) AND l > 1) AS disagreeing_items, round(count(*) FILTER ((n >= 2 OR r >= 2) AND l = 1) / count(*) FILTER (n >= 2 OR r >= 2), 4) AS agreement_rate FROM i",
    "disagreement_packet": f"{_SUBMISSIONS} SELECT item, l AS labels, reviewer_labels FROM i WHERE l > 1",
    "attempts_by_prefix_source": f"{_BY} SELECT * FROM summary",
    "attempts_by_prefix": f"WITH {PRIOR} SELECT * FROM prior",
    "best_and_worst_source": f"WITH {PRIOR} SELECT * FROM context",
    "attempt_context": f"{_ATTEMPTS}, o AS (SELECT article_id, attempt_source || ':' || attempt_status AS p, min(event_id) AS o FROM a GROUP BY 1, 2) SELECT article_id, string_agg(p, '|' ORDER BY o, p) AS attempt_context, count(*) AS attempt_kinds FROM o GROUP BY 1",
    "attempt_sample": f"{_ATTEMPTS}, d AS (SELECT min(event_id) AS event_id, article_id, attempt_source, attempt_status, attempt_error FROM a GROUP BY 2, 3, 4, 5), k AS (SELECT *, row_number() OVER (PARTITION BY attempt_source, attempt_status ORDER BY event_id) AS sample_row FROM d) SELECT event_id, attempt_source, attempt_status, CAST(sample_row AS INTEGER) AS sample_row FROM k WHERE sample_row <= 5",
    "first_found": f"""{_ATTEMPTS}, one AS (SELECT article_id, attempt_source AS source, coalesce(list_position(['purchase', 'view', 'click', 'signup', 'error'], attempt_source), 6) AS o, arg_min(attempt_status, event_id) AS status, arg_min(abstract, event_id) AS abstract, arg_min(oa_pdf_url, event_id) AS pdf FROM a GROUP BY ALL),
x AS (SELECT article_id, arg_min(STRUCT_PACK(o := o, source := source, status := status, abstract := abstract), o) FILTER (status = 'rate_limited' OR status = 'found' AND abstract <> '') AS s, arg_min(STRUCT_PACK(o := o, source := source, pdf := pdf), o) FILTER (pdf <> '') AS p, bool_and(status IN ('skipped', 'not_cached')) AS idle, count(*) AS attempts FROM one GROUP BY 1)
SELECT article_id, CASE WHEN s IS NOT NULL THEN s.status WHEN idle THEN 'skipped' ELSE 'not_found' END AS status, CASE WHEN s IS NOT NULL THEN s.source ELSE coalesce(p.source, '') END AS source, CASE WHEN s IS NOT NULL AND s.status = 'found' THEN s.abstract ELSE '' END AS abstract,
CASE WHEN p IS NOT NULL AND (s IS NULL OR s.status = 'found' AND p.o <= s.o) THEN p.pdf ELSE '' END AS oa_pdf_url, attempts FROM x""",
    "enrichment_candidates": f"{_C} SELECT article_id, CAST(chars AS INTEGER) AS current_text_chars, CAST(length({Q.clean('abstract')}) AS INTEGER) AS current_abstract_chars, length({Q.clean('abstract')}) > 0 AS has_current_abstract FROM classified WHERE (category = 'insufficient_text' OR chars < 400) AND CAST(publication_year AS INTEGER) BETWEEN 1980 AND 2010",
    "upsert_enrichment": f"""WITH p AS {_state_sql(1)}, c AS {_state_sql(2)}, r AS (SELECT *, CASE st WHEN 'enriched' THEN 60 WHEN 'partial_short_text' THEN 40 WHEN 'not_found' THEN 30 ELSE 10 END AS k FROM p), q AS (SELECT *, CASE st WHEN 'enriched' THEN 60 WHEN 'partial_short_text' THEN 40 WHEN 'not_found' THEN 30 ELSE 10 END AS k FROM c),
j AS (SELECT coalesce(r.article_id, q.article_id) AS article_id, r.article_id IS NULL OR q.article_id IS NOT NULL AND (q.sc = 'comment_reply' AND q.st = 'skipped_nonresearch_scope' OR q.k >= r.k) AS w, r.article_id IS NOT NULL AND q.article_id IS NOT NULL AS b2, r.st AS rst, q.st AS qst, r.so AS rso, q.so AS qso, r.ab AS rab, q.ab AS qab, r.pdf AS rpdf, q.pdf AS qpdf, r.sc AS rsc, q.sc AS qsc, r.att AS ratt, q.att AS qatt FROM r FULL JOIN q ON r.article_id = q.article_id),
b AS (SELECT article_id, CASE WHEN w THEN qst ELSE rst END AS st, CASE WHEN w THEN qso ELSE rso END AS so, CASE WHEN w THEN qab ELSE rab END AS ab, CASE WHEN w THEN coalesce(nullif(qpdf, ''), rpdf, '') ELSE coalesce(nullif(rpdf, ''), qpdf, '') END AS oa_pdf_url,
 CASE WHEN b2 AND qsc <> '' THEN qsc WHEN w THEN qsc ELSE rsc END AS article_scope, CASE WHEN w THEN list_concat(qatt, coalesce(ratt, [])) ELSE list_concat(ratt, coalesce(qatt, [])) END AS l FROM j)
SELECT article_id, st AS enrichment_status, so AS enrichment_source, md5(ab) AS enriched_abstract, CASE WHEN {Q.collapse('ab')} = '' THEN '' ELSE {_TIER} END AS evidence_tier, oa_pdf_url, article_scope, array_to_string(list_filter(l, lambda v, i: list_position(l, v) = i), '|') AS attempted_sources FROM b""",
    "apply_enrichment": f"""WITH {B["articles"]}, e AS {_state_sql(1)}, f AS (SELECT *, {Q.clean("ab")} AS raw, {Q.strip("ab")} AS cab, {Q.flags("ab")} AS fl FROM e),
n AS (SELECT a.*, f.st, f.so, f.raw, f.cab, f.fl, f.article_id IS NOT NULL AS has, length({Q.clean("title")}) AS tl, length({Q.strip("abstract")}) AS al FROM articles a LEFT JOIN f USING (article_id)),
m AS (SELECT *, CASE WHEN cab <> '' THEN tl + length(cab) + CASE WHEN tl > 0 THEN 1 ELSE 0 END ELSE 0 END AS chars, tl + al + CASE WHEN tl > 0 AND al > 0 THEN 1 ELSE 0 END AS cur FROM n),
d AS (SELECT *, CASE WHEN NOT has THEN 'not_needed' WHEN st = 'enriched' AND fl <> '' AND chars < 60 THEN 'partial_short_text' ELSE st END AS st2 FROM m), g AS (SELECT *, st2 = 'enriched' AND coalesce(cab, '') <> '' AS good FROM d), z AS (SELECT *, good AND (chars >= cur OR cur < 60) AS rep FROM g)
SELECT article_id, st2 AS text_enrichment_status, coalesce(so, '') AS text_enrichment_source, CASE WHEN good THEN {_TIER} ELSE '' END AS text_enrichment_evidence_tier, CASE WHEN coalesce(raw, '') = '' THEN '' ELSE CAST(chars AS VARCHAR) END AS text_enrichment_chars,
CASE WHEN rep THEN 'text_enrichment:' || so ELSE abstract_source END AS abstract_source, md5(CASE WHEN rep THEN cab ELSE abstract END) AS abstract_md5 FROM z""",
    "append_log": f"{_ATTEMPTS} SELECT DISTINCT article_id, attempt_source, attempt_status, 'new.csv' AS import_source_file FROM a UNION SELECT DISTINCT article_id, attempt_source, attempt_status, '' FROM a WHERE attempt_status <> 'found'",
    "strata": f"""{_C}, s AS (SELECT *, CASE WHEN c <= 0 THEN 'none' WHEN c <= 1 THEN 'low' WHEN c <= 3 THEN 'medium' ELSE 'high' END AS cb, CASE WHEN p <= 0 THEN 'none' WHEN p <= 1 THEN 'low' WHEN p <= 3 THEN 'medium' ELSE 'high' END AS pb FROM classified)
SELECT category || '|' || confidence || '|' || CASE WHEN {Q.collapse("abstract")} <> '' THEN 'yes' ELSE 'no' END || '|' || CAST(CAST(publication_year AS INTEGER) // 10 * 10 AS VARCHAR) || '|' || cb || '|' || pb AS stratum, (c > 0 AND p > 0) OR confidence = 'low' AS is_ambiguous, count(*) AS n FROM s GROUP BY 1, 2""",
    "validation_sample": f"""{_C}, w AS (SELECT article_id, category, CAST(CAST(publication_year AS INTEGER) // 10 * 10 AS VARCHAR) AS decade, journal_short, (c > 0 AND p > 0) OR confidence = 'low' AS amb, md5('1|' || article_id) AS d FROM classified),
e AS (SELECT * FROM w WHERE category <> 'insufficient_text'), u AS (SELECT *, 0 AS part FROM (SELECT * FROM w WHERE category = 'insufficient_text' ORDER BY d LIMIT 40) UNION ALL SELECT *, 1 FROM (SELECT * FROM e WHERE amb ORDER BY d LIMIT 70)
 UNION ALL SELECT *, 2 FROM (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY journal_short, decade, category ORDER BY d, article_id) = 1 ORDER BY d LIMIT 200) UNION ALL SELECT *, 9 FROM (SELECT * FROM e ORDER BY d LIMIT 200)),
o AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY part) = 1) SELECT article_id, category AS stratum_category, decade AS stratum_decade, amb AS is_ambiguous FROM o ORDER BY part, d LIMIT 200""",
    "impact_summary": f"""{_C}, b AS (SELECT journal_short, CAST(CAST(publication_year AS INTEGER) // 10 * 10 AS VARCHAR) AS decade, category AS bc, CASE WHEN article_id LIKE '%2' THEN CASE WHEN category = 'other' THEN 'insufficient_text' ELSE 'other' END ELSE category END AS ac, chars FROM classified),
g AS (SELECT 'overall' AS grouping, 'all' AS group_value, * FROM b UNION ALL SELECT 'journal_short', journal_short, * FROM b UNION ALL SELECT 'decade', decade, * FROM b UNION ALL SELECT 'before_category', bc, * FROM b)
SELECT grouping, group_value, count(*) AS rows, count(*) FILTER (bc = 'insufficient_text') AS before_insufficient, count(*) FILTER (ac = 'insufficient_text') AS after_insufficient, count(*) FILTER (bc = 'insufficient_text' AND ac <> 'insufficient_text') AS recovered, count(*) FILTER (bc <> 'insufficient_text' AND ac = 'insufficient_text') AS newly_insufficient,
count(*) FILTER (bc = 'insufficient_text' AND ac <> 'insufficient_text') - count(*) FILTER (bc <> 'insufficient_text' AND ac = 'insufficient_text') AS net_recovered, CAST(trunc(median(chars)) AS INTEGER) AS median_chars FROM g GROUP BY 1, 2""",
    "tier_counts": f"WITH {B['articles']} SELECT journal_short, CASE WHEN text_enrichment_status = '' THEN 'missing' ELSE text_enrichment_status END AS text_enrichment_status, count(*) AS article_count, CAST(sum(count(*)) OVER (PARTITION BY journal_short) AS BIGINT) AS group_total, round(count(*) / sum(count(*)) OVER (PARTITION BY journal_short), 6) AS text_enrichment_status_share FROM articles GROUP BY journal_short, articles.text_enrichment_status",
}
