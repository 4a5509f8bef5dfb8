"""The tables at hand as the tables of the model. Each function has the same rows in SQL under its name in WITH."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Frequent words and word pairs of the documents at hand, as rules that fire on them.
RULES = {
    "text_fields": ["title", "abstract"], "minimum_chars": 250, "strong_weight": 2, "moderate_weight": 1, "dominance_margin": 2,
    "causal": {"strong": ["that the", "with the", "un-known"], "moderate": ["that", "was", "there", "les", "der"]},
    "predictive": {"strong": ["of the", "and that"], "moderate": ["from", "this", "des", "und"]},
}


#: DOI prefixes with and without a lane of their own.
_PREFIXES = "'10.1257', '10.1086', '10.2307', '10.1111', '10.1093', '10.3982', '10.5555', '10.7916', '10.1162'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as articles: the first line is the title, the rest the abstract; year, DOI and other handles follow from doc_id."""
    return table(spark, sf_dir, "documents").selectExpr(
        "cast(doc_id as string) as article_id",
        "substring_index(text, '\n', 1) as title",
        "if(instr(text, '\n') > 0, substring(text, instr(text, '\n') + 1), '') as abstract",
        "source as journal_short",
        "cast(1975 + doc_id % 51 as string) as publication_year",
        "lang as article_type",
        f"if(doc_id % 7 = 0, '', concat(element_at(array({_PREFIXES}), cast(doc_id % 9 as int) + 1), '/', lang, '.', doc_id)) as doi",
        "if(doc_id % 3 = 0, concat('W', doc_id), '') as openalex_id",
        "if(doc_id % 11 = 0, concat('https://example.org/', doc_id, '.pdf'), '') as oa_pdf_url",
        "if(doc_id % 5 = 0, '', concat('https://example.org/', doc_id)) as article_url",
        "element_at(array('', 'enriched', 'partial_short_text', 'not_found'), cast(doc_id % 4 as int) + 1) as text_enrichment_status",
        "element_at(array('', 'tier_a_formal_abstract', 'tier_b_first_pages'), cast(doc_id % 3 as int) + 1) as text_enrichment_evidence_tier",
        "element_at(array('research', 'comment_reply', '', 'lecture_address', 'research'), cast(doc_id % 5 as int) + 1) as article_scope",
        "if(doc_id % 4 = 1, '', source) as abstract_source",
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records of two sources: the first gives what follows the title line, which may be nothing, the second the whole text."""
    docs = table(spark, sf_dir, "documents")
    common = ["cast(doc_id as string) as source_record_id", "source as journal_short", "cast(1975 + doc_id % 51 as string) as publication_year", "if(doc_id % 5 = 0, '', concat('10.1000/', doc_id % 400)) as doi", "'' as jel_codes", "substring_index(text, '\n', 1) as title"]
    a = docs.selectExpr(*common, "'crossref' as source", "if(instr(text, '\n') > 0, substring(text, instr(text, '\n') + 1), '') as abstract", "cast(doc_id % 40 as string) as volume", "'journal-article' as article_type")
    b = docs.selectExpr(*common, "'openalex' as source", "text as abstract", "if(doc_id % 2 = 0, '', cast(doc_id % 41 as string)) as volume", "if(doc_id % 4 = 0, 'report', 'article') as article_type")
    return a.unionByName(b)


def validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of documents as manual labels; some adjudicated."""
    return table(spark, sf_dir, "labels").selectExpr(
        "concat('VAL', doc_id) as validation_id", "cast(doc_id as string) as article_id",
        "case when doc_id % 13 = 0 then '' when toxic = 1 then 'causal' when quality = 1 then 'predictive' else 'other' end as manual_label",
        "if(doc_id % 17 = 0, 'insufficient_text', '') as adjudicated_label",
        "if(quality = 1, 'high', 'low') as manual_confidence", "'' as manual_notes", "'r1' as reviewer_id", "if(doc_id % 19 = 0, '2024-1-5', '2024-01-05') as review_date",
    )


SQL = {
    "articles": rf"""articles AS (SELECT CAST(doc_id AS VARCHAR) AS article_id, split_part(text, chr(10), 1) AS title,
  CASE WHEN instr(text, chr(10)) > 0 THEN substr(text, instr(text, chr(10)) + 1) ELSE '' END AS abstract, source AS journal_short,
  CAST(1975 + doc_id % 51 AS VARCHAR) AS publication_year, lang AS article_type,
  CASE WHEN doc_id % 7 = 0 THEN '' ELSE [{_PREFIXES}][doc_id % 9 + 1] || '/' || lang || '.' || doc_id END AS doi,
  CASE WHEN doc_id % 3 = 0 THEN 'W' || doc_id ELSE '' END AS openalex_id,
  CASE WHEN doc_id % 11 = 0 THEN 'https://example.org/' || doc_id || '.pdf' ELSE '' END AS oa_pdf_url,
  CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'https://example.org/' || doc_id END AS article_url,
  ['', 'enriched', 'partial_short_text', 'not_found'][doc_id % 4 + 1] AS text_enrichment_status,
  ['', 'tier_a_formal_abstract', 'tier_b_first_pages'][doc_id % 3 + 1] AS text_enrichment_evidence_tier,
  ['research', 'comment_reply', '', 'lecture_address', 'research'][doc_id % 5 + 1] AS article_scope,
  CASE WHEN doc_id % 4 = 1 THEN '' ELSE source END AS abstract_source FROM documents)""",
    "records": r"""records AS (SELECT CAST(doc_id AS VARCHAR) AS source_record_id, source AS journal_short, CAST(1975 + doc_id % 51 AS VARCHAR) AS publication_year,
  CASE WHEN doc_id % 5 = 0 THEN '' ELSE '10.1000/' || (doc_id % 400) END AS doi, '' AS jel_codes, split_part(text, chr(10), 1) AS title, 'crossref' AS source,
  CASE WHEN instr(text, chr(10)) > 0 THEN substr(text, instr(text, chr(10)) + 1) ELSE '' END AS abstract, CAST(doc_id % 40 AS VARCHAR) AS volume, 'journal-article' AS article_type FROM documents
  UNION ALL SELECT CAST(doc_id AS VARCHAR), source, CAST(1975 + doc_id % 51 AS VARCHAR), CASE WHEN doc_id % 5 = 0 THEN '' ELSE '10.1000/' || (doc_id % 400) END, '', split_part(text, chr(10), 1), 'openalex',
  text, CASE WHEN doc_id % 2 = 0 THEN '' ELSE CAST(doc_id % 41 AS VARCHAR) END, CASE WHEN doc_id % 4 = 0 THEN 'report' ELSE 'article' END FROM documents)""",
    "validation": r"""validation AS (SELECT 'VAL' || doc_id AS validation_id, CAST(doc_id AS VARCHAR) AS article_id,
  CASE WHEN doc_id % 13 = 0 THEN '' WHEN toxic = 1 THEN 'causal' WHEN quality = 1 THEN 'predictive' ELSE 'other' END AS manual_label,
  CASE WHEN doc_id % 17 = 0 THEN 'insufficient_text' ELSE '' END AS adjudicated_label, CASE WHEN quality = 1 THEN 'high' ELSE 'low' END AS manual_confidence,
  '' AS manual_notes, 'r1' AS reviewer_id, CASE WHEN doc_id % 19 = 0 THEN '2024-1-5' ELSE '2024-01-05' END AS review_date FROM labels)""",
}
