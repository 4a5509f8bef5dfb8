"""Where a row of the recovery queue goes next: lanes, decisions, workflow, split groups, tiers, automation, evidence, imports, progress."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.checkpoints import materialized
from folioscope.config import EXCLUDED_SCOPES
from folioscope.functions import text as T
from folioscope.functions.features import with_text_features
from folioscope.operators.attempts import FAILED, by_prefix, by_prefix_source, counted_attempts, source_context
from folioscope.operators.enrich import ACCEPTED_TIERS, completion, filter_empty, match_backfill
from folioscope.operators.rank import first_by, global_rank, numbered, top_by
from folioscope.operators.shares import flag

# Actions of the queue and their lanes; DOI prefixes and their lanes; lanes of each type.
DOI_ACTION = "recover_abstract_from_doi_or_publisher"
ACTION_LANES = {
    "review_oa_pdf_or_first_pages": "oa_pdf_review",
    "extend_existing_short_abstract": "partial_short_text_extension",
    "review_openalex_or_title_match": "openalex_or_title_search",
    "review_article_landing_page": "article_landing_page_review",
    "manual_title_year_search": "manual_title_year_search",
}
PREFIX_LANES = {
    "10.1257": "aea_publisher_metadata_10_1257",
    "10.7916": "academic_commons_metadata_10_7916",
    "10.1086": "jpe_chicago_or_repec_10_1086",
    "10.3982": "econometric_society_10_3982",
    "10.2307": "jstor_or_legacy_metadata_10_2307",
    "10.1111": "wiley_or_society_metadata_10_1111",
}
OTHER_DOI_LANE = "doi_publisher_metadata_other"
LANE_TYPES = {
    "targeted_source_pass": [*PREFIX_LANES.values(), OTHER_DOI_LANE],
    "pdf_or_ocr_review": ["oa_pdf_review"],
    "manual_recovery": ["partial_short_text_extension", "openalex_or_title_search", "article_landing_page_review", "manual_title_year_search"],
}
# Prefixes with an automated route, the one that is scanned in bounded passes, and decisions of lanes.
ROUTED_PREFIXES, BOUNDED_PREFIX = ("10.1257", "10.7916", "10.1086", "10.3982", "10.2307"), "10.2307"
LANE_DECISIONS = {
    "oa_pdf_review": "inspect_pdf_blockers",
    "partial_short_text_extension": "manual_abstract_extension",
    "openalex_or_title_search": "manual_index_search",
    "manual_title_year_search": "manual_low_yield_search",
}
# Row statuses of each split group.
SPLIT_GROUPS = {
    "ready_partial_text_extension": ["manual_extend_partial_text"],
    "ready_manual_metadata": [
        "manual_index_or_new_template", "manual_doi_metadata_review", "manual_index_title_match", "pdf_route_blocked_use_manual_metadata",
        "suspect_pdf_url_use_manual_metadata", "source_specific_followup", "scienceon_bounded_recovery", "try_public_pdf_once",
    ],
    "ready_autofill_or_completed": ["autofill_pdf_text", "completed_backfill"],
    "waiting_scope_review": ["scope_review_before_recovery", "scope_review_unsure_before_recovery"],
    "excluded_nonresearch": ["scope_review_excluded_nonresearch"],
}
# Review tiers in their order; statuses of evidence with their action groups and tier advice.
TIERS = [
    "source_metadata_fix", "tier_1_partial_near_threshold", "tier_2_partial_replace_suspect_text", "tier_3_partial_extension",
    "tier_4_manual_metadata_has_context", "tier_5_manual_metadata_pdf_blocked", "tier_6_manual_metadata_sparse", "completed_ready_for_preflight",
]
ACTION_GROUPS = {
    "cached_import_candidate": "review_cached_import_candidate",
    "cached_partial_extension_candidate": "review_cached_extension_candidate",
    "cached_current_text_only": "do_not_rerun_cached_source",
    "cached_suspect_text_only": "replace_boilerplate_from_new_source",
    "cached_fragment_only": "find_fuller_metadata",
    "no_cached_text_candidate": "manual_metadata_search",
    "cached_pdf_candidate_only": "verify_pdf_or_use_metadata",
    "cached_prior_rate_limited_only": "avoid_rate_limited_cache",
    "no_cached_response": "manual_source_route_no_cache",
}
TIER_ADVICE = {
    "cached_import_candidate": "review_required_tier_a_or_b",
    "cached_partial_extension_candidate": "review_context_only",
    "cached_current_text_only": "review_context_only",
    "cached_fragment_only": "review_context_only",
    "cached_pdf_candidate_only": "review_required_tier_c_if_public_pdf_text",
}
# DOI beginnings and their route families, in order.
ROUTE_FAMILIES = {
    "10.2307/": "jstor_or_legacy_doi",
    "10.1086/": "jpe_chicago_or_repec",
    "10.1257/": "aea_publisher_metadata",
    "10.1111/": "wiley_or_society_metadata",
    "10.1093/qje": "oup_journal_metadata",
    "10.1093/restud": "oup_journal_metadata",
    "10.3982/": "econometric_society_metadata",
}
SUSPECT_LINKS = ["code of conduct", "code-of-conduct", "professional conduct", "professional-conduct", "referee", "election of fellows"]
NEAR_THRESHOLD, FRAGMENT_CHARS = 75, 80


def by_value(c: Column, values: dict[str, str], other: str | Column) -> Column:
    """The value that stands beside c in a fixed table."""
    out = other if isinstance(other, Column) else F.lit(other)
    for k, v in reversed(values.items()):
        out = F.when(c == k, v).otherwise(out)
    return out


def by_start(c: Column, values: dict[str, str], other: str | Column) -> Column:
    """The value beside the first beginning of c in a fixed table."""
    out = other if isinstance(other, Column) else F.lit(other)
    for k, v in reversed(values.items()):
        out = F.when(c.startswith(k), v).otherwise(out)
    return out


def expansion_lane(action: Column | str, doi: Column | str) -> Column:
    """Lane of a row by its action and, where a DOI is to be looked up, the DOI's prefix."""
    a = T.collapse(T.text(action))
    return F.when(a == DOI_ACTION, by_start(T.doi(doi), PREFIX_LANES, OTHER_DOI_LANE)).otherwise(by_value(a, ACTION_LANES, "unassigned_review"))


def lane_type(lane: Column | str) -> Column:
    x = T.text(lane)
    return reduce(lambda out, kv: F.when(x.isin(*kv[1]), kv[0]).otherwise(out), LANE_TYPES.items(), F.lit("review"))


def prepared(queue: DataFrame) -> DataFrame:
    """The queue with lane, type and DOI prefix of each row."""
    return queue.withColumn("expansion_lane", expansion_lane("recovery_action", "doi")).withColumn("lane_type", lane_type("expansion_lane")).withColumn("doi_prefix", T.doi_prefix_family("doi"))


def _counts(*more: Column) -> list[Column]:
    return [F.count("*").alias("row_count"), *[F.sum(flag(F.col("recovery_priority") == p)).alias(f"{p}_priority_rows") for p in ("high", "medium", "low")], F.min("recovery_rank").alias("min_recovery_rank"), *more]


def expansion_plan(work: DataFrame) -> DataFrame:
    """Prepared rows by lane, action, journal and decade: rows, priorities, ranks and handles."""
    return work.groupBy("expansion_lane", "lane_type", "recovery_action", "journal_short", "decade").agg(
        *_counts(F.max("recovery_rank").alias("max_recovery_rank"), *[F.sum(flag(T.present(c))).alias(f"{n}_rows") for n, c in (("doi", "doi"), ("openalex", "openalex_id"), ("oa_pdf", "oa_pdf_url"))], F.sum(flag(F.col("text_enrichment_status") == "partial_short_text")).alias("partial_short_text_rows"))
    )


def lane_overview(work: DataFrame, cells: int = 3) -> DataFrame:
    """Prepared rows by lane, with the lane's largest cells as `journal decade (rows)`."""
    named = lambda c: F.when(T.blank(c), "missing").otherwise(T.collapse(T.text(c)))
    cell = work.groupBy("expansion_lane", named("journal_short").alias("j"), named("decade").alias("d")).agg(F.count("*").alias("n"))
    best = top_by(cell, ["expansion_lane"], [F.desc("n"), F.asc("j"), F.asc("d")], cells)
    said = F.concat("j", F.lit(" "), "d", F.lit(" ("), "n", F.lit(")"))
    top = best.groupBy("expansion_lane").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__n", said.alias("s")))), lambda x: x["s"]), "; ").alias("top_journal_decades"))  # `cells` entries a lane
    return work.groupBy("expansion_lane", "lane_type").agg(*_counts()).join(top, "expansion_lane", "left")


def compact_unique(df: DataFrame, keys: list[str], value: Column, name: str, most: int = 5) -> DataFrame:
    """Of each key the first `most` distinct values in order, joined by `; `, and how many more there are."""
    once = df.select(*keys, value.alias("__v")).where("__v <> ''").distinct()
    size = once.groupBy(*keys).agg(F.count("*").alias("__size"))
    first = top_by(once, keys, [F.asc("__v")], most).groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("__v")), "; ").alias("__s"))  # `most` entries a key
    return first.join(size, keys).select(*keys, F.when(F.col("__size") > most, F.concat("__s", F.lit("; +"), F.col("__size") - most, F.lit(" more"))).otherwise(F.col("__s")).alias(name))


def prefix_plan(work: DataFrame, attempts: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Prepared rows by DOI prefix: rows, priorities, lanes, cells, what prior attempts gave (known: their counted_attempts()), and whether there is an automated route."""
    own = work.where("doi_prefix <> ''")
    prior = ["prior_attempted_articles", "prior_found_articles", *[f"prior_{s}_attempts" for s in FAILED]]
    out = own.groupBy("doi_prefix").agg(*_counts())
    cell = F.concat_ws(" ", F.trim(T.text("journal_short")), F.trim(T.text("decade")))
    out = out.join(compact_unique(own, ["doi_prefix"], F.col("expansion_lane"), "expansion_lanes"), "doi_prefix", "left").join(compact_unique(own, ["doi_prefix"], cell, "journal_decades"), "doi_prefix", "left")
    out = out.join(by_prefix(attempts, known).select("doi_prefix", *prior), "doi_prefix", "left").na.fill(0, prior)
    return out.withColumn("supported", F.col("doi_prefix").isin(*ROUTED_PREFIXES))


def prior_failed() -> Column:
    return reduce(lambda a, b: a + b, [F.col(f"prior_{s}_attempts") for s in FAILED])


def prefix_decision(many: int = 50, least_failed: int = 25) -> Column:
    """What to do with a row of prefix_plan()."""
    found, failed, supported = F.col("prior_found_articles"), prior_failed(), F.col("supported")
    return (
        F.when(F.col("doi_prefix") == BOUNDED_PREFIX, "bounded_scienceon_recovery")
        .when(~supported & (F.col("row_count") >= many), "new_source_template_or_manual_recovery").when(~supported, "low_volume_manual_recovery")
        .when(F.col("prior_attempted_articles") == 0, "bounded_source_pass")
        .when((found > 0) & (failed > F.greatest(found * 2, F.lit(least_failed))), "source_specific_investigation_before_rerun").when(found > 0, "bounded_rerun_only_if_logic_changed")
        .when(failed > 0, "do_not_rerun_unchanged_logic").otherwise("inspect_before_rerun")
    )


def lane_decision() -> Column:
    """What to do with a row of lane_overview()."""
    return by_value(F.col("expansion_lane"), LANE_DECISIONS, F.when(F.col("lane_type") == "targeted_source_pass", "see_doi_prefix_decisions").otherwise("inspect_lane"))


def decision_plan(work: DataFrame, attempts: DataFrame) -> DataFrame:
    """One row for each DOI prefix and each lane of the prepared queue: counts, prior attempts, best and worst prior source, decision."""
    shared = ["row_count", "high_priority_rows", "min_recovery_rank"]
    known = counted_attempts(attempts)
    context = source_context(by_prefix_source(attempts, known, errors=False))
    prefixes = prefix_plan(work, attempts, known).join(context, "doi_prefix", "left").select(
        F.col("doi_prefix").alias("decision_unit"), F.lit("doi_prefix").alias("unit_type"), *shared, "prior_attempted_articles", "prior_found_articles", prior_failed().alias("prior_failed_attempts"),
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("best_prior_source", "top_failure_source")], prefix_decision().alias("decision"),
    )
    zero, none = F.lit(0).cast("long"), F.lit("")
    lanes = lane_overview(work).select(
        F.col("expansion_lane").alias("decision_unit"), F.lit("expansion_lane").alias("unit_type"), *shared, zero.alias("prior_attempted_articles"), zero.alias("prior_found_articles"), zero.alias("prior_failed_attempts"),
        none.alias("best_prior_source"), none.alias("top_failure_source"), lane_decision().alias("decision"),
    )
    return prefixes.unionByName(lanes)


def route_matrix(decisions: DataFrame, probes: DataFrame) -> DataFrame:
    """Decisions (decision_unit, unit_type, decision) with their probe counts (decision_unit, outcome) and the status of the route."""
    outcomes = ["abstract_found", "pdf_candidate", "access_challenge", "not_found", "http_error", "no_metadata_found"]
    seen = probes.groupBy("decision_unit").agg(F.count("*").alias("probe_rows"), *[F.sum(flag(F.col("outcome") == o)).alias(f"probe_{o}_rows") for o in outcomes])
    work = decisions.join(seen, "decision_unit", "left").na.fill(0, ["probe_rows", *[f"probe_{o}_rows" for o in outcomes]])
    found = (F.col("probe_abstract_found_rows") > 0) | (F.col("probe_pdf_candidate_rows") > 0)
    of_lane = by_value(F.col("decision"), {"inspect_pdf_blockers": "manual_pdf_blocker_review", "manual_abstract_extension": "manual_partial_abstract_extension", "manual_index_search": "manual_index_search"}, "lane_decision_reference")
    plain = {
        "bounded_scienceon_recovery": "scienceon_bounded_recovery", "bounded_source_pass": "ready_bounded_source_pass", "bounded_rerun_only_if_logic_changed": "rerun_only_after_logic_or_cache_change",
        "do_not_rerun_unchanged_logic": "manual_or_new_template_only", "low_volume_manual_recovery": "manual_or_new_template_only",
    }
    status = (
        F.when(F.col("unit_type") == "expansion_lane", of_lane)
        .when(F.col("decision") == "new_source_template_or_manual_recovery", F.when(found, "candidate_public_route_found").otherwise("unsupported_existing_route"))
        .when(F.col("decision") == "source_specific_investigation_before_rerun", F.when(found, "candidate_route_requires_parser_or_url_update").when(F.col("probe_rows") > 0, "do_not_rerun_landing_pages").otherwise("source_specific_probe_needed"))
        .otherwise(by_value(F.col("decision"), plain, "inspect_decision"))
    )
    return work.withColumn("current_route_status", status)


def route_unit(action: Column | str) -> Column:
    """The unit of the route matrix that a queue row looks up where its DOI prefix has none."""
    return by_value(T.text(action), {"extend_existing_short_abstract": "partial_short_text_extension", "review_openalex_or_title_match": "openalex_or_title_search", "review_oa_pdf_or_first_pages": "oa_pdf_review"}, "")


def suspect_link(url: Column | str) -> Column:
    """Links to something other than an article."""
    low = F.lower(T.collapse(T.text(url)))
    return reduce(lambda a, b: a | b, [low.contains(m) for m in SUSPECT_LINKS])


def row_workflow(scope_decision: Column, scope: Column, filled: Column, action: Column, pdf_status: Column, route_status: Column, pdf_url: Column) -> Column:
    """Status of a row: what is to be done with it, the first that applies."""
    document = F.when(pdf_status == "extracted", "autofill_pdf_text").when(suspect_link(pdf_url), "suspect_pdf_url_use_manual_metadata").when(pdf_status.isin("download_error", "extract_error", "too_short", "skipped_missing_url"), "pdf_route_blocked_use_manual_metadata").otherwise("try_public_pdf_once")
    publisher = (
        F.when(route_status.isin("unsupported_existing_route", "do_not_rerun_landing_pages", "manual_or_new_template_only"), "manual_index_or_new_template")
        .when(route_status.isin("ready_bounded_source_pass", "source_specific_probe_needed", "candidate_route_requires_parser_or_url_update"), "source_specific_followup")
        .when(route_status == "scienceon_bounded_recovery", "scienceon_bounded_recovery").otherwise("manual_doi_metadata_review")
    )
    return (
        F.when(scope_decision == "exclude_nonresearch", "scope_review_excluded_nonresearch").when(scope_decision == "unsure", "scope_review_unsure_before_recovery")
        .when(scope.isin(*EXCLUDED_SCOPES), "scope_review_before_recovery").when(filled, "completed_backfill")
        .when(action == "review_oa_pdf_or_first_pages", document).when(action == "extend_existing_short_abstract", "manual_extend_partial_text")
        .when(action == DOI_ACTION, publisher).when(action == "review_openalex_or_title_match", "manual_index_title_match").otherwise("manual_review")
    )


def split_group(row_status: Column | str) -> Column:
    x = T.col(row_status)
    return reduce(lambda out, kv: F.when(x.isin(*kv[1]), kv[0]).otherwise(out), SPLIT_GROUPS.items(), F.lit("other_manual_review"))


def _blocked(row_status: Column) -> Column:
    return row_status.contains("pdf_route_blocked") | row_status.contains("suspect_pdf_url")


def quick_win_tier(state: Column, group: Column, row_status: Column, flags: Column, chars: Column, has_source: Column, minimum: int = 250) -> Column:
    """Review tier of a row. state: completion(); has_source: whether the present text names its source."""
    partial = group == "ready_partial_text_extension"
    return (
        F.when(state == "needs_source_metadata", "source_metadata_fix").when(state == "ready_to_import", "completed_ready_for_preflight")
        .when(partial & (flags != ""), "tier_2_partial_replace_suspect_text").when(partial & (F.greatest(minimum - chars, F.lit(0)) <= NEAR_THRESHOLD), "tier_1_partial_near_threshold").when(partial, "tier_3_partial_extension")
        .when(_blocked(row_status), "tier_5_manual_metadata_pdf_blocked").when((chars > 0) | has_source, "tier_4_manual_metadata_has_context").otherwise("tier_6_manual_metadata_sparse")
    )


def review_stage(state: Column) -> Column:
    return by_value(state, {"needs_source_metadata": "source_metadata_fix", "ready_to_import": "ready_to_import"}, "recover_abstract")


def route_family(tier: Column, group: Column, row_status: Column, text_status: Column, artifact: Column, doi: Column | str) -> Column:
    """Family of sources that a row is looked up in."""
    low = F.lower(T.collapse(T.text(doi)))
    of_doi = by_start(low, ROUTE_FAMILIES, F.when(low != "", "doi_or_publisher_metadata").otherwise("title_index_search"))
    blocked = _blocked(row_status) | (text_status == "pdf_candidate") | artifact.contains("pdf_download_blockers")
    return F.when(tier == "source_metadata_fix", "source_metadata_fix").when(group == "ready_partial_text_extension", "partial_text_extension").when(blocked, "pdf_blocker_metadata").otherwise(of_doi)


def review_queue(rows: DataFrame, minimum: int = 250, entities: bool = True, texts: bool = True) -> DataFrame:
    """Split rows (article_id, split_group, row_status, current_text_chars, current_abstract, abstract, source, source_url, source_record_id,
    recovery_rank, ...) in review order. Rows whose enriched text is usable already are left out. texts=False leaves the texts themselves out: flags and
    states are made of them first, and ranking writes and sorts all that is left."""
    named = lambda c: T.collapse(T.text(c)) if c in rows.columns else F.lit("")
    chars = F.coalesce(T.number("current_text_chars"), F.lit(0.0)).cast("int")
    usable = (named("text_enrichment_status") == "enriched") & ((F.lower(named("has_usable_classification_text")) == "true") | (chars >= minimum))
    state = completion("abstract", "source", "source_url", "source_record_id")
    flags = T.quality_flags(T.first_present("current_abstract", "abstract"), entities=entities)
    work = rows.where(~usable).withColumns({"completion_status": state, "review_stage": review_stage(state), "current_text_quality_flag": flags, "current_text_chars": chars, "chars_needed_to_threshold": F.greatest(minimum - chars, F.lit(0))})
    tier = quick_win_tier(F.col("completion_status"), named("split_group"), named("row_status"), F.col("current_text_quality_flag"), F.col("current_text_chars"), named("current_abstract_source") != "", minimum)
    work = work.withColumn("quick_win_tier", tier).withColumn("source_route_family", route_family(F.col("quick_win_tier"), named("split_group"), named("row_status"), named("text_enrichment_status"), named("source_artifact"), "doi"))
    place = F.array_position(F.array(*[F.lit(t) for t in TIERS]), F.col("quick_win_tier"))
    rank = F.coalesce(T.number("recovery_rank"), F.lit(999999.0))
    work = work if texts else work.drop("current_abstract", "abstract")
    return global_rank(work, [place.asc(), F.asc("chars_needed_to_threshold"), rank.asc(), F.asc("journal_short"), F.asc("publication_year"), F.asc("title"), F.asc("article_id")], "review_rank")


def automation_status(state: Column, tier: Column, flags: Column, family: Column, row_status: Column, route_status: Column, decision: Column) -> Column:
    """Whether and how a review row can be helped along by automation."""
    dead_end = route_status.isin("unsupported_existing_route", "do_not_rerun_landing_pages") | (decision == "new_source_template_or_manual_recovery")
    return (
        F.when(state == "ready_to_import", "ready_for_preflight").when(state == "needs_source_metadata", "source_metadata_incomplete")
        .when((tier == "tier_2_partial_replace_suspect_text") | (flags != ""), "manual_replace_boilerplate").when((family == "pdf_blocker_metadata") | _blocked(row_status), "manual_metadata_after_pdf_block")
        .when(tier == "tier_1_partial_near_threshold", "manual_near_threshold_extension").when(tier == "tier_3_partial_extension", "manual_partial_extension")
        .when(dead_end, "manual_index_or_template_spike_required").when(tier == "tier_4_manual_metadata_has_context", "manual_metadata_recovery").otherwise("manual_review_required")
    )


def evidence_status(abstract_chars: Column, text_chars: Column, current_chars: Column, flags: Column, fallback: Column | None = None, pdf_url: Column | None = None, minimum: int = 250) -> Column:
    """What a candidate text is worth; a candidate without text by its document link or by why there is none."""
    fallback, pdf_url = F.lit("") if fallback is None else fallback, F.lit("") if pdf_url is None else pdf_url
    with_text = F.when(text_chars >= minimum, "cached_import_candidate").when(text_chars > current_chars, "cached_partial_extension_candidate").when(abstract_chars < FRAGMENT_CHARS, "cached_fragment_only").otherwise("cached_current_text_only")
    without = F.when(pdf_url != "", "cached_pdf_candidate_only").when(fallback == "rate_limited", "cached_prior_rate_limited_only").when(fallback == "not_cached", "no_cached_response").otherwise("no_cached_text_candidate")
    return F.when(flags != "", "cached_suspect_text_only").when(abstract_chars > 0, with_text).otherwise(without)


def action_group(status: Column, tier: Column) -> Column:
    near = (status == "cached_current_text_only") & (tier == "tier_1_partial_near_threshold")
    return F.when(near, "find_external_extension").otherwise(by_value(status, ACTION_GROUPS, "manual_review"))


def tier_advice(status: Column) -> Column:
    return by_value(status, TIER_ADVICE, "not_importable_from_cache")


def local_evidence(queue: DataFrame, records: DataFrame, minimum: int = 250, entities: bool = True, features: DataFrame | None = None) -> DataFrame:
    """Best candidate text of each queue row among source records of the same DOI, or else of the same title, journal and year: import-ready,
    then clean, then long with the title, then the first by `record_order`. Each record's text is looked at once, or found by content in a feature table;
    only sizes and flags, written once, go into the two equi-joins, one row a key."""
    key = F.concat_ws("|", T.title_key("title", entities), F.lower(T.text("journal_short")), T.text("publication_year"))
    sized = with_text_features(records.withColumn("__key", key), "abstract", "candidate", features, entities).where("candidate_stripped_chars > 0")
    r = materialized(sized.select(T.doi("doi").alias("__doi"), "__key", "record_order", "candidate_stripped_chars", "candidate_flags", "source"))
    q = queue.select("article_id", T.doi("doi").alias("__doi"), key.alias("__key"), F.length(T.clean("title", entities)).alias("__title"))
    size, clean = F.col("candidate_stripped_chars"), F.col("candidate_flags") == ""

    def of(key: str, matched_by: str, asks: DataFrame) -> DataFrame:
        # the title adds the same to all records of a key, so the key's best record is each row's: no pairs of rows and records are made
        first = F.max(F.struct(clean.alias("clean"), size.alias("abstract_chars"), (-F.col("record_order")).alias("o"), "candidate_flags", "source"))
        known = r.groupBy(key).agg(first.alias("k"), F.count("*").alias("n"))
        return asks.join(known, key).select(F.lit(matched_by).alias("matched_by"), "article_id", "__title", "k.*", "n")

    found = of("__doi", "source_records_exact_doi", q.where("__doi <> ''")).unionByName(of("__key", "source_records_exact_title_year", q.where("__doi = ''")))
    chars = F.col("abstract_chars") + F.when(F.col("__title") > 0, F.col("__title") + 1).otherwise(0)
    best = F.max(F.struct((F.col("clean") & (chars >= minimum)).alias("ready"), "clean", chars.alias("chars"), "o", "abstract_chars", "candidate_flags", "source", "matched_by"))
    both = found.groupBy("article_id").agg(best.alias("x"), F.sum("n").alias("candidates"))
    zero = F.lit(0)
    out = queue.select("article_id", F.coalesce(T.number("current_text_chars"), F.lit(0.0)).cast("int").alias("current_text_chars")).join(both, "article_id", "left")
    status = evidence_status(F.coalesce("x.abstract_chars", zero), F.coalesce("x.chars", zero), F.col("current_text_chars"), F.coalesce("x.candidate_flags", F.lit("")), minimum=minimum)
    return out.select(
        "article_id", "current_text_chars", F.coalesce("candidates", zero).alias("candidates"), F.coalesce("x.matched_by", F.lit("")).alias("matched_by"), F.coalesce("x.source", F.lit("")).alias("source"), F.coalesce("x.chars", zero).alias("candidate_text_chars"),
        status.alias("cached_evidence_status"), tier_advice(status).alias("evidence_tier_suggestion"),
    )


def action_packet(evidence: DataFrame, queue: DataFrame, cells: DataFrame | None = None, automation: DataFrame | None = None) -> DataFrame:
    """Evidence rows with review rank, tier, route family, cell target and automation status beside them, and what the reviewer is to do. Each
    context gives one row for a key: queue, automation by article_id, cells by journal_short and decade."""
    work = with_context(evidence, (queue.select("article_id", "review_rank", "quick_win_tier", "source_route_family", "journal_short", "decade"), ["article_id"]))
    if automation is not None:
        work = with_context(work, (automation.select("article_id", "automation_status"), ["article_id"]))
    if cells is not None:
        work = with_context(work, (cells.select("journal_short", "decade", F.col("target_rank").alias("cell_target_rank"), F.col("target_level").alias("cell_target_level")), ["journal_short", "decade"]))
    return work.withColumn("action_group", action_group(F.col("cached_evidence_status"), T.text("quick_win_tier")))


def import_preflight(rows: DataFrame, articles: DataFrame, minimum_match: float = 0.9, entities: bool = True) -> tuple[DataFrame, DataFrame]:
    """(one row for each recovery_batch and split_group of filled split rows with its status and counts, error rows): a dry run of the backfill
    import with provenance required. rows has row_number, unique among all."""
    key = ["recovery_batch", "split_group"]
    filled, _ = filter_empty(rows, ["abstract"])
    named = T.present("source") & (T.present("source_url") | T.present("source_record_id"))
    total = rows.groupBy(*key).agg(F.count("*").alias("total_rows"), F.sum(flag(T.blank("abstract"))).alias("skipped_empty_abstract_rows"), F.sum(flag(T.present("abstract"))).alias("candidate_rows_after_skip"), F.sum(flag(T.present("abstract") & named)).alias("source_ready_backfill_abstracts"), F.sum(flag(T.present("abstract") & ~named)).alias("source_incomplete_backfill_abstracts"))
    checked = match_backfill(filled, articles, minimum_match, require_source=True, entities=entities, within=key).join(filled.select("row_number", *key), "row_number")
    result = checked.groupBy(*key).agg(F.sum(flag(F.col("error") == "")).alias("import_ready_rows"), F.sum(flag(F.col("error") != "")).alias("error_rows"))
    out = total.join(result, key, "left").na.fill(0, ["import_ready_rows", "error_rows"])
    status = F.when(F.col("error_rows") > 0, "blocked_errors").when(F.col("candidate_rows_after_skip") == 0, "pass_empty").otherwise("pass_ready")
    return out.withColumn("preflight_status", status), checked.where("error <> ''")


EDIT_COLUMNS = ["backfill_abstract", "source", "source_url", "source_record_id", "evidence_tier", "notes"]


def carry_edits(queue: DataFrame, edits: DataFrame) -> DataFrame:
    """A new queue with the edits of an old packet: of several the one with most filled columns; machine notes don't count."""
    own_note = T.present("notes") & ~T.text("notes").startswith("suggested_action=")
    value = {c: F.when(own_note, T.text("notes")).otherwise("") if c == "notes" else T.text(c) for c in EDIT_COLUMNS}
    filled = sum((F.when(v != "", 1).otherwise(0) for v in value.values()), F.lit(0))
    named = edits.select("article_id", *[v.alias(c) for c, v in value.items()], filled.alias("__n")).where("__n > 0")
    best = first_by(named, ["article_id"], [F.desc("__n"), *[F.asc(c) for c in EDIT_COLUMNS]]).select("article_id", *[F.col(c).alias(f"__{c}") for c in EDIT_COLUMNS])
    work = queue.join(best, "article_id", "left")
    return work.withColumns({c: F.when(F.coalesce(F.col(f"__{c}"), F.lit("")) != "", F.col(f"__{c}")).otherwise(T.text(c) if c in queue.columns else F.lit("")) for c in EDIT_COLUMNS}).drop(*[f"__{c}" for c in EDIT_COLUMNS])


def autofill(batch: DataFrame, enrichment: DataFrame, overwrite: bool = False) -> DataFrame:
    """Batch rows filled from enriched rows, unless they are filled already."""
    good = first_by(enrichment.where((T.text("enrichment_status") == "enriched") & T.present("enriched_abstract")), ["article_id"], [F.asc("enrichment_source"), F.asc("enriched_abstract")])
    e = good.select("article_id", F.col("enriched_abstract").alias("__a"), T.text("enrichment_source").alias("__s"), T.text("evidence_tier").alias("__t"))
    take = F.col("__a").isNotNull() & (F.lit(overwrite) | T.blank("backfill_abstract"))
    note = F.when(T.blank("notes"), F.concat(F.lit("autofilled_from="), "__s")).otherwise(F.concat(T.text("notes"), F.lit(";autofilled_from="), F.col("__s")))
    return batch.join(e, "article_id", "left").withColumns({"notes": F.when(take, note).otherwise(T.text("notes")), "source": F.when(take, F.col("__s")).otherwise(T.text("source")), "evidence_tier": F.when(take, F.col("__t")).otherwise(T.text("evidence_tier")), "backfill_abstract": F.when(take, F.col("__a")).otherwise(T.text("backfill_abstract"))}).drop("__a", "__s", "__t")


def with_context(base: DataFrame, *contexts: tuple[DataFrame, list[str]]) -> DataFrame:
    """base left joined with one row a key of each (context, keys); columns that base has already are left out."""
    for context, keys in contexts:
        own = [c for c in context.columns if c not in base.columns or c in keys]
        base = base.join(first_by(context.select(*own), keys, [F.asc(c) for c in own]), keys, "left")
    return base


def duplicate_ids(df: DataFrame, key: str = "article_id") -> DataFrame:
    """Keys with more than one row."""
    return df.groupBy(key).agg(F.count("*").alias("rows")).where("rows > 1")


def unique_by(df: DataFrame, key: str = "article_id") -> DataFrame:
    """df, whose job fails as soon as a key turns out to have two rows. The check is part of the plan: whoever reads the result runs it."""
    same = F.count("*").over(Window.partitionBy(key))
    good = F.when(F.col("__same") > 1, F.raise_error(F.concat(F.lit(f"duplicate {key} after merge: "), T.text(key))).cast("boolean")).otherwise(True)
    return df.withColumn("__same", same).where(good).drop("__same")


def batch_with_context(batch: DataFrame, workplan: DataFrame, articles: DataFrame, attempts: DataFrame) -> DataFrame:
    """Batch rows with their workplan, article and attempt columns, one row each; fails on an article that the batch has twice."""
    once = attempts.distinct()  # many rows of an article, few different ones: these are sorted, not all
    return unique_by(with_context(batch, (workplan, ["article_id"]), (articles, ["article_id"]), (once, ["article_id"])))


def recent_triage(queue: DataFrame, scope_packet: DataFrame, start: int, journals: list[str] | None = None) -> DataFrame:
    """Recent queue rows in two lanes: those whose scope is under review wait."""
    rows = queue.where(T.number("publication_year") >= start)
    if journals:
        rows = rows.where(F.lower("journal_short").isin(*[j.lower() for j in journals]))
    review = scope_packet.select("article_id").distinct().withColumn("__r", F.lit(True))
    lane = F.when(F.col("__r"), "scope_review_first").otherwise("recover_text")
    return global_rank(rows.join(review, "article_id", "left").withColumn("lane", lane).drop("__r"), [F.asc("lane"), F.asc("recovery_rank"), F.asc("article_id")], "triage_rank")


def packets(queue: DataFrame) -> DataFrame:
    """Queue rows numbered within their batches."""
    return numbered(queue, ["recovery_batch"], [F.asc("recovery_rank"), F.asc("article_id")], "packet_row")


def batch_summary(rows: DataFrame, actions: list[str]) -> DataFrame:
    return rows.groupBy("recovery_batch").agg(F.count("*").alias("rows"), F.min("recovery_rank").alias("first_rank"), F.max("recovery_rank").alias("last_rank"), *[F.sum(flag(F.col("recovery_action") == a)).alias(a) for a in actions])


def history_by_batch(history: DataFrame, name: str) -> DataFrame:
    """Rows of an import history by the batch in its file name. Fixed value: the form of the name."""
    batch = F.regexp_extract(F.coalesce("import_source_file", F.lit("")), r"insufficient_text_recovery_batch_(R\d{3})(?:_[A-Za-z0-9_]+)?\.csv", 1)
    return history.withColumn("recovery_batch", batch).where("recovery_batch <> ''").groupBy("recovery_batch").agg(F.count("*").alias(name))


def batch_progress(rows: DataFrame, imported: DataFrame, errors: DataFrame) -> DataFrame:
    """Batches of packet rows (recovery_batch, abstract): rows, filled ones and their share, rows of the import and error histories."""
    out = rows.groupBy("recovery_batch").agg(F.count("*").alias("total_rows"), F.sum(flag(T.present("abstract"))).alias("completed_backfill_abstracts"), F.sum(flag(T.blank("abstract"))).alias("remaining_backfill_abstracts"))
    counts = ["history_imported_rows", "history_error_rows"]
    for history, name in zip((imported, errors), counts, strict=True):
        out = out.join(history_by_batch(history, name), "recovery_batch", "left")
    return out.na.fill(0, counts).withColumn("completed_backfill_share", F.round(F.col("completed_backfill_abstracts") / F.col("total_rows"), 6))


def progress_overview(progress: DataFrame, queue: DataFrame, imported: DataFrame, errors: DataFrame) -> DataFrame:
    """(metric, value): batches and rows of the queue, filled and imported rows, the next batch (of the first rank) and its rows."""
    q = queue.agg(F.count_distinct(F.when(T.present("recovery_batch"), F.col("recovery_batch"))).alias("recovery_batches"), F.count("*").alias("remaining"), F.min_by("recovery_batch", F.when(T.present("recovery_batch"), F.col("recovery_rank"))).alias("next"))
    of_next = queue.join(F.broadcast(q.select(F.col("next").alias("recovery_batch"))), "recovery_batch").agg(F.count("*").alias("next_rows"))
    done = progress.agg(F.coalesce(F.sum("completed_backfill_abstracts"), F.lit(0)).alias("filled"))
    i, e = imported.agg(F.count("*").alias("imported")), errors.agg(F.count("*").alias("errors"))
    one = q
    for other in (of_next, done, i, e):  # one row each
        one = one.join(F.broadcast(other), F.lit(True))
    completed = F.greatest("filled", "imported")
    metrics = {
        "recovery_batches": F.col("recovery_batches"), "recovery_rows": F.col("remaining") + completed, "current_recovery_queue_rows": F.col("remaining"), "completed_backfill_abstracts": completed,
        "current_packet_completed_backfill_abstracts": F.col("filled"), "cumulative_imported_recovery_rows": F.col("imported"), "remaining_backfill_abstracts": F.col("remaining"),
        "next_recovery_batch": F.coalesce("next", F.lit("")), "next_recovery_batch_remaining": F.col("next_rows"), "import_history_rows": F.col("imported"), "import_error_history_rows": F.col("errors"),
    }
    return one.select(F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), c.cast("string").alias("value")) for m, c in metrics.items()])))


#: Fixed value: the rank of rows that have none.
UNRANKED = 999999


def ranked_summary(rows: DataFrame, groups: list[str], listed: list[str] | None = None) -> DataFrame:
    """Rows and first review rank of each group, and the distinct values of other columns in order of their first rank, joined by `|`. The
    listed columns have few values: they are cut down to those before anything is gathered."""
    out = rows.groupBy(*groups).agg(F.count("*").alias("rows"), F.min("review_rank").alias("first_review_rank"))
    for c in listed or []:
        once = rows.where(T.present(c)).groupBy(*groups, c).agg(F.min("review_rank").alias("__r"))
        values = once.groupBy(*groups).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__r", F.col(c).alias("v")))), lambda x: x["v"]), "|").alias(f"{c}s"))
        out = out.join(values, groups, "left").na.fill("", [f"{c}s"])
    return out


def _with_tier(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"quick_win_tier": T.text("quick_win_tier"), "review_rank": F.coalesce(F.col("review_rank"), F.lit(UNRANKED))})


def evidence_summary(packet: DataFrame) -> DataFrame:
    """Rows, first review rank and candidate sources of each evidence status and tier of an action packet; rows without a rank count as UNRANKED."""
    return ranked_summary(_with_tier(packet), ["cached_evidence_status", "quick_win_tier"], ["source"]).withColumnRenamed("sources", "candidate_sources")


def action_summary(packet: DataFrame) -> DataFrame:
    """Rows and first review rank of each action group and tier of an action packet."""
    return ranked_summary(_with_tier(packet), ["action_group", "quick_win_tier"])


def automation_summary(rows: DataFrame) -> DataFrame:
    """Rows, first positive review rank, tiers and route families (in order of first rank) of each automation status."""
    return ranked_summary(rows.withColumn("review_rank", F.when(F.col("review_rank") > 0, F.col("review_rank"))), ["automation_status"], ["quick_win_tier", "source_route_family"]).withColumnRenamed("source_route_familys", "source_route_families")


def cells_top(rows: DataFrame, per_cell: int) -> DataFrame:
    return top_by(rows, ["journal_short", "decade"], [F.asc("recovery_rank"), F.asc("article_id")], per_cell)


def importable(tier: Column | str) -> Column:
    return F.trim(T.text(tier)).isin(*ACCEPTED_TIERS)
