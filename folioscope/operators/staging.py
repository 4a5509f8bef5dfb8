"""What reviewers hand in, on its way to an import: routes looked up, exports staged all or nothing, progress by row and group, the rows to begin with."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.checkpoints import materialized
from folioscope.functions import text as T
from folioscope.operators.enrich import ACCEPTED_TIERS, tier_error
from folioscope.operators.rank import first_by
from folioscope.operators.routing import by_start, by_value, route_unit
from folioscope.operators.shares import flag

# Groups of split rows in order, those that can be staged, what a reviewer may fill; statuses in the order in which a group takes them, and in which
# rows are begun with; tiers in that order; units of routes by DOI and by family.
GROUP_ORDER = ["ready_partial_text_extension", "ready_manual_metadata", "ready_autofill_or_completed", "waiting_scope_review", "excluded_nonresearch", "other_manual_review"]
STAGED_GROUPS = GROUP_ORDER[:3]
EDITABLE = ["abstract", "source", "source_url", "source_record_id", "evidence_tier", "notes"]
STATUSES = ["fix_stage_errors", "fix_preflight_errors", "complete_export_fields", "run_stage_and_preflight", "not_started", "ready_to_import"]
KICKOFF_TIERS = ["tier_1_partial_near_threshold", "tier_2_partial_replace_suspect_text", "tier_3_partial_extension", "tier_4_manual_metadata_has_context", "tier_5_manual_metadata_pdf_blocked"]
ROUTE_DOIS = {p: p for p in ("10.2307", "10.1086", "10.1257", "10.1111", "10.1093/qje", "10.3982")}
ROUTE_UNITS = {
    "partial_text_extension": "partial_short_text_extension",
    "pdf_blocker_metadata": "oa_pdf_review",
    "openalex_or_title_search": "openalex_or_title_search",
    "jpe_chicago_or_repec": "10.1086",
    "jstor_or_legacy_doi": "10.2307",
    "aea_publisher_metadata": "10.1257",
    "wiley_or_society_metadata": "10.1111",
    "oup_journal_metadata": "10.1093/qje",
    "econometric_society_metadata": "10.3982",
}
#: Rows of a look-up table up to which it is broadcast; a larger one is joined by a shuffle.
FEW = 10_000


# --- routes


def with_fallback(rows: DataFrame, table: DataFrame, unit: str, values: list[str], *keys: Column) -> DataFrame:
    """rows with `values` of the table's row for the first of the keys that it has, null where it has none. A unit with several rows counts with the
    first by its values; blank units are none. The table is written once, however many keys there are, and broadcast if its size, which is counted, allows."""
    one = materialized(first_by(table.where(T.present(unit)).select(T.collapse(T.text(unit)).alias(unit), *values), [unit], [F.asc(v) for v in values]))
    if one.count() <= FEW:
        one = F.broadcast(one)
    names = [f"__key{i}" for i in range(len(keys))]
    work = rows.withColumns(dict(zip(names, keys, strict=True)))
    for i, n in enumerate(names):
        found = one.select(F.col(unit).alias(f"__unit{i}"), F.struct(*values).alias(f"__found{i}"))
        work = work.join(found, F.col(n) == F.col(f"__unit{i}"), "left")
    found = F.coalesce(*[F.col(f"__found{i}") for i in range(len(keys))])
    return work.select(*[F.col(c) for c in rows.columns], *[found[v].alias(v) for v in values])


def with_route(rows: DataFrame, routes: DataFrame) -> DataFrame:
    """Queue rows (doi, recovery_action) with current_route_status and decision of their DOI prefix, else of the unit of their action."""
    return with_fallback(rows, routes, "decision_unit", ["current_route_status", "decision"], T.doi_prefix_family("doi"), route_unit("recovery_action"))


def with_review_route(rows: DataFrame, routes: DataFrame) -> DataFrame:
    """Review rows (doi, source_route_family) with current_route_status and decision of the unit of a known DOI beginning, or else of their family."""
    family = T.collapse(T.text("source_route_family"))
    unit = by_start(F.lower(T.collapse(T.text("doi"))), ROUTE_DOIS, by_value(family, ROUTE_UNITS, family))
    return with_fallback(rows, routes, "decision_unit", ["current_route_status", "decision"], unit)


# --- staging


def check_exports(base: DataFrame, exports: DataFrame, imported: DataFrame | None = None, entities: bool = True, texts: bool = True) -> DataFrame:
    """One row for each export row (source_file, row_number, article_id, split_group, the EDITABLE columns): outcome `staged`, `skipped` or `error`,
    error, and what the split row (article_id, split_group, current_abstract, current_abstract_chars, the EDITABLE columns) becomes, with staged_fields. texts=False leaves
    the abstract out: rows are judged by digests and lengths of texts, and the judged rows are written once.

    Left alone are rows without id, of articles imported before, without anything new, and partial texts that are current already. A split row that isn't there, isn't
    ready or is named with another group is an error, and so are missing text, source and tier, a partial text that got no longer, and a second export of an article."""
    place = F.array_position(F.array(*[F.lit(g) for g in GROUP_ORDER]), F.col("split_group"))
    own = ["split_group", "current_abstract", "current_abstract_chars", *EDITABLE]
    mark = lambda c: F.when(F.col(c) != "", F.md5(F.col(c).cast("binary"))).otherwise("")
    marks = {"mark": mark("abstract"), "chars": F.length("abstract")}
    unseen = [] if texts else ["abstract"]
    b = base.select(T.clean("article_id", entities).alias("article_id"), place.alias("__place"), *[(T.clean(c, entities) if c in base.columns else F.lit("")).alias(c) for c in own]).where("article_id <> ''")
    b = first_by(b, ["article_id"], [F.desc("__place"), *[F.asc(c) for c in own]]).withColumns(marks | {"now": mark("current_abstract")})
    b = b.select("article_id", *[F.col(c).alias(f"__{c}") for c in (*own, *marks, "now") if c not in ("current_abstract", *unseen)], F.lit(True).alias("__known"))
    given = ["split_group", *EDITABLE]
    e = exports.select("source_file", "row_number", T.clean("article_id", entities).alias("article_id"), *[(T.clean(c, entities) if c in exports.columns else F.lit("")).alias(c) for c in given])
    e = e.withColumns(marks).drop(*unseen)
    done = imported.select(T.clean("article_id", entities).alias("article_id")).where("article_id <> ''").distinct().withColumn("__done", F.lit(True)) if imported is not None else None
    work = e.join(b, "article_id", "left")
    work = work.join(done, "article_id", "left") if done is not None else work.withColumn("__done", F.lit(None).cast("boolean"))
    new = {c: F.when(F.col(c) != "", F.col(c)).otherwise(F.coalesce(f"__{c}", F.lit(""))) for c in (*EDITABLE, "mark") if c not in unseen}
    new["chars"] = F.when(F.col("mark") != "", F.col("chars")).otherwise(F.coalesce("__chars", F.lit(0)))
    work = work.withColumns({f"__new_{c}": v for c, v in new.items()})
    partial = F.col("__split_group") == GROUP_ORDER[0]
    named = (F.col("__new_source") != "") & ((F.col("__new_source_url") != "") | (F.col("__new_source_record_id") != ""))
    text, now = F.col("mark"), F.col("__now")
    current = partial & (text != "") & (text == now)
    offers = named | (text != "") & (partial & (text != now) | (text != F.col("__mark"))) | (F.concat("source", "source_url", "source_record_id") != "")
    size = F.coalesce(T.number("__current_abstract_chars").cast("long"), F.lit(0))
    extended = ~((now != "") & (F.col("__new_mark") == now)) & ~((size != 0) & (F.col("__new_chars") <= size))
    error = (
        F.when(F.col("__known").isNull(), "tiered_row_not_in_ready_split").when(~F.col("__split_group").isin(*STAGED_GROUPS), "tiered_row_not_stageable")
        .when((F.col("split_group") != "") & (F.col("split_group") != F.col("__split_group")), "tiered_split_group_mismatch")
        .when(current | ~offers, "-").when(F.col("__new_mark") == "", "missing_staged_abstract").when(~named, "missing_staged_source_provenance")
        .when(tier_error("__new_evidence_tier") != "", tier_error("__new_evidence_tier")).when(partial & ~extended, "partial_text_not_extended").otherwise("")
    )
    work = work.withColumn("__error", F.when((F.col("article_id") == "") | F.coalesce("__done", F.lit(False)), "-").otherwise(error))
    place_of = {c: "mark" if c == "abstract" else c for c in EDITABLE}
    fields = F.array_join(F.filter(F.array(*[F.when(F.col(f"__new_{m}") != F.col(f"__{m}"), F.lit(c)) for c, m in place_of.items()]), lambda x: x.isNotNull()), "|")
    kept_columns = [c for c in EDITABLE if c not in unseen]
    work = materialized(work.select("source_file", "row_number", "article_id", F.coalesce("__split_group", "split_group").alias("split_group"), "__error", fields.alias("__fields"), *[f"__new_{c}" for c in kept_columns]))  # read twice
    good = F.when(F.col("__error") == "", F.struct("source_file", "row_number"))
    first = work.groupBy("article_id").agg(F.min(good).alias("__first"))  # one row an article: no window over its exports
    work = work.join(first, "article_id").withColumn("error", F.when(F.col("__error") == "-", "").when((F.col("__error") == "") & (F.struct("source_file", "row_number") != F.col("__first")), "duplicate_completed_tiered_row").otherwise(F.col("__error")))
    outcome = F.when(F.col("__error") == "-", "skipped").when(F.col("error") != "", "error").otherwise("staged")
    kept = F.when(F.col("outcome") == "staged", F.lit(True))
    return work.withColumn("outcome", outcome).select("source_file", "row_number", "article_id", "split_group", "outcome", "error", F.when(kept, F.col("__fields")).otherwise("").alias("staged_fields"), *[F.when(kept, F.col(f"__new_{c}")).otherwise("").alias(c) for c in kept_columns])


def stage_changes(checked: DataFrame) -> DataFrame:
    """The staged rows of check_exports, none at all if any row has an error."""
    bad = checked.where("outcome = 'error'").agg(F.count("*").alias("__bad"))  # one row
    return checked.where("outcome = 'staged'").join(F.broadcast(bad), F.lit(True)).where("__bad = 0").drop("__bad", "outcome", "error")


def staged_rows(base: DataFrame, changes: DataFrame) -> DataFrame:
    """Split rows with the changes put in; a column that they lack is added."""
    new = changes.select("article_id", *[F.col(c).alias(f"__{c}") for c in EDITABLE], F.lit(True).alias("__changed"))
    return base.join(new, "article_id", "left").select(*[F.col(c) for c in base.columns if c not in EDITABLE], *[F.when(F.col("__changed"), F.col(f"__{c}")).otherwise(T.text(c) if c in base.columns else F.lit("")).alias(c) for c in EDITABLE])


def publish(rows: DataFrame, root: str, errors: DataFrame | None = None) -> str | None:
    """Writes rows aside and then makes them the current version of root, by a line in its manifest; none if there is an error row. Readers see the version before
    or the new one, never a part; a run that ends between the two steps leaves what was there."""
    if errors is not None and not errors.isEmpty():
        return None
    spark = rows.sparkSession
    before = current_version(spark, root)
    version = f"{(int(before.split('-')[0]) + 1) if before else 1:08d}-{uuid.uuid4().hex}"
    rows.write.parquet(f"{root}/versions/{version}")
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("append").parquet(f"{root}/manifest")
    return version


def current_version(spark: SparkSession, root: str) -> str | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/manifest")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema("version string").parquet(f"{root}/manifest").agg(F.max("version")).first()[0]


def published(spark: SparkSession, root: str) -> DataFrame:
    """The current version of root; an error where nothing was published."""
    version = current_version(spark, root)
    if version is None:
        raise ValueError(f"nothing is published at {root}")
    return spark.read.parquet(f"{root}/versions/{version}")


# --- progress


def export_status(exports: DataFrame) -> DataFrame:
    """One row for each article of the exports: rows, files in order of name, and whether any row has text, source, an accepted tier, all of these."""
    text, named, tier = T.present("abstract"), T.present("source") & (T.present("source_url") | T.present("source_record_id")), F.trim(T.text("evidence_tier")).isin(*ACCEPTED_TIERS)
    flags = {"exported_has_abstract": text, "exported_source_ready": named, "exported_importable_evidence_tier": tier, "exported_ready_candidate": text & named & tier}
    files = F.array_join(F.array_sort(F.collect_set(F.nullif(T.collapse(T.text("source_file")), F.lit("")))), "|")
    return exports.where(T.present("article_id")).groupBy(T.collapse(T.text("article_id")).alias("article_id")).agg(F.count("*").alias("export_row_count"), files.alias("exported_files"), *[F.max(c).alias(n) for n, c in flags.items()])


def action_progress(packet: DataFrame, exports: DataFrame, changes: DataFrame, stage_errors: DataFrame, preflight_errors: DataFrame) -> DataFrame:
    """Packet rows with what became of them: exports, staged or not, errors of staging and preflight, and the next status, the first that applies."""

    def ids(df: DataFrame, name: str) -> DataFrame:
        return df.where(T.present("article_id")).groupBy(T.collapse(T.text("article_id")).alias("article_id")).agg(F.count("*").alias(name))

    counts = ["stage_error_rows", "preflight_error_rows", "__staged"]
    yes_no = ["exported_has_abstract", "exported_source_ready", "exported_importable_evidence_tier", "exported_ready_candidate"]
    work = packet.join(export_status(exports), "article_id", "left")
    for df, name in zip((stage_errors, preflight_errors, changes), counts, strict=True):
        work = work.join(ids(df, name), "article_id", "left")
    work = work.na.fill(0, ["export_row_count", *counts]).na.fill(False, yes_no).na.fill("", ["exported_files"])
    status = (
        F.when(F.col("stage_error_rows") > 0, "fix_stage_errors").when(F.col("preflight_error_rows") > 0, "fix_preflight_errors").when(F.col("__staged") > 0, "ready_to_import")
        .when(F.col("exported_ready_candidate"), "run_stage_and_preflight").when(F.col("export_row_count") > 0, "complete_export_fields").otherwise("not_started")
    )
    made = {"duplicate_export_rows": F.greatest(F.col("export_row_count") - 1, F.lit(0)), "staged": F.col("__staged") > 0, "next_status": status}
    return work.withColumns(made).withColumn("import_ready", F.col("next_status") == "ready_to_import").drop("__staged")


def _order(c: str, values: list[str], other: int) -> Column:
    return by_value(F.col(c), {v: str(i) for i, v in enumerate(values)}, str(other)).cast("int")


def progress_summary(detail: DataFrame, group: str = "action_group") -> DataFrame:
    """Each group's rows, cells, exports and errors; its status is the first in STATUSES that any of its rows has."""
    needed, rank = F.coalesce(T.number("cell_recoveries_to_target_share"), F.lit(0.0)), T.number("cell_target_rank")
    rows = F.count("*")
    exported, ready = F.sum(flag(F.col("export_row_count") > 0)), F.sum(flag(F.col("import_ready")))
    out = detail.groupBy(T.collapse(T.text(group)).alias(group)).agg(
        rows.alias("rows_total"), F.sum(flag(needed > 0)).alias("priority_cell_rows"), F.sum(flag(T.text("cell_target_level") == "critical")).alias("critical_cell_rows"), F.min(rank).cast("int").alias("top_cell_target_rank"),
        exported.alias("exported_rows"), F.sum(flag(F.col("exported_ready_candidate"))).alias("exported_ready_candidates"), F.sum(flag(F.col("staged"))).alias("staged_rows"), ready.alias("import_ready_rows"),
        F.sum("stage_error_rows").alias("stage_error_rows"), F.sum("preflight_error_rows").alias("preflight_error_rows"), F.sum("duplicate_export_rows").alias("duplicate_export_rows"), (rows - exported).alias("remaining_unexported_rows"), (rows - ready).alias("remaining_not_import_ready_rows"),
        F.min(F.coalesce(T.number("review_rank"), F.lit(999999.0))).cast("int").alias("first_review_rank"), F.min(_order("next_status", STATUSES, 99)).alias("__o"),
    )
    return out.withColumn("next_status", F.coalesce(F.get(F.array(*[F.lit(s) for s in STATUSES]), F.col("__o")), F.lit(""))).drop("__o")


def progress_metrics(summary: DataFrame) -> DataFrame:
    """(metric, value): the groups added up, and the status that ranks first."""
    added = ["rows_total", "priority_cell_rows", "critical_cell_rows", "exported_rows", "import_ready_rows", "remaining_not_import_ready_rows", "stage_error_rows", "preflight_error_rows", "duplicate_export_rows"]
    one = summary.agg(F.count("*").alias("action_groups"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in added], F.min(_order("next_status", STATUSES, 99)).alias("__o"))
    status = F.coalesce(F.get(F.array(*[F.lit(s) for s in STATUSES]), F.col("__o")), F.lit(""))
    metrics = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("string").alias("value")) for m in ["action_groups", *added]]
    return one.select(F.inline(F.array(*metrics, F.struct(F.lit("next_status").alias("metric"), status.alias("value")))))


def kickoff(detail: DataFrame, packet: DataFrame, limit: int = 20) -> DataFrame:
    """The packet's rows for the first `limit` articles to begin with (a top-k report), with kickoff_rank: by status, most errors of staging and preflight,
    tier, cells that still need rows first, rank of the cell, review rank, id. An article's first packet row counts."""
    number = lambda c, other: F.coalesce(T.number(c).cast("long"), F.lit(other))
    order = [
        _order("next_status", STATUSES, 99), -F.col("stage_error_rows"), -F.col("preflight_error_rows"), _order("quick_win_tier", KICKOFF_TIERS, 99),
        (number("cell_recoveries_to_target_share", 0) <= 0), number("cell_target_rank", 999999), number("review_rank", 999999), F.col("article_id"),
    ]
    keyed = detail.select("article_id", F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]).alias("__o"))
    first = keyed.orderBy("__o").limit(limit).select("article_id", F.row_number().over(Window.orderBy("__o")).alias("kickoff_rank"))  # at most `limit` rows
    one = first_by(packet, ["article_id"], [F.asc(c) for c in packet.columns if c != "article_id"])
    return one.join(F.broadcast(first), "article_id").select("kickoff_rank", *packet.columns)
