"""Routes, staging, publishing and progress of what reviewers hand in."""

import pytest
from pyspark.sql import functions as F

from folioscope.operators import staging as G

PARTIAL, MANUAL, DONE, WAITING, OTHER = G.GROUP_ORDER[0], G.GROUP_ORDER[1], G.GROUP_ORDER[2], G.GROUP_ORDER[3], G.GROUP_ORDER[5]
TIER = "tier_a_formal_abstract"
BASE = "article_id string, split_group string, current_abstract string, current_abstract_chars string, abstract string, source string, source_url string, source_record_id string, evidence_tier string, notes string, title string"
EXPORT = "source_file string, row_number int, article_id string, split_group string, abstract string, source string, source_url string, source_record_id string, evidence_tier string, notes string"


def test_routes_fall_back_in_order(spark, monkeypatch):
    rows = spark.createDataFrame([("1", "10.2307/x", "review_oa_pdf_or_first_pages"), ("2", "10.9999/x", "review_oa_pdf_or_first_pages"), ("3", "", "review_openalex_or_title_match"), ("4", "", "manual_title_year_search"), ("5", None, None)], "article_id string, doi string, recovery_action string")
    routes = spark.createDataFrame([("10.2307", "of_prefix", "d1"), ("oa_pdf_review", "of_action", "d2"), ("oa_pdf_review", "z_later", "d3"), ("", "of_nothing", ""), (None, "null", ""), ("openalex_or_title_search", None, "d4")], "decision_unit string, current_route_status string, decision string")
    for few in (10_000, 0):
        monkeypatch.setattr(G, "FEW", few)
        got = {r["article_id"]: (r["current_route_status"], r["decision"]) for r in G.with_route(rows, routes).collect()}
        assert got == {"1": ("of_prefix", "d1"), "2": ("of_action", "d2"), "3": (None, "d4"), "4": (None, None), "5": (None, None)}
    review = spark.createDataFrame([("1", "10.2307/a", "pdf_blocker_metadata"), ("2", "10.5/a", "pdf_blocker_metadata"), ("3", "", "jstor_or_legacy_doi"), ("4", "", "10.2307"), ("5", "10.1111/q", "jstor_or_legacy_doi")], "article_id string, doi string, source_route_family string")
    got = {r["article_id"]: r["current_route_status"] for r in G.with_review_route(review, routes).collect()}
    assert got == {"1": "of_prefix", "2": "of_action", "3": "of_prefix", "4": "of_prefix", "5": None}  # a known DOI doesn't fall back on its family


@pytest.fixture(scope="module")
def base(spark):
    rows = [
        ("p1", PARTIAL, "short text", "10", "", "", "", "", "", "", "P1"), ("p2", PARTIAL, "short text", "10", "", "", "", "", "", "", "P2"), ("m1", MANUAL, "", "", "", "crossref", "u", "", TIER, "old note", "M1"),
        ("m2", MANUAL, "", "", "", "", "", "", "", "", "M2"), ("d1", DONE, "", "", "kept", "s", "u", "", TIER, "", "D1"), ("w1", WAITING, "", "", "", "", "", "", "", "", "W1"), ("o1", OTHER, "", "", "", "", "", "", "", "", "O1"),
    ]
    return spark.createDataFrame(rows, BASE)


def checked(spark, base, rows, imported=None):
    rows = [(f, i + 2, *r) for i, (f, *r) in enumerate(rows)]
    return G.check_exports(base, spark.createDataFrame(rows, EXPORT), imported)


def outcomes(df):
    return {r["row_number"]: (r["outcome"], r["error"]) for r in df.collect()}


def test_each_rule_of_staging(spark, base):
    full = ("econlit", "u", "", TIER, "")
    rows = [
        ("a.csv", "", "", "text", *full), ("a.csv", "im", "", "text", *full), ("a.csv", "??", "", "text", *full), ("a.csv", "w1", "", "text", *full), ("a.csv", "o1", "", "text", *full), ("a.csv", "m1", PARTIAL, "text", *full),
        ("a.csv", "p1", "", "short text", *full), ("a.csv", "m2", MANUAL, "", "", "", "", "", "only a note"), ("a.csv", "m2", "", "", "econlit", "", "", "", ""), ("a.csv", "m2", "", "text", "econlit", "", "", TIER, ""),
        ("a.csv", "m2", "", "text", "econlit", "", "r9", "", ""), ("a.csv", "m2", "", "text", "econlit", "", "r9", "tier_e_blocked", ""), ("a.csv", "p2", "", "tiny", *full), ("a.csv", "p2", "", "short text that goes on", *full),
        ("b.csv", "p2", "", "short text that goes on and on", *full), ("b.csv", "m1", "", "<b>new</b>  text", "", "", "", "", ""), ("b.csv", "d1", None, None, None, None, None, None, None),
    ]
    got = checked(spark, base, rows, spark.createDataFrame([("im",), ("im",), (None,)], "article_id string"))
    assert outcomes(got) == {
        2: ("skipped", ""), 3: ("skipped", ""), 4: ("error", "tiered_row_not_in_ready_split"), 5: ("error", "tiered_row_not_stageable"), 6: ("error", "tiered_row_not_stageable"), 7: ("error", "tiered_split_group_mismatch"),
        8: ("skipped", ""), 9: ("skipped", ""), 10: ("error", "missing_staged_abstract"), 11: ("error", "missing_staged_source_provenance"), 12: ("error", "missing_evidence_tier"), 13: ("error", "unimportable_evidence_tier"),
        14: ("error", "partial_text_not_extended"), 15: ("staged", ""), 16: ("error", "duplicate_completed_tiered_row"), 17: ("staged", ""), 18: ("staged", ""),
    }
    new = {r["article_id"]: r for r in got.where("outcome = 'staged'").collect()}
    assert (new["m1"]["abstract"], new["m1"]["source"], new["m1"]["notes"], new["m1"]["staged_fields"]) == ("new text", "crossref", "old note", "abstract")
    assert new["p2"]["staged_fields"] == "abstract|source|source_url|evidence_tier" and new["d1"]["staged_fields"] == ""
    assert G.stage_changes(got).count() == 0  # one error is enough
    assert checked(spark, base.limit(0), rows).where("outcome = 'staged'").count() == 0
    assert checked(spark, base, rows).where("article_id = 'im'").first()["error"] == "tiered_row_not_in_ready_split"


def test_staged_rows_are_all_or_nothing(spark, base):
    good = [("a.csv", "p1", "", "short text and more", "econlit", "u", "", TIER, "seen"), ("a.csv", "m2", "", "found", "library", "", "r1", TIER, "")]
    changes = G.stage_changes(checked(spark, base, good))
    after = {r["article_id"]: r for r in G.staged_rows(base, changes).collect()}
    assert len(after) == 7 and (after["p1"]["abstract"], after["p1"]["notes"], after["m2"]["source_record_id"], after["m1"]["source"], after["m1"]["title"]) == ("short text and more", "seen", "r1", "crossref", "M1")
    bad = G.stage_changes(checked(spark, base, [*good, ("a.csv", "m1", "", "x", "", "", "", "tier_e_blocked", "")]))
    assert {r["article_id"]: r["abstract"] for r in G.staged_rows(base, bad).collect()} == {r["article_id"]: r["abstract"] for r in base.collect()}
    assert "notes" in G.staged_rows(base.drop("notes"), changes).columns


def test_publish_in_two_steps(spark, base, tmp_path):
    root = str(tmp_path / "staged")
    with pytest.raises(ValueError):
        G.published(spark, root)
    first = G.publish(base, root)
    assert G.published(spark, root).count() == 7 and G.current_version(spark, root) == first
    good = checked(spark, base, [("a.csv", "m2", "", "found", "library", "", "r1", TIER, "")])
    failing = checked(spark, base, [("a.csv", "m2", "", "found", "library", "", "", TIER, "")])
    assert G.publish(G.staged_rows(base, G.stage_changes(failing)), root, failing.where("outcome = 'error'")) is None
    assert G.current_version(spark, root) == first
    base.limit(1).write.parquet(f"{root}/versions/00000009-left-behind")  # a run that ended between the two steps
    assert G.current_version(spark, root) == first and G.published(spark, root).count() == 7
    second = G.publish(G.staged_rows(G.published(spark, root), G.stage_changes(good)), root, good.where("outcome = 'error'"))
    assert second > first and G.published(spark, root).where("abstract = 'found'").count() == 1


def test_progress_and_kickoff(spark):
    packet = spark.createDataFrame(
        [("stage", "g1", "1", "tier_3_partial_extension", "2", "high", "0"), ("pre", "g1", "2", "", "1", "critical", "3"), ("ready", "g2", "3", "", "", "", ""), ("run", "g3", "4", "", "5", "low", "1"), ("fill", "g3", "5", "", "", "", ""), ("new", "g4", "x", "tier_1_partial_near_threshold", "9", "", "0"), ("new2", "g4", "7", "tier_1_partial_near_threshold", "8", "", "2"), ("ready2", "g4", "8", "", "", "", "")],
        "article_id string, action_group string, review_rank string, quick_win_tier string, cell_target_rank string, cell_target_level string, cell_recoveries_to_target_share string",
    )
    exports = spark.createDataFrame([("run", "b.csv", "t", "s", "", "r", TIER), ("run", "a.csv", "", "", "", "", ""), ("fill", "a.csv", "t", "s", "", "", TIER), ("stage", "a.csv", "t", "s", "u", "", TIER), ("", "a.csv", "t", "s", "u", "", TIER)], "article_id string, source_file string, abstract string, source string, source_url string, source_record_id string, evidence_tier string")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "article_id string")
    detail = G.action_progress(packet, exports, ids("ready", "ready2", "pre", "stage"), ids("stage", "stage"), ids("pre", "stage"))
    got = {r["article_id"]: r for r in detail.collect()}
    assert {i: r["next_status"] for i, r in got.items()} == {"stage": "fix_stage_errors", "pre": "fix_preflight_errors", "ready": "ready_to_import", "ready2": "ready_to_import", "run": "run_stage_and_preflight", "fill": "complete_export_fields", "new": "not_started", "new2": "not_started"}
    assert (got["run"]["exported_files"], got["run"]["duplicate_export_rows"], got["run"]["exported_ready_candidate"], got["stage"]["stage_error_rows"], got["new"]["export_row_count"]) == ("a.csv|b.csv", 1, True, 2, 0)
    groups = {r["action_group"]: r for r in G.progress_summary(detail).collect()}
    assert {g: r["next_status"] for g, r in groups.items()} == {"g1": "fix_stage_errors", "g2": "ready_to_import", "g3": "complete_export_fields", "g4": "not_started"}
    assert (groups["g1"]["top_cell_target_rank"], groups["g1"]["critical_cell_rows"], groups["g4"]["first_review_rank"], groups["g4"]["remaining_not_import_ready_rows"], groups["g3"]["exported_rows"]) == (1, 1, 7, 2, 2)
    metrics = {r["metric"]: r["value"] for r in G.progress_metrics(G.progress_summary(detail)).collect()}
    assert (metrics["action_groups"], metrics["rows_total"], metrics["stage_error_rows"], metrics["next_status"]) == ("4", "8", "2", "fix_stage_errors")
    rows = packet.unionByName(packet.where("article_id = 'pre'"))
    first = [(r["kickoff_rank"], r["article_id"]) for r in G.kickoff(detail, rows, 6).orderBy("kickoff_rank").collect()]
    assert first == [(1, "stage"), (2, "pre"), (3, "fill"), (4, "run"), (5, "new2"), (6, "new")]
    none = detail.limit(0)
    assert G.kickoff(none, rows).count() == 0 and G.progress_summary(none).count() == 0 and {r["value"] for r in G.progress_metrics(G.progress_summary(none)).collect()} == {"0", ""}


def test_a_route_table_is_worked_out_once_whatever_the_keys(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    routes = spark.createDataFrame([("10.1", "a"), ("oa", "b"), ("x", "c")], "unit string, status string").mapInArrow(count, "unit string, status string")
    rows = spark.createDataFrame([("1", "10.1", "oa"), ("2", "10.2", "oa"), ("3", "", "")], "id string, k1 string, k2 string")
    out = G.with_fallback(rows, routes, "unit", ["status"], F.col("k1"), F.col("k2"))
    assert {r["id"]: r["status"] for r in out.collect()} == {"1": "a", "2": "b", "3": None}
    assert seen.value == 3


def test_exports_are_judged_alike_without_their_texts(spark, base):
    rows = [
        ("a.csv", 2, "p1", "", "short text", "s", "u", "", TIER, ""), ("a.csv", 3, "p2", "", "a text that is longer than it was", "s", "u", "", TIER, ""), ("a.csv", 4, "p2", "", "short", "s", "u", "", TIER, ""), ("b.csv", 2, "p2", "", "again a text that is longer", "s", "u", "", TIER, ""),
        ("b.csv", 3, "m1", "", "", "s", "", "", "", ""), ("b.csv", 4, "m2", MANUAL, "new", "s", "", "r", TIER, ""), ("b.csv", 5, "d1", "", " kept ", "", "", "", "", ""), ("b.csv", 6, "x", "", "new", "", "", "", "", ""), ("b.csv", 7, "", "", "new", "", "", "", "", ""),
    ]
    exports = spark.createDataFrame(rows, EXPORT)
    whole, few = G.check_exports(base, exports), G.check_exports(base, exports, texts=False)
    assert "abstract" not in few.columns
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, whole.drop("abstract").collect()))
    assert {r["outcome"] for r in few.collect()} == {"staged", "skipped", "error"}
