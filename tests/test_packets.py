from folioscope.operators import packets as P


def test_packets(spark):
    sample = spark.createDataFrame([("V1", "1", "causal"), ("V2", "2", "")], "validation_id string, article_id string, manual_label string")
    packet = spark.createDataFrame([("C1", "V1", "1"), ("C1", "V2", "9"), ("C3", "V9", "9")], "calibration_id string, validation_id string, article_id string")
    assert sorted(r["error"] for r in P.packet_errors(sample, packet, "calibration_id").collect()) == ["duplicate_packet_id", "duplicate_packet_id", "stale_packet_row", "unknown_packet_row"]
    subs = spark.createDataFrame([("C1", "a", "causal"), ("C1", "a", "other"), ("C7", "b", "other")], "calibration_id string, reviewer_id string, manual_label string")
    errors = P.submission_errors(packet, subs, "calibration_id")
    assert sorted(r["error"] for r in errors.collect()) == ["duplicate_reviewer_row", "duplicate_reviewer_row", "unknown_submission_row"]
    assert {r["calibration_id"]: r["progress_status"] for r in P.row_progress(packet, subs, errors, "calibration_id").collect()} == {"C1": "has_errors", "C3": "not_started"}


def test_guides_and_snapshots(spark):
    a = spark.createDataFrame([("1", "An experiment", "", "aer", "2001", "other", 13), ("2", "Forecasts", "forecast " * 60, "aer", "1999", "predictive", 500)], "article_id string, title string, abstract string, journal_short string, publication_year string, causal_predictive_category string, classification_text_chars int")
    got = {r["article_id"]: (r["text_status"], r["cue_profile"], r["review_difficulty"]) for r in P.review_guide(a).collect()}
    assert got == {"1": ("no_abstract", "causal_cues", "high"), "2": ("usable_text", "predictive_cues", "routine")}
    assert P.guide_counts(P.review_guide(a)).count() == 6
    assert P.profile(a).first()["median_chars"] == 256
    snap = P.snapshot(a, "before", include=a.where("article_id = '1'")).collect()
    assert [(r["snapshot_label"], r["article_id"], r["decade"]) for r in snap] == [("before", "1", "2000")]
    rows = spark.createDataFrame([("1", "10.1/a"), ("2", "10.1/b"), ("3", "10.2/c")], "article_id string, doi string")
    assert [r["article_id"] for r in P.unseen_rows(rows, ["10.1"], rows.where("article_id = '2'")).collect()] == ["1"]


def test_summaries_count_rows_without_rank_or_tier(spark):
    from folioscope.operators import routing as R

    rows = [("s", "t1", "g", 5, "b"), ("s", "t1", "g", 3, "a"), ("s", "t1", "g", 4, "b"), ("s", None, "g", None, ""), ("z", None, "h", None, None)]
    packet = spark.createDataFrame(rows, "cached_evidence_status string, quick_win_tier string, action_group string, review_rank long, source string")
    got = {tuple(r) for r in R.evidence_summary(packet).collect()}
    assert got == {("s", "t1", 3, 3, "a|b"), ("s", "", 1, R.UNRANKED, ""), ("z", "", 1, R.UNRANKED, "")}
    assert {tuple(r) for r in R.action_summary(packet).collect()} == {("g", "t1", 3, 3), ("g", "", 1, R.UNRANKED), ("h", "", 1, R.UNRANKED)}
    seen = spark.createDataFrame([("m", "t2", "f1", 2), ("m", "t1", "f1", 1), ("m", "t3", "f2", 0), ("n", "t1", "f1", -1)], "automation_status string, quick_win_tier string, source_route_family string, review_rank long")
    got = {r["automation_status"]: (r["rows"], r["first_review_rank"], r["source_route_families"]) for r in R.automation_summary(seen).collect()}
    assert got["m"][:2] == (3, 1) and set(got["m"][2].split("|")) == {"f1", "f2"} and got["n"] == (1, None, "f1")
    assert R.evidence_summary(packet.limit(0)).count() == 0
