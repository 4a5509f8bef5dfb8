import pytest
from pyspark.sql import functions as F

from folioscope.functions import page as P
from folioscope.functions import features as FT
from folioscope.functions import text as T
from folioscope.operators import classify as C
from folioscope.operators import enrich as E


def one(spark, column, value=None, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("make", "value", "want"),
    [
        (T.clean, " <p>A&amp;B</p> \n c ", "A&B c"),
        (T.clean, "&lt;b&gt; stays", "<b> stays"),
        (T.clean, None, ""),
        (T.doi, " https://doi.org/10.1/ABC ", "10.1/abc"),
        (T.doi, "doi: 10.1/x", "10.1/x"),
        (T.title_key, "The <i>Effect</i> of X--Y!", "the effect of x y"),
        (T.strip_boilerplate, "Text . All rights reserved. | _ |", "Text.. _"),
        (T.decade, "1987.0", "1980"),
        (T.decade, "n/a", "missing"),
        (T.doi_prefix_family, "10.1093/qje/abc", "10.1093/qje"),
        (T.doi_prefix_family, "10.2307/123", "10.2307"),
        (T.doi_prefix_family, "", ""),
        (T.doi_url, "10.1/a b", "https://doi.org/10.1/a%20b"),
        (lambda c: T.preview(c, 8), "abcdefghijk", "abcde..."),
        (lambda c: T.abstract_section(c, 20, 5), "Title Abstract: we find things. Introduction more", "we find things."),
        (lambda c: T.title_url("u?q=", c), "A & B/~", "u?q=A%20%26%20B/~"),
    ],
)
def test_scalars(spark, make, value, want):
    assert one(spark, make(F.col("v")), value) == want


def test_pages_and_dates(spark):
    first, last = T.pages("v")
    assert tuple(spark.createDataFrame([("12 – 34",)], "v string").select(first, last).first()) == ("12", "34")
    d, y = T.best_date("a", "b")
    assert tuple(spark.createDataFrame([(None, [2001, 3])], "a array<int>, b array<int>").select(d, y).first()) == ("2001-03-01", 2001)


def test_inverted_index(spark):
    assert one(spark, T.from_inverted_index("v"), {"world": [1, 3], "hello": [0], "again": [3]}, "v map<string,array<int>>") == "hello world again"
    assert one(spark, T.from_inverted_index("v"), None, "v map<string,array<int>>") == ""
    long = spark.createDataFrame([({f"w{i}": [i] for i in range(3000)},)], "v map<string,array<int>>").select(T.from_inverted_index("v").alias("t"))
    assert long._jdf.queryExecution().analyzed().toString().count("array_sort(") == 1  # not again for each word
    assert long.first()["t"] == " ".join(f"w{i}" for i in range(3000))


def test_authors_and_keywords(spark):
    kind = "v array<struct<given:string,family:string,name:string>>"
    assert one(spark, T.author_names("v"), [("Ann", "Lee", None), (None, None, "Group"), (None, None, None)], kind) == ["Ann Lee", "Group"]
    assert one(spark, T.keyword_set("v", "v"), ["b", " a ", "", "b"], "v array<string>") == "a|b"


def test_rules(spark):
    text = "We use a difference in differences design with exogenous variation. " + "Filler words fill the abstract up to its length. " * 6
    rows = [("1", "Theory", "Plain theory. " * 30), ("2", "Short", "No."), ("3", "Causal", text), ("4", "Mixed", text + " out-of-sample machine learning forecast accuracy"), ("5", "R", "All rights reserved."), ("6", "UPPER", text.upper())]
    got = {r["article_id"]: r for r in C.classify(spark.createDataFrame(rows, "article_id string, title string, abstract string")).collect()}
    assert [got[i]["causal_predictive_category"] for i in "123456"] == ["other", "insufficient_text", "causal", "other" if got["4"]["causal_language_indicator"] - got["4"]["predictive_language_indicator"] > -2 else "predictive", "insufficient_text", "causal"]
    assert got["3"]["classification_confidence"] == "high" and got["4"]["classification_confidence"] != "high"
    assert got["5"]["classification_text_quality_flags"] == "access_or_rights_boilerplate" and "boilerplate" in got["5"]["classification_reason"]
    assert "difference-in-differences" in got["3"]["causal_language_terms"]


def test_phrase_boundaries(spark):
    df = spark.createDataFrame([("causal effects",)], "t string")
    assert df.select(FT.phrase_hits("t", ["causal effect", "causal effects"])).first()[0] == [1]


def test_phrases_against_patterns_one_by_one():
    import random
    import re

    phrases = ["causal effect", "difference-in-differences", "out-of-sample", "out of sample", "predict", "predicts", "effect of", "effects of", "-odd start", "a", "a-b-c", "effect"]
    rules = [re.compile("(?<![a-z0-9])" + p[0].replace("-", r"\-") + r"".join("[- ]" if c == "-" else re.escape(c) for c in p[1:]) + "(?![a-z0-9])") for p in phrases]
    rng = random.Random(4)
    bits = ["causal", "effect", "effects", "of", "out", "sample", "-", "-", " ", " ", " ", "difference", "in", "differences", "predict", "s", "x", "é", "a", "b", "c", "odd start", "1", "."]
    find = FT.Phrases(phrases).find
    for _ in range(4000):
        t = "".join(rng.choices(bits, k=rng.randint(0, 14)))
        assert find(t) == [i for i, r in enumerate(rules) if r.search(t)], t
    assert FT.Phrases([]).find("a") == [] and FT.Phrases([""]).find("a") == []


def test_features_are_the_text_functions(spark):
    texts = [None, "", "  a\u00a0b\x1cc ", "<p>Text &lt;b&gt; x</p>", "A , b . _ | c", "Copyright © 1999 All rights reserved. Body — dash", "This content downloaded from 1.2.3.4 all use subject to http://about.jstor.org/terms", "x|y", "| lone | bars _", "R&amp;D &lt;i&gt;it"]
    df = spark.createDataFrame([(i, t, texts[-1 - i]) for i, t in enumerate(texts)], "i int, t string, u string")
    both = df.select("*", FT.features(["t", "u"], ["a", "body"], title=0).alias("f"), FT.stripped_size("t").alias("s"))
    for r in both.select("*", F.length(T.classification_text(["t", "u"])).alias("chars"), T.quality_flags("t", "u").alias("flags"), F.length(T.strip_boilerplate("t")).alias("size"), F.length(T.clean("t")).alias("clean")).collect():
        assert (r["f"]["chars"], r["f"]["flags"], r["s"]["stripped_chars"], r["s"]["clean_chars"]) == (r["chars"], r["flags"], r["size"], r["clean"]), r
    assert {r["i"]: r["f"]["title_hits"] for r in both.collect()}[4] == [0]


def test_a_distinct_text_is_looked_at_once(spark):
    df = spark.createDataFrame([(i, f"text {i % 5} all rights reserved") for i in range(100)] + [(100, None), (101, "")], "i int, t string")
    table = FT.feature_table(df.select("t"))
    assert table.count() == 6
    joined = FT.with_text_features(df, "t", "t", table)
    assert joined.count() == 102 and joined.columns == ["i", "t", "t_clean_chars", "t_stripped_chars", "t_flags"]
    assert {tuple(r) for r in joined.collect()} == {tuple(r) for r in FT.with_text_features(df, "t", "t").collect()}
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    classified = C.classify(df.selectExpr("cast(i as string) article_id", "t as title", "t as abstract"), titles=True)
    plan = C.with_title_suggestion(classified).where("causal_predictive_category = 'insufficient_text'")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_scope_order(spark):
    scope, reason = C.article_scope("title", "kind", {"editorial": "review_erratum_paratext"}, [("comment_reply", r"\bcomment\b"), ("lecture_address", "nobel")])
    rows = [("A comment on Nobel", "article"), ("Nobel lecture", ""), ("", ""), ("Plain", ""), ("X", "Editorial")]
    got = [tuple(r) for r in spark.createDataFrame(rows, "title string, kind string").select(scope, reason).collect()]
    assert [g[0] for g in got] == ["comment_reply", "lecture_address", "unknown", "research", "review_erratum_paratext"]
    assert got[0][1] == r"title_pattern:\bcomment\b"


def test_model_responses(spark):
    good = '{"output_text": "{\\"category\\": \\"causal\\", \\"confidence\\": \\"high\\", \\"reason\\": \\"r\\"}"}'
    nested = '{"output": [{"content": [{"text": "{\\"category\\": \\"other\\", "}, {"text": "\\"confidence\\": \\"low\\", \\"reason\\": \\"x\\"}"}]}]}'
    bad = ['{"output_text": "nonsense"}', '{"output_text": "{\\"category\\": \\"causal\\"}"}', '{"output_text": "{\\"category\\": \\"zzz\\", \\"confidence\\": \\"high\\", \\"reason\\": \\"r\\"}"}', "not json", None]
    got = [one(spark, C.parse_model_response("v"), v) for v in (good, nested, *bad)]
    assert [g["error"] for g in got] == ["", "", "invalid_json", "missing_keys", "invalid_category", "no_output_text", "no_output_text"]
    assert got[1]["category"] == "other"


def test_page_helper(spark):
    body = "This abstract is long enough to be taken as an abstract of the page, with several clauses in it."
    html = f'<html><head><title>T &amp; U</title><meta name="citation_doi" content="10.1/X"><meta name="citation_title" content="My title"></head><body><div class="abstract"><p>Abstract: {body}</p><div>in</div></div><a href="/f/paper.pdf?x=1">pdf</a></body></html>'
    df = spark.createDataFrame([("10.1/x", "My Title: long", html, "https://h.org/a/", 1), ("10.1/y", "My title", html, "https://h.org/a/", 1)], "doi string, title string, html string, url string, page_order int")
    p = df.select(P.read_page("html", "url").alias("p")).first()["p"]
    assert p["pdf_url"] == "https://h.org/f/paper.pdf?x=1" and p["title"] == "My title" and body in p["abstract"]
    got = {r["doi"]: r["status"] for r in P.verified_match(df, 50).collect()}
    assert got == {"10.1/x": "recovered", "10.1/y": "no_verified_match"}
    assert one(spark, P.usable_abstract("v"), "Downloadable! No abstract is available for this item, sorry about this, please look elsewhere for it.") == ""


def test_title_similarity_and_its_block(spark):
    import difflib
    import random

    rng = random.Random(1)
    titles = ["".join(rng.choice("abc d") for _ in range(rng.randint(5, 30))) for _ in range(60)]
    rows = [(i, "", "", t, "" if i % 3 == 0 else "2000", "x") for i, t in enumerate(titles[:30] + [t[:-1] for t in titles[:10]])]
    arts = [(f"a{i}", "", t, "2000") for i, t in enumerate(titles)]
    b = spark.createDataFrame(rows, "row_number long, article_id string, doi string, title string, publication_year string, abstract string")
    a = spark.createDataFrame(arts, "article_id string, doi string, title string, publication_year string")
    got = {r["row_number"]: r for r in E.match_backfill(b, a).collect()}
    key = lambda t: " ".join(t.split())
    for i, _, _, t, _, _ in rows:
        s = [(1.0 if key(t) == key(x) else difflib.SequenceMatcher(None, key(t), key(x)).ratio(), f"a{j}") for j, x in enumerate(titles)]
        top = max(v for v, _ in s)
        best = [k for v, k in s if v == top]
        want = "missing_title" if not key(t) else "no_title_match" if top < 0.9 else "title_year" if len(best) == 1 else "ambiguous_title"
        assert got[i]["matched_by"] == want and (want != "title_year" or got[i]["matched_id"] == best[0])


def test_cleaning_is_one_arrow_evaluation(spark):
    """A text is cleaned in one pass outside the JVM, however often its steps would name it, and as step by step."""
    odd = ["", None, " a  b\x1cc\x85d ", "<p>x</p> &lt;b&gt; &amp;amp; <unclosed", "One , two | All Rights Reserved. ", "İ Σ K _ |"]
    df = spark.createDataFrame([(v,) for v in odd], "v string")
    for made, udfs in ((T.clean("v"), 1), (T.strip_boilerplate("v"), 1), (T.quality_flags("v"), 1)):
        plan = df.select(made.alias("x"))._jdf.queryExecution().optimizedPlan().toString()
        assert "regexp_replace" not in plan and plan.count("run(") == udfs
    steps = F.trim(F.regexp_replace(T._bare(T.text("v")), T.SPACE, " "))
    for r in df.where("v is null or not contains(v, '&')").select(T.clean("v").alias("a"), steps.alias("b")).collect():
        assert r["a"] == r["b"]
