"""Title matching by prefix filter against comparing all with all."""

import difflib
import random
from collections import Counter

from pyspark.sql import functions as F

from folioscope.operators import enrich as E
from folioscope.operators import titles as Y


def some_titles(n, seed, longest=14):
    rng = random.Random(seed)
    words = ["growth", "trade", "a", "of", "the", "effects", "on", "labor", "markets", "evidence", "from", "q", "x1", "policy", "1990", "firm", "zz", "theory", "optimal", "jazz"]
    out = []
    for _ in range(n):
        t = list(" ".join(rng.choices(words, k=rng.randint(1, longest))))
        if out and rng.random() < 0.6:
            t = list(rng.choice(out))
            for _ in range(rng.randint(0, 1 + len(t) // 12)):
                at = rng.randrange(len(t) + 1)
                t[at : at + rng.randint(0, 2)] = rng.choices("aeqz 1", k=rng.randint(0, 2))
        t = " ".join("".join(t).split())
        out.append(t or "x")
    return out


def overlap(a, b):
    return sum((Counter(a) & Counter(b)).values())


def test_pairs_are_all_that_the_bound_allows(spark):
    for minimum, longest, seed in ((0.9, 14, 1), (0.9, 120, 2), (0.75, 5, 3), (0.5, 3, 4), (1.0, 6, 5)):
        left, right = sorted(set(some_titles(70, seed, longest))), sorted(set(some_titles(80, seed + 50, longest) + some_titles(40, seed, longest)))
        years = lambda t: "1990" if len(t) % 2 else "1991"
        df = lambda ts, n: spark.createDataFrame([(y, t) for t in ts for y in ({"1990", years(t)})] + [("1990", ""), (None, "the one")], f"y string, {n} string")
        got = Counter((r["y"], r["l"], r["r"], r["overlap"]) for r in Y.bounded_pairs(df(left, "l"), df(right, "r"), minimum, ["y"]).collect())
        want = Counter((y, a, b, overlap(a, b)) for y in ("1990", "1991") for a in left for b in right if y in {"1990", years(a)} and y in {"1990", years(b)} and 2 * overlap(a, b) >= minimum * (len(a) + len(b)) - 1e-9)
        assert got == want and want
        near = [(a, b) for a in left for b in right if difflib.SequenceMatcher(None, a, b).ratio() >= minimum]
        assert {(a, b) for a, b in near} <= {(a, b) for _, a, b, _ in want}


def test_best_titles(spark):
    asks, known = some_titles(60, 7), some_titles(150, 8) + some_titles(60, 7)[:20] * 2
    got = {r["t"]: (r["best"], r["n"], r["key"]) for r in Y.best_titles(spark.createDataFrame([(t,) for t in asks * 2], "t string"), spark.createDataFrame([(t, f"{i:04d}") for i, t in enumerate(known)], "t string, key string")).collect()}
    want = {}
    for a in set(asks):
        scores = [(1.0 if a == k else difflib.SequenceMatcher(None, a, k).ratio(), f"{i:04d}") for i, k in enumerate(known)]
        top = max(s for s, _ in scores)
        if top >= 0.9:
            want[a] = (top, sum(s == top for s, _ in scores), min(i for s, i in scores if s == top))
    assert got == want and any(n > 1 for _, n, _ in want.values()) and any(s < 1 for s, _, _ in want.values())


def test_a_hot_year_is_not_compared_with_itself(spark):
    """One year with 3,000 different titles, a third of the rows being one title: few pairs reach the matcher."""
    rng = random.Random(11)
    letters = "etaoinshrdlucmfwypvbgkjqxz"
    word = lambda: "".join(rng.choices(letters, weights=[26 - i for i in range(26)], k=rng.randint(2, 9)))
    titles = [" ".join(word() for _ in range(rng.randint(5, 10))) for _ in range(3000)]
    known = spark.createDataFrame([(t, str(i), "1990") for i, t in enumerate(titles)] + [(titles[0], f"c{i}", "1990") for i in range(1500)], "t string, key string, y string")
    asks = spark.createDataFrame([(t[:-1] + "e", "1990") for t in titles[::10]], "t string, y string")
    pairs = Y.bounded_pairs(asks.select("y", F.col("t").alias("l")).distinct(), known.select("y", F.col("t").alias("r")).distinct(), 0.9, ["y"])
    assert pairs.count() < 0.01 * 300 * 3000
    best = Y.best_titles(asks, known, 0.9, ["y"])
    assert best.where("best >= 0.9").select("t").distinct().count() == len({t[:-1] + "e" for t in titles[::10]})
    assert best.where(F.col("t") == titles[0][:-1] + "e").first()["n"] == 1501


def test_backfill_against_rules_one_by_one(spark):
    rng = random.Random(5)
    pool = some_titles(60, 21)
    articles = [(f"a{i:02d}", rng.choice(["", f"10.1/{i % 30}"]), rng.choice(pool), rng.choice(["1990", "1991", ""])) for i in range(80)]
    rows = [(i, rng.choice(["", "", f"a{rng.randrange(90):02d}"]), rng.choice(["", "", f"10.1/{rng.randrange(32)}"]), rng.choice([*pool, ""]), rng.choice(["1990", "1991", "", "2000"]), rng.choice(["text", "text", ""])) for i in range(150)]
    got = {r["row_number"]: (r["matched_id"], r["matched_by"], r["error"]) for r in E.match_backfill(spark.createDataFrame(rows, "row_number int, article_id string, doi string, title string, publication_year string, abstract string"), spark.createDataFrame(articles, "article_id string, doi string, title string, publication_year string")).collect()}
    ratio = lambda a, b: 0.0 if not a or not b else 1.0 if a == b else difflib.SequenceMatcher(None, a, b).ratio()
    of, seen = {a[0]: a for a in articles}, set()
    for n, aid, doi, title, year, abstract in rows:
        if aid:
            match, how = (aid, "article_id") if aid in of else (None, "unknown_article_id")
        elif doi:
            same = [a[0] for a in articles if a[1] == doi]
            match, how = (same[0], "doi") if len(same) == 1 else (None, "ambiguous_doi" if same else "unknown_doi")
        elif not title:
            match, how = None, "missing_title"
        else:
            scores = sorted(((ratio(title, a[2]), a[0]) for a in articles if not year or a[3] == year), reverse=True)
            scores = [s for s in scores if s[0] >= 0.9]
            match, how = (None, "no_title_match") if not scores else (None, "ambiguous_title") if len(scores) > 1 and scores[0][0] == scores[1][0] else (scores[0][1], "title_year")
        fits = match is not None and (not title or ratio(title, of[match][2]) >= 0.9)
        error = "missing_abstract" if not abstract else "unmatched_article" if match is None else "duplicate_backfill_article_id" if match in seen else "" if fits else "title_mismatch"
        if not error:
            seen.add(match)
        assert got[n][1:] == (how, error), (n, got[n], match, how, error)
        assert error or got[n][0] == match


def test_blocks_meet_each_two_titles_once(spark, monkeypatch):
    """A band of many blocks, long titles that all lie within the bound, other columns beside the numbers, and a table that meets itself."""
    monkeypatch.setattr(Y, "BLOCK", 7)
    rng = random.Random(3)
    titles = sorted({"".join(rng.choices("eeetao ", k=rng.choice([9, 11, 300, 320]))).strip() or "x" for _ in range(150)})
    rows = [(n, t, f"m{n}", "1990" if n % 3 else "1991") for n, t in enumerate(titles)] + [(900, "", "m", "1990"), (901, "a title", "m", None), (902, None, "m", "1990")]
    df = spark.createDataFrame(rows, "n long, t string, m string, y string")
    side = lambda n: df.selectExpr("y", f"n as {n}", "t", f"m as {n}_m")
    got = Counter(tuple(r) for r in Y.overlapping(side("l"), side("r"), 0.9, ["y"], ordered=True).select("y", "l", "r", "l_m", "r_m", "overlap").collect())
    want = Counter((ya, i, j, f"m{i}", f"m{j}", overlap(a, b)) for i, a, _, ya in rows[:-3] for j, b, _, yb in rows[:-3] if i < j and ya == yb and 2 * overlap(a, b) >= 0.9 * (len(a) + len(b)) - 1e-9)
    assert got == want and len(want) > 1000


def test_the_longest_common_subsequence_bounds_the_ratio():
    for minimum, longest, seed in ((0.9, 14, 31), (0.9, 120, 32), (0.5, 20, 33), (1.0, 6, 34)):
        titles = some_titles(70, seed, longest)
        reached = [(a, b) for a in titles for b in titles if difflib.SequenceMatcher(None, a, b).ratio() >= minimum]
        assert reached and all(Y.may_reach(a, b, minimum) for a, b in reached)
        a, b = "ab" * 20, "ba" * 20 + "cccc"  # the subsequence is 39 long
        assert [Y.may_reach(a, b, m) for m in (78 / 84 - 1e-6, 78 / 84 + 1e-6)] == [True, False]
    assert not Y.may_reach("abc", "", 0.9) and Y.may_reach("abc", "abc", 1.0)


def test_long_titles_with_the_same_letters_do_not_reach_the_matcher(spark):
    """Sixty different titles of some 500 letters, with the same letters: all pairs are within the bound of overlaps, none but equal and near ones come out."""
    rng = random.Random(41)
    words = ["".join(rng.choices("eeeetttaaooiinnsshrdlu", k=rng.randint(2, 8))) for _ in range(300)]
    titles = [" ".join(rng.choices(words, k=90)) for _ in range(60)]
    known = titles + [t[:100] + "x" + t[101:] for t in titles[:20]]
    left = spark.createDataFrame([("1990", t) for t in titles], "y string, l string")
    right = spark.createDataFrame([("1990", t) for t in known], "y string, r string")
    pairs = lambda matched: {(r["l"], r["r"]) for r in Y.bounded_pairs(left, right, 0.9, ["y"], matched=matched).collect()}
    want = {(t, t) for t in titles} | set(zip(titles, known[60:], strict=False))
    assert len(pairs(False)) > 1000 and pairs(True) == want
