"""The candidate index against all pairs, the pairs that it makes, and the rounds of the street resolver on odd rows."""

import random

import pytest
from pyspark.sql import functions as F

from tessella.functions.similarity import damerau_levenshtein_of, jaro_winkler_of
from tessella.operators import fuzzy, streets


def score(measure, a, b):
    if measure == "jw":
        return round(jaro_winkler_of(a, b), 12) if a and b else float(a == b)
    return 1 - damerau_levenshtein_of(a, b) / max(len(a), len(b), 1)


def plain(words, entries, measure, cutoff):
    out = {}
    for w in words:
        best = min(((-score(measure, w, e), pos, e) for e, pos in entries.items()), default=None)
        if best and -best[0] >= cutoff:
            out[w] = (best[2], -best[0])
    return out


def vocabulary(seed, n, letters, low=1, high=14):
    rng = random.Random(seed)
    return sorted({"".join(rng.choice(letters) for _ in range(rng.randrange(low, high))) for _ in range(n)}), rng


def edited(rng, word, letters):
    for _ in range(rng.randrange(0, 4)):
        at = rng.randrange(0, len(word) + 1)
        word = rng.choice([word[:at] + rng.choice(letters) + word[at:], word[:at] + word[at + 1 :], word[:at] + word[at : at + 2][::-1] + word[at + 2 :]])
    return word


@pytest.mark.parametrize("measure, cutoff", [("dl", 0.7), ("dl", 0.0), ("jw", 0.8), ("jw", 0.55), ("jw", 0.0)])
def test_best_matches_are_those_of_all_pairs(spark, measure, cutoff):
    letters = "aabbccdeéfz\U0001f600 "
    entries, rng = vocabulary(7, 120, letters)
    known = {e: rng.randrange(40) * 1000 + i for i, e in enumerate(entries)}
    words = sorted({edited(rng, rng.choice(entries), letters) for _ in range(60)} | {"", "qqq", "x", "aaaaaaaaaaaaaaaaaaaa"})
    left = spark.createDataFrame([(w,) for w in words + [None, "x"]], "w string")
    dictionary = spark.createDataFrame([(e, p) for e, p in known.items()] + [(e, p + 5) for e, p in known.items()], "entry string, pos int")
    got = {r["w"]: (r["match"], r["score"]) for r in fuzzy.best_match(left, "w", dictionary, measure, cutoff).collect()}
    want = plain(words, known, measure, cutoff)
    assert set(got) == set(want)
    for w in want:
        assert abs(got[w][1] - want[w][1]) < 1e-9 and got[w][0] == want[w][0], w


def test_few_pairs_meet(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    entries, rng = vocabulary(3, 2000, letters, 8, 16)
    ranked = lambda strings: fuzzy._ranked(spark.createDataFrame([(s,) for s in strings], "name string"), counts, "name")
    rows = [(f"{ch}\0{k + 1}",) for e in entries for ch in set(e) for k in range(e.count(ch))]
    counts = spark.createDataFrame(rows, "letter string").groupBy("letter").count()
    words = [edited(rng, e, letters) for e in entries[::10]]
    for measure, threshold, most in (("dl", 0.85, 0.25), ("jw", 0.85, 0.35)):
        posted = ranked(entries).select(F.explode(fuzzy.keys(measure, threshold, False)).alias("key"), F.col("name").alias("e"), F.col("n").alias("m"))
        probes = ranked(words).select(F.explode(fuzzy.keys(measure, threshold, True)).alias("key"), "name", "n")
        met = probes.join(posted, "key").where(fuzzy._lengths(measure, threshold)).select("name", "e").distinct()
        print(measure, met.count() / len(set(words)) / len(entries))
        assert met.count() < most * len(set(words)) * len(entries)


def test_no_nested_loop(spark, monkeypatch):
    plans = []
    settle = fuzzy.settle
    monkeypatch.setattr(fuzzy, "settle", lambda df, label: plans.append(df._jdf.queryExecution().toString()) or settle(df, label))
    left = spark.createDataFrame([("abd",), ("xyz",)], "w string")
    fuzzy.best_match(left, "w", spark.createDataFrame([("abc", 1), ("xyz", 2)], "entry string, pos int"), "dl", 0.0).collect()
    assert len(plans) > 6 and not any("NestedLoop" in p or "Cartesian" in p for p in plans)


def test_rows_without_a_page_need_a_good_match(spark):
    rows = [(1, 1, None, "zzzzqqq"), (2, 1, 7, "zzzzqqq"), (3, 1, None, "main street w"), (4, 1, 7, None), (5, 2, None, "main st"), (6, 2, None, "main stt"), (7, 2, None, "mxin s")]
    df = spark.createDataFrame(rows, "id int, city int, page int, street string")
    known = spark.createDataFrame([("main st", 1), ("oak ave", 2)], "entry string, pos int")
    got = {r["id"]: (r["match"], r["round"]) for r in streets.resolve(df, known, ["city"], "id", "page").collect()}
    assert got == {
        1: ("zzzzqqq", 0), 2: ("main st", 3), 3: ("main street w", 0), 4: (None, None), 5: ("main st", 1), 6: ("main st", 2), 7: ("main st", 4),
    }
    none = streets.resolve(df, known.limit(0), ["city"], "id", "page").collect()
    assert {r["id"]: r["round"] for r in none} == {1: 0, 2: 0, 3: 0, 4: None, 5: 0, 6: 0, 7: 0}
