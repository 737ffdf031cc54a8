"""Closed forms against literal loops, similarities against DuckDB, estimators against known answers."""

import random
from pathlib import Path

import duckdb
import numpy as np
from pyspark.sql import functions as F

from tessella import session
from tessella.functions.similarity import damerau_levenshtein_of, jaro_winkler_of
from tessella.operators import describe, estimators, sequence
from tessella.plans import catalog, reports
from tessella.sources import readers


def test_fill_nearest_is_the_loop(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for page in range(60):
        n = rng.randrange(1, 12)
        street = [rng.choice([None, "a", "b"]) for _ in range(n)]
        number = [rng.choice([None, *range(0, 30, 4)]) for _ in range(n)]
        rows += [(page * 100 + i, page, s, x) for i, (s, x) in enumerate(zip(street, number))]
        linked = [i > 0 and number[i] is not None and number[i - 1] is not None and abs(number[i] - number[i - 1]) <= 6 for i in range(n)]
        while True:  # nulls take the next, then the previous neighbour's value, at once in every pass
            before = list(street)
            for i in range(n):
                if before[i] is None:
                    if i + 1 < n and linked[i + 1] and before[i + 1] is not None:
                        street[i] = before[i + 1]
                    if i > 0 and linked[i] and before[i - 1] is not None:
                        street[i] = before[i - 1]
            if street == before:
                break
        want |= {page * 100 + i: s for i, s in enumerate(street)}
    df = spark.createDataFrame(rows, "id int, page int, street string, num int")
    got = {r["id"]: r["filled"] for r in sequence.fill_nearest(df, "street", "num", ["page"], "id", 6).collect()}
    assert got == want


def test_similarities_are_duckdbs():
    rng = random.Random(2)
    pairs = [("", ""), ("ca", "abc"), ("abxy", "abqr"), ("same", "same")]
    pairs += [tuple("".join(rng.choice("abcd") for _ in range(rng.randrange(1, 9))) for _ in "xy") for _ in range(300)]
    for a, b in pairs:
        jw, dl = duckdb.execute("select jaro_winkler_similarity(?, ?), damerau_levenshtein(?, ?)", [a, b, a, b]).fetchone()
        assert damerau_levenshtein_of(a, b) == dl
        assert abs(jaro_winkler_of(a, b) - jw) < 1e-9 or not (a and b)


def test_estimators_recover_what_made_the_data(spark):
    df = spark.range(2000).select(
        (F.col("id") % 13).alias("a"), (F.col("id") % 7).alias("b"), (F.col("id") % 50).alias("g")
    ).withColumn("y", 2 + 3 * F.col("a") - F.col("b"))
    fit = {r["term"]: r["coef"] for r in estimators.ols(df, ["a", "b"], "y", cluster="g").collect()}
    assert np.allclose([fit["const"], fit["a"], fit["b"]], [2, 3, -1])
    counts = df.withColumn("z", F.floor(F.exp(0.5 + 0.1 * F.col("a"))))
    beta, _ = estimators.glm(counts, ["a"], "z", "poisson")
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    ready = VectorAssembler(inputCols=["a"], outputCol="x").transform(counts)
    model = GeneralizedLinearRegression(family="poisson", link="log", featuresCol="x", labelCol="z", tol=1e-10).fit(ready)
    assert np.allclose(beta, [model.intercept, model.coefficients[0]], atol=1e-6)
    draws = estimators.bootstrap(df, ["a", "b"], "y", "g", 5)
    assert draws.count() == 15


def test_bootstrap_draws_are_weighted_fits(spark):
    rng = np.random.default_rng(4)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(rng.normal(size=400), rng.normal(size=400)))]
    df = spark.createDataFrame(rows, "id bigint, a double, b double").withColumn("y", F.col("a") + F.col("b"))
    keys = np.array([r["k"] for r in df.orderBy("id").select(F.xxhash64("id").alias("k")).collect()], dtype=np.int64)
    got = {(r["draw"], r["term"]): r["coef"] for r in estimators.bootstrap(df, ["a"], "y", "id", 130).collect()}
    x, y = np.array([[1.0, a] for _, a, _ in rows]), np.array([a + b for _, a, b in rows])
    weights = estimators.draw_weights(keys, np.arange(130)).astype(float)
    assert abs(weights.mean() - 1) < 0.02 and abs(weights.var() - 1) < 0.05
    for d in range(130):
        want = np.linalg.solve((x.T * weights[d]) @ x, (x.T * weights[d]) @ y)
        assert np.allclose([got[d, "const"], got[d, "a"]], want)


def test_bootstrap_se_has_the_references_draws(spark, sf, monkeypatch):
    seen, real = [], estimators.bootstrap
    monkeypatch.setattr(estimators, "bootstrap", lambda *a: seen.append(a[-1]) or real(*a))
    got = {r["term"]: r for r in catalog.queries()["bootstrap_se"](spark, sf).collect()}
    assert seen == [1000] and set(got) == {"const", "q", "d"}
    assert all(r["low"] < r["high"] and r["se"] > 0 for r in got.values())


def test_haversine_takes_the_row_before_over_gaps(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/nation.parquet").write.parquet(str(tmp_path / "nation.parquet"))
    gaps = spark.read.parquet(f"{sf}/customer.parquet").where("c_custkey % 7 not in (2, 3)")
    far = gaps.withColumn("c_custkey", F.when(F.col("c_custkey") > 60, F.col("c_custkey") + 20_000_000).otherwise(F.col("c_custkey")))
    far.write.parquet(str(tmp_path / "customer.parquet"))
    con = duckdb.connect()
    for name in ("customer", "nation", "supplier"):
        con.execute(f"create view {name} as select * from '{sf if name == 'supplier' else tmp_path}/{name}.parquet{'' if name == 'supplier' else '/*.parquet'}'")
    want = con.execute(catalog.oracle_sql()["haversine_tiebreak"]).fetchall()
    got = catalog.queries()["haversine_tiebreak"](spark, str(tmp_path)).select("id", "first_m").collect()
    assert len(got) == gaps.count() - 1
    assert np.allclose(sorted(map(tuple, got)), sorted(want), atol=0.011)


def test_ranks_and_reports(spark):
    df = spark.createDataFrame([(i, float(i * 7 % 31)) for i in range(200)], "id int, v double")
    got = [r["id"] for r in describe.ranked(df, "v", "id").orderBy("rank").collect()]
    assert got == sorted(range(200), key=lambda i: (i * 7 % 31, i))
    fit = spark.createDataFrame([("a", 1.0, 0.5, 0.02)], "term string, coef double, se double, p double")
    cells = reports.merge_columns({"one": reports.regression_cells(fit), "two": reports.regression_cells(fit.withColumn("term", F.lit("b")))})
    assert "1.000** (0.500)" in reports.latex(cells, "c", "t")


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("s,v\n1,2.5\n2,NaN\n3,1\n")
    got = readers.read_csv(spark, str(tmp_path / "a.csv"), "s int, v double", "s", [1, 2]).collect()
    assert [tuple(r) for r in got] == [(1, 2.5), (2, None)]
    a, b = spark.createDataFrame([(1, "x")], "k int, v string"), spark.createDataFrame([(1, "y"), (2, "z")], "k int, v string")
    assert sorted(map(tuple, readers.append_missing(a, b, ["k"]).collect())) == [(1, "x"), (2, "z")]


def test_settled_tables_are_deleted(spark):
    kept, done = (session.settle(spark.range(n), "t") for n in (3, 4))
    session.discard(done)
    assert kept.count() == 3
    assert not Path(done.settled_at.removeprefix("file://")).exists()


def test_similarities_of_batches_equal_those_of_pairs():
    import numpy as np
    import pandas as pd

    from tessella.functions import similarity

    rng = np.random.default_rng(0)
    word = lambda: "".join(rng.choice(list("abcé "), rng.integers(0, 14)))
    left = [word() for _ in range(1500)] + ["", "x", "same", "a" * 80]
    right = [word() if rng.random() < 0.5 else a[1:2] + a[:1] + a[2:] for a in left[:-4]] + ["", "", "same", "a" * 79 + "b"]
    assert similarity.damerau_levenshtein_batch(left, right).tolist() == [similarity.damerau_levenshtein_of(a, b) for a, b in zip(left, right)]
    assert np.abs(similarity.jaro_winkler_batch(left, right) - [similarity.jaro_winkler_of(a, b) for a, b in zip(left, right)]).max() < 1e-12
    got = similarity._in_batches(pd.Series([None, "ab", "q" * 70]), pd.Series(["x", "ba", "q" * 70]), similarity.damerau_levenshtein_batch, similarity.damerau_levenshtein_of)
    assert np.isnan(got[0]) and got[1:].tolist() == [1, 0]


def test_exact_quantiles(spark):
    import numpy as np

    from tessella.operators.describe import exact_quantiles

    rng = np.random.default_rng(2)
    shares = [0.0, 0.1, 0.333, 0.5, 0.95, 1.0]
    for values in (rng.normal(size=1001), rng.integers(0, 4, 500).astype(float), np.array([3.0]), np.concatenate([np.full(400, 7.0), rng.normal(size=50)])):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double")
        assert np.allclose(exact_quantiles(df, "x", shares, 16), np.quantile(values, shares))
    assert exact_quantiles(spark.createDataFrame([], "x double"), "x", [0.5]) == [None]


def test_rolling_means_and_ranks_of_hot_groups(spark):
    rng = np.random.default_rng(9)
    rows = [(int(k), "hot" if k % 10 else None, int(k) // 4, float(v) if k % 6 else None) for k, v in enumerate(1e6 + rng.normal(size=3000))]
    df = spark.createDataFrame(rows, "id int, g string, tied int, v double").repartition(7)
    got = {r["id"]: r["mean"] for r in sequence.centred_mean(df, "v", ["g"], ["tied", "id"], least=7, part=300, rows=3).collect()}
    for group in ("hot", None):
        own = sorted((t, i, v) for i, g, t, v in rows if g == group)
        width = max(7, len(own) // 300)
        for k, (_, i, _) in enumerate(own):
            some = [v for _, _, v in own[max(0, k - width // 2) : k + (width - 1) // 2 + 1] if v is not None]
            assert (got[i] is None) == (len(some) < 3) and (len(some) < 3 or abs(got[i] - sum(some) / len(some)) < 1e-7)
    values = [1.0] * 500 + [2.0, 7.5, 7.5] + [3.0] * 40
    ordered = sorted(values)
    want = sum((2 * (i + 1) - len(ordered) - 1) * x for i, x in enumerate(ordered)) / len(ordered) / sum(ordered)
    assert abs(describe.gini(spark.createDataFrame([(v,) for v in values], "v double"), "v").first()["gini"] - want) < 1e-8


def test_house_numbers_of_the_same_street(spark):
    rows = [(1, "a", 5, 0), (2, "a", None, 0), (3, "a", None, 1), (4, "b", None, 0), (5, "b", None, 1), (6, None, None, 0), (7, None, None, 1), (8, "b", 9, 1), (9, "b", None, 1), (10, "b", None, 1), (11, "b", None, None)]
    df = spark.createDataFrame(rows, "id int, street string, number int, own int").withColumn("p", F.lit(1))
    got = {r["id"]: r["filled"] for r in sequence.fill_numbers(df, "number", "street", F.col("own") == 1, ["p"], "id").collect()}
    assert got == {1: 5, 2: 5, 3: 7, 4: None, 5: None, 6: None, 7: None, 8: 9, 9: 11, 10: None, 11: None}
