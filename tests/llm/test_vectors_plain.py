"""Codes, clusters and mixes against plain versions, on rows that repeat, tie, are null or can't take part."""

import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import clusters, codes, mixing
from tessella.llm.whole import squared_distances

LIMIT = 2**63 - 1


def whole(v, dim):
    if v is None or len(v) != dim or any(x is None or not math.isfinite(x) for x in v):
        return None
    out = [math.floor(256 * float(x)) for x in v]
    return out if max(map(abs, out)) <= math.isqrt(LIMIT // (4 * dim)) - 1 else None


def nearest(x, book):
    return min(((sum((a - b) ** 2 for a, b in zip(x, y)), e) for e, y in enumerate(book)), default=None)


def lloyd(points, book, rounds):
    for _ in range(rounds):
        members = defaultdict(list)
        for x in points:
            members[nearest(x, book)[1]].append(x)
        book = [[sum(c) // len(members[e]) for c in zip(*members[e])] if e in members else y for e, y in enumerate(book)]
    return book


def odd_vectors(n, dim, seed):
    rng = np.random.default_rng(seed)
    rows = [(int(i), [float(x) for x in rng.normal(size=dim).round(1)], int(i) % 4 if i % 7 else None) for i in rng.permutation(n)]
    rows += [rows[0], rows[0], (rows[1][0], rows[2][1], 1), (None, rows[3][1], 2), (n + 1, None, 0), (n + 2, [None] * dim, 0), (n + 3, [math.nan] * dim, 0)]
    rows += [(n + 4, [math.inf] + [0.0] * (dim - 1), 1), (n + 5, [], 1), (n + 6, [1.0] * (dim + 1), 1), (n + 7, [1e30] * dim, 1), (n + 8, [1000.0] + [-0.003] * (dim - 1), None)]
    rows += [(n + 10 + i, rows[4][1], 9) for i in range(3 * n)]  # one vector that most rows hold
    return rows


def frame(spark, rows):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").repartition(5)
    for name in ("n", "v", "at", "keys", "moved", "cluster", "distance", "code", "error", "dim", "_key", "key"):
        df = df.withColumn(name, F.lit("x"))
    return df


def known(rows, dim):
    found = [(i, whole(v, dim), label) for i, v, label in rows]
    return [(i, v, label) for i, v, label in found if v is not None]


def plain_codes(rows, parts, entries, rounds, dim):
    kept = known(rows, dim)
    width = dim // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [lloyd([cut(v, p) for _, v, _ in kept], [cut(v, p) for _, v, _ in first], rounds) for p in range(parts)]
    coded = [(i, label, [nearest(cut(v, p), books[p]) for p in range(parts)]) for i, v, label in kept]
    coded = [(i, label, bytes(e for _, e in c), sum(d for d, _ in c)) for i, label, c in coded]
    sums = Counter()
    for _, label, _, e in coded:
        sums[label] += e
    return Counter((i, code, e, sums[label]) for i, label, code, e in coded), ",".join(str(x) for b in books for y in b for x in y)


@pytest.mark.parametrize("entries, rounds", [(8, 2), (64, 4), (1, 2), (200, 1)])
def test_codes(spark, entries, rounds):
    rows = odd_vectors(80, 8, entries)
    found, books = codes.compress(frame(spark, rows), parts=4, entries=entries, rounds=rounds)
    due, components = plain_codes(rows, 4, entries, rounds, 8)
    assert Counter((r["vec_id"], bytes(r["code"]), r["error"], r["label_error"]) for r in found.collect()) == due
    assert codes.digest(books) == hashlib.sha256(components.encode()).hexdigest()


def test_codes_of_nothing(spark):
    for rows in ([], [(1, None, 1), (2, [1.0, 2.0, 3.0], 1), (3, [math.nan] * 4, 1)]):
        found, books = codes.compress(frame(spark, rows), parts=4)
        assert found.count() == 0 and books.shape[1] == 0
    bare = spark.createDataFrame([(1, [1.0, -1.0])], "vec_id bigint, embedding array<double>")
    assert [(r["vec_id"], bytes(r["code"]), r["error"], r["label_error"]) for r in codes.compress(bare, parts=2)[0].collect()] == [(1, b"\0\0", 0, 0)]


def test_parts_are_skipped_and_nothing_changes():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.integers(-30, 30, size=(60, 2, 3)) + 400 * np.array(c) for c in ([1, 0, 0], [0, 1, 0], [0, 0, 1], [-1, 0, 0])])
    books = x[[0, 1, 60, 120, 180]].transpose(1, 0, 2)
    at = keys = None
    drift, compared = np.zeros((2, 5)), []
    for _ in range(6):
        at, keys, _, n = codes.step(x, at, keys, books, drift)
        compared.append(n)
        new = books.copy()
        for p in range(2):
            assert (at[:, p] == squared_distances(x[:, p], books[p]).argmin(axis=1)).all()
            for e in range(5):
                if (at[:, p] == e).any():
                    new[p, e] = x[at[:, p] == e, p].sum(axis=0) // (at[:, p] == e).sum()
        drift, books = drift + codes._gathered(books, new), new
    assert compared[0] == 480 and sum(compared[1:]) < 0.7 * 480 * 5


def test_wide_numbers_are_compared_exactly():
    x = np.array([[2**27, -(2**27)], [3, 4]])
    assert squared_distances(x, -x).tolist() == [[sum((int(a) + int(b)) ** 2 for a, b in zip(r, s)) for s in x] for r in x]


@pytest.mark.parametrize("k, rounds", [(7, 5), (1, 2), (500, 2)])
def test_clusters(spark, k, rounds):
    rows = odd_vectors(80, 8, k)
    found, centroids = clusters.cluster(frame(spark, rows), k=k, rounds=rounds, dim=8)
    kept = known(rows, 8)
    digest = lambda i: hashlib.sha256(f"2:{i}".encode()).hexdigest()
    first = sorted(kept, key=lambda r: (r[0] is None, digest(r[0]), r[1]))[:k]
    book = lloyd([v for _, v, _ in kept], [v for _, v, _ in first], rounds)
    near = [(i, *nearest(v, book)[::-1]) for i, v, _ in kept]
    sums = Counter()
    for _, e, d in near:
        sums[e] += d
    due = Counter((i, e, d, sums[e], sum(sums.values())) for i, e, d in near)
    assert Counter((r["vec_id"], r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"]) for r in found.collect()) == due
    assert centroids.tolist() == book
    assert clusters.digests(centroids)[0] == hashlib.sha256(",".join(map(str, book[0])).encode()).hexdigest()


def test_clusters_of_nothing(spark):
    assert clusters.cluster(frame(spark, [(1, None, 1), (2, [1.0], 1)]), dim=4)[0].count() == 0


def test_weighted_sums_beyond_a_long():
    x, n = np.array([[2**27, -5], [2**27, 1]]), np.array([2**40, 2**40])
    assert clusters.weighted_sums(x, n, np.array([1, 1]), 2).tolist() == [[0, 0, 0], [2**41, 2**68, -(2**42)]]


def plain_targets(sizes, weights, most):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    capped = set()
    while True:
        left = sum(sizes.values()) - sum(most * sizes[s] for s in capped)
        sharing = sum(weight[s] for s in sizes if s not in capped)
        target = {s: float(most * sizes[s]) if s in capped else left * weight[s] / sharing for s in sizes}
        new = {s for s in sizes if s not in capped and target[s] > most * sizes[s]}
        if not new:
            return target
        capped |= new


def plain_mix(rows, weights, most):
    import re

    docs = [(i, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, s in rows]
    sizes = Counter()
    for _, s, n in docs:
        sizes[s] += n
    target = plain_targets(sizes, weights, most)
    out = Counter()
    for source in sizes:
        aim = math.floor(target[source])
        epochs = aim // sizes[source] if sizes[source] else 0
        rest = aim - epochs * sizes[source]
        own = sorted(((hashlib.md5(f"mix:{epochs}:{'' if i is None else i}".encode()).hexdigest(), i is not None, i or 0, n) for i, s, n in docs if s == source), key=lambda x: x)
        for _, there, i, n in own:
            part = min(n, max(0, rest))
            rest -= n
            out[(i if there else None, source, n, sizes[source], target[source], epochs * n + part)] += 1
    return out


def mixed(spark, rows, weights, **more):
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    for name in ("size", "key", "range", "target", "n", "place", "weight", "cap", "_range", "rest", "words"):
        df = df.withColumn(name, F.lit("x"))
    return [(r["doc_id"], r["source"], r["size"], r["source_size"], r["target"], r["taken"]) for r in mixing.mix(df, weights, **more).collect()]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mix(spark, seed, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE", 10)
    monkeypatch.setattr(mixing, "TOGETHER", 3)
    rng = np.random.default_rng(seed)
    blanks = [" ", "\n", "\t", "\x0b", "\x0c", "\r", "  "]
    texts = ["".join(f"w {j}{blanks[j % 7]}" for j in range(int(rng.integers(0, 30)))) for _ in range(300)]
    rows = [(int(i), t, ["b", "a", "B", "ä", "\U0001f600", "￮", None, ""][int(rng.choice(8, p=[0.4, 0.2, 0.1, 0.1, 0.05, 0.05, 0.05, 0.05]))]) for i, t in enumerate(texts)]
    rows += [(1, "x " * 5000, "long"), (2, None, "a"), (3, "", "none"), (None, "a b c", "a"), rows[5], rows[5], (6, " lead and trail ", None), (7, " \n", "blank")]
    found = mixed(spark, rows, [5, 2, 1])
    assert Counter(found) == plain_mix(rows, [5, 2, 1], 3)
    assert all(t <= 3 * size for _, _, size, _, _, t in found)
    taken = Counter()
    for _, s, _, _, _, t in found:
        taken[s] += t
    assert all(taken[s] == math.floor(target) for _, s, _, _, target, _ in found)
    assert sorted(map(str, found)) == sorted(map(str, mixed(spark, rows, [5, 2, 1])))


def test_mix_of_nothing(spark):
    assert mixed(spark, [], [5, 2, 1]) == []
    assert mixed(spark, [(1, None, None), (2, " ", "a")], [5, 2, 1]) in ([(1, None, 0, 0, 0.0, 0), (2, "a", 0, 0, 0.0, 0)], [(2, "a", 0, 0, 0.0, 0), (1, None, 0, 0, 0.0, 0)])


def test_mix_stays_in_the_jvm(spark):
    df = spark.createDataFrame([(1, "a", "s")], "doc_id bigint, text string, source string")
    plan = mixing.mix(df, [1])._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "CartesianProduct", "NestedLoop"))
