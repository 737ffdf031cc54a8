"""Line dedup of whole texts against a plain version: several lines a text, short and long ones, ties and repeats."""

import numpy as np
import pytest

from tessella.llm import lines


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain(rows, per_edit=15, most=2):
    places = sorted(((i is not None, i or 0), k, line) for i, t in rows for k, line in enumerate((t or "").split("\n")) if line.strip(" \t\n\x0b\f\r"))
    firsts = {}
    for i, k, line in places:
        firsts.setdefault(line, (i, k))
    alike = lambda a, b: edits(a, b) <= min(most, min(len(a), len(b)) // per_edit)
    late = {x for x in firsts if any(firsts[y] < firsts[x] and abs(len(x) - len(y)) <= most and alike(x, y) for y in firsts if y != x)}
    gone = {(i, k) for i, k, line in places if line in late or firsts[line] != (i, k)}
    out = {}
    for i, t in rows:
        key = (i is not None, i or 0)
        out[i] = "\n".join(line for k, line in enumerate((t or "").split("\n")) if (key, k) not in gone)
    return out


@pytest.mark.parametrize("seed", range(2))
def test_texts_of_several_lines(spark, seed):
    rng = np.random.default_rng(seed)
    seeds = ["".join(rng.choice(list("abcd e"), int(n))) for n in rng.integers(10, 60, 12)]

    def line():
        x = list(seeds[rng.integers(0, len(seeds))])
        for _ in range(rng.integers(0, 4)):
            at = rng.integers(0, len(x))
            kind = rng.integers(0, 3)
            if kind == 0:
                x[at] = rng.choice(list("xyz"))
            elif kind == 1:
                del x[at]
            else:
                x.insert(at, rng.choice(list("xyzé")))
        return "".join(x)

    rows = [(i, "\n".join(line() for _ in range(rng.integers(1, 6)))) for i in range(60)] + [(None, seeds[0]), (100, None), (101, ""), (102, "\n \n")]
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == plain(rows)


def test_lines_unlike_in_a_number(spark):
    rows = [(i, f"the record that was entered under number {i:05d} of this list") for i in range(0, 3000, 7)]
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == plain(rows)


def test_short_lines(spark):
    rows = [(1, "a" * 14), (2, "a" * 13 + "b"), (3, "c" * 29), (4, "c" * 28 + "d"), (5, "c" * 27 + "ef"), (6, "c" * 30), (7, "q" * 30), (8, "q" * 28)]
    got = {r["doc_id"]: r["n_removed"] for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: 0, 2: 0, 3: 0, 4: 1, 5: 0, 6: 1, 7: 0, 8: 0}


def test_keys_are_made_by_methods_that_the_jvm_compiles(spark, tmp_path):
    import re

    from pyspark.sql import functions as F

    df = spark.createDataFrame([("a" * n + x,) for n in range(15, 70) for x in ("", "é")], "line string")
    df.select("line", F.xxhash64("line").alias("h1")).withColumn("chars", F.length("line")).write.parquet(f"{tmp_path}/lines")
    keyed = lines.with_keys(spark.read.parquet(f"{tmp_path}/lines"), "line", "chars", 2, 15)
    debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    code = debug.codegenString(keyed._jdf.queryExecution().executedPlan())
    assert max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", code))) < 8000
    # 4 keys of one threshold, 12 of the other
    want = sum(4 * (15 <= n < 31) + 12 * (n >= 30) for n in [*range(15, 70), *range(16, 71)])
    assert keyed.count() == want
