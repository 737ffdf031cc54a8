"""Quality rules: word statistics and a hashed n-gram log-likelihood ratio, in DataFrame functions only.

Words and pairs of adjacent words are hashed into ``BUCKETS`` features. One multinomial is fitted to
every document of the corpus and one to trusted documents; a document's score is the mean, over its
features, of log(trusted share / corpus share). A document is kept if it passes the base rule and
its score is not under ``THRESHOLD``. Scoring is a pure function of the two tables of counts, which have
``BUCKETS`` rows each, whatever the corpus holds.

Trusted documents are those labelled good and not toxic: at most ``TRUSTED`` of them, the ones with
the smallest hashes of their ids. The corpus counts cover all documents.

Defined results: null texts have no words; a document without words fails the base rule and has a
null score; null ids are scored like others and are never trusted; without trusted documents the
score is 0 for all; equal rows give equal rows; other columns play no part.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.native import opaque

BUCKETS = 1 << 16
TRUSTED = 20_000
THRESHOLD = -0.09
#: Pseudo-count of every feature among the trusted ones; the corpus gets as many in proportion to its size.
PRIOR = 8
_BLANK = " \t\n\x0b\f\r"


def words_of(text: Column) -> Column:
    """Runs of other than ASCII white space."""
    bare = F.btrim(text, F.lit(_BLANK))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[ \t\n\x0b\f\r]+"))


def features(hashes: Column) -> Column:
    """Buckets of the words and of the adjacent pairs."""
    single = F.transform(hashes, lambda h: F.pmod(h, F.lit(BUCKETS)).cast("int"))
    pairs = F.transform(
        F.sequence(F.lit(1), F.size(hashes) - 1),
        lambda i: F.pmod(F.xxhash64(F.get(hashes, i - 1), F.get(hashes, i)), F.lit(BUCKETS)).cast("int"),
    )
    return F.when(F.size(hashes) < 2, single).otherwise(F.concat(single, pairs))


def windows_of_three(hashes: Column) -> Column:
    """Hashes of the windows of three adjacent words; none for texts that can't repeat one."""
    windows = F.transform(
        F.sequence(F.lit(0), F.size(hashes) - 3),
        lambda i: F.xxhash64(F.get(hashes, i), F.get(hashes, i + 1), F.get(hashes, i + 2)),
    )
    return F.when(F.size(hashes) < 4, F.array().cast("array<bigint>")).otherwise(windows)


def _covered(windows: Column) -> tuple[Column, Column]:
    """How many positions lie under windows that occur twice or more, from ``_placed``; and ``_placed``, the sorted windows with their positions."""
    placed = F.array_sort(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))

    def starts(items: Column) -> Column:
        n = F.size(items)
        twice = F.filter(
            F.transform(
                items,
                lambda x, k: F.when(
                    ((k > 0) & (F.get(items, k - 1)["w"] == x["w"]))
                    | ((k < n - 1) & (F.get(items, k + 1)["w"] == x["w"])),
                    x["i"],
                ),
            ),
            lambda i: i.isNotNull(),
        )
        return F.array_sort(twice)

    def count(at: Column) -> Column:
        return F.aggregate(
            at,
            F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
            lambda s, i: F.struct((s["n"] + F.least(F.lit(3), i - s["last"])).alias("n"), i.alias("last")),
            lambda s: s["n"],
        )

    return F.aggregate(F.array(starts(F.col("_placed"))), F.lit(0), lambda a, at: a + count(at)), placed


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple | list = ()) -> DataFrame:
    """Word counts of every document, beside ``_hashes``, the hashes of its words, and the columns to ``carry`` along."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text.alias("_text"), *carry)
    base = base.withColumn("_words", words_of(F.col("_text")))
    lines = F.filter(F.split("_text", "\n"), lambda line: F.btrim(line, F.lit(_BLANK)) != "")
    base = base.select(
        "doc_id", *carry,
        F.size("_words").cast("bigint").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("bigint").alias("word_chars"),
        F.length(F.regexp_replace("_text", r"[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"),
        lines.alias("_lines"),
        opaque(F.transform("_words", lambda w: F.xxhash64(w))).alias("_hashes"),
    )
    base = base.select(
        "doc_id", *carry, "n_words", "word_chars", "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        "_hashes", opaque(windows_of_three(F.col("_hashes"))).alias("_windows"),
    )
    covered, placed = _covered(F.col("_windows"))
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    base = base.select(
        "doc_id", *carry, "n_words", "word_chars", "n_symbols", "n_dup_lines", "_hashes",
        opaque(F.when(repeats, placed)).alias("_placed"),
    )
    return base.select(
        "doc_id", *carry, "n_words", "word_chars", "n_symbols", "n_dup_lines",
        F.when(F.col("_placed").isNull(), F.lit(0)).otherwise(covered).cast("bigint").alias("n_repeat_words"),
        "_hashes",
    )


def fit(docs: DataFrame, labels: DataFrame | None, id_col: str = "doc_id", text_col: str = "text") -> list[float]:
    """The weight of each bucket: log of its trusted share over its corpus share. ``BUCKETS`` numbers."""
    if labels is None:
        return [0.0] * BUCKETS
    chosen = (
        labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null")
        .select(F.col("doc_id").cast("bigint").alias("doc_id"))
        .distinct()
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(TRUSTED)
        .withColumn("_trusted", F.lit(1))
    )
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    hashed = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.transform(words_of(text), lambda w: F.xxhash64(w)).alias("_h")
    ).join(F.broadcast(chosen), "doc_id", "left")
    counts = (
        hashed.select("_trusted", F.explode(features(F.col("_h"))).alias("b"))
        .groupBy("b")
        .agg(F.count("*").alias("raw"), F.count("_trusted").alias("trusted"))
        .collect()
    )
    raw, trusted = [0] * BUCKETS, [0] * BUCKETS
    for row in counts:
        raw[row["b"]], trusted[row["b"]] = row["raw"], row["trusted"]
    all_raw, all_trusted = sum(raw), sum(trusted)
    if not all_trusted:
        return [0.0] * BUCKETS
    # the corpus' pseudo-counts are in proportion to its size, so both shares of an unseen feature are alike
    return [
        round(math.log((t + PRIOR) / (all_trusted + PRIOR * BUCKETS)) - math.log((r + more) / (all_raw + more * BUCKETS)), 6)
        for more in [PRIOR * all_raw / all_trusted]
        for t, r in zip(trusted, raw)
    ]


def assess(
    docs: DataFrame,
    weights: list[float],
    threshold: float = THRESHOLD,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: tuple | list = (),
) -> DataFrame:
    """Statistics, score and verdict of every document, behind the columns to ``carry`` along."""
    table = F.split(F.lit(",".join(f"{w:g}" for w in weights)), ",").cast("array<double>")
    found = statistics(docs, id_col, text_col, carry).withColumn("_features", opaque(features(F.col("_hashes"))))
    total = F.aggregate("_features", F.lit(0.0), lambda a, b: a + F.get(table, b))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    score = F.when(F.size("_features") > 0, F.round(total / F.size("_features"), 6))
    return (
        found.select("*", opaque(score).alias("llr"), opaque(failed).alias("base_failed"))
        .withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("llr") >= threshold, F.lit(False)))
        .select(
            "doc_id", *carry, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr"
        )
    )
