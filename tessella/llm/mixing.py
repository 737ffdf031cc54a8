"""Mixing of sources to target weights: how many words of which document a corpus takes.

Sources get a share of all words by weight; none gets more than ``most`` times its own words, and what it can't take is shared out among
the others by weight. A target is met in epochs: whole passes over the source, and a part of one more. For that part, every document draws a
hash-random key; the source is sorted by it in ranges of some hundred documents, the ranges' words are summed, and prefix sums over ranges
give each document its place. Documents that end before the rest of the budget are taken whole, the one on its edge in part, so a source takes
the whole number of words below its target exactly.

All of it is DataFrame functions. A range is a key of its own, so a source that holds most rows is dealt to as many tasks as it has ranges;
prefix sums over ranges are taken in two steps, so that a window of one task holds one row for a million documents of a source.

Defined results: a null text has no words and takes none; a null source is a source of its own and comes last. Rows that repeat are documents
of their own; where such a row is on the edge, one of them is taken in part, and which of the equal rows says nothing. A null id has the key
of an empty one. Sources without words have the target 0. An empty table gives an empty one. Other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.groups import bring_back, placed
from tessella.session import settle

#: Documents that a range holds on average, and ranges that are summed together.
RANGE, TOGETHER = 500, 2000
BLANK = r"\x20\x09-\x0D"


def n_words(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``: each becomes one letter together with the blanks beside it."""
    letters = F.regexp_replace(text, f"[{BLANK}]*[^{BLANK}]+[{BLANK}]*", "x")
    return F.when(text.rlike(f"[^{BLANK}]"), F.length(letters)).otherwise(0).cast("bigint")


def targets(sources: DataFrame, weights: list[int], most: int) -> DataFrame:
    """``sources`` (source, source_size, ...) with the ``target`` of each, in words.

    With all sources in the order of most * size / weight, those that are capped come first: a source is capped if the rest of the words,
    shared out among it and all after it, gives it more than its cap.
    """
    cycle = F.array(*[F.lit(w).cast("bigint") for w in weights])
    known = placed(sources, [F.col("source").asc_nulls_last()], {}, "mix-sources")
    known = known.withColumn("weight", F.element_at(cycle, (F.col("place") % len(weights) + 1).cast("int"))).withColumn("cap", F.col("source_size") * most).drop("place")
    ratio = F.col("cap").cast("double") / F.col("weight")
    running = placed(known, [ratio, F.col("source").asc_nulls_last()], {"caps": "cap", "weights": "weight"}, "mix-targets")
    whole = known.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weights")).first()
    big = lambda c: F.col(c).cast("decimal(38,0)")
    fixed = lambda n: F.lit(str(n or 0)).cast("decimal(38,0)")
    left, shares = fixed(whole["words"]) - (big("caps") - big("cap")), fixed(whole["weights"]) - (big("weights") - big("weight"))
    judged = running.withColumn("capped", big("cap") * shares < left * big("weight"))
    rest = judged.agg(F.sum(F.when(F.col("capped"), F.col("cap"))).alias("held"), F.sum(F.when(~F.col("capped"), F.col("weight"))).alias("sharing")).first()
    shared = (F.col("weight") * F.lit((whole["words"] or 0) - (rest["held"] or 0))).cast("double") / float(rest["sharing"] or 1)
    return judged.select(*sources.columns, F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(shared).alias("target"))


def mix(
    docs: DataFrame, weights: list[int], most: int = 3, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """doc_id, source, size, source_size, target, epochs (whole passes), rank key and taken words of every document.

    ``weights`` are given to the sources in the order of their code points, again and again; null comes last.
    """
    column = lambda c: F.col(f"`{c}`")
    size = F.coalesce(n_words(column(text_col).cast("string")), F.lit(0).cast("bigint"))
    rows = settle(docs.select(column(id_col).alias("doc_id"), column(source_col).cast("string").alias("source"), size.alias("size")), "mix-sizes")
    sources = settle(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), "mix-source-sizes")
    total = sources.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    aims = targets(sources, weights, most)
    budget = F.floor("target").cast("bigint")
    aims = aims.withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(0).cast("bigint"))
    aims = aims.withColumn("rest", budget - F.col("epochs") * F.col("source_size")).withColumn("ranges", F.ceil(F.col("n") / RANGE).cast("bigint"))
    aims = settle(aims, "mix-aims")
    known = bring_back(rows, aims, "source", "n", total)
    own = F.concat_ws(":", F.lit(seed), F.col("epochs").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    keyed = known.withColumn("key", F.md5(own.cast("binary")))
    # the key's first 52 bits, as a share of 1, times the number of ranges: ranges are in the order of keys
    share = F.conv(F.substring("key", 1, 13), 16, 10).cast("double") / float(2**52)
    ranged = settle(keyed.withColumn("range", F.least(F.floor(share * F.col("ranges")).cast("bigint"), F.col("ranges") - 1)), "mix-ranges")

    sums = ranged.groupBy("source", "range").agg(F.sum("size").alias("words")).withColumn("group", F.expr(f"range div {TOGETHER}"))
    earlier = lambda *by: Window.partitionBy("source", *by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("bigint")
    groups = sums.groupBy("source", "group").agg(F.sum("words").alias("words")).select(
        F.col("source").alias("g_source"), F.col("group").alias("g_group"), F.coalesce(F.sum("words").over(earlier("group")), none).alias("groups_before")
    )
    inside = sums.withColumn("ranges_before", F.coalesce(F.sum("words").over(earlier("group", "range")), none))
    starts = inside.join(groups, F.col("source").eqNullSafe(F.col("g_source")) & (F.col("group") == F.col("g_group"))).select(
        F.col("source").alias("s_source"), F.col("range").alias("s_range"), (F.col("ranges_before") + F.col("groups_before")).alias("start")
    )
    within = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.withColumn("before", F.coalesce(F.sum("size").over(within), none))
    found = summed.join(starts, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("range") == F.col("s_range")))
    part = F.greatest(none, F.least(F.col("size"), F.col("rest") - F.col("start") - F.col("before")))
    return found.select("doc_id", "source", "size", "source_size", "target", "epochs", "key", (F.col("epochs") * F.col("size") + part).alias("taken"))
