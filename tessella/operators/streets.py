"""Cleaning of street names and their match to known streets in rounds."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.similarity import jaro_winkler
from tessella.operators.fuzzy import best_match
from tessella.session import ship

# Street suffixes and their short forms, in the order in which they are replaced.
STREET_WORDS = [(r"\bavenue\b", "ave"), (r"\bstreet\b", ""), (r"\broad\b", " rd"), (r"\bdrive\b", "dr"), (r"\bplace\b", "pl"), (r"\bcourt\b", " ct"), (r"-", "")]
# The same for lists of renamed streets.
RENAMED_WORDS = [
    (r"\([^()]*\)", ""), (r"\[\d+\]", ""), (r"\bavenue\b", "ave"), (r"\bstreet\b", "st"), (r"\broad\b", " rd"), (r"\bdrive\b", "dr"),
    (r"\bplace\b", "pl"), (r"\bcourt\b", " ct"), (r"\bboulevard\b", " blvd"), (r"-\s*", ""), (r"'", ""),
]
# Ordinal words of 1 to 20 and their endings.
ORDINALS = ["first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth", "eleventh", "twelfth", "thirteenth", "fourteenth", "fifteenth", "sixteenth", "seventeenth", "eighteenth", "nineteenth", "twentieth"]
ENDINGS = {1: "st", 2: "nd", 3: "rd"}
# Fixed value: house numbers that belong to hotels and the like.
NOT_A_NUMBER = r"([0-9][ ][a-zA-Z])|([0-9][-][a-zA-Z])|([a-zA-Z][ ][0-9])|([a-zA-Z][-][0-9])"
# Fixed value: hotel, street and note of an entry.
ENTRY = r"^(?:([\w\s]+hotel)\s+)?([^\(]+?)(?:\s*\(([^)]*)\))?\s*$"


def replaced(text: Column, words: list[tuple[str, str]]) -> Column:
    """Lower case with each pattern replaced, one after the other, and blanks cut off."""
    out = F.lower(text)
    for pattern, by in words:
        out = F.regexp_replace(out, pattern, by)
    return F.trim(out)


def street_parts(text: Column) -> list[Column]:
    """hotel, street and note of an entry; null where it has none, all null where it has no such form."""
    part = lambda k: F.when(text.rlike("(?i)" + ENTRY), F.nullif(F.regexp_extract(text, "(?i)" + ENTRY, k), F.lit("")))
    return [part(1).alias("hotel"), part(2).alias("street"), part(3).alias("note")]


def ordinal_number(word: str, cutoff: float = 0.8) -> str | None:
    """1st to 20th for the first ordinal word that ``word`` is like, or None."""
    from tessella.functions.similarity import jaro_winkler_of

    for n, ordinal in enumerate(ORDINALS, 1):
        if jaro_winkler_of(word, ordinal) > cutoff:
            return f"{n}{ENDINGS.get(n, 'th')}"
    return None


def with_ordinals(df: DataFrame, column: str) -> DataFrame:
    """``df`` with words of ``column`` that are like an ordinal replaced; each distinct word is looked at once."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tessella.operators.streets import ordinal_number as number

        for batch in batches:
            words = batch.column("word").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array([number(w) for w in words], pa.string())], ["word", "ordinal"])

    texts = df.select(F.col(column).alias("_t")).where(F.col("_t").isNotNull()).distinct()
    placed = texts.select("_t", F.posexplode(F.split(F.trim("_t"), r"\s+")).alias("at", "word"))
    known = placed.select("word").distinct().mapInArrow(run, "word string, ordinal string")
    spelled = placed.join(known, "word").groupBy("_t").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("ordinal", "word").alias("w")))).alias("w"))
    spelled = spelled.select("_t", F.array_join(F.transform("w", lambda x: x["w"]), " ").alias("_new"))
    return df.join(spelled, F.col(column) == F.col("_t"), "left").withColumn(column, F.col("_new")).drop("_t", "_new")


def resolve(df: DataFrame, known: DataFrame, by: list[str], order: str, page: str, street: str = "street", reach: int = 31) -> DataFrame:
    """``df`` with ``match`` and ``round``, 1 to 4, or 0 where the street stands for itself; a null street has neither.

    Round 1: equal to a known street (``known``: entry, pos). Round 2: rows in ``order`` within ``by``, a city say, whose street is like the
    row's before it (Jaro-Winkler of 0.8), whatever their pages, take its match, over ``reach`` rows at most. Round 3: on a ``page`` the
    street is among the page's own, so it is itself the page's best candidate, and takes the known street that is most like it
    (Damerau-Levenshtein), however little. Round 4: rows without a page, which have no candidates, take the known street that is most like
    theirs from a similarity of 0.6 on. All that is left, as where no street is known, keeps its street.
    """
    ship(df.sparkSession)
    first = known.groupBy("entry").agg(F.min("pos").alias("pos"))
    rows = df.join(first.select(F.col("entry").alias("_known")), F.col(street) == F.col("_known"), "left")
    w = Window.partitionBy(*by).orderBy(order)
    rows = rows.withColumn("_before", F.lag(street).over(w))
    # each pair of neighbouring names is compared once
    pairs = rows.select(F.col(street).alias("_a"), F.col("_before").alias("_b")).where("_a is not null and _b is not null").distinct()
    pairs = pairs.withColumn("_like", jaro_winkler("_a", "_b") >= 0.8)
    rows = rows.join(pairs, (F.col(street) == F.col("_a")) & (F.col("_before") == F.col("_b")), "left").withColumn("_like", F.coalesce("_like", F.lit(False)))
    rows = rows.withColumn("_segment", F.sum(F.when(F.col("_like"), 0).otherwise(1)).over(w))
    s = Window.partitionBy(*by, "_segment").orderBy(order).rowsBetween(-reach, 0)
    rows = rows.withColumn("_carried", F.last("_known", True).over(s))
    unmatched = rows.where(F.col("_carried").isNull() & F.col(street).isNotNull())
    paged = F.col(page).isNotNull()
    # streets that only rows without a page have need no match below the cutoff
    best = best_match(unmatched.where(paged).select(F.col(street).alias("_o")), "_o", first, "dl", 0.0)
    rows = rows.join(best.select("_o", F.col("match").alias("_best")), F.col(street) == F.col("_o"), "left").drop("_o")
    least = best_match(unmatched.where(~paged).select(F.col(street).alias("_o")), "_o", first, "dl", 0.6)
    rows = rows.join(least.select("_o", F.col("match").alias("_least")), F.col(street) == F.col("_o"), "left")
    third, fourth = F.when(paged, F.col("_best")), F.when(~paged, F.col("_least"))
    turn = F.when(F.col(street).isNull(), None).when(F.col("_known").isNotNull(), 1).when(F.col("_carried").isNotNull(), 2).when(third.isNotNull(), 3).when(fourth.isNotNull(), 4).otherwise(0)
    match = F.when(F.col(street).isNotNull(), F.coalesce("_known", "_carried", third, fourth, street))
    return rows.withColumn("match", match).withColumn("round", turn).drop("_known", "_before", "_a", "_b", "_like", "_segment", "_carried", "_o", "_best", "_least")


def renamed(df: DataFrame, changes: DataFrame, street: str = "match", cutoff: float = 0.7) -> DataFrame:
    """``df`` with the new name of a street that was renamed (``changes``: entry, pos, new_name); a duplicate entry gives a row for each."""
    best = best_match(df.select(F.col(street).alias("_s")), "_s", changes.groupBy("entry").agg(F.min("pos").alias("pos")), "dl", cutoff)
    named = best.join(changes.select(F.col("entry").alias("match"), "new_name"), "match").select("_s", F.col("match").alias("old_name"), "new_name")
    return df.join(named, F.col(street) == F.col("_s"), "left").drop("_s")
