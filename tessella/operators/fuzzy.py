"""Best match of strings against a dictionary by an exact candidate index.

Two strings that are alike have letters in common, counted with repetition: a Damerau-Levenshtein similarity of t takes t times the longer
one's letters, and a Jaro similarity of j takes more than (3 j - 2) times either one's. So with the letters of every string in one order, the
rarest first, two strings that are as similar as t share one of their first letters already, of a string of n letters that must have c in
common one of the first n - c + 1. Those first letters are the index; for high thresholds they are posted together with both strings'
lengths, on which c depends. Jaro-Winkler adds to Jaro's by letters that both begin with; there
is an index for each such number of letters, in which strings meet only if they begin alike, with the bound that is then due.

Thresholds fall in steps. What finds a match at one step is done, as no other could be better, so wide postings are read only for
strings that nothing is much like. Every step joins on equal keys; candidates are scored in Arrow batches.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.similarity import damerau_levenshtein, jaro_winkler
from tessella.session import settle, ship

#: Steps that thresholds fall by, to the cutoff asked for.
STEPS = (0.85, 0.7, 0.5, 0.25)
#: Letters that both begin with and Jaro-Winkler counts, and what each adds.
BEGIN, ADDED = 4, 0.1
#: Thresholds from which keys hold the lengths too: of Damerau-Levenshtein, and of the share of letters that Jaro asks for.
NARROW, NARROW_JARO = 0.6, 0.4
_LEAST = 1e-9


def _ranked(strings: DataFrame, counts: DataFrame, name: str) -> DataFrame:
    """``name``, its length ``n`` and ``letters``: each with how often it stood before, the rarest of the dictionary first."""
    own = strings.select(name, F.posexplode(F.split(name, "")).alias("at", "letter")).where("letter <> ''")
    times = F.row_number().over(Window.partitionBy(name, "letter").orderBy("at"))
    numbered = own.select(name, F.concat_ws("\0", "letter", times.cast("string")).alias("letter"))
    known = numbered.join(counts, "letter", "left").select(name, F.struct(F.coalesce("count", F.lit(0)).alias("count"), "letter").alias("x"))
    return known.groupBy(name).agg(F.array_sort(F.collect_list("x")).alias("x")).select(name, F.length(name).alias("n"), F.transform("x", lambda x: x["letter"]).alias("letters"))


def _first(least: Column) -> Column:
    """Of the letters, those that come first, one of which is shared if ``least`` of all are (one at least)."""
    shared = F.greatest(F.lit(1), F.ceil(least - _LEAST).cast("int"))
    return F.slice("letters", 1, F.greatest(F.lit(0), F.col("n") - shared + 1))


def _by_length(share: float, least, asked: bool) -> Column:
    """Keys that hold both strings' lengths, for every length that the other may have; ``least``: letters in common, by both lengths."""
    n = F.col("n")
    lengths = F.sequence(F.ceil(n * share - _LEAST).cast("int"), F.floor(n / share + _LEAST).cast("int"))
    pair = lambda m: F.concat_ws(".", n.cast("string"), m.cast("string")) if asked else F.concat_ws(".", m.cast("string"), n.cast("string"))
    found = F.transform(lengths, lambda m: F.transform(_first(least(n, m)), lambda k: F.concat_ws("\1", pair(m), k)))
    return F.when(n > 0, F.flatten(found)).otherwise(F.array().cast("array<string>"))


def keys(measure: str, threshold: float, asked: bool) -> Column:
    """The keys of a ranked string, one that is ``asked`` for or an entry: any two that are as similar as ``threshold`` have one in common."""
    if measure == "dl":
        if threshold >= NARROW:
            return _by_length(threshold, lambda n, m: F.greatest(n, m) * threshold, asked)
        return _first(F.col("n") * threshold)
    name, out = F.col("name"), []
    for begin in range(BEGIN + 1):
        jaro = (threshold - begin * ADDED) / (1 - begin * ADDED)
        share = 3 * jaro - 2
        tag = lambda k: F.concat_ws("\1", F.lit(str(begin)), F.substring(name, 1, begin), k)  # noqa: E731, B023
        if share >= NARROW_JARO:
            some = F.transform(_by_length(share, lambda n, m: n * m / (n + m) * (3 * jaro - 1), asked), tag)  # noqa: B023
        elif begin and share <= 0.25:
            some = F.array(tag(F.lit("")))  # strings that begin alike have a letter in common without more
        else:
            some = F.transform(_first(F.col("n") * share), tag)
        out.append(F.when(F.col("n") >= begin, some).otherwise(F.array().cast("array<string>")))
    return F.concat(*out)


def best_match(left: DataFrame, column: str, dictionary: DataFrame, measure: str, cutoff: float) -> DataFrame:
    """(column, match, score): the best entry of at least ``cutoff``, the first by ``pos`` of equals.

    ``dictionary`` (entry, pos) is a street list or the like, ``measure`` is "jw" (Jaro-Winkler) or "dl" (Damerau-Levenshtein over the longer
    length). With a cutoff of 0 or less every string has a match, if only the first entry with a score of 0.
    """
    spark = left.sparkSession
    ship(spark)
    scorer = {"jw": lambda a, b: F.round(jaro_winkler(a, b), 12), "dl": damerau_levenshtein}[measure]
    words = settle(left.select(F.col(column).alias("name")).where(F.col(column).isNotNull()).distinct(), "words")
    entries = settle(dictionary.where(F.col("entry").isNotNull()).groupBy("entry").agg(F.min("pos").alias("pos")), "entries")
    # equal strings need no index
    found = [words.join(entries, F.col("name") == F.col("entry")).select("name", "entry", F.lit(1.0).alias("score"))]
    open_ = settle(words.join(entries, F.col("name") == F.col("entry"), "left_anti"), "words-open")
    letters = entries.select("entry", F.explode(F.split("entry", "")).alias("letter")).where("letter <> ''").groupBy("entry", "letter").agg(F.count("*").alias("n"))
    counts = letters.select(F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("k"), "letter").select(F.concat_ws("\0", "letter", F.col("k").cast("string")).alias("letter"))
    counts = settle(counts.groupBy("letter").count(), "letters")
    indexed = settle(_ranked(entries, counts, "entry").join(entries, "entry").withColumnRenamed("entry", "name"), "entries-ranked")
    asked = settle(_ranked(open_, counts, "name"), "words-ranked")
    least = max(cutoff, 0.0)
    for threshold in [s for s in STEPS if s > least] + [least]:
        if not asked.limit(1).count():
            break
        posted = indexed.select(F.explode(keys(measure, threshold, False)).alias("key"), F.col("name").alias("entry"), "pos", F.col("n").alias("m"))
        probes = asked.select(F.explode(keys(measure, threshold, True)).alias("key"), "name", "n")
        met = probes.join(posted, "key").where(_lengths(measure, threshold)).select("name", "entry", "pos").distinct()
        scored = settle(met.withColumn("score", scorer(F.col("name"), F.col("entry"))), "scored")
        # at 0 strings without a letter in common are as good as these
        best = scored.where(F.col("score") >= threshold if threshold > 0 else F.col("score") > 0).groupBy("name").agg(F.min(F.struct((-F.col("score")).alias("s"), "pos", "entry")).alias("x"))
        best = settle(best.select("name", "x.entry", (-F.col("x.s")).alias("score")), "matched")
        found.append(best)
        asked = settle(asked.join(best, "name", "left_anti"), "words-ranked")
    out = reduce(DataFrame.unionByName, found)
    if cutoff <= 0 and (first := entries.orderBy("pos", "entry").limit(1).collect()):
        rest = words.join(out, "name", "left_anti").select("name", F.lit(first[0]["entry"]).alias("entry"), F.lit(0.0).alias("score"))
        out = out.unionByName(rest)
    return out.select(F.col("name").alias(column), F.col("entry").alias("match"), "score")


def _lengths(measure: str, threshold: float) -> Column:
    """Whether strings of n and m letters can be as similar as ``threshold``."""
    share = F.least("n", "m") / F.greatest("n", "m")
    if measure == "dl":
        return share >= threshold - _LEAST
    jaro = (threshold - BEGIN * ADDED) / (1 - BEGIN * ADDED)
    return share >= 3 * jaro - 2 - _LEAST
