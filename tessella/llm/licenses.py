"""License scans with a positional index of rare words, in DataFrame functions only.

Every template is a short text with a label and a mandatory key phrase. The index holds, for each
template, the places of the words that are rarest in the scanned corpus. Every index word
that a file holds is looked up; each hit gives a template and the place in the file where it would begin. Where
enough rare words agree on that place and the key phrase stands there word for word, the label holds; the score is the
share of the template's words that stand in their places.

Base phrases are counted apart: wherever their words stand consecutively.

Defined results: null texts count as empty; files without words have no labels, null places and score
0; a row's null id stays null; rows that are equal in id and text are scanned alike; other columns play
no part.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.native import opaque
from tessella.session import settle

# Phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Well-known license notices, as (label, key phrase, text).
TEMPLATES = [
    ("apache", "apache license version 2 0", "licensed under the apache license version 2 0"),
    ("gpl", "gnu general public license", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "gnu general public license", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "gnu lesser general public license", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl", "gnu affero general public license", "under the terms of the gnu affero general public license as published by the free software foundation"),
    ("mit", "permission is hereby granted free of charge", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "mit license", "released under the mit license"),
    ("bsd", "redistribution and use in source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "mozilla public license", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "creative commons attribution", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "cc by nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "cc by sa", "licensed under cc by sa 4 0"),
    ("proprietary", "all rights reserved", "copyright all rights reserved"),
]

#: Index words of a template, rare words that must agree (fewer if a template has fewer).
INDEXED, AGREEING = 4, 2
_OTHER = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def spaced(text: Column) -> Column:
    """Words after A-Z are lower-cased, each with a space before and after; other letters' case is of no account here."""
    # lower() also makes ASCII letters of two signs, which must stay themselves
    odd = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    low = F.when(text.rlike("[\u0130\u212a]"), odd).otherwise(F.lower(text))
    return F.concat(F.lit(" "), F.btrim(F.regexp_replace(low, _OTHER, " ")), F.lit(" "))


def words_of(line: Column) -> Column:
    """The words of a ``spaced`` text."""
    bare = F.btrim(line)
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, " "))


def _scanned(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Each file's number of words, the words it shares with templates and phrases, and its ``line`` where it may match.

    A file may match if it holds every word of a key phrase or of a base phrase; no other file can have a label.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    known = sorted({w for _, _, t in TEMPLATES for w in t.split()} | {w for phrase in BASE for w in phrase.split()})
    phrases = sorted({key for _, key, _ in TEMPLATES} | set(BASE))
    read = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.xxhash64(text).alias("k1"),
        F.xxhash64(F.lit(1), text).alias("k2"),
        opaque(spaced(text)).alias("line"),
    ).withColumn("words", opaque(words_of(F.col("line"))))
    read = read.select(
        "doc_id", "k1", "k2", "line",
        F.size("words").cast("bigint").alias("n_words"),
        opaque(F.array_intersect("words", _literal(known))).alias("held"),
    )
    may = [F.size(F.array_except(_literal(phrase.split()), F.col("held"))) == 0 for phrase in phrases]
    return read.withColumn("line", F.when(reduce(or_, may), F.col("line")))


def _literal(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def frequencies(scanned: DataFrame) -> tuple[int, dict[str, int]]:
    """The number of files, and of those that hold each known word. As many rows as templates and phrases have words."""
    found = scanned.select(F.explode(F.concat("held", F.array(F.lit("")))).alias("w"))
    counts = {r["w"]: r["count"] for r in found.groupBy("w").count().collect()}
    return counts.pop("", 0), counts


def index_of(files: int, counts: dict[str, int]) -> list[tuple]:
    """Postings (word, weight, template, place) of each template's rarest words."""
    weight = lambda w: (files + 1) / (counts.get(w, 0) + 1)
    postings = []
    for number, (_, _, text) in enumerate(TEMPLATES):
        words = text.split()
        rarest = sorted(set(words), key=lambda w: (-weight(w), w))[:INDEXED]
        postings += [(w, float(weight(w)), number, place) for place, w in enumerate(words) if w in rarest]
    return postings


def base_places(line: Column, words: Column) -> Column:
    """Each base phrase's label and places; only files that hold a phrase are looked through."""
    empty = F.array().cast("array<struct<at:int,label:string>>")

    def places(phrase: str, label: str) -> Column:
        def starts(i: Column) -> Column:
            hit = F.lit(True)
            for k, part in enumerate(phrase.split()):
                hit = hit & F.coalesce(F.get(words, i + k) == part, F.lit(False))
            return hit

        found = F.filter(F.sequence(F.lit(0), F.size(words) - 1), starts)
        return F.transform(found, lambda i: F.struct(i.alias("at"), F.lit(label).alias("label")))

    found = [
        F.when(F.contains(line, F.lit(f" {phrase} ")), places(phrase, label)).otherwise(empty)
        for phrase, label in BASE.items()
    ]
    return F.concat(*found)


def _matches(scanned: DataFrame, postings: list[tuple]) -> DataFrame:
    """One row per file with its verified labels and best score; files without any are absent."""
    spark = scanned.sparkSession
    indexed = sorted({t for t, _, _, _ in postings})
    needed = {n: min(AGREEING, len({t for t, _, m, _ in postings if m == n})) for n in range(len(TEMPLATES))}
    rows = []
    for word, _, number, place in postings:
        label, key, text = TEMPLATES[number]
        words, key_words = text.split(), key.split()
        at = next((i for i in range(len(words)) if words[i : i + len(key_words)] == key_words), 0)
        rows.append((word, number, place, label, words, key_words, at, needed[number]))
    # one row for each of the templates' index words: bounded by TEMPLATES and INDEXED
    index = F.broadcast(spark.createDataFrame(rows, "word string, template int, place int, label string, t_words array<string>, key array<string>, key_at int, needed int"))
    files = scanned.withColumn("looked", opaque(F.array_intersect(_literal(indexed), "words"))).where(F.size("looked") > 0)
    # a hit takes along the words that any template may have around it, not the file
    reach = max(len(t.split()) for _, _, t in TEMPLATES)
    near = F.filter(
        F.transform("words", lambda w, i: F.struct(w.alias("word"), i.alias("i"), F.greatest(F.lit(0), i - reach).alias("low"))),
        lambda x: F.array_contains(F.col("looked"), x["word"]),
    )
    around = F.transform(near, lambda x: F.struct(x["word"].alias("word"), x["i"].alias("i"), x["low"].alias("low"), F.slice("words", x["low"] + 1, 2 * reach).alias("around")))
    hits = files.select("doc_id", "k1", "k2", F.explode(around).alias("hit")).select("doc_id", "k1", "k2", "hit.*")
    begun = hits.join(index, "word").withColumn("begin", F.col("i") - F.col("place"))
    at = F.col("begin") - F.col("low")  # where the template begins among the words around
    key_from = at + F.col("key_at")
    there = (key_from >= 0) & (F.when(key_from >= 0, F.slice("around", key_from + 1, F.size("key"))) == F.col("key"))
    share = F.aggregate(
        F.transform("t_words", lambda w, k: F.when(F.coalesce(F.when(at + k >= 0, F.get("around", at + k)) == w, F.lit(False)), 1).otherwise(0)), F.lit(0), lambda a, x: a + x
    ) / F.size("t_words")
    agreed = (
        begun.where(there)
        .select("doc_id", "k1", "k2", "template", "begin", "label", "needed", "word", share.alias("share"))
        .groupBy("doc_id", "k1", "k2", "template", "begin", "label", "needed")
        .agg(F.count_distinct("word").alias("words"), F.max("share").alias("share"))
        .where("words >= needed")
    )
    return agreed.groupBy("doc_id", "k1", "k2").agg(
        F.collect_set("label").alias("more_labels"), F.max("share").alias("best")
    )


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Words, base phrases, labels and score of every file."""
    scanned = settle(_scanned(docs, id_col, text_col), "scanned")
    postings = index_of(*frequencies(scanned))
    words = F.when(F.col("line").isNotNull(), words_of(F.col("line"))).otherwise(F.array().cast("array<string>"))
    placed = scanned.withColumn("words", opaque(words)).withColumn("places", opaque(base_places(F.col("line"), F.col("words"))))
    own = placed.select(
        "doc_id", "k1", "k2", "n_words",
        F.size("places").cast("bigint").alias("n_base"),
        F.array_min(F.transform("places", lambda p: p["at"])).cast("bigint").alias("first_word"),
        F.array_max(F.transform("places", lambda p: p["at"])).cast("bigint").alias("last_word"),
        F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"]))).alias("base"),
    )
    likely = scanned.where("line is not null").select("doc_id", "k1", "k2", opaque(words_of(F.col("line"))).alias("words"))
    more = _matches(likely, postings).select(
        F.col("doc_id").alias("m_id"), F.col("k1").alias("m1"), F.col("k2").alias("m2"), "more_labels", "best"
    )
    joined = own.join(more, F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("k1") == F.col("m1")) & (F.col("k2") == F.col("m2")), "left")
    labels = F.array_sort(F.array_union("base", F.coalesce("more_labels", F.array().cast("array<string>"))))
    return joined.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.round(F.coalesce("best", F.lit(0.0)), 6).alias("score"),
    )
