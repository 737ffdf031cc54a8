"""A corpus from raw documents to packed sequences: five stages, each written as a table before the next.

What all stages but the last do with odd rows: a null text counts as empty; a document without a word leaves with the quality rules,
as one that loses its last word leaves with the stage that takes it; null ids, sources and other values stay as they are, and so do
columns of any other name, which play no part; very long texts are whole texts; an empty table gives an empty one. Rows equal in id and text
are one document to the near-duplicate stage and leave it once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import lines, near, packing, quality, substrings
from tessella.llm.queries import tokenizer_path
from tessella.llm.tables import table
from tessella.session import discard, settle

#: Chunks of text whose ids a worker remembers while it packs: fewer than for packing alone, as workers here have done other stages.
REMEMBERED = 250_000


def _others(docs: DataFrame) -> Column:
    """All columns but the text, as one, whatever their names are."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("text", "n_chars")])


def _with_text(docs: DataFrame, cleaned: DataFrame, text: str) -> DataFrame:
    """The rows of ``cleaned`` (``carried`` and the new ``text``) as rows like those of ``docs``; documents left without a word go."""
    new = {"text": F.col(text), "n_chars": F.length(text).cast("bigint")}
    named = [new[c].alias(c) if c in new else F.col(f"carried.`{c}`").alias(c) for c in docs.columns]
    return cleaned.where(F.col(text).rlike(r"\S")).select(*named)


def _free(docs: DataFrame, name: str) -> str:
    """``name`` with as many underscores behind it as it takes to be no column of ``docs``."""
    while name in docs.columns:
        name += "_"
    return name


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; equal rows are kept or go together."""
    weights = quality.fit(docs, table(spark, sf_dir, "labels"))
    row = _free(docs, "_row")
    whole = docs.withColumn(row, F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    return quality.assess(whole, weights, carry=[row]).where("kept").select(f"{row}.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated lines; of equal lines, and of ties in doc_id, the first place stays."""
    return _with_text(docs, lines.dedup_lines(docs, carry=_others(docs)), "text")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, that with the least id; of equal rows one."""
    own, id_, node = (_free(docs, n) for n in ("_own", "_id", "_node"))
    kept = near.classes(docs, threshold=0.8, with_node=True).where("kept")
    keys = kept.select(F.col("doc_id").alias(id_), F.col("node").alias(node)).distinct()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    marked = docs.withColumn(own, F.unhex(F.md5(text)))
    one = marked.join(keys, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(own) == F.col(node)), "left_semi")
    return one.dropDuplicates(["doc_id", own]).select(*[F.col(f"`{c}`") for c in docs.columns])


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repetitions of 400 bytes, or of 50 words and 200 bytes, that occur elsewhere; a letter that a cut divides goes too."""
    return _with_text(docs, substrings.remove_repeats(docs, length=400, with_text=True, carry=_others(docs), words=50), "kept")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces in sequences of 2048 tokens; equal rows are packed one by one, a null text is its closing id alone."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), capacity=2048, end_id=0, kept=REMEMBERED)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("minhash near-dedup", near_dedup),
    ("suffix-array dedup", suffix_dedup),
    ("best-fit packing", packed),
]

#: The scores, classes and packing aren't expressible in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage's result is written to the shared folder and read again."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        discard(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
