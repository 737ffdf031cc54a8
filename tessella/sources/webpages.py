"""Pairs of new and old names from lists and tables of web pages, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def text_of(html: Column) -> Column:
    """Text without tags, the commonest entities replaced, runs of blanks as one, trimmed."""
    out = F.regexp_replace(html, "(?s)<[^>]*>", "")
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(sign))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def parts(html: Column, tag: str) -> Column:
    """What stands inside each ``tag`` of a text, in order; tags of the same kind inside one another aren't told apart."""
    return F.regexp_extract_all(html, F.lit(f"(?is)<{tag}(?:\\s[^>]*)?>(.*?)</{tag}>"), F.lit(1))


def list_pairs(pages: DataFrame, html: str, keep: list[str]) -> DataFrame:
    """keep, new_name and old_name: each entry of a list that holds a list gives its own first line and the inner entries, of its first inner list.

    Entries without an inner list, empty inner entries and null pages give no rows. Lists are two deep.
    """
    label = "((?:(?!</?(?:ul|li)\\b).)*)"
    pattern = F.lit(f"(?is)<li(?:\\s[^>]*)?>{label}<ul(?:\\s[^>]*)?>(.*?)</ul>")
    outer = F.arrays_zip(F.regexp_extract_all(html, pattern, F.lit(1)).alias("label"), F.regexp_extract_all(html, pattern, F.lit(2)).alias("inner"))
    first = F.element_at(F.split(F.trim(F.regexp_replace("_o.label", "(?i)<br\\s*/?>", "\n")), "\n"), 1)
    found = pages.select(*keep, F.explode(outer).alias("_o")).select(*keep, text_of(first).alias("new_name"), F.explode(parts(F.col("_o.inner"), "li")).alias("_i"))
    return found.select(*keep, "new_name", text_of(F.col("_i")).alias("old_name")).where("old_name <> ''")


def table_pairs(pages: DataFrame, html: str, header: str, kind: str, keep: list[str]) -> DataFrame:
    """keep, new_name and old_name: the first two cells of each row but the first of the first table of class ``kind`` behind the element ``header``.

    Rows with under two cells or an empty second one, and pages without that header or table, give no rows.
    """
    table = F.regexp_extract(html, f'(?is)id="{header}".*?<table[^>]*class="[^"]*\\b{kind}\\b[^"]*"[^>]*>(.*?)</table>', 1)
    rows = parts(table, "tr")
    found = pages.select(*keep, F.explode(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0)))).alias("_r")).select(*keep, parts(F.col("_r"), "td").alias("_c")).where(F.size("_c") >= 2)
    return found.select(*keep, text_of(F.col("_c")[0]).alias("new_name"), text_of(F.col("_c")[1]).alias("old_name")).where("old_name <> ''")
