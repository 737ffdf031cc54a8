"""Tables for publication: stars, cells and LaTeX of small collected results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stars(p: Column, cuts: tuple = (0.01, 0.05, 0.1)) -> Column:
    """Three, two, one or no stars for values under the cuts."""
    return F.when(p < cuts[0], "***").when(p < cuts[1], "**").when(p < cuts[2], "*").otherwise("")


def regression_cells(fit: DataFrame, cuts: tuple = (0.01, 0.05, 0.1), digits: int = 3) -> DataFrame:
    """term and its cell: coefficient with stars, standard error in brackets; a missing one is empty."""
    number = lambda v: F.format_string(f"%.{digits}f", v)
    cell = F.concat(number(F.col("coef")), stars(F.col("p"), cuts), F.lit(" ("), number(F.col("se")), F.lit(")"))
    return fit.select("term", F.coalesce(cell, F.lit("")).alias("cell"))


def merge_columns(tables: dict[str, DataFrame]) -> DataFrame:
    """Several models side by side, aligned by term; a term that a model lacks is empty."""
    out = None
    for name, cells in tables.items():
        one = cells.withColumnRenamed("cell", name)
        out = one if out is None else out.join(one, "term", "full")
    return out.na.fill("")


def specification(cities: list[str], blocks: list[list[tuple[str, str]]], labels: dict[str, str] | None = None) -> tuple[list[str], list[str]]:
    """Columns and their labels, the intercept's first: the blocks' (column, label) pairs and a dummy for each city but the first, in order."""
    named = labels or {}
    pairs = [pair for block in blocks for pair in block] + [(f"city_{x}", named.get(x, f"City_{x.title()}")) for x in list(dict.fromkeys(cities))[1:]]
    return [v for v, _ in pairs], ["Intercept", *[label for _, label in pairs]]


def longtable(df: DataFrame, caption: str, label: str, most: int = 1000) -> str:
    """A table that may break between pages, of at most ``most`` rows."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows")
    head = " & ".join(df.columns) + " \\\\\n\\midrule\n\\endhead"
    body = "\n".join(" & ".join("" if v is None else f"{v:.2f}" if isinstance(v, float) else str(v) for v in r) + r" \\" for r in rows)
    return f"\\begin{{longtable}}{{l{'c' * (len(df.columns) - 1)}}}\n\\caption{{{caption}}}\\label{{{label}}} \\\\\n\\toprule\n{head}\n{body}\n\\bottomrule\n\\end{{longtable}}\n"


def latex(df: DataFrame, caption: str, label: str, notes: str = "", most: int = 1000) -> str:
    """A threeparttable of at most ``most`` rows; more is an error, as a report is small."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows")
    cell = lambda v: "" if v is None else f"{v:.2f}" if isinstance(v, float) else str(v)
    body = "\n".join(" & ".join(map(cell, r)) + r" \\" for r in rows)
    head = " & ".join(df.columns) + r" \\"
    return (
        "\\begin{table}[htbp]\n\\centering\n\\begin{threeparttable}\n"
        f"\\caption{{{caption}}}\n\\label{{{label}}}\n\\begin{{tabular}}{{l{'c' * (len(df.columns) - 1)}}}\n\\toprule\n"
        f"{head}\n\\midrule\n{body}\n\\bottomrule\n\\end{{tabular}}\n"
        + (f"\\begin{{tablenotes}}\n{notes}\n\\end{{tablenotes}}\n" if notes else "")
        + "\\end{threeparttable}\n\\end{table}\n"
    )
