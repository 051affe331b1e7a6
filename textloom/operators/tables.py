"""Table views: sorting, paging and the pager."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as T


def sort_keys(df: DataFrame, column: str, descending: bool, tie: str, articles: bool = True) -> list[Column]:
    """Order of a table: missing numbers last both ways; strings without case and leading article; tie ascending."""
    kind = dict(df.dtypes)[column]
    key = (T.no_article(F.col(column)) if articles else F.lower(column)) if kind == "string" else F.when(~F.isnan(F.col(column).cast("double")), F.col(column))
    return [key.desc_nulls_last() if descending else key.asc_nulls_last(), T.no_article(F.col(tie)) if articles else F.lower(tie), F.col(tie)]


def page(df: DataFrame, keys: list[Column], number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1, clamped) of ``size`` rows with their rank; size 0 is all rows.

    Top-k ordering: only (number * size) rows leave each partition.
    """
    if size == 0:
        return df.orderBy(*keys)
    total = df.count()
    pages = max(1, -(-total // size))
    number = min(max(1, number), pages)
    head = df.orderBy(*keys).limit(number * size)
    ranked = head.withColumn("rank", F.row_number().over(Window.orderBy(*keys)).cast("long"))  # page rows only
    return ranked.where(F.col("rank") > (number - 1) * size)


def page_from_zero(df: DataFrame, keys: list[Column], number: int, size: int) -> DataFrame:
    """Page ``number`` counted from 0, clamped to the first and last."""
    return page(df, keys, max(0, number) + 1, size)


def first_direction(df: DataFrame, column: str) -> bool:
    """Whether a column is sorted downwards at first: numbers are."""
    return dict(df.dtypes)[column] != "string"


def range_text(total: int, number: int, size: int) -> str:
    if total == 0:
        return "0"
    if size == 0:
        return f"1-{total} / {total}"
    return f"{(number - 1) * size + 1}-{min(total, number * size)} / {total}"


def pager(current: int, pages: int, around: int = 2) -> list[int | None]:
    """Page numbers to show: the ends and the neighbours, None for a gap."""
    shown = sorted({1, pages, *range(max(1, current - around), min(pages, current + around) + 1)})
    out: list[int | None] = []
    for a, b in zip([0, *shown], shown, strict=False):
        if a and b - a > 1:
            out.append(None)
        out.append(b)
    return out


def listing(df: DataFrame, date: str, title: str, folder: str | None = None, limit: int | None = None) -> DataFrame:
    """Dated rows first, newest first, then by title; folders before all if asked for."""
    keys = [F.col(date).desc_nulls_last(), F.collate(F.lower(title), "UNICODE"), F.col(title)]
    if folder:
        keys.insert(0, F.col(folder).desc())
    out = df.orderBy(*keys)
    return out.limit(limit) if limit is not None else out


def natural_key(c: Column) -> Column:
    """Folder order: without case and accents, numbers by value."""
    padded = F.array_join(F.transform(F.split(F.regexp_replace(c, r"(\d+)", "\u0001$1\u0001"), "\u0001"), lambda x: F.when(x.rlike(r"^\d+$"), F.lpad(x, 20, "0")).otherwise(x)), "")
    return F.collate(padded, "UNICODE_CI_AI")
