"""Sinks: JSON documents, sharded tables, Markdown files and derived indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def overwrite(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    df.write.mode("overwrite").format(fmt).save(path)


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def sharded(df: DataFrame, folder: str, key: str) -> DataFrame:
    """One partition per key; returns the manifest of keys."""
    df.repartition(key).write.mode("overwrite").partitionBy(key).parquet(folder)
    return df.sparkSession.read.parquet(folder).select(key).distinct().orderBy(key)


def yaml_scalar(c: Column, kind: str) -> Column:
    """A value as frontmatter text: strings quoted, null, numbers and booleans plain."""
    if kind == "string":
        quoted = F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r'^\{"v":(.*)\}$', 1)
        return F.when(c.isNull(), F.lit("null")).otherwise(quoted)
    return F.when(c.isNull(), F.lit("null")).otherwise(c.cast("string"))


def frontmatter_block(df: DataFrame, columns: list[str]) -> Column:
    """Frontmatter of the given columns: arrays as block lists, [] if empty, missing arrays left out."""
    lines = []
    for name in columns:
        kind = dict(df.dtypes)[name]
        if kind.startswith("array"):
            items = F.array_join(F.transform(F.col(name), lambda x: F.concat(F.lit("\n  - "), yaml_scalar(x, "string"))), "")
            lines.append(F.when(F.size(name) == 0, F.lit(f"{name}: []")).when(F.col(name).isNotNull(), F.concat(F.lit(f"{name}:"), items)))
        else:
            lines.append(F.concat(F.lit(f"{name}: "), yaml_scalar(F.col(name), kind)))
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n"))


def markdown(df: DataFrame, folder: str, key: str, columns: list[str], body: str) -> None:
    """A text file of frontmatter and body for each row, in one folder per key."""
    out = df.select(F.col(key), F.concat(frontmatter_block(df, columns), F.coalesce(F.col(body), F.lit(""))).alias("value"))
    out.write.mode("overwrite").partitionBy(key).option("lineSep", "\u0000").text(folder)


def sorted_lock(df: DataFrame, path: str, key: str) -> None:
    """A lock table with its rows in key order, in one file: its size is that of a configuration."""
    df.coalesce(1).sortWithinPartitions(key).write.mode("overwrite").json(path)


def small_index(df: DataFrame, links: int = 20, chars: int = 80) -> DataFrame:
    """The index cut down to a few links and characters per page."""
    return df.select("slug", "title", "tags", F.slice("links", 1, links).alias("links"), F.substring("content", 1, chars).alias("content"))


def feed(df: DataFrame, base: str, limit: int = 10) -> DataFrame:
    """Newest pages as feed items."""
    return df.orderBy(F.col("date").desc_nulls_last(), "slug").limit(limit).select("title", F.concat(F.lit(base.rstrip("/") + "/"), "slug").alias("link"), "date")


def sitemap(df: DataFrame, base: str) -> DataFrame:
    return df.select(F.concat(F.lit(base.rstrip("/") + "/"), "slug").alias("loc"), F.date_format("date", "yyyy-MM-dd").alias("lastmod"))


def sizes(df: DataFrame, before: str, after: str) -> DataFrame:
    """Bytes before and after a rewrite."""
    size = lambda c: F.sum(F.octet_length(c)).alias(f"{c}_bytes")
    return df.agg(size(before), size(after))
