"""Page selection: matchers, first-match dispatch, named conditions, generated pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ext(extension: str, slug: str = "slug") -> Column:
    """Slugs with the extension, or without any dot for ".md"."""
    return F.col(slug).endswith(extension) | ~F.col(slug).contains(".")


def slug_prefix(prefix: str, slug: str = "slug") -> Column:
    return F.col(slug).startswith(prefix)


def frontmatter(key: str, rule, data: str = "data") -> Column:
    return F.coalesce(rule(F.element_at(data, key)), F.lit(False))


def every(*m: Column) -> Column:
    return reduce(Column.__and__, m, F.lit(True))


def some(*m: Column) -> Column:
    return reduce(Column.__or__, m, F.lit(False))


def negate(m: Column) -> Column:
    return ~m


def everything() -> Column:
    return F.lit(True)


def nothing() -> Column:
    return F.lit(False)


def dispatched(df: DataFrame, kinds: list[tuple[str, int, Column]], name: str = "page_type") -> DataFrame:
    """Each row's first matching kind by priority, highest first; unmatched rows go."""
    rule = None
    for kind, _, match in sorted(kinds, key=lambda k: -k[1]):
        rule = F.when(match, kind) if rule is None else rule.when(match, kind)
    return df.withColumn(name, rule).where(F.col(name).isNotNull())


#: Named conditions; ``register`` adds to them or replaces one.
CONDITIONS = {
    "not-index": lambda: F.col("slug") != "index",
    "has-tags": lambda: F.size("tags") > 0,
    "has-backlinks": lambda: F.size("backlinks") > 0,
    "has-toc": lambda: F.size("toc") > 0,
}


def register(name: str, rule) -> None:
    CONDITIONS[name] = rule


def condition(name: str) -> Column:
    return F.coalesce(CONDITIONS[name](), F.lit(False))


def published(df: DataFrame, rules: list[Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that every rule keeps, and the rows dropped."""
    ok = F.coalesce(every(*rules), F.lit(False))
    return df.where(ok), df.where(~ok)


#: Folders that the explorer leaves out.
HIDDEN = ("tags", "testi", "works", "404")


def in_explorer(slug: str = "slug", hidden: tuple[str, ...] = HIDDEN) -> Column:
    """Slugs whose first segment isn't a hidden folder."""
    return ~F.split(slug, "/")[0].isin(*hidden)


def known_folders(df: DataFrame, folder: str, kinds: DataFrame) -> DataFrame:
    """Rows of folders with a type, which is added; kinds: folder, type."""
    return df.join(F.broadcast(kinds), folder)  # a row for each folder of the site's layout


def emitted(df: DataFrame, emitter: str) -> DataFrame:
    """(emitter, files) and a last row of all files, whose emitter is null."""
    return df.rollup(emitter).agg(F.count("*").alias("files"))


def not_draft(draft: str = "draft") -> Column:
    return ~F.coalesce(F.col(draft).cast("string").isin("true"), F.lit(False))


def tag_pages(df: DataFrame, tags: str, prefix: str = "tags") -> DataFrame:
    """A generated page for each tag and each of its parent tags."""
    parents = lambda t: F.transform(F.sequence(F.lit(1), F.size(F.split(t, "/"))), lambda i: F.array_join(F.slice(F.split(t, "/"), F.lit(1), i), "/"))
    each = df.select(F.explode(F.array_distinct(F.flatten(F.transform(tags, parents)))).alias("title")).distinct()
    return each.select(F.concat(F.lit(f"{prefix}/"), "title").alias("slug"), "title")


def folder_pages(folders: DataFrame, folder: str) -> DataFrame:
    return folders.select(F.col(folder).alias("slug"), F.regexp_replace(folder, "/?index$", "").alias("title")).distinct()


def not_found_page(df: DataFrame) -> DataFrame:
    return df.sparkSession.range(1).select(F.lit("404").alias("slug"), F.lit("Not found").alias("title"))
