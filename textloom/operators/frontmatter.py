"""Frontmatter: typed parse of the block between --- lines, and its writing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = r"(?s)^---\r?\n(.*?)\r?\n---\r?\n?(.*)$"


def split_block(raw: Column) -> tuple[Column, Column]:
    """Frontmatter text (null without a block) and content."""
    has = raw.rlike(BLOCK)
    return F.when(has, F.regexp_extract(raw, BLOCK, 1)), F.when(has, F.regexp_extract(raw, BLOCK, 2)).otherwise(raw)


def unquoted(c: Column) -> Column:
    return F.regexp_replace(c, r"""^["']|["']$""", "")


def entries(block: Column) -> Column:
    """map key -> struct(kind, scalar, items) of a frontmatter block.

    Lists: "[a, b]" split at every comma, or indented "- a" lines; a key without a
    value is an empty list. Scalars: number, boolean, null ("null", "~") or string,
    with one pair of outer quotes dropped. Lines of other forms are skipped; the last
    value of a key wins.
    """
    # block lists join their key's line, so that each entry is one line
    lines = F.split(F.regexp_replace(block, r"\r?\n\s+-\s+", "\u0001"), r"\r?\n")
    keyed = F.filter(lines, lambda x: x.rlike(r"^\w[\w.-]*:"))
    # items under a value that isn't empty are stray lines
    value = lambda x: F.trim(F.regexp_extract(x, r"(?s)^\w[\w.-]*:[ \t]?(.*)$", 1))

    def entry(x: Column) -> Column:
        v = value(x)
        head = F.trim(F.split(v, "\u0001")[0])
        block_items = F.transform(F.filter(F.split(v, "\u0001"), lambda y, i: i > 0), lambda y: unquoted(F.trim(y)))
        inline = F.filter(F.transform(F.split(F.substr(head, F.lit(2), F.length(head) - 2), ","), lambda y: unquoted(F.trim(y))), lambda y: F.length(y) > 0)
        kind = F.when(F.length(head) == 0, "list").when(head.startswith("[") & head.endswith("]"), "list").when(head.rlike(r"^-?\d+(\.\d+)?$"), "number").when(head.isin("true", "false"), "boolean").when(head.isin("null", "~"), "null").otherwise("string")
        quoted = head.rlike(r"""(?s)^(".*"|'.*')$""") & (F.length(head) > 1)
        scalar = F.when(kind.isin("list", "null"), F.lit(None)).when((kind == "string") & quoted, F.substr(head, F.lit(2), F.length(head) - 2)).otherwise(head)
        items = F.when(F.length(head) == 0, block_items).when(kind == "list", inline)
        return F.struct(F.regexp_extract(x, r"^(\w[\w.-]*):", 1).alias("key"), F.struct(kind.alias("kind"), scalar.alias("scalar"), items.alias("items")).alias("value"))

    pairs = F.transform(keyed, entry)
    # the last value of a key wins
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs) - i - 1, F.lit(0))), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


def parsed(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds ``data`` (map of entries; empty without a block) and ``content``."""
    block, content = split_block(F.col(raw))
    return df.withColumn("data", entries(F.coalesce(block, F.lit("")))).withColumn("content", content)


def without_empty(m: Column) -> Column:
    """A string map without null and empty values."""
    return F.map_filter(m, lambda k, v: v.isNotNull() & (F.length(v) > 0))
