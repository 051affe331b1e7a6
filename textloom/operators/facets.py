"""Faceted search: value counts and predicates over scalar and array facets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _is_array(df: DataFrame, facet: str) -> bool:
    return dict(df.dtypes)[facet].startswith("array")


def counts(df: DataFrame, facets: list[str]) -> DataFrame:
    """(facet, value, n) over all rows; null and empty scalars are left out. One pass over the rows."""

    def pairs(facet: str) -> Column:
        pair = lambda v: F.struct(F.lit(facet).alias("facet"), v.cast("string").alias("value"))
        return F.transform(F.array_distinct(facet), pair) if _is_array(df, facet) else F.array(pair(F.col(facet)))

    rows = df.select(F.explode(F.concat(*map(pairs, facets))).alias("x")).select("x.*").where("value is not null and value <> ''")
    return rows.groupBy("facet", "value").agg(F.count("*").alias("n"))


def ranked(n: DataFrame) -> DataFrame:
    """Values by count, then by name."""
    return n.orderBy("facet", F.col("n").desc(), F.collate("value", "UNICODE"))


def parse_token(token: str) -> tuple[str, str]:
    """facet::value, cut at the first "::"."""
    facet, _, value = token.partition("::")
    return facet, value


def has(df: DataFrame, facet: str, value: str) -> Column:
    return F.array_contains(facet, value) if _is_array(df, facet) else F.col(facet).cast("string") == value


def matching(df: DataFrame, tokens: list[str], mode: str = "any", query: str = "", columns: list[str] = ()) -> DataFrame:
    """Rows that match the selected tokens and the text query.

    mode "any": values of one facet are alternatives, facets are all required.
    mode "anytag": any token will do. Nothing selected and no query: no rows.
    """
    if not tokens and not query.strip():
        return df.limit(0)
    pairs = [parse_token(t) for t in tokens]
    if pairs:
        if mode == "anytag":
            df = df.where(reduce(Column.__or__, [has(df, f, v) for f, v in pairs]))
        else:
            for facet in dict.fromkeys(f for f, _ in pairs):
                df = df.where(reduce(Column.__or__, [has(df, f, v) for f, v in pairs if f == facet]))
    return df.where(tokens_match(query, columns)) if query.strip() else df


def phrase_matches(query: str, columns: list[str]) -> Column:
    """The whole phrase is in some column."""
    q = F.lit(query.strip().lower())
    return reduce(Column.__or__, [F.coalesce(F.lower(F.col(c).cast("string")).contains(q), F.lit(False)) for c in columns])


def tokens_match(query: str, columns: list[str]) -> Column:
    """Every word of the query is in some column."""
    return reduce(Column.__and__, [phrase_matches(w, columns) for w in query.split()] or [F.lit(True)])


def content_matches(df: DataFrame, words: DataFrame, key: str, query: str, phrase: bool = True) -> DataFrame:
    """Rows whose keyword bag holds the query; rows without a bag don't match."""
    bag = words.select(key, F.col("words").alias("__words"))
    rule = phrase_matches(query, ["__words"]) if phrase else tokens_match(query, ["__words"])
    return df.join(bag, key, "left").where(rule).drop("__words")


def toggled(selected: set[str], token: str) -> set[str]:
    return selected ^ {token}
