"""Reading order: neighbours, marker segments, table-of-contents runs, language choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def neighbours(df: DataFrame, work: str, order: str) -> DataFrame:
    """Adds prev, next, position and total in reading order."""
    w = Window.partitionBy(work).orderBy(order)
    return df.withColumn("prev", F.lag(order).over(w)).withColumn("next", F.lead(order).over(w)).withColumn("position", F.row_number().over(w).cast("long")).withColumn("total", F.count("*").over(Window.partitionBy(work)))


def segments(df: DataFrame, doc: str, order: str, marker: Column, lang: Column | None = None) -> DataFrame:
    """Adds segment (from 1) and, given language markers, the language in force.

    Rows before the first marker are dropped; a new segment starts without a language.
    """
    w = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumn("segment", F.sum(marker.cast("long")).over(w)).where("segment > 0")
    if lang is not None:
        inside = Window.partitionBy(doc, "segment").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        df = df.withColumn("segment_lang", F.last(lang, ignorenulls=True).over(inside))
    return df


def runs(df: DataFrame, work: str, order: str, chapter: Column) -> DataFrame:
    """Adds run: consecutive rows of one chapter; rows without a chapter break runs and have none."""
    w = Window.partitionBy(work).orderBy(order)
    df = df.withColumn("__c", F.when(F.length(chapter) > 0, chapter))
    starts = F.col("__c").isNotNull() & ~F.col("__c").eqNullSafe(F.lag("__c").over(w))
    df = df.withColumn("__s", starts.cast("long"))
    return df.withColumn("run", F.when(F.col("__c").isNotNull(), F.sum("__s").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))).drop("__c", "__s")


def header_slice(df: DataFrame, doc: str, pos: str, depth: str, levels: int = 6) -> DataFrame:
    """Adds end: the position of the next header of the same or a lesser depth; null to the text's end.

    One pass over each document's headers from its end, with a running minimum for each of
    the ``levels`` depths; deeper headers count as of the last level.
    """
    w = Window.partitionBy(doc).orderBy(F.col(pos).desc()).rowsBetween(Window.unboundedPreceding, -1)
    own = F.least(F.col(depth), F.lit(levels))
    nearest = F.array(*[F.min(F.when(own <= k, F.col(pos))).over(w) for k in range(1, levels + 1)])
    return df.withColumn("end", F.get(nearest, (own - 1).cast("int")))


def body_in(translations: Column, lang: Column, source: Column) -> Column:
    """The body in a language, else the source's."""
    return F.coalesce(F.get(F.map_values(F.map_filter(translations, lambda k, v: k == lang)), F.lit(0)), F.get(F.map_values(F.map_filter(translations, lambda k, v: k == source)), F.lit(0)))


def languages(df: DataFrame, work: str, lang: str) -> DataFrame:
    """Languages of each work's atoms."""
    return df.groupBy(work).agg(F.sort_array(F.collect_set(lang)).alias("languages"))


def fragment(ids: DataFrame, work: str, id_col: str, order: str, wanted: Column) -> DataFrame:
    """The atom that a fragment names: the exact id, else the first with prefix "id--", else the first."""
    rank = F.when(F.col(id_col) == wanted, 0).when(F.col(id_col).startswith(F.concat(wanted, F.lit("--"))), 1).otherwise(2)
    return ids.groupBy(work).agg(F.min_by(id_col, F.struct(rank, F.col(order))).alias(id_col))
