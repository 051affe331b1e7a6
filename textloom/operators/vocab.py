"""Vocabulary: surface matching, links, counts by node, label terms."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from textloom.functions import text as T

#: Most surfaces matched by one alternation; larger vocabularies go by word n-grams.
PATTERN_LIMIT = 5000


def mentions(texts: DataFrame, key: str, text: str, surfaces: DataFrame) -> DataFrame:
    """(key, id, first_pos): vocabulary nodes that a text names, in first-match order.

    surfaces: surface, id, cap. A surface with cap counts only if written with an
    upper-case first letter. Matches are leftmost, then longest, between word
    boundaries, and don't overlap; first_pos is the match's number in the text. Up to
    PATTERN_LIMIT surfaces are matched by a pattern built on the driver, more by a
    join: the rule is the same.
    """
    rows = surfaces.select("surface").limit(PATTERN_LIMIT + 1).collect()
    if len(rows) > PATTERN_LIMIT:
        return mentions_by_words(texts, key, text, surfaces)
    pattern = T.surface_pattern([r[0] for r in rows])
    if pattern is None:
        return texts.select(key, F.lit(None).cast("string").alias("id"), F.lit(0).cast("long").alias("first_pos")).where("false")
    found = texts.select(key, F.posexplode(F.regexp_extract_all(text, F.lit(pattern), 1)).alias("pos", "found"))
    return _named(found, key, F.broadcast(_known(surfaces)))


def _known(surfaces: DataFrame) -> DataFrame:
    return surfaces.select(F.lower("surface").alias("s"), "id", F.coalesce("cap", F.lit(False)).alias("cap"))


def _named(found: DataFrame, key: str, known: DataFrame) -> DataFrame:
    """The nodes of the matches (key, pos, found)."""
    hits = found.join(known, F.lower("found") == F.col("s")).where(~F.col("cap") | F.col("found").rlike(r"^\p{Lu}"))
    return hits.groupBy(key, "id").agg(F.min("pos").cast("long").alias("first_pos"))


#: Runs of word characters, and every other character by itself.
TOKEN = r"([\p{L}\p{N}_-]+|[^\p{L}\p{N}_-])"


def mentions_by_words(texts: DataFrame, key: str, text: str, surfaces: DataFrame) -> DataFrame:
    """The same for large vocabularies: an equi-join of token n-grams with the surfaces.

    Texts and surfaces are cut into the same tokens, so any surface can match; n goes
    over the surfaces' lengths. A text's matches are then taken from left to right.
    """
    tokens = lambda c: F.regexp_extract_all(c, F.lit(TOKEN), 1)
    known = _known(surfaces.where(F.length("surface") > 0))
    lens = sorted(r[0] for r in surfaces.where(F.length("surface") > 0).select(F.size(tokens(F.col("surface")))).distinct().collect())
    rows = texts.withColumn("__row", F.monotonically_increasing_id()).select("__row", key, tokens(F.col(text)).alias("w"))
    rows = rows.select("*", F.explode(F.array(*map(F.lit, lens)).cast("array<int>")).alias("n")).where("size(w) >= n")
    word = lambda c: F.coalesce(c.rlike(r"^[\p{L}\p{N}_-]"), F.lit(False))
    w, n = F.col("w"), F.col("n")

    def bounded(i: Column) -> Column:
        """No word touches the n tokens from i."""
        return ~word(F.get(w, i - 2)) & ~word(F.get(w, i + n - 1))

    starts = F.filter(F.sequence(F.lit(1), F.size("w") - n + 1), bounded)
    grams = F.transform(starts, lambda i: F.struct(i.alias("at"), F.array_join(F.slice(w, i, n), "").alias("found")))
    found = rows.select("__row", key, "n", F.explode(grams).alias("g")).select("__row", key, "n", "g.*")
    found = found.join(known.select("s").distinct(), F.lower("found") == F.col("s"), "left_semi")
    schema = StructType(texts.select(key).schema.fields).add("pos", LongType()).add("found", StringType())

    def leftmost(t: pa.Table) -> pa.Table:
        t = t.sort_by([("at", "ascending"), ("n", "descending")])
        take, end = [], 0
        for i, (at, n) in enumerate(zip(t["at"].to_pylist(), t["n"].to_pylist(), strict=True)):
            if at >= end:
                take.append(i)
                end = at + n
        return pa.table([t[key].take(pa.array(take, pa.int64())), pa.array(range(len(take)), pa.int64()), t["found"].take(pa.array(take, pa.int64()))], names=[key, "pos", "found"])

    return _named(found.groupBy("__row").applyInArrow(leftmost, schema), key, known)


WIKILINK = r"\[\[([^\]|#]+)(?:\|([^\]]+))?\]\]"


def wikilinks(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, target, label) of every wikilink; label is null if none is written."""
    both = F.arrays_zip(F.regexp_extract_all(text, F.lit(WIKILINK), 1).alias("target"), F.regexp_extract_all(text, F.lit(WIKILINK), 2).alias("label"))
    rows = texts.select(key, F.posexplode(both).alias("pos", "l"))
    label = F.trim("l.label")
    return rows.select(key, F.col("pos").cast("long").alias("pos"), F.trim("l.target").alias("target"), F.when(F.length(label) > 0, label).alias("label"))


def rewritten(texts: DataFrame, key: str, text: str, targets: DataFrame) -> DataFrame:
    """Text with wikilinks as links to their target, or as plain labels where there is none.

    targets: target, href, title, priority; the least priority of a target wins.
    """
    best = targets.groupBy("target").agg(F.min_by(F.struct("href", "title"), "priority").alias("t"))
    links = wikilinks(texts, key, text).join(best, "target", "left")
    shown = F.when(F.col("t").isNotNull(), F.concat(F.lit("["), F.coalesce("label", "t.title", "target"), F.lit("](/"), F.col("t.href"), F.lit(")"))).otherwise(F.coalesce("label", "target"))
    by_text = links.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", shown.alias("s")))), lambda x: x["s"]).alias("subs"))
    rows = texts.join(by_text, key, "left")
    gaps = F.split(text, WIKILINK, -1)
    whole = F.array_join(F.flatten(F.transform(gaps, lambda g, i: F.array(g, F.coalesce(F.get("subs", i), F.lit(""))))), "")
    return rows.withColumn(text, F.when(F.col("subs").isNotNull(), whole).otherwise(F.col(text))).drop("subs")


def live_counts(nodes: DataFrame, node: str, tags: DataFrame, tag: str) -> DataFrame:
    """Every node with its number of tag rows, 0 if none."""
    n = tags.groupBy(F.col(tag).alias(node)).agg(F.count("*").alias("work_count"))
    return nodes.join(n, node, "left").withColumn("work_count", F.coalesce("work_count", F.lit(0)).cast("long"))


def label_pairs(tagged: DataFrame, key: str, labels: Column) -> DataFrame:
    """(term, key) of the labels of each key's nodes: whole phrases and words."""
    return tagged.select(key, F.explode(labels).alias("label")).where("label is not null").select(F.explode(T.label_terms(F.col("label"))).alias("term"), key).distinct()
