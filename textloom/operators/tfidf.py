"""Term statistics, TF-IDF keywords, the compressed index and the inverted index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.sources.readers import parts

#: Keys of a posting list's block.
BLOCK = 4096


def term_frequencies(docs: DataFrame, key: str, words: Column, stop: list[str] = (), shown: Column | None = None) -> DataFrame:
    """key, term, tf, first_pos: counts and first places of each text's words of three letters or more.

    Texts are dealt by key before they are cut up, into parts whose number follows the texts'
    size, so the counts go without a shuffle of their own and a task's stay small. shown: an
    array of words; then a column ``shown`` tells the terms that are in it.
    """
    head = [] if shown is None else [shown.alias("head")]
    rows = docs.repartition(parts(docs), key).select(key, *head, F.posexplode(words).alias("pos", "term")).where((F.length("term") >= T.MIN_LENGTH) & ~F.col("term").isin(*stop))
    more = [] if shown is None else [F.bool_or(F.coalesce(F.array_contains("head", F.col("term")), F.lit(False))).alias("shown")]
    return rows.groupBy(key, "term").agg(F.count("*").alias("tf"), F.min("pos").cast("long").alias("first_pos"), *more)


def document_frequencies(tf: DataFrame) -> DataFrame:
    return tf.groupBy("term").agg(F.count("*").alias("df"))


def scored(docs: DataFrame, key: str, words: Column, stop: list[str] = (), shown: Column | None = None) -> DataFrame:
    """key, term, tf, first_pos, df, score = tf * ln(N / df); terms of every text are left out.

    Rows go to their term once and are counted there.
    """
    tf = term_frequencies(docs, key, words, stop, shown).repartition(parts(docs), "term")
    total = docs.agg(F.count("*").alias("total"))  # one row
    out = tf.withColumn("df", F.count("*").over(Window.partitionBy("term"))).join(F.broadcast(total))
    return out.withColumn("score", F.col("tf") * F.log(F.col("total") / F.col("df"))).where("df < total").drop("total")


def top_terms(ranked: DataFrame, key: str, n: int, k: int) -> DataFrame:
    """The n best terms of each text, in k parts; ties go to the first in the text."""
    best = Window.partitionBy(key).orderBy(F.round("score", 9).desc(), "first_pos")
    return ranked.repartition(k, key).withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= n)


def keywords(docs: DataFrame, key: str, text: str, n: int = 40) -> DataFrame:
    return top_terms(scored(docs, key, T.words(F.col(text)), T.STOPWORDS), key, n, parts(docs))


def compressed_index(docs: DataFrame, key: str, text: str, n: int = 50, chars: int = 160) -> DataFrame:
    """A snippet and the best terms that it doesn't hold, for each text."""
    k = parts(docs)
    ranked = scored(docs, key, T.index_words(F.col(text)), T.INDEX_STOPWORDS, T.index_words(F.substring(text, 1, chars))).where("not shown")
    terms = top_terms(ranked.select(key, "term", "score", "first_pos"), key, n, k).groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("terms"))
    out = docs.select(key, F.substring(F.coalesce(text, F.lit("")), 1, chars).alias("__head")).repartition(k, key).join(terms, key, "left")
    return out.select(key, T.snippet(F.col("__head"), F.coalesce("terms", F.array().cast("array<string>")), chars).alias("content"))


def postings(pairs: DataFrame, term: str, key: str, size: int = BLOCK) -> DataFrame:
    """term, block and keys: a term's distinct integer keys, in blocks of ``size`` consecutive values.

    So no row or task holds a frequent term's whole list.
    """
    block = F.expr(f"{key} div {size}").alias("block")
    return pairs.groupBy(term, block).agg(F.sort_array(F.collect_set(key)).alias("keys"))


def lookup(pairs: DataFrame, term: str) -> DataFrame:
    """Keys of a term in a (term, key) table sorted or bucketed by term."""
    return pairs.where(F.col("term") == F.lower(F.lit(term))).select("key").distinct()
