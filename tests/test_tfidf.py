"""Term statistics in parts that follow the texts' size."""

from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import tfidf
from textloom.sources import readers


def test_parts_follow_the_size_of_texts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(readers, "PART_BYTES", 500)
    for n in (100, 400):
        rows = spark.range(n).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 512).alias("text"))
        rows.coalesce(1).write.parquet(str(tmp_path / f"{n}" / "documents.parquet"))
    small, large = (tfidf.term_frequencies(readers.table(spark, str(tmp_path / n), "documents"), "doc_id", T.words(F.col("text"))).rdd.getNumPartitions() for n in ("100", "400"))
    assert 4 < 2 * small < large


def test_unknown_sizes_take_the_set_partitions(spark):
    assert readers.parts(spark.createDataFrame([(1, "a")], "k int, t string")) == 4


def test_index_leaves_out_terms_of_the_snippet(spark):
    docs = spark.createDataFrame([(1, "alpha beta " + "x" * 20 + " gamma gamma"), (2, "delta"), (3, None)], "k long, t string")
    got = {r["k"]: r["content"] for r in tfidf.compressed_index(docs, "k", "t", chars=10).collect()}
    assert got == {1: "alpha beta " + "gamma " + "x" * 20, 2: "delta", 3: ""}
