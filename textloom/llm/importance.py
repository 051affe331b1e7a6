"""Operator 8: quality classifier by importance resampling.

Two hashed n-gram models (words and word pairs, ``BUCKETS`` buckets) are counted:
the raw model over all documents, the target model over documents that the labels
call good; ``PRIOR`` n-grams of the raw model's shape are added to every bucket of
both, so rare buckets have a ratio near one.  A document's log-weight is the summed log-ratio of its
n-grams, target over raw.  Gumbel noise, a pure function of seed and id, is added and the
top k are kept, which samples k documents without replacement in proportion to
their weights.

k is ``rate`` of the documents.  By default it is how many documents reach the
log-weight that best parts good labels from bad ones, a lost good one counting
``GOOD_COST`` times.  Labels are a bounded sample: the ``MAX_LABELS``
with the least hash of their id (a parameter), so they may be broadcast.  Counts,
weights and the choice of k cover all documents.  The k-th score is found by
counting scores in ever finer intervals; no scores are gathered.

Defined cases: null text has no n-grams and weight 0; without labels, or without
a good one, the target is the raw model, all weights are 0 and all rows stay unless
a rate is given; ties at the k-th score all stay; a null id gets noise of its own;
several labels of one id count as good if any is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm import common as C

BUCKETS = 1 << 15
MAX_LABELS = 100_000
SEED = 1234
PRIOR = 10.0
GOOD_COST = 10.0
#: Intervals of a round of the search for the k-th score, and its rounds.
STEPS, ROUNDS = 512, 7
WEIGHT = "__log_weight"


def _buckets(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams and their texts."""
    w = C.Words(C.LOWER[data], off)
    h, doc = w.hashes(), w.docs()
    with np.errstate(over="ignore"):
        pair = C.mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])[doc[1:] == doc[:-1]] if len(h) else h
    both = np.concatenate((h, pair)) % np.uint64(BUCKETS)
    return both.astype(np.int64), np.concatenate((doc, doc[1:][doc[1:] == doc[:-1]]))


def _sample(labels: DataFrame, max_labels: int) -> DataFrame:
    """doc_id, good: at most ``max_labels`` rows, so it may be broadcast."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality is not null")
    return F.broadcast(known.groupBy("doc_id").agg((F.max("quality") > 0).alias("good")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labels))


def log_ratios(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_labels: int = MAX_LABELS) -> tuple[np.ndarray, int]:
    """log(target / raw) of every bucket, and the number of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        n = 0
        for b in C.slices(batches, "text"):
            at, doc = _buckets(*C.text_bytes(b.column(0)))
            yes = b.column(1).fill_null(False).to_numpy(zero_copy_only=False)
            raw += np.bincount(at, minlength=BUCKETS)
            target += np.bincount(at[yes[doc]], minlength=BUCKETS)
            n += b.num_rows
        keys = np.append(np.arange(BUCKETS), -1)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.append(raw, n)), pa.array(np.append(target, 0))], names=["at", "raw", "target"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.join(_sample(labels, max_labels), "doc_id", "left").select("text", "good")
    got = rows.mapInArrow(C.trimmed(run), "at long, raw long, target long").groupBy("at").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    at = got["at"].to_numpy()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[at[at >= 0]], target[at[at >= 0]] = got["raw"].to_numpy()[at >= 0], got["target"].to_numpy()[at >= 0]
    n = dict(zip(at[at < 0].tolist(), got["raw"].to_numpy()[at < 0].tolist(), strict=True))
    if not target.sum():
        target = raw
    expected = raw * (target.sum() / max(raw.sum(), 1))
    return np.log((target + PRIOR) / (expected + PRIOR)), n.get(-1, 0)


def weights(docs: DataFrame, ratio: np.ndarray, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """doc_id, log_weight, perturbed (log-weight and Gumbel noise)."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for b in C.slices(batches, "text"):
            at, doc = _buckets(*C.text_bytes(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.bincount(doc, table[at], b.num_rows), pa.float64())], names=["doc_id", "log_weight"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(C.trimmed(run), "doc_id long, log_weight double").withColumn("perturbed", F.col("log_weight") + _noise("doc_id", seed))


def kth_largest(scores: DataFrame, col: str, k: int) -> float:
    """The k-th largest value by counting in ever finer intervals; -inf if there are no more than k."""
    n, low, high = scores.agg(F.count(col), F.min(col), F.max(col)).first()
    if n <= k:
        return float("-inf")
    if k <= 0:
        return float("inf")
    above = 0  # scores beyond the present interval
    for _ in range(ROUNDS):
        width = (high - low) / STEPS
        if width <= 0 or low + width == low:
            break
        step = F.least(F.floor((F.col(col) - F.lit(low)) / F.lit(width)), F.lit(STEPS - 1))
        rows = scores.where((F.col(col) >= low) & (F.col(col) <= high)).groupBy(step.alias("s")).agg(F.count("*").alias("c"), F.min(col).alias("lo"), F.max(col).alias("hi")).collect()  # STEPS rows
        for r in sorted(rows, key=lambda r: -r["s"]):
            if above + r["c"] >= k:
                low, high = r["lo"], r["hi"]
                inside = r["c"]
                break
            above += r["c"]
        if low == high or above + inside == k:
            break
    return low


def best_cut(weight: np.ndarray, good: np.ndarray) -> float:
    """The weight from which on to keep: least cost on the labels; -inf without both kinds."""
    good = good.astype(bool)
    if not good.any() or good.all():
        return float("-inf")
    order = np.argsort(weight, kind="stable")
    w, g = weight[order], good[order]
    # cost of dropping the first i
    cost = GOOD_COST * np.append(0, np.cumsum(g)) / g.sum() + np.append(0, np.cumsum(~g))[-1] / (~g).sum() - np.append(0, np.cumsum(~g)) / (~g).sum()
    i = int(np.argmin(cost))
    if i == 0:
        return float("-inf")
    return float((w[i - 1] + w[min(i, len(w) - 1)]) / 2)


def threshold(scored: DataFrame, labels: DataFrame, n: int, rate: float | None, max_labels: int) -> tuple[DataFrame, float]:
    """The scores, checkpointed, and the perturbed score of the last document kept."""
    scored = C.checkpoint(scored)
    if rate is None:
        known = scored.join(_sample(labels, max_labels), "doc_id").select("log_weight", "good").toArrow()
        k = scored.where(F.col("log_weight") >= F.lit(best_cut(known["log_weight"].to_numpy(), known["good"].to_numpy()))).count()
    else:
        k = round(n * rate)
    return scored, kth_largest(scored, "perturbed", k)


def classified(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float | None = None, max_labels: int = MAX_LABELS, seed: int = SEED) -> DataFrame:
    """doc_id, log_weight, perturbed, kept for every document."""
    ratio, n = log_ratios(docs, labels, id_col, text_col, max_labels)
    scored, least = threshold(weights(docs, ratio, id_col, text_col, seed), labels, n, rate, max_labels)
    return scored.withColumn("kept", F.col("perturbed") >= F.lit(least))


def _noise(id_col: str, seed: int) -> Column:
    u = (F.pmod(F.xxhash64(F.coalesce(F.col(id_col).cast("long"), F.lit(-1)), F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def kept(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float | None = None, max_labels: int = MAX_LABELS, seed: int = SEED) -> DataFrame:
    """The documents that stay, with all their columns; texts are not shuffled."""
    ratio, n = log_ratios(docs, labels, id_col, text_col, max_labels)
    least = threshold(weights(docs, ratio, id_col, text_col, seed), labels, n, rate, max_labels)[1]
    shared = docs.sparkSession.sparkContext.broadcast(ratio)
    at_text = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for b in C.slices(batches, text_col):
            at, doc = _buckets(*C.text_bytes(b.column(at_text)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.bincount(doc, table[at], b.num_rows), pa.float64())], names=[*b.schema.names, WEIGHT])

    schema = T.StructType([*docs.schema.fields, T.StructField(WEIGHT, T.DoubleType())])
    return docs.mapInArrow(C.trimmed(run), schema).where(F.col(WEIGHT) + _noise(id_col, seed) >= F.lit(least)).drop(WEIGHT)


def op8_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels"))
