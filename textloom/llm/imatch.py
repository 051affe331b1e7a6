"""Operator 3: I-Match document fingerprints over randomised lexicons.

Terms are lower-cased (A-Z) words.  The lexicon is the terms whose share of
documents lies between ``LOW`` and ``HIGH``, a band of inverse document frequency.
A fingerprint hashes, for each of ``SUBSETS`` random sub-lexicons, the sequence of the
text's distinct terms in it, sorted by their hashes, to 32 bits.  A sub-lexicon keeps a term with probability
2**-level; the level follows the text's own number of terms in the band, so that
a subset holds about one of them, and two neighbouring levels are written, so that
texts of nearly the same size share one.  The likeness of two fingerprints is the
share of equal hashes among subsets, at common levels, that are not empty in both.

Document frequencies are exact over all texts.  A term of share LOW has that share
in some block of documents, so blocks mark theirs in a bitmap of fixed size and a
second pass counts the marked terms.  The lexicon has at most (mean distinct terms
of a text) / LOW terms, which bounds what is broadcast.

The edited text needs the next document by id.  Ids are cut into buckets at their
quantiles, and the first document of a bucket goes to the bucket before it too, so
texts are shuffled once and no window spans the table.

Defined cases: null text is empty; texts without a term in the band are hashed
whole ("w"), so only equal term sets are alike; a null id comes before all ids;
rows of one id are ordered by text, each one's next being the next row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import common as C

LOW, HIGH = 2e-4, 0.05
SUBSETS = 32
#: Terms of a text in a subset, about.
TERMS = 0.6
BLOCK_DOCS, MAP_BITS = 8192, 23
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

_SEEDS = np.random.Generator(np.random.PCG64(31)).integers(0, 1 << 63, 2 * SUBSETS, dtype=np.uint64)
_LEAST_ID = -(1 << 63)


def _terms(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct words of a batch, and (text, word) pairs, distinct and sorted."""
    w = C.Words(C.LOWER[data], off)
    hv = C.hash_binary(w.vocab)
    n = max(len(hv), 1)
    pairs = np.unique(w.docs() * n + w.ids)
    return hv, pairs // n, pairs % n


def lexicon(docs: DataFrame, text_col: str = "text", low: float = LOW, high: float = HIGH) -> np.ndarray:
    """Sorted hashes of the terms in the band."""
    rows = docs.select(F.col(text_col).cast("string").alias("text"))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        seen = 0

        def frequent() -> pa.RecordBatch:
            keys = np.concatenate([k for k, _ in held])
            order = np.argsort(keys)
            keys, n = keys[order], np.concatenate([x for _, x in held])[order]
            first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
            total = np.add.reduceat(n, first) if len(first) else np.zeros(0, np.int64)
            hit = keys[first][total >= low * seen] >> np.uint64(64 - MAP_BITS)
            mark = np.zeros(1 << (MAP_BITS - 3), np.uint8)
            np.bitwise_or.at(mark, (hit >> np.uint64(3)).astype(np.int64), np.left_shift(np.uint8(1), (hit & np.uint64(7)).astype(np.uint8)))
            words = mark.view(np.int64)
            at = np.flatnonzero(words)
            # row -1 carries the number of documents
            return pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(words[at], 0)), pa.array(np.append(np.zeros(len(at), np.int64), seen))], names=["at", "bits", "n"])

        for b in C.slices(batches, "text"):
            hv, _, ids = _terms(*C.text_bytes(b.column(0)))
            held.append((hv, np.bincount(ids, minlength=len(hv))))
            seen += b.num_rows
            if seen >= BLOCK_DOCS:
                yield frequent()
                held, seen = [], 0
        if held:
            yield frequent()

    marks = rows.mapInArrow(blocks, "at long, bits long, n long").groupBy("at").agg(F.bit_or("bits").alias("bits"), F.sum("n").alias("n")).toArrow()
    at, bits = marks["at"].to_numpy(), marks["bits"].to_numpy()
    mark = np.zeros(1 << (MAP_BITS - 6), np.int64)
    mark[at[at >= 0]] = bits[at >= 0]
    n = int(marks["n"].to_numpy().sum()) if len(at) else 0
    shared = docs.sparkSession.sparkContext.broadcast(mark.view(np.uint8))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in C.slices(batches, "text"):
            hv, _, ids = _terms(*C.text_bytes(b.column(0)))
            c = np.bincount(ids, minlength=len(hv))
            bucket = hv >> np.uint64(64 - MAP_BITS)
            hit = (own[(bucket >> np.uint64(3)).astype(np.int64)] >> (bucket & np.uint64(7)).astype(np.uint8)) & 1 == 1
            yield pa.RecordBatch.from_arrays([pa.array(C.signed(hv[hit])), pa.array(c[hit])], names=["h", "c"])

    kept = rows.mapInArrow(count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).where((F.col("c") >= low * n) & (F.col("c") <= max(high * n, 1))).select("h").toArrow()
    return np.sort(kept["h"].to_numpy().view(np.uint64))


class Prints:
    """Fingerprints of a batch of texts as arrays."""

    def __init__(self, data: np.ndarray, off: np.ndarray, lex: np.ndarray) -> None:
        n = len(off) - 1
        hv, doc, ids = _terms(data, off)
        at = np.minimum(np.searchsorted(lex, hv), max(len(lex) - 1, 0))
        known = lex[at] == hv if len(lex) else np.zeros(len(hv), bool)
        # whole-text hash, for texts outside the band
        with np.errstate(over="ignore"):
            self.whole = C.mix(C.seg_reduce(np.add, C.mix(hv[ids] ^ _SEEDS[0]), np.searchsorted(doc, np.arange(n + 1)), 0))
        hit = known[ids]
        doc, ids = doc[hit], ids[hit]
        order = np.lexsort((hv[ids], doc))  # each text's terms, sorted
        doc, ids = doc[order], ids[order]
        m = np.bincount(doc, minlength=n)
        self.level = np.where(m > 0, np.maximum(np.rint(np.log2(np.maximum(m, 1) / TERMS)), 0), -1).astype(np.int64)
        self.hashes = np.zeros((n, 2, SUBSETS), np.uint32)
        lev = self.level[doc]
        for k in range(SUBSETS):
            pick = C.mix(hv ^ _SEEDS[k])[ids]
            value = C.mix(hv ^ _SEEDS[SUBSETS + k])
            for j in range(2):
                sel = np.flatnonzero(pick >> (np.uint64(64) - np.maximum(lev + j, 1).astype(np.uint64)) == 0)
                if j == 0:  # level 0 keeps all terms
                    sel = np.union1d(sel, np.flatnonzero(lev == 0))
                if not len(sel):
                    continue
                d = doc[sel]
                first = np.flatnonzero(np.append(True, d[1:] != d[:-1]))
                place = np.arange(len(d)) - np.repeat(first, np.diff(np.append(first, len(d))))
                with np.errstate(over="ignore"):
                    h = C.mix(np.add.reduceat(value[ids[sel]] * C._powers(int(place.max()) + 1)[place], first))
                self.hashes[d[first], j, k] = np.maximum(h >> np.uint64(32), 1).astype(np.uint32)

    def strings(self) -> list[str]:
        return [f"{lv}:{row.astype('>u4').tobytes().hex()}" if lv >= 0 else f"w:{w:016x}" for lv, row, w in zip(self.level.tolist(), self.hashes, self.whole.tolist(), strict=True)]


def likeness(la: np.ndarray, ha: np.ndarray, wa: np.ndarray, lb: np.ndarray, hb: np.ndarray, wb: np.ndarray) -> np.ndarray:
    """Likeness of fingerprints, row by row."""
    same = np.zeros(len(la), np.int64)
    some = np.zeros(len(la), np.int64)
    for i in range(2):
        for j in range(2):
            common = (la + i == lb + j) & (la >= 0) & (lb >= 0)
            x, y = ha[:, i], hb[:, j]
            same += np.where(common, ((x == y) & (x > 0)).sum(1), 0)
            some += np.where(common, ((x > 0) | (y > 0)).sum(1), 0)
    equal = (la == lb) & np.where(la < 0, wa == wb, (ha == hb).all((1, 2)))
    return np.where(equal, 1.0, same / np.maximum(some, 1))


def _with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """bucket, copy, doc_id, text: sorted in each bucket, copies (the next bucket's first) last."""
    spark = docs.sparkSession
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(_LEAST_ID))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), key.alias("k"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_buckets = 4 * n_parts
    cuts = rows.select(F.percentile_approx("k", [i / n_buckets for i in range(1, n_buckets)] or [0.5], 100 * n_buckets)).first()[0]
    cuts = sorted(set(cuts or []))
    bucket = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col("k"))) if cuts else F.lit(0)
    rows = rows.withColumn("own", bucket)
    firsts = sorted(rows.groupBy("own").agg(F.min("k")).collect())  # a row for each bucket
    if not firsts:
        return rows.select(F.col("own").alias("bucket"), F.lit(0).alias("copy"), "doc_id", "text")
    first_of, before = [0] * (len(cuts) + 1), [0] * (len(cuts) + 1)
    for i, (b, k) in enumerate(firsts):
        first_of[b], before[b] = k, firsts[i - 1][0]
    first = F.element_at(F.array(*[F.lit(x) for x in first_of]), F.col("own") + 1)
    prev = F.element_at(F.array(*[F.lit(x) for x in before]), F.col("own") + 1)
    mine = F.struct(F.col("own").alias("bucket"), F.lit(0).alias("copy"))
    places = F.when(F.col("k") == first, F.array(mine, F.struct(prev.alias("bucket"), F.lit(1).alias("copy")))).otherwise(F.array(mine))
    rows = rows.withColumn("place", F.explode(places)).select("place.bucket", "place.copy", "k", "doc_id", "text")
    return rows.repartition(n_parts, "bucket").sortWithinPartitions("bucket", "copy", "k", "text").select("bucket", "copy", "doc_id", "text")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", low: float = LOW, high: float = HIGH) -> DataFrame:
    """Fingerprint of every text, of its edited text, and their likeness."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon(docs, text_col, low, high))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = shared.value
        held: list[tuple] = []  # the last row, whose next is still to come
        for b in C.slices(batches, "text", C.BATCH_BYTES // 2):
            rows = held + list(zip(*(c.to_pylist() for c in b.columns), strict=True))
            held = rows[-1:]
            texts = [r[3] for r in rows]
            has = [i for i in range(len(rows) - 1) if not rows[i][1] and rows[i][0] == rows[i + 1][0]]
            edited = []
            for i in has:
                cut = len(texts[i]) // 4
                edited.append(texts[i][: len(texts[i]) - cut] + texts[i + 1][:cut])
            if not has:
                continue
            p = Prints(*C.text_bytes(pa.array(texts + edited, pa.string())), lex)
            at, nxt, ed = np.array(has), np.array(has) + 1, len(texts) + np.arange(len(has))
            side = lambda x: (p.level[x], p.hashes[x], p.whole[x])
            s = p.strings()
            cols = [
                pa.array([rows[i][2] for i in has], pa.int64()), pa.array([len(texts[i]) for i in has], pa.int64()), pa.array([hashlib.sha256(e.encode("utf-8")).hexdigest() for e in edited]),
                pa.array([s[i] for i in has]), pa.array(s[len(texts) :]), pa.array(likeness(*side(at), *side(ed))), pa.array(likeness(*side(at), *side(nxt))),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return _with_next(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def op3_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(C.table(spark, sf_dir, "documents"))
