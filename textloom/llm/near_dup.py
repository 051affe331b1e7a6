"""Operator 9: near-duplicates by SetSketch registers.

A document's set is its distinct shingles of ``shingle`` words (lower-cased A-Z),
three by default, or the whole sequence if it has fewer words.  A link is a
similarity of ``percent`` % or more, 85 by default.  Register j of its sketch is the truncated
minimum floor(1 - log_b x), x the least of exponential variates that register j
draws for the shingles; sketches merge by maximum, and equal registers are as
likely as the sets are alike.  Bands of registers (see ``Rule``) give candidates, the
joint likelihood of the register orders given both set sizes drops pairs that
cannot reach the threshold, and links are confirmed on the full sets.

Groups of copies never give all pairs:
* equal sets are one class, compared once through its representative;
* in a bucket each member meets only the bucket's two pivots, its least member and
  its most central one, which shares most buckets with others (the text that a
  group's copies were made from, if it is there); it meets the pivot that it shares
  most buckets with first, and members that are then in one component need no
  further test;
* members of buckets that still hold several components are joined by prefixes of
  their sets: shingles are put in one order, rare ones first, and a link must share
  a shingle among the first n - ceil(percent n / 100) + 1 of both, and after the first one
  shared enough must be left in both.  Copies that drifted apart have prefixes of
  their own and never meet.  This join is exact.
So no link is lost but by the bands: at the threshold a pair shares none with
probability below ``MISS``, (1 - 0.85**6)**36 at 85 % and (1 - 0.8**5)**43 at 80 %.

Only the texts of classes that share a bucket leave the tasks that read them.

Defined cases: null or blank text is an empty set, linked with nothing; rows of
one doc_id are one document: they are linked, and each row shows its own set's
size; of these, ``deduplicated`` keeps one; a null doc_id has a null component and
is kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import common as C
from textloom.llm.components import components

SHINGLE = 3
#: link if PERCENT * union <= 100 * intersection
PERCENT = 85
REGISTERS = 216
#: Greatest probability that a pair at the threshold shares no band.
MISS = 1e-7
BASE, RATE = 1.001, 20.0
#: Members of a pivot that are tested in one task's turn.
PART = 1000
#: Counters of the table that orders shingles by rarity; any order is right.
RARITY_BITS = 20
#: Natural-log likelihood ratio beyond which a similarity is ruled out (chance of error about exp(-20)).
RULED_OUT = 20.0

_RNG = np.random.Generator(np.random.PCG64(99))
_MUL = _RNG.integers(0, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, REGISTERS, dtype=np.uint64)
_WINDOW = _RNG.integers(0, 1 << 63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@dataclass(frozen=True)
class Rule:
    """Words of a shingle and the least similarity of a link in percent."""

    shingle: int = SHINGLE
    percent: int = PERCENT

    @property
    def rows(self) -> int:
        """Registers of a band: the most with which the bands still miss no more than ``MISS``."""
        p = self.percent / 100
        return max((k for k in range(1, REGISTERS + 1) if (1 - p**k) ** (REGISTERS // k) <= MISS), default=1)

    @property
    def bands(self) -> int:
        return REGISTERS // self.rows


def shingles(data: np.ndarray, off: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text, sorted, and the texts' offsets."""
    w = C.Words(C.LOWER[data], off)
    h = w.hashes()
    n = w.counts
    with np.errstate(over="ignore"):
        full = np.maximum(n - size + 1, 0)
        at = C.ragged(w.offsets[:-1], full)
        s = np.zeros(len(at), np.uint64)
        for k in range(size):
            s += C.mix(h[at + k] + _WINDOW[k]) * _WINDOW[k]
        doc = np.repeat(np.arange(len(n)), full)
        short = np.flatnonzero((n > 0) & (n < size))
        if len(short):
            t = n[short].astype(np.uint64) * np.uint64(0x94D049BB133111EB)
            for k in range(size - 1):
                has = n[short] > k
                t[has] += C.mix(h[w.offsets[:-1][short[has]] + k] + _WINDOW[k]) * _WINDOW[k]
            s, doc = np.concatenate((s, t)), np.concatenate((doc, short))
        s = C.mix(s)
    order = np.argsort(s)
    d = doc[order].astype(np.uint16 if len(n) < 1 << 16 else np.int64)
    order = order[np.argsort(d, kind="stable")]
    s, doc = s[order], doc[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
    s, doc = s[new], doc[new]
    return s, np.searchsorted(doc, np.arange(len(n) + 1))


def registers(s: np.ndarray, off: np.ndarray) -> np.ndarray:
    """SetSketch registers (uint16), a row for each text; zeros for an empty set."""
    n = len(off) - 1
    out = np.zeros((n, REGISTERS), np.uint16)
    full = np.flatnonzero(off[1:] > off[:-1])
    if not len(full):
        return out
    starts = off[:-1][full]
    least = np.empty((REGISTERS, len(full)), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(REGISTERS):
            np.minimum.reduceat(s * _MUL[j] + _ADD[j], starts, out=least[j])
    x = -np.log1p(-((least >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)) / RATE
    k = np.floor(1 - np.log(x) / np.log(BASE))
    out[full] = np.clip(k, 0, 65535).astype(np.uint16).T
    return out


def band_hashes(reg: np.ndarray, rule: Rule = Rule()) -> np.ndarray:
    """A hash for each band; holds the band's number."""
    with np.errstate(over="ignore"):
        rows, bands = rule.rows, rule.bands
        h = np.zeros((len(reg), bands), np.uint64)
        for r in range(rows):
            h = C.mix(h * np.uint64(0x9E3779B97F4A7C15) + reg[:, r : rows * bands : rows].astype(np.uint64) + np.uint64(1))
        return C.mix(h + np.arange(bands, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _log_p(x: np.ndarray) -> np.ndarray:
    """p_b(x) = -log_b(1 - x (b - 1) / b) of the SetSketch paper (Ertl, 2021)."""
    return -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)


def likelihood(j: np.ndarray, u: np.ndarray, v: np.ndarray, more: np.ndarray, less: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Joint log-likelihood of similarity j given the relative sizes u, v and the register orders."""
    a = np.clip(_log_p(np.maximum(u - v * j, 0)), 1e-12, 1)
    b = np.clip(_log_p(np.maximum(v - u * j, 0)), 1e-12, 1)
    return more * np.log(a) + less * np.log(b) + same * np.log(np.clip(1 - a - b, 1e-12, 1))


def estimate(nu: np.ndarray, nv: np.ndarray, ru: np.ndarray, rv: np.ndarray, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """Most likely similarity, and whether ``floor`` or more is ruled out."""
    u, v = nu / (nu + nv), nv / (nu + nv)
    more, less, same = (ru > rv).sum(1), (ru < rv).sum(1), (ru == rv).sum(1)
    lo, hi = np.zeros(len(u)), np.minimum(u, v) / np.maximum(u, v)
    top = hi.copy()
    for _ in range(40):  # the likelihood has one peak
        a, b = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        up = likelihood(a, u, v, more, less, same) < likelihood(b, u, v, more, less, same)
        lo, hi = np.where(up, a, lo), np.where(up, hi, b)
    best = (lo + hi) / 2
    gap = likelihood(best, u, v, more, less, same) - likelihood(np.minimum(floor, top), u, v, more, less, same)
    return best, (best < floor) & (gap > RULED_OUT)


def set_hashes(s: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each whole set."""
    with np.errstate(over="ignore"):
        return C.seg_reduce(np.add, s, off, 0), C.seg_reduce(np.add, C.mix(s ^ _WINDOW[4]), off, 0)


def sketches(docs: DataFrame, id_col: str, text_col: str, rule: Rule = Rule()) -> DataFrame:
    """doc_id, n, two hashes of the whole set, registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.slices(batches, "text"):
            s, off = shingles(*C.text_bytes(b.column(1)), rule.shingle)
            one, two = set_hashes(s, off)
            reg = registers(s, off)
            raw = C.binary_array(reg.view(np.uint8).ravel(), np.full(len(reg), 2 * REGISTERS))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(off)), pa.array(C.signed(one)), pa.array(C.signed(two)), raw], names=["doc_id", "n", "h1", "h2", "reg"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(C.trimmed(run), "doc_id long, n long, h1 long, h2 long, reg binary")


def _regs(col: pa.Array) -> np.ndarray:
    return C.text_bytes(col)[0].view(np.uint16).reshape(-1, REGISTERS)


def _bands(classes: DataFrame, rule: Rule) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                h = band_hashes(_regs(b.column(1)), rule)
                yield pa.RecordBatch.from_arrays([pa.array(C.signed(h.ravel())), pa.array(np.repeat(b.column(0).to_numpy(), rule.bands))], names=["bucket", "node"])

    return classes.select("node", "reg").mapInArrow(C.trimmed(run), "bucket long, node long")


def _members(bands: DataFrame) -> DataFrame:
    """(bucket, node, low, center, size): rows of buckets with several members, and the bucket's pivots."""
    shared = C.checkpoint(bands.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("size")).where("low <> high").drop("high"))
    rows = C.checkpoint(bands.join(C.few(shared), "bucket"))
    # how many members a class meets in all its buckets
    degree = rows.groupBy("node").agg(F.sum("size").alias("degree"))
    center = rows.where("size > 2").join(degree, "node").groupBy("bucket").agg(F.max(F.struct("degree", (-F.col("node")).alias("first"))).alias("c"))
    center = center.select("bucket", (-F.col("c.first")).alias("center"))
    return C.checkpoint(rows.join(center, "bucket", "left").select("bucket", "node", "low", F.coalesce("center", "low").alias("center"), "size"))


def _pivot_pairs(bands: DataFrame) -> DataFrame:
    """(member, pivot, shared): each pair of a member and a pivot once, with the number of buckets they share."""
    pairs = bands.select("node", F.explode(F.array_distinct(F.array("low", "center"))).alias("pivot")).where("node <> pivot")
    pairs = pairs.groupBy(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).agg(F.max("pivot").alias("pivot"), F.count("*").alias("shared"))
    return pairs.select((F.col("a") + F.col("b") - F.col("pivot")).alias("member"), "pivot", "shared")


def _candidates(docs: DataFrame, classes: DataFrame, nodes: DataFrame, id_col: str, text_col: str, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """(node, n, reg) and (node, text) of the classes in ``nodes``; no other text leaves its task."""
    own = C.checkpoint(classes.join(C.few(nodes), "node", "left_semi"))
    keys = C.few(own.select("node", "rep", "h1", "h2"))
    rows = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).cast("string").alias("text")).join(keys.select("rep"), "rep", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, np.uint64)
        for b in C.slices(batches, "text"):
            s, off = shingles(*C.text_bytes(b.column(1)), rule.shingle)
            one, two = set_hashes(s, off)
            _, first = np.unique(one, return_index=True)
            first = first[~np.isin(one[first], seen)]  # repeated rows go once
            seen = np.concatenate((seen, one[first]))
            yield pa.RecordBatch.from_arrays([pa.array(C.signed(one[first])), pa.array(C.signed(two[first])), b.column(1).take(pa.array(first))], names=["h1", "h2", "text"])

    found = rows.mapInArrow(C.trimmed(run), "h1 long, h2 long, text string").join(keys, ["h1", "h2"]).select("node", "text")
    return own.select("node", "n", "reg"), C.checkpoint(found)


def _test(pairs: DataFrame, own: DataFrame, texts: DataFrame, rule: Rule) -> DataFrame:
    """(a, b, inter, uni) of the pairs (member, pivot) that the joint likelihood doesn't rule out, from their full sets.

    A pivot goes once to each part of its members, sorted before them, so neither it nor
    its members meet in one task, and its text is not copied for each pair.
    """
    pairs = pairs.select("member", "pivot")
    large = C.checkpoint(pairs.groupBy("pivot").agg(F.count("*").alias("n")).where(F.col("n") > PART).select("pivot", F.ceil(F.col("n") / PART).alias("parts")))
    part = F.coalesce(F.pmod(F.xxhash64("member"), "parts"), F.lit(0)).alias("part")
    pairs = C.checkpoint(pairs.join(C.few(large), "pivot", "left").select("member", "pivot", part))
    every = own.join(texts, "node")
    members = pairs.join(every, F.col("member") == F.col("node")).select("pivot", "part", "node", "n", "reg", "text")
    heads = pairs.select("pivot", "part").distinct().join(every, F.col("pivot") == F.col("node")).select("pivot", "part", F.lit(None).cast("long").alias("node"), "n", "reg", "text")
    rows = heads.union(members).repartition("pivot", "part").sortWithinPartitions("pivot", "part", F.col("node").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the last head, whose members may go on
        for b in C.slices(batches, "text", C.BATCH_BYTES // 2):
            b = pa.Table.from_batches([*held, b]).combine_chunks().to_batches()[0]
            pivot, part, n = (b.column(k).to_numpy() for k in (0, 1, 3))
            head = b.column(2).is_null().to_numpy(zero_copy_only=False)
            node = b.column(2).fill_null(0).to_numpy()
            of = np.maximum.accumulate(np.where(head, np.arange(len(head)), 0))
            held = [b.slice(of[-1], 1)]
            again = np.append(False, (node[1:] == node[:-1]) & (pivot[1:] == pivot[:-1]) & (part[1:] == part[:-1]) & ~head[:-1])
            i = np.flatnonzero(~head & ~again)
            j = of[i]
            fits = 100 * np.minimum(n[i], n[j]) >= rule.percent * np.maximum(n[i], n[j])
            i, j = i[fits], j[fits]
            reg = _regs(b.column(4))
            _, out = estimate(n[i].astype(float), n[j].astype(float), reg[i], reg[j], rule.percent / 100)
            i, j = i[~out], j[~out]
            if not len(i):
                continue
            used, at = np.unique(np.append(i, j), return_inverse=True)
            s, off = shingles(*C.text_bytes(b.column(5).take(pa.array(used))), rule.shingle)
            size = np.diff(off)
            pair = np.repeat(np.append(np.arange(len(i)), np.arange(len(i))), size[at])
            s = s[C.ragged(off[at], size[at])]
            o = np.lexsort((s, pair))
            s, pair = s[o], pair[o]
            both = np.bincount(pair[1:][(s[1:] == s[:-1]) & (pair[1:] == pair[:-1])], minlength=len(i))
            uni = size[at[: len(i)]] + size[at[len(i) :]] - both
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[i], pivot[i])), pa.array(np.maximum(node[i], pivot[i])), pa.array(both), pa.array(uni)], names=["a", "b", "inter", "uni"])

    return C.checkpoint(rows.mapInArrow(C.trimmed(run), "a long, b long, inter long, uni long"))


def _links(tested: DataFrame, rule: Rule) -> DataFrame:
    return tested.where(100 * F.col("inter") >= rule.percent * F.col("uni")).select(F.col("a").alias("u"), F.col("b").alias("v"))


def _apart(pairs: DataFrame, label: DataFrame, a: str, b: str) -> DataFrame:
    """The pairs whose ends aren't in one component yet."""
    for end in (a, b):
        pairs = pairs.join(label.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}")), end, "left")
    return pairs.where(F.coalesce(f"of_{a}", a) != F.coalesce(f"of_{b}", b)).drop(f"of_{a}", f"of_{b}")


def linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document."""
    spark, rule = docs.sparkSession, Rule(shingle, percent)
    own = C.checkpoint(sketches(docs, id_col, text_col, rule))
    some = own.where("n > 0 and doc_id is not null")
    classes = some.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("reg").alias("reg"))
    classes = C.checkpoint(classes.withColumn("node", F.monotonically_increasing_id()))  # fixed by the checkpoint
    of = own.select("doc_id", "n", "h1", "h2").join(classes.select("h1", "h2", "node", "rep"), ["h1", "h2"], "left").select("doc_id", "n", "node", "rep")
    of = C.checkpoint(of.withColumn("node", F.when(F.col("doc_id").isNotNull(), F.col("node"))))
    bands = _members(_bands(classes, rule))
    sketch, texts = _candidates(docs, classes, bands.select("node").distinct(), id_col, text_col, rule)
    C.free(spark)

    # rows of one id are one document
    several = C.checkpoint(of.where("node is not null").groupBy("doc_id").agg(F.min("node").alias("u"), F.max("node").alias("v")).where("u <> v").select("doc_id", "u"))
    links = C.checkpoint(of.join(C.few(several), "doc_id").where("node <> u").select("u", F.col("node").alias("v")).distinct())
    pairs = C.checkpoint(_pivot_pairs(bands))
    # each class meets the pivot that it shares most buckets with; then the others, unless they have come together
    first = pairs.groupBy("member").agg(F.max(F.struct("shared", "pivot")).alias("most")).select("member", F.col("most.pivot").alias("pivot"))
    tested = _test(first, sketch, texts, rule)
    links = links.union(_links(tested, rule))
    label = components(links)
    pairs = pairs.select(F.least("member", "pivot").alias("a"), F.greatest("member", "pivot").alias("b"), "member", "pivot").join(tested.select("a", "b"), ["a", "b"], "left_anti")
    pairs = C.checkpoint(_apart(pairs, label, "member", "pivot"))
    C.free(spark)
    for more in (lambda: pairs, lambda: _undecided(bands, label, tested, sketch, texts, rule)):
        left = more()
        if left is not None and not left.isEmpty():
            now = _test(left, sketch, texts, rule)
            tested = tested.union(now)
            if not (new := _links(now, rule)).isEmpty():
                links = links.union(new)
                label = components(links)
    # the least id of each component
    reps = classes.select("node", "rep").join(label, "node")
    least = C.checkpoint(reps.groupBy("component").agg(F.min("rep").alias("component_id")))
    named = label.join(C.few(least), "component").select("node", "component_id")
    out = of.join(named, "node", "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "rep"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _undecided(bands: DataFrame, label: DataFrame, tested: DataFrame, sketch: DataFrame, texts: DataFrame, rule: Rule) -> DataFrame | None:
    """Pairs in different components, of members of undecided buckets, whose prefixes meet (checkpointed); None without such buckets."""
    rows = bands.where("size > 2").select("bucket", "node").join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = rows.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("bucket")
    left = C.checkpoint(rows.join(mixed, "bucket").select("node", "component").distinct())
    if left.isEmpty():
        return None
    own = C.checkpoint(texts.join(C.few(left), "node").select("node", "component", "text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << RARITY_BITS, np.int64)
        for b in C.slices(batches, "text"):
            s, _ = shingles(*C.text_bytes(b.column(2)), rule.shingle)
            total += np.bincount((s >> np.uint64(64 - RARITY_BITS)).astype(np.int64), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])

    got = own.mapInArrow(C.trimmed(count), "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # at most 2**RARITY_BITS rows
    table = np.zeros(1 << RARITY_BITS, np.int64)
    table[got["at"].to_numpy()] = got["n"].to_numpy()
    shared = own.sparkSession.sparkContext.broadcast(table)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = shared.value
        for b in C.slices(batches, "text"):
            s, off = shingles(*C.text_bytes(b.column(2)), rule.shingle)
            n = np.diff(off)
            doc = np.repeat(np.arange(len(n)), n)
            o = np.lexsort((s, common[(s >> np.uint64(64 - RARITY_BITS)).astype(np.int64)], doc))
            length = n - -(-rule.percent * n // 100) + (n > 0)
            at = C.ragged(off[:-1], length)
            doc = doc[o][at]
            yield pa.RecordBatch.from_arrays([pa.array(C.signed(s[o][at])), b.column(0).take(pa.array(doc)), b.column(1).take(pa.array(doc)), pa.array(n[doc]), pa.array(C.ragged(np.zeros(len(n), np.int64), length))], names=["shingle", "node", "component", "n", "at"])

    pre = own.mapInArrow(C.trimmed(prefixes), "shingle long, node long, component long, n long, at long")
    # shingles of one document or component only can't decide anything
    meet = pre.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("shingle")
    one = C.checkpoint(pre.join(meet, "shingle"))
    two = one.select("shingle", *(F.col(c).alias(f"{c}_2") for c in ("node", "component", "n", "at")))
    on = (F.col("node") < F.col("node_2")) & (F.col("component") != F.col("component_2")) & (100 * F.least("n", "n_2") >= rule.percent * F.greatest("n", "n_2"))
    # if this is the first shared shingle, no more than what follows it is shared; true of every link's first
    on &= (100 + rule.percent) * F.least(F.col("n") - F.col("at"), F.col("n_2") - F.col("at_2")) >= rule.percent * (F.col("n") + F.col("n_2"))
    pairs = one.join(two, (one["shingle"] == two["shingle"]) & on).select(F.col("node").alias("a"), F.col("node_2").alias("b")).distinct()
    return C.checkpoint(pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti").select(F.col("a").alias("member"), F.col("b").alias("pivot")))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The documents that stay, one of each component, with all their columns; of rows with one id, one.

    Only ids of documents that go are looked for, so texts don't move where these are few.
    """
    rows = C.checkpoint(linked(docs, id_col, text_col, shingle, percent))
    go = C.checkpoint(rows.where("not kept").select(F.col("doc_id").alias(id_col)).distinct())
    again = C.checkpoint(rows.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(id_col)))
    stay = docs.join(C.few(go), id_col, "left_anti")
    if again.isEmpty():
        return stay
    again = C.few(again)
    return stay.join(again, id_col, "left_anti").unionByName(stay.join(again, id_col, "left_semi").dropDuplicates([id_col]))


def op9_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(C.table(spark, sf_dir, "documents"))
