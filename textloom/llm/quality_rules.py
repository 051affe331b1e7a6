"""Operator 1: quality rules with suffix-array repetition.

Every text is sorted as a suffix array over its words; of words over ``LONG`` bytes, as
unspaced scripts have them, over their code points, ``CHARS`` of which count as a word.
Neighbouring suffixes give longest common prefixes; the deepest LCP interval around a suffix is the
longest substring that starts there and occurs again.  Spans of those of at
least ``min_repeat`` words are united; a text fails if the united spans hold more
than ``max_covered`` of its word characters, or its longest repeat has more than
``max_longest`` words.

The suffix arrays of all texts of an Arrow slice are built together by prefix
doubling: the first key holds the text's number, so suffixes of two texts never
meet in a group, and each round sorts only suffixes that still share a group.
No shuffle; memory is bounded by ``BATCH_BYTES`` or one text.

Defined cases: null text has no words; no words means base_failed (n_words < 50)
and kept false; repeated rows are judged one by one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import common as C

#: Bytes of the longest word that is one symbol, and code points that count as a word in longer ones.
LONG, CHARS = 64, 6
SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True


@dataclass(frozen=True)
class Rules:
    min_words: int = 50
    window: int = 3
    max_repeat_percent: int = 50
    min_repeat: int = 5
    max_covered: float = 0.4
    max_longest: int = 100


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, repeat_fraction double, longest_repeat long"


def longest_repeats(ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Words of the longest substring that starts at each position and occurs again in its text.

    ids: dense symbol ids; offsets: position offsets of the texts.
    """
    n = len(ids)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    counts = np.diff(offsets)
    doc = np.repeat(np.arange(len(counts)), counts)
    end = np.repeat(offsets[1:], counts)
    key = doc * (int(ids.max()) + 1) + ids
    order = np.argsort(key, kind="stable")
    sk = key[order]
    head = np.flatnonzero(np.concatenate(([True], sk[1:] != sk[:-1])))
    size = np.diff(np.append(head, n))
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(head, size)
    sa = order
    levels: list[tuple[int, np.ndarray]] = []
    open_ = order[np.repeat(size > 1, size)]
    h = 1
    while len(open_):
        levels.append((h, rank.copy()))
        nxt = open_ + h
        tail = np.where(nxt < end[open_], rank[np.minimum(nxt, n - 1)] + 1, 0)
        key = rank[open_] * (n + 1) + tail
        o = np.argsort(key, kind="stable")
        sk, pos = key[o], open_[o]
        old = sk // (n + 1)
        new_run = np.concatenate(([True], sk[1:] != sk[:-1]))
        old_run = np.concatenate(([True], old[1:] != old[:-1]))
        idx = np.arange(len(sk))
        run_at = np.maximum.accumulate(np.where(new_run, idx, 0))
        old_at = np.maximum.accumulate(np.where(old_run, idx, 0))
        rank[pos] = old + run_at - old_at
        size = np.diff(np.append(np.flatnonzero(new_run), len(sk)))
        open_ = pos[np.repeat(size > 1, size)]
        h *= 2
    sa = np.empty(n, np.int64)
    sa[rank] = np.arange(n)
    if not levels:
        return out
    first = levels[0][1]
    r = np.flatnonzero(first[sa[1:]] == first[sa[:-1]]) + 1
    a, b = sa[r - 1], sa[r]
    lcp = np.zeros(len(r), np.int64)
    for h, rk in reversed(levels):
        x, y = a + lcp, b + lcp
        fits = (x + h <= end[a]) & (y + h <= end[b])
        same = fits & (rk[np.minimum(x, n - 1)] == rk[np.minimum(y, n - 1)])
        lcp += np.where(same, h, 0)
    np.maximum.at(out, a, lcp)
    np.maximum.at(out, b, lcp)
    return out


def _covered(at: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    """Positions in the union of the spans."""
    d = np.bincount(at, minlength=n + 1)[: n + 1] - np.bincount(at + length, minlength=n + 1)[: n + 1]
    return np.cumsum(d)[:n] > 0


def measure(data: np.ndarray, off: np.ndarray, rules: Rules) -> dict[str, np.ndarray]:
    """All figures of operator 1 for a batch of texts."""
    w = C.Words(data, off)
    heads = C.IS_HEAD[data] & w.inside
    word_chars = C.seg_sum(heads, off)
    n_symbols = C.seg_sum(SYMBOLS[data], off)
    n = len(w.starts)
    rep = longest_repeats(w.ids, w.offsets)
    at = np.flatnonzero(rep >= rules.window)
    n_repeat = C.seg_sum(_covered(at, np.full(len(at), rules.window), n), w.offsets)
    chars = C.seg_sum(heads, np.append(w.starts, len(data))) if n else np.zeros(0, np.int64)
    offsets, size = w.offsets, np.full(n, CHARS)
    if n and (w.ends - w.starts).max() > LONG:
        rep, offsets, chars, size = _split_long(w, data, chars)
    # words that a span holds, times CHARS
    upto = np.append(0, np.cumsum(size))
    places = np.arange(len(rep))
    words = upto[places + rep] - upto[places]
    at = np.flatnonzero(words >= CHARS * rules.min_repeat)
    covered = C.seg_sum(np.where(_covered(at, rep[at], len(rep)), chars, 0), offsets)
    longest = C.seg_reduce(np.maximum, words, offsets, 0) // CHARS
    return {
        "n_words": w.counts, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": dup_lines(data, off, w.starts), "n_repeat_words": n_repeat,
        "repeat_fraction": covered / np.maximum(word_chars, 1), "longest_repeat": np.where(longest >= rules.min_repeat, longest, 0),
    }


def _split_long(w: C.Words, data: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Longest repeats, text offsets, code points and size of the symbols, with long words as their code points."""
    long = w.ends - w.starts > LONG
    n = np.where(long, chars, 1)
    first = np.cumsum(n) - n  # of each word
    ids = np.zeros(int(n.sum()), np.int64)
    ids[first[~long]] = w.ids[~long]
    begin, lens = w.starts[long], (w.ends - w.starts)[long]
    at = C.ragged(begin, lens)
    head = C.IS_HEAD[data[at]]
    point = np.maximum(np.cumsum(head) - 1, 0)
    value = np.zeros(int(head.sum()), np.int64)
    for k in range(4):  # the bytes of a code point, one after the other
        k_th = np.arange(len(at)) - np.flatnonzero(head)[point] == k
        value[point[k_th]] = value[point[k_th]] << 8 | data[at[k_th]]
    _, value = np.unique(value, return_inverse=True)
    ids[C.ragged(first[long], n[long])] = value + len(w.vocab)
    offsets = np.append(0, np.cumsum(n))[w.offsets]
    size = np.repeat(np.where(long, 1, CHARS), n)
    return longest_repeats(ids, offsets), offsets, np.where(size == 1, 1, np.repeat(chars, n)), size


def dup_lines(data: np.ndarray, off: np.ndarray, word_starts: np.ndarray) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text."""
    n_docs = len(off) - 1
    is_nl = data == 10
    nl = np.flatnonzero(is_nl)
    lo = np.sort(np.concatenate((off[:-1], nl + 1)))
    doc = np.repeat(np.arange(n_docs), C.seg_sum(is_nl, off) + 1)
    hi = np.sort(np.concatenate((nl, off[1:])))
    has_word = np.searchsorted(word_starts, hi) > np.searchsorted(word_starts, lo)
    lo, hi, doc = lo[has_word], hi[has_word], doc[has_word]
    if not len(lo):
        return np.zeros(n_docs, np.int64)
    lens = hi - lo
    ids = C.binary_array(data[C.ragged(lo, lens)], lens).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    key = np.sort(doc * (int(ids.max()) + 1) + ids)
    again = key[1:][key[1:] == key[:-1]] // (int(ids.max()) + 1)
    return np.bincount(again, minlength=n_docs)


def verdict(m: dict[str, np.ndarray], rules: Rules) -> tuple[np.ndarray, np.ndarray]:
    """base_failed and kept."""
    failed = (m["n_words"] < rules.min_words) | (100 * m["n_repeat_words"] > rules.max_repeat_percent * m["n_words"])
    bad = (m["repeat_fraction"] > rules.max_covered) | (m["longest_repeat"] > rules.max_longest)
    return failed, ~failed & ~bad


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """One row of figures and verdict per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.slices(batches, "text"):
            m = measure(*C.text_bytes(b.column(1)), rules)
            failed, kept = verdict(m, rules)
            names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
            cols = [b.column(0), *(pa.array(m[k], pa.int64()) for k in names), pa.array(failed), pa.array(kept), pa.array(m["repeat_fraction"], pa.float64()), pa.array(m["longest_repeat"], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", *names, "base_failed", "kept", "repeat_fraction", "longest_repeat"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(C.trimmed(run), SCHEMA)


def keep(docs: DataFrame, text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """The documents that pass, with all their columns, without a shuffle."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.slices(batches, text_col):
            yield b.filter(pa.array(verdict(measure(*C.text_bytes(b.column(at)), rules), rules)[1]))

    return docs.mapInArrow(C.trimmed(run), docs.schema)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(C.table(spark, sf_dir, "documents"))
