"""Operator 6: language-model scoring by a weighted backoff automaton.

Learning.  Words are lower-cased (A-Z) and every text ends with one end token,
which is also the context a text starts from.  Every word and every n-gram of
orders 2 and 3 that occurs ``LEAST`` times or more in the training texts is in the
model, however large the corpus.  Counts are exact.

Model.  p(w | u v) is the discounted share of w after u v, plus what the discounts
and the n-grams left out leave of the mass (the backoff weight) times p(w | v);
likewise down to the smoothed unigram.  So each history's distribution sums to one.

Scale.  Nothing of the corpus is collected or broadcast.  Slices of texts ("chunks")
send their distinct words and n-grams, with training counts, to buckets by hash;
the number of buckets follows the size of the texts.  A trigram goes where its
context goes, so a bucket has all the counts of its contexts.  Buckets sum the
counts and answer each chunk that asked, in the order of its question; the chunk
then has all it needs to score its texts.  The buckets are served in ``ROUNDS``
rounds, each ended by a checkpoint of its answers, so disks hold one round's questions.

``learn`` gives the same model as an automaton in one process, for small corpora:
kept contexts are states; an arc (state, word) carries the log-probability and
leads to the longest known suffix; a missing arc takes the state's failure arc,
whose weight is the backoff weight.

Defined cases: null or blank text is the end token alone; a null id counts as the
text "" for the training split; repeated rows are trained on and scored each; with no training
rows N = V = 0 and every word has the same base probability.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import common as C

#: Least training count of an n-gram in the model.
LEAST = 2
#: Text bytes of a chunk; characters of text for each bucket, and fewest buckets.
CHUNK, PER_BUCKET, MIN_BUCKETS = 8 << 20, 8 << 20, 256
#: Rounds in which n-grams are exchanged; the files of one round are on disk at a time.
ROUNDS = 2
DISCOUNT = 0.5
#: Tokens of a window in scoring.
WINDOW = 256
END = int(C.signed(C.hash_binary(pa.array([b"\x00end"], pa.binary())))[0])


def coded(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted hashes (as long) of the distinct words and END, their numbers in each text, which ends with END, and the texts' offsets."""
    w = C.Words(C.LOWER[data], off)
    words, at = np.unique(np.append(C.signed(C.hash_binary(w.vocab)), END), return_inverse=True)
    return words, np.insert(at[w.ids], w.offsets[1:], at[-1]), w.offsets + np.arange(len(off))


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes (as long) of each text and its end token, and the texts' offsets."""
    words, ids, off = coded(data, off)
    return words[ids], off


def _grams(h: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(first, middle, last) word hashes of every n-gram; first is 0 in bigrams. Texts start after END."""
    start = off[:-1]
    prev = np.empty_like(h)
    prev[1:] = h[:-1]
    prev[start] = END
    yield np.zeros(len(h), np.int64), prev, h
    far = np.zeros_like(h)
    far[2:] = h[:-2]
    inside = np.ones(len(h), bool)
    inside[start] = False  # a text's first token has no third back
    second = start[np.diff(off) > 1] + 1
    far[second] = END
    yield far[inside], prev[inside], h[inside]


def _gram_hash(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = C.mix(a.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        h = C.mix(h + b.view(np.uint64) * np.uint64(0xBF58476D1CE4E5B9))
        return C.mix(h + c.view(np.uint64) * np.uint64(0x94D049BB133111EB))


def _training(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.withColumn("held_out", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 1)


class Chunk:
    """The distinct words, bigrams and trigrams of some texts, in an order that follows from the texts as a set.

    words: sorted hashes; bi: first * len(words) + second; tri: (context + 1) * len(words) + third, where
    context is a bigram's index, or -1 at a text's first token, whose history is END alone.
    """

    def __init__(self, data: np.ndarray, off: np.ndarray) -> None:
        self.words, self.word_of, self.off = coded(data, off)
        n, end = len(self.words), int(np.searchsorted(self.words, END))
        start = self.off[:-1]
        prev = np.empty_like(self.word_of)
        prev[1:] = self.word_of[:-1]
        prev[start] = end
        self.bi, self.bi_of = np.unique(prev * n + self.word_of, return_inverse=True)
        context = np.empty_like(self.bi_of)
        context[1:] = self.bi_of[:-1]
        context[start] = -1
        self.tri, self.tri_of = np.unique((context + 1) * n + self.word_of, return_inverse=True)
        self.w1, self.w2 = self.bi // n, self.bi % n
        self.context, self.w3 = self.tri // n - 1, self.tri % n
        middle = np.where(self.context < 0, end, self.w2[self.context])
        self.shorter = np.searchsorted(self.bi, middle * n + self.w3)
        self.real = np.flatnonzero(self.context >= 0)  # trigrams proper

    def gram_order(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bigrams and trigrams by bucket, and the buckets' offsets in both."""
        key = _gram_hash(np.zeros(len(self.bi), np.int64), self.words[self.w1], self.words[self.w2])
        at = (key % np.uint64(buckets)).astype(np.int64)
        two = np.argsort(at, kind="stable")
        of = at[self.context[self.real]]
        order = np.argsort(of, kind="stable")
        every = np.arange(buckets + 1)
        return two, self.real[order], np.searchsorted(at[two], every), np.searchsorted(of[order], every)

    def word_order(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        at = _word_bucket(self.words, buckets)
        order = np.argsort(at, kind="stable")
        return order, np.searchsorted(at[order], np.arange(buckets + 1))


def _word_bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return (C.mix(h.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _pack(values: np.ndarray, off: np.ndarray) -> pa.Array:
    """values[off[i]:off[i + 1]] in row i: their first bytes, then their second bytes and so on, compressed."""
    out = zstandard.ZstdCompressor(level=1)
    flat = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize)
    off = np.asarray(off).tolist()
    return pa.array([out.compress(flat[i:j].T.tobytes()) for i, j in zip(off[:-1], off[1:], strict=True)], pa.binary())


def _unpack(col: pa.ChunkedArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All rows' values one after the other, and the rows' offsets."""
    back, size = zstandard.ZstdDecompressor(), np.dtype(kind).itemsize
    rows = [np.frombuffer(back.decompress(x), np.uint8).reshape(size, -1).T for x in col.to_pylist()]
    flat = np.concatenate(rows) if rows else np.zeros((0, size), np.uint8)
    return np.ascontiguousarray(flat).reshape(-1).view(kind), np.append(0, np.cumsum([len(x) for x in rows], dtype=np.int64))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Slices of (doc_id, text, held_out) and their ids, which hold task, place and content."""
    from pyspark import TaskContext

    task = TaskContext.get().partitionId()
    for i, b in enumerate(C.slices(batches, "text", CHUNK)):
        data, off = C.text_bytes(b.column(1))
        yield (((task << 24) + i) << 20) + zlib.crc32(off.tobytes(), zlib.crc32(data.tobytes())) % (1 << 20), b


def _trained(b: pa.RecordBatch, off: np.ndarray) -> np.ndarray:
    """For each token whether its text is a training text."""
    return np.repeat(~b.column(2).to_numpy(zero_copy_only=False), np.diff(off))


def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values, a place of each, and the number of each place's value."""
    order = np.argsort(key)
    ordered = key[order]
    new = np.append(True, ordered[1:] != ordered[:-1])[: len(key)]
    of = np.empty(len(key), np.int64)
    of[order] = np.cumsum(new) - 1
    return ordered[new], order[new], of


def _ask_grams(rows: DataFrame, buckets: int, turn: int) -> DataFrame:
    """The questions to the buckets of one round, in the order of ``Chunk.gram_order``; other n-grams aren't sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = np.flatnonzero(np.arange(buckets) % ROUNDS == turn)
        for chunk, b in _chunks(batches):
            words, ids, off = coded(*C.text_bytes(b.column(1)))
            n, start, train = len(words), off[:-1], _trained(b, off)
            prev = np.empty_like(ids)
            prev[1:] = ids[:-1]
            prev[start] = np.searchsorted(words, END)
            to = (_gram_hash(np.zeros(len(ids), np.int64), words[prev], words[ids]) % np.uint64(buckets)).astype(np.int64)
            here = to % ROUNDS == turn
            sel = np.flatnonzero(here)
            bi, one, of2 = _groups(prev[sel] * n + ids[sel])
            n2 = np.bincount(of2[train[sel]], minlength=len(bi)).astype(np.int32)
            # a trigram goes with the bigram before its last word
            follows = np.append(here, False)[: len(here)]
            follows[1:], follows[:1] = here[:-1], False
            follows[start] = False
            after = np.flatnonzero(follows)
            context = np.zeros(len(ids), np.int64)
            context[sel] = of2
            tri, _, of3 = _groups(context[after - 1] * n + ids[after])
            n3 = np.bincount(of3[train[after]], minlength=len(tri)).astype(np.int32)
            of = tri // n
            follow = np.bincount(of, minlength=len(bi)).astype(np.int32)
            to = to[sel[one]]
            two, three = np.argsort(to, kind="stable"), np.argsort(to[of], kind="stable")
            at2, at3 = (np.append(0, np.cumsum(np.bincount(x, minlength=buckets)[mine])) for x in (to, to[of]))
            cols = [_pack(words[bi[two] // n], at2), _pack(words[bi[two] % n], at2), _pack(n2[two], at2), _pack(follow[two], at2), _pack(words[tri[three] % n], at3), _pack(n3[three], at3)]
            got = pa.RecordBatch.from_arrays([pa.array(mine), pa.array(np.full(len(mine), chunk)), *cols], names=["bucket", "chunk", "w1", "w2", "n2", "follow", "w3", "n3"])
            yield got.filter(pa.array(np.diff(at2) > 0))

    return rows.mapInArrow(run, "bucket long, chunk long, w1 binary, w2 binary, n2 binary, follow binary, w3 binary, n3 binary")


def _ask_words(rows: DataFrame, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, b in _chunks(batches):
            words, ids, off = coded(*C.text_bytes(b.column(1)))
            n = np.bincount(ids[_trained(b, off)], minlength=len(words)).astype(np.int32)
            at = _word_bucket(words, buckets)
            order = np.argsort(at, kind="stable")
            at = np.searchsorted(at[order], np.arange(buckets + 1))
            got = pa.RecordBatch.from_arrays([pa.array(np.arange(buckets)), pa.array(np.full(buckets, chunk)), _pack(words[order], at), _pack(n[order], at)], names=["bucket", "chunk", "w", "n"])
            yield got.filter(pa.array(np.diff(at) > 0))

    return rows.mapInArrow(run, "bucket long, chunk long, w binary, n binary")


#: kind 2: an answer on n-grams (bigram counts, mass kept of each as a context, trigram counts);
#: kind 1: an answer on words (counts, mass kept, nothing); kind 0, sent to the words' buckets: words and their mass kept.
ANSWER = "kind int, chunk long, bucket long, a binary, b binary, c binary"


def _answer(kind: int, chunk: np.ndarray, bucket: np.ndarray, *cols: pa.Array) -> pa.Table:
    cols = [*cols, *[pa.nulls(len(chunk), pa.binary())] * (3 - len(cols))]
    return pa.table([pa.array(np.full(len(chunk), kind, np.int32)), pa.array(chunk), pa.array(bucket), *cols], names=["kind", "chunk", "bucket", "a", "b", "c"])


def _sum_grams(asked: DataFrame, buckets: int) -> DataFrame:
    def run(t: pa.Table) -> pa.Table:
        (w1, at2), (w2, _), (n2, _), (follow, _) = (_unpack(t[c], k) for c, k in (("w1", np.int64), ("w2", np.int64), ("n2", np.int32), ("follow", np.int32)))
        (w3, at3), (n3, _) = _unpack(t["w3"], np.int64), _unpack(t["n3"], np.int32)
        key = _gram_hash(np.zeros(len(w1), np.int64), w1, w2)
        key, first, of2 = _groups(key)
        c2 = np.bincount(of2, n2, len(key))
        c2[c2 < LEAST] = 0
        context = np.repeat(of2, follow)
        _, one, of3 = _groups(_gram_hash(key.view(np.int64)[context], np.ones(len(w3), np.int64), w3))
        c3 = np.bincount(of3, n3, len(one))
        c3[c3 < LEAST] = 0
        mass = np.bincount(context[one], np.where(c3 > 0, c3 - DISCOUNT, 0), len(key))
        out = _answer(2, t["chunk"].to_numpy(), t["bucket"].to_numpy(), _pack(c2[of2].astype(np.uint32), at2), _pack(mass[of2], at2), _pack(c3[of3].astype(np.uint32), at3))
        kept = c2 > 0
        w, of = np.unique(w1[first[kept]], return_inverse=True)
        sums = np.bincount(of, c2[kept] - DISCOUNT, len(w))
        to = _word_bucket(w, buckets)
        o = np.argsort(to, kind="stable")
        some, n = np.unique(to, return_counts=True)
        at = np.append(0, np.cumsum(n))
        return pa.concat_tables([out, _answer(0, np.full(len(some), -1), some, _pack(w[o], at), _pack(sums[o], at))])

    return asked.groupBy("bucket").applyInArrow(run, ANSWER)


def _sum_words(asked: DataFrame, sums: DataFrame) -> DataFrame:
    def run(t: pa.Table, kept: pa.Table) -> pa.Table:
        (w, at), (n, _) = _unpack(t["w"], np.int64), _unpack(t["n"], np.int32)
        words, of = np.unique(w, return_inverse=True)
        c = np.bincount(of, n, len(words)).astype(np.int64)
        mass = np.zeros(len(words))
        np.add.at(mass, np.searchsorted(words, _unpack(kept["a"], np.int64)[0]), _unpack(kept["b"], np.float64)[0])
        out = _answer(1, t["chunk"].to_numpy(), t["bucket"].to_numpy(), _pack(c[of], at), _pack(mass[of], at))
        # of the bucket: training tokens and distinct training words
        total = _answer(0, np.array([-1]), np.asarray(t["bucket"][:1]), _pack(np.array([c.sum(), (c > 0).sum()]), np.array([0, 2])))
        return pa.concat_tables([out, total])

    return asked.groupBy("bucket").cogroup(sums.groupBy("bucket")).applyInArrow(run, ANSWER)


def _gram_rows(train: DataFrame) -> DataFrame:
    """(w1, w2, w3, c): counts, by slice, of every n-gram; w1 = 0 in bigrams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.slices(batches, "text"):
            h, off = tokens(*C.text_bytes(b.column(0)))
            for w1, w2, w3 in _grams(h, off):
                _, first, n = np.unique(_gram_hash(w1, w2, w3), return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(w1[first]), pa.array(w2[first]), pa.array(w3[first]), pa.array(n)], names=["w1", "w2", "w3", "c"])

    return train.select("text").mapInArrow(run, "w1 long, w2 long, w3 long, c long")


def _word_rows(train: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.slices(batches, "text"):
            words, n = np.unique(tokens(*C.text_bytes(b.column(0)))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(n)], names=["h", "c"])

    return train.select("text").mapInArrow(run, "h long, c long")


@dataclass
class Automaton:
    """Arrays of the automaton; state 0 is empty, word len(words) is any rarer word."""

    words: np.ndarray  # sorted hashes
    log_uni: np.ndarray  # by word; 0 for rarer words, which the join adds
    uni_next: np.ndarray
    arc_key: np.ndarray  # state * (len(words) + 1) + word, sorted
    arc_logp: np.ndarray
    arc_next: np.ndarray
    fail: np.ndarray
    backoff: np.ndarray

    def word_ids(self, h: np.ndarray) -> np.ndarray:
        i = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        return np.where(self.words[i] == h, i, len(self.words))

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Read one word in each state: log10 probability and next state."""
        state = state.copy()
        score = np.zeros(len(state))
        out = np.zeros(len(state), np.int64)
        width = len(self.words) + 1
        open_ = np.arange(len(state))
        while len(open_):
            s, w = state[open_], word[open_]
            root = s == 0
            r = open_[root]
            score[r] += self.log_uni[w[root]]
            out[r] = self.uni_next[w[root]]
            open_, s, w = open_[~root], s[~root], w[~root]
            if not len(open_):
                break
            k = s * width + w
            i = np.minimum(np.searchsorted(self.arc_key, k), len(self.arc_key) - 1)
            hit = self.arc_key[i] == k
            score[open_[hit]] += self.arc_logp[i[hit]]
            out[open_[hit]] = self.arc_next[i[hit]]
            miss = ~hit
            open_ = open_[miss]
            score[open_] += self.backoff[s[miss]]
            state[open_] = self.fail[s[miss]]
        return score, out

    def score(self, h: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability of each text (rarer words' unigrams left out), and word ids."""
        ids = self.word_ids(h)
        end_id = int(self.word_ids(np.array([END]))[0])
        first = int(self.uni_next[end_id])
        n = np.diff(off)
        parts = np.maximum(-(-n // WINDOW), 1)
        doc = np.repeat(np.arange(len(n)), parts)
        lo = off[:-1][doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)) * WINDOW
        hi = np.minimum(lo + WINDOW, off[1:][doc])
        begin = np.maximum(lo - 2, off[:-1][doc])
        state = np.where(begin == off[:-1][doc], first, 0)
        total = np.zeros(len(doc))
        order = np.argsort(begin - hi, kind="stable")  # longest first
        begin, lo, hi, state = begin[order], lo[order], hi[order], state[order]
        size = hi - begin
        live = len(size)
        for t in range(int(size[0]) if live else 0):
            while live and size[live - 1] <= t:
                live -= 1
            at = begin[:live] + t
            p, state[:live] = self.step(state[:live], ids[at])
            total[:live] += np.where(at >= lo[:live], p, 0)
        return np.bincount(doc[order], weights=total, minlength=len(n)), ids


def build(head: np.ndarray, head_count: np.ndarray, grams: np.ndarray, n: int, v: int) -> Automaton:
    """The automaton of the kept n-grams: rows (w1, w2, w3, c) of ``grams``, w1 = 0 in bigrams."""
    if END not in set(head.tolist()):
        head, head_count = np.append(head, END), np.append(head_count, 0)
    order = np.argsort(head)
    words, count = head[order], head_count[order].astype(float)
    width = len(words) + 1
    log_uni = np.append(np.log10((count + 0.5) / (n + 0.5 * (v + 1))), 0.0)
    uni = 10 ** log_uni[:-1]
    ids = np.searchsorted(words, grams[:, :3])
    bi, tri = grams[:, 0] == 0, grams[:, 0] != 0
    b1, b2, bc = ids[bi, 1], ids[bi, 2], grams[bi, 3].astype(float)
    key = b1 * width + b2
    o = np.argsort(key)
    b1, b2, bc, key = b1[o], b2[o], bc[o], key[o]
    t1, t2, t3, tc = ids[tri, 0], ids[tri, 1], ids[tri, 2], grams[tri, 3].astype(float)
    ctx = np.searchsorted(key, t1 * width + t2)  # bigram rows that are contexts
    o = np.lexsort((t3, ctx))
    t2, t3, tc, ctx = t2[o], t3[o], tc[o], ctx[o]
    # states: words with bigrams, then bigrams with trigrams
    one = np.unique(b1)
    two = np.unique(ctx)
    state_of_word = np.zeros(width, np.int64)
    state_of_word[one] = 1 + np.arange(len(one))
    state_of_gram = np.zeros(len(key) + 1, np.int64)
    state_of_gram[two] = 1 + len(one) + np.arange(len(two))
    n_states = 1 + len(one) + len(two)
    fail, backoff = np.zeros(n_states, np.int64), np.zeros(n_states)
    fail[1 + len(one) :] = state_of_word[b2[two]]

    p2 = (bc - DISCOUNT) / count[b1]
    left = 1 - np.bincount(b1, p2, width)
    backoff[1 : 1 + len(one)] = np.log10(left[one])
    p2 += left[b1] * uni[b2]
    p3 = (tc - DISCOUNT) / bc[ctx] if len(ctx) else np.zeros(0)
    shorter = np.searchsorted(key, t2 * width + t3)  # kept, as no rarer than the trigram
    left = 1 - np.bincount(ctx, p3, len(key) + 1)
    backoff[1 + len(one) :] = np.log10(left[two])
    if len(ctx):
        p3 += left[ctx] * p2[shorter]

    longest = np.where(state_of_gram[:-1] > 0, state_of_gram[:-1], state_of_word[b2])
    arc_key = np.concatenate((state_of_word[b1] * width + b2, state_of_gram[ctx] * width + t3))
    arc_p = np.log10(np.concatenate((p2, p3)))
    arc_next = np.concatenate((longest, longest[shorter])) if len(ctx) else longest
    if not len(arc_key):
        arc_key, arc_p, arc_next = np.array([-1]), np.zeros(1), np.zeros(1, np.int64)
    o = np.argsort(arc_key)
    return Automaton(words, log_uni, state_of_word, arc_key[o], arc_p[o], arc_next[o], fail, backoff)


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Automaton, int, int]:
    """For small corpora: the unigram table (h, c), the automaton, and the training tokens and distinct words."""
    train = _training(docs, id_col, text_col).where(~F.col("held_out"))
    uni = C.checkpoint(_word_rows(train).groupBy("h").agg(F.sum("c").alias("c")))
    n, v = uni.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    head = uni.toArrow()
    kept = _gram_rows(train).groupBy("w1", "w2", "w3").agg(F.sum("c").alias("c")).where(F.col("c") >= LEAST).toArrow()
    rows = np.stack([kept[c].to_numpy() for c in ("w1", "w2", "w3", "c")], 1) if kept.num_rows else np.zeros((0, 4), np.int64)
    return uni, build(head["h"].to_numpy(), head["c"].to_numpy(), rows, n, v), n, v


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Learn from the training rows and score all of them."""
    rows = _training(docs, id_col, text_col)
    size = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    buckets = max(MIN_BUCKETS, -(-size // PER_BUCKET))
    grams = rows.sparkSession.createDataFrame([], ANSWER)
    for turn in range(ROUNDS):
        grams = grams.unionByName(C.checkpoint(_sum_grams(_ask_grams(rows, buckets, turn), buckets)))
        C.free(rows.sparkSession)
    words = C.checkpoint(_sum_words(_ask_words(rows, buckets), grams.where("kind = 0").select("bucket", "a", "b")))
    C.free(rows.sparkSession)
    totals = words.where("kind = 0").select("a").toArrow()  # a row for each bucket
    n, v = (int(x) for x in _unpack(totals["a"], np.int64)[0].reshape(-1, 2).sum(0)) if totals.num_rows else (0, 0)
    answers = grams.where("kind = 2").unionByName(words.where("kind = 1"))

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, b in _chunks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, chunk)), *b.columns], names=["chunk", "doc_id", "text", "held_out"])

    def run(t: pa.Table, got: pa.Table) -> pa.Table:
        c = Chunk(*C.text_bytes(t["text"]))
        off = c.off
        two, three, _, _ = c.gram_order(buckets)
        order, _ = c.word_order(buckets)
        got = got.sort_by("bucket")
        kind = got["kind"].to_numpy()
        of_grams, of_words = got.filter(pa.array(kind == 2)), got.filter(pa.array(kind == 1))

        def put(size: int, where: np.ndarray, col: pa.ChunkedArray, dtype: type) -> np.ndarray:
            out = np.zeros(size)
            values = _unpack(col, dtype)[0]
            if len(values) != len(where):
                raise ValueError("the texts were dealt otherwise when they were read again")
            out[where] = values
            return out

        c1, mass1 = put(len(c.words), order, of_words["a"], np.int64), put(len(c.words), order, of_words["b"], np.float64)
        c2, mass2 = put(len(c.bi), two, of_grams["a"], np.uint32), put(len(c.bi), two, of_grams["b"], np.float64)
        c3 = put(len(c.tri), three, of_grams["c"], np.uint32)
        uni = (c1 + 0.5) / (n + 0.5 * (v + 1))
        m1, m2 = c1[c.w1], np.maximum(c2, 1)
        p2 = np.where(c2 > 0, c2 - DISCOUNT, 0) / np.maximum(m1, 1) + (1 - mass1[c.w1] / np.maximum(m1, 1)) * uni[c.w2]
        ctx = np.maximum(c.context, 0)
        p3 = np.where(c3 > 0, c3 - DISCOUNT, 0) / m2[ctx] + (1 - mass2[ctx] / m2[ctx]) * p2[c.shorter]
        p = np.log10(np.where(c.context < 0, p2[c.shorter], p3))
        size, text = len(off) - 1, np.repeat(np.arange(len(off) - 1), np.diff(off))
        base = np.bincount(text, np.log10(uni)[c.word_of], size)
        total = np.bincount(text, p[c.tri_of], size)
        cols = [t["doc_id"], t["held_out"], pa.array(np.diff(off)), pa.array(C.seg_sum(c1[c.word_of] > 0, off)), pa.array(np.full(size, n)), pa.array(base), pa.array(total)]
        return pa.table(cols, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return rows.mapInArrow(texts, "chunk long, doc_id long, text string, held_out boolean").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, schema)


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(C.table(spark, sf_dir, "documents"))
