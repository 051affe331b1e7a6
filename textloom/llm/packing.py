"""Operator 2: packing along a space-filling curve.

Each document's tokens form a hashed count vector; a random-sign projection takes
it to ``DIMS`` numbers, each squashed to ``BITS`` bits, and their Hilbert index is
the document's key.  Documents are range-sorted by (key, hash of id, id), so equal
keys split freely over tasks, and neighbours along the curve are laid end to end
into sequences of ``SEQUENCE`` tokens, cut where a sequence is full.  What is left
at a task's end goes into sequences whose lengths are its binary digits, powers of
two that need no padding.

Ids are made once, checkpointed as bytes and shuffled once.  Sequence numbers hold
the task's number in the upper bits, so tasks need no common counter.

Defined cases: null text is empty and packs its end token alone; repeated rows are
packed once each; a null id stays null; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import common as C

SEQUENCE = 4096
END = 2
DIMS, BITS, BUCKETS = 4, 12, 1024
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Most words kept between slices.
CACHE = 600_000
#: Text bytes of a slice: the larger, the fewer distinct words in all.
SLICE_BYTES = 4 << 20
#: ASCII marks that the tokenizer never joins to a letter or digit before them.
MARKS = b".,!?$%&*#|;:()"


class WordCoder:
    """Ids by a tokenizer that drops white space and case, so each word is encoded alone.

    Words met before are found by their hash; of new ones the lower-cased part
    before trailing marks is encoded, once for all the words that share it.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.parts: dict[bytes, list[int]] = {}
        self.keys = np.zeros(0, np.uint64)
        self.starts = np.zeros(0, np.int64)
        self.lens = self.flat = np.zeros(0, np.int32)

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word, by its parts."""
        split = []
        for w in words:
            low = w.lower()
            core = low.rstrip(MARKS)
            if len(core) < len(low) and core and (core[-1:].isalnum() or core[-1] >= 0x80 and core.decode("utf-8")[-1].isalpha()):
                split.append((core, low[len(core) :]))
            else:
                split.append((low, b""))
        if len(self.parts) + len(words) > CACHE * 2 // 3:
            self.parts = {}
        parts = self.parts
        new = list(dict.fromkeys(x for pair in split for x in pair if x not in parts))
        for k in range(0, len(new), 20_000):
            some = new[k : k + 20_000]
            for x, e in zip(some, self.tokenizer.encode_batch_fast([x.decode("utf-8") for x in some], add_special_tokens=False), strict=True):
                parts[x] = e.ids
        return [parts[a] + parts[b] if b else parts[a] for a, b in split]

    def lookup(self, vocab: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Start and length, in ``flat``, of the ids of each distinct word."""
        h = C.hash_binary(vocab)
        at = np.minimum(np.searchsorted(self.keys, h), max(len(self.keys) - 1, 0))
        hit = self.keys[at] == h if len(self.keys) else np.zeros(len(h), bool)
        if hit.all():
            return self.starts[at], self.lens[at]
        if len(self.keys) + (~hit).sum() > CACHE:  # keep what this slice uses
            keep = np.unique(at[hit])
            self.flat = self.flat[C.ragged(self.starts[keep], self.lens[keep])]
            self.keys, self.lens = self.keys[keep], self.lens[keep]
            self.starts = np.cumsum(self.lens, dtype=np.int64) - self.lens
        ids = self.encode_words(vocab.filter(pa.array(~hit)).to_pylist())
        lens = np.fromiter(map(len, ids), np.int32, len(ids))
        flat = np.fromiter(itertools.chain.from_iterable(ids), np.int32, int(lens.sum()))
        keys = np.concatenate((self.keys, h[~hit]))
        order = np.argsort(keys)
        self.keys = keys[order]
        self.starts = np.concatenate((self.starts, len(self.flat) + np.cumsum(lens, dtype=np.int64) - lens))[order]
        self.lens = np.concatenate((self.lens, lens))[order]
        self.flat = np.concatenate((self.flat, flat))
        at = np.searchsorted(self.keys, h)
        return self.starts[at], self.lens[at]

    def encode(self, data: np.ndarray, off: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by ``end``, and the texts' offsets."""
        w = C.Words(data, off)
        words, bounds, vocab = w.ids, w.offsets, w.vocab
        del w  # its byte masks and spans are larger than what follows
        starts, lens = self.lookup(vocab)
        # the end token is one more word of each text
        n_ids = np.insert(lens[words], bounds[1:], 1)
        starts = np.insert(starts[words], bounds[1:], 0)
        del words
        ends = np.append(0, np.cumsum(n_ids, dtype=np.int64))[bounds + np.arange(len(off))]
        ids = self.flat[C.ragged(starts, n_ids)] if len(self.flat) else np.zeros(int(n_ids.sum()), np.int32)
        ids[ends[1:] - 1] = end
        return ids, ends


_CODERS: dict[str, WordCoder] = {}


def coder(path: str) -> WordCoder:
    if path not in _CODERS:
        _CODERS[path] = WordCoder(path)
    return _CODERS[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def projection(size: int, dims: int = DIMS, buckets: int = BUCKETS) -> np.ndarray:
    """Signs of each token's hash bucket in every dimension."""
    signs = np.random.Generator(np.random.PCG64(7)).integers(0, 2, (buckets, dims)) * 2 - 1
    return signs[C.mix(np.arange(size, dtype=np.uint64)) % np.uint64(buckets)].astype(np.int64)


def hilbert(x: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of points with integer coordinates below 2**bits, one per row.

    The transposed form of Skilling, "Programming the Hilbert curve" (2004).
    """
    x = [x[:, i].astype(np.int64) for i in range(x.shape[1])]
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            hit = (x[i] & q) > 0
            t = np.where(hit, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(hit, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] = x[i] ^ t
        q >>= 1
    for i in range(1, n):
        x[i] = x[i] ^ x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) > 0, t ^ (q - 1), t)
        q >>= 1
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | (((x[i] ^ t) >> b) & 1)
    return key


def curve_keys(ids: np.ndarray, off: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Hilbert key of each document."""
    n = np.maximum(np.diff(off), 1)
    v = np.stack([C.seg_sum(table[ids, d], off) for d in range(table.shape[1])], 1) / np.sqrt(n)[:, None]
    return hilbert(np.minimum((np.tanh(v / 4) + 1) / 2 * (1 << BITS), (1 << BITS) - 1).astype(np.int64), BITS)


def tokenized(docs: DataFrame, id_col: str, text_col: str, path: str, end: int) -> DataFrame:
    """doc_id, key, tie and the ids as little-endian bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        signs = projection(own.size)
        width = "<u2" if max(own.size, end + 1) <= 1 << 16 else "<u4"
        for b in C.slices(batches, "text", SLICE_BYTES):
            ids, off = own.encode(*C.text_bytes(b.column(1)), end)
            size = np.dtype(width).itemsize
            data = C.binary_array(ids.astype(width).view(np.uint8), np.diff(off) * size)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(curve_keys(ids, off, signs)), pa.array(np.diff(off)), data], names=["doc_id", "key", "n", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(C.trimmed(run), "doc_id long, key long, n long, ids binary")


def lay_out(doc_ids: list, starts: np.ndarray, totals: np.ndarray, ids: np.ndarray, off: np.ndarray, cuts: np.ndarray) -> dict[str, list]:
    """Cut segments laid end to end at ``cuts`` (sequence bounds, from 0) and describe the pieces."""
    lo = np.unique(np.concatenate((off[:-1], cuts[:-1])))
    hi = np.append(lo[1:], cuts[-1])
    seg = np.searchsorted(off, lo, "right") - 1
    seq = np.searchsorted(cuts, lo, "right") - 1
    raw = np.ascontiguousarray(ids.astype("<u4")).view(np.uint8)
    crc = [zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(lo.tolist(), hi.tolist(), strict=True)]
    return {"doc_id": [doc_ids[i] for i in seg.tolist()], "start": starts[seg] + lo - off[seg], "length": hi - lo, "ids_crc32": crc, "doc_tokens": totals[seg], "sequence": seq, "offset": lo - cuts[seq]}


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, sequence: int = SEQUENCE, end: int = END) -> DataFrame:
    """One row per piece of a document in a sequence."""
    if sequence & (sequence - 1):
        raise ValueError("sequence must be a power of two")
    spark = docs.sparkSession
    coded = C.checkpoint(tokenized(docs, id_col, text_col, tokenizer or default_tokenizer(), end))
    tie = F.xxhash64("doc_id", F.lit(17))
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = coded.withColumn("tie", tie).repartitionByRange(n_parts, "key", "tie").sortWithinPartitions("key", "tie", "doc_id", "ids").select("doc_id", "n", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        made = 0
        # the tail: segments of the sequence that is not full yet
        held: tuple[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray] = ([], np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))

        def emit(p: dict) -> pa.RecordBatch:
            cols = [pa.array(p["doc_id"], pa.int64()), *(pa.array(np.asarray(p[k], np.int64)) for k in ("start", "length", "ids_crc32", "doc_tokens")), pa.array(base + made + p["sequence"]), pa.array(np.asarray(p["offset"], np.int64))]
            return pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for b in C.slices(batches, "ids", C.BATCH_BYTES // 2):
            n = b.column(1).to_numpy(zero_copy_only=False)
            raw, byte_off = C.text_bytes(b.column(2))
            size = int(byte_off[-1] // n.sum())
            got = np.ascontiguousarray(raw).view(f"<u{size}")
            doc_ids = held[0] + b.column(0).to_pylist()
            starts = np.append(held[1], np.zeros(len(n), np.int64))
            totals, lens = np.append(held[2], n), np.append(held[3], n)
            ids = np.append(held[4].astype(got.dtype), got)
            off = np.append(0, np.cumsum(lens))
            full = len(ids) // sequence * sequence
            if full:
                last = int(np.searchsorted(off, full, "left"))  # segments before it hold the full sequences
                part = np.append(off[:last], full)
                yield emit(lay_out(doc_ids[:last], starts, totals, ids[:full], part, np.arange(0, full + 1, sequence)))
                made += full // sequence
                first = int(np.searchsorted(off, full, "right")) - 1
                doc_ids, totals = doc_ids[first:], totals[first:]
                starts, lens = starts[first:].copy(), lens[first:].copy()
                if len(lens):
                    used = full - off[first]
                    starts[0] += used
                    lens[0] -= used
                ids = ids[full:].copy()
            held = (doc_ids, starts, totals, lens, ids)
        rest = len(held[4])
        if rest:
            digits = [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]
            yield emit(lay_out(held[0], held[1], held[2], held[4], np.append(0, np.cumsum(held[3])), np.append(0, np.cumsum(digits))))

    return ordered.mapInArrow(C.trimmed(run), SCHEMA)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(C.table(spark, sf_dir, "documents"))
