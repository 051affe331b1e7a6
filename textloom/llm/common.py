"""Shared vectorised text plumbing of the training-data operators.

Words are maximal runs of ``[^\\x20\\x09-\\x0D]`` everywhere.  All separators are
single ASCII bytes, so words are found on the UTF-8 bytes directly, for a whole
Arrow batch at once: no per-document Python loop touches the text.
"""

from __future__ import annotations

import ctypes
import gc
import os
import time
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

IS_WORD = np.ones(256, dtype=bool)
IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
#: A-Z to a-z on bytes; all other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: Bytes that begin a code point (not UTF-8 continuation bytes).
IS_HEAD = (np.arange(256) & 0xC0) != 0x80

#: Text bytes handled at once by the vectorised operators; bounds a worker's memory.
BATCH_BYTES = 4 << 20
#: Most rows of a table that is broadcast; rows are a few numbers each.
MAX_BROADCAST = 1_000_000
#: Seconds after which the driver's JVM knows of the objects that its Python has dropped: the bridge passes them on each second.
LET_GO = 1.2

_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE_KEY = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver found it."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in have:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, have)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the driver's folder, read by Spark only (any Hadoop path works)."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; where it is unset, a local one if all runs on this machine."""
    sc = spark.sparkContext
    have = sc._jsc.sc().getCheckpointDir()
    if have.isDefined():
        return have.get()
    conf = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        import tempfile

        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")

        conf = tempfile.mkdtemp(prefix="textloom-checkpoints-")
    sc.setCheckpointDir(conf)
    return sc._jsc.sc().getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def few(df: DataFrame, limit: int = MAX_BROADCAST) -> DataFrame:
    """``df``, marked for a broadcast if it has no more rows than ``limit``; larger ones are joined by a shuffle.

    The rows are counted, so ``df`` should be a checkpoint or as cheap.
    """
    return F.broadcast(df) if df.count() <= limit else df


def free(spark: SparkSession) -> None:
    """Let go of the shuffle files of phases that a checkpoint has replaced.

    Spark deletes them when the driver collects the plans that made them, which may be
    long after the phase; a large job would hold all its phases' files until then.
    """
    for _ in range(2):  # some plans are let go by what others leave behind
        gc.collect()
        time.sleep(LET_GO)
        spark.sparkContext._jvm.System.gc()


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (the public splitmix64 finaliser)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def slices(batches: Iterator[pa.RecordBatch], text_col: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about ``limit`` bytes of text (one row at least)."""
    for b in batches:
        if not b.num_rows:
            continue
        col = b.column(b.schema.get_field_index(text_col))
        size = np.cumsum(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False))
        i = 0
        while i < b.num_rows:
            before = size[i - 1] if i else 0
            j = max(i + 1, int(np.searchsorted(size, before + limit, "right")))
            yield b.slice(i, j - i)
            i = j


def trim() -> None:
    """Give memory that this process has freed back to the system."""
    pa.default_memory_pool().release_unused()
    give = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if give is not None:
        give(0)


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which its worker gives its memory back; Spark keeps idle workers while the executor goes on."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trim()

    return whole


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and int64 offsets (n + 1, from 0); null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, b"" if pa.types.is_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    off = np.frombuffer(col.buffers()[1], dtype=np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buf = col.buffers()[2]
    data = np.frombuffer(buf, dtype=np.uint8)[off[0] : off[-1]] if buf is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, off - off[0]


def seg_sum(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values[offsets[i]:offsets[i + 1]] (int64), right for empty segments too."""
    c = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=c[1:])
    return c[offsets[1:]] - c[offsets[:-1]]


def seg_reduce(op: np.ufunc, values: np.ndarray, offsets: np.ndarray, empty) -> np.ndarray:
    """op.reduce over each segment; ``empty`` where a segment has no value."""
    out = np.full(len(offsets) - 1, empty, dtype=values.dtype)
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    if len(full):
        out[full] = op.reduceat(values, offsets[:-1][full])
    return out


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of every segment, one after the other."""
    total = int(lens.sum())
    if not total:
        return np.zeros(0, np.int64)
    out_start = np.cumsum(lens) - lens
    return np.arange(total, dtype=np.int64) + np.repeat(starts - out_start, lens)


class Words:
    """The words of a batch of texts.

    starts, ends: byte spans; offsets: word offsets of the texts (n + 1);
    ids: batch-wide dense word ids (exact, by value); vocab: the distinct words.
    """

    def __init__(self, data: np.ndarray, text_offsets: np.ndarray, encode: bool = True, inside: np.ndarray = IS_WORD) -> None:
        self.data, self.text_offsets = data, text_offsets
        inside = inside[data]
        self.inside = inside
        start, end = inside.copy(), inside.copy()
        if len(inside):
            start[1:] &= ~inside[:-1]
            end[:-1] &= ~inside[1:]
            first = text_offsets[:-1][text_offsets[:-1] < text_offsets[1:]]
            start[first] = inside[first]
            end[first[1:] - 1] = inside[first[1:] - 1]
        self.starts = np.flatnonzero(start)
        self.ends = np.flatnonzero(end) + 1
        self.offsets = np.searchsorted(self.starts, text_offsets)
        self.counts = np.diff(self.offsets)
        if encode:
            words = binary_array(data[inside], self.ends - self.starts)
            coded = words.dictionary_encode()
            self.ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            self.vocab = coded.dictionary

    def docs(self) -> np.ndarray:
        """The text's number of every word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self) -> np.ndarray:
        """Stable 64-bit hash of every word."""
        return hash_binary(self.vocab)[self.ids] if len(self.ids) else np.zeros(0, np.uint64)


def binary_array(data: np.ndarray, lens: np.ndarray) -> pa.Array:
    """A binary Arrow array over contiguous bytes."""
    off = np.zeros(len(lens) + 1, dtype=np.int64)
    np.cumsum(lens, out=off[1:])
    return pa.Array.from_buffers(pa.binary(), len(lens), [None, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        with np.errstate(over="ignore"):
            _POWERS = np.cumprod(np.full(1 << max(10, (n - 1).bit_length()), _BASE, np.uint64)) ^ np.uint64(0x5851F42D4C957F2C)
            _POWERS |= np.uint64(1)
    return _POWERS


def hash_binary(values: pa.Array) -> np.ndarray:
    """64-bit multilinear hash of each binary value; the same on every worker."""
    data, off = text_bytes(values)
    lens = np.diff(off)
    if not len(lens):
        return np.zeros(0, np.uint64)
    at = np.arange(len(data)) - np.repeat(off[:-1], lens)
    with np.errstate(over="ignore"):
        terms = _BYTE_KEY[data] * _powers(int(lens.max()) + 1)[at]
        return mix(seg_reduce(np.add, terms, off, 0) + lens.astype(np.uint64) * _BASE)


def signed(h: np.ndarray) -> np.ndarray:
    """Hashes as Spark's long."""
    return h.astype(np.uint64, copy=False).view(np.int64)
