"""Operator 5: byte-level BPE encoding and decoding with a segment tree.

A text is cut at ``PATTERN`` into pieces; a piece that is a token stays one,
else its bytes are merged.  A segment tree over the piece's byte positions holds,
at each live position, the rank of the pair that starts there; inner nodes keep
the leftmost minimum, so the root names the next merge.  A merge is three point
updates (the merged position, its dead right neighbour, its live left one), each
walking to the root.  Short pieces are merged many at a time, one tree per row
of a matrix; long ones by the same tree alone.

Texts are cut into whitespace-led chunks first and each distinct chunk of a slice
is encoded once; a bounded cache keeps chunks between slices.  No shuffle.

Defined cases: null is the empty text (no ids, hashes of nothing); repeated rows
repeat; other columns are ignored; a text without white space is one chunk.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import common as C

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
INF = np.int64(1) << 60
#: Longest piece, in bytes, that is merged in the matrix.
ROW_BYTES = 32
#: Most chunks kept between slices.
CACHE = 300_000
#: Unicode White_Space, as the \\s of the tokenizer's regular expressions.
WHITE = r"\t-\r \u0085   -     　"


class Codec:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str, pattern: str) -> None:
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(pattern.replace(r"[^\s", "[^" + WHITE).replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]"))
        #: a space and the ASCII letters after it are one match
        self.joins_letters = self.pattern.findall(" abcXYZ") == [" abcXYZ"]
        ranks = self.ranks
        self.byte_id = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        pairs: dict[int, int] = {}
        self.width = max(ranks.values()) + 1
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    pairs[a * self.width + b] = rank
        self.pairs = pairs
        keys = np.fromiter(pairs.keys(), np.int64, len(pairs))
        order = np.argsort(keys)
        self.keys, self.values = keys[order], np.fromiter(pairs.values(), np.int64, len(pairs))[order]
        by_id = [b""] * self.width
        for token, rank in ranks.items():
            by_id[rank] = token
        self.token_len = np.array([len(t) for t in by_id], np.int64)
        self.token_start = np.cumsum(self.token_len) - self.token_len
        self.token_bytes = np.frombuffer(b"".join(by_id), np.uint8)
        self.cache: dict[bytes, tuple[int, ...]] = {}
        self.older: dict[bytes, tuple[int, ...]] = {}

    # -- merging ---------------------------------------------------------
    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, INF where there is none."""
        k = a * self.width + b
        i = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
        return np.where((self.keys[i] == k) & (a >= 0) & (b >= 0), self.values[i], INF)

    def merge_rows(self, pieces: list[bytes], size: int) -> list[tuple[int, ...]]:
        """Encode pieces of at most ``size`` (a power of two) bytes, a segment tree per row."""
        n = len(pieces)
        lens = np.fromiter(map(len, pieces), np.int64, n)
        at = np.arange(size)
        live = at < lens[:, None]
        sym = np.full((n, size + 1), -1, np.int64)
        sym[:, :size][live] = self.byte_id[np.frombuffer(b"".join(pieces), np.uint8)]
        nxt = np.broadcast_to(np.append(np.minimum(at + 1, size), size), (n, size + 1)).copy()
        prv = np.broadcast_to(np.append(at - 1, size), (n, size + 1)).copy()
        prv[:, 0] = size
        tree = np.full((n, 2 * size), INF, np.int64)
        rank = self.pair_rank(sym[:, :-1], sym[:, 1:])
        tree[:, size:] = np.where(rank < INF, rank * size + at, INF)
        s = size // 2
        while s:
            tree[:, s : 2 * s] = np.minimum(tree[:, 2 * s : 4 * s : 2], tree[:, 2 * s + 1 : 4 * s : 2])
            s //= 2
        dead = np.zeros((n, size), bool)
        row = np.flatnonzero(tree[:, 1] < INF)

        def put(r: np.ndarray, p: np.ndarray, value: np.ndarray) -> None:
            i = p + size
            tree[r, i] = value
            i = i >> 1
            while i[0]:
                tree[r, i] = np.minimum(tree[r, 2 * i], tree[r, 2 * i + 1])
                i = i >> 1

        while len(row):
            rank, p = np.divmod(tree[row, 1], size)
            q = nxt[row, p]
            r = nxt[row, q]
            sym[row, p] = rank
            nxt[row, p] = r
            prv[row, r] = p
            dead[row, q] = True
            put(row, q, np.full(len(row), INF))
            k = self.pair_rank(rank, sym[row, r])
            put(row, p, np.where(k < INF, k * size + p, INF))
            left = prv[row, p]
            has = left < size
            if has.any():
                rr, ll = row[has], left[has]
                k = self.pair_rank(sym[rr, ll], rank[has])
                put(rr, ll, np.where(k < INF, k * size + ll, INF))
            row = row[tree[row, 1] < INF]
        stay = live & ~dead
        flat = sym[:, :size][stay].tolist()
        ends = np.cumsum(stay.sum(1)).tolist()
        return [tuple(flat[i:j]) for i, j in zip([0, *ends[:-1]], ends, strict=True)]

    def merge_one(self, piece: bytes) -> tuple[int, ...]:
        """Encode a long piece with its own segment tree."""
        n = len(piece)
        size = 1 << max(1, (n - 1).bit_length())
        sym: list[int] = self.byte_id[np.frombuffer(piece, np.uint8)].tolist()
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        pairs, width, inf = self.pairs, self.width, int(INF)
        tree = [inf] * (2 * size)

        def key(p: int, q: int) -> int:
            r = pairs.get(sym[p] * width + sym[q]) if q < n else None
            return inf if r is None else r * size + p

        for p in range(n - 1):
            tree[size + p] = key(p, p + 1)
        for i in range(size - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

        def put(p: int, value: int) -> None:
            i = size + p
            tree[i] = value
            i >>= 1
            while i:
                tree[i] = min(tree[2 * i], tree[2 * i + 1])
                i >>= 1

        while tree[1] < inf:
            rank, p = divmod(tree[1], size)
            q = nxt[p]
            sym[p], nxt[p] = rank, nxt[q]
            if nxt[q] < n:
                prv[nxt[q]] = p
            put(q, inf)
            put(p, key(p, nxt[p]))
            if prv[p] >= 0:
                put(prv[p], key(prv[p], p))
        out, p = [], 0
        while p < n:
            out.append(sym[p])
            p = nxt[p]
        return tuple(out)

    def encode_pieces(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of each piece."""
        out: list[tuple[int, ...]] = [()] * len(pieces)
        groups: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            rank = self.ranks.get(piece)
            if rank is not None:
                out[i] = (rank,)
            elif len(piece) > ROW_BYTES:
                out[i] = self.merge_one(piece)
            else:
                groups.setdefault(1 << (len(piece) - 1).bit_length(), []).append(i)
        for size, at in groups.items():
            for k in range(0, len(at), 50_000):
                part = at[k : k + 50_000]
                for i, ids in zip(part, self.merge_rows([pieces[i] for i in part], size), strict=True):
                    out[i] = ids
        return out

    # -- texts -----------------------------------------------------------
    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the texts' offsets in them."""
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(len(off), np.int64)
        starts = chunk_starts(data, off)
        coded = C.binary_array(data, np.diff(np.append(starts, len(data)))).dictionary_encode()
        chunks: list[bytes] = coded.dictionary.to_pylist()
        got = self.lookup(chunks)
        lens = np.fromiter(map(len, got), np.int64, len(got))
        flat = np.fromiter((x for g in got for x in g), np.int64, int(lens.sum()))
        inverse = coded.indices.to_numpy(zero_copy_only=False)
        n_ids = lens[inverse]
        ends = np.append(0, np.cumsum(n_ids))
        return flat[C.ragged((np.cumsum(lens) - lens)[inverse], n_ids)], ends[np.searchsorted(starts, off)]

    def lookup(self, chunks: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of each distinct chunk, from the two generations of the cache or made anew."""
        if len(self.cache) + len(chunks) > CACHE:
            self.older, self.cache = self.cache, {}
        cache, older = self.cache, self.older
        for c in chunks:
            if c not in cache and c in older:
                cache[c] = older[c]
        new = [c for c in chunks if c not in cache]
        if new:
            plain = [self.joins_letters and c[:1] == b" " and c[1:].isalpha() for c in new]
            split = [(c,) if p else [x.encode("utf-8") for x in self.pattern.findall(c.decode("utf-8"))] for c, p in zip(new, plain, strict=True)]
            pieces = list(dict.fromkeys(p for s in split for p in s))
            ids = dict(zip(pieces, self.encode_pieces(pieces), strict=True))
            for c, s in zip(new, split, strict=True):
                cache[c] = ids[s[0]] if len(s) == 1 else tuple(x for p in s for x in ids[p])
        return [cache[c] for c in chunks]

    def decode(self, ids: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts and their offsets."""
        lens = self.token_len[ids]
        ends = np.append(0, np.cumsum(lens))
        return self.token_bytes[C.ragged(self.token_start[ids], lens)], ends[off]


def chunk_starts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where texts and runs of white space begin; no match of the pattern crosses these."""
    white = ~C.IS_WORD[data]
    start = white.copy()
    start[1:] &= ~white[:-1]
    if (data >= 0xC2).any():  # a run may begin with white space outside ASCII
        d = np.concatenate((np.zeros(3, np.uint8), data))
        a, b, c = d[:-3], d[1:-2], d[2:-1]
        wide = (b == 0xC2) & ((c == 0x85) | (c == 0xA0)) | (a == 0xE1) & (b == 0x9A) & (c == 0x80)
        wide |= (a == 0xE2) & ((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)) | (b == 0x81) & (c == 0x9F)) | (a == 0xE3) & (b == 0x80) & (c == 0x80)
        start &= ~wide
    start[off[:-1][off[:-1] < off[1:]]] = True
    return np.flatnonzero(start)


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, ids array<int>: the general encoder."""
    path, pattern = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.slices(batches, "text"):
            ids, at = codec(path, pattern).encode(*C.text_bytes(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {dict(docs.dtypes)[id_col]}, ids array<int>")


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """Encode, decode and digest every text."""
    path, pattern = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for b in C.slices(batches, "text"):
            ids, at = own.encode(*C.text_bytes(b.column(1)))
            back, bytes_at = own.decode(ids, at)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(at), pa.int64()), pa.array(sha256s(ids.astype("<u4"), at)), pa.array(sha256s(back, bytes_at))], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)


def sha256s(values: np.ndarray, off: np.ndarray) -> list[str]:
    values, off = np.ascontiguousarray(values), off.tolist()
    return [hashlib.sha256(values[i:j]).hexdigest() for i, j in zip(off[:-1], off[1:], strict=True)]


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(C.table(spark, sf_dir, "documents"))
