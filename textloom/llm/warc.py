"""Operator 4: WARC archives with a two-level capture index.

Writing.  Payload digests are grouped to find repeats; each task then appends one
gzip member per record to an archive of its own in the shared folder.  Records
with a payload of at least ``MIN_REVISIT`` bytes that equals another's are revisits
of the one with the largest id, and carry no payload.

Index.  Captures (reversed-host URL key, id, place) are range-sorted and each task
writes its run of lines as compressed blocks of ``BLOCK_LINES`` lines, with a block
directory beside it: first key, offset and length of every block.  The driver sees
one row per task, the first key and the names, which is the index's upper level.

Reading.  A lookup binary-searches the upper level for the run, the run's directory
for the block, and the decompressed block for the capture, then range-reads the
record.  Lookups are sorted like the index, so each task opens neighbouring blocks
and keeps the last few; a revisit is resolved through the index too.

Files are opened by URI with Arrow's file systems (local, HDFS, S3, GCS); names end
in a random suffix, so a repeated task writes files of its own and only those that
it reports are read.  Reports are checkpointed before anything is read back.

Defined cases: null html is an empty payload; a null url is the empty URL; payloads
under MIN_REVISIT bytes are always responses; rows of one page_id with one payload are
each written and numbered, so each is looked up.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import itertools
import re
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm import common as C

MIN_REVISIT = 1000
BLOCK_LINES = 256
#: Most repeated payloads that are broadcast, a digest and a URL each.
MAX_GROUPS = 200_000
#: Decompressed blocks, and open files, that a reader keeps.
KEPT_BLOCKS, KEPT_FILES = 64, 32
DATE = "2020-01-01T00:00:00Z"
SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def clean_url(url: str) -> str:
    """Control characters percent-encoded, as they can't stand in a header."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def url_key(url: str) -> str:
    """Reversed-host key: com,example)/path?query, lower-cased host, no scheme or user."""
    try:
        u = urlsplit(url.strip())
        host = (u.hostname or "").split(".")
        port = f":{u.port}" if u.port else ""
    except ValueError:
        return re.sub(r"[\x00-\x20]", "", url)
    path = u.path or "/"
    key = ",".join(reversed(host)) + port + ")" + path + (f"?{u.query}" if u.query else "")
    return re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", key)


def _sort_key(key: str, page_id: int | None, ordinal: int) -> tuple:
    return key, -1 << 63 if page_id is None else page_id, ordinal


def record(page_id: int | None, url: str, payload: bytes, digest: str, kind: str, refers: tuple[int, str] | None) -> bytes:
    """One WARC/1.1 record, uncompressed."""
    name = "null" if page_id is None else str(page_id)
    head = [b"WARC/1.1", f"WARC-Type: {kind}".encode(), f"WARC-Record-ID: <urn:x-page:{name}>".encode(), f"WARC-Date: {DATE}".encode(), f"WARC-Target-URI: {url}".encode("utf-8"), f"WARC-Payload-Digest: sha1:{digest}".encode()]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if kind == "revisit":
        head += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:x-page:{refers[0]}>".encode(), f"WARC-Refers-To-Target-URI: {refers[1]}".encode("utf-8")]
        body = http
    else:
        body = http + payload
    head += [b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(body)]
    return b"\r\n".join(head) + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one record."""
    head, rest = data.split(b"\r\n\r\n", 1)
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    body = rest[: int(fields["Content-Length"])]
    return fields, body.split(b"\r\n\r\n", 1)[1]


class Files:
    """Range reads of files by URI; the last few stay open."""

    def __init__(self) -> None:
        self.open: OrderedDict = OrderedDict()

    def read(self, uri: str, offset: int, length: int) -> bytes:
        f = self.open.get(uri)
        if f is None:
            fs, path = pa.fs.FileSystem.from_uri(uri)
            f = self.open[uri] = fs.open_input_file(path)
            if len(self.open) > KEPT_FILES:
                self.open.popitem(last=False)[1].close()
        self.open.move_to_end(uri)
        return f.read_at(length, offset)


class Index:
    """Lookups in the two-level index. runs: (first key, uri, directory offset, directory length), sorted."""

    def __init__(self, runs: list[tuple]) -> None:
        self.runs = runs
        self.firsts = [r[0] for r in runs]
        self.files = Files()
        self.directories: OrderedDict = OrderedDict()
        self.blocks: OrderedDict = OrderedDict()

    def _kept(self, kept: OrderedDict, key: tuple, make) -> list:
        if key not in kept:
            kept[key] = make()
            if len(kept) > KEPT_BLOCKS:
                kept.popitem(last=False)
        kept.move_to_end(key)
        return kept[key]

    def find(self, key: str, page_id: int | None, ordinal: int) -> tuple[str, int, int]:
        """Archive, offset and length of a capture."""
        want = _sort_key(key, page_id, ordinal)
        r = bisect.bisect_right(self.firsts, want) - 1
        if r < 0:
            raise KeyError(want)
        _, uri, at, size = self.runs[r]

        def directory() -> tuple:
            rows = [x.split("\t") for x in zlib.decompress(self.files.read(uri, at, size)).decode("utf-8").split("\n")]
            return [_sort_key(k, None if i == "" else int(i), int(o)) for k, i, o, _, _ in rows], [(int(a), int(b)) for *_, a, b in rows]

        firsts, places = self._kept(self.directories, (uri,), directory)
        b = bisect.bisect_right(firsts, want) - 1
        if b < 0:
            raise KeyError(want)

        def block() -> tuple:
            rows = [x.split("\t") for x in zlib.decompress(self.files.read(uri, *places[b])).decode("utf-8").split("\n")]
            return [_sort_key(k, None if i == "" else int(i), int(o)) for k, i, o, *_ in rows], [(f, int(x), int(y)) for _, _, _, f, x, y in rows]

        keys, captures = self._kept(self.blocks, (uri, b), block)
        i = bisect.bisect_left(keys, want)
        if i == len(keys) or keys[i] != want:
            raise KeyError(want)
        return captures[i]


def _planned(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """page_id, url, html, digest, size, refers, refers_url: refers is null for responses."""
    html = F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), html.alias("html"))
    rows = rows.withColumn("digest", F.sha1("html")).withColumn("size", F.length("html").cast("long"))
    # one row per repeated payload; only digests are shuffled
    groups = rows.where(F.col("size") >= MIN_REVISIT).groupBy("digest", "size").agg(F.max(F.struct("page_id", "url")).alias("last"), F.count("*").alias("n")).where("n > 1 and last.page_id is not null")
    groups = groups.select("digest", "size", F.col("last.page_id").alias("refers"), F.col("last.url").alias("refers_url"))
    # few repeats go to the pages, and no html moves; with many, larger partitions of the join are split by adaptive execution
    rows = rows.join(C.few(C.checkpoint(groups), MAX_GROUPS), ["digest", "size"], "left")
    mine = F.col("page_id") == F.col("refers")
    return rows.select("page_id", "url", "html", "digest", F.when(~F.coalesce(mine, F.lit(False)), F.col("refers")).alias("refers"), F.when(~F.coalesce(mine, F.lit(False)), F.col("refers_url")).alias("refers_url"))


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write archives; (key, page_id, ordinal, file, offset, length), checkpointed."""
    schema = "key string, page_id long, ordinal long, file string, offset long, length long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, uri, at = None, f"{folder}/{uuid.uuid4().hex}.warc.gz", 0
        for b in C.slices(batches, "html"):
            if out is None:
                fs, path = pa.fs.FileSystem.from_uri(uri)
                fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
                out = fs.open_output_stream(path, compression=None)
            got: list[list] = [[], [], [], []]
            for page_id, url, html, digest, refers, refers_url in zip(*(c.to_pylist() for c in b.columns), strict=True):
                kind = "response" if refers is None else "revisit"
                url, refers_url = clean_url(url), clean_url(refers_url or "")
                raw = gzip.compress(record(page_id, url, html, digest, kind, None if refers is None else (refers, refers_url)), 5, mtime=0)
                out.write(raw)
                for c, x in zip(got, (url_key(url), page_id, at, len(raw)), strict=True):
                    c.append(x)
                at += len(raw)
            n = b.num_rows
            cols = [pa.array(got[0], pa.string()), pa.array(got[1], pa.int64()), pa.array([0] * n, pa.int64()), pa.array([uri] * n, pa.string()), pa.array(got[2], pa.int64()), pa.array(got[3], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["key", "page_id", "ordinal", "file", "offset", "length"])
        if out is not None:
            out.close()

    plan = _planned(pages, id_col, url_col, html_col)
    captures = C.checkpoint(plan.mapInArrow(run, schema))
    # rows that share a key and an id are numbered by their place
    many = captures.groupBy("key", "page_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("key").alias("k"), F.col("page_id").alias("i"))
    if many.isEmpty():
        return captures
    same = (captures["key"] == many["k"]) & captures["page_id"].eqNullSafe(many["i"])
    marked = captures.join(many, same, "left")
    once = marked.where("k is null").select(captures.columns)
    ordinal = F.row_number().over(Window.partitionBy("key", "page_id").orderBy("file", "offset")) - 1
    twice = marked.where("k is not null").withColumn("ordinal", ordinal.cast("long")).select(captures.columns)
    return C.checkpoint(once.unionByName(twice))


def index(captures: DataFrame, folder: str) -> list[tuple]:
    """Write the index; its upper level: a row for each task's run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri, out, at, held, places, first = f"{folder}/{uuid.uuid4().hex}.idx", None, 0, [], [], None

        def block(rows: list[tuple]) -> None:
            nonlocal at
            text = "\n".join("\t".join("" if x is None else str(x) for x in r) for r in rows)
            raw = zlib.compress(text.encode("utf-8"), 6)
            out.write(raw)
            places.append((*rows[0][:3], at, len(raw)))
            at += len(raw)

        for b in batches:
            if not b.num_rows:
                continue
            if out is None:
                fs, path = pa.fs.FileSystem.from_uri(uri)
                fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
                out = fs.open_output_stream(path, compression=None)
            held += zip(*(c.to_pylist() for c in b.columns), strict=True)
            first = first or held[0][:3]
            while len(held) >= BLOCK_LINES:
                block(held[:BLOCK_LINES])
                held = held[BLOCK_LINES:]
        if out is not None:
            if held:
                block(held)
            raw = zlib.compress("\n".join("\t".join("" if x is None else str(x) for x in p) for p in places).encode("utf-8"), 6)
            out.write(raw)
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([first[0]]), pa.array([first[1]], pa.int64()), pa.array([first[2]]), pa.array([uri]), pa.array([at]), pa.array([len(raw)])], names=["key", "page_id", "ordinal", "uri", "at", "size"])

    spark = captures.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = captures.repartitionByRange(n, "key", "page_id", "ordinal").sortWithinPartitions("key", "page_id", "ordinal")
    rows = ordered.select("key", "page_id", "ordinal", "file", "offset", "length").mapInArrow(run, "key string, page_id long, ordinal long, uri string, at long, size long").collect()  # a row for each task
    return sorted((_sort_key(r["key"], r["page_id"], r["ordinal"]), r["uri"], r["at"], r["size"]) for r in rows)


def read(captures: DataFrame, runs: list[tuple]) -> DataFrame:
    """Look every capture up in the index and read its record back."""
    spark = captures.sparkSession
    shared = spark.sparkContext.broadcast(runs)  # a row for each task that wrote the index
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lookups = captures.select("key", "page_id", "ordinal").repartitionByRange(n, "key", "page_id", "ordinal").sortWithinPartitions("key", "page_id", "ordinal")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, archives = Index(shared.value), Files()
        resolved: OrderedDict = OrderedDict()

        def get(key: str, page_id: int | None, ordinal: int) -> tuple[dict, bytes]:
            return parse(gzip.decompress(archives.read(*own.find(key, page_id, ordinal))))

        for b in batches:
            out: list[tuple] = []
            for key, page_id, ordinal in zip(*(c.to_pylist() for c in b.columns), strict=True):
                fields, payload = get(key, page_id, ordinal)
                said = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                refers = None
                if fields["WARC-Type"] == "revisit":
                    refers = int(fields["WARC-Refers-To"][len("<urn:x-page:") : -1])
                    at = (url_key(fields["WARC-Refers-To-Target-URI"]), refers)
                    if (*at, said) not in resolved:
                        payload = response(own, archives, *at, said)
                        resolved[(*at, said)] = (len(payload), hashlib.sha1(payload).hexdigest())
                        if len(resolved) > 4096:
                            resolved.popitem(last=False)
                    size, digest = resolved[(*at, said)]
                else:
                    size, digest = len(payload), hashlib.sha1(payload).hexdigest()
                if digest != said:
                    raise ValueError(f"record {page_id}: payload digest {digest}, header {said}")
                out.append((page_id, size, digest, fields["WARC-Type"], refers))
            cols = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return lookups.mapInArrow(run, SCHEMA)


def response(own: Index, archives: Files, key: str, page_id: int, digest: str) -> bytes:
    """Payload of the response with this key, id and digest."""
    for ordinal in itertools.count():  # ends in a KeyError where there is none
        fields, payload = parse(gzip.decompress(archives.read(*own.find(key, page_id, ordinal))))
        if fields["WARC-Type"] == "response" and fields["WARC-Payload-Digest"] == f"sha1:{digest}":
            return payload


def round_trip(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write, index and read back all pages."""
    spark = pages.sparkSession
    folder = folder or f"{_uri(C.ensure_checkpoint_dir(spark))}/warc-{uuid.uuid4().hex}"
    captures = write(pages, folder, id_col, url_col, html_col)
    return read(captures, index(captures, folder))


def _uri(folder: str) -> str:
    """The shared folder as a URI that Arrow takes."""
    if re.match(r"file:/(?!/)", folder):
        return "file://" + folder[len("file:") :]
    return folder if re.match(r"[a-z0-9]+://", folder) else f"file://{folder}"


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(C.table(spark, sf_dir, "pages"))
