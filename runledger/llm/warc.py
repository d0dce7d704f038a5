"""WARC archives with a two-level capture index.

Pages become WARC records, each a gzip member of its own, in archive files in the shared folder. Of records with equal
payloads of at least `least_bytes` the one with the smallest page id is the response; the others are
revisit records that carry its headers and point to it.

The index sorts captures by reversed-host URL key (SURT) into compressed blocks of some thousand lines.
Each index shard has a sparse directory, the first key and the place of every block. A lookup
finds the shards of a key by binary search over their first and last keys, the blocks by binary search in
the shard's directory, reads these blocks alone, and then reads records by byte range.

Task attempts write files of their own name; only files that a successful attempt has reported are in the index, so
lost executors leave at most files that nothing refers to. Null html is an empty payload. A null url has the key "-". Null
page ids come last among equal payloads; of rows with equal ids one is the response. Very long payloads are one record like any
other. Other columns of the table, whatever their names, play no part. An empty table gives an empty archive, and every
lookup in it no rows.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import re
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.llm.common import free_name, fresh_path, small_batches, tasks, with_row, written

BLOCK_LINES = 3000
FILE_BYTES = 1 << 30
DATE = "1970-01-01T00:00:00Z"
# Fixed values of the WARC 1.1 format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
GZIP = 31
NO_ID = "none"
NO_URL = "-"


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI and the path in it; executors open archives by these."""
    local = re.match(r"file:/*(/.*)", path)
    if local or "://" not in path:
        return fs.LocalFileSystem(), local[1] if local else path
    return fs.FileSystem.from_uri(re.sub("^s3a:", "s3:", path))


def surt(url: str | None) -> str:
    """Key of a URL: host labels reversed, then path and query; scheme, default port, www and fragment go."""
    if url is None:
        return NO_URL
    try:
        parts = urlsplit(url.strip())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02x}", url)
    labels = host.removeprefix("www.").split(".")
    shown = "" if port is None or port == {"http": 80, "https": 443}.get(parts.scheme) else f":{port}"
    key = f"{','.join(reversed(labels))}{shown}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")
    return re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02x}", key)


def _header(value: str) -> str:
    """Header values hold no control characters; % is kept apart so that the value can be read back."""
    return re.sub(r"[\x00-\x1f\x7f%]", lambda m: f"%{ord(m[0]):02X}", value)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page: int | None, url: str | None, payload: bytes, refers: str | None) -> bytes:
    """A WARC record; refers: the page id, as text, of the response that a revisit repeats."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers is not None else http + payload
    lines = [VERSION, f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{NO_ID if page is None else page}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header(url)}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest(payload)}")
    if refers is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    return {k.lower(): v for k, _, v in (x.partition(": ") for x in head.decode().split("\r\n")[1:])}


def parse(data: bytes) -> dict:
    """What a record holds; raises ValueError where lengths or the digest of a response don't fit."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = _fields(head)
    size = int(fields["content-length"])
    block = rest[:size]
    if not data.startswith(VERSION.encode()) or len(block) != size or rest[size:] != b"\r\n\r\n":
        raise ValueError("damaged record")
    http, _, payload = block.partition(b"\r\n\r\n")
    kind, said = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
    length = int(_fields(http)["content-length"])
    if kind == "response" and (len(payload) != length or digest(payload) != said):
        raise ValueError("payload does not match its digest")

    def page(field: str) -> int | None:
        found = fields.get(field, NO_ID).removeprefix("<urn:page:").removesuffix(">")
        return None if found == NO_ID else int(found)

    url = fields.get("warc-target-uri")
    return {"page_id": page("warc-record-id"), "url": url if url is None else unquote(url), "payload_bytes": length, "payload_digest": said, "record_type": kind, "refers_to": page("warc-refers-to"), "payload": payload if kind == "response" else None}


def _write(folder: str, file_bytes: int):
    """Archive files from rows (page, url, html, row, revisit, refers); gives what the index needs of each record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = filesystem(folder)
        out, name, at = None, "", 0
        for batch in batches:
            keys, rows, files, offsets, lengths = [], [], [], [], []
            html = batch.column(2).cast(pa.binary()).to_pylist()
            for page, url, payload, row, revisit, refers in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), html, *(batch.column(k).to_pylist() for k in (3, 4, 5)), strict=True):
                if out is None or at > file_bytes:
                    if out is not None:
                        out.close()
                    name, at = f"pages-{uuid.uuid4().hex}.warc.gz", 0
                    store.create_dir(base, recursive=True)
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                told = (NO_ID if refers is None else str(refers)) if revisit else None
                data = zlib.compress(record(page, url, payload or b"", told), wbits=GZIP)
                out.write(data)
                for column, v in zip((keys, rows, files, offsets, lengths), (surt(url), row, name, at, len(data)), strict=True):
                    column.append(v)
                at += len(data)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(rows, pa.int64()), pa.array(files, pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], names=["surt", "row", "file", "offset", "length"])
        if out is not None:
            out.close()

    return run


def _index(folder: str, lines: int):
    """Partitions sorted by key: a file of compressed blocks and its directory; gives (file, first, last key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = filesystem(folder)
        name = f"index-{uuid.uuid4().hex}"
        out, at, held, directory, last = None, 0, [], [], ""

        def put() -> None:
            nonlocal out, at, held
            if out is None:
                store.create_dir(base, recursive=True)
                out = store.open_output_stream(f"{base}/{name}.cdx.gz", compression=None)
            data = zlib.compress("".join(held).encode(), wbits=GZIP)
            out.write(data)
            directory.append((held[0].partition(" ")[0], at, len(data)))
            at, held = at + len(data), []

        for batch in batches:
            for key, file, offset, length in zip(*(batch.column(c).to_pylist() for c in ("surt", "file", "offset", "length")), strict=True):
                held.append(f"{key} {json.dumps([file, offset, length])}\n")
                last = key
                if len(held) == lines:
                    put()
        if held:
            put()
        if out is not None:
            out.close()
            with store.open_output_stream(f"{base}/{name}.dir") as f:
                f.write("".join(f"{k}\t{a}\t{n}\n" for k, a, n in directory).encode())
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([directory[0][0]]), pa.array([last])], names=["shard", "first", "last"])

    return run


@dataclass
class Archive:
    """Folder of the archives and the index; (shard, first key, last key) in key order."""

    folder: str
    shards: list[tuple[str, str, str]]


def write_archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, block_lines: int = BLOCK_LINES, file_bytes: int = FILE_BYTES) -> Archive:
    """Write a record for each row of pages, and the capture index."""
    spark = pages.sparkSession
    small_batches(spark)
    folder, n = fresh_path(spark, "warc"), tasks(spark)
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    # The table is read twice, so its rows need numbers that both plans agree on.
    row = free_name(pages, "row")
    source = with_row(pages, row).select(F.col(id_col).cast("long").alias("page"), F.col(url_col).cast("string").alias("url"), html.alias("html"), F.col(row).alias("row"))
    # Which records are revisits is decided on digests; texts move once, by their row number.
    seen = source.where(F.octet_length("html") >= least_bytes).select("page", "row", F.sha1(F.col("html").cast("binary")).alias("sha"))
    seen = written(seen, "digests")
    # Stored apart from the rows, so that adaptive execution can split a payload of very many pages.
    first = seen.groupBy("sha").agg(F.min(F.struct(F.col("page").isNull().alias("none"), "page", "row")).alias("first"), F.count("*").alias("records"))
    first = written(first.where("records > 1").drop("records"), "firsts")
    again = seen.join(first, "sha").where(F.col("row") != F.col("first.row")).select("row", F.lit(True).alias("revisit"), F.col("first.page").alias("refers"))
    ready = source.join(again, "row", "left").select("page", "url", "html", "row", F.coalesce("revisit", F.lit(False)).alias("revisit"), "refers")
    captures = written(ready.mapInArrow(_write(folder, file_bytes), "surt string, row long, file string, offset long, length long"), "captures")
    small_batches(spark, 10_000)
    indexed = captures.repartitionByRange(n, "surt", "row").sortWithinPartitions("surt", "row")
    # One row per shard: as many as there are shuffle partitions.
    shards = written(indexed.mapInArrow(_index(folder, block_lines), "shard string, first string, last string"), "shards").collect()
    return Archive(folder, sorted((tuple(r) for r in shards), key=lambda r: (r[1], r[2])))


class _Files:
    """The last few opened files of an archive."""

    def __init__(self, folder: str, most: int = 64) -> None:
        self.store, self.base = filesystem(folder)
        self.most, self.open = most, OrderedDict()

    def read(self, name: str, offset: int, length: int) -> bytes:
        f = self.open.get(name)
        if f is None:
            if len(self.open) >= self.most:
                self.open.popitem(last=False)[1].close()
            f = self.open[name] = self.store.open_input_file(f"{self.base}/{name}")
        self.open.move_to_end(name)
        f.seek(offset)
        return zlib.decompress(f.read(length), wbits=GZIP)

    def directory(self, shard: str) -> tuple[list[str], list[tuple[int, int]]]:
        with self.store.open_input_stream(f"{self.base}/{shard}.dir") as f:
            rows = [x.split("\t") for x in f.read().decode().split("\n")[:-1]]
        return [r[0] for r in rows], [(int(r[1]), int(r[2])) for r in rows]


def _shards_of(archive: Archive):
    """(shard, key) for every shard that can hold a key."""
    firsts, lasts = [s[1] for s in archive.shards], [s[2] for s in archive.shards]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(archive.shards[k][0], key) for key in map(surt, batch.column(0).to_pylist()) for k in range(bisect.bisect_left(lasts, key), bisect.bisect_right(firsts, key))]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.string()) for k in (0, 1)], names=["shard", "key"])

    return run


_FOUND = pa.schema([("surt", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
_FOUND_SQL = "surt string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _read(folder: str, payloads: bool):
    """Partitions sorted by (shard, key): the records of each key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _Files(folder)
        at, keys, places = None, [], []
        block_at, lines = None, []
        out: list[dict] = []
        for batch in batches:
            for shard, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if shard != at:
                    at, (keys, places), block_at = shard, files.directory(shard), None
                # From the last block that begins before the key to the last that begins with it.
                for k in range(max(0, bisect.bisect_left(keys, key) - 1), bisect.bisect_right(keys, key)):
                    if block_at != k:
                        block_at, lines = k, [x.partition(" ") for x in files.read(f"{shard}.cdx.gz", *places[k]).decode().split("\n")[:-1]]
                    for p in range(bisect.bisect_left(lines, key, key=lambda x: x[0]), bisect.bisect_right(lines, key, key=lambda x: x[0])):
                        found = parse(files.read(*json.loads(lines[p][2])))
                        out.append(found | {"surt": key, "payload": found["payload"] if payloads else None})
                    if len(out) >= 500:
                        yield pa.RecordBatch.from_pylist(out, schema=_FOUND)
                        out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_FOUND)

    return run


def lookup(archive: Archive, urls: DataFrame, url_col: str = "url", payloads: bool = True) -> DataFrame:
    """Every capture of the given urls: surt, page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload."""
    n = tasks(urls.sparkSession)
    # A url that fills many shards is asked for once, not once for each of its rows.
    asked = urls.select(F.col(url_col).cast("string")).distinct()
    keys = asked.mapInArrow(_shards_of(archive), "shard string, key string").distinct()
    return keys.repartitionByRange(n, "shard", "key").sortWithinPartitions("shard", "key").mapInArrow(_read(archive.folder, payloads), _FOUND_SQL)
