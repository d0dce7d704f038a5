"""Exact deduplication by Grace hash partitioning.

Texts are equal when identical after lower-casing A-Z. Map tasks reduce their own copies with an
open-addressing table, so a text that fills a third of the corpus leaves each task once. The distinct
texts are dealt out by hash; each bucket is read into an open-addressing table that compares
complete contents. A bucket that outgrows its table is partitioned again into spill files by further
bits of the hash, recursively. Only ids travel afterwards: members meet their local leader's verdict.

Null text counts as empty, empty texts are equal to each other; very long texts are compared whole. Of rows with the same
text the largest id stays (null ids are smallest, among equal ids the first row). Other columns of the table, whatever
their names, play no part. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os
import struct
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runledger.llm.common import LOWER, as_bytes, small_batches, tasks

#: Bytes of text that a table may hold before its bucket is partitioned again.
TABLE_BYTES = 96 << 20
FANOUT = 16
#: Below any 64-bit id that a row can have, for rows without an id.
NO_ID = -(1 << 63)

_PIECES = pa.schema(
    [("bucket", pa.int64()), ("row", pa.int64()), ("id", pa.int64()), ("leader", pa.int64()), ("n", pa.int64()), ("best_row", pa.int64()), ("sha", pa.string()), ("text", pa.binary())]
)
_PIECES_SQL = "bucket long, row long, id long, leader long, n long, best_row long, sha string, text binary"
_VERDICT = pa.schema([("row", pa.int64()), ("id", pa.int64()), ("leader", pa.int64()), ("sha", pa.string()), ("keep_id", pa.int64()), ("keep_row", pa.int64()), ("size", pa.int64())])
_VERDICT_SQL = "row long, id long, leader long, sha string, keep_id long, keep_row long, size long"


class ContentTable:
    """Open addressing with linear probing; a slot holds the number of an entry, entries hold whole texts."""

    def __init__(self) -> None:
        self.slots = np.full(1024, -1, np.int64)
        self.hashes: list[int] = []
        self.texts: list[bytes] = []
        self.bytes = 0

    def entry(self, h: int, text: bytes) -> int:
        """The entry of this text, made if there is none."""
        mask = len(self.slots) - 1
        at = h & mask
        while (e := self.slots[at]) >= 0:
            if self.hashes[e] == h and self.texts[e] == text:
                return int(e)
            at = (at + 1) & mask
        self.slots[at] = e = len(self.texts)
        self.hashes.append(h)
        self.texts.append(text)
        self.bytes += len(text) + 200
        if 2 * len(self.texts) > len(self.slots):
            self._grow()
        return int(e)

    def _grow(self) -> None:
        self.slots = np.full(4 * len(self.slots), -1, np.int64)
        mask = len(self.slots) - 1
        for e, h in enumerate(self.hashes):
            at = h & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = e


def _hash(text: bytes) -> tuple[str, int]:
    digest = hashlib.sha256(text)
    return digest.hexdigest(), int.from_bytes(digest.digest()[:8], "little") >> 1


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every row as a member of its task's first copy; every text of the task once, with the best of its rows."""
    table, groups = ContentTable(), []

    def flush() -> Iterator[pa.RecordBatch]:
        for k in range(0, len(groups), 256):
            part = groups[k : k + 256]
            texts, hashes = table.texts[k : k + 256], table.hashes[k : k + 256]
            none = pa.nulls(len(part), pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes, pa.int64()), pa.nulls(len(part), pa.int64()), pa.array([g[2] for g in part], pa.int64()), pa.array([g[0] for g in part], pa.int64()), pa.array([g[1] for g in part], pa.int64()), pa.array([g[3] for g in part], pa.int64()), none, pa.array(texts, pa.binary())],
                schema=_PIECES,
            )

    for batch in batches:
        ids, leaders, shas = batch.column(0).to_pylist(), [], []
        for doc, raw, row in zip(ids, as_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            text = raw.translate(LOWER)
            sha, h = _hash(text)
            e = table.entry(h, text)
            doc = NO_ID if doc is None else doc
            if e == len(groups):
                groups.append([row, 0, doc, row])
            g = groups[e]
            g[1] += 1
            if (doc, -row) > (g[2], -g[3]):
                g[2:] = [doc, row]
            leaders.append(g[0])
            shas.append(sha)
        n, rows = len(ids), batch.column(2)
        yield pa.RecordBatch.from_arrays([rows, rows, pa.array(ids, pa.int64()), pa.array(leaders, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(shas), pa.nulls(n, pa.binary())], schema=_PIECES)
        if table.bytes > TABLE_BYTES:
            yield from flush()
            table, groups = ContentTable(), []
    yield from flush()


_HEAD = struct.Struct("<qqqqqI")


def _scratch() -> str | None:
    """The executor's own folder for spills, which Spark clears when the executor ends; one of them, by turns."""
    given = [d for d in os.environ.get("SPARK_LOCAL_DIRS", "").split(",") if os.path.isdir(d)]
    return given[os.getpid() % len(given)] if given else None


class _Bucket:
    """The distinct texts of one bucket; partitions itself again when its table is full."""

    def __init__(self, limit: int, depth: int = 0) -> None:
        self.limit, self.depth = limit, depth
        self.table, self.best, self.leaders = ContentTable(), [], []
        self.spill: tempfile.TemporaryDirectory | None = None
        self.files: list = []

    def add(self, h: int, text: bytes, leader: int, n: int, doc: int, row: int) -> None:
        if self.spill is not None:
            self._put(h, text, leader, n, doc, row)
            return
        e = self.table.entry(h, text)
        if e == len(self.best):
            self.best.append([0, doc, row])
            self.leaders.append([])
        b = self.best[e]
        b[0] += n
        if (doc, -row) > (b[1], -b[2]):
            b[1:] = [doc, row]
        self.leaders[e].append(leader)
        self.table.bytes += 40
        if self.table.bytes > self.limit and len(self.best) > 1 and self.depth < 12:
            self._partition()

    def _put(self, h: int, text: bytes, leader: int, n: int, doc: int, row: int) -> None:
        f = self.files[(h >> (59 - 4 * self.depth)) % FANOUT]
        f.write(_HEAD.pack(h, leader, n, doc, row, len(text)) + text)

    def _partition(self) -> None:
        self.spill = tempfile.TemporaryDirectory(prefix="grace-", dir=_scratch())
        self.files = [open(os.path.join(self.spill.name, str(k)), "w+b") for k in range(FANOUT)]  # noqa: SIM115
        for h, text, best, leaders in zip(self.table.hashes, self.table.texts, self.best, self.leaders, strict=True):
            # The first leader carries the count of all; the others are told the verdict.
            for k, leader in enumerate(leaders):
                self._put(h, text, leader, best[0] if k == 0 else 0, best[1], best[2])
        self.table, self.best, self.leaders = ContentTable(), [], []

    def verdicts(self) -> Iterator[tuple[int, int, int, int]]:
        """(leader, keep_id, keep_row, size) of every leader."""
        if self.spill is None:
            for best, leaders in zip(self.best, self.leaders, strict=True):
                for leader in leaders:
                    yield leader, best[1], best[2], best[0]
            return
        with self.spill:
            for f in self.files:
                f.seek(0)
                part = _Bucket(self.limit, self.depth + 1)
                while head := f.read(_HEAD.size):
                    h, leader, n, doc, row, size = _HEAD.unpack(head)
                    part.add(h, f.read(size), leader, n, doc, row)
                f.close()
                yield from part.verdicts()


def _judge(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = _Bucket(limit)
        for batch in batches:
            members = batch.filter(pc.is_null(batch.column("text")))
            n = members.num_rows
            yield pa.RecordBatch.from_arrays([members.column("row"), members.column("id"), members.column("leader"), members.column("sha"), *[pa.nulls(n, pa.int64())] * 3], schema=_VERDICT)
            texts = batch.filter(pc.is_valid(batch.column("text")))
            for row in zip(*(texts.column(c).to_pylist() for c in ("bucket", "text", "leader", "n", "id", "best_row")), strict=True):
                bucket.add(*row)
        rows: list = []
        for v in bucket.verdicts():
            rows.append(v)
            if len(rows) >= 10_000:
                yield _verdict_rows(rows)
                rows = []
        if rows:
            yield _verdict_rows(rows)

    return run


def _verdict_rows(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    leader, keep, row, size = (pa.array(x, pa.int64()) for x in zip(*rows, strict=True))
    n = len(rows)
    return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), leader, pa.nulls(n, pa.string()), keep, row, size], schema=_VERDICT)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """One row per row of docs: <id_col>, keep_id, group_size, kept, text_sha256.

    With row_col (a unique long), that column is returned too, so that whole rows can be joined back.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rank = F.col(id_col).cast("long")
    row = F.monotonically_increasing_id() if row_col is None else F.col(row_col).cast("long")
    source = docs.select(rank.alias("id"), F.col(text_col).cast("string").alias("text"), row.alias("row"))
    pieces = source.mapInArrow(_local, _PIECES_SQL)
    n = tasks(spark)
    judged = pieces.repartition(n, "bucket").mapInArrow(_judge(table_bytes), _VERDICT_SQL)
    group = Window.partitionBy("leader")
    told = judged.repartition(n, "leader").withColumns({c: F.max(c).over(group) for c in ("keep_id", "keep_row", "size")})
    lost = F.col("keep_id") == NO_ID
    return told.where(F.col("row").isNotNull()).select(
        F.col("id").alias(id_col),
        F.when(~lost, F.col("keep_id")).alias("keep_id"),
        F.col("size").alias("group_size"),
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.col("sha").alias("text_sha256"),
        *([] if row_col is None else [F.col("row").alias(row_col)]),
    )
