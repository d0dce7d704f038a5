"""Best-fit packing of token sequences.

Documents are tokenized and end with id 0; longer ones are cut into whole sequences from their end, so
only first pieces leave room. Each task packs its pieces online: a fixed number of open bins, whose
free spaces are the bits of one integer, gives the tightest open bin that fits by a shift and a
count of trailing zeros; when all are open, the fullest closes. What a task leaves open is packed
once more, in fewer tasks, with whole bins as the pieces; at the end the open bins close.

Null text counts as empty: such a document is the single id 0. Very long texts are cut into pieces, and rows with equal
ids are packed one by one. Of bins with equal room the last one opened or filled is taken; equal pieces go in the order of
their rows. Other columns of the table, whatever their names, play no part. An empty table gives no rows.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.llm.common import small_batches, written

END = 0
OPEN_BINS = 1024
#: Pieces come in random batches of about so many, the longest of a batch first.
BATCH = 1024
#: Pieces that one packing task gets, about, and packing tasks whose open bins meet in one.
TASK_PIECES = 200_000
FAN_IN = 32


def _byte_of_char() -> dict[str, int]:
    """The printable characters that stand for bytes in a byte-level vocabulary."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(maxsize=1)
def _encoding(path: str):
    """The tokenizer of a byte-level BPE file whose ids are its merge ranks, in tiktoken's encoder; its added tokens by text."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    chars = _byte_of_char()
    added = {t["content"]: t["id"] for t in file["added_tokens"]}
    ranks = {bytes(chars[c] for c in token): k for token, k in file["model"]["vocab"].items() if token not in added}
    return tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), added


class _Words(dict):
    """Ids, as bytes, of words that follow a space, by the word alone."""

    def __init__(self, encode, most: int) -> None:
        self.encode, self.most = encode, most

    def __missing__(self, word: str) -> bytes:
        found = array("I", self.encode(" " + word)).tobytes()
        if len(word) < 64:
            if len(self) >= self.most:
                self.clear()
            self[word] = found
        return found


class Tokenizer:
    """Token ids as little-endian unsigned 32-bit bytes, as the file's own library gives them.

    Added tokens are cut out of a text first, each is one id. Words between single spaces are kept by text.
    """

    #: Two white characters in a row: a token may cross such a place.
    _RUN = re.compile(r"\s\s")

    def __init__(self, path: str, words: int = 400_000) -> None:
        encoding, added = _encoding(path)
        self.encode = encoding.encode_ordinary
        self.words = _Words(self.encode, words)
        self.added = {t: array("I", [k]).tobytes() for t, k in added.items()}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")").split if added else None

    def __call__(self, text: str) -> bytes:
        if any(t in text for t in self.added):
            return b"".join(self.added[x] if x in self.added else self._plain(x) for x in self.split(text) if x)
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        if self._RUN.search(text):
            return array("I", self.encode(text)).tobytes()
        first, *rest = text.split(" ")
        return array("I", self.encode(first)).tobytes() + b"".join(map(self.words.__getitem__, rest))


def _pieces(path: str, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokenizer(path)
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for doc, text, row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = tokens(text or "") + END.to_bytes(4, "little")
                n, at, k = len(ids) // 4, 0, 0
                while at < n:
                    size = (n - at - 1) % most + 1 if k == 0 else most
                    for column, v in zip(out, (doc, row, k, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)])), strict=True):
                        column.append(v)
                    at, k = at + size, k + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["id", "row", "piece", "start", "length", "crc"])

    return run


class BestFit:
    """Bounded-space online best fit over units of 1..size tokens; gives bins as they close."""

    def __init__(self, size: int, bins: int) -> None:
        self.size, self.bins = size, bins
        self.spaces = 0  # bit s: some open bin has s tokens free
        self.open: dict[int, list[list]] = {}
        self.count = 0

    def put(self, length: int, unit) -> Iterator[list]:
        """Place a unit; gives the bins that close for it."""
        fits = self.spaces >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            bin_ = self._take(space)
        else:
            if self.count == self.bins and length < self.size:
                yield self._take((self.spaces & -self.spaces).bit_length() - 1)
            space, bin_ = self.size, []
        bin_.append(unit)
        if space == length:
            yield bin_
        else:
            self._add(space - length, bin_)

    def rest(self) -> Iterator[tuple[int, list]]:
        """(tokens free, bin) of the bins still open."""
        for space, same in self.open.items():
            for bin_ in same:
                yield space, bin_

    def _take(self, space: int) -> list:
        same = self.open[space]
        bin_ = same.pop()
        if not same:
            del self.open[space]
            self.spaces &= ~(1 << space)
        self.count -= 1
        return bin_

    def _add(self, space: int, bin_: list) -> None:
        self.open.setdefault(space, []).append(bin_)
        self.spaces |= 1 << space
        self.count += 1


_FIELDS = ["id", "row", "piece", "start", "length", "crc"]
_TYPE = pa.list_(pa.struct([(n, pa.int64()) for n in [*_FIELDS, "offset"]]))
_BINS = f"bin long, key long, used long, piece array<struct<{', '.join(f'{n}:long' for n in [*_FIELDS, 'offset'])}>>, closed boolean"


def _first_bin(level: int) -> int:
    """Numbers of a task's bins start here: no two tasks, of one level or of two, give the same."""
    return (level << 58) | (TaskContext.get().partitionId() << 36)


def _bin_rows(first: int, bins: list[tuple[int, int, list, bool]]) -> pa.RecordBatch:
    for _, _, pieces, _ in bins:
        at = 0
        for p in pieces:
            p["offset"] = at
            at += p["length"]
    keys, used, pieces, closed = zip(*bins, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(range(first, first + len(bins)), pa.int64()), pa.array(keys, pa.int64()), pa.array(used, pa.int64()), pa.array(pieces, _TYPE), pa.array(closed)], names=["bin", "key", "used", "piece", "closed"])


def _pack_pieces(size: int, bins: int):
    """Partitions sorted by shard: a row for each bin, closed or left open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, packer, out, number = None, BestFit(size, bins), [], _first_bin(0)

        def ended() -> None:
            out.extend((shard, size - space, bin_, False) for space, bin_ in packer.rest())

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for now, *piece in zip(*columns, strict=True):
                if now != shard:
                    if shard is not None:
                        ended()
                    shard, packer = now, BestFit(size, bins)
                unit = dict(zip(_FIELDS, piece, strict=True))
                out.extend((now, sum(p["length"] for p in b), b, True) for b in packer.put(unit["length"], unit))
                if len(out) >= 2000:
                    yield _bin_rows(number, out)
                    number, out = number + len(out), []
        if shard is not None:
            ended()
        if out:
            yield _bin_rows(number, out)

    return run


def _pack_bins(size: int, bins: int, last: bool, level: int):
    """Partitions sorted by (key, falling use): bins as units of larger bins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, packer, out, number = None, BestFit(size, bins), [], _first_bin(level)

        def flat(bin_: list) -> list:
            return [p for unit in bin_ for p in unit]

        def ended() -> None:
            out.extend((key, size - space, flat(bin_), last) for space, bin_ in packer.rest())

        for batch in batches:
            for now, used, pieces in zip(*(batch.column(c).to_pylist() for c in ("key", "used", "piece")), strict=True):
                if now != key:
                    if key is not None:
                        ended()
                    key, packer = now, BestFit(size, bins)
                out.extend((now, sum(p["length"] for u in b for p in u), flat(b), True) for b in packer.put(used, pieces))
                if len(out) >= 2000:
                    yield _bin_rows(number, out)
                    number, out = number + len(out), []
        if key is not None:
            ended()
        if out:
            yield _bin_rows(number, out)

    return run


def pack(docs: DataFrame, tokenizer: str, size: int = 2048, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, open_bins: int = OPEN_BINS) -> DataFrame:
    """One row per piece: <id_col>, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    small_batches(spark)
    row = F.monotonically_increasing_id() if row_col is None else F.col(row_col).cast("long")
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), row.alias("row"))
    cut = written(source.mapInArrow(_pieces(tokenizer, size), "id long, row long, piece long, start long, length long, crc long"), "pieces")
    n = cut.count()
    shards = max(1, min(FAN_IN, n // 1000), math.ceil(n / TASK_PIECES))
    shard = F.pmod(F.xxhash64("row", "piece"), F.lit(shards)).cast("int")
    batch = F.pmod(F.xxhash64("piece", "row"), F.lit(max(1, n // shards // BATCH)))
    dealt = cut.select(shard.alias("shard"), *_FIELDS).repartition(shards, "shard").sortWithinPartitions("shard", batch, F.desc("length"), "row", "piece")
    packed = written(dealt.mapInArrow(_pack_pieces(size, open_bins), _BINS), "bins")
    done = packed.where("closed")
    rest = packed.where("not closed")
    for level in range(1, 32):
        shards = math.ceil(shards / FAN_IN)
        last = shards == 1
        regrouped = rest.withColumn("key", F.pmod("key", F.lit(shards))).repartition(shards, "key").sortWithinPartitions("key", F.desc("used"), F.expr("piece[0].row"), F.expr("piece[0].piece"))
        packed = written(regrouped.mapInArrow(_pack_bins(size, open_bins * FAN_IN, last, level), _BINS), "bins")
        done = done.union(packed.where("closed"))
        if last:
            break
        rest = packed.where("not closed")
    named = done.select(F.col("bin").alias("sequence_id"), F.explode("piece").alias("p"))
    return named.select(
        F.col("p.id").alias(id_col),
        F.col("p.piece").cast("int").alias("piece"),
        F.col("p.start").alias("start"),
        F.col("p.length").alias("length"),
        F.col("p.crc").alias("ids_crc32"),
        "sequence_id",
        F.col("p.offset").alias("offset"),
        *([] if row_col is None else [F.col("p.row").alias(row_col)]),
    )
