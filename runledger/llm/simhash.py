"""SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint has 64 bits: each is 1 where over half of the text's word shingles have it set in their
XXH64. Fingerprints of at most 4 differing bits are linked, classes are the components.

Fingerprints fall into segments of 22, 21 and 21 bits. Of at most 4 errors in three segments, either
one segment has none, and of the other two one has at most 2; or two segments have 1 each. So
  * an exact segment with a Golay key of another (shared within 2 errors), for 6 ordered pairs, and
  * the Golay keys of two segments (one side by nearest codeword, the other by all), for 3 pairs,
bring every linked pair together; the whole fingerprints are compared then. Equal fingerprints are
reduced to one first. A key's group gives its components as edges to their least member, not all
pairs. Groups over BLOCK rows are dealt to tasks as pairs of blocks, so no group meets in one task.

Null text counts as empty; texts without a word have fingerprint zero and are linked like any other. Very long texts are
read whole; equal rows have one fingerprint and one class, whose id is the least of their ids. Null ids are kept as rows and
never become a component's id unless the component has no other. Other columns of the table, whatever their names, play
no part. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.llm import golay
from runledger.llm.common import LOWER_SPACE, as_bytes, small_batches, tasks, written
from runledger.llm.components import components
from runledger.llm.xxh import xxh64_ranges

MOST_BITS = 4
BLOCK = 4096
#: (shift, bits) of the segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Bits of a byte as eight 8-bit lanes of a word, bit 0 in the lowest lane.
_SPREAD = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.uint8).view("<u8").ravel()


def fingerprints(texts: list[bytes], width: int = 4) -> np.ndarray:
    """Fingerprints (uint64) of whole texts in UTF-8, of word shingles with repeats."""
    words = [t.translate(LOWER_SPACE).split() for t in texts]
    data = b" ".join(b" ".join(w) for w in words)
    out = np.zeros(len(texts), np.uint64)
    counts = np.array([len(w) for w in words], np.int64)
    docs = np.flatnonzero(counts)
    if not len(docs):
        return out
    data = b" ".join(b" ".join(words[d]) for d in docs)
    gaps = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
    begin, end = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(data)]])
    n = counts[docs]
    first = np.cumsum(n) - n
    shingles = np.maximum(n - width + 1, 1)
    offset = np.cumsum(shingles) - shingles
    at = np.arange(shingles.sum()) + np.repeat(first - offset, shingles)
    last = at + np.repeat(np.minimum(n, width) - 1, shingles)
    h = xxh64_ranges(data, begin[at], end[last])
    # Counts of 8 bits each for runs of at most 255 shingles, then of whole texts.
    runs = (shingles + 254) // 255
    run_first = np.cumsum(runs) - runs
    run_at = np.repeat(offset, runs) + 255 * (np.arange(runs.sum()) - np.repeat(run_first, runs))
    lanes = np.add.reduceat(_SPREAD[h.astype("<u8").view(np.uint8).reshape(-1, 8)], run_at, axis=0)
    ones = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 64).astype(np.int64), run_first, axis=0)
    bits = (2 * ones > shingles[:, None]).astype(np.uint8)
    out[docs] = np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()
    return out


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: list[np.ndarray] = []
        texts, size = [], 0
        for t in as_bytes(batch.column(1)):
            texts.append(t)
            size += len(t)
            if size > 4 << 20:
                found.append(fingerprints(texts))
                texts, size = [], 0
        found.append(fingerprints(texts))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.concatenate(found).view(np.int64))], names=["id", "row", "fp"])


def _fuzzy_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp, store): every key of every fingerprint; store: the side of nearest codewords."""
    for batch in batches:
        every = batch.column(0).to_numpy()
        for k in range(0, len(every), 4096):
            fp = every[k : k + 4096]
            u = fp.view(np.uint64)
            parts = [((u >> np.uint64(s)) & np.uint64((1 << b) - 1)).astype(np.int64) for s, b in SEGMENTS]
            near = [golay.keys(p) for p in parts]
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            tag = 0
            for i in range(3):
                for j in range(3):
                    if i != j:
                        key = np.where(near[j] < 0, -1, (tag << 34) | (parts[i][:, None] << 12) | near[j])
                        out.append((key.ravel(), np.repeat(fp, 6), np.ones(key.size, bool)))
                        tag += 1
            for i, j in ((0, 1), (0, 2), (1, 2)):
                a, b = near[i][:, :, None], near[j][:, None, :]
                key = np.where((a < 0) | (b < 0), -1, (tag << 34) | (a << 12) | b).reshape(len(fp), 36)
                store = np.zeros(key.shape, bool)
                store[:, 0] = True
                out.append((key.ravel(), np.repeat(fp, 36), store.ravel()))
                tag += 1
            key, fps, store = (np.concatenate(x) for x in zip(*out, strict=True))
            yes = key >= 0
            yield pa.RecordBatch.from_arrays([pa.array(key[yes]), pa.array(fps[yes]), pa.array(store[yes])], names=["key", "fp", "store"])


def _close(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64)) <= MOST_BITS


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least node of each node's component, for edges a[i]-b[i] of nodes 0..n-1."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], least)
        np.minimum.at(new, root[b], least)
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _group_edges(fp: np.ndarray, store: np.ndarray, other: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Edges (member, least member) of the components of one key's rows, or of two blocks of them."""
    if other is not None:
        fp, store = np.concatenate([fp, other[0]]), np.concatenate([store, other[1]])
    order = np.lexsort((~store, fp))
    fp, store = fp[order], store[order]
    first = np.concatenate([[True], fp[1:] != fp[:-1]])
    fp, store = fp[first], store[first]
    a, b = [], []
    for k in range(len(fp)):
        near = np.flatnonzero(_close(fp[k + 1 :], fp[k : k + 1]) & (store[k] | store[k + 1 :]))
        a.append(np.full(len(near), k))
        b.append(near + k + 1)
    root = _roots(np.concatenate(a), np.concatenate(b), len(fp))
    yes = root != np.arange(len(fp))
    return fp[yes], fp[root[yes]]


_FOUND = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("key", pa.int64()), ("block", pa.int64()), ("store", pa.bool_())])
_FOUND_SQL = "u long, v long, key long, block long, store boolean"


def _edge_rows(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.nulls(len(u), pa.int64()), pa.nulls(len(u), pa.int64()), pa.nulls(len(u), pa.bool_())], schema=_FOUND)


def _block_rows(key: int, block: int, fp: np.ndarray, store: np.ndarray) -> pa.RecordBatch:
    n = len(fp)
    return pa.RecordBatch.from_arrays([pa.array(fp), pa.nulls(n, pa.int64()), pa.array(np.full(n, key)), pa.array(np.full(n, block)), pa.array(store)], schema=_FOUND)


def _match(most: int):
    """Within partitions sorted by key: edges of groups of up to `most` rows, blocks of larger groups."""

    def settled(key: np.ndarray, fp: np.ndarray, store: np.ndarray) -> Iterator[pa.RecordBatch]:
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.concatenate([start, [len(key)]]))
        run = np.repeat(size, size)
        small = run <= 32
        us, vs = [], []
        for lag in range(1, 32):
            i = np.flatnonzero(small[:-lag] & (key[lag:] == key[:-lag]) & (run[:-lag] > lag)) if len(key) > lag else np.zeros(0, np.int64)
            if not len(i):
                break
            i = i[(store[i] | store[i + lag]) & (fp[i] != fp[i + lag])]
            i = i[_close(fp[i], fp[i + lag])]
            us.append(fp[i])
            vs.append(fp[i + lag])
        for s, n in zip(start[size > 32], size[size > 32], strict=True):
            u, v = _group_edges(fp[s : s + n], store[s : s + n])
            us.append(u)
            vs.append(v)
        if us and sum(map(len, us)):
            pairs = np.unique(np.stack([np.concatenate(us), np.concatenate(vs)]), axis=1)
            yield _edge_rows(np.ascontiguousarray(pairs[0]), np.ascontiguousarray(pairs[1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)]
        split_key, block = None, 0
        for batch in batches:
            rows = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)]
            held = [np.concatenate(x) for x in zip(held, rows, strict=True)]
            if len(held[0]) < 65_536:
                continue
            tail = int(np.searchsorted(held[0], held[0][-1]))  # the last key's group may go on
            if tail:
                yield from finish(*(x[:tail] for x in held), split_key, block)
                held, split_key, block = [x[tail:] for x in held], None, 0
            while len(held[0]) > 2 * most:
                split_key = int(held[0][0])
                yield _block_rows(split_key, block, held[1][:most], held[2][:most])
                held, block = [x[most:] for x in held], block + 1
        if len(held[0]):
            yield from finish(*held, split_key, block)

    def finish(key, fp, store, split_key, block):
        """Groups that are complete; the first may be the rest of one that has given blocks."""
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.concatenate([start, [len(key)]]))
        whole = np.ones(len(key), bool)
        for s, n in zip(start, size, strict=True) if split_key is not None or (size > most).any() else ():
            if n > most or int(key[s]) == split_key:
                whole[s : s + n] = False
                for b, k in enumerate(range(s, s + n, most)):
                    z = min(k + most, s + n)
                    yield _block_rows(int(key[s]), b + (block if int(key[s]) == split_key else 0), fp[k:z], store[k:z])
        if whole.any():
            yield from settled(key[whole], fp[whole], store[whole])

    return run


def _block_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partitions sorted by (key, lower, upper): the edges of each pair of blocks."""
    held: tuple | None = None
    parts: list = []

    def edges() -> Iterator[pa.RecordBatch]:
        fp, store = (np.concatenate(x) for x in zip(*parts, strict=True))
        u, v = _group_edges(fp, store)
        if len(u):
            yield _edge_rows(u, v)

    for batch in batches:
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)]
        group = np.stack(columns[:3], axis=1)
        cuts = np.concatenate([[0], np.flatnonzero((group[1:] != group[:-1]).any(axis=1)) + 1, [len(group)]])
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            if a == z:
                continue
            now = tuple(group[a].tolist())
            if held is not None and now != held:
                yield from edges()
                parts = []
            held = now
            parts.append((columns[3][a:z], columns[4][a:z]))
    if parts:
        yield from edges()


def links(prints: DataFrame, block: int = BLOCK) -> DataFrame:
    """Edges (u, v) that connect what pairs of at most 4 differing bits connect, of distinct longs in `fp`."""
    n = tasks(prints.sparkSession)
    # Some 110 keys come from each: by number, so that small fingerprints are not put together in few tasks first.
    keyed = prints.select("fp").repartition(n, "fp").mapInArrow(_fuzzy_keys, "key long, fp long, store boolean")
    found = written(keyed.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_match(block), _FOUND_SQL), "links")
    edges = found.where("v is not null").select("u", "v")
    large = found.where("v is null")
    if large.isEmpty():
        return edges
    blocks = large.groupBy("key").agg((F.max("block") + 1).alias("blocks"))
    dealt = large.join(blocks, "key").select("key", "block", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)).alias("with"), "u", "store")
    pairs = dealt.select("key", F.least("block", "with").alias("lower"), F.greatest("block", "with").alias("upper"), "u", "store")
    more = pairs.repartition(n, "key", "lower", "upper").sortWithinPartitions("key", "lower", "upper").mapInArrow(_block_pairs, _FOUND_SQL)
    return edges.union(more.select("u", "v"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """One row per row of docs: <id_col>, fingerprint (16 hex digits), component_id (least id reachable).

    With row_col (a unique long): that column too, and kept, true for one row of each class, the first with
    the least id.
    """
    spark = docs.sparkSession
    small_batches(spark)
    row = F.monotonically_increasing_id() if row_col is None else F.col(row_col).cast("long")
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), row.alias("row"))
    prints = written(source.mapInArrow(_fingerprint, "id long, row long, fp long"), "prints")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row"))
    nodes = prints.groupBy("fp").agg(first.alias("first"))
    roots = components(links(nodes))
    named = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    # Apart from the rows that they are joined to, so that adaptive execution can split a class of very many members.
    classes = written(named.groupBy("root").agg(F.min("first").alias("best")), "classes")
    told = named.select("fp", "root").join(classes, "root").select("fp", "best")
    extra = [] if row_col is None else [F.col("row").alias(row_col), (F.col("row") == F.col("best.row")).alias("kept")]
    return prints.join(told, "fp").select(
        F.col("id").alias(id_col),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("best.id").alias("component_id"),
        *extra,
    )
