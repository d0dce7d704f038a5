"""Exact top-k by inner product with MaxScore.

Components become integers, floor(1024 * x). Vectors are dealt into shards; a shard is indexed as posting
lists, one for each dimension and sign, of the vectors whose component has that sign, largest first. A
query's terms are the lists whose sign agrees with its own component; a term's score bound is the query's
component times the largest of the list. Terms in order of their bounds split in two: as long as the
bounds of the smallest ones together stay below the k-th best score so far, those are non-essential,
since a vector in none of the essential lists can't get in. Essential lists are traversed first, long ones with the
list of the opposite sign as one column; what opposite signs take off is then settled for the candidates, which
are probed in the remaining lists, strongest bounds first, and leave as soon as what they have and what is left can't compete.

Queries are all rows that the caller names, in blocks. All shards meet all blocks in tiles: a task holds many blocks, as many
as fit its bytes, and goes through some shards one after the other. Each query keeps its k best so far, whose last score is the
threshold for the next shard. A tile gives k rows a query, and the tiles' answers are merged.

Vectors that are null or hold null or non-finite components take no part; neither do rows without an id. Rows with
equal ids are ranked one by one, however many they are; as queries they are one, by the largest vector, and none of
them is its own candidate. Vectors of different lengths are compared over the shorter one. Ties go to the smaller id.
Components are at most 2**62 in size after scaling, and scores are kept within 64 bits: what exceeds them is given as the
nearest such number. Other columns of the table, whatever their names, play no part. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runledger.llm.common import batches_of, tasks, written

SHARD_ROWS = 8192
QUERY_ROWS = 128
#: Bytes of queries that a task holds, and shards that it goes through.
HELD_BYTES = 32 << 20
RUN = 8
#: Rows of an Arrow batch of vectors, and of one of blobs.
VECTORS, BLOBS = 2048, 4
SCALE = 1024
#: Bounds of a component and of a score.
LARGEST, MOST = 1 << 62, (1 << 63) - 1
#: Lists that candidates are probed in before those that can't compete leave.
STRIDE = 4
#: A list of more than this part of the rows, one in so many, is added up as a column.
LONG = 4


def _blobs(most: int):
    """Partitions sorted by group: (group, part, ids blob, matrix blob, rows, width) of at most `most` vectors each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, part, ids, rows = None, 0, [], []

        def block() -> pa.RecordBatch:
            width = max(1, *map(len, rows), 1)
            m = np.zeros((len(rows), width), "<i8")
            for k, r in enumerate(rows):
                m[k, : len(r)] = np.clip(np.floor(SCALE * np.array(r, np.float64)), -LARGEST, LARGEST)
            columns = [([group], pa.int64()), ([part], pa.int32()), ([np.array(ids, "<i8").tobytes()], pa.binary()), ([m.tobytes()], pa.binary()), ([len(rows)], pa.int32()), ([width], pa.int32())]
            return pa.RecordBatch.from_arrays([pa.array(*c) for c in columns], names=["group", "part", "ids", "m", "n", "width"])

        for batch in batches:
            for g, i, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows and (g != group or len(rows) == most):
                    yield block()
                    part = part + 1 if g == group else 0
                    ids, rows = [], []
                group = g
                ids.append(i)
                rows.append(x)
        if rows:
            yield block()

    return run


class Shard:
    """Posting lists of a block of integer vectors: for each dimension and sign, rows by falling size."""

    def __init__(self, ids: np.ndarray, m: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.m = ids[order], np.ascontiguousarray(m[order].T)
        self.largest = int(np.abs(self.m).max(initial=0))
        self.lists: dict[tuple[int, int], np.ndarray] = {}
        self.most: dict[tuple[int, int], int] = {}
        for d, column in enumerate(self.m):
            for sign in (1, -1):
                rows = np.flatnonzero(sign * column > 0)
                if len(rows):
                    self.lists[d, sign] = rows[np.argsort(-sign * column[rows], kind="stable")]
                    self.most[d, sign] = int(sign * column[self.lists[d, sign][0]])

    def top(self, q: np.ndarray, own: int, k: int, least: int = 0) -> list[tuple[int, int]]:
        """The k best (score, id), without the rows of id `own`; ties to smaller ids. Scores below `least`, if it is above 0,
        may be left out."""
        width = min(len(q), len(self.m))
        if width * self.largest * int(np.abs(q).max(initial=0)) > MOST:
            return self._top_in_long_numbers(q[:width], own, k)
        n = len(self.ids)
        signed = [(d, 1 if q[d] > 0 else -1) for d in np.flatnonzero(q[:width]).tolist()]
        terms = [(abs(int(q[d])) * self.most[d, s], d, s) for d, s in signed if (d, s) in self.lists]
        terms.sort(reverse=True)
        bounds = np.array([t[0] for t in terms], np.int64)
        # What the terms from the i-th on can add at most.
        left = np.append(bounds[::-1].cumsum()[::-1], 0)
        others = self.ids != own
        threshold = max(least, self._first_threshold(q, terms, others, k, width))
        essential = int(np.searchsorted(-left, -threshold, side="right")) if threshold > 0 else len(terms) + 1
        # Dimensions whose list of the opposite sign is still to be taken off.
        owed = [d for d, sign in signed if (d, sign) not in self.lists]
        score = np.zeros(n, np.int64)
        if essential > len(terms):
            alive = np.flatnonzero(others)
            at = 0
        else:
            seen = np.zeros(n, bool)
            for _, d, sign in terms[:essential]:
                rows = self.lists[d, sign]
                seen[rows] = True
                if len(rows) * LONG > n:
                    score += q[d] * self.m[d]
                else:
                    score[rows] += q[d] * self.m[d, rows]
                    owed.append(d)
            alive = np.flatnonzero(seen & others)
            at = essential
        score = score[alive]
        for d in owed:
            score += np.minimum(q[d] * self.m[d, alive], 0)
        while at < len(terms) and len(alive):
            if threshold > 0:
                compete = score + left[at] >= threshold
                if not compete.all():
                    alive, score = alive[compete], score[compete]
            for _, d, _ in terms[at : at + STRIDE]:
                score += q[d] * (self.m[d] if len(alive) == n else self.m[d, alive])
            at += STRIDE
        if threshold > 0:
            alive, score = alive[score >= threshold], score[score >= threshold]
        best = np.lexsort((self.ids[alive], -score))[:k]
        return list(zip(score[best].tolist(), self.ids[alive[best]].tolist(), strict=True))

    def _top_in_long_numbers(self, q: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
        """The k best where products may pass 64 bits, in Python's numbers, each row in full."""
        rows = np.flatnonzero(self.ids != own)
        scores = q.astype(object) @ self.m[: len(q), rows].astype(object) if len(q) else np.zeros(len(rows), object)
        bounded = [(max(-MOST - 1, min(MOST, int(s))), i) for s, i in zip(scores, self.ids[rows].tolist(), strict=True)]
        return sorted(bounded, key=lambda x: (-x[0], x[1]))[:k]

    def _first_threshold(self, q: np.ndarray, terms: list, others: np.ndarray, k: int, width: int) -> int:
        """A k-th score that some k rows reach: whole scores of the heads of the strongest lists."""
        heads = [self.lists[d, s][: 4 * k] for _, d, s in terms[:8]]
        rows = np.unique(np.concatenate(heads)) if heads else np.zeros(0, np.int64)
        rows = rows[others[rows]]
        if len(rows) < k:
            return 0
        whole = q[:width] @ self.m[:width, rows]
        return int(np.partition(whole, len(whole) - k)[len(whole) - k])


class Held:
    """Blocks of queries, each query with its k best so far."""

    def __init__(self, k: int) -> None:
        self.k = k
        self.blocks: list[tuple[np.ndarray, np.ndarray, list[list[tuple[int, int]]]]] = []

    def add(self, ids: np.ndarray, m: np.ndarray) -> None:
        self.blocks.append((ids, m, [[] for _ in ids]))

    def meet(self, shard: Shard) -> None:
        for ids, m, best in self.blocks:
            for j, (own, q) in enumerate(zip(ids.tolist(), m, strict=True)):
                had = best[j]
                new = shard.top(q, own, self.k, max(0, had[-1][0]) if len(had) == self.k else 0)
                best[j] = sorted(had + new, key=lambda x: (-x[0], x[1]))[: self.k] if had else new

    def found(self) -> Iterator[pa.RecordBatch]:
        for ids, _, best in self.blocks:
            out = [(i, v, s) for i, own in zip(ids.tolist(), best, strict=True) for s, v in own]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 3, names=["query_id", "vec_id", "score"])


def _search(k: int):
    """Partitions sorted by tile, the blocks of queries of each before its shards: the k best of every query of a tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, Held(k)
        for batch in batches:
            for tile, is_shard, ids, m, n, width in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if tile != at:
                    yield from held.found()
                    at, held = tile, Held(k)
                vectors = np.frombuffer(ids, "<i8"), np.frombuffer(m, "<i8").reshape(n, width)
                if is_shard:
                    held.meet(Shard(*vectors))
                else:
                    held.add(*vectors)
        yield from held.found()

    return run


def _blocks(rows: DataFrame, group: Column, groups: int, most: int) -> DataFrame:
    """Blobs of the rows (id, x), at most `most` in each, dealt by group."""
    dealt = rows.select(group.cast("long").alias("group"), "id", "x")
    dealt = dealt.repartition(max(groups, tasks(rows.sparkSession)), "group").sortWithinPartitions("group", "id")
    return written(dealt.mapInArrow(_blobs(most), "group long, part int, ids binary, m binary, n int, width int"), "vectors")


def _tiles(groups: int, pieces: int, held: int, n: int) -> tuple[int, int]:
    """How many parts the shards and the blocks of queries are dealt into: blocks that a task can hold, few shards for each, and
    if there are enough of them a tile for each of n tasks."""
    down = -(-pieces // held)
    across = min(groups, max(-(-groups // RUN), -(-n // down)))
    return across, min(pieces, max(down, -(-n // across)))


def top_k(vectors: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each row that is_query (a Column) holds for: query_id, rank, vec_id, score of its k best rows."""
    spark = vectors.sparkSession
    x = F.col(vector_col).cast("array<double>")
    valid = F.col(id_col).isNotNull() & x.isNotNull() & ~F.coalesce(F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), F.lit(False))
    rows = vectors.where(valid)
    queries = rows.where(is_query).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(x).alias("x"))
    n = tasks(spark)
    count, width = rows.agg(F.count("*"), F.max(F.size(x))).first()
    # Groups are a little smaller than a shard, so few of them need a second one.
    groups = max(1, -(-count * 8 // (SHARD_ROWS * 7)))
    numbered = rows.select(F.col(id_col).cast("long").alias("id"), x.alias("x"), F.monotonically_increasing_id().alias("row"))
    pieces = max(1, -(-queries.count() // QUERY_ROWS))
    with batches_of(spark, VECTORS):
        shards = _blocks(numbered, F.pmod(F.xxhash64("id", "row"), F.lit(groups)), groups, SHARD_ROWS)
        blocks = _blocks(queries, F.pmod(F.xxhash64("id"), F.lit(pieces)), pieces, QUERY_ROWS)

    across, down = _tiles(groups, pieces, max(1, HELD_BYTES // (8 * QUERY_ROWS * max(1, width or 1))), n)
    columns = ["ids", "m", "n", "width"]
    # A block meets every part of the shards, a shard every part of the blocks.
    parts, lines = F.sequence(F.lit(0), F.lit(across - 1)), F.sequence(F.lit(0), F.lit(down - 1))
    line, part = F.pmod("group", F.lit(down)) * across, F.pmod(F.xxhash64("group", "part"), F.lit(across))
    asking = blocks.select(F.explode(F.transform(parts, lambda p: line + p)).alias("tile"), F.lit(False).alias("is_shard"), *columns)
    asked = shards.select(F.explode(F.transform(lines, lambda d: d * across + part)).alias("tile"), F.lit(True).alias("is_shard"), *columns)
    dealt = asking.union(asked).repartition(max(n, across * down), "tile").sortWithinPartitions("tile", "is_shard")
    # A row of blobs holds some MB. Written, so that a lost executor costs no more than its tiles.
    with batches_of(spark, BLOBS):
        found = written(dealt.mapInArrow(_search(k), "query_id long, vec_id long, score long"), "found")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
