"""Compression of vectors to codes, one byte a part, by codebooks that are trained and searched in integers alone.

Components become floor(1024 * x). Vectors are cut into equal consecutive parts; each part position has a codebook
of at most 256 entries, begun with the vectors of the smallest ids and improved by rounds of assigning and
averaging. Parts and entries are padded with zeros to a power of two and go through an integer Walsh-Hadamard transform,
which scales every squared distance by the padded width. Scaled squared differences are added up in the order of sequency,
coarse shapes first. One full distance, that to the entry that looks best after the first coefficients, bounds
the rest: an entry is dropped as soon as its sum so far is above it. Sums equal to the bound stay, so ties go to the lower
index, and nothing is rounded.

Tasks assign the vectors of their partition and send one row per entry with the sum of its parts; the driver gets the new
codebook, whose size is parts * entries * width whatever the number of vectors. Sums travel as decimal text: they have no
widest value.

Rows whose vector is null or holds null, NaN or infinite components are left out. Shorter vectors, and those whose
length is no multiple of the number of parts, count as padded with zeros at the end; an empty one is all zeros. Of equal ids
the lesser vector comes first, null ids come last. Components beyond 64-bit arithmetic are computed with unbounded integers;
an error that a long can't hold is null, as is a label's sum of such. Null labels are one label; repeated rows are coded each
by itself. Other columns of the table, whatever their names, play no part. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runledger.llm.common import small_batches, tasks, written

PARTS, ENTRIES, ROUNDS = 4, 256, 4
#: Fixed value of the contract: components are multiples of 1 / SCALE.
SCALE = 1024
#: Coefficients that all entries are compared in, and those between two looks at the bound.
HEAD, STEP = 4, 4
#: Vectors of an Arrow batch, so that a comparison of all with all entries stays in the cache.
BATCH = 512

#: The entries of each part position.
Codebooks = list[list[list[int]]]


def integers(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) of finite doubles: 64-bit integers, or unbounded ones if any is too large."""
    if len(values) == 0 or np.abs(values).max() < 2.0**50:
        return np.floor(values * SCALE).astype(np.int64)
    # Doubles from 2^52 on are whole.
    return np.array([int(x) * SCALE if abs(x) >= 2.0**52 else int(np.floor(x * SCALE)) for x in values.tolist()], object)


def padded_width(width: int) -> int:
    """The least power of two that a part of this width fits."""
    return 1 << max(0, width - 1).bit_length()


def sequency(n: int) -> np.ndarray:
    """Rows of the transform of size n, a power of two, in the order of how often they change sign."""
    bits = n.bit_length() - 1
    changes = np.zeros(n, np.int64)
    for k in range(bits):
        # Bits in reverse are a Gray code of the changes.
        changes |= ((np.arange(n) >> k) & 1) << (bits - 1 - k)
    for k in (1, 2, 4, 8, 16, 32):
        changes ^= changes >> k
    return np.argsort(changes)


def transform(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row, padded with zeros, its coefficients in the order of sequency."""
    n = padded_width(x.shape[1])
    out = np.zeros((len(x), n), x.dtype)
    out[:, : x.shape[1]] = x
    half = 1
    while half < n:
        pairs = out.reshape(len(x), n // (2 * half), 2, half)
        out = np.stack((pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]), 2).reshape(len(x), n)
        half *= 2
    return out[:, sequency(n)]


def nearest(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each transformed point the first of the nearest transformed entries, and the squared distance times the width."""
    so_far = sum((points[:, j, None] - entries[None, :, j]) ** 2 for j in range(min(HEAD, points.shape[1])))
    guess = so_far.argmin(1)
    bound = ((points - entries[guess]) ** 2).sum(1)
    rows, which = np.nonzero(so_far <= bound[:, None])
    so_far = so_far[rows, which]
    for j in range(HEAD, points.shape[1], STEP):
        so_far = so_far + ((points[rows, j : j + STEP] - entries[which, j : j + STEP]) ** 2).sum(1)
        alive = so_far <= bound[rows]
        rows, which, so_far = rows[alive], which[alive], so_far[alive]
    # Each row keeps at least the guess; its candidates are in the order of entries.
    starts = np.flatnonzero(np.diff(rows, prepend=-1))
    least = np.minimum.reduceat(so_far, starts)
    hits = np.flatnonzero(so_far == least[rows])
    first = hits[np.flatnonzero(np.diff(rows[hits], prepend=-1))]
    return which[first], least


def matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """The vectors of a batch as rows of integers, padded with zeros to the width."""
    flat = integers(column.flatten().to_numpy(zero_copy_only=False))
    lengths = np.diff(column.offsets.to_numpy())
    if len(lengths) and (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), flat.dtype)
    at = np.repeat(np.arange(len(lengths)), lengths)
    out[at, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


class Coder:
    """Nearest entries of whole vectors; holds the transformed codebooks."""

    def __init__(self, books: Codebooks) -> None:
        self.books, self.width = books, len(books[0][0])
        self.largest = max((abs(x) for book in books for entry in book for x in entry), default=0)
        small = self.largest < 1 << 62
        self.entries = [transform(np.array(book, np.int64 if small else object).reshape(len(book), self.width)) for book in books]

    def codes(self, x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each part position the indexes and the squared distances of the rows of x."""
        n = padded_width(self.width)
        most = max(self.largest, int(abs(x).max()) if x.size else 0)
        # The largest sum: the padded width times all squared differences.
        fits = n * max(1, self.width) * (2 * most) ** 2 < 1 << 62
        x = x.astype(np.int64 if fits else object)
        out = []
        for k, entries in enumerate(self.entries):
            which, scaled = nearest(transform(x[:, k * self.width : (k + 1) * self.width]), entries.astype(x.dtype))
            out.append((which, scaled // n))
        return out


def _sums(coder: Coder):
    """Rows (part, entry, n, sums): the parts of this task that are nearest to each entry, added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, entries, width = len(coder.books), len(coder.books[0]), coder.width
        counts = np.zeros((parts, entries), np.int64)
        sums = np.zeros((parts, entries, width), object)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column(0), parts * width)
            for k, (which, _) in enumerate(coder.codes(x)):
                own = np.zeros((entries, width), x.dtype)
                np.add.at(own, which, x[:, k * width : (k + 1) * width])
                sums[k] += own
                counts[k] += np.bincount(which, minlength=entries)
        k, e = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(e, pa.int32()), pa.array(counts[k, e]), pa.array([[str(v) for v in s] for s in sums[k, e]], pa.list_(pa.string()))], names=["part", "entry", "n", "sums"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, entry, mean): the sums of all tasks, divided and rounded down; there are as many as entries at most."""
    found: dict[tuple[int, int], list] = {}
    for batch in batches:
        for part, entry, n, sums in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own = found.setdefault((part, entry), [0, [0] * len(sums)])
            own[0] += n
            own[1] = [a + int(b) for a, b in zip(own[1], sums, strict=True)]
    rows = [(part, entry, [str(s // n) for s in sums]) for (part, entry), (n, sums) in found.items()]
    part, entry, mean = zip(*rows, strict=True) if rows else ([], [], [])
    yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(mean, pa.list_(pa.string()))], names=["part", "entry", "mean"])


def valid(vectors: DataFrame, id_col: str, vector_col: str, label_col: str | None) -> DataFrame:
    """(id, label, x) of the rows whose vectors can be coded, in the shared folder."""
    x = F.col(vector_col).cast("array<double>")
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    label = F.lit(None).cast("int") if label_col is None else F.col(label_col)
    kept = vectors.where(x.isNotNull() & ~F.coalesce(odd, F.lit(False)))
    return written(kept.select(F.col(id_col).alias("id"), label.alias("label"), x.alias("x")), "vectors")


def train(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks of the table that valid() gives; none if it has no rows."""
    longest = kept.agg(F.max(F.size("x"))).first()[0]
    if longest is None:
        return []
    width = -(-longest // parts)
    first = [r[0] for r in kept.orderBy(F.col("id").asc_nulls_last(), "x").limit(entries).select("x").collect()]
    rows = [[int(v) for v in integers(np.array(x, float))] + [0] * (parts * width - len(x)) for x in first]
    books = [[row[k * width : (k + 1) * width] for row in rows] for k in range(parts)]
    n = tasks(kept.sparkSession)
    for _ in range(rounds):
        sent = kept.select("x").mapInArrow(_sums(Coder(books)), "part int, entry int, n long, sums array<string>")
        for part, entry, mean in sent.repartition(n, "part", "entry").mapInArrow(_added, "part int, entry int, mean array<string>").collect():
            books[part][entry] = [int(v) for v in mean]
    return books


def digest(books: Codebooks) -> str:
    """SHA-256 of all components as decimal text."""
    return hashlib.sha256(",".join(str(v) for book in books for entry in book for v in entry).encode()).hexdigest()


def _encoded(coder: Coder, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found = coder.codes(matrix(batch.column("x"), len(coder.books) * coder.width))
            codes = ["".join(f"{i:02x}" for i in row) for row in zip(*(which.tolist() for which, _ in found), strict=True)]
            errors = [sum(row) for row in zip(*(error.tolist() for _, error in found), strict=True)]
            columns = [batch.column("id"), batch.column("label"), pa.array(codes), pa.array([e if e < 1 << 63 else None for e in errors], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=schema)

    return run


def encode(kept: DataFrame, books: Codebooks) -> DataFrame:
    """(id, label, code, error) of the table that valid() gives: two hex digits for each part, squared distance in all."""
    schema = T.StructType([kept.schema["id"], kept.schema["label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    if not books:
        return kept.select("id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).where("false")
    return kept.mapInArrow(_encoded(Coder(books), schema.names), schema)


def decode(code: str, books: Codebooks) -> list[int]:
    """The integers that stand for a vector with this code."""
    return [v for k, book in enumerate(books) for v in book[int(code[2 * k : 2 * k + 2], 16)]]


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """For each vector that can be coded: <id_col>, code, error, label, label_error, codebooks_sha256."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits a part, so there are 1 to 256 entries")
    small_batches(vectors.sparkSession, BATCH)
    kept = valid(vectors, id_col, vector_col, label_col)
    books = train(kept, parts, entries, rounds)
    coded = written(encode(kept, books), "codes")
    # Stored apart from the rows, so that a label of many rows can be split in the join.
    total = F.when(F.count("error") == F.count("*"), F.try_sum("error"))
    sums = written(coded.groupBy(F.col("label").alias("of")).agg(total.alias("label_error")), "labels")
    joined = coded.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return joined.select(F.col("id").alias(id_col), "code", "error", "label", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The same rows in DuckDB SQL, for vectors of one length and components that doubles hold exactly."""
    steps = [
        """v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS x FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"w AS MATERIALIZED (SELECT vec_id, label, k AS part, x[k * len(x) // {parts} + 1 : (k + 1) * len(x) // {parts}] AS y FROM v, range({parts}) r(k))",
        f"c0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, y AS e FROM w QUALIFY entry < {entries})",
    ]
    for r in range(rounds + 1):
        distance = "(list_inner_product(y, y) - 2 * list_inner_product(y, e) + list_inner_product(e, e))::BIGINT"
        steps.append(f"a{r} AS MATERIALIZED (SELECT vec_id, any_value(label) AS label, part, any_value(y) AS y, min(({distance}) * {entries} + entry) AS d FROM w JOIN c{r} USING (part) GROUP BY vec_id, part)")
        if r < rounds:
            steps.append(
                f"""m{r} AS (SELECT part, d % {entries} AS entry, i, floor(sum(y[i]) / count(*)) AS m FROM a{r}, range(1, len(y) + 1) t(i) GROUP BY ALL),
                l{r} AS (SELECT part, entry, list(m ORDER BY i) AS e FROM m{r} GROUP BY ALL),
                c{r + 1} AS MATERIALIZED (SELECT part, entry, coalesce(l{r}.e, c{r}.e) AS e FROM c{r} LEFT JOIN l{r} USING (part, entry))"""
            )
    steps.append(f"h AS (SELECT sha256(string_agg(x::BIGINT::VARCHAR, ',' ORDER BY part, entry, i)) AS codebooks_sha256 FROM (SELECT part, entry, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM c{rounds}))")
    steps.append(f"o AS (SELECT vec_id, any_value(label) AS label, string_agg(format('{{:02x}}', d % {entries}), '' ORDER BY part) AS code, sum(d // {entries})::BIGINT AS error FROM a{rounds} GROUP BY vec_id)")
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, label, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM o, h"
