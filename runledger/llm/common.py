"""What the corpus operators share: shared storage, row identity, fold numbers, Arrow helpers."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.session import fresh_path as fresh_path
from runledger.session import stored as written

#: Fixed value of the contract: a word is a run of other characters than space and \t..\r.
WORD = r"[^\x20\x09-\x0D]+"
#: Fixed value of the contract: bytes A-Z to a-z, others as they are.
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: As LOWER, and the characters \t..\r become spaces.
LOWER_SPACE = bytes.maketrans(
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz     "
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Arrow batches of few rows, since one text can be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of so many rows for the jobs that run inside; the session's own afterwards."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def tasks(spark: SparkSession, least: int = 8) -> int:
    """Shuffle partitions as the session sets them, at least `least`."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def fold(doc_id: str, n: int):
    """crc32 of the id as text, modulo n; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % n


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null becomes empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def free_name(df: DataFrame, name: str) -> str:
    """The name, with as many underscores as it needs to be none of the columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Rows of a file that a row number has room for, as bits.
INDEX_BITS = 38
#: Bytes of a table's paths up to which they are broadcast.
PATH_BYTES = 32 << 20


def with_row(df: DataFrame, name: str = "_row") -> DataFrame:
    """df with a number for each row that no two rows share and that stays the same however the table is split into tasks.

    Rows of files are numbered by the file, in the order of the paths, and their place in it, so a plan that is made
    again after executors have come or gone finds the same numbers. There is one path per file, as the driver has
    to plan a scan. Other rows are numbered and written to the shared folder.
    """
    if free_name(df, name) != name:
        raise ValueError(f"there is a column {name}")
    file, index = free_name(df, f"{name}_file"), free_name(df, f"{name}_index")
    try:
        placed = df.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(index))
    except AnalysisException:
        return written(df.withColumn(name, F.monotonically_increasing_id()), "rows")
    paths = sorted(r[0] for r in placed.select(file).distinct().collect())
    numbers = df.sparkSession.createDataFrame([(path, k << INDEX_BITS) for k, path in enumerate(paths)], f"{file} string, {name} long")
    # Without a broadcast the rows would be shuffled by their file.
    if sum(map(len, paths)) < PATH_BYTES:
        numbers = F.broadcast(numbers)
    return placed.join(numbers, file).select(*df.columns, (F.col(name) + F.col(index)).alias(name))
