"""Writers of result tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from runledger.checks import conform


def write_csv(df: DataFrame, path: str, by: Sequence[str] = (), mode: str = "error") -> None:
    """CSV with a header; one folder for each value of the `by` columns."""
    df.write.mode(mode).partitionBy(*by).option("header", True).csv(path)


def write_run_store(df: DataFrame, root: str, mode: str = "error") -> None:
    """Parquet files in a folder for each run and iteration; rows of one folder are written by one task."""
    df.repartition("dataset_id", "iteration").write.mode(mode).partitionBy("dataset_id", "iteration").parquet(root)


def write_json(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).json(path)


def write_folded(stacks: DataFrame, path: str, mode: str = "error") -> None:
    """Lines `stack samples` for external viewers."""
    stacks.select(F.concat_ws(" ", "stack", F.col("samples").cast("string")).alias("value")).write.mode(mode).text(path)


def write_text(lines: DataFrame, path: str, compress: bool = False, mode: str = "error") -> None:
    """A column `value` as lines, optionally gzipped."""
    lines.select("value").write.mode(mode).text(path, compression="gzip" if compress else "none")


def write_regions(traffic: DataFrame, path: str, mode: str = "error") -> None:
    """Region traffic in bytes, by name."""
    write_csv(traffic.select("name", *[c for c in traffic.columns if c.endswith(("_count", "_bytes"))]), path, mode=mode)


def write_conforming(df: DataFrame, schema: StructType, path: str, allowed: Mapping[str, Sequence[str]] | None = None, mode: str = "error") -> dict[str, int]:
    """The rows that keep the schema's rules as Parquet; returns how many rows there were and how many break each rule, counted
    in the same pass."""
    seen = Observation("violations")
    conform(df, schema, allowed, violations=seen).write.mode(mode).parquet(path)
    return dict(seen.get)
