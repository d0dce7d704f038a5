"""Reports of many lines, read by as many tasks as a file has splits.

A line's place is the start of its split and its number in the task that reads it, so lines of a file can be put in order
after they have been read apart. What a later line needs of earlier ones is found by aggregates over places (headers) or
carried from one range of lines to the next (open indentation). Lines are stored once with their places.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.operators.ordered import _ranged
from runledger.session import stored

PLACE = ("block", "place")


def placed_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """value, file, block and place of every line."""
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"))


def below_header(spark: SparkSession, path: str | Sequence[str], banner: int = 1) -> DataFrame:
    """file, header and value of the lines that aren't empty below the header, which follows so many banner rows."""
    lines = stored(placed_lines(spark, path), "lines")
    at = F.struct(*PLACE)
    top = lines.groupBy("file").agg(F.min_by("value", at).alias("header"), F.min(at).alias("top"))
    for _ in range(banner):
        upper = top.select(F.col("file").alias("_file"), F.col("top").alias("_top"))
        top = lines.join(upper, F.col("file") == F.col("_file")).where(at > F.col("_top")).groupBy("file").agg(F.min_by("value", at).alias("header"), F.min(at).alias("top"))
    # A row for each file, stored apart from the lines, so that a file of many lines can be split.
    top = stored(top.select(F.col("file").alias("_file"), "header", F.col("top").alias("_top")), "headers")
    return lines.join(top, F.col("file") == F.col("_file")).where((at > F.col("_top")) & (F.col("value") != "")).select("file", "header", "value")


def first_below(spark: SparkSession, path: str | Sequence[str], heading: str, form: str) -> DataFrame:
    """file and found: what the group of a form matches first below the first line with a heading (on that line, after it);
    null in a file without it."""
    lines = placed_lines(spark, path)
    at = F.struct(*PLACE)
    rows = lines.select("file", *PLACE, F.col("value").rlike(heading).alias("heads"), F.regexp_extract("value", form, 1).alias("any"), F.regexp_extract("value", f"{heading}.*?{form}", 1).alias("behind"))
    rows = stored(rows.where("heads or any <> ''").unionByName(lines.groupBy("file").agg(F.min("block").alias("block"), F.lit(-1).cast("long").alias("place"), F.lit(False).alias("heads"), F.lit("").alias("any"), F.lit("").alias("behind"))), "lines")
    head = rows.groupBy(F.col("file").alias("_file")).agg(F.min(F.when(F.col("heads"), at)).alias("_head"))
    joined = rows.join(head, F.col("file") == F.col("_file")).withColumn("text", F.when(at == F.col("_head"), F.col("behind")).when(at > F.col("_head"), F.col("any")))
    return joined.groupBy("file").agg(F.min_by("text", F.when(F.col("text") != "", at)).alias("found"))


# -- call graphs ---------------------------------------------------------------------------------

#: The first line of a call graph and its entries.
GRAPH = r"^@\s+(\S+)\s+\[(\d+) samples\]"
ENTRY = r"^(\s*)(\d+(?:\.\d+)?)%\s+\[(\d+)\]\s+(\S+)"

_OPEN = "array<struct<depth:int,name:string>>"


def _push(open_: list[tuple[int, str]], depth: int, name: str) -> None:
    """An entry closes those that are as deep as itself or deeper."""
    while open_ and open_[-1][0] >= depth:
        open_.pop()
    open_.append((depth, name))


def _frames(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple[int, str], pd.DataFrame]]:
    """Rows sorted by range and file, as frames of one of each."""
    for pdf in batches:
        for key, rows in pdf.groupby(["_range", "file"], sort=False):
            yield key, rows


def _ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each range of a file: its first and least depth, and what it leaves open."""
    at, first, least, open_ = None, 0, 0, []
    columns = ["_range", "file", "first", "least", "open"]
    for key, rows in _frames(batches):
        if key != at:
            if at is not None:
                yield pd.DataFrame([(*at, first, least, open_)], columns=columns)
            at, first, least, open_ = key, int(rows["depth"].iloc[0]), 1 << 30, []
        for depth, name in zip(rows["depth"], rows["name"]):
            least = min(least, depth)
            _push(open_, int(depth), name)
    if at is not None:
        yield pd.DataFrame([(*at, first, least, open_)], columns=columns)


def _carried(pdf: pd.DataFrame) -> pd.DataFrame:
    """The ranges of one file, in order: what is open where each begins, and the depth that follows it (-1 at the end)."""
    out, open_ = [], []
    pdf = pdf.sort_values("_range")
    following = [*pdf["first"].tolist()[1:], -1]
    for range_, file, least, left, after in zip(pdf["_range"], pdf["file"], pdf["least"], pdf["open"], following):
        out.append((range_, file, open_, after))
        open_ = [e for e in open_ if e[0] < least] + [(e["depth"], e["name"]) for e in left]
    return pd.DataFrame(out, columns=["_range", "file", "open", "after"])


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The stack of each leaf; a range of a file begins with the row that is carried to it."""
    open_: list[tuple[int, str]] = []
    last, after = None, -1

    def leaf(file: str, following: int) -> list[tuple[str, str, int]]:
        return [(file, ";".join(n for _, n in reversed(open_)), last[1])] if last is not None and following <= last[0] else []

    at = None
    for key, rows in _frames(batches):
        out = []
        if key != at:
            if at is not None:
                out += leaf(at[1], after)
            carried = rows.iloc[0]
            at, last, after = key, None, int(carried["after"])
            open_ = [(e["depth"], e["name"]) for e in carried["open"]]
            rows = rows.iloc[1:]
        for depth, name, samples in zip(rows["depth"], rows["name"], rows["samples"]):
            out += leaf(key[1], depth)
            _push(open_, int(depth), name)
            last = (int(depth), int(samples))
        yield pd.DataFrame(out, columns=["file", "stack", "samples"])
    if at is not None:
        yield pd.DataFrame(leaf(at[1], after), columns=["file", "stack", "samples"])


def call_graphs(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """file, counter, total, stack, samples of call-graph reports: one stack for each leaf, the leaf first.

    Equal stacks of a file are added up. A line of another form raises.
    """
    is_head, is_entry, blank = F.col("value").rlike(GRAPH), F.col("value").rlike(ENTRY), F.trim("value") == ""
    take = lambda form, k: F.regexp_extract("value", form, k)
    odd = F.raise_error(F.concat("file", F.lit(": not an entry: "), "value")).cast("int")
    kind = F.when(is_head, 0).when(is_entry, 1).when(blank, 2).otherwise(odd)
    depth = F.when(is_entry, F.length(take(ENTRY, 1)))
    lines = placed_lines(spark, path).select("file", *PLACE, kind.alias("kind"), F.when(is_head, take(GRAPH, 1)).alias("counter"), F.when(is_head, take(GRAPH, 2).try_cast("bigint")).alias("total"), depth.alias("depth"), take(ENTRY, 4).alias("name"), take(ENTRY, 3).try_cast("bigint").alias("samples"))
    lines = stored(lines, "lines")
    heads = lines.groupBy("file").agg(F.min_by("kind", F.struct(*PLACE)).alias("first"), F.count_if(F.col("kind") == 0).alias("heads"), F.max("counter").alias("counter"), F.max("total").alias("total"))
    bad = heads.where("first <> 0 or heads <> 1").take(1)
    if bad:
        raise ValueError(f"{bad[0]['file']}: not a call graph")

    entries = lines.where("kind = 1").select("file", *PLACE, "depth", "name", "samples")
    ranged, by = _ranged(entries, ["file"], PLACE)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ends = ranged.repartition(n, "_range").sortWithinPartitions("_range", "file", *by).select("_range", "file", "depth", "name").mapInPandas(_ends, f"_range int, file string, first int, least int, open {_OPEN}")
    # A row for each range of a file.
    carried = stored(ends.groupBy("file").applyInPandas(_carried, f"_range int, file string, open {_OPEN}, after int"), "open")
    both = ranged.withColumn("_line", F.lit(1)).unionByName(carried.withColumn("_line", F.lit(0)), allowMissingColumns=True)
    sorted_ = both.repartition(n, "_range").sortWithinPartitions("_range", "file", "_line", *by).select("_range", "file", "depth", "name", "samples", "open", "after")
    stacks = sorted_.mapInPandas(_walk, "file string, stack string, samples bigint").groupBy("file", "stack").agg(F.sum("samples").alias("samples"))
    told = stored(heads.select(F.col("file").alias("_file"), "counter", "total"), "headers")
    return stacks.join(told, F.col("file") == F.col("_file")).select("file", "counter", "total", "stack", "samples")
