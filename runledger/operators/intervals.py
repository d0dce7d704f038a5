"""Ranges and intervals: range and nearest joins, sweeps, regions, iteration windows."""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runledger.operators.ordered import filled, running
from runledger.session import stored

#: Pieces of ranges up to which that side of a range join is broadcast.
BROADCAST_ROWS = 40_000
#: Buckets of a level are so many times as wide as those of the level below.
FACTOR = 4
#: Bits of a bucket's number in which a double tells all buckets apart.
EXACT_BITS = 52


def _kind(*types: T.DataType) -> str:
    """How bounds and positions of these types are cut into buckets."""
    if all(isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) for t in types):
        return "whole"
    return "double" if any(isinstance(t, (T.FloatType, T.DoubleType)) for t in types) else "decimal"


def _cell(x: Column, level: int, kind: str) -> Column:
    """The bucket of FACTOR^level units that x is in; never falls where x rises."""
    if kind == "whole":
        return F.shiftright(x.cast("long"), 2 * level)
    if kind == "decimal":
        return F.floor(F.try_divide(x, F.lit(Decimal(FACTOR) ** level))).cast("long")
    largest = sys.float_info.max
    return F.floor(F.greatest(F.lit(-largest), F.least(F.lit(largest), x.cast("double"))) / F.lit(float(FACTOR) ** level))


def _levels(ranges: DataFrame, low: str, high: str, kind: str, bucket: float | None, spread: float = 4) -> tuple[Column, dict[int, int], float]:
    """(the level of a range by its own width, the level that each of these is dealt at, pieces of all ranges at most).

    A level is left out if its ranges, cut into buckets of a finer one, are few beside all ranges: pieces stay below `spread` a
    range (two are the least). One aggregate.
    """
    exact = {"whole": "decimal(20,0)", "double": "double"}.get(kind)
    a, z = (F.col(c).cast(exact) if exact else F.col(c) for c in (low, high))
    width = F.least(F.lit(sys.float_info.max), (z - a).cast("double"))
    # A long has no more bits to shift, a double no larger power.
    most = {"whole": 31, "decimal": 60, "double": 510}[kind]
    own = F.least(F.lit(most), F.ceil(F.log(width) / F.log(F.lit(float(FACTOR)))))
    least = 0 if bucket is None else math.ceil(math.log(bucket, FACTOR) - 1e-9)
    # Buckets that a number can tell apart, also at the bound that is furthest from zero.
    bits = {"whole": None, "decimal": 61, "double": EXACT_BITS}[kind]
    furthest = F.max(F.greatest(*[F.when(F.abs(F.col(c).cast("double")) < float("inf"), F.abs(F.col(c).cast("double"))) for c in (low, high)]))
    found = ranges.where(F.col(high) > F.col(low)).groupBy(own.cast("int").alias("k")).agg(F.count("*").alias("n"), F.sum(width).alias("wide"), furthest.alias("far")).collect()
    if bits is not None:
        far = max((r["far"] or 0 for r in found), default=0)
        least = max(-510 if kind == "double" and bucket is None else least, math.ceil((math.log2(far) if far else -1020) / 2 - bits / 2))
    counts: dict[int, int] = {}
    wide: dict[int, float] = {}
    for r in found:
        k = max(least, r["k"])
        counts[k] = counts.get(k, 0) + r["n"]
        wide[k] = wide.get(k, 0.0) + r["wide"]
    dealt, pieces, total, at = {}, 0, sum(counts.values()), least
    for k in sorted(counts):
        # A range meets a bucket for each of its widths, and one more.
        cut = wide[k] / FACTOR**at + counts[k] if dealt and k - at < 31 else None
        if cut is None or pieces + cut > spread * total + 1000:
            at, cut = k, 2 * counts[k]
        dealt[k] = at
        pieces += cut
    return F.greatest(F.lit(least), own).cast("int"), dealt, pieces


def range_join(points: DataFrame, ranges: DataFrame, at: str, low: str, high: str, how: str = "inner", bucket: float | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Points with every range low <= at < high, within equal keys.

    Each range is dealt at the level of its own width, into the two or so buckets of that width that it touches; a point is
    asked once at each level that has ranges, so the join is an equi-join and one wide range changes nothing for narrow ones.
    Few pieces of ranges are broadcast, by their number. Buckets are `bucket` units wide at least. Of a left join over
    several levels, the points without a range are those that no level holds. Null positions and bounds hold nothing;
    infinite bounds are bounds.
    """
    kind = _kind(points.schema[at].dataType, ranges.schema[low].dataType, ranges.schema[high].dataType)
    # Each further level costs an inner join a copy of its points, a left join an anti-join too.
    level, dealt_at, pieces = _levels(ranges, low, high, kind, bucket, 4 if how == "left" else 2.5)
    levels = sorted(set(dealt_at.values())) or [0]
    own = F.create_map(*[F.lit(x) for pair in dealt_at.items() for x in pair])[level] if dealt_at else F.lit(0)
    first, last = F.lit(None).cast("long"), F.lit(None).cast("long")
    upper = F.col(high) - 1 if kind == "whole" else F.col(high)
    for k in levels:
        first = F.when(F.col("_level") == k, _cell(F.col(low), k, kind)).otherwise(first)
        last = F.when(F.col("_level") == k, _cell(upper, k, kind)).otherwise(last)
    named = {k: f"_key_{i}" for i, k in enumerate(keys)}
    dealt = ranges.withColumnsRenamed(named).where(F.col(high) > F.col(low)).withColumn("_level", own).withColumn("_bucket", F.explode(F.sequence(first, last)))
    if pieces <= BROADCAST_ROWS:
        dealt = F.broadcast(dealt)
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in named.items()]
    inside = (F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))
    out = [*points.columns, *[c for c in ranges.columns if c not in named]]

    def asked(df: DataFrame, at_levels: Sequence[int]) -> DataFrame:
        cells = [F.struct(F.lit(k).alias("level"), _cell(F.col(at), k, kind).alias("bucket")) for k in at_levels]
        # One level needs no copies.
        cell = F.explode(F.array(*cells)) if len(cells) > 1 else cells[0]
        return df.withColumn("_c", cell).select(*df.columns, F.col("_c.level").alias("_asked"), F.col("_c.bucket").alias("_in"))

    on = [*same, F.col("_asked") == F.col("_level"), F.col("_in") == F.col("_bucket"), inside]
    if how == "inner" or len(levels) == 1:
        return asked(points, levels).join(dealt, on, how).select(*out)
    if how != "left":
        raise ValueError(f"a range join is inner or left, not {how}")
    points = stored(points, "points")
    rest = points
    for k in levels:
        rest = asked(rest, [k]).join(dealt.where(F.col("_level") == k), on, "left_anti").select(*points.columns)
    return asked(points, levels).join(dealt, on).select(*out).unionByName(rest, allowMissingColumns=True)


def nearest_lower(points: DataFrame, table: DataFrame, at: str, start: str, columns: Sequence[str], keys: Sequence[str] = (), exact: bool = False) -> DataFrame:
    """Each point with the columns of the table row of the largest start at or below it, null below the first.

    Both sides are sorted together by key and position into range partitions, which carry the last start of one into the
    next; no pairs are formed, and a key may fill many tasks. exact: an equi-join. Several table rows with one start: the
    largest columns count.
    """
    names = [f"_t_{c}" for c in columns]
    best = table.groupBy(*keys, start).agg(F.max(F.struct(*[F.col(c).alias(n) for c, n in zip(columns, names, strict=True)])).alias("_t"))
    if exact:
        right = best.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col(start).alias("_start"), "_t")
        joined = points.join(right, [points[at] == right["_start"], *[points[k].eqNullSafe(right[f"_k_{k}"]) for k in keys]], "left").drop("_start", *[f"_k_{k}" for k in keys])
        return joined.select(*points.columns, *[F.col(f"_t.{n}").alias(c) for n, c in zip(names, columns, strict=True)])
    probes = points.select(*[F.col(k) for k in keys], F.col(at).alias("_at"), F.lit(1).alias("_kind"), F.struct(*points.columns).alias("_row"), F.lit(None).cast(best.schema["_t"].dataType).alias("_t"))
    starts = best.select(*keys, F.col(start).alias("_at"), F.lit(0).alias("_kind"), F.lit(None).cast(probes.schema["_row"].dataType).alias("_row"), "_t")
    both = filled(starts.unionByName(probes), keys, ["_at", "_kind"], "_t")
    return both.where("_kind = 1").select("_row.*", *[F.col(f"_t.{n}").alias(c) for n, c in zip(names, columns, strict=True)])


def resolve_symbols(points: DataFrame, symbols: DataFrame, at: str, space: str, start: str, name: str, shared: str = "shared") -> DataFrame:
    """Nearest symbol in the point's own space, then in the shared one, else unknown: adds <name> and valid."""
    own = nearest_lower(points, symbols.select(space, start, F.col(name).alias("_own")), at, start, ["_own"], [space])
    common = symbols.where(F.col(space) == shared).select(start, F.col(name).alias("_common"))
    both = nearest_lower(own, common, at, start, ["_common"])
    found = F.coalesce("_own", "_common")
    return both.withColumn(name, F.coalesce(found, F.lit("unknown"))).withColumn("valid", found.isNotNull()).drop("_own", "_common")


def merge_intervals(df: DataFrame, keys: Sequence[str], start: str, end: str, value: str) -> DataFrame:
    """Elementary intervals between all boundaries of a key, with the sum of the intervals that cover each.

    A sweep: +value at the start, -value at the end, one running sum. Boundaries are summed first, then sorted into range
    partitions, each begun at the sums of the ones before and ended at the first boundary of the next, so one key
    may fill many tasks. Intervals that nothing covers, and those of zero length, are left out.
    """
    ends = F.explode(F.array(F.struct(F.col(start).alias("at"), F.col(value).alias("v"), F.lit(1).alias("n")), F.struct(F.col(end).alias("at"), (-F.col(value)).alias("v"), F.lit(-1).alias("n"))))
    points = df.where(F.col(end) > F.col(start)).select(*keys, ends.alias("e")).groupBy(*keys, F.col("e.at").alias("start")).agg(F.sum("e.v").alias("v"), F.sum("e.n").alias("n"))
    swept = running(points, keys, ["start"], {"value": "v", "covers": "n"}, following={"end": "start"})
    swept = swept.select(*keys, "start", "end", (F.col("value") + F.col("v")).alias("value"), (F.col("covers") + F.col("n")).alias("covers"))
    return swept.where("covers > 0 and end is not null")


def covered(points: DataFrame, ranges: DataFrame, at: str, low: str, high: str, name: str = "covers", keys: Sequence[str] = ()) -> DataFrame:
    """Points that some range low <= at < high of equal keys holds, with the number of these ranges.

    Ranges are swept first, so a point meets the one elementary interval that it lies in: the rows are no more than the
    points, however many ranges lie over one another. Keys are not null.
    """
    swept = merge_intervals(ranges.select(*keys, F.col(low).alias("_from"), F.col(high).alias("_to"), F.lit(0).alias("_v")), keys, "_from", "_to", "_v")
    pieces = stored(swept.select(*keys, F.col("start").alias("_low"), F.col("end").alias("_high"), F.col("covers").alias("_covers")), "covers")
    return range_join(points, pieces, at, "_low", "_high", keys=keys).select(*points.columns, F.col("_covers").alias(name))


def sum_equal_intervals(df: DataFrame, keys: Sequence[str], start: str, end: str, value: str) -> DataFrame:
    """The strict form: only intervals with the same bounds are added up; sums of zero are left out."""
    return df.groupBy(*keys, F.col(start).alias("start"), F.col(end).alias("end")).agg(F.sum(value).alias("value")).where("value <> 0")


def iteration_windows(markers: DataFrame, runs: DataFrame, run: Sequence[str], ts: str) -> DataFrame:
    """[start, end) of each iteration: from a marker to the next; the last, or all without markers, without end.

    Markers are numbered over range partitions, so a run may fill many tasks.
    """
    numbered = running(markers.select(*run, F.col(ts).alias("start")), run, ["start"], {"iteration": "1"}, following={"end": "start"})
    cut = numbered.select(*run, F.col("iteration").cast("int").alias("iteration"), "start", "end")
    none = runs.select(*run).distinct().join(cut.select(*run).distinct(), list(run), "left_anti")
    kind = cut.schema["start"].dataType
    return cut.unionByName(none.select(*run, F.lit(0).alias("iteration"), F.lit(None).cast(kind).alias("start"), F.lit(None).cast(kind).alias("end")))


def with_iteration(df: DataFrame, windows: DataFrame, run: Sequence[str], ts: str) -> DataFrame:
    """Rows inside the windows that iteration_windows cuts, with their iteration: that of the last start at or before them.

    Runs without a marker are one iteration, 0; rows before a run's first marker are in none and are left out.
    """
    marked = nearest_lower(df, windows.where(F.col("start").isNotNull()), ts, "start", ["iteration"], run)
    whole = windows.where(F.col("start").isNull()).select(*[F.col(c).alias(f"_w_{c}") for c in run], F.col("iteration").alias("_whole"))
    both = marked.join(whole, [F.col(c).eqNullSafe(F.col(f"_w_{c}")) for c in run], "left")
    return both.withColumn("iteration", F.coalesce("iteration", "_whole")).where("iteration is not null").select(*df.columns, "iteration")


def within(ts: Column, start: Column, end: Column) -> Column:
    """Half-open time range; a null bound is no bound."""
    return (start.isNull() | (ts >= start)) & (end.isNull() | (ts < end))


def size_classes(sizes: DataFrame, classes: DataFrame, size: str, limit: str, keys: Sequence[str] = ()) -> DataFrame:
    """Each size with the class whose limit is the least at or above it: previous < size <= limit. The class list is a fixed small table."""
    order = Window.partitionBy(*keys).orderBy(limit)
    bounds = classes.select(*keys, (F.lag(limit, 1).over(order) + 1).alias("_low"), F.col(limit).alias("class"))
    bounds = bounds.withColumns({"_low": F.coalesce("_low", F.lit(-(1 << 62))), "_high": F.col("class") + 1})
    return range_join(sizes, bounds, size, "_low", "_high", keys=keys).drop("_low", "_high")


FETCH_BYTES = 4


def region_traffic(records: DataFrame, regions: DataFrame, pc: str = "pc", mem: str = "mem") -> DataFrame:
    """Fetches, reads and writes per address region, in counts and bytes.

    records: pc and mem, an array of (is_load, addr, size), of which the first two count. Records without a pc are skipped;
    regions may overlap. Sums by address come first, so the range join sees each address once.
    """
    rows = records.where(F.col(pc).isNotNull())
    fetch = rows.select(F.col(pc).alias("addr"), F.lit("fetch").alias("kind"), F.lit(FETCH_BYTES).cast("long").alias("size"))
    access = rows.select(F.explode(F.slice(mem, 1, 2)).alias("m")).select("m.addr", F.when(F.col("m.is_load"), "read").otherwise("write").alias("kind"), F.col("m.size").cast("long").alias("size"))
    sums = fetch.unionByName(access).groupBy("addr", "kind").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    hit = range_join(sums, regions, "addr", "start", "end")
    told = [x for k in ("fetch", "read", "write") for x in (F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(f"{k}_count"), F.sum(F.when(F.col("kind") == k, F.col("bytes")).otherwise(0)).alias(f"{k}_bytes"))]
    counts = hit.groupBy("name").agg(*told)
    names = regions.select("name").distinct().join(counts, "name", "left")
    return names.na.fill(0)
