"""Exact quantiles of groups of any size.

The engine's own percentile keeps a table of a group's values in one task. That is right for groups up to TABLE_ROWS rows, which
one count decides. With a larger group, values are counted first, ranked over range partitions, and picked by rank: no
task holds a group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.operators.ordered import running
from runledger.session import stored

#: Rows of a group whose values one task may hold.
TABLE_ROWS = 500_000


def quantiles(df: DataFrame, groups: Sequence[str], wanted: Mapping[str, tuple[str, float]]) -> DataFrame:
    """groups and, under each name, the quantile (column, share) of a group, between neighbours by their distance.

    Nulls don't count; NaN is the largest value. A group without a value has null.
    """
    groups = list(groups)
    columns = sorted({c for c, _ in wanted.values()})
    most = df.groupBy(*groups).count().agg(F.max("count")).first()[0] or 0
    if most <= TABLE_ROWS:
        return df.groupBy(*groups).agg(*[F.percentile(c, F.lit(float(q))).alias(n) for n, (c, q) in wanted.items()])
    out = stored(df.select(*groups).distinct() if groups else df.groupBy().agg(F.lit(1).alias("_one")), "groups")
    for c in columns:
        counts = df.where(F.col(c).isNotNull()).groupBy(*groups, F.col(c).cast("double").alias("_v")).agg(F.count("*").alias("_c"))
        ranked = running(counts, groups, ["_v"], {"_lo": "_c"}, totals={"_n": "_lo"})
        picked = []
        for n, (of, q) in wanted.items():
            if of == c:
                at = F.lit(float(q)) * (F.col("_n") - 1)
                lower, upper = F.floor(at), F.ceil(at)
                value = lambda r: F.max(F.when((F.col("_lo") <= r) & (F.col("_lo") + F.col("_c") > r), F.col("_v")))
                share = F.max(at - lower)
                # Written as the engine's percentile, so both ways give one value.
                between = (1 - share) * value(lower) + share * value(upper)
                picked.append(F.when(value(lower).eqNullSafe(value(upper)), value(lower)).otherwise(between).alias(n))
        if groups:
            found = ranked.groupBy(*groups).agg(*picked).withColumnsRenamed({g: f"_f_{g}" for g in groups})
            out = out.join(found, [F.col(g).eqNullSafe(F.col(f"_f_{g}")) for g in groups], "left").drop(*[f"_f_{g}" for g in groups])
        else:
            out = out.crossJoin(F.broadcast(ranked.agg(*picked)))
    return out.select(*groups, *wanted)
