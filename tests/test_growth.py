"""What queries do where their work would grow faster than their tables."""

from pyspark.sql import functions as F

from runledger.functions import scalars
from runledger.operators import intervals as iv
from runledger.operators import layouts
from runledger.plans import layouts as layout_plans
from runledger.plans import registry, stores
from runledger.sources import readers

SF = "/root/testdata/sf0.001"


def test_bands_over_one_another_form_no_pairs(spark, tmp_path):
    # 4 * 10^9 pairs of a price and a band.
    n = 64_000
    spark.range(n).select(F.col("id").alias("p_partkey"), F.lit(900.0).alias("p_retailprice"), (F.col("id") % 2 + 1).cast("int").alias("p_size")).write.parquet(f"{tmp_path}/part.parquet")
    lines = spark.range(n).select((F.col("id") % 4).alias("l_partkey"), F.lit(1.0).alias("l_quantity"), (F.lit(899.5) + (F.col("id") % 4) * 0.25 + F.floor(F.col("id") / 4) * 0.0).alias("l_extendedprice"))
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    got = registry.QUERIES["range_join_bands"](spark, str(tmp_path)).collect()
    # Cents 89950 to 90025; bands begin at 90000 and end at 90040 or 90080.
    assert sorted(map(tuple, got)) == [(2, n, n // 4 * n), (3, n, n // 4 * n)]
    many = spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias("at"))
    wide = spark.range(n).select(F.lit(1).alias("k"), (F.col("id") - n).alias("low"), F.col("id").alias("high"))
    held = iv.covered(many, wide, "at", "low", "high", keys=["k"])
    # Of the ranges [i - n, i), those with i above the point hold it: n - 1 - at.
    assert held.agg(F.count("*"), F.sum((F.col("covers") != n - 1 - F.col("at")).cast("int"))).first()[:] == (n - 1, 0)


def test_covered_is_the_range_join_counted(spark):
    ranges = [(1, 0, 10), (1, 5, 7), (1, 7, 7), (1, 9, 3), (2, -4, 6), (2, None, 5), (2, 6, 8), (1, 5, 7)]
    points = [(k, at) for k in (1, 2, 3) for at in (-5, -4, 0, 4, 5, 6, 7, 8, 9, 10)] + [(1, None), (1, 5)]
    p, r = spark.createDataFrame(points, "k int, at long"), spark.createDataFrame(ranges, "k int, low long, high long")
    got = sorted(tuple(x) for x in iv.covered(p, r, "at", "low", "high", keys=["k"]).collect())
    count = lambda k, at: sum(k == key and None not in (at, low, high) and low <= at < high for key, low, high in ranges)
    assert got == sorted((k, at, count(k, at)) for k, at in points if count(k, at))


def test_nested_totals_broadcast_nothing(spark, monkeypatch):
    written = []
    keep = layouts.stored
    monkeypatch.setattr(layouts, "stored", lambda df, tag: written.append(df) or keep(df, tag))
    out = registry.QUERIES["nested_rollup"](spark, "/root/testdata/sf0.001")
    out.collect()
    joins = 0
    for df in [*written, out]:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan
        joins += plan.count("SortMergeJoin")
    assert joins > 2


def test_near_widths_share_a_level(spark):
    # Sizes of functions: a quarter each of 4, 8, 12 and 16 bytes, level 1 and 2 by their widths.
    code = spark.range(2_000).select((F.col("id") * 16).alias("low"), (F.col("id") * 16 + 4 + F.col("id") % 4 * 4).alias("high"))
    assert set(iv._levels(code, "low", "high", "whole", None)[1].values()) == {1}
    at = spark.range(0, 32_000, 4).withColumnRenamed("id", "at")
    found = iv.range_join(at, code, "at", "low", "high", how="left")
    assert "LeftAnti" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.agg(F.count("*"), F.count("low"), F.sum(F.col("at") - F.col("low"))).first()[:] == (8_000, 5_000, sum(4 * j for i in range(2_000) for j in range(i % 4 + 1)))


def test_calls_and_differences_read_traces_once(spark, monkeypatch):
    def none(df, tag):
        raise AssertionError(f"{tag} are stored for nothing")

    monkeypatch.setattr(iv, "stored", none)
    calls = registry.QUERIES["called_functions"](spark, SF)
    assert calls._jdf.queryExecution().executedPlan().toString().count("Join") == 1
    written = []
    keep = stores.stored
    monkeypatch.setattr(stores, "stored", lambda df, tag: written.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df, tag))
    registry.QUERIES["instruction_difference"](spark, SF).collect()
    # The listing of symbols and the traces of all targets.
    assert sum(p.count("FileScan text") for p in written) == 2
    written.clear()
    out = registry.QUERIES["instructions_per_call"](spark, SF)
    assert sum(p.count("FileScan text") for p in written) == 2
    # Medians of instructions and calls together, joined with the baseline's alone.
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") == 1


def test_instructions_by_one_match_a_line(spark):
    lines = ["[0:7] ffffffffffffffff: 0x1 a\x01b  x\x01y\tz ", "[1:8]\t0x0: 2 nop", "[0:1] something else", "[0:2] 0x8000000000000000: 0x3 str w1, [x2]", None, " [0:3] 0x1: 0x1 nop"]
    got = readers.parse_instructions(spark.createDataFrame([(x, k) for k, x in enumerate(lines)], "value string, k int"))
    want = [(0, 0, 7, 2**64 - 1, 2**63 - 1, "1", "a\x01b", "x\x01y\tz"), (1, 1, 8, 0, -(2**63), "2", "nop", ""), (3, 0, 2, 2**63, 0, "3", "str", "w1, [x2]")]
    assert sorted(tuple(r) for r in got.select("k", "cpu", "line", F.col("pc").cast("decimal(20,0)"), "address", "opcode", "mnemonic", "operands").collect()) == want
    assert [int(r[0], 16) for r in got.orderBy("k").select(scalars.ordered_to_hex(F.col("address"))).collect()] == [2**64 - 1, 0, 2**63]
    assert [r[0] for r in got.orderBy("k").select(scalars.ordered_decimal(F.col("pc")) == F.col("address")).collect()] == [True] * 3


def test_members_are_made_once_for_alias_pairs(spark, monkeypatch):
    written = []
    keep = layout_plans.stored
    monkeypatch.setattr(layout_plans, "stored", lambda df, tag: written.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df, tag))
    out = registry.QUERIES["alias_pairs"](spark, SF)
    # One exchange for both windows; the joins read what was written.
    assert [p.count("Exchange") for p in written] == [1]
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
    # Widths from 1 to 50 keep the level of their own in an inner join.
    spread = spark.range(5_000).select((F.col("id") * 60).alias("low"), (F.col("id") * 60 + 1 + F.col("id") % 50).alias("high"))
    assert iv._levels(spread, "low", "high", "whole", None, 2.5)[2] <= 2.5 * 5_000 + 1_000
