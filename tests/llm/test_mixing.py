import re
import time
from collections import Counter
from math import comb, lgamma, log, sqrt
from statistics import NormalDist

from pyspark.sql import functions as F

from runledger.llm import mixing
from runledger.llm.mixing import draw, mix, running, sized, split

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def water(sizes, most=3.0):
    """Plain targets: share, cap, share the excess again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(most * sizes[s] for s in capped)
        level = left / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if level * weight[s] > most * sizes[s] + 1e-9}
        if not over:
            return {s: most * sizes[s] if s in capped else level * weight[s] for s in order}
        capped |= over


def check(frame):
    rows = [(r["doc_id"], r["source"], len(WORD.findall(r["text"] or ""))) for r in frame.collect()]
    sizes = Counter()
    for _, s, n in rows:
        sizes[s] += n
    want = water(sizes)
    got = mix(frame).collect()
    again = mix(frame).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((d, n) for d, _, n in rows)
    taken = Counter()
    key = {}
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[(r["source_size"], round(r["target"], 6))] += r["taken"]
    for s, t in want.items():
        key[(sizes[s], round(t, 6))] = key.get((sizes[s], round(t, 6)), 0) + t
    assert set(taken) <= set(key)
    for k, t in taken.items():
        assert abs(t - key[k]) <= 1.5 * len(sizes)
    return got


def test_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "a"), (None, "x y z", "b"), (4, "one two", None), (4, "one two", None), (5, "w " * 5000, "c"), (6, " \t", "d"), (7, "k", "é"), (8, "v " * 40, "b")]
    rows += [(100 + k, "u " * (k % 50), f"s{k % 5}") for k in range(600)]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, size int").repartition(4)
    check(frame)
    assert mix(frame.where(F.lit(False))).collect() == []


def test_sf0001(spark):
    got = check(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    assert len(got) == 200


def test_whole_copies_are_disjoint_and_near(spark):
    sizes = sized(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id", "text", "source", None)
    copies, plan = draw(sizes, whole=True)
    rows = copies.join(sizes.select("row", "source", "size"), "row").collect()
    assert len({(r["row"], r["pass"]) for r in rows}) == len(rows)
    assert all(r["words"] == r["size"] for r in rows)
    longest = max(r["size"] for r in rows)
    words = Counter()
    for r in rows:
        words[r["source"]] += r["words"]
    for p in plan.collect():
        assert abs(words[p["source"]] - p["target"]) <= longest


def test_split_keeps_quotas(spark, monkeypatch):
    for fanout in (64, 2):
        # With lists of two, four sources take two levels of draws.
        monkeypatch.setattr(mixing, "FANOUT", fanout)
        quotas = {0: 40, 1: 7, 2: 13, 3: 1}
        frame = spark.createDataFrame(list(quotas.items()), "number long, slots long")
        got = split(frame, 6, 3).collect()
        sums, shards = Counter(), Counter()
        for r in got:
            sums[r["number"]] += r["slots"]
            shards[r["shard"]] += r["slots"]
        assert dict(sums) == quotas
        assert max(shards.values()) - min(shards.values()) <= 3 and len(shards) == 6


def test_the_same_rows_give_the_same_mix_however_they_lie(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [sorted((r["doc_id"], r["taken"], tuple(r["shards"])) for r in mix(frame).collect()) for frame in (docs, docs.repartition(13), docs.orderBy("n_chars"))]
    assert rows[0] == rows[1] == rows[2]


def test_one_source_of_a_third_is_spread(spark):
    frame = spark.range(9000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 40)).alias("source"))
    # Small partitions are put together else.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranged = running(frame.withColumn("h", F.xxhash64("doc_id")), ["source"], ["h"], {"n": "1L"})
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = spark.read.parquet(*set(ranged.inputFiles())).groupBy("_range").count().collect()
    assert max(r["count"] for r in parts) < 3000


def test_hypergeometric_quantiles(spark):
    n, k, m = 20, 8, 5
    frame = spark.range(0, 1000).select(((F.col("id") + 0.5) / 1000).alias("u"))
    got = Counter(r[0] for r in frame.select(mixing._hypergeometric(F.col("u"), F.lit(n), F.lit(k), F.lit(m))).collect())
    for x in range(m + 1):
        assert abs(got[x] / 1000 - comb(k, x) * comb(n - k, m - x) / comb(n, m)) < 2e-3


def test_wide_draws_take_time_in_proportion_to_their_deviation(spark):
    quantiles = [0.001, 0.2, 0.5, 0.9]
    law = lambda n: spark.createDataFrame([(u, n) for u in quantiles], "u double, n long").coalesce(1).select("u", mixing._hypergeometric(F.col("u"), F.col("n"), F.floor(F.col("n") / 3), F.floor(F.col("n") / 2)).alias("k"))
    law(1000).collect()
    for n in (10**6, 10**8):
        began = time.perf_counter()
        got = law(n).collect()
        # Four draws; the law of wide ones is near the normal one.
        assert time.perf_counter() - began < 4
        sigma = sqrt(n / 2 * (1 / 3) * (2 / 3) / 2)
        for u, k in got:
            assert abs((k - n / 6) / sigma - NormalDist().inv_cdf(u)) < 0.02
    # Exact quantiles of a law of some thousand cells.
    n, marked, drawn = 40_000, 9_000, 15_000
    lc = lambda a, b: lgamma(a + 1) - lgamma(b + 1) - lgamma(a - b + 1)
    logs = [lc(marked, x) + lc(n - marked, drawn - x) - lc(n, drawn) for x in range(marked + 1)]
    sums, want = 0.0, {}
    for x, v in enumerate(logs):
        sums += 2.718281828459045**v if v > log(1e-300) else 0.0
        for u in quantiles:
            if sums >= u:
                want.setdefault(u, x)
    frame = spark.createDataFrame([(u,) for u in quantiles], "u double").select("u", mixing._hypergeometric(F.col("u"), F.lit(n).cast("long"), F.lit(marked).cast("long"), F.lit(drawn).cast("long")).alias("k"))
    assert {u: k for u, k in frame.collect()} == want
