import random

import numpy as np
from pyspark.sql import functions as F

from runledger.llm import maxscore
from runledger.llm.maxscore import Shard, top_k


def plain(rows, k=10):
    good = [(i, [int(np.floor(1024 * v)) for v in x]) for i, x in rows if i is not None and x is not None and all(v is not None and np.isfinite(v) for v in x)]
    queries = {}
    for i, x in good:
        if i % 100 == 0:
            queries[i] = max(queries.get(i, x), x)
    out = []
    for q, x in queries.items():
        scores = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in good if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    return sorted(out)


def test_shard_is_exact():
    rng = np.random.default_rng(3)
    for width, spread in ((64, 200), (8, 3), (1, 5)):
        m = rng.integers(-spread, spread, (500, width))
        m[100:140] = m[7]
        if width == 64:
            m[300:] = m[300:301] + rng.integers(-20, 20, (200, width))
        ids = rng.permutation(500)
        shard = Shard(ids, m)
        for r in (0, 7, 300, 499):
            want = sorted((-int(m[j] @ m[r]), int(ids[j])) for j in range(500) if j != r)[:10]
            assert shard.top(m[r], int(ids[r]), 10) == [(-s, i) for s, i in want]


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(maxscore, "SHARD_ROWS", 16)
    monkeypatch.setattr(maxscore, "QUERY_ROWS", 2)
    rng = random.Random(4)
    rows = [(k * 10, [rng.gauss(0, 1) for _ in range(6)]) for k in range(80)]
    rows += [(100, [1.0] * 6), (100, [1.0] * 6), (7, [1.0] * 6), (8, [1.0] * 6), (None, [1.0] * 6), (200, None), (9, [1.0, None]), (11, [float("nan")] * 6), (12, [float("inf")]), (13, []), (14, [-2.0]), (500, [0.0] * 6)]
    frame = spark.createDataFrame([(*r, 1, "s") for r in rows], "vec_id long, embedding array<double>, score int, rank string").repartition(3)
    got = sorted(tuple(r) for r in top_k(frame, F.col("vec_id") % 100 == 0).collect())
    assert got == plain(rows)
    assert top_k(frame.where(F.lit(False)), F.col("vec_id") % 100 == 0).collect() == []
    few = frame.where("vec_id in (7, 100)")
    assert [r["vec_id"] for r in top_k(few, F.col("vec_id") == 7).collect()] == [100, 100, 100]


def test_a_given_bound_leaves_what_reaches_it():
    rng = np.random.default_rng(9)
    m, ids = rng.integers(-50, 50, (400, 12)), np.arange(400)
    shard = Shard(ids, m)
    for r in range(20):
        every = shard.top(m[r], r, 10)
        bound = every[4][0]
        got = shard.top(m[r], r, 10, bound)
        assert [x for x in got if x[0] >= bound] == [x for x in every if x[0] >= bound]


def test_numbers_beyond_64_bits(spark):
    rows = [(0, [1e300, 1.0]), (1, [1e300, 0.0]), (2, [-1e300, 0.0]), (3, [1.0, 1.0]), (4, [0.0, 0.0])]
    got = top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(1, 2**63 - 1), (3, 2**63 - 1), (4, 0), (2, -(2**63))]


def test_one_id_of_a_third_of_the_rows(spark, monkeypatch):
    monkeypatch.setattr(maxscore, "SHARD_ROWS", 32)
    rng = random.Random(8)
    rows = [(300 if k % 3 == 0 else k, [float(rng.randrange(-3, 4)) for _ in range(4)]) for k in range(600)]
    got = top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4), F.col("vec_id") % 100 == 0).collect()
    assert sorted(tuple(r) for r in got) == plain(rows)


def test_tiles():
    for groups, pieces, held, n in ((1, 1, 10, 8), (3, 2, 1, 8), (1000, 640, 512, 200), (100_000, 64_000, 512, 1000), (5, 40, 8, 2)):
        across, down = maxscore._tiles(groups, pieces, held, n)
        assert 1 <= across <= groups and 1 <= down <= pieces
        assert -(-pieces // down) <= held and -(-groups // across) <= maxscore.RUN
        assert across * down >= min(n, groups * pieces) // 2


def test_a_task_goes_through_many_shards(spark, monkeypatch):
    monkeypatch.setattr(maxscore, "SHARD_ROWS", 16)
    monkeypatch.setattr(maxscore, "QUERY_ROWS", 1)
    monkeypatch.setattr(maxscore, "HELD_BYTES", 128)
    rng = random.Random(11)
    rows = [(k * 20, [rng.gauss(0, 1) if rng.random() < 0.5 else 0.0 for _ in range(8)]) for k in range(400)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4), F.col("vec_id") % 100 == 0).collect()
    assert sorted(tuple(r) for r in got) == plain(rows)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_sparse_lists_are_exact():
    rng = np.random.default_rng(12)
    m = rng.integers(-30, 30, (600, 40)) * (rng.random((600, 40)) < 0.1)
    ids = rng.permutation(600)
    shard = Shard(ids, m)
    for r in range(0, 600, 17):
        want = sorted((-int(m[j] @ m[r]), int(ids[j])) for j in range(600) if j != r)[:10]
        assert shard.top(m[r], int(ids[r]), 10) == [(-s, i) for s, i in want]
