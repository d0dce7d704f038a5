import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from runledger.llm import vector_codes as vc


def plain(rows, parts=4, entries=256, rounds=4):
    """(id, code, error, label, label_error, sha) by plain loops over whole integers."""
    good = [(i, l, [int(np.floor(v * 1024)) if abs(v) < 2**50 else int(v) * 1024 for v in x]) for i, l, x in rows if x is not None and all(v is not None and np.isfinite(v) for v in x)]
    if not good:
        return []
    width = -(-max(len(x) for _, _, x in good) // parts)
    good = [(i, l, x + [0] * (parts * width - len(x))) for i, l, x in good]
    cut = lambda x, k: x[k * width : (k + 1) * width]
    first = sorted(good, key=lambda r: (r[0] is None, r[0], r[2]))[:entries]
    books = [[cut(x, k) for _, _, x in first] for k in range(parts)]
    near = lambda k, y: min((sum((a - b) ** 2 for a, b in zip(y, e)), j) for j, e in enumerate(books[k]))
    for _ in range(rounds):
        for k in range(parts):
            own = {}
            for _, _, x in good:
                own.setdefault(near(k, cut(x, k))[1], []).append(cut(x, k))
            for j, ys in own.items():
                books[k][j] = [sum(c) // len(ys) for c in zip(*ys)] if width else []
    sha = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    out, sums = [], {}
    for i, l, x in good:
        found = [near(k, cut(x, k)) for k in range(parts)]
        error = sum(d for d, _ in found)
        error = error if error < 2**63 else None
        sums[l] = None if error is None or (l in sums and sums[l] is None) else sums.get(l, 0) + error
        out.append((i, "".join(f"{j:02x}" for _, j in found), error, l))
    return sorted(((*r, sums[r[3]] if sums[r[3]] is None or sums[r[3]] < 2**63 else None, sha) for r in out), key=repr)


def coded(frame, **kw):
    got = vc.compress(frame, **kw).select("vec_id", "code", "error", "label", "label_error", "codebooks_sha256").collect()
    return sorted(map(tuple, got), key=repr)


def test_sequency_order_counts_sign_changes():
    for n in (1, 2, 8, 64):
        h = np.array([[(-1) ** bin(i & j).count("1") for j in range(n)] for i in range(n)])[vc.sequency(n)]
        assert [int((np.diff(row) != 0).sum()) for row in h] == list(range(n))


def test_transform_scales_squared_distances():
    rng = np.random.default_rng(5)
    for width in (1, 3, 16, 17):
        x, y = rng.integers(-3000, 3000, (2, 20, width))
        n = vc.padded_width(width)
        assert (((vc.transform(x) - vc.transform(y)) ** 2).sum(1) == n * ((x - y) ** 2).sum(1)).all()


def test_nearest_is_exact_with_ties():
    rng = np.random.default_rng(7)
    for width, spread, kind in ((16, 300, np.int64), (5, 1, np.int64), (1, 4, np.int64), (9, 40, object)):
        x, e = rng.integers(-spread, spread + 1, (300, width)), rng.integers(-spread, spread + 1, (256, width))
        e[200:] = e[:56]
        d = ((x[:, None] - e[None]) ** 2).sum(2)
        which, scaled = vc.nearest(vc.transform(x.astype(kind)), vc.transform(e.astype(kind)))
        assert (which == d.argmin(1)).all()
        assert (scaled == vc.padded_width(width) * d.min(1)).all()


def test_odd_rows(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice([None, 1, 2]), [rng.uniform(-1, 1) for _ in range(8)]) for k in range(40)]
    rows += [(3, 1, rows[3][2]), (3, 1, [0.5] * 8), (None, 2, [0.25] * 8), (50, 1, None), (51, 1, [1.0, None] * 4), (52, 1, [float("nan")] * 8), (53, 1, [float("inf")] + [0.0] * 7), (54, None, []), (55, 2, [0.1, 0.2, 0.3])]
    rows += [(100, 9, [1e300] * 8), (101, 9, [-1e300] * 8), (102, 8, [2.0**40] * 8)]
    frame = spark.createDataFrame([(*r, 0, "x") for r in rows], "vec_id long, label int, embedding array<double>, id int, code string").repartition(5)
    for entries in (256, 4):
        assert coded(frame, entries=entries) == plain(rows, entries=entries)
    assert coded(frame.where(F.lit(False))) == []
    assert coded(frame.where("vec_id = 54")) == plain([(54, None, [])])


def test_whole_small_table(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r["vec_id"], r["label"], list(r["embedding"])) for r in frame.collect()]
    assert coded(frame) == plain(rows)
    assert coded(frame.repartition(7), entries=16, rounds=2) == plain(rows, entries=16, rounds=2)


def test_codes_come_close(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    kept = vc.valid(frame, "vec_id", "embedding", "label")
    books = vc.train(kept)
    rows = {r["id"]: r["x"] for r in kept.collect()}
    for r in vc.encode(kept, books).collect():
        x = vc.integers(np.array(rows[r["id"]]))
        assert ((x - np.array(vc.decode(r["code"], books))) ** 2).sum() == r["error"]
    before = vc.encode(kept, vc.train(kept, rounds=0)).agg(F.sum("error")).first()[0]
    assert vc.encode(kept, books).agg(F.sum("error")).first()[0] < before
