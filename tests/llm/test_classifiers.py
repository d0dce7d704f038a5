import math
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from runledger.llm import newton
from runledger.llm.common import fold
from runledger.llm.quality import DIMENSIONS, estimate_prior, fit_pu, quality, statistics
from runledger.llm.toxicity import EXTRA, PATTERNS, Voters, _votes, capitals, fit_label_model, toxicity

SF = "/root/testdata/sf0.1"


def auc(rows):
    ranks = {i: k for k, i in enumerate(sorted(range(len(rows)), key=lambda i: rows[i][0]))}
    ones = [i for i, r in enumerate(rows) if r[1]]
    n, p = len(rows) - len(ones), len(ones)
    return (sum(ranks[i] for i in ones) - p * (p - 1) / 2) / (p * n)


def held_out(spark, operator, label, n, rest):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    scored = operator(docs, labels.where(fold("doc_id", n) != rest))
    assert scored.count() == docs.count()
    rows = scored.join(labels, "doc_id").where(fold("doc_id", n) == rest).select("score", label, "predicted").collect()
    assert all(0 <= r[0] <= 1 for r in rows)
    return auc([(r[0], r[1]) for r in rows]), sum(r[1] == r[2] for r in rows) / len(rows)


def test_quality_on_held_out_rows(spark):
    area, right = held_out(spark, quality, "quality", 4, 2)
    assert area > 0.97 and right > 0.96


def test_toxicity_on_held_out_rows(spark):
    area, right = held_out(spark, toxicity, "toxic", 5, 0)
    print(area, right)
    assert area > 0.92 and right > 0.97


def odd(spark):
    rng = random.Random(1)
    rows = [(1, None), (2, ""), (2, ""), (None, "idiot moron"), (5, "x" * 100_000), (6, " \n")]
    rows += [(10 + k, " ".join(rng.choice(["sun", "rain", "idiot" if k % 2 else "wind"]) for _ in range(30))) for k in range(200)]
    docs = spark.createDataFrame([(*r, 0.5, "a", 1) for r in rows], "doc_id long, text string, score double, x string, y int").repartition(3)
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(10, 150)] + [(None, 1, 1), (150, None, None)], "doc_id long, toxic int, quality int")
    return docs, labels


def test_odd_rows(spark):
    docs, labels = odd(spark)
    for operator in (toxicity, quality):
        for given in (labels, labels.where(F.lit(False))):
            got = operator(docs, given).collect()
            assert len(got) == 206 and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in got)
        assert operator(docs.where(F.lit(False)), labels).collect() == []
    toxic = {r["doc_id"]: r["score"] for r in toxicity(docs, labels).collect()}
    assert min(toxic[10 + k] for k in range(1, 200, 2)) > max(toxic[10 + k] for k in range(0, 200, 2))


def test_capitals_are_counted_over_whole_texts():
    # Every 64th character of the last text is small, the others are capitals.
    texts = [("aB" * 50_000)[:n] for n in (1_000, 1_999, 2_000, 2_001, 3_000, 3_999, 4_000, 4_001, 100_000)]
    texts += ["IDIOT " * 167, "IDIOT " * 500, "IDIOT " * 700, ("a" + "B" * 63) * 2_000, "ÄÖß€𝐀" * 900]
    shares = [sum(map(str.isupper, t)) / len(t) for t in texts]
    assert [capitals(t) for t in texts] == [sum(map(str.isupper, t)) for t in texts]
    voters = Voters(["=idiot"], [5.0], 0.1)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts), pa.array(range(len(texts)))], names=["id", "text", "row"])
    (out,) = _votes(voters)(iter([batch]))
    got = newton.matrix(out.column("x"), voters.d)
    assert np.allclose(got[:, -1], shares, atol=1e-6)
    # The vote for shouting of one toxic text in capitals is the same at each length.
    assert len(set(got[9:12, -EXTRA - 1])) == 1 and PATTERNS == 8


def test_label_model_recovers_accuracies_and_correlations(spark):
    # Voters 0 and 1 mostly repeat each other, 2 to 5 are independent; each votes toxic or clean or not at all.
    rng = np.random.default_rng(3)
    n, m, prior = 60_000, 6, 0.2
    y = rng.random(n) < prior
    cast, right = np.array([0.6, 0.6, 0.5, 0.5, 0.6, 0.4]), np.array([0.8, 0.8, 0.85, 0.75, 0.9, 0.8])

    def vote(j):
        v = np.where(rng.random(n) < right[j], np.where(y, 1, -1), np.where(y, -1, 1))
        return np.where(rng.random(n) < cast[j], v, 0)

    votes = np.stack([vote(j) for j in range(m)], axis=1).astype(np.int8)
    same = rng.random(n) < 0.8
    votes[same, 1] = votes[same, 0]
    found, count = np.unique(votes, axis=0, return_counts=True)
    frame = spark.createDataFrame([(bytearray(v.tobytes()), int(k)) for v, k in zip(found, count, strict=True)], "votes binary, n long").repartition(4)
    model = fit_label_model(frame, m, 0.3)
    assert [j for j in range(m) if model.parent[j] >= 0] in ([0], [1]) and {*model.parent} == {-1, int(model.parent.argmax() == 0)}
    assert abs(newton.sigmoid(model.bias) - prior) < 0.03
    for j in range(2, m):
        want = np.log(right[j] / (1 - right[j]))
        assert abs(model.tables[j, 5] - want) < 0.3 and abs(model.tables[j, 3] + want) < 0.3
    # Where both of the pair vote toxic, the second adds little to the first.
    child = int(model.parent.argmax())
    assert 0 < model.tables[child, 8] < 0.8
    # Posteriors are shares: of rows with about one posterior so many are toxic.
    q = model.posterior(votes)
    for low in np.arange(0, 1, 0.2):
        rows = (q >= low) & (q < low + 0.2)
        assert abs(y[rows].mean() - q[rows].mean()) < 0.06


def plain_model(rows, parent, odds, bias, known=None):
    """One round of EM over rows, one by one: the log-odds (voter, parent's vote, vote) and the bias that follow; known: the
    parents that the given log-odds are by."""
    m = len(parent)
    above = lambda v, j, parent=parent: v[parent[j]] if parent[j] >= 0 else 0
    counts = [[{} for _ in range(m)] for _ in range(2)]
    toxic = every = 0.0
    for v in rows:
        g = bias + sum(odds[j].get((above(v, j, known or parent), v[j]), 0.0) for j in range(m))
        q = 1 / (1 + math.exp(-g))
        toxic, every = toxic + q, every + 1
        for c, w in enumerate((q, 1 - q)):
            for j in range(m):
                at = (above(v, j), v[j])
                counts[c][j][at] = counts[c][j].get(at, 0.0) + w
    share = min(0.5, max(0.002, toxic / every))
    out = []
    for j in range(m):
        table = {}
        for c, faint in enumerate((1.0, 1e-2)):
            own = {b: sum(counts[c][j].get((a, b), 0.0) for a in (-1, 0, 1)) + faint * (1.0 if b == 0 else 0.5) for b in (-1, 0, 1)}
            total = sum(own.values())
            for a in (-1, 0, 1):
                seen = sum(counts[c][j].get((a, b), 0.0) for b in (-1, 0, 1))
                for b in (-1, 0, 1):
                    p = (counts[c][j].get((a, b), 0.0) + max(1e-6, own[b] / total)) / (seen + 1)
                    table[a, b] = table.get((a, b), 0.0) + (math.log(p) if c == 0 else -math.log(p))
        out.append({k: min(6.0, max(-6.0, x)) for k, x in table.items()})
    return out, math.log(share / (1 - share))


def test_posteriors_are_those_of_plain_rounds_over_rows(spark):
    rng = np.random.default_rng(12)
    n, m = 1500, 5
    y = rng.random(n) < 0.25
    votes = np.where(rng.random((n, m)) < 0.7, np.where((rng.random((n, m)) < 0.85) == y[:, None], 1, -1), 0).astype(np.int8)
    votes[:, 1] = np.where(rng.random(n) < 0.8, votes[:, 0], votes[:, 1])
    found, count = np.unique(votes, axis=0, return_counts=True)
    frame = spark.createDataFrame([(bytearray(v.tobytes()), int(k)) for v, k in zip(found, count, strict=True)], "votes binary, n long").repartition(3)
    rows = votes.tolist()
    for most in (0, 2):
        model = fit_label_model(frame, m, 0.3, most=most)
        odds, bias = [{(a, b): 1.5 * b for a in (-1, 0, 1) for b in (-1, 0, 1)} for _ in range(m)], math.log(0.3 / 0.7)
        for _ in range(6):
            odds, bias = plain_model(rows, [-1] * m, odds, bias)
        for k in range(most):
            odds, bias = plain_model(rows, model.parent.tolist(), odds, bias, None if k else [-1] * m)
        above = lambda v, j: v[model.parent[j]] if model.parent[j] >= 0 else 0  # noqa: E731, B023
        want = [1 / (1 + math.exp(-(bias + sum(odds[j][above(v, j), v[j]] for j in range(m))))) for v in rows]
        assert (model.parent >= 0).any() or not most
        assert np.allclose(model.posterior(votes), want, atol=1e-9)


def test_prior_is_estimated_from_thresholds(spark):
    # Good rows lie apart from most others; the estimate is near the share that was mixed in.
    rng = np.random.default_rng(6)
    scale = np.ones(DIMENSIONS)
    frame = lambda x: spark.createDataFrame([(bytearray(r.astype("<f4").tobytes()),) for r in x], "x binary").repartition(4)
    for share in (0.2, 0.5, 0.8):
        n = 4000
        x = np.zeros((n, DIMENSIONS))
        x[:, 0], good = 1, rng.random(n) < share
        x[:, 1], x[:, 2] = rng.normal(size=n) + np.where(good, 2.0, -2.0), rng.normal(size=n)
        p = np.zeros((1500, DIMENSIONS))
        p[:, 0], p[:, 1], p[:, 2] = 1, rng.normal(size=1500) + 2.0, rng.normal(size=1500)
        unlabelled, positive = frame(x), frame(p)
        got = estimate_prior(unlabelled, positive, fit_pu(unlabelled, positive, 0.5, scale), scale)
        assert abs(got - share) < 0.1
    assert estimate_prior(frame(x).where("false"), positive, np.zeros(DIMENSIONS), scale) == 0.5


def test_label_model_does_not_drift(spark):
    # Few voters vote on a text, most of them on toxic ones; however many rounds, texts without a vote stay clean.
    rng = np.random.default_rng(4)
    n, m, prior = 40_000, 24, 0.1
    y = rng.random(n) < prior
    votes = (rng.random((n, m)) < np.where(y[:, None], 0.25, 0.002)).astype(np.int8)
    votes[:, 1] = np.where(rng.random(n) < 0.7, votes[:, 0], votes[:, 1])
    votes[:, -1] = np.where(votes[:, :-1].sum(axis=1) > 0, 0, -1)
    found, count = np.unique(votes, axis=0, return_counts=True)
    frame = spark.createDataFrame([(bytearray(v.tobytes()), int(k)) for v, k in zip(found, count, strict=True)], "votes binary, n long").repartition(4)
    shares = []
    for most in (0, 2, 60):
        model = fit_label_model(frame, m, prior, most=most)
        q = model.posterior(votes)
        shares += [newton.sigmoid(model.bias), q.mean()]
        assert q[votes[:, :-1].sum(axis=1) == 0].max() < 0.1 and ((q >= 0.5) == y).mean() > 0.95
    assert max(shares) - min(shares) < 0.01 and max(shares) < 0.15


def test_risk_is_the_brute_force_minimum(spark):
    # The risk of fit_pu's weights, computed row by row, is no larger than that of any weights nearby.
    rng = np.random.default_rng(5)
    every = np.zeros((300, DIMENSIONS))
    every[:, 0], every[:, 1:4] = 1, rng.normal(size=(300, 3))
    good = every[every[:, 1] + rng.normal(size=300) > 0.7]
    frames = [spark.createDataFrame([(bytearray(r.astype("<f4").tobytes()),) for r in x], "x binary") for x in (every, good)]
    scale, prior = np.ones(DIMENSIONS), 0.35

    def risk(w):
        loss = lambda g: np.mean(np.log1p(np.exp(-g)))
        return prior * loss(good @ w) + max(0.0, loss(-(every @ w)) - prior * loss(-(good @ w))) + 0.5e-4 * w @ w

    w = fit_pu(*frames, prior, scale)
    least = risk(w)
    assert least < risk(np.zeros(DIMENSIONS))
    for _ in range(200):
        step = np.zeros(DIMENSIONS)
        step[:4] = rng.normal(size=4) * rng.choice([1e-3, 1e-2, 0.1])
        assert least <= risk(w + step) + 1e-6


def test_newton_sums_match_a_plain_fit(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([np.ones((400, 1)), rng.normal(size=(400, 3))], axis=1)
    q = newton.sigmoid(x @ np.array([0.3, 1.0, -2.0, 0.0]))
    frame = spark.createDataFrame([(bytearray(a.astype("<f4").tobytes()), float(b)) for a, b in zip(x, q, strict=True)], "x binary, q double").repartition(5)
    w = newton.fit_soft(frame, lambda b: b.column(1).to_numpy(), 4, rounds=20, ridge=1e-9)
    assert np.allclose(w, [0.3, 1.0, -2.0, 0.0], atol=1e-3)


def test_risk_counts_positives_by_their_mean(spark):
    texts = [b"one two three four five six", b"AAA!! AAA!! AAA!!", b"red green blue grey black white", b"zzz zzz zzz zzz zzz"]
    assert len(statistics(texts[0])) * 2 + 1 == DIMENSIONS
    x = np.array([[1, *s, *np.square(s)] for s in map(statistics, texts * 20)])
    blob = [(bytearray(r.astype("<f4").tobytes()),) for r in x]
    every = spark.createDataFrame(blob, "x binary")
    good = spark.createDataFrame([b for k, b in enumerate(blob) if k % 2 == 0], "x binary")
    scale = np.maximum(np.sqrt((x**2).mean(axis=0)), 1e-3)
    g = x[:4] / scale @ fit_pu(every, good, 0.5, scale)
    assert min(g[0], g[2]) > 1 > -1 > max(g[1], g[3])
