import re
from itertools import permutations

from pyspark.sql import functions as F

from runledger.llm import filter_audit as fa

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(docs, labels):
    """Every order applied to lists of documents, step by step."""
    say = lambda what: {i for i, q, t in labels if i is not None and {"quality": q, "toxic": t}[what] == 1}
    good, toxic = say("quality"), say("toxic")
    found = []
    for i, text, source in docs:
        t = text or ""
        w = WORD.findall(t)
        mask = {
            "A": len(w) < 200,
            "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t),
            "D": any(c in "#$%&*|" for c in t),
            "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs),
        }
        found.append((source or "", i, mask))
    out = {}
    for part in {p for p, _, _ in found}:
        rows = [(i, m) for p, i, m in found if p == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = rows
            for k, c in enumerate(order):
                gone = [(i, m) for i, m in left if m[c]]
                left = [(i, m) for i, m in left if not m[c]]
                alone = sum(m[c] and sum(m.values()) == 1 for _, m in rows)
                out[part, order, k + 1] = [len(left), len(gone), sum(m[c] for _, m in rows) - len(gone), alone, sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
                shapley[c] += len(gone)
        for order in map("".join, permutations("ABCDE")):
            for k, c in enumerate(order):
                out[part, order, k + 1].append(shapley[c])
    return out


def audited(docs, labels):
    return {(r["part"], r["filter_order"], r["step"]): list(r[3:]) for r in fa.audit(docs, labels).collect()}


def test_counters_add_without_overflow():
    counters = fa.Counters()
    assert len(counters.orders) * 5 == 600
    n = (1 << 40) + 3
    total = n * counters.of(0b10001, True, False) + 7 * counters.of(0, False, True)
    got = counters.unpacked(total)
    k = counters.orders.index("AEBCD")
    assert got["removed"][k].tolist() == [n, 0, 0, 0, 0]
    assert got["redundant"][k].tolist() == [0, n, 0, 0, 0]
    assert got["kept"][k].tolist() == [7] * 5
    assert got["good_lost"][k].tolist() == [n, 0, 0, 0, 0] and not got["toxic_lost"].any()
    assert got["shapley"][k].tolist() == [60 * n, 60 * n, 0, 0, 0]


def test_odd_rows(spark):
    long = " ".join(f"w{k}" for k in range(300))
    docs = [(1, None, "a"), (2, "", "a"), (None, "", None), (3, "x " * 250, ""), (4, long, "b"), (4, long, "b"), (5, long, "a"), (6, long.upper(), "b"), (7, f"{long} #", "b"), (8, "Ünï ÄÖ AB", "ä"), (9, "a\x0bb\x1cc d e", "ä"), (10, "many words " * 60_000, "b"), (None, long, "b"), (11, "A" * 2 + "é" * 98, "c"), (12, "A" * 3 + "é" * 97, "c")]
    labels = [(4, 1, 0), (4, 0, 1), (5, None, 1), (None, 1, 1), (6, 1, None), (99, 1, 1), (7, 1, 1)]
    frame = spark.createDataFrame([(*d, 0, 1, "m") for d in docs], "doc_id long, text string, source string, part int, mask int, sha string").repartition(6)
    told = spark.createDataFrame([(*x, 5) for x in labels], "doc_id long, quality int, toxic int, good int")
    assert audited(frame, told) == plain(docs, labels)
    assert audited(frame, told.where(F.lit(False))) == plain(docs, [])
    assert fa.audit(frame.where(F.lit(False)), told).collect() == []
    assert {k: v for k, v in audited(frame, None).items()} == plain(docs, [])


def test_many_parts_are_sent_on(spark, monkeypatch):
    monkeypatch.setattr(fa, "MOST_PARTS", 3)
    rows = spark.range(200).select((F.col("id") % 17).cast("string").alias("part"), (F.col("id") % 32).cast("int").alias("mask"), (F.col("id") % 3 == 0).alias("good"), (F.col("id") % 5 == 0).alias("toxic"))
    got = fa.interactions(rows)
    assert got.count() == 17 * 600
    assert got.where("filter_order = 'ABCDE'").agg(F.sum("removed"), F.sum(F.when(F.col("step") == 5, F.col("kept")))).first() == (200 - rows.where("mask = 0").count(), rows.where("mask = 0").count())
    assert got.where("filter_order = 'EDCBA'").agg(F.sum("good_lost")).first()[0] == rows.where("mask > 0 and good").count()
