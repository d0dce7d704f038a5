import hashlib
import random

from pyspark.sql import functions as F

from runledger.llm.exact_dedup import exact_duplicates


def plain(rows):
    groups = {}
    for doc, text in rows:
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        groups.setdefault(t, []).append(doc)
    out = []
    for t, docs in groups.items():
        keep = max((d for d in docs if d is not None), default=None)
        out += [(d, keep, len(docs), hashlib.sha256(t.encode()).hexdigest()) for d in docs]
    return sorted(out, key=str)


def check(frame, rows, **options):
    got = exact_duplicates(frame, **options).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=str) == plain(rows)
    texts = {r["text_sha256"] for r in got}
    assert sorted(r["text_sha256"] for r in got if r["kept"]) == sorted(texts)
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "A"), (3, "a"), (None, "a"), (None, "Ä"), (5, "ä"), (6, "x" * 3_000_000), (7, "X" * 3_000_000), (None, "z"), (None, "Z")]
    frame = spark.createDataFrame([(a, b, 1, "s") for a, b in rows], "doc_id long, text string, keep_id int, sha string")
    check(frame.repartition(3), rows)
    assert exact_duplicates(frame.where(F.lit(False))).collect() == []


def test_recursive_partitions(spark):
    rng = random.Random(3)
    rows = [(k, f"text {rng.randrange(900)} " * 20 if k % 3 else "hot") for k in range(4000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    check(frame, rows, table_bytes=4000)
