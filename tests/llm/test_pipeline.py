import sys
from collections import Counter
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from test_mixing import WORD, water  # noqa: E402
from test_simhash import classes, plain  # noqa: E402

SF = "/root/testdata/sf0.001"
ROWS = [(1, "A b c d e f", "s0"), (2, "a B c d e f", "s0"), (2, "a B c d e f", "s0"), (None, "x y z", None), (None, "X y z", "s1"), (7, None, "s1"), (8, "", None), (9, "one two three four", "s2")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(a, b, "en", c, 1) for a, b, c in ROWS], "doc_id long, text string, lang string, source string, n_chars long")


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def key(r):
    return r["doc_id"], r["text"]


def test_toxic_documents_go(spark, docs):
    got = stage("toxicity")(spark, docs, SF)
    assert got.columns == docs.columns
    # Documents with many words that toxic ones share go, however few the labels are.
    bad = spark.createDataFrame([(10_000 + k, "You are a stupid idiot, a pathetic moron and worthless trash. " * (k + 1)) for k in range(8)], "doc_id long, text string")
    both = docs.unionByName(bad, allowMissingColumns=True)
    assert stage("toxicity")(spark, both, SF).where("doc_id >= 10000").count() == 0
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in got.collect()}
    clean = [d for d, t in labels.items() if t == 0]
    assert sum(d in kept for d in clean) >= 0.9 * len(clean)


def test_exact_copies_go(spark, docs, odd):
    for frame in (docs, odd):
        got = stage("exact_dedup")(spark, frame, SF)
        assert got.columns == frame.columns
        best = {}
        for r in frame.collect():
            t = "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"] or "")
            best[t] = max(best.get(t, -1), -1 if r["doc_id"] is None else r["doc_id"])
        left = got.collect()
        assert sorted(best.values()) == sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in left)


def test_near_copies_go(spark, docs, odd):
    for frame in (docs, odd):
        got = stage("simhash_dedup")(spark, frame, SF).collect()
        rows = sorted(frame.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
        group = classes([plain(r["text"]) for r in rows])
        want = Counter(rows[g]["doc_id"] for g in set(group))
        assert Counter(r["doc_id"] for r in got) == want


def test_mix_repeats_documents(spark, docs, odd):
    for frame in (docs, odd):
        got = stage("mixing")(spark, frame, SF).collect()
        sizes, taken, longest = Counter(), Counter(), 0
        for r in frame.collect():
            n = len(WORD.findall(r["text"] or ""))
            sizes[r["source"]] += n
            longest = max(longest, n)
        for r in got:
            taken[r["source"]] += len(WORD.findall(r["text"] or ""))
        for s, t in water(sizes).items():
            assert abs(taken[s] - t) <= longest
        each, had = Counter(map(key, got)), Counter(map(key, frame.collect()))
        assert all(each[k] <= 3 * had[k] for k in each)


def test_two_runs_agree(spark):
    runs = [sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, SF).collect()) for _ in range(2)]
    assert runs[0] == runs[1]


def test_run_packs_what_the_stages_keep(spark):
    got = corpus_pipeline.run(spark, SF).collect()
    used = Counter()
    for r in got:
        used[r["sequence_id"]] += r["length"]
    assert max(used.values()) <= 2048
    assert len(used) <= -(-sum(used.values()) // 2048) * 1.03 + 1


def test_stages_take_odd_and_empty_tables(spark, odd):
    names = ("shard", "place", "row", "kept", "predicted", "size", "fp", "_row", "_row_file", "_row_index", "_shard", "_place", "number", "block")
    clash = odd.selectExpr("*", *[f"{k} as {n}" for k, n in enumerate(names)])
    for name, f in corpus_pipeline.STAGES:
        got = f(spark, clash, SF)
        if name != "packing":
            assert got.columns == clash.columns
        assert 0 < got.count() <= 3 * clash.count()
        assert f(spark, clash.limit(0), SF).count() == 0
