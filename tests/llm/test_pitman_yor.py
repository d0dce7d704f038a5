import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from runledger.llm import pitman_yor as py
from runledger.llm.common import fold

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return [*WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")), None]


def base(rows):
    """(doc, held, tokens, known, N, base score) by the formula."""
    held = [zlib.crc32(str("" if d is None else d).encode()) % 5 == 1 for d, _ in rows]
    counts = Counter(t for (_, x), h in zip(rows, held, strict=True) if not h for t in tokens(x))
    n, v = sum(counts.values()), len(counts)
    out = []
    for (d, x), h in zip(rows, held, strict=True):
        ts = tokens(x)
        out.append((d, h, len(ts), sum(counts[t] > 0 for t in ts), n, round(sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in ts), 6)))
    return sorted(out, key=str)


def check(frame):
    rows = [(r["doc_id"], r["text"]) for r in frame.collect()]
    got = py.score(frame, fold("doc_id", 5) == 1).collect()
    assert sorted(((r[0], r[1], r[2], r[3], r[4], round(r[5], 6)) for r in got), key=str) == base(rows)
    assert all(r["score"] < 0 and np.isfinite(r["score"]) for r in got)
    return got


def test_sf0001_beats_the_base_and_repeats_itself(spark, monkeypatch):
    monkeypatch.setattr(py, "BLOCK_TOKENS", 20_000)
    frame = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = check(frame)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    again = py.score(frame, fold("doc_id", 5) == 1).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (2, ""), (None, "A b a B"), (5, "a b " * 60_000), (6, "x" * 5000), (7, "a b a c"), (10, "zz a b")]
    frame = spark.createDataFrame([(*r, 1, "s") for r in rows], "doc_id long, text string, score int, words string").repartition(3)
    check(frame)
    assert py.score(frame.where(F.lit(False)), F.lit(False)).collect() == []
    alone = py.score(frame, F.lit(True)).collect()
    assert {r["train_tokens"] for r in alone} == {0} and {r["n_known"] for r in alone} == {0}


def restaurants(rows, sweeps):
    """The model of (text, held out) rows, word by word in dicts; only the draws of one dish are the operator's."""
    mask = (1 << 64) - 1

    def mixed(x, salt=0):
        x = (x + salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & mask
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & mask
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & mask
        return x ^ (x >> 31)

    def key(w):
        return int(py.END) if w is None else int(py.START) if w == "<s>" else xxhash.xxh64_intdigest(w.encode(), seed=42)

    def draw(c, weight, d, k, salt):
        return int(py.tables(np.array([c]), np.array([weight]), d, np.array([k], np.uint64), salt)[0])

    pairs = Counter(p for x, held in rows if not held for p in zip(["<s>", *tokens(x)], tokens(x)))
    count = Counter()
    for (_, w), n in pairs.items():
        count[w] += n
    context = Counter()
    for (u, _), n in pairs.items():
        context[u] += n
    discount = lambda values: py._discount(sum(v == 1 for v in values), sum(v == 2 for v in values))
    d, seated = discount(pairs.values()), {p: 1 for p in pairs}
    states = []
    for sweep in range(sweeps + 1):
        if sweep:
            root, own, root_d, root_tables, customers = states[-1][1:]
            p_root = lambda w: root_of(states[-1], count, w)  # noqa: B023, E731
            seated = {(u, w): draw(n, (1 + d * own[u]) * p_root(w), d, mixed(key(u) ^ mixed(key(w), 1), 2), 100_000 * sweep) if n > 1 else 1 for (u, w), n in pairs.items()}
        sent, own = Counter(), Counter()
        for (u, w), t in seated.items():
            sent[w] += t
            own[u] += t
        if sweep:
            base = (1 - py.UNKNOWN) / len(count)
            weight = (1 + root_d * sum(root_tables.values())) * base
            tables = {w: draw(n, weight, root_d, key(w), sweep) for w, n in sent.items()}
        else:
            root_d, tables = discount(sent.values()), {w: 1 for w in sent}
        states.append((seated, sent, own, root_d, tables, sum(sent.values())))
    chosen = states[-py.SAMPLES :]

    def p(u, w):
        return np.mean([(max(pairs[u, w] - d * s[0].get((u, w), 0), 0) + (1 + d * s[2][u]) * root_of(s, count, w)) / (1 + context[u]) for s in chosen])

    return p, count


def root_of(state, count, w):
    _, sent, _, root_d, tables, customers = state
    fresh = (1 + root_d * sum(tables.values())) / (1 + customers)
    return (sent[w] - root_d * tables[w]) / (1 + customers) + fresh * (1 - py.UNKNOWN) / len(count) if count[w] else fresh * py.UNKNOWN


def test_scores_are_those_of_plain_restaurants(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(60)]
    rows = [(" ".join(rng.choice(words) for _ in range(rng.randrange(0, 25))), k % 5 == 1) for k in range(120)]
    p, count = restaurants(rows, py.BURN_IN + py.SAMPLES)
    want = [sum(math.log10(p(u, w)) for u, w in zip(["<s>", *tokens(x)], tokens(x))) for x, _ in rows]
    frame = spark.createDataFrame([(k, x, h) for k, (x, h) in enumerate(rows)], "doc_id long, text string, held boolean").repartition(5)
    # In one block and in many; by buckets that blocks address at once, and by way of merged groups of blocks.
    for block, bucket, fan in ((10**6, 10**6, 256), (100, 10**6, 256), (100, 10, 4)):
        monkeypatch.setattr(py, "BLOCK_TOKENS", block)
        monkeypatch.setattr(py, "BUCKET_TOKENS", bucket)
        monkeypatch.setattr(py, "FAN", fan)
        got = {r["doc_id"]: r["score"] for r in py.score(frame, F.col("held")).collect()}
        assert all(abs(got[k] - s) < 1e-6 * (1 + abs(s)) for k, s in enumerate(want))
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith(("blocks_", "counted_"))]
    # Over all known words, the end and the unknown class the probabilities after any context sum to one.
    for u in ("<s>", *[w for w in count if w is not None], "never seen"):
        assert abs(sum(p(u, w) for w in count) + p(u, "another") - 1) < 1e-9


def test_stirling_law_of_tables():
    # Two customers: S(2, 1) = 1 - d and S(2, 2) = 1.
    keys = py._mixed(np.arange(200_000, dtype=np.uint64))
    t = py.tables(np.full(200_000, 2), np.full(200_000, 0.5), 0.3, keys, 7)
    assert abs((t == 2).mean() - 0.5 / (0.5 + 0.7)) < 5e-3
    # The limit law agrees with the exact one where both apply, nearly.
    for weight, discount in ((2.0, 0.5), (0.05, 0.9), (300.0, 0.7), (20.0, 0.9)):
        exact = py.tables(np.full(20_000, 64), np.full(20_000, weight), discount, keys[:20_000], 1).mean()
        limit = py.tables(np.full(20_000, 65), np.full(20_000, weight), discount, keys[:20_000], 1).mean()
        assert abs(exact - limit) < 0.1 * exact
    assert (py.tables(np.array([0, 1, 10**6]), np.full(3, 0.1), 0.5, keys[:3], 1) >= [0, 1, 1]).all()


def test_blobs():
    x = np.array([0, 1, 2**40, 2**64 - 1], np.uint64)
    assert (py._unpacked(py._packed(x), "<u8") == x).all()
    assert len(py._unpacked(py._packed(x[:0]), "<u8")) == 0


def test_totals_beyond_32_bits(spark, monkeypatch):
    """Pairs and words counted billions of times, in buckets and in merged groups of blocks."""
    keys = np.sort(py._mixed(np.arange(40, dtype=np.uint64)))
    each = 1_500_000_000

    def asked(fan, columns):
        def run(batches):
            for batch in batches:
                for block in batch.column(0).to_pylist():
                    yield py._asked(block, keys, [np.full(len(keys), each, np.int64)] * columns, fan)

        return run

    for most, fan, buckets in ((256, 32, 32), (4, 4, 16)):
        monkeypatch.setattr(py, "FAN", most)
        asks = lambda columns: spark.range(8).select("id").mapInArrow(asked(fan, columns), py._ASK_SQL)  # noqa: B023, E731
        pairs, stats = py._exchange(asks(1), py._pairs_reply, "pairs", 8, buckets, owned=True)
        told = [py._told(r["pairs"], 1)[0] for r in pairs.collect()]
        assert len(told) == 8 and all((t >> 1 == 8 * each).all() for t in told)
        # One block owns each pair.
        assert (sum(t & 1 for t in told) == 1).all()
        words, stats = py._exchange(asks(3), py._words_reply(None, 0), "words0", 8, buckets)
        for r in words.collect():
            count, sent, seated, own = py._told(r["words0"], 4)
            assert (count == 8 * each).all() and (sent == 8 * each).all() and (own == 8 * each).all() and (seated == 1).all()
        assert stats[0] == 8 * each * len(keys)
