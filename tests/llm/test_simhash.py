import random
import re
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import functions as F

from runledger.llm import golay, simhash
from runledger.llm.simhash import fingerprints, links, near_duplicates
from runledger.llm.xxh import xxh64_ranges

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(fps, bits=4):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(fps)), 2):
        if (fps[a] ^ fps[b]).bit_count() <= bits:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return [find(x) for x in range(len(fps))]


def test_xxh64_of_every_length():
    data = random.Random(1).randbytes(5000)
    starts = np.array([(k * 7) % 4000 for k in range(400)])
    ends = starts + np.arange(400) % 200
    assert xxh64_ranges(data, starts, ends).tolist() == [xxhash.xxh64_intdigest(data[a:z], 42) for a, z in zip(starts, ends, strict=True)]


def test_golay_keys_of_all_errors():
    # The keys of a word follow its coset, so one word for each coset stands for all.
    leaders = np.array([p[0] for p in golay._PATTERNS])
    own = golay.keys(leaders)
    for weight in (1, 2):
        for bits in combinations(range(23), weight):
            other = golay.keys(leaders ^ sum(1 << b for b in bits))
            shared = ((own[:, :, None] == other[:, None, :]) & (own[:, :, None] >= 0)).any(axis=(1, 2))
            assert shared.all()
            if weight == 1:
                assert (own[:, :1] == other).any(axis=1).all()


def test_fingerprints_match_plain():
    texts = ["", "   ", "One", "a B c", "a b c d", "x y z w " * 300, "é à ü A\tB\nC\x0bD " * 9, "w" * 500 + " b c d e"]
    assert fingerprints([t.encode() for t in texts]).tolist() == [plain(t) for t in texts]


def _fps(rng, n):
    fps = []
    for _ in range(n):
        base = rng.getrandbits(64)
        fps.append(base)
        for _ in range(rng.randrange(4)):
            for _ in range(rng.randrange(1, 7)):
                base ^= 1 << rng.randrange(64)
            fps.append(base)
    return fps


def test_links_find_all_pairs(spark):
    rng = random.Random(5)
    dense = [rng.getrandbits(64)]
    dense += [dense[0] ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 4))) for _ in range(150)]
    fps = list(dict.fromkeys(_fps(rng, 300) + dense))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    frame = spark.createDataFrame([(x,) for x in signed], "fp long").repartition(3)
    want = classes(fps)
    for block in (4096, 16):
        pairs = links(frame, block).distinct().collect()
        assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 64 for a, b in pairs)
        place = {x: k for k, x in enumerate(signed)}
        root = list(range(len(fps)))

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            x, y = find(place[a]), find(place[b])
            root[max(x, y)] = min(x, y)
        assert [find(x) for x in range(len(fps))] == want


def test_near_duplicates_on_sf0001(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    fps = [plain(t) for _, t in rows]
    want = [(d, f"{fp:016x}", rows[c][0]) for (d, _), fp, c in zip(rows, fps, classes(fps), strict=True)]
    assert sorted(tuple(r) for r in near_duplicates(docs).collect()) == want


def test_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, " \n", None), (4, "a b", None), (4, "A b", None), (None, "a  b", None), (9, "q " * 200_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    got = sorted((tuple(r) for r in near_duplicates(docs).collect()), key=str)
    zero = "0" * 16
    ab = f"{plain('a b'):016x}"
    assert got == sorted([(1, zero, 1), (2, zero, 1), (3, zero, 1), (4, ab, 4), (4, ab, 4), (None, ab, 4), (9, f"{plain('q ' * 2000):016x}", 9)], key=str)
    assert near_duplicates(docs.where(F.lit(False))).collect() == []
    assert simhash.MOST_BITS == 4
