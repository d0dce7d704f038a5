"""Language model scores by a hierarchical Pitman-Yor process over words.

Each previous word has a restaurant (the start of a text is one too); all share the restaurant of single words as
parent, whose base gives the unknown class a fixed share and the known words the rest in equal parts. A customer
is a token, a table sends one customer to the parent. Gibbs sweeps draw the number of tables of each dish in each
restaurant from its conditional law, S(c, t) a^t with generalized Stirling numbers S and a table's weight a, given the
counts of the sweep before; for dishes with very many customers by the Poisson law that it tends to. After the
burn-in, predictive probabilities are averaged over sweeps.

Texts are cut into blocks of bounded size. Distinct word pairs and words of a block travel as sorted key
blobs to buckets by key, which add up counts and tell every block the totals, by way of merged groups of blocks where
there are many buckets; blocks stay where they are, in a table bucketed by block. Of the blocks that share a pair one owns it, so its tables count once; every block draws the same
numbers, since they follow from the key and the sweep. Words are told apart by their XXH64.

Null text counts as empty: such a text is its end alone. A very long text is one block. Without training rows every
token is of the unknown class. Rows with equal ids are scored one by one. Other columns of the table, whatever their names,
play no part. An empty table gives no rows.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger.llm.common import LOWER_SPACE, as_bytes, fresh_path, small_batches, tasks, written
from runledger.llm.xxh import xxh64_ranges

BLOCK_TOKENS = 1_000_000
BUCKET_TOKENS = 2_000_000
#: Buckets that a block addresses, at most; a power of two.
FAN = 256
BURN_IN, SAMPLES = 1, 2
#: Strength of the context restaurants and of the root; share of the unknown class in the base.
STRENGTH, ROOT_STRENGTH, UNKNOWN = 1.0, 1.0, 0.9
#: Customers of a dish up to which its tables are drawn from the exact law.
EXACT = 64
#: Weights up to which products of EXACT ratios stay inside doubles.
LARGE_WEIGHT = 1e4
NO_ID = -(1 << 63)
#: Keys of a text's end, and of its start as a context.
END, START = np.uint64(0xE5D0000000000001), np.uint64(0x57A0000000000002)


# -- blobs ---------------------------------------------------------------------------------------


def _packed(x: np.ndarray) -> bytes:
    """Byte planes, compressed: high bytes of small numbers cost next to nothing."""
    return zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes(), 1) if len(x) else b""


def _unpacked(data: bytes, dtype: str) -> np.ndarray:
    if not data:
        return np.zeros(0, dtype)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(size, -1).T).view(dtype).ravel()


def _mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Scrambled 64-bit words (the finalizer of splitmix64)."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _uniform(keys: np.ndarray, salt: int) -> np.ndarray:
    return ((_mixed(keys, salt) >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


# -- blocks --------------------------------------------------------------------------------------

_COLUMNS = ("ids", "rows", "held", "sizes", "words", "counts", "pair_u", "pair_w", "pair_n", "tokens")
_BLOCK_SQL = "block long, " + ", ".join(f"{c} binary" for c in _COLUMNS)


class _Block:
    """ids, rows, held and sizes of texts; distinct words in the order of their keys, the start among them,
    with training counts; distinct pairs (numbers of words) with training counts; the pair of each token."""

    def __init__(self, **columns: np.ndarray) -> None:
        self.__dict__ |= columns

    @classmethod
    def of(cls, ids: list, rows: list, held: list, texts: list[list[bytes]]) -> _Block:
        words = [w for t in texts for w in t]
        data = b" ".join(words)
        end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        hashes = xxh64_ranges(data, np.concatenate([[0], end[:-1] + 1]) if len(end) else end, end)
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        last = np.cumsum(sizes) - 1
        key = np.full(sizes.sum(), END)
        inner = np.ones(len(key), bool)
        inner[last] = False
        key[inner] = hashes
        found, word = np.unique(np.append(key, START), return_inverse=True)
        start, word = word[-1], word[:-1]
        before = np.empty(len(word), np.int64)
        before[1:] = word[:-1]
        before[np.concatenate([[0], last[:-1] + 1])] = start
        learn = np.repeat(~np.array(held, bool), sizes)
        pairs, token = np.unique(before * len(found) + word, return_inverse=True)
        counts = np.bincount(word, learn, len(found)).astype("<u4")
        counts[start] = (~np.array(held, bool)).sum()
        return cls(
            ids=np.array(ids, "<i8"), rows=np.array(rows, "<i8"), held=np.array(held, "u1"), sizes=sizes.astype("<i8"),
            words=found.astype("<u8"), counts=counts,
            pair_u=(pairs // len(found)).astype("<u4"), pair_w=(pairs % len(found)).astype("<u4"),
            pair_n=np.bincount(token, learn, len(pairs)).astype("<u4"), tokens=token.astype("<u4"),
        )

    _TYPES = dict(zip(_COLUMNS, ("<i8", "<i8", "u1", "<i8", "<u8", "<u4", "<u4", "<u4", "<u4", "<u4"), strict=True))

    def row(self, block: int) -> pa.RecordBatch:
        blobs = [pa.array([_packed(getattr(self, c))], pa.binary()) for c in _COLUMNS]
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *blobs], names=["block", *_COLUMNS])

    @classmethod
    def read(cls, row: dict) -> _Block:
        return cls(**{c: _unpacked(row[c], cls._TYPES[c]) for c in _COLUMNS if c in row})

    def pair_keys(self, some: np.ndarray | slice = slice(None)) -> np.ndarray:
        return _mixed(self.words[self.pair_u[some]] ^ _mixed(self.words[self.pair_w[some]], 1), 2)


def _cut(most: int):
    """Blocks of about `most` tokens from rows (id, text, row, held)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for i, t, row, out in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                words = t.translate(LOWER_SPACE).split()
                held.append((NO_ID if i is None else i, row, out, words))
                size += len(words) + 1
                if size >= most:
                    yield _Block.of(*map(list, zip(*held, strict=True))).row(block)
                    held, size, block = [], 0, block + 1
        if held:
            yield _Block.of(*map(list, zip(*held, strict=True))).row(block)

    return run


# -- exchange of counts by key -------------------------------------------------------------------


def _asked(block: int, keys: np.ndarray, values: list[np.ndarray], fan: int, order: np.ndarray | None = None, own: np.ndarray | None = None, prefix: int = 0, bits: int = 0) -> pa.RecordBatch:
    """A block's keys with their values, as a row for each of `fan` buckets; order sorts the keys, which else are sorted.

    Values travel as 64 bits, since groups of blocks send sums; of small ones the byte planes cost next to nothing.

    All keys begin with `prefix`, of so many bits. own comes back to the block as it is, with the answers: it goes by a
    bucket of the block's, below zero.
    """
    if order is not None:
        keys, values = keys[order], [v[order] for v in values]
    free = 64 - bits - (fan.bit_length() - 1)
    cuts = np.searchsorted(keys, np.array([(prefix * fan + k) << free for k in range(1, fan)], np.uint64))
    rows = [(prefix * fan + b, block, _packed(np.diff(k, prepend=np.uint64(0))), [_packed(v.astype("<i8")) for v in vs]) for b, (k, *vs) in enumerate(zip(*(np.split(x, cuts) for x in (keys, *values)), strict=True)) if len(k)]
    if own is not None:
        rows.append((-1 - block % fan, block, b"", [_packed(own)]))
    columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary()), pa.array(columns[3], pa.list_(pa.binary()))], names=["bucket", "block", "keys", "vals"])


_ASK_SQL = "bucket long, block long, keys binary, vals array<binary>"
_ANSWER_SQL = "block long, bucket long, vals array<binary>, stats array<double>"


def _answer(block: int | None, bucket: int, vals: list[bytes] | None, stats: list[float] | None = None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([bucket], pa.int64()), pa.array([vals], pa.list_(pa.binary())), pa.array([stats], pa.list_(pa.float64()))], names=["block", "bucket", "vals", "stats"])


def _gathered(rows: list) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """Of rows (block, keys, values): the distinct keys, the distinct key of each entry, the values, where rows end."""
    keys = [np.cumsum(_unpacked(r[1], "<u8"), dtype=np.uint64) for r in rows]
    values = [np.concatenate([_unpacked(r[2][k], "<i8") for r in rows]) for k in range(len(rows[0][2]))]
    key, number = np.unique(np.concatenate(keys), return_inverse=True)
    return key, number, values, np.cumsum([len(k) for k in keys])[:-1]


def _each(batches: Iterator[pa.RecordBatch], settle: Callable) -> Iterator[pa.RecordBatch]:
    """settle(first column, rows of the others) for each run of rows whose first column is equal."""
    at, rows = None, []
    for batch in batches:
        for now, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now != at and rows:
                yield from settle(at, rows)
                rows = []
            at = now
            rows.append(row)
    if rows:
        yield from settle(at, rows)


def _answered(reply: Callable):
    """Partitions sorted by bucket. reply(key, number, values) -> (answers by entry, stats), where number is the distinct
    key of each entry."""

    def settle(bucket: int, rows: list) -> Iterator[pa.RecordBatch]:
        if bucket < 0:
            # What blocks keep for themselves.
            yield from (_answer(block, bucket, vals) for block, _, vals in rows)
            return
        key, number, values, cuts = _gathered(rows)
        answers, stats = reply(key, number, values)
        for row, *parts in zip(rows, *(np.split(x, cuts) for x in answers), strict=True):
            yield _answer(row[0], bucket, [_packed(x.astype("<i8")) for x in parts])
        yield _answer(None, bucket, None, [float(x) for x in stats])

    return lambda batches: _each(batches, settle)


def _merged(groups: int, fan: int, bits: int):
    """Partitions sorted by unit, a unit being a bucket's rows of one group of blocks: each asks as one block would."""

    def settle(unit: int, rows: list) -> Iterator[pa.RecordBatch]:
        key, number, values, _ = _gathered(rows)
        yield _asked(unit, key, [np.bincount(number, v, len(key)).astype(np.int64) for v in values], fan, prefix=unit // groups, bits=bits)

    return lambda batches: _each(batches, settle)


def _spread(groups: int, owned: bool):
    """Partitions sorted by unit, the unit's answers before its rows: the answers to every block of it.

    owned: the lowest bit of an answer is for one block of the unit alone, the first with a count.
    """

    def settle(unit: int, rows: list) -> Iterator[pa.RecordBatch]:
        parts = [r[3] for r in rows if r[3] is not None][0]
        asked = [r[:3] for r in rows if r[3] is None]
        _, number, values, cuts = _gathered(asked)
        answers = [x[number] for x in _told(parts, len(parts[0]["vals"]))]
        if owned:
            seen = np.flatnonzero(values[0])
            first = np.zeros(len(number), np.int64)
            first[seen[np.unique(number[seen], return_index=True)[1]]] = 1
            answers = [x - (x & 1) * (1 - first) for x in answers]
        for row, *split in zip(asked, *(np.split(x, cuts) for x in answers), strict=True):
            yield _answer(row[0], unit // groups, [_packed(x.astype("<i8")) for x in split])

    return lambda batches: _each(batches, settle)


def _exchange(asks: DataFrame, reply: Callable, tag: str, blocks: int, buckets: int, owned: bool = False, bits: int = 0) -> tuple[DataFrame, np.ndarray]:
    """(block, parts) with the answers of all buckets to each block, and the sum of the buckets' stats.

    A block addresses at most FAN buckets. Where there are more, groups of FAN blocks are merged in each of them and ask
    the finer buckets in it as one block would, so rows grow with the blocks and not with their square.
    """
    n = tasks(asks.sparkSession)
    if buckets <= FAN:
        told = written(asks.repartition(n, "bucket").sortWithinPartitions("bucket", "block").mapInArrow(_answered(reply), _ANSWER_SQL), tag)
        answers = told.where("block is not null")
        # A few sums, whatever the number of buckets.
        stats = np.zeros(8)
        for pos, x in told.where("stats is not null").select(F.posexplode("stats")).groupBy("pos").agg(F.sum("col")).collect():
            stats[pos] = x
    else:
        groups = -(-blocks // FAN)
        bits += FAN.bit_length() - 1
        kept = written(asks, f"{tag}-asks")
        units = kept.where("bucket >= 0").select((F.col("bucket") * groups + F.pmod(F.xxhash64("block"), F.lit(groups))).alias("unit"), "block", "keys", "vals")
        merged = units.repartition(n, "unit").sortWithinPartitions("unit", "block").mapInArrow(_merged(groups, min(FAN, buckets // FAN), bits), _ASK_SQL)
        parts, stats = _exchange(merged, reply, tag, FAN * groups, buckets // FAN, owned, bits)
        sides = units.withColumn("parts", F.lit(None).cast(parts.schema[tag].dataType)).unionByName(parts.select(F.col("block").alias("unit"), F.col(tag).alias("parts")), allowMissingColumns=True)
        spread = sides.repartition(n, "unit").sortWithinPartitions("unit", F.col("parts").isNull(), "block").mapInArrow(_spread(groups, owned), _ANSWER_SQL)
        own = kept.where("bucket < 0").select("block", "bucket", "vals", F.lit(None).cast("array<double>").alias("stats"))
        answers = written(spread.unionByName(own), tag)
    # A block's answers are as many as the buckets that it addresses, and as long as the block has keys.
    return answers.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("bucket", "vals"))).alias(tag)), stats


def _told(parts: list[dict], n: int) -> list[np.ndarray]:
    """The n answers to a block, in the order of its sorted keys."""
    return [np.concatenate([_unpacked(p["vals"][k], "<i8") for p in parts if p["bucket"] >= 0]) for k in range(n)]


def _kept(parts: list[dict]) -> np.ndarray:
    """What a block has kept for itself: the tables of its pairs of several customers."""
    return _unpacked(next(p["vals"][0] for p in parts if p["bucket"] < 0), "<i8")


# -- seating -------------------------------------------------------------------------------------


@lru_cache(maxsize=4)
def _steps(discount: float) -> np.ndarray:
    """S(c, t + 1) / S(c, t) of generalized Stirling numbers at [c, t - 1], up to EXACT customers."""
    logs = np.full((EXACT + 1, EXACT + 1), -np.inf)
    logs[0, 0] = 0
    for n in range(EXACT):
        t = np.arange(1, n + 2)
        with np.errstate(divide="ignore", invalid="ignore"):
            stay = logs[n, t] + np.log(np.maximum(n - t * discount, 0))
        logs[n + 1, t] = np.logaddexp(logs[n, t - 1], np.where(np.isnan(stay), -np.inf, stay))
    with np.errstate(invalid="ignore"):
        return np.nan_to_num(np.exp(logs[:, 2:] - logs[:, 1:-1]))


def tables(customers: np.ndarray, weight: np.ndarray, discount: float, keys: np.ndarray, salt: int) -> np.ndarray:
    """A draw of the number of tables of each dish; weight: of a new table, against customers less discounts."""
    out = np.minimum(customers, 1).astype(np.int64)
    steps = _steps(discount)
    some = np.flatnonzero((customers > 1) & (customers <= EXACT))
    some = some[np.argsort(customers[some].astype(np.uint8), kind="stable")]
    a, u = np.maximum(weight[some], 1e-300), _uniform(keys[some], salt)
    ends = np.cumsum(np.bincount(customers[some], minlength=EXACT + 1))
    for c in range(2, EXACT + 1):
        for k in range(int(ends[c - 1]), int(ends[c]), 8192):
            part = slice(k, min(k + 8192, int(ends[c])))
            # Probabilities against that of one table, by the ratios of neighbours.
            p = np.empty((c, part.stop - k))
            p[0] = 1
            np.multiply(steps[c, : c - 1, None], a[part], out=p[1:])
            if a[part].max() > LARGE_WEIGHT:
                p[1:] = np.log(p[1:])
                p[0] = 0
                np.cumsum(p, axis=0, out=p)
                p = np.exp(p - p.max(axis=0))
            else:
                np.cumprod(p, axis=0, out=p)
            np.cumsum(p, axis=0, out=p)
            out[some[part]] = 1 + (p < p[-1] * u[part]).sum(axis=0)
    at = np.flatnonzero(customers > EXACT)
    if len(at):
        # S(c, t) a^t is the law of a Poisson number of tables, tilted so that their sizes add up to c:
        # a x (1 - x)^(d - 1) = c gives the tilt, a / d (1 - (1 - x)^d) the mean.
        c, a = customers[at].astype(np.float64), np.maximum(weight[at], 1e-12)
        mean = a / discount * -np.expm1(discount * _tilt(np.log(c) - np.log(a), discount))
        out[at] = 1 + np.minimum(c - 1, _poisson(mean, _uniform(keys[at], salt))).astype(np.int64)
    return out


@lru_cache(maxsize=4)
def _tilts(discount: float) -> tuple[np.ndarray, np.ndarray]:
    y = -np.geomspace(1e-12, 80, 4096)
    return np.log(-np.expm1(y)) + (discount - 1) * y, y


def _tilt(target: np.ndarray, discount: float) -> np.ndarray:
    """y with log(1 - e^y) + (d - 1) y = target, in -80..0: from a grid, with two Newton steps."""
    at, grid = _tilts(discount)
    y = np.interp(target, at, grid)
    for _ in range(2):
        gone = -np.expm1(y)
        y = np.clip(y - (np.log(gone) + (discount - 1) * y - target) / (discount - 1 - np.exp(y) / gone), -80, -1e-12)
    return y


def _poisson(mean: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Quantiles of Poisson laws; from a mean of 50 on, of normal ones."""
    normal = np.rint(mean + np.sqrt(2 * mean) * _erfinv(2 * np.clip(u, 1e-9, 1 - 1e-9) - 1))
    small = mean < 50
    m, left = mean[small], u[small].copy()
    out, term = np.zeros(len(m)), np.exp(-m)
    for k in range(1, 200):
        left -= term
        if not (left > 0).any():
            break
        out += left > 0
        term = term * m / k
    normal[small] = out
    return np.maximum(normal, 0)


def _erfinv(x: np.ndarray) -> np.ndarray:
    """Inverse error function by Winitzki's closed form, good to 2e-3."""
    log = np.log(np.maximum(1 - x * x, 1e-300))
    a = 2 / (np.pi * 0.147) + log / 2
    return np.sign(x) * np.sqrt(np.maximum(np.sqrt(a * a - log / 0.147) - a, 0))


class _Model:
    """What all blocks share in a sweep: discounts, and totals of the root restaurant."""

    def __init__(self, discount: float, root_discount: float, stats: np.ndarray) -> None:
        self.d, self.root_d = discount, root_discount
        self.n, self.v, self.customers, self.tables = stats[:4]

    def base(self) -> float:
        return (1 - UNKNOWN) / max(self.v, 1)

    def root(self, count: np.ndarray, customers: np.ndarray, tables_: np.ndarray) -> np.ndarray:
        """Probability of words at the root; words without a count are of the unknown class."""
        all_ = ROOT_STRENGTH + self.customers
        fresh = (ROOT_STRENGTH + self.root_d * self.tables) / all_
        return np.where(count > 0, (customers - self.root_d * tables_) / all_ + fresh * self.base(), fresh * UNKNOWN)


def _pairs_reply(key: np.ndarray, number: np.ndarray, values: list[np.ndarray]) -> tuple[list[np.ndarray], list[float]]:
    """Training count of each pair, doubled, and 1 for the row whose block owns it: the first with a count."""
    n = values[0]
    total = np.bincount(number, n, len(key)).astype(np.int64)
    seen = np.flatnonzero(n)
    owner = np.zeros(len(n), np.int64)
    owner[seen[np.unique(number[seen], return_index=True)[1]]] = 1
    return [2 * total[number] + owner], [(total == 1).sum(), (total == 2).sum(), len(n)]


def _counts_reply(key: np.ndarray, number: np.ndarray, values: list[np.ndarray]) -> tuple[list[np.ndarray], list[float]]:
    """Training count of each word; all training tokens and how many words have one."""
    count = np.bincount(number, values[0], len(key)).astype(np.int64)
    word = key != START
    return [count[number]], [count[word].sum(), (count[word] > 0).sum()]


def _words_reply(model: _Model | None, salt: int):
    """Totals of each word: training count, customers and tables at the root, tables in its own restaurant."""

    def reply(key: np.ndarray, number: np.ndarray, values: list[np.ndarray]) -> tuple[list[np.ndarray], list[float]]:
        count, sent, own = (np.bincount(number, v, len(key)).astype(np.int64) for v in values)
        if model is None:
            seated = np.minimum(sent, 1)
        else:
            weight = np.full(len(key), (ROOT_STRENGTH + model.root_d * model.tables) * model.base())
            seated = tables(sent, weight, model.root_d, key, salt)
        word = key != START
        stats = [count[word].sum(), (count[word] > 0).sum(), sent.sum(), seated.sum(), (sent == 1).sum(), (sent == 2).sum()]
        return [x[number] for x in (count, sent, seated, own)], stats

    return reply


def _seated(block: _Block, pair: np.ndarray, word: list[np.ndarray], model: _Model, sweep: int) -> np.ndarray:
    """Tables of every pair of a block in a sweep; the same in every block that has the pair."""
    c = pair >> 1
    count, sent, root, own = word
    p = model.root(count, sent, root)
    out = np.minimum(c, 1)
    many = np.flatnonzero(c > 1)
    u, w = block.pair_u[many], block.pair_w[many]
    out[many] = tables(c[many], (STRENGTH + model.d * own[u]) * p[w], model.d, block.pair_keys(many), 100_000 * sweep)
    return out


def predictive(block: _Block, pair: np.ndarray, seated: np.ndarray, word: list[np.ndarray], model: _Model) -> np.ndarray:
    """Probability of the second word of every pair after the first; a context without a count leaves all to the root."""
    count, sent, root, own = word
    customers, t = count[block.pair_u], own[block.pair_u]
    return (np.maximum((pair >> 1) - model.d * seated, 0) + (STRENGTH + model.d * t) * model.root(count, sent, root)[block.pair_w]) / (STRENGTH + customers)


def _sent(block: _Block, pair: np.ndarray, seated: np.ndarray) -> list[np.ndarray]:
    """Per word of a block: its training count here, tables of it as a dish and in its restaurant, of pairs owned here."""
    mine = np.where(pair & 1, seated, 0)
    n = len(block.words)
    return [block.counts, np.bincount(block.pair_w, mine, n), np.bincount(block.pair_u, mine, n)]


def _bucketed(df: DataFrame, tag: str, n: int) -> DataFrame:
    """df as a table in the shared folder, bucketed by block; its name in the catalogue is taken back at once."""
    spark, name = df.sparkSession, f"{tag}_{uuid.uuid4().hex}"
    df.write.bucketBy(n, "block").option("path", fresh_path(spark, tag)).option("compression", "none").saveAsTable(name)
    found = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return found


def _discount(once: float, twice: float) -> float:
    """From how many have one and two customers, kept inside (0, 1)."""
    return min(0.95, max(0.05, once / (once + 2 * twice) if once + twice else 0.5))


def _blocks(docs: DataFrame, held_out: Column, id_col: str, text_col: str, row_col: str | None) -> tuple[DataFrame, int, int]:
    """(blocks of all texts, their number, buckets for their keys)."""
    spark = docs.sparkSession
    small_batches(spark, 256)
    row = F.monotonically_increasing_id() if row_col is None else F.col(row_col).cast("long")
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), row.alias("row"), held_out.cast("boolean").alias("held"))
    # Bucketed by block, so that joins move the small answers and not the blocks. Their blobs are compressed already.
    blocks = _bucketed(source.mapInArrow(_cut(BLOCK_TOKENS), _BLOCK_SQL), "blocks", tasks(spark, 1))
    small_batches(spark, 4)
    count = blocks.count()
    return blocks, count, 1 << max(5, math.ceil(math.log2(max(1, count * BLOCK_TOKENS / BUCKET_TOKENS))))


def base_scores(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As score(), without the model's own column: <id_col>, held_out, n_tokens, n_known, train_tokens, base_score.

    These follow from the counts of words alone, so one exchange finds them: no pairs, no seating.
    """
    blocks, count, buckets = _blocks(docs, held_out, id_col, text_col, None)
    fan = min(FAN, buckets)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                b = _Block.read(r)
                yield _asked(r["block"], b.words, [b.counts], fan)

    words, (n, v, *_) = _exchange(blocks.select("block", "words", "counts").mapInArrow(ask, _ASK_SQL), _counts_reply, "words0", count, buckets)

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                b = _Block.read(r)
                columns = _base_columns(b, _told(r["words0"], 1)[0], n, v)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns.values()], names=list(columns))

    joined = blocks.select("block", "ids", "rows", "held", "sizes", "pair_w", "tokens").join(words.hint("shuffle_hash"), "block")
    out = joined.mapInArrow(final, "id long, row long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double")
    return out.select(F.when(F.col("id") != NO_ID, F.col("id")).alias(id_col), "held_out", "n_tokens", "n_known", "train_tokens", "base_score")


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, burn_in: int = BURN_IN, samples: int = SAMPLES) -> DataFrame:
    """One row per row of docs: <id_col>, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Rows that held_out (a Column) holds for are scored but not learned from.
    """
    n = tasks(docs.sparkSession, 1)
    blocks, count, buckets = _blocks(docs, held_out, id_col, text_col, row_col)
    fan = min(FAN, buckets)

    def ask_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                b = _Block.read(r)
                keys = b.pair_keys()
                yield _asked(r["block"], keys, [b.pair_n], fan, np.argsort(keys))

    def settle_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                b = _Block.read(r)
                (told,) = _told(r["pairs"], 1)
                pair = np.empty(len(told), "<i8")
                pair[np.argsort(b.pair_keys())] = told
                yield pa.RecordBatch.from_arrays([pa.array([r["block"]], pa.int64()), pa.array([_packed(pair)], pa.binary())], names=["block", "pair"])

    pairs = blocks.select("block", "words", "pair_u", "pair_w", "pair_n")
    told, (once, twice, *_) = _exchange(pairs.mapInArrow(ask_pairs, _ASK_SQL), _pairs_reply, "pairs", count, buckets, owned=True)
    # The answers in the blocks' own order; from here on keys of pairs need no more sorting.
    counted = _bucketed(pairs.drop("pair_n").join(told.hint("shuffle_hash"), "block").mapInArrow(settle_pairs, "block long, pair binary"), "counted", n)
    slim = blocks.select("block", "words", "counts", "pair_u", "pair_w").join(counted.hint("shuffle_hash"), "block")
    discount = _discount(once, twice)

    def ask_words(model: _Model | None, sweep: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    b, pair = _Block.read(r), _unpacked(r["pair"], "<i8")
                    seated = np.minimum(pair >> 1, 1) if model is None else _seated(b, pair, _told(r["words0"], 4), model, sweep)
                    yield _asked(r["block"], b.words, _sent(b, pair, seated), fan, own=seated[pair > 3].astype("<i8") if sweep > burn_in else None)

        return run

    # The first seating has one table for each dish; each sweep draws anew, given the one before.
    words, stats = _exchange(slim.mapInArrow(ask_words(None, 0), _ASK_SQL), _words_reply(None, 0), "words0", count, buckets)
    root_discount = _discount(stats[4], stats[5])
    model = _Model(discount, root_discount, stats)
    kept: list[tuple[DataFrame, _Model]] = [(words, model)]
    for sweep in range(1, burn_in + samples + 1):
        joined = slim.join(words.hint("shuffle_hash"), "block")
        words, stats = _exchange(joined.mapInArrow(ask_words(model, sweep), _ASK_SQL), _words_reply(model, sweep), "words0", count, buckets)
        model = _Model(discount, root_discount, stats)
        kept.append((words, model))

    chosen = list(range(burn_in + 1, burn_in + samples + 1))
    models = [m for _, m in kept]

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                yield _scored(r, models, chosen)

    joined = blocks.drop("pair_n", "counts").join(counted.hint("shuffle_hash"), "block")
    for k in chosen:
        joined = joined.join(kept[k][0].withColumnRenamed("words0", f"words{k}").hint("shuffle_hash"), "block")
    out = joined.mapInArrow(final, "id long, row long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.select(F.when(F.col("id") != NO_ID, F.col("id")).alias(id_col), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", *([] if row_col is None else [F.col("row").alias(row_col)]))


def _scored(r: dict, models: list[_Model], chosen: list[int]) -> pa.RecordBatch:
    b = _Block.read(r)
    pair = _unpacked(r["pair"], "<i8")
    p = np.zeros(len(pair))
    for k in chosen:
        told = _told(r[f"words{k}"], 4)
        seated = np.minimum(pair >> 1, 1)
        seated[pair > 3] = _kept(r[f"words{k}"])
        p += predictive(b, pair, seated, told, models[k])
    logs = np.log10(p / len(chosen))
    columns = _base_columns(b, told[0], models[0].n, models[0].v)
    columns["score"] = np.add.reduceat(logs[b.tokens], np.cumsum(b.sizes) - b.sizes)
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns.values()], names=list(columns))


def _base_columns(b: _Block, count: np.ndarray, n: float, v: float) -> dict[str, np.ndarray]:
    """What follows from the training count of each word of a block, from all training tokens and the distinct ones."""
    base = np.log10((count + 0.5) / (n + 0.5 * (v + 1)))
    word = b.pair_w[b.tokens]
    start = np.cumsum(b.sizes) - b.sizes
    known, total = (np.add.reduceat(x, start) for x in ((count[word] > 0).astype(np.int64), base[word]))
    return {"id": b.ids, "row": b.rows, "held_out": b.held.astype(bool), "n_tokens": b.sizes, "n_known": known, "train_tokens": np.full(len(b.ids), int(n)), "base_score": total}
