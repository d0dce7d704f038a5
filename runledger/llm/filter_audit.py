"""How filters of a corpus interact: what each removes, at every place in every order of them.

Five filters, A to E, mark each document by the set of those that it fails. A table maps each set (with what the labels say)
to one big integer. Its fields, 64 bits each, hold the outcome of all 600 steps of the 120 orders: 1 where the
document is removed. So the sum of the integers of a part of the corpus counts every step of every order at once; a field
overflows after 2^64 documents. Tasks add up the documents that they hold and send one integer for each part; these are
added up part by part, in a stream, and unpacked.

A document fails
  A with under 200 words,
  B if less than half of its words are different,
  C if over 2% of its code points are A-Z,
  D with any of # $ % & * |,
  E if a document with a smaller id has the same text, whether or not any filter removes that one.

Null text counts as empty; an empty text fails A, and E where it is repeated. A null id is neither smaller nor larger
than another, so such a row makes no other fail E and doesn't fail it; nor do rows of equal ids each other. Null sources
are the part ''. Very long texts are read whole. Labels of a document that is labelled more than once count if any row has
them; labels of no document, or of a null id, for nothing. Other columns of the tables, whatever their names, play no
part. An empty table has no parts and gives no rows.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.llm.common import as_bytes, small_batches, tasks, written

LETTERS = "ABCDE"
#: Fixed values of the contract.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 2
CAPITALS, SIGNS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"
#: Bytes that go on with a code point.
_WITHIN = bytes(range(0x80, 0xC0))
#: Bits of a field, and parts that a task adds up before it sends them on.
FIELD, MOST_PARTS = 64, 2048


def failed(raw: bytes) -> int:
    """The filters A to D that a text fails, as bits; words are runs of other bytes than space and \\t to \\r."""
    words = raw.split()
    few = len(words) < LEAST_WORDS
    same = 100 * len(set(words)) < LEAST_DISTINCT * len(words)
    capitals = len(raw) - len(raw.translate(None, CAPITALS))
    loud = 100 * capitals > MOST_CAPITALS * len(raw.translate(None, _WITHIN))
    odd = len(raw.translate(None, SIGNS)) < len(raw)
    return few | same << 1 | loud << 2 | odd << 3


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = as_bytes(batch.column("text"))
        shas = [hashlib.sha256(t).digest() for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("part"), pa.array([failed(t) for t in texts], pa.int32()), pa.array(shas, pa.binary())], names=["id", "part", "mask", "sha"])


def marked(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, mask, good, toxic) of every document: the filters that it fails as bits, from A on; what its labels say."""
    small_batches(docs.sparkSession)
    part = F.coalesce(F.col(part_col).cast("string"), F.lit(""))
    source = docs.select(F.col(id_col).cast("long").alias("id"), part.alias("part"), F.col(text_col).cast("string").alias("text"))
    seen = written(source.mapInArrow(_marks, "id long, part string, mask int, sha binary"), "marks")
    # What is joined is stored apart from the rows, so that a text or an id of many rows can be split; neither is broadcast.
    firsts = written(seen.groupBy(F.col("sha").alias("text_sha")).agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("text_sha", "first"), "firsts")
    repeated = F.coalesce(F.col("id") > F.col("first"), F.lit(False))
    rows = seen.join(firsts.hint("merge"), F.col("sha") == F.col("text_sha"), "left").select("id", "part", F.col("mask").bitwiseOR(F.when(repeated, 16).otherwise(0)).alias("mask"))
    if labels is None:
        return rows.select("part", "mask", F.lit(False).alias("good"), F.lit(False).alias("toxic"))
    says = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    told = labels.groupBy(F.col(id_col).cast("long").alias("label_id")).agg(says("quality").alias("good"), says("toxic").alias("toxic"))
    told = written(told.where("label_id IS NOT NULL AND (good OR toxic)"), "labels")
    no = F.lit(False)
    return rows.join(told.hint("merge"), F.col("id") == F.col("label_id"), "left").select("part", "mask", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))


class Counters:
    """Packed counters of all orders of some filters.

    Fields, from the lowest: removed at each step of each order; the same of good documents; of toxic ones; then the failures
    of each filter, the failures of it alone, and all documents.
    """

    def __init__(self, letters: str = LETTERS) -> None:
        self.letters = letters
        self.orders = ["".join(p) for p in permutations(letters)]
        n = len(letters)
        #: The filter of each step of each order.
        self.filters = np.array([[letters.index(c) for c in order] for order in self.orders])
        self.steps = self.filters.size
        self.fields = 3 * self.steps + 2 * n + 1
        self.integers = [self._integer(mask, bool(flags & 1), bool(flags & 2)) for mask in range(1 << n) for flags in range(4)]

    def _integer(self, mask: int, good: bool, toxic: bool) -> int:
        fails = (mask >> self.filters) & 1
        # Removed by the first filter of the order that it fails.
        removed = (fails & (np.cumsum(fails, 1) == 1)).ravel()
        n = len(self.letters)
        alone = [int(mask == 1 << k) for k in range(n)]
        fields = [*removed, *(removed * good), *(removed * toxic), *((mask >> k) & 1 for k in range(n)), *alone, 1]
        return sum(int(x) << (FIELD * k) for k, x in enumerate(fields))

    def of(self, mask: int, good: bool, toxic: bool) -> int:
        return self.integers[4 * mask + good + 2 * toxic]

    def unpacked(self, total: int) -> dict[str, np.ndarray]:
        """kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley of each order and step."""
        fields = np.frombuffer(total.to_bytes(self.fields * FIELD // 8, "little"), "<u8").astype(np.int64)
        removed, good, toxic = fields[: 3 * self.steps].reshape(3, len(self.orders), len(self.letters))
        fails, alone, every = np.split(fields[3 * self.steps :], [len(self.letters), 2 * len(self.letters)])
        shapley = np.zeros(len(self.letters), np.int64)
        np.add.at(shapley, self.filters, removed)
        return {
            "kept": every[0] - np.cumsum(removed, 1),
            "removed": removed,
            "redundant": fails[self.filters] - removed,
            "unique_fails": alone[self.filters],
            "good_lost": good,
            "toxic_lost": toxic,
            "shapley": shapley[self.filters],
        }


_SENT = ["part", "total"]


def _added(counters: Counters):
    """One integer for each part that a task holds, or more if there are many parts."""

    def sent(totals: dict[str, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(totals), pa.string()), pa.array([t.to_bytes(-(-t.bit_length() // 8), "little") for t in totals.values()], pa.binary())], names=_SENT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, int] = {}
        for batch in batches:
            for (part, *kind), n in Counter(zip(*(c.to_pylist() for c in batch.columns), strict=True)).items():
                totals[part] = totals.get(part, 0) + n * counters.of(*kind)
            if len(totals) > MOST_PARTS:
                yield sent(totals)
                totals = {}
        if totals:
            yield sent(totals)

    return run


def _told(counters: Counters):
    """The rows of each part; integers come sorted by part, so one sum is held at a time."""
    n = len(counters.letters)

    def rows(part: str, total: int) -> pa.RecordBatch:
        orders = np.repeat(np.array(counters.orders, object), n)
        counts = [pa.array(c.ravel(), pa.int64()) for c in counters.unpacked(total).values()]
        return pa.RecordBatch.from_arrays([pa.array([part] * counters.steps), pa.array(orders, pa.string()), pa.array(np.tile(np.arange(1, n + 1), len(counters.orders)), pa.int32()), *counts], names=_TOLD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, 0
        for batch in batches:
            for part, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != at:
                    if at is not None:
                        yield rows(at, total)
                    at, total = part, 0
                total += int.from_bytes(packed, "little")
        if at is not None:
            yield rows(at, total)

    return run


_COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
_TOLD = ["part", "filter_order", "step", *_COUNTS]


def interactions(rows: DataFrame, letters: str = LETTERS) -> DataFrame:
    """One row per part, order and step of documents (part, mask, good, toxic), whose masks have a bit per letter."""
    counters = Counters(letters)
    sums = rows.select("part", "mask", "good", "toxic").mapInArrow(_added(counters), "part string, total binary")
    dealt = sums.repartition(tasks(rows.sparkSession), "part").sortWithinPartitions("part")
    return dealt.mapInArrow(_told(counters), ", ".join(["part string, filter_order string, step int", *[f"{c} long" for c in _COUNTS]]))


def audit(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """The five filters over docs: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    shapley sums what the step's filter removes over all orders, wherever it stands; over 120 it is the filter's Shapley value.
    """
    return interactions(marked(docs, labels, id_col, text_col, part_col))


def oracle() -> str:
    """The same rows in DuckDB SQL."""
    order = " || ".join(f"{c}.l" for c in "abcde")
    joins = " ".join(f"JOIN l {y} ON {' AND '.join(f'{y}.l <> {x}.l' for x in 'abcde'[:k])}" for k, y in enumerate("abcde") if k)
    fails = ["len(w) < 200", "100 * len(list_distinct(w)) < 50 * len(w)", "100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t)", "regexp_matches(t, '[#$%&*|]')", "coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)"]
    mask = " + ".join(f"{1 << k} * ({f})::INT" for k, f in enumerate(fails))
    label = lambda c: f"doc_id IN (SELECT doc_id FROM labels WHERE {c} = 1 AND doc_id IS NOT NULL)"
    return f"""
    WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    m AS (SELECT part, {mask} AS mask, coalesce({label("quality")}, false) AS good, coalesce({label("toxic")}, false) AS toxic FROM d),
    g AS MATERIALIZED (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY ALL),
    l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
    o AS (SELECT {order} AS filter_order FROM l a {joins}),
    s AS (SELECT filter_order, step::INT AS step, (1 << (ascii(substr(filter_order, step, 1)) - 65)::INT) AS bit,
        list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(substr(filter_order, i, 1)) - 65)::INT)) AS before FROM o, range(1, 6) r(step)),
    c AS (SELECT part, filter_order, step, bit,
        sum(n) FILTER (mask & (coalesce(before, 0)::INT | bit) = 0) AS kept,
        sum(n) FILTER (mask & coalesce(before, 0)::INT = 0 AND mask & bit <> 0) AS removed,
        sum(n) FILTER (mask & coalesce(before, 0)::INT <> 0 AND mask & bit <> 0) AS redundant,
        sum(n) FILTER (mask = bit) AS unique_fails,
        sum(good) FILTER (mask & coalesce(before, 0)::INT = 0 AND mask & bit <> 0) AS good_lost,
        sum(toxic) FILTER (mask & coalesce(before, 0)::INT = 0 AND mask & bit <> 0) AS toxic_lost
        FROM g, s GROUP BY ALL)
    SELECT part, filter_order, step, {", ".join(f"coalesce({c}, 0)::BIGINT AS {c}" for c in _COUNTS[:-1])},
        coalesce(sum(removed) OVER (PARTITION BY part, bit), 0)::BIGINT AS shapley FROM c
    """
