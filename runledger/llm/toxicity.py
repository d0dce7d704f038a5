"""Toxicity by weak supervision.

Voters are lexicon terms (whole words, prefixes and suffixes, mined from a bounded sample of labelled
rows, with a fixed seed list) and patterns. A generative label model learns, by EM over the vote patterns
of all documents, how often each voter votes for each class. From the expected counts of pairs of votes it
then takes which voters depend on each other within a class, the forest of most mutual information, and learns
by EM again how often each voter votes for each class beside each vote of its parent, so terms which fire
together do not count twice. A linear classifier of votes and densities is trained on the posteriors
over all documents and gives the scores.

Null text counts as empty. An empty text has no votes for toxic; very long texts are read whole, and equal rows
are scored alike. Terms that are equally strong are taken in the order of their spelling. Without any labels the seed list and the patterns vote alone. Other columns of the table, whatever
their names, play no part. An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.llm.common import small_batches, written
from runledger.llm.newton import blobs, fit_soft, matrix, sigmoid, summed

#: Labelled rows that the lexicon is mined from, at most.
LABELLED_ROWS = 30_000
#: Of the lexicon terms the strongest are voters of their own, the others vote in groups.
VOTING_TERMS = 64
GROUPS = 12
#: Fixed seed words, which vote even without labels.
SEEDS = ("idiot", "moron", "stupid", "trash", "scum", "loser", "pathetic", "worthless", "disgusting", "clown")
_STRIP = ".,;:!?\"'()[]{}*#$%&|<>/\\-_=+~`^"
_SHOUT = re.compile(r"!{2,}")
PATTERNS = 8
EXTRA = 5
#: Characters that capitals are counted in at a time.
PIECE = 1 << 20
#: Log-odds that count as weak, clear and strong evidence.
EVIDENCE = (3.0, 5.0, 9.0)


def term_keys(word: str) -> list[str]:
    """What a word can match: itself, its prefixes of 4-6 and its suffixes of 4-6 characters."""
    keys = ["=" + word]
    for k in (4, 5, 6):
        if len(word) > k:
            keys += ["<" + word[:k], ">" + word[-k:]]
    return keys


def words_of(text: str) -> list[str]:
    return [w for w in (x.strip(_STRIP) for x in text.lower().split()) if w]


@cache
def _upper() -> np.ndarray:
    return np.fromiter((chr(k).isupper() for k in range(sys.maxunicode + 1)), bool)


def capitals(text: str) -> int:
    """Upper-case characters of the whole text, piece by piece."""
    pieces = (text[k : k + PIECE].encode("utf-32-le", "surrogatepass") for k in range(0, len(text), PIECE))
    return sum(int(_upper()[np.frombuffer(p, "<u4")].sum()) for p in pieces)


def _mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each class that have a term, and how many documents."""
    found: tuple[Counter, Counter] = (Counter(), Counter())
    for batch in batches:
        for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found[y].update({k for w in set(words_of(text or "")) for k in term_keys(w)})
            found[y][""] += 1
        if len(found[0]) + len(found[1]) > 500_000:
            yield _counts(found)
            found = (Counter(), Counter())
    yield _counts(found)


def _counts(found: tuple[Counter, Counter]) -> pa.RecordBatch:
    terms = list(found[0] | found[1])
    return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([found[1][t] for t in terms], pa.int64()), pa.array([found[0][t] for t in terms], pa.int64())], names=["term", "pos", "neg"])


@dataclass
class Voters:
    """Lexicon terms with their log-odds, strongest first, and the share of toxic texts."""

    terms: list[str]
    odds: list[float]
    prior: float

    @property
    def n(self) -> int:
        return VOTING_TERMS + GROUPS + PATTERNS

    @property
    def d(self) -> int:
        return 1 + self.n + EXTRA


def mine_voters(docs: DataFrame, labels: DataFrame, text_col: str, id_col: str, label_col: str) -> Voters:
    """Lexicon terms far more frequent in toxic than in other labelled texts; share of toxic texts."""
    sample = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("y")).where("_id is not null and y in (0, 1)")
    sample = sample.dropDuplicates(["_id"]).orderBy(F.xxhash64("_id"), "_id").limit(LABELLED_ROWS)
    texts = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).cast("string").alias("_text"))
    rows = texts.join(F.broadcast(sample), F.col("_doc") == F.col("_id")).select("_text", "y")
    counts = rows.mapInArrow(_mine, "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    counts = written(counts.where("term = '' or pos >= 4 and pos > 20 * neg"), "terms")
    total = counts.where("term = ''").first()
    pos, neg = (total["pos"], total["neg"]) if total else (0, 0)
    # Smoothed, since among many terms a few rare ones fall on toxic texts alone by chance.
    odds = F.log((F.col("pos") + 0.5) / (pos + 1)) - F.log((F.col("neg") + 2) / (neg + 4))
    best = counts.where((F.col("term") != "") & (odds > 2) & (F.col("pos") > 20 * F.col("neg")) & (F.col("pos") >= max(4, pos // 250)))
    # Terms that several of the sampled toxic texts share: no more than the sample has words.
    best = best.select("term", odds.alias("odds")).collect()
    found = {r["term"]: float(r["odds"]) for r in best}
    found |= {"=" + s: max(found.get("=" + s, 0.0), EVIDENCE[1]) for s in SEEDS}
    ranked = sorted(found, key=lambda t: (-found[t], t))
    share = (pos + 1) / (pos + neg + 20)
    return Voters(ranked, [found[t] for t in ranked], min(0.5, max(0.005, share)))


def _votes(voters: Voters):
    """Per text: votes (-1 clean, 0 none, 1 toxic) as int8, and the classifier's features."""
    kinds = {"=": 0, "<": 1, ">": 2}

    def seat(k: int) -> int:
        """The voter of a term: its own, or the group of its kind and strength."""
        if k < VOTING_TERMS:
            return k
        return VOTING_TERMS + 4 * kinds[voters.terms[k][0]] + min(3, max(0, int(voters.odds[k] - 2)))

    place = {t: (seat(k), voters.odds[k]) for k, t in enumerate(voters.terms)}
    m = VOTING_TERMS + GROUPS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, tuple[float, tuple[int, ...], str] | None] = {}

        def terms_of(word: str) -> tuple[float, tuple[int, ...], str] | None:
            """The best log-odds among the terms of a word, all their voters, the bare word."""
            if word in cache:
                return cache[word]
            if len(cache) > 300_000:
                cache.clear()
            w = word.strip(_STRIP)
            found = [place[k] for k in term_keys(w) if k in place] if w else []
            cache[word] = (max(o for _, o in found), tuple({v for v, _ in found}), w) if found else None
            return cache[word]

        for batch in batches:
            n = batch.num_rows
            votes, extra = np.zeros((n, m + PATTERNS), np.int8), np.zeros((n, EXTRA))
            for r, text in enumerate(batch.column(1).to_pylist()):
                text = text or ""
                words = text.lower().split()
                hits, seated, odds = 0, set(), {}
                for found in map(terms_of, words):
                    if found:
                        hits += 1
                        odds[found[2]] = found[0]
                        seated.update(found[1])
                votes[r, list(seated)] = 1
                # A word counts once; what chance brings grows with the length of a text.
                top = max(odds.values(), default=0.0)
                total = sum(odds.values()) - len(words) / 300
                share = hits / max(1, len(words))
                shouts = len(_SHOUT.findall(text))
                caps = capitals(text) / max(1, len(text))
                # Patterns: strength of the best word and of all words, density, none at all, shouting.
                votes[r, m:] = [
                    1 if top > EVIDENCE[1] else -1 if top < EVIDENCE[0] else 0,
                    1 if total > EVIDENCE[0] else -1,
                    1 if total > EVIDENCE[1] else 0,
                    1 if total > EVIDENCE[2] else 0,
                    1 if share > 0.01 and hits > 1 else 0,
                    1 if len(odds) > 2 else 0,
                    -1 if not hits else 0,
                    1 if top > EVIDENCE[0] and shouts + caps > 1 else 0,
                ]
                extra[r] = [math.log1p(hits), min(1.0, 20 * share), top / 5, min(30.0, max(-5.0, total)) / 5, min(1.0, caps)]
            x = np.concatenate([np.ones((n, 1)), votes, extra], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([v.tobytes() for v in votes], pa.binary()), blobs(x)], names=["id", "row", "votes", "x"])

    return run


@dataclass
class LabelModel:
    """A latent class and, within each class, a forest of voters: a vote depends on the class and on its parent's vote.

    parent: of each voter, -1 for a root. tables: for each voter the log-odds of toxic that its vote adds, by
    3 * (parent's vote + 1) + (vote + 1); a root counts as if its parent had cast none.
    """

    bias: float
    parent: np.ndarray
    tables: np.ndarray

    def codes(self, votes: np.ndarray) -> np.ndarray:
        """Places in the tables, (rows, voters)."""
        above = np.where(self.parent >= 0, votes[:, self.parent], 0)
        return 3 * (above.astype(np.int64) + 1) + votes + 1

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        m = votes.shape[1]
        return sigmoid(self.bias + self.tables.ravel()[self.codes(votes) + 9 * np.arange(m)].sum(axis=1))


def _ballots(batch: pa.RecordBatch, m: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int8).reshape(-1, m)


def _maximised(counts: np.ndarray, parent: np.ndarray) -> LabelModel:
    """The model of expected counts (class, voter, place), toxic first; tables lean to the voter's own shares."""
    toxic, every = counts[0, 0].sum(), counts[:, 0].sum()
    share = min(0.5, max(0.002, toxic / max(1.0, every)))
    logs = []
    for n, faint in zip(counts, (1.0, 1e-2), strict=True):
        n = n.reshape(-1, 3, 3)
        own = n.sum(axis=1) + faint * np.array([0.5, 1.0, 0.5])
        own = np.clip(own / own.sum(axis=1, keepdims=True), 1e-6, 1)
        logs.append(np.log((n + own[:, None, :]) / (n.sum(axis=2, keepdims=True) + 1)))
    # A vote that isn't cast counts too: without it the share of toxic texts would drift from round to round.
    odds = np.clip(logs[0] - logs[1], -6, 6)
    return LabelModel(math.log(share / (1 - share)), parent, odds.reshape(-1, 9))


#: Votes depend on each other if within the classes they share so much of the information that the lesser of them has,
#: and by more than chance.
LEAST_SHARED, LEAST_EVIDENCE = 0.05, 30.0


def _pair_tables(pairs: np.ndarray, m: int) -> np.ndarray:
    """(voter, voter, vote, vote) shares from expected counts of pairs of cells; the last cell is on in every row."""
    n = pairs[-1, -1]
    cells = [slice(m, 2 * m), None, slice(0, m)]
    out = np.zeros((m, m, 3, 3))
    for a, i in ((0, cells[0]), (2, cells[2])):
        for b, j in ((0, cells[0]), (2, cells[2])):
            out[:, :, a, b] = pairs[i, j]
        out[:, :, a, 1] = pairs[i, -1][:, None] - out[:, :, a, 0] - out[:, :, a, 2]
        out[:, :, 1, a] = pairs[-1, i][None, :] - pairs[cells[0], i] - pairs[cells[2], i]
    out[:, :, 1, 1] = n - out.sum(axis=(2, 3))
    return np.maximum(out, 0) / max(n, 1e-9)


def _information(shares: np.ndarray) -> np.ndarray:
    """Mutual information of each pair of voters."""
    apart = shares.sum(axis=3, keepdims=True) * shares.sum(axis=2, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        terms = np.where(shares > 0, shares * np.log(shares / apart), 0)
    return np.nan_to_num(terms).sum(axis=(2, 3))


def dependencies(pairs: np.ndarray, m: int) -> np.ndarray:
    """parent of each voter: the forest of most information between votes within the classes.

    pairs: for each class the expected counts of pairs of cells (toxic votes, clean votes, one that is always on).
    """
    n = pairs[:, -1, -1]
    information = sum(k * _information(_pair_tables(p, m)) for k, p in zip(n, pairs, strict=True)) / max(n.sum(), 1e-9)
    own = np.diag(information)
    strong = (information > LEAST_SHARED * np.minimum(own[:, None], own)) & (2 * n.sum() * information > LEAST_EVIDENCE)
    parent, group = np.full(m, -1), np.arange(m)
    edges: list[list[int]] = [[] for _ in range(m)]
    for i, j in sorted(np.argwhere(np.triu(strong, 1)).tolist(), key=lambda e: (-information[e[0], e[1]], e)):
        if group[i] != group[j]:
            group[group == group[j]] = group[i]
            edges[i].append(j)
            edges[j].append(i)
    for root in range(m):
        if parent[root] < 0 and group[root] >= 0:
            queue, seen = [root], {root}
            while queue:
                i = queue.pop()
                for j in edges[i]:
                    if j not in seen:
                        seen.add(j)
                        parent[j] = i
                        queue.append(j)
            group[list(seen)] = -1
    return parent


def fit_label_model(patterns: DataFrame, m: int, prior: float, rounds: int = 6, most: int = 30) -> LabelModel:
    """patterns: (votes blob, count). EM with independent voters, then their dependencies, then EM with these until
    the log-odds settle, in at most so many rounds."""
    alone = np.full(m, -1)
    # Start: toxic where more vote so than not.
    start = np.zeros((m, 3, 3))
    start[:, :, 0], start[:, :, 2] = -1.5, 1.5
    model = LabelModel(math.log(prior / (1 - prior)), alone, start.reshape(m, 9))

    def expected(parent: np.ndarray) -> np.ndarray:
        """Expected counts (class, voter, place) of the model now, by the forest `parent`."""

        def part(batch: pa.RecordBatch, model=model) -> np.ndarray:
            votes, n = _ballots(batch, m), batch.column(1).to_numpy().astype(np.float64)
            q = model.posterior(votes)
            at = LabelModel(0.0, parent, model.tables).codes(votes) + 9 * np.arange(m)
            return np.concatenate([np.bincount(at.ravel(), np.repeat(w, m), 9 * m) for w in (n * q, n * (1 - q))])

        return summed(patterns, part, 18 * m).reshape(2, m, 9)

    for _ in range(rounds):
        model = _maximised(expected(alone), alone)

    def pairs(batch: pa.RecordBatch) -> np.ndarray:
        votes, n = _ballots(batch, m), batch.column(1).to_numpy().astype(np.float64)
        q = model.posterior(votes)
        cells = np.concatenate([votes > 0, votes < 0, np.ones((len(votes), 1), bool)], axis=1).astype(np.float64)
        return np.concatenate([(cells.T @ (cells * w[:, None])).ravel() for w in (n * q, n * (1 - q))])

    c = 2 * m + 1
    parent = dependencies(summed(patterns, pairs, 2 * c * c).reshape(2, c, c), m)
    for _ in range(most):
        before, model = model, _maximised(expected(parent), parent)
        if abs(model.bias - before.bias) < 0.01 and np.abs(model.tables - before.tables).max() < 0.05:
            break
    return model


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", row_col: str | None = None) -> DataFrame:
    """One row per row of docs: <id_col>, score (0 to 1), predicted (1 if score >= 0.5).

    labels must hold only the rows to learn from.
    """
    spark = docs.sparkSession
    small_batches(spark)
    voters = mine_voters(docs, labels, text_col, id_col, label_col)
    row = F.monotonically_increasing_id() if row_col is None else F.col(row_col).cast("long")
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), row.alias("row"))
    cast = written(source.mapInArrow(_votes(voters), "id long, row long, votes binary, x binary"), "votes")
    patterns = written(cast.groupBy("votes").agg(F.count("*").alias("n")), "patterns")
    model = fit_label_model(patterns, voters.n, voters.prior)
    m, d = voters.n, voters.d

    def target(batch: pa.RecordBatch) -> np.ndarray:
        return model.posterior(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int8).reshape(-1, m))

    w = fit_soft(cast.select("x", "votes"), target, d)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sigmoid(matrix(batch.column(2), d) @ w))], names=["id", "row", "score"])

    out = cast.select("id", "row", "x").mapInArrow(scored, "id long, row long, score double")
    return out.select(F.col("id").alias(id_col), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *([] if row_col is None else [F.col("row").alias(row_col)]))
