"""Base scores without the model's sweeps."""

from runledger.llm import pitman_yor
from runledger.llm.common import fold
from runledger.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_base_scores_are_those_of_the_model(spark, monkeypatch):
    tags = []
    exchange = pitman_yor._exchange
    monkeypatch.setattr(pitman_yor, "_exchange", lambda asks, reply, tag, *rest, **kw: tags.append(tag) or exchange(asks, reply, tag, *rest, **kw))
    columns = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score"]
    base = QUERIES["token_base_scores"](spark, SF).select(*columns).collect()
    # The counts of words are all that is asked for.
    assert tags == ["words0"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scored = pitman_yor.score(docs, fold("doc_id", 5) == 1).collect()
    assert sorted(tuple(r) for r in base) == sorted((*[r[c] for c in columns[:-1]], round(r["base_score"], 3)) for r in scored)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "A a b"), (3, "b"), (None, "zz")], "doc_id long, text string")
    got = pitman_yor.base_scores(odd, fold("doc_id", 5) == 9).select(*columns[:-1]).collect()
    # Words a, b, zz and the end: 2 + 2 + 1 + 5 tokens.
    assert sorted((tuple(r) for r in got), key=str) == sorted([(1, False, 1, 1, 10), (2, False, 1, 1, 10), (3, False, 4, 4, 10), (3, False, 2, 2, 10), (None, False, 2, 2, 10)], key=str)
    assert pitman_yor.base_scores(odd.limit(0), fold("doc_id", 5) == 1).collect() == []
