import gzip
import re

import pytest
from pyspark.sql import functions as F

from runledger.llm.common import with_row
from runledger.llm.warc import digest, filesystem, lookup, parse, record, surt, write_archive

ROWS = [
    (5, "http://www.a.example:80/x?b=1#f", "<p>ü</p>"),
    (3, "https://b.example", "<p>ü</p>"),
    (3, "https://b.example", "<p>ü</p>"),
    (1, "http://c.example/\r\nEvil: 1", None),
    (2, None, ""),
    (None, "not a url", "<p>ü</p>"),
    (None, "http://[bad", "only"),
    (9, "http://b.example/", "a\r\n\r\nb\r\n\r\nWARC/1.1" + "long " * 300_000),
]


def test_keys():
    assert surt("https://WWW.Sub.Example.org:443/A/b?q=1#top") == "org,example,sub)/A/b?q=1"
    assert surt("http://a.example:8080") == "example,a:8080)/"
    assert surt(None) == "-"


def test_records_round_trip():
    for page, url, html in ROWS:
        payload = (html or "").encode()
        got = parse(record(page, url, payload, None))
        assert (got["page_id"], got["url"], got["payload"], got["record_type"], got["refers_to"]) == (page, url, payload, "response", None)
        got = parse(record(page, url, payload, "77"))
        assert (got["payload_bytes"], got["payload_digest"], got["record_type"], got["refers_to"]) == (len(payload), digest(payload), "revisit", 77)
    with pytest.raises(ValueError):
        parse(record(1, "u", b"abc", None).replace(b"abc", b"abd"))


@pytest.fixture(scope="module")
def archive(spark):
    frame = spark.createDataFrame([(*r, "x") for r in ROWS], "page_id long, url string, html string, surt string").repartition(3)
    return frame, write_archive(frame, block_lines=2, file_bytes=200)


def test_every_record_is_found(spark, archive):
    frame, kept = archive
    got = lookup(kept, frame).collect()
    assert len(got) == len(ROWS)
    first = {"<p>ü</p>": 3, "": 1}
    for r in got:
        assert r["record_type"] == "response" or r["payload"] is None
    texts = sorted((r["page_id"] or 0, r["payload_bytes"], r["payload_digest"]) for r in got)
    assert texts == sorted((p or 0, len((h or "").encode()), digest((h or "").encode())) for p, _, h in ROWS)
    kinds = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"] or 0) for r in got if r["payload_digest"] == digest("<p>ü</p>".encode()))
    assert kinds == [(0, "revisit", 3), (3, "response", 0), (3, "revisit", 3), (5, "revisit", 3)]
    assert {r["page_id"]: r["refers_to"] for r in got if not r["payload_bytes"]} == {1: None, 2: first[""]}
    long = next(r for r in got if r["page_id"] == 9)
    assert bytes(long["payload"]).decode() == ROWS[-1][2] and long["url"] == ROWS[-1][1]


def test_lookup_of_some_keys(spark, archive):
    _, kept = archive
    ask = spark.createDataFrame([("http://b.example/",), ("http://a.example/x?b=1",), ("http://zz.example/",), (None,)], "url string")
    assert sorted(str(r["page_id"]) for r in lookup(kept, ask).collect()) == ["2", "3", "3", "5", "9"]


def test_members_are_plain_warc(spark, archive):
    _, kept = archive
    store, base = filesystem(kept.folder)
    files = [f.path for f in store.get_file_info(__import__("pyarrow").fs.FileSelector(base)) if f.path.endswith(".warc.gz")]
    assert len(files) > 3
    text = b"".join(gzip.decompress(store.open_input_stream(f, compression=None).read()) for f in files)
    assert len(re.findall(rb"WARC/1\.1\r\nWARC-Type", text)) == len(ROWS)


def test_one_hot_key_over_many_blocks(spark):
    frame = spark.range(300).select(F.col("id").alias("page_id"), F.when(F.col("id") % 3 == 0, F.lit("http://hot.example/")).otherwise(F.concat(F.lit("http://h"), "id", F.lit(".example/"))).alias("url"), (F.col("id") % 7).cast("string").alias("html"))
    kept = write_archive(frame, block_lines=4)
    got = lookup(kept, frame).collect()
    assert sorted(r["page_id"] for r in got) == list(range(300))
    assert sum(r["record_type"] == "response" for r in got) == 7
    only = lookup(kept, frame.where("page_id = 0")).collect()
    assert sorted(r["page_id"] for r in only) == list(range(0, 300, 3))


def test_urls_with_line_separators(spark):
    # Characters that Unicode counts as line ends, but an index line does not.
    rows = [(k, f"http://a.example/{k}{c}y", "x") for k, c in enumerate("\u0085\u2028\u2029\x0b\x1c\n")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert sorted(r["page_id"] for r in lookup(write_archive(frame, block_lines=1), frame).collect()) == list(range(6))


def test_row_numbers_are_unique_and_stable(spark, tmp_path):
    spark.range(1000).repartition(7).write.parquet(str(tmp_path / "t"))
    for size in ("1k", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        rows = with_row(spark.read.parquet(str(tmp_path / "t"))).collect()
        assert len({r["_row"] for r in rows}) == 1000
        first = {r["id"]: r["_row"] for r in rows} if size == "1k" else first
        assert first == {r["id"]: r["_row"] for r in rows}


def test_empty_table(spark, archive):
    frame, _ = archive
    none = frame.where(F.lit(False))
    assert lookup(write_archive(none), frame).collect() == []
