"""WARC round trips, against the pages themselves, and the assembly of foreign records."""

import base64
import gzip
import hashlib
import io

import pytest
from pyspark.sql import functions as F

from sieve.llm import warc as W
from sieve.llm.common import scratch_path

TRICKY = "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
PAGES = [(1, "http://a/1", "<p>same</p>"), (2, "http://a/2", "<p>same</p>"), (2, "http://a/2", "<p>same</p>"), (3, None, None), (4, "http://b", ""),
         (None, "http://null", "<p>same</p>"), (5, "http://c d\r\né", TRICKY), (6, "u", "ü" * 300_000), (-7, "u", "neg"), (8, "u", "neg"),
         (None, None, "only without id"), (None, "x", "only without id")]


def pages(spark, rows=PAGES):
    return spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).withColumn("digest", F.lit("clash"))


def test_round_trip(spark):
    got = W.warc_round_trip(pages(spark)).collect()
    assert len(got) == len(PAGES)
    for text in {p[2] or "" for p in PAGES}:
        digest = base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()
        mine = [r for r in got if r["payload_digest"] == digest]
        ids = [p[0] for p in PAGES if (p[2] or "") == text]
        assert sorted(str(r["page_id"]) for r in mine) == sorted(map(str, ids))
        assert {r["payload_bytes"] for r in mine} == {len(text.encode())}
        responses = [r for r in mine if r["record_type"] == "response"]
        first = min((i for i in ids if i is not None), default=None)
        assert len(responses) == 1 and responses[0]["page_id"] == first and responses[0]["refers_to"] is None
        assert {r["refers_to"] for r in mine if r["record_type"] == "revisit"} <= {first}
    assert W.warc_round_trip(pages(spark, PAGES[:0])).collect() == []


def test_short_payloads_are_all_responses(spark):
    got = W.warc_round_trip(pages(spark), min_bytes=1000).collect()
    assert {r["record_type"] for r in got} == {"response"}


def test_payloads_come_back_whole(spark):
    manifest = W.write_warc(W.captures(pages(spark)), scratch_path(spark, "warc"), file_bytes=500)
    assert manifest.count() > 2 and manifest.agg(F.sum("records")).first()[0] == 3 * len(PAGES)
    whole = W.assemble(W.read_warc(manifest)).where("response.record_type = 'response'").collect()
    assert sorted(r["response"]["payload"].decode() for r in whole) == sorted({p[2] or "" for p in PAGES})
    assert all(r["request"] is not None and r["metadata"] is not None for r in whole)


def test_files_are_plain_warc(spark):
    """Read with nothing but gzip: each record is a member, blocks end in two line ends."""
    manifest = W.write_warc(W.captures(pages(spark, PAGES[:2])), scratch_path(spark, "warc"))
    from pyarrow import fs

    for row in manifest.collect():
        system, path = fs.FileSystem.from_uri(row["uri"])
        raw = system.open_input_stream(path).read()
        text = gzip.decompress(raw)
        assert raw.count(b"\x1f\x8b\x08") >= row["records"] and text.startswith(b"WARC/1.1\r\n") and text.endswith(b"\r\n\r\n")


@pytest.mark.parametrize("packed", [True, False])
def test_parser(packed):
    row = {"page_id": 5, "capture": 9, "url": "u", "html": TRICKY, "digest": "D", "again": False, "first_page": None, "first_capture": None}
    members = W.capture_records(row)
    data = b"".join(members) if packed else b"".join(gzip.decompress(m) for m in members)
    found = list(W.parse_warc(io.BytesIO(data)))
    assert [f["warc-type"] for f, _ in found] == ["request", "response", "metadata"]
    assert found[1][1].endswith(TRICKY.encode()) and found[0][0]["warc-concurrent-to"] == found[1][0]["warc-record-id"]
    with pytest.raises(ValueError):
        list(W.parse_warc(io.BytesIO(gzip.decompress(members[1])[:-30])))


def test_assembly_of_partial_transactions(spark):
    body = {"refers_to": None, "target_uri": "u", "date": "d", "content_type": "t", "digest": None, "payload_bytes": None, "payload": None, "fields": {}}
    rows = [{"record_id": i, "record_type": t, "concurrent_to": c, **body} for i, t, c in [
        ("r1", "response", None), ("q1", "request", "r1"), ("q0", "request", "r1"), ("m9", "metadata", "gone"), ("r2", "revisit", None),
        (None, "response", None), ("q5", "request", None), ("i", "warcinfo", None)]]
    got = {r["capture"]: r for r in W.assemble(spark.createDataFrame(rows, W.RECORDS)).collect()}
    assert set(got) == {"r1", "r2", "gone"}
    assert got["r1"]["request"]["record_id"] == "q0" and got["r1"]["metadata"] is None
    assert got["gone"]["response"] is None and got["gone"]["metadata"]["record_id"] == "m9"
