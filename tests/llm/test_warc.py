"""Archives read back whole, lookups against brute force."""

import base64
import hashlib

import pytest

from larder.llm import queries, warc

SCHEMA = "page_id bigint, url string, html string, extra string, digest string, n int"


def pages(spark):
    rows = [
        (1, "http://www.Example.org/a?x=1#top", "<p>one</p>"), (2, "https://example.org/a", "<p>one</p>"),
        (3, "http://www.example.org/a?x=1", "<p>three ü</p>"), (4, None, None), (5, "", ""), (6, "not a url", "x\r\n\r\ny"),
        (6, "not a url", "x\r\n\r\ny"), (None, "http://b.net/ü", "<p>one</p>"), (7, "http://10.0.0.1:8080/z", "long " * 300_000),
    ]
    rows += [(100 + i, f"http://h{i % 7}.net/p{i % 11}", f"page {i % 13}") for i in range(300)]
    return spark.createDataFrame([(*r, "e", "d", 1) for r in rows], SCHEMA)


def expected(rows):
    lead = {}
    for r in rows:
        lead[r.html or ""] = max(lead.get(r.html or "", -1), -1 if r.page_id is None else r.page_id)
    out = []
    for r in rows:
        data = (r.html or "").encode()
        out.append((r.page_id, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), lead[r.html or ""]))
    return out


def test_keys():
    assert warc.url_key("https://www.Example.org:443/a?x=1#top") == "org,example,www)/a?x=1"
    assert warc.url_key("http://10.0.0.1:8080/z") == "10.0.0.1:8080)/z"
    assert warc.url_key(None) == ")/"
    assert warc.url_key("http://[broken") == "http://[broken"


def test_round_trip_and_lookup(spark):
    made = pages(spark).repartition(4)
    rows = made.collect()
    archive = warc.build_index(warc.write(made, file_bytes=2000), block_rows=7)
    found = warc.read(archive).collect()
    want = expected(rows)
    assert sorted((r.page_id or 0, r.payload_bytes, r.payload_digest) for r in found) == sorted((a or 0, b, c) for a, b, c, _ in want)
    lead = {(a, c): d for a, _, c, d in want}
    for r in found:
        if r.record_type == "response":
            assert r.refers_to is None and r.page_id == lead[r.page_id, r.payload_digest] and r.payload is not None
        else:
            assert r.refers_to == lead[r.page_id, r.payload_digest] and r.payload is None
    assert sum(r.record_type == "response" for r in found) == len({r.html or "" for r in rows})
    asked = ["http://h3.net/p5", "http://www.example.org/a?x=1", "http://nowhere.net/", None]
    got = warc.lookup(archive, spark.createDataFrame([(a,) for a in asked], "url string")).collect()
    keys = {warc.url_key(a) for a in asked}
    assert sorted(r.page_id for r in got) == sorted(r.page_id for r in rows if warc.url_key(r.url) in keys)


def test_least_bytes(spark):
    found = warc.read(warc.build_index(warc.write(pages(spark).filter("page_id >= 100"), least_bytes=7)), payload=False).collect()
    assert all(r.record_type == "response" for r in found if r.payload_bytes < 7)
    assert any(r.record_type == "revisit" for r in found)


def test_damage():
    row = {"html": "abc", "url": "u", "n": 1, "page_id": 1, "name": "x", "bytes": 3, "refers_name": None, "refers_to": None, "digest": "00" * 20}
    with pytest.raises(ValueError):
        warc.parse(warc.record(row))


def test_empty(spark):
    archive = warc.build_index(warc.write(pages(spark).filter("false")))
    assert warc.read(archive).count() == 0
    assert warc.lookup(archive, spark.createDataFrame([("u",)], "url string")).count() == 0


def test_query(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    got = queries.op8_warc_index(spark, "/root/testdata/sf0.001").collect()
    assert sorted((r.page_id, r.payload_bytes, r.payload_digest) for r in got) == sorted(x[:3] for x in expected(rows))


def test_query_against_plain(spark, tmp_path):
    """All five columns of the query, every record found by the search of its key."""
    made = pages(spark).select("page_id", "url", "html").filter("page_id IS NOT NULL")
    rows = made.collect()
    made.write.parquet(str(tmp_path / "pages.parquet"))
    got = queries.op8_warc_index(spark, str(tmp_path)).collect()
    last = {}
    for r in rows:
        last[r.html or ""] = max(last.get(r.html or "", (-1, "")), (r.page_id, r.url or ""))
    want = []
    seen = set()
    for r in rows:
        text, lead = r.html or "", last[r.html or ""]
        first = (r.page_id, r.url or "") == lead and text not in seen
        seen |= {text} if first else set()
        digest = base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()
        want.append((r.page_id, len(text.encode()), digest, "response" if first else "revisit", -1 if first else lead[0]))
    assert sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, -1 if r.refers_to is None else r.refers_to) for r in got) == sorted(want)


def test_a_search_that_misses_a_capture_is_an_error(spark):
    made = pages(spark).repartition(3)
    archive = warc.build_index(warc.write(made), block_rows=5)
    assert warc.lookup(archive, made, every=True).count() == made.count()
    with pytest.raises(ValueError, match="captures"):
        warc.lookup(archive, made.filter("page_id < 150"), every=True)
