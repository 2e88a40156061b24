import gzip
import hashlib

from pyspark.sql import functions as F

from revisit.llm import catalog, warc
from revisit.llm.shared import new_folder

SCHEMA = "page_id long, url string, html string"


def brute(data):
    """Equal payloads of 100 bytes or more: the smallest id is the response."""
    order = lambda d: (d[0] is None, d[0] or 0, d[1] or "")
    first, out = {}, []
    for n, d in enumerate(sorted(data, key=order)):
        raw = (d[2] or "").encode()
        digest = hashlib.sha256(raw).hexdigest()
        place, lead = first.setdefault(digest, (n, d))
        again = len(raw) >= 100 and place != n
        out.append((d[0], (d[1] or "").replace("\n", ""), len(raw), digest, "revisit" if again else "response", lead[0] if again else None))
    return sorted(out, key=repr)


def result(spark, df):
    folder = new_folder(spark, "test-warc")
    warc.write_captures(df, folder)
    rows = warc.page_columns(warc.assemble(warc.read_records(spark, folder, payloads=False))).collect()
    return sorted(((r.page_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows), key=repr)


def test_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    twins = pages.limit(40).withColumn("page_id", F.col("page_id") - 10_000)
    both = pages.unionByName(twins)
    assert result(spark, both) == brute([tuple(r) for r in both.collect()])


def test_query(spark):
    d = "/root/testdata/sf0.001"
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in catalog.op5_warc(spark, d).collect()}
    want = brute([tuple(r) for r in spark.read.parquet(f"{d}/pages.parquet").collect()])
    assert got == {w[0]: w[2:] for w in want} and len(got) == len(want)


def test_odd_pages(spark, rows):
    data = [(1, None, None), (2, "http://a/\nb", "x\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\né"), (None, "u", "y" * 200), (3, "u", "y" * 200),
            (3, "v", "y" * 200), (3, "v", "y" * 200), (4, "w", "é" * 49), (5, "w", "é" * 49), (6, "w", "é" * 50), (7, "w", "é" * 50), (-8, "w", "é" * 50),
            (9, "long", "z" * 3_000_000), (10, "http://h?q=1#f", "")]
    df = rows(data, SCHEMA).withColumn("key", F.lit("k")).withColumn("digest", F.lit(1)).withColumn("bytes", F.lit(2))
    assert result(spark, df) == brute(data)
    assert result(spark, rows([], SCHEMA)) == []


def test_repeated_rows(spark, rows, monkeypatch):
    """Each row is a record, however often it stands."""
    monkeypatch.setattr(warc, "COPIES", 4)
    data = [(1, "u", "x" * 300)] * 13 + [(2, "u", "small")] * 6 + [(0, "v", "x" * 300), (5, "w", "once")] + [(None, None, None)] * 3
    assert result(spark, rows(data, SCHEMA)) == brute(data)


def record(kind, rid, block, *more):
    lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: {rid}", *more, f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_reads_other_archives(spark, tmp_path):
    """A record per gzip member, links in either direction and over the request, orphans."""
    http = "Content-Type: application/http;msgtype=response"
    parts = [record("warcinfo", "<i>", b"software: x\r\n", "Content-Type: application/warc-fields"),
             record("metadata", "<m>", b"a: 1\r\n", "WARC-Concurrent-To: <q>", "Content-Type: application/warc-fields"),
             record("request", "<q>", b"GET / HTTP/1.1\r\n\r\n", "Content-Type: application/http;msgtype=request"),
             record("response", "<r>", b"HTTP/1.1 200 OK\r\n\r\nbody \r\n\r\n \xff", "WARC-Concurrent-To: <q>", http),
             record("request", "<q2>", b"GET /2 HTTP/1.1\r\n\r\n", "WARC-Concurrent-To: <gone>", "Content-Type: application/http;msgtype=request"),
             record("response", "<r2>", b"HTTP/1.1 404 No\r\n\r\n", http)]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, parts[:4])))
    (tmp_path / "b.warc").write_bytes(b"".join(parts[4:]))
    records = warc.read_records(spark, str(tmp_path))
    nested = {r.capture_id: r for r in warc.assemble(records).collect()}
    assert set(nested) == {"<i>", "<r>", "<q2>", "<r2>"}
    r = nested["<r>"]
    assert bytes(r.response.payload) == b"body \r\n\r\n \xff" and r.request.record_id == "<q>" and r.metadata.head == "a: 1\r\n"
    assert (r.n_requests, r.n_metadata) == (1, 1)
    assert nested["<q2>"].response is None and nested["<r2>"].request is None and nested["<r2>"].response.payload_bytes == 0
