"""WARC archives: writing captures, reading records, assembling transactions.

``write_captures`` writes each capture as three WARC/1.1 records (response or revisit,
request, metadata) with Spark's text writer, whose line separator is the blank line that
ends a record, gzipped. ``read_records`` parses the archives (any record order, several
gzip members) by their Content-Length. ``assemble`` joins request, response and metadata
records through WARC-Concurrent-To, given in either direction and also through the
request, and emits one nested row per capture.

Of captures with equal payloads of ``REVISIT_BYTES`` or more, the one with the smallest
``page_id`` (then URL) is a response, the others are revisits that refer to it. Groups of
equal payloads are found by an aggregate over digests; payloads are written by the task
that reads them, so one that a third of the pages share is spread like any other.

Defined results: null html is an empty payload; a null URL is empty; line breaks in a URL
are dropped in the archive; of rows equal in id, URL and html each is a capture: the
first as told above, the others revisits of it, or responses if the payload is smaller; a null
``page_id`` is kept (it sorts last among equal payloads); an empty table gives no records
and no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revisit.llm.shared import keep

REVISIT_BYTES = 100
FILE_BYTES = 32 << 20  # payload bytes aimed at in a file
COPIES = 10_000  # copies of a repeated row made by one task
DATE = "2025-01-01T00:00:00Z"  # the pages tell no time of capture
_END = "\r\n"


def _uuid(kind: str, key: Column) -> Column:
    """A record id that follows from the capture, so a task that runs again writes it again."""
    h = F.md5(F.concat(F.lit(f"{kind}|"), key))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-"), part(13, 4), F.lit("-"),
                    part(17, 4), F.lit("-"), part(21, 12), F.lit(">"))


def _record(fields: dict[str, Column], block: Column) -> Column:
    """Header and block; the writer's separator ends the record."""
    lines = [F.lit("WARC/1.1")] + [F.concat(F.lit(f"{k}: "), v) for k, v in fields.items()]
    size = F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))
    return F.concat(F.array_join(F.array(*lines, size), _END), F.lit(_END * 2), block)


def captures(pages: DataFrame) -> DataFrame:
    """``key, page_id, url, digest, bytes``, how often the row stands (``copies``) and, for
    revisits, the response's ``refers_key``."""
    rows = keep(_keyed(pages).groupBy("key", "page_id", "url", "digest", "bytes").agg(F.count(F.lit(1)).alias("copies")),
                "warc-captures")
    order = F.struct(F.col("page_id").isNull().alias("a"), F.col("page_id").alias("b"), F.col("url").alias("c"))
    first = (rows.filter(F.col("bytes") >= REVISIT_BYTES).groupBy("digest")
             .agg(F.min_by("key", order).alias("refers_key"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    again = rows.join(first, "digest").filter("key != refers_key").select("key", "refers_key")
    return keep(rows.join(again, "key", "left"), "warc-captures")


def _keyed(pages: DataFrame) -> DataFrame:
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"),
                        F.regexp_replace(F.coalesce("url", F.lit("")), "[\r\n]", "").alias("url"), html.alias("html"))
    rows = rows.withColumns({"digest": F.sha2("html", 256), "bytes": F.octet_length("html").cast("bigint")})
    return rows.withColumn("key", F.md5(F.concat_ws("|", F.coalesce(F.col("page_id").cast("string"), F.lit("null")), "digest", "url")))


def _copies(once: DataFrame, found: DataFrame) -> DataFrame:
    """The second and further copies of repeated rows, with keys of their own, numbered in
    blocks so that many copies of one row come from many tasks. Payloads that only their
    first copy is written with are left out."""
    n = found.filter("copies > 1").select("key", F.explode(F.expr(f"sequence(2, copies, {COPIES})")).alias("start"), "copies")
    rows = once.withColumn("html", F.when(F.col("bytes") < REVISIT_BYTES, F.col("html")).otherwise("")).join(n, "key")
    rows = rows.repartition("key", "start").withColumn("copy", F.explode(F.expr(f"sequence(start, least(copies, start + {COPIES - 1}))")))
    refers = F.when(F.col("bytes") >= REVISIT_BYTES, F.coalesce("refers_key", "key"))
    return rows.withColumn("refers_key", refers).withColumn("key", F.md5(F.concat_ws("|", "key", F.col("copy").cast("string")))).drop("start", "copies", "copy")


def write_captures(pages: DataFrame, folder: str) -> None:
    """Write the archives below ``folder``."""
    found = captures(pages)
    size = found.agg(F.sum(F.when(F.col("refers_key").isNull(), F.col("bytes")).otherwise(0)).alias("bytes"), F.sum("copies").alias("n"),
                     F.count(F.when(F.col("copies") > 1, 1)).alias("repeated")).first()
    per_file = max(1, int(FILE_BYTES / (1000 + (size["bytes"] or 0) / max(size["n"] or 0, 1))))
    # Payloads are written from where they are read: revisits and repeated rows are small
    # written tables, which Spark broadcasts below its threshold and else joins by shuffle.
    refers = keep(found.filter(F.col("refers_key").isNotNull()).select("key", "refers_key"), "warc-refers")
    rows = _keyed(pages)
    if size["repeated"]:
        repeated = keep(found.filter("copies > 1").select("key"), "warc-repeated")
        once = rows.join(repeated, "key", "left_semi").dropDuplicates(["key"])
        rows = rows.join(repeated, "key", "left_anti").unionByName(once).join(refers, "key", "left")
        rows = rows.unionByName(_copies(once.join(refers, "key", "left"), found))
    else:
        rows = rows.join(refers, "key", "left")
    me, revisit = _uuid("response", F.col("key")), F.col("refers_key").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_END}Content-Type: text/html; charset=utf-8{_END}Content-Length: "),
                    F.col("bytes").cast("string"), F.lit(_END * 2))
    common = {"WARC-Date": F.lit(DATE), "WARC-Target-URI": F.col("url")}
    digest = {"WARC-Payload-Digest": F.concat(F.lit("sha256:"), F.col("digest"))}
    kind = {"Content-Type": F.lit("application/http;msgtype=response")}
    response = _record({"WARC-Type": F.lit("response"), "WARC-Record-ID": me, **common, **digest, **kind},
                       F.concat(http, F.col("html")))
    again = _record({"WARC-Type": F.lit("revisit"), "WARC-Record-ID": me, **common, **digest,
                     "WARC-Profile": F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                     "WARC-Refers-To": _uuid("response", F.col("refers_key")), **kind}, http)
    path = F.regexp_extract("url", "^[A-Za-z]+://[^/?#]*([^#]*)", 1)
    request = _record({"WARC-Type": F.lit("request"), "WARC-Record-ID": _uuid("request", F.col("key")), **common,
                       "WARC-Concurrent-To": me, "Content-Type": F.lit("application/http;msgtype=request")},
                      F.concat(F.lit("GET "), F.when(path == "", "/").otherwise(path), F.lit(f" HTTP/1.1{_END}Host: "),
                               F.regexp_extract("url", "^[A-Za-z]+://([^/?#]*)", 1), F.lit(_END * 2)))
    # The metadata record names the request; the request names the response.
    metadata = _record({"WARC-Type": F.lit("metadata"), "WARC-Record-ID": _uuid("metadata", F.col("key")), **common,
                        "WARC-Concurrent-To": _uuid("request", F.col("key")), "Content-Type": F.lit("application/warc-fields")},
                       F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.lit(_END)))
    sep = F.lit(_END * 2)
    text = rows.select(F.concat(F.when(revisit, again).otherwise(response), sep, request, sep, metadata).alias("value"))
    text.write.option("maxRecordsPerFile", per_file).text(folder, compression="gzip", lineSep=_END * 2)


def inflate(raw: bytes) -> bytes:
    """All members of a gzip file; other bytes as they are."""
    if raw[:2] != b"\x1f\x8b":
        return raw
    out = []
    while raw[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        out.append(member.decompress(raw))
        raw = member.unused_data
    return b"".join(out)


def parse(data: bytes) -> Iterator[tuple[dict[str, list[str]], memoryview]]:
    """Header fields (names in lower case) and block of each record."""
    at, view = 0, memoryview(data)
    while (at := data.find(b"WARC/", at)) >= 0:
        end = data.index(b"\r\n\r\n", at)
        fields: dict[str, list[str]] = {}
        for line in data[at:end].split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            fields.setdefault(name.strip().lower().decode("ascii", "replace"), []).append(value.strip().decode("utf-8", "replace"))
        size = int(fields["content-length"][0])
        yield fields, view[end + 4:end + 4 + size]
        at = end + 4 + size


_SCHEMA = ("record_id string, type string, concurrent_to array<string>, target_uri string, date string, refers_to string, "
           "declared_digest string, content_type string, head string, payload_bytes long, payload_digest string, payload binary")
_KINDS = (pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(),
          pa.string(), pa.int64(), pa.string(), pa.binary())


def read_records(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """A row per record. ``head`` is the HTTP header (of HTTP messages) or the whole block
    (of metadata); ``payload`` what follows it (null unless wanted), with its size and
    SHA-256 taken from the bytes read."""

    def row(fields: dict, block: memoryview) -> tuple:
        one = lambda name: fields.get(name, [None])[0]
        kind = one("content-type") or ""
        raw = bytes(block)
        if kind.startswith("application/http"):
            head, _, payload = raw.partition(b"\r\n\r\n")
        elif kind == "application/warc-fields":
            head, payload = raw, b""
        else:
            head, payload = b"", raw
        return (one("warc-record-id"), one("warc-type"), fields.get("warc-concurrent-to", []), one("warc-target-uri"),
                one("warc-date"), one("warc-refers-to"), one("warc-payload-digest"), kind, head.decode("utf-8", "replace"),
                len(payload), hashlib.sha256(payload).hexdigest(), payload if payloads else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                rows, held = [], 0
                for fields, block in parse(inflate(raw.as_py())):
                    rows.append(row(fields, block))
                    held += len(block) if payloads else 0
                    if held > FILE_BYTES or len(rows) >= 10_000:
                        yield _batch(rows)
                        rows, held = [], 0
                yield _batch(rows)

    return (spark.read.format("binaryFile").load(folder).filter("length > 0").select("content")
            .mapInArrow(run, _SCHEMA))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(_KINDS), _KINDS)],
                                      [c.split()[0] for c in _SCHEMA.split(", ")])


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``capture_id, response, request, metadata`` (structs,
    null where there is none), ``n_requests`` and ``n_metadata`` (the struct holds the one
    with the smallest id). Revisits stand as ``response``. A request or metadata record
    that leads to no response is a capture without one."""
    records = keep(records, "warc-records")  # the archives are parsed once
    answer = F.col("type").isin("response", "revisit", "resource")
    ids = records.select("record_id", answer.alias("answer"))
    named = records.select(F.col("record_id").alias("x"), answer.alias("ax"), F.explode("concurrent_to").alias("y"))
    one_way = named.join(ids.select(F.col("record_id").alias("y"), F.col("answer").alias("ay")), "y")
    both = one_way.unionByName(one_way.select(F.col("y").alias("x"), F.col("ay").alias("ax"), F.col("x").alias("y"), F.col("ax").alias("ay")))
    side = both.filter(~F.col("ax")).distinct()
    near = side.filter("ay").select("x", F.col("y").alias("anchor"))
    far = side.filter(~F.col("ay")).select("x", "y").join(near.select(F.col("x").alias("y"), "anchor"), "y").select("x", "anchor")
    # A record's own response goes before one that it reaches through another record.
    anchors = (near.withColumn("step", F.lit(1)).unionByName(far.withColumn("step", F.lit(2)))
               .groupBy("x").agg(F.min(F.struct("step", "anchor"))["anchor"].alias("anchor")))
    placed = records.join(anchors, records["record_id"] == anchors["x"], "left").withColumn(
        "capture_id", F.coalesce("anchor", "record_id"))
    part = F.struct("record_id", "type", "target_uri", "date", "refers_to", "declared_digest", "head", "payload_bytes",
                    "payload_digest", "payload")
    return placed.groupBy("capture_id").agg(
        F.min_by(part, F.when(answer, F.col("record_id"))).alias("response"),
        F.min_by(part, F.when(F.col("type") == "request", F.col("record_id"))).alias("request"),
        F.min_by(part, F.when(F.col("type") == "metadata", F.col("record_id"))).alias("metadata"),
        F.count(F.when(F.col("type") == "request", 1)).alias("n_requests"),
        F.count(F.when(F.col("type") == "metadata", 1)).alias("n_metadata"))


def page_columns(nested: DataFrame) -> DataFrame:
    """Per page, what its archived capture tells. A revisit's size is that of the response
    it refers to; digests are those of the bytes read."""
    page = F.regexp_extract(F.col("metadata.head"), "page-id: (-?[0-9]+)", 1)
    rows = nested.select(
        F.when(page != "", page).cast("bigint").alias("page_id"), F.col("response.target_uri").alias("url"),
        F.col("response.record_id").alias("record_id"), F.col("response.type").alias("record_type"),
        F.col("response.refers_to").alias("to"), F.col("response.payload_bytes").alias("bytes"),
        F.col("response.payload_digest").alias("digest"))
    rows = keep(rows, "warc-pages")
    referred = rows.filter("record_type = 'response'").select(
        F.col("record_id").alias("to"), F.col("page_id").alias("refers_to"), F.col("bytes").alias("b"), F.col("digest").alias("d"))
    return rows.join(referred, "to", "left").select(
        "page_id", "url", F.when(F.col("to").isNull(), F.col("bytes")).otherwise(F.col("b")).alias("payload_bytes"),
        F.when(F.col("to").isNull(), F.col("digest")).otherwise(F.col("d")).alias("payload_digest"), "record_type", "refers_to")
