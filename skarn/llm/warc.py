"""WARC archives: records written as text through Spark, read back by length, joined into captures.

Every capture has a response (or revisit), a request and a metadata record; the latter two name the
first by WARC-Concurrent-To. Reading parses whole archive files by Content-Length, joins the records
of a capture and yields one nested row for each. Each record ends in two line breaks, which is the
line separator that Spark's text writer puts after each row, so archives are written by executors
wherever Spark can write. An archive file holds one writer task's records, about FILE_BYTES of payload
at most (or one page). Reading inflates and parses a file as a stream, so beside the compressed file it
holds one record at a time; files of one gzip member and of a member for each record are read alike.
What is joined after reading carries digests and lengths, not payloads, unless the caller asks for them.

Defined results: a null payload is empty; repeated page rows are captures of their own; of equal
payloads the row with the largest page_id is the response (ties: the later row); null ids come first;
payloads of any length are kept whole; an empty table gives an empty archive and an empty result; extra
columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.llm.common import discard, materialise, shared_dir, ship

CRLF = "\r\n"
RECORD = "record_id string, concurrent_to string, refers_to string, kind string, uri string, digest string, headers map<string,string>, payload binary"
#: Payload bytes that an archive file holds, about, and its pages at most.
FILE_BYTES, FILE_PAGES = 128 << 20, 2000


def _urn(key: Column) -> Column:
    """A record id from the MD5 of a key."""
    h = F.md5(key)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", h.substr(1, 8), h.substr(9, 4), h.substr(13, 4), h.substr(17, 4), h.substr(21, 12)), F.lit(">"))


def _record(kind: str, record_id: Column, uri: Column, content_type: str, block: Column, more: list[Column]) -> Column:
    head = [F.lit("WARC/1.1"), F.lit(f"WARC-Type: {kind}"), F.concat(F.lit("WARC-Record-ID: "), record_id), F.concat(F.lit("WARC-Target-URI: "), uri), F.lit("WARC-Date: 2024-01-01T00:00:00Z")]
    length = F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))
    return F.concat(F.concat_ws(CRLF, *head, *more, F.lit(f"Content-Type: {content_type}"), length), F.lit(CRLF + CRLF), block)


def numbered(pages: DataFrame) -> DataFrame:
    """(row, page_id, url, html, digest, size) of the pages, written once so that row numbers hold."""
    html = F.coalesce("html", F.lit(""))
    base = pages.select("page_id", F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", "").alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("digest"), F.octet_length(html).cast("long").alias("size"))
    return materialise(base.select(F.monotonically_increasing_id().alias("row"), "*"), "pages", "zstd")


def plan(rows: DataFrame, least: int = 1000) -> DataFrame:
    """The rows of numbered() with original: the response's row for revisits, else null.

    A payload held by many rows is decided by a partial aggregation on its digest; Spark may split the
    join back.
    """
    slim = rows.select("row", "page_id", "digest", "size")
    last = slim.where(F.col("size") >= least).groupBy("digest").agg(F.max(F.struct("page_id", "row")).alias("o"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return rows.join(last.select("digest", "o"), "digest", "left").select("row", "page_id", "url", "html", "digest", "size", F.when(F.col("o.row") != F.col("row"), F.col("o.row")).alias("original"))


def write_archives(pages: DataFrame, path: str, least: int = 1000, gzip: bool = True) -> None:
    """Write one request, one response or revisit, and one metadata record for each page."""
    rows = numbered(pages)
    planned = plan(rows, least)
    usual = rows.agg((F.avg("size") + F.percentile_approx("size", 0.99)).alias("bytes")).first()["bytes"] or 1
    per_file = 3 * max(1, min(FILE_PAGES, int(FILE_BYTES // max(1, usual))))
    again = F.col("original").isNotNull()
    main, uri = _urn(F.concat(F.lit("response/"), F.col("row"))), F.col("url")
    http = F.concat(F.lit(CRLF.join(["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", "Content-Length: "])), F.col("size"), F.lit(CRLF + CRLF))
    digest = F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"))
    with_main = F.concat(F.lit("WARC-Concurrent-To: "), main)
    response = _record("response", main, uri, "application/http; msgtype=response", F.concat(http, "html"), [digest])
    refers = F.concat(F.lit("WARC-Refers-To: "), _urn(F.concat(F.lit("response/"), F.col("original"))))
    revisit = _record("revisit", main, uri, "application/http; msgtype=response", http, [digest, refers, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")])
    ask = F.concat(F.lit("GET "), uri, F.lit(f" HTTP/1.1{CRLF}Accept: text/html{CRLF}{CRLF}"))
    request = _record("request", _urn(F.concat(F.lit("request/"), F.col("row"))), uri, "application/http; msgtype=request", ask, [with_main])
    facts = F.concat(F.lit("page_id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(f"{CRLF}payload_bytes: "), F.col("size").cast("string"), F.lit(CRLF))
    metadata = _record("metadata", _urn(F.concat(F.lit("metadata/"), F.col("row"))), uri, "application/warc-fields", facts, [with_main])
    records = planned.select(F.explode(F.array(F.when(again, revisit).otherwise(response), request, metadata)).alias("value"))
    writer = records.write.option("lineSep", CRLF + CRLF).option("maxRecordsPerFile", per_file)
    (writer.option("compression", "gzip") if gzip else writer).text(path)
    discard(rows)


def inflated(raw: bytes, piece: int = 1 << 20) -> Iterator[bytes]:
    """The plain bytes of a file of any number of gzip members, or of a plain file, piece by piece."""
    view, at = memoryview(raw), 0
    while raw[at : at + 2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        while not member.eof:
            some = view[at : at + piece]
            if not some:
                raise ValueError("a gzip member is cut off")
            yield member.decompress(some)
            at += len(some) - len(member.unused_data)
    while at < len(raw):
        yield bytes(view[at : at + piece])
        at += piece


def parse(pieces: Iterable[bytes]) -> Iterator[dict]:
    """The records of an archive's plain bytes, given piece by piece. Names of header fields may be in any case."""
    some, at, held = iter(pieces), 0, bytearray()

    def more() -> bool:
        nonlocal at
        got = next(some, None)
        if got is None:
            return False
        if at > len(held) // 2:  # parsed bytes go once they are most of the buffer
            del held[:at]
            at = 0
        held.extend(got)
        return True

    while True:
        while held[at : at + 2] == b"\r\n":  # line ends after the last record
            at += 2
        seen = at
        while (stop := held.find(b"\r\n\r\n", seen)) < 0:
            ahead = max(at, len(held) - 3) - at
            if not more():
                if held[at:].strip(b"\r\n"):
                    raise ValueError("the last record's header is cut off")
                return
            while held[at : at + 2] == b"\r\n":
                at += 2
            seen = at + max(0, ahead - 4)
        lines = held[at:stop].decode("utf-8", "replace").split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record begins with {lines[0][:40]!r}")
        head = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        field = {k.lower(): v for k, v in head.items()}
        size, start = int(field["content-length"]), stop + 4 - at
        while len(held) - at < start + size:
            if not more():
                raise ValueError(f"the record {field.get('warc-record-id')} is cut off")
        block = bytes(held[at + start : at + start + size])
        at += start + size
        kind, digest = field["warc-type"], field.get("warc-payload-digest")
        yield {
            "record_id": field["warc-record-id"], "concurrent_to": field.get("warc-concurrent-to"), "refers_to": field.get("warc-refers-to"), "kind": kind, "uri": field.get("warc-target-uri"),
            "digest": digest and digest.partition(":")[2], "headers": head, "payload": block.partition(b"\r\n\r\n")[2] if kind in ("response", "revisit", "request") else block,
        }


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record of the archives (plain or gzip, one file at a time in a task)."""
    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(RECORD))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                some: list[dict] = []
                size = 0
                for record in parse(inflated(batch.column("content")[k].as_py())):
                    some.append(record | {"headers": list(record["headers"].items())})
                    size += len(record["payload"])
                    if len(some) == 512 or size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(some, schema=schema)
                        some, size = [], 0
                if some:
                    yield pa.RecordBatch.from_pylist(some, schema=schema)

    return files.mapInArrow(run, RECORD)


def captures(records: DataFrame) -> DataFrame:
    """One nested row for each capture: (record_id, uri, kind, digest, refers_to, payload_bytes, payload_sha1, response, request, metadata).

    Requests and metadata are joined to the record that they name; a capture without them has nulls,
    one with several keeps the one of the smallest record id. Records that name nothing known are left out.
    payload_bytes and payload_sha1 are taken before the join, so a caller that needs no more than these
    has no payload moved.
    """
    body = F.struct("record_id", "headers", "payload")
    main = records.where(F.col("kind").isin("response", "revisit")).select(
        "record_id", "uri", "kind", "digest", "refers_to", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_sha1"), body.alias("response")
    )
    sides = records.where(F.col("kind").isin("request", "metadata") & F.col("concurrent_to").isNotNull())
    by = sides.groupBy(F.col("concurrent_to").alias("record_id")).agg(*[F.min_by(F.when(F.col("kind") == k, body), F.when(F.col("kind") == k, F.col("record_id"))).alias(k) for k in ("request", "metadata")])
    return main.join(by, "record_id", "left")


def digests(found: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of the result of captures(), written once."""
    facts = found.select(
        "record_id", "kind", "refers_to", F.str_to_map(F.col("metadata.payload").cast("string"), F.lit(CRLF), F.lit(": ")).alias("m"),
        F.when(F.col("kind") == "response", F.col("payload_sha1")).otherwise(F.col("digest")).alias("digest"), F.col("payload_bytes").alias("n"),
    )
    flat = facts.select(
        "record_id", F.expr("try_cast(m['page_id'] AS bigint)").alias("page_id"), F.when(F.col("kind") == "response", F.col("n")).otherwise(F.expr("try_cast(m['payload_bytes'] AS bigint)")).alias("payload_bytes"),
        F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), F.col("refers_to").alias("target"),
    )
    flat = materialise(flat, "captures")
    wanted = flat.where("target IS NOT NULL").select("target").distinct()
    named = flat.select(F.col("record_id").alias("target"), F.col("page_id").alias("refers_to")).join(wanted, "target", "left_semi")
    once = flat.where("target IS NULL").select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"))
    again = flat.where("target IS NOT NULL").join(named, "target", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return once.unionByName(again)


def archive_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
