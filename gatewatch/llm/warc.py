"""WARC archives: writing captures, reading records back, and putting the records of each transaction together."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewatch.llm.staging import small, staged

END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
ARCHIVE_BYTES = 64 << 20  # of records, before compression
PIECE_BYTES = 1 << 20
# Fixed values of the format.
VERSION = "WARC/1.1"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORDS = ("record_id string, record_type string, concurrent_to string, refers_to string, target_uri string, payload_digest string, "
           "payload_bytes long, fields map<string,string>, payload binary")


def _urn(kind: str, *parts: Column) -> Column:
    """A record id that only depends on what it names."""
    h = F.md5(F.concat_ws("|", F.lit(kind), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), *[x for i, n in ((9, 4), (13, 4), (17, 4), (21, 12)) for x in (F.lit("-"), F.substring(h, i, n))], F.lit(">"))


def _record(kind: str, record_id: Column, block: Column, *headers: tuple[str, Column]) -> Column:
    """One record without its closing line ends. Headers with null values are left out."""
    lines = [F.lit(f"{VERSION}\r\nWARC-Type: {kind}\r\nWARC-Date: {DATE}\r\nWARC-Record-ID: "), record_id]
    for name, value in headers:
        lines.append(F.coalesce(F.concat(F.lit(f"\r\n{name}: "), value), F.lit("")))
    return F.concat(*lines, F.lit("\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(END), block)


def write_warc(pages: DataFrame, path: str, least_bytes: int = 100, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Writes a request, a response and a metadata record per page as gzip WARC files under ``path``.

    Of the pages whose payloads (the html in UTF-8; null: empty) are equal and at least ``least_bytes`` long, that with the
    smallest id keeps its payload; the others become revisit records that refer to it. Only ids, digests and sizes are
    grouped for that; payloads are shuffled once at most. Repeated rows share one transaction, whose metadata tell how many
    there were. An archive holds at most 64 MB of records and one more, before compression. Pages without an id, or several urls under the smallest id, are defined: null ids never are the smallest, and
    every row of the smallest id is a response. Line ends in a url are percent-encoded. Spark's committer makes the files.
    """
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    base = pages.select(F.col(id_col).alias("id"), F.regexp_replace(F.regexp_replace(F.col(url_col), "\r", "%0D"), "\n", "%0A").alias("url"), html.alias("payload"))
    base = base.withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256)).withColumn("bytes", F.octet_length("payload"))
    keys = staged(base.select("id", "url", "digest", "bytes").groupBy("id", "url", "digest", "bytes").agg(F.count("*").alias("copies")), "page-keys")
    twice = keys.where("copies > 1").select("id", "url", "digest", "copies")
    if twice.isEmpty():
        rows = base.withColumn("copies", F.lit(1).cast("long"))
    else:
        many = small(twice.withColumnsRenamed({c: f"_{c}" for c in ("id", "url", "digest")}))
        rows = base.join(many, F.col("id").eqNullSafe(F.col("_id")) & F.col("url").eqNullSafe(F.col("_url")) & (F.col("digest") == F.col("_digest")), "left")
        once = rows.where("copies is null").withColumn("copies", F.lit(1).cast("long"))
        rows = once.select(*base.columns, "copies").unionAll(rows.where("copies is not null").select(*base.columns, "copies").groupBy("id", "url", "digest", "bytes", "copies").agg(
            F.first("payload").alias("payload")).select(*base.columns, "copies"))
    first = keys.where((F.col("bytes") >= least_bytes) & F.col("id").isNotNull()).groupBy("digest").agg(F.min(F.struct("id", F.coalesce("url", F.lit("")).alias("url"))).alias("first"))
    shared = keys.where(F.col("bytes") >= least_bytes).groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest")
    rows = rows.join(small(first.join(shared, "digest")), "digest", "left")
    again = F.col("first").isNotNull() & ~F.coalesce(F.col("id") == F.col("first.id"), F.lit(False))
    key = lambda kind: _urn(kind, F.col("id"), F.coalesce(F.col("url"), F.lit("")), F.col("digest"))
    capture = key("capture")
    original = _urn("capture", F.col("first.id"), F.col("first.url"), F.col("digest"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    target, digest = ("WARC-Target-URI", F.col("url")), ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest")))
    kind = ("Content-Type", F.lit("application/http;msgtype=response"))
    response = _record("response", capture, F.concat(http, F.col("payload")), target, digest, kind)
    revisit = _record("revisit", capture, http, target, digest, ("WARC-Profile", F.lit(SAME_PAYLOAD)), ("WARC-Refers-To", original), kind)
    asked = F.concat(F.lit("GET "), F.coalesce(F.regexp_extract("url", r"^[a-z]+://[^/]*([^#]*)", 1), F.lit("")), F.lit(" HTTP/1.1\r\nHost: "), F.coalesce(F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1), F.lit("")), F.lit(END))
    to = ("WARC-Concurrent-To", capture)
    request = _record("request", key("request"), asked, target, to, ("Content-Type", F.lit("application/http;msgtype=request")))
    notes = F.concat(F.coalesce(F.concat(F.lit("id: "), F.col("id").cast("string"), F.lit("\r\n")), F.lit("")), F.lit("copies: "), F.col("copies").cast("string"), F.lit("\r\n"))
    metadata = _record("metadata", key("metadata"), notes, to, ("Content-Type", F.lit("application/warc-fields")))
    records = rows.select(F.explode(F.array(request, F.when(again, revisit).otherwise(response), metadata)).alias("value"))

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0
        for batch in batches:
            sizes = pc.binary_length(batch.column(0)).to_numpy(zero_copy_only=False).astype(np.int64)
            starts = done + np.cumsum(sizes) - sizes
            done += int(sizes.sum())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array((starts // ARCHIVE_BYTES).astype(np.int32))], names=["value", "archive"])

    records = records.mapInArrow(numbered, "value string, archive int")
    records.write.partitionBy("archive").option("lineSep", END).option("compression", "gzip").text(path)


def _pieces(data: bytes) -> Iterator[bytes]:
    """The bytes of an archive, gzip (of one or many members) or plain, a bounded number at once; up to a damaged place."""
    if data[:2] != b"\x1f\x8b":
        yield from (data[i : i + PIECE_BYTES] for i in range(0, len(data), PIECE_BYTES))
        return
    at, member = 0, zlib.decompressobj(31)
    while at < len(data):
        chunk = data[at : at + PIECE_BYTES]
        at += len(chunk)
        while True:
            try:
                piece = member.decompress(chunk, PIECE_BYTES)
            except zlib.error:
                return
            if piece:
                yield piece
            if member.eof:
                chunk, member = member.unused_data, zlib.decompressobj(31)
                if not chunk:
                    break
            else:
                chunk = member.unconsumed_tail
                if not chunk and len(piece) < PIECE_BYTES:
                    break


def _fields(block: bytes) -> dict[str, str]:
    lines = (line.partition(b":") for line in block.split(b"\r\n") if b":" in line)
    return {k.decode("utf-8", "replace").strip().lower(): v.decode("utf-8", "replace").strip() for k, _, v in lines}


def _blocks(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each whole record, told apart by their stated lengths, so that blocks may hold anything. A record that
    does not start as one or states no length is skipped up to the next that does; one that the archive's end cuts off is left out.
    """
    pieces, held, end = _pieces(data), bytearray(), END.encode()

    def fill(n: int) -> bool:
        while len(held) < n:
            piece = next(pieces, None)
            if piece is None:
                return False
            held.extend(piece)
        return True

    def find(what: bytes, start: int) -> int:
        while (at := held.find(what, start)) < 0:
            start = max(start, len(held) - len(what) + 1)
            if not fill(len(held) + 1):
                return -1
        return at

    while True:
        while fill(2) and held[:2] == b"\r\n":
            del held[:2]
        cut = find(end, 0)
        if cut < 0:
            return
        head = _fields(bytes(held[:cut]))
        stated = head.get("content-length", "")
        if held[:5] != b"WARC/" or not (stated.isascii() and stated.isdigit()):
            following = find(end + b"WARC/", cut)
            if following < 0:
                return
            del held[: following + 4]
            continue
        size = int(stated)
        if not fill(cut + 4 + size):
            return
        yield head, bytes(held[cut + 4 : cut + 4 + size])
        del held[: cut + 4 + size]


def parse_records(data: bytes, with_payload: bool) -> Iterator[tuple]:
    """The rows of one archive, one at a time."""
    for head, block in _blocks(data):
        kind, digest, size, fields, payload = head.get("warc-type"), head.get("warc-payload-digest"), None, {}, None
        if kind in ("response", "revisit"):
            http, _, body = block.partition(b"\r\n\r\n")
            fields = _fields(http.partition(b"\r\n")[2])
            if kind == "response":
                payload, size, digest = body, len(body), hashlib.sha256(body).hexdigest()
            else:
                size = int(fields["content-length"]) if fields.get("content-length", "").isdigit() else None
        elif kind == "metadata":
            fields = _fields(block)
        yield (head.get("warc-record-id"), kind, head.get("warc-concurrent-to"), head.get("warc-refers-to"), head.get("warc-target-uri"),
               digest.rpartition(":")[2].lower() if digest else None, size, list(fields.items()), payload if with_payload else None)


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record of the archives under ``path``, gzip or plain. Sizes and digests of responses come from the bytes
    themselves, those of revisits from their headers. An archive that ends inside a record, or whose compression breaks, gives the whole records
    before that; a record without a readable length is skipped. Plain archives end in ``.warc``. An archive is one value while its
    task reads it (at most 2 GB, compressed); it is inflated and parsed piece by piece.
    """
    types = [pa.string()] * 6 + [pa.int64(), pa.map_(pa.string(), pa.string()), pa.binary()]
    names = [x.split()[0] for x in RECORDS.replace("map<string,string>", "map").split(", ")]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names=names)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for row in parse_records(content.as_py(), with_payload):
                    rows.append(row)
                    size += len(row[-1] or b"") + 500
                    if size > PIECE_BYTES:
                        yield made(rows)
                        rows, size = [], 0
                if rows:
                    yield made(rows)

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.{gz,warc}").option("recursiveFileLookup", "true").load(path).select("content").mapInArrow(parse, RECORDS)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture (response or revisit): capture, request, metadata, and the metadata of what it refers to.

    Requests and metadata find their capture through WARC-Concurrent-To; of several, the one with the smallest record id
    counts. What is missing is null; records that belong to no capture are left out.
    """
    own = [c for c in records.columns if c not in ("concurrent_to",)]
    captures = records.where("record_type in ('response', 'revisit')").select("record_id", F.col("refers_to").alias("_refers"), F.struct(*own).alias("capture"))

    def side(kind: str) -> DataFrame:
        rows = records.where((F.col("record_type") == kind) & F.col("concurrent_to").isNotNull())
        return rows.groupBy(F.col("concurrent_to").alias("_to")).agg(F.min_by(F.struct("record_id", "target_uri", "fields"), "record_id").alias(kind))

    out = captures
    for kind in ("request", "metadata"):
        found = side(kind)
        out = out.join(found, out["record_id"] == found["_to"], "left").drop("_to")
    wanted = captures.select(F.col("_refers").alias("_to")).where("_to is not null").distinct()
    target = side("metadata").withColumnRenamed("metadata", "refers_to").join(wanted, "_to", "left_semi")
    return out.join(target, out["_refers"] == target["_to"], "left").select("capture", "request", "metadata", "refers_to")
