"""WARC archives: records written by Spark, read back, segments put together, chunked framing decoded.

A page becomes a `response` record whose HTTP body is chunked, or a `revisit` of the record with the same
payload. A record whose block is over the segment size is written as a first segment and `continuation`
records. The reader parses by Content-Length, groups continuations by their origin id, orders them by segment
number, checks the numbers and the total length, and decodes the chunked transfer framing.

Defined cases: a null page is an empty payload; a null url or id leaves its header out; a repeated row is
written as often as it comes (the rows with the least id of their payload are all responses); a record with a
missing segment or a wrong total is kept, marked incomplete, and has no payload. So is a record that states no
length, or one that its file does not hold. Files of any name are read, plain or gzipped, with one gzip member or
one a record, in version 1.0 or 1.1; ids carry a mark of their write, so that archives can be read together.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from levelgrid.llm import text as T
from levelgrid.session import settle, workspace

SEGMENT = 16 << 10
CHUNK = 4 << 10
# Payloads from this size on are written once.
LEAST_REVISIT = 100
# Records of one archive file: with SEGMENT this bounds its size.
FILE_RECORDS = 1000

# Fixed values of the format.
VERSION = b"WARC/1.1"
VERSIONS = re.compile(rb"WARC/1\.[01]\r?\n")
HEAD_END = re.compile(rb"\r?\n\r?\n")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"

_RECORD_SQL = (
    "record_id string, record_type string, page_id long, url string, payload_digest string, "
    "segment int, origin_id string, total_length long, refers_to long, block binary"
)
_RECORD = pa.schema(
    [
        ("record_id", pa.string()),
        ("record_type", pa.string()),
        ("page_id", pa.int64()),
        ("url", pa.string()),
        ("payload_digest", pa.string()),
        ("segment", pa.int32()),
        ("origin_id", pa.string()),
        ("total_length", pa.int64()),
        ("refers_to", pa.int64()),
        ("block", pa.binary()),
    ]
)


def chunked(body: bytes, size: int = CHUNK) -> bytes:
    """A body in chunked transfer framing."""
    out = [b"%x\r\n%b\r\n" % (len(body[i : i + size]), body[i : i + size]) for i in range(0, len(body), size)]
    return b"".join(out) + b"0\r\n\r\n"


def dechunked(framed: bytes) -> bytes | None:
    """The body of a chunked transfer framing; None if it is cut short or malformed."""
    out, at = [], 0
    while True:
        end = framed.find(b"\r\n", at)
        if end < 0:
            return None
        try:
            size = int(framed[at:end].split(b";")[0].strip() or b"-", 16)
        except ValueError:
            return None
        at = end + 2
        if size == 0:
            return b"".join(out)
        if size < 0 or framed[at + size : at + size + 2] != b"\r\n":
            return None
        out.append(framed[at : at + size])
        at += size + 2


def _record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    """A record without the two line ends that close it; the writer of the file adds those."""
    lines = [f"{k}: {v}" for k, v in headers if v is not None] + [f"Content-Length: {len(block)}"]
    return VERSION + b"\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def page_records(name: str, page_id, url, html: bytes, digest: str, first, segment: int = SEGMENT) -> list[bytes]:
    """The records of one page: a revisit where another page's record has the payload, else a response in segments."""
    ident = f"<urn:uuid:{uuid.UUID(hashlib.md5(name.encode()).hexdigest())}>"
    target = None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    common = [("WARC-Date", DATE), ("WARC-Target-URI", target), ("X-Page-Id", page_id), ("WARC-Payload-Digest", f"sha256:{digest}")]
    kind = "Content-Type: text/html; charset=utf-8"
    if first is not None and first != page_id:
        block = f"HTTP/1.1 200 OK\r\n{kind}\r\nContent-Length: {len(html)}\r\n\r\n".encode()
        return [_record([("WARC-Type", "revisit"), ("WARC-Record-ID", ident), ("WARC-Profile", REVISIT_PROFILE), ("X-Refers-To-Page-Id", first), *common], block)]
    block = f"HTTP/1.1 200 OK\r\n{kind}\r\nTransfer-Encoding: chunked\r\n\r\n".encode() + chunked(html)
    cuts = [block[i : i + segment] for i in range(0, len(block), segment)]
    numbered = len(cuts) > 1
    out = [_record([("WARC-Type", "response"), ("WARC-Record-ID", ident), *common, ("WARC-Segment-Number", 1 if numbered else None)], cuts[0])]
    for i, cut in enumerate(cuts[1:], 2):
        own = f"<urn:uuid:{uuid.UUID(hashlib.md5(f'{name}/{i}'.encode()).hexdigest())}>"
        total = len(block) if i == len(cuts) else None
        out.append(
            _record(
                [("WARC-Type", "continuation"), ("WARC-Record-ID", own), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", ident), ("WARC-Segment-Number", i), ("WARC-Segment-Total-Length", total)],
                cut,
            )
        )
    return out


def write_archives(pages: DataFrame, path: str, segment: int = SEGMENT) -> None:
    """Write page_id, url, html as gzipped WARC files into a folder of the shared store."""
    T.bound_batches(pages.sparkSession)
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("html"))
    base = base.withColumn("digest", F.sha2("html", 256))
    # Only payloads that come more than once; copies are joined to them with skewed keys left to the adaptive join.
    firsts = (
        base.filter(F.length("html") >= LEAST_REVISIT)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("times"))
        .filter("times > 1")
        .select("digest", "first")
    )
    rows = base.join(settle(firsts), "digest", "left").select("page_id", "url", "html", "digest", "first")
    write = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            out = []
            for page in zip(*[c.to_pylist() for c in batch.columns]):
                out += page_records(f"{write}/{part}/{n}", *page, segment)
                n += 1
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    records = rows.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
    records.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def unzipped(data: bytes) -> bytes:
    """The content of all gzip members of a file, or of a plain one. What is cut short gives what is there."""
    out = []
    while data[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(47)
        out.append(member.decompress(data))
        # Between members some writers leave padding.
        data = member.unused_data.lstrip(b"\0")
    return b"".join(out) if out else data


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """Headers (names in lower case) and block of every record of an archive file; no block where its length is not
    stated, or is more than the file holds."""
    found = VERSIONS.search(data)
    while found:
        gap = HEAD_END.search(data, found.end() - 2)
        if not gap:
            return
        lines = data[found.end() : gap.start()].decode("utf-8", "replace").splitlines()
        headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        length, start = headers.get("content-length", ""), gap.end()
        whole = re.fullmatch("[0-9]{1,18}", length) and start + int(length) <= len(data)
        yield headers, data[start : start + int(length)] if whole else None
        found = VERSIONS.search(data, start + int(length) if whole else start)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archive files below a folder, as they stand in the files."""
    T.bound_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda v: int(v) if v and re.fullmatch("-?[0-9]{1,18}", v) else None
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for h, block in parse(unzipped(content.as_py())):
                    digest = h.get("warc-payload-digest")
                    rows.append(
                        (
                            h.get("warc-record-id"),
                            h.get("warc-type"),
                            number(h.get("x-page-id")),
                            h.get("warc-target-uri"),
                            digest and digest.partition(":")[2],
                            number(h.get("warc-segment-number")),
                            h.get("warc-segment-origin-id"),
                            number(h.get("warc-segment-total-length")),
                            number(h.get("x-refers-to-page-id")),
                            block,
                        )
                    )
                for i in range(0, len(rows), T.BATCH_ROWS):
                    columns = zip(*rows[i : i + T.BATCH_ROWS])
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _RECORD.types)], schema=_RECORD)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("content").mapInArrow(run, _RECORD_SQL)


def reassemble(records: DataFrame) -> DataFrame:
    """Whole records: segments joined in order under their origin, with `complete` telling whether all are there."""
    whole = records.filter("segment is null").withColumn("complete", F.col("block").isNotNull())
    parts = records.filter("segment is not null").withColumn("origin", F.coalesce("origin_id", "record_id"))
    meta = ["record_id", "record_type", "page_id", "url", "payload_digest", "refers_to"]
    grouped = parts.groupBy("origin").agg(
        F.min(F.when(F.col("origin_id").isNull(), F.struct(*meta))).alias("head"),
        F.max("total_length").alias("total_length"),
        F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("segments"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks, complete = [], []
            for total, segments in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                joined = b"".join([s["block"] or b"" for s in segments])
                blocks.append(joined)
                complete.append([s["segment"] for s in segments] == list(range(1, len(segments) + 1)) and total == len(joined))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(blocks, pa.binary()), pa.array(complete, pa.bool_())], ["head", "total_length", "block", "complete"]
            )

    head = "head struct<record_id:string,record_type:string,page_id:bigint,url:string,payload_digest:string,refers_to:bigint>"
    joined = grouped.select("head", "total_length", "segments").mapInArrow(run, f"{head}, total_length long, block binary, complete boolean")
    names = [*meta, "total_length", "block", "complete"]
    return whole.select(names).unionByName(joined.select("head.*", "total_length", "block", "complete"))


def payload(block: bytes) -> bytes | None:
    """The HTTP body of a block, with chunked framing decoded."""
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        return None
    return dechunked(body) if re.search(rb"(?im)^transfer-encoding:\s*chunked\s*$", head.replace(b"\r\n", b"\n")) else body


def payloads(records: DataFrame) -> DataFrame:
    """record_type, page_id, url, stated digest, refers_to, payload, complete of whole records (payload null for revisits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, blocks, complete = batch.column(0).to_pylist(), batch.column(5), batch.column(6).to_pylist()
            bodies = [payload(b.as_py()) if k == "response" and c else None for k, b, c in zip(kinds, blocks, complete)]
            good = [c and (k != "response" or b is not None) for k, b, c in zip(kinds, bodies, complete)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(bodies, pa.binary()), pa.array(good, pa.bool_())],
                ["record_type", "page_id", "url", "payload_digest", "refers_to", "payload", "complete"],
            )

    columns = ["record_type", "page_id", "url", "payload_digest", "refers_to", "block", "complete"]
    return records.select(columns).mapInArrow(
        run, "record_type string, page_id long, url string, payload_digest string, refers_to long, payload binary, complete boolean"
    )


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the archives, read them back: page_id, payload_bytes, payload_digest, record_type, refers_to, complete."""
    spark = pages.sparkSession
    path = f"{workspace(spark)}/warc/{uuid.uuid4().hex}"
    write_archives(pages, path)
    found = payloads(reassemble(read_archives(spark, path)))
    # Measured from the payloads themselves, then written once: the payloads are not needed again.
    sized = settle(
        found.select(
            "record_type",
            "page_id",
            F.length("payload").cast("long").alias("payload_bytes"),
            F.when(F.col("record_type") == "revisit", F.col("payload_digest")).otherwise(F.sha2("payload", 256)).alias("payload_digest"),
            "refers_to",
            (F.col("complete") & ((F.col("record_type") != "response") | (F.sha2("payload", 256) == F.col("payload_digest")))).alias("complete"),
        )
    )
    responses = sized.filter("record_type = 'response'")
    revisits = sized.filter("record_type = 'revisit'")
    # A revisit has the size of the response it refers to; only what revisits ask for is kept.
    targets = responses.filter(F.col("payload_bytes") >= LEAST_REVISIT).groupBy("payload_digest").agg(F.max("payload_bytes").alias("payload_bytes"))
    targets = targets.join(revisits.select("payload_digest").distinct(), "payload_digest", "left_semi")
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "complete"]
    seen = revisits.drop("payload_bytes").join(settle(targets), "payload_digest", "left")
    return responses.select(names).unionByName(seen.select(names))
