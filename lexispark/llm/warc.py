"""WARC archives: write, deduplicate by payload digest, resolve revisits, read back.

Payload digests, the choice of original responses and the record headers are plain DataFrame expressions: headers (no
payloads) are shuffled by digest, the least page of a digest is its response, and a join gives the others their
refers-to fields. Records are written by Spark's text sink as gzip files (a record's last CRLF is the sink's line end),
so its committers deal with lost executors and any store will do. Archives are read as whole files of bounded size and
parsed by Content-Length, so payloads may hold anything.

Defined results: null payloads are empty; payloads under MIN_REVISIT bytes are always responses; pages without an id come
last among equals and cannot be referred to (they are responses if no other page has the payload); of several pages with
the same least id all are responses; line ends and other control characters in a URL are percent-encoded in headers, and
come back as they were; a null URL has no header.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import unquote_to_bytes

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm import common

MIN_REVISIT = 100
#: Bytes of payload of a file, on average, and how far a record may exceed the size that its files are planned for: a
#: reader holds one file at a time, so one of GROWTH * FILE_BYTES or of one record at most.
FILE_BYTES, GROWTH = 16 << 20, 8
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


def resolve(pages: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """pages (page_id, url, payload_digest, payload_bytes, ...) with record_type, refers_to and refers_url.

    Digests, ids and URLs alone are grouped, and groups combine on the map side; only digests of several pages come back.
    """
    large = F.col("payload_bytes") >= min_bytes
    groups = pages.where(large).groupBy(F.col("payload_digest").alias("_digest")).agg(F.min(F.struct(F.col("page_id").isNull().alias("last"), "page_id", "url")).alias("_first"), F.count("*").alias("_n"))
    originals = groups.where("_n > 1 and _first.page_id is not null").select("_digest", F.col("_first.page_id").alias("_original"), F.col("_first.url").alias("refers_url"))
    joined = pages.join(common.sized(common.table(originals, "originals")), large & (F.col("payload_digest") == F.col("_digest")), "left")
    revisit = F.col("_original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_original"))
    return joined.withColumn("record_type", F.when(revisit, "revisit").otherwise("response")).withColumn("refers_to", F.when(revisit, F.col("_original"))).drop("_digest", "_original")


def _safe(column):
    """A URL for a header line: control characters, blanks' like and % are percent-encoded."""
    out = F.replace(column, F.lit("%"), F.lit("%25"))
    for code in [*range(32), 127]:
        out = F.replace(out, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return out


def record_id(page_id):
    """A stable record id for a page (a digest of its own for pages without id)."""
    return F.concat(F.lit("<urn:lexispark:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def records(pages: DataFrame) -> DataFrame:
    """One column `value`: each row's record without its last CRLF. pages: page_id, url, payload, payload_digest, payload_bytes, record_type, refers_to."""
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    revisit = F.col("record_type") == "revisit"
    payload = F.when(revisit, F.lit("")).otherwise(F.coalesce("payload", F.lit("")))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"))
    length = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes").cast("int"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", record_id(F.col("page_id"))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", _safe(F.col("url"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        line("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        line("WARC-Refers-To", F.when(revisit, record_id(F.col("refers_to")))),
        line("WARC-Refers-To-Date", F.when(revisit, F.lit(DATE))),
        F.when(revisit, line("WARC-Refers-To-Target-URI", _safe(F.col("refers_url")))).otherwise(F.lit("")),
        line("X-Payload-Bytes", F.col("payload_bytes").cast("string")),
        F.lit("Content-Type: application/http;msgtype=response\r\n"),
        line("Content-Length", length.cast("string")),
        F.lit("\r\n"),
    )
    return pages.select(F.concat(head, http, payload, F.lit("\r\n")).alias("value"))


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = MIN_REVISIT) -> None:
    """Write one record per row of pages, payloads that occur before as revisits, to gzip files under path (a new folder).

    Large payloads go to files of their own, of fewer records, so one page that is far above the average fills no file.
    """
    source = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("payload"))
    source = source.withColumns({"payload_digest": F.sha2(F.col("payload").cast("binary"), 256), "payload_bytes": F.octet_length("payload").cast("long")})
    marked = resolve(source, min_bytes)
    average, most = source.agg(F.avg("payload_bytes"), F.max("payload_bytes")).first()
    low, planned = -1, int(average or 0) + 600  # some 600 bytes of headers
    while low < (most or 0):  # one job, and one for each eightfold size beyond the average that occurs
        own = marked.where((F.col("payload_bytes") > low) & (F.col("payload_bytes") <= GROWTH * planned))
        mode, low, per_file = "append" if low >= 0 else "errorifexists", GROWTH * planned, max(1, FILE_BYTES // planned)
        records(own).write.mode(mode).option("compression", "gzip").option("lineSep", "\r\n").option("maxRecordsPerFile", per_file).text(path)
        planned = low


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of the records of an archive."""
    at, view = 0, memoryview(data)
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].split(b"\r\n")
        if not lines[0].startswith(b"WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = {}
        for text in lines[1:]:
            name, _, value = text.partition(b": ")
            headers[name.decode().lower()] = value.decode()
        start = end + 4
        stop = start + int(headers["content-length"])
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} does not end where it says")
        yield headers, bytes(view[start:stop])
        at = stop + 4


def gunzip(data: bytes) -> bytes:
    """All members of a gzip file."""
    out = []
    while data:
        member = zlib.decompressobj(31)
        out.append(member.decompress(data))
        out.append(member.flush())
        data = member.unused_data
    return b"".join(out)


def page_of(record_id_: str | None) -> int | None:
    found = (record_id_ or "").removeprefix("<urn:lexispark:page:").removesuffix(">")
    return int(found) if found.lstrip("-").isdigit() else None


def read_archives(spark, path: str, with_payload: bool = True) -> DataFrame:
    """(page_id, url, record_type, refers_to, payload_digest, payload_bytes[, payload]) of all records under path. Digests and lengths of responses are taken from the payload itself and must agree with the header."""
    common.tune(spark)
    schema = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long" + (", payload binary" if with_payload else "")
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows: list[list] = [[] for _ in names]
                for headers, block in parse(gunzip(content.as_buffer().to_pybytes())):
                    kind, digest = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha256:")
                    size, payload = int(headers["x-payload-bytes"]), None
                    if kind == "response":
                        payload = block[block.index(b"\r\n\r\n") + 4 :]
                        size, own = len(payload), hashlib.sha256(payload).hexdigest()
                        if own != digest:
                            raise ValueError(f"payload digest of {headers['warc-record-id']} does not agree")
                    url = headers.get("warc-target-uri")
                    values = [page_of(headers["warc-record-id"]), None if url is None else unquote_to_bytes(url).decode() if "%" in url else url, kind, page_of(headers.get("warc-refers-to")), digest, size]
                    for column, value in zip(rows, [*values, payload] if with_payload else values, strict=True):
                        column.append(value)
                kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds, strict=False)], names=names)

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content").mapInArrow(run, schema)


def payloads(read: DataFrame) -> DataFrame:
    """Records with revisits given the payload of the response that they refer to."""
    responses = read.where("record_type = 'response' and page_id is not null").select(F.col("page_id").alias("_page"), F.col("payload").alias("_payload")).dropDuplicates(["_page"])
    return read.join(responses, read.refers_to == F.col("_page"), "left").withColumn("payload", F.coalesce("payload", "_payload")).drop("_page", "_payload")


def query(spark, sf_dir: str) -> DataFrame:
    """op2: write all pages, read the archives back, report each page's record."""
    path = common.new_path(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_archives(spark, path, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, sha256(coalesce(html, '')) AS payload_digest, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes FROM pages),
o AS (SELECT payload_digest, min(page_id) AS original FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN o.original <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN o.original <> p.page_id THEN o.original END AS refers_to
FROM p LEFT JOIN o ON p.payload_digest = o.payload_digest AND p.payload_bytes >= 100
"""
