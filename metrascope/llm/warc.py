"""WARC archives: records written from pages, and read back with their segments put together.

Writing: equal payloads share one response record, that of the smallest page;
the others are revisit records that name it. A block over ``segment_bytes``
becomes a first record and continuation records. Payloads travel in chunked
transfer framing.

Reading: each archive is parsed by the lengths its records state. Unsegmented
records are decoded where they are read. Segments meet by the identifier of
their first record, ordered by number; their lengths have to add up to the
stated total. Then the transfer framing is taken off and the digest compared.

Files are written and read by Spark, as gzipped rows of text and as binary
files, gzipped or not, and none holds more than ``file_bytes`` and one record.
What does not add up is told
in ``problem``, with payload columns null; of an archive that breaks off or
holds something else, the records before that place are read, and a row with a
null page tells where. An empty folder gives no rows.

Payloads are equal if their SHA-256 and lengths are; the SHA-1 that records
print decides nothing.

Defined results: null payload counts as empty; a row with a null page id is a
response if no row with an id has its payload; rows that repeat a page id with
the same payload are all responses if that id is the smallest; a null url is
empty; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, join_groups, shuffle_partitions

#: Bytes of a block that a record holds at most; of a chunk; of an archive file before it is gzipped.
SEGMENT_BYTES, CHUNK_BYTES, FILE_BYTES = 16 << 10, 4 << 10, 16 << 20
#: WARC-Date of written records, so that archives are the same in every run.
DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(p := payload[i : i + size]), p) for i in range(0, len(payload), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload; ValueError where the framing is broken."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            break
        out.append(body[end + 2 : end + 2 + size])
        at = end + 2 + size
        if body[at : at + 2] != b"\r\n" or len(out[-1]) != size:
            raise ValueError("a chunk does not end where it should")
        at += 2
    if body[end + 2 : end + 4] != b"\r\n":
        raise ValueError("the last chunk is not closed")
    return b"".join(out)


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def page_records(record_id: str, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, segment_bytes: int = SEGMENT_BYTES) -> Iterator[bytes]:
    """The records of one page; a revisit if ``refers_to`` names a page."""
    from urllib.parse import quote

    uri = quote(url or "", safe="/:?#[]@!$&'()*+,;=%~-._")
    shared = [("WARC-Date", DATE), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", "sha1:" + base32_sha1(payload))]
    if page_id is not None:
        shared.append(("X-Page-Id", str(page_id)))
    kind = ("Content-Type", "application/http; msgtype=response")
    if refers_to is not None:
        head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
        yield _record([("WARC-Type", "revisit"), ("WARC-Record-ID", record_id), *shared, ("WARC-Profile", _PROFILE), ("X-Refers-To-Page-Id", str(refers_to)), kind], head)
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    for n, part in enumerate(parts, 1):
        own = record_id if n == 1 else f"{record_id[:-1]}-{n}>"
        fields = [("WARC-Type", "response" if n == 1 else "continuation"), ("WARC-Record-ID", own), *shared]
        if len(parts) > 1:
            fields.append(("WARC-Segment-Number", str(n)))
        if n > 1:
            fields.append(("WARC-Segment-Origin-ID", record_id))
            if n == len(parts):
                fields.append(("WARC-Segment-Total-Length", str(len(block))))
        yield _record([*fields, kind] if n == 1 else fields, part)


def parse_records(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields by lower-case name, block) of each record; ValueError where the archive is broken."""
    at = 0
    while at < len(archive):
        end = archive.index(b"\r\n\r\n", at)
        version, *lines = archive[at:end].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        size = int(fields["content-length"])
        if size < 0:
            raise ValueError(f"the record at byte {at} has a negative length")
        block = archive[end + 4 : end + 4 + size]
        at = end + 4 + size
        if len(block) != size or archive[at : at + 4] != b"\r\n\r\n":
            raise ValueError(f"the record before byte {at} does not end where it should")
        at += 4
        yield fields, block


def opened(content: bytes) -> tuple[bytes, str | None]:
    """The archive in a file, gzipped or not, as far as it can be had, and what is wrong with the compression."""
    if content[:2] != b"\x1f\x8b":
        return content, None
    out = []
    while content:
        member = zlib.decompressobj(31)
        try:
            out.append(member.decompress(content))
        except zlib.error as e:
            return b"".join(out), str(e)
        if not member.eof:
            return b"".join(out), "the compressed data break off"
        content = member.unused_data
    return b"".join(out), None


def _payload(block: bytes) -> bytes:
    head, _, body = block.partition(b"\r\n\r\n")
    return unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def _write(segment_bytes: int, file_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def cut() -> pa.RecordBatch:
            # The writer ends each row with a line feed: the last of the archive.
            return pa.record_batch([pa.array([b"".join(held)[:-1]], pa.binary())], ["archive"])

        for batch in batches:
            for page_id, url, payload, refers_to, row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                name = hashlib.md5(f"{row}/{page_id}".encode()).hexdigest()
                for record in page_records(f"<urn:uuid:{name}>", page_id, url, payload, refers_to, segment_bytes):
                    held.append(record)
                    size += len(record)
                    if size >= file_bytes:
                        yield cut()
                        held, size = [], 0
        if held:
            yield cut()

    return run


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES, file_bytes: int = FILE_BYTES) -> None:
    """Writes the pages' records as archives into the folder ``path``."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"), F.monotonically_increasing_id().alias("row"))
    rows = rows.withColumn("digest", F.concat_ws("/", F.sha2("payload", 256), F.octet_length("payload").cast("string")))
    groups = rows.select("page_id", "digest").groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first_page"))
    work = Workspace(pages.sparkSession, "payloads")
    groups = work.save(groups, "groups")
    # Only payloads of several rows have revisits, so only these groups need to meet the rows.
    rows = join_groups(rows, groups.where("n > 1"), "digest", "n", ["first_page"], F.col("row"))
    revisit = (F.octet_length("payload") >= min_revisit_bytes) & ~F.col("page_id").eqNullSafe(F.col("first_page"))
    rows = rows.select("page_id", "url", "payload", F.when(revisit, F.col("first_page")).alias("refers_to"), "row")
    archives = rows.mapInArrow(_write(segment_bytes, file_bytes), "archive binary")
    archives.select(F.col("archive").cast("string")).write.option("lineSep", "\n").option("maxRecordsPerFile", 1).option("compression", "gzip").text(path)
    work.drop("groups")


_READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, problem string"
_PARTS = "origin string, number int, total long, last boolean, fragment binary, " + _READ


def _schema(text: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in text.split(", "))])


def _told(fields: dict[str, str], block: bytes) -> tuple:
    """The columns of _READ."""
    number = lambda k: int(fields[k]) if k in fields else None
    kind, page_id, refers_to = fields["warc-type"], number("x-page-id"), number("x-refers-to-page-id")
    stated = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "revisit":
        length = [x for x in block.split(b"\r\n") if x.lower().startswith(b"content-length:")]
        return page_id, int(length[0].split(b":")[1]) if length else None, stated, kind, refers_to, None if length else "no length"
    try:
        payload = _payload(block)
    except ValueError as e:
        return page_id, None, None, kind, refers_to, str(e)
    digest = base32_sha1(payload)
    if stated and stated != digest:
        return page_id, None, None, kind, refers_to, "the digest differs"
    return page_id, len(payload), digest, kind, refers_to, None


def _part(fields: dict[str, str], block: bytes) -> tuple:
    """The columns of _PARTS of one record."""
    origin = fields.get("warc-segment-origin-id", fields["warc-record-id"])
    number, total = int(fields.get("warc-segment-number", 0)), fields.get("warc-segment-total-length")
    if not number:
        return origin, 0, None, False, None, *_told(fields, block)
    page = int(fields["x-page-id"]) if "x-page-id" in fields else None
    stated = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    return origin, number, int(total) if total else None, bool(total), block, page, None, stated, fields["warc-type"], None, None


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _PARTS from archives (path, content)."""
    schema = _schema(_PARTS)
    for batch in batches:
        for path, content in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            rows = []
            try:
                archive, broken = opened(content)
                for fields, block in parse_records(archive):
                    rows.append(_part(fields, block))
                if broken:
                    raise ValueError(broken)
            except (ValueError, KeyError) as e:
                rows.append((f"archive {path}", 0, None, False, None, None, None, None, None, None, f"after {len(rows)} records of {path}: {e}"))
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema) if rows else pa.RecordBatch.from_pylist([], schema)


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by origin and number; a page's segments are held until the next origin."""
    schema = _schema(_READ)
    held: list[tuple] = []

    def close() -> tuple:
        numbers, total = [r[1] for r in held], held[-1][2]
        page, stated, kind = held[0][5], held[0][7], held[0][8]
        if numbers != list(range(1, len(numbers) + 1)) or total is None:
            return page, None, None, kind, None, "segments are missing or repeated"
        block = b"".join(r[4] for r in held)
        if len(block) != total:
            return page, None, None, kind, None, f"{len(block)} bytes instead of {total}"
        fields = {"warc-type": kind, "warc-payload-digest": stated} | ({"x-page-id": str(page)} if page is not None else {})
        return _told(fields, block)

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    for batch in batches:
        rows = []
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if held and row[0] != held[0][0]:
                rows.append(close())
                held = []
            if row[1]:
                held.append(row)
            else:
                rows.append(row[5:])
        if rows:
            yield table(rows)
    if held:
        yield table([close()])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, problem of each page in the archives."""
    parts = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_parse, _PARTS)
    dealt = parts.repartition(shuffle_partitions(spark), "origin").sortWithinPartitions("origin", "number")
    return dealt.mapInArrow(_assemble, _READ)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{Workspace(spark, 'warc').path}/archives"
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_archives(spark, path)


OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS hex, min(page_id) OVER (PARTITION BY html) AS first_page FROM p),
g AS (SELECT *, list_transform(range(8), lambda i: CAST('0x' || substr(hex, CAST(5 * i + 1 AS BIGINT), 5) AS BIGINT)) AS vs FROM f)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(vs, lambda v: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v >> 15) & 31 AS BIGINT) + 1, 1)
           || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v >> 10) & 31 AS BIGINT) + 1, 1)
           || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v >> 5) & 31 AS BIGINT) + 1, 1)
           || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(v & 31 AS BIGINT) + 1, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = first_page THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_page THEN first_page END AS refers_to, CAST(NULL AS VARCHAR) AS problem
FROM g
"""
