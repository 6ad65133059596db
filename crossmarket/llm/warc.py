"""WARC archives written from and read back into a chunked record table.

1. A payload becomes rows of record, chunk number and at most `chunk_bytes` bytes. Each chunk carries the bytes and
   digests of its record up to there, so the last one has those of the whole payload, and nothing after the
   input row ever holds a whole record.
2. Records with equal payloads are one group (length, SHA-1 and SHA-256). The one with the smallest id is the
   response. Groups of more than a thousandth of all records, at most a thousand, are broadcast; a join deals
   the others out, whose size is then no matter.
3. Tasks get a header row and then the chunks of each record, in order, and write gzip members into archives in the
   folder all executors share. A task returns the names of its archives, and only returned names count, so what a
   lost task leaves behind is never read.
4. Readers stream the archives and give chunk rows again, with digests counted anew.
"""

from __future__ import annotations

import gzip
import uuid
import zlib
from base64 import b32encode
from collections.abc import Iterator
from hashlib import sha1, sha256
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossmarket.llm.common import Scratch, id_type, reachable

HOT_SHARE = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SPACE_OF_IDS = uuid.uuid5(uuid.NAMESPACE_URL, "urn:x-record")


def chunk_table(pages: DataFrame, id_col: str = "page_id", url_col: str | None = "url", payload_col: str = "html",
                chunk_bytes: int = 8192) -> DataFrame:
    """Chunk rows of every payload: record (a number per row), chunk, last, page_id, url, data, and the bytes and
    SHA-1 and SHA-256 of the record so far. A missing or empty payload is one empty chunk."""
    reachable(pages.sparkSession)
    url = F.col(f"`{url_col}`").cast("string") if url_col in pages.columns else F.lit(None).cast("string")
    payload = F.coalesce(F.col(f"`{payload_col}`").cast("binary"), F.lit(b""))
    rows = pages.select(F.monotonically_increasing_id().alias("record"), F.col(f"`{id_col}`").alias("page_id"),
                        url.alias("url"), payload.alias("payload"))
    many = F.greatest(F.ceil(F.octet_length("payload") / chunk_bytes), F.lit(1)).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), many - 1),
                         lambda i: F.substring(F.col("payload"), i * chunk_bytes + 1, F.lit(chunk_bytes)))
    parts = rows.select("record", "page_id", "url", many.alias("many"), F.posexplode(pieces).alias("chunk", "data"))
    parts = parts.select("record", "chunk", (F.col("chunk") == F.col("many") - 1).alias("last"), "page_id", "url", "data")

    def digested(batches):
        size, one, two = 0, sha1(), sha256()  # the chunks of a record follow each other
        for batch in batches:
            out = [], [], []
            for number, data in zip(batch.column("chunk").to_pylist(), batch.column("data")):
                if number == 0:
                    size, one, two = 0, sha1(), sha256()
                data = data.as_buffer()
                size += len(data)
                one.update(data)
                two.update(data)
                for column, value in zip(out, (size, one.digest(), two.digest())):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())],
                [*batch.schema.names, "bytes_so_far", "sha1_so_far", "sha256_so_far"])

    return parts.mapInArrow(digested, f"record bigint, chunk int, last boolean, page_id {id_type(parts, 'page_id')}, url string, "
                                      "data binary, bytes_so_far bigint, sha1_so_far binary, sha256_so_far binary")


def roles(chunks: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Per record: payload_bytes, digest, and the record and id it revisits (missing for responses).

    Of equal payloads of at least `least_bytes` the smallest id is the response; a missing id comes last, and rows
    that share the smallest id are told apart by their record number. Smaller payloads are all responses.
    """
    key = F.concat("sha1_so_far", "sha256_so_far").alias("key")
    ends = chunks.where("last").select("record", "page_id", "url", F.col("bytes_so_far").alias("payload_bytes"),
                                       F.col("sha1_so_far").alias("digest"), key)
    first = F.min(F.struct(F.col("page_id").isNull().alias("missing"), "page_id", "record")).alias("first")
    groups = (ends.where(F.col("payload_bytes") >= least_bytes).groupBy("key", "payload_bytes")
              .agg(first, F.count(F.lit(1)).alias("many")).where("many > 1"))
    total = ends.count()
    is_hot = F.col("many") * HOT_SHARE > total
    hot = F.broadcast(groups.where(is_hot).select("key", "payload_bytes", "first"))  # fewer than HOT_SHARE rows
    rest = groups.where(~is_hot).select("key", "payload_bytes", "first")
    on = ["key", "payload_bytes"]
    placed = ends.join(hot, on).unionByName(ends.join(hot, on, "left_anti").join(rest, on, "left"))
    again = F.col("first").isNotNull() & (F.col("first.record") != F.col("record"))
    return placed.select("record", "page_id", "url", "payload_bytes", "digest",
                         F.when(again, F.col("first.record")).alias("first_record"),
                         F.when(again, F.col("first.page_id")).alias("first_page"))


def _uri(record: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE_OF_IDS, str(record))}>"


def _label(digest: bytes) -> str:
    return b32encode(digest).decode()


def _head(row: dict, date: str) -> tuple[bytes, bool]:
    """The lines before a record's payload, and whether the payload follows."""
    http = ("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {row['payload_bytes']}\r\n\r\n").encode()
    revisit = row["first_record"] is not None
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_uri(row['record'])}",
             f"WARC-Date: {date}", f"WARC-Target-URI: {quote(row['url'] or 'urn:x-none:', safe=':/?#[]@!$&()*+,;=%~')}",
             f"WARC-Payload-Digest: sha1:{_label(row['digest'])}"]
    if row["page_id"] is not None:
        lines.append(f"X-Page-ID: {quote(row['page_id'], safe='')}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_uri(row['first_record'])}"]
        if row["first_page"] is not None:
            lines.append(f"X-Refers-To-Page-ID: {quote(row['first_page'], safe='')}")
    length = len(http) + (0 if revisit else row["payload_bytes"])
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {length}", "", ""]
    return "\r\n".join(lines).encode() + http, not revisit


def write_archives(chunks: DataFrame, roles: DataFrame, folder: str, archive_bytes: int = 32 << 20, level: int = 3,
                   date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Writes one record per row of `roles` into archives under `folder`; one row per archive: path, records, bytes.

    The caller must write the result before using it: that commits the names. Archives hold about `archive_bytes` of
    payload; every record is a gzip member of its own, and a member is compressed chunk by chunk.
    """
    total = roles.agg(F.sum("payload_bytes")).first()[0] or 0
    parts = max(1, -(-total // archive_bytes))
    text = lambda c: F.col(c).cast("string").alias(c)
    heads = roles.select("record", F.lit(-1).alias("chunk"), F.lit(None).cast("binary").alias("data"), text("page_id"), "url",
                         "payload_bytes", "digest", "first_record", text("first_page"))
    rows = heads.unionByName(chunks.select("record", "chunk", "data"), allowMissingColumns=True)
    fields = ["record", "page_id", "url", "payload_bytes", "digest", "first_record", "first_page"]

    def write(batches) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        context = TaskContext.get()
        name = f"part-{context.partitionId():05d}-{context.taskAttemptId()}-{uuid.uuid4().hex}.warc.gz"
        out = packed = None
        records, wanted = 0, False

        def close():
            if packed:
                out.write(packed.compress(b"\r\n\r\n") + packed.flush())

        for batch in batches:
            for i, (number, data) in enumerate(zip(batch.column("chunk").to_pylist(), batch.column("data"))):
                if number < 0:
                    if out is None:
                        store.create_dir(base, recursive=True)
                        out = store.open_output_stream(f"{base}/{name}", compression=None)
                    close()
                    packed = zlib.compressobj(level, zlib.DEFLATED, 31)
                    head, wanted = _head({c: batch.column(c)[i].as_py() for c in fields}, date)
                    out.write(packed.compress(head))
                    records += 1
                elif wanted:
                    out.write(packed.compress(data.as_buffer()))
        if out is not None:
            close()
            size = out.tell()
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([records]), pa.array([size])],
                                             ["path", "records", "bytes"])

    return (rows.repartition(parts, "record").sortWithinPartitions("record", "chunk")
            .mapInArrow(write, "path string, records bigint, bytes bigint"))


def _fields(stream) -> tuple[dict[str, str], int]:
    """Header fields up to the empty line, and the bytes they took."""
    found, size = {}, 0
    while True:
        line = stream.readline()
        size += len(line)
        if not line.strip():
            return found, size
        name, _, value = line.decode().partition(":")
        found[name.strip().lower()] = value.strip()


def _records(stream, chunk_bytes: int) -> Iterator[tuple[dict, int, bytes, int, bytes, bool]]:
    """Chunks of an archive: headers of the record, chunk number, data, bytes and SHA-1 so far, last."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a record: {line[:40]!r}")
        head, _ = _fields(stream)
        left = int(head["content-length"])
        if head["warc-type"] in ("response", "revisit"):
            status = stream.readline()
            http, used = _fields(stream)
            head["http-length"] = int(http["content-length"])
            left -= len(status) + used
        number, size, digest = 0, 0, sha1()
        while True:
            data = stream.read(min(chunk_bytes, left))
            if left and not data:
                raise EOFError("an archive ends inside a record")
            left -= len(data)
            size += len(data)
            digest.update(data)
            yield head, number, data, size, digest.digest(), not left
            if not left:
                break
            number += 1


def read_archives(archives: DataFrame, chunk_bytes: int = 8192, with_data: bool = True) -> DataFrame:
    """Chunk rows of the records in the archives named by the column `path`.

    Columns: record_uri, record_type, target_uri, page_id and refers_to (as text), declared_digest, declared_bytes, chunk, last,
    bytes_so_far, digest_so_far (base32 SHA-1 of what was read), and data unless `with_data` is false. Every archive is one task's
    stream; a truncated or damaged archive is an error.
    """
    columns = ["record_uri", "record_type", "target_uri", "page_id", "refers_to", "declared_digest", "declared_bytes", "chunk",
               "last", "bytes_so_far", "digest_so_far"] + ["data"] * with_data
    kinds = [pa.string()] * 6 + [pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.string(), pa.binary()]

    def text(head: dict, name: str) -> str | None:
        return unquote(head[name]) if name in head else None

    def read(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, at = fs.FileSystem.from_uri(path)
                with store.open_input_stream(at, compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    rows, held = [], 0
                    for head, number, data, size, digest, last in _records(stream, chunk_bytes):
                        rows.append((head["warc-record-id"], head["warc-type"], head.get("warc-target-uri"),
                                     text(head, "x-page-id"), text(head, "x-refers-to-page-id"),
                                     head.get("warc-payload-digest", "").removeprefix("sha1:"), head.get("http-length"),
                                     number, last, size, _label(digest), data))
                        held += len(data) if with_data else 256
                        if held > 4 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                    if rows:
                        yield batch_of(rows)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows))[:len(columns)], kinds)], columns)

    names = archives.select("path")
    spread = names.repartition(max(1, min(names.count(), 10_000)), "path")
    schema = ("record_uri string, record_type string, target_uri string, page_id string, refers_to string, declared_digest string, "
              "declared_bytes bigint, chunk int, last boolean, bytes_so_far bigint, digest_so_far string")
    return spread.mapInArrow(read, schema + ", data binary" * with_data)


def archived_pages(pages: DataFrame, id_col: str = "page_id", url_col: str | None = "url", payload_col: str = "html",
                   least_bytes: int = 0, chunk_bytes: int = 8192, folder: str | None = None,
                   archive_bytes: int = 32 << 20) -> DataFrame:
    """Writes the pages as archives, reads these back, and returns one row per record read.

    page_id, payload_bytes, payload_digest (bare upper-case base32 SHA-1 of the full payload), record_type, refers_to
    (a revisit's response), and intact: a response has the bytes and the digest its header declares. Without `folder`
    the archives go to the shared folder. A missing payload is an empty one. Rows with a missing id are records too;
    repeated rows are records of their own, all but one of which revisit; an empty table gives an empty result. Other
    columns are not read.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    folder = folder or f"{scratch.base}/archives"
    chunks, kept = scratch.write(chunk_table(pages, id_col, url_col, payload_col, chunk_bytes))
    decided, lists = scratch.write(roles(chunks, least_bytes))
    archives = scratch.cut(write_archives(chunks, decided, folder, archive_bytes))
    for path in (kept, lists):
        scratch.drop(path)
    kind = pages.schema[id_col].dataType.simpleString()
    response = F.col("record_type") == "response"
    intact = ((F.col("bytes_so_far") == F.col("declared_bytes")) & (F.col("digest_so_far") == F.col("declared_digest")))
    return (read_archives(archives, chunk_bytes, with_data=False).where("last")
            .select(F.col("page_id").cast(kind).alias("page_id"),
                    F.when(response, F.col("bytes_so_far")).otherwise(F.col("declared_bytes")).alias("payload_bytes"),
                    F.when(response, F.col("digest_so_far")).otherwise(F.col("declared_digest")).alias("payload_digest"),
                    "record_type", F.col("refers_to").cast(kind).alias("refers_to"), (~response | intact).alias("intact")))


# Five hex digits of the digest are 20 bits, so four letters of base32.
ORACLE_SQL = """
    WITH payloads AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
    firsts AS (SELECT html, min(page_id) AS first_page FROM payloads GROUP BY html)
    SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
           list_aggregate(list_transform(range(32), lambda i: substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(
             (CAST('0x' || substring(sha1(html), 5 * (i // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INTEGER) + 1, 1)),
             'string_agg', '') AS payload_digest,
           CASE WHEN page_id = first_page THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> first_page THEN first_page END AS refers_to, true AS intact
    FROM payloads JOIN firsts USING (html)"""
