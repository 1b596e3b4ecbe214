"""WARC archives with an index: gzip members written by tasks, then read back by coalesced byte ranges."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from urllib.parse import quote, unquote

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, stored

INDEX = "path string, offset long, length long, page_id {0}, url string, record_type string, payload_digest string, payload_bytes long, refers_to {0}"
RECORD = "page_id {0}, url string, payload_bytes long, payload_digest string, record_type string, refers_to {0}"
#: Bytes of archives that a task reads, once there are more than tasks can share.
TASK_BYTES = 1 << 27
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: bytes) -> str:
    """Upper-case base32 SHA-1, as archives write it."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def urn(page_id) -> str:
    """Record id of a page; a null id has a name of its own."""
    return "<urn:x-no-page>" if page_id is None else f"<urn:x-page:{quote(str(page_id), safe='')}>"


def record_bytes(page_id, url: str | None, date: str, payload: bytes, refers_to, is_revisit: bool) -> bytes:
    """One record as a gzip member. A revisit holds the HTTP header of its response, and no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if is_revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: {urn(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe='''!#$&'()*+,/:;=?@[]~''')}")
    if is_revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {urn(refers_to)}"]
    head += [f"WARC-Payload-Digest: sha1:{payload_digest(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def parse_record(member: bytes) -> dict:
    """Headers and payload of one gzip member; raises if a stored digest or length does not hold."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(x.split(b": ", 1) for x in http.split(b"\r\n")[1:])[b"Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != size or payload_digest(payload) != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")

    def page(name: str) -> str | None:
        _, known, i = fields.get(name, "").strip("<>").partition("urn:x-page:")
        return unquote(i) if known else None

    url = fields.get("WARC-Target-URI")
    return {"page_id": page("WARC-Record-ID"), "url": url if url is None else unquote(url), "payload_bytes": size, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": page("WARC-Refers-To"), "payload": payload}


def file_system(uri: str):
    """File system and path of a URI: local and shared folders, and the object stores that pyarrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def with_record_types(pages: DataFrame, min_payload_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, refers_to): payload in bytes, refers_to the smallest id with that payload if that is another.

    Only payload hashes are grouped; counts and minima are combined before the exchange. Groups of one are dropped, and
    the others, written out, are joined back on the hash, where AQE splits a hot one.
    """
    rows = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload")).withColumn("__key", F.sha2("payload", 256))
    same = rows.where(F.octet_length("payload") >= min_payload_bytes).groupBy(F.col("__key").alias("__same")).agg(F.min("page_id").alias("__first"), F.count("*").alias("__n"))
    same = stored(same.where((F.col("__n") > 1) & F.col("__first").isNotNull()).drop("__n"), "warc-same")
    joined = rows.join(same, F.col("__key") == F.col("__same"), "left")
    return joined.select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("__first")), F.col("__first")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, min_payload_bytes: int = 0, archive_bytes: int = 1 << 28, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write a record per row of pages (page_id, url, html) under ``folder`` and return the stored index.

    Every task writes archives of its own, named by its attempt, so a lost executor's task starts new files and only
    files of finished tasks are in the index. Memory: one batch of rows and one record.

    Rows with equal payloads of ``min_payload_bytes`` or more: those with the smallest page_id are responses, others
    revisit it. Null html is empty. A null page_id is larger than any; rows that share the smallest id are all responses.
    """
    records = with_record_types(pages, min_payload_bytes)
    schema = INDEX.format(dict(pages.dtypes)["page_id"])

    def run(batches):
        import pyarrow as pa

        files, base = file_system(folder)
        files.create_dir(base, recursive=True)
        task = TaskContext.get()
        name = f"{task.partitionId():06d}-{task.taskAttemptId()}"
        out, path, seq, at = None, None, 0, 0
        for batch in batches:
            index = []
            for row in range(batch.num_rows):
                page_id, url, payload, refers_to = (batch.column(i)[row].as_py() for i in range(4))
                if out is None or at >= archive_bytes:
                    if out:
                        out.close()
                    path, seq, at = f"{name}-{seq}.warc.gz", seq + 1, 0
                    out = files.open_output_stream(f"{base}/{path}", compression=None)
                kind = "response" if refers_to is None else "revisit"
                member = record_bytes(page_id, url, date, payload, refers_to, kind == "revisit")
                out.write(member)
                index.append((path, at, len(member), page_id, url, kind, payload_digest(payload), len(payload), refers_to))
                at += len(member)
            if index:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*index, strict=True), (pa.string(), pa.int64(), pa.int64(), batch.schema.types[0], pa.string(), pa.string(), pa.string(), pa.int64(), batch.schema.types[0]), strict=True)], names=[x.split()[0] for x in schema.split(", ")])
        if out:
            out.close()

    return stored(records.mapInArrow(run, schema), "warc-index")


def read_records(index: DataFrame, folder: str, gap: int = 1 << 16, range_bytes: int = 1 << 23, with_payload: bool = False) -> DataFrame:
    """The records that ``index`` (all of a stored index, or selected rows) names, read by byte range and parsed.

    Rows are dealt by archive and block of ``range_bytes`` and sorted by offset; neighbours at most ``gap`` bytes apart
    are fetched in one read of up to ``range_bytes``. Responses are checked against their digest. Tasks are counted by the
    bytes that they read, not by the small index. An index without rows gives no records; a row that stands in it twice
    gives its record twice; null ids and urls come back as nulls.
    """
    kind = dict(index.dtypes)["page_id"]
    schema = RECORD.format("string") + (", payload binary" if with_payload else "")
    names = [x.split()[0] for x in schema.split(", ")]
    total = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = max(1, -(-total // TASK_BYTES), min(-(-total // (1 << 22)), 2 * index.sparkSession.sparkContext.defaultParallelism))
    dealt = index.select("path", "offset", "length").repartition(tasks, "path", F.expr(f"offset div {range_bytes}")).sortWithinPartitions("path", "offset")

    def run(batches):
        import pyarrow as pa

        types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
        files, base = file_system(folder)

        def fetched(path, spans):
            with files.open_input_file(f"{base}/{path}") as f:
                first, (last, size) = spans[0][0], spans[-1]
                data = f.read_at(last + size - first, first)
            rows = [[r[n] for n in names] for r in (parse_record(data[o - first : o - first + k]) for o, k in spans)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=False)], names=names)

        path, spans = None, []
        for batch in batches:
            for p, o, k in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                end = spans[-1][0] + spans[-1][1] if spans else 0
                if spans and (p != path or o - end > gap or o + k - spans[0][0] > range_bytes):
                    yield fetched(path, spans)
                    spans = []
                path = p
                spans.append((o, k))
        if spans:
            yield fetched(path, spans)

    out = dealt.mapInArrow(run, schema)
    return out.select(*[F.col(c).cast(kind).alias(c) if c in ("page_id", "refers_to") else c for c in out.columns])


def archive_folder(spark: SparkSession) -> str:
    """A new folder for archives in the shared folder."""
    return f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
