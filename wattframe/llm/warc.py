"""WARC archives: write them, turn whole-file gzip streams into one member per record, read by offset.

Archives are files in a folder that every executor reaches. A task writes files under
names of its own attempt and reports them in its rows, so a task that is run again
leaves at most a file that nothing points to.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, functions as F

from ..session import materialise, scratch_path
from .common import map_batches

#: A new archive is begun once one holds this many bytes before compression.
ARCHIVE_BYTES = 16 << 20
LEVEL = 3
_READ = 1 << 20
_DATE = "2024-01-01T00:00:00Z"
_END = b"\r\n\r\n"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}')}>"


def headers(pairs: list[tuple[str, object]], first: str) -> bytes:
    return "\r\n".join([first, *(f"{k}: {v}" for k, v in pairs)]).encode() + _END


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, original: int | None) -> bytes:
    """One WARC record; with ``original`` a revisit of that page, which holds the response's headers only.

    A page without an id is named by its payload and has no ``X-Page-ID``.
    """
    http = headers([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", len(payload))], "HTTP/1.1 200 OK")
    block = http if original is not None else http + payload
    kind = "response" if original is None else "revisit"
    page = digest if page_id is None else page_id
    target = "".join(c for c in url or f"urn:page:{page}" if c not in "\r\n")
    pairs = [
        ("WARC-Type", kind), ("WARC-Record-ID", record_id(page)), ("WARC-Date", _DATE), ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
    ]
    if page_id is not None:
        pairs.append(("X-Page-ID", page_id))
    if original is not None:
        pairs += [
            ("WARC-Refers-To", record_id(original)), ("X-Refers-To-Page-ID", original),
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        ]
    pairs += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    return headers(pairs, "WARC/1.1") + block + _END


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    fs, path = pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)
    return fs, path


def parse_head(raw: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in raw.decode("utf-8", "replace").split("\r\n")[1:])}


def page_number(head: dict[str, str], name: str) -> int | None:
    return int(head[name]) if name in head else None


def records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records out of a stream of bytes; holds one record at most."""
    held = bytearray()
    for chunk in chunks:
        held += chunk
        while (end := held.find(_END)) >= 0:
            size = end + 4 + int(parse_head(bytes(held[:end]))["content-length"]) + 4
            if len(held) < size:
                break
            yield bytes(held[:size])
            del held[:size]
    if held:
        raise ValueError("the archive ends within a record")


def inflate(stream) -> Iterator[bytes]:
    """Bytes of a gzip file, one or many members, read once from front to back."""
    z = zlib.decompressobj(31)
    while raw := stream.read(_READ):
        while raw:
            yield z.decompress(raw)
            raw = z.unused_data
            if raw or z.eof:
                z = zlib.decompressobj(31)


def decide(pages: DataFrame, least: int = 0) -> DataFrame:
    """``page_id, url, payload, payload_digest, original``: of pages whose payloads of ``least``
    bytes or more are equal, the smallest ``page_id`` keeps it and the others point there.
    Pages without an id point there too; if no page of a payload has one, each keeps it."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    p = pages.select("page_id", "url", payload.alias("payload"), F.sha1(payload).alias("sha"))
    first = p.groupBy("sha").agg(F.min("page_id").alias("first"))  # a row per payload and task crosses the network
    p = p.join(first, "sha")
    again = (F.octet_length("payload") >= least) & ~F.col("page_id").eqNullSafe(F.col("first"))
    return p.select("page_id", "url", "payload", F.when(again, F.col("first")).alias("original"))


def write(decided: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write monolithic ``.warc.gz`` files: one gzip stream each. ``archive, records``, a row per file."""

    def run(batches):
        fs, root = _open(folder)
        fs.create_dir(root, recursive=True)
        out = None
        for batch in batches:
            for page_id, url, payload, original in zip(*(batch.column(k) for k in ("page_id", "url", "payload", "original")), strict=True):
                if out is None:
                    name, size, count = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out, z = fs.open_output_stream(f"{root}/{name}", compression=None), zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                body = payload.as_py()
                raw = record(page_id.as_py(), url.as_py(), body, base32_sha1(body), original.as_py())
                out.write(z.compress(raw))
                size, count = size + len(raw), count + 1
                if size >= archive_bytes:
                    out.write(z.flush())
                    out.close()
                    out = None
                    yield _rows(archive=[name], records=[count])
        if out is not None:
            out.write(z.flush())
            out.close()
            yield _rows(archive=[name], records=[count])

    return decided.mapInArrow(run, "archive STRING, records BIGINT")


def _rows(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v) for v in columns.values()], names=list(columns))


def normalise(archives: DataFrame, folder: str, to: str) -> DataFrame:
    """Inflate each archive once and write every record as a gzip member of its own.

    Gives the sidecar index: ``archive, record_no, offset, length, page_id, record_type``.
    """

    def run(batch):
        fs, root = _open(folder)
        to_fs, to_root = _open(to)
        to_fs.create_dir(to_root, recursive=True)
        for name in batch.column("archive").to_pylist():
            new, at = f"{uuid.uuid4().hex}.warc.gz", 0
            index: dict[str, list] = {k: [] for k in ("archive", "record_no", "offset", "length", "page_id", "record_type")}
            with fs.open_input_stream(f"{root}/{name}", compression=None) as stream, to_fs.open_output_stream(f"{to_root}/{new}", compression=None) as out:
                for no, raw in enumerate(records(inflate(stream))):
                    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                    member = z.compress(raw) + z.flush()
                    out.write(member)
                    head = parse_head(raw[: raw.index(_END)])
                    for k, v in zip(index, (new, no, at, len(member), page_number(head, "x-page-id"), head["warc-type"]), strict=True):
                        index[k].append(v)
                    at += len(member)
            yield index

    schema = "archive STRING, record_no BIGINT, offset BIGINT, length BIGINT, page_id BIGINT, record_type STRING"
    return map_batches(archives, run, schema)


def read(index: DataFrame, folder: str, tasks: int) -> DataFrame:
    """Records by their place: ``page_id, payload_bytes, payload_digest, record_type, refers_to, payload``.

    Bytes and digest are those of the full payload, for revisits as the record states them;
    for responses both are taken from the payload read back and compared with the record.
    The archives are dealt to ``tasks`` tasks: the index is small, what it points to is not.
    """

    def run(batch):
        fs, root = _open(folder)
        out: dict[str, list] = {k: [] for k in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload")}
        name, stream, held = None, None, 0
        for archive, offset, length in zip(*(batch.column(k).to_pylist() for k in ("archive", "offset", "length")), strict=True):
            if archive != name:
                if stream is not None:
                    stream.close()
                name, stream = archive, fs.open_input_file(f"{root}/{archive}")
            stream.seek(offset)
            raw = zlib.decompress(stream.read(length), 31)
            cut = raw.index(_END)
            head, block = parse_head(raw[:cut]), raw[cut + 4 : -4]
            http_end = block.index(_END)
            size = int(parse_head(block[:http_end])["content-length"])
            digest = head["warc-payload-digest"].removeprefix("sha1:")
            body = block[http_end + 4 :] if head["warc-type"] == "response" else None
            if body is not None and (len(body) != size or base32_sha1(body) != digest):
                raise ValueError(f"{archive} at {offset}: the payload is not the one the record states")
            row = (page_number(head, "x-page-id"), size, digest, head["warc-type"], page_number(head, "x-refers-to-page-id"), body)
            for k, v in zip(out, row, strict=True):
                out[k].append(v)
            held += len(raw)
            if held > 8 << 20:
                yield out
                out, held = {k: [] for k in out}, 0
        if stream is not None:
            stream.close()
        if out["page_id"]:
            yield out

    near = index.repartition(tasks, "archive").sortWithinPartitions("archive", "offset")
    schema = "page_id BIGINT, payload_bytes BIGINT, payload_digest STRING, record_type STRING, refers_to BIGINT, payload BINARY"
    return map_batches(near, run, schema)


def archive_pages(pages: DataFrame, folder: str | None = None, least: int = 0) -> DataFrame:
    """Write pages to monolithic archives, normalise these, and read the records back.

    * Null html is an empty payload; empty payloads are equal to one another.
    * A page without ``page_id`` has a record too. It cannot be referred to: it is a revisit of
      the page with an id that has its payload, or a response if there is none.
    * Rows that repeat a ``page_id`` with the same payload are equal responses, each
      a record of its own.
    * A null ``url`` is replaced by a name made of the id, or of the payload; other columns are not read.
    * Very long pages are records like any other; a task holds one record and 8 MB of rows at most.
    * An empty table writes nothing and gives no rows.
    """
    spark = pages.sparkSession
    folder = folder or scratch_path(spark, "warc")
    decided = decide(pages.withColumn("page_id", F.col("page_id").cast("bigint")), least)
    written = materialise(write(decided, f"{folder}/monolithic"), "warc-archives")
    # archives are few, and each is work of its own: one to a task
    tasks = max(1, min(4096, written.count()))
    dealt = written.repartition(tasks, "archive")
    index = f"{folder}/index"
    normalise(dealt, f"{folder}/monolithic", f"{folder}/records").write.parquet(index)
    return read(spark.read.parquet(index), f"{folder}/records", tasks)


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (
  SELECT page_id, octet_length(payload) AS payload_bytes, upper(sha1(payload)) AS hex, min(page_id) OVER (PARTITION BY payload) AS first FROM p),
b AS (
  SELECT *, list_transform(range(0, 32), lambda i:
    list_reduce(list_transform(range(0, 5), lambda j: (strpos('0123456789ABCDEF', hex[(i * 5 + j) // 4 + 1]) - 1) >> (3 - (i * 5 + j) % 4) & 1), lambda x, y: x * 2 + y)) AS digits FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(digits, lambda x: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(x AS INTEGER) + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to FROM b"""


def op4_warc(spark, sf_dir):
    return archive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("payload")
