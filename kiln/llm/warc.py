"""WARC archives written from, and read into, a chunked record table.

A payload never has to lie in memory as a whole: it travels as rows
``record, chunk_no, data`` of at most ``chunk_bytes`` bytes, and each chunk row
carries the digests of the payload up to its own end, so a record's digest is
that of its last chunk and no stage holds more of a record than one chunk.
(The source column itself is one cell of the input; that is the only place
where a payload is whole.)

Writing: one pass turns the pages into the chunk table (Parquet in the shared
folder). Which records are responses and which revisits is decided on the
narrow last-chunk rows. Head rows (``chunk_no = -1``) and the chunks of the
responses are dealt out by record and sorted, and each task streams them into
one archive, checking length and digest as the bytes pass. Every record is a
gzip member of its own. Reading streams the archives back chunk by chunk.

Rows with a null or empty payload are records with an empty payload. Repeated
rows are records of their own. Of equal payloads the smallest id is the
response (a null id comes last; equal ids: the first one read).
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sizing import broadcast_if_small
from .common import delete_path, query, read, saved, shared_path
from .framed import open_fs

CHUNK_BYTES = 1 << 20
#: Bytes of chunk rows that a Python worker holds before it hands them on.
BATCH_BYTES = 8 << 20
#: Revisits broadcast to keep their chunks out of the shuffle (beyond it the writer skips them).
BROADCAST_ROWS = 1_000_000

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNKS = "record long, chunk_no int, last boolean, id string, url string, n_bytes long, sha1 binary, sha256 binary, data binary"
RECORDS = "record_id string, record_type string, refers string, id string, url string, payload_bytes long, payload_digest string"


class Batches:
    """Collects rows of one schema and gives them out in batches bounded by rows and bytes."""

    def __init__(self, schema: pa.Schema, payload: str | None = None):
        self.schema, self.rows, self.held = schema, [], 0
        self.payload = schema.get_field_index(payload) if payload else None

    def add(self, *row) -> bool:
        self.rows.append(row)
        self.held += 128 + (len(row[self.payload] or b"") if self.payload is not None else 0)
        return self.held >= BATCH_BYTES

    def take(self) -> pa.RecordBatch:
        columns = zip(*self.rows) if self.rows else [[] for _ in self.schema]
        out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self.schema)], schema=self.schema)
        self.rows, self.held = [], 0
        return out


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    return pa.schema([(n, kinds[t]) for n, t in (x.split() for x in ddl.split(", "))])


def chunk_table(pages: DataFrame, id_col: str, url_col: str, payload_col: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Pages as chunk rows (:data:`CHUNKS`); every record has at least one, and ``last`` marks its end.

    ``record`` numbers the rows; it is fixed once the table is written.
    """
    named = pages.select(
        F.monotonically_increasing_id().alias("record"),
        F.col(id_col).cast("string").alias("id"),
        F.col(url_col).alias("url"),
        F.col(payload_col).cast("binary").alias("data"),
    )

    def cut(batches):
        out = Batches(_schema(CHUNKS), "data")
        for b in batches:
            records, ids, urls, payloads = (b.column(i) for i in range(4))
            for i in range(b.num_rows):
                cell = payloads[i].as_buffer() if payloads[i].is_valid else pa.py_buffer(b"")
                one, two, n = hashlib.sha1(), hashlib.sha256(), cell.size
                for k in range(max(1, -(-n // chunk_bytes))):
                    part = cell.slice(k * chunk_bytes, min(chunk_bytes, n - k * chunk_bytes))
                    one.update(part)
                    two.update(part)
                    at = k * chunk_bytes + part.size
                    last = at == n
                    if out.add(
                        records[i].as_py(), k, last, ids[i].as_py() if last else None, urls[i].as_py() if last else None,
                        at, one.digest(), two.digest(), part.to_pybytes(),
                    ):
                        yield out.take()
        yield out.take()

    return named.mapInArrow(cut, CHUNKS)


def record_heads(chunks: DataFrame, min_bytes: int = 0) -> DataFrame:
    """One row per record, from its last chunk: ``record, id, url, n_bytes, sha1, first_record``.

    ``first_record`` is null for a response and names the response of a revisit.
    Payloads under ``min_bytes`` are never revisits.
    """
    heads = chunks.filter("last").select("record", "id", "url", "n_bytes", "sha1", "sha256")
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id").try_cast("decimal(38,0)").alias("n"), "id", "record")
    twins = (
        heads.filter(F.col("n_bytes") >= min_bytes)
        .groupBy(F.col("sha256").alias("_sha"), F.col("n_bytes").alias("_n"))
        .agg(F.count(F.lit(1)).alias("copies"), F.min(order)["record"].alias("first_record"))
        .filter("copies > 1")
        .drop("copies")
    )
    side, _ = broadcast_if_small(saved(twins), max_rows=BROADCAST_ROWS, max_bytes=128 << 20)
    same = (F.col("sha256") == F.col("_sha")) & (F.col("n_bytes") == F.col("_n"))
    first = F.when(F.col("first_record") != F.col("record"), F.col("first_record"))
    return heads.join(side, same, "left").select("record", "id", "url", "n_bytes", "sha1", first.alias("first_record"))


def _urn(record: int, sha1: bytes) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{record}/'.encode() + sha1).digest(), version=4)}>"


def b32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _safe(value: str) -> str:
    """A header value without blanks, controls or line ends (undone by ``unquote``)."""
    return quote(value, safe="!#$&'()*+,/:;=?@[]~-._|{}")


class RecordWriter:
    """Streams records into one archive: ``start`` with the facts, ``chunk`` for each piece, ``finish``."""

    def __init__(self, out, date: str):
        self.out, self.date, self.at = out, date, 0

    def _send(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def start(self, record: int, id_: str | None, url: str | None, n_bytes: int, sha1: bytes, first: int | None) -> None:
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
        lines = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: {_urn(record, sha1)}"]
        lines.append(f"WARC-Date: {self.date}")
        if url is not None:
            lines.append(f"WARC-Target-URI: {_safe(url)}")
        if id_ is not None:
            lines.append(f"X-Source-Id: {_safe(id_)}")
        if first is not None:
            lines += [f"WARC-Refers-To: {_urn(first, sha1)}", f"WARC-Profile: {PROFILE}"]
        lines += [f"WARC-Payload-Digest: sha1:{b32(sha1)}", "Content-Type: application/http; msgtype=response"]
        self.left = 0 if first is not None else n_bytes
        lines.append(f"Content-Length: {len(http) + self.left}")
        self.want, self.seen, self.skip = sha1, hashlib.sha1(), first is not None
        self.gz = zlib.compressobj(6, zlib.DEFLATED, 31)
        self._send(self.gz.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + http))

    def chunk(self, data) -> None:
        if not self.skip:
            self.left -= len(data)
            self.seen.update(data)
            self._send(self.gz.compress(data))

    def finish(self) -> None:
        if not self.skip and (self.left or self.seen.digest() != self.want):
            raise ValueError("a record's chunks are not its payload")
        self._send(self.gz.compress(b"\r\n\r\n") + self.gz.flush())


def write_archives(heads: DataFrame, chunks: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", files: int | None = None) -> DataFrame:
    """Heads and chunks streamed into gzip WARC files; returns the saved manifest ``record, file, offset, length``.

    A task writes under a name of its own attempt and the manifest names only
    whole files, so a task that runs again leaves nothing half written in use.
    """
    spark = heads.sparkSession
    n = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    top = heads.select(
        "record", F.lit(-1).alias("chunk_no"), "id", "url", "n_bytes", "sha1", "first_record", F.lit(None).cast("binary").alias("data")
    )
    revisits, _ = broadcast_if_small(heads.filter("first_record IS NOT NULL").select("record"), max_rows=BROADCAST_ROWS)
    body = chunks.select("record", "chunk_no", "data").join(revisits, "record", "left_anti")
    rows = top.unionByName(body, allowMissingColumns=True)
    base, root = open_fs(folder)
    base.create_dir(root, recursive=True)

    def run(batches):
        target, where = open_fs(folder)
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        out = Batches(_schema("record long, file string, offset long, length long"))
        writer = sink = open_record = None
        made = []
        for b in batches:
            records, numbers, data = b.column(0), b.column(1), b.column(7)
            for i in range(b.num_rows):
                if numbers[i].as_py() >= 0:
                    writer.chunk(data[i].as_buffer())
                    continue
                if writer is None:
                    sink = target.open_output_stream(f"{where}/{name}", compression=None)
                    writer = RecordWriter(sink, date)
                if open_record is not None:
                    writer.finish()
                    made.append((*open_record, writer.at - open_record[2]))
                open_record = (records[i].as_py(), name, writer.at)
                writer.start(open_record[0], *(b.column(c)[i].as_py() for c in range(2, 7)))
        if writer is not None:
            writer.finish()
            made.append((*open_record, writer.at - open_record[2]))
            sink.close()
            for row in made:
                if out.add(*row):
                    yield out.take()
        yield out.take()

    dealt = rows.repartition(n, "record").sortWithinPartitions("record", "chunk_no")
    return saved(dealt.mapInArrow(run, "record long, file string, offset long, length long"))


def write_warc(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
    min_bytes: int = 0, chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """All rows of ``pages`` as response and revisit records; returns the manifest of :func:`write_archives`."""
    spark = pages.sparkSession
    staged = shared_path(spark, "chunks")
    chunk_table(pages, id_col, url_col, payload_col, chunk_bytes).write.option("compression", "zstd").parquet(staged)
    chunks = spark.read.parquet(staged)
    manifest = write_archives(saved(record_heads(chunks, min_bytes)), chunks, folder)
    delete_path(spark, staged)
    return manifest


class _Unzipped:
    """Bytes of consecutive gzip members, read on demand."""

    def __init__(self, source, step: int = 1 << 18):
        self.source, self.step, self.gz, self.raw, self.held = source, step, zlib.decompressobj(31), b"", bytearray()

    def _fill(self) -> bool:
        """Unpack up to ``step`` more bytes; False at the end."""
        while True:
            if self.gz.eof:
                self.raw, self.gz = self.gz.unused_data, zlib.decompressobj(31)
            self.raw = self.gz.unconsumed_tail or self.raw or self.source.read(self.step)
            if not self.raw:
                return False
            got, self.raw = self.gz.decompress(self.raw, self.step), b""
            if got:
                self.held += got
                return True

    def until(self, mark: bytes, most: int = 1 << 20) -> bytes | None:
        """Everything up to and with ``mark``; None at the end."""
        while (at := self.held.find(mark)) < 0:
            if len(self.held) > most:
                raise ValueError("a record's head has no end")
            if not self._fill():
                if self.held:
                    raise ValueError("the archive ends within a record")
                return None
        out = bytes(self.held[: at + len(mark)])
        del self.held[: at + len(mark)]
        return out

    def pieces(self, n: int, most: int):
        """The next ``n`` bytes in pieces of at most ``most``."""
        while n:
            want = min(n, most)
            while len(self.held) < want:
                if not self._fill():
                    raise ValueError("the archive ends within a record")
            yield bytes(self.held[:want])
            del self.held[:want]
            n -= want


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")
    return {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:] if x)}


def iter_chunks(source, chunk_bytes: int = CHUNK_BYTES):
    """``(headers, chunk_no, last, bytes so far, SHA-1 so far, data)`` of every record of an opened ``.warc.gz``."""
    stream = _Unzipped(source)
    while (head := stream.until(b"\r\n\r\n")) is not None:
        fields = _fields(head)
        http = stream.until(b"\r\n\r\n")
        left = int(fields["content-length"]) - len(http)
        seen, so_far, k = hashlib.sha1(), 0, 0
        for data in stream.pieces(left, chunk_bytes) if left else [b""]:
            seen.update(data)
            so_far += len(data)
            yield fields, k, so_far == left, so_far, seen.digest(), data
            k += 1
        if b"".join(stream.pieces(4, 4)) != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")


def _each_file(spark: SparkSession, folder: str, manifest: DataFrame, ddl: str, make, payload: str | None = None) -> DataFrame:
    """``make(chunk)`` for all chunks of the manifest's files, which are dealt out over the tasks."""
    names = manifest.select("file").distinct()
    files = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def run(batches):
        source, where = open_fs(folder)
        out = Batches(_schema(ddl), payload)
        for b in batches:
            for name in b.column(0).to_pylist():
                with source.open_input_stream(f"{where}/{name}", compression=None) as f:
                    for chunk in iter_chunks(f):
                        if (row := make(*chunk)) and out.add(*row):
                            yield out.take()
        yield out.take()

    # By a hash of the name: a shuffle by the name itself is that of distinct(), which AQE joins into one task.
    return names.repartition(files, F.xxhash64("file")).mapInArrow(run, ddl)


def _of(fields: dict[str, str]) -> tuple:
    plain = lambda k: unquote(fields[k]) if k in fields else None
    return fields["warc-record-id"], fields["warc-type"], fields.get("warc-refers-to"), plain("x-source-id"), plain("warc-target-uri")


def read_chunks(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """The archives as a chunk table again: head columns, ``chunk_no, last, n_bytes, sha1, data``."""
    ddl = "record_id string, record_type string, refers string, id string, url string, chunk_no int, last boolean, n_bytes long, sha1 binary, data binary"
    return _each_file(spark, folder, manifest, ddl, lambda fields, *rest: (*_of(fields), *rest), "data")


def read_records(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """One row per record (:data:`RECORDS`); length and digest of a response come from the bytes that were read.

    A response whose bytes differ from its header's digest is an error. A
    revisit has no bytes: its digest is the header's and its length null.
    """

    def summary(fields, k, last, so_far, sha1, data):
        if not last:
            return None
        told = fields["warc-payload-digest"].removeprefix("sha1:")
        if fields["warc-type"] == "revisit":
            return (*_of(fields), None, told)
        if told != b32(sha1):
            raise ValueError("a payload differs from its digest")
        return (*_of(fields), so_far, told)

    return _each_file(spark, folder, manifest, RECORDS, summary)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """``records`` with ``payload_bytes`` of a revisit's response and ``refers_id``, the response's source id."""
    records = saved(records)
    named = records.filter("refers IS NOT NULL").select(F.col("refers").alias("_named")).distinct()
    first = saved(
        records.filter("record_type = 'response'")
        .join(broadcast_if_small(saved(named), max_rows=BROADCAST_ROWS)[0], F.col("record_id") == F.col("_named"), "left_semi")
        .select(F.col("record_id").alias("_of"), F.col("id").alias("refers_id"), F.col("payload_bytes").alias("_bytes"))
    )
    side, _ = broadcast_if_small(first, max_rows=BROADCAST_ROWS)
    whole = F.coalesce("payload_bytes", "_bytes").alias("payload_bytes")
    rest = [c for c in records.columns if c != "payload_bytes"]
    return records.join(side, F.col("refers") == F.col("_of"), "left").select(*rest, whole, "refers_id")


OP11_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS h,
        min(page_id) OVER (PARTITION BY html) AS first_id,
        row_number() OVER (PARTITION BY html ORDER BY page_id NULLS LAST) AS nth FROM p),
b AS (SELECT *, array_to_string(list_transform(range(40), lambda i:
        substr('0000000100100011010001010110011110001001101010111100110111101111',
               4 * (strpos('0123456789abcdef', substr(h, CAST(i AS INT) + 1, 1)) - 1) + 1, 4)), '') AS bits FROM d)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1
    + 16 * CAST(bits[5 * i + 1] AS INT) + 8 * CAST(bits[5 * i + 2] AS INT) + 4 * CAST(bits[5 * i + 3] AS INT)
    + 2 * CAST(bits[5 * i + 4] AS INT) + CAST(bits[5 * i + 5] AS INT), 1)), '') AS payload_digest,
  CASE WHEN nth = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN nth > 1 THEN first_id END AS refers_to
FROM b
"""


@query("op11_warc_records", OP11_SQL)
def op11(spark, sf_dir):
    """All ``pages`` as WARC archives in the shared folder, read back record by record."""
    pages = read(spark, sf_dir, "pages")
    folder = shared_path(spark, "warc")
    manifest = write_warc(pages, folder)
    back = resolve_revisits(read_records(spark, folder, manifest))
    return back.select(
        F.col("id").cast("long").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_id").cast("long").alias("refers_to"),
    )
