"""WARC archives: write, index first, then coalesced byte-range reads.

``write_archives`` stores rows as WARC 1.1 records, each a gzip member of its own, one or more
archives per task. Rows with equal payloads (by SHA-1) share one response record, that of the
largest id; the others become revisit records, which carry no payload. ``build_index`` walks
archives and notes offset, length, URL and digest of each record. ``read_records`` sorts
selected index rows by archive and offset, joins neighbouring ranges that are at most ``GAP``
apart into reads of at most ``READ`` bytes, and parses the records from those.

Files go through Arrow's file systems, so a folder may be local and shared, HDFS, S3 or GCS. Archive
names are unique per attempt, and only those that a successful task reported are indexed, so a
lost executor leaves at worst an unused file.

Null html counts as empty. A null id or URL is left out of its record and read back as null. Rows
whose payload has no id at all are responses. Repeated rows of the largest id are all responses.
Further columns are ignored; an empty table gives no archive and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import materialize

ARCHIVE_BYTES = 128 << 20
GAP = 64 << 10
READ = 8 << 20
CHUNK = 1 << 20

INDEX = "archive string, offset long, length long, id long, url string, digest string, record_type string, refers_to long, payload_bytes long"
RECORD = INDEX + ", payload binary"


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, id_: int | None, url: str | None, digest: str, refers_to: int | None, payload: bytes) -> bytes:
    """One WARC 1.1 record, gzipped. The date is fixed: equal rows give equal archives."""
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{id_}:{url}:{digest}")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{name}>", "WARC-Date: 2000-01-01T00:00:00Z",
        *([f"WARC-Target-URI: {' '.join(url.split())}"] if url is not None else []), *([f"X-Row-ID: {id_}"] if id_ is not None else []),
        f"WARC-Payload-Digest: sha1:{digest}",
        *([f"X-Refers-To-Row-ID: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if kind == "revisit" else []),
        "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}",
    ]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n") + packer.flush()


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers by lower-case name, and the block, of an uncompressed record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = int(fields.get("content-length", 0))
    if len(rest) < size:
        raise ValueError("record cut short")
    return fields, rest[:size]


def _facts(fields: dict[str, str], block: bytes) -> tuple:
    number = lambda k: int(fields[k]) if fields.get(k) else None
    digest = fields.get("warc-payload-digest", "").rpartition(":")[2] or payload_digest(block)
    kind = fields.get("warc-type")
    return number("x-row-id"), fields.get("warc-target-uri"), digest, kind, number("x-refers-to-row-id"), None if kind == "revisit" else len(block)


def write_archives(pages: DataFrame, folder: str, where: str, id_: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0) -> DataFrame:
    """Write a record per row below ``folder``; returns (archive, bytes, records), already written.

    Payloads under ``min_bytes`` are never shared.
    """
    rows = pages.select(F.col(id_).alias("id"), F.col(url).alias("url"), F.coalesce(F.col(payload), F.lit("")).alias("payload"))
    rows = rows.withColumn("sha", F.unhex(F.sha1(F.encode("payload", "utf-8"))))
    shared = rows.where(F.octet_length("payload") >= min_bytes).groupBy("sha").agg(F.max("id").alias("first"), F.count(F.lit(1)).alias("n"))
    # only digests of several rows, as a written table: a hot digest is then split by adaptive execution
    shared = materialize(shared.where("n > 1 and first is not null").select("sha", "first"), f"{where}/shared")
    rows = rows.join(shared, "sha", "left")
    rows = rows.withColumn("revisit", F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")) & (F.octet_length("payload") >= min_bytes))
    rows = rows.select("id", "url", "sha", F.when(F.col("revisit"), F.col("first")).alias("first"), F.when(~F.col("revisit"), F.col("payload")).alias("payload"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path, at, records = None, "", 0, 0

        def closed() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([at], pa.int64()), pa.array([records], pa.int64())], names=["archive", "bytes", "records"])

        for batch in batches:
            ids, urls, shas, firsts, payloads = batch.columns
            for k in range(batch.num_rows):
                if out is None:
                    path, at, records = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    files, inner = _open(path)
                    files.create_dir(inner.rpartition("/")[0], recursive=True)
                    out = files.open_output_stream(inner, compression=None)
                first = firsts[k].as_py()
                raw = record("response" if first is None else "revisit", ids[k].as_py(), urls[k].as_py(), base64.b32encode(shas[k].as_py()).decode(), first, (payloads[k].as_py() or "").encode())
                out.write(raw)
                at, records = at + len(raw), records + 1
                if at >= ARCHIVE_BYTES:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    return materialize(rows.mapInArrow(run, "archive string, bytes long, records long"), f"{where}/archives")


def members(path: str) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of each gzip member of an archive, or each record of a plain one."""
    files, inner = _open(path)
    with files.open_input_stream(inner, compression=None) as stream:
        head = stream.read(CHUNK)
        if head[:2] != b"\x1f\x8b":
            yield from _plain(head, stream)
            return
        offset, data, length, parts, unpacker = 0, head, 0, [], zlib.decompressobj(31)
        while True:
            if not data:
                data = stream.read(CHUNK)
                if not data:
                    break
            parts.append(unpacker.decompress(data))
            length += len(data) - len(unpacker.unused_data)
            data = unpacker.unused_data
            if unpacker.eof:
                yield offset, length, b"".join(parts)
                offset, length, parts, unpacker = offset + length, 0, [], zlib.decompressobj(31)
        if length:
            raise ValueError(f"{path} ends within a record")


def _plain(data: bytes, stream) -> Iterator[tuple[int, int, bytes]]:
    offset = 0
    while data or (data := stream.read(CHUNK)):
        while (end := data.find(b"\r\n\r\n")) < 0:
            more = stream.read(CHUNK)
            if not more:
                raise ValueError("archive ends within a header")
            data += more
        size = next((int(x.partition(b":")[2]) for x in data[:end].split(b"\r\n") if x.lower().startswith(b"content-length:")), 0)
        total = end + 4 + size + 4
        while len(data) < total:
            more = stream.read(max(CHUNK, total - len(data)))
            if not more:
                raise ValueError("archive ends within a record")
            data += more
        yield offset, total, data[:total]
        offset, data = offset + total, data[total:]


def build_index(archives: DataFrame) -> DataFrame:
    """A row per record, see ``INDEX``, of the paths in column ``archive``; read as streams, a record at a time."""
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(INDEX)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                for offset, length, content in members(path):
                    rows.append((path, offset, length, *_facts(*parse(content))))
                    if len(rows) >= 4096:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)

    # a number of partitions of its own: paths are short, and Spark would join small partitions of them into one task
    n = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return archives.select("archive").repartition(n, "archive").mapInArrow(run, schema)


KINDS = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
NAMES = [x.split()[0] for x in RECORD.split(", ")]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (*KINDS, pa.binary())[: len(rows[0])]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=NAMES[: len(kinds)])


def coalesced(ranges: list[tuple[int, int]], gap: int = GAP, most: int = READ) -> list[tuple[int, int, int]]:
    """(first range, end range, end byte) of each read for sorted (offset, length) ranges."""
    reads: list[tuple[int, int, int]] = []
    for k, (offset, length) in enumerate(ranges):
        if reads:
            first, _, end = reads[-1]
            if offset - end <= gap and offset + length - ranges[first][0] <= most:
                reads[-1] = (first, k + 1, max(end, offset + length))
                continue
        reads.append((k, k + 1, offset + length))
    return reads


def read_records(selected: DataFrame, partitions: int | None = None) -> DataFrame:
    """The records of index rows, see ``RECORD``; digests of responses are checked."""
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(RECORD)
    keys = ("archive", "offset")
    n = partitions or int(selected.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = selected.select("archive", "offset", "length").repartitionByRange(n, *keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, opened = None, None
        for batch in batches:
            archives, offsets, lengths = (c.to_pylist() for c in batch.columns)
            k = 0
            while k < len(archives):
                n = next((j for j in range(k, len(archives)) if archives[j] != archives[k]), len(archives))
                if archives[k] != source:
                    files, inner = _open(archives[k])
                    opened, source = files.open_input_file(inner), archives[k]
                ranges = list(zip(offsets[k:n], lengths[k:n], strict=True))
                for first, last, end in coalesced(ranges):
                    start = ranges[first][0]
                    data, rows = opened.read_at(end - start, start), []
                    for offset, length in ranges[first:last]:
                        raw = data[offset - start : offset - start + length]
                        fields, block = parse(zlib.decompress(raw, 31) if raw[:2] == b"\x1f\x8b" else raw)
                        facts = _facts(fields, block)
                        if facts[3] != "revisit" and payload_digest(block) != facts[2]:
                            raise ValueError(f"{source} at {offset}: the payload does not match its digest")
                        rows.append((source, offset, length, *facts, block))
                    yield _batch(rows)
                k = n

    return dealt.mapInArrow(run, schema)


def resolve(records: DataFrame) -> DataFrame:
    """Revisit records with the ``payload_bytes`` of the response of equal digest; both sides should be written tables."""
    full = records.where("record_type = 'response'").groupBy("digest").agg(F.max("payload_bytes").alias("_bytes"))
    out = records.where("record_type = 'response'")
    again = records.where("record_type <> 'response'").drop("payload_bytes").join(full, "digest", "left").withColumnRenamed("_bytes", "payload_bytes")
    return out.unionByName(again)


def archive_listing(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.createDataFrame([(p,) for p in paths], "archive string")
