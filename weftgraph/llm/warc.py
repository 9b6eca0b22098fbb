"""WARC archives compressed with Zstandard: writing, and the reader that checks what it reads.

An archive is a skippable frame (magic 0x184D2A5D) with the dictionary, then one Zstandard frame per record. Archives
are written by tasks under names of their own attempt into the shared folder; the table of written archives is
committed by Spark, so archives of failed attempts are never read. Writer and reader hold one record (plus the
bounded dictionary sample) at a time.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm._shared import cut, new_path, table

DICTIONARY_MAGIC, ZSTD_MAGIC = 0x184D2A5D, b"\x28\xb5\x2f\xfd"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, archive string, payload binary"
ARCHIVE = "archive string, records long, bytes long"


class WarcError(ValueError):
    """An archive that breaks the format: bad dictionary, frame, header, length or digest."""


def _open(uri: str, mode: str):
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    if mode == "w":
        store.create_dir(path.rpartition("/")[0], recursive=True)
        return store.open_output_stream(path, compression=None)
    return store.open_input_stream(path, compression=None)


def _printable(value: str) -> str:
    """Header values hold no control characters: those are percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def format_record(page_id, url, payload: bytes, digest: str, record_type: str, refers_to, date="2024-01-01T00:00:00Z") -> bytes:
    name = lambda n: f"<urn:page:{'none' if n is None else n}>"
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_printable(url)}")
    head += ["Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha256:{digest}"]
    if record_type == "revisit":
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {name(refers_to)}"]
    else:
        block += payload
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Checks one record's version, headers, lengths, trailer and digest, and returns its fields."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or lines[0] not in (b"WARC/1.0", b"WARC/1.1"):
        raise WarcError("no WARC version line")
    try:
        head.decode()
    except UnicodeDecodeError as e:
        raise WarcError("a header that isn't UTF-8") from e
    fields: dict[str, str] = {}
    for line in lines[1:]:
        key, colon, value = line.partition(b":")
        if not colon:
            raise WarcError(f"header without a colon: {line[:80]!r}")
        if (k := key.decode().strip().lower()) in fields:
            raise WarcError(f"header twice: {k}")
        fields[k] = value.decode().strip()
    for needed in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if needed not in fields:
            raise WarcError(f"no {needed}")
    if not fields["content-length"].isdigit() or len(rest) != int(fields["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise WarcError("Content-Length does not match the block")
    out = {"record_type": fields["warc-type"], "id": fields["warc-record-id"], "refers_to": fields.get("warc-refers-to"), "url": fields.get("warc-target-uri")}
    if out["record_type"] not in ("response", "revisit"):
        return out | {"payload": None, "payload_bytes": None, "payload_digest": None}
    http, gap, payload = rest[:-4].partition(b"\r\n\r\n")
    length = next((x.partition(b":")[2].strip() for x in http.split(b"\r\n")[1:] if x.lower().startswith(b"content-length:")), b"")
    if not gap or not http.startswith(b"HTTP/") or not length.isdigit():
        raise WarcError("the block is no HTTP response with a length")
    digest = fields.get("warc-payload-digest", "").removeprefix("sha256:")
    if out["record_type"] == "response":
        if len(payload) != int(length) or hashlib.sha256(payload).hexdigest() != digest:
            raise WarcError("the payload does not match its length or digest")
    elif payload or not out["refers_to"] or not re.fullmatch("[0-9a-f]{64}", digest):
        raise WarcError("a revisit needs WARC-Refers-To and a digest, and has no payload")
    return out | {"payload": payload if out["record_type"] == "response" else None, "payload_bytes": int(length), "payload_digest": digest}


def train_dictionary(records: list[bytes], size=16384):
    """A dictionary from a bounded sample, or None where the sample is too small for one."""
    import zstandard

    if len(records) < 16:
        return None
    try:
        return zstandard.train_dictionary(size, records)
    except zstandard.ZstdError:
        return None


def archive_head(dictionary) -> bytes:
    data = dictionary.as_bytes() if dictionary else b""
    return struct.pack("<II", DICTIONARY_MAGIC, len(data)) + data if data else b""


def read_archive(stream):
    """Yields the fields of each record of one archive, frame by frame."""
    import zstandard

    source = io.BufferedReader(stream) if not hasattr(stream, "peek") and isinstance(stream, io.RawIOBase) else stream
    pending = source.read(8)
    dictionary = None
    if len(pending) == 8 and struct.unpack("<I", pending[:4])[0] == DICTIONARY_MAGIC:
        size = struct.unpack("<I", pending[4:])[0]
        data = source.read(size)
        if len(data) != size:
            raise WarcError("the dictionary frame is cut short")
        if data[:4] == ZSTD_MAGIC:  # the dictionary may itself be compressed
            data = zstandard.ZstdDecompressor().decompress(data, max_output_size=1 << 27)
        dictionary, pending = zstandard.ZstdCompressionDict(data), b""
    decoder = zstandard.ZstdDecompressor(dict_data=dictionary)
    while pending or (pending := source.read(1 << 16)):
        if len(pending) < 4:
            pending += source.read(1 << 16)
        if pending[:4] != ZSTD_MAGIC:
            raise WarcError("no Zstandard frame where a record should start")
        frame, out = decoder.decompressobj(), []
        try:
            while not frame.eof:
                if not pending and not (pending := source.read(1 << 16)):
                    raise WarcError("a frame is cut short")
                out.append(frame.decompress(pending))
                pending = frame.unused_data if frame.eof else b""
        except zstandard.ZstdError as e:
            raise WarcError(f"a frame cannot be decoded: {e}") from e
        yield parse_record(b"".join(out))


def _write_task(folder: str, sample_records: int, sample_bytes: int, archive_bytes: int):
    def run(batches):
        import zstandard

        sink = encoder = None
        name, count, written, sample, sampled = "", 0, 0, [], 0

        def start():
            nonlocal sink, encoder, name, count, written, sample, sampled
            name, count, written = f"{folder}/{uuid.uuid4().hex}.warc.zst", 0, 0
            sink = _open(name, "w")
            dictionary = train_dictionary([x[: 1 << 16] for x in sample])
            encoder = zstandard.ZstdCompressor(level=3, dict_data=dictionary) if dictionary else zstandard.ZstdCompressor(level=3)
            put(archive_head(dictionary), 0)
            for x in sample:
                put(encoder.compress(x), 1)
            sample, sampled = [], 0

        def put(data, records):
            nonlocal count, written
            sink.write(data)
            count, written = count + records, written + len(data)

        def finish():
            nonlocal sink
            if sink is None and sample:
                start()
            if sink is not None:
                sink.close()
                sink = None
                return [pa.RecordBatch.from_pydict({"archive": [name], "records": pa.array([count], pa.int64()), "bytes": pa.array([written], pa.int64())})]
            return []

        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "digest", "record_type", "refers_to")), strict=True):
                record = format_record(*(x.as_py() for x in row))
                if sink is None:
                    sample.append(record)
                    sampled += len(record)
                    if len(sample) >= sample_records or sampled >= sample_bytes:
                        start()
                else:
                    put(encoder.compress(record), 1)
                if sink is not None and written >= archive_bytes:
                    yield from finish()
        yield from finish()

    return run


def _number(name: str | None):
    text = (name or "").removeprefix("<urn:page:").removesuffix(">")
    return int(text) if re.fullmatch(r"-?\d+", text) else None


def _rows(name, records, keep_payload, size=64):
    def batch(rows):
        cols = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "url": pa.string(), "archive": pa.string(), "payload": pa.binary()}
        return pa.RecordBatch.from_pydict({k: pa.array([r[k] for r in rows], t) for k, t in cols.items()})

    rows = []
    for r in records:
        rows.append(r | {"page_id": _number(r["id"]), "refers_to": _number(r["refers_to"]), "archive": name, "payload": r["payload"] if keep_payload else None})
        if len(rows) >= size:
            yield batch(rows)
            rows = []
    if rows:
        yield batch(rows)


def write_pages(pages: DataFrame, sample_records=256, sample_bytes=1 << 20, archive_bytes=1 << 26, revisit_bytes=100, folder=None, broadcast_rows=200_000) -> DataFrame:
    """Writes a record per row of ``pages`` (page_id, url, html) and returns the table of archives.

    Payload: the html as UTF-8, empty where null. Of rows with equal payloads of ``revisit_bytes`` or more, those
    with the smallest page_id are responses (more than one only if rows repeat that id) and the rest revisits of it;
    null ids count as larger than any. ``sample_*`` bound what a dictionary is trained on. A very long payload is one record,
    held whole; an empty table writes no archive. Digests that repeat are broadcast up to ``broadcast_rows``, so that no
    payload is shuffled, and joined by a shuffle beyond.
    """
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    large = rows.where(F.octet_length("payload") >= revisit_bytes).select("digest", F.col("page_id").alias("p"))
    first = large.groupBy("digest").agg(F.min("p").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    first = cut(first, "warc-first")
    rows = rows.join(F.broadcast(first) if first.count() <= broadcast_rows else first, "digest", "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    rows = rows.withColumn("record_type", F.when(again, "revisit").otherwise("response")).withColumn("refers_to", F.when(again, F.col("first")))
    run = _write_task(folder or new_path(pages.sparkSession, "warc"), sample_records, sample_bytes, archive_bytes)
    return cut(rows.mapInArrow(run, ARCHIVE), "warc-archives")


def read_written(archives: DataFrame, keep_payload=True) -> DataFrame:
    """The records of a table of archives (archive: uri), each archive read as a stream."""

    def run(batches):
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                with _open(name, "r") as stream:
                    yield from _rows(name, read_archive(stream), keep_payload)

    n = max(1, min(archives.count(), 10_000))
    return archives.select("archive").repartition(n, "archive").mapInArrow(run, RECORD)


def read_files(spark: SparkSession, path: str, keep_payload=True) -> DataFrame:
    """The records of archives at a path that perhaps only Spark can reach; each archive is held in memory as it is."""

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                yield from _rows(name, read_archive(io.BytesIO(content.as_py())), keep_payload)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, RECORD)


def query(spark, sf_dir):
    records = read_written(write_pages(table(spark, sf_dir, "pages")), keep_payload=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, p.payload_digest,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest AND payload_bytes >= 100
"""
