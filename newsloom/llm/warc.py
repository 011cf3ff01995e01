"""WARC archives in Zstandard: a leading skippable frame holds the dictionary, and each record is one frame.

Writing and reading run in Spark tasks. A task writes its records to archives of bounded size under a folder that all
machines share, through pyarrow's file systems, so that file:, s3:, gs: and hdfs: addresses all work. File names hold
the task attempt, and only files that a finished attempt reported are read, so lost executors and repeated tasks leave
no trace. Reading checks the dictionary frame, each record's headers, its lengths and its payload digest.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, slices, written

#: Fixed values of the format: the skippable frame that may hold a dictionary, and the magics of a frame and a dictionary.
DICT_FRAME, FRAME, DICT = 0x184D2A5D, 0xFD2FB528, 0xEC30A437
SMALLEST = 100
ARCHIVE_BYTES = 16 << 20


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", smallest: int = SMALLEST) -> DataFrame:
    """page_id, url, body, digest, refers_to of each row of pages: of equal payloads of at least `smallest` bytes the
    least page_id (nulls last) is the response, the others refer to it."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.encode(F.coalesce(F.col(body_col), F.lit("")), "UTF-8").alias("body"))
    rows = rows.withColumn("digest", F.sha2("body", 256))
    keys = rows.where(F.length("body") >= smallest).select("digest", "page_id")
    firsts = keys.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("digest", "first")
    return rows.join(firsts, "digest", "left").select("page_id", "url", "body", "digest", F.expr("case when page_id is null or page_id <> first then first end as refers_to"))


def train_dictionary(pages: DataFrame, body_col: str = "html", sample: int = 2000, size: int = 16 << 10) -> bytes:
    """A Zstandard dictionary of `size` bytes, trained on the first 4 KB of about `sample` distinct bodies, taken by
    hash and never more than twice that; a dictionary changes sizes alone, never contents."""
    texts = pages.where(F.length(body_col) > 0).select(F.substring(body_col, 1, 4096).alias("t"))
    step = -(-texts.count() // sample) or 1
    bodies = sorted(r.t.encode() for r in texts.where(F.pmod(F.xxhash64("t"), F.lit(step)) == 0).distinct().limit(2 * sample).collect())
    try:
        return zstandard.train_dictionary(size, bodies, level=3).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too little to train on: the bytes themselves serve
        return b"".join(bodies)[:size]


def record(page_id, url, body: bytes, digest: str, refers_to) -> bytes:
    """One WARC 1.1 record. A revisit carries no payload, but its digest and length."""
    lines = [
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {len(body)}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + " ".join(url.split()))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body)
    block = http + (body if refers_to is None else b"")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return ("WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def head(dictionary: bytes) -> bytes:
    """The leading skippable frame."""
    return struct.pack("<II", DICT_FRAME, len(dictionary)) + dictionary


def write_archives(records: DataFrame, folder: str, dictionary: bytes, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the rows of plan_records() below `folder`; returns path, n_records of each archive, as a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder if ":" in folder else f"file://{folder}")
        store.create_dir(base)
        pack = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_content_size=True, write_checksum=True).compress
        out, name, size, n, done = None, "", 0, 0, []
        for batch in batches:
            for part in slices(batch, "body", archive_bytes):
                for row in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "body", "digest", "refers_to"))):
                    if out is None:
                        t = TaskContext.get()
                        name, size, n = f"{t.partitionId():06d}-{t.taskAttemptId()}-{len(done):04d}.warc.zst", 0, 0
                        out = store.open_output_stream(f"{base}/{name}", compression=None)
                        out.write(head(dictionary))
                    frame = pack(record(*row))
                    out.write(frame)
                    size, n = size + len(frame), n + 1
                    if size >= archive_bytes:
                        out.close()
                        out = done.append((name, n))
        if out is not None:
            out.close()
            done.append((name, n))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done]), pa.array([d[1] for d in done], pa.int64())], ["name", "n_records"])

    return written(records.mapInArrow(run, "name string, n_records bigint"), "warc-manifest")


class BadArchive(ValueError):
    """An archive that breaks the format."""


def read_records(data: bytes) -> Iterator[dict]:
    """The records of one archive, validated: dictionary frame first, then one frame for each record."""
    if len(data) < 8 or struct.unpack_from("<I", data)[0] != DICT_FRAME:
        raise BadArchive("no dictionary frame at the start")
    at = 8 + struct.unpack_from("<I", data, 4)[0]
    if at > len(data):
        raise BadArchive("the dictionary frame is cut off")
    words = data[8:at]
    if words[:4] == struct.pack("<I", FRAME):  # the dictionary may itself be compressed
        words = zstandard.ZstdDecompressor().decompress(words)
    unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words) if words else None)
    view = memoryview(data)
    while at < len(data):
        if struct.unpack_from("<I", data, at)[0] != FRAME:
            raise BadArchive(f"no frame at byte {at}")
        one = unpack.decompressobj()
        text, start = [], at
        while not one.eof and at < len(data):
            text.append(one.decompress(view[at : at + 65536]))
            at += min(65536, len(data) - at)
        if not one.eof:
            raise BadArchive(f"the frame at byte {start} is cut off")
        at -= len(one.unused_data)
        yield parse(b"".join(text))


def parse(raw: bytes) -> dict:
    """The headers and payload of one record; BadArchive where they contradict each other."""
    top, found, rest = raw.partition(b"\r\n\r\n")
    lines = top.decode("utf-8").split("\r\n")
    if not found or lines[0] not in ("WARC/1.1", "WARC/1.0"):
        raise BadArchive("not a WARC record")
    headers = {}
    for line in lines[1:]:
        key, colon, value = line.partition(":")
        if not colon:
            raise BadArchive(f"header without a colon: {line[:80]}")
        headers[key.strip().lower()] = value.strip()
    length = headers.get("content-length", "")
    if not length.isdigit() or len(rest) != int(length) + 4 or rest[-4:] != b"\r\n\r\n":
        raise BadArchive("Content-Length doesn't hold")
    for needed in ("warc-type", "warc-record-id", "warc-date"):
        if needed not in headers:
            raise BadArchive(f"{needed} is missing")
    http, _, payload = rest[:-4].partition(b"\r\n\r\n")
    if not http.startswith(b"HTTP/"):
        raise BadArchive("not an HTTP response")
    if headers["warc-type"] == "response":
        said = headers.get("warc-payload-digest", "").removeprefix("sha256:")
        if said and hashlib.sha256(payload).hexdigest() != said:
            raise BadArchive("the payload's digest doesn't hold")
        if int(headers.get("x-payload-length", len(payload))) != len(payload):
            raise BadArchive("the payload's length doesn't hold")
    elif payload:
        raise BadArchive("a revisit with a payload")
    return {"headers": headers, "payload": payload}


def read_archives(spark: SparkSession, folder: str, manifest: DataFrame | None = None, keep_payload: bool = True) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_bytes, payload_digest and, with keep_payload, payload (null for
    revisits) of each record below `folder`. Spark's binaryFile source reads the archives, so any store serves; with a
    manifest, only the files that it names."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    if manifest is not None:
        files = files.withColumn("name", F.regexp_extract("path", "[^/]+$", 0)).join(manifest.select("name"), "name", "left_semi")
    fields = {"page_id": pa.string(), "url": pa.string(), "record_type": pa.string(), "refers_to": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string()}
    if keep_payload:
        fields["payload"] = pa.binary()

    def one(r: dict) -> list:
        h = r["headers"]
        name = lambda key: h.get(key, "").removeprefix("<urn:page:").removesuffix(">") or None
        body = r["payload"] if h["warc-type"] == "response" else None
        said, length = h.get("warc-payload-digest", "").removeprefix("sha256:"), h.get("x-payload-length")
        if body is None and not (said and length):
            raise BadArchive("a revisit without its payload's digest and length")
        said, length = said or hashlib.sha256(body).hexdigest(), len(body) if length is None else int(length)
        return [name("warc-record-id"), h.get("warc-target-uri"), h["warc-type"], name("warc-refers-to"), length, said] + [body] * keep_payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content"):
                rows, size = [], 0
                for r in read_records(data.as_py()):
                    rows.append(one(r))
                    size += len(r["payload"])
                    if size > 4 << 20 or len(rows) >= 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), fields.values())], list(fields))
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), fields.values())], list(fields))

    return files.select("content").mapInArrow(run, "page_id string, url string, record_type string, refers_to string, payload_bytes bigint, payload_digest string" + ", payload binary" * keep_payload)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """Writes a record for each row of pages, reads the archives back, and returns what the records say.

    One row per row of pages: page_id, payload_bytes, payload_digest (of the full payload), record_type, refers_to.
    Null bodies are empty payloads; payloads of under 100 bytes are all responses; a null page_id stays null and is
    never referred to while its payload has another page; rows that repeat both id and payload of a response are
    responses too. Payloads are UTF-8, as Spark has no other strings. Extra columns are ignored.
    """
    spark = pages.sparkSession
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    manifest = write_archives(plan_records(pages, id_col, url_col, body_col), folder, train_dictionary(pages, body_col))
    if not manifest.take(1):
        return spark.createDataFrame([], "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")
    kind = pages.schema[id_col].dataType
    read = read_archives(spark, folder, manifest, keep_payload=False)
    return read.select(F.col("page_id").cast(kind), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind))
