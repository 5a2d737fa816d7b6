"""WARC archives compressed by Zstandard with a dictionary of their own.

A file begins with a skippable frame that holds a dictionary, trained on a bounded sample of the file's records; every record
is a frame of its own, compressed with it. A payload that an earlier page has already (smallest ``page_id``, at least
``min_bytes``) is a revisit record that refers to that page's response.

A null html is an empty payload, a null url leaves the target URI out. Of equal payloads those with a null ``page_id`` revisit;
if all are null, all are responses. Rows that repeat the first page's id are responses too. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.llm.store import keep, open_fs, scratch_path

DICT_FRAME = 0x184D2A5D
DICT_BYTES, SAMPLE_BYTES, LEVEL = 32 << 10, 2 << 20, 6
SPACE_ID, NULL_ID = b"fwpage-0", b"fwpage-n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: int | None) -> str:
    """A UUID that carries the page's id."""
    return f"<urn:uuid:{uuid.UUID(bytes=(NULL_ID if page_id is None else SPACE_ID) + (page_id or 0).to_bytes(8, 'big', signed=True))}>"


def page_of(name: str) -> int | None:
    raw = uuid.UUID(name.strip("<>").removeprefix("urn:uuid:")).bytes
    return None if raw[:8] == NULL_ID else int.from_bytes(raw[8:], "big", signed=True)


def record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: int | None, date: str) -> bytes:
    """One record; ``payload`` is None for a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if payload is not None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if payload is None:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {record_id(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join([*head, "", ""]).encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(fields, block) of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def train(records: list[bytes]) -> bytes:
    """A dictionary from sample records; their beginnings one after another where they are too few to train on."""
    try:
        return zstandard.train_dictionary(min(DICT_BYTES, max(1024, sum(map(len, records)) // 8)), records, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(r[:512] for r in records)[:DICT_BYTES]


def write_archive(out, records: Iterator[bytes], level: int = LEVEL) -> int:
    """Dictionary frame and record frames to a binary stream; the number of records."""
    sample, size = [], 0
    for r in records:
        sample.append(r)
        size += len(r)
        if size >= SAMPLE_BYTES:
            break
    words = train(sample)
    out.write(struct.pack("<II", DICT_FRAME, len(words)) + words)
    press = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(words)) if words else zstandard.ZstdCompressor(level=level)
    n = 0
    for r in chain(sample, records):
        out.write(press.compress(r))
        n += 1
    return n


def read_archive(src, step: int = 1 << 16) -> Iterator[bytes]:
    """The records of an archive, one frame at a time."""
    magic, size = struct.unpack("<II", src.read(8))
    if magic != DICT_FRAME:
        raise ValueError("no dictionary frame")
    words = src.read(size)
    press = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words)) if words else zstandard.ZstdDecompressor()
    held = src.read(step)
    while held:
        frame, parts = press.decompressobj(), []
        while True:
            parts.append(frame.decompress(held))
            if frame.eof:
                held = frame.unused_data
                break
            held = src.read(step)
            if not held:
                raise ValueError("the last frame is cut off")
        if not held:
            held = src.read(step)
        yield b"".join(parts)


def write(pages: DataFrame, path: str, min_bytes: int = 100, date: str = "1970-01-01T00:00:00Z") -> list[str]:
    """Archives of ``pages`` (page_id, url, html), one a task, in the folder ``path``; their names.

    A file appears under its final name only when whole, so a task that runs again does no harm.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("size", F.octet_length("payload").cast("long"))
    # the key is an expression of its own, so that the join deals both sides anew and a hot digest can be split
    first = rows.filter(F.col("size") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select(F.concat("digest", F.lit("")).alias("digest"), "first")
    refers = F.when(F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > F.col("first"))), F.col("first"))
    sent = rows.join(first, "digest", "left").select("page_id", "url", F.when(refers.isNull(), F.col("payload")).alias("payload"), "size", "digest", refers.alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}.warc.zst"
        fs, folder = open_fs(path)
        fs.create_dir(folder, recursive=True)
        own = f"{folder}/.{name}.{task.taskAttemptId()}"
        records = (record(*(x.as_py() for x in row), date) for batch in batches for row in zip(*batch.columns, strict=True))
        with fs.open_output_stream(own) as out:
            n = write_archive(out, records)
        fs.move(own, f"{folder}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], names=["file", "records"])

    made = keep(sent.mapInArrow(run, "file string, records long"), "archives")
    return sorted(r["file"] for r in made.filter("records > 0").collect())


def read(spark: SparkSession, path: str, files: list[str]) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of all records in ``files``."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = open_fs(path)
        for name in chain.from_iterable(b.column(0).to_pylist() for b in batches):
            with fs.open_input_file(f"{folder}/{name}") as src:
                rows = []
                for raw in read_archive(src):
                    fields, block = parse(raw)
                    http, _, payload = block.partition(b"\r\n\r\n")
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                    if fields["WARC-Type"] == "response":
                        own, refers = (len(payload), hashlib.sha256(payload).hexdigest()), None
                        if own[1] != digest:
                            raise ValueError(f"{name}: a payload does not match its digest")
                    else:
                        own, refers = (int(http.rpartition(b"Content-Length: ")[2]), digest), page_of(fields["WARC-Refers-To"])
                    rows.append((page_of(fields["WARC-Record-ID"]), *own, fields["WARC-Type"], refers))
            types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    where = spark.createDataFrame([(f,) for f in files], "file string").repartition(max(1, len(files)), "file")
    return where.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame, **how) -> DataFrame:
    """Archives in the shared folder, written and read back."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    return read(spark, path, write(pages, path, **how))
