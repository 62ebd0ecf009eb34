"""WARC archives as seekable Zstandard bundles.

Records are written in bundles: files of independent Zstandard frames, each
of at most ``FRAME`` bytes, followed by a seek table in a skippable frame (the
public seekable format). A frame holds several records, or a part of a long
one. The index maps each record identifier to (bundle, frame, offset inside
the frame, length), so one record is read by decompressing its frames only.

Records with equal payloads of at least ``REVISIT_BYTES`` bytes are stored
once: the record with the largest id is the response, the others are revisits
that refer to it. Payloads are compared by SHA-1, length and a second hash.

Every task writes bundles under names of its own and reports them in the
index; only bundles named in the index count, so a retried or lost task
leaves at most files that nothing refers to.

Defined results: a null payload is empty, a null url has no target line; rows
that agree in id and payload are written each (the response's twins too, as
none has a larger id); a null id sorts below all others.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stage, stage_path

FRAME = 1 << 20          # uncompressed bytes of a frame
BUNDLE = 64 << 20        # uncompressed bytes after which a bundle is closed
REVISIT_BYTES = 1000
LEVEL = 3

SKIPPABLE = 0x184D2A5E   # fixed values of the seekable format
SEEK_MAGIC = 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = ("record_id string, page_id bigint, bundle string, frame int, offset int, "
         "length bigint")


class BundleWriter:
    """Writes records to one seekable bundle."""

    def __init__(self, folder: str):
        self.name = f"bundle-{uuid.uuid4().hex}.warc.zst"
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root)
        self.out = fs.open_output_stream(f"{root}/{self.name}", compression=None)
        self.pack = zstandard.ZstdCompressor(level=LEVEL)
        self.frames: list[tuple[int, int]] = []
        self.held = bytearray()
        self.size = 0

    def add(self, record: bytes) -> tuple[int, int]:
        """Append a record; its (frame, offset)."""
        at = (len(self.frames), len(self.held))
        view = memoryview(record)
        while len(view):
            room = FRAME - len(self.held)
            self.held += view[:room]
            view = view[room:]
            if len(self.held) == FRAME:
                self._flush()
        self.size += len(record)
        return at

    def _flush(self) -> None:
        if self.held:
            packed = self.pack.compress(bytes(self.held))
            self.out.write(packed)
            self.frames.append((len(packed), len(self.held)))
            self.held.clear()

    def close(self) -> None:
        self._flush()
        table = b"".join(struct.pack("<II", *f) for f in self.frames)
        table += struct.pack("<IBI", len(self.frames), 0, SEEK_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()


class BundleReader:
    """Random access to one seekable bundle."""

    def __init__(self, folder: str, name: str):
        fs, root = pafs.FileSystem.from_uri(folder)
        self.file = fs.open_input_file(f"{root}/{name}")
        size = self.file.size()
        count, _, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEK_MAGIC:
            raise ValueError(f"{name} has no seek table")
        table = self.file.read_at(8 * count, size - 9 - 8 * count)
        self.frames, at = [], 0
        for packed, plain in struct.iter_unpack("<II", table):
            self.frames.append((at, packed, plain))
            at += packed
        self.unpack = zstandard.ZstdDecompressor()

    def frame(self, k: int) -> bytes:
        at, packed, plain = self.frames[k]
        return self.unpack.decompress(self.file.read_at(packed, at), max_output_size=plain)

    def read(self, frame: int, offset: int, length: int) -> bytes:
        """One record by its place."""
        out = bytearray(self.frame(frame)[offset:offset + length])
        while len(out) < length:
            frame += 1
            out += self.frame(frame)[:length - len(out)]
        return bytes(out)

    def records(self) -> Iterator[bytes]:
        """All records in order; holds one record and one frame at a time."""
        held = bytearray()
        for k in range(len(self.frames)):
            held += self.frame(k)
            at = 0
            while (end := _record_end(held, at)) is not None and end <= len(held):
                yield bytes(held[at:end])
                at = end
            del held[:at]
        if held:
            raise ValueError("a record is cut off")

    def close(self) -> None:
        self.file.close()


def _record_end(data: bytearray, at: int) -> int | None:
    """Where the record at ``at`` ends; None if its header is not all there."""
    head = data.find(b"\r\n\r\n", at)
    if head < 0:
        return None
    mark = b"\r\nContent-Length: "
    size = data.find(mark, at, head + 2)
    stop = data.find(b"\r\n", size + len(mark))
    return head + 4 + int(data[size + len(mark):stop]) + 4


def render(record_id: str, kind: str, url: str | None, digest: str, size: int,
           refers: str | None, payload: bytes) -> bytes:
    """One WARC/1.1 record. A revisit carries no payload."""
    body = payload if kind == "response" else b""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>"]
    if url is not None:
        clean = url.replace("\r", "%0D").replace("\n", "%0A")
        lines.append(f"WARC-Target-URI: {clean}")
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}"]
    if refers is not None:
        lines += [f"WARC-Refers-To: <{refers}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of a record."""
    head, _, body = record.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    return fields, body[:int(fields["Content-Length"])]


def record_name(page_id: int | None) -> str:
    return f"urn:page:{'null' if page_id is None else page_id}"


def mark_revisits(pages: DataFrame, payload: str = "html") -> DataFrame:
    """``page_id``, ``url``, ``payload`` (binary), ``digest``, ``refers_to``."""
    body = F.coalesce(F.encode(F.col(payload), "UTF-8"), F.lit(b""))
    rows = (pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url",
                         body.alias("payload"))
            .withColumn("digest", F.sha1("payload"))
            .withColumn("size", F.octet_length("payload"))
            .withColumn("check", F.xxhash64("payload")))
    key = ["digest", "size", "check"]
    # Only ids and hashes travel here; equal payloads collapse before the shuffle.
    slim = rows.where(F.col("size") >= REVISIT_BYTES).select(*key, "page_id")
    groups = (slim.groupBy(*key)
              .agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n"))
              .where("n > 1 and refers_to is not null"))
    revisits = (slim.join(groups, key)
                .where(F.coalesce(F.col("page_id") < F.col("refers_to"), F.lit(True)))
                .select("page_id", "digest", "check", "refers_to").distinct())
    renamed = revisits.toDF("__p", "__d", "__c", "refers_to")
    return rows.join(renamed, F.col("page_id").eqNullSafe(F.col("__p"))
                     & (F.col("digest") == F.col("__d")) & (F.col("check") == F.col("__c")),
                     "left").select("page_id", "url", "payload", "digest", "refers_to")


def write_bundles(records: DataFrame, folder: str) -> DataFrame:
    """Write ``mark_revisits`` rows as bundles; the index, written to the shared
    folder. ``folder`` is a URI that all executors reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, rows = None, []

        def done() -> pa.RecordBatch:
            writer.close()
            cols = list(zip(*rows))
            types = [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int64()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, types)],
                names=["record_id", "page_id", "bundle", "frame", "offset", "length"])

        for b in batches:
            for i in range(b.num_rows):
                page, url, body, digest, refers = (c[i].as_py() for c in b.columns)
                name = record_name(page)
                record = render(name, "response" if refers is None else "revisit", url,
                                digest, len(body), None if refers is None
                                else record_name(refers), body)
                writer = writer or BundleWriter(folder)
                frame, offset = writer.add(record)
                rows.append((name, page, writer.name, frame, offset, len(record)))
                if writer.size >= BUNDLE:
                    yield done()
                    writer, rows = None, []
        if writer:
            yield done()

    return stage(records.mapInArrow(run, INDEX), "warc-index")


RECORD = ("page_id bigint, record_type string, url string, payload_digest string, "
          "payload_bytes bigint, refers_to bigint, payload binary")


def _fields(record: bytes):
    head, body = parse(record)
    page = head["WARC-Record-ID"].strip("<>").rpartition(":")[2]
    refers = head.get("WARC-Refers-To", "").strip("<>").rpartition(":")[2]
    return (None if page == "null" else int(page), head["WARC-Type"],
            head.get("WARC-Target-URI"), head["WARC-Payload-Digest"].partition(":")[2],
            int(head["X-Payload-Length"]), int(refers) if refers else None, body)


def _record_batch(rows) -> pa.RecordBatch:
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(),
             pa.binary()]
    names = [x.split()[0] for x in RECORD.split(", ")]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def read_bundles(index: DataFrame, folder: str) -> DataFrame:
    """All records of the bundles that the index names."""
    bundles = index.where("frame = 0 and offset = 0").select("bundle")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column(0).to_pylist():
                reader = BundleReader(folder, name)
                rows, size = [], 0
                for record in reader.records():
                    rows.append(_fields(record))
                    size += len(record)
                    if size >= FRAME * 4:
                        yield _record_batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _record_batch(rows)
                reader.close()

    return bundles.repartition("bundle").mapInArrow(run, RECORD)


def fetch(index: DataFrame, folder: str, wanted: DataFrame) -> DataFrame:
    """The records whose ``record_id`` is in ``wanted``, by seeking."""
    places = (index.join(wanted.select("record_id").distinct(), "record_id", "left_semi")
              .select("bundle", "frame", "offset", "length"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, name = None, None
        for b in batches:
            for bundle, frame, offset, length in zip(*(c.to_pylist() for c in b.columns)):
                if bundle != name:
                    if reader:
                        reader.close()
                    reader, name = BundleReader(folder, bundle), bundle
                yield _record_batch([_fields(reader.read(frame, offset, length))])
        if reader:
            reader.close()

    return (places.repartition("bundle", "frame")
            .sortWithinPartitions("bundle", "frame", "offset").mapInArrow(run, RECORD))


def archive(spark: SparkSession, pages: DataFrame) -> tuple[DataFrame, str]:
    """Write pages to bundles in the shared folder: (index, folder URI)."""
    folder = stage_path(spark, "warc-bundles")
    if "://" not in folder:
        folder = "file://" + folder.removeprefix("file:")
    return write_bundles(mark_revisits(pages), folder), folder


def digests(records: DataFrame) -> DataFrame:
    """Digest and size per record: of the stored payload for responses, of the
    record's fields for revisits."""
    own: Column = F.col("record_type") == "response"
    return records.select(
        "page_id", F.when(own, F.octet_length("payload")).otherwise(F.col("payload_bytes"))
        .cast("bigint").alias("payload_bytes"),
        F.when(own, F.sha1("payload")).otherwise(F.col("payload_digest"))
        .alias("payload_digest"), "record_type", "refers_to")
