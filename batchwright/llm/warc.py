"""WARC archives as seekable Zstandard bundles.

A bundle is one file: independent Zstandard frames, each with some whole WARC records, and at the end a seek table
in a skippable frame (the public seekable format: per frame its compressed and decompressed size, then the number of
frames, a descriptor and the magic number). The index maps each record's identifier to its bundle, frame, and
offset and length within that frame's content, so that one record is read by one range request and one frame.

Records of equal payloads: the one with the smallest page_id (nulls last, then the earlier row) is the response,
others are revisits that refer to it, if the payload has at least ``least_bytes``. Digests are compared first, apart
from the payloads. Where the revisits are few enough to be broadcast (they are counted) no payload moves at all.

Bundles are written through pyarrow's file systems into the shared folder, under names that hold the task's attempt;
only those in the index of tasks that ended well count, so tasks may fail and run again.

Defined cases: null html is an empty payload; a null page_id is written as ``null`` and read back as null; repeated
rows are records of their own; an empty table gives an empty index and no bundle; other columns are ignored.
``pages`` that isn't a plain reading of Parquet files is written as a table first, so that a row can be told by its place.
"""

from __future__ import annotations

import base64
import hashlib
import struct

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from batchwright.llm.common import fresh, join_rows, map_arrow, stable, text_or_empty, with_row
from batchwright.session import materialize, new_path

# Fixed values of the seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
INDEX = "page_id long, row long, record_id string, bundle string, frame int, frame_at long, frame_bytes long, offset long, length long"
RECORDS = "page_id long, row long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"
DATE = "2024-01-01T00:00:00Z"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _id(page_id, row) -> str:
    return f"<urn:x-page:{'null' if page_id is None else page_id}:{row}>"


def _page_of(record_id: str):
    page = record_id[1:-1].split(":")[2]
    return None if page == "null" else int(page)


def _clean(value: str) -> str:
    return "".join(c for c in value if c not in "\r\n")


def record(page_id, row, url: str, payload: bytes, original: str | None) -> bytes:
    """One WARC/1.1 record; ``original`` is the identifier that a revisit refers to."""
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if original else 'response'}",
        f"WARC-Record-ID: {_id(page_id, row)}",
        f"WARC-Target-URI: {_clean(url)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        f"WARC-Payload-Length: {len(payload)}",
    ]
    if original:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {original}"]
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (b"" if original else payload)
    return "\r\n".join([*lines, "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}", "", ""]).encode() + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """The headers of a record and its payload, which must have the digest that the headers give unless it is a revisit."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    body = rest[: int(headers["Content-Length"])]
    if rest[len(body) :] != b"\r\n\r\n":
        raise ValueError(f"{headers['WARC-Record-ID']}: the record doesn't end where it should")
    payload = body.partition(b"\r\n\r\n")[2]
    if headers["WARC-Type"] == "response" and f"sha1:{base32_sha1(payload)}" != headers["WARC-Payload-Digest"]:
        raise ValueError(f"{headers['WARC-Record-ID']}: its payload doesn't have its digest")
    return headers, payload


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    """The last frame of a bundle from the compressed and decompressed size of each frame."""
    body = b"".join(struct.pack("<II", *s) for s in sizes) + struct.pack("<IBI", len(sizes), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(read_at, size: int) -> list[tuple[int, int, int]]:
    """Of each frame its place, compressed and decompressed size. ``read_at(offset, length)`` gives bytes of the bundle."""
    frames, descriptor, magic = struct.unpack("<IBI", read_at(size - 9, 9))
    if magic != SEEKABLE or descriptor & 0x80:
        raise ValueError("this bundle has no seek table without checksums")
    raw, out, at = read_at(size - 9 - 8 * frames, 8 * frames), [], 0
    for packed, whole in struct.iter_unpack("<II", raw):
        out.append((at, packed, whole))
        at += packed
    return out


class BundleWriter:
    """Collects records into frames of about ``frame_bytes`` and frames into one file."""

    def __init__(self, stream, frame_bytes: int, level: int):
        self.stream, self.frame_bytes = stream, frame_bytes
        self.compress = zstandard.ZstdCompressor(level=level).compress
        self.sizes, self.open, self.held, self.at, self.waiting = [], [], 0, 0, []

    def add(self, key, data: bytes) -> list[tuple]:
        self.waiting.append((key, self.held, len(data)))
        self.open.append(data)
        self.held += len(data)
        return self.end_frame() if self.held >= self.frame_bytes else []

    def end_frame(self) -> list[tuple]:
        """(key, frame, frame_at, frame_bytes, offset, length) of the records of the frame that ends."""
        if not self.open:
            return []
        packed = self.compress(b"".join(self.open))
        self.stream.write(packed)
        placed = [(key, len(self.sizes), self.at, len(packed), offset, length) for key, offset, length in self.waiting]
        self.sizes.append((len(packed), self.held))
        self.at += len(packed)
        self.open, self.waiting, self.held = [], [], 0
        return placed

    def close(self) -> None:
        self.stream.write(seek_table(self.sizes))
        self.stream.close()


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def plan(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """row, original_id, original_row of each row that is a revisit. No payload is shuffled."""
    html = F.encode(text_or_empty("html"), "utf-8")
    row = fresh(pages, "row")
    marks = with_row(pages, row).select(F.col("page_id").cast("long").alias("page_id"), F.col(row).alias("row"), F.unhex(F.sha1(html)).alias("digest"), F.octet_length(html).alias("size")).where(F.col("size") >= least_bytes)
    first = F.struct(F.col("page_id").isNull().alias("unnamed"), "page_id", "row")
    groups = marks.groupBy("digest", "size").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    return marks.join(groups, ["digest", "size"]).where(F.col("row") != F.col("first.row")).select("row", F.col("first.page_id").alias("original_id"), F.col("first.row").alias("original_row"))


def write_archives(pages: DataFrame, folder: str | None = None, least_bytes: int = 0, frame_bytes: int = 1 << 18, bundle_bytes: int = 1 << 26, level: int = 3) -> DataFrame:
    """Write a record for every page; return the index, which is kept as a table. Without ``folder`` the bundles go to
    the shared folder until ``session.release``."""
    pages = stable(pages)
    folder = folder or new_path(pages.sparkSession, "warc", released=True)
    uri = folder if "://" in folder else f"file://{folder}"
    number = fresh(pages, "row")
    rows = with_row(pages, number).select(F.col("page_id").cast("long").alias("page_id"), F.col(number).alias("row"), text_or_empty("url").alias("url"), F.encode(text_or_empty("html"), "utf-8").alias("payload"))
    work = join_rows(rows, materialize(plan(pages, least_bytes), "warc-plan"), "row", "left").select("row", "page_id", "url", "payload", "original_id", "original_row")

    def write(batches):
        files, path = _file_system(uri)
        task = TaskContext.get()
        bundle = writer = None
        count = 0

        def index(placed):
            if placed:
                keys, frames, ats, sizes, offsets, lengths = zip(*placed, strict=True)
                page, row = zip(*keys, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(page, pa.int64()), pa.array(row, pa.int64()), pa.array([_id(*k) for k in keys]), pa.array([bundle] * len(keys)), pa.array(frames, pa.int32()), *(pa.array(x, pa.int64()) for x in (ats, sizes, offsets, lengths))],
                    names=["page_id", "row", "record_id", "bundle", "frame", "frame_at", "frame_bytes", "offset", "length"],
                )

        for b in batches:
            for row, page, url, payload, original, original_row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if writer is None:
                    bundle = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{count:04d}.warc.zst"
                    count += 1
                    files.create_dir(path, recursive=True)
                    writer = BundleWriter(files.open_output_stream(f"{path}/{bundle}", compression=None), frame_bytes, level)
                yield from index(writer.add((page, row), record(page, row, url, payload, None if original_row is None else _id(original, original_row))))
                if writer.at >= bundle_bytes:
                    yield from index(writer.end_frame())
                    writer.close()
                    writer = None
        if writer is not None:
            yield from index(writer.end_frame())
            writer.close()

    return materialize(map_arrow(work, write, INDEX).withColumn("folder", F.lit(uri)), "warc-index")


def read_archives(spark: SparkSession, index: DataFrame, with_payload: bool = False) -> DataFrame:
    """The records that ``index`` (or rows of it) names, read from their bundles by frame: each frame once. The
    payload of a revisit is not there; its digest and size are those of the full payload."""
    frames = index.groupBy("folder", "bundle", "frame", "frame_at", "frame_bytes").agg(F.collect_list(F.struct("offset", "length", "record_id", "row")).alias("records"))

    def read(batches):
        open_name = stream = table = None
        for b in batches:
            for folder, bundle, frame, at, size, records in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (folder, bundle) != open_name:
                    files, path = _file_system(folder)
                    stream = files.open_input_file(f"{path}/{bundle}")
                    open_name, table = (folder, bundle), read_seek_table(lambda o, n, s=stream: s.read_at(n, o), stream.size())
                if table[frame][:2] != (at, size):
                    raise ValueError(f"{bundle}: the index and the seek table differ on frame {frame}")
                whole = zstandard.ZstdDecompressor().decompress(stream.read_at(size, at), max_output_size=table[frame][2])
                out = []
                for r in records:
                    headers, payload = parse(whole[r["offset"] : r["offset"] + r["length"]])
                    if headers["WARC-Record-ID"] != r["record_id"]:
                        raise ValueError(f"{bundle}: {r['record_id']} isn't where the index says")
                    refers = headers.get("WARC-Refers-To")
                    out.append((_page_of(headers["WARC-Record-ID"]), r["row"], int(headers["WARC-Payload-Length"]), headers["WARC-Payload-Digest"].removeprefix("sha1:"), headers["WARC-Type"], _page_of(refers) if refers else None, headers["WARC-Target-URI"], payload if with_payload and not refers else None))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["page_id", "row", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"])

    return map_arrow(frames.sortWithinPartitions("folder", "bundle", "frame"), read, RECORDS)
