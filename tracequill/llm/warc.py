"""WARC archives as seekable Zstandard bundles.

Each task groups its records into independent Zstandard frames, writes them to a bundle, and
appends a seek table in a skippable frame. An index maps each record id to its bundle, frame, and offset in the frame, so that
one record is read by decompressing one frame.

Null html counts as empty. Of records with equal payloads of at least `least_bytes` bytes, the one with the largest
id is a response and the others refer to it; repeated rows that share that largest id are all responses.
Rows with a null id get record ids of their own and never win. An empty table gives no bundle. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import uuid

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracequill.llm.bpe import slices
from tracequill.llm.common import new_folder, open_fs, ship, written

#: Bytes of records in a frame, before compression.
FRAME = 1 << 20
#: Parts of the rows of one payload.
SALTS = 64
#: Fixed values of the seekable format: the skippable frame's magic number and the seek table's.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
INDEX = "page_id long, bundle string, frame_at long, frame_bytes long, at long, record_bytes long"


def _record(url: str, page_id: int | None, kind: str, payload: bytes, digest: str, refers_to: int | None, seen: str) -> bytes:
    """One WARC/1.1 record; a revisit has no payload. No id is drawn at random: a task run again writes the same bytes."""
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id}|{url}|{digest}")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Date: {seen}", f"WARC-Target-URI: {url.replace(chr(13), '%0D').replace(chr(10), '%0A')}", f"X-Page-Id: {'' if page_id is None else page_id}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-Id: {refers_to}"]
        body = b"HTTP/1.1 200 OK\r\n\r\n"
    else:
        body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + payload
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    body = rest[: int(fields["Content-Length"])]
    return fields, body.partition(b"\r\n\r\n")[2]


class Bundle:
    """Independent frames, then the seek table."""

    def __init__(self, sink, level: int = 3):
        self.sink, self.zip = sink, zstandard.ZstdCompressor(level=level)
        self.held, self.size, self.at = [], 0, 0
        self.frames: list[tuple[int, int]] = []
        self.index: list[list] = []

    def add(self, page_id: int | None, record: bytes) -> None:
        self.index.append([page_id, self.at, None, self.size, len(record)])
        self.held.append(record)
        self.size += len(record)
        if self.size >= FRAME:
            self.flush()

    def flush(self) -> None:
        if not self.held:
            return
        raw = b"".join(self.held)
        data = self.zip.compress(raw)
        for x in reversed(self.index):
            if x[2] is not None:
                break
            x[2] = len(data)
        self.sink.write(data)
        self.frames.append((len(data), len(raw)))
        self.at += len(data)
        self.held, self.size = [], 0

    def close(self) -> None:
        self.flush()
        body = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.sink.write(struct.pack("<II", SKIPPABLE, len(body)) + body)


def seek_table(source) -> list[tuple[int, int, int]]:
    """(offset, compressed, raw) of each frame, from the end of the bundle."""
    source.seek(source.size() - 9)
    n, _, magic = struct.unpack("<IBI", source.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    source.seek(source.size() - 9 - 8 * n)
    at, out = 0, []
    for c, r in struct.iter_unpack("<II", source.read(8 * n)):
        out.append((at, c, r))
        at += c
    return out


def with_winners(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """page_id, url, body (binary), refers_to: the page whose payload this one repeats, or null."""
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), F.coalesce(pages["html"].cast("string"), F.lit("")).cast("binary").alias("body"))
    # a payload may have very many copies: its winner goes to each part of its rows, and no part is one task's whole load
    rows = rows.withColumns({"body_key": F.sha2("body", 256), "salt": F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")})
    long_enough = F.octet_length("body") >= least_bytes
    first = rows.where(long_enough).groupBy("body_key").agg(F.max("page_id").alias("winner"), F.count("*").alias("n"), F.collect_set("salt").alias("salts")).where("n > 1")
    return rows.join(first.select("body_key", "winner", F.explode("salts").alias("salt")), ["body_key", "salt"], "left").select("page_id", "url", "body", F.when(~F.col("winner").eqNullSafe(F.col("page_id")), F.col("winner")).alias("refers_to"))


def write_bundles(pages: DataFrame, folder: str | None = None, least_bytes: int = 1000, seen: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes the archives and returns the index of their records (a written table)."""
    spark = pages.sparkSession
    ship(spark)
    folder = folder or new_folder(spark, "warc")

    def run(batches):
        part = TaskContext.get().partitionId()
        fs, base = open_fs(folder)
        name, made = f"part-{part:06d}-{TaskContext.get().attemptNumber()}-{uuid.uuid4().hex[:8]}.warc.zst", f"{base}/.writing-{uuid.uuid4().hex}"
        out = sink = None
        for b in batches:
            for s in slices(b, column=2):
                if out is None:
                    sink = fs.open_output_stream(made)
                    out = Bundle(sink)
                for page, url, body, refers in zip(*(s.column(i).to_pylist() for i in range(4)), strict=True):
                    out.add(page, _record(url or "", page, "response" if refers is None else "revisit", body, hashlib.sha1(body).hexdigest(), refers, seen))
        if out is not None:
            out.close()
            sink.close()
            fs.move(made, f"{base}/{name}")  # only a finished bundle gets a name, and only a finished task an index
            page, at, size, inner, length = zip(*out.index, strict=True)
            n = len(page)
            yield pa.RecordBatch.from_arrays([pa.array(page, pa.int64()), pa.array([f"{folder}/{name}"] * n), *(pa.array(x, pa.int64()) for x in (at, size, inner, length))], ["page_id", "bundle", "frame_at", "frame_bytes", "at", "record_bytes"])

    return written(with_winners(pages, least_bytes).mapInArrow(run, INDEX), "warc-index")


_ROWS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
_KINDS = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]


def _row(record: bytes, where: str) -> tuple:
    """What one record says, in the order of _ROWS; a response's payload must have its digest."""
    fields, payload = parse_record(record)
    revisit = fields["WARC-Type"] == "revisit"
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if not revisit and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"damaged record in {where}")
    number = lambda k: int(fields[k]) if fields.get(k) else None
    return number("X-Page-Id"), fields["WARC-Target-URI"], number("X-Payload-Length"), digest, fields["WARC-Type"], number("X-Refers-To-Page-Id"), None if revisit else payload


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _KINDS, strict=True)], [f.split()[0] for f in _ROWS.split(", ")])


def _frame(bundle: str, at: int, size: int) -> bytes:
    fs, name = open_fs(bundle)
    with fs.open_input_file(name) as f:
        f.seek(at)
        return zstandard.ZstdDecompressor().decompress(f.read(size))


def read_bundles(index: DataFrame) -> DataFrame:
    """Every record of the indexed bundles again, frame by frame as their seek tables say: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload (null for revisits)."""

    def frames(batches):
        for b in batches:
            for bundle in b.column(0).to_pylist():
                fs, name = open_fs(bundle)
                with fs.open_input_file(name) as f:
                    at, size, _ = zip(*seek_table(f), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([bundle] * len(at)), pa.array(at, pa.int64()), pa.array(size, pa.int64())], ["bundle", "frame_at", "frame_bytes"])

    def run(batches):
        for b in batches:
            for bundle, at, size in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                raw, rows, begin = _frame(bundle, at, size), [], 0
                while begin < len(raw):
                    head_end = raw.index(b"\r\n\r\n", begin)
                    end = head_end + 8 + int(raw[begin:head_end].rsplit(b"Content-Length: ", 1)[1])
                    rows.append(_row(raw[begin:end], f"{bundle} at {at}"))
                    begin = end
                yield _batch(rows)

    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # the count is given, so that frames aren't gathered in few tasks
    found = index.select("bundle").distinct().repartition(parts, "bundle").mapInArrow(frames, "bundle string, frame_at long, frame_bytes long")
    return found.repartition(parts, "bundle", "frame_at").mapInArrow(run, _ROWS)


def read_records(index: DataFrame) -> DataFrame:
    """The records of the index rows alone: each frame is decompressed once, and only the bytes at the records' offsets are parsed."""

    def run(batches):
        for b in batches:
            for bundle, at, size, places in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                raw = _frame(bundle, at, size)
                yield _batch([_row(raw[p["at"] : p["at"] + p["record_bytes"]], f"{bundle} at {at}") for p in places])

    # a frame holds some FRAME bytes of records, so its list of places is bounded
    frames = index.groupBy("bundle", "frame_at", "frame_bytes").agg(F.collect_list(F.struct("at", "record_bytes")).alias("places"))
    return frames.mapInArrow(run, _ROWS)


def read_record(index: DataFrame, page_id: int) -> DataFrame:
    """One page's records: of all bundles only their frames are read, and of these only the records."""
    return read_records(index.where(F.col("page_id") == page_id))
