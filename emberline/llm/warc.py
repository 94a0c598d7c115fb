"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent Zstandard frames; the bundle ends in a
skippable frame that holds the seek table (compressed and decompressed size of
each frame). An index table maps each record id to its bundle, frame and offset
within the decompressed frame, so a reader fetches and decompresses only the
frames it needs.

Defined results: null html is an empty payload; empty payloads are equal like
any others; a null url is written as `about:blank`; control characters in urls
are percent-encoded; rows that repeat a page_id with an equal payload all take
that page's record type; a very long payload is a frame of its own; other columns
of the input are not read; an empty table writes no bundle. page_id is an integer.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import filter_of
from .common import open_fs, partitions, shared_dir, text_or_empty, written

# Fixed values of the seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
FOOTER = struct.Struct("<IBI")
ENTRY = struct.Struct("<II")
HEAD = struct.Struct("<II")

FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 64 << 20
INDEX = "record_id long, bundle string, frame long, frame_at long, frame_size long, start long, length long"


class Bundle:
    """Writes frames to a stream and keeps the seek table."""

    def __init__(self, stream) -> None:
        self.stream, self.at, self.table, self.packer = stream, 0, [], zstandard.ZstdCompressor(level=3)

    def frame(self, raw: bytes) -> tuple[int, int, int]:
        """Number, place and compressed size of the new frame."""
        packed = self.packer.compress(raw)
        self.stream.write(packed)
        self.table.append((len(packed), len(raw)))
        at, self.at = self.at, self.at + len(packed)
        return len(self.table) - 1, at, len(packed)

    def close(self) -> None:
        body = b"".join(ENTRY.pack(*x) for x in self.table) + FOOTER.pack(len(self.table), 0, SEEKABLE_MAGIC)
        self.stream.write(HEAD.pack(SKIPPABLE_MAGIC, len(body)) + body)
        self.stream.close()


def seek_table(file) -> list[tuple[int, int, int]]:
    """(place, compressed size, decompressed size) of each frame, from the footer of an open bundle."""
    size = file.size()
    file.seek(size - FOOTER.size)
    frames, _, magic = FOOTER.unpack(file.read(FOOTER.size))
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table at the end of the bundle")
    file.seek(size - FOOTER.size - frames * ENTRY.size)
    out, at = [], 0
    for packed, raw in ENTRY.iter_unpack(file.read(frames * ENTRY.size)):
        out.append((at, packed, raw))
        at += packed
    return out


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _safe(url: str | None) -> str:
    return "".join(c if " " < c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "about:blank")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response record, or a revisit record without the payload."""
    kind = "response" if refers_to is None else "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Target-URI: {_safe(url)}", f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return ("\r\n".join([*head, f"Content-Length: {len(block)}"]) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Headers and payload of one record; the payload digest of a response is recomputed and compared."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b": ")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length"))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != size or base32_sha1(payload) != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']} does not match its digest")
    key = lambda name: fields.get(name, "").removeprefix("<urn:page:").removesuffix(">")
    return {"type": fields["WARC-Type"], "id": int(key("WARC-Record-ID")) if key("WARC-Record-ID") else None, "url": fields["WARC-Target-URI"], "digest": digest, "size": size, "refers_to": int(key("WARC-Refers-To")) if "WARC-Refers-To" in fields else None, "payload": payload}


def mark_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, html (no nulls), refers_to: the smallest page_id with an equal payload of at least min_bytes, null for that page itself.

    A filter over the digests of repeated payloads tells which pages have to meet
    another; the others stay where they are.
    """
    rows = pages.select("page_id", "url", text_or_empty("html").alias("html")).withColumn("__digest", F.sha2("html", 256))
    large = F.octet_length("html") >= min_bytes
    firsts = rows.filter(large).groupBy("__digest").agg(F.min("page_id").alias("__first"), F.count(F.lit(1)).alias("__n")).filter("__n > 1").drop("__n")
    firsts = written(firsts, "warc-firsts")  # both sides of the join are plain exchanges then, and AQE may split a payload that many pages share
    seen = filter_of(firsts.select(F.xxhash64("__digest")), firsts.count(), repeats=False)
    flagged = rows.withColumn("__maybe", seen.test(F.xxhash64("__digest")))
    joined = flagged.filter("__maybe").join(firsts, "__digest", "left")
    later = F.col("__first").isNotNull() & large & ~F.col("page_id").eqNullSafe(F.col("__first"))
    alone = flagged.filter("not __maybe").select("page_id", "url", "html", F.lit(None).cast(dict(rows.dtypes)["page_id"]).alias("refers_to"))
    return alone.unionByName(joined.select("page_id", "url", "html", F.when(later, F.col("__first")).alias("refers_to")))


def _write(folder: str, frame_bytes: int, bundle_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_fs(folder)
        part = TaskContext.get().partitionId()
        bundle, name, number, held, rows = None, "", 0, [], []

        def flush() -> list[tuple]:
            nonlocal held, rows
            if not held:
                return []
            frame, at, size = bundle.frame(b"".join(held))
            out, held, found = [(i, name, frame, at, size, s, n) for i, s, n in rows], [], None
            rows = []
            return out

        def close() -> None:
            nonlocal bundle
            bundle.close()
            store.move(f"{base}/.{name}", f"{base}/{name}")
            bundle = None

        total = 0
        for batch in batches:
            done: list[tuple] = []
            for page_id, url, html, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bundle is None:
                    name = f"part-{part:05d}-{number:04d}-{uuid.uuid4().hex[:12]}.warc.zst"
                    number += 1
                    bundle, total = Bundle(store.open_output_stream(f"{base}/.{name}", compression=None)), 0
                raw = record(page_id, url, html.encode(), refers)
                rows.append((page_id, total, len(raw)))
                held.append(raw)
                total += len(raw)
                if total >= frame_bytes:
                    done += flush()
                    total = 0
                    if bundle.at >= bundle_bytes:
                        close()
            if done:
                yield _index(done)
        if bundle is not None:
            last = flush()
            close()
            if last:
                yield _index(last)

    return run


def _index(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), *[pa.int64()] * 5)
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["record_id", "bundle", "frame", "frame_at", "frame_size", "start", "length"])


def write_warc(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> tuple[str, DataFrame]:
    """Write the pages as bundles; returns the folder and the index table (record_id, bundle, frame, frame_at, frame_size, start, length).

    A task writes to a hidden name and renames it when complete; a retried task
    makes new names and only the successful attempt's rows reach the index.
    """
    folder = folder or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    store, base = open_fs(folder)
    store.create_dir(base, recursive=True)
    index = mark_revisits(pages, min_bytes).mapInArrow(_write(folder, frame_bytes, bundle_bytes), INDEX)
    return folder, written(index, "warc-index")


RECORDS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long"


def _read(folder: str, with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_fs(folder)
        name, file, frame, raw = None, None, None, b""
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for bundle, number, at, size, start, length in zip(*(batch.column(c).to_pylist() for c in ("bundle", "frame", "frame_at", "frame_size", "start", "length")), strict=True):
                if bundle != name:
                    if file is not None:
                        file.close()
                    name, frame, file = bundle, None, store.open_input_file(f"{base}/{bundle}")
                    table = seek_table(file)
                if number != frame:
                    if table[number][:2] != (at, size):
                        raise ValueError(f"{bundle}: index and seek table differ at frame {number}")
                    file.seek(at)
                    raw, frame = unpack.decompress(file.read(size), max_output_size=table[number][2]), number
                x = parse(raw[start : start + length])
                out.append((x["id"], x["url"], x["type"], x["size"], x["digest"], x["refers_to"], *([x["payload"]] if with_payload else [])))
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
            names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
            cols = list(zip(*out, strict=True)) if out else [()] * (6 + with_payload)
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=False)], names[: 6 + with_payload])
        if file is not None:
            file.close()

    return run


def read_warc(folder: str, index: DataFrame, with_payload: bool = False) -> DataFrame:
    """The records that index names (all of it, or a filtered part: only the frames needed are read)."""
    places = index.repartition(partitions(index.sparkSession), "bundle", (F.col("frame") / 16).cast("long")).sortWithinPartitions("bundle", "frame", "start")
    return places.mapInArrow(_read(folder, with_payload), RECORDS + (", payload binary" if with_payload else ""))
