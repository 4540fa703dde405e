"""Media columns: ISO base media files in a binary column.

``wrap`` stores a payload as raw 8-bit grey frames of 8 x 8 pixels in one video track;
``probe`` walks the nested boxes of such a column, decodes the sample tables and gives
codec, duration and key-frame byte ranges without looking at the frames.  One row is
one file; both run batch by batch inside tasks, without a shuffle.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemspark.llm.registry import query, table
from itemspark.llm.tasks import releasing, values

FRAME = 64                  # bytes of a frame: 8 x 8 samples of 8 bits
FRAMES_PER_CHUNK = 64
KEY_INTERVAL = 16           # every so many frames one is marked as a key frame
FRAME_RATE = 25

#: Boxes that only hold other boxes.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"dinf", b"stbl", b"udta"}

MATRIX = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def numbers(values, width: str = ">u4") -> bytes:
    return np.asarray(values, dtype=width).tobytes()


def mux(payload: bytes) -> bytes:
    """An ISO media file that holds ``payload`` padded with zeros to whole frames."""
    length = len(payload)
    payload += bytes(-length % FRAME or (FRAME if not length else 0))
    n = len(payload) // FRAME
    head = box(b"ftyp", b"isom", struct.pack(">I", 0x200), b"isomiso2mp41")
    data = box(b"mdat", payload)
    chunk_at = np.arange(0, n, FRAMES_PER_CHUNK) * FRAME + len(head) + len(data) - len(payload)
    whole, rest = divmod(n, FRAMES_PER_CHUNK)
    runs = ([(1, FRAMES_PER_CHUNK, 1)] if whole else []) + ([(whole + 1, rest, 1)] if rest else [])
    keys = np.arange(1, n + 1, KEY_INTERVAL)
    wide = len(head) + len(data) >= 1 << 32
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", 8, 8, 0x480000, 0x480000, 0, 1),
                bytes(32), struct.pack(">Hh", 40, -1))
    stbl = box(b"stbl", full(b"stsd", struct.pack(">I", 1), entry),
               full(b"stts", struct.pack(">III", 1, n, 1)),
               full(b"stss", struct.pack(">I", len(keys)), numbers(keys)),
               full(b"stsc", struct.pack(">I", len(runs)), numbers(runs)),
               full(b"stsz", struct.pack(">II", FRAME, n)),
               full(b"co64" if wide else b"stco", struct.pack(">I", len(chunk_at)), numbers(chunk_at, ">u8" if wide else ">u4")))
    minf = box(b"minf", full(b"vmhd", bytes(8), flags=1),
               box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), stbl)
    mdia = box(b"mdia", full(b"mdhd", struct.pack(">QQIQHH", 0, 0, FRAME_RATE, n, 0x55C4, 0), version=1),
               full(b"hdlr", bytes(4), b"vide", bytes(12), b"frames\0"), minf)
    trak = box(b"trak", full(b"tkhd", struct.pack(">QQIIQ8xhhhH", 0, 0, 1, 0, n, 0, 0, 0, 0), MATRIX,
                             struct.pack(">II", 8 << 16, 8 << 16), version=1, flags=7), mdia)
    moov = box(b"moov", full(b"mvhd", struct.pack(">QQIQIH10x", 0, 0, FRAME_RATE, n, 0x10000, 0x100), MATRIX,
                             bytes(24), struct.pack(">I", 2), version=1), trak,
               box(b"udta", box(b"tlen", struct.pack(">Q", length))))
    return head + data + moov


def boxes(data, start: int = 0, end: int | None = None, path: tuple = ()):
    """(path, body start, body end) of every box, parents before children; stops at a
    box whose size does not fit its parent."""
    end = len(data) if end is None else end
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1 and start + 16 <= end:
            size, body = struct.unpack_from(">Q", data, body)[0], start + 16
        elif size == 0:
            size = end - start
        if size < body - start or start + size > end:
            return
        yield (*path, kind), body, start + size
        if kind in CONTAINERS:
            yield from boxes(data, body, start + size, (*path, kind))
        start += size


class Track:
    """The decoded tables of a file's first track; ``None`` from ``read`` if it has none."""

    def __init__(self, data, tables: dict):
        def rows(name: bytes, at: int, kind: str) -> np.ndarray:
            start, end = tables.get(name, (0, 0))
            if end - start < at + 4:
                return np.zeros(0, "i8")
            count = struct.unpack_from(">I", data, start + at)[0]
            wide = np.dtype(kind).itemsize
            return np.frombuffer(data, kind, min(count, (end - start - at - 4) // wide), start + at + 4)

        start, _ = tables[b"mdhd"]
        long = data[start]
        self.timescale = struct.unpack_from(">I", data, start + (20 if long else 12))[0]
        self.duration = struct.unpack_from(">Q" if long else ">I", data, start + (24 if long else 16))[0]
        self.codec = bytes(data[tables[b"stsd"][0] + 12:tables[b"stsd"][0] + 16]).decode("latin-1")
        start, _ = tables[b"stsz"]
        size, count = struct.unpack_from(">II", data, start + 4)
        sizes = np.full(count, size, "i8") if size else rows(b"stsz", 8, ">u4").astype("i8")
        chunks = (rows(b"co64", 4, ">u8") if b"co64" in tables else rows(b"stco", 4, ">u4")).astype("i8")
        runs = rows(b"stsc", 4, np.dtype((">u4", (3,)))).reshape(-1, 3).astype("i8")
        until = np.append(runs[1:, 0], len(chunks) + 1)
        per_chunk = np.repeat(runs[:, 1], np.maximum(until - runs[:, 0], 0))[:len(chunks)]
        chunk = np.repeat(np.arange(len(per_chunk)), per_chunk)[:count]
        sizes = sizes[:len(chunk)]
        before = np.cumsum(sizes) - sizes
        first = np.searchsorted(chunk, chunk, side="left")
        self.starts = chunks[chunk] + before - before[first]
        self.ends = self.starts + sizes
        sync = rows(b"stss", 4, ">u4").astype("i8") - 1
        self.keys = sync[(sync >= 0) & (sync < len(sizes))] if b"stss" in tables else np.arange(len(sizes))

    def payload(self, data) -> bytes:
        """The samples in order; neighbours are read in one piece."""
        if not len(self.starts):
            return b""
        breaks = np.flatnonzero(self.starts[1:] != self.ends[:-1])
        return b"".join(bytes(data[a:b]) for a, b in
                        zip(self.starts[np.append(0, breaks + 1)], self.ends[np.append(breaks, len(self.ends) - 1)]))


def read(data) -> tuple[Track | None, int | None]:
    """The first track and the stored text length, as far as the boxes give them."""
    tables, length, tracks = {}, None, 0
    for path, start, end in boxes(data):
        tracks += path[-1] == b"trak"
        if path == (b"moov", b"udta", b"tlen"):
            length = struct.unpack_from(">Q", data, start)[0]
        elif path[:2] == (b"moov", b"trak") and tracks == 1:
            tables.setdefault(path[-1], (start, end))
    whole = {b"mdhd", b"stsd", b"stsz", b"stsc"} <= set(tables) and (b"stco" in tables or b"co64" in tables)
    return (Track(data, tables) if whole else None), length


def wrap(docs: DataFrame, text: str = "text") -> DataFrame:
    """Replace ``text`` by ``media``: its UTF-8 bytes as an ISO media file.

    Other columns stay, also one named ``media`` is replaced.  Null text: the file of
    the empty text (one zero frame).  Equal texts give equal files.
    """
    rest = [c for c in docs.columns if c not in (text, "media")]
    stored = docs.select(*rest, F.coalesce(F.col(text), F.lit("")).cast("binary").alias("media"))

    def run(batches):
        for batch in batches:
            media = pa.array([mux(x) for x in values(batch.column("media"))], pa.binary())
            yield pa.record_batch([*batch.columns[:-1], media], names=batch.schema.names)

    return stored.mapInArrow(releasing(run), stored.schema)


PROBED = ("codec string, timescale long, duration long, n_samples long, stored_length long, "
          "key_ranges array<struct<start: long, end: long>>, payload binary, media_bytes long, media_sha256 string")


def probe(files: DataFrame, payload: bool = False) -> DataFrame:
    """Add what the boxes of column ``media`` say; ``media`` itself goes.

    Columns of ``PROBED`` replace input columns of those names.  ``payload`` holds the
    stored samples only if asked for.  Null or unreadable media: null fields.
    """
    names = ["codec", "timescale", "duration", "n_samples", "stored_length", "key_ranges", "payload", "media_bytes", "media_sha256"]
    rest = [c for c in files.columns if c not in (*names, "media")]
    ranges = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), ranges, pa.binary(), pa.int64(), pa.string()]

    def facts(data: bytes | None) -> tuple:
        if data is None:
            return (None,) * len(names)
        track, length = read(data)
        own = (len(data), hashlib.sha256(data).hexdigest())
        if track is None:
            return (None,) * 7 + own
        keys = [{"start": a, "end": b} for a, b in zip(track.starts[track.keys].tolist(), track.ends[track.keys].tolist())]
        return (track.codec, track.timescale, track.duration, len(track.starts), length, keys,
                track.payload(data) if payload else None, *own)

    def run(batches):
        for batch in batches:
            rows = [facts(x) for x in values(batch.column("media"))]
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.record_batch([*batch.columns[:-1], *columns], names=[*rest, *names])

    shape = files.select(*rest, F.col("media"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in shape.drop("media").schema), PROBED])
    return shape.mapInArrow(releasing(run), schema)


def tail_crc32(payload: DataFrame) -> DataFrame:
    return payload.withColumn("tail_crc32", F.crc32(F.expr("substring(payload, -64, 64)")))


@query("op7_media")
def op7_media(spark, folder) -> DataFrame:
    """All documents stored as media files, read back by their sample tables."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = tail_crc32(probe(wrap(docs), payload=True))
    first, last = F.element_at("key_ranges", 1), F.element_at("key_ranges", -1)
    feature = F.concat_ws(";", F.concat(F.lit("codec="), F.trim("codec")),
                          F.concat(F.lit("seconds="), F.format_string("%.2f", F.col("duration") / F.col("timescale"))),
                          F.concat(F.lit("frames="), F.col("n_samples")),
                          F.concat(F.lit("keys="), F.size("key_ranges")),
                          F.concat(F.lit("first="), first["start"], F.lit("-"), first["end"]),
                          F.concat(F.lit("last="), last["start"], F.lit("-"), last["end"]))
    return found.select("doc_id", F.col("stored_length").alias("n_bytes"),
                        F.octet_length("payload").cast("long").alias("payload_bytes"),
                        F.sha2("payload", 256).alias("payload_sha256"), "tail_crc32",
                        "media_bytes", "media_sha256", feature.alias("feature"))
