import hashlib
import struct
import zlib

import pytest

from itemspark.llm import media
from itemspark.llm.queries import QUERIES


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 64 * 16, 64 * 64, 64 * 64 * 3 + 5, 200_000])
def test_round_trip_and_key_ranges(n):
    text = bytes(i * 7 % 251 for i in range(n))
    data = media.mux(text)
    track, length = media.read(data)
    padded = text + bytes(-n % 64 or (0 if n else 64))
    assert length == n and track.payload(data) == padded
    assert (track.codec, track.timescale, track.duration) == ("raw ", 25, len(padded) // 64)
    frames = [padded[i:i + 64] for i in range(0, len(padded), 64)]
    for key in range(0, len(frames), media.KEY_INTERVAL):
        assert data[track.starts[key]:track.ends[key]] == frames[key]
    assert track.keys.tolist() == list(range(0, len(frames), media.KEY_INTERVAL))
    paths = [p for p, _, _ in media.boxes(data)]
    assert (b"moov", b"trak", b"mdia", b"minf", b"stbl", b"stsz") in paths


def test_other_layouts_and_damage():
    """Varying sample sizes, large sizes, unknown boxes, cut files."""
    payload = b"abcdefghij"
    stbl = media.box(b"stbl", media.full(b"stsd", struct.pack(">I", 1), media.box(b"mp4a", bytes(20))),
                     media.full(b"stsc", struct.pack(">I6I", 2, 1, 2, 1, 2, 1, 1)),
                     media.full(b"stsz", struct.pack(">II3I", 0, 3, 4, 3, 3)),
                     media.full(b"co64", struct.pack(">I2Q", 2, 8, 16)))
    mdhd = media.full(b"mdhd", struct.pack(">IIIIHH", 0, 0, 1000, 42, 0, 0))
    moov = media.box(b"moov", media.box(b"free", b"x"), media.box(b"trak", media.box(b"mdia", mdhd, media.box(b"minf", stbl))))
    data = media.box(b"mdat", payload[:7] + b"?" + payload[7:]) + moov
    track, length = media.read(data)
    assert length is None and (track.codec, track.duration) == ("mp4a", 42)
    assert track.payload(data) == payload and track.keys.tolist() == [0, 1, 2]
    large = struct.pack(">I4sQ", 1, b"free", 20) + b"1234" + data
    assert [p for p, _, _ in media.boxes(large)][:2] == [(b"free",), (b"mdat",)]
    assert media.read(data[:-30]) == (None, None) and media.read(b"junk") == (None, None)


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"].encode() for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = QUERIES["op7_media"](spark, folder).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        raw = texts[r["doc_id"]]
        padded = raw + bytes(-len(raw) % 64)
        stored = media.mux(raw)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (
            len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert f"frames={len(padded) // 64};" in r["feature"]


def test_nulls_clashing_columns_and_empty_table(spark):
    rows = [(1, None, "x", 5), (None, "", "y", 6), (3, "ab" * 50_000, None, None), (3, "ab" * 50_000, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, codec string, extra int")
    got = media.probe(media.wrap(docs), payload=True).collect()
    assert sorted(len(r["payload"]) for r in got) == [64, 64, 100_032, 100_032]
    assert {r["codec"] for r in got} == {"raw "} and sorted(str(r["extra"]) for r in got) == ["5", "6", "None", "None"]
    broken = spark.createDataFrame([(None,), (bytearray(b"junk"),)], "media binary")
    assert [r["codec"] for r in media.probe(broken).collect()] == [None, None]
    assert media.probe(media.wrap(docs.limit(0))).count() == 0
