import hashlib
import zlib

import pytest

from lodestone.llm import ogg


def slow_checksum(page):
    crc = 0
    for byte in page:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1) ^ (0x04C11DB7 if crc & 0x80000000 else 0)
            crc &= 0xFFFFFFFF
    return crc


def test_checksum():
    for data in (b"", b"123456789", bytes(range(256)) * 3):
        assert ogg.checksum(data) == slow_checksum(data)


@pytest.mark.parametrize("size", [1, 254, 255, 256, 510, 255 * 255 - 1, 255 * 255, 255 * 255 + 1, 200_000])
def test_packets_over_pages(size):
    packets = [(b"head", 0), (bytes(i % 251 for i in range(size)), 7), (b"", 9), (b"xyz", 11)]
    found = ogg.demux(b"".join(ogg.pages(5, packets)))
    assert found.streams[5].packets == [p for p, _ in packets] and found.bad_pages == 0 and found.streams[5].ended
    assert found.streams[5].times[-1] == 11 / ogg.RATE


def test_round_trip_and_streams():
    for text in ("", "a", "é" * 96, "long " * 60_000):
        n, payload = ogg.payload_of(text)
        assert n == len(text.encode()) and len(payload) % 192 == 0 and payload.rstrip(b" ") == text.encode().rstrip(b" ")
        found = ogg.demux(ogg.encode(payload, b"note"))
        assert ogg.samples(found) == payload and found.streams[ogg.TEXT_SERIAL].packets[1] == b"note"
        assert found.streams[ogg.DATA_SERIAL].granule == len(payload)


def test_broken_pages_are_counted():
    stored = bytearray(ogg.encode(b"x" * 150_000))
    whole = ogg.demux(bytes(stored))
    stored[70_000] ^= 1
    found = ogg.demux(b"junk" + bytes(stored))
    assert found.bad_pages == 1 and found.streams[1].lost == 1
    assert len(found.streams[1].packets) < len(whole.streams[1].packets)
    assert ogg.demux(bytes(stored[:60_000])).bad_pages == 1


def test_tables(spark):
    rows = [(1, "Hello"), (2, None), (3, ""), (None, "z" * 100_000), (1, "Hello")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as media", "2 as n_bytes")
    got = ogg.digests(ogg.media(docs)).collect()
    assert len(got) == 5
    for r in got:
        text = {1: "Hello", 2: "", 3: "", None: "z" * 100_000}[r["doc_id"]].encode()
        payload = text.ljust(max(1, -(-len(text) // 192)) * 192, b" ")
        assert (r["n_bytes"], r["payload_bytes"]) == (len(text), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-16:])
        assert r["media_bytes"] > len(payload) and r["bad_pages"] == 0 and r["seconds"] == len(payload) / ogg.RATE
    same = {(r["media_sha256"], r["feature"]) for r in got if r["doc_id"] == 1}
    assert len(same) == 1
    parts = ogg.packets(ogg.media(docs).where("doc_id is null")).where("serial = 1").orderBy("packet").collect()
    assert b"".join(bytes(p["data"]) for p in parts[1:]).rstrip() == b"z" * 100_000
    assert ogg.digests(ogg.media(docs.limit(0))).count() == 0


def test_a_missing_page_is_seen():
    """Five pages of whole packets less one: neither checksums nor packets tell, page numbers do."""
    packets = [(ogg.DATA_HEAD.pack(ogg.DATA_MAGIC, 1, 1, ogg.RATE, 8), 0)] + [(bytes([i % 256]) * 254, 254 * (i + 1)) for i in range(1020)]
    pages = ogg.pages(1, packets)
    assert len(pages) == 5 and ogg.demux(b"".join(pages)).streams[1].whole
    for gone in range(5):
        found = ogg.demux(b"".join(p for i, p in enumerate(pages) if i != gone))
        assert found.bad_pages == 0 and found.streams[1].missing == 1 and not found.streams[1].whole


def test_every_packet_has_its_time():
    sizes = [10, 300, 254, 1, 700]
    ends = [sum(sizes[: i + 1]) for i in range(5)]
    packets = [(ogg.DATA_HEAD.pack(ogg.DATA_MAGIC, 1, 1, ogg.RATE, 8), 0)] + [(b"s" * n, e) for n, e in zip(sizes, ends)]
    found = ogg.demux(b"".join(ogg.pages(1, packets))).streams[1]
    assert found.times[1:] == [e / ogg.RATE for e in ends]


def test_damaged_rows_do_not_stop_the_others(spark):
    good = ogg.encode(b"x" * 192)
    rows = [(1, 192, bytearray(good)), (2, 192, bytearray(good[:40])), (3, 0, bytearray(b"no ogg at all"))]
    got = {r["doc_id"]: r for r in ogg.digests(spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary")).collect()}
    assert got[1]["whole"] and not got[2]["whole"] and not got[3]["whole"] and got[3]["payload_bytes"] == 0
