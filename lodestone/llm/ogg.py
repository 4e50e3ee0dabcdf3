"""Ogg media columns: pages, packets, logical streams and timestamps.

The container is written and read here. A payload of 8-bit mono samples is
packed into packets of one logical stream; a second stream describes it, and
pages of both are multiplexed. The reader verifies each page's checksum, puts
packets together from lacing values (over page borders), separates streams by
serial number and derives times from granule positions.

Defined results: a null text is the empty one, whose payload is one block of
blanks. Pages with a wrong checksum or a cut end are counted (bad) and skipped;
what precedes and follows them is still read, and a packet that lost a part is
dropped and counted (lost). Every page number of a stream is looked at: pages
that are not there, also those after the last one read, are counted (missing).
The payload of a file with any such fault is what could be read, and `whole` is
false for it.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from lodestone.llm.common import map_column, ship_package

BLOCK = 192
RATE = 8000
PACKET = 48_000  # samples: six seconds; a long payload's packets lie over page borders
PAGE_SEGMENTS = 255
DATA_SERIAL, TEXT_SERIAL = 1, 2
CONTINUED, FIRST, LAST = 1, 2, 4
NO_GRANULE = -1
DATA_HEAD = struct.Struct("<8sBBIH")  # magic, version, channels, rate, bits
TEXT_HEAD = struct.Struct("<8sB")
DATA_MAGIC, TEXT_MAGIC = b"pcm8mono", b"describe"
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))
_HEAD = struct.Struct("<4sBBqIIIB")


def checksum(page: bytes) -> int:
    """The page CRC: polynomial 04C11DB7, most significant bit first, from zero.

    zlib's CRC has the same polynomial with bits reversed, so it runs over
    bytes with reversed bits, starting at state zero.
    """
    state = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(state.to_bytes(4, "little").translate(_REVERSED), "big")


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = _HEAD.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    whole = head + body
    return whole[:22] + checksum(whole).to_bytes(4, "little") + whole[26:]


def pages(serial: int, packets: list[tuple[bytes, int]]) -> list[bytes]:
    """Pages of one logical stream; each packet comes with the granule position at its end.

    The first packet has a page of its own, as stream headers must.
    """
    made: list[tuple[int, int, bytes, bytes]] = []
    lacing, body, granule, begun = bytearray(), bytearray(), NO_GRANULE, False

    def close(continued: bool) -> None:
        nonlocal lacing, body, granule, begun
        if lacing:
            made.append((CONTINUED * begun, granule, bytes(lacing), bytes(body)))
        lacing, body, granule, begun = bytearray(), bytearray(), NO_GRANULE, continued

    for i, (packet, end) in enumerate(packets):
        values = b"\xff" * (len(packet) // 255) + bytes([len(packet) % 255])
        at = 0
        while at < len(values):
            take = values[at : at + PAGE_SEGMENTS - len(lacing)]
            body += packet[at * 255 : (at + len(take)) * 255]
            lacing += take
            at += len(take)
            if at == len(values):
                granule = end
            if len(lacing) == PAGE_SEGMENTS:
                close(at < len(values))
        if i == 0:
            close(False)
    close(False)
    last = len(made) - 1
    return [
        _page(flags | FIRST * (i == 0) | LAST * (i == last), granule, serial, i, lacing, body)
        for i, (flags, granule, lacing, body) in enumerate(made)
    ]


def mux(streams: list[list[bytes]]) -> bytes:
    """One physical stream: the first pages first, then pages in turn."""
    out = [s[0] for s in streams]
    for i in range(1, max(map(len, streams))):
        out += [s[i] for s in streams if i < len(s)]
    return b"".join(out)


def encode(payload: bytes, comment: bytes = b"") -> bytes:
    """A payload of 8-bit samples as an Ogg file."""
    data = [(DATA_HEAD.pack(DATA_MAGIC, 1, 1, RATE, 8), 0)]
    data += [(payload[i : i + PACKET], min(i + PACKET, len(payload))) for i in range(0, len(payload), PACKET)]
    text = [(TEXT_HEAD.pack(TEXT_MAGIC, 1), 0), (comment, 0)]
    return mux([pages(DATA_SERIAL, data), pages(TEXT_SERIAL, text)])


@dataclass
class Stream:
    packets: list[bytes] = field(default_factory=list)
    times: list[float | None] = field(default_factory=list)
    granule: int = 0
    pages: int = 0
    lost: int = 0
    part: bytearray | None = None
    next_page: int = 0
    missing: int = 0
    ended: bool = False

    @property
    def whole(self) -> bool:
        """Whether no page and no packet is missing."""
        return self.ended and not self.missing and not self.lost


@dataclass
class Decoded:
    streams: dict[int, Stream] = field(default_factory=dict)
    bad_pages: int = 0


def demux(stored: bytes, rate: int = RATE) -> Decoded:
    """Every logical stream's packets, with the end time of each packet that ends a page.

    In a stream of samples a packet's length tells its time, so the times of
    the other packets follow from the granule position of their page.
    """
    out, at = Decoded(), 0
    while (at := stored.find(b"OggS", at)) >= 0:
        if at + 27 > len(stored):
            out.bad_pages += 1
            break
        _, version, flags, granule, serial, number, crc, n = _HEAD.unpack_from(stored, at)
        lacing = stored[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lacing)
        whole = stored[at:end]
        if version or len(lacing) < n or end > len(stored) or checksum(whole[:22] + b"\0\0\0\0" + whole[26:]) != crc:
            out.bad_pages += 1
            at += 4
            continue
        s = out.streams.setdefault(serial, Stream())
        s.pages += 1
        s.missing += max(0, number - s.next_page)
        if s.part is not None and (number != s.next_page or not flags & CONTINUED):
            s.part, s.lost = None, s.lost + 1
        skip = bool(flags & CONTINUED) and s.part is None
        s.next_page, pos, complete = number + 1, at + 27 + n, 0
        part = s.part if s.part is not None else bytearray()
        s.part = None
        for i, value in enumerate(lacing):
            part += stored[pos : pos + value]
            pos += value
            if value < 255:
                if not skip:
                    s.packets.append(bytes(part))
                    s.times.append(None)
                    complete += 1
                part, skip = bytearray(), False
            elif i == n - 1:
                s.part = None if skip else part
        if complete and granule >= 0:
            s.granule = granule
            s.times[-1] = granule / rate
            if s.packets[0][:8] == DATA_MAGIC:
                for i in range(len(s.packets) - 2, max(0, len(s.packets) - 1 - complete), -1):
                    granule -= len(s.packets[i + 1])
                    s.times[i] = granule / rate
        s.ended |= bool(flags & LAST)
        at = end
    for s in out.streams.values():
        if s.part is not None:
            s.lost += 1
        if not s.ended:
            s.missing += 1  # at least one
    return out


def samples(found: Decoded) -> bytes:
    """The samples of the stream whose header says that it holds them."""
    for s in found.streams.values():
        if s.packets and s.packets[0][:8] == DATA_MAGIC:
            return b"".join(s.packets[1:])
    return b""


def describe(found: Decoded) -> str:
    """Features of the samples and of the container, as text."""
    data = next((s for s in found.streams.values() if s.packets and s.packets[0][:8] == DATA_MAGIC), Stream())
    x = np.frombuffer(b"".join(data.packets[1:]), np.uint8)
    if not len(x):
        return f"streams={len(found.streams)};pages={data.pages};packets=0;bad={found.bad_pages};seconds=0.000000"
    centred = x.astype(np.int16) - 128
    crossings = int(np.count_nonzero((centred[1:] < 0) != (centred[:-1] < 0)))
    total = int(x.sum(dtype=np.int64))
    square = int((centred.astype(np.int32) ** 2).sum(dtype=np.int64))
    ends = ",".join(f"{t:.3f}" for t in data.times[1:] if t is not None)
    return (
        f"streams={len(found.streams)};pages={data.pages};packets={len(data.packets) - 1};bad={found.bad_pages};"
        f"lost={data.lost};missing={data.missing};seconds={data.granule / RATE:.6f};mean={total / len(x):.6f};"
        f"rms={(square / len(x)) ** 0.5:.6f};crossings={crossings};"
        f"ends_sha1={hashlib.sha1(ends.encode()).hexdigest()}"
    )


def payload_of(text: str | None) -> tuple[int, bytes]:
    """UTF-8 bytes and the payload: filled with blanks to a positive multiple of 192."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw.ljust(max(1, -(-len(raw) // BLOCK)) * BLOCK, b" ")


def media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the Ogg file of every text."""

    def start():
        def work(texts: list[str | None]) -> list[list]:
            made = [payload_of(t) for t in texts]
            return [[n for n, _ in made], [encode(p, f"n_bytes={n}".encode()) for n, p in made]]

        return work

    return map_column(docs, "text", ["doc_id"], "n_bytes long, media binary", start)


DIGEST = (
    "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, "
    "feature string, seconds double, bad_pages int, whole boolean"
)


def digests(files: DataFrame) -> DataFrame:
    """Read Ogg files back: digests of the samples, features and the end time of each row's media."""

    def start():
        def one(stored: bytes) -> tuple:
            found = demux(stored)
            payload = samples(found)
            seconds = found.streams[DATA_SERIAL].granule / RATE if DATA_SERIAL in found.streams else 0.0
            return (
                len(payload),
                hashlib.sha256(payload).hexdigest(),
                zlib.crc32(payload[-16:]),
                len(stored),
                hashlib.sha256(stored).hexdigest(),
                describe(found),
                seconds,
                found.bad_pages,
                len(found.streams) == 2 and all(s.whole for s in found.streams.values()),
            )

        return lambda files: [list(c) for c in zip(*map(one, files))] or [[]] * 9

    return map_column(files, "media", ["doc_id", "n_bytes"], DIGEST, start)


def packets(files: DataFrame) -> DataFrame:
    """One row for each packet of each logical stream: serial, number, end time (if known) and bytes."""

    ship_package(files.sparkSession)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc_id, stored in zip(batch["doc_id"], batch["media"]):
                found = [
                    (doc_id, serial, i, t, p)
                    for serial, s in sorted(demux(stored).streams.items())
                    for i, (t, p) in enumerate(zip(s.times, s.packets))
                ]
                yield pd.DataFrame(found, columns=["doc_id", "serial", "packet", "end_s", "data"])

    return files.select("doc_id", "media").mapInPandas(
        rows, "doc_id long, serial long, packet int, end_s double, data binary"
    )
