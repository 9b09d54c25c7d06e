"""Ogg columns: payloads as Ogg files, and back with every page verified.

Writing: a payload of 8-bit samples becomes packets of one logical stream, beside a second logical stream with
a packet of text about it; pages carry lacing values, granule positions and checksums. Reading: page checksums
are verified, pages dealt to their logical streams by serial number, packets put together from lacing values
across pages, and timestamps derived from granule positions.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenframe.llm.shared import tidy

RATE = 8_000
PACKET = 4_096
MAGIC = b"PCM8\x00\x00\x00\x01"
UNIT = 64
AUDIO, NOTES = 1, 2
_HEAD = struct.Struct("<4sBBqIIIB")
_CONTINUED, _FIRST, _LAST = 1, 2, 4
_MIRROR = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def page_checksum(page: bytes) -> int:
    """CRC-32 of polynomial 04c11db7, most significant bit first, from 0 and not inverted.

    It equals the mirrored bits of the common reflected CRC of the mirrored bytes.
    """
    crc = zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "big").translate(_MIRROR), "little")


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = _HEAD.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    crc = page_checksum(head + body)
    return head[:22] + crc.to_bytes(4, "little") + head[26:] + body


def pages_of(packets: list[tuple[bytes, int]], serial: int) -> list[bytes]:
    """Pages of one logical stream: its packets with the granule position that each ends at.

    The first packet has a page of its own. A page has the position of the last packet that ends on it,
    or -1 if none does.
    """
    out: list[bytes] = []
    lacing, body, granule, continued = bytearray(), bytearray(), -1, False

    def flush(last: bool = False, open_packet: bool = False):
        nonlocal lacing, body, granule, continued
        flags = _CONTINUED * continued | _FIRST * (not out) | _LAST * last
        out.append(_page(flags, granule, serial, len(out), bytes(lacing), bytes(body)))
        lacing, body, granule, continued = bytearray(), bytearray(), -1, open_packet

    for i, (packet, end) in enumerate(packets):
        laces = [255] * (len(packet) // 255) + [len(packet) % 255]
        at = 0
        for k, lace in enumerate(laces):
            if len(lacing) == 255:
                flush(open_packet=k > 0)
            lacing.append(lace)
            body += packet[at : at + lace]
            at += lace
        granule = end
        if i == 0 and len(packets) > 1:
            flush()
    flush(last=True)
    return out


def write(payload: bytes, note: str = "") -> bytes:
    """An Ogg file with the payload as 8-bit samples and the note; the streams' first pages come first."""
    head = MAGIC + struct.pack("<IQ", RATE, len(payload))
    cuts = range(0, len(payload), PACKET)
    audio = pages_of([(head, 0), *((payload[i : i + PACKET], min(len(payload), i + PACKET)) for i in cuts)], AUDIO)
    notes = pages_of([(b"NOTE\x00\x00\x00\x01", 0), (note.encode(), 0)], NOTES)
    return b"".join([audio[0], notes[0], notes[1], *audio[1:]])


class OggError(ValueError):
    """A page that is cut short, out of order, or has another checksum than it says."""


@dataclass
class Stream:
    serial: int
    pages: int = 0
    packets: list[bytes] = field(default_factory=list)
    #: granule position of the page on which each packet ends, for the last packet of the page; else -1
    ends: list[int] = field(default_factory=list)
    closed: bool = False
    _open: bytearray | None = None

    def seconds(self, rate: int = RATE) -> list[float | None]:
        """End time of each packet, where its page tells one."""
        return [e / rate if e >= 0 else None for e in self.ends]


def read(data: bytes) -> dict[int, Stream]:
    """Logical streams by serial number; raises OggError on damage, missing pages and packets left open."""
    streams: dict[int, Stream] = {}
    at = 0
    while at < len(data):
        if len(data) < at + 27 or data[at : at + 4] != b"OggS":
            raise OggError(f"no page at byte {at}")
        _, version, flags, granule, serial, number, crc, count = _HEAD.unpack_from(data, at)
        lacing = data[at + 27 : at + 27 + count]
        start = at + 27 + count
        end = start + sum(lacing)
        if version or len(lacing) < count or len(data) < end:
            raise OggError(f"the page at byte {at} is cut short")
        if page_checksum(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != crc:
            raise OggError(f"the page at byte {at} has another checksum")
        if (serial not in streams) != bool(flags & _FIRST):
            raise OggError(f"stream {serial} starts at a page that is not its first")
        stream = streams.setdefault(serial, Stream(serial))
        if number != stream.pages or stream.closed or bool(flags & _CONTINUED) != (stream._open is not None):
            raise OggError(f"stream {serial}: page {number} does not follow page {stream.pages - 1}")
        stream.pages += 1
        packet, done = stream._open if stream._open is not None else bytearray(), 0
        stream._open = None
        for lace in lacing:
            packet += data[start : start + lace]
            start += lace
            if lace < 255:
                stream.packets.append(bytes(packet))
                stream.ends.append(-1)
                packet, done = bytearray(), done + 1
        if lacing and lacing[-1] == 255:
            stream._open = packet
        if done:
            stream.ends[-1] = granule
        stream.closed = bool(flags & _LAST)
        at = end
    for stream in streams.values():
        if stream._open is not None or not stream.closed:
            raise OggError(f"stream {stream.serial} has no end")
    return streams


def samples(streams: dict[int, Stream]) -> bytes:
    """The payload of a file that `write` made."""
    head, *rest = streams[AUDIO].packets
    payload = b"".join(rest)
    rate, n = struct.unpack("<IQ", head[len(MAGIC) :])
    if not head.startswith(MAGIC) or n != len(payload) or rate != RATE:
        raise OggError("the header packet does not fit the samples")
    return payload


def features(streams: dict[int, Stream], payload: bytes) -> str:
    """Streams, pages, packets, duration, and mean, root mean square and zero crossings of the samples about 128."""
    audio = streams[AUDIO]
    x = np.frombuffer(payload, np.uint8).astype(np.int16) - 128
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    rms = float(np.sqrt(np.mean(x.astype(np.float64) ** 2)))
    pages = sum(s.pages for s in streams.values())
    return f"streams={len(streams)};pages={pages};packets={len(audio.packets)};seconds={audio.seconds()[-1]:.6f};mean={x.mean():.6f};rms={rms:.6f};crossings={crossings}"


def padded(text: str | None) -> tuple[int, bytes]:
    """Length of the text in UTF-8, and those bytes with bytes 0 up to a positive multiple of 64."""
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""
    return len(raw), raw + bytes(-len(raw) % UNIT if raw else UNIT)


_REPORT = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def stored(text: str | Column = "text") -> Column:
    """Binary column with the Ogg file of each text; null texts are stored as empty ones."""

    @F.pandas_udf("binary")
    def to_ogg(texts: pd.Series) -> pd.Series:
        return pd.Series([write(payload, f"bytes={n}") for n, payload in map(padded, texts)], dtype=object)

    return to_ogg(F.col(text) if isinstance(text, str) else text)


def inspected(media: str | Column) -> Column:
    """Struct column about an Ogg file that `stored` made, read back from its bytes; damage raises OggError."""

    @F.pandas_udf(_REPORT)
    @tidy
    def look(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in _REPORT.split(", ")]
        for batch in batches:
            rows = []
            for data in batch:
                data = bytes(data)
                streams = read(data)
                payload = samples(streams)
                n = int(streams[NOTES].packets[1].removeprefix(b"bytes="))
                rows.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), features(streams, payload)))
            yield pd.DataFrame(rows, columns=names)

    return look(F.col(media) if isinstance(media, str) else media)
