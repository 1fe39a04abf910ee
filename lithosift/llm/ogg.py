"""Media columns: Ogg bitstreams as binary columns.

write() multiplexes two logical streams of unsigned 8-bit PCM, which hold the payload's bytes in turn, into pages with checksums and
lacing values; read() verifies each page's checksum and sequence number, reassembles packets from the lacing values, also where
they go on over several pages, demultiplexes the streams by serial number, derives the time of each packet from the granule
positions, and puts the streams' samples together by their times.

A stream starts with a header packet: the OggPCM codec name, format, sample rate and channels. A page's granule position is the
number of the stream's samples up to the end of the last packet that ends on it, -1 if none does; the packets before it on
the page end where the next one starts. So packets may have any lengths, and the reader knows nothing of the writer.

Defined results: a null text counts as empty; every payload has 192 bytes at least; equal texts give equal media (serial
numbers are fixed); null ids and repeated rows are kept; an empty table gives an empty
result; other columns aren't read; read() raises OggError for damaged media, describe_media() puts its message in the column error and
leaves the others null, as it does for null media.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, per_text, ship

#: The payload is a positive multiple of so many bytes.
UNIT = 192
RATE = 8000
#: Samples of a packet that the writer makes: 0.3 s. With lacing values of 255 it takes ten of a page's 255 segments.
PACKET = 2400
SERIALS = (0x1A, 0x2B)
#: The header flags of a page.
CONTINUED, FIRST, LAST = 1, 2, 4
_HEADER = struct.Struct("<4sBBqIIIB")
#: OggPCM's codec name, and its number for unsigned 8-bit samples.
CODEC, U8 = b"PCM     ", 1
_CODEC = struct.Struct(">8sHHIIBBHI")
#: Each byte with its bits in reverse order.
_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


class OggError(ValueError):
    pass


def checksum(page: bytes) -> int:
    """Ogg's CRC (polynomial 0x04c11db7, most significant bit first, no inversion), by way of zlib's mirrored one."""
    mirrored = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int(f"{mirrored:032b}"[::-1], 2)


def lacing(n: int) -> bytes:
    """The lacing values of a packet of n bytes: 255s and one value below, which ends it."""
    return b"\xff" * (n // 255) + bytes([n % 255])


class _Writer:
    """Pages of one logical stream."""

    def __init__(self, serial: int):
        self.serial, self.sequence, self.flags = serial, 0, FIRST
        self.laces, self.body, self.granule = bytearray(), bytearray(), -1

    def page(self, last: bool = False) -> bytes:
        head = _HEADER.pack(b"OggS", 0, self.flags | LAST * last, self.granule, self.serial, self.sequence, 0, len(self.laces))
        page = bytearray(head + self.laces + self.body)
        struct.pack_into("<I", page, 22, checksum(bytes(page)))
        self.sequence += 1
        self.flags, self.granule = CONTINUED if self.laces and self.laces[-1] == 255 else 0, -1
        self.laces.clear()
        self.body.clear()
        return bytes(page)

    def packet(self, data: bytes, granule: int) -> Iterator[bytes]:
        """Takes a packet; yields the pages that are full."""
        at = 0
        for n in lacing(len(data)):
            if len(self.laces) == 255:
                yield self.page()
            self.laces.append(n)
            self.body += data[at : at + n]
            at += n
        self.granule = granule


def pad(data: bytes, unit: int = UNIT) -> bytes:
    return data + b" " * ((-len(data)) % unit if data else unit)


def write(payload: bytes, packet: int = PACKET) -> bytes:
    """An Ogg file of the payload's bytes as samples, dealt to the streams in turn."""
    streams = [_Writer(s) for s in SERIALS]
    out = []
    for s in streams:
        list(s.packet(_CODEC.pack(CODEC, 0, 0, U8, RATE, 8, 1, 0, 0), 0))
        out.append(s.page())
    samples = [payload[k :: len(streams)] for k in range(len(streams))]
    for at in range(0, len(samples[0]), packet):
        for s, data in zip(streams, samples, strict=True):
            if part := data[at : at + packet]:
                out += s.packet(part, at + len(part))
    return b"".join([*out, *(s.page(last=True) for s in streams)])


@dataclass
class Stream:
    serial: int
    rate: int = 0
    #: (end in samples, data).
    packets: list[tuple[int, bytes]] = field(default_factory=list)
    pages: int = 0
    ended: bool = False
    _partial: bytearray = field(default_factory=bytearray)
    _open: bool = False


def pages(media: bytes) -> Iterator[tuple[int, int, int, int, bytes, memoryview]]:
    """(flags, granule, serial, sequence, laces, body) of each page, its checksum verified."""
    at, view = 0, memoryview(media)
    while at < len(media):
        if len(media) - at < _HEADER.size:
            raise OggError("cut off in a page header")
        magic, version, flags, granule, serial, sequence, crc, n = _HEADER.unpack_from(media, at)
        if magic != b"OggS" or version:
            raise OggError(f"no page at byte {at}")
        laces = media[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(laces)
        if len(laces) < n or end > len(media):
            raise OggError("cut off in a page")
        if checksum(media[at : at + 22] + bytes(4) + media[at + 26 : end]) != crc:
            raise OggError(f"wrong checksum of the page at byte {at}")
        yield flags, granule, serial, sequence, laces, view[at + 27 + n : end]
        at = end


def demultiplex(media: bytes) -> dict[int, Stream]:
    """Each logical stream with its data packets and the granule positions of their ends."""
    out: dict[int, Stream] = {}
    for flags, granule, serial, sequence, laces, body in pages(media):
        s = out.setdefault(serial, Stream(serial))
        if sequence != s.pages or bool(flags & FIRST) != (sequence == 0) or s.ended or bool(flags & CONTINUED) != s._open:
            raise OggError(f"stream {serial}: page {sequence} is out of order")
        s.pages += 1
        at, done = 0, []
        for n in laces:
            s._partial += body[at : at + n]
            at += n
            s._open = n == 255
            if not s._open:
                done.append(bytes(s._partial))
                s._partial.clear()
        if (granule == -1) != (not done):
            raise OggError(f"stream {serial}: page {sequence} has no place in time")
        # The granule position is that of the page's last packet; the others end where the next one starts.
        ends, end = [], granule
        for data in reversed(done):
            ends.append(end)
            end -= len(data)
        for data, e in zip(done, reversed(ends), strict=True):
            if not s.rate:
                if len(data) != _CODEC.size:
                    raise OggError(f"stream {serial}: no header packet")
                name, _, _, kind, s.rate, bits, channels, _, _ = _CODEC.unpack(data)
                if (name, kind, bits, channels) != (CODEC, U8, 8, 1) or not s.rate:
                    raise OggError(f"stream {serial}: not 8-bit PCM")
            else:
                if e - len(data) != (s.packets[-1][0] if s.packets else 0):
                    raise OggError(f"stream {serial}: a gap before sample {e - len(data)}")
                s.packets.append((e, data))
        s.ended = bool(flags & LAST)
    if any(s._open or not s.ended for s in out.values()):
        raise OggError("a stream has no end")
    return out


def read(media: bytes) -> tuple[bytes, dict]:
    """The payload, and what its container says: streams, pages, packets, seconds."""
    streams = list(demultiplex(media).values())
    if len({s.rate for s in streams}) > 1:
        raise OggError("streams of several rates")
    samples = [b"".join(d for _, d in s.packets) for s in streams]
    if not streams or max(map(len, samples)) - min(map(len, samples)) > 1 or sorted(map(len, samples), reverse=True) != [len(x) for x in samples]:
        raise OggError("streams of several lengths")
    # Sample k of each stream has the same time; the streams' order is that of their first pages.
    out = bytearray(sum(map(len, samples)))
    for k, data in enumerate(samples):
        out[k :: len(samples)] = data
    return bytes(out), {"streams": len(streams), "pages": sum(s.pages for s in streams), "packets": sum(len(s.packets) for s in streams), "seconds": max(len(x) for x in samples) / streams[0].rate}


def features(payload: bytes, info: dict) -> str:
    """Duration, container counts, and of the samples: peak, mean, root mean square and zero crossings."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    total, squares = int(x.sum()), int((x * x).sum())
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    ms = round(info["seconds"] * 1000)
    return f"ms={ms};streams={info['streams']};pages={info['pages']};packets={info['packets']};peak={int(np.abs(x).max())};mean={total / len(x):.4f};rms={(squares / len(x)) ** 0.5:.4f};crossings={crossings}"


MEDIA = [("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("error", pa.string())]


def _encode(texts: list[str]) -> pa.Array:
    data = [t.encode() for t in texts]
    cols = [pa.array(map(len, data), pa.int64()), pa.array([write(pad(d)) for d in data], pa.binary())]
    return pa.StructArray.from_arrays(cols, fields=[pa.field("n_bytes", pa.int64()), pa.field("media", pa.binary())])


def _described(media: bytes | None) -> tuple:
    if media is None:
        return (*[None] * (len(MEDIA) - 1), "null")
    try:
        payload, info = read(media)
    except OggError as e:
        return (*[None] * 3, len(media), hashlib.sha256(media).hexdigest(), None, str(e))
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), features(payload, info), None


def _decode(media: pa.Array) -> pa.Array:
    cols = list(zip(*[_described(m.as_py()) for m in media], strict=True)) or [()] * len(MEDIA)
    return pa.StructArray.from_arrays([pa.array(c, k) for c, (_, k) in zip(cols, MEDIA, strict=True)], fields=[pa.field(n, k) for n, k in MEDIA])


_decode.__annotations__ = {"media": pa.Array, "return": pa.Array}


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of docs: doc_id, n_bytes, media (an Ogg file of the text's bytes)."""
    made = per_text(docs.sparkSession, _encode, "n_bytes bigint, media binary", F.col("text")).alias("made")
    return id_and_text(docs, id_col, text_col).select("doc_id", made).select("doc_id", "made.*")


def describe_media(media: DataFrame) -> DataFrame:
    """Per row of doc_id, n_bytes, media: what the stored bytes hold, and their features; error says what is wrong with them, if anything."""
    ship(media.sparkSession)
    kinds = {pa.int64(): "bigint", pa.string(): "string"}
    made = F.arrow_udf(_decode, ", ".join(f"{n} {kinds[k]}" for n, k in MEDIA)).asNondeterministic()(F.col("media")).alias("made")
    return media.select("doc_id", "n_bytes", made).select("doc_id", "n_bytes", "made.*")
