"""Media columns of Ogg files: writing them, checking them, and reading their logical streams.

A file is a row of pages, each with a checksum, the serial number of its logical stream and a
granule position. Packets are cut into segments (lacing values) that pages carry; a value below 255
ends a packet. The PCM stream here holds unsigned 8-bit samples; a second stream of cues, muxed
between its pages, repeats where each stretch of samples starts and its crc32.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farewright.llm.shared import fresh

RATE = 8000
VENDOR = b"farewright"
#: Samples of a packet, and packets between cues.
PACKET, CUE_EVERY = 4096, 16
#: Payloads are padded with bytes 0 to a positive multiple of this.
ALIGN = 64
PCM, CUES = 1, 2
_HEAD = struct.Struct("<4sBBqIIIB")
_IDENT = struct.Struct(">8sHHIIBBHI")
_CUE = struct.Struct("<QI")
CONTINUED, FIRST, LAST = 1, 2, 4
_MIRROR = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def checksum(page: bytes) -> int:
    """Ogg's CRC: polynomial 0x04C11DB7, high bit first, start and final xor 0. That is the mirror
    image of zlib's CRC over mirrored bytes, without its start and final xor."""
    crc = zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "little").translate(_MIRROR), "big")


def pages(packets: list[tuple[bytes, int]], serial: int, last: bool, start: int = 0) -> list[bytes]:
    """Pages for (packet, granule position at its end), numbered from start."""
    out, lacing, body, granule, carried = [], bytearray(), [], -1, False

    def close(flags: int) -> None:
        number = start + len(out)
        flags |= (CONTINUED if carried else 0) | (FIRST if number == 0 else 0)
        head = _HEAD.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing
        page = head + b"".join(body)
        out.append(page[:22] + struct.pack("<I", checksum(page)) + page[26:])

    for packet, at in packets:
        left = memoryview(packet)
        todo = len(packet) // 255 + 1
        while todo:
            room = min(todo, 255 - len(lacing))
            ends = room == todo
            lacing += b"\xff" * (room - ends) + (bytes([len(packet) % 255]) if ends else b"")
            take = 255 * (room - ends) + (len(packet) % 255 if ends else 0)
            body.append(bytes(left[:take]))
            left, todo = left[take:], todo - room
            granule = at if ends else granule
            if len(lacing) == 255 and not (ends and packet is packets[-1][0] and at == packets[-1][1]):
                close(0)
                lacing, body, granule, carried = bytearray(), [], -1, not ends
    if lacing:
        close(LAST if last else 0)
    return out


def encode(payload: bytes, rate: int = RATE) -> bytes:
    """An Ogg file with the payload as 8-bit samples, and its cues."""
    parts = [payload[i : i + PACKET] for i in range(0, len(payload), PACKET)]
    ident = _IDENT.pack(b"PCM     ", 0, 0, 1, rate, 8, 1, PACKET, 0)
    comment = struct.pack("<I", len(VENDOR)) + VENDOR + struct.pack("<I", 0)
    cues = pages([(b"cues\0\0\0\0" + struct.pack("<I", rate), 0)], CUES, False)
    audio = pages([(ident, 0)], PCM, False)
    out = [*audio, *cues, *pages([(comment, 0)], PCM, False, 1)]
    n_audio, n_cues, done = 2, 1, 0
    for k in range(0, len(parts), CUE_EVERY):
        stretch, final = parts[k : k + CUE_EVERY], k + CUE_EVERY >= len(parts)
        begun, packets = done, []
        for p in stretch:
            done += len(p)
            packets.append((p, done))
        cue = pages([(_CUE.pack(begun, zlib.crc32(b"".join(stretch))), done)], CUES, final, n_cues)
        audio = pages(packets, PCM, final, n_audio)
        n_audio, n_cues = n_audio + len(audio), n_cues + len(cue)
        out += [*cue, *audio]
    return b"".join(out)


@dataclass
class Stream:
    """One logical stream: its packets, the granule position of each packet that ends a page (else
    -1), its pages, and how many times pages were missing."""

    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)
    pages: int = 0
    gaps: int = 0
    ended: bool = False
    next_page: int = 0
    part: bytearray | None = None


def demux(media: bytes) -> tuple[dict[int, Stream], int]:
    """The logical streams by serial number, and the count of damaged stretches. A page with a wrong
    checksum is skipped and the next page sought; a packet that lacks a page is dropped."""
    streams: dict[int, Stream] = {}
    at, bad = 0, 0
    while at < len(media):
        size = 0
        if media[at : at + 4] == b"OggS" and at + 27 <= len(media):
            _, version, flags, granule, serial, number, crc, n = _HEAD.unpack_from(media, at)
            lacing = media[at + 27 : at + 27 + n]
            size = 27 + n + sum(lacing)
            page = media[at : at + size]
            if version or len(lacing) < n or len(page) < size or checksum(page[:22] + b"\0\0\0\0" + page[26:]) != crc:
                size = 0
        if not size:
            bad += 1
            at = media.find(b"OggS", at + 1)
            if at < 0:
                break
            continue
        s = streams.setdefault(serial, Stream())
        if number != s.next_page:
            s.gaps += 1
            s.part = None
        s.next_page, s.pages, s.ended = number + 1, s.pages + 1, bool(flags & LAST)
        if not flags & CONTINUED:
            s.part = bytearray()
        here, whole = 27 + n, len(s.packets)
        for value in lacing:
            if s.part is not None:
                s.part += page[here : here + value]
            here += value
            if value < 255:
                if s.part is not None:
                    s.packets.append(bytes(s.part))
                    s.granules.append(-1)
                s.part = bytearray()
        if len(s.packets) > whole and granule >= 0:
            s.granules[-1] = granule
        at += size
    return streams, bad


@dataclass
class Track:
    """What a file's PCM stream holds."""

    payload: bytes
    rate: int
    streams: int
    pages: int
    bad: int
    gaps: int
    cues_held: bool
    #: (start, end) seconds of each page's samples, from granule positions.
    times: list[tuple[float, float]]


def track(media: bytes) -> Track:
    """The samples of the PCM stream, whose first packet names its format and whose second is a comment. A file without one has an
    empty payload, rate 0 and no times."""
    streams, bad = demux(media)
    pcm = next((s for s in streams.values() if s.packets and s.packets[0][:8] == b"PCM     " and len(s.packets[0]) >= _IDENT.size), Stream())
    cue = next((s for s in streams.values() if s.packets and s.packets[0][:8] == b"cues\0\0\0\0"), Stream())
    rate = _IDENT.unpack_from(pcm.packets[0])[4] if pcm.packets else 0
    payload = b"".join(pcm.packets[2:])
    marks = [g for g in pcm.granules[2:] if g >= 0]
    times = [(a / rate, b / rate) for a, b in zip([0, *marks], marks, strict=False)] if rate else []
    starts = [_CUE.unpack(c) for c in cue.packets[1:] if len(c) == _CUE.size]
    ends = [a for a, _ in starts[1:]] + [len(payload)]
    held = all(zlib.crc32(payload[a:b]) == crc for (a, crc), b in zip(starts, ends, strict=True)) if starts else False
    return Track(payload, rate, len(streams), sum(s.pages for s in streams.values()), bad, sum(s.gaps for s in streams.values()), held, times)


def features(t: Track) -> str:
    """Figures of the samples as read back: length, level, crossings of the middle, and the pages."""
    x = np.frombuffer(t.payload, np.uint8)
    if not len(x):
        return f"ms=0;mean=0.000;rms=0.000;crossings=0;pages={t.pages};streams={t.streams};bad={t.bad};gaps={t.gaps};cues={int(t.cues_held)}"
    total, squares = int(x.sum(dtype=np.int64)), int((x.astype(np.int64) ** 2).sum())
    crossings = int(np.count_nonzero(np.diff((x >= 128).view(np.int8))))
    end = t.times[-1][1] if t.times else 0.0
    return (f"ms={round(end * 1000)};mean={total / len(x):.3f};rms={(squares / len(x)) ** 0.5:.3f};crossings={crossings};"
            f"pages={t.pages};streams={t.streams};bad={t.bad};gaps={t.gaps};cues={int(t.cues_held)}")


def _mapped(df: DataFrame, drop: str, new: dict, make) -> DataFrame:
    """df without one column and with new ones, made row by row from that column as bytes."""
    keep = [c for c in df.columns if c != drop]
    names = fresh(df.select(*keep), *new)
    (raw,) = fresh(df, "as_bytes")
    types = [k for k, _ in new.values()]

    def run(batches):
        for batch in batches:
            rows = [make(v) for v in batch.column(0).to_pylist()]
            columns = [pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(new.values())]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *columns], names=[*batch.schema.names[1:], *names])

    schema = df.select(*keep).withColumns({n: F.lit(None).cast(k) for n, k in zip(names, types, strict=True)}).schema
    for f in schema.fields:
        f.nullable = True
    return df.select(F.col(drop).cast("binary").alias(raw), *keep).mapInArrow(run, schema)


def store_text(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without its text, and with n_bytes and media: the whole text's UTF-8 bytes, padded, as
    an Ogg file. A null text counts as empty: one block of bytes 0. Repeated rows stay. n_bytes and
    media take other names if docs has columns of those names."""

    def make(b):
        b = b or b""
        return len(b), encode(b + bytes(-len(b) % ALIGN if b else ALIGN))

    return _mapped(docs, text, {"n_bytes": ("bigint", pa.int64()), "media": ("binary", pa.binary())}, make)


def read_media(df: DataFrame, media: str = "media") -> DataFrame:
    """df without its media column, and with what the files hold: payload_bytes, payload_sha256,
    tail_crc32 (of the last 64 bytes), media_bytes, media_sha256, feature, page_times (seconds).

    Damaged pages are skipped and counted in feature; a null or empty file has an empty payload."""

    def make(b):
        b = b or b""
        t = track(b)
        times = [{"start": a, "stop": z} for a, z in t.times]
        return (len(t.payload), hashlib.sha256(t.payload).hexdigest(), zlib.crc32(t.payload[-ALIGN:]), len(b), hashlib.sha256(b).hexdigest(), features(t), times)

    span = pa.list_(pa.struct([("start", pa.float64()), ("stop", pa.float64())]))
    return _mapped(df, media, {
        "payload_bytes": ("bigint", pa.int64()), "payload_sha256": ("string", pa.string()), "tail_crc32": ("bigint", pa.int64()),
        "media_bytes": ("bigint", pa.int64()), "media_sha256": ("string", pa.string()), "feature": ("string", pa.string()),
        "page_times": ("array<struct<start: double, stop: double>>", span)}, make)
