"""Media columns: signature sniffing of stored bytes.

An Aho-Corasick automaton locates magic bytes at any offset; a validator per format confirms structure and lengths.
The type found at offset 0 corrects the declared one, and confirmed media further inside are carved. Payloads are
stored as 8-bit PCM samples in a WAVE container and read back through the same sniffer.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from itemforge.llm.common import bound_batches

PAD = 64
SAMPLE_RATE = 16_000

#: Media type, magic bytes, offset of the magic bytes from the start of the medium.
SIGNATURES = (
    ("audio/wav", b"RIFF", 0),
    ("image/png", b"\x89PNG\r\n\x1a\n", 0),
    ("image/gif", b"GIF87a", 0),
    ("image/gif", b"GIF89a", 0),
    ("image/jpeg", b"\xff\xd8\xff", 0),
    ("image/bmp", b"BM", 0),
    ("application/zip", b"PK\x03\x04", 0),
    ("application/gzip", b"\x1f\x8b\x08", 0),
    ("application/pdf", b"%PDF-", 0),
    ("audio/flac", b"fLaC", 0),
    ("audio/ogg", b"OggS", 0),
    ("video/mp4", b"ftyp", 4),
)


@dataclass(frozen=True)
class Medium:
    type: str
    start: int
    end: int


class Finder:
    """Places of byte strings in data, each searched for once."""

    def __init__(self, data: bytes) -> None:
        self.data, self.places = data, {}

    def first(self, what: bytes, start: int) -> int:
        """The first place from start on, -1 for none."""
        if what not in self.places:
            self.places[what] = [m.start() for m in re.finditer(re.escape(what), self.data)]
        places = self.places[what]
        k = bisect_left(places, start)
        return places[k] if k < len(places) else -1


def _wav(d: bytes, s: int, find: Finder) -> int | None:
    if len(d) - s < 44 or d[s + 8 : s + 12] != b"WAVE":
        return None
    end = s + 8 + struct.unpack_from("<I", d, s + 4)[0]
    at, seen = s + 12, set()
    while at + 8 <= end <= len(d):
        name, size = d[at : at + 4], struct.unpack_from("<I", d, at + 4)[0]
        seen.add(name)
        at += 8 + size + size % 2
    return end if at == end and {b"fmt ", b"data"} <= seen else None


def _png(d: bytes, s: int, find: Finder) -> int | None:
    at = s + 8
    while at + 12 <= len(d):
        size = struct.unpack_from(">I", d, at)[0]
        end = at + 12 + size
        if end > len(d) or zlib.crc32(d[at + 4 : end - 4]) != struct.unpack_from(">I", d, end - 4)[0]:
            return None
        if d[at + 4 : at + 8] == b"IEND":
            return end
        at = end
    return None


def _gif(d: bytes, s: int, find: Finder) -> int | None:
    if len(d) - s < 14:
        return None
    at = s + 13 + (3 * 2 ** ((d[s + 10] & 7) + 1) if d[s + 10] & 0x80 else 0)
    while at < len(d):
        mark = d[at]
        if mark == 0x3B:
            return at + 1
        if mark == 0x2C:
            if at + 10 > len(d):
                return None
            at += 11 + (3 * 2 ** ((d[at + 9] & 7) + 1) if d[at + 9] & 0x80 else 0)
        elif mark == 0x21:
            at += 2
        else:
            return None
        while at < len(d) and d[at]:
            at += d[at] + 1
        at += 1
    return None


def _jpeg(d: bytes, s: int, find: Finder) -> int | None:
    at = s + 2
    while at + 4 <= len(d) and d[at] == 0xFF:
        if d[at + 1] == 0xDA:
            end = find.first(b"\xff\xd9", at)
            return end + 2 if end >= 0 else None
        at += 2 + struct.unpack_from(">H", d, at + 2)[0]
    return None


def _bmp(d: bytes, s: int, find: Finder) -> int | None:
    if len(d) - s < 54:
        return None
    size, reserved, offset, header = struct.unpack_from("<IIII", d, s + 2)
    return s + size if reserved == 0 and header in (40, 52, 56, 108, 124) and 54 <= offset <= size <= len(d) - s else None


def _zip(d: bytes, s: int, find: Finder) -> int | None:
    end = find.first(b"PK\x05\x06", s)
    if end < 0 or end + 22 > len(d):
        return None
    size, offset, comment = struct.unpack_from("<IIH", d, end + 12)
    return end + 22 + comment if s + offset + size == end and end + 22 + comment <= len(d) else None


def _gzip(d: bytes, s: int, find: Finder) -> int | None:
    inflate = zlib.decompressobj(31)
    try:
        for at in range(s, len(d), 65536):
            block = d[at : at + 65536]
            while block and not inflate.eof:
                inflate.decompress(block, 1 << 20)
                block = inflate.unconsumed_tail
            if inflate.eof:
                return min(at + 65536, len(d)) - len(inflate.unused_data)
    except zlib.error:
        return None
    return None


def _pdf(d: bytes, s: int, find: Finder) -> int | None:
    end = find.first(b"%%EOF", s)
    return end + 5 if end >= 0 and 0 <= find.first(b"startxref", s) < end else None


def _crc_table(polynomial: int, bits: int) -> list[int]:
    out, top = [], 1 << bits - 1
    for byte in range(256):
        value = byte << bits - 8
        for _ in range(8):
            value = (value << 1 ^ (polynomial if value & top else 0)) & (1 << bits) - 1
        out.append(value)
    return out


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def _flac_frame(d: bytes, at: int) -> tuple[int, int] | None:
    """Samples and header length of the frame header at a place, if its checksum is right."""
    if len(d) - at < 6 or d[at] != 0xFF or d[at + 1] & 0xFE != 0xF8:
        return None
    size, rate = d[at + 2] >> 4, d[at + 2] & 15
    number = 1 if d[at + 4] < 0x80 else 8 - (~d[at + 4] & 0xFF).bit_length()
    place = at + 4 + number
    more = {6: 1, 7: 2}.get(size, 0)
    end = place + more + {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if not size or rate == 15 or number > 7 or end >= len(d):
        return None
    samples = int.from_bytes(d[place : place + more], "big") + 1 if more else 192 if size == 1 else 576 << size - 2 if size < 6 else 256 << size - 8
    check = 0
    for byte in d[at:end]:
        check = _CRC8[check ^ byte]
    return (samples, end + 1 - at) if check == d[end] else None


def _flac(d: bytes, s: int, find: Finder) -> int | None:
    """Metadata blocks, then frames by their checksums until the stream's samples are there."""
    at, last, total = s + 4, 0, 0
    while not last:
        if at + 4 > len(d):
            return None
        last, kind, size = d[at] & 0x80, d[at] & 0x7F, int.from_bytes(d[at + 1 : at + 4], "big")
        if (at == s + 4) != (kind == 0) or kind == 127 or at == s + 4 and size != 34 or at + 4 + size > len(d):
            return None
        if kind == 0:
            total = int.from_bytes(d[at + 17 : at + 22], "big") & (1 << 36) - 1
        at += 4 + size
    done, start = 0, at
    while header := _flac_frame(d, at):
        check, end = 0, at
        while end < len(d):
            check = (check << 8 & 0xFFFF) ^ _CRC16[check >> 8 ^ d[end]]
            end += 1
            if not check and end - at > header[1] + 2 and (done + header[0] >= total > 0 or end == len(d) or _flac_frame(d, end)):
                break
        if check:
            return None
        done, at = done + header[0], end
        if done >= total > 0:
            break
    return at if at > start and done >= total else None


def _ogg(d: bytes, s: int, find: Finder) -> int | None:
    at = s
    while at + 27 <= len(d) and d[at : at + 5] == b"OggS\0":
        lacing = d[at + 27 : at + 27 + d[at + 26]]
        end = at + 27 + d[at + 26] + sum(lacing)
        if end > len(d):
            return None
        if d[at + 5] & 4:
            return end
        at = end
    return None


def _mp4(d: bytes, s: int, find: Finder) -> int | None:
    at, names = s, []
    while at + 8 <= len(d):
        size, name = struct.unpack_from(">I4s", d, at)
        if size < 8 or at + size > len(d) or name not in (b"ftyp", b"moov", b"mdat", b"free", b"skip", b"wide", b"moof", b"mfra", b"uuid"):
            break
        names.append(name)
        at += size
    return at if {b"ftyp", b"moov"} <= set(names) else None


_VALIDATORS = {"audio/wav": _wav, "image/png": _png, "image/gif": _gif, "image/jpeg": _jpeg, "image/bmp": _bmp, "application/zip": _zip, "application/gzip": _gzip, "application/pdf": _pdf, "audio/flac": _flac, "audio/ogg": _ogg, "video/mp4": _mp4}
_AUTOMATON = None


def _automaton() -> ahocorasick.Automaton:
    global _AUTOMATON
    if _AUTOMATON is None:
        _AUTOMATON = ahocorasick.Automaton()
        for kind, magic, offset in SIGNATURES:
            _AUTOMATON.add_word(magic.decode("latin-1"), (kind, len(magic), offset))
        _AUTOMATON.make_automaton()
    return _AUTOMATON


def sniff(data: bytes) -> list[Medium]:
    """Confirmed media in data, by start; a medium inside another one is listed after it."""
    found, find = [], Finder(data)
    for last, (kind, length, offset) in _automaton().iter(data.decode("latin-1")):
        start = last + 1 - length - offset
        end = _VALIDATORS[kind](data, start, find) if start >= 0 else None
        if end is not None:
            found.append(Medium(kind, start, end))
    return sorted(found, key=lambda m: (m.start, -m.end, m.type))


def correct_type(data: bytes, declared: str | None) -> tuple[str | None, list[Medium]]:
    """The type by signature, the declared one where no signature at offset 0 is confirmed; and the media inside."""
    found = sniff(data)
    outer = next((m.type for m in found if m.start == 0), None)
    return outer or declared, [m for m in found if m.start > 0]


def store_wav(payload: bytes) -> bytes:
    """An 8-bit mono PCM WAVE file whose samples are the payload's bytes; its length is even."""
    n = len(payload)
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, SAMPLE_RATE, SAMPLE_RATE, 1, 8, b"data", n) + payload


def read_wav(media: bytes) -> bytes:
    at = 12
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"data":
            return media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def describe(media: bytes, declared: str) -> tuple[bytes, str]:
    """The payload read back from stored media, and its features as text."""
    kind, inside = correct_type(media, declared)
    payload = read_wav(media)
    samples = np.frombuffer(payload, dtype=np.uint8).astype(np.int32) - 128
    total, energy = int(samples.sum()), int((samples.astype(np.int64) ** 2).sum())
    crossings = int(np.count_nonzero((samples[1:] < 0) != (samples[:-1] < 0)))
    carved = ";".join(f"{m.type}@{m.start}+{m.end - m.start}" for m in inside)
    return payload, f"type={kind}|declared={declared}|n={len(samples)}|sum={total}|energy={energy}|crossings={crossings}|peak={int(np.abs(samples).max())}|carved={carved}"


def media_digests(docs: DataFrame, declared: str = "text/plain") -> DataFrame:
    """Per input row the digests of its text stored as samples and read back.

    Null text counts as empty; an empty text is 64 zero bytes. Equal texts give equal values. Repeated rows give
    repeated results; other columns are ignored. A text is held whole by one task.
    """
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            rows = []
            for value in batch.column(1):
                raw = (value.as_py() or "").encode("utf-8", "surrogatepass")
                media = store_wav(raw + bytes(-len(raw) % PAD if raw else PAD))
                payload, feature = describe(media, declared)
                rows.append((len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-PAD:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            columns = list(zip(*rows, strict=True)) or [[]] * len(types)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names)

    bound_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(batches, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
