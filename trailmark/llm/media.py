"""MPEG audio columns: resynchronise frame headers, parse tags and variable-bitrate tables, verify checksums,
and store exact durations and frame seek offsets.

``parse_audio`` works on any binary column that holds an MPEG-1/2/2.5 audio stream (layers I to III).
``embed_payload`` stores arbitrary bytes losslessly as such a stream: each frame of layer III is digital silence
(its side information is zero), and the bytes lie in the frame's ancillary data, which decoders skip. Frames take
the smallest bit rate that holds what is left, so the stream has a variable bit rate and carries a seek table.

Defined results: a null or empty stream has no frame, duration 0 and no offsets; bytes that are not part of a frame
or tag (free-format frames, whose length no header tells, among them) are counted as ``skipped``; a frame whose checksum differs is counted and still timed; bytes inside a frame are no closing tag. A null text is the
empty text; it is stored as 64 zero bytes. Rows are mapped one by one, so repeated rows and ties give equal values,
an empty table gives an empty table, and columns besides the kept ones never meet the operator's own names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from fractions import Fraction
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_row

# Fixed values of ISO/IEC 11172-3 and 13818-3: kbit/s by (version 1, layer) or (version 2, layer), and Hz by version.
BITRATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}

CRC_TABLE = []
for _i in range(256):
    _c = _i << 8
    for _ in range(8):
        _c = (_c << 1 ^ 0x8005 if _c & 0x8000 else _c << 1) & 0xFFFF
    CRC_TABLE.append(_c)


@lru_cache(1 << 14)
def crc16(data: bytes) -> int:
    """The frames' checksum: polynomial 0x8005, start 0xFFFF, most significant bit first."""
    c = 0xFFFF
    for b in data:
        c = (c << 8 & 0xFFFF) ^ CRC_TABLE[c >> 8 ^ b]
    return c


@lru_cache(1 << 12)
def header(word: int) -> tuple | None:
    """(length, samples, rate, layer, side bytes, protected, kbit/s, kind) of a header, or None if it is none.

    kind: the fields that all frames of one stream share (version, layer, sample rate).
    """
    if word >> 21 != 0x7FF:
        return None
    version, layer, rate, at = word >> 19 & 3, 4 - (word >> 17 & 3), word >> 10 & 3, word >> 12 & 15
    if version == 1 or layer == 4 or rate == 3 or at in (0, 15) or word & 3 == 2:
        return None
    kbits = BITRATES[1 if version == 3 else 2, layer][at]
    hz, pad, mono = RATES[version][rate], word >> 9 & 1, word >> 6 & 3 == 3
    samples = 384 if layer == 1 else 1152 if layer == 2 or version == 3 else 576
    length = (12000 * kbits // hz + pad) * 4 if layer == 1 else samples // 8 * 1000 * kbits // hz + pad
    side = ((17 if mono else 32) if version == 3 else (9 if mono else 17)) if layer == 3 else 0
    return length, samples, hz, layer, side, not word >> 16 & 1, kbits, (version, layer, rate)


def crc_bits(data: bytes, first: int, n: int, c: int) -> int:
    """The checksum ``c`` carried on over ``n`` bits from bit ``first`` of ``data``."""
    for i in range(first, first + n):
        c = (c << 1 ^ 0x8005 if (c >> 15 ^ data[i >> 3] >> 7 - (i & 7)) & 1 else c << 1) & 0xFFFF
    return c


def guarded_bits(frame: bytes, layer: int, side: int) -> int | None:
    """How many bits after the checksum it covers besides the header: side information (III), bit allocation (I), and scale factor selection (II).

    None: the frame ends before them.
    """
    if layer == 3:
        return side * 8
    mpeg1, rate, mode = frame[1] >> 3 & 3 == 3, frame[2] >> 2 & 3, frame[3] >> 6
    if layer == 1:
        widths = [4] * 32
    elif not mpeg1:
        widths = [4] * 4 + [3] * 7 + [2] * 19
    else:
        kbits = BITRATES[1, 2][frame[2] >> 4] // (1 if mode == 3 else 2)
        if kbits < 56:
            widths = [4] * 2 + [3] * (10 if rate == 2 else 6)
        else:
            widths = [4] * 11 + [3] * 12 + [2] * (7 if kbits >= 96 and rate != 1 else 4)
    both = {3: 0, 1: 4 * (frame[3] >> 4 & 3) + 4}.get(mode, 32)  # subbands with an allocation for each channel
    body = int.from_bytes(frame[6:], "big")
    total, at, chosen = 8 * (len(frame) - 6), 0, 0
    for i, w in enumerate(widths):
        for _ in range(2 if i < both else 1):
            if at + w > total:
                return None
            if body >> total - at - w & (1 << w) - 1:
                chosen += 1 if mode == 3 or i < both else 2  # a shared allocation has a selection for each channel
            at += w
    n = at if layer == 1 else at + 2 * chosen
    return n if n <= total else None


def crc_holds(frame: bytes, layer: int, side: int) -> bool:
    n = guarded_bits(frame, layer, side)
    if n is None or len(frame) < 6 + (n + 7) // 8:
        return False
    whole = crc16(frame[2:4] + frame[6 : 6 + n // 8])
    return crc_bits(frame, 48 + n // 8 * 8, n % 8, whole) == frame[4] << 8 | frame[5]


def at_header(data: bytes, pos: int) -> tuple | None:
    return header(int.from_bytes(data[pos : pos + 4], "big")) if pos + 4 <= len(data) else None


def id3v2(data: bytes) -> tuple[int, dict[str, str]]:
    """Bytes that a leading ID3v2 tag (2.2 to 2.4) takes, and its text fields; unsynchronised tags and fields are read as they were before it."""
    if data[:3] != b"ID3" or len(data) < 10:
        return 0, {}
    synch = lambda b: b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]
    joined = lambda b: b.replace(b"\xff\0", b"\xff")  # noqa: E731  undoes unsynchronisation
    version, flags, end = data[3], data[5], min(len(data), 10 + synch(data[6:10]))
    body, pos, fields = data[10:end], 0, {}
    if flags & 0x80 and version < 4:
        body = joined(body)
    if version > 2 and flags & 0x40 and len(body) >= 4:  # an extended header
        pos = synch(body) if version == 4 else 4 + int.from_bytes(body[:4], "big")
    name_size, head = (3, 6) if version == 2 else (4, 10)
    while pos + head <= len(body) and body[pos]:
        raw = body[pos + name_size : pos + 2 * name_size]
        size = synch(raw) if version == 4 else int.from_bytes(raw, "big")
        name, value = body[pos : pos + name_size].decode("latin-1"), body[pos + head : pos + head + size]
        if version == 4 and (body[pos + 9] & 2 or flags & 0x80):
            value = joined(value)
        if version == 4 and body[pos + 9] & 1:  # a length stands before the value
            value = value[4:]
        if name[0] == "T" and value:
            text = value[1:].decode({0: "latin-1", 3: "utf-8"}.get(value[0], "utf-16"), "replace")
            key, _, value = text.partition("\0") if name in ("TXXX", "TXX") else (name, "", text)
            fields[key] = value.strip("\0")
        pos += head + size
    return end + 10 * bool(flags & 0x10), fields


def vbr_table(frame: bytes, side: int, protected: bool) -> tuple[str, int, int, bytes] | None:
    """(kind, frames, bytes, table of contents) of a frame that holds a variable-bitrate header."""
    at = 4 + 2 * protected + side
    for at in {at, 4 + side}:
        if frame[at : at + 4] in (b"Xing", b"Info"):
            flags, pos, got = int.from_bytes(frame[at + 4 : at + 8], "big"), at + 8, [0, 0]
            for i in (0, 1):
                if flags >> i & 1:
                    got[i], pos = int.from_bytes(frame[pos : pos + 4], "big"), pos + 4
            return frame[at : at + 4].decode(), *got, frame[pos : pos + 100] if flags & 4 else b""
    if frame[36:40] == b"VBRI":
        n_bytes, n_frames = struct.unpack(">II", frame[46:54])
        n, _, size = struct.unpack(">HHH", frame[54:60])
        return "VBRI", n_frames, n_bytes, frame[62 : 62 + n * size]
    return None


def scan(data: bytes | None) -> dict:
    """Everything that ``parse_audio`` reports of a stream, with its frame bodies (what follows the side information)."""
    data = data or b""
    pos, tags = id3v2(data)
    end = len(data)
    tag = end - 128 if data[-128:-125] == b"TAG" and end - 128 >= pos else end  # a tag, unless these bytes lie in a frame
    offsets, bodies, seconds, kinds = [], [], {}, set()
    samples = crc_ok = crc_bad = skipped = 0
    low, high, vbr, kind, rate = 1 << 30, 0, None, None, 0
    while pos + 4 <= end:
        if pos == tag:
            end = tag
            break
        h = at_header(data, pos)
        after = pos + h[0] if h else 0
        if h and (kind is None or h[7] != kind or pos < tag < after):  # in doubt: the next header, the tag or the end must follow
            follows = at_header(data, after)
            if not (after in (tag, end) or after < end and follows and follows[7] == h[7]):
                h = None
        if not h or after > end:
            limit = tag if pos < tag else end
            found = data.find(b"\xff", pos + 1, limit)
            skipped += (found if found > 0 else limit) - pos
            pos = found if found > 0 else limit
            continue
        length, n, rate, layer, side, protected, kbits, kind = h
        frame = data[pos:after]
        if protected:
            if crc_holds(frame, layer, side):
                crc_ok += 1
            else:
                crc_bad += 1
        if not offsets and vbr is None and layer == 3 and (vbr := vbr_table(frame, side, protected)):
            pos = after  # the table's frame holds no sound
            continue
        offsets.append(pos)
        bodies.append(frame[4 + 2 * protected + side :])
        samples += n
        seconds[rate] = seconds.get(rate, 0) + n
        kinds.add(kind)
        low, high = min(low, kbits), max(high, kbits)
        pos = after
    if end == tag < len(data):
        tags["id3v1"] = data[tag + 3 : tag + 33].rstrip(b"\0 ").decode("latin-1")
    skipped += end - pos
    exact = sum((Fraction(n, hz) for hz, n in seconds.items()), Fraction(0))
    return {
        "n_frames": len(offsets), "samples": samples, "sample_rate": rate, "duration_num": exact.numerator,
        "duration_den": exact.denominator, "min_kbits": low if offsets else 0, "max_kbits": high, "crc_ok": crc_ok, "crc_bad": crc_bad,
        "skipped": skipped, "vbr": vbr[0] if vbr else None, "vbr_frames": vbr[1] if vbr else None, "tags": tags, "seek_offsets": offsets,
        "bodies": bodies,
    }


_SIDE = bytes(17)
_CAPACITY = [144_000 * k // 44100 - 23 for k in BITRATES[1, 3]]


@lru_cache(64)
def _silent(at: int) -> bytes:
    """Header, checksum and side information of a silent mono frame with the bit rate's index ``at``."""
    head = bytes((0xFF, 0xFA, at << 4, 0xC0))
    return head + crc16(head[2:] + _SIDE).to_bytes(2, "big") + _SIDE


def embed(payload: bytes, n_bytes: int) -> bytes:
    """``payload`` as MPEG-1 layer III; ``n_bytes``: its length without padding, noted in a tag."""
    frames, pos, top = [], 0, _CAPACITY[14]
    while pos < len(payload):
        left = len(payload) - pos
        at = 14 if left >= top else next(i for i in range(1, 15) if _CAPACITY[i] >= left)
        frames.append(_silent(at) + payload[pos : pos + _CAPACITY[at]].ljust(_CAPACITY[at], b"\0"))
        pos += _CAPACITY[at]
    size = sum(map(len, frames))
    ends, total = [0], 0
    for f in frames:
        ends.append(total := total + len(f))
    toc = bytes(min(255, 256 * ends[i * len(frames) // 100] // max(size, 1)) for i in range(100))
    table = b"Xing" + struct.pack(">III", 7, len(frames), size + 23 + _CAPACITY[5]) + toc
    text = b"\0payload_bytes\0%d" % n_bytes
    body = b"TXXX" + struct.pack(">I", len(text)) + b"\0\0" + text
    synch = bytes(len(body) >> s & 127 for s in (21, 14, 7, 0))
    return b"".join((b"ID3\3\0\0" + synch + body, _silent(5) + table.ljust(_CAPACITY[5], b"\0"), *frames))


def padded(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % 64 if raw else 64), len(raw)


def embed_payload(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and the column ``media``: every whole text, padded with zero bytes to a positive multiple of 64, as audio."""
    return per_row(docs, text, lambda t: (embed(*padded(t)),), [("media", pa.binary(), "binary")], list(keep))


AUDIO_FIELDS = [
    ("n_frames", pa.int64(), "bigint"), ("samples", pa.int64(), "bigint"), ("sample_rate", pa.int32(), "int"),
    ("duration_num", pa.int64(), "bigint"), ("duration_den", pa.int64(), "bigint"), ("min_kbits", pa.int32(), "int"),
    ("max_kbits", pa.int32(), "int"), ("crc_ok", pa.int64(), "bigint"), ("crc_bad", pa.int64(), "bigint"), ("skipped", pa.int64(), "bigint"),
    ("vbr", pa.string(), "string"), ("vbr_frames", pa.int64(), "bigint"), ("tags", pa.map_(pa.string(), pa.string()), "map<string,string>"),
    ("seek_offsets", pa.list_(pa.int64()), "array<bigint>"),
]


def _audio_row(data: bytes | None) -> tuple:
    got = scan(data)
    return tuple(list(got[n].items()) if n == "tags" else got[n] for n, *_ in AUDIO_FIELDS)


def parse_audio(df: DataFrame, media: str = "media", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Frames, exact duration (a fraction of seconds), tags, checksum counts and the byte offset of every frame."""
    return per_row(df, media, _audio_row, AUDIO_FIELDS, list(keep))


def _read_back(media: bytes) -> tuple:
    got = scan(media)
    n_bytes = int(got["tags"].get("payload_bytes", 0))
    payload = b"".join(got["bodies"])[: -(-n_bytes // 64) * 64 or 64]
    seeks = hashlib.sha256(struct.pack(f">{len(got['seek_offsets'])}Q", *got["seek_offsets"])).hexdigest()[:16]
    feature = ";".join(f"{k}={got[k]}" for k in ("n_frames", "samples", "sample_rate", "duration_num", "duration_den", "min_kbits", "max_kbits", "crc_ok", "crc_bad", "skipped", "vbr", "vbr_frames"))
    return (
        n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(),
        f"{feature};seek={seeks}", got["duration_num"], got["duration_den"], got["seek_offsets"],
    )


def audio_digests(media: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Reads what ``embed_payload`` stored: digests of the payload and of the stored form, and the stream's features."""
    long, text = (pa.int64(), "bigint"), (pa.string(), "string")
    fields = [("n_bytes", *long), ("payload_bytes", *long), ("payload_sha256", *text), ("tail_crc32", *long), ("media_bytes", *long), ("media_sha256", *text), ("feature", *text), ("duration_num", *long), ("duration_den", *long), ("seek_offsets", pa.list_(pa.int64()), "array<bigint>")]
    return per_row(media, "media", _read_back, fields, list(keep))


def op1_mpeg_audio(spark, sf_dir):
    from .common import table

    docs = table(spark, sf_dir, "documents")
    return audio_digests(embed_payload(docs.select(F.col("doc_id"), F.col("text"))))


#: The payload's columns of ``op1_mpeg_audio``.
PAYLOADS_SQL = r"""
WITH raw AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents), sized AS (SELECT *, octet_length(b) AS n FROM raw)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(greatest(64, (n + 63) // 64 * 64) AS BIGINT) AS payload_bytes, sha256(b || repeat('\x00'::BLOB, greatest(64, (n + 63) // 64 * 64) - n)) AS payload_sha256
FROM sized
"""
