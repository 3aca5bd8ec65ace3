"""Extents of films, and the frames of motion JPEG."""

from __future__ import annotations

import hashlib
import struct

from .. import dims
from . import extent
from .images import EOI
from .source import Source, Window

# Box types that show a file's structure.
BOXES = frozenset({
    b"ftyp", b"moov", b"mdat", b"free", b"skip", b"wide", b"uuid", b"meta", b"trak", b"mdia", b"minf", b"stbl", b"mvhd", b"tkhd", b"mdhd", b"hdlr", b"stsd",
    b"stts", b"stsc", b"stsz", b"stco", b"co64", b"udta", b"edts", b"dinf", b"vmhd", b"smhd", b"nmhd", b"elst", b"cmov", b"cmvd", b"dcom", b"jp2h", b"pnot", b"pict",
})
# Identifiers of EBML's header and segment, of ASF's header and data objects.
SEGMENT, EBML = b"\x18\x53\x80\x67", b"\x1a\x45\xdf\xa3"
ASF_HEADER = b"\x30\x26\xb2\x75\x8e\x66\xcf\x11\xa6\xd9\x00\xaa\x00\x62\xce\x6c"
ASF_DATA = b"\x36\x26\xb2\x75\x8e\x66\xcf\x11\xa6\xd9\x00\xaa\x00\x62\xce\x6c"
EBML_SEARCH, PS_READ, AVI_HEAD, FRAME_MAX = 8 * dims.MIB, 500 * dims.MIB, 256 * dims.KIB, 80 * dims.MIB


def boxes(src: Source, start: int, most: int):
    """(type, place, size, 0 if it runs to the end) of each sound box in a row."""
    at = 0
    while at < most:
        size, kind, head = src.num(start + at, ">I"), src.at(start + at + 4, 4), 8
        if size is None or len(kind) < 4:
            return
        if size == 1:
            size, head = src.num(start + at + 8, ">Q"), 16
        if size == 0:
            yield kind, at, 0
            return
        if size is None or size < head or size > most - at or not all(0x20 <= b <= 0x7E for b in kind):
            return
        yield kind, at, size
        at += size


@extent("isobmff_walk")
def isobmff_end(src: Source, start: int, most: int) -> int | None:
    """After the media data that follows another box, else after the last sound box; there must be a type box and known structure."""
    typed = known = False
    end = 0
    for i, (kind, at, size) in enumerate(boxes(src, start, most)):
        typed = typed or kind == b"ftyp"
        if not size:
            return start + most
        if kind in BOXES:
            known = True
        elif i and not known:
            break
        end = at + size
        if typed and known and i >= 1 and kind == b"mdat":
            return start + end
    return start + end if typed and known and end > 100 else None


def vint(src: Source, place: int, keep_marker: bool = False) -> tuple[int, int] | None:
    """(value, bytes) of an EBML variable-length number."""
    lead = src.at(place, 1)
    if not lead or not lead[0]:
        return None
    n = 9 - lead[0].bit_length()
    raw = src.at(place, n)
    if len(raw) < n:
        return None
    value = int.from_bytes(raw, "big")
    return (value if keep_marker else value & ((1 << 7 * n) - 1)), n


def _unknown(value: int, n: int) -> bool:
    return value == (1 << 7 * n) - 1


@extent("ebml_walk")
def ebml_end(src: Source, start: int, most: int) -> int | None:
    """After the segment, which may follow other elements; as far as allowed where its size is left open."""
    head = vint(src, start + 4)
    if src.at(start, 4) != EBML or head is None:
        return None
    at = 4 + head[1] + head[0]
    while at + 8 <= min(most, EBML_SEARCH):
        name = src.at(start + at, 4)
        kind = vint(src, start + at, True)
        size = vint(src, start + at + kind[1]) if kind else None
        if len(name) < 4 or size is None:
            return None
        if name == SEGMENT:
            if _unknown(*size):
                return start + most
            end = at + 4 + size[1] + size[0]
            return start + end if 0 < size[0] <= most and end > 1000 else None
        if _unknown(*size):
            return None
        at += kind[1] + size[1] + size[0]
    return None


@extent("flv_tags")
def flv_end(src: Source, start: int, most: int) -> int | None:
    """Where the row of audio, video and script tags ends."""
    offset = src.num(start + 5, ">I")
    if src.at(start, 3) != b"FLV" or offset is None or src.num(start + offset, ">I") is None:
        return None
    at = offset + 4
    while at < most:
        tag = src.at(start + at, 11)
        if len(tag) < 11 or tag[0] not in (8, 9, 18):
            return start + at
        at += 15 + int.from_bytes(tag[1:4], "big")
    return start + at if at > 100 else None


@extent("asf_header")
def asf_end(src: Source, start: int, most: int) -> int | None:
    """Header and data object, if the header's objects fill it exactly."""
    head = src.at(start, 30)
    if len(head) < 30 or head[:16] != ASF_HEADER:
        return None
    size, count, one, two = struct.unpack_from("<QIBB", head, 16)
    if not 30 <= size <= most or count < 1 or (one, two) != (1, 2):
        return None
    at = 30
    for _ in range(count):
        if at + 24 > size:
            break
        inner = src.num(start + at + 16, "<Q")
        if inner is None or inner < 24 or at + inner > size:
            return None
        at += inner
    data = src.num(start + size + 16, "<Q")
    if at != size or src.at(start + size, 16) != ASF_DATA or data is None or data < 50:
        return None
    return start + size + data if 1000 < size + data <= most else None


def ps_packet(b: bytes, i: int) -> int:
    """Bytes of the program-stream packet at i; 0 if there is no sound one."""
    if b[i : i + 3] != b"\x00\x00\x01" or i + 14 > len(b):
        return 0
    code = b[i + 3]
    set_bits = lambda *pairs: all(b[i + k] & mask == want for k, mask, want in pairs)
    if code == 0xBA:
        if set_bits((4, 0xC4, 0x44), (6, 4, 4), (8, 4, 4), (9, 1, 1), (12, 3, 3)):
            return 14 + (b[i + 13] & 7)
        return 12 if set_bits((4, 0xF1, 0x21), (6, 1, 1), (8, 1, 1), (9, 0x80, 0x80), (11, 1, 1)) else 0
    if code == 0xB9:
        return 4
    if code == 0xB3:
        return 12 if set_bits((10, 0x20, 0x20)) else 0
    if code == 0xB5:
        return 10
    if code == 0xB8:
        return 8 if set_bits((5, 0x40, 0x40)) else 0
    return 6 + int.from_bytes(b[i + 4 : i + 6], "big") if code == 0xBB or 0xBD <= code <= 0xEF else 0


@extent("mpeg_ps_scan")
def ps_end(src: Source, start: int, most: int) -> int | None:
    """After the end code, else after the last sound packet, if it is far enough for a film."""
    data, at = Window(src, start, min(most, PS_READ)), 0
    while size := ps_packet(data.at(at, 14), 0):
        if size > 14 and not data.at(at + size - 1, 1):
            break
        at += size
        if size == 4:
            return start + at
    return start + at if at > dims.VIDEO_MIN else None


def ts_stride(data: bytes, at: int) -> int | None:
    """188 or 192 where eight sync bytes stand so far apart."""
    if at + 8 * 192 > len(data):
        return None
    return next((s for s in (188, 192) if all(data[at + i * s] == 0x47 for i in range(8))), None)


def ts_end(src: Source, start: int, most: int, stride: int, least: int = dims.VIDEO_MIN) -> int | None:
    """Where the sync is lost; None unless beyond `least` bytes."""
    at, step = 0, stride * 4096
    while at < most:
        piece = src.at(start + at, min(step, most - at))
        syncs = piece[::stride]
        bad = next((i for i, x in enumerate(syncs) if x != 0x47), None)
        if bad is not None:
            at += bad * stride
            break
        at += len(piece)
        if len(piece) < step:
            break
    return start + at if at > least else None


def ftyp_format(src: Source, start: int) -> tuple[str, str, str]:
    """(format, extension, media) by the major brand, else the first known compatible one."""
    size, major = src.num(start, ">I"), src.at(start + 8, 4)
    if size is None or src.at(start + 4, 4) != b"ftyp" or len(major) < 4:
        return dims.DEFAULT_BRAND
    more = src.at(start + 16, min(max(size - 20, 0), 64))  # the last compatible brand isn't looked at: results depend on it
    for raw in [major, *(more[i : i + 4] for i in range(0, len(more) - 3, 4))]:
        name = raw.decode("ascii", "replace").strip("\x00")
        if name in dims.BRANDS:
            return dims.BRANDS[name]
    return dims.DEFAULT_BRAND


def riff_chunks(src: Source, at: int, stop: int):
    """(id, place, size) of the chunks in a row, sizes as they are stated."""
    while at + 8 <= stop:
        name, size = src.at(at, 4), src.num(at + 4, "<I")
        if size is None or len(name) < 4:
            return
        yield name, at, size
        at += 8 + size + size % 2


def avi_is_mjpeg(src: Source, start: int, stop: int) -> bool:
    """Whether a stream header within the first 256 KiB names a video handler of motion JPEG."""
    if src.at(start, 4) != b"RIFF" or src.at(start + 8, 4) != b"AVI ":
        return False
    waiting, last = [(start + 12, min(stop, start + AVI_HEAD))], min(stop, start + AVI_HEAD)
    while waiting:
        at, end = waiting.pop()
        for name, place, size in riff_chunks(src, at, end):
            if name == b"LIST" and src.at(place + 8, 4) != b"movi":
                waiting.append((place + 12, min(place + 8 + size, last)))
            elif name == b"strh" and size >= 8:
                body = src.at(place + 8, 8)
                if body[:4] == b"vids" and body[4:].lower() in dims.MJPEG_HANDLERS:
                    return True
    return False


def trim_jpeg(data: bytes) -> bytes:
    """Up to and with the last end-of-image marker; all of it if there is none."""
    at = data.rfind(EOI)
    return data if at < 0 else data[: at + 2]


def avi_frames(src: Source, size: int | None = None):
    """(index, offset, chunk size, jpeg size, sha256, is_jpeg) of each video chunk of an AVI's movi list.

    A chunk that claims more than there is ends the walk. Lists inside the movi list are entered. A JPEG is hashed
    without what follows its last end marker.
    """
    size = src.size if size is None else size
    if src.at(0, 4) != b"RIFF" or src.at(8, 4) != b"AVI ":
        return
    movi = None
    for name, at, length in riff_chunks(src, 12, size):
        if length > size - at:
            break
        if name == b"LIST" and src.at(at + 8, 4) == b"movi":
            movi = (at + 12, min(at + 8 + length, size))
            break
    if movi is None:
        return
    at, index = movi[0], 0
    while at < movi[1] - 8:
        name, length = src.at(at, 4), src.num(at + 4, "<I")
        if length is None or length > movi[1] - (at + 8):
            return
        if name == b"LIST":
            at += 12
            continue
        if name[:2].isdigit() and name[2:] in (b"dc", b"db") and length:
            data = src.at(at + 8, min(length, FRAME_MAX))
            if len(data) == length:
                is_jpeg = data[:2] == b"\xff\xd8"
                body = trim_jpeg(data) if is_jpeg else data
                yield index, at + 8, length, len(body), hashlib.sha256(body).hexdigest(), is_jpeg
            index += 1
        at += 8 + length + length % 2

