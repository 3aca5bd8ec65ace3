"""Extents, sizes and tags of pictures."""

from __future__ import annotations

import io
import struct

from .. import dims
from . import extent
from .source import Source, Window

EOI = b"\xff\xd9"
# Bits per sample that each PNG colour type allows; sizes of BMP headers, and bits per pixel.
PNG_DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}
BMP_HEADERS, BMP_DEPTHS = (12, 40, 52, 56, 108, 124), (1, 4, 8, 16, 24, 32)
GIF_READ = 32 * dims.MIB


@extent("jpeg_eoi")
def jpeg_end(src: Source, start: int, most: int) -> int | None:
    """After the first end-of-image marker."""
    found = src.find(EOI, start, start + most)
    return None if found < 0 else found + 2


def jpeg_ends(src: Source, start: int, most: int, tries: int = 9):
    """Ends at the first and the following markers: a thumbnail inside has one of its own."""
    at = start
    for _ in range(tries):
        at = src.find(EOI, at, start + most)
        if at < 0:
            return
        at += 2
        yield at


@extent("png_iend")
def png_end(src: Source, start: int, most: int) -> int | None:
    """After IEND, by a walk over chunks that starts with a sound IHDR."""
    if src.at(start, 8) != b"\x89PNG\r\n\x1a\n":
        return None
    at, first = start + 8, True
    while at + 12 <= start + most:
        length, kind = src.num(at, ">I"), src.at(at + 4, 4)
        if length is None or len(kind) < 4 or not kind.isalpha() or not kind.isascii() or at + 12 + length > start + most:
            return None
        if first != (kind == b"IHDR"):
            return None
        if first:
            body = src.at(at + 8, 13)
            if length != 13 or len(body) < 13:
                return None
            w, h, depth, colour, packing, filters, interlace = struct.unpack(">IIBBBBB", body)
            if not w or not h or depth not in PNG_DEPTHS.get(colour, ()) or packing or filters or interlace > 1:
                return None
        elif len(src.at(at + 8 + length, 4)) < 4:
            return None
        at, first = at + 12 + length, False
        if kind == b"IEND":
            return at if length == 0 else None
    return None


@extent("gif_trailer")
def gif_end(src: Source, start: int, most: int) -> int | None:
    """After the trailer, by a walk over extensions, images and their sub-blocks, read in blocks as far as the walk comes."""
    data = Window(src, start, min(most, GIF_READ))
    head = data.at(0, 13)
    if head[:6] not in (b"GIF87a", b"GIF89a") or len(head) < 13:
        return None
    palette = lambda flags: 3 << ((flags & 7) + 1) if flags & 0x80 else 0
    at = 13 + palette(head[10])
    while (kind := data.byte(at)) is not None:
        if kind == 0x3B:
            return start + at + 1
        if kind == 0x21:
            at += 2
        elif kind == 0x2C and len(data.at(at, 10)) == 10:
            at += 11 + palette(data.byte(at + 9))
        else:
            return None
        while size := data.byte(at):
            at += 1 + size
        at += 1
    return None


@extent("bmp_header")
def bmp_end(src: Source, start: int, most: int) -> int | None:
    """By the header's size, if its fields agree with one another."""
    head = src.at(start, 54)
    if head[:2] != b"BM" or len(head) < 30:
        return None
    size, pixels, kind = struct.unpack_from("<I4xII", head, 2)
    if not 100 <= size <= most or not 14 <= pixels < size or kind not in BMP_HEADERS:
        return None
    if kind >= 40 and len(head) >= 38:
        w, h, planes, depth, packing, payload = struct.unpack_from("<iiHHII", head, 18)
        if not w or not h or planes != 1 or depth not in BMP_DEPTHS or packing not in (0, 3, 6) or payload > most:
            return None
        plain = pixels + (abs(w) * depth + 31) // 32 * 4 * abs(h)
        if packing == 0 and size > max(3 * plain, plain + 2 * dims.MIB):
            return None
    return start + size


@extent("riff_size")
def riff_end(src: Source, start: int, most: int) -> int | None:
    size = src.num(start + 4, "<I")
    return start + size + 8 if size is not None and 100 <= size + 8 <= most else None


def tiff_order(src: Source, start: int) -> str | None:
    return {b"II": "<", b"MM": ">"}.get(src.at(start, 2))


def tiff_entries(src: Source, start: int, order: str, place: int, most_entries: int = 2000):
    """(tag, type, count, value, place of the value field) of a directory; then ('next', place of the next one)."""
    count = src.num(start + place, order + "H")
    if count is None or count > most_entries:
        return
    for i in range(count):
        raw = src.at(start + place + 2 + 12 * i, 12)
        if len(raw) < 12:
            return
        yield (*struct.unpack(order + "HHII", raw), place + 2 + 12 * i + 8)
    following = src.num(start + place + 2 + 12 * count, order + "I")
    if following:
        yield ("next", 0, 1, following, 0)


@extent("tiff_ifd")
def tiff_end(src: Source, start: int, most: int) -> int | None:
    """The greatest offset that any directory names, and a tenth (1 MiB at most) for the last strip."""
    order, first = tiff_order(src, start), None
    if order:
        first = src.num(start + 4, order + "I")
    if first is None:
        return None
    far, waiting, seen = first, [first], set()
    while waiting:
        place = waiting.pop()
        if place in seen or not 8 <= place <= most:
            continue
        seen.add(place)
        for tag, kind, count, value, _ in tiff_entries(src, start, order, place):
            if tag == "next":
                waiting.append(value)
                continue
            if tag in (273, 279, 324, 325):  # strips and tiles
                if count == 1:
                    far = max(far, value)
                elif count > 1 and value < most:
                    raw = src.at(start + value, 4 * min(count, 5000))
                    far = max(far, *struct.unpack(f"{order}{len(raw) // 4}I", raw[: len(raw) // 4 * 4]), 0)
            if tag in (330, 34665, 34853) and count == 1 and value:
                waiting.append(value)
            if kind in (3, 4) and count == 1 and value < most:
                far = max(far, value)
    total = far + min(far // 10, dims.MIB)
    return start + total if total > 1000 else None


@extent("raf_header")
def raf_end(src: Source, start: int, most: int) -> int | None:
    """By place and length of the raw data; a MiB where the header is cut short."""
    if len(src.at(start + 84, 12)) < 12:
        return None
    place, length = src.num(start + 100, ">I"), src.num(start + 104, ">I")
    if place is None or length is None:
        return start + dims.MIB
    return start + place + length if place + length > 1000 else None


def tiff_format(src: Source, start: int) -> tuple[str, str]:
    """(format, extension) of a TIFF: by the raw marker, else by the first known make in its Make tag."""
    plain, order = ("TIFF", "tif"), tiff_order(src, start)
    first = src.num(start + 4, order + "I") if order else None
    if first is None:
        return plain
    if src.at(start + 8, 2) == b"CR":
        return "CR2", "cr2"
    if first > 10 * dims.MIB:
        return plain
    for tag, _, count, value, field in tiff_entries(src, start, order, first, 1000):
        if tag == 0x010F:
            raw = src.at(start + (field if count <= 4 else value), min(count, 64))
            make = raw.decode("ascii", "replace").strip("\x00").lower()
            return next(((f, e) for key, f, e in dims.MAKES if key.lower() in make), plain)
    return plain


def jpeg_frame(data: bytes) -> tuple[int, int, bool] | None:
    """(width, height, progressive) from the first start-of-frame segment."""
    data, at = bytes(data), 2
    if data[:2] != b"\xff\xd8":
        return None
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            at += 1
            continue
        mark = data[at + 1]
        if mark == 0xFF:
            at += 1
        elif mark in (0x00, 0x01) or 0xD0 <= mark <= 0xD8:
            at += 2
        elif mark in (0xD9, 0xDA):
            return None
        elif 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            if at + 9 > len(data):
                return None
            h, w = struct.unpack_from(">HH", data, at + 5)
            return (w, h, mark in (0xC2, 0xC6, 0xCA, 0xCE)) if w and h else None
        else:
            at += 2 + max(2, struct.unpack_from(">H", data, at + 2)[0])
    return None


def exif_facts(data: bytes) -> dict:
    """Make, model and times from a JPEG's EXIF segment, and what they say. Never raises: unreadable parts are left out."""
    out = {"exif_readable": False, "camera_make": None, "camera_model": None, "datetime_original": None, "datetime": None}
    data = bytes(data)
    if data[:2] == b"\xff\xd8":
        out["exif_readable"], at = True, 2
        while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] not in (0xDA, 0xD9):
            length = struct.unpack_from(">H", data, at + 2)[0]
            if data[at + 1] == 0xE1 and data[at + 4 : at + 10] == b"Exif\x00\x00":
                out |= _tags(Source(data[at + 10 : at + 2 + length]))
                break
            at += 2 + max(2, length)
    out["has_camera_identity"] = bool(out["camera_make"] or out["camera_model"])
    out["has_timestamp"] = bool(out["datetime_original"] or out["datetime"])
    return out


def _tags(src: Source) -> dict:
    order, out = tiff_order(src, 0), {}
    first = src.num(4, order + "I") if order else None
    names = {0x010F: "camera_make", 0x0110: "camera_model", 0x9003: "datetime_original", 0x0132: "datetime"}
    waiting, seen = [first], set()
    while waiting and len(seen) < 16:
        place = waiting.pop()
        if place is None or place in seen:
            continue
        seen.add(place)
        for tag, kind, count, value, field in tiff_entries(src, 0, order, place):
            if tag == 0x8769:
                waiting.append(value)
            elif tag in names and kind == 2:
                text = src.at(field if count <= 4 else value, min(count, 4096)).decode("latin-1").strip("\x00 ")
                out[names[tag]] = text or None
    return out


def is_valid_jpeg(data: bytes, least: int = 0, decode: bool = False) -> bool:
    """Whether segments follow one another up to scans whose entropy-coded data ends exactly with the data, and the picture has sides of `least` or more.

    An end marker inside a segment (a thumbnail's) or a cut-off scan fails, and so does another picture's start: it has no length, so nothing may be skipped by it. decode: Pillow, where it is installed, must also read the picture whole, without a grey tail.
    """
    frame, at, n, scans = jpeg_frame(data), 2, len(data), 0
    if frame is None or min(frame[:2]) < least:
        return False
    while at + 2 <= n and data[at] == 0xFF:
        mark = data[at + 1]
        if mark == 0xFF:
            at += 1
        elif mark == 0xD9:
            return at + 2 == n and scans > 0 and (not decode or _decodes(data, least))
        elif mark == 0xD8:
            return False
        elif mark == 0x01 or 0xD0 <= mark <= 0xD7:
            at += 2
        else:
            if at + 4 > n:
                return False
            at += 2 + max(2, struct.unpack_from(">H", data, at + 2)[0])
            if mark == 0xDA:
                scans += 1
                at = _scan_end(data, at)
    return False


def _scan_end(data: bytes, at: int) -> int:
    """The first marker from `at` on that ends entropy-coded data."""
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            return len(data)
        if data[at + 1] and not 0xD0 <= data[at + 1] <= 0xD7:
            return at
        at += 2


def _decodes(data: bytes, least: int) -> bool:
    try:
        from PIL import Image
    except ImportError:
        return True
    try:
        with Image.open(io.BytesIO(data)) as picture:
            grey = picture.convert("L")
            w, h = grey.size
            rows = [bytes(grey.crop((0, y, w, y + 1)).tobytes()[:: max(1, w // 10)]) for y in range(h - max(1, h // 20), h)]
            return min(w, h) >= least and not has_grey_tail(rows)
    except Exception:
        return False


def has_grey_tail(rows: list[bytes]) -> bool:
    """Whether over half of the last rows (grey bytes) hold nothing but 125..131, as decoders fill what is missing."""
    flat = [bool(r) and all(125 <= x <= 131 for x in r) for r in rows]
    return bool(flat) and 2 * sum(flat) > len(flat)
