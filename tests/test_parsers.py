"""Extent parsers, sizes and frames on bytes built by hand."""

import hashlib
import struct

import pytest

from lacuna import dims
from lacuna.functions.bytes import entropy_of
from lacuna.parsers import find_end, images, videos
from lacuna.parsers.source import Source
from lacuna.plans.streams import tiny_avi, tiny_jpeg, tiny_png

BIG = 1 << 30


def test_jpeg():
    data = tiny_jpeg(640, 480, True, b"\x01" * 300_000)
    assert find_end("jpeg_eoi", b"\x00" * 7 + data + b"\x22" * 9, 7, BIG) == 7 + len(data)
    assert find_end("jpeg_eoi", data[:-2], 0, BIG) is None
    assert images.jpeg_frame(data) == (640, 480, True)
    assert images.jpeg_frame(tiny_jpeg(1, 1)) == (1, 1, False)
    assert images.jpeg_frame(b"\xff\xd8\xff\xd9") is None
    assert list(images.jpeg_ends(Source(b"..\xff\xd9.\xff\xd9"), 0, 100)) == [4, 7]
    seam = b"\xff\xd8" + b"\x00" * ((256 << 10) - 3) + b"\xff\xd9"  # marker across the seam of two reads
    assert find_end("jpeg_eoi", seam, 0, BIG) == len(seam)


def test_a_cut_off_picture_does_not_end_in_the_next_ones():
    head = tiny_jpeg(64, 48)[:-2]
    assert images.is_valid_jpeg(head + b"\xff\xd9")
    # the next picture's start, read as a segment, would be 0xFFE0 bytes long and lead right to the last end marker
    following = b"\xff\xd8\xff\xe0" + bytes(2 + 0xFFE0 - 4) + b"\xff\xd9"
    assert not images.is_valid_jpeg(head + bytes(32) + following)
    assert not images.is_valid_jpeg(b"\xff\xd8\xff\xd8" + head[2:] + b"\xff\xd9")


def test_png():
    data = tiny_png(b"abc")
    assert find_end("png_iend", data + b"tail", 0, BIG) == len(data)
    assert find_end("png_iend", data[:-4], 0, BIG) is None
    broken = bytearray(data)
    broken[16:20] = b"\x00" * 4  # width 0
    assert find_end("png_iend", bytes(broken), 0, BIG) is None


def test_gif():
    head = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + b"\x00" * 6
    image = b"\x2c" + b"\x00" * 8 + b"\x00" + b"\x02" + b"\x02ab\x00"
    data = head + b"\x21\xf9\x04....\x00" + image + b"\x3b"
    assert find_end("gif_trailer", data + b"zz", 0, BIG) == len(data)
    assert find_end("gif_trailer", head + b"\x7f\x3b", 0, BIG) is None


def test_bmp_and_riff():
    def bmp(size, planes=1):
        return b"BM" + struct.pack("<I4xII", size, 54, 40) + struct.pack("<iiHHII", 10, -10, planes, 24, 0, 0) + b"\x00" * 16 + b"\x00" * 320

    assert find_end("bmp_header", bmp(374), 0, BIG) == 374
    assert find_end("bmp_header", bmp(374, 2), 0, BIG) is None
    assert find_end("bmp_header", bmp(90 << 20), 0, BIG) is None  # far more than its pixels
    avi = tiny_avi([tiny_jpeg(2, 2)])
    assert find_end("riff_size", avi, 0, BIG) == len(avi)
    assert find_end("riff_size", b"RIFF\x08\x00\x00\x00AVI ", 0, BIG) is None


def test_isobmff():
    box = lambda kind, body: struct.pack(">I", len(body) + 8) + kind + body
    ftyp = box(b"ftyp", b"isom" + b"\x00" * 12)
    assert find_end("isobmff_walk", ftyp + box(b"moov", b"\x00" * 100), 0, BIG) == len(ftyp) + 108
    assert find_end("isobmff_walk", ftyp + box(b"mdat", b"\x00" * 50) + box(b"moov", b""), 0, BIG) == len(ftyp) + 58
    assert find_end("isobmff_walk", ftyp + b"\x00\x00\x00\x10\x01\x02\x03\x04" + b"\x00" * 8, 0, BIG) is None
    assert videos.ftyp_format(Source(box(b"ftyp", b"qt  \x00\x00\x00\x00")), 0) == ("MOV", "mov", "video")
    assert videos.ftyp_format(Source(box(b"ftyp", b"xxxx\x00\x00\x00\x00heicmif1")), 0) == ("HEIC", "heic", "photo")
    assert videos.ftyp_format(Source(b""), 0) == dims.DEFAULT_BRAND


def test_ebml():
    head = b"\x1a\x45\xdf\xa3\x80"
    assert find_end("ebml_walk", head + b"\xec\x81\x00" + b"\x18\x53\x80\x67\xff" + b"\x00" * 64, 0, 77) == 77
    sized = head + b"\x18\x53\x80\x67" + struct.pack(">H", 0x4000 | 2000) + b"\x00" * 2000
    assert find_end("ebml_walk", sized, 0, BIG) == len(sized)
    assert find_end("ebml_walk", head + b"\xec\xff", 0, BIG) is None


def test_flv_asf_ps_ts():
    tag = lambda n: b"\x09" + n.to_bytes(3, "big") + b"\x00" * 7 + b"\x00" * (n + 4)
    flv = b"FLV\x01\x05" + struct.pack(">I", 9) + b"\x00" * 4 + tag(100) + tag(50)
    assert find_end("flv_tags", flv + b"\x55" * 20, 0, BIG) == len(flv)
    inner = b"\x11" * 16 + struct.pack("<Q", 24)
    asf = videos.ASF_HEADER + struct.pack("<QIBB", 54, 1, 1, 2) + inner + videos.ASF_DATA + struct.pack("<Q", 2000)
    assert find_end("asf_header", asf, 0, BIG) == 2054
    assert find_end("asf_header", asf.replace(struct.pack("<QIBB", 54, 1, 1, 2), struct.pack("<QIBB", 54, 1, 1, 3)), 0, BIG) is None
    assert find_end("mpeg_ps_scan", b"\x00\x00\x01\xba" + b"\x00" * 256, 0, BIG) is None
    pack = b"\x00\x00\x01\xba\x44\x00\x04\x00\x04\x01\x00\x00\x03\x00"
    ps = pack + b"\x00\x00\x01\xe0" + struct.pack(">H", 100) + b"\x00" * 100 + b"\x00\x00\x01\xb9"
    assert find_end("mpeg_ps_scan", ps + b"\x00" * 20, 0, BIG) == len(ps)
    ts = (b"\x47" + b"\x00" * 187) * 400
    assert videos.ts_stride(ts, 0) == 188
    assert videos.ts_end(Source(ts + b"\x00" * 5000), 0, BIG, 188) == len(ts)
    assert videos.ts_end(Source(ts[: 188 * 20]), 0, BIG, 188) is None


def test_tiff_and_raf():
    make = b"NIKON CORPORATION\x00"
    ifd = struct.pack("<H", 2) + struct.pack("<HHII", 0x010F, 2, len(make), 60) + struct.pack("<HHII", 273, 4, 1, 50_000) + struct.pack("<I", 0)
    data = b"II\x2a\x00" + struct.pack("<I", 8) + ifd
    data += b"\x00" * (60 - len(data)) + make
    assert images.tiff_format(Source(data), 0) == ("NEF", "nef")
    assert find_end("tiff_ifd", data, 0, BIG) == 55_000
    assert images.tiff_format(Source(b"II\x2a\x00\x10\x00\x00\x00CR"), 0) == ("CR2", "cr2")
    loop = b"MM\x00\x2a\x00\x00\x00\x08" + struct.pack(">H", 0) + struct.pack(">I", 8)  # a directory that is its own successor
    assert find_end("tiff_ifd", loop, 0, BIG) is None
    raf = b"FUJIFILMCCD-RAW ".ljust(100, b"\x00") + struct.pack(">II", 2000, 3000)
    assert find_end("raf_header", raf, 0, BIG) == 5000


@pytest.mark.parametrize(("handler", "want"), [(b"MJPG", True), (b"mjpg", True), (b"XVID", False)])
def test_avi_handler(handler, want):
    data = tiny_avi([tiny_jpeg(2, 2)], handler)
    assert videos.avi_is_mjpeg(Source(data), 0, len(data)) is want


def test_avi_frames():
    a, b = tiny_jpeg(2, 2, body=b"x"), tiny_jpeg(4, 4, body=b"yy")
    got = list(videos.avi_frames(Source(tiny_avi([a + b"pad!", b"raw", b]))))
    assert [(g[0], g[3], g[5]) for g in got] == [(0, len(a), True), (1, 3, False), (2, len(b), True)]
    assert got[0][4] == hashlib.sha256(a).hexdigest()
    assert list(videos.avi_frames(Source(b"RIFF"))) == []
    assert videos.trim_jpeg(b"a\xff\xd9b\xff\xd9ccc") == b"a\xff\xd9b\xff\xd9" and videos.trim_jpeg(b"abc") == b"abc"


def test_exif_and_entropy():
    text = b"Maker\x00"
    tiff = b"II\x2a\x00\x08\x00\x00\x00" + struct.pack("<H", 1) + struct.pack("<HHII", 0x010F, 2, len(text), 26) + struct.pack("<I", 0) + text
    data = b"\xff\xd8\xff\xe1" + struct.pack(">H", len(tiff) + 8) + b"Exif\x00\x00" + tiff + b"\xff\xd9"
    facts = images.exif_facts(data)
    assert facts["camera_make"] == "Maker" and facts["has_camera_identity"] and not facts["has_timestamp"]
    assert not images.exif_facts(b"")["exif_readable"] and not images.exif_facts(b"\xff\xd8\xff\xe1")["has_timestamp"]
    assert entropy_of(b"") == 0.0 and entropy_of(b"aaaa") == 0.0 and entropy_of(bytes(range(256))) == 8.0
    assert images.has_grey_tail([bytes([128] * 9)] * 3) and not images.has_grey_tail([bytes([1] * 9)] * 3) and not images.has_grey_tail([])


@pytest.mark.parametrize("strategy", ["jpeg_eoi", "png_iend", "gif_trailer", "bmp_header", "riff_size", "isobmff_walk", "ebml_walk", "flv_tags", "asf_header", "mpeg_ps_scan", "tiff_ifd", "raf_header"])
def test_cut_short_input_never_fails(strategy):
    import random

    r = random.Random(5)
    heads = [s.magic for s in dims.SIGNATURES if s.strategy == strategy] + [b"\x00\x00\x00\x18ftypisom"]
    for head in heads:
        for n in (0, 1, 5, 12, 40, 200):
            end = find_end(strategy, (head + r.randbytes(n))[: len(head) + n], 0, 4096)
            assert end is None or end > 0


class Counted(Source):
    """Counts the bytes that are asked for."""

    asked = 0

    def at(self, place, n):
        self.asked += n
        return super().at(place, n)


def test_walks_read_what_they_cover():
    """A GIF or program stream of a few KB in front of 40 MB costs a few blocks, sound or not; walks go on over block borders."""
    blocks = b"\xff" + b"x" * 255
    gif = b"GIF89a\x01\x00\x01\x00\x00\x00\x00\x2c" + bytes(9) + b"\x02" + blocks * 200 + b"\x00\x3b"
    ps = b"\x00\x00\x01\xba\x44\x00\x04\x00\x04\x01\x00\x00\x03\xf8" + (b"\x00\x00\x01\xe0" + struct.pack(">H", 9000) + b"y" * 9000) * 8
    for strategy, data, ends in (("gif_trailer", gif, len(gif)), ("gif_trailer", gif[:13] + b"\x99", None), ("mpeg_ps_scan", ps + b"\x00\x00\x01\xb9", len(ps) + 4), ("mpeg_ps_scan", ps, len(ps)), ("mpeg_ps_scan", ps[:14], None)):
        src = Counted(data + bytes(40 << 20))
        assert find_end(strategy, src, 0, BIG) == ends
        assert src.asked <= 3 * len(data) + (64 << 10)
    cut = ps[:-10]  # the last packet claims more than there is
    assert find_end("mpeg_ps_scan", cut, 0, BIG) == len(ps) - 9006
    assert find_end("gif_trailer", gif[:-1], 0, BIG) is None and find_end("gif_trailer", gif, 0, len(gif) - 1) is None


def test_starts_are_found_where_they_overlap():
    from lacuna.plans.carve import LOOK_AHEAD, starts_in

    sync = (b"\x47" + bytes(187)) * 9
    data = b"..\xff\xd8\xff\xd8\xff\xe0" + b"\x00\x00\x00\x18ftypisom" + b"BM" + sync + b"ftyp" + bytes(LOOK_AHEAD)
    typed, bm = data.find(b"ftyp") - 4, data.find(b"BM")
    assert list(starts_in(data, len(data) - LOOK_AHEAD)) == [2, 4, typed, bm, bm + 2, bm + 190, len(data) - LOOK_AHEAD - 8]
    assert list(starts_in(data, typed)) == [2, 4] and list(starts_in(b"", 5)) == [] and list(starts_in(b"BM", 2)) == [0] and list(starts_in(b"ftyp", 4)) == []
