"""Width, height and color mode from the first structures of an image file."""

from __future__ import annotations

import struct

# Color modes by PNG color type and by TIFF photometric/sample count.
PNG_MODES = {0: "L", 2: "RGB", 3: "P", 4: "LA", 6: "RGBA"}
TIFF_MODES = {(0, 1): "L", (1, 1): "L", (2, 3): "RGB", (2, 4): "RGBA", (3, 1): "P", (5, 4): "CMYK"}
JPEG_MODES = {1: "L", 3: "RGB", 4: "CMYK"}

Meta = tuple[int, int, str]


def _png(b: bytes) -> Meta:
    length, kind, width, height, depth, color = struct.unpack(">I4sIIBB", b[8:26])
    if kind != b"IHDR" or length != 13 or not width or not height:
        raise ValueError("bad PNG header")
    mode = PNG_MODES[color]
    if color == 0:
        mode = {1: "1", 16: "I;16"}.get(depth, "L")
    return width, height, mode


def _jpeg(b: bytes) -> Meta:
    at = 2
    while at + 9 < len(b):
        if b[at] != 0xFF:
            raise ValueError("bad JPEG marker")
        marker = b[at + 1]
        if marker == 0xFF:  # fill byte
            at += 1
        elif 0xD0 <= marker <= 0xD9 or marker == 0x01:
            at += 2
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            height, width, parts = struct.unpack(">HHB", b[at + 5 : at + 10])
            return width, height, JPEG_MODES[parts]
        else:
            at += 2 + struct.unpack(">H", b[at + 2 : at + 4])[0]
    raise ValueError("no JPEG frame")


def _gif(b: bytes) -> Meta:
    width, height = struct.unpack("<HH", b[6:10])
    return width, height, "P"


def _bmp(b: bytes) -> Meta:
    size = struct.unpack("<I", b[14:18])[0]
    if size == 12:
        width, height, _, bits = struct.unpack("<HHHH", b[18:26])
    else:
        width, height, _, bits = struct.unpack("<iiHH", b[18:30])
    mode = {1: "1", 4: "P", 8: "P", 16: "RGB", 24: "RGB", 32: "RGB"}[bits]
    return abs(width), abs(height), mode


def _webp(b: bytes) -> Meta:
    kind = b[12:16]
    if kind == b"VP8 ":
        width, height = struct.unpack("<HH", b[26:30])
        return width & 0x3FFF, height & 0x3FFF, "RGB"
    if kind == b"VP8L":
        bits = struct.unpack("<I", b[21:25])[0]
        return (bits & 0x3FFF) + 1, ((bits >> 14) & 0x3FFF) + 1, "RGBA" if bits >> 28 & 1 else "RGB"
    if kind == b"VP8X":
        width = int.from_bytes(b[24:27], "little") + 1
        height = int.from_bytes(b[27:30], "little") + 1
        return width, height, "RGBA" if b[20] & 0x10 else "RGB"
    raise ValueError("unknown WebP chunk")


def _tiff(b: bytes) -> Meta:
    order = "<" if b[:2] == b"II" else ">"
    at = struct.unpack(order + "I", b[4:8])[0]
    tags = {}
    for i in range(struct.unpack(order + "H", b[at : at + 2])[0]):
        entry = b[at + 2 + 12 * i : at + 14 + 12 * i]
        tag, kind, count = struct.unpack(order + "HHI", entry[:8])
        wide = {1: "B", 3: "H", 4: "I"}.get(kind)
        if wide:
            if struct.calcsize(wide) * count <= 4:
                tags[tag] = struct.unpack(order + wide, entry[8 : 8 + struct.calcsize(wide)])[0]
            else:
                where = struct.unpack(order + "I", entry[8:12])[0]
                tags[tag] = struct.unpack(order + wide, b[where : where + struct.calcsize(wide)])[0]
    mode = TIFF_MODES[(tags.get(262, 1), tags.get(277, 1))]
    return tags[256], tags[257], "1" if mode == "L" and tags.get(258, 1) == 1 else mode


def read_header(b: bytes | None) -> Meta | None:
    """(width, height, mode), or None for anything that is not a readable image."""
    try:
        if b[:8] == b"\x89PNG\r\n\x1a\n":
            return _png(b)
        if b[:2] == b"\xff\xd8":
            return _jpeg(b)
        if b[:6] in (b"GIF87a", b"GIF89a"):
            return _gif(b)
        if b[:2] == b"BM":
            return _bmp(b)
        if b[:4] == b"RIFF" and b[8:12] == b"WEBP":
            return _webp(b)
        if b[:4] in (b"II*\x00", b"MM\x00*"):
            return _tiff(b)
    except (TypeError, ValueError, KeyError, IndexError, struct.error):
        pass
    return None
