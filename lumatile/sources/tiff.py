"""Baseline TIFF, uncompressed, of one sample per pixel: reading tiles, writing image stacks of several pages."""

from __future__ import annotations

import struct

import numpy as np

#: Tags and field sizes by type (fixed values of the format).
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, DESCRIPTION, OFFSETS, SAMPLES, ROWS, COUNTS, FORMAT = 256, 257, 258, 259, 262, 270, 273, 277, 278, 279, 339
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 16: 8}
CODES = {1: "B", 3: "H", 4: "I", 16: "Q"}
KINDS = {1: "u", 2: "i", 3: "f"}


def read_pages(raw: bytes) -> list[np.ndarray]:
    """All pages; ValueError for what isn't baseline."""
    order = {b"II": "<", b"MM": ">"}.get(raw[:2])
    if order is None or struct.unpack_from(order + "H", raw, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    at, pages = struct.unpack_from(order + "I", raw, 4)[0], []
    while at:
        (n,) = struct.unpack_from(order + "H", raw, at)
        tags = {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", raw, at + 2 + 12 * k)
            if kind in CODES:
                place = at + 10 + 12 * k
                if SIZES[kind] * count > 4:
                    (place,) = struct.unpack_from(order + "I", raw, place)
                tags[tag] = struct.unpack_from(f"{order}{count}{CODES[kind]}", raw, place)
        if tags.get(COMPRESSION, (1,))[0] != 1 or tags.get(SAMPLES, (1,))[0] != 1:
            raise ValueError("compressed files and colour need a decode function of their own")
        data = b"".join(raw[o : o + c] for o, c in zip(tags[OFFSETS], tags[COUNTS], strict=True))
        kind = np.dtype(f"{order}{KINDS[tags.get(FORMAT, (1,))[0]]}{tags[BITS][0] // 8}")
        pages.append(np.frombuffer(data, kind).reshape(tags[HEIGHT][0], tags[WIDTH][0]))
        (at,) = struct.unpack_from(order + "I", raw, at + 2 + 12 * n)
    return pages


def write_pages(pages: list[np.ndarray]) -> bytes:
    """Pages of whole numbers or float32, little-endian, one strip each."""
    out, link = bytearray(b"II*\0\0\0\0\0"), 4
    for a in pages:
        a = np.ascontiguousarray(a).astype(a.dtype.newbyteorder("<"))
        data = len(out)
        out += a.tobytes()
        out += b"\0" * (len(out) % 2)
        struct.pack_into("<I", out, link, len(out))
        form = {"u": 1, "i": 2, "f": 3}[a.dtype.kind]
        entries = [(WIDTH, 4, a.shape[1]), (HEIGHT, 4, a.shape[0]), (BITS, 3, a.dtype.itemsize * 8), (COMPRESSION, 3, 1), (PHOTOMETRIC, 3, 1), (OFFSETS, 4, data), (SAMPLES, 3, 1), (ROWS, 4, a.shape[0]), (COUNTS, 4, a.nbytes), (FORMAT, 3, form)]
        out += struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHI", t, k, 1) + (struct.pack("<HH", v, 0) if k == 3 else struct.pack("<I", v)) for t, k, v in sorted(entries))
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)
