"""Pixel values of image files as numpy arrays: PNG and uncompressed TIFF, 8 and 16 bits, gray and colour."""

from __future__ import annotations

import struct
import zlib

import numpy as np

PNG = b"\x89PNG\r\n\x1a\n"
_SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}       # fixed values: samples of a pixel for each colour type


def luminance(rgb: np.ndarray) -> np.ndarray:
    """Gray value of ``(..., 3)`` colours, in the usual integer weights for red, green and blue."""
    r, g, b = (rgb[..., k].astype(np.int64) for k in range(3))
    return ((19595 * r + 38470 * g + 7471 * b + 32768) >> 16).astype(np.int32)


def gray(pixels: np.ndarray) -> np.ndarray:
    """``(h, w)`` gray values from ``(h, w, samples)``; an alpha sample is left out."""
    return luminance(pixels) if pixels.shape[2] >= 3 else pixels[..., 0].astype(np.int32)


def decode(content: bytes) -> np.ndarray:
    """``(h, w)`` gray values; ValueError for what is broken or of another make."""
    try:
        if content.startswith(PNG):
            return gray(_png(content))
        if content[:4] in (b"II*\0", b"MM\0*"):
            return gray(_tiff(content))
    except (struct.error, zlib.error, IndexError, KeyError, TypeError) as broken:
        raise ValueError(f"damaged image: {broken}") from broken
    raise ValueError("neither PNG nor TIFF")


def _png(content: bytes) -> np.ndarray:
    at, data, palette = len(PNG), [], None
    width = height = bits = colour = None
    while at < len(content):
        size, tag = struct.unpack_from(">I4s", content, at)
        body = content[at + 8 : at + 8 + size]
        if len(body) < size:
            raise ValueError("truncated image")
        if tag == b"IHDR":
            width, height, bits, colour, _, _, interlaced = struct.unpack(">IIBBBBB", body)
            if interlaced:
                raise ValueError("interlaced PNG is not read")
        elif tag == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif tag == b"IDAT":
            data.append(body)
        at += size + 12
    samples = _SAMPLES[colour]
    step, line = max(1, samples * bits // 8), (width * samples * bits + 7) // 8
    rows = _unfilter(np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, line + 1), step)
    if bits == 16:
        values = rows.view(">u2").astype(np.int32)
    elif bits == 8:
        values = rows
    else:
        values = np.unpackbits(rows, axis=1).reshape(height, -1, bits)[:, : width * samples]
        values = values @ (1 << np.arange(bits - 1, -1, -1))
        values = values if colour == 3 else values * 255 // ((1 << bits) - 1)
    values = values.reshape(height, width, samples)
    return palette[values[..., 0]] if colour == 3 else values


def _unfilter(rows: np.ndarray, step: int) -> np.ndarray:
    kinds, out = rows[:, 0], rows[:, 1:].copy()
    above = np.zeros(out.shape[1], np.uint8)
    for kind, row in zip(kinds, out, strict=True):
        if kind == 1:
            for c in range(step):
                row[c::step] = np.cumsum(row[c::step], dtype=np.uint8)
        elif kind == 2:
            row += above
        elif kind in (3, 4):
            line, up = row.tolist(), above.tolist()
            for i, v in enumerate(line):
                a, b, c = (line[i - step] if i >= step else 0), up[i], (up[i - step] if i >= step else 0)
                if kind == 3:
                    guess = (a + b) >> 1
                else:
                    pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
                line[i] = (v + guess) & 255
            row[:] = line
        elif kind:
            raise ValueError(f"unknown row filter {kind}")
        above = row
    return out


def _tiff(content: bytes) -> np.ndarray:
    order = "<" if content[:2] == b"II" else ">"
    first = struct.unpack_from(f"{order}I", content, 4)[0]
    tags = {}
    for k in range(struct.unpack_from(f"{order}H", content, first)[0]):
        tag, kind, count = struct.unpack_from(f"{order}HHI", content, first + 2 + 12 * k)
        size, code = {1: (1, "B"), 3: (2, "H"), 4: (4, "I")}.get(kind, (0, ""))
        if size:
            at = first + 10 + 12 * k
            at = at if size * count <= 4 else struct.unpack_from(f"{order}I", content, at)[0]
            tags[tag] = struct.unpack_from(f"{order}{count}{code}", content, at)
    width, height, bits, samples = tags[256][0], tags[257][0], tags.get(258, (1,))[0], tags.get(277, (1,))[0]
    if tags.get(259, (1,))[0] != 1 or bits not in (8, 16) or 273 not in tags or tags.get(284, (1,))[0] != 1:
        raise ValueError("only uncompressed TIFF in strips of 8 or 16 bits is read")
    raw = b"".join(content[at : at + n] for at, n in zip(tags[273], tags[279], strict=True))
    return np.frombuffer(raw, np.dtype("u1" if bits == 8 else f"{order}u2"), width * height * samples).reshape(height, width, samples)
