"""PNG files of eight bits a channel as arrays of height x width x channels (grey, red-green-blue, with alpha, or a palette)."""

from __future__ import annotations

import struct
import zlib

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Channels by the format's colour type.
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def encode(pixels: np.ndarray) -> bytes:
    """A file of an array with 1, 3 or 4 channels."""
    height, width, channels = pixels.shape
    kind = {1: 0, 3: 2, 4: 6}[channels]
    rows = np.zeros((height, 1 + width * channels), np.uint8)  # every row begins with its filter, none
    rows[:, 1:] = pixels.reshape(height, -1)
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    header = struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def decode(data: bytes) -> np.ndarray:
    """The pixels of a file; a palette becomes red, green, blue. Interlaced files and other depths are an error."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG file")
    at, packed, palette, header = 8, [], None, None
    while at < len(data):
        size, name = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if name == b"IHDR":
            header = struct.unpack(">IIBBBBB", body)
        elif name == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif name == b"IDAT":
            packed.append(body)
        at += 12 + size
    width, height, depth, kind, _, _, interlaced = header
    if depth != 8 or interlaced:
        raise ValueError("only eight bits a channel, not interlaced")
    n = CHANNELS[kind]
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, 1 + width * n)
    pixels = _unfiltered(rows[:, 0], rows[:, 1:].reshape(height, width, n))
    return palette[pixels[:, :, 0]] if kind == 3 else pixels


def _unfiltered(filters: np.ndarray, rows: np.ndarray) -> np.ndarray:
    out = np.zeros((rows.shape[0] + 1, rows.shape[1] + 1, rows.shape[2]), np.int64)  # a row above and a column before, of zeros
    for y, kind in enumerate(filters.tolist(), 1):
        raw = rows[y - 1].astype(np.int64)
        if kind == 0:
            out[y, 1:] = raw
        elif kind == 1:
            out[y, 1:] = np.cumsum(raw, axis=0) & 255
        elif kind == 2:
            out[y, 1:] = (raw + out[y - 1, 1:]) & 255
        else:  # each pixel needs the one before
            for x in range(1, out.shape[1]):
                left, up, corner = out[y, x - 1], out[y - 1, x], out[y - 1, x - 1]
                if kind == 3:
                    guess = (left + up) // 2
                else:
                    gaps = np.abs(np.stack([up - corner, left - corner, left + up - 2 * corner]))
                    guess = np.choose(np.argmin(gaps, axis=0), [left, up, corner])
                out[y, x] = (raw[x - 1] + guess) & 255
    return out[1:, 1:].astype(np.uint8)
