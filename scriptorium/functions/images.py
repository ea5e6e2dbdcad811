"""Page images as raw RGB samples: padding, cropping and PNG files, with NumPy and zlib alone."""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: An element is cropped only if either side of its box is longer than so many pixels.
LEAST_SIDE = 3
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(image: np.ndarray) -> bytes:
    """A PNG file of (height, width, 3) 8-bit samples; its rows are stored without prediction."""
    height, width, _ = image.shape
    rows = np.concatenate([np.zeros((height, 1), np.uint8), np.ascontiguousarray(image, np.uint8).reshape(height, width * 3)], axis=1)
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + _chunk(b"IEND", b"")


def from_png(data: bytes) -> np.ndarray:
    """The samples of a file that :func:`to_png` made; ValueError for another."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG file")
    width, height, depth, color = struct.unpack(">IIBB", data[16:26])
    at, packed = 8, b""
    while at < len(data):
        (length,) = struct.unpack(">I", data[at : at + 4])
        packed += data[at + 8 : at + 8 + length] if data[at + 4 : at + 8] == b"IDAT" else b""
        at += 12 + length
    rows = np.frombuffer(zlib.decompress(packed), np.uint8)
    if (depth, color) != (8, 2) or len(rows) != height * (1 + 3 * width) or rows.reshape(height, -1)[:, 0].any():
        raise ValueError("not a PNG file of this module")
    return rows.reshape(height, -1)[:, 1:].reshape(height, width, 3)


def padded(image: np.ndarray) -> tuple[np.ndarray, dict[str, int]]:
    """The image in the middle of a black square of its longer side, and both sizes."""
    height, width, _ = image.shape
    side = max(height, width)
    top, left = (side - height) // 2, (side - width) // 2
    out = np.zeros((side, side, 3), np.uint8)
    out[top : top + height, left : left + width] = image
    return out, {"original_width": width, "original_height": height, "padded_width": side, "padded_height": side}


def cropped(image: np.ndarray, x1: int, y1: int, x2: int, y2: int) -> np.ndarray:
    """A region of an image; ValueError where a side has LEAST_SIDE pixels or fewer."""
    region = image[max(0, y1) : max(0, y2), max(0, x1) : max(0, x2)]
    if min(region.shape[:2]) <= LEAST_SIDE:
        raise ValueError(f"a region of {region.shape[1]} x {region.shape[0]} pixels is too small")
    return region
