"""PNG decoding and encoding with zlib alone: gray, RGB, palette and alpha images of 8 or 16 bits."""

from __future__ import annotations

import struct
import zlib

import numpy as np

_MAGIC = b"\x89PNG\r\n\x1a\n"
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def decode(data: bytes) -> np.ndarray:
    """Array (height, width) or (height, width, channels); palettes are resolved to RGB."""
    if data[:8] != _MAGIC:
        raise ValueError("not a PNG")
    at, packed, palette, head = 8, [], None, None
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        at += 12 + size
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, dtype=np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"IEND":
            break
    width, height, depth, color, _, _, interlace = head
    if interlace or depth not in (1, 2, 4, 8, 16):
        raise ValueError("unsupported PNG")
    channels = _CHANNELS[color]
    stride, step = (width * channels * depth + 7) // 8, max(1, channels * depth // 8)
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), dtype=np.uint8).reshape(height, stride + 1)
    rows, above = np.zeros((height, stride), dtype=np.uint8), np.zeros(stride, dtype=np.uint8)
    for y in range(height):
        above = rows[y] = _unfilter(int(raw[y, 0]), raw[y, 1:], above, step)
    if depth == 16:
        out = rows.view(">u2").astype(np.uint16)
    elif depth == 8:
        out = rows
    else:
        bits = np.unpackbits(rows, axis=1).reshape(height, -1, depth)
        out = (bits * (1 << np.arange(depth - 1, -1, -1))).sum(axis=2).astype(np.uint8)[:, : width * channels]
        if color == 0:
            out = (out * (255 // ((1 << depth) - 1))).astype(np.uint8)
    out = out.reshape(height, width, channels) if channels > 1 else out.reshape(height, width)
    return palette[out] if color == 3 else out


def _unfilter(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    if kind == 0:
        return line.copy()
    if kind == 2:
        return line + above
    if kind == 1:
        return np.cumsum(line.reshape(-1, step).astype(np.uint64), axis=0).astype(np.uint8).ravel() if len(line) % step == 0 else _slow(kind, line, above, step)
    return _slow(kind, line, above, step)


def _slow(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    cur, up = line.tolist(), above.tolist()
    for i in range(len(cur)):
        left, corner = (cur[i - step], up[i - step]) if i >= step else (0, 0)
        if kind == 1:
            guess = left
        elif kind == 3:
            guess = (left + up[i]) // 2
        else:
            p = left + up[i] - corner
            guess = min(((abs(p - v), k, v) for k, v in enumerate((left, up[i], corner))))[2]
        cur[i] = (cur[i] + guess) & 255
    return np.array(cur, dtype=np.uint8)


def encode(image: np.ndarray) -> bytes:
    """Gray 8- or 16-bit, or RGB 8-bit."""
    wide = image.dtype == np.uint16
    body = image.astype(">u2") if wide else image.astype(np.uint8)
    h, w = image.shape[:2]
    lines = np.zeros((h, body.reshape(h, -1).view(np.uint8).shape[1] + 1), dtype=np.uint8)
    lines[:, 1:] = np.ascontiguousarray(body.reshape(h, -1)).view(np.uint8)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", w, h, 16 if wide else 8, 2 if image.ndim == 3 else 0, 0, 0, 0)
    return _MAGIC + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")
