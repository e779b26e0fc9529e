"""Directly addressable codes: a random-access file format for token ids.

An id is cut into chunks of ``WIDTHS`` bits, low bits first. Level k holds the
k-th chunk of every id that has one, in order, and a bitmap with a set bit
where the id goes on to level k + 1. The place of an id's next chunk is the
rank of its bit, which a directory (set bits before each block of 512) gives
with one popcount of at most 64 bytes: any id is read without decoding others.

Image layout, little-endian: b"DAC1", uint32 levels, uint64 ids; then for each
level uint32 width in bits, uint64 entries, the chunks, the bitmap and the
directory, each of the last three padded to 8 bytes.
"""

from __future__ import annotations

import struct

import numpy as np

WIDTHS = (8, 8, 16)
BLOCK = 512
POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)
TYPES = {8: np.uint8, 16: np.uint16, 32: np.uint32}


def _padded(a: np.ndarray) -> bytes:
    raw = a.tobytes()
    return raw + bytes(-len(raw) % 8)


def encode(ids: np.ndarray, widths: tuple[int, ...] = WIDTHS) -> bytes:
    """The image of an array of unsigned 32-bit ids (may be empty)."""
    rest = np.asarray(ids, np.uint32)
    out = [b"DAC1", struct.pack("<IQ", len(widths), len(rest))]
    for k, width in enumerate(widths):
        more = rest >> np.uint32(width) if k + 1 < len(widths) else np.zeros(len(rest), np.uint32)
        goes_on = more > 0
        bits = np.packbits(goes_on, bitorder="little")
        blocks = np.pad(POPCOUNT[bits], (0, -len(bits) % (BLOCK // 8))).reshape(-1, BLOCK // 8).sum(1, dtype=np.uint64)
        out += [struct.pack("<IQ", width, len(rest)), _padded((rest & np.uint32((1 << width) - 1)).astype(TYPES[width])), _padded(bits), _padded((np.cumsum(blocks) - blocks).astype(np.uint32))]
        rest = more[goes_on]
    return b"".join(out)


class Reader:
    """Random access to an image; nothing is decoded until it is asked for."""

    def __init__(self, image: bytes):
        image = memoryview(image)
        if image[:4] != b"DAC1":
            raise ValueError("not an image of directly addressable codes")
        levels, self.n = struct.unpack_from("<IQ", image, 4)
        at, self.levels = 16, []

        def take(kind: type, n: int) -> np.ndarray:
            nonlocal at
            a = np.frombuffer(image, kind, n, at)
            at += a.nbytes + -a.nbytes % 8
            return a

        for _ in range(levels):
            width, n = struct.unpack_from("<IQ", image, at)
            at += 12
            chunks = take(TYPES[width], n)
            bits = take(np.uint8, -(-n // 8))
            self.levels.append((width, chunks, bits, take(np.uint32, -(-n // BLOCK))))

    def __len__(self) -> int:
        return self.n

    def rank(self, level: int, i: int) -> int:
        """Set bits before bit i of a level's bitmap."""
        _, _, bits, directory = self.levels[level]
        if i // BLOCK >= len(directory):
            return int(directory[-1]) + int(POPCOUNT[bits[(len(directory) - 1) * BLOCK // 8 :]].sum()) if len(directory) else 0
        byte = i // 8
        return int(directory[i // BLOCK]) + int(POPCOUNT[bits[i // BLOCK * (BLOCK // 8) : byte]].sum()) + (int(POPCOUNT[bits[byte] & ((1 << i % 8) - 1)]) if i % 8 else 0)

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = shift = 0
        for k, (width, chunks, bits, _) in enumerate(self.levels):
            value |= int(chunks[i]) << shift
            if not bits[i // 8] >> i % 8 & 1:
                break
            shift, i = shift + width, self.rank(k, i)
        return value

    def slice(self, a: int, b: int) -> np.ndarray:
        """Ids a to b (end exclusive), by one rank a level at either end."""
        a, b = max(a, 0), min(b, self.n)
        if a >= b:
            return np.zeros(0, np.uint32)
        parts = []
        for k, (width, chunks, bits, _) in enumerate(self.levels):
            goes_on = np.unpackbits(bits[a // 8 : -(-b // 8)], bitorder="little")[a % 8 : a % 8 + b - a].astype(bool)
            parts.append((width, chunks[a:b].astype(np.uint32), goes_on))
            if not goes_on.any():
                break
            a, b = self.rank(k, a), self.rank(k, b)
        higher = np.zeros(0, np.uint32)
        for width, value, goes_on in reversed(parts):
            if len(higher):
                value[goes_on] |= higher << np.uint32(width)
            higher = value
        return higher
