"""Elias-Fano coding of a non-decreasing sequence, with select structures."""

from __future__ import annotations

import struct

import numpy as np

HEADER = struct.Struct("<QQBQ")
#: The place of every so many-th set bit is kept, so that select reads few bytes.
SAMPLE = 256


def encode(values: np.ndarray) -> bytes:
    """Header (count, largest, low bits, bytes of high part), low bits, high bits in unary, samples.

    Takes n values up to u in about n * (2 + log2(u / n)) bits. Values are
    unsigned 64-bit and never decrease.
    """
    v = np.asarray(values, np.uint64)
    n = len(v)
    top = int(v[-1]) if n else 0
    low_bits = max(0, (top // n).bit_length() - 1) if n else 0
    low = np.zeros((n, low_bits), np.uint8)
    for k in range(low_bits):
        low[:, k] = (v >> np.uint64(k)) & np.uint64(1)
    places = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
    high = np.zeros((int(places[-1]) + 1) if n else 0, np.uint8)
    high[places] = 1
    packed = np.packbits(high, bitorder="little").tobytes()
    samples = places[::SAMPLE].astype("<u4" if len(high) < 1 << 32 else "<u8").tobytes()
    return HEADER.pack(n, top, low_bits, len(packed)) + np.packbits(low.ravel(), bitorder="little").tobytes() + packed + samples


class Sequence:
    """Random access to an encoded sequence: only the parts that are asked for are read."""

    def __init__(self, data: bytes):
        self.n, self.top, self.low_bits, high = HEADER.unpack_from(data)
        a = HEADER.size
        b = a + (self.n * self.low_bits + 7) // 8
        self.low = np.frombuffer(data, np.uint8, b - a, a)
        self.high = np.frombuffer(data, np.uint8, high, b)
        kind = "<u4" if (self.top >> self.low_bits) + self.n < 1 << 32 else "<u8"
        self.samples = np.frombuffer(data, kind, -(-self.n // SAMPLE), b + high)

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        """The i-th value: select in the high bits from the nearest sample, then its low bits."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place = int(self.samples[i // SAMPLE])
        left, byte = i % SAMPLE, place >> 3
        bits = np.unpackbits(self.high[byte : byte + 1], bitorder="little")
        bits[: place & 7] = 0
        while left >= (ones := int(bits.sum())):
            left -= ones
            byte += 1
            bits = np.unpackbits(self.high[byte : byte + 1], bitorder="little")
        place = byte * 8 + int(np.flatnonzero(bits)[left])
        value = place - i
        for k in reversed(range(self.low_bits)):
            at = i * self.low_bits + k
            value = value << 1 | (int(self.low[at >> 3]) >> (at & 7)) & 1
        return value

    def all(self) -> np.ndarray:
        places = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        value = (places - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)
        low = np.unpackbits(self.low, bitorder="little", count=self.n * self.low_bits).reshape(self.n, self.low_bits)
        for k in range(self.low_bits):
            value |= low[:, k].astype(np.uint64) << np.uint64(k)
        return value
