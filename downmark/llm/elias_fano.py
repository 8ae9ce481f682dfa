"""Elias-Fano sequences: non-decreasing integers at two bits above their entropy.

The low bits of all values stand packed side by side, the high bits in unary with a
rank every 64 bits.  Reads work on the bytes in place, for whole arrays at once.
"""

from __future__ import annotations

import struct

import numpy as np

_HEAD = "<QQBQ"


def _packed(values: np.ndarray, width: int) -> bytes:
    """``width`` bits of each value, and room for the last unaligned read."""
    out = np.zeros((len(values) * width + 7) // 8 + 8, dtype=np.uint8)
    if width:
        for at in range(0, len(values), 1 << 16):  # a multiple of eight values starts on a byte
            part = values[at:at + (1 << 16)]
            bits = ((part[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
            raw = np.packbits(bits.ravel(), bitorder="little")
            start = at * width // 8
            out[start:start + len(raw)] = raw
    return out.tobytes()


def select_in_word(words: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The place of the ``rank``-th set bit (from 0) of each 64-bit word."""
    words, rank, place = words.copy(), rank.astype(np.int64), np.zeros(len(words), dtype=np.int64)
    for width in (32, 16, 8, 4, 2, 1):
        below = np.bitwise_count(words & np.uint64((1 << width) - 1)).astype(np.int64)
        up = rank >= below
        rank -= np.where(up, below, 0)
        words = np.where(up, words >> np.uint64(width), words)
        place += np.where(up, width, 0)
    return place


def encode(values: np.ndarray) -> bytes:
    """A sequence of non-decreasing values of at most 62 bits."""
    values = np.asarray(values, dtype=np.uint64)
    n, top = len(values), int(values[-1]) if len(values) else 0
    width = max(0, (top // n).bit_length() - 1) if n else 0
    buckets = (top >> width) + 1
    ones = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
    n_words = (n + buckets + 63) // 64
    bits = np.zeros(n_words * 64, dtype=np.uint8)
    bits[ones] = 1
    high = np.packbits(bits, bitorder="little").view("<u8")
    rank = np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)]).astype("<u4")
    low = _packed(values & np.uint64((1 << width) - 1), width)
    body = b"".join([high.tobytes(), rank.tobytes(), low])
    return struct.pack(_HEAD, n, buckets, width, len(body)) + body


class Sequence:
    """Reads an encoded sequence from a buffer; ``end`` is where it stops."""

    def __init__(self, data: memoryview, at: int = 0):
        self.n, self.buckets, self.width, size = struct.unpack_from(_HEAD, data, at)
        at += struct.calcsize(_HEAD)
        self.end = at + size
        words = (self.n + self.buckets + 63) // 64
        self.high = np.frombuffer(data, dtype="<u8", count=words, offset=at)
        self.rank = np.frombuffer(data, dtype="<u4", count=words + 1, offset=at + 8 * words)
        low = at + 12 * words + 4
        # every byte may start a read of eight
        self.low = np.ndarray((self.end - low - 7,), dtype="<u8", buffer=data, offset=low, strides=(1,))
        self.zero_rank = np.arange(words + 1, dtype=np.int64) * 64 - self.rank

    def _low(self, at: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(at), dtype=np.uint64)
        bit = at * self.width
        return (self.low[bit >> 3] >> (bit & 7).astype(np.uint64)) & np.uint64((1 << self.width) - 1)

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        """The values at these places."""
        word = np.searchsorted(self.rank, at, side="right") - 1
        place = word * 64 + select_in_word(self.high[word], at - self.rank[word])
        return ((place - at).astype(np.uint64) << np.uint64(self.width)) | self._low(at)

    def _ones_before_zero(self, k: np.ndarray) -> np.ndarray:
        """How many values lie in buckets up to ``k`` (-1: none)."""
        safe = np.maximum(k, 0)
        word = np.searchsorted(self.zero_rank, safe, side="right") - 1
        place = word * 64 + select_in_word(~self.high[word], safe - self.zero_rank[word])
        return np.where(k < 0, 0, place - safe)

    def find(self, values: np.ndarray) -> np.ndarray:
        """The place of each value in a strictly increasing sequence, or -1."""
        values = np.asarray(values, dtype=np.uint64)
        if not self.n:
            return np.full(len(values), -1, dtype=np.int64)
        bucket = (values >> np.uint64(self.width)).astype(np.int64)
        inside = bucket < self.buckets
        bucket = np.minimum(bucket, self.buckets - 1)
        first, last = self._ones_before_zero(bucket - 1), self._ones_before_zero(bucket)
        want, end = values & np.uint64((1 << self.width) - 1), last.copy()
        while True:  # the first place of the bucket whose low bits are not smaller
            open_ = np.flatnonzero(first < last)
            if not len(open_):
                break
            mid = (first[open_] + last[open_]) >> 1
            small = self._low(mid) < want[open_]
            first[open_[small]] = mid[small] + 1
            last[open_[~small]] = mid[~small]
        hit = np.flatnonzero(inside & (first < end))
        hit = hit[self._low(first[hit]) == want[hit]]
        out = np.full(len(values), -1, dtype=np.int64)
        out[hit] = first[hit]
        return out
