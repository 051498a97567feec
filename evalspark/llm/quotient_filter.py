"""Counting quotient filters of packed word-id n-grams.

An n-gram's word ids are packed into 64-bit limbs. The first limb is mixed with the others and permuted by an
invertible map of its own width, so n-grams spread evenly and can be read back. Its leading bits are the shard and
the quotient, which a filter doesn't store: it is known from where an entry stands, by one bit an entry and
one a quotient. The rest is the full remainder, so nothing is estimated. A filter's entries are sorted; filters of a shard
are merged by sorting runs and adding counts.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

from evalspark.llm.common import mix64

ROUNDS = 3
_ODD = 0x9E3779B97F4A7C15
_HEAD = "<QBQ"
_SMALL = 255


def _mask(bits: int) -> np.uint64:
    return np.uint64((1 << bits) - 1)


@dataclass(frozen=True)
class Layout:
    """How n-grams of ``words`` ids below ``2**bits`` are packed, and how many leading bits name the shard."""

    words: int
    bits: int
    shard_bits: int = 0

    def __post_init__(self):
        if not 1 <= self.bits <= 32:
            raise ValueError("word ids have 1 to 32 bits")

    @property
    def each(self) -> int:
        """Ids in a limb."""
        return min(self.words, 64 // self.bits)

    @property
    def widths(self) -> list[int]:
        full, rest = divmod(self.words, self.each)
        return [self.each * self.bits] * full + ([rest * self.bits] if rest else [])

    @property
    def shards(self) -> int:
        """Bits of the first limb that name the shard."""
        return min(self.shard_bits, self.widths[0])


def pack(columns: list[np.ndarray], layout: Layout) -> np.ndarray:
    """Limbs (rows) of n-grams given as a column of ids for each word."""
    limbs = np.zeros((len(layout.widths), len(columns[0])), dtype=np.uint64)
    for i, ids in enumerate(columns):
        limb = limbs[i // layout.each]
        limb <<= np.uint64(layout.bits)
        limb |= ids.astype(np.uint64)
    return limbs


def unpack(limbs: np.ndarray, layout: Layout) -> list[np.ndarray]:
    columns = []
    for i in range(layout.words):
        limb = i // layout.each
        behind = min(layout.each * (limb + 1), layout.words) - 1 - i
        columns.append((limbs[limb] >> np.uint64(behind * layout.bits)) & _mask(layout.bits))
    return columns


def _others(limbs: np.ndarray, width: int) -> np.ndarray | None:
    if len(limbs) == 1:
        return None
    mixed = np.zeros(limbs.shape[1], dtype=np.uint64)
    for limb in limbs[1:]:
        mixed = mix64(mixed ^ limb)
    return mixed & _mask(width)


def permute(limbs: np.ndarray, layout: Layout) -> np.ndarray:
    """The limbs with the first one mixed and permuted; distinct n-grams stay distinct."""
    width = layout.widths[0]
    x = limbs[0].copy()
    if (others := _others(limbs, width)) is not None:
        x ^= others
    shift, odd = np.uint64(max(1, (width + 1) // 2)), np.uint64(_ODD & ((1 << width) - 1) | 1)
    for _ in range(ROUNDS):
        x ^= x >> shift
        x = (x * odd) & _mask(width)
    x ^= x >> shift
    return np.concatenate([x[None], limbs[1:]])


def restore(limbs: np.ndarray, layout: Layout) -> np.ndarray:
    """The inverse of ``permute``."""
    width = layout.widths[0]
    x = limbs[0].copy()
    shift = np.uint64(max(1, (width + 1) // 2))
    odd = _ODD & ((1 << width) - 1) | 1
    back = np.uint64(pow(odd, -1, 1 << width))
    x ^= x >> shift
    for _ in range(ROUNDS):
        x = (x * back) & _mask(width)
        x ^= x >> shift
    if (others := _others(limbs, width)) is not None:
        x ^= others
    return np.concatenate([x[None], limbs[1:]])


def merged(limbs: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries sorted, equal ones as one with the sum of their counts."""
    if limbs.shape[1] == 0:
        return limbs, counts
    order = np.argsort(limbs[0], kind="stable") if len(limbs) == 1 else np.lexsort(limbs[::-1])
    limbs, counts = limbs[:, order], counts[order]
    new = np.ones(limbs.shape[1], dtype=bool)
    new[1:] = (limbs[:, 1:] != limbs[:, :-1]).any(axis=0)
    starts = np.flatnonzero(new)
    return limbs[:, starts], np.add.reduceat(counts, starts)


def _packed_bytes(values: np.ndarray, bits: int) -> bytes:
    size = -(-bits // 8)
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].tobytes()


def _unpacked_bytes(raw: memoryview, at: int, entries: int, bits: int) -> tuple[np.ndarray, int]:
    size = -(-bits // 8)
    wide = np.zeros((entries, 8), dtype=np.uint8)
    wide[:, :size] = np.frombuffer(raw, np.uint8, entries * size, at).reshape(entries, size)
    return wide.reshape(-1).view("<u8").astype(np.uint64), at + entries * size


def encode(limbs: np.ndarray, counts: np.ndarray, layout: Layout) -> bytes:
    """The filter of sorted distinct entries of one shard."""
    entries = limbs.shape[1]
    low = layout.widths[0] - layout.shards
    quotient_bits = min(low, max(0, entries.bit_length() - 1))
    rest = low - quotient_bits
    x = limbs[0] & _mask(low)
    quotients = (x >> np.uint64(rest)) if quotient_bits else np.zeros(entries, dtype=np.uint64)
    # after the entries of a quotient comes a zero
    places = np.zeros(entries + (1 << quotient_bits), dtype=bool)
    places[np.arange(entries) + quotients.astype(np.int64)] = True
    big = counts[counts >= _SMALL]
    out = [
        struct.pack(_HEAD, entries, quotient_bits, len(big)),
        np.packbits(places).tobytes(),
        _packed_bytes(x & _mask(rest), rest),
    ]
    out += [_packed_bytes(limb, width) for limb, width in zip(limbs[1:], layout.widths[1:])]
    out += [np.minimum(counts, _SMALL).astype(np.uint8).tobytes(), big.astype("<u8").tobytes()]
    return b"".join(out)


def decode(raw: bytes, shard: int, layout: Layout) -> tuple[np.ndarray, np.ndarray]:
    """Sorted entries and counts of a filter."""
    raw = memoryview(raw)
    entries, quotient_bits, n_big = struct.unpack_from(_HEAD, raw)
    at = struct.calcsize(_HEAD)
    low = layout.widths[0] - layout.shards
    rest = low - quotient_bits
    size = -(-(entries + (1 << quotient_bits)) // 8)
    places = np.unpackbits(np.frombuffer(raw, np.uint8, size, at)).astype(bool)
    at += size
    quotients = (np.flatnonzero(places) - np.arange(entries)).astype(np.uint64)
    x, at = _unpacked_bytes(raw, at, entries, rest)
    if quotient_bits:
        x |= quotients << np.uint64(rest)
    if layout.shards:
        x |= np.uint64(shard) << np.uint64(low) if low < 64 else np.uint64(0)
    limbs = [x]
    for width in layout.widths[1:]:
        limb, at = _unpacked_bytes(raw, at, entries, width)
        limbs.append(limb)
    counts = np.frombuffer(raw, np.uint8, entries, at).astype(np.int64)
    counts[counts == _SMALL] = np.frombuffer(raw, "<u8", n_big, at + entries).astype(np.int64)
    return np.stack(limbs), counts


def split(limbs: np.ndarray, counts: np.ndarray, layout: Layout) -> list[tuple[int, bytes]]:
    """Sorted distinct entries as a filter for each shard that has any."""
    low = layout.widths[0] - layout.shards
    shard = (limbs[0] >> np.uint64(low)).astype(np.int64) if layout.shards else np.zeros(limbs.shape[1], np.int64)
    starts = np.flatnonzero(np.diff(shard, prepend=-1))
    ends = [*starts[1:], len(shard)]
    return [(int(shard[a]), encode(limbs[:, a:b], counts[a:b], layout)) for a, b in zip(starts, ends)]
