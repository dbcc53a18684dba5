"""Counting quotient filters: sorted, lossless counters of fixed-width integer keys."""

from __future__ import annotations

import struct

import numpy as np

from paperloom.llm.common import mix

#: Bits of a limb; keys are rows of limbs, the first the most significant.
LIMB = 64
ROUNDS = 4
#: A count below this takes one byte, another eight more.
WIDE_COUNT = 255


def limb_widths(width: int) -> list[int]:
    """Widths of the limbs of a key of ``width`` bits: two of about half, or more where they would pass 64 bits."""
    limbs = max(2, -(-width // LIMB))
    return [width // limbs + (nth < width % limbs) for nth in range(limbs)]


def _mask(width: int) -> np.uint64:
    return np.uint64((1 << width) - 1)


def permute(limbs: list[np.ndarray], widths: list[int]) -> list[np.ndarray]:
    """A bijection of the keys of these widths that spreads them evenly: each limb in turn is changed by the next one."""
    limbs = list(limbs)
    for turn in range(ROUNDS):
        for at in range(len(limbs)):
            limbs[at] = limbs[at] ^ (_scatter(limbs[at - 1], turn, at) & _mask(widths[at]))
    return limbs


def restore(limbs: list[np.ndarray], widths: list[int]) -> list[np.ndarray]:
    """The inverse of ``permute``."""
    limbs = list(limbs)
    for turn in reversed(range(ROUNDS)):
        for at in reversed(range(len(limbs))):
            limbs[at] = limbs[at] ^ (_scatter(limbs[at - 1], turn, at) & _mask(widths[at]))
    return limbs


def _scatter(limb: np.ndarray, turn: int, at: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(limb + np.uint64((turn * 8 + at + 1) * 0x9E3779B9))


def pack_ids(columns: list[np.ndarray], bits: int) -> list[np.ndarray]:
    """Limbs of the keys that hold one id of ``bits`` bits from each column, the first id in the highest bits."""
    widths = limb_widths(bits * len(columns))
    limbs = [np.zeros(len(columns[0]), np.uint64) for _ in widths]
    for nth, column in enumerate(reversed(columns)):
        _deposit(limbs, widths, column.astype(np.uint64), nth * bits, bits)
    return limbs


def unpack_ids(limbs: list[np.ndarray], bits: int, count: int) -> list[np.ndarray]:
    """The inverse of ``pack_ids``."""
    widths = limb_widths(bits * count)
    return [_extract(limbs, widths, nth * bits, bits) for nth in reversed(range(count))]


def _places(widths: list[int], low: int, bits: int):
    """``(limb, shift in the limb, shift in the value, bits)`` of the pieces of a value that starts at bit ``low``."""
    end = 0
    for at in reversed(range(len(widths))):
        start, end = end, end + widths[at]
        first, last = max(start, low), min(end, low + bits)
        if first < last:
            yield at, np.uint64(first - start), np.uint64(first - low), last - first


def _deposit(limbs: list[np.ndarray], widths: list[int], values: np.ndarray, low: int, bits: int) -> None:
    for at, inside, skipped, count in _places(widths, low, bits):
        limbs[at] |= ((values >> skipped) & _mask(count)) << inside


def _extract(limbs: list[np.ndarray], widths: list[int], low: int, bits: int) -> np.ndarray:
    values = np.zeros(len(limbs[0]), np.uint64)
    for at, inside, skipped, count in _places(widths, low, bits):
        values |= ((limbs[at] >> inside) & _mask(count)) << skipped
    return values


def counted(limbs: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Distinct keys in order, the sum of their counts, and for every given key its place among them."""
    order = np.lexsort(limbs[::-1])
    limbs = [limb[order] for limb in limbs]
    new = np.zeros(len(order), bool)
    new[:1] = True
    for limb in limbs:
        new[1:] |= limb[1:] != limb[:-1]
    group = np.cumsum(new) - 1
    place = np.empty(len(order), np.int64)
    place[order] = group
    starts = np.flatnonzero(new)
    sums = np.add.reduceat(counts[order], starts) if len(starts) else counts[:0]
    return [limb[new] for limb in limbs], sums, place


def encode(limbs: list[np.ndarray], widths: list[int], counts: np.ndarray, skipped: int = 0) -> bytes:
    """The filter of distinct sorted keys whose first ``skipped`` bits are all the same, and not stored.

    The next bits, about as many as number the keys, are a key's quotient. A bit for each quotient says whether it has a
    run of keys, a bit for each key whether it ends its run; the full remainder and the count follow. Nothing is lost: a
    run's place gives the quotient back.
    """
    size = len(counts)
    bits = min(max(size.bit_length(), 1), widths[0] - skipped)
    rest = widths[0] - skipped - bits
    first = limbs[0] & _mask(widths[0] - skipped)
    quotient = (first >> np.uint64(rest)).astype(np.int64)
    occupied = np.zeros(1 << bits, bool)
    occupied[quotient] = True
    ends = np.ones(size, bool)
    ends[:-1] = quotient[1:] != quotient[:-1]
    small = np.minimum(counts, WIDE_COUNT).astype(np.uint8)
    parts = [struct.pack("<qBB", size, bits, skipped), np.packbits(occupied).tobytes(), np.packbits(ends).tobytes()]
    for limb, width in zip([first & _mask(rest), *limbs[1:]], [rest, *widths[1:]], strict=True):
        parts.append(limb.astype("<u8").view(np.uint8).reshape(size, 8)[:, : -(-width // 8)].tobytes())
    return b"".join([*parts, small.tobytes(), counts[small == WIDE_COUNT].astype("<i8").tobytes()])


def decode(data: bytes, widths: list[int], prefix: int = 0) -> tuple[list[np.ndarray], np.ndarray]:
    """Keys and counts of a filter; ``prefix`` is the value of the bits that were not stored."""
    size, bits, skipped = struct.unpack_from("<qBB", data)
    at = struct.calcsize("<qBB")

    def take(count: int) -> np.ndarray:
        nonlocal at
        at += count
        return np.frombuffer(data, np.uint8, count, at - count)

    occupied = np.unpackbits(take(-(-(1 << bits) // 8)), count=1 << bits)
    ends = np.unpackbits(take(-(-size // 8)), count=size)
    run = np.cumsum(ends) - ends
    quotient = np.flatnonzero(occupied)[run].astype(np.uint64)
    rest = widths[0] - skipped - bits
    limbs = []
    for width in [rest, *widths[1:]]:
        held = -(-width // 8)
        whole = np.zeros((size, 8), np.uint8)
        whole[:, :held] = take(size * held).reshape(size, held)
        limbs.append(whole.view("<u8").reshape(size).astype(np.uint64))
    limbs[0] |= quotient << np.uint64(rest)
    if skipped:
        limbs[0] |= np.uint64(prefix) << np.uint64(widths[0] - skipped)
    counts = take(size).astype(np.int64)
    wide = counts == WIDE_COUNT
    counts[wide] = take(8 * int(wide.sum())).view("<i8")
    return limbs, counts
