"""Content-defined chunks by a gear rolling hash, computed for a whole batch of texts at once.

The gear hash of a position is the sum of random words of the last WINDOW bytes, each
shifted by its distance.  It is built by doubling: the hash over 2w bytes is the hash
over w bytes plus the one w positions earlier, shifted by w.
"""

from __future__ import annotations

import numpy as np

WINDOW = 16


def _gear() -> np.ndarray:
    return np.random.Generator(np.random.PCG64(20_417)).integers(0, 2**64, size=256, dtype=np.uint64)


GEAR = _gear()


def gear_hash(data: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Hash of the ``window`` (a power of two) bytes that end at each position; the first few see fewer bytes."""
    out, width = GEAR[data], 1
    while width < window:
        out[width:] = out[width:] + (out[:-width] << np.uint64(width))
        width *= 2
    return out


def masked_cuts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, average: int, least: int, most: int) -> list[list[int]]:
    """Chunk ends of each text (a slice of ``data``): where the hash has zero bits, between ``least`` and ``most`` bytes.

    ``least`` is at least WINDOW, so no hash that decides sees bytes of another text.
    """
    if least < WINDOW:
        raise ValueError("chunks must not be shorter than the hash window")
    # The upper bits of the sum mix every byte of the window.
    bits = np.uint64(average.bit_length() - 1)
    hits = np.flatnonzero(gear_hash(data) >> (np.uint64(64) - bits) == 0) + 1
    cuts: list[list[int]] = []
    for start, end in zip(starts.tolist(), ends.tolist(), strict=True):
        own, at = [], start
        while end - at > least:
            k = int(np.searchsorted(hits, at + least))
            cut = int(hits[k]) if k < len(hits) else end
            cut = min(cut, at + most, end)
            own.append(cut)
            at = cut
        if at < end:
            own.append(end)
        cuts.append(own)
    return cuts


def peak_cuts(data: np.ndarray, radius: int) -> np.ndarray:
    """Positions after which a chunk ends because the hash is the largest within ``radius`` on both sides.

    A cut depends on the bytes from WINDOW + radius before it to radius after it and on
    nothing else, so an insertion moves no cut beyond that distance.  Texts of no more than
    radius + 1 bytes have no cut.
    """
    if len(data) <= radius + 1:
        return np.empty(0, dtype=np.int64)
    value = gear_hash(data)
    top = value.copy()
    # Running maximum over radius + 1 positions that end here, by doubling.
    width = 1
    while width < radius + 1:
        step = min(width, radius + 1 - width)
        top[step:] = np.maximum(top[step:], top[:-step].copy())
        width += step
    left = np.zeros_like(value)
    left[1:] = top[:-1]
    right = np.zeros_like(value)
    right[: len(top) - radius] = top[radius:]
    if radius:
        tail = np.maximum.accumulate(value[::-1])[::-1]
        right[len(top) - radius :] = tail[len(top) - radius :]
    # ``left`` covers the radius + 1 positions before, ``right`` this one and the radius after.
    return np.flatnonzero((value > left) & (value == right)) + 1
