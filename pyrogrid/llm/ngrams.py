"""Hashed n-grams of whole texts as numpy arrays, many texts at a time.

Texts are laid out as code points with spaces between them.  Every function works
on such a block; a text longer than a block is cut at white space into several rows
that belong to the same document, so memory is bounded whatever a text's length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from pyrogrid.llm.common import BLOCK_CHARS

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def blocks(texts: list[str], chars: int = BLOCK_CHARS) -> Iterator[tuple[np.ndarray, list[str]]]:
    """(document numbers, their texts) of at most about ``chars`` code points, in order."""
    numbers: list[int] = []
    parts: list[str] = []
    held = 0
    for n, text in enumerate(texts):
        at = 0
        while True:
            end = len(text)
            if end - at > chars:
                end = max(text.rfind(" ", at + 1, at + chars), text.rfind("\n", at + 1, at + chars))
                end = end if end > at else at + chars
            if held and held + end - at > chars:
                yield np.array(numbers), parts
                numbers, parts, held = [], [], 0
            numbers.append(n)
            parts.append(text[at:end])
            held += end - at
            at = end
            if at >= len(text):
                break
    if numbers:
        yield np.array(numbers), parts


# Spaces after each part: n-grams of up to one more than this never reach the next part's text.
PAD = 3


def layout(parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all parts, each between one space and PAD spaces; and where each part, with its spaces, starts and ends.

    The end of a part is behind its first closing space: n-grams that start before it
    depend on that part alone.
    """
    shown = "".join([f" {part}{' ' * PAD}" for part in parts]) + " "
    points = np.frombuffer(shown.encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    lengths = np.array([len(p) for p in parts])
    starts = np.cumsum(lengths + 1 + PAD) - (lengths + 1 + PAD)
    return points, starts, starts + lengths + 2


def scramble(values: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each hash; ``buckets`` is a power of two."""
    return ((values * MULTIPLIER) >> np.uint64(64 - (buckets.bit_length() - 1))).astype(np.int64)


def gram_hashes(points: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n code points from each position on; the last n - 1 positions have none."""
    count = len(points) - n + 1
    if count <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.full(count, n, dtype=np.uint64)
    for k in range(n):
        out = out * MULTIPLIER + points[k : k + count]
        out ^= out >> np.uint64(29)
    return out


def is_blank(points: np.ndarray) -> np.ndarray:
    return (points == 32) | ((points >= 9) & (points <= 13)) | (points == 0xA0)
