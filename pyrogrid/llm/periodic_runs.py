"""Periodic runs of words: Lyndon arrays by Baier grouping, Lyndon roots extended to runs.

A run is a stretch of consecutive words with a smallest period q that no neighbouring
word extends.  Every run holds, under an order of the words or under its reverse, a
Lyndon root: a longest Lyndon word that starts at some position, one period long.  So
the longest Lyndon word at each position under both orders, extended to both sides as
far as the period holds, gives all runs and nothing else.

The first phase of Baier's suffix sorter keeps suffixes in ordered groups of equal
context and takes the groups from the highest to the lowest.  A group's members join
the context of the nearest position before them that belongs to a lower group, which
moves such positions, by how many members they received, to new groups right above
their old one.  When it ends, the context of a position is the longest Lyndon word that
starts there, so its length is read off directly, without sorting suffixes.  Many
stretches advance together here, one group of each per round, in numpy.

How far a period holds is the longest common extension of two positions, both ways; it
is read from names of all blocks of 2, 4, 8, ... words (equal names, equal blocks).

Only runs of a length of at least ``exponent`` periods and ``least`` words are asked
for.  Every three neighbouring words of such a run occur in it at least exponent - 1
times, so words outside stretches of three-word sequences that frequent belong to no
such run, and the sorter works on those stretches only.  Sequences are counted by a
64-bit hash; a clash can only keep words that could have gone.

Words are separated by the white space of ASCII and compared as bytes.  A null, empty
or blank text has no words and no runs.  Every row is on its own: repeated rows give
equal rows, and other columns play no part.  A text is never cut; memory grows with
the longest one, about 200 bytes a word.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyrogrid.llm.common import rows_of

EXPONENT, LEAST = 4, 6
# Words whose stretches are sorted together (a longer text is taken alone).
BLOCK_WORDS = 400_000
MIX = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers starts[k], starts[k] + 1, ..., sizes[k] of them, for all k in turn."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def lyndon_words(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(length, group) of the longest Lyndon word at each position of stretches that lie side by side.

    ``words`` are compared as numbers; each stretch counts as followed by a smallest end.
    Within a stretch, equal Lyndon words have equal groups.
    """
    n = len(words)
    if n == 0:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    stretch = np.repeat(np.arange(len(starts)), sizes)
    # Groups lie in ``order`` one after the other; a group is named by its first place.
    order = np.lexsort((words, stretch))
    fresh = np.concatenate(([True], (words[order][1:] != words[order][:-1]) | (stretch[order][1:] != stretch[order][:-1])))
    firsts = np.flatnonzero(fresh)
    members = np.diff(np.append(firsts, n))
    place = np.empty(n, dtype=np.int64)
    place[order] = np.arange(n)
    group = np.empty(n, dtype=np.int64)
    group[order] = np.repeat(firsts, members)
    size = np.zeros(n, dtype=np.int64)
    size[firsts] = members
    length = np.ones(n, dtype=np.int64)
    # Positions whose group is still to come, linked in text order; n stands before each stretch and after it.
    before, after = np.arange(-1, n), np.arange(1, n + 2)
    before[starts], after[starts + sizes - 1] = n, n
    before[n] = after[n] = n
    jump, inside = np.empty(n + 1, dtype=np.int64), np.zeros(n + 1, dtype=bool)
    moved = np.zeros(n, dtype=bool)
    low, top = starts.astype(np.int64), (starts + sizes).astype(np.int64)
    while True:
        going = top > low
        if not going.all():
            low, top = low[going], top[going]
            if not len(top):
                return length, group
        first = group[order[top - 1]]
        own = order[ragged(first, top - first)]
        top = first
        # The nearest position before each member that is in a lower group.
        inside[own] = True
        jump[own] = before[own]
        chained = own[inside[jump[own]]]
        while len(chained):
            jump[chained] = jump[jump[chained]]
            chained = chained[inside[jump[chained]]]
        left = jump[own]
        last = ~inside[after[own]]
        left_end, right_end = left[last], after[own][last]
        after[left_end], before[right_end] = right_end, left_end
        before[n] = after[n] = n
        inside[own] = False
        named = left < n
        if not named.any():
            continue
        to, at, times = np.unique(left[named], return_index=True, return_counts=True)
        grown = times * length[own[named][at]]
        # Within its group a position moves to the end, those with more members last.
        sort = np.lexsort((times, group[to]))
        to, times, grown = to[sort], times[sort], grown[sort]
        old = group[to]
        head = np.flatnonzero(np.concatenate(([True], old[1:] != old[:-1])))
        count = np.diff(np.append(head, len(old)))
        begin = old[head] + size[old[head]] - count
        target = ragged(begin, count)
        moved[to] = True
        there = order[target]
        displaced = there[~moved[there]]
        source = place[to]
        freed = source[source < np.repeat(begin, count)]
        moved[to] = False
        order[freed], place[displaced] = displaced, freed
        order[target], place[to] = to, target
        kind = np.concatenate(([True], (old[1:] != old[:-1]) | (times[1:] != times[:-1])))
        kinds = np.flatnonzero(kind)
        amount = np.diff(np.append(kinds, len(old)))
        size[old[head]] -= count
        size[target[kinds]] = amount
        group[to] = np.repeat(target[kinds], amount)
        length[to] += grown


def block_names(words: np.ndarray, longest: int) -> list[np.ndarray]:
    """names[k][i] tells the block of 2 ** k words at i apart from all other blocks, up to ``longest`` words."""
    names = [np.unique(words, return_inverse=True)[1].astype(np.int64)]
    while 2 ** len(names) <= longest:
        half, own = 2 ** (len(names) - 1), names[-1]
        if len(own) <= half:
            break
        pairs = own[:-half] * (int(own.max()) + 1) + own[half:]
        names.append(np.unique(pairs, return_inverse=True)[1].astype(np.int64))
    return names


def extensions(names: list[np.ndarray], a: np.ndarray, b: np.ndarray, forward: bool) -> np.ndarray:
    """Length of the longest common extension of positions a < b: from them on, or up to and with them."""
    total = np.zeros(len(a), dtype=np.int64)
    for k in range(len(names) - 1, -1, -1):
        own, step = names[k], 2**k
        while True:
            x, y = (a + total, b + total) if forward else (a - total - step + 1, b - total - step + 1)
            fits = (x >= 0) & (y < len(own))
            fits[fits] = own[x[fits]] == own[y[fits]]
            total[fits] += step
            # Only the largest blocks can fit more than once.
            if k < len(names) - 1 or not fits.any():
                break
    return total


def runs_of(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray, exponent: int, least: int) -> np.ndarray:
    """Rows (start, length, period) of all runs of the stretches, sorted, each once."""
    if len(words) == 0:
        return np.empty((0, 3), dtype=np.int64)
    # A word of its own after each stretch keeps extensions inside.
    stretch = np.repeat(np.arange(len(starts)), sizes)
    here = np.arange(len(words)) + stretch
    ends = starts + sizes + np.arange(len(starts))
    spaced = np.empty(len(words) + len(starts), dtype=np.int64)
    spaced[here] = words
    spaced[ends] = int(words.max()) + 1 + np.arange(len(starts))
    names = block_names(spaced, int(sizes.max()))
    found = []
    for sign in (1, -1):
        length, group = lyndon_words(sign * words, starts, sizes)
        at = np.arange(len(words))
        nearest = at + length < (starts + sizes)[stretch]
        # Roots that follow each other in a run are equal; the first of them tells the run.
        again = np.zeros(len(words), dtype=bool)
        back = at - length
        inner = back >= starts[stretch]
        again[inner] = group[back[inner]] == group[inner]
        keep = np.flatnonzero(nearest & ~again)
        a, period = here[keep], length[keep]
        right = extensions(names, a, a + period, True)
        left = extensions(names, a - 1, a + period - 1, False)
        total = left + period + right
        wanted = (total >= np.maximum(least, exponent * period)) & (left + right >= period)
        found.append(np.column_stack((keep[wanted] - left[wanted], total[wanted], period[wanted])))
    return np.unique(np.concatenate(found), axis=0)


def frequent_stretches(words: np.ndarray, owner: np.ndarray, exponent: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, sizes) of the stretches of each owner's words that can hold a run."""
    starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1]))) if len(words) else np.empty(0, dtype=np.int64)
    sizes = np.diff(np.append(starts, len(words)))
    if exponent < 3 or least <= exponent:
        # Too weak to leave anything out; periods of one word need a word more than the exponent.
        return starts, sizes
    while True:
        some = sizes >= least
        starts, sizes = starts[some], sizes[some]
        if not len(starts):
            return starts, sizes
        at = ragged(starts, sizes - 2)
        own = np.repeat(np.arange(len(starts)), sizes - 2)
        mixed = own.astype(np.uint64) * MIX[3]
        for k in range(3):
            mixed = (mixed ^ words[at + k].astype(np.uint64)) * MIX[k]
            mixed ^= mixed >> np.uint64(29)
        _, which, count = np.unique(mixed, return_inverse=True, return_counts=True)
        often = count[which] >= exponent - 1
        at, own = at[often], own[often]
        if not len(at):
            return at, at
        cut = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1] + 1) | (own[1:] != own[:-1]))))
        new_starts, new_sizes = at[cut], np.diff(np.append(cut, len(at))) + 2
        if new_sizes.sum() == sizes.sum() and len(new_sizes) == len(sizes):
            return starts, sizes
        starts, sizes = new_starts, new_sizes


def find_runs(texts: list[np.ndarray], exponent: int = EXPONENT, least: int = LEAST) -> list[np.ndarray]:
    """For each text, given as word numbers, its runs as rows (start, length, period) by start, then period."""
    out = [np.empty((0, 3), dtype=np.int64)] * len(texts)
    if not texts:
        return out
    lengths = np.array([len(t) for t in texts])
    words = np.concatenate(texts).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), lengths)
    starts, sizes = frequent_stretches(words, owner, exponent, least)
    if not len(starts):
        return out
    # Stretches of like size advance together.
    sort = np.argsort(sizes, kind="stable")
    starts, sizes = starts[sort], sizes[sort]
    block = np.cumsum(sizes) // BLOCK_WORDS
    found = []
    for own in np.split(np.arange(len(starts)), np.flatnonzero(np.diff(block)) + 1):
        inner = np.concatenate(([0], np.cumsum(sizes[own])[:-1]))
        runs = runs_of(words[ragged(starts[own], sizes[own])], inner, sizes[own], exponent, least)
        if len(runs):
            k = np.searchsorted(inner, runs[:, 0], side="right") - 1
            runs[:, 0] += starts[own][k] - inner[k]
            found.append(runs)
    if found:
        runs = np.concatenate(found)
        begins = np.cumsum(lengths) - lengths
        which = owner[runs[:, 0]]
        runs[:, 0] -= begins[which]
        runs = runs[np.lexsort((runs[:, 2], runs[:, 0], which))]
        which = np.sort(which)
        cuts = np.flatnonzero(np.diff(which, prepend=-1))
        for number, rows in zip(which[cuts].tolist(), np.split(runs, cuts[1:]), strict=True):
            out[number] = rows
    return out


def numbered(words: list[list[bytes]]) -> list[np.ndarray]:
    """Word numbers of each text: equal words of the batch have equal numbers."""
    number: dict[bytes, int] = {}
    return [np.fromiter((number.setdefault(w, len(number)) for w in own), dtype=np.int64, count=len(own)) for own in words]


def inside_repeats(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of ``n`` words lie in a run after its first period."""
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change[:n]) > 0


def strongest(runs: np.ndarray) -> list[int]:
    """The run of the greatest length per period; of equal ones the first, then the shortest period."""
    best = runs[0].tolist()
    for run in runs[1:].tolist():
        if run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def periodic_runs(docs: DataFrame, exponent: int = EXPONENT, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, runs, collapsed) of each row: runs as array<struct<start, length, period>> in words, and the text without repeats.

    ``collapsed`` is the text's words joined by one space, without those that a run
    holds after its first period.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in rows_of(batches):
            words = [t.split() for t in texts]
            found = find_runs(numbered(words), exponent, least)
            runs = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in own.tolist()] for own in found]
            kept = [kept_words(w, r) for w, r in zip(words, found, strict=True)]
            kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))
            columns = [batch.column(0), pa.array(runs, kind), pa.array([k.decode("utf-8", "replace") for k in kept], pa.string())]
            yield pa.record_batch(columns, names=["doc_id", "runs", "collapsed"])

    schema = "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(of, schema)


def kept_words(words: list[bytes], runs: np.ndarray) -> bytes:
    if not len(runs):
        return b" ".join(words)
    dropped = inside_repeats(len(words), runs).tolist()
    return b" ".join([w for w, gone in zip(words, dropped, strict=True) if not gone])


def repeating(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words with an ending made periodic, for one id in ten (no id: as they are)."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit, rest = words[a : a + p], n - a
    return words[:a] + (unit * (rest // p + 1))[:rest]


def run_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256): one row per row of ``docs``.

    Each text is first given a periodic ending where ``repeating`` says so.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in rows_of(batches):
            words = [repeating(i, t.split()) for i, t in zip(batch.column(0).to_pylist(), texts, strict=True)]
            found = find_runs(numbered(words))
            rows = []
            for own, runs in zip(words, found, strict=True):
                best = strongest(runs) if len(runs) else [None, None, None]
                milli = 1000 * best[1] // best[2] if len(runs) else None
                listed = "".join(f"{a},{b},{c}\n" for a, b, c in runs.tolist()).encode()
                rows.append((len(runs), *best, milli, hashlib.sha256(listed).hexdigest(), hashlib.sha256(kept_words(own, runs)).hexdigest()))
            columns = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), [pa.int64()] * 5 + [pa.string()] * 2, strict=True)]
            yield pa.record_batch([batch.column(0), *columns], names=["doc_id", *REPORT])

    schema = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(of, schema)


REPORT = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
