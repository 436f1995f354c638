"""Best-fit packing of documents into token sequences of one length, improved by swaps.

A document is its ids and one end id.  Documents longer than a sequence are cut into
full pieces and a remainder.  Pieces of full length are sequences; all others are dealt
by a hash of their row into groups of bounded expected size.  A group is packed best
fit first, longest first, and then improved by local search: a piece moves to a fuller
bin, or one is exchanged for one or for two of another bin, whenever the sum of the
squared fills rises, which empties bins.  What the groups leave in underfull bins is
packed again together, in ever fewer groups, while they are a minority.  Piece
texts never move; only (row, length) does.

Null and empty texts are a document of the end id alone.  Rows are told apart by their
row, so repeated ids are packed as separate documents.  An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyrogrid.llm.common import raw_texts
from pyrogrid.llm.word_ids import tokenizer
from pyrogrid.session import stored

CAPACITY = 4096
END_ID = 1
# Expected pieces per group.
GROUP_PIECES = 4096
# Bins filled below this share are packed again with those of other groups.
AGAIN_BELOW = 0.98

PIECE = "array<struct<piece:int,start:bigint,length:bigint,ids_crc32:bigint,ids:binary>>"


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, ids): one row per piece; ids only on demand."""

    def cut(texts: pa.Array) -> pa.Array:
        own, end = tokenizer(path), np.array([end_id], dtype="<u4").tobytes()
        rows = []
        for text in raw_texts(texts):
            ids = own.encode(text) + end
            parts = [ids[k : k + 4 * capacity] for k in range(0, len(ids), 4 * capacity)]
            rows.append([
                {"piece": n, "start": n * capacity, "length": len(p) // 4, "ids_crc32": zlib.crc32(p), "ids": p if with_ids else None}
                for n, p in enumerate(parts)
            ])
        kind = pa.struct([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])
        return pa.array(rows, pa.list_(kind))

    udf = F.arrow_udf(cut, PIECE).asNondeterministic()
    return docs.select("doc_id", F.inline(udf("text")))


class _Bins:
    """Bins of one group, with an index of the pieces that underfull bins hold by length."""

    def __init__(self, lengths: list[int], capacity: int) -> None:
        self.lengths, self.capacity = lengths, capacity
        self.bins: list[list[int]] = []
        self.fill: list[int] = []
        self.home = [-1] * len(lengths)

    def best_fit(self) -> None:
        """Longest piece first, each into the fullest bin that still takes it."""
        free: dict[int, list[int]] = {}
        marks = 0
        for item in sorted(range(len(self.lengths)), key=lambda i: (-self.lengths[i], i)):
            length = self.lengths[item]
            fitting = marks >> length
            if fitting:
                room = length + (fitting & -fitting).bit_length() - 1
                at = free[room].pop()
                if not free[room]:
                    marks &= ~(1 << room)
            else:
                room, at = self.capacity, len(self.bins)
                self.bins.append([])
                self.fill.append(0)
            self.bins[at].append(item)
            self.fill[at] += length
            self.home[item] = at
            room -= length
            if room:
                free.setdefault(room, []).append(at)
                marks |= 1 << room

    def shift(self, item: int, to: int) -> None:
        at = self.home[item]
        self.bins[at].remove(item)
        self.fill[at] -= self.lengths[item]
        self.bins[to].append(item)
        self.fill[to] += self.lengths[item]
        self.home[item] = to

    def needed(self) -> int:
        return -(-sum(self.lengths) // self.capacity)

    def improve(self) -> None:
        """Empty the emptiest bins into fuller ones while a move or exchange raises the sum of squared fills.

        Stops at the least possible number of bins, or when no bin changes any more.
        """
        while sum(1 for f in self.fill if f) > self.needed():
            under = sorted((b for b, f in enumerate(self.fill) if 0 < f < self.capacity), key=lambda b: (-self.fill[b], b))
            by_length: dict[int, set[int]] = {}
            marks = 0
            for b in under:
                for item in self.bins[b]:
                    by_length.setdefault(self.lengths[item], set()).add(item)
            for length in by_length:
                marks |= 1 << length

            def drop(item: int) -> None:
                nonlocal marks
                length = self.lengths[item]
                own = by_length.get(length)
                if own is not None:
                    own.discard(item)
                    if not own:
                        del by_length[length]
                        marks &= ~(1 << length)

            def take(most: int, least: int) -> int | None:
                """The longest indexed piece of ``least`` to ``most`` tokens."""
                fitting = marks & ((1 << (most + 1)) - 1)
                length = fitting.bit_length() - 1
                return min(by_length[length]) if length >= max(least, 1) else None

            changed = False
            for b in under:
                for item in self.bins[b]:
                    drop(item)
                while (gap := self.capacity - self.fill[b]) and marks:
                    step = self._step(b, gap, take)
                    if step is None:
                        break
                    given, got = step
                    emptier = self.home[got[0]]
                    for item in got:
                        drop(item)
                        self.shift(item, b)
                    for item in given:
                        self.shift(item, emptier)
                        by_length.setdefault(self.lengths[item], set()).add(item)
                        marks |= 1 << self.lengths[item]
                    changed = True
            if not changed:
                return

    def _step(self, b: int, gap: int, take) -> tuple[list[int], list[int]] | None:
        """What bin ``b`` gives and gets: a move, one for one, or one for two; the best fill of the first kind that works.

        Only pieces of bins no fuller than ``b`` are indexed, so every step raises the sum of squares.
        """
        item = take(gap, 1)
        if item is not None:
            return [], [item]
        best: tuple[int, list[int], list[int]] | None = None
        for own in self.bins[b]:
            length = self.lengths[own]
            other = take(length + gap, length + 1)
            if other is not None and (best is None or self.lengths[other] - length > best[0]):
                best = (self.lengths[other] - length, [own], [other])
        if best is not None:
            return best[1], best[2]
        for own in self.bins[b]:
            length = self.lengths[own]
            first = take((length + gap) // 2, 1)
            if first is None:
                continue
            second = take(length + gap - self.lengths[first], length + 1 - self.lengths[first])
            if second is not None and second != first and self.home[second] == self.home[first]:
                return [own], [first, second]
        return None


def pack_group(lengths: list[int], capacity: int = CAPACITY) -> list[int]:
    """Bin of each piece."""
    bins = _Bins(lengths, capacity)
    bins.best_fit()
    bins.improve()
    return bins.home


def _packed(frame: pd.DataFrame, capacity: int) -> pd.DataFrame:
    frame = frame.sort_values("row", kind="stable")
    bins = np.array(pack_group(frame["length"].tolist(), capacity), dtype=np.int64)
    frame = frame.assign(bin=bins)
    frame["offset"] = frame.groupby("bin")["length"].cumsum() - frame["length"]
    frame["fill"] = frame.groupby("bin")["length"].transform("sum")
    return frame[["row", "length", "grp", "bin", "offset", "fill"]]


def assign(items: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """(row, sequence_id, offset) for items (row long, length long) of less than a full sequence."""
    level, done = 0, None
    left = items.select("row", "length")
    count = left.count()
    while True:
        groups = max(1, -(-count // group_pieces))
        dealt = left.withColumn("grp", F.pmod(F.xxhash64("row"), F.lit(groups)))
        packed = stored(
            dealt.groupBy("grp").applyInPandas(
                lambda frame: _packed(frame, capacity), "row long, length long, grp long, bin long, offset long, fill long"
            ),
            "packed",
        )
        again = F.col("fill") < AGAIN_BELOW * capacity
        # Packing again pays while it concerns a minority; groups thus never outgrow their bound.
        fewer = 0 if groups == 1 else packed.filter(again).count()
        last = fewer == 0 or 2 * fewer > count
        kept = packed if last else packed.filter(~again)
        # Levels, groups and bins have separate bits, so numbers never meet.
        number = F.shiftleft(F.lit(level + 1).cast("long"), 56) + F.shiftleft(F.col("grp"), 24) + F.col("bin")
        kept = kept.select("row", number.alias("sequence_id"), "offset")
        done = kept if done is None else done.unionByName(kept)
        if last:
            return done
        left, count, level = packed.filter(again).select("row", "length"), fewer, level + 1


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, group_pieces: int = GROUP_PIECES, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]) for every piece of ``docs`` (doc_id, text)."""
    cut = stored(pieces(docs, path, capacity, end_id, with_ids).withColumn("row", F.monotonically_increasing_id()), "pieces")
    whole = F.col("length") == capacity
    place = assign(cut.filter(~whole), capacity, group_pieces)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] + ["ids"] * with_ids
    full = cut.filter(whole).select("*", F.col("row").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return full.select(columns).unionByName(cut.filter(~whole).join(place, "row").select(columns))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the ids of each sequence in order, from ``pack(..., with_ids=True)``."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(ordered, F.lit(b"").cast("binary"), lambda done, part: F.concat(done, part["ids"]))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"))
