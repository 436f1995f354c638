"""Byte-level BPE: encode by a hierarchical-bitmap rank queue, decode by table.

A pre-token starts as a doubly linked list of single bytes.  Every adjacent pair that
forms a vocabulary entry waits in the bucket of its merge rank; three levels of 64-bit
words mark the buckets in use, so the lowest rank is three find-first-set steps away
however long the pre-token is.  Merging leaves outdated entries in the buckets; they
are recognised by the pair's present rank and skipped.  A pre-token of n bytes costs
O(n log n) at worst, so one unbroken word of a million characters is no special case.

Null and empty texts give no ids.  Equal texts give equal ids.  Ids outside the
vocabulary fail on decoding.
"""

from __future__ import annotations

import base64
import struct

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyrogrid.llm.common import list_array, raw_texts

# Entries kept per worker; the caches are emptied when full, results do not depend on them.
CACHE_ENTRIES = 500_000
# Longer strings are not kept.
CACHED_CHARS = 64
# New pre-tokens that share one queue.
MERGED_AT_ONCE = 20_000
# A space after white space belongs to a longer run that one pre-token may cover.
RUN_BEFORE_SPACE = regex.compile(r"\s ")


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 token and rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class RankQueue:
    """Buckets of list positions by merge rank, with bitmaps over the buckets in use."""

    def __init__(self, ranks: int) -> None:
        self.low = [0] * (ranks // 64 + 1)
        self.mid = [0] * (ranks // 4096 + 1)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(position)
            return
        self.buckets[rank] = [position]
        self.low[rank >> 6] |= 1 << (rank & 63)
        self.mid[rank >> 12] |= 1 << ((rank >> 6) & 63)
        self.top |= 1 << (rank >> 12)

    def fill(self, ranks: np.ndarray) -> None:
        """Push every position at its rank (below zero: not at all), grouped by rank first."""
        at = np.flatnonzero(ranks >= 0)
        at = at[np.argsort(ranks[at], kind="stable")]
        sorted_ranks = ranks[at]
        cuts = np.flatnonzero(np.diff(sorted_ranks, prepend=-1))
        for rank, positions in zip(sorted_ranks[cuts].tolist(), np.split(at, cuts[1:]), strict=True) if len(at) else ():
            first, *rest = positions.tolist()
            self.push(rank, first)
            self.buckets[rank] += rest

    def pop(self) -> tuple[int, list[int]] | None:
        """The lowest rank and its positions from left to right; None when nothing waits."""
        if not self.top:
            return None
        i = (self.top & -self.top).bit_length() - 1
        word = self.mid[i]
        j = (i << 6) | ((word & -word).bit_length() - 1)
        word = self.low[j]
        rank = (j << 6) | ((word & -word).bit_length() - 1)
        self.low[j] &= ~(1 << (rank & 63))
        if not self.low[j]:
            self.mid[i] &= ~(1 << (j & 63))
            if not self.mid[i]:
                self.top &= ~(1 << i)
        return rank, sorted(self.buckets.pop(rank))


class Encoder:
    """Ids of texts by one rank file and one splitting pattern."""

    def __init__(self, path: str, pattern: str) -> None:
        self.ranks = read_ranks(path)
        self.split = regex.compile(pattern).findall
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        size = max(self.tokens) + 1
        self.queue = RankQueue(size)
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)])
        self.doubles = np.full(65536, -1, dtype=np.int64)
        for token, rank in self.ranks.items():
            if len(token) == 2:
                self.doubles[token[0] * 256 + token[1]] = rank
        self.lengths = np.full(size, -1, dtype=np.int64)
        for rank, token in self.tokens.items():
            self.lengths[rank] = len(token)
        known = np.maximum(self.lengths, 0)
        self.starts = np.concatenate(([0], np.cumsum(known)[:-1]))
        self.blob = np.frombuffer(b"".join(self.tokens.get(rank, b"") for rank in range(size)), dtype=np.uint8)
        self.pieces: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    def merge(self, tokens: list[bytes]) -> list[list[int]]:
        """Ids of pre-tokens, all merged through one queue; pairs never cross from one to the next.

        The lowest rank is popped with all its positions, left to right.  Should a merge
        make a pair of still lower rank, the unread positions go back and that pair is next.
        """
        ranks, names, queue = self.ranks, self.tokens, self.queue
        find, push = ranks.get, queue.push
        joined_text = b"".join(tokens)
        n = len(joined_text)
        codes = np.frombuffer(joined_text, dtype=np.uint8).astype(np.int64)
        ends = np.cumsum([len(token) for token in tokens])
        starts = (ends - [len(token) for token in tokens]).tolist()
        ids = self.single[codes].tolist()
        after = np.arange(1, n + 1)
        after[ends - 1] = n
        before = np.arange(-1, n - 1)
        before[starts] = -1
        first = np.full(n, -1, dtype=np.int64)
        first[:-1] = self.doubles[codes[:-1] * 256 + codes[1:]]
        first[ends - 1] = -1
        queue.fill(first)
        after, before, waiting = after.tolist(), before.tolist(), first.tolist()
        while (entry := queue.pop()) is not None:
            rank, bucket = entry
            name = names[rank]
            for seen, k in enumerate(bucket):
                if waiting[k] != rank:
                    continue
                lowest = rank
                gone = after[k]
                ids[k] = rank
                ids[gone] = waiting[gone] = waiting[k] = -1
                nxt = after[k] = after[gone]
                if nxt < n:
                    before[nxt] = k
                    pair = find(name + names[ids[nxt]])
                    if pair is not None:
                        waiting[k] = pair
                        push(pair, k)
                        if pair < lowest:
                            lowest = pair
                prev = before[k]
                if prev >= 0:
                    pair = find(names[ids[prev]] + name)
                    if pair is None:
                        waiting[prev] = -1
                    else:
                        waiting[prev] = pair
                        push(pair, prev)
                        if pair < lowest:
                            lowest = pair
                if lowest < rank:
                    for rest in bucket[seen + 1 :]:
                        push(rank, rest)
                    break
        return [[i for i in ids[k : k + len(token)] if i >= 0] for k, token in zip(starts, tokens, strict=True)]

    def learn(self, wanted: set[str]) -> dict[str, bytes]:
        """Packed ids of pre-tokens; those not yet known are merged together."""
        known, found, fresh = self.pieces, {}, []
        for piece in wanted:
            packed = known.get(piece)
            if packed is None:
                whole = self.ranks.get(piece.encode())
                if whole is None:
                    fresh.append(piece)
                    continue
                packed = struct.pack("<I", whole)
            found[piece] = packed
        for k in range(0, len(fresh), MERGED_AT_ONCE):
            some = fresh[k : k + MERGED_AT_ONCE]
            for piece, ids in zip(some, self.merge([p.encode() for p in some]), strict=True):
                found[piece] = struct.pack(f"<{len(ids)}I", *ids)
        if len(known) + len(found) > CACHE_ENTRIES:
            known.clear()
        known.update((p, v) for p, v in found.items() if len(p) <= CACHED_CHARS)
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed little-endian ids of each text.

        A space between two characters that are not white space always starts a
        pre-token, so what stands between such spaces is looked up as a whole.
        """
        parts: list[list[str]] = []
        for text in texts:
            if RUN_BEFORE_SPACE.search(text) or text[:1] == " ":
                parts.append([text])
            else:
                words = text.split(" ")
                parts.append(words[:1] + [" " + word for word in words[1:]])
        known = self.chunks
        fresh = {part: self.split(part) for part in set().union(*parts) if part not in known}
        if len(known) + len(fresh) > CACHE_ENTRIES:
            known.clear()
            fresh = {part: self.split(part) for part in set().union(*parts)}
        pieces = self.learn(set().union(*fresh.values())) if fresh else {}
        found = {part: b"".join([pieces[piece] for piece in split]) for part, split in fresh.items()}
        known.update((part, packed) for part, packed in found.items() if len(part) <= CACHED_CHARS)
        return [b"".join([known[part] if part in known else found[part] for part in split]) for split in parts]

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) and not (0 <= ids.min() and ids.max() < len(self.lengths) and self.lengths[ids].min() >= 0):
            raise ValueError("id without a token")
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        at = np.repeat(self.starts[ids] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ids) else 0)
        return self.blob[at].tobytes()


_LOADED: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """The worker's encoder for a file; loaded once."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = Encoder(path, pattern)
    return _LOADED[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with the ids of a text column as array<int>; all other columns stay."""

    def ids_of(texts: pa.Array) -> pa.Array:
        own = encoder(path, pattern)
        packed = own.encode([t.decode() for t in raw_texts(texts)])
        return list_array([np.frombuffer(ids, dtype="<u4") for ids in packed], pa.int32())

    return docs.withColumn(ids_col, F.arrow_udf(ids_of, "array<int>").asNondeterministic()(F.col(text_col)))


def decode(docs: DataFrame, path: str, pattern: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """``docs`` with the bytes that a column of ids stands for (null: no bytes)."""

    def bytes_of(ids: pa.Array) -> pa.Array:
        own = encoder(path, pattern)
        if isinstance(ids, pa.ChunkedArray):
            ids = ids.combine_chunks()
        out = []
        for value in ids:
            out.append(own.decode(np.asarray(value.values, dtype=np.int64)) if value.is_valid else b"")
        return pa.array(out, pa.binary())

    return docs.withColumn(bytes_col, F.arrow_udf(bytes_of, "binary").asNondeterministic()(F.col(ids_col)))


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per document: number of ids, digest of the ids as text, digest of the decoded bytes."""
    coded = encode(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), path, pattern).select(
        "doc_id",
        "ids",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
    )
    return decode(coded, path, pattern).select(
        "doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256")
    )
