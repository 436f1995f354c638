"""SimHash near-dedup: exact links within a Hamming distance by multi-index hashing.

Rows of one fingerprint are collapsed first, so copies cost one row.  A 64-bit
fingerprint has two segments of 32 bits.  Of two fingerprints at distance 2 or less
either the second segments are equal, or the first ones differ in one bit at most and
the second ones in two at most.  Each segment is therefore looked up with a Hamming
ball of radius 0 or 1 in a table, and because a table over 32 bits has crowded entries
where many near copies share a segment, the other segment is indexed in the same way by
its 16-bit halves: all keys have 48 bits.  A ball only turns zero bits into ones, so an
unordered pair at distance 1 is met from one side.  Matches are verified on the whole
distance inside the join.  The number of links of a fingerprint is bounded by geometry,
and only links leave the join.

A null or empty text, and one without words, has fingerprint zero and links like any
other.  Rows without id take part but never name a component (unless all lack one).

Near copies by Jaccard similarity are searched by fingerprints of their sets of longer
shingles first: of a 64-bit fingerprint's six blocks two at distance 3 or less share
three, so each choice of three blocks is a key of a multi-index, and matches up to a
wider distance are verified on the sets themselves.  Sets at 0.8 differ by about ten
bits, more than a multi-index affords; so sets are met by bands of minima as well, and
verified in the same way.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyrogrid.llm.common import free_name, list_array, rows_of, texts_of
from pyrogrid.llm.graph import connected_components
from pyrogrid.session import stored

SHINGLE = 3
SEED = 42
DISTANCE = 2
# Two sets at Jaccard similarity 0.8 share no band key with probability (1 - 0.8 ** 3) ** 24 = 3e-8.
BANDS, BAND_ROWS = 24, 3
# First bits of the blocks of a fingerprint; keys are choices of SHARED_BLOCKS of them.
BLOCKS, SHARED_BLOCKS = [0, 11, 22, 33, 43, 53, 64], 3
# Sets whose fingerprints share a key are compared up to this distance.
NEAR_DISTANCE = 12
# Keys that the rows of one fingerprint are dealt to.
SALTS = 64
_random = np.random.RandomState(SEED)
MULTIPLY = _random.randint(0, 2**63, BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FLIP = _random.randint(0, 2**63, BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2)


def shingle_hashes(text: bytes, shingle: int) -> list[int]:
    """64-bit hashes of the word shingles in order; a shorter text is one shingle, one without words has none."""
    words = text.lower().split()  # bytes: A to Z, and the white space of ASCII
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= shingle:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: len(words) - shingle].tolist()]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)]


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Signed 64-bit fingerprint of one text."""
    return majority(shingle_hashes(text, shingle))


def majority(hashes: list[int] | np.ndarray) -> int:
    """Signed number whose bits are 1 where over half of the hashes have a 1."""
    if not len(hashes):
        return 0
    bits = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 65536):
        block = np.array(hashes[k : k + 65536], dtype=">u8")
        bits += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes)).view(">i8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp long) of (doc_id, text)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in rows_of(batches):
            yield pa.record_batch([batch.column(0), pa.array([fingerprint(t, shingle) for t in texts], pa.int64())], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(of, "doc_id long, fp long")


def _key(table: int, segment: Column, half: Column) -> Column:
    """Table number, 32-bit segment and 16-bit half of the other segment in one number."""
    return F.shiftleft(F.lit(table).cast("long"), 48) + F.shiftleft(segment, 16) + half


def _ball(value: Column, bits: int) -> Column:
    """Values one bit above ``value``: each of its zero bits set in turn."""
    masks = F.array(*[F.lit(1 << k).cast("long") for k in range(bits)])
    free = F.filter(masks, lambda m: value.bitwiseAND(m) == 0)
    return F.transform(free, lambda m: value.bitwiseOR(m))


def links(distinct: DataFrame) -> DataFrame:
    """(src, dst): pairs of different fingerprints ``fp`` at distance DISTANCE or less, once each."""
    fp = F.col("fp")
    first, second = F.shiftrightunsigned(fp, 32), fp.bitwiseAND(F.lit(0xFFFFFFFF))
    parts = distinct.select(
        "fp", first.alias("s0"), second.alias("s1"),
        F.shiftrightunsigned(first, 16).alias("a0"), first.bitwiseAND(F.lit(0xFFFF)).alias("b0"),
        F.shiftrightunsigned(second, 16).alias("a1"), second.bitwiseAND(F.lit(0xFFFF)).alias("b1"),
    )
    s0, s1, a0, b0, a1, b1 = (F.col(c) for c in ("s0", "s1", "a0", "b0", "a1", "b1"))
    same = [_key(0, s1, a0), _key(1, s1, b0), _key(2, s0, a1), _key(3, s0, b1)]
    table = parts.select(F.explode(F.array(*same)).alias("key"), F.col("fp").alias("dst"))
    near = [
        # Second segments equal, first ones two apart at most: halves within 1, or equal.
        F.transform(_ball(a0, 16), lambda half: _key(0, s1, half)),
        # First segments equal.
        F.transform(_ball(a1, 16), lambda half: _key(2, s0, half)),
        # First segments one apart, second ones one apart at most: one half is equal.
        F.transform(_ball(s0, 32), lambda segment: _key(2, segment, a1)),
        F.transform(_ball(s0, 32), lambda segment: _key(3, segment, b1)),
    ]
    probes = parts.select(F.explode(F.concat(*near)).alias("key"), F.col("fp").alias("src"), F.lit(True).alias("above"))
    exact = parts.select(F.explode(F.array(*same)).alias("key"), F.col("fp").alias("src"), F.lit(False).alias("above"))
    close = F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= DISTANCE
    # Equal keys meet from both sides; one is enough.
    once = F.col("above") | (F.col("src") < F.col("dst"))
    met = probes.unionByName(exact).alias("p").join(table.alias("t"), (F.col("p.key") == F.col("t.key")) & close & once & (F.col("src") != F.col("dst")))
    return met.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint as 16 hex digits, component_id, links): one row per row of ``docs``.

    ``links`` counts the other fingerprints that the row's fingerprint links to.
    """
    # Rows of one fingerprint are dealt to SALTS keys, so that a group with a third of all rows is not one task's.
    own = fingerprints(texts_of(docs, id_col, text_col), shingle)
    own = stored(own.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))), "fingerprints")
    distinct = stored(own.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    pairs = stored(links(distinct.select("fp")), "links")
    both = pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    degree = both.groupBy("src").agg(F.count(F.lit(1)).alias("links"))
    found = connected_components(pairs)
    placed = (
        distinct.join(found, distinct["fp"] == found["node"], "left").drop("node")
        .withColumn("root", F.coalesce("component", "fp"))
    )
    smallest = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = (
        placed.join(smallest, "root").join(degree, F.col("fp") == F.col("src"), "left")
        .select("fp", "component_id", F.coalesce("links", F.lit(0)).alias("links"))
    )
    dealt = own.select("fp", "salt").distinct().join(stored(by_fp, "components"), "fp")
    return own.join(dealt, ["fp", "salt"]).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "links"
    )


def _band_keys(own: np.ndarray) -> np.ndarray:
    """BANDS keys of a shingle set: each digests BAND_ROWS minima of the set under own orders."""
    if not len(own):
        return np.empty(0, dtype=np.int64)
    least = np.full(len(MULTIPLY), 2**64 - 1, dtype=np.uint64)
    for k in range(0, len(own), 8192):
        least = np.minimum(least, ((own[k : k + 8192] ^ FLIP[:, None]) * MULTIPLY[:, None]).min(axis=1))
    rows = least.reshape(BANDS, BAND_ROWS)
    return np.array([xxhash.xxh3_64_intdigest(row.tobytes(), band) for band, row in enumerate(rows)], dtype=np.uint64).view(np.int64)


def shingle_sets(docs: DataFrame, shingle: int, whole: bool) -> DataFrame:
    """(doc_id, digest, size, fp, keys, hashes) of (doc_id, text): the set of shingles, listed only if ``whole``, else its fingerprint."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.empty(0, dtype=np.int64)
        for batch, texts in rows_of(batches):
            own = [np.unique(np.array(shingle_hashes(t, shingle), dtype=np.uint64)) for t in texts]
            columns = [
                batch.column(0), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in own], pa.binary()), pa.array([len(s) for s in own], pa.int32()),
                pa.array([None if whole else majority(s) for s in own], pa.int64()),
                list_array([_band_keys(s) for s in own], pa.int64()), list_array([s.view(np.int64) if whole else none for s in own], pa.int64()),
            ]
            yield pa.record_batch(columns, names=["doc_id", "digest", "size", "fp", "keys", "hashes"])

    return docs.select("doc_id", "text").mapInArrow(of, "doc_id long, digest binary, size int, fp long, keys array<long>, hashes array<long>")


def _alike(a: str, b: str, similarity: float) -> Column:
    """Whether two lists of different hashes have this Jaccard similarity."""
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both) >= similarity


def _block_keys(fp: Column) -> list[Column]:
    """A key for each choice of SHARED_BLOCKS blocks: its number and their bits."""
    blocks = [F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(BLOCKS, BLOCKS[1:], strict=False)]
    keys = []
    for number, chosen in enumerate(combinations(blocks, SHARED_BLOCKS)):
        key = F.lit(number).cast("long")
        for block in chosen:
            key = F.shiftleft(key, 11).bitwiseOR(block)
        keys.append(key)
    return keys


def near_fingerprints(sets: DataFrame) -> DataFrame:
    """(src, dst) of (set, fp): each set with the smallest one of a block key, at NEAR_DISTANCE or less."""
    each = sets.select("set", "fp", F.explode(F.array(*_block_keys(F.col("fp")))).alias("key"))
    keys = each.groupBy("key").agg(F.min("set").alias("src"), F.max("set").alias("most")).filter("src < most").select("key", "src")
    met = each.join(keys, "key").filter(F.col("set") != F.col("src")).select("src", F.col("set").alias("dst"), "fp").distinct()
    met = met.join(sets.select(F.col("set").alias("src"), F.col("fp").alias("src_fp")), "src")
    return met.filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("src_fp"))) <= NEAR_DISTANCE).select("src", "dst")


def similar_groups(docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(doc_id, root) of (doc_id, text) with unique ids: connected by Jaccard ``similarity`` of the word shingles.

    Texts of equal sets are one.  Sets with near fingerprints and sets that share a band
    key are candidates, and every link is verified on the whole sets.  A key's sets are
    first compared with its smallest one; then only those of a band key that are not yet
    connected are compared with each other.
    """
    own = stored(shingle_sets(docs, shingle, False).drop("hashes"), "bands")
    distinct = own.groupBy("digest").agg(F.min("doc_id").alias("set"))
    # Few sets are equal, so only the ids of those that go are moved.
    equal = own.groupBy("digest").agg(F.min("doc_id").alias("set"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    equal = stored(own.select("doc_id", "digest").join(equal, "digest").filter("doc_id <> set").select("doc_id"), "equal")
    once = own.join(equal, "doc_id", "left_anti").select(F.col("doc_id").alias("set"), "size", "fp", "keys")
    near = stored(near_fingerprints(once.select("set", "fp")), "near")
    each = once.select("set", "size", F.explode("keys").alias("key"))
    keys = each.groupBy("key").agg(F.min("set").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    hits = stored(each.join(keys, "key"), "hits")
    wanted = hits.select("set").unionByName(near.select(F.explode(F.array("src", "dst")).alias("set"))).distinct()
    some = docs.join(wanted.select(F.col("set").alias("doc_id")), "doc_id", "left_semi")
    sets = stored(shingle_sets(some, shingle, True).select(F.col("doc_id").alias("set"), "keys", "hashes"), "sets")

    stars = hits.filter("set <> least").select(F.col("least").alias("src"), F.col("set").alias("dst"))
    pairs = stored(near.unionByName(stars).distinct(), "pairs")
    left = pairs.join(sets.select(F.col("set").alias("dst"), F.col("hashes").alias("a")), "dst")
    # Only lists of sets in a pair are moved.
    right = sets.select(F.col("set").alias("src"), F.col("hashes").alias("b")).join(pairs.select("src").distinct(), "src", "left_semi")
    first = stored(left.join(right, "src").filter(_alike("a", "b", similarity)).select("src", "dst"), "links")

    found = connected_components(first)
    placed = hits.filter("set <> least and n > 2").join(found, F.col("set") == F.col("node"), "left").withColumn("part", F.coalesce("component", "set"))
    placed = stored(placed.select("key", "set", "size", "part"), "placed")
    open_ = placed.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low < high").select("key")
    rest = stored(placed.join(open_, "key").join(sets, "set"), "open")
    a, b = (rest.select("key", *[F.col(c).alias(f"{c}_{x}") for c in ("set", "size", "part", "keys", "hashes")]) for x in "ab")
    close = F.least("size_a", "size_b") / F.greatest("size_a", "size_b") >= similarity
    # Of the keys that two sets share, the smallest compares them.
    here = F.array_min(F.array_intersect("keys_a", "keys_b")) == a["key"]
    met = a.join(b, (a["key"] == b["key"]) & (F.col("set_a") < F.col("set_b")) & (F.col("part_a") != F.col("part_b")) & close & here & _alike("hashes_a", "hashes_b", similarity))
    second = stored(met.select(F.col("set_a").alias("src"), F.col("set_b").alias("dst")), "links")

    if not second.isEmpty():
        found = connected_components(first.unionByName(second))
    named = distinct.join(found, F.col("set") == F.col("node"), "left").select("digest", F.coalesce("component", "set").alias("root"))
    return own.join(named, "digest").select("doc_id", "root")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, similarity: float | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each component the row with the smallest id.

    Rows are linked by fingerprints at DISTANCE or less, or, where a ``similarity`` is
    given, by that Jaccard similarity of their sets of shingles.  Rows without id stay
    only where their whole component lacks ids, and of rows that repeat an id, or all
    lack one, one stays per component.
    """
    row = free_name("row", docs.columns)
    own = stored(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    texts = texts_of(own, row)
    if similarity is None:
        prints = stored(fingerprints(texts, shingle), "fingerprints")
        found = connected_components(stored(links(prints.select("fp").distinct()), "links"))
        placed = prints.join(found, prints["fp"] == found["node"], "left").select("doc_id", F.coalesce("component", "fp").alias("root"))
    else:
        placed = similar_groups(texts, shingle, similarity)
    placed = placed.select(F.col("doc_id").alias("place"), "root")
    # Nulls order first in a struct, so whether the id is missing comes before it.
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "place")).alias("first")
    ids = own.select(F.col("doc_id").alias("id"), F.col(row).alias("place"))
    kept = ids.join(placed, "place").groupBy("root").agg(first).select(F.col("first.place").alias(row))
    return own.join(kept, row, "left_semi").select(docs.columns)
