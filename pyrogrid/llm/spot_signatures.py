"""SpotSigs document fingerprints, with DataFrame functions only.

A spot signature is a common word (the anchor) with the next CHAIN content words; words
of the stop list that are not anchors are passed over.  A text's start counts as an
anchor, so short texts have signatures too, and a text without any word is its own
signature.  Signatures are hashed to 16 hex digits; the fingerprint of a text is its
sorted set of signatures, and the likeness of two texts the Jaccard similarity of the
sets.

Two sets can only reach a similarity t if the smaller has at least t times the size of
the larger.  ``near_pairs`` therefore partitions sets by length, meets each partition
with itself and the next, and compares only sets that share one of their rarest
signatures; equal sets are compared once for all their documents.

Null and empty texts have the empty set.  Two empty sets are alike (1), an empty and
another set are not (0).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pyrogrid.session import stored

CHAIN = 2
THRESHOLD = 0.8
# Successive ids that are read side by side.
IDS_PER_BUCKET = 1024
# Words that text of the four languages is made of: anchors, and further words that chains pass over.
ANCHORS = (
    "the a an is was are that this with of to in and for "  # English
    "der die das und ist ein eine den dem mit von zu "  # German
    "le la les un une et est des du que dans pour "  # French
    "el los las del y es en con por para se"  # Spanish
).split()
PASSED = "it he she be by on at as or from have had not but des sich auf für nicht als auch sur par pas au ce qui su al lo como más o".split()
WORD = r"[\p{L}\p{N}]+"


def signatures(text: Column, chain: int = CHAIN) -> Column:
    """Sorted set of the signatures of a text: array of strings of 16 hex digits."""
    words = F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))
    counted = F.filter(words, lambda w: ~w.isin([p for p in PASSED if p not in ANCHORS]))

    def of(kept: Column) -> Column:
        content = F.filter(kept, lambda w: ~w.isin(ANCHORS))
        spots = F.filter(F.transform(kept, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda s: s["w"].isin(ANCHORS))

        def chains(body: Column) -> Column:
            # The k-th anchor, at place i, stands before the content word number i - k.
            each = F.transform(spots, lambda s, k: F.concat_ws(" ", s["w"], F.slice(body, s["i"] - k + 1, chain)))
            start = F.concat_ws(" ", F.lit("^"), F.slice(body, 1, chain))
            return F.concat(F.array(start), each)

        return _let(content, chains)

    own = F.when(F.size(words) > 0, _let(counted, of)).otherwise(F.array(F.concat(F.lit("= "), text)))
    found = F.transform(own, lambda s: F.substring(F.md5(s.cast("binary")), 1, 16))
    return F.when(F.length(text) > 0, F.array_sort(F.array_distinct(found))).otherwise(F.array().cast("array<string>"))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def likeness(a: Column, b: Column, threshold: float = 0.0) -> Column:
    """Jaccard similarity of two sets; 0 without comparing them where their sizes rule ``threshold`` out."""
    larger, smaller = F.greatest(F.size(a), F.size(b)), F.least(F.size(a), F.size(b))
    shared = F.size(F.array_intersect(a, b))
    return (
        F.when(larger == 0, 1.0)
        .when(smaller < threshold * larger, 0.0)
        .otherwise(shared / (F.size(a) + F.size(b) - shared))
        .cast("double")
    )


def followers(docs: DataFrame) -> DataFrame:
    """(doc_id, next_id): the next document by descending id, the first after the last.

    Ids are range-partitioned; only the ends of the partitions are put in order together.
    Rows without id have no place in the order.
    """
    ids = docs.filter(F.col("doc_id").isNotNull()).select("doc_id").distinct()
    ranged = stored(ids.repartitionByRange("doc_id").withColumn("part", F.spark_partition_id()), "ids")
    inside = Window.partitionBy("part").orderBy(F.desc("doc_id"))
    ends = ranged.groupBy("part").agg(F.max("doc_id").alias("top"), F.min("doc_id").alias("bottom"))
    # One row per partition.
    across = Window.orderBy(F.desc("top"))
    whole = Window.orderBy(F.desc("top")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = ends.select(F.col("bottom").alias("doc_id"), F.coalesce(F.lead("top").over(across), F.first("top").over(whole)).alias("across"))
    return (
        ranged.withColumn("inside", F.lead("doc_id").over(inside)).join(after, "doc_id", "left")
        .select("doc_id", F.coalesce("inside", "across").alias("next_id"))
    )


def fingerprint(sigs: Column) -> Column:
    return F.array_join(sigs, "")


def against_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of (doc_id, text) and of the edited texts, and how alike they and the next document are.

    The edited text ends in the beginning of the next document by descending id, the
    first one's after the last.  Texts are shuffled once, in buckets of IDS_PER_BUCKET
    successive ids, where the next document is the next row; only the document that
    follows a bucket is fetched from another one.  Rows that repeat an id follow each
    other by text; rows without id have no next document and their edit only shortens.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    bucket = F.floor(F.col("doc_id") / IDS_PER_BUCKET)
    known = texts.filter(F.col("doc_id").isNotNull()).withColumn("bucket", bucket)
    tops = known.groupBy("bucket").agg(F.max("doc_id").alias("doc_id")).select("doc_id")
    after = followers(tops).select(bucket.alias("bucket"), F.col("next_id").alias("doc_id"))
    # A bucket's neighbour may repeat its id: the first of those rows by text follows.
    beyond = (
        known.select("doc_id", "text").join(after, "doc_id").groupBy("bucket").agg(F.min("text").alias("text_beyond"))
        .withColumn("sigs_beyond", signatures(F.col("text_beyond")))
    )
    order = [F.desc("doc_id"), F.col("text")]
    ordered = known.repartition("bucket").sortWithinPartitions("bucket", *order).withColumn("sigs", signatures(F.col("text")))
    inside = Window.partitionBy("bucket").orderBy(*order)
    led = ordered.withColumns({"next_text": F.lead("text").over(inside), "next_sigs": F.lead("sigs").over(inside)})
    led = led.join(beyond, (led["bucket"] == beyond["bucket"]) & led["next_text"].isNull(), "left")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    own = F.substr("text", F.lit(1), (n - half).cast("int"))
    head = F.substr(F.coalesce("next_text", "text_beyond"), F.lit(1), half)
    both = led.select(
        "doc_id", n.cast("long").alias("n_chars"), "sigs", F.coalesce("next_sigs", "sigs_beyond").alias("next_sigs"), F.concat(own, head).alias("edited")
    )
    none = texts.filter(F.col("doc_id").isNull()).select(
        "doc_id", n.cast("long").alias("n_chars"), signatures(F.col("text")).alias("sigs"),
        F.array().cast("array<string>").alias("next_sigs"), own.alias("edited"),
    )
    both = both.unionByName(none).withColumn("edited_sigs", signatures(F.col("edited")))
    return both.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("sigs")).alias("fingerprint"), fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"), likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
    )


def near_pairs(docs: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): (doc_id, set_id), and (a, b, likeness) of different sets at least ``threshold`` alike.

    A set of n signatures must share one of its n - ceil(t n) + 1 rarest ones with any
    set as alike as t, so only those are met; they are the rarest, which keeps the lists
    short.  ``set_id`` is the smallest doc_id of the set.
    """
    own = stored(docs.select("doc_id", signatures(F.coalesce("text", F.lit(""))).alias("sigs")), "signed")
    sets = stored(own.groupBy("sigs").agg(F.min("doc_id").alias("set_id")), "sets")
    members = own.join(sets, "sigs").select("doc_id", "set_id")
    sets = sets.filter((F.size("sigs") > 0) & F.col("set_id").isNotNull())
    counts = sets.select(F.explode("sigs").alias("sig")).groupBy("sig").agg(F.count(F.lit(1)).alias("n"))
    ranked = (
        sets.select("set_id", F.size("sigs").alias("size"), F.explode("sigs").alias("sig")).join(counts, "sig")
        .groupBy("set_id", "size").agg(F.array_sort(F.collect_list(F.struct("n", "sig"))).alias("rare"))
    )
    prefix = F.col("size") - F.ceil(F.lit(threshold) * F.col("size")) + 1
    keys = ranked.select("set_id", "size", F.explode(F.slice("rare", F.lit(1), prefix.cast("int"))).alias("own")).select("set_id", "size", "own.sig")
    # Partition k holds sizes from (1/t)^k to (1/t)^(k+1): partners are in the same one or a neighbour.
    part = F.floor(F.log(F.col("size").cast("double")) / math.log(1.0 / threshold)).cast("int") if threshold < 1 else F.col("size")
    left = keys.withColumn("part", part)
    right = left.select(F.col("set_id").alias("b"), F.col("size").alias("size_b"), "sig", F.explode(F.array(F.col("part"), F.col("part") + 1)).alias("part"))
    met = left.withColumnsRenamed({"set_id": "a", "size": "size_a"}).join(right, ["sig", "part"])
    fits = (F.least("size_a", "size_b") >= threshold * F.greatest("size_a", "size_b")) & (F.col("a") != F.col("b"))
    candidates = met.filter(fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    content = sets.select("set_id", "sigs")
    pairs = (
        candidates.join(content.withColumnsRenamed({"set_id": "a", "sigs": "sigs_a"}), "a")
        .join(content.withColumnsRenamed({"set_id": "b", "sigs": "sigs_b"}), "b")
        .withColumn("likeness", likeness(F.col("sigs_a"), F.col("sigs_b"), threshold))
        .filter(F.col("likeness") >= threshold)
    )
    return members, pairs.select("a", "b", "likeness")


def edits_sql() -> str:
    """``against_edits`` over table ``documents`` in DuckDB's SQL."""
    anchors = ", ".join(f"'{w}'" for w in ANCHORS)
    passed = ", ".join(f"'{w}'" for w in PASSED if w not in ANCHORS)

    def sigs(text: str) -> str:
        words = f"regexp_extract_all(lower({text}), '{WORD}')"
        kept = f"list_filter({words}, lambda w: w NOT IN ({passed}))"
        return f"""(SELECT CASE WHEN length({text}) = 0 THEN CAST([] AS VARCHAR[]) ELSE list_sort(list_distinct(list_transform(
            CASE WHEN len({words}) = 0 THEN ['= ' || {text}]
            ELSE list_prepend(array_to_string(list_prepend('^', body[1:{CHAIN}]), ' '),
                list_transform(spots, lambda s, k: array_to_string(list_prepend(s.w, body[s.i - k + 1:s.i - k + {CHAIN}]), ' '))) END,
            lambda c: left(md5(c), 16)))) END
          FROM (SELECT list_filter(kept, lambda w: w NOT IN ({anchors})) AS body,
            list_filter(list_transform(kept, lambda w, i: {{'w': w, 'i': i}}), lambda s: s.w IN ({anchors})) AS spots
            FROM (SELECT {kept} AS kept)))"""

    jaccard = "CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1.0 ELSE len(list_intersect({a}, {b})) / CAST(len(list_distinct(list_concat({a}, {b}))) AS DOUBLE) END"
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    o AS (SELECT doc_id, t, coalesce(lead(t) OVER (ORDER BY doc_id DESC), first_value(t) OVER (ORDER BY doc_id DESC)) AS nxt FROM d),
    e AS (SELECT doc_id, t, nxt, left(t, length(t) - length(t) // 2) || left(nxt, length(t) // 2) AS edited FROM o),
    s AS (SELECT doc_id, t, edited, {sigs('t')} AS a, {sigs('edited')} AS b, {sigs('nxt')} AS c FROM e)
    SELECT doc_id, CAST(length(t) AS BIGINT) AS n_chars, sha256(edited) AS edited_sha256,
      array_to_string(a, '') AS fingerprint, array_to_string(b, '') AS edited_fingerprint,
      CAST({jaccard.format(a='a', b='b')} AS DOUBLE) AS near_edited, CAST({jaccard.format(a='a', b='c')} AS DOUBLE) AS near_next
    FROM s"""
