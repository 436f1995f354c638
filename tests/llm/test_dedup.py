import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from pyrogrid.llm import exact_dedup, graph, simhash, substring_dedup
from pyrogrid.llm.chunking import gear_hash, masked_cuts, peak_cuts
from pyrogrid.llm.common import prepared, texts_of

KIND = "doc_id long, text string, row string, recipe int, fp string, kept int, digest string"


def frame(spark, rows):
    """(doc_id, text) rows with further columns whose names the operators use themselves."""
    prepared(spark)
    return spark.createDataFrame([(i, t, "x", 1, "y", 2, "z") for i, t in rows], KIND)


def words(seed, n):
    draw = random.Random(seed)
    return " ".join("".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 8))) for _ in range(n))


LONG = words(1, 40_000)
ROWS = [
    (1, "Same Text"), (2, "same text"), (3, "SAME TEXT"), (4, None), (5, ""), (6, "Ärger"), (7, "ärger"), (8, LONG), (9, LONG.upper()),
    (10, LONG[:-1] + "!"), (11, " "), (11, " "), (None, "lone"), (None, None),
]


def lowered(text):
    return (text or "").encode().lower()


def expected_groups(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(lowered(t), []).append(i)
    return sorted(
        (str(i), str(max((x for x in groups[lowered(t)] if x is not None), default=None)), len(groups[lowered(t)])) for i, t in rows
    )


def test_exact_groups_with_and_without_digest_clashes(spark):
    docs = frame(spark, ROWS)
    for bits in (64, 2):
        found = exact_dedup.groups(docs, digest_bits=bits).collect()
        assert sorted((str(r.doc_id), str(r.keep_id), r.group_size) for r in found) == expected_groups(ROWS)
        assert sum(r.kept for r in found) == len({lowered(t) for _, t in ROWS})
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["3", "5", "6", "7", "9", "10", "11", "None"])


def test_exact_groups_of_an_empty_table(spark):
    assert exact_dedup.groups(frame(spark, [])).count() == 0 and exact_dedup.keep_one(frame(spark, [])).count() == 0


def test_chunks_resist_insertions_and_ignore_neighbours():
    text = LONG.encode()
    data = np.frombuffer(text, dtype=np.uint8)
    alone = masked_cuts(data, np.array([0]), np.array([len(text)]), 512, 64, 4096)[0]
    two = masked_cuts(np.concatenate((data[:1000], data)), np.array([0, 1000]), np.array([1000, 1000 + len(text)]), 512, 64, 4096)[1]
    assert [c - 1000 for c in two] == alone and alone[-1] == len(text)
    shifted = np.frombuffer(text[:5000] + b"inserted words" + text[5000:], dtype=np.uint8)
    before, after = set(peak_cuts(data, 16).tolist()), {c - 14 for c in peak_cuts(shifted, 16).tolist()}
    assert {c for c in before if c > 5100} == {c for c in after if c > 5100}
    value = gear_hash(data[:3000])
    naive = [
        i + 1 for i in range(3000)
        if all(value[i] > value[j] for j in range(max(0, i - 17), i)) and all(value[i] >= value[j] for j in range(i + 1, min(3000, i + 17)))
    ]
    assert peak_cuts(data[:3000], 16).tolist() == naive


def naive_fingerprint(text):
    parts = lowered(text).split()
    if not parts:
        return 0
    shingles = [b" ".join(parts[i : i + 3]) for i in range(len(parts) - 2)] or [b" ".join(parts)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def naive_components(prints):
    ids = list(prints)
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[:k]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in ids}


def test_simhash_components_equal_all_pairs(spark):
    draw = random.Random(4)
    rows, base = [], [words(s, 60) for s in range(12)]
    for i in range(150):
        text = draw.choice(base).split()
        for _ in range(draw.choice((0, 0, 1, 1, 2))):
            text[draw.randrange(len(text))] = "changed"
        rows.append((i, " ".join(text)))
    rows += [(200, None), (201, ""), (202, " \t\n"), (203, "one"), (204, "One two"), (205, "one TWO"), (206, LONG)]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.components(frame(spark, rows)).collect()}
    prints = {i: naive_fingerprint(t) for i, t in rows}
    assert {i: f for i, (f, _) in got.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {i: c for i, (_, c) in got.items()} == naive_components(prints)
    kept = simhash.keep_one(frame(spark, rows))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(naive_components(prints).values()))


def test_simhash_links_of_crafted_fingerprints_are_complete(spark):
    prepared(spark)
    draw = random.Random(9)
    values = {0, 2**64 - 1}
    for _ in range(40):
        base = draw.getrandbits(64)
        values.add(base)
        for _ in range(8):
            near = base
            for bit in draw.sample(range(64), draw.choice((1, 2, 2, 3))):
                near ^= 1 << bit
            values.add(near)
    signed = {v - (1 << 64) if v >> 63 else v for v in values}
    got = {(r.src, r.dst) for r in simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long")).collect()}
    ordered = sorted(signed)
    mask = 2**64 - 1
    want = {(a, b) for i, a in enumerate(ordered) for b in ordered[i + 1 :] if ((a & mask) ^ (b & mask)).bit_count() <= 2}
    assert got == want


def test_simhash_without_ids_and_without_rows(spark):
    got = simhash.components(frame(spark, [(None, "a b c d"), (7, "a b c d"), (None, "other words are here")])).collect()
    assert sorted(str(r.component_id) for r in got) == ["7", "7", "None"]
    assert simhash.components(frame(spark, [])).count() == 0


def test_near_copies_go_whatever_their_ids(spark):
    one, two, three, four = (words(s, 60) for s in (61, 62, 63, 64))
    rows = [(None, one), (None, one), (None, two), (5, two), (7, three), (7, three), (3, four), (7, four), (None, four)]
    kept = simhash.keep_one(frame(spark, rows))
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == sorted([("None", one), ("5", two), ("7", three), ("3", four)])


def naive_similar(rows, similarity=0.8):
    """Of each group connected by all-pairs Jaccard of five-word shingles the smallest id."""
    parts = {i: lowered(t).split() for i, t in rows}
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)} for i, w in parts.items()}
    root = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= similarity:
                low, high = sorted((root[a], root[b]))
                root = {i: low if r == high else r for i, r in root.items()}
    return set(root.values())


def test_near_dedup_stage_equals_all_pairs_jaccard(spark):
    draw = random.Random(8)
    rows, base = [], [words(s, 120) for s in range(500, 506)]
    for i in range(150):
        text = draw.choice(base).split()
        for _ in range(draw.choice((0, 1, 2, 3, 4, 6))):
            text[draw.randrange(len(text))] = words(9000 + i, 1) + draw.choice("xyz")
        rows.append((i, " ".join(text)))
    rows += [(200, None), (201, ""), (202, " \t\n"), (203, "one"), (204, "One two"), (205, "one  TWO"), (206, LONG), (207, LONG + " more")]
    rows += [(208, " ".join("abcdefgh")), (209, " ".join("abcdefghi"))]
    kept = corpus_pipeline.drop_near_copies(spark, frame(spark, rows), "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(naive_similar(rows))
    assert corpus_pipeline.drop_near_copies(spark, frame(spark, []), "").count() == 0


def test_near_dedup_searches_fingerprints_of_the_shingle_sets(spark):
    prepared(spark)
    draw = random.Random(12)
    mask, pairs = 2**64 - 1, []
    for k in range(60):
        base, other = draw.getrandbits(64), 0
        for bit in draw.sample(range(64), k % 4):
            other |= 1 << bit
        pairs += [(2 * k, base), (2 * k + 1, base ^ other)]
    sets = spark.createDataFrame([(i, v - (1 << 64) if v >> 63 else v) for i, v in pairs], "set long, fp long")
    got = {(r.src, r.dst) for r in simhash.near_fingerprints(sets).collect()}
    assert {(2 * k, 2 * k + 1) for k in range(60)} <= got
    assert all(((pairs[a][1] ^ pairs[b][1]) & mask).bit_count() <= simhash.NEAR_DISTANCE for a, b in got)
    # A long text and its copy with one other word.
    text = words(90, 6000)
    rows = [(1, text), (2, text.replace(text.split()[250], "other", 1)), (3, words(91, 500))]
    found = simhash.shingle_sets(texts_of(frame(spark, rows)), 5, False).select(F.col("doc_id").alias("set"), "fp")
    assert [tuple(r) for r in simhash.near_fingerprints(found).collect()] == [(1, 2)]
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, frame(spark, rows), "").collect()} == {1, 3}


def test_substring_spans_cover_passages_and_spare_the_rest(spark):
    passage, line = words(50, 60), words(51, 9)
    rows = [(i, f"{words(100 + i, 80)}\n{line}\n{words(200 + i, 50)}") for i in range(8)]
    rows += [(20, f"{words(300, 40)} {passage} {words(301, 33)}"), (21, f"é{words(302, 7)} {passage}"), (22, f"{passage}\n{words(303, 90)}")]
    rows += [(30, None), (31, ""), (32, "short"), (33, "na " * 400), (34, f"{words(400, 60)} x {words(400, 60)}"), (None, passage)]
    docs = frame(spark, rows)
    found = substring_dedup.spans(docs)
    got = found.collect()
    texts = dict(rows)
    assert {r.doc_id for r in got} == {20, 21, 22}
    assert {r.doc_id for r in got if r.is_first} == {20} and {r.first_doc_id for r in got} == {20}
    for r in got:
        part = texts[r.doc_id][r.start : r.end]
        assert len(part.split()) >= 25 and part.strip() in " ".join((passage, "")) + "\n" or part.strip() in texts[20] + texts[22]
    short = {r.doc_id: r.text for r in substring_dedup.without_repeats(docs.filter("doc_id is not null"), found).collect()}
    assert short[20] == texts[20] and len(short[21]) < len(texts[21]) - 150 and short[30] is None and short[0] == texts[0]
    assert substring_dedup.spans(frame(spark, [])).count() == 0


def test_substring_counts_a_repeated_row_as_one_document(spark):
    text = words(7, 120)
    assert substring_dedup.spans(frame(spark, [(1, text), (1, text)])).count() == 0
    assert {r.doc_id for r in substring_dedup.spans(frame(spark, [(1, text), (1, text), (2, text)])).collect()} == {1, 2}


def test_substring_finds_passages_of_scripts_without_spaces(spark):
    draw = random.Random(4)
    passage, *others = ("".join(chr(0x4E00 + draw.randrange(4000)) for _ in range(n)) for n in (400, 300, 300, 120))
    rows = [(1, others[0] + passage), (2, passage + others[1]), (3, others[2]), (4, "x" + others[2])]
    got = substring_dedup.spans(frame(spark, rows)).collect()
    assert {r.doc_id for r in got} == {1, 2} and {r.doc_id for r in got if r.is_first} == {1}
    assert all(r.end - r.start > 330 and rows[r.doc_id - 1][1][r.start : r.end] in passage for r in got)


def test_substring_first_copy_is_whole_where_an_earlier_text_has_a_part(spark):
    left, line, right = words(70, 22), words(71, 20), words(72, 22)
    passage = f"{left} {line} {right}"
    rows = [(1, f"{words(80, 40)} {line} {words(81, 40)}"), (2, f"{words(82, 40)} {passage} {words(83, 40)}"), (3, f"{words(84, 40)} {passage} {words(85, 40)}")]
    got = [r for r in substring_dedup.spans(frame(spark, rows)).collect() if r.doc_id == 2]
    text = rows[1][1]
    at, end = text.index(passage), text.index(passage) + len(passage)
    covered = {k for r in got for k in range(r.start, r.end)}
    assert len(covered & set(range(at, end))) > 0.7 * len(passage) and {r.is_first for r in got} == {True, False}
    assert sum(r.end - r.start for r in got) == len(covered)


def test_large_groups_of_copies_stay_whole(spark):
    prepared(spark)
    docs = spark.range(3000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the one text that a third shares").otherwise(F.concat(F.lit("text "), F.col("id"))).alias("text")
    )
    group = exact_dedup.groups(docs).filter("group_size > 1")
    assert group.count() == 1000 and group.select("keep_id").distinct().first()[0] == 2997
    assert simhash.components(docs).filter("component_id = 0").count() == 1000


HELPERS = ["row", "row_1", "_row", "id", "place", "root", "_key", "_sha", "_n", "salt", "digest", "fp", "key", "part", "text_sha256", "recipe"]


def test_stages_pass_columns_named_like_helpers(spark):
    rows = [(1, "one two three four five six seven"), (2, "ONE two three four five six seven"), (None, "other words in this one here"), (None, "other words in this one here"), (4, None)]
    docs = spark.createDataFrame([(i, t, *[f"{n}{k}" for n in HELPERS]) for k, (i, t) in enumerate(rows)], "doc_id long, text string, " + ", ".join(f"{n} string" for n in HELPERS))
    exact = exact_dedup.keep_one(docs)
    near = simhash.keep_one(docs, 5, 0.8)
    bits = simhash.keep_one(docs)
    assert exact.columns == near.columns == bits.columns == docs.columns
    given = {tuple(r) for r in docs.collect()}
    for out, ids in ((exact, [2, 4, None]), (near, [1, 4, None]), (bits, [1, 4, None])):
        found = out.collect()
        assert {tuple(r) for r in found} <= given and sorted((r.doc_id for r in found), key=str) == sorted(ids, key=str)


def test_a_large_group_of_near_copies_is_one(spark):
    draw = random.Random(5)
    base = words(77, 60).split()
    rows = []
    for i in range(120):
        text = list(base)
        for _ in range(draw.choice((0, 1, 2, 3))):
            text[draw.randrange(60)] = words(10_000 + i, 1)
        rows.append((i, " ".join(text)))
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), 5, 0.8)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(naive_similar(rows))


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (103, 102), (102, 100)]
    got = dict(map(tuple, graph.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()))
    assert {got.get(i, i) for i in range(61)} == {0} and {got.get(i, i) for i in range(100, 104)} == {100}
