import hashlib
import random
import zlib

import numpy as np
import pytest

from pyrogrid.llm import periodic_runs as pr
from pyrogrid.llm.common import prepared

SF = "/root/testdata/sf0.01"


def naive_runs(w, exponent=4, least=6):
    """Maximal stretches of each period that have no smaller period."""
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i >= q and (i, j + q) not in found:
                found[i, j + q] = q
            i = j + 1
    return sorted((a, b - a, q) for (a, b), q in found.items() if b - a >= max(least, exponent * q))


def naive_lyndon(w):
    """Distance to the next smaller suffix."""
    return [next((j for j in range(i + 1, len(w)) if w[j:] < w[i:]), len(w)) - i for i in range(len(w))]


def strings(seed, count):
    draw = random.Random(seed)
    out = [[], [0], [0] * 9, [0, 1] * 6, [0, 0, 1] * 8 + [0], list(range(12))]
    for _ in range(count):
        w = [draw.randrange(draw.choice((1, 2, 3, 5, 20))) for _ in range(draw.randrange(70))]
        if draw.random() < 0.6 and w:
            a = draw.randrange(len(w))
            p = draw.randrange(1, 9)
            w[a:] = [w[a + (i - a) % p] if a + (i - a) % p < len(w) else 0 for i in range(a, len(w))]
        out.append(w)
    return out


@pytest.mark.parametrize("sign", [1, -1])
def test_lyndon_words_of_many_stretches_at_once(sign):
    own = [w for w in strings(3, 300) if w]
    sizes = np.array([len(w) for w in own])
    got, _ = pr.lyndon_words(sign * np.concatenate(own), np.cumsum(sizes) - sizes, sizes)
    assert got.tolist() == [x for w in own for x in naive_lyndon([sign * v for v in w])]


@pytest.mark.parametrize(("exponent", "least"), [(2, 2), (3, 3), (3, 5), (4, 6), (5, 9)])
def test_runs_equal_brute_force(exponent, least):
    texts = strings(exponent, 400)
    found = pr.find_runs([np.array(w, dtype=np.int64) for w in texts], exponent, least)
    for w, runs in zip(texts, found, strict=True):
        assert [tuple(r) for r in runs.tolist()] == naive_runs(w, exponent, least)


def test_blocks_of_stretches_give_the_same_runs(monkeypatch):
    texts = [np.array(w, dtype=np.int64) for w in strings(9, 200)]
    whole = pr.find_runs(texts)
    monkeypatch.setattr(pr, "BLOCK_WORDS", 50)
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(whole, pr.find_runs(texts), strict=True))


def test_long_texts():
    long = ["a"] * 300_000
    mixed = [str(i) for i in range(50_000)] + ["x", "y", "z"] * 40_000 + ["q"] + ["x", "y"] * 3
    found = pr.find_runs(pr.numbered([[w.encode() for w in t] for t in (long, mixed)]))
    assert found[0].tolist() == [[0, 300_000, 1]] and found[1].tolist() == [[50_000, 120_000, 3]]


def edited(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def naive_report(doc_id, text):
    words = edited(doc_id, (text or "").encode().split())
    runs = naive_runs(words)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None, None, None)
    dropped = {i for a, n, q in runs for i in range(a + q, a + n)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    listed = "".join(f"{a},{n},{q}\n" for a, n, q in runs).encode()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(listed).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_report_equals_brute_force_on_documents(spark):
    docs = prepared(spark).read.parquet(f"{SF}/documents.parquet")
    want = {r.doc_id: naive_report(r.doc_id, r.text) for r in docs.collect() if r.text is None or len(r.text) < 3000}
    got = {r.doc_id: tuple(r) for r in pr.run_report(docs).collect()}
    assert len(got) == docs.count() and {i: got[i] for i in want} == want
    assert sum(r[1] > 0 for r in want.values()) > 20


def test_edges(spark):
    prepared(spark)
    rows = [(None, "a a a a a a"), (1, None), (2, ""), (3, " \t\n"), (4, "b " * 5), (4, "b " * 6), (4, "b " * 6), (5, "é ü " * 4 + " "), (6, "x\x0by\x0c" * 5)]
    docs = spark.createDataFrame([(i, t, 1, "x", [2]) for i, t in rows], "doc_id long, text string, n_runs int, runs string, start array<int>")
    got = sorted((tuple(r) for r in pr.run_report(docs).collect()), key=repr)
    assert got == sorted((naive_report(i, t) for i, t in rows), key=repr)
    assert pr.run_report(docs.limit(0)).count() == 0 and pr.periodic_runs(docs.limit(0)).count() == 0


def test_collapsed_text_and_spans(spark):
    prepared(spark)
    docs = spark.createDataFrame([(1, "go  on and on and on and on and on\nnow"), (2, None)], "doc_id long, text string")
    first, second = sorted(pr.periodic_runs(docs).collect())
    assert [tuple(r) for r in first.runs] == [(1, 9, 2)] and first.collapsed == "go on and now"
    assert second.runs == [] and second.collapsed == ""
