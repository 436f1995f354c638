import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pyrogrid.llm import gated_lm as g
from pyrogrid.llm.common import prepared

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def found(spark):
    docs = prepared(spark).read.parquet(f"{SF}/documents.parquet")
    return {r.doc_id: r.text for r in docs.collect()}, {r.doc_id: r for r in g.scored(docs).collect()}


def tokens(text):
    return [w.lower() for w in (text or "").encode().split()] + [None]


def test_counts_and_base_equal_plain_counting(found):
    texts, rows = found
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    counts = Counter(t for i, text in texts.items() if not out[i] for t in tokens(text))
    total, distinct = sum(counts.values()), len(counts)
    assert rows.keys() == texts.keys()
    for i, r in rows.items():
        own = tokens(texts[i])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[i], len(own), sum(counts[t] > 0 for t in own), total)
        assert math.isclose(r.base_score, sum(math.log10((counts[t] + 1) / (total + distinct + 1)) for t in own), rel_tol=1e-9)


def test_held_out_texts_are_likelier_than_by_counts(found):
    own = [r for r in found[1].values() if r.held_out]
    assert len(own) > 100 and all(r.score < 0 for r in own)
    assert sum(r.score for r in own) > 0.99 * sum(r.base_score for r in own)
    assert sum(r.score for r in own) / sum(r.n_tokens for r in own) > sum(r.base_score for r in own) / sum(r.n_tokens for r in own) + 0.05
    assert np.mean([r.score > r.base_score for r in own]) > 0.9


def small(modelled=9, others=5, state=4):
    counts = np.arange(modelled + others, 0, -1)
    vocabulary = g.Vocabulary([bytes([97 + k]) for k in range(modelled + others)], counts, int(counts.sum()), len(counts), modelled)
    return vocabulary, g.Network.initial(vocabulary, state)


def naive(network, text):
    """Log-probability of the numbers of one text, one token after the other, and the whole distribution at each place."""
    def sigmoid(x):
        return 1 / (1 + np.exp(-x))

    size, h, x, total, sums = network.state, np.zeros(network.state), network.modelled + 1, 0.0, []
    for token in text:
        e, u = network.enter[x].astype(float), h @ network.carry
        z, r = sigmoid(e[:size] + u[:size]), sigmoid(e[size : 2 * size] + u[size : 2 * size])
        h = (1 - z) * np.tanh(e[2 * size :] + r * u[2 * size :]) + z * h
        logits = h @ network.classes + network.class_bias
        classes = np.exp(logits) / np.exp(logits).sum()
        each = {network.modelled: classes[-1]}
        for c in range(g.CLASSES):
            own = range(c * network.per_class, (c + 1) * network.per_class)
            inner = np.exp([network.words[k] @ h + network.word_bias[k] for k in own])
            each |= {k: classes[c] * p / inner.sum() for k, p in zip(own, inner, strict=True) if k < network.modelled}
        total += math.log(each[token])
        sums.append(sum(each.values()))
        x = token
    return total, sums


def test_likelihood_equals_a_plain_recurrence_and_sums_to_one():
    vocabulary, network = small()
    draw = np.random.RandomState(2)
    texts = [draw.randint(0, 10, n) for n in (1, 3, 60, 17, 16, 33, 2, 1)]
    for lanes in (1, 3, 50):
        got = g.log_likelihoods(network, texts, lanes)
        for value, text in zip(got, texts, strict=True):
            want, sums = naive(network, text)
            assert math.isclose(value, want, rel_tol=1e-4) and np.allclose(sums, 1.0, atol=1e-5)
    rest = 10 ** vocabulary.within_rest(np.append(vocabulary.counts[9:], 0))
    assert math.isclose(rest.sum(), 1.0)


def test_slopes_equal_differences():
    _, network = small()
    network = g.Network(network.modelled, [w.astype(np.float64) for w in network.weights])
    texts = [np.random.RandomState(k).randint(0, 10, n) for k, n in enumerate((5, 9, 2, 12))]
    inputs, targets, keep, active, _ = next(g.windows(texts, network.modelled + 1, 3, 40))

    def loss():
        return network.gradients(inputs, targets, keep, active, np.zeros((inputs.shape[1], network.state)))[0]

    _, slopes = network.gradients(inputs, targets, keep, active, np.zeros((inputs.shape[1], network.state)))
    draw = np.random.RandomState(3)
    for weight, slope in zip(network.weights, slopes, strict=True):
        if isinstance(slope, tuple):
            whole = np.zeros_like(weight)
            whole[slope[0]] += slope[1]
            slope = whole
        for _ in range(12):
            at = tuple(draw.randint(n) for n in weight.shape)
            if weight[at] < -50:
                continue
            before = weight[at]
            weight[at] = before + 1e-4
            up = loss()
            weight[at] = before - 1e-4
            down = loss()
            weight[at] = before
            # States are held in single precision.
            assert abs((up - down) / 2e-4 - slope[at]) < 2e-2 * max(1.0, abs(slope[at]))


def test_windows_hold_every_token_once_behind_its_predecessor():
    draw = np.random.RandomState(5)
    texts = [draw.randint(0, 9, n) for n in draw.randint(1, 40, 30)]
    seen = {k: [] for k in range(30)}
    for inputs, targets, keep, active, owner in g.windows(texts, 77, 7, 6):
        for t in range(len(inputs)):
            for lane in range(active[t]):
                text = seen[owner[t, lane]]
                assert inputs[t, lane] == (text[-1] if text else 77) and keep[t, lane] == (1.0 if text else 0.0)
                text.append(targets[t, lane])
    assert all((np.array(seen[k]) == texts[k]).all() for k in seen)


def test_training_lowers_the_loss():
    _, network = small(modelled=9, state=8)
    texts = [np.array([0, 1, 2, 3] * 20) for _ in range(400)]
    before = g.log_likelihoods(network, texts[:1])[0]
    assert g.learn(network, texts, lanes=8) > 400 * 80 / 4
    assert g.log_likelihoods(network, texts[:1])[0] > 0.5 * before


def test_every_token_is_learned_from_once():
    _, network = small(modelled=9, state=4)
    draw = np.random.RandomState(8)
    texts = [draw.randint(0, 10, n) for n in [*draw.randint(1, 60, 90), 700]]
    for lanes in (1, 8, 256):
        assert g.learn(network, texts, lanes=lanes) == sum(len(t) for t in texts)


def test_rows_of_logits_far_apart_keep_their_chances():
    logits = np.array([[0, 1, -300], [-400, -399, -401], [90, 80, 0]], dtype=np.float32)
    exact = np.exp(logits.astype(float) - logits.max(axis=1, keepdims=True))
    exact /= exact.sum(axis=1, keepdims=True)
    assert np.allclose(g._softmax(logits.copy()), exact, atol=1e-6)
    assert np.allclose(g._log_softmax_at(logits.copy(), np.array([0, 2, 1])), np.log(exact[[0, 1, 2], [0, 2, 1]]), rtol=1e-5)


def test_few_counted_words_give_the_same_counts(spark, monkeypatch):
    """Words beyond the broadcast table meet their counts in the join."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 150")
    counts = g.stored(g.token_counts(g.open_rows(docs)))
    network = g.Network.initial(g.learn_vocabulary(counts))
    whole, few = (
        {r.doc_id: r for r in g.score(docs, g.Model(counts, g.learn_vocabulary(counts, counted=n, modelled=32), g.Network.initial(g.learn_vocabulary(counts, counted=n, modelled=32)))).collect()}
        for n in (1 << 18, 100)
    )
    assert network.modelled == g.MODELLED and len(g.learn_vocabulary(counts, counted=100).counts) <= 101
    for i, r in whole.items():
        assert r[1:3] == few[i][1:3] and np.allclose(r[3:], few[i][3:], rtol=1e-6)


def test_edges(spark):
    prepared(spark)
    rows = [(i, "the cat sat on the mat " * (i % 4), 1, "x") for i in range(30)]
    rows += [(None, "The cat", 2, "y"), (40, None, 0, None), (41, "", 0, None), (42, " \t", 0, None), (42, " \t", 0, None), (43, "never seen words ", 0, ""), (44, "dog the " * 60_000, 0, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, score string")
    found = g.scored(docs).collect()
    assert len(found) == len(rows) and all(r.score <= 0 and math.isfinite(r.score) for r in found)
    assert len({r.score for r in found if r.doc_id in (40, 41, 42)}) == 1 and {r.n_tokens for r in found if r.doc_id in (40, 41)} == {1}
    assert next(r.n_tokens for r in found if r.doc_id == 44) == 120_001
    assert next(r.held_out for r in found if r.doc_id is None) is False
    assert g.scored(docs.limit(0)).count() == 0
    outside = docs.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2)
    assert {(r.base_score, r.score, r.n_known, r.train_tokens) for r in g.scored(outside).collect()} == {(0.0, 0.0, 0, 0)}
