"""Language-model scoring: a gated recurrent network over words with a class-factored softmax.

What is learned, all from the training rows (``open_rows``) and all of them:

- Counts of every token: the words of the texts, A to Z lower-cased, and one end per
  text.  The table of counts is grouped by Spark and stays there.
- The vocabulary of the network: the MODELLED most frequent tokens, in CLASSES classes
  of like rank.  All other tokens form one further class, inside which a token's
  probability follows the table of counts, with one added to each and one for all
  tokens never met.  So every token has a probability, and they sum to one.
- The network: a gated recurrent unit whose state predicts the class of the next token
  and then the token within the class.  Output biases start at the counts' logarithms.

Training goes through all training rows once, in ROUNDS rounds over disjoint halves.
In a round every task starts from the same weights, reads its texts, LANES side by side,
in windows of WINDOW tokens (more where few lanes are left) with the state carried from
window to window until a text ends, runs truncated backpropagation over every window, and
hands back its weights; they are averaged by tokens learned, block by block in Spark, so only one
bounded set reaches the driver.  What is learned from grows in proportion to the rows.

Scoring reads each text once.  Tokens among the COUNTED most frequent are looked up in
a broadcast table of that bounded size; the others, each with a smaller count than any
of those, meet the table of counts in a join.  A text's likelihood is the sum over its
whole length: the state is carried across windows.

A null text counts as empty and is one end token.  Rows without id are learned from.
Repeated rows are scored each; other columns play no part.  Without training rows the
only probability is that of the tokens never met, which is one: both scores are 0.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyrogrid.llm.common import rows_of
from pyrogrid.session import stored

# The end of a text; no word is empty.
END = b""
HELD_OUT_OF, HELD_OUT = 7, 2

MODELLED, CLASSES = 2048, 32
COUNTED = 1 << 18
STATE = 16
ROUNDS, WINDOW, LANES, RATE = 2, 16, 256, 0.12
SCORE_LANES = 512
# Tokens that a task holds at once (longer texts are held alone).
POOL = 2_000_000
# Distinct words that a counting task holds before it hands them on.
HELD_WORDS = 400_000
BLOCK = 4096


def held_out(doc_id: Column) -> Column:
    """Rows the model does not learn from: crc32 of the id as text leaves 2 when divided by 7 (no id: false)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % HELD_OUT_OF == HELD_OUT, F.lit(False))


def open_rows(docs: DataFrame) -> DataFrame:
    return docs.filter(~held_out(F.col("doc_id"))).select("doc_id", "text")


def tokens_of(text: bytes) -> list[bytes]:
    """Words between ASCII white space with A to Z lower-cased, and the end."""
    words = text.lower().split()
    words.append(END)
    return words


def token_counts(docs: DataFrame) -> DataFrame:
    """(token, n) over all of ``docs`` (text)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()
        for _, texts in rows_of(batches):
            for text in texts:
                held.update(tokens_of(text))
            if len(held) > HELD_WORDS:
                yield pa.record_batch([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], names=["token", "n"])
                held = Counter()
        if held:
            yield pa.record_batch([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], names=["token", "n"])

    return docs.select("text").mapInArrow(of, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


class Vocabulary:
    """The most frequent tokens with their counts, and the sums over all tokens."""

    def __init__(self, tokens: list[bytes], counts: np.ndarray, total: int, distinct: int, modelled: int = MODELLED) -> None:
        self.number = {t: k for k, t in enumerate(tokens)}
        self.counts, self.total, self.distinct = counts, total, distinct
        self.modelled = min(modelled, len(tokens))
        # The class of all other tokens.
        self.rest_total = total - int(counts[: self.modelled].sum())
        self.rest_distinct = distinct - self.modelled

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 1) / (self.total + self.distinct + 1))

    def within_rest(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 1) / (self.rest_total + self.rest_distinct + 1))


def learn_vocabulary(counts: DataFrame, counted: int = COUNTED, modelled: int = MODELLED) -> Vocabulary:
    """The most frequent of ``counts`` (token, n): all from some count on, at most ``counted`` and the end."""
    total, distinct = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
    # Eight steps per power of two: a few hundred sums, whatever the number of tokens.
    step = F.floor(F.log2("n") * 8)
    held, least = 0, None
    for size, tokens in sorted(counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("tokens")).collect(), reverse=True):
        held += tokens
        if held > counted:
            break
        least = size
    frequent = F.col("token") == F.lit(END)
    if least is not None:
        frequent = frequent | (step >= least)
    top = counts.filter(frequent).select("token", "n").toArrow()
    tokens, n = top["token"].to_pylist(), top["n"].to_numpy()
    order = sorted(range(len(tokens)), key=lambda k: (-n[k], tokens[k]))
    # The end is in every training text; whatever its rank, the network models it.
    end = next((place for place, k in enumerate(order) if tokens[k] == END), 0)
    if end >= modelled:
        order.insert(modelled - 1, order.pop(end))
    return Vocabulary([tokens[k] for k in order], n[order].astype(np.int64), int(total or 0), distinct, modelled)


# --- the network ---------------------------------------------------------------------


# Row sums below this are taken again with the row's own largest logit.
LEAST_SUM = 1e-20


def _exponents(logits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(exponentials, their row sums, what was subtracted): of all logits the largest, or each row's where rows lie far apart."""
    ones, most = np.ones(logits.shape[1], dtype=logits.dtype), logits.max(initial=-np.inf)
    out = np.exp(logits - most)
    sums = out @ ones
    if sums.min(initial=np.inf) < LEAST_SUM:
        most = logits.max(axis=1)
        np.exp(logits - most[:, None], out=out)
        sums = out @ ones
    return out, sums, most


def _softmax(logits: np.ndarray) -> np.ndarray:
    out, sums, _ = _exponents(logits)
    out /= sums[:, None]
    return out


def _log_softmax_at(logits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Per row the log-probability of place ``at``."""
    _, sums, most = _exponents(logits)
    return logits[np.arange(len(at)), at] - most - np.log(sums)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.multiply(x, 0.5, out=x)
    np.tanh(x, out=x)
    x += 1.0
    x *= 0.5
    return x


class Network:
    """Weights by name: enter (per token, three gates), carry, classes, class_bias, words, word_bias.

    Token numbers below ``modelled`` are words of the vocabulary; ``modelled`` stands
    for every other token and, as an input, modelled + 1 for the start of a text.
    """

    NAMES = ("enter", "carry", "classes", "class_bias", "words", "word_bias")

    def __init__(self, modelled: int, weights: list[np.ndarray]) -> None:
        self.modelled = modelled
        self.weights = weights
        self.enter, self.carry, self.classes, self.class_bias, self.words, self.word_bias = weights
        self.state = self.carry.shape[0]
        self.per_class = self.words.shape[0] // CLASSES

    @classmethod
    def initial(cls, vocabulary: Vocabulary, state: int = STATE, seed: int = 12) -> Network:
        """Random weights under biases that state the counts."""
        draw = np.random.Generator(np.random.PCG64(seed))
        modelled = vocabulary.modelled
        per_class = max(1, -(-modelled // CLASSES))
        counts = np.zeros(CLASSES * per_class)
        counts[:modelled] = vocabulary.counts[:modelled] + 1
        mass = np.append(counts.reshape(CLASSES, per_class).sum(axis=1), vocabulary.rest_total + vocabulary.rest_distinct + 1)
        with np.errstate(divide="ignore"):
            # Places without a word are out of reach.
            word_bias = np.maximum(np.log(counts), -60.0)
            class_bias = np.maximum(np.log(mass / mass.sum()), -60.0)
        weights = [
            draw.normal(0, 0.3, (modelled + 2, 3 * state)), draw.normal(0, 1 / np.sqrt(state), (state, 3 * state)),
            draw.normal(0, 0.1, (state, CLASSES + 1)), class_bias, draw.normal(0, 0.1, (CLASSES * per_class, state)), word_bias,
        ]
        return cls(modelled, [w.astype(np.float32) for w in weights])

    def advance(self, inputs: np.ndarray, keep: np.ndarray, active: np.ndarray, state: np.ndarray, trace: dict[str, np.ndarray] | None = None) -> np.ndarray:
        """States (window, lanes, state) after each input; ``state`` is carried on in place.

        ``keep`` is 0 where a text starts; only the first active[t] lanes run at step t.
        A ``trace`` receives what backpropagation needs, each as (window, lanes, ...).
        """
        size = self.state
        out = np.zeros((len(inputs), state.shape[0], size), dtype=np.float32)
        entered = self.enter[inputs]
        if trace is not None:
            trace |= {"before": np.zeros_like(out), "gates": np.zeros_like(entered[..., : 2 * size]), "new": np.zeros_like(out), "carried": np.zeros_like(out)}
        keep = keep[:, :, None]
        for t, n in enumerate(active.tolist()):
            h, own = state[:n], entered[t, :n]
            h *= keep[t, :n]
            carried = h @ self.carry
            gates = _sigmoid(carried[:, : 2 * size] + own[:, : 2 * size])
            new = gates[:, size:] * carried[:, 2 * size :]
            new += own[:, 2 * size :]
            np.tanh(new, out=new)
            if trace is not None:
                trace["before"][t, :n], trace["gates"][t, :n], trace["new"][t, :n], trace["carried"][t, :n] = h, gates, new, carried[:, 2 * size :]
            h -= new
            h *= gates[:, :size]
            h += new
            out[t, :n] = h
        return out

    def log_probabilities(self, states: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Natural logarithms for (rows, state) and token numbers; for ``modelled`` that of the class of other tokens."""
        known = targets < self.modelled
        of = np.where(known, targets // self.per_class, CLASSES)
        out = _log_softmax_at(states @ self.classes + self.class_bias, of)
        rows, runs = self._by_class(of)
        if runs:
            logits = self._word_logits(states[rows], runs)
            out[rows] += _log_softmax_at(logits, targets[rows] - of[rows] * self.per_class)
        return out

    @staticmethod
    def _by_class(of: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """Rows of modelled words in the order of their classes, and each class's (begin, end, class) there."""
        order = np.argsort(of.astype(np.int16), kind="stable")
        ends = np.cumsum(np.bincount(of, minlength=CLASSES + 1)[:CLASSES]).tolist()
        runs = [(a, b, k) for k, (a, b) in enumerate(zip([0, *ends], ends, strict=False)) if a < b]
        return order[: ends[-1]], runs

    def _word_logits(self, states: np.ndarray, runs: list[tuple[int, int, int]]) -> np.ndarray:
        """Logits of the words of its class for each row; rows lie in the order of ``runs``."""
        size = self.per_class
        out = np.empty((len(states), size), dtype=states.dtype)
        for a, b, k in runs:
            own = slice(k * size, (k + 1) * size)
            np.matmul(states[a:b], self.words[own].T, out=out[a:b])
            out[a:b] += self.word_bias[own]
        return out

    def gradients(self, inputs: np.ndarray, targets: np.ndarray, keep: np.ndarray, active: np.ndarray, state: np.ndarray) -> tuple[float, list]:
        """Minus the log-likelihood of a window, and its slopes: arrays, or (rows, slopes) for tables by row.

        Backpropagation ends at the window's start; ``state`` is carried on in place.
        """
        size, lanes = self.state, state.shape[0]
        trace: dict[str, np.ndarray] = {}
        states = self.advance(inputs, keep, active, state, trace)
        used = np.arange(lanes)[None, :] < active[:, None]
        flat, wanted = states[used], targets[used]
        known = wanted < self.modelled
        of = np.where(known, wanted // self.per_class, CLASSES)
        chance = _softmax(flat @ self.classes + self.class_bias)
        rows = np.arange(len(of))
        loss = -float(np.log(chance[rows, of]).sum())
        chance[rows, of] -= 1.0
        slopes = [None, None, flat.T @ chance, chance.sum(axis=0), None, None]
        back = chance @ self.classes.T
        own, runs = self._by_class(of)
        if runs:
            heard, size_in = flat[own], self.per_class
            inside = _softmax(self._word_logits(heard, runs))
            at = (np.arange(len(own)), wanted[own] - of[own] * size_in)
            loss -= float(np.log(inside[at]).sum())
            inside[at] -= 1.0
            word_slopes = np.empty((len(runs) * size_in, size), dtype=inside.dtype)
            bias_slopes = np.empty(len(word_slopes), dtype=inside.dtype)
            word_rows = np.concatenate([np.arange(k * size_in, (k + 1) * size_in) for _, _, k in runs])
            returned, ones = np.empty_like(heard), np.ones(len(own), dtype=inside.dtype)
            for place, (a, b, k) in enumerate(runs):
                to = slice(place * size_in, (place + 1) * size_in)
                np.matmul(inside[a:b].T, heard[a:b], out=word_slopes[to])
                np.matmul(ones[a:b], inside[a:b], out=bias_slopes[to])
                np.matmul(inside[a:b], self.words[k * size_in : (k + 1) * size_in], out=returned[a:b])
            back[own] += returned
            slopes[4], slopes[5] = (word_rows, word_slopes), (word_rows, bias_slopes)
        reaching = np.zeros_like(states)
        reaching[used] = back
        update, reset, new = trace["gates"][..., :size], trace["gates"][..., size:], trace["new"]
        # What a state's slope is multiplied by for the slopes of the gates and of what is carried.
        left = 1.0 - update
        inner = left * (1.0 - new * new)
        factors = np.empty((len(inputs), lanes, 3, size), dtype=inner.dtype)
        np.multiply((trace["before"] - new) * update, left, out=factors[:, :, 0])
        np.multiply(inner, reset, out=factors[:, :, 2])
        np.multiply(factors[:, :, 2] * (1.0 - reset), trace["carried"], out=factors[:, :, 1])
        through = np.zeros_like(factors)
        flat_through, back_carry = through.reshape(len(inputs), lanes, 3 * size), np.ascontiguousarray(self.carry.T)
        passed = update * keep[:, :, None]
        for t in range(len(inputs) - 1, -1, -1):
            n = int(active[t])
            slope = reaching[t, :n]
            np.multiply(slope[:, None, :], factors[t, :n], out=through[t, :n])
            if t:
                following = flat_through[t, :n] @ back_carry
                following *= keep[t, :n, None]
                following += slope * passed[t, :n]
                reaching[t - 1, :n] += following
        slopes[1] = trace["before"].reshape(-1, size).T @ flat_through.reshape(-1, 3 * size)
        before_gates = flat_through
        before_gates[..., 2 * size :] = reaching * inner
        numbers = inputs[used]
        order = np.argsort(numbers, kind="stable")
        starts = np.flatnonzero(np.diff(numbers[order], prepend=-1))
        slopes[0] = (numbers[order][starts], np.add.reduceat(before_gates[used][order], starts, axis=0))
        return loss, slopes


# --- texts side by side --------------------------------------------------------------


def lanes_of(lengths: np.ndarray, lanes: int) -> list[list[int]]:
    """Texts dealt to at most ``lanes`` lanes of like length; the longest lane first."""
    count = min(lanes, len(lengths))
    heap = [(0, k) for k in range(count)]
    out: list[list[int]] = [[] for _ in range(count)]
    for text in np.argsort(-lengths, kind="stable").tolist():
        load, lane = heapq.heappop(heap)
        out[lane].append(text)
        heapq.heappush(heap, (load + int(lengths[text]), lane))
    # Long and short texts take turns, so that no end of training is all short ones.
    draw = np.random.Generator(np.random.PCG64(len(lengths)))
    return sorted((draw.permutation(own).tolist() for own in out), key=lambda own: -int(lengths[own].sum()))


def windows(texts: list[np.ndarray], start: int, lanes: int, width: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(inputs, targets, keep, active, text number) for each window of ``width`` steps of all lanes, or more steps of the last ones.

    Inputs are a text's tokens behind the number ``start``, targets the tokens.
    """
    if not texts:
        return
    lengths = np.array([len(t) for t in texts])
    dealt = lanes_of(lengths, lanes)
    loads = np.array([int(lengths[own].sum()) for own in dealt])
    order = np.concatenate([np.array(own) for own in dealt])
    # All lanes one after the other; a lane is a stretch of these.
    tokens = np.concatenate([texts[k] for k in order.tolist()])
    owners = np.repeat(order, lengths[order])
    begins = np.cumsum(lengths[order]) - lengths[order]
    entering = np.concatenate(([start], tokens[:-1]))
    entering[begins] = start
    going_on = np.ones(len(tokens), dtype=np.float32)
    going_on[begins] = 0.0
    offsets = np.cumsum(loads) - loads
    at = 0
    while at < loads[0]:
        running = int((loads > at).sum())
        # Where few lanes are left, a window takes more steps, so that it holds about as many tokens.
        steps = np.arange(at, min(at + width * max(1, len(loads) // (4 * running)), int(loads[0])))
        at = int(steps[-1]) + 1
        active = (loads[None, :running] > steps[:, None]).sum(axis=1)
        # Lanes that have ended repeat their last place, which nobody reads.
        place = offsets[:running] + np.minimum(steps[:, None], loads[:running] - 1)
        yield entering[place], tokens[place], going_on[place], active, owners[place]


def learn(network: Network, texts: list[np.ndarray], lanes: int = LANES, squares: list[np.ndarray] | None = None) -> int:
    """One pass of truncated backpropagation over the texts' token numbers; the count of tokens learned.

    ``squares`` holds the sums of squared slopes that scale each weight's steps.
    """
    if squares is None:
        squares = [np.zeros_like(w) for w in network.weights]
    learned, state = 0, None
    # A window that few lanes are left in makes a small step.
    full = np.float32(lanes * WINDOW)
    for inputs, targets, keep, active, _ in windows(texts, network.modelled + 1, lanes, WINDOW):
        running = inputs.shape[1]
        state = np.zeros((running, network.state), dtype=np.float32) if state is None else state[:running]
        _, slopes = network.gradients(inputs, targets, keep, active, state)
        learned += int(active.sum())
        for weight, square, slope in zip(network.weights, squares, slopes, strict=True):
            if slope is None:
                continue
            rows, slope = slope if isinstance(slope, tuple) else (slice(None), slope)
            slope = slope / full
            scale = slope * slope
            scale += square[rows]
            square[rows] = scale
            np.sqrt(scale, out=scale)
            scale += 1e-8
            slope *= RATE
            slope /= scale
            weight[rows] -= slope
    return learned


def log_likelihoods(network: Network, texts: list[np.ndarray], lanes: int = SCORE_LANES) -> np.ndarray:
    """Natural log-likelihood of each text's token numbers, the state carried over its whole length."""
    out, state = np.zeros(len(texts)), None
    for inputs, targets, keep, active, owner in windows(texts, network.modelled + 1, lanes, WINDOW):
        running = inputs.shape[1]
        state = np.zeros((running, network.state), dtype=np.float32) if state is None else state[:running]
        states = network.advance(inputs, keep, active, state, None)
        used = np.arange(running)[None, :] < active[:, None]
        out += np.bincount(owner[used], weights=network.log_probabilities(states[used], targets[used]), minlength=len(texts))
    return out


# --- Spark jobs ----------------------------------------------------------------------


def pools(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[list, list[list[bytes]]]]:
    """(ids, token lists) of about ``size`` tokens."""
    ids, texts, held = [], [], 0
    for batch, raw in rows_of(batches):
        for doc_id, text in zip(batch.column(0).to_pylist(), raw, strict=True):
            own = tokens_of(text)
            if held and held + len(own) > size:
                yield ids, texts
                ids, texts, held = [], [], 0
            ids.append(doc_id)
            texts.append(own)
            held += len(own)
    if held:
        yield ids, texts


def _numbers(number: dict[bytes, int], unknown: int, texts: list[list[bytes]]) -> list[np.ndarray]:
    get = number.get
    return [np.fromiter(map(get, own, repeat(unknown)), dtype=np.int64, count=len(own)) for own in texts]


def learn_network(docs: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS) -> Network:
    """Rounds of local training in every task, each followed by averaging (module text)."""
    network = Network.initial(vocabulary)
    if not vocabulary.modelled:
        return network
    shapes = [w.shape for w in network.weights]
    sizes = np.cumsum([0] + [int(np.prod(s)) for s in shapes])
    modelled = {t: k for t, k in vocabulary.number.items() if k < vocabulary.modelled}
    context = docs.sparkSession.sparkContext
    draw = F.pmod(F.xxhash64(F.lit("round"), "doc_id", F.length("text")), F.lit(rounds))
    for number in range(rounds):
        shared = context.broadcast((network.modelled, network.weights, modelled))

        def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            size, weights, known = shared.value
            own = Network(size, [w.copy() for w in weights])
            squares = [np.zeros_like(w) for w in own.weights]
            learned = sum(learn(own, _numbers(known, size, texts), squares=squares) for _, texts in pools(batches, POOL))
            if learned:
                flat = np.concatenate([w.ravel() for w in own.weights]).astype(np.float64) * learned
                parts = [flat[k : k + BLOCK].tobytes() for k in range(0, len(flat), BLOCK)]
                yield pa.record_batch([pa.array(range(len(parts)), pa.int32()), pa.array([learned] * len(parts), pa.int64()), pa.array(parts, pa.binary())], names=["block", "learned", "part"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, tuple[int, np.ndarray]] = {}
            for batch in batches:
                for block, learned, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    before, own = sums.get(block, (0, np.float64(0.0)))
                    sums[block] = before + learned, own + np.frombuffer(part, dtype=np.float64)
            if sums:
                columns = [pa.array(sums.keys(), pa.int32()), pa.array([n for n, _ in sums.values()], pa.int64()), pa.array([a.tobytes() for _, a in sums.values()], pa.binary())]
                yield pa.record_batch(columns, names=["block", "learned", "part"])

        schema = "block int, learned long, part binary"
        trained = docs.filter(draw == number).mapInArrow(train, schema)
        # Each task holds one sum per block, whatever the number of rows that reach it.
        found = trained.repartition("block").mapInArrow(add, schema).collect()
        shared.unpersist()
        if found:
            flat = np.concatenate([np.frombuffer(r.part, dtype=np.float64) / r.learned for r in sorted(found)])
            network = Network(network.modelled, [flat[a:b].reshape(s).astype(np.float32) for a, b, s in zip(sizes, sizes[1:], shapes, strict=False)])
    return network


class Model:
    """Counts of all tokens (a table), the vocabulary and the network."""

    def __init__(self, counts: DataFrame, vocabulary: Vocabulary, network: Network) -> None:
        self.counts, self.vocabulary, self.network = counts, vocabulary, network


def train(docs: DataFrame, rounds: int = ROUNDS) -> Model:
    """Learn from the open rows of ``docs`` (doc_id, text)."""
    own = open_rows(docs)
    counts = stored(token_counts(own), "tokens")
    vocabulary = learn_vocabulary(counts)
    return Model(counts, vocabulary, learn_network(own, vocabulary, rounds))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score): base-10 logarithms, one row per row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.vocabulary, model.network.modelled, model.network.weights))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, modelled, weights = shared.value
        network = Network(modelled, weights)
        known, counted = vocabulary.number, len(vocabulary.counts)
        base, within = vocabulary.base(vocabulary.counts), vocabulary.within_rest(vocabulary.counts)
        within[:modelled] = 0.0
        base, within = np.append(base, 0.0), np.append(within, 0.0)
        for ids, texts in pools(batches, POOL):
            numbers = _numbers(known, counted, texts)
            if modelled:
                scores = log_likelihoods(network, [np.minimum(n, modelled) for n in numbers]) / np.log(10.0)
            else:
                scores = np.zeros(len(texts))
            rest_tokens, rest_times = [], []
            for own, n in zip(texts, numbers, strict=True):
                rest = Counter([own[k] for k in np.flatnonzero(n == counted).tolist()])
                rest_tokens.append(list(rest.keys()))
                rest_times.append(list(rest.values()))
            columns = [
                pa.array(ids, pa.int64()), pa.array([len(n) for n in numbers], pa.int64()), pa.array([int((n < counted).sum()) for n in numbers], pa.int64()),
                pa.array([float(base[n].sum()) for n in numbers], pa.float64()),
                pa.array([float(within[n].sum() + s) for n, s in zip(numbers, scores, strict=True)], pa.float64()),
                pa.array(rest_tokens, pa.list_(pa.binary())), pa.array(rest_times, pa.list_(pa.int64())),
            ]
            yield pa.record_batch(columns, names=["doc_id", "n_tokens", "n_known", "base_score", "score", "tokens", "times"])

    schema = "doc_id long, n_tokens long, n_known long, base_score double, score double, tokens array<binary>, times array<long>"
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(of, schema)
    found = stored(found.withColumn("row", F.monotonically_increasing_id()), "scored")
    vocabulary = model.vocabulary
    rest = found.select("row", F.explode(F.arrays_zip("tokens", "times")).alias("of")).select("row", F.col("of.tokens").alias("token"), F.col("of.times").alias("times"))
    n = F.coalesce("n", F.lit(0))
    parts = rest.join(model.counts, "token", "left").groupBy("row").agg(
        F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("rest_known"),
        F.sum(F.col("times") * F.log10((n + 1) / F.lit(float(vocabulary.total + vocabulary.distinct + 1)))).alias("rest_base"),
        F.sum(F.col("times") * F.log10((n + 1) / F.lit(float(vocabulary.rest_total + vocabulary.rest_distinct + 1)))).alias("rest_score"),
    )
    together = [F.col("n_known") + F.coalesce("rest_known", F.lit(0))] + [F.col(c) + F.coalesce(f"rest_{c.split('_')[0]}", F.lit(0.0)) for c in ("base_score", "score")]
    return found.join(parts, "row", "left").select("doc_id", "n_tokens", *[c.alias(a) for c, a in zip(together, ("n_known", "base_score", "score"), strict=True)])


def scored(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) by a model learned from the open rows."""
    model = train(docs)
    total = F.lit(model.vocabulary.total).cast("long").alias("train_tokens")
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", total, "base_score", "score")
