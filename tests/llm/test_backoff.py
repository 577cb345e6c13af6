"""The backoff automaton of operator 7 with orders above two, against brute force."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from quern.llm import exchange, lm

SEEN = 4
SCHEMA = "doc_id long, text string, size int, score double"


def rows():
    rng = np.random.default_rng(12)
    text = lambda n: " ".join(f"W{x}" for x in np.minimum(rng.geometric(0.25, n), 9))
    found = [(i, text(int(rng.integers(0, 60))), 0, 0.0) for i in range(120)]
    found += [(200, None, None, None), (201, "", 0, 0.0), (None, "w1 w2 w1 w2", 0, 0.0), (202, "never seen words", 0, 0.0), (203, text(3000), 0, 0.0), found[5], found[5]]
    return found


class Brute:
    def __init__(self, texts, train, order, seen):
        self.order, self.seen, self.count = order, seen, Counter()
        words = [w for t, on in zip(texts, train) if on for w in t]
        self.one, self.n = Counter(words), len(words)
        for t, on in zip(texts, train):
            marked = ["^", *t]
            for k in range(1, order + 1):
                self.count.update(tuple(marked[i : i + k]) for i in range(len(marked) - k + 1) if on)

    def p(self, word, history):
        if not history:
            return (self.one[word] + 1) / (self.n + len(self.one) + 1)
        if len(history) > 1 and self.count[history] < self.seen:
            return self.p(word, history[1:])
        return (self.count[*history, word] + lm.PRIOR * self.p(word, history[1:])) / (self.count[history] + lm.PRIOR)

    def score(self, text):
        marked = ["^", *text]
        return sum(math.log10(self.p(w, tuple(marked[max(0, i + 1 - self.order + 1) : i + 1]))) for i, w in enumerate(text))


def tokens(row):
    return [*(row[1] or "").lower().split(), "$end"]


@pytest.mark.parametrize("order,fan", [(3, 512), (4, 512), (3, 2), (1 + 1, 2)])
def test_scores_equal_brute_force(spark, monkeypatch, order, fan):
    monkeypatch.setattr(exchange, "FAN", fan)
    monkeypatch.setattr(exchange, "BUCKET_BYTES", 2000)
    data = rows()
    held = [r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 2 for r in data]
    brute = Brute([tokens(r) for r in data], [not h for h in held], order, SEEN)
    want = [(r[0], h, len(tokens(r)), brute.n, round(brute.score(tokens(r)), 6)) for r, h in zip(data, held)]
    out = lm.score_documents(spark.createDataFrame(data, SCHEMA).repartition(3), order=order, seen=SEEN)
    got = [(r.doc_id, r.held_out, r.n_tokens, r.train_tokens, round(r.score, 6)) for r in out.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def chunk_of(data):
    ids = np.array([-1 if r[0] is None else r[0] for r in data])
    null = np.array([r[0] is None for r in data])
    return lm.Chunk.read(ids, null, [(r[1] or "").encode() for r in data], 7, 2)


@pytest.mark.parametrize("order", [2, 3, 4])
def test_each_history_sums_to_one(order):
    chunk = chunk_of(rows())
    levels = [(chunk.bigrams(), None)]
    levels[0] = (levels[0][0], levels[0][0].counts)
    for _ in range(2, order):
        grams = chunk.longer(*levels[-1], SEEN)
        levels.append((grams, grams.counts))
    c1 = chunk.words()
    n, v = int(c1[1:].sum()), int((c1[1:] > 0).sum())
    automaton = lm.Automaton(chunk.size, c1, levels, n, v, lm.PRIOR, SEEN)
    unseen = int((c1[1:] == 0).sum())
    assert len(automaton.failure) == len(automaton.penalty) > (1 + chunk.size if order > 2 else chunk.size)

    arcs = dict(zip(zip(automaton.source.tolist(), automaton.word.tolist()), automaton.weight.tolist()))

    def total(state):
        out = 0.0
        for w in range(1, chunk.size):
            s, log = state, 0.0
            while (s, w) not in arcs:
                log += automaton.penalty[s]
                s = automaton.failure[s]
            out += 10 ** (log + arcs[s, w])
        # words without training counts share the mass of one more word
        return out, out - (unseen - 1) * lowest(state)

    def lowest(state):
        log = 0.0
        while state:
            log += automaton.penalty[state]
            state = automaton.failure[state]
        return 10 ** (log - math.log10(n + v + 1))

    for state in set(range(len(automaton.failure))) - {1 + lm._END}:  # no text goes on after its end
        assert math.isclose(total(state)[1], 1.0, rel_tol=1e-9), state


def test_longer_histories_help_on_held_out_text(spark):
    rng = np.random.default_rng(4)
    cycle = [f"c{i}" for i in range(30)]
    data = [(i, " ".join(cycle[k % 30] if rng.random() < 0.9 else "x" for k in range(int(rng.integers(0, 30)), 200)), 0, 0.0) for i in range(300)]
    frame = spark.createDataFrame(data, SCHEMA)
    mean = [lm.score_documents(frame, prior=5.0, order=k).filter("held_out").agg({"score": "avg"}).first()[0] for k in (2, 3)]
    base = lm.score_documents(frame).filter("held_out").agg({"base_score": "avg"}).first()[0]
    assert base < mean[0] < mean[1]


def test_targets_are_the_longest_states(spark):
    """Walking state by state over the arcs gives what traverse() finds by depth."""
    chunk = chunk_of(rows())
    levels = [(chunk.bigrams(), None)]
    levels[0] = (levels[0][0], levels[0][0].counts)
    grams = chunk.longer(*levels[-1], SEEN)
    levels.append((grams, grams.counts))
    automaton = lm.Automaton(chunk.size, chunk.words(), levels, 1000, 10, lm.PRIOR, SEEN)
    arcs = {(a, b): (c, d) for a, b, c, d in zip(automaton.source.tolist(), automaton.word.tolist(), automaton.weight.tolist(), automaton.target.tolist())}
    weights, failures, after = automaton.steps(chunk.tokens)
    for a, n in zip(chunk.first.tolist(), chunk.n.tolist()):
        state, total = 1 + lm._START, 0.0
        for k, word in enumerate(chunk.tokens[a : a + n].tolist()):
            while (state, word) not in arcs:
                total += automaton.penalty[state]
                state = automaton.failure[state]
            weight, state = arcs[state, word]
            total += weight
            assert automaton.depth[state] == after[a + k]
        cut = lambda x: x[a : a + n].tolist()
        assert math.isclose(total, lm.traverse([cut(x) for x in weights], [cut(x) for x in failures], cut(after)), rel_tol=1e-12)
