"""Language-model scoring with a weighted backoff automaton (operator 7).

Model: n-grams with Dirichlet smoothing towards the next shorter history, down to add-one unigrams,
    p(w) = (c(w) + 1) / (N + V + 1)        p(w | h) = (c(h w) + prior * p(w | h')) / (c(h) + prior)
over words and an end token; a start mark begins each text, and h' is h without its first word. Histories of
one word all count; longer ones only if training has them SEEN times or more, else h' stands for h. The
probabilities of all words after a history sum to one.

The automaton has a state for each history. A state has an arc, weighted log10 p(w | h), for each n-gram
seen in training, to the longest state that ends the text read so far, and a failure arc, weighted
log10(prior / (c(h) + prior)), to the state of h'. The root's arcs are the unigrams. One traversal from left
to right carries the state through a text and adds up the weights.

Texts are read and cut in words once, where they lie: a chunk of about CHUNK bytes becomes word numbers,
which stay with the chunk. All counts cover the whole corpus and stay distributed: a round of key buckets for
words and bigrams, and one for each longer order, sends a chunk's distinct n-grams with their training
counts and answers with their corpus totals; from these the chunk builds the part of the automaton that its
own texts can reach. Chunks are made in the order of the scan, so docs must come from files or another
source that gives the same rows in the same order again.

Null or empty text: only the end token. A null doc_id is in the training part. Repeated rows count each.
An empty table gives no rows. N-grams are compared by 64-bit keys.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from quern.llm.common import column_bytes, ids_of, mix, plan_bytes
from quern.llm.exchange import MESSAGE, STAYS, Route, address, answers, decide, messages, notes, pack_parts, totals, unpack_parts
from quern.llm.rolling import words_of

PRIOR = 300.0
SEEN = 16  # under the prior, fewer would count for less than a twentieth
FOLDS, HELD = 7, 2
CHUNK = 8 << 20

_START, _END = 0, 1  # numbers of the marks; their hashes are fixed values
_MARKS = [0x243F6A8885A308D3, 0x13198A2E03707344]
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Chunk:
    """Texts as word numbers: n tokens for each text, each text's tokens ending in _END."""

    def __init__(self, ids: np.ndarray, null: np.ndarray, n: np.ndarray, tokens: np.ndarray, hashes: np.ndarray, folds: int, held: int):
        self.parts = ids, null, n, tokens, hashes
        self.ids, self.null, self.n, self.hash = ids, null, n, hashes
        self.tokens = tokens.astype(np.int64)
        self.size = len(hashes)
        self.first = np.cumsum(n) - n
        self.held = np.array([not m and zlib.crc32(str(i).encode()) % folds == held for i, m in zip(ids.tolist(), null.tolist())], bool)
        self.train = np.repeat(~self.held, n)

    @classmethod
    def read(cls, ids: np.ndarray, null: np.ndarray, texts: list[bytes], folds: int, held: int) -> Chunk:
        words, n = words_of(texts, lower=True)
        known, number, count = np.unique(words, return_inverse=True, return_counts=True)
        often = np.argsort(-count, kind="stable")  # frequent words get small numbers, which take less room
        ends = np.cumsum(n)
        tokens = np.insert(unsorted(np.arange(len(known)), often)[number] + 2, ends, _END) if len(texts) else number
        return cls(ids, null, n + 1, tokens.astype(np.uint32), np.concatenate([np.array(_MARKS, np.uint64), known[often]]), folds, held)

    def bigrams(self) -> Grams:
        before = np.empty_like(self.tokens)
        before[1:] = self.tokens[:-1]
        before[self.first] = _START
        return self._grams(2, np.arange(len(self.tokens)), before, self.hash, self.tokens)

    def longer(self, shorter: Grams, total: np.ndarray, seen: int) -> Grams:
        """N-grams of one word more, whose history (an n-gram of `shorter`) is a state."""
        before = np.full(len(self.tokens), -1)
        before[1:] = shorter.arc[:-1]
        before[self.first] = -1
        at = np.flatnonzero(before >= 0)
        at = at[total[before[at]] >= seen]
        return self._grams(shorter.order + 1, at, before[at], shorter.keys, shorter.arc)

    def _grams(self, order: int, at: np.ndarray, history: np.ndarray, keys: np.ndarray, below: np.ndarray) -> Grams:
        """The n-grams that end at these places, with their histories and the n-grams of the order below at all places."""
        ids, own = np.unique(history * self.size + self.tokens[at], return_inverse=True)
        arc, first = np.full(len(self.tokens), -1), np.empty(len(ids), np.int64)
        arc[at], first[own] = own, np.arange(len(at))
        history, word = ids // self.size, ids % self.size
        counts = np.bincount(own[self.train[at]], minlength=len(ids))
        return Grams(order, history, word, below[at[first]], arc, mix(keys[history] * _STEP + self.hash[word]), counts)

    def words(self) -> np.ndarray:
        """Training counts of the words; the start mark counts texts."""
        counts = np.bincount(self.tokens[self.train], minlength=self.size)
        counts[_START] = (~self.held).sum()
        return counts

    def first_round(self) -> tuple[Grams, np.ndarray, np.ndarray, np.ndarray]:
        """Bigrams, and the keys of words and bigrams with their training counts, and the order in which they are sent."""
        two = self.bigrams()
        keys = np.concatenate([mix(self.hash) | np.uint64(1), two.keys & ~np.uint64(1)])  # the lowest bit tells words
        return two, keys, np.concatenate([self.words(), two.counts]), np.argsort(keys, kind="stable")

    def levels(self, totals_: list[np.ndarray], seen: int) -> tuple[np.ndarray, list[tuple[Grams, np.ndarray]]]:
        """The words' corpus totals, and the n-grams of each order with theirs, from the answers of the rounds so far."""
        two, _, _, order = self.first_round()
        sums = unsorted(totals_[0], order)
        found = [(two, sums[self.size :])]
        for sums_ in totals_[1:]:
            grams = self.longer(*found[-1], seen)
            found.append((grams, unsorted(sums_, np.argsort(grams.keys, kind="stable"))))
        return sums[: self.size], found


@dataclass
class Grams:
    """A chunk's distinct n-grams of one order: history and suffix (numbers in the order below), last word, key, count
    in the chunk's training texts; arc: the n-gram that ends at each token, or -1."""

    order: int
    history: np.ndarray
    word: np.ndarray
    suffix: np.ndarray
    arc: np.ndarray
    keys: np.ndarray
    counts: np.ndarray


def unsorted(x: np.ndarray, order: np.ndarray) -> np.ndarray:
    out = np.empty_like(x)
    out[order] = x
    return out


class Automaton:
    """A chunk's part of the automaton.

    States: 0 the root, 1 + w the history of one word w, then the longer ones; depth, failure and penalty (the failure
    arc's weight) by state. Arcs: source, word, weight and target. For each text place and each depth of the state there,
    steps() gives the weights of its arc for the word at that place (not a number: no such arc) and of its failure arc.
    """

    def __init__(self, size: int, c1: np.ndarray, levels: list[tuple[Grams, np.ndarray]], n: int, v: int, prior: float, seen: int):
        words = np.arange(size)
        self.root = np.log10((c1 + 1) / (n + v + 1))
        source, word, weight, target = [np.zeros(size, np.int64)], [words], [self.root], [1 + words]
        failure, penalty, depth = [np.zeros(size + 1, np.int64)], [np.zeros(1), np.log10(prior / (c1 + prior))], [np.zeros(1, np.int64), np.ones(size, np.int64)]
        p, count, state, longest, used = 10**self.root, c1, 1 + words, 1 + words, size + 1  # of the order below
        self.levels = []
        for grams, total in levels:
            p = (total + prior * p[grams.suffix]) / (count[grams.history] + prior)
            start, back = state[grams.history], longest[grams.suffix]
            new = (total >= seen) & (grams.word != _END) & (grams.order <= len(levels))  # a history of the next order
            state = np.where(new, used + np.cumsum(new) - 1, -1)
            used += int(new.sum())
            failure.append(back[new])
            penalty.append(np.log10(prior / (total[new] + prior)))
            depth.append(np.full(len(failure[-1]), grams.order))
            longest, count, known = np.where(new, state, back), total, total > 0
            own = np.log10(p)
            for kept, x in zip((source, word, weight, target), (start, grams.word, own, longest)):
                kept.append(x[known])
            self.levels.append((grams.arc, np.where(known, own, np.nan), start, longest))
        self.source, self.word, self.weight, self.target = map(np.concatenate, (source, word, weight, target))
        self.failure, self.penalty, self.depth = map(np.concatenate, (failure, penalty, depth))

    def steps(self, tokens: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """By depth and place: arc weights and failure weights; by place: the depth of the longest state that ends there."""
        weights, failures = [self.root[tokens]], [np.zeros(len(tokens))]
        after = np.ones(len(tokens), np.int64)
        for arc, weight, start, longest in self.levels:
            here = arc >= 0
            for found, x in ((weights, weight), (failures, self.penalty[start])):
                found.append(np.where(here, x[arc] if len(x) else np.nan, np.nan))
            if len(longest):
                after[here] = np.maximum(after[here], self.depth[longest[arc[here]]])
        return weights, failures, after


def traverse(weights: list[list[float]], failures: list[list[float]], after: list[int]) -> float:
    """The log10 probability of a text, read from left to right; the state is that of the last `depth` words."""
    depth, total = 1, 0.0
    for i, reached in enumerate(after):
        weight = weights[depth][i]
        while weight != weight:  # no arc for this word: over the failure arc to the next shorter history
            total += failures[depth][i]
            depth -= 1
            weight = weights[depth][i]
        total += weight
        depth = reached
    return total


def score_documents(docs: DataFrame, prior: float = PRIOR, folds: int = FOLDS, held: int = HELD, order: int = 2, seen: int = SEEN) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each document."""
    route = Route.of(plan_bytes(docs))

    def read(batches):
        part, number = TaskContext.get().partitionId(), 0
        ids, null, texts, size = [], [], [], 0

        def sent():
            chunk = Chunk.read(np.concatenate(ids), np.concatenate(null), texts, folds, held)
            _, keys, counts, order_ = chunk.first_round()
            return messages(number << 24 | part, route, keys[order_], counts[order_].astype(np.uint32), pack_parts(*chunk.parts), stays=True, every=True).to_batches()

        for batch in batches:
            all_texts, start = column_bytes(batch["text"]), 0
            all_ids, all_null = ids_of(batch["doc_id"]), np.asarray(batch["doc_id"].is_null())
            while start < len(all_texts):
                stop = start
                while stop < len(all_texts) and size < CHUNK:
                    size += len(all_texts[stop])
                    stop += 1
                ids.append(all_ids[start:stop])
                null.append(all_null[start:stop])
                texts += all_texts[start:stop]
                start = stop
                if size >= CHUNK:
                    yield from sent()
                    number += 1
                    ids, null, texts, size = [], [], [], 0
        if texts:
            yield from sent()

    def extend(own: pa.Table, got: pa.Table) -> pa.Table:
        if not len(got):  # messages to a bucket
            return own.slice(0, 0)
        chunk, marks, sums = _state(own, got, folds, held)
        _, levels = chunk.levels(sums, seen)
        grams = chunk.longer(*levels[-1], seen)
        order_ = np.argsort(grams.keys, kind="stable")
        state = pack_parts(marks, *(x.astype(np.uint32) if x.max(initial=0) < 2**32 else x for x in sums))
        return messages(address(own["node"][0].as_py()), route, grams.keys[order_], grams.counts[order_].astype(np.uint32), state)

    def score(own: pa.Table, got: pa.Table) -> pa.Table:
        if not len(got):
            return pa.table([pa.array([], t) for t in _KINDS], names=_NAMES)
        chunk, (v, train), sums = _state(own, got, folds, held)
        c1, levels = chunk.levels(sums, seen)
        automaton = Automaton(chunk.size, c1, levels, int(train), int(v), prior, seen)
        weights, failures, after = automaton.steps(chunk.tokens)
        scores = []
        for a, n in zip(chunk.first.tolist(), chunk.n.tolist()):
            scores.append(traverse([x[a : a + n].tolist() for x in weights], [x[a : a + n].tolist() for x in failures], after[a : a + n].tolist()))
        add = lambda x: np.add.reduceat(x, chunk.first)
        found = [pa.array(chunk.ids, mask=chunk.null), pa.array(chunk.held), chunk.n, add((c1[chunk.tokens] > 0).astype(np.int64)), np.full(len(chunk.n), train), add(automaton.root[chunk.tokens]), scores]
        return pa.table([x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(found, _KINDS)], names=_NAMES)

    sent = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(read, MESSAGE)
    found = decide(route, sent, "u4", totals, _vocabulary)
    for _ in range(2, order):
        found = decide(route, sent.groupBy("node").cogroup(found.groupBy("node")).applyInArrow(extend, MESSAGE), "u4", totals)
    return sent.groupBy("node").cogroup(found.groupBy("node")).applyInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


_NAMES = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
_KINDS = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]


def _state(own: pa.Table, got: pa.Table, folds: int, held: int) -> tuple[Chunk, np.ndarray, list[np.ndarray]]:
    """The chunk, (V, N), and the answers of all rounds so far."""
    (stayed,) = (a for s, a in zip(own["sender"].to_pylist(), own["aux"].to_pylist()) if s == STAYS)
    newest, state = answers(got, "i8")
    before = unpack_parts(state) if state else [notes(got)]
    return Chunk(*unpack_parts(stayed), folds, held), before[0], [*(x.astype(np.int64) for x in before[1:]), newest]


def _vocabulary(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A bucket's distinct training words, and their tokens; the start mark is no token."""
    start = mix(np.array(_MARKS[:1], np.uint64)) | np.uint64(1)
    word = ((keys & np.uint64(1)) == 1) & (keys != start[0]) & (counts > 0)
    return np.array([len(np.unique(keys[word])), counts[word].astype(np.int64).sum()], np.int64)
