"""Substring dedup with repeated-phrase automata (operator 5).

1. Each shard picks, in every window of WINDOW words, the phrase of SEED words with the least hash; two
   equal windows pick the same phrase, so only phrases found in two documents can lie in a repeated
   window. A round of key buckets tells each shard which of its phrases recur.
2. Windows around such a phrase are candidates. A second round tells each shard which of its distinct
   candidates a smaller document holds: with those that recur within the shard, these are the passages
   confirmed to recur. Of each, only one place and the smallest document are remembered.
3. Each shard compiles the phrases of its confirmed passages into Aho-Corasick automata of at most PATTERNS
   phrases and streams all its documents through each. Each hit is extended to the windows around it, which are
   compared with the confirmed ones: these occurrences, and no others, are removed where a smaller document than
   their own holds the passage.

Automata are cut by document shard and by number of phrases, so their memory is bounded, however large the
corpus. They read a letter for each word, eight bits of its hash, so a step is a word, not a byte. Words and
windows are compared by 64-bit keys. Null or empty text: no words. A null doc_id counts as the largest.
Rows with one doc_id are judged alike: none is smaller than the others. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import itertools

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import window_hash
from quern.llm.exchange import Batch, Shards, answers, messages, minima, pack, runs, totals, unpack
from quern.llm.rolling import words_of

WINDOW = 13
SEED = 5
PATTERNS = 1 << 16


class _Words:
    """The words of a shard as hashes, one document after another."""

    def __init__(self, batch: Batch):
        self.hashes, self.counts = words_of(batch.texts)
        self.starts = np.concatenate([[0], np.cumsum(self.counts)])
        self.doc = np.repeat(np.arange(len(batch.texts)), self.counts)
        self.left = self.starts[1:][self.doc] - np.arange(len(self.hashes))  # words from here to the end

    def picks(self, at: np.ndarray, window: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """The place of each window's phrase, and the keys of phrases by place."""
        keys = window_hash(self.hashes, seed)
        span = window - seed + 1
        low = np.uint64((1 << span.bit_length()) - 1)
        best = np.full(len(at), ~np.uint64(0))
        for j in range(span):
            np.minimum(best, (keys[at + j] & ~low) | np.uint64(j), out=best)
        return at + (best & low).astype(np.int64), keys

    def windows(self, window: int) -> np.ndarray:
        return np.flatnonzero(self.left >= window)

    def letters(self) -> str:
        return (self.hashes >> np.uint64(56)).astype(np.uint8).tobytes().decode("latin-1")


def automata(phrases: list[str]):
    """Compiles the phrases, sorted; the result maps a text to the ends of all their occurrences."""
    built = []
    for first in range(0, len(phrases), PATTERNS):
        one = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for phrase in phrases[first : first + PATTERNS]:
            one.add_word(phrase)
        one.make_automaton()
        built.append(one)
    return lambda text: np.fromiter((end for one in built for end, _ in one.iter(text)), np.int64)


def occurrences(words: _Words, places: np.ndarray, window: int, seed: int, build=automata) -> tuple[np.ndarray, np.ndarray]:
    """(place, index in places) of each occurrence, in any document, of the distinct windows at these places."""
    text = words.letters()
    phrase, _ = words.picks(places, window, seed)
    hits = build(sorted({text[p : p + seed] for p in np.unique(phrase).tolist()}))(text) - seed + 1
    near = np.zeros(len(text) + window, bool)
    for j in range(window - seed + 1):
        near[np.maximum(hits - j, 0)] = True
    at = np.flatnonzero(near[: len(text)] & (words.left >= window))
    keys = window_hash(words.hashes, window)
    order = np.argsort(keys[places])
    known = keys[places][order]
    found = np.minimum(np.searchsorted(known, keys[at]), max(0, len(known) - 1))
    same = known[found] == keys[at] if len(known) else np.zeros(0, bool)
    return at[same], order[found[same]]


def dedup_substrings(docs: DataFrame, carry: tuple[str, ...] = (), window: int = WINDOW, seed: int = SEED, build=automata) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, spans (removed word ranges), text after removal, and carried columns.

    text is unchanged where nothing is removed, else the kept words joined by one space. A carried column takes
    the place of a result of the same name.
    """
    shards = Shards(docs, carry)
    route = shards.route

    def phrases(group: pa.Table) -> pa.Table:
        batch = Batch(group)
        words = _Words(batch)
        place, keys = words.picks(words.windows(window), window, seed)
        place = place[runs(place)]
        keys, ids = keys[place], batch.ids[words.doc[place]]
        order = np.lexsort((ids, keys))
        keys, ids = keys[order], ids[order]
        starts = runs(keys)
        ends = np.concatenate([starts[1:], [len(keys)]]).astype(np.int64)
        several = (ids[starts] != ids[ends - 1]) if len(starts) else np.zeros(0, bool)
        return messages(batch.shard, route, keys[starts], (1 + several).astype(np.uint8))

    def passages(group: pa.Table, got: pa.Table) -> pa.Table:
        batch = Batch(group)
        words = _Words(batch)
        at = words.windows(window)
        place, keys = words.picks(at, window, seed)
        recurs, _ = answers(got, "u1")
        first = runs(place)
        found = np.zeros(len(words.hashes), bool)
        found[place[first]] = recurs[np.unique(keys[place[first]], return_inverse=True)[1]].astype(bool)
        at = at[found[place]]
        keys = window_hash(words.hashes, window)[at]
        ids = batch.ids[words.doc[at]]
        order = np.lexsort((ids, keys))
        starts = runs(keys[order])
        ends = np.concatenate([starts[1:], [len(order)]]).astype(np.int64)
        least = order[starts]
        several = (ids[least] != ids[order[ends - 1]]) if len(starts) else np.zeros(0, bool)
        state = pack(np.concatenate([at[least].astype("<i4").view(np.uint8), several.view(np.uint8)]))
        return messages(batch.shard, route, keys[least], ids[least], state)

    def removed(group: pa.Table, got: pa.Table) -> pa.Table:
        batch = Batch(group)
        words = _Words(batch)
        elsewhere, state = answers(got, "u1")
        gone = np.zeros(len(words.hashes), bool)
        if len(elsewhere):
            places, several = _places(state, len(elsewhere))
            known = elsewhere.astype(bool)
            confirmed = known | several
            places, known = places[confirmed].astype(np.int64), known[confirmed]
            least = batch.ids[words.doc[places]]
            where, which = occurrences(words, places, window, seed, build)
            where = where[known[which] | (batch.ids[words.doc[where]] > least[which])]
            edge = np.zeros(len(words.hashes) + window + 1, np.int32)
            np.add.at(edge, where, 1)
            np.add.at(edge, where + window, -1)
            gone = np.cumsum(edge)[: len(words.hashes)] > 0
        n_removed, digests, spans, texts = [], [], [], []
        for k, whole in enumerate(batch.texts):
            cut = gone[words.starts[k] : words.starts[k + 1]]
            own = whole.split()
            if cut.any():
                step = np.flatnonzero(np.diff(np.concatenate([[0], cut.astype(np.int8), [0]]))).reshape(-1, 2).tolist()
                spans.append([{"start": s, "stop": e} for s, e in step])
                kept = b" ".join(itertools.compress(own, (~cut).tolist()))
                texts.append(kept)
            else:
                spans.append([])
                kept = b" ".join(own)
                texts.append(None)
            n_removed.append(int(np.count_nonzero(cut)))
            digests.append(hashlib.sha256(kept).hexdigest())
        rows = batch.rows
        text = [old if new is None else new.decode() for new, old in zip(texts, rows["text"].to_pylist())]
        return pa.table(
            [rows["doc_id"].combine_chunks(), pa.array(words.counts, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string()), pa.array(spans, _SPANS), pa.array(text, pa.string()), *(rows[f"__c{i}"].combine_chunks() for i in range(len(carry)))],
            names=["doc_id", "n_words", "n_removed", "kept_sha256", "spans", "text", *(f"__c{i}" for i in range(len(carry)))],
        )

    kinds = dict(shards.docs.dtypes)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:long,stop:long>>, text string"
    schema += "".join(f", __c{i} {kinds[f'__c{i}']}" for i in range(len(carry)))
    recurring = shards.decide(shards.first(phrases), "u1", _recurs)
    smaller = shards.decide(shards.again(recurring, passages), "i8", _elsewhere)
    out = shards.again(smaller, removed, schema)
    taken = {c.lower() for c in carry}
    own = [c for c in ("doc_id", "n_words", "n_removed", "kept_sha256", "spans", "text") if c not in taken]
    return out.select(*own, *(F.col(f"__c{i}").alias(c) for i, c in enumerate(carry)))


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def _places(state: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in the order of the windows' keys, and whether several documents of the shard hold the window."""
    flat = unpack(state)
    return np.frombuffer(flat, "<i4", n), np.frombuffer(flat, "?", n, 4 * n)


def _recurs(keys: np.ndarray, documents: np.ndarray) -> np.ndarray:
    return (totals(keys, documents) >= 2).astype(np.uint8)


def _elsewhere(keys: np.ndarray, first: np.ndarray) -> np.ndarray:
    return (minima(keys, first) < first).astype(np.uint8)
