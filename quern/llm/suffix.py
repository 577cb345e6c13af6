"""Exact substring dedup over bytes, by rounds over growing prefixes at synchronised places (operator 9).

Prefix doubling ranks every position by its first bytes, pairs ranks at growing offsets and drops a
position as soon as its rank is unique or its prefix passes the threshold. Here the rounds grow prefixes and drop
places in the same way, but hashes of byte ranges stand for ranks, and only synchronised places take part, since a
rank for every byte would take many times the input on disk:

0. Anchors: in each 400-byte string, the place of the least 32-byte hash among its first 192 places. Equal
   strings have equal anchors, so comparing anchors is enough.
1. Compare the 209 bytes from the anchor on, which every string of this anchor holds. Unique: dropped.
2. Compare pairs (337 bytes that all strings of one 64-byte block of starts hold, the bytes of all those
   strings together). First unique: dropped. Second repeated: all these strings repeat. Else, the edge of
   a repeat: every block with that first hash goes on.
3. Compare the single 400-byte strings of what goes on: those that occur twice repeat.

Equal 64-bit hashes stand for equal bytes. Buckets sort them; each shard sends a hash once, with its number of
places. Null or empty text: no bytes. Strings never cross documents. Repeated rows are documents of their own, so
their strings occur elsewhere, null ids too. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quern.llm.common import mix
from quern.llm.exchange import Batch, Shards, answers, messages, pack_state, runs, totals, unpack_state
from quern.llm.rolling import Hashes

LENGTH = 400
_GRAM, _SPAN, _BLOCK, _CHUNK = 32, 192, 64, 1 << 20
_PAIR = [("key", "<u8"), ("n", "<u4")]


def _least(x: np.ndarray, n: int) -> np.ndarray:
    """Minima of all runs of n values, by prefixes and suffixes of blocks."""
    m = len(x) - n + 1
    padded = np.full(-(-len(x) // n) * n, np.uint64(2**64 - 1))
    padded[: len(x)] = x
    blocks = padded.reshape(-1, n)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[:m], ahead[n - 1 : n - 1 + m])


class _Bytes:
    """A shard's documents end to end."""

    def __init__(self, batch: Batch):
        sizes = np.array([len(t) for t in batch.texts], np.int64)
        self.stop = np.cumsum(sizes)
        self.begin = self.stop - sizes
        self.data = np.frombuffer(b"".join(batch.texts), np.uint8)

    def chunks(self, at: np.ndarray):
        """(hashes, slice of at) for chunks of sorted places; hashes reach far enough behind each place."""
        cuts = np.searchsorted(at, np.arange(0, len(self.data) + _CHUNK, _CHUNK))
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            if b > a:
                yield Hashes(self.data, k * _CHUNK, min(len(self.data), (k + 1) * _CHUNK + LENGTH + 2 * _SPAN)), slice(a, b)

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For runs of string starts lo..hi with one anchor: lo, hi, anchor, and the key of the bytes from the anchor on."""
        out = []
        low = np.uint64((1 << 28) - 1)
        for a in range(0, len(self.data), _CHUNK):
            hashes = Hashes(self.data, a, min(len(self.data), a + _CHUNK + LENGTH))
            n = len(hashes.sums) - 1
            if n < LENGTH:
                continue
            places = np.arange(a, a + n - _GRAM + 1)
            gram = (hashes.of(places, places + _GRAM) & ~low) | (places - a).astype(np.uint64)
            first = (_least(gram, _SPAN)[: min(_CHUNK, n - LENGTH + 1)] & low).astype(np.int64)
            lo = runs(first)
            anchor = first[lo] + a
            hi = np.concatenate([lo[1:], [len(first)]]) - 1 + a
            lo = lo + a
            doc = np.searchsorted(self.stop, anchor, side="right")
            lo, hi = np.maximum(lo, self.begin[doc]), np.minimum(hi, self.stop[doc] - LENGTH)
            good = lo <= hi
            lo, hi, anchor = lo[good], hi[good], anchor[good]
            out.append((lo, hi, anchor, hashes.of(anchor, anchor + LENGTH - _SPAN + 1)))
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (*(np.zeros(0, np.int64) for _ in range(3)), np.zeros(0, np.uint64))

    def blocks(self, lo: np.ndarray, hi: np.ndarray, anchor: np.ndarray) -> tuple[np.ndarray, ...]:
        """Each run cut into blocks of starts by their distance from the anchor: starts s..e, and both keys."""
        far, near = (anchor - lo) // _BLOCK, (anchor - hi) // _BLOCK
        n = far - near + 1
        own = np.repeat(np.arange(len(lo)), n)
        block = far[own] - (np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n))
        end = anchor[own] - block * _BLOCK
        s, e = np.maximum(lo[own], end - _BLOCK + 1), np.minimum(hi[own], end)
        first, second = np.zeros(len(s), np.uint64), np.zeros(len(s), np.uint64)
        for hashes, k in self.chunks(s):
            first[k] = mix(hashes.of(end[k], end[k] - _BLOCK + 1 + LENGTH) + block[k].astype(np.uint64))
            second[k] = mix(hashes.of(s[k], e[k] + LENGTH) + (end[k] - e[k]).astype(np.uint64))
        return s, e, first, second

    def strings(self, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All starts of the ranges s..e, and the keys of their strings."""
        n = e - s + 1
        at = np.repeat(s, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        keys = np.zeros(len(at), np.uint64)
        for hashes, k in self.chunks(at):
            keys[k] = hashes.of(at[k], at[k] + LENGTH)
        return at, keys


def dedup_bytes(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (removed byte ranges) and kept (the bytes left)."""
    shards = Shards(docs)
    route = shards.route

    def anchors(group: pa.Table) -> pa.Table:
        batch = Batch(group)
        lo, hi, anchor, key = _Bytes(batch).anchors()
        keys, counts = np.unique(key, return_counts=True)
        return messages(batch.shard, route, keys, counts.astype(np.uint32), pack_state(lo, hi, anchor, key.view(np.int64)))

    def blocks(group: pa.Table, got: pa.Table) -> pa.Table:
        batch = Batch(group)
        repeats, state = answers(got, "u1")
        lo, hi, anchor, key = unpack_state(state)
        on = repeats[np.unique(key.view(np.uint64), return_inverse=True)[1]].astype(bool)
        lo, hi, anchor = lo[on], hi[on], anchor[on]
        _, _, first, second = _Bytes(batch).blocks(lo, hi, anchor)
        start, _, n_same = _pairs(first, second)
        out = np.empty(len(start), _PAIR)
        out["key"], out["n"] = second[start], n_same
        return messages(batch.shard, route, first[start], out, pack_state(lo, hi, anchor))

    def strings(group: pa.Table, got: pa.Table) -> pa.Table:
        batch = Batch(group)
        verdict, state = answers(got, "u1")
        text = _Bytes(batch)
        s, e, first, second = text.blocks(*unpack_state(state))
        verdict = verdict[_pairs(first, second)[1]] if len(s) else np.zeros(0, np.uint8)
        sure, on = (verdict == 1) | (verdict == 2), verdict >= 2
        _, keys = text.strings(s[on], e[on])
        keys, counts = np.unique(keys, return_counts=True)
        return messages(batch.shard, route, keys, counts.astype(np.uint32), pack_state(s[sure], e[sure], s[on], e[on]))

    def removed(group: pa.Table, got: pa.Table) -> pa.Table:
        batch = Batch(group)
        repeats, state = answers(got, "u1")
        text = _Bytes(batch)
        edge = np.zeros(len(text.data) + 1, np.int32)
        if state:
            s, e, s2, e2 = unpack_state(state)
            at, keys = text.strings(s2, e2)
            at = at[repeats[np.unique(keys, return_inverse=True)[1]].astype(bool)] if len(at) else at
            for a, b in ((s, e), (at, at)):
                np.add.at(edge, a, 1)
                np.add.at(edge, b + LENGTH, -1)
        gone = np.cumsum(edge[:-1], dtype=np.int32) > 0
        columns: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept")}
        for whole, a, b in zip(batch.texts, text.begin, text.stop):
            cut = gone[a:b]
            count = int(np.count_nonzero(cut))
            step = np.flatnonzero(np.diff(np.concatenate([[0], cut.view(np.int8), [0]]))).reshape(-1, 2).tolist() if count else []
            kept = text.data[a:b][~cut].tobytes() if count else whole
            for k, v in (("n_bytes", int(b - a)), ("n_removed", count), ("n_spans", len(step)), ("kept_sha256", hashlib.sha256(kept).hexdigest()), ("spans", [{"start": i, "stop": j} for i, j in step]), ("kept", kept)):
                columns[k].append(v)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), pa.binary())
        return pa.table({"doc_id": batch.rows["doc_id"].combine_chunks()} | {k: pa.array(v, t) for (k, v), t in zip(columns.items(), kinds)})

    found = shards.decide(shards.first(anchors), "u4", _twice)
    found = shards.decide(shards.again(found, blocks), _PAIR, _verdict)
    found = shards.decide(shards.again(found, strings), "u4", _twice)
    return shards.again(found, removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,stop:long>>, kept binary")


def _pairs(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in order: the place of one of each, the pair's number for each place, and counts."""
    order = np.lexsort((second, first))
    a, b = first[order], second[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, bool)
    number = np.empty(len(a), np.int64)
    number[order] = np.cumsum(new) - 1
    starts = np.flatnonzero(new)
    return order[starts], number, np.diff([*starts, len(a)]).astype(np.uint32)


def _twice(keys: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (totals(keys, places) >= 2).astype(np.uint8)


def _verdict(keys: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """0: the first hash is unique; 1: the second repeats, as it does for all of this first hash; 2: it repeats, for some not; 3: it is unique."""
    start, number, _ = _pairs(keys, pairs["key"])
    same = np.bincount(number, weights=pairs["n"], minlength=len(start))[number]
    group = totals(keys, pairs["n"])
    edge = totals(keys, same == 1) > 0
    return np.where(group < 2, 0, np.where(same >= 2, np.where(edge, 2, 1), 3)).astype(np.uint8)
