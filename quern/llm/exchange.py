"""Rounds between document shards and key buckets.

Operators that ask "where else does this key occur?" cut the documents into shards of about SHARD_BYTES
of input. A round sends each shard's distinct keys, packed as binary arrays, to buckets cut by the keys'
top bits; a bucket decides on all its keys with sorted numpy arrays and sends each shard one answer for
each of its keys, in the order sent. Keys are distinct within a shard before they are shuffled, so a key
that a third of all documents hold is one entry of each shard, never a group of rows.

A shard sends at most FAN messages, whatever the number of buckets. Where there are more buckets, messages
take several hops: a relay takes one range of keys from FAN neighbouring shards (or relays), merges them,
and passes them on to at most FAN narrower ranges, as in a radix sort; answers go back the same way. There are
as many relays in a hop as shards, each with as many keys, so a round of h hops makes at most 2 * h * FAN rows
for a shard: rows grow with the input, not with its square, and h = log(buckets) / log(FAN).

Addresses (`node`): buckets and relays count from 0; shard s is -1 - s.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import column_bytes, ids_of, pieces, plan_bytes

SHARD_BYTES = 4 << 20  # of input, the documents of a shard
BUCKET_BYTES = 8 << 20  # of input, whose keys a bucket holds
FAN = 4096  # rows that a shard or relay sends in one hop at most

MESSAGE = "node long, sender long, keys binary, aux binary"
ANSWER = "node long, sender long, data binary, note binary"
_MESSAGE = pa.schema([("node", pa.int64()), ("sender", pa.int64()), ("keys", pa.binary()), ("aux", pa.binary())])
_ANSWER = pa.schema([("node", pa.int64()), ("sender", pa.int64()), ("data", pa.binary()), ("note", pa.binary())])
STAYS = 1 << 62  # the sender of what a shard keeps to itself: it is never passed on


def address(shard: int) -> int:
    return -1 - shard


def pack(x: np.ndarray) -> bytes:
    """Compressed byte by byte: the upper bytes of small numbers take no room."""
    size = x.dtype.itemsize
    return zstandard.compress(bytes([size]) + np.ascontiguousarray(x).view(np.uint8).reshape(-1, size).T.tobytes(), 1)


def unpack(x: bytes) -> bytes:
    flat = zstandard.decompress(x)
    return np.frombuffer(flat, np.uint8, offset=1).reshape(flat[0], -1).T.tobytes()


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as differences."""
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_keys(x: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(unpack(x), np.uint64), dtype=np.uint64)


@dataclass(frozen=True)
class Route:
    """fan ** hops buckets; a node of hop j < hops takes the keys of one range from fan ** j shards."""

    fan: int
    hops: int

    @classmethod
    def of(cls, size: int) -> Route:
        n, hops, fan = pieces(size, BUCKET_BYTES), 1, 1
        while FAN**hops < n:
            hops += 1
        while fan**hops < n:
            fan += 1
        return cls(fan, hops)

    def bucket(self, keys: np.ndarray) -> np.ndarray:
        return ((keys >> np.uint64(32)) * np.uint64(self.fan**self.hops) >> np.uint64(32)).astype(np.int64)

    def node(self, hop: int, group: int, bucket):
        """Where keys of this bucket go in this hop, from the shards of this group (of fan ** hop shards)."""
        return bucket if hop == self.hops else group * self.fan**hop + bucket // self.fan ** (self.hops - hop)


class Shards:
    """Documents cut into shards by a hash of id and text; `carry` columns travel along."""

    def __init__(self, docs: DataFrame, carry: Iterable[str] = ()):
        size = plan_bytes(docs)
        self.route = Route.of(size)
        columns = [F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(carry)]
        shard = F.pmod(F.xxhash64("doc_id", "text"), F.lit(pieces(size, SHARD_BYTES)))
        self.docs = docs.select(
            (-1 - shard).cast("long").alias("node"),
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("text").cast("string").alias("text"),
            *columns,
        )

    def first(self, emit: Callable[[pa.Table], pa.Table]) -> DataFrame:
        return self.docs.groupBy("node").applyInArrow(emit, MESSAGE)

    def again(self, answers: DataFrame, emit: Callable[[pa.Table, pa.Table], pa.Table], schema: str = MESSAGE) -> DataFrame:
        return self.docs.groupBy("node").cogroup(answers.groupBy("node")).applyInArrow(emit, schema)

    def decide(self, messages: DataFrame, aux, verdict: Callable[[np.ndarray, np.ndarray], np.ndarray], note: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> DataFrame:
        return decide(self.route, messages, aux, verdict, note)


def decide(route: Route, messages: DataFrame, aux, verdict: Callable[[np.ndarray, np.ndarray], np.ndarray], note: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """verdict(keys, aux) over all entries of a bucket gives an array with an answer for each entry.

    note(keys, aux), a few integers, travels with the bucket's answers, so that each shard learns the sums over all
    buckets; for that, the messages must have been made with every=True.
    """
    kind, way = np.dtype(aux), [messages]
    for hop in range(1, route.hops):
        way.append(way[-1].groupBy("node").applyInArrow(_relay(route, hop, kind, note is not None), MESSAGE))

    def bucket(group: pa.Table) -> pa.Table:
        node = group["node"][0].as_py()
        if node < 0:
            return _passed(group)
        sender, keys, values = _entries(group, kind)
        cuts = np.cumsum([len(k) for k in keys])[:-1]
        keys, values = np.concatenate(keys), np.concatenate(values)
        noted = note(keys, values).astype(np.int64).tobytes() if note else None
        return _table([(s, node, pack(x), noted) for s, x in zip(sender, np.split(verdict(keys, values), cuts))], _ANSWER)

    answers = way[-1].groupBy("node").applyInArrow(bucket, ANSWER)
    for sent in way[-2::-1]:
        answers = sent.groupBy("node").cogroup(answers.groupBy("node")).applyInArrow(_back(kind), ANSWER)
    return answers


def _relay(route: Route, hop: int, kind: np.dtype, every: bool):
    def run(group: pa.Table) -> pa.Table:
        node = group["node"][0].as_py()
        if node < 0:
            return group.filter(pc.not_equal(group["sender"], STAYS))
        _, keys, values = _entries(group, kind)
        keys, values = np.concatenate(keys), np.concatenate(values)
        order = np.argsort(keys, kind="stable")
        group, part = divmod(node, route.fan**hop)
        return _table(_cut(route, hop + 1, group // route.fan, part, node, keys[order], values[order], every), _MESSAGE)

    return run


def _back(kind: np.dtype):
    def run(sent: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(answers) or answers["node"][0].as_py() < 0:
            return answers
        node = answers["node"][0].as_py()
        sender, keys, _ = _entries(sent, kind)
        merged, _ = _joined(answers)
        n = sum(map(len, keys))
        out = np.empty(n, f"V{len(merged) // max(1, n) or 1}")
        out[np.argsort(np.concatenate(keys), kind="stable")] = np.frombuffer(merged, out.dtype)
        noted = notes(answers).tobytes() if answers["note"].null_count == 0 else None
        return _table([(s, node, pack(x), noted) for s, x in zip(sender, np.split(out, np.cumsum([len(k) for k in keys])[:-1]))], _ANSWER)

    return run


def _entries(group: pa.Table, kind: np.dtype) -> tuple[list[int], list[np.ndarray], list[np.ndarray]]:
    """Senders in order, and the keys and values of each."""
    rows = sorted(zip(group["sender"].to_pylist(), group["keys"].to_pylist(), group["aux"].to_pylist()), key=lambda r: r[0])
    return [r[0] for r in rows], [unpack_keys(r[1]) for r in rows], [np.frombuffer(unpack(r[2]), kind) for r in rows]


def _passed(group: pa.Table) -> pa.Table:
    """A shard's own state as an answer to it."""
    rows = zip(group["node"].to_pylist(), group["sender"].to_pylist(), group["aux"].to_pylist())
    return _table([(*r, None) for r in rows if r[1] != STAYS], _ANSWER)


def _table(rows: list, schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows)) or [[] for _ in schema]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _cut(route: Route, hop: int, group: int, part: int, sender: int, keys: np.ndarray, aux: np.ndarray, every: bool) -> list[tuple]:
    """Messages to the nodes of this hop that take the keys; to all that take keys of this part, if every."""
    nodes, starts = np.unique(route.node(hop, group, route.bucket(keys)), return_index=True)
    if every:
        all_nodes = np.arange(part * route.fan, (part + 1) * route.fan) + (0 if hop == route.hops else group * route.fan**hop)
        nodes, starts = all_nodes, np.append(starts, len(keys))[np.searchsorted(nodes, all_nodes)]
    return [(int(n), sender, pack_keys(keys[s:e]), pack(aux[s:e])) for n, s, e in zip(nodes, starts, [*starts[1:], len(keys)])]


def messages(shard: int, route: Route, keys: np.ndarray, aux: np.ndarray, state: bytes | None = None, stays: bool = False, every: bool = False) -> pa.Table:
    """A row for each node that gets some of the keys (sorted, distinct); for all nodes the shard can send to, if every.

    The state comes back unchanged to this shard with the answers; or it stays, beside the messages.
    """
    rows = _cut(route, 1, shard // route.fan, 0, address(shard), keys, aux, every)
    if state is not None:
        rows.append((address(shard), STAYS if stays else address(shard), b"", state))
    return _table(rows, _MESSAGE)


def _joined(group: pa.Table) -> tuple[bytes, bytes]:
    rows = sorted(zip(group["sender"].to_pylist(), group["data"].to_pylist()), key=lambda x: x[0])
    return b"".join(unpack(x) for b, x in rows if b >= 0), b"".join(x for b, x in rows if b < 0)


def answers(group: pa.Table, kind: str) -> tuple[np.ndarray, bytes]:
    """The answers in the order of the shard's keys, and its state."""
    data, state = _joined(group)
    return np.frombuffer(data, np.dtype(kind)), state


def notes(group: pa.Table) -> np.ndarray:
    """The sums of the notes of all buckets."""
    return np.sum([np.frombuffer(x, np.int64) for x in group["note"].to_pylist() if x is not None], axis=0)


def pack_parts(*arrays: np.ndarray) -> bytes:
    return pickle.dumps([(x.dtype.str, pack(x)) for x in arrays])


def unpack_parts(x: bytes) -> list[np.ndarray]:
    return [np.frombuffer(unpack(data), kind) for kind, data in pickle.loads(x)]


def pack_state(*arrays: np.ndarray) -> bytes:
    """Integer arrays as differences, compressed."""
    out = [np.array([len(arrays), *map(len, arrays)], np.int64), *(np.diff(x.astype(np.int64), prepend=0) for x in arrays)]
    return pack(np.concatenate(out))


def unpack_state(state: bytes) -> list[np.ndarray]:
    flat = np.frombuffer(unpack(state), np.int64)
    n = int(flat[0])
    return [np.cumsum(x) for x in np.split(flat[n + 1 :], np.cumsum(flat[1:n + 1])[:-1])]


class Batch:
    """The documents of one shard in a fixed order, whatever order they were fetched in."""

    def __init__(self, group: pa.Table):
        ids, texts = ids_of(group["doc_id"]), column_bytes(group["text"])
        order = sorted(range(len(texts)), key=lambda i: (ids[i], texts[i]))
        self.shard = address(group["node"][0].as_py()) if len(texts) else 0
        self.rows = group.take(pa.array(order, pa.int64())) if len(texts) else group
        self.ids = ids[order] if len(texts) else ids
        self.texts = [texts[i] for i in order]


def runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))


def totals(keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each entry, the sum of the weights of all entries with its key."""
    order = np.argsort(keys, kind="stable")
    starts = runs(keys[order])
    sums = np.add.reduceat(weights[order], starts, dtype=np.int64) if len(starts) else np.zeros(0, np.int64)
    out = np.empty(len(keys), np.int64)
    out[order] = np.repeat(sums, np.diff([*starts, len(keys)]))
    return out


def minima(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each entry, the least value of all entries with its key."""
    order = np.argsort(keys, kind="stable")
    starts = runs(keys[order])
    least = np.minimum.reduceat(values[order], starts) if len(starts) else values[:0]
    out = np.empty(len(keys), values.dtype)
    out[order] = np.repeat(least, np.diff([*starts, len(keys)]))
    return out
