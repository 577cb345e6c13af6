"""Rounds between shards and buckets: the same answers over one hop and over several, and rows that grow with the input."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.llm import exchange, substring
from quern.llm.exchange import Batch, Route, Shards, answers, messages, notes, pack_keys, totals, unpack_keys


def test_packed_keys():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 1000):
        keys = np.sort(rng.integers(0, 2**64, n, dtype=np.uint64))
        assert (unpack_keys(pack_keys(keys)) == keys).all()
    assert unpack_keys(pack_keys(np.array([3, 3, 2**64 - 1], np.uint64))).tolist() == [3, 3, 2**64 - 1]


def test_routes_reach_every_bucket(monkeypatch):
    monkeypatch.setattr(exchange, "FAN", 4)
    monkeypatch.setattr(exchange, "BUCKET_BYTES", 10)
    for size, want in ((1, (1, 1)), (40, (4, 1)), (50, (3, 2)), (160, (4, 2)), (170, (3, 3)), (640, (4, 3))):
        assert Route.of(size) == Route(*want)
    keys = np.sort(np.random.default_rng(2).integers(0, 2**64, 9999, dtype=np.uint64))
    assert set(Route(3, 3).bucket(keys).tolist()) == set(range(27))




@pytest.mark.parametrize("fan,bucket", [(512, 1 << 20), (3, 1000), (2, 1000)])
def test_totals_over_hops(spark, monkeypatch, fan, bucket):
    monkeypatch.setattr(exchange, "SHARD_BYTES", 1500)
    monkeypatch.setattr(exchange, "BUCKET_BYTES", bucket)
    monkeypatch.setattr(exchange, "FAN", fan)
    docs = spark.createDataFrame([(i, " ".join(str(j % 50 + i % 5) for j in range(60))) for i in range(120)], "doc_id long, text string")
    want = docs.select(F.explode(F.split("text", " ")).alias("w")).groupBy("w").count().agg(F.sum("count"), F.count("*"), F.sum(F.col("count") * F.col("count"))).first()
    shards = Shards(docs)
    route = shards.route
    assert (shards.route.hops == 1) == (fan == 512) and (fan != 2 or shards.route.hops >= 4)

    def check(group, got):
        batch = Batch(group)
        words = [int(w) for t in batch.texts for w in t.split()]
        keys, counts = np.unique(mixed(np.array(words, np.uint64)), return_counts=True)
        sums, state = answers(got, "i8")
        assert not len(batch.texts) or state == b"state%d" % batch.shard
        return pa.table({"n": [int(counts.sum())], "square": [int((sums * counts).sum())], "distinct": [int(notes(got)[0])]})

    def mixed(x):
        return x * np.uint64(0x9E3779B97F4A7C15)

    def emit(group):
        batch = Batch(group)
        keys, counts = np.unique(mixed(np.array([int(w) for t in batch.texts for w in t.split()], np.uint64)), return_counts=True)
        return messages(batch.shard, route, keys, counts.astype(np.uint32), b"state%d" % batch.shard, every=True)

    found = shards.decide(shards.first(emit), "u4", totals, lambda keys, n: np.array([len(np.unique(keys)), 1]))
    out = shards.again(found, check, "n long, square long, distinct long")
    assert tuple(out.agg(F.sum("n"), F.sum("square")).first()) == (want[0], want[2])
    assert {r.distinct for r in out.collect()} == {want[1]}  # every shard learns the sum over all buckets


def test_rows_of_a_hop_do_not_grow_with_the_square(spark, monkeypatch):
    """Four times the documents make four times the rows, not sixteen times."""
    monkeypatch.setattr(exchange, "SHARD_BYTES", 1000)
    monkeypatch.setattr(exchange, "BUCKET_BYTES", 1000)
    monkeypatch.setattr(exchange, "FAN", 4)

    def rows(n):
        rng = np.random.default_rng(n)
        docs = spark.createDataFrame([(i, " ".join(map(str, rng.integers(0, 10**9, 40)))) for i in range(n)], "doc_id long, text string")
        shards = Shards(docs)
        route = shards.route

        def emit(group):
            batch = Batch(group)
            keys = np.unique(np.array([int(w) for t in batch.texts for w in t.split()], np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            return messages(batch.shard, route, keys, np.ones(len(keys), np.uint32))

        sent, total = shards.first(emit), 0
        for hop in range(1, shards.route.hops + 1):
            total += sent.count()
            if hop < shards.route.hops:
                sent = sent.groupBy("node").applyInArrow(exchange._relay(shards.route, hop, np.dtype("u4"), False), exchange.MESSAGE)
        return total / shards.route.hops

    assert rows(400) < 5 * rows(100)


def test_hops_give_the_same_substrings(spark, monkeypatch):
    monkeypatch.setattr(exchange, "SHARD_BYTES", 3000)
    rng = np.random.default_rng(7)
    line = " ".join(f"p{i}" for i in range(30))
    docs = spark.createDataFrame([(i, " ".join(f"w{x}" for x in rng.integers(0, 10**9, 80)) + (" " + line if i % 3 == 0 else "")) for i in range(90)], "doc_id long, text string")
    out = []
    for fan, bucket in ((512, 1 << 24), (2, 2000)):
        monkeypatch.setattr(exchange, "FAN", fan)
        monkeypatch.setattr(exchange, "BUCKET_BYTES", bucket)
        out.append(sorted(map(tuple, substring.dedup_substrings(docs).select("doc_id", "n_removed", "kept_sha256").collect())))
    assert out[0] == out[1] and sum(r[1] for r in out[0]) == 29 * 30


def test_removal_comes_from_the_automata(spark):
    line = " ".join(f"p{i}" for i in range(20))
    docs = spark.createDataFrame([(1, "a b " + line), (2, line + " c"), (3, line)], "doc_id long, text string")
    removed = lambda build: {r.doc_id: r.n_removed for r in substring.dedup_substrings(docs, build=build).collect()}
    assert removed(substring.automata) == {1: 0, 2: 20, 3: 20}
    nothing = np.zeros(0, np.int64)
    assert removed(lambda phrases: lambda text: nothing) == {1: 0, 2: 0, 3: 0}


def test_automata_in_slices_find_every_occurrence(monkeypatch):
    monkeypatch.setattr(substring, "PATTERNS", 3)
    rng = np.random.default_rng(3)
    for spread in (3, 70000):
        texts = [" ".join(map(str, rng.integers(0, spread, n))) for n in (0, 40, 1, 300, 25000)] + [" ".join("x" * 40 + str(i) for i in range(60000))] * (spread > 12)
        batch = Batch(pa.table({"node": pa.array([-1] * len(texts), pa.int64()), "doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts}))
        words = substring._Words(batch)
        lists = [t.encode().split() for t in texts]
        assert words.counts.tolist() == [len(x) for x in lists]
        flat = [(d, w) for d, x in enumerate(lists) for w in x]
        gram = lambda i: tuple(x[1] for x in flat[i : i + 6])
        places = np.array([3, 30, 41 + 200, 341 + 17, 341 + 600, 341 + 24900 - 5])
        at, which = substring.occurrences(words, places, 6, 3)
        want = {(i, gram(i)) for i in range(len(flat) - 5) if flat[i][0] == flat[i + 5][0] and gram(i) in set(map(gram, places.tolist()))}
        assert {(int(a), gram(places[k])) for a, k in zip(at, which)} == want and len(want) >= len(places)
