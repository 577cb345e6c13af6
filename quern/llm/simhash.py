"""SimHash near-duplicates with vantage-point shards (operator 8).

Fingerprints: 64 bits, by majority over the XXH64 hashes of the word shingles, repeats included. Two
fingerprints link if they differ in at most RADIUS bits; groups are the connected components.

Random fingerprints all lie about 32 bits, give or take 4, from any vantage point, so a vantage cut of the
whole space with an overlap of 4 keeps most points on both sides (see README). Candidate search is therefore
banding: the 64 bits are cut in RADIUS + 2 parts (more for more fingerprints, so that balls of random ones stay
small); of two fingerprints within RADIUS, all parts but RADIUS of some choice are equal, so the pair meets
in the ball of that choice. A fingerprint lies in one ball of each choice (15 at six parts), so balls overlap. Within
a ball of over 256 points a vantage-point tree cuts by Hamming distance: the inner side takes all within m + RADIUS of
the vantage point, the outer all beyond m, and by the triangle inequality no linked pair is lost. Leaves
grow components from each point among those not reached yet, so a dense group of m points costs about m
comparisons, and only one edge for each member leaves the leaf, never all pairs. A ball of over BALL points is
cut in blocks, each two of which meet in a task.

Equal fingerprints are one node. Components of the edges come from alternating star steps over written tables.
Null or empty text: fingerprint zero. A null doc_id gets its group's smallest id but is never one. Repeated rows
each get the result. An empty table gives no rows.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import column_bytes, pieces, stored

SHINGLE, RADIUS, SEED = 4, 4, 42
_LEAF = 256
BALL = 20_000  # fingerprints of one ball that one task takes at most


def fingerprint(text: bytes, n: int = SHINGLE) -> int:
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.concatenate([np.flatnonzero(np.frombuffer(joined, np.uint8) == 32), [len(joined)]])
    if len(words) > n:
        starts = np.concatenate([[0], ends[:-n] + 1]).tolist()
        hashes = np.array([xxhash.xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts, ends[n - 1 :].tolist())], "<u8")
    else:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], "<u8")
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[k : k + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    def run(batches):
        for batch in batches:
            found = np.array([fingerprint(t, shingle) for t in column_bytes(batch["text"])], np.uint64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, fp long")


def parts(n: int, radius: int, few: int = 4) -> int:
    """In how many parts to cut fingerprints so that a ball of n random ones holds few: with more, more of them are equal."""
    p = radius + 2
    while p < 2 * radius + 2 and n >> (64 * (p - radius) // p) > few:
        p += 1
    return p


def _ball_keys(radius: int, n_parts: int) -> Column:
    """The keys of the balls of a fingerprint: all but `radius` of the parts of its bits, with their choice's number."""
    cuts = [64 * i // n_parts for i in range(n_parts + 1)]
    part = [F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(cuts, cuts[1:])]
    return F.array(*(F.xxhash64(F.lit(k), *(part[i] for i in chosen)) for k, chosen in enumerate(itertools.combinations(range(n_parts), n_parts - radius))))


def near(x: np.ndarray, y) -> np.ndarray:
    return np.bitwise_count(x ^ y)


def _grow(points: np.ndarray, radius: int) -> list[tuple[np.ndarray, int]]:
    """Components of a leaf: (other members, root) for those of two or more."""
    out, rest = [], points
    while len(rest) > 1:
        root, front, members, rest = rest[0], [rest[0]], [], rest[1:]
        while front and len(rest):
            close = near(rest, front.pop()) <= radius
            if close.any():
                found, rest = rest[close], rest[~close]
                members.append(found)
                front += list(found)
        if members:
            out.append((np.concatenate(members), root))
    return out


def tree_links(points: np.ndarray, radius: int = RADIUS, leaf: int = _LEAF) -> list[tuple[np.ndarray, int]]:
    """Stars that connect all points within the radius of each other, by a vantage-point tree."""
    todo, out = [points], []
    while todo:
        points = todo.pop()
        if len(points) > leaf:
            distance = near(points, points[len(points) // 2])
            middle = int(np.median(distance))
            inner, outer = points[distance <= middle + radius], points[distance > middle]
            if max(len(inner), len(outer)) < 0.9 * len(points):
                todo += [inner, outer]
                continue
        out += _grow(points, radius)
    return out


def links(nodes: DataFrame, radius: int = RADIUS, rows_per_task: int = 50_000, largest: int = BALL, few: int = 4) -> DataFrame:
    """Edges (u, v), u < v, between distinct fingerprints; they connect all that lie within the radius."""
    count = nodes.count()
    n_parts = parts(count, radius, few)
    n = pieces(count * math.comb(n_parts, radius), rows_per_task)

    def run(group: pa.Table) -> pa.Table:
        key, fp = group["key"].to_numpy(), group["fp"].to_numpy().view(np.uint64)
        order = np.lexsort((fp, key))
        key, fp = key[order], fp[order]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff([*starts, len(key)])
        u, v = [], []
        small = np.repeat(sizes <= 48, sizes)
        k, x = key[small], fp[small]
        for j in range(1, int(sizes[sizes <= 48].max(initial=1))):
            hit = np.flatnonzero((k[:-j] == k[j:]) & (near(x[:-j], x[j:]) <= radius))
            u.append(x[hit])
            v.append(x[hit + j])
        for a, m in zip(starts[sizes > 48], sizes[sizes > 48]):
            for members, root in tree_links(fp[a : a + m], radius):
                u.append(np.full(len(members), root))
                v.append(members)
        u, v = (np.concatenate(x).astype(np.uint64).view(np.int64) if x else np.zeros(0, np.int64) for x in (u, v))
        return pa.table({"u": np.minimum(u, v), "v": np.maximum(u, v)})

    keyed = nodes.select(F.explode(_ball_keys(radius, n_parts)).alias("key"), "fp")
    large = stored(keyed.groupBy("key").agg(F.count("*").alias("size")).filter(F.col("size") > largest))
    if not large.isEmpty():  # a large ball is cut in blocks; each two of them meet in a ball of their own
        blocks = F.ceil(F.col("size") / largest).cast("int")
        own = F.pmod(F.xxhash64(F.lit("block"), "fp"), blocks).cast("int")
        pairs = F.transform(F.sequence(F.lit(0), blocks - 1), lambda other: F.xxhash64("key", F.least(other, own), F.greatest(other, own)))
        keyed = keyed.join(large, "key", "left").select(F.explode(F.when(F.col("size").isNull(), F.array("key")).otherwise(pairs)).alias("key"), "fp")
    return keyed.withColumn("task", F.pmod(F.xxhash64("key"), F.lit(n)).cast("int")).groupBy("task").applyInArrow(run, "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of edges (u, v); root is the least node. Alternating large and small stars."""
    edges = stored(edges.selectExpr("least(u, v) u", "greatest(u, v) v").filter("u < v").distinct())
    mark = None
    while True:
        both = edges.union(edges.selectExpr("v u", "u v"))
        # the minima are written, so that both sides of each join are plain shuffles, which adaptive execution can split
        least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = stored(both.join(least, "u").filter("v > u").selectExpr("m u", "v").filter("u < v").distinct())
        down = stored(large.groupBy("v").agg(F.min("u").alias("m")))
        small = large.join(down, "v").select(F.col("m"), F.explode(F.array("u", "v")).alias("v")).filter("m < v").selectExpr("m u", "v").distinct()
        edges = stored(small)
        new = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if new == mark:
            return edges.selectExpr("v node", "u root")
        mark = new


def smallest(named: DataFrame, node: str) -> DataFrame:
    """(node, component_id) from (node, first, root): the least `first` of each root, written before it is joined, so
    that a root with many nodes can be split."""
    named = stored(named)
    least = stored(named.groupBy("root").agg(F.min("first").alias("component_id")))
    return named.join(least, "root").select(node, "component_id")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id (smallest doc_id of the group)."""
    prints = stored(fingerprints(docs, shingle))
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(links(nodes.select("fp"), radius))
    named = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    of = smallest(named, "fp")
    return prints.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
