"""Near copies by SimHash, confirmed by exact similarity of shingle sets, and the rest (the pipeline's near-dedup stage).

Documents link if the Jaccard similarity of their sets of five-word shingles is at least 4/5; groups are the
connected components. No pair is lost to an estimate:

1. A round of key buckets counts the documents of each shingle, which orders all shingles, rarest first. Of two
   sets within 4/5, each has at least 4/5 of its own shingles in common with the other, so they share one of
   the rarest fifth (and one more) of both. A document whose rarest fifth no other document holds is done.
2. SimHash, as in operator 8, of the others: fingerprints by majority over the shingles' keys, balls of equal parts,
   vantage-point trees in large balls. Fingerprints within RADIUS bits of each other (fewer for more fingerprints, so that
   random ones do not chain), and chains of them, are candidates.
3. The sets of a group of candidates meet in one task, which compares them exactly, growing groups among those not
   reached yet, so a dense group of m sets never makes m^2 rows. A group of over LARGEST sets is first compared with
   its least set, each set by itself. What is within 4/5 of that is one group; only the sets outside of it must still be
   compared with all. They are cut in blocks of LARGEST, as all are, and each block of the ones meets each of the others
   in a task. So a large group of near copies costs a comparison for each, and no task holds more than two blocks.
4. The rest: two sets at 4/5 differ in 9.7 of 64 bits on average (standard deviation 2.9), so SimHash misses some at any
   radius that still tells texts apart. Documents that share a shingle of step 1 are chained to the least of them, and
   alternating stars give coarse components: no linked pair lies in two of them. A coarse component that step 3 has made
   one group is done, the sets of the others are compared as in step 3, and both steps' links are joined.

Words are those of operator 8 (ASCII lower case, cut at ASCII whitespace); fewer than five are one shingle.
Words, shingles and equal sets are told apart by 64-bit keys. Null or empty text: the empty set, all equal. A null
doc_id gets its group's smallest id but is never one.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import stored, window_hash
from quern.llm.exchange import Batch, Shards, answers, messages, totals
from quern.llm.rolling import words_of
from quern.llm.simhash import components, links, majority, smallest

SHINGLE = 5
PART, WHOLE = 4, 5  # least similarity: PART / WHOLE
LARGEST = 1000  # sets of one block
RADIUS = 12  # bits
_BALL = 4096  # random fingerprints of a ball, about, before they are cut in more parts

_PRINTS = "doc_id long, node long, tokens array<long>, keys binary, fp long"


def shingle_sets(texts: list[bytes], n: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle keys of each text."""
    hashes, counts = words_of(texts, lower=True)
    keys, out = window_hash(hashes, n), []
    for start, count in zip((np.cumsum(counts) - counts).tolist(), counts.tolist()):
        out.append(np.unique(keys[start : start + count - n + 1]) if count >= n else window_hash(hashes[start : start + count], max(1, count)))
    return out


def rarest(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Of a set's shingles, rarest first, those that a set within PART / WHOLE must share one of, if others hold them."""
    n = len(keys) - -(-PART * len(keys) // WHOLE) + 1
    first = np.lexsort((keys, counts))[:n]
    return keys[first[counts[first] > 1]]


def roots(sets: list[np.ndarray]) -> np.ndarray:
    """For each of some sets, the first set of its component; sets link at a similarity of PART / WHOLE."""
    m, sizes = len(sets), np.array([len(x) for x in sets], np.int64)
    known, flat = np.unique(np.concatenate(sets), return_inverse=True)
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    root, rest, left, built = np.arange(m), np.ones(m, bool), m, 2 * m
    for r in range(m):
        if not rest[r]:
            continue
        rest[r], left, front = False, left - 1, [r]
        while front and left:
            if 2 * left <= built:  # postings of the sets not reached yet
                built, own = left, np.repeat(rest, sizes)
                order = np.argsort(flat[own], kind="stable")
                holders = np.repeat(np.arange(m), sizes)[own][order]
                starts = np.searchsorted(flat[own][order], np.arange(len(known) + 1))
            p = front.pop()
            t = flat[cuts[p] : cuts[p + 1]]
            n = starts[t + 1] - starts[t]
            at = np.repeat(starts[t] - np.cumsum(n) + n, n) + np.arange(n.sum())
            shared = np.bincount(holders[at], minlength=m)
            close = np.flatnonzero(rest & (WHOLE * shared >= PART * (sizes + sizes[p] - shared)))
            root[close], rest[close], left = r, False, left - len(close)
            front += close.tolist()
    return root


def _compared(group: pa.Table) -> pa.Table:
    """(node, root) for the sets of a group; a set that is there twice counts once."""
    node, order = np.unique(group["node"].to_numpy(), return_index=True)
    keys = group["keys"].to_pylist()
    root = roots([np.frombuffer(keys[i], np.uint64) for i in order])
    return pa.table({"node": node, "root": node[root]})


def _near_least(batches):
    """Which sets are within PART / WHOLE of their component's least set."""
    for batch in batches:
        near = []
        for a, b in zip(batch["keys"].to_pylist(), batch["least_keys"].to_pylist()):
            x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
            shared = len(np.intersect1d(x, y, assume_unique=True))
            near.append(WHOLE * shared >= PART * (len(x) + len(y) - shared))
        yield pa.RecordBatch.from_arrays([batch["coarse"], batch["node"], batch["least"], pa.array(near, pa.bool_())], ["coarse", "node", "least", "near"])


def linked_sets(sets: DataFrame, coarse: DataFrame, largest: int = LARGEST) -> DataFrame:
    """(node, root): the components of the sets (node, keys) whose coarse components (node, coarse) are known."""
    large = stored(coarse.groupBy("coarse").agg(F.count("*").alias("size")).filter(F.col("size") > largest))
    members = sets.join(coarse, "node")
    whole = members.join(large, "coarse", "left_anti").groupBy("coarse").applyInArrow(_compared, "node long, root long")
    if large.isEmpty():
        return whole
    big = stored(members.join(large, "coarse"))
    least = stored(big.groupBy("coarse").agg(F.min("node").alias("least"), F.min_by("keys", "node").alias("least_keys")))
    star = stored(big.join(least, "coarse").select("coarse", "node", "keys", "least", "least_keys").mapInArrow(_near_least, "coarse long, node long, least long, near boolean"))
    outside = star.filter("not near").select("coarse", "node")
    counts = stored(outside.groupBy("coarse").agg(F.count("*").alias("n_outside")))
    few, all_ = F.ceil(F.col("n_outside") / largest), F.ceil(F.col("size") / largest)
    own = lambda n: F.pmod(F.xxhash64(F.lit("block"), "node"), n)
    others = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    cut = big.join(counts, "coarse")
    blocks = cut.select("coarse", "node", "keys", others(few).alias("i"), own(all_).alias("j")).unionByName(
        cut.join(outside, ["coarse", "node"]).select("coarse", "node", "keys", own(few).alias("i"), others(all_).alias("j"))
    )
    met = blocks.withColumn("task", F.xxhash64("coarse", "i", "j")).groupBy("task").applyInArrow(_compared, "node long, root long")
    edges = whole.union(met).union(star.filter("near").select("node", "least")).filter("node <> root")
    return components(edges.selectExpr("node u", "root v"))


def widest(n: int, radius: int = RADIUS) -> int:
    """The largest radius at which n random fingerprints have a tenth of a neighbour each at most."""
    while radius > 4 and 10 * n * sum(math.comb(64, k) for k in range(radius + 1)) > 2**64:
        radius -= 1
    return radius


def print_groups(nodes: DataFrame) -> DataFrame:
    """(node, coarse): groups of two or more nodes (node, fp) whose fingerprints are chained by steps within the radius."""
    roots = components(links(nodes.select("fp").distinct(), widest(nodes.count()), few=_BALL))
    named = stored(nodes.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("node", F.coalesce("root", "fp").alias("coarse")))
    return named.join(named.groupBy("coarse").agg(F.count("*").alias("size")).filter("size > 1").select("coarse"), "coarse").select("node", "coarse")


def not_joined(coarse: DataFrame, linked: DataFrame) -> DataFrame:
    """The coarse components (node, coarse) that links (node, root) have not made one group."""
    roots = coarse.join(linked, "node", "left").select("coarse", F.coalesce("root", "node").alias("root"))
    apart = roots.groupBy("coarse").agg(F.min("root").alias("least"), F.max("root").alias("most")).filter("least <> most")
    return coarse.join(apart.select("coarse"), "coarse").select("node", "coarse")


def near_copies(docs: DataFrame, largest: int = LARGEST) -> DataFrame:
    """doc_id, component_id (smallest doc_id of the group)."""
    shards = Shards(docs)

    def held(group: pa.Table) -> pa.Table:
        batch = Batch(group)
        keys, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_sets(batch.texts)]), return_counts=True)
        return messages(batch.shard, route, keys, counts.astype(np.uint32))

    def chosen(group: pa.Table, got: pa.Table) -> pa.Table:
        batch = Batch(group)
        sets = shingle_sets(batch.texts)
        every = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]))
        counts, _ = answers(got, "u4")
        nodes, tokens, kept, fps, seen = [], [], [], [], set()
        for keys in sets:
            node = xxhash.xxh3_64_intdigest(keys.tobytes())
            nodes.append(node)
            few = rarest(keys, counts[np.searchsorted(every, keys)]) if len(keys) and node not in seen else keys[:0]
            seen.add(node)
            tokens.append(few.view(np.int64).tolist())
            kept.append(keys.tobytes() if len(few) else None)
            fps.append(np.uint64(majority(keys)).view(np.int64) if len(few) else None)
        ids = batch.rows["doc_id"].combine_chunks()
        columns = [ids, pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(tokens, pa.list_(pa.int64())), pa.array(kept, pa.binary()), pa.array(fps, pa.int64())]
        return pa.table(columns, names=["doc_id", "node", "tokens", "keys", "fp"])

    route = shards.route
    counted = shards.decide(shards.first(held), "u4", lambda keys, n: np.minimum(totals(keys, n), 2**32 - 1).astype(np.uint32))
    prints = stored(shards.again(counted, chosen, _PRINTS))
    sets = prints.filter("keys is not null").dropDuplicates(["node"])
    confirmed = stored(linked_sets(sets.select("node", "keys"), stored(print_groups(stored(sets.select("node", "fp")))), largest))
    least = F.min("node").over(Window.partitionBy("token"))
    shared = prints.select("node", F.explode("tokens").alias("token")).distinct().select(least.alias("u"), F.col("node").alias("v"))
    coarse = components(shared.filter("u < v"))
    coarse = coarse.union(coarse.selectExpr("root node", "root")).distinct().selectExpr("node", "root coarse")
    rest = linked_sets(sets.select("node", "keys"), stored(not_joined(coarse, confirmed)), largest)
    linked = stored(components(confirmed.union(rest).filter("node <> root").selectExpr("node u", "root v")))
    nodes = prints.groupBy("node").agg(F.min("doc_id").alias("first")).join(linked, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    named = smallest(nodes, "node")
    return prints.select("doc_id", "node").join(named, "node").select("doc_id", "component_id")
