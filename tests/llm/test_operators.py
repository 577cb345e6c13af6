"""The training-data operators against brute force, on a table with nulls, ties, copies, empty and long texts."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash

from quern.llm import bpe, chat, contamination, cotrain, exchange, lm, quality, sharding, simhash, substring, suffix

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, __doc string"
WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def _texts():
    words = lambda a, n: " ".join(f"w{(a * 7 + i * i) % 97}é" for i in range(n))
    passage = words(3, 30)
    out = [None, "", "   \n\t ", "one", words(1, 3), "a" * 900, "ab" * 500, passage, passage, passage, words(5, 60) + " " + passage, passage + "\n" + words(9, 40)]
    out += [words(2, 15), words(2, 15).upper(), words(2, 14), "x y z " * 30, "line\nline\nother\n\nline # $", "漢字 " * 150, words(11, 4000), "Ünï cödé\x1cmix \U0001f600"]
    return out + [words(20 + i, 40 + i) for i in range(8)]


@pytest.fixture(scope="module")
def rows():
    found = [(i, t, "en" if i % 3 else None, f"s{i % 2}", None, 1, "x") for i, t in enumerate(_texts())]
    return found + [found[7], found[7], (None, _texts()[7], None, None, None, None, None), (None, None, None, None, None, None, None)]


@pytest.fixture(scope="module", autouse=True)
def small_shards():
    exchange.SHARD_BYTES, before = 4000, exchange.SHARD_BYTES
    yield
    exchange.SHARD_BYTES = before


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def same(df, want, *columns):
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    assert got == sorted(want, key=repr)


def raw(row):
    return (row[1] or "").encode()


def test_substring_dedup(docs, rows, empty):
    own = lambda r: math.inf if r[0] is None else r[0]
    first = {}
    for r in sorted(rows, key=own):
        w = raw(r).split()
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), own(r))
    want = []
    for r in rows:
        w = raw(r).split()
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < own(r):
                gone[k : k + 13] = [True] * 13
        want.append((r[0], len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest(), r[3]))
    same(substring.dedup_substrings(docs, ("source", "shard")), want, "doc_id", "n_words", "n_removed", "kept_sha256", "source")
    assert substring.dedup_substrings(empty).count() == 0


def test_byte_dedup(docs, rows, empty):
    count = Counter(raw(r)[k : k + 400] for r in rows for k in range(len(raw(r)) - 399))
    want = []
    for r in rows:
        t = raw(r)
        gone = bytearray(len(t))
        for k in range(len(t) - 399):
            if count[t[k : k + 400]] > 1:
                gone[k : k + 400] = b"\1" * 400
        kept = bytes(x for x, g in zip(t, gone) if not g)
        want.append((r[0], len(t), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(kept).hexdigest()))
    same(suffix.dedup_bytes(docs), want, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert suffix.dedup_bytes(empty).count() == 0


def test_lm(docs, rows, empty):
    tokens = [[*raw(r).lower().split(), None] for r in rows]
    held = [r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 2 for r in rows]
    one, two, before = Counter(), Counter(), Counter()
    for w, h in zip(tokens, held):
        if not h:
            one.update(w)
            two.update(zip(["^", *w], w))
            before.update(["^", *w[:-1]])
    n, v = sum(one.values()), len(one)
    p = lambda w: (one[w] + 1) / (n + v + 1)
    want = []
    for r, w, h in zip(rows, tokens, held):
        score = sum(math.log10((two[a, b] + lm.PRIOR * p(b)) / (before[a] + lm.PRIOR)) for a, b in zip(["^", *w], w))
        want.append((r[0], h, len(w), sum(one[x] > 0 for x in w), n, round(sum(math.log10(p(x)) for x in w), 6), round(score, 6)))
    got = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in lm.score_documents(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert lm.score_documents(empty).count() == 0


def test_simhash(docs, rows, empty):
    def print_of(t):
        w = t.lower().split()
        grams = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [b" ".join(w)] * bool(w)
        h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = [print_of(raw(r)) for r in rows]
    group = list(range(len(rows)))
    for _ in rows:
        group = [min(group[j] for j in range(len(rows)) if (prints[i] ^ prints[j]).bit_count() <= 4) for i in range(len(rows))]
    least = {}
    for r, g in zip(rows, group):
        if r[0] is not None:
            least[g] = min(least.get(g, r[0]), r[0])
    same(simhash.near_duplicates(docs), [(r[0], f"{p:016x}", least.get(g)) for r, p, g in zip(rows, prints, group)], "doc_id", "fingerprint", "component_id")
    assert simhash.near_duplicates(empty).count() == 0


def test_vantage_point_tree_is_exact():
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 2**63, 4).astype(np.uint64)
    near = (centres[:, None] ^ (np.uint64(1) << rng.integers(0, 64, (4, 150)).astype(np.uint64))).ravel()
    points = np.unique(np.concatenate([near, rng.integers(0, 2**63, 900).astype(np.uint64)]))

    def groups(stars):
        root = {int(p): int(p) for p in points}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for members, r in stars:
            for m in members:
                a, b = sorted((find(int(m)), find(int(r))))
                root[b] = a
        return [find(int(p)) for p in points]

    every = [(np.array([q for q in points if (int(p) ^ int(q)).bit_count() <= 4 and q != p], np.uint64), p) for p in points]
    assert groups(simhash.tree_links(points, 4, 16)) == groups(every)


def test_components_of_paths(spark):
    n = 40
    edges = spark.createDataFrame([(i, i + 1) for i in range(n) if i % 10 != 9], "u long, v long")
    same(simhash.components(edges), [(i, i // 10 * 10) for i in range(n) if i % 10], "node", "root")


def test_bpe_trees():
    ranks = open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb").read()
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    rng = np.random.default_rng(1)
    letters = list(" \n\t'sdtrevml ab12é　漢\U0001f600.,!\r\x1c ")
    texts = [t or "" for t in _texts()] + ["".join(rng.choice(letters, rng.integers(0, 80))) for _ in range(400)]
    for leaf in (3, 17, 500):
        own = bpe.Coder(ranks, public_tokenizers.PATTERN, leaf)
        for t in texts:
            ids = own.encode(t)
            assert ids == plain.encode_ordinary(t) and own.decode(ids) == t.encode()


def test_bpe_documents(docs, rows, empty):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    got = bpe.encode_documents(docs, path, public_tokenizers.PATTERN, with_decoded=True).collect()
    assert sorted((repr(r.doc_id), bytes(r.decoded)) for r in got) == sorted((repr(r[0]), raw(r)) for r in rows)
    assert all(r.decoded_sha256 == hashlib.sha256(r.decoded).hexdigest() and r.n_tokens == len(r.ids) for r in got)
    assert bpe.encode_documents(empty, path, public_tokenizers.PATTERN).count() == 0


def test_sharding(spark, docs, rows, empty, tmp_path):
    found = sharding.records(docs)
    loads = sharding.slot_bytes(found)
    slot_map = sharding.build_map(loads, shards=5)
    got = sharding.assign(found, slot_map, loads).collect()
    assert sorted((repr(r.doc_id), r.size, r.text_crc32) for r in got) == sorted((repr(r[0]), len(raw(r)) + 16, zlib.crc32(raw(r))) for r in rows)
    for s in range(5):
        places = sorted(r.slot for r in got if r.shard == s)
        assert places == list(range(len(places)))
    path = str(tmp_path / "map")
    sharding.save_map(spark, path, slot_map, 1)
    grown = sharding.rebalance(slot_map, loads, 6)
    sharding.save_map(spark, path, grown, 2)
    assert sharding.load_map(spark, path) == (2, grown) and sharding.load_map(spark, path, 1) == (1, slot_map)
    assert all(b == 5 for a, b in zip(slot_map, grown) if a != b) or sum(a != b for a, b in zip(slot_map, grown)) < len(loads)
    assert sharding.slot_bytes(sharding.records(empty)) == [] and sharding.assign(sharding.records(empty), slot_map, []).count() == 0


def test_decontamination(spark, docs, rows, empty):
    text = _texts()
    items = [(1, " ".join(text[7].split()[3:20])), (2, "ONE"), (3, None), (4, "..."), (5, text[18][5000:5200]), (6, "never seen anywhere in it"), (6, text[12]), (None, text[7])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = []
    for r in rows:
        w = WORD.findall(raw(r).lower())
        hit, ids = set(), set()
        for i, t in items:
            x = WORD.findall((t or "").encode().lower())
            n = min(10, len(x))
            for s in range(len(x) - n + 1) if n and i is not None else ():
                for k in range(len(w) - n + 1):
                    if w[k : k + n] == x[s : s + n]:
                        hit |= set(range(k, k + n))
                        ids.add(str(i))
        want.append((r[0], len(w), len(hit), sorted(ids), bool(hit), r[6]))
    found = contamination.find(docs.withColumnRenamed("__doc", "item"), bench)
    same(found, want, "doc_id", "n_words", "n_hit", "item_ids", "contaminated", "item")
    assert found.filter("n_hit > 20 and n_near = 0").count() == 0
    clashing = docs.withColumnsRenamed({"shard": "n_hit", "lang": "contaminated"})
    same(contamination.find(clashing, bench), want, "doc_id", "n_words", "n_hit", "item_ids", "contaminated", "__doc")
    kept = contamination.clean(clashing, bench)
    assert kept.columns == clashing.columns
    same(kept, [(r[0], r[1], r[2], r[3], r[5]) for r, w in zip(rows, want) if not w[4]], "doc_id", "text", "contaminated", "source", "n_hit")
    assert contamination.find(empty.drop("__doc"), bench).count() == 0 and contamination.find(docs.drop("__doc"), bench.limit(0)).filter("contaminated").count() == 0


def test_quality_counts_and_sketch(spark, docs, rows, empty):
    def brute(t):
        w, lines = t.split(), [x for x in t.split(b"\n") if x.split()]
        windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        hit = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        return len(w), sum(len(x.decode()) for x in w), sum(chr(c) in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit)

    out = quality.apply_rules(docs)
    want = [(r[0], *(c := brute(raw(r))), c[0] < 50 or 100 * c[4] > 50 * c[0]) for r in rows]
    same(out, want, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert out.filter("kept and (base_failed or size(failed) > 0)").count() == 0
    assert quality.apply_rules(empty).count() == 0
    measured = quality.measure(docs)
    parts = quality.sketch(measured.filter("n_words % 2 = 0")).union(quality.sketch(measured.filter("n_words % 2 = 1")))
    merged = parts.groupBy("lang", "source", "rate", "value").agg({"n": "sum"})
    assert sorted(map(tuple, merged.collect()), key=repr) == sorted(map(tuple, quality.sketch(measured).collect()), key=repr)


def test_quality_thresholds_follow_the_group(spark):
    rows = [(i, "en", "a", 1000, 5000 + i % 100, 0, 0, 0) for i in range(300)] + [(1000 + i, "en", "b", 1000, 5000, 100 + i % 50, 0, 0) for i in range(300)]
    limits = {(r.source, r.rate): (r.low, r.high) for r in quality.thresholds(quality.sketch(spark.createDataFrame(rows, f"doc_id long, lang string, source string, {quality._COUNTS}"))).collect()}
    assert limits["a", "symbols"] == (0, 0) and limits["b", "symbols"][1] > 1200


def test_cotraining(spark, empty):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 4))
    rows, labels = [], []
    for i in range(600):
        bad, toxic = i % 5 == 0, i % 7 == 0
        text = " ".join(("NOISE!! ###" if bad else word()) for _ in range(60)) + " scum" * toxic
        rows.append((i, text, "en", "s", len(text), 0, ""))
        if i % 2 and i > 10:
            labels.append((i, int(not bad), int(toxic)))
    docs = spark.createDataFrame([*rows, (None, None, None, None, None, None, None), (9999, "", "en", "s", 0, 0, "")], SCHEMA)
    known = spark.createDataFrame([*labels, labels[0], (5, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in cotrain.classify(docs, known).collect()}
    assert len(out) == 602
    wrong = [i for i in range(600) if out[i].kept != (i % 5 != 0 and i % 7 != 0)]
    assert len(wrong) <= 6
    assert cotrain.keep_good(docs, known).count() == sum(r.kept for r in out.values())
    assert cotrain.classify(empty, known).count() == 0
    assert cotrain.classify(docs, known.limit(0)).filter("kept").count() == 602


def test_chat(spark):
    rows = [(1, 0, "ann", "hi"), (1, 1, "bob", "yo <|im_start|>"), (1, 2, "system", "be"), (1, 2, "system", "be"), (1, 70, "ann", None), (1, None, None, "?"), (None, 0, "ann", "lone"), (3, 0, "system", "only")]
    conversations = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, perspective string")
    got = {(r.conv_id, r.perspective, r.part): r for r in chat.rotate(conversations).collect()}
    assert set(got) == {(1, p, k) for p in ("ann", "bob", "unknown") for k in (-1, 0, 1)} | {(None, "ann", 0)}
    assert got[1, "bob", 0].text == "<|im_start|>user name=ann\nhi<|im_end|>\n<|im_start|>assistant\nyo < |im_start|><|im_end|>\n" + "<|im_start|>system\nbe<|im_end|>\n" * 2
    for r in got.values():
        at, trained = 0, ""
        for n, train in r.mask:
            trained += r.text[at : at + n] if train else ""
            at += n
        assert at == len(r.text)
        if (r.conv_id, r.perspective, r.part) == (1, "bob", 0):
            assert trained == "yo < |im_start|><|im_end|>"
    assert chat.rotate(conversations.limit(0)).count() == 0
