"""The pipeline's near-dedup stage against all pairs, with planted near copies at similarities about 4/5."""

import numpy as np
import pytest

import corpus_pipeline
from quern.llm import exchange, nearset


@pytest.fixture(autouse=True)
def small_shards(monkeypatch):
    monkeypatch.setattr(exchange, "SHARD_BYTES", 4000)


def brute_sets(texts):
    words = [(t or "").encode().lower().split() for t in texts]
    return [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]


def similar(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def brute_components(sets):
    group = list(range(len(sets)))
    near = [[j for j in range(len(sets)) if similar(sets[i], sets[j])] for i in range(len(sets))]
    while True:
        new = [min(group[j] for j in near[i]) for i in range(len(sets))]
        if new == group:
            return group
        group = new


def corpus():
    """Texts and the similarities of the planted copies to their originals."""
    rng = np.random.default_rng(8)
    word = lambda: f"w{rng.integers(0, 5000)}"
    line = " ".join(f"common{i}" for i in range(40))
    texts, planted = [None, "", " \n", "one two", "ONE two", "one two three"], []
    for i in range(12):
        base = [word() for _ in range(int(rng.integers(90, 400)))]
        texts.append(" ".join(base))
        for share in (0.007, 0.012, 0.02, 0.024, 0.03):
            copy = [word() if rng.random() < share else w for w in base]
            texts.append(" ".join(copy))
            a, b = brute_sets([texts[-1], " ".join(base)])
            planted.append(len(a & b) / len(a | b))
        texts += [" ".join([*base[: len(base) // 2], *(word() for _ in range(60))]), line + " " + " ".join(word() for _ in range(12)), line + f" x{i}"]
    return texts, planted


def test_near_dedup_is_all_pairs_exactly(spark):
    texts, planted = corpus()
    assert sum(0.8 <= j < 0.95 for j in planted) >= 20 and sum(0.6 < j < 0.8 for j in planted) >= 5
    order = np.random.default_rng(2).permutation(len(texts)).tolist()
    rows = [(i, texts[k], "en", "s", 0) for i, k in enumerate(order)]
    want = [i for i, g in enumerate(brute_components(brute_sets([r[1] for r in rows]))) if g == i]
    rows += [(None, rows[3][1], None, None, None), (None, None, None, None, None), rows[want[-1]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted([rows[i] for i in want] + rows[-3:], key=repr)


def test_roots_of_dense_and_chained_sets():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**62, 100).astype(np.uint64)
    sets = [np.unique(np.append(base[i * 3 : i * 3 + 60], extra)) for i in range(13) for extra in (base[:0], np.uint64(i), rng.integers(0, 2**62, 12).astype(np.uint64))]
    sets += [np.unique(np.concatenate([base[: 100 - k], rng.integers(0, 2**62, k).astype(np.uint64)])) for k in rng.integers(0, 25, 80)]
    want = brute_components([set(x.tolist()) for x in sets])
    got = nearset.roots(sets)
    assert [int(got[i]) for i in range(len(sets))] == want


@pytest.mark.parametrize("largest", [1000, 7])
def test_large_groups_are_cut_without_losing_links(spark, largest):
    """A dense group about one text, chains that hang on to it, and groups of their own that share its first shingles."""
    rng = np.random.default_rng(31)
    word = lambda: f"w{rng.integers(0, 10**6)}"
    base = [word() for _ in range(120)]
    texts = [" ".join(word() if rng.random() < 0.01 else w for w in base) for _ in range(40)]
    drift = list(base)
    for k in range(30):  # each within 4/5 of the one before, far from the first in the end
        drift[119 - 3 * k : 122 - 3 * k] = [word() for _ in range(3)]
        texts.append(" ".join(drift))
    other = base[:10] + [word() for _ in range(110)]
    texts += [" ".join(word() if rng.random() < 0.01 else w for w in other) for _ in range(20)]
    want = brute_components(brute_sets(texts))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in nearset.near_copies(docs, largest).collect()}
    assert [got[i] for i in range(len(texts))] == want and 3 < len(set(want)) < len(texts)
