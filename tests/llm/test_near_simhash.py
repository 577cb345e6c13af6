"""The SimHash step of the pipeline's near-dedup stage: its links are true and most of them, and the rest is compared only where needed."""

from test_near_dedup import brute_components, brute_sets, corpus

from quern.llm import nearset


def test_simhash_alone_finds_most_links_and_no_others(spark, monkeypatch):
    monkeypatch.setattr(nearset, "not_joined", lambda coarse, linked: coarse.filter("false"))  # without the rest
    texts, _ = corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in nearset.near_copies(docs).collect()}
    want = brute_components(brute_sets(texts))
    assert all(want[g] == want[i] for i, g in got.items())
    words = [i for i, w in enumerate(want) if texts[i] and len(texts[i].split()) > 5]
    assert sum(got[i] != i for i in words) >= 0.7 * sum(want[i] != i for i in words) > 0


def test_only_components_that_are_not_one_group_go_on(spark):
    coarse = spark.createDataFrame([(n, c) for c, nodes in ((1, (1, 2, 3)), (4, (4, 5)), (6, (6, 7, 8))) for n in nodes], "node long, coarse long")
    linked = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (6, 6), (7, 6)], "node long, root long")
    assert sorted(map(tuple, nearset.not_joined(coarse, linked).collect())) == [(4, 4), (5, 4), (6, 6), (7, 6), (8, 6)]


def test_radius_narrows_before_random_fingerprints_chain():
    found = [nearset.widest(10**k) for k in range(12)]
    assert found[0] == nearset.RADIUS and found == sorted(found, reverse=True) and min(found) >= 4 and nearset.widest(10**7) == 10
