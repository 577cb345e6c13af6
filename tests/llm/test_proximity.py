"""Proximity matches of operator 3 for items of one window and for items with words the corpus lacks."""

from quern.llm import contamination


def test_shuffled_short_item_and_item_with_absent_words(spark):
    short = "kappa lima mike november oscar papa"
    long = " ".join(f"word{i}" for i in range(30))
    docs = [(1, "some text before papa mike kappa oscar november lima and after"), (2, "kappa and nothing else of it " * 4), (3, "x y " + " ".join(f"word{i}" for i in reversed(range(30)) if i % 7)), (4, "")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(1, short), (2, long)], "item_id long, text string")
    got = {r.doc_id: (r.near_ids, r.contaminated) for r in contamination.find(frame, bench).collect()}
    assert got == {1: (["1"], False), 2: ([], False), 3: (["2"], False), 4: ([], False)}
