"""The adaptive fences of operator 2: each rule rejects planted outliers that the base rule passes."""

import numpy as np

from quern.llm import quality

SCHEMA = "doc_id long, text string, lang string, source string"


def documents():
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("abcdefghij"), rng.integers(3, 8)))
    line = lambda n=12: " ".join(word() for _ in range(n))
    rows = [(i, "\n".join(line() for _ in range(20)), "en", f"s{i % 2}") for i in range(600)]
    odd = {
        "word_length": "\n".join(" ".join(word() + "xy" for _ in range(12)) for _ in range(20)),
        "symbols": "\n".join(line() + (" # $" if k % 2 else "") for k in range(20)),
        "dup_lines": "\n".join(["so it goes"] * 6 + [line() for _ in range(14)]),
        "repeats": "\n".join([line() + " the same four words"] * 1 + [line() + " the same four words" for _ in range(9)] + [line() for _ in range(10)]),
    }
    return rows, [(1000 + i, t, "en", "s0") for i, t in enumerate(odd.values())], list(odd)


def test_each_rule_rejects_what_the_base_rule_passes(spark):
    rows, planted, names = documents()
    out = {r.doc_id: r for r in quality.apply_rules(spark.createDataFrame(rows + planted, SCHEMA)).collect()}
    assert not any(r.base_failed for r in out.values())
    for (i, *_), name in zip(planted, names):
        assert name in out[i].failed and not out[i].kept, (name, out[i])
    assert sum(out[r[0]].kept for r in rows) >= 0.99 * len(rows)


def test_width_follows_the_spread_of_the_group(spark):
    measured = [(i, "en", "narrow", 1000, 5000 + i % 10, 0, 0, i % 5) for i in range(300)] + [(1000 + i, "en", "wide", 1000, 4000 + 5 * (i % 300), 0, 0, i % 200) for i in range(300)]
    frame = spark.createDataFrame(measured, f"doc_id long, lang string, source string, {quality._COUNTS}")
    width = {(r.source, r.rate): r.high - r.low for r in quality.thresholds(quality.sketch(frame)).collect()}
    assert width["wide", "word_length"] > 4 * width["narrow", "word_length"]
    assert width["wide", "repeats"] > 4 * width["narrow", "repeats"]


def test_thresholds_do_not_jump_with_the_size_of_a_group(spark):
    def high(n):
        rows = [(i, "en", "small", 1000, 4500 + i * 100 // n, 0, 0, 0) for i in range(n)] + [(1000 + i, "en", "large", 1000, 6000 + i % 100, 0, 0, 0) for i in range(2000)]
        frame = spark.createDataFrame(rows, f"doc_id long, lang string, source string, {quality._COUNTS}")
        return {(r.source, r.rate): r.low for r in quality.thresholds(quality.sketch(frame)).collect()}["small", "word_length"]

    below, above = high(199), high(200)
    assert abs(below - above) < 0.05 * abs(above)
