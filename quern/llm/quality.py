"""Quality rules with adaptive thresholds from mergeable quantile sketches (operator 2).

Each document gets whole-text counts and rates. A sketch for each language and source holds, for each rate,
how many documents fall in each bucket of a log-linear scale (32 buckets for each power of two, so a
quantile is known to 1/32). Sketches merge by adding counts, so they come from a plain partial
aggregation over the documents that pass the base rule. A group's sketch is taken together with PRIOR documents
spread like its language's, and a language's with PRIOR spread like all, so the fewer documents a group has the
more its language counts, at any size of the input; weights are whole numbers of 1 / UNIT documents.

Fences come from the group's quantiles alone: they lie outside the first quartile and the rate's upper quantile
by a multiple of the range between them. A group without spread in a rate has fences at the edges of the one
bucket that holds its quartile and upper quantile. Documents join their group's fences and pass if all rates lie inside.

Null or empty text: zero counts, which fails the base rule. Null language or source: a group like any other.
Repeated rows count each. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import column_bytes, stored

SYMBOLS = b"#*$%&|<>"
MIN_WORDS, MAX_REPEATED = 50, 50  # base rule: words, per cent of words in repeated windows
RATES = {"word_length": (75, 5), "symbols": (75, 3), "dup_lines": (98, 2), "repeats": (95, 3)}
"""Rates per 10,000 words (dup_lines: lines; word_length: thousandths of a character): per cent of the documents at
most at the upper quantile, and how many times the range from the first quartile to it the fences lie outside both."""
PRIOR, UNIT = 20, 1 << 20

_COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
_LINES = "n_lines long"


def counts(text: bytes) -> tuple[int, int, int, int, int, int]:
    words = text.split()
    n = len(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeated = 0
    if n >= 4:
        known: dict[bytes, int] = {}
        ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
        pairs = np.unique(ids[:-1] * len(known) + ids[1:], return_inverse=True)[1].astype(np.int64)
        windows = pairs[:-1] * len(known) + ids[2:]
        _, which, times = np.unique(windows, return_inverse=True, return_counts=True)
        at = np.flatnonzero(times[which] > 1)
        hit = np.zeros(n, bool)
        for j in range(3):
            hit[at + j] = True
        repeated = int(hit.sum())
    return n, len(b"".join(words).decode()), len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated, len(lines)


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the whole-text counts."""

    def run(batches):
        for batch in batches:
            rows = [counts(t) for t in column_bytes(batch["text"])]
            found = np.array(rows, np.int64).reshape(-1, 6)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["lang"], batch["source"], *(pa.array(found[:, i]) for i in range(6))], names)

    schema = f"doc_id long, lang string, source string, {_COUNTS}, {_LINES}"
    names = [x.split()[0] for x in schema.split(", ")]
    columns = ("cast(doc_id as long) doc_id", "cast(lang as string) lang", "cast(source as string) source", "cast(text as string) text")
    return docs.selectExpr(*columns).mapInArrow(run, schema)


def rates(measured: DataFrame) -> dict[str, Column]:
    """The rates whose counts are there."""
    per = lambda x, m, of="n_words": F.when(F.col(of) > 0, F.floor(F.col(x) * m / F.col(of)).cast("long"))
    found = {"word_length": per("word_chars", 1000), "symbols": per("n_symbols", 10000), "repeats": per("n_repeat_words", 10000)}
    return found | ({"dup_lines": per("n_dup_lines", 10000, "n_lines")} if "n_lines" in measured.columns else {})


def base_failed(min_words: int = MIN_WORDS, max_repeated: int = MAX_REPEATED) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeated * F.col("n_words"))


def _low(x: Column) -> Column:
    """How many low bits of x its bucket leaves open."""
    return F.greatest(F.length(F.bin(x)) - 6, F.lit(0))


def bucket(x: Column) -> Column:
    """The least value of x's bucket: x with all but its six highest bits cleared."""
    return F.call_function("shiftleft", F.call_function("shiftright", x, _low(x)), _low(x))


def top(x: Column) -> Column:
    """The largest value of x's bucket."""
    return bucket(x) + F.call_function("shiftleft", F.lit(1).cast("long"), _low(x)) - 1


def sketch(measured: DataFrame) -> DataFrame:
    """(lang, source, rate, value, n): mergeable, at most a few hundred rows for each group and rate."""
    each = F.array(*(F.struct(F.lit(k).alias("rate"), bucket(v).alias("value")) for k, v in rates(measured).items()))
    rows = measured.filter("n_words > 0").select("lang", "source", F.explode(each).alias("r"))
    return rows.groupBy("lang", "source", "r.rate", "r.value").agg(F.count("*").alias("n"))


def shrunk(sketches: DataFrame, keys: list[str], towards: DataFrame | None = None, prior: int = PRIOR) -> DataFrame:
    """(keys, rate, value, weight, up, all): cumulative weights, in units, of the sketches merged by keys, with the prior's.

    towards: such a table for the first of the keys, or for none of them.
    """
    counts = sketches.select(*keys, "rate", "value", (F.col("n") * UNIT).alias("weight"))
    if towards is not None:
        outer = [k for k in keys if k in towards.columns]
        groups = sketches.select(*keys, "rate").distinct()
        given = F.expr(f"cast(weight as decimal(38, 0)) * {prior * UNIT} div all")
        share = towards.select(*(F.col(k).alias(f"__{k}") for k in outer), F.col("rate").alias("__rate"), "value", given.alias("weight"))
        same = F.col("rate") == F.col("__rate")
        for k in outer:
            same &= F.col(k).eqNullSafe(F.col(f"__{k}"))
        counts = counts.unionByName(groups.join(share, same).select(*keys, "rate", "value", "weight"))
    merged = counts.groupBy(*keys, "rate", "value").agg(F.sum("weight").alias("weight"))
    each = Window.partitionBy(*keys, "rate").orderBy("value")
    whole = each.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return merged.withColumns({"up": F.sum("weight").over(each), "all": F.sum("weight").over(whole)})


def of_rate(i: int) -> Column:
    return F.create_map(*(F.lit(x) for k, v in RATES.items() for x in (k, v[i])))[F.col("rate")]


def thresholds(sketches: DataFrame, prior: int = PRIOR) -> DataFrame:
    """(lang, source, rate) -> low, high; see RATES."""
    lang = shrunk(sketches, ["lang"], shrunk(sketches, []), prior)
    at = lambda per_cent: F.min(F.when(F.col("up") * 100 >= F.col("all") * per_cent, F.col("value")))
    found = shrunk(sketches, ["lang", "source"], lang, prior).groupBy("lang", "source", "rate").agg(at(25).alias("q1"), at(of_rate(0)).alias("upper"))
    width = of_rate(1) * (F.col("upper") - F.col("q1"))
    return found.select("lang", "source", "rate", (F.col("q1") - width).alias("low"), (top(F.col("upper")) + width).alias("high"))


def apply_rules(docs: DataFrame, prior: int = PRIOR, min_words: int = MIN_WORDS, max_repeated: int = MAX_REPEATED) -> DataFrame:
    """doc_id, lang, source, the counts, base_failed, kept, and failed (the rates outside their fences)."""
    measured = stored(measure(docs))
    base = base_failed(min_words, max_repeated)
    limits = thresholds(stored(sketch(measured.filter(~base))), prior).groupBy("lang", "source").agg(
        *(F.max(F.when(F.col("rate") == k, F.struct("low", "high"))).alias(f"__{k}") for k in RATES)
    ).withColumnsRenamed({"lang": "__lang", "source": "__source"})
    joined = measured.join(limits, F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source")), "left")
    failed = F.array_compact(F.array(*(F.when(~v.between(F.col(f"__{k}.low"), F.col(f"__{k}.high")), F.lit(k)) for k, v in rates(measured).items())))
    out = joined.select(*measured.columns, base.alias("base_failed"), failed.alias("failed"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))
