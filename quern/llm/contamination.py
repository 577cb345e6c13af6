"""Benchmark decontamination with a positional inverted index (operator 3), with DataFrame functions only.

Index: one posting (term, document, position) for each corpus word that is a benchmark term, stored as a
table. Search: corpus counts from the index rank each window's terms; the two rarest are its anchors. The
postings of the anchors, less the anchor's offset, give alignments (item, document, start); an alignment
that two anchors share can hold a window, since a window brings both of its own. What is left is compared
word by word with the postings of the documents concerned, which gives exact phrase matches: no text is read
again, and no group of postings is collected. Proximity matches are documents that hold most of an item's
RAREST rarest terms (all terms of a shorter item) within twice the item's length, in any order.

The benchmark's terms and anchors, and the documents with alignments, are broadcast only if counted below
BROADCAST_ROWS, else joined by a shuffle. Terms, documents and items are told apart by 64-bit hashes (of the word, of id
and text), so repeated ids do no harm. Null or empty text: no words. An item with a null id is not searched for. Repeated
rows each get the result. An empty table gives no rows, an empty benchmark no matches. The documents' own columns
travel under numbers, so no name of theirs can clash.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import stored

WINDOW, BROADCAST_ROWS, NEAR, RAREST = 10, 100_000, 0.6, 8
RESULTS = ("n_words", "n_hit", "item_ids", "n_near", "near_ids", "contaminated")


def words(text: str | Column) -> Column:
    lowered = F.translate(F.col(text) if isinstance(text, str) else text, string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(F.coalesce(lowered, F.lit("")), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def _small(df: DataFrame) -> DataFrame:
    """A stored table, marked for broadcast only if it has been counted as small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def items_of(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item, item_id, item_words, length): length is the window's, shorter for items of fewer words."""
    found = benchmark.filter("item_id is not null").select(F.xxhash64("item_id", "text").alias("item"), F.col("item_id").cast("string").alias("item_id"), words("text").alias("item_words"))
    return found.filter(F.size("item_words") > 0).withColumn("length", F.least(F.size("item_words"), F.lit(window))).dropDuplicates(["item"])


def build_index(docs: DataFrame, terms: DataFrame, path: str | None = None) -> DataFrame:
    """The postings (term, doc, pos) of the given terms, stored; terms and documents are 64-bit hashes."""
    each = docs.select(F.xxhash64("doc_id", "text").alias("doc"), F.posexplode(words("text")).alias("pos", "word"))
    return stored(each.select(F.xxhash64("word").alias("term"), "doc", "pos").join(terms, "term", "left_semi"), path)


def anchors_of(items: DataFrame, index: DataFrame) -> DataFrame:
    """(term, item, offset, need): the two rarest terms of each window that can occur."""
    start = F.explode(F.sequence(F.lit(0), F.size("item_words") - F.col("length"))).alias("start")
    each = items.select("item", "item_words", "length", start).select("item", "start", "length", F.posexplode(F.slice("item_words", F.col("start") + 1, F.col("length"))).alias("i", "word"))
    counts = index.groupBy("term").agg(F.count("*").alias("n"))
    ranked = each.withColumn("term", F.xxhash64("word")).join(counts, "term")
    window = Window.partitionBy("item", "start")
    ranked = ranked.withColumns({"rank": F.row_number().over(window.orderBy("n", "i")), "present": F.count("*").over(window)})
    return ranked.filter("rank <= 2 and present = length").select("term", "item", (F.col("start") + F.col("i")).alias("offset"), F.least("length", F.lit(2)).alias("need")).distinct()


def rarest_of(items: DataFrame, index: DataFrame, near: float) -> DataFrame:
    """(term, item, number, n_terms, span): the rarest terms of each item that can occur, if enough of its terms can."""
    each = items.select("item", (2 * F.size("item_words")).alias("span"), F.size(F.array_distinct("item_words")).alias("size"), F.explode(F.array_distinct("item_words")).alias("word"))
    counts = index.groupBy("term").agg(F.count("*").alias("n"))
    own = Window.partitionBy("item")
    ranked = each.withColumn("term", F.xxhash64("word")).join(counts, "term").withColumns({"number": F.row_number().over(own.orderBy("n", "word")) - 1, "present": F.count("*").over(own)})
    chosen = ranked.filter((F.col("number") < RAREST) & (F.col("present") >= F.ceil(F.col("size") * near)))
    return chosen.select("term", "item", "number", F.least("present", F.lit(RAREST)).alias("n_terms"), "span")


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, near: float = NEAR) -> DataFrame:
    """The columns of docs, then RESULTS (item_ids and near_ids sorted), which replace columns of these names."""
    own = [F.col(f"__c{i}").alias(c) for i, c in enumerate(docs.columns) if c.lower() not in RESULTS]
    return _search(docs, benchmark, window, near).select(*own, *RESULTS)


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, near: float = NEAR) -> DataFrame:
    """The documents that hold no benchmark window, with exactly their own columns."""
    own = [F.col(f"__c{i}").alias(c) for i, c in enumerate(docs.columns)]
    return _search(docs, benchmark, window, near).filter("not contaminated").select(*own)


def _aligned(items: DataFrame, index: DataFrame) -> DataFrame:
    """(item, doc, delta): where an item, begun at place delta of a document, can have a window."""
    anchors = stored(anchors_of(items, index))
    hits = index.join(_small(anchors), "term").select("item", "doc", (F.col("pos") - F.col("offset")).alias("delta"), "need")
    found = hits.groupBy("item", "doc", "delta").agg(F.count("*").alias("n"), F.max("need").alias("need"))
    return stored(found.filter("n >= need").select("item", "doc", "delta"))


def windows_of(items: DataFrame, index: DataFrame) -> DataFrame:
    """(doc, item_id, place, length): the places in documents where a window of an item occurs."""
    aligned = _aligned(items, index)
    postings = index.join(_small(aligned.select("doc").distinct()), "doc", "left_semi")
    own = items.select("item", "item_id", "length", F.size("item_words").alias("size"), F.posexplode("item_words").alias("offset", "word"))
    wanted = aligned.join(own.withColumn("term", F.xxhash64("word")).drop("word"), "item").withColumn("pos", F.col("delta") + F.col("offset"))
    same = wanted.join(postings, ["doc", "pos", "term"]).distinct()
    first, last = F.greatest(F.col("offset") - F.col("length") + 1, F.lit(0)), F.least(F.col("offset"), F.col("size") - F.col("length"))
    each = same.withColumn("start", F.explode(F.sequence(first, last)))
    whole = each.groupBy("doc", "item", "item_id", "delta", "length", "start").agg(F.count("*").alias("n")).filter("n = length")
    return whole.select("doc", "item_id", (F.col("delta") + F.col("start")).alias("place"), "length")


def near_of(items: DataFrame, index: DataFrame, near: float) -> DataFrame:
    """(doc, item_id): documents that hold most of an item's rarest terms close together."""
    rarest = stored(rarest_of(items, index, near))
    half = F.floor(2 * F.col("pos") / F.col("span"))
    spans = index.join(_small(rarest), "term").withColumn("place", F.explode(F.array(half, half - 1)))
    close = spans.groupBy("item", "doc", "place").agg(F.expr("bit_count(bit_or(shiftleft(1L, cast(number as int))))").alias("n"), F.max("n_terms").alias("of"))
    return close.filter(F.col("n") >= F.ceil(F.col("of") * near)).select("item", "doc").distinct().join(items.select("item", "item_id"), "item").select("doc", "item_id")


def _search(docs: DataFrame, benchmark: DataFrame, window: int, near: float) -> DataFrame:
    """The columns of docs as __c0, __c1 and so on, and RESULTS."""
    place = {c: F.col(f"__c{i}") for i, c in enumerate(docs.columns)}
    numbered = docs.toDF(*(f"__c{i}" for i in range(len(docs.columns)))).withColumns({"__doc": F.xxhash64(place["doc_id"], place["text"]), "n_words": F.size(words(place["text"])).cast("long")})
    items = stored(items_of(benchmark, window))
    terms = stored(items.select(F.explode("item_words").alias("word")).select(F.xxhash64("word").alias("term")).distinct())
    index = build_index(docs, _small(terms))
    windows = stored(windows_of(items, index))
    hit = windows.select("doc", F.explode(F.sequence("place", F.col("place") + F.col("length") - 1)).alias("pos")).distinct().groupBy("doc").agg(F.count("*").alias("n_hit"))
    ids = windows.select("doc", "item_id", F.lit(True).alias("exact")).distinct().unionByName(near_of(items, index, near).distinct().withColumn("exact", F.lit(False)))
    named = ids.groupBy("doc").agg(*(F.sort_array(F.collect_list(F.when(F.col("exact") == e, F.col("item_id")))).alias(c) for e, c in ((True, "item_ids"), (False, "near_ids"))))
    found = stored(named.join(hit, "doc", "left")).withColumnRenamed("doc", "__doc")
    none = F.expr("array()").cast("array<string>")
    out = numbered.join(found, "__doc", "left").withColumns({"n_hit": F.coalesce("n_hit", F.lit(0).cast("long")), "item_ids": F.coalesce("item_ids", none), "near_ids": F.coalesce("near_ids", none)})
    return out.withColumns({"n_near": F.size("near_ids").cast("long"), "contaminated": F.col("n_hit") > 0}).drop("__doc")
