"""Benchmark decontamination by a prefix-filtered set join, with DataFrame functions only.

An item's windows are its runs of n consecutive words. A window is contained in a document only if
all its words are, so one word is enough as the prefix: its rarest, by how often the documents have
it. Document words join the prefix words; the place of the prefix word in its window fixes where an
occurrence must start (positional bound), it must fit into the document (length bound), and the words
of that window are then compared one by one.

Results for odd input: a null or empty text has no words, is not contaminated and has no windows. An
item of fewer than n words is one window. A document is a pair of doc_id (which may be null) and
text: repeated rows get the same result. Items that share an item_id count once; a null item_id
counts as an item but has no name in the list. Extra columns are ignored; an empty benchmark leaves
all documents clean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedgeline.llm.common import ascii_lower, cut, row_key, text_or_empty, without

#: What separates words: ASCII characters that are neither digits nor letters (A-Z are lower-cased first).
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Tables of at most so many entries (words of windows and ids of items) are broadcast. Larger ones are joined by shuffle.
BROADCAST_ROWS = 400_000


def words(text: str | Column) -> Column:
    return F.filter(F.split(ascii_lower(text_or_empty(text)), GAP, -1), lambda w: w != "")


def item_windows(benchmark: DataFrame, n: int, item_id: str, text: str) -> DataFrame:
    """window (array of words), items (the ids that have it)."""
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), words(text).alias("words")).filter(F.size("words") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - n, F.lit(0)))
    windows = items.select("item", F.explode(F.transform(starts, lambda i: F.slice("words", i + 1, n))).alias("window"))
    # An id of null is kept apart from any text by the struct.
    return windows.groupBy("window").agg(F.collect_set(F.struct("item")).alias("items"))


def prefix_table(docs: DataFrame, benchmark: DataFrame, n: int, item_id: str, text: str, doc_text: str) -> DataFrame:
    """token, offset, window, items: each window under its rarest word, the earliest if several are."""
    windows = cut(item_windows(benchmark, n, item_id, text))
    vocabulary = cut(windows.select(F.explode("window").alias("token")).distinct())
    small = vocabulary.count() <= BROADCAST_ROWS
    tokens = docs.select(F.explode(words(doc_text)).alias("token"))
    found = tokens.join(F.broadcast(vocabulary) if small else vocabulary, "token", "left_semi").groupBy("token").count()
    places = windows.select("window", "items", F.posexplode("window").alias("offset", "token"))
    # found has at most a row for each word of the vocabulary; a word of many windows meets it where it is.
    counted = places.join(F.broadcast(found) if small else found, "token", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    rarest = counted.groupBy("window", "items").agg(F.min(F.struct("count", "offset", "token")).alias("best"))
    # A window with a word that no document has is nowhere.
    return cut(rarest.filter(F.col("best.count") > 0).select(F.col("best.token").alias("token"), F.col("best.offset").alias("offset"), "window", "items"))


def occurrences(
    docs: DataFrame,
    benchmark: DataFrame,
    n: int = 10,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """doc_id, text_hash, start, length, items: every place where an item's window is in a document."""
    prefix = prefix_table(docs, benchmark, n, item_id, item_text, text)
    named = docs.select(F.col(doc_id).alias("doc_id"), row_key(doc_id, text).alias("text_hash"), words(text).alias("words"))
    start = F.col("pos") - F.col("offset")
    entries = prefix.agg(F.coalesce(F.sum(F.size("window") + F.size("items")), F.lit(0))).first()[0]
    if entries <= BROADCAST_ROWS:
        places = named.select("doc_id", "text_hash", "words", F.posexplode("words").alias("pos", "token"))
        near = places.join(F.broadcast(prefix), "token")
        fits = (start >= 0) & (start + F.size("window") <= F.size("words"))
        at = F.slice("words", F.greatest(start, F.lit(0)) + 1, F.size("window"))
    else:
        # Each word takes along only what a window around it can hold.
        low = F.greatest(F.col("pos") - (n - 1), F.lit(0))
        places = named.select("doc_id", "text_hash", "words", F.posexplode("words").alias("pos", "token"))
        places = places.select("doc_id", "text_hash", "pos", "token", low.alias("low"), F.slice("words", low + 1, 2 * n - 1).alias("around"))
        near = places.join(prefix, "token")
        fits = (start >= 0) & (start - F.col("low") + F.size("window") <= F.size("around"))
        at = F.slice("around", F.greatest(start - F.col("low"), F.lit(0)) + 1, F.size("window"))
    return near.filter(fits & (at == F.col("window"))).select("doc_id", "text_hash", start.alias("start"), F.size("window").alias("length"), "items")


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    n: int = 10,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """doc_id, text_hash, n_words, n_hit, n_items, items (sorted array), contaminated for each row of docs."""
    found = occurrences(docs, benchmark, n, doc_id, text, item_id, item_text)
    # Per document the places are sets, so that neither repeats of a row nor of a place add up.
    hit = found.groupBy("doc_id", "text_hash").agg(
        F.collect_set(F.struct("start", "length")).alias("places"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("found_items")
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p["start"], p["start"] + p["length"] - 1)))))
    hit = hit.select(F.col("doc_id").alias("h_id"), F.col("text_hash").alias("h_hash"), covered.cast("long").alias("covered"), "found_items")
    named = docs.select(F.col(doc_id).alias("doc_id"), row_key(doc_id, text).alias("text_hash"), F.size(words(text)).cast("long").alias("n_words"))
    joined = named.join(hit, named["doc_id"].eqNullSafe(hit["h_id"]) & (named["text_hash"] == hit["h_hash"]), "left")
    items = F.coalesce(F.array_sort(F.filter(F.transform("found_items", lambda i: i["item"]), lambda i: i.isNotNull())), F.array().cast("array<string>"))
    n_hit = F.coalesce("covered", F.lit(0))
    return joined.select(
        "doc_id",
        "text_hash",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce(F.size("found_items"), F.lit(0)).cast("long").alias("n_items"),
        items.alias("items"),
        (n_hit > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, n: int = 10, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of docs that hold no window of any item, with the columns of docs."""
    found = occurrences(docs, benchmark, n, doc_id, text, **options)
    dirty = cut(found.select("doc_id", "text_hash").distinct())
    return without(docs, dirty, doc_id, text)
