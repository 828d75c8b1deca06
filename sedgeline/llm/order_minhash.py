"""Document fingerprints by Order MinHash, with DataFrame functions only.

The k-mers of a text are its runs of three units, numbered by occurrence, so that a repeated k-mer counts
as often as it is there. A unit is a word, but of a word of more than LONG code points (text without white
space, such as Chinese, is one) those runs of SPAN code points are units whose hash is divisible by SPAN,
about one in SPAN, wherever they stand; if there are none, the word. That is told word by word, so that an
edit changes the units of the words that it touches, and no others. The k-mers' hashes deal them to bins; in each bin the two minimal ones are taken,
put back into the order they have in the text, and hashed as a tuple. Unlike the minima alone, the
tuples change when passages are moved, as edit distance does. Two fingerprints are as alike as the
share of bins, of those that are filled in either, that hold the same tuple.

Results for odd input: a null text counts as empty, and an empty one has one empty word. Rows without
doc_id come before all others. Rows that share a doc_id follow each other in the order of their
texts. A single row follows itself. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedgeline.llm.common import SPACE, partitions, text_or_empty

BINS = 64
#: Code points beyond which a word is taken by its code points, and how many of them stand for a word.
LONG, SPAN = 24, 5
_BIN_SHIFT = 63 - 6
_HIGH = 0x7FFFFFFF00000000
_LOW = 0xFFFFFFFF
_NO_ID = -(1 << 63)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body with value evaluated once: a lambda's variable isn't expanded as a column would be."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _steps(ordered: Column) -> Column:
    """The powers of two that a search in an array takes, the largest first."""
    top = F.floor(F.log2(F.greatest(F.size(ordered), F.lit(1)))).cast("int")
    return F.transform(F.sequence(top, F.lit(0), F.lit(-1)), lambda i: F.pow(F.lit(2), i).cast("int"))


def _below(ordered: Column, steps: Column, bound: Column) -> Column:
    """How many elements of an ascending array are below bound, by binary search."""
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(ordered, at + step - 1) < bound, at + step).otherwise(at))


def _numbered(ordered: Column, steps: Column) -> Column:
    """For k-mer hashes with their places, in order: hash of (k-mer, occurrence) with the place."""

    def one(x: Column, j: Column) -> Column:
        kmer = F.shiftright(x, 32)
        is_first = ~F.shiftright(F.get(ordered, j - 1), 32).eqNullSafe(kmer)
        is_second = ~F.shiftright(F.get(ordered, j - 2), 32).eqNullSafe(kmer)
        occurrence = F.when(is_first, 0).when(is_second, 1).otherwise(j - _below(ordered, steps, F.shiftleft(kmer, 32)))
        return F.xxhash64(kmer, occurrence).bitwiseAND(F.lit(_HIGH)).bitwiseOR(x.bitwiseAND(F.lit(_LOW)))

    return F.transform(ordered, one)


def _tuples(kmers: Column, minimal: Column, steps: Column) -> Column:
    def one(b: Column) -> Column:
        low = F.shiftleft(b, _BIN_SHIFT)

        def pair(at: Column) -> Column:
            first, second = F.get(minimal, at), F.get(minimal, at + 1)
            place = first.bitwiseAND(F.lit(_LOW)).cast("int")
            other = second.bitwiseAND(F.lit(_LOW)).cast("int")
            inside = [F.coalesce(F.shiftright(x, _BIN_SHIFT) == b, F.lit(False)) for x in (first, second)]
            both = F.xxhash64(F.get(kmers, F.least(place, other)), F.get(kmers, F.greatest(place, other)))
            code = F.when(~inside[0], 0).when(~inside[1], F.xxhash64(F.get(kmers, place))).otherwise(both)
            # 32 bits of the tuple's hash; 0 is kept for an empty bin.
            return F.when(~inside[0], 0).otherwise(F.greatest(code.bitwiseAND(F.lit(_LOW)), F.lit(1)))

        return _let(_below(minimal, steps, low), pair)

    return F.transform(F.sequence(F.lit(0).cast("long"), F.lit(BINS - 1).cast("long")), one)


def signature(text: Column) -> Column:
    """BINS numbers of 32 bits, 0 where a bin is empty."""

    def of_kmers(kmers: Column) -> Column:
        placed = F.transform(kmers, lambda h, i: h.bitwiseAND(F.lit(_HIGH)).bitwiseOR(i.cast("long")))
        return _let(
            F.sort_array(placed),
            lambda ordered: _let(
                _steps(ordered),
                lambda steps: _let(F.sort_array(_numbered(ordered, steps)), lambda minimal: _tuples(kmers, minimal, steps)),
            ),
        )

    def of_words(hashed: Column) -> Column:
        kmers = F.transform(hashed, lambda w, i: F.xxhash64(w, F.get(hashed, i + 1), F.get(hashed, i + 2)))
        return _let(kmers, of_kmers)

    def of_characters(c: Column) -> Column:
        return F.transform(c, lambda x, i: F.xxhash64(x, *[F.get(c, i + k) for k in range(1, SPAN)]))

    def of_word(w: Column) -> Column:
        points = _let(F.filter(F.split(w, "", -1), lambda x: x != ""), of_characters)
        chosen = F.filter(points, lambda h: F.pmod(h, F.lit(SPAN)) == 0)
        whole = F.array(F.xxhash64(w))
        return F.when(F.length(w) > LONG, _let(chosen, lambda c: F.when(F.size(c) > 0, c).otherwise(whole))).otherwise(whole)

    def units(words: Column) -> Column:
        # Without a long word both give the same; most texts need no lists of lists.
        short = F.transform(words, lambda w: F.xxhash64(w))
        return F.when(F.exists(words, lambda w: F.length(w) > LONG), F.flatten(F.transform(words, of_word))).otherwise(short)

    return _let(_let(F.split(text, SPACE, -1), units), of_words)


def as_text(sig: Column) -> Column:
    """Eight hexadecimal digits for each bin."""
    return F.array_join(F.transform(sig, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of the bins filled in either signature that are equal; 1 if none is filled."""
    equal = F.aggregate(F.zip_with(a, b, lambda x, y: F.when((x == y) & (x != 0), 1).otherwise(0)), F.lit(0), lambda n, x: n + x)
    filled = F.aggregate(F.zip_with(a, b, lambda x, y: F.when((x != 0) | (y != 0), 1).otherwise(0)), F.lit(0), lambda n, x: n + x)
    return F.coalesce(F.try_divide(equal.cast("double"), filled.cast("double")), F.lit(1.0))


def with_next(df: DataFrame, key: str, tie: str, columns: list[str]) -> DataFrame:
    """df with next_<column> of the row after it by key, then tie; after the last row comes the first.

    key is cut into ranges (4 per shuffle partition, so the bounds are as few as a range
    partitioning has), and the first rows of each range also go to the end of the one before.
    """
    spark = df.sparkSession
    ranges = 4 * partitions(spark)
    cuts = df.agg(F.percentile_approx(key, [i / ranges for i in range(1, ranges)], 100 * ranges)).first()[0] or []
    bounds = F.array(*[F.lit(x).cast("long") for x in sorted(set(cuts))]) if cuts else F.array().cast("array<bigint>")
    placed = df.withColumn("_range", _below(bounds, _steps(bounds), F.col(key)))
    first = {r["_range"]: r["first"] for r in placed.groupBy("_range").agg(F.min(key).alias("first")).collect()}
    filled = sorted(first)
    before = {r: filled[i - 1] for i, r in enumerate(filled)}
    every = range(max(filled, default=0) + 1)
    firsts = F.array(*[F.lit(first.get(r)).cast("long") for r in every])
    previous = F.array(*[F.lit(before.get(r)).cast("int") for r in every])
    here = F.struct(F.col("_range").alias("at"), F.lit(False).alias("copy"))
    ahead = F.struct(F.get(previous, F.col("_range")).alias("at"), F.lit(True).alias("copy"))
    is_first = F.get(firsts, F.col("_range")) == F.col(key)
    dealt = placed.withColumn("_to", F.explode(F.when(is_first, F.array(here, ahead)).otherwise(F.array(here))))
    order = Window.partitionBy("_to.at").orderBy("_to.copy", key, tie)
    ahead_of = F.lead(F.struct(*columns)).over(order)
    found = dealt.withColumn("_next", ahead_of).filter(~F.col("_to.copy"))
    return found.select(*df.columns, *[F.col(f"_next.{c}").alias(f"next_{c}") for c in columns])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited, signature, edited_signature, next_signature for each row of docs.

    edited: the text whose last half is replaced by the first half as many code points of the next one.
    """
    base = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(doc_id), F.lit(_NO_ID)).cast("long").alias("_key"), text_or_empty(text).alias("text"))
    signed = base.withColumn("signature", signature(F.col("text")))
    pairs = with_next(signed, "_key", "text", ["text", "signature"])
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half))
    pairs = pairs.select("doc_id", F.length("text").cast("long").alias("n_chars"), edited.alias("edited"), "signature", "next_signature")
    return pairs.withColumn("edited_signature", signature(F.col("edited")))
