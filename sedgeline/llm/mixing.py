"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target in words. A document's expected number of copies is proportional to its weight
(by default the binary digits of its size, so that longer documents are somewhat likelier; or a column),
up to a cap, at the level at which the source's expected words are its target. The whole part of that
number is taken for certain; the rest is the document's inclusion probability in a sample without
replacement of a fixed size in words: documents are ranked by the odds of their random number over the
odds of their inclusion, and taken in that order up to what the certain copies leave of the target.

Results for odd input: a null text has size 0 and a null source is a source of its own, after all
others. Documents of size 0 are taken as their rank says. Documents without id draw by their text.
Repeated rows are separate documents that tie; of ties at the end as many are taken as the target asks
for. A null or negative weight is 0. Extra columns are kept by apply_mix, whatever they are called, and
ignored by mix. An empty table, or one without any word, gives targets of 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedgeline.llm.common import WORD, compact, cut, fresh, text_or_empty

#: Words of a source are counted in so many bins of the rank at a time; only the bin in which the target falls is looked into.
BINS = 4096
#: A table of one row for each source is broadcast up to so many rows, and joined by shuffle beyond.
BROADCAST_SOURCES = 10_000


def source_targets(sizes: DataFrame, weights: Sequence[float], budget: float, cap: float) -> DataFrame:
    """source, source_size, target: the budget shared by weight, none above cap times its source.

    One row per source goes through the windows, in one task; the rows of documents are summed before.
    Resharing what caps cut off, until none is above, ends at one level (words per weight): with
    sources in order of cap per weight, one is capped if the level that is left would exceed its cap.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    weighed = per_source.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(cap)))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    level = (
        weighed.withColumn("total", F.sum("source_size").over(everything) * F.lit(float(budget)))
        .withColumn("before", F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("rest", F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("before")) / F.col("rest"))
        .withColumn("capped", F.col("level") * F.col("weight") >= F.col("cap"))
    )
    common = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(everything)
    return level.select(
        "source",
        "source_size",
        F.when(F.col("capped"), F.col("cap")).otherwise(common["level"] * F.col("weight")).alias("target"),
    )


def _measured(docs: DataFrame, name: str, seed: str, doc_id: str, text: str, weight: str | None) -> DataFrame:
    """docs with the struct name: size (words), weight, draw (32 hexadecimal digits from the id; without an id, from the text)."""
    size = F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")
    digits = F.col(weight).cast("double") if weight else None
    key = F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("text:"), F.md5(text_or_empty(text))))
    draw = F.md5(F.concat(F.lit(f"{seed}:"), key))

    def about(s: Column) -> Column:
        own = F.coalesce(F.greatest(digits, F.lit(0.0)), F.lit(0.0)) if weight else F.length(F.bin(s)).cast("double")
        return F.struct(s.alias("size"), own.alias("weight"), draw.alias("draw"))

    # A lambda's variable, so that words are counted once.
    return docs.withColumn(name, F.get(F.transform(F.array(size), about), F.lit(0)))


def _attach(rows: DataFrame, source: str, per_source: DataFrame, name: str) -> DataFrame:
    """rows with the struct name: what per_source (cut) has of their source. Few sources are broadcast."""
    side = per_source.select(F.struct("*").alias(name))
    return rows.join(F.broadcast(side) if per_source.count() <= BROADCAST_SOURCES else side, F.col(source).eqNullSafe(F.col(f"{name}.source")), "left")


def _levels(sums: DataFrame, targets: DataFrame, cap: float) -> DataFrame:
    """source, source_size, target, level, wanted. A document's expected copies are level * weight, cap at most (level null: all are at cap).

    sums: source, weight, words: a row for each weight. The heaviest documents reach the cap first; the level is
    that of the heaviest weight below it. wanted: the words that whole copies leave to the sample.
    """
    down = Window.partitionBy("source").orderBy(F.col("weight").desc())
    above = F.coalesce(F.sum(F.col("words") * cap).over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum(F.col("words") * F.col("weight")).over(down.rowsBetween(0, Window.unboundedFollowing))
    joined = sums.join(targets.withColumnRenamed("source", "t_source"), F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source")
    tried = joined.withColumn("try", F.try_divide(F.col("target") - above, rest))
    below = F.max(F.when(F.col("try") * F.col("weight") < cap, F.struct("weight", "try"))).over(Window.partitionBy("source"))
    level = tried.withColumn("level", below["try"])
    whole = F.floor(F.coalesce(F.least(F.col("level") * F.col("weight"), F.lit(cap)), F.lit(cap)))
    found = level.groupBy("source", "source_size", "target", "level").agg(F.sum(whole * F.col("words")).alias("certain"))
    return found.withColumn("wanted", F.greatest(F.round(F.col("target") - F.col("certain"), 3), F.lit(0.0))).drop("certain")


def _ranked(rows: DataFrame, m: str, p: str, name: str, cap: float) -> DataFrame:
    """rows with the struct name: whole (certain copies) and rank (in (0, 1), rising with the Pareto quotient; null: not sampled)."""
    expected = F.coalesce(F.least(F.col(f"{p}.level") * F.col(f"{m}.weight"), F.lit(cap)), F.lit(cap))
    u = (F.conv(F.substring(f"{m}.draw", 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)

    def rank(share: Column) -> Column:
        quotient = u / (1 - u) / (share / (1 - share))
        return F.when((share > 0) & (share < 1), quotient / (1 + quotient))

    def both(e: Column) -> Column:
        return F.struct(F.floor(e).alias("whole"), rank(e - F.floor(e)).alias("rank"))

    return rows.withColumn(name, F.get(F.transform(F.array(expected), both), F.lit(0)))


def _edge(rows: DataFrame, bins: int) -> DataFrame:
    """Of rows (source, wanted, rank, draw, size, before: words of lower bins), those of the first bin of each source
    whose end is beyond wanted, with its words before and its lower bound (low)."""
    binned = rows.withColumn("bin", F.floor(F.col("rank") * bins))
    up = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    sums = binned.groupBy("source", "wanted", "before", "bin").agg(F.sum("size").alias("words")).withColumn("end", F.col("before") + F.sum("words").over(up))
    first = F.min(F.when(F.col("end") > F.col("wanted"), F.struct("bin", (F.col("end") - F.col("words")).alias("start")))).alias("first")
    edge = cut(sums.groupBy("source").agg(first).filter("first is not null").select("source", "first.*"))
    found = _attach(binned.drop("before"), "source", edge, "e").filter(F.col("bin") == F.col("e.bin"))
    return found.select("source", "wanted", "rank", "draw", "size", F.col("e.start").alias("before"), (F.col("bin") / bins).alias("low"))


def _cuts(sizes: DataFrame, levels: DataFrame, cap: float) -> DataFrame:
    """levels with low, last, ties, taken_ties: of a source's sampled documents those are taken whose rank is under
    low, or whose (rank, draw, size) is under last; of the ties that equal last, taken_ties.

    Words are summed in bins of the rank, then in bins of the one that holds the wanted number, and only
    documents of one bin of those (one in BINS * BINS of a source) are put in order.
    """
    ranked = _ranked(_attach(sizes, "source", levels, "p"), "m", "p", "r", cap).filter("r.rank is not null")
    rest = ranked.select("source", F.col("p.wanted").alias("wanted"), "r.rank", "m.draw", "m.size", F.lit(0).cast("long").alias("before"))
    for bins in (BINS, BINS * BINS):
        rest = _edge(rest, bins)
    order = Window.partitionBy("source").orderBy("rank", "draw", "size").rowsBetween(Window.unboundedPreceding, 0)
    put = rest.withColumn("start", F.col("before") + F.sum("size").over(order) - F.col("size"))
    put = put.select("source", "low", F.struct("rank", "draw", "size").alias("place"), (F.col("start") + F.col("size") / 2 <= F.col("wanted")).alias("taken"))
    by_place = put.groupBy("source", "low", "place").agg(F.count(F.lit(1)).alias("ties"), F.count_if("taken").alias("taken_ties"))
    last = F.max(F.when(F.col("taken_ties") > 0, F.struct("place", "ties", "taken_ties"))).alias("last")
    edges = by_place.groupBy("source").agg(F.min("low").alias("low"), last).withColumnRenamed("source", "e_source")
    joined = levels.join(edges, F.col("source").eqNullSafe(F.col("e_source")), "left")
    # Without an edge all sampled documents are taken: ranks are under 1.
    counts = [F.coalesce(f"last.{c}", F.lit(0)).alias(c) for c in ("ties", "taken_ties")]
    return joined.select(*levels.columns, F.coalesce("low", F.lit(2.0)).alias("low"), F.col("last.place").alias("last"), *counts)


def _with_copies(rows: DataFrame, source: str, plan: DataFrame, m: str, p: str, copies: str, cap: float) -> DataFrame:
    """rows with p (what plan has of their source) and copies."""
    r, tie, number = fresh(rows, "rank", "tie", "number")
    ranked = _ranked(_attach(rows, source, plan, p), m, p, r, cap)
    place = F.struct(F.col(f"{r}.rank").alias("rank"), F.col(f"{m}.draw").alias("draw"), F.col(f"{m}.size").alias("size"))
    rank, last = F.col(f"{r}.rank"), F.col(f"{p}.last")
    under = rank.isNotNull() & ((rank < F.col(f"{p}.low")) | F.coalesce(place <= last, F.lit(False)))
    whole = F.col(f"{r}.whole")
    if plan.filter("taken_ties < ties").isEmpty():
        return ranked.withColumn(copies, whole + under.cast("long")).drop(r)
    # Repeated rows at a source's end, of which some are taken: those alone are numbered.
    marked = ranked.withColumn(tie, F.coalesce(rank.isNotNull() & (place == last) & (F.col(f"{p}.taken_ties") < F.col(f"{p}.ties")), F.lit(False)))
    clear = marked.filter(~F.col(tie)).withColumn(copies, whole + under.cast("long"))
    order = Window.partitionBy(source, f"{m}.draw").orderBy(F.lit(0))
    tied = marked.filter(F.col(tie)).withColumn(number, F.row_number().over(order))
    tied = tied.withColumn(copies, whole + (F.col(number) <= F.col(f"{p}.taken_ties")).cast("long")).drop(number)
    return clear.unionByName(tied).drop(r, tie)


def _plan(sizes: DataFrame, weights: Sequence[float], budget: float, cap: float) -> DataFrame:
    """One row for each source; cut. sizes: source and m."""
    flat = sizes.select("source", "m.size", "m.weight")
    sums = cut(flat.groupBy("source", "weight").agg(F.sum("size").alias("words")))
    targets = source_targets(sums.withColumnRenamed("words", "size"), weights, budget, cap)
    levels, _ = compact(_levels(sums, targets, float(cap)))
    return compact(_cuts(sizes, levels, float(cap)))[0]


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (3, 1, 2),
    budget: float = 1.5,
    cap: float = 2.0,
    seed: str = "mix",
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weight: str | None = None,
) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken for each row of docs.

    weights: of sources, in order of their names, repeating; weight: the column of the documents' own
    weights, of few different values. A source's taken words differ from its target by half a document at
    most, if every weight in it is above 0.
    """
    measured = _measured(docs, (m := fresh(docs, "measure")[0]), seed, doc_id, text, weight)
    sizes = cut(measured.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.col(m).alias("m")))
    found = _with_copies(sizes, "source", _plan(sizes, weights, budget, cap), "m", "p", "copies", float(cap))
    taken = (F.col("copies") * F.col("m.size")).alias("taken")
    return found.select("doc_id", "m.size", "p.source_size", "p.target", "copies", taken)


def apply_mix(
    docs: DataFrame,
    weights: Sequence[float] = (3, 1, 2),
    budget: float = 1.5,
    cap: float = 2.0,
    seed: str = "mix",
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weight: str | None = None,
) -> DataFrame:
    """The mix itself: each row of docs as many times as mix takes it, with the columns of docs. Texts aren't shuffled."""
    m, p, copies, copy = fresh(docs, "measure", "plan", "copies", "copy")
    measured = _measured(docs, m, seed, doc_id, text, weight)
    plan = _plan(cut(measured.select(F.col(source).alias("source"), F.col(m).alias("m"))), weights, budget, cap)
    found = _with_copies(measured, source, plan, m, p, copies, float(cap)).filter(F.col(copies) > 0)
    return found.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).drop(m, p, copies, copy)
