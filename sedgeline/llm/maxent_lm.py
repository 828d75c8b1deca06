"""LM scoring with a hashed maximum-entropy model.

Tokens are words (A-Z lower-cased) and one end per text. The HEAD most frequent tokens are dealt to
classes by rank, all others by what they end in (their last byte). A token's probability is that of its
class, a softmax over features of its history (the word before, the two before, the second before: a
skip), times that within the class: again a softmax over hashed features (the word before, with the
class) for classes of the head, and add-one frequencies in the class for the rest, which leave one place
for words that training hasn't seen.

Weights are learnt from all training texts: a hash of each deals it to a round and a share of it, of about
SHARE_TOKENS tokens; steps are taken on each share, in the order of the hashes, from the common weights, and
its changes are summed per feature row, weighted by use, with a plain aggregation. So weights are a function
of the table alone (but for the last digits of sums), however its rows are partitioned.
They have a fixed size. Counts of all tokens are kept as a table: frequent tokens (over one in
2^20: under 2^20 of them) are broadcast, all others joined, none of which can be hot.

Results for odd input: a null text is empty and has its end only. A null doc_id is learnt from; a
document is a pair of doc_id and text, and repeated rows get the same result. Without training texts
the score is the base score. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedgeline.llm.blocks import ASCII_LOWER, hashes, slices, words
from sedgeline.llm.common import cut, row_key, same

CLASSES, PER_CLASS = 32, 32
HEAD = CLASSES * PER_CLASS
CLASS_ROWS = WORD_ROWS = 1 << 14
#: Classes of the tokens outside the head.
ENDINGS = 32
WIDTH = CLASSES + ENDINGS
#: A token is frequent if more than one in so many tokens is it.
FREQUENT = 1 << 20
ROUNDS = 2
#: Tokens of a share, about: what a share returns doesn't depend on how many it has.
SHARE_TOKENS = 2_000_000
BATCH = 16384
#: Runs of one row in a batch are short up to so many tokens.
SHORT = 6
RATE = 0.25
#: Letters are classes of their own, then digits, comma, full stop, other signs, and bytes of other characters in two.
_ENDING = np.array([b - 97 if 97 <= b <= 122 else 26 if 48 <= b <= 57 else 27 if b == 44 else 28 if b == 46 else 29 if b < 128 else 30 + (b & 1) for b in range(256)], np.uint8)
_END, _BEGIN = np.uint64(0xE0F), np.uint64(0xB0F)
_FLUSH = 1 << 19
_ODD = np.random.default_rng(7).integers(0, 1 << 63, 6, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def token_arrays(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Per slice of texts: first and end row, hash and ending of every token with each text's end, tokens per text."""
    for first, end, data, rows in slices(column):
        lower = ASCII_LOWER[data]
        starts, ends, counts = words(lower, rows)
        stops = np.cumsum(counts)
        tokens = np.insert(hashes(lower, starts, ends), stops, _END)
        endings = np.insert(_ENDING[lower[ends - 1]], stops, np.uint8(29))
        yield first, end, tokens, endings, counts + 1


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(token: np.ndarray, ending: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(ending.astype(np.int32)), pa.array(count)], ["token", "ending", "count"])

    nothing = np.empty(0, np.uint64), np.empty(0, np.uint8), np.empty(0, np.int64)
    known, kinds, totals = nothing
    for batch in batches:
        for _first, _end, tokens, endings, _sizes in token_arrays(batch.column("text")):
            new, at, count = np.unique(tokens, return_index=True, return_counts=True)
            both, first, place = np.unique(np.concatenate([known, new]), return_index=True, return_inverse=True)
            kinds = np.concatenate([kinds, endings[at]])[first]
            known, totals = both, np.bincount(place, np.concatenate([totals, count]), len(both)).astype(np.int64)
            if len(known) > _FLUSH:
                yield out(known, kinds, totals)
                known, kinds, totals = nothing
    yield out(known, kinds, totals)


@dataclass
class Model:
    """token (sorted), log_count and place (in the head, or -1) of the frequent tokens, the logarithms of the tail classes' sizes, and the weights."""

    token: np.ndarray
    log_count: np.ndarray
    place: np.ndarray
    tail: np.ndarray
    classes: np.ndarray
    within: np.ndarray

    def __post_init__(self):
        """token is sorted: where tokens of each value of their first 16 bits start, and the longest run of one value."""
        first = (self.token >> np.uint64(48)).astype(np.int64)
        self.starts = np.searchsorted(first, np.arange(1 << 16))
        self.longest = int(np.bincount(first, minlength=1).max())

    def look_up(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether frequent, where)"""
        start = self.starts[tokens >> np.uint64(48)]
        known, at = np.zeros(len(tokens), bool), np.zeros(len(tokens), np.int64)
        for k in range(self.longest):
            here = np.minimum(start + k, len(self.token) - 1)
            equal = self.token[here] == tokens
            known |= equal
            np.copyto(at, here, where=equal)
        return known, at


def features(tokens: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Three rows of the class weights for each token, and the hash of the word before."""
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = np.arange(len(tokens)) - first
    one, two = np.full(len(tokens), _BEGIN), np.full(len(tokens), _BEGIN)
    one[1:] = np.where(at[1:] > 0, tokens[:-1], _BEGIN)
    two[2:] = np.where(at[2:] > 1, tokens[:-2], _BEGIN)
    # Tokens are mixed hashes: a product's first 14 bits are as good as any. Row 0 is every token's.
    rows = [one * _ODD[0], two * _ODD[1], (one * _ODD[2] ^ two) * _ODD[3]]
    return np.stack([np.maximum((r >> np.uint64(50)).astype(np.int32), 1) for r in rows], axis=1), one


def within_rows(before: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Rows of the weights within classes: one for the word before, with the class (rows under CLASSES are the classes' own)."""
    return np.maximum(((((before + group.astype(np.uint64)) * _ODD[4]) ^ before) * _ODD[5] >> np.uint64(50)).astype(np.int32), CLASSES)


def _gather(weights: np.ndarray, *rows: np.ndarray) -> np.ndarray:
    """The sum of the weights of each token's rows."""
    total, more = np.take(weights, rows[0], axis=0), np.empty((len(rows[0]), weights.shape[1]), weights.dtype)
    for row in rows[1:]:
        total += np.take(weights, row, axis=0, out=more, mode="clip")  # clip: numpy writes to out without a copy
    return total


def _log_chance(x: np.ndarray, goal: np.ndarray) -> np.ndarray:
    """Of each row's softmax, the logarithm at goal; x is spent."""
    x -= x.max(axis=1, keepdims=True)
    value = x[np.arange(len(goal)), goal]
    np.exp(x, out=x)
    return value - np.log(np.einsum("ij->i", x))


def _softmax(x: np.ndarray) -> np.ndarray:
    """x is spent."""
    x -= x.max(axis=1, keepdims=True)
    np.exp(x, out=x)
    x /= np.einsum("ij->i", x)[:, None]
    return x


def _sums(values: np.ndarray, at: np.ndarray, starts: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Sums of values[at] over runs. Most runs are short: those are added one element of all runs at a time."""
    total = values[at[starts]]
    for k in range(1, SHORT):
        runs = np.flatnonzero((length > k) & (length <= SHORT))
        total[runs] += values[at[starts[runs] + k]]
    long = length > SHORT
    if long.any():
        total[long] = np.add.reduceat(values[at[np.repeat(long, length)]], np.cumsum(length[long]) - length[long], axis=0)
    return total


def _step(weights: np.ndarray, seen: np.ndarray, used: np.ndarray, rows: np.ndarray, gradient: np.ndarray) -> None:
    """An adaptive step on the rows that a batch uses; rows: (tokens, features of each)."""
    flat = rows.ravel().astype(np.uint16)  # rows are under 2^16, which are sorted by digits
    order = np.argsort(flat, kind="stable")
    ordered = flat[order]
    starts = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    length = np.diff(np.append(starts, len(ordered)))
    _move(weights, seen, used, ordered[starts], _sums(gradient, order // rows.shape[1], starts, length), length)


def _move(weights: np.ndarray, seen: np.ndarray, used: np.ndarray, row: np.ndarray, total: np.ndarray, count: np.ndarray) -> None:
    seen[row] += np.square(total).mean(axis=1)
    used[row] += count
    weights[row] -= RATE * total / np.sqrt(seen[row] + 1e-2)[:, None]


def _learn(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        classes, within = model.classes.copy(), model.within.copy()
        seen = [np.zeros(CLASS_ROWS, np.float32), np.zeros(WORD_ROWS, np.float32)]
        used = [np.zeros(CLASS_ROWS, np.float32), np.zeros(WORD_ROWS, np.float32)]
        for batch in batches:
            for _first, _end, tokens, endings, sizes in token_arrays(batch.column("text")):
                rows, before = features(tokens, sizes)
                known, at = model.look_up(tokens)
                place = np.where(known, model.place[at], -1)
                target = np.where(place >= 0, place // PER_CLASS, CLASSES + endings.astype(np.int64))
                for i in range(0, len(tokens), BATCH):
                    part = slice(i, i + BATCH)
                    here, goal = rows[part], target[part]
                    gradient = _softmax(_gather(classes, *here.T) + classes[0])
                    gradient[np.arange(len(goal)), goal] -= 1
                    _move(classes, seen[0], used[0], np.zeros(1, int), gradient.sum(axis=0, keepdims=True), np.array([len(goal)]))
                    _step(classes, seen[0], used[0], here, gradient)
                    inside = np.flatnonzero(goal < CLASSES)
                    if len(inside):
                        group, word = goal[inside], place[part][inside] % PER_CLASS
                        row = within_rows(before[part][inside], group)
                        gradient = _softmax(_gather(within, group, row))
                        gradient[np.arange(len(word)), word] -= 1
                        own = (group == np.arange(CLASSES)[:, None]).astype(np.float32)
                        _move(within, seen[1], used[1], np.arange(CLASSES), own @ gradient, own.sum(axis=1))
                        _step(within, seen[1], used[1], row[:, None], gradient)
        for base, count, change in ((0, used[0], classes - model.classes), (CLASS_ROWS, used[1], within - model.within)):
            row = np.flatnonzero(count)
            change = np.pad(change[row] * count[row, None], ((0, 0), (0, WIDTH - change.shape[1])))
            arrays = [pa.array((row + base).astype(np.int32)), pa.array(count[row])] + [pa.array(change[:, k]) for k in range(WIDTH)]
            yield pa.RecordBatch.from_arrays(arrays, ["row", "used", *[f"d{k}" for k in range(WIDTH)]])

    return run


def _learn_share(shared):
    """The changes that the texts of one share make, taken in the order of their keys."""
    run = _learn(shared)

    def one(share: pa.Table) -> pa.Table:
        ordered = share.sort_by("key").select(["text"]).combine_chunks()
        return pa.Table.from_batches(list(run(iter(ordered.to_batches()))))

    return one


def vocabulary(train: DataFrame) -> DataFrame:
    """token (hash), ending, count over all training texts."""
    counts = train.mapInArrow(_count, "token long, ending int, count long")
    return cut(counts.groupBy("token").agg(F.min("ending").alias("ending"), F.sum("count").alias("count")))


def fit(train: DataFrame, vocab: DataFrame, total: int) -> Model:
    """train: text and key columns; vocab: its vocabulary; total: its tokens."""
    spark = train.sparkSession
    frequent = vocab.filter(F.col("count") * FREQUENT >= total).toArrow()
    token, ending, count = frequent.column("token").to_numpy().view(np.uint64), frequent.column("ending").to_numpy(), frequent.column("count").to_numpy()
    order = np.argsort(token)
    token, ending, count = token[order], ending[order], count[order]
    place = np.full(len(token), -1, np.int32)
    head = np.lexsort((token, -count))[:HEAD]
    place[head] = np.arange(len(head))
    size = np.ones(ENDINGS)
    for r in vocab.groupBy("ending").agg((F.sum("count") + F.count(F.lit(1))).alias("size")).collect():
        size[r["ending"]] += r["size"]
    size -= np.bincount(ending[head], count[head] + 1, ENDINGS)
    weights = [np.zeros((CLASS_ROWS, WIDTH), np.float32), np.zeros((WORD_ROWS, PER_CLASS), np.float32)]
    model = Model(token, np.log10(count + 1.0), place, np.log10(size), *weights)
    columns = [f"d{k}" for k in range(WIDTH)]
    schema = "row int, used float, " + ", ".join(f"{c} float" for c in columns)
    shares = max(1, round(total / (ROUNDS * SHARE_TOKENS)))
    for number in range(ROUNDS):
        shown = train.filter(F.pmod(F.col("key"), F.lit(ROUNDS)) == number).withColumn("share", F.pmod(F.xxhash64("key"), F.lit(shares)))
        shared = spark.sparkContext.broadcast(model)
        learnt = shown.groupBy("share").applyInArrow(_learn_share(shared), schema)
        sums = learnt.groupBy("row").agg(F.sum("used").alias("used"), *[F.sum(c).alias(c) for c in columns])
        changes = sums.toArrow()
        row = changes.column("row").to_numpy()
        mean = np.stack([changes.column(c).to_numpy() for c in columns], axis=1) / changes.column("used").to_numpy()[:, None]
        classes, within = model.classes.copy(), model.within.copy()
        of_classes = row < CLASS_ROWS
        classes[row[of_classes]] += mean[of_classes].astype(np.float32)
        within[row[~of_classes] - CLASS_ROWS] += mean[~of_classes, :PER_CLASS].astype(np.float32)
        model = replace(model, classes=classes, within=within)
    return model


def _score(shared, keep: list[str]):
    log10 = np.log10(np.e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for first, end, tokens, endings, sizes in token_arrays(batch.column("text")):
                rows, before = features(tokens, sizes)
                known, at = model.look_up(tokens)
                place = np.where(known, model.place[at], -1)
                target = np.where(place >= 0, place // PER_CLASS, CLASSES + endings.astype(np.int64))
                base = np.where(known, model.log_count[at], 0.0)
                # Counts of tokens that aren't frequent come by a join.
                value = np.where(place >= 0, 0.0, base - model.tail[endings])
                for i in range(0, len(tokens), BATCH):
                    part = slice(i, i + BATCH)
                    here, goal = rows[part], target[part]
                    value[part] += _log_chance(_gather(model.classes, *here.T) + model.classes[0], goal) * log10
                    inside = np.flatnonzero(goal < CLASSES)
                    if len(inside):
                        group = goal[inside]
                        row = within_rows(before[part][inside], group)
                        value[i + inside] += _log_chance(_gather(model.within, group, row), place[part][inside] % PER_CLASS) * log10
                starts = np.cumsum(sizes) - sizes
                sums = [np.add.reduceat(x, starts) for x in (known.astype(np.int64), base, value)]
                arrays = [batch.column(c)[first:end] for c in keep] + [pa.array(x) for x in (sizes, *sums)]
                yield pa.RecordBatch.from_arrays(arrays, [*keep, "n_tokens", "often_known", "often_base", "partial"])

    return run


def _rare(shared):
    """The tokens that are not frequent, of each text: distinct, with their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text_hash")
            for first, _end, tokens, _endings, sizes in token_arrays(batch.column("text")):
                known, _at = model.look_up(tokens)
                row, token = np.repeat(np.arange(len(sizes)), sizes)[~known], tokens[~known]
                order = np.lexsort((token, row))
                row, token = row[order], token[order]
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (token[1:] != token[:-1])
                starts = np.flatnonzero(new)
                at = pa.array(row[starts] + first)
                count = np.diff(np.append(starts, len(row)))
                yield pa.RecordBatch.from_arrays([ids.take(at), texts.take(at), pa.array(token[starts].view(np.int64)), pa.array(count)], ["doc_id", "text_hash", "token", "n"])

    return run


def score(docs: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row; learns where held_out is false."""
    spark = docs.sparkSession
    named = docs.select(F.col(doc_id).alias("doc_id"), row_key(doc_id, text).alias("text_hash"), held_out.alias("held_out"), F.col(text).alias("text"))
    train = named.filter(~F.col("held_out")).select("text", F.xxhash64("text_hash").alias("key"))
    vocab = vocabulary(train.select("text"))
    total, size = vocab.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count(F.lit(1))).first()
    if not total:
        empty = named.select("doc_id", "held_out", (F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")) + 1).cast("long").alias("n_tokens"))
        zero, nothing = F.lit(0).cast("long"), F.lit(0.0)
        return empty.select("*", zero.alias("n_known"), zero.alias("train_tokens"), nothing.alias("base_score"), nothing.alias("score"))
    model = fit(train, vocab, total)
    shared = spark.sparkContext.broadcast(model)
    keep = ["doc_id", "text_hash", "held_out"]
    scored = named.mapInArrow(
        _score(shared, keep), "doc_id long, text_hash long, held_out boolean, n_tokens long, often_known long, often_base double, partial double"
    )
    scored = cut(scored)
    rare = named.select("doc_id", "text_hash", "text").mapInArrow(_rare(shared), "doc_id long, text_hash long, token long, n long")
    counted = rare.join(vocab, "token").groupBy("doc_id", "text_hash")
    sums = counted.agg(F.sum("n").alias("rare_known"), F.sum(F.col("n") * F.log10(F.col("count") + 1)).alias("rare_base"))
    # Repeated rows add up in these sums; each of them gets its share.
    times = scored.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("times"))
    sums = sums.join(times, same(sums, times, "doc_id", "text_hash")).select(
        sums["doc_id"].alias("r_id"), sums["text_hash"].alias("r_hash"), (F.col("rare_known") / F.col("times")).cast("long").alias("rare_known"), (F.col("rare_base") / F.col("times")).alias("rare_base")
    )
    joined = scored.join(sums, scored["doc_id"].eqNullSafe(sums["r_id"]) & (scored["text_hash"] == sums["r_hash"]), "left")
    rare_base = F.coalesce("rare_base", F.lit(0.0))
    return joined.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("often_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("often_base") + rare_base - F.col("n_tokens") * F.lit(float(np.log10(total + size + 1)))).alias("base_score"),
        (F.col("partial") + rare_base).alias("score"),
    )
