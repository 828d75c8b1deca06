"""Language ID by hierarchical discrimination: the family first, then the languages in it.

A text is its byte bigrams and trigrams (A-Z lower-cased, other ASCII signs as spaces), hashed to a
fixed number of features, as square roots of counts and of length 1. Both levels are one-versus-one
linear support vector machines; a level's share of a class is the mean of its pairwise odds.

Learning takes at most PER_LANGUAGE rows of each language (those least by a hash) and learns every
language. Where the table of families leaves more of them than FAMILIES_AT_MOST and the square root of the
number of languages, those whose mean texts are most alike are joined, so that there are about n^1.5
machines, not n^2. Each pair's machine is trained in a task of its own and only its weights, of fixed size,
come to the driver. Prediction reads whole texts, in any number.

Results for odd input: a text that is null or has no letter is ``und`` with score 0, and so is every
text if there is nothing to learn from. Rows with a null language are not learnt from; repeated ones
count once. Repeated rows are predicted each. Extra columns are kept, whatever they are called, but
for those of the names that the result gets; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedgeline.llm.blocks import slices
from sedgeline.llm.common import cut, fresh

UNKNOWN = "und"
#: Rows learnt from, of each language.
PER_LANGUAGE = 400
#: Families beyond which they are joined by likeness, unless the languages' square root is more.
FAMILIES_AT_MOST = 16
#: Groups in which the rows of a language are ranked first.
_GROUPS = 64
#: The list of rows to learn from is broadcast if its bound is no more than this.
_BROADCAST_ROWS = 100_000
FEATURES = 1 << 13
#: Families of closely related languages. Any other language is a family of its own.
FAMILIES = {
    "da": "germanic", "de": "germanic", "en": "germanic", "nl": "germanic", "no": "germanic", "sv": "germanic",
    "ca": "romance", "es": "romance", "fr": "romance", "it": "romance", "pt": "romance", "ro": "romance",
    "bg": "slavic", "cs": "slavic", "pl": "slavic", "ru": "slavic", "sk": "slavic", "uk": "slavic",
}
_LETTERS = np.array([c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256)], dtype=np.uint32)
_ROWS = 128


def _features(data: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """A row of FEATURES numbers for each text."""
    n = len(rows) - 1
    code = _LETTERS[data]
    owner = np.repeat(np.arange(n, dtype=np.int64) * FEATURES, np.diff(rows))
    total = np.zeros(n * FEATURES, dtype=np.int64)
    for width in (2, 3):
        if len(code) < width:
            continue
        gram = code[: len(code) - width + 1].copy()
        for k in range(1, width):
            gram = gram * np.uint32(1000003) + code[k : len(code) - width + 1 + k]
        gram = (gram * np.uint32(2654435761)) >> np.uint32(19)
        inside = owner[: len(gram)] == owner[width - 1 :]
        total += np.bincount((owner[: len(gram)] + gram)[inside], minlength=n * FEATURES)
    x = np.sqrt(total.reshape(n, FEATURES), dtype=np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def feature_rows(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    for first, end, data, rows in slices(column):
        for i in range(0, end - first, _ROWS):
            j = min(i + _ROWS, end - first)
            yield first + i, first + j, _features(data[rows[i] : rows[j]], rows[i : j + 1] - rows[i])


@dataclass(frozen=True)
class Pairwise:
    """One-versus-one linear machines over classes: a column of weights for each pair (i, j), positive for i."""

    classes: tuple[str, ...]
    weights: np.ndarray
    bias: np.ndarray

    def shares(self, x: np.ndarray) -> np.ndarray:
        n = len(self.classes)
        if n == 1:
            return np.ones((len(x), 1))
        odds = 1 / (1 + np.exp(-4 * (x @ self.weights + self.bias)))
        shares, at = np.zeros((len(x), n)), 0
        for i in range(n):
            for j in range(i + 1, n):
                shares[:, i] += odds[:, at] / (n - 1)
                shares[:, j] += (1 - odds[:, at]) / (n - 1)
                at += 1
        return shares


def _machine(x: np.ndarray, y: np.ndarray, rounds: int = 300, penalty: float = 1e-4) -> tuple[np.ndarray, float]:
    """A linear support vector machine by subgradient steps on the mean hinge loss, each side weighing one half."""
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    weight = np.where(y > 0, 0.5 / max(1, np.sum(y > 0)), 0.5 / max(1, np.sum(y < 0))).astype(np.float32)
    mean_w, mean_b = np.zeros_like(w), 0.0
    for k in range(rounds):
        late = (y * (x @ w + b) < 1) * y * weight
        step = 20 / np.sqrt(k + 1)
        w = w * (1 - min(0.5, step * penalty)) + step * (late @ x)
        b += 0.1 * step * float(late.sum())
        if k >= rounds // 2:
            mean_w, mean_b = mean_w + w, mean_b + b
    return mean_w / (rounds - rounds // 2), mean_b / (rounds - rounds // 2)


def _pairs(classes: Sequence[str]) -> list[tuple[str, str]]:
    """In the order in which Pairwise has its columns."""
    return [(a, b) for i, a in enumerate(classes) for b in classes[i + 1 :]]


@dataclass(frozen=True)
class Model:
    families: Pairwise
    languages: Mapping[str, Pairwise]

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        by_family = self.families.shares(x)
        best = by_family.argmax(axis=1)
        names, score = np.empty(len(x), object), np.zeros(len(x))
        for k, family in enumerate(self.families.classes):
            if (rows := np.flatnonzero(best == k)).size:
                within = self.languages[family].shares(x[rows])
                top = within.argmax(axis=1)
                names[rows] = np.array(self.languages[family].classes, object)[top]
                score[rows] = by_family[rows, k] * within[np.arange(len(rows)), top]
        return names, score


def has_letter(text: str) -> Column:
    return F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))


def _sample(docs: DataFrame, per_language: int, doc_id: str, text: str, lang: str) -> tuple[DataFrame, list[str]]:
    """lang, text_hash, at and value (the features that are not zero) of the rows to learn from, cut; and the languages."""
    labelled = docs.filter(F.col(lang).isNotNull() & has_letter(text))
    named = labelled.select(F.col(lang).cast("string").alias("lang"), F.col(doc_id).alias("doc"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    # Ranks are found without the texts, in groups of each language first, so that no task gets more than so many rows of each group.
    ranked = named.select("lang", "doc", "text_hash", F.xxhash64(F.lit("train"), "doc", "text_hash").alias("rank")).withColumn("group", F.pmod("rank", F.lit(_GROUPS)))
    for part in (["lang", "group"], ["lang"]):
        order = Window.partitionBy(*part).orderBy("rank")
        ranked = ranked.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= per_language).drop("n")
    chosen = cut(ranked.select(F.col("doc").alias("c_doc"), F.col("text_hash").alias("c_hash"), F.col("lang").alias("c_lang")).distinct())
    learnt = sorted(r["c_lang"] for r in chosen.select("c_lang").distinct().collect())
    if per_language * len(learnt) <= _BROADCAST_ROWS:
        chosen = F.broadcast(chosen)
    on = named["doc"].eqNullSafe(chosen["c_doc"]) & (named["text_hash"] == chosen["c_hash"]) & (named["lang"] == chosen["c_lang"])
    found = named.join(chosen, on, "left_semi").dropDuplicates(["lang", "doc", "text_hash"])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, hashes = batch.column("lang"), batch.column("text_hash")
            for first, end, x in feature_rows(batch.column("text")):
                at = [np.flatnonzero(row).astype(np.uint16) for row in x]
                values = [row[i].astype(np.float16).tobytes() for row, i in zip(x, at, strict=True)]
                blobs = [pa.array([i.tobytes() for i in at], pa.binary()), pa.array(values, pa.binary())]
                yield pa.RecordBatch.from_arrays([langs[first:end], hashes[first:end], *blobs], ["lang", "text_hash", "at", "value"])

    return cut(found.select("lang", "text_hash", "text").mapInArrow(extract, "lang string, text_hash long, at binary, value binary")), learnt


def _train_one(table: pa.Table) -> pa.Table:
    """The machine of one pair from its rows (side: 1 or -1). Rows are put in order by number: their features are held once, beside x."""
    order = pc.sort_indices(table, [("side", "descending"), ("lang", "ascending"), ("text_hash", "ascending")]).to_numpy()
    at, value = table.column("at"), table.column("value")
    x = np.zeros((table.num_rows, FEATURES), np.float32)
    for i, k in enumerate(order.tolist()):
        x[i, np.frombuffer(at[k].as_buffer(), np.uint16)] = np.frombuffer(value[k].as_buffer(), np.float16)
    w, b = _machine(x, table.column("side").to_numpy()[order].astype(np.float32))
    return pa.table({"machine": table.column("machine").slice(0, 1), "weights": pa.array([w.astype(np.float32).tobytes()], pa.binary()), "bias": pa.array([float(b)])})


def _mean_text(table: pa.Table) -> pa.Table:
    """The sum of a language's rows of features, as long as 1."""
    total = np.zeros(FEATURES, np.float32)
    for at, value in zip(table.column("at").to_pylist(), table.column("value").to_pylist(), strict=True):
        total[np.frombuffer(at, np.uint16)] += np.frombuffer(value, np.float16)
    total /= max(float(np.linalg.norm(total)), 1e-9)
    return pa.table({"lang": table.column("lang").slice(0, 1), "mean": pa.array([total.tobytes()], pa.binary())})


def _joined(family: dict[str, str], sample: DataFrame) -> dict[str, str]:
    """family, in which the families that are most alike (by their languages' mean texts) are joined until they are few enough."""
    most = max(FAMILIES_AT_MOST, math.ceil(math.sqrt(len(family))))
    names = sorted(set(family.values()))
    if len(names) <= most:
        return family
    rows = sample.select("lang", "text_hash", "at", "value").groupBy("lang").applyInArrow(_mean_text, "lang string, mean binary").collect()
    mean = {r["lang"]: np.frombuffer(r["mean"], np.float32) for r in rows}
    total = np.array([sum(mean[x] for x in sorted(family) if family[x] == f) for f in names])
    into = list(range(len(names)))
    alive = list(range(len(names)))
    while len(alive) > most:
        own = total[alive] / np.maximum(np.linalg.norm(total[alive], axis=1, keepdims=True), 1e-9)
        alike = own @ own.T
        np.fill_diagonal(alike, -np.inf)
        i, j = sorted(np.unravel_index(int(np.argmax(alike)), alike.shape))
        a, b = alive[i], alive[j]
        total[a] += total[b]
        into = [a if x == b else x for x in into]
        alive.pop(j)
    of = {f: names[into[k]] for k, f in enumerate(names)}
    return {x: of[f] for x, f in family.items()}


def train(
    docs: DataFrame,
    per_language: int = PER_LANGUAGE,
    families: Mapping[str, str] = FAMILIES,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
) -> Model | None:
    """A model from at most per_language rows of each language; None if no row has one."""
    sample, learnt = _sample(docs, per_language, doc_id, text, lang)
    if not learnt:
        return None
    family = _joined({name: families.get(name, name) for name in learnt}, sample)
    names = sorted(set(family.values()))
    within = {f: [name for name in learnt if family[name] == f] for f in names}
    sides = []
    for k, (a, b) in enumerate(_pairs(names)):
        sides += [(f"family {k}", name, 1 if family[name] == a else -1) for name in learnt if family[name] in (a, b)]
    for f, members in within.items():
        for k, pair in enumerate(_pairs(members)):
            sides += [(f"{f} language {k}", name, side) for name, side in zip(pair, (1, -1), strict=True)]
    trained: dict[str, tuple[np.ndarray, float]] = {}
    if sides:
        machines = F.broadcast(docs.sparkSession.createDataFrame(sides, "machine string, lang string, side int"))
        dealt = sample.join(machines, "lang").select("machine", "side", "lang", "text_hash", "at", "value")
        rows = dealt.groupBy("machine").applyInArrow(_train_one, "machine string, weights binary, bias double").toArrow().to_pylist()
        trained = {r["machine"]: (np.frombuffer(r["weights"], np.float32), r["bias"]) for r in rows}

    def pairwise(classes: Sequence[str], stem: str) -> Pairwise:
        found = [trained[f"{stem} {k}"] for k in range(len(_pairs(classes)))]
        weights = np.array([w for w, _ in found], np.float32).T.reshape(FEATURES, len(found))
        return Pairwise(tuple(classes), weights, np.array([b for _, b in found], np.float32))

    return Model(pairwise(names, "family"), {f: pairwise(members, f"{f} language") for f, members in within.items()})


def predict(docs: DataFrame, model: Model | None, text: str = "text", lang_pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with the language and the score, in columns of the names given; those of docs with these names are replaced."""
    columns = [c for c in docs.columns if c.lower() not in (lang_pred.lower(), score.lower())]
    kept = docs.select(*[docs[f"`{c}`"] for c in columns])
    if model is None:
        return kept.withColumn(lang_pred, F.lit(UNKNOWN)).withColumn(score, F.lit(0.0))
    (flag,) = fresh(docs, "known")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # A slice at a time, so that what comes back is as small: whole batches of long texts take 64 MB in both processes.
            for first, end, x in feature_rows(batch.column(text)):
                part = batch.slice(first, end - first)
                known = part.column(flag).to_numpy(zero_copy_only=False).astype(bool)
                names, share = shared.value.predict(x)
                names[~known], share[~known] = UNKNOWN, 0.0
                arrays = [part.column(c) for c in columns] + [pa.array(names, pa.string()), pa.array(share, pa.float64())]
                yield pa.RecordBatch.from_arrays(arrays, [*columns, lang_pred, score])

    out = kept.schema.add(lang_pred, "string").add(score, "double")
    return kept.withColumn(flag, has_letter(text)).mapInArrow(run, out)
