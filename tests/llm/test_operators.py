"""The numbered operators against plain versions, on small tables with nulls, repeats, ties and odd texts."""

import gzip
import hashlib
import json
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from sedgeline.llm.common import row_key
from sedgeline.llm import decontamination, jaccard_join, language_id, line_dedup, maxent_lm, mixing, order_minhash, sharding, suffix_dedup, warc

SCHEMA = "doc_id long, text string, lang string, source string, _key string, n_shingles long, name string"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


@pytest.fixture(scope="module")
def rows():
    base = [f"w{i % 37}x{i * 7 % 41} v{i}" for i in range(120)]
    texts = [None, "", " \n\t", "one", "Two words", "é ü 漢字 \n same line\nSAME LINE ", " ".join(base)]
    texts += [" ".join([*base[:k], f"edit{k}", *base[k + 1 :]]) for k in range(3, 60, 2)]
    texts += [f"Line {i}\n common line \n" + " ".join(f"t{i}q{j}" for j in range(70)) + "\n" + " ".join(base[20:50]) for i in range(14)]
    texts += ["word " * 5000, " ".join(base)]
    return [(i, t, ["en", "fr", None][i % 3], ["a", "b", None][i % 3], "clash", 1, "n") for i, t in enumerate(texts)] + [(3, "one", "en", "a", "k", 1, "n")] * 2 + [(None, "no id here", "en", "a", "k", 1, "n")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_line_dedup(docs, rows, empty):
    bits = line_dedup.keep_bitmaps(docs, line_dedup.FREQUENT, min_docs=10)
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_lines, r.n_dropped, r.kept_text) for r in line_dedup.apply_bitmaps(docs, bits).collect())
    keys = lambda t: [lower(x.strip(" \t\n\r\v\f")) for x in (t or "").split("\n")]
    count = Counter(k for d, t in {(r[0], r[1]) for r in rows} for k in set(keys(t)) if k)
    want = []
    for r in rows:
        kept = [x for x, k in zip((r[1] or "").split("\n"), keys(r[1]), strict=True) if count[k] < 10]
        n = len(keys(r[1]))
        want.append((r[0] is not None, r[0] or 0, n, n - len(kept), "\n".join(kept)))
    assert got == sorted(want) and any(x[3] for x in got)
    assert line_dedup.keep_bitmaps(empty).count() == 0


@pytest.mark.parametrize("parts, batch", [(1, 10_000), (7, 13), (64, 7)])
def test_line_dedup_over_partitions(spark, parts, batch):
    """Runs of equal lines that go over several partitions and batches, both policies, against plain versions."""
    texts = ["\n".join([f"shared {k}" for k in range(60)] + [f"own {i}", "twice", "twice", ""]) for i in range(12)] + [None, "shared 1", "shared 1\n" * 40]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(0, texts[0])], "doc_id long, text string")
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {}
        for policy in (line_dedup.FREQUENT, line_dedup.REPEATED):
            bits = line_dedup.keep_bitmaps(docs, policy, min_docs=10)
            got[policy] = sorted((r.doc_id, r.n_dropped, r.kept_text) for r in line_dedup.apply_bitmaps(docs, bits).collect())
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    lines = [(t or "").split("\n") for t in texts]
    count = Counter(x for ls in lines for x in set(ls) if x)
    frequent = [[x for x in ls if count[x] < 10] for ls in lines]
    seen, first = set(), []
    for ls in lines:
        kept = []
        for x in ls:
            if not x or x not in seen:
                kept.append(x)
            seen.add(x)
        first.append(kept)
    for policy, kept in ((line_dedup.FREQUENT, frequent), (line_dedup.REPEATED, first)):
        want = [(i, len(ls) - len(k), "\n".join(k)) for i, (ls, k) in enumerate(zip(lines, kept, strict=True))]
        assert got[policy] == sorted([*want, want[0]])


@pytest.mark.parametrize("small, n, percent", [(24, 3, 90), (2, 3, 90), (2, 5, 80), (24, 5, 80)])
def test_jaccard_join(docs, rows, empty, small, n, percent):
    sets = []
    for r in rows:
        w = tokens(r[1])
        sets.append(frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else []))
    group = list(range(len(rows)))

    def top(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                group[max(top(a), top(b))] = min(top(a), top(b))
    least = defaultdict(list)
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[top(i)].append(r[0])
    want = sorted((str(r[0]), len(sets[i]), str(min(least[top(i)], default=None))) for i, r in enumerate(rows))
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard_join.link_components(docs, n, percent, small=small, chunk=4 if small == 2 else 4096).collect())
    assert got == want
    kept = jaccard_join.one_of_each(docs, n, percent).collect()
    assert len(kept) == len({top(i) for i, s in enumerate(sets) if s}) + sum(not s for s in sets)
    assert {r._key for r in kept} <= {r[4] for r in rows} and jaccard_join.one_of_each(docs, n, percent).columns == docs.columns
    assert jaccard_join.link_components(empty).count() == 0 and jaccard_join.one_of_each(empty).count() == 0


def found_in_order(docs, bench):
    dirty = {(r.doc_id, r.text_hash) for r in decontamination.contamination(docs, bench, n=10).collect() if r.contaminated}
    return [(r.doc_id, r.h) in dirty for r in docs.select("doc_id", row_key("doc_id", "text").alias("h")).collect()]


def test_decontamination(spark, docs, rows, empty):
    items = [(1, " ".join(f"T2q{j}" for j in range(10, 25))), (2, "two, WORDS!"), (3, None), (4, "!!"), (2, "one"), (None, "漢字 absent")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.contamination(docs, bench, n=10).collect()
    split = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t)) if w]
    windows = [(i, w[k : k + 10]) for i, t in items for w in [split(t)] if w for k in range(max(1, len(w) - 9))]
    want = []
    for r in rows:
        w, hit, names = split(r[1]), set(), set()
        for i, win in windows:
            for k in range(len(w) - len(win) + 1):
                if w[k : k + len(win)] == win:
                    hit |= set(range(k, k + len(win)))
                    names.add(i)
        want.append((str(r[0]), len(w), len(hit), len(names), sorted(str(i) for i in names if i is not None), bool(hit)))
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r["items"], r.contaminated) for r in found) == sorted(want)
    clean = decontamination.clean(docs, bench).collect()
    assert sorted(map(str, clean)) == sorted(str(r) for r, f in zip(docs.collect(), found_in_order(docs, bench), strict=True) if not f)
    assert len(clean) == sum(not x[-1] for x in want) and decontamination.clean(empty, bench).count() == 0
    assert decontamination.contamination(docs, bench.limit(0)).filter("contaminated").count() == 0
    assert decontamination.contamination(empty, bench).count() == 0


def test_suffix_dedup(docs, rows, empty):
    distinct = {(r[0], r[1]) for r in rows}
    count = Counter(tuple(w[k : k + 50]) for _, t in distinct for w in [tokens(t)] for k in range(len(w) - 49))
    want = set()
    for d, t in distinct:
        w = tokens(t)
        covered = [False] * (len(w) + 1)
        for k in range(len(w) - 49):
            if count[tuple(w[k : k + 50])] > 1:
                covered[k : k + 50] = [True] * 50
        start = None
        for k, c in enumerate(covered):
            if c and start is None:
                start = k
            elif not c and start is not None:
                want.add((d, start, k))
                start = None
    got = [(r.doc_id, r.start, r.end) for r in suffix_dedup.repeated_spans(docs).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want
    assert suffix_dedup.repeated_spans(empty).count() == 0


def test_long_runs_of_suffixes_are_held_in_pieces(monkeypatch):
    """A passage of hundreds of documents, with few suffixes held at once: the same candidates."""
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [f"{' '.join(f'u{d}x{i}' for i in range(d % 13))} {passage} tail{d}" for d in range(400)] + [" ".join(f"z{i}" for i in range(90))] * 2
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text_hash": [hash(t) & 0xFFFFFFF for t in texts], "text": texts})
    suffixes = sorted(s for b in suffix_dedup._suffixes(iter([batch])) for s in b.column("suffix").to_pylist())
    most_held = []

    def candidates(block, most):
        monkeypatch.setattr(suffix_dedup, "_BLOCK", block)
        monkeypatch.setattr(suffix_dedup, "_MOST", most)
        extended = suffix_dedup._extended
        monkeypatch.setattr(suffix_dedup, "_extended", lambda codes, place: most_held.append(len(codes)) or extended(codes, place))
        parts = [pa.RecordBatch.from_pydict({"suffix": suffixes[i : i + 7]}) for i in range(0, len(suffixes), 7)]
        found = [r for b in suffix_dedup._neighbours(iter(parts)) for r in b.to_pylist()]
        monkeypatch.setattr(suffix_dedup, "_extended", extended)
        surely = {(r["doc_id"], k) for r in found if r["passage"] is None for k in range(r["first"], r["last"] + 1)}
        late = defaultdict(set)
        for r in found:
            if r["passage"] is not None:
                late[r["passage"]].add((r["doc_id"], r["first"]))
        return surely | {x for places in late.values() if len(places) > 1 for x in places}

    want = candidates(1 << 20, 1 << 21)
    assert {d for d, _ in want} >= set(range(400)) and max(most_held) > 300
    for block, most in ((10, 20), (25, 50), (100, 200)):
        most_held.clear()
        assert candidates(block, most) == want and max(most_held) <= most + 7 + block


def test_maxent_lm(docs, rows, empty):
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7, F.lit(0)) == 2
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in maxent_lm.score(docs, out).collect())
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    count = Counter(w for r in rows if not held(r[0]) for w in [*tokens(r[1]), None])
    total, size = sum(count.values()), len(count)
    want = []
    for r in rows:
        w = [*tokens(r[1]), None]
        want.append((str(r[0]), held(r[0]), len(w), sum(count[x] > 0 for x in w), total, round(sum(math.log10((count[x] + 1) / (total + size + 1)) for x in w), 6)))
    assert [x[:5] for x in got] == [x[:5] for x in sorted(want)]
    assert [x[5] for x in got] == pytest.approx([x[5] for x in sorted(want)])
    assert maxent_lm.score(empty, out).count() == 0


def test_maxent_lm_probabilities(spark, docs):
    """Chances of all tokens after a history add up to 1, and scores are sums of their logarithms (a plain version)."""
    train = docs.select("text", F.lit(0).alias("key"))
    vocab = maxent_lm.vocabulary(train.select("text"))
    total = vocab.agg(F.sum("count")).first()[0]
    model = maxent_lm.fit(train, vocab, total)
    counts = {r.token: (r.ending, r["count"]) for r in vocab.collect()}

    def hashed(text):
        return next(maxent_lm.token_arrays(pa.array([text])))[2]

    known = {int(t): int(p) for t, p in zip(model.token.view(np.int64), model.place, strict=True)}
    softmax = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()

    def chances(history):
        """The chance of every token of the vocabulary after the tokens in history, and that of any other token by its ending."""
        sizes = np.array([len(history) + 1])
        rows, before = maxent_lm.features(np.append(history, np.uint64(0)), sizes)
        of_class = softmax(model.classes[rows[-1]].sum(axis=0) + model.classes[0])
        found = {}
        for token, (ending, n) in counts.items():
            place = known.get(token, -1)
            if place >= 0:
                group = np.array([place // maxent_lm.PER_CLASS])
                row = maxent_lm.within_rows(before[-1:], group)[0]
                inside = softmax(model.within[group[0]] + model.within[row])
                found[token] = of_class[group[0]] * inside[place % maxent_lm.PER_CLASS]
            else:
                found[token] = of_class[maxent_lm.CLASSES + ending] * (n + 1) / 10 ** model.tail[ending]
        return found, of_class[maxent_lm.CLASSES :] / 10**model.tail, of_class

    for text in ("one two", "w3x7 v1 w6x14", ""):
        tokens = hashed(text)
        found, other, of_class = chances(tokens[:-1])
        head = sum(v for t, v in found.items() if known.get(t, -1) >= 0)
        empty_places = 1 - sum(v for v in found.values()) - other.sum()
        # Places of the head without a token (the vocabulary is small here) take the rest.
        assert -1e-5 <= empty_places < 1 and head <= of_class[: maxent_lm.CLASSES].sum() + 1e-5
        assert sum(v for t, v in found.items() if known.get(t, -1) < 0) + other.sum() == pytest.approx(of_class[maxent_lm.CLASSES :].sum(), abs=1e-5)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    some = [(1, 0, False, "One two"), (2, 0, False, ""), (3, 0, False, "w3x7 v1 unseen; w0x0")]
    schema = "doc_id long, text_hash long, held_out boolean, n_tokens long, often_known long, often_base double, partial double"
    df = spark.createDataFrame(some, "doc_id long, text_hash long, held_out boolean, text string")
    got = {r.doc_id: r.partial for r in df.mapInArrow(maxent_lm._score(shared, ["doc_id", "text_hash", "held_out"]), schema).collect()}
    for i, _, _, text in some:
        tokens, want = hashed(text), 0.0
        endings = next(maxent_lm.token_arrays(pa.array([text])))[3]
        for k, token in enumerate(tokens):
            found, other, _ = chances(tokens[:k])
            want += math.log10(found.get(int(np.int64(token.view(np.int64))), other[endings[k]]))
        assert got[i] == pytest.approx(want, abs=1e-3)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_maxent_lm_scores_are_a_function_of_the_table(spark, monkeypatch):
    """In 1, 4 and 16 partitions, in several shares, scores agree."""
    monkeypatch.setattr(maxent_lm, "SHARE_TOKENS", 30_000)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    found = []
    for n in (1, 4, 16):
        rows = maxent_lm.score(docs.repartition(n), F.col("doc_id") % 7 == 2).collect()
        found.append([r.score for r in sorted(rows, key=lambda r: r.doc_id)])
    for other in found[1:]:
        assert other == pytest.approx(found[0], rel=1e-6)


def test_maxent_lm_beats_the_base_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    r = maxent_lm.score(docs, out).filter("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    print("held-out log10 probability a token:", r[0] / r[2], "base:", r[1] / r[2])
    assert r[0] / r[2] > r[1] / r[2] + 0.05


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_language_id_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3, F.lit(0)) == 1
    model = language_id.train(docs.filter(~out))
    judged = language_id.predict(docs.filter(out & F.col("lang").isNotNull() & language_id.has_letter("text")), model)
    right, every = judged.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count(F.lit(1))).first()
    assert every > 300 and right / every >= 0.95


def test_language_id(spark, docs, empty):
    words = {"en": "the of and that with this", "de": "der die und das nicht ist", "fr": "le la les des que dans", "es": "el los que una por con"}
    rows = [(i, " ".join(w.split()[(i * k) % 6] for k in range(1, 20)), lang) for i in range(60) for lang, w in words.items()]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_language=20)
    test = spark.createDataFrame([(1, "the that and this", "en"), (2, "nicht und das", "de"), (3, "les dans des", "fr"), (4, "una por los", "es"), (5, None, None), (6, "12 !!", "en"), (7, "", "en")], "doc_id long, text string, want string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(test, model).collect()}
    assert [got[i][0] for i in range(1, 8)] == ["en", "de", "fr", "es", "und", "und", "und"]
    assert all(0 <= s <= 1 for _, s in got.values())
    assert language_id.train(empty) is None and language_id.predict(docs, None).count() == docs.count()
    clashing = test.withColumns({"_known": F.lit("mine"), "__known": F.lit("too"), "score": F.lit("old")})
    kept = language_id.predict(clashing, model, lang_pred="lp", score="sc").collect()
    assert all((r._known, r["__known"], r.score) == ("mine", "too", "old") for r in kept) and {r.doc_id: r.lp for r in kept} == {i: v[0] for i, v in got.items()}


def test_language_id_learns_every_language(spark):
    """Seventy languages without a table of families: all are learnt and told apart; families come from the texts."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = []
    for k in range(70):
        rng = random.Random(k // 5)  # five languages each share half of their words
        shared = ["".join(rng.choices(letters, k=5)) for _ in range(12)]
        own = ["".join(random.Random(1000 + k).choices(letters, k=60))[5 * i : 5 * i + 5] for i in range(12)]
        for i in range(14):
            draw = random.Random(k * 100 + i)
            rows.append((k * 100 + i, " ".join(draw.choices(shared + own, k=40)), f"x{k:02d}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs.filter("doc_id % 100 < 10"), per_language=10)
    assert sum(len(p.classes) for p in model.languages.values()) == 70 and len(model.families.classes) == language_id.FAMILIES_AT_MOST
    judged = language_id.predict(docs.filter("doc_id % 100 >= 10"), model)
    right, every = judged.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count(F.lit(1))).first()
    assert every == 280 and right / every > 0.97 and judged.select("lang_pred").distinct().count() == 70


def test_order_minhash(docs, rows, empty):
    found = order_minhash.fingerprints(docs).collect()
    ordered = sorted(((r[0] if r[0] is not None else -1, r[1] or "") for r in rows))
    edited = []
    for (_, t), (_, n) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        edited.append(t[: len(t) - len(t) // 2] + n[: len(t) // 2])
    assert sorted(r.edited for r in found) == sorted(edited)
    by_text = defaultdict(set)
    for r, (_, t) in zip(sorted(found, key=lambda r: (r.doc_id if r.doc_id is not None else -1, r.n_chars)), sorted(((d, t) for d, t in ordered), key=lambda x: (x[0], len(x[1]))), strict=True):
        by_text[t].add(tuple(r.signature))
    assert all(len(s) == 1 for s in by_text.values())
    assert order_minhash.fingerprints(empty).count() == 0


def test_order_minhash_sees_order(spark):
    words = [f"w{i}" for i in range(400)]
    moved = words[200:] + words[:200]
    near = words[:390] + ["x"] * 10
    df = spark.createDataFrame([(" ".join(words), " ".join(near), " ".join(sorted(words, key=lambda w: hashlib.md5(w.encode()).digest())), " ".join(moved))], "a string, b string, c string, d string")
    s = {c: order_minhash.signature(F.col(c)) for c in "abcd"}
    r = df.select(*[order_minhash.likeness(s["a"], s[c]).alias(c) for c in "abcd"]).first()
    assert r.a == 1 and r.b > 0.8 > r.d > r.c


def test_mixing(docs, rows, empty):
    plan = mixing.mix(docs).collect()
    assert len(plan) == len(rows) and all(r.taken <= 2 * r.size and r.taken == r.copies * r.size for r in plan)
    assert sorted(map(str, plan)) == sorted(map(str, mixing.mix(docs.repartition(5)).collect()))
    by_target = defaultdict(list)
    for r in plan:
        by_target[(r.source_size, r.target)].append(r)
    assert sum(t for _, t in by_target) == pytest.approx(1.5 * sum(len(tokens(r[1])) for r in rows))
    for (_, target), found in by_target.items():
        assert abs(sum(r.taken for r in found) - target) <= max(r.size for r in found) / 2 + 1
    assert mixing.apply_mix(docs).columns == docs.columns and mixing.mix(empty).count() == 0 and mixing.apply_mix(empty).count() == 0


def test_applied_mix_is_the_plan(docs):
    """Clashing columns, rows without id, repeated rows: each row as often as the plan says, with its values."""
    clashing = docs.withColumns({c: F.lit("mine") for c in ("_words", "_copies", "_copy", "__measure", "m", "p", "size")})
    applied = mixing.apply_mix(clashing)
    assert applied.columns == clashing.columns and applied.filter("_words <> 'mine' or __measure <> 'mine' or size <> 'mine'").count() == 0
    plan = Counter()
    for r in mixing.mix(docs).collect():
        plan[(r.doc_id, r["size"])] += r.copies
    got = Counter((r.doc_id, len(tokens(r.text))) for r in applied.collect())
    assert got == +plan


def test_mixing_draws_by_inclusion(spark):
    """Over many seeds a document is taken as often as its expected copies say; repeated rows at the end are cut apart."""
    n = 120
    docs = spark.createDataFrame([(i, "w " * (1 + i % 12 * 40), "a") for i in range(n)], "doc_id long, text string, source string").cache()
    copies, seeds = Counter(), 8
    for seed in range(seeds):
        for r in mixing.mix(docs, (1,), budget=0.8, cap=2.0, seed=f"s{seed}").collect():
            copies[r["size"]] += r.copies
    mean = {s: c / (seeds * n / 12) for s, c in copies.items()}
    size = lambda k: 1 + k % 12 * 40
    words = sum(size(i) for i in range(n))
    level = 0.8 * words / sum(size(i) * len(bin(size(i))[2:]) for i in range(n))
    for s, m in mean.items():
        assert m == pytest.approx(min(2, level * len(bin(s)[2:])), abs=0.2)
    assert mean[441] > mean[1] + 0.3
    same = spark.createDataFrame([(7, "x y z", "a")] * 50, "doc_id long, text string, source string")
    taken = mixing.mix(same, (1,), budget=0.5).agg(F.sum("taken")).first()[0]
    assert abs(taken - 75) <= 1.5 and mixing.apply_mix(same, (1,), budget=0.5).count() == taken / 3
    weighed = docs.withColumn("grade", F.when(F.col("doc_id") % 2 == 0, 3.0).otherwise(1.0))
    found = {r.doc_id: r.copies for r in mixing.mix(weighed, (1,), budget=1.0, weight="grade").collect()}
    assert sum(v for k, v in found.items() if k % 2 == 0) > 2 * sum(v for k, v in found.items() if k % 2)


def test_sharding(docs, rows, empty):
    names = [f"s{i}" for i in range(7)]
    table = sharding.lookup_table(names, 1009)
    share = Counter(table)
    assert set(share) == set(range(7)) and max(share.values()) - min(share.values()) <= 1
    fewer = sharding.lookup_table(names[:-1], 1009)
    assert sum(a != b for a, b in zip(table, fewer, strict=True)) < 1009 * 0.35
    prefer = [[(sharding._number(s, "offset") % 1009 + j * (sharding._number(s, "skip") % 1008 + 1)) % 1009 for j in range(1009)] for s in names]
    plain, turn = [None] * 1009, 0
    while None in plain:
        plain[next(x for x in prefer[turn % 7] if plain[x] is None)] = turn % 7
        turn += 1
    assert table == plain
    placed = sharding.shard(docs, names, 1009).collect()
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    for r in placed:
        key = str(r.doc_id) if r.doc_id is not None else f"text:{r.text}"
        assert r.slot == signed(xxhash.xxh64_intdigest(key.encode(), 42)) % 1009
    assert len(placed) == len(rows) and all(r.shard == names[table[r.slot]] for r in placed)
    assert sharding.shard(empty).count() == 0


signed = lambda h: h - (1 << 64) if h >> 63 else h
chain = lambda xs, h=42: h if not xs else chain(xs[1:], signed(xxhash.xxh64_intdigest(xs[0] if isinstance(xs[0], bytes) else (xs[0] & (1 << 64) - 1).to_bytes(8, "little"), h & (1 << 64) - 1)))
chain32 = lambda k, occurrence: signed(xxhash.xxh64_intdigest((occurrence & 0xFFFFFFFF).to_bytes(4, "little"), chain([k]) & (1 << 64) - 1))

def plain_signature(text):
    words = re.split(r"[\x20\x09-\x0D]+", text)
    units = []
    for w in words:
        if len(w) > order_minhash.LONG:
            runs = [chain([c.encode() for c in w[i : i + order_minhash.SPAN]]) for i in range(len(w))]
            units += [h for h in runs if h % order_minhash.SPAN == 0] or [chain([w.encode()])]
        else:
            units.append(chain([w.encode()]))
    kmers = [chain(units[i : i + 3]) for i in range(len(units))]
    placed = sorted((k & order_minhash._HIGH) | i for i, k in enumerate(kmers))
    times, numbered = Counter(), []
    for x in placed:
        kmer = x >> 32
        numbered.append((chain32(kmer, times[kmer]) & order_minhash._HIGH) | (x & 0xFFFFFFFF))
        times[kmer] += 1
    bins = defaultdict(list)
    for x in sorted(numbered):
        bins[x >> order_minhash._BIN_SHIFT].append(x & 0xFFFFFFFF)
    out = []
    for b in range(order_minhash.BINS):
        places = sorted(bins[b][:2])
        out.append(max(chain([kmers[i] for i in places]) & 0xFFFFFFFF, 1) if places else 0)
    return out


def plain_likeness(a, b):
    filled = [(x, y) for x, y in zip(a, b, strict=True) if x or y]
    return sum(x == y for x, y in filled) / len(filled) if filled else 1.0


def test_order_minhash_signature(spark):
    """The signature recomputed in plain Python, for words, for text without white space, and for texts of both."""
    texts = ["", "a b c", "x " * 300, " ".join(f"w{i % 90}" for i in range(500)), "漢字" * 40 + "かな" * 30, "q" * 200, "short " + "漢字かな" * 20 + " words 𠮷" + "é" * 30 + " " + "a" * 24 + " " + "b" * 25]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: list(r.s) for r in df.select("i", order_minhash.signature(F.col("t")).alias("s")).collect()}
    assert got == {i: plain_signature(t) for i, t in enumerate(texts)}
    same = "".join(chr(0x4E00 + i * 37 % 900) for i in range(400))
    a, b = F.lit(same), F.lit(same[:390] + "xyz")
    assert 0.6 < spark.range(1).select(order_minhash.likeness(order_minhash.signature(a), order_minhash.signature(b))).first()[0] < 1


def test_order_minhash_of_near_copies_around_long_words(spark):
    """Edits of one word leave texts alike, on whichever side of LONG their words are on average."""
    pairs = []
    for size in (22, 23, 24, 25, 26):
        words = [hashlib.sha256(f"{size}:{i}".encode()).hexdigest()[:size] for i in range(301)]
        for last in ("x", "y" * 24, "z" * 25, "w" * 60):
            pairs.append((" ".join(words), " ".join([*words[:-1], last])))
    mixed = [f"w{i}" for i in range(150)] + ["漢字" * 300]
    pairs += [(" ".join(mixed), " ".join([*mixed[:-1], "short"][:150] + ["漢字" * 290 + "かな" * 10])), (" ".join(mixed), " ".join([*mixed[:75], "u" * 40, *mixed[76:]]))]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    likeness = order_minhash.likeness(order_minhash.signature(F.col("a")), order_minhash.signature(F.col("b")))
    found = {r.i: r.x for r in df.select("i", likeness.alias("x")).collect()}
    assert min(x for i, x in found.items() if i < 20) > 0.9 and min(found.values()) > 0.6, found


def test_order_minhash_query_likenesses(spark, docs, rows):
    """near_edited and near_next of the query's columns, against plain ones."""
    found = order_minhash.fingerprints(docs.filter("doc_id is not null").dropDuplicates(["doc_id"]))
    found = found.select("doc_id", order_minhash.likeness(F.col("signature"), F.col("edited_signature")).alias("e"), order_minhash.likeness(F.col("signature"), F.col("next_signature")).alias("n"))
    ordered = sorted({r[0]: r[1] or "" for r in reversed(rows) if r[0] is not None}.items())
    got = {r.doc_id: (r.e, r.n) for r in found.collect()}
    for (i, t), (_, after) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        own, half = plain_signature(t), len(t) // 2
        assert got[i] == (pytest.approx(plain_likeness(own, plain_signature(t[: len(t) - half] + after[:half]))), pytest.approx(plain_likeness(own, plain_signature(after))))


PAGES = "page_id long, url string, html string, record string"


def test_warc(spark):
    page = "<title>A &amp; B</title><script>no</script><p>Text <b>bold</b><a href='../x'>l</a>"
    rows = [(1, "http://h.example/a/", page, "x"), (2, None, None, "x"), (1, "http://h.example/a/", "", "x"), (1, "http://h.example/a/", page, "x")]
    sources = warc.responses(spark.createDataFrame(rows, PAGES))
    found = warc.derive(sources, keep=["page_id"]).collect()
    ids = [warc.first(warc.parse(r.record)[0], "WARC-Record-ID") for r in sources.collect()]
    assert len(found) == 8 and len(set(ids)) == 4 and {r.refers_to for r in found} == set(ids) and len({r.record_id for r in found}) == 8
    for r in found:
        fields, block = warc.parse(r.record)
        assert warc.first(fields, "WARC-Refers-To") == r.refers_to and warc.first(fields, "WARC-Block-Digest") == warc.digest(block) and warc.first(fields, "WARC-Target-URI") == r.target
    meta = next(r for r in found if r.type == "metadata" and b"A & B" in r.record)
    assert b'"http://h.example/x"' in meta.record
    text = next(warc.parse(r.record)[1].decode() for r in found if r.type == "conversion" and b"bold" in r.record)
    assert text == "A & B\nText boldl"
    assert warc.derive(warc.responses(spark.createDataFrame([], PAGES))).count() == 0


@pytest.mark.parametrize("packed", [False, True])
def test_warc_files(spark, tmp_path, packed):
    """Response records of a file: fields in order, repeated names, own date and digest, codings; written and read again."""
    body = "<p>caf\xe9".encode("latin-1")
    http = b"HTTP/1.1 200 OK\r\nSet-Cookie: a=1\r\nSet-Cookie: b=2\r\nX-Empty:\r\nContent-Type: text/html; charset=ISO-8859-1\r\nTransfer-Encoding: chunked\r\n\r\n"
    chunked = b"3\r\n" + body[:3] + b"\r\n%x\r\n" % len(body[3:]) + body[3:] + b"\r\n0\r\n\r\n"
    records = [
        warc.serialise([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<urn:uuid:0>")], b"software: x\r\n"),
        warc.serialise([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:uuid:1>"), ("WARC-Target-URI", "http://x/"), ("WARC-Date", "2020-02-02T02:02:02Z"), ("WARC-Payload-Digest", "sha1:GIVEN")], http + chunked),
        warc.serialise([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:uuid:2>")], b"HTTP/1.1 404 Not Found\r\n\r\n"),
    ]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / ("a.warc.gz" if packed else "a.warc")).write_bytes(b"".join(gzip.compress(r) for r in records) if packed else b"".join(records))
    found = warc.derive(warc.read_warc(spark, str(tmp_path / "in")), keep=["path"])
    rows = {(r.refers_to, r.type): r for r in found.collect()}
    assert sorted(rows) == [("<urn:uuid:1>", "conversion"), ("<urn:uuid:1>", "metadata"), ("<urn:uuid:2>", "conversion"), ("<urn:uuid:2>", "metadata")]
    fields, block = warc.parse(rows[("<urn:uuid:1>", "metadata")].record)
    assert warc.first(fields, "WARC-Date") == "2020-02-02T02:02:02Z" and warc.first(fields, "WARC-Payload-Digest") == "sha1:GIVEN"
    about = json.loads(block)
    assert about["http"][:3] == [["Set-Cookie", "a=1"], ["Set-Cookie", "b=2"], ["X-Empty", ""]] and about["status"] == "HTTP/1.1 200 OK"
    assert warc.parse(rows[("<urn:uuid:1>", "conversion")].record)[1].decode() == "café"
    warc.write_warc(found, str(tmp_path / "out"))
    written = b"".join(gzip.decompress(f.read_bytes()) for f in sorted((tmp_path / "out").glob("part*")))
    assert sorted(warc._split(iter([written[:100], written[100:]]))) == sorted(r.record[:-4] for r in rows.values())
