"""Hard negatives, fill-in-the-middle and SentencePiece against plain versions and the library."""

import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sedgeline.llm import fill_in_middle, hard_negatives, sentencepiece_bpe

VECTORS = "vec_id long, label int, embedding array<float>, id string, d int, anchor string"


def plain_negatives(rows, every, positives=5, negatives=3, low=50, high=95):
    finite = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    rows = [(i, l, tuple(math.floor(256 * x) for x in v)) for i, l, v in rows if i is not None and l is not None and finite(v)]
    out = []
    for i, label, v in {r for r in rows if r[0] % every == 0}:
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=False)), j, m) for j, m, w in rows)
        for score, j in [(-s, j) for s, j, m in scored if m == label and j != i][:positives]:
            others = [(-s, k) for s, k, m in scored if m != label and low * score <= -100 * s <= high * score][:negatives]
            out += [(i, j, r + 1, k, score, s) for r, (s, k) in enumerate(others)]
    return sorted(out)


def mined(spark, rows, every=10, **options):
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], VECTORS).repartition(5)
    return sorted(tuple(r) for r in hard_negatives.mine(df, F.col("vec_id") % every == 0, **options).collect())


@pytest.fixture(scope="module")
def vectors():
    base = np.random.default_rng(5).normal(size=(200, 6)).astype(np.float32).astype(float).tolist()
    rows = [(i, i % 4, base[i]) for i in range(200)]
    rows += [(200 + i, i % 3, base[3]) for i in range(150)]  # copies: ties of scores, a hot vector
    rows += [(5, 1, None), (6, None, [1.0] * 6), (7, 1, [1.0, None, 2.0]), (None, 1, [1.0] * 6), (8, 1, [math.nan] * 6), (10, 1, [math.inf] * 6)]
    return rows + [(20, 2, []), (21, 2, [1.0, 2.0]), (0, 0, base[0]), (10, 3, base[11]), (11, 1, base[11])]


def test_hard_negatives(spark, vectors):
    assert mined(spark, vectors) == plain_negatives(vectors, 10)
    got = mined(spark, vectors, positives=2, negatives=1, low=20, high=100)
    assert got == plain_negatives(vectors, 10, 2, 1, 20, 100)


def test_hard_negatives_in_small_blocks(spark, vectors, monkeypatch):
    for name, value in (("BLOCK_BYTES", 1 << 12), ("BLOCK_ROWS", 16), ("ROWS_AT_ONCE", 7), ("ANCHORS_AT_ONCE", 5)):
        monkeypatch.setattr(hard_negatives, name, value)
    assert mined(spark, vectors) == plain_negatives(vectors, 10)


def test_hard_negatives_of_long_vectors(spark, vectors):
    far = [(i, l, v and [None if x is None else float(np.float32(x * 1e6)) for x in v]) for i, l, v in vectors]
    assert mined(spark, far) == plain_negatives(far, 10)  # beyond what doubles hold exactly
    with pytest.raises(ArithmeticError):
        mined(spark, [(10, 1, [1e30]), (1, 1, [1.0])])


def test_hard_negatives_of_few_rows(spark):
    for rows in ([], [(3, 1, [1.0])], [(10, 1, [1.0])], [(10, 1, [])] * 3, [(10, None, [1.0])]):
        assert mined(spark, rows) == []


def test_pivots_bracket_every_score_and_leave_rows_out():
    rng = np.random.default_rng(1)
    centres = rng.integers(-2000, 2000, (6, 8))
    rows = np.concatenate([c + rng.integers(-40, 40, (300, 8)) for c in centres]).astype(np.float64)
    most = float((rows**2).sum(1).max())
    points = hard_negatives._augmented(rows, most)
    pivots = hard_negatives.choose_pivots(points, hard_negatives.PIVOTS)
    anchors = rows[::50]
    at = hard_negatives._distances(hard_negatives._augmented(anchors, most, anchors=True), pivots).astype(np.float32)
    d = hard_negatives._distances(points, pivots).astype(np.float32)
    total = (anchors**2).sum(1) + most
    low, high = hard_negatives._reach(d, d, at, total, 2.0 + total.max() * 2.0**-18)
    score = anchors @ rows.T
    assert (low <= score).all() and (score <= high).all()
    fifth = np.sort(score, axis=1)[:, -5, None]
    assert (high < fifth).mean() > 0.3


def plain_middle(key, text, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digits = hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digits[k : k + 8], 16) for k in (0, 8, 16, 24)]
    low, high = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text, text
    parts = f"<S>{suffix}<P>{prefix}<M>{middle}" if h[3] % 100 < spm else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return len(units), "spm" if h[3] % 100 < spm else "psm", len(prefix), len(middle), parts, text


@pytest.mark.parametrize(("rate", "spm"), [(100, 50), (60, 20), (0, 0)])
def test_fill_in_middle(spark, rate, spm):
    rng = random.Random(3)
    texts = [None, "", "\n", "\n\n\n", "a", "a\n", "a<P>b\nc", "x<\nS>\n<S", "é😀\nz\x00q\r\nb c\n", "<\n<P\n<", "line\n" * 50_000, "漢" * 900_000, "漢\n" * 900_000]
    texts += ["".join(rng.choice(["a", "\n", "é", "😀", "<", "P", "S", "M", ">", " ", "\r", "\x85"]) for _ in range(rng.randrange(30))) for _ in range(300)]
    rows = [(i or None, t, "clash", "k") for i, t in enumerate(texts)] + [(3, "\n\n\n", "clash", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string, __key string").repartition(3)
    found = fill_in_middle.fill_in_middle(docs, rate=rate, spm=spm).collect()
    assert len(found) == len(rows)
    for r in found:
        want = plain_middle(r.doc_id, r.text, rate, spm)
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored) == want
        assert r["__key"] == "k"
        assert [r.output_sha256, r.restored_sha256] == [hashlib.sha256(x.encode()).hexdigest() for x in want[4:]]
    digests = fill_in_middle.fill_in_middle(docs, rate=rate, spm=spm, texts=False)
    assert "output" not in digests.columns
    assert sorted(r.output_sha256 for r in digests.collect()) == sorted(r.output_sha256 for r in found)


def test_fill_in_middle_of_words_with_other_marks(spark):
    docs = spark.createDataFrame([(1, "one two  three's"), (2, "[pre]it"), (3, "")], "k long, t string")
    made = fill_in_middle.fill_in_middle(docs, "k", "t", units=r"\S+\s*|\s+", seed="it's", marks=("[pre]", "[suf]", "[mid]"))
    assert {(r.k, r.n, r.restored) for r in made.collect()} == {(1, 3, "one two  three's"), (2, 1, "[pre]it"), (3, 0, "")}
    with pytest.raises(ValueError, match="marks"):
        fill_in_middle.fill_in_middle(docs, "k", "t", marks=("<P<", "<S>", "<M>"))
    assert fill_in_middle.fill_in_middle(docs.limit(0), "k", "t").collect() == []


@pytest.fixture(scope="module")
def tokenizer():
    tokenizers = pytest.importorskip("public_tokenizers")
    library = pytest.importorskip("sentencepiece")
    path = tokenizers.path("piece_bpe_32k.model")
    return path, library.SentencePieceProcessor(model_file=path), sentencepiece_bpe.Model(sentencepiece_bpe._proto(path))


def odd_texts(seed, n):
    rng = random.Random(seed)
    parts = ["a", "b", "e", "t", "h", "in", " ", "  ", "▁", "\n", "1", "é", "漢", "字", "😀", "the", " of", "\x00", "�", "́", "ß", "в", "==", "//"]
    return ["".join(rng.choice(parts) for _ in range(rng.choice([0, 1, 3, 10, 50, 400]))) for _ in range(n)]


LONG_TEXTS = [None, "", " ", "  a", "\tfoo  bar ", "aaaa" * 100, " " * 700 + "x" + "▁ " * 400, "a" * 3000, "漢字かな交じり文" * 300, "ab" * 50_000, "word " * 300_000]


@pytest.mark.parametrize("chunk", [64, sentencepiece_bpe.CHUNK_BYTES])
def test_sentencepiece_arrays(tokenizer, monkeypatch, chunk):
    _, library, model = tokenizer
    monkeypatch.setattr(sentencepiece_bpe, "CHUNK_BYTES", chunk)
    texts = odd_texts(chunk, 400) + (LONG_TEXTS if chunk > 64 else LONG_TEXTS[:9])
    ids = sentencepiece_bpe.encode_array(pa.array(texts, pa.string()), model)
    want = [library.encode(t or "", add_eos=True) for t in texts]
    assert ids.to_pylist() == want
    assert sentencepiece_bpe.decode_array(ids, model).to_pylist() == library.decode(want)


def test_sentencepiece_rounds_and_heap_agree(tokenizer, monkeypatch):
    _, library, model = tokenizer
    texts = [t for t in odd_texts(9, 200)] + ["a" * 300 + "the" * 40, " " * 99]
    for most in (1, 8, 10_000):
        monkeypatch.setattr(sentencepiece_bpe, "LONG", most)
        assert sentencepiece_bpe.encode_array(pa.array(texts), model, end=False).to_pylist() == [library.encode(t) for t in texts]


def test_sentencepiece_decodes_any_ids(tokenizer):
    _, library, model = tokenizer
    rng = random.Random(2)
    ids = [[rng.randrange(400 if rng.random() < 0.7 else 32000) for _ in range(rng.randrange(9))] for _ in range(3000)]
    assert sentencepiece_bpe.decode_array(pa.array(ids, pa.list_(pa.int32())), model).to_pylist() == [library.decode(x) for x in ids]
    whole = [[*b] for b in ([261, 262], [2, 261], [28705, 28705, 261], [])]
    assert sentencepiece_bpe.decode_array(pa.array([*whole, None], pa.list_(pa.int32())), model).to_pylist() == [*[library.decode(x) for x in whole], None]


def test_sentencepiece_frames(spark, tokenizer):
    path, library, _ = tokenizer
    texts = [*LONG_TEXTS, *odd_texts(4, 50), "again", "again"]
    docs = spark.createDataFrame([(i, t, "clash", "k") for i, t in enumerate(texts)], "doc_id long, text string, ids string, __text string").repartition(3)
    found = sentencepiece_bpe.encode(docs, path, decoded="decoded")
    assert found.columns == ["doc_id", "text", "__text", "ids", "decoded"]
    rows = {r.doc_id: r for r in found.collect()}
    for i, t in enumerate(texts):
        want = library.encode(t or "", add_eos=True)
        assert rows[i].ids == want
        assert rows[i].decoded == library.decode(want)
    again = sentencepiece_bpe.decode(found.select("doc_id", "ids", "decoded"), path, text="text").collect()
    assert len(again) == len(texts) and all(r.text == r.decoded for r in again)
    assert sentencepiece_bpe.encode(docs.limit(0), path).collect() == []
