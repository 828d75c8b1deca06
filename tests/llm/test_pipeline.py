"""The pipeline from end to end, against plain versions of its stages where there are any."""

import os
import re
import urllib.parse
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sedgeline.llm import decontamination, language_id, mixing


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("tables"))
    words = {"en": "the of and that with this from have", "de": "der die und das nicht ist ein zu", "fr": "le la les des que dans pour une", "es": "el los que una por con las se"}
    item = " ".join(f"exam{i}" for i in range(14))
    rows = []
    for i in range(80):
        lang = list(words)[i % 4]
        own = words[lang].split()
        rows.append((i, " ".join(own[(i * k) % 8] + (f" u{i}x{k}" if k % 3 == 0 else "") for k in range(1, 90)), lang, ["a", "b", None][i % 3]))
    long = " ".join(f"t{k}" for k in range(200))
    rows += [(100, long, "en", "a"), (101, long, "en", "b"), (102, long.replace("t7 ", "s7 "), None, "a"), (103, f"before {item} after", "en", "a")]
    rows += [(104, None, "en", "a"), (105, "12 34", "en", "a"), (106, "", None, None), (100, long, "en", "a"), (None, "no number here at all", "en", "b")]
    docs = spark.createDataFrame([(*r, len(r[1] or ""), "kept", 7) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, _key string, lang_pred long")
    docs.write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out


def test_run(spark, folder):
    got = corpus_pipeline.run(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert got.columns == [*docs.columns, "slot", "shard"] and got.filter("_key <> 'kept' or lang_pred <> 7").count() == 0
    # Of the stages' copies of the corpus only the last is left.
    [run] = {os.path.dirname(os.path.dirname(urllib.parse.urlparse(f).path)) for f in got.inputFiles()}
    assert os.listdir(run) == ["4-sharding"]
    rows = got.collect()
    ids = {r.doc_id for r in rows}
    # Without letters: gone. Of the copies one stays, that of the least id. The benchmark's passage is gone.
    assert not ids & {104, 105, 106, 101, 102, 103}
    for r in rows:
        assert re.search(r"[^\W\d_]", r.text)
    # One document of each group goes into the mix, as often as the mix of what is left takes it.
    left = docs.filter(language_id.has_letter("text")).dropDuplicates(["doc_id", "text"]).filter("doc_id is null or doc_id not in (101, 102)")
    left = decontamination.clean(left, spark.read.parquet(f"{folder}/benchmark.parquet"))
    plan = Counter()
    for r in mixing.mix(left).collect():
        plan[(r.doc_id, r["size"])] += r.copies
    assert Counter((r.doc_id, len(re.findall(r"[^\x20\x09-\x0D]+", r.text))) for r in rows) == +plan
    assert len({(r.doc_id, r.shard) for r in rows}) == len(ids)


def test_empty_tables(spark, folder, tmp_path):
    docs, bench = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    bench.limit(0).write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    stage = dict(corpus_pipeline.STAGES)["decontamination"]
    assert stage(spark, docs, str(tmp_path)).count() == docs.count()


def test_stages_keep_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("slot", F.lit("s"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns, name


def test_batches_are_small(spark, folder):
    """Long texts go to Python in batches of a few MB, not of the 64 MB that Spark would send; a smaller setting of the session holds."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = spark.conf.get(name)
    try:
        for stage in (corpus_pipeline.language_stage, corpus_pipeline.near_duplicate_stage):
            spark.conf.unset(name)
            stage(spark, docs, folder)
            sizes = spark.range(24, numPartitions=1).select(F.repeat(F.lit("a"), 1 << 20).alias("text"))
            sizes = sizes.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n long")
            assert max(r.n for r in sizes.collect()) <= 2 * corpus_pipeline.BATCH_BYTES
            spark.conf.set(name, "1000")
            stage(spark, docs, folder)
            assert spark.conf.get(name) == "1000"
    finally:
        spark.conf.set(name, before)


def test_machine_of_rows_in_any_order():
    """A pair's machine is the same whatever the order and the chunks of its rows."""
    rng = np.random.default_rng(3)
    at = [np.sort(rng.choice(language_id.FEATURES, 40, replace=False)).astype(np.uint16) for _ in range(30)]
    value = [rng.random(40).astype(np.float16) for _ in at]
    side = [1 if i % 2 else -1 for i in range(30)]
    table = pa.table({"machine": ["m"] * 30, "side": pa.array(side, pa.int32()), "lang": ["a" if s > 0 else "b" for s in side], "text_hash": list(range(30)), "at": [x.tobytes() for x in at], "value": [x.tobytes() for x in value]})
    order = sorted(range(30), key=lambda i: (-side[i], i))
    x = np.zeros((30, language_id.FEATURES), np.float32)
    for i, k in enumerate(order):
        x[i, at[k]] = value[k]
    w, b = language_id._machine(x, np.array([side[k] for k in order], np.float32))
    w = w.astype(np.float32)
    mixed = table.take(rng.permutation(30))
    for rows in (table, mixed, pa.concat_tables([mixed.slice(0, 7), mixed.slice(7)])):
        [got] = language_id._train_one(rows).to_pylist()
        assert np.array_equal(np.frombuffer(got["weights"], np.float32), w) and got["bias"] == b
