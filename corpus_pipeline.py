"""A training corpus from documents: each stage reads what its predecessor wrote.

Results for odd input: a document whose text is null, empty or without a letter goes at the first stage,
as no language can be told. Of rows that repeat a doc_id and a text, and of all near copies, one stays.
Null doc_ids, langs and sources are kept as they are. Extra columns go through all stages, whatever they
are called, but for slot and shard, which the last stage gives. Empty documents give an empty corpus; an
empty benchmark leaves all documents clean.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedgeline.llm import decontamination, jaccard_join, language_id, mixing, sharding
from sedgeline.llm.common import ensure_checkpoint_dir, fresh


#: Bytes of an Arrow batch that goes to Python. Spark's own bound, 64 MB, is held outside the heap, more than once in each running task.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def _small_batches(spark: SparkSession) -> None:
    """Batches of BATCH_BYTES at most, unless the session's are smaller: what comes of a stage is planned later, so that the setting stays."""
    if int(spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()) > BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a language; those without a letter, of which no language can be told, go."""
    _small_batches(spark)
    model = language_id.train(docs)
    if model is None:
        return docs.filter(language_id.has_letter("text"))
    lang, score = fresh(docs, "lang", "score")
    named = language_id.predict(docs, model, lang_pred=lang, score=score)
    return named.filter(F.col(lang) != language_id.UNKNOWN).drop(lang, score)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of those whose sets of five-word shingles are alike to 0.8 or more."""
    _small_batches(spark)
    return jaccard_join.one_of_each(docs, n=5, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a ten-word window of any benchmark item."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), n=10)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: documents as often as the mix takes them."""
    return mixing.apply_mix(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its slot and shard."""
    return sharding.shard(docs)


STAGES = [
    ("language_id", language_stage),
    ("jaccard_join", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: Linear machines and similarity joins have no SQL; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet to the shared folder and read again; only the last one's copy stays."""
    base = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for number, (name, stage) in enumerate(STAGES):
        written = f"{base}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(written)
        docs = spark.read.parquet(written)
        if before:
            _remove(spark, before)
        before = written
    return docs


def _remove(spark: SparkSession, path: str) -> None:
    """A stage's copy of the corpus goes once its successor is written."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
