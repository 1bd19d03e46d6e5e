"""The training-data pipeline: toxic documents go, repeated lines go, one document of each group of
near copies stays, sources are mixed to their weights, and what is left is encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its output is written as Parquet and
read again as the next one's ``docs``. All stages but the last return the columns of ``documents``.

Results: null and empty texts are neither toxic nor near copies, keep their lines, have size 0 and no
tokens; texts are taken whole, however long; of equal rows or ids the operators' own rules decide, which
their modules state (of equal texts the one of the least id stays, ties go to the least text); an empty
table gives an empty table; extra columns are carried to the last stage, whatever their names.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changetrail.llm import byte_bpe, line_dedup, mixing, near_dedup, toxicity
from changetrail.llm.queries import RANKS
from changetrail.llm.storage import Scratch, small_side, table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

# Rows that go to a Python worker at a time: texts are long, and by Spark's default 10,000 of them would
# lie in memory several times over, on both sides.
ROWS_PER_BATCH = 1_000

# Intermediate tables of the stage before. Its output has been written when the next one begins.
_last: list[Scratch] = []


def stage(function: Stage) -> Stage:
    """A stage that first deletes the intermediate tables of the stage before it.

    It leaves the session's rows per Arrow batch at ``ROWS_PER_BATCH``, as its result is lazy.
    """
    @functools.wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _last:
            _last.pop().delete()
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS_PER_BATCH)
        with Scratch(spark) as scratch:
            _last.append(scratch)
            return function(spark, docs, sf_dir)

    return run_stage


def free_names(docs: DataFrame, *names: str) -> tuple[str, ...]:
    """``names``, with underscores before them as far as ``docs`` has columns of these names."""
    taken = {name.lower() for name in docs.columns}
    found = []
    for name in names:
        while name in taken:
            name = f"_{name}"
        found.append(name)
    return tuple(found)


@stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` without those predicted to be toxic. Scores depend on the text alone, so a hash of it
    tells rows without a doc_id apart, and rows of one doc_id too."""
    scored = toxicity.scored_texts(docs, table(spark, sf_dir, "labels"))
    toxic = written(scored.where("predicted = 1").select("digest").distinct(), "toxic")
    return docs.join(small_side(toxic, 16), F.xxhash64(docs["text"]) == toxic["digest"], "left_anti").select(*docs.columns)


@stage
def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` without later similar lines; documents of which nothing is left go."""
    counts = free_names(docs, "n_lines", "n_removed")
    cleaned = line_dedup.dedup_lines(docs, counts=counts)
    changed = F.col(counts[1]) > 0
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        cleaned = cleaned.withColumn("n_chars", F.when(changed, length).otherwise(F.col("n_chars")))
    nothing = changed & ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    return cleaned.where(~nothing).select(*docs.columns)


@stage
def keep_one_near_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one_of_each(docs).select(*docs.columns)


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


@stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_documents(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("minhash_near_dedup", keep_one_near_copy),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]

# Sketches, nearest examples and merges can't be expressed in SQL; tests hold the stages against
# brute force instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, function in STAGES:
        result = function(spark, docs, sf_dir)
        with Scratch(spark) as output:
            docs = written(result, f"stage-{name}")
        if before is not None:
            before.delete()
        before = output
    while _last:
        _last.pop().delete()
    return docs
