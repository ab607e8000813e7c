"""A corpus pipeline: quality rules, near-duplicates, benchmark leaks, mixing, token files."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from aerolens.llm import decontamination, mixing, quality, simhash, token_files
from aerolens.llm.texts import importable
from aerolens.session import remove, scratch, work_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Bytes of texts that go to a Python worker at once, for sessions that set nothing; both sides hold several copies of them.
BATCH_BYTES, BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "8m"


def stage(fn: Stage) -> Stage:
    """A stage whose Python workers can import this package and get texts in batches of BATCH. Its intermediate tables stay, as its
    result reads them; ``run`` knows when they are no longer read. The size of batches stays set, as the result is computed later."""
    @wraps(fn)
    def start(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        importable(spark)
        if spark.conf.get(BATCH_BYTES, None) is None:
            spark.conf.set(BATCH_BYTES, BATCH)
        return fn(spark, docs, sf_dir)
    return start


@stage
def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality.keep_good(docs)


@stage
def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose fingerprints over three-word shingles link at two bits."""
    return simhash.keep_one(docs, most=2, shingle=3)


@stage
def clean_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@stage
def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: a row for each copy, 0 to 2."""
    return mixing.mix_documents(docs)


@stage
def token_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place, length and checksum of each row's ids, as read back from the token files."""
    path = work_path(spark, "pipeline-token-files")
    token_files.write_tokens(docs, path, public_tokenizers.path("word_bpe_49k.json"), 2)
    return token_files.digests(token_files.read_tokens(spark, path))


STAGES: list[tuple[str, Stage]] = [
    ("quality", good_documents),
    ("near_duplicates", distinct_documents),
    ("decontamination", clean_documents),
    ("mixing", mixed_documents),
    ("token_files", token_documents),
]

#: Rolling hashes, XXH64 fingerprints, edit distances and the tokenizer are not SQL; the tests hold run() against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and reread. What a stage read is removed once its own
    output is written; the token files and the last output stay."""
    docs, read = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, one in STAGES:
        path = work_path(spark, f"pipeline-{name}")
        with scratch(spark):
            one(spark, docs, sf_dir).write.parquet(path)
        if read:
            remove(spark, read)
        docs, read = spark.read.parquet(path), path
    return docs
