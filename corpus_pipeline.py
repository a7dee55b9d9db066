"""A corpus pipeline of five stages, each written as Parquet and read again as the next one's documents.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of ``documents``.
1. toxicity: documents that score 0.5 or more go.
2. line dedup: lines with recurring templates go; every document stays.
3. n-gram Jaccard join: of each group of near copies (five-word shingles, similarity 0.8 or more) the smallest doc_id stays.
4. source mix: documents are taken as often as their source's target weight asks (0 to 3 times, as repeated rows).
5. byte-level BPE: token counts and digests of ids and of what they decode to.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trailmark.llm.bpe import token_digests
from trailmark.llm.common import checkpoint_dir, table
from trailmark.llm.jaccard import near_copies_removed
from trailmark.llm.lines import lines_removed
from trailmark.llm.mixing import mixed_documents
from trailmark.llm.toxicity import toxic_removed


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxic_removed(spark, docs, sf_dir)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines_removed(spark, docs, sf_dir)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies_removed(spark, docs, sf_dir)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, memo=150_000)  # executors still hold what earlier stages left


#: Rows in a batch, at most: between Spark and a Python worker, and of a Parquet reader. Whole texts are long rows, and five stages share an executor's memory.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": 4096, "spark.sql.parquet.columnarReaderBatchSize": 512}


def in_batches(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The stage in a session that has ``BATCHES``, or what it set below them."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for key, most in BATCHES.items():
            if not 0 < int(spark.conf.get(key)) <= most:
                spark.conf.set(key, most)
        return stage(spark, docs, sf_dir)

    return run


STAGES = [(name, in_batches(stage)) for name, stage in (
    ("toxicity", toxicity), ("line dedup", line_dedup), ("n-gram Jaccard join", jaccard_join),
    ("mixing sources to target weights", source_mix), ("byte-level BPE", byte_bpe),
)]

#: Scores of a trained model and similarity components have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, base = table(spark, sf_dir, "documents"), f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{i}")
        docs = spark.read.parquet(f"{base}/{i}")
    return docs
