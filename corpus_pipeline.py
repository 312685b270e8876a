"""From raw documents to packed sequences of clean, distinct training text.

Each stage works on all that the one before it kept, is written as Parquet and
read again. The stages call the operators of ``attesta.llm``:

1. toxicity        documents that score 0.3 or more go
2. line_dedup      lines that an earlier document holds go
3. ngram_join      one document of each class of near copies stays
4. decontaminate   documents that hold a passage of the benchmark go
5. packing         what is left, as pieces in sequences of at most 4096 tokens
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from attesta.llm import _store, decontaminate, line_dedup, ngram_join, packing, toxicity
from attesta.llm.registry import tokenizer

TOXIC = 0.3
#: Word shingles and similarity of near copies.
SHINGLE, SIMILAR = 5, (4, 5)
CAPACITY, END = 4096, 1


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.clean(docs, toxicity.fitted(docs, labels), TOXIC)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.deduplicated(docs, length_col="n_chars")


def one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.distinct(docs, SHINGLE, *SIMILAR)


def not_in_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs, tokenizer("word_bpe_49k.json"), CAPACITY, END)


STAGES = [
    ("toxicity", not_toxic),
    ("line_dedup", without_repeated_lines),
    ("ngram_join", one_of_each_class),
    ("decontaminate", not_in_benchmark),
    ("packing", sequences),
]

#: Learning, similarity classes and tokenizing are beyond SQL; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other; the last one's rows.

    A stage's table goes once the next one is written; the last one's goes with
    the session.
    """
    now, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = _store.temporary(spark, f"pipeline-{name}")
        stage(spark, now, sf_dir).write.parquet(path)
        if before:
            _store.delete(spark, before)
        now, before = spark.read.parquet(path), path
    return now
