"""The queries of the corpus operators, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _store, ann, decontaminate, distance_keys, license_scan, line_dedup, metric_tree, ngram_join, oracles, packing, periodic_runs, sharding, substring_dedup, token_files, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    """The path of a public tokenizer's file, as installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark."""
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents whose 4-word shingles have a Jaccard similarity of 0.85 or more."""
    return ngram_join.joined(_table(spark, sf_dir, "documents"), n=4, p=85, q=100)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases, labels and expressions of every document."""
    return license_scan.licenses(_table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens."""
    return packing.packed(_table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), capacity=4096, end_id=1)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labelled ones that are not held out."""
    docs = _table(spark, sf_dir, "documents")
    found = toxicity.scored(docs, toxicity.fitted(docs, _table(spark, sf_dir, "labels")))
    return found.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors found of every vector whose id is divisible by 20."""
    return ann.nearest(_table(spark, sf_dir, "embeddings"), k=20, every=20)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 13-word passages that start in an earlier one."""
    found = substring_dedup.repeats_removed(_table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return found.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document among 16, and among 17."""
    return sharding.sharded(_table(spark, sf_dir, "documents"), shards=16)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that an earlier one holds."""
    found = line_dedup.line_dedup(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as read back from entropy-coded files of token ids."""
    path = _store.temporary(spark, "tokens")
    token_files.write(_table(spark, sf_dir, "documents"), path, tokenizer("byte_bpe_50k.json"), end_id=2)
    return token_files.read(spark, path, with_ids=False).drop("ids")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector and its positives, with every seventh label off by one."""
    noisy = F.when(F.pmod("vec_id", F.lit(7)) == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return distance_keys.hard_negatives(_table(spark, sf_dir, "embeddings").withColumn("label", noisy))


def op12_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best of every hundredth vector among all others."""
    return metric_tree.nearest(_table(spark, sf_dir, "embeddings"), k=10, every=100, scale=1024).drop("distances")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of at least four periods in every document, and its text without their repeats."""
    found = periodic_runs.periodic_runs(periodic_runs.with_planted_periods(_table(spark, sf_dir, "documents")))
    best = F.col("strongest")
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(best[c].alias(c) for c in ("start", "length", "period")),
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_decontaminate,
        op2_ngram_join,
        op3_license_scan,
        op4_best_fit_packing,
        op5_toxicity,
        op6_nearest,
        op7_substring_dedup,
        op8_sharding,
        op9_line_dedup,
        op10_token_files,
        op11_hard_negatives,
        op12_exact_top_k,
        op13_periodic_runs,
    )
}
ORACLES: dict[str, str] = dict(oracles.ORACLES)
