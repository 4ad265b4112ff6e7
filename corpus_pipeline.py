"""The corpus pipeline: judge, deduplicate, redact, mix and pack ``documents``, stage by stage.

Each stage gets the table that its predecessor wrote and works on all of it. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm import minhash, mixing, packing, quality, queries, secret_scan
from docquarry.llm.tables import Scratch, sifted, unused


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules' posterior, or the base rules, reject go; null and empty texts are among them.

    Repeated rows are judged alike. Nulls in other columns and extra columns don't matter. An empty table stays empty.
    """
    return quality.keep_good(docs)


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, similarity 0.8) stays: the one with the smallest doc_id.

    Of repeated rows of one doc_id one stays. Rows without doc_id stay, as do null and empty texts, which are like nothing.
    Extra columns don't matter. An empty table stays empty.
    """
    name, maybe = unused("gone", docs), unused("maybe", docs)
    scratch = Scratch(spark, "pipeline-dedup")
    verdicts = scratch.save(minhash.near_duplicates(docs, minhash.MinHashParameters()), "verdicts")
    gone = verdicts.where(~F.col("kept")).select(F.col("doc_id").alias(name)).distinct()
    gone = scratch.save(gone, "gone")
    marked = sifted(docs, "doc_id", gone, maybe)
    doubtful = marked.where(F.col(maybe)).drop(maybe).join(gone.hint("merge"), F.col("doc_id") == F.col(name), "left_anti")
    left = marked.where(~F.col(maybe)).drop(maybe).unionByName(doubtful)
    repeated = verdicts.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(name))
    if repeated.isEmpty():
        return left
    alone = left.join(repeated, F.col("doc_id") == F.col(name), "left_anti")
    return alone.unionByName(left.join(repeated, F.col("doc_id") == F.col(name), "left_semi").dropDuplicates(["doc_id"]))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets become marks; every document stays, with n_chars of its new text.

    Null and empty texts are not touched; a null source is no test path. Repeated rows are redacted alike. Extra
    columns don't matter. An empty table stays empty.
    """
    p = secret_scan.SecretParameters()
    trees = secret_scan.default_forest(spark, p)
    return secret_scan.redact(docs, trees, p).withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, as rows in the order of the mix, which the next stage keeps.

    Null sources are a source of their own. Rows that share doc_id and source stand together. Nulls in other
    columns and extra columns don't matter. An empty table stays empty.
    """
    return mixing.ordered(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and place in it; sequences follow the order of ``docs`` by windows.

    Null and empty texts are one end token. Repeated rows are packed as often as they occur. Other columns don't
    matter. An empty table gives no pieces.
    """
    return packing.pack_in_order(docs, queries.tokenizer_file(), 2048)


STAGES = [
    ("quality_rules", quality_rules),
    ("minhash_dedup", minhash_dedup),
    ("secret_scans", secret_scans),
    ("mix_sources", mix_sources),
    ("best_fit_packing", best_fit_packing),
]

#: Weak supervision, forests and tokenizers have no SQL form; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written as Parquet and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.save(docs, name)
    return docs
