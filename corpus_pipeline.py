"""The training-corpus pipeline: quality, near duplicates, repeated passages, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; all but the last return the columns of documents. run() writes each
stage's result to the shared folder and reads it again. Null ids, null and
empty texts: those without words fall to the quality rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.llm import decontaminate, jaccard, packing, quality, substring
from memlake.llm.common import partitions_for, quoted, staged
from memlake.llm.queries import table, tokenizer_path
from memlake.session import ship


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; each row by its own text, so repeated rows stay or go together, and an empty table stays empty. Null texts go."""
    ship(spark)
    return quality.kept_documents(docs)


def _numbered(docs: DataFrame) -> DataFrame:
    """key (ascending with doc_id, one for each row) and the row, doc; in the shared folder."""
    order = [F.col("doc_id"), F.xxhash64("text")]
    rows = docs.repartitionByRange(partitions_for(docs, 32 << 20), *order).sortWithinPartitions(*order)
    return staged(rows.select(F.monotonically_increasing_id().alias("key"), F.struct(*map(quoted, docs.columns)).alias("doc")))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id, once.

    Rows without id stay. Rows that share an id are documents of their own here, so
    of unlike texts under one id each stays, and of like ones the first. Null and
    empty texts are like nothing and stay. An empty table stays empty.
    """
    ship(spark)
    named = docs.filter("doc_id IS NOT NULL")
    if named.groupBy("doc_id").count().filter("count > 1").isEmpty():
        rows, key = named, "doc_id"
        found = jaccard.near_duplicates(named)
    else:
        rows, key = _numbered(named), "key"
        found = jaccard.near_duplicates(rows.select(F.col("key").alias("doc_id"), F.col("doc")["text"].alias("text")))
    first = staged(found.filter("doc_id = component_id").select(F.col("doc_id").alias(key)))
    kept = rows.join(F.broadcast(first) if first.count() <= jaccard.BROADCAST_IDS else first, key, "left_semi")
    kept = kept.select("doc.*") if key == "key" else kept.select(*map(quoted, docs.columns))
    return kept.union(docs.filter("doc_id IS NULL"))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that a smaller id has too; rows with one id don't take from each other. Texts without words go, an empty table stays empty."""
    ship(spark)
    return substring.remove_repeats(docs, output="texts")


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window; each row by its own text. Null and empty texts stay, an empty table stays empty."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences; repeated rows are packed each. A null text is its end id, an empty table has no pieces."""
    ship(spark)
    return packing.packed_documents(docs, tokenizer_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("jaccard_join", jaccard_join),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: SQL has no suffix arrays, tokenizers or packing by linear programs.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
