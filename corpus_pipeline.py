"""Training-corpus pipeline: five operators over ``documents``, in order.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; its output
is written as Parquet and read again as the next stage's ``docs``. All stages
but the last return the columns of ``documents``; extra columns of the input
are left out, null and empty texts follow each operator's own rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perilscope.llm import decontam, jaccard_join, quality_rules, secret_scan
from perilscope.llm.queries import ship, table, token_digests
from perilscope.session import stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """4: documents that the quality rules reject go."""
    ship(spark)
    docs = docs.select(*COLUMNS)
    cutoffs = quality_rules.fit_cutoffs(
        quality_rules.measure(docs, ["doc_id", "lang"]), table(spark, sf_dir, "labels"))
    judged = quality_rules.judge(quality_rules.measure(docs, COLUMNS),
                                 stage(cutoffs, "pipeline-cutoffs"))
    return judged.where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """2: of each class of near duplicates the first document stays (of rows
    that agree in id and text, one)."""
    ship(spark)
    docs = docs.select(*COLUMNS)
    found = jaccard_join.jaccard_join(docs)
    out = (found.where(~F.col("first_of_class"))
           .select(F.col("doc_id").alias("__d"), F.col("text_hash").alias("__h"))
           .distinct())
    hashed = docs.withColumn("__t", F.xxhash64("text"))
    return (hashed.join(out, F.col("doc_id").eqNullSafe(F.col("__d"))
                        & (F.col("__t") == F.col("__h")), "left_anti")
            .dropDuplicates(["doc_id", "__t"]).select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """10: documents that hold a benchmark item go."""
    docs = docs.select(*COLUMNS)
    leaks = decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return (decontam.mark(docs, leaks).where(F.size("leaked_items") == 0)
            .select(*COLUMNS))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """9: every secret is replaced by a mask; ``n_chars`` follows the text."""
    docs = docs.select(*COLUMNS)
    found = stage(secret_scan.scan(docs, []), "pipeline-secret-tokens")
    least = secret_scan.discoveries(found)
    spans = secret_scan.all_spans(least)
    text = secret_scan.redact(F.col("text"), F.col("spans"))
    return (secret_scan.scan(docs, COLUMNS).withColumn("spans", spans)
            .select("doc_id", text.alias("text"), "lang", "source", "spans", "n_chars")
            .withColumn("n_chars", F.when(F.size("spans") == 0, F.col("n_chars"))
                        .otherwise(F.length("text")).cast("bigint"))
            .select(*COLUMNS))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """6: the ids of every text, with their count and the digests of the ids and
    of the decoded bytes."""
    ship(spark)
    return token_digests(docs)


STAGES = [
    ("quality rules", quality),
    ("n-gram jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secrets),
    ("byte-level bpe", tokens),
]

# The join and the tokenizer have no SQL form; tests check the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is staged in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, fn in STAGES[:-1]:
        docs = stage(fn(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
