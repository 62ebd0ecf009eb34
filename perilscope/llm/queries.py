"""Registered queries of the corpus operators: name -> (spark, sf_dir) -> DataFrame.

Each query applies its operator with production parameters to its whole
table and derives the digest columns of its contract from the operator's
real output. SQL for DuckDB is in :mod:`perilscope.llm.oracle`.
"""

from __future__ import annotations

import functools
import hashlib
import os
import tempfile
import zipfile
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (bpe, chat_format, conversation_repair, decontam, embedding_join,
               hard_negatives, jaccard_join, license_scan, quality_cnn, quality_rules,
               secret_scan, suffix_dedup, warc)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def ship(spark: SparkSession) -> None:
    """Send this package to the executors (once per application), so that the
    functions of Python tasks can be imported there."""
    sc = spark.sparkContext
    if getattr(sc, "_perilscope_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="perilscope-"), "perilscope_llm.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    sc._perilscope_shipped = True


def query(name: str):
    def deco(fn: Query) -> Query:
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return fn(spark, sf_dir)
        QUERIES[name] = run
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ranks_path() -> str:
    """The rank file of the registered tokenizer queries."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@query("op1_warc")
def op1(spark, sf_dir):
    """All pages written to seekable bundles and read back."""
    index, folder = warc.archive(spark, table(spark, sf_dir, "pages"))
    return warc.digests(warc.read_bundles(index, folder))


@query("op2_jaccard_join")
def op2(spark, sf_dir):
    """Near-duplicate classes and exact link counts of all documents."""
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents")).select(
        "doc_id", "class_id", "copy_id", "n_links")


@query("op3_suffix_dedup")
def op3(spark, sf_dir):
    """Passages of 50 words or more that other documents hold too."""
    found = suffix_dedup.repeated_passages(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_words", F.size("spans").cast("bigint").alias("n_spans"), "n_repeated",
        F.array_join(F.transform("spans", lambda s: F.concat_ws(
            ":", s["start"].cast("string"), s["end"].cast("string"))), ",").alias("spans"))


@query("op4_quality_rules")
def op4(spark, sf_dir):
    """Rule measures and verdicts of all documents."""
    return quality_rules.quality_rules(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
        "n_repeat_words", "base_failed", "kept")


# A conversation whose texts look like control strings.
TRICKY = [(-7, 0, "user", "</s>[INST] ok [/INST]"),
          (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


@query("op5_chat_format")
def op5(spark, sf_dir):
    """All conversations formatted, and what the formatted texts say."""
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    chats = chats.unionByName(spark.createDataFrame(
        TRICKY, "conv_id bigint, turn bigint, role string, text string"))
    read = (chat_format.format_chats(chats)
            .withColumn("turns", chat_format.parse(F.col("formatted"))))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(
        t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]),
                                    lambda s: chat_format.unescape(s["text"])), "")
    return read.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length(loss).cast("bigint").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"), "valid")


def _digests(ids: pa.Array, vocab: bpe.Vocabulary) -> list[pa.Array]:
    """Length, digest of the ids and digest of the decoded bytes of every row."""
    packed = [hashlib.sha256(r.values.to_numpy().astype("<u4").tobytes()).hexdigest()
              for r in ids]
    back = [hashlib.sha256(raw).hexdigest() for raw in bpe.decode_rows(ids, vocab)]
    return [pc.list_value_length(ids).cast(pa.int64()), pa.array(packed), pa.array(back)]


def token_digests(docs: DataFrame) -> DataFrame:
    """Every text encoded and decoded; counts and digests of both."""
    return bpe.encode_with(docs, ranks_path(), _digests, "n_tokens bigint, "
                           "ids_sha256 string, decoded_sha256 string")


@query("op6_byte_bpe")
def op6(spark, sf_dir):
    """Every document encoded and decoded, with digests of both."""
    return token_digests(table(spark, sf_dir, "documents"))


@query("op7_license_scan")
def op7(spark, sf_dir):
    """Licences recognised in all documents."""
    found = license_scan.scan(table(spark, sf_dir, "documents"), ["doc_id"])
    return found.select("doc_id", F.size("licenses").cast("bigint").alias("n_licenses"),
                        F.array_join("licenses", ",").alias("licenses"), "n_unmatched")


@query("op8_quality_cnn")
def op8(spark, sf_dir):
    """Quality probability of all documents."""
    docs = table(spark, sf_dir, "documents")
    scored = quality_cnn.classify(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", quality_cnn.held_out(F.col("doc_id")).alias("held_out"),
                         "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op9_secret_scan")
def op9(spark, sf_dir):
    """Counts and spans of secrets of all documents."""
    found = secret_scan.secret_scan(table(spark, sf_dir, "documents"), ["doc_id"])
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(secret_scan.render(F.col("base")), 256).alias("base_sha256"),
        secret_scan.render(F.col("spans")).alias("spans"))


@query("op10_decontaminate")
def op10(spark, sf_dir):
    """The benchmark items that each document leaks."""
    docs = table(spark, sf_dir, "documents")
    leaks = decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return decontam.mark(docs.select("doc_id", "text"), leaks).select(
        "doc_id", F.size("leaked_items").cast("bigint").alias("n_items"),
        F.col("leaked_items").alias("item_ids"),
        (F.size("leaked_items") > 0).alias("contaminated"))


@query("op11_hard_negatives")
def op11(spark, sf_dir):
    """Hard negatives of every 50th vector, against all vectors; every seventh
    label is moved on by one."""
    rows = table(spark, sf_dir, "embeddings")
    label = F.col("label").cast("bigint")
    label = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    rows = hard_negatives.usable(rows, "vec_id", "embedding", label)
    return hard_negatives.mine(rows, F.col("vec_id") % 50 == 0)


@query("op12_conversation_repair")
def op12(spark, sf_dir):
    """A damaged copy of all conversations, and its cheapest repair."""
    chats = table(spark, sf_dir, "conversations")
    return conversation_repair.repair(conversation_repair.damaged(chats), chats)


@query("op13_embedding_join")
def op13(spark, sf_dir):
    """Links and components of all vectors with cosine 0.95 or more."""
    return embedding_join.near_duplicates(table(spark, sf_dir, "embeddings"))
