"""The corpus pipeline: documents from raw rows to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the caller writes it as
Parquet and hands what it reads back to the next.  All but the last return the columns
of ``documents``, whatever those are called.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, near_dedup, packing, quality, substrings
from .common import discard, fresh, materialize, table


def aside(docs: DataFrame, names: Sequence[str]) -> tuple[dict[str, str], DataFrame]:
    """``docs`` with columns of the given names renamed, and how to rename them back."""
    back = {fresh(docs, f"aside_{c}"): c for c in names if c in docs.columns}
    return back, docs.withColumnsRenamed({c: new for new, c in back.items()})


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the discriminant doesn't reject.

    It is fitted on at most ``quality.MAX_LABELLED`` labelled documents of the training fold
    and judges every document.  Null and empty texts are judged like any other, by their
    statistics; repeated rows and rows with a null doc_id are judged each on its text, so
    equal texts share their fate; with no labels nothing is rejected; an empty table stays empty.
    """
    return quality.keep_good(docs, quality.train_bounded(docs, table(spark, sf_dir, "labels")))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five words, 0.8): that of the smallest doc_id, null last.

    Rows are told apart by doc_id and text together (128 bits of both), so rows that share a
    doc_id or have none are judged each on its own text; exactly repeated rows are one
    document; null and empty texts are in no group and stay; an empty table stays empty.
    """
    key = fresh(docs, "key")
    part = lambda c: F.concat(F.when(F.col(c).isNull(), "-").otherwise("+"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("\0"))
    named = docs.withColumn(key, F.unhex(F.md5(F.concat(part("doc_id"), part("text")).cast("binary"))))
    groups = near_dedup.near_duplicates(named.select(F.col(key).alias("doc_id"), "text"), k=5, threshold=80)
    found = materialize(groups.select(F.col("doc_id").alias(key), "component_id").distinct(), "groups")
    first = found.join(named.select(key, "doc_id").distinct(), key).groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", F.col(key).alias("name"))).alias("first"))
    kept = first.select(F.col("first.name").alias(key))
    return named.join(kept, key, "left_semi").dropDuplicates([key]).select(docs.columns)


def cut_repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without sentences of repeated spans; documents of which nothing is left go.

    Null and empty texts have no sentences and stay as they are; n_chars, where it is there,
    follows the text; an empty table stays empty.
    """
    own, docs = aside(docs, ("n_sentences", "n_removed"))
    out = substrings.dedup_substrings(docs).where("n_removed = 0 or length(trim(text)) > 0").drop("n_sentences", "n_removed")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.withColumnsRenamed(own)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs.

    Null and wordless texts have no window and stay; repeated rows share their fate; an empty
    benchmark drops nothing; an empty table stays empty.
    """
    own, docs = aside(docs, decontaminate.ADDED)
    return decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark")).where("n_hit = 0").select(docs.columns).withColumnsRenamed(own)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens; a null text is the single closing id, repeated rows are packed each."""
    return packing.pack(docs)


STAGES = [
    ("quality", reject_low_quality),
    ("near_dedup", keep_one_of_each_group),
    ("substring_dedup", cut_repeated_spans),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again; a table that the next stage has read is deleted."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
