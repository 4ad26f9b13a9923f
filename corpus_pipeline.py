"""A corpus in five stages: language ID, exact dedup, near dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; all but the last return the columns of documents.

Defined cases: null texts and texts without a letter go in the first stage; null ids are kept and judged row by row (near copies of them are not looked for); of rows that repeat id and
text one stays; further columns pass through, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm import exact_dedup, language_id, mixing, near_dedup, packing
from spindrift.llm.common import fold_of
from spindrift.staging import drop, stage, staged

#: Documents whose best language is less likely than this are rejected, as are those with no letter: a word or two that could be of any language.
LEAST_SCORE = 0.4


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known with some certainty stay; all go if nothing can be learnt from."""
    net = language_id.train(docs.where(fold_of("doc_id", 4) != 2))
    found = language_id.identify(docs.select(F.struct("*").alias("_row"), "text"), net)
    kept = found.where((F.col("lang_pred") != "und") & (F.col("lang_score") >= LEAST_SCORE))
    return kept.select(*(F.col(f"_row.`{c}`").alias(c) for c in docs.columns))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (white space aside) the document with the smallest id stays, null ids being the largest."""
    return exact_dedup.dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays; those with a null id all stay."""
    return near_dedup.dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, none or up to twice; a null source is one of its own."""
    return mixing.mix(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 1024 tokens: a row for each piece of each copy."""
    import public_tokenizers

    return packing.pack(docs, str(public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

#: SQL can't express a recurrent network's predictions, MinHash groups or differencing; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents; each result is written as Parquet and read again for the next. What only an earlier stage read is removed."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), staged()
    for name, step in STAGES[:-1]:
        docs, path = stage(step(spark, docs, sf_dir), name)
        drop(spark, *(staged() - before - {path}))
    return STAGES[-1][1](spark, docs, sf_dir)
