"""What the operators of this subpackage share: staged tables, bounded samples, Arrow maps."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship
from ..staging import clear, drop, shared_dir, stage  # noqa: F401

#: What counts as white space in every contract: the space and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Labelled texts of more characters are not learnt from, so that a sample is bounded in bytes too; every text is still judged in whole.
LEARNT = 100_000


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Before Python runs on executors: the package is sent there, and as texts may be long, Arrow batches hold fewer rows than the default."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(rows))


def fold_of(column: str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; null ids count as the empty string."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def sample_by_class(rows: DataFrame, label: str, per_class: int, *key: str) -> DataFrame:
    """At most per_class rows of each class, chosen by the hash of their key: a bounded sample to fit models on.

    A first threshold on the hash leaves about twice as many rows as are wanted, so that the window
    over a class never holds more than a bounded number of rows, however many the class has. Classes are measured by their distinct
    hashes, and rows that share a hash count as one: repeated or null keys neither empty the sample nor swell it.
    """
    rows = rows.withColumn("_h", F.xxhash64(*key, F.lit("sample")))
    sizes = rows.groupBy(label).agg(F.approx_count_distinct("_h", 0.02).alias("_sizes")).withColumnRenamed(label, "_class")
    kept = (
        rows.join(F.broadcast(sizes), F.col(label) == F.col("_class"))
        .where(F.pmod(F.col("_h"), F.lit(1 << 20)) < F.lit((1 << 20) * 2.0 * per_class) / F.col("_sizes") + F.lit(64))
        .dropDuplicates([label, "_h"])
    )
    w = Window.partitionBy(label).orderBy("_h")
    return kept.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= per_class).drop("_h", "_rank", "_class", "_sizes")


def sample_of(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """doc_id, _label and text of the documents whose id was chosen (_id, _label), none of more than LEARNT characters; of rows that share an id the least text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = docs.select("doc_id", text.alias("text")).where(F.length("text") <= LEARNT).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    return found.groupBy("doc_id", "_label").agg(F.min("text").alias("text"))


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """mapInArrow of a function from batch to batch; it may return None for an empty one."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := fn(batch)) is not None:
                yield out

    return df.mapInArrow(over, schema)


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned crc32 of a text's UTF-8 bytes, which has no function there."""
    byte = f"list_transform(range(0, strlen({text})), lambda j: CAST('0x' || substr(hex(encode({text})), CAST(2 * j + 1 AS BIGINT), 2) AS BIGINT))"
    shifted = "list_reduce(list_concat([xor(c, b)], range(0, 8)), lambda y, j: xor(y >> 1, 3988292384 * (y & 1)))"
    return f"xor(list_reduce(list_concat([4294967295], {byte}), lambda c, b: {shifted}), 4294967295)"
