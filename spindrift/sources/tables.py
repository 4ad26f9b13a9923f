"""Reading and writing tables of spikes, traces and geometry."""

from __future__ import annotations

import math
import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed schemas of the data model.
CHANNELS = "channel INT, x DOUBLE, z DOUBLE"
TRACES = "chunk_id BIGINT, channel INT, t0 BIGINT, v ARRAY<FLOAT>"
SPIKES = "spike_id BIGINT, t BIGINT, t_s DOUBLE, channel INT, label INT, amplitude DOUBLE, x DOUBLE, z DOUBLE, score DOUBLE"
TEMPLATES = "unit INT, channel INT, v ARRAY<FLOAT>"
MOTION = "t_bin DOUBLE, z_bin DOUBLE, disp DOUBLE"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as spikes: spike_id, t (an hour is a million), label (the user), channel (the type), amplitude (the value)."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("spike_id"),
        F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3600).alias("t"),
        F.col("user_id").alias("label"),
        F.col("event_type").alias("channel"),
        F.col("value").alias("amplitude"),
    )


def read_spikes(spark: SparkSession, path: str, features: list[str] | None = None) -> DataFrame:
    """Spikes with the features asked for; columns left out are never read."""
    df = spark.read.parquet(path)
    core = [c for c in ("spike_id", "t", "channel", "label") if c in df.columns]
    return df if features is None else df.select(*core, *(f for f in features if f not in core))


def write_spikes(spikes: DataFrame, path: str, chunk: str | None = None, mode: str = "overwrite") -> None:
    """Parquet, by chunk if asked for, so that chunks can be pruned on reading and written anew one by one."""
    w = spikes.write.mode(mode)
    (w.partitionBy(chunk) if chunk else w).parquet(path)


def with_ids(spikes: DataFrame, order: list[str], to: str = "spike_id") -> DataFrame:
    """A row's number in the given order without a window over the whole table: ranges are sorted apart and offset by the sizes of those before."""
    rdd = spikes.repartitionByRange(*order).sortWithinPartitions(*order).rdd.zipWithIndex()
    schema = T.StructType([*spikes.schema.fields, T.StructField(to, T.LongType())])
    return spikes.sparkSession.createDataFrame(rdd.map(lambda r: (*r[0], r[1])), schema)


def read_binary_traces(spark: SparkSession, path: str, channels: int, samples: int = 30_000, dtype: str = "int16") -> DataFrame:
    """Flat time-major binary recordings (one file) as traces (chunk_id, channel, t0, v), chunks of `samples` and a shorter last one; split by Spark's fixed-length record reader.

    Its records must divide the file, so they are as many samples as divide both a chunk and the recording. Records of a chunk that lie in one task are put together there; only chunks
    that tasks share are put together by a shuffle.
    """
    width = {"int16": 2, "int32": 4, "float32": 4}[dtype]
    kind = "<f4" if dtype == "float32" else f"<i{width}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    size = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).getLen()
    total, odd = divmod(size, channels * width)
    if odd:
        raise ValueError(f"{path} ends within a sample of {channels} channels")
    if not total:
        return spark.createDataFrame([], TRACES)
    step = math.gcd(total, samples)

    def pieces(part):
        import numpy as np

        def rows(at, raws):
            x = np.frombuffer(b"".join(raws), dtype=kind).reshape(-1, channels).T.astype(np.float32)
            return [(at // samples, c, at, v.tolist()) for c, v in enumerate(x)]

        first, last, held = 0, -1, []
        for raw, index in part:
            at = index * step
            if held and (at // samples != last // samples):
                yield from rows(first, held)
                held = []
            if not held:
                first = at
            held.append(raw)
            last = at
        if held:
            yield from rows(first, held)

    rdd = spark.sparkContext.binaryRecords(path, channels * width * step).zipWithIndex()
    got = spark.createDataFrame(rdd.mapPartitions(pieces), TRACES)
    if step == samples:
        return got
    parts = got.groupBy("chunk_id", "channel").agg(F.sort_array(F.collect_list(F.struct("t0", "v"))).alias("p"))
    return parts.select("chunk_id", "channel", F.col("p")[0]["t0"].alias("t0"), F.flatten(F.transform("p", lambda x: x["v"])).alias("v"))


def explode_traces(traces: DataFrame) -> DataFrame:
    """(t, channel, v): a row for each sample."""
    return traces.select("channel", "t0", F.posexplode("v").alias("i", "v")).select((F.col("t0") + F.col("i")).alias("t"), "channel", "v")


def snippets(spikes: DataFrame, traces: DataFrame, before: int, after: int, length: int) -> DataFrame:
    """v: the samples about each spike on its channel, from chunks of `length` samples; a snippet that crosses a chunk's edge is joined from two."""
    need = spikes.withColumn("_a", F.col("t") - before).withColumn("_b", F.col("t") + after)
    need = need.withColumn("t0", F.explode(F.sequence(F.floor(F.col("_a") / length) * length, F.floor((F.col("_b") - 1) / length) * length, F.lit(length).cast("long"))))
    cut = need.join(traces.select("channel", "t0", F.col("v").alias("_v")), ["channel", "t0"])
    a = F.greatest(F.col("_a") - F.col("t0"), F.lit(0))
    b = F.least(F.col("_b") - F.col("t0"), F.size("_v").cast("long"))
    parts = cut.withColumn("_part", F.slice("_v", (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int")))
    got = parts.groupBy("spike_id").agg(F.sort_array(F.collect_list(F.struct("t0", "_part"))).alias("_p"))
    return got.select("spike_id", F.flatten(F.transform("_p", lambda p: p["_part"])).alias("v"))


def single_precision(df: DataFrame) -> DataFrame:
    """All double columns as float, as features are stored."""
    return df.select(*(F.col(f.name).cast("float").alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in df.schema.fields))


def npy_header(raw: bytes) -> dict:
    """The header of a .npy file."""
    import ast

    if raw[:6] != b"\x93NUMPY":
        raise ValueError("not a .npy file")
    size, start = (struct.unpack("<H", raw[8:10])[0], 10) if raw[6] == 1 else (struct.unpack("<I", raw[8:12])[0], 12)
    return ast.literal_eval(raw[start : start + size].decode("latin1")) | {"offset": start + size}


def read_npy_rows(spark: SparkSession, path: str) -> DataFrame:
    """(file, i, v) of one- or two-dimensional .npy files, a row for each first index."""

    def rows(batches):
        import io

        import numpy as np
        import pandas as pd

        for pdf in batches:
            for name, raw in zip(pdf["path"], pdf["content"]):
                x = np.atleast_1d(np.load(io.BytesIO(raw), allow_pickle=False))
                x = x.reshape(len(x), -1).astype(float)
                yield pd.DataFrame({"file": name, "i": range(len(x)), "v": x.tolist()})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(rows, "file string, i long, v array<double>")
