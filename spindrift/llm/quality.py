"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

A document's terms are its words and the shapes of its words (letter case, digits and punctuation, runs written once), hashed to DIMS columns, and a few
terms for how much it repeats itself. Sublinear frequencies times inverse document frequencies, projected on the leading
singular vectors of a bounded labelled sample, give its latent vector. The labelled vectors are broadcast (at most 2 * PER_CLASS by RANK floats), and
each document's cosine with every one of them is computed in blocks of documents; the NEAREST vote, weighted by similarity.

Defined cases: a null text counts as empty; an empty text, or one without any known term, has a zero vector and gets the balanced sample's prior, 0.5 rounded down to label 0 (0.49);
texts are read whole; labels that are null are not learnt from; with no labels at all every score is 0.49; repeated rows and null ids are scored row by row;
ties of similarity go to the neighbour that comes first; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, fold_of, sample_by_class, sample_of, small_batches

#: Labelled documents of a class, hashed columns, latent dimensions, neighbours that vote, terms a worker keeps.
PER_CLASS, DIMS, RANK, NEAREST, KEPT = 1500, 4096, 32, 15, 300_000
EXTRA = 64
_terms: dict[str, tuple[int, int]] = {}


def shape(word: str) -> str:
    out, last = [], ""
    for c in word:
        k = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        if k != last:
            out.append(k)
            last = k
        if len(out) == 8:
            break
    return "".join(out)


def term(word: str) -> tuple[int, int]:
    """The columns of a word and of its shape."""
    core = word.strip(".,;:!?\"'()").lower()
    return zlib.crc32(core.encode()) % (DIMS // 2), DIMS // 2 + zlib.crc32(shape(word).encode()) % (DIMS // 2 - EXTRA)


def counts(texts: list[str | None]) -> np.ndarray:
    """Frequencies (texts, DIMS) of hashed terms; the last EXTRA columns tell how a text repeats itself."""
    if len(_terms) > KEPT:
        _terms.clear()
    keys, times, n = [], [], len(texts)
    for i, text in enumerate(texts):
        if not text:
            continue
        found = Counter(text.split())
        base = i * DIMS
        for w, c in found.items():
            if (k := _terms.get(w)) is None:
                k = _terms[w] = term(w)
            keys += (base + k[0], base + k[1])
            times += (c, c)
        if total := sum(found.values()):
            lines = text.split("\n")
            for j, share in enumerate((len(found) / total**0.8, max(found.values()) / total, len(set(lines)) / len(lines))):
                keys.append(base + DIMS - EXTRA + 16 * j + min(15, int(share * 15)))
                times.append(total)
    return np.bincount(np.array(keys, np.int64), np.array(times, np.float64), n * DIMS).reshape(n, DIMS).astype(np.float32) if keys else np.zeros((n, DIMS), np.float32)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


class Neighbours:
    """Labelled latent vectors, and how to get a text's own."""

    def __init__(self, texts: list[str], labels: np.ndarray, rank: int = RANK, seed: int = 5):
        tf = counts(texts)
        df = (tf > 0).sum(0)
        self.idf = np.where(df > 1, np.log((len(texts) + 1) / (df + 0.5)), 0).astype(np.float32).clip(0.05)
        self.idf[df <= 1] = 0
        x = unit(np.log1p(tf) * self.idf)
        q = np.linalg.qr(x.T @ (x @ np.random.default_rng(seed).normal(size=(DIMS, rank + 8)).astype(np.float32)))[0]
        for _ in range(3):
            q = np.linalg.qr(x.T @ (x @ q))[0]
        _, _, v = np.linalg.svd(x @ q, full_matrices=False)
        self.basis = (q @ v.T)[:, :rank].astype(np.float32)
        self.vectors, self.labels = unit(x @ self.basis), labels.astype(np.float32)

    def scores(self, texts: list[str | None], nearest: int = NEAREST, block: int = 256) -> np.ndarray:
        out = np.full(len(texts), 0.49)
        for i in range(0, len(texts), block):
            x = unit(np.log1p(counts(texts[i : i + block])) * self.idf) @ self.basis
            known = np.linalg.norm(x, axis=1) > 1e-6
            cos = unit(x) @ self.vectors.T
            k = min(nearest, cos.shape[1])
            # what lies above the k-th similarity, and of those equal to it the first
            least = np.partition(cos, cos.shape[1] - k, axis=1)[:, cos.shape[1] - k, None]
            rank = np.where(cos > least, 2, np.where(cos == least, 1, 0)).astype(np.int8)
            top = np.argsort(-rank, axis=1, kind="stable")[:, :k]
            w = np.take_along_axis(cos, top, 1).clip(1e-3) ** 8
            got = (w * self.labels[top]).sum(1) / w.sum(1)
            out[i : i + block][known] = got[known]
        return out


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS) -> Neighbours | None:
    """docs: what may be learnt from; labels: doc_id and label."""
    known = labels.where(F.col(label).isNotNull()).select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_label"))
    chosen = sample_by_class(known, "_label", per_class, "_id")
    got = sample_of(docs, chosen).toPandas()
    got = got.sort_values(["doc_id", "text"]).drop_duplicates("text")
    return Neighbours(got["text"].tolist(), got["_label"].to_numpy()) if len(got) else None


def score(docs: DataFrame, model: Neighbours | None) -> DataFrame:
    """doc_id and score of each row of docs."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def over(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).to_pylist()
        found = shared.value.scores(texts) if shared.value else np.full(len(texts), 0.49)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], ["doc_id", "score"])

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), over, "doc_id long, score double")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held = fold_of("doc_id", 3) == 1
    model = train(docs.where(~held), labels.where(~held))
    out = score(docs, model)
    return out.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
