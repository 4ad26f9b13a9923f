"""Token counts from the pieces of distinct pre-tokens; no ids of a document are ever made.

A text's tokens are the sum over its pre-tokens of the pieces that each is split into, so pieces are counted once
for each distinct pre-token and joined to the documents' pre-token frequencies. The join is in two parts. The most frequent
pre-tokens of a bounded sample, at most FREQUENT of them, are broadcast with their counts and summed where the text is
read; this also takes every hot key out of the other part. All other (document, pre-token, frequency) rows are joined by a
shuffle on the pre-token. The sample decides only which way a pre-token goes, never what is counted.

Defined cases: a null or empty text has 0 tokens and 0 bytes; special strings inside a text count as one token each, as the library's
default has it; a text of any length is counted whole; repeated rows and null ids are counted row by row; an empty table gives no
rows; further columns are not read.
"""

from __future__ import annotations

import json
import os
import unicodedata
from collections import Counter
from functools import cache, cached_property

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, small_batches, stage

#: Documents in the sample, pre-tokens that are broadcast, and the limit of over_limit.
SAMPLED, FREQUENT, LIMIT = 4000, 65536, 2048


class Words:
    """A tokenizers file of the word BPE kind: what it makes of a text, pre-token by pre-token."""

    def __init__(self, path: str):
        import regex

        self.path = path
        with open(path, encoding="utf-8") as f:
            special = [t["content"] for t in json.load(f)["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.marks = sorted({s[:2] for s in special})
        # the tokenizer's own split pattern; below U+0530 Python's Unicode tables and the library's agree on it
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        self.rare = regex.compile(r"[^\x00-ԯ]|Σ")
        byte = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = {chr(b): b for b in byte} | {chr(256 + i): b for i, b in enumerate(sorted({*range(256)} - {*byte}))}
        self.bytes_of = lambda piece: bytes(shown[c] for c in piece).decode("utf-8", "surrogateescape")

    @cached_property
    def tokenizer(self):
        """The library's own, loaded where it is used; its threads would only hold memory beside Spark's tasks."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    @cached_property
    def model(self):
        """The same model for pre-tokens: bytes as the library shows them, without a normaliser, a split or special strings."""
        from tokenizers import Tokenizer, pre_tokenizers

        out = Tokenizer(self.tokenizer.model)
        out.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        return out

    def pre_tokens(self, text: str) -> tuple[Counter, int]:
        """Frequencies of the pre-tokens, and the number of special strings."""
        parts, specials = [text], 0
        if self.special and any(m in text for m in self.marks) and (specials := len(self.special.findall(text))):
            parts = self.special.split(text)
        found: Counter = Counter()
        for part in parts:
            if self.rare.search(part):
                t = self.tokenizer
                found.update(self.bytes_of(p) for p, _ in t.pre_tokenizer.pre_tokenize_str(t.normalizer.normalize_str(part)))
            else:
                found.update(self.split.findall(unicodedata.normalize("NFC", part).lower()))
        return found, specials

    def pieces(self, tokens: list[str]) -> list[int]:
        """How many pieces the model makes of each pre-token, which is taken as it is."""
        return [len(e) for e in self.model.encode_batch_fast(tokens, add_special_tokens=False)]


@cache
def words(path: str) -> Words:
    return Words(path)


def frequent(docs: DataFrame, path: str, rows: int, sampled: int = SAMPLED, most: int = FREQUENT) -> dict[str, int]:
    """Pieces of the pre-tokens that a bounded sample of documents has most often: at most `most` of them."""
    part = docs.where(F.pmod(F.xxhash64("doc_id", F.lit("words")), F.lit(1 << 20)) < F.lit(int((1 << 20) * min(1.0, sampled / max(rows, 1))) + 1)).select("text")

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        found: Counter = Counter()
        for text in batch.column(0).to_pylist():
            if text:
                found.update(words(path).pre_tokens(text)[0])
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["token", "n"])

    got = arrow_map(part, count, "token string, n long").groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(most).select("token").toPandas()
    tokens = got["token"].tolist()
    return dict(zip(tokens, words(path).pieces(tokens)))


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT, sampled: int = SAMPLED, most: int = FREQUENT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit: a row for each row of docs."""
    spark = docs.sparkSession
    small_batches(spark, 256)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = spark.sparkContext.broadcast(frequent(docs, path, docs.count(), sampled, most))

    def split(batch: pa.RecordBatch) -> pa.RecordBatch:
        w, pieces = words(path), known.value.get
        first, ids, sizes, sums, tokens, times = (batch.column(0).to_pylist(), [], [], [], [], [])
        rows = []
        for row, doc_id, text in zip(first, batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            total, at = 0, len(rows)
            rows.append(row), ids.append(doc_id), tokens.append(None), times.append(None)
            if text:
                found, total = w.pre_tokens(text)
                for token, n in found.items():
                    if (p := pieces(token)) is None:
                        rows.append(row), ids.append(None), tokens.append(token), times.append(n)
                    else:
                        total += p * n
            more = len(rows) - at - 1
            sizes.append(len(text.encode()) if text else 0), sums.append(total)
            sizes += [None] * more
            sums += [None] * more
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((rows, ids, sizes, sums, tokens, times), kinds)], ["row", "doc_id", "n_bytes", "n_tokens", "token", "times"])

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(words(path).pieces(batch.column(0).to_pylist()), pa.int64())], ["token", "pieces"])

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    both, _ = stage(arrow_map(numbered, split, "row long, doc_id long, n_bytes long, n_tokens long, token string, times long"), "tokens")
    rest = both.where("token is not null").select("row", "token", "times")
    pieces = arrow_map(rest.select("token").distinct(), measure, "token string, pieces long")
    tails = rest.join(pieces, "token").select("row", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("n_bytes"), (F.col("pieces") * F.col("times")).alias("n_tokens"))
    heads = both.where("token is null").select("row", "doc_id", "n_bytes", "n_tokens")
    out = heads.unionByName(tails).groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum("n_tokens").alias("n_tokens"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), str(public_tokenizers.path("word_bpe_49k.json")))
