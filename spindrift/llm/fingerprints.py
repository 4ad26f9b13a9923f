"""Document fingerprints by winnowing.

Every run of GRAM code points has a hash, every window of WIDTH hashes selects its least one, the rightmost of equals, and a hash selected by several
windows is kept once with its position. Any passage of GRAM + WIDTH - 1 or more code points that two texts share is therefore selected
at least once in both. Short texts have narrower windows, whose hashes contain those of wider ones, so this holds between short and long texts too; and
of the three quarters that an edit leaves at least one hash stays, whatever the length. Where these are shorter than a gram, all runs of
SHORT code points are hashed as well, or alone if the whole text is; a text shorter than SHORT is hashed as a whole.

Neighbours by doc_id are found without a total order in one task: ranges of ids, whose bounds come from an approximate quantile, are dealt to tasks and sorted
there, and the first document of each range is sent to the range before as well. Texts travel compressed. There is a task for each range of about RANGE documents. Above RANGE * RANGES
documents (268 million) the ranges are larger instead of more; a range is sorted with spill and read as a stream, so memory doesn't grow with it. All rows that share one id lie in one range.

Defined cases: a null text counts as empty; the fingerprint of an empty text is the empty string, and two empty fingerprints are alike to 1, an empty and a full one to 0;
rows with equal ids follow each other in order of their text's digest; null ids come first; with one row, the next document is itself; an empty table
gives no rows; texts are hashed whole; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches

#: Code points of a gram, hashes of a window, code points of a short text's gram, documents of a range, most ranges.
GRAM, WIDTH, SHORT, RANGE, RANGES = 8, 16, 3, 4096, 65536
BASE = np.uint64(0x9E3779B97F4A7C15)
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB) >> np.uint64(32)


def gram_hashes(text: str, gram: int = GRAM) -> np.ndarray:
    """32-bit hashes of all runs of `gram` code points: a polynomial rolled by doubling, then mixed."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
    if len(c) < gram:
        gram = len(c)
    out, size, power = None, 0, BASE
    block, width, bits = c, 1, gram
    # a polynomial of a run of 2w is that of w times BASE**w plus that of the next w
    while bits:
        if bits & 1:
            if out is None:
                out, size = block, width
            else:
                n = len(c) - (size + width) + 1
                out = out[:n] * power + block[size : size + n]
                size += width
        bits >>= 1
        if bits:
            block = block[: len(block) - width] * power + block[width:]
            width *= 2
            power = np.uint64(int(power) * int(power) & 0xFFFFFFFFFFFFFFFF)
    return _mix(out) if out is not None else np.zeros(0, np.uint64)


def winnow(text: str, gram: int = GRAM, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Selected hashes and their positions, in order of position."""
    h = gram_hashes(text, gram)
    n = len(h)
    if not n:
        return h, np.zeros(0, np.int64)
    # ties go right: of equal hashes, the later position makes the smaller key
    key = (h << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - np.arange(n, dtype=np.uint64))
    width, least, step = min(width, n), key, 1
    while step * 2 <= width:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if step < width:
        least = np.minimum(least[: n - width + 1], least[width - step : width - step + n - width + 1])
    kept = least[np.concatenate([[True], least[1:] != least[:-1]])]
    return kept >> np.uint64(32), (np.uint64(0xFFFFFFFF) - (kept & np.uint64(0xFFFFFFFF))).astype(np.int64)


def fingerprint(text: str, gram: int = GRAM, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """As winnow, with windows and grams that suit the text's length."""
    n = len(text)
    left = n - n // 4
    if n < gram:
        return winnow(text, SHORT, 1)
    hashes, positions = winnow(text, gram, max(1, min(width, (n - gram + 1) // 4, left - gram + 1)))
    if left < gram:
        more, at = winnow(text, SHORT, 1)
        hashes, positions = np.concatenate([hashes, more]), np.concatenate([positions, at])
        order = np.argsort(positions, kind="stable")
        hashes, positions = hashes[order], positions[order]
    return hashes, positions


def written(hashes: np.ndarray, positions: np.ndarray) -> str:
    """hash@position, the hash in eight hexadecimal digits, space by space."""
    return " ".join([f"{h:08x}@{p}" for h, p in zip(hashes.tolist(), positions.tolist())])


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of hashes."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    a, b = np.unique(a), np.unique(b)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def ranged(docs: DataFrame, span: int = RANGE, most: int = RANGES) -> tuple[DataFrame, int]:
    """(part, mark, doc_id, digest, packed): documents by ranges of ids, and the number of ranges; mark 1: the first document after the range.

    The bounds are ids that occur, so the document after a range is known before any is moved: it has the next bound as its id.
    """
    spark = docs.sparkSession
    ends = docs.agg(F.min("doc_id"), F.count_if(F.col("doc_id").isNull()), F.count(F.lit(1))).first()
    parts = min(most, -(-ends[2] // span))
    bounds = np.zeros(0, np.int64)
    if parts > 1 and ends[0] is not None:
        cuts = docs.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 10 * parts)).first()[0]
        bounds = np.unique(np.array(cuts, np.int64))
    start = None if ends[1] else ends[0]
    shared = spark.sparkContext.broadcast((bounds, start))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        bounds, start = shared.value
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = (text or "").encode("utf-8", "surrogatepass")
                own, packed = hashlib.blake2b(raw, digest_size=8).digest(), pack(raw)
                at = 0 if doc_id is None else int(np.searchsorted(bounds, doc_id, side="right"))
                rows.append((at, 0, doc_id, own, packed))
                if at and doc_id == bounds[at - 1]:
                    rows.append((at - 1, 1, doc_id, own, packed))
                if doc_id == start:
                    rows.append((len(bounds), 2, doc_id, own, packed))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], ["part", "mark", "doc_id", "digest", "packed"])

    return docs.mapInArrow(deal, "part long, mark int, doc_id long, digest binary, packed binary"), len(bounds) + 1


def fingerprint_documents(docs: DataFrame, gram: int = GRAM, width: int = WIDTH, span: int = RANGE) -> DataFrame:
    """A row for each row of docs: its fingerprint, that of its edited text, and how like they are to it and the next document's."""
    spark = docs.sparkSession
    small_batches(spark, 512)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        held = None
        for batch in batches:
            out = []
            for part, mark, doc_id, packed in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4))):
                if mark and (held is None or held[0] != part):
                    continue  # the range has no document, or its last one has met the next already
                text = unpack(packed).decode("utf-8", "surrogatepass")
                hashes, positions = fingerprint(text, gram, width)
                if held is not None:
                    out.append(_row(held, text, hashes, gram, width))
                held = None if mark else (part, doc_id, text, hashes, positions)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)] if out else [pa.array([], k) for k in kinds], names)

    rows, parts = ranged(docs, span)
    dealt = rows.repartitionById(parts, F.col("part").cast("int")).sortWithinPartitions("part", "mark", F.asc_nulls_first("doc_id"), "digest")
    return dealt.mapInArrow(pairs, SCHEMA)


def edited(text: str, following: str) -> str:
    """The last quarter replaced by as much of the following text's beginning."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def _row(held: tuple, following: str, next_hashes: np.ndarray, gram: int, width: int) -> tuple:
    _, doc_id, text, hashes, positions = held
    new = edited(text, following)
    new_hashes, new_positions = fingerprint(new, gram, width)
    return (
        doc_id,
        len(text),
        hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(),
        written(hashes, positions),
        written(new_hashes, new_positions),
        likeness(hashes, new_hashes),
        likeness(hashes, next_hashes),
    )


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
