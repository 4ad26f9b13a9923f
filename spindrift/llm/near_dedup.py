"""Near-duplicates by MinHash with sequential Bayesian verification.

Texts equal word by word form a class and go on as its first document. Each class has BANDS keys of ROWS minima; those that share a key are candidates.
Further minima, in batches, are compared for each candidate pair: with m of n equal and a uniform prior, the posterior of the similarity is
Beta(m+1, n-m+1), and the pair is pruned as soon as the probability that it reaches the threshold falls below MISS. Survivors are verified on their full shingle sets.

A bucket's members are first compared with its least member only; verified links give components. Buckets that still hold several are taken up again: members
are compared with PIVOTS others, drawn by hash, that are in another component. At last, members of one bucket in different components are all compared
with each other, in blocks of at most BLOCK rows by BLOCK rows inside a task. There a bitmap of each set, eight bits or more for an element, bounds the
symmetric difference from below, which rules out nearly all that the posterior leaves, and only survivors leave the task. So most of a group of n near copies costs a
number of comparisons in proportion to n, and no pair of a bucket that could join two components is passed over. Within a block only pairs whose set sizes allow the similarity are made.
A bucket of more than FINE blocks, which is one of documents that share only a common passage, is first divided: its members are compared where one of
the 32 runs of four minima to verify with agrees too. That misses a link at the threshold with probability 5e-6, and a passage that makes up a fifth of its documents leaves 0.16 % of a bucket together
a run, so the pairs shrink some ten-thousandfold; they still grow with the square of that share. For tables far larger than 10^9 documents raise ROWS and BANDS.

Defined cases: words are runs of anything but white space, A-Z in lower case; a text of fewer words than a shingle has one shingle, the whole sequence; one without words
(or null) has none and is linked with nothing; rows that share a doc_id count as one document; a null doc_id is linked with nothing, its component_id is null and it
is kept; an empty table gives no rows; texts are read whole; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import arrow_map, drop, small_batches, stage

#: Words of a shingle, similarity in percent, bands, minima of a band, minima to verify with and of a batch, miss probability, further pivots, rows of a block, blocks of a bucket that isn't divided, minima of a run that divides.
SHINGLE, PERCENT, BANDS, ROWS, CHECKS, BATCH, MISS, PIVOTS, BLOCK, FINE, RUN = 5, 75, 40, 5, 128, 16, 1e-6, 3, 512, 32, 4
_hashes: dict[bytes, int] = {}
_odd = (np.random.default_rng(20).integers(0, 1 << 31, BANDS * ROWS + CHECKS, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_mults = np.random.default_rng(21).integers(1, 1 << 62, max(SHINGLE, ROWS) + 1, dtype=np.uint64) | np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def words(text: str | None) -> list[bytes]:
    """bytes.lower() changes A-Z only, and bytes.split() parts at the space and U+0009 to U+000D."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingles(found: list[bytes]) -> np.ndarray:
    """Distinct 64-bit hashes of the shingles, sorted."""
    import xxhash

    if not found:
        return np.zeros(0, np.uint64)
    if len(found) < SHINGLE:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(found), 7)], np.uint64)
    if len(_hashes) > 400_000:
        _hashes.clear()
    for w in {*found}:
        if w not in _hashes:
            _hashes[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(_hashes.__getitem__, found), np.uint64, len(found))
    n = len(h) - SHINGLE + 1
    s = h[:n] * _mults[0]
    for i in range(1, SHINGLE):
        s = (s ^ (s >> np.uint64(29))) * _mults[0] + h[i : i + n] * _mults[i]
    return np.unique(_mix(s))


def minima(s: np.ndarray) -> np.ndarray:
    """The least image of the set under each of the odd multipliers modulo 2**32."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(_odd), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 2048):
        out = np.minimum(out, (_odd[:, None] * x[None, i : i + 2048]).min(1))
    return out


def signature(s: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Keys of the bands, and 16 bits of each minimum to verify with."""
    m = minima(s)
    rows = m[: BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * _mults[-1]
    for i in range(ROWS):
        key = _mix(key + rows[:, i] * _mults[i])
    return key.view(np.int64), m[BANDS * ROWS :].astype(np.uint16).tobytes()


def bitmap(s: np.ndarray) -> bytes:
    """A bit for each shingle at its hash modulo the size, a power of two of at least eight bits a shingle."""
    bits = np.zeros(max(256, 1 << (8 * len(s) - 1).bit_length()), bool)
    bits[(s & np.uint64(len(bits) - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def possible(maps: list[bytes], n: np.ndarray, u: np.ndarray, v: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of rows (u, v) the bitmaps don't rule out.

    Bits that differ are set by as many different elements of the symmetric difference at least, also after a bitmap is folded to
    the size of a smaller one, so the intersection is at most (|A| + |B| - differing bits) / 2.
    """
    size = np.array([len(m) for m in maps])
    least, keep = np.minimum(size[u], size[v]), np.zeros(len(u), bool)
    for width in np.unique(least):
        at = np.flatnonzero(least == width)
        rows, inverse = np.unique(np.concatenate([u[at], v[at]]), return_inverse=True)
        table = np.stack([np.bitwise_or.reduce(np.frombuffer(maps[r], np.uint64).reshape(-1, width // 8), axis=0) for r in rows])
        x, y = inverse[: len(at)], inverse[len(at) :]
        step = max(1, 16_000_000 // width)
        for k in range(0, len(at), step):
            differ = np.bitwise_count(table[x[k : k + step]] ^ table[y[k : k + step]]).sum(1, dtype=np.int64)
            both = n[u[at[k : k + step]]] + n[v[at[k : k + step]]]
            keep[at[k : k + step]] = (100 + percent) * (both - differ) >= 2 * percent * both
    return np.flatnonzero(keep)


def bounds(percent: int = PERCENT, miss: float = MISS) -> list[tuple[int, int]]:
    """(n, least m): after n comparisons a pair with fewer than m equal is pruned.

    P(similarity >= t | m of n) = P(Binomial(n + 1, t) <= m) under a uniform prior.
    """
    t, out = percent / 100, []
    for n in range(BATCH, CHECKS + 1, BATCH):
        total, m = 0.0, 0
        while m <= n and (total := total + comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)) < miss:
            m += 1
        out.append((n, m))
    return out


def survives(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Which pairs of signatures (rows of a and b) stay, batch by batch; set sizes alone can rule a pair out too."""
    left = np.flatnonzero(np.minimum(na, nb) * 100 >= np.maximum(na, nb) * percent)
    equal = np.zeros(len(a), np.int64)
    for n, m in bounds(percent):
        if not len(left):
            break
        equal[left] += (a[left, n - BATCH : n] == b[left, n - BATCH : n]).sum(1)
        left = left[equal[left] >= m]
    return left


def _signed(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), CHECKS)


def parsed(docs: DataFrame) -> DataFrame:
    """doc_id, digest of the word sequence (null without words), n, bands, checks, map."""

    def over(batch: pa.RecordBatch) -> pa.RecordBatch:
        digests, sizes, bands, checks, maps = [], [], [], [], []
        for text in batch.column(1).to_pylist():
            found = words(text)
            s = shingles(found)
            sizes.append(len(s))
            if len(s):
                keys, check = signature(s)
                digests.append(hashlib.blake2b(b" ".join(found), digest_size=16).digest()), bands.append(keys), checks.append(check), maps.append(bitmap(s))
            else:
                digests.append(None), bands.append(None), checks.append(None), maps.append(None)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(checks, pa.binary()), pa.array(maps, pa.binary())],
            ["doc_id", "digest", "n", "bands", "checks", "map"],
        )

    return arrow_map(docs, over, "doc_id long, digest binary, n long, bands array<long>, checks binary, map binary")


def pruned(pairs: DataFrame, firsts: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that Bayesian verification leaves."""
    own = lambda c: firsts.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("checks").alias(f"s{c}"))

    def over(batch: pa.RecordBatch) -> pa.RecordBatch:
        a, b, na, nb, sa, sb = (batch.column(i) for i in range(6))
        left = survives(_signed(sa), _signed(sb), na.to_numpy(), nb.to_numpy(), percent)
        return pa.RecordBatch.from_arrays([a.take(pa.array(left)), b.take(pa.array(left))], ["a", "b"])

    return arrow_map(pairs.join(own("a"), "a").join(own("b"), "b").select("a", "b", "na", "nb", "sa", "sb"), over, "a long, b long")


def divided(members: DataFrame, block: int, fine: int) -> DataFrame:
    """members with buckets of more than `fine` blocks divided by the runs of minima of their members."""
    large = members.groupBy("key").count().where(F.col("count") > block * fine).select("key")
    runs = F.expr(f"explode(transform(sequence(0, {CHECKS // RUN - 1}), i -> xxhash64(key, i, substring(checks, {2 * RUN} * i + 1, {2 * RUN}))))")
    finer = members.join(large, "key", "left_semi").withColumn("key", runs)
    several = finer.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key")
    return members.join(large, "key", "left_anti").unionByName(finer.join(several.hint("merge"), "key", "left_semi"))


def crossing(members: DataFrame, percent: int, block: int) -> DataFrame:
    """Surviving pairs (a, b) of different components within each bucket.

    members: key, node, component, n, checks, map. A bucket of more than `block` rows is dealt into blocks, and each pair of blocks is a group of its own.
    """
    sizes = members.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("q"))
    own = F.pmod(F.xxhash64("node"), F.col("q")).cast("int")
    dealt = (
        members.join(sizes, "key")
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("q") - 1)))
        .select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "component", "n", "checks", "map")
    )

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def pairs(t: pa.Table) -> pa.RecordBatch:
            key, i, j, own, node, comp, n = (t.column(c).to_numpy() for c in ("key", "i", "j", "own", "node", "component", "n"))
            s, maps = _signed(t.column("checks").combine_chunks()), t.column("map").to_pylist()
            edge = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]), [True]]))
            xs, ys = [], []
            for a, b in zip(edge, edge[1:]):
                if b - a < 2:
                    continue
                within = i[a] == j[a]
                # in order of size: what is too large for a row is too large for all before it
                ends = a + np.searchsorted(n[a:b], n[a:b] * 100 // percent, side="right")
                for at in range(a, b):
                    to = np.arange(at + 1, ends[at - a])
                    to = to[(comp[to] != comp[at]) & (within | (own[to] != own[at]))]
                    if len(to):
                        xs.append(np.full(len(to), at))
                        ys.append(to)
            x, y = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (xs, ys))
            got = [np.zeros((0, 2), np.int64)]
            for k in range(0, len(x), 50_000):
                u, v = x[k : k + 50_000], y[k : k + 50_000]
                left = survives(s[u], s[v], n[u], n[v], percent)
                u, v = u[left], v[left]
                left = possible(maps, n, u, v, percent)
                got.append(np.stack([node[u[left]], node[v[left]]], 1))
            found = np.unique(np.sort(np.concatenate(got), axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            t = pa.Table.from_batches(held)
            last = [t.column(c)[-1].as_py() for c in ("key", "i", "j")]
            open_ = np.logical_and.reduce([t.column(c).to_numpy() == v for c, v in zip(("key", "i", "j"), last)])
            cut = int(np.argmax(open_))
            if cut:
                yield pairs(t.slice(0, cut))
                held = t.slice(cut).combine_chunks().to_batches()
        if held:
            yield pairs(pa.Table.from_batches(held))

    return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "n", "node").mapInArrow(over, "a long, b long").distinct()


def packed(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, packed): the word sequences of these nodes, compressed before they are shuffled."""

    def pack(batch: pa.RecordBatch) -> pa.RecordBatch:
        import zstandard

        zip_ = zstandard.ZstdCompressor(level=3).compress
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([zip_(b" ".join(words(t))) for t in batch.column(1).to_pylist()], pa.binary())], ["node", "packed"])

    return arrow_map(docs, pack, "node long, packed binary").join(nodes.hint("merge"), "node", "left_semi")


def verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Links (a, b): those of the pairs whose full shingle sets are as similar as asked for."""

    def compare(batch: pa.RecordBatch) -> pa.RecordBatch:
        import zstandard

        unzip, known, left = zstandard.ZstdDecompressor().decompress, {}, []
        ids = [batch.column(i).to_pylist() for i in (0, 1)]
        texts = [batch.column(i).to_pylist() for i in (2, 3)]
        for row, (a, b, x, y) in enumerate(zip(*ids, *texts)):
            if a not in known:
                known = {a: shingles(unzip(x).split())}
            s, t = known[a], shingles(unzip(y).split())
            both = len(np.intersect1d(s, t, assume_unique=True))
            if both * 100 >= percent * (len(s) + len(t) - both):
                left.append(row)
        at = pa.array(left, pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], ["a", "b"])

    own = lambda c: texts.select(F.col("node").alias(c), F.col("packed").alias(f"p{c}")).hint("merge")
    return arrow_map(pairs.join(own("b"), "b").join(own("a"), "a").select("a", "b", "pa", "pb"), compare, "a long, b long").distinct()


def link(docs: DataFrame, percent: int = PERCENT, block: int = BLOCK, pivots: int = PIVOTS, fine: int = FINE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row for each row of docs."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows, rows_path = stage(parsed(docs), "parsed")
    known = rows.where("digest is not null and doc_id is not null")
    first = known.groupBy("digest").agg(F.min(F.struct("doc_id", "n", "bands", "checks", "map")).alias("s"))
    firsts, firsts_path = stage(first.select(F.col("s.doc_id").alias("node"), "digest", "s.n", "s.bands", "s.checks", "s.map"), "firsts")
    keys = firsts.select("node", F.explode("bands").alias("key"))
    least = keys.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least <> most").select("key", "least")
    shared, shared_path = stage(keys.join(least.hint("merge"), "key"), "buckets")
    texts, texts_path = stage(packed(docs, shared.select("node").distinct()), "texts")

    def decided(pairs: DataFrame) -> tuple[DataFrame, str]:
        """Links among pairs (a, b), staged."""
        left, path = stage(pairs, "survivors")
        found = stage(verified(left, texts, percent), "links")
        drop(spark, path)
        return found

    # every bucket about its least member
    stars, stars_path = stage(shared.where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct(), "stars")
    links, links_path = decided(pruned(stars, firsts, percent))
    labels, labels_path = components(links)

    # buckets of several components about members drawn by hash
    label = F.coalesce("component", "node")

    def labelled() -> tuple[DataFrame, str]:
        """Members of the buckets that hold several components: key, node, component."""
        members = shared.select("key", "node").join(labels, "node", "left").withColumn("component", label)
        several = members.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key")
        return stage(members.join(several.hint("merge"), "key", "left_semi").select("key", "node", "component"), "open")

    open_, open_path = labelled()
    drawn = open_.groupBy("key").agg(*(F.min(F.struct(F.xxhash64("node", F.lit(r)).alias("h"), "node", "component")).alias(f"s{r}") for r in range(pivots)))
    drawn = drawn.select("key", F.explode(F.array(*(F.col(f"s{r}") for r in range(pivots)))).alias("s")).select("key", F.col("s.node").alias("pivot"), F.col("s.component").alias("far"))
    again = open_.join(drawn.hint("merge"), "key").where("component <> far").select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
    again, again_path = stage(again.join(stars, ["a", "b"], "left_anti"), "stars")
    more, more_path = decided(pruned(again, firsts, percent))
    both, both_path = stage(links.unionByName(more), "links")
    drop(spark, open_path, labels_path, links_path, more_path)
    labels, labels_path = components(both)

    # what is left: all pairs of a bucket that are still in different components, but for those that have been decided
    open_, open_path = labelled()
    members = divided(open_.join(firsts.select("node", "n", "checks", "map").hint("merge"), "node"), block, fine)
    more, more_path = decided(crossing(members, percent, block).join(stars.unionByName(again), ["a", "b"], "left_anti"))
    every, every_path = stage(both.unionByName(more), "links")
    drop(spark, open_path, labels_path, both_path, more_path, stars_path, again_path, texts_path, shared_path)
    labels, labels_path = components(every)
    classes, _ = stage(firsts.select("node", "digest").join(labels, "node", "left").select("digest", label.alias("component_id")), "classes")
    slim, _ = stage(rows.select("doc_id", "digest", "n"), "documents")
    drop(spark, every_path, firsts_path, rows_path, labels_path)
    out = slim.join(classes.withColumnRenamed("digest", "_digest"), F.col("digest") == F.col("_digest"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def dedup(docs: DataFrame, **how) -> DataFrame:
    """Rows of docs that stay, with all their columns: one document of each group."""
    kept = link(docs, **how).where("kept and doc_id is not null").select(F.col("doc_id").alias("_keep")).distinct()
    named = docs.join(kept, F.col("doc_id").cast("long") == F.col("_keep"), "left_semi")
    return named.unionByName(docs.where("doc_id is null"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(spark.read.parquet(f"{sf_dir}/documents.parquet"))
