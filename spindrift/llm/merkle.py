"""A Merkle manifest of a table of documents: an external-memory store of nodes by level, and proofs by coordinate.

Each row is a leaf; a source's leaves, in order of id, form a tree of arity ARITY, and the sources' subroots, in order of source, form one more of the same kind. Both are the same NodeStore:

- `coordinates` sorts leaves by range into runs, streams each run once to number its rows and adds the runs' offsets, so a tree's leaves know their place and no task holds a source.
- `NodeStore.build` climbs HEIGHT levels at a time. Nodes are dealt in blocks of ARITY ** HEIGHT consecutive ones, sorted, and each block is read once in order: a level's nodes are made
  of the one before it as that comes by. Every level is a partition of the store's Parquet table.
- `NodeStore.paths` goes down again. Whatever lies above a block is the same for all of its leaves, so it is joined once a block, and the block's own levels, merged in order of coordinate,
  give the siblings of each node. A task holds one block, at most 1.5 * ARITY ** HEIGHT digests, whatever the size of a source; a source with most of the rows has most of the blocks.

`proofs` gives the steps of each document's proof as text: the place in the run, then the digests of its other nodes. `folded` computes a root from a leaf and such steps, in the JVM and without the store.

Defined cases: a null is the leaf's `-`; null ids come first, and rows that share an id go by their leaf digest (equal rows have equal leaves, so it doesn't matter which is which); each null id's document
counts as not tampered with; a null source is a source of its own, first in order; a table of one row has its leaf for subroot and root and an empty proof; an empty table gives no rows; long texts
are hashed whole in the JVM; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import crc32_sql, small_batches, stage

#: Nodes of a run, and levels of a block.
ARITY, HEIGHT = 3, 5
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: A node of the store: its tree, place among the level's n nodes, digest; a leaf of a source also has its document's id and altered leaf, a leaf of the top tree the source's key.
NODE = "tree string, idx long, n long, digest string, doc_id long, altered string, name string"
PATH = "tree string, level int, idx long, doc_id long, altered string, name string, digest string, subroot string, steps array<string>"


def _encoded(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(**values: Column) -> Column:
    """The digest of a row: each field as its byte count and value."""
    return F.sha2(F.concat(*(_encoded(values[f]) for f in FIELDS)), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """tree (the source's key, null first), doc_id, digest, altered (the leaf after tampering, null where that changes nothing)."""
    own = {f: F.col(f) for f in FIELDS}
    less = leaf_of(**own | {"text": F.replace(F.col("text").cast("string"), F.lit("\n"), F.lit(""))})
    hit = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & F.col("text").cast("string").contains("\n")
    key = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source").cast("string")))
    return docs.select(key.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf_of(**own).alias("digest"), F.when(hit, less).alias("altered"))


def _batches(rows: Iterator[tuple], fields: str, size: int = 4096) -> Iterator[pa.RecordBatch]:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "array<string>": pa.list_(pa.string())}
    names, types = zip(*(f.split() for f in fields.split(", ")))
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(zip(*held), types)], list(names))

    for row in rows:
        held.append(row)
        if len(held) == size:
            yield batch()
            held = []
    if held:
        yield batch()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def coordinates(rows: DataFrame, *order: str) -> DataFrame:
    """rows (tree, doc_id, digest, altered, name) as nodes: idx is the place among the tree's rows in the given order, n their number."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, before, at = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            places = []
            for tree in batch.column(0).to_pylist():
                at = at + 1 if tree == before else 0
                before = tree
                places.append(at)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([run] * batch.num_rows, pa.int64()), pa.array(places, pa.int64())], [*batch.schema.names, "run", "at"])

    rows = rows.select("tree", "doc_id", "digest", "altered", "name").withColumn("_even", F.monotonically_increasing_id() % 64)
    # copies of one row are told apart by _even, so that they need not all lie in one run
    ranged = rows.repartitionByRange("tree", *order, "_even").sortWithinPartitions("tree", *order, "_even").drop("_even")
    runs, _ = stage(ranged.mapInArrow(number, "tree string, doc_id long, digest string, altered string, name string, run long, at long"), "runs")
    sizes = runs.groupBy("tree", "run").agg(F.count(F.lit(1)).alias("size"))
    before = Window.partitionBy("tree").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("tree", "run", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"), F.sum("size").over(Window.partitionBy("tree")).alias("n"))
    return runs.join(offsets, ["tree", "run"]).select("tree", (F.col("offset") + F.col("at")).alias("idx"), "n", "digest", "doc_id", "altered", "name")


def _h(digests: list[str]) -> str:
    return sha256("".join(digests).encode()).hexdigest()


class NodeStore:
    """Trees of digests as a Parquet table partitioned by level; level 0 holds the leaves."""

    def __init__(self, spark: SparkSession, path: str, arity: int = ARITY, height: int = HEIGHT):
        self.spark, self.path, self.arity, self.height = small_batches(spark, 4096) or spark, path, arity, height

    def levels(self, first: int, last: int) -> DataFrame:
        """The nodes of levels first to last, with their level."""
        return self.spark.read.schema(f"{NODE}, level int").parquet(self.path).where(F.col("level").between(first, last))

    def block(self, up: int | Column) -> Column:
        """Which block a node lies in whose level is `up` below the block's top."""
        return F.floor(F.col("idx") / F.pow(F.lit(self.arity), F.lit(up) if isinstance(up, int) else up)).cast("long")

    def _add(self, nodes: DataFrame) -> None:
        nodes.sortWithinPartitions("level", "tree", "idx").write.mode("append").partitionBy("level").parquet(self.path)

    def build(self, nodes: DataFrame) -> int:
        """Writes the leaves and every level above them; how many levels lie above the leaves of the largest tree."""
        self._add(nodes.withColumn("level", F.lit(0)))
        most, depth = self.levels(0, 0).agg(F.max("n")).first()[0] or 0, 0
        while most > 1:
            most, depth = -(-most // self.arity), depth + 1
        arity, height = self.arity, self.height

        def climb(base: int) -> Callable:
            def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                def made() -> Iterator[tuple]:
                    for (tree, block), rows in groupby(_rows(batches), key=lambda r: (r[0], r[1] // arity**height)):
                        _, starts, counts, level = zip(*rows)
                        first, n = starts[0], counts[0]
                        for up in range(1, height + 1):
                            if n == 1:
                                break
                            level = [_h(level[i : i + arity]) for i in range(0, len(level), arity)]
                            first, n = first // arity, -(-n // arity)
                            for i, digest in enumerate(level):
                                yield tree, first + i, n, digest, base + up

                yield from _batches(made(), "tree string, idx long, n long, digest string, level int")

            return over

        for base in range(0, depth, height):
            below = self.levels(base, base).where("n > 1").select("tree", "idx", "n", "digest")
            dealt = below.repartition("tree", self.block(height)).sortWithinPartitions("tree", "idx")
            made = dealt.mapInArrow(climb(base), "tree string, idx long, n long, digest string, level int")
            self._add(made.select("tree", "idx", "n", "digest", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("altered"), F.lit(None).cast("string").alias("name"), "level"))
        return depth

    def tops(self, depth: int) -> DataFrame:
        """tree, level, digest: the one node of each tree that nothing lies above."""
        return self.levels(0, depth).where("n = 1").select("tree", "level", "digest")

    def paths(self, depth: int, above: DataFrame) -> DataFrame:
        """The leaves with the steps that lead up from each. above: tree, level, digest (of the tree's top) and steps, those that lead on from there."""
        arity, height = self.arity, self.height
        tops = above.select("tree", "level", F.lit(0).cast("long").alias("idx"), F.col("digest").alias("subroot"), "steps")
        led = tops.limit(0)

        def scan(base: int) -> Callable:
            def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                def found() -> Iterator[tuple]:
                    for _, rows in groupby(_rows(batches), key=lambda r: (r[0], r[1])):
                        # the block's top comes first, then its levels from the top down, each in order
                        tree, _, _, level, idx, _, _, _, _, subroot, steps = next(rows)
                        first, paths = idx, [steps]
                        if level == base:
                            r = next(rows)
                            yield tree, base, r[4], r[5], r[6], r[7], r[8], subroot, steps
                        for level, nodes in groupby(rows, key=lambda r: r[3]):
                            nodes = list(nodes)
                            start, below = nodes[0][4], []
                            for i in range(0, len(nodes), arity):
                                run = [r[8] for r in nodes[i : i + arity]]
                                up = paths[(start + i) // arity - first]
                                below += [[str(k) + "".join(run[:k] + run[k + 1 :]), *up] for k in range(len(run))]
                            first, paths = start, below
                            if level == base:
                                for r, path in zip(nodes, paths):
                                    yield tree, base, r[4], r[5], r[6], r[7], r[8], subroot, path

                yield from _batches(found(), PATH, 1024)

            return over

        for base in reversed(range(0, max(depth, 1), height)):
            ends = tops.where((F.col("level") > base) & (F.col("level") <= base + height) | (F.col("level") == 0) & (F.lit(base) == 0))
            nodes = self.levels(base, base + height - 1).where((F.col("n") > 1) | (F.col("level") == 0))
            block, none = self.block(base + height - F.col("level")).alias("block"), F.lit(None)
            rows = nodes.select("tree", block, F.lit(1).alias("kind"), "level", "idx", "doc_id", "altered", "name", "digest", none.cast("string").alias("subroot"), none.cast("array<string>").alias("steps"))
            if base:  # trees that end below are met in a lower round
                rows = rows.where("level > 0")
            heads = ends.unionByName(led).select("tree", block, F.lit(0).alias("kind"), "level", "idx", none.cast("long").alias("doc_id"), none.cast("string").alias("altered"), none.cast("string").alias("name"), none.cast("string").alias("digest"), "subroot", "steps")
            dealt = heads.unionByName(rows).repartition("tree", "block").sortWithinPartitions("tree", "block", "kind", F.desc("level"), "idx")
            out = dealt.mapInArrow(scan(base), PATH)
            led = stage(out.select("tree", "level", "idx", "subroot", "steps"), "paths")[0] if base else out
        return led


def proofs(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, leaf, altered, subroot, root and steps, the proof of each document. The stores are written to `path`, or to the shared folder."""
    spark = docs.sparkSession
    path = path or stage(docs.select("doc_id").limit(0), "manifest")[1]
    source, top = NodeStore(spark, f"{path}/sources"), NodeStore(spark, f"{path}/top")
    rows, _ = stage(leaves(docs).withColumn("name", F.lit(None).cast("string")), "leaves")
    depth = source.build(coordinates(rows, "doc_id", "digest"))
    subroots = source.tops(depth)
    roots = subroots.select(F.lit("top").alias("tree"), F.lit(None).cast("long").alias("doc_id"), "digest", F.lit(None).cast("string").alias("altered"), F.col("tree").alias("name"))
    height = top.build(coordinates(roots, "name"))
    ends = top.tops(height)
    root = ends.select("digest").first()
    up = top.paths(height, ends.withColumn("steps", F.array().cast("array<string>"))).select(F.col("name").alias("tree"), "steps")
    led = source.paths(depth, subroots.join(up, "tree"))
    return led.select("doc_id", F.col("digest").alias("leaf"), "altered", "subroot", F.lit(root[0] if root else None).cast("string").alias("root"), "steps")


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and the steps of its proof lead to."""

    def up(digest: Column, step: Column) -> Column:
        left = F.substring(step, 1, 1).cast("int") * 64
        return F.sha2(F.concat(F.substr(step, F.lit(2), left), digest, F.substr(step, left + 2, F.length(step))), 256)

    return F.aggregate(steps, leaf, up)


def manifest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: a row for each row of docs."""
    siblings = F.concat_ws("", F.transform("steps", lambda s: F.substr(s, F.lit(2), F.length(s))))
    got = proofs(docs, path).withColumn("folded_root", folded(F.coalesce("altered", "leaf"), F.col("steps")))
    return got.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql_field(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen(CAST({value} AS VARCHAR)) || ':' || {value} END"


def _sql_leaf(text: str) -> str:
    return "sha256(" + " || ".join(_sql_field(text if f == "text" else f) for f in FIELDS) + ")"


SQL = f"""
WITH RECURSIVE r AS (
  SELECT row_number() OVER () AS row, doc_id, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS k, {_sql_leaf("text")} AS leaf,
    CASE WHEN doc_id IS NOT NULL AND {crc32_sql("CAST(doc_id AS VARCHAR)")} % 2 = 0 THEN {_sql_leaf("replace(text, chr(10), '')")} ELSE {_sql_leaf("text")} END AS given FROM documents
), l AS (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY k) AS n FROM r
), t(k, lev, i, n, d) AS (
  SELECT k, 0, i, n, leaf FROM l
  UNION ALL
  SELECT k, any_value(lev) + 1, i // {ARITY}, any_value((n + {ARITY - 1}) // {ARITY}), sha256(string_agg(d, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY k, i // {ARITY}
), s AS (
  SELECT k, lev, d, row_number() OVER (ORDER BY k) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1
), u(lev, i, n, d) AS (
  SELECT 0, i, n, d FROM s
  UNION ALL
  SELECT any_value(lev) + 1, i // {ARITY}, any_value((n + {ARITY - 1}) // {ARITY}), sha256(string_agg(d, '' ORDER BY i)) FROM u WHERE n > 1 GROUP BY i // {ARITY}
), p AS (
  SELECT l.row, t.lev, coalesce(string_agg(t.d, '' ORDER BY t.i) FILTER (t.i < l.i // CAST(pow({ARITY}, t.lev) AS BIGINT)), '') AS a,
    coalesce(string_agg(t.d, '' ORDER BY t.i) FILTER (t.i > l.i // CAST(pow({ARITY}, t.lev) AS BIGINT)), '') AS b
  FROM l JOIN t ON l.k = t.k AND t.n > 1 AND t.i // {ARITY} = l.i // CAST(pow({ARITY}, t.lev + 1) AS BIGINT) GROUP BY l.row, t.lev
), q AS (
  SELECT s.k, s.lev + u.lev AS lev, coalesce(string_agg(u.d, '' ORDER BY u.i) FILTER (u.i < s.i // CAST(pow({ARITY}, u.lev) AS BIGINT)), '') AS a,
    coalesce(string_agg(u.d, '' ORDER BY u.i) FILTER (u.i > s.i // CAST(pow({ARITY}, u.lev) AS BIGINT)), '') AS b
  FROM s JOIN u ON u.n > 1 AND u.i // {ARITY} = s.i // CAST(pow({ARITY}, u.lev + 1) AS BIGINT) GROUP BY s.k, s.lev + u.lev
), x AS (
  SELECT row, lev, a, b FROM p UNION ALL SELECT l.row, q.lev, a, b FROM l JOIN q ON l.k = q.k
), f(row, lev, d) AS (
  SELECT row, 0, given FROM l
  UNION ALL
  SELECT f.row, f.lev + 1, sha256(x.a || f.d || x.b) FROM f JOIN x ON f.row = x.row AND f.lev = x.lev
), e AS (
  SELECT row, max_by(d, lev) AS folded_root FROM f GROUP BY row
), g AS (
  SELECT row, sha256(string_agg(a || b, '' ORDER BY lev)) AS proof FROM x GROUP BY row
)
SELECT l.doc_id, l.leaf, s.d AS subroot, root.d AS root, coalesce(g.proof, sha256('')) AS proof_sha256, e.folded_root, e.folded_root = root.d AS verified
FROM l JOIN s ON l.k = s.k JOIN e ON l.row = e.row LEFT JOIN g ON l.row = g.row JOIN (SELECT d FROM u WHERE n = 1) AS root ON true
"""
