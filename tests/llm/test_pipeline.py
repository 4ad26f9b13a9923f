"""The pipeline stage by stage, each against a plain version on its own input."""

import collections
import re

import duckdb
import pytest
from pyspark.sql import functions as F
from test_llm import COLUMNS, base_rows, brute_components  # noqa: F401

import corpus_pipeline
from spindrift.llm import mixing
from spindrift.llm.common import stage

pytest.importorskip("public_tokenizers")


def test_stages(spark, tmp_path):
    from tokenizers import Tokenizer

    import public_tokenizers

    docs = spark.createDataFrame([r for r in base_rows() if r[0] is not None], COLUMNS).withColumnRenamed("n_chars", "lang_pred")
    docs, _ = stage(docs, "input")
    tables = [docs.toPandas()]
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns
        docs, _ = stage(out, name)
        tables.append(docs.toPandas())
    start, known, unique, apart, mixed, packed = tables
    # language ID: what has no letter goes, and ordinary documents stay
    assert {100, 101, 102, 103}.isdisjoint(known.doc_id) and set(start.doc_id) - {100, 101, 102, 103} == set(known.doc_id)
    # exact dedup: the smallest id of each normalised text
    least: dict = {}
    for i, t in zip(known.doc_id, known.text):
        k = re.sub("[\\x20\\x09-\\x0D]+", " ", t)
        least[k] = min(i, least.get(k, i))
    assert sorted(unique.doc_id) == sorted(least.values())
    # near dedup: the smallest id of each component
    _, comps = brute_components(dict(zip(unique.doc_id, unique.text)))
    assert sorted(apart.doc_id) == sorted(i for i, c in comps.items() if c == i)
    # mixing: as often as the SQL says
    con = duckdb.connect()
    con.register("documents", apart)
    want = {i: taken // size for i, size, taken in con.execute(f"select doc_id, size, taken from ({mixing.SQL})").fetchall() if taken}
    assert collections.Counter(mixed.doc_id) == want
    # packing: every token of every copy once
    t = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    total = sum(len(t.encode(x, add_special_tokens=False).ids) + 1 for x in mixed.text)
    assert packed.length.sum() == total and packed.groupby("sequence_id").length.sum().max() <= 1024


def brute_run(spark, docs, sf_dir):
    """Ids and token counts of what run() packs: the stages' decisions by plain loops, but for the network's, which is asked text by text."""
    from tokenizers import Tokenizer

    import public_tokenizers
    from spindrift.llm import language_id

    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    net = language_id.train(rows.where(language_id.fold_of("doc_id", 4) != 2))
    pick = []
    for row in docs.itertuples(index=False):
        (name,), (score,) = language_id.predict(net, [row.text])
        if name != "und" and score >= corpus_pipeline.LEAST_SCORE:
            pick.append(row)
    least: dict = {}
    for row in sorted(pick, key=lambda r: r.doc_id):
        least.setdefault(re.sub("[\\x20\\x09-\\x0D]+", " ", row.text), row)
    _, comps = brute_components({r.doc_id: r.text for r in least.values()})
    apart = [r for r in least.values() if comps[r.doc_id] == r.doc_id]
    con = duckdb.connect()
    con.register("documents", type(docs)(apart, columns=docs.columns))
    copies = {i: taken // size for i, size, taken in con.execute(f"select doc_id, size, taken from ({mixing.SQL})").fetchall() if taken}
    t = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    return collections.Counter({r.doc_id: copies[r.doc_id] * (len(t.encode(r.text, add_special_tokens=False).ids) + 1) for r in apart if r.doc_id in copies}), len(docs) - len(pick)


def test_run(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").toPandas()
    want, _ = brute_run(spark, docs, d)
    got = corpus_pipeline.run(spark, d).toPandas()
    assert collections.Counter(got.groupby("doc_id").length.sum().to_dict()) == want
    assert got.groupby("sequence_id").length.sum().max() <= 1024


def test_rejects(spark):
    """What could be of any language goes, and nothing else."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    odd = spark.createDataFrame([(10**6, "1234 5678"), (10**6 + 1, None), (10**6 + 2, "%%% \n")], "doc_id long, text string")
    got = corpus_pipeline.identify_language(spark, docs.unionByName(odd, allowMissingColumns=True), "")
    gone = docs.join(got.select("doc_id"), "doc_id", "left_anti").select("text").collect()
    assert got.where("doc_id >= 1000000").count() == 0 and len(gone) <= 0.01 * docs.count() and all(len(r.text) < 60 for r in gone)


def test_odd_tables(spark, tmp_path):
    docs = spark.createDataFrame(base_rows(), COLUMNS).withColumn("_h", F.lit(1)).withColumn("copies", F.lit("x"))
    docs.write.parquet(f"{tmp_path}/odd/documents.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0 and corpus_pipeline.run(spark, f"{tmp_path}/odd").where("doc_id is null").count() <= 2
