"""The Merkle manifest, importance resampling and byte-level BPE against brute force and the library."""

import hashlib
import math
import random
import re
import zlib
from array import array

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from spindrift.llm import bpe, merkle, queries, resampling

public_tokenizers = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, tampered=False):
    doc_id, text, lang, source, n = row
    if tampered and text and doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0:
        text = text.replace("\n", "")
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n, text)))


def grown(leaves):
    """All levels of a tree, one after the other."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def plain_manifest(rows):
    trees = {}
    for r in rows:
        trees.setdefault(r[3], []).append(r)
    order = sorted(trees, key=lambda s: b"" if s is None else b"s" + s.encode())
    built = {}
    for s in order:
        trees[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        built[s] = grown([leaf(r) for r in trees[s]])
    top = grown([built[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, r in enumerate(trees[s]):
            digest, proof = leaf(r, True), ""
            for levels, at in ((built[s], i), (top, k)):
                for level in levels[:-1]:
                    run, place = level[at // 3 * 3 : at // 3 * 3 + 3], at % 3
                    proof += "".join(run[:place] + run[place + 1 :])
                    digest = h(*run[:place], digest, *run[place + 1 :])
                    at //= 3
            out.append((r[0], leaf(r), built[s][-1][0], top[-1][0], h(proof), digest, digest == top[-1][0]))
    return out


def tables(seed, n, sources):
    r = random.Random(seed)
    rows = [(i, r.choice(["a\nb", "", None, "x" * r.randint(0, 50), "naïve\n日本\n"]), r.choice(["en", None]), r.choice(sources), r.choice([None, 3])) for i in range(n)]
    return rows + rows[:5] + [(None, "no id\n", "en", sources[0], 1)] * 3 + [(2, "another\ntext", None, sources[0], 9)] * (n > 2)


@pytest.mark.parametrize("n, sources", [(1, ["one"]), (40, ["a", None, "bé", "B"]), (700, ["hot"] * 5 + ["s1", "s2", None]), (60, [f"s{i:02}" for i in range(40)])])
@pytest.mark.parametrize("height", [1, 2, 5])
def test_manifest(spark, monkeypatch, n, sources, height):
    monkeypatch.setattr(merkle.NodeStore.__init__, "__defaults__", (3, height))
    rows = tables(n, n, sources) if n > 1 else [(7, "only\n", "en", "one", 5)]
    r = random.Random(0)
    r.shuffle(rows)
    got = merkle.manifest(spark.createDataFrame(rows, DOCS).withColumn("idx", F.lit(1)).withColumn("level", F.lit(2)).repartition(3))
    key = lambda rows: sorted(map(repr, rows))
    assert key(tuple(x) for x in got.collect()) == key(plain_manifest(rows))


def test_manifest_depends_on_rows_alone(spark):
    """Neither order nor partitions change a manifest; a changed row changes the root and no other leaf."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    a = merkle.manifest(docs.repartition(7)).toPandas().sort_values("doc_id", ignore_index=True)
    b = merkle.manifest(docs.coalesce(1)).toPandas().sort_values("doc_id", ignore_index=True)
    assert a.equals(b) and a["root"].nunique() == 1 and (a["verified"] | (a["folded_root"] != a["root"])).all()
    other = docs.withColumn("lang", F.when(F.col("doc_id") == 5, "zz").otherwise(F.col("lang")))
    c = merkle.manifest(other).toPandas().sort_values("doc_id", ignore_index=True)
    assert (a["leaf"] != c["leaf"]).sum() == 1 and c["root"][0] != a["root"][0]


def test_store_is_partitioned_by_level(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"t{i}", "en", "s", 1) for i in range(100)], DOCS)
    merkle.manifest(docs, str(tmp_path)).count()
    levels = sorted(p.name for p in (tmp_path / "sources").iterdir() if p.name.startswith("level="))
    assert levels == [f"level={i}" for i in range(6)]
    got = spark.read.parquet(str(tmp_path / "sources")).groupBy("level").count().toPandas().set_index("level")["count"]
    assert got.to_dict() == {0: 100, 1: 34, 2: 12, 3: 4, 4: 2, 5: 1}


def plain_resample(rows, target, buckets=10_000, least=20, percent=10, longest=1):
    def features(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        return [zlib.crc32(" ".join(words[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(words) - n + 1)]

    s, t = np.zeros(buckets), np.zeros(buckets)
    for into, texts in ((s, [r[1] for r in rows]), (t, target)):
        for text in texts:
            for b in features(text):
                into[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.sum() + buckets) / ((s[b] + 1) * (t.sum() + buckets)))) for b in range(buckets)]
    out = []
    for doc_id, text in rows:
        found = features(text)
        u = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        out.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((u + 0.5) / 4294967296))), None])
    fit = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for rank, r in enumerate(fit[: len(fit) * percent // 100], 1):
        r[4] = rank
    return sorted(map(repr, map(tuple, out)))


@pytest.mark.parametrize("longest", [1, 3])
def test_resampling(spark, longest):
    r = random.Random(longest)
    rows = [(i, " ".join(r.choice(["Alpha", "béta", "GAMMA", "été", "ÉTÉ", "x1", "日本", "_a-b", "z"]) for _ in range(r.randint(0, 60)))) for i in range(300)]
    rows += [(None, rows[0][1] + " more" * 30), (None, rows[0][1] + " more" * 30), (7, rows[7][1]), (901, None), (902, ""), (903, "q" * 100_000 + " w" * 100_000)]
    target = ["Alpha alpha béta", None, "x1 z z"]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("own")).withColumn("run", F.lit(0)).repartition(5)
    got = resampling.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), buckets=500, longest=longest, percent=37)
    assert sorted(repr(tuple(x)) for x in got.collect()) == plain_resample(rows, target, 500, percent=37, longest=longest)


def test_a_score_of_a_third_of_all_rows(spark):
    """Equal scores are ranked by id over all the runs that they lie in."""
    scores = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit(30).cast("long").alias("n_features"), F.lit(0).cast("long").alias("weight"), F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") % 7).cast("long").alias("score"))
    got = resampling.draw(scores.repartition(6), percent=50).toPandas()
    want = got.sort_values(["score", "doc_id"], ascending=[False, True], ignore_index=True)
    assert want["rank"][:1500].tolist() == list(range(1, 1501)) and want["rank"][1500:].isna().all()


@pytest.fixture(scope="module")
def path():
    return str(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def texts_of(seed, n):
    r = random.Random(seed)
    alphabet = "abcdeeetthhiinnss  ''\n\t.,123éß日本語😀Ωя½²  ก" + "".join(map(chr, range(0x558, 0x560)))
    odd = ["", "a" * 5000, " " * 30_000 + "x", "\n" * 777, "ab" * 2000, "the" * 3000, "<|endoftext|>a <|endoftext|><|endof", "it's we'll I'D 'S", "x \r\n  y", "\x1c\x1d a\x85b\xa0 c", "½ ²³ ՘", "é ‍️"]
    return odd + ["".join(r.choice(alphabet) for _ in range(r.randint(1, 80))) for _ in range(n)]


def test_bpe_like_the_library(path, library):
    b = bpe.bpe(path)
    for text in texts_of(1, 4000):
        parts = b.parts(text)
        known = dict(b.encode_words(sorted({w for w in parts if isinstance(w, str)})))
        got = [i for w in parts for i in (known[w] if isinstance(w, str) else [w])]
        assert got == library.encode(text, add_special_tokens=False).ids, text[:80]
        assert b.decode(array("I", got)) == library.decode(got, skip_special_tokens=False)


def test_trie_states_are_plain_encodings(path):
    """Each word of a trie, shared prefixes and all, encodes as by merges in order; so do arbitrary bytes."""
    b, r = bpe.Bpe(path), random.Random(2)
    words = sorted({bytes(r.choice(b"aehnrst \xc3\xa9\xff") for _ in range(r.randint(1, 14))) for _ in range(3000)})
    assert [list(x) for x in b.encode(words)] == [b.plain(w) for w in words]
    shared = bpe.Trie()
    for i, w in enumerate([b"there", b"then", b"the", b"other", b"t"]):
        shared.insert(w, i)
    assert sum(len(edge) for _, edge, _ in shared.paths()) == len(b"there" b"n" b"other")


def test_latin_splits_like_the_pattern(path):
    b = bpe.bpe(path)
    for c in range(256):
        text = f"x{chr(c)}x 1{chr(c)}1 !{chr(c)}! {chr(c)}{chr(c)} '{chr(c)}'s"
        assert b.words(text) == b.split.findall(text)


@pytest.mark.parametrize("most, sampled", [(0, 10), (50, 10), (65536, 4000)])
def test_round_trip(spark, path, library, monkeypatch, most, sampled):
    """Which words are broadcast, and when a task forgets, doesn't change a result."""
    monkeypatch.setattr(bpe, "HELD", 500)
    texts = [None, *texts_of(3, 150), "word " * 50_000]
    rows = [(None if i == 5 else i, t) for i, t in enumerate(texts)] + [(1, texts[1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(1)).withColumn("word", F.lit(2)).repartition(3)
    got = bpe.round_trip(docs, path, sampled=sampled, most=most).collect()
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(repr(tuple(r)) for r in got) == sorted(map(repr, want))


def test_op13_on_a_table(spark, path, library):
    got = queries.QUERIES["op13_bpe"](spark, "/root/testdata/sf0.001").toPandas().set_index("doc_id")
    docs = pd.read_parquet("/root/testdata/sf0.001/documents.parquet")
    for doc_id, text in zip(docs["doc_id"], docs["text"]):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert got.loc[doc_id, "n_tokens"] == len(ids) and got.loc[doc_id, "ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
