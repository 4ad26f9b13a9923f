"""Byte-level BPE encoding and decoding through tries of words.

The last token of a prefix's encoding is the one token that ends there and may follow the last token of the prefix before it: an encoding is right exactly if each two neighbours in it are what
their bytes alone encode to. So a prefix's whole encoding is kept as a single state, its last token, and the rest follows by stepping back.
Distinct words (pre-tokens) are inserted into a trie, whose edges are byte strings; a depth-first walk carries the states of the path and computes those of a shared prefix once for all words below.

Work is dealt by documents, and no text is shuffled. The most frequent words of a bounded sample, at most FREQUENT, are counted and encoded by Spark jobs first, through tries over ranges of sorted words, and broadcast; what a
task meets besides goes into a trie for each batch of documents, of at most TRIE bytes of words (a longer word has its own), and is remembered up to HELD bytes. The sample decides only where a word is encoded, never what becomes of it.

Defined cases: a null or empty text has no ids and decodes to the empty text; special strings inside a text are their one id, as the library's default has it; texts and words of any length are encoded whole; repeated
rows and null ids are treated row by row; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import gc
import json
import re
import unicodedata
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import cache, cached_property
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, small_batches

#: Documents in the sample, words that are broadcast, bytes of words of one trie, bytes of words that a task remembers, pairs whose check is remembered.
SAMPLED, FREQUENT, TRIE, HELD, PAIRS = 4000, 65536, 1 << 18, 1 << 22, 1 << 20
#: The split pattern of byte-level pre-tokenization.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Outside these ranges Unicode versions may class a character differently, and the library's own splitter is asked.
AGREED = "\\x00-\u052f\u2000-\u206f\u3040-\u30ff\u4e00-\u9fff\uac00-\ud7a3"


class Trie:
    """Words by their shared prefixes; an edge is a byte string, a node a list: its edge, its children by their first byte, the word's number or None."""

    def __init__(self) -> None:
        self.root: list = [b"", {}, None]

    def insert(self, word: bytes, number: int) -> None:
        node, at = self.root, 0
        while at < len(word):
            child = node[1].get(word[at])
            if child is None:
                node[1][word[at]] = [word[at:], {}, number]
                return
            edge, same = child[0], 1
            if not word.startswith(edge, at):
                most = min(len(edge), len(word) - at)
                while same < most and edge[same] == word[at + same]:
                    same += 1
                middle = [edge[:same], {edge[same]: child}, None]
                child[0] = edge[same:]
                node[1][word[at]] = middle
                child = middle
            at += len(child[0])
            node = child
        node[2] = number

    def paths(self) -> Iterator[tuple[int, bytes, int | None]]:
        """Depth first: how long the path to a node's parent is, the edge that leads on, the number of the word that ends there."""
        todo = [(0, self.root)]
        while todo:
            depth, (edge, children, number) = todo.pop()
            yield depth, edge, number
            todo += ((depth + len(edge), child) for child in children.values())


class Bpe:
    """A tokenizers .json file of the byte-level BPE kind: its vocabulary, merges and special strings."""

    def __init__(self, path: str):
        import regex

        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted({*range(256)} - {*shown}))}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = {bytes(byte[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in self.special}
        self.ids = vocab
        self.bytes_of = {i: piece for piece, i in vocab.items()} | {i: s.encode() for s, i in self.special.items()}
        self.rank: dict[int, int] = {}
        self.halves: dict[int, tuple[int, int, int]] = {}
        for k, merge in enumerate(spec["model"]["merges"]):
            a, b = (vocab[bytes(byte[c] for c in half)] for half in (merge if isinstance(merge, list) else merge.split(" ")))
            self.rank[a << 32 | b] = k
            self.halves.setdefault(vocab[self.bytes_of[a] + self.bytes_of[b]], (k, a, b))
        # every beginning of a token; the longest that a path ends in says which tokens end there
        self.starts = {piece[:i] for piece in vocab for i in range(1, len(piece) + 1)}
        self.steps: dict[bytes, tuple[bytes, list[tuple[int, int]]]] = {}
        self.split = regex.compile(SPLIT)
        self.other = regex.compile(f"[^{AGREED}]")
        # the same pattern for texts of Latin-1 characters, with their classes spelt out; what begins with a letter is tried first, which nothing else in it can begin with
        class_of = lambda kind: "".join(re.escape(chr(c)) for c in range(256) if unicodedata.category(chr(c))[0] == kind)
        letter, number, blank = class_of("L"), class_of("N"), "\t\n\x0b\x0c\r \x85\xa0"
        self.beyond = re.compile("[^\x00-\xff]")
        self.latin = re.compile(f" ?[{letter}]+|'(?:[stmd]|re|ve|ll)| ?[{number}]+| ?[^{letter}{number}{blank}]+|[{blank}]+(?![^{blank}])|[{blank}]+")
        self.specials = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.follows: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}

    @cached_property
    def tokenizer(self):
        """The library's own, for its splitter alone."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def words(self, text: str) -> list[str]:
        """The pre-tokens of a text without special strings."""
        if not self.beyond.search(text):
            return self.latin.findall(text)
        if self.other.search(text):
            return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        return self.split.findall(text)

    def parts(self, text: str) -> list[str | int]:
        """The pre-tokens of a text, and the ids of its special strings."""
        if self.specials and self.specials.search(text):
            return [x for i, part in enumerate(self.specials.split(text)) for x in ([self.special[part]] if i % 2 else self.words(part))]
        return self.words(text)

    def plain(self, word: bytes) -> list[int]:
        """A word's ids by its merges in order of rank, one after the other."""
        got = [self.ids[word[i : i + 1]] for i in range(len(word))]
        while len(got) > 1:
            best = min(range(len(got) - 1), key=lambda i: self.rank.get(got[i] << 32 | got[i + 1], 1 << 60))
            if (k := self.rank.get(got[best] << 32 | got[best + 1])) is None:
                break
            a, b = got[best : best + 2]
            out, i = [], 0
            joined = self.ids[self.bytes_of[a] + self.bytes_of[b]]
            while i < len(got):
                if i + 1 < len(got) and got[i] == a and got[i + 1] == b and self.rank[a << 32 | b] == k:
                    out.append(joined)
                    i += 2
                else:
                    out.append(got[i])
                    i += 1
            got = out
        return got

    def may_start(self, token: int) -> bool:
        """Whether a token's bytes encode to the token."""
        if (known := self.whole.get(token)) is None:
            known = self.whole[token] = self.plain(self.bytes_of[token]) == [token]
        return known

    def may_follow(self, before: int, token: int) -> bool:
        """Whether the bytes of two tokens encode to these two: no merge across their boundary comes up before the parts beside it are merged away from it.

        The parts that touch the boundary are, from the tokens down, the right halves of the left token and the left halves of the right one. Each lives until the rank of the merge that takes it in. A merge across is done
        if its rank is lower than that of the left part's own, or not higher than that of the right part's: of equal merges the leftmost is first.
        """
        key = before << 32 | token
        if (known := self.follows.get(key)) is not None:
            return known
        left, right, end_left, end_right, fits = before, token, 1 << 60, 1 << 60, True
        while True:
            k = self.rank.get(left << 32 | right)
            if k is not None and k < end_left and k <= end_right:
                fits = False
                break
            a, b = self.halves.get(left), self.halves.get(right)
            if a is None and b is None:
                break
            # the part that was made last is taken apart first
            if b is None or a is not None and a[0] > b[0]:
                end_left, left = a[0], a[2]
            else:
                end_right, right = b[0], b[1]
        if len(self.follows) >= PAIRS:
            self.follows.clear()
        self.follows[key] = fits
        return fits

    def step(self, end: bytes) -> tuple[bytes, list[tuple[int, int]]]:
        """Of what a path ends in, the longest part that some token begins with; and the tokens that end there with their lengths, longest first."""
        state = end
        while state not in self.starts:
            state = state[1:]
        if len(self.steps) >= PAIRS // 4:
            self.steps.clear()
        found = [(self.ids[state[i:]], len(state) - i) for i in range(len(state)) if state[i:] in self.ids]
        self.steps[end] = state, found
        return state, found

    def encode(self, words: list[bytes]) -> list[array]:
        """The ids of distinct words, through one trie."""
        collects = gc.isenabled()
        gc.disable()  # a trie has no cycles, but very many nodes that would be searched for them
        try:
            return self._encode(words)
        finally:
            if collects:
                gc.enable()

    def _encode(self, words: list[bytes]) -> list[array]:
        trie, out = Trie(), [array("I")] * len(words)
        for i, word in enumerate(words):
            trie.insert(word, i)
        may_start, may_follow, follows, step, steps, bytes_of = self.may_start, self.may_follow, self.follows, self.step, self.steps, self.bytes_of
        states, last = [b""], array("q", [-1])
        for depth, edge, number in trie.paths():
            del states[depth + 1 :], last[depth + 1 :]
            state = states[depth]
            for i in range(len(edge)):
                end = state + edge[i : i + 1]
                depth += 1
                state, found = steps.get(end) or step(end)
                for token, size in found:
                    if size == depth:
                        if may_start(token):
                            break
                    else:
                        before = last[depth - size]
                        known = follows.get(before << 32 | token)
                        if may_follow(before, token) if known is None else known:
                            break
                else:
                    raise ValueError(f"no token ends at byte {depth} of a word")
                states.append(state)
                last.append(token)
            if number is not None:
                found, at = array("I"), depth
                while at:
                    found.append(last[at])
                    at -= len(bytes_of[last[at]])
                found.reverse()
                out[number] = found
        return out

    def encode_words(self, words: list[str], most: int = TRIE) -> Iterator[tuple[str, array]]:
        """Distinct words with their ids, through tries of at most `most` bytes of words, or of one word."""
        held: list[tuple[str, bytes]] = []
        size = 0
        for word in words:
            raw = word.encode()
            if held and size + len(raw) > most:
                yield from zip((w for w, _ in held), self.encode([r for _, r in held]))
                held, size = [], 0
            held.append((word, raw))
            size += len(raw)
        if held:
            yield from zip((w for w, _ in held), self.encode([r for _, r in held]))

    def decode(self, ids: array) -> str:
        """The text of ids, special strings included; bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@cache
def bpe(path: str) -> Bpe:
    return Bpe(path)


def frequent(docs: DataFrame, path: str, rows: int, sampled: int = SAMPLED, most: int = FREQUENT) -> dict[str, bytes]:
    """The ids of the words that a bounded sample of documents has most often, at most `most` of them: encoded through tries over ranges of sorted words."""
    part = docs.where(F.pmod(F.xxhash64("doc_id", F.lit("bpe")), F.lit(1 << 20)) < F.lit(int((1 << 20) * min(1.0, sampled / max(rows, 1))) + 1)).select("text")

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        found: Counter = Counter()
        for text in batch.column(0).to_pylist():
            if text:
                found.update(w for w in bpe(path).parts(text) if isinstance(w, str) and len(w) <= 64)
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, ids = zip(*bpe(path).encode_words(batch.column(0).to_pylist()))
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([i.tobytes() for i in ids], pa.binary())], ["word", "ids"])

    top = arrow_map(part, count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(most).select("word")
    got = arrow_map(top.repartitionByRange("word").sortWithinPartitions("word"), encode, "word string, ids binary").toPandas()
    return {word: bytes(ids) for word, ids in zip(got["word"], got["ids"])}


def encode(docs: DataFrame, path: str, sampled: int = SAMPLED, most: int = FREQUENT) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers, four bytes each): a row for each row of docs."""
    spark = docs.sparkSession
    small_batches(spark, 128)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    common = spark.sparkContext.broadcast(frequent(docs, path, docs.count(), sampled, most))

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = bpe(path)
        fixed = common.value | {i: array("I", [i]).tobytes() for i in b.special.values()}
        known, size = dict(fixed), 0
        for batch in batches:
            parts = [b.parts(text) if text else () for text in batch.column(1).to_pylist()]
            if size > HELD:
                known, size = dict(fixed), 0
            for word, ids in b.encode_words(sorted({w for words in parts for w in words if w not in known})):
                known[word] = ids.tobytes()
                size += len(word) + 4 * len(ids)
            ids = [b"".join(map(known.__getitem__, words)) for words in parts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return docs.mapInArrow(over, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """encoded (doc_id, ids) with text, what the ids stand for."""
    small_batches(encoded.sparkSession, 128)

    def over(batch: pa.RecordBatch) -> pa.RecordBatch:
        b = bpe(path)
        texts = [b.decode(array("I", ids)) for ids in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return arrow_map(encoded.select("doc_id", "ids"), over, "doc_id long, ids binary, text string")


def round_trip(docs: DataFrame, path: str, **how) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: each text encoded and decoded again."""
    got = decode(encode(docs, path, **how), path)
    return got.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), str(public_tokenizers.path("byte_bpe_50k.json")))
