"""Toxicity behind a noisy channel: disguised words are decoded to plain ones, then the restored text is scored.

The channel turns letters into look-alike digits and signs, repeats them, and spaces words out. A token is a
lattice: each run of one character may be any of the letters it can stand for, once or twice, or nothing. Viterbi decoding finds
the path that is likeliest under a trigram model of characters and the channel's costs, over all states and without a beam. A token that has neither a doubled letter nor a sign of the channel is a
lattice of one path and stands for itself; a doubled letter is enough to be decoded where the token is less likely, a character, than the model's words are on average. Time is in proportion to a token's length. Letters spaced out one by one are joined into one lattice with a possible word break after
each. Decoded words, their first letters and the other tokens are the features of a sparse logistic regression, learnt on a bounded sample.
The trigrams are counted over all documents that may be learnt from, with or without a label.

Defined cases: a null text counts as empty and gets the model's score of no words; texts are read whole; null labels are not learnt from; with no
labels at all every score is 0; repeated rows and null ids are scored row by row; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, fold_of, sample_by_class, sample_of, small_batches

#: Labelled documents of a class, hashed features, features with a weight, tokens a worker keeps.
PER_CLASS, DIMS, CHOSEN, KEPT = 5000, 1 << 20, 4096, 400_000
#: What digits and signs can stand for.
LOOKS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e"}
EDGES = ".,;:!?\"'()[]{}<>*#%&$|=~^-_/\\`"
SWAP, BREAK, DROP, ONE_OF_TWO = -math.log(0.3), 8.0, 14.0, 2.0
_sign = "".join(map(re.escape, LOOKS))
#: A letter beside a look-alike, or letters parted by signs.
_beside = rf"[^\W\d_][{_sign}]|[{_sign}][^\W\d_]|[^\W\d_][*._\-]+[^\W\d_][*._\-]"
#: Signs of the channel: any of these, or a letter three times or more.
DISGUISED, DOUBLED = re.compile(_beside + r"|([^\W\d_])\1\1"), re.compile(r"([^\W\d_])\1")
#: Three or more single characters parted by one separator each.
SPACED = re.compile(rf"(?<![^\s])(?:[^\W_][ ._\-*]|[{_sign}][ ._\-*]){{2,}}(?:[^\W_]|[{_sign}])(?![^\s.,;:!?])")


class Characters:
    """Interpolated trigrams of characters; '#' stands for a word's edge."""

    def __init__(self, words: Counter):
        tri: Counter = Counter()
        for word, n in words.items():
            w, n = "##" + word + "#", math.sqrt(n)
            for a, b, c in zip(w, w[1:], w[2:]):
                tri[a + b + c] += n
        self.take(tri)

    @classmethod
    def of(cls, trigrams: dict[str, float]) -> Characters:
        """From weights of trigrams that were summed elsewhere."""
        out = cls(Counter())
        out.take(Counter(trigrams))
        return out

    def take(self, tri: Counter) -> None:
        self.tri, self.bi, self.uni = tri, Counter(), Counter()
        for k, n in tri.items():
            self.bi[k[1:]] += n
            self.uni[k[2]] += n
        self.heads, self.firsts = Counter(), Counter()
        for k, n in self.tri.items():
            self.heads[k[:2]] += n
        for k, n in self.bi.items():
            self.firsts[k[0]] += n
        self.total, self.known = sum(self.uni.values()) + 100.0, {}
        #: What a character of the words learnt from costs on average.
        self.usual = sum(n * self.cost(k[:2], k[2]) for k, n in tri.items()) / max(sum(tri.values()), 1e-9)

    def cost(self, context: str, c: str) -> float:
        key = context + c
        if (found := self.known.get(key)) is None:
            p = (self.uni[c] + 0.5) / self.total
            p = (self.bi[key[1:]] + 4 * p) / (self.firsts[key[1]] + 4)
            p = (self.tri[key] + 4 * p) / (self.heads[context] + 4)
            found = self.known[key] = -math.log(p)
        return found


def odd(token: str, chars: Characters) -> bool:
    """Whether a token is worth decoding: it shows signs of the channel, or has a doubled letter and is no likely word."""
    if DISGUISED.search(token):
        return True
    if not DOUBLED.search(token):
        return False
    w = "##" + token.strip(EDGES) + "#"
    return sum(map(chars.cost, map("".join, zip(w, w[1:])), w[2:])) > chars.usual * (len(w) - 2)


def lattice(token: str, breaks: bool) -> Iterator[tuple[tuple[str, float], ...]]:
    """For each run of one character, what it may stand for and at what cost; '#' is a break between words."""
    for run in re.finditer(r"(.)\1*", token, re.S):
        yield _arcs(run[1], min(run.end() - run.start(), 3), breaks)


@lru_cache(65536)
def _arcs(c: str, n: int, breaks: bool) -> tuple[tuple[str, float], ...]:
    letters = [(c, 0.0)] if c.isalpha() else []
    letters += [(x, SWAP) for x in LOOKS.get(c, "")]
    arcs = []
    for x, cost in letters:
        if n == 1:
            arcs.append((x, cost))
        else:
            arcs += [(x + x, cost), (x, cost + (ONE_OF_TWO if n == 2 and x == c else 0.0))]
    if not c.isalpha():
        arcs += [("#", BREAK if c in LOOKS else 0.5), ("", DROP if c in LOOKS else 1.0)]
    if breaks:
        arcs += [(x + "#", cost + 0.5) for x, cost in arcs if x and x != "#"]
    return tuple(arcs)


def _chain(last: list | None, stop: list | None) -> list[list]:
    """The nodes after `stop` up to `last`, in reading order."""
    out = []
    while last is not stop:
        out.append(last)
        last = last[0]
    return out[::-1]


def decode(token: str, chars: Characters, breaks: bool = False, flush: int = 4096) -> list[str]:
    """Viterbi over the lattice with the last two characters as state: the likeliest words. Exact: no state is dropped.

    A state's path is a chain of nodes [node before, piece], so a step copies nothing; up to where all states' chains have met they are written out and freed.
    """
    root: list | None = None
    paths: dict[str, tuple[float, list | None]] = {"##": (0.0, None)}
    done: list[str] = []
    due = flush
    for step, arcs in enumerate(lattice(token, breaks), 1):
        new: dict[str, tuple[float, list | None]] = {}
        for state, (cost, node) in paths.items():
            for piece, own in arcs:
                s, total = state, cost + own
                for c in piece:
                    if c == "#" and s[1] == "#":
                        continue
                    total += chars.cost(s, c)
                    s = "##" if c == "#" else s[1] + c
                if s not in new or total < new[s][0]:
                    new[s] = (total, [node, piece])
        paths = new
        if step >= due:
            chains = [_chain(node, root) for _, node in paths.values()]
            shared = 0
            while shared < min(map(len, chains)) and all(c[shared] is chains[0][shared] for c in chains):
                shared += 1
            if shared:
                done += [node[1] for node in chains[0][:shared]]
                root = chains[0][shared - 1]
                root[0] = None
            due = step + max(flush, len(chains[0]) - shared)
    best = min(paths.items(), key=lambda x: x[1][0] + chars.cost(x[0], "#") if x[0] != "##" else x[1][0])
    return [w for w in "".join(done + [node[1] for node in _chain(best[1][1], root)]).split("#") if w]


def restored(token: str, chars: Characters) -> list[str]:
    """The plain words that a lower-case token stands for."""
    core = token.strip(EDGES)
    if not odd(token, chars):
        return [core] if core else []
    # signs at the edges that come once or twice may be letters; longer runs are ornament
    trimmed = re.sub(r"^([^\w\s])\1{2,}|([^\w\s])\2{2,}$", "", token).strip(".,;:?\"'()[]{}<>")
    return (decode(trimmed, chars) if odd(trimmed, chars) else [core]) if core else []


def features(words: list[str]) -> list[int]:
    """The columns of words and of their first four and five letters."""
    out = []
    for w in words:
        out.append(zlib.crc32(w.encode("utf-8", "replace")) % DIMS)
        out += [zlib.crc32(f"^{n}{w[:n]}".encode("utf-8", "replace")) % DIMS for n in (4, 5) if len(w) > n]
    return out


def tokens(text: str) -> set[str]:
    """Distinct tokens of the text; those that were spaced out begin with a line feed."""
    low = text.lower()
    found = set(low.split())
    for m in SPACED.finditer(low):
        found.add("\n" + re.sub(r"[ ._\-*]", "", m[0]))
    return found


_plain: dict[str, str] = {}


def plain_words(text: str) -> list[str]:
    """Tokens of letters only, without their edges, that show no sign of the channel; each distinct token once."""
    if len(_plain) > KEPT:
        _plain.clear()
    out = []
    for w in set(text.lower().split()):
        if (c := _plain.get(w)) is None:
            c = w.strip(EDGES)
            c = _plain[w] = c if c.isalpha() and not DISGUISED.search(w) else ""
        if c:
            out.append(c)
    return out


def trigrams(docs: DataFrame) -> dict[str, float]:
    """Of the words that two or more rows of docs have (copies count too): sums of the roots of their counts by trigram. Only this table reaches the driver."""
    small_batches(docs.sparkSession)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def table() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        held: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.update(plain_words(text))
            if len(held) > KEPT:
                yield table()
                held.clear()
        yield table()

    counted = docs.select(F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull()).mapInArrow(words, "word string, n long")
    often = counted.groupBy("word").agg(F.sum("n").alias("n")).where("n > 1").select(F.concat(F.lit("##"), "word", F.lit("#")).alias("w"), F.sqrt("n").alias("x"))
    each = often.select("x", F.explode(F.expr("transform(sequence(1, length(w) - 2), i -> substring(w, i, 3))")).alias("k"))
    # the sums are rounded, so their order doesn't matter
    return {r[0]: r[1] for r in each.groupBy("k").agg(F.round(F.sum("x"), 6)).collect()}


class Model:
    """Character model, weights of the features, and what each worker has already decoded."""

    def __init__(self, texts: list[str], labels: np.ndarray, chars: Characters | None = None):
        # texts are read one by one and only columns are kept, so the driver holds no text's tokens but one's
        if chars is None:
            plain: Counter = Counter()
            for text in texts:
                plain.update(plain_words(text))
            chars = Characters(Counter({w: n for w, n in plain.items() if n > 1}))
        self.chars = chars
        known: dict[str, tuple] = {}
        rows = []
        for text in texts:
            own: set[int] = set()
            for w in tokens(text):
                if (f := known.get(w)) is None:
                    f = known[w] = tuple(features(self.words(w)))
                own.update(f)
            rows.append(np.fromiter(own, np.int32, len(own)))
            if len(known) > 100_000:
                known.clear()
        self.fit(rows, labels)

    def words(self, token: str) -> list[str]:
        return decode(token[1:], self.chars, breaks=True) if token[0] == "\n" else restored(token, self.chars)

    def fit(self, rows: list[np.ndarray], labels: np.ndarray, steps: int = 300, ridge: float = 1e-4) -> None:
        """Logistic regression with Adam on the columns that tell the classes apart, at most CHOSEN by their z-score."""
        at = np.concatenate([*rows, np.zeros(0, np.int32)])
        names, col = np.unique(at, return_inverse=True)
        doc, n, k, y = np.repeat(np.arange(len(rows)), [len(r) for r in rows]), len(rows), len(names), labels.astype(float)
        with_it, ones = np.bincount(col, minlength=k), np.bincount(col, y[doc], k)
        share, m = y.mean() if n else 0.0, np.maximum(with_it, 1)
        z = (ones - with_it * share) / np.sqrt(m * max(share * (1 - share), 1e-9) * (1 - m / (n + 1)) + 0.25)
        chosen = np.flatnonzero((np.abs(z) > 3) & (with_it >= 3))
        chosen = chosen[np.argsort(-np.abs(z[chosen]), kind="stable")[:CHOSEN]]
        place = np.full(k, -1)
        place[chosen] = np.arange(len(chosen))
        keep = place[col] >= 0
        col, doc, k = place[col[keep]], doc[keep], len(chosen)
        # the rarer class counts as much as the other, up to four times
        weight = np.where(y > 0, min(4.0, max(1.0, (1 - share) / max(share, 1e-9))), 1.0)
        w, m, v = np.zeros(k + 1), np.zeros(k + 1), np.zeros(k + 1)
        for step in range(1, steps + 1):
            e = (1 / (1 + np.exp(-(np.bincount(doc, w[:-1][col], n) + w[-1]).clip(-30, 30))) - y) * weight
            g = np.append(np.bincount(col, e[doc], k), e.sum()) / max(n, 1) + ridge * np.append(w[:-1], 0)
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            w = w - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        self.bias = float(w[-1])
        self.weights = dict(zip(names[chosen].tolist(), w[:-1].tolist()))
        self.memory: dict[str, tuple] = {}

    def scores(self, texts: list[str | None]) -> list[float]:
        out, weights, memory = [], self.weights, self.memory
        for text in texts:
            if len(memory) > KEPT:
                memory.clear()
            hit: set[int] = set()
            for t in tokens(text) if text else ():
                if (f := memory.get(t)) is None:
                    f = memory[t] = tuple(x for x in features(self.words(t)) if x in weights)
                if f:
                    hit.update(f)
            z = self.bias + sum(weights[x] for x in sorted(hit))
            out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
        return out


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS) -> Model | None:
    """docs: what may be learnt from, in whole for the character model and by a sample for the regression; labels: doc_id and label."""
    known = labels.where(F.col(label).isNotNull()).select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_label"))
    chosen = sample_by_class(known, "_label", per_class, "_id")
    got = sample_of(docs, chosen).toPandas()
    got = got.sort_values(["doc_id", "text"]).drop_duplicates("text")
    return Model(got["text"].tolist(), got["_label"].to_numpy(), Characters.of(trigrams(docs))) if len(got) else None


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id and score of each row of docs."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def over(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).to_pylist()
        found = shared.value.scores(texts) if shared.value else [0.0] * len(texts)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], ["doc_id", "score"])

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), over, "doc_id long, score double")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held = fold_of("doc_id", 5) == 0
    out = score(docs, train(docs.where(~held), labels.where(~held)))
    return out.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
