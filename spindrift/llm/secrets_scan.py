"""Secret scans: patterns for known kinds, and character Markov models for the rest.

Two second-order Markov models over the characters of credentials, one of random strings and one of ordinary identifiers, are trained from labelled samples.
Random strings are the values the base patterns found in a bounded sample of documents, with as many drawn from the usual alphabets. Ordinary ones are the other
words of those documents and the names and words of Python's standard library (`lexicon`), both also as `composed` makes paths, compounds, constants and versions of them, with
drawn numbers, dates, rulers and sequences: what stands in ordinary text whether the sample has it or not. A first model learns no word of the documents that is long enough to be judged; of the long ones, the second
and last also learns those that the first takes for ordinary, so a secret in the sample isn't learnt as ordinary and can't hide itself. A run of credential characters whose log-likelihood ratio
favours the random model by a margin of nats a character, and in all by as much as LONG characters at the margin would, is a further span, `markov`. Where a run with a slash or an equals sign is ordinary as a whole,
the pieces between those signs are judged too, so a path doesn't hide a key in it. Where base spans cover a part of a run, what lies outside them is judged.
The margin is set on labelled strings held out from a fit (every fifth by hash): the greatest that loses at most SLACK of the best of recall less 20 times the false alarms' share. The model keeps recall and false alarms of those strings in `held_out`.

Defined cases: a null or empty text has no spans and the digest of the empty string; offsets are code points, ends exclusive; texts are scanned whole, matches of a kind do not
overlap and a match that fails its length is dropped with the text it used up; repeated rows and null ids are scanned row by row; an empty table gives no
rows; further columns are not read. Runs of digits and signs alone are numbers, never secrets; a UUID is random and may be marked.
"""

from __future__ import annotations

import hashlib
import importlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, drop, small_batches, stage

KINDS = ("assign", "access", "hex", "markov")


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


ASSIGN = re.compile("(?:" + "|".join([*map(_either, ("password", "passwd", "secret", "token")), _either("api") + "_?" + _either("key")]) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
#: What the models judge.
CREDENTIAL = re.compile(r"[A-Za-z0-9+/_=-]{12,}")

#: Pieces of a run that are judged where the run is ordinary.
BETWEEN = re.compile(r"[A-Za-z0-9+_-]{12,}")
#: What is learnt from: shorter words too.
LEARNT_FROM = re.compile(r"[A-Za-z0-9+/_=-]{6,}")

#: Documents in the sample, strings of each kind, nats a character in favour of the random model where none was set on held-out strings.
SAMPLED, STRINGS, MARGIN = 2000, 4000, 1.0
#: Runs shorter than LONG need as much in all as LONG characters at the margin; what of the best gain a higher margin may lose; characters of a piece that is learnt from.
LONG, SLACK, PIECE = 20, 0.002, 1024
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
CODE = np.full(128, -1, np.int64)
CODE[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))
#: Modules of the standard library whose names and docstrings are labelled ordinary.
MODULES = (
    "argparse array asyncio base64 builtins calendar codecs collections configparser csv dataclasses datetime decimal difflib email functools glob gzip hashlib html http "
    "inspect io itertools json locale logging math mimetypes multiprocessing operator os pathlib pickle platform random re secrets shutil signal socket sqlite3 ssl statistics "
    "string subprocess sys tarfile tempfile textwrap threading time tokenize traceback types typing unittest urllib uuid warnings xml zipfile"
).split()


def base(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the base kinds, in order of start and then of kind."""
    found = []
    # before the value of an assignment stands a colon or an equals sign
    if "=" in text or ":" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return [(a, KINDS[k], b) for a, k, b in sorted(found)]


class Markov:
    """Log-likelihood ratio of random strings to ordinary identifiers, by second-order transitions with backoff to first order."""

    def __init__(self, random: list[str], ordinary: list[str]):
        self.pairs = self._logs(random) - self._logs(ordinary)
        #: The margin, and recall and share of false alarms among strings that weren't learnt from.
        self.margin, self.held_out = MARGIN, (0.0, 0.0)

    def set_margin(self, random: list[str], ordinary: list[str], steps: np.ndarray = np.arange(0.2, 2.0, 0.05)) -> None:
        """From labelled strings that weren't learnt from."""
        hit = np.array([np.mean(marked(random, self, m)) for m in steps])
        false = np.array([np.mean(marked(ordinary, self, m)) for m in steps])
        gain = hit - 20 * false
        k = np.flatnonzero(gain >= gain.max() - SLACK)[-1]
        self.margin, self.held_out = float(steps[k]), (float(hit[k]), float(false[k]))

    @staticmethod
    def _logs(strings: list[str]) -> np.ndarray:
        n = len(ALPHABET)
        none, one, two = np.full(n, 0.5), np.zeros((n, n)), np.zeros((n, n, n))
        for s in strings:
            c = CODE[np.frombuffer(s.encode("ascii", "ignore"), np.uint8)]
            c = c[c >= 0]
            np.add.at(none, c, 1)
            np.add.at(one, (c[:-1], c[1:]), 1)
            np.add.at(two, (c[:-2], c[1:-1], c[2:]), 1)
        # each order backs off to the one below, so what ordinary text hardly ever has stays unlikely in contexts it never had
        one += 5 * none / none.sum()
        two += 5 * (one / one.sum(1, keepdims=True))[None]
        return np.log(two / two.sum(2, keepdims=True)).astype(np.float32)

    def ratios(self, strings: list[str]) -> np.ndarray:
        """Mean ratio a character of each string of credential characters."""
        if not strings:
            return np.zeros(0)
        sizes = np.array([len(s) for s in strings])
        c = CODE[np.frombuffer("".join(strings).encode("ascii"), np.uint8)]
        r = np.zeros(len(c), np.float64)
        r[2:] = self.pairs[c[:-2], c[1:-1], c[2:]]
        starts = np.cumsum(sizes) - sizes
        r[starts] = 0
        r[np.minimum(starts + 1, len(c) - 1)] = 0
        return np.add.reduceat(r, starts) / np.maximum(sizes - 2, 1)


def marked(strings: list[str], model: Markov, margin: float | None = None) -> list[bool]:
    """Whether each string of credential characters looks random."""
    margin = model.margin if margin is None else margin
    return [r * min(len(s) - 2, LONG - 2) >= margin * (LONG - 2) and not s.isdigit() and any(c.isalpha() for c in s) for s, r in zip(strings, model.ratios(strings).tolist())]


def outside(a: int, b: int, spans: list[tuple[int, str, int]]) -> list[tuple[int, int]]:
    """What of [a, b) no span covers; spans in order of start."""
    out = []
    for start, _, end in spans:
        if start < b and end > a:
            out.append((a, start))
            a = max(a, end)
    return [(x, y) for x, y in [*out, (a, b)] if x < y]


def drawn(n: int, seed: int = 11) -> list[str]:
    """Random strings of the usual alphabets and lengths."""
    r = np.random.default_rng(seed)
    kinds = ("0123456789abcdef", ALPHABET[:62], ALPHABET[26:62], ALPHABET[:26] + ALPHABET[52:62], ALPHABET)
    return ["".join(r.choice(list(kinds[i % len(kinds)]), int(r.integers(12, 41)))) for i in range(n)]


def lexicon() -> list[str]:
    """Names and words of Python's standard library."""
    out: set[str] = set()
    for module in map(importlib.import_module, MODULES):
        out.update(dir(module))
        for told in [module, *(getattr(module, name, None) for name in dir(module))]:
            if isinstance(doc := getattr(told, "__doc__", None), str):
                out.update(re.findall("[A-Za-z]{3,}", doc))
    return sorted(w for w in out if w.isascii())


def composed(names: list[str], n: int, seed: int = 12) -> list[str]:
    """n ordinary strings of each usual form: what people make of words, and numbers, dates, rulers and sequences."""
    r = np.random.default_rng(seed)
    some = lambda x, k: [x[i] for i in r.integers(0, len(x), k)]
    number = lambda least, most: "".join(map(str, r.integers(0, 10, int(r.integers(least, most)))))
    names = [w for w in names if w.isalpha() and len(w) <= 20] or ["ordinary", "identifier"]
    low = [w.lower() for w in names]
    several = lambda most: some(low, int(r.integers(2, most)))
    signs, orders = list("=-_/+"), [ALPHABET[:26], ALPHABET[26:52], ALPHABET[52:62], "qwertyuiop", "asdfghjkl", "zxcvbnm"]
    forms = (
        lambda: some(["", "/", "//"], 1)[0] + "/".join(several(7)),
        lambda: "-".join(several(6)),
        lambda: "_".join(several(5)),
        lambda: "".join(w + c for w, c in zip(some(low, 6), [*some(signs, 5), ""])),
        lambda: "".join(several(5)),
        lambda: "".join(w.capitalize() for w in several(5)),
        lambda: some(["", "_"], 1)[0].join(several(4)).upper(),
        lambda: some(names, 1)[0].upper(),
        lambda: some(low, 1)[0] + number(1, 5) + some(["-", "_", "/", ""], 1)[0] + some(low, 1)[0],
        lambda: number(8, 25),
        lambda: some(signs, 1)[0].join(number(2, 6) for _ in range(int(r.integers(3, 7)))),
        lambda: some(["-", "", "/", "_"], 1)[0].join([f"{r.integers(1900, 2100)}", f"{r.integers(1, 13):02}", f"{r.integers(1, 32):02}"]) + some(["", "T", "-", "_"], 1)[0] + number(2, 7) + some(["", "Z"], 1)[0],
        lambda: "".join(some(signs, 2)) * int(r.integers(6, 41)),
        lambda: some(list(ALPHABET), 1)[0] * int(r.integers(12, 81)),
        lambda: (some(orders, 1)[0] * 4)[int(r.integers(0, 10)) :][: int(r.integers(12, 40))],
    )
    return [form() for form in forms for _ in range(n)]


def labelled(docs: DataFrame) -> DataFrame:
    """random boolean, string: distinct values of base spans and distinct other words of docs, cut where they have more than PIECE characters."""

    def over(batch: pa.RecordBatch) -> pa.RecordBatch:
        kinds, strings = [], []
        for text in batch.column(0).to_pylist():
            at = 0
            for a, _, b in [*base(text), (len(text), "", len(text))]:
                words = [m[0] for m in LEARNT_FROM.finditer(text, at, max(at, a))]
                value = [m[0]] if (m := CREDENTIAL.search(text, a, b)) else []
                for kind, found in ((False, words), (True, value)):
                    pieces = [w[i : i + PIECE] for w in found for i in range(0, len(w), PIECE)]
                    kinds += [kind] * len(pieces)
                    strings += pieces
                at = max(at, b)
        return pa.RecordBatch.from_arrays([pa.array(kinds, pa.bool_()), pa.array(strings, pa.string())], ["random", "string"])

    return arrow_map(docs.where(F.col("text").isNotNull()).select(F.col("text").cast("string").alias("text")), over, "random boolean, string string").distinct()


def train(docs: DataFrame, rows: int | None = None, sampled: int = SAMPLED, strings: int = STRINGS) -> Markov:
    """From a bounded sample of documents, read in whole: what the base patterns mark, and the other words. At most 9 * strings pieces reach the driver."""
    small_batches(docs.sparkSession)
    rows = docs.count() if rows is None else rows
    key = F.xxhash64("doc_id", "text", F.lit("secrets"))
    part = docs.where(F.pmod(key, F.lit(1 << 20)) < F.lit(int((1 << 20) * min(1.0, sampled / max(rows, 1))) + 1))
    found, path = stage(labelled(part), "labelled")
    least = lambda kind, n: [r[0] for r in found.where(kind).orderBy(F.xxhash64("string"), "string").limit(n).select("string").collect()]
    random, names = least(F.col("random"), strings), sorted(least(~F.col("random"), 8 * strings))
    drop(docs.sparkSession, path)
    return fitted(random, names, strings)


def fitted(random: list[str], names: list[str], strings: int = STRINGS) -> Markov:
    """The model of labelled random strings and of the other words of documents, some of which may be secrets."""
    order = lambda x: hashlib.blake2b(x.encode(), digest_size=8).digest()
    random, known = sorted({*random}, key=order) + drawn(strings), lexicon()
    ordinary_of = lambda own: sorted({*own, *known, *composed(own, strings // 4), *composed(known, strings // 2, 13)})
    judged = [w for w in names if CREDENTIAL.fullmatch(w)]
    random_looking = {w for w, x in zip(judged, marked(judged, Markov(random, ordinary_of(sorted({*names} - {*judged}))))) if x}
    plain = ordinary_of([w for w in names if w not in random_looking])
    model, held = Markov(random, plain), lambda x: order(x)[0] % 5 == 0
    trial = Markov([x for x in random if not held(x)], [x for x in plain if not held(x)])
    apart = [x for x in plain if held(x) and CREDENTIAL.fullmatch(x)]
    trial.set_margin([x for x in random if held(x) and len(x) >= 12], apart)
    model.margin, model.held_out = trial.margin, trial.held_out
    return model


def scan(texts: list[str | None], model: Markov, margin: float | None = None) -> list[list[tuple[int, str, int]]]:
    """All spans of each text: the base ones, and those the models add."""
    found = [base(t) if t else [] for t in texts]
    where, strings = [], []
    for i, text in enumerate(texts):
        for m in CREDENTIAL.finditer(text or ""):
            for a, b in outside(m.start(), m.end(), found[i]):
                if CREDENTIAL.fullmatch(text, a, b):
                    where.append((i, a, b))
                    strings.append(text[a:b])
    pieces, inner = [], []
    for (i, a, b), x, s in zip(where, marked(strings, model, margin), strings):
        if x:
            found[i].append((a, "markov", b))
        elif "/" in s or "=" in s:
            for m in BETWEEN.finditer(s):
                pieces.append((i, a + m.start(), a + m.end()))
                inner.append(m[0])
    for (i, a, b), x in zip(pieces, marked(inner, model, margin)):
        if x:
            found[i].append((a, "markov", b))
    return [sorted(s, key=lambda x: (x[0], KINDS.index(x[1]), x[2])) for s in found]


def joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, k, b in spans)


def scan_documents(docs: DataFrame, model: Markov) -> DataFrame:
    """doc_id and spans array<struct<kind, start, stop>> of each row of docs."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))

    def over(batch: pa.RecordBatch) -> pa.RecordBatch:
        spans = scan(batch.column(1).to_pylist(), shared.value)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([[{"kind": k, "start": a, "stop": b} for a, k, b in s] for s in spans], kind)], ["doc_id", "spans"])

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), over, "doc_id long, spans array<struct<kind string, start long, stop long>>")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = scan_documents(docs, train(docs))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    only = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    return found.select(
        "doc_id",
        *(F.size(only(k)).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(text(F.filter("spans", lambda s: s["kind"] != "markov")).cast("binary"), 256).alias("base_sha256"),
        text(F.col("spans")).alias("spans"),
    )
