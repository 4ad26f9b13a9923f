"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads whole texts, white space, digits and punctuation included, forwards and backwards, and gives every byte a distribution over the languages;
a document's probabilities are the normalised geometric mean over the bytes of its letters (ASCII letters, and all bytes of other characters). A text is read in stretches of STRETCH
bytes; the state of each way starts CONTEXT bytes before its stretch, so every byte is labelled with at least that much of the text on either side. What lies
outside the text is read as spaces. Stretches of equal length are read side by side, so time is in proportion to the bytes and memory is bounded whatever a text's length;
a prediction depends on the text alone, not on its neighbours in a batch. The network is trained in numpy by backpropagation through time on stretches drawn from a bounded sample of the labelled rows:
PER_CLASS documents of a language, each of at most LEARNT characters (longer ones aren't learnt from, but are predicted in whole).

Defined cases: a null text, or one with no letter, is `und` with score 0; rows with a null lang are never learnt from; without any row to learn from
every prediction is `und`; texts are read whole; null ids and repeated rows are predicted row by row; an empty table
gives no rows; ties go to the language that sorts first; further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LEARNT, arrow_map, fold_of, sample_by_class, small_batches

#: Documents of a language in the sample, stretches drawn from them, hidden units each way, passes, bytes of a stretch in training and in use, bytes of context on either side, stretches read side by side.
PER_CLASS, DRAWN, HIDDEN, PASSES, TRAINED, STRETCH, CONTEXT, SIDE = 250, 2000, 12, 3, 64, 224, 16, 1024
#: Lengths of a text's last stretch are multiples of this.
STEP = 32
#: Bytes whose labels are pooled.
POOLED = np.array([c >= 128 or chr(c).isalpha() for c in range(256)])


def raw(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace")


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


class Network:
    """Gated recurrent units both ways; parameters are float32 arrays by name, with the way (0: forwards) as first axis."""

    def __init__(self, classes: list[str], hidden: int = HIDDEN, seed: int = 1):
        self.classes, self.hidden = classes, hidden
        r, h, c = np.random.default_rng(seed), hidden, len(classes)
        p = {
            "w": r.normal(0, 0.3, (2, 256, 3 * h)),
            "u": r.normal(0, 1 / np.sqrt(h), (2, h, 3 * h)),
            "c": np.zeros((2, 3 * h)),
            "o": r.normal(0, 1 / np.sqrt(2 * h), (2, h, c)),
            "b": np.zeros(c),
        }
        self.p = {k: v.astype(np.float32) for k, v in p.items()}

    @staticmethod
    def ways(x: np.ndarray, context: int) -> np.ndarray:
        """Bytes (2, T, B) in the order each way reads them, of x (B, context + n + context)."""
        t = x.shape[1] - context
        return np.stack([x[:, :t].T, x[:, context:][:, ::-1].T])

    def run(self, x: np.ndarray, keep: list | None = None):
        """Yields the states (2, B, H) after each step over x (2, T, B); what the backward pass needs goes to keep."""
        h = self.hidden
        w, u = self.p["w"] + self.p["c"][:, None], self.p["u"]
        _, steps, n = x.shape
        state = np.zeros((2, n, h), w.dtype)
        a, b = np.empty((2, n, 3 * h), w.dtype), np.empty((2, n, 3 * h), w.dtype)
        for t in range(steps):
            for d in (0, 1):
                np.take(w[d], x[d, t], axis=0, out=a[d], mode="clip")
            np.matmul(state, u, out=b)
            gates = a[..., : 2 * h] + b[..., : 2 * h]
            gates *= 0.5
            np.tanh(gates, out=gates)
            gates += 1
            gates *= 0.5
            new = b[..., 2 * h :] * gates[..., h:]
            new += a[..., 2 * h :]
            np.tanh(new, out=new)
            old, state = state, state - new
            state *= gates[..., :h]
            state += new
            if keep is not None:
                keep.append((old, gates, new, b[..., 2 * h :].copy()))
            yield state

    def positions(self, x: np.ndarray, context: int = CONTEXT) -> np.ndarray:
        """Log probabilities (n, B, C) of every byte of x (B, context + n + context) but the context."""
        read = self.ways(x, context)
        n = read.shape[1] - context
        y = np.zeros((n, x.shape[0], len(self.classes)), self.p["o"].dtype)
        for t, state in enumerate(self.run(read)):
            if t >= context:
                own = np.matmul(state, self.p["o"])
                y[t - context] += own[0]
                y[n - 1 - (t - context)] += own[1]
        y += self.p["b"]
        y -= y.max(axis=2, keepdims=True)
        return y - np.log(np.exp(y).sum(axis=2, keepdims=True))

    def gradients(self, x: np.ndarray, y: np.ndarray, context: int = CONTEXT) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy over all labelled bytes, by backpropagation through time."""
        h, read, kept = self.hidden, self.ways(x, context), []
        states = list(self.run(read, kept))
        steps, rows = len(states), x.shape[0]
        n = steps - context
        both = np.stack(states[context:])
        f, b = both[:, 0], both[::-1, 1]
        o, u = self.p["o"], self.p["u"]
        e = f @ o[0] + b @ o[1] + self.p["b"]
        e = np.exp(e - e.max(axis=2, keepdims=True))
        e /= e.sum(axis=2, keepdims=True)
        e[:, np.arange(rows), y] -= 1
        e /= n * rows
        g = {"o": np.stack([np.tensordot(s, e, ((0, 1), (0, 1))) for s in (f, b)]), "b": e.sum((0, 1))}
        down = np.stack([e, e[::-1]], axis=1) @ o.transpose(0, 2, 1)
        gu, da, ds = np.zeros_like(u), np.empty((steps, 2, rows, 3 * h), u.dtype), np.zeros((2, rows, h), u.dtype)
        back = u.transpose(0, 2, 1)
        for t in range(steps - 1, -1, -1):
            old, gates, new, own = kept[t]
            z, r = gates[..., :h], gates[..., h:]
            if t >= context:
                ds = ds + down[t - context]
            dn = ds * (1 - z) * (1 - new * new)
            a = da[t]
            a[..., :h] = ds * (old - new) * z * (1 - z)
            a[..., h : 2 * h] = dn * own * r * (1 - r)
            a[..., 2 * h :] = dn
            db = a.copy()
            db[..., 2 * h :] *= r
            gu += old.transpose(0, 2, 1) @ db
            ds = ds * z + db @ back
        gw = np.zeros_like(self.p["w"])
        for d in (0, 1):
            at = read[d].ravel()
            order = np.argsort(at, kind="stable")
            names, first = np.unique(at[order], return_index=True)
            gw[d][names] = np.add.reduceat(da[:, d].reshape(-1, 3 * h)[order], first, axis=0)
        return {**g, "u": gu, "c": gw.sum(1), "w": gw}

    def fit(self, x: np.ndarray, labels: np.ndarray, passes: int = PASSES, batch: int = 64, rate: float = 0.012, seed: int = 2) -> "Network":
        """x: (rows, CONTEXT + n + CONTEXT) bytes; Adam with a rate that falls in the second half."""
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(a) for k, a in self.p.items()}
        batches = [part for _ in range(passes) for part in np.array_split(r.permutation(len(x)), max(1, len(x) // batch))]
        for step, at in enumerate(batches, 1):
            now = rate * min(1.0, 2 * (1 - step / (len(batches) + 1)))
            for k, g in self.gradients(x[at], labels[at]).items():
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.01 * (g * g - v[k])
                self.p[k] -= (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
        return self

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """Mean log probabilities (texts, C) over the pooled bytes of each text."""
        pad = b" " * CONTEXT
        spaced, places, at = [], [], 0
        for i, text in enumerate(texts):
            n = len(text)
            rest = -(-(n % STRETCH) // STEP) * STEP
            spaced += (pad, text, b" " * (n // STRETCH * STRETCH + rest - n if rest else 0), pad)
            places += [(STRETCH, i, at + k * STRETCH) for k in range(n // STRETCH)]
            if rest:
                places.append((rest, i, at + n // STRETCH * STRETCH))
            at += 2 * CONTEXT + n // STRETCH * STRETCH + rest
        flat = np.frombuffer(b"".join(spaced), np.uint8)
        out, counted = np.zeros((len(texts), len(self.classes))), np.zeros(len(texts))
        size, doc, first = (np.array(c, np.int64) for c in zip(*places)) if places else (np.zeros(0, np.int64),) * 3
        for n in np.unique(size):
            rows = np.flatnonzero(size == n)
            for part in np.array_split(rows, -(-len(rows) // SIDE)):
                x = flat[first[part][:, None] + np.arange(n + 2 * CONTEXT)]
                own = POOLED[x[:, CONTEXT : CONTEXT + n]]
                y = np.einsum("nbc,bn->bc", self.positions(x), own.astype(np.float32), optimize=False).astype(np.float64)
                np.add.at(out, doc[part], y)
                np.add.at(counted, doc[part], own.sum(1))
        return out / np.maximum(counted, 1)[:, None]


def train(rows: DataFrame, label: str = "lang", per_class: int = PER_CLASS, drawn: int = DRAWN) -> Network | None:
    """rows: what may be learnt from, with doc_id and text."""
    rows = rows.where(F.col(label).isNotNull() & F.col("text").isNotNull() & (F.length("text") <= LEARNT)).select("doc_id", "text", F.col(label).cast("string").alias("_label"))
    got = sample_by_class(rows, "_label", per_class, "doc_id", "text").select("_label", "text").toPandas()
    classes = sorted(got["_label"].unique().tolist())
    r, pad, x, labels = np.random.default_rng(3), b" " * CONTEXT, [], []
    for i, name in enumerate(classes):
        texts = [raw(t) for t in sorted(got["text"][got["_label"] == name]) if has_letter(t)]
        if not texts:
            continue
        sizes = np.array([len(t) for t in texts], float)
        # long texts are drawn from more often, but short ones too
        for k in r.choice(len(texts), drawn, p=np.sqrt(sizes) / np.sqrt(sizes).sum()):
            at = int(r.integers(0, max(1, len(texts[k]) - TRAINED // 2)))
            part = (pad + texts[k])[at : at + TRAINED + 2 * CONTEXT]
            x.append(part.ljust(TRAINED + 2 * CONTEXT))
            labels.append(i)
    return Network(classes).fit(np.frombuffer(b"".join(x), np.uint8).reshape(len(x), -1), np.array(labels)) if x else None


def predict(net: Network, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """The language of each text and its probability."""
    known = [i for i, t in enumerate(texts) if has_letter(t)]
    names, scores = ["und"] * len(texts), [0.0] * len(texts)
    mean = net.pooled([raw(texts[i]) for i in known])
    p = np.exp(mean - mean.max(axis=1, keepdims=True)) if known else mean
    p /= p.sum(axis=1, keepdims=True)
    for i, own in zip(known, p):
        k = int(own.argmax())
        names[i], scores[i] = net.classes[k], float(own[k])
    return names, scores


def identify(docs: DataFrame, net: Network | None) -> DataFrame:
    """docs with all its columns, lang_pred and lang_score."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(net)
    at = docs.columns.index("text")

    def label(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(at).to_pylist()
        names, scores = predict(shared.value, texts) if shared.value else (["und"] * len(texts), [0.0] * len(texts))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, "lang_pred", "lang_score"])

    return arrow_map(docs, label, T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())]))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = fold_of("doc_id", 4) == 2
    net = train(docs.where(~held))
    out = identify(docs.select("doc_id", "text"), net)
    return out.select("doc_id", held.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
