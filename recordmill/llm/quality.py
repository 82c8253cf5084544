"""Quality scores: random-indexing word vectors pooled per text, then a two-layer network.

Every token has a fixed sparse random index vector, made from its hash. A token's context vector is the sum
of the index vectors beside it in the fitted texts; tokens share hashed rows. A text is the mean of its tokens'
index and context vectors, with the shares of a few shapes of words and lines. The network's logit is divided by
a temperature fitted on texts that its weights weren't fitted on.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordmill.llm.language_id import fold
from recordmill.llm.shared import lean, slices, texts

TOKEN = re.compile(r"[^\W_]+|[^\w\s]+|_+")
#: Labelled texts, and their bytes, that the classifier is fitted on at most (about), chosen by a hash of the key.
FIT_TEXTS, FIT_BYTES = 8000, 64 << 20
#: Dimensions of an index vector; places that aren't zero; rows that tokens are hashed to; reach of a context.
DIM, PLACES, ROWS, REACH = 96, 6, 1 << 14, 2
#: Hidden units, steps and size of a batch, rate and weight decay of the fit; share of texts for the temperature.
HIDDEN, STEPS, BATCH, RATE, DECAY, CALIBRATE = 48, 1500, 256, 0.004, 0.0005, 0.2
REMEMBERED = 200_000

_RNG = np.random.default_rng(3)
#: Where the index vector of a row isn't zero, and what it holds there (sums where a place comes twice).
AT, SIGN = _RNG.integers(0, DIM, (PLACES, ROWS)), _RNG.choice([-1.0, 1.0], (PLACES, ROWS))
INDEX = np.zeros((ROWS, DIM), np.float32)
for _at, _sign in zip(AT, SIGN):
    INDEX[np.arange(ROWS), _at] += _sign


class Rows(dict):
    """The hashed row of each token."""

    def __missing__(self, token: str) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        n = self[token] = xxhash.xxh3_64_intdigest(token) % ROWS
        return n


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall(text) if text else []


def shapes(text: str, found: list[str]) -> list[float]:
    """Shares and sizes that don't depend on which words a text has."""
    n = max(1, len(found))
    lines = text.split("\n")
    words = [t for t in found if t[0].isalnum()]
    w = max(1, len(words))
    counts = Counter(words)
    return [
        np.log1p(len(words)),
        np.log1p(len(lines)),
        (len(found) - len(words)) / n,
        sum(len(t) > 1 for t in found if not t[0].isalnum()) / n,
        sum(t.isupper() for t in words) / w,
        sum(t.istitle() for t in words) / w,
        sum(t.isdigit() for t in words) / w,
        len(counts) / w,
        max(counts.values(), default=0) / w,
        len(set(lines)) / len(lines),
        sum(map(len, words)) / w / 10,
        max(map(len, words), default=0) / 50,
        len(words) / max(1, len(lines)) / 20,
        text.count("  ") / n,
        len(text.encode()) / max(1, len(text)) - 1,
    ]


@dataclass
class Model:
    """Context vectors of the rows, scaling of the features, the network's two layers, and the temperature."""

    context: np.ndarray
    middle: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        x = np.clip((x - self.middle) / self.scale, -6, 6)
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def contexts(rows: list[np.ndarray]) -> np.ndarray:
    """Sums of the index vectors beside each row's occurrences, to length 1."""
    out = np.zeros(ROWS * DIM)
    for reach in range(1, REACH + 1):
        left = np.concatenate([r[:-reach] for r in rows]) if rows else np.zeros(0, np.int64)
        right = np.concatenate([r[reach:] for r in rows]) if rows else left
        for here, beside in ((left, right), (right, left)):
            for at, sign in zip(AT, SIGN):
                out += np.bincount(here * DIM + at[beside], sign[beside], ROWS * DIM)
    out = out.reshape(ROWS, DIM).astype(np.float32)
    return out / np.maximum(1e-6, np.linalg.norm(out, axis=1, keepdims=True))


def features(many: list[str], known: Rows, vectors: np.ndarray) -> np.ndarray:
    """A row for each text: mean of [index, context] over tokens, then shapes."""
    split = [tokens(t) for t in many]
    out = np.zeros((len(many), vectors.shape[1] + len(shapes("", []))), np.float32)
    for i, (t, found) in enumerate(zip(many, split)):
        if found:
            n = np.bincount(np.fromiter(map(known.__getitem__, found), np.int64, len(found)), minlength=ROWS)
            at = n.nonzero()[0]
            out[i, : vectors.shape[1]] = n[at] @ vectors[at] / len(found)
        out[i, vectors.shape[1] :] = shapes(t, found)
    return out


def learn(x: np.ndarray, y: np.ndarray, seed: int = 5) -> tuple:
    """Weights of the two layers by Adam on the logistic loss."""
    rng = np.random.default_rng(seed)
    p = [rng.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, (1 / HIDDEN) ** 0.5, HIDDEN), np.zeros(1)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for step in range(1, STEPS + 1):
        at = rng.integers(0, len(x), min(BATCH, len(x)))
        a, t = x[at], y[at]
        h = np.maximum(a @ p[0] + p[1], 0)
        d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3][0], -30, 30))) - t) / len(at)
        dh = np.outer(d, p[2]) * (h > 0)
        grads = [a.T @ dh + DECAY * p[0], dh.sum(axis=0), h.T @ d + DECAY * p[2], np.array([d.sum()])]
        rate = RATE * (1 - step / (STEPS + 1))
        for k, g in enumerate(grads):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return p[0], p[1], p[2], float(p[3][0])


def fit(rows: list[tuple[str, int]]) -> Model | None:
    """A model from (text, label 0 or 1) rows; None without any."""
    if not rows:
        return None
    known = Rows()
    many, y = [t or "" for t, _ in rows], np.array([float(b) for _, b in rows])
    context = contexts([np.fromiter(map(known.__getitem__, tokens(t)), np.int64) for t in many])
    x = features(many, known, np.concatenate([INDEX, context], axis=1))
    middle, scale = x.mean(axis=0), x.std(axis=0) + 1e-4
    model = Model(context, middle, scale, *learn(np.clip((x - middle) / scale, -6, 6), y), 1.0)
    held = np.random.default_rng(9).random(len(y)) < CALIBRATE
    if held.any() and not held.all():
        part = Model(context, middle, scale, *learn(np.clip((x[~held] - middle) / scale, -6, 6), y[~held]), 1.0)
        z, t = part.logits(x[held]), y[held]
        loss = {c: np.mean(np.logaddexp(0, z / c) - t * z / c) for c in np.geomspace(0.5, 20, 60)}
        model.temperature = float(min(loss, key=loss.get))
    return model


def sample(df: DataFrame, labels: DataFrame, label: str, key: str, text: str, most: int) -> list[tuple[str, int]]:
    """At most about so many labelled texts, by a hash of the key, in its order.

    Labels are picked before texts are read, so what is broadcast has a row for each text of the sample.
    """
    h = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("fit")), F.lit(1 << 30))
    labels = labels.where(F.col(label).isNotNull()).select(key, F.col(label).cast("int").alias("y"), h.alias("h"))
    part = min(1.0, most / max(labels.count(), 1))
    found = df.select(key, text).join(F.broadcast(labels.where(F.col("h") < int(part * (1 << 30)))), key)
    size = found.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    found = found.where(F.col("h") < int(part * min(1.0, FIT_BYTES / max(size, 1)) * (1 << 30)))
    return [(r[1], r[2]) for r in sorted(found.select("h", text, "y").collect(), key=lambda r: (r[0], r[1] or "", r[2]))]


def score(df: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score (0 to 1) and predicted (1 from 0.5) for each row; null texts count as empty.

    Without a model every score is 0.5. Other columns are left out.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, known = shared.value, Rows()
        vectors = np.concatenate([INDEX, here.context], axis=1) if here else None
        for batch in slices(batches, text, 2 << 20):
            if here:
                s = here.scores(features([t or "" for t in texts(batch, text)], known, vectors).astype(np.float64))
            else:
                s = np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], [key, "score", "predicted"])

    return df.select(key, text).mapInArrow(lean(run), f"`{key}` {df.schema[key].dataType.simpleString()}, score double, predicted int")


def predict(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", most: int = FIT_TEXTS) -> DataFrame:
    """key, held_out (fold 1 of 3), score and predicted for each row; labels of the other folds' rows are learned.

    A null key is in no fold; repeated labels of a key each count; null labels take no part.
    """
    known = labels.where(F.col(label).isNotNull() & ~(fold(key, 3) == 1)).select(key, label)
    model = fit(sample(df, known, label, key, text, most))
    return score(df, model, key, text).select(key, F.coalesce(fold(key, 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")
