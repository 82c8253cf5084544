"""Language identification: scripts narrow the candidates, then Viterbi over words labels spans.

A word's score in a language is the sum of log probabilities of its hashed character n-grams, as counted in
labelled texts. A path may change language between words for a fixed penalty; the best path gives spans, and a
text's language is the one with most letters. All of a batch's words run through the path search together:
texts are cut into chunks whose best paths from every state are found side by side and then joined in order.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordmill.llm.shared import lean, slices, texts
from recordmill.llm.words import mix

WORD = re.compile(r"[^\W\d_]+")
#: Labelled texts of a language that the model is fitted on at most, chosen by a hash of the key.
FIT_TEXTS = 4000
#: Buckets of n-grams of 1 to ORDER characters.
BUCKETS, ORDER = 1 << 16, 4
#: Nats that a change of language costs.
SWITCH = 8.0
#: A language is a candidate for a script if at least this share of the language's own words is in it.
SHARE = 0.005
#: Words of a chunk; states of all chunks searched at a time; words remembered by a worker.
CHUNK, STATES, REMEMBERED = 64, 2_000_000, 150_000
#: First code points of the ranges that count as one script each (fixed values: starts of Unicode blocks).
SCRIPTS = np.array([0x0, 0x370, 0x400, 0x530, 0x590, 0x600, 0x700, 0x900, 0x980, 0xA00, 0xA80, 0xB00, 0xB80, 0xC00, 0xC80, 0xD00, 0xD80, 0xE00, 0xE80, 0xF00, 0x1000, 0x10A0, 0x1100, 0x1200, 0x13A0, 0x1780, 0x1800, 0x1E00, 0x1F00, 0x2000, 0x2C00, 0x3040, 0x3100, 0x3400, 0xA000, 0xAC00, 0xD800, 0xF900, 0xFB00, 0xFB50, 0xFE70, 0xFF00, 0x10000, 0x20000])
#: Ranges that belong to the script of an earlier one: Latin Extended Additional to Latin, and so on (fixed values).
SAME = {0x1E00: 0x0, 0x1F00: 0x370, 0xFB50: 0x600, 0xFE70: 0x600, 0xF900: 0x3400, 0x20000: 0x3400}


def scripts(words: list[str]) -> np.ndarray:
    """The script range of each word's first letter."""
    found = np.searchsorted(SCRIPTS, np.fromiter((ord(w[0]) for w in words), np.int64, len(words)), side="right") - 1
    for a, b in SAME.items():
        found[SCRIPTS[found] == a] = np.searchsorted(SCRIPTS, b)
    return found


def letters(text: str | None) -> list[str]:
    """Lower-cased runs of letters; other characters that a run of word characters holds, such as \u00b2, cut it."""
    found = WORD.findall(text.lower()) if text else []
    if all(map(str.isalpha, found)):
        return found
    return [x for w in found for x in ([w] if w.isalpha() else "".join(c if c.isalpha() else " " for c in w).split())]


def ngrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the words with marks at both ends, and for each the word's number."""
    points = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    owner = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(points))
    buckets, owners, h = [], [], np.zeros(len(points), np.uint64)
    for n in range(1, ORDER + 1):
        if len(points) < n:
            break
        h = h[: len(points) - n + 1] * np.uint64(0x100000001B3) + points[n - 1 :] + np.uint64(n)
        keep = left[: len(h)] >= n
        buckets.append((mix(h[keep]) >> np.uint64(20)).astype(np.int64) & (BUCKETS - 1))
        owners.append(owner[: len(h)][keep])
    return np.concatenate(buckets), np.concatenate(owners)


@dataclass
class Model:
    """Languages; log probability of each n-gram bucket by language; which languages each script allows."""

    langs: list[str]
    logp: np.ndarray
    allowed: np.ndarray

    def scores(self, words: list[str]) -> np.ndarray:
        """A row of scores by language for each word."""
        out = np.zeros((len(words), len(self.langs)), np.float32)
        if words:
            buckets, owners = ngrams(words)
            for k in range(len(self.langs)):
                out[:, k] = np.bincount(owners, self.logp[k, buckets], len(words))
            allowed = self.allowed[scripts(words)]
            out = np.where(allowed, out, out.max(axis=1, keepdims=True) - 100 * SWITCH)
        return out


def best_paths(scores: np.ndarray, sizes: list[int], switch: float = SWITCH) -> np.ndarray:
    """The best path's state for each of the words of consecutive texts of these sizes."""
    states = scores.shape[1]
    starts, owner, length = [], [], []
    at = 0
    for d, n in enumerate(sizes):
        for i in range(0, n, CHUNK):
            starts.append(at + i)
            owner.append(d)
            length.append(min(CHUNK, n - i))
        at += n
    labels = np.zeros(len(scores), np.int16)
    if not starts:
        return labels
    starts, length = np.array(starts), np.array(length)
    count = len(starts)
    ends = np.empty((count, states, states), np.float32)
    step = max(1, STATES // (states * states))
    trails = []
    for lo in range(0, count, step):
        s, n = starts[lo : lo + step], length[lo : lo + step]
        v = np.where(np.eye(states, dtype=bool), 0, -switch).astype(np.float32)[None].repeat(len(s), 0)
        stay, best = np.ones((CHUNK, len(s), states, states), bool), np.zeros((CHUNK, len(s), states), np.int16)
        for t in range(int(n.max())):
            live = n > t
            e = scores[np.where(live, s + t, s)]
            if t:
                arg = v.argmax(axis=2)
                top = np.take_along_axis(v, arg[:, :, None], 2) - np.float32(switch)
                moved = np.maximum(v, top)
                stay[t] = (v >= top) | ~live[:, None, None]
                best[t] = arg
            else:
                moved = v
            v = np.where(live[:, None, None], moved + e[:, None, :], v)
        ends[lo : lo + step] = v
        trails.append((stay, best))
    before = np.zeros(count, np.int64)
    after = np.zeros(count, np.int64)
    i = 0
    while i < count:
        j = i
        v, back = np.zeros(states, np.float32), []
        while j < count and owner[j] == owner[i]:
            total = v[:, None] + ends[j]
            back.append(total.argmax(axis=0))
            v = total.max(axis=0)
            j += 1
        state = int(v.argmax())
        for k in range(j - 1, i - 1, -1):
            after[k] = state
            before[k] = state = int(back[k - i][state])
        i = j
    for g, (stay, best) in enumerate(trails):
        lo = g * step
        s, n, here, start = starts[lo : lo + step], length[lo : lo + step], after[lo : lo + step].copy(), before[lo : lo + step]
        at = np.arange(len(s))
        for t in range(int(n.max()) - 1, -1, -1):
            live = n > t
            labels[(s + t)[live]] = here[live]
            if t:
                here = np.where(stay[t][at, start, here], here, best[t][at, start])
    return labels


class Scores(dict):
    """Rows of word scores; those asked for and not known are listed for scoring."""

    def __init__(self, model: Model):
        self.model, self.rows, self.asked = model, np.zeros((0, len(model.langs)), np.float32), []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.asked.append(word)
        return n

    def of(self, words: list[str]) -> np.ndarray:
        if len(self) > REMEMBERED:
            self.clear()
            self.rows = self.rows[:0]
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.asked:
            self.rows = np.concatenate([self.rows, *(self.model.scores(self.asked[i : i + 20_000]) for i in range(0, len(self.asked), 20_000))])
            self.asked = []
        return self.rows[at]


def fit(df: DataFrame, lang: str = "lang", key: str = "doc_id", text: str = "text", most: int = FIT_TEXTS) -> Model | None:
    """A model from the rows' texts and languages, at most so many texts of a language; None without any.

    What is collected grows with the number of languages: a count and a row of n-grams for each.
    """
    df = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = {r[0]: r[1] for r in df.groupBy(lang).count().collect()}
    langs = sorted(counts)
    if not langs:
        return None
    share = F.create_map(*(F.lit(x) for k in langs for x in (k, min(1.0, most / counts[k]))))
    sample = df.where(F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("fit")), F.lit(1 << 30)) < F.element_at(share, F.col(lang)) * (1 << 30))
    number = {k: i for i, k in enumerate(langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, by_script = np.zeros((len(langs), BUCKETS), np.int64), np.zeros((len(langs), len(SCRIPTS)), np.int64)
        for batch in slices(batches, text, 2 << 20):
            seen: dict[str, Counter] = {}
            for name, t in zip(texts(batch, lang), texts(batch, text)):
                seen.setdefault(name, Counter()).update(letters(t))
            for name, total in seen.items():
                words, n = list(total), np.fromiter(total.values(), np.int64)
                if words:
                    buckets, owners = ngrams(words)
                    grams[number[name]] += np.bincount(buckets, n[owners], BUCKETS).astype(np.int64)
                    by_script[number[name]] += np.bincount(scripts(words), n, len(SCRIPTS)).astype(np.int64)
        both = np.concatenate([grams, by_script], axis=1)
        k, b = both.nonzero()
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(b, pa.int32()), pa.array(both[k, b])], ["lang", "bucket", "n"])

    found = sample.select(lang, text).mapInArrow(lean(run), "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = np.zeros((len(langs), BUCKETS + len(SCRIPTS)))
    for batch in found.toArrow().to_batches():
        table[batch.column("lang").to_numpy(), batch.column("bucket").to_numpy()] = batch.column("n").to_numpy()
    grams, by_script = table[:, :BUCKETS], table[:, BUCKETS:]
    used = max(1, (grams.sum(axis=0) > 0).sum())
    logp = np.log((grams + 0.5) / (grams.sum(axis=1, keepdims=True) + 0.5 * used)).astype(np.float32)
    allowed = ((by_script > 0) & (by_script >= SHARE * by_script.sum(axis=1, keepdims=True))).T
    allowed[~allowed.any(axis=1)] = True
    return Model(langs, logp, allowed)


def label(df: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """Add lang_pred, score (the language's share of the letters) and spans (lang, first word, words).

    A null text or one without letters, and any text without a model, is `und` with score 0 and no spans; equal
    shares go to the language that comes first. Input columns with these names are replaced.
    """
    df = df.drop("lang_pred", "score", "spans")
    span = T.StructType([T.StructField("lang", T.StringType()), T.StructField("start", T.LongType()), T.StructField("words", T.LongType())])
    schema = T.StructType([*df.schema, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(span))])
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int64()), ("words", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = shared.value
        known = Scores(here) if here else None
        for batch in slices(batches, text, 2 << 20):
            names, shares, spans = [], [], []
            split = [letters(t) for t in texts(batch, text)] if here else [[]] * batch.num_rows
            words = [w for ws in split for w in ws]
            labels = best_paths(known.of(words), [len(ws) for ws in split]) if words else np.zeros(0, np.int16)
            size = np.fromiter(map(len, words), np.int64, len(words))
            at = 0
            for ws in split:
                mine, chars = labels[at : at + len(ws)], size[at : at + len(ws)]
                at += len(ws)
                if not ws:
                    names.append("und")
                    shares.append(0.0)
                    spans.append([])
                    continue
                by_lang = np.bincount(mine, chars, len(here.langs))
                top = int(by_lang.argmax())
                names.append(here.langs[top])
                shares.append(float(by_lang[top] / chars.sum()))
                cuts = [0, *(np.flatnonzero(mine[1:] != mine[:-1]) + 1).tolist(), len(ws)]
                spans.append([{"lang": here.langs[mine[a]], "start": a, "words": b - a} for a, b in zip(cuts, cuts[1:])])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names), pa.array(shares, pa.float64()), pa.array(spans, kind)], [*batch.schema.names, "lang_pred", "score", "spans"])

    return df.mapInArrow(lean(run), schema)


def fold(key: str, mod: int):
    return F.pmod(F.crc32(F.col(key).cast("string")), F.lit(mod))


def predict(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """key, held_out (fold 2 of 4), lang_pred and score for each row; learned from the other folds' rows.

    A row with a null key is in no fold: it is not learned from and not held out.
    """
    held = fold(key, 4) == 2
    model = fit(df.where(~held).select(key, text, lang), lang, key, text)
    found = label(df.select(key, text), model, text)
    return found.select(key, F.coalesce(fold(key, 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
