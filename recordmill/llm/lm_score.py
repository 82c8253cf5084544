"""Language-model scores by logistic context mixing over the bits of tokens' codes.

A text is its tokens and one end. The most frequent tokens that occur twice are words with a code of their own in a
Huffman tree, so that a frequent one takes few bits; any other is an escape and then its bytes and a closing mark, coded in a tree of
bytes. Each bit is predicted from hashed contexts of what is before it (see mixing): a word's from one and two tokens before,
whatever these are; a byte's from one, two and four bytes of its token before. Counts come from every
text that is learned from. Weights by set and the refinement are then learned online over all those texts in order,
each bit predicted without its own count; each partition is a shard, and the shards' weights are averaged by their
bits, their outcomes added. Bytes are learned from each distinct token without a code, once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordmill.llm.language_id import fold
from recordmill.llm.mixing import DEPTHS, LEVELS, SETS, Code, Learner, Predictor, Shape, first_weights, mix32, packed, tallied
from recordmill.llm.shared import lean, materialize, slices, texts
from recordmill.llm.words import spaced_column

#: The end of a text as a token; no token of a text can be this byte.
END = b"\xff"
#: Tokens with a code of their own at most: what each worker holds by name. Longer names are held by their digest.
WORDS, NAME = 1 << 17, 64
#: Base-2 logarithms of slots: of the contexts of words, which grow with the corpus between two bounds, and of bytes.
LEAST_SLOTS, MOST_SLOTS, BYTES = 16, 23, (17, 20, 20)
#: The closing mark as a symbol of bytes; what stands before a text or a token.
CLOSE, BEFORE = 256, np.uint32(0x51ED270B)
#: Bytes of texts of a partial count; symbols that tables are made and used from at a time; slots of a block of a table.
COUNTED, SYMBOLS, BLOCK = 16 << 20, 1 << 16, 1 << 17
#: Tokens of a shard at least, where there are so many: each shard's tables are sent once.
SHARD = 8_000_000


def name_of(token: bytes) -> bytes:
    """What a token is called among the words: itself or, if it is long, a mark and its digest."""
    return token if len(token) <= NAME else END + hashlib.md5(token).digest()


def token_counts(df: DataFrame, text: str) -> DataFrame:
    """token, n over all texts, each with its end; summed in the worker before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, COUNTED):
            found = pa.compute.value_counts(spaced_column(batch.column(text))[0])
            found = found.filter(pa.compute.not_equal(pa.compute.binary_length(found.field(0)), 0))
            yield pa.RecordBatch.from_arrays(found.flatten(), ["token", "n"])
            yield pa.RecordBatch.from_arrays([pa.array([END]), pa.array([batch.num_rows])], ["token", "n"])

    return df.select(text).mapInArrow(lean(run), "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """The words by name with their counts, the most frequent first, and the totals of all tokens."""

    names: list[bytes]
    times: np.ndarray
    total: int
    distinct: int

    @property
    def escape(self) -> int:
        return len(self.names)

    def code(self) -> Code:
        return Code(np.append(np.maximum(self.times, 0.5), max(0.5, self.total - self.times.sum())))

    def byte_code(self) -> Code:
        """A tree for bytes and the closing mark by how often they are in words, each word once."""
        joined = np.frombuffer(b"".join(self.names), np.uint8)
        return Code(np.append(np.bincount(joined, minlength=256) + 0.5, len(self.names) + 0.5))


def vocabulary(counts: DataFrame) -> Vocabulary:
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    name = F.when(F.octet_length("token") > NAME, F.concat(F.lit(END), F.unhex(F.md5("token")))).otherwise(F.col("token"))
    top = counts.where("n > 1").orderBy(F.desc("n"), "token").limit(WORDS).select(name.alias("name"), "n").toArrow()
    names, times = [bytes(t) for t in top.column("name").to_pylist()], top.column("n").to_numpy().astype(float)
    if END not in names:
        names, times = [*names, END], np.append(times, 0.0)
    return Vocabulary(names, times, int(total), int(distinct))


def slots(total: int) -> int:
    """The logarithm of slots for a corpus of so many tokens."""
    return min(MOST_SLOTS, max(LEAST_SLOTS, int(total).bit_length() + 1))


def word_contexts(marks: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """For each token of consecutive texts, given as marks, its contexts; first: where texts start."""
    before = []
    for k in (1, 2):
        mark = np.full(len(marks), BEFORE, np.uint32)
        mark[k:] = marks[:-k]
        for j in range(k):
            at = first + j
            mark[at[at < len(marks)]] = BEFORE
        before.append(mark)
    one = mix32(before[0])
    return [one, mix32(one + before[1] * np.uint32(0x9E3779B1) + np.uint32(1))]


def byte_symbols(tokens: list[bytes]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Symbols of the tokens' bytes and closing marks, their contexts, and where tokens start."""
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1
    first = np.cumsum(sizes) - sizes
    symbols = np.frombuffer(b" ".join([*tokens, b""]), np.uint8).astype(np.int64)
    symbols[first + sizes - 1] = CLOSE
    place = np.arange(len(symbols)) - np.repeat(first, sizes)
    value = np.zeros(len(symbols), np.uint32)
    contexts = []
    for k in range(1, 5):
        shifted = np.full(len(symbols), CLOSE, np.uint32)
        shifted[k:] = symbols[:-k]
        value = value * np.uint32(521) + np.where(place >= k, shifted, CLOSE).astype(np.uint32) + np.uint32(1)
        if k in (1, 2, 4):
            contexts.append(mix32(value))
    return symbols, contexts, first


def encode(df: DataFrame, words: Vocabulary, key: str, text: str) -> DataFrame:
    """A row for each text: key, row, n_bytes, n_tokens, n_known and logs of its words, marks (32 bits a token, by byte
    planes: a word's number, or a hash of any other with the highest bit set), and the other tokens in order with how
    often they occur.
    """
    shared = df.sparkSession.sparkContext.broadcast((words.names, words.times))
    kind = pa.list_(pa.struct([("token", pa.binary()), ("n", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, times = shared.value
        known_names, end = pa.array(names, pa.binary()), names.index(END)
        long_names = {n: i for i, n in enumerate(names) if n.startswith(END)}
        logs, heard = np.append(np.log10(times + 1), 0.0), np.append(times > 0, False).astype(np.int64)
        part, row = TaskContext.get().partitionId() << 40, 0
        for batch in slices(batches, text):
            found, starts = spaced_column(batch.column(text))
            found = found.dictionary_encode()
            tokens, which = found.dictionary, found.indices.to_numpy()
            at = pa.compute.index_in(tokens, value_set=known_names)
            mark = np.append(at.fill_null(0).to_numpy(), end).astype(np.uint32)
            others = at.is_null()
            for i, t in zip(others.to_numpy(zero_copy_only=False).nonzero()[0], tokens.filter(others).to_pylist()):
                n = long_names.get(name_of(t)) if len(t) > NAME else None
                mark[i] = xxhash.xxh32_intdigest(t) | 1 << 31 if n is None else n
            which = np.insert(which, starts[1:], len(tokens))  # the ends
            here = np.repeat(np.arange(batch.num_rows), np.diff(starts) + 1)
            real = np.append(pa.compute.binary_length(tokens).to_numpy() > 0, True).take(which)
            which, here = which[real], here[real]
            n_tokens = np.bincount(here, minlength=batch.num_rows)
            first = np.cumsum(n_tokens) - n_tokens
            ids = mark.take(which)
            word = ids < len(names)
            at = np.where(word, ids, len(names))
            known, base = np.add.reduceat(heard.take(at), first), np.add.reduceat(logs.take(at), first)
            marks = [np.ascontiguousarray(m.view(np.uint8).reshape(-1, 4).T).tobytes() for m in np.split(ids, first[1:])]
            cells, times_here = np.unique(here[~word] * len(mark) + which[~word], return_counts=True)
            stops = np.searchsorted(cells, np.arange(batch.num_rows + 1) * len(mark))
            cells = pa.StructArray.from_arrays([tokens.take(pa.array(cells % len(mark))), pa.array(times_here)], ["token", "n"])
            rare = pa.ListArray.from_arrays(pa.array(stops, pa.int32()), cells).cast(kind)
            columns = [batch.column(key), pa.array(part + row + np.arange(len(marks))), pa.array(n_tokens), pa.array(known), pa.array(base), pa.array(marks, pa.binary()), rare]
            row += len(marks)
            rest = [c for c in batch.schema.names if c not in (key, text)]
            yield pa.RecordBatch.from_arrays([*columns, *map(batch.column, rest)], [key, "row", "n_tokens", "n_known", "logs", "marks", "rare", *rest])

    fields = df.select(key, F.octet_length(text).cast("long").alias("n_bytes"), (F.coalesce(fold(key, 7), F.lit(2)) != 2).alias("learn"), text)
    kinds = f"`{key}` {df.schema[key].dataType.simpleString()}, row long, n_tokens long, n_known long, logs double, marks binary, rare array<struct<token: binary, n: long>>, n_bytes long, learn boolean"
    return materialize(fields.mapInArrow(lean(run), kinds), "encoded", "zstd")


def word_parts(batches: Iterator[pa.RecordBatch], escape: int) -> Iterator[tuple[np.ndarray, list[np.ndarray], np.ndarray]]:
    """Symbols, contexts and starts of the texts of the batches' marks, about SYMBOLS at a time."""
    for batch in batches:
        column = texts(batch, "marks")
        done = np.cumsum([len(m) // 4 for m in column])
        lo = 0
        while lo < len(column):
            hi = max(lo + 1, int(np.searchsorted(done, (done[lo - 1] if lo else 0) + SYMBOLS, "right")))
            marks = np.concatenate([np.ascontiguousarray(np.frombuffer(m, np.uint8).reshape(4, -1).T).view(np.uint32)[:, 0] for m in column[lo:hi]])
            ends = done[lo:hi] - (done[lo - 1] if lo else 0)
            first = ends - np.diff(ends, prepend=0)
            yield np.minimum(marks, escape).astype(np.int64), word_contexts(marks, first), first
            lo = hi


def byte_parts(batches: Iterator[pa.RecordBatch], names: list[bytes]) -> Iterator[tuple[np.ndarray, list[np.ndarray], np.ndarray]]:
    """Symbols, contexts and starts of the batches' tokens that aren't words."""
    known = set(names)
    for batch in slices(batches, "token", SYMBOLS):
        tokens = [t for t in texts(batch, "token") if name_of(t) not in known]
        if tokens:
            yield byte_symbols(tokens)


def counts_of(data: bytes, context: int, shape: Shape) -> np.ndarray:
    """A block's counts, which were sent with two bytes each where that is enough."""
    size = 2 * min(BLOCK, 1 << shape.bits[context])
    return np.frombuffer(data, np.uint16 if len(data) == 2 * size else np.uint32).astype(np.float64)


class Fit:
    """A model's shapes and how its tables, weights and outcomes are gathered: both from words and from bytes."""

    def __init__(self, words: Vocabulary):
        self.words = words
        many = slots(words.total)
        self.shapes = {"words": Shape(words.code(), (many, many)), "bytes": Shape(words.byte_code(), BYTES)}

    def sources(self, encoded: DataFrame, counts: DataFrame) -> dict:
        return {
            "words": (encoded.where("learn").select("marks").coalesce(max(1, self.words.total // SHARD)), word_parts, self.words.escape),
            "bytes": (counts.select("token").coalesce(max(1, self.words.distinct // SHARD)), byte_parts, self.words.names),
        }

    def tables(self, rows: DataFrame, parts, known, shape: Shape) -> list[np.ndarray]:
        """Counts by slot over all rows: blocks of each partition's tables, added by block."""
        shared = rows.sparkSession.sparkContext.broadcast((shape, known))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            here, known = shared.value
            tables, pack = [np.zeros(2 << b, np.uint32) for b in here.bits], zstandard.ZstdCompressor(1)
            for symbols, contexts, _ in parts(batches, known):
                tallied(here, tables, symbols, contexts)
            for c, table in enumerate(tables):
                for k in range(0, len(table), 2 * BLOCK):
                    block = table[k : k + 2 * BLOCK]
                    if most := int(block.max()):
                        block = block.astype(np.uint16) if most < 1 << 16 else block
                        yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([k // (2 * BLOCK)], pa.int32()), pa.array([pack.compress(block.tobytes())], pa.binary())], ["context", "block", "data"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, total, pack, unpack = None, None, zstandard.ZstdCompressor(1), zstandard.ZstdDecompressor()
            out = lambda: pa.RecordBatch.from_arrays([*(pa.array([v], pa.int32()) for v in at), pa.array([pack.compress(packed(total).tobytes())], pa.binary())], ["context", "block", "data"])
            for batch in batches:
                for c, k, data in zip(*(batch.column(i) for i in range(3))):
                    here, block = (c.as_py(), k.as_py()), counts_of(unpack.decompress(data.as_py()), c.as_py(), shape)
                    if here == at:
                        total += block
                    else:
                        if at is not None:
                            yield out()
                        at, total = here, block
            if at is not None:
                yield out()

        names = "context int, block int, data binary"
        blocks = rows.mapInArrow(lean(count), names).repartition("context", "block").sortWithinPartitions("context", "block").mapInArrow(lean(add), names)
        tables, unpack = [np.zeros(1 << b, np.uint16) for b in shape.bits], zstandard.ZstdDecompressor()
        for r in materialize(blocks, "blocks").toLocalIterator():
            data = np.frombuffer(unpack.decompress(bytes(r["data"])), np.uint16)
            tables[r["context"]][r["block"] * BLOCK :][: len(data)] = data
        shared.destroy()
        return tables

    def learned(self, rows: DataFrame, parts, known, shape: Shape, tables: list[np.ndarray]) -> Predictor:
        """Weights and outcomes that each partition learns in order, averaged and added."""
        shared = rows.sparkSession.sparkContext.broadcast((shape, known, tables))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            here, known, counts = shared.value
            learner = Learner(here, counts)
            for symbols, contexts, _ in parts(batches, known):
                learner.learn(symbols, contexts)
            if learner.seen:
                values = np.concatenate([learner.seen * learner.weights.reshape(-1), [learner.seen], learner.outcomes])
                at = values.nonzero()[0]
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(values[at])], ["at", "value"])

        found = rows.mapInArrow(lean(run), "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).toArrow()
        plain = first_weights(len(shape.bits))
        size = plain.size
        values = np.zeros(size + 1 + 2 * LEVELS * DEPTHS)
        values[found.column("at").to_numpy()] = found.column("value").to_numpy()
        weights = values[:size].reshape(SETS, -1) / values[size] if values[size] else plain
        shared.destroy()
        return Predictor(shape, tables, weights, values[size + 1 :])

    def model(self, encoded: DataFrame, counts: DataFrame) -> Model:
        made = {}
        for name, (rows, parts, known) in self.sources(encoded, counts).items():
            shape = self.shapes[name]
            made[name] = self.learned(rows, parts, known, shape, self.tables(rows, parts, known, shape))
        return Model(made["words"], made["bytes"], self.words.escape)


@dataclass
class Model:
    """What scoring needs: the predictors of words and of bytes."""

    words: Predictor
    bytes: Predictor
    escape: int

    def text_scores(self, batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        """log10 of the texts' probabilities, but the spelling of tokens that aren't words, for runs of texts."""
        for symbols, contexts, first in word_parts(batches, self.escape):
            yield np.add.reduceat(self.words.scores(symbols, contexts), first)

    def spelled(self, tokens: list[bytes]) -> np.ndarray:
        """log10 of the tokens' probabilities as spelled after an escape."""
        out, lo = np.zeros(len(tokens)), 0
        done = np.cumsum([len(t) + 1 for t in tokens])
        while lo < len(tokens):
            hi = max(lo + 1, int(np.searchsorted(done, (done[lo - 1] if lo else 0) + SYMBOLS, "right")))
            symbols, contexts, first = byte_symbols(tokens[lo:hi])
            out[lo:hi] = np.add.reduceat(self.bytes.scores(symbols, contexts), first)
            lo = hi
        return out

    def spelled_column(self, tokens: pa.Array) -> np.ndarray:
        """The same of a column, each distinct token spelled once."""
        found = tokens.dictionary_encode()
        return self.spelled(found.dictionary.to_pylist()).take(found.indices.to_numpy())


def score(encoded: DataFrame, counts: DataFrame, words: Vocabulary, model: Model, key: str) -> DataFrame:
    """key, learn, n_tokens, n_known, train_tokens, base_score, score, n_bytes and bits_per_byte for each row."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = np.concatenate(list(shared.value.text_scores(iter([batch]))))
                yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(found)], ["row", "words"])

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "token", 1 << 20):
            each = shared.value.spelled_column(batch.column("token"))  # the join leaves equal tokens next to each other
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(each)], [*batch.schema.names, "spelled"])

    worded = encoded.select("row", "marks").mapInArrow(lean(run), "row long, words double")
    rare = encoded.select("row", F.inline("rare"))
    rare = rare.join(counts.select("token", F.col("n").alias("times")), "token", "left").select("row", "token", "n", F.coalesce("times", F.lit(0)).alias("times"))
    rare = rare.mapInArrow(lean(spell), "row long, token binary, n long, times long, spelled double")
    known = F.col("times") > 0
    sums = {"known": F.when(known, F.col("n")).otherwise(0), "more": F.col("n") * F.log10(F.col("times") + 1), "spelled": F.col("n") * F.col("spelled")}
    rare = rare.groupBy("row").agg(*(F.sum(v).alias(k) for k, v in sums.items()))
    found = encoded.drop("marks", "rare").join(worded, "row").join(rare, "row", "left")
    each = float(np.log10(words.total + words.distinct + 1))
    total = F.col("words") + F.coalesce("spelled", F.lit(0.0))
    return found.select(
        key,
        "learn",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(words.total).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * each).alias("base_score"),
        total.alias("score"),
        F.coalesce("n_bytes", F.lit(0)).alias("n_bytes"),
        F.when(F.col("n_bytes") > 0, -total * float(np.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"),
    )


def predict(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Scores of all rows by a model of those outside fold 2 of 7: key, held_out, n_tokens, n_known, train_tokens,
    base_score, score, n_bytes (of the text) and bits_per_byte (null without bytes).

    A null text counts as empty: one token, the end. A row with a null key is in no fold, so it is not learned from.
    Without rows to learn from, counts are zero. Columns of the input are left out; repeated rows are each returned.
    """
    counts = materialize(token_counts(df.where(~(fold(key, 7) == 2)), text), "counts")
    words = vocabulary(counts)
    encoded = encode(df, words, key, text)
    found = score(encoded, counts, words, Fit(words).model(encoded, counts), key)
    return found.select(key, F.coalesce(fold(key, 7) == 2, F.lit(False)).alias("held_out"), *(c for c in found.columns if c not in (key, "learn")))
