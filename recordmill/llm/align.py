"""Cross-tokenizer alignment: tokens of two tokenizers over the same bytes, the groups that both cut, and their links.

Both token sequences of a text are laid over its bytes by running lengths. Ends that both share are cuts, and the
number of cuts before a token is its group. Each stretch between neighbouring ends, of whichever side, is the overlap
of one token of each side: a link. So links are as many as distinct ends, however long a group is, and no pairs are
tried. Neither tokenizer's tokens pass a space when texts are cut before each space (which is proved on loading),
so a stretch from space to space is aligned once for a task and remembered; other texts are aligned whole. What links
are worth comes from a join: pairs are counted over the corpus, the best count of each second id found, and both
brought back to the documents, by shuffle with hot pairs apart where the counted pairs are too many to broadcast.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recordmill.llm.planes import Ids, byte_characters
from recordmill.llm.pretokens import Remembered, apart, settled
from recordmill.llm.shared import lean, materialize, slices, texts, with_hot
from recordmill.llm.token_counts import SPACE, Counter

#: Stretches that a task remembers and aligns together, text bytes of a slice, and counted pairs that are broadcast at most.
REMEMBERED, TOGETHER, SLICE, PAIRS = 160_000, 10_000, 2 << 20, 500_000
#: A pair of ids as one number.
WIDTH = 1 << 32


class Aligner:
    """Aligns a byte-level BPE file (A) of the tokenizers library with a sentencepiece model (B)."""

    def __init__(self, a_path: str, b_path: str):
        self.a = Ids(a_path)
        self.a.library.encode_special_tokens = True  # their strings in a text are ordinary text
        with open(a_path, encoding="utf-8") as f:
            whole = json.load(f)
        table = byte_characters()
        plain = {i: p for p, i in whole["model"]["vocab"].items()}
        self.a_bytes = [bytes(table[c] for c in plain.get(i, "") if c in table) for i in range(max(plain) + 1)]
        self.b = model = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.splits = self.a.fast is not None and Counter(b_path).splits
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        self.seen = Remembered(REMEMBERED)

    def ids_a(self, text: str) -> list[int]:
        if self.a.fast is None or not settled(text):
            return self.a.library.encode(text, add_special_tokens=False).ids
        return self.a.fast.encode_ordinary(text)

    def aligned(self, many: list[str]) -> list[tuple | None]:
        """For each text, which starts with a space: its groups as bytes, the numbers of tokens of A and B and of groups,
        and its links as the bytes of numbers, in order; None if the tokens' bytes aren't the text's."""
        if len(many) > TOGETHER:
            return [x for i in range(0, len(many), TOGETHER) for x in self.aligned(many[i : i + TOGETHER])]
        a = [self.ids_a(t) for t in many]
        b = self.b.encode([t[1:] for t in many], num_threads=1)
        as_a, as_b = self.a_bytes.__getitem__, self.b_bytes.__getitem__
        raw = [t.encode() for t in many]
        good = [i for i, t in enumerate(raw) if b"".join(map(as_b, b[i])) == t == b"".join(map(as_a, a[i]))]
        out: list = [None] * len(many)
        if not good:
            return out
        flat_a, flat_b = (np.fromiter(chain.from_iterable(side[i] for i in good), np.int64) for side in (a, b))
        ends_a, ends_b = self.a_sizes[flat_a].cumsum(), self.b_sizes[flat_b].cumsum()
        ends = np.union1d(ends_a, ends_b)
        links = flat_a[np.searchsorted(ends_a, ends)] * WIDTH + flat_b[np.searchsorted(ends_b, ends)]
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
        stops = np.cumsum([len(raw[i]) for i in good])
        at_links, at_cuts = (np.searchsorted(x, stops, "right") for x in (ends, cuts))
        group_a, group_b = np.searchsorted(ends_a, cuts, "right").tolist(), np.searchsorted(ends_b, cuts, "right").tolist()
        text_a, text_b = list(map(str, flat_a.tolist())), list(map(str, flat_b.tolist()))
        said, p, q = [], 0, 0
        for x, y in zip(group_a, group_b):
            said.append((text_a[p] if x == p + 1 else ",".join(text_a[p:x])) + "|" + (text_b[q] if y == q + 1 else ",".join(text_b[q:y])))
            p, q = x, y
        g = k = 0
        for i, to_link, to_cut in zip(good, at_links.tolist(), at_cuts.tolist()):
            out[i] = (";".join(said[g:to_cut]).encode(), len(a[i]), len(b[i]), to_cut - g, links[k:to_link].tobytes())
            g, k = to_cut, to_link
        return out

    def stretches(self, text: str) -> list[str]:
        """A text with a space before it, cut before each space if that is safe; B may join spaces that follow each other."""
        whole = " " + text
        safe = self.splits and "  " not in whole and not whole.endswith(" ") and settled(whole) and apart(whole)
        return [" " + x for x in text.split(" ")] if safe else [whole]

    def align(self, many: list[str]) -> list[tuple | None]:
        """What aligned() says of each text and a space before it; the links are distinct, each with its number."""
        split = [self.stretches(t) if t else [] for t in many]
        distinct = set().union(*split)
        rest = self.seen.missing(distinct)
        self.seen.new.update(zip(rest, self.aligned(rest)))
        known = self.seen.new.__getitem__
        out: list = []
        for parts in split:
            found = list(map(known, parts))
            if not found or None in found:
                out.append(None)
                continue
            said, n_a, n_b, groups, links = zip(*found)
            pairs, n = np.unique(np.frombuffer(b"".join(links), np.int64), return_counts=True)
            out.append((b";".join(said), sum(n_a), sum(n_b), sum(groups), pairs, n))
        self.seen.forget_long(rest)
        return out


@lru_cache(2)
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def alignments(df: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row: row (a number of its own), key, n_a, n_b, n_groups, n_links, groups (`a1,a2|b1;a3|b2,b3`), pairs
    (distinct links as a * 2^32 + b) and times (how often each is linked).

    Texts that are null, empty or not given back by either tokenizer's bytes have zeros, an empty string and no pairs.
    Null keys stay, repeated rows are each aligned; other columns are left out, so their names can't clash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, row = aligner(a_path, b_path), TaskContext.get().partitionId() << 40
        for batch in slices(batches, text, SLICE):
            found = [x or (b"", 0, 0, 0, (), ()) for x in tool.align([t or "" for t in texts(batch, text)])]
            said, n_a, n_b, groups, pairs, times = zip(*found) if found else [()] * 6
            numbers = [pa.array(x, pa.int64()) for x in (n_a, n_b, groups, [int(sum(t)) for t in times])]
            lists = pa.array(pairs, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(range(row, row + len(found)), pa.int64()), batch.column(key), *numbers, pa.array([x.decode() for x in said], pa.string()), *lists], ["row", key, "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"])
            row += len(found)

    return df.select(key, text).mapInArrow(lean(run), f"row long, `{key}` {df.schema[key].dataType.simpleString()}, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<long>")


def link_counts(found: DataFrame) -> DataFrame:
    """For each pair of ids: count (how many links of the corpus are this pair), rows (in how many texts it stands) and
    whether no other first id is linked with its second id more often."""
    each = found.select(F.explode(F.arrays_zip("pairs", "times")).alias("x"))
    counts = each.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("count"), F.count("*").alias("rows"))
    second = W.partitionBy((F.col("pair") % WIDTH))  # as many rows as the first vocabulary has ids, at most
    return counts.withColumn("best", F.col("count") == F.max("count").over(second))


def report(df: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row: key, n_a, n_b, n_groups, n_links, n_best, count_sum and the sha256 of its groups ('' without tokens)."""
    found = alignments(df, a_path, b_path, key, text)
    digest = F.when(F.col("n_links") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    found = materialize(found.select("row", key, "n_a", "n_b", "n_groups", "n_links", digest, "pairs", "times"), "aligned", "zstd")
    counts = materialize(link_counts(found), "counts")
    each = found.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("n"))
    pairs, total = counts.agg(F.count("*"), F.coalesce(F.sum("rows"), F.lit(0))).first()
    worth = each.join(F.broadcast(counts.drop("rows")), "pair") if pairs <= PAIRS else with_hot(each, counts, "pair", total)
    worth = worth.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum"))
    zero = F.lit(0).cast("long")
    out = found.drop("pairs", "times").join(worth, "row", "left")
    return out.select(key, "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
