"""Token counts: strings proved to be one token are looked up, the rest is merged by the library."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from recordmill.llm.pretokens import Remembered
from recordmill.llm.shared import lean, slices, texts

#: What the model writes for a space.
SPACE = "▁"
#: A pre-token: a run of spaces with what follows up to the next space.
UNIT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
REMEMBERED = 400_000


def message_fields(data: bytes) -> list[tuple[int, int | bytes]]:
    """The fields of a message as protocol buffers write it: number and value, in order."""
    out, at = [], 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            out.append((tag >> 3, varint()))
            continue
        size = varint() if tag & 7 == 2 else {1: 8, 5: 4}[tag & 7]
        out.append((tag >> 3, data[at : at + size]))
        at += size
    return out


def leaves_texts(model) -> bool:
    """Whether the model's own settings say that a text is only given a space in front: no table of characters to
    replace, no white space taken away, spaces written as marks."""
    spec = next((v for k, v in message_fields(model.serialized_model_proto()) if k == 3), b"")
    # the settings' numbers in the format, with what they are when left out (fixed values)
    found = {2: b"", 3: 1, 4: 1, 5: 1} | dict(message_fields(spec))
    return (found[2], found[3], found[4], found[5]) == (b"", 1, 0, 1)


class Counter:
    """Counts the pieces of a sentencepiece BPE model that leaves texts as they are and puts a space before them.

    No piece of such a vocabulary may hold a space after another character; then no merge passes from one
    unit to the next, and a text's count is the sum of its units' counts. Both are proved on loading.
    """

    def __init__(self, path: str):
        self.model = model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        self.splits = leaves_texts(model) and not any(SPACE in p.lstrip(SPACE) for p in pieces) and model.encode(" a  b ", out_type=str) == self.as_units(model, " a  b ")
        units = [p for p in pieces if p[0] == SPACE and p != SPACE and UNIT.fullmatch(p)]
        #: Units that the library, asked once for each, encodes as one token.
        self.whole = {p for p, ids in zip(units, model.encode([p[1:] for p in units], num_threads=1)) if len(ids) == 1} | {SPACE}
        self.seen = Remembered(REMEMBERED)

    @staticmethod
    def as_units(model, text: str) -> list[str]:
        return [x for u in UNIT.findall(SPACE + text.replace(" ", SPACE)) for x in (model.encode(u[1:], out_type=str) if u != SPACE else [SPACE])]

    def counts(self, many: list[str]) -> list[int]:
        if not self.splits:
            return [len(x) for x in self.model.encode(many, num_threads=1)]
        split = [UNIT.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in many]
        distinct = {u for units in split for u in units}
        rest = self.seen.missing(distinct)
        known = self.seen.new
        known.update(dict.fromkeys((u for u in rest if u in self.whole), 1))
        rest = [u for u in rest if u not in self.whole]
        known.update(zip(rest, map(len, self.model.encode([u[1:] for u in rest], num_threads=1))))
        out = [sum(map(known.__getitem__, units)) for units in split]
        self.seen.forget_long(rest)
        return out


@lru_cache(2)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(df: DataFrame, path: str, limit: int = 4096, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row: key, n_bytes, n_tokens, over_limit (more than limit tokens).

    Null texts count as empty: 0 bytes and 0 tokens. Null keys stay, repeated rows are each counted, and other
    columns are left out, so their names can't clash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(path)
        for batch in slices(batches, text):
            many = [t or "" for t in texts(batch, text)]
            n = tokens.counts(many)
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), pa.array([len(t.encode()) for t in many], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n])], [key, "n_bytes", "n_tokens", "over_limit"]
            )

    return df.select(key, text).mapInArrow(lean(run), f"`{key}` {df.schema[key].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
