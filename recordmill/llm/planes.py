"""Token ids as files of bit or byte planes, compressed with zstandard, with an index of chunks.

A file is a Parquet table of chunks. A chunk holds a fixed number of ids of consecutive documents (the last of
a shard may be shorter): each byte or bit position of all its ids is one plane, compressed by itself. The
other columns are the index: shard, chunk, first id within the shard, number of ids, and for each piece of
a document its key, its number within the shard and how many ids it has. They are read without the planes.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from recordmill.llm.pretokens import settled
from recordmill.llm.shared import lean, new_path, slices, texts

#: Ids of a chunk.
CHUNK = 1 << 16
#: Characters of a text that parting into shards looks at; Spark samples so many of some rows on the driver.
BEGINNING = 64
#: The pattern that the library's byte-level pre-tokenizer splits by (fixed value); public_tokenizers has to name the same.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_characters() -> dict[str, int]:
    """The byte that each character of a byte-level piece stands for: printable ones themselves, the rest from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def same_by_ranks(pieces: dict[bytes, int], merges: list[tuple[bytes, bytes]]) -> bool:
    """Whether merging any neighbours that make a piece, lowest id first, gives what the listed merges give.

    It does if ids of merged pieces rise with the list and every merged piece, alone, comes out whole of the listed
    merges. For then, by induction on the rank: before a piece's turn its bytes are split in a text as they are
    when alone, into its two listed parts, unless a merge has passed its ends; so no other two neighbours make it.
    """
    ids = [pieces.get(a + b, -1) for a, b in merges]
    if any(x >= y for x, y in zip(ids, ids[1:])) or len(pieces) != 256 + len(merges):
        return False
    rank = {pair: i for i, pair in enumerate(merges)}
    for a, b in merges:
        parts = [bytes([x]) for x in a + b]
        while len(parts) > 1:
            found = min((rank.get(pair, len(rank)), i) for i, pair in enumerate(zip(parts, parts[1:])))
            if found[0] == len(rank):
                return False
            parts[found[1] : found[1] + 2] = [parts[found[1]] + parts[found[1] + 1]]
    return True


class Ids:
    """Ids of texts, equal to the tokenizers library's.

    On loading, the file's merges are proved to be a merge by ranks; texts then go through a faster engine for those. A
    text with an added token's string or a character that engines may class differently goes to the library, as
    do all where the proof fails.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        self.special = [x["content"] for x in whole.get("added_tokens", [])]
        self.fast = None
        plain = whole["pre_tokenizer"] or {}
        if public_tokenizers.PATTERN == BYTE_LEVEL and whole["normalizer"] is None and plain.get("type") == "ByteLevel" and plain.get("use_regex") and not plain.get("add_prefix_space"):
            table = byte_characters()
            raw = lambda piece: bytes(map(table.__getitem__, piece))
            pieces = {raw(p): i for p, i in whole["model"]["vocab"].items() if p not in self.special}
            pairs = [m.split(" ") if isinstance(m, str) else m for m in whole["model"]["merges"]]
            if same_by_ranks(pieces, [(raw(a), raw(b)) for a, b in pairs]):
                self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=pieces, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if self.fast is None or not settled(text) or any(s in text for s in self.special):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")
        return self.fast.encode_to_numpy(text, disallowed_special=())


@lru_cache(2)
def ids_of(path: str) -> Ids:
    return Ids(path)


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """The planes of 32-bit ids, lowest first, up to the highest that isn't all zero; bits in little order."""
    if bits:
        width = int(ids.max(initial=0)).bit_length()
        planes = np.packbits(np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little", count=width).T, axis=1, bitorder="little") if width else []
    else:
        planes = ids.astype("<u4").view(np.uint8).reshape(-1, 4).T[: -(-int(ids.max(initial=0)).bit_length() // 8)]
    pack = zstandard.ZstdCompressor(level=1)
    return [pack.compress(np.ascontiguousarray(p).tobytes()) for p in planes]


def from_planes(planes: list[bytes], n: int, bits: bool) -> np.ndarray:
    unpack = zstandard.ZstdDecompressor()
    raw = [np.frombuffer(unpack.decompress(p), np.uint8) for p in planes]
    if bits:
        spread = np.zeros((n, 32), np.uint8)
        for k, p in enumerate(raw):
            spread[:, k] = np.unpackbits(p, bitorder="little", count=n)
        return np.packbits(spread, axis=1, bitorder="little").view("<u4").reshape(-1)
    spread = np.zeros((n, 4), np.uint8)
    for k, p in enumerate(raw):
        spread[:, k] = p
    return spread.view("<u4").reshape(-1)


def write(df: DataFrame, path: str, tokenizer: str, end: int, bits: bool = True, chunk: int = CHUNK, key: str = "doc_id", text: str = "text") -> None:
    """Encode all texts in ascending order of the key (null keys first, equal keys by text) and write the files.

    A null text counts as empty; every row ends with the end id. Shards are ranges of the key and of how texts begin, so
    rows of one key, or of none, are parted too, unless they begin alike; such rows are streamed through one task.
    """
    spark = df.sparkSession
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, shard, last = ids_of(tokenizer), TaskContext.get().partitionId(), np.array([end], "<u4").tobytes()
        buffer, pieces, k, start, row = bytearray(), [], 0, 0, 0

        def out(n: int) -> pa.RecordBatch:
            ids = np.frombuffer(bytes(buffer[: 4 * n]), "<u4")
            cells = [[shard], [k], [start], [n], [bits], [[p[0] for p in pieces]], [[p[1] for p in pieces]], [[p[2] for p in pieces]], [to_planes(ids, bits)]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.bool_(), pa.list_(key_type), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.binary())]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, kinds)], ["shard", "chunk", "start", "n_ids", "bits", "keys", "rows", "lengths", "planes"])

        for batch in slices(batches, text, 4 << 20):
            key_type = batch.column(key).type
            for name, t in zip(texts(batch, key), texts(batch, text)):
                data = coder.encode(t or "").astype("<u4").tobytes() + last
                at = 0
                while at < len(data):
                    part = data[at : at + 4 * chunk - len(buffer)]
                    buffer += part
                    at += len(part)
                    pieces.append((name, row, len(part) // 4))
                    if len(buffer) == 4 * chunk:
                        yield out(chunk)
                        buffer.clear()
                        pieces, k, start = [], k + 1, start + chunk
                row += 1
        if buffer:
            yield out(len(buffer) // 4)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = f"shard int, chunk int, start long, n_ids int, bits boolean, keys array<{kind}>, rows array<long>, lengths array<int>, planes array<binary>"
    df.select(key, text).repartitionByRange(parts, F.col(key), F.left(F.col(text), F.lit(BEGINNING))).sortWithinPartitions(key, text).mapInArrow(lean(run), schema).write.parquet(path)


def shift(n: int) -> list[int]:
    """What n zero bytes do to each bit of a crc32, as columns of a matrix."""
    def times(m: list[int], v: int) -> int:
        out, i = 0, 0
        while v:
            if v & 1:
                out ^= m[i]
            v, i = v >> 1, i + 1
        return out

    one = [0xEDB88320, *(1 << i for i in range(31))]
    for _ in range(3):
        one = [times(one, x) for x in one]
    total = [1 << i for i in range(32)]
    while n:
        if n & 1:
            total = [times(one, x) for x in total]
        one, n = [times(one, x) for x in one], n >> 1
    return total


def joined_crc(pieces: list[tuple[int, int]]) -> int:
    """The crc32 of consecutive (crc32, bytes) pieces."""
    crc = 0
    for c, n in pieces:
        moved = shift(n) if crc else []
        crc = c ^ int(np.bitwise_xor.reduce([moved[i] for i in range(32) if crc >> i & 1] or [0]))
    return crc


def read(spark, path: str, key: str = "doc_id") -> DataFrame:
    """What the files hold for each document: shard, row (its number there), key, start (ids before it in the shard), n_tokens, ids_crc32."""
    table = spark.read.parquet(path)
    kind = table.schema["keys"].dataType.elementType.simpleString()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x = {c: batch.column(c)[i] for c in batch.schema.names}
                ids = from_planes(x["planes"].as_py(), x["n_ids"].as_py(), x["bits"].as_py())
                lengths = np.array(x["lengths"].as_py(), np.int64)
                stops = np.cumsum(lengths)
                crcs = [zlib.crc32(ids[b - n : b].tobytes()) for n, b in zip(lengths, stops)]
                starts = stops - lengths + x["start"].as_py()
                yield pa.RecordBatch.from_arrays([pa.array([x["shard"].as_py()] * len(crcs), pa.int32()), x["rows"].values, x["keys"].values, pa.array(starts), pa.array(lengths), pa.array(crcs, pa.int64())], ["shard", "row", key, "start", "n", "crc"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc = [p[0]["crc"] if len(p) == 1 else joined_crc([(q["crc"], 4 * q["n"]) for q in p]) for p in texts(batch, "pieces")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("shard", "row", key, "start", "n_tokens")), pa.array(crc, pa.int64())], ["shard", "row", key, "start", "n_tokens", "ids_crc32"])

    found = table.mapInArrow(lean(pieces), f"shard int, row long, `{key}` {kind}, start long, n long, crc long")
    found = found.groupBy("shard", "row").agg(F.first(key).alias(key), F.min("start").alias("start"), F.sum("n").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("start", "n", "crc"))).alias("pieces"))
    return found.mapInArrow(lean(whole), f"shard int, row long, `{key}` {kind}, start long, n_tokens long, ids_crc32 long")


def round_trip(df: DataFrame, tokenizer: str, end: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write all texts and read the files back: key, start (ids of all documents before it), n_tokens, ids_crc32.

    Starts are within shards in the files; the totals of shards before are added from the index, which has a row
    for each shard of the write.
    """
    spark = df.sparkSession
    path = new_path(spark, "planes")
    write(df, path, tokenizer, end, key=key, text=text)
    totals = sorted((r.shard, r.n) for r in spark.read.parquet(path).groupBy("shard").agg(F.sum("n_ids").alias("n")).collect())
    base, before = [], 0
    for shard, n in totals:
        base.append((shard, before))
        before += n
    found = read(spark, path, key)
    offsets = F.broadcast(spark.createDataFrame(base, "shard int, base long"))  # a row for each shard
    return found.join(offsets, "shard").select(key, (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")
