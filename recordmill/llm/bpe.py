"""Byte-level BPE: whole pre-tokens by a minimal perfect hash, the rest by merges over linked bytes.

A long miss has a heap of its own. Short misses of a batch are merged side by side: each step takes the lowest
pair of every one of them from its row, which is what its heap would give, and relinks its bytes.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from recordmill.llm.pretokens import Encoder
from recordmill.llm.shared import lean, slices, texts

#: Chunks and pre-tokens whose ids a Python worker remembers.
CHUNKS, PIECES = 250_000, 250_000
#: Bytes of a short miss, misses merged side by side, and the rank of a pair that isn't a token.
SHORT, TOGETHER, NONE = 32, 20_000, 1 << 30
#: Bytes of text that encode() cuts into words at once; these take some ten times as much.
ENCODED_BYTES = 1 << 20
#: Keys to a bucket of the perfect hash.
BUCKET = 2


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def mixed(h: int, d: int) -> int:
    """Other 64 bits for each displacement d."""
    x = ((h ^ d * 0x9E3779B97F4A7C15) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
    return x ^ x >> 31


class PerfectHash:
    """A minimal perfect hash of byte strings by displacement: n keys in n slots, with the key kept for proof.

    Buckets are placed from the largest down, each by the first displacement that leads its keys to free slots;
    a bucket of one key takes any free slot, written as a negative displacement.
    """

    def __init__(self, keys: dict[bytes, int]):
        self.n = n = len(keys)
        self.buckets = nb = max(1, n // BUCKET)
        self.displace = [0] * nb
        self.keys: list = [None] * n
        self.values = [0] * n
        members: list[list] = [[] for _ in range(nb)]
        for k, v in keys.items():
            h = xxhash.xxh3_64_intdigest(k)
            members[h % nb].append((h, k, v))
        order = sorted(range(nb), key=lambda b: -len(members[b]))
        for b in (b for b in order if len(members[b]) > 1):
            d = 0
            while len(slots := {mixed(h, d) % n for h, _, _ in members[b]}) < len(members[b]) or any(self.keys[s] is not None for s in slots):
                d += 1
            self.displace[b] = d
            for h, k, v in members[b]:
                self.put(mixed(h, d) % n, k, v)
        free = (s for s in range(n) if self.keys[s] is None)
        for b in (b for b in order if len(members[b]) == 1):
            (_, k, v), s = members[b][0], next(free)
            self.displace[b] = -s - 1
            self.put(s, k, v)

    def put(self, slot: int, key: bytes, value: int) -> None:
        self.keys[slot], self.values[slot] = key, value

    def get(self, key: bytes) -> int | None:
        h = xxhash.xxh3_64_intdigest(key)
        d = self.displace[h % self.buckets]
        s = mixed(h, d) % self.n if d >= 0 else -d - 1
        return self.values[s] if self.keys[s] == key else None


class ByteBPE(Encoder):
    """Encodes and decodes by a table of ranks; equal to the tiktoken library without special tokens."""

    def __init__(self, path: str):
        self.ranks = load_ranks(path)
        self.whole = PerfectHash(self.ranks)
        self.bytes_of = [k for k, _ in sorted(self.ranks.items(), key=lambda x: x[1])] if sorted(self.ranks.values()) == list(range(len(self.ranks))) else {v: k for k, v in self.ranks.items()}
        self.library = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        super().__init__(CHUNKS, PIECES)
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)])
        pairs = sorted((self.ranks[k[:i]] << 32 | self.ranks[k[i:]], v) for k, v in self.ranks.items() for i in range(1, len(k)) if k[:i] in self.ranks and k[i:] in self.ranks)
        self.pair_keys, self.pair_values = np.array([k for k, _ in pairs]), np.array([v for _, v in pairs], np.int32)

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        """The ids of one pre-token."""
        found = self.whole.get(piece)
        return (found,) if found is not None else self.merge(piece)

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Merge neighbours by lowest rank, leftmost first.

        after[i] and before[i] link the live parts by where they start; pair[i] is the rank of the part at i with
        the next, -1 for none. A heap entry holds rank and place and is stale if the pair's rank is another by now.
        """
        rank, n = self.ranks.get, len(piece)
        after, before = list(range(1, n + 1)), list(range(-1, n))
        pair = [rank(piece[i : i + 2], -1) for i in range(n)]
        pair[-1] = -1
        heap = [r << 32 | i for i, r in enumerate(pair) if r >= 0]
        heapify(heap)
        while heap:
            x = heappop(heap)
            i = x & 0xFFFFFFFF
            if pair[i] != x >> 32:
                continue
            j = after[i]
            pair[j], after[i] = -1, (k := after[j])
            before[k] = i
            pair[i] = r = rank(piece[i : after[k]], -1) if k < n else -1
            if r >= 0:
                heappush(heap, r << 32 | i)
            if (h := before[i]) >= 0:
                pair[h] = r = rank(piece[h:k], -1)
                if r >= 0:
                    heappush(heap, r << 32 | h)
        out, i, ranks = [], 0, self.ranks
        while i < n:
            out.append(ranks[piece[i : after[i]]])
            i = after[i]
        return tuple(out)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each two tokens together, NONE if they aren't one."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_values[at], NONE)

    def merge_many(self, pieces: list[bytes]) -> list[bytes]:
        """merge() of pieces of 2 to SHORT bytes, as little-endian 32-bit ids."""
        m = len(pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, m)
        width = int(sizes.max())
        inside = np.arange(width) < sizes[:, None]
        ids = np.zeros((m, width + 1), np.int64)
        ids[:, :width][inside] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        pair = np.full((m, width + 1), NONE, np.int32)
        r, c = np.nonzero(inside[:, 1:])
        pair[r, c] = self.pair_ranks(ids[r, c], ids[r, c + 1])
        after = np.tile(np.arange(1, width + 2, dtype=np.int16), (m, 1))
        before = np.tile(np.arange(-1, width + 1, dtype=np.int16), (m, 1))
        alive = inside.copy()
        rows = np.arange(m)
        while len(rows):
            i = pair[rows].argmin(axis=1)
            rank = pair[rows, i]
            go = rank < NONE
            rows, i, rank = rows[go], i[go], rank[go]
            j = after[rows, i]
            k = after[rows, j]
            ids[rows, i], pair[rows, j], alive[rows, j], after[rows, i], before[rows, k] = rank, NONE, False, k, i
            pair[rows, i] = np.where(k < sizes[rows], self.pair_ranks(rank, ids[rows, k]), NONE)
            h = before[rows, i]
            left = h >= 0
            pair[rows[left], h[left]] = self.pair_ranks(ids[rows[left], h[left]], rank[left])
        data = ids[:, :width][alive].astype("<u4").tobytes()
        cuts = [0, *(4 * np.cumsum(alive.sum(axis=1))).tolist()]
        return [data[a:b] for a, b in zip(cuts, cuts[1:])]

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """The ids of pre-tokens as little-endian 32-bit bytes."""
        out: list = [None] * len(pieces)
        short = []
        for i, p in enumerate(pieces):
            b = p.encode()
            found = self.whole.get(b)
            if found is not None:
                out[i] = found.to_bytes(4, "little")
            elif len(b) <= SHORT:
                short.append((len(b), i, b))
            else:
                out[i] = np.array(self.merge(b), "<u4").tobytes()
        short.sort()
        for lo in range(0, len(short), TOGETHER):
            some = short[lo : lo + TOGETHER]
            for (_, i, _), v in zip(some, self.merge_many([b for _, _, b in some])):
                out[i] = v
        return out

    def encode_text(self, text: str) -> bytes:
        return np.array(self.library.encode_ordinary(text), "<u4").tobytes()

    def add(self, values) -> bytes:
        return b"".join(values)

    def ids_of_many(self, many: list[str]) -> list[list[int]]:
        return [np.frombuffer(v, "<u4").tolist() for v in self.encode_many(many)]

    def encode(self, text: str) -> list[int]:
        return self.ids_of_many([text])[0]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(2)
def codec(path: str) -> ByteBPE:
    return ByteBPE(path)


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Add an array of ids and the bytes they decode to; a null text is taken as empty.

    Empty texts get an empty array and empty bytes. Columns of the input that have these names are replaced.
    Repeated rows are each encoded. An unknown byte can't occur, as all 256 bytes have ranks.
    """
    df = df.drop(ids, decoded)
    kept = [c for c in df.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for batch in slices(batches, text, ENCODED_BYTES):
            found = bpe.encode_many([t or "" for t in texts(batch, text)])
            ends = np.cumsum([0, *(len(v) // 4 for v in found)]).astype(np.int32)
            all_ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), "<u4").astype(np.int32)))
            columns = [*batch.columns, all_ids, pa.array([bpe.decode(np.frombuffer(v, "<u4").tolist()) for v in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, ids, decoded])

    schema = T.StructType([*df.select(*kept, text).schema, T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(decoded, T.BinaryType())])
    return df.select(*kept, text).mapInArrow(lean(run), schema)


def digests(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode, decode, and return for each row: key, n_tokens, ids_sha256, decoded_sha256.

    A null or empty text has no tokens and the digests of nothing; a null key stays null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, number = codec(path), [str(i) for i in range(1 << 17)]
        for batch in slices(batches, text, 4 << 20):
            counts, ids_sha, out_sha = [], [], []
            for ids in bpe.ids_of_many([t or "" for t in texts(batch, text)]):
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(number.__getitem__, ids)).encode()).hexdigest())
                out_sha.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(out_sha)], [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(lean(run), f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
