"""Benchmark passages in documents: windows of item words found by their rarest word, then compared whole.

Exact containment needs every word of a window, so one necessary word is enough as its prefix: the rarest in
the documents. Documents look up only such words, bound the window by length and position, and compare it.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordmill.llm.shared import lean, slices, texts
from recordmill.llm.words import alnum_words

WINDOW = 13
#: Bytes of item texts in a block: what one broadcast of items holds at most (a longer item is its own block).
BLOCK_BYTES = 16 << 20


def windows(words: list[bytes], width: int = WINDOW) -> list[tuple[bytes, ...]]:
    """Runs of so many words; fewer words, but not none, are one window."""
    if len(words) <= width:
        return [tuple(words)] if words else []
    return list(zip(*(words[i:] for i in range(width))))


def blocks(items: DataFrame, key: str, text: str, limit: int) -> Iterator[list[tuple]]:
    """The items in lists of bounded size, each fetched by a query of its own; null texts take no part."""
    items = items.where(F.col(text).isNotNull()).select(F.col(key).cast("string").alias("id"), F.col(text).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-2 * total // limit)) if total > limit else 1
    for i in range(n):
        part = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == i) if n > 1 else items
        yield [(r.id, r.text) for r in part.collect()]


class Index:
    """For each rarest word: where it stands in windows (offset, length), and the items of those windows."""

    def __init__(self, items: list[tuple], counts: dict[bytes, int]):
        self.ids = [i for i, _ in items]
        self.by_word: dict[bytes, dict[tuple[int, int], dict[bytes, list[int]]]] = {}
        for k, (_, text) in enumerate(items):
            for w in set(windows(alnum_words(text))):
                rarest = min(w, key=lambda x: (counts.get(x, 0), x))
                owners = self.by_word.setdefault(rarest, {}).setdefault((w.index(rarest), len(w)), {})
                owners.setdefault(b" ".join(w), []).append(k)

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Spans of words hit, and the items."""
        by_word, n = self.by_word, len(words)
        spans, found = [], set()
        for i, x in [(i, x) for i, x in enumerate(words) if x in by_word]:
            for (offset, length), owners in by_word[x].items():
                start = i - offset
                if start >= 0 and start + length <= n and (who := owners.get(b" ".join(words[start : start + length]))):
                    spans.append((start, start + length))
                    found.update(who)
        return spans, found


def covered(spans: list[tuple[int, int]]) -> int:
    """Words in any of the spans."""
    total = last = 0
    for a, b in sorted(spans):
        total += max(0, b - max(a, last))
        last = max(last, b)
    return total


def word_counts(df: DataFrame, text: str, words: set[bytes]) -> dict[bytes, int]:
    """How often each of the given words occurs in all texts; their number is bounded by a block of items."""
    shared = df.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, total = shared.value, Counter()
        for batch in slices(batches, text):
            for t in texts(batch, text):
                total.update(wanted.intersection(alnum_words(t)))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    found = df.select(text).mapInArrow(lean(run), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r.word): r.n for r in found.toLocalIterator()}


def scan(df: DataFrame, index: Index, text: str) -> DataFrame:
    """All columns with n_words, spans and items of one block."""
    shared = df.sparkSession.sparkContext.broadcast(pickle.dumps(index))
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))
    schema = T.StructType([*df.schema, T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("spans", span), T.StructField("items", T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = pickle.loads(shared.value)
        for batch in slices(batches, text):
            n, hit, spans, items = [], [], [], []
            for t in texts(batch, text):
                words = alnum_words(t)
                s, found = here.scan(words)
                n.append(len(words))
                hit.append(covered(s))
                spans.append([{"start": a, "stop": b} for a, b in sorted(set(s))])
                items.append(sorted({here.ids[k] for k in found if here.ids[k] is not None}))
            added = [pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, "n_words", "n_hit", "spans", "items"])

    return df.mapInArrow(lean(run), schema)


def merge_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hit = [covered([(x["start"], x["stop"]) for x in s]) for s in texts(batch, "all_spans")]
        yield pa.RecordBatch.from_arrays([batch.column("h1"), batch.column("h2"), pa.array(hit, pa.int64()), batch.column("all_items")], ["h1", "h2", "all_hit", "all_items"])


def contamination(df: DataFrame, items: DataFrame, key: str = "item_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Add n_words, n_hit, items (ids found, as sorted strings) and contaminated (n_hit > 0 and 20 n_hit >= n_words).

    A word is a run of ASCII letters and digits and other non-ASCII characters, with A-Z lower-cased; a word in
    any occurrence of an item's window is hit. A null text has no words; null items take no part; a null
    item id counts as hit but is not listed. Items that share an id count once. Input columns with the added
    names are replaced. Items over the block size are searched for block by block, each against all rows.
    """
    df = df.drop("n_words", "n_hit", "items", "spans", "contaminated")
    result, more = None, []
    for block in blocks(items, key, text, block_bytes):
        counts = word_counts(df, text, {w for _, t in block for w in alnum_words(t)})
        found = scan(df, Index(block, counts), text)
        if result is None:
            result = found
        more.append(found.where("n_hit > 0").select(F.md5(text).alias("h1"), F.sha1(text).alias("h2"), "spans", "items").dropDuplicates(["h1", "h2"]))
    if len(more) > 1:
        rows = more[0]
        for x in more[1:]:
            rows = rows.union(x)
        rows = rows.groupBy("h1", "h2").agg(F.flatten(F.collect_list("spans")).alias("all_spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("all_items"))
        rows = rows.mapInArrow(lean(merge_spans), "h1 string, h2 string, all_hit long, all_items array<string>")
        whole = result.select(F.struct("*").alias("row"), F.md5(text).alias("h1"), F.sha1(text).alias("h2")).join(rows, ["h1", "h2"], "left")
        summed = {"n_hit": F.coalesce("all_hit", F.lit(0).cast("long")), "items": F.coalesce("all_items", F.array().cast("array<string>"))}
        result = whole.select(*(summed.get(c, F.col("row").getField(c)).alias(c) for c in result.columns))
    return result.drop("spans").withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def report(df: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """contamination() as a digest for each row: key, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = contamination(df.select(key, text), items)
    return found.select(key, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


#: The same by strings of all windows of both sides.
SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS k, array_to_string(list_slice(w, i, i + least(len(w), 13) - 1), ' ') AS s
  FROM b, LATERAL (SELECT unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i) WHERE len(w) > 0
), ks AS (SELECT DISTINCT k FROM bw
), dw AS (
  SELECT rid, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS s
  FROM d, ks, LATERAL (SELECT unnest(range(1, len(w) - k + 2)) AS i) WHERE len(w) >= k
), m AS (SELECT rid, dw.k, i, item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.s = bw.s
), h AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT rid, k, i FROM m)) GROUP BY rid
), t AS (SELECT rid, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS x FROM m) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN t USING (rid)
"""
