"""Near duplicates by an LSH forest: neighbours in several sorted signature orders, checked on full sets.

Each distinct shingle set is a node with a MinHash signature. A tree orders the nodes by a few of its values;
candidates are nodes near each other in that order that share a prefix, and the heads of the regions that share
it. Texts with the same set are one node from the start. A few trees come first, some at a time: each node's
neighbour and heads that are in other classes are candidates there, the best of each node are checked, and what
is linked becomes one class. Then all trees run over the nodes with their classes, and each node meets all those
of other classes in its region. Where a region is crowded with them, its nodes meet with their signatures and a
bitmap of their sets at hand: each bit that only one of two maps has is a shingle that only one of the sets has, so a
pair with too many such bits can't be linked and is dismissed there, as is one whose signatures are too far apart, or
that meets in an earlier tree as well; all others go on, however many. Candidates are checked on full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordmill.llm.components import components
from recordmill.llm.shared import discard, few, lean, materialize, slices, texts, with_hot
from recordmill.llm.words import WordHashes, shingle_hashes, shingle_set, spaced_words

#: MinHash values of a signature; trees; values that a candidate shares at least; further values in the order.
HASHES, TREES, DEPTH, DEEPER = 128, 40, 6, 10
#: Trees that come first: from, to.
FIRST = ((0, 8), (8, 16), (16, 24))
#: Depths after DEPTH at which a region has a head, in the trees that come first.
HEADS = (0, 5)
#: Nodes of other classes before a node above which its region is crowded.
ROOM = 64
#: Rows whose neighbours are found at a time; pairs at a time.
ROWS, PAIRS = 50_000, 50_000
#: Bits of a set's map.
MAP = 1024
#: Share of equal values under which a pair is not checked (seven standard errors less than 0.8).
AGREE = 0.55

_RNG = np.random.default_rng(11)
_A = (_RNG.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1))[:, None]
_B = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64)[:, None]
_ORDER = np.stack([_RNG.permutation(HASHES)[: DEPTH + DEEPER] for _ in range(TREES)])
_MIX = _RNG.integers(1, 1 << 63, (TREES, DEPTH), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Shingles whose hash values are computed at a time.
BLOCK = 4096


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of HASHES 32-bit minima for each non-empty array of shingle hashes."""
    out = np.full((len(sets), HASHES), 0xFFFFFFFF, np.uint32)
    group: list[int] = []

    def flush() -> None:
        h = np.concatenate([sets[i] for i in group])
        starts = np.cumsum([0] + [len(sets[i]) for i in group[:-1]])
        out[group] = np.minimum.reduceat(((h * _A + _B) >> np.uint64(32)).astype(np.uint32), starts, axis=1).T

    total = 0
    for i, h in enumerate(sets):
        if len(h) > BLOCK:
            for k in range(0, len(h), BLOCK):
                out[i] = np.minimum(out[i], ((h[k : k + BLOCK] * _A + _B) >> np.uint64(32)).astype(np.uint32).min(axis=1))
            continue
        if group and total + len(h) > BLOCK:
            flush()
            group, total = [], 0
        group.append(i)
        total += len(h)
    if group:
        flush()
    return out


def bitmap(shingles: np.ndarray) -> bytes:
    """A bit for each shingle's hash; shingles may share bits."""
    bits = np.zeros(MAP, np.uint8)
    bits[(shingles >> np.uint64(40)).astype(np.int64) & (MAP - 1)] = 1
    return np.packbits(bits).tobytes()


def possible(n: np.ndarray, m: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether sets of n and m shingles with these maps (rows of 64-bit words) can be linked: an exact bound."""
    only_x, only_y = (np.bitwise_count(a & ~b).sum(axis=1, dtype=np.int64) for a, b in ((x, y), (y, x)))
    both = np.minimum(n - only_x, m - only_y)
    return 100 * both >= 80 * (n + m - both)


def fixed(values: np.ndarray, width: int) -> pa.Array:
    """Rows of bytes as a binary column."""
    data = np.ascontiguousarray(values)
    return pa.Array.from_buffers(pa.binary(width), len(data), [None, pa.py_buffer(data)]).cast(pa.binary())


def sign(width: int, text: str):
    """Each text's set size, node (128-bit hash of its set; null if empty) and signature with the set's map after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in slices(batches, text, 2 << 20):
            sets = [shingle_hashes(words.array(spaced_words(t)), width) for t in texts(batch, text)]
            full = [i for i, h in enumerate(sets) if len(h)]
            made = signatures([sets[i] for i in full])
            nodes: list = [None] * len(sets)
            sigs: list = [None] * len(sets)
            for k, i in enumerate(full):
                nodes[i] = xxhash.xxh3_128_digest(sets[i].tobytes())
                sigs[i] = made[k].tobytes() + bitmap(sets[i])
            rest = [batch.column(c) for c in batch.schema.names if c != text]
            names = [c for c in batch.schema.names if c != text]
            yield pa.RecordBatch.from_arrays([*rest, pa.array([len(h) for h in sets], pa.int64()), pa.array(nodes, pa.binary()), pa.array(sigs, pa.binary())], [*names, "n_shingles", "node", "sig"])

    return run


def unpacked(column: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of minima and of maps."""
    rows = np.frombuffer(b"".join(column), np.uint32).reshape(len(column), HASHES + MAP // 32)
    return rows[:, :HASHES], np.ascontiguousarray(rows[:, HASHES:]).view(np.uint64)


def keys_of(sig: np.ndarray, t: int) -> np.ndarray:
    """A hash of a tree and the first values that it orders signatures by."""
    key = (sig[:, _ORDER[t][:DEPTH]].astype(np.uint64) * _MIX[t]).sum(axis=1, dtype=np.uint64) + _MIX[t, 0]
    return (key ^ (key >> np.uint64(29))).view(np.int64)


def grow(trees: range, whole_sig: bool):
    """A row for each node and tree: key (see keys_of), deep (bytes of further values), and the signature if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                m = batch.num_rows
                sig, _ = unpacked(texts(batch, "sig"))
                node = np.frombuffer(b"".join(texts(batch, "node")), np.uint8).reshape(m, 16)
                beside = batch.column("sig") if whole_sig else pa.nulls(m, pa.binary())
                for t in trees:
                    deep = (sig[:, _ORDER[t][DEPTH:]] & 0xFF).astype(np.uint8)
                    columns = [pa.array(keys_of(sig, t)), fixed(deep, DEEPER), fixed(node, 16), beside, batch.column("n_shingles"), batch.column("class")]
                    yield pa.RecordBatch.from_arrays(columns, ["key", "deep", "node", "sig", "n", "class"])

    return run


def whole_regions(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Of rows in order, the columns of one or more whole regions (equal keys) at a time."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        m = batch.num_rows
        if not m:
            continue
        deep = np.frombuffer(b"".join(texts(batch, "deep")), np.uint8).reshape(m, DEEPER)
        node = np.frombuffer(b"".join(texts(batch, "node")), np.uint8).reshape(m, 16)
        sig = np.frombuffer(b"".join(x or b"" for x in texts(batch, "sig")), np.uint32).reshape(m, -1)
        rows = [batch.column("key").to_numpy(), deep, node, sig, batch.column("n").to_numpy(), batch.column("class").to_numpy()]
        last = int(np.searchsorted(rows[0], rows[0][-1]))
        if last or (held and held[-1][0][-1] != rows[0][0]):
            held.append([x[:last] for x in rows])
            yield [np.concatenate(x) for x in zip(*held)]
            held = []
        held.append([x[last:] for x in rows])
    if held:
        yield [np.concatenate(x) for x in zip(*held)]


def before_others(rows: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The rows of regions with more than one class; where each row's region and its run of one class start."""
    key, group = rows[0], rows[-1]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    mixed = np.minimum.reduceat(group, starts) != np.maximum.reduceat(group, starts)
    rows = [v[np.repeat(mixed, np.diff(np.append(starts, len(key))))] for v in rows]
    key, group = rows[0], rows[-1]
    new = np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]
    at = np.arange(len(key))
    fresh = new | np.concatenate([[True], group[1:] != group[:-1]])[: len(key)]
    return rows, np.maximum.accumulate(np.where(new, at, 0)), np.maximum.accumulate(np.where(fresh, at, 0))


def pairs_of(rows: list[np.ndarray], x: list[np.ndarray], y: list[np.ndarray]) -> pa.RecordBatch:
    """Distinct pairs of rows of different classes that may be linked, as nodes.

    Where rows have signatures, pairs come from the first tree alone in which they meet.
    """
    key, _, node, sig, n, group = rows
    x, y = np.concatenate(x), np.concatenate(y)
    fits = (group[x] != group[y]) & (5 * np.minimum(n[x], n[y]) >= 4 * np.maximum(n[x], n[y]))
    y, x = np.divmod(np.unique(y[fits] * len(n) + x[fits]), len(n))
    if sig.shape[1] and len(x):
        maps = np.ascontiguousarray(sig[:, HASHES:]).view(np.uint64)
        fits = possible(n[x], n[y], maps[x], maps[y])
        x, y = x[fits], y[fits]
        same = sig[x, :HASHES] == sig[y, :HASHES]
        fits = same.mean(axis=1) >= AGREE
        x, y, same = x[fits], y[fits], same[fits]
        first = np.zeros(len(x), bool)
        left = np.ones(len(x), bool)
        for t in range(TREES):
            meet = left & same[:, _ORDER[t][:DEPTH]].all(axis=1)
            if meet.any():
                first[meet] = keys_of(sig[x[meet]], t) == key[x[meet]]
                left &= ~meet
        x, y = x[first], y[first]
    return pa.RecordBatch.from_arrays([fixed(node[x], 16), fixed(node[y], 16)], ["x", "y"])


def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in order, pairs (x, y) of different classes: the nearest row of another class before, and the heads."""
    for rows in whole_regions(batches):
        rows, region, runs = before_others(rows)
        at, deep = np.arange(len(region)), rows[1]
        if not len(at):
            continue
        x, y = [], []
        for depth in HEADS:
            fresh = (region == at) | np.concatenate([[True], (deep[1:, :depth] != deep[:-1, :depth]).any(axis=1)])
            x.append(np.maximum.accumulate(np.where(fresh, at, 0)))
            y.append(at)
        before = runs - 1
        live = before >= region
        yield pairs_of(rows, [*x, before[live]], [*y, at[live]])


def meetings(room: int | None):
    """Of rows in order, all pairs (x, y) of one region and different classes that may be linked.

    Of a region where a row has more than room rows of other classes before it, no pairs but all rows come, as
    (x, null); without a limit all regions give pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_regions(batches):
            by = np.lexsort((rows[-1], rows[0]))  # by class in each region, so that own rows are passed over as one run
            rows, region, runs = before_others([v[by] for v in rows])
            others = runs - region
            if not len(others):
                continue
            if room is not None:
                starts = np.flatnonzero(region == np.arange(len(region)))
                crowded = np.repeat(np.maximum.reduceat(others, starts) > room, np.diff(np.append(starts, len(region))))
                if crowded.any():
                    node = rows[2][crowded]
                    yield pa.RecordBatch.from_arrays([fixed(node, 16), pa.nulls(len(node), pa.binary())], ["x", "y"])
                others = np.where(crowded, 0, others)
            done = np.cumsum(others)
            lo = 0
            while lo < len(others):  # so many rows that they have about PAIRS pairs, one at least
                hi = max(lo + 1, int(np.searchsorted(done, (done[lo - 1] if lo else 0) + PAIRS, "right")))
                hi = min(hi, lo + ROWS)
                n = others[lo:hi]
                y = np.repeat(np.arange(lo, hi), n)
                x = np.arange(len(y)) - np.repeat(np.cumsum(n) - n, n) + region[y]
                if len(y):
                    yield pairs_of(rows, [x], [y])
                lo = hi

    return run


def check(width: int):
    """Which pairs of texts have 100 * intersection >= 80 * union of their sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known = None, set()
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                linked = []
                for a, ta, tb in zip(texts(part, "a"), texts(part, "text_a"), texts(part, "text_b")):
                    if a != last:
                        last, known = a, shingle_set(spaced_words(ta), width)
                    other = shingle_set(spaced_words(tb), width)
                    both = len(known & other)
                    linked.append(100 * both >= 80 * (len(known) + len(other) - both))
                part = part.select(["a", "b"])
                yield part.filter(pa.array(linked))

    return run


def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose signatures agree enough, and whose maps allow it, to be worth a check."""
    for whole in batches:
        for start in range(0, whole.num_rows, 2000):
            batch = whole.slice(start, 2000)
            (x, p), (y, q) = (unpacked(texts(batch, c)) for c in ("sig_a", "sig_b"))
            n, m = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
            yield batch.select(["a", "b"]).filter(pa.array(((x == y).mean(axis=1) >= AGREE) & possible(n, m, p, q)))


class NearDuplicates:
    """Classes of texts linked at 0.8 or more over shingles of so many words."""

    def __init__(self, width: int, key: str = "doc_id", text: str = "text"):
        self.width, self.key, self.text = width, key, text

    def bodies(self, wanted: DataFrame) -> DataFrame:
        """node, body: the text of each of the distinct nodes."""
        wanted = materialize(wanted.join(self.nodes.select("node", "body_key"), "node"), "wanted")
        keys = few(wanted)
        found = self.docs.select(F.unhex(F.md5(self.text)).alias("body_key"), F.col(self.text).alias("body")).join(keys.select("body_key"), "body_key", "left_semi")
        found = found.groupBy("body_key").agg(F.first("body").alias("body"))
        found = materialize(found.join(keys, "body_key").select("node", "body"), "bodies")
        discard(found.sparkSession, wanted)
        return found

    def linked(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) of nodes whose texts' full sets are close enough."""
        pairs = materialize(pairs, "pairs")
        bodies = self.bodies(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
        one = pairs.join(bodies.select(F.col("node").alias("b"), F.col("body").alias("text_b")), "b")
        two = one.join(bodies.select(F.col("node").alias("a"), F.col("body").alias("text_a")), "a")
        links = materialize(two.select("a", "b", "text_a", "text_b").mapInArrow(lean(check(self.width)), "a binary, b binary"), "links")
        for table in (pairs, bodies):
            discard(links.sparkSession, table)
        return links

    def near(self, nodes: DataFrame, trees: range, find, whole_sig: bool = False) -> DataFrame:
        """What find() gives for the orders of these trees. Ranges are of the key alone: no region is divided among tasks."""
        parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        forest = nodes.select("node", "n_shingles", "sig", "class").mapInArrow(lean(grow(trees, whole_sig)), "key long, deep binary, node binary, sig binary, n long, class long")
        return forest.repartitionByRange(parts, "key").sortWithinPartitions("key", "deep", "node").mapInArrow(lean(find), "x binary, y binary")

    def candidates(self, nodes: DataFrame) -> DataFrame:
        """Pairs (a, b) of nodes of different classes that share a region in any tree, but those that an exact bound dismisses."""
        found = materialize(self.near(nodes, range(TREES), meetings(ROOM)).distinct(), "met")
        pairs = found.where("y is not null")
        crowded = found.where("y is null").select(F.col("x").alias("node"))
        if not crowded.isEmpty():
            pairs = pairs.union(self.near(nodes.join(few(crowded), "node"), range(TREES), meetings(None), True))
        return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()

    def mark(self, nodes: DataFrame, labels: DataFrame) -> DataFrame:
        """Nodes with a number for the class they are in."""
        return materialize(nodes.join(few(labels), "node", "left").withColumn("class", F.xxhash64(F.coalesce("label", "node"))).drop("label"), "marked")

    def joined(self, labels: DataFrame | None, links: DataFrame) -> DataFrame:
        """The classes (node, label) that further links make."""
        if labels is not None:
            if links.isEmpty():
                return labels
            links = labels.select(F.col("node").alias("a"), F.col("label").alias("b")).union(links)
        return components(links)

    def alike(self, pairs: DataFrame) -> DataFrame:
        """Pairs whose signatures say that a check is worth it."""
        for side in "ab":
            pairs = pairs.join(self.nodes.select(F.col("node").alias(side), F.col("sig").alias(f"sig_{side}"), F.col("n_shingles").alias(f"n_{side}")), side)
        return pairs.select("a", "b", "sig_a", "sig_b", "n_a", "n_b").mapInArrow(lean(alike), "a binary, b binary")

    def classes(self, df: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
        """For each row: key, n_shingles, component_id, body_key (hash of the text), label, and the carried columns.

        label is one value for each class, and null for a row with an empty set.
        component_id is the smallest key that links reach, the row's own included; with an empty set it is the
        row's key. Rows with equal texts are in one class. Null keys come before no others: a class with a key
        that isn't null takes the smallest such key.
        """
        base = df.select(self.key, *carry, self.text, F.unhex(F.md5(self.text)).alias("body_key"))
        kinds = ", ".join(f"`{c}` {base.schema[c].dataType.simpleString()}" for c in (self.key, *carry, "body_key"))
        members = materialize(base.mapInArrow(lean(sign(self.width, self.text)), f"{kinds}, n_shingles long, node binary, sig binary"), "members")
        self.nodes = nodes = materialize(
            members.where("node is not null").groupBy("node").agg(F.min(self.key).alias("first"), F.min("body_key").alias("body_key"), F.min("n_shingles").alias("n_shingles"), F.min("sig").alias("sig")), "nodes"
        )
        self.docs = df
        marked, labels = nodes.withColumn("class", F.xxhash64("node")), None
        for lo, hi in FIRST:
            found = self.near(marked, range(lo, hi), nearest).groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.count("*").alias("votes"))
            found = materialize(found, "candidates")
            best = F.max_by(F.struct("a", "b"), F.struct("votes", "a", "b")).alias("p")
            pairs = found.groupBy("b").agg(best).select("p.*").union(found.groupBy("a").agg(best).select("p.*")).distinct()
            labels = self.joined(labels, self.linked(pairs))
            before, marked = marked, self.mark(nodes, labels)
            discard(df.sparkSession, found)
            if before.inputFiles()[:1] != nodes.inputFiles()[:1]:
                discard(df.sparkSession, before)
        labels = self.joined(labels, self.linked(self.alike(self.candidates(marked))))

        named = nodes.select("node", "first").join(few(labels), "node", "left")
        together = named.where("label is not null")
        smallest = together.groupBy("label").agg(F.min("first").alias("component_id"), F.count("*").alias("rows"))
        together = with_hot(together.select("node", "label"), smallest, "label", together.count()).select("node", "component_id", "label")
        named = materialize(together.union(named.where("label is null").select("node", "first", "node")), "classes")
        discard(df.sparkSession, nodes)
        return members.join(named, "node", "left").select(self.key, *carry, "n_shingles", F.coalesce("component_id", self.key).alias("component_id"), "body_key", "label")


def near_duplicates(df: DataFrame, width: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row: key, n_shingles, component_id, kept (the row whose key names its class).

    A null or blank text has an empty set and a class of its own; a row with a null key in a class of rows with
    keys isn't kept, and with no such row its class is null and it is kept. Repeated rows are each returned.
    """
    found = NearDuplicates(width, key, text).classes(df)
    return found.select(key, "n_shingles", "component_id", F.col(key).eqNullSafe(F.col("component_id")).alias("kept"))


def one_of_each(df: DataFrame, width: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay: one of each class, and all with an empty set, which are alone in theirs.

    Of a class it is the row with the smallest key, null keys last, then by a hash of the text; rows equal in both
    are counted, and any one of them stays.
    """
    found = NearDuplicates(width, key, text).classes(df)
    found = found.groupBy("label", F.col(key).alias("_key"), F.col("body_key").alias("_body")).agg(F.count("*").alias("_rows"))
    found = materialize(found, "members_of_classes")
    order = F.struct(F.col("_key").isNull(), "_key", "_body")
    first = found.where("label is not null").groupBy("label").agg(F.min_by(F.struct("_key", "_body", "_rows"), order).alias("first")).select("first.*")
    kept = materialize(first.union(found.where("label is null").select("_key", "_body", F.lit(1).cast("long"))), "kept")

    def rows(some: DataFrame) -> DataFrame:
        here = df.withColumn("_text", F.unhex(F.md5(text)))
        return here.join(some, F.col(key).eqNullSafe(F.col("_key")) & F.col("_text").eqNullSafe(F.col("_body")), "left_semi")

    out = rows(kept.where("_rows = 1"))
    repeated = kept.where("_rows > 1")
    if not repeated.isEmpty():
        out = out.union(rows(repeated).dropDuplicates([key, "_text"]))
    return out.drop("_text")
