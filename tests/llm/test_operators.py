"""The corpus operators against libraries, SQL and brute force, on the small tables and on odd ones."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
import sentencepiece
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from recordmill.llm import ann, bpe, catalogue, decontaminate, language_id, line_dedup, lm_score, mixing, near_dup, planes, pretokens, quality, token_counts
from recordmill.llm.components import components
from recordmill.llm.words import alnum_words, shingle_set, spaced_column, spaced_words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " ", "  ", "\n", "a", " a", "a ", "a  b", "a\n b", "x \n\n y  ", "don't we'll I'M", "　 a", "123 4,5. 6", "\x00\x1c a", "<|endoftext|> a <s>", "▁a ▁", "é́ x", "ࢍ ა", "😀😀", "z" * 5000, "the quick " * 3000]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, twice, with null keys, repeated rows and columns whose names clash with results."""
    rows = [(i, t, "en" if i % 3 else None, None, None) for i, t in enumerate([*ODD, *ODD])] + [(None, "null key", None, None, None), (3, "a", "en", None, None), (3, "a", "en", None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    names = ("score", "n_tokens", "ids", "spans", "items", "kept", "n_words", "lang_pred", "n_removed", "component_id")
    return df.withColumns({n: F.lit("clash") for n in names})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def docs(spark, sf_dir):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]


# ---- tokens


def test_token_counts(spark, sf_dir, odd, empty):
    model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    for df in (spark.read.parquet(f"{sf_dir}/documents.parquet"), odd):
        texts = [r.text for r in df.collect()]
        found = token_counts.count_tokens(df, P.path("piece_bpe_32k.model")).collect()
        assert sorted(r.n_tokens for r in found) == sorted(len(model.encode(t or "")) for t in texts)
        assert sorted(r.n_bytes for r in found) == sorted(len((t or "").encode()) for t in texts)
        assert all(r.over_limit == (r.n_tokens > 4096) for r in found)
    assert token_counts.count_tokens(empty, P.path("piece_bpe_32k.model")).count() == 0


def test_byte_bpe(spark, sf_dir, odd, empty):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("x", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    for df in (spark.read.parquet(f"{sf_dir}/documents.parquet"), odd):
        wanted = []
        for r in df.collect():
            ids = library.encode_ordinary(r.text or "")
            wanted.append((str(r.doc_id), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
        assert sorted((str(r[0]), *r[1:]) for r in bpe.digests(df, path).collect()) == sorted(wanted)
    encoded = bpe.encode(odd, path).collect()
    assert all(bytes(r.decoded) == library.decode_bytes(r.ids) for r in encoded) and len(encoded) == odd.count()
    assert bpe.digests(empty, path).count() == 0


def test_heap_and_side_by_side_merges_agree():
    codec = bpe.codec(P.path("byte_bpe_multi_50k.tiktoken"))
    rng = np.random.default_rng(0)
    pieces = [bytes(rng.integers(97, 105, rng.integers(2, 33)).astype(np.uint8)) for _ in range(3000)] + ["éàü漢字".encode()]
    assert [np.frombuffer(v, "<u4").tolist() for v in codec.merge_many(pieces)] == [list(codec.merge(p)) for p in pieces]


def test_perfect_hash():
    keys = {str(i * i).encode(): i for i in range(3000)}
    table = bpe.PerfectHash(keys)
    assert all(table.get(k) == v for k, v in keys.items()) and None not in table.keys
    assert table.get(b"x") is None and bpe.PerfectHash({b"one": 1}).get(b"one") == 1


def test_chunks_are_safe():
    for text in (t for t in ODD if t and pretokens.settled(t) and pretokens.apart(t)):
        head, *rest = text.split(" ")
        assert pretokens.SPLIT.findall(head) + [p for c in rest for p in pretokens.SPLIT.findall(" " + c)] == pretokens.SPLIT.findall(text)


def test_planes(spark, sf_dir, odd, empty, tmp_path):
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for df in (spark.read.parquet(f"{sf_dir}/documents.parquet"), odd):
        wanted, start = [], 0
        for r in sorted(df.select("doc_id", "text").collect(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
            ids = library.encode(r.text or "", add_special_tokens=False).ids + [2]
            wanted.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
        found = planes.round_trip(df, P.path("byte_bpe_50k.json"), 2).collect()
        assert sorted(map(tuple, found), key=lambda r: r[1]) == wanted
    assert planes.round_trip(empty, P.path("byte_bpe_50k.json"), 2).count() == 0


def test_planes_of_one_key(spark, tmp_path):
    """Rows without a key are parted by how their texts begin, and stay in order."""
    df = spark.createDataFrame([(None, f"{i:03d} words of no key") for i in range(200)], "doc_id long, text string")
    planes.write(df, f"{tmp_path}/p", P.path("byte_bpe_50k.json"), 2)
    assert spark.read.parquet(f"{tmp_path}/p").select("shard").distinct().count() > 1
    library, wanted, start = Tokenizer.from_file(P.path("byte_bpe_50k.json")), [], 0
    for i in range(200):
        ids = library.encode(f"{i:03d} words of no key").ids + [2]
        wanted.append((None, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, planes.round_trip(df, P.path("byte_bpe_50k.json"), 2).collect()), key=lambda r: r[1]) == wanted


@pytest.mark.parametrize("bits", [True, False])
def test_planes_of_small_chunks(spark, tmp_path, bits):
    df = spark.createDataFrame([(i, "some words " * i) for i in range(40)], "doc_id long, text string")
    planes.write(df, f"{tmp_path}/p", P.path("byte_bpe_50k.json"), 2, bits, chunk=16)
    found = {r.doc_id: r for r in planes.read(spark, f"{tmp_path}/p").collect()}
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for i in range(40):
        ids = np.array(library.encode("some words " * i).ids + [2], "<u4")
        assert (found[i].n_tokens, found[i].ids_crc32) == (len(ids), zlib.crc32(ids.tobytes()))


@pytest.mark.parametrize("bits", [True, False])
def test_plane_round_trip(bits):
    for ids in (np.zeros(0), np.array([0]), np.arange(1000) * 97, np.array([2**32 - 1, 5])):
        assert (planes.from_planes(planes.to_planes(ids.astype("<u4"), bits), len(ids), bits) == ids).all()


# ---- line dedup


def brute_lines(rows, least=50):
    """Lines in a run of enough words that occurs, whole, at an earlier place; rows: (key, text) in order."""
    places = []
    for key, text in rows:
        kept = [(i, line.strip(" \t\r\f\x0b")) for i, line in enumerate(text.split("\n"))]
        places.append([(i, x, len(x.split())) for i, x in kept if x])
    first, gone = {}, defaultdict(set)
    for d, lines in enumerate(places):
        for a in range(len(lines)):
            words = 0
            for b in range(a, len(lines)):
                words += lines[b][2]
                run = tuple(x for _, x, _ in lines[a : b + 1])
                if words >= least:
                    if run in first and first[run] != (d, a):
                        gone[d].update(range(lines[a][0], lines[b][0] + 1))
                    first.setdefault(run, (d, a))
    return {d: "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone[d]) for d, (_, text) in enumerate(rows)}


def test_line_dedup_brute_force(spark):
    rng = np.random.default_rng(1)
    pool = [" ".join(f"w{i}x{j}" for j in range(rng.integers(1, 40))) for i in range(25)]
    rows = [(d, "\n".join(pool[i] if i >= 0 else "" for i in rng.integers(-2, 25, rng.integers(1, 25)).clip(-1))) for d in range(60)]
    found = {r.doc_id: r.text for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {rows[d][0]: t for d, t in brute_lines(rows).items()}


def line_rows():
    rng = np.random.default_rng(1)
    pool = [" ".join(f"w{i}x{j}" for j in range(rng.integers(1, 40))) for i in range(25)]
    return [(d, "\n".join(pool[i] if i >= 0 else "" for i in rng.integers(-2, 25, rng.integers(1, 25)).clip(-1))) for d in range(60)]


def test_line_dedup_when_fingerprints_collide(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "fingerprint", lambda line: F.length(line).cast("long") % 2)
    rows = line_rows()
    found = {r.doc_id: r.text for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {rows[d][0]: t for d, t in brute_lines(rows).items()}


def test_line_dedup_names_and_hot_windows(spark, monkeypatch):
    from recordmill.llm import shared

    monkeypatch.setattr(shared, "HOT_ROWS", 3)
    rows = line_rows()
    names = ["row", "key", "_text", "_key", "k1", "k2", "spans", "pos", "line", "h1", "hits", "content", "n_removed"]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({n: F.lit("mine") for n in names})
    found = line_dedup.line_dedup(df)
    assert found.columns == ["doc_id", "text", *names[:-1], "n_lines", "n_removed"]
    assert {r.doc_id: r.text for r in found.collect()} == {rows[d][0]: t for d, t in brute_lines(rows).items()}
    assert found.where("spans != 'mine' OR k1 != 'mine' OR row != 'mine'").count() == 0


def test_line_dedup_odd(spark, odd, empty):
    found = line_dedup.line_dedup(odd)
    assert found.count() == odd.count() and {r.text for r in found.where("text is null").collect()} == {None}
    assert {r.n_lines for r in found.where("text is null").collect()} == {0}
    texts = Counter(r.text for r in found.collect())
    assert texts["the quick " * 3000] == 1 and texts["z" * 5000] == 2
    assert line_dedup.line_dedup(empty).count() == 0


# ---- decontamination


def brute_hits(text, items):
    words = alnum_words(text)
    hit, found = set(), set()
    for key, item in items:
        for w in decontaminate.windows(alnum_words(item)):
            for i in range(len(words) - len(w) + 1):
                if tuple(words[i : i + len(w)]) == w:
                    hit.update(range(i, i + len(w)))
                    found.add(str(key))
    return len(words), len(hit), found


def test_contamination_brute_force(spark):
    rng = np.random.default_rng(2)
    item = lambda n: " ".join(f"w{i}" for i in rng.integers(0, 6, n))
    items = [(i, item(rng.integers(1, 20))) for i in range(12)] + [(99, None), (100, ""), (None, "w1 w2 w3 w4"), (3, "W5 w5")]
    rows = [(i, item(rng.integers(0, 200))) for i in range(60)] + [(60, None), (61, "W5, w5!")]
    a, b = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for size in (decontaminate.BLOCK_BYTES, 100):
        for r in decontaminate.contamination(a, b, block_bytes=size).collect():
            n, hit, found = brute_hits(r.text, [(k, t) for k, t in items if t is not None])
            assert (r.n_words, r.n_hit, set(r["items"])) == (n, hit, found - {"None"})
            assert r.contaminated == (hit > 0 and 20 * hit >= n)


def test_contamination_of_long_texts_and_clashing_names(spark):
    names = ("h1", "h2", "all_hit", "all_items", "row", "all_spans")
    item = " ".join(f"i{k}" for k in range(40))
    long = " ".join(f"w{k % 977}" for k in range(150_000))
    rows = [(1, f"{long} {item} {long}"), (2, item), (3, long), (4, "x" * 1_000_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({n: F.lit("mine") for n in names})
    items = spark.createDataFrame([(1, item), (2, "never there at all")], "item_id long, text string")
    for size in (decontaminate.BLOCK_BYTES, 50):
        found = {r.doc_id: r for r in decontaminate.contamination(df, items, block_bytes=size).collect()}
        assert [(found[k].n_words, found[k].n_hit, found[k].contaminated) for k in (1, 2, 3, 4)] == [(300_040, 40, False), (40, 40, True), (150_000, 0, False), (1, 0, False)]
        assert all(found[k][n] == "mine" for k in found for n in names)


def test_long_texts(spark):
    rng = np.random.default_rng(2)
    long = " ".join(f"w{k}" for k in rng.integers(0, 5000, 60_000))
    lines = "\n".join(f"line {k} of many" for k in range(20_000))
    rows = [(1, long), (2, long + " more"), (3, lines), (4, "head\n" + lines), (5, "z" * 400_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en"))
    assert {r.doc_id: r.component_id for r in near_dup.near_duplicates(df, 5).collect()} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5}
    cut = {r.doc_id: r for r in line_dedup.line_dedup(df).collect()}
    assert (cut[4].text, cut[4].n_removed, cut[3].n_removed, cut[2].text) == ("head", 20_000, 0, long + " more")
    assert language_id.label(df, language_id.fit(df)).count() == 5
    scored = {r.doc_id: r for r in lm_score.predict(df).collect()}
    assert scored[1].n_tokens == 60_001 and all(r.score < 0 for r in scored.values())


def test_contamination_odd(spark, odd, empty):
    items = spark.createDataFrame([(1, "the quick the")], "item_id long, text string")
    found = decontaminate.contamination(odd, items)
    assert found.count() == odd.count() and found.where("contaminated").count() == 2
    assert decontaminate.contamination(empty, items).count() == 0
    assert decontaminate.contamination(odd, items.where("false")).where("n_hit > 0").count() == 0


@pytest.mark.parametrize("name", ["op1_line_dedup", "op2_decontaminate"])
def test_against_sql(name, spark, sf_dir, duck, same):
    same(catalogue.queries()[name](spark, sf_dir), duck.sql(catalogue.oracle_sql()[name]))


# ---- near duplicates


def brute_classes(rows, width):
    """The smallest key that links of 0.8 reach, for each (key, text)."""
    sets = [shingle_set(spaced_words(t), width) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = root(i), root(j)
                label[max(x, y)] = min(x, y)
    least = {}
    for i, (key, _) in enumerate(rows):
        r = root(i)
        if key is not None:
            least[r] = min(least.get(r, key), key)
    return [(key, len(sets[i]), least.get(root(i), key) if sets[i] else key) for i, (key, _) in enumerate(rows)]


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_brute_force(spark, sf_dir, width):
    rng = np.random.default_rng(3)
    rows = docs(spark, sf_dir)
    for i in range(150):  # chains and groups around the threshold
        words = (rows[i % 12][1] or "x").split()[:120]
        for k in rng.integers(0, len(words), rng.integers(0, 14)):
            words[k] = f"new{rng.integers(1000)}"
        rows.append((10_000 + i, " ".join(words)))
    rows += [(20_000, None), (20_001, ""), (20_002, "one"), (20_003, "ONE"), (None, "one"), (20_003, "ONE")]
    found = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == Counter(brute_classes(rows, width))
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_near_duplicates_odd(odd, empty):
    assert near_dup.near_duplicates(odd, 2).count() == odd.count()
    assert near_dup.near_duplicates(empty, 2).count() == 0


def meetings(rows, room, known=False):
    """Pairs of places that rows (class, shingles) of one region give; None: in a crowded region."""
    count = len(rows)
    names = [k.to_bytes(16, "big") for k in range(count)]
    values = np.zeros((count, near_dup.HASHES), np.uint32)
    maps = [near_dup.bitmap(np.array(sorted(s), np.uint64) << np.uint64(40)) for _, s in rows]
    sigs = [v.tobytes() + m for v, m in zip(values, maps)] if known else [None] * count
    long = lambda values: pa.array(list(values), pa.int64())
    key = int(near_dup.keys_of(values[:1], 0)[0])
    columns = [long([key] * count), pa.array([bytes(near_dup.DEEPER)] * count, pa.binary()), pa.array(names, pa.binary()), pa.array(sigs, pa.binary()), long(len(s) for _, s in rows), long(c for c, _ in rows)]
    batch = pa.RecordBatch.from_arrays(columns, ["key", "deep", "node", "sig", "n", "class"])
    out = near_dup.meetings(room)(iter([batch.slice(k, 7) for k in range(0, count, 7)]))
    number = lambda x: None if x is None else int.from_bytes(x, "big")
    found = [(number(x), number(y)) for b in out for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist())]
    assert len(found) == len(set(found))
    return {(x, y) if y is None else (min(x, y), max(x, y)) for x, y in found}


def test_regions_meet_whole(monkeypatch):
    ten = set(range(10))
    every = {(x, y) for y in range(50) for x in range(y)}
    assert meetings([(c, ten) for c in range(50)], 64) == meetings([(c, ten) for c in range(50)], None, True) == every
    assert meetings([(c, ten) for c in range(50)], 40) == {(x, None) for x in range(50)}
    assert meetings([(1, ten)] * 30, None) == set()
    monkeypatch.setattr(near_dup, "PAIRS", 10)
    assert meetings([(k % 2, ten) for k in range(40)], None) == {(x, y) for y in range(40) for x in range(y) if (x + y) % 2}
    nine = ten - {3}
    assert meetings([(0, ten), (1, ten - {1, 2, 3} | {11, 12, 13}), (2, nine)], None, True) == {(0, 2)}


def test_pairs_come_from_their_first_tree():
    rng = np.random.default_rng(3)
    values = rng.integers(0, 1 << 32, (2, near_dup.HASHES), dtype=np.uint32)
    shared = np.unique(np.concatenate([near_dup._ORDER[t][: near_dup.DEPTH] for t in (4, 9, 30)]))
    rest = np.setdiff1d(np.arange(near_dup.HASHES), shared)
    values[1, shared] = values[0, shared]
    values[1, rest[:90]] = values[0, rest[:90]]
    together = [t for t in range(near_dup.TREES) if (near_dup.keys_of(values[:1], t) == near_dup.keys_of(values[1:], t)).all()]
    bits = np.zeros((2, near_dup.MAP // 32), np.uint32)
    sig = np.concatenate([values, bits], axis=1)
    node = np.arange(32, dtype=np.uint8).reshape(2, 16)
    found = [near_dup.pairs_of([near_dup.keys_of(values, t), None, node, sig, np.array([9, 9]), np.array([1, 2])], [np.array([0])], [np.array([1])]).num_rows for t in together]
    assert {4, 9, 30} <= set(together) and found == [1] + [0] * (len(together) - 1)


def test_bound_dismisses_no_link(monkeypatch):
    rng = np.random.default_rng(8)
    links = 0
    for _ in range(2000):
        a = rng.choice(3000, rng.integers(1, 400), replace=False).astype(np.uint64) << np.uint64(40)
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.9], rng.choice(3000, rng.integers(0, 30)).astype(np.uint64) << np.uint64(40)]))
        if not len(b):
            continue
        linked = 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b))
        links += linked
        x, y = (np.frombuffer(near_dup.bitmap(s), np.uint64)[None] for s in (a, b))
        assert near_dup.possible(np.array([len(a)]), np.array([len(b)]), x, y)[0] or not linked
    assert 500 < links < 1900


@pytest.mark.parametrize("parts", [4, 32])
def test_crowded_group_loses_no_class(spark, parts):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(3000):  # most pairs lie just under the threshold; a few are linked
        words = [f"w{k}" for k in range(200)]
        for k in rng.integers(0, 200, 9):
            words[k] = f"n{i}_{k}"
        rows.append((i, " ".join(words)))
    sets = [shingle_set(spaced_words(t), 2) for _, t in rows]
    number = {}
    held = [np.array(sorted(number.setdefault(x, len(number)) for x in s)) for s in sets]
    common = [x for x in range(len(number)) if x < 199 + 9 * 2 * 3000]
    matrix = np.zeros((3000, len(common)), np.float32)
    for i, h in enumerate(held):
        matrix[i, h] = 1
    shared = matrix[:, matrix.sum(axis=0) > 1]
    both = shared @ shared.T
    size = matrix.sum(axis=1)
    linked = np.argwhere(np.tril(100 * both >= 80 * (size[:, None] + size[None] - both), -1))
    label = list(range(3000))
    for _ in range(20):
        for a, b in linked:
            label[a] = label[b] = min(label[a], label[b])
    assert 10 <= len(linked) < 100
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        found = {r.doc_id: r.component_id for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert found == dict(enumerate(label))


def test_pairs_seven_errors_under_are_checked():
    x = np.zeros(near_dup.HASHES, np.uint32)
    y = (np.arange(near_dup.HASHES) >= 0.6 * near_dup.HASHES).astype(np.uint32)
    bits = bytes(near_dup.MAP // 8)
    nine = pa.array([9])
    batch = pa.RecordBatch.from_arrays([*(pa.array([v], pa.binary()) for v in (b"a", b"b", x.tobytes() + bits, y.tobytes() + bits)), nine, nine], ["a", "b", "sig_a", "sig_b", "n_a", "n_b"])
    assert sum(b.num_rows for b in near_dup.alike(iter([batch]))) == 1


def test_regions_stay_whole(spark):
    same_values = bytearray(4 * near_dup.HASHES + near_dup.MAP // 8)
    rows = [(k.to_bytes(16, "big"), 9, same_values, k) for k in range(60)]
    nodes = spark.createDataFrame(rows, "node binary, n_shingles long, sig binary, class long")
    assert near_dup.NearDuplicates(5).candidates(nodes).count() == 60 * 59 // 2


@pytest.mark.parametrize("part", [30, 200_000])
def test_components(spark, monkeypatch, part):
    from recordmill.llm import components as module

    monkeypatch.setattr(module, "PART", part)
    rng = np.random.default_rng(4)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (None, 1)]
    found = {r.node: r.label for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    label = {n: n for p in pairs for n in p if None not in p}
    for _ in range(100):
        for a, b in pairs:
            if a is not None:
                label[a] = label[b] = min(label[a], label[b])
    assert found == {n: x for n, x in label.items() if any(n in p and p[0] != p[1] for p in pairs if None not in p)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- language


def test_language_held_out(spark, sf_dir):
    found = language_id.predict(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    truth = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    held = found.join(truth, "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in found.collect())


def test_rare_language_is_predicted(spark):
    many = {"aa": "bread water house", "bb": "pane acqua casa", "cc": "brot wasser haus"}
    rows = [(f"{lang}{k}", " ".join(words.split() * 10), lang) for lang, words in many.items() for k in range(400)]
    rows += [(f"rare{k}", "zyxo qwuvy", "dd") for k in range(8)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id string, text string, lang string"))
    found = language_id.label(spark.createDataFrame([("zyxo qwuvy zyxo",), ("pane casa",)], "text string"), model).collect()
    assert [r.lang_pred for r in found] == ["dd", "bb"]


def test_letters_are_cut_out_of_runs():
    assert language_id.letters("km\u00b2 \u00bdx Ab1c \u00b2") == ["km", "x", "ab", "c"] and language_id.letters(None) == []


def test_language_brute_force(spark, sf_dir):
    """Predictions by n-grams counted one by one and the best of all paths by a plain recursion."""
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    learn = [(t, k) for d, t, k in rows if zlib.crc32(str(d).encode()) % 4 != 2 and k is not None and t is not None]
    langs = sorted({k for _, k in learn})

    def buckets(word):
        word = f"\x02{word}\x03"
        for n in range(1, language_id.ORDER + 1):
            for i in range(len(word) - n + 1):
                h = 0
                for j in range(n):  # each length goes on from the one before
                    h = (h * 0x100000001B3 + ord(word[i + j]) + j + 1) & (2**64 - 1)
                yield (int(language_id.mix(np.array([h], np.uint64))[0]) >> 20) & (language_id.BUCKETS - 1)

    grams = {k: Counter() for k in langs}
    seen = Counter((w, k) for t, k in learn for w in language_id.letters(t))
    held = {}
    for (w, k), n in seen.items():
        for b in held.setdefault(w, list(buckets(w))):
            grams[k][b] += n
    used = len({b for g in grams.values() for b in g})
    total = {k: sum(g.values()) for k, g in grams.items()}
    some = [(d, t) for d, t, _ in rows if t and len(t) < 600][:12]
    found = {r.doc_id: r for r in language_id.predict(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()}
    for d, t in some:
        words = language_id.letters(t)
        if not words:
            continue
        best = {k: (0.0, []) for k in langs}
        for i, w in enumerate(words):
            score = {k: sum(math.log((grams[k][b] + 0.5) / (total[k] + 0.5 * used)) for b in buckets(w)) for k in langs}
            best = {k: max(((v - (language_id.SWITCH if i and path[-1] != k else 0) + score[k], [*path, k]) for v, path in best.values()), key=lambda x: x[0]) if i else (score[k], [k]) for k in langs}
        path = max(best.values(), key=lambda x: x[0])[1]
        share = Counter()
        for w, k in zip(words, path):
            share[k] += len(w)
        top = min(langs, key=lambda k: (-share[k], k))
        assert found[d].lang_pred == top and abs(found[d].score - share[top] / sum(share.values())) < 1e-6


def test_language_odd(spark, odd, empty):
    found = {r.text: r.lang_pred for r in language_id.label(odd, language_id.fit(odd)).collect()}
    assert found[None] == found[""] == found["123 4,5. 6"] == found["😀😀"] == "und" and found["don't we'll I'M"] == "en"
    assert language_id.label(odd, None).where("lang_pred != 'und'").count() == 0
    assert language_id.predict(empty).count() == 0


def test_spans_of_mixed_text(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language_id.fit(rows)
    texts = {r.lang: " ".join(r.text.split()[:60]) for r in rows.where("n_chars between 800 and 3000").collect()}
    mixed = spark.createDataFrame([(1, texts["de"] + " " + texts["fr"])], "doc_id long, text string")
    spans = language_id.label(mixed, model).first()["spans"]
    assert [s["lang"] for s in spans] == ["de", "fr"]


@pytest.mark.parametrize("states", [1, 2, 5])
def test_best_paths(states):
    rng = np.random.default_rng(states)
    sizes = [0, 1, 5, 64, 65, 200]
    scores = (rng.normal(size=(sum(sizes), states)) * 3).astype(np.float32)
    found, at = language_id.best_paths(scores, sizes, 2.0), 0
    for n in sizes:
        e, path = scores[at : at + n].astype(float), found[at : at + n]
        at += n
        if n:
            best = e[0].copy()
            for t in range(1, n):
                best = np.maximum(best, best.max() - 2.0) + e[t]
            assert abs(best.max() - (e[np.arange(n), path].sum() - 2.0 * (path[1:] != path[:-1]).sum())) < 1e-2


# ---- vectors


def test_neighbours(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    vectors = {r.vec_id: np.array(r.embedding, np.float32).astype(float) for r in rows.collect()}
    ids = np.array(sorted(vectors))
    matrix = np.stack([vectors[i] for i in ids])
    found = defaultdict(list)
    for r in catalogue.op4_ann_search(spark, sf_dir).collect():
        found[r.query_id].append(r)
    assert set(found) == {i for i in ids if i % 20 == 0}
    recall = []
    for q, got in found.items():
        scores = matrix @ vectors[q]
        best = [i for i in ids[np.lexsort((ids, -scores))] if i != q][:20]
        got.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in got] == list(range(1, 21)) and all(abs(r.score - vectors[q] @ vectors[r.vec_id]) < 1e-9 for r in got)
        recall.append(len({r.vec_id for r in got} & set(best)) / 20)
    assert np.mean(recall) >= 0.9


def test_neighbours_over_shards_and_lengths(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD", 150)
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=8 if i % 3 else 5).astype(np.float32).tolist()) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = defaultdict(set)
    for r in ann.nearest(df, df.where("vec_id % 20 = 0")).collect():
        found[r.query_id].add(r.vec_id)
    vectors = {i: np.array(v, np.float32).astype(float) for i, v in rows}
    recall = []
    for q in range(0, 900, 20):
        scores = sorted(((-float(v @ vectors[q]), i) for i, v in vectors.items() if i != q and len(v) == len(vectors[q])))
        recall.append(len(found[q] & {i for _, i in scores[:20]}) / 20)
    assert np.mean(recall) >= 0.95 and min(recall) >= 0.7


def test_neighbours_odd(spark):
    rows = [(i, [1.0, 0.0]) for i in range(40)] + [(100, [0.5, 0.5]), (101, None), (102, [0.0, 0.0]), (103, [float("nan"), 1.0]), (104, [None, 1.0]), (105, [1.0, 0.0, 0.0]), (None, [1.0, 1.0]), (106, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    found = ann.nearest(df, df.where("vec_id in (0, 100, 101, 105)"), 5).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id, r.score) for r in found] == [(0, i, 1.0) for i in range(1, 6)] + [(100, i, 0.5) for i in range(5)]
    assert ann.nearest(df.where("false"), df.where("false")).count() == 0


def test_graph_recall():
    vectors = np.random.default_rng(6).normal(size=(3000, 16)).astype(np.float32)
    graph = ann.build(vectors)
    queries = np.concatenate([vectors[::50], np.zeros((60, 1), np.float32)], axis=1)
    best = np.argsort(-(vectors[::50] @ vectors.T), axis=1)[:, :20]
    found, _ = graph.seek(queries, ann.BEAM)
    assert np.mean([len(set(a) & set(b)) / 20 for a, b in zip(found, best)]) >= 0.9


# ---- scores


def test_language_model(spark, sf_dir, odd, empty):
    for df in (spark.read.parquet(f"{sf_dir}/documents.parquet"), odd):
        rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        count = Counter()
        for key, text in rows:
            if key is not None and zlib.crc32(str(key).encode()) % 7 != 2:
                count.update([*spaced_words(text), lm_score.END])
        total, distinct = sum(count.values()), len(count)
        wanted = []
        for key, text in rows:
            words = [*spaced_words(text), lm_score.END]
            wanted.append((str(key), len(words), sum(w in count for w in words), total, round(sum(math.log10((count[w] + 1) / (total + distinct + 1)) for w in words), 3)))
        found = lm_score.predict(df).collect()
        assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 3)) for r in found) == sorted(wanted)
        assert all(r.score < 0 for r in found)
        assert all((r.bits_per_byte is None) == (r.n_bytes == 0) for r in found)
    assert lm_score.predict(empty).count() == 0


def lm_model(df):
    counts = lm_score.materialize(lm_score.token_counts(df.where(~(lm_score.fold("doc_id", 7) == 2)), "text"), "counts")
    words = lm_score.vocabulary(counts)
    encoded = lm_score.encode(df, words, "doc_id", "text")
    fit = lm_score.Fit(words)
    return words, fit, fit.model(encoded, counts), encoded, counts


def brute_path(code, symbol):
    return [(int(s) >> 1, int(s) & 1) for s in code.steps[code.start[symbol] :][: code.size[symbol]]]


def brute_slot(shape, c, context, node):
    node = node * 0x9E3779B1 & 0xFFFFFFFF
    return ((context ^ node) * 0x85EBCA6B & 0xFFFFFFFF) >> (32 - shape.bits[c])


def brute_mix32(x):
    x = (x ^ x >> 16) * 0x7FEB352D & 0xFFFFFFFF
    x = (x ^ x >> 15) * 0x846CA68B & 0xFFFFFFFF
    return x ^ x >> 16


def brute_word_stream(words, text):
    """(symbol, contexts) of each token of one text."""
    number = {n: i for i, n in enumerate(words.names)}
    tokens = [*spaced_words(text), lm_score.END]
    marks = [number.get(lm_score.name_of(t)) for t in tokens]
    marks = [xxhash.xxh32_intdigest(t) | 1 << 31 if m is None else m for m, t in zip(marks, tokens)]
    before = int(lm_score.BEFORE)
    for i, m in enumerate(marks):
        one, two = (marks[i - k] if i >= k else before for k in (1, 2))
        one = brute_mix32(one)
        yield min(m, words.escape), (one, brute_mix32((one + two * 0x9E3779B1 + 1) & 0xFFFFFFFF))


def brute_byte_stream(token):
    codes, symbols = [], [*token, lm_score.CLOSE]
    for i, symbol in enumerate(symbols):
        value, found = 0, []
        for k in range(1, 5):
            value = (value * 521 + (symbols[i - k] if i >= k else lm_score.CLOSE) + 1) & 0xFFFFFFFF
            if k != 3:
                found.append(brute_mix32(value))
        codes.append((symbol, tuple(found)))
    return codes


def brute_counts(shape, streams):
    tables = [Counter() for _ in shape.bits]
    for symbol, contexts in streams:
        for node, bit in brute_path(shape.code, symbol):
            for c in range(len(tables)):
                tables[c][brute_slot(shape, c, contexts[c], node), bit] += 1
    return tables


def brute_score(predictor, tables, streams):
    """log10 of symbols, bit by bit, from counts that were made here."""
    shape, total = predictor.shape, 0.0
    depth = lambda n: min(7, math.ceil(math.log2(n + 1)))
    for symbol, contexts in streams:
        for node, bit in brute_path(shape.code, symbol):
            n = [[tables[c][brute_slot(shape, c, contexts[c], node), b] for b in (0, 1)] for c in range(len(tables))]
            n = [[round(v / max(1.0, max(pair) / mixing.TOP)) for v in pair] for pair in n]
            x = [min(8.0, max(-8.0, math.log((one + mixing.PRIOR) / (zero + mixing.PRIOR)))) for zero, one in n]
            x = [round((v + 8) * predictor.GRAIN) / predictor.GRAIN - 8 for v in x]
            gate = depth(sum(n[-2])) * 8 + depth(sum(n[-1]))
            s = sum(float(w[gate]) * v for w, v in zip(predictor.weights, [*x, mixing.CONSTANT]))
            at = int((min(mixing.LIMIT, max(-mixing.LIMIT, s)) + mixing.LIMIT) * mixing.UNIT) + mixing.LEVELS * depth(sum(n[-1]))
            total += float(predictor.logs[2 * at + bit])
    return total


def test_language_model_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(rng.choice(["the", "a", "cat", "dog", "sat", "on", "mat", f"rare{i}", "\u00e9t\u00e9", "x" * 70, f"{'y' * 70}{i}"], rng.integers(0, 40)))) for i in range(60)] + [(60, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    words, fit, model, encoded, counts = lm_model(df)
    learn = [(k, t) for k, t in rows if zlib.crc32(str(k).encode()) % 7 != 2]
    tables = brute_counts(fit.shapes["words"], (x for _, t in learn for x in brute_word_stream(words, t)))
    every = {w for _, t in learn for w in [*spaced_words(t), lm_score.END]}
    spelled = brute_counts(fit.shapes["bytes"], (x for w in every if lm_score.name_of(w) not in words.names for x in brute_byte_stream(w)))
    found = {r.doc_id: r for r in lm_score.score(encoded, counts, words, model, "doc_id").collect()}
    for key, text in rows:
        wanted = brute_score(model.words, tables, brute_word_stream(words, text))
        wanted += sum(brute_score(model.bytes, spelled, brute_byte_stream(w)) for w in spaced_words(text) if lm_score.name_of(w) not in words.names)
        size = len((text or "").encode())
        assert abs(found[key].score - wanted) < 1e-3 * max(1, abs(wanted))
        assert found[key].n_bytes == size and (size == 0) == (found[key].bits_per_byte is None)
        assert not size or abs(found[key].bits_per_byte + found[key].score * math.log2(10) / size) < 1e-9


def test_symbols_make_a_distribution(spark, sf_dir):
    words, _, model, _, _ = lm_model(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for mark in (7, 11):
        every = np.arange(words.escape + 1)
        contexts = [np.full(len(every), c, np.uint32) for c in (mark, mark * 77, mark * 99)]
        assert abs((10.0 ** model.words.scores(every, contexts[:2])).sum() - 1) < 1e-3
        assert abs((10.0 ** model.bytes.scores(np.arange(257), [c[:257] for c in contexts])).sum() - 1) < 1e-3


def test_mixing_learns_in_order_without_its_own_count():
    rng = np.random.default_rng(9)
    shape = mixing.Shape(mixing.Code(np.array([8.0, 4, 2, 1, 1])), (8, 10, 10))
    symbols = rng.integers(0, 5, 5000)
    contexts = [np.zeros(5000, np.uint32), np.roll(symbols, 1).astype(np.uint32), np.roll(symbols, 2).astype(np.uint32)]
    symbols = np.where(rng.random(5000) < 0.7, (contexts[1] + 1) % 5, symbols).astype(np.int64)
    tables = [np.zeros(2 << b, np.uint32) for b in shape.bits]
    mixing.tallied(shape, tables, symbols, contexts)
    tables = [mixing.packed(t) for t in tables]
    learner = mixing.Learner(shape, tables)
    learner.learn(symbols, contexts)
    assert learner.seen == shape.code.size[symbols].sum() == learner.outcomes.sum()
    made = mixing.Predictor(shape, tables, learner.weights, learner.outcomes)
    plain = np.log10(np.bincount(symbols)[symbols] / 5000).sum()
    assert made.scores(symbols, contexts).sum() > 0.8 * plain > made.scores(symbols, contexts).sum() * 3
    once = mixing.Learner(shape, [np.where(t > 0, np.uint32(1), np.uint32(0)) for t in tables])
    found, bit, _ = shape.decisions(symbols[:1], [c[:1] for c in contexts])
    once.step([f[:1] for f in found], np.zeros(1, np.int64))  # its only count is its own: nothing else is known
    assert once.outcomes[2 * mixing.level(np.array([0.0]), np.array([0]))[0]] == 1


def test_learning_reads_symbols_a_few_times_only():
    class Sizes:
        read = 0

        def __init__(self, sizes):
            self.sizes = sizes

        def __getitem__(self, symbols):
            self.read += len(symbols)
            return self.sizes[symbols]

    shape = mixing.Shape(mixing.Code(np.ones(64)), (8, 10))
    symbols = np.arange(60_000) % 64
    contexts = [np.zeros(60_000, np.uint32), symbols.astype(np.uint32)]
    shape.code.size = Sizes(shape.code.size)
    mixing.Learner(shape, [np.zeros(1 << b, np.uint16) for b in shape.bits]).learn(symbols, contexts)
    assert shape.code.size.read <= 2 * len(symbols)


def test_tokens_of_a_batch_are_spelled_once():
    class Bits:
        read = 0

        def scores(self, symbols, contexts):
            self.read += len(symbols)
            return symbols.astype(float)

    bits = Bits()
    tokens = [b"cat", b"cat", b"", b"dogs", b"cat", b"dogs"]
    found = lm_score.Model(None, bits, 0).spelled_column(pa.array(tokens, pa.binary()))
    assert found.tolist() == [sum(t) + lm_score.CLOSE for t in tokens] and bits.read == 4 + 1 + 5


def test_words_of_a_column():
    rows = ["", None, " A\x0bb\x1cC \n", "\x85x\u00a0Y\u2003z", "".join(f"x{chr(i)}Y" for i in range(256)), "  ", "last"]
    for column in (pa.array(rows), pa.array(["cut", *rows])[1:]):
        found, starts = spaced_column(column)
        found = found.to_pylist()
        assert [[w for w in found[a:b] if w] for a, b in zip(starts, starts[1:])] == [spaced_words(t) for t in rows]


def test_context_does_not_pass_texts():
    marks, first = np.arange(10, dtype=np.uint32), np.array([0, 1, 5])
    one, two = lm_score.word_contexts(marks, first)
    alone = [lm_score.word_contexts(marks[a:b], np.array([0])) for a, b in ((0, 1), (1, 5), (5, 10))]
    assert (one == np.concatenate([x[0] for x in alone])).all() and (two == np.concatenate([x[1] for x in alone])).all()


def test_codes_are_prefix_free():
    for weights in ([1.0], [3, 1], [5, 1, 1, 1, 9, 2, 2]):
        code = mixing.Code(np.array(weights, float))
        paths = [tuple(brute_path(code, i)) for i in range(len(weights))]
        bits = sorted("".join(str(b) for _, b in p) for p in paths)
        assert len(set(bits)) == len(weights) and not any(b.startswith(a) for a, b in zip(bits, bits[1:]))
        assert abs(sum(2.0 ** -len(p) for p in paths) - 1) < 1e-9


def brute_quality(model, text):
    """A text's score by sums over its tokens one by one and the network's units one by one."""
    found = quality.tokens(text)
    row = lambda t: xxhash.xxh3_64_intdigest(t) % quality.ROWS
    pooled = [0.0] * (2 * quality.DIM)
    for t in found:
        for k in range(quality.DIM):
            pooled[k] += float(quality.INDEX[row(t), k]) / len(found)
            pooled[quality.DIM + k] += float(model.context[row(t), k]) / len(found)
    x = [min(6.0, max(-6.0, (v - m) / s)) for v, m, s in zip([*pooled, *quality.shapes(text, found)], model.middle, model.scale)]
    hidden = [max(0.0, sum(v * w for v, w in zip(x, model.w1[:, j])) + model.b1[j]) for j in range(quality.HIDDEN)]
    z = (sum(h * w for h, w in zip(hidden, model.w2)) + model.b2) / model.temperature
    return 1 / (1 + math.exp(-min(30.0, max(-30.0, z))))


def test_quality_brute_force(spark, sf_dir):
    rows, labels = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "labels"))
    known = labels.where("quality IS NOT NULL").where(~(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1)).select("doc_id", "quality")
    sampled = quality.sample(rows, known, "quality", "doc_id", "text", 8000)
    truth = {r.doc_id: r.quality for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 != 1 and r.quality is not None}
    texts = {r.doc_id: r.text for r in rows.collect()}
    assert Counter(sampled) == Counter((texts[k], y) for k, y in truth.items() if k in texts)
    model = quality.fit(sampled)
    some = [(i, t) for i, t in enumerate(["", "Word", "two  words\n\nand a line", *[t for t in texts.values() if t and len(t) < 2500][:8]])]
    found = {r.doc_id: r.score for r in quality.score(spark.createDataFrame(some, "doc_id long, text string"), model).collect()}
    assert all(abs(found[i] - brute_quality(model, t)) < 1e-4 for i, t in some)


def brute_context(rows):
    """Context vectors of hashed rows by going over each token and its neighbours."""
    out = np.zeros((quality.ROWS, quality.DIM))
    for r in rows:
        for i, here in enumerate(r):
            for j in range(max(0, i - quality.REACH), min(len(r), i + quality.REACH + 1)):
                if j != i:
                    out[here] += quality.INDEX[r[j]]
    return out / np.maximum(1e-6, np.linalg.norm(out, axis=1, keepdims=True))


def test_context_vectors():
    rows = [np.random.default_rng(k).integers(0, 50, k) for k in (0, 1, 2, 30)]
    assert np.allclose(quality.contexts(rows), brute_context(rows), atol=1e-5)


def test_quality(spark, sf_dir, odd, empty):
    rows, labels = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "labels"))
    found = quality.predict(rows, labels)
    held = [r for r in found.join(labels, "doc_id").collect() if r.held_out]
    ones, zeros = [r.score for r in held if r.quality == 1], [r.score for r in held if r.quality == 0]
    assert np.mean([a > b for a in ones for b in zeros]) >= 0.9
    assert all(r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in found.collect())
    marked = odd.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    assert quality.predict(odd, marked).count() == odd.count()
    assert {r.score for r in quality.predict(odd, marked.where("false")).collect()} == {0.5}
    assert quality.predict(empty, marked).count() == 0


def test_bpe_encodes_little_text_at_once(spark):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    rows = [(i, f"word{i} and more " * 2000) for i in range(90)] + [(90, None), (91, "")]
    found = bpe.encode(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), path)
    library = bpe.codec(path).library
    assert bpe.ENCODED_BYTES <= 1 << 20 < sum(len(t or "") for _, t in rows)
    for r in found.collect():
        assert r.ids == library.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
