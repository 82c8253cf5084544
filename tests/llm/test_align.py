"""Alignment of two tokenizers against a version by characters of bytes, and against token rows joined by their ends."""

import hashlib
from collections import Counter, defaultdict

import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from recordmill.llm import align, catalogue
from tests.llm.test_operators import ODD

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
MORE = ["a ▁b", "one<|endoftext|>two <s> </s>", "日本語の文章 と English mixed 文", "naïve café’s …", "x" * 300 + " y", "\t\ttabs  and   spaces \n\n", "١٢٣ ४५", "word " * 2000, "<0x41> <unk>"]


@pytest.fixture(scope="module")
def tokens():
    """(id, bytes) of each token of a text by the two libraries; None where the bytes aren't the text's."""
    library, model = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    library.encode_special_tokens = True
    shown = [b for b in range(256) if chr(b).isprintable() and b != 32 and b not in (0xAD,)]
    table = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}

    def find(text):
        if not text:
            return None
        a = [(i, bytes(table[c] for c in library.id_to_token(i))) for i in library.encode(" " + text, add_special_tokens=False).ids]
        b = [(i, bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode()) for i in model.encode(text) for p in [model.id_to_piece(i)]]
        want = (" " + text).encode()
        return (a, b) if b"".join(x for _, x in a) == want == b"".join(x for _, x in b) else None

    return find


def brute(rows, tokens):
    """Token of each byte, so that links are the distinct pairs of occurrences that share a byte."""
    found = []
    for key, text in rows:
        both = tokens(text)
        if both is None:
            found.append((key, None))
            continue
        owner, ends = [[], []], [set(), set()]
        for side in (0, 1):
            for k, (_, raw) in enumerate(both[side]):
                owner[side] += [k] * len(raw)
                ends[side].add(len(owner[side]))
        links = [(both[0][x][0], both[1][y][0]) for x, y in sorted(set(zip(*owner)))]
        groups, at, cuts = [([], [])], [0, 0], ends[0] & ends[1]
        for cut in sorted(cuts):
            group = []
            for side in (0, 1):
                ids = []
                while at[side] < len(both[side]) and owner[side].index(at[side]) < cut:
                    ids.append(str(both[side][at[side]][0]))
                    at[side] += 1
                group.append(",".join(ids))
            groups.append(group)
        found.append((key, (len(both[0]), len(both[1]), len(cuts), links, ";".join("|".join(g) for g in groups[1:]))))
    count = Counter(x for _, f in found if f for x in f[3])
    best = defaultdict(int)
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    out = []
    for key, f in found:
        if f is None:
            out.append((key, 0, 0, 0, 0, 0, 0, ""))
        else:
            out.append((key, *f[:3], len(f[3]), sum(count[x] == best[x[1]] for x in f[3]), sum(count[x] for x in f[3]), hashlib.sha256(f[4].encode()).hexdigest()))
    return out


def by_token_rows(spark, rows, tokens):
    """The relational form: token rows, running lengths, a full join of ends, running counts of cuts, links from the next
    token of each side at or after each end. Gives (row, n_a, n_b, n_groups, n_links)."""
    flat = [(r, side, pos, i, len(raw)) for r, (_, text) in enumerate(rows) if (both := tokens(text)) for side in (0, 1) for pos, (i, raw) in enumerate(both[side])]
    df = spark.createDataFrame(flat, "row long, side int, pos int, id long, size long")
    df = df.withColumn("end", F.sum("size").over(W.partitionBy("row", "side").orderBy("pos")))
    a = df.where("side = 0").select("row", "end", F.col("id").alias("a"))
    b = df.where("side = 1").select("row", "end", F.col("id").alias("b"))
    ends = a.join(b, ["row", "end"], "full")
    back = W.partitionBy("row").orderBy(F.desc("end")).rowsBetween(W.unboundedPreceding, 0)
    links = ends.select("row", F.sum((F.col("a").isNotNull() & F.col("b").isNotNull()).cast("int")).over(back).alias("group"), F.last("a", True).over(back).alias("la"), F.last("b", True).over(back).alias("lb"), "a", "b")
    return links.groupBy("row").agg(F.count("a").alias("n_a"), F.count("b").alias("n_b"), F.countDistinct("group").alias("n_groups"), F.count("la").alias("n_links"))


def told(found):
    return sorted(map(tuple, found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=str)


def test_odd_texts(spark, tokens, monkeypatch):
    odd = [t for t in [*ODD, *MORE] if t is None or len(t) < 12_000]
    rows = [(i, t) for i, t in enumerate(odd * 2)] + [(None, "null key"), (3, "a"), (3, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({n: F.lit("clash") for n in ("row", "pairs", "n_a", "best")})
    want = sorted(brute(rows, tokens), key=str)
    assert told(align.report(df, A, B)) == want
    monkeypatch.setattr(align, "PAIRS", 0)
    monkeypatch.setattr("recordmill.llm.shared.HOT_ROWS", 3)
    assert told(align.report(df, A, B)) == want
    sizes = Counter((r.n_a, r.n_b, r.n_groups, r.n_links) for r in by_token_rows(spark, rows, tokens).collect())
    assert sizes == Counter(r[1:5] for r in want if r[1])


def test_whole_table(spark, sf_dir, tokens):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    short = [(k, t) for k, t in rows if len(t or "") < 4000]
    df = spark.createDataFrame(short, "doc_id long, text string")
    assert told(align.report(df, A, B)) == sorted(brute(short, tokens), key=str)
    assert catalogue.op12_token_alignment(spark, sf_dir).count() == len(rows)


def test_empty(spark):
    assert align.report(spark.createDataFrame([], "doc_id long, text string"), A, B).count() == 0
