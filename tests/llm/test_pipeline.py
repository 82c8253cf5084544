"""The pipeline's stages, each against a brute-force version on what the one before kept."""

import tiktoken
import public_tokenizers as P
from pyspark.sql import functions as F

import corpus_pipeline
from recordmill.llm import bpe
from tests.llm.test_operators import brute_classes, brute_hits, brute_lines


def test_pipeline(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = sorted(map(tuple, docs.select("doc_id", "text").collect()))
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = docs.collect()
        if name != "byte_bpe":
            assert docs.columns == columns
        after = {r.doc_id: r for r in kept[name]}
        if name == "language_id":
            assert len(after) >= 0.97 * len(before)
        elif name == "line_dedup":
            texts = brute_lines(before)
            wanted = {key: texts[d] for d, (key, old) in enumerate(before) if texts[d] == old or texts[d].strip(" \t\r\n\f\x0b")}
            assert {k: r.text for k, r in after.items()} == wanted
        elif name == "near_dedup":
            assert set(after) == {key for key, _, first in brute_classes(before, 5) if key == first}
        elif name == "decontaminate":
            hits = {key: brute_hits(text, items) for key, text in before}
            assert set(after) == {k for k, (n, hit, _) in hits.items() if not (hit and 20 * hit >= n)}
        else:
            library = tiktoken.Encoding("x", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(P.path(corpus_pipeline.RANKS)), special_tokens={})
            assert {k: list(r.ids) for k, r in after.items()} == {key: library.encode_ordinary(text) for key, text in before}
            assert all(r.round_trip and r.n_tokens == len(r.ids) for r in after.values())
    assert sorted(map(str, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(str, kept["byte_bpe"]))


def test_stages_take_odd_rows(spark, sf_dir):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "some words of a text here", None, None, 5), (4, "some words of a text here", "en", "s", 5), (4, "some words of a text here", "en", "s", 5), (6, "x" * 3000, "en", "s", 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for table in (docs, docs.where("false")):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, sf_dir)
            assert out.count() <= table.count()
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir)
    assert sorted(r.doc_id for r in kept.where(F.col("text").startswith("some")).collect()) == [4]


def test_one_row_of_each_group(spark, sf_dir):
    clean = [f"{w} " + " ".join(f"{w}{k}" for k in range(40)) for w in ("river", "stone", "cloud", "ember", "maple", "quartz")]
    near = clean[4] + " at last"
    rows = [(None, clean[0]), (None, clean[1]), (7, clean[2]), (7, clean[3]), (3, clean[4]), (None, near), (None, clean[5]), (None, clean[5]), (7, clean[2]), (9, "")]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    found = corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir)
    wanted = [(None, clean[0]), (None, clean[1]), (7, clean[2]), (7, clean[3]), (3, clean[4]), (None, clean[5]), (9, "")]
    assert sorted((r.doc_id, r.text) for r in found.collect() if r.doc_id) + sorted(r.text for r in found.collect() if not r.doc_id) == sorted((k, t) for k, t in wanted if k) + sorted(t for k, t in wanted if not k)
