"""Personal data: base spans against the patterns as they are given, and what the labelers add."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from recordmill.llm import catalogue, pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def sound(kind, found):
    numbers = [int(c) for c in found if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "card":
        odd, even = numbers[::-1][::2], numbers[::-1][1::2]
        return 16 <= len(numbers) <= 19 and (sum(odd) + sum(2 * d - 9 * (d > 4) for d in even)) % 10 == 0
    return kind == "email" or 8 <= len(numbers) <= 15


def brute(rows):
    out = []
    for key, text in rows:
        spans = {k: [(m.start(), m.end()) for m in re.finditer(p, text or "") if sound(k, m[0])] for k, p in PLAIN.items()}
        said = ",".join(f"{k}:{a}:{b}" for k in PLAIN for a, b in spans[k])
        out.append((key, *(len(spans[k]) for k in PLAIN), hashlib.sha256(said.encode()).hexdigest()))
    return sorted(out, key=str)


def told(found):
    return sorted(map(tuple, found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256").collect()), key=str)


ODD = [
    None, "", " ", "a@b.c_d@e.f", "a@b.c..d@e.f", "a@b@c.d", "@x.y", "x@y", "é.ü@b.com 😀a.b@c-d.e😀", "1.2.3.4.5.6.7.8", "300.1.2.3.4", "0001.0255.3.4", "1.2.3", "999999999999999999999.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1111 27.1.2.3",
    "4111  1111 1111 1111", "4111 1111 1111 1112", "4111111111111111 4111111111111111", "-4111111111111111-", "4111 1111 1111 1111 1", "+1 (692) 555-7565", "+1 (826) 555-4081 190.137.223.204", "+1 2 3", "+12345678901234567", "+1 (((((((", "+1.2.3.4.5.6.7.8.9 +4",
    "z" * 20_000, "7" * 20_000, "1 2 " * 20_000, "a@" + "b." * 20_000 + "c", "+1" + " " * 50_000, "x@y.z " * 3000, "1." * 30_000,
]


def test_odd_texts(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "x@y.zz"), (3, "x@y.zz"), (3, "x@y.zz")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({n: F.lit("clash") for n in ("row", "kind", "found", "base", "spans", "key", "start")})
    assert told(pii.report(df)) == brute(rows)


def test_whole_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    found = catalogue.op13_personal_data(spark, sf_dir)
    assert told(found) == brute(rows)
    texts = dict(rows)
    for r in found.where("spans != ''").collect():  # base spans stay, and all are in order
        all_spans = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in r.spans.split(","))]
        base = [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, texts[r.doc_id]) if sound(k, m[0])]
        assert set(base) <= set(all_spans) and all_spans == sorted(all_spans, key=lambda s: (list(PLAIN).index(s[0]), s[1]))


def test_what_is_added(spark):
    rows = [(i, f"Text before, ann{i}@mail{i}.example.com and words, call +1 (2{i % 10}3) 555-{1000 + i} or so. Host 10.0.{i}.7 is up, card 4111 1111 1111 1111 was used.") for i in range(60)]
    rows += [(100 + i, f'release token = "{10**15 + i * 7919}ab" and order 12{i}-334-5566x, version 1.2.{i + 300}.4 of the table') for i in range(60)]
    rows += [(200, "card 4111111111111111 27.189.188.194 and more"), (201, "phone +1 (826) 555-4081 190.137.223.204 un"), (202, "write to ann (at) example (dot) com today"), (203, "nothing here but 12 words and 3.0")]
    found = {r.doc_id: r.spans for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert "card:5:21" in found[200].split(",") and "phone:6:23" in found[201].split(",") and "email:9:35" in found[202].split(",")
    assert found[203] == "" and all(found[100 + i] == ("card:17:33" if sound("card", str(10**15 + i * 7919)) else "") for i in range(60))


def test_estimation_finds_reliable_labelers():
    """Votes drawn from known reliabilities: the estimate tells real candidates from others, the noise has no say."""
    patterns = {}
    for truth, n in ((1, 600), (0, 400)):
        for i in range(n):
            right = 2 if truth else 0
            votes = tuple(right if (i * p) % 100 < q else 2 - right for p, q in ((7, 90), (11, 85), (13, 80))) + (1, 2 if i % 2 else 0)
            patterns.setdefault(votes, [0, 0])[truth] += 1
    rows = sorted(patterns.items())
    real = pii.estimate([(v, sum(n)) for v, n in rows])
    hit = sum(n[1] if p >= 0.5 else n[0] for (_, n), p in zip(rows, real))
    assert hit >= 930


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "no data")]])
def test_nothing_to_find(spark, rows):
    found = pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r.doc_id, r.n_email, r.spans) for r in found] == [(k, 0, "") for k, _ in rows]
