"""Conversation repair against an exhaustive search and a plain version over whole conversations."""

import hashlib
import re
import zlib
from collections import defaultdict
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordmill.llm import catalogue, conversations

SPACE = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def in_order(rows):
    """Role, text and fault of each turn of one conversation."""
    rows = [(c, t, " " if role is None else role, " " if text is None else text) for c, t, role, text in rows]
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).hexdigest()))
    seen, out = set(), []
    for _, _, role, text in rows:
        bare = text.rstrip(SPACE)
        out.append((role, text, "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""))
        seen.add((role, text))
    return rows, out


def cheapest(turns):
    """The least (cost, audit, lines) over states, forward; strings are compared whole."""
    steps = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
    best = {0: (0, "", ())}

    def insert(best):
        for _ in range(3):
            for s, (cost, audit, lines) in list(best.items()):
                for role in ("user", "assistant"):
                    if role[0] in steps[s]:
                        new, t = (cost + 2, audit + "I", (*lines, f"{role}:")), steps[s][role[0]]
                        best[t] = min(best.get(t, new), new)
        return best

    for role, text, fault in turns:
        best, before = {}, insert(best)
        for s, (cost, audit, lines) in before.items():
            options = [(s, (cost + 3, audit + "D", lines))]
            if fault not in ("blank", "duplicate"):
                late = fault == "truncated"
                if role[:1] in steps[s]:
                    options.append((steps[s][role[:1]], (cost + late, audit + "K", (*lines, f"{role}:{text}"))))
                options += [(steps[s][r[0]], (cost + 2 + late, audit + "R", (*lines, f"{r}:{text}"))) for r in ("user", "assistant") if r[0] in steps[s]]
            for t, new in options:
                best[t] = min(best.get(t, new), new)
    best = insert(best)
    return min(best[s] for s in (0, 3) if s in best)


def expected(rows, every):
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    out = []
    for conv in every:
        raw, turns = in_order(by[conv])
        known = [r[1] for r in raw if r[1] is not None]
        faults = [f for _, _, f in turns]
        cost, audit, lines = cheapest(turns)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


def told(found):
    return sorted((tuple(r) for r in found.select("conv_id", *conversations.REPORT).collect()), key=str)


def test_walk_is_the_least_of_all_edits():
    """All sequences of edits of short conversations, judged by the grammar as a pattern."""
    rng = np.random.default_rng(3)
    for _ in range(25):
        n = int(rng.integers(0, 4))
        initials = [str(x) for x in rng.choice(["s", "u", "a", "x"], n)]
        faults = [int(x) for x in rng.choice([0, 0, 1, 2, 3], n)]
        best = None
        inserts = [(), ("u",), ("a",), ("u", "a"), ("a", "u"), ("u", "u")]
        for kinds in product(["D", "K", "Ru", "Ra"], repeat=n):
            if any(f >= 2 and k != "D" for f, k in zip(faults, kinds)):
                continue
            for more in product(inserts, repeat=n + 1):
                roles, audit, cost = list(more[0]), "I" * len(more[0]), 2 * len(more[0])
                for x, f, k, m in zip(initials, faults, kinds, more[1:]):
                    cost += {"D": 3, "K": f, "Ru": 2 + f, "Ra": 2 + f}[k] + 2 * len(m)
                    roles += ([] if k == "D" else [x] if k == "K" else [k[1]]) + list(m)
                    audit += k[0] + "I" * len(m)
                if re.fullmatch("(s?(ua)+)?", "".join(roles)) and (best is None or (cost, audit) < best):
                    best = (cost, audit)
        ahead = conversations.costs(initials, faults, [1] * n, conversations.END)
        edits, _, cost = conversations.walk(initials, faults, [1] * n, ahead, 0, True)
        assert (cost, "".join(e for e, _, _ in edits)) == best and ahead[0][0] == cost


def odd_rows():
    rng = np.random.default_rng(5)
    texts = [None, "", " ", "\n\x0b", "One.", "Two?", "Three", "Four! ", "a\nb.", "…", "x" * 3000 + "."]
    roles = [None, "user", "assistant", "system", "tool", "", "User"]
    rows = [(int(c), None if rng.random() < 0.1 else int(t), roles[rng.choice(7, p=[0.04, 0.38, 0.38, 0.08, 0.04, 0.04, 0.04])], texts[int(rng.integers(len(texts)))]) for c in range(40) for t in rng.integers(0, 12, rng.integers(1, 14))]
    return rows + [(None, 1, "user", "Hi."), (None, 1, "user", "Hi."), (None, None, None, None)] + [(99, 3, "user", "same.")] * 50 + [(100, i, "user" if i % 2 else "assistant", f"t {i // 9}.") for i in range(300)]


@pytest.mark.parametrize("parts", [1, 3, 40])
@pytest.mark.parametrize("size", [2, 4096])
def test_odd_conversations(spark, monkeypatch, parts, size):
    monkeypatch.setattr(conversations, "ENTRIES", size)
    rows = odd_rows()
    df = spark.createDataFrame(rows, SCHEMA).withColumns({n: F.lit("clash") for n in ("conv", "cost", "audit", "shard", "n", "kind")})
    keep = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        assert told(conversations.report(df, df)) == sorted(expected(rows, {r[0] for r in rows}), key=str)
        broken = conversations.damage(df)
        assert told(conversations.report(broken, df)) == sorted(expected(damaged(rows), {r[0] for r in rows}), key=str)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", keep)


def test_turns_are_rebuilt(spark):
    rows = [(1, 0, "system", "S."), (1, 1, "assistant", "Hello."), (1, 2, "assistant", "And"), (1, 3, "user", "")]
    found = conversations.turns(conversations.repair(spark.createDataFrame(rows, SCHEMA))).orderBy("shard", "k", "place").collect()
    assert [(r.edit, r.role, r.text) for r in found] == [("K", "system", "S."), ("R", "user", "Hello."), ("K", "assistant", "And")]


def test_no_turns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert conversations.report(empty, empty).count() == 0
    assert told(conversations.report(empty, spark.createDataFrame([(7, 0, "user", "x")], SCHEMA))) == [(7, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert told(catalogue.op11_conversation_repair(spark, sf_dir)) == sorted(expected(damaged(rows), {r[0] for r in rows}), key=str)
