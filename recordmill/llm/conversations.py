"""Conversation structure repair: the cheapest edits that give a well-formed turn order, and the turns rebuilt.

A conversation is well formed if its role initials are an optional system turn and then pairs of user and assistant.
Edits are Keep (0), Rerole to user or assistant (2), Delete (3; blank and repeated turns have to go), Insert an empty
user or assistant turn anywhere (2); a turn that is cut short and stays adds 1. A cost-to-go is computed backward over
turns and states of the grammar; the walk forward takes, of the edits that keep the cost least, the one whose letter
comes first (D, I, K, R), which gives the least audit string.

No conversation has to fit into a task. Equal turns are counted first; all turns are ranged and sorted, and written as
chunks of bounded size. Most conversations are one chunk. For the others each chunk has a matrix of costs from state to
state (minimum of sums, which is associative): parts of a range are combined backward to the costs that follow
them, each part is walked from all four states, and the states are combined forward; then all chunks are edited
side by side. Only the digest of a conversation's text, one hash of one string, is taken in one place: chunk after
chunk, never held whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordmill.llm.shared import discard, lean, materialize

#: ASCII white space; a text of nothing else is blank.
SPACE = " \t\n\x0b\x0c\r"
#: Entries and characters of text that a chunk has at most (one longer text is a chunk of its own).
ENTRIES, CHARS = 4096, 1 << 20

#: States: 0 at the start, 1 after system, 2 after user, 3 after assistant. The state that an inserted or reroled
#: turn leads to, and the role that it has.
START, NEXT, ROLE = 0, (2, 2, 3, 2), ("user", "user", "assistant", "user")
#: The state that a kept turn leads to, by state and initial; what isn't listed can't be kept.
KEPT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: What it costs to end in each state: open pairs are filled up, and system alone needs a pair.
END = (0, 4, 2, 0)
#: Faults of an entry. Only sound and cut ones can stay.
SOUND, CUT, BLANK, REPEATED = range(4)
LEGAL = {"su", "ua", "au"}


def costs(initials: list[str], faults: list[int], times: list[int], after: tuple) -> list[tuple]:
    """The costs to go from each state before each entry, and after the last."""
    out = [tuple(after)]
    for initial, fault, n in zip(reversed(initials), reversed(faults), reversed(times)):
        last = out[-1]
        if fault >= BLANK:
            out.append(tuple(3 * n + c for c in last))
            continue
        best = [min(3 + last[s], 2 + fault + last[NEXT[s]], fault + last[KEPT[s][initial]] if initial in KEPT[s] else 1 << 62) for s in range(4)]
        out.append(tuple(min(best[s], 2 + best[NEXT[s]], 4 + best[NEXT[NEXT[s]]]) for s in range(4)))
    return out[::-1]


def walk(initials: list[str], faults: list[int], times: list[int], ahead: list[tuple], state: int, last: bool) -> tuple[list[tuple[str, int, int]], int, int]:
    """The edits from a state on: (letter, entry, state before it); the state reached and what they cost.

    Turns inserted after the last entry belong to the end of the conversation; within it, to the entry after them.
    """
    edits, cost = [], 0
    for i, (initial, fault, n) in enumerate(zip(initials, faults, times)):
        here, then = ahead[i], ahead[i + 1]
        if fault >= BLANK:
            edits.append(("D", i, state))
            cost += 3 * n
            continue
        while True:
            left = here[state]
            if left == 3 + then[state]:
                edits.append(("D", i, state))
                cost += 3
            elif left == 2 + here[NEXT[state]]:
                edits.append(("I", i, state))
                cost, state = cost + 2, NEXT[state]
                continue
            elif initial in KEPT[state] and left == fault + then[KEPT[state][initial]]:
                edits.append(("K", i, state))
                cost, state = cost + fault, KEPT[state][initial]
            else:
                edits.append(("R", i, state))
                cost, state = cost + 2 + fault, NEXT[state]
            break
    while last and END[state]:
        edits.append(("I", len(times), state))
        cost, state = cost + 2, NEXT[state]
    return edits, state, cost


def matrix(initials: list[str], faults: list[int], times: list[int]) -> list[int]:
    """What it costs to pass the entries, from each state (row) to each state."""
    far = 1 << 40
    columns = [costs(initials, faults, times, tuple(0 if s == t else far for s in range(4)))[0] for t in range(4)]
    return [columns[t][s] for s in range(4) for t in range(4)]


def before(m: list[int], after: tuple | list[int]) -> list[int]:
    """Costs to go before a stretch with this matrix, from those after it; the least is taken as 0."""
    out = [min(m[4 * s + t] + after[t] for t in range(4)) for s in range(4)]
    return [c - min(out) for c in out]


def product(a: list[int], b: list[int]) -> list[int]:
    return [min(a[4 * s + k] + b[4 * k + t] for k in range(4)) for s in range(4) for t in range(4)]


def damage(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows damaged by crc32 of `conv:turn` modulo 20: 0 drops a row, 1 empties its text, 2 takes away `.`, `!` and `?`,
    3 repeats it, 4 makes it the user's. Null roles and texts are one space, as null keys are in what is hashed."""
    hashed = F.concat(F.coalesce(F.col(conv).cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col(turn).cast("string"), F.lit(" ")))
    kind = (F.crc32(hashed) % 20).cast("int")
    said = F.coalesce(F.col(text), F.lit(" "))
    said = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(said, "[.!?]", "")).otherwise(said)
    by = F.when(kind == 4, "user").otherwise(F.coalesce(F.col(role), F.lit(" ")))
    copies = F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return df.where(kind != 0).select(F.col(conv), F.col(turn), by.alias(role), said.alias(text), copies.alias("_copy")).drop("_copy")


def entries(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """For each turn with equal role and text: how often it is there, without its text; and for each role and text of a
    conversation, where it comes first, with its text. No join is needed: both meet when they are sorted."""
    trimmed = F.rtrim("text", F.lit(SPACE))
    rows = df.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text"))
    rows = rows.select("*", F.md5("text").alias("hash"))
    counts = rows.groupBy("conv", "turn", "role", "hash", (trimmed == "").alias("blank")).agg(F.count("*").alias("n"))
    firsts = rows.groupBy("conv", "role", "text", "hash").agg(F.min(F.struct(F.col("turn").isNotNull(), "turn"))["turn"].alias("turn"))
    cut = ~F.right(trimmed, F.lit(1)).isin(".", "!", "?")
    firsts = firsts.where(trimmed != "").select("conv", "turn", "role", "hash", F.lit(0).alias("kind"), F.lit(False).alias("blank"), cut.alias("cut"), F.lit(1).cast("long").alias("n"), "text")
    return firsts.unionByName(counts.select("conv", "turn", "role", "hash", F.lit(1).alias("kind"), "blank", F.lit(False).alias("cut"), "n", F.lit(None).cast("string").alias("text")))


class Part:
    """The chunks of one conversation in one range: filled entry by entry, taken from `done` as they are ready."""

    def __init__(self, conv, shard: int):
        self.conv, self.shard, self.k, self.done, self.whole = conv, shard, 0, [], None
        self.clear()

    def clear(self) -> None:
        self.initials, self.faults, self.times, self.roles, self.texts, self.turns, self.chars = [], [], [], [], [], [], 0

    def add(self, turn, role: str, fault: int, n: int, text: str | None) -> None:
        if len(self.times) >= ENTRIES or self.chars and self.chars + len(text or "") > CHARS:
            self.close(True)
        self.initials.append(role[:1])
        self.faults.append(fault)
        self.times.append(n)
        self.roles.append(role if fault <= CUT else None)
        self.texts.append(text if fault <= CUT else None)
        self.turns.append(turn)
        self.chars += len(text or "") + len(role)

    def close(self, joined: bool, last: bool = False) -> None:
        """End a chunk; joined: the conversation has, or may have, others; last: it ends the part."""
        known = [t for t in self.turns if t is not None]
        m = matrix(self.initials, self.faults, self.times) if joined else None
        if joined:
            self.whole = m if self.whole is None else product(self.whole, m)
        counts = [sum(n for f, n in zip(self.faults, self.times) if f == fault) for fault in (BLANK, REPEATED, CUT)]
        same = sum(n - 1 for x, n in zip(self.initials, self.times) if n > 1 and x + x not in LEGAL)
        illegal = same + sum(a + b not in LEGAL for a, b in zip(self.initials, self.initials[1:]))
        turns = (known[0], known[-1], len(set(known))) if known else (None, None, 0)
        self.done.append((self.conv, self.shard, self.k, joined, self.initials, self.faults, self.times, self.roles, self.texts, m, self.whole if last else None, *counts, illegal, *turns, self.initials[0], self.initials[-1]))
        self.k += 1
        self.clear()

    def end(self, joined: bool) -> list[tuple]:
        """The chunks that are left; joined: the conversation may go on in another range."""
        self.close(joined or self.k > 0, True)
        return self.take()

    def take(self) -> list[tuple]:
        out, self.done = self.done, []
        return out


#: The columns of a chunk after the conversation.
CHUNK = {
    "shard": "int", "k": "int", "joined": "boolean", "initials": "array<string>", "faults": "array<int>", "times": "array<long>", "roles": "array<string>", "texts": "array<string>", "matrix": "array<long>", "whole": "array<long>",
    "blank": "long", "duplicate": "long", "truncated": "long", "illegal": "long", "first_turn": "long", "last_turn": "long", "n_turns": "long", "first_initial": "string", "last_initial": "string",
}
ARROW = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}
ARROW |= {f"array<{k}>": pa.list_(v) for k, v in ARROW.items()}


def as_batch(rows: list[tuple], kinds: dict[str, str], key: pa.DataType) -> pa.RecordBatch:
    types = [key, *(ARROW[k] for k in kinds.values())]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["conv", *kinds])


def ddl(key: str, kinds: dict[str, str]) -> str:
    return ", ".join([f"conv {key}", *(f"{n} {k}" for n, k in kinds.items())])


def chunks(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """The turns of each conversation in order, as chunks."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = materialize(entries(df, conv, turn, role, text), "entries")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, part, first, waiting, key = TaskContext.get().partitionId(), None, True, None, pa.null()
        for batch in batches:
            key, ready = batch.schema.field("conv").type, []
            for conv_, turn_, role_, hash_, kind, blank, cut, n, text_ in zip(*(c.to_pylist() for c in batch.columns)):
                if part is None or conv_ != part.conv:
                    if part is not None:
                        ready += part.end(first)
                        first = False
                    part = Part(conv_, shard)
                if kind == 0:
                    waiting = (turn_, role_, hash_, cut, text_)
                    continue
                if waiting and waiting[:3] == (turn_, role_, hash_):
                    part.add(turn_, role_, CUT if waiting[3] else SOUND, 1, waiting[4])
                    n -= 1
                if n:
                    part.add(turn_, role_, BLANK if blank else REPEATED, n, None)
                waiting = None
                ready += part.take()
            if ready:
                yield as_batch(ready, CHUNK, key)
        if part is not None:
            yield as_batch(part.end(True), CHUNK, key)

    columns = ("conv", "turn", "role", "hash", "kind", "blank", "cut", "n", "text")
    ranged = found.repartitionByRange(parts, "conv", "turn", "role", "hash").sortWithinPartitions("conv", "turn", "role", "hash", "kind").select(*columns)
    cut = materialize(ranged.mapInArrow(lean(run), ddl(found.schema["conv"].dataType.simpleString(), CHUNK)), "chunks")
    discard(spark, found)
    return cut


def entry_states(found: DataFrame) -> DataFrame:
    """For each chunk of the joined conversations: the costs to go after it, and the state before it.

    Groups are the parts of a range, which is bounded, and for each conversation a row for each range.
    """
    kind = found.schema["conv"].dataType.simpleString()
    joined = found.where("joined")

    def back(rows: pd.DataFrame) -> pd.DataFrame:
        rows, after, out = rows.sort_values("shard", ascending=False), list(END), []
        for m in rows["whole"]:
            out.append(after)
            after = before(list(m), after)
        return pd.DataFrame({"conv": rows["conv"], "shard": rows["shard"], "after": out})

    def through(rows: pd.DataFrame) -> pd.DataFrame:
        """From each state before the part: the state before each chunk, and after the part."""
        rows = rows.sort_values("k")
        after, ends = list(rows["after"].iloc[0]), []
        for m in rows["matrix"][::-1]:
            ends.append(after)
            after = before(list(m), after)
        ends.reverse()
        states, starts = [0, 1, 2, 3], []
        for initials, faults, times, end in zip(rows["initials"], rows["faults"], rows["times"], ends):
            starts.append(states)
            one = list(initials), list(faults), list(times)
            ahead = costs(*one, tuple(end))
            reached = {s: walk(*one, ahead, s, False)[1] for s in set(states)}
            states = [reached[s] for s in states]
        leave = [None] * (len(starts) - 1) + [states]
        return pd.DataFrame({"conv": rows["conv"], "shard": rows["shard"], "k": rows["k"], "after": ends, "starts": starts, "leave": leave})

    def forth(rows: pd.DataFrame) -> pd.DataFrame:
        rows, state, out = rows.sort_values("shard"), START, []
        for leave in rows["leave"]:
            out.append(state)
            state = int(leave[state])
        return pd.DataFrame({"conv": rows["conv"], "shard": rows["shard"], "state": out, "last": [False] * (len(out) - 1) + [True]})

    after = joined.where("whole IS NOT NULL").select("conv", "shard", "whole").groupBy("conv").applyInPandas(back, f"conv {kind}, shard int, after array<long>")
    slim = joined.select("conv", "shard", "k", "initials", "faults", "times", "matrix")
    after = after.select(F.col("conv").alias("conv2"), F.col("shard").alias("shard2"), "after")
    slim = slim.join(after, F.col("conv").eqNullSafe(F.col("conv2")) & (F.col("shard") == F.col("shard2"))).drop("conv2", "shard2")
    walked = slim.groupBy("conv", "shard").applyInPandas(through, f"conv {kind}, shard int, k int, after array<long>, starts array<int>, leave array<int>")
    walked = materialize(walked, "walked")
    entered = walked.where("leave IS NOT NULL").groupBy("conv").applyInPandas(forth, f"conv {kind}, shard int, state int, last boolean")
    entered = entered.select(F.col("conv").alias("conv2"), F.col("shard").alias("shard2"), "state", "last")
    found = walked.join(entered, F.col("conv").eqNullSafe(F.col("conv2")) & (F.col("shard") == F.col("shard2")))
    return found.select(F.col("conv").alias("conv2"), F.col("shard").alias("shard2"), F.col("k").alias("k2"), "after", F.element_at("starts", F.col("state") + 1).alias("state"), (F.col("last") & F.col("leave").isNotNull()).alias("last"))


#: What the counts of a chunk are, and what it has after its edits.
COUNTS = [n for n in CHUNK if n not in ("initials", "faults", "times", "roles", "texts", "matrix", "whole")]
EDITED = {n: CHUNK[n] for n in COUNTS} | {"audit": "string", "cost": "long", "edits": "array<string>", "roles": "array<string>", "texts": "array<string>"}


def repair(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The repaired conversations as chunks, in order of (conv, shard, k): counts of faults, the audit letters, what the
    edits cost, and the turns that stay or come as arrays of edits, roles and texts. turns() gives a row for each turn.

    Turns are in order of their number, nulls first, and where it is the same by role and then by the md5 of the text. A
    null role or text is one space; a null conversation is one of its own; equal rows are repeats. An empty role fits
    nowhere. Other columns are left out, so their names can't clash. An empty table has no chunks.
    """
    found = chunks(df, conv, turn, role, text)
    kind = found.schema["conv"].dataType.simpleString()
    states = entry_states(found)
    alone = found.where("NOT joined").withColumns({"after": F.array(*(F.lit(c).cast("long") for c in END)), "state": F.lit(START), "last": F.lit(True)})
    some = found.where("joined").join(states, F.col("conv").eqNullSafe(F.col("conv2")) & (F.col("shard") == F.col("shard2")) & (F.col("k") == F.col("k2"))).drop("conv2", "shard2", "k2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            added = []
            for initials, faults, times, roles, texts, after, state, last in zip(*(batch.column(c).to_pylist() for c in ("initials", "faults", "times", "roles", "texts", "after", "state", "last"))):
                edits, _, cost = walk(initials, faults, times, costs(initials, faults, times, tuple(after)), state, last)
                audit = "".join(e * times[i] if e == "D" and faults[i] >= BLANK else e for e, i, _ in edits)
                stay = [(e, roles[i] if e == "K" else ROLE[s], "" if e == "I" else texts[i]) for e, i, s in edits if e != "D"]
                added.append((audit, cost, *([x[j] for x in stay] for j in range(3))))
            new = [pa.array(c, ARROW[EDITED[n]]) for n, c in zip(("audit", "cost", "edits", "roles", "texts"), zip(*added))] if added else [pa.array([], t) for t in (pa.string(), pa.int64(), *[pa.list_(pa.string())] * 3)]
            yield pa.RecordBatch.from_arrays([batch.column("conv"), *(batch.column(c) for c in COUNTS), *new], ["conv", *EDITED])

    return alone.unionByName(some).mapInArrow(lean(run), ddl(kind, EDITED))


def turns(repaired: DataFrame) -> DataFrame:
    """The repaired turns, in order of (conv, shard, k, place): edit, role, text."""
    each = F.posexplode(F.arrays_zip("edits", "roles", "texts")).alias("place", "turn")
    return repaired.select("conv", "shard", "k", each).select("conv", "shard", "k", "place", F.col("turn.edits").alias("edit"), F.col("turn.roles").alias("role"), F.col("turn.texts").alias("text"))


#: The columns of the report after the key.
REPORT = {"gaps": "long", "blank": "long", "duplicate": "long", "truncated": "long", "illegal": "long", "cost": "long", "audit": "string", "repaired_sha256": "string"}


def gaps(first: Column, last: Column, n: Column) -> Column:
    return F.coalesce(last - first + 1 - n, F.lit(0).cast("long"))


def report(df: DataFrame, every: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row for each conversation of `every`: what was found in and done to its turns in df, and the sha256 of its
    repaired `role:text` lines. A conversation without turns has zeros, an empty audit and the hash of an empty text."""
    repaired = materialize(repair(df, conv, turn, role, text), "repaired", "zstd")
    kind = repaired.schema["conv"].dataType.simpleString()
    body = F.array_join(F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit(":"), t)), "\n")
    alone = repaired.where("NOT joined").select("conv", gaps(F.col("first_turn"), F.col("last_turn"), F.col("n_turns")).alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(body, 256).alias("repaired_sha256"))
    columns = ["conv", *COUNTS[3:], "cost", "audit"]
    some = repaired.where("joined").select(*columns, "shard", "k", (F.size("roles") > 0).alias("some"), body.alias("body"))
    some = some.repartition("conv").sortWithinPartitions("conv", "shard", "k").select(*columns, "some", "body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Chunks one after another; of texts only the state of the hash is kept."""
        conv_, state, key = None, None, pa.null()

        def out() -> pa.RecordBatch:
            lack = state["last"] - state["first"] + 1 - state["turns"] if state["first"] is not None else 0
            return as_batch([(conv_, lack, *state["sums"], "".join(state["audit"]), state["hash"].hexdigest())], REPORT, key)

        for batch in batches:
            key = batch.schema.field("conv").type
            for i in range(batch.num_rows):
                x = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                if state is None or x["conv"] != conv_:
                    if state is not None:
                        yield out()
                    conv_, state = x["conv"], {"sums": [0] * 5, "audit": [], "hash": hashlib.sha256(), "some": False, "first": None, "last": None, "turns": 0, "initial": None}
                sums = [x[c] for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
                sums[3] += state["initial"] is not None and state["initial"] + x["first_initial"] not in LEGAL
                state["sums"] = [a + b for a, b in zip(state["sums"], sums)]
                state["audit"].append(x["audit"])
                state["initial"] = x["last_initial"]
                if x["first_turn"] is not None:
                    state["turns"] += x["n_turns"] - (state["last"] == x["first_turn"])
                    state["first"] = x["first_turn"] if state["first"] is None else state["first"]
                    state["last"] = x["last_turn"]
                if x["some"]:
                    state["hash"].update(("\n" if state["some"] else "").encode() + x["body"].encode())
                    state["some"] = True
        if state is not None:
            yield out()

    found = alone.unionByName(some.mapInArrow(lean(run), ddl(kind, REPORT)))
    ids = every.select(F.col(conv).alias("id")).distinct()
    filled = {c: F.coalesce(F.col(c), F.lit(0).cast("long")) for c in REPORT if REPORT[c] == "long"} | {"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256))}
    return ids.join(found, F.col("id").eqNullSafe(F.col("conv")), "left").select(F.col("id").alias(conv), *(c.alias(n) for n, c in filled.items()))
