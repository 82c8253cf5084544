"""Personal data by weak supervision: labelers vote on candidate spans, their reliabilities are estimated, and a
classifier trained on what the votes are worth decides.

Base spans are the matches of four fixed patterns that pass their checks; they always stay. Candidates are these, the
matches that fail, and looser forms (numbers joined to a neighbour, cards of 15 digits, phones without a plus, addresses
written with "at" and "dot", version 6 addresses). Five labelers vote yes, no or nothing on each: its shape, its
check (Luhn, ranges, digits), a gazetteer (issuers, calling codes, top-level domains, address blocks), the words before
it, and what it touches. Expectation-maximisation over the counts of vote patterns estimates for each kind how often
candidates are real and how each labeler votes on real and other ones. A logistic classifier for each kind,
over votes and the span's own form, is trained on those probabilities; loose candidates that it accepts are added where
they touch no base span. All work on texts and candidates is DataFrame operations; what reaches the driver is counts
of vote and form patterns, of which there are at most 4 * 3^5 * 12.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recordmill.llm.shared import materialize

KINDS = ("email", "ip", "card", "phone")
#: The base patterns, written so that no start is tried twice and no group recurses: a match is taken from the first
#: character of its run, or from where the last one ended; cards are the whole runs of 16 to 19 digits.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[\[(]at[\])] ?[A-Za-z0-9-]{1,63}+(?: ?(?:\.|[\[(]dot[\])]) ?[A-Za-z0-9-]{1,63}+){1,8}+",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])|(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9.])",
    "card": r"(?<![0-9])(?:[0-9]{4}[ -]?){3}[0-9]{4}(?![0-9])|(?<![0-9])3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5}(?![0-9])",
    "phone": r"(?<![0-9])\+?(?:[0-9]{1,3}[ .-])?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
}
#: A text without this has no match of either pattern, which saves looking for one.
NEEDED = {"email": r"@|[\[(]at[\])]", "ip": "[0-9]+[.:]", "card": "[0-9]{4}", "phone": "[0-9][ .)-]|\\+[0-9]"}
STRICT = {
    "email": r"^[A-Za-z0-9][A-Za-z0-9._%+-]*+@(?:[A-Za-z0-9][A-Za-z0-9-]*+\.)++[A-Za-z]{2,24}$",
    "ip": r"^(?:(?:0|[1-9][0-9]{0,2})(?:\.|$)){4}$|^[0-9A-Fa-f:]+$",
    "card": r"^[0-9]{15,19}$|^[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}$|^3[0-9]{3}([ -])[0-9]{6}\2[0-9]{5}$",
    "phone": r"^\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{2,4}([ .-]?[0-9]{2,4}){1,4}$|^\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}$",
}
#: Gazetteers, as patterns from the start of a span's digits, or of a domain's end: what its kind begins or ends with.
GAZETTEER = {
    "email": r"\.(?:com|org|net|edu|gov|int|info|biz|io|eu|de|fr|es|it|uk|us|nl|ch|at|be|pl|se|no|dk|fi|pt|ie|br|mx|ar|ca|au|nz|in|jp|cn|kr|ru)$",
    "ip": r"^(?:[1-9]|[1-9][0-9]|1[0-9][0-9]|2[01][0-9]|22[0-3])\.|:",
    "card": r"^(?:4|5[1-5]|2(?:22[1-9]|2[3-9]|[3-6]|7[01]|720)|3[47]|6011|65|35|62)",
    "phone": r"^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])",
}
#: Words that stand before personal data of a kind, and words that stand before other numbers.
WORDS = {
    "email": r"(?i)e-?mail|contact|write to|kontakt|correo|courriel|mailto",
    "ip": r"(?i)\bip\b|address|host|server|adresse|direcci|client|from",
    "card": r"(?i)card|visa|master|amex|credit|debit|karte|tarjeta|carte|payment",
    "phone": r"(?i)\btel|phone|call|mobile|\bfax|telefon|móvil|portable|whatsapp",
}
OTHERS = r"(?i)(?:token|password|secret|hash|sha|md5|key|version|license|licence|isbn|issn|doi|serial|order|invoice|figure|table|section|page)\W{0,4}\w{0,8}\W{0,4}$"
#: Characters of text before and after a span that labelers look at.
BEFORE, AFTER = 40, 8
#: Votes are 0 (no), 1 (nothing) and 2 (yes).
LABELERS = ("shape", "check", "listed", "context", "border")
#: How often each vote counts before any is seen; rounds of estimation and of training; what a candidate is added from.
PRIOR, ROUNDS, STEPS, ACCEPT = 1.0, 40, 60, 0.9


def gaps(text: Column, pattern: str, found: Column) -> Column:
    """The stretches between matches, each with the match that follows it (null after the last)."""
    pieces = F.split(text, pattern, -1)
    return F.zip_with(pieces, found, lambda p, m: F.struct(F.length(p).alias("gap"), F.right(p, F.lit(BEFORE)).alias("before"), F.left(p, F.lit(AFTER)).alias("after"), m.alias("match")))


def matches(df: DataFrame, key: str, text: str) -> DataFrame:
    """A row for each row of df: a number of its own, its key, and the matches of each kind and pattern."""
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.coalesce(text, F.lit("")).alias("text"))
    patterns = {f"{kind}_{name}": (kind, of[kind]) for kind in KINDS for name, of in (("base", BASE), ("loose", LOOSE))}
    rows = rows.withColumns({kind: F.col("text").rlike(NEEDED[kind]) for kind in KINDS})
    rows = rows.withColumns({n: F.when(F.col(kind), F.regexp_extract_all("text", F.lit(p), F.lit(0))) for n, (kind, p) in patterns.items()})
    rows = rows.withColumns({n: F.when(F.size(n) > 0, gaps(F.col("text"), p, F.col(n))) for n, (kind, p) in patterns.items()})
    every = F.array_compact(F.array(*(F.when(F.col(n).isNotNull(), F.struct(F.lit(KINDS.index(kind)).alias("kind"), F.lit(n.endswith("loose")).alias("loose"), F.col(n).alias("gaps"))) for n, (kind, _) in patterns.items())))
    return rows.select("row", "key", every.alias("found"))


def spans(found: DataFrame) -> DataFrame:
    """A row for each match: row, kind, loose, start, end, match, and the text before and after it."""
    lists = found.select("row", F.explode("found").alias("f")).select("row", "f.kind", "f.loose", F.posexplode("f.gaps").alias("pos", "g"))
    rows = lists.select("row", "kind", "loose", "pos", "g.*")
    order = W.partitionBy("row", "kind", "loose").orderBy("pos")  # the matches of one text
    end = F.sum(F.col("gap") + F.coalesce(F.length("match"), F.lit(0))).over(order.rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumns({"end": end, "after": F.lead("after").over(order)}).where("match IS NOT NULL")
    return rows.select("row", "kind", "loose", (F.col("end") - F.length("match")).alias("start"), "end", "match", "before", "after")


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether the digits, every second from the right doubled, sum up to a multiple of ten."""
    each = F.split(F.reverse(number), "(?!^)(?=.)")
    worth = F.zip_with(each, F.sequence(F.lit(0), F.size(each) - 1), lambda d, i: d.cast("int") * (1 + i % 2))
    return F.aggregate(worth, F.lit(0), lambda total, d: total + d - F.when(d > 9, 9).otherwise(0)) % 10 == 0


def passes(kind: Column, match: Column) -> Column:
    """Whether a match passes the check of its kind."""
    small = F.forall(F.split(match, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.substring(F.ltrim(p, F.lit("0")), 1, 3).try_cast("int"), F.lit(0)) <= 255))
    n = F.length(digits(match))
    return F.when(kind == 0, True).when(kind == 1, match.contains(":") | small).when(kind == 2, n.between(15, 19) & luhn(digits(match))).otherwise(n.between(8, 15))


def by_kind(patterns: dict[str, str], subject: Column) -> Column:
    return reduce(lambda c, k: c.when(F.col("kind") == KINDS.index(k), subject.rlike(patterns[k])), KINDS[1:], F.when(F.col("kind") == 0, subject.rlike(patterns["email"])))


def vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 2).when(no, 0).otherwise(1)


def voted(candidates: DataFrame) -> DataFrame:
    """Each candidate with the labelers' votes and its form: separators (none, some, many) and how it begins."""
    match, number = F.col("match"), digits(F.col("match"))
    listed = by_kind(GAZETTEER, F.when(F.col("kind").isin(2, 3), number).otherwise(F.lower(F.regexp_replace(match, r" ?[\[(]dot[\])] ?", "."))))
    left, right = F.right("before", F.lit(1)), F.left("after", F.lit(1))
    held = left.rlike(r"[\p{L}\p{N}=\"'/#_:&]") | right.rlike(r"[\p{L}\p{N}=\"'/#_@]")
    free = ((left == "") | left.rlike(r"[\s(<\[]")) & ((right == "") | right.rlike(r"[\s,.;!?)>\]*%]"))
    strict = by_kind(STRICT, match)
    votes = {
        "shape": vote(strict, ~strict & (F.col("kind") != 0)),
        "check": vote(F.col("kind").isin(1, 2, 3) & F.col("passes"), ~F.col("passes")),
        "listed": vote(listed, ~listed),
        "context": vote(by_kind(WORDS, F.col("before")), F.col("before").rlike(OTHERS)),
        "border": vote(free, held),
        "cuts": F.least(F.lit(2), F.floor(F.length(F.regexp_replace(match, r"[A-Za-z0-9]", "")) / 2)).cast("int"),
        "opens": F.when(match.startswith("+"), 1).when(match.startswith("("), 2).when(match.rlike("^[0-9]"), 3).otherwise(0),
    }
    return candidates.withColumns(votes)


FORM = ("cuts", "opens")


def estimate(patterns: list[tuple[tuple[int, ...], float]]) -> list[float]:
    """For each vote pattern with its count: how likely its candidates are real, by expectation-maximisation.

    Votes are taken as independent given the truth; it starts from the share of yes among the votes given.
    """
    real = []
    for votes, _ in patterns:
        yes, no = votes.count(2), votes.count(0)
        real.append((yes + 0.5) / (yes + no + 1))
    for _ in range(ROUNDS):
        table = [[[PRIOR] * 3 for _ in LABELERS] for _ in (0, 1)]
        total = [PRIOR, PRIOR]
        for (votes, n), p in zip(patterns, real):
            for truth, share in ((0, 1 - p), (1, p)):
                total[truth] += n * share
                for k, v in enumerate(votes):
                    table[truth][k][v] += n * share
        logs = [[[math.log(x / sum(row)) for x in row] for row in side] for side in table]
        odds = math.log(total[1] / total[0])
        # a labeler that says yes more often of others than of real ones has no say
        real = [1 / (1 + math.exp(-max(-30.0, min(30.0, odds + sum(d for k, v in enumerate(votes) if (d := logs[1][k][v] - logs[0][k][v]) * (v - 1) >= 0))))) for votes, _ in patterns]
    return real


def features(votes: tuple[int, ...], form: tuple[int, ...]) -> list[int]:
    """Which of the classifier's weights a pattern has: one for each vote and each value of its form, and a bias."""
    return [0, *(1 + 3 * k + v for k, v in enumerate(votes)), *(1 + 3 * len(LABELERS) + 4 * k + v for k, v in enumerate(form))]


WEIGHTS = 1 + 3 * len(LABELERS) + 4 * len(FORM)


def train(rows: list[tuple[tuple[int, ...], tuple[int, ...], float, float]]) -> list[float]:
    """Weights of a logistic classifier from (votes, form, count, how likely it is real), by steps scaled to each weight's own curvature."""
    weights, whole = [0.0] * WEIGHTS, sum(n for _, _, n, _ in rows) or 1.0
    at = [(features(v, f), n / whole, p) for v, f, n, p in rows]
    for _ in range(STEPS):
        slope, curve = [1e-3 * w for w in weights], [1e-3] * WEIGHTS
        for where, n, p in at:
            q = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(weights[i] for i in where)))))
            for i in where:
                slope[i] += n * (q - p)
                curve[i] += n * 0.25 * len(where)
        weights = [w - s / c for w, s, c in zip(weights, slope, curve)]
    return weights


def fit(candidates: DataFrame) -> dict[int, list[float]]:
    """The weights of each kind's classifier, from counts of vote and form patterns over all candidates."""
    counted = candidates.groupBy("kind", *LABELERS, *FORM).agg(F.count("*").alias("n")).collect()  # at most 4 * 3^5 * 12 rows
    out = {}
    for kind in range(len(KINDS)):
        own = sorted((tuple(r[c] for c in LABELERS), tuple(r[c] for c in FORM), r["n"]) for r in counted if r["kind"] == kind)
        by_votes: dict[tuple, float] = {}
        for votes, _, n in own:
            by_votes[votes] = by_votes.get(votes, 0) + n
        patterns = sorted(by_votes.items())
        real = dict(zip((v for v, _ in patterns), estimate(patterns)))
        out[kind] = train([(v, f, n, real[v]) for v, f, n in own])
    return out


def score(weights: dict[int, list[float]]) -> Column:
    """The probability that a candidate is real."""
    def one(w: list[float]) -> Column:
        terms = [F.element_at(F.array(*(F.lit(x) for x in w[1 + 3 * k : 4 + 3 * k])), F.col(c) + 1) for k, c in enumerate(LABELERS)]
        first = 1 + 3 * len(LABELERS)
        terms += [F.element_at(F.array(*(F.lit(x) for x in w[first + 4 * k : first + 4 * k + 4])), F.col(c) + 1) for k, c in enumerate(FORM)]
        return F.lit(1.0) / (1 + F.exp(-reduce(lambda a, b: a + b, terms, F.lit(w[0]))))

    return reduce(lambda c, k: c.when(F.col("kind") == k, one(weights[k])), list(weights)[1:], F.when(F.col("kind") == 0, one(weights[0])))


def judged(found: DataFrame) -> DataFrame:
    """The spans that stay, of the table of matches: row, kind, start, end, base (a base span), score (null for those)."""
    each = spans(found).withColumn("passes", passes(F.col("kind"), F.col("match")))
    each = materialize(voted(each.withColumn("base", ~F.col("loose") & F.col("passes"))).drop("before", "after", "match"), "candidates")
    text_ = W.partitionBy("row")
    base = F.when(F.col("base"), F.col("end"))
    ahead = F.when(F.col("base"), F.col("start"))
    each = each.withColumns({
        "covered": F.coalesce(F.max(base).over(text_.orderBy("start", F.desc("base"), "kind", "end").rowsBetween(W.unboundedPreceding, 0)) > F.col("start"), F.lit(False)),
        "reaches": F.coalesce(F.min(ahead).over(text_.orderBy(F.desc("start"), F.desc("base"), "kind", "end").rowsBetween(W.unboundedPreceding, -1)) < F.col("end"), F.lit(False)),
    })
    candidates = materialize(each.where(F.col("base") | ~F.col("loose") | ~(F.col("covered") | F.col("reaches"))), "judged")
    kept = candidates.withColumn("score", F.when(~F.col("base"), score(fit(candidates))))
    kept = kept.where(F.col("base") | (F.col("loose") & F.col("passes") & (F.col("score") >= ACCEPT)))
    # of added spans that overlap, the one that begins first stays; of those that begin together, the first kind's
    seen = F.max("end").over(W.partitionBy("row", "base").orderBy("start", "kind", "end").rowsBetween(W.unboundedPreceding, -1))
    kept = kept.withColumn("seen", seen).where(F.col("base") | F.col("seen").isNull() | (F.col("seen") <= F.col("start")))
    return kept.select("row", "kind", "start", "end", "base", "score")


def find(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of df: key, base (its base spans) and spans (all of them), arrays of (kind, start, end) in order of
    kind and start, in code points, the end exclusive.

    Base spans of different kinds may overlap. A null text is empty; null keys stay, repeated rows are each searched;
    other columns are left out, so their names can't clash. An empty table gives no rows.
    """
    found = materialize(matches(df, key, text), "matches")
    some = judged(found.where(F.size("found") > 0))
    span = F.struct("kind", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))
    lists = some.groupBy("row").agg(F.sort_array(F.collect_list(F.when(F.col("base"), span))).alias("base"), F.sort_array(F.collect_list(span)).alias("spans"))
    none = F.array().cast("array<struct<kind:int,start:int,end:int>>")
    return found.select("row", "key").join(lists, "row", "left").select(F.col("key").alias(key), *(F.coalesce(c, none).alias(c) for c in ("base", "spans")))


def report(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row: key, the number of base spans of each kind, their digest, and all spans as kind:start:end."""
    found = find(df, key, text)
    names = F.array(*map(F.lit, KINDS))

    def said(spans: str) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")

    def of_kind(k: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")

    counts = map(of_kind, range(len(KINDS)))
    return found.select(key, *counts, F.sha2(said("base"), 256).alias("base_sha256"), said("spans").alias("spans"))
