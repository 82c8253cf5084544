"""Line dedup: runs of lines that occurred before are found by winnowed line hashes and deleted.

A window is a shortest run of lines with at least so many words. Winnowing takes from each window that starts at a
line the line with the least hash: such minima are the fingerprints, and two equal runs that are long enough have one
at the same place. Fingerprints are joined by value; those that stand at one place only end there. Around the places
that are left each match is extended both ways: every window ahead and back that holds the fingerprint's window is
compared, by two hashes of its lines, with the first place of its content, which reaches all lines of a match. A
line goes if and only if it lies in a run of that many words or more whose lines all occur, in this order, at an
earlier place (by key, then text, then line). The first place of every line stays. All of it is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recordmill.llm.shared import discard, materialize, with_hot

#: Words that a repeated run has at least.
MIN_WORDS = 50
#: White space at the ends of lines, and between words.
SPACE = " \t\r\f\x0b"


def words_of(line: Column) -> Column:
    return F.when(line == "", 0).otherwise(F.size(F.split(line, "[ \t\r\f\x0b]+")))


def fingerprint(line: Column) -> Column:
    """The hash that winnowing orders lines by; a window's content has another one besides."""
    return F.xxhash64(line)


def places(df: DataFrame, min_words: int, key: str, text: str) -> DataFrame:
    """A row for each line that isn't blank: its place (k1, k2, pos), hashes h1 and h2, the words before it and after
    it, and of the windows that start (ahead) and end (back) there, if any, the other end and the fingerprint's line.
    """
    lines = df.where(F.col(text).isNotNull()).select(F.col(key).alias("k1"), F.xxhash64(text).alias("k2"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    lines = lines.withColumn("line", F.btrim("line", F.lit(SPACE))).where("line != ''")
    lines = lines.select("k1", "k2", "pos", fingerprint(F.col("line")).alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), words_of(F.col("line")).cast("long").alias("n"))
    text_ = W.partitionBy("k1", "k2")
    lines = lines.withColumn("last_pos", F.lag("pos").over(text_.orderBy("pos"))).where("last_pos IS NULL OR last_pos != pos").drop("last_pos")  # rows with equal key and text
    lines = lines.withColumn("stop", F.sum("n").over(text_.orderBy("pos").rowsBetween(W.unboundedPreceding, 0)))
    lines = lines.withColumn("start", F.col("stop") - F.col("n")).drop("n")
    ahead, back = text_.orderBy("start").rangeBetween(0, min_words - 1), text_.orderBy("stop").rangeBetween(1 - min_words, 0)
    least = F.min(F.struct("h1", "pos")).over(ahead)
    enough = F.max("stop").over(ahead) - F.col("start") >= min_words
    lines = lines.withColumns({"ahead_to": F.when(enough, F.max("pos").over(ahead)), "print": F.when(enough, least)})
    enough = F.col("stop") - F.min("start").over(back) >= min_words
    return lines.withColumns({"back_to": F.when(enough, F.min("pos").over(back)), "back_print": F.when(enough, F.first("print").over(back))})


def repeated_prints(lines: DataFrame) -> DataFrame:
    """k1, k2, pos of the fingerprints whose value stands at more places than one."""
    picked = lines.where("print IS NOT NULL").select("k1", "k2", F.col("print.h1").alias("h1"), F.col("print.pos").alias("pos")).distinct()
    value = picked.groupBy("h1").agg(F.count("*").alias("rows"))
    some = materialize(value.where("rows > 1"), "prints")
    again = with_hot(picked, some, "h1", some.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]) if some.count() else picked.where("false")
    return again.select("k1", "k2", "pos")


def repeated_runs(df: DataFrame, min_words: int, key: str, text: str) -> DataFrame:
    """k1, k2 (the row's key and text hash) and the spans (from, to) of line numbers to delete, in order."""
    spark = df.sparkSession
    lines = materialize(places(df, min_words, key, text), "lines")
    hits = repeated_prints(lines).groupBy("k1", "k2").agg(F.collect_set("pos").alias("hits"))
    hits = materialize(hits.select(F.col("k1").alias("hit1"), F.col("k2").alias("hit2"), "hits"), "hits")
    near = lines.join(hits.hint("merge"), F.col("k1").eqNullSafe(F.col("hit1")) & (F.col("k2") == F.col("hit2"))).drop("hit1", "hit2")
    text_ = W.partitionBy("k1", "k2")
    frames = {"ahead": text_.orderBy("start").rangeBetween(0, min_words - 1), "back": text_.orderBy("stop").rangeBetween(1 - min_words, 0)}
    held = {"ahead": F.array_contains("hits", F.col("print.pos")), "back": F.array_contains("hits", F.col("back_print.pos"))}
    near = near.withColumns({f"{side}_{h}": F.collect_list(h).over(frame) for side, frame in frames.items() for h in ("h1", "h2")})
    ends = {"ahead": (F.col("pos"), F.col("ahead_to")), "back": (F.col("back_to"), F.col("pos"))}
    sides = [F.when(held[s], F.struct(ends[s][0].alias("first"), ends[s][1].alias("last"), F.xxhash64(f"{s}_h1").alias("w1"), F.xxhash64(F.lit(1), f"{s}_h2").alias("w2"))) for s in frames]
    windows = near.select("k1", "k2", F.explode(F.array_compact(F.array_distinct(F.array(*sides)))).alias("w"))
    again = materialize(windows.select("k1", "k2", "w.first", "w.last", F.struct("w.w1", "w.w2").alias("content")), "windows")
    place = F.struct("k1", "k2", "first")
    same = again.groupBy("content").agg(F.min(place).alias("origin"), F.max(place).alias("latest"), F.count("*").alias("rows")).where("origin != latest").drop("latest")
    later = with_hot(again, same, "content", again.count()).where(place != F.col("origin")).select("k1", "k2", "first", "last").distinct()
    seen = W.partitionBy("k1", "k2").orderBy("first", "last")
    later = later.withColumn("reach", F.max("last").over(seen.rowsBetween(W.unboundedPreceding, -1)))
    later = later.withColumn("run", F.sum(F.when(F.col("first") <= F.col("reach") + 1, 0).otherwise(1)).over(seen))
    runs = later.groupBy("k1", "k2", "run").agg(F.min("first").alias("from"), F.max("last").alias("to"))
    runs = materialize(runs.groupBy("k1", "k2").agg(F.sort_array(F.collect_list(F.struct("from", "to"))).alias("spans")), "spans")
    for table in (lines, hits, again):
        discard(spark, table)
    return runs


def line_dedup(df: DataFrame, min_words: int = MIN_WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows with the text cut, and n_lines and n_removed (of the text's lines).

    Lines are separated by line feeds and compared without white space at their ends. Blank lines have no words;
    those inside a deleted run go with it. A null text stays null with 0 lines, an empty text has one line.
    Rows that share key and text are one place and are cut alike; null keys come first in the order. A text
    whose lines all go becomes empty. Other columns stay, whatever their names; n_lines and n_removed of the input
    are replaced.
    """
    df = df.drop("n_lines", "n_removed")
    runs = repeated_runs(df, min_words, key, text).select("k1", "k2", "spans")
    rows = df.select(F.struct("*").alias("row"), F.col(key).alias("key"), F.col(text).alias("text"))
    # both tables grow with the input: the plan is the same at every size, not a broadcast where files are small
    cut = rows.join(runs.hint("merge"), F.col("key").eqNullSafe(F.col("k1")) & (F.xxhash64("text") == F.col("k2")), "left")
    lines = F.split("text", "\n")
    starts = F.concat(F.array(F.lit(0)), F.transform("spans", lambda s: s["to"] + 1))
    stops = F.concat(F.transform("spans", lambda s: s["from"]), F.array(F.size(lines)))
    kept = F.flatten(F.zip_with(starts, stops, lambda a, b: F.slice(lines, a + 1, b - a)))
    removed = F.aggregate("spans", F.lit(0), lambda n, s: n + s["to"] - s["from"] + 1)
    added = {
        text: F.when(F.col("spans").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")),
        "n_lines": F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long"),
        "n_removed": F.coalesce(removed, F.lit(0)).cast("long"),
    }
    out = [(added[c] if c == text else F.col("row").getField(c)).alias(c) for c in df.columns]
    return cut.select(*out, added["n_lines"].alias("n_lines"), added["n_removed"].alias("n_removed"))


#: The same by windows of the lines themselves, without hashes.
SQL = r"""
WITH d AS (SELECT DISTINCT doc_id, md5(text) AS k2, text FROM documents WHERE text IS NOT NULL
), l AS (
  SELECT doc_id, k2, CAST(pos - 1 AS BIGINT) AS pos, line, len(string_split_regex(line, '[ \t\r\f\v]+')) AS n
  FROM (SELECT doc_id, k2, generate_subscripts(x, 1) AS pos, trim(unnest(x), e' \t\r\f\v') AS line FROM (SELECT doc_id, k2, string_split(text, chr(10)) AS x FROM d)) WHERE line != ''
), s AS (SELECT *, sum(n) OVER (PARTITION BY doc_id, k2 ORDER BY pos) AS stop FROM l
), f AS (
  SELECT doc_id, k2, min(pos) OVER a AS p, max(pos) OVER a AS q, list(line) OVER a AS run, max(stop) OVER a - (stop - n) AS words FROM s
  WINDOW a AS (PARTITION BY doc_id, k2 ORDER BY stop - n RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING)
), b AS (
  SELECT doc_id, k2, min(pos) OVER a AS p, max(pos) OVER a AS q, list(line) OVER a AS run, stop - min(stop - n) OVER a AS words FROM s
  WINDOW a AS (PARTITION BY doc_id, k2 ORDER BY stop RANGE BETWEEN 49 PRECEDING AND CURRENT ROW)
), w AS (SELECT doc_id, k2, p, q, array_to_string(run, chr(10)) AS run FROM f WHERE words >= 50 UNION SELECT doc_id, k2, p, q, array_to_string(run, chr(10)) FROM b WHERE words >= 50
), later AS (
  SELECT doc_id, k2, p, q FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, k2, p) AS r FROM w) WHERE r > 1
), gone AS (SELECT DISTINCT doc_id, k2, unnest(range(p, q + 1)) AS pos FROM later
), every AS (SELECT doc_id, k2, generate_subscripts(x, 1) - 1 AS pos, unnest(x) AS line FROM (SELECT doc_id, k2, string_split(text, chr(10)) AS x FROM d)
), cut AS (
  SELECT e.doc_id, e.k2, count(*) AS n_lines, count(g.pos) AS n_removed, coalesce(string_agg(e.line, chr(10) ORDER BY e.pos) FILTER (WHERE g.pos IS NULL), '') AS text
  FROM every e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.k2 = g.k2 AND e.pos = g.pos GROUP BY ALL
)
SELECT o.doc_id, coalesce(c.n_lines, 0) AS n_lines, coalesce(c.n_removed, 0) AS n_removed, sha256(c.text) AS text_sha256
FROM documents o LEFT JOIN cut c ON o.doc_id = c.doc_id AND md5(o.text) = c.k2
"""
