from pyspark.sql import functions as F

from recordmill.streaming import log


def test_stream_appends_each_batch_once(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    source = log.without_repeats(log.read(spark, f"{tmp_path}/in", events.schema, 1), "event_type", "user_id", "props")
    for _ in range(2):  # the second run finds its cursor at the end
        log.start(source, log.appender(f"{tmp_path}/out", "ts", "event_id"), f"{tmp_path}/cursor").awaitTermination()
    out = spark.read.parquet(f"{tmp_path}/out")
    wanted = events.dropDuplicates(["event_type", "user_id", "props"]).count()
    assert out.count() == wanted
    assert sorted(r.seq for r in out.select("seq").collect()) == list(range(1, wanted + 1))


def test_windowed_counts(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.write.parquet(f"{tmp_path}/in")
    counts = log.counts(log.read(spark, f"{tmp_path}/in", events.schema), late="40 days")
    query = counts.writeStream.format("memory").queryName("window_counts").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("window_counts").agg(F.sum("n")).first()[0] == events.count()


def test_first_of_repeats_over_batches(spark, tmp_path):
    """Repeats in a batch, in later ones, after a restart, of null keys, and beyond the batches that are kept."""
    schema = "event_id long, kind string, n long"
    batches = [[(1, "a", 1), (2, "a", 1), (3, None, None)], [(4, "a", 1), (5, None, None), (6, "", None)], [(7, "b", 2)], [(8, "a", 1), (9, "b", 2)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/log/batch={i}")
        source = log.read(spark, f"{tmp_path}/log/batch=*", spark.createDataFrame(rows, schema).schema)
        log.start(source, log.first_keeper(f"{tmp_path}", "event_id", "kind", "n", kept=2), f"{tmp_path}/cursor").awaitTermination()
    found = {r.event_id: (r["first"], r["repeat"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert found == {1: (1, False), 2: (1, True), 3: (3, False), 4: (1, True), 5: (3, True), 6: (6, False), 7: (7, False), 8: (8, False), 9: (7, True)}
    assert log.numbered(spark, f"{tmp_path}/firsts", 0, 2) != [] and log.numbered(spark, f"{tmp_path}/firsts", 0, 1) == []


def test_rules_of_a_table(spark):
    from recordmill.operators import events as E

    events = spark.createDataFrame([(1, "click", "u1", 5), (2, "click", "u2", 50), (3, None, "u1", 1), (4, "x", "y", None)], "event_id long, kind string, source string, v long")
    rules = spark.createDataFrame([(1, "click", "", ""), (2, "", "u1", ""), (3, "click", "u2", "v > 10"), (4, "click", "u2", "v > 99"), (5, "none", "", ""), (6, "", "", "v > 3")], "rule long, kind string, source string, filter string")
    found = E.rule_matches(events, rules, F.expr)
    assert {r.event_id: (r.n, r["first"]) for r in found.collect()} == {1: (3, 1), 2: (3, 1), 3: (1, 2)}
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in found._jdf.queryExecution().executedPlan().toString()


def test_cursors_are_merged_without_skipping(spark):
    """A target past the log's end isn't taken; a log that was cut starts over; else the further one stays."""
    from recordmill.operators import events as E

    cases = [((5, 9, 7), 5), ((5, 7, 9), 7), ((5, 3, 9), 5), ((5, 2, 4), 2), ((5, 5, 5), 5), ((0, 1, 0), 0)]
    df = spark.createDataFrame([c for c, _ in cases], "stored long, target long, disk long")
    assert [r[0] for r in df.select(E.merge_cursor(F.col("stored"), F.col("target"), F.col("disk"))).collect()] == [w for _, w in cases]


def test_log_by_numbers(spark, tmp_path):
    """Batches past the cursor, a restart without anything new, a log begun anew, and folders that are still being written."""
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    from recordmill.streaming import sequence

    path, fields = f"{tmp_path}/log", StructType([StructField("seq", LongType()), StructField("v", StringType())])

    def take():
        seen = []
        log.start(sequence.read(spark, path, fields), lambda batch, n: seen.extend(tuple(r) for r in batch.collect()), f"{tmp_path}/cursor").awaitTermination()
        return sorted(seen)

    def add(*values):
        return sequence.append(spark.createDataFrame([(v,) for v in values], "v string"), path, "v")

    assert take() == []  # no log yet
    assert add("b", "a", "a") == 3 and take() == [(1, "a"), (2, "a"), (3, "b")]
    assert take() == []
    assert add("c") == 4 and add(None, "d") == 6 and add() == 6
    (tmp_path / "log" / "_staging-x").mkdir()
    assert sorted(take(), key=lambda r: r[0]) == [(4, "c"), (5, None), (6, "d")]
    sequence.clear(spark, path)
    assert add("x", "y") == 2 and take() == [(1, "x"), (2, "y")]  # the cursor was past the end
    assert add("z") == 3 and take() == [(3, "z")]


def test_log_ranges_are_pruned(spark, tmp_path):
    """Only files whose folders can hold wanted numbers become tasks."""
    from pyspark.sql.types import LongType, StructField, StructType

    from recordmill.streaming import sequence

    for _ in range(3):
        sequence.append(spark.range(10).coalesce(1), f"{tmp_path}/log", "id")
    reader = sequence.SequenceReader(f"{tmp_path}/log", StructType([StructField("seq", LongType())]), "seq")
    assert reader.latestOffset() == {"seq": 30}
    folders = lambda low, high: {p.file.split("from=")[1].split("/")[0].lstrip("0") for p in reader.partitions({"seq": low}, {"seq": high})}
    assert folders(10, 30) == {"11", "21"} and folders(9, 10) == {"1"} and folders(20, 20) == set() and folders(40, 30) == {"1", "11", "21"}
    piece = [p for p in reader.partitions({"seq": 15}, {"seq": 17})]
    assert sorted(n for p in piece for b in reader.read(p) for n in b.column(0).to_pylist()) == [16, 17]


def test_due_units(spark):
    from recordmill.operators import events as E

    units = spark.createDataFrame([("fresh", 60, None), ("ruled", None, None), ("held", 60, 120), ("quiet", None, None), ("late", 60, None), ("early", 60, None)], "name string, every long, cap int")
    states = spark.sql("""SELECT * FROM VALUES ('held', 9, TIMESTAMP '2026-01-01 00:00:00', NULL), ('late', 0, NULL, TIMESTAMP '2026-01-01 00:00:00'), ('early', 0, NULL, TIMESTAMP '2026-01-01 00:00:50'), ('gone', 0, NULL, NULL) AS t(name, failures, last_end, last_scheduled)""")
    taken = spark.createDataFrame([("ruled", 2), ("held", 1), ("quiet", 0)], "name string, n long")
    found = E.due_units(units, states, taken, F.lit("2026-01-01 00:01:00").cast("timestamp"))
    assert {r.name: (r.trigger, r.wait) for r in found.collect()} == {"fresh": ("schedule", 0), "ruled": ("event", 0), "held": ("held", 60), "quiet": ("idle", 0), "late": ("schedule", 0), "early": ("idle", 0)}
