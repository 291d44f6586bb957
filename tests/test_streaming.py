"""Live feeds: sessions over micro-batches, and stats that are known from one run to the next."""

import random
from collections import Counter
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from quillstone.streaming import changes

START = datetime(2024, 1, 1)


def run(rows, place):
    query = rows.writeStream.format("parquet").outputMode("append").option("path", f"{place}/rows").option("checkpointLocation", f"{place}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    assert query.exception() is None


def test_sessions_of_many_batches_equal_the_log(spark, tmp_path):
    r = random.Random(8)
    at, rows = 0, []
    for k in range(300):
        at += r.choice([0, 1, 119, 120, 121, 600])
        rows.append((k, "a" if k % 3 else "b", START + timedelta(seconds=at)))
    log = spark.createDataFrame(rows, "event_id int, folder string, ts timestamp")
    want = set()
    for name in "ab":
        whole = changes.debounced(log.where(F.col("folder") == name), "ts", "event_id", 120).groupBy("batch").agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.count("*").alias("n"))
        want |= {(name, x["a"], x["b"], x["n"]) for x in whole.collect()}
    assert {tuple(x) for x in changes.sessions(log, "folder", "ts", 120, 0).collect()} == want

    # six micro-batches, each a restart; neighbours change places, a null time and a last event far ahead are added
    mixed = rows[:]
    for k in range(0, 300, 2):
        mixed[k], mixed[k + 1] = mixed[k + 1], mixed[k]
    mixed += [(300, "a", None), (301, "z", START + timedelta(days=30))]
    for k in range(0, len(mixed), 60):
        spark.createDataFrame(mixed[k : k + 60], log.schema).write.mode("append").parquet(f"{tmp_path}/feed")
        run(changes.sessions(spark.readStream.schema(log.schema).parquet(f"{tmp_path}/feed"), "folder", "ts", 120, 3600), tmp_path)
    got = [tuple(x) for x in spark.read.parquet(f"{tmp_path}/rows").select("folder", "first", "last", "n_events").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    # the session of z is open still, and an event behind the watermark opens none
    spark.createDataFrame([(302, "a", START)], log.schema).write.mode("append").parquet(f"{tmp_path}/feed")
    run(changes.sessions(spark.readStream.schema(log.schema).parquet(f"{tmp_path}/feed"), "folder", "ts", 120, 3600), tmp_path)
    assert spark.read.parquet(f"{tmp_path}/rows").count() == len(want)


def test_known_stats_are_passed_over(spark, tmp_path):
    schema = "path string, length long, modified timestamp, seen timestamp"
    second = lambda n: START + timedelta(seconds=n)
    batches = [
        # last stat of a batch counts, repeated rows are one, a null is a value, rows without path or time say nothing
        ([("a", 1, START, second(1)), ("a", 2, START, second(3)), ("a", 2, START, second(3)), ("b", None, None, second(2)), (None, 5, START, second(2)), ("n", 5, START, None)], {("a", 2), ("b", None)}),
        # nothing new; the same size with another change time is a change; an older stat than the known one is none
        ([("a", 2, START, second(10)), ("b", None, None, second(11)), ("c", 7, START, second(12))], {("c", 7)}),
        ([("c", 7, second(5), second(20)), ("a", 9, START, second(2))], {("c", 7)}),
        # far ahead: what was not seen for the time to live is forgotten by the next batch
        ([("d", 1, START, second(5000))], {("d", 1)}),
        ([("a", 2, START, second(5001)), ("d", 1, START, second(5002))], {("a", 2)}),
    ]
    before = Counter()
    for rows, want in batches:
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{tmp_path}/polls")
        run(changes.changed_stats(spark.readStream.schema(schema).parquet(f"{tmp_path}/polls"), 1000), tmp_path)
        found = spark.read.parquet(f"{tmp_path}/rows").collect()
        now = Counter((r["path"], r["length"]) for r in found)
        assert now - before == Counter(want) and not before - now
        before = now
    assert {r["modified"] for r in found if r["path"] == "b"} == {None}


def test_paths_share_states(spark, tmp_path):
    r, schema = random.Random(5), "path string, length long, modified timestamp, seen timestamp"
    known, want = {}, Counter()
    for poll in range(3):
        rows = [(f"p{r.randrange(3000)}", r.randrange(3), None if r.random() < 0.5 else START, START + timedelta(seconds=r.randrange(600) + 300 * poll)) for _ in range(6000)]
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{tmp_path}/polls")
        query = changes.changed_stats(spark.readStream.schema(schema).parquet(f"{tmp_path}/polls"), 86400).writeStream.format("parquet").option("path", f"{tmp_path}/rows").option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start()
        query.awaitTermination()
        last = {}
        for path, length, modified, seen in rows:
            stat = (seen, modified is not None, length)
            last[path] = max(last.get(path, stat), stat)
        for path, stat in last.items():
            if path not in known or known[path][0] <= stat[0]:
                want.update([(path, stat[2], stat[1], stat[0])] if known.get(path, stat[:1])[1:] != stat[1:] else [])
                known[path] = stat
    got = spark.read.parquet(f"{tmp_path}/rows").collect()
    assert Counter((x["path"], x["length"], x["modified"] is not None, x["seen"]) for x in got) == want
    # one call of the step serves a state, so that its calls do not grow with the paths
    assert len(known) > 2500 and query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 1024


def test_an_older_stat_does_not_keep_its_path_from_being_forgotten(spark, tmp_path):
    schema = "path string, length long, modified timestamp, seen timestamp"
    for at, path in [(100, "a"), (50, "a"), (5000, "d"), (5001, "a")]:
        spark.createDataFrame([(path, 1, START, START + timedelta(seconds=at))], schema).write.mode("append").parquet(f"{tmp_path}/polls")
        run(changes.changed_stats(spark.readStream.schema(schema).parquet(f"{tmp_path}/polls"), 1000), tmp_path)
    found = {(x["path"], x["seen"]) for x in spark.read.parquet(f"{tmp_path}/rows").collect()}
    assert found == {("a", START + timedelta(seconds=100)), ("d", START + timedelta(seconds=5000)), ("a", START + timedelta(seconds=5001))}


def test_a_hot_path_is_thinned_before_the_shuffle():
    import pandas as pd

    rows = pd.DataFrame({"path": ["hot"] * 9999 + ["b"], "length": range(10000), "modified_us": 0, "seen_us": [*range(9999), 4]})
    kept = pd.concat(changes.last_stats(iter([rows, rows[:0]])))
    assert sorted(zip(kept["path"], kept["length"], strict=True)) == [("b", 9999), ("hot", 9998)]
