"""Streams over several batches: restarts, late rows, state that ends, batches that are run again."""

import datetime as dt
import random
import time

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from quire import streaming
from quire.streaming import Replay, events, keep_state, poll, polled, read_events, run_now, stateful


def replayed(rows, nth, parts):
    """All steps at once, one small file and so one batch each."""
    replay = Replay(rows.coalesce(1), nth, parts)
    for _ in replay.steps():
        time.sleep(0.05)
    return rows.sparkSession.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(replay.folder)


def brute(batches):
    last, out = {}, []
    for rows in batches:
        for task, at, key, meaning in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
            if task not in last or last[task] != meaning:
                out.append(key)
            last[task] = meaning
    return sorted(out)


def write(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    time.sleep(0.05)


EVENT = "task long, at long, key long, meaning string"


def changes(spark, path, files):
    return stateful.changes_only(read_events(spark, path, files), "task", "at", "key", F.col("meaning"))


@pytest.mark.parametrize("files", [1, 2])
def test_changes_over_batches_and_a_restart(spark, tmp_path, files):
    rng = random.Random(files)
    keys = iter(range(10**6))
    # one task has most of the rows, some have no number or no time, some come late
    batches = [[(rng.choice([7] * 20 + [1, 2, None, 10 + i]), rng.choice([None] + [rng.randint(0, 50) + 40 * i] * 9), next(keys), rng.choice(["a", "a", "b", None])) for _ in range(300)] for i in range(4)]
    path, folder = str(tmp_path / "events.parquet"), str(tmp_path / "stream")
    for rows in batches[:2]:
        write(spark, path, rows, EVENT)
    run_now(changes(spark, path, files), folder=folder)
    for rows in batches[2:]:
        write(spark, path, rows, EVENT)
    got = run_now(changes(spark, path, files), folder=folder)
    assert sorted(r.key for r in got.collect()) == brute([sum(batches[i : i + files], []) for i in range(0, 4, files)])


def test_a_batch_writes_the_state_of_its_tasks_only(spark, tmp_path):
    path = str(tmp_path / "events.parquet")
    write(spark, path, [(t, 1, t, "a") for t in range(500)], EVENT)
    write(spark, path, [(t, 2, 1000 + t, "b" if t < 3 else "a") for t in range(6)], EVENT)
    with streaming._state_store(spark):
        query = changes(spark, path, 1).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    updated = [p["stateOperators"][0]["numRowsUpdated"] for p in query.recentProgress if p["numInputRows"]]
    assert updated == [500, 3]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", "unset") == "unset"  # as it was


def test_newest_entries(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.choice(["x", "x", "x", "y", None]), rng.choice([None, rng.randrange(5000)]), i, f"m{i}") for i in range(20_000)]
    table = spark.createDataFrame(rows, "name string, at long, id long, message string")
    folder = str(tmp_path / "ring")
    query = keep_state(stateful.newest(replayed(table, F.col("id") % 3, 3), "name", "at", "id", ["at", "id", "message"], 50), folder)
    assert len([p for p in query.recentProgress if p["numInputRows"]]) == 3
    best = {n: sorted((r for r in rows if r[0] == n), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))[-50:] for n in ("x", "y", None)}
    assert sorted(map(tuple, stateful.recent(spark, folder).collect()), key=str) == sorted(sum(best.values(), []), key=str)
    since = best["x"][20][1]
    got = stateful.recent(spark, folder, since, 10).where("stream = 'x'").collect()
    assert sorted(r.key for r in got) == sorted(r[2] for r in [r for r in best["x"] if r[1] > since][-10:])


def test_keys_are_forgotten_behind_the_watermark(spark, tmp_path):
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    path = str(tmp_path / "e.parquet")
    for n in range(14):
        # 100 new keys a day, the key "again" every day, and repeats of the day's keys
        write(spark, path, [(f"{n}-{i % 100}", day(n)) for i in range(150)] + [("again", day(n))], "key string, at timestamp")
    folder = str(tmp_path / "once")
    query = keep_state(events.once_within(read_events(spark, path, 1), "key", "at", "2 days"), folder)
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress]
    assert max(kept) <= 505  # of 1401 keys
    got = run_now(events.once_within(read_events(spark, path, 1), "key", "at", "2 days"))
    counts = {r.key: r["count"] for r in got.groupBy("key").count().collect()}
    assert len(counts) == 1401 and all(n == 1 for k, n in counts.items() if k != "again") and 3 <= counts["again"] <= 5


def test_a_loop_that_was_stopped_goes_on(spark, tmp_path):
    table = spark.range(300).select("id", (F.col("id") % 7).alias("task"))
    stream, folder, seen = replayed(table, F.col("id") % 3, 3), str(tmp_path / "loop"), []

    def work(batch, number):
        seen.append(number)
        # stops in the middle of what it writes, once
        broken = number == 1 and seen.count(1) == 1
        return batch.withColumn("twice", F.when(F.lit(broken) & (F.col("id") > 200), F.raise_error(F.lit("stopped"))).otherwise(F.col("id") * 2).cast("long"))

    with pytest.raises(StreamingQueryException, match="stopped"):
        poll(stream, work, folder).awaitTermination()
    poll(stream, work, folder).awaitTermination()
    got = polled(spark, folder, "id long, task long, twice long, batch int").collect()
    assert seen == [0, 1, 1, 2] and sorted(r.id for r in got) == list(range(300)) and all(r.batch == r.id % 3 and r.twice == 2 * r.id for r in got)


def test_a_loop_with_a_trigger(spark, tmp_path):
    query = poll(replayed(spark.range(50), F.col("id") % 2, 2), lambda batch, _: batch, str(tmp_path / "loop"), seconds=0.2)
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert polled(spark, str(tmp_path / "loop"), "id long, batch int").count() == 50


def test_a_batch_judges_twice_by_what_it_saw_first(spark, tmp_path):
    tasks = spark.createDataFrame([(1, 10, 5), (1, 11, 5), (2, 20, 50), (3, 30, 0)], "source int, task int, started_at int")
    rows = spark.createDataFrame([(i, s, 9, "api-alive-only" if i % 6 == 3 else "x") for i, s in enumerate([1, 2, 3, 4, None, 1, 1, 2, 3, 3])], "id int, source int, at int, level string")
    folder, asked = str(tmp_path / "loop"), []

    def snapshot(number):
        asked.append(number)
        return tasks.where("task <> 11") if len(asked) > 1 else tasks

    work = events.attribution(snapshot, folder, "at", "level")
    failed = []

    def once_failing(batch, number):
        found = work(batch, number)
        if number == 0 and not failed:
            failed.append(found.count())
            raise RuntimeError("lost")
        return found

    stream = replayed(rows, F.when(F.col("id") < 5, 0).otherwise(1), 2)
    with pytest.raises(StreamingQueryException, match="lost"):
        poll(stream, once_failing, folder).awaitTermination()
    poll(stream, once_failing, folder).awaitTermination()
    got = {r.id: (r.attribution, r.task) for r in polled(spark, folder, "id int, attribution string, task int, batch int").collect()}
    none = ("unattributed", None)
    assert asked == [0, 1]
    assert got == {0: none, 1: ("stale", None), 2: ("attributed", 30), 3: none, 4: none, 5: ("attributed", 10), 6: ("attributed", 10), 7: ("stale", None), 8: ("attributed", 30), 9: ("api-noise", None)}


def test_a_start_that_comes_after_its_observations(spark, tmp_path):
    at = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(hours=n)
    seen, begun = str(tmp_path / "seen.parquet"), str(tmp_path / "begun.parquet")
    for n in range(11):
        write(spark, seen, [(100 * n + i, f"t{10 * n + i}", at(24 * n + 2)) for i in range(10)], "id int, task string, at timestamp")
        late = max(0, n - 1)  # starts come a batch later than what they start, every other one too late for its observation
        write(spark, begun, [(f"t{10 * late + i}", at(24 * late + (1 if i % 2 else 3))) for i in range(10)], "task string, begun timestamp")
    joined = events.attributed_late(read_events(spark, seen, 1), read_events(spark, begun, 1), "task", "at", "begun", "30 hours", "'5' HOUR")
    with streaming._state_store(spark):
        query = joined.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert {100 * n + i for n in range(10) for i in range(1, 10, 2)} == got
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(kept) <= 90  # 220 rows came


def test_compaction_in_a_loop(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, rng.choice([1, 1, 1, 2, None, 3 + i % 40]), rng.randrange(100)) for i in range(600)]
    table = spark.createDataFrame(rows, "id int, task int, at int")
    folder = str(tmp_path / "loop")
    poll(replayed(table, F.col("id") % 4, 4), events.compaction(folder, table, "task", "at", "id", 5), folder).awaitTermination()
    want = [r for t in {r[1] for r in rows} for r in sorted((r for r in rows if r[1] == t), key=lambda r: (r[2], r[0]))[-5:]]
    assert sorted(map(tuple, events.compacted(spark, folder, table, "task").collect()), key=str) == sorted(want, key=str)
