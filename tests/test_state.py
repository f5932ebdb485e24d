"""State over streams: a stream over files gives what the batch gives, repeated batches change nothing, old state asks again."""

import datetime
import random

import pytest

from docsieve.streaming import state

ALLOWED = {"none": ("uploaded",), "uploaded": ("parsing", "error"), "parsing": ("parsed", "error"), "error": ("uploaded",)}


def events(spark, n=400):
    r = random.Random(4)
    at = datetime.datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        at += datetime.timedelta(hours=r.randint(1, 60))
        rows.append((i, at, r.randint(0, 6), r.choice(["uploaded", "parsing", "parsed", "error"])))
    return spark.createDataFrame(rows, "event_id long, ts timestamp, who int, wanted string")


@pytest.fixture
def store(spark):
    spark.conf.set(*state.STORE)
    yield
    spark.conf.unset(state.STORE[0])


def files(spark, rows, path, parts=5):
    """The events in files, in order of time."""
    n = rows.count()
    for k in range(parts):
        rows.where(f"event_id >= {k * n // parts} AND event_id < {(k + 1) * n // parts}").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def collected(spark, stream, name, checkpoint):
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return {tuple(r) for r in spark.table(name).collect()}


def test_machine(spark, store, tmp_path):
    rows = events(spark)
    want = {tuple(r) for r in state.status_moves(rows, "who", ALLOWED).collect()}
    stream = state.status_moves(files(spark, rows, str(tmp_path / "in")), "who", ALLOWED)
    assert collected(spark, stream, "moves", str(tmp_path / "c")) == want
    assert len(want) == 400 and 20 < sum(r[3] for r in want) < 380


def test_questions_are_asked_again(spark, store, tmp_path):
    rows = events(spark)
    want = {tuple(r) for r in state.asked_again(rows, "who", 30).collect()}
    by_hand, last = set(), {}
    for r in rows.orderBy("ts").collect():
        ask = r["who"] not in last or r["ts"] - last[r["who"]] >= datetime.timedelta(days=30)
        by_hand.add((r["event_id"], r["who"], ask))
        if ask:
            last[r["who"]] = r["ts"]
    assert want == by_hand and sum(r[2] for r in want) > 60
    stream = state.asked_again(files(spark, rows, str(tmp_path / "in")), "who", 30)
    assert collected(spark, stream, "asked", str(tmp_path / "c")) == want


def test_repeated_batches_change_nothing(spark, tmp_path):
    rows, out = events(spark, 50), str(tmp_path / "out")
    stream = files(spark, rows, str(tmp_path / "in"), 3)
    state.append_stream(stream, out, str(tmp_path / "c")).awaitTermination()
    first = sorted(map(tuple, spark.read.parquet(out).select("event_id", "who").collect()))
    state.into_batches(out)(spark.read.parquet(f"{out}/batch=1"), 7)  # as a batch of its own it counts
    batch = spark.read.parquet(f"{out}/batch=1")
    again = spark.createDataFrame(batch.collect(), batch.schema)
    state.into_batches(out)(again, 7)  # the same one again doesn't
    assert spark.read.parquet(out).count() == 50 + again.count()
    assert first == sorted((r["event_id"], r["who"]) for r in rows.collect())
    # A restarted stream that has seen all of it adds nothing.
    state.append_stream(stream, out, str(tmp_path / "c")).awaitTermination()
    assert spark.read.parquet(out).count() == 50 + again.count()
    current = state.latest(spark.read.parquet(out), ["who"], "ts", "event_id").collect()
    assert {r["who"]: r["event_id"] for r in current} == {r["who"]: r["event_id"] for r in rows.orderBy("event_id").collect()}
