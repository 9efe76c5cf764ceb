"""Commits, retries, validators, the writer and streams."""

import pytest

from batchwright.cancellation import Cancellation
from batchwright.model import Check, Entity, Model
from batchwright.operators import flat
from batchwright.options import Retry
from batchwright.plans.index import with_index
from batchwright.sources.opaque import validated
from batchwright.sources.store import Store, VersionConflict, with_retry
from batchwright.streaming.micro_batches import mutate_stream
from batchwright.writer import BatchWriter

MODEL = Model.of(Entity("t", ("id",), checks=(Check("v > 0", "v"),)))


def test_commit_and_conflict(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    assert store.version("t") is None
    store.commit({"t": spark.createDataFrame([(1, 1)], "id long, v long")})
    first = store.version("t")
    writer = BatchWriter(store, MODEL, "t")
    result = writer.insert(spark.createDataFrame([(2, 1), (2, 2), (3, -1)], "id long, v long"))
    assert result.metrics().first()["success_count"] == 1
    assert sorted(r["id"] for r in store.read("t").collect()) == [1, 2]
    assert [r["id"] for r in store.read("t", first).collect()] == [1]
    with pytest.raises(VersionConflict):
        store.commit({"t": store.read("t")}, {"t": first})


def test_commits_are_whole_and_ordered(spark, tmp_path):
    import threading

    store = Store(spark, f"file://{tmp_path}")
    frame = lambda v: spark.createDataFrame([(1, v)], "id long, v long")
    store.commit({"t": frame(0), "u": frame(0)})
    seen, stop = [], threading.Event()

    def look():
        while not stop.is_set():
            versions = store.versions()
            seen.append((versions["t"], versions["u"]))

    reader = threading.Thread(target=look)
    reader.start()
    states = [store.versions()]
    for v in range(1, 4):
        store.commit({"t": frame(v), "u": frame(v)})
        states.append(store.versions())
    stop.set()
    reader.join()
    assert set(seen) <= {(s["t"], s["u"]) for s in states} and store.commits() == 4
    # A writer that died before its entry: files that no entry names.
    frame(9).write.parquet(f"file://{tmp_path}/t/v-lost")
    (tmp_path / "_log" / "_draft-lost").write_text("{")
    assert store.commits() == 4 and store.read("t").first()["v"] == 3


def test_commits_planned_on_one_state(spark, tmp_path, monkeypatch):
    """Another commit takes the number while this one is being written: refused if it changed what was read."""
    store = Store(spark, f"file://{tmp_path}")
    frame = spark.createDataFrame([(1, 1)], "id long, v long")
    store.commit({"t": frame, "u": frame})
    planned, enter = store.versions(), Store._enter
    rivals = [lambda: enter(store, 2, {**planned, "u": "v-rival"})]
    monkeypatch.setattr(Store, "_enter", lambda self, *a: (rivals.pop(0)() if rivals else None, enter(self, *a))[1])
    store.commit({"t": frame}, {"t": planned["t"]})  # the rival changed another table: this one comes after it
    assert store.commits() == 3 and store.versions()["u"] == "v-rival"
    rivals.append(lambda: enter(store, 4, {**store.versions(), "t": "v-rival"}))
    with pytest.raises(VersionConflict):
        store.commit({"u": frame}, {"t": store.versions()["t"]})  # the rival changed a table that was only read
    assert store.versions()["t"] == "v-rival"


def test_writer_starts_an_empty_store_and_can_be_stopped(spark, tmp_path):
    store, cancellation = Store(spark, f"file://{tmp_path}"), Cancellation(spark)
    rows = spark.createDataFrame([(2, 1), (2, 2), (3, -1)], "id long, v long")
    writer = BatchWriter(store, MODEL, "t", cancellation)
    first = writer.insert(rows)
    assert [r["id"] for r in store.read("t").collect()] == [2]
    summary = first.summary().first()
    assert summary["duration_seconds"] > 0 and (summary["round_trips"], summary["total_retries"], summary["success_count"]) == (1, 0, 1)
    cancellation.cancel()
    stopped = writer.insert(rows)
    assert stopped.metrics().first()["not_attempted_count"] == 3 and store.commits() == 1


def test_retry():
    calls, pauses = [], []

    def action():
        calls.append(1)
        if len(calls) < 3:
            raise TimeoutError("timed out")
        return "done"

    assert with_retry(action, Retry(initial_delay=1), pauses.append) == ("done", 2)
    assert pauses == [1, 2]
    with pytest.raises(ValueError):
        with_retry(lambda: int("x"), Retry(), pauses.append)


def test_validator_that_raises(spark):
    def validate(rows):
        if (rows["v"] % 50 == 7).any():
            raise ValueError("seven")

    found = validated(spark.range(200).selectExpr("id", "id AS v"), validate).where("reason is not null").collect()
    assert sorted(r["id"] for r in found) == [7, 57, 107, 157]
    assert {r["reason"] for r in found} == {"ValidationError"}


def test_validator_gets_rows_in_many_tasks(spark):
    """Also the rows of a single partition: a validator that refuses many is called for nearly each of them."""
    found = validated(spark.range(0, 400, 1, 1), lambda rows: None)
    assert found.rdd.getNumPartitions() >= 2 and sorted(r["id"] for r in found.collect()) == list(range(400))


def test_index_is_dense_and_ordered(spark):
    df = with_index(spark.range(1000).selectExpr("(id * 7919) % 1000 AS x").repartition(5), "x")
    assert [r["x"] for r in df.orderBy("__idx").collect()] == list(range(1000))
    assert df.agg({"__idx": "max"}).first()[0] == 999


def test_index_needs_no_shuffle_of_rows(spark):
    """Only the sizes of partitions are put together; windows over the rows once gathered a million of them and more."""
    df = with_index(spark.range(1000).selectExpr("(id * 7919) % 1000 AS x", "id AS y").repartition(5), "x")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan and sorted((r["x"], r["__idx"]) for r in df.collect()) == [(i, i) for i in range(1000)]


def test_stream(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    store.commit({"t": spark.createDataFrame([(1, 1)], "id long, v long")})
    spark.createDataFrame([(1, 1), (2, 5), (3, -5)], "id long, v long").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id long, v long").parquet(f"{tmp_path}/in")
    query = mutate_stream(stream, store, MODEL, "t", flat.insert, ("id",)).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(r["id"] for r in store.read("t").collect()) == [1, 2]


def test_written_tables_can_be_released(spark, tmp_path):
    import os

    from batchwright import session

    before = session._written.pop(spark.sparkContext.applicationId, [])
    table = session.materialize(spark.range(3).toDF("x"), "kept")
    path = session._written[spark.sparkContext.applicationId][0].removeprefix("file://")
    assert table.count() == 3 and os.path.isdir(path)
    assert session.release(spark) == 1 and not os.path.exists(path)
    session._written[spark.sparkContext.applicationId] = before
