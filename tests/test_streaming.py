"""Streamed ingest equals the batch fold, whatever the cut into micro-batches."""

import random

import pytest
from pyspark.sql import functions as F

from obscat.operators.fold import fold, mark_late, sparse
from obscat.operators.golden import golden_record
from obscat.operators.state import source_health
from obscat.schema import OBSERVATION
from obscat.streaming import ingest, watch
from tests.test_fold import frame, observation, random_log

AS_OF = "2024-02-01 00:00:00"


def text(df):
    return sorted(str(r.asDict()) for r in df.select(*sorted(df.columns)).collect())


def cut(rows, parts):
    size = -(-len(rows) // parts)
    return [rows[i:i + size] for i in range(0, len(rows), size)]


def run(spark, folder, parts, prepare=sparse, **kwargs):
    """Ingest the parts one after the other, each as a micro-batch of its own."""
    store = None
    for part in parts:
        frame(spark, part).coalesce(1).write.mode("append").parquet(str(folder / "in"))
        stream = spark.readStream.schema(OBSERVATION).parquet(str(folder / "in"))
        store = ingest.run_ingest(stream, str(folder / "store"), str(folder / "cp"), prepare, buckets=4, **kwargs)
    return store


@pytest.mark.parametrize("seed", [21, 22])
def test_micro_batches_equal_one_batch(spark, tmp_path, seed):
    rows = random_log(seed, 120)
    log = sparse(frame(spark, rows))
    store = run(spark, tmp_path, cut(rows, 4), as_of=AS_OF)
    assert store.committed() == [0, 1, 2, 3]
    batch = fold(log)
    assert text(store.snapshot()) == text(batch)
    assert text(store.given("late").drop("epoch")) == text(mark_late(log).where("late").drop("late"))
    # items that nothing names any more are gone
    assert text(store.items()) == text(golden_record(batch, AS_OF))
    assert {r.kind for r in store.outcome().collect()} >= {"current", "late"}

    store.compact(2)
    assert text(store.snapshot()) == text(batch)
    assert text(store.items()) == text(golden_record(batch, AS_OF))


def test_a_batch_that_comes_again_changes_nothing(spark, tmp_path):
    rows = random_log(23, 60)
    store = run(spark, tmp_path, cut(rows, 3), as_of=AS_OF)
    before, items = text(store.snapshot()), text(store.items())
    again = spark.read.schema(ingest.OUT).parquet(str(tmp_path / "store/given/epoch=1"))
    ingest.write_epoch(store, again.where("false"), 1, AS_OF)
    assert text(store.snapshot()) == before and text(store.items()) == items


def test_readers_see_committed_epochs_only(spark, tmp_path):
    rows = random_log(24, 60)
    store = run(spark, tmp_path, cut(rows, 2), as_of=AS_OF)
    before, items = text(store.snapshot()), text(store.items())
    given = store.read("given").where("epoch = 1").drop("epoch")

    class Stopped(ingest.Store):
        """Fails before the last step of an epoch."""

        def commit(self, epoch):
            raise RuntimeError("lost")

    changed = given.withColumn("title", F.lit("between two writes"))
    with pytest.raises(RuntimeError):
        ingest.write_epoch(Stopped(spark, store.path, 4), changed, 2, AS_OF)
    assert text(store.snapshot()) == before and text(store.items()) == items
    # the same epoch, tried again
    ingest.write_epoch(store, changed, 2, AS_OF)
    assert store.committed() == [0, 1, 2]
    assert store.snapshot().where("title = 'between two writes'").count() > 0


def test_only_touched_buckets_are_opened(spark, tmp_path):
    rows = [observation(i, key=f"k{i}", entity_hash=f"item{i}") for i in range(40)]
    store = run(spark, tmp_path, cut(rows, 2), as_of=AS_OF)
    items = spark.createDataFrame([("item3",)], "entity_hash string")
    touched = store.touched(items, ["entity_hash"])
    assert len(touched) == 1
    found = store.rows_of(items, touched, 1)
    files = store.read("rows", touched).inputFiles()
    assert files and all(f"/bucket={touched[0]}/" in f for f in files)
    assert len(store.read("rows").inputFiles()) > len(files)
    assert [r.source_key for r in found.collect()] == ["k3"]


def test_the_cost_of_a_batch_does_not_grow(spark, tmp_path):
    """The operator gives out and holds rows of the keys of a batch, however many came before."""
    batches = [[observation(100 * b + i, key=f"k{b}-{i}", entity_hash=f"item{b}") for i in range(20)] for b in range(5)]
    store = run(spark, tmp_path, batches, as_of=AS_OF)
    per_epoch = {r.epoch: r.n for r in store.read("given").groupBy("epoch").agg(F.count("*").alias("n")).collect()}
    assert per_epoch == {b: 20 for b in range(5)}
    assert {r.epoch: r.n for r in store.read("items").groupBy("epoch").agg(F.count("*").alias("n")).collect()} == {b: 1 for b in range(5)}


def test_order_of_batches_is_the_order_of_arrival(spark, tmp_path):
    rng = random.Random(5)
    rows = [observation(i, at=rng.randrange(50), bits=["title"], title=f"t{i}") for i in range(30)]
    store = run(spark, tmp_path, cut(rows, 5))
    assert text(store.snapshot()) == text(fold(sparse(frame(spark, rows))))


def test_rejected_rows_are_kept_apart(spark, tmp_path):
    rows = [observation(1, key="a"), observation(2, key="")]
    store = run(spark, tmp_path, [rows], lambda b: (sparse(b.where("source_key <> ''")), b.where("source_key = ''")))
    assert store.snapshot().count() == 1
    assert [r.rejected.count('"source_key":""') for r in store.given("rejected").collect()] == [1]


def test_rows_without_a_clock(spark, tmp_path):
    rows = [observation(1, key="a"), observation(2, key="a"), observation(3, key="b")]
    log = frame(spark, rows).withColumn("fetched_at", F.when(F.col("arrival_key") != rows[1]["arrival_key"], F.col("fetched_at")))
    log.coalesce(1).write.parquet(str(tmp_path / "in"))
    store = ingest.run_ingest(spark.readStream.schema(OBSERVATION).parquet(str(tmp_path / "in")), str(tmp_path / "store"), str(tmp_path / "cp"), sparse, buckets=4)
    assert text(store.snapshot()) == text(fold(sparse(log)))


def test_duplicates_over_batches_and_null_keys(spark, tmp_path):
    parts = [[("a", 3, 1), ("a", 1, 2), (None, 5, 3)], [("a", 0, 4), ("b", 2, 5), (None, 1, 6)], [("c", 1, 7), ("b", 9, 8)]]
    out = None
    for part in parts:
        spark.createDataFrame(part, "k string, at int, n int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("k string, at int, n int").parquet(str(tmp_path / "in"))
        out = watch.run_dedupe(stream, str(tmp_path / "out"), str(tmp_path / "cp"), ["k"], "at", buckets=4)
    assert sorted((r.k or "", r.n) for r in out.collect()) == [("", 3), ("a", 2), ("b", 5), ("c", 7)]


def test_open_windows_are_given_out_and_batch_agrees(spark, tmp_path):
    rows = [("s", i, "failed" if i % 3 else "ok") for i in range(0, 400, 7)] + [("t", 399, "failed")]
    log = spark.createDataFrame(rows, "source string, second int, status string").select(
        "source", "status", F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, second)").alias("ts"))
    out = None
    for low, high in ((0, 100), (100, 250), (250, 1000)):
        part = log.where(f"ts >= TIMESTAMP_NTZ '2024-01-01 00:00:00' + INTERVAL {low} SECOND AND ts < TIMESTAMP_NTZ '2024-01-01 00:00:00' + INTERVAL {high} SECOND")
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        out = watch.run_health(spark.readStream.schema(log.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"), "10 seconds")
    batch = source_health(log.withColumn("ts", F.col("ts").cast("timestamp")))
    assert text(out) == text(batch) and out.where("source = 't'").count() == 1
    held = {(r.source, r.window_start): r.held for r in watch.held_back(out).collect()}
    assert any(held.values()) and not held[min(k for k in held if k[0] == "s")]


def test_shown_and_final_results(spark, tmp_path):
    rows = [observation(i, key=f"k{i}", entity_hash=f"{i:040x}", title=f"Some item {i}", quality=1080 if i % 2 else 720, bits=["title", "quality", "size", "popularity"]) for i in range(12)]
    store = None
    for part in cut(rows, 3):
        frame(spark, part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(OBSERVATION).parquet(str(tmp_path / "in"))
        store = watch.run_results(stream, str(tmp_path / "store"), str(tmp_path / "cp"), sparse, AS_OF, buckets=4, quality=1080)
    shown = watch.shown_results(store).collect()
    assert sorted(r.epoch for r in shown) == [0, 0, 1, 1, 2, 2] and all('"title":"Some item' in r.line for r in shown)
    from obscat.operators.state import override_summaries  # noqa: F401

    summaries = spark.createDataFrame([], "hash string, season_count long, file_count long, primary_source string, primary_season int, primary_offset int")
    final = watch.final_results(store, summaries, "some", sort="size", quality=1080).collect()
    assert [r.kind for r in final].count("done") == 1 and sorted(r.position for r in final if r.kind == "final") == [1, 2, 3, 4, 5, 6]


class Counted:
    """A state handle in memory that counts the calls for each key."""

    def __init__(self):
        self.held, self.calls = {}, {}

    def getMapState(self, *args):
        return self

    def getValue(self, key):
        self.calls[key] = self.calls.get(key, 0) + 1
        return self.held.get(key)

    def updateValue(self, key, value):
        self.calls[key] += 1
        self.held[key] = value


def test_keys_of_a_slot_come_together_and_cost_two_state_calls_each(spark):
    """One call takes many keys, also without a source; each is read and written once."""
    log = [observation(i, key=f"k{i % 7}", at=i) for i in range(35)] + [observation(40, key=None), observation(41, key="k0", at=0)]
    rows = [(3, *r) for r in sparse(frame(spark, log)).select(*OBSERVATION.names).collect()]
    fold_, state = ingest.KeyFold(), Counted()
    fold_.init(state)
    out = list(fold_.handleInputRows((3,), iter(rows[:20]), None)) + list(fold_.handleInputRows((3,), iter(rows[20:]), None))
    assert len(state.held) == 8 and {len(k) for k in state.held} == {2} and max(state.calls.values()) == 4  # two batches
    assert [r.source_key for r in out if r.kind == "late"] == ["k0"]
    last = {r.source_key: r.fetched_at for r in out if r.kind == "current"}
    assert len(last) == 8 and last["k6"] == max(r["fetched_at"] for r in log if r["source_key"] == "k6")
