"""Incremental ingest of the observation log.

A stateful operator keeps one row per source key: the newest clock it has seen and the folded
values. A micro-batch therefore costs its own rows and keys, whatever came before it. Of every key
the operator gives out its late rows, its current row and, where it moved to another item, a row that
takes it off the old one. Keys are grouped in ``SLOTS`` by their hash, each with a map of its keys: a key costs
one read and one write of the state, and rows are given out slot by slot.

The rows of items lie in ``BUCKETS`` hash buckets. The items of an epoch are computed again from the
buckets that it touches; the others are not opened. All tables of an epoch are written first and its
commit file last; readers only see epochs with a commit file, and a batch that comes again after
its commit is left out.

Layout below the store folder: ``given/epoch=N/kind=K`` (all that the operator gives out), ``rows/bucket=B/epoch=N``,
``items/bucket=B/epoch=N`` and the files ``commits/N``.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from obscat.operators.fold import ARRIVAL, CLOCK, KEY, last_per_key
from obscat.operators.golden import ITEM, golden_record
from obscat.schema import FIELD_BITS, MASKED_COLUMNS, OBSERVATION, RETAINING_STATES

# Raw stream to observations, or to (observations, rejected rows).
Prepare = Callable[[DataFrame], DataFrame | tuple[DataFrame, DataFrame]]

#: Buckets of a store; the number must stay the same while the store lives.
BUCKETS = 64
#: Groups of keys of the stateful operator; the number must stay the same while a checkpoint lives.
SLOTS = 8_192
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_NAMES = OBSERVATION.names
_AT = {name: i for i, name in enumerate(_NAMES)}
_MASKED = [(FIELD_BITS[f], [_AT[c] for c in cols]) for f, cols in MASKED_COLUMNS.items()]
_FOLLOW = [
    i for i, name in enumerate(_NAMES)
    if name not in {c for cols in MASKED_COLUMNS.values() for c in cols} | {"observed_fields", "details"}
]
_KNOWN_BITS = sum(FIELD_BITS.values())
#: Held per key, as one value: newest clock, whether its details are to be kept, and the folded row.
HELD = T.StructType([T.StructField("held", T.BinaryType())])
HELD_KEY = T.StructType([OBSERVATION[k] for k in KEY])
OUT = T.StructType([T.StructField("kind", T.StringType()), *OBSERVATION.fields, T.StructField("rejected", T.StringType())])


def _arrival(values: Sequence) -> tuple:
    arrival = values[_AT[ARRIVAL]]
    return (arrival is not None, arrival or "")

#: Tables that may have epochs without any row, and so without a file that holds their schema.
_SCHEMAS = {
    "given": T.StructType([*OUT.fields, T.StructField("epoch", T.IntegerType())]),
    "rows": T.StructType([T.StructField("kind", T.StringType()), *OBSERVATION.fields, T.StructField("bucket", T.IntegerType()), T.StructField("epoch", T.IntegerType())]),
}


class KeyFold(StatefulProcessor):
    """Masked fold of the keys of one slot, row by row in arrival order, as :mod:`obscat.operators.fold` defines it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.current = handle.getMapState("current", HELD_KEY, HELD)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        per_key: dict[tuple, list[tuple]] = {}
        for row in rows:
            values = tuple(row)[-len(_NAMES):]
            per_key.setdefault(tuple(values[_AT[k]] for k in KEY), []).append(values)
        for one, log in per_key.items():
            yield from self._key(one, log)

    def _key(self, key: tuple, log: list[tuple]) -> Iterator[Row]:
        held = self.current.getValue(key)
        newest, kept, folded = pickle.loads(held[0]) if held else (None, False, None)
        before = folded[_AT[ITEM]] if folded else None
        accepted = False
        for values in sorted(log, key=_arrival):
            clock = values[_AT[CLOCK]]
            if newest is not None and (clock is None or clock < newest):
                yield _out("late", values)
                continue
            newest = clock if clock is not None else newest
            folded, kept = _fold(folded, kept, values)
            accepted = True
        if not accepted:
            return
        self.current.updateValue(key, (pickle.dumps((newest, kept, folded), 5),))
        yield _out("current", folded)
        if before is not None and before != folded[_AT[ITEM]]:
            moved = [None] * len(_NAMES)
            for name, value in ((KEY[0], key[0]), (KEY[1], key[1]), (ITEM, before)):
                moved[_AT[name]] = value
            yield _out("moved", moved)

    def close(self) -> None:
        pass


_OUT_ROW = Row(*OUT.names)


def _out(kind: str, values: Sequence) -> Row:
    return _OUT_ROW(kind, *values, None)


def _fold(folded: list | None, kept: bool, row: Sequence) -> tuple[list, bool]:
    """The folded row after one accepted row, and whether a row has set its details for good."""
    mask, details = _AT["observed_fields"], _AT["details"]
    if folded is None:
        folded = [None] * len(_NAMES)
        folded[mask], folded[details] = 0, row[details] if row[details] is not None else "{}"
    for i in _FOLLOW:
        folded[i] = row[i]
    seen = row[mask] or 0
    for bit, columns in _MASKED:
        if seen & bit:
            for i in columns:
                folded[i] = row[i]
    folded[mask] |= seen & _KNOWN_BITS
    state = row[_AT["details_state"]]
    if state is not None and state not in RETAINING_STATES:
        folded[details], kept = row[details] if row[details] is not None else "{}", True
    return folded, kept


def folded_stream(stream: DataFrame, prepare: Prepare, show: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Rows of kind ``late``, ``current``, ``moved`` and ``rejected`` of a streamed log, and as ``shown`` what ``show`` leaves of it."""
    prepared = prepare(stream)
    obs, rejected = prepared if isinstance(prepared, tuple) else (prepared, None)
    obs = obs.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in OBSERVATION])
    slots = obs.select(bucket_of(KEY, SLOTS).alias("slot"), *_NAMES)
    out = slots.groupBy("slot").transformWithState(KeyFold(), outputStructType=OUT, outputMode="Append", timeMode="None")
    if show is not None:
        out = out.unionByName(show(obs).withColumn("kind", F.lit("shown")), allowMissingColumns=True)
    if rejected is None:
        return out
    bad = rejected.select(F.lit("rejected").alias("kind"), F.to_json(F.struct("*")).alias("rejected"))
    return out.unionByName(bad, allowMissingColumns=True)


def bucket_of(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


class Store:
    """Written tables of one ingest; only committed epochs are read."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path, buckets

    def _place(self, name: str):
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), place

    def committed(self) -> list[int]:
        """Numbers of the committed epochs."""
        files, place = self._place("commits")
        if not files.exists(place):
            return []
        return sorted(int(f.getPath().getName()) for f in files.listStatus(place) if f.getPath().getName().isdigit())

    def commit(self, epoch: int) -> None:
        """Make an epoch visible; a file is created as a whole or not at all."""
        files, place = self._place(f"commits/{epoch}")
        files.create(place, True).close()

    def read(self, table: str, buckets: Iterable[int] | None = None, also: int | None = None) -> DataFrame | None:
        """Committed rows of a table (and those of epoch ``also``), of some of its buckets; None where there is nothing."""
        epochs = {*self.committed(), *([] if also is None else [also])}
        places = [table] if buckets is None else [f"{table}/bucket={b}" for b in sorted(buckets)]
        found = [p for p in places if (lambda fs, at: fs.exists(at))(*self._place(p))]
        if not found or not epochs:
            return None
        reader = self.spark.read.option("basePath", f"{self.path}/{table}")
        if table in _SCHEMAS:
            reader = reader.schema(_SCHEMAS[table])
        rows = reader.parquet(*[f"{self.path}/{p}" for p in found])
        return rows.where(F.col("epoch").isin(*epochs))

    def write(self, table: str, epoch: int, rows: DataFrame, bucket_by: Sequence[str] = (), by: Sequence[str] = ()) -> None:
        """Write an epoch of a table again from scratch, in buckets by the hash of some columns or in folders by others."""
        if not bucket_by:
            rows.write.mode("overwrite").partitionBy(*by).parquet(f"{self.path}/{table}/epoch={epoch}")
            return
        rows = rows.withColumn("bucket", bucket_of(bucket_by, self.buckets)).withColumn("epoch", F.lit(epoch))
        # one task per bucket, several for one that a common item has made large
        out = rows.hint("rebalance", "bucket").write.partitionBy("bucket", "epoch")
        out.option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(f"{self.path}/{table}")

    def touched(self, rows: DataFrame, keys: Sequence[str]) -> list[int]:
        """Buckets of some rows."""
        return [r[0] for r in rows.select(bucket_of(keys, self.buckets).alias("b")).distinct().collect()]

    def given(self, kind: str) -> DataFrame:
        """What the operator gave out of one kind, with its epoch: ``late``, ``rejected``, ``shown``."""
        rows = self.read("given").where(F.col("kind") == kind).drop("kind")
        return rows.select("rejected", "epoch") if kind == "rejected" else rows.drop("rejected")

    def outcome(self) -> DataFrame:
        """Rows per epoch, kind and source."""
        counted = self.read("given").where("kind <> 'shown'")
        return counted.groupBy("epoch", "kind", "source").agg(F.count(F.lit(1)).alias("n_rows"))

    def snapshot(self) -> DataFrame:
        """Current row per source key."""
        rows = self.read("rows").where("kind = 'current'").drop("kind", "bucket")
        return last_per_key(rows, KEY, "epoch").drop("epoch", ARRIVAL)

    def items(self) -> DataFrame:
        """Current canonical row per item: the one of its latest epoch, unless nothing names it any more."""
        last = last_per_key(self.read("items"), [ITEM], "epoch")
        return last.where("NOT gone").drop("epoch", "bucket", "gone")

    def rows_of(self, items: DataFrame, buckets: Iterable[int], epoch: int) -> DataFrame:
        """Current rows of ``items``, from their buckets, up to an epoch that may still be uncommitted."""
        rows = self.read("rows", buckets, also=epoch).where(F.col("epoch") <= epoch)
        mine = rows.join(items, ITEM, "left_semi")
        last = last_per_key(mine, [ITEM, *KEY], "epoch")
        return last.where("kind = 'current'").drop("kind", "bucket", "epoch", ARRIVAL)

    def compact(self, through: int) -> None:
        """Keep only the last row per item and key of the epochs up to one, under that epoch's number.

        Readers may not run meanwhile: files of the older epochs go.
        """
        for table, key in (("rows", [ITEM, *KEY]), ("items", [ITEM])):
            rows = self.read(table)
            if rows is None:
                continue
            old = rows.where(F.col("epoch") <= through).drop("bucket")
            kept = last_per_key(old, key, "epoch").drop("epoch")
            kept.write.mode("overwrite").parquet(f"{self.path}/compact-{table}")
            self.write(table, through, self.spark.read.parquet(f"{self.path}/compact-{table}"), [ITEM])
            for bucket in range(self.buckets):
                files, place = self._place(f"{table}/bucket={bucket}")
                if files.exists(place):
                    for entry in files.listStatus(place):
                        name = entry.getPath().getName()
                        if name.startswith("epoch=") and int(name[6:]) < through:
                            files.delete(entry.getPath(), True)


def write_epoch(store: Store, out: DataFrame, epoch: int, as_of: str | None = None, **golden) -> None:
    """Write what the stateful operator gave out for one micro-batch, then commit it."""
    if epoch in store.committed():
        return
    store.write("given", epoch, out, by=["kind"])
    given = store.read("given", also=epoch).where(F.col("epoch") == epoch)
    changed = given.where("kind IN ('current', 'moved')").select("kind", *OBSERVATION.names)
    store.write("rows", epoch, changed, [ITEM])
    if as_of is not None:
        affected = changed.select(ITEM).distinct()
        buckets = store.touched(affected, [ITEM])
        if buckets:
            current = store.rows_of(affected, buckets, epoch)
            rows = golden_record(current, as_of, **golden)
            named = affected.join(rows, ITEM, "left").withColumn("gone", F.col("source").isNull())
            store.write("items", epoch, named, [ITEM])
    store.commit(epoch)


def run_available(out: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Give everything available on a stream to ``each``, batch by batch, and stop; the next call goes on from there."""
    spark = out.sparkSession
    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, ROCKSDB)  # keyed state needs a store that changes single keys; a query keeps the settings it starts with
    try:
        query = out.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(STATE_STORE, before)
    query.awaitTermination()


def run_ingest(
    stream: DataFrame, path: str, checkpoint: str, prepare: Prepare, as_of: str | None = None,
    freshness_minutes: int | None = None, show: Callable[[DataFrame], DataFrame] | None = None, buckets: int = BUCKETS,
) -> Store:
    """Ingest everything available on a stream and stop."""
    golden = {} if freshness_minutes is None else {"freshness_minutes": freshness_minutes}

    def each(out: DataFrame, epoch: int) -> None:
        write_epoch(Store(out.sparkSession, path, buckets), out, epoch, as_of, **golden)

    run_available(folded_stream(stream, prepare, show), checkpoint, each)
    return Store(stream.sparkSession, path, buckets)
