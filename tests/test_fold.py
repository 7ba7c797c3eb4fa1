"""The fold against a sequential fold of random logs, and the cases that are easy to miss."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from obscat.operators import fold as fo
from obscat.schema import FIELD_BITS, OBSERVATION, RETAINING_STATES

T0 = dt.datetime(2024, 1, 1)
MASKED = {
    "title": "title", "size_bytes": "size", "popularity": "popularity", "name": "names",
    "original_name": "names", "quality": "quality", "voices": "voices",
}


def observation(arrival, key="k", source="src_a", at=0, bits=(), **facts):
    row = {f.name: None for f in OBSERVATION}
    row.update(
        source=source, source_key=key, entity_hash="h1", source_url="https://x.example/1",
        fetched_at=T0 + dt.timedelta(minutes=at), arrival_key=f"{arrival:08d}",
        observed_fields=sum(FIELD_BITS[b] for b in bits), details_state="fetched",
    )
    row.update(facts)
    return row


def frame(spark, rows):
    names = [f.name for f in OBSERVATION]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], OBSERVATION)


def one_by_one(rows):
    """Fold in arrival order, one row at a time."""
    current = {}
    for row in sorted(rows, key=lambda r: r["arrival_key"]):
        key = (row["source"], row["source_key"])
        mask = row["observed_fields"] | 3
        old = current.get(key)
        if old is not None and row["fetched_at"] < old["fetched_at"]:
            continue
        new = dict(row)
        new["observed_fields"] = mask | (old["observed_fields"] if old else 0)
        for column, field in MASKED.items():
            if not mask & FIELD_BITS[field]:
                new[column] = old[column] if old else None
            elif column == "size_bytes" and row[column] is not None:
                new[column] = max(0, row[column])
        if old is not None and row["details_state"] in RETAINING_STATES:
            new["details"] = old["details"]
        elif new["details"] is None:
            new["details"] = "{}"
        current[key] = new
    return current


def random_log(seed, n=150):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        out.append(
            observation(
                i, key=f"k{rng.randrange(5)}", source=rng.choice(["src_a", "src_b"]),
                at=i // 3 + rng.randrange(-25, 25), bits=rng.sample(sorted(FIELD_BITS), rng.randrange(8)),
                entity_hash=f"h{rng.randrange(3)}", title=rng.choice([None, f"t{i}"]),
                size_bytes=rng.choice([None, i, -i]), popularity=rng.choice([None, i]),
                name=rng.choice([None, f"n{i}"]), original_name=rng.choice([None, f"o{i}"]),
                quality=rng.choice([None, i]), voices=rng.choice([None, [], [f"v{i}"]]),
                details_state=rng.choice(["fetched", "partial", "failed", "not_required", "budget_exhausted"]),
                details=rng.choice([None, f"d{i}"]),
            )
        )
    return out


def check(spark, rows):
    got = {(r.source, r.source_key): r.asDict() for r in fo.fold(fo.sparse(frame(spark, rows))).collect()}
    want = one_by_one(rows)
    assert got.keys() == want.keys()
    columns = [*MASKED, "entity_hash", "details_state", "fetched_at", "observed_fields", "details"]
    for key, row in want.items():
        assert {c: got[key][c] for c in columns} == {c: row[c] for c in columns}


@pytest.mark.parametrize("seed", range(3))
def test_random_logs(spark, seed):
    check(spark, random_log(seed))


@pytest.mark.parametrize("seed", range(3, 6))
def test_random_logs_in_many_slices(spark, many_slices, seed):
    check(spark, random_log(seed, 500))


def test_states_merge_in_any_grouping(spark):
    """Folding stretches and merging them equals folding the whole log."""
    rows = random_log(9)
    whole = fo.finish(fo.fold_state(fo.sparse(frame(spark, rows))))
    cut = fo.sparse(frame(spark, rows)).withColumn("part", F.floor(F.col("arrival_key").cast("int") / 20))
    parts = fo.fold_state(cut, carry=("part",))
    first = fo.merge_states(parts.where("part < 4"), "part").withColumn("part", F.lit(3).cast("long"))
    both = first.unionByName(parts.where("part >= 4"))
    merged = fo.finish(fo.merge_states(both, "part")).select(*whole.columns)
    assert sorted(map(str, whole.collect())) == sorted(map(str, merged.collect()))


def test_observed_null_clears_and_unobserved_keeps(spark):
    rows = [
        observation(1, at=1, bits=["title", "names"], title="t", name="n"),
        observation(2, at=2, bits=["names"], title="ignored", name=None),
    ]
    row = fo.fold(fo.sparse(frame(spark, rows))).first()
    assert (row["title"], row["name"]) == ("t", None)


def test_late_row_leaves_no_trace(spark):
    rows = [
        observation(1, at=5, bits=["title"], title="new"),
        observation(2, at=1, bits=["title", "quality"], title="old", quality=720),
    ]
    folded = fo.fold(fo.sparse(frame(spark, rows))).first()
    assert (folded["title"], folded["quality"]) == ("new", None)
    assert folded["observed_fields"] == FIELD_BITS["title"] | 3


def test_equal_clock_is_accepted(spark):
    rows = [observation(1, at=5, bits=["title"], title="a"), observation(2, at=5, bits=["title"], title="b")]
    assert fo.fold(fo.sparse(frame(spark, rows))).first()["title"] == "b"


def test_unknown_bits_and_missing_clocks_fold_alike_in_any_slices(spark, many_slices):
    rows = [observation(i, at=i % 4, bits=["title"], title=f"t{i}") for i in range(40)]
    rows += [observation(100 + i, key="n", at=1, bits=["title"], title=f"n{i}") for i in range(3)]
    log = frame(spark, rows)
    gone = F.when(F.col("arrival_key") >= "00000102", F.lit(None).cast("timestamp_ntz")).otherwise(F.col("fetched_at"))
    log = log.withColumn("observed_fields", F.col("observed_fields").bitwiseOR(F.lit(1 << 20))).withColumn("fetched_at", gone)
    columns = fo.fold(fo.sparse(log)).columns
    folded = fo.fold(fo.sparse(log)).select(*columns).collect()
    one = fo.finish(fo.fold_state(fo.sparse(log))).select(*columns).collect()
    assert sorted(map(str, folded)) == sorted(map(str, one)) and {r["observed_fields"] >> 16 for r in folded} == {0}
    late = {r["arrival_key"] for r in fo.mark_late(fo.sparse(log)).where("late").collect()}
    kept = {r["arrival_key"] for r in fo.accepted(fo.sparse(log)).collect()}
    assert not late & kept and "00000102" in late
