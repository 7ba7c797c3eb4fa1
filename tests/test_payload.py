"""Payload envelopes: defaults, retained details, list and detail rows."""

import json

import pytest
from pyspark.sql import functions as F

from obscat.operators import payload as pay

EMPTY = {"schemaVersion": 1, "parserVersion": "", "list": {}, "details": {}, "unmapped": {}, "warnings": []}


def plain(text):
    """Envelope of a text with the defaults of the parts that are missing."""
    try:
        node = json.loads(text) if text is not None else {}
    except ValueError:
        node = {}
    node = node if isinstance(node, dict) else {}
    return {k: node.get(k) if node.get(k) is not None else v for k, v in EMPTY.items()}


def as_dict(row):
    return {
        "schemaVersion": row.schema_version, "parserVersion": row.parser_version, "warnings": row.warnings,
        **{k: json.loads(row[k]) for k in ("list", "details", "unmapped")},
    }


TEXTS = [
    None, "", "{", "[1]", "5", "null", "{}", '{"list":{"b":1,"a":[1,{"c":null}]}}', '{"details":null,"warnings":null}',
    '{"schemaVersion":3,"parserVersion":"x","list":[1],"details":"text","unmapped":{"é":"ü"},"warnings":["a","a"," "],"more":1}',
]


def test_defaults(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, p string")
    got = rows.withColumn("e", pay.envelope("p")).select("i", *[c.alias(n) for n, c in pay.written_envelope("e").items()]).collect()
    assert {r.i: as_dict(r) for r in got} == {i: plain(t) for i, t in enumerate(TEXTS)}


@pytest.mark.parametrize("first", TEXTS[6:])
def test_details_of_a_list_row(spark, first):
    second = '{"parserVersion":"d","details":{"x":1},"unmapped":{"é":1,"n":2},"warnings":["a","z"]}'
    row = spark.createDataFrame([(first, second)], "a string, b string").select(pay.with_details(pay.envelope("a"), pay.envelope("b")).alias("e"))
    got = as_dict(row.select(*[c.alias(n) for n, c in pay.written_envelope("e").items()]).first())
    a, b = plain(first), plain(second)
    said = [w for w in a["warnings"] if w.strip()]
    assert got == {
        "schemaVersion": 1, "parserVersion": "d", "list": a["list"], "details": b["details"], "unmapped": {**a["unmapped"], **b["unmapped"]},
        "warnings": list(dict.fromkeys([*said, *b["warnings"]])),
    }


def test_retained_details_row_by_row(spark, many_slices):
    import datetime as dt
    import random

    rng = random.Random(3)
    rows = [
        ("s", f"k{rng.randrange(4)}", f"{i:05d}", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rng.randrange(60)), 3,
         rng.choice(["fetched", "partial", "failed", "not_required", "budget_exhausted"]), rng.choice(TEXTS[:-1] + ['{"details":{"n":%d}}' % i]))
        for i in range(80)
    ]
    want, newest = {}, {}
    for source, key, _, at, _, state, text in rows:
        if key in newest and at < newest[key]:
            continue
        newest[key] = at
        node = plain(text)
        if key in want and state in ("failed", "partial", "budget_exhausted"):
            node["details"] = want[key]["details"]
        want[key] = node
    log = spark.createDataFrame(
        rows, "source string, source_key string, arrival_key string, fetched_at timestamp_ntz, observed_fields long, details_state string, payload string")
    folded = pay.fold_payloads(log).select("source_key", *[c.alias(n) for n, c in pay.written_envelope("payload").items()]).collect()
    assert {r.source_key: as_dict(r) for r in folded} == want


def test_a_list_row_without_details_keeps_its_own(spark):
    lists = spark.createDataFrame([("s", "a", TEXTS[7]), ("s", "b", TEXTS[9])], "source string, source_key string, p string").withColumn("payload", pay.envelope("p"))
    details = spark.createDataFrame([("s", "b", '{"details":{"x":1}}')], "source string, source_key string, p string").withColumn("payload", pay.envelope("p"))
    got = {r.source_key: r for r in pay.enrich_payloads(lists, details).select("source_key", F.to_json("payload.details").alias("d"), F.to_json("payload.list").alias("l")).collect()}
    assert (got["a"].d, got["a"].l) == ("{}", '{"a":[1,{"c":null}],"b":1}') and (got["b"].d, got["b"].l) == ('{"x":1}', "[1]")
