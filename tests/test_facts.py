"""Numbered labels."""

from obscat.operators.facts import suffix_facts


def test_a_number_that_a_label_carries_itself_is_passed_over(spark, many_slices):
    labels = ["Audio", "audio", "Audio 2", "Audio", "Audio 4", "Size", "Audio 2", "Audio 02"]
    rows = [(p, i, label, f"v{i}", f"{i:03d}") for p in (1, 2) for i, label in enumerate(labels)]
    facts = spark.createDataFrame(rows, "page_id long, seq int, label string, value string, tie_key string")
    found = suffix_facts(facts, order=("seq", "tie_key")).collect()
    keys = {}
    for r in sorted(found, key=lambda r: r["seq"]):
        keys.setdefault(r["page_id"], []).append(r["key"])
    assert keys[1] == keys[2] == ["Audio", "audio 3", "Audio 2", "Audio 5", "Audio 4", "Size", "Audio 2 2", "Audio 02"]
    assert len({k.lower() for k in keys[1]}) == len(labels)
