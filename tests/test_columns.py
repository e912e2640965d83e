"""Numbering without a global window."""

import random

from lacewing.functions import placed_in_group


def test_places_in_groups_that_span_partitions(spark):
    rng = random.Random(3)
    rows = [(g, rng.randrange(50)) for g in [1] * 300 + [rng.randrange(40) for _ in range(300)]]
    df = spark.createDataFrame(rows, "src long, dst long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = placed_in_group(df, "src", ["dst"]).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    by: dict[int, list[tuple[int, int]]] = {}
    for r in got:
        by.setdefault(r["src"], []).append((r["pos"], r["dst"]))
    assert len(got) == len(rows)
    for g, places in by.items():
        places.sort()
        assert [p for p, _ in places] == list(range(len(places)))
        assert [d for _, d in places] == sorted(d for s, d in rows if s == g)


def test_places_of_no_rows(spark):
    df = spark.createDataFrame([], "src long, dst long")
    assert placed_in_group(df, "src", ["dst"]).collect() == []
