import hashlib
import math
from collections import Counter

import pytest

from lacewing.llm.mixing import expected_standard_error, mix_sources, mixture_order, source_rates

SCHEMA = "doc_id long, text string, source string, copy string, rate int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def uniform(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:13], 16) / 2**52


def poisson(mean, u):
    k, p = 0, math.exp(-mean)
    total = p
    while total <= u:
        k += 1
        p *= mean / k
        total += p
    return k


ROWS = [(i, "t" * (i % 9), "abc"[i % 3] if i % 10 else "a") for i in range(3000)]


@pytest.mark.parametrize("limit", [10_000, 0])
def test_counts_match_brute_force(spark, limit):
    weights = {"a": 2.0, "b": 1.0, "none": 3.0}
    df = table(spark, ROWS)
    got = Counter(r["doc_id"] for r in mix_sources(df, weights, seed=3, broadcast_sources=limit).collect())
    sizes = Counter()
    for i, t, s in ROWS:
        sizes[s] += len(t) + 1
    want = Counter()
    for i, _, s in ROWS:
        if s in weights:
            # weights are shared among the sources that exist
            rate = weights[s] / 3 * sum(sizes.values()) / sizes[s]
            if n := poisson(rate, uniform(3, "draw", i, 1)):
                want[i] = n
    assert got == want


def test_target_weights_are_met_and_large_means_too(spark):
    rows = [(i, "t", "big") for i in range(4000)] + [(10_000 + i, "t", "tiny") for i in range(20)]
    df = table(spark, rows)
    copies = Counter(r["source"] for r in mix_sources(df, {"big": 0.5, "tiny": 0.5}, total=8000.0).collect())
    rate = {r["source"]: r["rate"] for r in source_rates(df, {"big": 0.5, "tiny": 0.5}, total=8000.0).collect()}
    assert rate["tiny"] == 100
    assert abs(copies["tiny"] - 2000) < 5 * expected_standard_error(100, 20)
    assert abs(copies["big"] - 2000) < 5 * expected_standard_error(0.5, 4000)


def test_shuffle_is_global_and_repeatable(spark):
    df = table(spark, ROWS)
    one = {(r["doc_id"], r["copy"]): r["position"] for r in mixture_order(mix_sources(df)).collect()}
    two = {(r["doc_id"], r["copy"]): r["position"] for r in mixture_order(mix_sources(df.repartition(7))).collect()}
    assert one == two
    assert sorted(one.values()) == list(range(len(one)))
    order = sorted(one, key=one.get)
    assert order == sorted(one, key=lambda k: (uniform(1, "place", *k), k))


def test_nulls_ties_and_empty(spark):
    rows = [(None, None, None), (None, "x", None), (1, None, "a"), (1, None, "a"), (2, "é", "a")] * 20
    mixed = mix_sources(table(spark, rows), total=2000.0)
    assert mixed.columns == ["doc_id", "text", "source", "rate", "copies", "copy", "shuffle_key"]
    assert {r["source"] for r in mixed.collect()} == {None, "a"}
    ones = [r["copies"] for r in mixed.filter("doc_id = 1").collect()]
    assert len(set(ones)) == 1
    assert len(ones) == 40 * ones[0]
    assert mix_sources(table(spark, rows).limit(0)).count() == 0
    assert mix_sources(table(spark, rows), {"zzz": 1.0}).count() == 0


def test_clashing_columns_stay_and_long_texts_count_whole(spark):
    rows = [(i, "t", "ab"[i % 2], 1, "p", 2, "x") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, __source int, __parts string, __cdf int, size string")
    plain = Counter(r["doc_id"] for r in mix_sources(df.select("doc_id", "text", "source")).collect())
    got = mix_sources(df)
    assert got.columns == [*df.columns, "copies", "copy", "shuffle_key"]
    assert Counter(r["doc_id"] for r in got.collect()) == plain
    long = spark.createDataFrame([(1, "é" * 2_000_000, "a"), (2, "x", "b")], "doc_id long, text string, source string")
    assert {r["source"]: r["size"] for r in source_rates(long).collect()} == {"a": 4_000_001, "b": 2}
