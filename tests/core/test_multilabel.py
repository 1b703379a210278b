"""Splits of label vectors: exact sizes, counts near their targets, one result whatever the partitions."""

import random

import pytest

from runledger.operators import split


def rows_of(seed, n):
    rng = random.Random(seed)
    chance = {"a": 0.5, "b": 0.3, "c": 0.05, "d": 0.01, "é": 0.2}
    return [(i, None if rng.random() < 0.02 else [x for x, p in chance.items() if rng.random() < p] + ([None, "a"] if rng.random() < 0.05 else [])) for i in range(n)]


@pytest.mark.parametrize(("n", "wanted"), [(600, 150), (40, 39)])
def test_sizes_are_exact_and_labels_in_proportion(spark, n, wanted):
    rows = rows_of(n, n)
    table = spark.createDataFrame(rows, "id long, labels array<string>")
    got = {r["id"] for r in split.multilabel_take(table, "id", "labels", wanted).collect()}
    assert len(got) == wanted
    for x in "abcdé":
        have, all_ = (sum(x in (v or ()) for i, v in rows if i in ids) for ids in (got, range(n)))
        assert abs(have - all_ * wanted / n) <= 2, x
    if n > 100:
        again = split.multilabel_take(table.repartition(9, "labels"), "id", "labels", wanted)
        assert {r["id"] for r in again.collect()} == got


def test_edges(spark):
    table = spark.createDataFrame([(i, ["a", "b"] if i < 4 else ["a"] if i < 8 else []) for i in range(10)], "id long, labels array<string>")
    take = lambda df, n: split.multilabel_take(df, "id", "labels", n).count()
    assert take(table, 0) == 0 and take(table, 99) == 10 and take(table, 5) == 5
    assert take(table.where("id < 0"), 3) == 0


def test_one_vector_is_shared_exactly(spark):
    table = spark.createDataFrame([(i, ["a"]) for i in range(30)], "id long, labels array<string>")
    assert [(r["size"], r["quota"]) for r in split.multilabel_quota(table, "id", "labels", 7).collect()] == [(30, 7)]
