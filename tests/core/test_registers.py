"""Edge cases of the registers by hand."""

import random

import duckdb
from oracle import assert_same
from pyspark.sql import functions as F

from runledger.operators import registers, validate
from runledger.plans import catalogue


def test_scalars(spark):
    names = spark.createDataFrame([("a/b", "0"), ("..", "24h"), ("é", "5"), ("", "7 d"), (None, None), ("ok\n", " 3d ")], "name string, age string")
    got = names.select(registers.safe_name(F.col("name")).alias("n"), registers.age_seconds(F.col("age")).alias("a")).collect()
    assert [r["a"] for r in got] == [0, 86400, None, None, None, 259200]
    assert got[0]["n"] == "a__b" and all(len(got[i]["n"]) == 16 for i in (1, 2, 3, 5))
    vectors = spark.createDataFrame([([1.0, 1.0], [1.0, 1.0]), ([1.0, 1.0], [2.0, 2.0]), ([1.0, 2.0], [2.0, 1.0])], "a array<double>, b array<double>")
    assert [round(r[0], 9) for r in vectors.select(registers.pearson(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, -1.0]


def test_mentions_are_whole_tokens(spark):
    notes = spark.createDataFrame([(1, " S1 note"), (2, "S10"), (3, "see S1."), (4, "(S1)"), (5, None), (6, "")], "note_id int, description string")
    got = registers.mentions(notes, spark.createDataFrame([("S1",), ("S1",)], "submission_id string"))
    assert sorted((r["note_id"], r["leads"]) for r in got.collect()) == [(1, True), (4, False)]


def test_nearest_decade_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, 0), (2, 150), (3, 10_000)], "id int, edges long")
    strata = spark.createDataFrame([(1, 5.0), (3, 7.0)], "decade int, incremental_rmse double")
    assert {r["id"]: r["width"] for r in registers.band_widths(rows, strata).collect()} == {1: 5.0, 2: 7.0, 3: 7.0}
    assert {r["width"] for r in registers.band_widths(rows, strata.limit(0)).collect()} == {None}
    grades = spark.createDataFrame([], "run string, grade string")
    owners = spark.createDataFrame([("a",)], "run string")
    assert registers.lowest_grade(owners, grades, "run", ["declared", "recorded"]).first()["grade"] == "declared"


def test_first_of_equal_places(spark, tmp_path):
    """Of records with one path and place the one that stands first in the table states digest and size, whatever their order as values."""
    rows = "(4, 9), (4, 7), (5, 7), (5, 9), (4, 8)"
    duckdb.execute(f"copy (select 12::bigint as l_orderkey, 1 as l_linenumber, p::bigint as l_partkey, k::bigint as l_suppkey, k::double as l_quantity, timestamp '1996-01-01' as l_shipdate from (values {rows}) t(p, k)) to '{tmp_path}/lineitem.parquet' (format parquet)")
    got = catalogue.queries()["reference_collapse"](spark, str(tmp_path))
    assert sorted(tuple(r) for r in got.collect()) == [("f4", 1, "h9", 9), ("f5", 1, "h7", 7)]
    assert_same(got, tmp_path, catalogue.oracle_sql()["reference_collapse"])


def test_clean_subsets_without_a_row_per_run_and_sample(spark):
    rng = random.Random(6)
    names = ["a", "b", "c", "d", "e"]
    plan = [(rng.choice(names), rng.choice(["train", "eval", "eval", None]), rng.choice([*range(40), None])) for _ in range(45)]
    trained = [(f"r{i}", rng.choice([*names, "none"])) for i in range(30)]
    found = validate.clean_subsets(spark.createDataFrame(plan, "subset string, role string, sample_id long"), spark.createDataFrame(trained, "run_id string, subset string"))
    held = {(s, x) for s, r, x in plan if r not in ("train", None)}
    wanted = set()
    for run in {r for r, _ in trained}:
        own = {s for r, s in trained if r == run}
        seen = {x for s, _, x in plan if s in own and x is not None}
        wanted |= {(run, s) for s, _ in held if s not in own and not any(x in seen for t, x in held if t == s)}
    assert {tuple(r) for r in found.select("run_id", "subset").collect()} == wanted and 0 < len(wanted) < 30 * 4
    joins = [x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x]
    assert joins and not any("sample_id" in x for x in joins)
