"""The kept-up status view, paths to a head, order statistics, matchings and digests against brute force."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from runledger.operators import ledger, lineage, matching, quantiles, relations
from runledger.operators.incremental import TABLES, StatusView, ingest_stream
from runledger.storage import new_folder

EFFECTS = ["SPLIT_AFFECTING", "TRAINING_AFFECTING", "EVALUATION_AFFECTING", "INPUT_AFFECTING", "UNKNOWN", "DISPLAY_ONLY", "DISPLAY_ONLY"]
TYPES = ["split", "run", "fusion_run", "reading", "reading", "artifact", "export", "judgement", "submission", "backup"]


def world(seed):
    """Random records with edges to earlier ones, splits, run subsets and changes."""
    rng = random.Random(seed)
    entities, edges, roles = [], [], []
    for k in range(60):
        kind = rng.choice(TYPES)
        runs = [e[0] for e in entities if e[1] in ("run", "fusion_run")]
        entities.append((f"{kind}:{k}", kind, f"d{k % 3}", f"plan{k % 2}", rng.choice(runs) if kind == "reading" and runs else None, rng.choice(["train", "valA"]) if kind == "reading" else None, "missing" if rng.random() < 0.04 else None))
        edges += [(rng.choice(entities[:-1])[0], entities[-1][0]) for _ in range(rng.randrange(3)) if k]
        roles += [(entities[-1][0], "train", "trained"), (entities[-1][0], "valA", "predicted")] if kind in ("run", "fusion_run") else []
    splits = [(f"split:{d}{p}", f"d{d}", f"plan{p}", str(s), "train" if s % 2 else "valA") for d in range(3) for p in range(2) for s in range(20)]
    changes = [(f"d{rng.randrange(3)}", str(rng.randrange(25)), rng.choice(EFFECTS)) for _ in range(14)]
    return entities, sorted(set(edges)), splits, roles, changes


def frame(spark, table, rows):
    return spark.createDataFrame(rows, TABLES[table] if table != "changes" else "dataset_id string, sample_id string, effect string").coalesce(1)


@pytest.mark.parametrize("seed", [5])
def test_ingest_equals_replay(spark, seed):
    entities, edges, splits, roles, changes = world(seed)
    old = {e[0] for e in entities[:45]}
    late_edges = [e for e in edges if not set(e) <= old] + edges[:2]
    view = StatusView(spark, new_folder(spark, "view"))
    view.create(frame(spark, "entities", entities[:45]), frame(spark, "edges", [e for e in edges if e not in late_edges]), frame(spark, "changes", changes[:3]), frame(spark, "splits", splits), frame(spark, "run_subsets", [r for r in roles if r[0] in old]))
    assert view.ingest("a", frame(spark, "changes", changes[3:6]))
    assert view.verify().count() == 0
    assert view.ingest("b", frame(spark, "changes", changes[5:10]), frame(spark, "entities", entities[45:]), frame(spark, "edges", late_edges), frame(spark, "run_subsets", [r for r in roles if r[0] not in old]))
    assert view.verify().count() == 0
    before = view.version()
    assert not view.ingest("b", frame(spark, "changes", changes[5:10])) and view.version() == before
    with pytest.raises(ValueError, match="other contents"):
        view.ingest("b", frame(spark, "changes", changes[:1]))
    assert view.ingest("c", frame(spark, "changes", [("d9", "1", "UNKNOWN")])) and view.table("applied").where("diff_id = 'c'").first()["dirty"] == 0
    statuses = sorted(map(tuple, view.statuses().collect()), key=str)
    assert len(statuses) == 60 and len({s[2] for s in statuses}) > 1
    assert sorted(map(tuple, view.compact(new_folder(spark, "view")).statuses().collect()), key=str) == statuses


def test_broken_off_ingest_is_repeated(spark, tmp_path):
    """What a run wrote before it broke off isn't seen and is written again; batches of a stream are differences."""
    entities, edges, splits, roles, changes = world(2)
    view = StatusView(spark, new_folder(spark, "view"))
    view.create(frame(spark, "entities", entities), frame(spark, "edges", edges), frame(spark, "changes", []), frame(spark, "splits", splits), frame(spark, "run_subsets", roles))
    kept = view._write
    view._write = lambda df, table, version: (_ for _ in ()).throw(RuntimeError("broken off")) if table == "levels" else kept(df, table, version)
    with pytest.raises(RuntimeError):
        view.ingest("a", frame(spark, "changes", changes[:6]))
    view._write = kept
    assert view.version() == 0 and view.verify().count() == 0
    frame(spark, "changes", changes[:6]).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("dataset_id string, sample_id string, effect string").parquet(str(tmp_path / "in"))
    ingest_stream(stream, view, str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    assert view.version() == 1 and view.verify().count() == 0 and view.statuses().where("status <> 'VALID'").count() > 0


def test_changes_to_head(spark):
    edges = [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "h"), ("d", "x"), ("y", "x")]
    changes = [(s, t, f"{s}{t}{k}") for s, t in edges for k in range(2)] + [("a", "b", "shared"), ("c", "d", "shared")]
    t, c = spark.createDataFrame(edges, "source_id string, target_id string"), spark.createDataFrame(changes, "source_id string, target_id string, change_id string")
    found = {(r.dataset_id, r.change_id) for r in lineage.changes_to_head(t, c, "h").collect()}
    below = {"a": edges[:5], "b": [("b", "d"), ("d", "h")], "c": [("c", "d"), ("d", "h")], "d": [("d", "h")]}
    assert found == {(d, i) for d, own in below.items() for s, t_, i in changes if (s, t_) in own}
    with pytest.raises(ValueError, match="cycle"):
        lineage.changes_to_head(t.union(spark.createDataFrame([("d", "a")], t.schema)), c, "h")


@pytest.mark.parametrize("values", [[3.0], [1.0, 1.0, 1.0, 2.0], [0.1 * k for k in range(1000)], [1e-300, 1e300, -1e308, 1e308, 5e-324, 0.0, -0.0, 7.0], [float(k % 7) for k in range(500)] + [1e9 + k for k in range(20)]])
def test_quantile_edges(spark, values):
    df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),), (float("inf"),)], "v double").repartition(3)
    ranks = list(range(0, len(values), max(1, len(values) // 40)))
    assert quantiles.order_statistics(df, "v", ranks) == {r: sorted(values)[r] for r in ranks}
    expected = np.quantile(np.array(values), np.linspace(0, 1, 11)[1:-1])
    edges = quantiles.quantile_edges(df, "v")
    assert edges == pytest.approx(expected, rel=1e-12, abs=0)
    keys = {(r.v, r.q) for r in quantiles.quantile_keys(df.where("v < double('infinity') and not isnan(v)"), "v", "q").collect()}
    assert keys == {(v, f"q{int(np.searchsorted(np.array(edges), v, side='right'))}") for v in values}


def test_stratum_keys(spark):
    df = spark.createDataFrame([(1, [0, 1], 5, None), (2, None, None, 2.0), (3, [1, 1], 7, 3.0)], "k int, labels array<int>, n int, x double")
    key = lambda c: [r.s for r in quantiles.stratum_keys(df, c, "s").orderBy("k").collect()]
    assert key("labels") == ["[0, 1]", "[0, 0]", "[1, 1]"] and key("n") == ["5", "None", "7"] and key("x") == ["None", "q0", "q9"]
    with pytest.raises(ValueError, match="widths"):
        quantiles.stratum_keys(df.union(spark.createDataFrame([(4, [1], 1, 1.0)], df.schema)), "labels", "s")


def test_absorbed_arrivals(spark):
    rng = random.Random(4)
    start, window = datetime(2024, 1, 1), 600
    for _ in range(2):
        uploads = [(i, rng.randrange(4), f"r{rng.randrange(60)}" if rng.random() < 0.2 else None, start + timedelta(seconds=30 * rng.randrange(200))) for i in range(60)]
        foreign = [(f"r{k}", start + timedelta(seconds=30 * rng.randrange(200))) for k in range(50)]
        ties = [(f"r{k}", rng.randrange(4)) for k in range(50) for _ in range(2)]
        ours = {r: s for _, s, r, _ in sorted(uploads, key=lambda u: u[0]) if r in dict(foreign)}
        expected, used = {r: (s, None) for r, s in ours.items()}, set()
        pairs = sorted((abs(at - u[3]), u[0], ref, sid) for ref, at in foreign if ref not in ours for sid in {s for r, s in ties if r == ref} for u in uploads if u[1] == sid and u[2] is None)
        for gap, place, ref, sid in pairs:
            if gap <= timedelta(seconds=window) and place not in used and ref not in expected:
                used.add(place)
                expected[ref] = (sid, place)
        found = matching.absorbed_arrivals(spark.createDataFrame(uploads, "place long, submission_id long, ref string, at timestamp"), spark.createDataFrame(foreign, "ref string, at timestamp"), spark.createDataFrame(ties, "ref string, submission_id long"), window)
        assert {r.ref: (r.submission_id, r.place) for r in found.collect()} == expected


def test_digests_tell_rows_apart(spark):
    rows = [("a|b", "c"), ("a", "b|c"), ("~", None), (None, "~"), ("", None), (None, ""), ("1:x", "y"), ("1", ":xy"), (None, None)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, x string, y string")
    assert df.select(lineage.row_hash("x", "y")).distinct().count() == len(rows)
    old, new = df.where("k in (0, 2, 4)").withColumn("k", F.col("k") / 2), df.where("k in (1, 3, 5)").withColumn("k", (F.col("k") - 1) / 2)
    assert lineage.dataset_diff(old, new, "k", ("x", "y")).count() == 3
    assert relations.parity(old, new, "k").count() == 3
    assert relations.identity(df, ["x", "y"], "i").select("i").distinct().count() == len(rows)


def test_merged_ledgers(spark):
    schema = "seq int, submission_id string, at_time int, event string, value double"
    a = spark.createDataFrame([(1, "s", 5, "staged", None), (2, "s", 6, "scored", 1.0), (2, "s", 6, "scored", 1.0)], schema)
    b = spark.createDataFrame([(1, "s", 5, "staged", None), (2, "s", 6, "scored", 2.0), (3, "t", 1, "staged", None), (9, "t", 2, "staged", None)], schema)
    merged = ledger.merge_ledgers(a, b)
    assert [(r.seq, r.value) for r in merged.orderBy("turn", "value").collect()] == [(3, None), (9, None), (1, None), (2, 1.0), (2, 2.0)]
    assert [tuple(r) for r in ledger.staging_conflicts(merged).collect()] == [("t", 2)]
    once = ledger.merge_dedupe(a, b)
    assert sorted((r.seq, r.value) for r in once.collect() if r.value) == [(2, 1.0)] and once.count() == 4
