"""Records, placements, statuses, average precision and splits against hand values and brute force."""

import random

import pytest
from pyspark.sql import functions as F

from runledger import fixtures
from runledger.operators import ledger, metrics, relations, split, status, validate
from runledger.sources import exchange

LEDGER = "seq long, submission_id long, ts timestamp_ntz, at_time timestamp_ntz, event string, value double"


def day(n):
    import datetime

    return None if n is None else datetime.datetime(2024, 1, 1) + datetime.timedelta(days=n)


def placed(spark, rows, events=("scored",)):
    table = spark.createDataFrame([(s, 1, day(t), day(a), e, v) for s, t, a, e, v in rows], LEDGER)
    return {r["upload_seq"]: r["outcome_seq"] for r in ledger.place_outcomes(table, events).collect()}


def test_scores_go_to_the_nearest_upload(spark):
    assert placed(spark, [(1, 1, 1, "uploaded", None), (2, 10, 10, "uploaded", None), (3, 11, 9, "scored", 0.5)]) == {1: None, 2: 3}
    assert placed(spark, [(1, 1, 1, "uploaded", None), (2, 3, 3, "uploaded", None), (3, 4, 2, "scored", 0.5)]) == {1: None, 2: 3}
    assert placed(spark, [(1, 1, 1, "uploaded", None), (2, 3, 3, "uploaded", None), (3, 2, None, "scored", 0.5), (4, 0, None, "scored", 0.1)]) == {1: 3, 2: None}
    assert placed(spark, [(1, 1, 1, "uploaded", None), (2, 5, 1, "scored", 0.5), (3, 5, 1, "scored", 0.6), (4, 4, 1, "scored", 0.7)]) == {1: 2}


def test_final_gates_agree(spark):
    rows = [(1, 1, 1, 1, "uploaded", None), (2, 1, 2, 2, "scored", 0.5), (3, 1, 2, 2, "errored", None), (4, 2, 1, 1, "uploaded", None), (5, 2, 2, 2, "scored", None), (6, 3, 1, 1, "uploaded", None), (8, 3, 2, 2, "errored", None), (9, 3, 2, 2, "scored", 0.4)]
    table = spark.createDataFrame([(s, i, day(t), day(a), e, v) for s, i, t, a, e, v in rows], LEDGER)
    assert {r["submission_id"]: r["why"] for r in ledger.gate_reasons(table).collect()} == {1: "errored", 2: "no_value", 3: "eligible"}
    assert [r["submission_id"] for r in ledger.final_ranking(table).collect()] == [3]


def test_statuses_by_brute_force(spark):
    """The rules gone through one by one until nothing changes, over random graphs."""
    rng = random.Random(3)
    kinds = ["split", "run", "fusion_run", "reading", "artifact", "export", "judgement", "submission"]
    entities = [(f"{k}:{i}", k, f"d{i % 3}", f"p{i % 2}", f"run:{rng.randrange(6)}" if k == "reading" else None, rng.choice("AB") if k == "reading" else None, "gone" if rng.random() < 0.08 else None) for k in kinds for i in range(6)]
    edges = [(a[0], b[0]) for a in entities for b in entities if a is not b and rng.random() < 0.03]
    changes = [(f"d{rng.randrange(2)}", rng.randrange(12), rng.choice(["INPUT_AFFECTING", "TRAINING_AFFECTING", "EVALUATION_AFFECTING", "UNKNOWN", "DISPLAY_ONLY"])) for _ in range(8)]
    splits = [(f"split:{i}", f"d{i % 3}", f"p{i % 2}", s, rng.choice("AB")) for i in range(6) for s in range(10)]
    roles = [(e[0], s, rng.choice(["trained", "predicted"])) for e in entities if "run" in e[1] for s in "AB" if rng.random() < 0.7]
    chosen = {}
    for sid, d, p, s, sub in splits:
        if (d, p) not in chosen or sid < chosen[d, p]:
            chosen[d, p] = sid
    subset = {(d, p, s): sub for sid, d, p, s, sub in splits if chosen[d, p] == sid}
    state = {e[0]: (3, e[6], "") if e[6] else (0, "canonical evidence is current", "") for e in entities}

    def put(i, level, reason, pred):
        old = state[i]
        if level > old[0] or level == old[0] and (reason, pred) < old[1:]:
            state[i] = (level, reason, pred)

    for i, kind, d, p, *_rest, broken in entities:
        own = [c for c in changes if c[0] == d]
        if broken or not own:
            continue
        effects = {c[2] for c in own}
        if kind == "split" and "UNKNOWN" in effects:
            put(i, 1, "unclassified dataset evolution may affect split", d)
        if kind in ("artifact", "export"):
            if effects - {"DISPLAY_ONLY", "UNKNOWN"}:
                put(i, 2, "dataset evolution affects derived data", d)
            elif "UNKNOWN" in effects:
                put(i, 1, "unclassified dataset evolution may affect derived data", d)
        if kind in ("run", "fusion_run"):
            trained, all_ = {s for r, s, t in roles if r == i and t == "trained"}, {s for r, s, _ in roles if r == i}
            for _, s, e in own:
                sub = subset.get((d, p, s))
                if e in ("INPUT_AFFECTING", "TRAINING_AFFECTING") and sub in trained:
                    put(i, 2, f"training-affecting change in subset {sub} for sample {s}", d)
                if e == "UNKNOWN" and (sub is None or sub in all_):
                    put(i, 1, f"unclassified change for sample {s}", d)
    names = status.NAMES
    for i, kind, d, p, ref, want, broken in entities:
        if kind == "reading" and not broken:
            if state[ref][0]:
                put(i, state[ref][0], f"upstream {ref} is {names[state[ref][0]]}", ref)
                continue
            for _, s, e in (c for c in changes if c[0] == d):
                if subset.get((d, p, s)) == want and e in ("INPUT_AFFECTING", "EVALUATION_AFFECTING"):
                    put(i, 2, f"evaluation-affecting change in subset {want} for sample {s}", d)
                elif subset.get((d, p, s)) == want and e == "UNKNOWN":
                    put(i, 1, f"unclassified change in subset {want} for sample {s}", d)
    kind_of, before = {e[0]: e[1] for e in entities}, None
    while before != state:
        before = dict(state)
        for a, b in edges:
            if state[a][0] == 3 or state[a][0] and kind_of[b] in status.INHERITING:
                put(b, state[a][0], f"upstream {a} is {names[state[a][0]]}", a)
    frames = [spark.createDataFrame(r, s) for r, s in ((entities, "entity_id string, entity_type string, dataset_id string, plan_id string, run_ref string, subset string, broken_reason string"), (edges, "source_id string, target_id string"), (changes, "dataset_id string, sample_id long, effect string"), (splits, "split_id string, dataset_id string, plan_id string, sample_id long, subset string"), (roles, "run_id string, subset string, role string"))]
    got = {r["entity_id"]: (names.index(r["status"]), r["reason"], r["predecessor_id"] or "") for r in status.statuses(*frames).collect()}
    assert got == state and {s[0] for s in state.values()} == {0, 1, 2, 3}


BOX = "side string, image_id long, category_id int, x double, y double, w double, h double, score double, crowd boolean, turn long"


def test_average_precision_by_hand(spark):
    g = lambda i, x, crowd=False: ("gold", i, 0, x, 0.0, 10.0, 10.0, 0.0, crowd, 0)
    p = lambda i, x, s, t=0: ("predicted", i, 0, x, 0.0, 10.0, 10.0, s, False, t)
    rows = [g(1, 0.0), g(1, 100.0), g(2, 0.0), g(2, 50.0, True), p(1, 0.0, 0.9), p(1, 200.0, 0.8), p(2, 0.0, 0.7), p(2, 50.0, 0.95)]
    got = {r["iou"]: r["ap"] for r in metrics.average_precision(spark.createDataFrame(rows, BOX), (0.5, 0.75)).collect()}
    # recalls 1/3 at precision 1 and 2/3 at precision 2/3; the crowd's detection doesn't count
    assert got == pytest.approx({0.5: (34 + 33 * 2 / 3) / 101, 0.75: (34 + 33 * 2 / 3) / 101})
    cut = metrics.average_precision(spark.createDataFrame(rows, BOX), (0.5,), max_dets=1).first()["ap"]
    assert cut == pytest.approx(34 / 101)
    assert metrics.average_precision(spark.createDataFrame([g(1, 0.0)], BOX), (0.5,)).first()["ap"] == 0


def test_fixed_split_is_exact(spark, small):
    samples = fixtures.table(spark, small, "fx_samples")
    got = split.fixed_split(samples, [("holdout", 0.1), ("valA", 0.2)])
    n = samples.where("label_source = 'gold' and cls is not null").count()
    counts = {r["subset"]: r["count"] for r in got.groupBy("subset").count().collect()}
    assert counts == {"holdout": round(n * 0.1), "valA": round(n * 0.2), "train": samples.count() - round(n * 0.1) - round(n * 0.2)}
    assert got.where("subset <> 'train'").join(samples.where("label_source = 'none'"), "sample_id").count() == 0 and got.select("sample_id").distinct().count() == samples.count()


def test_duplicates_parity_and_appending(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "k long, v string")
    assert {(r["k"], r["how"]) for r in relations.parity(a, a.distinct(), "k").collect()} == {(1, "differs")} and relations.parity(a, a, "k").count() == 0
    rows = spark.createDataFrame([(1, 1.0), (2, float("nan")), (3, None), (4, 2.0), (4, 2.0)], "k long, value double")
    assert {r["k"] for r in relations.new_rows(rows, rows.where("k = 1"), "k", "value").collect()} == {4}
    assert {r["k"] for r in relations.merged_refs(a.where("k = 1"), a, "k").collect()} == {1, 2}


def test_polygons_and_torn_yolo_lines(spark):
    ring = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 4.0, 0.0), (1, 2, 4.0, 3.0), (2, 0, 1.0, 1.0)], "polygon_id long, place int, x double, y double")
    assert {r["polygon_id"]: (r["area"], r["problem"]) for r in validate.polygon_facts(ring, 10, 10).collect()} == {1: (6.0, None), 2: (0.0, "degenerate_ring")}
    lines = exchange.yolo_boxes(spark.createDataFrame([("0 0.5 0.5 0.2 0.4",), ("0 0.5",), ("x",)], "line string"), 100, 50).collect()
    assert (lines[0]["x"], lines[0]["y"], lines[0]["w"], lines[0]["h"]) == pytest.approx((40, 15, 20, 20)) and lines[1]["w"] is None and lines[2]["x"] is None


def test_boxes_of_one_place_are_found(spark):
    from runledger.operators import audit

    rows = [(1, 0, 1, 2, 3, 4)] * 2 + [(1, 0, 1, 2, 3, 5), (2, 0, 1, 2, 3, 4)]
    got = audit.duplicate_boxes(spark.createDataFrame(rows, "l_orderkey long, category_id int, x int, y int, w int, h int")).select("l_orderkey", "h", "n").collect()
    assert [tuple(r) for r in got] == [(1, 4, 2)]


def test_tolerance_and_signs(spark):
    from runledger.operators import audit, registers

    boxes = spark.createDataFrame([(1, -1.0, -1.0, 9.0, 9.0), (2, -1.5, 0.0, 9.0, 9.0), (3, 632.0, 0.0, 9.0, 9.0), (4, 632.5, 0.0, 9.0, 9.0)], "id long, x double, y double, w double, h double")
    assert {r["id"]: r["problem"] for r in audit.box_problems(boxes).collect()} == {2: "negative_origin", 4: "out_of_bounds"}
    ring = spark.createDataFrame([(p, i, x, y) for p, far in ((1, 11.0), (2, 11.5)) for i, (x, y) in enumerate([(-1.0, 0.0), (far, 0.0), (5.0, 9.0)])], "polygon_id long, place int, x double, y double")
    assert {r["polygon_id"]: r["problem"] for r in validate.polygon_facts(ring, 10, 10).collect()} == {1: None, 2: "vertex_outside"}
    task = lambda *v: exchange.inferred_task(spark.createDataFrame([(x,) for x in v], "a string"), ["a"]).first()["task"]
    assert [task(" 5 ", "-7"), task("+5", "7"), task("1", " 0.0"), task("1", None)] == ["cls", "regression", "multilabel", "regression"]
    edges = spark.createDataFrame([(0.5,), (1.0,), (9.9,), (10.0,), (12345678.0,)], "n double")
    assert [r[0] for r in edges.select(registers.decade(F.col("n"))).collect()] == [0, 0, 0, 1, 7]
