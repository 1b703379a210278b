"""Boxes: fusion and average precision against the sequential rules."""

import random

import pytest

from runledger.operators import fusion, metrics

FUSED = "image_id long, category_id int, x double, y double, w double, h double, score double, weight double, turn long"
BOX = "side string, image_id long, category_id int, x double, y double, w double, h double, score double, crowd boolean, turn long"


def share(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    both = max(w, 0) * max(h, 0)
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both
    return both / union if union > 0 else 0.0


def fused_by_hand(rows, weights, iou, conf):
    """Every image and category as a whole, clusters as plain lists."""
    out = []
    for key in sorted({r[:2] for r in rows}):
        own = sorted(((-r[6] * r[7], r[8], (r[2], r[3], r[2] + r[4], r[3] + r[5])) for r in rows if r[:2] == key))
        found = []
        for q, _, b in own:
            best = max(found, key=lambda c: share(c["at"], b), default=None)
            if best is None or share(best["at"], b) <= iou:
                best = {"m": []}
                found.append(best)
            best["m"].append((-q, b))
            all_ = sum(m[0] for m in best["m"])
            best["at"] = [sum((m[0] if all_ else 1) * m[1][i] for m in best["m"]) / (all_ or len(best["m"])) for i in range(4)]
        for c in found:
            qs = [m[0] for m in c["m"]]
            s = max(qs) / max(weights) if conf == "max" else sum(qs) / len(qs) * min(len(weights), len(qs)) / sum(weights)
            a = c["at"]
            out.append((*key, a[0], a[1], a[2] - a[0], a[3] - a[1], min(1.0, s), len(qs)))
    return sorted(out)


@pytest.mark.parametrize("conf", ["avg", "max"])
def test_fusion_equals_the_sequential_rule(spark, conf):
    rng = random.Random(5)
    weights = [1.0, 2.0, 0.5]
    rows = [(i % 5, i % 2, rng.uniform(0, 90 if i % 3 else 900), rng.uniform(0, 90), rng.uniform(4, 40), rng.uniform(4, 40), rng.choice([0.0, 0.2, 0.5, rng.random()]), weights[i % 3], i) for i in range(400)]
    got = fusion.fuse_boxes(spark.createDataFrame(rows, FUSED), weights, 0.3, conf=conf, turn="turn", cell=7.0).collect()
    wanted = fused_by_hand(rows, weights, 0.3, conf)
    assert len(got) == len(wanted)
    for a, b in zip(sorted(tuple(r) for r in got), wanted, strict=True):
        assert a == pytest.approx(b, abs=2e-6)


def test_boxes_are_shuffled_once_unless_an_image_is_hot(spark):
    rng = random.Random(11)
    rows = [(0 if i % 3 else i % 29, i % 2, float(rng.randrange(900 if i % 2 else 60)), float(rng.randrange(60)), float(rng.randrange(1, 30)), float(rng.randrange(1, 30)), rng.randrange(6) / 5, 1.0, i) for i in range(600)]
    near = lambda rs: sorted(tuple(round(v, 4) for v in r) for r in rs)
    wanted = near(fused_by_hand([(*r[:8], (r[2], r[3])) for r in rows], [1.0], 0.4, "avg"))
    boxes = spark.createDataFrame(rows, FUSED).repartition(5)
    for hot in (fusion.HOT, 20):
        df = fusion.fuse_boxes(boxes, 1, 0.4, cell=7.0, hot=hot)
        if hot == fusion.HOT:
            # the other exchange is the test's own
            assert df._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 2
        got = near(df.collect())
        assert got == wanted and any(r[7] > 2 for r in got)


def test_fusion_parameters(spark):
    one = [(1, 0, -5.0, 0.0, 20.0, 10.0, 0.8, 2.0, 0)]
    boxes = spark.createDataFrame(one, FUSED)
    assert tuple(fusion.fuse_boxes(boxes, [2.0]).first()) == (1, 0, -5.0, 0.0, 20.0, 10.0, 0.8, 1)
    assert tuple(fusion.fuse_boxes(boxes, [2.0], size=(12, 8)).first())[2:6] == (0.0, 0.0, 12.0, 8.0)
    assert fusion.fuse_boxes(boxes, [2.0], skip=0.9).count() == 0 and fusion.fuse_boxes(boxes, [2.0], min_score=0.81).count() == 0
    rows = [(1, c, 100.0 * i, 0.0, 10.0, 10.0, s, 1.0, i) for i, (c, s) in enumerate([(1, 0.5), (0, 0.5), (0, 0.5), (1, 0.9)])] + [(2, 0, None, 0.0, 1.0, 1.0, 1.0, 1.0, 0)]
    best = fusion.fuse_boxes(spark.createDataFrame(rows, FUSED), 1, top=2, turn="turn").collect()
    assert sorted((r["category_id"], r["x"]) for r in best) == [(0, 100.0), (1, 300.0)]
    with pytest.raises(ValueError):
        fusion.fuse_boxes(boxes, 1, conf="median")


def precision_by_hand(rows, iou, most):
    """One category at a time: greedy matching, then the best precision at each of 101 recalls."""
    out = {}
    for cat in sorted({r[2] for r in rows if r[0] == "gold" and not r[8]}):
        marks, gold = [], 0
        for image in sorted({r[1] for r in rows}):
            g = [r for r in rows if r[:3] == ("gold", image, cat)]
            g.sort(key=lambda r: (r[8], r[9], r[3:7]))
            gold += sum(not r[8] for r in g)
            taken = set()
            for r in sorted((r for r in rows if r[:3] == ("predicted", image, cat)), key=lambda r: (-r[7], r[9]))[:most]:
                best, at = min(iou, 1 - 1e-10), None
                for k, o in enumerate(g):
                    if k in taken and not o[8] or at is not None and not g[at][8] and o[8]:
                        continue
                    a, b = ((z[3], z[4], z[3] + z[5], z[4] + z[6]) for z in (r, o))
                    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
                    both = max(w, 0) * max(h, 0)
                    v = both / (r[5] * r[6] if o[8] else r[5] * r[6] + o[5] * o[6] - both)
                    if v >= best:
                        best, at = v, k
                if at is None or not g[at][8]:
                    marks.append((-r[7], image, r[9], at is not None))
                if at is not None:
                    taken.add(at)
        marks.sort()
        right, curve = 0, []
        for n, m in enumerate(marks, 1):
            right += m[3]
            curve.append((right, right / n))
        out[cat] = sum(max((p for r, p in curve if 100 * r >= k * gold), default=0.0) for k in range(101)) / 101
    return out


def test_average_precision_equals_the_sequential_rule(spark):
    rng = random.Random(8)
    rows, turn = [], 0
    for i in range(240):
        image, cat, x, y = rng.randrange(6), rng.randrange(2), rng.randrange(60), rng.randrange(40)
        turn += 1
        rows.append(("gold", image, cat, float(x), float(y), 20.0, 20.0, 0.0, i % 9 == 0, turn))
        for _ in range(rng.randrange(3)):
            turn += 1
            rows.append(("predicted", image, cat, float(x + rng.randrange(-4, 5)), float(y + rng.randrange(4)), 20.0, float(rng.choice([18, 20, 22])), rng.randrange(12) / 12, False, turn))
    table = spark.createDataFrame(rows, BOX).repartition(5)
    for most in (100, 7):
        got = {(r["category_id"], r["iou"]): r["ap"] for r in metrics.average_precision(table, (0.5, 0.75, 0.9), max_dets=most).collect()}
        wanted = {(c, v): ap for v in (0.5, 0.75, 0.9) for c, ap in precision_by_hand(rows, v, most).items()}
        assert got == pytest.approx(wanted) and any(0 < v < 1 for v in got.values())
