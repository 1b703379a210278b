"""Masks against pixel by pixel rules."""

import random

import numpy as np
import pytest

from runledger.operators import masks

WIDE, TALL = 23, 17


def walked(ring):
    """Pixels of a ring: the whole outline on the fine grid first, then its passes of column middles, point by point."""
    fine = [(int(5 * x + 0.5), int(5 * y + 0.5)) for x, y in ring]
    points = []
    for (x0, y0), (x1, y1) in zip(fine, fine[1:] + fine[:1], strict=True):
        dx, dy = abs(x1 - x0), abs(y1 - y0)
        turned = x0 > x1 if dx >= dy else y0 > y1
        (a, b), (c, d) = ((x1, y1), (x0, y0)) if turned else ((x0, y0), (x1, y1))
        span = max(dx, dy)
        line = []
        for t in range(span + 1):
            if dx >= dy:
                line.append((a + t, int((2 * (b * dx + (d - b) * t) + dx) / (2 * dx)) if dx else b))
            else:
                line.append((int((2 * (a * dy + (c - a) * t) + dy) / (2 * dy)), b + t))
        points += line[::-1] if turned else line
    marks = []
    for (u, v), (p, q) in zip(points, points[1:], strict=False):
        low = min(u, p)
        if u != p and low % 5 == 2 and 0 <= low // 5 < WIDE:
            marks.append(low // 5 * TALL + min(max(-((2 - min(v, q)) // 5), 0), TALL))
    inside, out = False, set()
    for at in range(WIDE * TALL):
        inside ^= marks.count(at) % 2 == 1
        if inside:
            out.add(at)
    return out


def pixels(rows):
    return {p for r in rows for p in range(r["start"], r["start"] + r["len"])}


def test_polygons_equal_the_walk(spark):
    rng = random.Random(3)
    rings = {(0, 0): [(2, 2), (4, 2), (4, 4), (2, 4)], (0, 1): [(3, 3), (9, 3), (9, 8), (3, 8)], (1, 0): [(-4, -3), (40, 5), (10, 30)]}
    for m in range(2, 40):
        rings[(m, 0)] = [(round(rng.uniform(-5, WIDE + 5), 2), round(rng.uniform(-5, TALL + 5), 2)) for _ in range(rng.randrange(3, 8))]
    rows = [(m, r, i, float(x), float(y)) for (m, r), ring in rings.items() for i, (x, y) in enumerate(ring)]
    rows += [(90, 0, 0, 1.0, 1.0), (90, 0, 1, 5.0, 5.0), (91, 0, 0, 1.0, 1.0), (91, 0, 1, None, 3.0), (91, 0, 2, 9.0, 9.0)]
    table = spark.createDataFrame(rows, "mask long, ring int, place int, x double, y double").repartition(7)
    got = {}
    for r in masks.polygon_runs(table, ["mask"], WIDE, TALL).collect():
        got.setdefault((r["mask"], r["ring"]), []).append(r)
    for key, ring in rings.items():
        assert pixels(got.get(key, [])) == walked(ring), key
    assert set(got) <= set(rings) and len(pixels(got[(0, 0)])) == 4
    union = masks.united(masks.polygon_runs(table, ["mask"], WIDE, TALL), ["mask"]).where("mask = 0").collect()
    assert pixels(union) == walked(rings[(0, 0)]) | walked(rings[(0, 1)]) and sum(r["len"] for r in union) == len(pixels(union))


def decoded(text):
    """Counts of a compressed text, character by character."""
    counts, i = [], 0
    while i < len(text):
        value, shift, more = 0, 0, True
        while more:
            c = ord(text[i]) - 48
            value |= (c & 31) << shift
            shift += 5
            more = c & 32
            i += 1
            if not more and c & 16:
                value -= 1 << shift
        counts.append(value + (counts[-2] if len(counts) > 2 else 0))
    return counts


def test_texts_round_trip(spark):
    rng = random.Random(4)
    size = 3_000_000
    runs, wanted = [], {}
    for m in range(30):
        at = rng.choice([0, 5])
        for _ in range(rng.randrange(1, 12)):
            n = rng.choice([1, 3, 40, 900, 20_000, 130_000])
            if at + n > size:
                break
            runs.append((m, at, n))
            wanted.setdefault(m, set()).add((at, n))
            at += n + rng.choice([1, 17, 600, 70_000])
    runs.append((30, 0, size))
    wanted[30] = {(0, size)}
    table = spark.createDataFrame(runs, "mask long, start long, len long").repartition(5)
    counts = masks.counts_of(masks.united(table, ["mask"]), ["mask"], size)
    texts = counts.select("mask", "counts", masks.text_of().alias("text")).cache()
    for r in texts.collect():
        assert decoded(r["text"]) == r["counts"] and sum(r["counts"]) == size
    got = {}
    for r in masks.runs_of_text(texts, ["mask"], "text", size).collect():
        assert r["problem"] is None
        got.setdefault(r["mask"], set()).add((r["start"], r["len"]))
    assert got == wanted


def test_bad_texts_are_named(spark):
    rows = [(0, None), (1, " "), (2, "0~"), (3, "0o"), (4, "00O5"), (5, "05"), (6, "55"), (7, ":")]
    got = {r["mask"]: r["problem"] for r in masks.runs_of_text(spark.createDataFrame(rows, "mask long, text string"), ["mask"], "text", 10).collect()}
    assert got == {0: "empty", 1: "empty", 2: "bad_character", 3: "torn", 4: "negative", 5: "wrong_size", 6: None}


def test_overlap_by_pixels(spark):
    rng = random.Random(9)
    rows = [(s, rng.randrange(3), rng.randrange(2), rng.randrange(300), rng.randrange(60)) for s in ("gold", "predicted") for _ in range(40)]
    table = spark.createDataFrame(rows, "side string, image_id long, category_id int, start long, len long")
    for bucket in (7, 64, 4096):
        for r in masks.overlap(table, bucket).collect():
            g, p = ({(i, x) for s, i, c, at, n in rows if s == side and c == r["category_id"] for x in range(at, at + n)} for side in ("gold", "predicted"))
            assert r["shared"] == len(g & p) and r["dice"] == pytest.approx(2 * len(g & p) / (len(g) + len(p))) and r["iou"] == pytest.approx(len(g & p) / len(g | p))


def test_runs_meet_no_window_and_no_pairs(spark):
    """Only corners are shuffled for runs, texts are read where they are, and overlaps pair no runs."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    corners = spark.createDataFrame([(0, 0, 0, 1.0, 1.0)], "mask long, ring int, place int, x double, y double")
    runs = plan(masks.polygon_runs(corners, ["mask"], WIDE, TALL))
    assert "Window" not in runs and runs.count("Exchange ") == 1
    read = plan(masks.runs_of_text(spark.createDataFrame([(0, "05")], "mask long, text string"), ["mask"], "text", 5))
    assert "Window" not in read and "Exchange" not in read
    both = spark.createDataFrame([("gold", 0, 0, 0, 5)], "side string, image_id long, category_id int, start long, len long")
    assert "Join" not in plan(masks.overlap(both))


def test_long_numbers_and_missing_values(spark):
    rows = [(0, "o" * 12 + "0"), (1, "o" * 12 + "O"), (2, "0" + "P" * 12 + "1"), (3, "0" + "P" * 12 + "@"), (4, " 05PP0 "), (5, "")]
    got = [tuple(r)[1:] for r in masks.runs_of_text(spark.createDataFrame(rows, "mask long, text string"), ["mask"], "text", 5).orderBy("mask").collect()]
    assert got == [(None, None, p) for p in ("wrong_size", "negative", "wrong_size", "negative")] + [(0, 5, None), (None, None, "empty")]
    counts = [(0, [0, 5]), (1, None), (2, []), (3, [1 << 40, 3, 1 << 34, 1, 2, 1 << 29])]
    texts = [r["text"] for r in spark.createDataFrame(counts, "mask long, counts array<long>").select("mask", masks.text_of().alias("text")).orderBy("mask").collect()]
    assert texts[:3] == ["05", None, ""] and decoded(texts[3]) == counts[3][1]


def test_crossings_in_parts(monkeypatch):
    rng = random.Random(2)
    sizes = np.array([rng.randrange(3, 9) for _ in range(40)])
    x, y = (np.array([rng.randrange(-20, 5 * n + 20) for _ in range(sizes.sum())]) for n in (WIDE, TALL))
    whole = masks._crossed(x, y, np.cumsum(sizes) - sizes, sizes, WIDE, TALL)
    monkeypatch.setattr(masks, "AT_ONCE", 30)
    for a, b in zip(whole, masks._crossed(x, y, np.cumsum(sizes) - sizes, sizes, WIDE, TALL), strict=True):
        assert (a == b).all() and len(a) > 100
