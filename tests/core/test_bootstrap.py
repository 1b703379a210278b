"""Bootstrap spreads against explicit resampling of the rows."""

import hashlib
import random
import statistics as st

import pytest

from runledger.operators import statistics

DRAWS = 40


def md5(x):
    return hashlib.md5(x.encode()).hexdigest()


def value(metric, rows):
    """A metric of (gold, predicted) rows, None where it is undefined."""
    if metric == "accuracy":
        return sum(g == p for g, p in rows) / len(rows)
    if metric.startswith("recall:"):
        own = [p for g, p in rows if str(g) == metric[7:]]
        return sum(str(p) == metric[7:] for p in own) / len(own) if own else None
    out = []
    for c in {g for g, _ in rows}:
        tp, fp, fn = (sum(f(g == c, p == c) for g, p in rows) for f in (lambda a, b: a and b, lambda a, b: not a and b, lambda a, b: a and not b))
        out.append(2 * tp / (2 * tp + fp + fn))
    return sum(out) / len(out)


@pytest.mark.parametrize("metric", ["accuracy", "macro_f1", "recall:7"])
def test_spread_equals_explicit_resampling(spark, metric):
    rng = random.Random(2)
    rows = [(run, sub, f"s{i}", 7 if i == 3 else i % 3, rng.choice([0, 1, 2, 7])) for run in ("a", "b") for sub, n in (("x", 25), ("y", 9)) for i in range(n)]
    rows += [("a", "x", "none", None, 1), ("a", "z", "s1", 1, 1)]
    table = spark.createDataFrame(rows, "run_id string, subset string, sample_id string, gold int, predicted int")
    got = {(r["run_id"], r["subset"]): r for r in statistics.bootstrap_spread(table.repartition(3), metric, draws=DRAWS).collect()}
    keys = {(r[0], r[1]) for r in rows}
    assert set(got) == keys
    for run, sub in keys:
        ids = sorted({r[2] for r in rows if r[1] == sub and r[3] is not None}, key=lambda x: (int(md5(x)[:8], 16) % 64, x))
        of = {r[2]: (r[3], r[4]) for r in rows if r[:2] == (run, sub)}
        values = [value(metric, [of[ids[int(md5(f"0|{k}|{i}")[:8], 16) % len(ids)]] for i in range(len(ids))]) for k in range(DRAWS)]
        used = [v for v in values if v is not None]
        r = got[run, sub]
        assert r["value"] == (None if (v := value(metric, [of[i] for i in ids])) is None else pytest.approx(v))
        assert (r["used"], r["skipped"]) == (len(used), DRAWS - len(used))
        assert r["refused"] == (len(used) < max(2, DRAWS - len(used)))
        assert r["se"] is None if r["refused"] else r["se"] == pytest.approx(st.stdev(used), abs=1e-12)


def test_unknown_metric(spark):
    with pytest.raises(ValueError):
        statistics.bootstrap_spread(spark.createDataFrame([], "run_id string, subset string, sample_id string, gold int, predicted int"), "beauty")
