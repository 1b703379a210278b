"""Paired bootstrap, noise estimates and the verdict over a pre-registered claim."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from runledger.functions.columns import draw_index, t_statistic


def numbered(rows: DataFrame, group: str, order: str, pieces: int = 64) -> DataFrame:
    """Numbers the rows of each group from 0 in ``order``, in pieces so that a large group is more than one task.

    Pieces are hash-free: they are cut by the first characters of ``order``'s digest,
    which only has to be the same everywhere; the number's order is (piece, order).
    """
    cut = rows.withColumn("piece", F.pmod(F.conv(F.substring(F.md5(F.col(order).cast("string").cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(pieces)))
    sizes = cut.groupBy(group, "piece").count()
    before = Window.partitionBy(group).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(group, "piece", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"), F.sum("count").over(Window.partitionBy(group)).alias("n"))
    place = F.row_number().over(Window.partitionBy(group, "piece").orderBy(order)) - 1
    return cut.withColumn("place", place).join(sizes, [group, "piece"]).withColumn("place", F.col("place") + F.col("before")).drop("piece", "before")


def paired_bootstrap(hits: DataFrame, baseline: str, candidate: str, draws: int = 200, seed: int = 0) -> DataFrame:
    """Difference of two runs' accuracy per subset and its standard error over the same resamples for both."""
    wide = hits.where(F.col("run_id").isin(baseline, candidate)).groupBy("subset", "sample_id").pivot("run_id", [baseline, candidate]).agg(F.first("hit"))
    pairs = numbered(wide.where(F.col(f"`{baseline}`").isNotNull() & F.col(f"`{candidate}`").isNotNull()), "subset", "sample_id")
    pairs = pairs.select("subset", "place", "n", (F.col(f"`{candidate}`") - F.col(f"`{baseline}`")).alias("d"))
    whole = pairs.groupBy("subset").agg(F.avg("d").alias("delta"), F.count("*").alias("n"))
    asked = pairs.select("subset", "n", "place", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    asked = asked.groupBy("subset", "draw", draw_index(seed, F.col("draw"), F.col("place"), F.col("n")).alias("place")).agg(F.count("*").alias("times"))
    resampled = asked.join(pairs.select("subset", "place", "n", "d"), ["subset", "place"]).groupBy("subset", "draw").agg((F.sum(F.col("d") * F.col("times")) / F.first("n")).alias("delta"))
    spread = resampled.groupBy("subset").agg(F.stddev_samp("delta").alias("se"))
    return whole.join(spread, "subset").select("subset", "n", "delta", "se", t_statistic(F.col("delta"), F.col("se")).alias("t"))


def bootstrap_spread(marks: DataFrame, metric: str = "macro_f1", draws: int = 200, seed: int = 0, least: int = 2) -> DataFrame:
    """How far one reading moves when its subset is resampled: per run and subset the value and ``se`` over the draws.

    ``marks``: run_id, subset, sample_id, gold, predicted. ``metric``: accuracy,
    macro_f1 (classes without gold samples in a draw are left out) or
    ``recall:<class>``, which a draw without that class refuses. Refused draws are
    counted in ``skipped``; where they exceed those used, or fewer than ``least``
    are left, ``se`` is null and ``refused`` true. Samples without gold are left out;
    all runs share the draws of a subset's samples.

    A draw is reduced to counts of (gold, predicted) before values are formed, so
    what is shuffled behind it doesn't grow with the samples.
    """
    known = marks.where("gold is not null")
    places = numbered(known.select("subset", "sample_id").distinct(), "subset", "sample_id").select("subset", "sample_id", "place", "n")
    asked = places.select("subset", "n", "place", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    asked = asked.groupBy("subset", "draw", draw_index(seed, F.col("draw"), F.col("place"), F.col("n")).alias("place")).agg(F.count("*").alias("times"))
    drawn = asked.join(places, ["subset", "place"]).select("subset", "sample_id", "draw", "times").join(known, ["subset", "sample_id"])
    whole = known.withColumns({"draw": F.lit(-1), "times": F.lit(1).cast("long")})
    columns = ["run_id", "subset", "draw", "gold", "predicted", "times"]
    cells = drawn.select(*columns).unionByName(whole.select(*columns)).groupBy(*columns[:-1]).agg(F.sum("times").alias("times"))
    keys = ["run_id", "subset", "draw"]
    hit = F.coalesce(F.col("gold") == F.col("predicted"), F.lit(False))
    if metric == "macro_f1":
        side = F.explode(F.array(F.struct(F.col("gold").alias("c"), F.lit(1).alias("own")), F.struct(F.col("predicted").alias("c"), F.lit(0).alias("own")))).alias("s")
        classes = cells.select(*keys, "times", hit.alias("hit"), side).where("s.c is not null").groupBy(*keys, "s.c").agg(F.sum(F.when(F.col("hit"), F.col("times")).otherwise(0)).alias("tp2"), F.sum("times").alias("all"), F.sum(F.col("times") * F.col("s.own")).alias("own"))
        # both sides of a hit are counted: tp2 is twice the true positives, all is 2 tp + fp + fn
        values = classes.groupBy(*keys).agg(F.avg(F.when(F.col("own") > 0, F.col("tp2") / F.col("all"))).alias("v"))
    elif metric == "accuracy":
        values = cells.groupBy(*keys).agg((F.sum(F.when(hit, F.col("times")).otherwise(0)) / F.sum("times")).alias("v"))
    elif metric.startswith("recall:"):
        own = F.col("gold").cast("string") == metric.removeprefix("recall:")
        values = cells.groupBy(*keys).agg(F.try_divide(F.sum(F.when(own & hit, F.col("times")).otherwise(0)), F.sum(F.when(own, F.col("times")).otherwise(0))).alias("v"))
    else:
        raise ValueError(f"no bootstrap of {metric}")
    is_draw = F.col("draw") >= 0
    used = F.count(F.when(is_draw, F.col("v")))
    out = values.groupBy("run_id", "subset").agg(F.max(F.when(~is_draw, F.col("v"))).alias("value"), used.alias("used"), (F.lit(draws) - used).alias("skipped"), F.stddev_samp(F.when(is_draw, F.col("v"))).alias("se"))
    refused = (F.col("skipped") > F.col("used")) | (F.col("used") < least)
    return out.select("run_id", "subset", "value", F.when(~refused, F.col("se")).alias("se"), "used", "skipped", refused.alias("refused"))


def sigma_split_half(values: DataFrame, first: str = "valA", second: str = "valB", least_runs: int = 3) -> DataFrame:
    """Noise of a reading: spread over runs of the difference of two halves, over the square root of 2; null under ``least_runs``."""
    wide = values.where(F.col("subset").isin(first, second)).groupBy("run_id").pivot("subset", [first, second]).agg(F.first("value"))
    diff = wide.select((F.col(first) - F.col(second)).alias("d")).where("d is not null")
    return diff.agg(F.count("*").alias("runs"), F.when(F.count("*") >= least_runs, F.stddev_samp("d") / F.sqrt(F.lit(2.0))).alias("sigma"))


def judge(bases: DataFrame, sigma: DataFrame, t_min: float = 2.0, min_bases: int = 2, ratio: float = 1.0) -> DataFrame:
    """PASS if enough subsets improve significantly and the mean improvement is at least the noise; else FAIL with reasons."""
    positive = ((F.col("delta") > 0) & (F.col("t") >= t_min)).cast("int")
    sums = bases.agg(F.sum(positive).alias("bases_positive"), F.avg("delta").alias("mean_delta"), F.count("*").alias("bases"))
    # both sides are single rows
    both = sums.crossJoin(F.broadcast(sigma.select("sigma")))
    few = F.when(F.col("bases_positive") < min_bases, F.lit("bases"))
    noise = F.when(F.col("sigma").isNull(), F.lit("no_sigma")).when(F.col("mean_delta") < ratio * F.col("sigma"), F.lit("sigma"))
    reasons = F.concat_ws(",", few, noise)
    return both.select("bases", "bases_positive", "mean_delta", "sigma", F.when(reasons == "", "PASS").otherwise("FAIL").alias("verdict"), reasons.alias("reasons"))
