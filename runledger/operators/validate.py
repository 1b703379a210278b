"""Checks of records: labels by task, polygons, predictions, subsets; each gives rows of problems."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SEVERITY = ("PASS", "WARN", "FAIL")


def unknown_classes(samples: DataFrame, categories: DataFrame) -> DataFrame:
    """Samples whose class is missing or no declared category (a table of ``cls``; no size is assumed)."""
    return samples.join(categories.select("cls"), "cls", "left_anti").select("sample_id", "cls", F.when(F.col("cls").isNull(), "no_class").otherwise("unknown_class").alias("problem"))


def multilabel_problems(values: DataFrame, names: list[str]) -> DataFrame:
    """Samples (sample_id, name, value) whose names aren't exactly the declared ones, or with values other than 0 and 1."""
    known = F.col("name").isin(*names)
    own = values.groupBy("sample_id").agg(F.countDistinct(F.when(known, F.col("name"))).alias("have"), F.sum((~known).cast("long")).alias("strange"), F.sum((~F.coalesce(F.col("value").isin(0.0, 1.0), F.lit(False))).cast("long")).alias("other"))
    problem = F.when(F.col("strange") > 0, "unknown_name").when(F.col("have") < len(names), "missing_name").when(F.col("other") > 0, "not_binary")
    return own.select("sample_id", problem.alias("problem")).where("problem is not null")


def regression_problems(samples: DataFrame, values: DataFrame, names: list[str]) -> DataFrame:
    """Samples without a target, with a target that isn't declared, or one that isn't finite."""
    finite = F.coalesce(~F.isnan("value") & (F.abs("value") < F.lit(float("inf"))), F.lit(False))
    own = values.groupBy("sample_id").agg(F.sum((~F.col("name").isin(*names)).cast("long")).alias("strange"), F.sum((~finite).cast("long")).alias("odd"))
    problem = F.when(F.col("strange").isNull(), "no_target").when(F.col("strange") > 0, "unknown_name").when(F.col("odd") > 0, "not_finite")
    return samples.select("sample_id").join(own, "sample_id", "left").select("sample_id", problem.alias("problem")).where("problem is not null")


def detection_problems(boxes: DataFrame, categories: list[int], views: int, width: int, height: int) -> DataFrame:
    """Boxes of an unknown view or category, without area, or more than a pixel outside the image; the first of these counts."""
    x, y, w, h = (F.col(c) for c in "xywh")
    outside = (x < -1) | (y < -1) | (x + w > width + 1) | (y + h > height + 1)
    problem = F.when((F.col("view") < 0) | (F.col("view") >= views), "no_view").when(~F.col("category_id").isin(*categories), "unknown_category").when((w <= 0) | (h <= 0), "no_area").when(outside, "outside")
    return boxes.withColumn("problem", problem).where("problem is not null")


def inconsistent_samples(samples: DataFrame, label: str = "quality") -> DataFrame:
    """A label source of none must mean no label, and any other source a label."""
    return samples.where((F.col("label_source") == "none") == F.col(label).isNotNull()).select("sample_id", "label_source")


def repeated_places(views: DataFrame, sequence: str, index: str) -> DataFrame:
    """Places of a sequence that several views claim."""
    return views.groupBy(sequence, index).agg(F.count("*").alias("n")).where("n > 1")


def polygon_facts(vertices: DataFrame, width: int, height: int) -> DataFrame:
    """Area by the shoelace formula and the first problem of each ring (polygon_id, place, x, y): under three vertices, or one more than a pixel outside the image."""
    ring = Window.partitionBy("polygon_id").orderBy("place")
    near = vertices.withColumns({"nx": F.lead("x").over(ring), "ny": F.lead("y").over(ring)})
    first = F.min(F.struct("place", "x", "y"))
    last = F.max(F.struct("place", "x", "y"))
    outside = F.max(((F.col("x") < -1) | (F.col("y") < -1) | (F.col("x") > width + 1) | (F.col("y") > height + 1)).cast("int"))
    own = near.groupBy("polygon_id").agg(F.count("*").alias("n"), F.sum(F.col("x") * F.col("ny") - F.col("nx") * F.col("y")).alias("s"), first.alias("f"), last.alias("l"), outside.alias("out"))
    area = F.abs(F.coalesce("s", F.lit(0.0)) + F.col("l.x") * F.col("f.y") - F.col("f.x") * F.col("l.y")) / 2
    problem = F.when(F.col("n") < 3, "degenerate_ring").when(F.col("out") == 1, "vertex_outside")
    return own.select("polygon_id", "n", area.alias("area"), problem.alias("problem"))


def prediction_problems(predictions: DataFrame, samples: DataFrame) -> DataFrame:
    """Predictions of repeated or unknown samples, and samples without a prediction."""
    counts = predictions.groupBy("sample_id").agg(F.count("*").alias("n"))
    both = counts.join(samples.select("sample_id", F.lit(1).alias("known")), "sample_id", "full_outer")
    problem = F.when(F.col("known").isNull(), "unknown").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "repeated")
    return both.select("sample_id", problem.alias("problem")).where("problem is not null")


def clean_subsets(plan: DataFrame, trained_on: DataFrame) -> DataFrame:
    """Subsets of a plan (subset, role, sample_id) to evaluate on: not for training, not trained on, and sharing no sample with those (``trained_on``: run_id, subset)."""
    held = plan.where("role <> 'train'")
    # which subsets share samples is settled first, at most one row a pair of subsets, so that no run meets a sample
    kept = F.collect_set(F.when(F.col("role") != "train", F.col("subset")))
    sets = plan.where("sample_id is not null").groupBy("sample_id").agg(F.sort_array(F.collect_set("subset")).alias("all"), F.sort_array(kept).alias("kept")).select("all", "kept").distinct()
    shared = sets.select(F.explode("all").alias("subset"), "kept").select("subset", F.explode("kept").alias("other")).distinct()
    touched = trained_on.join(F.broadcast(shared), "subset").select("run_id", F.col("other").alias("subset")).distinct()
    # a plan has a few subsets
    names = [F.lit(r["subset"]) for r in held.select("subset").distinct().collect()]
    runs = trained_on.select("run_id").distinct().select("run_id", F.explode(F.array(*names)).alias("subset"))
    return runs.join(touched, ["run_id", "subset"], "left_anti").join(trained_on.select("run_id", "subset"), ["run_id", "subset"], "left_anti")


def audit(checks: dict[str, DataFrame], severity: dict[str, int]) -> DataFrame:
    """One row a check with its problems and status; an empty check passes. ``status`` of the row ``all`` is the worst."""
    counted = reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("problems")).select(F.lit(name).alias("check"), "problems", F.when(F.col("problems") > 0, F.lit(severity[name])).otherwise(0).alias("level")) for name, df in checks.items()])
    worst = counted.agg(F.sum("problems").alias("problems"), F.max("level").alias("level")).select(F.lit("all").alias("check"), "problems", "level")
    return counted.union(worst).select("check", "problems", F.element_at(F.array(*map(F.lit, SEVERITY)), F.col("level") + 1).alias("status"))
