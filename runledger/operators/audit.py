"""Near duplicates by 64-bit hashes and geometry checks of boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (first bit, bits) of five disjoint bands: hashes within distance 4 agree in one of them.
BANDS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))


def _banded(hashes: DataFrame) -> DataFrame:
    bands = [F.struct(F.lit(i).alias("band"), F.shiftrightunsigned(F.shiftleft("h", first), 64 - bits).alias("v")) for i, (first, bits) in enumerate(BANDS)]
    return hashes.withColumn("b", F.explode(F.array(*bands))).select("*", "b.band", "b.v").drop("b")


def near_pairs(left: DataFrame, right: DataFrame | None = None, most: int = 4) -> DataFrame:
    """Pairs of different hashes at Hamming distance up to 4 (``most``), each with the rows that carry it.

    Equal hashes are one class with a count, so copies are never paired. Without
    ``right`` the table is held against itself and a pair comes once.
    """
    if most > len(BANDS) - 1:
        raise ValueError("five bands find distances up to 4")
    classes = lambda df, h, n: df.groupBy(F.col("h")).agg(F.count("*").alias("n")).select("h", "n")
    a = _banded(classes(left, "h", "n")).select("band", "v", F.col("h").alias("h_a"), F.col("n").alias("n_a"))
    b = _banded(classes(left if right is None else right, "h", "n")).select("band", "v", F.col("h").alias("h_b"), F.col("n").alias("n_b"))
    distance = F.bit_count(F.col("h_a").bitwiseXOR(F.col("h_b")))
    met = a.join(b, ["band", "v"]).where(distance <= most)
    met = met.where("h_a < h_b") if right is None else met
    return met.select("h_a", "h_b", "n_a", "n_b", distance.cast("int").alias("distance")).distinct()


def box_problems(boxes: DataFrame, width: int = 640, height: int = 480) -> DataFrame:
    """The first problem of every box in the order of precedence; sound boxes have none and are left out."""
    x, y, w, h = (F.col(c) for c in ("x", "y", "w", "h"))
    problem = (
        F.when((w <= 0) | (h <= 0), "non_positive")
        .when((x < -1) | (y < -1), "negative_origin")
        .when((x + w > width + 1) | (y + h > height + 1), "out_of_bounds")
        .when((w < 2) | (h < 2), "tiny")
        .when(F.greatest(w, h) > 20 * F.least(w, h), "aspect")
        .when(w * h >= 0.98 * width * height, "covers")
    )
    return boxes.withColumn("problem", problem).where("problem is not null")


def duplicate_boxes(boxes: DataFrame) -> DataFrame:
    """Boxes of one image, category and place that occur more than once."""
    return boxes.groupBy("l_orderkey", "category_id", "x", "y", "w", "h").agg(F.count("*").alias("n")).where("n > 1")
