"""Record formats: wide score tables, box conventions, JSON lines with exact row digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON lines file with the digest of each exact line; lines that don't parse have a null record."""
    return spark.read.text(path).select(F.sha2(F.concat("value", F.lit("\n")).cast("binary"), 256).alias("row_sha256"), F.from_json("value", schema).alias("record")).select("row_sha256", "record.*")


def write_jsonl(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.text(path)


def scores_wide(scores: DataFrame, classes: list[int]) -> DataFrame:
    """One row per run and sample, one column per class."""
    return scores.groupBy("run_id", "sample_id").pivot("cls_id", classes).agg(F.first("raw")).select("run_id", "sample_id", *[F.col(str(c)).alias(f"class_{c}") for c in classes])


def scores_long(wide: DataFrame, classes: list[int]) -> DataFrame:
    return wide.select("run_id", "sample_id", F.explode(F.array(*[F.struct(F.lit(c).alias("cls_id"), F.col(f"class_{c}").alias("raw")) for c in classes])).alias("x")).select("run_id", "sample_id", "x.*")


def yolo_columns(x: Column, y: Column, w: Column, h: Column, width: int, height: int) -> tuple[Column, Column, Column, Column]:
    """Centre and size as fractions of the image, from a top-left box in pixels."""
    return (x + w / 2) / width, (y + h / 2) / height, w / width, h / height


def box_formats(boxes: DataFrame, width: int = 640, height: int = 480) -> DataFrame:
    """Boxes as corners and as fractions, rounded to eight digits."""
    cx, cy, fw, fh = yolo_columns(*(F.col(c).cast("double") for c in ("x", "y", "w", "h")), width, height)
    corners = ((F.col("x") + F.col("w")).alias("x2"), (F.col("y") + F.col("h")).alias("y2"))
    return boxes.select("l_orderkey", "l_linenumber", "category_id", *corners, *(F.round(c, 8).alias(n) for c, n in ((cx, "cx"), (cy, "cy"), (fw, "fw"), (fh, "fh"))))


def export_ids(boxes: DataFrame) -> DataFrame:
    """Images of an export with their box counts and covered area."""
    return boxes.groupBy(F.col("l_orderkey").alias("image_id")).agg(F.count("*").alias("boxes"), F.sum(F.col("w") * F.col("h")).alias("area"), F.countDistinct("category_id").alias("categories"))
