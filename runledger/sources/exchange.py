"""Exchange formats as table transforms: COCO, YOLO and CSV boxes, categories of CSV labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from runledger.operators.statistics import numbered


def category_order(values: DataFrame, column: str = "value") -> DataFrame:
    """Ids from 0 for the distinct values of a label column: whole numbers first by size, then texts. One row a category."""
    whole = F.col(column).rlike(r"^-?[0-9]+$")
    order = Window.orderBy((~whole).cast("int"), F.when(whole, F.expr(f"try_cast(`{column}` as decimal(38,0))")), column)
    return values.where(F.col(column).isNotNull()).select(column).distinct().withColumn("category_id", F.row_number().over(order) - 1)


def inferred_task(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``cls`` for one column of whole numbers, ``multilabel`` where all values are 0 or 1, else ``regression``; blanks around a value don't count, a plus sign is no whole number."""
    all_ = lambda pattern: F.bool_and(F.array_min(F.array(*[F.coalesce(F.trim(F.col(c)).rlike(pattern), F.lit(False)) for c in columns])))
    found = rows.agg(all_(r"^-?[0-9]+$").alias("whole"), all_(r"^(0|1|0\.0|1\.0)$").alias("binary"))
    return found.select(F.when(F.lit(len(columns) == 1) & F.col("whole"), "cls").when(F.col("binary"), "multilabel").otherwise("regression").alias("task"))


def coco_images(boxes: DataFrame, group: str) -> DataFrame:
    """Image numbers from 1 in the order of the images, for all distinct images of a group column; numbered in pieces."""
    images = boxes.select(F.col(group).alias("sample_id")).distinct().withColumn("all", F.lit(1))
    return numbered(images, "all", "sample_id").select("sample_id", (F.col("place") + 1).alias("image_id"))


def coco_annotations(boxes: DataFrame, images: DataFrame, order: list[str]) -> DataFrame:
    """Annotations with their image's number, a number of their own from 1 by image and ``order``, and area.

    Counts by image come first, so that each image is numbered by itself.
    """
    own = boxes.join(images, "sample_id")
    counts = own.groupBy("image_id").agg(F.count("*").alias("n"))
    # runs of images: a running sum over the runs, then within each run
    counts = counts.withColumn("run", F.floor(F.col("image_id") / 4096))
    within = Window.partitionBy("run").orderBy("image_id").rowsBetween(Window.unboundedPreceding, -1)
    runs = counts.groupBy("run").agg(F.sum("n").alias("m"))
    runs = runs.select("run", F.coalesce(F.sum("m").over(Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("above"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(within), F.lit(0))).join(runs, "run").select("image_id", (F.col("before") + F.col("above")).alias("before"))
    turn = F.row_number().over(Window.partitionBy("image_id").orderBy(*order))
    return own.withColumn("turn", turn).join(before, "image_id").select((F.col("before") + F.col("turn")).alias("annotation_id"), "image_id", "category_id", "x", "y", "w", "h", (F.col("w") * F.col("h")).alias("area"))


def coco_joined(annotations: DataFrame, images: DataFrame) -> DataFrame:
    """Annotations under their image's file name; ``file_name`` is null where the image isn't known (those are skipped on import)."""
    return annotations.join(images.select("image_id", "file_name"), "image_id", "left")


def repeated_names(images: DataFrame, column: str = "file_name") -> DataFrame:
    """Names that more than one image has: an import or export refuses these."""
    return images.groupBy(column).agg(F.count("*").alias("n")).where("n > 1")


def yolo_file(path: Column) -> Column:
    """The label file of an image path: folders are joined by two underscores."""
    return F.concat(F.regexp_replace(F.replace(path, F.lit("/"), F.lit("__")), r"\.[^.]*$", ""), F.lit(".txt"))


def yolo_lines(boxes: DataFrame, width: int, height: int) -> DataFrame:
    """One text line a box: class, centre and size as fractions of the image with six digits."""
    part = lambda c: F.format_string("%.6f", c.cast("double"))
    x, y, w, h = (F.col(c) for c in "xywh")
    line = F.concat_ws(" ", F.col("category_id").cast("string"), part((x + w / 2) / width), part((y + h / 2) / height), part(w / width), part(h / height))
    return boxes.withColumn("line", line)


def yolo_boxes(lines: DataFrame, width: int, height: int) -> DataFrame:
    """Boxes in pixels from such lines; a line that doesn't parse has nulls."""
    part = lambda i: F.expr(f"try_cast(try_element_at(split(line, ' '), {i}) as double)")
    cx, cy, w, h = part(2) * width, part(3) * height, part(4) * width, part(5) * height
    return lines.withColumns({"category_id": F.expr("try_cast(try_element_at(split(line, ' '), 1) as int)"), "x": cx - w / 2, "y": cy - h / 2, "w": w, "h": h})


def box_values(form: str) -> dict[str, Column]:
    """The four numbers of a box in pixels as ``xywh``, ``xyxy`` or ``cxcywh``."""
    x, y, w, h = (F.col(c).cast("double") for c in "xywh")
    forms = {"xywh": (x, y, w, h), "xyxy": (x, y, x + w, y + h), "cxcywh": (x + w / 2, y + h / 2, w, h)}
    return dict(zip("abcd", forms[form], strict=True))


def absolute_box(form: str, width: float = 1, height: float = 1) -> dict[str, Column]:
    """The inverse of :func:`box_values`; fractions of an image are scaled by its size."""
    a, b, c, d = (F.col(x).cast("double") * s for x, s in zip("abcd", (width, height, width, height), strict=True))
    forms = {"xywh": (a, b, c, d), "xyxy": (a, b, c - a, d - b), "cxcywh": (a - c / 2, b - d / 2, c, d)}
    return dict(zip("xywh", forms[form], strict=True))
