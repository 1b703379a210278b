"""Metrics of predictions against gold labels, one value per run and subset.

Scores are in long form (run_id, subset, sample_id, gold, cls_id, raw). All
metrics aggregate partially on the map side and shuffle one row per sample at
most; none is NaN: what is undefined is null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from runledger.operators.masks import overlap as mask_overlap  # noqa: F401  (kept under the name of before)
from runledger.storage import written

KEYS = ("run_id", "subset")


def argmax(scores: DataFrame) -> DataFrame:
    """The predicted class of every sample; of equal scores the first class counts."""
    best = F.max(F.struct("raw", (-F.col("cls_id")).alias("n")))
    return scores.groupBy(*KEYS, "sample_id").agg(F.first("gold").alias("gold"), best.alias("best")).select(*KEYS, "sample_id", "gold", (-F.col("best.n")).alias("predicted"))


def hits(scores: DataFrame) -> DataFrame:
    return argmax(scores).select(*KEYS, "sample_id", (F.col("gold") == F.col("predicted")).cast("int").alias("hit"))


def accuracy(scores: DataFrame) -> DataFrame:
    return hits(scores).groupBy(*KEYS).agg(F.avg("hit").alias("value"), F.count("*").alias("n_samples"))


def per_class(scores: DataFrame) -> DataFrame:
    """True and false positives and negatives and F1 per class; F1 is null for a class without gold samples."""
    marks = argmax(scores).withColumn("c", F.explode(F.array_distinct(F.array("gold", "predicted"))))
    count = lambda cond: F.sum(cond.cast("long"))
    own, said = F.col("c") == F.col("gold"), F.col("c") == F.col("predicted")
    sums = marks.groupBy(*KEYS, F.col("c").alias("cls_id")).agg(count(own & said).alias("tp"), count(~own & said).alias("fp"), count(own & ~said).alias("fn"))
    f1 = F.when(F.col("tp") + F.col("fn") > 0, 2.0 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn")))
    return sums.withColumn("f1", f1)


def macro_f1(scores: DataFrame) -> DataFrame:
    return per_class(scores).groupBy(*KEYS).agg(F.avg("f1").alias("value"))


def log_loss(scores: DataFrame) -> DataFrame:
    """Scores over their sum are probabilities, clipped to [1e-15, 1] and normalised again."""
    total = scores.groupBy(*KEYS, "sample_id").agg(F.sum("raw").alias("total"))
    p = F.least(F.greatest(F.col("raw") / F.col("total"), F.lit(1e-15)), F.lit(1.0))
    clipped = scores.join(total, [*KEYS, "sample_id"]).withColumn("p", p)
    rows = clipped.groupBy(*KEYS, "sample_id").agg(F.sum("p").alias("all"), F.sum(F.when(F.col("cls_id") == F.col("gold"), F.col("p"))).alias("own"))
    return rows.groupBy(*KEYS).agg((-F.avg(F.log(F.col("own") / F.col("all")))).alias("value"))


def class_auc(scores: DataFrame) -> DataFrame:
    """ROC area per class with average ranks for ties; null where a class has only positives or only negatives.

    Rows are counted per distinct score before the running sum, so a window
    partition holds distinct scores and not samples.
    """
    own = (F.col("gold") == F.col("cls_id")).cast("long")
    counts = scores.groupBy(*KEYS, "cls_id", "raw").agg(F.sum(own).alias("pos"), F.sum(1 - own).alias("neg"))
    below = Window.partitionBy(*KEYS, "cls_id").orderBy("raw").rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts.withColumn("below", F.coalesce(F.sum("neg").over(below), F.lit(0)))
    sums = ranked.groupBy(*KEYS, "cls_id").agg(F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2.0)).alias("u"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return sums.select(*KEYS, "cls_id", F.try_divide("u", F.col("pos") * F.col("neg")).alias("auc"))


def macro_auc(scores: DataFrame) -> DataFrame:
    return class_auc(scores).groupBy(*KEYS).agg(F.avg("auc").alias("value"))


def regression(targets: DataFrame) -> DataFrame:
    """Root mean square and mean absolute error over all samples and targets of a subset."""
    off = F.col("predicted") - F.col("gold")
    return targets.groupBy("subset").agg(F.sqrt(F.avg(off * off)).alias("rmse"), F.avg(F.abs(off)).alias("mae"), F.count("*").alias("n"))


POINTS = 101


def _matched(kept: DataFrame, ious: tuple[float, ...]) -> DataFrame:
    """Detections with the thresholds at which they have a gold box of their own (bits of ``hit``) or only meet a crowd (``out``).

    A detection of place k in its image and category needs its k best gold boxes
    at most, as those before it hold fewer than k; so a group's list of pairs is
    bounded by the detections kept, not by its gold boxes.
    """
    group = ["image_id", "category_id"]
    said = kept.where("side = 'predicted'").select(*group, "place", "score", "turn", *[F.col(c).alias(f"p{c}") for c in "xywh"])
    gold = kept.where("side = 'gold'").select(*group, "crowd", F.col("turn").alias("gturn"), *[F.col(c).alias(f"g{c}") for c in "xywh"]).withColumn("gold_id", F.struct("gturn", "gx", "gy", "gw", "gh"))
    wide = F.least(F.expr("px + pw"), F.expr("gx + gw")) - F.greatest("px", "gx")
    tall = F.least(F.expr("py + ph"), F.expr("gy + gh")) - F.greatest("py", "gy")
    both = F.greatest(wide, F.lit(0.0)) * F.greatest(tall, F.lit(0.0))
    union = F.when(F.col("crowd"), F.expr("pw * ph")).otherwise(F.expr("pw * ph + gw * gh") - both)
    met = said.join(gold, group).withColumn("iou", both / F.greatest(union, F.lit(1e-300))).where(F.col("iou") >= min(ious))
    # of equal overlaps the last gold box counts
    near = Window.partitionBy(*group, "place", "crowd").orderBy(F.desc("iou"), F.desc("gold_id"))
    pairs = met.withColumn("near", F.row_number().over(near)).where("near <= place")
    lists = pairs.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("place", F.col("crowd").cast("int").alias("crowd"), "near", "iou", "gold_id"))).alias("pairs"))
    # pairs by detection, gold boxes before crowds, best first: a detection takes the first free one
    taken = "transform(filter({s}, m -> m.crowd = 0), m -> m.gold_id)"
    step = "(s, p) -> if(size(s) > 0 and element_at(s, -1).place = p.place or p.crowd = 0 and array_contains(" + taken.format(s="s") + ", p.gold_id), s, array_append(s, p))"
    matches = F.transform(F.array(*[F.lit(float(min(v, 1 - 1e-10))) for v in ious]), lambda t: F.filter("pairs", lambda p: p["iou"] >= t))
    lists = lists.withColumn("open", matches)
    lists = lists.withColumn("own", F.expr(f"transform(open, l -> aggregate(l, slice(l, 1, 0), {step}))"))
    one = lists.select(*group, F.posexplode("own").alias("k", "l")).select(*group, "k", F.explode("l").alias("m"))
    bit = F.expr("shiftleft(1L, k)")
    marks = one.groupBy(*group, F.col("m.place").alias("place")).agg(F.sum(F.when(F.col("m.crowd") == 0, bit).otherwise(0)).alias("hit"), F.sum(F.when(F.col("m.crowd") == 1, bit).otherwise(0)).alias("out"))
    return said.select(*group, "place", "score", "turn").join(marks, [*group, "place"], "left").na.fill(0, ["hit", "out"])


def average_precision(boxes: DataFrame, ious: tuple[float, ...] = tuple(round(0.5 + 0.05 * i, 2) for i in range(10)), max_dets: int = 100) -> DataFrame:
    """Average precision of every category and threshold, interpolated at 101 recalls.

    ``boxes``: side (gold or predicted), image_id, category_id, x, y, w, h, score,
    crowd and turn (the order among equal scores, and of equal overlaps). The
    ``max_dets`` best of an image and category count. A detection that only meets
    a crowd box is neither right nor wrong. Categories without gold boxes are left out.

    Detections are cut into ranges of (category, falling score, image, turn);
    precision is summed within a range, then ranges are put together, so no
    category is in one task.
    """
    best = F.row_number().over(Window.partitionBy("image_id", "category_id").orderBy(F.desc("score"), "turn"))
    typed = boxes.select("side", F.col("image_id").cast("long").alias("image_id"), F.col("category_id").cast("int").alias("category_id"), *[F.col(c).cast("double").alias(c) for c in "xywh"], F.col("score").cast("double").alias("score"), F.coalesce(F.col("crowd").cast("boolean"), F.lit(False)).alias("crowd"), F.col("turn").cast("long").alias("turn"))
    said = typed.where("side = 'predicted'").withColumn("place", best).where(F.col("place") <= max_dets)
    kept = said.unionByName(typed.where("side = 'gold'").withColumn("place", F.lit(None).cast("int")))
    gold = typed.where("side = 'gold' and not crowd").groupBy("category_id").agg(F.count("*").alias("gold"))
    ranged = _matched(kept, ious).repartitionByRange("category_id", F.desc("score"), "image_id", "turn").withColumn("piece", F.spark_partition_id())
    ranged = written(ranged, "detections").join(gold, "category_id")
    every = range(len(ious))
    right, live = ([F.expr(f"shiftright({c}, {k}) & 1") for k in every] for c in ("hit", "out"))
    live = [1 - x for x in live]
    keys = ["category_id", "piece"]
    sums = ranged.groupBy(*keys).agg(*[F.sum(right[k]).alias(f"r{k}") for k in every], *[F.sum(live[k]).alias(f"a{k}") for k in every])
    above = Window.partitionBy("category_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*keys, *[F.coalesce(F.sum(f"{c}{k}").over(above), F.lit(0)).alias(f"{c}{k}") for c in "ra" for k in every])
    down = Window.partitionBy(*keys).orderBy(F.desc("score"), "image_id", "turn").rowsBetween(Window.unboundedPreceding, 0)
    curve = ranged.withColumns({f"right{k}": F.sum(right[k]).over(down) for k in every} | {f"all{k}": F.sum(live[k]).over(down) for k in every}).join(before, keys)
    # the best precision at a recall is the largest at this or a later hit; each hit stands for the recalls that it is the first to reach
    reached = lambda n: F.floor((POINTS - 1) * n / F.col("gold") + 1e-9)
    total = [F.col(f"right{k}") + F.col(f"r{k}") for k in every]
    hits = curve.where("hit <> 0").select(*keys, "score", "image_id", "turn", *[F.when(right[k] == 1, total[k] / (F.col(f"all{k}") + F.col(f"a{k}"))).alias(f"p{k}") for k in every], *[(reached(total[k]) - reached(total[k] - 1) + F.when(total[k] == 1, 1).otherwise(0)).alias(f"n{k}") for k in every])
    # from the end backwards: a frame that is open towards the end is summed anew for every row
    later = Window.partitionBy("category_id").orderBy(F.desc("piece")).rowsBetween(Window.unboundedPreceding, -1)
    tops = hits.groupBy(*keys).agg(*[F.max(f"p{k}").alias(f"m{k}") for k in every]).select(*keys, *[F.max(f"m{k}").over(later).alias(f"l{k}") for k in every])
    up = Window.partitionBy(*keys).orderBy("score", F.desc("image_id"), F.desc("turn")).rowsBetween(Window.unboundedPreceding, 0)
    reach = hits.withColumns({f"u{k}": F.max(f"p{k}").over(up) for k in every}).join(tops, keys)
    sums = reach.groupBy("category_id").agg(*[(F.sum(F.when(F.col(f"p{k}").isNotNull(), F.greatest(f"u{k}", f"l{k}") * F.col(f"n{k}"))) / POINTS).alias(f"ap{k}") for k in every])
    all_ = gold.join(sums, "category_id", "left")
    each = F.explode(F.array(*[F.struct(F.lit(float(v)).alias("iou"), F.coalesce(f"ap{k}", F.lit(0.0)).alias("ap")) for k, v in enumerate(ious)])).alias("v")
    return all_.select("category_id", each).select("category_id", "v.iou", "v.ap")
