"""Fusing the predictions of several runs."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from runledger.storage import prepare


def fuse_mean(scores: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Weighted mean of the members' scores per sample and class; every member must have the key, else it is left out."""
    w = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    own = scores.where(F.col("run_id").isin(*weights)).withColumn("w", w[F.col("run_id")])
    fused = own.groupBy("subset", "sample_id", "cls_id").agg(F.sum(F.col("raw") * F.col("w")).alias("s"), F.count("*").alias("n"))
    return fused.where(F.col("n") == len(weights)).select("subset", "sample_id", "cls_id", (F.col("s") / F.lit(float(sum(weights.values())))).alias("value"))


def ranked(scores: DataFrame) -> DataFrame:
    """Average ranks scaled to [0, 1] per run, subset and class; a single row has 0.5. Windows run over distinct scores."""
    keys = ["run_id", "subset", "cls_id"]
    counts = scores.groupBy(*keys, "raw").count()
    below = F.coalesce(F.sum("count").over(Window.partitionBy(*keys).orderBy("raw").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    all_ = F.sum("count").over(Window.partitionBy(*keys))
    rank = F.when(all_ > 1, (below + (F.col("count") - 1) / 2.0) / (all_ - 1)).otherwise(0.5)
    return scores.join(counts.select(*keys, "raw", rank.alias("rank")), [*keys, "raw"])


def fuse_rank_mean(scores: DataFrame, weights: dict[str, float]) -> DataFrame:
    return fuse_mean(ranked(scores).withColumn("raw", F.col("rank")), weights)


ROUNDS = 2
CELL = 16.0


def _strips(rows: DataFrame, low: str, high: str, cell: float) -> DataFrame:
    """Cuts every group of boxes (image_id, category_id, part) where a line across it meets no box.

    Boxes are counted into cells by their lower edge first, so the window holds
    cells of an axis and not boxes; a gap inside one cell isn't used.
    """
    keys = ["image_id", "category_id", "part"]
    celled = rows.withColumn("cell", F.floor(F.col(low) / cell))
    reach = celled.groupBy(*keys, "cell").agg(F.min(low).alias("lo"), F.max(high).alias("hi"))
    order = Window.partitionBy(*keys).orderBy("cell")
    before = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    cut = reach.withColumn("new", (F.col("lo") >= before).cast("int")).withColumn("strip", F.coalesce(F.sum("new").over(order), F.lit(0)))
    strips = cut.select(*keys, "cell", "strip")
    return celled.join(strips, [*keys, "cell"]).withColumn("part", F.concat_ws(".", "part", "strip")).drop("cell", "strip")


def _pieces(boxes: DataFrame, cell: float) -> DataFrame:
    """Boxes with ``part``: those of different parts of an image and category, and any means of them, have no area in common."""
    rows = boxes.withColumn("part", F.lit("").cast("string"))
    for _ in range(ROUNDS):
        rows = _strips(_strips(rows, "x1", "x2", cell), "y1", "y2", cell)
    return rows


#: Groups of more boxes than HOT (and than four buckets' mean) are cut by Spark; they are looked for by buckets of hashed keys.
HOT = 50_000
BUCKETS = 16_384
#: Up to this many boxes, groups are fused side by side, one box of each at a time.
SMALL = 32


def _spread(rows: DataFrame, cell: float, hot: int) -> tuple[DataFrame, list[str]]:
    """The boxes and the columns by which they go to tasks: image and category, and if some of these have very many boxes, the part of those.

    Counts are of buckets of keys first, so only a bucket with many boxes has its
    keys counted; at most BUCKETS counts and a quarter as many keys are collected
    or broadcast.
    """
    keys = ["image_id", "category_id"]
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS))
    full = rows.groupBy(bucket.alias("bucket")).count().where(F.col("count") > hot).collect()
    most = max(hot, 4 * sum(r["count"] for r in full) // BUCKETS)
    wanted = [r["bucket"] for r in full if r["count"] > most]
    if not wanted:
        return rows, keys
    large = F.broadcast(rows.where(bucket.isin(wanted)).groupBy(*keys).count().where(F.col("count") > most).select(*keys))
    cut = _pieces(rows.join(large, keys, "left_semi"), cell)
    return rows.join(large, keys, "left_anti").withColumn("part", F.lit("")).unionByName(cut), [*keys, "part"]


PLACE = ["x1", "y1", "x2", "y2"]
CLUSTERS = "image_id long, category_id int, q double, turn_a double, turn_b double, x1 double, y1 double, x2 double, y2 double, total double, most double, n long"


def _parted(group: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Numbers of the parts of each group, cut like `_strips` but at every gap."""
    for _ in range(ROUNDS):
        for low, high in ((0, 2), (1, 3)):
            order = np.lexsort((place[:, low], group))
            g, ends = group[order], place[order, high]
            values, rank = np.unique(ends, return_inverse=True)
            # the largest end so far in the group: groups ascend, so they outweigh ranks
            reach = values[np.maximum.accumulate(g * len(values) + rank) % len(values)]
            new = np.r_[True, (g[1:] != g[:-1]) | (place[order[1:], low] >= reach[:-1])]
            group = np.empty_like(group)
            group[order] = np.cumsum(new) - 1
    return group


def _together(q: np.ndarray, place: np.ndarray, starts: np.ndarray, sizes: np.ndarray, iou: float):
    """Greedy clusters of groups of boxes in order, box by box: (first box, corners, total, most, count) of each cluster."""
    turn = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[turn], sizes[turn]
    groups, slots = len(sizes), int(sizes[0])
    # per group and cluster: sums of q * corners, of corners, of q, the largest q, the count, the first box
    heavy, plain, corners = np.zeros((3, groups, slots, 4))
    total, most, area = np.zeros((3, groups, slots))
    count, lead = np.zeros((2, groups, slots), np.int64)
    n = np.zeros(groups, np.int64)
    for k in range(slots):
        m = int(np.searchsorted(-sizes, -k))
        at = starts[:m] + k
        a, w = place[at], q[at]
        to = n[:m].copy()
        if k:
            side = np.minimum(corners[:m, :k, 2:], a[:, None, 2:]) - np.maximum(corners[:m, :k, :2], a[:, None, :2])
            both = np.where((side > 0).all(axis=2), side[..., 0] * side[..., 1], 0.0)
            union = area[:m, :k] + ((a[:, 2] - a[:, 0]) * (a[:, 3] - a[:, 1]))[:, None] - both
            share = np.divide(both, union, out=np.zeros((m, k)), where=union > 0)
            share[np.arange(k) >= n[:m, None]] = -np.inf
            found = share.argmax(axis=1)
            to = np.where(share[np.arange(m), found] > iou, found, to)
        own = (np.arange(m), to)
        opened = to == n[:m]
        lead[own] = np.where(opened, at, lead[own])
        n[:m] += opened
        heavy[own] += w[:, None] * a
        plain[own] += a
        total[own] += w
        count[own] += 1
        most[own] = np.maximum(most[own], w)
        c, t = count[own][:, None], total[own][:, None]
        mean = np.where(t > 0, heavy[own] / np.where(t > 0, t, 1.0), plain[own] / c)
        corners[own] = now = np.where(c == 1, a, mean)
        area[own] = (now[:, 2] - now[:, 0]) * (now[:, 3] - now[:, 1])
    used = np.arange(slots) < n[:, None]
    return lead[used], corners[used], total[used], most[used], count[used]


def _alone(q: np.ndarray, place: np.ndarray, iou: float):
    """Like `_together` for one large group."""
    size = len(q)
    heavy, plain, corners = np.zeros((3, size, 4))
    total, most, area = np.zeros((3, size))
    count, lead = np.zeros((2, size), np.int64)
    n = 0
    for i in range(size):
        a, to = place[i], n
        if n:
            side = np.minimum(corners[:n, 2:], a[2:]) - np.maximum(corners[:n, :2], a[:2])
            both = np.where((side > 0).all(axis=1), side[:, 0] * side[:, 1], 0.0)
            union = area[:n] + (a[2] - a[0]) * (a[3] - a[1]) - both
            share = np.divide(both, union, out=np.zeros(n), where=union > 0)
            found = int(share.argmax())
            to = found if share[found] > iou else n
        if to == n:
            lead[n] = i
            n += 1
        heavy[to] += q[i] * a
        plain[to] += a
        total[to] += q[i]
        count[to] += 1
        most[to] = max(most[to], q[i])
        corners[to] = a if count[to] == 1 else heavy[to] / total[to] if total[to] > 0 else plain[to] / count[to]
        area[to] = (corners[to, 2] - corners[to, 0]) * (corners[to, 3] - corners[to, 1])
    return lead[:n], corners[:n], total[:n], most[:n], count[:n]


def _clustered(iou: float, keys: list[str]):
    """Greedy clusters of each run of equal ``keys``; boxes of a run come in any order."""

    def changes(rows: pa.RecordBatch | pa.Table) -> np.ndarray:
        found = np.zeros(max(rows.num_rows - 1, 0), bool)
        for k in keys:
            own = rows[k].to_numpy(zero_copy_only=False) if isinstance(rows, pa.RecordBatch) else rows[k].to_numpy()
            found |= own[1:] != own[:-1]
        return found

    def whole(rows: pa.Table) -> pa.RecordBatch:
        column = {k: rows[k].to_numpy() for k in rows.column_names}
        group = np.r_[0, np.cumsum(changes(rows))]
        place = np.stack([column[k] for k in PLACE], axis=1)
        large = np.bincount(group)[group] > SMALL
        if large.any():
            # parts of large groups are numbered after all groups
            group[large] = len(group) + _parted(group[large], place[large])
        turns = [column[k] for k in ("turn_a", "turn_b") if k in column]
        order = np.lexsort((*place.T[::-1], *turns[::-1], -column["q"], group))
        group, place, q = group[order], place[order], column["q"][order]
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        sizes = np.diff(np.r_[starts, len(group)])
        small = sizes <= SMALL
        found = [_together(q, place, starts[small], sizes[small], iou)] if small.any() else []
        for a, n in zip(starts[~small], sizes[~small], strict=True):
            lead, *rest = _alone(q[a : a + n], place[a : a + n], iou)
            found.append((lead + a, *rest))
        lead, corners, total, most, count = (np.concatenate(x) for x in zip(*found, strict=True))
        first = {k: v[order[lead]] for k, v in column.items()}
        # without a turn it is the place
        tied = [first.get("turn_a", first["x1"]), first.get("turn_b", first["y1"])]
        names = [x.split()[0] for x in CLUSTERS.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (first["image_id"], first["category_id"], first["q"], *tied, *corners.T, total, most, count)], names=names)

    def run(batches):
        held: list[pa.RecordBatch] = []
        for rows in batches:
            if not rows.num_rows:
                continue
            joint = [held[-1].slice(held[-1].num_rows - 1), rows] if held else [rows]
            cuts = np.flatnonzero(changes(pa.Table.from_batches(joint)))
            if len(cuts):
                end = int(cuts[-1]) + (1 if len(joint) == 1 else 0)
                yield whole(pa.Table.from_batches([*held, rows.slice(0, end)]))
                held = []
                rows = rows.slice(end)
            held.append(rows)
        if held:
            yield whole(pa.Table.from_batches(held))

    return run


def fuse_boxes(boxes: DataFrame, members: int | Sequence[float], iou: float = 0.55, *, conf: str = "avg", skip: float = 0.0, min_score: float = 0.0, top: int | None = None, turn: str | None = None, size: tuple[float, float] | None = None, cell: float = CELL, hot: int = HOT) -> DataFrame:
    """Weighted boxes fusion per image and category.

    ``boxes`` has image_id, category_id, x, y, w, h, score and weight (its
    member's). ``members`` lists the members' weights, or says how many there are
    if all weigh 1. Boxes by falling weighted score, ties by ``turn`` (without it
    by x, then y), join the cluster whose fused box overlaps most, if by more than
    ``iou``, and move it to the weighted mean of its corners. A cluster's score is
    its mean weighted score times min(members, boxes) over the sum of the weights,
    or with ``conf='max'`` its largest weighted score over the largest weight; at
    most 1. Boxes under ``skip`` are left out before, fused ones under
    ``min_score`` after; ``top`` keeps an image's best by score, then category,
    then the order in which clusters began. ``size`` (width, height) clips the
    result. Boxes with a null in any of these columns are left out.

    Boxes are shuffled once, by image and category. One with more than ``hot`` boxes
    is first cut along lines that meet no box, and its parts go to tasks of their
    own; boxes that overlap in one chain stay in one task.
    """
    if conf not in ("avg", "max"):
        raise ValueError("conf is avg or max")
    weights = [1.0] * members if isinstance(members, int) else [float(x) for x in members]
    x, y, w, h, score, weight = (F.col(c).cast("double") for c in ("x", "y", "w", "h", "score", "weight"))
    # with a turn, its columns travel along; the place does anyway
    order = [F.col(turn).cast("double").alias("turn_a"), F.lit(0.0).alias("turn_b")] if turn else []
    rows = boxes.where(score >= skip).select(F.col("image_id").cast("long").alias("image_id"), F.col("category_id").cast("int").alias("category_id"), x.alias("x1"), y.alias("y1"), (x + w).alias("x2"), (y + h).alias("y2"), (score * weight).alias("q"), *order).dropna()
    rows, keys = _spread(rows, cell, hot)
    prepare(boxes.sparkSession)
    fused = rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_clustered(iou, keys), CLUSTERS)
    n, own = F.col("n"), F.lit(sum(weights))
    value = F.col("most") / max(weights) if conf == "max" else F.col("total") / n * F.least(n, F.lit(len(weights))) / own
    fused = fused.withColumn("score", F.least(F.lit(1.0), value)).where(F.col("score") >= min_score)
    if top:
        best = Window.partitionBy("image_id").orderBy(F.desc("score"), "category_id", F.desc("q"), "turn_a", "turn_b")
        fused = fused.withColumn("place", F.row_number().over(best)).where(F.col("place") <= top)
    clip = lambda c, most: F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(float(most))) if size else F.col(c)
    wide, tall = size or (0, 0)
    a, b, c, d = clip("x1", wide), clip("y1", tall), clip("x2", wide), clip("y2", tall)
    near = lambda v: F.round(v, 6)
    return fused.select("image_id", "category_id", near(a).alias("x"), near(b).alias("y"), near(c - a).alias("w"), near(d - b).alias("h"), F.round("score", 9).alias("score"), "n")
