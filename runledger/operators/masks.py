"""Masks as runs of pixels in column-major order: from polygons and from compressed texts, and back; no pixel is ever a row.

Runs are (mask columns, start, len) with ``start`` counted down the columns of an
image of the given height.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from runledger.storage import prepare

#: Fixed values of the scan rule and of the text format.
SUB = 5
FIRST_CHAR = 48
BITS = 5


#: Numbers, characters and crossings that are worked on at once; a text is never cut.
AT_ONCE = 1 << 20


def _slices(batch: pa.RecordBatch, sizes: np.ndarray):
    """The batch in slices of at most AT_ONCE by the sizes of its rows, or of one row."""
    upto, at = np.cumsum(sizes.astype(np.int64)), 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + AT_ONCE, "right")))
        yield batch.slice(at, to - at)
        at = to


def _crossed(x: np.ndarray, y: np.ndarray, first: np.ndarray, sizes: np.ndarray, width: int, height: int):
    """Runs (ring, start, len) of rings with corners on the fine grid, edge by edge and column by column."""
    ring = np.repeat(np.arange(len(sizes)), sizes)
    after = np.arange(1, len(x) + 1)
    after[first + sizes - 1] = first
    u, v = x[after], y[after]
    # the walk goes along the longer side, from its smaller end
    flat = np.abs(u - x) >= np.abs(v - y)
    back = np.where(flat, x > u, y > v)
    xs, ys, xe, ye = (np.where(back, p, q) for p, q in ((u, x), (v, y), (x, u), (y, v)))
    c0 = np.maximum(0, -((2 - np.minimum(xs, xe)) // SUB))
    c1 = np.minimum(width - 1, (np.maximum(xs, xe) - 3) // SUB)
    passed = np.maximum(0, c1 - c0 + 1)
    upto = np.cumsum(passed)
    stride = width * height + 1
    marks, at = np.zeros(0, np.int64), 0
    while at < len(x):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + AT_ONCE, "right")))
        edge = np.repeat(np.arange(at, to), passed[at:to])
        c = c0[edge] + np.arange(len(edge)) - np.repeat(upto[at:to] - passed[at:to], passed[at:to]) + (upto[at - 1] if at else 0)
        level, wide = np.zeros(len(edge), np.int64), flat[edge]
        # height at a step of a flat walk, rounded half up, both divisions towards zero
        e, column = edge[wide], c[wide]
        run, rise, step = xe[e] - xs[e], ye[e] - ys[e], SUB * column + 2 - xs[e]
        heights = []
        for t in (step, step + 1):
            top = 2 * (ys[e] * run + rise * t) + run
            heights.append(np.sign(top) * (np.abs(top) // (2 * run)))
        level[wide] = np.minimum(*heights)
        # the last step of a steep walk before it passes the middle of the column: 2 (xs + s t) + 1 against 2 (5 c + 3), s = (xe - xs) / (ye - ys)
        e, column = edge[~wide], c[~wide]
        steps = (2 * SUB * column + 5 - 2 * xs[e]) * (ye[e] - ys[e]) / (2.0 * (xe[e] - xs[e]))
        level[~wide] = ys[e] + np.where(xe[e] > xs[e], np.ceil(steps) - 1, np.floor(steps)).astype(np.int64)
        # first pixel whose middle is at or below; two crossings at one pixel are none
        row = np.clip(-((2 - level) // SUB), 0, height)
        found, n = np.unique(np.r_[marks, ring[edge] * stride + c * height + row], return_counts=True)
        marks, at = found[n % 2 == 1], to
    own, start = marks // stride, marks % stride
    new = np.r_[True, own[1:] != own[:-1]][: len(own)]
    place = np.arange(len(own)) - np.repeat(np.flatnonzero(new), np.diff(np.r_[np.flatnonzero(new), len(own)]))
    end = np.where(np.r_[new[1:], True][: len(own)], width * height, np.r_[start[1:], 0][: len(own)])
    kept = (place % 2 == 0) & (end > start)
    return own[kept], start[kept], (end - start)[kept]


def polygon_runs(vertices: DataFrame, keys: list[str], width: int, height: int, ring: str = "ring", place: str = "place") -> DataFrame:
    """Runs of the rings of ``vertices`` (keys, ring, place, x, y), one set a ring; rings of one mask may overlap.

    The scan rule of the common detection format: corners are put on a grid of a
    fifth of a pixel, edges are walked on it, and where an edge passes the middle
    of a pixel column, the first pixel below is where the mask begins or ends.
    Only corners are shuffled; a ring's crossings are computed in whole numbers in
    the task that holds it. What lies outside the image is cut off; rings of under
    three corners, with an odd or missing coordinate give no run.
    """
    prepare(vertices.sparkSession)
    own = [*keys, ring]
    fine = lambda c: (F.col(c).cast("double") * SUB + 0.5).cast("long")
    corners = vertices.select(*own, F.struct(F.col(place).alias("place"), fine("x").alias("x"), fine("y").alias("y")).alias("corner"))
    odd = F.max((F.col("corner.x").isNull() | F.col("corner.y").isNull()).cast("int"))
    rings = corners.groupBy(*own).agg(F.sort_array(F.collect_list("corner")).alias("corners"), odd.alias("odd")).where("odd = 0 and size(corners) >= 3")
    rings = rings.select(*own, F.col("corners.x").alias("xs"), F.col("corners.y").alias("ys"))
    kinds = T.StructType([*rings.select(*own).schema.fields, T.StructField("start", T.LongType()), T.StructField("len", T.LongType())])

    def found(rows: pa.RecordBatch) -> pa.RecordBatch:
        sizes = pc.list_value_length(rows["xs"]).to_numpy().astype(np.int64)
        x, y = (rows[k].flatten().to_numpy() for k in ("xs", "ys"))
        which, start, length = _crossed(x, y, np.cumsum(sizes) - sizes, sizes, width, height)
        which = pa.array(which)
        return pa.RecordBatch.from_arrays([*[rows[k].take(which) for k in own], pa.array(start), pa.array(length)], names=[*own, "start", "len"])

    def run(batches):
        for batch in batches:
            for rows in _slices(batch, pc.list_value_length(batch["xs"]).to_numpy() * width):
                yield found(rows)

    return rings.mapInArrow(run, kinds)


def united(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Runs of each mask without overlaps or touching ends: the union of its parts."""
    order = Window.partitionBy(*keys).orderBy("start", "len")
    end = F.col("start") + F.col("len")
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = runs.where("len > 0").withColumn("new", (reach.isNull() | (F.col("start") > reach)).cast("int"))
    islands = opened.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*keys, "island")
    return islands.agg(F.min("start").alias("start"), F.max(end).alias("end")).select(*keys, "start", (F.col("end") - F.col("start")).alias("len"))


def counts_of(runs: DataFrame, keys: list[str], pixels: int) -> DataFrame:
    """One row a mask: ``counts``, lengths of empty and full stretches in turn from an empty one on. ``runs`` must be ``united``."""
    order = Window.partitionBy(*keys).orderBy("start")
    gap = F.col("start") - F.coalesce(F.lag(F.col("start") + F.col("len")).over(order), F.lit(0))
    lists = runs.withColumn("gap", gap.cast("long")).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("start", "gap", "len"))).alias("r"), F.max(F.col("start") + F.col("len")).alias("end"))
    each = F.flatten(F.transform("r", lambda r: F.array(r["gap"], r["len"].cast("long"))))
    return lists.select(*keys, F.when(F.col("end") < pixels, F.concat(each, F.array((F.lit(pixels) - F.col("end")).cast("long")))).otherwise(each).alias("counts"))


def _texts(counts: pa.Array) -> pa.Array:
    """Texts of arrays of counts, all numbers of a batch at once."""
    lists = counts.cast(pa.large_list(pa.int64())).fill_null([]) if counts.null_count else counts.cast(pa.large_list(pa.int64()))
    at, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    first, values = at[:-1] - at[0], values[at[0] : at[-1]]
    place = np.arange(len(values)) - np.repeat(first, np.diff(at))
    moved = values.copy()
    later = np.flatnonzero(place > 2)
    moved[later] -= values[later - 2]
    # groups of five bits until the rest is the sign
    size = np.ones(len(moved), np.int64)
    for n in range(1, 13):
        size += (moved >> (BITS * n - 1) != 0) & (moved >> (BITS * n - 1) != -1)
    number = np.repeat(np.arange(len(moved)), size)
    group = np.arange(len(number)) - np.repeat(np.cumsum(size) - size, size)
    codes = (moved[number] >> (BITS * group)) & 31
    chars = (codes + np.where(group < size[number] - 1, 32, 0) + FIRST_CHAR).astype(np.uint8)
    ends = np.r_[0, np.cumsum(size)][at - at[0]].astype(np.int64)
    texts = pa.LargeStringArray.from_buffers(len(lists), pa.py_buffer(ends), pa.py_buffer(chars)).cast(pa.string())
    return pc.if_else(counts.is_valid(), texts, None)


def text_of(counts: str = "counts"):
    """The compressed text of a column of counts: from the fourth on differences to the one two before, in groups of five bits."""
    prepare(SparkSession.active())

    @F.arrow_udf("string")
    def texts(values: pa.Array) -> pa.Array:
        return _texts(values)

    return texts(F.col(counts))


#: Stands for every number beyond it.
FAR = 1 << 53


def _read(texts: pa.Array, pixels: int):
    """Runs of sound texts and the fault of each text: (text, start, len) of each run, 0, 1 (negative) or 2 (wrong size) of each text."""
    texts = texts.cast(pa.large_string())
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = texts.buffers()[2]
    codes = np.frombuffer(body, np.uint8)[at[0] : at[-1]].astype(np.int64) - FIRST_CHAR if body else np.zeros(0, np.int64)
    own = np.repeat(np.arange(len(texts)), np.diff(at))
    # a line's end after the text
    known = (codes >= 0) & (codes < 64)
    codes, own = codes[known], own[known]
    last = codes < 32
    ends = np.flatnonzero(last)
    starts = np.r_[0, ends[:-1] + 1][: len(ends)]
    size, text = ends - starts + 1, own[ends]
    codes, group = codes[: len(last)], np.arange(len(codes)) - np.repeat(starts, size)
    low = np.add.reduceat((codes & 31) << (BITS * group), starts) if len(starts) else np.zeros(0, np.int64)
    rough = np.add.reduceat((codes & 31) * 2.0 ** (BITS * group), starts) if len(starts) else np.zeros(0)
    minus = (codes[ends] & 16) > 0
    low -= np.where(minus & (size < 13), np.int64(1) << (BITS * np.minimum(size, 12)), 0)
    rough -= np.where(minus, 2.0 ** (BITS * size), 0.0)
    step = np.where(np.abs(rough) < FAR, low, np.where(rough < 0, -FAR, FAR))
    new = np.r_[True, text[1:] != text[:-1]][: len(text)]
    first = np.flatnonzero(new)
    head = np.repeat(first, np.diff(np.r_[first, len(text)]))
    m = np.arange(len(text)) - head

    def summed(values):
        total = np.cumsum(values)
        return total - (total - values)[head]

    # differences add up over every second number; the first number stands for itself
    count = np.where(m == 0, step, np.where(m % 2 == 1, summed(np.where(m % 2 == 1, step, 0)), summed(np.where((m % 2 == 0) & (m > 0), step, 0))))
    end = summed(count)
    fault = np.zeros(len(texts), np.int64)
    if len(first):
        whole = np.add.reduceat(count, first)
        fault[text[first]] = np.where(np.minimum.reduceat(count, first) < 0, 1, np.where(whole != pixels, 2, 0))
    runs = (m % 2 == 1) & (count > 0) & (fault[text] == 0)
    return text[runs], end[runs] - count[runs], count[runs], fault


def runs_of_text(masks: DataFrame, keys: list[str], text: str, pixels: int) -> DataFrame:
    """Runs of compressed texts, one row a run, and ``problem`` (null if sound): ``empty``, ``bad_character``, ``torn``, ``negative`` or ``wrong_size``.

    A mask that isn't sound has one row without a run, a sound mask without pixels none.
    """
    prepare(masks.sparkSession)
    body = F.trim(F.col(text))
    ok = f"^[{chr(FIRST_CHAR)}-{chr(FIRST_CHAR + 63)}]+$"
    problem = F.when(body.isNull() | (body == ""), "empty").when(~body.rlike(ok), "bad_character").when(body.rlike("[P-o]$") | body.rlike("[P-o]{13}"), "torn")
    rows = masks.select(*keys, F.when(problem.isNull(), body).alias("body"), problem.alias("problem"))
    kinds = T.StructType([*masks.select(*keys).schema.fields, T.StructField("start", T.LongType()), T.StructField("len", T.LongType()), T.StructField("problem", T.StringType())])

    def read(rows: pa.RecordBatch) -> pa.RecordBatch:
        own, start, length, fault = _read(rows["body"].fill_null(""), pixels)
        named = pc.if_else(pa.array(fault == 0), rows["problem"], pa.array(np.array(["", "negative", "wrong_size"])[fault], pa.string()))
        wrong = np.flatnonzero(named.is_valid().to_numpy(zero_copy_only=False))
        to, nothing = np.r_[own, wrong], np.r_[np.zeros(len(own), bool), np.ones(len(wrong), bool)]
        padded = lambda v: pa.array(np.r_[v, np.zeros(len(wrong), np.int64)], mask=nothing)
        return pa.RecordBatch.from_arrays([*[rows[k].take(pa.array(to)) for k in keys], padded(start), padded(length), named.take(pa.array(to))], names=[*keys, "start", "len", "problem"])

    def run(batches):
        for batch in batches:
            for rows in _slices(batch, pc.binary_length(batch["body"].fill_null("")).to_numpy()):
                yield read(rows)

    return rows.mapInArrow(run, kinds)


def overlap(runs: DataFrame, bucket: int = 4096) -> DataFrame:
    """Dice and intersection over union per class of ``runs`` (side gold or predicted, image_id, category_id, start, len).

    Masks of one side, class and image are united. Runs are cut at buckets of
    pixels, and in each bucket one pass in order adds up what each side covers and
    what both together do: no two runs are paired, and a large image is spread.
    """
    last = F.col("start") + F.col("len")
    pieces = runs.where("len > 0 and side in ('gold', 'predicted')").withColumn("b", F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor((last - 1) / bucket))))
    low, high = F.greatest(F.col("start"), F.col("b") * bucket), F.least(last, (F.col("b") + 1) * bucket)
    pieces = pieces.select("image_id", "category_id", "b", "side", low.alias("s"), high.alias("e"))
    before = Window.partitionBy("image_id", "category_id", "b").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)

    def gain(end):
        """Pixels of a row beyond those of the rows before it, of rows for which ``end`` isn't null."""
        return F.greatest(end - F.greatest(F.col("s"), F.coalesce(F.max(end).over(before), F.col("s"))), F.lit(0))

    of = lambda name: F.when(F.col("side") == name, F.col("e"))
    gains = pieces.select("category_id", *[F.coalesce(F.when(end.isNotNull(), gain(end)), F.lit(0)).alias(name) for name, end in (("gold", of("gold")), ("predicted", of("predicted")), ("all", F.col("e")))])
    full = gains.groupBy("category_id").agg(*[F.sum(c).alias(c) for c in ("gold", "predicted", "all")]).withColumn("both", F.col("gold") + F.col("predicted") - F.col("all"))
    one = 1.0 * F.col("both")
    return full.select("category_id", F.col("both").alias("shared"), F.try_divide(2 * one, F.col("gold") + F.col("predicted")).alias("dice"), F.try_divide(one, F.col("all")).alias("iou"))
