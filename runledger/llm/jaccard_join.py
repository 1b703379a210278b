"""Exact n-gram Jaccard self-join as a blocked sparse product of the document by n-gram incidence matrix.

Rows of the matrix are documents, columns are 5-word shingles. A size-derived
bound cuts the columns: two sets with Jaccard similarity t share a shingle among
the first ``n - ceil(t n) + 1`` of each in any common order, so only those
entries of the product are formed. A count sketch of all shingles of all texts
gives each a level, and the order is by level, then hash: passages that many
documents share come last, which keeps them out of these prefixes.

* Columns with few rows add 1 to the overlap count of every pair of their rows.
* Columns with many rows are not multiplied out: of each column's rows of about one
  size the one with the least of its prefix in short columns is the pivot, as it has
  the fewest shingles of its own. Each row is paired with its pivot, and pivots of
  neighbouring sizes with each other. After components are known only rows of
  different components are paired, as the other pairs can't change a component, and
  of these only rows that have enough long columns, by size, before they are joined:
  texts that share a long passage but are less alike have too few.
* Pairs whose count plus what may lie beyond the prefix stays below
  ``3 (nx + ny) / 7`` are discarded; the rest of the product is then completed
  from the whole texts, block by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.llm.common import materialize, minimal_labels, parts, prepare, shingle_hashes, word_slices

SHORT_COLUMN = 8
#: The sketch has 2 ** SKETCH_BITS counters, whatever the input; a task sends them in chunks of 2 ** CHUNK_BITS.
SKETCH_BITS, CHUNK_BITS = 21, 15
#: Counters of so many texts above the mean counter, and of so many of its roots, have a level above 0. Any order of shingles gives the same result.
FREQUENT, ABOVE_NOISE = 8, 6
SALTS = 16
#: Steps of size between a set and one of 4/3 of its size.
STEPS = 8
SIGN = np.uint64(1 << 63)


def _signature(unique: np.ndarray) -> bytes:
    return np.array([len(unique), unique.sum(dtype=np.uint64), (unique * (unique | np.uint64(1))).sum(dtype=np.uint64)], np.uint64).tobytes()


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int, list[int], list[np.ndarray]]]:
    for batch in batches:
        ids = batch.column(0).to_pylist()
        for first, count, _, _, _, hashes, bounds in word_slices(batch.column(1)):
            yield ids[first : first + count], [np.unique(shingle_hashes(hashes[bounds[i] : bounds[i + 1]], size)) for i in range(count)]


def _counters(unique: np.ndarray) -> np.ndarray:
    return (unique * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _measure(size: int):
    """Set sizes and signatures, then the task's counters: ``h`` is the chunk, ``sig`` its counters' places and counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << SKETCH_BITS, np.int64)
        for ids, sets in _sets(batches, size):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(x) for x in sets], pa.int64()), pa.array([_signature(x) if len(x) else None for x in sets], pa.binary()), pa.nulls(len(ids), pa.int64())], names=["doc_id", "n", "sig", "h"])
            if sets:
                np.add.at(sketch, _counters(np.concatenate(sets)), 1)
        for chunk, part in enumerate(sketch.reshape(-1, 1 << CHUNK_BITS)):
            at = np.flatnonzero(part)
            if len(at):
                packed = at.astype(np.uint16).tobytes() + part[at].astype(np.uint32).tobytes()
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([packed], pa.binary()), pa.array([chunk], pa.int64())], names=["doc_id", "n", "sig", "h"])

    return run


def _add_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            n = len(packed) // 6
            total.setdefault(chunk, np.zeros(1 << CHUNK_BITS, np.int64))[np.frombuffer(packed, np.uint16, n)] += np.frombuffer(packed, np.uint32, n, 2 * n)
    for chunk, counts in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([counts.tobytes()], pa.binary())], names=["h", "sig"])


def _levels(measured: DataFrame) -> np.ndarray:
    """One byte a counter: 0 if it is not frequent, else 1 and one more for each doubling. What the driver gets has a fixed size."""
    chunks = measured.where("h is not null").select("h", "sig").repartition(1 << (SKETCH_BITS - CHUNK_BITS), "h").mapInArrow(_add_chunks, "h long, sig binary")
    counts = np.zeros((1 << (SKETCH_BITS - CHUNK_BITS), 1 << CHUNK_BITS), np.int64)
    for row in chunks.collect():
        counts[row["h"]] = np.frombuffer(row["sig"], np.int64)
    counts = counts.ravel()
    mean = counts.mean()
    over = (counts - mean) / max(FREQUENT, ABOVE_NOISE * np.sqrt(mean))
    return np.where(over >= 1, 1 + np.log2(np.maximum(over, 1)), 0).astype(np.uint8)


def _prefixes(size: int, levels_b):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = levels_b.value
        for ids, sets in _sets(batches, size):
            h, d, kind, place = [], [], [], []
            for doc, unique in zip(ids, sets, strict=True):
                n = len(unique)
                if not n:
                    continue
                level = levels[_counters(unique)]
                first = np.argsort(level, kind="stable")[: n - (3 * n + 3) // 4 + 1]
                h += [unique[first], unique[first[-1:]]]
                d.append(np.full(len(first) + 1, doc, np.int64))
                place += [np.arange(len(first)), [0]]
                kind += [(level[first] > 0).astype(np.int8), (2 + level[first[-1:]]).astype(np.int8)]
            if h:
                flags, docs = np.concatenate(kind), np.concatenate(d)
                salt = 1 + (docs.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(60)).astype(np.int8) % SALTS
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(h).view(np.int64)), pa.array(docs), pa.array(np.where(flags == 0, 0, salt).astype(np.int8)), pa.array(flags), pa.array(np.concatenate(place).astype(np.int32))], names=["h", "doc_id", "salt", "kind", "place"])

    return run


def _columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by column; what it holds of a column between batches is at most SHORT_COLUMN rows.

    Gives kind 0: a pair (a, b) of one short column; 1: an entry (a: column, b: row) of a
    long or frequent one; 2 and more: where the prefix of b ends, 2 plus the level.
    """
    names = ["kind", "a", "b", "place"]

    def out(kind, a, b):
        """``b``: rows, or rows and the column's place in each."""
        b, place = (b, np.zeros(len(b), np.int64)) if b.ndim == 1 else (b[:, 0], b[:, 1])
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int8) if np.isscalar(kind) else kind), pa.array(a), pa.array(b), pa.array(place.astype(np.int32))], names=names)

    held_h, held_d = np.zeros(0, np.int64), np.zeros((0, 2), np.int64)
    long_column = None
    for batch in batches:
        h, d, kind, place = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 3, 4))
        d = np.stack((d, place.astype(np.int64)), axis=1)
        other = kind > 0
        if other.any():
            yield out(kind[other].astype(np.int8), h[other], d[other])
            h, d = h[~other], d[~other]
        if long_column is not None and len(h):
            same = h == long_column
            if same.any():
                yield out(1, h[same], d[same])
                h, d = h[~same], d[~same]
            if len(h):
                long_column = None
        h, d = np.concatenate((held_h, h)), np.concatenate((held_d, d))
        if not len(h):
            continue
        starts = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        sizes = np.diff(np.concatenate((starts, [len(h)])))
        last = int(starts[-1])
        if sizes[-1] > SHORT_COLUMN:
            long_column = h[-1]
            held_h, held_d = np.zeros(0, np.int64), np.zeros((0, 2), np.int64)
            end = len(h)
        else:
            held_h, held_d, end = h[last:], d[last:], last
            starts, sizes = starts[:-1], sizes[:-1]
        yield from _multiply(h[:end], d[:end], starts, sizes, out)
    if len(held_h):
        yield from _multiply(held_h, held_d, np.array([0]), np.array([len(held_h)]), out)


def _multiply(h, d, starts, sizes, out):
    long = sizes > SHORT_COLUMN
    if long.any():
        at = np.repeat(long, sizes)
        yield out(1, h[at], d[at])
    for n in range(2, SHORT_COLUMN + 1):
        s = starts[sizes == n]
        if not len(s):
            continue
        rows = d[s[:, None] + np.arange(n), 0]
        rows.sort(axis=1)
        i, j = np.triu_indices(n, 1)
        a, b = rows[:, i].ravel(), rows[:, j].ravel()
        keep = a != b
        yield out(0, a[keep], b[keep])


def _complete(size: int):
    """The rest of the product for blocks of pairs: whole rows a and b, overlap counted, links kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, len(batch), 256):
                part = batch.slice(first, 256)
                a_ids, b_ids = part.column(0).to_pylist(), part.column(1).to_pylist()
                a_sets = [x for _, sets in _sets(iter([part.select([0, 2])]), size) for x in sets]
                b_sets = [x for _, sets in _sets(iter([part.select([1, 3])]), size) for x in sets]
                keep = []
                for x, y in zip(a_sets, b_sets, strict=True):
                    small, large = (x, y) if len(x) <= len(y) else (y, x)
                    at = np.minimum(np.searchsorted(large, small), max(len(large) - 1, 0))
                    both = int((large[at] == small).sum()) if len(large) else 0
                    keep.append(100 * both >= 75 * (len(x) + len(y) - both) and both > 0)
                yield pa.RecordBatch.from_arrays([pa.array([v for v, k in zip(a_ids, keep, strict=True) if k], pa.int64()), pa.array([v for v, k in zip(b_ids, keep, strict=True) if k], pa.int64())], names=["a", "b"])

    return run


def _late_pairs(rest: DataFrame) -> DataFrame:
    """Pairs of rows (h, doc_id, place, n, fine, component, long, level, end) of one column and different components that may still be linked.

    A pair shares long columns only. Let x be the smaller set and y be ``k`` steps of
    size above it. The prefix that ends first bounds the overlap by the long columns
    of either set and what lies beyond that prefix, so both need at least
    ``3 (nx + ny) / 7 - 3 ny / 4`` long columns; and the first shared column's place
    leaves room for the overlap. Both are asked of each row before the join, by ``k``,
    and of each pair in it.
    """
    n, slack = F.col("n"), 1e-6
    x_side, y_side = [], []
    for k in range(STEPS + 2):
        least, most = (4 / 3) ** (max(k - 1, 0) / STEPS), (4 / 3) ** ((k + 1) / STEPS)
        x_side.append(F.when((7 * F.col("place") <= n * (4 - 3 * least + slack)) & (F.col("long") >= n * (3 / 7 - 9 / 28 * most - slack)), F.lit(k)))
        y_side.append(F.when((7 * F.col("place") <= n * (4 - 3 / most + slack)) & (F.col("long") >= n * (3 / 7 / most - 9 / 28 - slack)), F.lit(k)))

    def side(steps: list, s: str) -> DataFrame:
        facts = [F.col(c).alias(f"{c}_{s}") for c in ("doc_id", "n", "component", "place", "long", "level", "end")]
        return rest.select("h", "fine", F.explode(F.array_compact(F.array(*steps))).alias("k"), *facts)

    x, y = side(x_side, "x").withColumn("fine", F.col("fine") + F.col("k")), side(y_side, "y")
    beyond = F.when(F.struct("level_x", "end_x") <= F.struct("level_y", "end_y"), F.floor((3 * F.col("n_x") + 3) / 4)).otherwise(F.floor((3 * F.col("n_y") + 3) / 4)) - 1
    room = F.least("long_x", "long_y") + beyond >= F.ceil(3 * (F.col("n_x") + F.col("n_y")) / F.lit(7))
    smaller = F.expr("component_x <> component_y and 4 * n_x >= 3 * n_y and (n_x < n_y or n_x = n_y and doc_id_x < doc_id_y) and 7 * place_x <= 4 * n_x - 3 * n_y and 7 * place_y <= 4 * n_y - 3 * n_x")
    met = x.join(y, ["h", "fine", "k"]).where(smaller & room)
    return met.select(F.least("doc_id_x", "doc_id_y").alias("a"), F.greatest("doc_id_x", "doc_id_y").alias("b")).distinct()


def jaccard_components(docs: DataFrame, size: int = 5) -> DataFrame:
    """Links texts whose shingle sets have Jaccard similarity 0.75 or more and groups them by reachability.

    ``docs`` has ``doc_id`` (long, distinct) and ``text``; other columns are
    ignored. Returns ``doc_id, n_shingles, component_id``, one row a document;
    rows without an id are left out.
    Null texts and texts without words have no shingles and are linked with
    nothing; texts with fewer than ``size`` words have one shingle, all of them.
    Equal sets are linked. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    measured = materialize(docs.mapInArrow(_measure(size), "doc_id long, n long, sig binary, h long"), "jaccard-sizes")
    levels = spark.sparkContext.broadcast(_levels(measured))
    nodes = measured.where("doc_id is not null").select("doc_id", "n", "sig")
    first = nodes.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    copies = materialize(nodes.where("n > 0").join(first.where("copies > 1"), "sig").select("doc_id", "rep"), "jaccard-copies")

    entries = docs.mapInArrow(_prefixes(size, levels), "h long, doc_id long, salt byte, kind byte, place int")
    product = materialize(entries.repartition(parts(docs), "h", "salt").sortWithinPartitions("h").mapInArrow(_columns, "kind byte, a long, b long, place int"), "jaccard-product")

    def to_rep(df: DataFrame, col: str) -> DataFrame:
        other = copies.select(F.col("doc_id").alias(col), F.col("rep").alias("_rep"))
        return df.join(other, col, "left").withColumn(col, F.coalesce("_rep", col)).drop("_rep")

    ends = product.where("kind >= 2").select(F.col("b").alias("doc_id"), (F.col("kind") - 2).alias("level"), F.col("a").alias("end"))
    listed = materialize(to_rep(product.where("kind = 1").select(F.col("a").alias("h"), F.col("b").alias("doc_id"), "place"), "doc_id").distinct(), "jaccard-entries")
    long_columns = listed.groupBy("doc_id").agg(F.count("*").alias("long"))
    # signed order of the end marks is enough to compare them: flip the sign bit to compare as unsigned
    facts = materialize(nodes.where("n > 0").join(ends, "doc_id").join(long_columns, "doc_id", "left").select("doc_id", "n", F.coalesce("long", F.lit(0)).alias("long"), "level", F.col("end").bitwiseXOR(F.lit(-(1 << 63))).alias("end")), "jaccard-facts")
    entry = listed.join(facts, "doc_id").withColumn("band", F.floor(F.log("n") / F.log(F.lit(4 / 3))))
    # the row with the least of its prefix in short columns has the fewest shingles of its own
    own = (F.floor(F.col("n") / 4) + 1 - F.col("long")) / F.col("n")
    pivots = entry.groupBy("h", "band").agg(F.min(F.struct(own, "doc_id")).alias("x"), F.count("*").alias("rows")).select("h", "band", "rows", F.col("x.doc_id").alias("pivot"))
    spokes = entry.join(pivots.where("rows > 1"), ["h", "band"]).select(F.col("pivot").alias("a"), F.col("doc_id").alias("b"))
    rims = pivots.join(pivots.select("h", (F.col("band") - 1).alias("band"), F.col("pivot").alias("b")), ["h", "band"]).select(F.col("pivot").alias("a"), "b")
    star = spokes.union(rims).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().withColumn("c", F.lit(0))
    # a pair of rows that stand for others may count a column several times; that only loosens the bound
    short = to_rep(to_rep(product.where("kind = 0").groupBy("a", "b").agg(F.count("*").alias("c")), "a"), "b").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "c")
    def bounded(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b, c) that can still reach the needed overlap."""
        for side in ("a", "b"):
            pairs = pairs.join(facts.select(F.col("doc_id").alias(side), *(F.col(x).alias(f"{x}_{side}") for x in ("n", "long", "level", "end"))), side)
        a_first = F.struct("level_a", "end_a") <= F.struct("level_b", "end_b")
        beyond = F.when(a_first, F.floor((3 * F.col("n_a") + 3) / 4) - 1).otherwise(F.floor((3 * F.col("n_b") + 3) / 4) - 1)
        most = F.col("c") + F.least("long_a", "long_b") + beyond
        needed = F.ceil(3 * (F.col("n_a") + F.col("n_b")) / F.lit(7))
        return pairs.where((4 * F.least("n_a", "n_b") >= 3 * F.greatest("n_a", "n_b")) & (most >= needed)).select("a", "b")

    def linked(pairs: DataFrame, label: str) -> DataFrame:
        pairs = materialize(pairs, f"{label}-pairs")
        text = docs.select(F.col("doc_id").alias("_id"), "text")
        left = text.hint("shuffle_hash").join(pairs.hint("shuffle_hash"), F.col("_id") == F.col("a")).select("a", "b", F.col("text").alias("text_a"))
        both = left.join(docs.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")
        return materialize(both.mapInArrow(_complete(size), "a long, b long"), f"{label}-links")

    tried = materialize(bounded(short.union(star).groupBy("a", "b").agg(F.sum("c").alias("c"))), "jaccard-tried")
    links = linked(tried, "jaccard")
    same = copies.where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    found = minimal_labels(links, "jaccard")

    # columns that still hold rows of different components; pairs with a short column in common are settled, so what is left shares long ones only
    member = entry.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    open_columns = member.groupBy("h").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min(7 * F.col("place") - F.col("n")).alias("lead")).where("lo <> hi and lead <= 0").select("h")
    rest = materialize(member.join(open_columns, "h", "left_semi").withColumn("fine", F.floor(STEPS * F.log("n") / F.log(F.lit(4 / 3)))), "jaccard-open")
    late_pairs = _late_pairs(rest).join(tried, ["a", "b"], "left_anti")
    more = linked(late_pairs, "jaccard-more")
    labels = minimal_labels(links.union(more).union(same), "jaccard-all")
    return nodes.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
