"""Mixing sources to target weights by pivotal dependent rounding.

A source's documents all want the same number of copies, target over size. Its
whole part is given outright; the fraction is rounded by pairing documents and
moving word mass from one to the other, in a random direction that keeps every
expectation, until one of the two is a whole number. Each block of a source
leaves at most one unrounded document; these are paired again, block by block, up
a tree. The words a source gives therefore miss its target by less than one
document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from runledger.llm.common import materialize, prepare, word_slices

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_COPIES = 2
BLOCK = 4096
#: Unrounded documents that one step of the tree pairs.
FAN_IN = 512
#: With more sources than this the plan is joined by a shuffle.
MOST_BROADCAST = 100_000


def word_counts(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "source"), text: str = "text") -> DataFrame:
    """Adds ``size``, the number of words of a text (null: 0), and ``text_hash`` to the columns in ``keep``."""
    prepare(docs.sparkSession)
    keep = tuple(keep)
    chosen = docs.select(*keep, F.xxhash64(F.col(text).cast("string")).alias("text_hash"), F.col(text).cast("string").alias("__text"))
    keep = (*keep, "text_hash")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [np.diff(s[-1]) for s in word_slices(batch.column(len(keep)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(np.concatenate(sizes) if sizes else np.zeros(0, np.int64), pa.int64())], names=[*keep, "size"])

    return chosen.mapInArrow(run, ", ".join([*(f"`{c}` {t}" for c, t in chosen.drop("__text").dtypes), "size long"]))


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> list[float]:
    """Words each source should give: ``share`` of all words by weight, no source above ``most`` times its size, the excess shared anew."""
    left, out = share * sum(sizes), [0.0] * len(sizes)
    active = [i for i, s in enumerate(sizes) if s > 0]
    while active:
        total = sum(weights[i % len(weights)] for i in active)
        part = {i: left * weights[i % len(weights)] / total for i in active}
        above = [i for i in active if part[i] > most * sizes[i]]
        if not above:
            for i in active:
                out[i] = part[i]
            break
        for i in above:
            out[i] = float(most * sizes[i])
            left -= out[i]
        active = [i for i in active if i not in set(above)]
    return out


def _pair(sizes: np.ndarray, p: np.ndarray, ids: np.ndarray, seed: int) -> np.ndarray:
    """Rounds fractions ``p`` in place of pairs, largest documents first; at most one stays fractional."""
    out = p.copy()
    order = np.lexsort((ids, -sizes))
    rng = np.random.default_rng([seed & 0x7FFFFFFF, len(ids), int(ids[order[0]]) & 0x7FFFFFFF])
    draws = rng.random(len(order))
    tiny = 1e-9
    i = order[0]
    for u, j in zip(draws[1:], order[1:], strict=True):
        si, sj, pi, pj = sizes[i], sizes[j], out[i], out[j]
        to_i, to_j = min((1 - pi) * si, pj * sj), min(pi * si, (1 - pj) * sj)
        move = to_i if u * (to_i + to_j) < to_j else -to_j
        out[i], out[j] = pi + move / si, pj - move / sj
        for k in (i, j):
            if out[k] < tiny or out[k] > 1 - tiny:
                out[k] = round(out[k])
        if out[i] in (0.0, 1.0):
            i = j
    return out


def _round_group(key, rows):
    p = rows["p"].to_numpy(float)
    open_ = (p > 0) & (p < 1)
    if open_.sum() > 1:
        own = np.flatnonzero(open_)
        p[own] = _pair(rows["size"].to_numpy(float)[own], p[own], rows["doc_id"].fillna(-1).to_numpy(np.int64)[own], int(key[-1]))
    return rows.assign(p=p)


def mix(docs: DataFrame, text: str = "text", seed: int = 7) -> DataFrame:
    """Copies of each document that bring the sources to their targets.

    ``docs`` has ``doc_id`` (long), ``source`` (null is a source of its own,
    last in order) and ``text``. Returns ``doc_id, source, size, source_size,
    target, copies, taken, text_hash``, one row a document. Documents without words and
    sources without words give nothing; a source at its limit gives every document
    twice. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    sized = materialize(word_counts(docs.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("source", F.col("source").cast("string")), text=text), "mix-sizes")
    # one row a source, not a document
    rows = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")).orderBy(F.col("source").asc_nulls_last()).collect()
    goals = targets([r.source_size for r in rows])
    plan = [(r.source, r.source_size, t, int(c := t / r.source_size if r.source_size else 0), float(c - int(c)), int(max(1, -(-r.n // BLOCK)))) for r, t in zip(rows, goals, strict=True)]
    small = len(plan) <= MOST_BROADCAST
    plan = spark.createDataFrame(plan, "source string, source_size long, target double, whole int, fraction double, blocks int")
    known = sized.join(F.broadcast(plan) if small else plan, sized.source.eqNullSafe(plan.source)).select("doc_id", sized.source, "size", "text_hash", "source_size", "target", "whole", "blocks", F.when(F.col("size") > 0, F.col("fraction")).otherwise(0.0).alias("p")).withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("blocks")).cast("long"))
    schema = "doc_id long, source string, size long, text_hash long, source_size long, target double, whole int, blocks int, p double, block long"
    leaves = materialize(known.groupBy("source", "block").applyInPandas(_round_group, schema), "mix-leaves")
    most = max((r.n for r in rows), default=0)
    blocks = -(-most // BLOCK)
    left = leaves.where("p > 0 and p < 1")
    done = None
    while blocks > 1:
        blocks = -(-blocks // FAN_IN)
        stepped = materialize(left.withColumn("block", F.pmod(F.col("block"), F.lit(blocks)).cast("long")).groupBy("source", "block").applyInPandas(_round_group, schema), "mix-residuals")
        settled = stepped.where("p <= 0 or p >= 1")
        done = settled if done is None else done.union(settled)
        left = stepped.where("p > 0 and p < 1")
    last = left.withColumn("p", F.round("p"))
    final = (last if done is None else done.union(last)).unionByName(leaves.where("p <= 0 or p >= 1"))
    copies = (F.col("whole") + F.round("p")).cast("int")
    return final.select("doc_id", "source", "size", "text_hash", "source_size", "target", F.when(F.col("size") > 0, copies).otherwise(0).alias("copies")).withColumn("taken", F.col("size") * F.col("copies"))


def mix_rows(docs: DataFrame, text: str = "text", seed: int = 7) -> DataFrame:
    """The mixed table itself: each row of ``docs`` as many times as the mix takes it.

    Ids may be null or repeated: rows of one id, source and text are numbered and each
    takes one grant, so none comes more often than the mix allows. The names
    ``_id``, ``_source``, ``_hash``, ``_turn`` and ``_copy`` must not be columns of ``docs``.
    """
    alike = Window.partitionBy("_id", "_source", "_hash")
    hash_ = F.xxhash64(F.col(text).cast("string"))
    granted = mix(docs, text, seed).select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("text_hash").alias("_hash"), F.col("copies").alias("_copy"))
    granted = granted.withColumn("_turn", F.row_number().over(alike.orderBy(F.desc("_copy")))).where("_copy > 0")
    own = docs.withColumns({"_id": F.col("doc_id").cast("long"), "_source": F.col("source").cast("string"), "_hash": hash_})
    own = own.withColumn("_turn", F.row_number().over(alike.orderBy(F.lit(0))))
    same = own["_id"].eqNullSafe(granted["_id"]) & own["_source"].eqNullSafe(granted["_source"]) & (own["_hash"] == granted["_hash"]) & (own["_turn"] == granted["_turn"])
    return own.join(granted, same).select(*[own[c] for c in docs.columns], F.explode(F.expr("sequence(1, _copy)")).alias("_copy")).drop("_copy")
