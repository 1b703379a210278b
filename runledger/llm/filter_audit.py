"""Interaction audit of five document filters under all 120 orders.

A document's failures are five bits. A table of 32 by 120 gives, for every set of
failures and every order, the step that removes the document. Documents are counted by
part, failures and labels; each task looks its cells up in the table and adds them
into one array a part and label; the arrays are summed across tasks.

Filter E (copies) needs other rows: the rows that hold the smallest id of their
text are found by digest, and all others with a larger id fail it. Texts are read
once and don't enter a shuffle, and no group of copies is gathered.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from runledger.llm.common import SLICE_BYTES, materialize, prepare

FILTERS = "ABCDE"
ORDERS = tuple("".join(x) for x in permutations(FILTERS))
STEPS = len(FILTERS)
LEAST_WORDS = 200
UPPER = bytes(range(0x41, 0x5B))
INSIDE = bytes(range(0x80, 0xC0))  # bytes that continue a code point
SYMBOLS = b"#$%&*|"
SPACE = re.compile(rb"[\x20\x09-\x0D]")
CELLS = len(ORDERS) * STEPS


def first_failures() -> np.ndarray:
    """For every set of failures (bit k: filter k) and order, the first step whose filter fails, STEPS where none does."""
    table = np.full((1 << STEPS, len(ORDERS)), STEPS, np.int64)
    for at, order in enumerate(ORDERS):
        for step in reversed(range(STEPS)):
            failing = (np.arange(1 << STEPS) >> FILTERS.index(order[step])) & 1 == 1
            table[failing, at] = step
    return table


def word_counts(text: bytes) -> tuple[int, int]:
    """Words and distinct words; long texts are split in pieces cut at white space, so only distinct words are held at once."""
    if len(text) <= SLICE_BYTES:
        words = text.split()
        return len(words), len(set(words))
    count, seen, at = 0, set(), 0
    while at < len(text):
        gap = SPACE.search(text, at + SLICE_BYTES)
        end = gap.start() if gap else len(text)
        words = text[at:end].split()
        count += len(words)
        seen.update(words)
        at = end
    return count, len(seen)


def failures(text: bytes) -> int:
    """Bits of filters A to D."""
    words, distinct = word_counts(text)
    capitals = len(text) - len(text.translate(None, UPPER))
    points = len(text.translate(None, INSIDE))
    return (words < LEAST_WORDS) | (100 * distinct < 50 * words) << 1 | (100 * capitals > 3 * points) << 2 | (len(text.translate(None, SYMBOLS)) < len(text)) << 3


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(2)
        kind = pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()
        bits, digests = [], []
        for x in texts.cast(kind):
            text = x.as_py() or b""
            bits.append(failures(text))
            digests.append(hashlib.sha256(text).digest())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bits, pa.int32()), pa.array(digests, pa.binary())], names=["doc_id", "part", "bits", "digest"])


def document_facts(docs: DataFrame) -> DataFrame:
    """``doc_id, part, bits, digest`` of every row (A to D; null text: empty, null language: empty string), written once."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.col("text").cast("string").alias("text"))
    return materialize(rows.mapInArrow(_facts, "doc_id long, part string, bits int, digest binary"), "audit-facts")


def _audit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``part, bits, good, toxic, n`` to arrays by part: documents, failures by filter and lone failures, and by order and step removals, good and toxic ones."""
    table = first_failures()
    flat = np.arange(len(ORDERS))[None, :] * (STEPS + 1) + table
    single = 1 << np.arange(STEPS)
    totals: dict[str, list[np.ndarray]] = {}
    for batch in batches:
        found = batch.column(0).dictionary_encode()
        names = found.dictionary.to_pylist()
        bits, good, toxic, n = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (1, 2, 3, 4))
        places = found.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        for k, name in enumerate(names):
            own = places == k
            size = (STEPS + 1) * len(ORDERS)
            masks = [np.bincount(bits[own], weights=(n * w)[own], minlength=1 << STEPS).astype(np.int64) for w in (np.ones_like(n), good, toxic)]
            removed = [np.bincount(flat.ravel(), weights=np.repeat(m, len(ORDERS)), minlength=size).astype(np.int64) for m in masks]
            steps = [r.reshape(len(ORDERS), STEPS + 1)[:, :STEPS].ravel() for r in removed]
            fails = np.array([masks[0][(np.arange(1 << STEPS) & bit) > 0].sum() for bit in single])
            add = [masks[0].sum(keepdims=True), fails, masks[0][single], *steps]
            totals[name] = [x + y for x, y in zip(totals[name], add, strict=True)] if name in totals else add
    if totals:
        columns = [pa.array([v[k].tolist() for v in totals.values()], pa.list_(pa.int64())) for k in range(6)]
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.string()), *columns], names=["part", "docs", "fails", "lone", "removed", "good", "toxic"])


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What each filter removes at each step of all 120 orders, by language.

    ``docs`` has ``doc_id, text, lang``, ``labels`` has ``doc_id, quality, toxic``;
    other columns are ignored. Returns ``part, filter_order, step, kept, removed,
    redundant, unique_fails, good_lost, toxic_lost, shapley``, 600 rows a part,
    zeros included; an empty table has no part. A row without an id has no
    smaller id than others, is no smaller id to them and has no label. Of
    repeated rows of one id and text none fails E for the other. An id with
    several labels counts as good or toxic where any of them is.
    """
    facts = document_facts(docs)
    # equal rows are added up before anything is dealt by id
    rows = facts.groupBy("doc_id", "digest", "part", "bits").agg(F.count("*").alias("n"))
    first = facts.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("first_id"))
    known = F.col("doc_id").isNotNull()
    rows = rows.join(first.withColumnRenamed("digest", "first_digest"), (F.col("doc_id") == F.col("first_id")) & (F.col("digest") == F.col("first_digest")), "left")
    rows = rows.withColumn("bits", F.col("bits") + F.when(known & F.col("first_id").isNull(), 1 << 4).otherwise(0))
    own = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("label_id"))
    own = own.agg(F.max(F.coalesce((F.col("quality") == 1).cast("int"), F.lit(0))).alias("good"), F.max(F.coalesce((F.col("toxic") == 1).cast("int"), F.lit(0))).alias("toxic")).withColumn("has_id", F.lit(True))
    # rows without an id are dealt by digest, and match nothing
    rows = rows.withColumn("key", F.coalesce("doc_id", F.xxhash64("digest"))).withColumn("known", known)
    rows = rows.join(own, (F.col("key") == F.col("label_id")) & (F.col("known") == F.col("has_id")), "left")
    rows = rows.select("part", "bits", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"), "n")
    # at most 128 cells a part are left, so that a part's arrays are few whatever the number of tasks
    counted = rows.groupBy("part", "bits", "good", "toxic").agg(F.sum("n").alias("n")).repartition("part")
    array = "array<long>"
    partial = materialize(counted.mapInArrow(_audit, f"part string, docs {array}, fails {array}, lone {array}, removed {array}, good {array}, toxic {array}"), "audit-sums")

    def each(*arrays: str) -> DataFrame:
        """The arrays summed across tasks, element by element."""
        rows = partial.select("part", F.posexplode(F.arrays_zip(*arrays)).alias("at", "v"))
        return rows.groupBy("part", "at").agg(*[F.sum(f"v.{x}").alias(x) for x in arrays])

    steps = each("removed", "good", "toxic")
    order = F.element_at(F.array(*[F.lit(x) for x in ORDERS]), (F.floor(F.col("at") / STEPS) + 1).cast("int"))
    steps = steps.select("part", order.alias("filter_order"), (F.col("at") % STEPS + 1).cast("int").alias("step"), "removed", "good", "toxic")
    steps = steps.withColumn("filter", F.substring(F.col("filter_order"), F.col("step"), F.lit(1)))
    singles = each("fails", "lone").select(F.col("part").alias("p"), F.element_at(F.array(*[F.lit(x) for x in FILTERS]), (F.col("at") + 1).cast("int")).alias("f"), "fails", "lone")
    sizes = each("docs").select(F.col("part").alias("q"), "docs")
    steps = steps.join(singles, (F.col("part") == F.col("p")) & (F.col("filter") == F.col("f"))).join(sizes, F.col("part") == F.col("q"))
    done = F.sum("removed").over(Window.partitionBy("part", "filter_order").orderBy("step"))
    return steps.select(
        "part", "filter_order", "step",
        (F.col("docs") - done).alias("kept"), "removed", (F.col("fails") - F.col("removed")).alias("redundant"), F.col("lone").alias("unique_fails"),
        F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"), F.sum("removed").over(Window.partitionBy("part", "filter")).alias("shapley"),
    )
