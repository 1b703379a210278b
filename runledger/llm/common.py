"""Helpers shared by the corpus operators: shared storage, batch tokenisation, gapless numbering.

Words are always the maximal runs of bytes other than the ASCII white space
``\\x20 \\x09-\\x0D``, after lower-casing ``A-Z``; that is what
``bytes.lower().split()`` gives, so texts are handled as UTF-8 bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from runledger.storage import prepare, shared_dir, written  # noqa: F401  (used by the operators)

#: Texts are handled in runs of so many bytes, and their words in pieces of half of that, so that a worker's arrays stay small.
SLICE_BYTES = 1 << 19
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
POLY = np.uint64(0xD6E8FEB86659FD93)
SHINGLE_MULTIPLIERS = np.array(
    [0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F], np.uint64
)

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


materialize = written


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) <= n:
        size = max(n, SLICE_BYTES) + 2
        inverse = np.uint64(pow(int(POLY), -1, 1 << 64))
        for key, base in (("up", POLY), ("down", inverse)):
            row = np.full(size, base, np.uint64)
            row[0] = 1
            _POWERS[key] = np.multiply.accumulate(row)
    return _POWERS["up"], _POWERS["down"]


def _words_of(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not len(buf):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64)
    space = _SPACE[buf]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edges = np.concatenate(([0], edges))
    if not space[-1]:
        edges = np.concatenate((edges, [len(buf)]))
    starts, ends = edges[0::2], edges[1::2]
    up, down = _powers(len(buf))
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=sums[1:])
    return starts, ends, mix64((sums[ends] - sums[starts]) * down[starts])


def words_of(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of the words in a byte buffer, which is taken in pieces cut at white space."""
    parts, at = [], 0
    while at < len(buf):
        end = min(len(buf), at + SLICE_BYTES // 2)
        if end < len(buf):
            gaps = np.flatnonzero(_SPACE[buf[at:end]])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
            else:
                more = np.flatnonzero(_SPACE[buf[end:]])
                end = end + int(more[0]) + 1 if len(more) else len(buf)
        s, e, h = _words_of(buf[at:end])
        parts.append((s + at, e + at, h))
        at = end
    if not parts:
        return _words_of(buf)
    if len(parts) == 1:
        return parts[0]
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def slices(texts: pa.Array, lower: bool = True) -> Iterator[tuple[int, list[bytes], np.ndarray, np.ndarray]]:
    """Cuts a column of texts into runs of about SLICE_BYTES.

    Gives the index of the first text, the texts as bytes (null: empty), one
    buffer of them with a space after each, and the offsets of the texts in it.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int32 if texts.type in (pa.string(), pa.binary()) else np.int64)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)) if len(texts) else np.zeros(0, np.int64)
    first = 0
    while first < len(texts):
        last, total = first, 0
        while last < len(texts) and (last == first or total + sizes[last] <= SLICE_BYTES):
            total += int(sizes[last])
            last += 1
        rows = [x or b"" for x in texts.slice(first, last - first).cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()).to_pylist()]
        offsets = np.concatenate(([0], np.cumsum([len(x) + 1 for x in rows]))).astype(np.int64)
        joined = b" ".join(rows) + b" "
        yield first, rows, np.frombuffer(joined.lower() if lower else joined, np.uint8), offsets
        first = last


def word_slices(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each slice: first text, texts, buffer, word starts, ends, hashes, and for text i its words ``bounds[i]:bounds[i+1]``."""
    for first, rows, buf, offsets in slices(texts):
        starts, ends, hashes = words_of(buf)
        yield first, len(rows), buf, starts, ends, hashes, np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray, size: int = 5) -> np.ndarray:
    """Hashes of the shingles of one text; with fewer words than that, one shingle of all of them; none without words."""
    if len(words) >= size:
        total = np.zeros(len(words) - size + 1, np.uint64)
        for k in range(size):
            total += words[k : len(words) - size + 1 + k] * SHINGLE_MULTIPLIERS[k % 5]
        return mix64(total + np.uint64(size))
    if len(words) == 0:
        return np.zeros(0, np.uint64)
    total = (words * SHINGLE_MULTIPLIERS[: len(words)]).sum(dtype=np.uint64)
    return mix64(np.array([total + np.uint64(1000 + len(words))], np.uint64))


def parts(df: DataFrame) -> int:
    """Partitions for work that outlives adaptive coalescing: the session's setting."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def placed(df: DataFrame, order: list[str], label: str) -> DataFrame:
    """Sorts a table across the cluster and keeps each row's partition and place in it as ``_part`` and ``_place``.

    Range partitions are cut from a sample of ``order``; give it enough columns
    to make rows distinct, so that a frequent key is split. The result is
    written to the shared folder: numbering then never depends on a rerun.
    """
    n = parts(df)
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return materialize(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), label)


def offsets_by_part(table: DataFrame, weight: F.Column, name: str) -> DataFrame:
    """Sum of ``weight`` over all earlier partitions, one row a partition."""
    sums = table.groupBy("_part").agg(F.sum(weight).alias("_sum"))
    return sums.select("_part", (F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias(name))


def minimal_labels(edges: DataFrame, label: str) -> DataFrame:
    """Connected components: (node, component) for every node of ``edges`` (a, b), component being its smallest node.

    Each round takes the smallest label among a node's neighbours and then jumps
    to that label's own label; rounds end when no label changes.
    """
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), f"{label}-edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")), f"{label}-labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        hooked = labels.join(near, "node").select("node", "component", F.least("component", "near").alias("next"))
        up = labels.select(F.col("node").alias("next"), F.col("component").alias("above"))
        after = materialize(hooked.join(up, "next", "left").select("node", F.least("next", F.coalesce("above", "next")).alias("component"), (F.least("next", F.coalesce("above", "next")) != F.col("component")).alias("changed")), f"{label}-labels")
        moved = after.where("changed").limit(1).count()
        labels = after.select("node", "component")
        if not moved:
            return labels
