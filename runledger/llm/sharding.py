"""Minimax contiguous sharding over ordered atomic groups.

Rows of equal text are one group; groups are ordered by digest. The smallest
capacity under which a greedy pass needs no more than the wanted shards is found
by binary search, and the greedy pass at that capacity sets the cuts. The search
sees sums over digest prefixes and opens only the prefixes that a cut may fall
into, so what reaches the driver doesn't grow with the number of groups.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.llm.common import materialize, offsets_by_part, placed

FIRST_PREFIX, MORE_PREFIX = 3, 2
DIGEST = 32


def _position(sums: list[int], x: float) -> int:
    """The segment that holds byte ``x``."""
    return min(bisect_right(sums, x) - 1, len(sums) - 2)


def _reach(segments: list[tuple], sums: list[int], x: float, capacity: int, split: bool) -> float:
    """Where a shard from byte ``x`` ends. With ``split`` a segment of several groups may be cut anywhere, else nowhere."""
    if x + capacity >= sums[-1]:
        return sums[-1]
    i = _position(sums, x + capacity)
    if split and segments[i][2] > 1:
        return x + capacity
    return max(x, sums[i])


def _ends(segments, sums, capacity, shards, split) -> list[float]:
    out, x = [], 0
    for _ in range(shards):
        x = _reach(segments, sums, x, capacity, split)
        out.append(x)
    return out


def _least(segments: list[tuple], sums: list[int], shards: int, split: bool) -> int:
    """Binary search for the smallest feasible capacity."""
    low, high = max((s[3] for s in segments), default=0), max(sums[-1], 1)
    low = max(low, -(-sums[-1] // shards))
    while low < high:
        middle = (low + high) // 2
        if _ends(segments, sums, middle, shards, split)[-1] >= sums[-1]:
            high = middle
        else:
            low = middle + 1
    return low


def _totals(segments: list[tuple]) -> list[int]:
    out = [0]
    for s in segments:
        out.append(out[-1] + s[1])
    return out


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[list[str], int]:
    """Digest prefixes at which shards 1, 2, ... begin, and the largest shard's bytes.

    ``groups`` has ``key`` (hexadecimal digest, distinct) and ``bytes``.
    """

    def sums_by(length: int, within: list[str] | None) -> list[tuple]:
        rows = groups if within is None else groups.where(F.substring("key", 1, len(within[0])).isin(within))
        found = rows.groupBy(F.substring("key", 1, length).alias("prefix")).agg(F.sum("bytes"), F.count("*"), F.max("bytes")).collect()
        return [tuple(r) for r in found]

    segments = sorted(sums_by(FIRST_PREFIX, None))
    while segments:
        sums = _totals(segments)
        low, high = _least(segments, sums, shards, True), _least(segments, sums, shards, False)
        near, far = _ends(segments, sums, low, shards, False), _ends(segments, sums, high, shards, True)
        open_ = {i for a, b in zip(near, far, strict=True) for i in range(_position(sums, a), _position(sums, b) + 1) if segments[i][2] > 1 and len(segments[i][0]) < DIGEST}
        if not open_:
            ends = _ends(segments, sums, high, shards, False)
            return [segments[_position(sums, e)][0] for e in ends if e < sums[-1]], high
        kept = [s for i, s in enumerate(segments) if i not in open_]
        by_length: dict[int, list[str]] = {}
        for i in open_:
            by_length.setdefault(len(segments[i][0]), []).append(segments[i][0])
        for length, prefixes in by_length.items():
            kept += sums_by(min(DIGEST, length + MORE_PREFIX), prefixes)
        segments = sorted(kept)
    return [], 0


def shard_by_bytes(docs: DataFrame, shards: int = 8, text: str = "text") -> DataFrame:
    """Shards of near-equal bytes that keep equal texts together.

    Returns ``doc_id, size, text_crc32, law, shard, slot, grown_shard``. A null
    text has size 1, a null checksum and is equal to other null texts. Slots
    number a shard's rows from 0 without gaps; repeated ids have slots of their
    own. ``grown_shard`` is null under this law. An empty table gives an empty
    result; shards may stay empty where there are fewer groups.
    """
    t = F.col(text).cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(F.octet_length(t), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(t).alias("text_crc32"), F.coalesce(F.md5(t.cast("binary")), F.lit("")).alias("key"))
    rows = materialize(rows, "shard-rows")
    groups = materialize(rows.groupBy("key").agg(F.sum("size").alias("bytes")), "shard-groups")
    cuts, _ = minimax_cuts(groups, shards)
    shard = F.lit(0)
    for cut in cuts:
        shard = shard + (F.col("key") >= cut).cast("int")
    ranged = placed(rows.withColumn("shard", shard), ["shard", "key", "doc_id"], "shard-order")
    first, before = F.lit(0).cast("long"), 0
    for r in ranged.groupBy("shard").count().orderBy("shard").collect():
        first = F.when(F.col("shard") == r["shard"], F.lit(before)).otherwise(first)
        before += r["count"]
    # one row a partition
    offsets = F.broadcast(offsets_by_part(ranged, F.lit(1), "before"))
    return ranged.join(offsets, "_part").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("_place") - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
