"""Exact top-k inner-product search with a bit-sliced index.

Vectors are quantised and cut into blocks of rows. In a block, bit j of one
attribute over all rows is a bitmap (a slice). A query's scores are a sum of
shifted slices, added with carry-save bitmap arithmetic, so the block's scores
are slices again; from the most significant slice downward they split the rows
into those surely above, surely below and still equal. Rows left equal at the
end tie exactly and go by their ids.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from runledger.llm.common import materialize, prepare

ROWS_IN_BLOCK = 32768
QUERIES_IN_BLOCK = 128
#: A block of rows is copied to so many lanes, each of which takes at most so many blocks of queries.
LEAST_LANES, QUERY_BLOCKS_IN_LANE = 8, 64
#: Quantised components beyond so many bits are scored by plain integer products instead of slices.
MOST_BITS = 20


def quantised(vector: F.Column, scale: int = 256) -> F.Column:
    """floor(scale * x) of every component; null where the vector is null or has a null or non-finite component."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(vector.isNotNull() & fine, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


class SlicedBlock:
    """The slices of one block. Values are shifted to be at least 0; a negative weight uses the complement."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[order], rows[order]
        n = len(ids)
        self.words = -(-n // 64)
        self.low = int(self.rows.min()) if rows.size else 0
        self.bits = max(1, int(int(self.rows.max()) - self.low).bit_length()) if rows.size else 1
        self.all = self._bitmap(np.ones(n, bool))
        if self.bits <= MOST_BITS:
            shifted = (self.rows - self.low).T
            self.up = [[self._bitmap((shifted[d] >> j) & 1) for j in range(self.bits)] for d in range(rows.shape[1])]
            self.down = [[~x for x in own] for own in self.up]

    def _bitmap(self, flags: np.ndarray) -> np.ndarray:
        out = np.zeros(self.words * 64, np.uint8)
        out[: len(flags)] = flags
        return np.packbits(out, bitorder="little").view(np.uint64)

    def slices_of(self, query: np.ndarray) -> list[np.ndarray]:
        """The slices of sum(|q| * w), least significant first; it is the inner product but for a constant of the query."""
        columns: list[list[np.ndarray]] = []
        for d, q in enumerate(query.tolist()):
            own = self.up[d] if q > 0 else self.down[d]
            for i in range(abs(q).bit_length()):
                if abs(q) >> i & 1:
                    while len(columns) < i + self.bits:
                        columns.append([])
                    for j, x in enumerate(own):
                        columns[i + j].append(x)
        out, at = [], 0
        while at < len(columns):
            column = columns[at]
            if at + 1 == len(columns) and len(column) > 1:
                columns.append([])
            while len(column) > 2:
                a, b, c = column.pop(), column.pop(), column.pop()
                half = a ^ b
                column.insert(0, half ^ c)
                columns[at + 1].append((a & b) | (half & c))
            if len(column) == 2:
                a, b = column
                columns[at + 1].append(a & b)
                column = [a ^ b]
            out.append(column[0] if column else np.zeros(self.words, np.uint64))
            at += 1
        return out

    def top(self, query: np.ndarray, k: int, own_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best rows of this block but the query's own: ids and scores."""
        equal = self.all & ~self._bitmap(self.ids == own_id) if (at := np.searchsorted(self.ids, own_id)) < len(self.ids) and self.ids[at] == own_id else self.all
        if self.bits > MOST_BITS or np.abs(query).max(initial=0) >= 1 << MOST_BITS:
            rows = self._members(equal)
            scores = self.rows[rows] @ query
            best = np.lexsort((self.ids[rows], -scores))[:k]
            return self.ids[rows[best]], scores[best]
        above = np.zeros(self.words, np.uint64)
        if int(np.bitwise_count(equal).sum()) > k:
            for s in reversed(self.slices_of(query)):
                ones = equal & s
                n = int(np.bitwise_count(above | ones).sum())
                if n > k:
                    equal = ones
                elif n < k:
                    above, equal = above | ones, equal & ~s
                else:
                    above, equal = above | ones, np.zeros(self.words, np.uint64)
                    break
        sure = self._members(above)
        rows = np.concatenate((sure, self._members(equal)[: k - len(sure)]))
        return self.ids[rows], self.rows[rows] @ query

    def _members(self, bitmap: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little")[: len(self.ids)])


def _matrix(ids: bytes, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    numbers = np.frombuffer(ids, np.int64)
    return numbers, np.frombuffer(data, np.int64).reshape(len(numbers), -1)


def _search(k: int):
    def run(blocks, asked):
        out = []
        for ids, data in zip(blocks["ids"], blocks["data"], strict=True):
            block = SlicedBlock(*_matrix(ids, data))
            for q_ids, q_data in zip(asked["ids"], asked["data"], strict=True):
                for own, query in zip(*_matrix(q_ids, q_data), strict=True):
                    found, scores = block.top(query, k, int(own))
                    out.append((np.full(len(found), own, np.int64), found, scores))
        columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), columns, strict=True)))

    return run


def _packed(key, rows):
    return pd.DataFrame({"block": [key[0]], "width": [key[1]], "ids": [rows["vec_id"].to_numpy(np.int64).tobytes()], "data": [np.concatenate(rows["q"].to_numpy()).astype(np.int64).tobytes()]})


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, vector: str = "embedding") -> DataFrame:
    """The k candidates of highest integer inner product for every query, ties to the smaller id.

    Both tables have ``vec_id`` (distinct) and the vector; a query is never its
    own candidate. Returns ``query_id, rank`` (from 1), ``vec_id, score``; fewer
    rows where there are fewer candidates. Null vectors and vectors with a null or
    non-finite component take no part, nor do empty ones; only vectors of equal
    length meet. The queries are a stated set that is held against all rows
    block by block; a block meets each block of queries once.
    """
    spark = vectors.sparkSession
    prepare(spark)

    def cut(df: DataFrame, size: int, label: str) -> tuple[DataFrame, int]:
        rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col(vector), scale).alias("q")).where("vec_id is not null and q is not null and size(q) > 0").withColumn("width", F.size("q"))
        blocks = max(1, -(-rows.count() // size))
        packed = materialize(rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).groupBy("block", "width").applyInPandas(_packed, "block int, width int, ids binary, data binary"), label)
        return packed, blocks

    (rows, blocks), (asked, _) = cut(vectors, ROWS_IN_BLOCK, "topk-rows"), cut(queries, QUERIES_IN_BLOCK, "topk-queries")
    lanes = max(LEAST_LANES, -(-asked.count() // QUERY_BLOCKS_IN_LANE))
    left = rows.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    right = asked.withColumn("lane", F.pmod(F.col("block"), F.lit(lanes))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    keys = ["width", "block", "lane"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_search(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
