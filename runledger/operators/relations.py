"""Questions over sets of records: division, parity, gaps, identities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.operators.lineage import reachable, reverse, row_hash


def common_subsets(members: DataFrame) -> DataFrame:
    """Subsets that every run of ``members`` (run_id, subset) has."""
    # one number
    all_ = members.agg(F.countDistinct("run_id").alias("all"))
    return members.groupBy("subset").agg(F.countDistinct("run_id").alias("runs")).crossJoin(F.broadcast(all_)).where(F.col("runs") == F.col("all")).select("subset", "runs")


def merged_refs(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """The first table's rows and those of the second whose key it lacks."""
    return first.unionByName(second.join(first.select(key).distinct(), key, "left_anti"))


def parity(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys whose rows differ between two copies of a table, counting repeats; no rows mean that the two are equal."""
    own = [c for c in a.columns if c != key]
    sums = lambda df, n: df.groupBy(key).agg(F.count("*").alias(f"n_{n}"), F.sum(F.xxhash64(*[x for c in own for x in (F.col(c).isNull(), F.col(c))]).cast("decimal(38,0)")).alias(f"h_{n}"))
    both = sums(a, "a").join(sums(b, "b"), key, "full_outer").where("not (n_a <=> n_b) or not (h_a <=> h_b)")
    return both.select(key, F.when(F.col("n_a").isNull(), "only_second").when(F.col("n_b").isNull(), "only_first").otherwise("differs").alias("how"))


def path_links(edges: DataFrame, starts: DataFrame, ends: DataFrame) -> DataFrame:
    """Edges on a path from one of ``starts`` to one of ``ends`` (both ``start``): source below a start, target above an end."""
    down = reachable(edges, starts).select(F.col("node").alias("source_id")).distinct()
    up = reachable(reverse(edges), ends).select(F.col("node").alias("target_id")).distinct()
    return edges.join(down, "source_id", "left_semi").join(up, "target_id", "left_semi").select("source_id", "target_id", "edge_type").distinct()


def path_diff(recorded: DataFrame, present: DataFrame) -> DataFrame:
    """Files (path, digest) that were added, removed or changed since they were recorded."""
    both = recorded.select("path", F.col("digest").alias("was")).join(present.select("path", F.col("digest").alias("is")), "path", "full_outer")
    how = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(F.col("was") != F.col("is"), "changed")
    return both.select("path", how.alias("how")).where("how is not null")


def identity(rows: DataFrame, columns: list[str], name: str) -> DataFrame:
    """Adds the digest of some columns; a null is told from an empty text."""
    return rows.withColumn(name, row_hash(*columns))


def new_rows(rows: DataFrame, ledger: DataFrame, key: str, value: str) -> DataFrame:
    """Rows that may be appended to a ledger: with a finite value, each key once (its smallest row) and not there yet."""
    finite = F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))
    once = rows.where(finite).groupBy(key).agg(F.min(F.struct(*[c for c in rows.columns if c != key])).alias("x"))
    return once.select(*[F.col(key) if c == key else F.col(f"x.{c}").alias(c) for c in rows.columns]).join(ledger.select(key).distinct(), key, "left_anti")


def guarded(cells: DataFrame, anchors: DataFrame, tolerance: float) -> DataFrame:
    """Cells (run_id, subset, value) of the anchor runs held against the anchors' values: (subset, run_id, anchor)."""
    off = F.abs(F.col("value") - F.col("anchor"))
    return cells.join(anchors, ["run_id", "subset"]).select("run_id", "subset", "value", "anchor", (off > tolerance).alias("refused"))
