"""Stratified splits with exact sizes in a reproducible random order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from runledger.functions.columns import draw_key
from runledger.storage import written


def strata_quota(rows: DataFrame, stratum: str, wanted: int) -> DataFrame:
    """How many each stratum gives: its exact share rounded down, then one each by largest fraction, ties by name. One row a stratum."""
    sizes = rows.groupBy(stratum).count()
    whole = sizes.agg(F.sum("count").alias("all"))
    shares = sizes.crossJoin(F.broadcast(whole)).select(stratum, "count", (F.lit(wanted) * F.col("count")).alias("x"), "all")
    shares = shares.select(stratum, "count", F.least("count", F.floor(F.expr("x div all"))).alias("low"), (F.col("x") % F.col("all")).alias("rest"))
    left = shares.agg((F.lit(wanted) - F.sum("low")).alias("left"))
    turn = F.row_number().over(Window.orderBy(F.desc("rest"), stratum))
    return shares.crossJoin(F.broadcast(left)).withColumn("turn", turn).select(stratum, F.col("count").alias("size"), (F.col("low") + (F.col("turn") <= F.col("left")).cast("long")).alias("quota"))


def take_quota(rows: DataFrame, stratum: str, key: str, quotas: DataFrame, seed: int) -> DataFrame:
    """The first ``quota`` rows of each stratum in digest order.

    Digest prefixes are counted first; only the prefix in which the quota ends is
    ranked, so no task holds a stratum.
    """
    marked = rows.withColumn("draw", draw_key(seed, F.col(key))).withColumn("prefix", F.substring("draw", 1, 3))
    counts = marked.groupBy(stratum, "prefix").count()
    before = Window.partitionBy(stratum).orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0))).join(quotas.select(stratum, "quota"), stratum)
    met = counts.where("before < quota").select(stratum, "prefix", "before", "count", "quota")
    near = marked.join(met, [stratum, "prefix"])
    sure = near.where("before + count <= quota").withColumn("rank", F.lit(0))
    edge = near.where("before + count > quota").withColumn("rank", F.row_number().over(Window.partitionBy(stratum, "prefix").orderBy("draw", key)) + F.col("before"))
    return sure.union(edge.where("rank <= quota")).select(*rows.columns)


def distribution(assigned: DataFrame) -> DataFrame:
    """Counts of subset and class, with shares of the subset."""
    counts = assigned.groupBy("subset", "cls").count()
    return counts.join(counts.groupBy("subset").agg(F.sum("count").alias("all")), "subset").select("subset", "cls", F.col("count").alias("n"), (F.col("count") / F.col("all")).alias("share"))


def crossing_groups(assigned: DataFrame) -> DataFrame:
    """Groups whose samples are in more than one subset: the split's invariant names them."""
    return assigned.groupBy("grp").agg(F.countDistinct("subset").alias("subsets"), F.count("*").alias("n")).where("subsets > 1")


def group_split(samples: DataFrame, seed: int = 0) -> DataFrame:
    """Whole groups to subsets by digest: 70 % train, 10 % each of valA, valB and holdout, in expectation."""
    b = F.pmod(F.conv(F.substring(draw_key(seed, F.col("grp")), 1, 8), 16, 10).cast("long"), F.lit(1000))
    return samples.select("sample_id", "cls", "grp", F.when(b < 700, "train").when(b < 800, "valA").when(b < 900, "valB").otherwise("holdout").alias("subset"))


#: Pieces in which running sums over label vectors are made.
PIECES = 64


def _shared(vectors: DataFrame, wanted: int, all_: int) -> DataFrame:
    """``share``: whole numbers near wanted * open / all_ that add up to ``wanted``, by running sums in an order of pieces, then vectors."""
    cut = vectors.withColumn("piece", F.pmod(F.xxhash64("v"), F.lit(PIECES)))
    own = cut.groupBy("piece").agg(F.sum("open").alias("s"))
    own = own.select("piece", F.coalesce(F.sum("s").over(Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("above"))
    within = F.coalesce(F.sum("open").over(Window.partitionBy("piece").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    below = cut.withColumn("within", within).join(F.broadcast(own), "piece").withColumn("s", F.col("within") + F.col("above"))
    upto = lambda x: F.floor(x.cast("decimal(38,0)") * wanted / all_)
    return below.withColumn("share", (upto(F.col("s") + F.col("open")) - upto(F.col("s"))).cast("long")).drop("piece", "within", "above", "s")


def multilabel_quota(samples: DataFrame, key: str, labels: str, wanted: int) -> DataFrame:
    """How many samples of each label vector are taken: (v, names, size, quota), quotas adding up to ``wanted``.

    Iterative stratification on counted vectors: the label with the fewest samples
    not yet decided goes first, and its samples are taken until the label has its
    share of ``wanted``, spread over the vectors that hold it; then the next label.
    Samples without labels fill up. What is still too much or too little is
    balanced greedily: the vector that mends the labels' counts most moves first,
    in blocks. Ties go by name, so the result doesn't depend on partitions.

    A job or two a label; the driver sees one row a label and never the vectors.
    Null labels and repeats are left out, a null list is an empty one.
    """
    names = F.array_sort(F.array_distinct(F.array_compact(F.coalesce(F.col(labels), F.array().cast("array<string>")))))
    vectors = samples.withColumn("names", names).groupBy("names").agg(F.count(F.lit(1)).alias("size"))
    vectors = written(vectors.select(vector_key(F.col("names")).alias("v"), "names", "size", F.lit(0).cast("long").alias("quota"), F.lit(False).alias("done")), "vectors")
    all_ = vectors.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    wanted = max(0, min(wanted, all_))
    by_label = lambda: {r["l"]: r for r in vectors.select(F.explode("names").alias("l"), "*").groupBy("l").agg(F.sum("size").alias("size"), F.sum("quota").alias("quota"), F.sum(F.when(~F.col("done"), F.col("size")).otherwise(0)).alias("left")).collect()}
    while True:
        # one row a label
        counts = by_label()
        open_ = [(r["left"], name) for name, r in counts.items() if r["left"]]
        if not open_:
            break
        left, name = min(open_)
        target = (2 * wanted * counts[name]["size"] + all_) // (2 * all_)
        take = max(0, min(left, target - counts[name]["quota"]))
        turn = ~F.col("done") & F.array_contains("names", name)
        shared = _shared(vectors.withColumn("open", F.when(turn, F.col("size")).otherwise(0)), take, left)
        vectors = written(shared.select("v", "names", "size", F.when(turn, F.col("share")).otherwise(F.col("quota")).alias("quota"), (F.col("done") | turn).alias("done")), "vectors")
    if not all_:
        return vectors.drop("done")
    short = wanted - vectors.agg(F.sum("quota")).first()[0]
    free = min(max(short, 0), vectors.where(F.size("names") == 0).agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0])
    vectors = vectors.withColumn("quota", F.when(F.size("names") == 0, F.lit(free)).otherwise(F.col("quota")))
    short -= free
    while short:
        vectors = written(vectors, "vectors")
        sign = 1 if short > 0 else -1
        need = {name: sign * (wanted * r["size"] / all_ - r["quota"]) for name, r in by_label().items()}
        room = (F.col("size") - F.col("quota")) if short > 0 else F.col("quota")
        score = F.aggregate("names", F.lit(0.0), lambda a, x: a + F.element_at(F.create_map(*[F.lit(y) for kv in need.items() for y in kv]), x)) if need else F.lit(0.0)
        best = vectors.where(room > 0).select("v", score.alias("score"), room.alias("room"), F.size("names").alias("n")).orderBy(F.desc("score"), "v").first()
        move = max(1, min(best["room"], abs(short), max(int(best["score"] / max(2 * best["n"], 1)), abs(short) // 4)))
        vectors = vectors.withColumn("quota", F.col("quota") + F.when(F.col("v") == best["v"], sign * move).otherwise(0))
        short -= sign * move
    return vectors.drop("done")


def vector_key(names: Column) -> Column:
    """One text a label vector, each name after its length."""
    return F.array_join(F.transform(names, lambda x: F.concat(F.length(x).cast("string"), F.lit(":"), x)), "")


def multilabel_take(samples: DataFrame, key: str, labels: str, wanted: int, seed: int = 0) -> DataFrame:
    """Exactly ``wanted`` samples (all, if fewer) with the labels in proportion; of one label vector the first in digest order."""
    names = F.array_sort(F.array_distinct(F.array_compact(F.coalesce(F.col(labels), F.array().cast("array<string>")))))
    quotas = multilabel_quota(samples, key, labels, wanted).select(F.col("v").alias("__v"), "quota")
    return take_quota(samples.withColumn("__v", vector_key(names)), "__v", key, written(quotas, "quotas"), seed).drop("__v")


def fixed_split(samples: DataFrame, subsets: list[tuple[str, float]], rest: str = "train", seed: int = 0) -> DataFrame:
    """Exact sizes: each subset takes its share (halves to even) of the eligible samples from what is left, by strata.

    Samples without a gold label are never held out. ``subsets`` are carved in the
    order given (sealed ones first). A pass a subset; each ranks only the digest prefix in
    which a stratum's quota ends.
    """
    eligible = samples.where("label_source = 'gold' and cls is not null").select("sample_id", "cls")
    n = eligible.count()
    taken, left = None, eligible
    for step, (name, ratio) in enumerate(subsets):
        quotas = strata_quota(left, "cls", round(ratio * n))
        own = written(take_quota(left, "cls", "sample_id", quotas, seed * 1000 + step).select("sample_id", F.lit(name).alias("subset")), "subset")
        taken = own if taken is None else taken.union(own)
        left = left.join(own, "sample_id", "left_anti")
    return samples.select("sample_id").join(taken, "sample_id", "left").select("sample_id", F.coalesce("subset", F.lit(rest)).alias("subset"))
