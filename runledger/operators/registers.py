"""Questions over registers: label files, claims, notes, references, grades, sealed readings, costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What may continue an id, fixed by the matching rule.
ID_CHARACTERS = "[A-Za-z0-9._-]"
#: File names that are kept as they are, fixed by the naming rule.
SAFE_NAME = "^[A-Za-z0-9._@+=,-]+$"
UNIT_SECONDS = {"m": 60, "h": 3600, "d": 86400}
DOMAINS = ("views", "labels", "label_source", "group", "meta")
EFFECTS = {
    "views": ["INPUT_AFFECTING"],
    "labels": ["EVALUATION_AFFECTING", "TRAINING_AFFECTING"],
    "label_source": ["EVALUATION_AFFECTING", "TRAINING_AFFECTING"],
    "group": ["SPLIT_AFFECTING"],
}


def key_owners(keys: DataFrame) -> DataFrame:
    """The sample behind each external key (key, sample_id); ``ambiguous`` where a key names two samples, since the field can't tell them apart."""
    own = keys.where("key is not null").groupBy("key").agg(F.min("sample_id").alias("sample_id"), F.max("sample_id").alias("last"))
    return own.select("key", "sample_id", (F.col("sample_id") != F.col("last")).alias("ambiguous"))


def classified_labels(ids: DataFrame, owners: DataFrame, assignment: DataFrame, allowed: list[str]) -> DataFrame:
    """Rows of a label file (``id``) by verdict and subset: ``duplicate`` ids, ``external`` ones that no sample has,
    ``matched`` in an allowed subset, ``outside`` on any other sample (subset ``unassigned`` if it has none)."""
    own = ids.groupBy("id").agg(F.count("*").alias("n"))
    known = own.join(owners.select(F.col("key").alias("id"), "sample_id"), "id", "left").join(assignment.select("sample_id", "subset"), "sample_id", "left")
    verdict = F.when(F.col("n") > 1, "duplicate").when(F.col("sample_id").isNull(), "external").when(F.col("subset").isin(*allowed), "matched").otherwise("outside")
    subset = F.when(F.col("sample_id").isNull(), "-").otherwise(F.coalesce("subset", F.lit("unassigned")))
    return known.groupBy(verdict.alias("verdict"), subset.alias("subset")).agg(F.sum("n").alias("n"))


def empty_subsets(declared: DataFrame, assignment: DataFrame) -> DataFrame:
    """Declared subsets (subset, role) that no sample landed in."""
    return declared.join(assignment.select("subset").distinct(), "subset", "left_anti")


def default_subsets(runs: DataFrame, declared: DataFrame, touched: DataFrame, clean: DataFrame, unseal: bool) -> DataFrame:
    """Subsets to evaluate each run on: the ``clean`` ones (run_id, subset) of a run that touched any, else every held one; sealed ones only if ``unseal``."""
    held = declared.where("role in ('eval', 'sealed')")
    fresh = runs.select("run_id").join(touched.select("run_id"), "run_id", "left_anti")
    # a plan declares a few subsets
    names = F.array(*[F.lit(r["subset"]) for r in held.select("subset").collect()])
    every = fresh.select("run_id", F.explode(names).alias("subset")).unionByName(clean.select("run_id", "subset"))
    open_ = held if unseal else held.where("role <> 'sealed'")
    return every.join(open_.select("subset"), "subset", "left_semi").select("run_id", "subset").distinct()


def missing_fields(cards: DataFrame, key: str, required: list[str]) -> DataFrame:
    """Status of each card and the required fields that are null or blank in it, ``-`` for none."""
    absent = F.concat_ws(",", *[F.when(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "", c) for c in required])
    return cards.select(key, F.when(absent == "", "-").otherwise(absent).alias("missing"), F.when(absent == "", "OK").otherwise("FAIL").alias("status"))


def mask_problems(samples: DataFrame, masks: DataFrame, categories: list[int]) -> DataFrame:
    """Labelled samples (sample_id, views) without masks, and masks (sample_id, view, category_id) of an unknown view or category; one row a sample, the first of these counts."""
    own = masks.groupBy("sample_id").agg(F.max("view").alias("last"), F.min("view").alias("first"), F.max((~F.coalesce(F.col("category_id").isin(*categories), F.lit(False))).cast("int")).alias("strange"))
    problem = F.when(F.col("strange").isNull(), "no_masks").when((F.col("first") < 0) | (F.col("last") >= F.col("views")), "no_view").when(F.col("strange") == 1, "unknown_category")
    return samples.join(own, "sample_id", "left").select("sample_id", problem.alias("problem")).where("problem is not null")


def claim_differences(bound: DataFrame, given: DataFrame, key: str, both: bool = False) -> DataFrame:
    """Claims (key, name, value) that don't come out as bound; those given beyond the bound ones count only for ``both`` sides (then it is the difference of two specs)."""
    joined = bound.select(key, "name", F.col("value").alias("want"), F.lit(True).alias("bound")).join(given.select(key, "name", F.col("value").alias("got"), F.lit(True).alias("given")), [key, "name"], "full_outer" if both else "left")
    return joined.where("not (want <=> got) or bound is null or given is null").select(key, "name", "want", "got")


def mentions(notes: DataFrame, ids: DataFrame) -> DataFrame:
    """Submissions whose id stands as a whole token in a note (note_id, description), and whether it opens the note.

    Ids consist of `ID_CHARACTERS`, so a whole token is a maximal run of them and the match is a hash join.
    """
    runs = F.regexp_extract_all("description", F.lit(f"({ID_CHARACTERS}+)"), 1)
    first = F.regexp_extract("description", rf"^\s*({ID_CHARACTERS}+)", 1)
    tokens = notes.select("note_id", first.alias("first"), F.explode(F.array_distinct(runs)).alias("submission_id"))
    return tokens.join(ids.select("submission_id").distinct(), "submission_id").select("note_id", "submission_id", (F.col("first") == F.col("submission_id")).alias("leads"))


def registered_gaps(registered: DataFrame, listed: DataFrame, created: Column) -> DataFrame:
    """Files (run_id, path, at_time) registered by ``created`` that a manifest doesn't list, each once under its first run."""
    return registered.where(F.col("at_time") <= created).join(listed.select("path").distinct(), "path", "left_anti").groupBy("path").agg(F.min("run_id").alias("run_id"))


def collapsed_references(refs: DataFrame) -> DataFrame:
    """References (place, path, referrer, digest, bytes) by path: the number of referrers and the first digest and size that one of them states.

    ``place`` may be a struct; of records with equal places the least digest and size count.
    """
    # referrers apart from facts: each is counted or held map-side, also for a path that very many records name, and no fact travels with a referrer
    named = refs.groupBy("path").agg(F.countDistinct("referrer").alias("referrers"))
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("place", c)))[c].alias(c)
    facts = refs.groupBy(F.col("path").alias("own")).agg(first("digest"), first("bytes"))
    return named.join(facts, F.col("path").eqNullSafe(F.col("own"))).select("path", "referrers", "digest", "bytes")


def listing_totals(files: DataFrame) -> DataFrame:
    """Files (class, digest, bytes) by class: files, bytes, and the files and bytes that repeat a digest of the class."""
    own = files.groupBy("class", "digest").agg(F.count("*").alias("n"), F.sum("bytes").alias("all"), F.min("bytes").alias("one"))
    return own.groupBy("class").agg(F.sum("n").alias("files"), F.sum("all").alias("bytes"), F.sum(F.col("n") - 1).alias("repeats"), F.sum(F.col("all") - F.col("one")).alias("repeat_bytes"))


def group_vectors(values: DataFrame, group: str) -> DataFrame:
    """Key of a group of samples with vectors (name, value): the largest value of each place."""
    return values.groupBy(group, "name").agg(F.max("value").alias("value"))


def group_first_label(samples: DataFrame, group: str) -> DataFrame:
    """Key of a group of samples with one class: that of its first labelled sample, null without one."""
    return samples.groupBy(group).agg(F.min(F.when(F.col("cls").isNotNull(), F.struct("sample_id", "cls")))["cls"].alias("cls"))


def worst_over_heads(rows: DataFrame, severity: dict[str, int]) -> DataFrame:
    """The most severe status of each entity over several heads (head, entity_id, status); ties keep the earlier head."""
    level = F.create_map(*[F.lit(x) for pair in severity.items() for x in pair])[F.col("status")]
    best = F.min(F.struct((-level).alias("level"), "head", "status"))
    return rows.groupBy("entity_id").agg(best.alias("b")).select("entity_id", "b.status", "b.head")


def lowest_grade(owners: DataFrame, grades: DataFrame, key: str, ranks: list[str]) -> DataFrame:
    """The weakest grade among each owner's parts (key, grade), the first of ``ranks`` for an owner without parts."""
    order = F.array_position(F.array(*map(F.lit, ranks)), F.col("grade"))
    low = grades.groupBy(key).agg(F.min(order).alias("rank"))
    return owners.select(key).distinct().join(low, key, "left").select(key, F.element_at(F.array(*map(F.lit, ranks)), F.coalesce("rank", F.lit(1)).cast("int")).alias("grade"))


def sealed_readings(cards: DataFrame, readings: DataFrame, size: int) -> DataFrame:
    """The last appended sealed reading of each run and why it can't be used, empty if it can.

    ``cards``: run_id, prediction_sha of the present predictions; ``readings``: those of the sealed subset and metric (run_id, seq, value, prediction_sha, n_samples).
    """
    newest = readings.groupBy("run_id").agg(F.max(F.struct("seq", "value", F.col("prediction_sha").alias("read"), "n_samples")).alias("r")).select("run_id", "r.*")
    stale = F.col("prediction_sha").isNull() | ~F.col("prediction_sha").eqNullSafe(F.col("read"))
    why = F.when(F.col("seq").isNull(), "no_sealed_reading").when(stale, "stale_reading").when(F.col("n_samples") != size, "partial_reading").otherwise("")
    return cards.join(newest, "run_id", "left").select("run_id", "seq", "value", why.alias("unusable"))


def decade(edges: Column) -> Column:
    """Digits of the whole part less one; 0 below one edge."""
    return F.when(edges < 1, 0).otherwise(F.length(F.floor(edges).cast("decimal(38,0)").cast("string")) - 1).cast("int")


def relative_band(rows: DataFrame) -> DataFrame:
    """Root mean square of (actual - predicted) / predicted for both kinds of cost; null if an estimate isn't positive."""
    def one(kind):
        p, a = F.col(f"{kind}_predicted"), F.col(f"{kind}_actual")
        return F.when(F.min(p) > 0, F.sqrt(F.avg(((a - p) / p) * ((a - p) / p)))).alias(f"{kind}_rmse")

    return rows.agg(one("incremental"), one("full"))


def stratified_band(rows: DataFrame) -> DataFrame:
    """Root mean square error of both kinds of cost in each decade of edges."""
    def one(kind):
        off = F.col(f"{kind}_actual") - F.col(f"{kind}_predicted")
        return F.sqrt(F.avg(off * off)).alias(f"{kind}_rmse")

    return rows.groupBy(decade(F.col("edges")).alias("decade")).agg(one("incremental"), one("full"), F.count("*").alias("observations"))


def band_widths(rows: DataFrame, strata: DataFrame) -> DataFrame:
    """The incremental half-width for each estimate (id, edges): that of the nearest decade, of two equally near the higher.

    ``strata`` has one row a decade, so at most twenty.
    """
    best = [(r["decade"], r["incremental_rmse"]) for r in strata.select("decade", "incremental_rmse").collect()]
    if not best:
        return rows.select("id", F.lit(None).cast("double").alias("width"))
    own = decade(F.col("edges"))
    near = F.least(*[F.struct(F.abs(own - d).alias("off"), F.lit(-d).alias("below"), F.lit(w).cast("double").alias("width")) for d, w in best]) if len(best) > 1 else F.struct(F.lit(best[0][1]).cast("double").alias("width"))
    return rows.select("id", near["width"].alias("width"))


def worst_effect(changes: DataFrame, severity: dict[str, int], by: str) -> DataFrame:
    """The largest severity of the effects of each ``by``; effects without one count as 0."""
    level = F.coalesce(F.create_map(*[F.lit(x) for pair in severity.items() for x in pair])[F.col("effect")], F.lit(0))
    return changes.groupBy(by).agg(F.max(level).alias("severity"))


def changed_paths(paths: DataFrame) -> DataFrame:
    """Domain and effects of changed field paths (``path`` such as ``views[0].width``), one row an effect."""
    top = F.regexp_extract("path", r"^[^.\[]*", 0)
    domain = F.when(top.isin(*DOMAINS), top).otherwise("unknown")
    effects = F.create_map(*[x for k, v in EFFECTS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])[top]
    return paths.withColumns({"domain": domain, "effect": F.explode(F.coalesce(effects, F.array(F.lit("UNKNOWN"))))})


def safe_name(name: Column) -> Column:
    """A folder name: slashes become two underscores; the first 16 hex digits of the digest where that isn't safe."""
    flat = F.replace(name, F.lit("/"), F.lit("__"))
    return F.when(flat.rlike(SAFE_NAME) & ~flat.rlike("\n") & ~flat.isin(".", ".."), flat).otherwise(F.substring(F.sha2(name.cast("binary"), 256), 1, 16))


def age_seconds(text: Column) -> Column:
    """Seconds of an age such as ``24h``, ``90m``, ``7d`` or ``0``; null for anything else."""
    bare = F.trim(text)
    unit = F.create_map(*[F.lit(x) for pair in UNIT_SECONDS.items() for x in pair])[F.regexp_extract(bare, "([mhd])$", 1)]
    return F.when(bare == "0", F.lit(0).cast("long")).when(bare.rlike("^[0-9]+[mhd]$"), F.regexp_extract(bare, "^([0-9]+)", 1).cast("long") * unit)


def arrival_label(submission: Column, ref: Column) -> Column:
    """What an arrival is called: the submission's id, else ``foreign:`` and its reference."""
    return F.when(F.coalesce(submission, F.lit("")) != "", submission).otherwise(F.concat(F.lit("foreign:"), ref))


def pearson(a: Column, b: Column) -> Column:
    """Correlation of two arrays of one length; without variance 1 if they are equal, else 0."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    centred = lambda x: F.transform(x, lambda v: v.cast("double") - total(F.transform(x, lambda u: u.cast("double"))) / F.size(x))
    dot = lambda x, y: total(F.zip_with(x, y, lambda p, q: p * q))
    ca, cb = centred(a), centred(b)
    scale = F.sqrt(dot(ca, ca) * dot(cb, cb))
    return F.when(scale == 0, F.when(a == b, 1.0).otherwise(0.0)).otherwise(dot(ca, cb) / scale)


def clipped(rows: DataFrame) -> DataFrame:
    """Corners (x1, y1, x2, y2) held inside the view (width, height); left alone where its size isn't known."""
    sized = F.col("width").isNotNull() & F.col("height").isNotNull()
    inside = lambda c, most: F.when(sized, F.least(F.greatest(F.col(c), F.lit(0.0)), F.col(most).cast("double"))).otherwise(F.col(c))
    return rows.withColumns({"x1": inside("x1", "width"), "y1": inside("y1", "height"), "x2": inside("x2", "width"), "y2": inside("y2", "height")})
