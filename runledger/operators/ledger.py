"""Questions over append-only event ledgers; ``seq`` is the order of appending."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest(ledger: DataFrame, event: str) -> DataFrame:
    """The newest row of an event per submission: by platform time (missing is oldest), ties to the last appended."""
    newest = F.max(F.struct("at_time", "seq", "value"))
    return ledger.where(F.col("event") == event).groupBy("submission_id").agg(newest.alias("x")).select("submission_id", F.col("x.at_time").alias("at_time"), F.col("x.seq").alias("seq"), F.col("x.value").alias("value"))


def assign_scores(ledger: DataFrame) -> DataFrame:
    """Each scored row with the submission's last upload at or before its time (null where there is none)."""
    rows = ledger.where(F.col("event").isin("scored", "uploaded"))
    up = F.when(F.col("event") == "uploaded", F.col("seq"))
    # at equal times uploads come first
    order = Window.partitionBy("submission_id").orderBy("at_time", F.desc("event"), "seq").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("upload_seq", F.last(up, ignorenulls=True).over(order)).where("event = 'scored'").select("seq", "submission_id", "at_time", "value", "upload_seq")


def quota_windows(ledger: DataFrame, per_day: int) -> DataFrame:
    """Uploads of every platform day, and whether the day's quota is used up."""
    return ledger.where("event in ('uploaded', 'foreign')").groupBy(F.date_trunc("day", "at_time").cast("date").alias("day")).agg(F.count("*").alias("used"), F.countDistinct("submission_id").alias("submissions")).withColumn("full", F.col("used") >= per_day)


def delta_report(ledger: DataFrame) -> DataFrame:
    """Every score with its difference to the submission's previous one in order of arrival."""
    order = Window.partitionBy("submission_id").orderBy("at_time", "seq")
    return ledger.where("event = 'scored'").select("seq", "submission_id", "value", (F.col("value") - F.lag("value").over(order)).alias("delta"))


def final_ranking(ledger: DataFrame, slots: int = 10) -> DataFrame:
    """The best eligible submissions by latest score, ties to the earlier and then smaller id; errored after scoring is a reason to be out."""
    top = _gates(ledger).where("why = 'eligible'").orderBy(F.desc("value"), "scored_at", "submission_id").limit(slots)
    # at most ``slots`` rows
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("value"), "scored_at", "submission_id"))).select("rank", "submission_id", "value")


def _gates(ledger: DataFrame) -> DataFrame:
    newest = lambda event: F.max(F.when(F.col("event") == event, F.struct("at_time", "seq", "value")))
    flags = ledger.groupBy("submission_id").agg(F.max((F.col("event") == "uploaded").cast("int")).alias("up"), newest("scored").alias("s"), newest("errored").alias("e"))
    errored = F.struct("e.at_time", "e.seq") >= F.struct("s.at_time", "s.seq")
    why = F.when(F.col("up") == 0, "not_uploaded").when(F.col("s").isNull(), "no_reading").when(F.col("e").isNotNull() & errored, "errored").when(F.col("s.value").isNull(), "no_value").otherwise("eligible")
    return flags.select("submission_id", why.alias("why"), F.col("s.value").alias("value"), F.col("s.at_time").alias("scored_at"))


def gate_reasons(ledger: DataFrame) -> DataFrame:
    """Why each submission is or isn't eligible, by the first gate that stops it; ``final_ranking`` passes the same gates."""
    return _gates(ledger).select("submission_id", "why")


def merge_dedupe(first: DataFrame, second: DataFrame, key: str = "seq") -> DataFrame:
    """Both ledgers' rows once each by key; of two versions the first ledger's stays, within one ledger the smallest row."""
    own = [c for c in first.columns if c != key]
    both = first.withColumn("_side", F.lit(0)).unionByName(second.withColumn("_side", F.lit(1)))
    once = both.groupBy(key).agg(F.min(F.struct("_side", *own)).alias("x"))
    return once.select(*[F.col(key) if c == key else F.col(f"x.{c}").alias(c) for c in first.columns])


def merge_ledgers(*sources: DataFrame, at: str = "at_time", place: str = "seq") -> DataFrame:
    """All sources' rows; rows that are equal in every field are kept once, rows that differ all stay.

    ``turn`` orders them by time, then source, then place. Ids that the sources
    stage with different rows are ``staging_conflicts``.
    """
    columns = sources[0].columns
    rows = [df.select(*columns).withColumn("_source", F.lit(k)) for k, df in enumerate(sources)]
    every = rows[0]
    for df in rows[1:]:
        every = every.unionByName(df)
    return every.groupBy(*columns).agg(F.min("_source").alias("_source")).withColumn("turn", F.struct(F.col(at), F.col("_source"), F.col(place))).drop("_source")


def staging_conflicts(merged: DataFrame) -> DataFrame:
    """Submissions with more than one different ``staged`` row."""
    return merged.where("event = 'staged' and submission_id is not null").groupBy("submission_id").agg(F.count("*").alias("n")).where("n > 1")


def lock_state(ledger: DataFrame, lock: str = "staged", unlock: str = "errored") -> DataFrame:
    """Whether each submission's last lock or unlock row is a lock."""
    last = F.max(F.struct("seq", "event"))
    return ledger.where(F.col("event").isin(lock, unlock)).groupBy("submission_id").agg(last.alias("x")).select("submission_id", (F.col("x.event") == lock).alias("locked"))


def newest(rows: DataFrame, keys: list[str], first_of_ties: bool) -> DataFrame:
    """The row with the largest ``ts`` of each key; of equal times the first appended one, or the last. One struct a key is shuffled, no window."""
    rest = [c for c in rows.columns if c not in (*keys, "ts", "seq")]
    turn = (-F.col("seq") if first_of_ties else F.col("seq")).alias("turn")
    return rows.groupBy(*keys).agg(F.max(F.struct("ts", turn, "seq", *rest)).alias("x")).select(*keys, "x.ts", "x.seq", *[f"x.{c}" for c in rest])


def at_end(rows: DataFrame, keys: list[str], last: bool = True) -> DataFrame:
    """The last (or first) appended row of each key, whatever its time."""
    rest = [c for c in rows.columns if c not in (*keys, "seq")]
    pick = F.max if last else F.min
    return rows.groupBy(*keys).agg(pick(F.struct("seq", *rest)).alias("x")).select(*keys, "x.seq", *[f"x.{c}" for c in rest])


def newest_in_first_order(rows: DataFrame, key: str) -> DataFrame:
    """The last registration of each key, numbered by when the key was first registered."""
    rest = [c for c in rows.columns if c not in (key, "seq")]
    picked = rows.groupBy(key).agg(F.min("seq").alias("first_seq"), F.max(F.struct("seq", *rest)).alias("x"))
    return picked.select(key, "first_seq", "x.seq", *[f"x.{c}" for c in rest])


def reading_pairs(readings: DataFrame, baseline: str, candidate: str) -> DataFrame:
    """Both runs' newest reading of every subset and metric, with the side that is missing."""
    new = newest(readings.where(F.col("run_id").isin(baseline, candidate)), ["run_id", "subset", "metric"], True)
    side = lambda run, name: F.max(F.when(F.col("run_id") == run, F.col("value"))).alias(name)
    missing = F.when(F.col("baseline").isNull(), "baseline").when(F.col("candidate").isNull(), "candidate").otherwise("")
    return new.groupBy("subset", "metric").agg(side(baseline, "baseline"), side(candidate, "candidate")).withColumn("missing", missing)


def last_against(readings: DataFrame, baseline: str) -> DataFrame:
    """Each run's last appended reading less the baseline run's, per subset and metric."""
    last = at_end(readings, ["run_id", "subset", "metric"])
    # one row a subset and metric
    base = last.where(F.col("run_id") == baseline).select("subset", "metric", F.col("value").alias("base"))
    return last.where(F.col("run_id") != baseline).join(base, ["subset", "metric"]).select("run_id", "subset", "metric", "value", (F.col("value") - F.col("base")).alias("delta"))


def place_outcomes(ledger: DataFrame, events: tuple[str, ...] = ("scored",)) -> DataFrame:
    """What became of each upload: the newest outcome (by ``ts``, ties to the first appended) of those placed on it.

    An outcome with a platform time belongs to the submission's upload nearest in time,
    ties to the later upload and then the first appended; one without to the newest
    upload (by ``ts``, then last appended) not after it. A submission's rows meet in one
    window over both directions, so outcomes are never paired with all uploads.
    """
    up, key = F.col("event") == "uploaded", Window.partitionBy("submission_id")
    rows = ledger.where(F.col("event").isin("uploaded", *events)).select("submission_id", "seq", "ts", "at_time", "value", "event")
    # uploads of one platform time: only the first appended can be the nearest one
    first_at = F.min(F.when(up, F.col("seq"))).over(Window.partitionBy("submission_id", "at_time"))
    mark = rows.withColumn("u", F.when(up & (F.col("seq") == first_at), F.struct("at_time", "seq")))
    before = F.last("u", True).over(key.orderBy("at_time", (~up).cast("int"), "seq").rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("u", True).over(key.orderBy("at_time", up.cast("int"), "seq").rowsBetween(0, Window.unboundedFollowing))
    by_ts = F.last(F.when(up, F.col("seq")), True).over(key.orderBy("ts", (~up).cast("int"), "seq").rowsBetween(Window.unboundedPreceding, 0))
    gap = lambda a, b: F.unix_micros(a.cast("timestamp")) - F.unix_micros(b.cast("timestamp"))
    nearest = F.when(F.col("a").isNull(), F.col("b.seq")).when(F.col("b").isNull(), F.col("a.seq")).when(gap(F.col("at_time"), F.col("b.at_time")) < gap(F.col("a.at_time"), F.col("at_time")), F.col("b.seq")).otherwise(F.col("a.seq"))
    placed = mark.withColumns({"b": before, "a": after, "t": by_ts}).where(~up).withColumn("upload_seq", F.when(F.col("at_time").isNull(), F.col("t")).otherwise(nearest)).where("upload_seq is not null")
    won = placed.groupBy("submission_id", "upload_seq").agg(F.max(F.struct("ts", (-F.col("seq")).alias("turn"), "event", "value")).alias("x"))
    uploads = rows.where(up).select("submission_id", F.col("seq").alias("upload_seq"), "at_time", "ts")
    return uploads.join(won, ["submission_id", "upload_seq"], "left").select("submission_id", "upload_seq", "at_time", "ts", F.col("x.event").alias("outcome"), (-F.col("x.turn")).alias("outcome_seq"), F.col("x.value").alias("value"))


def latest_outcome(ledger: DataFrame) -> DataFrame:
    """The outcome of each submission's newest upload, by platform time and then ``ts``; null while it has none."""
    placed = place_outcomes(ledger, ("scored", "errored"))
    return placed.groupBy("submission_id").agg(F.max(F.struct("at_time", "ts", (-F.col("upload_seq")).alias("turn"), "outcome", "outcome_seq", "value")).alias("x")).select("submission_id", (-F.col("x.turn")).alias("upload_seq"), "x.outcome", "x.outcome_seq", "x.value")


def arrivals(ledger: DataFrame) -> DataFrame:
    """Every upload that the platform saw: ours, each ref once (first appended), and the newest snapshot of each foreign ref that isn't ours."""
    own = ledger.where("event = 'uploaded'")
    named = at_end(own.where("ref is not null"), ["ref"], last=False).select("seq", "submission_id", "ref", "at_time", F.lit(False).alias("foreign"))
    plain = own.where("ref is null").select("seq", "submission_id", "ref", "at_time", F.lit(False).alias("foreign"))
    others = at_end(ledger.where("event = 'foreign' and ref is not null"), ["ref"]).join(named.select("ref"), "ref", "left_anti")
    return named.union(plain).union(others.select("seq", "submission_id", "ref", "at_time", F.lit(True)))


def quota_days(arrived: DataFrame, per_day: int, zone: str, day_start_hour: int = 0) -> DataFrame:
    """Arrivals of every platform day, from ``day_start_hour`` of the zone's wall time to the same hour of the next day."""
    local = F.from_utc_timestamp(F.col("at_time").cast("timestamp"), zone) - F.expr(f"interval {day_start_hour} hours")
    return arrived.where("at_time is not null").groupBy(F.to_date(local).alias("day")).agg(F.count("*").alias("used")).withColumn("full", F.col("used") >= per_day)


def staged_conflicts(first: DataFrame, second: DataFrame) -> DataFrame:
    """Submissions that two ledgers stage with different values: these can't be merged."""
    staged = first.unionByName(second).where("event = 'staged'").groupBy("submission_id", "seq").agg(F.countDistinct(F.coalesce(F.col("value").cast("string"), F.lit("-"))).alias("versions"))
    return staged.where("versions > 1").select("submission_id", "seq", "versions")


def board(ledger: DataFrame) -> DataFrame:
    """Best and last score of each submission; of equal bests the first appended."""
    scored = ledger.where("event = 'scored' and value is not null")
    sums = scored.groupBy("submission_id").agg(F.max(F.struct("value", (-F.col("seq")).alias("turn"))).alias("best"), F.max(F.struct("seq", "value")).alias("last"))
    return sums.select("submission_id", F.col("best.value").alias("best"), (-F.col("best.turn")).alias("best_seq"), F.col("last.value").alias("last"), F.col("last.seq").alias("last_seq"))
