"""Named queries over whole tables, each with DuckDB SQL of the same result (fixtures in braces)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger import fixtures
from runledger.functions.columns import text_hash64
from runledger.operators import audit, fusion, ledger, lineage, metrics, split, statistics
from runledger.sources import records

CATALOGUE: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}
HELD = ("valA", "valB", "holdout")
WEIGHTS = {"baseline": 1.0, "candidate": 2.0, "third": 1.0}
DRAWS = 200


def query(sql: str | None = None):
    def add(f):
        CATALOGUE[f.__name__] = (f, sql)
        return f

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 9) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def scores(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.table(spark, d, "fx_scores").where(F.col("subset").isin(*HELD))


#: The held-out scores and their argmax, as CTEs of the oracles.
_HELD = "sc as (select * from {fx_scores} where subset in ('valA', 'valB', 'holdout')), am as (select run_id, subset, sample_id, any_value(gold) as gold, arg_max(cls_id, raw * 10 - cls_id) as predicted from sc group by all)"
_F1 = "pc as (select run_id, subset, c as cls_id, sum((gold = c and predicted = c)::int)::bigint as tp, sum((gold <> c and predicted = c)::int)::bigint as fp, sum((gold = c and predicted <> c)::int)::bigint as fn from (select *, unnest(list_distinct([gold, predicted])) as c from am) group by all), f1 as (select *, case when tp + fn > 0 then 2.0::double * tp / (2 * tp + fp + fn) end as f1 from pc)"
_AUC = "auc as (select run_id, subset, cls_id, case when p * (n - p) > 0 then (rs - p * (p + 1) / 2.0::double) / (p * (n - p)) end as auc from (select run_id, subset, cls_id, sum(rk) filter (gold = cls_id) as rs, count(*) filter (gold = cls_id)::double as p, count(*)::double as n from (select *, rank() over w + (count(*) over (partition by run_id, subset, cls_id, raw) - 1) / 2.0::double as rk from sc window w as (partition by run_id, subset, cls_id order by raw)) group by all))"


@query(f"with {_HELD} select run_id, subset, round(avg((gold = predicted)::int), 9) as value, count(*) as n_samples from am group by all")
def metric_accuracy(spark, d):
    return rounded(metrics.accuracy(scores(spark, d)), "value")


@query(f"with {_HELD}, {_F1} select run_id, subset, cls_id, tp, fp, fn, round(f1, 9) as f1 from f1")
def metric_per_class(spark, d):
    return rounded(metrics.per_class(scores(spark, d)), "f1")


@query(f"with {_HELD}, {_F1} select run_id, subset, round(avg(f1), 9) as value from f1 group by all")
def metric_macro_f1(spark, d):
    return rounded(metrics.macro_f1(scores(spark, d)), "value")


@query(f"with {_HELD}, t as (select run_id, subset, sample_id, sum(raw) as total from sc group by all), p as (select sc.*, least(greatest(raw::double / total, 1e-15), 1.0::double) as p from sc join t using (run_id, subset, sample_id)), r as (select run_id, subset, sample_id, sum(p) as al, sum(p) filter (cls_id = gold) as own from p group by all) select run_id, subset, round(-avg(ln(own / al)), 8) as value from r group by all")
def metric_log_loss(spark, d):
    return rounded(metrics.log_loss(scores(spark, d)), "value", digits=8)


@query(f"with {_HELD}, {_AUC} select run_id, subset, cls_id, round(auc, 9) as auc from auc")
def metric_class_auc(spark, d):
    return rounded(metrics.class_auc(scores(spark, d)), "auc")


@query(f"with {_HELD}, {_AUC} select run_id, subset, round(avg(auc), 9) as value from auc group by all")
def metric_macro_auc(spark, d):
    return rounded(metrics.macro_auc(scores(spark, d)), "value")


@query("select subset, round(sqrt(avg((predicted - gold) * (predicted - gold))), 4) as rmse, round(avg(abs(predicted - gold)), 4) as mae, count(*) as n from {fx_targets} group by all")
def metric_rmse_mae(spark, d):
    return rounded(metrics.regression(fixtures.table(spark, d, "fx_targets")), "rmse", "mae", digits=4)


@query("with px as (select distinct side, image_id, category_id, unnest(range(start, start + len)) as p from {fx_mask_runs}), t as (select category_id, count(*) filter (side = 'gold') as g, count(*) filter (side = 'predicted') as q from px group by all), i as (select a.category_id, count(*) as both_ from px a join px b using (image_id, category_id, p) where a.side = 'gold' and b.side = 'predicted' group by all) select category_id, both_::bigint as shared, round(2.0::double * both_ / (g + q), 9) as dice, round(both_::double / (g + q - both_), 9) as iou from t join i using (category_id)")
def metric_dice_iou_runs(spark, d):
    return rounded(metrics.mask_overlap(fixtures.table(spark, d, "fx_mask_runs")), "dice", "iou")


_WORD = "(('0x' || substr(md5('0|' || {{a}} || '|' || {{b}}), 1, 8))::bigint)"
_BOOT = (
    f"{_HELD}, h as (select run_id, subset, sample_id, (gold = predicted)::int as hit from am), w as (select a.subset, a.sample_id, b.hit - a.hit as d from h a join h b using (subset, sample_id) where a.run_id = 'baseline' and b.run_id = 'candidate'),"
    " nb as (select *, row_number() over (partition by subset order by ('0x' || substr(md5(sample_id), 1, 8))::bigint % 64, sample_id) - 1 as place, count(*) over (partition by subset) as n from w),"
    f" ask as (select subset, n, draw, (('0x' || substr(md5('0|' || draw || '|' || place), 1, 8))::bigint) % n as place from nb, range({DRAWS}) r(draw)),"
    " rs as (select subset, draw, avg(d) as delta from ask join nb using (subset, place) group by all),"
    " bs as (select subset, n, delta, se, case when se <> 0 then delta / se when delta = 0 then 0 else sign(delta) * 1e9 end as t from (select subset, count(*) as n, avg(d) as delta from w group by all) join (select subset, stddev_samp(delta) as se from rs group by all) using (subset))"
)
_SIGMA = "sg as (select count(*) as runs, case when count(*) >= 3 then stddev_samp(a - b) / sqrt(2.0::double) end as sigma from (select run_id, avg((gold = predicted)::int) filter (subset = 'valA') as a, avg((gold = predicted)::int) filter (subset = 'valB') as b from am group by all) where a - b is not null)"


@query(f"with {_BOOT} select subset, n, round(delta, 9) as delta, round(se, 9) as se, round(t, 6) as t from bs")
def paired_bootstrap(spark, d):
    return rounded(rounded(statistics.paired_bootstrap(metrics.hits(scores(spark, d)), "baseline", "candidate", DRAWS), "delta", "se"), "t", digits=6)


@query(f"with {_HELD}, {_SIGMA} select runs, round(sigma, 9) as sigma from sg")
def sigma_splithalf(spark, d):
    return rounded(statistics.sigma_split_half(metrics.accuracy(scores(spark, d))), "sigma")


@query(f"with {_BOOT}, {_SIGMA}, s as (select count(*) as bases, sum((delta > 0 and t >= 2)::int)::bigint as bases_positive, avg(delta) as mean_delta from bs), r as (select *, concat_ws(',', case when bases_positive < 2 then 'bases' end, case when sigma is null then 'no_sigma' when mean_delta < sigma then 'sigma' end) as reasons from s, sg) select bases, bases_positive, round(mean_delta, 9) as mean_delta, round(sigma, 9) as sigma, case when reasons = '' then 'PASS' else 'FAIL' end as verdict, reasons from r")
def judge_verdict(spark, d):
    held = scores(spark, d)
    bases = statistics.paired_bootstrap(metrics.hits(held), "baseline", "candidate", DRAWS)
    return rounded(statistics.judge(bases, statistics.sigma_split_half(metrics.accuracy(held))), "mean_delta", "sigma")


_QUOTA = "z as (select cls, count(*) as size from {fx_samples} group by all), q0 as (select cls, size, least(size, 100 * size // (select sum(size) from z)) as low, 100 * size % (select sum(size) from z) as rest from z), q as (select cls, size, (low + (row_number() over (order by rest desc, cls) <= 100 - (select sum(low) from q0))::int)::bigint as quota from q0)"


@query(f"with {_QUOTA} select * from q")
def split_strata_quota(spark, d):
    return split.strata_quota(fixtures.table(spark, d, "fx_samples"), "cls", 100)


@query(f"with {_QUOTA}, m as (select s.cls, sample_id, row_number() over (partition by s.cls order by md5('3|' || sample_id), sample_id) as rk from {{fx_samples}} s) select m.cls, sample_id from m join q on m.cls = q.cls where rk <= quota")
def split_stratified_take(spark, d):
    rows = fixtures.table(spark, d, "fx_samples").select("cls", "sample_id")
    return split.take_quota(rows, "cls", "sample_id", split.strata_quota(rows, "cls", 100), 3)


@query("select subset, cls, n, round(n::double / sum(n) over (partition by subset), 9) as share from (select subset, cls, count(*) as n from {fx_assignment} group by all)")
def split_distribution(spark, d):
    return rounded(split.distribution(fixtures.table(spark, d, "fx_assignment")), "share")


@query("select grp, count(distinct subset) as subsets, count(*) as n from {fx_assignment} group by all having count(distinct subset) > 1")
def split_crossing_groups(spark, d):
    return split.crossing_groups(fixtures.table(spark, d, "fx_assignment"))


@query("select sample_id, cls, grp, case when b < 700 then 'train' when b < 800 then 'valA' when b < 900 then 'valB' else 'holdout' end as subset from (select *, ('0x' || substr(md5('0|' || grp), 1, 8))::bigint % 1000 as b from {fx_samples})")
def split_by_group(spark, d):
    return split.group_split(fixtures.table(spark, d, "fx_samples"))


_HASH = "hs as (select doc_id, sum(case when unicode(substring(text, (((9*(k//8)+k%8+1)*length(text))//72)::int+1,1)) > unicode(substring(text, (((9*(k//8)+k%8)*length(text))//72)::int+1,1)) then bit else 0::hugeint end) as u from {documents}, (select k, (1::hugeint << (63-k)) as bit from range(0,64) t(k)) group by 1), h as (select doc_id, (case when u >= 9223372036854775808::hugeint then u - 18446744073709551616::hugeint else u end)::bigint as h from hs)"


def hashes(spark, d):
    return fixtures.table(spark, d, "documents").where("text is not null").select("doc_id", text_hash64(F.col("text")).alias("h"))


@query(f"with {_HASH}, c as (select h, count(*) as n from h group by all) select a.h as h_a, b.h as h_b, a.n as n_a, b.n as n_b, bit_count(xor(a.h, b.h))::int as distance from c a join c b on a.h < b.h and bit_count(xor(a.h, b.h)) <= 4")
def near_pairs_hamming(spark, d):
    return audit.near_pairs(hashes(spark, d))


@query(f"with {_HASH}, c as (select doc_id % 2 as side, h, count(*) as n from h group by all) select a.h as h_a, b.h as h_b, a.n as n_a, b.n as n_b, bit_count(xor(a.h, b.h))::int as distance from c a join c b on a.side = 0 and b.side = 1 and bit_count(xor(a.h, b.h)) <= 4")
def cross_overlap(spark, d):
    found = hashes(spark, d)
    return audit.near_pairs(found.where("doc_id % 2 = 0"), found.where("doc_id % 2 = 1"))


@query(f"with recursive {_HASH}, e as (select a.h as a, b.h as b from (select distinct h from h) a join (select distinct h from h) b on a.h <> b.h and bit_count(xor(a.h, b.h)) <= 4), r as (select a as node, a as r from e union select r.node, e.b from r join e on r.r = e.a), g as (select node, min(r) as g from r group by all), m as (select h.doc_id, coalesce(g.g, h.h) as g from h left join g on h.h = g.node) select doc_id, min(doc_id) over (partition by g) as group_id from m qualify count(*) over (partition by g) > 1")
def dup_groups(spark, d):
    found = lineage.written(hashes(spark, d), "hashes")
    labels = lineage.components(audit.near_pairs(found).select(F.col("h_a").alias("a"), F.col("h_b").alias("b")))
    member = found.join(labels, found.h == labels.node, "left").select("doc_id", F.coalesce("component", "h").alias("g"))
    groups = member.groupBy("g").agg(F.min("doc_id").alias("group_id"), F.count("*").alias("n")).where("n > 1")
    return member.join(groups, "g").select("doc_id", "group_id")


@query("select l_orderkey, l_linenumber, x, y, w, h, category_id, problem from (select *, case when w <= 0 or h <= 0 then 'non_positive' when x < -1 or y < -1 then 'negative_origin' when x + w > 641 or y + h > 481 then 'out_of_bounds' when w < 2 or h < 2 then 'tiny' when greatest(w, h) > 20 * least(w, h) then 'aspect' when w * h >= 0.98 * 640 * 480 then 'covers' end as problem from {fx_boxes}) where problem is not null")
def box_coords_audit(spark, d):
    return audit.box_problems(fixtures.table(spark, d, "fx_boxes"))


@query("select l_orderkey, category_id, x, y, w, h, count(*) as n from {fx_boxes} group by all having count(*) > 1")
def duplicate_boxes(spark, d):
    return audit.duplicate_boxes(fixtures.table(spark, d, "fx_boxes"))


@query("with s as (select * from {fx_scores} where subset in ('valA', 'valB', 'holdout')) select subset, sample_id, cls_id, round(sum(raw * case run_id when 'candidate' then 2 else 1 end) / 4.0::double, 6) as value from s group by all having count(*) = 3")
def fuse_mean(spark, d):
    return rounded(fusion.fuse_mean(scores(spark, d), WEIGHTS), "value", digits=6)


@query("with s as (select * from {fx_scores} where subset in ('valA', 'valB', 'holdout')), r as (select *, case when count(*) over k > 1 then (rank() over (partition by run_id, subset, cls_id order by raw) - 1 + (count(*) over (partition by run_id, subset, cls_id, raw) - 1) / 2.0::double) / (count(*) over k - 1) else 0.5 end as rk from s window k as (partition by run_id, subset, cls_id)) select subset, sample_id, cls_id, round(sum(rk * case run_id when 'candidate' then 2 else 1 end) / 4.0::double, 8) as value from r group by all having count(*) = 3")
def fuse_rank_mean(spark, d):
    return rounded(fusion.fuse_rank_mean(scores(spark, d), WEIGHTS), "value", digits=8)


@query()
def fuse_wbf(spark, d):
    """Two members: the boxes of ``fx_boxes`` and the same boxes moved and scored otherwise; no SQL, tested by hand values."""
    own = fixtures.table(spark, d, "fx_boxes").where("w > 0").select(F.col("l_orderkey").alias("image_id"), F.col("category_id").cast("int").alias("category_id"), *[F.col(c).cast("double").alias(c) for c in "xywh"], ((F.col("x") % 97 + 1) / 100.0).alias("score"), F.lit(1.0).alias("weight"))
    moved = own.withColumns({"x": F.col("x") + 2, "score": (F.col("y") % 89 + 1) / 100.0})
    return fusion.fuse_boxes(own.union(moved), 2)


def framed_sql(*columns: str) -> str:
    """DuckDB SQL of ``columns.framed``."""
    return "concat(" + ", ".join(f"case when {c} is null then '~' else concat(length({c}::varchar), ':', {c}::varchar) end" for c in columns) + ")"


_DIFF = f"a as (select sample_id, labels, grp, views, sha256({framed_sql('labels', 'grp', 'views')}) as bh from {{fx_v1}}), b as (select sample_id, labels, grp, views, sha256({framed_sql('labels', 'grp', 'views')}) as ah from {{fx_v2}}), " "j as (select coalesce(a.sample_id, b.sample_id) as sample_id, bh, ah, case when bh is null then 'ADDED' when ah is null then 'REMOVED' else 'MODIFIED' end as change_type, concat_ws(',', case when a.grp is distinct from b.grp then 'GRP' end, case when a.labels is distinct from b.labels then 'LABELS' end, case when a.views is distinct from b.views then 'VIEWS' end) as ch from a full join b on a.sample_id = b.sample_id where bh is distinct from ah), df as (select sample_id, change_type, case change_type when 'MODIFIED' then ch else '*' end as changed_domains, bh as before_hash, ah as after_hash, " + f"sha256({framed_sql('sample_id', 'change_type', 'bh', 'ah')}) as change_id from j)"


def changes(spark, d):
    return lineage.dataset_diff(fixtures.table(spark, d, "fx_v1"), fixtures.table(spark, d, "fx_v2"), "sample_id", ("labels", "grp", "views"))


@query(f"with {_DIFF} select * from df")
def dataset_diff(spark, d):
    return changes(spark, d)


@query(f"with {_DIFF} select change_type, changed_domains, count(*) as n from df group by all")
def diff_summary(spark, d):
    return lineage.diff_summary(changes(spark, d))


@query("select edge_type, count(*) as n, count(distinct source_id) as sources, count(distinct target_id) as targets from {fx_edges} group by all")
def graph_edges(spark, d):
    return fixtures.table(spark, d, "fx_edges").groupBy("edge_type").agg(F.count("*").alias("n"), F.countDistinct("source_id").alias("sources"), F.countDistinct("target_id").alias("targets"))


@query("with recursive e as materialized (select * from {fx_edges}), r as (select source_id as start, source_id as node, 0 as depth from e where source_id like 'region:%' union select r.start, e.target_id, r.depth + 1 from r join e on r.node = e.source_id) select start, depth, count(distinct node) as nodes from (select start, node, min(depth)::int as depth from r group by all) group by all")
def descendants(spark, d):
    edges = lineage.written(fixtures.table(spark, d, "fx_edges"), "edges")
    starts = edges.where("source_id like 'region:%'").select(F.col("source_id").alias("start")).distinct()
    return lineage.reachable(edges, starts).groupBy("start", "depth").agg(F.count("*").alias("nodes"))


@query("with recursive e as materialized (select * from {fx_edges}), r as (select target_id as start, target_id as node, 0 as depth from e where target_id in ('part:1', 'part:2', 'part:3') union select r.start, e.source_id, r.depth + 1 from r join e on r.node = e.target_id) select start, node, min(depth)::int as depth from r group by all")
def ancestors_explain(spark, d):
    edges = lineage.written(lineage.reverse(fixtures.table(spark, d, "fx_edges")), "edges")
    starts = edges.where("source_id in ('part:1', 'part:2', 'part:3')").select(F.col("source_id").alias("start")).distinct()
    return lineage.reachable(edges, starts)


_SEVERITY = "case when node like 'customer:%7' then 2 when node like 'order:%13' then 3 when node like 'nation:1%' then 1 else 0 end"


@query(f"with recursive e as materialized (select * from {{fx_edges}}), n as (select distinct unnest([source_id, target_id]) as node from e), i as (select node, {_SEVERITY} as severity from n), r as (select node, severity from i where severity > 0 union select e.target_id, r.severity from r join e on r.node = e.source_id) select node, max(severity)::int as severity from (select * from i union all select * from r) group by all")
def status_fixpoint(spark, d):
    edges = lineage.written(fixtures.table(spark, d, "fx_edges"), "edges")
    nodes = edges.select(F.col("source_id").alias("node")).union(edges.select("target_id")).distinct()
    return lineage.fixpoint_status(edges, nodes.select("node", F.expr(_SEVERITY).alias("severity")))


@query("select count(*) as n, " + ", ".join(f"sum(('0x' || substr(h, {1 + 8 * i}, 8))::bigint)::bigint as limb{i}" for i in range(8)) + f" from (select sha256({framed_sql('source_id', 'target_id', 'edge_type')}) as h from {{fx_edges}})")
def graph_fingerprint(spark, d):
    return lineage.fingerprint(fixtures.table(spark, d, "fx_edges"), "source_id", "target_id", "edge_type")


@query("select submission_id, at_time, seq, value from {fx_ledger} where event = 'scored' qualify row_number() over (partition by submission_id order by at_time desc, seq desc) = 1")
def latest_score(spark, d):
    return ledger.latest(fixtures.table(spark, d, "fx_ledger"), "scored")


@query("select s.seq, s.submission_id, s.at_time, s.value, (select arg_max(u.seq, (u.at_time, u.seq)) from {fx_ledger} u where u.event = 'uploaded' and u.submission_id = s.submission_id and u.at_time <= s.at_time) as upload_seq from {fx_ledger} s where s.event = 'scored'")
def assign_scores_asof(spark, d):
    return ledger.assign_scores(fixtures.table(spark, d, "fx_ledger"))


@query("select date_trunc('day', at_time)::date as day, count(*) as used, count(distinct submission_id) as submissions, count(*) >= 10 as \"full\" from {fx_ledger} where event in ('uploaded', 'foreign') group by 1")
def quota_windows(spark, d):
    return ledger.quota_windows(fixtures.table(spark, d, "fx_ledger"), 10)


@query("select seq, submission_id, value, round(value - lag(value) over (partition by submission_id order by at_time, seq), 9) as delta from {fx_ledger} where event = 'scored'")
def report_delta_lag(spark, d):
    return rounded(ledger.delta_report(fixtures.table(spark, d, "fx_ledger")), "delta")


_LAST = "l as (select submission_id, event, arg_max(value, (at_time, seq)) as value, max(at_time) as at_time, arg_max(seq, (at_time, seq)) as seq from {fx_ledger} group by all)"


@query(f"with {_LAST}, t as (select s.submission_id, s.value, s.at_time from l u join l s on u.event = 'uploaded' and s.event = 'scored' and u.submission_id = s.submission_id left join l e on e.event = 'errored' and e.submission_id = s.submission_id where s.value is not null and (e.at_time is null or (e.at_time, e.seq) < (s.at_time, s.seq))) select row_number() over (order by value desc, at_time, submission_id)::int as rank, submission_id, value from t order by value desc, at_time, submission_id limit 10")
def final_ranking(spark, d):
    return ledger.final_ranking(fixtures.table(spark, d, "fx_ledger"))


@query("with g as (select submission_id, bool_or(event = 'uploaded') as up, max((at_time, seq)) filter (event = 'scored') as s, arg_max(value, (at_time, seq)) filter (event = 'scored') as v, max((at_time, seq)) filter (event = 'errored') as e from {fx_ledger} group by all) select submission_id, case when not up then 'not_uploaded' when s is null then 'no_reading' when e >= s then 'errored' when v is null then 'no_value' else 'eligible' end as why from g")
def final_gate_reasons(spark, d):
    return ledger.gate_reasons(fixtures.table(spark, d, "fx_ledger"))


@query("select seq, submission_id, at_time, value, event from {fx_ledger} where seq % 3 <> 0 union all select seq, submission_id, at_time, -1.0::double, event from {fx_ledger} where seq % 3 = 0 and seq % 2 = 0")
def ledger_merge_dedupe(spark, d):
    rows = fixtures.table(spark, d, "fx_ledger")
    return ledger.merge_dedupe(rows.where("seq % 3 <> 0"), rows.where("seq % 2 = 0").withColumn("value", F.lit(-1.0)))


@query("select submission_id, arg_max(event, seq) = 'staged' as locked from {fx_ledger} where event in ('staged', 'errored') group by all")
def lock_state(spark, d):
    return ledger.lock_state(fixtures.table(spark, d, "fx_ledger"))


@query("select run_id, sample_id, " + ", ".join(f"max(raw) filter (cls_id = {c}) as class_{c}" for c in range(4)) + " from {fx_scores} where subset in ('valA', 'valB', 'holdout') group by all")
def scores_pivot(spark, d):
    return records.scores_wide(scores(spark, d), [0, 1, 2, 3])


@query("select l_orderkey, l_linenumber, category_id, x + w as x2, y + h as y2, round((x + w / 2.0::double) / 640, 8) as cx, round((y + h / 2.0::double) / 480, 8) as cy, round(w / 640.0::double, 8) as fw, round(h / 480.0::double, 8) as fh from {fx_boxes}")
def box_format_convert(spark, d):
    return records.box_formats(fixtures.table(spark, d, "fx_boxes"))


@query("select l_orderkey as image_id, count(*) as boxes, sum(w * h)::bigint as area, count(distinct category_id) as categories from {fx_boxes} group by all")
def export_ids(spark, d):
    return records.export_ids(fixtures.table(spark, d, "fx_boxes"))


def _all() -> dict:
    from runledger.plans import catalogue_labels, catalogue_records, catalogue_registers, catalogue_views  # noqa: F401  (they register their queries here)

    return CATALOGUE


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: fixtures.duckdb_sql(sql) for name, (_, sql) in _all().items() if sql}
