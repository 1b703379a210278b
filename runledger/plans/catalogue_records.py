"""Further named queries: readings, submissions, validation, statuses, exchange formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from runledger.fixtures import table
from runledger.operators import ledger, lineage, metrics, relations, split, status, validate
from runledger.plans.catalogue import _HELD, HELD, framed_sql, query, rounded, scores
from runledger.sources import exchange

_TOP = "row_number() over (partition by run_id, subset, metric order by ts desc, seq) = 1"


@query(f"select run_id, subset, metric, ts, seq, value from {{fx_readings}} qualify {_TOP}")
def reading_latest(spark, d):
    return ledger.newest(table(spark, d, "fx_readings"), ["run_id", "subset", "metric"], True)


@query("select run_id, subset, ts, seq, metric, value from {fx_readings} qualify row_number() over (partition by run_id, subset order by ts desc, seq desc) = 1")
def reading_latest_per_run(spark, d):
    return ledger.newest(table(spark, d, "fx_readings"), ["run_id", "subset"], False)


@query("select run_id, seq, subset, metric, ts, value from {fx_readings} qualify row_number() over (partition by run_id order by seq desc) = 1")
def last_appended(spark, d):
    return ledger.at_end(table(spark, d, "fx_readings"), ["run_id"])


@query("select run_id, metric, seq, subset, ts, value from {fx_readings} qualify row_number() over (partition by run_id, metric order by seq) = 1")
def first_appended(spark, d):
    return ledger.at_end(table(spark, d, "fx_readings"), ["run_id", "metric"], last=False)


@query("select run_id, min(seq) as first_seq, max(seq) as seq, arg_max(subset, seq) as subset, arg_max(metric, seq) as metric, arg_max(ts, seq) as ts, arg_max(value, seq) as value from {fx_readings} group by all")
def newest_in_first_order(spark, d):
    return ledger.newest_in_first_order(table(spark, d, "fx_readings"), "run_id")


@query(f"with n as (select * from {{fx_readings}} where run_id in ('run1', 'run2') qualify {_TOP}), w as (select subset, metric, max(value) filter (run_id = 'run1') as baseline, max(value) filter (run_id = 'run2') as candidate from n group by all) select *, case when baseline is null then 'baseline' when candidate is null then 'candidate' else '' end as missing from w")
def reading_pairs(spark, d):
    return ledger.reading_pairs(table(spark, d, "fx_readings"), "run1", "run2")


@query("with n as (select * from {fx_readings} qualify row_number() over (partition by run_id, subset, metric order by seq desc) = 1) select n.run_id, n.subset, n.metric, n.value, round(n.value - b.value, 9) as delta from n join n b on b.run_id = 'run1' and n.run_id <> 'run1' and n.subset = b.subset and n.metric = b.metric")
def last_against_baseline(spark, d):
    return rounded(ledger.last_against(table(spark, d, "fx_readings"), "run1"), "delta")


_PLACED = """u as (select * from {fx_platform} where event = 'uploaded'),
 p as (select s.seq, s.ts, s.event, s.value, s.submission_id, case when s.at_time is not null
   then (select arg_min(u.seq, (abs(epoch_us(u.at_time) - epoch_us(s.at_time)), -epoch_us(u.at_time), u.seq)) from u where u.submission_id = s.submission_id)
   else (select arg_max(u.seq, (u.ts, u.seq)) from u where u.submission_id = s.submission_id and u.ts <= s.ts) end as upload_seq
  from {fx_platform} s where s.event in (EVENTS)),
 w as (select * from p where upload_seq is not null qualify row_number() over (partition by submission_id, upload_seq order by ts desc, seq) = 1),
 pl as (select u.submission_id, u.seq as upload_seq, u.at_time, u.ts, w.event as outcome, w.seq as outcome_seq, w.value from u left join w on w.upload_seq = u.seq)"""


@query(f"with {_PLACED.replace('EVENTS', chr(39) + 'scored' + chr(39))} select * from pl")
def assign_scores_nearest(spark, d):
    return ledger.place_outcomes(table(spark, d, "fx_platform"))


@query("with " + _PLACED.replace("EVENTS", "'scored', 'errored'") + " select submission_id, upload_seq, outcome, outcome_seq, value from pl qualify row_number() over (partition by submission_id order by at_time desc, ts desc, upload_seq) = 1")
def latest_outcome(spark, d):
    return ledger.latest_outcome(table(spark, d, "fx_platform"))


_ARRIVED = """own as (select * from {fx_platform} where event = 'uploaded' and (ref is null or seq = (select min(x.seq) from {fx_platform} x where x.event = 'uploaded' and x.ref = fx_platform.ref))),
 oth as (select * from {fx_platform} where event = 'foreign' and ref is not null qualify row_number() over (partition by ref order by seq desc) = 1),
 ar as (select seq, submission_id, ref, at_time, false as "foreign" from own union all select seq, submission_id, ref, at_time, true from oth where ref not in (select ref from own where ref is not null))"""


@query(f"with {_ARRIVED} select * from ar")
def arrivals(spark, d):
    return ledger.arrivals(table(spark, d, "fx_platform"))


@query(f"with {_ARRIVED} select (at_time + interval 5 hours - interval 6 hours)::date as day, count(*) as used, count(*) >= 5 as \"full\" from ar where at_time is not null group by 1")
def quota_by_zone(spark, d):
    """Platform days of a zone five hours east of Greenwich that begin at six in the morning."""
    return ledger.quota_days(ledger.arrivals(table(spark, d, "fx_platform")), 5, "Etc/GMT-5", 6)


@query("select submission_id, seq, 2::bigint as versions from {fx_ledger} where event = 'staged' and seq % 4 = 0 and value is distinct from -1.0::double")
def staged_conflicts(spark, d):
    rows = table(spark, d, "fx_ledger")
    return ledger.staged_conflicts(rows, rows.where("seq % 4 = 0").withColumn("value", F.lit(-1.0)))


@query("select submission_id, max(value) as best, arg_max(seq, (value, -seq)) as best_seq, arg_max(value, seq) as last, max(seq) as last_seq from {fx_ledger} where event = 'scored' and value is not null group by all")
def score_board(spark, d):
    return ledger.board(table(spark, d, "fx_ledger"))


@query("with m as (select distinct run_id, concat(metric, '-', cast(seq % 5 as varchar(20))) as subset from {fx_readings} where metric = 'loss' or run_id <> 'run3') select subset, count(*) as runs from m group by 1 having count(*) = (select count(distinct run_id) from m)")
def common_subsets(spark, d):
    rows = table(spark, d, "fx_readings").where("metric = 'loss' or run_id <> 'run3'")
    return relations.common_subsets(rows.select("run_id", F.concat("metric", F.lit("-"), (F.col("seq") % 5).cast("string")).alias("subset")))


@query("select coalesce(a.sample_id, b.sample_id) as sample_id, case when a.sample_id is null then 'only_second' when b.sample_id is null then 'only_first' else 'differs' end as how from {fx_v1} a full join {fx_v2} b on a.sample_id = b.sample_id where a.sample_id is null or b.sample_id is null or a.labels <> b.labels or a.grp <> b.grp or a.views <> b.views")
def copies_parity(spark, d):
    return relations.parity(table(spark, d, "fx_v1"), table(spark, d, "fx_v2"), "sample_id")


@query("select coalesce(a.sample_id, b.sample_id)::varchar as path, case when a.sample_id is null then 'added' when b.sample_id is null then 'removed' else 'changed' end as how from {fx_v1} a full join {fx_v2} b on a.sample_id = b.sample_id where a.sample_id is null or b.sample_id is null or a.labels <> b.labels")
def path_diff(spark, d):
    files = lambda t: table(spark, d, t).select(F.col("sample_id").cast("string").alias("path"), F.sha2(F.col("labels").cast("binary"), 256).alias("digest"))
    return relations.path_diff(files("fx_v1"), files("fx_v2"))


@query("with recursive e as materialized (select * from {fx_edges}), dn as (select source_id as node from e where source_id = 'nation:3' union select e.target_id from dn join e on dn.node = e.source_id), up as (select target_id as node from e where target_id in ('part:1', 'part:2') union select e.source_id from up join e on up.node = e.target_id) select distinct source_id, target_id, edge_type from e where source_id in (select node from dn) and target_id in (select node from up)")
def path_links(spark, d):
    edges = lineage.written(table(spark, d, "fx_edges"), "edges")
    return relations.path_links(edges, spark.createDataFrame([("nation:3",)], "start string"), spark.createDataFrame([("part:1",), ("part:2",)], "start string"))


@query(f"select seq, sha256({framed_sql('run_id', 'subset', 'metric', 'seq')}) as reading_id from {{fx_readings}}")
def reading_identity(spark, d):
    return relations.identity(table(spark, d, "fx_readings"), ["run_id", "subset", "metric", "seq"], "reading_id").select("seq", "reading_id")


@query(f"with {_HELD}, c as (select run_id, subset, avg((gold = predicted)::int) as value from am group by all) select run_id, subset, round(value, 9) as value, case run_id when 'baseline' then 0.4::double else 0.6::double end as anchor, abs(value - case run_id when 'baseline' then 0.4::double else 0.6::double end) > 0.05 as refused from c where run_id <> 'third'")
def guardrail(spark, d):
    anchors = spark.createDataFrame([(r, s, a) for r, a in (("baseline", 0.4), ("candidate", 0.6)) for s in HELD], "run_id string, subset string, anchor double")
    return rounded(relations.guarded(metrics.accuracy(scores(spark, d)), anchors, 0.05), "value")


@query("select sample_id, cls, case when cls is null then 'no_class' else 'unknown_class' end as problem from {fx_samples} where cls is null or cls not in (0, 1, 2)")
def validate_classes(spark, d):
    return validate.unknown_classes(table(spark, d, "fx_samples"), spark.createDataFrame([(0,), (1,), (2,)], "cls int"))


_NAMES = "('k1', 'k2', 'k3', 'k4', 'k5', 'k6')"


@query(f"with v as (select sample_id, count(distinct name) filter (name in {_NAMES}) as have, count(*) filter (name not in {_NAMES}) as strange, count(*) filter (value not in (0, 1)) as other from {{fx_named_values}} group by 1) select * from (select sample_id, case when strange > 0 then 'unknown_name' when have < 6 then 'missing_name' when other > 0 then 'not_binary' end as problem from v) where problem is not null")
def validate_multilabel(spark, d):
    return validate.multilabel_problems(table(spark, d, "fx_named_values"), [f"k{i}" for i in range(1, 7)])


@query(f"with v as (select sample_id, count(*) filter (name not in {_NAMES}) as strange, count(*) filter (value > 2) as odd from {{fx_named_values}} group by 1) select * from (select o_orderkey as sample_id, case when strange is null then 'no_target' when strange > 0 then 'unknown_name' when odd > 0 then 'not_finite' end as problem from {{orders}} left join v on sample_id = o_orderkey) where problem is not null")
def validate_regression(spark, d):
    values = table(spark, d, "fx_named_values").withColumn("value", F.when(F.col("value") > 2, float("nan")).otherwise(F.col("value")))
    return validate.regression_problems(table(spark, d, "orders").select(F.col("o_orderkey").alias("sample_id")), values, [f"k{i}" for i in range(1, 7)])


@query("select * from (select l_orderkey, l_linenumber, case when l_linenumber - 1 >= 6 then 'no_view' when category_id not in (0, 1) then 'unknown_category' when w <= 0 or h <= 0 then 'no_area' when x < -1 or y < -1 or x + w > 641 or y + h > 481 then 'outside' end as problem from {fx_boxes}) where problem is not null")
def validate_detection(spark, d):
    boxes = table(spark, d, "fx_boxes").withColumn("view", F.col("l_linenumber") - 1)
    return validate.detection_problems(boxes, [0, 1], 6, 640, 480).select("l_orderkey", "l_linenumber", "problem")


_SOURCES = "case when doc_id % 9 = 0 then 'gold' else label_source end"


@query(f"select sample_id, {_SOURCES} as label_source from {{fx_samples}} where ({_SOURCES} = 'none') = (quality is not null)")
def sample_consistency(spark, d):
    return validate.inconsistent_samples(table(spark, d, "fx_samples").withColumn("label_source", F.expr(_SOURCES)))


@query("select l_orderkey, l_quantity, count(*) as n from {lineitem} group by all having count(*) > 1")
def repeated_views(spark, d):
    return validate.repeated_places(table(spark, d, "lineitem"), "l_orderkey", "l_quantity")


_RING = "v as (select polygon_id, place, x, y, lead(x) over w as nx, lead(y) over w as ny, first_value(x) over w as fx, first_value(y) over w as fy from {fx_vertices} window w as (partition by polygon_id order by place))"


@query(f"with {_RING}, s as (select polygon_id, count(*) as n, abs(sum(x * coalesce(ny, fy) - coalesce(nx, fx) * y)) / 2 as area, bool_or(x < -1 or y < -1 or x > 641 or y > 481) as out_ from v group by all) select polygon_id, n, area, case when n < 3 then 'degenerate_ring' when out_ then 'vertex_outside' end as problem from s")
def polygon_audit(spark, d):
    return validate.polygon_facts(table(spark, d, "fx_vertices"), 640, 480)


@query("with p as (select doc_id % 700 as sample_id, count(*) as n from {documents} where doc_id % 7 <> 0 group by 1), s as (select doc_id as sample_id from {labels} union select doc_id from {documents} where doc_id < 60) select * from (select coalesce(p.sample_id, s.sample_id) as sample_id, case when s.sample_id is null then 'unknown' when n is null then 'missing' when n > 1 then 'repeated' end as problem from p full join s on p.sample_id = s.sample_id) where problem is not null")
def prediction_check(spark, d):
    docs = table(spark, d, "documents")
    samples = table(spark, d, "labels").select(F.col("doc_id").alias("sample_id")).union(docs.where("doc_id < 60").select("doc_id")).distinct()
    return validate.prediction_problems(docs.where("doc_id % 7 <> 0").select((F.col("doc_id") % 700).alias("sample_id")), samples)


_PLANNED = "pn as (select subset, case when subset = 'train' then 'train' else 'eval' end as role, sample_id from {fx_assignment} union all select 'extra', 'eval', sample_id from {fx_assignment} where subset = 'train' and cls = 0), tn as (select 'a' as run_id, 'train' as subset union all select 'b', 'valA' union all select 'c', 'none')"


@query(f"with {_PLANNED}, tr as (select distinct run_id, sample_id from pn join tn using (subset)), hd as (select * from pn where role <> 'train'), al as (select r.run_id, s.subset from (select distinct run_id from tn) r, (select distinct subset from hd) s) select * from al where (run_id, subset) not in (select run_id, subset from hd join tr using (sample_id)) and (run_id, subset) not in (select run_id, subset from tn)")
def clean_eval_subsets(spark, d):
    rows = table(spark, d, "fx_assignment")
    plan = rows.select("subset", F.when(F.col("subset") == "train", "train").otherwise("eval").alias("role"), "sample_id").union(rows.where("subset = 'train' and cls = 0").select(F.lit("extra"), F.lit("eval"), "sample_id"))
    return validate.clean_subsets(plan, spark.createDataFrame([("a", "train"), ("b", "valA"), ("c", "none")], "run_id string, subset string"))


@query("with c as (select 'classes' as \"check\", count(*) filter (cls is null or cls not in (0, 1, 2)) as problems, 2 as bad from {fx_samples} union all select 'polygons', count(*), 1 from (select polygon_id from {fx_vertices} group by 1 having count(*) < 3) union all select 'nothing', 0, 2), l as (select *, case when problems > 0 then bad else 0 end as level from c), a as (select \"check\", problems, level from l union all select 'all', sum(problems), max(level) from l) select \"check\", problems::bigint as problems, ['PASS', 'WARN', 'FAIL'][level + 1] as status from a")
def audit_run(spark, d):
    polygons = validate.polygon_facts(table(spark, d, "fx_vertices"), 640, 480).where("problem = 'degenerate_ring'")
    return validate.audit({"classes": validate_classes(spark, d), "polygons": polygons, "nothing": spark.range(0)}, {"classes": 2, "polygons": 1, "nothing": 2})


def _status_inputs(spark, d):
    return [lineage.written(table(spark, d, t), t) for t in ("fx_entities", "fx_links", "fx_changes", "fx_split_rows", "fx_run_subsets")]


_PLAN = "cs as (select dataset_id, plan_id, min(split_id) as split_id from {fx_split_rows} group by all), sr as (select s.* from {fx_split_rows} s join cs using (dataset_id, plan_id, split_id))"
_STATUS = f"""with recursive {_PLAN},
 dt as (select entity_id, 3 as sv, broken_reason as reason, '' as pred from {{fx_entities}} where broken_reason is not null
  union all select entity_id, case when sp then 2 else 1 end, case when sp then 'split-affecting dataset evolution' else 'unclassified dataset evolution may affect split' end, dataset_id
   from {{fx_entities}} join (select dataset_id, bool_or(effect = 'SPLIT_AFFECTING') as sp, bool_or(effect = 'UNKNOWN') as un from {{fx_changes}} group by 1) using (dataset_id) where entity_type = 'split' and broken_reason is null and (sp or un)
  union all select entity_id, case when an then 2 else 1 end, case when an then 'dataset evolution affects derived data' else 'unclassified dataset evolution may affect derived data' end, dataset_id
   from {{fx_entities}} join (select dataset_id, bool_or(effect not in ('DISPLAY_ONLY', 'UNKNOWN')) as an, bool_or(effect = 'UNKNOWN') as un from {{fx_changes}} group by 1) using (dataset_id) where entity_type in ('artifact', 'export', 'materialized_cache') and broken_reason is null and (an or un)
  union all select * from (select e.entity_id, case when effect = 'SPLIT_AFFECTING' then 2 when effect in ('INPUT_AFFECTING', 'TRAINING_AFFECTING') and exists (select 1 from {{fx_run_subsets}} r where r.run_id = e.entity_id and r.subset = sr.subset and r.role = 'trained') then 2
     when effect = 'UNKNOWN' and (sr.subset is null or exists (select 1 from {{fx_run_subsets}} r where r.run_id = e.entity_id and r.subset = sr.subset)) then 1 end as sv,
    case when effect = 'SPLIT_AFFECTING' then 'split-affecting change for sample ' || c.sample_id when effect = 'UNKNOWN' then 'unclassified change for sample ' || c.sample_id else 'training-affecting change in subset ' || sr.subset || ' for sample ' || c.sample_id end, e.dataset_id
    from {{fx_entities}} e join {{fx_changes}} c on e.dataset_id = c.dataset_id left join sr on sr.dataset_id = e.dataset_id and sr.plan_id = e.plan_id and sr.sample_id = c.sample_id
    where e.entity_type in ('run', 'fusion_run') and e.broken_reason is null) where sv is not null),
 dm as (select entity_id, max(sv) as sv from dt group by 1),
 rd as (select e.entity_id, dm.sv, 'upstream ' || e.run_ref || ' is ' || ['VALID', 'REVIEW', 'STALE', 'BROKEN'][dm.sv + 1] as reason, e.run_ref as pred from {{fx_entities}} e join dm on dm.entity_id = e.run_ref where e.entity_type = 'reading' and e.broken_reason is null
  union all select e.entity_id, case when effect = 'UNKNOWN' then 1 else 2 end, case when effect = 'UNKNOWN' then 'unclassified' else 'evaluation-affecting' end || ' change in subset ' || e.subset || ' for sample ' || c.sample_id, e.dataset_id
   from {{fx_entities}} e join {{fx_changes}} c on e.dataset_id = c.dataset_id and effect not in ('TRAINING_AFFECTING', 'DISPLAY_ONLY') join sr on sr.dataset_id = e.dataset_id and sr.plan_id = e.plan_id and sr.sample_id = c.sample_id and sr.subset = e.subset
   where e.entity_type = 'reading' and e.broken_reason is null and e.run_ref not in (select entity_id from dm)),
 fd as (select * from dt union all select * from rd),
 te as (select l.source_id, l.target_id, e.entity_type in ('judgement', 'fusion_run', 'artifact', 'submission', 'backup') as inh from {{fx_links}} l join {{fx_entities}} e on e.entity_id = l.target_id),
 sp as (select entity_id, sv from fd union select te.target_id, sp.sv from sp join te on te.source_id = sp.entity_id where te.inh or sp.sv = 3),
 lv as (select entity_id, max(sv) as sv from sp group by 1),
 al as (select * from fd union all select te.target_id, lv.sv, 'upstream ' || te.source_id || ' is ' || ['VALID', 'REVIEW', 'STALE', 'BROKEN'][lv.sv + 1], te.source_id from te join lv on lv.entity_id = te.source_id where te.inh or lv.sv = 3)
 select e.entity_id, e.entity_type, ['VALID', 'REVIEW', 'STALE', 'BROKEN'][coalesce(x.sv, 0) + 1] as status, coalesce(x.reason, 'canonical evidence is current') as reason, nullif(x.pred, '') as predecessor_id
 from {{fx_entities}} e left join (select * from al qualify row_number() over (partition by entity_id order by sv desc, reason, pred) = 1) x on x.entity_id = e.entity_id"""


@query(_STATUS)
def record_statuses(spark, d):
    return status.statuses(*_status_inputs(spark, d))


@query("select split_name as value, (row_number() over (order by (try_cast(split_name as int) is null)::int, try_cast(split_name as int), split_name) - 1)::int as category_id from (select distinct case when p_size % 3 = 0 then p_brand else p_size::varchar end as split_name from {part})")
def category_order(spark, d):
    return exchange.category_order(table(spark, d, "part").select(F.when(F.col("p_size") % 3 == 0, F.col("p_brand")).otherwise(F.col("p_size").cast("string")).alias("value")))


@query("with r as (select l_partkey::varchar as a, (l_partkey % 2)::varchar as b, printf('%.1f', (l_suppkey % 2)::double) as c, l_tax::varchar as e from {lineitem}) select case when bool_and(regexp_full_match(trim(a), '-?[0-9]+')) then 'cls' when bool_and(trim(a) in ('0', '1', '0.0', '1.0')) then 'multilabel' else 'regression' end as task from r union all select case when bool_and(trim(b) in ('0', '1', '0.0', '1.0') and trim(c) in ('0', '1', '0.0', '1.0')) then 'multilabel' else 'regression' end from r union all select case when bool_and(trim(b) in ('0', '1', '0.0', '1.0') and trim(e) in ('0', '1', '0.0', '1.0')) then 'multilabel' else 'regression' end from r")
def inferred_tasks(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").cast("string").alias("a"), (F.col("l_partkey") % 2).cast("string").alias("b"), F.format_string("%.1f", (F.col("l_suppkey") % 2).cast("double")).alias("c"), F.col("l_tax").cast("string").alias("e"))
    return exchange.inferred_task(rows, ["a"]).union(exchange.inferred_task(rows, ["b", "c"])).union(exchange.inferred_task(rows, ["b", "e"]))


_IMAGES = "im as (select sample_id, (row_number() over (order by ('0x' || substr(md5(sample_id::varchar), 1, 8))::bigint % 64, sample_id))::bigint as image_id from (select distinct l_orderkey as sample_id from {fx_boxes}))"


@query(f"with {_IMAGES} select (row_number() over (order by image_id, l_linenumber, x, y, w, h))::bigint as annotation_id, image_id, category_id, x, y, w, h, w * h as area from {{fx_boxes}} join im on sample_id = l_orderkey")
def coco_export(spark, d):
    """Images and annotations are numbered across the cluster; the images' order is by digest piece, then id."""
    boxes = table(spark, d, "fx_boxes").withColumnRenamed("l_orderkey", "sample_id")
    images = lineage.written(exchange.coco_images(boxes, "sample_id"), "images")
    return exchange.coco_annotations(boxes, images, ["l_linenumber", "x", "y", "w", "h"])


@query("select l_orderkey, l_linenumber, case when l_orderkey % 5 > 0 then concat('img', (l_orderkey // 2)::varchar) end as file_name from {fx_boxes}")
def coco_join(spark, d):
    boxes = table(spark, d, "fx_boxes")
    images = boxes.where("l_orderkey % 5 > 0").select(F.col("l_orderkey").alias("image_id")).distinct().withColumn("file_name", F.concat(F.lit("img"), F.floor(F.col("image_id") / 2).cast("string")))
    return exchange.coco_joined(boxes.withColumnRenamed("l_orderkey", "image_id"), images).select(F.col("image_id").alias("l_orderkey"), "l_linenumber", "file_name")


@query("select concat('img', (k // 2)::varchar) as file_name, count(*) as n from (select distinct l_orderkey as k from {fx_boxes}) group by 1 having count(*) > 1")
def repeated_file_names(spark, d):
    return exchange.repeated_names(table(spark, d, "fx_boxes").select("l_orderkey").distinct().select(F.concat(F.lit("img"), F.floor(F.col("l_orderkey") / 2).cast("string")).alias("file_name")))


@query("select l_orderkey, l_linenumber, category_id, round((x + w / 2.0::double) * 1e6 / 640) as cx, round(w * 1e6 / 640) as fw, concat('a__b__', l_orderkey::varchar, '.txt') as file from {fx_boxes} where w > 0")
def yolo_round_trip(spark, d):
    """The lines written and read again: numbers are compared as millionths of the image."""
    lines = exchange.yolo_lines(table(spark, d, "fx_boxes").where("w > 0"), 640, 480).select("l_orderkey", "l_linenumber", "line", exchange.yolo_file(F.concat(F.lit("a/b/"), F.col("l_orderkey").cast("string"), F.lit(".png"))).alias("file"))
    back = exchange.yolo_boxes(lines, 1, 1)
    return back.select("l_orderkey", "l_linenumber", F.col("category_id").cast("long").alias("category_id"), F.round((F.col("x") + F.col("w") / 2) * 1e6).alias("cx"), F.round(F.col("w") * 1e6).alias("fw"), "file")


@query("select l_orderkey, l_linenumber, x::double as x, y::double as y, w::double as w, h::double as h, (x + w / 2.0::double) as a, y::double + h as d from {fx_boxes}")
def box_geometry_inverse(spark, d):
    """Boxes to centres and corners and back."""
    boxes = table(spark, d, "fx_boxes")
    centre = boxes.select("l_orderkey", "l_linenumber", *[c.alias(n) for n, c in exchange.box_values("cxcywh").items()])
    back = centre.select("l_orderkey", "l_linenumber", F.col("a"), *[c.alias(n) for n, c in exchange.absolute_box("cxcywh").items()])
    return back.withColumn("d", exchange.box_values("xyxy")["d"])


@query()
def coco_average_precision(spark, d):
    """Gold boxes are ``fx_boxes``; predictions are the same, moved, with some left out. No SQL (greedy matching); tested by hand values and brute force."""
    boxes = table(spark, d, "fx_boxes").where("w > 0").select(F.col("l_orderkey").alias("image_id"), "category_id", "x", "y", "w", "h", F.col("l_linenumber").alias("turn"))
    gold = boxes.withColumns({"side": F.lit("gold"), "score": F.lit(0.0), "crowd": F.col("x") % 50 == 0})
    said = boxes.where("y % 9 <> 0").withColumns({"side": F.lit("predicted"), "x": F.col("x") + F.col("y") % 7, "score": (F.col("x") % 97 + 1) / 100.0, "crowd": F.lit(False)})
    return rounded(metrics.average_precision(gold.unionByName(said)), "ap")


@query()
def fixed_split(spark, d):
    """Sealed subsets first; sizes are exact, which the tests check, as the strata are drawn pass by pass."""
    return split.fixed_split(table(spark, d, "fx_samples"), [("holdout", 0.1), ("valB", 0.1), ("valA", 0.1)])


@query("select m.run_id, m.subset, round(avg(value), 9) as value from (select run_id, subset, metric, value from {fx_readings} where isfinite(value)) m group by all")
def reading_means(spark, d):
    rows = relations.new_rows(table(spark, d, "fx_readings"), table(spark, d, "fx_readings").where("seq < 0"), "seq", "value")
    return rounded(rows.groupBy("run_id", "subset").agg(F.avg("value").alias("value")), "value")
