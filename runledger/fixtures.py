"""Canonical record tables derived from the driver's tables; the same SQL runs in Spark and DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SQL = {
    "fx_samples": """
select d.doc_id, concat('s', lpad(cast(d.doc_id as varchar(20)), 8, '0')) as sample_id,
  case d.lang when 'de' then 0 when 'en' then 1 when 'es' then 2 when 'fr' then 3 end as cls, d.source as grp,
  case when l.doc_id is null then 'none' else 'gold' end as label_source, l.quality, l.toxic
from {documents} d left join {labels} l on d.doc_id = l.doc_id""",
    "fx_assignment": """
select sample_id, cls, grp, case when b < 700 then 'train' when b < 800 then 'valA' when b < 900 then 'valB' else 'holdout' end as subset
from (select sample_id, cls, grp, (doc_id * 2654435761) % 1000 as b from {fx_samples}) q""",
    "fx_scores": """
select r.run_id, a.sample_id, a.subset, a.cls as gold, k.cls_id,
  (case when a.cls = k.cls_id then r.boost else 0 end + (((cast(substring(a.sample_id, 2, 8) as bigint) * 31 + k.cls_id * 17 + r.salt * 101) * 1103515245 + 12345) % 2147483648) % 1000) as raw
from {fx_assignment} a cross join (values (0), (1), (2), (3)) k(cls_id)
  cross join (values ('baseline', 1, 300), ('candidate', 2, 600), ('third', 3, 450)) r(run_id, salt, boost)""",
    "fx_targets": """
select concat('o', cast(o_orderkey as varchar(20))) as sample_id, o_orderpriority as subset, 'price' as target, o_totalprice as gold,
  o_totalprice * (1e0 + ((o_orderkey * 7919) % 201 - 100) * 1e-3) as predicted from {orders}
union all
select concat('o', cast(o_orderkey as varchar(20))), o_orderpriority, 'rank', cast(o_custkey as double), cast(o_custkey + (o_orderkey * 31) % 7 - 3 as double) from {orders}""",
    "fx_boxes": """
select l_orderkey, l_linenumber, l_partkey % 640 as x, (l_suppkey * 37) % 480 as y, cast(l_quantity as bigint) - 2 as w,
  cast(1 + (l_partkey * 7) % 90 as bigint) as h, l_linenumber % 3 as category_id from {lineitem}""",
    "fx_mask_runs": """
select 'gold' as side, l_orderkey as image_id, l_linenumber % 3 as category_id, l_partkey % 200 as start, cast(l_quantity as bigint) as len from {lineitem}
union all
select 'predicted', l_orderkey, l_linenumber % 3, l_partkey % 200 + l_suppkey % 5, cast(l_quantity as bigint) from {lineitem} where l_suppkey % 11 <> 0""",
    "fx_v1": """
select o_orderkey as sample_id, o_orderstatus as labels, o_orderpriority as grp, cast(round(o_totalprice * 100) as bigint) as views from {orders} where o_orderkey % 50 <> 7""",
    "fx_v2": """
select o_orderkey as sample_id, case when o_orderkey % 17 = 0 then 'X' else o_orderstatus end as labels,
  case when o_orderkey % 13 = 0 then '9-NEW' else o_orderpriority end as grp,
  cast(round(o_totalprice * 100) as bigint) + case when o_orderkey % 11 = 0 then 1 else 0 end as views from {orders} where o_orderkey % 50 <> 3""",
    "fx_edges": """
select concat('region:', cast(n_regionkey as varchar(20))) as source_id, concat('nation:', cast(n_nationkey as varchar(20))) as target_id, 'DERIVED_FROM' as edge_type from {nation}
union all select concat('nation:', cast(c_nationkey as varchar(20))), concat('customer:', cast(c_custkey as varchar(20))), 'USES_SPLIT' from {customer}
union all select concat('customer:', cast(o_custkey as varchar(20))), concat('order:', cast(o_orderkey as varchar(20))), 'CONSUMED_BY' from {orders}
union all select concat('order:', cast(l_orderkey as varchar(20))), concat('part:', cast(l_partkey as varchar(20))), 'EVALUATED_BY' from {lineitem} where l_linenumber = 1""",
    "fx_ledger": """
select event_id as seq, user_id as submission_id, ts as at_time, value,
  case event_type when 'purchase' then 'uploaded' when 'view' then 'scored' when 'error' then 'errored' when 'click' then 'foreign' else 'staged' end as event from {events}""",
    "fx_readings": """
select event_id as seq, concat('run', cast(user_id % 20 as varchar(20))) as run_id,
  case event_id % 3 when 0 then 'valA' when 1 then 'valB' else 'holdout' end as subset, case when event_id % 2 = 0 then 'accuracy' else 'loss' end as metric,
  date_trunc('day', ts) as ts, cast(event_id % 101 as double) / 100 as value from {events}""",
    "fx_platform": """
select event_id as seq, user_id as submission_id, ts, case when event_type = 'view' and event_id % 5 = 0 then null else date_trunc('hour', ts) end as at_time,
  case when event_type in ('purchase', 'click') and event_id % 3 = 0 then concat('p', cast(event_id % 500 as varchar(20))) end as ref, value,
  case event_type when 'purchase' then 'uploaded' when 'view' then 'scored' when 'error' then 'errored' when 'click' then 'foreign' else 'staged' end as event from {events}""",
    "fx_named_values": """
select l_orderkey as sample_id, concat('k', cast(l_linenumber as varchar(20))) as name, cast(l_partkey % 11 as double) / 5 as value from {lineitem} where l_suppkey % 7 <> 0""",
    "fx_vertices": """
select l_orderkey as polygon_id, l_linenumber as place, cast(max(l_partkey % 700) as double) as x, cast(max((l_suppkey * 37) % 500) as double) as y from {lineitem} group by l_orderkey, l_linenumber""",
    "fx_rings": """
select 'gold' as side, polygon_id, place, x / 7 as x, y / 5 as y from {fx_vertices}
union all select 'predicted', polygon_id, place, x / 7 + (polygon_id % 5) * 5e-1, y / 5 from {fx_vertices}""",
    "fx_nested": """
select o_orderkey as sample_id, o_orderkey % 17 = 0 as relabelled, o_orderkey % 13 = 0 as regrouped, o_orderkey % 11 = 0 as widened, o_orderkey % 7 = 0 as longer, o_orderkey % 5 = 0 as retyped, o_orderkey % 3 = 0 as noted,
  replace(replace(concat('<"views":[<"width":', cast(o_custkey as varchar(20)), ',"height":480>],"labels":<"cls":', cast(o_orderkey % 9 as varchar(20)), ',"boxes":[1,2]>,"group":"', o_orderpriority, '","meta":<"site":<"a.b":1>>>'), '<', chr(123)), '>', chr(125)) as before_row,
  replace(replace(concat('<"views":[<"width":', cast(o_custkey + case when o_orderkey % 11 = 0 then 1 else 0 end as varchar(20)), ',"height":480.0>],"labels":<"cls":', cast(o_orderkey % 9 + case when o_orderkey % 17 = 0 then 1 else 0 end as varchar(20)), ',"boxes":[1,2', case when o_orderkey % 7 = 0 then ',3' else '' end, ']>,"group":', case when o_orderkey % 13 = 0 then 'null' else concat('"', o_orderpriority, '"') end,
    ',"meta":<"site":', case when o_orderkey % 5 = 0 then '[1]' else '<"a.b":1>' end, case when o_orderkey % 3 = 0 then ',"note":<"by":"x">' else '' end, '>>'), '<', chr(123)), '>', chr(125)) as after_row from {orders}""",
    "fx_label_vectors": """
select l_orderkey as sample_id, case when l_partkey % 13 = 0 then 'rare' when l_partkey % 17 = 0 then null else concat('kind', cast(l_partkey % 5 as varchar(20))) end as label from {lineitem}""",
    "fx_changes": """
select o_orderkey as sample_id, concat('d', cast(o_custkey % 6 as varchar(20))) as dataset_id,
  case when o_orderkey % 1009 = 0 then 'SPLIT_AFFECTING' when o_orderkey % 31 = 0 then 'TRAINING_AFFECTING' when o_orderkey % 29 = 0 then 'EVALUATION_AFFECTING'
    when o_orderkey % 23 = 0 then 'INPUT_AFFECTING' when o_orderkey % 19 = 0 then 'UNKNOWN' else 'DISPLAY_ONLY' end as effect
from {orders} where o_orderkey % 37 = 1 and o_custkey % 6 < 4""",
    "fx_split_rows": """
select concat('split:', cast(s.k as varchar(20))) as split_id, concat('d', cast(s.k % 6 as varchar(20))) as dataset_id, concat('plan', cast(s.k % 12 as varchar(20))) as plan_id, o.o_orderkey as sample_id,
  case (o.o_orderkey + s.k) % 4 when 0 then 'train' when 1 then 'valA' when 2 then 'valB' else 'holdout' end as subset
from {orders} o join (select p_partkey as k from {part} where p_partkey % 10 = 0 and p_partkey <= 120) s on o.o_custkey % 6 = s.k % 6""",
    "fx_entities": """
select concat(entity_type, ':', cast(k as varchar(20))) as entity_id, entity_type, concat('d', cast(k % 6 as varchar(20))) as dataset_id,
  case when entity_type in ('run', 'fusion_run', 'reading') then concat('plan', cast(k % 12 as varchar(20))) end as plan_id,
  case when entity_type = 'reading' then concat('run:', cast(k - 2 as varchar(20))) end as run_ref,
  case when entity_type = 'reading' then case k % 4 when 0 then 'train' when 1 then 'valA' when 2 then 'valB' else 'holdout' end end as subset,
  case when k % 97 = 0 then 'missing file' end as broken_reason, k
from (select p_partkey as k, case p_partkey % 10 when 0 then 'split' when 1 then 'run' when 2 then 'fusion_run' when 3 then 'reading' when 4 then 'artifact'
  when 5 then 'export' when 6 then 'judgement' when 7 then 'submission' when 8 then 'backup' else 'materialized_cache' end as entity_type from {part}) q""",
    "fx_run_subsets": """
select entity_id as run_id, s.subset, s.role from {fx_entities} cross join (values ('train', 'trained'), ('valA', 'trained'), ('valB', 'predicted')) s(subset, role)
where entity_type in ('run', 'fusion_run') and (s.subset <> 'valA' or k % 3 = 0)""",
    "fx_links": """
select a.entity_id as source_id, b.entity_id as target_id from {fx_entities} a join {fx_entities} b on b.k = a.k * 2 + 1
union select a.entity_id, b.entity_id from {fx_entities} a join {fx_entities} b on b.k = a.k + 3""",
    "fx_transitions": """
select concat('d', cast(a.n_nationkey as varchar(20))) as source_id, concat('d', cast(b.n_nationkey as varchar(20))) as target_id from {nation} a join {nation} b on b.n_nationkey = a.n_nationkey * 2 + 1
union select concat('d', cast(a.n_nationkey as varchar(20))), concat('d', cast(b.n_nationkey as varchar(20))) from {nation} a join {nation} b on b.n_nationkey = a.n_nationkey + 3""",
    "fx_transition_changes": """
select t.source_id, t.target_id, concat('c', cast(o.o_orderkey % 5000 as varchar(20))) as change_id
from {fx_transitions} t join {orders} o on t.source_id = concat('d', cast(o.o_custkey % 25 as varchar(20)))
where o.o_orderkey % 2 = length(t.target_id) % 2 or o.o_orderkey % 7 = 0""",
    "fx_label_ids": """
select case when doc_id % 13 = 0 then concat('x', cast(doc_id as varchar(20)))
  else concat('s', lpad(cast(case when doc_id % 50 = 1 then doc_id - 1 else doc_id end as varchar(20)), 8, '0')) end as id from {documents}""",
    "fx_declared": """
select subset, role from (values ('train', 'train'), ('valA', 'eval'), ('valB', 'eval'), ('holdout', 'sealed'), ('spare', 'eval')) s(subset, role)""",
    "fx_notes": """
select o_orderkey as note_id, concat(case o_orderkey % 3 when 0 then ' ' when 1 then 'see ' else '' end, 'S', cast(o_custkey as varchar(20)),
  case o_orderkey % 5 when 0 then '0' when 1 then '-b' else ', as' end, ' S', cast(o_orderkey % 97 as varchar(20)), ' (S', cast(o_custkey % 41 as varchar(20)), ')') as description from {orders}""",
    "fx_claims": """
select l_orderkey as authorization_id, concat('k', cast(l_linenumber as varchar(20))) as name, cast(l_partkey % 7 as varchar(20)) as want,
  case when l_suppkey % 11 = 0 then null else cast((l_partkey + case when l_suppkey % 17 = 0 then 1 else 0 end) % 7 as varchar(20)) end as got,
  l_suppkey % 5 > 0 as bound, l_suppkey % 7 > 0 as given from {lineitem}""",
    "fx_registered": """
select concat('run', cast(l_orderkey as varchar(20))) as run_id, concat('f', cast(l_partkey as varchar(20))) as path, l_shipdate as at_time,
  l_orderkey * 10 + l_linenumber as place, case when l_linenumber % 3 > 0 then concat('h', cast(l_suppkey as varchar(20))) end as digest,
  case when l_linenumber % 2 > 0 then cast(l_quantity as bigint) end as bytes from {lineitem}""",
    "fx_cards": """
select concat('run', cast(n_nationkey as varchar(20))) as run_id, case when n_nationkey % 4 > 0 then concat('p', cast(n_nationkey % 3 as varchar(20))) end as prediction_sha from {nation}""",
    "fx_costs": """
select o_orderkey as id, o_custkey * o_custkey as edges, o_totalprice as incremental_predicted, o_totalprice * (1e0 + (o_orderkey % 21 - 10) * 1e-2) as incremental_actual,
  o_totalprice + 500 as full_predicted, o_totalprice + 500 + o_custkey % 13 as full_actual from {orders}""",
    "fx_head_statuses": """
select h.head, e.entity_id, case (e.k * h.head + e.k % 7) % 4 when 0 then 'ACTIVE' when 1 then 'REVIEW_REQUIRED' when 2 then 'STALE' else 'BROKEN' end as status
from (select entity_id, cast(k as int) as k from {fx_entities}) e cross join (values (1), (2), (3)) h(head)""",
    "fx_paths": """
select sample_id, case sample_id % 7 when 0 then 'views[0].width' when 1 then 'labels.cls' when 2 then 'label_source' when 3 then 'group' when 4 then 'meta.site' when 5 then '*' else 'labels.boxes[2].x' end as path from {fx_v1}""",
}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _used(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, or a fixture over them."""
    if name not in SQL:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spark.sql(SQL[name], **{x: table(spark, sf_dir, x) for x in _used(SQL[name])})


def placed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture that selects from one driver table, with ``source_row``: where each row stands in that table's files, which decides between rows that are equal in a query's order."""
    (source,) = _used(SQL[name])
    rows = table(spark, sf_dir, source)
    # a table of one file needs no names
    names = ["_metadata.file_name"] if len(rows.inputFiles()) > 1 else []
    rows = rows.select("*", F.struct(*names, "_metadata.row_index").alias("source_row"))
    return spark.sql(SQL[name].replace("select ", "select source_row, ", 1), **{source: rows})


def duckdb_sql(sql: str) -> str:
    """A query that names fixtures in braces, with those it needs put before it."""
    needed: list[str] = []

    def need(text: str) -> None:
        for x in _used(text):
            if x in SQL and x not in needed:
                need(SQL[x])
                needed.append(x)

    need(sql)
    plain = lambda text: re.sub(r"\{(\w+)\}", r"\1", text)
    heads = ", ".join(f"{x} as ({plain(SQL[x])})" for x in needed)
    body = plain(sql).strip()
    if not heads:
        return body
    if body.lower().startswith("with recursive"):
        return f"with recursive {heads}, {body[len('with recursive'):]}"
    return f"with {heads}, {body[len('with'):]}" if body.lower().startswith("with ") else f"with {heads} {body}"
