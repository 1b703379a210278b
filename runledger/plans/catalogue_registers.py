"""Further named queries: label files, claims, notes, references, grades, sealed readings, costs, names."""

from __future__ import annotations

from pyspark.sql import functions as F

from runledger.fixtures import placed, table
from runledger.operators import registers, validate
from runledger.plans.catalogue import query, rounded

GRADES = ["declared", "recorded", "verified"]
SEVERITY = {"ACTIVE": 0, "REVIEW_REQUIRED": 1, "STALE": 2, "BROKEN": 3}
EFFECT_SEVERITY = {"DISPLAY_ONLY": 0, "EVALUATION_AFFECTING": 1, "TRAINING_AFFECTING": 2, "INPUT_AFFECTING": 3, "SPLIT_AFFECTING": 4, "UNKNOWN": 5}

_KEYS = "keys as (select doc_id, concat('s', lpad(doc_id::varchar, 8, '0')) as sample_id, concat('key', doc_id - (doc_id % 30 = 1)::int) as key from {documents})"


@query(f"with {_KEYS} select key, min(sample_id) as sample_id, count(distinct sample_id) > 1 as ambiguous from keys group by key")
def label_key_owners(spark, d):
    number = F.col("doc_id") - (F.col("doc_id") % 30 == 1).cast("int")
    keys = table(spark, d, "documents").select(F.concat(F.lit("key"), number.cast("string")).alias("key"), F.concat(F.lit("s"), F.lpad(F.col("doc_id").cast("string"), 8, "0")).alias("sample_id"))
    return registers.key_owners(keys)


@query("with own as (select id, count(*) as n from {fx_label_ids} group by 1), j as (select n, a.sample_id, a.subset from own left join {fx_assignment} a on a.sample_id = own.id) select case when n > 1 then 'duplicate' when sample_id is null then 'external' when subset in ('valA', 'valB') then 'matched' else 'outside' end as verdict, coalesce(subset, '-') as subset, sum(n)::bigint as n from j group by 1, 2")
def label_classification(spark, d):
    samples = table(spark, d, "fx_assignment")
    owners = registers.key_owners(samples.select(F.col("sample_id").alias("key"), "sample_id"))
    return registers.classified_labels(table(spark, d, "fx_label_ids"), owners, samples, ["valA", "valB"])


@query("select subset, role from {fx_declared} where subset not in (select subset from {fx_assignment})")
def empty_subsets(spark, d):
    return registers.empty_subsets(table(spark, d, "fx_declared"), table(spark, d, "fx_assignment"))


_TOUCHED = "t as (select run_id, subset from {fx_run_subsets} where role = 'trained' and subset = 'valA')"


@query(f"with {_TOUCHED}, r as (select distinct run_id from {{fx_run_subsets}}) select r.run_id, s.subset from r cross join (values ('valA'), ('valB'), ('spare')) s(subset) where (s.subset <> 'spare' or r.run_id not in (select run_id from t)) and (r.run_id, s.subset) not in (select (run_id, subset) from t)")
def default_subsets(spark, d):
    """Only ``valA`` counts as trained on here; a subset without samples is clean only for runs that touched nothing."""
    rows, declared = table(spark, d, "fx_run_subsets"), table(spark, d, "fx_declared")
    touched = rows.where("role = 'trained' and subset = 'valA'").select("run_id", "subset")
    plan = table(spark, d, "fx_assignment").join(F.broadcast(declared), "subset")
    return registers.default_subsets(rows.select("run_id").distinct(), declared, touched, validate.clean_subsets(plan, touched), unseal=False)


@query("with m as (select page_id, concat_ws(',', case when trim(coalesce(url, '')) = '' then 'url' end, case when trim(coalesce(html, '')) = '' then 'html' end, case when page_id % 9 = 4 then 'license' end) as missing from {pages}) select page_id, case missing when '' then '-' else missing end as missing, case missing when '' then 'OK' else 'FAIL' end as status from m")
def provenance_audit(spark, d):
    cards = table(spark, d, "pages").withColumn("license", F.when(F.col("page_id") % 9 == 4, " ").otherwise("known"))
    return registers.missing_fields(cards, "page_id", ["url", "html", "license"])


@query("with m as (select o_orderkey as sample_id, max(l_linenumber) as last, max((l_partkey % 29 = 0)::int) as strange from {orders} left join {lineitem} on l_orderkey = o_orderkey group by 1) select * from (select sample_id, case when last is null then 'no_masks' when last > 5 then 'no_view' when strange = 1 then 'unknown_category' end as problem from m) where problem is not null")
def validate_masks(spark, d):
    masks = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("sample_id"), (F.col("l_linenumber") - 1).alias("view"), F.when(F.col("l_partkey") % 29 > 0, 1).alias("category_id"))
    return registers.mask_problems(table(spark, d, "orders").select(F.col("o_orderkey").alias("sample_id"), F.lit(5).alias("views")), masks, [0, 1, 2])


_SIDES = "b as (select authorization_id, name, max(want) as want from {fx_claims} where bound group by all), g as (select authorization_id, name, max(got) as got from {fx_claims} where given group by all)"


def _sides(spark, d):
    rows = table(spark, d, "fx_claims")
    side = lambda flag, value: rows.where(flag).groupBy("authorization_id", "name").agg(F.max(value).alias("value"))
    return side("bound", "want"), side("given", "got")


@query(f"with {_SIDES} select authorization_id, name, want, got from b left join g using (authorization_id, name) where want is distinct from got")
def authorization_differences(spark, d):
    return registers.claim_differences(*_sides(spark, d), "authorization_id")


@query(f"with {_SIDES}, j as (select authorization_id, name, want, got, b.name is not null as inb, g.name is not null as ing from b full join g using (authorization_id, name)) select authorization_id, name, want, got from j where want is distinct from got or not inb or not ing")
def spec_differences(spark, d):
    return registers.claim_differences(*_sides(spark, d), "authorization_id", both=True)


@query("with t as (select distinct note_id, description, unnest(regexp_extract_all(description, '[A-Za-z0-9._-]+')) as submission_id from {fx_notes}) select note_id, submission_id, regexp_extract(description, '^\\s*([A-Za-z0-9._-]+)', 1) = submission_id as leads from t where submission_id in (select concat('S', c_custkey) from {customer})")
def note_mentions(spark, d):
    ids = table(spark, d, "customer").select(F.concat(F.lit("S"), F.col("c_custkey").cast("string")).alias("submission_id"))
    return registers.mentions(table(spark, d, "fx_notes"), ids)


@query("select path, min(run_id) as run_id from {fx_registered} where at_time <= timestamp '1996-06-17' and path not in (select concat('f', s_suppkey) from {supplier}) group by path")
def backup_gaps(spark, d):
    listed = table(spark, d, "supplier").select(F.concat(F.lit("f"), F.col("s_suppkey").cast("string")).alias("path"))
    return registers.registered_gaps(table(spark, d, "fx_registered"), listed, F.lit("1996-06-17").cast("timestamp"))


@query("select path, count(distinct run_id) as referrers, arg_min(digest, place) filter (digest is not null) as digest, arg_min(bytes, place) filter (bytes is not null) as bytes from {fx_registered} group by path")
def reference_collapse(spark, d):
    rows = placed(spark, d, "fx_registered").withColumn("place", F.struct("place", "source_row"))
    return registers.collapsed_references(rows.withColumnRenamed("run_id", "referrer"))


@query("with f as (select source as class, md5(text) as digest, count(*) as n, min(strlen(text)) as one from {documents} group by all) select class, sum(n)::bigint as files, sum(n * one)::bigint as bytes, sum(n - 1)::bigint as repeats, sum((n - 1) * one)::bigint as repeat_bytes from f group by class")
def listing_totals(spark, d):
    return registers.listing_totals(table(spark, d, "documents").select(F.col("source").alias("class"), F.md5(F.col("text").cast("binary")).alias("digest"), F.octet_length("text").cast("long").alias("bytes")))


@query("select doc_id, strlen(text) as bytes from {documents} where strlen(text) >= 4096 order by bytes desc, doc_id")
def large_items(spark, d):
    size = F.octet_length("text")
    return table(spark, d, "documents").where(size >= 4096).select("doc_id", size.cast("long").alias("bytes")).orderBy(F.desc("bytes"), "doc_id")


@query("select o_custkey, name, max(value) as value from {fx_named_values} join {orders} on o_orderkey = sample_id group by all")
def group_key_vectors(spark, d):
    groups = table(spark, d, "orders").select(F.col("o_orderkey").alias("sample_id"), "o_custkey")
    return registers.group_vectors(table(spark, d, "fx_named_values").join(groups, "sample_id"), "o_custkey")


@query("select grp, arg_min(cls, sample_id) filter (cls is not null) as cls from {fx_samples} group by grp")
def group_key_first(spark, d):
    return registers.group_first_label(table(spark, d, "fx_samples"), "grp")


@query("select entity_id, status, head from {fx_head_statuses} qualify row_number() over (partition by entity_id order by case status when 'BROKEN' then 0 when 'STALE' then 1 when 'REVIEW_REQUIRED' then 2 else 3 end, head) = 1")
def worst_over_heads(spark, d):
    return registers.worst_over_heads(table(spark, d, "fx_head_statuses"), SEVERITY)


@query("with m as (select l.target_id, e.k % 3 as g from {fx_links} l join {fx_entities} e on e.entity_id = l.source_id) select entity_id, case coalesce(min(g), 0) when 0 then 'declared' when 1 then 'recorded' else 'verified' end as grade from {fx_entities} left join m on target_id = entity_id group by entity_id")
def fused_grades(spark, d):
    entities = table(spark, d, "fx_entities")
    grade = F.element_at(F.array(*map(F.lit, GRADES)), (F.col("k") % 3 + 1).cast("int"))
    members = table(spark, d, "fx_links").join(entities.select(F.col("entity_id").alias("source_id"), grade.alias("grade")), "source_id")
    return registers.lowest_grade(entities, members.select(F.col("target_id").alias("entity_id"), "grade"), "entity_id", GRADES)


@query("with n as (select run_id, max(seq) as seq, arg_max(value, seq) as value from {fx_readings} where subset = 'holdout' and metric = 'loss' group by 1) select c.run_id, seq, value, case when seq is null then 'no_sealed_reading' when prediction_sha is null or prediction_sha <> concat('p', (seq // 3) % 3) then 'stale_reading' when seq % 4 = 1 then 'partial_reading' else '' end as unusable from {fx_cards} c left join n using (run_id)")
def sealed_readings(spark, d):
    rows = table(spark, d, "fx_readings").where("subset = 'holdout' and metric = 'loss'")
    rows = rows.withColumns({"prediction_sha": F.concat(F.lit("p"), (F.floor(F.col("seq") / 3) % 3).cast("string")), "n_samples": F.when(F.col("seq") % 4 == 1, 99).otherwise(100)})
    return registers.sealed_readings(table(spark, d, "fx_cards"), rows, 100)


@query("select round(sqrt(avg(((incremental_actual - incremental_predicted) / incremental_predicted) ** 2)), 9) as incremental_rmse, round(sqrt(avg(((full_actual - full_predicted) / full_predicted) ** 2)), 9) as full_rmse from {fx_costs}")
def cost_relative_band(spark, d):
    return rounded(registers.relative_band(table(spark, d, "fx_costs")), "incremental_rmse", "full_rmse")


_STRATA = "s as (select length(edges::varchar) - 1 as decade, sqrt(avg((incremental_actual - incremental_predicted) ** 2)) as incremental_rmse, sqrt(avg((full_actual - full_predicted) ** 2)) as full_rmse, count(*) as observations from {fx_costs} group by 1)"


@query(f"with {_STRATA} select decade::int as decade, round(incremental_rmse, 4) as incremental_rmse, round(full_rmse, 6) as full_rmse, observations from s")
def cost_stratified_band(spark, d):
    rows = rounded(registers.stratified_band(table(spark, d, "fx_costs")), "incremental_rmse", digits=4)
    return rounded(rows, "full_rmse", digits=6)


@query(f"with {_STRATA}, p as (select o_orderkey as id, length((o_orderkey * 1000000)::varchar) - 1 as own from {{orders}}) select id, round(arg_min(incremental_rmse, abs(decade - own) * 100 - decade), 4) as width from p cross join s group by id")
def cost_band_width(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") * 1000000).alias("edges"))
    return rounded(registers.band_widths(rows, registers.stratified_band(table(spark, d, "fx_costs"))), "width", digits=4)


@query("select dataset_id, max(case effect when 'EVALUATION_AFFECTING' then 1 when 'TRAINING_AFFECTING' then 2 when 'INPUT_AFFECTING' then 3 when 'SPLIT_AFFECTING' then 4 when 'UNKNOWN' then 5 else 0 end) as severity from {fx_changes} group by 1")
def worst_effect(spark, d):
    return registers.worst_effect(table(spark, d, "fx_changes"), EFFECT_SEVERITY, "dataset_id")


@query("with p as (select *, regexp_extract(path, '^[a-z_]*') as top from {fx_paths}) select sample_id, path, case when top in ('views', 'labels', 'label_source', 'group', 'meta') then top else 'unknown' end as domain, unnest(case top when 'views' then ['INPUT_AFFECTING'] when 'labels' then ['EVALUATION_AFFECTING', 'TRAINING_AFFECTING'] when 'label_source' then ['EVALUATION_AFFECTING', 'TRAINING_AFFECTING'] when 'group' then ['SPLIT_AFFECTING'] else ['UNKNOWN'] end) as effect from p")
def changed_paths(spark, d):
    return registers.changed_paths(table(spark, d, "fx_paths"))


@query("select distinct l.target_id as run_id, s.subset from {fx_links} l join {fx_run_subsets} s on s.run_id = l.source_id and s.role = 'trained'")
def fused_trained_on(spark, d):
    trained = table(spark, d, "fx_run_subsets").where("role = 'trained'").select(F.col("run_id").alias("source_id"), "subset")
    return table(spark, d, "fx_links").join(trained, "source_id").select(F.col("target_id").alias("run_id"), "subset").distinct()


@query("select distinct run_id, subset from {fx_run_subsets} where role = 'predicted' and subset in (select subset from {fx_readings})")
def claimed_and_measured(spark, d):
    """Subsets that a claim names and that have been measured."""
    return table(spark, d, "fx_run_subsets").where("role = 'predicted'").join(table(spark, d, "fx_readings").select("subset").distinct(), "subset", "left_semi").select("run_id", "subset").distinct()


@query("select target_id as entity_id from {fx_edges} where target_id not in (select source_id from {fx_edges}) group by 1")
def graph_heads(spark, d):
    """Nodes that nothing is derived from."""
    edges = table(spark, d, "fx_edges")
    return edges.select(F.col("target_id").alias("entity_id")).distinct().join(edges.select(F.col("source_id").alias("entity_id")), "entity_id", "left_anti")


@query("with r as (select entity_id, case when k % 40 = 3 then 'run:0' else run_ref end as run_ref from {fx_entities} where entity_type = 'reading') select entity_id, run_ref from r where run_ref not in (select entity_id from {fx_entities})")
def orphan_readings(spark, d):
    entities = table(spark, d, "fx_entities")
    readings = entities.where("entity_type = 'reading'").withColumn("run_ref", F.when(F.col("k") % 40 == 3, "run:0").otherwise(F.col("run_ref")))
    return readings.join(entities.select(F.col("entity_id").alias("run_ref")), "run_ref", "left_anti").select("entity_id", "run_ref")


@query("with n as (select event_id, case event_id % 4 when 0 then concat('a/b', event_id) when 1 then concat('é', event_id) when 2 then '..' else concat('v_', event_id) end as name, case event_id % 5 when 0 then '0' when 1 then concat(event_id % 90, 'm') when 2 then concat(' ', event_id % 40, 'h') when 3 then concat(event_id % 9, 'd') else '12' end as age, * from {events}) select event_id, case event_id % 4 when 0 then concat('a__b', event_id) when 3 then name else sha256(name)[:16] end as folder, (case event_id % 5 when 0 then 0 when 1 then event_id % 90 * 60 when 2 then event_id % 40 * 3600 when 3 then event_id % 9 * 86400 end)::bigint as seconds, case when event_id % 3 = 0 then concat('foreign:p', user_id) else concat('S', user_id) end as label, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') as stamp from n")
def record_names(spark, d):
    n, text = F.col("event_id"), lambda x: x.cast("string")
    name = F.when(n % 4 == 0, F.concat(F.lit("a/b"), text(n))).when(n % 4 == 1, F.concat(F.lit("é"), text(n))).when(n % 4 == 2, F.lit("..")).otherwise(F.concat(F.lit("v_"), text(n)))
    age = F.when(n % 5 == 0, F.lit("0")).when(n % 5 == 1, F.concat(text(n % 90), F.lit("m"))).when(n % 5 == 2, F.concat(F.lit(" "), text(n % 40), F.lit("h"))).when(n % 5 == 3, F.concat(text(n % 9), F.lit("d"))).otherwise(F.lit("12"))
    label = registers.arrival_label(F.when(n % 3 > 0, F.concat(F.lit("S"), text(F.col("user_id")))), F.concat(F.lit("p"), text(F.col("user_id"))))
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return table(spark, d, "events").select("event_id", registers.safe_name(name).alias("folder"), registers.age_seconds(age).alias("seconds"), label.alias("label"), stamp.alias("stamp"))


@query("with p as (select vec_id, unnest(embedding)::double as a, unnest(list_reverse(embedding))::double as b from {embeddings}) select vec_id, round(coalesce(case when stddev_pop(a) * stddev_pop(b) > 0 then corr(a, b) end, 1.0::double), 6) as r from p group by 1")
def vector_correlation(spark, d):
    return rounded(table(spark, d, "embeddings").select("vec_id", registers.pearson(F.col("embedding"), F.reverse("embedding")).alias("r")), "r", digits=6)


@query("select l_orderkey, l_linenumber, least(greatest(x::double, 0), 600.0::double) as x1, least(greatest(y::double, 0), 400.0::double) as y1, least(greatest((x + w)::double, 0), 600.0::double) as x2, least(greatest((y + h)::double, 0), 400.0::double) as y2 from {fx_boxes}")
def boxes_clipped(spark, d):
    corner = lambda c: F.expr(c).cast("double")
    rows = table(spark, d, "fx_boxes").select("l_orderkey", "l_linenumber", corner("x").alias("x1"), corner("y").alias("y1"), corner("x + w").alias("x2"), corner("y + h").alias("y2"), F.lit(600).alias("width"), F.lit(400).alias("height"))
    return registers.clipped(rows).drop("width", "height")
