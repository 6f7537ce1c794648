"""Projections, filters, joins, aggregates, windows, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamina.constants import PEAK_LOAD_ALERT_KWH
from lamina.functions.calendar import in_month, month_start
from lamina.operators import aggregates, ordered, relational
from lamina.plans import energy as energy_plans
from lamina.plans import maintenance as maintenance_plans
from lamina.plans import shifts
from lamina.sources.files import chronological
from workload import tables as t
from workload.registry import query
from workload.tables import ts

# ---- filters and projections ----


@query("filter_eq", "SELECT count(*) AS n FROM plates WHERE steel_grade = 'R'", "plates")
def _(spark, sf):
    return t.plates(spark, sf).filter(F.col("steel_grade") == "R").agg(F.count("*").alias("n"))


@query(
    "filter_half_open_range",
    "SELECT round(sum(usage_kwh), 4) AS kwh FROM energy WHERE load_type = 'purchase' "
    "AND ts >= '2024-01-01' AND ts < '2024-02-01'",
    "energy",
)
def _(spark, sf):
    wanted = (F.col("load_type") == "purchase") & in_month(F.col("ts"), 2024, 1)
    return t.energy(spark, sf).filter(wanted).agg(F.round(F.sum("usage_kwh"), 4).alias("kwh"))


@query("filter_threshold", "SELECT count(*) AS n FROM energy WHERE usage_kwh > 99.0", "energy")
def _(spark, sf):
    return t.energy(spark, sf).filter(F.col("usage_kwh") > 99.0).agg(F.count("*").alias("n"))


@query(
    "filter_null",
    "SELECT category, count(*) AS without_report FROM maintenance WHERE report_doc_id IS NULL "
    "GROUP BY category",
    "maintenance",
)
def _(spark, sf):
    missing = t.maintenance(spark, sf).filter(F.col("report_doc_id").isNull())
    return missing.groupBy("category").agg(F.count("*").alias("without_report"))


@query(
    "filter_in",
    "SELECT count(*) AS n FROM plates p JOIN faults f USING (fault_code) "
    "WHERE f.label_fr IN ('PROMO', 'LARGE')",
    "plates", "faults",
)
def _(spark, sf):
    wanted = t.faults(spark, sf).filter(F.col("label_fr").isin("PROMO", "LARGE"))
    return t.plates(spark, sf).join(wanted, "fault_code", "left_semi").agg(F.count("*").alias("n"))


@query(
    "filter_or",
    "SELECT p.steel_grade, count(*) AS n FROM plates p JOIN faults f USING (fault_code) "
    "WHERE f.severity >= 3 OR p.steel_grade IN ('A') GROUP BY 1",
    "plates", "faults",
)
def _(spark, sf):
    counted = t.plates(spark, sf).groupBy("fault_code", "steel_grade").agg(F.count("*").alias("_n"))
    joined = counted.join(t.faults(spark, sf), "fault_code")
    kept = joined.filter((F.col("severity") >= 3) | F.col("steel_grade").isin("A"))
    return kept.groupBy("steel_grade").agg(F.sum("_n").alias("n"))


@query(
    "filter_hour_wrap",
    "SELECT round(sum(usage_kwh), 4) AS night_kwh FROM energy "
    "WHERE extract(hour FROM ts) >= 22 OR extract(hour FROM ts) < 6",
    "energy",
)
def _(spark, sf):
    night = (F.hour("ts") >= 22) | (F.hour("ts") < 6)
    return t.energy(spark, sf).filter(night).agg(F.round(F.sum("usage_kwh"), 4).alias("night_kwh"))


@query(
    "filter_metadata",
    "SELECT chunk_id, source_id FROM chunks WHERE lang = 'fr' AND source = 'src3'", "chunks",
)
def _(spark, sf):
    kept = relational.filter_metadata(t.chunks(spark, sf), {"lang": "fr", "source": "src3"})
    return kept.select("chunk_id", "source_id")


@query(
    "project_case",
    "SELECT fault_code, CASE WHEN severity = 3 THEN 'high' ELSE 'low' END AS level FROM faults",
    "faults",
)
def _(spark, sf):
    level = F.when(F.col("severity") == 3, "high").otherwise("low")
    return t.faults(spark, sf).select("fault_code", level.alias("level"))


@query(
    "project_onehot_collapse",
    "SELECT event_id, event_type AS fault FROM events",
)
def _(spark, sf):
    from lamina.sources.files import collapse_one_hot

    events = t.table(spark, sf, "events")
    names = ("view", "signup", "click", "error", "purchase")
    wide = events.select(
        "event_id", *[(F.col("event_type") == n).cast("int").alias(f"is_{n}") for n in names]
    )
    return collapse_one_hot(wide, {f"is_{n}": n for n in names}, "fault")


@query(
    "limit_default",
    "SELECT event_id FROM events ORDER BY ts, event_id LIMIT 200",
)
def _(spark, sf):
    ordered_events = t.table(spark, sf, "events").orderBy("ts", "event_id").select("event_id")
    return relational.limit_default(ordered_events)


@query(
    "result_preview",
    """SELECT event_id, usage_kwh, n AS row_count, n > 50 AS truncated
    FROM (SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY usage_kwh DESC, event_id) AS place FROM energy WHERE usage_kwh > 99.0)
    WHERE place <= 50""",
    "energy",
)
def _(spark, sf):
    peaks = t.energy(spark, sf).where(F.col("usage_kwh") > PEAK_LOAD_ALERT_KWH).select("event_id", "usage_kwh")
    shown, summary = relational.result_preview(peaks.orderBy(F.desc("usage_kwh"), "event_id"))
    return shown.join(F.broadcast(summary))


# ---- joins ----


@query(
    "join_inner_dim",
    "SELECT count(*) AS n FROM plates p JOIN faults f ON f.fault_code = p.fault_code "
    "WHERE f.severity = 3",
    "plates", "faults",
)
def _(spark, sf):
    severe = t.faults(spark, sf).filter(F.col("severity") == 3)
    return t.plates(spark, sf).join(severe, "fault_code").agg(F.count("*").alias("n"))


@query(
    "join_three_way",
    "SELECT l.process, f.label_fr, count(*) AS n FROM plates p JOIN lines l USING (line_id) "
    "JOIN faults f USING (fault_code) GROUP BY 1, 2",
    "plates", "lines", "faults",
)
def _(spark, sf):
    # Lines are few and become their process at once; rows are counted before they meet the faults.
    # (Line and fault together are nearly a key here: counting by both would reduce nothing.)
    with_process = t.plates(spark, sf).join(t.lines(spark, sf), "line_id")
    by_process = with_process.groupBy("process", "fault_code").agg(F.count("*").alias("_n"))
    joined = by_process.join(t.faults(spark, sf), "fault_code")
    return joined.groupBy("process", "label_fr").agg(F.sum("_n").alias("n"))


@query(
    "join_left",
    "SELECT f.fault_code, f.severity, count(m.event_id) AS events FROM faults f "
    "LEFT JOIN maintenance m ON m.fault_code = f.fault_code GROUP BY 1, 2",
    "faults", "maintenance",
)
def _(spark, sf):
    # Events are counted by key first, so the outer join meets one row per fault.
    counted = t.maintenance(spark, sf).groupBy("fault_code").agg(F.count("event_id").alias("_n"))
    joined = t.faults(spark, sf).join(counted, "fault_code", "left")
    none = F.lit(0).cast("bigint")
    return joined.select("fault_code", "severity", F.coalesce("_n", none).alias("events"))


@query(
    "join_in_subquery",
    "SELECT line_id, count(*) AS n FROM plates WHERE fault_code IN "
    "(SELECT fault_code FROM faults WHERE severity = 3) GROUP BY line_id",
    "plates", "faults",
)
def _(spark, sf):
    severe = t.faults(spark, sf).filter(F.col("severity") == 3)
    kept = t.plates(spark, sf).join(severe, "fault_code", "left_semi")
    return kept.groupBy("line_id").agg(F.count("*").alias("n"))


@query(
    "join_exists",
    "SELECT c_custkey AS custkey, EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c_custkey "
    "AND o_totalprice > 400000) AS found FROM customer",
)
def _(spark, sf):
    big = t.table(spark, sf, "orders").filter(F.col("o_totalprice") > 400000)
    customers = t.table(spark, sf, "customer").select(F.col("c_custkey").alias("custkey"))
    return relational.exists_flag(
        customers, big.select(F.col("o_custkey").alias("custkey")), "custkey"
    )


@query(
    "join_anti_refs",
    "SELECT 'left' AS side, CAST(k AS VARCHAR) AS key FROM (SELECT DISTINCT fault_code AS k FROM "
    "maintenance WHERE fault_code IS NOT NULL EXCEPT SELECT fault_code FROM faults) UNION ALL "
    "SELECT 'right', CAST(k AS VARCHAR) FROM (SELECT fault_code AS k FROM faults EXCEPT "
    "SELECT fault_code FROM maintenance)",
    "maintenance", "faults",
)
def _(spark, sf):
    return relational.anti_references(
        t.maintenance(spark, sf), t.faults(spark, sf), "fault_code", "fault_code"
    )


@query(
    "join_correlated_top1",
    "SELECT line_id, plates, top_fault FROM (SELECT line_id, CAST(sum(n) OVER (PARTITION BY "
    "line_id) AS BIGINT) AS plates, fault_code AS top_fault, row_number() OVER (PARTITION BY "
    "line_id ORDER BY n DESC, fault_code) AS r FROM (SELECT line_id, fault_code, count(*) AS n "
    "FROM plates GROUP BY 1, 2)) WHERE r = 1",
    "plates",
)
def _(spark, sf):
    pairs = t.plates(spark, sf).groupBy("line_id", "fault_code").agg(F.count("*").alias("n"))
    top = relational.distinct_on(pairs, ["line_id"], [F.desc("n"), F.col("fault_code")])
    totals = pairs.groupBy("line_id").agg(F.sum("n").alias("plates"))
    return totals.join(
        top.select("line_id", F.col("fault_code").alias("top_fault")), "line_id"
    )


@query(
    "join_lateral_topk",
    "SELECT line_id, name_fr, event_id, rank FROM (SELECT c_custkey AS line_id, c_name AS name_fr, "
    "o_orderkey AS event_id, row_number() OVER (PARTITION BY c_custkey ORDER BY o_totalprice DESC, "
    "o_orderkey) AS rank FROM customer JOIN orders ON o_custkey = c_custkey) WHERE rank <= 3",
)
def _(spark, sf):
    customers = t.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("line_id"), F.col("c_name").alias("name_fr")
    )
    orders = t.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("line_id"), F.col("o_orderkey").alias("event_id"), "o_totalprice"
    )
    best = relational.lateral_topk(
        customers, orders, "line_id", [F.desc("o_totalprice"), F.asc("event_id")], 3
    )
    return best.select("line_id", "name_fr", "event_id", F.col("rank").cast("bigint").alias("rank"))


@query(
    "join_lateral_unnest",
    "SELECT event_id, r.name AS name, r.value AS value FROM (SELECT event_id, unnest(["
    "{'name': 'usage', 'value': usage_kwh}, {'name': 'factor', 'value': "
    "lagging_current_power_factor}]) AS r FROM energy)",
    "energy",
)
def _(spark, sf):
    paired = t.energy(spark, sf).select(
        "event_id",
        F.array(F.lit("usage"), F.lit("factor")).alias("name"),
        F.array("usage_kwh", "lagging_current_power_factor").alias("value"),
    )
    return relational.unnest_pairs(paired, ["event_id"], ["name", "value"])


@query(
    "join_shift_range",
    "SELECT shift_code, count(*) AS intervals FROM energy JOIN (VALUES ('M', 6, 14), "
    "('A', 14, 22), ('N', 22, 6)) AS s(shift_code, a, b) ON CASE WHEN a < b THEN "
    "hour(ts) >= a AND hour(ts) < b ELSE hour(ts) >= a OR hour(ts) < b END GROUP BY 1",
    "energy",
)
def _(spark, sf):
    from lamina.sources.files import seed_dims

    joined = shifts.join_shift_range(t.energy(spark, sf), seed_dims(spark)["shifts"], "ts")
    return joined.groupBy("shift_code").agg(F.count("*").alias("intervals"))


# ---- aggregates ----


@query(
    "agg_global",
    "SELECT count(*) AS n, round(sum(usage_kwh), 4) AS total, round(avg(usage_kwh), 6) AS mean, "
    "max(usage_kwh) AS top FROM energy",
    "energy",
)
def _(spark, sf):
    return t.energy(spark, sf).agg(
        F.count("*").alias("n"), F.round(F.sum("usage_kwh"), 4).alias("total"),
        F.round(F.avg("usage_kwh"), 6).alias("mean"), F.max("usage_kwh").alias("top"),
    )


@query(
    "agg_group",
    "SELECT category, count(*) AS n, CAST(sum(downtime_minutes) AS BIGINT) AS minutes_arret, "
    "round(avg(downtime_minutes), 6) AS mean FROM maintenance GROUP BY category",
    "maintenance",
)
def _(spark, sf):
    return t.maintenance(spark, sf).groupBy("category").agg(
        F.count("*").alias("n"), F.sum("downtime_minutes").alias("minutes_arret"),
        F.round(F.avg("downtime_minutes"), 6).alias("mean"),
    )


@query(
    "agg_having",
    "SELECT line_id, count(*) AS n FROM plates GROUP BY line_id HAVING count(*) > 600", "plates",
)
def _(spark, sf):
    grouped = t.plates(spark, sf).groupBy("line_id").agg(F.count("*").alias("n"))
    return grouped.filter(F.col("n") > 600)


@query(
    "agg_filter_clause",
    "SELECT p.steel_grade, count(*) FILTER (WHERE f.severity = 3) AS critical, count(*) AS total "
    "FROM plates p JOIN faults f USING (fault_code) GROUP BY 1",
    "plates", "faults",
)
def _(spark, sf):
    counted = t.plates(spark, sf).groupBy("fault_code", "steel_grade").agg(F.count("*").alias("_n"))
    joined = counted.join(t.faults(spark, sf), "fault_code")
    critical = F.when(F.col("severity") == 3, F.col("_n")).otherwise(0)
    return joined.groupBy("steel_grade").agg(
        F.sum(critical).alias("critical"), F.sum("_n").alias("total")
    )


@query(
    "agg_pct_share",
    "SELECT line_id, round(CAST(100.0 * count(*) FILTER (WHERE category = 'corrective') AS "
    "DOUBLE) / nullif(count(*), 0), 2) AS pct FROM maintenance GROUP BY line_id",
    "maintenance",
)
def _(spark, sf):
    part = F.count_if(F.col("category") == "corrective")
    share = aggregates.pct_share(part, F.count("*"))
    return t.maintenance(spark, sf).groupBy("line_id").agg(share.alias("pct"))


@query(
    "agg_month",
    "SELECT strftime(date_trunc('month', started_at), '%Y-%m-%d %H:%M:%S.%f') AS mois, "
    "count(*) AS nb_interventions FROM maintenance GROUP BY 1",
    "maintenance",
)
def _(spark, sf):
    month = month_start(F.col("started_at")).alias("mois")
    return t.maintenance(spark, sf).groupBy(month).agg(F.count("*").alias("nb_interventions"))


@query(
    "agg_rounded_decimal",
    "SELECT load_type, CAST(round(CAST(sum(usage_kwh) AS DECIMAL(38,10)), 1) AS DOUBLE) AS total, "
    "CAST(round(CAST(avg(usage_kwh) AS DECIMAL(38,10)), 2) AS DOUBLE) AS mean "
    "FROM energy GROUP BY load_type",
    "energy",
)
def _(spark, sf):
    return t.energy(spark, sf).groupBy("load_type").agg(
        aggregates.rounded_decimal(F.sum("usage_kwh"), 1).alias("total"),
        aggregates.rounded_decimal(F.avg("usage_kwh"), 2).alias("mean"),
    )


@query(
    "agg_percentile_exact",
    "SELECT load_type, f AS fraction, round(CASE WHEN f = 0.5 THEN p50 ELSE p95 END, 6) AS "
    "percentile FROM (SELECT load_type, quantile_cont(usage_kwh, 0.5) AS p50, "
    "quantile_cont(usage_kwh, 0.95) AS p95 FROM energy GROUP BY 1), "
    "(VALUES (CAST(0.5 AS DOUBLE)), (CAST(0.95 AS DOUBLE))) AS x(f)",
    "energy",
)
def _(spark, sf):
    ranked = aggregates.exact_percentiles(
        t.energy(spark, sf), ["load_type"], "usage_kwh", [0.5, 0.95]
    )
    return ranked.withColumn("percentile", F.round("percentile", 6))


@query(
    "agg_distinct",
    "SELECT line_id, category, CAST(n_faults AS BIGINT) AS n_faults FROM (SELECT line_id, "
    "category, count(DISTINCT fault_code) AS n_faults FROM maintenance GROUP BY 1, 2)",
    "maintenance",
)
def _(spark, sf):
    return t.maintenance(spark, sf).groupBy("line_id", "category").agg(
        F.count_distinct("fault_code").alias("n_faults")
    )


@query(
    "agg_overall_and_by_category",
    "SELECT config, CASE WHEN grouping(category) = 1 THEN 'overall' ELSE category END AS scope, "
    "count(*) AS n, round(avg(latency_ms), 6) AS latency FROM outcomes "
    "GROUP BY GROUPING SETS ((config), (config, category))",
    "outcomes",
)
def _(spark, sf):
    return aggregates.overall_and_by(
        t.outcomes(spark, sf), ["config"], "category",
        [F.count("*").alias("n"), F.round(F.avg("latency_ms"), 6).alias("latency")],
    )


@query(
    "agg_nullable_mean",
    "SELECT config, round(avg(CAST(sql_correct AS DOUBLE)), 6) AS accuracy, "
    "round(avg(faithfulness), 6) AS faithfulness FROM outcomes GROUP BY config",
    "outcomes",
)
def _(spark, sf):
    return t.outcomes(spark, sf).groupBy("config").agg(
        F.round(aggregates.share_true(F.col("sql_correct")), 6).alias("accuracy"),
        F.round(F.avg("faithfulness"), 6).alias("faithfulness"),
    )


@query(
    "agg_pooled_ratio",
    "SELECT category, round(CAST(sum(numbers_grounded) AS DOUBLE) / nullif(sum(numbers_checked), 0)"
    ", 6) AS ratio FROM outcomes GROUP BY category",
    "outcomes",
)
def _(spark, sf):
    ratio = aggregates.pooled_ratio(F.col("numbers_grounded"), F.col("numbers_checked"))
    return t.outcomes(spark, sf).groupBy("category").agg(F.round(ratio, 6).alias("ratio"))


# ---- windows ----


@query(
    "window_moving_avg",
    "SELECT event_id, round(avg(usage_kwh) OVER (ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING "
    "AND CURRENT ROW), 6) AS moving_avg FROM energy",
    "energy",
)
def _(spark, sf):
    readings = t.energy(spark, sf).select("event_id", "ts", "usage_kwh")
    averaged = ordered.moving_average(readings, ["ts", "event_id"], "usage_kwh", 3)
    return averaged.select("event_id", F.round("moving_avg", 6).alias("moving_avg"))


@query(
    "window_moving_avg_by_series",
    "SELECT event_id, round(avg(usage_kwh) OVER (PARTITION BY load_type ORDER BY ts, event_id "
    "ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 6) AS moving_avg FROM energy",
    "energy",
)
def _(spark, sf):
    readings = t.energy(spark, sf).select("event_id", "ts", "usage_kwh", "load_type")
    averaged = ordered.moving_average(
        readings, ["ts", "event_id"], "usage_kwh", 3, keys=["load_type"]
    )
    return averaged.select("event_id", F.round("moving_avg", 6).alias("moving_avg"))


@query(
    "window_distinct_on",
    "SELECT DISTINCT ON (fault_code) fault_code, line_id, n FROM (SELECT fault_code, line_id, "
    "count(*) AS n FROM plates GROUP BY 1, 2) ORDER BY fault_code, n DESC, line_id",
    "plates",
)
def _(spark, sf):
    pairs = t.plates(spark, sf).groupBy("fault_code", "line_id").agg(F.count("*").alias("n"))
    return relational.distinct_on(pairs, ["fault_code"], [F.desc("n"), F.col("line_id")])


@query(
    "window_longest_flag",
    "SELECT event_id, category, downtime_minutes, CASE WHEN r <= 20 AND category = 'corrective' "
    "THEN 'MNT-RPT-' || event_id END AS report_doc_id FROM (SELECT *, row_number() OVER "
    "(PARTITION BY category ORDER BY downtime_minutes DESC, event_id) AS r FROM maintenance)",
    "maintenance",
)
def _(spark, sf):
    flagged = maintenance_plans.flag_longest(t.maintenance(spark, sf))
    return flagged.select("event_id", "category", "downtime_minutes", "report_doc_id")


# ---- sorts and top-k ----


@query(
    "sort_chronological",
    f"SELECT event_id, {ts('ts')} AS ts, usage_kwh FROM energy ORDER BY ts, event_id", "energy",
)
def _(spark, sf):
    return t.energy(spark, sf).select("event_id", "ts", "usage_kwh").orderBy("ts", "event_id")


@query(
    "load_chronological",
    f"SELECT {ts('ts')} AS ts, readings, usage_kwh FROM (SELECT date_trunc('minute', ts) AS ts, count(*) AS readings, "
    "round(sum(usage_kwh), 4) AS usage_kwh FROM energy GROUP BY 1)",
    "energy",
)
def _(spark, sf):
    # One row a minute: any instant that came twice would fail the job.
    minute = t.energy(spark, sf).groupBy(F.date_trunc("minute", "ts").alias("ts"))
    loaded = minute.agg(F.count("*").alias("readings"), F.round(F.sum("usage_kwh"), 4).alias("usage_kwh"))
    return chronological(loaded, "ts")


@query(
    "sort_multi",
    "SELECT steel_grade, fault_code, count(*) AS nb FROM plates GROUP BY 1, 2 "
    "ORDER BY steel_grade, nb DESC, fault_code",
    "plates",
)
def _(spark, sf):
    grouped = t.plates(spark, sf).groupBy("steel_grade", "fault_code").agg(F.count("*").alias("nb"))
    return grouped.orderBy("steel_grade", F.desc("nb"), "fault_code")


@query(
    "topk_global",
    "SELECT fault_code, count(*) AS n FROM plates GROUP BY fault_code "
    "ORDER BY n DESC, fault_code LIMIT 3",
    "plates",
)
def _(spark, sf):
    counted = t.plates(spark, sf).groupBy("fault_code").agg(F.count("*").alias("n"))
    return counted.orderBy(F.desc("n"), "fault_code").limit(3)


@query(
    "topk_worst_intervals",
    f"SELECT {ts('ts')} AS ts, lagging_current_power_factor AS power_factor, usage_kwh, "
    "lagging_current_reactive_power_kvarh AS reactive_kvarh FROM energy "
    "WHERE lagging_current_power_factor < 92.0 ORDER BY power_factor, energy.ts, usage_kwh LIMIT 10",
    "energy",
)
def _(spark, sf):
    return energy_plans.worst_intervals(t.energy(spark, sf))


@query(
    "topk_faults_by_downtime",
    "SELECT fault_code, CAST(sum(downtime_minutes) AS BIGINT) AS minutes FROM maintenance "
    "WHERE fault_code IS NOT NULL GROUP BY fault_code ORDER BY minutes DESC, fault_code LIMIT 5",
    "maintenance",
)
def _(spark, sf):
    return maintenance_plans.top_faults_by_downtime(t.maintenance(spark, sf))


# ---- set operations ----


@query(
    "set_union_distinct",
    "SELECT fault_code FROM faults UNION SELECT fault_code FROM maintenance "
    "WHERE fault_code IS NOT NULL",
    "faults", "maintenance",
)
def _(spark, sf):
    a = t.faults(spark, sf).select("fault_code")
    b = t.maintenance(spark, sf).select("fault_code").filter(F.col("fault_code").isNotNull())
    return a.union(b).distinct()


@query(
    "set_intersect",
    "SELECT fault_code FROM faults INTERSECT SELECT fault_code FROM maintenance",
    "faults", "maintenance",
)
def _(spark, sf):
    return t.faults(spark, sf).select("fault_code").intersect(
        t.maintenance(spark, sf).select("fault_code")
    )


@query(
    "set_except",
    "SELECT fault_code FROM faults EXCEPT SELECT fault_code FROM maintenance",
    "faults", "maintenance",
)
def _(spark, sf):
    return t.faults(spark, sf).select("fault_code").subtract(
        t.maintenance(spark, sf).select("fault_code")
    )


@query(
    "set_orphans",
    "SELECT DISTINCT doc_id FROM documents EXCEPT SELECT doc_id FROM labels",
)
def _(spark, sf):
    documents = t.table(spark, sf, "documents").select("doc_id").distinct()
    return documents.join(t.table(spark, sf, "labels"), "doc_id", "left_anti")
