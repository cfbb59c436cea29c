"""Access, performance, discovery and time queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseweave.operators import access, discovery, evolution, performance
from caseweave.operators import filters as flt
from caseweave.plans.tables import CU, EDGES, EV, SE, TRACES, by_customer, by_session, by_user

VARIANT = "click→view"


def _summary(df: DataFrame) -> DataFrame:
    """What a filter lets through: events, cases, sum of ids."""
    return df.agg(F.count("*").alias("n"), F.count_distinct("case_id").alias("cases"), F.coalesce(F.sum("seq"), F.lit(0)).cast("bigint").alias("ids"))


def _filtered(*filters: flt.Filter):
    def run(spark: SparkSession, d: str) -> DataFrame:
        log = by_user(spark, d)
        return _summary(log.events.where(flt.where(filters, log.events.columns)))

    return run


def _filter_sql(where: str) -> str:
    return f"WITH {EV} SELECT count(*) AS n, count(DISTINCT case_id) AS cases, CAST(coalesce(sum(seq), 0) AS BIGINT) AS ids FROM ev WHERE {where}"


def _variant_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = access.variants(by_session(spark, d))
    return rows.select("variant", "n_cases", F.round("avg_duration_s", 6).alias("avg_duration_s"), F.round("median_duration_s", 6).alias("median_duration_s"), "first_seen", "last_seen", F.round("share", 9).alias("share"), "rank")


def _detail(spark: SparkSession, d: str) -> DataFrame:
    rows = access.variant_detail(by_session(spark, d), VARIANT)
    return rows.select("variant", "n_cases", F.round("avg_duration_s", 6).alias("avg_duration_s"), F.round("median_duration_s", 6).alias("median_duration_s"), "p90_duration_s", "min_duration_s", "max_duration_s")


def _histogram(spark: SparkSession, d: str) -> DataFrame:
    return access.variant_histogram(by_session(spark, d), VARIANT).select("bin", F.round("bin_start", 6).alias("bin_start"), F.round("bin_end", 6).alias("bin_end"), "n")


def _data_quality(spark: SparkSession, d: str) -> DataFrame:
    return access.data_quality(by_user(spark, d), ["case_id", "activity", "timestamp", "cost"])


QUERIES = {
    "kpi_summary": lambda s, d: access.kpi_summary(by_user(s, d)),
    "cases_table": lambda s, d: access.cases(by_session(s, d)),
    "events_page": lambda s, d: access.events_page(by_user(s, d), sort="timestamp:desc,activity:asc", offset=20, limit=100).select("case_id", "activity", "timestamp", "seq", "cost", "has_missing"),
    "events_indexed": lambda s, d: access.indexed(by_user(s, d)).select("case_id", "seq", "row_index"),
    "filter_contains": _filtered(flt.Filter("activity", "contains", "CLI")),
    "filter_in": _filtered(flt.Filter("activity", "in", ["view", "purchase"])),
    "filter_in_empty": _filtered(flt.Filter("activity", "in", [])),
    "filter_range": _filtered(flt.Filter("cost", "gte", 10.0), flt.Filter("cost", "lte", 50.0)),
    "filter_equals": _filtered(flt.Filter("case_id", "equals", "7")),
    "filter_null": _filtered(flt.Filter("cost", "is_null"), flt.Filter("activity", "is_not_null")),
    "search_any": lambda s, d: _summary((log := by_user(s, d)).events.where(flt.search(["case_id", "activity", "props"], "view"))),
    "missing_only": lambda s, d: _summary(by_user(s, d).events.where(flt.missing(["case_id", "activity", "timestamp"]))),
    "outlier_filter": lambda s, d: _summary(flt.without_outliers(by_user(s, d).events, "cost", 3.0)),
    "column_values": lambda s, d: access.column_values(by_user(s, d), "activity"),
    "time_bounds": lambda s, d: access.time_bounds(by_user(s, d)),
    "data_quality": _data_quality,
    "activity_frequency": lambda s, d: access.activity_frequency(by_user(s, d)),
    "variants": _variant_rows,
    "variant_detail": _detail,
    "variant_histogram": _histogram,
    "variant_attributes": lambda s, d: access.variant_attributes(by_session(s, d), VARIANT, ["activity", "resource"]),
    "variant_cases": lambda s, d: access.variant_cases(by_session(s, d), VARIANT, 5, 50).select("case_id", "case_start", "case_end", "event_count"),
    "variant_coverage": lambda s, d: discovery.variant_coverage(by_session(s, d), 0.8).select("variant", "n_cases", F.round("reached_before", 9).alias("reached_before")),
    "cycle_histogram": lambda s, d: performance.cycle_histogram(by_user(s, d)),
    "log_histogram": lambda s, d: performance.log_histogram(performance.durations(by_session(s, d))),
    "activity_sojourn": lambda s, d: performance.activity_sojourn(by_user(s, d)),
    "bottlenecks": lambda s, d: performance.bottlenecks(by_user(s, d)),
    "dfg": lambda s, d: discovery.dfg(by_user(s, d)),
    "dfg_orders": lambda s, d: discovery.dfg(by_customer(s, d)),
    "dfg_nodes": lambda s, d: discovery.dfg_nodes(by_session(s, d)),
    "trace_position": lambda s, d: discovery.trace_position(by_session(s, d)),
    "prefix_tree": lambda s, d: discovery.prefix_tree(by_session(s, d)),
    "footprints": lambda s, d: discovery.footprints(by_session(s, d)),
    "transition_matrix": lambda s, d: discovery.transition_matrix(by_session(s, d), 4),
    "heuristics_edges": lambda s, d: discovery.heuristics_edges(by_session(s, d)),
    "loops_of_two": lambda s, d: discovery.loops_of_two(by_session(s, d)),
    "visible_dfg": lambda s, d: discovery.visible_dfg(by_session(s, d), 0.8, 0.3),
    "evolution": lambda s, d: evolution.evolution(by_session(s, d)),
    "activity_mix": lambda s, d: evolution.activity_mix(by_user(s, d), "week", 3),
    "dotted_ranks": lambda s, d: evolution.dotted_ranks(by_session(s, d)),
    "slices_absolute": lambda s, d: evolution.slices_absolute(by_session(s, d), 12).groupBy("slice").agg(F.count("*").alias("n_cases")),
    "slices_calendar": lambda s, d: evolution.slices_calendar(by_session(s, d), "week"),
    "slices_sliding": lambda s, d: evolution.slices_sliding(by_session(s, d), 7, 3).groupBy("slice").agg(F.count("*").alias("n_cases")),
}

_ENDPOINTS = "en AS (SELECT activity, CAST(sum(s) AS BIGINT) AS starts, CAST(sum(e) AS BIGINT) AS ends FROM (SELECT fa AS activity, 1 AS s, 0 AS e FROM tr UNION ALL SELECT la, 0, 1 FROM tr) GROUP BY activity)"
_SOJOURN = """so AS (SELECT f.activity, f.n AS frequency, round(coalesce(a, 0.0), 6) AS avg_sojourn_s, round(coalesce(p, 0.0), 6) AS p90_sojourn_s
  FROM (SELECT activity, count(*) AS n FROM ev GROUP BY activity) f
  LEFT JOIN (SELECT source, avg(seconds) AS a, quantile_cont(seconds, 0.9) AS p FROM ed WHERE seconds >= 0 GROUP BY source) x ON f.activity = x.source)"""
_DFG = """SELECT source, target, count(*) AS frequency, round(avg(seconds), 6) AS mean_s, round(median(seconds), 6) AS median_s, min(seconds) AS min_s, max(seconds) AS max_s FROM ed GROUP BY ALL"""

ORACLE_SQL = {
    "kpi_summary": f"""WITH {EV}, p AS (SELECT case_id, min(timestamp) AS a, max(timestamp) AS b, count(*) AS n, (epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 1000000.0::DOUBLE AS d FROM ev GROUP BY 1),
r AS (SELECT count(*) AS cases, CAST(sum(n) AS BIGINT) AS events, avg(d) AS m, quantile_cont(d, [0.5, 0.9, 0.95]) AS q, min(d) AS lo, max(d) AS hi, min(a) AS earliest, max(b) AS latest FROM p)
SELECT cases, events, round(m, 6) AS avg_cycle_time_s, round(q[1], 6) AS median_cycle_time_s, round(q[2], 6) AS p90_cycle_time_s, round(q[3], 6) AS p95_cycle_time_s,
 lo AS min_cycle_time_s, hi AS max_cycle_time_s, earliest, latest, round(cases * 86400.0::DOUBLE / ((epoch_us(latest) - epoch_us(earliest)) / 1000000.0::DOUBLE), 6) AS throughput_per_day FROM r""",
    "cases_table": f"WITH {SE}, {TRACES} SELECT case_id, s AS case_start, e AS case_end, d AS case_duration_seconds, n AS event_count, variant, fa AS first_activity, la AS last_activity FROM tr",
    "events_page": f"WITH {EV} SELECT case_id, activity, timestamp, seq, cost, case_id IS NULL OR activity IS NULL OR timestamp IS NULL AS has_missing FROM ev ORDER BY timestamp DESC, activity, seq LIMIT 100 OFFSET 20",
    "events_indexed": f"WITH {EV} SELECT case_id, seq, row_number() OVER (ORDER BY case_id, timestamp, seq) - 1 AS row_index FROM ev",
    "filter_contains": _filter_sql("activity ILIKE '%CLI%'"),
    "filter_in": _filter_sql("activity IN ('view', 'purchase')"),
    "filter_in_empty": _filter_sql("FALSE"),
    "filter_range": _filter_sql("cost >= 10.0 AND cost <= 50.0"),
    "filter_equals": _filter_sql("case_id = '7'"),
    "filter_null": _filter_sql("cost IS NULL AND activity IS NOT NULL"),
    "search_any": _filter_sql("case_id ILIKE '%view%' OR activity ILIKE '%view%' OR props ILIKE '%view%'"),
    "missing_only": _filter_sql("case_id IS NULL OR activity IS NULL OR timestamp IS NULL"),
    "outlier_filter": f"""WITH {EV}, m AS (SELECT median(cost) AS m FROM ev), x AS (SELECT *, abs(cost - m) AS x FROM ev, m), s AS (SELECT CASE WHEN median(x) = 0 THEN 1.0 ELSE median(x) END AS s FROM x)
SELECT count(*) AS n, count(DISTINCT case_id) AS cases, CAST(coalesce(sum(seq), 0) AS BIGINT) AS ids FROM x, s WHERE x / s < 3.0""",
    "column_values": f"WITH {EV} SELECT activity AS value, count(*) AS n, (SELECT count(DISTINCT activity) FROM ev) AS distinct_values FROM ev WHERE activity IS NOT NULL GROUP BY activity ORDER BY n DESC, value LIMIT 50",
    "time_bounds": f"WITH {EV} SELECT min(timestamp) AS min_timestamp, max(timestamp) AS max_timestamp FROM ev",
    "data_quality": f"WITH {EV} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS nulls, round(count(*) FILTER (WHERE {c} IS NULL) * 100.0::DOUBLE / count(*), 6) AS null_pct, count(DISTINCT {c}) AS distinct_values FROM ev"
        for c in ("case_id", "activity", "timestamp", "cost")
    ),
    "activity_frequency": f"WITH {EV} SELECT activity, count(*) AS n FROM ev GROUP BY activity",
    "variants": f"""WITH {SE}, {TRACES}, v AS (SELECT variant, count(*) AS n_cases, avg(d) AS a, median(d) AS m, min(s) AS first_seen, max(e) AS last_seen FROM tr GROUP BY variant)
SELECT variant, n_cases, round(a, 6) AS avg_duration_s, round(m, 6) AS median_duration_s, first_seen, last_seen, round(n_cases / CAST(sum(n_cases) OVER () AS DOUBLE), 9) AS share, row_number() OVER (ORDER BY n_cases DESC, variant) AS rank FROM v""",
    "variant_detail": f"""WITH {SE}, {TRACES}, x AS (SELECT * FROM tr WHERE variant = '{VARIANT}'), l AS (SELECT variant, count(*) AS n, avg(d) AS a, median(d) AS m, list(d ORDER BY d) AS ds FROM x GROUP BY variant)
SELECT variant, n AS n_cases, round(a, 6) AS avg_duration_s, round(m, 6) AS median_duration_s, ds[least(CAST(floor(n * 0.9::DOUBLE) AS BIGINT) + 1, n)] AS p90_duration_s, ds[1] AS min_duration_s, ds[n] AS max_duration_s FROM l""",
    "variant_histogram": f"""WITH {SE}, {TRACES}, x AS (SELECT d FROM tr WHERE variant = '{VARIANT}'), b AS (SELECT min(d) AS lo, max(d) AS hi FROM x),
f AS (SELECT CASE WHEN hi <= lo THEN 0 ELSE least(CAST(floor((d - lo) / ((hi - lo) / 12.0::DOUBLE)) AS BIGINT), 11) END AS bin, count(*) AS n FROM x, b GROUP BY 1),
g AS (SELECT lo, hi, CASE WHEN hi > lo THEN 12 ELSE 1 END AS k, unnest(range(0, CASE WHEN hi > lo THEN 12 ELSE 1 END)) AS bin FROM b WHERE lo IS NOT NULL)
SELECT CAST(g.bin AS INTEGER) AS bin, round(lo + g.bin * ((hi - lo) / k), 6) AS bin_start, round(lo + (g.bin + 1) * ((hi - lo) / k), 6) AS bin_end, coalesce(n, 0) AS n FROM g LEFT JOIN f ON g.bin = f.bin""",
    "variant_attributes": f"""WITH {SE}, {TRACES}, x AS (SELECT ev.* FROM ev SEMI JOIN (SELECT case_id FROM tr WHERE variant = '{VARIANT}') c ON ev.case_id = c.case_id),
l AS (SELECT 'activity' AS "column", activity AS value, count(*) AS n FROM x GROUP BY ALL UNION ALL SELECT 'resource', resource, count(*) FROM x GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS rank FROM l QUALIFY row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) <= 5""",
    "variant_cases": f"WITH {SE}, {TRACES} SELECT case_id, s AS case_start, e AS case_end, n AS event_count FROM tr WHERE variant = '{VARIANT}' ORDER BY s DESC NULLS LAST, case_id LIMIT 50 OFFSET 5",
    "variant_coverage": f"""WITH {SE}, {TRACES}, v AS (SELECT variant, count(*) AS n_cases FROM tr GROUP BY variant),
c AS (SELECT *, coalesce(sum(n_cases) OVER (ORDER BY n_cases DESC, variant ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE / sum(n_cases) OVER () AS r FROM v)
SELECT variant, n_cases, round(r, 9) AS reached_before FROM c WHERE r < 0.8""",
    "cycle_histogram": f"""WITH {EV}, {TRACES}, b AS (SELECT min(d) AS lo, max(d) AS hi FROM tr),
x AS (SELECT least(coalesce(CAST(50.0::DOUBLE * (d - lo) / nullif(hi - lo, 0.0) AS INTEGER), 0), 49) AS bucket, lo, hi, count(*) AS n FROM tr, b GROUP BY ALL)
SELECT bucket, round(lo + bucket * ((hi - lo) / 50.0::DOUBLE), 6) AS bucket_start, round(lo + (bucket + 1) * ((hi - lo) / 50.0::DOUBLE), 6) AS bucket_end, n FROM x""",
    "log_histogram": f"""WITH {SE}, {TRACES}, v AS (SELECT d FROM tr WHERE d > 0), b AS (SELECT min(d) AS lo, max(d) AS hi, (ln(max(d)) - ln(min(d))) / 24.0::DOUBLE AS w FROM v),
f AS (SELECT CASE WHEN hi <= lo THEN 0 ELSE least(CAST(floor((ln(d) - ln(lo)) / w) AS BIGINT), 23) END AS bucket, count(*) AS n FROM v, b GROUP BY 1),
g AS (SELECT lo, w, unnest(range(0, CASE WHEN hi > lo THEN 24 ELSE 1 END)) AS bucket FROM b WHERE lo IS NOT NULL)
SELECT CAST(g.bucket AS INTEGER) AS bucket, round(lo * exp(g.bucket * w), 3) AS bucket_start, round(lo * exp((g.bucket + 1) * w), 3) AS bucket_end, coalesce(n, 0) AS n FROM g LEFT JOIN f ON g.bucket = f.bucket""",
    "activity_sojourn": f"WITH {EV}, {EDGES}, {_SOJOURN} SELECT * FROM so",
    "bottlenecks": f"""WITH {EV}, {EDGES}, {_SOJOURN}, q AS (SELECT quantile_cont(avg_sojourn_s, [0.25, 0.5, 0.75]) AS q, sum(avg_sojourn_s * frequency) AS total FROM so)
SELECT activity, frequency, avg_sojourn_s, p90_sojourn_s, round(CASE WHEN total > 0 THEN avg_sojourn_s * frequency / total ELSE 0.0 END, 6) AS share_of_total_time,
 avg_sojourn_s > 0 AND avg_sojourn_s >= CASE WHEN q[3] - q[1] = 0 THEN q[2] ELSE q[2] + 1.5 * (q[3] - q[1]) END AS is_bottleneck, row_number() OVER (ORDER BY avg_sojourn_s DESC, activity) AS rank FROM so, q""",
    "dfg": f"WITH {EV}, {EDGES} {_DFG}",
    "dfg_orders": f"WITH {CU}, {EDGES} {_DFG}",
    "dfg_nodes": f"""WITH {SE}, {EDGES}, {TRACES}, {_ENDPOINTS}, o AS (SELECT source, count(*) AS n FROM ed GROUP BY source)
SELECT a.activity, greatest(coalesce(n, 0), coalesce(starts, 0), coalesce(ends, 0)) AS frequency, coalesce(starts, 0) AS starts, coalesce(ends, 0) AS ends
FROM (SELECT DISTINCT activity FROM ev) a LEFT JOIN o ON a.activity = o.source LEFT JOIN en ON a.activity = en.activity""",
    "trace_position": f"""WITH {SE}, x AS (SELECT activity, row_number() OVER (PARTITION BY case_id ORDER BY timestamp, seq) AS p, count(*) OVER (PARTITION BY case_id) AS n FROM ev)
SELECT activity, round(avg(CASE WHEN n > 1 THEN (p - 1) / CAST(n - 1 AS DOUBLE) ELSE 0.0 END), 6) AS mean_position FROM x GROUP BY activity""",
    "prefix_tree": f"""WITH {SE}, t AS (SELECT case_id, list(activity ORDER BY timestamp, seq) AS a FROM ev GROUP BY case_id), p AS (SELECT a, unnest(range(1, len(a) + 1)) AS k FROM t)
SELECT array_to_string(a[1:k], '→') AS prefix, CASE WHEN k = 1 THEN '' ELSE array_to_string(a[1:k-1], '→') END AS parent, a[k] AS label, CAST(k AS INTEGER) AS depth, count(*) AS frequency, count(*) FILTER (WHERE k = len(a)) AS ends FROM p GROUP BY ALL""",
    "footprints": f"""WITH {SE}, {EDGES}, {TRACES}, {_ENDPOINTS}, e AS (SELECT DISTINCT source, target FROM ed)
SELECT CASE WHEN EXISTS (SELECT 1 FROM e b WHERE b.source = e.target AND b.target = e.source) THEN 'parallel' ELSE 'directly_follows' END AS relation, source, target FROM e
UNION ALL SELECT 'start', activity, NULL FROM en WHERE starts > 0 UNION ALL SELECT 'end', activity, NULL FROM en WHERE ends > 0""",
    "transition_matrix": f"""WITH {SE}, {EDGES}, k AS (SELECT activity FROM (SELECT activity, count(*) AS n FROM ev GROUP BY activity ORDER BY n DESC, activity LIMIT 4)),
c AS (SELECT source, target, count(*) AS n FROM ed WHERE source IN (SELECT activity FROM k) AND target IN (SELECT activity FROM k) GROUP BY ALL)
SELECT source, target, round(n / CAST(sum(n) OVER (PARTITION BY source) AS DOUBLE), 4) AS probability FROM c""",
    "heuristics_edges": f"""WITH {SE}, {EDGES}, c AS (SELECT source, target, count(*) AS n FROM ed GROUP BY ALL), x AS (
SELECT c.source, c.target, c.n AS frequency, round(CASE WHEN c.source = c.target THEN c.n / CAST(c.n + 1 AS DOUBLE) ELSE (c.n - coalesce(b.n, 0)) / CAST(c.n + coalesce(b.n, 0) + 1 AS DOUBLE) END, 6) AS dependency
FROM c LEFT JOIN c b ON c.source = b.target AND c.target = b.source) SELECT *, dependency >= 0.5 AS kept FROM x""",
    "loops_of_two": f"""WITH {SE}, x AS (SELECT activity AS a, lead(activity) OVER w AS b, lead(activity, 2) OVER w AS c FROM ev WINDOW w AS (PARTITION BY case_id ORDER BY timestamp, seq)),
y AS (SELECT a, b, count(*) AS n FROM x WHERE a = c AND a <> b GROUP BY ALL)
SELECT y.a, y.b, y.n AS frequency, round((y.n + coalesce(z.n, 0)) / CAST(y.n + coalesce(z.n, 0) + 1 AS DOUBLE), 6) AS dependency FROM y LEFT JOIN y z ON y.a = z.b AND y.b = z.a""",
    "evolution": f"""WITH {SE}, {TRACES}, c AS (SELECT unnest(generate_series(date_trunc('day', (SELECT min(s) FROM tr)), date_trunc('day', (SELECT max(e) FROM tr)), INTERVAL 1 DAY)) AS period),
a AS (SELECT date_trunc('day', s) AS p, count(*) AS n FROM tr GROUP BY 1), z AS (SELECT date_trunc('day', e) AS p, count(*) AS n FROM tr GROUP BY 1), v AS (SELECT date_trunc('day', timestamp) AS p, count(*) AS n FROM ev GROUP BY 1)
SELECT CAST(period AS TIMESTAMP) AS period, coalesce(a.n, 0) AS arrivals, coalesce(z.n, 0) AS completions, coalesce(v.n, 0) AS events, CAST(sum(coalesce(a.n, 0) - coalesce(z.n, 0)) OVER (ORDER BY period) AS BIGINT) AS wip
FROM c LEFT JOIN a ON a.p = period LEFT JOIN z ON z.p = period LEFT JOIN v ON v.p = period""",
    "activity_mix": f"""WITH {EV}, n AS (SELECT activity, CASE WHEN row_number() OVER (ORDER BY count(*) DESC, activity) <= 3 THEN activity ELSE 'Other' END AS label FROM ev GROUP BY activity),
c AS (SELECT unnest(generate_series(date_trunc('week', (SELECT min(timestamp) FROM ev)), date_trunc('week', (SELECT max(timestamp) FROM ev)), INTERVAL 7 DAY)) AS period),
x AS (SELECT date_trunc('week', timestamp) AS p, label, count(*) AS n FROM ev JOIN n ON ev.activity = n.activity GROUP BY ALL)
SELECT CAST(period AS TIMESTAMP) AS period, l.label, coalesce(x.n, 0) AS n FROM c CROSS JOIN (SELECT DISTINCT label FROM n) l LEFT JOIN x ON x.p = period AND x.label = l.label""",
    "dotted_ranks": f"WITH {SE}, {TRACES} SELECT case_id, row_number() OVER (ORDER BY s, case_id) - 1 AS y FROM tr",
    "slices_absolute": f"""WITH {SE}, {TRACES}, b AS (SELECT min(s) AS lo, max(s) AS hi FROM tr)
SELECT CAST(CASE WHEN hi <= lo THEN 0 ELSE greatest(CAST(ceil(((epoch_us(s) - epoch_us(lo)) / 1000000.0::DOUBLE) / ((epoch_us(hi) - epoch_us(lo)) / 1000000.0::DOUBLE) * 12) AS BIGINT) - 1, 0) END AS INTEGER) AS slice, count(*) AS n_cases FROM tr, b GROUP BY 1""",
    "slices_calendar": f"""WITH {SE}, {TRACES}, c AS (SELECT unnest(generate_series(date_trunc('week', (SELECT min(s) FROM tr)), date_trunc('week', (SELECT max(s) FROM tr)), INTERVAL 7 DAY)) AS p), x AS (SELECT date_trunc('week', s) AS p, count(*) AS n FROM tr GROUP BY 1)
SELECT CAST(c.p AS TIMESTAMP) AS slice, coalesce(n, 0) AS n_cases FROM c LEFT JOIN x ON c.p = x.p""",
    "slices_sliding": f"""WITH {SE}, {TRACES}, b AS (SELECT min(s) AS lo, max(s) AS hi FROM tr), w AS (SELECT unnest(generate_series(lo, hi, INTERVAL 3 DAY)) AS ws, lo FROM b)
SELECT CAST((epoch_us(ws) - epoch_us(lo)) // 259200000000 AS INTEGER) AS slice, count(*) AS n_cases FROM tr JOIN w ON s >= ws AND s < ws + INTERVAL 7 DAY GROUP BY 1""",
}
