"""Constraint series and their changes, norms between windows, tests on logs and measurements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseweave.operators import drift, series, statistics
from caseweave.plans.tables import EV, SE, by_parity, by_session, by_user, table

WINDOWS = 20


def _runs(spark: SparkSession, d: str) -> DataFrame:
    """Mean value of each kind of event (an experiment) on each day (a run)."""
    rows = table(spark, d, "events").where("value is not null")
    return rows.groupBy(F.lit("value").alias("metric"), F.col("event_type").alias("experiment"), F.to_date("ts").cast("string").alias("run")).agg(F.avg(F.col("value").cast("double")).alias("value"))


def _clusters(spark: SparkSession, d: str) -> DataFrame:
    return series.clusters(series.response_series(by_user(spark, d), WINDOWS), 100.0)


def _changes(spark: SparkSession, d: str) -> DataFrame:
    rows = series.response_series(by_user(spark, d), WINDOWS)
    return series.change_points(rows, series.clusters(rows, 100.0))


def _paired(spark: SparkSession, d: str) -> DataFrame:
    rows = statistics.paired_tests(_runs(spark, d))
    return rows.select("metric", "a", "b", "n", F.round("t", 6).alias("t"))


QUERIES = {
    "response_series": lambda s, d: series.response_series(by_session(s, d), WINDOWS),
    "constraint_clusters": _clusters,
    "change_points": _changes,
    "drift_norms": lambda s, d: drift.drift_norms(by_session(s, d), WINDOWS),
    "drift_exact_norms": lambda s, d: drift.drift_norms(by_session(s, d), WINDOWS, ("fro", "inf", "cos")),
    "control_flow_distance": lambda s, d: statistics.control_flow_distance(*by_parity(s, d).values()),
    "timed_flow_distance": lambda s, d: statistics.control_flow_distance(*by_parity(s, d).values(), timed=True),
    "permutation_test": lambda s, d: statistics.permutation_test(*by_parity(s, d).values()),
    "bootstrap_test": lambda s, d: statistics.bootstrap_test(*by_parity(s, d).values()),
    "paired_tests": _paired,
    "paired_ranks": lambda s, d: statistics.ranks(_runs(s, d)),
}

_WIN = (
    "st AS (SELECT case_id, row_number() OVER (ORDER BY min(timestamp), case_id) AS k, count(*) OVER () AS n FROM ev GROUP BY case_id), "
    f"wn AS (SELECT case_id, CAST(least((k - 1) // greatest(n // {WINDOWS}, 1), {WINDOWS - 1}) AS INTEGER) AS w FROM st)"
)
_FLOW = """sq AS (SELECT user_id % 2 AS odd, case_id, activity, timestamp, lead(activity) OVER w AS nxt, lead(timestamp) OVER w AS nts, row_number() OVER w AS pos FROM ev WINDOW w AS (PARTITION BY case_id ORDER BY timestamp, seq)),
ft AS (SELECT odd, activity || '→' || coalesce(nxt, '⊥') || {power} AS f FROM sq UNION ALL SELECT odd, '⊤→' || activity FROM sq WHERE pos = 1),
ct AS (SELECT f, count(*) FILTER (odd = 0) AS a, count(*) FILTER (odd = 1) AS b FROM ft GROUP BY f)
SELECT round(sum(abs(a / (SELECT sum(a) FROM ct)::DOUBLE - b / (SELECT sum(b) FROM ct)::DOUBLE)) / 2, 9) AS distance FROM ct"""

ORACLE_SQL = {
    "response_series": f"""WITH {SE}, {_WIN}, p AS (SELECT case_id, activity, row_number() OVER (PARTITION BY case_id ORDER BY timestamp, seq) AS pos FROM ev), q AS (SELECT p.*, w FROM p JOIN wn USING (case_id)),
l AS (SELECT case_id, activity AS b, max(pos) AS last FROM p GROUP BY ALL), m AS (SELECT w, activity AS a, b, count(*) AS n FROM q JOIN l USING (case_id) WHERE last > pos GROUP BY ALL), t AS (SELECT w, activity AS a, count(*) AS total FROM q GROUP BY ALL),
g AS (SELECT a, b, unnest(generate_series(0, {WINDOWS - 1})) AS w FROM (SELECT DISTINCT a, b FROM m))
SELECT a || '→' || b AS "constraint", CAST(g.w AS INTEGER) AS pos, coalesce(round(100.0 * n::DOUBLE / total, 6), 0.0::DOUBLE) AS value FROM g LEFT JOIN m USING (a, b, w) LEFT JOIN t USING (a, w)""",
    "drift_exact_norms": f"""WITH {SE}, {_WIN}, ed AS (SELECT * FROM (SELECT case_id, activity AS a, lead(activity) OVER x AS b, lead(seq) OVER x AS s FROM ev WINDOW x AS (PARTITION BY case_id ORDER BY timestamp, seq)) WHERE s IS NOT NULL),
f AS (SELECT w, a, b, count(*) AS n FROM ed JOIN wn USING (case_id) GROUP BY ALL), g AS (SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j FROM range({WINDOWS}) x(i), range({WINDOWS}) y(j) WHERE i < j),
c AS (SELECT i, j, e.a, e.b, coalesce(x.n, 0)::DOUBLE AS x, coalesce(y.n, 0)::DOUBLE AS y FROM g CROSS JOIN (SELECT DISTINCT a, b FROM f) e LEFT JOIN f x ON x.w = i AND x.a = e.a AND x.b = e.b LEFT JOIN f y ON y.w = j AND y.a = e.a AND y.b = e.b),
r AS (SELECT i, j, a, sum(abs(x - y)) AS s FROM c GROUP BY ALL), d AS (SELECT i, j, sqrt(sum((x - y) * (x - y))) AS fro, sqrt(sum(x * x)) * sqrt(sum(y * y)) AS size, sum(x * y) AS dot FROM c GROUP BY ALL), m AS (SELECT i, j, max(s) AS inf FROM r GROUP BY ALL)
SELECT i, j, 'fro' AS norm, round(fro, 6) AS distance FROM d UNION ALL SELECT i, j, 'inf', round(inf, 6) FROM m UNION ALL SELECT i, j, 'cos', round(CASE WHEN size > 0 THEN 1 - dot / size ELSE fro END, 6) FROM d""",
    "control_flow_distance": f"WITH {SE}, " + _FLOW.format(power="''"),
    "timed_flow_distance": f"WITH {SE}, " + _FLOW.format(power="coalesce('→' || CAST(CAST(floor(log2(1.0 + greatest(date_sub('second', timestamp, nts), 0))) AS INTEGER) AS VARCHAR), '→')"),
    "paired_tests": """WITH v AS (SELECT event_type AS e, CAST(ts AS DATE) AS day, avg(value::DOUBLE) AS v FROM events WHERE value IS NOT NULL GROUP BY ALL), m AS (SELECT e, avg(v) AS m FROM v GROUP BY e), w AS (SELECT v.*, m FROM v JOIN m USING (e)),
p AS (SELECT x.e AS a, y.e AS b, x.v - y.v AS d FROM w x JOIN w y ON x.day = y.day AND (x.m, x.e) < (y.m, y.e))
SELECT 'value' AS metric, a, b, count(*) AS n, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 6) AS t FROM p GROUP BY a, b""",
}
