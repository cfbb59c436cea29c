"""Agent, page and usage queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseweave.operators import agents, discovery, simulation, usage
from caseweave.plans.tables import EDGES, EV, SE, TRACES, by_parity, by_session, by_user, table, usage_events


def _jobs(spark: SparkSession, d: str) -> DataFrame:
    """Orders as jobs of a status."""
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))


def _sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions as jobs of their first event's type, from first to last event."""
    rows = usage_events(spark, d).groupBy("session_id")
    return rows.agg(F.min(F.struct("occurred_at", "event_type"))["event_type"].alias("kind"), F.min("occurred_at").alias("started_at"), F.max("occurred_at").alias("finished_at"))


QUERIES = {
    "padded_log": lambda s, d: agents.padded(by_session(s, d)).select("case_id", "activity", "timestamp", "seq"),
    "resource_codes": lambda s, d: agents.resource_codes(by_session(s, d)),
    "events_with_ends": lambda s, d: agents.with_ends(by_user(s, d)).events.groupBy("activity").agg(F.count("*").alias("n"), F.max("end_timestamp").alias("last_end")),
    "interaction_net": lambda s, d: agents.interaction_net(by_session(s, d)),
    "agent_prefix_next": lambda s, d: agents.agent_prefix_next(by_session(s, d), 3),
    "agent_transitions": lambda s, d: simulation.agent_transitions(by_user(s, d), "activity"),
    "resource_profiles": lambda s, d: simulation.resource_profiles(by_session(s, d)),
    "weekday_runs": lambda s, d: agents.weekday_runs(by_session(s, d)),
    "simulation_summary": lambda s, d: agents.simulation_summary(by_session(s, d), list(by_parity(s, d).values())),
    "representative_case": lambda s, d: agents.representative(by_session(s, d), "purchase"),
    "dfg_total": lambda s, d: discovery.edge_total(by_session(s, d)),
    "usage_preview": lambda s, d: usage.preview(usage_events(s, d)),
    "usage_summary": lambda s, d: usage.summary(usage_events(s, d)),
    "usage_filtered": lambda s, d: usage.preview(usage.matching(usage_events(s, d), prefix="P", start=datetime(2024, 1, 5), end=datetime(2024, 1, 20))),
    "job_statuses": lambda s, d: usage.statuses(_jobs(s, d), ("O", "P")),
    "job_durations": lambda s, d: usage.durations(_sessions(s, d), "kind"),
}

_PREVIEW = "count(*) AS events, count(DISTINCT user_id) AS users, count(DISTINCT session_id) AS sessions, count(DISTINCT event_type) AS types, min(occurred_at) AS earliest, max(occurred_at) AS latest"
_US = "us AS (SELECT user_id, CAST(user_id AS VARCHAR) || '-' || CAST(CAST(ts AS DATE) AS VARCHAR) AS session_id, event_type, ts AS occurred_at FROM events)"

ORACLE_SQL = {
    "padded_log": f"WITH {SE} SELECT case_id, activity, timestamp, seq FROM ev UNION ALL SELECT case_id, 'zzz_end', max(timestamp), arg_max(seq, struct_pack(t := timestamp, q := seq)) FROM ev GROUP BY case_id",
    "resource_codes": f"WITH {SE}, f AS (SELECT coalesce(resource, 'undefined') AS resource, min(struct_pack(t := timestamp, q := seq)) AS a FROM ev GROUP BY 1) SELECT resource, CAST(row_number() OVER (ORDER BY a, resource) - 1 AS INTEGER) AS code FROM f",
    "events_with_ends": f"WITH {EV} SELECT activity, count(*) AS n, max(timestamp) AS last_end FROM ev GROUP BY activity",
    "interaction_net": f"""WITH {SE}, x AS (SELECT lag(resource, 1, '-1') OVER (PARTITION BY case_id ORDER BY timestamp, seq) AS source, resource AS target FROM ev), c AS (SELECT source, target, count(*) AS n FROM x GROUP BY ALL)
SELECT *, round(n / CAST(sum(n) OVER (PARTITION BY source) AS DOUBLE), 6) AS probability FROM c""",
    "agent_prefix_next": f"""WITH {SE}, l AS (SELECT list(activity ORDER BY timestamp, seq) AS a, list(resource ORDER BY timestamp, seq) AS r FROM ev GROUP BY case_id), e AS (SELECT a, r, unnest(range(1, len(a))) AS e FROM l), x AS (SELECT *, unnest(range(1, least(e, 3) + 1)) AS k FROM e),
c AS (SELECT array_to_string(a[e-k+1:e], '→') AS prefix, r[e] AS agent, a[e + 1] AS next_activity, count(*) AS n FROM x GROUP BY ALL) SELECT *, round(n / CAST(sum(n) OVER (PARTITION BY prefix, agent) AS DOUBLE), 6) AS probability FROM c""",
    "agent_transitions": f"""WITH {EV}, {EDGES}, c AS (SELECT source AS activity, target AS next_activity, source, target, count(*) AS n FROM ed GROUP BY ALL)
SELECT *, round(n / CAST(sum(n) OVER (PARTITION BY activity, next_activity, source) AS DOUBLE), 6) AS probability FROM c""",
    "resource_profiles": f"WITH {SE} SELECT resource, activity, count(*) AS n FROM ev GROUP BY ALL",
    "weekday_runs": f"""WITH {SE}, {TRACES}, d AS (SELECT CAST(s AS DATE) AS day, count(*) AS n, CAST(dayofweek(CAST(s AS DATE)) AS INTEGER) AS weekday FROM tr GROUP BY ALL), o AS (SELECT *, CASE WHEN lag(weekday) OVER (ORDER BY day) = weekday THEN 0 ELSE 1 END AS o FROM d),
i AS (SELECT *, sum(o) OVER (ORDER BY day) AS run FROM o), r AS (SELECT run, weekday, sum(n) AS n FROM i GROUP BY ALL), c AS (SELECT weekday, CASE WHEN run < max(run) OVER () THEN n END AS n FROM r)
SELECT weekday, count(n) AS runs, round(avg(n), 6) AS mean_cases, round(stddev_pop(n), 6) AS std_cases FROM c GROUP BY weekday""",
    "simulation_summary": f"""WITH {SE}, p AS (SELECT count(DISTINCT case_id) AS c, count(*) AS n FROM ev GROUP BY user_id % 2)
SELECT count(DISTINCT case_id) AS cases, count(*) AS events, count(DISTINCT activity) AS activities, count(DISTINCT resource) AS resources, (SELECT round(avg(c), 6) FROM p) AS sim_cases, (SELECT round(avg(n), 6) FROM p) AS sim_events FROM ev""",
    "representative_case": f"""WITH {SE}, h AS (SELECT case_id FROM ev WHERE activity = 'purchase' ORDER BY timestamp, seq LIMIT 1)
SELECT case_id, CAST(row_number() OVER (ORDER BY timestamp, seq) AS INTEGER) AS pos, activity, timestamp FROM ev WHERE case_id IN (SELECT case_id FROM h) QUALIFY pos <= 8""",
    "dfg_total": f"WITH {SE}, {EDGES} SELECT count(*) AS total, (SELECT count(*) - count(DISTINCT case_id) FROM ev) AS expected FROM ed",
    "usage_preview": f"WITH {_US} SELECT {_PREVIEW} FROM us",
    "usage_summary": f"WITH {_US} SELECT event_type, count(*) AS n, min(occurred_at) AS first_seen, max(occurred_at) AS last_seen FROM us GROUP BY event_type",
    "usage_filtered": f"WITH {_US} SELECT {_PREVIEW} FROM us WHERE event_type ILIKE 'P%' AND occurred_at >= TIMESTAMP '2024-01-05' AND occurred_at < TIMESTAMP '2024-01-20'",
    "job_statuses": "SELECT o_orderstatus AS status, count(*) AS n, o_orderstatus IN ('O', 'P') AS active FROM orders GROUP BY o_orderstatus",
    "job_durations": f"""WITH {_US}, s AS (SELECT arg_min(event_type, struct_pack(t := occurred_at, e := event_type)) AS kind, (epoch_us(max(occurred_at)) - epoch_us(min(occurred_at))) / 1000000.0::DOUBLE AS d FROM us GROUP BY session_id)
SELECT kind, count(*) AS jobs, round(avg(d), 6) AS avg_s, max(d) AS max_s FROM s GROUP BY kind""",
}
