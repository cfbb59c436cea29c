"""Object-centric, comparison, complexity, drift, simulation and usage queries."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseweave.operators import access, compare, complexity, drift, evolution, metric_series, miners, ocel, resources, simulation, usage
from caseweave.plans.tables import EDGES, EV, OC, SE, TRACES, by_parity, by_session, by_session_timed, by_user, object_log, table, usage_events

QUERY_VECTOR = [((k * 37) % 19 - 9) / 10.0 for k in range(64)]
NOW = date(2024, 1, 31)


def _topk(spark: SparkSession, d: str) -> DataFrame:
    return drift.vector_topk(table(spark, d, "embeddings"), QUERY_VECTOR, 20)


def _rerank(spark: SparkSession, d: str) -> DataFrame:
    hits = drift.vector_topk(table(spark, d, "embeddings"), QUERY_VECTOR, 50).withColumn("specificity", (F.col("vec_id") % 10) / 10.0)
    return drift.rerank(hits, "label", "specificity", "score").select("vec_id", "label", "score", "rank_score")


def _wasserstein(spark: SparkSession, d: str) -> DataFrame:
    logs = by_parity(spark, d)
    hours = {k: log.events.select(F.hour("timestamp").alias("h")) for k, log in logs.items()}
    cycle = {k: log.traces().select((F.col("duration_s") / 3600.0).alias("h")) for k, log in logs.items()}
    rows = [compare.wasserstein(x["a"], x["b"], "h").select(F.lit(m).alias("metric"), "distance") for m, x in (("circadian", hours), ("cycle_time", cycle))]
    return rows[0].unionByName(rows[1])


def _calendar(spark: SparkSession) -> DataFrame:
    """Monday to Friday, nine to five with a break."""
    rows = [(d, a, b) for d in range(1, 6) for a, b in ((32_400, 43_200), (46_800, 61_200))]
    return spark.createDataFrame(rows, "weekday int, begin_s int, end_s int")


def _banded(spark: SparkSession, d: str):
    log = by_session(spark, d)
    return complexity.enriched(type(log)(log.df.withColumn("band", F.floor(F.col("cost") / 50.0))), ["band"])


QUERIES = {
    "enriched_entropy": lambda s, d: complexity.epa_entropy(_banded(s, d)),
    "drift_frobenius": lambda s, d: drift.drift_frobenius(by_session(s, d), 20),
    "concurrency": lambda s, d: resources.concurrency(by_session_timed(s, d)),
    "in_calendar": lambda s, d: resources.in_calendar(by_session_timed(s, d).events, _calendar(s)).groupBy("activity", "inside").agg(F.count("*").alias("n")),
    "working_seconds": lambda s, d: resources.working_seconds(by_session_timed(s, d).events, _calendar(s)),
    "resource_calendars": lambda s, d: resources.calendars(by_session(s, d), support=0.3, least=100),
    "delays": lambda s, d: resources.delays(by_session_timed(s, d)),
    "activity_delays": lambda s, d: resources.activity_delays(by_session_timed(s, d)),
    "duration_fit": lambda s, d: resources.fit_distributions(by_session(s, d).edges(), "source", "seconds"),
    "inductive_net": lambda s, d: miners.inductive_net(by_session(s, d), 0.2),
    "variant_ids": lambda s, d: access.variant_ids(by_session(s, d)),
    "ocel_overview": lambda s, d: ocel.overview(object_log(s, d)),
    "ocel_types": lambda s, d: ocel.type_counts(object_log(s, d)),
    "ocel_page": lambda s, d: ocel.object_page(object_log(s, d), "supplier", "1", 2, 20),
    "ocel_matrix": lambda s, d: ocel.activity_types(object_log(s, d)),
    "ocel_lifecycle": lambda s, d: ocel.lifecycle(object_log(s, d)),
    "ocel_longest": lambda s, d: ocel.longest_lived(object_log(s, d)),
    "ocel_interaction": lambda s, d: ocel.interaction_graph(object_log(s, d)),
    "ocel_degree": lambda s, d: ocel.interaction_degree(object_log(s, d)),
    "ocel_cobirth": lambda s, d: ocel.object_graph(object_log(s, d), "cobirth"),
    "ocel_codeath": lambda s, d: ocel.object_graph(object_log(s, d), "codeath"),
    "ocel_descendants": lambda s, d: ocel.object_graph(object_log(s, d), "descendants"),
    "ocel_inheritance": lambda s, d: ocel.object_graph(object_log(s, d), "inheritance"),
    "ocel_variable_arcs": lambda s, d: ocel.variable_arcs(object_log(s, d)),
    "ocdfg_edges": lambda s, d: ocel.ocdfg_edges(object_log(s, d)),
    "ocdfg_endpoints": lambda s, d: ocel.ocdfg_endpoints(object_log(s, d)),
    "dfg_diff": lambda s, d: compare.dfg_diff(*by_parity(s, d).values()),
    "variant_diff": lambda s, d: compare.variant_diff(by_parity(s, d)).select("variant", "n_a", "n_b", F.round("share_a", 9).alias("share_a"), F.round("share_b", 9).alias("share_b"), F.round("max_delta", 9).alias("max_delta"), "rank"),
    "activity_deltas": lambda s, d: compare.activity_deltas(*by_parity(s, d).values()),
    "similarity_jaccard": lambda s, d: compare.similarity_jaccard(by_parity(s, d)),
    "wasserstein_hours": _wasserstein,
    "ngram_tv": lambda s, d: compare.ngram_tv(*by_parity(s, d).values()),
    "handover_matrix": lambda s, d: compare.handover_matrix(by_user(s, d), "activity", 4),
    "circadian": lambda s, d: compare.circadian(by_parity(s, d)),
    "arrivals_compare": lambda s, d: compare.arrivals(by_parity(s, d)),
    "cycle_time_bins": lambda s, d: compare.cycle_time_bins(by_parity(s, d)),
    "fidelity_self": lambda s, d: compare.fidelity((log := by_session(s, d)), [log]),
    "emd": lambda s, d: miners.emd(*by_parity(s, d).values()),
    "size_metrics": lambda s, d: complexity.size_metrics(by_session(s, d)),
    "order_variation": lambda s, d: complexity.order_variation(by_session(s, d)),
    "structure": lambda s, d: complexity.structure(by_session(s, d)),
    "time_granularity": lambda s, d: complexity.time_granularity(by_session(s, d)),
    "n_ties": lambda s, d: complexity.n_ties(by_session(s, d)),
    "affinity": lambda s, d: complexity.affinity(by_session(s, d)),
    "edit_distance": lambda s, d: complexity.edit_distance(by_session(s, d)),
    "epa_entropy": lambda s, d: complexity.epa_entropy(by_session(s, d)),
    "epa_entropy_forgetting": lambda s, d: complexity.epa_entropy_forgetting(by_session(s, d)),
    "lempel_ziv": lambda s, d: complexity.lempel_ziv(by_user(s, d)),
    "structural_variety": lambda s, d: complexity.structural_variety(by_session(s, d)),
    "drift_windows": lambda s, d: drift.drift_windows(by_session(s, d), 20),
    "drift_similarity": lambda s, d: drift.drift_similarity(by_session(s, d), 20),
    "dominant_activity": lambda s, d: drift.dominant_activity(by_user(s, d), 30),
    "drift_starts": lambda s, d: drift.sliding_windows(by_session(s, d)),
    "vector_topk": _topk,
    "rerank": _rerank,
    "text_chunks": lambda s, d: drift.chunks(table(s, d, "documents")).groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum(F.length("chunk")).cast("bigint").alias("chars"), F.md5(F.max_by("chunk", "chunk_no")).alias("last_md5")),
    "prerequisites": lambda s, d: simulation.prerequisites(by_session(s, d)),
    "zero_waiting": lambda s, d: simulation.zero_waiting(by_session(s, d)),
    "start_distribution": lambda s, d: simulation.start_distribution(by_session(s, d)),
    "interarrival": lambda s, d: simulation.interarrival(by_session(s, d)),
    "weekday_arrivals": lambda s, d: simulation.weekday_arrivals(by_session(s, d)),
    "prefix_next": lambda s, d: simulation.prefix_next(by_session(s, d), 3),
    "agent_activities": lambda s, d: simulation.agent_activities(by_session(s, d)),
    "max_activity_count": lambda s, d: simulation.max_activity_count(by_session(s, d)),
    "overlap_pairs": lambda s, d: simulation.overlap_pairs(by_session_timed(s, d), 0.2),
    "enabling_event": lambda s, d: simulation.enabling_event(by_session_timed(s, d)),
    "resource_previous_end": lambda s, d: simulation.resource_previous_end(by_session_timed(s, d)),
    "resource_roles": lambda s, d: simulation.resource_roles(by_session(s, d)),
    "weekly_calendar": lambda s, d: simulation.weekly_calendar(by_session(s, d)),
    "train_test_split": lambda s, d: simulation.split_by_time(by_session(s, d)).groupBy("part").agg(F.count("*").alias("events"), F.count_distinct("case_id").alias("cases")),
    "simulated_log": lambda s, d: simulation.simulate(by_session(s, d), 200).groupBy("activity").agg(F.count("*").alias("n")),
    "alpha_net": lambda s, d: miners.alpha(by_session(s, d)),
    "inductive_tree": lambda s, d: miners.inductive(by_session(s, d), 0.2),
    "heuristics_net": lambda s, d: miners.heuristics(by_session(s, d)),
    "oc_petri_net": lambda s, d: miners.object_centric_net(object_log(s, d)),
    "session_kpis": lambda s, d: usage.session_kpis(usage_events(s, d)),
    "recency_buckets": lambda s, d: usage.recency_buckets(usage_events(s, d), NOW),
    "usage_per_day": lambda s, d: usage.per_day(usage_events(s, d)),
    "hourly": lambda s, d: usage.hourly(usage_events(s, d)),
    "weekday": lambda s, d: usage.weekday(usage_events(s, d)),
    "usage_top": lambda s, d: usage.top(usage_events(s, d), "user_id"),
    "metric_series": lambda s, d: metric_series.metric_series(by_session(s, d), evolution.slices_absolute(by_session(s, d), 6).select("case_id", "slice")),
    "metric_series_sliding": lambda s, d: metric_series.metric_series(by_session(s, d), evolution.slices_sliding(by_session(s, d), 7, 3).select("case_id", "slice")),
    "calendar_granules": lambda s, d: simulation.calendar_granules(by_session(s, d), minutes=240, confidence=0.55),
    "net_tree": lambda s, d: miners.net_tree(miners.inductive_net(by_session(s, d), 0.2)),
    "alpha_tree": lambda s, d: miners.alpha_tree(by_session(s, d), loops=True),
    "slice_metrics": lambda s, d: metric_series.slice_metrics(by_session(s, d), evolution.slices_absolute(by_session(s, d), 6).select("case_id", "slice")),
}

_LIVES = "lv AS (SELECT oid, type, count(DISTINCT eid) AS n, (epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 1000000.0::DOUBLE AS d, arg_min(eid, struct_pack(t := timestamp, e := eid)) AS born, arg_max(eid, struct_pack(t := timestamp, e := eid)) AS dead FROM rel GROUP BY oid, type)"
_PAIR = "pr AS (SELECT DISTINCT a.eid, a.oid AS oa, b.oid AS ob, a.type AS ta, b.type AS tb, x.born AS ba, x.dead AS da, y.born AS bb, y.dead AS db FROM rel a JOIN rel b ON a.eid = b.eid AND a.oid <> b.oid JOIN lv x ON a.oid = x.oid JOIN lv y ON b.oid = y.oid)"


def _graph(where: str, ordered: bool) -> str:
    s, t = ("ta", "tb") if ordered else ("least(ta, tb)", "greatest(ta, tb)")
    return f"WITH {OC}, {_LIVES}, {_PAIR} SELECT {s} AS source, {t} AS target, count(*) AS pairs FROM (SELECT DISTINCT oa, ob, ta, tb FROM pr WHERE {where}) GROUP BY ALL"


_AB = "user_id % 2 = 1"
_TAG = f"tg AS (SELECT *, CASE WHEN {_AB} THEN 'b' ELSE 'a' END AS l FROM ev)"
_TAGTR = "tt AS (SELECT tr.*, t.l FROM tr JOIN (SELECT DISTINCT case_id, l FROM tg) t ON tr.case_id = t.case_id)"
_TAGED = "te AS (SELECT ed.*, t.l FROM ed JOIN (SELECT DISTINCT case_id, l FROM tg) t ON ed.case_id = t.case_id)"
_LIST = "ls AS (SELECT case_id, list(activity ORDER BY timestamp, seq) AS a FROM ev GROUP BY case_id)"
_VAR = "va AS (SELECT a, count(*) AS n FROM ls GROUP BY a)"
_STATES = """nx AS (SELECT a, n, unnest(range(1, len(a) + 1)) AS k FROM va),
rows_ AS (SELECT ls.case_id, array_to_string(a[1:k], '→') AS path, CASE WHEN k = 1 THEN '' ELSE array_to_string(a[1:k-1], '→') END AS parent, k
  FROM (SELECT case_id, a, unnest(range(1, len(a) + 1)) AS k FROM ls) ls),
pos AS (SELECT case_id, timestamp, row_number() OVER (PARTITION BY case_id ORDER BY timestamp, seq) AS k FROM ev),
st AS (SELECT path, parent, r.k, count(*) AS events, min(struct_pack(t := timestamp, c := r.case_id, k := r.k)) AS seen FROM rows_ r JOIN pos p ON r.case_id = p.case_id AND r.k = p.k GROUP BY ALL),
op AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY seen) > 1 AS opens FROM st),
ch AS (SELECT array_to_string(a, '→') AS v, k, array_to_string(a[1:k], '→') AS path FROM nx),
hd AS (SELECT DISTINCT ch.path, coalesce(last_value(CASE WHEN opens THEN ch.path END IGNORE NULLS) OVER (PARTITION BY v ORDER BY ch.k ROWS UNBOUNDED PRECEDING), '') AS head FROM ch JOIN op ON ch.path = op.path)"""
_EXPLODED_W = "wn AS (SELECT case_id, s, least((row_number() OVER (ORDER BY s, case_id) - 1) // greatest(count(*) OVER () // 20, 1), 19) AS w FROM tr)"
_DOT = " + ".join(f"embedding[{k + 1}]::DOUBLE * ({x}::DOUBLE)" for k, x in enumerate(QUERY_VECTOR))
_NORM = " + ".join(f"embedding[{k + 1}]::DOUBLE * embedding[{k + 1}]::DOUBLE" for k in range(64))
_QNORM = " + ".join(f"({x}::DOUBLE) * ({x}::DOUBLE)" for x in QUERY_VECTOR)
_COS = f"ve AS (SELECT vec_id, label, round(({_DOT}) / (sqrt({_NORM}) * sqrt({_QNORM})), 9) AS score FROM embeddings)"
_US = "us AS (SELECT user_id, CAST(user_id AS VARCHAR) || '-' || CAST(CAST(ts AS DATE) AS VARCHAR) AS session_id, event_type, ts AS occurred_at FROM events)"
_XLX = "CASE WHEN {0} > 0 THEN {0} * ln({0}) ELSE 0.0 END"


def _ent(src: str, w: str, name: str) -> str:
    n, x = "sum(w)", f"sum({_XLX.format('w')})"
    return f"SELECT '{name}' AS metric, round(({_XLX.format(n)}) - {x}, 6) AS value, round((({_XLX.format(n)}) - {x}) / ({_XLX.format(n)}), 6) AS normalised FROM (SELECT CAST({w} AS DOUBLE) AS w FROM {src})"


def _jac(kind: str, key: str, src: str) -> str:
    return f"SELECT DISTINCT '{kind}' AS kind, {key} AS key, l FROM {src}"


_CAL = "cal AS (SELECT * FROM (SELECT unnest([1, 2, 3, 4, 5]) AS weekday), (VALUES (32400, 43200), (46800, 61200)) t(begin_s, end_s))"
_ENABLED = """en AS (SELECT x.case_id, x.seq, x.activity, x.timestamp, max(y.end_timestamp) AS enabled_at FROM ev x JOIN ev y ON x.case_id = y.case_id AND y.end_timestamp <= x.timestamp AND y.seq <> x.seq GROUP BY ALL),
fr AS (SELECT seq, max(end_timestamp) OVER (PARTITION BY resource ORDER BY timestamp, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS available_since FROM ev),
de AS (SELECT case_id, en.seq, activity, enabled_at, available_since, greatest((epoch_us(timestamp) - epoch_us(greatest(enabled_at, coalesce(available_since, enabled_at)))) / 1000000.0::DOUBLE, 0.0) AS delay_s FROM en JOIN fr ON en.seq = fr.seq)"""
_BANDED = SE.replace("event_type AS activity", "event_type || '|' || CAST(CAST(floor(value / 50.0) AS BIGINT) AS VARCHAR) AS activity")

_SLICED = """sl AS (SELECT case_id, CAST(greatest(CAST(ceil(((epoch_us(s) - epoch_us(lo)) / 1000000.0::DOUBLE) / ((epoch_us(hi) - epoch_us(lo)) / 1000000.0::DOUBLE) * 6) AS BIGINT) - 1, 0) AS INTEGER) AS slice FROM tr, (SELECT min(s) AS lo, max(s) AS hi FROM tr))"""
_SLID = """sl AS (SELECT case_id, CAST((epoch_us(ws) - epoch_us(lo)) // 259200000000 AS INTEGER) AS slice FROM tr JOIN (SELECT unnest(generate_series(lo, hi, INTERVAL 3 DAY)) AS ws, lo FROM (SELECT min(s) AS lo, max(s) AS hi FROM tr)) ON s >= ws AND s < ws + INTERVAL 7 DAY)"""


def _series(slices: str) -> str:
    """All metrics by slice, each from its definition over whole prefixes."""
    entropy = lambda w: f"({_XLX.format(f'CAST(sum({w}) AS DOUBLE)')}) - sum({_XLX.format(f'CAST({w} AS DOUBLE)')})"
    plain = lambda w: f"({_XLX.format(f'CAST(sum({w}) AS DOUBLE)')})"
    return f"""WITH {SE}, {TRACES}, {slices},
e AS (SELECT slice, ev.case_id, activity, timestamp, seq, lead(activity) OVER w AS target, lead(seq) OVER w AS nseq, row_number() OVER w AS k,
  (epoch_us(lead(timestamp) OVER w) - epoch_us(timestamp)) / 1000000.0::DOUBLE AS gap, string_agg(activity, '→') OVER (PARTITION BY slice, ev.case_id ORDER BY timestamp, seq ROWS UNBOUNDED PRECEDING) AS path
  FROM ev JOIN sl ON ev.case_id = sl.case_id WINDOW w AS (PARTITION BY slice, ev.case_id ORDER BY timestamp, seq)),
ls AS (SELECT slice, case_id, list(activity ORDER BY timestamp, seq) AS a FROM e GROUP BY ALL),
m AS (SELECT slice, CAST(sum(len(a)) AS BIGINT) AS magnitude, count(*) AS support, round(avg(len(list_distinct(a))), 6) AS level_of_detail, CAST(min(len(a)) AS INTEGER) AS min_length, round(avg(len(a)), 6) AS avg_length, CAST(max(len(a)) AS INTEGER) AS max_length,
  count(DISTINCT a) AS n_variants, round(100.0::DOUBLE * count(DISTINCT a) / count(*), 6) AS pct_distinct_traces FROM ls GROUP BY slice),
ac AS (SELECT slice, count(*) AS n FROM e GROUP BY slice, activity),
kv AS (SELECT slice, count(*) AS variety, round(-sum((n / t) * ln(n / t)), 6) AS activity_variation FROM (SELECT slice, n, CAST(sum(n) OVER (PARTITION BY slice) AS DOUBLE) AS t FROM ac) GROUP BY slice),
ec AS (SELECT slice, activity <> target AS moved, count(*) AS c FROM e WHERE nseq IS NOT NULL GROUP BY slice, activity, target),
eg AS (SELECT slice, count(*) AS edges, CAST(sum(c) AS DOUBLE) AS steps, coalesce(sum(c) FILTER (WHERE moved), 0) AS moves, CAST(sum(c * c) AS DOUBLE) AS squares FROM ec GROUP BY slice),
gp AS (SELECT slice, round(avg(lo), 6) AS low, round(avg(me), 6) AS avg_time_diff_s FROM (SELECT slice, min(gap) AS lo, avg(gap) AS me FROM e WHERE nseq IS NOT NULL GROUP BY slice, case_id) GROUP BY slice),
st AS (SELECT slice, path, CASE WHEN k = 1 THEN '' ELSE left(path, length(path) - length(activity) - 1) END AS parent, k, count(*) AS events, min(struct_pack(t := timestamp, c := case_id, k := k)) AS seen FROM e GROUP BY ALL),
op AS (SELECT *, row_number() OVER (PARTITION BY slice, parent ORDER BY seen) > 1 AS opens FROM st),
hd AS (SELECT DISTINCT slice, path, coalesce(last_value(CASE WHEN opens THEN path END IGNORE NULLS) OVER (PARTITION BY slice, case_id ORDER BY e_k ROWS UNBOUNDED PRECEDING), '') AS head FROM (SELECT e.slice, e.case_id, e.k AS e_k, e.path, opens FROM e JOIN op ON e.slice = op.slice AND e.path = op.path)),
gr AS (SELECT st.slice, head, count(*) AS s, sum(events) AS n FROM hd JOIN st ON hd.slice = st.slice AND hd.path = st.path GROUP BY ALL),
en AS (SELECT slice, round({entropy('s')}, 6) AS variant_entropy, round(({entropy('s')}) / nullif({plain('s')}, 0.0), 6) AS vn, round({entropy('n')}, 6) AS sequence_entropy, round(({entropy('n')}) / nullif({plain('n')}, 0.0), 6) AS sn FROM gr GROUP BY slice)
SELECT m.*, variety, activity_variation, round(coalesce(moves, 0) / CAST(magnitude AS DOUBLE), 6) AS order_variation, coalesce(edges, 0) AS edges, round(1 - coalesce(edges, 0) / CAST(variety * variety AS DOUBLE), 6) AS structure,
round(pow(10.0::DOUBLE, 0.08::DOUBLE * (1 + coalesce(edges, 0) - variety)), 6) AS acyclic_paths, round(1 - sqrt(greatest(squares - steps * steps / CAST(variety * variety AS DOUBLE), 0.0)) / steps, 6) AS deviation_from_random,
coalesce(low, 0.0) AS time_granularity_s, avg_time_diff_s, variant_entropy, coalesce(vn, 0.0) AS variant_entropy_normalised, sequence_entropy, coalesce(sn, 0.0) AS sequence_entropy_normalised
FROM m JOIN kv ON m.slice = kv.slice LEFT JOIN eg ON m.slice = eg.slice LEFT JOIN gp ON m.slice = gp.slice JOIN en ON m.slice = en.slice"""


ORACLE_SQL = {
    "calendar_granules": f"""WITH {SE}, x AS (SELECT resource, activity, CAST(timestamp AS DATE) AS day, CAST(dayofweek(timestamp) AS INTEGER) AS weekday, CAST((hour(timestamp) * 60 + minute(timestamp)) // 240 AS INTEGER) AS granule FROM ev),
ac AS (SELECT resource, activity, weekday, count(DISTINCT day) AS d FROM x GROUP BY ALL), ce AS (SELECT resource, activity, weekday, granule, count(DISTINCT day) AS d, count(*) AS n FROM x GROUP BY ALL),
gr AS (SELECT ce.resource, ce.weekday, granule, CAST(sum(n) AS BIGINT) AS n, round(max(ce.d / CAST(ac.d AS DOUBLE)), 6) AS confidence FROM ce JOIN ac ON ce.resource = ac.resource AND ce.activity = ac.activity AND ce.weekday = ac.weekday GROUP BY ALL),
fr AS (SELECT resource, activity, count(*) AS n FROM x GROUP BY ALL), pa AS (SELECT resource, round(sum(n) / CAST(sum(m) AS DOUBLE), 6) AS participation FROM (SELECT *, max(n) OVER (PARTITION BY activity) AS m FROM fr) GROUP BY resource),
su AS (SELECT resource, sum(n) AS t, coalesce(sum(n) FILTER (WHERE confidence >= 0.55), 0) AS h FROM gr GROUP BY resource),
lo AS (SELECT p.resource, p.weekday, p.granule, coalesce(sum(q.n), 0) AS b FROM gr p LEFT JOIN gr q ON p.resource = q.resource AND q.confidence < 0.55 AND (q.n > p.n OR (q.n = p.n AND (q.weekday < p.weekday OR (q.weekday = p.weekday AND q.granule < p.granule)))) GROUP BY ALL)
SELECT gr.*, participation, participation >= 0.4 AND (confidence >= 0.55 OR (h > 0 AND h + b < 0.7::DOUBLE * t)) AS accepted FROM gr JOIN pa ON gr.resource = pa.resource JOIN su ON gr.resource = su.resource JOIN lo ON gr.resource = lo.resource AND gr.weekday = lo.weekday AND gr.granule = lo.granule""",
    "resource_roles": f"""WITH RECURSIVE {SE}, p AS (SELECT resource, activity, CAST(count(*) AS DOUBLE) AS n FROM ev GROUP BY ALL), k AS (SELECT count(DISTINCT activity) AS k FROM ev), s AS (SELECT resource, sum(n) AS s, sum(n * n) AS q FROM p GROUP BY resource),
lk AS (SELECT a.resource AS a, b.resource AS b FROM p a JOIN p b ON a.activity = b.activity AND a.resource <> b.resource JOIN s x ON x.resource = a.resource JOIN s y ON y.resource = b.resource, k
  GROUP BY ALL HAVING max(k) * sum(a.n * b.n) - max(x.s) * max(y.s) > 0.7::DOUBLE * sqrt((max(k) * max(x.q) - max(x.s) ** 2) * (max(k) * max(y.q) - max(y.s) ** 2))),
re AS (SELECT resource AS a, resource AS b FROM s UNION SELECT re.a, lk.b FROM re JOIN lk ON re.b = lk.a)
SELECT a AS resource, CAST(dense_rank() OVER (ORDER BY min(b)) - 1 AS INTEGER) AS role FROM re GROUP BY a""",
    "metric_series": _series(_SLICED),
    "metric_series_sliding": _series(_SLID),
    "enriched_entropy": f"WITH {_BANDED}, {_LIST}, {_VAR}, {_STATES}, g AS (SELECT head, count(*) AS s, sum(events) AS e FROM hd JOIN st ON hd.path = st.path GROUP BY head) {_ent('g', 's', 'variant')} UNION ALL {_ent('g', 'e', 'sequence')}",
    "drift_frobenius": f"""WITH {SE}, {TRACES}, {EDGES}, {_EXPLODED_W}, f AS (SELECT w, source, target, count(*) AS n FROM ed JOIN wn ON ed.case_id = wn.case_id GROUP BY ALL), k AS (SELECT DISTINCT source, target FROM f), w AS (SELECT DISTINCT w FROM f),
g AS (SELECT w.w, k.source, k.target, coalesce(n, 0) AS n FROM w CROSS JOIN k LEFT JOIN f ON f.w = w.w AND f.source = k.source AND f.target = k.target)
SELECT CAST(a.w AS INTEGER) AS i, CAST(b.w AS INTEGER) AS j, round(sqrt(CAST(sum((a.n - b.n) * (a.n - b.n)) AS DOUBLE)), 6) AS distance FROM g a JOIN g b ON a.source = b.source AND a.target = b.target AND a.w < b.w GROUP BY ALL""",
    "concurrency": f"""WITH {SE}, m AS (SELECT resource, timestamp AS t, 1 AS s FROM ev UNION ALL SELECT resource, end_timestamp, -1 FROM ev), r AS (SELECT resource, s, sum(s) OVER (PARTITION BY resource ORDER BY t, s ROWS UNBOUNDED PRECEDING) AS n FROM m)
SELECT resource, CAST(max(n) AS BIGINT) AS most, count(*) FILTER (WHERE s = 1) AS events FROM r GROUP BY resource""",
    "in_calendar": f"""WITH {SE}, {_CAL} SELECT activity, CAST(timestamp AS DATE) = CAST(end_timestamp AS DATE) AND EXISTS (SELECT 1 FROM cal WHERE weekday = dayofweek(timestamp) AND begin_s <= hour(timestamp) * 3600 + minute(timestamp) * 60 + second(timestamp) AND hour(end_timestamp) * 3600 + minute(end_timestamp) * 60 + second(end_timestamp) <= end_s) AS inside, count(*) AS n FROM ev GROUP BY ALL""",
    "working_seconds": f"""WITH {SE}, {_CAL}, d AS (SELECT case_id, seq, timestamp AS a, end_timestamp AS b, unnest(generate_series(date_trunc('day', timestamp), date_trunc('day', end_timestamp), INTERVAL 1 DAY)) AS day FROM ev),
x AS (SELECT case_id, seq, CASE WHEN begin_s IS NOT NULL THEN greatest(least((epoch_us(b) - epoch_us(day)) / 1000000.0::DOUBLE, end_s::DOUBLE) - greatest((epoch_us(a) - epoch_us(day)) / 1000000.0::DOUBLE, begin_s::DOUBLE), 0.0) END AS s FROM d LEFT JOIN cal ON weekday = dayofweek(day))
SELECT case_id, seq AS key, round(coalesce(sum(s), 0.0), 6) AS working_s FROM x GROUP BY case_id, seq""",
    "delays": f"WITH {SE}, {_ENABLED} SELECT * FROM de",
    "activity_delays": f"WITH {SE}, {_ENABLED} SELECT activity, count(*) AS n, round(avg(CASE WHEN delay_s > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS delayed, round(avg(delay_s), 6) AS mean_delay_s FROM de GROUP BY activity",
    "ocel_overview": f"WITH {OC} SELECT * FROM (SELECT count(*) AS events, count(DISTINCT activity) AS activities, min(timestamp) AS earliest, max(timestamp) AS latest FROM evs), (SELECT count(*) AS objects, count(DISTINCT type) AS types FROM obj), (SELECT count(*) AS relations FROM rel), (SELECT count(*) AS o2o FROM o2o)",
    "ocel_types": f"WITH {OC} SELECT type, count(*) AS n FROM obj GROUP BY type",
    "ocel_page": f"WITH {OC} SELECT oid, type FROM obj WHERE type = 'supplier' AND oid ILIKE '%1%' ORDER BY oid LIMIT 20 OFFSET 2",
    "ocel_matrix": f"WITH {OC} SELECT activity, type, count(DISTINCT eid) AS events, count(DISTINCT oid) AS objects FROM rel GROUP BY ALL",
    "ocel_lifecycle": f"WITH {OC}, {_LIVES} SELECT type, count(*) AS objects, round(median(d), 6) AS median_lifetime_s, round(avg(d), 6) AS avg_lifetime_s, round(avg(n), 6) AS avg_events FROM lv GROUP BY type",
    "ocel_longest": f"WITH {OC} SELECT oid, type, min(timestamp) AS start, max(timestamp) AS \"end\", count(DISTINCT eid) AS n_events, (epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 1000000.0::DOUBLE AS lifetime_s FROM rel GROUP BY oid, type ORDER BY lifetime_s DESC, oid LIMIT 50",
    "ocel_interaction": _graph("oa < ob", False),
    "ocel_degree": f"WITH {OC}, b AS (SELECT oid, oid_2 FROM o2o UNION SELECT oid_2, oid FROM o2o), g AS (SELECT oid, count(DISTINCT oid_2) AS n FROM b WHERE oid <> oid_2 GROUP BY oid) SELECT type, round(avg(n), 6) AS avg_interacting FROM g JOIN obj ON g.oid = obj.oid GROUP BY type",
    "ocel_cobirth": _graph("ba = eid AND bb = eid AND oa < ob", False),
    "ocel_codeath": _graph("da = eid AND db = eid AND oa < ob", False),
    "ocel_descendants": _graph("bb = eid AND ba <> eid", True),
    "ocel_inheritance": _graph("bb = eid AND da = eid", True),
    "ocel_variable_arcs": f"WITH {OC}, p AS (SELECT activity, type, eid, count(DISTINCT oid) AS k FROM rel GROUP BY ALL), q AS (SELECT activity, type, count(*) AS c, max(k) AS m FROM p GROUP BY ALL), n AS (SELECT activity, count(DISTINCT eid) AS n FROM evs GROUP BY activity) SELECT q.activity, type, m > 1 OR c < n AS variable FROM q JOIN n ON q.activity = n.activity",
    "ocdfg_edges": f"""WITH {OC}, e AS (SELECT type, oid, eid, activity AS source, lead(activity) OVER w AS target, lead(eid) OVER w AS ne, (epoch_us(lead(timestamp) OVER w) - epoch_us(timestamp)) / 1000000.0::DOUBLE AS s FROM rel WINDOW w AS (PARTITION BY type, oid ORDER BY timestamp, eid))
SELECT type, source, target, count(DISTINCT oid) AS unique_objects, count(DISTINCT (eid, ne)) AS event_couples, count(*) AS total_objects, round(avg(s), 6) AS mean_s, round(median(s), 6) AS median_s FROM e WHERE ne IS NOT NULL GROUP BY ALL""",
    "ocdfg_endpoints": f"""WITH {OC}, p AS (SELECT type, oid, arg_min(activity, struct_pack(t := timestamp, e := eid)) AS f, arg_max(activity, struct_pack(t := timestamp, e := eid)) AS l FROM rel GROUP BY ALL)
SELECT type, activity, CAST(sum(s) AS BIGINT) AS starts, CAST(sum(1 - s) AS BIGINT) AS ends FROM (SELECT type, f AS activity, 1 AS s FROM p UNION ALL SELECT type, l, 0 FROM p) GROUP BY ALL""",
    "dfg_diff": f"WITH {SE}, {_TAG}, {EDGES}, {_TAGED}, c AS (SELECT source, target, count(*) FILTER (WHERE l = 'a') AS freq_a, count(*) FILTER (WHERE l = 'b') AS freq_b FROM te GROUP BY ALL) SELECT *, CASE WHEN freq_b = 0 THEN 'only_a' WHEN freq_a = 0 THEN 'only_b' ELSE 'shared' END AS status, freq_b - freq_a AS delta FROM c",
    "variant_diff": f"""WITH {SE}, {_TAG}, {TRACES}, {_TAGTR}, c AS (SELECT variant, count(*) FILTER (WHERE l = 'a') AS n_a, count(*) FILTER (WHERE l = 'b') AS n_b FROM tt GROUP BY variant),
s AS (SELECT *, n_a / CAST(sum(n_a) OVER () AS DOUBLE) AS sa, n_b / CAST(sum(n_b) OVER () AS DOUBLE) AS sb FROM c), r AS (SELECT *, row_number() OVER (ORDER BY abs(sb - sa) DESC, variant) AS rank FROM s)
SELECT variant, n_a, n_b, round(sa, 9) AS share_a, round(sb, 9) AS share_b, round(abs(sb - sa), 9) AS max_delta, rank FROM r WHERE rank <= 60""",
    "activity_deltas": f"""WITH {SE}, {_TAG}, {EDGES}, {_TAGED}, f AS (SELECT activity, count(*) FILTER (WHERE l = 'a') AS freq_a, count(*) FILTER (WHERE l = 'b') AS freq_b FROM tg GROUP BY activity),
w AS (SELECT source, round(avg(seconds) FILTER (WHERE l = 'a'), 6) AS sojourn_a, round(avg(seconds) FILTER (WHERE l = 'b'), 6) AS sojourn_b FROM te GROUP BY source)
SELECT activity, freq_a, freq_b, sojourn_a, sojourn_b, freq_b - freq_a AS freq_delta FROM f LEFT JOIN w ON f.activity = w.source""",
    "similarity_jaccard": f"""WITH {SE}, {_TAG}, {EDGES}, {_TAGED}, {TRACES}, {_TAGTR}, e2 AS (SELECT DISTINCT l, source, target FROM te),
k AS ({_jac('activities', 'activity', 'tg')} UNION ALL {_jac('edges', "source || '→' || target", 'te')} UNION ALL {_jac('variants', 'variant', 'tt')}
 UNION ALL SELECT 'footprints', CASE WHEN EXISTS (SELECT 1 FROM e2 y WHERE y.l = x.l AND y.source = x.target AND y.target = x.source) THEN 'parallel|' ELSE 'directly_follows|' END || source || '|' || target, l FROM e2 x
 UNION ALL SELECT DISTINCT 'footprints', 'start|' || fa || '|', l FROM tt UNION ALL SELECT DISTINCT 'footprints', 'end|' || la || '|', l FROM tt),
h AS (SELECT kind, key, max(CASE WHEN l = 'a' THEN 1 ELSE 0 END) AS a, max(CASE WHEN l = 'b' THEN 1 ELSE 0 END) AS b FROM k GROUP BY ALL),
s AS (SELECT kind, sum(a) AS a, sum(b) AS b, sum(a * b) AS i, sum(greatest(a, b)) AS u FROM h GROUP BY kind)
SELECT kind, 'a' AS log_a, 'a' AS log_b, 1.0::DOUBLE AS jaccard FROM s UNION ALL SELECT kind, 'b', 'b', 1.0::DOUBLE FROM s UNION ALL SELECT kind, 'a', 'b', round(CAST(i AS DOUBLE) / u, 6) FROM s""",
    "wasserstein_hours": f"""WITH {SE}, {_TAG}, {TRACES}, {_TAGTR}, x AS (SELECT 'circadian' AS metric, CAST(hour(timestamp) AS DOUBLE) AS v, l FROM tg UNION ALL SELECT 'cycle_time', d / 3600.0::DOUBLE, l FROM tt),
c AS (SELECT metric, v, count(*) FILTER (WHERE l = 'a') AS a, count(*) FILTER (WHERE l = 'b') AS b FROM x GROUP BY ALL),
g AS (SELECT metric, abs(sum(a) OVER u / CAST(sum(a) OVER (PARTITION BY metric) AS DOUBLE) - sum(b) OVER u / CAST(sum(b) OVER (PARTITION BY metric) AS DOUBLE)) * (lead(v) OVER (PARTITION BY metric ORDER BY v) - v) AS area FROM c WINDOW u AS (PARTITION BY metric ORDER BY v ROWS UNBOUNDED PRECEDING))
SELECT metric, round(sum(area), 6) AS distance FROM g GROUP BY metric""",
    "ngram_tv": f"""WITH {SE}, {_TAG}, t AS (SELECT l, list_concat(['#', '#'], list_concat(list(activity ORDER BY timestamp, seq), ['#', '#'])) AS a FROM tg GROUP BY l, case_id),
g AS (SELECT l, array_to_string(a[k:k+2], '→') AS gram FROM (SELECT l, a, unnest(range(1, len(a) - 1)) AS k FROM t)), c AS (SELECT gram, count(*) FILTER (WHERE l = 'a') AS x, count(*) FILTER (WHERE l = 'b') AS y FROM g GROUP BY gram)
SELECT round(sum(abs(p - q)) / 2, 6) AS ngd FROM (SELECT x / CAST(sum(x) OVER () AS DOUBLE) AS p, y / CAST(sum(y) OVER () AS DOUBLE) AS q FROM c)""",
    "handover_matrix": f"""WITH {EV}, {EDGES}, k AS (SELECT activity FROM (SELECT activity, count(*) AS n FROM ev GROUP BY activity ORDER BY n DESC, activity LIMIT 4)), c AS (SELECT source, target, count(*) AS n FROM ed WHERE source IN (SELECT activity FROM k) AND target IN (SELECT activity FROM k) GROUP BY ALL)
SELECT source, target, n, round(n / CAST(sum(n) OVER (PARTITION BY source) AS DOUBLE), 6) AS probability FROM c""",
    "circadian": f"WITH {SE}, {_TAG}, c AS (SELECT l AS log_id, CAST(hour(timestamp) AS INTEGER) AS hour, count(*) AS n FROM tg GROUP BY ALL) SELECT *, round(n / CAST(sum(n) OVER (PARTITION BY log_id) AS DOUBLE), 6) AS share FROM c",
    "arrivals_compare": f"""WITH {SE}, {_TAG}, {TRACES}, {_TAGTR}, b AS (SELECT min(CAST(s AS DATE)) AS lo, max(CAST(s AS DATE)) AS hi FROM tt)
SELECT l AS log_id, CAST((CAST(s AS DATE) - lo) // CASE WHEN hi - lo > 90 THEN 7 ELSE 1 END AS INTEGER) AS bin, count(*) AS n FROM tt, b GROUP BY ALL""",
    "cycle_time_bins": f"""WITH {SE}, {_TAG}, {TRACES}, {_TAGTR}, b AS (SELECT quantile_cont(d, 0.97) AS top FROM tt) SELECT l AS log_id, CAST(CASE WHEN top <= 0 THEN 0 ELSE least(CAST(floor(d / (top / 20)) AS BIGINT), 20) END AS INTEGER) AS bin, count(*) AS n FROM tt, b GROUP BY ALL""",
    "fidelity_self": "SELECT unnest(['ngd', 'aedd', 'cedd', 'redd', 'ctdd']) AS metric, 0.0::DOUBLE AS mean, 0.0::DOUBLE AS std",
    "size_metrics": f"""WITH {SE}, {_LIST} SELECT CAST(sum(len(a)) AS BIGINT) AS magnitude, count(*) AS support, (SELECT count(DISTINCT activity) FROM ev) AS variety, round(avg(len(list_distinct(a))), 6) AS level_of_detail,
CAST(min(len(a)) AS INTEGER) AS min_length, round(avg(len(a)), 6) AS avg_length, CAST(max(len(a)) AS INTEGER) AS max_length, count(DISTINCT a) AS n_variants, round(100.0::DOUBLE * count(DISTINCT a) / count(*), 6) AS pct_distinct_traces FROM ls""",
    "order_variation": f"""WITH {SE}, x AS (SELECT activity, activity <> lag(activity) OVER (PARTITION BY case_id ORDER BY timestamp, seq) AS m FROM ev), p AS (SELECT count(*) / CAST((SELECT count(*) FROM x) AS DOUBLE) AS p FROM x GROUP BY activity)
SELECT (SELECT round(count(*) FILTER (WHERE m) / CAST(count(*) AS DOUBLE), 6) FROM x) AS order_variation, (SELECT round(-sum(p * ln(p)), 6) FROM p) AS activity_variation""",
    "structure": f"""WITH {SE}, {EDGES}, c AS (SELECT count(*) AS c FROM ed GROUP BY source, target), e AS (SELECT count(*) AS e, CAST(sum(c) AS DOUBLE) AS n, CAST(sum(c * c) AS DOUBLE) AS q FROM c), v AS (SELECT count(DISTINCT activity) AS v FROM ev)
SELECT e AS edges, v AS activities, round(1 - e / CAST(v * v AS DOUBLE), 6) AS structure, round(pow(10.0::DOUBLE, 0.08::DOUBLE * (1 + e - v)), 6) AS acyclic_paths, round(1 - sqrt(greatest(q - n * n / CAST(v * v AS DOUBLE), 0.0)) / n, 6) AS deviation_from_random FROM e, v""",
    "time_granularity": f"WITH {SE}, {EDGES}, p AS (SELECT min(seconds) AS lo, avg(seconds) AS m FROM ed GROUP BY case_id) SELECT round(avg(lo), 6) AS time_granularity_s, round(avg(m), 6) AS avg_time_diff_s FROM p",
    "n_ties": f"""WITH {SE}, {_LIST}, {_VAR}, p AS (SELECT DISTINCT array_to_string(a[1:k], '→') AS path, CASE WHEN k = 1 THEN '' ELSE array_to_string(a[1:k-1], '→') END AS parent, k FROM (SELECT a, unnest(range(1, len(a) + 1)) AS k FROM va))
SELECT CAST(sum(k) AS BIGINT) AS n_ties FROM p WHERE path NOT IN (SELECT parent FROM p)""",
    "affinity": f"""WITH {SE}, {_LIST}, {_VAR}, w AS (SELECT array_to_string(a, '→') AS v, n, list_distinct([a[i] || '→' || a[i + 1] for i in range(1, len(a))]) AS e FROM va),
x AS (SELECT sum(2.0::DOUBLE * p.n * q.n * len(list_intersect(p.e, q.e)) / nullif(len(p.e) + len(q.e) - len(list_intersect(p.e, q.e)), 0)) AS x FROM w p JOIN w q ON p.v < q.v), s AS (SELECT sum(n) AS n, sum(CASE WHEN len(e) > 0 THEN n * (n - 1) ELSE 0 END) AS same FROM w)
SELECT round((same + x) / CAST(n * (n - 1) AS DOUBLE), 6) AS affinity FROM s, x""",
    "edit_distance": f"""WITH {SE}, {_LIST}, nm AS (SELECT activity, chr(96 + CAST(row_number() OVER (ORDER BY activity) AS INTEGER)) AS c FROM (SELECT DISTINCT activity FROM ev)), {_VAR},
w AS (SELECT * FROM (SELECT array_to_string(a, '→') AS v, n, a, row_number() OVER (ORDER BY n DESC, array_to_string(a, '→')) AS id FROM va) WHERE id <= 300),
u AS (SELECT id, n, k, c FROM (SELECT id, n, unnest(a) AS activity, unnest(range(1, len(a) + 1)) AS k FROM w) x JOIN nm ON x.activity = nm.activity), z AS (SELECT id, n, string_agg(c, '' ORDER BY k) AS s FROM u GROUP BY id, n)
SELECT round((SELECT sum(levenshtein(p.s, q.s) * p.n * q.n) FROM z p JOIN z q ON p.id < q.id) / (sum(n) * (sum(n) - 1) / 2.0::DOUBLE), 6) AS avg_edit_distance, count(*) AS variants_used FROM z""",
    "epa_entropy": f"WITH {SE}, {_LIST}, {_VAR}, {_STATES}, g AS (SELECT head, count(*) AS s, sum(events) AS e FROM hd JOIN st ON hd.path = st.path GROUP BY head) {_ent('g', 's', 'variant')} UNION ALL {_ent('g', 'e', 'sequence')}",
    "epa_entropy_forgetting": f"""WITH {SE}, {_LIST}, {_VAR}, {_STATES}, b AS (SELECT min(timestamp) AS lo, max(timestamp) AS hi FROM ev),
z AS (SELECT head, 1 - (epoch_us(hi) - epoch_us(timestamp)) / CAST(epoch_us(hi) - epoch_us(lo) AS DOUBLE) AS w FROM rows_ r JOIN pos p ON r.case_id = p.case_id AND r.k = p.k JOIN hd ON hd.path = r.path, b),
g AS (SELECT head, sum(w) AS w, count(*) AS n FROM z GROUP BY head), t AS (SELECT sum(w) AS w, sum({_XLX.format('w')}) AS x, CAST(sum(n) AS DOUBLE) AS n FROM g)
SELECT round(w * ln(w) - x, 6) AS value, round((w * ln(w) - x) / (n * ln(n)), 6) AS normalised FROM t""",
    "drift_windows": f"WITH {SE}, {TRACES}, {EDGES}, {_EXPLODED_W} SELECT CAST(w AS INTEGER) AS \"window\", source, target, count(*) AS frequency FROM ed JOIN wn ON ed.case_id = wn.case_id GROUP BY ALL",
    "drift_similarity": f"""WITH {SE}, {TRACES}, {EDGES}, {_EXPLODED_W}, f AS (SELECT w, source, target, count(*) AS n FROM ed JOIN wn ON ed.case_id = wn.case_id GROUP BY ALL), m AS (SELECT w, sqrt(CAST(sum(n * n) AS DOUBLE)) AS m FROM f GROUP BY w),
d AS (SELECT p.w AS i, q.w AS j, CAST(sum(p.n * q.n) AS DOUBLE) AS dot FROM f p JOIN f q ON p.source = q.source AND p.target = q.target GROUP BY ALL), g AS (SELECT unnest(range(0, 20)) AS i), h AS (SELECT g.i, k.i AS j FROM g, g k),
r AS (SELECT h.i, h.j, CASE WHEN h.i = h.j THEN 0.0 ELSE round(1 - coalesce(dot / nullif(a.m * b.m, 0.0), 0.0), 12) END AS d FROM h LEFT JOIN d ON h.i = d.i AND h.j = d.j LEFT JOIN m a ON a.w = h.i LEFT JOIN m b ON b.w = h.j)
SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CAST(floor(round((1 - d / max(d) OVER ()) * 255, 6)) AS INTEGER) AS value FROM r""",
    "dominant_activity": f"""WITH {EV}, x AS (SELECT activity, CAST(least((row_number() OVER (ORDER BY timestamp, seq) - 1) // greatest(count(*) OVER () // 30, 1), 29) AS INTEGER) AS w FROM ev), c AS (SELECT w, activity, count(*) AS n FROM x GROUP BY ALL)
SELECT w AS "window", activity, n FROM c QUALIFY row_number() OVER (PARTITION BY w ORDER BY n DESC, activity) = 1""",
    "drift_starts": f"WITH {SE}, {TRACES}, x AS (SELECT s, row_number() OVER (ORDER BY s, case_id) - 1 AS k, count(*) OVER () AS n FROM tr) SELECT CAST(k // 50 AS INTEGER) AS \"window\", s AS start FROM x WHERE k % 50 = 0 AND k < n - 100",
    "vector_topk": f"WITH {_COS} SELECT vec_id, label, score FROM ve ORDER BY score DESC, vec_id LIMIT 20",
    "rerank": f"""WITH {_COS}, h AS (SELECT *, round(0.4::DOUBLE * ((vec_id % 10) / 10.0::DOUBLE) + 0.6::DOUBLE * score, 9) AS rank_score FROM (SELECT * FROM ve ORDER BY score DESC, vec_id LIMIT 50)),
b AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY label ORDER BY rank_score DESC, vec_id) = 1) SELECT vec_id, label, score, rank_score FROM b ORDER BY rank_score DESC, vec_id LIMIT 4""",
    "text_chunks": """WITH d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE length(coalesce(text, '')) > 0), c AS (SELECT doc_id, text, unnest(range(0, greatest(CAST(ceil((n - 100) / 900.0::DOUBLE) AS BIGINT), 1))) AS k FROM d),
x AS (SELECT doc_id, k, substring(text, k * 900 + 1, 1000) AS chunk FROM c) SELECT doc_id, count(*) AS chunks, CAST(sum(length(chunk)) AS BIGINT) AS chars, md5(arg_max(chunk, k)) AS last_md5 FROM x GROUP BY doc_id""",
    "prerequisites": f"""WITH {SE}, p AS (SELECT case_id, activity, row_number() OVER (PARTITION BY case_id ORDER BY timestamp, seq) AS k FROM ev), b AS (SELECT case_id, activity AS requires, min(k) AS k FROM p GROUP BY ALL), n AS (SELECT activity, count(*) AS n FROM ev GROUP BY activity),
s AS (SELECT p.activity, requires, count(*) AS c FROM p JOIN b ON p.case_id = b.case_id AND b.k < p.k GROUP BY ALL) SELECT s.activity, requires FROM s JOIN n ON s.activity = n.activity WHERE c = n""",
    "zero_waiting": f"WITH {SE}, {EDGES}, x AS (SELECT target AS activity, avg(CASE WHEN seconds <= 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS s FROM ed GROUP BY target) SELECT activity, round(s, 6) AS zero_share, s >= 0.99 AS zero_waiting FROM x",
    "start_distribution": f"WITH {SE}, {TRACES}, x AS (SELECT fa AS activity, count(*) AS n FROM tr GROUP BY fa) SELECT activity, n, round(n / CAST(sum(n) OVER () AS DOUBLE), 6) AS share FROM x",
    "interarrival": f"WITH {SE}, {TRACES}, x AS (SELECT case_id, (epoch_us(s) - epoch_us(lag(s) OVER (PARTITION BY CAST(s AS DATE) ORDER BY s, case_id))) / 1000000.0::DOUBLE AS seconds FROM tr) SELECT * FROM x WHERE seconds IS NOT NULL",
    "weekday_arrivals": f"""WITH {SE}, {TRACES}, d AS (SELECT CAST(dayofweek(s) AS INTEGER) AS weekday, CAST(s AS DATE) AS day, count(*) AS n, min(hour(s) * 3600 + minute(s) * 60 + second(s)) AS lo, max(hour(s) * 3600 + minute(s) * 60 + second(s)) AS hi FROM tr GROUP BY ALL)
SELECT weekday, min(lo) AS min_second, max(hi) AS max_second, round(avg(n), 6) AS mean_cases, round(stddev_pop(n), 6) AS std_cases FROM d GROUP BY weekday""",
    "prefix_next": f"""WITH {SE}, {_LIST}, e AS (SELECT a, unnest(range(1, len(a))) AS e FROM ls), r AS (SELECT a, e, unnest(range(1, least(e, 3) + 1)) AS k FROM e), c AS (SELECT array_to_string(a[e-k+1:e], '→') AS prefix, a[e + 1] AS next_activity, count(*) AS n FROM r GROUP BY ALL)
SELECT *, round(n / CAST(sum(n) OVER (PARTITION BY prefix) AS DOUBLE), 6) AS probability FROM c""",
    "agent_activities": f"WITH {SE} SELECT resource AS agent, string_agg(DISTINCT activity, ',' ORDER BY activity) AS activities FROM ev GROUP BY resource",
    "max_activity_count": f"WITH {SE} SELECT activity, max(n) AS max_per_case FROM (SELECT activity, count(*) AS n FROM ev GROUP BY case_id, activity) GROUP BY activity",
    "overlap_pairs": f"""WITH {SE}, p AS (SELECT x.case_id, x.activity AS a, y.activity AS b, max(CASE WHEN x.timestamp < y.end_timestamp AND y.timestamp < x.end_timestamp THEN 1 ELSE 0 END) AS o FROM ev x JOIN ev y ON x.case_id = y.case_id AND x.activity < y.activity GROUP BY ALL)
SELECT a, b, count(*) AS cases, CAST(sum(o) AS BIGINT) AS overlapping, sum(o) >= 0.2 * count(*) AS concurrent FROM p GROUP BY ALL""",
    "enabling_event": f"""WITH {SE} SELECT x.case_id, x.seq, x.activity, arg_max(y.activity, struct_pack(e := y.end_timestamp, q := y.seq)) AS enabled_by, max(y.end_timestamp) AS enabled_at
FROM ev x LEFT JOIN ev y ON x.case_id = y.case_id AND y.end_timestamp <= x.timestamp AND y.seq <> x.seq GROUP BY ALL""",
    "resource_previous_end": f"WITH {SE} SELECT seq, resource, max(end_timestamp) OVER (PARTITION BY resource ORDER BY timestamp, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS available_since FROM ev",
    "weekly_calendar": f"WITH {SE}, c AS (SELECT resource, CAST(dayofweek(timestamp) AS INTEGER) AS weekday, CAST(hour(timestamp) AS INTEGER) AS hour, count(*) AS n FROM ev GROUP BY ALL), x AS (SELECT *, round(n / CAST(max(n) OVER (PARTITION BY resource) AS DOUBLE), 6) AS confidence FROM c) SELECT * FROM x WHERE confidence >= 0.1",
    "train_test_split": f"""WITH {SE}, x AS (SELECT case_id, CASE WHEN row_number() OVER (ORDER BY timestamp, case_id, seq) <= round(count(*) OVER () * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS side FROM ev), s AS (SELECT case_id, min(side) AS lo, max(side) AS hi, count(*) AS n FROM x GROUP BY case_id)
SELECT CASE WHEN lo = hi THEN lo ELSE 'cut' END AS part, CAST(sum(n) AS BIGINT) AS events, count(*) AS cases FROM s GROUP BY 1""",
    "session_kpis": f"""WITH {_US}, s AS (SELECT count(*) AS n, (epoch_us(max(occurred_at)) - epoch_us(min(occurred_at))) / 1000000.0::DOUBLE AS d FROM us GROUP BY session_id)
SELECT count(*) AS sessions, round(avg(d), 6) AS avg_session_s, round(avg(n), 6) AS avg_events, round(avg(CASE WHEN n = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS bounce_rate, (SELECT count(DISTINCT user_id) FROM us) AS users FROM s""",
    "recency_buckets": f"""WITH {_US}, l AS (SELECT DATE '2024-01-31' - CAST(max(occurred_at) AS DATE) AS d FROM us GROUP BY user_id) SELECT CASE WHEN d <= 0 THEN 'today' WHEN d < 7 THEN '7d' WHEN d < 30 THEN '30d' ELSE 'older' END AS bucket, count(*) AS users FROM l GROUP BY 1""",
    "usage_per_day": f"WITH {_US} SELECT CAST(occurred_at AS DATE) AS day, count(*) AS events, count(DISTINCT user_id) AS users FROM us GROUP BY 1",
    "hourly": f"WITH {_US} SELECT CAST(hour(occurred_at) AS INTEGER) AS hour, count(*) AS n FROM us GROUP BY 1",
    "weekday": f"WITH {_US} SELECT CAST(dayofweek(occurred_at) AS INTEGER) AS weekday, count(*) AS n FROM us GROUP BY 1",
    "usage_top": f"WITH {_US} SELECT user_id, count(*) AS n FROM us GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10",
    "slice_metrics": f"""WITH {SE}, {TRACES}, b AS (SELECT min(s) AS lo, max(s) AS hi FROM tr),
sl AS (SELECT case_id, n, d, variant, CAST(greatest(CAST(ceil(((epoch_us(s) - epoch_us(lo)) / 1000000.0::DOUBLE) / ((epoch_us(hi) - epoch_us(lo)) / 1000000.0::DOUBLE) * 6) AS BIGINT) - 1, 0) AS INTEGER) AS slice FROM tr, b)
SELECT slice, CAST(sum(n) AS BIGINT) AS magnitude, count(*) AS support, round(avg(n), 6) AS avg_length, count(DISTINCT variant) AS n_variants, round(avg(d), 6) AS avg_duration_s FROM sl GROUP BY slice""",
}
