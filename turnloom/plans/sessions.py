"""Queries of session lifecycles, rejected requests and trial results, on rows made from turns and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnloom.functions import endpoints
from turnloom.operators import lifecycle, trials
from turnloom.plans.registry import query
from turnloom.ship import ship
from turnloom.sources import records
from turnloom.sources.adapter import DUCK_TURNS, read
from turnloom.streaming import rejections

#: SQL that Spark and DuckDB both read. Turns come 10 apart and last up to 34, some for ever; sessions are
#: finalized in the midst of their turns or behind them, once or twice, and some deleted, of which some fail to release.
_WORK = """SELECT session_id AS session, turn_ordinal * 10 AS accepted_at, CASE WHEN conv_id % 31 = 4 THEN NULL ELSE turn_ordinal * 10 + n_completion % 35 END AS done_at, conv_id % 23 = 3 AS lost FROM turns"""
_NUMBERED = "(SELECT session_id, min(conv_id) AS c, max(turn_ordinal) AS n FROM turns GROUP BY session_id) s"
_CONTROL = f"""SELECT session_id AS session, CASE WHEN c % 3 = 0 THEN n * 10 + 50 ELSE n * 10 - 12 END AS moment, 'finalize' AS kind, CAST(NULL AS BOOLEAN) AS released FROM {_NUMBERED} WHERE c % 5 <> 1
    UNION ALL SELECT session_id, n * 10 - 3, 'finalize', CAST(NULL AS BOOLEAN) FROM {_NUMBERED} WHERE c % 7 = 2
    UNION ALL SELECT session_id, 1, 'finalize', CAST(NULL AS BOOLEAN) FROM {_NUMBERED} WHERE c % 8 = 4
    UNION ALL SELECT session_id, n * 10 - c % 40, 'delete', c % 16 = 0 FROM {_NUMBERED} WHERE c % 12 = 0 AND c % 36 <> 0
    UNION ALL SELECT session_id, n * 10 + 60, 'delete', c % 5 = 0 FROM {_NUMBERED} WHERE c % 24 = 0"""


def session_lifecycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.lifecycles(query(_WORK)(spark, sf_dir), query(_CONTROL)(spark, sf_dir))


#: Users as streams that ask for one of two things; what an engine says follows from the event.
_REQUESTS = """SELECT concat('u', user_id) AS stream, event_id AS ordinal, concat('m', (event_id + user_id) % 2) AS key, CAST(CASE event_type WHEN 'purchase' THEN 200 WHEN 'error' THEN 429 WHEN 'signup' THEN 503 WHEN 'click' THEN 400 ELSE 422 END AS INT) AS status FROM events"""


def rejected_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return rejections.answers(query(_REQUESTS)(spark, sf_dir))


#: One result a conversation, with faults by its number; the first in order counts.
_ROLES = "SELECT 'a0' AS agent_id, 'planner' AS role UNION ALL SELECT 'a1', 'worker' UNION ALL SELECT 'a2', 'helper' UNION ALL SELECT CAST(NULL AS STRING), 'legacy'"
_CONVERSATIONS = "(SELECT conv_id, agent_id, max(segment_index) AS last_segment FROM turns GROUP BY conv_id, agent_id) c"


def trial_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = lambda sql: query(sql)(spark, sf_dir)
    number = lambda i: f"conv_id % 40 = {i}"
    allocations = q(f"SELECT concat('t', conv_id % 5) AS task_id, conv_id AS slot, attempt, CASE WHEN {number(1)} AND attempt = 1 THEN concat('c', conv_id) ELSE concat('c', conv_id, '-', attempt) END AS session_id FROM (SELECT conv_id, explode(sequence(0, 1)) AS attempt FROM {_CONVERSATIONS}) x UNION ALL SELECT 't1', conv_id, 2, concat('c', conv_id) FROM {_CONVERSATIONS} WHERE {number(1)}")
    results = q(f"""SELECT result, concat('t', conv_id % 5) AS task_id, CASE WHEN {number(4)} THEN -1 - conv_id ELSE conv_id END AS slot, CASE WHEN {number(3)} THEN -1 ELSE 1 END AS attempt,
        CASE WHEN {number(2)} THEN '' WHEN {number(1)} THEN concat('c', conv_id) WHEN {number(6)} THEN concat('c', conv_id, '-0') ELSE concat('c', conv_id, '-1') END AS session_id, map('score', CASE WHEN {number(7)} THEN CAST('NaN' AS DOUBLE) ELSE 1.0D END) AS scores
        FROM (SELECT *, conv_id * 2 AS result FROM {_CONVERSATIONS} UNION ALL SELECT *, conv_id * 2 + 1 FROM {_CONVERSATIONS} WHERE {number(5)}) x WHERE NOT {number(0)}""")
    streams = q(f"""SELECT conv_id * 2 AS result, segment_index AS place, CASE WHEN {number(9)} THEN 'other' WHEN {number(6)} THEN concat('c', conv_id, '-0') WHEN {number(1)} THEN concat('c', conv_id) ELSE concat('c', conv_id, '-1') END AS session_id, CASE WHEN {number(11)} THEN 'a9' ELSE s.agent_id END AS agent_id,
        CASE WHEN {number(12)} THEN segment_index + 1 ELSE segment_index END AS segment_index, CASE WHEN {number(10)} THEN 'worker2' ELSE r.role END AS role, NOT {number(8)} AS valid
        FROM (SELECT DISTINCT conv_id, agent_id, segment_index FROM turns) s JOIN ({_ROLES}) r ON s.agent_id IS NOT DISTINCT FROM r.agent_id""")
    completions = q(f"SELECT conv_id * 2 AS result, agent_id, CASE WHEN {number(12)} THEN segment_index + 1 ELSE segment_index END AS segment_index, turn_ordinal AS start, turn_ordinal + n_completion AS end, weight_version, map('top_p', top_p, 'temperature', 1.0D) AS sampling_params FROM turns")
    return trials.validate(results, allocations, streams, completions, q(_ROLES), ["planner", "worker", "legacy"], {"top_p": 1, "temperature": 1}, "7")


def wired_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses around each document's source, in all spellings, with none, one, as many or too many keys."""
    address = "concat(' http://', source, CASE (doc_id + {i}) % 4 WHEN 0 THEN '' WHEN 1 THEN '/' WHEN 2 THEN '/v1' ELSE '/v1//' END, '\t')"
    one, two = address.format(i=0), address.format(i=1)
    d = read(spark, sf_dir, "documents").selectExpr(
        "doc_id", f"CASE doc_id % 9 WHEN 5 THEN array() WHEN 6 THEN array({one}, ' /v1/') WHEN 7 THEN array({one}) ELSE array({one}, {two}) END AS urls",
        "CASE doc_id % 9 WHEN 0 THEN NULL WHEN 1 THEN array('k') WHEN 2 THEN array('k', 'l') WHEN 3 THEN array('k', 'l', 'm') WHEN 4 THEN array() ELSE array('k') END AS keys",
    )
    r = d.select("doc_id", endpoints.wired(F.col("urls"), F.col("keys")).alias("r"))
    shown = F.array_join(F.transform("r.endpoints", lambda e: F.concat_ws("|", e["root"], F.coalesce(e["key"], F.lit("-")))), " ")
    return r.select("doc_id", shown.alias("endpoints"), "r.error")


def error_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of the control log as lines of their session's file in the run's folder, in order."""
    e = read(spark, sf_dir, "events").where("event_type = 'error'")
    run = F.date_format("ts", "yyyy-MM-dd'T'HH")
    rows = e.select(run.alias("run_ts"), F.concat(F.lit("u"), "user_id").alias("session_id"), "ts", "event_id", F.concat(F.lit("lost "), F.col("event_id").cast("string")).alias("message"))
    lines = rows.withColumn("line", records.error_line(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.col("message"))).withColumn("place", F.row_number().over(Window.partitionBy("run_ts", "session_id").orderBy("ts", "event_id")).cast("bigint"))
    folder = F.concat(F.lit("base/run_ts="), F.replace("run_ts", F.lit(":"), F.lit("%3A")))
    return lines.select(folder.alias("folder"), "session_id", "place", "line")


QUERIES = {"endpoints": wired_endpoints, "error_lines": error_lines, "session_lifecycles": session_lifecycles, "rejected_requests": rejected_requests, "trial_validation": trial_validation}
#: Without a sweep: what runs at a moment is counted anew for every moment that could be the one.
ORACLE = {
    "endpoints": """SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN concat(u, '|- ', u, '|-') WHEN 1 THEN concat(u, '|k ', u, '|k') WHEN 2 THEN concat(u, '|k ', u, '|l') WHEN 7 THEN concat(u, '|k') WHEN 8 THEN concat(u, '|k ', u, '|k') END AS endpoints,
        CASE doc_id % 9 WHEN 3 THEN 'keys' WHEN 4 THEN 'keys' WHEN 5 THEN 'none' WHEN 6 THEN 'blank' END AS error FROM (SELECT doc_id, 'http://' || source AS u FROM documents) q""",
    "error_lines": """SELECT 'base/run_ts=' || strftime(ts, '%Y-%m-%dT%H') AS folder, 'u' || user_id AS session_id, (SELECT count(*) FROM events b WHERE b.event_type = 'error' AND b.user_id = e.user_id AND strftime(b.ts, '%Y-%m-%dT%H') = strftime(e.ts, '%Y-%m-%dT%H') AND (b.ts < e.ts OR b.ts = e.ts AND b.event_id <= e.event_id)) AS place,
        '[' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '] lost ' || event_id AS line FROM events e WHERE event_type = 'error'""",
    "rejected_requests": f"""WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY ordinal) AS n FROM ({_REQUESTS}) q),
        f AS (SELECT stream, CAST(0 AS BIGINT) AS n, CAST(-1 AS BIGINT) AS ordinal, TRUE AS sent, 0 AS answered, CAST(NULL AS VARCHAR) AS held, 0 AS times, 0 AS kept FROM r WHERE n = 1
            UNION ALL SELECT stream, n, ordinal, NOT served, CASE WHEN served THEN kept ELSE status END, CASE WHEN served THEN held WHEN status = 200 THEN NULL WHEN final THEN key ELSE held END,
                CASE WHEN served THEN times WHEN status = 200 THEN 0 WHEN final THEN CASE WHEN held = key THEN times + 1 ELSE 1 END ELSE times END, CASE WHEN NOT served AND final THEN status ELSE kept END
            FROM (SELECT r.*, f.held, f.times, f.kept, coalesce(f.held = r.key AND f.times >= 2, FALSE) AS served, r.status IN (400, 422) AS final FROM f JOIN r ON r.stream = f.stream AND r.n = f.n + 1) x)
        SELECT stream, ordinal, sent, answered, times AS attempts FROM f WHERE n > 0""",
    "trial_validation": f"""WITH {DUCK_TURNS}, c AS (SELECT conv_id, min(agent_id) AS agent_id, bool_or(n_completion > 0 AND weight_version <> '7') AS stale, bool_or(n_completion > 0 AND top_p <> 1) AS other FROM turns GROUP BY conv_id),
        v AS (SELECT conv_id, CASE conv_id % 40 WHEN 0 THEN 'missing' WHEN 1 THEN 'allocation' WHEN 2 THEN 'session' WHEN 3 THEN 'attempt_number' WHEN 4 THEN 'slot' WHEN 6 THEN 'attempt' WHEN 7 THEN 'scores' WHEN 8 THEN 'stream' WHEN 9 THEN 'identity' WHEN 10 THEN 'role' WHEN 11 THEN 'role'
            ELSE CASE WHEN stale AND coalesce(agent_id, '') <> 'a2' THEN 'weight_version' WHEN other AND coalesce(agent_id, '') <> 'a2' THEN 'sampling' WHEN conv_id % 40 = 12 THEN 'segments' ELSE 'ok' END END AS verdict FROM c)
        SELECT concat('t', conv_id % 5) AS task_id, CASE WHEN conv_id % 40 = 4 THEN -1 - conv_id ELSE conv_id END AS slot, CASE WHEN verdict <> 'missing' THEN conv_id * 2 END AS result, verdict FROM v
        UNION ALL SELECT concat('t', conv_id % 5), conv_id, conv_id * 2 + 1, 'slot' FROM v WHERE conv_id % 40 = 5 UNION ALL SELECT concat('t', conv_id % 5), conv_id, NULL, 'missing' FROM v WHERE conv_id % 40 = 4""",
    "session_lifecycles": f"""WITH {DUCK_TURNS}, work AS ({_WORK}), control AS ({_CONTROL}),
        s AS (SELECT session, min(accepted_at) AS first, (SELECT min(moment) FROM control c WHERE c.session = w.session AND kind = 'delete') AS gone, (SELECT bool_or(released) FROM control c WHERE c.session = w.session AND kind = 'delete') AS released FROM work w GROUP BY session),
        t AS (SELECT *, (SELECT min(moment) FROM control c WHERE c.session = s.session AND kind = 'finalize' AND moment >= first AND moment < coalesce(gone, 999999999)) AS sealed FROM s),
        w AS (SELECT work.*, t.sealed, accepted_at < coalesce(gone, 999999999) AND accepted_at <= coalesce(sealed, 999999999) AS ok, least(coalesce(done_at, 999999999), coalesce(gone, 999999999)) AS ended FROM work JOIN t ON t.session = work.session),
        m AS (SELECT session, sealed, accepted_at AS x FROM w WHERE ok UNION SELECT session, sealed, ended FROM w WHERE ok AND ended < 999999999 UNION SELECT session, sealed, sealed FROM w WHERE sealed IS NOT NULL AND ok),
        r AS (SELECT m.session, m.x, m.sealed, count(*) FILTER (w.accepted_at <= m.x AND w.ended > m.x) AS after, count(*) FILTER (w.accepted_at <= m.x AND w.ended >= m.x) AS during FROM m JOIN w ON w.session = m.session AND w.ok GROUP BY m.session, m.x, m.sealed),
        q AS (SELECT session, max(during) AS most_running, min(x) FILTER (x >= sealed AND after = 0) AS drained_at FROM r GROUP BY session),
        n AS (SELECT session, count(*) FILTER (ok) AS n_admitted, count(*) FILTER (NOT ok) AS n_refused, bool_or(ok AND lost) AS lost FROM w GROUP BY session)
        SELECT t.session, n_admitted, n_refused, coalesce(most_running, 0) AS most_running, sealed AS sealed_at, drained_at, CASE WHEN gone IS NOT NULL THEN CASE WHEN released THEN 'deleted' ELSE 'release_failed' END WHEN sealed IS NULL THEN 'open' WHEN drained_at IS NULL THEN 'draining' WHEN lost THEN 'failed' ELSE 'finalized' END AS state
        FROM t JOIN n ON n.session = t.session LEFT JOIN q ON q.session = t.session""",
}
