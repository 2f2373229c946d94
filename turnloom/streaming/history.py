"""State machines over an ordered control log, as batch queries.

events are the log: error deletes, signup pushes a policy or finalizes, purchase is a turn, click
a retry, view a fetch. Times are explicit, so a time to live is a comparison.
"""

QUERIES = {
    # a delete refuses its session's later turns for an hour; an exact hour is over
    "tombstones": """
        SELECT event_id, deleted_at IS NOT NULL AND ts < deleted_at + INTERVAL '3600' SECOND AS refused
        FROM (SELECT event_id, event_type, ts, max(CASE WHEN event_type = 'error' THEN ts END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS deleted_at FROM events) q
        WHERE event_type = 'purchase'""",
    # at most the newest 8192 tombstones are kept
    "kept_tombstones": "SELECT user_id, max(ts) AS deleted_at FROM events WHERE event_type = 'error' GROUP BY user_id ORDER BY deleted_at DESC, user_id LIMIT 8192",
    # open until sealed; a delete goes above all, a failure above a seal
    "session_states": """
        SELECT event_id, CASE WHEN deletes > 0 THEN 'deleted' WHEN failures > 0 AND seals > 0 THEN 'failed' WHEN seals > 0 THEN 'finalized' WHEN turns_before > 0 THEN 'open' ELSE 'unknown' END AS state
        FROM (SELECT event_id, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER w AS deletes, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER w AS seals, sum(CASE WHEN event_type = 'purchase' AND value < 5 THEN 1 ELSE 0 END) OVER w AS failures, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER w AS turns_before
            FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) q""",
    # the policy in force when a turn began: the last push before it; an empty push (k = 0) clears
    "policy_in_force": """
        SELECT event_id, CASE WHEN k = 0 THEN NULL ELSE k END AS top_k
        FROM (SELECT e.event_id, e.event_type, max_k.k FROM (SELECT *, max(CASE WHEN event_type = 'signup' THEN event_id END) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS push FROM events) e
            LEFT JOIN (SELECT event_id, CAST(@json(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type = 'signup') max_k ON e.push = max_k.event_id) q
        WHERE event_type = 'purchase'""",
    # a committed turn is replayed four times, then refused
    "replays": """
        SELECT event_id, place, place <= 4 AS replayed
        FROM (SELECT event_id, event_type, CAST(row_number() OVER (PARTITION BY user_id, turns_before, event_type ORDER BY ts, event_id) AS BIGINT) AS place
            FROM (SELECT *, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS turns_before FROM events) a) b
        WHERE event_type = 'click'""",
    # a rejected request reaches the engine twice, then its rejection is served from the slot; a success clears it
    "rejections": """
        SELECT event_id, place, place <= 2 AS reached_engine
        FROM (SELECT event_id, event_type, CAST(row_number() OVER (PARTITION BY user_id, run, event_type ORDER BY ts, event_id) AS BIGINT) AS place
            FROM (SELECT *, sum(CASE WHEN event_type = 'purchase' OR event_type = 'view' AND CAST(@json(props, '$.k') AS BIGINT) % 7 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM events) a) b
        WHERE event_type = 'error'""",
    # a stream's first model pins it; another name is refused, none is fine
    "model_pins": """
        SELECT event_id, asked, pinned, asked IS NULL OR asked = pinned AS ok
        FROM (SELECT e.event_id, e.asked, f.asked AS pinned FROM (SELECT event_id, user_id, CASE CAST(@json(props, '$.k') AS BIGINT) % 5 WHEN 0 THEN NULL WHEN 1 THEN 'model-b' ELSE 'model-a' END AS asked FROM events WHERE event_type = 'purchase') e
            LEFT JOIN (SELECT user_id, asked FROM (SELECT user_id, CASE CAST(@json(props, '$.k') AS BIGINT) % 5 WHEN 0 THEN NULL WHEN 1 THEN 'model-b' ELSE 'model-a' END AS asked, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS place FROM events WHERE event_type = 'purchase' AND CAST(@json(props, '$.k') AS BIGINT) % 5 <> 0) p WHERE place = 1) f ON e.user_id = f.user_id) q""",
    # the last push replaces the whole layer
    "runtime_layer": "SELECT user_id, k AS top_k FROM (SELECT user_id, CAST(@json(props, '$.k') AS BIGINT) AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events WHERE event_type = 'signup') q WHERE place = 1",
    # a runtime switch goes above the configured one; null restores it
    "capture_switch": "SELECT event_id, coalesce(CASE CAST(@json(props, '$.k') AS BIGINT) % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END, user_id % 2 = 0) AS effective FROM events WHERE event_type = 'signup'",
    # the newest version of a session's snapshot is the one that stays
    "latest_snapshots": "SELECT user_id, event_id AS version, props AS payload FROM (SELECT user_id, event_id, props, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS place FROM events WHERE event_type = 'purchase') q WHERE place = 1",
    # sessions that can be fetched: known, and without an unresolved failure
    "session_fetch": """
        SELECT user_id, n_turns FROM (SELECT user_id, count(*) AS n_turns FROM events WHERE event_type = 'purchase' GROUP BY user_id) s
        WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = s.user_id AND e.event_type = 'error' AND e.value > 40)""",
    # turns of sessions that were deleted before: the side output of late data
    "late_turns": """
        SELECT p.event_id FROM events p JOIN (SELECT user_id, min(ts) AS first_delete FROM events WHERE event_type = 'error' GROUP BY user_id) d ON p.user_id = d.user_id
        WHERE p.event_type = 'purchase' AND p.ts > d.first_delete""",
    # one turn at a time: a turn waits for the end of every earlier one of its stream; events last value seconds
    "waiting_turns": """
        SELECT event_id, before_end IS NOT NULL AND ts < before_end AS waits
        FROM (SELECT event_id, ts, max(ends) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before_end
            FROM (SELECT event_id, user_id, ts, ts + CAST(floor(value * 60) AS INT) * INTERVAL '1' SECOND AS ends FROM events WHERE event_type = 'purchase') a) b""",
    # failures that block a collection: the first of each session, until an equal delivery succeeds
    "recording_failures": """
        SELECT f.user_id, f.first_failure, EXISTS (SELECT 1 FROM events c WHERE c.user_id = f.user_id AND c.event_type = 'click' AND c.event_id > f.first_failure AND @json(c.props, '$.k') = f.k) AS repaired
        FROM (SELECT user_id, event_id AS first_failure, @json(props, '$.k') AS k FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS place FROM events WHERE event_type = 'error') a WHERE place = 1) f""",
}

_NUMBERED = "o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)"


def _since(counts: str, resets: str) -> str:
    """SQL of the place of each counted event o behind the last event p that resets."""
    return f"""c AS (SELECT o.event_id, o.user_id, o.rn, coalesce(max(p.rn), 0) AS since FROM o LEFT JOIN o p ON p.user_id = o.user_id AND p.rn < o.rn AND {resets} WHERE {counts} GROUP BY o.event_id, o.user_id, o.rn),
        counted AS (SELECT c.event_id, count(*) AS place FROM c JOIN o ON o.user_id = c.user_id AND o.rn > c.since AND o.rn <= c.rn AND {counts} GROUP BY c.event_id)"""


#: SQL for DuckDB that says the same in another way.
ORACLES = {
    "tombstones": """SELECT event_id, EXISTS (SELECT 1 FROM events d WHERE d.user_id = e.user_id AND d.event_type = 'error' AND (d.ts < e.ts OR d.ts = e.ts AND d.event_id < e.event_id) AND d.ts > e.ts - INTERVAL '3600' SECOND) AS refused
        FROM events e WHERE event_type = 'purchase'""",
    "kept_tombstones": "SELECT user_id, max(ts) AS deleted_at FROM events WHERE event_type = 'error' GROUP BY user_id QUALIFY rank() OVER (ORDER BY max(ts) DESC, user_id) <= 8192",
    # a state lasts from the first event that brings it
    "session_states": f"""WITH {_NUMBERED}, f AS (SELECT user_id, min(rn) FILTER (event_type = 'error') AS gone, min(rn) FILTER (event_type = 'signup') AS sealed, min(rn) FILTER (event_type = 'purchase' AND value < 5) AS failed, min(rn) FILTER (event_type = 'purchase') AS met FROM o GROUP BY user_id)
        SELECT event_id, CASE WHEN rn >= gone THEN 'deleted' WHEN rn >= failed AND rn >= sealed THEN 'failed' WHEN rn >= sealed THEN 'finalized' WHEN rn >= met THEN 'open' ELSE 'unknown' END AS state FROM o JOIN f ON f.user_id = o.user_id""",
    # equal events since the last one that resets, counted one by one
    "replays": f"""WITH {_NUMBERED}, {_since("o.event_type = 'click'", "p.event_type = 'purchase'")} SELECT event_id, place, place <= 4 AS replayed FROM counted""",
    "rejections": f"""WITH {_NUMBERED}, {_since("o.event_type = 'error'", "(p.event_type = 'purchase' OR p.event_type = 'view' AND CAST(json_extract_string(p.props, '$.k') AS BIGINT) % 7 = 0)")} SELECT event_id, place, place <= 2 AS reached_engine FROM counted""",
    "model_pins": """WITH a AS (SELECT event_id, user_id, [NULL, 'model-b', 'model-a', 'model-a', 'model-a'][CAST(json_extract_string(props, '$.k') AS BIGINT) % 5 + 1] AS asked FROM events WHERE event_type = 'purchase'),
        p AS (SELECT user_id, arg_min(asked, event_id) AS pinned FROM a WHERE asked IS NOT NULL GROUP BY user_id) SELECT event_id, asked, pinned, asked IS NULL OR asked = pinned AS ok FROM a LEFT JOIN p ON p.user_id = a.user_id""",
    "runtime_layer": "SELECT user_id, list(CAST(json_extract_string(props, '$.k') AS BIGINT) ORDER BY ts, event_id)[-1] AS top_k FROM events WHERE event_type = 'signup' GROUP BY user_id",
    "capture_switch": "SELECT event_id, coalesce([TRUE, FALSE, NULL][CAST(json_extract_string(props, '$.k') AS BIGINT) % 3 + 1], user_id % 2 = 0) AS effective FROM events WHERE event_type = 'signup'",
    "latest_snapshots": "SELECT user_id, max(event_id) AS version, arg_max(props, event_id) AS payload FROM events WHERE event_type = 'purchase' GROUP BY user_id",
    "session_fetch": "SELECT user_id, count(*) FILTER (event_type = 'purchase') AS n_turns FROM events GROUP BY user_id HAVING count(*) FILTER (event_type = 'purchase') > 0 AND count(*) FILTER (event_type = 'error' AND value > 40) = 0",
    "late_turns": "SELECT event_id FROM events p WHERE event_type = 'purchase' AND EXISTS (SELECT 1 FROM events d WHERE d.user_id = p.user_id AND d.event_type = 'error' AND d.ts < p.ts)",
    "waiting_turns": """SELECT event_id, EXISTS (SELECT 1 FROM events b WHERE b.user_id = e.user_id AND b.event_type = 'purchase' AND (b.ts < e.ts OR b.ts = e.ts AND b.event_id < e.event_id) AND b.ts + CAST(floor(b.value * 60) AS INT) * INTERVAL '1' SECOND > e.ts) AS waits
        FROM events e WHERE event_type = 'purchase'""",
    "recording_failures": """SELECT f.user_id, f.first_failure, coalesce(bool_or(json_extract_string(c.props, '$.k') = f.k), FALSE) AS repaired
        FROM (SELECT user_id, min(event_id) AS first_failure, arg_min(json_extract_string(props, '$.k'), event_id) AS k FROM events WHERE event_type = 'error' GROUP BY user_id) f
        LEFT JOIN events c ON c.user_id = f.user_id AND c.event_type = 'click' AND c.event_id > f.first_failure GROUP BY f.user_id, f.first_failure""",
}
