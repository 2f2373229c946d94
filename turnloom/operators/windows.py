"""Window-like operators over turns: sequences, spans, extents, deltas and duplicates.

All windows are keyed by session or stream, so a shuffle by key is all that they need.
"""

STREAM = "PARTITION BY session_id, agent_id"
SEGMENT = "PARTITION BY session_id, agent_id, segment_index"

QUERIES = {
    # spans of completions in their segment's token stream; empty completions have empty spans
    "training_spans": f"""
        SELECT session_id, agent_id, segment_index, turn_ordinal, purpose, span_end - n_completion AS span_start, span_end
        FROM (SELECT *, CAST(sum(n_prompt + n_completion) OVER ({SEGMENT} ORDER BY turn_ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS span_end FROM turns) q""",
    # offsets at which nonempty completions end
    "completion_ends": f"""
        SELECT session_id, agent_id, segment_index, span_end AS completion_end
        FROM (SELECT *, CAST(sum(n_prompt + n_completion) OVER ({SEGMENT} ORDER BY turn_ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS span_end FROM turns) q
        WHERE n_completion > 0""",
    # a turn's segment must be its stream's last one, or the next one if the turn resets
    "segment_sequence": f"""
        SELECT session_id, agent_id, turn_ordinal, segment_index, expected, segment_index = expected AS ok
        FROM (SELECT session_id, agent_id, turn_ordinal, seen AS segment_index,
                coalesce(lag(seen) OVER ({STREAM} ORDER BY turn_ordinal), -1) + CASE WHEN new_conversation OR lag(seen) OVER ({STREAM} ORDER BY turn_ordinal) IS NULL THEN 1 ELSE 0 END AS expected
            FROM (SELECT session_id, agent_id, turn_ordinal, new_conversation, CASE WHEN conv_id % 13 = 0 AND tn = 1 THEN segment_index + 1 ELSE segment_index END AS seen FROM turns) a) b""",
    # messages and tokens since a stream's last reset
    "conversation_extent": f"""
        SELECT session_id, agent_id, turn_ordinal, resets,
            CAST(sum(n_messages) OVER (PARTITION BY session_id, agent_id, resets ORDER BY turn_ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS n_messages_since,
            CAST(sum(n_prompt + n_completion) OVER (PARTITION BY session_id, agent_id, resets ORDER BY turn_ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS n_tokens_since
        FROM (SELECT *, CAST(sum(CASE WHEN new_conversation THEN 1 ELSE 0 END) OVER ({STREAM} ORDER BY turn_ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS resets FROM turns) q""",
    # place of the last reset at or before each turn
    "last_reset": f"""
        SELECT session_id, agent_id, turn_ordinal, max(CASE WHEN new_conversation THEN turn_ordinal END) OVER ({STREAM} ORDER BY turn_ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS reset_at
        FROM turns""",
    # a continuation stores only what lies beyond the stream before it; one that does not grow is refused
    "delta_encoding": f"""
        SELECT session_id, agent_id, segment_index, turn_ordinal, full_len, stored_len,
            CASE WHEN full_len > stored_len THEN full_len - stored_len ELSE 0 END AS delta_len,
            full_len > stored_len OR stored_len = 0 AS accepted,
            CASE WHEN full_len > stored_len THEN @sha(substr(full_prompt, CAST(stored_len AS INT) + 1)) END AS delta_sha
        FROM (SELECT session_id, agent_id, segment_index, turn_ordinal, prompt AS delta, CAST(before_len AS BIGINT) AS stored_len, CAST(before_len + CASE WHEN conv_id % 17 = 4 AND tn % 3 = 1 THEN 0 ELSE n_prompt END AS BIGINT) AS full_len, concat(repeat('#', CAST(before_len AS INT)), prompt) AS full_prompt
            FROM (SELECT *, coalesce(sum(n_prompt + n_completion) OVER ({SEGMENT} ORDER BY turn_ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_len FROM turns) a) b""",
    # runs of one delivery sent again: same messages, completion, stream length and purpose as the agent's own last turn
    "duplicate_deliveries": f"""
        SELECT session_id, agent_id, delivery, turn_ordinal, again, again AND before_sha = completion_sha AND before_purpose = purpose AND before_messages = n_messages AND before_full = n_full AND before_segment = segment_index AS dropped
        FROM (SELECT *, lag(completion_sha) OVER ({STREAM} ORDER BY turn_ordinal, delivery) AS before_sha, lag(purpose) OVER ({STREAM} ORDER BY turn_ordinal, delivery) AS before_purpose, lag(n_messages) OVER ({STREAM} ORDER BY turn_ordinal, delivery) AS before_messages,
                lag(n_full) OVER ({STREAM} ORDER BY turn_ordinal, delivery) AS before_full, lag(segment_index) OVER ({STREAM} ORDER BY turn_ordinal, delivery) AS before_segment
            FROM (SELECT session_id, agent_id, segment_index, turn_ordinal, purpose, n_messages, n_prompt AS n_full, 0 AS delivery, FALSE AS again, @sha(completion) AS completion_sha FROM turns
                UNION ALL SELECT session_id, agent_id, segment_index, turn_ordinal, CASE WHEN conv_id % 6 = 0 THEN 'auxiliary' ELSE purpose END, n_messages, n_prompt + CASE WHEN conv_id % 9 = 6 THEN 1 ELSE 0 END, 1, TRUE, @sha(completion) FROM turns WHERE conv_id % 3 = 0) a) b""",
    # endpoints are dealt in turn by a stream's first use
    "sticky_endpoints": """
        SELECT session_id, agent_id, CAST((row_number() OVER (ORDER BY first_conv, session_id, agent_id) - 1) % 3 AS BIGINT) AS endpoint
        FROM (SELECT session_id, agent_id, min(conv_id) AS first_conv FROM turns GROUP BY session_id, agent_id) q""",
    # the model that a session is stamped with: its first turn that names one
    "model_stamp": """
        SELECT t.session_id, min(CASE WHEN t.turn_ordinal = f.first_named THEN CASE WHEN t.conv_id % 3 = 1 THEN 'model-b' ELSE 'model-a' END END) AS model_name
        FROM turns t LEFT JOIN (SELECT session_id, min(turn_ordinal) AS first_named FROM turns WHERE conv_id % 3 <> 0 GROUP BY session_id) f ON t.session_id = f.session_id
        GROUP BY t.session_id""",
    # version spans of a turn: contiguous from 0, of positive length, covering all tokens, of one version
    "version_spans": """
        SELECT conv_id, tn, count(*) AS n_spans, bool_and(span_start = expected AND span_end > span_start) AS contiguous, max(span_end) = max(n_completion) AS covers, count(DISTINCT version) = 1 AS one_version
        FROM (SELECT conv_id, tn, n_completion, version, span_start, span_end, coalesce(lag(span_end) OVER (PARTITION BY conv_id, tn ORDER BY piece), 0) AS expected
            FROM (SELECT conv_id, tn, n_completion, 0 AS piece, CAST(0 AS BIGINT) AS span_start, CAST(floor(n_completion / 2) AS BIGINT) AS span_end, weight_version AS version FROM turns WHERE n_completion > 1
                UNION ALL SELECT conv_id, tn, n_completion, 1, CAST(floor(n_completion / 2) AS BIGINT) + CASE WHEN conv_id % 19 = 2 THEN 1 ELSE 0 END, n_completion, CASE WHEN conv_id % 23 = 5 THEN '9' ELSE weight_version END FROM turns WHERE n_completion > 1) a) b
        GROUP BY conv_id, tn""",
}

_UPTO = """(SELECT t.*, (SELECT CAST(sum(b.n_prompt + b.n_completion) AS BIGINT) FROM turns b WHERE b.session_id = t.session_id AND b.agent_id IS NOT DISTINCT FROM t.agent_id AND b.segment_index = t.segment_index AND b.turn_ordinal <= t.turn_ordinal) AS n_upto FROM turns t)"""
#: SQL for DuckDB that says the same in another way.
ORACLES = {
    # running lengths as sums over all turns up to each one
    "training_spans": f"SELECT a.session_id, a.agent_id, a.segment_index, a.turn_ordinal, a.purpose, n_upto - a.n_completion AS span_start, n_upto AS span_end FROM {_UPTO} a",
    "completion_ends": f"SELECT a.session_id, a.agent_id, a.segment_index, n_upto AS completion_end FROM {_UPTO} a WHERE a.n_completion > 0",
    "segment_sequence": """SELECT a.session_id, a.agent_id, a.turn_ordinal, a.seen AS segment_index, CASE WHEN p.seen IS NULL THEN 0 WHEN a.new_conversation THEN p.seen + 1 ELSE p.seen END AS expected, a.seen = CASE WHEN p.seen IS NULL THEN 0 WHEN a.new_conversation THEN p.seen + 1 ELSE p.seen END AS ok
        FROM (SELECT *, coalesce(agent_id, '-') AS a, segment_index + CASE WHEN conv_id % 13 = 0 AND tn = 1 THEN 1 ELSE 0 END AS seen FROM turns) a
        ASOF LEFT JOIN (SELECT *, coalesce(agent_id, '-') AS a, segment_index + CASE WHEN conv_id % 13 = 0 AND tn = 1 THEN 1 ELSE 0 END AS seen FROM turns) p ON p.session_id = a.session_id AND p.a = a.a AND a.turn_ordinal > p.turn_ordinal""",
    "conversation_extent": """SELECT a.session_id, a.agent_id, a.turn_ordinal, a.resets, CAST(sum(b.n_messages) AS BIGINT) AS n_messages_since, CAST(sum(b.n_prompt + b.n_completion) AS BIGINT) AS n_tokens_since
        FROM (SELECT t.session_id, t.agent_id, t.turn_ordinal, count(r.turn_ordinal) AS resets, coalesce(max(r.turn_ordinal), 0) AS since FROM turns t LEFT JOIN turns r ON r.session_id = t.session_id AND r.agent_id IS NOT DISTINCT FROM t.agent_id AND r.new_conversation AND r.turn_ordinal <= t.turn_ordinal GROUP BY t.session_id, t.agent_id, t.turn_ordinal) a
        JOIN turns b ON b.session_id = a.session_id AND b.agent_id IS NOT DISTINCT FROM a.agent_id AND b.turn_ordinal BETWEEN a.since AND a.turn_ordinal GROUP BY a.session_id, a.agent_id, a.turn_ordinal, a.resets""",
    "last_reset": "SELECT t.session_id, t.agent_id, t.turn_ordinal, max(r.turn_ordinal) AS reset_at FROM turns t LEFT JOIN turns r ON r.session_id = t.session_id AND r.agent_id IS NOT DISTINCT FROM t.agent_id AND r.new_conversation AND r.turn_ordinal <= t.turn_ordinal GROUP BY t.session_id, t.agent_id, t.turn_ordinal",
    # what lies beyond the stream is the turn's own prompt
    "delta_encoding": f"""SELECT session_id, agent_id, segment_index, turn_ordinal, stored_len + n AS full_len, stored_len, n AS delta_len, n > 0 OR stored_len = 0 AS accepted, CASE WHEN n > 0 THEN sha256(prompt) END AS delta_sha
        FROM (SELECT *, n_upto - n_prompt - n_completion AS stored_len, CASE WHEN conv_id % 17 = 4 AND tn % 3 = 1 THEN 0 ELSE n_prompt END AS n FROM {_UPTO} a) q""",
    "duplicate_deliveries": """SELECT session_id, agent_id, 0 AS delivery, turn_ordinal, FALSE AS again, FALSE AS dropped FROM turns
        UNION ALL SELECT session_id, agent_id, 1, turn_ordinal, TRUE, (conv_id % 6 <> 0 OR purpose = 'auxiliary') AND conv_id % 9 <> 6 FROM turns WHERE conv_id % 3 = 0""",
    "model_stamp": "SELECT session_id, arg_min(CASE WHEN conv_id % 3 = 1 THEN 'model-b' ELSE 'model-a' END, turn_ordinal) FILTER (conv_id % 3 <> 0) AS model_name FROM turns GROUP BY session_id",
    "version_spans": "SELECT conv_id, tn, CAST(2 AS BIGINT) AS n_spans, conv_id % 19 <> 2 AS contiguous, TRUE AS covers, conv_id % 23 <> 5 OR weight_version = '9' AS one_version FROM turns WHERE n_completion > 1",
}
