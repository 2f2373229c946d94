"""Validators as rule tables: a record passes if none of its rules fails.

first_error keeps the precedence of validators that stop at the first failure: the failing rule
of the least number.
"""

_FAULTY = """faulty AS (SELECT session_id, agent_id, turn_ordinal, conv_id, tn, n_prompt, n_completion, segment_index,
                CASE WHEN conv_id % 13 = 0 THEN n_completion - 1 ELSE n_completion END AS n_logprobs,
                CASE WHEN conv_id % 29 = 3 THEN 'unknown' ELSE purpose END AS purpose,
                CASE WHEN conv_id % 31 = 7 THEN -1 ELSE 5 END AS least_token,
                CASE WHEN conv_id % 37 = 2 THEN CAST('Infinity' AS DOUBLE) ELSE top_p END AS top_p
            FROM turns),
        rules AS (SELECT session_id, turn_ordinal, 1 AS rule_no, 'token_ids' AS rule_id, least_token >= 0 AS ok FROM faulty
            UNION ALL SELECT session_id, turn_ordinal, 2, 'purpose', purpose IN ('primary', 'compaction', 'auxiliary') FROM faulty
            UNION ALL SELECT session_id, turn_ordinal, 3, 'logprobs', n_logprobs = n_completion FROM faulty
            UNION ALL SELECT session_id, turn_ordinal, 4, 'sampling', abs(top_p) < CAST('Infinity' AS DOUBLE) FROM faulty)"""

QUERIES = {
    # token count of each segment
    "segment_lengths": "SELECT session_id, agent_id, segment_index, CAST(sum(n_prompt + n_completion) AS BIGINT) AS n_tokens FROM turns GROUP BY session_id, agent_id, segment_index",
    "turns_by_agent": "SELECT session_id, agent_id, count(*) AS n_turns FROM turns GROUP BY session_id, agent_id",
    "weight_versions": "SELECT session_id, count(DISTINCT weight_version) AS n_versions, count(DISTINCT weight_version) > 1 AS straddles FROM turns GROUP BY session_id",
    # a stream may not open with an empty prompt where logprobs are needed
    "leading_prompt": """
        SELECT session_id, agent_id, segment_index, turn_ordinal, NOT (n_completion > 0 AND shown = 0 AND before_len = 0) AS ok
        FROM (SELECT *, CASE WHEN conv_id % 9 = 1 THEN 0 ELSE n_prompt END AS shown, coalesce(sum(n_prompt + n_completion) OVER (PARTITION BY session_id, agent_id, segment_index ORDER BY turn_ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_len FROM turns) q""",
    # structural rules of records, one row for each record and rule, on records with planted faults
    "record_rules": f"""
        WITH {_FAULTY}
        SELECT session_id, rule_id, count(*) AS n_checked, sum(CASE WHEN ok THEN 0 ELSE 1 END) AS n_failed, min(CASE WHEN ok THEN NULL ELSE turn_ordinal END) AS first_failed
        FROM rules GROUP BY session_id, rule_id""",
    # turns are checked in order, each by the rules in order: the first failure is that of the least (turn, rule)
    "first_error": f"""
        WITH {_FAULTY}
        SELECT session_id, turn_ordinal AS first_turn, rule_id AS first_rule, n_errors
        FROM (SELECT session_id, turn_ordinal, rule_id, row_number() OVER (PARTITION BY session_id ORDER BY turn_ordinal, rule_no) AS place, count(*) OVER (PARTITION BY session_id) AS n_errors FROM rules WHERE NOT ok) q
        WHERE place = 1""",
    # every nonempty completion of a trained agent must have the expected version and policy; a missing one fails
    "sampling_policy": """
        WITH expected AS (SELECT 'top_p' AS param, CAST(1 AS DOUBLE) AS wanted UNION ALL SELECT 'temperature', CAST(1 AS DOUBLE)),
        actual AS (SELECT session_id, agent_id, turn_ordinal, weight_version, 'top_p' AS param, top_p AS got FROM turns WHERE n_completion > 0
            UNION ALL SELECT session_id, agent_id, turn_ordinal, weight_version, 'temperature', CASE WHEN conv_id % 15 = 4 THEN NULL ELSE CAST(1 AS DOUBLE) END FROM turns WHERE n_completion > 0)
        SELECT a.session_id, a.agent_id, count(*) AS n_checked, sum(CASE WHEN a.got = e.wanted THEN 0 ELSE 1 END) AS n_policy_failed, count(DISTINCT CASE WHEN a.weight_version = '7' THEN NULL ELSE a.turn_ordinal END) AS n_version_failed
        FROM actual a JOIN expected e ON a.param = e.param WHERE a.agent_id IN ('a0', 'a1') GROUP BY a.session_id, a.agent_id""",
    # a null agent is a key of its own: joined null-safely
    "agent_roles": """
        WITH roles AS (SELECT 'a0' AS agent_id, 'planner' AS role UNION ALL SELECT 'a1', 'worker' UNION ALL SELECT NULL, 'legacy')
        SELECT t.session_id, t.agent_id, r.role, count(*) AS n_turns, r.role IS NOT NULL AS registered
        FROM turns t LEFT JOIN roles r ON t.agent_id IS NOT DISTINCT FROM r.agent_id GROUP BY t.session_id, t.agent_id, r.role""",
    # segment indices of a stream are 0, 1, 2 and so on
    "segment_contiguity": """
        SELECT session_id, agent_id, min(segment_index) AS first_segment, max(segment_index) AS last_segment, min(segment_index) = 0 AND max(segment_index) = count(DISTINCT segment_index) - 1 AS contiguous
        FROM turns WHERE NOT (conv_id % 14 = 6 AND segment_index = 0) GROUP BY session_id, agent_id""",
    # trial results against their allocations: missing, surplus, doubled, wrong attempt, bad score
    "trial_results": """
        WITH allocations AS (SELECT lang AS task_id, doc_id AS slot, CAST(0 AS BIGINT) AS attempt, concat('s', CAST(doc_id AS @text)) AS session_id FROM documents WHERE doc_id % 10 <> 9),
        results AS (SELECT d.lang AS task_id, l.doc_id AS slot, CAST(CASE WHEN l.doc_id % 41 = 0 THEN 1 ELSE 0 END AS BIGINT) AS attempt, concat('s', CAST(l.doc_id AS @text)) AS session_id, CASE WHEN l.doc_id % 43 = 0 THEN CAST('NaN' AS DOUBLE) ELSE CAST(l.quality AS DOUBLE) END AS score
            FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
        counted AS (SELECT task_id, slot, count(*) AS n_results, min(attempt) AS attempt, min(session_id) AS session_id, max(CASE WHEN isnan(score) THEN 1 ELSE 0 END) AS bad_score FROM results GROUP BY task_id, slot)
        SELECT coalesce(a.task_id, r.task_id) AS task_id, coalesce(a.slot, r.slot) AS slot,
            CASE WHEN r.slot IS NULL THEN 'missing' WHEN a.slot IS NULL THEN 'unallocated' WHEN r.n_results > 1 THEN 'duplicate' WHEN r.attempt <> a.attempt OR r.session_id <> a.session_id THEN 'wrong_attempt' WHEN r.bad_score = 1 THEN 'bad_score' ELSE 'ok' END AS verdict
        FROM allocations a FULL OUTER JOIN counted r ON a.task_id = r.task_id AND a.slot = r.slot""",
    # session ids allocated more than once
    "allocation_uniqueness": """
        SELECT session_id, count(*) AS n_slots FROM (SELECT concat('s', CAST(CASE WHEN doc_id % 25 = 1 THEN doc_id - 1 ELSE doc_id END AS @text)) AS session_id FROM documents) q GROUP BY session_id HAVING count(*) > 1""",
    # streams with one key twice
    "stream_uniqueness": "SELECT session_id, agent_id, segment_index, count(*) AS n_streams FROM (SELECT session_id, agent_id, segment_index FROM turns WHERE new_conversation UNION ALL SELECT session_id, agent_id, segment_index FROM turns WHERE conv_id % 21 = 8 AND tn = 0) q GROUP BY session_id, agent_id, segment_index HAVING count(*) > 1",
    # expected and seen slots, both ways
    "slot_difference": """
        SELECT 'missing' AS side, slot FROM (SELECT doc_id AS slot FROM documents EXCEPT SELECT doc_id FROM labels) a
        UNION ALL SELECT 'surplus', slot FROM (SELECT doc_id AS slot FROM labels EXCEPT SELECT doc_id FROM documents WHERE doc_id % 50 <> 0) b""",
    # every nonempty selected segment has a capture of all but its last token
    "capture_coverage": """
        WITH lengths AS (SELECT session_id, agent_id, segment_index, CAST(sum(n_prompt + n_completion) AS BIGINT) AS n_tokens FROM turns GROUP BY session_id, agent_id, segment_index),
        captures AS (SELECT session_id, agent_id, segment_index, n_tokens - 1 - CASE WHEN segment_index = 1 THEN 1 ELSE 0 END AS n_rows FROM lengths WHERE agent_id IS NULL OR agent_id <> 'a2')
        SELECT l.session_id, l.agent_id, l.segment_index, l.n_tokens, c.n_rows, coalesce(c.n_rows = l.n_tokens - 1, FALSE) AS covered
        FROM lengths l LEFT JOIN captures c ON l.session_id = c.session_id AND l.agent_id IS NOT DISTINCT FROM c.agent_id AND l.segment_index = c.segment_index WHERE l.n_tokens > 0""",
    # captures of segments that do not exist
    "orphan_captures": """
        SELECT c.session_id, c.agent_id, c.segment_index FROM (SELECT session_id, agent_id, max(segment_index) + CASE WHEN session_id IN ('s1', 's3', 's7') THEN 1 ELSE 0 END AS segment_index FROM turns GROUP BY session_id, agent_id) c
        WHERE NOT EXISTS (SELECT 1 FROM turns t WHERE t.session_id = c.session_id AND t.agent_id IS NOT DISTINCT FROM c.agent_id AND t.segment_index = c.segment_index)""",
    # strict base64, and as many bytes as rows times columns
    "capture_blobs": """
        SELECT doc_id, data, n_rows, n_cols, @match(data, '^([A-Za-z0-9+/]{4})*([A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$') AS strict,
            n_rows >= 0 AND n_cols > 0 AND CASE WHEN @match(data, '^([A-Za-z0-9+/]{4})*([A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$') THEN CAST(length(data) AS BIGINT) * 3 / 4 - (length(data) - length(replace(data, '=', ''))) = n_rows * n_cols ELSE FALSE END AS ok
        FROM (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'AQID' WHEN 1 THEN 'AQI=' WHEN 2 THEN 'AQI' WHEN 3 THEN '!' WHEN 4 THEN '' ELSE 'AQIDBAUG' END AS data, CASE doc_id % 6 WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 4 THEN 0 ELSE 6 END AS n_rows, 1 AS n_cols FROM documents) q""",
    # tokens and logprobs of one response lie side by side
    "token_alignment": """
        SELECT conv_id, tn, n_completion AS n_tokens, n_logprobs, n_tokens_ok AND n_completion = n_logprobs AND n_completion > 0 AS accepted, CASE WHEN n_completion = 0 THEN 'empty' WHEN n_completion <> n_logprobs THEN 'length' WHEN NOT n_tokens_ok THEN 'token' ELSE NULL END AS reason
        FROM (SELECT conv_id, tn, n_completion, CASE WHEN conv_id % 12 = 5 THEN n_completion + 1 ELSE n_completion END AS n_logprobs, conv_id % 16 <> 9 AS n_tokens_ok FROM turns) q""",
}

_EACH = """SELECT session_id, turn_ordinal, n_completion, conv_id,
        list_filter([CASE WHEN conv_id % 31 = 7 THEN 'token_ids' END, CASE WHEN conv_id % 29 = 3 THEN 'purpose' END, CASE WHEN conv_id % 13 = 0 THEN 'logprobs' END, CASE WHEN conv_id % 37 = 2 THEN 'sampling' END], lambda x: x IS NOT NULL) AS failed FROM turns"""
#: SQL for DuckDB that says the same in another way.
ORACLES = {
    "leading_prompt": """SELECT session_id, agent_id, segment_index, turn_ordinal, n_completion = 0 OR n_prompt > 0 AND conv_id % 9 <> 1 OR EXISTS (SELECT 1 FROM turns b WHERE b.session_id = t.session_id AND b.agent_id IS NOT DISTINCT FROM t.agent_id AND b.segment_index = t.segment_index AND b.turn_ordinal < t.turn_ordinal AND b.n_prompt + b.n_completion > 0) AS ok FROM turns t""",
    "agent_roles": "SELECT session_id, agent_id, role, count(*) AS n_turns, role IS NOT NULL AS registered FROM (SELECT *, CASE coalesce(agent_id, '') WHEN 'a0' THEN 'planner' WHEN 'a1' THEN 'worker' WHEN '' THEN 'legacy' END AS role FROM turns) q GROUP BY session_id, agent_id, role",
    "trial_results": """SELECT d.lang AS task_id, d.doc_id AS slot, CASE WHEN d.doc_id NOT IN (SELECT doc_id FROM labels) THEN 'missing' WHEN d.doc_id % 10 = 9 THEN 'unallocated' WHEN d.doc_id % 41 = 0 THEN 'wrong_attempt' WHEN d.doc_id % 43 = 0 THEN 'bad_score' ELSE 'ok' END AS verdict
        FROM documents d WHERE d.doc_id % 10 <> 9 OR d.doc_id IN (SELECT doc_id FROM labels)""",
    "stream_uniqueness": "SELECT session_id, agent_id, segment_index, CAST(2 AS BIGINT) AS n_streams FROM turns WHERE conv_id % 21 = 8 AND tn = 0",
    "slot_difference": """SELECT 'missing' AS side, doc_id AS slot FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)
        UNION ALL SELECT 'surplus', doc_id FROM labels l WHERE l.doc_id % 50 = 0 OR NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id)""",
    "capture_coverage": """SELECT DISTINCT session_id, agent_id, segment_index, n AS n_tokens, CASE WHEN coalesce(agent_id, '') <> 'a2' THEN n - 1 - CAST(segment_index = 1 AS BIGINT) END AS n_rows, coalesce(agent_id, '') <> 'a2' AND segment_index <> 1 AS covered
        FROM (SELECT *, CAST(sum(n_prompt + n_completion) OVER (PARTITION BY session_id, agent_id, segment_index) AS BIGINT) AS n FROM turns) q WHERE n > 0""",
    "orphan_captures": "SELECT session_id, agent_id, max(segment_index) + 1 AS segment_index FROM turns WHERE list_contains(['s1', 's3', 's7'], session_id) GROUP BY session_id, agent_id",
    "token_alignment": """SELECT conv_id, tn, n_completion AS n_tokens, n_completion + CAST(conv_id % 12 = 5 AS BIGINT) AS n_logprobs, len(why) = 0 AS accepted, why[1] AS reason
        FROM (SELECT *, list_filter([CASE WHEN n_completion = 0 THEN 'empty' END, CASE WHEN conv_id % 12 = 5 THEN 'length' END, CASE WHEN conv_id % 16 = 9 THEN 'token' END], lambda x: x IS NOT NULL) AS why FROM turns) q""",
    "turns_by_agent": "SELECT DISTINCT session_id, agent_id, count(*) OVER (PARTITION BY session_id, agent_id) AS n_turns FROM turns",
    "segment_lengths": "SELECT session_id, agent_id, segment_index, CAST(length(string_agg(prompt || completion, '')) AS BIGINT) AS n_tokens FROM turns GROUP BY session_id, agent_id, segment_index",
    "first_error": f"""SELECT session_id, min(turn_ordinal) AS first_turn, arg_min(failed[1], turn_ordinal) AS first_rule, CAST(sum(len(failed)) AS BIGINT) AS n_errors FROM ({_EACH}) q WHERE len(failed) > 0 GROUP BY session_id""",
    "record_rules": f"""SELECT s.session_id, r.rule_id, n_turns AS n_checked, CAST(count(f.turn_ordinal) AS BIGINT) AS n_failed, min(f.turn_ordinal) AS first_failed
        FROM (SELECT session_id, count(*) AS n_turns FROM turns GROUP BY session_id) s CROSS JOIN (VALUES ('token_ids'), ('purpose'), ('logprobs'), ('sampling')) r(rule_id)
        LEFT JOIN ({_EACH}) f ON f.session_id = s.session_id AND list_contains(f.failed, r.rule_id) GROUP BY s.session_id, r.rule_id, n_turns""",
    "segment_contiguity": """SELECT session_id, agent_id, list_min(s) AS first_segment, list_max(s) AS last_segment, s = list_sort(s) AND s = range(len(s)) AS contiguous
        FROM (SELECT session_id, agent_id, list(DISTINCT segment_index ORDER BY segment_index) AS s FROM turns WHERE NOT (conv_id % 14 = 6 AND segment_index = 0) GROUP BY session_id, agent_id) q""",
    "capture_blobs": """SELECT doc_id, d[1] AS data, d[2] AS n_rows, 1 AS n_cols, d[3] AS strict, d[4] AS ok FROM (SELECT doc_id, CASE doc_id % 6
        WHEN 0 THEN row('AQID', 3, TRUE, TRUE) WHEN 1 THEN row('AQI=', 2, TRUE, TRUE) WHEN 2 THEN row('AQI', 6, FALSE, FALSE) WHEN 3 THEN row('!', 6, FALSE, FALSE) WHEN 4 THEN row('', 0, TRUE, TRUE) ELSE row('AQIDBAUG', 6, TRUE, TRUE) END AS d FROM documents) q""",
    "allocation_uniqueness": "SELECT 's' || a.doc_id AS session_id, CAST(2 AS BIGINT) AS n_slots FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1 AND b.doc_id % 25 = 1",
    "weight_versions": "SELECT session_id, CAST(len(v) AS BIGINT) AS n_versions, len(v) > 1 AS straddles FROM (SELECT session_id, list(DISTINCT weight_version) AS v FROM turns GROUP BY session_id) q",
    "sampling_policy": """SELECT session_id, agent_id, 2 * count(*) AS n_checked, CAST(sum(CASE WHEN top_p <> 1 THEN 1 ELSE 0 END) + sum(CASE WHEN conv_id % 15 = 4 THEN 1 ELSE 0 END) AS BIGINT) AS n_policy_failed, CAST(sum(CASE WHEN weight_version <> '7' THEN 1 ELSE 0 END) AS BIGINT) AS n_version_failed
        FROM turns WHERE n_completion > 0 AND agent_id IN ('a0', 'a1') GROUP BY session_id, agent_id""",
}
