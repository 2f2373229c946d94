"""Request checks: fields, sampling ranges, efforts, and the order in which refusals win."""

_REQUESTS = """(SELECT event_id, user_id, event_type, CAST(@json(props, '$.k') AS BIGINT) AS k, value,
    event_id % 11 <> 0 AS has_model, event_id % 13 <> 0 AS has_messages, CASE WHEN event_id % 17 = 0 THEN 'n' WHEN event_id % 19 = 0 THEN 'frobnicate' END AS extra_field,
    CASE event_id % 6 WHEN 0 THEN 'low' WHEN 1 THEN 'high' WHEN 2 THEN 'extreme' END AS effort, CASE event_id % 3 WHEN 0 THEN 'profile_a' WHEN 1 THEN 'profile_b' ELSE 'profile_c' END AS profile FROM events) r"""
_EFFORTS = "(SELECT 'profile_a' AS profile, 'low' AS effort, FALSE AS fallback UNION ALL SELECT 'profile_a', 'high', TRUE UNION ALL SELECT 'profile_b', 'low', TRUE) e"

QUERIES = {
    # ranges of the seven sampling keys
    "sampling_ranges": f"""
        SELECT event_id, (top_k = -1 OR top_k >= 1) AND top_p > 0 AND top_p <= 1 AND min_p >= 0 AND min_p <= 1 AND temperature >= 0 AND repetition_penalty > 0 AND presence_penalty BETWEEN -2 AND 2 AND frequency_penalty BETWEEN -2 AND 2 AS ok
        FROM (SELECT event_id, k - 1 AS top_k, value / 400 AS top_p, value / 500 - 0.01 AS min_p, value - 10 AS temperature, k AS repetition_penalty, k / 40.0 - 2 AS presence_penalty, k / 30.0 - 1 AS frequency_penalty FROM {_REQUESTS}) q""",
    # an effort must be known, then supported by the profile; profiles without efforts ignore it
    "reasoning_efforts": f"""
        SELECT r.event_id, CASE WHEN r.effort IS NOT NULL AND r.effort NOT IN ('low', 'medium', 'high', 'max', 'xhigh') THEN 'invalid' WHEN r.profile = 'profile_c' THEN 'ignored' WHEN r.effort IS NULL THEN 'default' WHEN e.effort IS NULL THEN 'unsupported' ELSE 'ok' END AS verdict
        FROM {_REQUESTS} LEFT JOIN {_EFFORTS} ON r.profile = e.profile AND r.effort = e.effort""",
    # 401 before 400 before 410 before 404 before a bad effort before 409
    "refusal_precedence": f"""
        SELECT event_id, CASE WHEN user_id % 29 = 0 THEN 401 WHEN NOT has_messages OR NOT has_model THEN 400 WHEN event_type = 'error' THEN 410 WHEN k = 0 THEN 404 WHEN effort = 'extreme' THEN 400 WHEN event_type = 'signup' THEN 409 ELSE 200 END AS status
        FROM {_REQUESTS}""",
    "control_requests": f"SELECT event_id, k IS NOT NULL AND event_type IN ('signup', 'view') AS accepted FROM {_REQUESTS}",
    # instances are bound: another instance's header is refused before admission
    "instance_binding": f"SELECT event_id, CASE WHEN user_id % 8 = 3 THEN 412 ELSE 200 END AS status FROM {_REQUESTS}",
    # a model resolves by its full name, else by what follows its last slash
    "model_profiles": """
        WITH dim AS (SELECT 'src0' AS model, 'profile_a' AS profile UNION ALL SELECT 'org/src1', 'profile_b' UNION ALL SELECT 'src1', 'profile_c' UNION ALL SELECT 'src2', 'profile_a'),
        asked AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN concat('org/', source) ELSE source END AS model, source AS base FROM documents)
        SELECT a.doc_id, coalesce(f.profile, b.profile) AS profile, coalesce(f.profile, b.profile) IS NOT NULL AS known FROM asked a LEFT JOIN dim f ON a.model = f.model LEFT JOIN dim b ON a.base = b.model""",
    # trust on first use: a first pin is stored, an equal one passes, another one conflicts and is not stored
    "template_pins": """
        WITH held AS (SELECT source AS model, min(lang) AS pin FROM documents WHERE doc_id % 2 = 0 AND source <> 'src3' GROUP BY source),
        seen AS (SELECT source AS model, max(lang) AS pin FROM documents WHERE doc_id % 2 = 1 OR source = 'src3' GROUP BY source)
        SELECT coalesce(h.model, s.model) AS model, coalesce(h.pin, s.pin) AS pin, h.pin IS NOT NULL AND s.pin IS NOT NULL AND h.pin <> s.pin AS conflict FROM held h FULL OUTER JOIN seen s ON h.model = s.model""",
}

#: SQL for DuckDB that says the same in another way.
ORACLES = {
    "instance_binding": "SELECT event_id, CASE user_id & 7 WHEN 3 THEN 412 ELSE 200 END AS status FROM events",
    "template_pins": """SELECT model, coalesce(held, seen) AS pin, coalesce(held <> seen, FALSE) AS conflict
        FROM (SELECT source AS model, min(lang) FILTER (doc_id % 2 = 0 AND source <> 'src3') AS held, max(lang) FILTER (doc_id % 2 = 1 OR source = 'src3') AS seen FROM documents GROUP BY source) q""",
    # the first of the refusals that hold, by their order
    "refusal_precedence": f"""SELECT event_id, coalesce(list_filter([CASE WHEN user_id % 29 = 0 THEN 401 END, CASE WHEN event_id % 13 = 0 OR event_id % 11 = 0 THEN 400 END, CASE WHEN event_type = 'error' THEN 410 END, CASE WHEN k = 0 THEN 404 END, CASE WHEN event_id % 6 = 2 THEN 400 END, CASE WHEN event_type = 'signup' THEN 409 END], lambda x: x IS NOT NULL)[1], 200) AS status FROM {_REQUESTS}""",
    "reasoning_efforts": "SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'ok' WHEN 1 THEN 'unsupported' WHEN 2 THEN 'invalid' WHEN 5 THEN 'ignored' ELSE 'default' END AS verdict FROM events",
    "model_profiles": "SELECT doc_id, profile, profile IS NOT NULL AS known FROM (SELECT doc_id, CASE WHEN source IN ('src0', 'src2') THEN 'profile_a' WHEN source = 'src1' THEN CASE WHEN doc_id % 2 = 0 THEN 'profile_b' ELSE 'profile_c' END END AS profile FROM documents) q",
}
