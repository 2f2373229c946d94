"""Equi-joins and look-ups between messages, calls, requests and responses."""

_CALLS = """(SELECT conv_id, turn, concat('c', CAST(turn AS @text), '-', CAST(k AS @text)) AS call_id, concat('f', CAST((turn + k) % 3 AS @text)) AS name
    FROM (SELECT conv_id, turn, 0 AS k FROM conversations WHERE role = 'assistant' UNION ALL SELECT conv_id, turn, 1 FROM conversations WHERE role = 'assistant' AND conv_id % 3 = 0) a)"""
_RESPONSES = """(SELECT conv_id, tn, n_completion, concat('{"meta_info":{"finish_reason":{"type":"', CASE WHEN conv_id % 4 = 0 THEN 'length' WHEN conv_id % 9 = 2 THEN 'abort' ELSE 'stop' END, '"},"weight_version":', CASE WHEN conv_id % 5 = 0 THEN 'null' ELSE concat('"', weight_version, '"') END, '},"usage":{"completion_tokens":', CAST(n_completion AS @text), '}}') AS body FROM turns)"""

_STOPS = """(SELECT event_id, array(7, 9) AS profile, CASE WHEN event_id % 4 = 0 THEN array(k, 9, k + 1, 7, k) WHEN event_id % 4 = 1 THEN array(k) ELSE array(9, k % 10) END AS request FROM (SELECT event_id, CAST(@json(props, '$.k') AS INT) AS k FROM events) e) q"""

QUERIES = {
    # a tool's result goes to the call of its id, or without an id to the sole call before it; another name is refused
    "tool_result_calls": f"""
        SELECT r.conv_id, r.turn, coalesce(i.call_id, CASE WHEN r.call_id IS NULL AND s.n_calls = 1 THEN s.call_id END) AS matched,
            CASE WHEN coalesce(i.call_id, CASE WHEN r.call_id IS NULL AND s.n_calls = 1 THEN s.call_id END) IS NULL THEN 'unmatched' WHEN r.name IS NOT NULL AND r.name <> coalesce(i.name, s.name) THEN 'name' ELSE 'ok' END AS verdict
        FROM (SELECT conv_id, turn, CASE WHEN conv_id % 4 = 1 THEN NULL ELSE concat('c', CAST(turn - 1 AS @text), '-', CASE WHEN conv_id % 7 = 0 THEN '9' ELSE '0' END) END AS call_id, CASE WHEN conv_id % 5 = 0 THEN 'f0' END AS name FROM conversations WHERE role = 'user' AND turn > 0) r
        LEFT JOIN {_CALLS} i ON r.conv_id = i.conv_id AND r.call_id = i.call_id
        LEFT JOIN (SELECT conv_id, turn, count(*) AS n_calls, min(call_id) AS call_id, min(name) AS name FROM {_CALLS} c GROUP BY conv_id, turn) s ON r.conv_id = s.conv_id AND r.turn = s.turn + 1""",
    # a request repeats the messages before the last answer one by one, then echoes the answer, and goes on with a tool, a user or the system
    "history_prefixes": """
        WITH cut AS (SELECT conv_id, max(turn) AS answer FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
        asked AS (SELECT conv_id, turn, CASE WHEN conv_id % 11 = 3 AND turn = 1 THEN 'tool' ELSE role END AS role, CASE WHEN conv_id % 9 = 4 AND turn = 0 THEN 'edited' ELSE text END AS text FROM conversations WHERE NOT (conv_id % 7 = 5 AND turn = 0)
            UNION ALL SELECT conv_id, answer + 1, CASE conv_id % 5 WHEN 0 THEN 'tool' WHEN 1 THEN 'user' WHEN 2 THEN 'system' WHEN 3 THEN 'assistant' ELSE 'critic' END, 'more' FROM cut WHERE conv_id % 13 <> 6)
        SELECT c.conv_id, count(*) AS n_messages, min(CASE WHEN p.place < c.answer AND NOT p.same THEN p.place END) AS first_difference,
            CASE WHEN bool_or(p.place < c.answer AND NOT p.same) THEN 'modified' WHEN NOT bool_or(p.place = c.answer AND p.role = 'assistant') THEN 'echo' WHEN NOT bool_or(p.place > c.answer) THEN 'short' WHEN bool_or(p.place > c.answer AND p.role NOT IN ('tool', 'user', 'system')) THEN 'role' ELSE 'ok' END AS verdict
        FROM cut c JOIN (SELECT coalesce(o.conv_id, a.conv_id) AS conv_id, coalesce(o.turn, a.turn) AS place, a.role, o.role IS NOT DISTINCT FROM a.role AND o.text IS NOT DISTINCT FROM a.text AS same
            FROM conversations o FULL OUTER JOIN asked a ON o.conv_id = a.conv_id AND o.turn = a.turn) p ON c.conv_id = p.conv_id AND (p.place <= c.answer OR p.role = 'assistant' AND p.place > c.answer + 1 OR p.place = c.answer + 1)
        GROUP BY c.conv_id""",
    # a turn is replayed to a request of equal stream, segment, messages, effort and purpose
    "replay_lookups": """
        SELECT r.conv_id, r.tn, t.turn_ordinal AS replayed_from
        FROM (SELECT conv_id, tn, session_id, agent_id, segment_index, CASE WHEN conv_id % 6 = 5 THEN 'auxiliary' ELSE purpose END AS purpose, @sha(CASE WHEN conv_id % 8 = 1 THEN concat(prompt, '!') ELSE prompt END) AS messages FROM turns) r
        LEFT JOIN (SELECT session_id, agent_id, segment_index, purpose, turn_ordinal, @sha(prompt) AS messages FROM turns) t
            ON r.session_id = t.session_id AND r.agent_id IS NOT DISTINCT FROM t.agent_id AND r.segment_index = t.segment_index AND r.purpose = t.purpose AND r.messages = t.messages""",
    # a tool is a named function with object parameters, and not strict
    "tool_definitions": """
        SELECT doc_id, @json(tool, '$.type') = 'function' AND coalesce(@json(tool, '$.function.name'), '') <> '' AND coalesce(@json(tool, '$.function.parameters.type'), 'object') = 'object' AND coalesce(@json(tool, '$.function.strict'), 'false') = 'false' AS ok
        FROM (SELECT doc_id, concat('{"type":"', CASE WHEN doc_id % 7 = 0 THEN 'retrieval' ELSE 'function' END, '","function":{"name":"', CASE WHEN doc_id % 5 = 0 THEN '' ELSE source END, '","strict":', CASE WHEN doc_id % 11 = 0 THEN 'true' ELSE 'false' END, ',"parameters":{"type":"', CASE WHEN doc_id % 13 = 0 THEN 'array' ELSE 'object' END, '"}}}') AS tool FROM documents) q""",
    # finish reason, version and usage of engine responses; aborted and empty ones are refused
    "engine_responses": f"""
        SELECT conv_id, tn, @json(body, '$.meta_info.finish_reason.type') AS finish_reason, @json(body, '$.meta_info.weight_version') AS weight_version, CAST(@json(body, '$.usage.completion_tokens') AS BIGINT) AS completion_tokens,
            @json(body, '$.meta_info.finish_reason.type') <> 'abort' AND CAST(@json(body, '$.usage.completion_tokens') AS BIGINT) > 0 AS accepted FROM {_RESPONSES} r""",
    # bundled sampling defaults: known keys that are not null
    "sampling_defaults": """
        SELECT source, CAST(@json(d, '$.temperature') AS DOUBLE) AS temperature, CAST(@json(d, '$.top_k') AS BIGINT) AS top_k
        FROM (SELECT DISTINCT source, concat('{"temperature":', CASE WHEN source = 'src1' THEN 'null' ELSE '0.5' END, ',"top_k":', CAST(length(source) AS @text), ',"pad_token_id":0}') AS d FROM documents) q""",
    # vocabulary merges in both shapes, as pairs
    "merge_pairs": """
        SELECT doc_id, CASE WHEN m LIKE '[%' THEN @json(m, '$[0]') ELSE regexp_extract(m, '^([^ ]*) ([^ ]*)$', 1) END AS left_part, CASE WHEN m LIKE '[%' THEN @json(m, '$[1]') ELSE regexp_extract(m, '^([^ ]*) ([^ ]*)$', 2) END AS right_part
        FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN concat(lang, ' ', source) ELSE concat('["', lang, '","', source, '"]') END AS m FROM documents) q""",
    # vocabulary entries by id: the order in which they enter a digest
    "added_tokens": "SELECT source, lang, token_id, CAST(row_number() OVER (PARTITION BY source ORDER BY token_id) AS BIGINT) AS place FROM (SELECT source, lang, min(doc_id) AS token_id FROM documents GROUP BY source, lang) q",
    # sampling keys that are none of the seven, and roles without a stream
    "unknown_sampling_keys": "SELECT DISTINCT k FROM (SELECT CASE event_id % 9 WHEN 0 THEN 'temperature' WHEN 1 THEN 'top_p' WHEN 2 THEN 'top_k' WHEN 3 THEN 'min_p' WHEN 4 THEN 'repetition_penalty' WHEN 5 THEN 'presence_penalty' WHEN 6 THEN 'frequency_penalty' WHEN 7 THEN 'best_of' ELSE 'length_penalty' END AS k FROM events) q EXCEPT SELECT k FROM (SELECT 'temperature' AS k UNION ALL SELECT 'top_p' UNION ALL SELECT 'top_k' UNION ALL SELECT 'min_p' UNION ALL SELECT 'repetition_penalty' UNION ALL SELECT 'presence_penalty' UNION ALL SELECT 'frequency_penalty') known",
    "roles_without_streams": "SELECT role FROM (SELECT 'a0' AS role UNION ALL SELECT 'a1' UNION ALL SELECT 'a9') r EXCEPT SELECT agent_id FROM turns",
    # stop ids of the profile, then of the request, each once, in order
    "stop_ids": f"SELECT event_id, array_join(array_distinct(concat(profile, request)), ',') AS stop_ids FROM {_STOPS}",
}

#: SQL for DuckDB that says the same in another way.
ORACLES = {
    "merge_pairs": "SELECT doc_id, lang AS left_part, source AS right_part FROM documents",
    "sampling_defaults": "SELECT DISTINCT source, CASE WHEN source <> 'src1' THEN CAST(0.5 AS DOUBLE) END AS temperature, CAST(length(source) AS BIGINT) AS top_k FROM documents",
    "tool_definitions": "SELECT doc_id, NOT list_contains([doc_id % 7, doc_id % 5, doc_id % 11, doc_id % 13], 0) AS ok FROM documents",
    "engine_responses": "SELECT conv_id, tn, CASE WHEN conv_id % 4 = 0 THEN 'length' WHEN conv_id % 9 = 2 THEN 'abort' ELSE 'stop' END AS finish_reason, CASE WHEN conv_id % 5 <> 0 THEN weight_version END AS weight_version, n_completion AS completion_tokens, n_completion > 0 AND (conv_id % 4 = 0 OR conv_id % 9 <> 2) AS accepted FROM turns",
    "tool_result_calls": """SELECT conv_id, turn, matched, CASE WHEN matched IS NULL THEN 'unmatched' WHEN conv_id % 5 = 0 AND (turn - 1) % 3 <> 0 THEN 'name' ELSE 'ok' END AS verdict
        FROM (SELECT r.conv_id, r.turn, CASE WHEN a.role = 'assistant' AND (conv_id % 4 = 1 AND conv_id % 3 <> 0 OR conv_id % 4 <> 1 AND conv_id % 7 <> 0) THEN concat('c', r.turn - 1, '-0') END AS matched FROM conversations r LEFT JOIN conversations a USING (conv_id) WHERE r.role = 'user' AND r.turn > 0 AND a.turn = r.turn - 1) q""",
    "stop_ids": f"""SELECT event_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY place) AS stop_ids
        FROM (SELECT event_id, id, min(place) AS place FROM (SELECT event_id, unnest(list_concat(profile, request)) AS id, unnest(range(len(profile) + len(request))) AS place FROM {_STOPS.replace("array(", "list_value(")}) a GROUP BY event_id, id) b GROUP BY event_id""",
    "added_tokens": "SELECT a.source, a.lang, a.token_id, count(*) AS place FROM (SELECT source, lang, min(doc_id) AS token_id FROM documents GROUP BY source, lang) a JOIN (SELECT source, lang, min(doc_id) AS token_id FROM documents GROUP BY source, lang) b ON a.source = b.source AND b.token_id <= a.token_id GROUP BY a.source, a.lang, a.token_id",
    "roles_without_streams": "SELECT role FROM (VALUES ('a0'), ('a1'), ('a9')) r(role) WHERE role NOT IN (SELECT agent_id FROM turns WHERE agent_id IS NOT NULL)",
    "unknown_sampling_keys": "SELECT DISTINCT CASE event_id % 9 WHEN 7 THEN 'best_of' ELSE 'length_penalty' END AS k FROM events WHERE event_id % 9 >= 7",
}
