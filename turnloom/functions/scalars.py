"""Scalar functions: keys, finish reasons, budgets, sampling layers, messages and stop ids."""

#: White space, as a text in SQL.
WHITE = "' \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000'"

#: What each layer (runtime, config, request, bundle) says of each sampling key: key, base and step of its values.
_KEYS = [("temperature", "0.0"), ("top_p", "0.5"), ("top_k", "20"), ("min_p", "0.0"), ("repetition_penalty", "1.0"), ("presence_penalty", "0.0"), ("frequency_penalty", "0.25")]


def _says(layer: int, key: int) -> str:
    """SQL of a layer's value of a key, null where it says nothing."""
    return f"CASE WHEN (event_id + {3 * key}) % {(7, 5, 3, 2)[layer]} = 0 THEN CAST({_KEYS[key][1]} + CAST(@json(props, '$.k') AS BIGINT) % {layer + 2} AS DOUBLE) END"


_LAYERED = "(SELECT event_id, " + ", ".join(f"{_says(i, j)} AS {name}_{key}" for i, name in enumerate("rcqb") for j, (key, _) in enumerate(_KEYS)) + " FROM events) l"

QUERIES = {
    # the last two delimiters split a composed key, so the real key may contain the delimiter
    "session_keys": """
        SELECT conv_id, tn, composed, regexp_extract(composed, '^(.*)[|]([^|]*)[|]([^|]*)$', 1) AS real_key, regexp_extract(composed, '^(.*)[|]([^|]*)[|]([^|]*)$', 2) AS session_part, regexp_extract(composed, '^(.*)[|]([^|]*)[|]([^|]*)$', 3) AS agent_part,
            @match(regexp_extract(composed, '^(.*)[|]([^|]*)[|]([^|]*)$', 2), '^[A-Za-z0-9._]{1,256}$') AND @match(regexp_extract(composed, '^(.*)[|]([^|]*)[|]([^|]*)$', 3), '^[A-Za-z0-9._]{1,256}$') AS valid
        FROM (SELECT conv_id, tn, concat(CASE WHEN conv_id % 2 = 0 THEN 'key' ELSE 'k|e|y' END, '|', session_id, '|', coalesce(agent_id, 'no agent')) AS composed FROM turns) q""",
    "stream_ids": "SELECT DISTINCT session_id, agent_id, CASE WHEN agent_id IS NULL THEN session_id ELSE concat(session_id, '-', agent_id) END AS stream_id FROM turns",
    "instance_ids": "SELECT doc_id, instance, @match(instance, '^[0-9a-f]{32}$') AS valid FROM (SELECT doc_id, substr(@sha(CAST(doc_id AS @text)), 1, CASE WHEN doc_id % 5 = 0 THEN 31 ELSE 32 END) AS instance FROM documents) q",
    # numbers that are neither NaN nor infinite
    "finite_values": "SELECT event_id, NOT isnan(v) AND abs(v) < CAST('Infinity' AS DOUBLE) AS finite FROM (SELECT event_id, CASE event_id % 10 WHEN 1 THEN CAST('NaN' AS DOUBLE) WHEN 2 THEN CAST('-Infinity' AS DOUBLE) WHEN 3 THEN CAST('Infinity' AS DOUBLE) ELSE value END AS v FROM events) q",
    # stop, length and abort are authoritative; else the budget decides; parsed calls upgrade all but length
    "finish_reasons": """
        SELECT conv_id, tn, CASE WHEN n_calls > 0 AND reason <> 'length' THEN 'tool_calls' ELSE reason END AS finish_reason
        FROM (SELECT conv_id, tn, CASE WHEN raw IN ('stop', 'length', 'abort') THEN raw WHEN n_completion >= 100 THEN 'length' ELSE 'stop' END AS reason, CASE WHEN conv_id % 5 = 1 THEN 1 ELSE 0 END AS n_calls
            FROM (SELECT conv_id, tn, n_completion, CASE conv_id % 4 WHEN 0 THEN 'stop' WHEN 1 THEN 'length' WHEN 2 THEN NULL ELSE 'eos' END AS raw FROM turns) a) b""",
    # max_completion_tokens, else max_tokens, else 65536; then what the context window leaves
    "token_budgets": """
        SELECT conv_id, tn, budget, CASE WHEN window_size IS NULL THEN budget ELSE least(budget, window_size - n_prompt) END AS clamped, window_size IS NOT NULL AND window_size - n_prompt <= 0 AS refused
        FROM (SELECT conv_id, tn, n_prompt, coalesce(CASE WHEN conv_id % 3 = 0 THEN CAST(128 AS BIGINT) END, CASE WHEN conv_id % 2 = 0 THEN CAST(512 AS BIGINT) END, CAST(65536 AS BIGINT)) AS budget, CASE WHEN conv_id % 7 = 0 THEN NULL ELSE CAST(400 AS BIGINT) END AS window_size FROM turns) q""",
    # runtime over config over request over bundled over implicit, key by key, and a floor for the temperature; nothing is implied of penalties
    "sampling_layers": f"""
        SELECT event_id, CASE WHEN temperature IS NULL THEN NULL ELSE greatest(temperature, CAST(0.01 AS DOUBLE)) END AS temperature, top_p, top_k, min_p, repetition_penalty, presence_penalty, frequency_penalty
        FROM (SELECT event_id, coalesce(r_temperature, c_temperature, q_temperature, b_temperature, CAST(1 AS DOUBLE)) AS temperature, coalesce(r_top_p, c_top_p, q_top_p, b_top_p, CAST(1 AS DOUBLE)) AS top_p, coalesce(r_top_k, c_top_k, q_top_k, b_top_k) AS top_k,
            coalesce(r_min_p, c_min_p, q_min_p, b_min_p) AS min_p, coalesce(r_repetition_penalty, c_repetition_penalty, q_repetition_penalty, b_repetition_penalty) AS repetition_penalty,
            coalesce(r_presence_penalty, c_presence_penalty, q_presence_penalty, b_presence_penalty) AS presence_penalty, coalesce(r_frequency_penalty, c_frequency_penalty, q_frequency_penalty, b_frequency_penalty) AS frequency_penalty FROM {_LAYERED}) q""",
    # text parts are joined by line ends; a null assistant text beside calls is the empty text; other roles are refused
    "normal_messages": """
        SELECT conv_id, turn, role, CASE WHEN role = 'assistant' AND shown IS NULL THEN '' WHEN turn % 2 = 0 OR shown IS NULL THEN shown ELSE concat(shown, chr(10), 'part') END AS content, role IN ('system', 'user', 'assistant', 'tool') AND NOT (role <> 'assistant' AND shown IS NULL) AS accepted
        FROM (SELECT conv_id, turn, CASE WHEN conv_id % 20 = 3 THEN 'critic' ELSE role END AS role, CASE WHEN conv_id % 8 = 2 AND turn % 4 = 1 THEN NULL ELSE text END AS shown FROM conversations) q""",
    # what an agent sees: beside calls the stripped text or nothing, else the text as it is
    "visible_content": f"""
        SELECT conv_id, tn, CASE WHEN conv_id % 5 = 1 THEN nullif(@strip(shown, {WHITE}), '') ELSE shown END AS visible
        FROM (SELECT conv_id, tn, CASE tn % 4 WHEN 0 THEN concat({WHITE}, completion, {WHITE}) WHEN 1 THEN {WHITE} WHEN 2 THEN concat(chr(10), chr(10), completion, chr(9)) ELSE completion END AS shown FROM turns) q""",
    # a missing version stays missing; zero is the text 0
    "weight_version_text": "SELECT doc_id, CAST(CASE WHEN doc_id % 4 = 0 THEN NULL ELSE doc_id % 4 - 1 END AS @text) AS weight_version FROM documents",
    # first positive of two reported context lengths
    "context_windows": "SELECT doc_id, coalesce(CASE WHEN a > 0 THEN a END, CASE WHEN b > 0 THEN b END) AS context_length FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 0 WHEN 1 THEN n_chars ELSE NULL END AS a, CASE WHEN doc_id % 6 = 0 THEN NULL ELSE n_chars + 1 END AS b FROM documents) q",
    # usage of each response and of each session
    "usage_totals": "SELECT session_id, CAST(sum(n_prompt) AS BIGINT) AS prompt_tokens, CAST(sum(n_completion) AS BIGINT) AS completion_tokens, CAST(sum(n_prompt + n_completion) AS BIGINT) AS total_tokens FROM turns GROUP BY session_id",
    # whether the policy that a client asked for is in force
    "sampling_matches": "SELECT event_id, top_k = 5 AND temperature = 1 AS matches FROM (SELECT event_id, CAST(@json(props, '$.k') AS BIGINT) AS top_k, CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END AS temperature FROM events) q",
    # digest of a canonical serialisation, compared with the one pinned first
    "fingerprints": "SELECT source, @sha(concat('{\"model\":\"', source, '\",\"n\":', CAST(count(*) AS @text), '}')) AS fingerprint FROM documents GROUP BY source",
}

_EDGE = "[\\x09-\\x0D\\x1C-\\x1F\\x85\\p{Z}]+"
#: SQL for DuckDB that says the same in another way.
ORACLES = {
    "instance_ids": "SELECT doc_id, i AS instance, length(i) = 32 AS valid FROM (SELECT doc_id, left(sha256(CAST(doc_id AS VARCHAR)), 32 - CAST(doc_id % 5 = 0 AS INT)) AS i FROM documents) q",
    "finite_values": "SELECT event_id, event_id % 10 NOT BETWEEN 1 AND 3 AND isfinite(value) AS finite FROM events",
    "finish_reasons": "SELECT conv_id, tn, CASE WHEN conv_id % 4 = 1 OR conv_id % 4 > 1 AND n_completion > 99 THEN 'length' WHEN conv_id % 5 = 1 THEN 'tool_calls' ELSE 'stop' END AS finish_reason FROM turns",
    "token_budgets": """SELECT conv_id, tn, budget, CASE WHEN conv_id % 7 <> 0 AND budget > 400 - n_prompt THEN 400 - n_prompt ELSE budget END AS clamped, conv_id % 7 <> 0 AND n_prompt >= 400 AS refused
        FROM (SELECT *, CAST(list_filter([CASE WHEN conv_id % 3 = 0 THEN 128 END, CASE WHEN conv_id % 2 = 0 THEN 512 END, 65536], lambda x: x IS NOT NULL)[1] AS BIGINT) AS budget FROM turns) q""",
    "weight_version_text": "SELECT doc_id, [NULL, '0', '1', '2'][doc_id % 4 + 1] AS weight_version FROM documents",
    "context_windows": "SELECT doc_id, list_filter([CASE doc_id % 3 WHEN 0 THEN 0 WHEN 1 THEN n_chars END, CASE WHEN doc_id % 6 <> 0 THEN n_chars + 1 END], lambda x: x > 0)[1] AS context_length FROM documents",
    "usage_totals": "SELECT session_id, CAST(length(string_agg(prompt, '')) AS BIGINT) AS prompt_tokens, CAST(length(string_agg(completion, '')) AS BIGINT) AS completion_tokens, CAST(length(string_agg(prompt || completion, '')) AS BIGINT) AS total_tokens FROM turns GROUP BY session_id",
    # the layers as rows, the first of each key by a place instead of a coalesce
    "sampling_layers": f"""WITH l AS (SELECT * FROM {_LAYERED}), v AS ({" UNION ALL ".join(f"SELECT event_id, '{key}' AS k, {i} AS place, {name}_{key} AS v FROM l" for i, name in enumerate("rcqb") for key, _ in _KEYS)} UNION ALL SELECT event_id, k, 9, 1 FROM l, (VALUES ('temperature'), ('top_p')) d(k))
        SELECT event_id, greatest(arg_min(v, place) FILTER (k = 'temperature'), CAST(0.01 AS DOUBLE)) AS temperature, {", ".join(f"arg_min(v, place) FILTER (k = '{key}') AS {key}" for key, _ in _KEYS[1:])} FROM v WHERE v IS NOT NULL GROUP BY event_id""",
    "visible_content": f"""
        SELECT conv_id, tn, CASE WHEN conv_id % 5 <> 1 THEN shown WHEN regexp_matches(shown, '[^\\x09-\\x0D\\x1C-\\x1F\\x85\\p{{Z}}]') THEN regexp_replace(regexp_replace(shown, '^{_EDGE}', ''), '{_EDGE}$', '') END AS visible
        FROM (SELECT conv_id, tn, CASE tn % 4 WHEN 0 THEN {WHITE} || completion || {WHITE} WHEN 1 THEN {WHITE} WHEN 2 THEN chr(10) || chr(10) || completion || chr(9) ELSE completion END AS shown FROM turns) q""",
    "stream_ids": "SELECT DISTINCT session_id, agent_id, concat_ws('-', session_id, agent_id) AS stream_id FROM turns",
    "usage_totals": "SELECT session_id, p AS prompt_tokens, c AS completion_tokens, p + c AS total_tokens FROM (SELECT session_id, CAST(sum(length(prompt)) AS BIGINT) AS p, CAST(sum(length(completion)) AS BIGINT) AS c FROM turns GROUP BY session_id) q",
    "session_keys": """
        SELECT conv_id, tn, composed, array_to_string(p[1:len(p) - 2], '|') AS real_key, p[len(p) - 1] AS session_part, p[len(p)] AS agent_part,
            regexp_full_match(p[len(p) - 1], '[A-Za-z0-9._]{1,256}') AND regexp_full_match(p[len(p)], '[A-Za-z0-9._]{1,256}') AS valid
        FROM (SELECT conv_id, tn, composed, string_split(composed, '|') AS p FROM (SELECT conv_id, tn, concat_ws('|', CASE WHEN conv_id % 2 = 0 THEN 'key' ELSE 'k|e|y' END, session_id, coalesce(agent_id, 'no agent')) AS composed FROM turns) a) b""",
}
