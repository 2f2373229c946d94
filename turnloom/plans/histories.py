"""Queries of canonical JSON, normal messages and histories, on requests made from the conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.operators import messages
from turnloom.plans.registry import query
from turnloom.sources.adapter import read

#: One message as JSON in two spellings of equal values, and one with another type of a number.
_PLAIN = "to_json(named_struct('role', role, 'content', text, 'meta', named_struct('n', turn, 'f', 2.5D)))"
_OTHER = "concat('{ \"meta\": {\"f\": 2.50, \"n\": ', turn, '}, \"content\": ', to_json(array(text)), ', \"role\": \"', role, '\"}')"
_TYPED = "concat('{\"meta\":{\"n\":', turn, '.0,\"f\":2.5},\"content\":', to_json(array(text)), ',\"role\":\"', role, '\"}')"

#: (JSON over @n, JSON over @n, whether they are equal)
PAIRS = [
    ('{"a": [@n], "b": null}', '{"b":null,"a":[ @n ]}', True), ('{"a": [@n]}', '{"a": [@n.0]}', False), ("[@n.50]", "[@n.5e0]", True), ("@n", '"@n"', False), ('{"a": [true]}', '{"a": [1]}', False),
    ('{"k": {"x": "@n\\"1.0", "y": []}}', '{"k": {"y": [], "x": "@n\\u00221.0"}}', True), ('{"a": @n}', '{"a": @n, "b": null}', False), ("[1, @n]", "[@n, 1, 0]", False), ("@n", "@n x", False), ('"1.0 @n"', '"1.00 @n"', False), ("-0.0", "0.0", True), ("[]", "{}", False),
]


def _cases(values: list[str], column: str) -> str:
    return f"CASE {column} % {len(values)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


def json_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of JSON texts around a document's length, equal or not in value and type."""
    side = lambda i: F.expr(_cases(["replace('" + p[i].replace("\\", "\\\\") + "', '@n', cast(n_chars as string))" for p in PAIRS], "doc_id"))
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", messages.same_json(side(0), side(1)).alias("same"))


#: kinds of a message's raw form by (conv_id + turn) % 9; what is refused, and what the content becomes.
_FORMS = [
    _PLAIN, _OTHER, "concat('{\"role\":\"', role, '\",\"content\":[{\"type\":\"text\",\"text\":', to_json(text), '},\"part\"]}')", "concat('{\"role\":\"', role, '\",\"content\":[{\"type\":\"image_url\"}]}')", "concat('{\"content\":', turn, ',\"role\":\"', role, '\"}')",
    "concat('[\"', role, '\"]')", "concat('{\"role\":\"critic', '\",\"content\":\"x\"}')", "concat('{\"role\":\"assistant\",\"tool_calls\":[{\"id\":\"c', turn, '\"}],\"content\":null}')", "concat('{\"role\":\"', role, '\",\"content\":null}')",
]


def message_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each message in one of nine raw forms: role, content, why it is refused, and whether it equals its plain form."""
    text = [f.replace("to_json(text)", "substr(to_json(array(text)), 2, length(to_json(array(text))) - 2)") for f in _FORMS]
    d = read(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", f"{_PLAIN} AS plain", f"{_cases(text, '(conv_id + turn)')} AS raw")
    d = messages.normalized(messages.normalized(d).withColumnsRenamed({"role": "r", "content": "c", "error": "e", "digest": "d"}), "plain")
    return d.select("conv_id", "turn", F.col("r").alias("role"), F.col("c").alias("content"), F.col("e").alias("error"), F.coalesce(F.col("d") == F.col("digest"), F.lit(False)).alias("as_plain"))


def request_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of five kinds of requests of each conversation with an answer, by the prefixes that they share with its
    committed messages: going on, retried, with an edited message, without an echo, and opening a segment."""
    cut = query("SELECT * FROM (SELECT conv_id, max(turn) AS n_prev FROM conversations WHERE role = 'assistant' GROUP BY conv_id) c WHERE n_prev > 0")(spark, sf_dir)
    states = cut.selectExpr("cast(conv_id as string) AS stream", "0 AS segment", "'primary' AS purpose", "'low' AS effort", "n_prev AS n_messages")
    kinds = cut.selectExpr("conv_id", "n_prev", "explode(sequence(0, 4)) AS kind")
    r = kinds.selectExpr("*", "explode(sequence(1, if(kind = 1 AND conv_id % 4 = 1, 6, 1))) AS k").selectExpr("*", "concat(conv_id, '-', kind, '-', k) AS request", "cast(conv_id as string) AS stream", "kind * 10 + k AS ordinal")
    requests = r.selectExpr("request", "stream", "ordinal", "if(kind = 4, 1, 0) AS segment", "if(kind = 1 AND conv_id % 6 = 5, 'auxiliary', 'primary') AS purpose", "if(kind = 1 AND conv_id % 6 = 4 OR kind = 0 AND conv_id % 19 = 4, 'high', 'low') AS effort")
    said = read(spark, sf_dir, "conversations")
    stored = said.selectExpr("cast(conv_id as string) AS stream", "turn AS place", f"{_PLAIN} AS raw")
    repeated = said.join(r, "conv_id").where("turn < n_prev AND (kind < 4 OR turn = 0)").selectExpr("request", "turn AS place", f"if(kind = 2 AND turn = conv_id % n_prev, {_TYPED}, {_OTHER}) AS raw")
    tail = r.where("kind IN (0, 2, 3)").selectExpr("request", "n_prev AS place", "concat('{\"role\":\"', if(kind = 3, 'user', 'assistant'), '\",\"content\":\"echo\"}') AS raw")
    role = "CASE WHEN kind > 0 THEN 'user' WHEN conv_id % 17 = 3 THEN 'critic' ELSE element_at(array('tool', 'user', 'system', 'assistant', 'developer'), cast(conv_id % 5 + 1 as int)) END"
    more = r.where("kind IN (2, 3) OR kind = 0 AND (conv_id % 13 <> 6 OR conv_id % 17 = 3)").selectExpr("request", "n_prev + 1 AS place", f"concat('{{\"role\":\"', {role}, '\",\"content\":\"more\"}}') AS raw")
    return messages.judge(requests, repeated.union(tail).union(more), states, stored)


QUERIES = {"json_equality": json_equality, "message_forms": message_forms, "request_histories": request_histories}
ORACLE = {
    "json_equality": f"SELECT doc_id, {_cases([str(p[2]).lower() for p in PAIRS], 'doc_id')} AS same FROM documents",
    "message_forms": """SELECT conv_id, turn, CASE k WHEN 5 THEN NULL WHEN 6 THEN 'critic' WHEN 7 THEN 'assistant' ELSE role END AS role, CASE WHEN k IN (0, 1) THEN text WHEN k = 2 THEN text || chr(10) || 'part' WHEN k = 7 THEN '' END AS content,
        CASE k WHEN 3 THEN 'parts' WHEN 4 THEN 'content' WHEN 5 THEN 'object' WHEN 6 THEN 'role' END AS error, k IN (0, 1) AS as_plain FROM (SELECT *, (conv_id + turn) % 9 AS k FROM conversations) q""",
    "request_histories": """WITH cut AS (SELECT conv_id, max(turn) AS n FROM conversations WHERE role = 'assistant' GROUP BY conv_id HAVING max(turn) > 0),
        r AS (SELECT conv_id, n, kind, k FROM cut, range(5) a(kind), range(1, 7) b(k) WHERE k = 1 OR kind = 1 AND conv_id % 4 = 1),
        v AS (SELECT *, CASE kind WHEN 0 THEN CASE WHEN conv_id % 17 = 3 THEN 'invalid' WHEN conv_id % 19 = 4 THEN 'effort' WHEN conv_id % 13 = 6 THEN 'short' WHEN conv_id % 5 < 3 THEN 'ok' ELSE 'role' END
            WHEN 1 THEN CASE conv_id % 6 WHEN 5 THEN 'purpose' WHEN 4 THEN 'effort' ELSE CASE WHEN k < 5 THEN 'replay' ELSE 'exhausted' END END WHEN 2 THEN 'modified' WHEN 3 THEN 'echo' ELSE 'opening' END AS verdict FROM r)
        SELECT concat(conv_id, '-', kind, '-', k) AS request, CAST(CASE kind WHEN 1 THEN n WHEN 4 THEN 1 WHEN 0 THEN n + CASE WHEN conv_id % 13 = 6 AND conv_id % 17 <> 3 THEN 1 ELSE 2 END ELSE n + 2 END AS BIGINT) AS n_messages,
            CAST(CASE kind WHEN 2 THEN conv_id % n WHEN 4 THEN 1 ELSE n END AS BIGINT) AS n_common, verdict, CASE WHEN verdict IN ('replay', 'exhausted') THEN CAST(k AS BIGINT) END AS replay FROM v""",
}
