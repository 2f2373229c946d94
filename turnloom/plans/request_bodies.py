"""Queries of request rules, on raw bodies made around the conversations' texts."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.operators import request_rules
from turnloom.sources.adapter import read

_CALL = {"type": "function", "function": {"name": "look", "arguments": "{}"}}
_SAYS = [{"role": "user", "content": "@t"}]
_TURN = lambda **more: {"messages": [*_SAYS, {"role": "assistant", "content": None, "tool_calls": [_CALL]} | more]}
#: What a body has besides a model and a text, its verdict, and its unknown fields.
BODIES: list[tuple[dict, str, str]] = [
    ({}, "ok", ""), ({"model": " "}, "model", ""), ({"model": 1, "tools": 1}, "model", ""), ({"messages": []}, "messages", ""), ({"messages": {"role": "user"}}, "messages", ""), ({"messages": [*_SAYS, {"role": "critic", "content": "@t"}]}, "message", ""),
    ({"messages": [{"role": "user", "content": [{"type": "text", "text": "@t"}, "part"]}]}, "ok", ""), ({"messages": [{"role": "user", "content": [{"type": "image_url", "text": "@t"}]}]}, "message", ""), ({"messages": [{"role": "user", "content": "@t", "audio": {}}]}, "audio", ""),
    (_TURN(), "ok", ""), (_TURN(tool_calls="f"), "calls", ""), (_TURN(tool_calls=[_CALL, {"type": "code"}]), "call", ""), (_TURN(tool_calls=[{"type": "function", "function": {"arguments": "@t"}}]), "call_name", ""), (_TURN(tool_calls=[{"type": "function", "function": {"name": "f"}}]), "call_arguments", ""),
    ({"tools": "f"}, "tools", ""), ({"tools": [{"type": "retrieval"}], "n": 3}, "tool_type", ""), ({"tools": [{"type": "function", "function": {"name": ""}}]}, "tool_name", ""), ({"tools": [{"type": "function", "function": {"name": "f", "parameters": "@t"}}]}, "tool_parameters", ""),
    ({"tools": [{"type": "function", "function": {"name": "f", "strict": 0}}]}, "tool_strict", ""), ({"temperature": "@t"}, "temperature", ""), ({"top_p": 0}, "top_p", ""), ({"top_k": 0}, "top_k", ""), ({"top_k": 2.0}, "top_k", ""), ({"min_p": 1.5}, "min_p", ""), ({"repetition_penalty": 0}, "repetition_penalty", ""),
    ({"presence_penalty": -2, "frequency_penalty": 2.5}, "frequency_penalty", ""), ({"max_tokens": 1, "max_completion_tokens": 0}, "max_completion_tokens", ""), ({"max_tokens": True}, "max_tokens", ""), ({"seed": 1.0}, "seed", ""), ({"stop_token_ids": [3, -1]}, "stop_token_ids", ""), ({"stop": ["@t", ""]}, "stop", ""),
    ({"stop": "x", "seed": -1, "temperature": 0, "top_k": -1, "reasoning_effort": "xhigh"}, "ok", ""), ({"reasoning_effort": "extreme"}, "reasoning_effort", ""), ({"rollout": {"purpose": "compaction", "other": 1}}, "rollout", ""), ({"rollout": {"segment_index": -1}}, "segment_index", ""), ({"rollout": {"purpose": "other"}}, "purpose", ""),
    ({"stream": "true"}, "stream", ""), ({"n": 1, "stream": True, "user": "@t", "top_logprobs": 0}, "ok", ""), ({"n": 1.0}, "n", ""), ({"response_format": {"type": "json_object"}}, "response_format", ""), ({"tool_choice": "required"}, "tool_choice", ""), ({"parallel_tool_calls": False}, "parallel_tool_calls", ""),
    ({"logprobs": True}, "logprobs", ""), ({"top_logprobs": False}, "top_logprobs", ""), ({"logit_bias": {"1": 1}}, "logit_bias", ""), ({"stream_options": {"include_usage": False}}, "stream_options", ""), ({"frob": "@t"}, "fields", "frob"), ({"store": 0, "frob": None, "best_of": 2}, "fields", "best_of,store"), ({"n": 0, "store": 1}, "n", "store"),
]
_PLACE = f"(conv_id * 5 + turn) % {len(BODIES)}"
_GENERATION = {v for v, _ in request_rules.GENERATION_RULES}


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn and raw: each message's text in one of the bodies above."""
    texts = [json.dumps({"model": "m", "messages": _SAYS} | more) for more, _, _ in BODIES]
    raw = F.get(F.array(*map(F.lit, texts)), F.expr(f"cast({_PLACE} as int)"))
    quoted = F.to_json(F.array(F.coalesce("text", F.lit(""))))
    c = read(spark, sf_dir, "conversations").withColumn("q", quoted)
    return c.select("conv_id", "turn", F.replace(raw, F.lit('"@t"'), F.expr("substr(q, 2, length(q) - 2)")).alias("raw"))


def chat_request_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = bodies(spark, sf_dir).withColumn("r", request_rules.chat_request(F.col("raw")))
    return d.select("conv_id", "turn", "r.verdict", F.array_join("r.unsupported", ",").alias("unsupported"))


def unknown_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = bodies(spark, sf_dir).select(F.explode(request_rules.chat_request(F.col("raw"))["unsupported"]).alias("extra_field"))
    return d.groupBy("extra_field").agg(F.count("*").alias("n_requests"))


def generation_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bodies(spark, sf_dir).select("conv_id", "turn", request_rules.generation_parameters(F.col("raw")).alias("verdict"))


def _planted(column: int, of=lambda v: v) -> str:
    rows = ", ".join(f"({i}, '{of(b[column])}')" for i, b in enumerate(BODIES))
    return f"(SELECT conv_id, turn, v FROM conversations JOIN (VALUES {rows}) t(i, v) ON i = {_PLACE})"


QUERIES = {"chat_request_checks": chat_request_checks, "unknown_fields": unknown_fields, "generation_parameters": generation_parameters}
ORACLE = {
    "chat_request_checks": f"SELECT a.conv_id, a.turn, a.v AS verdict, b.v AS unsupported FROM {_planted(1)} a JOIN {_planted(2)} b ON a.conv_id = b.conv_id AND a.turn = b.turn",
    "unknown_fields": f"SELECT x AS extra_field, count(*) AS n_requests FROM (SELECT unnest(string_split(v, ',')) AS x FROM {_planted(2)} q WHERE v <> '') r GROUP BY x",
    "generation_parameters": f"SELECT conv_id, turn, v AS verdict FROM {_planted(1, lambda v: v if v in _GENERATION else 'ok')} q",
}
