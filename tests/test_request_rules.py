"""Rules for request bodies: every refusal by itself, and the first of two."""

import json

from pyspark.sql import functions as F

from turnloom.operators import request_rules

GOOD = {"model": "m", "messages": [{"role": "user", "content": "hi"}]}
CALL = {"type": "function", "function": {"name": "f", "arguments": "{}"}}
TOOL = {"type": "function", "function": {"name": "f"}}
#: What is added to a good body, and the verdict.
CASES = [
    ({}, "ok"), ({"model": None}, "model"), ({"model": " \t"}, "model"), ({"model": 3}, "model"), ({"messages": []}, "messages"), ({"messages": "hi"}, "messages"), ({"messages": ["hi"]}, "message"), ({"messages": [{"role": "critic"}]}, "message"),
    ({"messages": [{"role": "user", "content": [{"type": "image_url"}]}]}, "message"), ({"messages": [{"role": "user", "content": "", "audio": {}}]}, "audio"), ({"messages": [{"role": "assistant", "content": "", "function_call": {}}]}, "audio"),
    ({"messages": [{"role": "assistant", "content": "", "tool_calls": {}}]}, "calls"), ({"messages": [{"role": "assistant", "tool_calls": [CALL]}]}, "ok"), ({"messages": [{"role": "assistant", "tool_calls": [CALL, 3]}]}, "call"),
    ({"messages": [{"role": "assistant", "tool_calls": [CALL | {"type": "x"}]}]}, "call"), ({"messages": [{"role": "assistant", "tool_calls": [{"type": "function", "function": {"arguments": "{}"}}]}]}, "call_name"), ({"messages": [{"role": "assistant", "tool_calls": [{"type": "function"}]}]}, "call_name"),
    ({"messages": [{"role": "assistant", "tool_calls": [{"type": "function", "function": {"name": "", "arguments": [1]}}]}]}, "call_arguments"), ({"messages": [{"role": "assistant", "tool_calls": [{"type": "function", "function": {"name": "", "arguments": {}}}]}]}, "ok"),
    ({"messages": [{"role": "user", "content": "", "tool_calls": 3}, {"role": "critic"}]}, "message"),
    ({"tools": None}, "ok"), ({"tools": {}}, "tools"), ({"tools": [TOOL]}, "ok"), ({"tools": [TOOL, {"type": "x"}]}, "tool_type"), ({"tools": ["f"]}, "tool_type"), ({"tools": [{"type": "function", "function": {"name": " "}}]}, "tool_name"),
    ({"tools": [{"type": "function", "function": {"name": "f", "parameters": []}}]}, "tool_parameters"), ({"tools": [{"type": "function", "function": {"name": "f", "parameters": {}, "strict": True}}]}, "tool_strict"), ({"tools": [{"type": "function", "function": {"name": "f", "strict": False}}]}, "ok"),
    ({"temperature": 0}, "ok"), ({"temperature": -0.1}, "temperature"), ({"temperature": "1"}, "temperature"), ({"temperature": True}, "temperature"), ({"top_p": 0}, "top_p"), ({"top_p": 1.0}, "ok"), ({"top_p": 1.1}, "top_p"), ({"top_k": -1}, "ok"), ({"top_k": 0}, "top_k"),
    ({"top_k": 5.0}, "top_k"), ({"min_p": 0}, "ok"), ({"min_p": -0.5}, "min_p"), ({"repetition_penalty": 0}, "repetition_penalty"), ({"presence_penalty": -2}, "ok"), ({"presence_penalty": 2.5}, "presence_penalty"), ({"frequency_penalty": -3}, "frequency_penalty"),
    ({"max_tokens": 0}, "max_tokens"), ({"max_tokens": 5.0}, "max_tokens"), ({"max_tokens": True}, "max_tokens"), ({"max_tokens": None}, "ok"), ({"max_completion_tokens": -1}, "max_completion_tokens"), ({"seed": -7}, "ok"), ({"seed": 1.5}, "seed"),
    ({"stop_token_ids": [1, 0]}, "ok"), ({"stop_token_ids": [1, -1]}, "stop_token_ids"), ({"stop_token_ids": [True]}, "stop_token_ids"), ({"stop_token_ids": 5}, "stop_token_ids"), ({"stop": "x"}, "ok"), ({"stop": ""}, "stop"), ({"stop": ["x", ""]}, "stop"), ({"stop": []}, "ok"), ({"stop": 4}, "stop"),
    ({"reasoning_effort": "low"}, "ok"), ({"reasoning_effort": "most"}, "reasoning_effort"), ({"reasoning_effort": 1}, "reasoning_effort"), ({"rollout": {}}, "ok"), ({"rollout": None}, "rollout"), ({"rollout": {"x": 1}}, "rollout"), ({"rollout": []}, "rollout"), ({"rollout": {"segment_index": 2, "purpose": "auxiliary"}}, "ok"),
    ({"rollout": {"segment_index": -1}}, "segment_index"), ({"rollout": {"segment_index": None}}, "segment_index"), ({"rollout": {"segment_index": 1.0}}, "segment_index"), ({"rollout": {"purpose": None}}, "purpose"), ({"rollout": {"purpose": "other"}}, "purpose"),
    ({"stream": True}, "ok"), ({"stream": None}, "stream"), ({"stream": 1}, "stream"), ({"n": 1}, "ok"), ({"n": 1.0}, "n"), ({"n": True}, "n"), ({"n": 2}, "n"), ({"response_format": {"type": "text"}}, "ok"), ({"response_format": {"type": "json_object"}}, "response_format"),
    ({"tool_choice": "auto"}, "ok"), ({"tool_choice": "none"}, "tool_choice"), ({"parallel_tool_calls": True}, "ok"), ({"parallel_tool_calls": 1}, "parallel_tool_calls"), ({"parallel_tool_calls": False}, "parallel_tool_calls"), ({"logprobs": False}, "ok"), ({"logprobs": 0}, "logprobs"),
    ({"top_logprobs": 0}, "ok"), ({"top_logprobs": False}, "top_logprobs"), ({"top_logprobs": 3}, "top_logprobs"), ({"logit_bias": {}}, "ok"), ({"logit_bias": {"5": 1}}, "logit_bias"), ({"stream_options": {}}, "ok"), ({"stream_options": {"include_usage": True}}, "ok"),
    ({"stream_options": {"include_usage": 1}}, "stream_options"), ({"stream_options": {"include_usage": True, "x": 1}}, "stream_options"), ({"user": "u", "metadata": {}, "safety_identifier": "s"}, "ok"), ({"frob": None}, "ok"), ({"frob": 1, "able": []}, "fields"),
    ({"frob": 1, "n": 2}, "n"), ({"n": 2, "seed": "x"}, "seed"), ({"tools": {}, "messages": []}, "messages"),
]


def test_every_rule(spark):
    rows = [(i, json.dumps(GOOD | add), want, sorted(k for k, v in add.items() if k in ("frob", "able") and v is not None)) for i, (add, want) in enumerate(CASES)]
    rows += [(1000 + i, raw, "body", []) for i, raw in enumerate(["[]", "null", "x", '"m"', "", None, '{"model":"m"} x'])]
    rows += [(2000, '{"model":"m","messages":[{"role":"user"}],"temperature":1e999}', "temperature", [])]
    d = spark.createDataFrame(rows, "i int, raw string, want string, names array<string>").withColumn("r", request_rules.chat_request(F.col("raw"))).withColumn("g", request_rules.generation_parameters(F.col("raw")))
    got = d.collect()
    assert [(r.raw, r.want, r.r.verdict) for r in got if r.r.verdict != r.want] == []
    assert [(r.raw, r.r.unsupported) for r in got if r.r.unsupported != r.names] == []
    own = {v for v, _ in request_rules.GENERATION_RULES} | {"body"}
    assert all(r.g == (r.want if r.want in own else "ok") for r in got if r.i != CASES.index(({"frob": 1, "n": 2}, "n")))
