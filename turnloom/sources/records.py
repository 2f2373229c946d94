"""Session records as JSON, raw validation, snapshots, responses and error logs."""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.sources.objects import json_list, json_object


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """session_id and raw JSON text of one record a file; types are checked before any cast."""
    d = spark.read.text(path, wholetext=True)
    return d.select(F.get_json_object("value", "$.session_id").alias("session_id"), F.col("value").alias("raw"))


def token_ids_ok(ids: Column) -> Column:
    """Whether a JSON text is a list of nonnegative integers: true, 1.0 and "3" are none."""
    v = F.try_parse_json(ids)
    listed = F.from_json(ids, "array<variant>")
    every = F.forall(listed, lambda x: (F.schema_of_variant(x) == "BIGINT") & (F.try_variant_get(x, "$", "bigint") >= 0))
    return F.coalesce(v.isNotNull() & ids.rlike("^\\s*\\[") & F.coalesce(every, F.lit(False)), F.lit(False))


def type_errors(raw: Column) -> Column:
    """Names of the type rules that a record's JSON text breaks, sorted: turns is a list of objects, an agent
    id is a text or null, a conversation flag is true or false or missing, token ids are whole and not negative."""
    v = F.try_parse_json(raw)
    kind = lambda x: F.coalesce(F.schema_of_variant(x), F.lit(""))
    at = lambda x, path: F.try_variant_get(x, path, "variant")
    listed = kind(at(v, "$.turns")).startswith("ARRAY")
    turns = F.when(listed, F.try_variant_get(v, "$.turns", "array<variant>"))
    ids = lambda x: F.forall(F.try_variant_get(x, "$", "array<variant>"), lambda i: (kind(i) == "BIGINT") & F.coalesce(F.try_variant_get(i, "$", "bigint") >= 0, F.lit(False)))
    is_ids = lambda x: kind(x).startswith("ARRAY") & F.coalesce(ids(x), F.lit(False))
    broken = {
        "turn": lambda t: ~kind(t).startswith("OBJECT"),
        "agent_id": lambda t: ~kind(at(t, "$.agent_id")).isin("", "STRING", "VOID"),
        "new_conversation": lambda t: ~kind(at(t, "$.new_conversation")).isin("", "BOOLEAN"),
        "prompt_token_ids": lambda t: (kind(at(t, "$.prompt_token_ids")) != "") & ~is_ids(at(t, "$.prompt_token_ids")),
        "completion_token_ids": lambda t: ~is_ids(at(t, "$.completion_token_ids")),
    }

    def any_turn(name: str, bad: Callable[[Column], Column]) -> Column:
        return F.when(F.exists(turns, lambda t: (kind(t).startswith("OBJECT") | F.lit(name == "turn")) & bad(t)), name)

    found = [F.when(~listed | v.isNull(), "turns")] + [any_turn(name, bad) for name, bad in broken.items()]
    return F.array_sort(F.array_compact(F.array(*found)))


def collected(requested: DataFrame, records: DataFrame, failures: DataFrame) -> DataFrame:
    """requested (asked) with the record that came for it and a verdict: unknown, failed, another or ok.

    records: (asked, raw); failures: (asked) of sessions with a turn that was not recorded.
    """
    d = requested.join(records.select("asked", "raw"), "asked", "left").join(failures.select("asked", F.lit(True).alias("lost")).distinct(), "asked", "left")
    named = F.coalesce(F.get_json_object("raw", "$.session_id") == F.col("asked"), F.lit(False))
    return d.select("asked", F.when(F.col("raw").isNull(), "unknown").when(F.col("lost"), "failed").when(~named, "another").otherwise("ok").alias("verdict"), "raw")


def write_snapshots(snapshots: DataFrame, path: str, key: str = "session_id", version: str = "version", payload: str = "payload") -> None:
    """Adds the newest payload of each session to a log of snapshots; one commit adds all or none."""
    newest = snapshots.groupBy(key).agg(F.max(F.struct(version, payload)).alias("s"))
    newest.select(F.col(key).alias("session_id"), F.col(f"s.{version}").cast("bigint").alias("version"), F.col(f"s.{payload}").alias("payload")).write.mode("append").parquet(path)


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """The newest payload of each session: an older version that came later replaces none."""
    d = spark.read.schema("session_id string, version bigint, payload string").parquet(path)
    return d.groupBy("session_id").agg(F.max(F.struct("version", "payload")).alias("s")).select("session_id", "s.version", "s.payload")


def compact_snapshots(spark: SparkSession, path: str, target: str) -> None:
    """The newest snapshots as a log of their own, in a new folder."""
    read_snapshots(spark, path).write.parquet(target)


def run_folder(base: str, started: str) -> str:
    """A run's folder, named by its server's start time; characters that a path cannot hold are percent codes."""
    return f"{base.rstrip('/')}/run_ts={quote(started, safe='')}"


def error_line(ts: Column, message: Column) -> Column:
    return F.concat(F.lit("["), ts, F.lit("] "), message)


def append_errors(rejects: DataFrame, path: str) -> None:
    """Error lines by run, each with its session; columns run_ts, session_id, ts, message."""
    line = error_line(F.col("ts").cast("string"), F.col("message"))
    rejects.select("run_ts", "session_id", line.alias("line")).write.mode("append").partitionBy("run_ts").json(path)


def session_log(spark: SparkSession, path: str, run: str, session: str) -> DataFrame:
    """A session's error lines of one run; only that run's folder is read."""
    d = spark.read.schema("session_id string, line string, run_ts string").json(path)
    return d.where((F.col("run_ts") == run) & (F.col("session_id") == session)).select("line")


def usage(n_prompt: Column, n_completion: Column) -> Column:
    return json_object({"prompt_tokens": n_prompt, "completion_tokens": n_completion, "total_tokens": n_prompt + n_completion})


def _calls(calls: Column, indexed: bool = False) -> Column:
    """Calls (structs of id, name, arguments) as a JSON list, null where there are none; indexed: with their places."""
    function = lambda c: json_object({"name": c["name"], "arguments": c["arguments"]})
    one = lambda c, i: json_object(({"index": i} if indexed else {}) | {"id": c["id"], "type": F.lit("function"), "function": function(c)}, raw=("function",))
    return F.when(F.size(calls) > 0, json_list(F.transform(calls, one)))


def response(id: Column, created: Column, model: Column, content: Column, reasoning: Column, calls: Column, finish: Column, n_prompt: Column, n_completion: Column) -> Column:
    """A chat response as compact JSON: a null content stays, missing reasoning and calls go; calls: structs of id, name, arguments."""
    message = json_object({"role": F.lit("assistant"), "content": content, "tool_calls": _calls(calls), "reasoning_content": reasoning}, ("tool_calls", "reasoning_content"), ("tool_calls",))
    choice = json_object({"index": F.lit(0), "message": message, "finish_reason": finish}, raw=("message",))
    return json_object({"id": id, "object": F.lit("chat.completion"), "created": created, "model": model, "choices": json_list(F.array(choice)), "usage": usage(n_prompt, n_completion)}, raw=("choices", "usage"))


def event_stream(id: Column, created: Column, model: Column, content: Column, reasoning: Column, calls: Column, finish: Column, n_prompt: Column, n_completion: Column) -> Column:
    """The three lines of a streamed response: all of the message with indexed calls, finish with usage, end."""
    delta = json_object({"role": F.lit("assistant"), "content": content, "reasoning_content": reasoning, "tool_calls": _calls(calls, True)}, ("reasoning_content", "tool_calls"), ("tool_calls",))
    base = {"id": id, "object": F.lit("chat.completion.chunk"), "created": created, "model": model}
    choice = lambda d, f: json_list(F.array(json_object({"index": F.lit(0), "delta": d, "finish_reason": f}, raw=("delta",))))
    first = json_object(base | {"choices": choice(delta, F.lit(None).cast("string"))}, raw=("choices",))
    last = json_object(base | {"choices": choice(F.lit("{}"), finish), "usage": usage(n_prompt, n_completion)}, raw=("choices", "usage"))
    return F.array(*[F.concat(F.lit("data: "), x) for x in (first, last, F.lit("[DONE]"))])


#: What a turn says as a parser read it: these keys go where they are null, all others stay.
PARSED = ("content", "reasoning_content", "tool_calls")


def snapshot(record: Column, turn_fields: list[str], captures: bool, logprobs: bool) -> Column:
    """A record (struct of session_id, turns, segment_routed_experts) as compact JSON.

    turn_fields: the fields of its turns. Null parsed views go, and so do captures that are empty or not
    asked for, and logprobs that are not; other nulls and empty lists stay.
    """
    names = [c for c in turn_fields if logprobs or c != "completion_logprobs"]
    turns = F.transform(record["turns"], lambda t: json_object({c: t[c] for c in names}, PARSED))
    held = record["segment_routed_experts"]
    fields = {"session_id": record["session_id"], "turns": json_list(turns)} | ({"segment_routed_experts": F.when(F.size(held) > 0, held)} if captures else {})
    return json_object(fields, ("segment_routed_experts",), ("turns",))
