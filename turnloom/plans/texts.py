"""Queries of parsers, token logic, captures, recorders and responses, on rows made from the tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnloom.functions import completion, templates, tokens
from turnloom.operators import captures
from turnloom.operators.training import with_tokens
from turnloom.plans.registry import query
from turnloom.sources import adapter, records, wire
from turnloom.sources.adapter import DUCK_TURNS, read
from turnloom.streaming import recorder

#: Completions of each dialect: (text, content, reasoning, number of calls, first call's arguments). @n is a
#: document's n_chars and @s its source; the tools below are declared.
TOOLS = [
    {"type": "function", "function": {"name": "look", "parameters": {"properties": {"n": {"type": "integer"}, "code": {"type": " String "}, "either": {"type": ["null", "str"]}, "mixed": {"type": ["number", "string"]}}}}},
    {"name": "flat", "parameters": {"properties": {"code": {"type": "string"}, "kind": {"type": "enum"}}}},
]
_OPEN, _SHUT = "<tool_call>", "</tool_call>"


def _xml(name: str, *pairs: tuple[str, str]) -> str:
    return f"\n<function={name}>\n" + "".join(f"<parameter={k}>\n{v}\n</parameter>\n" for k, v in pairs) + "</function>\n"


def _pairs(name: str, *pairs: tuple[str, str]) -> str:
    return name + "".join(f"<arg_key>{k}</arg_key><arg_value>{v}</arg_value>" for k, v in pairs)


def _as_content(text: str) -> tuple:
    return text, text, None, 0, None


CASES = {
    "hermes": [
        ('<think>@s</think>\n\nsay @s <tool_call>\n{"name": "look", "arguments": {"n": @n}}\n</tool_call>', "say @s", "@s", 1, '{"n": @n}'),
        ('<tool_call>{"name": "look", "arguments": "{\\"n\\": @n}"}</tool_call> after', "after", None, 1, '{"n": @n}'),
        ('<tool_call>{"name": "look", "arguments": [@n]}</tool_call><tool_call>{"name": "look"}</tool_call>', "", None, 2, "{}"),
        _as_content('<tool_call>{"name": "", "arguments": {}}</tool_call>'), _as_content('<tool_call>{"name": "look", "arguments": {"n": NaN}}</tool_call>'), _as_content('<tool_call>{"name": "look", "arguments": {"n": @n}}'),
        ('<tool_call>wait @s <tool_call>{"name": "look", "parameters": {"n": @n}}</tool_call>', "<tool_call>wait @s", None, 1, '{"n": @n}'),
    ],
    "qwen3_coder": [
        ("@s</think>\n\nsay @s " + _OPEN + _xml("look", ("n", "@n")) + _SHUT, "say @s", "@s", 1, '{"n": @n}'),
        (_OPEN + _xml("look", ("code", "@n"), ("either", "@n"), ("mixed", "@n"), ("other", "[@n]")) + _SHUT, "", None, 1, '{"code": "@n", "either": "@n", "mixed": @n, "other": [@n]}'),
        (_OPEN + _xml("flat", ("code", "@n"), ("kind", "@n")) + _SHUT, "", None, 1, '{"code": "@n", "kind": @n}'),
        ("a " + _OPEN + _xml("look", ("n", "@n")) + _xml("flat") + _SHUT + " b", "a  b", None, 2, '{"n": @n}'),
        _as_content(_OPEN + _xml("look", ("code", "x</parameter>y @n")) + _SHUT), _as_content(_OPEN + "\n<function=look>loose @n</function>\n" + _SHUT), _as_content(_OPEN + _xml("look", ("n", "@n"))[:-12] + _SHUT),
        (_OPEN + _xml("look", ("code", "see <parameter=n> @n")) + _SHUT, "", None, 1, '{"code": "see <parameter=n> @n"}'),
        (_OPEN + _xml("look", ("n", "NaN")) + _SHUT, "", None, 1, '{"n": "NaN"}'),
    ],
    "glm47": [
        ("<think>@s</think>say @s " + _OPEN + _pairs("look", ("n", "@n")) + _SHUT, "say @s", "@s", 1, '{"n": @n}'),
        (_OPEN + _pairs("look", ("code", " @n\n"), ("mixed", "@n")) + _SHUT + _OPEN + "flat" + _SHUT, "", None, 2, '{"code": " @n\\n", "mixed": @n}'),
        ("<think>@s" + _OPEN + _pairs("look", ("n", "@n")) + _SHUT, "", "@s", 1, '{"n": @n}'),
        _as_content(_OPEN + _pairs("look", ("n", "@n"), ("n", "@n")) + _SHUT), _as_content(_OPEN + _pairs("look", ("n", "@n")) + "left" + _SHUT), _as_content(_OPEN + _pairs("two words", ("n", "@n")) + _SHUT),
    ],
    "gpt_oss": [
        ('<|channel|>analysis<|message|>@s<|end|><|start|>assistant<|channel|>commentary<|message|>say @s<|end|><|start|>assistant to=functions.look<|channel|>commentary<|message|>{"n": @n}<|call|>', "say @s", "@s", 1, '{"n": @n}'),
        ('<|channel|>commentary to=functions.look<|constrain|>json<|message|> {"n": @n} <|call|><|start|>assistant<|message|>unread<|end|>', "", None, 1, '{"n": @n}'),
        ('<|channel|>commentary to=functions.look<|message|>{"n": @n}<|end|>', '{"n": @n}', None, 0, None), ("<|channel|>commentary to=functions.look<|message|>[@n]<|call|>", "[@n]", None, 0, None),
        ("<|channel|>analysis<|message|>one @n<|start|>assistant<|channel|>analysis<|message|> two <|end|><|start|>assistant<|channel|>final<|message|>said @s<|return|>", "said @s", "one @n\n\ntwo", 0, None),
        ("<|channel|>final<|end|><|start|>assistant<|message|>lost @n", "", None, 0, None), ("<|start|>user<|message|>@n<|end|>", "", None, 0, None),
    ],
}


def _sql(text: str | None, kind: str) -> str:
    """SQL of a text with @n and @s in it."""
    if text is None:
        return f"CAST(NULL AS {kind})"
    parts = []
    for piece in re.split("(@n|@s)", text):
        if piece in ("@n", "@s"):
            parts.append(f"CAST(n_chars AS {kind})" if piece == "@n" else "source")
        elif piece:
            lines = [f"'{line}'".replace("\\", "\\\\" if kind == "STRING" else "\\") for line in piece.replace("'", "''").split("\n")]
            parts.append(", chr(10), ".join(lines))
    return f"concat({', '.join(parts)})" if parts else "''"


def _case(values: list[str]) -> str:
    return f"CASE doc_id % {len(values)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


def _expected(dialect: str) -> str:
    """SQL for DuckDB of what each completion becomes."""
    rows = CASES[dialect]
    column = lambda i, name: f"{_case([_sql(r[i], 'VARCHAR') for r in rows])} AS {name}"
    return f"SELECT doc_id, {column(1, 'content')}, {column(2, 'reasoning')}, CAST({_case([str(r[3]) for r in rows])} AS BIGINT) AS n_calls, {column(4, 'arguments')} FROM documents"


def _calls(dialect: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = read(spark, sf_dir, "documents").select("doc_id", F.expr(_case([_sql(r[0], "STRING") for r in CASES[dialect]])).alias("t"))
        d = d.withColumn("p", completion.parsed(dialect, F.col("t"), TOOLS))
        return d.select("doc_id", "p.content", "p.reasoning", F.size("p.calls").cast("bigint").alias("n_calls"), F.get("p.calls", F.lit(0))["arguments"].alias("arguments"))

    return run


def harmony_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled ids, code points but for the markers' own: a source spelled as a marker stays text."""
    marks = {text: i for text, i, _ in completion.HARMONY_MARKERS}
    points = lambda c: F.transform(F.split(c, ""), lambda x: F.ascii(x))
    piece = lambda text: F.array(*[F.lit(ord(c)) for c in text])
    mark = lambda text: F.array(F.lit(marks[text]))
    spelled = F.concat(F.lit("<|end|>"), "source")
    ids = F.concat(mark("<|channel|>"), piece("analysis"), mark("<|message|>"), points(spelled), mark("<|end|>"), mark("<|start|>"), piece("assistant"), mark("<|channel|>"), piece("final"), mark("<|message|>"), points(F.concat(F.lit("<|return|>"), "lang")), F.when(F.col("doc_id") % 2 == 0, mark("<|return|>")).otherwise(mark("<|end|>")))
    d = read(spark, sf_dir, "documents").where("lang IS NOT NULL").withColumn("p", completion.parsed_ids(ids, _points_text))
    return d.select("doc_id", "p.content", "p.reasoning", F.size("p.calls").cast("bigint").alias("n_calls"))


def _points_text(ids: list[int]) -> str:
    return "".join(map(chr, ids))


def bare_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit('{"name": "look", "parameters": {"n": '), F.col("n_chars").cast("string"), F.lit("}}"))).otherwise(F.concat(F.lit("plain "), "source"))
    p = completion.parsed("llama3_json", t)
    d = read(spark, sf_dir, "documents").select("doc_id", p.alias("p"))
    return d.select("doc_id", "p.content", F.size("p.calls").cast("bigint").alias("n_calls"), F.get("p.calls", F.lit(0))["arguments"].alias("arguments"))


def cleaned_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", completion.parsed("none", F.concat(F.lit("<think>"), "lang", F.lit("</think>"), "source", F.lit(" "))).alias("p"))
    return d.select("doc_id", "p.content", "p.reasoning")


def raw_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of token ids as raw JSON, good and bad."""
    kinds = F.array(*[F.lit(x) for x in ("[1, 2]", "[true]", "[-1]", "[1.0]", "null", "[]", '["3"]', "[1, 1e400]")])
    ids = F.element_at(kinds, (F.col("doc_id") % 8 + 1).cast("int"))
    return read(spark, sf_dir, "documents").select("doc_id", records.token_ids_ok(ids).alias("ok"))


def turn_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    tails = [[5, 7, 8, 9], [5, 7, 8], [5, 7], [5], [], [9, 8, 7]]
    stream = F.element_at(F.array(*[F.array(*map(F.lit, t)).cast("array<int>") for t in tails]), (F.col("doc_id") % 6 + 1).cast("int"))
    gap = tokens.turn_gap(stream, F.array(*map(F.lit, (7, 8, 9))))
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(gap, ",").alias("gap"))


def implicit_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix of doc_id % 4 tokens; every tenth pair of renders does not line up."""
    prefix = F.transform(F.sequence(F.lit(0), F.col("doc_id") % 4), lambda i: i + 100)
    block = F.array(F.lit(1), F.lit(2), F.lit(3)).cast("array<bigint>")
    one, odd = F.concat(prefix, block), F.when(F.col("doc_id") % 10 == 3, F.array(F.lit(9))).otherwise(F.slice(F.array(F.lit(9)), 1, 0)).cast("array<bigint>")
    p = tokens.implicit_prefix(one, F.concat(prefix, block, odd, block))
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(p, ",").alias("prefix"))


def sampled_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    header = F.array(F.lit(40), F.lit(41))
    stream = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit(1), F.lit(40), F.lit(41))).otherwise(F.array(F.lit(1), F.lit(2)))
    delta = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit(50), F.lit(6))).otherwise(F.array(F.lit(40), F.lit(41), F.lit(6)))
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(tokens.without_sampled_header(stream, delta, header), ",").alias("delta"))


def _blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One blob a turn, of its whole prompt and completion; some start too late, and some are whole ones again."""
    t = adapter.turns(spark, sf_dir).withColumn("n", F.col("n_prompt") + F.col("n_completion"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("session_id", "agent_id", "segment_index").orderBy("turn_ordinal").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = F.when((before == 0) | (F.col("conv_id") % 7 == 2), F.lit(0)).otherwise(before + F.when(F.col("conv_id") % 6 == 1, 1).otherwise(0))
    return t.select("session_id", "agent_id", "segment_index", F.col("turn_ordinal").alias("ordinal"), F.base64(F.regexp_replace(F.concat("prompt", "completion"), "[^\\x00-\\x7F]", "?").cast("binary")).alias("data"), F.col("n").alias("rows"), F.lit(1).cast("bigint").alias("cols"), start.cast("bigint").alias("start"))


def capture_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures of every segment from one blob a turn."""
    return captures.fold(_blobs(spark, sf_dir)).withColumn("data_sha", F.sha2(F.unbase64("data"), 256)).drop("data")


def capture_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as chunks, cut to the rows from the 50th to the 400th of each segment."""
    d = captures.rows_between(captures.chunks(_blobs(spark, sf_dir)), F.lit(50), F.lit(400))
    return d.withColumn("data_sha", F.sha2("bytes", 256)).drop("bytes")


def capture_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One capture of two rows for each whole embedding, quantised to bytes; every ninth has a value that doesn't fit."""
    value = lambda x: F.least(F.lit(255), F.greatest(F.lit(0), F.floor((x + 1) * 128))).cast("bigint")
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.array_join(F.transform("embedding", lambda x: F.concat(F.lpad(F.hex(value(x)), 2, "0"), F.lit("000000"))), "").alias("digits"))
    digits = F.when(F.col("vec_id") % 9 == 4, F.concat(F.lit("00010000"), F.substring("digits", 9, 1 << 30))).otherwise(F.col("digits"))
    d = e.withColumn("p", captures.pack(F.base64(F.unhex(digits)), F.lit(2), F.lit(1)))
    return d.select("vec_id", "p.rows", "p.cols", F.lower(F.hex(F.unbase64("p.data"))).alias("bytes"))


#: SQL that Spark and DuckDB both read: deliveries of turns with faults, then the log made of them. A third comes
#: twice; some turns are lost and delivered again, told as lost though they are there, or lost for good; some
#: sessions are deleted, and every session is collected, some twice. An ordinal is 100 seconds.
RECORDED = """
    t AS (SELECT *, -n_completion + sum(n_prompt + n_completion) OVER w AS n_all, sum(n_messages) OVER w AS n_seen FROM turns WINDOW w AS (PARTITION BY session_id, agent_id, segment_index ORDER BY turn_ordinal)),
    u AS (SELECT session_id, agent_id, conv_id, tn, turn_ordinal * 10 AS o, segment_index + CASE WHEN new_conversation THEN 0 WHEN conv_id % 11 = 2 THEN 1 WHEN conv_id % 11 = 5 THEN 2 ELSE 0 END AS segment_index,
        CASE WHEN conv_id % 17 = 6 AND tn = 2 THEN 'other' ELSE purpose END AS purpose, CAST(n_seen AS BIGINT) AS n_messages, @sha(concat(prompt, '/m')) AS messages_sha,
        CAST(CASE WHEN NOT new_conversation AND conv_id % 13 = 3 THEN 0 ELSE n_all END AS BIGINT) AS n_full_prompt, @sha(prompt) AS prompt_sha, n_completion, @sha(completion) AS completion_sha, conv_id % 5 IN (1, 3) AND tn = 1 AS lost FROM t),
    ev AS (SELECT session_id, o AS ordinal, CASE WHEN lost THEN 'failed' ELSE 'turn' END AS kind, agent_id, segment_index, purpose, n_messages, messages_sha, n_full_prompt, prompt_sha, n_completion, completion_sha FROM u
        UNION ALL SELECT session_id, o + 1, 'turn', agent_id, segment_index, purpose, n_messages, messages_sha, n_full_prompt, prompt_sha, n_completion, completion_sha FROM u WHERE conv_id % 3 = 0 AND NOT lost
        UNION ALL SELECT session_id, o + 2, 'failed', agent_id, segment_index, purpose, n_messages, messages_sha, n_full_prompt, prompt_sha, n_completion, completion_sha FROM u WHERE conv_id % 5 = 2 AND tn = 1
        UNION ALL SELECT session_id, o + 3, 'turn', agent_id, segment_index, purpose, n_messages, messages_sha, n_full_prompt, prompt_sha, n_completion, completion_sha FROM u WHERE conv_id % 5 IN (1, 2) AND tn = 1),
    ctl AS (SELECT session_id, o + 5 AS ordinal, 'delete' AS kind FROM u WHERE conv_id % 24 = 16 AND tn = 1
        UNION ALL SELECT session_id, o + 4, 'collect' FROM u WHERE conv_id % 4 = 0 AND tn = 2
        UNION ALL SELECT session_id, max(o) + 9, 'collect' FROM u GROUP BY session_id)"""


def recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of deliveries, losses, deletions and collections through the recorder."""
    log = f"""WITH {RECORDED} SELECT *, ordinal * 100000 AS ts FROM (SELECT * FROM ev UNION ALL
        SELECT session_id, ordinal, kind, CAST(NULL AS STRING), CAST(NULL AS BIGINT), CAST(NULL AS STRING), CAST(NULL AS BIGINT), CAST(NULL AS STRING), CAST(NULL AS BIGINT), CAST(NULL AS STRING), CAST(NULL AS BIGINT), CAST(NULL AS STRING) FROM ctl) q"""
    return recorder.record(query(log)(spark, sf_dir))


def live_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uses and deletes of streams in the control log, by profile, with 4096 streams held in each."""
    e = read(spark, sf_dir, "events")
    uses = e.select(F.concat(F.lit("p"), F.col("event_id") % 4).alias("profile"), F.concat(F.lit("s"), "user_id").alias("stream"), F.col("event_id").alias("ordinal"), F.when(F.col("event_type") == "error", "delete").otherwise("use").alias("action"))
    return recorder.live_streams(uses)


def _answers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list]:
    """Turns, and what a response takes: ids, contents with nulls and quotation marks, reasoning, none to two calls, usage."""
    t = adapter.turns(spark, sf_dir)
    call = lambda k: F.expr(f"named_struct('id', concat('c', tn, '-{k}'), 'name', 'look', 'arguments', concat('{{\"n\": ', conv_id, '}}'))")
    calls = F.when(F.col("conv_id") % 5 == 1, F.array(call(0))).when(F.col("conv_id") % 5 == 2, F.array(call(0), call(1))).when(F.col("conv_id") % 5 == 3, F.slice(F.array(call(0)), 1, 0))
    content = F.when(F.col("conv_id") % 4 != 1, F.concat(F.lit('turn "'), F.col("conv_id").cast("string"), F.lit('"')))
    reasoning = F.when(F.col("tn") % 2 == 1, F.concat(F.lit("why "), "tn"))
    return t, [F.concat(F.lit("chatcmpl-"), "conv_id", F.lit("-"), "tn"), F.col("conv_id") + 1700000000, F.lit("m"), content, reasoning, calls, F.when(F.size(calls) > 0, "tool_calls").otherwise(F.lit("stop")), F.col("n_prompt"), F.col("n_completion")]


def chat_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, parts = _answers(spark, sf_dir)
    return t.select("conv_id", "tn", records.response(*parts).alias("body"))


def event_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, parts = _answers(spark, sf_dir)
    return t.select("conv_id", "tn", F.posexplode(records.event_stream(*parts)).alias("place", "line"))


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as JSON with and without log-probabilities and captures, as digests; parsed views that are null, empty and full, captures of some sessions."""
    t = with_tokens(adapter.turns(spark, sf_dir))
    t = t.withColumn("content", F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit('said "'), "tn", F.lit('"')))).withColumn("reasoning_content", F.when(F.col("tn") % 2 == 0, F.lit(""))).withColumn("weight_version", F.when(F.col("conv_id") % 2 == 0, "7"))
    t = t.withColumn("tool_calls", F.when(F.col("conv_id") % 4 == 1, F.array(F.struct(F.lit("c").alias("id"), F.lit("look").alias("name")))).when(F.col("conv_id") % 4 == 2, F.slice(F.array(F.struct(F.lit("c").alias("id"), F.lit("look").alias("name"))), 1, 0)))
    fields = ["turn_ordinal", "agent_id", "prompt_ids", "completion_ids", "weight_version", "content", "reasoning_content", "tool_calls", "completion_logprobs"]
    r = t.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct(*fields)), lambda a, b: F.when(a["turn_ordinal"] < b["turn_ordinal"], -1).otherwise(1)).alias("turns"), F.min("conv_id").alias("c"))
    blob = F.create_map(F.lit("a0"), F.create_map(F.lit("0"), F.struct(F.lit("AQ==").alias("data"), F.lit(1).alias("rows"))))
    held = F.when(F.col("c") % 8 == 0, blob).when(F.col("c") % 8 == 4, F.map_filter(blob, lambda k, _: k != "a0"))
    r = r.select("session_id", F.struct("session_id", "turns", held.alias("segment_routed_experts")).alias("r"))
    full, lean = records.snapshot(F.col("r"), fields, True, True), records.snapshot(F.col("r"), fields, False, False)
    return r.select("session_id", F.sha2(full, 256).alias("full_sha"), F.sha2(lean, 256).alias("lean_sha"))


def chat_renders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as three templates write them, with the answer's header; a late system message is refused by the first."""
    c = read(spark, sf_dir, "conversations").withColumn("content", F.col("text"))
    last = F.struct((F.max("turn") + 1).alias("turn"), F.lit("system").alias("role"), F.lit("late").alias("content"))
    m = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "content"))).alias("m"), last.alias("more"))
    m = m.withColumn("m", F.when(F.col("conv_id") % 8 == 5, F.concat("m", F.array("more"))).otherwise(F.col("m")))
    name = F.element_at(F.array(*[F.lit(x) for x in ("chatml", "paired", "headed")]), (F.col("conv_id") % 3 + 1).cast("int"))
    d = m.select("conv_id", templates.rendered(name, F.to_json(F.transform("m", lambda x: F.struct(x.role.alias("role"), x.content.alias("content"))))).alias("r"))
    return d.select("conv_id", F.length("r.text").cast("bigint").alias("n_chars"), F.sha2("r.text", 256).alias("text_sha"), "r.error")


def wire_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies of three dialects made from turns, some broken, and what they decode to."""
    t = with_tokens(adapter.turns(spark, sf_dir))
    fault, dialect = F.col("conv_id") % 7, F.col("tn") % 3
    logprob = lambda x: (-(x % 16) / 16.0).cast("string")
    shown = lambda x, i: F.when((fault == 1) & (i == 0), "true").when((fault == 5) & (i == 0), "null").otherwise(logprob(x))
    other = lambda x, i: F.when((fault == 2) & (i == 0), x + 1).otherwise(x).cast("string")
    joined = lambda get: F.array_join(F.transform("completion_ids", get), ",")
    ids = F.concat(F.lit("["), F.array_join("completion_ids", ","), F.lit("]"))
    finish = F.when(fault == 3, "abort").otherwise(F.lit("stop"))
    listed = F.when(F.col("conv_id") % 5 == 0, F.lit("")).otherwise(F.concat(F.lit('"output_ids":'), ids, F.lit(",")))
    one = F.concat(F.lit("{"), listed, F.lit('"meta_info":{"finish_reason":{"type":"'), finish, F.lit('"},"weight_version":0,"output_token_logprobs":['), joined(lambda x, i: F.concat(F.lit("["), shown(x, i), F.lit(","), other(x, i), F.lit(",null]"))), F.lit("]}}"))
    entry = lambda x, i: F.concat(F.lit('{"logprob":'), shown(x, i), F.when(i % 2 == 0, F.concat(F.lit(',"token_id":'), other(x, i))).otherwise(F.concat(F.lit(',"token":"token_id:'), other(x, i), F.lit('"'))), F.lit("}"))
    half = F.floor(F.size("completion_ids") / 2).cast("string")
    spans = F.when(F.size("completion_ids") > 1, F.concat(F.lit('[{"start":0,"end":'), half, F.lit(',"version":"7"},{"start":'), half, F.lit(',"end":'), F.size("completion_ids").cast("string"), F.lit(',"version":"'), F.when(fault == 4, "8").otherwise(F.lit("7")), F.lit('"}]'))).otherwise(F.lit("null"))
    two = F.concat(F.lit('{"usage":{"completion_tokens":'), (F.size("completion_ids") + F.when(fault == 6, 1).otherwise(0)).cast("string"), F.lit('},"choices":[{"token_ids":'), ids, F.lit(',"finish_reason":"'), finish, F.lit('","weight_versions":'), spans, F.lit(',"logprobs":{"content":['), joined(entry), F.lit("]}}]}"))
    three = F.concat(F.lit('{"choices":[{"finish_reason":"'), finish, F.lit('","logprobs":{"tokens":['), joined(lambda x, i: F.concat(F.lit('"token_id:'), F.when((fault == 2) & (i == 0), "x").otherwise(x.cast("string")), F.lit('"'))), F.lit('],"token_logprobs":['), joined(shown), F.lit("]}}]}"))
    got = F.when(dialect == 0, wire.pairs_response(one)).when(dialect == 1, wire.content_response(two)).otherwise(wire.columns_response(three))
    # a generator keeps the answer from being merged into each expression that reads it
    d = t.select("conv_id", "tn", F.explode(F.array(got)).alias("r"))
    return d.select("conv_id", "tn", F.size("r.token_ids").cast("bigint").alias("n_tokens"), F.sha2(F.array_join("r.token_ids", ","), 256).alias("ids_sha"), F.aggregate("r.logprobs", F.lit(0.0), lambda a, x: a + x).alias("sum_logprob"), "r.finish", "r.version", "r.error")


_RECORD_FAULTS = ['{"session_id":"x"}', '{"turns":{}}', "no json", '{"turns":[3,"t"]}', '{"turns":[{"agent_id":5,"completion_token_ids":[]}]}', '{"turns":[{"agent_id":null,"new_conversation":1,"completion_token_ids":[1]}]}', '{"turns":[{"new_conversation":null,"completion_token_ids":[true]}]}', '{"turns":[{"prompt_token_ids":[1.0],"completion_token_ids":null}]}', '{"turns":[]}']
_RECORD_ERRORS = ["turns", "turns", "turns", "turn", "agent_id", "new_conversation", "completion_token_ids,new_conversation", "completion_token_ids,prompt_token_ids", ""]


def record_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as raw JSON: whole ones of each document's id, and some of wrong types."""
    whole = F.concat(F.lit('{"turns":[{"agent_id":"a","new_conversation":true,"prompt_token_ids":['), "doc_id", F.lit('],"completion_token_ids":['), "n_chars", F.lit(",0]}]}"))
    raw = F.coalesce(F.get(F.array(*map(F.lit, _RECORD_FAULTS)), (F.col("doc_id") % 12).cast("int")), whole)
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(records.type_errors(raw), ",").alias("errors"))


def session_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions as a collector asks for them: of conversations, some unknown, some failed, some answered with another's record."""
    t = adapter.turns(spark, sf_dir).groupBy("session_id").agg(F.min("conv_id").alias("c"))
    asked = t.select(F.col("session_id").alias("asked")).union(spark.createDataFrame([("s-1",)], "asked string"))
    named = F.when(F.col("c") % 3 == 1, F.concat("session_id", F.lit("x"))).otherwise(F.col("session_id"))
    held = t.where("c % 5 <> 4").select(F.col("session_id").alias("asked"), F.to_json(F.struct(named.alias("session_id"))).alias("raw"))
    return records.collected(asked, held, t.where("c % 7 = 0").select(F.col("session_id").alias("asked"))).select("asked", "verdict")


QUERIES = {f"tool_calls_{d}": _calls(d) for d in CASES} | {
    "harmony_ids": harmony_ids, "live_streams": live_streams, "wire_responses": wire_responses, "record_types": record_types, "session_identity": session_identity, "chat_renders": chat_renders,
    "tool_calls_llama3_json": bare_calls, "cleaned_texts": cleaned_texts, "raw_token_ids": raw_token_ids, "turn_gaps": turn_gaps, "implicit_prefixes": implicit_prefixes,
    "sampled_headers": sampled_headers, "capture_fold": capture_fold, "capture_chunks": capture_chunks, "capture_pack": capture_pack, "recorded_deliveries": recorded, "chat_responses": chat_responses, "event_streams": event_streams, "snapshots": snapshots,
}

_USAGE = """'"usage":{"prompt_tokens":' || n_prompt || ',"completion_tokens":' || n_completion || ',"total_tokens":' || (n_prompt + n_completion) || '}}'"""
#: Blobs folded one after the other, with what is stored as one text and as places of blobs.
_FOLDED = f"""WITH RECURSIVE {DUCK_TURNS},
        t AS (SELECT *, n_prompt + n_completion AS n, sum(n_prompt + n_completion) OVER (PARTITION BY session_id, agent_id, segment_index ORDER BY turn_ordinal) - n_prompt - n_completion AS before, row_number() OVER (PARTITION BY session_id, agent_id, segment_index ORDER BY turn_ordinal) AS place FROM turns),
        b AS (SELECT session_id, agent_id, segment_index, place, regexp_replace(prompt || completion, '[^\\x00-\\x7F]', '?', 'g') AS data, n, CASE WHEN before = 0 OR conv_id % 7 = 2 THEN 0 ELSE before + CASE WHEN conv_id % 6 = 1 THEN 1 ELSE 0 END END AS start FROM t),
        f AS (SELECT session_id, agent_id, segment_index, place, data, n, [place] AS kept, 1 AS accepted, 0 AS dropped FROM b WHERE place = 1
            UNION ALL SELECT session_id, agent_id, segment_index, place, CASE how WHEN 'add' THEN old || data WHEN 'new' THEN data ELSE old END, CASE how WHEN 'add' THEN stored + n WHEN 'new' THEN n ELSE stored END,
                CASE how WHEN 'add' THEN list_append(kept, place) WHEN 'new' THEN [place] ELSE kept END, accepted + CASE WHEN how = '' THEN 0 ELSE 1 END, dropped + CASE WHEN how = '' THEN 1 ELSE 0 END
            FROM (SELECT b.*, f.data AS old, f.n AS stored, f.kept, f.accepted, f.dropped, CASE WHEN b.start > 0 AND b.start = f.n THEN 'add' WHEN b.start = 0 AND b.n >= f.n THEN 'new' ELSE '' END AS how
                FROM f JOIN b ON b.session_id = f.session_id AND b.agent_id IS NOT DISTINCT FROM f.agent_id AND b.segment_index = f.segment_index AND b.place = f.place + 1) q),
        last_of AS (SELECT session_id, agent_id, segment_index, arg_max(f, place) AS last FROM f GROUP BY session_id, agent_id, segment_index)"""
_CONTENT = """CASE WHEN conv_id % 4 = 1 THEN 'null' ELSE '"turn \\"' || conv_id || '\\""' END"""
_WHY = """CASE WHEN tn % 2 = 1 THEN ',"reasoning_content":"why ' || tn || '"' ELSE '' END"""
_ONE = """'{@i@k"id":"c' || tn || '-@k","type":"function","function":{"name":"look","arguments":"{\\"n\\": ' || conv_id || '}"}}'"""
_LISTED = f"""CASE conv_id % 5 WHEN 1 THEN ',"tool_calls":[' || {_ONE.replace("@k", "0")} || ']' WHEN 2 THEN ',"tool_calls":[' || {_ONE.replace("@k", "0")} || ',' || {_ONE.replace("@k", "1")} || ']' ELSE '' END"""
ORACLE = {f"tool_calls_{d}": _expected(d) for d in CASES} | {
    "record_types": "SELECT doc_id, CASE doc_id % 12 " + " ".join(f"WHEN {i} THEN '{e}'" for i, e in enumerate(_RECORD_ERRORS)) + " ELSE '' END AS errors FROM documents",
    "session_identity": f"""WITH {DUCK_TURNS}, t AS (SELECT session_id, min(conv_id) AS c FROM turns GROUP BY session_id)
        SELECT session_id AS asked, CASE WHEN c % 5 = 4 THEN 'unknown' WHEN c % 7 = 0 THEN 'failed' WHEN c % 3 = 1 THEN 'another' ELSE 'ok' END AS verdict FROM t UNION ALL SELECT 's-1', 'unknown'""",
    "wire_responses": f"""WITH {DUCK_TURNS}, r AS (SELECT conv_id, tn, n_completion AS n, tn % 3 AS dialect, conv_id % 7 AS fault, CASE WHEN completion = '' THEN [] ELSE list_transform(string_split(completion, ''), lambda x: unicode(x)) END AS ids FROM turns),
        e AS (SELECT *, CASE WHEN fault = 3 THEN 'abort' WHEN n = 0 AND dialect = 1 AND fault = 6 THEN 'usage' WHEN n = 0 THEN 'empty' WHEN fault IN (1, 5) THEN 'logprobs' WHEN fault = 2 THEN CASE dialect WHEN 2 THEN 'token_ids' WHEN 1 THEN 'aligned' WHEN 0 THEN CASE WHEN conv_id % 5 <> 0 THEN 'aligned' END END
            WHEN fault = 4 AND dialect = 1 AND n > 1 THEN 'version' WHEN fault = 6 AND dialect = 1 THEN 'usage' END AS error FROM r),
        f AS (SELECT *, CASE WHEN fault = 2 AND dialect = 0 AND conv_id % 5 = 0 AND n > 0 THEN list_concat([ids[1] + 1], ids[2:]) ELSE ids END AS seen FROM e)
        SELECT conv_id, tn, CASE WHEN error IS NULL THEN n END AS n_tokens, CASE WHEN error IS NULL THEN sha256(array_to_string(list_transform(seen, lambda x: CAST(x AS VARCHAR)), ',')) END AS ids_sha, CASE WHEN error IS NULL THEN list_sum(list_transform(ids, lambda x: CAST(-(x % 16) / 16.0 AS DOUBLE))) END AS sum_logprob,
            CASE WHEN error IS NULL THEN 'stop' END AS finish, CASE WHEN error IS NULL THEN CASE WHEN dialect = 0 THEN '0' WHEN dialect = 1 AND n > 1 THEN '7' END END AS version, error FROM f""",
    "chat_renders": """WITH m AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT conv_id, max(turn) + 1, 'system', 'late' FROM conversations WHERE conv_id % 8 = 5 GROUP BY conv_id),
        n AS (SELECT *, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id) AS asked FROM m),
        p AS (SELECT conv_id, place, turn, role, conv_id % 3 AS kind, conv_id % 3 = 0 AND role = 'system' AND place > 1 AS late, CASE conv_id % 3
            WHEN 0 THEN '<|im_start|>' || role || chr(10) || CASE WHEN role = 'assistant' AND turn > asked THEN '<think>' || chr(10) || chr(10) || '</think>' || chr(10) || chr(10) ELSE '' END || t || '<|im_end|>' || chr(10)
            WHEN 1 THEN CASE role WHEN 'user' THEN '<|user|>' || text WHEN 'system' THEN '<|system|>' || text ELSE '<|assistant|><think></think>' || t END
            ELSE CASE WHEN role = 'system' AND place = 1 THEN '' ELSE '<|start_header_id|>' || role || '<|end_header_id|>' || chr(10) || chr(10) || t || '<|eot_id|>' END END AS part, CASE WHEN role = 'system' AND place = 1 THEN t ELSE '' END AS head FROM n),
        q AS (SELECT conv_id, bool_or(late) AS late, CASE kind WHEN 0 THEN '' WHEN 1 THEN '[gMASK]<sop><|system|>Reasoning Effort: Max' ELSE '<|begin_of_text|><|start_header_id|>system<|end_header_id|>' || chr(10) || chr(10) || 'Cutting Knowledge Date: December 2023' || chr(10) || 'Today Date: 26 Jul 2024' || chr(10) || chr(10) || max(head) || '<|eot_id|>' END
            || string_agg(part, '' ORDER BY turn) || CASE kind WHEN 0 THEN '<|im_start|>assistant' || chr(10) WHEN 1 THEN '<|assistant|>' ELSE '<|start_header_id|>assistant<|end_header_id|>' || chr(10) || chr(10) END AS r FROM p GROUP BY conv_id, kind)
        SELECT conv_id, CASE WHEN NOT late THEN CAST(length(r) AS BIGINT) END AS n_chars, CASE WHEN NOT late THEN sha256(r) END AS text_sha, CASE WHEN late THEN 'a system message must come first' END AS error FROM q""",
    "harmony_ids": "SELECT doc_id, '<|return|>' || lang AS content, '<|end|>' || source AS reasoning, CAST(0 AS BIGINT) AS n_calls FROM documents WHERE lang IS NOT NULL",
    # a chain of turns and losses for each agent between two deletions, and collections that look at their ends
    "recorded_deliveries": f"""WITH RECURSIVE {DUCK_TURNS}, {RECORDED.replace("@sha(", "sha256(")},
        e AS (SELECT ev.*, coalesce(d.ordinal, -1000) AS cut, ev.ordinal - coalesce(d.ordinal, -1000) < 36 AS late FROM ev ASOF LEFT JOIN (SELECT * FROM ctl WHERE kind = 'delete') d ON ev.session_id = d.session_id AND ev.ordinal >= d.ordinal),
        x AS (SELECT *, row_number() OVER (PARTITION BY session_id, agent_id, cut ORDER BY ordinal) AS place, concat_ws('|', segment_index, purpose, messages_sha, prompt_sha, completion_sha) AS mark FROM e WHERE NOT late),
        f AS (SELECT session_id, agent_id, cut, CAST(0 AS BIGINT) AS place, CAST(-1 AS BIGINT) AS ordinal, '' AS kind, CAST(NULL AS VARCHAR) AS reason, false AS repaired, CAST(-1 AS BIGINT) AS g, CAST(0 AS BIGINT) AS m, CAST(0 AS BIGINT) AS s, CAST(0 AS BIGINT) AS l, '' AS c, '' AS p, CAST(0 AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS lost FROM x WHERE place = 1
            UNION ALL SELECT session_id, agent_id, cut, place, ordinal, kind, why, fits,
                CASE WHEN why IS NULL AND kind = 'turn' THEN segment_index ELSE g END, CASE WHEN why IS NULL AND kind = 'turn' THEN n_messages ELSE m END, CASE WHEN why IS NULL AND kind = 'turn' THEN n_full_prompt + n_completion ELSE s END, CASE WHEN why IS NULL AND kind = 'turn' THEN n_completion ELSE l END,
                CASE WHEN why IS NULL AND kind = 'turn' THEN completion_sha ELSE c END, CASE WHEN why IS NULL AND kind = 'turn' THEN purpose ELSE p END, CASE WHEN why IS NULL AND kind = 'turn' THEN n + 1 ELSE n END,
                CASE WHEN kind = 'failed' THEN coalesce(lost, mark || '|' || n) WHEN fits THEN NULL ELSE lost END
            FROM (SELECT *, kind = 'turn' AND coalesce(lost = mark || '|' || n, false) AND coalesce(why, 'repeat') = 'repeat' AS fits FROM (SELECT x.*, f.g, f.m, f.s, f.l, f.c, f.p, f.n, f.lost, CASE
                WHEN x.kind = 'failed' THEN CASE WHEN f.lost IS NOT NULL THEN 'held' END WHEN x.purpose = 'other' THEN 'purpose' WHEN x.segment_index = f.g + 1 THEN NULL WHEN x.segment_index <> f.g THEN 'segment'
                WHEN x.n_messages = f.m AND x.completion_sha = f.c AND x.purpose = f.p AND x.n_full_prompt + f.l = f.s THEN 'repeat' WHEN x.n_messages <= f.m OR x.n_full_prompt < f.s THEN 'short' END AS why
                FROM f JOIN x ON x.session_id = f.session_id AND x.agent_id IS NOT DISTINCT FROM f.agent_id AND x.cut = f.cut AND x.place = f.place + 1) q) r),
        c AS (SELECT k.session_id, k.ordinal, coalesce(d.ordinal, -1000) AS cut, k.ordinal - coalesce(d.ordinal, -1000) < 36 AS late FROM (SELECT * FROM ctl WHERE kind = 'collect') k ASOF LEFT JOIN (SELECT * FROM ctl WHERE kind = 'delete') d ON k.session_id = d.session_id AND k.ordinal >= d.ordinal),
        seen AS (SELECT c.session_id, c.ordinal, coalesce(bool_or(f.kind = 'turn'), false) AS known, string_agg(CASE WHEN f.kind = 'turn' AND f.reason IS NULL THEN CAST(f.ordinal AS VARCHAR) END, ',' ORDER BY f.ordinal) AS recorded FROM c LEFT JOIN f ON f.session_id = c.session_id AND f.cut = c.cut AND f.ordinal < c.ordinal AND f.place > 0 AND NOT c.late GROUP BY c.session_id, c.ordinal),
        ends AS (SELECT session_id, ordinal, bool_or(lost IS NOT NULL) AS open FROM (SELECT c.session_id, c.ordinal, f.agent_id, arg_max(struct_pack(x := f.lost), f.place).x AS lost FROM c JOIN f ON f.session_id = c.session_id AND f.cut = c.cut AND f.ordinal < c.ordinal GROUP BY c.session_id, c.ordinal, f.agent_id) q GROUP BY session_id, ordinal)
        SELECT session_id, agent_id, ordinal, kind, reason IS NULL AS accepted, reason, s AS stream_len, n AS n_turns, repaired, false AS late, CAST(NULL AS VARCHAR) AS recorded FROM f WHERE place > 0
        UNION ALL SELECT session_id, agent_id, ordinal, kind, false, 'deleted', 0, 0, false, kind = 'turn', NULL FROM e WHERE late
        UNION ALL SELECT session_id, NULL, ordinal, kind, true, NULL, 0, 0, false, false, NULL FROM ctl WHERE kind = 'delete'
        UNION ALL SELECT s.session_id, NULL, s.ordinal, 'collect', known AND NOT coalesce(open, false), CASE WHEN NOT known THEN 'unknown' WHEN open THEN 'failed' END, 0, 0, false, false, CASE WHEN known AND NOT coalesce(open, false) THEN coalesce(recorded, '') END FROM seen s LEFT JOIN ends USING (session_id, ordinal)""",
    "capture_fold": f"""{_FOLDED}
        SELECT session_id, agent_id, segment_index, CAST(last.n AS BIGINT) AS "rows", CAST(1 AS BIGINT) AS cols, CAST(last.accepted AS BIGINT) AS accepted, CAST(last.dropped AS BIGINT) AS dropped, sha256(last.data) AS data_sha FROM last_of""",
    "capture_chunks": f"""{_FOLDED},
        k AS (SELECT session_id, agent_id, segment_index, unnest(last.kept) AS place, generate_subscripts(last.kept, 1) - 1 AS chunk FROM last_of),
        p AS (SELECT k.*, b.data, b.n, sum(b.n) OVER (PARTITION BY k.session_id, k.agent_id, k.segment_index ORDER BY k.chunk) - b.n AS first FROM k JOIN b ON b.session_id = k.session_id AND b.agent_id IS NOT DISTINCT FROM k.agent_id AND b.segment_index = k.segment_index AND b.place = k.place),
        c AS (SELECT *, greatest(first, 50) AS lo, least(first + n, 400) AS hi FROM p)
        SELECT session_id, agent_id, segment_index, CAST(chunk AS INTEGER) AS chunk, CAST(lo AS BIGINT) AS first, CAST(hi - lo AS BIGINT) AS "rows", CAST(1 AS BIGINT) AS cols, sha256(substr(data, CAST(lo - first + 1 AS BIGINT), CAST(hi - lo AS BIGINT))) AS data_sha FROM c WHERE lo < hi""",
    "snapshots": f"""WITH {DUCK_TURNS},
        ids AS (SELECT *, CASE WHEN prompt = '' THEN [] ELSE list_transform(string_split(prompt, ''), lambda x: unicode(x)) END AS p, CASE WHEN completion = '' THEN [] ELSE list_transform(string_split(completion, ''), lambda x: unicode(x)) END AS c FROM turns),
        j AS (SELECT session_id, turn_ordinal, conv_id, '{{"turn_ordinal":' || turn_ordinal || ',"agent_id":' || coalesce('"' || agent_id || '"', 'null') || ',"prompt_ids":[' || array_to_string(list_transform(p, lambda t: CAST(t AS VARCHAR)), ',') || '],"completion_ids":[' || array_to_string(list_transform(c, lambda t: CAST(t AS VARCHAR)), ',') || ']'
            || CASE WHEN conv_id % 2 = 0 THEN ',"weight_version":"7"' ELSE ',"weight_version":null' END || CASE WHEN conv_id % 3 = 0 THEN ',"content":"said \\"' || tn || '\\""' ELSE '' END || CASE WHEN tn % 2 = 0 THEN ',"reasoning_content":""' ELSE '' END
            || CASE conv_id % 4 WHEN 1 THEN ',"tool_calls":[{{"id":"c","name":"look"}}]' WHEN 2 THEN ',"tool_calls":[]' ELSE '' END AS lean, ',"completion_logprobs":[' || array_to_string(list_transform(c, lambda t: CAST(-(t % 16) / 16.0 AS VARCHAR)), ',') || ']' AS more FROM ids),
        g AS (SELECT session_id, min(conv_id) AS c, string_agg(lean || '}}', ',' ORDER BY turn_ordinal) AS lean, string_agg(lean || more || '}}', ',' ORDER BY turn_ordinal) AS whole FROM j GROUP BY session_id)
        SELECT session_id, sha256('{{"session_id":"' || session_id || '","turns":[' || whole || ']' || CASE WHEN c % 8 = 0 THEN ',"segment_routed_experts":{{"a0":{{"0":{{"data":"AQ==","rows":1}}}}}}' ELSE '' END || '}}') AS full_sha, sha256('{{"session_id":"' || session_id || '","turns":[' || lean || ']}}') AS lean_sha FROM g""",
    "tool_calls_llama3_json": """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '' ELSE 'plain ' || source END AS content, CAST(CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS n_calls, CASE WHEN doc_id % 2 = 0 THEN '{"n": ' || n_chars || '}' END AS arguments FROM documents""",
    "cleaned_texts": "SELECT doc_id, source AS content, lang AS reasoning FROM documents",
    "raw_token_ids": "SELECT doc_id, doc_id % 8 IN (0, 5) AS ok FROM documents",
    "turn_gaps": "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '' WHEN 1 THEN '9' WHEN 2 THEN '8,9' WHEN 5 THEN '8,9' ELSE '7,8,9' END AS gap FROM documents",
    "implicit_prefixes": "SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN NULL ELSE CASE doc_id % 4 WHEN 0 THEN '100' WHEN 1 THEN '100,101' WHEN 2 THEN '100,101,102' ELSE '100,101,102,103' END END AS prefix FROM documents",
    "sampled_headers": "SELECT doc_id, CASE WHEN doc_id % 2 = 1 THEN CASE WHEN doc_id % 3 = 0 THEN '50,6' ELSE '40,41,6' END WHEN doc_id % 3 = 0 THEN NULL ELSE '6' END AS delta FROM documents",
    "capture_pack": """SELECT vec_id, CASE WHEN fits THEN CAST(2 AS BIGINT) END AS "rows", CASE WHEN fits THEN CAST(n / 2 AS BIGINT) END AS cols, CASE WHEN fits THEN bytes END AS bytes
        FROM (SELECT vec_id, vec_id % 9 <> 4 AS fits, count(*) AS n, string_agg(printf('%02x', CAST(least(255, greatest(0, floor((CAST(embedding[i] AS DOUBLE) + 1) * 128))) AS INTEGER)), '' ORDER BY i) AS bytes FROM embeddings, unnest(generate_series(1, len(embedding))) AS g(i) GROUP BY vec_id) q""",
    "chat_responses": f"""WITH {DUCK_TURNS} SELECT conv_id, tn, '{{"id":"chatcmpl-' || conv_id || '-' || tn || '","object":"chat.completion","created":' || (1700000000 + conv_id) || ',"model":"m","choices":[{{"index":0,"message":{{"role":"assistant","content":' || {_CONTENT} || {_LISTED.replace("@i0", "").replace("@i1", "")} || {_WHY}
        || '}},"finish_reason":"' || CASE WHEN conv_id % 5 IN (1, 2) THEN 'tool_calls' ELSE 'stop' END || '"}}],' || {_USAGE} AS body FROM turns""",
    "event_streams": f"""WITH {DUCK_TURNS}, b AS (SELECT *, 'data: {{"id":"chatcmpl-' || conv_id || '-' || tn || '","object":"chat.completion.chunk","created":' || (1700000000 + conv_id) || ',"model":"m","choices":[{{"index":0,"delta":{{' AS head FROM turns)
        SELECT conv_id, tn, 0 AS place, head || '"role":"assistant","content":' || {_CONTENT} || {_WHY} || {_LISTED.replace("@i0", '"index":0,').replace("@i1", '"index":1,')} || '}},"finish_reason":null}}]}}' AS line FROM b
        UNION ALL SELECT conv_id, tn, 1, head || '}},"finish_reason":"' || CASE WHEN conv_id % 5 IN (1, 2) THEN 'tool_calls' ELSE 'stop' END || '"}}],' || {_USAGE} FROM b UNION ALL SELECT conv_id, tn, 2, 'data: [DONE]' FROM b""",
}
