"""Turns to training streams: aligned tokens, loss masks, log-probabilities and spans.

Tokens are code points; a turn's arrays are made once and a stream is one ordered concatenation,
so the shuffle moves one row a turn. Streams are keyed null-safely by agent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from turnloom.sources import adapter

KEYS = ["session_id", "agent_id", "segment_index"]


def points(text: str) -> str:
    """SQL: the code points of a text; none for the empty one."""
    return f"CASE WHEN {text} = '' THEN CAST(array() AS array<bigint>) ELSE transform(split({text}, ''), c -> CAST(ascii(c) AS bigint)) END"


def with_tokens(turns: DataFrame) -> DataFrame:
    d = turns.withColumn("prompt_ids", F.expr(points("prompt"))).withColumn("completion_ids", F.expr(points("completion")))
    return d.withColumn("completion_logprobs", F.transform("completion_ids", lambda t: -(t % 16) / 16.0))


def record_to_streams(turns: DataFrame) -> DataFrame:
    """One row a stream: tokens, loss_mask, logprobs and spans in turn order.

    Prompt tokens have mask 0 and log-probability 0; completion tokens have mask 1 only if their
    turn's purpose is primary. A turn with a null ordinal sorts first; streams of no turns do not
    exist. Span ends are running sums over the stream's turns, before they are put together.
    """
    length = F.size("prompt_ids") + F.size("completion_ids")
    turns = turns.withColumn("end", F.sum(length.cast("bigint")).over(_before_and_here()))
    piece = F.struct("turn_ordinal", "prompt_ids", "completion_ids", "completion_logprobs", "purpose", "weight_version", "end")
    g = turns.groupBy(*KEYS).agg(F.array_sort(F.collect_list(piece)).alias("turns"))
    g = g.withColumn("tokens", F.flatten(F.transform("turns", lambda t: F.concat(t.prompt_ids, t.completion_ids))))
    mask = lambda t: F.concat(F.array_repeat(F.lit(0), F.size(t.prompt_ids)), F.array_repeat(F.when(t.purpose == "primary", 1).otherwise(0), F.size(t.completion_ids)))
    g = g.withColumn("loss_mask", F.flatten(F.transform("turns", mask)))
    g = g.withColumn("logprobs", F.flatten(F.transform("turns", lambda t: F.concat(F.array_repeat(F.lit(0.0), F.size(t.prompt_ids)), t.completion_logprobs))))
    span = lambda t: F.struct((t.end - F.size(t.completion_ids)).alias("start"), t.end.alias("end"), t.purpose.alias("purpose"), t.weight_version.alias("version"))
    return g.withColumn("spans", F.transform("turns", span)).select(*KEYS, F.expr("turns[0].turn_ordinal").alias("first_ordinal"), "tokens", "loss_mask", "logprobs", "spans")


def _before_and_here() -> WindowSpec:
    return Window.partitionBy(*KEYS).orderBy("turn_ordinal").rowsBetween(Window.unboundedPreceding, 0)


def validate_streams(streams: DataFrame) -> DataFrame:
    """Keys and one boolean a rule.

    aligned lists; binary_mask; finite log-probabilities; ordered spans within the stream, which covers says
    they reach the end of; mask_in_spans: the mask is 1 in primary spans and 0 elsewhere;
    quiet_prompts: log-probabilities are 0 outside of spans.
    """
    places = "CASE WHEN size(spans) > 0 THEN sequence(0, size(spans) - 1) ELSE CAST(array() AS array<int>) END"
    start = "if(i = 0, 0L, get(spans, i - 1).end)"
    expected = f"flatten(transform({places}, i -> concat(array_repeat(0, CAST(greatest(0L, spans[i].start - {start}) AS int)), array_repeat(if(spans[i].purpose = 'primary', 1, 0), CAST(greatest(0L, spans[i].end - spans[i].start) AS int)))))"
    rules = {
        "aligned": "size(tokens) = size(loss_mask) AND size(tokens) = size(logprobs)",
        "binary_mask": "forall(loss_mask, m -> m IN (0, 1))",
        "finite": "forall(logprobs, p -> p IS NOT NULL AND NOT isnan(p) AND abs(p) < double('Infinity'))",
        "ordered": f"forall({places}, i -> {start} <= spans[i].start AND spans[i].start <= spans[i].end AND spans[i].end <= size(tokens))",
        "covers": "coalesce(try_element_at(spans, -1).end, 0L) = size(tokens)",
        "mask_in_spans": f"loss_mask = {expected}",
        "quiet_prompts": f"forall({places}, i -> forall(slice(logprobs, CAST({start} + 1 AS int), CAST(greatest(0L, spans[i].start - {start}) AS int)), p -> p = 0))",
    }
    return streams.select(*KEYS, *[F.coalesce(F.expr(rule), F.lit(False)).alias(name) for name, rule in rules.items()])


def training_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = record_to_streams(with_tokens(adapter.turns(spark, sf_dir)))
    digest = lambda c: F.sha2(F.array_join(c, ","), 256)
    return s.select(*KEYS, "first_ordinal", F.size("tokens").cast("bigint").alias("n_tokens"), F.aggregate("loss_mask", F.lit(0).cast("bigint"), lambda a, m: a + m).alias("n_trainable"), F.aggregate("logprobs", F.lit(0.0), lambda a, p: a + p).alias("sum_logprob"), digest("tokens").alias("tokens_sha"), digest("loss_mask").alias("mask_sha"))


def stream_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules of all streams, of which some are tampered with: each fault by segment and first turn."""
    s = record_to_streams(with_tokens(adapter.turns(spark, sf_dir)))
    kind = (F.col("first_ordinal") + F.col("segment_index")) % 9
    last = F.try_element_at("spans", F.lit(-1))
    s = s.withColumn("loss_mask", F.when(kind == 1, F.concat(F.slice("loss_mask", 1, F.size("loss_mask") - 1), F.array(F.lit(2)))).when(kind == 2, F.array_append("loss_mask", F.lit(0))).when(kind == 3, F.transform("loss_mask", lambda m: F.lit(0))).otherwise(F.col("loss_mask")))
    s = s.withColumn("logprobs", F.when(kind == 4, F.transform("logprobs", lambda p, i: F.when(i == 0, F.lit(float("nan"))).otherwise(p))).when(kind == 5, F.slice("logprobs", 1, F.size("logprobs") - 1)).otherwise(F.col("logprobs")))
    s = s.withColumn("spans", F.when(kind == 6, F.concat(F.slice("spans", 1, F.size("spans") - 1), F.array(last.withField("end", last["end"] + 1)))).when(kind == 7, F.transform("spans", lambda x: x.withField("start", x.end + 1))).otherwise(F.col("spans")))
    return validate_streams(s)


def reconstructed(turns: DataFrame) -> DataFrame:
    """n_full of each turn: how many of its segment's stream tokens are its full prompt.

    A full prompt is all tokens of its segment before the turn, and the turn's own prompt delta: the
    stream's first n_full tokens. It is given by that number, as whole copies of it would grow with
    the square of a segment's turns; full_prompt() makes one from a stream.
    """
    n = (F.size("prompt_ids") + F.size("completion_ids")).cast("bigint")
    return turns.withColumn("n_full", F.sum(n).over(_before_and_here()) - F.size("completion_ids"))


def full_prompt(tokens: Column, n_full: Column) -> Column:
    """The full prompt of a turn, from its stream's tokens."""
    return F.slice(tokens, F.lit(1), n_full.cast("int"))


def full_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length and a checksum of every full prompt: each token times its place in it, which are summed along the stream."""
    d = reconstructed(with_tokens(adapter.turns(spark, sf_dir)))
    weighed = lambda ids, start: F.aggregate(F.transform(ids, lambda t, i: t * ((start + i) % 1009 + 1)), F.lit(0).cast("bigint"), lambda a, x: a + x)
    at = F.col("n_full") - F.size("prompt_ids")
    both = weighed(F.col("prompt_ids"), at) + weighed(F.col("completion_ids"), F.col("n_full"))
    d = d.withColumn("checksum", F.sum(both).over(_before_and_here()) - weighed(F.col("completion_ids"), F.col("n_full")))
    return d.select(*KEYS, "turn_ordinal", "n_full", "checksum")


QUERIES = {"training_streams": training_streams, "stream_rules": stream_rules, "full_prompts": full_prompts}

_EXPLODED = """tok AS (
    SELECT session_id, agent_id, segment_index, turn_ordinal, 0 AS part, i, unicode(substr(prompt, CAST(i AS INT), 1)) AS t, 0 AS m FROM turns, unnest(generate_series(1, n_prompt)) AS g(i)
    UNION ALL SELECT session_id, agent_id, segment_index, turn_ordinal, 1, i, unicode(substr(completion, CAST(i AS INT), 1)), CASE WHEN purpose = 'primary' THEN 1 ELSE 0 END FROM turns, unnest(generate_series(1, n_completion)) AS g(i))"""

ORACLE = {
    "training_streams": f"""WITH {adapter.DUCK_TURNS}, {_EXPLODED}
        SELECT session_id, agent_id, segment_index, (SELECT min(turn_ordinal) FROM turns u WHERE u.session_id = q.session_id AND u.agent_id IS NOT DISTINCT FROM q.agent_id AND u.segment_index = q.segment_index) AS first_ordinal, n_tokens, n_trainable, sum_logprob, tokens_sha, mask_sha
        FROM (SELECT session_id, agent_id, segment_index, count(*) AS n_tokens, CAST(sum(m) AS BIGINT) AS n_trainable, CAST(sum(CASE WHEN part = 1 THEN -(t % 16) / 16.0 ELSE 0 END) AS DOUBLE) AS sum_logprob,
            sha256(string_agg(CAST(t AS VARCHAR), ',' ORDER BY turn_ordinal, part, i)) AS tokens_sha, sha256(string_agg(CAST(m AS VARCHAR), ',' ORDER BY turn_ordinal, part, i)) AS mask_sha FROM tok GROUP BY session_id, agent_id, segment_index) q""",
    "stream_rules": f"""WITH {adapter.DUCK_TURNS}, {_EXPLODED},
        s AS (SELECT session_id, agent_id, segment_index, (min(turn_ordinal) + segment_index) % 9 AS kind, arg_min(n_prompt, turn_ordinal) AS first_prompt,
            sum(CASE WHEN purpose = 'primary' THEN n_completion ELSE 0 END) AS n_trained FROM turns GROUP BY session_id, agent_id, segment_index),
        loud AS (SELECT DISTINCT session_id, agent_id, segment_index FROM tok WHERE part = 1 AND t % 16 <> 0)
        SELECT s.session_id, s.agent_id, s.segment_index, kind NOT IN (2, 5) AS aligned, kind <> 1 AS binary_mask, kind <> 4 AS finite, kind NOT IN (6, 7) AS ordered, kind <> 6 AS covers,
            kind NOT IN (1, 2, 6, 7) AND (kind <> 3 OR n_trained = 0) AS mask_in_spans, CASE kind WHEN 4 THEN first_prompt = 0 WHEN 7 THEN loud.session_id IS NULL ELSE TRUE END AS quiet_prompts
        FROM s LEFT JOIN loud ON loud.session_id = s.session_id AND loud.agent_id IS NOT DISTINCT FROM s.agent_id AND loud.segment_index = s.segment_index""",
    "full_prompts": f"""WITH {adapter.DUCK_TURNS}, {_EXPLODED},
        placed AS (SELECT *, row_number() OVER (PARTITION BY session_id, agent_id, segment_index ORDER BY turn_ordinal, part, i) - 1 AS place FROM tok)
        SELECT a.session_id, a.agent_id, a.segment_index, a.turn_ordinal, count(b.t) AS n_full, CAST(coalesce(sum(b.t * (b.place % 1009 + 1)), 0) AS BIGINT) AS checksum
        FROM turns a LEFT JOIN placed b ON a.session_id = b.session_id AND a.agent_id IS NOT DISTINCT FROM b.agent_id AND a.segment_index = b.segment_index AND (b.turn_ordinal < a.turn_ordinal OR b.turn_ordinal = a.turn_ordinal AND b.part = 0)
        GROUP BY a.session_id, a.agent_id, a.segment_index, a.turn_ordinal""",
}
