"""Prompts of a stream: an opening is rendered whole, a continuation is the stream, the gap and the delta.

The stream's tokens are never rendered again: what was sampled stays as it was sampled. A prompt is
given as what it adds to the stream before it (added) and as its length, as whole prompts would grow
with the square of a segment's turns. Renderer, tokenizer and profile are given; by default a
message's text is its render and tokens are code points.
"""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.functions import templates
from turnloom.sources import adapter
from turnloom.streaming.ordered_fold import in_order

Encode = Callable[[str], list[int]]
KEYS = ["session_id", "agent_id", "segment_index"]
Turn = namedtuple("Turn", "session_id agent_id segment_index turn_ordinal role prompt completion tools effort")
OUT = "session_id string, agent_id string, segment_index bigint, turn_ordinal bigint, n_prompt_ids bigint, added array<bigint>, error string"


def code_points(text: str) -> list[int]:
    return [ord(c) for c in text]


def starts(ids: list[int], head: list[int]) -> bool:
    return bool(head) and ids[: len(head)] == head


def gap(stream: list[int], ending: list[int]) -> list[int]:
    """What of ending the stream's tail lacks."""
    return next((ending[k:] for k in range(len(ending), 0, -1) if stream[-k:] == ending[:k]), ending)


@dataclass(frozen=True)
class Profile:
    """What a model's template puts around messages.

    prefix: what every render starts with (None if it could not be measured). system_header: how a
    system block starts. ending: what ends a turn. generation: the header of the answer. headers:
    role headers that a model can sample as its stop. complete: other marks that end an answer, behind which no ending follows.
    """

    name: str
    prefix: str | None = ""
    system_header: str = ""
    ending: str = "~"
    generation: str = ""
    headers: tuple[str, ...] = field(default=())
    complete: tuple[str, ...] = field(default=())

    def __post_init__(self) -> None:
        if not self.name:
            raise ValueError("a profile needs a name")
        if any(not h for h in (*self.headers, *self.complete)):
            raise ValueError("a continuation header or a mark of an end cannot be empty")


def chat(name: str) -> Profile:
    """The profile of a chat template: its start is measured, its ending and its answer's header are its own."""
    return Profile(name, templates.implicit_prefix(name), ending=templates.profile(name).ending, generation=templates.header(name))


class Stream:
    """One segment's stream, of which the end is held: as much as endings and headers can look at."""

    def __init__(self, profile: Profile, encode: Encode) -> None:
        self.profile, self.encode = profile, encode
        self.prefix = None if profile.prefix is None else encode(profile.prefix)
        self.system, self.ending, self.generation = encode(profile.system_header), encode(profile.ending), encode(profile.generation)
        self.headers = [encode(h) for h in profile.headers]
        self.complete = [encode(c) for c in profile.complete]
        self.keep = max(map(len, [self.ending, *self.headers, *self.complete, [0]]))
        self.tail: list[int] = []
        self.length, self.tools, self.effort = 0, None, None

    def added(self, role: str, text: str, tools: str | None, effort: str | None = None) -> list[int]:
        """Ids that a turn's prompt adds to the stream; text is the render of its new messages, prefix included."""
        ids = self.encode(text)
        if not self.length:
            self.tools, self.effort = tools, effort
            return ids + self.generation
        if tools != self.tools:
            raise ValueError("tools changed")
        if effort != self.effort:
            raise ValueError("effort changed")
        if self.prefix is not None:
            if self.prefix and not starts(ids, self.prefix):
                raise ValueError("delta without the render's prefix")
            ids = ids[len(self.prefix) :]
        elif role != "system" and starts(ids, self.system):
            raise ValueError("delta with a system prefix")
        sampled = next((h for h in self.headers if self.tail[-len(h) :] == h), [])
        if sampled and not starts(ids, sampled):
            raise ValueError("sampled header of another role")
        ended = any(self.tail[-len(c) :] == c for c in self.complete)
        return ([] if ended else gap(self.tail, self.ending)) + ids[len(sampled) :] + self.generation

    def turn(self, role: str, text: str, completion: str, tools: str | None, effort: str | None = None) -> tuple[int | None, list[int] | None, str | None]:
        """(prompt length, added ids, error); a turn with an error leaves the stream as it is."""
        try:
            added = self.added(role, text, tools, effort)
        except ValueError as why:
            return None, None, str(why)
        done = self.encode(completion)
        n = self.length + len(added)
        self.length = n + len(done)
        self.tail = (self.tail + added + done)[-self.keep :]
        return n, added, None


def build(turns: DataFrame, profile: Profile, encode: Encode = code_points) -> DataFrame:
    """Prompts of turns (keys, turn_ordinal, role of the first new message, prompt, completion, tools and, if there is one, effort)."""
    if "effort" not in turns.columns:
        turns = turns.withColumn("effort", F.lit(None).cast("string"))

    def fold(rows: Iterator[Turn]) -> Iterator[tuple]:
        stream = Stream(profile, encode)
        for r in rows:
            yield (*r[:4], *stream.turn(r.role, r.prompt or "", r.completion or "", r.tools, r.effort))

    return in_order(turns.select(*Turn._fields), KEYS, ["turn_ordinal"], Turn, fold, OUT)


def continuations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a profile with a prefix and a sampled header; some renders lack the prefix, some tools or efforts change, some answers end a turn themselves, wholly or in part."""
    t = adapter.turns(spark, sf_dir)
    cut = lambda name, when, text: F.when(when, F.lit(text)).otherwise(F.lit(name))
    place = F.col("conv_id") + F.col("tn")
    seen = F.concat(cut("P", place % 19 == 4, "Q"), F.when((F.col("conv_id") % 5 == 1) & (place % 4 != 3), F.lit("<u>")).otherwise(F.lit("")), "prompt")
    done = F.concat("completion", F.when(F.col("conv_id") % 5 == 1, F.lit("~\n<u>")).when(F.col("conv_id") % 7 == 4, F.lit("#!")).when(F.col("conv_id") % 3 == 0, F.lit("~")).otherwise(F.lit("")))
    rows = t.select(*KEYS, "turn_ordinal", F.lit("user").alias("role"), seen.alias("prompt"), done.alias("completion"), cut("t", place % 17 == 2, "u").alias("tools"), cut("low", place % 23 == 7, "high").alias("effort"))
    d = build(rows, Profile("plain", prefix="P", ending="~\n", generation="A:", headers=("<u>",), complete=("#!",)))
    return d.select(*KEYS, "turn_ordinal", "n_prompt_ids", F.sha2(F.array_join("added", ","), 256).alias("added_sha"), "error")


QUERIES = {"continuations": continuations}
#: SQL for DuckDB: the stream as one fold over its turns, in texts instead of ids.
ORACLE = {
    "continuations": f"""WITH RECURSIVE {adapter.DUCK_TURNS},
        r AS (SELECT session_id, agent_id, segment_index, turn_ordinal, row_number() OVER (PARTITION BY session_id, agent_id, segment_index ORDER BY turn_ordinal) AS place, CASE WHEN (conv_id + tn) % 19 = 4 THEN 'Q' ELSE 'P' END || CASE WHEN conv_id % 5 = 1 AND (conv_id + tn) % 4 <> 3 THEN '<u>' ELSE '' END || prompt AS render,
            completion || CASE WHEN conv_id % 5 = 1 THEN '~' || chr(10) || '<u>' WHEN conv_id % 7 = 4 THEN '#!' WHEN conv_id % 3 = 0 THEN '~' ELSE '' END AS done, CASE WHEN (conv_id + tn) % 17 = 2 THEN 'u' ELSE 't' END AS tools, (conv_id + tn) % 23 = 7 AS high FROM turns),
        f AS (SELECT r.*, render || 'A:' AS added, CAST(NULL AS VARCHAR) AS error, render || 'A:' || done AS stream, tools AS pinned, high AS effort FROM r WHERE place = 1
            UNION ALL SELECT q.session_id, q.agent_id, q.segment_index, q.turn_ordinal, q.place, q.render, q.done, q.tools, q.high, CASE WHEN q.error IS NULL THEN q.add END, q.error, CASE WHEN q.error IS NULL THEN q.before || q.add || q.done ELSE q.before END, q.pinned, q.effort
            FROM (SELECT r.*, f.stream AS before, f.pinned, f.effort, CASE WHEN r.tools <> f.pinned THEN 'tools changed' WHEN r.high <> f.effort THEN 'effort changed' WHEN r.render[1] <> 'P' THEN 'delta without the render''s prefix' WHEN suffix(f.stream, '<u>') AND NOT starts_with(substr(r.render, 2), '<u>') THEN 'sampled header of another role' END AS error,
                CASE WHEN suffix(f.stream, '#!') OR suffix(f.stream, '~' || chr(10)) THEN '' WHEN suffix(f.stream, '~') THEN chr(10) ELSE '~' || chr(10) END || substr(r.render, CASE WHEN suffix(f.stream, '<u>') THEN 5 ELSE 2 END) || 'A:' AS add
                FROM f JOIN r ON r.session_id = f.session_id AND r.agent_id IS NOT DISTINCT FROM f.agent_id AND r.segment_index = f.segment_index AND r.place = f.place + 1) q)
        SELECT f.session_id, f.agent_id, f.segment_index, f.turn_ordinal, CASE WHEN error IS NULL THEN CAST(length(stream) - length(done) AS BIGINT) END AS n_prompt_ids,
            CASE WHEN error IS NULL THEN sha256(array_to_string(list_transform(string_split(added, ''), lambda c: CAST(unicode(c) AS VARCHAR)), ',')) END AS added_sha, error FROM f"""
}
