"""Stateful streams: recorder of sessions with repairs and tombstones, and a bounded set of live streams.

The transition functions are plain Python over one session's events in order, on a small store of what is
held. The batch form holds it in dictionaries while sorted partitions are read row by row; the streaming
form holds it in Spark's state (transformWithState). So both give the same rows.
"""

from __future__ import annotations

from collections import OrderedDict, namedtuple
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from turnloom.ship import ship
from turnloom.streaming.ordered_fold import in_order

#: kind: turn, failed (a turn that was committed but not recorded), delete or collect. n_messages counts the
#: segment's messages of others than the assistant so far; prompts are whole. ts is in milliseconds.
EVENT = """session_id string, ordinal bigint, ts bigint, kind string, agent_id string, segment_index bigint, purpose string, n_messages bigint, messages_sha string,
    n_full_prompt bigint, prompt_sha string, n_completion bigint, completion_sha string"""
Event = namedtuple("Event", [c.split()[0] for c in EVENT.split(",")])
OUT = "session_id string, agent_id string, ordinal bigint, kind string, accepted boolean, reason string, stream_len bigint, n_turns bigint, repaired boolean, late boolean, recorded string"
PURPOSES = ("primary", "compaction", "auxiliary")
TTL_MS = 3_600_000

AGENT = "segment bigint, messages bigint, length bigint, completion bigint, completion_sha string, purpose string, turns bigint"
Agent = namedtuple("Agent", [c.split()[0] for c in AGENT.split(", ")])
FRESH = Agent(-1, 0, 0, 0, None, None, 0)
#: What an exact retry must bring again, and how many turns its agent had when the turn was lost.
FAILURE = "segment bigint, purpose string, messages_sha string, prompt_sha string, completion_sha string, turns bigint"
Failure = namedtuple("Failure", [c.split()[0] for c in FAILURE.split(", ")])


class Held:
    """What is known of one session, in memory."""

    def __init__(self) -> None:
        self.deleted_at: int | None = None
        self.clear()

    def clear(self) -> None:
        self.known = False
        self.agents: dict[str | None, Agent] = {}
        self.failures: dict[str | None, Failure] = {}
        self.turns: list[int] = []

    def meet(self) -> None:
        self.known = True

    def agent(self, name: str | None) -> Agent:
        return self.agents.get(name, FRESH)

    def record(self, name: str | None, agent: Agent, ordinal: int) -> None:
        self.agents[name] = agent
        self.turns.append(ordinal)

    def failure(self, name: str | None) -> Failure | None:
        return self.failures.get(name)

    def fail(self, name: str | None, failure: Failure) -> None:
        self.failures[name] = failure

    def repair(self, name: str | None) -> None:
        del self.failures[name]

    def failed(self) -> bool:
        return bool(self.failures)

    def recorded(self) -> list[int]:
        return self.turns

    def bury(self, ts: int) -> None:
        self.clear()
        self.deleted_at = ts


class Stated:
    """The same in Spark's state: maps by agent, a list of recorded turns, a tombstone that the store drops by itself."""

    def __init__(self, handle: StatefulProcessorHandle, keep_ms: int) -> None:
        self._known = handle.getValueState("known", "known boolean")
        self._agents = handle.getMapState("agents", "name string", AGENT)
        self._failures = handle.getMapState("failures", "name string", FAILURE)
        self._turns = handle.getListState("turns", "ordinal bigint")
        self._deleted = handle.getValueState("deleted", "ts bigint", keep_ms)

    @staticmethod
    def _key(name: str | None) -> tuple[str]:
        return ("-" if name is None else f"+{name}",)

    @property
    def deleted_at(self) -> int | None:
        return self._deleted.get()[0] if self._deleted.exists() else None

    @property
    def known(self) -> bool:
        return self._known.exists()

    def meet(self) -> None:
        if not self.known:
            self._known.update((True,))

    def agent(self, name: str | None) -> Agent:
        got = self._agents.getValue(self._key(name))
        return Agent(*got) if got else FRESH

    def record(self, name: str | None, agent: Agent, ordinal: int) -> None:
        self._agents.updateValue(self._key(name), tuple(agent))
        self._turns.appendValue((ordinal,))

    def failure(self, name: str | None) -> Failure | None:
        got = self._failures.getValue(self._key(name)) if self._failures.exists() else None
        return Failure(*got) if got else None

    def fail(self, name: str | None, failure: Failure) -> None:
        self._failures.updateValue(self._key(name), tuple(failure))

    def repair(self, name: str | None) -> None:
        self._failures.removeKey(self._key(name))

    def failed(self) -> bool:
        return self._failures.exists() and next(iter(self._failures.keys()), None) is not None

    def recorded(self) -> list[int]:
        return [x[0] for x in self._turns.get()] if self._turns.exists() else []

    def bury(self, ts: int) -> None:
        for state in (self._known, self._agents, self._failures, self._turns):
            state.clear()
        self._deleted.update((ts,))


def refusal(agent: Agent, e: Event) -> str | None:
    """Why a turn is not recorded. A segment is the agent's last one or the next; the next one opens a conversation.

    Within a segment a turn brings more messages and at least the stream as its prompt. One with the last
    turn's messages, completion and purpose, whose prompt is the stream before that completion, is a repeat.
    """
    if e.purpose not in PURPOSES:
        return "purpose"
    if e.segment_index is None or e.segment_index < 0 or e.segment_index - agent.segment not in (0, 1):
        return "segment"
    if e.segment_index > agent.segment:
        return None
    if (e.n_messages, e.completion_sha, e.purpose, e.n_full_prompt) == (agent.messages, agent.completion_sha, agent.purpose, agent.length - agent.completion):
        return "repeat"
    return "short" if e.n_messages <= agent.messages or e.n_full_prompt < agent.length else None


def transition(held: Held | Stated, e: Event, ttl_ms: int = TTL_MS) -> tuple:
    """Applies one event to what is held and gives its output row."""

    def row(accepted: bool, reason: str | None, agent: Agent = FRESH, repaired: bool = False, recorded: str | None = None) -> tuple:
        return e.session_id, e.agent_id, e.ordinal, e.kind, accepted, reason, agent.length, agent.turns, repaired, e.kind == "turn" and reason == "deleted", recorded

    if e.kind == "delete":
        held.bury(e.ts)
        return row(True, None)
    at = held.deleted_at
    buried = at is not None and e.ts - at < ttl_ms
    if e.kind == "collect":
        why = "unknown" if buried or not held.known else "failed" if held.failed() else None
        return row(why is None, why, recorded=None if why else ",".join(map(str, held.recorded())))
    if buried:
        return row(False, "deleted")
    agent = held.agent(e.agent_id)
    lost = Failure(e.segment_index, e.purpose, e.messages_sha, e.prompt_sha, e.completion_sha, agent.turns)
    before = held.failure(e.agent_id)
    if e.kind == "failed":  # the first one stays until it is repaired
        if before is None:
            held.fail(e.agent_id, lost)
        return row(before is None, None if before is None else "held", agent)
    held.meet()
    why = refusal(agent, e)
    repaired = before == lost and why in (None, "repeat")
    if why is None:
        agent = Agent(e.segment_index, e.n_messages, e.n_full_prompt + e.n_completion, e.n_completion, e.completion_sha, e.purpose, agent.turns + 1)
        held.record(e.agent_id, agent, e.ordinal)
    if repaired:
        held.repair(e.agent_id)
    return row(why is None, why, agent, repaired)


def record(events: DataFrame, ttl_ms: int = TTL_MS) -> DataFrame:
    """Batch form over columns EVENT. A session is read event by event in order of its ordinals, whatever its length."""

    def fold(rows: Iterator[Event]) -> Iterator[tuple]:
        held = Held()
        for e in rows:
            yield transition(held, e, ttl_ms)

    return in_order(events.select(*Event._fields), ["session_id"], ["ordinal"], Event, fold, OUT)


class Recorder(StatefulProcessor):
    """The transitions on Spark's state; a micro-batch's events of one session are put in order first."""

    def __init__(self, ttl_ms: int, keep_ms: int) -> None:
        self.ttl_ms, self.keep_ms = ttl_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = Stated(handle, self.keep_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        names = [c.split()[0] for c in OUT.split(", ")]
        for e in sorted((Event(*(r[c] for c in Event._fields)) for r in rows), key=lambda e: e.ordinal):
            yield Row(**dict(zip(names, transition(self.held, e, self.ttl_ms))))

    def close(self) -> None:
        pass


def record_stream(events: DataFrame, ttl_ms: int = TTL_MS, keep_ms: int | None = None) -> DataFrame:
    """Streaming form over a streaming DataFrame of columns EVENT.

    Whether a turn comes too late is told by the events' own times. The store forgets a tombstone keep_ms
    after its deletion was read (twice ttl_ms unless given), so that deleted sessions leave nothing behind.
    Its clock makes Spark run empty batches; with the trigger availableNow, which would not end then, set
    spark.sql.streaming.noDataMicroBatches.enabled to false.
    """
    spark = events.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    processor = Recorder(ttl_ms, keep_ms or 2 * ttl_ms)
    return events.select(*Event._fields).groupBy("session_id").transformWithState(processor, OUT, "append", "processingTime")


def write_split(outcomes: DataFrame, path: str, checkpoint: str, late: Column | None = None):
    """A query that writes a stream's rows to path/main and its late ones to path/late.

    A micro-batch has a folder of its own in each, which a repeated one writes over: no row comes twice.
    """
    side = F.col("late") if late is None else late

    def put(batch: DataFrame, n: int) -> None:
        batch = batch.persist()
        for name, rows in (("main", batch.where(~side)), ("late", batch.where(side))):
            rows.write.mode("overwrite").parquet(f"{path}/{name}/batch={n}")
        batch.unpersist()

    return outcomes.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)


class LiveStreams:
    """At most limit streams held. The stream used longest ago goes when a new one comes; one that
    went is refused until it is deleted."""

    def __init__(self, limit: int = 4096) -> None:
        self.limit = limit
        self.held: OrderedDict[str, None] = OrderedDict()
        self.gone: set[str] = set()

    def use(self, stream: str, action: str) -> bool:
        """Whether this use (or delete) is admitted."""
        if action == "delete":
            self.held.pop(stream, None)
            self.gone.discard(stream)
            return True
        if stream in self.gone:
            return False
        self.held[stream] = None
        self.held.move_to_end(stream)
        if len(self.held) > self.limit:
            self.gone.add(self.held.popitem(last=False)[0])
        return True


Use = namedtuple("Use", "profile stream ordinal action")


def live_streams(uses: DataFrame, limit: int = 4096) -> DataFrame:
    """uses (profile, stream, ordinal, action) with whether each is admitted, in order of ordinals within a profile."""

    def fold(rows: Iterator[Use]) -> Iterator[tuple]:
        live = LiveStreams(limit)
        for r in rows:
            yield (*r, live.use(r.stream, r.action))

    return in_order(uses.select(*Use._fields), ["profile"], ["ordinal"], Use, fold, "profile string, stream string, ordinal bigint, action string, admitted boolean")
