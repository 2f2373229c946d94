"""Results of trials against their allocations, roles and policies, as joins.

A result gets the first rule that it fails, in the order of the rules and, within them, of its streams and their
completions: allocation (its session id is allocated twice), session (no id), attempt_number, slot (not
allocated, or an earlier result has it), attempt (another session id is allocated there), scores (not finite),
then of each stream stream (not valid in itself), identity (another session's, or one key twice), role (unregistered or
relabelled), weight_version and sampling of nonempty completions of selected roles, and last segments
(indices that are not 0, 1, 2 and so on). Slots without a result are missing.
"""

from __future__ import annotations

from collections.abc import Collection, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

STREAM_RULES = ("stream", "identity", "role", "weight_version", "sampling")


def _policy_faults(completions: DataFrame, sampling: Mapping[str, float] | None, version: str | None) -> DataFrame:
    """(result, agent_id, segment_index, rule) of the first nonempty completion that breaks a policy."""
    stale = ~F.coalesce(F.col("weight_version") == version, F.lit(False)) if version is not None else F.lit(False)
    other = F.lit(False)
    for name, wanted in (sampling or {}).items():
        other = other | ~F.coalesce(F.col("sampling_params")[name] == float(wanted), F.lit(False))
    rule = F.when(stale, "weight_version").when(other, "sampling")
    d = completions.where(F.col("start") < F.col("end")).withColumn("rule", rule).where("rule IS NOT NULL")
    return d.groupBy("result", "agent_id", "segment_index").agg(F.min(F.struct("start", "rule"))["rule"].alias("policy"))


def stream_faults(results: DataFrame, streams: DataFrame, completions: DataFrame, roles: DataFrame, selected: Collection[str] | None, sampling: Mapping[str, float] | None, version: str | None) -> DataFrame:
    """(result, rule) of the first stream of each result that fails one; a null agent is a key of its own."""
    key = Window.partitionBy("result", "agent_id", "segment_index").orderBy("place")
    s = streams.withColumn("nth", F.row_number().over(key)).join(results.select("result", F.col("session_id").alias("own")), "result")
    named = roles.select(F.col("agent_id").alias("r_agent"), F.col("role").alias("registered"))
    s = s.join(named, s["agent_id"].eqNullSafe(named["r_agent"]), "left")
    p = _policy_faults(completions, sampling, version).withColumnsRenamed({"result": "p_result", "agent_id": "p_agent", "segment_index": "p_segment"})
    s = s.join(p, (s["result"] == p["p_result"]) & s["agent_id"].eqNullSafe(p["p_agent"]) & (s["segment_index"] == p["p_segment"]), "left")
    chosen = F.lit(True) if selected is None else F.col("role").isin(*selected) if selected else F.lit(False)
    rule = (
        F.when(~F.coalesce("valid", F.lit(False)), "stream").when(~F.col("session_id").eqNullSafe(F.col("own")) | (F.col("nth") > 1), "identity")
        .when(F.col("registered").isNull() | ~F.coalesce(F.col("role") == F.col("registered"), F.lit(False)), "role").when(chosen, F.col("policy"))
    )
    return s.withColumn("rule", rule).where("rule IS NOT NULL").groupBy("result").agg(F.min(F.struct("place", "rule"))["rule"].alias("rule"))


def validate(results: DataFrame, allocations: DataFrame, streams: DataFrame, completions: DataFrame, roles: DataFrame, selected: Collection[str] | None = None, sampling: Mapping[str, float] | None = None, version: str | None = None) -> DataFrame:
    """task_id, slot, result and verdict (a rule, ok or missing) of every result and of every slot without one.

    results: result (in order), task_id, slot, attempt, session_id, scores (map to doubles). allocations: task_id,
    slot, attempt, session_id. streams: result, place, session_id, agent_id, segment_index, role, valid.
    completions: result, agent_id, segment_index, start, end, weight_version, sampling_params (map to doubles).
    roles: agent_id, role. selected: roles whose policy counts, all unless given.
    """
    twice = allocations.groupBy("session_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("session_id").alias("t_session"), F.lit(True).alias("twice"))
    slots = allocations.select(F.col("task_id").alias("a_task"), F.col("slot").alias("a_slot")).distinct().withColumn("known", F.lit(True))
    given = allocations.select(F.col("task_id").alias("g_task"), F.col("slot").alias("g_slot"), F.col("attempt").alias("g_attempt"), F.col("session_id").alias("allocated"))
    r = results.withColumn("nth", F.row_number().over(Window.partitionBy("task_id", "slot").orderBy("result")))
    r = r.join(slots, (r["task_id"] == slots["a_task"]) & (r["slot"] == slots["a_slot"]), "left")
    r = r.join(given, (r["task_id"] == given["g_task"]) & (r["slot"] == given["g_slot"]) & (r["attempt"] == given["g_attempt"]), "left").join(twice, r["session_id"] == twice["t_session"], "left")
    found = stream_faults(results, streams, completions, roles, selected, sampling, version).withColumnsRenamed({"result": "f_result", "rule": "stream_rule"})
    gaps = streams.groupBy("result", "agent_id").agg(F.min("segment_index").alias("lo"), F.max("segment_index").alias("hi"), F.count("*").alias("n"), F.count_distinct("segment_index").alias("u"))
    gaps = gaps.where("lo <> 0 OR hi <> n - 1 OR u <> n").select(F.col("result").alias("s_result"), F.lit(True).alias("gap")).distinct()
    r = r.join(found, r["result"] == found["f_result"], "left").join(gaps, r["result"] == gaps["s_result"], "left")
    whole = F.coalesce(F.forall(F.map_values("scores"), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
    verdict = (
        F.when(F.col("twice"), "allocation").when(F.coalesce(F.col("session_id"), F.lit("")) == "", "session").when(~F.coalesce(F.col("attempt") >= 0, F.lit(False)), "attempt_number")
        .when(F.col("known").isNull() | (F.col("nth") > 1), "slot").when(~F.coalesce(F.col("allocated") == F.col("session_id"), F.lit(False)), "attempt").when(~whole, "scores")
        .when(F.col("stream_rule").isNotNull(), F.col("stream_rule")).when(F.col("gap"), "segments").otherwise("ok")
    )
    seen = results.select(F.col("task_id").alias("a_task"), F.col("slot").alias("a_slot"))
    missing = slots.join(seen, ["a_task", "a_slot"], "left_anti").select(F.col("a_task").alias("task_id"), F.col("a_slot").alias("slot"), F.lit(None).cast(dict(results.dtypes)["result"]).alias("result"), F.lit("missing").alias("verdict"))
    return r.select("task_id", "slot", "result", verdict.alias("verdict")).unionByName(missing)
