"""Sessions from admission to release, as a sweep over the intervals of their work.

Accepted work is an interval; its ends are +1 and -1 at their times, and the running sum says how much is
under way. A session is sealed by its first finalization; it is drained at the first moment from then on at
which nothing runs. Deletion ends work that still runs, and releases streams, which can fail and be tried again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def admitted(work: DataFrame, control: DataFrame) -> DataFrame:
    """work with sealed_at, deleted_at, status (200, 409 behind a seal, 410 behind a deletion) and ended_at.

    work: session, accepted_at, done_at (null while it runs), lost (whether its record is missing). control:
    session, moment, kind (finalize or delete), released. A finalization ahead of any work finds no session, and
    behind a deletion nothing to seal. Work that comes at the moment of a seal is admitted, at that of a deletion refused.
    """
    first = work.groupBy("session").agg(F.min("accepted_at").alias("__first"))
    deleted = control.where("kind = 'delete'").groupBy("session").agg(F.min("moment").alias("deleted_at"))
    seals = control.where("kind = 'finalize'").join(first, "session").join(deleted, "session", "left")
    seals = seals.where("moment >= __first AND (deleted_at IS NULL OR moment < deleted_at)").groupBy("session").agg(F.min("moment").alias("sealed_at"))
    d = work.join(seals, "session", "left").join(deleted, "session", "left")
    status = F.when(F.col("accepted_at") >= F.col("deleted_at"), 410).when(F.col("accepted_at") > F.col("sealed_at"), 409).otherwise(200)
    return d.withColumn("status", status).withColumn("ended_at", F.when(status == 200, F.least("done_at", "deleted_at")))


def lifecycles(work: DataFrame, control: DataFrame) -> DataFrame:
    """Per session: n_admitted, n_refused, most_running, sealed_at, drained_at (null if never), state.

    States: open, draining, failed (drained with a record missing), finalized, deleted, release_failed (deleted,
    and no attempt has released all streams yet: another deletion can).
    """
    d = admitted(work, control)
    ok = d.where("status = 200")
    points = ok.select("session", "sealed_at", F.explode(F.array(F.struct(F.col("accepted_at").alias("at"), F.lit(1).alias("step")), F.struct(F.col("ended_at").alias("at"), F.lit(-1).alias("step")))).alias("p"))
    seals = ok.where("sealed_at IS NOT NULL").groupBy("session").agg(F.max("sealed_at").alias("sealed_at")).select("session", "sealed_at", F.col("sealed_at").alias("at"), F.lit(0).alias("step"))
    points = points.where("p.at IS NOT NULL").select("session", "sealed_at", "p.at", "p.step").union(seals)
    moments = points.groupBy("session", "at").agg(F.max("sealed_at").alias("sealed_at"), F.sum("step").alias("step"), F.sum(F.when(F.col("step") > 0, 1).otherwise(0)).alias("begun"))
    upto = Window.partitionBy("session").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    running = moments.withColumn("running", F.sum("step").over(upto))
    # at a moment, work that begins meets what ends
    peak = F.max(F.col("running") - F.col("step") + F.col("begun"))
    swept = running.groupBy("session").agg(peak.alias("most_running"), F.min(F.when((F.col("at") >= F.col("sealed_at")) & (F.col("running") == 0), F.col("at"))).alias("drained_at"))
    counts = d.groupBy("session").agg(F.count_if(F.col("status") == 200).alias("n_admitted"), F.count_if(F.col("status") != 200).alias("n_refused"), F.max("sealed_at").alias("sealed_at"), F.max("deleted_at").alias("deleted_at"), F.bool_or((F.col("status") == 200) & F.col("lost")).alias("lost"))
    released = control.where("kind = 'delete'").groupBy("session").agg(F.bool_or("released").alias("released"))
    out = counts.join(swept, "session", "left").join(released, "session", "left")
    state = (
        F.when(F.col("deleted_at").isNotNull() & F.col("released"), "deleted").when(F.col("deleted_at").isNotNull(), "release_failed").when(F.col("sealed_at").isNull(), "open")
        .when(F.col("drained_at").isNull(), "draining").when(F.col("lost"), "failed").otherwise("finalized")
    )
    return out.select("session", "n_admitted", "n_refused", F.coalesce("most_running", F.lit(0)).cast("bigint").alias("most_running"), "sealed_at", "drained_at", state.alias("state"))
