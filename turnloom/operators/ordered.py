"""Operators over one global order without one global task.

A window without a partition key would send all rows to one task. Here the order is cut into
BUCKETS ranges of the leading order column, at its quantiles, so the buckets are of like size
whatever the values; windows run inside buckets, and only one row a bucket (a total or a last value)
is carried across them. Rows of one value of the leading column share a bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnloom.sources import adapter

BUCKETS = 256


def bucket_of(value: Column, cuts: list[int]) -> Column:
    """How many of the sorted cuts are at most an integer, by bisection in one constant array; null counts as before all."""
    if not cuts:
        return F.lit(0).cast("bigint")
    array = F.expr(f"array({', '.join(f'{c}L' for c in cuts)})")

    def halved(a: Column, _: Column) -> Column:
        mid = F.floor((a["lo"] + a["hi"]) / 2).cast("int")
        up = F.get(array, mid) <= value
        return F.when(a["lo"] >= a["hi"], a).when(up, F.struct((mid + 1).alias("lo"), a["hi"].alias("hi"))).otherwise(F.struct(a["lo"].alias("lo"), mid.alias("hi")))

    steps = F.sequence(F.lit(1), F.lit(len(cuts).bit_length()))
    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi")), halved)["lo"].cast("bigint")


def bucketed(df: DataFrame, column: str, buckets: int = BUCKETS) -> DataFrame:
    """df with a column bucket that rises with an integer column; buckets - 1 quantiles come to the driver."""
    found = df.select(column).approxQuantile(column, [i / buckets for i in range(1, buckets)], 1 / (4 * buckets))
    return df.withColumn("bucket", bucket_of(F.col(column), sorted({int(x) for x in found})))


def _before(totals: DataFrame, value: Column) -> DataFrame:
    """totals (bucket, v) with the fold of v over the earlier buckets: BUCKETS rows at most."""
    return totals.select("bucket", value.over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))


def global_row_number(df: DataFrame, order: list[str], name: str = "place", buckets: int = BUCKETS) -> DataFrame:
    """df with its 1-based place by order; order[0] is an integer column, nulls come first."""
    d = bucketed(df, order[0], buckets)
    carried = _before(d.groupBy("bucket").agg(F.count("*").alias("v")), F.sum("v"))
    inside = F.row_number().over(Window.partitionBy("bucket").orderBy(*order))
    return d.withColumn("inside", inside).join(carried, "bucket").withColumn(name, F.col("inside") + F.coalesce("carried", F.lit(0))).drop("bucket", "inside", "carried")


def last_before(rows: DataFrame, at: str, value: str, name: str, buckets: int = BUCKETS) -> DataFrame:
    """rows with the last non-null value at or before each row's place in the order of at (unique integers)."""
    d = bucketed(rows, at, buckets)
    pushed = F.when(F.col(value).isNotNull(), F.struct(F.col(at), F.col(value)))
    carried = _before(d.groupBy("bucket").agg(F.max(pushed).alias("v")), F.max("v"))
    inside = F.max(pushed).over(Window.partitionBy("bucket").orderBy(at).rowsBetween(Window.unboundedPreceding, 0))
    return d.withColumn("inside", inside).join(carried, "bucket", "left").withColumn(name, F.coalesce("inside", "carried")[value]).drop("bucket", "inside", "carried")


def policy_in_force(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The policy of the last push before each turn; an empty push (k = 0) clears it."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    e = adapter.read(spark, sf_dir, "events").select("event_id", "event_type", F.when(F.col("event_type") == "signup", k).alias("k"))
    d = last_before(e, "event_id", "k", "pushed").where("event_type = 'purchase'")
    return d.select("event_id", F.when(F.col("pushed") != 0, F.col("pushed")).alias("top_k"))


def bound(events: DataFrame, endpoints: int, buckets: int = BUCKETS) -> DataFrame:
    """events (stream, ordinal, kind: use or release) that are uses, with their lifetime and endpoint.

    A stream keeps its endpoint from its first use until a release; then its next use is a first one again.
    First uses are dealt over the endpoints in turn, in the one order of ordinals (unique integers).
    """
    before = Window.partitionBy("stream").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    d = events.select("stream", "ordinal", "kind").withColumn("lifetime", F.count_if(F.col("kind") == "release").over(before)).where("kind = 'use'")
    first = d.groupBy("stream", "lifetime").agg(F.min("ordinal").alias("first"))
    dealt = global_row_number(first, ["first"], buckets=buckets).select("stream", "lifetime", ((F.col("place") - 1) % endpoints).cast("bigint").alias("endpoint"))
    return d.join(dealt, ["stream", "lifetime"]).select("stream", "ordinal", "lifetime", "endpoint")


def endpoint_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as streams over three endpoints; an error releases its user's."""
    e = adapter.read(spark, sf_dir, "events").select(F.col("user_id").alias("stream"), F.col("event_id").alias("ordinal"), F.when(F.col("event_type") == "error", "release").otherwise("use").alias("kind"))
    return bound(e, 3)


def sticky_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Endpoints are dealt in turn by a stream's first use."""
    s = adapter.turns(spark, sf_dir).groupBy("session_id", "agent_id").agg(F.min("conv_id").alias("first_conv"))
    d = global_row_number(s, ["first_conv", "session_id", "agent_id"])
    return d.select("session_id", "agent_id", ((F.col("place") - 1) % 3).cast("bigint").alias("endpoint"))


QUERIES = {"policy_in_force": policy_in_force, "sticky_endpoints": sticky_endpoints, "endpoint_bindings": endpoint_bindings}
#: A use belongs to the first use that no release of its stream stands between; those are counted one by one.
ORACLE = {
    "endpoint_bindings": """WITH u AS (SELECT user_id AS stream, event_id AS ordinal, (SELECT count(*) FROM events r WHERE r.user_id = e.user_id AND r.event_type = 'error' AND r.event_id < e.event_id) AS lifetime FROM events e WHERE event_type <> 'error'),
        f AS (SELECT stream, lifetime, min(ordinal) AS first FROM u GROUP BY stream, lifetime), n AS (SELECT *, rank() OVER (ORDER BY first) - 1 AS nth FROM f)
        SELECT u.stream, u.ordinal, u.lifetime, n.nth % 3 AS endpoint FROM u JOIN n ON n.stream = u.stream AND n.lifetime = u.lifetime""",
}
