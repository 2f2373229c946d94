"""Control of running streams: pins, switches, and the order in which refusals win."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnloom.operators.messages import exact
from turnloom.operators.request_rules import SAMPLING, fields_of, given, in_range, kind


def precedence(refusals: list[tuple[Column, int]], otherwise: int = 200) -> Column:
    """The status of the first refusal that holds; a condition that is null does not."""
    return F.coalesce(*[F.when(F.coalesce(c, F.lit(False)), status) for c, status in refusals], F.lit(otherwise))


def model_pins(requests: DataFrame) -> DataFrame:
    """requests (stream, ordinal, asked) with the model that each stream is pinned to and whether it fits: the first
    model that a stream names pins it, naming none is fine, and a name counts from its own request on."""
    upto = Window.partitionBy("stream").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    pinned = F.first(F.nullif(F.trim("asked"), F.lit("")), ignorenulls=True).over(upto)
    return requests.withColumn("pinned", pinned).withColumn("ok", F.coalesce(F.nullif(F.trim("asked"), F.lit("")) == F.col("pinned"), F.lit(True)))


def first_pins(held: DataFrame, seen: DataFrame) -> DataFrame:
    """name, pin, conflict: pins are kept as they were held; new names take the pin seen first (name, ordinal, pin).

    A name conflicts if any other pin was seen than the one that counts. A null pin pins nothing.
    """
    new = seen.where("pin IS NOT NULL").groupBy("name").agg(F.min_by("pin", "ordinal").alias("first"), F.min("pin").alias("lo"), F.max("pin").alias("hi"))
    d = held.where("pin IS NOT NULL").groupBy("name").agg(F.min("pin").alias("kept")).join(new, "name", "full_outer").withColumn("pin", F.coalesce("kept", "first"))
    return d.select("name", "pin", F.coalesce((F.col("lo") != F.col("pin")) | (F.col("hi") != F.col("pin")), F.lit(False)).alias("conflict"))


def switches(events: DataFrame, configured: Column) -> DataFrame:
    """events (stream, ordinal, kind: set or read, value) that read, with the value in force: the last one that was set,
    where null restores what is configured."""
    upto = Window.partitionBy("stream").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    last = F.max(F.when(F.col("kind") == "set", F.struct("ordinal", F.col("value").isNull().alias("none"), F.coalesce("value", F.lit(False)).alias("value")))).over(upto)
    d = events.withColumn("__last", last).where("kind = 'read'")
    return d.withColumn("effective", F.when(F.col("__last").isNull() | F.col("__last.none"), configured).otherwise(F.col("__last.value"))).drop("__last")


def bound_to(instance: str, header: Column, key: Column) -> Column:
    """412 for requests that name another instance in a header or in their key, else null; naming none is fine."""
    other = lambda c: F.coalesce(c != instance, F.lit(False))
    return F.when(other(header) | other(key), 412)


def control_request(name: Column, raw: Column) -> Column:
    """Why the body of a control request is refused, or ok. name: sampling (an object of sampling parameters in
    their ranges; an empty one clears) or captures (an object with enabled: true, false, or null, which restores)."""
    v = exact(raw)

    def sampling(m: Column) -> Column:
        faults = [F.when(given(m[k]) & ~in_range(k)(m[k]) | (kind(m[k]) == "VOID"), k) for k in SAMPLING]
        unknown = F.exists(F.map_keys(m), lambda k: ~k.isin(*SAMPLING))
        return F.coalesce(F.when(unknown, "unknown"), *faults, F.lit("ok"))

    body = F.transform(F.array(fields_of(v)), lambda m: F.when(m.isNull(), "object").otherwise(sampling(m)))[0]
    switch = F.transform(F.array(fields_of(v)), lambda m: F.when(m.isNull() | ~F.array_contains(F.map_keys(m), "enabled"), "object").when(kind(m["enabled"]).isin("BOOLEAN", "VOID"), "ok").otherwise("boolean"))[0]
    return F.when(name == "sampling", body).when(name == "captures", F.coalesce(switch, F.lit("object"))).otherwise("control")
