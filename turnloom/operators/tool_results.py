"""Results of tools, named by the calls that they answer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def named(results: DataFrame, calls: DataFrame) -> DataFrame:
    """results (answer, place, call_id, name) with the name of the call and an error.

    calls: answer (the message that has them), call_id, name. A result goes to the call of its id, or
    without an id to the answer's only call. Errors: unmatched (no such call, several, or one without a name) and name (the
    result says another one). Of calls with one id the last name by order of names counts once.
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    by_id = calls.where(~blank("call_id")).groupBy(F.col("answer").alias("i_answer"), F.col("call_id").alias("i_id")).agg(F.max("name").alias("i_name"))
    sole = calls.groupBy(F.col("answer").alias("s_answer")).agg(F.count("*").alias("n"), F.max("name").alias("s_name")).where("n = 1").drop("n")
    d = results.join(by_id, (results["answer"] == by_id["i_answer"]) & (results["call_id"] == by_id["i_id"]), "left").join(sole, results["answer"] == sole["s_answer"], "left")
    found = F.when(blank("call_id"), F.col("s_name")).otherwise(F.col("i_name"))
    d = d.withColumn("found", F.nullif(found, F.lit("")))
    error = F.when(F.col("found").isNull(), "unmatched").when(~blank("name") & (F.col("name") != F.col("found")), "name")
    return d.select("answer", "place", "call_id", F.when(error.isNull(), F.col("found")).alias("name"), error.alias("error"))
