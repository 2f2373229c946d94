"""Turn logs derived from the conversations table.

A turn is the text before an assistant's message and that message. Tokens are code points. Four
agents share a session, one of them without a name; segments, purposes, versions and policies
follow from ids, so that every operator meets each case.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Columns over (conv_id, tn), in SQL that Spark and DuckDB both read.
DERIVED = """
    concat('s', CAST(CAST((conv_id - conv_id % 4) / 4 AS BIGINT) AS VARCHAR(20))) AS session_id,
    CASE WHEN conv_id % 4 = 3 THEN NULL ELSE concat('a', CAST(conv_id % 4 AS VARCHAR(20))) END AS agent_id,
    CAST((tn - tn % 3) / 3 AS BIGINT) AS segment_index,
    tn % 3 = 0 AS new_conversation,
    CASE WHEN tn % 3 = 1 AND conv_id % 7 = 3 THEN 'compaction' WHEN tn % 3 = 2 AND conv_id % 5 = 2 THEN 'auxiliary' ELSE 'primary' END AS purpose,
    CASE WHEN conv_id % 10 = 9 THEN '8' ELSE '7' END AS weight_version,
    CASE WHEN conv_id % 11 = 5 THEN 0.9D0 ELSE 1.0D0 END AS top_p
"""
SPARK_DERIVED = DERIVED.replace("D0", "D").replace("VARCHAR(20)", "STRING")
DUCK_DERIVED = DERIVED.replace("0.9D0", "CAST(0.9 AS DOUBLE)").replace("1.0D0", "CAST(1 AS DOUBLE)").replace("VARCHAR(20)", "VARCHAR")

#: The same table for DuckDB.
DUCK_TURNS = f"""
numbered AS (SELECT conv_id, turn, role, text, CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS tn FROM conversations),
grouped AS (SELECT conv_id, tn, coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role <> 'assistant'), '') AS prompt, coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '') AS completion,
    CAST(count(*) FILTER (WHERE role <> 'assistant') AS BIGINT) AS n_messages FROM numbered GROUP BY conv_id, tn),
turns AS (SELECT *, CAST(row_number() OVER (PARTITION BY session_id ORDER BY tn, conv_id) AS BIGINT) AS turn_ordinal FROM (SELECT conv_id, tn, prompt, completion, n_messages, CAST(length(prompt) AS BIGINT) AS n_prompt, CAST(length(completion) AS BIGINT) AS n_completion, {DUCK_DERIVED} FROM grouped))
"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a turn, keyed by (session_id, agent_id, segment_index, turn_ordinal)."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    said = F.col("role") == "assistant"
    c = read(spark, sf_dir, "conversations").withColumn("tn", F.coalesce(F.sum(said.cast("bigint")).over(before), F.lit(0).cast("bigint")))
    joined = lambda who: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(who, F.struct("turn", "text")))), lambda m: m.text), "")
    g = c.groupBy("conv_id", "tn").agg(joined(~said).alias("prompt"), joined(said).alias("completion"), F.count_if(~said).alias("n_messages"))
    g = g.withColumns({"n_prompt": F.length("prompt").cast("bigint"), "n_completion": F.length("completion").cast("bigint")})
    g = g.selectExpr("conv_id", "tn", "prompt", "completion", "n_messages", "n_prompt", "n_completion", *_split(SPARK_DERIVED))
    order = Window.partitionBy("session_id").orderBy("tn", "conv_id")
    return g.withColumn("turn_ordinal", F.row_number().over(order).cast("bigint"))


def _split(columns: str) -> list[str]:
    """Top-level comma-separated expressions."""
    out, depth, start = [], 0, 0
    for i, ch in enumerate(columns):
        depth += (ch == "(") - (ch == ")")
        if ch == "," and not depth:
            out.append(columns[start:i])
            start = i + 1
    return [x.strip() for x in [*out, columns[start:]]]
