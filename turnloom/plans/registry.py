"""Queries in SQL that Spark and DuckDB both read, with the few words that differ replaced.

A query is a SELECT over the names turns, events, documents, labels and so on. For Spark each
name is bound to a DataFrame, for DuckDB turns is a common table expression.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from turnloom.sources import adapter

TABLES = "events documents labels conversations customer orders".split()
#: Spark's and DuckDB's words for one thing.
WORDS = {
    "@match(": ("regexp_like(", "regexp_matches("),
    "@json(": ("get_json_object(", "json_extract_string("),
    "@sha(": ("turnloom_sha(", "sha256("),
    "@size(": ("size(", "len("),
    "@strip(": ("btrim(", "trim("),
    "@text": ("STRING", "VARCHAR"),
}


def for_duck(sql: str) -> str:
    for word, (_, duck) in WORDS.items():
        sql = sql.replace(word, duck)
    if not re.search(r"\bturns\b", sql):
        return sql
    own = re.match(r"\s*WITH\s+", sql)
    return f"WITH {adapter.DUCK_TURNS}" + (", " + sql[own.end() :] if own else sql)


def for_spark(sql: str) -> str:
    for word, (spark, _) in WORDS.items():
        sql = sql.replace(word, spark)
    while (at := sql.find("turnloom_sha(")) >= 0:
        depth, end = 1, at + len("turnloom_sha(")
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = f"{sql[:at]}sha2({sql[at + len('turnloom_sha('):end - 1]}, 256){sql[end:]}"
    return sql


def query(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    text = for_spark(sql)
    names = [n for n in ["turns", *TABLES] if re.search(rf"\b(?:FROM|JOIN)\s+{n}\b", text)]
    text = text.replace("{", "{{").replace("}", "}}")  # braces of the text itself
    bound = re.sub(rf"\b(FROM|JOIN)\s+({'|'.join(names)})\b", r"\1 {\2}", text) if names else text

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        given = {n: adapter.turns(spark, sf_dir) if n == "turns" else adapter.read(spark, sf_dir, n) for n in names}
        return spark.sql(bound, **given)

    run.__doc__ = f"SELECT of {', '.join(names)}"

    return run
