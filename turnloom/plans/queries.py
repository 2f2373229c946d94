"""All queries of the log operators, and their SQL for DuckDB."""

from __future__ import annotations

from functools import wraps

from turnloom.functions import scalars
from turnloom.operators import lookups, ordered, requests, training, validation, windows
from turnloom.plans import histories, request_bodies, sessions, texts, tokenizers
from turnloom.plans.registry import for_duck, query
from turnloom.ship import ship
from turnloom.streaming import continuation, history

SQL = scalars.QUERIES | windows.QUERIES | validation.QUERIES | requests.QUERIES | lookups.QUERIES | history.QUERIES


def _shipped(run):
    """run, after the package is sent to the executors, whose Python may not see this folder."""

    @wraps(run)
    def call(spark, sf_dir):
        ship(spark)
        return run(spark, sf_dir)

    return call


QUERIES = {name: query(sql) for name, sql in SQL.items()} | ordered.QUERIES | training.QUERIES | histories.QUERIES | request_bodies.QUERIES | sessions.QUERIES | tokenizers.QUERIES | {name: _shipped(run) for name, run in (texts.QUERIES | continuation.QUERIES).items()}
#: Where there is another formulation for DuckDB, it takes the place of the shared one.
OWN = scalars.ORACLES | validation.ORACLES | lookups.ORACLES | windows.ORACLES | requests.ORACLES | history.ORACLES
ORACLE = {name: for_duck(OWN.get(name, sql)) for name, sql in SQL.items()} | ordered.ORACLE | training.ORACLE | histories.ORACLE | request_bodies.ORACLE | sessions.ORACLE | tokenizers.ORACLE | texts.ORACLE | continuation.ORACLE
