"""Requests that an engine has rejected for good are answered from a slot instead of being sent again.

A stream has one slot: a request's key (its messages, effort, segment and purpose) and how often the engine
rejected it. After LIMIT rejections an equal request is served the stored status; another request is sent, and
takes the slot if it is rejected for good. A success clears the slot; server errors and
statuses that pass leave it.
"""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Iterator

from pyspark.sql import DataFrame

from turnloom.streaming.ordered_fold import in_order

LIMIT = 2
#: Statuses of requests that can succeed when they are sent again.
TRANSIENT = (408, 425, 429)
Request = namedtuple("Request", "stream ordinal key status")
OUT = "stream string, ordinal bigint, sent boolean, answered int, attempts int"


def answers(requests: DataFrame, limit: int = LIMIT) -> DataFrame:
    """requests (stream, ordinal, key, status: what the engine says to it) with whether each is sent, its
    answer, and the slot's rejections afterwards. A stream is read in order, and holds its slot alone."""

    def fold(rows: Iterator[Request]) -> Iterator[tuple]:
        held: tuple | None = None  # key, rejections, status
        for r in rows:
            sent = not (held and held[0] == r.key and held[1] >= limit)
            if sent and 200 <= r.status < 300:
                held = None
            elif sent and 400 <= r.status < 500 and r.status not in TRANSIENT:
                held = (r.key, held[1] + 1 if held and held[0] == r.key else 1, r.status)
            yield r.stream, r.ordinal, sent, r.status if sent else held[2], held[1] if held else 0

    return in_order(requests.select(*Request._fields), ["stream"], ["ordinal"], Request, fold, OUT)
