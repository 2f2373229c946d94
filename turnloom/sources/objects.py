"""JSON objects built key by key, so that a null can be left out of one key and kept in another."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def value(c: Column) -> Column:
    """Any value as compact JSON; null as null."""
    whole = F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"})
    return F.substring(whole, 6, F.length(whole) - 6)


def members(fields: dict[str, Column], optional: tuple[str, ...] = (), raw: tuple[str, ...] = ()) -> Column:
    """The members of an object in order, without braces; optional ones go where they are null, raw ones are JSON already."""
    one = lambda k, c: F.concat(F.lit(f'"{k}":'), F.coalesce(c, F.lit("null")) if k in raw else value(c))
    return F.array_join(F.array_compact(F.array(*[F.when(c.isNotNull() | F.lit(k not in optional), one(k, c)) for k, c in fields.items()])), ",")


def json_object(fields: dict[str, Column], optional: tuple[str, ...] = (), raw: tuple[str, ...] = ()) -> Column:
    return F.concat(F.lit("{"), members(fields, optional, raw), F.lit("}"))


def json_list(items: Column) -> Column:
    """A list of JSON texts as one text."""
    return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))
