"""Engine responses of three dialects as token ids, log-probabilities, finish reason and version.

Bodies are JSON texts. They are read as variants, so types are exact: true is no number, 1.0 no token
id. error names the first rule that a response breaks: json, abort, finish, token_ids, logprobs, aligned,
version, usage, empty; the other fields are null then.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

RESPONSE = "struct<token_ids:array<bigint>,logprobs:array<double>,finish:string,version:string,error:string>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is evaluated once however often body reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _at(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, path, kind)


def _kind(v: Column) -> Column:
    """BIGINT, STRING and so on; empty for what is missing."""
    return F.coalesce(F.schema_of_variant(v), F.lit(""))


def _is_list(v: Column) -> Column:
    return _kind(v).startswith("ARRAY")


def _items(v: Column, path: str) -> Column:
    """The items of a list; null for anything else."""
    return F.when(_is_list(_at(v, path)), _at(v, path, "array<variant>"))


def _id(v: Column) -> Column:
    """A nonnegative integer; null for anything else."""
    n = F.when(_kind(v) == "BIGINT", F.try_variant_get(v, "$", "bigint"))
    return F.when(n >= 0, n)


def _number(v: Column) -> Column:
    """A finite number; null for anything else."""
    x = F.when((_kind(v) == "BIGINT") | (_kind(v) == "DOUBLE") | _kind(v).startswith("DECIMAL"), F.try_variant_get(v, "$", "double"))
    return F.when(F.abs(x) < float("inf"), x)


def _each(items: Column, get) -> Column:
    return F.transform(items, get)


def _whole(values: Column) -> Column:
    """Whether a list is there and has no null."""
    return F.coalesce(F.forall(values, lambda x: x.isNotNull()), F.lit(False))


def _answer(v: Column, r: Column, finish: Column, version: Column, rules: list[tuple[str, Column]]) -> Column:
    broken = F.when(v.isNull(), "json")
    for name, bad in [*rules, ("empty", F.size(r.ids) == 0)]:
        broken = broken.when(bad, name)

    def answer(error: Column) -> Column:
        good = error.isNull()
        return F.struct(F.when(good, r.ids).alias("token_ids"), F.when(good, r.logprobs).alias("logprobs"), F.when(good, finish).alias("finish"), F.when(good, version).alias("version"), error.alias("error")).cast(RESPONSE)

    return _let(broken, answer)


def _version(v: Column, path: str) -> Column:
    """A version as text: 0 is the text 0, null and what is missing are null."""
    at = _at(v, path)
    return F.when(_kind(at) != "VOID", F.try_variant_get(at, "$", "string"))


def _named(t: Column) -> Column:
    """N of a text token_id:N."""
    return F.regexp_extract(t, "^token_id:([0-9]+)$", 1).try_cast("bigint")


def pairs_response(body: Column) -> Column:
    """output_ids, and meta_info with finish_reason.type and triples (log-probability, id, text)."""

    def read(v: Column) -> Column:
        entries, listed = _items(v, "$.meta_info.output_token_logprobs"), _at(v, "$.output_ids")
        seen = _each(entries, lambda e: _id(_at(e, "$[1]")))
        # ids can be left to the triples
        ids = F.when(listed.isNull() | (_kind(listed) == "VOID"), seen).otherwise(_each(_items(v, "$.output_ids"), _id))
        finish = _at(v, "$.meta_info.finish_reason.type", "string")
        row = F.struct(ids.alias("ids"), seen.alias("seen"), _each(entries, lambda e: _number(_at(e, "$[0]"))).alias("logprobs"))
        rules = lambda r: [("abort", finish == "abort"), ("token_ids", ~_whole(r.ids)), ("logprobs", ~(_whole(r.logprobs) & _whole(r.seen))), ("aligned", r.ids != r.seen)]
        return _let(row, lambda r: _answer(v, r, finish, _version(v, "$.meta_info.weight_version"), rules(r)))

    return _let(F.try_parse_json(body), read)


def content_response(body: Column) -> Column:
    """choices[0] with token_ids, logprobs.content of objects, and version spans."""

    def token(e: Column) -> Column:
        return F.when(_at(e, "$.token_id").isNotNull(), _id(_at(e, "$.token_id"))).otherwise(_named(_at(e, "$.token", "string")))

    def read(v: Column) -> Column:
        entries, spans = _items(v, "$.choices[0].logprobs.content"), _items(v, "$.choices[0].weight_versions")
        said, given, count = _version(v, "$.weight_version"), _at(v, "$.choices[0].weight_versions"), _at(v, "$.usage.completion_tokens")
        raw = _at(v, "$.choices[0].finish_reason")
        finish = F.coalesce(_at(v, "$.choices[0].finish_reason.type", "string"), F.when(_kind(raw) == "STRING", F.try_variant_get(raw, "$", "string")))
        row = F.struct(
            _each(_items(v, "$.choices[0].token_ids"), _id).alias("ids"), _each(entries, token).alias("seen"), _each(entries, lambda e: _number(_at(e, "$.logprob"))).alias("logprobs"),
            _each(spans, lambda s: _id(_at(s, "$.start"))).alias("start"), _each(spans, lambda s: _id(_at(s, "$.end"))).alias("end"),
            _each(spans, lambda s: F.when(_kind(_at(s, "$.version")) == "STRING", F.nullif(_at(s, "$.version", "string"), F.lit("")))).alias("names"),
            F.when(finish == "cancelled", "abort").otherwise(finish).alias("finish"),
        )

        def answer(r: Column) -> Column:
            steps = F.concat(F.array(F.lit(0).cast("bigint")), r.end) == F.concat(r.start, F.array(F.size(r.ids).cast("bigint")))
            one = F.get(r.names, F.lit(0))
            covered = _whole(r.start) & _whole(r.end) & _whole(r.names) & steps & F.forall(F.arrays_zip(r.start.alias("a"), r.end.alias("b")), lambda s: s.a < s.b)
            agreed = covered & (F.size(F.array_distinct(r.names)) <= 1) & F.coalesce(said == one, F.lit(True))
            spanned = given.isNotNull() & (_kind(given) != "VOID")
            return _answer(v, r, r.finish, F.when(spanned, F.coalesce(one, said)).otherwise(said), [
                ("abort", r.finish == "abort"), ("finish", ~F.coalesce(r.finish.isin("stop", "length"), r.finish.isNull())), ("token_ids", ~_whole(r.ids)), ("version", spanned & ~F.coalesce(agreed, F.lit(False))),
                ("logprobs", ~_whole(r.logprobs)), ("aligned", ~F.coalesce(r.ids == r.seen, F.lit(False))), ("usage", count.isNotNull() & (_kind(count) != "VOID") & ~F.coalesce(_id(count) == F.size(r.ids), F.lit(False))),
            ])

        return _let(row, answer)

    return _let(F.try_parse_json(body), read)


def columns_response(body: Column) -> Column:
    """choices[0].logprobs with tokens as token_id:N beside token_logprobs; no version is reported."""

    def read(v: Column) -> Column:
        tokens, listed = _items(v, "$.choices[0].logprobs.tokens"), _items(v, "$.choices[0].logprobs.token_logprobs")
        ids = _each(tokens, lambda t: F.when(_kind(t) == "STRING", _named(F.try_variant_get(t, "$", "string"))))
        row = F.struct(F.coalesce(ids, F.array().cast("array<bigint>")).alias("ids"), F.coalesce(_each(listed, _number), F.array().cast("array<double>")).alias("logprobs"))
        finish = _at(v, "$.choices[0].finish_reason", "string")
        rules = lambda r: [("abort", finish == "abort"), ("aligned", F.size(r.ids) != F.size(r.logprobs)), ("token_ids", ~_whole(r.ids)), ("logprobs", ~_whole(r.logprobs))]
        return _let(row, lambda r: _answer(v, r, finish, F.lit(None).cast("string"), rules(r)))

    return _let(F.try_parse_json(body), read)
