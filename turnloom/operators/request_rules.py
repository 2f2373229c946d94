"""Rules for raw request bodies, compiled to one expression over a variant.

A rule is a verdict and what an accepted value is; rules stand in the order in which they win, and compiled
they are one CASE, so a body is parsed once and the first failure names the verdict. Kinds are exact: a
whole number is no fraction and true is no number. Values that must be one constant are compared as
canonical text.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnloom.operators.messages import exact, message

#: Names of sampling parameters, efforts, purposes and the fields that a request can have.
SAMPLING = ("temperature", "top_p", "top_k", "min_p", "repetition_penalty", "presence_penalty", "frequency_penalty")
EFFORTS = ("none", "minimal", "low", "medium", "high", "xhigh", "max")
PURPOSES = ("primary", "compaction", "auxiliary")
FIELDS = (
    "model", "messages", "tools", "stream", "stream_options", "n", "response_format", "tool_choice", "parallel_tool_calls", "logprobs", "top_logprobs", "logit_bias",
    "max_tokens", "max_completion_tokens", "stop", "stop_token_ids", "seed", "reasoning_effort", "rollout", *SAMPLING, "user", "metadata", "safety_identifier",
)
#: The range of each sampling parameter.
RANGES: dict[str, Callable[[Column], Column]] = {
    "temperature": lambda x: x >= 0, "top_p": lambda x: (x > 0) & (x <= 1), "top_k": lambda x: (x == -1) | (x >= 1), "min_p": lambda x: x.between(0, 1),
    "repetition_penalty": lambda x: x > 0, "presence_penalty": lambda x: x.between(-2, 2), "frequency_penalty": lambda x: x.between(-2, 2),
}

Test = Callable[[Column], Column]
Rule = tuple[str, Test]  # a verdict, and whether a map of a body's fields fails it


#: Kinds of whole numbers.
INTS = ("BIGINT", "DECIMAL")


def kind(v: Column) -> Column:
    """Name of a variant's kind without what it holds, and the empty text where there is none; whole numbers are INTS."""
    return F.regexp_extract(F.coalesce(F.schema_of_variant(v), F.lit("")), "^[A-Z]+", 0)


def at(v: Column, path: str, as_kind: str = "variant") -> Column:
    return F.try_variant_get(v, path, as_kind)


def given(v: Column) -> Column:
    """Whether a value is there and is not null."""
    return ~kind(v).isin("", "VOID")


def is_text(v: Column) -> Column:
    return kind(v) == "STRING"


def is_int(least: int | None = None) -> Test:
    return lambda v: kind(v).isin(*INTS) & (F.lit(True) if least is None else F.coalesce(at(v, "$", "decimal(38,0)") >= least, F.lit(False)))


def is_list_of(test: Test, nonempty: bool = False) -> Test:
    def check(v: Column) -> Column:
        items = at(v, "$", "array<variant>")
        return (kind(v) == "ARRAY") & F.coalesce(F.forall(items, test), F.lit(False)) & (F.size(items) > 0 if nonempty else F.lit(True))

    return check


def is_one_of(*texts: str) -> Test:
    return lambda v: is_text(v) & at(v, "$", "string").isin(*texts)


def is_named(v: Column) -> Column:
    """A text with more than blanks."""
    return is_text(v) & (F.regexp_replace(F.coalesce(at(v, "$", "string"), F.lit("")), "[\\s\\x{1c}-\\x{1f}\\x{85}\\p{Z}]+", "") != "")


def is_json(*texts: str) -> Test:
    """Exactly one of these values, written canonically."""
    return lambda v: F.coalesce(F.to_json(v).isin(*texts), F.lit(False))


def any_of(*tests: Test) -> Test:
    return lambda v: reduce(lambda a, b: a | b, [t(v) for t in tests])


def in_range(name: str) -> Test:
    """A finite number in the parameter's range; top_k is whole."""

    def check(v: Column) -> Column:
        number = at(v, "$", "double")
        return kind(v).isin(*INTS, *([] if name == "top_k" else ["DOUBLE"])) & F.coalesce(RANGES[name](number) & (F.abs(number) < float("inf")), F.lit(False))

    return check


def optional(field: str, test: Test, verdict: str | None = None) -> Rule:
    """A field that can be missing or null."""
    return verdict or field, lambda m: given(m[field]) & ~test(m[field])


def present(field: str, test: Test) -> Rule:
    """A field that can be missing, but null is a value."""
    return field, lambda m: F.array_contains(F.map_keys(m), field) & ~test(m[field])


def required(field: str, test: Test) -> Rule:
    return field, lambda m: ~test(m[field])


def first_failure(m: Column, rules: list[Rule]) -> Column:
    """The verdict of the first rule that fails, else null."""
    return F.coalesce(*[F.when(F.coalesce(fails(m), F.lit(True)), verdict) for verdict, fails in rules])


def fields_of(v: Column) -> Column:
    return F.when(kind(v) == "OBJECT", at(v, "$", "map<string,variant>"))


def in_list(v: Column, rules: list[Rule], other: str) -> Column:
    """The first failure within a list of objects, in the list's order; other: the verdict of what is no object."""
    found = F.transform(at(v, "$", "array<variant>"), lambda x: F.when(kind(x) != "OBJECT", other).otherwise(first_failure(fields_of(x), rules)))
    return F.get(F.array_compact(found), F.lit(0))


_NAMED_FUNCTION = lambda test: lambda m: ~((kind(m["function"]) == "OBJECT") & test(at(m["function"], "$.name")))
CALL_RULES: list[Rule] = [
    ("call", lambda m: ~is_one_of("function")(m["type"])),
    ("call_name", _NAMED_FUNCTION(is_text)),
    ("call_arguments", lambda m: ~kind(at(m["function"], "$.arguments")).isin("STRING", "OBJECT")),
]
TOOL_RULES: list[Rule] = [
    ("tool_type", lambda m: ~is_one_of("function")(m["type"])),
    ("tool_name", _NAMED_FUNCTION(is_named)),
    ("tool_parameters", lambda m: given(at(m["function"], "$.parameters")) & (kind(at(m["function"], "$.parameters")) != "OBJECT")),
    ("tool_strict", lambda m: given(at(m["function"], "$.strict")) & ~is_json("false")(at(m["function"], "$.strict"))),
]
GENERATION_RULES: list[Rule] = [
    *[optional(name, in_range(name)) for name in SAMPLING],
    optional("max_tokens", is_int(1)), optional("max_completion_tokens", is_int(1)), optional("seed", is_int()), optional("stop_token_ids", is_list_of(is_int(0))),
    optional("stop", any_of(lambda v: is_text(v) & (at(v, "$", "string") != ""), is_list_of(lambda x: is_text(x) & F.coalesce(at(x, "$", "string") != "", F.lit(False))))),
]
OPTION_RULES: list[Rule] = [
    optional("reasoning_effort", is_one_of(*EFFORTS)),
    ("rollout", lambda m: F.array_contains(F.map_keys(m), "rollout") & ~F.coalesce(F.forall(F.map_keys(fields_of(m["rollout"])), lambda k: k.isin("segment_index", "purpose")), F.lit(False))),
    ("segment_index", lambda m: F.coalesce(first_failure(fields_of(m["rollout"]), [present("segment_index", is_int(0))]).isNotNull() & m["rollout"].isNotNull(), F.lit(False))),
    ("purpose", lambda m: F.coalesce(first_failure(fields_of(m["rollout"]), [present("purpose", is_one_of(*PURPOSES))]).isNotNull() & m["rollout"].isNotNull(), F.lit(False))),
    present("stream", lambda v: kind(v) == "BOOLEAN"),
    optional("n", is_json("1")), optional("response_format", is_json('{"type":"text"}')), optional("tool_choice", is_json('"auto"')), optional("parallel_tool_calls", is_json("true")), optional("logprobs", is_json("false")),
    optional("top_logprobs", is_json("0")), optional("logit_bias", is_json("{}")), optional("stream_options", is_json("{}", '{"include_usage":true}')),
]


def unsupported(m: Column) -> Column:
    """Sorted names of the fields that are given and unknown."""
    return F.array_sort(F.map_keys(F.map_filter(m, lambda k, v: ~k.isin(*FIELDS) & given(v))))


def _messages(m: Column) -> Column:
    """The first failure of the messages: all of them are read as messages first."""
    v = m["messages"]
    listed = is_list_of(lambda x: F.lit(True), nonempty=True)(v)
    bad = F.exists(at(v, "$", "array<variant>"), lambda x: message(F.to_json(x))["error"].isNotNull())
    legacy: list[Rule] = [("audio", lambda f: given(f["audio"]) | given(f["function_call"])), ("calls", lambda f: given(f["tool_calls"]) & (kind(f["tool_calls"]) != "ARRAY"))]
    one = lambda x: F.coalesce(first_failure(fields_of(x), legacy), in_list(fields_of(x)["tool_calls"], CALL_RULES, "call"))
    own = F.get(F.array_compact(F.transform(at(v, "$", "array<variant>"), one)), F.lit(0))
    return F.when(~listed, "messages").when(bad, "message").otherwise(own)


def _tools(m: Column) -> Column:
    return F.when(given(m["tools"]) & (kind(m["tools"]) != "ARRAY"), "tools").when(given(m["tools"]), in_list(m["tools"], TOOL_RULES, "tool_type"))


def chat_request(raw: Column) -> Column:
    """Struct of verdict (ok, or the name of the first rule that a body fails) and unsupported (field names)."""

    def judged(m: Column) -> Column:
        names = unsupported(m)
        verdict = F.coalesce(F.when(m.isNull(), "body"), first_failure(m, [required("model", is_named)]), _messages(m), _tools(m), first_failure(m, GENERATION_RULES + OPTION_RULES), F.when(F.size(names) > 0, "fields"), F.lit("ok"))
        return F.struct(verdict.alias("verdict"), F.coalesce(names, F.array().cast("array<string>")).alias("unsupported"))

    return F.transform(F.array(fields_of(exact(raw))), judged)[0]


def generation_parameters(raw: Column) -> Column:
    """The first of the generation parameters that is refused, ok, or body for what is no object."""
    return F.transform(F.array(fields_of(exact(raw))), lambda m: F.when(m.isNull(), "body").otherwise(F.coalesce(first_failure(m, GENERATION_RULES), F.lit("ok"))))[0]
