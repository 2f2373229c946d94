"""Pins, switches and refusals against plain Python."""

import random

from pyspark.sql import functions as F

from turnloom.operators import controls


def test_precedence(spark):
    d = spark.createDataFrame([(True, True, None), (False, True, True), (None, None, True), (False, False, False)], "a boolean, b boolean, c boolean")
    got = [r[0] for r in d.select(controls.precedence([(F.col("a"), 401), (F.col("b"), 400), (F.col("c"), 410)])).collect()]
    assert got == [401, 400, 410, 200]


def test_model_pins(spark):
    rnd = random.Random(1)
    log = [(rnd.choice("ab"), i, rnd.choice([None, "", " ", "m", "n"])) for i in range(40)]
    pins, want = {}, {}
    for stream, i, asked in log:
        asked = (asked or "").strip()
        if asked:
            pins.setdefault(stream, asked)
        want[i] = (pins.get(stream), not asked or asked == pins[stream])
    got = {r.ordinal: (r.pinned, r.ok) for r in controls.model_pins(spark.createDataFrame(log, "stream string, ordinal int, asked string")).collect()}
    assert got == want


def test_first_pins(spark):
    held = spark.createDataFrame([("a", "1"), ("b", "1"), ("e", None)], "name string, pin string")
    seen = spark.createDataFrame([("a", 1, "1"), ("b", 2, "2"), ("c", 5, "x"), ("c", 4, "y"), ("d", 6, "z"), ("d", 7, "z"), ("d", 8, None), ("e", 9, "w"), ("f", 10, None)], "name string, ordinal int, pin string")
    got = {r.name: (r.pin, r.conflict) for r in controls.first_pins(held, seen).collect()}
    assert got == {"a": ("1", False), "b": ("1", True), "c": ("y", True), "d": ("z", False), "e": ("w", False)}


def test_switches(spark):
    rnd = random.Random(4)
    log = [(rnd.choice("ab"), i, *rnd.choice([("read", None), ("read", None), ("set", True), ("set", False), ("set", None)])) for i in range(60)]
    state, want = {}, {}
    for stream, i, kind, value in log:
        if kind == "set":
            state[stream] = value
        else:
            want[i] = (stream == "a") if state.get(stream) is None else state[stream]
    d = spark.createDataFrame(log, "stream string, ordinal int, kind string, value boolean")
    assert {r.ordinal: r.effective for r in controls.switches(d, F.col("stream") == "a").collect()} == want


def test_instances_and_bodies(spark):
    d = spark.createDataFrame([("i", "i"), (None, None), ("j", "i"), ("i", "j"), (None, "j")], "h string, k string")
    assert [r[0] for r in d.select(controls.bound_to("i", F.col("h"), F.col("k"))).collect()] == [None, None, 412, 412, 412]
    cases = [("sampling", "{}", "ok"), ("sampling", '{"top_k": 5, "top_p": 0.5}', "ok"), ("sampling", '{"top_k": 5.0}', "top_k"), ("sampling", '{"top_p": null}', "top_p"), ("sampling", '{"max_tokens": 5}', "unknown"), ("sampling", "[]", "object"), ("sampling", "null", "object"), ("sampling", None, "object"),
             ("sampling", '{"temperature": true}', "temperature"), ("captures", '{"enabled": true}', "ok"), ("captures", '{"enabled": null}', "ok"), ("captures", '{"enabled": 0}', "boolean"), ("captures", '{"enabled": "true"}', "boolean"), ("captures", "{}", "object"), ("captures", "true", "object"), ("captures", "x", "object"), ("other", "{}", "control"), (None, "{}", "control")]
    d = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, name string, raw string, want string").orderBy("i")
    assert [r[0] for r in d.select(controls.control_request(F.col("name"), F.col("raw"))).collect()] == [c[2] for c in cases]
