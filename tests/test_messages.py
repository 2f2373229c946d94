"""Canonical JSON, normal messages and histories against plain Python."""

import json
import random

from pyspark.sql import functions as F

from turnloom.functions.completion import same_json
from turnloom.operators import messages


def test_canonical_is_exact(spark):
    """Equal canonical texts are equal values of equal types, and the other way round."""
    texts = ['1', '1.0', '1.00', '1e0', '10e-1', 'true', 'false', 'null', '"1"', '"\\u0041"', '"A"', '"a\\"1.5"', '"\\\\"', '"\\\\\\" 2.50 "', '-0.0', '0.0', '-0', '0', '-0.05', '[]', '{}', '[1,2]', '[1, 2.0]', '[2,1]',
             '{"a": 1, "b": {"d": [1.50], "c": "x"}}', '{"b":{"c":"x","d":[1.5]},"a":1}', '{"b":{"c":"x","d":[1.5]},"a":1.0}', '{"a": null}', '{"1.0": 1}', '{"1.00": 1}', '123456789012345678901234567890', '1.5e300', '15e299', '[1.25,"1.25",{"x":-2.5}]', ' [ 1 , 2 ] ', '"é漢😀"', '"\\ud83d\\ude00"', '"😀"']
    pairs = [(a, b) for a in texts for b in texts]
    d = spark.createDataFrame(pairs, "a string, b string").select("a", "b", messages.same_json(F.col("a"), F.col("b")).alias("same"))
    assert [(r.a, r.b) for r in d.collect() if r.same != same_json(json.loads(r.a), json.loads(r.b))] == []
    none = ["", None, "{", "nul", '{"a":1,"a":2}', "1" * 39, '"\u0002"', "1 x", "1] x", "1} x", "1, 2", '1, "w": 2', "1] [2", '1}, {"v": 2', "[1]]", "{}}", "1,"]
    assert {r[0] for r in spark.createDataFrame([(x,) for x in none], "a string").select(messages.canonical(F.col("a"))).collect()} == {None}
    long = json.dumps({"x": '\\"' * 50000 + "1.5", "y": [1.5] * 3000})
    assert json.loads(spark.createDataFrame([(long,)], "a string").select(messages.canonical(F.col("a"))).first()[0]) == json.loads(long)


def plain(raw):
    """(role, content, error, normal message) of one message, with lists and dictionaries."""
    try:
        m = json.loads(raw)
    except ValueError:
        m = None
    if not isinstance(m, dict):
        return None, None, "object", None
    role, content = m.get("role"), m.get("content")
    role = role if isinstance(role, str) else None
    if role not in messages.ROLES:
        return role, None, "role", None
    if isinstance(content, list):
        parts = [p if isinstance(p, str) else p["text"] if isinstance(p, dict) and p.get("type") == "text" and isinstance(p.get("text"), str) else None for p in content]
        if None in parts:
            return role, None, "parts", None
        content = "\n".join(parts)
        m["content"] = content
    elif content is not None and not isinstance(content, str):
        return role, None, "content", None
    if role == "assistant" and "tool_calls" in m and content is None:
        m["content"] = content = ""
    return role, content, None, m


RAW = ['{"role":"user","content":"a"}', '{"content": ["a"], "role": "user"}', '{"role":"user","content":[{"type":"text","text":"a"},"b"]}', '{"role":"user","content":"a\\nb"}', '{"role":"user","content":[]}', '{"role":"user","content":""}',
       '{"role":"user","content":[{"type":"image_url"}]}', '{"role":"user","content":[{"type":"text","text":3}]}', '{"role":"user","content":{"type":"text"}}', '{"role":"user","content":1}', '{"role":"critic","content":"a"}', '{"role":5}', '{"role":"user"}',
       '{"role":"user","content":null}', '{"role":"assistant","content":null,"tool_calls":[]}', '{"role":"assistant","tool_calls":[]}', '{"role":"assistant","tool_calls":[],"content":""}', '{"role":"assistant","content":null}', '{"role":"tool","tool_call_id":"c","content":"a"}',
       '{"role":"tool","tool_call_id":"d","content":"a"}', '{"role":"user","content":"a","n":1}', '{"role":"user","n":1.0,"content":"a"}', '{"role":"user","n":true,"content":"a"}', '[]', 'x', '"user"', '{"role":"user","content":"text a"}', '{"role":"system","content":["text a"]}']


def test_normal_messages(spark):
    d = messages.normalized(spark.createDataFrame(list(enumerate(RAW)), "i int, raw string")).orderBy("i").collect()
    want = [plain(x) for x in RAW]
    assert [(r.role, r.content, r.error) for r in d] == [w[:3] for w in want]
    for x, a in zip(d, want):
        for y, b in zip(d, want):
            if a[3] is not None and b[3] is not None:
                assert (x.digest == y.digest) == same_json(a[3], b[3]), (x, y)
            else:
                assert x.digest is None or y.digest is None


def expected(request, asked, state, stored, served, cap):
    """The verdict by walking along both lists."""
    _, stream, _, segment, purpose, effort = request
    read = [plain(x) for x in asked]
    have = state.get(stream)
    n = have[3] if have else 0
    old = [plain(x)[3] for x in stored.get(stream, [])][:n]
    common = 0
    for a, b in zip(read, old):
        if a[3] is None or not same_json(a[3], b):
            break
        common += 1
    if any(r[2] for r in read):
        return common, "invalid", None
    if have is None or have[0] != segment:
        return common, "opening", None
    if len(read) == n == common:
        if purpose != have[1]:
            return common, "purpose", None
        if effort != have[2]:
            return common, "effort", None
        served[stream] = served.get(stream, 0) + 1
        return common, "replay" if served[stream] <= cap else "exhausted", served[stream]
    if effort != have[2]:
        return common, "effort", None
    if len(read) < n + 2:
        return common, "short", None
    if common < n:
        return common, "modified", None
    if read[n][0] != "assistant":
        return common, "echo", None
    return common, "role" if any(r[0] not in messages.GAP_ROLES for r in read[n + 1 :]) else "ok", None


def test_histories_against_lists(spark):
    rnd = random.Random(6)
    user = lambda k: json.dumps({"role": rnd.choice(["user", "user", "tool"]), "content": rnd.choice([f"m{k}", [f"m{k}"], [{"type": "text", "text": f"m{k}"}]])})
    stored, state = {}, {}
    for s in "abcde":
        stored[s] = [x for k in range(rnd.randrange(1, 4)) for x in (json.dumps({"role": "user", "content": f"m{k}", "n": k}), json.dumps({"role": "assistant", "content": f"o{k}"}))][:-1]
        state[s] = (rnd.randrange(2), "primary", rnd.choice([None, "low"]), len(stored[s]))
    requests, asked = [], {}
    for i in range(400):
        s = rnd.choice("abcdef")
        base = list(stored.get(s, []))
        base = [json.dumps(dict(reversed(json.loads(x).items()))) if rnd.random() < 0.5 else x for x in base]
        if base and rnd.random() < 0.3:
            k = rnd.randrange(len(base))
            base[k] = rnd.choice([base[k].replace('"n": ', '"n": 1'), base[k].replace("}", ".0}"), '{"role":"user"}'])
        if rnd.random() < 0.7:
            base += [json.dumps({"role": rnd.choice(["assistant"] * 5 + ["user"]), "content": "any"})]
            base += [user(9) if rnd.random() < 0.85 else json.dumps({"role": rnd.choice(["developer", "critic", "assistant"]), "content": "x"}) for _ in range(rnd.randrange(3))]
        elif rnd.random() < 0.2:
            base = base[:-1]
        have = state.get(s, (0, "primary", None, 0))
        requests.append((f"r{i}", s, i, rnd.choice([have[0]] * 8 + [have[0] + 1]), rnd.choice(["primary"] * 7 + ["auxiliary"]), rnd.choice([have[2]] * 7 + ["high"])))
        asked[f"r{i}"] = base
    served = {}
    want = {r[0]: expected(r, asked[r[0]], state, stored, served, 4) for r in requests}
    lists = lambda d, names: spark.createDataFrame([(k, i, x) for k, v in d.items() for i, x in enumerate(v)], names)
    got = messages.judge(
        spark.createDataFrame(requests, "request string, stream string, ordinal int, segment int, purpose string, effort string"), lists(asked, "request string, place int, raw string"),
        spark.createDataFrame([(k, *v) for k, v in state.items()], "stream string, segment int, purpose string, effort string, n_messages int"), lists(stored, "stream string, place int, raw string"),
    )
    assert {r.request: (r.n_common, r.verdict, r.replay) for r in got.collect()} == want
    assert {w[1] for w in want.values()} == {"invalid", "opening", "purpose", "effort", "replay", "exhausted", "short", "modified", "echo", "role", "ok"}
