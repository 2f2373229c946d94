"""Streams, captures, array logic and stateful operators."""

import base64
import random

import numpy as np
from pyspark.sql import functions as F

from turnloom.functions import tokens
from turnloom.operators import captures, ordered, training
from turnloom.plans import texts
from turnloom.sources import adapter, records
from turnloom.streaming import recorder

TURN = "session_id string, agent_id string, segment_index bigint, turn_ordinal bigint, prompt_ids array<bigint>, completion_ids array<bigint>, completion_logprobs array<double>, purpose string, weight_version string"


def test_two_agents_interleave(spark):
    rows = [("s", "p", 0, 1, [1, 2], [3], [-0.25], "primary", "7"), ("s", None, 0, 2, [10], [11, 12], [-0.5, -0.5], "primary", "7"), ("s", "p", 0, 3, [4], [5, 6], [-0.25, -0.25], "primary", "7"), ("s", None, 0, 4, [13], [], [], "primary", "7"), ("s", None, 0, 5, [], [14], [-1.0], "auxiliary", "7")]
    random.Random(3).shuffle(rows)
    got = {r.agent_id: r for r in training.record_to_streams(spark.createDataFrame(rows, TURN)).collect()}
    p, n = got["p"], got[None]
    assert p.tokens == [1, 2, 3, 4, 5, 6] and p.loss_mask == [0, 0, 1, 0, 1, 1] and p.logprobs == [0, 0, -0.25, 0, -0.25, -0.25]
    assert [(s.start, s.end) for s in p.spans] == [(2, 3), (4, 6)]
    assert n.tokens == [10, 11, 12, 13, 14] and n.loss_mask == [0, 1, 1, 0, 0] and [(s.start, s.end) for s in n.spans] == [(1, 3), (4, 4), (4, 5)]


def test_tampered_streams_fail_their_rules(spark):
    s = training.record_to_streams(spark.createDataFrame([("s", "p", 0, 1, [1], [2], [-0.5], "primary", "7")], TURN))
    ok = training.validate_streams(s).first()
    assert all(ok[c] for c in ("aligned", "binary_mask", "finite", "ordered", "covers", "mask_in_spans", "quiet_prompts"))
    bad = s.withColumn("loss_mask", F.array(F.lit(1), F.lit(2))).withColumn("logprobs", F.array(F.lit(float("nan"))))
    r = training.validate_streams(bad).first()
    assert not (r.aligned or r.binary_mask or r.finite or r.mask_in_spans)


def test_empty_turns(spark, sf):
    assert training.record_to_streams(training.with_tokens(adapter.turns(spark, sf).limit(0))).count() == 0


def test_gap_prefix_header(spark):
    d = spark.createDataFrame([([1, 7], [7, 8], [1, 2], [1, 2, 2], [40, 5], [40])], "s array<int>, e array<int>, one array<int>, two array<int>, delta array<int>, h array<int>")
    r = d.select(tokens.turn_gap(F.col("s"), F.col("e")).alias("g"), tokens.turn_gap(F.col("s"), F.col("e"), F.array(F.lit(7))).alias("c"), tokens.implicit_prefix(F.col("one"), F.col("two")).alias("p"), tokens.without_sampled_header(F.col("s"), F.col("delta"), F.col("h")).alias("d")).first()
    assert (r.g, r.c, r.p, r.d) == ([8], [], [1], [40, 5])


def test_pack(spark):
    as_text = lambda v, kind: base64.b64encode(np.array(v, kind).tobytes()).decode()

    def file(v, kind):
        import io

        out = io.BytesIO()
        np.save(out, np.array(v, kind))
        return base64.b64encode(out.getvalue()).decode()

    # text, prompt, completion, start, cols, bytes
    plain = [
        (as_text([9, 0, 255, 7], "<i4"), 2, 1, 0, None, [9, 0, 255, 7]), (as_text([[1, 2], [3, 4], [5, 6]], "<i4"), 2, 2, 1, 2, [3, 4, 5, 6]), (as_text([[3, 4], [5, 6]], "<i4"), 2, 2, 1, 2, [3, 4, 5, 6]),
        (as_text([1, 2, 3], "<i4"), 2, 1, 0, None, None), (as_text([256, 1], "<i4"), 2, 1, 0, None, None), (as_text([-1, 1], "<i4"), 2, 1, 0, None, None), (as_text([1, 2], "<i4"), 2, 1, 0, 2, None),
        (as_text([1, 2], "<i4"), 1, 0, 0, None, None), (None, 2, 1, 0, None, None), ("", 2, 1, 0, None, None), ("not base64!", 2, 1, 0, None, None), ("AQID", 2, 1, 0, None, None),
    ]
    files = [
        (file([[[1], [2]], [[3], [255]]], "<i8"), 2, 1, 0, None, [1, 2, 3, 255]), (file([[1, 2], [3, 4]], "u1"), 1, 2, 1, 2, [3, 4]), (file([[3, 4]], "<u2"), 1, 2, 1, 2, [3, 4]),
        (file([[1.0, 2.0]], "<f4"), 1, 1, 0, None, None), (file([[1, 2]], "<i4"), 2, 1, 0, None, None), (file([[1, 300]], "<i4"), 1, 1, 0, None, None), (file([[1, 2]], "<i4"), 1, 1, 0, 3, None),
        (file([1, 2], "<i4"), 2, 1, 0, None, None), (file(np.asfortranarray([[1, 2], [3, 4]]), "<i4"), 2, 1, 0, None, None), (as_text([1, 2], "<i4"), 2, 1, 0, None, None), (None, 2, 1, 0, None, None),
    ]
    schema = "e string, p bigint, c bigint, s bigint, w bigint, want array<int>"
    for rows, pack in ((plain, captures.pack), (files, captures.pack_npy)):
        d = spark.createDataFrame(rows, schema).withColumn("b", pack(F.col("e"), F.col("p"), F.col("c"), F.col("s"), F.col("w")))
        for r in d.collect():
            assert (None if r.b is None else list(base64.b64decode(r.b.data))) == r.want, r
            assert r.b is None or (r.b.rows, r.b.cols * r.b.rows, r.b.dtype, r.b.start) == (r.p + r.c - 1 - r.s, len(r.want), "uint8", r.s)


def test_fold(spark):
    b = lambda n: base64.b64encode(bytes(range(n))).decode()
    rows = [("s", None, 0, 1, b(2), 2, 1, 0), ("s", None, 0, 2, b(1), 1, 1, 2), ("s", None, 0, 3, b(1), 1, 1, 7), ("s", None, 0, 4, b(1), 1, 1, 0), ("s", None, 0, 5, b(5), 5, 1, 0)]
    d = spark.createDataFrame(rows, "session_id string, agent_id string, segment_index bigint, ordinal bigint, data string, rows bigint, cols bigint, start bigint")
    r = captures.fold(d).first()
    assert (r.rows, r.accepted, r.dropped, base64.b64decode(r.data)) == (5, 3, 2, bytes(range(5)))


def test_chunks_and_ranges(spark):
    """Chunks hold the fold's bytes, and a range is cut out of them as out of one blob; columns are two wide, keys can be null."""
    rnd = random.Random(3)
    rows, want = [], {}
    for seg in range(6):
        stored, n = None, 0
        for i in range(30):
            k = rnd.randrange(1, 5)
            data = bytes(rnd.randrange(256) for _ in range(2 * k))
            start = rnd.choice([n] * 6 + [0, n + 1])
            rows.append(("s", None if seg % 2 else "a", seg, i, base64.b64encode(data).decode(), k, 2, start))
            if stored is not None and start > 0 and start == n:
                stored, n = stored + data, n + k
            elif start == 0 and (stored is None or k >= n):
                stored, n = data, k
        want[seg] = stored
    d = spark.createDataFrame(rows, "session_id string, agent_id string, segment_index bigint, ordinal bigint, data string, rows bigint, cols bigint, start bigint").repartition(5)
    assert {r.segment_index: base64.b64decode(r.data) for r in captures.fold(d).collect()} == want
    pieces = captures.chunks(d).cache()
    for low, high in ((0, 10**6), (0, 1), (3, 9), (20, 21), (10**5, 10**6)):
        got = {}
        for r in sorted(captures.rows_between(pieces, F.lit(low), F.lit(high)).collect(), key=lambda r: (r.segment_index, r.first)):
            assert len(r.bytes) == 2 * r.rows and r.first >= low
            got[r.segment_index] = got.get(r.segment_index, b"") + bytes(r.bytes)
        assert got == {k: v[2 * low : 2 * high] for k, v in want.items() if v[2 * low : 2 * high]}


def test_endpoints_of_lifetimes(spark):
    """Against a fold over one list, with streams bound again after a release."""
    rnd = random.Random(8)
    log = [(rnd.choice("abcdefg"), i * 3, rnd.choice(["use", "use", "use", "release"])) for i in range(500)]
    held, dealt, want = {}, 0, {}
    for stream, i, kind in log:
        if kind == "release":
            held.pop(stream, None)
            continue
        if stream not in held:
            held[stream], dealt = dealt % 4, dealt + 1
        want[i] = held[stream]
    got = {r.ordinal: r.endpoint for r in ordered.bound(spark.createDataFrame(log, "stream string, ordinal bigint, kind string").repartition(7), 4, buckets=16).collect()}
    assert got == want


def test_snapshot_table(spark, tmp_path):
    """A repeated batch changes nothing; compactions keep what came between; readers see whole states."""
    from turnloom.sources.snapshot_sink import SnapshotTable

    t = SnapshotTable(spark, str(tmp_path / "t"))
    rows = lambda *r: spark.createDataFrame(list(r), "session_id string, version bigint, payload string")
    state = lambda: {r.session_id: (r.version, r.payload) for r in t.read().collect()}
    assert state() == {} and not t.compact()
    assert t.add(rows(("a", 1, "x"), ("a", 2, "y"), ("b", 5, "z")), 0) and not t.add(rows(("a", 9, "twice")), 0)
    assert t.add(rows(("a", 1, "late"), ("c", 1, "n")), 1) and state() == {"a": (2, "y"), "b": (5, "z"), "c": (1, "n")}
    before = t.read()
    # a batch that comes while the compaction writes
    whole, put = t._written, []
    t._written = lambda d, kind: (whole(d, kind), put or put.append(t.add(rows(("b", 6, "new")), 2)))[0] if kind == "whole" else whole(d, kind)
    assert t.compact() and len(t.state()[1]["folders"]) == 2 and put == [True]
    assert state() == {"a": (2, "y"), "b": (6, "new"), "c": (1, "n")} and before.count() == 3 and not t.add(rows(("a", 9, "again")), 2)
    assert t.clean(1) == 2 and state() == {"a": (2, "y"), "b": (6, "new"), "c": (1, "n")}
    # a manifest that a lost writer left empty is passed over
    (tmp_path / "t" / "manifests" / "000000000099.json").write_text("")
    assert t.state()[0] == 3 and state()["b"] == (6, "new")


def test_snapshot_stream(spark, tmp_path):
    from turnloom.sources.snapshot_sink import SCHEMA, SnapshotTable

    t, src, at = SnapshotTable(spark, str(tmp_path / "t")), str(tmp_path / "in"), str(tmp_path / "at")
    run = lambda: t.stream(spark.readStream.schema(SCHEMA).parquet(src), at).trigger(availableNow=True).start().awaitTermination(60)
    for i in range(3):
        spark.createDataFrame([("a", i, f"p{i}"), (f"s{i}", 1, "q")], SCHEMA).write.mode("append").parquet(src)
        assert run()
    want = {"a": (2, "p2"), "s0": (1, "q"), "s1": (1, "q"), "s2": (1, "q")}
    assert {r.session_id: (r.version, r.payload) for r in t.read().collect()} == want
    for name in ("2", ".2.crc"):  # as if the driver was lost after the sink's commit and ahead of the stream's
        (tmp_path / "at" / "commits" / name).unlink()
    folders = t.state()[1]["folders"]
    assert run() and t.state()[1]["folders"] == folders and {r.session_id: (r.version, r.payload) for r in t.read().collect()} == want


def event(session, ordinal, kind, agent=None, segment=0, messages=1, prompt=1, completion=1, purpose="primary", ts=None, text="x", m="m", p="p"):
    return recorder.Event(session, ordinal, ordinal * 1000 if ts is None else ts, kind, agent, segment, purpose, messages, m, prompt, p, completion, text)


def outcomes(spark, events, **kw):
    return sorted(map(tuple, recorder.record(spark.createDataFrame(events, recorder.EVENT), **kw).collect()), key=lambda r: (r[0], r[2]))


def test_recorder_rules(spark):
    """Segments are the last one or the next, whatever a flag says; repeats, short prompts and strange purposes are refused."""
    e = [event("s", i, "turn", "a", **kw) for i, kw in enumerate([
        {"segment": 1}, {}, {}, {"messages": 2, "prompt": 2, "text": "y"}, {"messages": 2, "prompt": 2, "text": "z"}, {"messages": 3, "prompt": 2}, {"messages": 3, "prompt": 3, "purpose": "other"}, {"segment": 1, "text": "n"},
        {"segment": 0, "messages": 9, "prompt": 9}, {"segment": 3}, {"segment": None}, {"segment": -1}, {"segment": 1, "text": "n", "purpose": "auxiliary"}, {"segment": 1, "messages": 2, "prompt": 2}, {"segment": 2},
    ])]
    assert [r[5] for r in outcomes(spark, e)] == ["segment", None, "repeat", None, "short", "short", "purpose", None, "segment", "segment", "segment", "segment", "short", None, None]


def test_repairs(spark):
    """Only an exact retry before the agent's next turn repairs; the first loss stays; other agents are on their own."""
    lost = {"messages": 2, "prompt": 2, "text": "y"}
    e = [event("s", 0, "turn", "a"), event("s", 1, "failed", "a", **lost), event("s", 2, "failed", "a", messages=3), event("s", 3, "collect"), event("s", 4, "turn", "b"), event("s", 5, "turn", "a", m="other", **lost | {"text": "w"}),
         event("s", 6, "turn", "a", segment=1), event("s", 7, "collect"), event("t", 1, "failed"), event("t", 2, "collect"), event("t", 3, "turn", p="q"), event("t", 4, "turn"), event("t", 5, "collect"),
         event("u", 0, "turn"), event("u", 1, "failed"), event("u", 2, "turn"), event("u", 3, "collect"), event("v", 0, "collect"), event("w", 0, "failed"), event("w", 1, "turn", p="q"), event("w", 2, "turn"), event("w", 3, "collect")]
    got = {(r[0], r[2]): (r[5], r[8], r[10]) for r in outcomes(spark, e)}
    assert got["s", 2] == ("held", False, None) and got["s", 3] == ("failed", False, None) == got["s", 7] and got["s", 4] == (None, False, None)
    # a lost first turn of an unknown session is repaired by itself, not after another one
    assert got["t", 2] == ("unknown", False, None) and got["t", 3] == (None, False, None) and got["t", 4] == ("repeat", False, None) and got["t", 5] == ("failed", False, None)
    assert got["u", 1] == (None, False, None) and got["u", 2] == ("repeat", True, None) and got["u", 3] == (None, False, "0") and got["v", 0] == ("unknown", False, None)
    assert got["w", 3] == ("failed", False, None)


def test_tombstones_expire(spark):
    h = recorder.TTL_MS
    e = [event("s", 0, "turn", ts=0), event("s", 1, "delete", ts=10), event("s", 2, "turn", ts=9 + h), event("s", 3, "collect", ts=9 + h), event("s", 4, "failed", ts=9 + h), event("s", 5, "turn", ts=10 + h), event("s", 6, "collect", ts=10 + h), event("s", 7, "delete", ts=11 + h), event("s", 8, "delete", ts=12 + h), event("s", 9, "turn", ts=11 + 2 * h), event("s", 10, "turn", ts=12 + 2 * h)]
    assert [(r[5], r[9], r[10]) for r in outcomes(spark, e)] == [(None, False, None), (None, False, None), ("deleted", True, None), ("unknown", False, None), ("deleted", False, None), (None, False, None), (None, False, "5"), (None, False, None), (None, False, None), ("deleted", True, None), (None, False, None)]


def random_log(n, seed):
    """Events of a few sessions and agents with whole messages and tokens, and what a recorder on whole lists makes of them."""
    rnd = random.Random(seed)
    store, lost, buried, events, want = {}, {}, {}, [], []
    plain = lambda s, a, i, k, ok, why, rep=False, rec=None: want.append((s, i, k, ok, why, rep, k == "turn" and why == "deleted", rec))
    last = {}
    for i in range(n):
        s, a, ts = rnd.choice("stu"), rnd.choice(["a", "b", None]), i * 1000
        kind = rnd.choices(["turn", "failed", "delete", "collect"], [30, 3, 1, 3])[0]
        mine = [t for t in store.get(s, []) if t["agent"] == a]
        if kind in ("turn", "failed"):
            seg = mine[-1]["segment"] if mine else 0
            same = [t for t in mine if t["segment"] == seg]
            msgs = [m for t in same for m in t["messages"]] + ["u%d" % rnd.randrange(3)]
            prompt = [x for t in same for x in t["prompt"] + t["tokens"]] + [rnd.randrange(3)]
            e = {"agent": a, "segment": seg, "messages": msgs, "all": prompt, "tokens": [rnd.randrange(2) for _ in range(rnd.randrange(1, 3))], "purpose": rnd.choice(["primary", "primary", "auxiliary"])}
            if rnd.random() < 0.35 and (s, a) in last:
                e = last[s, a]
            elif rnd.random() < 0.2:
                e = e | {"segment": seg + rnd.choice([1, 2]), "messages": ["o"], "all": [7]}
            elif rnd.random() < 0.1:
                e = e | {"all": prompt[:1]}
            last[s, a] = e
            events.append(recorder.Event(s, i, ts, kind, a, e["segment"], e["purpose"], len(e["messages"]), repr(e["messages"]), len(e["all"]), repr(e["all"]), len(e["tokens"]), repr(e["tokens"])))
        else:
            events.append(recorder.Event(s, i, ts, kind, None, None, None, None, None, None, None, None, None))
        gone = s in buried and ts - buried[s] < 20_000
        if kind == "delete":
            store.pop(s, None), lost.pop(s, None)
            buried[s] = ts
            plain(s, None, i, kind, True, None)
        elif kind == "collect":
            why = "unknown" if gone or s not in store else "failed" if lost.get(s) else None
            plain(s, None, i, kind, why is None, why, rec=None if why else ",".join(str(t["i"]) for t in store[s]))
        elif gone:
            plain(s, a, i, kind, False, "deleted")
        elif kind == "failed":
            new = a not in lost.setdefault(s, {})
            if new:
                lost[s][a] = (e["messages"], e["all"], e["tokens"], e["segment"], e["purpose"], len(mine))
            plain(s, a, i, kind, new, None if new else "held")
        else:
            turns = store.setdefault(s, [])
            fits = lost.get(s, {}).get(a) == (e["messages"], e["all"], e["tokens"], e["segment"], e["purpose"], len(mine))
            current = mine[-1]["segment"] if mine else -1
            why, new = None, dict(e, prompt=e["all"], i=i)
            if e["segment"] not in (current, current + 1):
                why = "segment"
            elif e["segment"] == current:
                same = [t for t in mine if t["segment"] == current]
                k, size = sum(len(t["messages"]) for t in same), sum(len(t["prompt"]) + len(t["tokens"]) for t in same)
                if (len(e["messages"]), e["tokens"], len(e["all"]), e["purpose"]) == (k, mine[-1]["tokens"], size - len(mine[-1]["tokens"]), mine[-1]["purpose"]):
                    why = "repeat"
                elif len(e["messages"]) <= k or len(e["all"]) < size:
                    why = "short"
                new = dict(e, messages=e["messages"][k:], prompt=e["all"][size:], i=i)
            if why is None:
                turns.append(new)
            if fits and why in (None, "repeat"):
                del lost[s][a]
            plain(s, a, i, kind, why is None, why, fits and why in (None, "repeat"))
    return events, want


def short(r):
    return r[0], r[2], r[3], r[4], r[5], r[8], r[9], r[10]


def test_recorder_against_lists(spark):
    for seed in range(4):
        events, want = random_log(900, seed)
        got = [short(r) for r in outcomes(spark, events, ttl_ms=20_000)]
        assert sorted(got, key=lambda r: r[1]) == want
        assert {r[4] for r in want} >= {None, "segment", "repeat", "short", "deleted", "held", "unknown", "failed"} and any(r[5] for r in want)


def test_stream_equals_batch(spark, tmp_path):
    """Deletions, expiries, repeats and repairs over several micro-batches, written with their late turns apart; a repeated batch adds nothing."""
    events, _ = random_log(600, 9)
    d = spark.createDataFrame(events, recorder.EVENT)
    want = sorted(map(tuple, recorder.record(d, ttl_ms=20_000).collect()), key=repr)
    src, out, at = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "at")

    def run():
        rows = spark.readStream.schema(d.schema).parquet(src)
        recorder.write_split(recorder.record_stream(rows, ttl_ms=20_000, keep_ms=3_600_000), out, at).trigger(availableNow=True).start().awaitTermination()
        return [tuple(r) for side in ("main", "late") for r in spark.read.parquet(f"{out}/{side}").drop("batch").collect()]

    # else a query over processing time goes on with empty batches and never ends
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    for lo in (0, 150, 300, 450):
        d.where(f"ordinal >= {lo} AND ordinal < {lo + 150}").coalesce(1).write.mode("append").parquet(src)
        got = run()
    assert sorted(got, key=repr) == want
    assert {r.reason for r in spark.read.parquet(f"{out}/late").collect()} == {"deleted"} and not any(r.late for r in spark.read.parquet(f"{out}/main").collect())
    (last,) = sorted((tmp_path / "at" / "commits").glob("3"))
    last.unlink()  # as if the driver was lost before the last commit
    (tmp_path / "at" / "commits" / ".3.crc").unlink()
    assert sorted(run(), key=repr) == want


def test_live_streams(spark):
    r = random.Random(2)
    for limit, n, names in ((2, 60, "abcd"), (3, 200, "abcdefgh")):
        log = [(r.choice("pq"), r.choice(names), i, r.choice(["use", "use", "use", "delete"])) for i in range(n)]
        held, gone, want = {"p": [], "q": []}, {"p": [], "q": []}, {}
        for profile, stream, i, action in log:  # lists, searched whole
            h, g = held[profile], gone[profile]
            want[i] = action == "delete" or stream not in g
            if action == "delete":
                h[:], g[:] = [x for x in h if x != stream], [x for x in g if x != stream]
            elif stream not in g:
                h[:] = [x for x in h if x != stream] + [stream]
                if len(h) > limit:
                    g.append(h.pop(0))
        r.shuffle(log)
        got = recorder.live_streams(spark.createDataFrame(log, "profile string, stream string, ordinal bigint, action string"), limit).collect()
        assert {x.ordinal: x.admitted for x in got} == want and not all(want.values())


def test_raw_ids_and_sinks(spark, tmp_path):
    cases = {"[1, 2]": True, "[]": True, "[true]": False, "[-1]": False, "[1.0]": False, '["3"]': False, "null": False, "{}": False, "x": False, None: False, "[null]": False}
    d = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.ok for r in d.select("t", records.token_ids_ok(F.col("t")).alias("ok")).collect()} == cases
    schema, path = "session_id string, version int, payload string", str(tmp_path / "snap")
    for rows in ([("a", 1, "old"), ("a", 2, "new"), ("b", 1, "only")], [("a", 1, "late"), ("c", 7, "more")], [("a", 3, "newest")]):
        records.write_snapshots(spark.createDataFrame(rows, schema), path)
    newest = {"a": (3, "newest"), "b": (1, "only"), "c": (7, "more")}
    read = lambda where: {r.session_id: (r.version, r.payload) for r in records.read_snapshots(spark, where).collect()}
    assert read(path) == newest
    records.compact_snapshots(spark, path, str(tmp_path / "small"))
    assert read(str(tmp_path / "small")) == newest and spark.read.parquet(str(tmp_path / "small")).count() == 3
    e = spark.createDataFrame([("r", "a", "t", "m"), ("r", "b", "t", "n"), ("q", "a", "t", "o")], "run_ts string, session_id string, ts string, message string")
    records.append_errors(e, str(tmp_path / "log"))
    records.append_errors(e, str(tmp_path / "log"))
    assert [r.line for r in records.session_log(spark, str(tmp_path / "log"), "r", "a").collect()] == ["[t] m"] * 2
    assert records.run_folder("x/", "2024-01-01 10:00") == "x/run_ts=2024-01-01%2010%3A00"


def test_prompts_extend_the_stream():
    from turnloom.streaming.continuation import Profile, Stream, code_points

    s = Stream(Profile("x", prefix="P", ending="~\n"), code_points)
    turns = [("Pab", "c~", "t"), ("Pd", "e", "t"), ("Px", "y", "other"), ("Pf", "", "t"), ("g", "", "t")]
    text, got = "", []
    for prompt, completion, tools in turns:
        n, ids, why = s.turn("user", prompt, completion, tools)
        got.append((None if ids is None else "".join(map(chr, ids)), why))
        if ids is not None:
            text += got[-1][0]
            assert n == len(text)
            text += completion
    assert got == [("Pab", None), ("\nd", None), (None, "tools changed"), ("~\nf", None), (None, "delta without the render's prefix")]
    guard = Stream(Profile("y", prefix=None, system_header="S:", generation="A", headers=("<u>",)), code_points)
    assert guard.turn("user", "hi", "<u>", "t")[0] == 3
    assert guard.turn("user", "S:hi", "", "t")[2] == "delta with a system prefix" and guard.turn("user", "<o>", "", "t")[2] == "sampled header of another role"
    assert "".join(map(chr, guard.turn("user", "<u>on", "", "t")[1])) == "~onA"


def test_settings():
    import pytest

    from turnloom.sources.config import load

    assert load(None).max_streams == 4096 and load({"engine_urls": "a, b"}).engine_urls == ["a", "b"]
    for bad in ({"nope": 1}, {"record_dir": "x"}, {"engine_urls": "a", "router_url": "b"}, {"max_streams": 0}):
        with pytest.raises(ValueError):
            load(bad)


def test_capture_fold_has_whole_turns(spark, sf):
    keys = ["session_id", "agent_id", "segment_index"]
    n = {}
    for r in adapter.turns(spark, sf).select(*keys, (F.col("n_prompt") + F.col("n_completion")).alias("n")).collect():
        n[tuple(r)[:3]] = n.get(tuple(r)[:3], 0) + r.n
    whole = [r for r in texts.capture_fold(spark, sf).collect() if not r.dropped]
    assert whole and all(r.rows == n[r.session_id, r.agent_id, r.segment_index] for r in whole) and max(r.rows for r in whole) > 27


def test_global_order_of_sparse_and_null_ids(spark):
    from turnloom.operators import ordered

    r = random.Random(5)
    ids = [r.choice([i, i * 10**9, -i * 77]) for i in range(400)] + [None, None]
    r.shuffle(ids)
    d = spark.createDataFrame(list(zip(ids, range(len(ids)))), "k bigint, n bigint")
    got = {x.n: x.place for x in ordered.global_row_number(d, ["k", "n"], buckets=16).collect()}
    want = sorted(range(len(ids)), key=lambda n: (ids[n] is not None, ids[n] or 0, n))
    assert [n for n, _ in sorted(got.items(), key=lambda x: x[1])] == want and sorted(got.values()) == list(range(1, len(ids) + 1))
    sizes = [x["count"] for x in ordered.bucketed(d, "k", 16).groupBy("bucket").count().collect()]
    assert len(sizes) >= 12 and max(sizes) <= 60
    rows = sorted({i for i in ids if i is not None})
    value = {k: (k % 7 if k % 3 == 0 else None) for k in rows}
    e = spark.createDataFrame(list(value.items()), "k bigint, v bigint")
    seen, expect = None, {}
    for k in rows:
        seen = seen if value[k] is None else value[k]
        expect[k] = seen
    assert {x.k: x.last for x in ordered.last_before(e, "k", "v", "last", buckets=16).collect()} == expect


def test_folds_read_keys_of_any_length_in_order(spark):
    from collections import namedtuple

    from turnloom.streaming.ordered_fold import in_order

    Row = namedtuple("Row", "k n")
    d = spark.range(30000).selectExpr("CASE WHEN id % 10 = 0 THEN NULL WHEN id % 3 = 0 THEN 'b' ELSE 'a' END AS k", "id AS n").orderBy("n", ascending=False)

    def fold(rows):
        last = None
        for i, r in enumerate(rows):
            assert last is None or r.n > last
            last = r.n
            yield r.k, r.n, i

    got = in_order(d, ["k"], ["n"], Row, fold, "k string, n bigint, place bigint")
    assert {(x.k, x.m, x.c) for x in got.groupBy("k").agg(F.max("place").alias("m"), F.count("*").alias("c")).collect()} == {(None, 2999, 3000), ("b", 8999, 9000), ("a", 17999, 18000)}
    assert in_order(d.limit(0), ["k"], ["n"], Row, fold, "k string, n bigint, place bigint").count() == 0
