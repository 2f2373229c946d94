"""Periodic runs, filter audit and shards against brute force."""

import random
from collections import defaultdict
from hashlib import sha256
from itertools import permutations
from zlib import crc32

import numpy as np
import pytest

from turnloom.llm import filter_audit, periodic_runs, sharding
from turnloom.llm.queries import QUERIES, tail_repeated


def brute_runs(w, least=12):
    """Every period by itself; a run counts under its smallest period."""
    n, out = len(w), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            a = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            size = i - a + q
            if size >= max(least, 2 * q) and not any(w[a : a + size - r] == w[a + r : a + size] for r in range(1, q)):
                out.append((a, size, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text, edit=None):
    words = (text or "").encode().split()
    if edit:
        words = edit(doc_id, words)
    runs = brute_runs(words)
    gone = {k for a, n, q in runs for k in range(a + q, a + n)}
    a, n, q = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    lines = "".join(f"{a},{n},{q}\n" for a, n, q in runs)
    kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
    return doc_id, len(runs), a, n, q, 1000 * n // q if runs else None, sha256(lines.encode()).hexdigest(), sha256(kept).hexdigest()


@pytest.mark.parametrize("least", [2, 12])
def test_runs_of_few_letters(least):
    """Words of few kinds with repeated tails, several documents together, all runs of all lengths."""
    rnd = random.Random(least)
    for _ in range(300):
        docs = []
        for _ in range(rnd.randint(1, 5)):
            n, k = rnd.choice([0, 1, 2, 13, 40, 90]), rnd.choice([1, 2, 3, 6])
            w = [b"%d" % rnd.randrange(k) for _ in range(n)]
            if n and rnd.random() < 0.5:
                a = rnd.randrange(n)
                p = 1 + rnd.randrange(max(1, (n - a) // 2))
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            docs.append(w)
        assert [list(map(tuple, r.tolist())) for r in periodic_runs.found(docs, least)] == [brute_runs(w, least) for w in docs]


def test_long_runs():
    """One word many times, a Fibonacci word (most runs), a long period over two thirds of the text, many different words."""
    rnd = random.Random(5)
    fib = [b"a", b"ab"]
    while len(fib[-1]) < 400:
        fib.append(fib[-1] + fib[-2])
    fib = [bytes([x]) for x in fib[-1]]
    base = [b"w%d" % rnd.randrange(10**6) for _ in range(700)]
    for words in ([b"x"] * 1500, fib, base[:300] * 3 + base[300:], base):
        assert list(map(tuple, periodic_runs.found([words, [], words])[2].tolist())) == brute_runs(words)
    n = 400_000
    assert periodic_runs.found([[b"y", b"z"] * (n // 2)])[0].tolist() == [[0, n, 2]]


def test_smaller_values():
    rnd = np.random.default_rng(3)
    for n in (1, 2, 30, 500):
        v = rnd.integers(0, n, n)
        want = [next((j for j in range(i + 1, n) if v[j] < v[i]), n) for i in range(n)]
        assert periodic_runs.next_smaller(v, n).tolist() == want
    assert periodic_runs.next_smaller(np.arange(300)[::-1].copy(), 300).tolist() == [*range(1, 300), 300]
    assert periodic_runs.next_smaller(np.arange(300), 300).tolist() == [300] * 300


def test_op11(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = sorted(map(tuple, QUERIES["op11_periodic_runs"](spark, sf).collect()))
    assert got == sorted(brute_row(r.doc_id, r.text, tail_repeated) for r in docs)
    assert sum(r[1] > 0 for r in got) > len(docs) // 20


def test_odd_runs(spark, odd):
    got = periodic_runs.report(odd, texts=True).collect()
    want = [brute_row(r.doc_id, r.text if r.doc_id != 6 else None) for r in odd.collect()]
    assert sorted((tuple(r)[:8] for r in got if r.doc_id != 6), key=repr) == sorted((r for r in want if r[0] != 6), key=repr)
    (long,) = [r for r in got if r.doc_id == 6]
    assert tuple(long)[1:6] == (1, 0, 60000, 1, 60000000) and long.collapsed == "word" and long.runs[0].length == 60000
    assert periodic_runs.report(odd.where("false")).collect() == []


def brute_audit(docs, labels, filters):
    """Leads every row through every order."""
    first = {}
    for i, part, text in docs:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    rows = []
    for i, part, text in docs:
        t = text or ""
        w = t.encode().split()
        fails = {x for x, f in filters.items() if f(t, w)} | ({"E"} if i is not None and i > first[t] else set())
        rows.append((part or "", fails, any(d == i and q == 1 for d, q, _ in labels if d is not None), any(d == i and x == 1 for d, _, x in labels if d is not None)))
    out = defaultdict(lambda: [0] * 6)
    shapley = defaultdict(int)
    for part in {r[0] for r in rows}:
        for o in permutations("ABCDE"):
            for s in range(5):
                cell = out[part, "".join(o), s + 1]
                for p, fails, good, toxic in rows:
                    if p != part:
                        continue
                    at = next((k for k in range(5) if o[k] in fails), 9)
                    cell[0] += at > s
                    cell[1] += at == s
                    cell[2] += at < s and o[s] in fails
                    cell[3] += fails == {o[s]}
                    cell[4] += at == s and good
                    cell[5] += at == s and toxic
                shapley[part, o[s]] += cell[1]
    return sorted((part, o, s, *cell, shapley[part, o[s - 1]]) for (part, o, s), cell in out.items())


FILTERS = {
    "A": lambda t, w: len(w) < 100,
    "B": lambda t, w: 100 * len(set(w)) < 80 * len(w),
    "C": lambda t, w: 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t),
    "D": lambda t, w: any(c in t for c in "#$%&*|"),
}


def test_audit(spark):
    """Copies over parts and ids, repeated rows of the first id, null ids, texts and parts, labels of any kind."""
    rnd = random.Random(2)
    texts = [None, "", "short", "SHOUTED WORDS", "a | b", " ".join(f"w{i}" for i in range(120)), "x " * 130, " ".join(f"Q{i}" for i in range(110)) + " $", "\x0b\x1c é漢😀"]
    docs = [(rnd.choice([None, *range(12)]) if rnd.random() < 0.4 else k, rnd.choice([None, "", "en", "de"]), rnd.choice(texts)) for k in range(20, 180)]
    labels = [(rnd.choice([None, *range(200)]), rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for _ in range(150)]
    df = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id bigint, lang string, text string, __mask int, good string")
    lb = spark.createDataFrame([(*r, "y") for r in labels], "doc_id bigint, quality int, toxic int, text string")
    got = sorted(map(tuple, filter_audit.audit(df, lb).collect()))
    assert got == brute_audit(docs, labels, FILTERS)
    assert [r[-1] for r in filter_audit.audit(df).collect()] and filter_audit.audit(df.where("false"), lb).collect() == []


def test_audit_of_own_filters(spark):
    """Two conditions and the copies: six orders of three steps; dividends still sum up to what all remove."""
    df = spark.createDataFrame([(i, "p", t) for i, t in enumerate(["a", "a", "bb", "", "ccc ccc"])], "k bigint, part string, body string")
    rows = filter_audit.audit(df, key="k", text="body", part="part", filters=[("A", "length(__text) > 2"), ("B", "size(__words) = 0")]).collect()
    assert len(rows) == 18 and {r.filter_order for r in rows} == {"".join(p) for p in permutations("ABE")}
    assert sum(r.shapley for r in rows if r.filter_order == "ABE") == 6 * 3 and {r.kept for r in rows if r.step == 3} == {2}


def check_shards(rows, docs, shards, group=True):
    """Sizes, checksums, gapless slots, near equal bytes, and the ends of shards where the rule puts them."""
    size = lambda t: len((t or "").encode()) + 8
    assert sorted((repr(r.doc_id), r.size, r.text_crc32) for r in rows) == sorted((repr(i), size(t), crc32((t or "").encode())) for i, t in docs)
    assert {r.law for r in rows} <= {"bytes"} and {r.grown_shard for r in rows} <= {None}
    by = defaultdict(list)
    for r in sorted(rows, key=lambda r: r.place):
        by[r.shard].append(r)
    assert all([r.slot for r in x] == list(range(len(x))) for x in by.values()) and set(by) <= set(range(shards))
    total, before, ends = sum(r.size for r in rows), 0, {}
    groups = defaultdict(list)
    spans = []
    for r in sorted(rows, key=lambda r: r.place):
        spans.append((before, before + r.size))
        groups[r.place[:16]].append(spans[-1])
        before += r.size
        ends[r.shard] = before
    for s in range(shards - 1):
        t = total * (s + 1) / shards
        a, b = next(x for x in spans if x[0] <= t < x[1])
        g = next(x for x in groups.values() if x[0][0] <= t < x[-1][1])
        low, high = (g[0][0], g[-1][1]) if (g[-1][1] - g[0][0]) * sharding.KEEP * shards <= total else (a, b)
        assert max([v for k, v in ends.items() if k <= s], default=0) == min((low, high), key=lambda e: (abs(e - t), e))


def test_op13(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = sharding.assign(spark.read.parquet(f"{sf}/documents.parquet"), 24).collect()
    check_shards(rows, docs, 24)
    cols = "doc_id size text_crc32 law shard slot grown_shard".split()
    got = QUERIES["op13_sharding"](spark, sf)
    assert got.columns == cols and sorted(map(tuple, got.collect()), key=repr) == sorted((tuple(r[c] for c in cols) for r in rows), key=repr)


def test_shards_of_a_hot_group(spark):
    """A third of all rows are copies, a fifth one repeated row, and one text holds more than a shard."""
    rnd = random.Random(4)
    docs = [(i, "copied text " * 5) for i in range(700)] + [(7, "one row again and again")] * 400 + [(5000, "z" * 40000)]
    docs += [(6000 + i, "t%d " % rnd.randrange(300) * rnd.randint(0, 40)) for i in range(900)]
    df = spark.createDataFrame([(*r, 1, "p") for r in docs], "doc_id bigint, text string, size int, place string")
    rows = sharding.assign(df, 8, ranges=16).collect()
    check_shards(rows, docs, 8)
    hot = {r.shard for r in rows if r.text_crc32 == crc32(("copied text " * 5).encode())}
    assert len(hot) > 1


def test_no_range_is_overfull(spark):
    docs = [(i % 40, "same" if i % 3 else f"text {i}") for i in range(3000)]
    rows = sharding.records(spark.createDataFrame(docs, "doc_id bigint, text string"), "doc_id", "text").cache()
    total = sum(r.size for r in rows.collect())
    cuts, sums = sharding.splitters(rows, total, 32)
    assert sum(b for b, _ in sums) == total and sum(n for _, n in sums) == 3000 and max(b for b, _ in sums) <= 2 * total / 32 and cuts == sorted(set(cuts))


def test_odd_shards(spark, odd):
    rows = sharding.assign(odd, 3).collect()
    check_shards(rows, [(r.doc_id, r.text) for r in odd.collect()], 3)
    assert sharding.assign(odd.where("false"), 3).collect() == []
    assert {(r.shard, r.slot) for r in sharding.assign(odd.limit(1), 4).collect()} <= {(s, 0) for s in range(4)}
