"""Trees of digests against plain Python, whatever the partitions."""

import json
from hashlib import sha256

from pyspark.sql import functions as F

from turnloom.operators import fingerprints


def tree(leaves):
    level = [sha256(x.encode()).hexdigest() for x in leaves]
    for _ in range(fingerprints.LEVELS):
        level = [sha256("".join(level[i : i + fingerprints.FAN]).encode()).hexdigest() for i in range(0, len(level), fingerprints.FAN)]
    return sha256("".join(level).encode()).hexdigest()


def test_roots(spark):
    for n in (1, 255, 256, 257, 3000):
        words = sorted((f"w{i * 7919 % n:x}", i) for i in range(n))
        want = tree([json.dumps([w, str(i)], separators=(",", ":")) for w, i in words])
        for parts in (1, 5):
            d = spark.createDataFrame([("a", w, i) for w, i in words] + [("b", w, i + (k == 0)) for k, (w, i) in enumerate(words)], "owner string, token string, id bigint").repartition(parts, "token")
            got = {r.owner: r for r in fingerprints.vocabulary(d).collect()}
            assert got["a"].root == want and got["a"].n == n and got["b"].root != want


def test_merges_in_both_shapes(spark):
    rows = ['"a b"', '["a","b"]', '[ "a" , "b" ]', '"a\\u0020b"', '"a  b"', '"ab"', '["a"]', '["a","b","c"]', '["a",1]', "3", "{", None, '"a "', '" "']
    got = [r[0] for r in spark.createDataFrame(list(enumerate(rows)), "i int, raw string").orderBy("i").select(fingerprints.merge_pair(F.col("raw"))).collect()]
    pair = '["a","b"]'
    assert got == [pair] * 4 + [None] * 8 + ['["a",""]', '["",""]']
    d = spark.createDataFrame([("a", 0, '"a b"'), ("a", 1, '"c d"'), ("b", 1, '["c","d"]'), ("b", 0, '["a","b"]'), ("c", 0, '"c d"'), ("c", 1, '"a b"'), ("x", 0, '"a b"'), ("x", 1, '"ab"')], "owner string, place int, raw string")
    r = {x.owner: x.root for x in fingerprints.merges(d).collect()}
    assert r["a"] == r["b"] != r["c"] and r["x"] is None


def test_damaged_and_missing_components(spark):
    v = fingerprints.vocabulary(spark.createDataFrame([("a", "t", 1), ("b", "t", 1)], "owner string, token string, id int"))
    m = fingerprints.merges(spark.createDataFrame([("a", 0, '"x y"'), ("c", 0, '"x"')], "owner string, place int, raw string"))
    f = fingerprints.fingerprints({"vocab": v, "merges": m}, "v1", "c0")
    assert {r.owner: r.fingerprint is not None for r in f.collect()} == {"a": True, "b": False, "c": False}
    same = fingerprints.agreement(f, f.withColumn("pin", F.lit("p")), ["vocab", "merges"])
    assert {r.owner: r.verdict for r in same.collect()} == {"a": "ok", "b": "merges", "c": "vocab,merges"}
