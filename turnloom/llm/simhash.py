"""SimHash near-duplicates through deletion-variant signatures.

A fingerprint's 64 bits are cut into SEGMENTS = 2 parts. Of two fingerprints that differ in at
most 3 bits, one part differs in at most 1 bit. Each part is indexed by its variants with one bit
deleted (a wildcard): two parts that differ in at most one bit share a variant. Equal variants
are joined, and the candidates verified on all 64 bits.

Equal fingerprints are one node. A bucket (all fingerprints with one variant) is never turned
into all its pairs. First every member is compared with a few pivots of its bucket, which
emits a few rows a member; the links that hold give components. Then only buckets that still
hold several components are joined, and in them only fingerprints of different components meet;
the check of the distance is part of the join's condition and a pair passes in one bucket only.

Defined results: a null or empty text has fingerprint zero and is linked like any other; repeated
rows give one row each; an empty table gives an empty result; extra columns are ignored. A null
doc_id is a node of its own fingerprint but never a component's name, unless no other is there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnloom.llm.common import checkpointed, map_texts
from turnloom.llm.components import components

WORDS = 3
SEED = 42
DISTANCE = 3
SEGMENTS = 2
BITS = 64 // SEGMENTS
PIVOTS = 4
_BIT = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_WEIGHT = (1 << np.arange(63, -1, -1, dtype=np.uint64)).astype(np.uint64)


def shingle_hashes(text: str) -> list[int]:
    words = text.encode().lower().split()
    if not words:
        return []
    line = b" ".join(words)
    if len(words) < WORDS:
        return [xxhash.xxh64_intdigest(line, SEED)]
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest, seed = xxhash.xxh64_intdigest, SEED
    return [digest(line[a:b], seed) for a, b in zip(starts[: 1 - WORDS].tolist(), ends[WORDS - 1 :].tolist())]


def fingerprints(texts: list[str]) -> np.ndarray:
    """64-bit fingerprints: a bit is set if more than half of the shingles' hashes have it."""
    hashes = [shingle_hashes(t) for t in texts]
    n = np.array([len(h) for h in hashes], np.int64)
    flat = np.array([x for h in hashes for x in h], np.uint64)
    out = np.zeros((len(texts), 64), np.int64)
    row = np.repeat(np.arange(len(texts)) * 256, n)
    for i in range(8):
        byte = (flat >> np.uint64(56 - 8 * i) & np.uint64(255)).astype(np.int64)
        byte += row
        out[:, 8 * i : 8 * i + 8] = np.bincount(byte, minlength=256 * len(texts)).reshape(-1, 256) @ _BIT
    return ((out * 2 > n[:, None]) * _WEIGHT).sum(1, dtype=np.uint64)


def fingerprinted(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """keep and fp (bigint, the fingerprint's bits) of every row's whole text."""

    def run(texts: list[str]) -> dict[str, pa.Array]:
        fps = [fingerprints(texts[i : i + 256]) for i in range(0, len(texts), 256)]
        return {"fp": pa.array(np.concatenate(fps).view(np.int64) if fps else [], pa.int64())}

    return map_texts(df, text, keep, run, "fp bigint")


def apart(a: str, b: str) -> Column:
    return F.expr(f"bit_count({a} ^ {b})")


def variants(fp: str = "fp") -> Column:
    """Keys of all one-wildcard variants of both parts: 1 bit of part, 6 of place, 32 of value."""
    return F.expr(f"""flatten(transform(sequence(0, {SEGMENTS - 1}), s -> transform(sequence(0, {BITS - 1}), w ->
        shiftleft(cast(s * 64 + w as bigint), 32) | (shiftrightunsigned({fp}, s * {BITS}) & 4294967295L & ~shiftleft(1L, w)))))""")


def first_bucket(a: str, b: str) -> str:
    """SQL: the number (part * 64 + place) of the first bucket that two fingerprints share."""
    part = lambda s: f"(shiftrightunsigned({a} ^ {b}, {s * BITS}) & 4294967295L)"
    place = lambda s: f"CASE WHEN {part(s)} = 0 THEN 0 ELSE bit_count({part(s)} - 1) END"
    return f"(CASE WHEN bit_count({part(0)}) <= 1 THEN {place(0)} ELSE 64 + {place(1)} END)"


def linked(fps: DataFrame) -> DataFrame:
    """(node, component) of the distinct fingerprints in column fp that have links."""
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a fingerprint has 64 variants: dealt anew by another key, as partitions of the grouping before are joined by the size they have without these
    index = fps.repartition(n, F.xxhash64("fp")).select("fp", F.explode(variants()).alias("key"))
    crowd = Window.partitionBy("key")
    picks = [F.min("fp").over(crowd), F.max("fp").over(crowd)] + [F.min_by("fp", F.expr(f"xxhash64(fp, {i})")).over(crowd) for i in range(PIVOTS - 2)]
    star = index.select("fp", "key", F.count("*").over(crowd).alias("n"), F.array(*picks).alias("pivots")).where("n > 1")
    star = checkpointed(star)
    near = star.select("fp", F.explode(F.array_distinct("pivots")).alias("p")).where((F.col("fp") != F.col("p")) & (apart("fp", "p") <= DISTANCE)).distinct()
    comp = checkpointed(components(near))
    # buckets of two fingerprints are done: the pivots were all there is
    rest = star.where(f"n > {2}").select("fp", "key").join(comp.select(F.col("node").alias("fp"), "component"), "fp", "left")
    rest = rest.select("fp", "key", F.coalesce("component", "fp").alias("c"))
    mixed = rest.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("key")
    rest = checkpointed(rest.join(mixed, "key", "left_semi"))
    x, y = (rest.select(F.col("fp").alias(v), F.col("key").alias("bucket"), F.col("c").alias(f"c{v}")) for v in "xy")
    cross = x.join(y, (x["bucket"] == y["bucket"]) & (F.col("cx") < F.col("cy")) & (apart("x", "y") <= DISTANCE) & (F.shiftright(x["bucket"], 32) == F.expr(first_bucket("x", "y"))))
    more = checkpointed(cross.select("cx", "cy").distinct())
    merged = components(more).toDF("component", "top")
    found = comp.join(merged, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    # fingerprints without a link in the first pass can have one now
    alone = merged.join(comp.select("component").distinct(), "component", "left_anti").toDF("node", "component")
    return found.union(alone)


def classes(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp and component_id of every row."""
    docs = checkpointed(fingerprinted(df.select(df[key].alias("doc_id"), df[text].alias("text")), ["doc_id"]))
    groups = docs.groupBy("fp").agg(F.min("doc_id").alias("first"))
    comp = checkpointed(linked(groups.select("fp")))
    groups = groups.join(comp.select(F.col("node").alias("fp"), "component"), "fp", "left")
    groups = groups.select("fp", "first", F.coalesce("component", "fp").alias("component"))
    low = groups.groupBy("component").agg(F.min("first").alias("component_id"))
    named = groups.join(low, "component").select("fp", "component_id")
    return docs.join(named, "fp").select("doc_id", "fp", "component_id")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id that can be reached)."""
    d = classes(df, key, text)
    return d.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of df whose key names their component: one document of each group stays.

    Rows with a null key stay; repeated rows with the naming key all stay only if they are equal
    in key, so exact repeats of one id count as one document.
    """
    first = classes(df, key, text).where("doc_id = component_id").select(F.col("doc_id").alias("__keep")).distinct()
    return df.join(first, df[key] == first["__keep"], "left_semi").unionByName(df.where(df[key].isNull()))
