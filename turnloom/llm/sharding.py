"""Shards of near equal size by sampled splitters.

Records have one order: by the hash of their text, then of their key, so equal texts stand together.

1. A record is drawn with a chance in proportion to its size; the driver gets about SAMPLE keys,
   whatever the table's size. A drawn key stands for the table's size by SAMPLE, or for its own if larger.
2. Boundaries at the quantiles of these weights cut the order into ranges, RANGES a shard.
3. The ranges' sizes are summed exactly. Those that hold over twice their share are drawn from anew and
   subdivided, until none is overfull but those of a single record.
4. Each range is put in order by itself, and the sums of the ranges before it give every record its exact
   place and the size before it in the whole order. A shard ends where the running size is nearest to
   its share; a group of equal texts there stays whole if it is at most 1 / KEEP of a shard, and is
   cut between records if it is larger.

So shards differ by a record or by a small group, a group of copies of any size is spread over as many
ranges as it needs, and no task gets more than its ranges. Only keys, sizes and hashes are
shuffled; texts are hashed where they are read.

Defined results: a null or empty text counts 8 bytes and the checksum 0; null keys and repeated rows are
records of their own (repeated rows are told apart by a number given when the keys are written); records of
equal hashes and key are in no certain order; an empty table gives an empty result; other columns never enter.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnloom.llm.common import checkpointed

OVERHEAD = 8
RANGES = 64
#: Drawn keys of a range.
DRAWS = 16
KEEP = 50
ROUNDS = 20


def records(df: DataFrame, key: str, text: str) -> DataFrame:
    """doc_id, size, text_crc32 and place: 48 hexadecimal digits in the records' order."""
    t = F.coalesce(df[text].cast("string"), F.lit(""))
    d = df.select(df[key].alias("doc_id"), (F.octet_length(t) + F.lit(OVERHEAD)).cast("bigint").alias("size"), F.crc32(t).alias("text_crc32"), F.xxhash64(t).alias("h"))
    digits = lambda c: F.lpad(F.hex(c), 16, "0")
    return d.select("doc_id", "size", "text_crc32", F.concat(digits(F.col("h")), digits(F.xxhash64("doc_id", "h")), digits(F.monotonically_increasing_id())).alias("place"))


def drawn(rows: DataFrame, share: float) -> list[tuple[str, float]]:
    """Places in order, with the bytes each stands for; a record is drawn with the chance size / share."""
    chance = F.expr(f"pmod(xxhash64(place, 'draw'), 1000000007) / 1000000007D < size / {share!r}D")
    return sorted((r.place, max(float(r.size), share)) for r in rows.where(chance).select("place", "size").collect())


def quantiles(sample: list[tuple[str, float]], ranges: int) -> list[str]:
    """Places at which the drawn weights reach each of the ranges' shares."""
    total, done, cuts = sum(w for _, w in sample), 0.0, []
    for place, w in sample:
        if done * ranges // total > len(cuts):
            cuts += [place] * int(done * ranges // total - len(cuts))
        done += w
    return sorted(set(cuts))


def found_range(cuts: list[str], place: str = "place") -> Column:
    """How many of the cuts are at or before a place: a binary search in one constant array."""
    if not cuts:
        return F.lit(0)
    array = f"split('{' '.join(cuts)}', ' ')"
    steps = len(cuts).bit_length()
    halve = "if(a.lo >= a.hi, a, if(c[(a.lo + a.hi) div 2] <= %s, named_struct('lo', int((a.lo + a.hi) div 2 + 1), 'hi', a.hi), named_struct('lo', a.lo, 'hi', int((a.lo + a.hi) div 2))))" % place
    # the constant is bound once, so each step reads it by its place
    return F.expr(f"transform(array({array}), c -> aggregate(sequence(1, {steps}), named_struct('lo', 0, 'hi', {len(cuts)}), (a, i) -> {halve}).lo)[0]")


def splitters(rows: DataFrame, total: int, ranges: int) -> tuple[list[str], list[tuple[int, int]]]:
    """Cuts of the order, and of each range its exact bytes and records."""
    cuts = quantiles(drawn(rows, max(total / (ranges * DRAWS), 1.0)), ranges)
    limit = 2 * total / ranges
    for _ in range(ROUNDS):
        d = rows.withColumn("r", found_range(cuts))
        got = {x.r: x for x in d.groupBy("r").agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.min("place").alias("lo"), F.max("place").alias("hi")).collect()}
        full = [r for r, x in got.items() if x.b > limit and x.lo < x.hi]
        if not full:
            break
        # one more draw from the overfull ranges alone, enough for parts of half a share
        inside = d.where(F.col("r").isin(full))
        sample = drawn(inside, max(total / (2 * ranges * DRAWS), 1.0))
        more = []
        for r in full:
            own = [s for s in sample if got[r].lo <= s[0] <= got[r].hi]
            parts = quantiles(own, max(2, round(2 * got[r].b * ranges / total))) if own else []
            # the middle place if nothing else tells its records apart
            more += [c for c in parts if c > got[r].lo] or [f"{(int(got[r].lo, 16) + int(got[r].hi, 16) + 1) // 2:048X}"]
        cuts = sorted(set(cuts) | set(more))
    else:
        raise RuntimeError(f"ranges are still overfull after {ROUNDS} rounds")
    return cuts, [(got[r].b, got[r].n) if r in got else (0, 0) for r in range(len(cuts) + 1)]


def constants(values: list[int], at: str) -> Column:
    """The value of a constant array at a place that a column gives."""
    return F.expr(f"bigint(split('{' '.join(map(str, values))}', ' ')[{at}])")


def ordered(rows: DataFrame, cuts: list[str], sums: list[tuple[int, int]]) -> DataFrame:
    """rows with nth (from 0) and before (bytes) in the whole order."""
    bytes_before, rows_before = [0], [0]
    for b, n in sums:
        bytes_before.append(bytes_before[-1] + b)
        rows_before.append(rows_before[-1] + n)
    own = Window.partitionBy("r").orderBy("place")
    d = rows.withColumn("r", found_range(cuts)).withColumn("nth", F.row_number().over(own)).withColumn("upto", F.sum("size").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.withColumn("nth", F.col("nth") - 1 + constants(rows_before[:-1], "r"))
    return d.withColumn("before", F.col("upto") - F.col("size") + constants(bytes_before[:-1], "r")).drop("upto", "r")


def shard_ends(d: DataFrame, total: int, shards: int) -> list[tuple[int, int]]:
    """(bytes, records) before each shard but the first."""
    targets = [total * s / shards for s in range(1, shards)]
    text = F.substring("place", 1, 16)
    over = F.expr(f"exists(array({', '.join(f'{t!r}D' for t in targets)}), t -> before <= t AND t < before + size)") if targets else F.lit(False)
    hit = d.where(over).select("before", "size", "nth", text.alias("h")).collect()  # a record a target at most
    if not hit:
        return []
    group = d.where(text.isin(sorted({r.h for r in hit}))).groupBy(text.alias("h")).agg(F.min("before").alias("a"), F.max(F.col("before") + F.col("size")).alias("b"), F.min("nth").alias("na"), F.max("nth").alias("nb"))
    group = {r.h: r for r in group.collect()}
    begins, ends = sorted((r.before, r) for r in hit), []
    for t in targets:
        r = begins[bisect_right([x for x, _ in begins], t) - 1][1]
        g = group[r.h]
        edges = [(g.a, g.na), (g.b, g.nb + 1)] if (g.b - g.a) * KEEP * shards <= total else [(r.before, r.nth), (r.before + r.size, r.nth + 1)]
        ends.append(min(edges, key=lambda e: (abs(e[0] - t), e)))
    return sorted(ends)


def assign(df: DataFrame, shards: int, key: str = "doc_id", text: str = "text", ranges: int = RANGES) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and place of every row."""
    rows = checkpointed(records(df, key, text))  # written once: the numbers in place must not change
    total = rows.agg(F.sum("size")).first()[0] or 0
    d = ordered(rows, *splitters(rows, total, shards * ranges)) if total else rows.withColumn("nth", F.lit(0).cast("bigint")).withColumn("before", F.lit(0).cast("bigint"))
    d = checkpointed(d)
    ends = shard_ends(d, total, shards)
    shard = F.expr(" + ".join(f"int(before >= {b}L)" for b, _ in ends)) if ends else F.lit(0)
    d = d.withColumn("shard", shard.cast("int"))
    slot = F.col("nth") - constants([0] + [n for _, n in ends], "shard")
    return d.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "place")
