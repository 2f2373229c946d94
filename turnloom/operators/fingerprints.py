"""Fingerprints of tokenizers as trees of digests, so that no row holds a vocabulary.

A component (vocabulary, merges, added tokens, backend, probe) is a list of leaves in order, each one canonical
JSON. Leaves are numbered and digested one by one; FAN neighbours make a node, LEVELS times, and the last
nodes of a component are few enough for one digest. The tree's shape depends on the number of leaves alone,
so equal lists have equal roots on any cluster, and two fingerprints that differ are told apart by component.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnloom.operators.messages import canonical, exact
from turnloom.sources.objects import json_object

FAN = 256
LEVELS = 2


def root(leaves: DataFrame, order: list[str], owner: str = "owner", leaf: str = "leaf") -> DataFrame:
    """owner, root (null if any leaf is null) and n of each owner's leaves in order."""
    d = leaves.select(owner, F.row_number().over(Window.partitionBy(owner).orderBy(*order)).alias("place"), F.sha2(leaf, 256).alias("digest"), F.lit(1).cast("bigint").alias("n"))
    d = d.withColumn("place", (F.col("place") - 1).cast("bigint"))
    for level in range(LEVELS + 1):
        up = F.floor(F.col("place") / FAN) if level < LEVELS else F.lit(0)
        inside = F.array_sort(F.collect_list(F.struct("place", "digest")))
        whole = F.when(F.count("digest") == F.count("*"), F.sha2(F.array_join(F.transform(inside, lambda x: x["digest"]), ""), 256))
        d = d.withColumn("up", up.cast("bigint")).groupBy(owner, "up").agg(whole.alias("digest"), F.sum("n").alias("n")).withColumnRenamed("up", "place")
    return d.select(owner, F.col("digest").alias("root"), "n")


def vocabulary(tokens: DataFrame) -> DataFrame:
    """owner, token, id, in the order of tokens."""
    leaf = F.to_json(F.array(F.col("token"), F.col("id").cast("string")))
    return root(tokens.select("owner", "token", "id", leaf.alias("leaf")), ["token", "id"])


def merge_pair(raw: Column) -> Column:
    """A merge as canonical JSON of its pair; raw: JSON of a pair of texts, or of one text with one blank between its parts; null for others."""
    listed = F.try_variant_get(exact(raw), "$", "array<variant>")
    pair = F.when((F.size(listed) == 2) & F.forall(listed, lambda x: F.schema_of_variant(x) == "STRING"), canonical(raw))
    text = F.when(F.schema_of_variant(exact(raw)) == "STRING", F.try_variant_get(exact(raw), "$", "string"))
    parts = F.split(text, " ", -1)
    return F.coalesce(pair, F.when(F.size(parts) == 2, F.to_json(parts)))


def merges(entries: DataFrame) -> DataFrame:
    """owner, place, raw; the order is the merges' priority."""
    return root(entries.select("owner", "place", merge_pair(F.col("raw")).alias("leaf")), ["place"])


#: An added token's flags, as they enter its leaf.
FLAGS = ("special", "lstrip", "rstrip", "single_word", "normalized")


def added(tokens: DataFrame) -> DataFrame:
    """owner, id, content and FLAGS; missing flags are false. In the order of ids."""
    fields = {"id": F.col("id"), "content": F.col("content")} | {f: F.coalesce(F.col(f), F.lit(False)) for f in FLAGS}
    return root(tokens.select("owner", "id", "content", json_object(fields).alias("leaf")), ["id", "content"])


def documents(rows: DataFrame) -> DataFrame:
    """owner, place, raw JSON of a backend's parts, or of a probe's ids."""
    return root(rows.select("owner", "place", canonical(F.col("raw")).alias("leaf")), ["place"])


def fingerprints(components: dict[str, DataFrame], algorithm: str, corpus: str) -> DataFrame:
    """owner, each component's root and number of leaves, and the fingerprint over all of them; null if a component is missing or damaged."""
    named = [d.select("owner", F.col("root").alias(k), F.col("n").alias(f"n_{k}")) for k, d in components.items()]
    d = reduce(lambda a, b: a.join(b, "owner", "full_outer"), named)
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in components])
    parts = {"algorithm": F.lit(algorithm), "corpus": F.lit(corpus)} | {x: F.col(x) for k in sorted(components) for x in (k, f"n_{k}")}
    return d.withColumns({"algorithm": F.lit(algorithm), "corpus": F.lit(corpus), "fingerprint": F.when(whole, F.sha2(json_object(parts), 256))})


def agreement(local: DataFrame, remote: DataFrame, components: list[str]) -> DataFrame:
    """owner and verdict of each local fingerprint: model (none reported), protocol (another algorithm or corpus), the
    names of the components that differ, pin (none kept), or ok. remote has a column pin."""
    r = remote.select(F.col("owner").alias("__owner"), F.struct(*[c for c in remote.columns if c != "owner"]).alias("r"))
    d = local.join(r, local["owner"] == r["__owner"], "left")
    same = lambda c: F.coalesce(F.col(c) == F.col(f"r.{c}"), F.lit(False))
    differ = F.array_join(F.array_compact(F.array(*[F.when(~(same(c) & same(f"n_{c}")), c) for c in components])), ",")
    verdict = F.when(F.col("__owner").isNull(), "model").when(~(same("algorithm") & same("corpus")), "protocol").when(differ != "", differ).when(F.coalesce(F.col("r.pin"), F.lit("")) == "", "pin").otherwise("ok")
    return d.select("owner", verdict.alias("verdict"))
