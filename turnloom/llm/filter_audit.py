"""Interaction of filters by inclusion-exclusion.

Every row gets its failure flags once. One aggregation gives, for each part of the table, the joint
failures of all 2 ** n sets of filters as sums of products of flags, for all rows and for rows of
each label. All that is asked of any order follows from these sums alone:

- survivors of a set of filters: the Möbius inversion, sum over its subsets of (-1) ** size * joint failures;
- removed by a step: the difference of the survivors before and after it;
- redundant: the filter's failures that an earlier step removed; unique: the survivors of all others
  that it removes;
- Shapley: joint failures of a set, with their sign, are its Harsanyi dividend, which its filters share
  evenly; n! times that is the sum over all orders, and whole, as n! has all sizes for divisors.

So the rows are read once, whatever the number of orders, and what is spread out has n! * n rows a part.

The fifth filter fails a text that a smaller doc_id has anywhere in the table. Equal texts are brought
together by their SHA-256, after rows of one digest, part, flags and labels were counted, so a group of
any number of copies is a few rows.

Defined results: a null text is an empty one, a null part joins the empty one; a null doc_id is no smaller id
and has none, so it does not fail as a copy; equal ids are not smaller than one another; several label
rows of a doc_id count if any of them is 1, those of unknown documents not at all; repeated rows
count each; an empty table has no parts; other columns never enter.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WHITE = " \\t\\n\\u000b\\u000c\\r"
#: letter, condition of a failure over __text, __words, __n; the last filter is the copies' one.
FILTERS = [
    ("A", "size(__words) < 100"),
    ("B", "100 * size(array_distinct(__words)) < 80 * size(__words)"),
    ("C", "100 * (length(__text) - length(translate(__text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 10 * length(__text)"),
    ("D", "__text RLIKE '[#$%&*|]'"),
]
COPY = "E"


def flagged(df: DataFrame, text: str, filters: list[tuple[str, str]], keep: dict[str, Column]) -> DataFrame:
    """keep, the digest of the text and __mask, whose bit i is a failure of filter i; one pass over the texts."""
    d = df.select(*[c.alias(name) for name, c in keep.items()], F.coalesce(df[text].cast("string"), F.lit("")).alias("__text"))
    d = d.withColumn("__trim", F.expr(f"btrim(__text, '{WHITE}')"))
    d = d.withColumn("__words", F.when(F.col("__trim") == "", F.array().cast("array<string>")).otherwise(F.split("__trim", "[ \\t\\n\\x0B\\f\\r]+")))
    mask = reduce(lambda a, b: a + b, [F.when(F.expr(cond), 1 << i).otherwise(0) for i, (_, cond) in enumerate(filters)])
    return d.select(*keep, F.unhex(F.sha2("__text", 256)).alias("__digest"), mask.alias("__mask"))


def counted(rows: DataFrame, copy_bit: int, same: list[str]) -> DataFrame:
    """same, __mask with the copies' bit, and __n rows of each kind; rows: id, __digest, __mask and the columns same."""
    kind = ["__digest", "__mask", *same]
    # copies by id first, so that repeated rows of the first id are told from its copies
    ids = rows.groupBy(*kind, "id").agg(F.count("*").alias("n"))
    groups = ids.groupBy(*kind).agg(
        F.min("id").alias("low"), F.expr("min_by(n, id) FILTER (WHERE id IS NOT NULL)").alias("n_low"),
        F.sum("n").alias("n"), F.coalesce(F.expr("sum(n) FILTER (WHERE id IS NULL)"), F.lit(0)).alias("n_null"),
    )
    # a digest has as many rows here as parts and labels, however many copies
    first = F.min("low").over(Window.partitionBy("__digest"))
    groups = groups.withColumn("kept", F.col("n_null") + F.when(F.col("low") == first, F.col("n_low")).otherwise(0))
    both = F.array(F.struct(F.col("__mask"), F.col("kept").alias("n")), F.struct((F.col("__mask") + F.lit(copy_bit)).alias("__mask"), (F.col("n") - F.col("kept")).alias("n")))
    return groups.select(*same, F.explode(both).alias("x")).select(*same, "x.__mask", F.col("x.n").alias("__n"))


def joint(cells: DataFrame, part: str, n: int, weights: dict[str, Column]) -> DataFrame:
    """Of each part, for each weight an array of joint failures: place S holds those of all filters in the set S."""
    d = cells.select(part, "__n", *[F.expr(f"(__mask >> {i}) & 1").alias(f"f{i}") for i in range(n)], *[w.cast("bigint").alias(f"w_{k}") for k, w in weights.items()])
    flags = ["".join(f" * f{i}" for i in range(n) if s >> i & 1) for s in range(1 << n)]
    return d.groupBy(part).agg(*[F.expr(f"array({', '.join(f'sum(__n * w_{k}{x})' for x in flags)})").alias(k) for k in weights])


def survivors(joint_failures: str, n: int) -> Column:
    """Möbius inversion: place P holds the rows that fail no filter of the set P."""
    every = f"sequence(0, {(1 << n) - 1})"
    return F.expr(f"transform({every}, p -> aggregate({every}, 0L, (a, s) -> a + if((s & ~p) = 0, if(bit_count(s) % 2 = 0, 1, -1) * {joint_failures}[s], 0L)))")


def audit(df: DataFrame, labels: DataFrame | None = None, key: str = "doc_id", text: str = "text", part: str = "lang", filters: list[tuple[str, str]] = FILTERS) -> DataFrame:
    """One row per part, order of all filters (the copies' one is the last letter) and step.

    labels: doc_id, quality, toxic. filters: letters and SQL conditions over __text and __words.
    """
    n = len(filters) + 1
    letters = "".join(x for x, _ in filters) + COPY
    rows = flagged(df, text, filters, {"id": df[key], "part": F.coalesce(df[part].cast("string"), F.lit(""))})
    if labels is None:
        rows = rows.withColumn("good", F.lit(False)).withColumn("toxic", F.lit(False))
    else:
        marks = labels.groupBy(labels["doc_id"].alias("__id")).agg(F.max(F.coalesce(labels["quality"] == 1, F.lit(False))).alias("g"), F.max(F.coalesce(labels["toxic"] == 1, F.lit(False))).alias("t"))
        rows = rows.join(marks, rows["id"] == marks["__id"], "left").select(*rows.columns, F.coalesce("g", F.lit(False)).alias("good"), F.coalesce("t", F.lit(False)).alias("toxic"))
    cells = counted(rows, 1 << (n - 1), ["part", "good", "toxic"])
    sums = joint(cells, "part", n, {"all": F.lit(1), "good": F.col("good"), "toxic": F.col("toxic")})
    left = sums.select("part", "all", *[survivors(k, n).alias(f"{k}_left") for k in ("all", "good", "toxic")])
    # orders times steps of constants: the sets before and after each step
    orders = []
    for o in permutations(range(n)):
        before = 0
        for step, f in enumerate(o):
            orders.append((before, f, step + 1))
            before |= 1 << f
    names = ["".join(letters[f] for f in o) for o in permutations(range(n))]
    numbers = lambda values: F.expr(f"split('{' '.join(map(str, values))}', ' ')")
    spread = F.arrays_zip(numbers([x for x in names for _ in range(n)]).alias("o"), numbers([b for b, _, _ in orders]).alias("b"), numbers([f for _, f, _ in orders]).alias("f"), numbers([s for _, _, s in orders]).alias("s"))
    d = left.select("*", F.explode(spread).alias("x")).select("part", "all", "all_left", "good_left", "toxic_left", F.col("x.o").alias("filter_order"), F.expr("int(x.b)").alias("b"), F.expr("int(x.f)").alias("f"), F.expr("int(x.s)").alias("step"))
    d = d.withColumn("bit", F.expr("shiftleft(1, f)"))
    lost = lambda k, b: f"{k}_left[{b}] - {k}_left[{b} | bit]"
    whole = (1 << n) - 1
    total = len(names)
    shapley = f"aggregate(sequence(1, {whole}), 0L, (a, s) -> a + if((s & bit) <> 0, if(bit_count(s) % 2 = 1, 1, -1) * all[s] * ({total} div bit_count(s)), 0L))"
    return d.select(
        "part", "filter_order", "step", F.expr("all_left[b | bit]").alias("kept"), F.expr(lost("all", "b")).alias("removed"),
        F.expr(f"all[bit] - ({lost('all', 'b')})").alias("redundant"), F.expr(lost("all", f"({whole} & ~bit)")).alias("unique_fails"),
        F.expr(lost("good", "b")).alias("good_lost"), F.expr(lost("toxic", "b")).alias("toxic_lost"), F.expr(shapley).alias("shapley"),
    )
