"""Quality rules by weak supervision: rules vote or abstain, EM weighs them, posteriors decide.

Everything here is DataFrame or SQL functions; nothing runs Python on an executor.

Each rule looks at counts of one whole text and votes +1 (good), -1 (bad) or 0 (abstains). The
vote vectors are counted over the whole table (at most 3 ** len(RULES) different vectors), and
expectation-maximisation over those counts estimates each rule's accuracies and the share of good
texts; abstaining is no evidence. Texts are bad in different ways, of which most rules see nothing: so
besides the good texts there are as many kinds of bad ones as rules, and a rule has an accuracy on
each. A kind's start is that its own rule is right on it (RIGHT) and the others take it for good
(FOOLED); PRIOR votes of that stand beside the data, alike for all, and only say which class is
which. Accuracies are free within BOUNDS. A text is kept if its posterior probability of being good
is at least THRESHOLD and the base rule of n_words and n_repeat_words does not fail.

Defined results: a null text counts as one without words (base_failed, not kept, because it has
fewer than 50 words); an empty table gives an empty result; repeated rows and repeated doc_ids
give one result row each; extra columns of the input never enter.
Windows of three words are compared by their 64-bit hash within one text. Function words count as
they are written, so shouted ones do not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.llm.common import checkpointed, written

THRESHOLD = 0.5
MIN_WORDS = 50
ITERATIONS = 40
#: What a rule votes + on at the start: good texts, bad texts of its own kind, and those of other kinds.
GOOD, RIGHT, FOOLED = 0.9, 0.3, 0.9
#: The share of good texts at the start.
SHARE = 0.9
#: Votes that the start counts as, for each rule and class.
PRIOR = 10
BOUNDS = (0.001, 0.999)
WHITE = " \\t\\n\\u000b\\u000c\\r"
WHITE_RUN = "[ \\t\\n\\x0B\\f\\r]+"
#: Frequent function words of the languages.
STOPWORDS = "the of and to in is that it for der die das und ist nicht von mit ein el la los las de que y en una se por le les et des est un au qui dans".split()

#: name, condition of a vote +1, condition of a vote -1; over the columns of counted().
RULES = [
    ("length", "n_words >= 50", "n_words < 10"),
    ("symbols", "20 * n_symbols <= n_words", "10 * n_symbols > n_words"),
    ("lines", "n_dup_lines = 0", "10 * n_dup_lines > 3 * n_lines"),
    ("repeats", "20 * n_repeat_words <= n_words", "5 * n_repeat_words > n_words"),
    ("capitals", "10 * n_upper <= word_chars", "10 * n_upper > 3 * word_chars"),
    ("shouts", "100 * n_shouts <= n_words", "10 * n_shouts > n_words"),
    ("function_words", "n_stopwords >= 2", "n_stopwords = 0 AND n_words >= 20"),
    ("word_length", "word_chars BETWEEN 3 * n_words AND 10 * n_words", "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
]


def counted(df: DataFrame, text: str = "text") -> DataFrame:
    """df with a column __q of counts of each whole text; df's own columns stay as they are."""
    t = F.coalesce(df[text].cast("string"), F.lit(""))
    d = df.withColumn("__t", t).withColumn("__trim", F.expr(f"btrim(__t, '{WHITE}')"))
    d = d.withColumn("__w", F.when(F.col("__trim") == "", F.array().cast("array<string>")).otherwise(F.split("__trim", WHITE_RUN)))
    lines = F.filter(F.split("__t", "\n", -1), lambda x: x.rlike("[^ \\t\\n\\x0B\\f\\r]"))
    d = d.withColumn("__l", lines).withColumn("__s", F.regexp_replace("__t", "[^#*$%&|<>!]+", ""))
    d = d.withColumn("__h", F.when(F.size("__w") >= 3, F.expr("transform(sequence(0, size(__w) - 3), i -> xxhash64(__w[i], __w[i + 1], __w[i + 2]))")))
    d = d.withColumn("__o", F.when(F.size("__h") > F.size(F.array_distinct("__h")), F.expr("array_sort(transform(__h, (h, i) -> struct(h, i)))")))
    # first words of the windows that occur again, then the words that those windows cover
    starts = F.expr("transform(filter(transform(__o, (x, k) -> if(x.h = get(__o, k - 1).h OR x.h = get(__o, k + 1).h, x.i, -1)), v -> v >= 0), v -> v)")
    d = d.withColumn("__p", F.when(F.col("__o").isNotNull(), starts))
    covered = F.size(F.array_distinct(F.concat("__p", F.transform("__p", lambda v: v + 1), F.transform("__p", lambda v: v + 2))))
    number = lambda c: c.cast("bigint")
    q = F.struct(
        number(F.size("__w")).alias("n_words"),
        number(F.length(F.array_join("__w", ""))).alias("word_chars"),
        number(F.length(F.expr("replace(__s, '!', '')"))).alias("n_symbols"),
        number(F.size("__l") - F.size(F.array_distinct("__l"))).alias("n_dup_lines"),
        number(F.when(F.col("__p").isNull(), 0).otherwise(covered)).alias("n_repeat_words"),
        number(F.size("__l")).alias("n_lines"),
        number(F.length(F.regexp_replace("__t", "[^\\p{Lu}]+", ""))).alias("n_upper"),
        number(F.length("__s") - F.length(F.expr("replace(__s, '!', '')"))).alias("n_shouts"),
        number(F.size(F.array_intersect("__w", F.array(*map(F.lit, STOPWORDS))))).alias("n_stopwords"),
    )
    return d.select(*[df[c] for c in df.columns], q.alias("__q"))


def votes(q: str = "__q") -> Column:
    """The rules' votes as a string of one character a rule: +, - or 0."""
    names = "n_words word_chars n_symbols n_dup_lines n_repeat_words n_lines n_upper n_shouts n_stopwords".split()

    def over(cond: str) -> str:
        return " ".join(f"{q}.{x}" if x in names else x for x in cond.split())

    return F.concat(*[F.expr(f"CASE WHEN {over(bad)} THEN '-' WHEN {over(good)} THEN '+' ELSE '0' END") for _, good, bad in RULES])


def posteriors(patterns: DataFrame, iterations: int = ITERATIONS) -> DataFrame:
    """(votes, posterior, shares, plus) of each vote vector, from (votes, n).

    shares: of the good texts, then of each kind of bad ones; plus: each rule's probability of a
    vote + on each of these classes, if it votes. One row holds all vectors (3 ** len(RULES) at
    most, whatever the input), and the EM steps are one SQL aggregate over that row.
    """
    m = len(RULES)
    vector = ", ".join(f"CASE substr(votes, {j + 1}, 1) WHEN '+' THEN 1 WHEN '-' THEN -1 ELSE 0 END" for j in range(m))
    one = patterns.groupBy().agg(F.expr(f"array_sort(collect_list(struct(votes, cast(n as double) AS n, array({vector}) AS v))) AS p")).where("size(p) > 0")

    def numbers(values: list[float]) -> str:
        return "array(" + ", ".join(f"{v}D" for v in values) + ")"

    first = "array(" + ", ".join(numbers([(GOOD if c == 0 else RIGHT if c == j + 1 else FOOLED) for j in range(m)]) for c in range(m + 1)) + ")"
    shares = numbers([SHARE] + [(1 - SHARE) / m] * m)
    # probabilities of the classes for each vector, up to its own factor and then in all 1
    likely = f"transform(s.logs, (l, c) -> exp(aggregate(sequence(0, {m - 1}), ln(s.shares[c]), (a, j) -> a + CASE x.v[j] WHEN 1 THEN l.yes[j] WHEN -1 THEN l.no[j] ELSE 0D END)))"
    shared = f"transform(array({likely}), e -> transform(e, y -> y / aggregate(e, 0D, (a, z) -> a + z)))[0]"
    state = "named_struct('shares', {shares}, 'plus', {plus}, 'logs', transform({plus}, t -> named_struct('yes', transform(t, y -> ln(y)), 'no', transform(t, y -> ln(1 - y)))))"
    # weights of the vectors in each class, then votes + and all votes of each rule there
    weights = f"transform(sequence(0, {m}), c -> transform(sequence(0, size(p) - 1), k -> p[k].n * q[k][c]))"
    total = "aggregate(w[c], 0D, (a, y) -> a + y)"
    cast = lambda hit: f"aggregate(sequence(0, size(p) - 1), 0D, (a, k) -> a + if({hit}, w[c][k], 0D))"
    plus = f"transform({first}, (t, c) -> transform(t, (y, j) -> least({BOUNDS[1]}D, greatest({BOUNDS[0]}D, ({PRIOR} * y + {cast('p[k].v[j] = 1')}) / ({PRIOR} + {cast('p[k].v[j] <> 0')})))))"
    every = "aggregate(p, 0D, (a, x) -> a + x.n)"
    step = f"transform(array(transform(p, x -> {shared})), q -> transform(array({weights}), w -> transform(array(named_struct('a', transform(sequence(0, {m}), c -> (1 + {total}) / ({m + 1} + {every})), 'b', {plus})), u -> {state.format(shares='u.a', plus='u.b')})[0])[0])[0]"
    fit = f"aggregate(sequence(1, {iterations}), {state.format(shares=shares, plus=first)}, (s, i) -> {step})"
    # generators keep Catalyst from merging the fit into the expressions that read it many times
    model = one.select(F.explode(F.array("p")).alias("p")).select(F.explode(F.array(F.struct(F.expr(fit).alias("s"), "p"))).alias("f")).select("f.s", "f.p")
    model = model.selectExpr("s", f"transform(p, x -> struct(x.votes AS votes, {shared}[0] AS posterior)) AS r")
    return model.select("s", F.explode("r").alias("r")).select("r.votes", "r.posterior", "s.shares", "s.plus")


def judged(scored: DataFrame) -> DataFrame:
    """scored: a table cut from its lineage with __q and __votes; adds __posterior, __base, __kept."""
    table = posteriors(scored.groupBy(F.col("__votes").alias("votes")).agg(F.count("*").alias("n")))
    table = table.select(F.col("votes").alias("__votes"), F.col("posterior").alias("__posterior"))
    base = F.expr(f"__q.n_words < {MIN_WORDS} OR 100 * __q.n_repeat_words > 50 * __q.n_words")
    # at most 3 ** len(RULES) rows are broadcast
    d = scored.join(F.broadcast(table), "__votes")
    return d.withColumn("__base", base).withColumn("__kept", ~base & (F.col("__posterior") >= THRESHOLD))


def score(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, counts, base_failed, posterior, kept."""
    scored = checkpointed(counted(df.select(df[key].alias("doc_id"), df[text].alias("text"))).select("doc_id", "__q", votes().alias("__votes")))
    d = judged(scored)
    return d.select(
        "doc_id", "__q.n_words", "__q.word_chars", "__q.n_symbols", "__q.n_dup_lines", "__q.n_repeat_words",
        F.col("__base").alias("base_failed"), F.col("__kept").alias("kept"), F.col("__posterior").alias("posterior"), F.col("__votes").alias("votes"),
    )


def keep(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows of df that are kept, with df's own columns."""
    cols = df.columns
    d = df.withColumnsRenamed({c: f"__c{i}" for i, c in enumerate(cols)})
    scored = written(counted(d, f"__c{cols.index(text)}").withColumn("__votes", votes()), "quality")
    return judged(scored).where("__kept").select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(cols)])
