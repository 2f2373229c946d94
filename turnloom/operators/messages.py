"""Messages as raw JSON: canonical forms, normal forms, and histories compared by digests of their prefixes.

All of it is built-in functions. Variants keep an object's keys in order, so their text is canonical but
for numbers; fractions are written as doubles first, so that 1, 1.0 and true stay three values.

A history is compared with what is stored through one equi-join: each message's digest is tied to its place,
and a running exclusive or over a conversation gives the digest of every prefix. Equal prefixes of two
conversations are equal rows, so the longest common one is a count, without comparing places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Roles of messages, those that can follow an echoed answer, and how often a turn is replayed.
ROLES = ("system", "developer", "user", "assistant", "tool")
GAP_ROLES = ("tool", "user", "system")
MAX_REPLAYS = 4


def _doubles(text: Column) -> Column:
    """JSON text in which fractions have an exponent and no zero has a sign; null where integers have over 38 digits.

    Escapes are hidden while the text is cut at quotation marks: every second piece is outside strings.
    """
    hidden = F.replace(F.replace(text, F.lit("\\\\"), F.lit("\u0002")), F.lit('\\"'), F.lit("\u0003"))
    pieces = F.split(hidden, '"', -1)
    number = lambda x: F.regexp_replace(F.regexp_replace(x, r"-(0++(?:\.0++)?(?:[eE][+-]?[0-9]++)?)(?![.0-9eE])", "$1"), r"([0-9]\.[0-9]++)(?![eE])", "$1e0")
    outside = F.transform(pieces, lambda x, i: F.when(i % 2 == 0, number(x)).otherwise(x))
    long = F.exists(F.transform(pieces, lambda x, i: (i % 2 == 0) & x.rlike("[0-9]{39}")), lambda x: x)
    shown = F.replace(F.replace(F.array_join(outside, '"'), F.lit("\u0003"), F.lit('\\"')), F.lit("\u0002"), F.lit("\\\\"))
    return F.when(~text.rlike("[\u0002\u0003]") & ~long, shown)


def exact(text: Column) -> Column:
    """A JSON text as a variant whose numbers keep their kind; null if it is none, names a key twice or has integers of over 38 digits.

    The reader stops behind the first whole value. What is the only value both of a list and of an object has nothing behind it.
    """

    def sole(t: Column) -> Column:
        listed = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), t, F.lit("]"))), "$", "array<variant>")
        return F.when(F.size(listed) == 1, F.try_variant_get(F.try_parse_json(F.concat(F.lit('{"v":'), t, F.lit("}"))), "$.v", "variant"))

    return F.transform(F.array(_doubles(text)), sole)[0]


def canonical(text: Column) -> Column:
    """One text for all JSON texts of equal values and types: keys in order, no blanks, escapes read."""
    return F.to_json(exact(text))


def same_json(a: Column, b: Column) -> Column:
    """Whether two JSON texts have equal values of equal types; what is no JSON equals nothing."""
    return F.coalesce(canonical(a) == canonical(b), F.lit(False))


def message(raw: Column) -> Column:
    """Struct of role, content, error and digest of one message.

    Text parts are joined by line ends; an assistant's missing or null content beside calls is the empty
    text. error: object, role, content or parts; such a message has no digest. The digest is exact in types.
    """
    fields = F.try_variant_get(exact(raw), "$", "map<string,variant>")
    kind = lambda v: F.coalesce(F.schema_of_variant(v), F.lit(""))
    at = lambda v, path: F.try_variant_get(v, path, "variant")
    as_text = lambda v, path="$": F.when(kind(at(v, path)) == "STRING", F.try_variant_get(v, path, "string"))
    part = lambda p: F.when(kind(p) == "STRING", as_text(p)).when(kind(p).startswith("OBJECT") & F.coalesce(as_text(p, "$.type") == "text", F.lit(False)), as_text(p, "$.text"))

    def read(m: Column) -> Column:
        content, role = m["content"], as_text(m["role"])
        of = kind(content)
        parts = F.when(of.startswith("ARRAY"), F.transform(F.try_variant_get(content, "$", "array<variant>"), part))
        bare = of.isin("", "VOID")
        calls = F.array_contains(F.map_keys(m), "tool_calls") & F.coalesce(role == "assistant", F.lit(False))
        text = F.when(of == "STRING", as_text(content)).when(parts.isNotNull(), F.array_join(parts, "\n")).when(bare & calls, F.lit(""))
        error = F.when(m.isNull(), "object").when(~F.coalesce(role.isin(*ROLES), F.lit(False)), "role").when(~bare & (of != "STRING") & parts.isNull(), "content").when(F.exists(parts, lambda p: p.isNull()), "parts")
        given = F.when(text.isNotNull(), F.concat(F.lit("text "), text)).otherwise(of)
        rest = F.to_json(F.map_filter(m, lambda k, _: k != "content"))
        return F.struct(role.alias("role"), F.when(error.isNull(), text).alias("content"), error.alias("error"), F.when(error.isNull(), F.sha2(F.concat_ws("\u0001", rest, given), 256)).alias("digest"))

    # bound once: each use would parse the text again
    return F.transform(F.array(fields), read)[0]


def normalized(messages: DataFrame, raw: str = "raw") -> DataFrame:
    """messages with role, content, error and digest in place of raw."""
    return messages.withColumn("__m", message(F.col(raw))).select(*[c for c in messages.columns if c != raw], "__m.role", "__m.content", "__m.error", "__m.digest")


def prefixes(messages: DataFrame, key: str) -> DataFrame:
    """messages (key, place from 0, digest) with prefix: the digest of all messages up to this one; null behind a message without a digest."""
    upto = Window.partitionBy(key).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    half = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), "place", "digest")).over(upto)
    whole = (F.count("digest").over(upto) == F.col("place") + 1) & (F.count("*").over(upto) == F.col("place") + 1)
    return messages.withColumn("prefix", F.when(whole, F.struct(half(1).alias("a"), half(2).alias("b"))))


def judge(requests: DataFrame, asked: DataFrame, states: DataFrame, stored: DataFrame, max_replays: int = MAX_REPLAYS) -> DataFrame:
    """Per request: request, n_messages, n_common, verdict, and replay (which replay of its turn it is).

    requests: request, stream, ordinal, segment, purpose, effort. asked: request, place, raw. states: stream,
    segment, purpose, effort, n_messages of each stream's last committed turn. stored: stream, place, raw.

    A request whose messages are those of the committed turn, in its segment, is a retry: replayed so many
    times, and refused if its purpose or effort is another. Others of that segment must repeat all of these messages, echo the answer and go on
    with tools, users or the system. Verdicts: invalid (a message is refused), opening, replay, exhausted,
    purpose, short, modified (at place n_common), echo, role, effort, ok.
    """
    a = normalized(asked)
    mine = prefixes(a, "request").select("request", "place", "role", "error", "prefix")
    theirs = prefixes(normalized(stored), "stream").select("stream", F.col("prefix").alias("theirs"), F.col("place").alias("at"))
    state = states.select("stream", F.col("segment").alias("s_segment"), F.col("purpose").alias("s_purpose"), F.col("effort").alias("s_effort"), F.col("n_messages").alias("n_prev"))
    r = requests.join(state, "stream", "left")
    rows = mine.join(r.select("request", "stream", "n_prev"), "request")
    rows = rows.join(theirs, (rows["stream"] == theirs["stream"]) & (rows["place"] == theirs["at"]) & (rows["prefix"] == theirs["theirs"]) & (rows["place"] < rows["n_prev"]), "left").drop(theirs["stream"])
    found = rows.groupBy("request").agg(
        F.count("*").alias("n_messages"), F.count("at").alias("n_common"), F.coalesce(F.bool_or(F.col("error").isNotNull()), F.lit(False)).alias("invalid"),
        F.coalesce(F.bool_or((F.col("place") == F.col("n_prev")) & (F.col("role") == "assistant")), F.lit(False)).alias("echoed"),
        F.coalesce(F.bool_or((F.col("place") > F.col("n_prev")) & ~F.coalesce(F.col("role").isin(*GAP_ROLES), F.lit(False))), F.lit(False)).alias("strange"),
    )
    d = r.join(found, "request", "left").fillna({"n_messages": 0, "n_common": 0, "invalid": False, "echoed": False, "strange": False})
    here = F.coalesce(F.col("segment") == F.col("s_segment"), F.lit(False))
    again = here & (F.col("n_messages") == F.col("n_prev")) & (F.col("n_common") == F.col("n_prev")) & ~F.col("invalid")
    effort, purpose = F.col("effort").eqNullSafe(F.col("s_effort")), F.col("purpose").eqNullSafe(F.col("s_purpose"))
    serves = again & effort & purpose
    nth = F.row_number().over(Window.partitionBy("stream", serves).orderBy("ordinal")).cast("bigint")
    d = d.withColumn("replay", F.when(serves, nth))
    verdict = (
        F.when(F.col("invalid"), "invalid").when(~here, "opening").when(again & ~purpose, "purpose").when(again & ~effort, "effort").when(again, F.when(F.col("replay") <= max_replays, "replay").otherwise("exhausted"))
        .when(~effort, "effort").when(F.col("n_messages") < F.col("n_prev") + 2, "short").when(F.col("n_common") < F.col("n_prev"), "modified").when(~F.col("echoed"), "echo").when(F.col("strange"), "role").otherwise("ok")
    )
    return d.select("request", "n_messages", "n_common", verdict.alias("verdict"), "replay")
