"""Capture blobs: engine answers as rows of bytes, and the fold of deltas into one blob a segment.

All of it is SQL functions. An answer's integers are read as hexadecimal digits: a value fits one
byte if its other bytes are zero, so a pattern tells whether all fit and drops what is zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a NumPy file starts with, in hexadecimal digits, and its integer types with their widths.
_NPY = "934E554D5059"
_WIDTHS = {"|u1": 1, "<u1": 1, "|i1": 1, "<i1": 1, "<u2": 2, "<i2": 2, "<u4": 4, "<i4": 4, "<u8": 8, "<i8": 8}
BLOB = "struct<data:string,rows:bigint,cols:bigint,dtype:string,start:bigint>"


def _bytes(digits: Column, width: Column | int) -> Column:
    """Little-endian integers of width bytes, as one byte each; null if one does not fit."""
    zeros = F.repeat(F.lit("00"), F.lit(width) - 1 if isinstance(width, int) else width - 1)
    fits = F.regexp_like(digits, F.concat(F.lit("^(..("), zeros, F.lit("))*$")))
    return F.when(fits, F.regexp_replace(digits, F.concat(F.lit("(..)"), zeros), F.lit("$1")))


def _blob(digits: Column, n_rows: Column, cols: Column, start: Column) -> Column:
    whole = digits.isNotNull() & (n_rows > 0) & (cols > 0) & (F.length(digits) == 2 * n_rows * cols)
    return F.when(whole, F.struct(F.base64(F.unhex(digits)).alias("data"), n_rows.cast("bigint").alias("rows"), cols.cast("bigint").alias("cols"), F.lit("uint8").alias("dtype"), start.cast("bigint").alias("start"))).cast(BLOB)


def pack(encoded: Column, n_prompt: Column, n_completion: Column, start: Column | None = None, cols: Column | None = None) -> Column:
    """Blob of an answer of base64 little-endian int32 values; null if it does not line up.

    It has one row for each token from start on but the last one. cols is the stored blob's width,
    if one is stored; an answer from row 0 on is then cut to the rows from start.
    """
    start = F.lit(0) if start is None else F.coalesce(start, F.lit(0))
    known = F.lit(None).cast("bigint") if cols is None else cols.cast("bigint")
    every = (n_prompt + n_completion - 1).cast("bigint")
    wanted = every - start
    digits = _bytes(F.hex(F.try_to_binary(encoded, F.lit("base64"))), 4)
    size = F.length(digits) / 2
    from_first = (start > 0) & (size == every * known)
    kept = F.when(from_first, F.substr(digits, (start * known * 2 + 1).cast("int"))).otherwise(digits)
    width = F.coalesce(known, F.when(wanted > 0, (F.length(kept) / 2 / wanted).cast("bigint")))
    return _blob(kept, wanted, width, start)


def pack_npy(encoded: Column, n_prompt: Column, n_completion: Column, start: Column | None = None, cols: Column | None = None) -> Column:
    """Blob of an answer that is a base64 NumPy file of integers (tokens, layers[, choices]); null if it does not line up."""
    start = F.lit(0) if start is None else F.coalesce(start, F.lit(0))
    known = F.lit(None).cast("bigint") if cols is None else cols.cast("bigint")
    digits = F.hex(F.try_to_binary(encoded, F.lit("base64")))
    major = F.conv(F.substring(digits, 13, 2), 16, 10).cast("int")
    # the header's length is a little-endian number of two bytes, or of four from version 2 on
    at = F.when(major == 1, 10).otherwise(12)
    turned = F.concat(*[F.substr(digits, (at * 2 - 1 - 2 * i).cast("int"), F.lit(2)) for i in range(2)])
    long = F.concat(*[F.substring(digits, 23 - 2 * i, 2) for i in range(4)])
    size = F.conv(F.when(major == 1, turned).otherwise(long), 16, 10).cast("int")
    head = F.decode(F.unhex(F.substr(digits, at * 2 + 1, size * 2)), "ISO-8859-1")
    width = F.create_map(*[F.lit(x) for kv in _WIDTHS.items() for x in kv])[F.regexp_extract(head, "'descr': *'([^']*)'", 1)]
    shape = F.transform(F.split(F.regexp_extract(head, r"'shape': *\(([0-9]+, *[0-9]+(?:, *[0-9]+)?)\)", 1), ", *"), lambda x: x.try_cast("bigint"))
    n = F.get(shape, F.lit(0))
    each = F.get(shape, F.lit(1)) * F.coalesce(F.get(shape, F.lit(2)), F.lit(1))
    data = _bytes(F.substr(digits, (at + size) * 2 + 1), width)
    good = digits.startswith(_NPY) & head.contains("'fortran_order': False") & (F.length(data) == 2 * n * each)
    every = (n_prompt + n_completion - 1).cast("bigint")
    kept = F.when((start > 0) & (n == every), F.substr(data, (start * each * 2 + 1).cast("int"))).otherwise(data)
    return F.when(good & F.coalesce(known == each, F.lit(True)), _blob(kept, every - start, each, start))


KEYS = ["session_id", "agent_id", "segment_index"]


_START = "named_struct('rows', 0L, 'cols', 0L, 'kept', CAST(NULL AS array<struct<ordinal:bigint,first:bigint>>), 'accepted', 0L, 'dropped', 0L)"
#: What becomes of the stored sizes s with the next blob x: extended, replaced, or left as they are.
_STEP = """CASE WHEN s.kept IS NOT NULL AND x.start > 0 AND x.start = s.rows AND x.cols = s.cols
        THEN named_struct('rows', s.rows + x.rows, 'cols', s.cols, 'kept', concat(s.kept, array(named_struct('ordinal', x.ordinal, 'first', s.rows))), 'accepted', s.accepted + 1L, 'dropped', s.dropped)
    WHEN x.start = 0 AND (s.kept IS NULL OR x.rows >= s.rows)
        THEN named_struct('rows', x.rows, 'cols', x.cols, 'kept', array(named_struct('ordinal', x.ordinal, 'first', 0L)), 'accepted', s.accepted + 1L, 'dropped', s.dropped)
    ELSE named_struct('rows', s.rows, 'cols', s.cols, 'kept', s.kept, 'accepted', s.accepted, 'dropped', s.dropped + 1L) END"""


def extents(blobs: DataFrame) -> DataFrame:
    """Per segment: rows, cols, accepted, dropped and kept (ordinal and first row of each blob that counts).

    A delta that starts where the stored rows end, with the same columns, is appended; a blob from row 0
    with at least as many rows replaces; others are dropped. Only sizes are folded, in order of ordinals.
    """
    piece = F.struct(*[F.col(c).cast("bigint").alias(c) for c in ("ordinal", "rows", "cols", "start")])
    g = blobs.groupBy(*KEYS).agg(F.array_sort(F.collect_list(piece)).alias("pieces"))
    return g.withColumn("s", F.expr(f"aggregate(pieces, {_START}, (s, x) -> {_STEP})")).select(*KEYS, "s.rows", "s.cols", "s.accepted", "s.dropped", "s.kept")


def chunks(blobs: DataFrame) -> DataFrame:
    """The captures of all segments as chunks (keys, chunk, first row, rows, cols, bytes): one row a blob that counts, whatever a segment's length."""
    e = extents(blobs).select(*[F.col(k).alias(f"__{k}") for k in KEYS], F.posexplode("kept").alias("chunk", "k"))
    same = [blobs[k].eqNullSafe(e[f"__{k}"]) for k in KEYS]
    d = blobs.join(e, [*same, blobs["ordinal"] == e["k.ordinal"]])
    return d.select(*[blobs[k] for k in KEYS], "chunk", F.col("k.first").alias("first"), blobs["rows"].cast("bigint").alias("rows"), blobs["cols"].cast("bigint").alias("cols"), F.unbase64(blobs["data"]).alias("bytes"))


def rows_between(pieces: DataFrame, low: Column, high: Column) -> DataFrame:
    """chunks cut to the rows from low up to high (without it); chunks outside go, and a filter on first and rows can reach a scan."""
    begin, end = F.greatest(low.cast("bigint"), F.col("first")), F.least(high.cast("bigint"), F.col("first") + F.col("rows"))
    d = pieces.withColumns({"__a": begin, "__b": end}).where("__a < __b")
    cut = F.substring(F.col("bytes"), (F.col("__a") - F.col("first")) * F.col("cols") + 1, (F.col("__b") - F.col("__a")) * F.col("cols"))
    return d.select(*KEYS, "chunk", F.col("__a").alias("first"), (F.col("__b") - F.col("__a")).alias("rows"), "cols", cut.alias("bytes"))


def fold(blobs: DataFrame) -> DataFrame:
    """One capture a segment as one blob, with its rows, cols, and how many blobs were accepted and dropped. Where a segment
    can be long, chunks() gives the same bytes in rows of the blobs' size."""
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "bytes"))), lambda x: F.hex(x["bytes"])), "")
    data = chunks(blobs).groupBy(*KEYS).agg(F.base64(F.unhex(whole)).alias("data"))
    e = extents(blobs).drop("kept").withColumnsRenamed({k: f"__{k}" for k in KEYS})
    d = data.join(e, [data[k].eqNullSafe(e[f"__{k}"]) for k in KEYS], "right")
    return d.select(*[F.col(f"__{k}").alias(k) for k in KEYS], "data", "rows", "cols", "accepted", "dropped")
