"""Benchmark decontamination by one Aho-Corasick automaton over normalised items.

Texts are normalised to their words, single blanks between and around them. Every window of ten
consecutive item words is a pattern " w1 ... w10 "; an item of fewer words is one pattern. The
automaton scans each document's normalised text once; a match's end gives the words it covers,
and word offsets map back to the original text.

The patterns are sent to the executors only while the items' texts and ids have at most
MAX_ITEM_BYTES together (counted first, equal rows once, items without words not at all). A larger
benchmark is read in parts and dealt into groups by running totals, none larger than that unless
one item alone is; each group has its automaton and its pass, and the hits of the passes are united.

Defined results: null or wordless texts have no words and no hits; null or wordless items have no
windows; items with equal texts or ids are each counted by their id; a null item_id counts as the
empty string; repeated documents give one row each; an empty table of items gives no hits; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.llm.common import map_texts

WINDOW = 10
MAX_ITEM_BYTES = 4 << 20
#: Bytes of words stay (A-Z in lower case), all others become blanks; bytes over 127 are of words.
_TO = bytes(b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
#: A character of a word.
_WORD = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]"
_held: dict[str, tuple] = {}


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TO).split()


def word_spans(text: str) -> list[tuple[int, int]]:
    """Character offsets in the original text of each word of words_of(text)."""
    raw = text.encode()
    at = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)  # bytes that start a character
    word = np.frombuffer(raw.translate(_TO), np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate([[0], word.view(np.int8), [0]])))
    to = np.searchsorted(at, edge)
    return list(zip(to[::2].tolist(), to[1::2].tolist()))


def patterns_of(items: list[tuple[str, str | None]]) -> dict[str, tuple[int, tuple[str, ...]]]:
    """Each pattern with its number of words and the ids of the items that have it."""
    found: dict[str, tuple[int, set[str]]] = {}
    for item_id, text in items:
        w = words_of(text)
        if not w:
            continue
        n = min(WINDOW, len(w))
        for i in range(len(w) - n + 1):
            p = b" " + b" ".join(w[i : i + n]) + b" "
            found.setdefault(p.decode(), (n, set()))[1].add(item_id)
    return {p: (n, tuple(sorted(ids))) for p, (n, ids) in found.items()}


def automaton(items: list[tuple[str, str | None]]) -> ahocorasick.Automaton | None:
    patterns = patterns_of(items)
    if not patterns:
        return None
    a = ahocorasick.Automaton()
    for p, (n, ids) in patterns.items():
        a.add_word(p, (n, ids))
    a.make_automaton()
    return a


def scan(a: ahocorasick.Automaton | None, text: str | None) -> tuple[int, list[tuple[int, int]], set[str]]:
    """Number of words, the word ranges [start, end) that hits cover (apart from each other), items with hits."""
    w = words_of(text)
    ranges: list[tuple[int, int]] = []
    items: set[str] = set()
    if a is None or not w:
        return len(w), ranges, items
    line = (b" " + b" ".join(w) + b" ").decode()
    ends = None
    for at, (n, ids) in a.iter(line):
        if ends is None:  # positions of the blanks behind the words
            sizes = np.fromiter((len(x.decode()) for x in w), np.int64, len(w))
            ends = np.cumsum(sizes + 1)
        k = int(np.searchsorted(ends, at)) + 1
        ranges.append((k - n, k))
        items.update(ids)
    return len(w), united(ranges), items


def united(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges that overlap or touch made one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _groups(items: DataFrame, key: str, text: str) -> Iterator[list[tuple[str, str]]]:
    """Items with words in groups of bounded size; only one group's texts are held at a time."""
    rows = items.select(F.coalesce(items[key].cast("string"), F.lit("")).alias("k"), items[text].alias("t")).where(F.col("t").rlike(_WORD)).distinct()
    size = F.octet_length("k") + F.octet_length("t")
    n = 1 + (rows.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]) // MAX_ITEM_BYTES
    group, held = [], 0
    for r in rows.repartition(n, "k", "t").toLocalIterator() if n > 1 else rows.collect():
        more = len(r.k.encode()) + len(r.t.encode())
        if group and held + more > MAX_ITEM_BYTES:
            yield group
            group, held = [], 0
        group.append((r.k, r.t))
        held += more
    yield group


def hits(df: DataFrame, items: list[tuple[str, str]], keep: list[str], text: str = "text") -> DataFrame:
    """keep, n_words, ranges and items (ids) of every row's whole text.

    ranges: hit words [s, e), and the characters [start, end) of the original text that they stand in.
    """
    spark = df.sparkSession
    sent = spark.sparkContext.broadcast(items)  # at most MAX_ITEM_BYTES of texts and ids, or one item
    name = sha256(repr(items).encode()).hexdigest()

    def run(texts: list[str]) -> dict[str, pa.Array]:
        if name not in _held:
            _held.clear()
            _held[name] = (automaton(sent.value),)
        a = _held[name][0]
        got = [scan(a, t) for t in texts]
        rows = []
        for t, (_, ranges, _) in zip(texts, got):
            at = word_spans(t) if ranges else []
            rows.append([{"s": x, "e": y, "start": at[x][0], "end": at[y - 1][1]} for x, y in ranges])
        return {
            "n_words": pa.array([g[0] for g in got], pa.int64()),
            "ranges": pa.array(rows, pa.list_(pa.struct([(c, pa.int64()) for c in ("s", "e", "start", "end")]))),
            "items": pa.array([sorted(g[2]) for g in got], pa.list_(pa.string())),
        }

    return map_texts(df, text, keep, run, f"n_words bigint, ranges {_RANGES}, items array<string>")


_RANGES = "array<struct<s:bigint,e:bigint,start:bigint,end:bigint>>"
#: SQL: ranges of several passes in order, those that overlap or touch made one.
_UNITED = f"""aggregate(array_sort(ranges), CAST(array() AS {_RANGES}), (a, r) -> CASE WHEN r.s <= try_element_at(a, -1).e
    THEN concat(slice(a, 1, size(a) - 1), array(named_struct('s', try_element_at(a, -1).s, 'e', greatest(try_element_at(a, -1).e, r.e), 'start', try_element_at(a, -1).start, 'end', greatest(try_element_at(a, -1).end, r.end))))
    ELSE concat(a, array(r)) END)"""


def report(df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans of every row of df.

    spans: the characters [start, end) of the original text that runs of hit words stand in.
    """
    out = None
    for group in _groups(benchmark, item, item_text):
        if out is None:
            src = df.select(df[key].alias("doc_id"), df[text].alias("text"))
            out = hits(src, group, ["doc_id", "text"])
        else:
            prev = out.withColumnsRenamed({"n_words": "n", "ranges": "r", "items": "i"})
            got = hits(prev, group, ["doc_id", "text", "r", "i"])
            out = got.select("doc_id", "text", "n_words", F.concat("r", "ranges").alias("ranges"), F.concat("i", "items").alias("items"))
    ids = F.array_sort(F.array_distinct("items"))
    out = out.withColumn("runs", F.expr(_UNITED))
    return out.select(
        "doc_id", "n_words", F.expr("aggregate(runs, 0L, (a, r) -> a + r.e - r.s)").alias("n_hit"), F.size(ids).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (F.size("ranges") > 0).alias("contaminated"), F.transform("runs", lambda r: F.struct(r.start, r.end)).alias("spans"),
    )


def keep_clean(df: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of df without any benchmark window, with df's own columns."""
    cols = df.columns
    out = df.withColumnsRenamed({c: f"__c{i}" for i, c in enumerate(cols)})
    at = f"__c{cols.index(text)}"
    keep = [f"__c{i}" for i in range(len(cols))]
    for group in _groups(benchmark, item, item_text):
        out = hits(out, group, keep, at).where("size(ranges) = 0").select(*keep)
    return out.withColumnsRenamed({f"__c{i}": c for i, c in enumerate(cols)})
