"""Periodic runs of words by the runs theorem.

A run is a stretch of consecutive words with smallest period q that is at least twice q long and
that no neighbouring word extends. By the runs theorem every run holds, as one of its periods,
the longest Lyndon word that starts at some place, under one order of the words or under the
opposite one. So of all words of many documents together:

1. one suffix array, by doubling: windows of a few words are sorted packed into one integer, and only
   those still equal are sorted again by what follows them. A mark ends each document; it is smaller than
   all words, and a document's number leads its windows, so suffixes of different documents never mix;
2. the longest Lyndon word at a place ends where the next smaller value of the inverse suffix array
   stands, and under the opposite order where the next greater one stands: two candidate roots a place;
3. a root is extended to both sides as far as words repeat one period apart. Extensions of less
   than CLOSE words are found by comparing; longer ones from the LCP arrays of the text and of
   its reverse, by range minima in a sparse table, and only for documents that have any.

Roots that cannot reach the wanted length go as soon as that is known, as the first root of a run is
less than a period away from its start.

Defined results: a null or empty text has no words, no runs, four nulls and the digests of an empty string;
a null key is kept, and its words stay as they are where an edit asks for the key; repeated rows give
one row each; an empty table gives an empty result; other columns never enter. One document is
worked on whole: about 150 bytes a word, whatever other documents there are.
"""

from __future__ import annotations

from collections.abc import Callable
from hashlib import sha256
from itertools import chain, compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from turnloom.llm.common import map_texts

MIN_LENGTH = 12
#: Words that are compared one by one before suffix arrays of both directions are asked.
CLOSE = 8
SCHEMA = "n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"

Edit = Callable[[object, list[bytes]], list[bytes]]


def minima(v: np.ndarray, reach: int) -> list[np.ndarray]:
    """Sparse table: level k holds the minimum of the 2 ** k values from each place on, for ranges up to reach."""
    table = [v]
    while (w := 1 << (len(table) - 1)) * 2 <= reach and w < len(table[-1]):
        table.append(np.minimum(table[-1][:-w], table[-1][w:]))
    return table


def next_smaller(v: np.ndarray, reach: int) -> np.ndarray:
    """The next place with a smaller value, of each place; len(v) where there is none within reach.

    Most are a few places away, so those are looked at first; the others descend the sparse table.
    """
    n = len(v)
    found, left = np.full(n, n), np.arange(n)
    for step in range(1, CLOSE + 1):
        left = left[left + step < n]
        hit = v[left + step] < v[left]
        found[left[hit]] = left[hit] + step
        left = left[~hit]
    if len(left):
        at, x = left + CLOSE + 1, v[left]
        for k, low in reversed(list(enumerate(minima(v, reach)))):
            skip = at < len(low)
            skip[skip] = low[at[skip]] >= x[skip]
            at[skip] += 1 << k
        ok = at < n
        ok[ok] = v[at[ok]] < x[ok]
        found[left[ok]] = at[ok]
    return found


def suffix_order(codes: np.ndarray, docs: np.ndarray, levels: list[tuple[int, np.ndarray]] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array and its inverse. codes: 0 ends each document; docs: rising numbers of documents.

    levels, if given, gets (h, ranks): equal ranks are equal windows of h words of one document.
    """
    n = len(codes)
    bits = max(1, int(codes.max()).bit_length())
    h = min(CLOSE, max(1, (62 - int(docs[-1]).bit_length()) // bits))
    padded, key = np.concatenate([codes, np.zeros(h, np.int64)]), docs.copy()
    for k in range(h):
        key = key << bits | padded[k : k + n]
    order, places = np.argsort(key), np.arange(n)
    rank, at = np.empty(n, np.int64), places
    key = key[order]
    while True:
        # the rank of a group of equal windows is the place of its first member
        new = np.concatenate([[True], key[1:] != key[:-1]])
        rank[order[at]] = at[np.maximum.accumulate(np.where(new, places[: len(at)], 0))]
        if levels is not None:
            levels.append((h, rank.copy()))
        at = at[~new | ~np.concatenate([new[1:], [True]])]
        if not len(at):
            return order, rank
        # equal windows hold no mark, so what follows them is in the same document
        tied = order[at]
        key = rank[tied] * n + rank[tied + h]
        by = np.argsort(key)
        order[at], key = tied[by], key[by]
        h *= 2


class Extension:
    """Lengths that two suffixes of one document have in common: LCP array and range minima."""

    def __init__(self, codes: np.ndarray, docs: np.ndarray, longest: int):
        levels: list[tuple[int, np.ndarray]] = []
        order, self.rank = suffix_order(codes, docs, levels)
        a, b = order[:-1].copy(), order[1:].copy()
        common = np.zeros(len(codes), np.int64)
        for h, rank in reversed(levels):
            same = rank[a] == rank[b]
            common[1:] += h * same
            a += h * same
            b += h * same
        going = np.flatnonzero(docs[a] == docs[b])
        for _ in range(levels[0][0] - 1):  # what is shorter than a packed window
            going = going[codes[a[going]] == codes[b[going]]]
            common[going + 1] += 1
            a[going] += 1
            b[going] += 1
        self.table = minima(common, longest + 1)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        low, high = np.minimum(self.rank[a], self.rank[b]) + 1, np.maximum(self.rank[a], self.rank[b])
        out = np.empty(len(a), np.int64)
        level = np.frexp((high - low + 1).astype(float))[1] - 1
        for k in np.unique(level):
            q = level == k
            out[q] = np.minimum(self.table[k][low[q]], self.table[k][high[q] - (1 << k) + 1])
        return out


def repeats(codes: np.ndarray, a: np.ndarray, b: np.ndarray, step: int) -> np.ndarray:
    """How many words from a and from b on are equal, looking CLOSE words far; step: 1 or -1."""
    out, left = np.zeros(len(a), np.int64), np.arange(len(a))
    for d in range(CLOSE):
        left = left[codes[a[left] + step * d] == codes[b[left] + step * d]]
        out[left] += 1
    return out


def runs_of(documents: list[np.ndarray], least: int = MIN_LENGTH) -> list[np.ndarray]:
    """Of each document (codes of its words, from 1 on) all its runs: start, length, period, sorted."""
    sizes = np.array([len(d) for d in documents], np.int64)
    empty = [np.empty((0, 3), np.int64)] * len(documents)
    if not sizes.sum():
        return empty
    zero = np.zeros(1, np.int64)
    # a mark before the first word, and one behind every document
    codes = np.concatenate([zero, *(x for d in documents for x in (d, zero))])
    first = np.concatenate([[1], 1 + np.cumsum(sizes + 1)])[:-1]
    docs = np.concatenate([zero, np.repeat(np.arange(len(sizes)), sizes + 1)])
    longest = int(sizes.max()) + 1
    rank = suffix_order(codes, docs)[1]
    at = np.flatnonzero(codes)
    i, j = [], []
    for v in (rank, -rank):
        end = next_smaller(v, longest)[at]
        ok = (end < len(codes)) & (codes[at] == codes[np.minimum(end, len(codes) - 1)])
        i.append(at[ok])
        j.append(end[ok])
    i, j = np.concatenate(i), np.concatenate(j)
    same = docs[i] == docs[j]  # the next greater value can be in the next document
    i, j = i[same], j[same]
    period = j - i
    wanted = np.maximum(least, 2 * period) - period
    right = repeats(codes, i, j, 1)
    near = right + period - 1 >= wanted
    near |= right == CLOSE
    i, j, period, wanted, right = i[near], j[near], period[near], wanted[near], right[near]
    left = repeats(codes, i - 1, j - 1, -1)
    near = (right == CLOSE) | (left == CLOSE) | (right + left >= wanted)
    i, j, period, wanted, right, left = i[near], j[near], period[near], wanted[near], right[near], left[near]
    far = np.unique(docs[i[(right == CLOSE) | (left == CLOSE)]])
    if len(far):
        n = sizes[far]
        part = np.concatenate([x for d in far for x in (documents[d], zero)])
        back = np.concatenate([x for d in far for x in (documents[d][::-1], zero)])
        number, begin = np.repeat(np.arange(len(far)), n + 1), np.concatenate([[0], np.cumsum(n + 1)])[:-1]
        place = np.zeros(len(documents), np.int64)
        place[far] = np.arange(len(far))
        for side, table, step in ((right, part, 0), (left, back, 1)):
            q = np.flatnonzero(side == CLOSE)
            if len(q):
                d = docs[i[q]]
                a, b = i[q] - first[d], j[q] - first[d]
                if step:  # the words before them, counted from the end
                    a, b = sizes[d] - a, sizes[d] - b
                side[q] = Extension(table, number, longest)(begin[place[d]] + a, begin[place[d]] + b)
    length = left + period + right
    ok = length >= np.maximum(least, 2 * period)
    rows = np.unique(np.column_stack([docs[i], i - left - first[docs[i]], length, period])[ok], axis=0)
    rows = rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]
    cut = np.searchsorted(rows[:, 0], np.arange(len(sizes) + 1))
    return [rows[a:b, 1:] for a, b in zip(cut[:-1], cut[1:])]


def dropped(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words some run holds after its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge)[:n] > 0


def found(documents: list[list[bytes]], least: int = MIN_LENGTH) -> list[np.ndarray]:
    """Runs of documents given as lists of words."""
    flat = pa.array(chain.from_iterable(documents), pa.binary()).dictionary_encode()
    codes = flat.indices.to_numpy().astype(np.int64) + 1
    return runs_of(np.split(codes, np.cumsum([len(words) for words in documents])[:-1]) if documents else [], least)


def collapsed(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words without the repeats of their runs."""
    return list(compress(words, ~dropped(len(words), runs))) if len(runs) else words


def report(df: DataFrame, key: str = "doc_id", text: str = "text", least: int = MIN_LENGTH, edit: Edit | None = None, texts: bool = False) -> DataFrame:
    """One row per row of df: key, number of runs, the longest one, digests of all runs and of the collapsed text.

    edit changes a document's words, given its key, before they are looked at. With texts, the
    collapsed text and all runs follow as columns.
    """

    def run(values: list[str], keys: list[object]) -> dict[str, pa.Array]:
        words = [v.encode().split() for v in values]
        if edit:
            words = [edit(k, w) for k, w in zip(keys, words)]
        rows: dict[str, list] = {c: [] for c in names}
        for w, r in zip(words, found(words, least)):
            text = b" ".join(collapsed(w, r))
            lines = "".join(f"{a},{n},{p}\n" for a, n, p in r.tolist())
            a, n, p = max(r.tolist(), key=lambda x: (x[1], -x[0], -x[2])) if len(r) else (None, None, None)
            out = [len(r), a, n, p, n and 1000 * n // p, sha256(lines.encode()).hexdigest(), sha256(text).hexdigest()]
            for c, v in zip(names, [*out, text.decode(), [dict(zip(("start", "length", "period"), x)) for x in r.tolist()]]):
                rows[c].append(v)
        kinds = [pa.int64()] * 5 + [pa.string()] * 3 + [pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))]
        return {c: pa.array(rows[c], k) for c, k in zip(names, kinds)}

    names = [c.split()[0] for c in SCHEMA.split(", ")] + (["collapsed", "runs"] if texts else [])
    more = ", collapsed string, runs array<struct<start: bigint, length: bigint, period: bigint>>" if texts else ""
    return map_texts(df, text, [key], run, SCHEMA + more, also=key)
