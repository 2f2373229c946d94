"""Byte-level BPE encoding and decoding by a rank file.

Texts are cut by the splitting pattern's state machine. Pieces that are new to a worker are
encoded together: rows of equal length classes stand in padded numpy matrices, and in every round
each row merges its leftmost pair of the lowest rank. Ranks come from a hash table of token pairs
that numpy probes for all rows at once; after a round the rows are compacted to the left, finished
rows leave the matrix, and spare columns go. In a piece too long for that, a round merges all pairs
of the lowest rank from the left on, up to the first whose new neighbours make a pair of a lower
rank still, which comes next: the same merges in the same order, many at a time. Decoding gathers
the vocabulary's bytes by id.

Defined results: null is encoded as the empty text (no ids); strings that look like special
tokens are ordinary text; repeated rows give one row each; an empty table gives an empty result;
further columns of the input are ignored.
"""

from __future__ import annotations

import base64
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from turnloom.llm import pretoken
from turnloom.llm.common import map_texts, shared_bytes

NONE = np.int32(1 << 30)
#: Lengths up to which rows share a padded matrix.
WIDTHS = [4, 8, 12, 16, 24, 32, 64, 128, 256, 512]
CELLS = 1 << 18
#: Pieces that a worker remembers with their ids.
MAX_PIECES = 300_000
_encoders: dict[str, Encoder] = {}


class Ragged:
    """Rows of different lengths in one array."""

    def __init__(self, flat: np.ndarray, lens: np.ndarray) -> None:
        self.flat, self.lens = flat, lens.astype(np.int64)
        self.starts = np.cumsum(self.lens) - self.lens
        self.size = len(flat)

    def add(self, more: list[np.ndarray]) -> None:
        """Rows behind the others; room grows by doubling, so what is there is seldom copied."""
        n, lens = self.size, np.array([len(m) for m in more], np.int64)
        self.size = n + int(lens.sum())
        if self.size > len(self.flat):
            room = np.empty(2 * self.size, self.flat.dtype)
            room[:n] = self.flat[:n]
            self.flat = room
        self.flat[n : self.size] = np.concatenate(more) if more else 0
        self.lens = np.concatenate([self.lens, lens])
        self.starts = np.concatenate([self.starts, n + np.cumsum(lens) - lens])

    def take(self, rows: np.ndarray) -> np.ndarray:
        """The rows one after another."""
        lens = self.lens[rows]
        shift = self.starts[rows] - (np.cumsum(lens) - lens)
        at = np.repeat(shift, lens)
        at += np.arange(len(at))
        return self.flat[at]


class Encoder:
    def __init__(self, raw: bytes) -> None:
        lines = [x.split() for x in raw.splitlines() if x]
        self.rank = {base64.b64decode(a): int(b) for a, b in lines}
        n = max(self.rank.values()) + 1
        if n > 1 << 16:
            raise ValueError("ranks of more than 16 bits")
        words = [b""] * n
        for w, r in self.rank.items():
            words[r] = w
        self.byte_id = np.array([self.rank[bytes([b])] for b in range(256)], np.int32)
        self.words = Ragged(np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words]))
        digits = [b"%d," % i for i in range(n)]
        self.digits = Ragged(np.frombuffer(b"".join(digits), np.uint8), np.array([len(d) for d in digits]))
        pairs = [(self.rank[w[:i]], self.rank[w[i:]], r) for w, r in self.rank.items() for i in range(1, len(w)) if w[:i] in self.rank and w[i:] in self.rank]
        self._hash(np.array(pairs, np.int64))
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.known = Ragged(np.zeros(0, np.int32), np.zeros(0))

    def _hash(self, pairs: np.ndarray) -> None:
        """An entry: 32 bits of pair, 17 of rank; -1 is free."""
        self.bits = int(len(pairs) * 3).bit_length()
        self.table = np.full(1 << self.bits, -1, np.int64)
        keys = pairs[:, 0] << 16 | pairs[:, 1]
        entries = keys << 17 | pairs[:, 2]
        at = self._slot(keys)
        while len(at):  # of all that want a free slot, one gets it and the others go on
            free = self.table[at] < 0
            self.table[at[free]] = entries[free]
            left = self.table[at] != entries
            at, entries = (at[left] + 1) & (len(self.table) - 1), entries[left]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (((keys & 0xFFFFFFFF).astype(np.uint32) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - self.bits)).astype(np.int64)

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the tokens that pairs make; NONE where there is none or a token is below 0."""
        keys = a.astype(np.int64) << 16 | b
        at = self._slot(keys)
        held = self.table[at]
        odd = np.flatnonzero((held >= 0) & ((held >> 17) != keys))
        while len(odd):
            at[odd] = (at[odd] + 1) & (len(self.table) - 1)
            held[odd] = self.table[at[odd]]
            odd = odd[(held[odd] >= 0) & ((held[odd] >> 17) != keys[odd])]
        return np.where((held >= 0) & (a >= 0) & (b >= 0), held & 0x1FFFF, NONE).astype(np.int32)

    def _matrix(self, pieces: list[bytes], width: int) -> list[np.ndarray]:
        """Ids of pieces of at most width bytes."""
        n = len(pieces)
        out: list[np.ndarray] = [None] * n
        lens = np.array([len(p) for p in pieces])
        ids = np.full((n, width), -1, np.int32)
        ids[np.arange(width)[None, :] < lens[:, None]] = self.byte_id[np.frombuffer(b"".join(pieces), np.uint8)]
        ranks = np.full((n, width), NONE, np.int32)
        ranks[:, :-1] = self.pair_ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width - 1)
        rows = np.arange(n)
        while len(rows):
            at = ranks.argmin(1)
            best = ranks[np.arange(len(rows)), at]
            done = best == NONE
            if done.any():
                for r, i, m in zip(rows[done].tolist(), ids[done], lens[done].tolist()):
                    out[r] = i[:m].copy()
                live = ~done
                rows, lens, at, best = rows[live], lens[live], at[live], best[live]
                w = int(lens.max()) if len(lens) else 1
                ids, ranks = ids[live, :w], ranks[live, :w]
                if not len(rows):
                    break
            k = np.arange(len(rows))
            cols = np.arange(ids.shape[1])
            # compaction: what stands right of the merged pair moves one place to the left
            src = np.minimum(cols[None, :] + (cols[None, :] > at[:, None]), ids.shape[1] - 1)
            ids = np.take_along_axis(ids, src, 1)
            ranks = np.take_along_axis(ranks, src, 1)
            lens -= 1
            ids[k, at] = best
            ids[k, lens] = -1
            ranks[k, lens] = NONE
            right = ids[k, np.minimum(at + 1, ids.shape[1] - 1)]
            ranks[k, at] = np.where(at + 1 < lens, self.pair_ranks(best, right), NONE)
            left = np.flatnonzero(at > 0)
            ranks[left, at[left] - 1] = self.pair_ranks(ids[left, at[left] - 1], best[left])
        return out

    def _long(self, piece: bytes) -> np.ndarray:
        """Ids of one long piece."""
        ids = self.byte_id[np.frombuffer(piece, np.uint8)].copy()
        ranks = self.pair_ranks(ids[:-1], ids[1:])
        while len(ids) > 1:
            best = int(ranks.min())
            if best == NONE:
                break
            at = np.flatnonzero(ranks == best)
            # of pairs that overlap, the first, the third and so on
            run = np.cumsum(np.concatenate([[True], np.diff(at) > 1]))
            first = at[np.searchsorted(run, run)]
            at = at[(at - first) % 2 == 0]
            # the pairs that each merge makes at once: with what stands left after the merges before it, and right
            merged = np.full(len(at), best, np.int32)
            before = np.where(at > 0, ids[at - 1], -1)
            before[1:][at[1:] == at[:-1] + 2] = best
            after = np.where(at + 2 < len(ids), ids[np.minimum(at + 2, len(ids) - 1)], -1)
            lower = np.flatnonzero((self.pair_ranks(before, merged) < best) | (self.pair_ranks(merged, after) < best))
            if len(lower):
                at = at[: lower[0] + 1]
            ids[at] = best
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids = ids[keep]
            at -= np.arange(len(at))
            # a pair that was merged away is that of the token after it
            ranks = np.concatenate([ranks, [NONE]])[keep][:-1]
            touched = np.unique(np.concatenate([at - 1, at]))
            touched = touched[(touched >= 0) & (touched + 1 < len(ids))]
            ranks[touched] = self.pair_ranks(ids[touched], ids[touched + 1])
        return ids

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        out: list[np.ndarray] = [None] * len(pieces)
        by_width: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            r = self.rank.get(p)
            if r is not None:
                out[i] = np.array([r], np.int32)
            elif len(p) > WIDTHS[-1]:
                out[i] = self._long(p)
            else:
                by_width.setdefault(next(w for w in WIDTHS if len(p) <= w), []).append(i)
        for width, rows in by_width.items():
            step = max(1, CELLS // width)
            for a in range(0, len(rows), step):
                some = rows[a : a + step]
                for i, ids in zip(some, self._matrix([pieces[i] for i in some], width)):
                    out[i] = ids
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and how many each text has."""
        if len(self.index) > MAX_PIECES:
            self.forget()
        flat, starts = pretoken.code_points(texts)
        at = pretoken.cuts(flat)
        joined = "\0".join([*texts, ""])
        ends = np.append(at[1:], len(flat))
        real = flat[at] != 0x110000
        at, ends = at[real], ends[real]
        pieces = [joined[a:b] for a, b in zip(at.tolist(), ends.tolist())]
        new = list(set(pieces) - self.index.keys())
        if new:
            got = self.encode_pieces([p.encode() for p in new])
            n = len(self.index)
            self.index.update(zip(new, range(n, n + len(new))))
            self.known.add(got)
        rows = np.fromiter(map(self.index.__getitem__, pieces), np.int64, len(pieces))
        total = np.concatenate([[0], np.cumsum(self.known.lens[rows])])
        first = np.append(np.searchsorted(at, starts), len(at))
        return self.known.take(rows), np.diff(total[first])

    def decode(self, ids: np.ndarray, lens: np.ndarray) -> list[bytes]:
        """The bytes of each run of ids."""
        data = self.words.take(ids).tobytes()
        to = np.concatenate([[0], np.cumsum(self.words.lens[ids])])[np.concatenate([[0], np.cumsum(lens)])].tolist()
        return [data[a:b] for a, b in zip(to, to[1:])]

    def decimal(self, ids: np.ndarray, lens: np.ndarray) -> list[bytes]:
        """Each run of ids in decimal, joined by commas."""
        data = self.digits.take(ids).tobytes()
        to = np.concatenate([[0], np.cumsum(self.digits.lens[ids])])[np.concatenate([[0], np.cumsum(lens)])].tolist()
        return [data[a : max(a, b - 1)] for a, b in zip(to, to[1:])]


def encoder(raw: bytes) -> Encoder:
    key = sha256(raw).hexdigest()
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(raw)
    return _encoders[key]


def round_trip(df: DataFrame, ranks_path: str, keep: list[str], text: str = "text", ids: bool = True) -> DataFrame:
    """keep, then n_tokens, ids_sha256, decoded_sha256 and (if ids) input_ids of every whole text."""
    raw = shared_bytes(df.sparkSession, ranks_path)

    def run(texts: list[str]) -> dict[str, pa.Array]:
        e = encoder(raw.value)
        flat, lens = e.encode(texts)
        hexed = [[sha256(x).hexdigest() for x in of(flat, lens)] for of in (e.decimal, e.decode)]
        out = {"n_tokens": pa.array(lens.astype(np.int64)), "ids_sha256": pa.array(hexed[0], pa.string()), "decoded_sha256": pa.array(hexed[1], pa.string())}
        if ids:
            to = np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)
            out["input_ids"] = pa.ListArray.from_arrays(pa.array(to), pa.array(flat.astype(np.int32)))
        return out

    schema = "n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", input_ids array<int>" * ids
    return map_texts(df, text, keep, run, schema)


def decode(df: DataFrame, ranks_path: str, keep: list[str], ids: str = "input_ids") -> DataFrame:
    """keep and decoded (binary) of every row's ids; null ids decode to nothing."""
    from turnloom.llm.common import prepare

    prepare(df.sparkSession)
    raw = shared_bytes(df.sparkSession, ranks_path)
    src = df.select(*[df[c] for c in keep], df[ids].cast("array<int>").alias("__ids"))

    def run(batches):
        for b in batches:
            rows = [x or [] for x in b.column("__ids").to_pylist()]
            flat = np.array([i for r in rows for i in r], np.int64)
            got = encoder(raw.value).decode(flat, np.array([len(r) for r in rows], np.int64))
            yield pa.RecordBatch.from_pydict({c: b.column(c) for c in keep} | {"decoded": pa.array(got, pa.binary())})

    schema = ", ".join(f"`{c}` {t}" for c, t in src.dtypes if c in keep)
    return src.mapInArrow(run, f"{schema}, decoded binary")
