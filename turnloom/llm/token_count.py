"""Token counts from a tokenizer compiled to finite-state machines.

Two deterministic transducers are composed. The first is the splitting pattern (pretoken.py):
chunk maps of its states compose through a parallel prefix scan and give the cuts. The second
reads the bytes between cuts and annotates every transition with the number of tokens that the
byte adds (it can be negative: one more byte can join tokens). Its state after a prefix holds, for
every earlier position from which a vocabulary entry could still reach past the prefix, the place
in the vocabulary's trie, the last token before that position and the token count there relative
to now. Such states are finitely many. They are compiled when first met, into a hash table that
numpy reads for many chunks in lockstep; a table that outgrows MAX_STATES is emptied but for the states
that are in use. The machine begins anew at a cut, so chunks start at cuts. A piece
that is longer is chunked as well: each chunk's map from start to end state is computed for the
state that its LOOK bytes before it lead to, the maps are composed from left to right, and where
the state that arrives is another one, the maps are extended by it, for all such chunks in lockstep,
until they compose throughout.

Whichever token ends the encoding of a prefix is the only one whose pair with the last token of
the shorter prefix is stable under the merges; stable() tests it along the seam.

Defined results: null counts as empty (0 tokens); the added token's string inside a text counts
as one token, as the library does by default; repeated rows give one row each; empty tables give
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import json
from array import array
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from turnloom.llm import pretoken
from turnloom.llm.common import map_texts, shared_bytes

MAX_STATES = 1 << 18
ROW_BYTES = 512
#: Bytes ahead of a chunk inside a long piece that its first start state is guessed from.
LOOK = 64
_machines: dict[str, CountMachine] = {}


def byte_letters() -> dict[str, int]:
    """The printable letters that byte-level vocabulary files write for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class CountMachine:
    def __init__(self, raw: bytes) -> None:
        spec = json.loads(raw)
        letters = byte_letters()
        self.added = [t["content"] for t in spec["added_tokens"]]
        added = set(self.added)
        vocab = {bytes(letters[c] for c in k): v for k, v in spec["model"]["vocab"].items() if k not in added}
        ids = {k: vocab[bytes(letters[c] for c in k)] for k in spec["model"]["vocab"] if k not in added}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for r, m in enumerate(spec["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            pair = ids[a], ids[b]
            self.rank[pair] = r
            self.parts.setdefault(ids[a + b], (*pair, r))
        self.trie: dict[int, int] = {}
        self.token_at = [-1]
        inner = set()
        for word, t in vocab.items():
            if len(word) > 1 and t not in self.parts:
                continue  # no merge makes it
            node = 0
            for b in word:
                inner.add(node)
                node_key = node << 8 | b
                if node_key not in self.trie:
                    self.trie[node_key] = len(self.token_at)
                    self.token_at.append(-1)
                node = self.trie[node_key]
            self.token_at[node] = t
        self.has_more = [n in inner for n in range(len(self.token_at))]
        self.spines: tuple[dict, dict] = ({}, {})
        self.pairs: dict[tuple[int, int], bool] = {}
        self.reset()

    def reset(self) -> None:
        #: a state's triples (trie node, token before, count relative to now) as packed integers
        self.states: list[bytes] = [array("i", (0, -1, 0)).tobytes()]
        self.number = {self.states[0]: 0}
        self.bits = 16
        self._alloc()
        self.used = 0

    def _alloc(self) -> None:
        #: an entry: 28 bits of key, 20 of the next state, 8 of the count plus 128; -1 is free
        self.table = np.full(1 << self.bits, -1, np.int64)

    def spine(self, token: int, right: bool) -> list[tuple[int, float]]:
        """From the outermost byte up to token: each part and the rank of the merge that absorbs it."""
        held = self.spines[right]
        if token not in held:
            up, t, absorbed = [], token, float("inf")
            while True:
                up.append((t, absorbed))
                if t not in self.parts:
                    break
                a, b, absorbed = self.parts[t]
                t = b if right else a
            held[token] = up[::-1]
        return held[token]

    def stable(self, a: int, b: int) -> bool:
        """Whether the merges leave a and b as they are when they stand side by side."""
        found = self.pairs.get((a, b))
        if found is None:
            x, y = self.spine(a, True), self.spine(b, False)
            i = j = 0
            found = True
            while True:
                (p, until_p), (q, until_q) = x[i], y[j]
                r = self.rank.get((p, q))
                # of equal ranks the merge further left comes first
                if r is not None and r < until_p and r <= until_q:
                    found = False
                    break
                if i + 1 == len(x) and j + 1 == len(y):
                    break
                if until_p <= until_q:
                    i += 1
                else:
                    j += 1
            if len(self.pairs) > 1 << 20:
                self.pairs.clear()
            self.pairs[a, b] = found
        return found

    def compile(self, key: int) -> tuple[int, int]:
        state, b = array("i", self.states[key >> 8]).tolist(), key & 255
        alive, last, count = [], None, 0
        for node, before, rel in zip(state[::3], state[1::3], state[2::3]):
            to = self.trie.get(node << 8 | b)
            if to is None:
                continue
            t = self.token_at[to]
            if last is None and t >= 0 and (before < 0 or self.stable(before, t)):
                last, count = t, rel + 1
            if self.has_more[to]:
                alive += (to, before, rel)
        for i in range(2, len(alive), 3):
            alive[i] -= count
        after = array("i", (*alive, 0, last, 0)).tobytes()
        number = self.number.get(after)
        if number is None:
            number = self.number[after] = len(self.states)
            self.states.append(after)
        return number, count

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint32) * np.uint32(0x9E3779B1)) >> np.uint32(32 - self.bits)

    def _insert(self, keys: np.ndarray, entries: np.ndarray) -> None:
        mask = len(self.table) - 1
        for e, s in zip(entries.tolist(), self._slot(keys).tolist()):
            while self.table[s] >= 0:
                s = (s + 1) & mask
            self.table[s] = e
        self.used += len(keys)

    def _add(self, keys: np.ndarray) -> None:
        got = [self.compile(k) for k in keys.tolist()]
        entries = keys << 28 | np.array([n << 8 | (c + 128) for n, c in got], np.int64)
        while (self.used + len(keys)) * 4 > len(self.table):
            old = self.table[self.table >= 0]
            self.bits += 1
            self.used = 0
            self._alloc()
            self._insert(old >> 28, old)
        self._insert(keys, entries)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Entries of keys; -1 where a key isn't compiled yet."""
        at = self._slot(keys)
        held = self.table[at]
        odd = np.flatnonzero((held >> 28) != keys)
        if len(odd):
            odd = odd[held[odd] >= 0]
            mask = len(self.table) - 1
            at = at.astype(np.int64)
            while len(odd):
                at[odd] = (at[odd] + 1) & mask
                got = held[odd] = self.table[at[odd]]
                odd = odd[(got >= 0) & ((got >> 28) != keys[odd])]
        return held

    def _numbered(self, state: bytes) -> int:
        n = self.number.get(state)
        if n is None:
            n = self.number[state] = len(self.states)
            self.states.append(state)
        return n

    def _run(self, data: np.ndarray, pos: np.ndarray, ends: np.ndarray, begin: list[bytes], out: np.ndarray | None) -> list[bytes]:
        """Runs chunks [pos, end) of data from their start states in lockstep; gives their end states.

        out: where the tokens that each byte adds are written. Bytes over 255 begin anew.
        """
        by_len = np.argsort(pos - ends, kind="stable")
        after = list(begin)
        if not len(pos):
            return after
        where = by_len
        pos, ends = pos[by_len].copy(), ends[by_len]
        # chunks stand by falling length: how many are left after each step
        left = len(pos) - np.searchsorted((ends - pos)[::-1], np.arange(int((ends - pos)[0]) + 1), "right")
        state = np.array([self._numbered(begin[i]) for i in by_len.tolist()], np.int64)
        for m in left.tolist():
            if m < len(pos):
                for i, n in zip(where[m:].tolist(), state[m:].tolist()):
                    after[i] = self.states[n]
                pos, state, where = pos[:m], state[:m], where[:m]
            if not m:
                break
            if len(self.states) > MAX_STATES:
                held = [self.states[n] for n in state.tolist()]
                self.reset()
                state = np.array([self._numbered(h) for h in held], np.int64)
            b = data[pos].astype(np.int64)
            state[b > 255] = 0
            keys = state << 8 | (b & 255)
            found = self._find(keys)
            new = np.flatnonzero(found < 0)
            if len(new):
                self._add(np.unique(keys[new]))
                found[new] = self._find(keys[new])
            if out is not None:
                out[pos] = (found & 255) - 128
            state = found >> 8 & 0xFFFFF
            pos += 1
        return after

    def increments(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Tokens that each byte adds; starts: positions where the machine begins anew, the first 0."""
        n = len(data)
        anew = data.astype(np.int16)
        anew[starts] |= 256
        at_cut = starts[np.unique(np.searchsorted(starts, np.arange(0, n, ROW_BYTES)).clip(max=len(starts) - 1))]
        size = np.diff(starts, append=n)
        long = np.flatnonzero(size > 2 * ROW_BYTES)
        inside = np.concatenate([np.zeros(0, np.int64), *[np.arange(starts[i] + ROW_BYTES, starts[i] + size[i], ROW_BYTES) for i in long.tolist()]])
        rows = np.union1d(at_cut, inside)
        ends = np.append(rows[1:], n)
        out = np.zeros(n, np.int16)
        fresh = self.states[0]
        begin = [fresh] * len(rows)
        open_rows = np.flatnonzero(np.isin(rows, inside))
        for i, state in zip(open_rows.tolist(), self._run(anew, rows[open_rows] - LOOK, rows[open_rows], [fresh] * len(open_rows), None)):
            begin[i] = state
        after = self._run(anew, rows, ends, begin, out)
        while len(wrong := [i for i in open_rows.tolist() if begin[i] != after[i - 1]]):
            for i in wrong:
                begin[i] = after[i - 1]
            again = np.array(wrong)
            for i, state in zip(wrong, self._run(anew, rows[again], ends[again], [begin[i] for i in wrong], out)):
                after[i] = state
        return out

    def count(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and tokens of each text."""
        n_bytes, n_tokens = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        parts, owner = [], []
        for i, t in enumerate(texts):
            cut = [t]
            for word in self.added:
                if word in t:
                    cut = [x for piece in cut for x in piece.split(word)]
                    n_bytes[i] += len(word.encode()) * t.count(word)
            n_tokens[i] += len(cut) - 1
            parts += cut
            owner += [i] * len(cut)
        flat, _ = pretoken.code_points(parts)
        cut_at = pretoken.cuts(flat)
        end = np.flatnonzero(flat == 0x110000)
        width = 1 + (flat >= 0x80).astype(np.int64) + (flat >= 0x800) + ((flat >= 0x10000) & (flat < 0x110000))
        width[end] = 0
        to = np.cumsum(width)  # bytes up to and with each character
        data = np.frombuffer("".join(parts).encode(), np.uint8)
        size = np.diff(to[end], prepend=0)
        owner = np.array(owner, np.int64)
        np.add.at(n_bytes, owner, size)
        if len(data):
            starts = (to - width)[cut_at[flat[cut_at] != 0x110000]]
            total = np.concatenate([[0], np.cumsum(self.increments(data, starts), dtype=np.int64)])
            np.add.at(n_tokens, owner, total[to[end]] - total[to[end] - size])
        return n_bytes, n_tokens


def machine(raw: bytes) -> CountMachine:
    key = sha256(raw).hexdigest()
    if key not in _machines:
        _machines.clear()
        _machines[key] = CountMachine(raw)
    return _machines[key]


def count_tokens(df: DataFrame, tokenizer_path: str, limit: int = 512, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, n_tokens and over_limit (n_tokens > limit) of every row's whole text."""
    raw = shared_bytes(df.sparkSession, tokenizer_path)

    def run(texts: list[str]) -> dict[str, pa.Array]:
        b, t = machine(raw.value).count(texts)
        return {"n_bytes": pa.array(b), "n_tokens": pa.array(t), "over_limit": pa.array(t > limit)}

    return map_texts(df, text, [key], run, "n_bytes bigint, n_tokens bigint, over_limit boolean")
