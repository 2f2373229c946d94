"""The splitting pattern of byte-level BPE vocabularies as a finite-state machine.

The machine reads character classes and cuts text where the pattern's matches end. It runs over
many texts at once: the texts are laid end to end with a separator class, cut into equal chunks,
and every chunk's map from start state to end state is computed for all start states in lockstep.
The maps compose through a parallel prefix scan, which gives every chunk's true start state; a
second lockstep pass then emits the cuts.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

CHUNK = 512

# classes: letter, number, other, blank, other white space, apostrophe, letters of contractions
L, N, O, SP, WS, AP, C_STMD, C_R, C_V, C_E, C_LL, END = range(12)
LETTERS = (L, C_STMD, C_R, C_V, C_E, C_LL)
# states: at a cut; in letters, numbers, others; one blank, one white, more ending in blank or
# white; after a leading apostrophe, and after its r or v, and after its l
START, S_L, S_N, S_O, S_SP, S_WS, S_SPN, S_WSN, S_AP, S_AP_E, S_AP_L = range(11)
N_STATES = 11


#: Letters and numbers of Unicode 16, which the tokenizers' libraries follow, that Python's older tables lack.
NEWER = [
    (0x1C89, 0x1C8A, L), (0xA7CB, 0xA7CD, L), (0xA7DA, 0xA7DC, L), (0x105C0, 0x105F3, L), (0x10D40, 0x10D49, N), (0x10D4A, 0x10D65, L), (0x10D6F, 0x10D85, L),
    (0x10EC2, 0x10EC4, L), (0x11380, 0x11389, L), (0x1138B, 0x1138B, L), (0x1138E, 0x1138E, L), (0x11390, 0x113B5, L), (0x113B7, 0x113B7, L), (0x113D1, 0x113D1, L),
    (0x113D3, 0x113D3, L), (0x116D0, 0x116E3, N), (0x11BC0, 0x11BE0, L), (0x11BF0, 0x11BF9, N), (0x13460, 0x143FA, L), (0x16100, 0x1611D, L), (0x16130, 0x16139, N),
    (0x16D40, 0x16D6C, L), (0x16D70, 0x16D79, N), (0x18CFF, 0x18CFF, L), (0x1CCF0, 0x1CCF9, N), (0x1E5D0, 0x1E5ED, L), (0x1E5F0, 0x1E5F0, L), (0x1E5F1, 0x1E5FA, N),
]


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of every code point; 0x110000 is the separator between texts."""
    out = np.full(0x110001, O, np.uint8)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))[0]
        if kind == "L":
            out[cp] = L
        elif kind == "N":
            out[cp] = N
    for first, last, kind in NEWER:
        out[first : last + 1] = kind
    # fixed values: code points with the property White_Space
    white = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    out[white] = WS
    out[0x20], out[0x27], out[0x110000] = SP, AP, END
    for c, k in [*((x, C_STMD) for x in "stmd"), ("r", C_R), ("v", C_V), ("e", C_E), ("l", C_LL)]:
        out[ord(c)] = k
    return out


def _fresh(c: int) -> int:
    """The state after c as the first character of a match."""
    if c in LETTERS:
        return S_L
    return {N: S_N, O: S_O, SP: S_SP, WS: S_WS, AP: S_AP, END: START}[c]


@lru_cache(maxsize=1)
def machine() -> tuple[np.ndarray, np.ndarray]:
    """next state and cuts by (state * 12 + class); cuts: 1 before this character, 2 before the last one."""
    nxt, cut = np.zeros(N_STATES * 12, np.uint8), np.zeros(N_STATES * 12, np.uint8)
    run = {S_L: LETTERS, S_N: (N,), S_O: (O, AP)}
    for s in range(N_STATES):
        for c in range(12):
            to, k = _fresh(c), 1
            if c == END or s == START:
                # a separator ends every match; r, v and l that no contraction took are letters
                k = 3 if c == END and s in (S_AP_E, S_AP_L) else 1
            elif s in run and c in run[s]:
                to, k = s, 0
            elif s in (S_SP, S_WS, S_SPN, S_WSN):
                many = s in (S_SPN, S_WSN)
                if c in (SP, WS):
                    to, k = (S_SPN if c == SP else S_WSN), 0
                else:
                    blank = s in (S_SP, S_SPN)  # goes with what follows
                    k = (0 if blank else 1) | (2 if many else 0)
                    if blank and c == AP:
                        to = S_O
            elif s == S_AP:
                if c == C_STMD:
                    to, k = START, 0
                elif c in (C_R, C_V):
                    to, k = S_AP_E, 0
                elif c == C_LL:
                    to, k = S_AP_L, 0
                elif c in (O, AP):
                    to, k = S_O, 0
            elif s in (S_AP_E, S_AP_L):
                if c == (C_E if s == S_AP_E else C_LL):
                    to, k = START, 0
                elif c in LETTERS:
                    to, k = S_L, 2
                else:
                    k = 3
            nxt[s * 12 + c], cut[s * 12 + c] = to, k
    return nxt, cut


def scan(cls: np.ndarray) -> np.ndarray:
    """Cuts of each character of cls (1 before it, 2 before the one ahead of it)."""
    nxt, cut = machine()
    n = len(cls)
    rows = max(1, -(-n // CHUNK))
    grid = np.full(rows * CHUNK, END, np.uint8)
    grid[:n] = cls
    grid = np.ascontiguousarray(grid.reshape(rows, CHUNK).T)
    # one row of 16 for each chunk: its map of states
    state = np.repeat(np.arange(N_STATES, dtype=np.uint8)[None, :], rows, 0)
    step = nxt.reshape(N_STATES, 12)
    # most start states meet within a few characters: follow all only as long as they differ
    j, together = 0, False
    while j < CHUNK and not together:
        state = step[state, grid[j][:, None]]
        j += 1
        if j % 16 == 0:
            together = bool((state == state[:, :1]).all())
    if j < CHUNK:
        one = state[:, 0]
        for i in range(j, CHUNK):
            one = nxt[one.astype(np.int16) * 12 + grid[i]]
        state = np.repeat(one[:, None], N_STATES, 1)
    # inclusive prefix scan of the maps under composition, by doubling
    maps, d = state, 1
    while d < rows:
        later = maps.copy()
        later[d:] = np.take_along_axis(maps[d:], maps[:-d].astype(np.int64), 1)
        maps, d = later, d * 2
    at = np.zeros(rows, np.uint8)
    at[1:] = maps[:-1, START]
    out = np.empty((CHUNK, rows), np.uint8)
    for i in range(CHUNK):
        key = at.astype(np.int16) * 12 + grid[i]
        out[i] = cut[key]
        at = nxt[key]
    return np.ascontiguousarray(out.T).reshape(-1)[:n]


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' code points, each text followed by the separator 0x110000; and where each text starts."""
    lens = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(lens + 1)
    flat = np.empty(int(ends[-1]) if len(texts) else 0, np.uint32)
    flat[:] = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    flat[ends - 1] = 0x110000
    return flat, ends - lens - 1


def cuts(flat: np.ndarray) -> np.ndarray:
    """Sorted positions in flat where a match or a separator starts."""
    bits = scan(classes()[flat])
    first = (bits & 1).astype(bool)
    before = np.flatnonzero(bits & 2) - 1
    first[before] = True
    return np.flatnonzero(first)
