"""Where reasoning starts and ends in a completion.

A marker counts wherever it stands but inside the argument values of a call: between a parameter's
opener and its end, or in the strings below "arguments" or "parameters" of a JSON call. A call's header
that is only quoted (in a code span, a fence or quotation marks) owns no text beyond its quotation.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

THINK, DONE = "<think>", "</think>"
#: Quotation marks, and those that close them.
PAIRS = {'"': '"', "'": "'", "“": "”", "‘": "’", "«": "»", "‹": "›", "„": "“”", "‚": "‘’", "「": "」", "『": "』", "〝": "〞〟", "﹁": "﹂", "﹃": "﹄", "＂": "＂", "＇": "＇"}
_CLOSERS = set("".join(PAIRS.values()))
_APOSTROPHES = "'’＇"
_MARKS = re.compile("|".join(["</?think>", "</?tool_call>", r"<function=[^\n>]*>", "</function>", r"<parameter=[^\n>]*>", "`+", "~{3,}", *map(re.escape, PAIRS)]))
#: What a call's scopes are made of, by one letter each: o and d open and end reasoning, c opens a call, e ends a value.
_LETTER = {THINK: "o", DONE: "d", "<tool_call>": "c", "</tool_call>": "e", "</function>": "e", "</parameter>": "e"}
_SCOPE = re.compile("|".join(_LETTER))
#: Reasoning as a word over these letters: an end without an opener only comes first; a block runs from its first opener.
_BLOCK = re.compile("^d|(?P<open>o+)(?P<end>d?)")
_JSON = re.compile(r'"(?:[^"\\]|\\.)*"|"|[{}\[\]]|</?think>|</tool_call>', re.S)
_GIVEN = re.compile(r'"(?:arguments|parameters)"\s*:\s*(?=["{\[])')
_STRING = re.compile(r'"(?:[^"\\]|\\.)*(?:"|\Z)', re.S)


def fences(text: str) -> Iterator[tuple[int, int, str, str]]:
    """(start, length, character, what follows up to a marker) of code fences, one a line: behind at most three blanks, at a line's start or a marker."""
    begin = 0
    for line in text.split("\n"):
        at = begin
        for piece in re.split("(</?think>)", line):
            mark = piece.lstrip(" ")
            blanks, kind = len(piece) - len(mark), mark[:1]
            size = len(mark) - len(mark.lstrip(kind)) if kind and kind in "`~" else 0
            if blanks <= 3 and size >= 3:
                yield at + blanks, size, kind, mark[size:]
                break
            at += len(piece)
        begin += len(line) + 1


def quotations(text: str) -> dict[int, int]:
    """Start and end of whatever is quoted and closed, from the right to the left: an opener ends at its next closer."""
    ends: dict[int, int] = {}
    ahead: dict[str, int] = {}
    for i in range(len(text) - 1, -1, -1):
        c = text[i]
        if c not in PAIRS and c not in _CLOSERS:
            continue
        if i and text[i - 1] == "\\" and _escaped(text, i):
            continue
        before, after = i > 0 and text[i - 1].isalnum(), i + 1 < len(text) and text[i + 1].isalnum()
        if c in _APOSTROPHES and before and after:
            continue
        closers = [ahead[x] for x in PAIRS.get(c, "") if x in ahead]
        # a mark that also closes cannot open behind a letter or digit
        if closers and not (before and c in PAIRS[c]):
            ends[i] = min(closers) + 1
        if c in _CLOSERS:
            ahead[c] = i
    spans: dict[int, int] = {}
    for m in reversed(list(re.finditer("`+", text))):
        if len(m[0]) in spans:
            ends[m.start()] = spans[len(m[0])]
        spans[len(m[0])] = m.end()
    # a fence ends at the next bare one of its kind that is at least as long: kept by falling distance and rising length
    bare: dict[str, list[tuple[int, int]]] = {"`": [], "~": []}
    for begin, size, kind, info in reversed(list(fences(text))):
        if kind == "`" and "`" in info:
            continue
        held = bare[kind]
        k = bisect_left(held, -size, key=lambda h: -h[0])
        longer = held[:k] + [h for h in held[k : k + 1] if h[0] == size]
        if longer:
            ends[begin] = longer[-1][1]
        if not info.strip():
            while held and held[-1][0] <= size:
                held.pop()
            held.append((size, begin + size + len(info)))
    return ends


def _escaped(text: str, i: int) -> bool:
    n = 0
    while i - n - 1 >= 0 and text[i - n - 1] == "\\":
        n += 1
    return n % 2 == 1


class Reader:
    """Finds reasoning markers from left to right; every part of the text is read a bounded number of times."""

    def __init__(self, text: str) -> None:
        self.text, self.quoted = text, quotations(text)
        self.thinking: bool | None = None  # not known ahead of the first marker
        self.first = len(text) - len(text.lstrip())

    def markers(self) -> Iterator[re.Match[str]]:
        at = 0
        while m := self._next(at, len(self.text), None, False, False):
            self.thinking = m[0] == THINK
            yield m
            at = m.end()

    def _next(self, at: int, limit: int, mark: str | None, in_call: bool, in_function: bool) -> re.Match[str] | None:
        """The next marker ahead of limit; mark: the quotation mark that this scope stands in."""
        text = self.text
        hypothetical = self.thinking is not False
        while m := _MARKS.search(text, at, limit):
            at, word = m.end(), m[0]
            if word in (THINK, DONE):
                return m
            if word == "<tool_call>":
                in_call, in_function = True, False
                if self.thinking is None and m.start() == self.first:
                    self.thinking = hypothetical = False
                body = re.compile(r"\s*\{").match(text, at, limit)
                if body:
                    own = mark == '"'  # JSON's own quotation marks do not end this one
                    at = self._json(body.end(), len(text) if own else limit)
                    if own:
                        end = text.find('"', at)
                        limit = len(text) if end < 0 else end + 1
            elif word == "</tool_call>":
                in_call = in_function = False
            elif word.startswith("<function="):
                in_function = in_call and bool(word[10:-1].strip())
            elif word == "</function>":
                in_function = False
            elif word.startswith("<parameter="):
                if in_function and word[11:-1].strip():
                    at = self._value(at, limit, hypothetical and mark is None)
            elif mark is None and (end := self.quoted.get(m.start())) and end <= limit:
                if inner := self._next(at, end, word, in_call, in_function):
                    return inner
                at = max(end, self._resumed)
        self._resumed = limit
        return None

    _resumed = 0

    def _value(self, at: int, limit: int, hypothetical: bool) -> int:
        """The end of a parameter's value.

        In reasoning, a header can be a mere mention: its value ends at the latest at a closing marker that
        no opener inside it answers, if a new call or the end follows before any end of the value.
        """
        marks, end = [], None
        for m in _SCOPE.finditer(self.text, at, limit):
            if _LETTER[m[0]] == "e":
                end = m.start()
                break
            marks.append((_LETTER[m[0]], m.start()))
        level = lowest = 0
        mentions, calls = [], []
        for letter, place in marks if hypothetical else []:
            level += {"o": 1, "d": -1, "c": 0}[letter]
            if level < lowest:  # no opener answers a marker that brings a new low
                mentions.append(place)
                lowest = level
            elif letter == "c" and mentions:
                calls.append(len(mentions))
        if calls:
            return mentions[calls[0] - 1]
        if end is None:
            return mentions[-1] if mentions else limit
        return end

    def _json(self, at: int, limit: int) -> int:
        """Behind a JSON call's object, or where a marker, a call's end or a broken string stops it; argument values are passed over."""
        depth = 1
        while depth and (m := _JSON.search(self.text, at, limit)):
            if m[0][0] == "<":
                return m.start()
            given = _GIVEN.match(self.text, m.start(), limit) if depth == 1 and m[0][0] == '"' else None
            if given:
                at = self._argument(given.end(), limit)
            elif m[0][0] == '"':
                if m[0] == '"' or THINK in m[0] or DONE in m[0]:
                    return m.start() + 1  # a header conceals no marker
                at = m.end()
            else:
                depth += 1 if m[0] in "{[" else -1
                at = m.end()
        return at if not depth else limit

    def _argument(self, at: int, limit: int) -> int:
        """The end of a string, or of an object or list whose strings are passed over whole."""
        depth = 0
        token = re.compile(r'"|[{}\[\]]|</?think>|</tool_call>')
        while m := token.search(self.text, at, limit):
            if m[0] == '"':
                whole = _STRING.match(self.text, m.start())  # none where a lone backslash ends the text
                at = min(limit, whole.end()) if whole else limit
            elif m[0][0] == "<":
                return m.start()
            else:
                depth += 1 if m[0] in "{[" else -1
                at = m.end()
            if not depth:
                return at
        return limit


def spans(text: str) -> Iterator[tuple[int, int, int | None, int]]:
    """(start, body, end of body or None if open, end) of reasoning.

    A first closing marker without an opener ends reasoning that the prompt opened. An open block
    owns the rest.
    """
    marks = list(Reader(text).markers())
    for block in _BLOCK.finditer("".join(_LETTER[m[0]] for m in marks)):
        if block["open"] is None:
            yield 0, 0, marks[0].start(), marks[0].end()
            continue
        opener, last = marks[block.start("open")].start(), marks[block.end("open") - 1]
        start = 0 if not block.start() and not text[:opener].strip() else opener
        if block["end"]:
            done = marks[block.start("end")]
            yield start, last.end(), done.start(), done.end()
        else:
            yield start, last.end(), None, len(text)
