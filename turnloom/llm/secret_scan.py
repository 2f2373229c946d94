"""Secret scans: patterns propose candidates, a random forest drops the false positives.

Candidates are values of assignments to names such as token or password (also "the password is ..."),
strings of known key formats, passwords in addresses, and long runs of letters and digits, each to the
end of its token at any length. The forest looks at a candidate's length, its transitions between character classes, how much of it
dictionary words cover, the path it was found under, and the words beside it. It is trained from
labelled findings: a list of (text, start, end, path, label). The dictionary has the fixed words
below and those that stand in SEEN labelled findings outside of their secrets. labelled_findings()
makes a list of N_FINDINGS examples by a seeded generator; findings reviewed by people can be given
instead or added.

Defined results: null and empty texts have no candidates; overlapping candidates are one finding,
the one that starts first and then the longest; repeated rows give one row each; an empty table
gives an empty result; a null path is the empty path; extra columns are ignored.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.llm.common import map_texts
from turnloom.llm.forest import Forest

#: Bound of the labelled sample that the forest is fitted on.
N_FINDINGS = 3000
THRESHOLD = 0.5
SEEN = 5
MASK = "[SECRET]"
_KEYED = r"(?i:\b(?:[a-z0-9]{0,20}[_-]){0,3}(?:auth|access|client|refresh|session|user|bot|db)?(?:token|secret|passwd|password|pwd|api_?key|access_?key|key|auth|credential)s?\b(?:[\"']?[ \t]{0,3}[:=]{1,2}[ \t]{0,3}|[ ]is[ ])[\"']?)(?!-----BEGIN )(?P<v>[^\s\"'<>,;]{8,})"
_FORMATS = r"\b(?P<f>(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9_-]{20,}|AIza[0-9A-Za-z_-]{35}|npm_[A-Za-z0-9]{36}|SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}|[sr]k_(?:live|test)_[A-Za-z0-9]{16,}|glpat-[A-Za-z0-9_-]{20,}|hf_[A-Za-z0-9]{30,}|pypi-[A-Za-z0-9_-]{40,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}(?:\.[A-Za-z0-9_-]{8,})*)[A-Za-z0-9+/_=-]*+)"
_BLOCK = r"(?P<b>-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----(?:[A-Za-z0-9+/=:,.;()\\\s_]|-(?!----))*+-----END [A-Z ]{0,20}PRIVATE KEY-----)"
_RUN = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])(?=[0-9+/_=-]*+[A-Za-z])(?P<r>[A-Za-z0-9+/_=-]{24,}+)"
_ADDRESS = r"\b[a-z][a-z0-9+.-]{1,20}://[^\s:/@\"']{0,80}:(?P<u>[^\s/@\"']{4,}+)(?=@)"
FIND = re.compile("|".join((_BLOCK, _FORMATS, _ADDRESS, _KEYED, _RUN)))
#: A text without any of these cannot have a candidate.
MAYBE = re.compile(r"-----BEGIN|AKIA|gh[pousr]_|xox|sk-|AIza|eyJ|npm_|SG\.|[sr]k_|glpat-|hf_|pypi-|://|(?i:token|secret|passw|pwd|key|auth|credential)|[A-Za-z0-9+/_=-]{24}")
#: Words of names, placeholders and prose for dictionary coverage.
DICTIONARY = """about access account admin after again also another because before being between change changeme check client code config could
count data database default demo development docs dummy each email enter environment example fake file first foobar from function generic group
hello here index info input insert item just key know like local login make master message model more most name never none null number object only
other over path password people placeholder please private production project public query real replace request result root sample secret server
service should some string system table test than that their them then there these they this time token type undefined update user username value
version very want what when where which with word work world would write year your""".split()
_LETTERS = re.compile("[a-z]{4,}")
NEAR_BAD = "token secret password passwd pwd apikey api_key key auth bearer credential private access".split()
NEAR_GOOD = "example sample placeholder dummy test checksum sha256 sha1 md5 digest commit hash uuid guid id isbn order invoice version url file image".split()
PATHS = "test example sample doc mock fixture spec readme".split()


def candidates(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every candidate of the whole text, without overlaps."""
    if not MAYBE.search(text):
        return []
    return [(*m.span(m.lastgroup), {"v": "assignment", "f": "format", "b": "private key", "u": "address", "r": "run"}[m.lastgroup]) for m in FIND.finditer(text)]


def learned(findings: list[tuple[str, int, int, str, int]]) -> frozenset[str]:
    """The dictionary: fixed words of four letters and more, and such words beside or in place of secrets."""
    seen = Counter(w for t, a, b, _, secret in findings for w in set(_LETTERS.findall((t[:a] + " " + t[b:] if secret else t).lower())))
    return frozenset(w for w in DICTIONARY if len(w) > 3) | {w for w, n in seen.items() if n >= SEEN}


def covered(low: str, words: frozenset[str], longest: int) -> int:
    """Characters of low that words cover, the longest word first at each place."""
    total = 0
    for run in _LETTERS.finditer(low):
        at, end = run.span()
        while at < end - 3:
            n = next((n for n in range(min(longest, end - at), 3, -1) if low[at : at + n] in words), 0)
            total += n
            at += n or 1
    return total


def features(text: str, start: int, end: int, path: str, words: frozenset[str], longest: int) -> list[float]:
    s = text[start:end]
    n = len(s)
    kind = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.isalpha() else "o" for c in s]
    counts = {c: s.count(c) for c in set(s)}
    entropy = -sum(v / n * np.log2(v / n) for v in counts.values())
    low = s.lower()
    before, after = text[max(0, start - 60) : start].lower(), text[end : end + 60].lower()
    near = re.findall(r"[a-z0-9_]+", before)[-3:] + re.findall(r"[a-z0-9_]+", after)[:3]
    joined = " ".join(near)
    return [
        n, sum(a != b for a, b in zip(kind, kind[1:])) / max(1, n - 1), entropy, entropy / np.log2(max(2, n)),
        kind.count("d") / n, kind.count("u") / n, kind.count("o") / n, max(counts.values()) / n, len(counts),
        covered(low, words, longest) / n, float(bool(re.fullmatch("[0-9a-f]+", low))), float(bool(re.fullmatch("[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", low))),
        float("/" in s), float(bool(re.search(r"\.[a-z]{2,4}$", low))), float(any(p in path.lower() for p in PATHS)), float(bool(re.search("[=:]", before[-4:]))), float(before[-1:] in ("'", '"')),
        float(any(w in joined for w in NEAR_BAD)), float(any(w in near for w in NEAR_GOOD)), float(bool(re.match(_KNOWN_START, s))), float(len(set(re.findall(r"(.)\1\1", s))) > 0),
        float(bool(re.match("sha[0-9]+[-=:]", low)) or bool(re.search("(?:base64,|sha[0-9]+[-=:])$", before))), float(bool(re.fullmatch("[a-z]+[0-9]{0,4}", low))), float(bool(re.search("://[^ ]*:$", before))), float(bool(re.search(r"\bis ['\"]?$", before))),
    ]


#: What keys of known formats start with.
_KNOWN_START = "AKIA|gh[pousr]_|xox|sk-|AIza|eyJ|npm_|SG\\.|[sr]k_(?:live|test)_|glpat-|hf_|pypi-|-----BEGIN"


def labelled_findings(n: int = N_FINDINGS, seed: int = 11) -> list[tuple[str, int, int, str, int]]:
    """n findings with labels, half of them false positives, in made-up surroundings."""
    rng = random.Random(seed)
    pick = rng.choice
    some = lambda alphabet, k: "".join(pick(alphabet) for _ in range(k))
    lower, upper, digit, hexa = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"
    mixed = lower + upper + digit
    prose = lambda k: " ".join(some(lower, rng.randint(2, 9)) if rng.random() < 0.6 else pick(DICTIONARY) for _ in range(k))

    def real() -> tuple[str, str]:
        name = pick(["token", "secret", "api_key", "access_key", "password", "auth_token", "client_secret", "db_password"])
        k = rng.random()
        if k < 0.3:
            return some(hexa, pick([32, 40, 64])), f"{name} {pick('=:')} "
        if k < 0.5:
            return some(mixed, rng.randint(20, 48)), f"{name}{pick([' = ', '=', ': '])}"
        if k < 0.6:
            return some(mixed + "!@#%^&*-_+", rng.randint(10, 24)), f"password{pick([' = ', '=', ': '])}"
        if k < 0.66:
            return some(mixed + "+/", 40), f"{name.upper()}="
        if k < 0.70:
            return some(pick([hexa, mixed]), pick([32, 40])), pick(["Bearer ", "Authorization: Bearer ", "authorization: token "])
        if k < 0.74:
            return some(mixed + "!#%^&*-_", rng.randint(8, 20)), pick(["postgres", "mysql", "amqp", "https"]) + "://" + some(lower, rng.randint(3, 8)) + ":"
        if k < 0.78:
            value = some(lower, rng.randint(4, 8)) + some(digit, rng.randint(1, 3))
            return pick([value + value, some(mixed, rng.randint(9, 16)), some(mixed + "!#%&", rng.randint(9, 16))]), pick(["the password is ", "my token is ", "secret is "])
        if k < 0.95:
            return pick(["npm_" + some(mixed, 36), "SG." + some(mixed + "-_", 22) + "." + some(mixed + "-_", 43), "sk_live_" + some(mixed, 24), "glpat-" + some(mixed + "-_", 20), "hf_" + some(mixed, 34),"AKIA" + some(upper + digit, 16), "ghp_" + some(mixed, 36), "xoxb-" + some(digit, 11) + "-" + some(mixed, 24), "sk-" + some(mixed, 40), "AIza" + some(mixed + "-_", 35)]), pick([f"{name}: ", "", "use ", "key="])
        return "eyJ" + some(mixed, 20) + "." + some(mixed, 40) + "." + some(mixed + "-_", 43), "Bearer "

    def false() -> tuple[str, str]:
        name = pick(["token", "secret", "api_key", "password", "auth"])
        k = rng.random()
        if k < 0.3:
            return pick(["_", "-", ""]).join(pick(DICTIONARY) for _ in range(rng.randint(2, 5)))[:60].ljust(8, "x"), f"{name}{pick(['=', ': ', ' = '])}"
        if k < 0.36:
            return pick("xX*0.") * rng.randint(8, 40), f"{name}="
        if k < 0.4:
            return "sha" + pick(["256-", "384-", "512-"]) + some(mixed + "+/", pick([43, 64, 86])) + pick(["=", "", "=="]), pick(["integrity ", 'integrity="', "integrity: "])
        if k < 0.44:
            return some(mixed + "+/", rng.randint(40, 200)) + pick(["", "=", "=="]), pick(["data:image/png;base64,", "data:font/woff2;base64,", "src=data:image/gif;base64,"])
        if k < 0.47:
            word = pick([w for w in DICTIONARY if len(w) > 3])
            return (word + pick(["", pick(DICTIONARY)]) + some(digit, rng.randint(0, 4))).ljust(8, "1"), f"{name}{pick(['=', ': ', ' is ', ' = '])}"
        if k < 0.48:
            return pick(["password", "changeme", "username", "secret12", "${DB_PASSWORD}", "PASSWORD", "xxxxxxxx"]), "postgres://" + some(lower, 5) + ":"
        if k < 0.5:
            return "${" + some(upper + "_", rng.randint(6, 20)) + "}", f"{name}="
        if k < 0.65:
            return some(hexa, pick([32, 40, 64])), pick(["sha256 ", "md5 ", "commit ", "checksum: ", "digest ", "image ", "hash "])
        if k < 0.75:
            return "-".join(some(hexa, j) for j in (8, 4, 4, 4, 12)), pick(["id ", "uuid ", "order ", "guid: "])
        if k < 0.85:
            return "/".join(some(lower, rng.randint(3, 9)) for _ in range(5)) + str(rng.randint(0, 99)), pick(["file ", "url ", "see ", ""])
        if k < 0.93:
            return some(lower, rng.randint(24, 40)) + some(digit, 1), prose(1) + " "
        return some(digit, rng.randint(20, 30)) + pick(lower), pick(["invoice ", "isbn ", "order ", "version "])

    out = []
    for i in range(n):
        value, lead = real() if i % 2 else false()
        quote = pick(["", '"', "'"]) if lead.rstrip().endswith(("=", ":")) else ""
        start = prose(rng.randint(0, 12)) + " " + lead + quote
        path = pick(["src/app.py", "config/settings.yml", "src0", "web", ""]) if i % 2 or rng.random() < 0.6 else pick(["tests/test_login.py", "docs/example.md"])
        out.append((start + value + quote + " " + prose(rng.randint(0, 12)), len(start), len(start) + len(value), path, i % 2))
    return out


class Detector:
    """A dictionary and a forest, both learned from labelled findings."""

    def __init__(self, findings: list[tuple[str, int, int, str, int]]) -> None:
        self.words = learned(findings)
        self.longest = max(map(len, self.words))
        self.forest = Forest().fit(self._features([f[:4] for f in findings]), np.array([f[4] for f in findings]))

    def _features(self, found: list[tuple[str, int, int, str]]) -> np.ndarray:
        return np.array([features(*f, self.words, self.longest) for f in found])

    def probability(self, found: list[tuple[str, int, int, str]]) -> np.ndarray:
        """Probability of a secret for each (text, start, end, path)."""
        return self.forest.probability(self._features(found)) if found else np.zeros(0)


def train(findings: list[tuple[str, int, int, str, int]]) -> Detector:
    return Detector(findings)


@lru_cache(maxsize=1)
def default_model() -> Detector:
    return train(labelled_findings())


def judge(model: Detector, text: str, path: str | None) -> list[tuple[int, int, str, float]]:
    """(start, end, kind, probability) of every candidate of one text."""
    found = candidates(text)
    p = model.probability([(text, a, b, path or "") for a, b, _ in found])
    return [(*c, float(q)) for c, q in zip(found, p)]


def masked(text: str, secrets: list[tuple[int, int]]) -> str:
    at, out = 0, []
    for a, b in secrets:
        out += [text[at:a], MASK]
        at = b
    return "".join([*out, text[at:]])


def scan(df: DataFrame, keep: list[str], text: str = "text", path: str | None = "source", model: Detector | None = None, mask: bool = False) -> DataFrame:
    """keep, n_candidates, n_secrets, findings and (if mask) the masked text of every row."""
    sent = df.sparkSession.sparkContext.broadcast(model or default_model())  # some hundred kB

    def run(texts: list[str], paths: list[str | None] | None = None) -> dict[str, pa.Array]:
        all_found = [judge(sent.value, t, p) for t, p in zip(texts, paths or [""] * len(texts))]
        secret = [[f for f in found if f[3] >= THRESHOLD] for found in all_found]
        item = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("probability", pa.float64())])
        out = {
            "n_candidates": pa.array(list(map(len, all_found)), pa.int64()),
            "n_secrets": pa.array(list(map(len, secret)), pa.int64()),
            "findings": pa.array([[dict(zip(("start", "end", "kind", "probability"), f)) for f in s] for s in secret], pa.list_(item)),
        }
        if mask:
            out["masked"] = pa.array([masked(t, [f[:2] for f in s]) for t, s in zip(texts, secret)], pa.string())
        return out

    schema = "n_candidates bigint, n_secrets bigint, findings array<struct<start:bigint,end:bigint,kind:string,probability:double>>" + ", masked string" * mask
    return map_texts(df, text, keep, run, schema, path)


def mask_secrets(df: DataFrame, text: str = "text", path: str = "source") -> DataFrame:
    """df's rows and columns, with secrets in texts masked; null texts stay null."""
    cols = df.columns
    d = df.withColumnsRenamed({c: f"__c{i}" for i, c in enumerate(cols)})
    t = f"__c{cols.index(text)}"
    d = scan(d, d.columns, t, f"__c{cols.index(path)}", mask=True)
    d = d.withColumn(t, F.when(F.col("n_secrets") > 0, F.col("masked")).otherwise(F.col(t)))
    return d.select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(cols)])
