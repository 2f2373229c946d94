"""BPE and token counts against the public libraries, byte for byte."""

import random
from hashlib import sha256

import public_tokenizers
import pytest
import regex
import tiktoken
from tokenizers import Tokenizer

from turnloom.llm import bpe, pretoken, token_count

RANKS, COUNTS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
ALPHABET = "ab'strevlmd 1  \n\t.!é漢 ²'eeeaaattthh😀"


@pytest.fixture(scope="module")
def texts():
    r = random.Random(4)
    out = ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 50))) for _ in range(2000)]
    return out + ["", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "a" * 3000, "=-" * 2000, "".join(r.choice("abcdethin") for _ in range(4000)), "\0\x01 é" * 40, "'re've'll'd'm's't'S " * 300]


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(open(RANKS, "rb").read())


def reference(encoder):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=encoder.rank, special_tokens={})


def test_pieces_are_the_patterns_matches(texts):
    pattern = regex.compile(public_tokenizers.PATTERN)
    flat, starts = pretoken.code_points(texts)
    cuts = pretoken.cuts(flat).tolist()
    joined = "\0".join([*texts, ""])
    got = [joined[a:b] for a, b in zip(cuts, [*cuts[1:], len(flat)]) if flat[a] != 0x110000]
    assert got == [p for t in texts for p in pattern.findall(t)]


def test_every_code_point_is_cut_as_the_library_cuts_it():
    """Each code point behind a letter, a number and another sign, in texts of some thousand of them."""
    split = Tokenizer.from_file(COUNTS).pre_tokenizer.pre_tokenize_str
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for a in range(0, len(points), 40000):
        text = "".join(f"a{c}\n1{c}\n!{c}\n" for c in points[a : a + 40000])
        flat, _ = pretoken.code_points([text])
        cuts = pretoken.cuts(flat)
        assert cuts[:-1].tolist() == [at for _, (at, _) in split(text)]


def test_letters_newer_than_the_python_tables(encoder):
    texts = [f"a{chr(c)}a1{chr(c)}1 {chr(c)}" for a, b, _ in pretoken.NEWER for c in range(a, b + 1)]
    ids, lens = encoder.encode(texts)
    want = reference(encoder).encode_ordinary_batch(texts)
    assert ids.tolist() == [i for w in want for i in w] and lens.tolist() == list(map(len, want))
    n = token_count.CountMachine(open(COUNTS, "rb").read()).count(texts)[1]
    assert n.tolist() == [len(e.ids) for e in Tokenizer.from_file(COUNTS).encode_batch(texts, add_special_tokens=False)]


LONG = {"one letter": "a", "two": "ab", "all": "abcdefghijklmnopqrstuvwxyz", "frequent": "etaoinshr", "signs": "=-*#.!", "han": "漢字語日本"}


@pytest.mark.parametrize("name", list(LONG))
def test_long_pieces(encoder, name):
    """Pieces without a cut, of one and of many kilobytes, as the libraries encode and count them."""
    r = random.Random(name)
    texts = ["".join(r.choice(LONG[name]) for _ in range(n)) for n in (511, 513, 1500, 20000)] + [LONG[name] * 700, LONG[name][0] * 1025 + LONG[name][-1] * 2000]
    ids, lens = encoder.encode(texts)
    assert ids.tolist() == [i for t in texts for i in reference(encoder).encode_ordinary(t)]
    want = [len(e.ids) for e in Tokenizer.from_file(COUNTS).encode_batch(texts, add_special_tokens=False)]
    assert token_count.CountMachine(open(COUNTS, "rb").read()).count(texts)[1].tolist() == want


def test_merges_that_make_a_lower_pair():
    """Ranks in which a merge's result has a pair of a lower rank than its own: it comes before the other merges."""
    import base64

    words = [bytes([b]) for b in range(256)]
    r = random.Random(8)
    for _ in range(40):
        more = {"".join(r.choice("abc") for _ in range(r.randint(2, 5))).encode() for _ in range(25)}
        more = sorted(w for w in more)
        r.shuffle(more)
        raw = b"\n".join(base64.b64encode(w) + b" %d" % i for i, w in enumerate(words + more))
        e = bpe.Encoder(raw)
        texts = ["".join(r.choice("abc") for _ in range(n)) for n in (30, 600, 1200)]
        ids, lens = e.encode(texts)
        assert ids.tolist() == [i for t in texts for i in reference(e).encode_ordinary(t)]


def test_a_piece_of_many_megabytes():
    """Counts of a piece of 20 MB against a period that is known from shorter ones."""
    m = token_count.CountMachine(open(COUNTS, "rb").read())
    unit = "abcdefghij" * 1000
    one, two, n = (int(m.count([unit * k])[1][0]) for k in (3, 4, 2000))
    assert n == one + (two - one) * 1997


def test_encoding_and_decoding(texts, encoder):
    ids, lens = encoder.encode(texts)
    want = reference(encoder).encode_ordinary_batch(texts)
    assert lens.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    assert encoder.decode(ids, lens) == [t.encode() for t in texts]
    assert encoder.decimal(ids, lens) == [",".join(map(str, w)).encode() for w in want]


def test_counts(texts):
    m = token_count.CountMachine(open(COUNTS, "rb").read())
    n_bytes, n = m.count(texts)
    assert n.tolist() == [len(e.ids) for e in Tokenizer.from_file(COUNTS).encode_batch(texts, add_special_tokens=False)]
    assert n_bytes.tolist() == [len(t.encode()) for t in texts]


def test_counts_survive_an_emptied_table(texts, monkeypatch):
    monkeypatch.setattr(token_count, "MAX_STATES", 50)
    m = token_count.CountMachine(open(COUNTS, "rb").read())
    one = m.count(texts[:300])[1].tolist()
    assert m.count(texts[:300])[1].tolist() == one
    # emptied while texts are read, long pieces among them
    some = texts[300:600] + ["".join(random.Random(k).choice("etaoinshr") for _ in range(9000)) for k in range(3)]
    assert m.count(some)[1].tolist() == [len(e.ids) for e in Tokenizer.from_file(COUNTS).encode_batch(some, add_special_tokens=False)]


def test_operators_on_odd_rows(spark, odd, encoder):
    rows = odd.select("doc_id", "text").collect()
    tk, counter = reference(encoder), Tokenizer.from_file(COUNTS)
    got = bpe.round_trip(odd, RANKS, ["doc_id", "key"]).collect()
    key = lambda t: (t[0] is not None, t[0] or 0, *t[1:])
    want = []
    for r in rows:
        ids = tk.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), sha256(",".join(map(str, ids)).encode()).hexdigest(), sha256((r.text or "").encode()).hexdigest()))
    assert sorted(((g.doc_id, g.n_tokens, g.ids_sha256, g.decoded_sha256) for g in got), key=key) == sorted(want, key=key)
    assert sorted(bytes(r.decoded) for r in bpe.decode(bpe.round_trip(odd, RANKS, ["doc_id"]), RANKS, ["doc_id"]).collect()) == sorted((r.text or "").encode() for r in rows)
    counts = [(g.doc_id, g.n_bytes, g.n_tokens, g.over_limit) for g in token_count.count_tokens(odd, COUNTS).collect()]
    expect = [(r.doc_id, len((r.text or "").encode()), n := len(counter.encode(r.text or "", add_special_tokens=False).ids), n > 512) for r in rows]
    assert sorted(counts, key=key) == sorted(expect, key=key)
    assert bpe.round_trip(odd.limit(0), RANKS, ["doc_id"]).count() == token_count.count_tokens(odd.limit(0), COUNTS).count() == 0
