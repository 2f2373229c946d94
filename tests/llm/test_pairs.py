"""Near-duplicates, components, repeated passages and archives against brute force."""

import random
import re
from collections import defaultdict
from hashlib import sha256

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from turnloom.llm import components, simhash, substring_dedup, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fingerprint(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    three = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in three]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def linked(fps, limit=3):
    """Smallest index of each one's component, by comparing all pairs."""
    top = list(range(len(fps)))

    def find(a):
        while top[a] != a:
            top[a] = top[top[a]]
            a = top[a]
        return a

    f = np.array(fps, np.uint64)
    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f[i + 1 :] ^ f[i]) <= limit) + i + 1:
            a, b = find(i), find(int(j))
            top[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(f))]


def test_components(spark):
    r = random.Random(5)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(r.randint(200, 400), r.randint(200, 400)) for _ in range(90)]
    nodes = sorted({x for e in edges for x in e if e[0] != e[1]})
    low = {n: n for n in nodes}
    for _ in nodes:
        for a, b in edges:
            if a != b:
                low[a] = low[b] = min(low[a], low[b])
    d = spark.createDataFrame(edges + edges[:9], "x bigint, y bigint")
    assert {r.node: r.component for r in components.components(d).collect()} == low
    assert components.components(d.limit(0)).count() == 0


def test_simhash_links_of_planted_fingerprints(spark):
    r = random.Random(6)
    base = [r.getrandbits(64) for _ in range(60)]
    flip = lambda f, k: f ^ sum(1 << b for b in r.sample(range(64), k))
    fps = base + [flip(f, r.randint(1, 5)) for f in base for _ in range(4)] + [flip(base[0], r.randint(1, 6)) for _ in range(400)] + [0, 1, 3, 7, 15, 31, (1 << 64) - 1]
    fps = list(dict.fromkeys(fps))
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    got = {x.node: x.component for x in simhash.linked(spark.createDataFrame([(s,) for s in signed], "fp bigint")).collect()}
    groups = defaultdict(set)
    for s in signed:
        groups[got.get(s, s)].add(s)
    want = defaultdict(set)
    for s, c in zip(signed, linked(fps)):
        want[c].add(s)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_simhash_documents(spark, sf, odd):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select((F.col("doc_id") + 100).alias("doc_id"), "text").union(odd.select("doc_id", "text"))
    rows = docs.where("doc_id IS NOT NULL").collect()
    rows.sort(key=lambda r: r.doc_id)
    fps = [fingerprint(r.text) for r in rows]
    tops = linked(fps)
    want = sorted((r.doc_id, format(f, "016x"), rows[t].doc_id) for r, f, t in zip(rows, fps, tops))
    got = simhash.near_duplicates(docs)
    assert sorted(map(tuple, got.where("doc_id IS NOT NULL").collect())) == want and got.count() == docs.count()
    assert simhash.near_duplicates(odd.limit(0)).count() == 0
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {None, 1, 2, 6, 7, 8}


def prose(r, n):
    return ["".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 8))) for _ in range(n)]


@pytest.fixture(scope="module")
def passages():
    r = random.Random(8)
    docs = {i: prose(r, 200) for i in range(30)}
    planted = prose(r, 60)
    for i in (3, 9, 20):
        docs[i][40:40] = planted
    fuzzy = prose(r, 90)
    for i in (5, 6):
        docs[i][100:100] = [w if k % 12 or i == 5 else "changed" for k, w in enumerate(fuzzy)]
    docs[11][0:0] = docs[10][:30]  # too short to count
    docs[25] = list(docs[24])
    return {i: " ".join(w) for i, w in docs.items()}


def test_repeated_passages(spark, passages, odd):
    d = spark.createDataFrame(list(passages.items()), "doc_id bigint, text string")
    got = {r.doc_id: r for r in substring_dedup.report(d).collect()}
    assert {i for i, r in got.items() if r.n_repeated} == {3, 9, 20, 5, 6, 24, 25}
    for i in (9, 20):
        s = got[i].spans[0]
        assert (s.start, s.end, s.partner, s.partner_start, s.partner_end) == (40, 100, 3, 40, 100)
    assert got[3].n_repeated == 60 and abs(got[6].n_repeated - 90) <= 4 and got[6].partners == [5]
    assert [got[i].partners for i in (3, 9, 20, 5, 24, 25, 0)] == [[9], [3], [3], [6], [25], [24], []]
    assert all(r.repeated == (r.n_repeated > 0) for r in got.values())
    assert got[25].class_id == 24 and got[24].n_repeated == got[25].n_repeated == 200
    assert substring_dedup.report(odd).count() == odd.count() and substring_dedup.report(d.limit(0)).count() == 0


def test_chains_follow_both_texts():
    x, y = np.array([0, 10, 20, 30, 5]), np.array([100, 110, 90, 130, 500])
    best = substring_dedup.chains(x, y)[0]
    assert best.tolist() == [0, 1, 3]


def test_passages_that_a_chain_bridges(spark):
    r = random.Random(9)
    own = lambda n: prose(r, n)
    one, two, small, tiny, copy = own(200), own(200), own(60), own(60), own(800)
    docs = [one + own(250) + two, one + own(250) + two, own(30) + small + own(70) + tiny, small + own(70) + tiny + own(30), copy, copy[:400] + own(300) + copy[400:]]
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id bigint, text string")
    got = {x.doc_id: x for x in substring_dedup.report(d).collect()}
    spans = [[(s.start, s.end, s.partner_start, s.partner_end) for s in got[i].spans] for i in (1, 3, 5)]
    assert spans == [[(0, 200, 0, 200), (450, 650, 450, 650)], [(0, 60, 30, 90), (130, 190, 160, 220)], [(0, 400, 0, 400), (700, 1100, 400, 800)]]
    assert [got[i].n_repeated for i in range(6)] == [400, 400, 120, 120, 800, 800]


def test_passages_whose_seeds_first_occur_in_several_documents(spark):
    r = random.Random(10)
    whole = prose(r, 60)
    three = prose(r, 75)
    docs = [whole[:30] + prose(r, 99), prose(r, 99) + whole[30:], prose(r, 40) + whole + prose(r, 40), prose(r, 70) + whole + prose(r, 9)]
    # two earlier holders of every part
    docs += [prose(r, 50) + three[i : i + 25] + prose(r, 50) for i in (0, 25, 50, 0, 25, 50)] + [prose(r, 20) + three + prose(r, 20), prose(r, 30) + three]
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id bigint, text string")
    got = {x.doc_id: x for x in substring_dedup.report(d).collect()}
    assert [(i, got[i].n_repeated, got[i].partners) for i in range(12) if got[i].repeated] == [(2, 60, [3]), (3, 60, [2]), (10, 75, [11]), (11, 75, [10])]


@pytest.mark.parametrize("copies", [2, 9])
def test_passages_whose_every_part_many_earlier_documents_hold(spark, copies):
    """Two documents share 60 words, of which others have 49 each; with 9 copies the seeds have more holders than are all compared."""
    r = random.Random(26)
    whole, one, two = prose(r, 60), prose(r, 30), prose(r, 30)
    docs = [prose(r, 40) + whole[i : i + 49] + prose(r, 40) for _ in range(copies) for i in range(12)]
    docs += [prose(r, 40) + part + prose(r, 40) for _ in range(6 * copies) for part in (one, two)]
    n = len(docs)
    docs += [prose(r, 20) + whole + prose(r, 20) for _ in range(2)] + [prose(r, 20) + one + prose(r, k) + two + prose(r, 20) for k in (1, 3)]
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id bigint, text string")
    got = {x.doc_id: x for x in substring_dedup.report(d).collect()}
    last = [(i - n, got[i].n_repeated, [p - n for p in got[i].partners if p >= n]) for i in range(n, n + 4)]
    assert last == [(0, 60, [1]), (1, 60, [0]), (2, 61, [3]), (3, 63, [2])]


def test_rows_in_step_are_those_of_a_loop():
    r = np.random.default_rng(27)
    a = np.array([0, 2, 3], np.uint8)[r.integers(0, 3, (40, 133))]
    labels = [(1 + r.choice(9, r.integers(0, 3), replace=False)).tolist() for _ in a]
    x, y = substring_dedup.in_step(a, a, labels, labels, True)
    want = {(i, j) for i in range(40) for j in range(i + 1, 40) if ((a[i] == a[j]) & (a[i] > 0)).sum() >= substring_dedup.IN_STEP and not set(labels[i]) & set(labels[j])}
    assert {(i, j) for i, j in zip(x.tolist(), y.tolist())} == want and 0 < len(want) < 780


def test_runs_that_many_documents_share_are_linked_by_neighbours(spark, monkeypatch):
    """90 documents with a run of one word, of other lengths: each is compared with a few others, not with all."""
    r = random.Random(28)
    long = {i: 50 + (7 * i) % 19 for i in range(1, 91)}
    own = lambda: [f"w{r.getrandbits(40)}" for _ in range(40)]
    docs = {i: own() + ["so"] * n + own() for i, n in ({0: 40} | long).items()}
    pairs, whole = [], substring_dedup.written

    def counted(df, label, *more):
        out = whole(df, label, *more)
        if label == "pairs":
            pairs.append(out.count())
        return out

    monkeypatch.setattr(substring_dedup, "written", counted)
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id bigint, text string")
    got = {x.doc_id: x.n_repeated for x in substring_dedup.report(d).collect()}
    assert got == {0: 0} | {i: min(n, max(m for j, m in long.items() if j != i)) for i, n in long.items()}
    assert pairs and pairs[0] <= 4 * len(docs)


def test_neighbours_cover_what_any_other_row_shares():
    r = np.random.default_rng(29)
    side, width = substring_dedup.SIDE, 2 * substring_dedup.SIDE + substring_dedup.K
    rows = r.integers(2, 256, (5, width)).astype(np.uint8)[r.integers(0, 5, 60)]
    for row in rows:
        lo, hi = r.integers(0, side), r.integers(side + substring_dedup.K, width + 1)
        row[:lo], row[hi:] = r.integers(0, 256, lo), 0 if r.random() < 0.2 else r.integers(0, 256, width - hi)
    docs = r.integers(0, 25, 60)
    pairs = substring_dedup.neighbours(rows, docs)

    def covered(i, others):
        out = set()
        for j in (j for j in others if docs[j] != docs[i]):
            back, on = substring_dedup.runs(((rows[i] == rows[j]) & (rows[i] > 0))[None])
            if back[0] + on[0] >= substring_dedup.MIN_WORDS:
                out |= set(range(side - back[0], side + on[0]))
        return out

    assert 0 < len(pairs) < 300
    for i in range(60):
        assert covered(i, set(range(60)) - {i}) == covered(i, [b if a == i else a for a, b in pairs if i in (a, b)])


def test_what_is_left_out_around_a_seed_holds_no_passage():
    r = np.random.default_rng(30)
    side, k, width = substring_dedup.SIDE, substring_dedup.K, 2 * substring_dedup.SIDE + substring_dedup.K
    rows = r.random((300, width)) < r.choice([0.3, 0.6, 0.75, 0.85, 0.95], (300, 1))
    rows[:, side : side + k] = True
    rows[::2, 100:] = False
    want = [any(v[x] and v[y - 1] and 100 * v[x:y].sum() >= 80 * (y - x) for x in range(side + 1) for y in range(max(side + k, x + 50), width + 1)) for v in rows]
    got = substring_dedup.possible(rows)
    assert got[want].all() and 0 < sum(want) and not got.all()


def test_seeds_of_pairs_are_joined_as_in_a_loop():
    r = np.random.default_rng(31)
    h, g = r.integers(-5, 5, 300), r.integers(-5, 5, 200)
    of, to = np.sort(r.integers(0, 20, 300)), np.sort(r.integers(0, 20, 200))
    x, y = substring_dedup.joined(h, of, g, to)
    assert sorted(zip(x.tolist(), y.tolist())) == [(i, j) for i in range(300) for j in range(200) if h[i] == g[j] and of[i] == to[j]]


def test_passages_with_every_eighth_word_changed(spark):
    r = random.Random(12)
    docs = []
    for _ in range(12):
        p = prose(r, 100)
        docs += [prose(r, 50) + p + prose(r, 50), prose(r, 70) + [f"changed{k}" if k % 8 == 7 else w for k, w in enumerate(p)] + prose(r, 50)]
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id bigint, text string")
    got = {x.doc_id: x for x in substring_dedup.report(d).collect()}
    assert [got[i].partners for i in range(24)] == [[i ^ 1] for i in range(24)]


def test_archives(spark, sf, tmp_path):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    more = [(7001, "http://a.example.com/x?q=1#f", "z" * 99), (7002, "http://a.example.com/x?q=1", "z" * 99), (7003, None, None), (7004, "not a url\n", "y" * 100), (7005, "", "y" * 100), (None, "http://b/", "WARC/1.1\r\n\r\n" * 20), (7006, "http://b/", "w" * (17 << 20)), (7005, "", "y" * 100)]
    d = pages.union(spark.createDataFrame(more, "page_id bigint, url string, html string"))
    d = d.union(pages.where("page_id % 9 = 4").withColumn("page_id", F.col("page_id") + 5000)).withColumn("digest", F.lit("clash"))
    rows = d.collect()
    first = {}
    for r in rows:
        p = (r.html or "").encode()
        if len(p) >= 100 and r.page_id is not None:
            first[p] = min(first.get(p, r.page_id), r.page_id)
    want = []
    for r in rows:
        p = (r.html or "").encode()
        own = first.get(p, r.page_id) == r.page_id
        want.append((str(r.page_id), len(p), sha256(p).hexdigest(), "response" if own else "revisit", None if own else first[p]))
    got = warc.round_trip(d)
    assert sorted(((str(r.page_id), *list(r)[1:]) for r in got.collect()), key=str) == sorted(want, key=str)
    _, index = warc.archive(d)
    ix = warc.Index(spark, index)
    some = [r for r in rows if r.url][:20]
    for r in some:
        pages_of = sorted("" if x.page_id is None else str(x.page_id) for x in rows if warc.reversed_host_key(x.url or "") == warc.reversed_host_key(r.url))
        assert sorted(f.get("Page-Id", "") for f, _ in ix.read(r.url)) == pages_of
    assert ix.find("http://nowhere.example/") == [] and warc.round_trip(d.limit(0)).count() == 0


def test_index_of_small_blocks_and_any_ids(spark, monkeypatch):
    """Many blocks, keys that share a long beginning or go over several blocks, and ids of any characters."""
    r = random.Random(31)
    monkeypatch.setattr(warc, "BLOCK", 3)
    monkeypatch.setattr(warc, "DIRECTORY_KEY", 12)
    urls = [f"http://{h}.example.org/{'p' * 30}{i % 7}" for i, h in enumerate("aabbbbbbbbbbbbbbbbcd" * 3)] + ["", None, "http://b.example.org/"]
    ids = ["", None, "b\r\nX: y", "a%20b", "\t", "é 漢"] + [f"id{i}" for i in range(len(urls) - 6)]
    rows = [(i, u, "same " * 40 if k % 3 else "x" * r.randint(0, 200)) for k, (i, u) in enumerate(zip(ids, urls))]
    d = spark.createDataFrame(rows, "page_id string, url string, html string")
    first = {}
    for i, _, p in rows:
        if len(p) >= 100 and i is not None:
            first[p] = min(first.get(p, i), i)
    want = [(i, len(p), "response" if first.get(p, i) == i else "revisit", None if first.get(p, i) == i else first[p]) for i, _, p in rows]
    got = [(x.page_id, x.payload_bytes, x.record_type, x.refers_to) for x in warc.round_trip(d).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    _, index = warc.archive(d)
    ix = warc.Index(spark, index)
    assert len(ix.ids) > 15
    some = spark.createDataFrame([(u,) for u in [urls[0], urls[4], urls[4], "http://none.example/", None]], "url string")
    same = lambda u: sum(warc.reversed_host_key(v or "") == warc.reversed_host_key(u or "") for v in urls)
    assert ix.captures(some).count() == same(urls[0]) + same(urls[4]) + same(None)
    assert [len(ix.find(u)) for u in (urls[0], urls[4], "")] == [same(urls[0]), same(urls[4]), same(None)]


def shared_runs(docs, least):
    """Words of each document that stand in a run of least or more words of another one, by comparing all runs."""
    where = defaultdict(set)
    for i, w in docs.items():
        for p in range(len(w) - least + 1):
            where[tuple(w[p : p + least])].add((i, p))
    hit = defaultdict(set)
    for places in where.values():
        if len({i for i, _ in places}) > 1:
            for i, p in places:
                hit[i].update(range(p, p + least))
    return {i: len(v) for i, v in hit.items()}


def test_exact_passages_against_brute_force(spark):
    """Runs of 50 and more words whose parts (halves, thirds, quarters) stand in other documents too; nothing else repeats."""
    r = random.Random(21)
    docs = []
    for k in range(60):
        whole = prose(r, r.choice([50, 51, 55, 60, 75, 90, 120, 200]))
        parts = k % 4 + 1
        if parts > 1:
            cut = [i * len(whole) // parts for i in range(parts + 1)]
            docs += [prose(r, r.randint(0, 60)) + whole[a:b] + prose(r, r.randint(0, 60)) for a, b in zip(cut, cut[1:]) for _ in range(r.randint(1, 3))]
        docs += [prose(r, r.randint(0, 90)) + whole + prose(r, r.randint(0, 90)) for _ in range(r.randint(2, 5))]
    docs += [prose(r, 20) + ["again"] * 70 + prose(r, 30) for _ in range(3)]
    named = {f"d{i:03}": w for i, w in enumerate(docs)}
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in named.items()], "doc_id string, text string")
    got = {x.doc_id: x.n_repeated for x in substring_dedup.report(d).collect()}
    want = shared_runs(named, 50)
    assert len(want) > 150
    # a passage is aligned with its anchor, so a word beside it that two other holders share by chance can be missing
    assert all(got[i] >= n - 2 for i, n in want.items()), {i: (got[i], n) for i, n in want.items() if got[i] < n - 2}
    assert sum(got[i] < n for i, n in want.items()) <= 4
    assert all(not n or i in want or n < 60 for i, n in got.items()) and sum(n > 0 for i, n in got.items() if i not in want) <= 3


def test_fuzzy_passages_against_known_ones(spark):
    """Passages with a tenth to a sixth of their words changed, inserted or left out, at random places; copies of parts elsewhere."""
    r = random.Random(22)
    docs, pairs = [], []
    for k in range(80):
        whole = prose(r, r.choice([80, 120, 200]))
        if k % 2:
            docs += [prose(r, 30) + whole[: len(whole) // 2] + prose(r, 30), prose(r, 30) + whole[len(whole) // 2 :]]
        changed = []
        for w in whole:
            x = r.random() * (10 if k % 3 else 6)
            changed += ["new" + w] if x < 0.6 else [w, "more" + w] if x < 0.8 else [] if x < 1 else [w]
        pairs.append((len(docs), len(whole), k))
        docs += [prose(r, 40) + whole + prose(r, 40), prose(r, 40) + changed + prose(r, 40)]
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id bigint, text string")
    got = {x.doc_id: x for x in substring_dedup.report(d).collect()}
    lost = [(n, k % 2, k % 3) for i, n, k in pairs if min(got[i].n_repeated, got[i + 1].n_repeated) < min(50, 0.6 * n)]
    assert len(lost) <= 0.1 * len(pairs), lost


def test_long_gaps_and_long_ends_are_aligned():
    r = random.Random(23)
    a = [str(r.random()) for _ in range(300)]
    b = list(a)
    for i in r.sample(range(300), 60):
        b[i] = "x" + b[i]
    assert substring_dedup.equal_words(a, b) == 240 and substring_dedup.equal_words(a, a[7:] + ["z"] * 400) == 293
    assert substring_dedup.equal_words(a, ["y"] * 300) == 0 and substring_dedup.equal_words(a[:9], a[3:20]) == 6


def test_ids_with_several_texts_and_repeated_rows(spark):
    r = random.Random(24)
    p = prose(r, 60)
    one, two, three = (" ".join(prose(r, 30) + p + prose(r, 30)) for _ in range(3))
    other = " ".join(prose(r, 80))
    d = spark.createDataFrame([(1, one), (1, one), (2, two), (2, other), (7, three), (None, three), (None, None), (8, "")], "doc_id bigint, text string")
    got = sorted(((x.doc_id, x.n_repeated, x.class_id, tuple(x.partners)) for x in substring_dedup.report(d).collect()), key=repr)
    ones = [g for g in got if g[0] == 1]
    assert len(got) == 8 and len(ones) == 2 and all(60 <= g[1] <= 62 for g in ones)
    assert sorted(g[1] > 0 for g in got if g[0] == 2) == [False, True]
    assert [g[1] > 0 for g in got if g[0] == 7] == [True] and {g[2] for g in got if g[1] and g[0] in (None, 7)} == {7}


def test_repeated_rows_of_one_text(spark):
    """Every row of an id has its document's passages; an id that stands twice is no partner of itself."""
    r = random.Random(25)
    p = prose(r, 70)
    docs = [(i, " ".join(prose(r, 30) + p + prose(r, 30))) for i in range(3)]
    d = spark.createDataFrame(docs + docs[:2] + [(5, " ".join(prose(r, 99)))] * 2, "doc_id int, text string")
    got = [(x.doc_id, x.n_repeated, x.partners) for x in substring_dedup.report(d).collect()]
    assert sorted((i, n > 0) for i, n, _ in got) == [(0, True), (0, True), (1, True), (1, True), (2, True), (5, False), (5, False)]
    assert all(i not in partners for i, _, partners in got)
