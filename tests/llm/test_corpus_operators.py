"""The corpus operators against brute force, over rows with nulls, empty and long texts, ties, repeats and clashing names."""

import hashlib
import html.parser
import itertools
import random
import struct
import time
import zlib

import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from quarry.llm import common, fingerprint, html_text, line_dedup, mixing, ngram_join, packing, shards, topk, toxicity, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, h string, size string, pos string, key string, rep string, label string, row string, th string, norm string, h1 string"
WORDS = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa", "lambda", "mu"]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "n", "s", "ion"]) for _ in range(n))


def texts():
    rng = random.Random(5)
    base = [prose(rng, rng.randint(5, 120)) + ".\n" + prose(rng, 30) + "." for _ in range(14)]
    near = base[0].replace("alpha", "alphax", 1)
    out = [*base, base[0], base[0], near, base[1] + " more", base[1].upper(), None, "", " \n\t ", "one", "one two", "ONE  two", prose(rng, 9000), "é́ ß Σ 漢字, <|endoftext|> ...", "a\x1cb c\x0bd"]
    return out


def frame(spark, rows=None, extra=None):
    rows = texts() if rows is None else rows
    data = [(i * 3, t, None if i % 4 == 0 else "en", None if i % 5 == 0 else f"s{i % 3}", None if t is None else len(t), *["x"] * 11) for i, t in enumerate(rows)]
    if rows:
        data += [data[2], (None, "null id alpha beta gamma delta", None, None, 1, *[None] * 11)]
    return spark.createDataFrame(data + (extra or []), SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in regex.split(r"[\x20\x09-\x0D]+", low) if w]


def brute_groups(pairs, k, num, den):
    """Component of each id of (id, text)."""
    sets = {}
    for i, t in pairs:
        w = words_of(t)
        sets[i] = {tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    home = {i: i for i in sets}

    def root(x):
        while home[x] != x:
            x = home[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        inter = len(sets[a] & sets[b])
        if sets[a] and sets[b] and den * inter >= num * (len(sets[a]) + len(sets[b]) - inter):
            x, y = root(a), root(b)
            home[max(x, y)] = min(x, y)
    return {i: root(i) for i in sets}, {i: len(s) for i, s in sets.items()}


@pytest.mark.parametrize(("k", "num", "den", "chunk"), [(3, 9, 10, 500_000), (5, 4, 5, 300)])
def test_ngram_join(spark, docs, empty, k, num, den, chunk):
    rng = random.Random(k)
    near = [prose(rng, 60)]
    for _ in range(25):  # a chain of small changes, so that groups hold sets that aren't linked themselves
        w = near[-1].split()
        w[rng.randrange(len(w))] = rng.choice(WORDS)
        near.append(" ".join(w))
    more = docs.unionByName(spark.createDataFrame([(1000 + i, t, None, None, None, *["y"] * 11) for i, t in enumerate(near)], SCHEMA))
    got = ngram_join.similar_groups(more, k, num, den, chunk).collect()
    rows = [(r.doc_id, r.text) for r in more.collect()]
    assert len(got) == len(rows)
    want, size = brute_groups([r for r in rows if r[0] is not None], k, num, den)
    for r in got:
        assert r.component_id == want.get(r.doc_id)
        assert r.doc_id is None or r.n_shingles == size[r.doc_id]
    if k == 3:
        assert ngram_join.similar_groups(empty, k, num, den).count() == 0
        assert ngram_join.one_of_each_group(empty, k, num, den).columns == empty.columns


def test_rows_of_one_id_are_one_node(spark):
    rng = random.Random(31)
    x, y, z = (prose(rng, 40) for _ in range(3))
    rows = [(3, x), (5, x), (5, y), (9, y), (11, z), (11, ""), (12, z), (13, None), (14, None), (12, z)]
    data = spark.createDataFrame([(i, t, None, None, None, *["x"] * 11) for i, t in rows], SCHEMA)
    got = {r.doc_id: r.component_id for r in ngram_join.similar_groups(data, 3, 9, 10).collect()}
    assert got == {3: 3, 5: 3, 9: 3, 11: 11, 12: 11, 13: 13, 14: 14}
    assert ngram_join.similar_groups(data, 3, 9, 10).count() == len(rows)
    assert sorted(r.doc_id for r in ngram_join.one_of_each_group(data, 3, 9, 10).collect()) == [3, 11, 13, 14]


def test_token_sets_go_to_pairs_that_may_link(spark, monkeypatch):
    """A phrase of many documents gives them signatures in common, which alone must not have their sets sent."""
    rng = random.Random(17)
    fresh = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    phrase = fresh(30)
    rows = [(i, f"{fresh(40 + i % 7)} {phrase} {fresh(30)}") for i in range(150)]
    rows += [(1000 + i, t.replace(t.split()[5], "other")) for i, t in rows[:5]]
    sent = []
    write = ngram_join.materialise

    def counted(df, *args, **kwargs):
        out = write(df, *args, **kwargs)
        if "tokens" in out.columns:
            sent.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "materialise", counted)
    data = spark.createDataFrame(rows, "doc_id long, text string")
    want, _ = brute_groups(rows, 5, 4, 5)
    assert {r.doc_id: r.component_id for r in ngram_join.similar_groups(data, 5, 4, 5).collect()} == want
    assert sum(sent) <= 20
    assert sum(i != c for i, c in want.items()) == 5


@pytest.mark.parametrize("direct", [64, 1])
def test_chains_by_pairs_and_by_trees(spark, direct):
    rng = random.Random(23)
    rows = []
    for n in (12, 40):  # neighbours link, ends of a chain don't
        w = prose(rng, n).split()
        for _ in range(20):
            w[rng.randrange(len(w))] = f"w{rng.randrange(50)}"
            w += [f"w{rng.randrange(50)}"] * (rng.random() < 0.3)
            rows.append((len(rows) * 7 % 41, " ".join(w)))
    data = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.similar_groups(data, 3, 4, 5, 2000, direct).collect()}
    assert got == brute_groups(rows, 3, 4, 5)[0]


def test_parities_refute_no_link(spark):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(400):
        a = np.unique(rng.integers(0, 2**63, rng.integers(1, 300)).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.integers(0, len(a) // 6 + 1) :], rng.integers(0, 2**63, rng.integers(0, len(a) // 6 + 2)).astype(np.uint64)]))
        rows.append((len(a), len(b), ngram_join.parities(a).tolist(), ngram_join.parities(b).tolist(), len(np.intersect1d(a, b))))
    data = spark.createDataFrame(rows, "na long, nb long, oa array<long>, ob array<long>, both int")
    for num, den in ((9, 10), (4, 5), (2, 5)):
        t = ngram_join.Threshold(num, den)
        for r in data.withColumn("may", F.expr(ngram_join._may_link(t))).collect():
            assert r.may or not t.similar(r.both, r.na, r.nb)
    assert len({len(r[2]) == len(r[3]) for r in rows}) == 2


def test_signature_tree_finds_what_all_pairs_find():
    rng = np.random.default_rng(3)
    t = ngram_join.Threshold(7, 10)
    sets = []
    for _ in range(60):
        if sets and rng.random() < 0.5:
            base = sets[rng.integers(len(sets))]
            sets.append(np.unique(np.concatenate([base[rng.random(len(base)) < 0.9], rng.integers(0, 500, 3).astype(np.uint64)])))
        else:
            sets.append(np.unique(rng.integers(0, 500, rng.integers(3, 60)).astype(np.uint64)))
    home = list(range(60))

    def root(h, x):
        while h[x] != x:
            x = h[x]
        return x

    for a, b in itertools.combinations(range(60), 2):
        if t.similar(len(np.intersect1d(sets[a], sets[b])), len(sets[a]), len(sets[b])):
            home[root(home, b)] = root(home, a)
    got = list(range(60))
    for a, b in ngram_join.tree_links(sets, list(range(60)), t):
        got[root(got, b)] = root(got, a)
    same = lambda h: {frozenset(j for j in range(60) if root(h, j) == root(h, i)) for i in range(60)}
    assert same(home) == same(got)
    sides = [i % 2 for i in range(60)]
    links = ngram_join.tree_links(sets, list(range(60)), t, sides)
    assert all(sides[a] != sides[b] for a, b in links)


def test_every_similar_pair_shares_a_signature():
    rng = np.random.default_rng(1)
    for num, den in ((9, 10), (4, 5), (1, 2)):
        t = ngram_join.Threshold(num, den)
        for _ in range(300):
            a = np.unique(rng.integers(0, 2**63, rng.integers(1, 80)).astype(np.uint64))
            gone = rng.integers(0, len(a) * (den - num) // den + 1)
            b = np.unique(np.concatenate([a[gone:], rng.integers(0, 2**63, rng.integers(0, 3)).astype(np.uint64)]))
            if t.similar(len(np.intersect1d(a, b)), len(a), len(b)):
                assert np.intersect1d(t.signatures(a), t.signatures(b)).size


def test_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)] + [(7, 7), (None, 3)]
    home = {}

    def root(x):
        while home.setdefault(x, x) != x:
            x = home[x]
        return x

    for a, b in pairs:
        if a is not None and a != b:
            x, y = root(a), root(b)
            home[max(x, y)] = min(x, y)
    got = common.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == {x: root(x) for x in list(home)} and len(got) == len(home)


def test_top_products(spark):
    rng = np.random.default_rng(0)
    vectors = [(i, [float(x) for x in rng.normal(size=6) * rng.choice([0.01, 1, 30])]) for i in range(260)]
    vectors += [(900, vectors[3][1]), (901, vectors[3][1]), (300, None), (400, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (500, [float("nan")] * 6), (600, [float("inf")] * 6), (None, vectors[0][1]), (700, [0.0] * 6), (800, [1e30] * 6), (1000, [1.0, 2.0]), (1100, []), (200, vectors[200][1])]
    df = spark.createDataFrame([(*v, "q", 1) for v in vectors], "vec_id long, embedding array<double>, norm string, dim int")
    got = topk.top_products(df, F.col("vec_id") % 100 == 0, 10, bucket=16, block=2).select("query_id", "rank", "vec_id", "score").collect()
    ok = [(i, v) for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    whole = {j: [int(np.floor(1024 * x)) for x in v] for j, (_, v) in enumerate(ok)}
    want = []
    for j, (i, v) in enumerate(ok):
        if i % 100 == 0:
            scores = sorted(((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(whole[j], whole[m], strict=True)))), c) for m, (c, u) in enumerate(ok) if c != i and len(u) == len(v)))[:10]
            want += [(i, c, -s) for s, c in scores]
    # a repeated query row asks once
    assert {(r.query_id, r.vec_id, r.score) for r in got} == set(want) and len(got) == len(set(want))
    assert topk.top_products(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_pruning_keeps_every_row_that_can_score():
    rng = np.random.default_rng(4)
    for _ in range(200):
        v = rng.normal(size=(50, 8)) * rng.choice([0.5, 1, 2], size=(50, 1))
        norms = np.sqrt((v**2).sum(1))
        order = np.argsort(-norms)
        v, norms = v[order], norms[order]
        q = rng.normal(size=8)
        score = v @ q
        theta = float(np.sort(score)[-rng.integers(1, 12)])
        keep = topk.bucket_search(q, float(np.sqrt((q**2).sum())), theta, v / norms[:, None], norms, 6)
        assert set(np.flatnonzero(score >= theta)) <= set(keep)


@pytest.mark.parametrize("dims", [1, 2, 8])
@pytest.mark.parametrize("sparse", [False, True])
def test_pruning_keeps_rows_near_a_dominant_component(dims, sparse):
    rng = np.random.default_rng(dims)
    for _ in range(200):
        q = np.zeros(dims)
        q[rng.integers(dims)] = rng.choice([-1.0, 1.0])
        if not sparse:
            q += 0.2 * rng.normal(size=dims)
        v = q + rng.choice([0.05, 0.3, 1]) * rng.normal(size=(60, dims))
        norms = np.sqrt((v**2).sum(1))
        order = np.argsort(-norms)
        v, norms = v[order], norms[order]
        score = v @ q
        theta = float(np.sort(score)[-rng.integers(1, 12)])
        keep = topk.bucket_search(q, float(np.sqrt((q**2).sum())), theta * (1 - 1e-12), v / norms[:, None], norms, 6)
        assert set(np.flatnonzero(score >= theta)) <= set(keep)


def test_top_products_of_sparse_vectors_over_many_buckets(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in np.eye(4)[i % 4] * rng.uniform(0.5, 2) + (rng.random(4) < 0.3) * rng.normal(size=4) * 0.3]) for i in range(400)]
    rows += [(1000 + i, [float(x) for x in np.eye(4)[i]]) for i in range(4)]
    got = topk.top_products(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") >= 1000, 10, bucket=16, block=2).collect()
    whole = {i: np.floor(1024 * np.array(v)).astype(int) for i, v in rows}
    want = {(i, c, -s) for i in range(1000, 1004) for s, c in sorted((-int(whole[i] @ whole[c]), c) for c in whole if c != i)[:10]}
    assert {(r.query_id, r.vec_id, r.score) for r in got} == want


def brute_digests(text):
    """Pieces as the docstring of digests says, by hashes of the xxhash package."""
    spark_hash = lambda b, seed=42: xxhash.xxh64_intdigest(b, seed)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    text = regex.sub(r"(?<=\S{16})(?=\S{16})", " ", text) if regex.search(r"\S{33}", text) else text
    words = [w + "\n" if signed(spark_hash(w.encode())) % fingerprint.CUT == 0 else w for w in text.split(" ")]
    return {signed(spark_hash(x.encode())) for p in regex.split(r"\n+", " ".join(words)) if (x := p.strip(" "))}


def peel_texts(one, other):
    """Digests that either sketch has alone, from the texts of two fingerprints; None if they can't be peeled."""

    def of(text):
        n, c, cells = text.split(";")
        return int(n), int(c), [(int(p), int(k), int(x, 16), int(y, 16)) for p, k, x, y in (e.split(":") for e in cells.split(",") if e)]

    def place(x, part, c):
        h = xxhash.xxh64_intdigest(struct.pack("<i", part), xxhash.xxh64_intdigest(struct.pack("<Q", x), 42))
        return part * c + (h - (1 << 64) if h >> 63 else h) % c

    def check(x):
        return xxhash.xxh64_intdigest(struct.pack("<i", 99), xxhash.xxh64_intdigest(struct.pack("<Q", x), 42)) & 0xFFFFFFFF

    sides = [of(one), of(other)]
    c = min(s[1] for s in sides)
    table = {}
    for sign, (_, own, cells) in zip((1, -1), sides, strict=True):
        for p, k, x, y in cells:
            at = p // own * c + p % own % c
            a = table.get(at, (0, 0, 0))
            table[at] = (a[0] + sign * k, a[1] ^ x, a[2] ^ y)
    found, moved = (set(), set()), True
    while moved:
        moved = False
        for at, (k, x, y) in list(table.items()):
            if abs(k) == 1 and table[at] == (k, x, y) and check(x) == y and place(x, at // c, c) == at:
                found[k < 0].add(x)
                for part in range(3):
                    a = table.get(place(x, part, c), (0, 0, 0))
                    table[place(x, part, c)] = (a[0] - k, a[1] ^ x, a[2] ^ y)
                moved = True
    return found if all(v == (0, 0, 0) for v in table.values()) else None


def test_fingerprints(spark, docs, empty):
    rng = random.Random(77)
    long = prose(rng, 60_000)
    han = "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(3000))
    more = docs.unionByName(spark.createDataFrame([(7000 + i, t, None, None, None, *["x"] * 11) for i, t in enumerate([long, long[:-500], han, han[:1500] + "x" + han[1500:], prose(rng, 400)])], SCHEMA))
    out = fingerprint.fingerprint_documents(more).collect()
    got = {(r.doc_id, r.n_chars, r.edited_sha256): r for r in out}
    rows = sorted({(r.doc_id, r.text or "") for r in more.collect()}, key=lambda r: (r[0] is not None, r[0] or 0))
    jaccard = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
    peeled = 0
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        k = len(t) // 4
        edited = t[: len(t) - k] + after[:k]
        r = got[(i, len(t), hashlib.sha256(edited.encode()).hexdigest())]
        a, b, n = map(brute_digests, (t, edited, after))
        assert r.near_edited == pytest.approx(jaccard(a, b)) and r.near_next == pytest.approx(jaccard(a, n))
        assert r.fingerprint.split(";")[0] == str(len(a)) and r.edited_fingerprint.split(";")[0] == str(len(b))
        if (both := peel_texts(r.fingerprint, r.edited_fingerprint)) is not None:
            peeled += 1
            only = tuple(len(x) for x in both)
            assert only == (len(a - b), len(b - a)) and r.near_edited == pytest.approx((len(a) - only[0]) / (len(a) + only[1]) if a or b else 1.0)
    assert peeled >= 0.7 * len(rows)
    near = {r.doc_id: r for r in out}
    assert near[7000].near_next > 0.95 and near[7002].near_next > 0.95 and near[7000].near_edited > 0.5
    prints = {}
    text_of = {(i, len(t)): t for i, t in rows}
    for r in out:
        prints.setdefault(text_of[r.doc_id, r.n_chars], set()).add(r.fingerprint)
    assert all(len(p) == 1 for p in prints.values())
    assert len(out) == more.count()
    assert fingerprint.fingerprint_documents(empty).count() == 0


def test_sketches_recover_differences(spark):
    rng = random.Random(9)
    rows = []
    for i in range(40):
        a = rng.sample(range(10**9), rng.randint(0, 200))
        b = a[rng.randint(0, len(a)) :] + rng.sample(range(10**9), rng.randint(0, 90))
        rows.append((i, a, list(dict.fromkeys(b)), rng.sample(range(10**9), rng.randint(0, 50))))
    df = spark.createDataFrame(rows, "rid long, a array<long>, b array<long>, n array<long>")
    want = {(i, x, 1) for i, a, b, _ in rows for x in set(a) - set(b)} | {(i, x, -1) for i, a, b, _ in rows for x in set(b) - set(a)}
    assert {tuple(r) for r in fingerprint.differing_digests(df, 0.25).collect()} == want  # small sketches: retries must happen
    for scale, tries in ((0.5, 6), (0.01, 1)):  # retried, and settled from the sets
        found = {r.rid: r for r in fingerprint.compare(df, scale, tries).collect()}
        for i, a, b, n in ((i, *map(set, x)) for i, *x in rows):
            own = (len(a - b), len(b - a), len(a - n), len(n - a))
            assert (i not in found and own == (0, 0, 0, 0)) or tuple(found[i])[1:] == own


def test_repeated_ids_lend_one_text(spark):
    rng = random.Random(5)
    rows = [(i, prose(rng, 30) + (" you scumbag" if i % 5 == 0 else "")) for i in range(300)]
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(300)], "doc_id long, quality int, toxic int")
    once = spark.createDataFrame(rows, "doc_id long, text string")
    more = [(1, rows[1][1] + f" zz {n}") for n in range(400)] + [(1, rows[1][1])] * 300 + [(10, None)]
    often = once.unionByName(spark.createDataFrame(more, "doc_id long, text string")).repartition(5)
    a, b = toxicity.train(once, labels), toxicity.train(often, labels)
    assert len(a.features) and a.features.tolist() == b.features.tolist() and a.weights.tolist() == b.weights.tolist() and a.bias == b.bias


def test_toxicity(spark, docs, empty):
    rng = random.Random(1)
    rows, marks = [], []
    for i in range(600):
        bad = i % 8 == 0
        t = prose(rng, 40)
        rows.append((i, t + (" you " + rng.choice(["idiot", "scumbag", "trashy"]) if bad else ""), None, None, None, *["x"] * 11))
        if i % 2 == 0:
            marks.append((i, 1, int(bad)))
    data = spark.createDataFrame(rows, SCHEMA).unionByName(docs.withColumn("doc_id", F.col("doc_id") + 10_000))
    labels = spark.createDataFrame([*marks, marks[0], (None, 1, 1), (2, 1, None)], "doc_id long, quality int, toxic int")
    got = toxicity.score_documents(data, labels).collect()
    assert len(got) == data.count()
    by = {r.doc_id: r for r in got if r.doc_id is not None and r.doc_id < 600}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(by[i].held_out == (i in set(held)) and 0 <= by[i].score <= 1 and by[i].predicted == int(by[i].score >= 0.5) for i in range(600))
    assert sum(by[i].predicted == int(i % 8 == 0) for i in held) >= 0.95 * len(held)
    kept = toxicity.drop_toxic(data, labels)
    assert kept.columns == data.columns and kept.count() == sum(r.predicted == 0 for r in got)
    assert toxicity.score_documents(empty, labels).count() == 0
    assert all(r.score < 0.5 for r in toxicity.score_documents(docs, labels.limit(0)).collect())


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("plain & simple &amp; text", "plain & simple & text"),
        ("<p>a<p>b", "a\n\nb"),
        ("<title>t</title><body><h1>H</h1>x<br>y<div>z</div>", "H\n\nx\ny\nz"),
        ("<ul><li>a<li>b<ul><li>c</ul></ul>", "- a\n- b\n  - c"),
        ("<ol start=9><li>a<li>b</ol>", "9. a\n10. b"),
        ("<table><tr><th>k<th>v<tr><td>long<td>1</table>", "k     v\nlong  1"),
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a  b\n   c"),
        ("<div style='display: none'>no</div><b hidden>no</b>yes<script>no()</script><!-- no -->", "yes"),
        ("<p style='visibility:hidden'>no <i style='visibility:visible'>yes</i></p>", "yes"),
        ("<pre>\n a\n  b</pre>", " a\n  b"),
        ("<details><summary>s</summary>hidden</details><details open><summary>t</summary>shown</details>", "s\nt\nshown"),
        ("</p>a</div></td>b<<c", "ab<<c"),
        ("<div>" * 3000 + "deep", "deep"),
        ("<a href='x>y'>l</a> <td>c", "l c"),
        ("<style>/* x */ .h, #i{display:none} p.v{visibility:hidden}</style><b class='a h'>no</b><b id=i>no</b><p class=v>no<p class=h style='display:block'>yes", "yes"),
        ("<table><tr><td colspan=2>a long title<td>x<tr><td>k<td>v<td>y</table>", "a long title  x\nk  v          y"),
        ('<p title="a>b">c</p><i "d>e</i>', "c\n\ne"),
        ("x<b y", "x<b y"),
    ],
)
def test_page_text(page, text):
    assert html_text.render(page) == text


@pytest.mark.parametrize("piece", ["<a ", "<a '", '<a ">" ', "<!", "<!--", "<a x='", "<td>", "</p>", "&lt;", "<p a=b "])
def test_long_broken_pages_take_linear_time(piece):
    start = time.perf_counter()
    html_text.render(piece * (300_000 // len(piece)))
    assert time.perf_counter() - start < 10


class Words(html.parser.HTMLParser):
    """Visible words of a page, by the standard library's parser."""

    def __init__(self):
        super().__init__()
        self.out, self.skip = [], []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in ("script", "style", "title", "noscript", "template", "svg") or "hidden" in a or "display:none" in (a.get("style") or "").replace(" ", ""):
            self.skip.append(tag)
        elif self.skip and tag == self.skip[-1]:
            self.skip.append(tag)

    def handle_endtag(self, tag):
        if self.skip and tag == self.skip[-1]:
            self.skip.pop()

    def handle_data(self, data):
        if not self.skip:
            self.out += data.split()


def test_pages_have_the_words_another_parser_sees(spark):
    rng = random.Random(4)
    tags = ["p", "div", "li", "b", "td", "section", "h2"]
    for _ in range(60):
        page, open_ = ["<html><head><title>t</title><style>p {color: red}</style></head><body>"], []
        for _ in range(rng.randrange(80)):
            kind = rng.randrange(6)
            if kind == 0:
                open_.append(rng.choice(["div", "section", "span"]))
                page.append(f"<{open_[-1]}{rng.choice(['', ' hidden', ' class=x', ' style=display:none'])}>")
            elif kind == 1 and open_:
                page.append(f"</{open_.pop()}>")
            elif kind == 2:
                page.append(f"<{(t := rng.choice(['p', 'h2', 'li', 'em']))}>{prose(rng, 3)} &amp;</{t}>")
            elif kind == 3:
                page.append("<script>if (a < b) no()</script><!-- no <p> -->")
            elif kind == 4:
                page.append("<table><tr><td>one <td>two</table>" if rng.random() < 0.5 else "<ul><li>item<li>other</ul>")
            else:
                page.append(f" {prose(rng, 2)} <br>")
        seen = Words()
        seen.feed("".join(page))
        got = [w for w in html_text.render("".join(page)).split() if w != "-"]
        assert sorted(got) == sorted(seen.out)


def test_pages(spark):
    named = spark.createDataFrame([(1, "old", "<p>x")], "page_id long, text string, html string")
    assert html_text.render_pages(named).collect() == [(1, "x")]
    df = spark.createDataFrame([(1, "u", "<p>x", "t"), (1, None, None, None)], "page_id long, url string, html string, text2 string")
    out = html_text.render_pages(df).collect()
    assert sorted((r.page_id, r.text) for r in out) == [(1, ""), (1, "x")]
    assert html_text.render_pages(df.limit(0)).count() == 0


def brute_canonical(url):
    """As the docstring of canonical_url says, by urllib's splitting."""
    if url is None:
        return None
    bare = url.strip(" ").split("#")[0]
    scheme, mark, rest = bare.partition("://")
    rest = rest if mark and scheme and scheme.replace("+", "").isalnum() else bare
    before, ask, query = rest.partition("?")
    host, slash, path = before.partition("/")
    host = host.lower().rpartition("@")[2].removeprefix("www.")
    host = host.removesuffix(":80") if host.endswith(":80") else host.removesuffix(":443")
    kept = sorted(p for p in query.split("&") if p and not (p.split("=")[0] in ("ref", "fbclid", "gclid", "sessionid") or p.split("=")[0].startswith("utm_")))
    return host + (slash + path).rstrip("/") + ("?" + "&".join(kept) if kept else "")


def brute_revisits(records):
    from collections import defaultdict

    def low(headers):
        out = {}
        for k in sorted(headers or {}):
            out.setdefault(k.lower(), headers[k])
        return out

    full = defaultdict(list)
    for r in records:
        if r["kind"] == "response" and r["url"] is not None and r["ts"] is not None and r["record_id"] is not None:
            full[brute_canonical(r["url"])].append(r)
    out = []
    for r in records:
        if r["kind"] != "revisit":
            continue
        earlier = [x for x in full.get(brute_canonical(r["url"]), []) if r["ts"] is not None and x["ts"] < r["ts"]]
        if not earlier:
            out.append((r["record_id"], None, "missing", None))
            continue
        best = max(earlier, key=lambda x: (x["ts"], x["record_id"], x["digest"] or ""))
        mine, theirs = low(r["headers"]), low(best["headers"])
        weak = lambda t: None if t is None else t.strip().removeprefix("W/")
        outcome = "unverified"
        for a, b in ((weak(mine.get("etag")), weak(theirs.get("etag"))), (mine.get("last-modified"), theirs.get("last-modified")), (r["digest"], best["digest"])):
            if a is not None and b is not None:
                outcome = "resolved" if a == b else "mismatch"
                break
        merged = theirs | {k: v for k, v in mine.items() if k in warc.PERMITTED} if outcome == "resolved" else None
        out.append((r["record_id"], best["record_id"], outcome, merged and sorted(merged.items())))
    return sorted(out, key=str)


def test_revisits(spark):
    rng = random.Random(3)
    urls = ["http://hot.com/x"] * 12 + ["https://www.hot.com:443/x/?utm_source=1#f", "b.com/y?b=1&a=2", "http://u@B.com/y?a=2&b=1&ref=z", "c.com/z", None]
    records = []
    for i in range(900):
        headers = {"Content-Type": "t", "Date": str(i), "VARY": "v", "vary": "w"}
        if rng.random() < 0.5:
            headers[rng.choice(["etag", "ETag"])] = rng.choice(["a", "W/a", "b"])
        if rng.random() < 0.5:
            headers["Last-Modified"] = rng.choice(["m", "n"])
        records.append({"record_id": rng.choice([i, i, i, 7, None]) if i % 2 else i, "url": rng.choice(urls), "ts": rng.choice([None, *range(300)]), "kind": rng.choice(["response", "revisit", "revisit", "other"]), "headers": rng.choice([headers, headers, headers, None, {}]), "digest": rng.choice([None, "d", "e"]), "key": "k", "part": 1, "full": "x", "last": "y"})
    df = spark.createDataFrame(records, "record_id long, url string, ts long, kind string, headers map<string,string>, digest string, key string, part int, full string, last string")
    shown = lambda rows: sorted(((r.record_id, r.refers_to, r.outcome, r.headers and sorted(r.headers.items())) for r in rows), key=str)
    want = brute_revisits(records)
    assert {w[2] for w in want} == {"missing", "resolved", "mismatch", "unverified"}
    assert shown(warc.resolve_revisits(df).collect()) == want
    timed = df.withColumn("ts", F.timestamp_micros(F.col("ts") + 1_700_000_000_000_001))
    assert shown(warc.resolve_revisits(timed).collect()) == want
    assert warc.resolve_revisits(df.limit(0)).count() == 0
    url = lambda u: spark.createDataFrame([(u,)], "u string").select(warc.canonical_url(F.col("u"))).first()[0]
    assert url("HTTPS://user@WWW.Ex.com:443/a/b/?utm_source=x&b=2&a=1#f") == "ex.com/a/b?a=1&b=2"
    assert url(None) is None
    long = "http://e.com/" + "x" * 100_000
    assert url(long) == long[7:]
    assert spark.createDataFrame([], "page_id long, url string, html string").transform(warc.resolved_pages).count() == 0


def test_shards(spark, docs, empty):
    got = shards.shard_documents(docs, 7).collect()
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    assert sorted((r.doc_id or -1, r.size, r.text_crc32) for r in got) == sorted((i or -1, len(t.encode()) + 16, zlib.crc32(t.encode())) for i, t in rows)
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    order = sorted(got, key=lambda r: (r.shard, r.slot))
    ids = [r.doc_id for r in order]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0)) and all(0 <= r.shard < 7 for r in got)
    even = spark.range(10_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")).alias("text"))
    sizes = [r["s"] for r in shards.shard_documents(even, 40).groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    assert len(sizes) == 40 and max(sizes) - min(sizes) <= 2 * 66
    assert shards.shard_documents(empty).count() == 0


def test_mixing(spark, docs, empty):
    rng = random.Random(8)
    rows = [(i, " ".join(["w"] * rng.randint(0, 300)), None, rng.choice(["a"] * 6 + ["b", "c", "d", None]), None, *["x"] * 11) for i in range(900)]
    data = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix_documents(data).collect()
    assert len(got) == 900 and all(0 <= r.taken <= 2 * r.size for r in got)
    total = sum(r.size for r in got)
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(r[1].split())
    weights = dict(zip(sorted(sizes, key=lambda s: (s is None, s or "")), itertools.cycle((5, 2, 1))))
    target, open_, left = {}, set(sizes), 1.5 * total
    while open_:
        w = sum(weights[s] for s in open_)
        full = {s for s in open_ if left * weights[s] / w > 2 * sizes[s]}
        if not full:
            target |= {s: left * weights[s] / w for s in open_}
            break
        target |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(2 * sizes[s] for s in full)
        open_ -= full
    by = {r[0]: r[3] for r in rows}
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r.target == pytest.approx(target[by[r.doc_id]]) and r.source_size == sizes[by[r.doc_id]]
        taken[by[r.doc_id]] += r.taken
    for s in sizes:
        assert taken[s] == pytest.approx(target[s], rel=0.02)
    assert sorted(tuple(r) for r in got) == sorted(tuple(r) for r in mixing.mix_documents(data.repartition(3)).collect())
    assert all((r.shards is None) == (r.taken == 0) and all(0 <= x < mixing.SHARDS for x in r.shards or ()) for r in got)
    assert {x for r in got for x in r.shards or ()} == set(range(mixing.SHARDS))
    out = mixing.mixed_texts(data)
    assert out.columns == data.columns and sum(len(r.text.split()) for r in out.collect()) == sum(r.taken for r in got)
    edge = mixing.mix_documents(docs)
    assert edge.count() == docs.count() and mixing.mixed_texts(docs).columns == docs.columns
    assert mixing.mix_documents(empty).count() == 0 and mixing.mixed_texts(empty).count() == 0


def test_small_sources_keep_their_share_of_a_large_corpus(spark):
    """At 3.2e9 tokens a common block has about 73,000."""
    rows = [(f"hot{i}", "hot", 3_200_000) for i in range(1000)]
    sizes = {"a": 5_000, "b": 12_000, "c": 20_000, "d": 50_000, "e": 130_000, "f": 400_000, "g": 7}
    rows += [(f"{s}{i}", s, n // 5 + (n % 5 if i == 0 else 0)) for s, n in sizes.items() for i in range(5)]
    got = mixing.mix(spark.createDataFrame(rows, "key string, source string, size long")).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert len(got) == 8
    for r in got:
        assert r.taken == pytest.approx(r.target, rel=0.02), r


def test_seats_are_sainte_lague(spark):
    targets = spark.createDataFrame([(0, 53.0), (1, 24.0), (2, 23.0), (3, 0.0)], "place int, target double")
    got = {(r.place, r.shard): r.seats for r in mixing.seats(targets, shards=4, blocks=20, per_source=1).collect()}
    for k in range(1, 5):
        seats = [0] * 4
        for _ in range(5 * k):
            i = max(range(3), key=lambda i: ([53.0, 24.0, 23.0][i] / (2 * seats[i] + 1), -i))
            seats[i] += 1
        assert [sum(got.get((i, s), 0) for s in range(k)) for i in range(4)] == seats


def test_line_dedup(spark, empty):
    rng = random.Random(6)
    line = lambda n=14: prose(rng, n)
    shared, fuzzy = line(), line(60)
    variants = [fuzzy, fuzzy.upper() + "!!", "42 " + fuzzy + ".", fuzzy.replace(" ", " - ", 3)]
    rows = [(i, "\n".join([line(), shared if i % 2 else line(), variants[i % 4], "short line"]), None, None, None, *["x"] * 11) for i in range(40)]
    rows += [(100, None, None, None, None, *[None] * 11), (101, "", None, None, None, *["x"] * 11), (None, shared, None, None, None, *["x"] * 11), rows[3], (102, shared + "\n" + shared, None, None, None, *["x"] * 11), (103, "z" * 200_000 + " " + line(4000), None, None, None, *["x"] * 11)]
    data = spark.createDataFrame(rows, SCHEMA)
    norm = lambda x: regex.sub(r"[^\p{L}]+", " ", x.lower()).strip()
    seen, want = set(), {}
    for r in sorted({r[:2] for r in rows}, key=lambda r: (r[0] is not None, r[0] or 0)):
        lines = (r[1] or "").split("\n")
        keep = []
        for x in lines:
            long = len(norm(x)) >= 40
            if not (long and norm(x) in seen):
                keep.append(x)
            if long:
                seen.add(norm(x))
        want[r[0]] = None if r[1] is None else "\n".join(keep)
    got = line_dedup.without_repeats(data).select("row.doc_id", "_lines.*").collect()
    assert len(got) == len(rows) and {r.doc_id: r.text for r in got} == want
    out = line_dedup.dedup_lines(data)
    assert out.columns == data.columns and {r.doc_id for r in out.collect()} == {i for i, t in want.items() if i != 102}
    assert line_dedup.dedup_lines(empty).count() == 0


def test_bitmap_keeps_all_keys(spark):
    rows = spark.range(5000).withColumnRenamed("id", "cid")
    keys = rows.where("cid % 7 = 3")
    for bits, most in ((24, 1000), (4, 5000)):
        kept = {r.cid for r in line_dedup.possible(rows, "cid", keys, bits).collect()}
        assert {r.cid for r in keys.collect()} <= kept and len(kept) <= most


def test_few_edges_go_to_few_files(spark):
    """Each file of a local folder starts processes, which count with their executor's memory."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 200, 2)], "a long, b long").repartition(16)
    held = {"spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        got = common.connected_components(edges)
        slim = common.materialise(edges.distinct(), rows=100)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(got.inputFiles()) == 1 and len(slim.inputFiles()) == 1
    assert {r.node: r.component for r in got.collect()} == {i: i - i % 2 for i in range(200)}


def test_pairs_are_split_once(spark):
    """A filter on what is made of a pair's words doesn't repeat the making of it, and holds all pairs within the bound."""
    rng = random.Random(8)
    rows = []
    for i in range(30):
        n = rng.choice([12, 60, 300])
        w = ["".join(rng.choice("abcdef") for _ in range(rng.randint(1, 8))) for _ in range(n)]
        other = list(w)
        for _ in range(rng.randint(0, max(2, n // 6))):
            j = rng.randrange(len(other))
            other[j : j + 1] = rng.choice([[], ["x"], [other[j], "yy"], [other[j] + "z"]])
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(other))]
    texts = spark.createDataFrame(rows, "cid long, norm string")
    pairs = spark.createDataFrame([(2 * i, 2 * i + 1) for i in range(30)], "a long, b long")
    got = line_dedup._verified(pairs, texts, 90)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("split(") == 2
    both = pairs.join(texts.toDF("a", "na"), "a").join(texts.toDF("b", "nb"), "b")
    want = {r.a for r in both.where(line_dedup.alike("na", "nb", 90)).collect()}
    assert {r.a for r in got.collect()} == want and 0 < len(want) < 30


def test_fuzzy_lines(spark):
    rng = random.Random(7)
    base = " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(300))
    words = base.split()
    changed = []
    for i in range(12):
        w = list(words)
        w[i * 7] = "changed"
        changed.append(" ".join(w))
    other = [" ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(300)) for _ in range(12)]
    data = spark.createDataFrame(list(enumerate([base, *changed, *other])), "doc_id long, text string")
    kept = {r.doc_id for r in line_dedup.dedup_lines(data).collect()}
    assert 0 in kept and set(range(13, 25)) <= kept and len(kept & set(range(1, 13))) <= 3
    pair = spark.createDataFrame([("abcd efgh", "abcd efgi")], "a string, b string")
    assert pair.select(line_dedup.alike("a", "b", 88), line_dedup.alike("a", "b", 90)).first() == (True, False)


def test_all_pairs_of_a_block_are_compared(spark):
    """Lines of the same longer words meet in every block, whatever their order and their short words."""
    rng = random.Random(3)
    longer = ["".join(rng.choice("abcdefghij") for _ in range(12)) for _ in range(9)]
    unlike = [" ".join(rng.sample(longer, 9)) for _ in range(10)]
    twin = " ".join(rng.sample(longer, 9))
    short = ["".join(rng.choice("klmnopqr") for _ in range(3)) for _ in range(60)]
    chain = []
    for i in range(6):  # neighbours differ by a tenth of the short words, further ones by more
        chain.append(" ".join([*longer, *["xyz" if j < 6 * i else w for j, w in enumerate(short)]]))
    data = spark.createDataFrame(list(enumerate([*unlike, twin + " ab", twin + " ac", *chain])), "doc_id long, text string")
    kept = {r.doc_id for r in line_dedup.dedup_lines(data).collect()}
    assert kept == {*range(11), 12}


def test_near_lines_meet(spark):
    """Recall over lines of all lengths, with a letter changed and with a twentieth of the words replaced."""
    rng = random.Random(12)
    word = lambda n=None: "".join(rng.choice("abcdefghijklmnopqrst") for _ in range(n or rng.randint(2, 9)))
    rows, kinds = [], []
    for n in (8, 12, 20, 40, 80, 200):
        for _ in range(40):
            w = [word() for _ in range(n)]
            w[0] = word(9)
            one, some = list(w), list(w)
            one[rng.randrange(1, n)] += "z"
            for j in rng.sample(range(1, n), n // 20):
                some[j] = word(len(w[j]))
            kinds += [(n, x) for x in ("first", "letter", "words" if n >= 20 else "")]
            rows += [w, one, some if n >= 20 else [word(12) for _ in range(n)]]
    data = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")
    kept = {r.doc_id for r in line_dedup.dedup_lines(data).collect()}
    assert {i for i, (_, x) in enumerate(kinds) if x in ("first", "")} <= kept
    for n, x in {k for k in kinds if k[1] in ("letter", "words")}:
        own = [i for i, k in enumerate(kinds) if k == (n, x)]
        assert sum(i not in kept for i in own) >= 0.9 * len(own), (n, x)


def test_lines_of_every_kind_are_matched(spark):
    """Scripts without spaces, lines of short words, and letters changed in many words of a long line."""
    rng = random.Random(5)
    han = ["".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(n)) for n in (60, 900)]
    short = " ".join("".join(rng.choice("abcdefghij") for _ in range(3)) for _ in range(30))
    words = ["".join(rng.choice("abcdefghij") for _ in range(9)) for _ in range(80)]
    edited = " ".join(w[:-1] + "z" if j % 9 == 0 else w for j, w in enumerate(words))
    lines = [*han, *(x[:30] + "z" + x[31:] for x in han), short, short[:40] + "z" + short[41:], " ".join(words), edited]
    data = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    assert {r.doc_id for r in line_dedup.dedup_lines(data).collect()} == {0, 1, 4, 6}


def test_packing(spark, docs, empty):
    window = 64
    got = packing.pack_documents(docs, window=window).collect()
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(packing.tokenizer_path())
    want = []
    for r in docs.collect():
        ids = np.array(plain.encode(r.text or "", add_special_tokens=False).ids + [2], "<u4")
        want += [(r.doc_id or -1, a, len(ids[a : a + window]), zlib.crc32(ids[a : a + window].tobytes()), len(ids)) for a in range(0, len(ids), window)]
    assert sorted((r.doc_id or -1, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == sorted(want)
    rows = {}
    for r in got:
        rows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(rows) == list(range(len(rows)))
    for parts in rows.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= window
    assert len(rows) == one_by_one([w[2] for w in want], window)
    assert packing.pack_documents(empty).count() == 0


def one_by_one(lengths, window):
    """Number of windows that best fit decreasing opens, a piece at a time."""
    left = []
    for n in sorted(lengths, reverse=True):
        fits = [(r, i) for i, r in enumerate(left) if r >= n]
        if fits:
            i = min(fits)[1]
            left[i] -= n
        else:
            left.append(window - n)
    return len(left)


def test_batched_best_fit_is_best_fit():
    rng = random.Random(4)
    for _ in range(200):
        window = rng.choice([7, 20, 64])
        lengths = [rng.randint(1, window) for _ in range(rng.randint(0, 80))]
        counts = {n: lengths.count(n) for n in set(lengths)}
        runs = packing.best_fit_decreasing(counts, window)
        used = {}
        for n, _, pieces, first, per, at in runs:
            for i in range(pieces):
                used.setdefault(first + i // per, []).append((at + i % per * n, n))
        assert sum(len(p) for p in used.values()) == len(lengths)
        for parts in used.values():
            at = 0
            for offset, n in sorted(parts):
                assert offset == at
                at += n
            assert at <= window
        assert len(used) == one_by_one(lengths, window)


def test_token_chunks_agree_with_the_tokenizer():
    rng = random.Random(2)
    ids = packing._Ids(packing.tokenizer_path(), room=40)
    for _ in range(4000):
        text = "".join(rng.choice("aB.,' sé1_-\n\t́Σ²|<>ǅİ") for _ in range(rng.randint(0, 14)))
        assert ids.of(text) == np.array(ids.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_shapes_rule_out_unlike_pairs_alone(spark, monkeypatch):
    """Shapes differ in two bits an edit at the most, and few texts of unlike lines of one block are compared."""
    rng = random.Random(4)
    rows = []
    for i in range(300):
        a = [rng.choice("abcdefghijklmnopqrstuvwxyz éß1") for _ in range(rng.randint(40, 400))]
        b, n = list(a), rng.randint(0, 60)
        for _ in range(n):
            j = rng.randrange(len(b))
            b[j : j + 1] = rng.choice([[], ["e"], [b[j], "q"], [b[j], b[j]]])
        rows.append((i, n, "".join(a), "".join(b)))
    pairs = spark.createDataFrame(rows, "id int, n int, a string, b string")
    x, y = (line_dedup.with_shape(pairs.select("id", "n", F.col(c).alias("norm"))) for c in "ab")
    apart = " + ".join(f"bit_count(x.{s} ^ y.{s})" for s in line_dedup.SHAPE)
    got = x.alias("x").join(y.alias("y"), "id").select("x.n", F.expr(apart).alias("d")).collect()
    assert all(r.d <= 2 * r.n for r in got) and sum(r.d for r in got) > sum(r.n for r in got) / 2
    longer = " ".join("".join(rng.choice("abcdefghij") for _ in range(24)) for _ in range(3))
    lines = [f"{longer} " + " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(24)) for _ in range(60)]
    compared, verified = [], line_dedup._verified
    monkeypatch.setattr(line_dedup, "_verified", lambda pairs, *rest: (compared.append(pairs.count()), verified(pairs, *rest))[1])
    data = spark.createDataFrame(list(enumerate([*lines, lines[30] + " ab"])), "doc_id long, text string")
    assert {r.doc_id for r in line_dedup.dedup_lines(data).collect()} == set(range(60))
    assert sum(compared) < 200, compared  # of 1,830 pairs
