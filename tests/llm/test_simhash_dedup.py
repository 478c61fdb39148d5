import random
import re

import numpy as np
import xxhash

from periodica.llm import simhash_dedup as sd
from periodica.llm.common import table
from periodica.llm.components import components
from tests.llm.helpers import HARD, SF, docs


def fingerprint(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x20\x09-\x0d]+", t)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, prints, reach):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    u = np.array(prints, np.uint64)
    for k, i in enumerate(ids):
        for j in np.flatnonzero(np.bitwise_count(u[k] ^ u[k + 1 :]) <= reach):
            a, b = find(i), find(ids[k + 1 + j])
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def check(spark, df, **params):
    rows = sorted(df.select("doc_id", "text").collect(), key=lambda r: r.doc_id)
    prints = [fingerprint(r.text) for r in rows]
    want = brute_components([r.doc_id for r in rows], prints, params.get("max_bits", 2))
    got = {r.doc_id: (r.fp & (1 << 64) - 1, r.component_id) for r in sd.classes(df, **params).collect()}
    assert got == {r.doc_id: (p, want[r.doc_id]) for r, p in zip(rows, prints)}


def test_documents_against_brute_force(spark):
    check(spark, table(spark, "/root/testdata/sf0.01", "documents"), most=64)
    check(spark, table(spark, SF, "documents"), max_bits=3, most=64)


def test_hard_texts_and_chain(spark):
    check(spark, docs(spark, HARD))


def test_links_of_random_points(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = sorted({b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 4))) for b in base for _ in range(40)})
    rows = [(k, fp - (1 << 64) if fp >> 63 else fp) for k, fp in enumerate(fps)]
    points = spark.createDataFrame(rows, "node long, fp long")
    want = brute_components(list(range(len(fps))), fps, 2)
    for most in (sd.MOST, 30):
        roots = {r.node: r.root for r in components(sd.bit_links(points, 2, most)).collect()}
        assert {k: roots.get(k, k) for k in want} == want


def test_copies_of_a_point_do_not_grow_and_crowded_shards_are_split(spark):
    rng = np.random.default_rng(5)
    for n in (1000, 8000):
        fps = rng.integers(-(1 << 63), 1 << 63, n)
        rows = spark.createDataFrame([(0, int(x), int(x), int(x), 64) for x in fps], "shard long, node long, fp long, rest long, width int")
        dealt = sd.split_bits(rows, 3)
        assert dealt.count() == 3 * n
        assert {(r.width, r.c) for r in dealt.groupBy("width").count().withColumnRenamed("count", "c").collect()} == {(42, n), (43, 2 * n)}
    # points that share a block: dealt again, they stand in shards of fewer
    hot = spark.range(3000).selectExpr("0L as shard", "id as node", "id as fp", "id as rest", "64 as width")
    once = sd.split_bits(hot, 3)
    assert once.groupBy("shard").count().agg({"count": "max"}).first()[0] == 3000
    twice = once
    for _ in range(5):
        twice = sd.split_bits(twice, 3)
    assert twice.where("width < 12").groupBy("shard").count().agg({"count": "max"}).first()[0] <= 1 << 11


def test_components_of_long_chain_and_hub(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(8, 60)] + [(5, 5), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 7 for i in range(7, 60)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_dedup_keeps_one_row_per_class(spark):
    a = "one two three four five six seven eight nine ten eleven twelve"
    df = docs(spark, [a, a, "something else entirely", a.upper(), None, ""])
    df = df.unionAll(df)
    out = sd.dedup(df)
    assert out.columns == df.columns and sorted(r.doc_id for r in out.collect()) == [0, 2, 4]
    assert sd.dedup(docs(spark, [])).count() == 0


def test_near_copies_with_second_fingerprint(spark):
    rng = random.Random(1)
    words = ["w%d" % k for k in range(500)]
    texts = []
    for _ in range(30):
        t = rng.choices(words, k=300)
        u = list(t)
        for k in rng.sample(range(300), 5):
            u[k] = "changed"
        texts += [" ".join(t), " ".join(u)]
    got = {r.doc_id: r.component_id for r in sd.classes(docs(spark, texts), **sd.NEAR_COPIES).collect()}
    assert sum(got[2 * k] == got[2 * k + 1] == 2 * k for k in range(30)) >= 28
    assert all(got[i] in (i, i - 1) for i in got)


def shingles(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_near(texts, similarity=0.8):
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or len(a & b) >= similarity * len(a | b):
                root = [root[j] if r == root[i] else r for r in root] if root[j] < root[i] else [root[i] if r == root[j] else r for r in root]
    return dict(enumerate(root))


def edited(rng, words, part, block):
    """Words of which about ``part`` of the shingles are replaced, by one block or by single words far apart."""
    out, n = list(words), len(words)
    if block:
        k, at = round(n * part) - 4, rng.randrange(n // 2)
        out[at : at + k] = [f"n{rng.random()}" for _ in range(k)]
    else:
        for at in rng.sample(range(2, n // 5), round(n * part / 5)):
            out[5 * at] = f"n{rng.random()}"
    return out


def test_near_copies_are_those_of_exact_similarity(spark):
    rng = random.Random(11)
    texts = []
    for similarity in (0.75, 0.78, 0.795, 0.805, 0.82, 0.85, 0.9):
        for block in (True, False):
            for n in (60, 200, 400, 400, 400, 600):
                t = [f"w{rng.randrange(5000)}" for _ in range(n)]
                texts += [" ".join(t), " ".join(edited(rng, t, (1 - similarity) / (1 + similarity), block))]
    texts += ["", "a b", "a b", "a b c d e f", " ".join(["same line again here now"] * 9), " ".join(["same line again here now"] * 99)]
    want = brute_near(texts)
    assert 60 < len({*want.values()}) < len(texts) - 40
    got = {r.doc_id: r.component_id for r in sd.classes(docs(spark, texts), **sd.NEAR_COPIES).collect()}
    assert got == want


def test_large_group_of_near_copies_without_its_original(spark):
    rng = random.Random(12)
    t = [f"w{k}" for k in range(200)]
    texts = [" ".join(edited(rng, t, rng.choice((0.02, 0.06, 0.1)), False)) for _ in range(60)]
    want = brute_near(texts)
    assert 1 < len({*want.values()}) < 40
    for most in (sd.MOST, 12):
        got = {r.doc_id: r.component_id for r in sd.classes(docs(spark, texts), **sd.NEAR_COPIES, most=most).collect()}
        assert got == want


def test_pivots_lose_no_link(spark, monkeypatch):
    rng = random.Random(4)
    t = [f"w{k}" for k in range(120)]
    texts = [" ".join(edited(rng, t, rng.choice((0.05, 0.11, 0.15)), rng.random() < 0.5)) for _ in range(40)]
    texts += [" ".join(f"x{rng.randrange(9**9)}" for _ in range(50)) for _ in range(10)]
    want = brute_near(texts)
    sets = sd.shingle_sets(docs(spark, texts), 5, 4, 2).select("doc_id", "node", "shingles").cache()
    node = {r.node: r.doc_id for r in sets.collect()}
    members = sets.selectExpr("1L as shard", "node").unionAll(sets.where("doc_id < 5").selectExpr("2L as shard", "node"))
    for most, rounds in ((10, 6), (3, 1)):
        monkeypatch.setattr(sd, "PIVOTS", rounds)
        links = sd.pivot_links(members, sets.select("node", "shingles"), 0.8, most)
        roots = {node[r.node]: node[r.root] for r in components(links).collect()}
        groups = lambda root: {frozenset(i for i in range(50) if root(i) == r) for r in map(root, range(50))}
        assert groups(lambda i: roots.get(i, i)) == groups(want.get)


def test_clashing_columns_and_nulls(spark):
    rows = [(1, "a b c d e f g", "x", 5), (1, "a b c d e f g", "y", 6), (2, "a b c d e f g", "z", 7), (None, None, "n", 8), (3, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, copies string, row long")
    out = sd.dedup(df, **sd.NEAR_COPIES)
    assert out.columns == df.columns
    assert sorted(r.doc_id or 0 for r in out.collect()) == [0, 1, 3]
