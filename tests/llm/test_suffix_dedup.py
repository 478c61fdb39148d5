import hashlib
import random
from collections import Counter

import numpy as np

from periodica.llm import suffix_dedup as s
from periodica.llm.common import table
from tests.llm.helpers import HARD, SF, docs


def brute(texts, length=200):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    for r in raw:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        yield len(r), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(r, gone) if not g)).hexdigest()


def rows(df, **params):
    return sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in s.remove_repeats(df, **params).collect())


def check(spark, texts, **params):
    assert rows(docs(spark, texts), **params) == [(i, *x) for i, x in enumerate(brute(texts))]


def test_documents(spark):
    df = table(spark, SF, "documents")
    texts = df.orderBy("doc_id").collect()
    assert rows(df) == [(r.doc_id, *x) for r, x in zip(texts, brute([r.text for r in texts]))]


def edges(seed):
    rng = random.Random(seed)
    make = lambda n: "".join(rng.choices("abcdefgh é", k=n))
    passage, shared = make(420), make(199)
    texts = [make(rng.randint(0, 300)) + passage[rng.randint(0, 60) : rng.randint(250, 420)] + make(rng.randint(0, 300)) for _ in range(60)]
    texts += [make(50) + shared + make(50) for _ in range(5)]  # a byte short of a match
    near = make(3000)
    for _ in range(12):
        t = list(near)
        for k in rng.sample(range(3000), 9):
            t[k] = "#"
        texts.append("".join(t))
    texts += [make(500)] * 2 + [make(150)] * 2
    texts += ["a" * 1000, "ab" * 400, "x" * 199, "y" * 200, "z" * 201, (make(7) * 200)[:1000]]
    return texts + HARD


def test_edges_of_passages_and_periodic_texts(spark):
    check(spark, edges(1))


def test_large_groups_give_the_same(spark):
    check(spark, edges(2), group_rows=3)


def test_long_text_over_segments(spark):
    rng = random.Random(4)
    long = "".join(rng.choices("abcdefghijklmnop", k=s.SEGMENT + 5000))
    cut = long[s.SEGMENT - 300 : s.SEGMENT + 300]
    got = rows(docs(spark, [long, "head " + cut + " tail", "other"]))
    assert [x[2] for x in got] == [600, 600, 0] and [x[3] for x in got] == [1, 1, 0]


def test_unclear_ids_and_empty(spark):
    a, b = "".join(map(str, range(200))), "".join(map(str, range(5000, 5200)))
    df = spark.createDataFrame([(None, a), (None, a), (1, b), (1, a + b), (2, None)], "doc_id long, text string")
    got = sorted((r.n_bytes, r.n_removed) for r in s.remove_repeats(df).collect())
    assert got == sorted([(len(a), len(a))] * 2 + [(len(b), len(b)), (len(a + b), len(a + b)), (0, 0)])
    assert s.remove_repeats(docs(spark, [])).count() == 0


def test_triggers_are_leftmost_least_and_local():
    rng = np.random.default_rng(2)
    data = rng.integers(97, 100, 3000).astype(np.uint8)
    x = s.sums(data)
    t = s.triggers(x)
    grams = s.hashes(x, np.arange(len(data) - s.GRAM + 1), np.arange(len(data) - s.GRAM + 1) + s.GRAM) >> np.uint64(20)
    for w in range(0, len(t), 37):
        assert t[w] == w + np.argmin(grams[w : w + s.REACH])
    again = s.triggers(s.sums(data[100:]))
    assert (again + 100 == t[100:]).all()
