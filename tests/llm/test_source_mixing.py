import re
from collections import defaultdict

from periodica.llm import source_mixing as sm
from periodica.llm.common import table
from tests.llm.helpers import HARD, SF, by_id, docs, same

SCHEMA = "doc_id long, text string, source string, target string, hash int"


def texts(spark, sizes, copies=1):
    """Rows of given (source, words), with columns that clash."""
    rows = [(i, "w " * n, s, "t", 1) for i, (s, n) in enumerate(sizes)] * copies
    return spark.createDataFrame(rows, SCHEMA)


def shares(sizes, weights=(1, 2, 3), most=3, budget=None):
    """Targets by resharing step by step."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, left, free = {}, sum(sizes.values()) if budget is None else budget, set(names)
    while free:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if w[s] * level > most * sizes[s]}
        if not over:
            out |= {s: w[s] * level for s in free}
            break
        out |= {s: float(most * sizes[s]) for s in over}
        left -= sum(most * sizes[s] for s in over)
        free -= over
    return out


def test_query_is_its_sql(spark):
    same(sm.op11_source_mixing(spark, SF), sm.ORACLE)


def test_targets_are_shares_with_the_excess_handed_on(spark):
    sizes = {"a": 5, "b": 1, "c": 900, "": 40, "é": 7, None: 300, "zero": 0, "Z": 11}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    for weights, most in (((1, 2, 3), 3), ((1,), 1), ((5, 1), 2)):
        got = {r.source: r.target for r in sm.source_targets(df, weights, most=most).collect()}
        want = shares(sizes, weights, most)
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)
    got = {r.source: r.target for r in sm.source_targets(df, share=5.0).collect()}
    assert got == {s: 3.0 * n for s, n in sizes.items()}  # more than there is


def test_each_source_comes_near_its_target_and_reruns_agree(spark):
    df = table(spark, "/root/testdata/sf0.01", "documents")
    rows = sm.mix(df).collect()
    sums, most, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        sums[r.source] += r.taken
        most[r.source] = max(most[r.source], r["size"])
        target[r.source] = r.target
        assert r.taken == r["size"] * r.copies <= 3 * r["size"]
    assert all(abs(sums[s] - target[s]) <= most[s] for s in sums)
    assert sorted(map(repr, rows)) == sorted(map(repr, sm.mix(df.repartition(7)).collect()))


def test_finer_and_coarser_histograms_agree(spark, monkeypatch):
    df = table(spark, SF, "documents")
    want = sorted(map(repr, sm.mix(df).collect()))
    for step in (2, 30):
        monkeypatch.setattr(sm, "STEP", step)
        assert sorted(map(repr, sm.mix(df).collect())) == want


def test_larger_budgets_take_supersets(spark):
    df = table(spark, SF, "documents")
    small, large = by_id(sm.mix(df, share=0.3)), by_id(sm.mix(df, share=0.6))
    assert all(small[i].copies <= large[i].copies for i in small) and any(r.copies for r in small.values())


def test_nulls_ties_repeats_and_an_empty_table(spark):
    odd = docs(spark, HARD).union(docs(spark, ["a b c", None], 90).selectExpr("doc_id", "text", "lang", "null as source", "n_chars", "kept", "n_words"))
    got = by_id(sm.mix(odd))
    assert [got[i]["size"] for i in range(len(HARD))] == [len(re.findall("[^\x20\x09-\x0d]+", t or "")) for t in HARD]
    assert got[90].source is None and got[90].source_size == 3
    # rows that repeat are taken alike
    rows = sm.mix(texts(spark, [("a", 10), ("a", 10), ("b", 200)], copies=3)).collect()
    alike = defaultdict(set)
    for r in rows:
        alike[r.doc_id].add(r.copies)
    assert len(rows) == 9 and all(len(x) == 1 for x in alike.values())
    assert sm.mix(texts(spark, [])).count() == 0 and sm.mixture(texts(spark, [])).count() == 0
    none = sm.mix(texts(spark, [("a", 0), (None, 0)])).collect()
    assert [(r.target, r.taken) for r in none] == [(0.0, 0)] * 2


def test_the_mix_repeats_whole_rows(spark):
    df = texts(spark, [("a", 3), ("b", 40), ("c", 2), ("c", 5), ("b", 1)])
    n = {r.doc_id: r.copies for r in sm.mix(df).collect()}
    got = defaultdict(list)
    for r in sm.mixture(df).collect():
        assert r.target == "t" and r.hash == 1
        got[r.doc_id].append(r.repeat)
    assert {k: sorted(v) for k, v in got.items()} == {k: list(range(1, v + 1)) for k, v in n.items() if v}
