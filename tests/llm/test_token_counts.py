import re

from periodica.llm import token_counts as tc
from periodica.llm.common import table
from tests.llm.helpers import HARD, SF, by_id, docs


def plain(word, scores, longest, unknown):
    """Tokens of one word, by dynamic programming of its own."""
    best = [(0.0, 0)]
    for i in range(1, len(word) + 1):
        size = len(word[i - 1].encode("utf-8", "surrogatepass"))
        ways = [(best[i - 1][0] + unknown * size, -i, best[i - 1][1] + size)]
        ways += [(best[j][0] + scores[word[j:i]], -j, best[j][1] + 1) for j in range(max(0, i - longest), i) if word[j:i] in scores]
        top = max(ways, key=lambda x: x[:2])
        best.append((top[0], top[2]))
    return best[-1][1]


def test_counts_match_word_by_word_brute_force(spark):
    m = tc.model(tc.vocabulary_path())
    texts = HARD + [r.text for r in table(spark, SF, "documents").collect()][:60]
    got = by_id(tc.count(docs(spark, texts)))
    known = {}
    for i, t in enumerate(texts):
        words = re.findall("[^\x20\x09-\x0d]+", t or "")
        counts = [known.setdefault(w, plain("▁" + w, *m)) if w not in known else known[w] for w in words]
        assert (got[i].n_pretokens, got[i].n_tokens, got[i].max_word_tokens) == (len(words), sum(counts), max(counts, default=0))


def test_small_memory_changes_nothing(spark):
    df = table(spark, SF, "documents").limit(50)
    assert sorted(tc.count(df).collect()) == sorted(tc.count(df, remembered=10).collect())


def test_shared_prefixes_and_empty(spark):
    scores = {"a": -1.0, "ab": -1.5, "b": -1.0, "abc": -1.4, "c": -3.0}
    words = ["a", "ab", "abc", "abcab", "b", "zz", "abz"]
    assert tc.trie_counts(words, scores, 3, -9.0) == {w: plain(w, scores, 3, -9.0) for w in words}
    assert tc.count(docs(spark, [])).count() == 0


def test_repeated_rows_and_clashing_columns(spark):
    df = docs(spark, ["some words here", None]).selectExpr("*", "1 as n_tokens", "'x' as n_pretokens")
    got = sorted((r.doc_id, r.n_pretokens, r.n_tokens > 0) for r in tc.count(df.unionAll(df)).collect())
    assert got == [(0, 3, True)] * 2 + [(1, 0, False)] * 2
