import re
from collections import Counter

from periodica.llm import quality_rules as q
from tests.llm.helpers import HARD, SF, by_id, docs, same

WORD = re.compile("[^\x20\x09-\x0d]+")
CLEAN = "The harvest was late this year, and the villagers waited. Nobody knew how long the rain would last in these hills."


def base(text):
    t = text or ""
    w = WORD.findall(t)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    seen = Counter(windows)
    inside = {i + k for i, x in enumerate(windows) if seen[x] > 1 for k in range(5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    n = len(w)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(inside), n < 10 or 100 * len(inside) > 20 * n


def test_matches_sql(spark):
    same(q.op1_quality_rules(spark, SF), q.ORACLE)


def test_base_figures_on_hard_texts(spark):
    texts = HARD + ["a b c d e " * 3, "a b c d e f a b c d e g " + CLEAN, "w " * 40, CLEAN + "\n" + CLEAN]
    got = by_id(q.judge(docs(spark, texts)))
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(t), repr(t)[:60]
        assert not (r.base_failed and r.kept)


def test_lines_go_and_documents_go(spark):
    menu, symbols = "home | news | sport | more", "what$$$ is### this&&& stuff***"
    texts = [CLEAN, CLEAN + "\n" + menu, CLEAN + "\nAll rights reserved.", "\n".join([menu] * 9 + [CLEAN]), symbols + " and %%% more$$$ of*** the&&& same### here$$$", "Cookie policy: we use cookies, subscribe to the news, log in."]
    got = by_id(q.judge(docs(spark, texts)))
    assert [got[i].kept for i in range(6)] == [True, True, True, False, False, False]
    assert got[1].clean_text == CLEAN and got[2].clean_text == CLEAN


def test_boilerplate_counts_as_lost_text(spark):
    one = "The river rose over night and the bridge was closed."
    texts = ["\n".join([one, *["We use a cookie here."] * 4]), "\n".join([one, "Tous droits réservés."]), "\n".join([f"{one} {one}", *["Alle Rechte vorbehalten."] * 9])]
    got = by_id(q.judge(docs(spark, texts)))
    assert [(got[i].kept, got[i].chars_boilerplate > 0) for i in range(3)] == [(False, True), (True, True), (False, True)]
    assert got[0].chars_left == len(one) and got[0].chars_boilerplate == 4 * len("We use a cookie here.")


def test_clean_keeps_columns_and_follows_text(spark):
    df = docs(spark, [CLEAN, None, CLEAN + "\nhome | news | sport | more"])
    out = q.clean(df)
    assert out.schema.simpleString() == df.schema.simpleString()
    assert sorted((r.doc_id, r.text, r.n_chars, r.kept) for r in out.collect()) == [(0, CLEAN, len(CLEAN), "kept?"), (2, CLEAN, len(CLEAN), "kept?")]


def test_empty_table(spark):
    assert q.judge(docs(spark, [])).count() == 0 and q.clean(docs(spark, [])).count() == 0


def test_no_python_in_plan(spark):
    plan = q.judge(docs(spark, [CLEAN]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
