import random

from periodica.llm import decontamination as d
from tests.llm.helpers import HARD, docs


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return "".join(c if c.isascii() and c.isalnum() or ord(c) > 127 else " " for c in low).split(" ")


def brute(texts, items, min_words=5):
    """(doc_id, item_id, most equal words) by comparing every window with every other."""
    out, seen = set(), set()
    for item, text in sorted(items, key=lambda x: (x[0] is None, x[0] or 0)):
        w = [x for x in words(text) if x]
        if len(w) < min_words or tuple(w) in seen:
            continue
        seen.add(tuple(w))
        n = min(13, len(w))
        allowed = n * 2 // 13
        for i, t in enumerate(texts):
            v = [x for x in words(t) if x]
            best = max((sum(a == b for a, b in zip(w[k : k + n], v[j : j + n])) for k in range(len(w) - n + 1) for j in range(len(v) - n + 1)), default=-1)
            if best >= n - allowed:
                out.add((i, item, best))
    return out


def run(spark, texts, items):
    bench = spark.createDataFrame(items, "item_id long, text string")
    return {(r.doc_id, r.item_id, r.equal_words) for r in d.overlaps(docs(spark, texts), bench).collect()}


def test_against_every_window(spark):
    r = random.Random(3)
    vocabulary = [f"w{k}é" if k % 7 == 0 else f"w{k}" for k in range(60)]
    say = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [(k, " ".join(say(n))) for k, n in enumerate([3, 5, 6, 8, 10, 11, 12, 13, 14, 20, 40, 60])] + [(90, None), (91, ""), (92, "a b")]
    texts = list(HARD)
    for k, (_, text) in enumerate(items[:12]):
        for subs in (0, 1, 2, 3):
            w = text.split()
            a = r.randrange(max(1, len(w) - 15))
            part = w[a : a + 15]
            for p in r.sample(range(len(part)), min(subs, len(part))):
                part[p] = "other"
            texts.append(" ".join(say(20) + part + say(20)).upper().replace("É", "é") if k % 2 else ", ".join(say(9) + part))
    texts += [items[10][1], items[10][1] + " " + items[11][1], " ".join(say(400))]
    assert run(spark, texts, items) == brute(texts, items)


def test_same_items_and_repeated_rows(spark):
    text = " ".join(f"alpha{k}" for k in range(20))
    bench = spark.createDataFrame([(7, text), (3, text), (5, "unrelated words that stand nowhere else at all in these texts here now")], "item_id long, text string")
    rows = spark.createDataFrame([(1, text), (1, text), (None, "x " + text), (2, "clean")], "doc_id long, text string")
    assert sorted((r.doc_id is None, r.item_id) for r in d.overlaps(rows, bench).collect()) == [(False, 3), (True, 3)]
    assert [r.doc_id for r in d.decontaminate(rows, bench).collect()] == [2]


def test_short_and_nameless_items(spark):
    items = [(1, "one"), (2, "two three"), (None, "four five six seven eight nine"), (4, "a1 b2 c3 d4 e5 f6 g7 h8"), (None, "p q r s t u v w x y z a b c d e")]
    texts = ["three two one", "x two three", "four five six seven eight nine", "a1 b2 c3 d4 e5 f6 g7 x8", "z1 b2 c3 d4 e5 f6 g7 h8", "a1 b2 c3 d4 x5 f6 g7 x8", "q r s t u v w x y z a b c d", None]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for least in (1, 5):
        got = {(r.doc_id, r.item_id, r.equal_words) for r in d.overlaps(docs(spark, texts), bench, least).collect()}
        assert got == brute(texts, items, least)
    assert (3, 4, 7) in got and (2, None, 6) in got


def test_hot_hashes_are_split_alike(spark, monkeypatch):
    r = random.Random(5)
    items = [(k, " ".join(f"w{r.randrange(50)}" for _ in range(30))) for k in range(6)]
    texts = ["intro words " + items[k % 6][1] for k in range(20)]
    want = run(spark, texts, items)
    monkeypatch.setattr(d, "SALTS", 1)
    assert run(spark, texts, items) == want and len(want) >= 20


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    some = docs(spark, HARD)
    assert d.overlaps(some, none).count() == 0
    assert d.decontaminate(some, none).count() == len(HARD)
    assert d.decontaminate(some.limit(0), none).columns == some.columns


def test_masks_miss_no_window_with_two_substitutions():
    for a in range(d.WINDOW):
        for b in range(a):
            assert any(all(o + at not in (a, b) for o in m) for m in d.MASKS for at in range(d.WINDOW - m[-1]))


def test_items_that_share_a_passage(spark):
    r = random.Random(8)
    say = lambda n: [f"w{r.randrange(900)}" for _ in range(n)]
    passage = say(60)
    items = [(k, " ".join(passage + say(8))) for k in (4, 9, 2)] + [(7, " ".join(say(5) + passage + say(5))), (8, " ".join(passage)), (11, " ".join(say(30)))]
    items.append((5, items[0][1].upper()))
    texts = [" ".join(say(20) + passage[a:b] + say(20)) for a, b in ((15, 40), (0, 20), (20, 33), (45, 60), (0, 60), (30, 42))]
    bent = passage[16:40]
    bent[5] = bent[9] = "other"
    texts += [" ".join(say(6) + bent + say(6)), " ".join(passage[20:40] + say(9) + passage[20:40])]
    want = brute(texts, items)
    assert len(want) >= 30
    assert run(spark, texts, items) == want
