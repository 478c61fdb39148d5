import re

from periodica.llm import license_scan as ls
from periodica.llm.common import table
from tests.llm.helpers import HARD, SF, by_id, docs

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w, at, labels = WORD.findall(t), [], set()
    for phrase, label in ls.BASE:
        p = phrase.split()
        hits = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        at += hits
        labels |= {label} if hits else set()
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


TEXTS = HARD + [
    "Released under the MIT License. MIT-License! mit  license",
    "GNU General Public License, CC BY-NC 4.0, Apache License; cc by cc by",
    "Relesed under the MIT Licence",
    "Licensed under the Apach License, Version 2.0.",
    "submit license mit licensed xcc by",
    "Permission is hereby granted, free of charge, to any persn obtaining a copy of it",
    "all rights reservd. a right is reserved for all.",
]


def test_base_matches_brute_force(spark):
    texts = TEXTS + [r.text for r in table(spark, SF, "documents").collect()]
    got = by_id(ls.scan(docs(spark, texts)))
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(t), repr(t)[:80]
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_fuzzy_notices_with_edits_and_spans():
    label, notice = lambda t: ls.scan_text(t)[5], lambda t: ls.scan_text(t)[7]
    assert label("Relesed under the MIT Licence") == "mit"
    assert label("Licensed under the Apach License, Version 2.0.") == "apache"
    assert label("submit license mit licensed xcc by") == ""
    assert label("Permission is hereby granted, free of charge, to any persn obtaining a copy of it") == "mit"
    assert label("Licensed under CC BY-SA 4.0") == "cc-by,cc-by-sa"
    text = "Note. All   Rights, Reservd here"
    (kind, a, b, edits), = [x.split(":") for x in notice(text).split(",")]
    assert (kind, text[int(a) : int(b)], edits) == ("all-rights-reserved", "All   Rights, Reservd", "1")


def test_pigeonhole_finds_every_match_within_the_bound():
    import random

    import regex

    rng = random.Random(1)
    for label, notice, k in ls.NOTICES:
        for _ in range(20):
            s = list(notice)
            for _ in range(rng.randint(0, k)):
                i = rng.randrange(1, len(s) - 1)
                s[i] = rng.choice("abcdefgh") if s[i] != " " else " "
            t = "zz qq " + "".join(s) + " ww"
            plain = bool(regex.search(rf"\b(?:{notice}){{e<={k}}}\b", t))
            assert not plain or any(ls.NOTICES[i][1] == notice for i, *_ in ls.notices_in(t)), (notice, t)


def brute_notices(joined):
    """Every substring of about a notice's length that starts and ends at a word's edge, by edit distance."""
    found = []
    for i, (_, notice, k) in enumerate(ls.NOTICES):
        def edits(a, b):
            row = list(range(len(notice) + 1))
            for x, c in enumerate(joined[a:b], 1):
                row, up = [x], row
                for y, d in enumerate(notice, 1):
                    row.append(min(row[-1] + 1, up[y] + 1, up[y - 1] + (c != d)))
            return row[-1]

        edge = lambda at, side: not (0 <= at + side < len(joined) and re.match(r"\w", joined[at + side]))
        for a in range(len(joined)):
            if edge(a, -1):
                for b in range(a + len(notice) - k, min(len(joined), a + len(notice) + k) + 1):
                    if edge(b, 0) and (e := edits(a, b)) <= k:
                        found.append((i, a, b, e))
    return found


def test_labels_and_spans_against_edit_distances():
    import random

    rng = random.Random(3)
    for _ in range(60):
        words = []
        for _ in range(rng.randint(1, 3)):
            s = list(rng.choice(ls.NOTICES)[1])
            for _ in range(rng.randint(0, 5)):
                at = rng.randrange(len(s))
                s[at : at + rng.randint(0, 1)] = rng.choice(["", "q", "“", " x"])
            words += ["".join(s), rng.choice(["", "zz", "©", "license mit"])]
        joined = " ".join(" ".join(words).split())
        found, want = ls.notices_in(joined), brute_notices(joined)
        assert set(found) <= set(want), joined
        for i, a, b, e in want:  # whatever matches is found, or overlaps a match of that notice that is no worse
            assert any(j == i and x < b and a < y and f <= e for j, x, y, f in found), (joined, i, a, b)


def test_signs_against_a_notice():
    for text, span in (("“Mozilla Public License”", "mpl:1:23:0"), ("©All rights reserved", "all-rights-reserved:1:20:0"), ("—Eclipse Public License—", "epl:1:23:0")):
        assert ls.scan_text(text)[7] == span


def test_many_notices_take_linear_time():
    import time

    took = []
    for n in (4000, 16000):
        began = time.process_time()
        assert ls.scan_text("all rights reserved " * n)[7].count(",") == n - 1
        assert ls.scan_text("mit license " * n)[1] == n
        took.append(time.process_time() - began)
    assert took[1] < 8 * took[0]


def test_empty_table(spark):
    assert ls.scan(docs(spark, [])).count() == 0


def test_adjacent_notices_with_falling_edits():
    assert [x[1:] for x in ls.notices_in("all rights reservd all rights reserved")] == [(0, 18, 1), (19, 38, 0)]
    text = "eclips publc license eclipse publc license eclipse public license eclips public license"
    assert [x[3] for x in ls.notices_in(text)] == [2, 1, 0, 1]
    assert [x[1] for x in ls.notices_in(text)] == [0, 21, 43, 66]
