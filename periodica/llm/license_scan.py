"""License scans: fuzzy search for short notices.

A text is lower-cased (A-Z), split into words of ASCII letters, digits and non-ASCII characters, and joined with single
spaces. Base labels come from phrases whose words stand consecutively. Notices may hold up to ``k`` edits: split into
``k + 1`` parts, one part must stand unchanged (pigeonhole), so an Aho-Corasick pass over the exact parts locates all
candidates, and the ``regex`` library's bounded-error matching verifies each candidate's neighbourhood and counts edits. A
notice begins and ends where no letter or digit goes on, so quotes, dashes and signs may stand against it, though the
contract counts those outside ASCII to the words.

Edge cases: null text counts as empty: no words, no labels, score 0. Texts are searched whole, in time linear in their
length; repeated rows one by one; other columns are ignored. Of overlapping matches of a notice that of fewest edits is
reported, then the leftmost. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import bisect
import functools
import re

import ahocorasick
import regex
from pyspark.sql import DataFrame

from periodica.llm.common import map_rows, table

# Base phrases and their labels.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

# Label, notice in normalised words, edits allowed.
NOTICES = (
    ("agpl", "gnu affero general public license", 2),
    ("all-rights-reserved", "all rights reserved", 1),
    ("apache", "licensed under the apache license version 2 0", 3),
    ("artistic", "the artistic license 2 0", 1),
    ("boost", "boost software license version 1 0", 2),
    ("bsd", "redistribution and use in source and binary forms", 3),
    ("cc-by", "creative commons attribution", 2),
    ("cc-by-nc", "licensed under cc by nc 4 0", 1),
    ("cc-by-nd", "licensed under cc by nd 4 0", 1),
    ("cc-by-sa", "licensed under cc by sa 4 0", 1),
    ("cc0", "cc0 1 0 universal public domain dedication", 3),
    ("epl", "eclipse public license", 2),
    ("gpl", "licensed under the gnu general public license version 3", 4),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", 5),
    ("lgpl", "gnu lesser general public license", 2),
    ("mit", "released under the mit license", 2),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", 5),
    ("mpl", "mozilla public license", 2),
    ("unlicense", "this is free and unencumbered software released into the public domain", 5),
    ("zlib", "this software is provided as is without any express or implied warranty", 5),
)

#: Byte classes of normalisation: letters lower-cased, digits and bytes of non-ASCII characters kept, all else a space.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def normal_words(text: str) -> list[bytes]:
    """The words of ``text``, lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


def parts(notice: str, k: int) -> list[tuple[int, str]]:
    """``k + 1`` pieces of about equal length with their offsets."""
    n = len(notice)
    cuts = [n * i // (k + 1) for i in range(k + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


@functools.lru_cache(1)
def matcher():
    """The automaton over all parts, and each notice's bounded-error pattern; built once per worker."""
    auto, at = ahocorasick.Automaton(), {}
    for i, (_, notice, k) in enumerate(NOTICES):
        for offset, part in parts(notice, k):
            at.setdefault(part, []).append((i, offset, len(part)))
    for part, places in at.items():
        auto.add_word(part, places)
    auto.make_automaton()
    return auto, [regex.compile(rf"(?b)(?<!\w)(?:{notice}){{e<={k}}}(?!\w)") for _, notice, k in NOTICES]


def best_matches(pattern, joined: str, start: int, end: int):
    """The best match of the candidate between two places, and those of the parts before and behind it, and so on."""
    inside = lambda at: 0 <= at < len(joined) and (joined[at].isalnum() or joined[at] == "_")
    parts = [(start, end)]
    while parts:
        a, b = parts.pop()
        # a cut inside a word must not look like a word's edge
        part = joined[max(a - 1, 0) : b + 1]
        shift, at = max(a - 1, 0), a - max(a - 1, 0)
        while m := pattern.search(part, at):
            first, last = m.start() + shift, m.end() + shift
            if last <= b and not inside(last if last < len(joined) else -1):
                yield first, last, sum(m.fuzzy_counts)
                parts += [(a, first), (last, b)]
                break
            at = m.start() + 1


def apart(matches: list) -> list:
    """Of (start, end, edits) those that overlap none of fewer edits, or as many and further to the left."""
    out, group, reach = [], [], -1
    for m in [*sorted(matches), (1 << 62, 1 << 62, 0)]:
        if m[0] >= reach and group:
            taken: list = []
            for x in sorted(group, key=lambda x: (x[2], x[0], x[1])):
                k = bisect.bisect_left(taken, x)
                if (k == 0 or taken[k - 1][1] <= x[0]) and (k == len(taken) or taken[k][0] >= x[1]):
                    taken.insert(k, x)
            out += taken
            group = []
        group.append(m)
        reach = max(reach, m[1])
    return out


def notices_in(joined: str) -> list[tuple[int, int, int, int]]:
    """(notice, start, end, edits) in ``joined``."""
    auto, patterns = matcher()
    near: dict[int, set[int]] = {}
    for last, places in auto.iter(joined):
        for i, offset, size in places:
            near.setdefault(i, set()).add(last + 1 - size - offset)
    found = []
    for i, starts in near.items():
        _, notice, k = NOTICES[i]
        seen, done = set(), -len(joined) - len(notice)
        for start in sorted(starts):
            # seeds of one place may disagree by as many characters as there are edits
            a, b = max(0, start - k - 1), min(len(joined), start + len(notice) + k + 1)
            if (start, start + len(notice), 0) in seen or start < done:
                continue
            hits = set(best_matches(patterns[i], joined, a, b))
            seen |= hits
            done = max((y for x, y, e in hits if e == 0 and x <= start), default=done)
        found += [(i, *m) for m in apart(list(seen))]
    return sorted(found)


def scan_text(text: str) -> tuple:
    """n_words, n_base, first_word, last_word, base labels, labels, score, spans of one text."""
    words = normal_words(text)
    raw = b" " + b" ".join(words) + b" "
    places, base = [], set()
    for phrase, label in BASE:
        needle = b" " + phrase.encode() + b" "
        at = raw.find(needle)
        n = counted = 0
        while at >= 0:
            n, counted = n + raw.count(b" ", counted, at), at
            places.append(n)
            base.add(label)
            at = raw.find(needle, at + 1)
    joined = raw[1:-1].decode("utf-8", "surrogatepass")
    found = notices_in(joined) if words else []
    labels, score, spans = set(base), 1.0 if base else 0.0, []
    if found:
        starts = [0, *(m.end() for m in re.finditer(" ", joined))]
        original = [m.span() for m in _WORD.finditer(text)]
        for i, a, b, edits in found:
            label, notice, _ = NOTICES[i]
            labels.add(label)
            score = max(score, 1 - edits / len(notice))
            first, last = bisect.bisect_right(starts, a) - 1, bisect.bisect_right(starts, b - 1) - 1
            spans.append(f"{label}:{original[first][0] + a - starts[first]}:{original[last][0] + b - starts[last]}:{edits}")
    return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, ",".join(spans))


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string"


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (columns doc_id and text are read)."""

    def rows(ids, texts):
        cols = list(zip(*((i, *scan_text(t or "")) for i, t in zip(ids, texts))))
        return {c.split()[0]: list(v) for c, v in zip(SCHEMA.split(", "), cols)}

    return map_rows(docs.select("doc_id", "text"), rows, SCHEMA)


def op7_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
