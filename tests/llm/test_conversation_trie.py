import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from periodica.llm import conversation_trie as ct
from tests.llm.helpers import SF, same

SCHEMA = "conv_id long, turn long, role string, text string, depth string, parent int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def conversations(rows):
    out = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            out[c].append(((turn is not None, turn or 0), role or "", text or ""))
    return {c: [(role, text) for _, role, text in sorted(v)] for c, v in out.items()}


def rebuild(said):
    out = {}
    for c, own in said.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = said.get(c - c % 5, [])[:h] + own[h:]
    return out


def brute(said):
    """Every node's row by walking all prefixes of all conversations."""
    nodes = defaultdict(list)
    for c in sorted(said):
        for d in range(len(said[c]) + 1):
            nodes[tuple(said[c][:d])].append(c)
    name = {p: (cs[0], len(p)) for p, cs in nodes.items()}
    children = defaultdict(int)
    for p in nodes:
        if p:
            children[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, cs in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(cs) - 1) * len(p[-1][1].encode()) if p else 0
    digest = {p: hashlib.sha256(",".join(str(c) for c in cs if len(said[c]) == len(p)).encode()).hexdigest() for p, cs in nodes.items()}
    return sorted((*name[p], name[p[:-1]][0] if p else None, len(cs), children[p], leaves[p], saved[p], digest[p]) for p, cs in nodes.items())


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: r[:2])


def several(seed, n=60, longest=12, words=2):
    g = random.Random(seed)
    rows = []
    for c in range(n):
        rows += [(c, t if g.random() < 0.95 else None, g.choice(["user", None]), g.choice(["é", "bb", None][:words])) for t in range(g.randrange(longest))]
    return rows


def test_query_is_its_sql(spark):
    same(ct.op13_conversation_trie(spark, SF), ct.ORACLE)


@pytest.mark.parametrize("seed,block", [(0, 4096), (1, 2), (2, 5)])
def test_is_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(ct, "BLOCK", block)
    monkeypatch.setattr(ct, "CHUNK", 4)
    rows = several(seed)
    df = frame(spark, rows).repartition(3)
    assert rows_of(ct.prefix_trie(df)) == brute(conversations(rows))
    places = ct.cut(ct.turns(df), "turns")
    assert rows_of(ct.trie(*ct.rebuilt(places))) == brute(rebuild(conversations(rows)))


def test_a_long_conversation_and_a_crowd_of_equal_ones(spark, monkeypatch):
    monkeypatch.setattr(ct, "BLOCK", 16)
    monkeypatch.setattr(ct, "CHUNK", 8)
    rows = [(7, t, "user", f"turn {t}") for t in range(200)]
    rows += [(c, t, "user", f"turn {t}") for c in range(100, 180) for t in range(3)]  # equal, and the long one's beginning
    rows += [(c, t, "user", f"turn {t}" if t < 150 else f"other {c} {t}") for c in (3, 9) for t in range(170)]
    assert rows_of(ct.prefix_trie(frame(spark, rows))) == brute(conversations(rows))


def test_each_first_turn_another_and_paths_that_hang_deep(spark):
    rows = [(c, 0, "u", f"first {c}") for c in range(40)]
    # a comb: each conversation leaves the one before after a turn, so light paths hang under light paths
    for c in range(16):
        path = f"{c:04b}"
        rows += [(100 + c, t, "u", path[: t + 1]) for t in range(4)]
    assert rows_of(ct.prefix_trie(frame(spark, rows))) == brute(conversations(rows))


def test_nulls_repeats_negative_ids_and_an_empty_table(spark):
    rows = [(None, 0, "u", "no conversation"), (1, None, None, None), (1, None, None, None), (1, 3, "u", ""), (1, 3, "a", "x"), (-6, 1, "u", ""), (-5, 1, "u", "y"), (2, 0, None, None)]
    assert rows_of(ct.prefix_trie(frame(spark, rows))) == brute(conversations(rows))
    twice = conversations(rows + rows)
    assert rows_of(ct.prefix_trie(frame(spark, rows + rows))) == brute(twice)
    assert ct.prefix_trie(frame(spark, [])).count() == 0
    assert ct.trie(*ct.rebuilt(ct.turns(frame(spark, [])))).count() == 0


def test_conversations_without_a_turn_left_end_in_the_root(spark):
    # conversation 1 has one turn of its own, dropped, and conversation 0 is absent
    rows = [(c, 0, "u", f"only {c}") for c in range(1, 5)]
    got = rows_of(ct.trie(*ct.rebuilt(ct.turns(frame(spark, rows)))))
    assert got == brute(rebuild(conversations(rows))) and got[0][:2] == (1, 0)
