import random
import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from periodica.llm import packing as p
from periodica.llm.common import table
from tests.llm.helpers import HARD, SF, docs

TOKENIZER = Tokenizer.from_file(p.tokenizer_path())


def ids(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids + [2]


def whole(rows, texts, capacity=4096):
    """Checks the contract of packing on collected rows; returns the share of padding."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for i, t in texts.items():
        want, at = ids(t), 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(want)
            assert r.ids_crc32 == zlib.crc32(np.array(want[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(want)
    for s in by_sequence.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    used = sum(r.length for r in rows)
    padded = sum(n if (n := sum(r.length for r in s)) & (n - 1) == 0 else capacity for s in by_sequence.values())
    return 1 - used / max(1, padded)


def test_documents_many_workers(spark):
    df = table(spark, SF, "documents").repartition(70)
    assert whole(p.pack(df).collect(), {r.doc_id: r.text for r in df.collect()}) < 0.03


def test_hard_texts(spark):
    texts = HARD + ["<|endoftext|> in a text", "a<|startoftext|>b", "It's I'll we'd'S", "ＦＵＬＬ ﬁ Å é", "a\xa0b c\x1cd\x85e", "İI ΣΑΣ", "word " * 5000]
    whole(p.pack(docs(spark, texts)).collect(), dict(enumerate(texts)))


def test_encoder_matches_tokenizer_on_random_text():
    rng = random.Random(5)
    alphabet = list("abcXYZ019 \n\t'.,!?-é́ßİΣ漢😀‍\xa0 \x1f<|>") + ["<|endoftext|>", "'s", "'ll", "  "]
    encoder = p.Encoder(p.tokenizer_path(), remembered=50)
    for _ in range(150):
        t = "".join(rng.choices(alphabet, k=rng.randint(0, 60)))
        assert encoder([t], 2)[0].tolist() == ids(t), repr(t)


def test_cuts():
    for n in range(1, 9000, 7):
        c = p.cuts(n, 4096, 1 / 64)
        assert sum(c) == n and all(4096 - 4096 // x * x <= 64 or x == 4096 // (4096 // x) for x in c)


def test_best_fit_fills():
    rows = [[i, 0, n, 0, n, None, None, 0] for i, n in enumerate([4000, 96, 50, 46, 2048, 2048, 4096])]
    bins = p.best_fit(rows, 4096)
    assert sorted(sum(r[2] for r in b) for b in bins) == [96, 4096, 4096, 4096] and sum(map(len, bins)) == 7


def test_empty_and_small_capacity(spark):
    assert p.pack(docs(spark, [])).count() == 0
    texts = ["one two three four five six seven " * k for k in range(1, 30)]
    whole(p.pack(docs(spark, texts), capacity=64).collect(), dict(enumerate(texts)), 64)
