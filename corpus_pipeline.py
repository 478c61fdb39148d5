"""A corpus pipeline of five stages over ``documents``.

Every stage but the last returns the columns of its input, whatever they are called, and ``n_chars`` follows the text where the
text changes. A null text counts as empty and goes in the first stage, as does an empty one. Rows that repeat are judged one by
one, and the near-duplicate stage keeps one of them; rows without an id can't be told apart and stay. An empty table gives no
rows at any stage. Texts are taken whole.
"""

from __future__ import annotations

from periodica.llm import decontamination, packing, quality_rules, secret_scan, simhash_dedup
from periodica.llm.common import cut, table


def quality(spark, docs, sf_dir):
    """Documents that pass the quality rules, without the lines that fail."""
    return quality_rules.clean(docs)


def near_duplicates(spark, docs, sf_dir):
    """One document, that of the smallest id, of each group of near copies."""
    return simhash_dedup.dedup(docs, **simhash_dedup.NEAR_COPIES)


def benchmark(spark, docs, sf_dir):
    """Documents that share no passage with a benchmark item."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark, docs, sf_dir):
    """All documents, with secrets replaced by a mark."""
    return secret_scan.redact(docs)


def pack(spark, docs, sf_dir):
    """The pieces of all documents in sequences of a fixed capacity."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality),
    ("simhash_dedup", near_duplicates),
    ("decontamination", benchmark),
    ("secret_scan", secrets),
    ("packing", pack),
]

#: Fingerprints, fuzzy matches and token ids are beyond SQL; tests/llm/test_pipeline_brute_force.py has a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
