"""Small frames and the comparison of a query with its SQL."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"

#: Rows that every text operator must take: nulls, empty and blank texts, odd characters, a very long word, repeats.
HARD = [None, "", "   \n\t", "a", "a b c", "é ü ß 漢字 😀 ́x", "\x00\x01 zero", "x" * 30_000, "same text here", "same text here", "line\n\nline\nline", "a b c\u0085d"]


def docs(spark, texts, start=0):
    """``documents`` with clashing extra columns."""
    rows = [(start + i, t, "en", "s", len(t or ""), "kept?", 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string, n_words int")


def oracle(sql, sf=SF):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        c.sql(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    r = c.sql(sql)
    return [d[0] for d in r.description], r.fetchall()


def same(df, sql, sf=SF):
    names, rows = oracle(sql, sf)
    assert sorted(names) == sorted(df.columns)
    got = [tuple(r[n] for n in names) for r in df.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, rows))


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}
