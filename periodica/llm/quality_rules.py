"""Quality rules: line-first cleaning, in DataFrame functions only.

Every line is judged by three rules; failing lines are removed, and a document that loses too much of its text is
rejected:

* punctuation: symbol runs (``#*$%&<>`` or repeated ``!``) on more than a fifth of the words, or a line of
  ``min_words`` or more words without any sentence end;
* navigation: two or more separators (``|``, ``»``, ``›``, ``•``) and at least one per five words;
* boilerplate: a line of at most 25 words with a rights, licence, cookie or sign-up phrase.

A document is rejected if the lines that fail any of the three rules hold more than ``max_lost`` of the text of its
lines, or if no line is left. Lines without a word are neither counted nor kept.

Edge cases: a null text counts as empty, has no words, and fails the base rules. Repeated rows are judged one by one.
The input may have any other columns; only ``doc_id`` and the text column are read. Windows of five words are compared
by their 64-bit hash chained over the words.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from periodica.llm.common import WORD, WS, let, table

# Symbols of the base rule, and the phrases of the boilerplate rule.
SYMBOLS = "#*$%&|<>"
BOILERPLATE = (
    "all rights reserved|licensed under|released under|copyright|cookie|privacy policy|terms of use|terms of service"
    "|subscribe|sign up|log in|javascript|lorem ipsum"
    "|tous droits réservés|politique de confidentialité|alle rechte vorbehalten|datenschutzerklärung"
    "|todos los derechos reservados|política de privacidad"
)

MARKS = r"[#*$%&<>]+|!!+"
SEPARATORS = "[|»›•]"
SENTENCE_END = rf"""[.!?…]["'”»)]*([{WS}]|$)"""


def without(text: Column, chars: str, mark: str = "") -> Column:
    """``text`` with ``mark`` for each of ``chars``; scans bytes, so it costs less than a regular expression."""
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(mark))
    return text


def words_of(text: Column) -> Column:
    return F.filter(F.split(without(text, "\t\n\x0b\x0c\r", " "), " "), lambda w: w != "")


def repeat_words(words: Column) -> Column:
    """Words inside five-word windows that occur twice or more in the text, the first included."""
    n = F.size(words)

    def covered(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def of(s: Column) -> Column:
            twice = F.filter(
                s, lambda x, j: F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False))
            )
            return let(
                F.sort_array(F.transform(twice, lambda x: x["i"])),
                lambda p: F.aggregate(F.sequence(F.lit(1), F.size(p) - 1), F.lit(5), lambda acc, j: acc + F.least(F.lit(5), F.get(p, j) - F.get(p, j - 1))),
            )

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(
            let(ordered, lambda s: let(F.size(s), lambda _: of(s)))
        )

    hashes = F.transform(
        F.sequence(F.lit(0), n - 5), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2), F.get(words, i + 3), F.get(words, i + 4))
    )
    return F.when(n < 6, F.lit(0)).otherwise(let(hashes, covered))


def line_verdict(line: Column, min_words: int, marked: Column, separated: Column) -> Column:
    """'' if the line stays, else the rule that it fails.

    ``marked`` and ``separated``: whether the text has any mark or separator. Words are counted where a rule asks.
    """
    n = F.regexp_count(line, F.lit(WORD))
    marks = F.when(marked, F.regexp_count(line, F.lit(MARKS))).otherwise(0)
    separators = F.when(separated, F.regexp_count(line, F.lit(SEPARATORS))).otherwise(0)
    said = let(F.lower(line), lambda low: functools.reduce(lambda a, b: a | b, (low.contains(p) for p in BOILERPLATE.split("|"))))
    return (
        F.when(let(marks, lambda k: (k >= 2) & (k * 5 > n)), F.lit("punctuation"))
        .when(let(separators, lambda k: (k >= 2) & (k * 5 >= n)), F.lit("navigation"))
        .when(said & (n <= 25), F.lit("boilerplate"))
        .when(~line.rlike(SENTENCE_END) & (n >= min_words), F.lit("punctuation"))
        .otherwise(F.lit(""))
    )


def judged(text: Column, min_words: int = 8, max_lost: float = 0.5) -> Column:
    """A struct of the figures of a text (null: empty), ``kept`` and the cleaned text."""

    def by_line(t: Column, n_symbols: Column) -> Column:
        def of(flags: Column) -> Column:
            return let(
                F.filter(F.split(t, "\n", -1), lambda x: x.rlike(rf"[^{WS}]")),
                lambda lines: F.struct(
                    (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
                    F.transform(
                        lines, lambda x: F.struct(x.alias("line"), line_verdict(x, min_words, flags["marked"], flags["separated"]).alias("rule"))
                    ).alias("judged"),
                ),
            )

        other = t.contains("»") | t.contains("›") | t.contains("•")
        return let(F.struct(((n_symbols > 0) | t.contains("!!")).alias("marked"), ((n_symbols > 0) | other).alias("separated")), of)

    def figures(t: Column) -> Column:
        n_symbols = (F.octet_length(t) - F.octet_length(without(t, SYMBOLS))).cast("long")
        by_word = let(
            words_of(t),
            lambda w: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
                repeat_words(w).cast("long").alias("n_repeat_words"),
            ),
        )
        return let(n_symbols, lambda k: F.struct(k.alias("n_symbols"), by_line(t, k).alias("by_line"), by_word.alias("by_word")))

    def chars(lines: Column, *rules: str) -> Column:
        return F.aggregate(lines, F.lit(0).cast("long"), lambda acc, x: acc + F.when(x["rule"].isin(*rules), F.char_length(x["line"])).otherwise(0))

    def row(f: Column) -> Column:
        n, repeated, lines = f["by_word"]["n_words"], f["by_word"]["n_repeat_words"], f["by_line"]["judged"]
        first = F.struct(
            ((n < 10) | (repeated * 100 > n * 20)).alias("base_failed"),
            chars(lines, "punctuation", "navigation").alias("chars_failed"),
            chars(lines, "boilerplate").alias("chars_boilerplate"),
            chars(lines, "").alias("chars_left"),
        )

        def whole(g: Column) -> Column:
            lost = g["chars_failed"] + g["chars_boilerplate"]
            lost_little = (g["chars_left"] > 0) & (lost <= F.lit(max_lost) * (lost + g["chars_left"]))
            return F.struct(
                n.alias("n_words"),
                f["by_word"]["word_chars"].alias("word_chars"),
                f["n_symbols"].alias("n_symbols"),
                f["by_line"]["n_dup_lines"].alias("n_dup_lines"),
                repeated.alias("n_repeat_words"),
                *(g[k].alias(k) for k in ("base_failed", "chars_failed", "chars_boilerplate", "chars_left")),
                (~g["base_failed"] & lost_little).alias("kept"),
                F.array_join(F.transform(F.filter(lines, lambda x: x["rule"] == ""), lambda x: x["line"]), "\n").alias("clean_text"),
            )

        return let(first, whole)

    return let(F.coalesce(text.cast("string"), F.lit("")), lambda t: let(figures(t), row))


def judge(docs: DataFrame, text: str = "text", **params) -> DataFrame:
    """Per row of ``docs``: doc_id, the base figures, ``kept`` and the cleaned text."""
    return docs.select("doc_id", judged(F.col(text), **params).alias("r")).select("doc_id", "r.*")


def clean(docs: DataFrame, **params) -> DataFrame:
    """Documents that pass, with the columns of ``docs``: failing lines are gone and ``n_chars`` follows the text.

    Rows are judged in place, so repeated ids and nulls need no join; a generator drops the rejected ones, so that
    nothing is judged a second time for a filter.
    """
    r = F.col("_r")
    new = {"text": r["clean_text"], "n_chars": F.char_length(r["clean_text"]).cast(dict(docs.dtypes).get("n_chars", "long"))}
    row = F.struct(F.lit(True).alias("_kept"), *(new.get(c, F.col("_doc")[c]).alias(c) for c in docs.columns))
    both = docs.select(F.struct(*docs.columns).alias("_doc"), judged(F.col("text"), **params).alias("_r"))
    return both.select(F.inline_outer(F.when(r["kept"], F.array(row)))).where("_kept").drop("_kept")


COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "chars_failed", "chars_boilerplate", "chars_left"]


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select(*COLUMNS)


ORACLE = r"""
with d as (select doc_id, coalesce(text, '') as t from documents),
w as (select doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from d),
pos as (select doc_id, unnest(range(len(ws) - 4)) as i, ws from w where len(ws) >= 5),
win as (select doc_id, i, array_to_string(list_slice(ws, i + 1, i + 5), ' ') as g from pos),
twice as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as c from win) where c > 1),
gap as (select doc_id, least(5, coalesce(lead(i) over (partition by doc_id order by i) - i, 5)) as c from twice),
rep as (select doc_id, sum(c) as n_repeat_words from gap group by doc_id),
ln as (select doc_id, line from (select doc_id, unnest(string_split(t, chr(10))) as line from d) where regexp_matches(line, '[^\x20\x09-\x0D]')),
cnt as (select doc_id, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) as n, len(regexp_extract_all(line, '[#*$%&<>]+|!!+')) as marks,
               len(regexp_extract_all(line, '[|»›•]')) as seps from ln),
rule as (select doc_id, line, case
           when marks >= 2 and marks * 5 > n then 'punctuation'
           when seps >= 2 and seps * 5 >= n then 'navigation'
           when n <= 25 and regexp_matches(lower(line), '""" + BOILERPLATE + r"""') then 'boilerplate'
           when n >= 8 and not regexp_matches(line, '[.!?…]["''”»)]*([\x20\x09-\x0D]|$)') then 'punctuation'
           else '' end as r from cnt),
per as (select doc_id, count(*) - count(distinct line) as n_dup_lines,
               coalesce(sum(length(line)) filter (r in ('punctuation', 'navigation')), 0) as chars_failed,
               coalesce(sum(length(line)) filter (r = 'boilerplate'), 0) as chars_boilerplate,
               coalesce(sum(length(line)) filter (r = ''), 0) as chars_left from rule group by doc_id),
base as (select doc_id, cast(len(ws) as bigint) as n_words,
                cast(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) as bigint) as word_chars,
                cast(len(regexp_extract_all(t, '[#*$%&|<>]')) as bigint) as n_symbols,
                cast(coalesce(n_dup_lines, 0) as bigint) as n_dup_lines,
                cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words,
                cast(coalesce(chars_failed, 0) as bigint) as chars_failed,
                cast(coalesce(chars_boilerplate, 0) as bigint) as chars_boilerplate,
                cast(coalesce(chars_left, 0) as bigint) as chars_left
         from w left join rep using (doc_id) left join per using (doc_id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 10 or 100 * n_repeat_words > 20 * n_words) as base_failed,
       not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and chars_left > 0
         and chars_failed + chars_boilerplate <= 0.5 * (chars_failed + chars_boilerplate + chars_left) as kept,
       chars_failed, chars_boilerplate, chars_left
from base
"""
