"""Which person of a roster a name said means: candidates by keys and by tiles, the score of each, and the ranking.

Two names agree if they are equal, if one is a short form of the other, or if they are alike (``similarity``). Candidates for short forms
and equal names meet by keys that every such pair shares. Alike names meet in tiles: the distinct names of both sides are cut into tiles of
at most ``TILE`` names by length, only tiles of compatible lengths meet, and what pairs of letters names have in common rules out nearly all
of a tile's pairs before any is scored. No pair that agrees is lost, and no group is larger than two tiles.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from periodica.functions import similarity
from periodica.operators.stored import stored

# What stands where no name could be read, and the lead a best candidate needs.
PLACEHOLDERS = (
    "john doe", "jane doe", "john smith", "first last", "firstname lastname", "employee name", "full name", "name", "employee", "test",
    "testing", "sample", "n/a", "na", "none", "unknown", "xxxx", "xxx", "abc", "string",
)
LEAD = 8

TILE = 1 << 14
#: Sorted words that are alike by ``TOKEN_RATIO`` are at most so many times as long as one another.
STRETCH = (200 - similarity.TOKEN_RATIO) / similarity.TOKEN_RATIO + 1e-6
#: Names of more words give a key for each word, others one for each pair of words.
MANY_WORDS = 16

SCORED = "said string, name string, score double"


def is_placeholder(name: Column) -> Column:
    """A known placeholder, or fewer than two letters; null counts as one."""
    n = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    return n.isin(*PLACEHOLDERS) | (F.char_length(F.regexp_replace(n, r"\P{L}", "")) < 2)


def _scored(said: list | pa.Array, name: pa.Array, i: np.ndarray, j: np.ndarray, names: similarity.Names) -> pa.RecordBatch:
    """Rows (said, name, score) of the pairs (i, j) that agree; i and j are rows of ``names``, said and name its two halves."""
    score = np.round(similarity.scores(names, i, j), 4)
    ok = np.flatnonzero(~np.isnan(score))
    return pa.RecordBatch.from_arrays([said.take(pa.array(i[ok])), name.take(pa.array(j[ok])), pa.array(score[ok])], names=["said", "name", "score"])


def scored_pairs(pairs: DataFrame) -> DataFrame:
    """(said, name, score) of the rows (said, name) that agree."""

    def run(batches):
        for b in batches:
            both = pa.concat_arrays([b.column(0), b.column(1)]).dictionary_encode()
            at, texts = both.indices.to_numpy(), both.dictionary
            yield _scored(texts, texts, at[: b.num_rows], at[b.num_rows :], similarity.Names(texts.to_pylist()))

    return pairs.select("said", "name").where("said is not null and name is not null").mapInArrow(run, SCORED)


# --- candidates by keys: short forms and equal names ---


def _words(name: Column) -> Column:
    return F.filter(F.split(F.lower(F.trim(name)), "[^a-z0-9]+"), lambda w: w != "")


def _word_keys(word: Column, shorter: bool) -> Column:
    """What two words that match have in common: three letters, the word itself if it has fewer, or an initial of one and the other's."""
    n, first = F.char_length(word), F.substring(word, 1, 1)
    whole = F.concat(F.least(n, F.lit(3)).cast("string"), F.substring(word, 1, 3))
    mixed = F.concat(F.when((n == 1) == F.lit(shorter), F.lit("i")).otherwise(F.lit("f")), first)
    return F.array(whole, mixed)


def _pair_keys(x: Column, y: Column, shorter: bool) -> Column:
    both = lambda a: F.transform(_word_keys(y, shorter), lambda b: F.concat_ws("|", F.least(a, b), F.greatest(a, b)))
    return F.flatten(F.transform(_word_keys(x, shorter), both))


def short_keys(name: Column) -> Column:
    """Keys of a name as the shorter one of a pair: of its two longest words, or of its only one."""
    def of(words):
        by_size = F.array_sort(words, lambda a, b: F.char_length(b) - F.char_length(a))
        one = F.transform(_word_keys(F.get(words, F.lit(0)), True), lambda k: F.concat(F.lit("last:"), k))
        pairs = F.transform(_pair_keys(F.get(by_size, F.lit(0)), F.get(by_size, F.lit(1)), True), lambda k: F.concat(F.lit("pair:"), k))
        single = F.transform(_word_keys(F.get(by_size, F.lit(0)), True), lambda k: F.concat(F.lit("word:"), k))
        return F.when(F.size(words) == 0, F.array().cast("array<string>")).when(F.size(words) == 1, one).otherwise(F.concat(pairs, single))

    return F.concat(F.array(F.concat(F.lit("="), F.lower(F.trim(name)))), of(_words(name)))


def long_keys(name: Column) -> Column:
    """Keys of a name as the longer one: of every pair of its words, and of its last word."""
    def of(words):
        last = F.transform(_word_keys(F.element_at(words, -1), False), lambda k: F.concat(F.lit("last:"), k))
        pairs = F.flatten(F.transform(words, lambda x, i: F.flatten(F.transform(F.slice(words, i + 2, MANY_WORDS), lambda y: _pair_keys(x, y, False)))))
        single = F.flatten(F.transform(words, lambda w: _word_keys(w, False)))
        named = F.when(F.size(words) > MANY_WORDS, F.transform(single, lambda k: F.concat(F.lit("word:"), k))).otherwise(F.transform(pairs, lambda k: F.concat(F.lit("pair:"), k)))
        return F.when(F.size(words) == 0, F.array().cast("array<string>")).otherwise(F.concat(last, named))

    return F.concat(F.array(F.concat(F.lit("="), F.lower(F.trim(name)))), of(_words(name)))


def keyed_pairs(said: DataFrame, names: DataFrame) -> DataFrame:
    """(said, name) of all pairs of which one can be a short form of the other, and of the equal ones."""

    def by(a, b):
        left = said.select("said", F.explode(F.array_distinct(a(F.col("said")))).alias("key"))
        right = names.select("name", F.explode(F.array_distinct(b(F.col("name")))).alias("key"))
        # a name gives some twenty keys, which its table's size says nothing of: never broadcast through the driver
        return left.join(right.hint("merge"), "key").select("said", "name")

    return by(short_keys, long_keys).unionAll(by(long_keys, short_keys)).distinct()


# --- candidates by tiles: names that are alike ---


def _tiled(names: DataFrame, column: str) -> tuple[DataFrame, dict[int, int]]:
    """``names`` with the class of their length and a tile in it, and the number of tiles of each class."""
    size = F.char_length(F.array_join(F.array_sort(F.filter(F.split(F.lower(F.trim(column)), r"\s+"), lambda w: w != "")), " "))
    of = names.select(column, size.alias("size")).where("size > 0").withColumn("kind", F.floor(F.log("size") / math.log(STRETCH)).cast("int"))
    # a row for each class of length: at most some tens of them
    tiles = {r.kind: -(-r.n // TILE) for r in of.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    many = F.create_map(*(F.lit(int(x)) for kv in tiles.items() for x in kv)) if tiles else F.create_map().cast("map<int,int>")
    return of.select(column, "kind", F.pmod(F.xxhash64(column), F.element_at(many, F.col("kind"))).cast("int").alias("tile")), tiles


def _met(names: DataFrame, column: str, tiles: dict[int, int], mine: str, other: str) -> DataFrame:
    """Each name in every meeting of its tile with a tile of the other side."""
    # an expression of the same size however many tiles there are
    many = F.create_map(*(F.lit(int(x)) for kv in tiles.items() for x in kv))
    count = lambda c: F.coalesce(F.try_element_at(many, c), F.lit(0))
    of = lambda c: F.transform(F.filter(F.sequence(F.lit(0), count(c)), lambda t: t < count(c)), lambda t: F.struct(c.alias("k"), t.alias("t")))
    each = names.withColumn("met", F.explode(F.concat(*(of(F.col("kind") + k) for k in (-1, 0, 1)))))
    own = [F.col("kind").alias(f"{mine}_kind"), F.col("tile").alias(f"{mine}_tile")]
    return each.select(column, *own, F.col("met.k").alias(f"{other}_kind"), F.col("met.t").alias(f"{other}_tile"))


def alike_pairs(said: DataFrame, names: DataFrame) -> DataFrame:
    """(said, name, score) of all pairs that are alike; distinct ``said`` and ``name``."""
    a, a_tiles = _tiled(said, "said")
    b, b_tiles = _tiled(names, "name")
    if not a_tiles or not b_tiles:
        return said.sparkSession.createDataFrame([], SCORED)
    key = ["a_kind", "a_tile", "b_kind", "b_tile"]

    def tile(x: pa.Table, y: pa.Table) -> pa.Table:
        n, m = x.num_rows, y.num_rows
        if not n or not m:
            return pa.table({"said": pa.array([], pa.string()), "name": pa.array([], pa.string()), "score": pa.array([], pa.float64())})
        texts = pa.chunked_array([*x["said"].chunks, *y["name"].chunks]).combine_chunks()
        prepared = similarity.Names(texts.to_pylist())
        i, j = similarity.may_be_alike(prepared, np.arange(n), np.arange(n, n + m))
        # short forms and equal names, which need not be alike by their words, meet by keys
        i, j = similarity.by_words(prepared, i, j + n)
        return pa.Table.from_batches([_scored(texts, texts, i, j, prepared)])

    left, right = _met(a, "said", b_tiles, "a", "b"), _met(b, "name", a_tiles, "b", "a")
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(tile, SCORED)


def agreeing(said: DataFrame, names: DataFrame) -> DataFrame:
    """(said, name, score) of every pair that agrees, of distinct ``said`` and distinct ``name``."""
    return scored_pairs(keyed_pairs(said, names)).unionAll(alike_pairs(said, names)).distinct()


# --- who is meant ---


def resolve(asked: DataFrame, roster: DataFrame, key: str | None = None) -> DataFrame:
    """asked_id, match, n: the roster row (id, name) that a name said means, and how many agree with it.

    One that agrees is the match; of several the best if it leads by ``LEAD``. With ``key`` only rows of the same key are
    candidates. Distinct names are compared once, however many say or bear them.
    """
    keys = [key] if key else []
    said = asked.where(F.col("said").isNotNull()).select("said", *keys).distinct()
    people = roster.where(F.col("name").isNotNull()).groupBy("name", *keys).agg(F.min("id").alias("id"), F.count("*").alias("bearers"))
    if key:
        pairs = said.join(people.select("name", key), key)
        found = pairs.join(scored_pairs(pairs.select("said", "name").distinct()), ["said", "name"])
    else:
        found = agreeing(said, people.select("name"))
    found = found.join(people, ["name", *keys])
    by_said = Window.partitionBy("said", *keys)
    order = by_said.orderBy(F.desc("score"), "id")
    gap = F.when(F.col("bearers") > 1, F.lit(0.0)).otherwise(F.col("score") - F.lead("score").over(order))
    best = found.withColumn("gap", gap).withColumn("n", F.sum("bearers").over(by_said)).withColumn("rank", F.row_number().over(order)).where("rank = 1")
    sure = F.when(F.col("gap").isNull() | (F.col("gap") >= LEAD), F.col("id"))
    best = best.select("said", *keys, sure.alias("match"), "n")
    return asked.join(best, ["said", *keys], "left").select("asked_id", "match", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def match_people(asked: DataFrame, roster: DataFrame, write: Callable[[DataFrame], DataFrame] = stored) -> DataFrame:
    """asked_id, match, code of every row of ``asked`` (asked_id, badge, name; optionally hint, a roster id).

    Roster: id, badge, name. The name decides first (the hinted person if it agrees, then the one person that it means), then the badge
    with the name; a badge without a name that agrees is no match. Codes: ``email_and_name`` for the hinted person, ``id_and_name``
    where the badge is the person's own or decided, else ``name_primary``; ``ambiguous_id``, ``no_match`` and ``no_identity`` without one.
    """
    hint = F.col("hint") if "hint" in asked.columns else F.lit(None).cast(dict(roster.dtypes)["id"])
    badge = F.nullif(F.upper(F.trim("badge")), F.lit(""))
    rows = asked.select("asked_id", badge.alias("badge"), F.when(~is_placeholder(F.col("name")), F.lower(F.trim("name"))).alias("said"), hint.alias("hint"))
    # both are read several times, and what they are made of may be one small file
    rows, people = write(rows), write(roster.select("id", badge.alias("badge"), "name"))
    hinted = rows.join(people.select(F.col("id").alias("hint"), "name"), "hint").select("asked_id", "hint", "said", "name")
    agrees = scored_pairs(hinted.select("said", "name").distinct())
    hinted = hinted.join(agrees, ["said", "name"]).select("asked_id", F.col("hint").alias("by_hint"))
    by_name = resolve(rows.select("asked_id", "said"), people.select("id", "name")).select("asked_id", F.col("match").alias("by_name"))
    by_badge = resolve(rows.select("asked_id", "said", "badge"), people.where("badge is not null"), "badge").select("asked_id", F.col("match").alias("by_badge"))
    shared = people.groupBy("badge").agg(F.count("*").alias("sharing"))
    found = rows.join(hinted, "asked_id", "left").join(by_name, "asked_id", "left").join(by_badge, "asked_id", "left").join(shared, "badge", "left")
    found = found.withColumn("named", F.coalesce("by_hint", "by_name")).join(people.select(F.col("id").alias("named"), F.col("badge").alias("own")), "named", "left")
    code = (
        F.when(F.col("badge").isNull() & F.col("said").isNull(), "no_identity")
        .when(F.col("by_hint").isNotNull(), "email_and_name")
        .when(F.col("named").isNotNull(), F.when(F.col("badge") == F.col("own"), "id_and_name").otherwise("name_primary"))
        .when(F.col("said").isNull() | F.col("sharing").isNull(), "no_match")
        .when(F.col("by_badge").isNotNull(), "id_and_name")
        .when(F.col("sharing") > 1, "ambiguous_id")
        .otherwise("no_match")
    )
    match = F.when(code.isin("email_and_name", "name_primary", "id_and_name"), F.coalesce("named", "by_badge"))
    return found.select("asked_id", match.alias("match"), code.alias("code"))


def by_address(asked: DataFrame, roster: DataFrame) -> DataFrame:
    """asked_id, match, address of every row of ``asked`` (asked_id, candidates): the roster row (id, addresses) of the first candidate
    address that anyone has, null if nobody has any; of several people the one of the smallest id."""
    known = roster.select("id", F.explode("addresses").alias("address")).groupBy("address").agg(F.min("id").alias("id"))
    each = asked.select("asked_id", F.posexplode("candidates").alias("place", "address")).join(known, "address")
    first = each.groupBy("asked_id").agg(F.min(F.struct("place", "id", "address")).alias("m"))
    return asked.select("asked_id").join(first, "asked_id", "left").select("asked_id", F.col("m.id").alias("match"), "m.address")
