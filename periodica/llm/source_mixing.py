"""Mixing sources to target weights by hash thresholds, without a sort.

Every row has a hash of its id and text. A source whose target is ``q`` whole passes and a rest takes each of its rows ``q`` times, and
the rows of the smallest hashes once more until the rest is spent. The hash that ends the rest is found by histograms: sizes are summed
by source and hash bucket, the bucket in which the running sum passes the rest is split into finer buckets by the next bits of the hash,
and so on until that bucket holds a single hash; only its rows are read again. As the order of hashes stays, larger budgets take
supersets of smaller ones.

Targets: the sources, by code point and null last, weigh as given (by default 1, 2, 3, repeating) and share the budget, by default the
size of everything. A target stops at ``most`` times its source's size; the excess goes to the others by weight until none is above.

Edge cases: a null text has no words, a null or empty source is a source of its own, rows of size 0 are taken without effect; a null id
counts as empty in the hash. Rows that are equal in id and text and source have one hash: they are taken alike, all or none once more,
whichever comes nearer to the target. A single row may be larger than its source's rest: it is taken where half of it lies within. An
empty table gives no rows. Only ``doc_id``, ``text`` and ``source`` are read, so other columns may have any names; ``mixture`` keeps them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from periodica.llm.common import WORD, cut, numbered, table, text_or_empty

#: Bits of a row's hash, and those that each histogram resolves.
BITS, STEP = 60, 10


def row_hash(seed: str = "") -> Column:
    """60 bits of the MD5 of the id and the text."""
    joined = F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("\n"), text_or_empty())
    return F.conv(F.substring(F.md5(joined), 1, BITS // 4), 16, 10).cast("long")


def words() -> Column:
    return F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long")


def source_targets(sources: DataFrame, weights: Sequence[int] = (1, 2, 3), share: float = 1.0, most: int = 3) -> DataFrame:
    """``sources`` (source, source_size) with ``target``.

    Sources are numbered by a range sort and the level of the shares is found by sums over all of them, so their count has no bound.
    """
    by_order = F.element_at(F.array(*(F.lit(int(w)) for w in weights)), (F.col("number") % len(weights)).cast("int") + 1).cast("long")
    named = cut(numbered(sources, F.col("source").asc_nulls_last()).select("source", "source_size", by_order.alias("_w"), (most * F.col("source_size")).alias("_cap")), "weights")
    total = named.agg(F.sum("source_size")).first()[0] or 0
    budget = total if share == 1 else int(share * total)
    held, weight, before = 0, None, None
    while before != (held, weight):
        before = held, weight
        above = F.lit(False) if weight is None else F.col("_w") * F.lit(budget - held) / F.lit(weight) > F.col("_cap")
        held, weight = (x or 0 for x in named.agg(F.sum(F.when(above, F.col("_cap"))), F.sum(F.when(~above, F.col("_w")))).first())
        if not weight:  # the budget is larger than all caps
            return named.select("source", "source_size", F.col("_cap").cast("double").alias("target"))
    return named.select("source", "source_size", F.least(F.col("_cap").cast("double"), F.col("_w") * F.lit(budget - held) / F.lit(weight)).alias("target"))


def thresholds(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """``targets`` with ``passes`` and ``last_hash``: rows up to that hash are taken once more.

    ``rows``: (source, size, hash). Each round sums the sizes of the rows in the sources' open buckets, at most 2^STEP buckets a source.
    """
    size, target = F.col("source_size"), F.col("target")
    passes = F.when(size > 0, F.floor(target / size)).otherwise(F.lit(0)).cast("long")
    named = targets.withColumn("passes", passes).withColumn("_rest", target - F.col("passes") * size)
    open_ = cut(named.withColumn("_bucket", F.lit(0).cast("long")).withColumn("_before", F.lit(0).cast("long")), "open")
    found = [open_.where("_rest <= 0").select("source", "source_size", "target", "passes", F.lit(-1).cast("long").alias("last_hash"))]
    open_ = open_.where("_rest > 0")
    for left in range(BITS - STEP, -1, -STEP):
        o = open_.select(F.col("source").alias("_source"), F.col("_bucket").alias("_open"), "_before", "_rest")
        inside = rows.join(o, F.col("source").eqNullSafe(F.col("_source")) & (F.shiftright("hash", left + STEP) == F.col("_open")))
        sums = inside.groupBy("source", F.shiftright("hash", left).alias("_bucket")).agg(
            F.sum("size").alias("_size"), F.min("hash").alias("_least"), F.max("hash").alias("_most"), F.first("_before").alias("_before"), F.first("_rest").alias("_rest")
        )
        so_far = F.sum("_size").over(Window.partitionBy("source").orderBy("_bucket"))
        crossing = F.row_number().over(Window.partitionBy("source").orderBy("_bucket"))
        over = sums.withColumn("_after", F.col("_before") + so_far).where(F.col("_after") > F.col("_rest")).withColumn("_k", crossing).where("_k = 1")
        over = over.select(F.col("source").alias("_source"), "_bucket", (F.col("_after") - F.col("_size")).alias("_before"), "_size", "_least", "_most")
        over = cut(open_.drop("_bucket", "_before").join(over, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source"), "crossing")
        # a single hash ends the rest: its rows are taken if the middle of their sizes lies within
        within = 2 * F.col("_before") + F.col("_size") <= 2 * F.col("_rest")
        last = F.when(F.col("_least").isNull(), F.lit((1 << BITS) - 1)).when(within, F.col("_least")).otherwise(F.col("_least") - 1)
        done = F.col("_least").isNull() | (F.col("_least") == F.col("_most"))
        found.append(over.where(done).select("source", "source_size", "target", "passes", last.alias("last_hash")))
        open_ = over.where(~done).select(*open_.columns)
        if open_.isEmpty():
            break
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    return cut(out, "thresholds")


def copies() -> Column:
    return F.col("passes") + F.when(F.col("hash") <= F.col("last_hash"), F.lit(1)).otherwise(F.lit(0))


def _with_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    named = plan.withColumnRenamed("source", "_source")
    return rows.join(named, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


def mix(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), share: float = 1.0, most: int = 3, seed: str = "") -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, copies and the words taken of it."""
    rows = cut(docs.select("doc_id", F.col("source").cast("string").alias("source"), words().alias("size"), row_hash(seed).alias("hash")), "sizes")
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = thresholds(rows, source_targets(sources, weights, share, most))
    return _with_plan(rows, plan).select("doc_id", "source", "size", "source_size", "target", copies().alias("copies"), (F.col("size") * copies()).alias("taken"))


def mixture(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), share: float = 1.0, most: int = 3, seed: str = "") -> DataFrame:
    """The mix itself: the rows of ``docs`` with all their columns, each as often as it is taken, and ``repeat`` from 1."""
    at = {"size": words(), "hash": row_hash(seed)}
    rows = docs.select(F.struct("*").alias("_row"), F.col("source").cast("string").alias("source"), *(c.alias(n) for n, c in at.items()))
    sized = cut(rows.drop("_row"), "sizes")
    plan = thresholds(sized, source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most))
    taken = _with_plan(rows, plan).withColumn("_n", copies()).where("_n > 0")
    return taken.select("_row.*", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("repeat"))


def op11_source_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


#: The same rows by a sort: running sums over the hash in place of histograms.
ORACLE = r"""
WITH rows AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    substr(md5(concat(coalesce(doc_id::VARCHAR, ''), chr(10), coalesce(text, ''))), 1, 15) AS hash
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM rows GROUP BY source
), ordered AS (
  SELECT *, 3 * source_size AS cap, row_number() OVER (ORDER BY 3.0 * source_size / w, source NULLS LAST) AS k, sum(source_size) OVER () AS total FROM sources
), levels AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held, sum(w) OVER (ORDER BY k DESC) AS weight FROM ordered
), level AS (
  SELECT held, weight, total FROM levels WHERE cap >= w * (total - held)::DOUBLE / weight::DOUBLE ORDER BY k LIMIT 1
), targets AS (
  SELECT s.source, s.source_size, least(s.cap::DOUBLE, (s.w * (l.total - l.held))::DOUBLE / l.weight::DOUBLE) AS target FROM ordered s, level l
), rests AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS passes FROM targets
), summed AS (
  SELECT r.doc_id, r.source, r.size, t.source_size, t.target, t.passes,
    sum(r.size) OVER (PARTITION BY r.source ORDER BY r.hash RANGE UNBOUNDED PRECEDING) AS after,
    sum(r.size) OVER (PARTITION BY r.source, r.hash) AS own
  FROM rows r JOIN rests t ON r.source IS NOT DISTINCT FROM t.source
), counted AS (
  SELECT *, passes + CASE WHEN target > passes * source_size AND 2 * after - own <= 2 * (target - passes * source_size) THEN 1 ELSE 0 END AS n FROM summed
)
SELECT doc_id, source, size, source_size, target, n::BIGINT AS copies, (size * n)::BIGINT AS taken FROM counted
"""
