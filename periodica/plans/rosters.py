"""Roster coverage, team roll-ups, roster diffs and upserts. Roster: customer; filed records: orders; received: events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from periodica.functions import names
from periodica.operators import matching
from periodica.operators import predicates as p
from periodica.operators import relational as rel
from periodica.plans.registry import query, table as t


def _filed(spark, sf_dir, year=1997, month=1):
    return p.period(t(spark, sf_dir, "orders"), "o_orderdate", year, month)


def _received(spark, sf_dir):
    return t(spark, sf_dir, "events").where("event_type = 'purchase'").select("user_id")


@query(
    """
    with s as (select distinct o_custkey as k from orders
               where o_orderdate >= timestamp '1997-01-01' and o_orderdate < timestamp '1997-02-01'),
         r as (select distinct user_id as k from events where event_type = 'purchase')
    select count(*) as total, count(*) filter (s.k is not null) as submitted,
           count(*) filter (s.k is null and r.k is not null) as awaiting,
           count(*) filter (s.k is null and r.k is null) as missing
    from customer c left join s on s.k = c.c_custkey left join r on r.k = c.c_custkey
    """
)
def coverage_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    roster = t(spark, sf_dir, "customer").select("c_custkey")
    r = rel.keyed_partition(roster, "c_custkey", submitted=_filed(spark, sf_dir).select("o_custkey"), awaiting=_received(spark, sf_dir))
    return r.agg(F.count("*").alias("total"), *(F.count_if(F.col("state") == s).alias(s) for s in ("submitted", "awaiting", "missing")))


@query("""select c_custkey, c_name from customer where c_custkey not in (select o_custkey from orders where o_orderdate >= timestamp '1997-01-01' and o_orderdate < timestamp '1997-02-01')
          and c_custkey not in (select user_id from events where event_type = 'purchase' and user_id is not null)""")
def missing_anti(spark, sf_dir):
    roster = t(spark, sf_dir, "customer").select("c_custkey", "c_name")
    left = roster.join(_filed(spark, sf_dir).select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")
    return left.join(_received(spark, sf_dir).where("user_id is not null").toDF("c_custkey"), "c_custkey", "left_anti")


@query("""with f as (select o_custkey, max(case o_orderstatus when 'F' then 2 when 'O' then 1 else 0 end) as s from orders
                     where o_orderdate >= timestamp '1997-01-01' and o_orderdate < timestamp '1997-07-01' group by o_custkey)
          select coalesce(c_mktsegment, '—') as team, count(*) as total, count(s) as submitted, count(*) filter (s = 2) as approved,
                 count(*) filter (s = 1) as pending, count(*) filter (s is null) as missing,
                 round(100.0 * count(s) / count(*), 1) as submitted_percent
          from customer left join f on o_custkey = c_custkey group by 1""")
def team_overview(spark, sf_dir):
    day, status = F.col("o_orderdate"), F.col("o_orderstatus")
    filed = t(spark, sf_dir, "orders").where((day >= "1997-01-01") & (day < "1997-07-01")).groupBy(F.col("o_custkey").alias("c_custkey"))
    filed = filed.agg(F.max(F.when(status == "F", 2).when(status == "O", 1).otherwise(0)).alias("s"))
    g = t(spark, sf_dir, "customer").join(filed, "c_custkey", "left").groupBy(F.coalesce("c_mktsegment", F.lit("—")).alias("team"))
    return g.agg(
        F.count("*").alias("total"), F.count("s").alias("submitted"), F.count_if(F.col("s") == 2).alias("approved"), F.count_if(F.col("s") == 1).alias("pending"),
        F.count_if(F.col("s").isNull()).alias("missing"), F.round(100.0 * F.count("s") / F.count("*"), 1).alias("submitted_percent"),
    )


@query("""select o_custkey, count(*) as submitted, count(*) filter (o_orderstatus = 'F') as approved, count(*) filter (o_orderstatus <> 'F') as not_approved,
                 string_agg(distinct strftime(o_orderdate, '%Y-%m'), ',' order by strftime(o_orderdate, '%Y-%m')) as months,
                 max(strftime(o_orderdate, '%Y-%m-%d')) as newest from orders where year(o_orderdate) = 1998 group by o_custkey""")
def employee_overview(spark, sf_dir):
    month = F.date_format("o_orderdate", "yyyy-MM")
    return p.period(t(spark, sf_dir, "orders"), "o_orderdate", 1998).groupBy("o_custkey").agg(
        F.count("*").alias("submitted"), F.count_if(F.col("o_orderstatus") == "F").alias("approved"), F.count_if(F.col("o_orderstatus") != "F").alias("not_approved"),
        F.array_join(F.sort_array(F.collect_set(month)), ",").alias("months"), F.max(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("newest"),
    )


@query("""select count(distinct c_custkey) as people, count(distinct o_orderkey) as records, count(distinct c_nationkey) as offices
          from orders join customer on c_custkey = o_custkey where o_orderstatus = 'P'""")
def distinct_after_join(spark, sf_dir):
    o = t(spark, sf_dir, "orders").where("o_orderstatus = 'P'").join(t(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    return o.agg(*(F.count_distinct(c).alias(n) for c, n in (("c_custkey", "people"), ("o_orderkey", "records"), ("c_nationkey", "offices"))))


@query("""select n_name, r_name, count(c_custkey) as people, coalesce(sum(case when c_acctbal < 0 then 1 end), 0) as overdrawn
          from nation join region on r_regionkey = n_regionkey left join customer on c_nationkey = n_nationkey group by n_name, r_name""")
def office_rollup(spark, sf_dir):
    n = t(spark, sf_dir, "nation").join(t(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    c = t(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("people"), F.count_if(F.col("c_acctbal") < 0).alias("overdrawn"))
    return n.join(c, "n_nationkey", "left").select("n_name", "r_name", *(F.coalesce(x, F.lit(0).cast("long")).alias(x) for x in ("people", "overdrawn")))


@query("""with o as (select p_partkey, p_name, p_brand, p_size from part where p_partkey % 5 <> 0),
               n as (select p_partkey, p_name, case when p_partkey % 3 = 0 then upper(p_brand) || '!' when p_partkey % 11 = 0 then null else p_brand end as p_brand,
                            case when p_partkey % 7 = 0 then p_size + 1 else p_size end as p_size from part where p_partkey % 4 <> 0),
               b as (select coalesce(o.p_partkey, n.p_partkey) as p_partkey, o.p_partkey is null as a, n.p_partkey is null as m,
                            n.p_brand is not null and n.p_brand is distinct from o.p_brand as x, n.p_size is not null and n.p_size is distinct from o.p_size as y
                     from o full join n on o.p_partkey = n.p_partkey)
          select p_partkey, case when a then 'add' when m then 'missing' when x or y then 'update' else 'unchanged' end as change,
                 case when a or m then '' else concat_ws(',', case when x then 'p_brand' end, case when y then 'p_size' end) end as fields from b""")
def dimension_diff(spark, sf_dir):
    part = t(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    k = F.col("p_partkey")
    brand = F.when(k % 3 == 0, F.concat(F.upper("p_brand"), F.lit("!"))).when(k % 11 == 0, F.when(k % 2 == 0, F.lit("  "))).otherwise(F.concat(F.col("p_brand"), F.lit(" ")))
    new = part.where(k % 4 != 0).select(k, brand.alias("p_brand"), F.when(k % 7 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")).alias("p_size"))
    return rel.diff(part.where(k % 5 != 0), new, ["p_partkey"], ["p_brand", "p_size"])


@query("""with o as (select * from supplier where s_suppkey % 3 <> 0), n as (select s_suppkey, case when s_suppkey % 2 = 0 then null else upper(s_name) end as s_name,
                 s_nationkey + 100 as s_nationkey, s_acctbal from supplier where s_suppkey % 4 <> 0)
          select coalesce(o.s_suppkey, n.s_suppkey) as s_suppkey, coalesce(n.s_name, o.s_name) as s_name,
                 case when o.s_suppkey is not null then o.s_nationkey else n.s_nationkey end as s_nationkey, coalesce(n.s_acctbal, o.s_acctbal) as s_acctbal
          from o full join n on o.s_suppkey = n.s_suppkey""")
def upsert_merge(spark, sf_dir):
    s, k = t(spark, sf_dir, "supplier"), F.col("s_suppkey")
    name = F.when(k % 2 != 0, F.upper("s_name"))
    new = s.where(k % 4 != 0).withColumn("s_name", name).withColumn("s_nationkey", (F.col("s_nationkey") + 100).cast("int"))
    return rel.upsert(s.where(k % 3 != 0), new, ["s_suppkey"], keep=["s_nationkey"])


@query("""select s_suppkey, s_name from supplier where s_suppkey % 2 = 0 union all
          select s_suppkey, s_name from supplier where s_suppkey % 2 = 1 and s_acctbal < 0""")
def keyed_sync(spark, sf_dir):
    s = t(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    return rel.keyed_sync(s, s.where("s_suppkey % 2 = 0"), "s_suppkey", F.col("s_acctbal") < 0).select("s_suppkey", "s_name")


@query("""with r as (select c_custkey as id, c_custkey % 50 as badge, lower(c_name) as name from customer), f as (select event_id, user_id as badge,
                 'customer#' || lpad(cast(event_id % 2000 as varchar), 9, '0') as name from events where event_type = 'signup'),
               a as (select badge, min(id) as id from r group by badge), b as (select name, min(id) as id from r group by name)
          select event_id, coalesce(a.id, b.id) as match from f left join a using (badge) left join b using (name)""")
def either_key_join(spark, sf_dir):
    r = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 50).alias("badge"), F.lower("c_name").alias("name"))
    made = F.concat(F.lit("customer#"), F.lpad((F.col("event_id") % 2000).cast("string"), 9, "0"))
    f = t(spark, sf_dir, "events").where("event_type = 'signup'").select("event_id", F.col("user_id").alias("badge"), made.alias("name"))
    return rel.either_key(f, r, "badge", "name").select("event_id", "match")


@query()
def fuzzy_resolve(spark, sf_dir):
    """Every part's name with a letter lost and its second word an initial, against the names of all parts: the one that it means, or none.

    Every pair that agrees is a candidate; tests compare the result with scoring all pairs.
    """
    named = t(spark, sf_dir, "part").groupBy("p_name").agg(F.min("p_partkey").alias("id"))
    roster = named.select("id", F.col("p_name").alias("name"))
    words = F.split("p_name", " ")
    said = F.array_join(F.transform(words, lambda w, i: F.when(i == 1, F.substring(w, 1, 1)).when(i == 0, F.concat(F.substring(w, 1, 3), F.substring(w, F.lit(5), F.char_length(w)))).otherwise(w)), " ")
    asked = named.select(F.col("id").alias("asked_id"), said.alias("said"))
    found = names.resolve(asked, roster)
    code = F.when(F.col("match").isNotNull(), "matched").when(F.col("n") > 1, "ambiguous").otherwise("no_match")
    return found.select(F.col("asked_id").alias("asked"), "match", code.alias("code"))


@query("""select c_custkey, o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as day from customer
          left join (select * from orders where year(o_orderdate) = 1998 qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1) on o_custkey = c_custkey""")
def roster_grid(spark, sf_dir):
    """The whole roster, each with its last record of a year or none."""
    filed = p.period(t(spark, sf_dir, "orders"), "o_orderdate", 1998).select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderdate")
    grid = matching.last_wins(t(spark, sf_dir, "customer").select("c_custkey"), filed, "c_custkey", F.desc("o_orderdate"), F.desc("o_orderkey"))
    return grid.select("c_custkey", "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


@query("""select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'P')
          and lower(c_name) not in (select 'customer#' || lpad(cast(user_id as varchar), 9, '0') from events where event_type = 'purchase')""")
def missing_by_two_keys(spark, sf_dir):
    """People that a record names neither by id nor by name."""
    by_id = t(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    by_name = t(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.concat(F.lit("customer#"), F.lpad(F.col("user_id").cast("string"), 9, "0")).alias("name"))
    left = t(spark, sf_dir, "customer").select("c_custkey", F.lower("c_name").alias("name"))
    return left.join(by_id, "c_custkey", "left_anti").join(by_name, "name", "left_anti").select("c_custkey")


@query("""with g as (select event_type, user_id, count(*) as n from events group by all)
          select event_type, cast(sum(n) as bigint) as n, case when event_type in ('error', 'purchase') then string_agg(user_id || ':' || n, ',' order by user_id) filter (user_id < 10) end as by_user from g group by event_type""")
def status_counts(spark, sf_dir):
    """Counts by status, and for two of them by a second key as a map."""
    g = t(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    second = F.col("event_type").isin("error", "purchase") & (F.col("user_id") < 10)
    s = g.groupBy("event_type").agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.when(second, F.struct("user_id", "n")))).alias("m"))
    said = F.array_join(F.transform(F.sort_array(F.map_entries("m")), lambda x: F.concat_ws(":", x["key"], x["value"])), ",")
    return s.select("event_type", "n", F.nullif(said, F.lit("")).alias("by_user"))
