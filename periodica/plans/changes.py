"""Keyed writes over the driver's tables: syncs, cascades, back-fills, transitions, field changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from periodica.operators import ordering, updates as u
from periodica.operators.stored import folder
from periodica.plans.registry import query, table as t
from periodica.streaming.tablelog import TableLog


@query("""with o as (select s_suppkey, s_name, s_nationkey, case when s_acctbal < 0 then s_suppkey end as filed from supplier)
          select s_suppkey, s_name, filed from o where s_nationkey >= 10
          union all select s_suppkey, s_name, filed from o where s_nationkey < 10 and s_suppkey % 2 = 1 and filed is not null
          union all select s_suppkey, upper(s_name), filed from o where s_nationkey < 10 and s_suppkey % 2 = 0""")
def scoped_sync(spark, sf_dir):
    """A sync of the suppliers of ten nations: others stay, absent ones go unless they are filed."""
    o = t(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey", F.when(F.col("s_acctbal") < 0, F.col("s_suppkey")).alias("filed"))
    new = o.where("s_nationkey < 10 and s_suppkey % 2 = 0").select("s_suppkey", F.upper("s_name").alias("s_name"), "s_nationkey")
    return u.sync_scope(o, new, "s_suppkey", F.col("s_nationkey") < 10, "filed").select("s_suppkey", "s_name", "filed")


@query("""with g as (select c_custkey from customer where c_acctbal < -500)
          select o_orderkey, case when o_custkey not in (select * from g) then o_custkey end as o_custkey, case when o_custkey in (select * from g) then 'failed' else o_orderstatus end as status,
                 (o_custkey in (select * from g))::int as events from orders""")
def deletion_cascade(spark, sf_dir):
    """Records of people that were deleted are un-linked and failed, and tell so."""
    people = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal")
    kids = t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderstatus").alias("status"), F.array().cast("array<struct<what: string, at: timestamp_ntz>>").alias("events"))
    _, kids = u.delete_cascade(people, kids, people.where("c_acctbal < -500"), "o_custkey", "status", "events", F.lit("2024-01-01").cast("timestamp_ntz"))
    return kids.select("o_orderkey", "o_custkey", "status", F.size("events").alias("events"))


@query("""with s as (select o_custkey as k, min(o_orderkey) as v from orders group by 1)
          select event_id, coalesce(case when event_type = 'view' then 'seen' end, cast(v as varchar), event_type) as thread_key from events left join s on k = user_id""")
def thread_back_fill(spark, sf_dir):
    """A key filled from a joined table, then from the row itself."""
    s = t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("user_id")).agg(F.min("o_orderkey").cast("string").alias("v"))
    e = t(spark, sf_dir, "events").withColumn("thread_key", F.when(F.col("event_type") == "view", "seen"))
    return u.back_fill(e, s, "user_id", "thread_key", "v", "event_type").select("event_id", "thread_key")


@query("""with o as (select p_partkey, case when p_size > 20 then p_brand end as p_brand from part where p_partkey % 3 <> 0), n as (select p_partkey, upper(p_type) as p_brand from part where p_partkey % 2 = 0)
          select p_partkey, coalesce(o.p_brand, n.p_brand) as p_brand from o left join n using (p_partkey) union all select p_partkey, p_brand from n where p_partkey not in (select p_partkey from o)""")
def seeded_parts(spark, sf_dir):
    """Absent rows are inserted, of the others a null attribute is filled."""
    part = t(spark, sf_dir, "part")
    old = part.where("p_partkey % 3 <> 0").select("p_partkey", F.when(F.col("p_size") > 20, F.col("p_brand")).alias("p_brand"))
    return u.insert_or_fill(old, part.where("p_partkey % 2 = 0").select("p_partkey", F.upper("p_type").alias("p_brand")), "p_partkey", "p_brand")


@query("""with a as (select user_id, event_type, case when bool_or(value > 50) filter (ts < timestamp '2024-01-16') then 'high' when count(*) filter (ts < timestamp '2024-01-16') > 0 then 'none' end as old,
                            case when bool_or(value > 50) filter (ts >= timestamp '2024-01-16') then 'new' when count(*) filter (ts >= timestamp '2024-01-16') > 0 then 'none' end as new from events group by all)
          select user_id, string_agg(event_type || '=' || case when new is null then old when new = 'none' and old is not null then old else new end, ',' order by event_type) as known from a group by user_id""")
def remembered(spark, sf_dir):
    """Two runs of a map per user: new entries replace old ones, a marker of nothing replaces none."""
    e = t(spark, sf_dir, "events").withColumn("late", F.col("ts") >= "2024-01-16")
    one = e.groupBy("user_id", "late", "event_type").agg(F.bool_or(F.col("value") > 50).alias("high"))
    word = F.when(F.col("high"), F.when(F.col("late"), "new").otherwise("high")).otherwise("none")
    pairs = lambda late: F.map_from_entries(F.filter(F.collect_list(F.when(F.col("late") == late, F.struct("event_type", word))), lambda x: x.isNotNull()))
    m = one.groupBy("user_id").agg(pairs(False).alias("old"), pairs(True).alias("new"))
    known = F.sort_array(F.transform(F.map_entries(u.remember(F.col("old"), F.col("new"))), lambda x: F.concat(x["key"], F.lit("="), x["value"])))
    return m.select("user_id", F.array_join(known, ",").alias("known"))


@query("""select o_orderkey, case when o_orderstatus = 'O' then 'verified' when o_orderstatus = 'P' then 'archived' else 'approved' end as state,
                 case when o_orderstatus = 'F' then 'can''t verify what is approved' end as error from orders""")
def transitions(spark, sf_dir):
    """Moves of states; one that may not be made changes nothing and says so."""
    s = F.col("o_orderstatus")
    rows = t(spark, sf_dir, "orders").select("o_orderkey", F.when(s == "O", "pending").when(s == "P", "rejected").otherwise("approved").alias("state"), F.when(s == "P", "archive").otherwise("verify").alias("action"))
    return u.moved(rows, "state", "action").select("o_orderkey", "state", "error")


@query("""with o as (select p_partkey, p_brand, p_type from part), n as (select p_partkey, case when p_partkey % 4 = 0 then '' else p_brand || '?' end as p_brand, case when p_partkey % 3 = 0 then p_type end as p_type from part where p_partkey % 2 = 0)
          select p_partkey, concat_ws(';', case when n.p_brand <> '' then 'p_brand:' || o.p_brand || '>' || n.p_brand end) as changes from o join n using (p_partkey)""")
def field_changes(spark, sf_dir):
    """Fields with their old and new values; blanks erase nothing."""
    part = t(spark, sf_dir, "part")
    k = F.col("p_partkey")
    new = part.where("p_partkey % 2 = 0").select(k, F.when(k % 4 == 0, "").otherwise(F.concat("p_brand", F.lit("?"))).alias("p_brand"), F.when(k % 3 == 0, F.col("p_type")).alias("p_type"))
    c = u.field_changes(part, new, "p_partkey", ["p_brand", "p_type"])
    said = F.transform("changes", lambda x: F.concat(x["field"], F.lit(":"), x["old"], F.lit(">"), x["new"]))
    return c.select("p_partkey", F.array_join(said, ";").alias("changes"))


@query("""with m as (select distinct year(o_orderdate) as year, month(o_orderdate) as month from orders) select year, month, case when month <= 6 then 'Friday,Saturday' else 'Saturday,Sunday' end as weekdays from m""")
def calendar_upsert(spark, sf_dir):
    """A month's calendar in place of the one that was there, its weekdays once each."""
    m = t(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")).distinct()
    days = lambda *d: F.array(*map(F.lit, d)).alias("weekdays")
    none = F.array().cast("array<string>").alias("holidays")
    put = u.put_month(m.select("year", "month", days("Saturday", "Sunday"), none), m.where("month <= 6").select("year", "month", days("Friday", "Saturday", "Friday"), none))
    return put.select("year", "month", F.array_join("weekdays", ",").alias("weekdays"))


@query("""select event_id, case when event_type = 'error' then 'view' else event_type end as event_type, case when event_type = 'error' then 0 else value end as value from events where user_id not in (select c_custkey from customer where c_acctbal < 0)""")
def bulk_reset(spark, sf_dir):
    """A bulk delete by a set, and columns reset on the rows of a test."""
    gone = t(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("user_id"))
    left = t(spark, sf_dir, "events").join(gone, "user_id", "left_anti")
    return u.reset_where(left, F.col("event_type") == "error", event_type="view", value=0.0).select("event_id", "event_type", "value")


@query("""select o_custkey, string_agg(o_orderkey || ':' || case when o_orderkey = last then 'new' else o_orderstatus end, ',' order by o_orderkey = last, o_orderkey) as items
          from (select *, max(o_orderkey) over (partition by o_custkey) as last from orders) group by o_custkey""")
def replaced_items(spark, sf_dir):
    """A list whose item of a key is replaced, or the new one appended."""
    g = t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("v")))).alias("items"))
    new = F.struct(F.array_max("items")["k"].alias("k"), F.lit("new").alias("v"))
    items = ordering.replace_or_append(F.col("items"), "k", new)
    return g.select("o_custkey", F.array_join(F.transform(items, lambda x: F.concat_ws(":", x["k"].cast("string"), x["v"])), ",").alias("items"))


@query("""select o_orderkey, case when o_orderkey % 2 = 1 then 'X' else o_orderstatus end as status, case when o_orderkey % 2 = 1 then 2 else 1 end as at from orders where o_orderkey % 3 <> 0 union all select o_orderkey, 'back', 9 from orders where o_orderkey % 15 = 0""")
def table_log(spark, sf_dir):
    """Orders as a log: updates, deletes, a batch that runs again, what comes late, some buckets compacted, and keys that come back."""
    orders, log = t(spark, sf_dir, "orders"), TableLog(spark, folder(spark, "log"), ["o_orderkey"], "at")
    rows = lambda which, status, at: orders.where(which).select("o_orderkey", F.expr(status).alias("status"), F.lit(at).alias("at"))
    log.append(rows("true", "o_orderstatus", 1), 0)
    for _ in range(2):
        log.append(rows("o_orderkey % 2 = 1", "'X'", 2), 1)
    log.append(rows("o_orderkey % 3 = 0", "null", 5), 2, F.lit(True))
    log.compact(3, buckets=list(range(8)))
    log.append(rows("o_orderkey % 3 = 0", "'late'", 4), 4)
    log.append(rows("o_orderkey % 15 = 0", "'back'", 9), 5)
    return log.current()
