"""Filed records: filters, pages, period totals, buckets, calendars and anomalies over orders and lineitem."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from periodica.functions import dates
from periodica.operators import predicates as p
from periodica.operators import relational as rel
from periodica.plans.registry import query, table as t


@query("""select p_partkey, p_name from part where (lower(p_name) like '%a%e%' or lower(p_type) like '%steel%') and p_brand not in ('Brand#11', 'Brand#22')
          order by p_retailprice desc, p_partkey limit 50 offset 20""")
def paged_search(spark, sf_dir):
    found = t(spark, sf_dir, "part").where(p.like_any("a%e", "p_name") | p.like_any("steel", "p_type")).where(p.not_listed("p_brand", "Brand#11, Brand#22"))
    return rel.page(found, [F.desc("p_retailprice"), F.asc("p_partkey")], 50, 20).select("p_partkey", "p_name")


@query("""select doc_id, lang from documents where (contains(lower(text), 'the') or contains(lower(source), 'the')) and (contains(lower(text), '%') or contains(lower(source), '%'))""")
def multi_term_search(spark, sf_dir):
    return t(spark, sf_dir, "documents").where(p.every_term("the %", "text", "source")).select("doc_id", "lang")


@query("""select event_type, count(*) as n, count(*) filter (cast(json_extract_string(props, '$.k') as int) >= 50) as high from events group by event_type""")
def json_path_filter(spark, sf_dir):
    high = F.try_variant_get(F.try_parse_json("props"), "$.k", "int") >= 50
    return t(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(high).alias("high"))


@query("""select o_orderkey, o_totalprice from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R')
          and o_custkey not in (select c_custkey from customer where c_acctbal < 0)""")
def semi_and_anti(spark, sf_dir):
    back = t(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    bad = t(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return t(spark, sf_dir, "orders").join(back, "o_orderkey", "left_semi").join(bad, "o_custkey", "left_anti").select("o_orderkey", "o_totalprice")


@query("""with r as (select o_custkey, o_orderkey, o_totalprice, row_number() over w as rn, lead(o_totalprice) over w as second from orders
                     window w as (partition by o_custkey order by o_totalprice desc, o_orderkey))
          select o_custkey, o_orderkey, round(o_totalprice - second, 2) as gap from r where rn = 1 and o_totalprice - second >= 10000""")
def top_gap(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    r = t(spark, sf_dir, "orders").withColumn("gap", F.col("o_totalprice") - F.lead("o_totalprice").over(w)).withColumn("rn", F.row_number().over(w))
    return r.where("rn = 1 and gap >= 10000").select("o_custkey", "o_orderkey", F.round("gap", 2).alias("gap"))


@query("""with c as (select o_custkey, year(o_orderdate) as y, month(o_orderdate) as m, count(*) as n from orders group by all)
          select o_custkey, y, m, n from c qualify row_number() over (partition by o_custkey order by n desc, y desc, m desc) = 1""")
def majority_period(spark, sf_dir):
    c = t(spark, sf_dir, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m")).agg(F.count("*").alias("n"))
    return rel.newest(c, ["o_custkey"], F.desc("n"), F.desc("y"), F.desc("m"))


@query("""select l_returnflag, l_linestatus, cast(sum(cast(l_quantity as decimal(18,2))) filter (year(l_shipdate) = 1997) as double) as before,
                 cast(sum(cast(l_quantity as decimal(18,2))) filter (year(l_shipdate) = 1998) as double) as after,
                 cast(coalesce(sum(cast(l_quantity as decimal(18,2))) filter (year(l_shipdate) = 1998), 0) - coalesce(sum(cast(l_quantity as decimal(18,2))) filter (year(l_shipdate) = 1997), 0) as double) as delta
          from lineitem group by 1, 2""")
def two_period_delta(spark, sf_dir):
    q, y = F.col("l_quantity").cast("decimal(18,2)"), F.year("l_shipdate")
    g = t(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum(F.when(y == 1997, q)).alias("b"), F.sum(F.when(y == 1998, q)).alias("a"))
    zero = F.lit(0).cast("decimal(18,2)")
    delta = (F.coalesce("a", zero) - F.coalesce("b", zero)).cast("double")
    return g.select("l_returnflag", "l_linestatus", F.col("b").cast("double").alias("before"), F.col("a").cast("double").alias("after"), delta.alias("delta"))


@query("""with a as (select l_orderkey, count(*) filter (l_returnflag = 'R') as returned, count(*) filter (l_discount >= 0.09) as discounted,
                            max(l_quantity) as largest from lineitem group by l_orderkey),
               r as (select l_orderkey, concat_ws(',', case when returned >= 3 then 'returned' end, case when discounted >= 3 then 'discounted' end, case when largest >= 50 then 'large' end) as reasons from a)
          select l_orderkey, reasons from r where reasons <> ''""")
def anomaly_reasons(spark, sf_dir):
    a = t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.count_if(F.col("l_returnflag") == "R").alias("r"), F.count_if(F.col("l_discount") >= 0.09).alias("d"), F.max("l_quantity").alias("q")
    )
    found = a.withColumn("reasons", p.reasons(returned=F.col("r") >= 3, discounted=F.col("d") >= 3, large=F.col("q") >= 50))
    return found.where(F.size("reasons") > 0).select("l_orderkey", F.array_join("reasons", ",").alias("reasons"))


@query("""with d as (select l_suppkey, l_returnflag as bucket, strftime(l_shipdate, '%Y-%m-%d') as day from lineitem where l_shipdate >= timestamp '1998-01-01'),
               f as (select l_suppkey, day from d group by l_suppkey, day having count(distinct bucket) > 1)
          select d.l_suppkey, string_agg(distinct d.day, ',' order by d.day) filter (bucket = 'N') as normal, string_agg(distinct d.day, ',' order by d.day) filter (bucket = 'R') as returned,
                 string_agg(distinct f.day, ',' order by f.day) as conflicts
          from d left join f on f.l_suppkey = d.l_suppkey and f.day = d.day group by d.l_suppkey""")
def bucket_union(spark, sf_dir):
    d = t(spark, sf_dir, "lineitem").where("l_shipdate >= '1998-01-01'").select("l_suppkey", F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"), "l_returnflag")
    per_day = d.groupBy("l_suppkey", "day").agg(F.collect_set("l_returnflag").alias("b"))
    join = lambda c: F.nullif(F.array_join(F.sort_array(F.collect_list(F.when(c, F.col("day")))), ","), F.lit(""))
    has = lambda x: F.array_contains("b", x)
    return per_day.groupBy("l_suppkey").agg(join(has("N")).alias("normal"), join(has("R")).alias("returned"), join(F.size("b") > 1).alias("conflicts"))


@query("""with s as (select strftime(d, '%Y-%m-%d') as day from range(date '2024-01-01', date '2024-02-01', interval 1 day) r(d)),
               u as (select user_id from events group by user_id), a as (select distinct user_id, strftime(ts, '%Y-%m-%d') as day from events where ts >= timestamp '2024-01-01' and ts < timestamp '2024-02-01'),
               n as (select user_id, day from u cross join s except select user_id, day from a)
          select user_id, count(n.day) as n_missing, coalesce(string_agg(n.day, ',' order by n.day), '') as missing from u left join n using (user_id) group by user_id""")
def calendar_unaccounted(spark, sf_dir):
    in_month = F.when((F.col("ts") >= "2024-01-01") & (F.col("ts") < "2024-02-01"), F.date_format("ts", "yyyy-MM-dd"))
    a = t(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set(in_month).alias("days"))
    gone = a.select("user_id", dates.unaccounted(F.lit(2024), F.lit(1), F.col("days")).alias("m"))
    return gone.select("user_id", F.size("m").cast("long").alias("n_missing"), F.array_join("m", ",").alias("missing"))


@query("""with m as (select distinct year(o_orderdate) as y, month(o_orderdate) as m from orders),
               d as (select y, m, unnest(generate_series(make_date(y, m, 1), last_day(make_date(y, m, 1)), interval 1 day)) as d from m)
          select y, m, count(*) as days, strftime(make_date(y, m, 1), '%B-%Y') as label, string_agg(strftime(d, '%Y-%m-%d'), ',' order by d) filter (dayofweek(d) in (0, 6)) as weekends
          from d group by y, m""")
def month_calendars(spark, sf_dir):
    m = t(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m")).distinct()
    y, k = F.col("y"), F.col("m")
    ends = F.array_join(dates.weekends(y, k, ["Saturday", "Sunday"]), ",")
    return m.select("y", "m", dates.days_in_month(y, k).cast("long").alias("days"), dates.month_label(F.make_date(y, k, F.lit(1))).alias("label"), ends.alias("weekends"))


@query("""with g as (select o_custkey, count(*) as n, count(*) filter (o_orderstatus = 'F') as f, count(*) filter (o_orderpriority = '1-URGENT') as u from orders group by o_custkey)
          select o_custkey, concat_ws(',', case when n >= 5 then 'enough' end, case when f >= 1 then 'closed' end) as reasons,
                 concat_ws(',', case when n < 5 then 'few' end, case when f = 0 then 'open' end, case when u >= 4 then 'urgent' end) as blockers,
                 n >= 5 and f >= 1 and u < 4 as accepted from g""")
def recommendation_gate(spark, sf_dir):
    g = t(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("f"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("u")
    )
    n, f, u = (F.col(c) for c in "nfu")
    blockers = p.reasons(few=n < 5, open=f == 0, urgent=u >= 4)
    return g.select("o_custkey", F.array_join(p.reasons(enough=n >= 5, closed=f >= 1), ",").alias("reasons"), F.array_join(blockers, ",").alias("blockers"), (F.size(blockers) == 0).alias("accepted"))


@query("""select o_orderpriority, count(*) as total, count(*) filter (o_orderstatus = 'F') as done, round(100.0 * count(*) filter (o_orderstatus = 'F') / count(*), 1) as percent,
                 min(year(o_orderdate)) as first_year, max(year(o_orderdate)) as last_year, max_by(o_orderkey, (o_totalprice, o_orderkey)) as focus from orders group by o_orderpriority""")
def dashboard_row(spark, sf_dir):
    done = F.count_if(F.col("o_orderstatus") == "F")
    return t(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(
        F.count("*").alias("total"), done.alias("done"), F.round(100.0 * done / F.count("*"), 1).alias("percent"), F.min(F.year("o_orderdate")).cast("long").alias("first_year"),
        F.max(F.year("o_orderdate")).cast("long").alias("last_year"), F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("focus"),
    )


@query("""select coalesce(c_mktsegment, 'all') as segment, coalesce(o_orderstatus, 'all') as status, count(*) as n
          from orders join customer on c_custkey = o_custkey group by cube (c_mktsegment, o_orderstatus)""")
def cube_counts(spark, sf_dir):
    """Beyond the reference: grouping sets."""
    o = t(spark, sf_dir, "orders").join(t(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    g = o.cube("c_mktsegment", "o_orderstatus").agg(F.count("*").alias("n"))
    return g.select(F.coalesce("c_mktsegment", F.lit("all")).alias("segment"), F.coalesce("o_orderstatus", F.lit("all")).alias("status"), "n")


@query("""select k, 'both' as side from (select o_custkey as k from orders intersect select user_id from events) union all
          select k, 'left' from (select o_custkey as k from orders except select user_id from events)""")
def set_operations(spark, sf_dir):
    """Beyond the reference: set operations on rows."""
    a, b = t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), t(spark, sf_dir, "events").select(F.col("user_id").alias("k"))
    return a.intersect(b).withColumn("side", F.lit("both")).unionAll(a.subtract(b).withColumn("side", F.lit("left")))


@query("""select l_returnflag, l_linestatus, cast(sum(cast(l_quantity as decimal(18,2))) as double) as sum_qty, round(avg(l_discount), 6) as avg_disc, count(*) as n
          from lineitem where l_shipdate <= timestamp '1998-09-02' group by l_returnflag, l_linestatus""")
def large_rollup(spark, sf_dir):
    f = t(spark, sf_dir, "lineitem").where("l_shipdate <= '1998-09-02'").groupBy("l_returnflag", "l_linestatus")
    return f.agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("sum_qty"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))
