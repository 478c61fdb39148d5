"""Pages with totals, capped lists, orders, batches and joins with fallbacks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from periodica.functions import sheets
from periodica.operators import greedy, matching as m
from periodica.operators import ordering as o
from periodica.operators import predicates as p
from periodica.operators import relational as rel
from periodica.plans.registry import query, table as t


@query("""with f as (select o_orderkey, o_totalprice, count(*) over () as total from orders where o_orderstatus = 'P' and o_orderdate >= timestamp '1997-01-01' and o_orderdate < timestamp '1998-01-01')
          select o_orderkey, total, total > 60 as has_more from f order by o_totalprice desc, o_orderkey limit 50 offset 10""")
def page_envelope(spark, sf_dir):
    found = p.where_given(p.period(t(spark, sf_dir, "orders"), "o_orderdate", 1997), o_orderstatus="P", o_orderpriority=None)
    return o.envelope(found, [F.desc("o_totalprice"), F.asc("o_orderkey")], 50, 10).select("o_orderkey", "total", "has_more")


@query("""with f as (select p_partkey, p_name, p_size = 7 as x from part where lower(p_name) like '%e%' order by p_name, p_partkey limit 25)
          select p_partkey, p_name from f where x or not (select bool_or(x) from f)""")
def exact_after_limit(spark, sf_dir):
    """The first 25 hits, of which exact ones are preferred only then."""
    found = t(spark, sf_dir, "part").where(p.like_any("e", "p_name"))
    return o.prefer_exact(found, [F.asc("p_name"), F.asc("p_partkey")], F.col("p_size") == 7).select("p_partkey", "p_name")


@query("""with c as (select c_mktsegment, c_custkey, c_name, c_acctbal, row_number() over (partition by c_mktsegment order by c_acctbal, c_custkey) as rn from customer)
          select c_mktsegment as team, count(*) as people, count(*) filter (c_acctbal < 0) as overdrawn, string_agg(c_name, ',' order by rn) filter (rn <= 50) as poorest from c group by 1""")
def org_summary(spark, sf_dir):
    c = t(spark, sf_dir, "customer")
    counts = c.groupBy("c_mktsegment").agg(F.count("*").alias("people"), F.count_if(F.col("c_acctbal") < 0).alias("overdrawn"))
    names = o.capped_list(c, ["c_mktsegment"], "c_name", 50, [F.asc("c_acctbal"), F.asc("c_custkey")])
    return counts.join(names, "c_mktsegment").select(F.col("c_mktsegment").alias("team"), "people", "overdrawn", F.array_join("c_name", ",").alias("poorest"))


@query("""select row_number() over (order by lower(p_name), p_name, p_partkey) as place, p_name from (select * from part order by lower(p_name), p_name, p_partkey limit 50)""")
def first_names(spark, sf_dir):
    """A sample of the first fifty names, in an order that ignores case."""
    by = [F.lower("p_name"), F.col("p_name"), F.col("p_partkey")]
    few = t(spark, sf_dir, "part").orderBy(*by).limit(50)
    return few.select(F.row_number().over(Window.orderBy(*by)).alias("place"), "p_name")


@query("""with n as (select user_id, max(case when event_type = 'error' then ts end) as newest from events group by user_id)
          select user_id, row_number() over (order by newest nulls last, user_id) as place, strftime(coalesce(newest, timestamp '1970-01-01'), '%Y-%m-%d') as day
          from (select * from n order by newest nulls last, user_id limit 100)""")
def nulls_last(spark, sf_dir):
    """Oldest first and unknown times last; the epoch stands for unknown ones where a value is asked for."""
    n = t(spark, sf_dir, "events").groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "error", F.col("ts"))).alias("newest"))
    by = [F.asc_nulls_last("newest"), F.asc("user_id")]
    few = n.orderBy(*by).limit(100)
    day = F.date_format(F.coalesce("newest", F.lit("1970-01-01").cast("timestamp_ntz")), "yyyy-MM-dd")
    return few.select("user_id", F.row_number().over(Window.orderBy(*by)).alias("place"), day.alias("day"))


@query("""with g as (select c_mktsegment as team, min(c_custkey) as first, count(*) filter (c_acctbal < 0) as missing from customer group by 1)
          select team, missing, row_number() over (order by missing desc, first) as place from g""")
def stable_resort(spark, sf_dir):
    """Teams by how many are missing; equals stay in order of appearance."""
    g = t(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("team")).agg(F.min("c_custkey").alias("first"), F.count_if(F.col("c_acctbal") < 0).alias("missing"))
    return g.select("team", "missing", F.row_number().over(Window.orderBy(F.desc("missing"), F.asc("first"))).alias("place"))


@query("""select count(distinct coalesce(nullif(event_type, 'view'), cast(user_id as varchar))) as threads, count(distinct user_id) as users,
                 strftime(max(case when value > 50 then ts end), '%Y-%m-%d %H:%M:%S') as newest_high from events""")
def coalesced_count(spark, sf_dir):
    key = F.coalesce(F.nullif(F.col("event_type"), F.lit("view")), F.col("user_id").cast("string"))
    high = F.date_format(F.max(F.when(F.col("value") > 50, F.col("ts"))), "yyyy-MM-dd HH:mm:ss")
    return t(spark, sf_dir, "events").agg(F.count_distinct(key).alias("threads"), F.count_distinct("user_id").alias("users"), high.alias("newest_high"))


@query("""with c as (select conv_id, count(*) filter (role = 'user') as asked, count(*) filter (role = 'assistant') as answered from conversations group by conv_id)
          select conv_id, asked, answered, asked + answered as both, sum(asked) over () as asked_total from c""")
def array_totals(spark, sf_dir):
    """Lengths of lists, per row and in total."""
    of = lambda r: F.collect_list(F.when(F.col("role") == r, F.col("turn")))
    c = t(spark, sf_dir, "conversations").groupBy("conv_id").agg(of("user").alias("u"), of("assistant").alias("a"))
    c = c.select("conv_id", F.size("u").cast("long").alias("asked"), F.size("a").cast("long").alias("answered"))
    total = c.agg(F.sum("asked").alias("asked_total"))
    return c.join(F.broadcast(total)).select("conv_id", "asked", "answered", (F.col("asked") + F.col("answered")).alias("both"), "asked_total")


@query("""select turn, role, length(text) as chars from conversations where conv_id = (select min(conv_id) from conversations) order by turn limit 200""")
def thread_messages(spark, sf_dir):
    """All messages of one conversation, oldest first, 200 at most."""
    c = t(spark, sf_dir, "conversations")
    one = c.agg(F.min("conv_id").alias("conv_id"))
    return c.join(F.broadcast(one), "conv_id", "left_semi").orderBy("turn").limit(200).select("turn", "role", F.char_length("text").cast("long").alias("chars"))


@query("""select p_partkey, p_type from part where p_type like 'S_A%'""")
def prefix_tags(spark, sf_dir):
    """A prefix whose underscore stays a wildcard; the plain part of it is pushed down."""
    return t(spark, sf_dir, "part").where(F.col("p_type").startswith("S") & F.col("p_type").like("S_A%")).select("p_partkey", "p_type")


@query("""select o_orderkey, case o_orderstatus when 'F' then 'Approved' when 'O' then 'Pending review' else o_orderstatus end as label, coalesce(nullif(o_orderpriority, '5-LOW'), '') as priority,
                 o_orderstatus in ('O', 'P') as can_retry, o_orderstatus = 'F' and o_totalprice < 100000 as auto_accepted from orders""")
def labelled_rows(spark, sf_dir):
    """Labels of codes (an unknown one stands for itself), empty for null, and derived flags."""
    s = F.col("o_orderstatus")
    label = F.coalesce(F.create_map(F.lit("F"), F.lit("Approved"), F.lit("O"), F.lit("Pending review"))[s], s)
    priority = F.coalesce(F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")), F.lit(""))
    return t(spark, sf_dir, "orders").select("o_orderkey", label.alias("label"), priority.alias("priority"), s.isin("O", "P").alias("can_retry"), ((s == "F") & (F.col("o_totalprice") < 100000)).alias("auto_accepted"))


@query("""select o_orderkey, year(o_orderdate) as y from orders where o_custkey in (select c_custkey from customer where lower(c_name) = 'customer#000000007')""")
def key_dispatch(spark, sf_dir):
    """A key with a prefix stands for a name, any other for an id."""
    return p.records_of(t(spark, sf_dir, "orders"), t(spark, sf_dir, "customer"), "unmatched::Customer#000000007").select("o_orderkey", F.year("o_orderdate").cast("long").alias("y"))


@query("""with g as (select user_id, max(ts) as newest, max(ts) filter (event_type = 'signup') as a, max(ts) filter (event_type = 'purchase') as b from events group by user_id)
          select user_id, case when greatest(a, b) >= newest then 'skip' else 'need' end as state from g""")
def skip_partition(spark, sf_dir):
    """Threads checked (either way) since their newest message are skipped."""
    at = lambda k: F.max(F.when(F.col("event_type") == k, F.col("ts")))
    g = t(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("newest"), at("signup").alias("a"), at("purchase").alias("b"))
    return g.select("user_id", F.when(F.greatest("a", "b") >= F.col("newest"), "skip").otherwise("need").alias("state"))


@query("""select event_id, p_name from events join part on p_partkey = cast(json_extract_string(props, '$.k') as bigint)""")
def json_key_join(spark, sf_dir):
    key = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    return t(spark, sf_dir, "events").select("event_id", key.alias("p_partkey")).join(t(spark, sf_dir, "part"), "p_partkey").select("event_id", "p_name")


@query("""with c as (select c_custkey from customer order by c_acctbal desc, c_custkey limit 40)
          select c_custkey, count(o_orderkey) as n from c left join orders on o_custkey = c_custkey group by c_custkey""")
def page_bounded_join(spark, sf_dir):
    """Children of a page's keys only: the limit stands below the join."""
    page = t(spark, sf_dir, "customer").orderBy(F.desc("c_acctbal"), "c_custkey").limit(40).select("c_custkey")
    children = t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return page.join(children, "c_custkey", "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))


@query("""with k as (select p_partkey, p_name from part where p_size > 5)
          select l_orderkey, case when bool_and(p_name is not null) then string_agg(p_name, ',' order by l_partkey) end as names
          from (select distinct l_orderkey, l_partkey from lineitem) left join k on p_partkey = l_partkey group by l_orderkey""")
def all_or_nothing(spark, sf_dir):
    asked = t(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("p_partkey")).distinct()
    known = t(spark, sf_dir, "part").where("p_size > 5").select("p_partkey", "p_name")
    return m.all_or_none(asked, known, "l_orderkey", "p_partkey", "p_name").select("l_orderkey", F.array_join("p_name", ",").alias("names"))


@query("""with o as (select p_brand, p_size, min_by(p_name, p_partkey) as was from part where p_partkey % 2 = 0 group by all)
          select p_partkey, case when was <> p_name then was end as renamed_from from part left join o using (p_brand, p_size) where p_partkey % 2 = 1""")
def possible_rename(spark, sf_dir):
    """Two halves of the parts as two versions: the same brand and size under another name."""
    part = t(spark, sf_dir, "part")
    return m.renamed(part.where("p_partkey % 2 = 0"), part.where("p_partkey % 2 = 1"), ["p_brand", "p_size"], "p_name", "p_partkey").select("p_partkey", "renamed_from")


@query("""with i as (select doc_id, sha256(text) as d from documents where lang <> 'fr' and text is not null), c as (select sha256(text) as d, min(doc_id) as result from documents where lang in ('fr', 'de') and text is not null group by 1)
          select doc_id, d, result, case when result is null then 'fresh' else 'reused' end as state from i left join c using (d)
          union all select null, d, result, 'stale' from c where d not in (select d from i)""")
def digest_reuse(spark, sf_dir):
    """Results cached by content digest: joined where known, the rest of the cache appended."""
    d = t(spark, sf_dir, "documents").where("text is not null").withColumn("d", F.sha2("text", 256))
    cache = d.where(F.col("lang").isin("fr", "de")).groupBy("d").agg(F.min("doc_id").alias("result"))
    return m.cached(d.where("lang <> 'fr'").select("doc_id", "d"), cache, "d").select("doc_id", "d", "result", "state")


@query("""with l as (select event_id, user_id as pk, event_type as label, cast(json_extract_string(props, '$.k') as bigint) as k from events where event_type in ('signup', 'error')),
               r as (select c_custkey as id, case when c_custkey % 3 = 0 then c_custkey end as pk, c_custkey % 100 as k, c_nationkey from customer),
               a as (select event_id, min(id) as match, 0 as n from l join r using (pk) group by event_id),
               b as (select event_id, min(id) as match, 1 as n from l join r on l.k = r.k where l.pk is null or r.pk is null or l.pk = r.pk group by event_id),
               h as (select * from a union all select * from b)
          select event_id, min_by(match, n) as match, case min(n) when 0 then 'pk' when 1 then 'badge' end as rule from l left join h using (event_id) group by event_id""")
def existing_lookup(spark, sf_dir):
    """Existing rows by id, else by badge; an id known on both sides that differs vetoes the badge."""
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    left = t(spark, sf_dir, "events").where(F.col("event_type").isin("signup", "error")).select("event_id", F.col("user_id").alias("pk"), k.alias("k"))
    key = F.col("c_custkey")
    right = t(spark, sf_dir, "customer").select(key.alias("id"), F.when(key % 3 == 0, key).alias("pk"), (key % 100).alias("k"))
    return m.by_priority(left, right, "event_id", "id", ("pk", "pk"), ("badge", "k"), veto="pk").select("event_id", "match", "rule")


@query("""select o_custkey, string_agg(o_orderpriority, ',' order by first) as priorities from
          (select o_custkey, o_orderpriority, min((o_orderdate, o_orderkey)) as first from orders group by all) group by o_custkey""")
def ordered_distinct(spark, sf_dir):
    """Distinct priorities in order of appearance: reduced to the first of each before they are listed."""
    first = t(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.min(F.struct("o_orderdate", "o_orderkey")).alias("first"))
    return first.groupBy("o_custkey").agg(F.array_join(o.ordered_distinct(F.col("o_orderpriority"), F.col("first")), ",").alias("priorities"))


@query("""with r as (select *, case event_type when 'purchase' then 3 when 'signup' then 2 when 'click' then 1 else 0 end as rank from events)
          select user_id, max_by(event_type, (rank, ts, event_id)) filter (rank > 1) as best, bool_or(rank = 1) as weak from r group by user_id""")
def triage(spark, sf_dir):
    """The highest evidence of a user, of equals the latest; weak evidence is kept aside."""
    e = t(spark, sf_dir, "events").groupBy("user_id").agg(o.best_evidence(F.col("event_type"), {"purchase": 3, "signup": 2, "click": 1}, F.struct("ts", "event_id")).alias("b"))
    return e.select("user_id", "b.best", "b.weak")


@query("""with h as (select user_id, max(case event_type when 'purchase' then 3 when 'signup' then 2 else 0 end) filter (ts < timestamp '2024-01-16') as old,
                            max(case event_type when 'purchase' then 3 when 'signup' then 2 else 0 end) filter (ts >= timestamp '2024-01-16') as new from events group by user_id)
          select user_id, case when new is null or old > new then 'kept' else 'replaced' end as evidence from h""")
def evidence_merge(spark, sf_dir):
    """Two runs: the earlier evidence survives where it ranks strictly higher."""
    rank = F.when(F.col("event_type") == "purchase", 3).when(F.col("event_type") == "signup", 2).otherwise(0)
    h = t(spark, sf_dir, "events").groupBy("user_id").agg(F.max(F.when(F.col("ts") < "2024-01-16", rank)).alias("old"), F.max(F.when(F.col("ts") >= "2024-01-16", rank)).alias("new"))
    return h.select("user_id", F.when(F.col("new").isNull() | (F.col("old") > F.col("new")), "kept").otherwise("replaced").alias("evidence"))


@query("""with d as (select cast(ts as date) as d, * from events)
          select strftime(d, '%Y-%m-%d') as run, count(*) as total, count(*) filter (event_type = 'view') as skipped, count(*) filter (event_type = 'purchase') as succeeded, count(*) filter (event_type = 'error') as failed,
                 count(*) filter (event_type in ('view', 'purchase', 'error')) as processed, count(*) filter (event_type not in ('view', 'purchase', 'error')) = 0 as complete from d group by d""")
def run_counters(spark, sf_dir):
    """Counters of a run; processed and complete are derived from them."""
    n = lambda k: F.count_if(F.col("event_type") == k)
    c = t(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("run")).agg(F.count("*").alias("total"), n("view").alias("skipped"), n("purchase").alias("succeeded"), n("error").alias("failed"))
    done = F.col("skipped") + F.col("succeeded") + F.col("failed")
    return c.select("*", done.alias("processed"), (done == F.col("total")).alias("complete"))


@query("""select p_brand, p_size, count(*) as sharing, string_agg(cast(p_partkey as varchar), ',' order by p_partkey) filter (rn <= 20) as ids from
          (select *, row_number() over (partition by p_brand, p_size order by p_partkey) as rn from part) group by all having count(*) > 1""")
def shared_ids(spark, sf_dir):
    """Ids that several rows share, twenty of them named."""
    part = t(spark, sf_dir, "part")
    n = part.groupBy("p_brand", "p_size").agg(F.count("*").alias("sharing")).where("sharing > 1")
    ids = o.capped_list(part.select("p_brand", "p_size", "p_partkey"), ["p_brand", "p_size"], "p_partkey", 20)
    return n.join(ids, ["p_brand", "p_size"]).select("p_brand", "p_size", "sharing", F.array_join(F.col("p_partkey").cast("array<string>"), ",").alias("ids"))


@query("""select event_id, row_number() over (partition by user_id, event_type order by ts, event_id) > 1 as duplicate from events""")
def first_occurrence(spark, sf_dir):
    return o.first_wins(t(spark, sf_dir, "events"), ["user_id", "event_type"], [F.asc("ts"), F.asc("event_id")]).select("event_id", "duplicate")


@query("""select conv_id, turn, (row_number() over (partition by conv_id order by turn) - 1) // 4 as batch from conversations""")
def batches_of_four(spark, sf_dir):
    return o.fixed_batches(t(spark, sf_dir, "conversations"), ["conv_id"], [F.asc("turn")], 4).select("conv_id", "turn", "batch")


@query("""with recursive r as (select l_orderkey, l_linenumber, cast(l_quantity as bigint) as w, row_number() over (partition by l_orderkey order by l_linenumber, cast(l_quantity as bigint)) as rn from lineitem),
               b as (select l_orderkey, l_linenumber, rn, 0 as batch, w as held from r where rn = 1
                     union all select r.l_orderkey, r.l_linenumber, r.rn, case when held + w > 60 then batch + 1 else batch end, case when held + w > 60 then w else held + w end
                     from b join r on r.l_orderkey = b.l_orderkey and r.rn = b.rn + 1)
          select l_orderkey, l_linenumber, batch from b""")
def batches_by_weight(spark, sf_dir):
    return o.weighted_batches(t(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", "l_quantity", 60)


@query("""with s as (select user_id, epoch(date_trunc('second', ts)) as s, epoch(date_trunc('second', ts)) + 43200 as e from events),
               recursive_free as (select user_id, s, e, row_number() over (partition by user_id order by s, e) as rn from s)
          select user_id, cast(min(s) as bigint) as s, cast(min(s) + 43200 as bigint) as e from recursive_free group by user_id""")
def first_spans(spark, sf_dir):
    """The first of the spans taken one behind the other, of each user."""
    sec = F.unix_timestamp(F.col("ts").cast("timestamp"))
    spans = o.spans_apart(t(spark, sf_dir, "events").select("user_id", sec.alias("s"), (sec + 43200).alias("e")), "user_id", "s", "e")
    return spans.groupBy("user_id").agg(F.min("s").alias("s"), F.min("e").alias("e"))


@query("""select conv_id, turn, coalesce(lead(turn) over (partition by conv_id order by turn), least(turn + 60, 100)) as until from conversations where role = 'user'""")
def segment_until_next(spark, sf_dir):
    c = t(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.col("turn").alias("e"), F.lit(100).cast("long").alias("n"))
    return o.segments(c, "conv_id", "turn", "e", "n", 60).select("conv_id", "turn", "until")


@query("""select event_id, user_id from events where event_type in ('purchase', 'error') qualify row_number() over (partition by user_id order by ts desc, event_id desc) <= 3""")
def newest_finished(spark, sf_dir):
    """Of each user only the three newest finished tasks."""
    done = t(spark, sf_dir, "events").where(F.col("event_type").isin("purchase", "error"))
    return o.first_k(done, ["user_id"], [F.desc("ts"), F.desc("event_id")], 3).select("event_id", "user_id")


@query("""with i as (select conv_id, turn, role from conversations), l as (select conv_id, case conv_id % 3 when 0 then 'Item #2' when 1 then 'USER' else 'the assistant said' end as label from (select distinct conv_id from conversations)),
               r as (select conv_id, label, turn, case when conv_id % 3 = 0 then case when turn = 2 then 0 end when conv_id % 3 = 1 then case when role = 'user' then 1 end when role = 'assistant' then 2 end as rank from l join i using (conv_id))
          select conv_id, label, min_by(turn, (rank, turn)) filter (rank is not null) as item from l left join r using (conv_id, label) group by conv_id, label""")
def resolved_labels(spark, sf_dir):
    """Which turn a label means: a number, a name, or a name inside it."""
    c = t(spark, sf_dir, "conversations")
    k = F.col("conv_id") % 3
    labels = c.select("conv_id").distinct().withColumn("label", F.when(k == 0, "Item #2").when(k == 1, "USER").otherwise("the assistant said"))
    return m.labelled_items(labels, c, "conv_id", "label", "role", "turn")


@query("""select n_nationkey, '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","region":' || case when n_regionkey = 0 then 'null' else cast(n_regionkey as varchar) end || '}' as row from nation""")
def json_rows(spark, sf_dir):
    n = t(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.nullif(F.col("n_regionkey"), F.lit(0)).alias("region"))
    return rel.row_json(n).select(F.get_json_object("row", "$.n_nationkey").cast("int").alias("n_nationkey"), "row")


@query("""select user_id, string_agg(event_type, ',' order by event_type) as twice from (select user_id, event_type from events where ts < timestamp '2024-01-03' group by all having count(*) > 1) group by user_id""")
def duplicates_in_lists(spark, sf_dir):
    """Values that a user's list holds twice or more."""
    g = t(spark, sf_dir, "events").where("ts < '2024-01-03'").groupBy("user_id").agg(F.collect_list("event_type").alias("l"))
    return g.select("user_id", F.array_join(F.sort_array(sheets.duplicates(F.col("l"))), ",").alias("twice")).where("twice <> ''")


@query("""with recursive l as (select l_returnflag, l_orderkey * 10 + l_linenumber as s, l_orderkey * 10 + l_linenumber + cast(floor(l_extendedprice / 10) as bigint) as e from lineitem),
               b as (select l_returnflag, min({'s': s, 'e': e}) as x from l group by all
                     union all select b.l_returnflag, min({'s': l.s, 'e': l.e}) from b join l on l.l_returnflag = b.l_returnflag and l.s >= b.x.e group by all)
          select l_returnflag, x.s as s, x.e as e from b""")
def flags_apart(spark, sf_dir):
    """Spans of three keys that hold a third of the table each."""
    s = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    spans = t(spark, sf_dir, "lineitem").select("l_returnflag", s.alias("s"), (s + F.floor(F.col("l_extendedprice") / 10)).alias("e"))
    return greedy.apart(spans, "l_returnflag", "s", "e")


@query("""with recursive r as (select coalesce(source, '') as source, doc_id, coalesce(n_chars, 0) as w, row_number() over (partition by source order by doc_id, coalesce(n_chars, 0)) as rn from documents),
               b as (select source, doc_id, rn, 0 as batch, w as held from r where rn = 1
                     union all select r.source, r.doc_id, r.rn, case when held + w > 20000 then batch + 1 else batch end, case when held + w > 20000 then w else held + w end
                     from b join r on r.source = b.source and r.rn = b.rn + 1)
          select source, doc_id, batch from b""")
def source_batches(spark, sf_dir):
    """Documents of each source, however many, in batches of up to 20,000 characters."""
    d = t(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("")).alias("source"), "doc_id", "n_chars")
    return greedy.batches(d, "source", "doc_id", "n_chars", 20_000)
