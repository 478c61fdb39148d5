"""Messages in threads, trackers and rate windows over conversations and events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from periodica.operators import relational as rel
from periodica.plans.registry import query, table as t


@query("""select conv_id, turn, role, n from (select conv_id, turn, role, count(*) over (partition by conv_id) as n, row_number() over (partition by conv_id order by turn desc, role) as rn from conversations) where rn = 1""")
def thread_newest(spark, sf_dir):
    c = t(spark, sf_dir, "conversations")
    newest = c.groupBy("conv_id").agg(F.min(F.struct((-F.col("turn")).alias("k"), "role")).alias("m"), F.count("*").alias("n"))
    return newest.select("conv_id", (-F.col("m.k")).alias("turn"), "m.role", "n")


@query("""select conv_id, turn, lag(role) over (partition by conv_id order by turn) as prior_role, length(lag(text) over (partition by conv_id order by turn)) as prior_chars from conversations""")
def prior_turn(spark, sf_dir):
    c = rel.previous(t(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    return c.select("conv_id", "turn", "prior_role", F.char_length("prior_text").cast("long").alias("prior_chars"))


@query("""select event_type, count(*) as n, count(*) filter (value > 50) as high, count(distinct user_id) as users, strftime(max(ts), '%Y-%m-%d %H:%M:%S') as newest from events group by event_type""")
def event_stats(spark, sf_dir):
    return t(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("high"), F.count_distinct("user_id").alias("users"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("newest")
    )


@query("""select event_id, count(*) over (partition by user_id order by epoch_us(ts) range between 299999999 preceding and current row) as n from events""")
def sliding_rate(spark, sf_dir):
    """Events of the user in the last five minutes; one exactly five minutes old is out."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy("us").rangeBetween(-299_999_999, 0)
    return t(spark, sf_dir, "events").withColumn("us", us).select("event_id", F.count("*").over(w).alias("n"))


@query("""select e.event_id, max(p.event_id) as prior_event from (select * from events where event_type = 'error') e
          left join (select event_id, user_id, ts from events where event_type = 'purchase' qualify row_number() over (partition by user_id, ts order by event_id desc) = 1) p
          on p.user_id = e.user_id and p.ts = (select max(ts) from events q where q.event_type = 'purchase' and q.user_id = e.user_id and q.ts < e.ts) group by e.event_id""")
def asof_purchase(spark, sf_dir):
    """For every error the newest purchase of the user strictly before it."""
    e = t(spark, sf_dir, "events")
    bought = e.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("event_id").alias("event"))
    errors = e.where("event_type = 'error'").select("event_id", "user_id", "ts")
    return rel.asof(errors, bought, "user_id", "ts", "event").select("event_id", F.col("prior_event").alias("prior_event"))


@query("""with m as (select user_id, max(ts) as run from events where event_type = 'signup' group by user_id)
          select e.event_id, case when run is null then 'new' when event_type = 'error' or e.ts <= run then 'covered' else 'late' end as state from events e left join m using (user_id)""")
def extracted_threshold(spark, sf_dir):
    """Messages by the last run of their thread; one without a time (errors here) passes as covered."""
    e = t(spark, sf_dir, "events").withColumn("ts", F.when(F.col("event_type") != "error", F.col("ts")))
    runs = t(spark, sf_dir, "events").where("event_type = 'signup'").groupBy("user_id").agg(F.max("ts").alias("run"))
    state = F.when(F.col("run").isNull(), "new").when(F.col("ts").isNull() | (F.col("ts") <= F.col("run")), "covered").otherwise("late")
    return e.join(runs, "user_id", "left").select("event_id", state.alias("state"))


@query("""with m as (select conv_id, min(turn) + 3 as mark from conversations where conv_id % 2 = 0 group by conv_id),
               r as (select c.conv_id, c.turn, row_number() over w as rn, count(*) over (partition by c.conv_id) as n, mark is null or c.turn > mark as fresh
                     from conversations c left join m using (conv_id) window w as (partition by c.conv_id order by c.turn)),
               f as (select *, min(case when fresh then rn end) over (partition by conv_id) as first from r)
          select conv_id, turn from f where rn >= first - 2 and rn > n - 40""")
def new_with_context(spark, sf_dir):
    c = t(spark, sf_dir, "conversations")
    marks = c.where("conv_id % 2 = 0").groupBy("conv_id").agg((F.min("turn") + 3).alias("mark"))
    return rel.since(c, "conv_id", "turn", marks, "mark").select("conv_id", "turn")


@query("""select user_id, max_by(event_type, (ts, event_id)) as last_type, max(ts) = max(case when event_type = 'click' then ts end) as ends_in_click from events group by user_id""")
def newest_wins(spark, sf_dir):
    click = F.max(F.when(F.col("event_type") == "click", F.col("ts")))
    return t(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"), (F.max("ts") == click).alias("ends_in_click"))


@query("""with g as (select user_id, event_id, ts, case when ts - lag(ts) over (partition by user_id order by ts, event_id) <= interval 12 hour then 0 else 1 end as s from events),
               n as (select user_id, sum(s) over (partition by user_id order by ts, event_id) as session from g)
          select user_id, cast(session as bigint) as session, count(*) as n from n group by user_id, session""")
def sessions(spark, sf_dir):
    """Beyond the reference: sessions of a user by a gap of twelve hours."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp"))
    e = t(spark, sf_dir, "events").withColumn("s", F.when(gap <= 12 * 3600 * 1_000_000, 0).otherwise(1))
    return e.withColumn("session", F.sum("s").over(w)).groupBy("user_id", "session").agg(F.count("*").alias("n"))
