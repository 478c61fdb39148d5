"""Queries that run as streams over all that is there, and end."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from periodica.operators.stored import folder
from periodica.plans.registry import query, table as t
from periodica.sources import mailbox
from periodica.streaming import ingest, state

#: Files that a batch is written to, and read from.
FILES = 2


def _events(spark, sf_dir):
    return t(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _ran(spark, stream, at: str):
    """What a stream has written when it has read all there is."""
    ingest.run(stream, f"{at}/state", path=f"{at}/out")
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


@query("""select event_type, count(*) as n, count(distinct event_id) as ids, round(sum(value), 2) as total from events group by event_type""")
def stream_ingest(spark, sf_dir):
    """Events in three files, each of the first two read again with changed values before the newer ones: upserted by id in micro-batches."""
    at = folder(spark, "stream")
    e = _events(spark, sf_dir).withColumn("seen", F.lit(1))
    old = e.where("event_id % 3 = 0").withColumn("value", F.lit(-1.0)).withColumn("seen", F.lit(0))
    e.unionAll(old).repartitionByRange(3, "seen", "event_id").write.parquet(f"{at}/in")
    stream = ingest.source(spark, f"{at}/in", e, 1)
    ingest.run(stream, f"{at}/state", each=ingest.deltas_into(f"{at}/table", ["event_id"], "seen"))
    newest = ingest.current(spark, f"{at}/table", ["event_id"], "seen")
    return newest.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"), F.round(F.sum("value"), 2).alias("total"))


@query("""select strftime(time_bucket(interval 1 day, ts), '%Y-%m-%d') as day, event_type, count(*) as n from events group by 1, 2""")
def daily_windows(spark, sf_dir):
    """Tumbling windows of a day, as a stream; a last row of a later day closes those that are open."""
    at = folder(spark, "stream")
    e = _events(spark, sf_dir).select("ts", "event_type")
    flush = e.agg((F.max("ts") + F.expr("interval 3 days")).alias("ts")).withColumn("event_type", F.lit("flush"))
    e.write.parquet(f"{at}/in")
    flush.write.mode("append").parquet(f"{at}/in")
    days = ingest.tumbling(ingest.source(spark, f"{at}/in", e), "ts", "1 day", "event_type")
    return _ran(spark, days, at).where("event_type <> 'flush'").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def _in_batches(spark, rows: DataFrame, batch: Column, make: Callable[[DataFrame], DataFrame], n: int = 4) -> DataFrame:
    """What a stream has written of ``rows``, read in ``n`` batches; after half of them it ends and goes on from its checkpoint."""
    at = folder(spark, "stream")
    for k in range(n):
        rows.where(batch == k).repartition(FILES).write.mode("append").parquet(f"{at}/in")
        if k in (n // 2 - 1, n - 1):
            out = make(ingest.source(spark, f"{at}/in", rows, FILES))
            ingest.run(out, f"{at}/state", empty_batches=False, path=f"{at}/out")
    return spark.read.schema(out.schema).parquet(f"{at}/out")


@query("""with e as (select *, event_id % 4 as b from events), m as (select user_id, b, max(ts) as run from e where event_type = 'signup' group by all)
          select event_id, case when max(run) is null or e.ts > max(run) then 'new' else 'covered' end as state
          from e left join m on m.user_id = e.user_id and m.b <= e.b where event_type <> 'signup' group by event_id, e.ts""")
def late_stream(spark, sf_dir):
    """Messages after the last run of their thread that was seen, over four batches; most runs come before messages that are older."""
    kind = F.when(F.col("event_type") == "signup", "run").otherwise("message")
    rows = _events(spark, sf_dir).select(F.col("user_id").alias("thread"), F.col("event_id").alias("id"), F.col("ts").alias("at"), kind.alias("kind"))
    return _in_batches(spark, rows, F.col("id") % 4, state.late_or_covered).select(F.col("id").alias("event_id"), "state")


@query("""with c as (select conv_id, turn, least(turn // 2, 3) as b, row_number() over (partition by conv_id order by turn) as rn from conversations),
               f as (select conv_id, b, min(rn) as lo, max(rn) as hi from c group by all)
          select conv_id, turn, rn >= lo as fresh from f join c using (conv_id) where rn between greatest(lo - 2, hi - 39) and hi""")
def context_stream(spark, sf_dir):
    """What is new in each thread, the newest forty with the two messages ahead of it; the last batch has the first turns once more."""
    c = t(spark, sf_dir, "conversations").select(F.col("conv_id").alias("thread"), F.col("turn").alias("id"), F.timestamp_seconds("turn").alias("at"))
    batch = F.least(F.floor(F.col("id") / 2), F.lit(3))
    rows = c.withColumn("b", batch).unionAll(c.where("id < 2").withColumn("b", F.lit(3).cast("long")))
    out = _in_batches(spark, rows, F.col("b"), state.new_with_context)
    return out.select(F.col("thread").alias("conv_id"), F.col("id").alias("turn"), "fresh")


@query("""with g as (select user_id, event_id % 4 as b, max(ts) filter (event_type not in ('purchase', 'error')) as m, max(ts) filter (event_type in ('purchase', 'error')) as c from events group by all)
          select user_id, case when max(c) over w >= max(m) over w then 'skip' else 'need' end as state from g window w as (partition by user_id order by b)""")
def memo_stream(spark, sf_dir):
    """After each batch, threads whose last check, with or without a finding, is as new as their newest message."""
    kind = F.when(F.col("event_type") == "purchase", "found").when(F.col("event_type") == "error", "nothing").otherwise("message")
    rows = _events(spark, sf_dir).select(F.col("user_id").alias("thread"), F.col("event_id").alias("id"), F.col("ts").alias("at"), kind.alias("kind"))
    return _in_batches(spark, rows, F.col("id") % 4, state.memo).select(F.col("thread").alias("user_id"), "state")


@query("""with recursive e as (select user_id, event_id, epoch_us(ts) as us, row_number() over (partition by user_id order by ts, event_id) as rn from events),
               r as (select user_id, event_id, rn, true as allowed, [us] as held from e where rn = 1
                     union all select e.user_id, e.event_id, e.rn, len(list_filter(held, lambda h: h > us - 86400000000)) < 3,
                       case when len(list_filter(held, lambda h: h > us - 86400000000)) < 3 then list_append(held, us) else held end from r join e on e.user_id = r.user_id and e.rn = r.rn + 1)
          select event_id, allowed from r""")
def rate_stream(spark, sf_dir):
    """At most three events of a user in any day; refused ones don't count. Four batches, one after the other in time."""
    rows = _events(spark, sf_dir).select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.col("ts").alias("at"))
    cuts = rows.agg(F.percentile_approx(F.unix_micros("at"), [0.25, 0.5, 0.75]).alias("q")).first().q or []
    batch = sum((F.when(F.unix_micros("at") > q, 1).otherwise(0) for q in cuts), F.lit(0))
    return _in_batches(spark, rows, batch, lambda s: state.limited(s, 3, 86400)).select(F.col("id").alias("event_id"), "allowed")


@query("""with e as (select user_id, event_id % 4 as b, case event_type when 'signup' then 'total' when 'purchase' then 'done' when 'error' then 'failed' when 'view' then 'total' when 'click' then 'done' else 'skipped' end as kind from events),
               g as (select user_id, b, count(*) filter (kind = 'total') as t, count(*) filter (kind = 'skipped') as sk, count(*) filter (kind = 'done') as d, count(*) filter (kind = 'failed') as f, user_id % 3 = 0 and b >= 1 as asked from e group by all
                     union all select user_id, 1, 0, 0, 0, 0, true from (select distinct user_id from e where user_id % 3 = 0) where user_id not in (select user_id from e where b = 1)),
               s as (select *, sum(t) over w as total, sum(sk) over w as skipped, sum(case when asked and b > 1 then 0 else d end) over w as done, sum(case when asked and b > 1 then 0 else f end) over w as failed,
                       sum(case when asked and b > 1 then d + f else 0 end) over w as stopped from g window w as (partition by user_id order by b)),
               c as (select *, min(b) filter (total > 0 and total <= skipped + done + failed + stopped) over (partition by user_id) as ended from s)
          select user_id, total::bigint as total, skipped::bigint as skipped, done::bigint as done, failed::bigint as failed, stopped::bigint as stopped,
            case when b >= ended then case when user_id % 3 = 0 and ended >= 1 then 'stopped' else 'completed' end when asked then 'stopping' else 'running' end as state from c""")
def counter_stream(spark, sf_dir):
    """Counters of runs (users here) after each of four batches; every third run is asked to stop in the second, and its later tasks count as stopped."""
    kinds = {"signup": "total", "purchase": "done", "error": "failed", "view": "total", "click": "done"}
    kind = F.coalesce(F.create_map(*(F.lit(x) for kv in kinds.items() for x in kv))[F.col("event_type")], F.lit("skipped"))
    e = _events(spark, sf_dir).select(F.col("user_id").alias("run"), (F.col("event_id") % 4).alias("b"), kind.alias("kind"), F.lit(1).cast("long").alias("n"))
    stops = e.where("run % 3 = 0").select("run", F.lit(1).cast("long").alias("b"), F.lit("stop").alias("kind"), F.lit(1).cast("long").alias("n")).distinct()
    return _in_batches(spark, e.unionAll(stops), F.col("b"), state.counters).withColumnRenamed("run", "user_id")


@query("""select user_id, count(*) as n, min(event_id) as first, max(event_id) as last, sum(case when event_type = 'error' then 1 else 0 end)::bigint as errors from events group by user_id""")
def mailbox_stream(spark, sf_dir):
    """A mailbox that is delivered in three parts, each with the last messages of the one before, read by a stream that looks back ten minutes:
    every message once, upserted by id."""
    at = folder(spark, "mail")
    e = _events(spark, sf_dir)
    last = e.agg(F.max("event_id")).first()[0] or 0
    i = F.col("event_id")
    part = F.floor(3 * i / (last + 1)) + F.when((i + 5 <= last) & (F.floor(3 * i / (last + 1)) < F.floor(3 * (i + 5) / (last + 1))), 1).otherwise(0)
    stamp = F.date_format(F.timestamp_seconds(60 * i), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    mails = e.select(part.alias("part"), i.cast("string").alias("message_id"), F.col("user_id").cast("string").alias("conversation_id"), stamp.alias("received_at"), F.col("event_type").alias("subject"))
    for k in range(3):
        mails.where(F.col("part") == k).drop("part").write.mode("append").json(f"{at}/box")
        stream = mailbox.mailbox(spark, f"{at}/box", stream=True, overlap=600, page=1000, span=5000)
        ingest.run(stream, f"{at}/state", each=ingest.deltas_into(f"{at}/table", ["message_id"], "received_at"))
    m = ingest.current(spark, f"{at}/table", ["message_id"], "received_at").withColumn("id", F.col("message_id").cast("long"))
    g = m.groupBy(F.col("conversation_id").cast("long").alias("user_id"))
    return g.agg(F.count("*").alias("n"), F.min("id").alias("first"), F.max("id").alias("last"), F.count_if(F.col("subject") == "error").alias("errors"))
