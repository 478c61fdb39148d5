"""Archives, reports and raw copies that Spark writes from the tables and reads back."""

from __future__ import annotations

from pyspark.sql import functions as F

from periodica.operators.stored import folder
from periodica.plans.registry import query, table as t
from periodica.sources import sinks, vault, workbooks


@query("""select coalesce(source, '') as archive, doc_id, md5(coalesce(text, '')) as content, strlen(coalesce(text, '')) as n_bytes from documents""")
def archives_read(spark, sf_dir):
    """Every document as a file in the zip archive of its source, written and read again entry by entry."""
    d, at = t(spark, sf_dir, "documents"), folder(spark, "archives")
    files = d.select("source", F.concat_ws("/", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"), F.encode("text", "UTF-8").alias("content"))
    sinks.write_archives(files, at, F.col("source"))
    doc = F.regexp_extract("path", r"(\d+)\.txt$", 1).cast("long")
    return sinks.read_archives(spark, at).select("archive", doc.alias("doc_id"), F.md5("content").alias("content"), F.octet_length("content").cast("long").alias("n_bytes"))


@query("""select s_suppkey as id, strlen(s_name) as length from supplier where s_acctbal < 0""")
def raw_kept(spark, sf_dir):
    """A raw copy of every supplier's file, released where it went well: what waits for another try."""
    s, at = t(spark, sf_dir, "supplier"), folder(spark, "raw")
    path = sinks.raw_path(F.col("s_suppkey"), F.col("s_name"))
    sinks.write_files(s.select(path.alias("path"), F.encode("s_name", "UTF-8").alias("content")), at)
    sinks.delete(s.where("not s_acctbal < 0").select(path.alias("path")), at).write.format("noop").mode("overwrite").save()
    return vault.listed(spark, at).select(F.split_part("path", F.lit("/"), F.lit(1)).cast("long").alias("id"), "length")


@query(f"""with m as (select distinct year(l_shipdate) as y, month(l_shipdate) as m from lineitem where l_shipdate is not null),
          l as (select l_suppkey as pk, year(l_shipdate) as y, month(l_shipdate) as m, strftime(l_shipdate, '%Y-%m-%d') as day, l_linenumber as k, l_returnflag as flag from lineitem where l_shipdate is not null),
          b as (select pk, y, m, k, count(distinct day) as n, string_agg(distinct day, ', ' order by day) as days from l where flag <> 'N' group by all),
          r as (select pk, y, m, count(*) as files from l where flag <> 'N' group by all)
          select strftime(make_date(m.y, m.m, 1), '%b %Y') as period, s_suppkey as pk, s_name as name,
                 case when r.pk is not null then 'Received & Stored' when exists (from l where l.pk = s_suppkey and l.y = m.y and l.m = m.m) then 'Received & Not Stored' else 'Not Received' end as status,
                 case when r.pk is not null then null when exists (from l where l.pk = s_suppkey and l.y = m.y and l.m = m.m) then 'FFEB9C' else 'FFC7CE' end as fill,
                 coalesce(r.files, 0) as files, strftime(make_date(m.y, m.m, 1), '%B') as month, m.y as year,
                 coalesce(annual.n, 0) as annual, coalesce(absent.days, '') as absent_days, coalesce(sick.n, 0) as sick, coalesce(sick.days, '') as sick_days, 34 as width
          from m cross join supplier left join r on r.pk = s_suppkey and r.y = m.y and r.m = m.m
          left join b annual on annual.pk = s_suppkey and annual.y = m.y and annual.m = m.m and annual.k = 1 left join b sick on sick.pk = s_suppkey and sick.y = m.y and sick.m = m.m and sick.k = 3
          left join b absent on absent.pk = s_suppkey and absent.y = m.y and absent.m = m.m and absent.k = 6""")
def month_workbooks(spark, sf_dir):
    """The report of every month as a workbook, a row a supplier, read again: states, colours, counts and dates."""
    s = t(spark, sf_dir, "supplier")
    of = [F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month"), F.col("l_suppkey").alias("pk")]
    l = t(spark, sf_dir, "lineitem").where("l_shipdate is not null").select(*of, F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"), "l_linenumber", "l_returnflag")
    filed = l.where("l_returnflag <> 'N'")
    lists = [F.sort_array(F.collect_set(F.when(F.col("l_linenumber") == k, F.col("day")))).alias(n) for k, n in enumerate(workbooks.LISTS, 1)]
    records = filed.groupBy("year", "month", "pk").agg(*lists, F.lit("valid").alias("validation_status"), F.lit("pending").alias("approval_status"), F.count("*").alias("source_file_count"))
    # a calendar's months, of which there are few: every person has a row in each
    months = l.select("year", "month").distinct().agg(F.collect_list(F.struct("year", "month")).alias("months"))
    person = {n: F.lit(None).cast("string") for n in workbooks.PERSON} | {"employee_id": F.col("s_suppkey").cast("string"), "employee_name": F.col("s_name")}
    people = s.join(F.broadcast(months)).select(F.explode("months").alias("m"), F.col("s_suppkey").alias("pk"), *(c.alias(n) for n, c in person.items())).select("m.*", "*").drop("m")
    books = workbooks.write_reports(workbooks.month_report(people, records, l))
    rows = workbooks.read(books.select(F.col("period").alias("path"), "content"), rows=workbooks.MOST_ROWS + 1).where("row > 1")
    at = {h: k for k, h in enumerate([*workbooks.PERSON.values(), *workbooks.STATE.values(), *(c for c, _ in workbooks.LISTS.values()), *(d for _, d in workbooks.LISTS.values())])}
    cell = lambda h: F.get("cells", F.lit(at[h]))
    return rows.select(
        F.col("path").alias("period"), cell("Employee ID").cast("long").alias("pk"), cell("Employee Name").alias("name"), cell("Status").alias("status"), F.get("fills", F.lit(0)).alias("fill"),
        cell("Source Files").cast("long").alias("files"), cell("Month").alias("month"), cell("Year").cast("int").alias("year"), cell("Annual Leave Count").cast("long").alias("annual"),
        cell("Absent Dates").alias("absent_days"), cell("Sick Leave Count").cast("long").alias("sick"), cell("Sick Leave Dates").alias("sick_days"), F.size("cells").alias("width"),
    )
