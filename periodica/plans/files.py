"""Mails, workbooks and folders that Spark writes from the tables and reads back, and the rules for names, days and attachments."""

from __future__ import annotations

from pyspark.sql import functions as F

from periodica.functions import dates, letters as l, names, sheets, text as x
from periodica.operators import predicates, relational
from periodica.operators.stored import folder
from periodica.plans.registry import query, table as t
from periodica.sources import mail, vault, workbooks

SPACE = r"\s+"


@query(r"""select conv_id, turn, role || ' of ' || conv_id as subject, role || '@x.org' as sender, md5(regexp_replace(trim(text, ' ' || chr(10) || chr(9) || chr(13)), '\s+', ' ', 'g')) as said, '2024-01-02 03:04:05' as date from conversations""")
def mails_read(spark, sf_dir):
    """A mail built of every turn, and read again: headers, date and body."""
    none = F.lit(None).cast("string")
    c = t(spark, sf_dir, "conversations").withColumn("id", F.monotonically_increasing_id())
    built = c.select(F.concat_ws("/", "conv_id", "turn").alias("path"), F.lit(None).cast("binary").alias("raw"), F.concat("role", F.lit(" of "), "conv_id").alias("subject"), F.concat("role", F.lit("@x.org")).alias("sender"),
                     F.lit("b@x.org").alias("to"), F.lit("Tue, 02 Jan 2024 07:04:05 +0400").alias("date"), "text", none.alias("html"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"))
    files = mail.rebuilt(built).select(F.col("id").cast("string").alias("path"), "content")
    m = mail.messages(files).withColumn("id", F.col("path").cast("long"))
    said = F.md5(F.regexp_replace(F.regexp_replace("body_text", r"^\s+|\s+$", ""), SPACE, " ").cast("binary"))
    return m.select(F.floor(F.col("id") / 1000).alias("conv_id"), (F.col("id") % 1000).alias("turn"), "subject", F.col("from_").alias("sender"), said.alias("said"), F.date_format("date", "yyyy-MM-dd HH:mm:ss").alias("date"))


@query("""select conv_id, count(*) as leaves, 1 as depth, string_agg(role || ' ' || turn, ',' order by turn) as subjects from conversations group by conv_id""")
def mails_bundled(spark, sf_dir):
    """The mails of each conversation bundled into one, oldest first, and taken apart again."""
    none = F.lit(None).cast("string")
    c = t(spark, sf_dir, "conversations")
    built = mail.rebuilt(c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.lit(None).cast("binary").alias("raw"), F.concat_ws(" ", "role", "turn").alias("subject"), none.alias("sender"), none.alias("to"), none.alias("date"), F.lit("x").alias("text"), none.alias("html")))
    whole = mail.bundled(built.withColumn("conv_id", F.floor(F.col("id") / 1000)), "conv_id", "id")
    leaves = mail.flattened(whole.select(F.col("conv_id").cast("string").alias("path"), "content"))
    name = F.regexp_replace(F.split_part("label", F.lit("/"), F.lit(2)), r"\.eml$", "")
    g = leaves.groupBy(F.col("path").cast("long").alias("conv_id")).agg(F.count("*").alias("leaves"), F.max("depth").alias("depth"), F.sort_array(F.collect_list(F.struct("place", name.alias("n")))).alias("s"))
    return g.select("conv_id", "leaves", "depth", F.array_join(F.transform("s", lambda s: s["n"]), ",").alias("subjects"))


@query("""select s_nationkey as nation, s_suppkey::varchar as badge, s_name as name, 'P' || (s_suppkey % 7) as project, lower(replace(s_name, '#', '')) || '@x.org' as address from supplier""")
def workbooks_read(spark, sf_dir):
    """A roster's workbook for each nation, written and read again: columns found by their headers."""
    s = t(spark, sf_dir, "supplier")
    book = s.select(F.col("s_nationkey").cast("long").alias("nation"), F.col("s_suppkey").cast("long").alias("Emp ID"), F.col("s_name").alias("Employees  Name"), F.concat(F.lit("P"), (F.col("s_suppkey") % 7).cast("string")).alias("Project"),
                    F.concat(F.lower(F.replace("s_name", F.lit("#"), F.lit(""))), F.lit("@x.org")).alias("Email"), F.when(F.col("s_suppkey") % 2 == 0, "FFFFFF00").alias("fill"))
    files = workbooks.write_by(book, "nation", "Emp ID", "fill").select(F.col("nation").cast("string").alias("path"), "content")
    return workbooks.roster(workbooks.read(files)).select(F.col("path").cast("long").alias("nation"), "badge", "name", "project", "address")


def _vault(spark, sf_dir):
    """Files of orders below priority, status and a folder of the year."""
    at = folder(spark, "vault")
    o = t(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("team"), F.col("o_orderstatus").alias("person"), F.concat(F.lit("May-"), F.year("o_orderdate").cast("string")).alias("month"))
    o.repartition("team", "person", "month").write.partitionBy("team", "person", "month").parquet(at)
    return vault.listed(spark, at)


ORDERS = "o as (select distinct 'team=' || o_orderpriority as team, 'person=' || o_orderstatus as person, 'month=May-' || year(o_orderdate) as month from orders)"


@query(f"""with {ORDERS} select 0 as level, team as folder, count(distinct person) as children from o group by team union all select 1, team || '/' || person, count(*) from o group by team, person union all select 2, team || '/' || person || '/' || month, 1 from o""")
def vault_levels(spark, sf_dir):
    return vault.children(_vault(spark, sf_dir)).select("level", "folder", "children")


@query(f"""with {ORDERS} select right(month, 4)::int as year, count(*) as files from o group by 1""")
def vault_years(spark, sf_dir):
    return vault.by_year(_vault(spark, sf_dir)).select("year", "files")


@query(f"""with {ORDERS} select count(*) filter (team = 'team=1-URGENT') as urgent, count(*) filter (right(month, 4) = '1995') as of_year, count(*) filter (person = 'person=F') as of_person, count(*) filter (team = 'team=2-HIGH' and month like 'month=May-199%') as of_month from o""")
def vault_scopes(spark, sf_dir):
    """How many files there are in scopes by team, year, person and month."""
    v = _vault(spark, sf_dir)
    scopes = {"urgent": predicates.in_scope(F.col("path"), "team=1-URGENT/"), "of_year": predicates.in_scope(F.col("path"), "team=", year=1995),
              "of_person": predicates.in_scope(F.col("path"), "team=", people=["person=F"]), "of_month": predicates.in_scope(F.col("path"), "team=2-HIGH/", month="month=May-199")}
    return v.agg(*(F.count_if(c).alias(n) for n, c in scopes.items()))


@query("""select page_id, (['pdf', 'image', 'xlsx', 'xlsx', 'docx', 'docx', 'eml', 'unknown'])[(page_id % 8) + 1] as kind,
             (['application/octet-stream', 'image/jpeg', 'application/vnd.openxmlformats-officedocument.spreadsheetml.sheet', 'text/csv', 'application/vnd.openxmlformats-officedocument.wordprocessingml.document', 'x/y', 'message/rfc822', 'application/octet-stream'])[(page_id % 8) + 1] as media from pages""")
def file_types(spark, sf_dir):
    """What a file is by its first bytes, else by its name; and the media type, where the given one says nothing."""
    k = (F.col("page_id") % 8).cast("int")
    pick = lambda *v: F.element_at(F.array(*(F.lit(i) for i in v)), k + 1)
    head = F.unhex(pick("255044462D312E34", "FFD8FFE0", "504B030420786C2F", "D0CF11E0A1B11AE1", "504B0304776F72642F", "D0CF11E0A1B11AE1", "46726F6D3A", "00"))
    name = pick("a.bin", "photo.JPG", "b.xlsx", "r.csv", "c.docx", "letter", "m.EML", "noname")
    given = pick("application/octet-stream", "", "application/octet-stream", "", "application/octet-stream", "x/y", "", "")
    return t(spark, sf_dir, "pages").select("page_id", l.sniffed(name, F.concat(head, F.col("html").cast("binary"))).alias("kind"), l.media_type(name, given).alias("media"))


@query(r"""select c_custkey, lower(trim(regexp_replace('  ' || c_name || chr(9) || ' X  y ', '\s+', ' ', 'g'))) as key, case when c_custkey % 3 = 0 then c_custkey::varchar else 'n' || c_custkey end as number,
             case c_custkey % 4 when 0 then 'ACO-' || c_custkey when 1 then 'ACO ' || c_custkey end as aco, case c_custkey % 4 when 1 then 'DCO' || c_custkey when 2 then 'DCO' || c_custkey end as dco from customer""")
def name_keys(spark, sf_dir):
    """Keys of names whatever their case and spaces, numbers without a decimal point, and references taken apart."""
    k = F.col("c_custkey").cast("string")
    number = F.when(F.col("c_custkey") % 3 == 0, F.concat(k, F.lit(".0"))).otherwise(F.concat(F.lit("N"), k))
    kind = F.col("c_custkey") % 4
    ref = F.when(kind == 0, F.concat(F.lit("see aco-"), k)).when(kind == 1, F.concat(F.lit("ACO "), k, F.lit(" / dco"), k)).when(kind == 2, F.concat(F.lit(" "), k)).otherwise(F.lit("none"))
    both = x.split_reference(ref)
    return t(spark, sf_dir, "customer").select("c_custkey", x.name_key(F.concat(F.lit("  "), "c_name", F.lit("\t X  y "))).alias("key"), x.name_key(number).alias("number"), both["aco"].alias("aco"), both["dco"].alias("dco"))


@query("""select doc_id, length(regexp_replace(coalesce(source, ''), '[^A-Za-z]', '', 'g')) < 2 or doc_id % 5 in (1, 2, 3) as placeholder from documents""")
def placeholders(spark, sf_dir):
    d = F.col("doc_id") % 5
    said = F.when(d == 1, " John DOE ").when(d == 2, "N/A").when(d == 3, "-- 7").otherwise(F.col("source"))
    return t(spark, sf_dir, "documents").select("doc_id", names.is_placeholder(said).alias("placeholder"))


@query("""select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as present, strftime(o_orderdate + interval 1 day, '%Y-%m-%d') as weekend from orders""")
def attendance_found(spark, sf_dir):
    """A grid in prose: days with clock times, and days that a word says are off; the third is neither."""
    d = F.col("o_orderdate")
    day = lambda n, form: F.date_format(d + F.make_interval(days=F.lit(n)), form)
    text = F.concat(day(0, "yyyy-MM-dd"), F.lit(" 08:30 to 17:00 8h\n"), day(1, "d MMM yyyy"), F.lit(" Weekly OFF\n"), day(2, "MMMM d, yyyy"), F.lit(" sick leave"))
    a = l.attendance(text)
    return t(spark, sf_dir, "orders").select("o_orderkey", F.array_join(a["present"], ",").alias("present"), F.array_join(a["weekend"], ",").alias("weekend"))


@query("""select o_orderkey, case when o_orderkey % 3 = 0 then '1996-02-' || lpad((o_orderkey % 40)::varchar, 2, '0') end as day,
             case when o_orderkey % 3 = 0 and o_orderkey % 40 between 1 and 29 then '1996-02-' || lpad((o_orderkey % 40)::varchar, 2, '0') when o_orderkey % 3 = 1 then strftime(o_orderdate, '%Y-%m-%d') end as iso,
             case when month(o_orderdate) = 2 and year(o_orderdate) = 1996 then 0 else 1 end as outside, array_to_string(list_sort(list_distinct([strftime(o_orderdate, '%Y-%m-%d'), '1995-05-05'])), ',') as clean,
             o_orderkey % 14 between 1 and 12 and year(o_orderdate) + 4 between 2000 and 2100 as valid, case when year(o_orderdate) = 1996 then month(o_orderdate) else 12 end as focus from orders""")
def day_rules(spark, sf_dir):
    """Bare day numbers and whole dates, dates of another month, clean lists, valid periods, and the month that a list opens with."""
    k, d = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    two = F.lpad((k % 40).cast("string"), 2, "0")
    value = F.when(k % 3 == 0, two).when(k % 3 == 1, d).otherwise(F.lit("5th"))
    of = dates.outside(F.array(d), F.lit(1996), F.lit(2))
    return t(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(k % 3 == 0, F.concat(F.lit("1996-02-"), two)).alias("day"), dates.iso_or_day(value, 1996, 2).alias("iso"), F.size(of).alias("outside"),
        F.array_join(dates.clean(F.array(F.concat(F.lit(" "), d), F.lit("1995-05-05"), d, F.lit("x"))), ",").alias("clean"),
        sheets.valid_period(F.year("o_orderdate") + 4, (k % 14).cast("int")).alias("valid"), sheets.focus_month(1996, F.col("o_orderdate")).alias("focus"),
    )


@query("""select event_id, event_id % 3 = 0 as ok from events""")
def json_flags(spark, sf_dir):
    """A boolean inside a JSON text; a text without it, or that is no JSON, counts as false."""
    k = F.col("event_id") % 3
    e = t(spark, sf_dir, "events").withColumn("j", F.when(k == 0, F.lit('{"meta": {"ok": true}}')).when(k == 1, F.lit('{"meta": {"ok": "perhaps"}}')).otherwise(F.lit("{no")))
    return e.select("event_id", predicates.json_flag("j", "$.meta.ok").alias("ok"))


@query("""select page_id, case when page_id % 3 = 0 then '<img src="file:scan.jpg">' else '<img src="">' end as html, page_id * 1000 < 71680 or page_id % 5 = 0 as decorative from pages where page_id > 0""")
def inlined_pictures(spark, sf_dir):
    """References to attachments answered by name, others dropped; and whether the picture only decorates a mail that has a document."""
    p = t(spark, sf_dir, "pages").where("page_id > 0")
    k = F.col("page_id")
    one = F.struct(F.lit("scan.jpg").alias("filename"), F.lit("image/jpeg").alias("content_type"), (k * 1000).cast("long").alias("size"), F.when(k % 3 == 0, F.lit("<C1>")).alias("cid"), (k % 5 == 0).alias("is_inline"))
    html = F.lit('<img src="cid:c1">')
    return p.select("page_id", l.resolved_cids(html, F.array(one)).alias("html"), l.decorative(one, F.lit(True)).alias("decorative"))


@query("""with n as (select p_partkey, 'f' || (p_partkey % 50) as folder, 'n' || (p_partkey % 7) || '.pdf' as name, row_number() over (partition by p_partkey % 50, p_partkey % 7 order by p_partkey) as k, p_partkey % 7 < 3 as taken from part)
          select p_partkey, case when not taken and k = 1 then name when taken and k = 1 or not taken and k = 2 then replace(name, '.pdf', '_2024-01-02.pdf')
                   else replace(name, '.pdf', '_2024-01-02 (' || (case when taken then k else k - 1 end) || ').pdf') end as stored_name from n""")
def dated_copies(spark, sf_dir):
    """Names that overwrite nothing: three of seven are there already."""
    p = t(spark, sf_dir, "part")
    file = lambda k: (F.concat(F.lit("f"), (k % 50).cast("string")).alias("folder"), F.concat(F.lit("n"), (k % 7).cast("string"), F.lit(".pdf")).alias("name"))
    k = F.col("p_partkey")
    taken = p.where(k % 7 < 3).select(*file(k)).distinct()
    return relational.dated_names(p.select("p_partkey", *file(k)), "folder", "name", taken, F.lit("2024-01-02").cast("date"), "p_partkey").select("p_partkey", "stored_name")
