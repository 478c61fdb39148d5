"""Text queries: HTML flattening, keyword scores, scrubbing, duplicates and path roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from periodica.functions import letters, text as x
from periodica.operators import relational as rel
from periodica.plans.registry import query, table as t


@query("""select sha256(text) as digest, count(*) as copies, min(doc_id) as first_doc from documents where text is not null group by 1 having count(*) > 1""")
def exact_dedup(spark, sf_dir):
    g = t(spark, sf_dir, "documents").where("text is not null").groupBy(F.sha2("text", 256).alias("digest"))
    return g.agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc")).where("copies > 1")


@query(r"""with f as (select doc_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(text, '')), '\b(approved\s*by|approval\s*date|date\s*(of\s*)?approval)\s*:?\s*[^\n]*', ' ', 'g'),
                           '\b(approval|approved|approver|signature|signed|signatory|stamp|line\s*manager|manager|lm|status|submitted|pending|present)\b', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')) as p from documents)
           select md5(p) as fingerprint, count(*) as copies, min(doc_id) as first_doc from f where length(p) >= 40 group by p having count(*) > 1""")
def fingerprint_groups(spark, sf_dir):
    f = t(spark, sf_dir, "documents").select("doc_id", x.fingerprint(F.col("text")).alias("p")).where(F.char_length("p") >= 40)
    g = f.groupBy(F.md5(F.col("p").cast("binary")).alias("fingerprint")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc"))
    return g.where("copies > 1")


@query("""select doc_id, cast(50 * contains(lower(text), 'license')::int + 50 * contains(lower(text), 'password')::int + 5 * len(regexp_extract_all(lower(text), 'the'))
                 + 5 * len(regexp_extract_all(lower(text), 'que')) + least(floor(length(text) / 200), 40) as bigint) as score from documents""")
def keyword_score(spark, sf_dir):
    score = x.keyword_score(F.col("text"), ["license", "password"], ["the", "que"])
    return t(spark, sf_dir, "documents").select("doc_id", score.cast("long").alias("score"))


@query(r"""with m as (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) as a, generate_subscripts(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}'), 1) as i from documents),
                f as (select doc_id, lower(a) as a, min(i) as i from m group by all)
           select doc_id, string_agg(a, ',' order by i) as emails from documents left join f using (doc_id) group by doc_id""")
def email_scan(spark, sf_dir):
    """The addresses of a text, each once, in order of appearance."""
    return t(spark, sf_dir, "documents").select("doc_id", F.nullif(F.array_join(x.emails(F.col("text")), ","), F.lit("")).alias("emails"))


@query()
def html_flatten(spark, sf_dir):
    return t(spark, sf_dir, "pages").select("page_id", x.html_text(F.col("html")).alias("text"))


@query()
def scrubbed(spark, sf_dir):
    """Mail texts without addresses, secrets and telephone numbers; look-arounds are beyond the SQL side, ``scrubbed_addresses`` counts there."""
    return t(spark, sf_dir, "documents").select("doc_id", letters.scrub(F.col("text")).alias("text"))


@query(r"""select regexp_extract(url, '^https?://([^/]+)', 1) as host, regexp_extract(url, '^https?://[^/]+/([^/?#]+)', 1) as folder, count(*) as pages,
                  cast(sum(strlen(html)) as bigint) as bytes from pages group by 1, 2""")
def path_rollup(spark, sf_dir):
    host, folder = (F.regexp_extract("url", r, 1) for r in (r"^https?://([^/]+)", r"^https?://[^/]+/([^/?#]+)"))
    return t(spark, sf_dir, "pages").groupBy(host.alias("host"), folder.alias("folder")).agg(F.count("*").alias("pages"), F.sum(F.octet_length("html")).alias("bytes"))


@query(r"""select page_id, case when n = 1 then name else regexp_replace(name, '^(.*?)(\.[^.]*)?$', '\1 (' || n || ')\2') end as stored_name from
           (select page_id, name, row_number() over (partition by host, name order by page_id) as n from
            (select page_id, regexp_extract(url, '^https?://([^/]+)', 1) as host, lang || '.html' as name from (select *, regexp_extract(url, '/([a-z]{2})/', 1) as lang from pages)))""")
def stored_names(spark, sf_dir):
    name = F.concat(F.regexp_extract("url", "/([a-z]{2})/", 1), F.lit(".html"))
    pages = t(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("host"), name.alias("name"))
    return rel.name_collisions(pages, "host", "name", "page_id").select("page_id", "stored_name")


@query(r"""select lang, source, count(*) as n, count(*) filter (text is null) as empty, cast(sum(length(text)) as bigint) as chars from documents group by lang, source""")
def kind_histogram(spark, sf_dir):
    return t(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"), F.count_if(F.col("text").isNull()).alias("empty"), F.sum(F.char_length("text")).alias("chars"))
