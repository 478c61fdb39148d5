"""A closed set of queries with parameters, checked before they run; stages that go on past a failure."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from periodica.operators import ordering, predicates
from periodica.operators.updates import edited
from periodica.plans.registry import query, table as t


@dataclasses.dataclass(frozen=True)
class Tool:
    """A query with parameters: name to (type, needed, allowed values or None)."""

    run: Callable[..., DataFrame]
    parameters: dict[str, tuple[type, bool, tuple | None]]
    writes: bool = False


TOOLS: dict[str, Tool] = {}


def tool(writes: bool = False, **parameters):
    def add(f):
        TOOLS[f.__name__] = Tool(f, parameters, writes)
        return f

    return add


class Refused(ValueError):
    pass


def call(name: str, spark: SparkSession, sf_dir: str, mode: str = "read", **given) -> DataFrame:
    """The result of a tool. Unknown names, unknown or missing parameters, wrong types and values, and writing tools in read mode
    are refused before anything is read."""
    if name not in TOOLS:
        raise Refused(f"no tool {name!r}")
    one = TOOLS[name]
    if one.writes and mode != "write":
        raise Refused(f"{name} writes")
    if unknown := sorted(set(given) - set(one.parameters)):
        raise Refused(f"unknown parameters {unknown}")
    for k, (kind, needed, allowed) in one.parameters.items():
        if k not in given or given[k] is None:
            if needed:
                raise Refused(f"{k} is needed")
        elif not isinstance(given[k], kind) or isinstance(given[k], bool) and kind is int:
            raise Refused(f"{k} must be {kind.__name__}")
        elif allowed and given[k] not in allowed:
            raise Refused(f"{k} must be one of {allowed}")
    return one.run(spark, sf_dir, **given)


MONTHS = tuple(range(1, 13))
# What people call the statuses of a record.
SYNONYMS = {"approved": "F", "done": "F", "final": "F", "open": "O", "pending": "O", "waiting": "O", "partial": "P", "review": "P"}


def canonical(word):
    """The status that a word means, whatever its case, spaces and plural; null if it means none."""
    key = F.regexp_replace(F.translate(F.lower(F.trim(word)), " -", "__"), "s+$", "")
    return F.create_map(*(F.lit(x) for kv in SYNONYMS.items() for x in kv))[key]


@tool(year=(int, True, None), month=(int, False, MONTHS), segment=(str, False, None))
def missing(spark, sf_dir, year, month=None, segment=None):
    """People without a record in a period."""
    filed = predicates.period(t(spark, sf_dir, "orders"), "o_orderdate", year, month).select(F.col("o_custkey").alias("c_custkey"))
    return predicates.where_given(t(spark, sf_dir, "customer"), c_mktsegment=segment).join(filed, "c_custkey", "left_anti").select("c_custkey", "c_name")


@tool(q=(str, True, None), limit=(int, False, None))
def search(spark, sf_dir, q, limit=200):
    found = t(spark, sf_dir, "part").where(predicates.every_term(q, "p_name", "p_type"))
    return ordering.envelope(found, [F.asc("p_partkey")], limit).select("p_partkey", "p_name", "total", "has_more")


@tool(first=(int, True, None), second=(int, True, None))
def compare(spark, sf_dir, first, second):
    """Totals of two years by status; statuses whose totals are equal are left out."""
    y = F.year("o_orderdate")
    rows = t(spark, sf_dir, "orders").where(y.isin(first, second)).groupBy("o_orderstatus").agg(F.count_if(y == first).alias("first"), F.count_if(y == second).alias("second"))
    return rows.withColumn("delta", F.col("second") - F.col("first")).where("delta <> 0")


@tool(writes=True, person=(int, True, None), action=(str, True, ("set", "add", "remove", "clear")), days=(list, True, None))
def edit(spark, sf_dir, person, action, days):
    """The days of a person's records after an edit, with what it added, removed and rejected."""
    days_of = t(spark, sf_dir, "orders").where(F.col("o_custkey") == person).groupBy("o_custkey").agg(F.sort_array(F.collect_set(F.date_format("o_orderdate", "yyyy-MM-dd"))).alias("days"))
    return edited(days_of, "days", F.lit(action), F.array(*map(F.lit, days)).cast("array<string>"))


@tool(year=(int, True, None), month=(int, True, MONTHS))
def reminder(spark, sf_dir, year, month):
    """A draft to everyone whose record is missing."""
    text = F.format_string("Dear %s, your record for %s is missing. Please send it.", F.col("c_name"), F.date_format(F.make_date(F.lit(year), F.lit(month), F.lit(1)), "MMMM yyyy"))
    return missing(spark, sf_dir, year, month).select("c_custkey", text.alias("draft"))


def cards(spark, sf_dir, name: str, result: DataFrame) -> DataFrame:
    """A card of a result: the tool, how many rows, and what to ask next."""
    following = {"missing": "reminder", "compare": "missing", "search": "compare"}
    return result.agg(F.count("*").alias("rows")).select(F.lit(name).alias("tool"), "rows", F.lit(following.get(name)).alias("next"))


@dataclasses.dataclass
class Stages:
    """Named stages over a frame. One that fails leaves the frame as it was and a note; a needed one ends the run."""

    stages: list[tuple[str, Callable[[DataFrame], DataFrame], bool]]
    notes: list[tuple[str, str]] = dataclasses.field(default_factory=list)

    def __call__(self, df: DataFrame, skip: tuple[str, ...] = ()) -> DataFrame:
        for name, stage, needed in self.stages:
            if name in skip:
                self.notes.append((name, "skipped"))
                continue
            try:
                new = stage(df)
                new.schema  # noqa: B018  an analysis error shows here, not at the end
                df = new
            except Exception as e:
                self.notes.append((name, f"{type(e).__name__}: {e}".split("\n")[0]))
                if needed:
                    break
        return df


@query("""select c_custkey, 'Dear ' || c_name || ', your record for January 1997 is missing. Please send it.' as draft from customer
          where c_custkey not in (select o_custkey from orders where o_orderdate >= timestamp '1997-01-01' and o_orderdate < timestamp '1997-02-01')""")
def reminder_drafts(spark, sf_dir):
    return call("reminder", spark, sf_dir, year=1997, month=1)


@query("""with g as (select o_orderstatus, count(*) filter (year(o_orderdate) = 1996) as first, count(*) filter (year(o_orderdate) = 1997) as second from orders where year(o_orderdate) in (1996, 1997) group by 1)
          select o_orderstatus, first, second, second - first as delta from g where second <> first""")
def year_comparison(spark, sf_dir):
    return call("compare", spark, sf_dir, first=1996, second=1997)


@query("""with d as (select o_custkey, array_agg(distinct strftime(o_orderdate, '%Y-%m-%d')) as days from orders where o_custkey = 7 group by 1), n as (select ['2031-01-05', '2031-01-04'] as new)
          select o_custkey, len(days) as before, len(list_distinct(list_concat(days, new))) as after, array_to_string(list_sort(new), ',') as added, 'soon' as rejected from d, n""")
def record_edit(spark, sf_dir):
    e = call("edit", spark, sf_dir, mode="write", person=7, action="add", days=["2031-01-05", "2031-01-04", "soon"])
    n = lambda c: F.size(c).cast("long")
    return e.select("o_custkey", n("before").alias("before"), n("days").alias("after"), F.array_join("added", ",").alias("added"), F.array_join("rejected", ",").alias("rejected"))


@query("""select 'missing' as tool, count(*) as rows, 'reminder' as next from customer where c_custkey not in (select o_custkey from orders where year(o_orderdate) = 1997)""")
def result_card(spark, sf_dir):
    return cards(spark, sf_dir, "missing", call("missing", spark, sf_dir, year=1997))


@query("""select event_type, case event_type when 'view' then 'O' when 'error' then 'P' when 'purchase' then 'F' end as status, count(*) as n from events group by 1""")
def canonical_status(spark, sf_dir):
    """Words that mean a status."""
    words = F.create_map(*(F.lit(x) for kv in {"view": " Waiting ", "error": "REVIEWS", "purchase": "done"}.items() for x in kv))
    return t(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n")).select("event_type", canonical(words[F.col("event_type")]).alias("status"), "n")
