"""Operators and functions on small frames: edge cases that the driver tables don't hold."""

import pytest
from pyspark.sql import functions as F

from periodica.functions import dates, text
from periodica.operators import predicates as p
from periodica.operators import relational as rel
from periodica.streaming import ingest


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first()


def test_dates(spark):
    y, m = F.lit(2024), F.lit(2)
    r = one(
        spark,
        n=dates.days_in_month(y, m),
        none=dates.days_in_month(y, F.lit(13)),
        w=dates.weekends(y, m, ["Friday"]),
        c=dates.clean(F.array(F.lit(" 2024-02-31"), F.lit("2024-2-3"), F.lit("2024-01-01"), F.lit("2024-01-01"))),
        u=F.size(dates.unaccounted(y, m, F.array(F.lit("2024-02-01"), F.lit("2024-03-01")))),
        o=dates.outside(F.array(F.lit("2024-02-01"), F.lit("2024-03-01")), y, m),
        d=dates.iso_or_day(F.lit("7"), 2024, 2),
        i=dates.iso_or_day(F.lit("2024-02-30"), 2024, 2),
        x=dates.iso_or_day(F.lit("31"), 2024, 2),
        b=dates.iso_or_day(F.lit("soon"), 2024, 2),
    )
    assert (r.n, r.none, r.u, r.o, r.d, r.i, r.x, r.b) == (29, None, 28, ["2024-03-01"], "2024-02-07", None, None, None)
    assert r.w == ["2024-02-02", "2024-02-09", "2024-02-16", "2024-02-23"]
    assert r.c == ["2024-01-01", "2024-02-31"]


def test_text(spark):
    r = one(
        spark,
        k=text.name_key(F.lit("  Abdul   GHANI ")),
        n=text.name_key(F.lit("123.0")),
        d=text.dimension_key(F.lit("Sick Leaves")),
        s=text.split_reference(F.lit("aco 12 / DCO-7")),
        b=text.split_reference(F.lit(" 77 ")),
        e=text.emails(F.lit("A@x.org; b@y.com, a@X.org")),
        h=text.html_text(F.lit("<table><tr><td>a</td><td>b &amp; c</td></tr></table><p>x<br>y</p><script>no</script>")),
        f=text.fingerprint(F.lit("Hello, World\nApproved by me\nBye")),
        q=text.safe_name(F.lit("a/b:c  d.pdf")),
    )
    assert (r.k, r.n, r.d, r.e, r.f, r.q) == ("abdul ghani", "123", "sick_leave", ["a@x.org", "b@y.com"], "hello world bye", "a_b_c d.pdf")
    assert tuple(r.s) == ("ACO 12", "DCO-7") and tuple(r.b) == (None, "DCO77")
    assert r.h == "a | b & c |\nx\ny"
    e = one(spark, e=text.html_text(F.lit("&auml;&#228;&#xE4;&nbsp;&amp;lt; &unknown; <b>bo</b>ld &hellip; 5 &lt; 6")))
    assert e.e == "äää &lt; &unknown; bold … 5 < 6"


def test_predicates(spark):
    df = spark.createDataFrame([(1, "a%b", '{"x": {"y": true}}'), (2, None, None), (3, "ab", "not json")], "id int, s string, j string")
    ids = lambda c: [r.id for r in df.where(c).orderBy("id").collect()]
    assert ids(p.every_term("A% b", "s")) == [1] and ids(p.every_term("", "s")) == [1, 2, 3]
    assert ids(p.like_any("a%b", "s")) == [1, 3]
    assert ids(p.not_listed("s", "ab, zz")) == [1]
    assert ids(p.json_flag("j", "$.x.y")) == [1]
    with pytest.raises(ValueError):
        p.period(df, "s", month=2)
    with pytest.raises(ValueError):
        rel.page(df, [F.col("id")], 501)


def test_diff_upsert_sync(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (3, "c", 3)], "k int, s string, n int")
    new = spark.createDataFrame([(2, None, 2), (3, "x", 3), (4, "d", 4)], "k int, s string, n int")
    assert {r.k: (r.change, r.fields) for r in rel.diff(old, new, ["k"], ["s", "n"]).collect()} == {1: ("missing", ""), 2: ("unchanged", ""), 3: ("update", "s"), 4: ("add", "")}
    assert sorted(map(tuple, rel.upsert(old, new, ["k"]).collect())) == [(1, "a", 1), (2, "b", 2), (3, "x", 3), (4, "d", 4)]
    assert sorted(r.k for r in rel.keyed_sync(old, new, "k", F.col("s") == "a").collect()) == [1, 2, 3, 4]
    assert sorted(r.k for r in rel.keyed_sync(old, new, "k", F.lit(False)).collect()) == [2, 3, 4]


def test_asof_is_strict(spark):
    left = spark.createDataFrame([("a", 5, 1), ("a", 7, 2), ("b", 5, 3)], "k string, at int, id int")
    right = spark.createDataFrame([("a", 5, 10), ("a", 6, 11)], "k string, at int, v int")
    assert {r.id: r.prior_v for r in rel.asof(left, right, "k", "at", "v").collect()} == {1: None, 2: 11, 3: None}


def test_stream_takes_each_key_once(spark, tmp_path):
    rows = [(k % 5, f"2024-01-01 00:0{k % 5}:00", k) for k in range(10)]
    df = spark.createDataFrame(rows, "id int, at string, n int").withColumn("at", F.to_timestamp("at"))
    df.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = ingest.once(ingest.source(spark, f"{tmp_path}/in", df, 1), "at", "id")
    ingest.run(stream, f"{tmp_path}/state", path=f"{tmp_path}/out")
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [0, 1, 2, 3, 4]


def test_months_are_united_by_one_list_aggregate(spark):
    from periodica.functions import sheets as s

    lists = {b: [] for b in s.ALL}
    base = lists | {"person": "p", "year": 2024, "month": 5, "period_type": "week", "days_covered": 1, "uncertain_days": [], "missing_days": [], "unaccounted": [], "issues": []}
    rows = [
        base | {"seq": 2, "annual": ["2024-05-02", "2024-06-09"], "sick": ["2024-04-30"], "issues": ["b", "a"], "missing_days": [4, 2], "uncertain_days": [("2024-05-07", "late")]},
        base | {"seq": 1, "annual": ["2024-05-01", "2024-06-09"], "issues": ["c", "b"], "missing_days": [2], "uncertain_days": [("2024-05-07", "first")], "period_type": "full_month"},
        base | {"seq": 3, "working_days": ["2024-05-03"], "missing_days": None, "period_type": None},
        base | {"seq": 1, "month": 6},
    ]
    texts = ", ".join(f"{b} array<string>" for b in s.ALL)
    d = spark.createDataFrame(rows, f"person string, year int, month int, seq int, period_type string, days_covered long, {texts}, uncertain_days array<struct<date: string, reason: string>>, missing_days array<int>, unaccounted array<string>, issues array<string>")
    g = s.month_union(d, "seq")
    got = {r.month: r for r in g.collect()}
    m = got[5]
    assert (m.annual, m.sick, m.working_days, m.remote) == (["2024-05-01", "2024-05-02", "2024-06-09"], ["2024-04-30"], ["2024-05-03"], [])
    assert (m.issues, m.missing_days, m.period_types, m.days_covered) == (["c", "b", "a"], [2, 4], ["full_month", "week"], 3)
    assert [tuple(u) for u in m.uncertain_days] == [("2024-05-07", "first")] and got[6].issues == got[6].annual == []
    said = g._jdf.queryExecution().optimizedPlan().toString()
    assert said.count("collect_list(") + said.count("collect_set(") == 1


def test_crossing_groups_hold_numbers_not_lists(spark):
    """Sheets of one name or none, dates of other months and of no month, against a reading by hand; no aggregate gathers a list."""
    import itertools
    import random

    from periodica.functions import sheets as s
    from periodica.plans import sheets as plans

    r = random.Random(7)
    days = ["2024-02-01", " 2024-02-16", "2024-02-17", "2024-02-29", "2024-02-31", "2024-02-32", "2024-02-00", "2024-03-01", "no date", None]
    rows = []
    for _ in range(120):
        lists = [r.choice([None, [], r.sample(days, 2)]) if b in ("annual", "remote", "other", "working_days", "weekend_days") else [] for b in s.ALL]
        rows.append((r.choice(["a", None]), *r.choice([(2024, 2), (2024, 2), (None, 2)]), r.choice(["x", "x", "y", None]), *lists))
    for few in (rows[:9], rows):
        df = spark.createDataFrame(few, "person string, year int, month int, name string, " + ", ".join(f"{b} array<string>" for b in s.ALL))
        seen = {}
        for person, year, month, name, *lists in few:
            for b, dates in zip(s.ALL, lists):
                for x in dates or ():
                    if x and (x := x.strip())[:2] == "20":
                        names, buckets = seen.setdefault((person, year, month, x), (set(), set()))
                        buckets.add(b)
                        names.update([name] if name else [])
        want = {(*k, *sorted(b)) for k, (n, b) in seen.items() if len(n) > 1 and any(s._apart(*two) for two in itertools.combinations(b, 2))}
        assert want and {(x.person, x.year, x.month, x.date, *x.buckets) for x in s.crossing(df).collect()} == want
    for plan in (s.crossing(df), plans.crossing_sheets(spark, "/root/testdata/sf0.001")):
        assert "collect_" not in plan._jdf.queryExecution().executedPlan().toString()


def test_sheets_of_bits_are_cleaned_as_their_lists_are(spark):
    """Bits and dates of other months, against the same sheets as lists; the query's sheets and their unions meet in one exchange."""
    import random

    from periodica.functions import daybits as bits
    from periodica.functions import sheets as s
    from periodica.plans import sheets as plans

    r = random.Random(5)
    rows = []
    for k in range(200):
        year, month = r.choice([(2024, 2), (2024, 2), (2023, 12), (None, 2)])
        masks = [sum(1 << (x - 1) for x in r.sample(range(1, 30), r.choice([0, 0, 1, 3]))) if year else 0 for _ in s.ALL]
        far = sorted((b, f"2024-0{r.randint(4, 5)}-1{r.randint(0, 2)}") for b in range(len(s.ALL)) if r.random() < 0.15)
        unsure = [("2024-02-07 ", "late"), ("2024-02-07", "x"), ("2024-04-10", None), ("soon", "x")][: r.choice([0, 0, 4])]
        rows.append((f"p{k % 9}", year, month, k, r.choice(["full_month", "week", None]), 1, unsure, r.choice([[], [3, 31, 2]]), far or None, *masks))
    uncertain, ints = "array<struct<date: string, reason: string>>", ", ".join(f"{b} int" for b in s.ALL)
    df = spark.createDataFrame(rows, f"person string, year int, month int, seq int, period_type string, days_covered long, uncertain_days {uncertain}, missing_days array<int>, _far {s.FAR}, {ints}")
    begins = bits.prefix(F.col("year"), F.col("month"))
    dated = lambda k, b: F.concat(F.coalesce(bits.days(F.col(b), begins), F.array().cast("array<string>")), F.transform(F.filter(F.coalesce("_far", F.array().cast(s.FAR)), lambda x: x["k"] == k), lambda x: x["date"]))
    lists = df.withColumns({b: dated(k, b) for k, b in enumerate(s.ALL)}).drop("_far")
    settled = s.settled(s.marked_bits(df))
    shown = ["seq", *s.SETS, "uncertain_days", "missing_days", "issues"]
    got = settled.select(*(s.listed(c).alias(c) if c in s.SETS else F.col(c) for c in shown)).orderBy("seq").collect()
    assert got == s.normalise(lists).select(shown).orderBy("seq").collect() and any(x.issues for x in got) and any(x.unaccounted for x in got)
    g = s.united(settled, "seq")
    shown[0] = "tag"
    got = g.select(*(s.listed(c).alias(c) if c in s.SETS else F.col(c) for c in shown)).orderBy("tag").collect()
    assert got == s.month_union(s.normalise(lists), "seq").select(shown).orderBy("tag").collect()
    said = plans.month_union(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert said.count("Exchange ") == 1
