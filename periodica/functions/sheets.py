"""Sheets of days: cleaning, conflicts, calendars, unions of a person's month, whom unnamed sheets belong to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from periodica.functions import dates as d
from periodica.functions import daybits as bits

# The lists of a sheet in the order in which the first to claim a date keeps it, and what may stand beside work.
BUCKETS = "annual remote sick maternity unpaid absent public_holiday other".split()
DAYS = "working_days weekend_days".split()
BESIDE_WORK = ("remote", "public_holiday")
ALL = [*BUCKETS, *DAYS]


def trimmed(dates: Column) -> Column:
    return F.transform(F.coalesce(dates, F.array().cast("array<string>")), lambda x: F.trim(x))


def duplicates(dates: Column) -> Column:
    """Dates that a list holds twice or more, in order of their second appearance."""
    return F.array_distinct(F.filter(F.transform(dates, lambda x, i: F.when(F.array_contains(F.slice(dates, 1, i), x), x)), lambda x: x.isNotNull()))


def compatible(a: Column, b: Column) -> Column:
    """Two lists that may both hold a date: work, and work elsewhere or on a holiday."""
    return ((a == "working_days") & b.isin(*BESIDE_WORK)) | ((b == "working_days") & a.isin(*BESIDE_WORK))


def claims(sheet_lists: list[str]) -> Column:
    """(bucket, place, date) of every date of a sheet's lists, in their order."""

    def of(k: int, b: str) -> Column:
        return F.transform(trimmed(F.col(b)), lambda x, i: F.struct(F.lit(k).alias("k"), i.alias("i"), F.lit(b).alias("bucket"), x.alias("date")))

    return F.concat(*(of(k, b) for k, b in enumerate(sheet_lists)))


def _apart(a: str, b: str) -> bool:
    """Whether a date may not be in both lists."""
    return a != b and {a, b} not in ({"working_days", x} for x in BESIDE_WORK)


def normalise(sheets: DataFrame, weekends: Column | None = None) -> DataFrame:
    """``sheets`` (year, month, period_type, missing_days, uncertain_days, and the lists) with clean lists, ``unaccounted`` and ``issues``.

    A date belongs to the first list that claims it; work and work elsewhere may share one, of which the first list keeps it.
    Dates of another month stay and are flagged. ``weekends``: dates that the calendar says are weekends, which decide between
    work and weekend. Missing days outside the month go. Days that no list has are unaccounted, of whole months only.

    The month's days are sets of bits; dates of other months and those in conflict, few as a rule, are read one by one.
    """
    s = settled(marked(sheets, weekends))
    own = [*sheets.columns, *(c for c in (*ALL, "uncertain_days", "missing_days", "unaccounted", "issues") if c not in sheets.columns)]
    return s.select(*(listed(c).alias(c) if c in SETS else F.col(c) for c in own))


#: The lists and the days that none has, by number: settled sheets have ``_b0`` and so on, and ``_far`` (k, date) for dates that are no days of the month; null: none.
SETS = [*ALL, "unaccounted"]
FAR = "array<struct<k: int, date: string>>"


def listed(name: str) -> Column:
    """A list of a settled sheet, or of a union of them, as dates in order."""
    k = SETS.index(name)
    here, far = bits.days(F.col(f"_b{k}"), bits.prefix(F.col("year"), F.col("month"))), F.transform(F.filter("_far", lambda x: x["k"] == k), lambda x: x["date"])
    return F.when(F.col("_far").isNull(), here).otherwise(F.array_sort(F.array_distinct(F.concat(here, far))))


def _some(test: Column, found: Column, kind: str = "array<string>") -> Column:
    """``found``, which is computed only where ``test`` says that there is any."""
    return F.when(test, found).otherwise(F.array().cast(kind))


def marked(sheets: DataFrame, weekends: Column | None = None) -> DataFrame:
    """Sheets of lists with what ``settled`` reads: the lists as bits, and the claims that are read one by one."""
    begins = F.col("_begins")
    iso = lambda c: c["date"].rlike(d.ISO)
    known = weekends if weekends is not None else F.array().cast("array<string>")
    s = sheets.withColumns({"_begins": bits.prefix(F.col("year"), F.col("month")), "_weekends": known, "_all": claims(ALL)})
    s = _owned(s.withColumns({f"_m{k}": bits.bits(trimmed(F.col(b)), begins) for k, b in enumerate(ALL)} | {"_we": bits.bits(F.col("_weekends"), begins)}))
    bad = F.transform(F.filter("_all", lambda c: ~iso(c)), lambda c: F.concat(F.lit("not a date: "), c["date"], F.lit(" ("), c["bucket"], F.lit(")")))
    # the set is computed once, not for each date
    odd = F.get(F.transform(F.array("_clash_bits"), lambda both: F.filter("_all", lambda c: iso(c) & (~bits.within(c["date"], begins) | bits.holds(both, c["date"], begins)))), F.lit(0))
    return s.withColumns({"_bad": bad, "_claims": odd}).drop("_all")


def marked_bits(sheets: DataFrame) -> DataFrame:
    """The same of sheets whose lists, of dates in order, are given as bits, with ``_far`` (k, date) for the dates of other months, null where there are none."""
    begins = F.col("_begins")
    s = sheets.withColumns({"_begins": bits.prefix(F.col("year"), F.col("month")), "_weekends": F.array().cast("array<string>"), "_we": F.lit(0)} | {f"_m{k}": F.col(b) for k, b in enumerate(ALL)})
    s, kind = _owned(s), "array<struct<k: int, i: int, bucket: string, date: string>>"
    claim = lambda k, i, b, date: F.struct(F.lit(k).alias("k"), i.cast("int").alias("i"), F.lit(b).alias("bucket"), date.alias("date"))

    def of(k: int, b: str) -> Column:
        both = F.col(f"_m{k}").bitwiseAND(F.col("_clash_bits"))
        here = F.transform(bits.numbers(both), lambda n: claim(k, n, b, F.concat(begins, F.lpad(n.cast("string"), 2, "0"))))
        far = F.transform(F.filter("_far", lambda x: x["k"] == k), lambda x, i: claim(k, i + 31, b, x["date"]))
        return F.concat(_some(both != 0, here, kind), _some(F.col("_far").isNotNull(), far, kind))

    odd = _some((F.col("_clash_bits") != 0) | F.col("_far").isNotNull(), F.concat(*(of(k, b) for k, b in enumerate(ALL))), kind)
    return s.withColumns({"_bad": F.array().cast("array<string>"), "_claims": odd}).drop("_far")


def _owned(s: DataFrame) -> DataFrame:
    """Of each list the days that are its own, the days of work that are weekends, and those that lists claim which don't go together."""
    m = [F.col(f"_m{k}") for k in range(len(ALL))]
    s = s.withColumns({f"_o{k}": bits.less(m[k], bits.union(*m[:k])) for k in range(len(ALL))})
    s = s.withColumn("_wrong_bits", F.col(f"_o{ALL.index('working_days')}").bitwiseAND(F.col("_we")))
    clash = []
    for k, b in enumerate(ALL):
        apart, beside = ([F.col(f"_o{i}") for i, a in enumerate(ALL[:k]) if _apart(a, b) and (a in DAYS and b in DAYS) == x] for x in (False, True))
        clash.append(m[k].bitwiseAND(bits.union(*apart, *(bits.less(o, F.col("_wrong_bits")) for o in beside))))
    return s.withColumns({"_clash_bits": bits.union(*clash), "_mine": bits.union(*m)})


def settled(s: DataFrame) -> DataFrame:
    """Marked sheets with clean lists as bits (``SETS``), ``uncertain_days``, ``missing_days`` and ``issues``; see ``normalise``.

    What is read one by one is looked at only in sheets that have any of it: most cost some operations on whole numbers.
    """
    y, m, nothing = F.col("year"), F.col("month"), F.array().cast("array<string>")
    begins, any_odd = F.col("_begins"), F.size("_claims") > 0
    iso = lambda c: c["date"].rlike(d.ISO)
    work, rest = ALL.index("working_days"), ALL.index("weekend_days")
    owner = lambda c: F.get(F.filter(F.col("_claims"), lambda x: x["date"] == c["date"]), F.lit(0))["bucket"]
    far = lambda c: ~bits.within(c["date"], begins)
    kept = F.filter("_claims", lambda c: far(c) & (owner(c) == c["bucket"]))
    away = F.array_sort(F.array_distinct(F.transform(kept, lambda c: F.struct(c["k"].alias("k"), c["date"].alias("date")))))
    s = s.withColumn("_away", _some(any_odd, away, FAR))
    any_away = F.size("_away") > 0
    s = s.withColumn("_wrong", _some(any_away & (F.size("_weekends") > 0), F.array_intersect("_weekends", F.transform(F.filter("_away", lambda x: x["k"] == work), lambda x: x["date"]))))
    wrong = lambda c: F.array_contains("_wrong", c["date"]) | bits.holds(F.col("_wrong_bits"), c["date"], begins)
    settled_ = lambda c: wrong(c) & c["bucket"].isin(*DAYS) & owner(c).isin(*DAYS)
    twice = F.filter("_claims", lambda c: (owner(c) != c["bucket"]) & ~compatible(owner(c), c["bucket"]) & ~settled_(c))
    say = lambda c: F.concat(F.lit("date in two categories: "), c["date"], F.lit(" in "), owner(c), F.lit(" and "), c["bucket"])
    turned = F.transform("_wrong", lambda x: F.struct(F.lit(rest).alias("k"), x.alias("date")))
    turned = F.array_sort(F.array_distinct(F.concat(F.filter("_away", lambda x: (x["k"] != work) | ~F.array_contains("_wrong", x["date"])), turned)))
    s = s.withColumns({"_twice": _some(any_odd, F.array_distinct(F.transform(twice, say))), "_away": F.when(F.size("_wrong") > 0, turned).otherwise(F.col("_away"))})
    clean = {k: F.col(f"_o{k}") for k in range(len(ALL))}
    clean |= {work: bits.less(clean[work], F.col("_wrong_bits")), rest: clean[rest].bitwiseOR(F.col("_wrong_bits"))}
    s = s.withColumns({f"_b{k}": c for k, c in clean.items()})

    # uncertain days are those that no list has; of equal dates the first reason stays
    kind = "array<struct<date: string, reason: string>>"
    any_unsure = F.size(F.coalesce("uncertain_days", F.array().cast(kind))) > 0
    unsure = F.filter(F.transform("uncertain_days", lambda u: F.struct(F.trim(u["date"]).alias("date"), F.substring(F.coalesce(u["reason"], F.lit("")), 1, 200).alias("reason"))), iso)
    claimed = lambda u: bits.holds(F.col("_mine"), u["date"], begins) | F.exists("_claims", lambda c: c["date"] == u["date"])
    of = lambda u: F.coalesce(owner(u), *(F.when(bits.holds(F.col(f"_o{k}"), u["date"], begins), F.lit(b)) for k, b in enumerate(ALL)))
    free = F.filter(unsure, lambda u: ~claimed(u))
    first = F.filter(F.transform(free, lambda u, i: F.when(~F.exists(F.slice(free, 1, i), lambda v: v["date"] == u["date"]), u)), lambda u: u.isNotNull())
    also = F.transform(F.filter(unsure, claimed), lambda u: F.concat(F.lit("date in two categories: "), u["date"], F.lit(" in "), of(u), F.lit(" and uncertain_days")))
    s = s.withColumns({"_uncertain": _some(any_unsure, F.array_sort(first), kind), "_also": _some(any_unsure, also)})

    last = d.days_in_month(y, m)
    missing = F.filter(F.transform("missing_days", lambda x: F.trim(x.cast("string")).try_cast("int")), lambda n: n.between(1, F.coalesce(last, F.lit(31))))
    missing = _some(F.size("missing_days") > 0, F.array_sort(F.array_distinct(missing)), "array<int>")
    dated = y.isNotNull() & m.isNotNull()
    beyond = lambda k: F.size(F.filter("_away", lambda x: (x["k"] == k) & ~x["date"].startswith(begins)))
    outside = [F.when(beyond(k) > 0, F.concat(beyond(k).cast("string"), F.lit(f" date(s) outside the month in {b}"))) for k, b in enumerate(ALL)]
    outside = _some(dated & (F.size("_away") > 0), F.filter(F.array(*outside), lambda x: x.isNotNull()))
    told = bits.union(*(F.col(f"_b{k}") for k in range(len(ALL))), F.when(F.size("_uncertain") > 0, bits.bits(F.transform("_uncertain", lambda u: u["date"]), begins)).otherwise(F.lit(0)))
    unaccounted = F.when(dated & (F.col("period_type") == "full_month"), bits.less(bits.whole(last), told)).otherwise(F.lit(0))
    issues = _some((F.size("_bad") > 0) | any_odd | any_unsure, F.concat("_bad", "_twice", "_also", outside))
    s = s.withColumns({"uncertain_days": F.col("_uncertain"), "missing_days": missing, "issues": issues, f"_b{len(ALL)}": unaccounted, "_far": F.when(F.size("_away") > 0, F.col("_away"))})
    ours = {"_begins", "_weekends", "_we", "_bad", "_claims", "_wrong_bits", "_clash_bits", "_mine", "_away", "_wrong", "_twice", "_uncertain", "_also"} | {f"_{x}{k}" for x in "mo" for k in range(len(ALL))}
    return s.drop(*ours)


def mismatches(sheets: DataFrame, calendars: DataFrame) -> DataFrame:
    """person, year, month and ``flags`` where timesheets say other weekends or holidays than the calendar (month, year,
    weekdays, holidays; one row a month). Only days that a sheet said something about are compared; an empty
    list of the calendar is not configured and compares nothing."""
    y, m = F.col("year"), F.col("month")
    begins = bits.prefix(y, m)
    listed = F.coalesce("weekdays", F.array().cast("array<string>"))
    marked = F.filter(d.spine(y, m), lambda x: F.array_contains(listed, F.date_format(F.to_date(x), "EEEE")))
    calendar = calendars.select(y, m, bits.bits(marked, begins).alias("we"), bits.bits(F.col("holidays"), begins).alias("ph"), F.size(F.coalesce("holidays", F.array().cast("array<string>"))).alias("named"))
    numbers = F.aggregate(F.coalesce("missing_days", F.array().cast("array<int>")), F.lit(0), lambda acc, n: acc.bitwiseOR(F.when(n.between(1, 31), bits.of_day(n)).otherwise(F.lit(0))))
    said = bits.bits(F.transform("uncertain_days", lambda u: u["date"]), begins).bitwiseOR(numbers)
    g = sheets.where("kind = 'timesheet'").groupBy("person", "year", "month").agg(*(F.bit_or(bits.bits(F.col(b), begins)).alias(b) for b in ALL), F.bit_or(said).alias("_said"))
    g = g.join(calendar, ["year", "month"])
    we, ph, work = F.col("weekend_days"), F.col("public_holiday"), F.col("working_days")
    leave = bits.union(*(F.col(b) for b in BUCKETS))
    scope = bits.union(leave, F.col("_said"), work, we)
    tests = [
        ("weekend marked as working", F.col("we") != 0, F.col("we").bitwiseAND(work)),
        ("weekend not in the calendar", F.col("we") != 0, bits.less(we, F.col("we"))),
        ("weekend not listed", F.col("we") != 0, bits.less(F.col("we").bitwiseAND(scope), bits.union(we, leave, work))),
        ("holiday not listed", F.col("named") > 0, bits.less(F.col("ph").bitwiseAND(scope), ph)),
        ("holiday not in the calendar", F.col("named") > 0, bits.less(ph, F.col("ph"))),
    ]
    shown = lambda c: F.concat(F.array_join(F.slice(bits.days(c, begins), 1, 8), ", "), F.when(F.bit_count(c) > 8, F.lit(" …")).otherwise(""))
    flags = F.filter(F.array(*(F.when(told & (c != 0), F.concat(F.lit(f"{name}: "), shown(c))) for name, told, c in tests)), lambda x: x.isNotNull())
    return g.select("person", "year", "month", flags.alias("flags"))


def folds(sheets: DataFrame) -> DataFrame:
    """person, year, month, ``overlap`` (two sheets claim the whole month) and ``fold`` (how many parts were merged; null: none)."""
    g = sheets.where("kind = 'timesheet'").groupBy("person", "year", "month").agg(F.count("*").alias("n"), F.count_if(F.col("period_type") == "full_month").alias("whole"))
    return g.select("person", "year", "month", ((F.col("n") > 1) & (F.col("whole") > 1)).alias("overlap"), F.when((F.col("n") > 1) & (F.col("whole") < 2), F.col("n")).alias("fold"))


def crossing(sheets: DataFrame) -> DataFrame:
    """person, year, month, date, buckets: dates that different sheets put in lists that don't go together.

    Days of the sheet's month are sets of bits in one row; any other date has a row of its own, as its only day. A day is of several
    sheets if one ahead by name has it too: groups hold numbers, not lists, and are read one row at a time.
    """
    begins = bits.prefix(F.col("year"), F.col("month"))
    of = lambda b: F.when(F.size(b) > 0, bits.bits(trimmed(F.col(b)), begins)).otherwise(F.lit(0))
    month = F.struct(F.lit(None).cast("string").alias("_at"), *(of(b).alias(b) for b in ALL))
    one = lambda c, k: F.when(c["k"] == k, F.lit(1)).otherwise(F.lit(0))
    others = F.filter(claims(ALL), lambda c: c["date"].rlike(d.ISO) & ~bits.within(c["date"], begins))
    others = F.transform(others, lambda c: F.struct(c["date"].alias("_at"), *(one(c, k).alias(b) for k, b in enumerate(ALL))))
    keys, claimed = ["person", "year", "month", "_at"], bits.union(*(F.col(b) for b in ALL))
    each = sheets.select("person", "year", "month", "name", F.inline(F.concat(F.array(month), others))).where(claimed != 0)
    named = each.repartition(*keys).groupBy(*keys, "name").agg(*(F.bit_or(b).alias(b) for b in ALL))
    ahead = Window.partitionBy(*keys).orderBy("name").rowsBetween(Window.unboundedPreceding, -1)
    named = named.withColumn("_own", F.when(F.col("name").isNotNull(), claimed).otherwise(F.lit(0)))
    named = named.withColumn("_shared", F.col("_own").bitwiseAND(F.coalesce(F.bit_or("_own").over(ahead), F.lit(0))))
    by = named.groupBy(*keys).agg(*(F.bit_or(b).alias(b) for b in [*ALL, "_shared"]))
    clash = bits.union(*(F.col(a).bitwiseAND(F.col(b)) for k, b in enumerate(ALL) for a in ALL[:k] if _apart(a, b)))
    by = by.withColumn("_days", F.col("_shared").bitwiseAND(clash)).where("_days <> 0")
    by = by.select(*keys, *ALL, F.explode(bits.numbers(F.col("_days"))).alias("_day"))
    buckets = F.filter(F.array(*(F.when(F.col(b).bitwiseAND(bits.of_day(F.col("_day"))) != 0, F.lit(b)) for b in sorted(ALL))), lambda x: x.isNotNull())
    date = F.coalesce("_at", F.concat(begins, F.lpad(F.col("_day").cast("string"), 2, "0")))
    return by.select("person", "year", "month", date.alias("date"), buckets.alias("buckets"))


def month_union(sheets: DataFrame, order: str) -> DataFrame:
    """One row per person and month: lists united, reasons of uncertain days by the first sheet, missing and unaccounted days,
    covered days, period types and issues in order of appearance. Days of the month are united as bits, others as lists."""
    begins = bits.prefix(F.col("year"), F.col("month"))
    far = F.concat(*(F.transform(bits.elsewhere(F.col(b), begins), lambda x: F.struct(F.lit(k).alias("k"), x.alias("date"))) for k, b in enumerate(SETS)))  # noqa: B023
    rows = sheets.withColumns({f"_b{k}": bits.bits(F.col(b), begins) for k, b in enumerate(SETS)} | {"_far": far})
    g = united(rows, order)
    return g.select("person", "year", "month", *(listed(b).alias(b) for b in SETS), *(c for c in g.columns if c not in {"person", "year", "month", "_far", *(f"_b{k}" for k in range(len(SETS)))}))


def united(rows: DataFrame, order: str) -> DataFrame:
    """``month_union`` of settled sheets, with the united lists as bits and ``_far``, for ``listed``."""
    some = lambda c: F.when(F.size(c) > 0, F.col(c)).alias(c)
    # one list of what is not bits, for all lists together: each aggregate of objects costs a group more than its few rows do
    g = rows.groupBy("person", "year", "month").agg(
        *(F.bit_or(f"_b{k}").alias(f"_b{k}") for k in range(len(SETS))), F.sum("days_covered").alias("days_covered"),
        F.collect_list(F.struct(F.col(order).alias("at"), some("uncertain_days"), some("issues"), some("missing_days"), "period_type", some("_far"))).alias("_rows"),
    )
    any_ = lambda c: F.exists("_rows", lambda x: x[c].isNotNull())
    of = lambda c: F.flatten(F.transform(F.sort_array(F.transform(F.filter("_rows", lambda x: x[c].isNotNull()), lambda x: F.struct(x["at"].alias("at"), x[c].alias("v")))), lambda x: x["v"]))
    known = lambda c: F.filter(F.transform("_rows", lambda x: x[c]), lambda x: x.isNotNull())
    kinds = dict(rows.dtypes)
    g = g.withColumns({
        "missing_days": _some(any_("missing_days"), F.array_sort(F.array_distinct(F.flatten(known("missing_days")))), kinds["missing_days"]), "_u": _some(any_("uncertain_days"), of("uncertain_days"), kinds["uncertain_days"]),
        "issues": _some(any_("issues"), F.array_distinct(of("issues"))), "period_types": F.array_sort(F.array_distinct(known("period_type"))), "_far": F.when(any_("_far"), F.flatten(known("_far"))),
    })
    first = F.filter(F.transform("_u", lambda u, i: F.when(~F.exists(F.slice(F.col("_u"), 1, i), lambda v: v["date"] == u["date"]), u)), lambda u: u.isNotNull())
    tag = F.concat(F.lit("group:"), F.substring(F.sha1(F.concat_ws("|", "person", F.coalesce("month", F.lit(0)), F.coalesce("year", F.lit(0)))), 1, 12))
    return g.withColumns({"uncertain_days": F.when(F.size("_u") > 0, F.array_sort(first)).otherwise(F.col("_u")), "tag": tag}).drop("_u", "_rows")


def identities(sheets: DataFrame, senders: DataFrame) -> DataFrame:
    """``sheets`` (thread, name, person) with ``owner`` and ``note``: the person named; in a thread of one person everything is
    theirs; in one of several, unnamed sheets are nobody's; in one of none they are the sender's (senders: thread, sender)."""
    known = sheets.groupBy("thread").agg(F.count_distinct("person").alias("_n"), F.min("person").alias("_only"))
    s = sheets.join(known, "thread").join(senders, "thread", "left")
    owner = F.coalesce("person", F.when(F.col("_n") == 1, F.col("_only")).when(F.col("_n") > 1, "unassigned").otherwise(F.coalesce("sender", F.lit("unknown"))))
    note = F.when(F.col("person").isNotNull(), "named").when(F.col("_n") == 1, "attributed").when(F.col("_n") > 1, "unassigned").when(F.col("sender").isNotNull(), "sender").otherwise("unknown")
    return s.select(*sheets.columns, owner.alias("owner"), note.alias("note"))


def sheet_summary(sheet: Column) -> Column:
    """(leave, working, weekend): how many days of each a sheet struct has; null lists count nothing."""
    n = lambda b: F.coalesce(F.size(sheet[b]), F.lit(0))
    leave = sum((n(b) for b in BUCKETS[1:]), n(BUCKETS[0]))
    return F.struct(leave.alias("leave"), n("working_days").alias("working"), n("weekend_days").alias("weekend"))


def sentence(leave: Column, working: Column) -> Column:
    """What a summary says of a record."""
    days = lambda n, w: F.concat(n.cast("string"), F.lit(" "), F.lit(w), F.when(n == 1, " day").otherwise(" days"))
    return F.concat_ws(", ", F.when(working > 0, days(working, "working")), F.when(leave > 0, days(leave, "leave")))


def gate(n_flags: Column, matched: Column, complete: Column, approved: Column, dated: Column, single: Column) -> Column:
    """accepted, reasons, blockers of the six checks that decide whether a record needs nobody's eye."""
    tests = {"no flags": n_flags == 0, "person matched": matched, "month complete": complete, "approved": approved, "period known": dated, "one sheet": single}
    pick = lambda keep: F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)) == keep, F.lit(k)) for k, c in tests.items())), lambda x: x.isNotNull())
    return F.struct((F.size(pick(False)) == 0).alias("accepted"), pick(True).alias("reasons"), pick(False).alias("blockers"))


def calendar_text(year: Column, month: Column, weekdays: list[str], holidays: Column) -> Column:
    """The month as text: how many days, the weekday of each date, weekends and holidays."""
    dated = F.transform(d.spine(year, month), lambda x: F.concat(x, F.lit(" "), F.date_format(F.to_date(x), "EEE")))
    lines = [F.concat(F.lit("days: "), d.days_in_month(year, month).cast("string")), F.array_join(dated, ", "), F.concat(F.lit("weekends: "), F.array_join(d.weekends(year, month, weekdays), ", "))]
    return F.concat_ws("\n", *lines, F.when(F.size(holidays) > 0, F.concat(F.lit("holidays: "), F.array_join(holidays, ", "))))


def focus_month(year: int, today: Column) -> Column:
    """The month that a list opens with: this one in this year, the last one of others."""
    return F.when(F.year(today) == year, F.month(today)).otherwise(12)


def valid_period(year: Column, month: Column) -> Column:
    return F.coalesce(month.between(1, 12) & year.between(2000, 2100), F.lit(False))


def first_claimant(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """keys and date with the bucket whose row came first, and ``others``: the buckets that claim it too."""
    w = Window.partitionBy(*keys, "date").orderBy(order, "bucket")
    ranked = rows.withColumn("_first", F.first("bucket").over(w)).groupBy(*keys, "date", "_first").agg(F.sort_array(F.collect_set("bucket")).alias("b"))
    return ranked.select(*keys, "date", F.col("_first").alias("bucket"), F.array_except("b", F.array("_first")).alias("others"))
