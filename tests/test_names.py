"""Names, mail texts, attachments and dates on cases that say what must come out."""

import datetime
import hashlib
import itertools
import random
import re
from difflib import SequenceMatcher

import numpy as np
from pyspark.sql import functions as F

from periodica.functions import letters as l
from periodica.functions import names as n
from periodica.functions import similarity
from periodica.functions import text as x
from periodica.operators import near, ordering, predicates, updates
from periodica.operators.stored import folder as near_folder


def subsequence(a, b):
    row = [0] * (len(b) + 1)
    for c in a:
        row = [0, *itertools.accumulate(range(len(b)), lambda last, k: max(last, row[k + 1], row[k] + (c == b[k])), initial=0)][1:]
    return row[-1]


def alike(a, b):
    return 200.0 * subsequence(a, b) / (len(a) + len(b)) if a or b else 100.0


def inside(a, b):
    short, long = sorted((a, b), key=len)
    return max((alike(short, long[max(0, k) : k + len(short)]) for k in range(1 - len(short), len(long))), default=0.0) if short else 0.0


def by_words(a, b, measure):
    """(sorted words, the best of the shared words and both sides)."""
    s, u = set(a.split()), set(b.split())
    join = lambda *sets: " ".join(w for x in sets for w in sorted(x))
    best = measure(join(s & u, s - u), join(s & u, u - s))
    if s & u:
        best = max(best, measure(join(s & u), join(s & u, s - u)), measure(join(s & u), join(s & u, u - s)))
    return measure(" ".join(sorted(a.split())), " ".join(sorted(b.split()))), best


def fits(a, b):
    """Each word of the shorter name in the longer one: equal, three letters or more of it, or an initial."""
    short, long = sorted((re.findall("[a-z0-9]+", a), re.findall("[a-z0-9]+", b)), key=len)
    same = lambda x, y: x == y or (x.startswith(y) or y.startswith(x)) and (min(len(x), len(y)) > 2 or 1 in (len(x), len(y)))
    if len(short) == 1:
        return same(short[0], long[-1])
    free = list(range(len(long)))
    for x in short:
        k = next((k for k in free if same(x, long[k])), None)
        if k is None:
            return False
        free.remove(k)
    return bool(short)


def plain_score(a, b):
    """The score of two names that agree, else None."""
    a, b = a.strip().lower(), b.strip().lower()
    if not a or not b:
        return None
    words, best = by_words(a, b, alike)
    unlike = max(len(a), len(b)) / min(len(a), len(b))
    if unlike < 1.5:
        weighted = max(alike(a, b), 0.95 * max(words, best))
    else:
        scale = 0.9 if unlike < 8 else 0.6
        weighted = max(alike(a, b), scale * inside(a, b), 0.95 * scale * max(by_words(a, b, inside)))
    if a == b or fits(a, b) or weighted >= 82 and words >= 70:
        return round(max(weighted, 93.0 if fits(a, b) else 0.0), 4)
    return None


def invented(rng, n):
    first = ["Abdul", "Sara", "Mohammed", "Mohd", "Jennifer", "Peter", "Anna", "A.", "J", "Li", "عمر", "de la"]
    last = ["Ghani", "Khan", "Hussain", "Fernandes", "Miller", "Rossi", "Almeida", "al", "O'Neil", "K.", "Khan"]
    out = ["", " ", "x" * 70 + " y", "x" * 66 + " z", "a a b", "a b", "xx xx abcdefghijklmno", "xy abcdefghijklmnp"]
    while len(out) < n:
        name = list(" ".join([rng.choice(first), *(rng.choice(last) for _ in range(rng.randrange(4)))]))
        if rng.random() < 0.6:
            name[rng.randrange(len(name))] = rng.choice(["", "a", "e", "o ", " "])
        out.append("".join(name))
    return list(dict.fromkeys(out))


def test_scores_against_plain_loops():
    known = invented(random.Random(1), 100)
    prepared, n = similarity.Names(known), len(known)
    i, j = np.divmod(np.arange(n * n), n)
    got = similarity.scores(prepared, i, j)
    for k in range(0, n * n, 7):
        want = plain_score(known[i[k]], known[j[k]])
        assert np.isnan(got[k]) if want is None else abs(got[k] - want) < 1e-4, (known[i[k]], known[j[k]], want, got[k])
    assert similarity.common(similarity.Strings.of(["kitten", "", "ab" * 100]), similarity.Strings.of(["sitting", "x", "b" * 150])).tolist() == [4, 0, 100]


def test_candidates_lose_no_pair_that_agrees(spark, monkeypatch):
    """1,300 names said against 700, with tiles of 200: all pairs that scoring every pair finds, with the same scores."""
    monkeypatch.setattr(n, "TILE", 200)
    rng = random.Random(3)
    said, roster = invented(rng, 1300), invented(rng, 700)
    names = similarity.Names(said + roster)
    i, j = np.divmod(np.arange(len(said) * len(roster)), len(roster))
    score = np.concatenate([similarity.scores(names, i[k : k + 400_000], j[k : k + 400_000] + len(said)) for k in range(0, len(i), 400_000)])
    want = {(said[i[k]], roster[j[k]], round(score[k], 4)) for k in np.flatnonzero(~np.isnan(score))}
    left, right = spark.createDataFrame([(x,) for x in said], "said string"), spark.createDataFrame([(x,) for x in roster], "name string")
    got = n.agreeing(left, right).collect()
    assert len(got) == len(set(map(tuple, got))) and {tuple(r) for r in got} == want and len(want) > 2000


def test_who_is_meant_against_a_loop(spark):
    rng = random.Random(2)
    roster = list(enumerate(invented(rng, 60) + invented(rng, 20)))
    said = [(k, x) for k, x in enumerate([*invented(rng, 60), None])]
    got = {r.asked_id: (r.match, r.n) for r in n.resolve(spark.createDataFrame(said, "asked_id int, said string"), spark.createDataFrame(roster, "id int, name string")).collect()}
    for k, s in said:
        agreeing = sorted((-score, i) for i, name in roster if s is not None and (score := plain_score(s, name)) is not None)
        match = agreeing[0][1] if agreeing and (len(agreeing) == 1 or agreeing[1][0] - agreeing[0][0] >= n.LEAD) else None
        assert got[k] == (match, len(agreeing)), s
    assert n.resolve(spark.createDataFrame(said, "asked_id int, said string"), spark.createDataFrame([], "id int, name string")).where("n > 0").count() == 0


def matched(spark, roster, cases):
    """(code, name) of each (badge, name, hint)."""
    asked = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "asked_id int, badge string, name string, hint int")
    known = {i: name for i, _, name in roster}
    got = {r.asked_id: (r.code, known.get(r.match)) for r in n.match_people(asked, spark.createDataFrame(roster, "id int, badge string, name string")).collect()}
    return [got[k] for k in range(len(cases))]


def test_every_code(spark):
    """Two people of one name, one of them with a badge that another has too."""
    ghani, ali, khan = "Abdul Syed Ghani", "Mohammed Ali", "Sara Mohammed Khan"
    roster = [(1, "MT1", ghani), (2, "MT2", ali), (3, "MT9", ghani), (4, "MT9", khan)]
    cases = {
        ("MT1", ghani, None): ("id_and_name", ghani), ("MT1", "Abdul Ghani", None): ("id_and_name", ghani), ("MT1", "A. Ghani", None): ("id_and_name", ghani), ("MT1", "Abd Ghani", None): ("id_and_name", ghani),
        ("MT2", "Mohd Ali", None): ("id_and_name", ali), ("MT1", "Abdul Ali", None): ("no_match", None), ("MT2", "Zzz Wrong", None): ("no_match", None), ("MT5", "Abdul Ghani", None): ("no_match", None),
        ("MT9", "Sara Khan", None): ("id_and_name", khan), ("MT9", "Unknown Person", None): ("ambiguous_id", None), ("MT1", None, None): ("no_match", None), (None, ali, None): ("name_primary", ali),
        ("MT404", ali, None): ("name_primary", ali), ("MT1", ali, None): ("name_primary", ali), ("MT404", ghani, None): ("no_match", None), (None, None, None): ("no_identity", None), ("", "n/a", None): ("no_identity", None),
        ("MT2", ali, 2): ("email_and_name", ali), (None, "Abdul Ghani", 3): ("email_and_name", ghani), (" mt2 ", ali, 1): ("id_and_name", ali), ("MT9", "employee", 3): ("no_match", None), (None, ghani, None): ("no_match", None),
    }
    assert matched(spark, roster, list(cases)) == list(cases.values())


def test_nobody_is_lost_by_address(spark):
    asked = spark.createDataFrame([(1, ["x@a", "y@a"]), (2, ["nobody@a"]), (3, []), (4, None)], "asked_id int, candidates array<string>")
    roster = spark.createDataFrame([(7, ["y@a"]), (5, ["y@a", "z@a"]), (6, None)], "id int, addresses array<string>")
    assert {r.asked_id: (r.match, r.address) for r in n.by_address(asked, roster).collect()} == {1: (5, "y@a"), 2: (None, None), 3: (None, None), 4: (None, None)}


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first()


def scrubbed(spark, *texts):
    return [r[0] for r in spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k int, t string").coalesce(1).select(l.scrub(F.col("t"))).collect()]


def person(address):
    return f"person-{hashlib.sha256(address.lower().encode()).hexdigest()[:6]}@redacted.invalid"


def test_scrub(spark):
    text = "Mail Me@x.org or me@X.org and Me@x.org.uk, +971 50 123 4567, tel 050 1234567, Mobile: 2024-01-05, password: hunter2, 8 hours\u200b on 2024-01-05\nFrom: Bob <bob@y.com>\nCc: x"
    got, none = scrubbed(spark, text, None)
    assert got == f"Mail {person('me@x.org')} or {person('me@x.org')} and {person('me@x.org.uk')}, [phone-redacted], tel [phone-redacted], Mobile: 2024-01-05, password: [secret-redacted], 8 hours on 2024-01-05\nFrom: [header-redacted]\nCc: [header-redacted]"
    assert none == ""


def test_scrub_cases(spark):
    cases = {
        "the password hunter2 works": "the password [secret-redacted]",
        "PIN 4321 today": "PIN [secret-redacted]",
        "VPN password: Winter99 for access": "VPN password: [secret-redacted]",
        "wifi password is Zz9; tell nobody": "wifi password is [secret-redacted]; tell nobody",
        "api_key=abc.def, then more": "api_key=[secret-redacted], then more",
        "call me on +971 50 123 4567 anytime": "call me on [phone-redacted] anytime",
        "Tel. (04) 123-4567": "Tel. [phone-redacted]",
        "T: +971 4 777 8526\u200b\nM: 050000000": "T: [phone-redacted]\nM: [phone-redacted]",
        "1-Jun-26\n8:30 AM\n5:30 PM\n9": "1-Jun-26\n8:30 AM\n5:30 PM\n9",
        "tel 05-06-2026 meeting": "tel 05-06-2026 meeting",
        "tel 04-12-3456-789": "tel [phone-redacted]",
        "From: Sylvia Noronha <sylvia@client.ae>": "From: [header-redacted]",
        "To : a@b.ae; c@d.ae\nSubject: Approved\n\nApproved. Please process.": "To: [header-redacted]\nSubject: Approved\n\nApproved. Please process.",
        "Contact Kevin Dsouza at Kevin.Dsouza@acme.com please": f"Contact Kevin Dsouza at {person('kevin.dsouza@acme.com')} please",
        "": "",
    }
    kept = "ATTENDANCE SHEET\nEmployee Name: Kevin Dsouza\nEmp No: E2507067\n01 June 26  9:00 am  6:00 pm  8\n2026-06-15  Public Holiday\n15/06/2026 annual leave, also written 15-06-2026\nTotal working hours: 168"
    assert scrubbed(spark, *cases, kept) == [*cases.values(), kept]


def test_cuts(spark):
    text = "Please find my sheet attached.\nOn Monday, 5 June 2023 Bob Smith wrote:\n> older"
    cut, quote = "\n\n[signature-redacted]", "\n\n[quoted-thread-redacted]"
    r = one(
        spark, a=l.newest_part(F.lit(text)), b=l.newest_part(F.lit("Hi\n-----Original Message-----\nold")), e=l.focus(F.lit("a\nTotal hours\nb"), "total"), f=l.focus(F.lit("a\nb"), "total"),
        g=l.newest_part(F.lit("Latest note only, please see below.\n\nFrom: Other <o@x.com>\nSent: yesterday\nPrior")), n=l.newest_part(F.lit(None).cast("string")),
    )
    assert r.a == "Please find my sheet attached." + quote and r.b.endswith("old") and (r.e, r.f) == ("Total hours\nb", "a\nb") and r.g == "Latest note only, please see below." + quote and r.n is None
    said = "The sheet is attached to this mail for you."
    closings = ["Regards", "-- ", "Best,", "With kind regards", "Sent from my iPhone", "Thanks and regards", "Thank you!", "Yours faithfully,", "____", "---", "CHEERS"]
    sheet = "ATTENDANCE SHEET\nEMP NO: E1\nEMPLOYEE SIGNATURE\nMANAGER SIGNATURE"
    texts = {f"{said}\n{c}\nAnn, +971 50 1": said + cut for c in closings} | {
        "Approved.\nThanks": "Approved.\nThanks", "Looks good to me, please go on\nBest regards\nAnn": "Looks good to me, please go on\nBest regards\nAnn", "Hello\nRegards\nA": "Hello\nRegards\nA", said: said, "": "",
        f"{sheet}\n\nSri L\nT: +971 4 777 8526": sheet + cut, f"{sheet}\n\n{'a long footer of a brand ' * 3}": sheet + cut, f"{sheet}\nSri L\n": f"{sheet}\nSri L\n",
    }
    got = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k int, t string").coalesce(1).select(l.without_signature(F.col("t"))).collect()
    assert [r[0] for r in got] == list(texts.values())


def test_attachments(spark):
    kind = "array<struct<filename: string, content_type: string, size: long, cid: string, is_inline: boolean>>"
    rows = [
        ([("May.pdf", "application/pdf", 10, None, False), ("image001.png", "image/png", 90000, None, False), ("scan.png", "image/png", 90000, "c1", False), ("real.jpg", "image/jpeg", 90000, None, False)], "<img src='cid:c1'>", 2, True),
        ([("logo.png", "image/png", 500, None, False)], None, 0, False), (None, None, 0, False), ([("x.jpg", "image/jpeg", None, None, None)], None, 1, True), ([("a.zip", "application/zip", 9, None, None)], None, 0, False),
    ]
    df = spark.createDataFrame([(a, h) for a, h, _, _ in rows], f"a {kind}, h string").coalesce(1)
    got = df.select(F.size(l.visible(F.col("a"), F.col("h"))).alias("n"), l.extractable(F.col("a"), F.col("h")).alias("x")).collect()
    assert [(r.n, r.x) for r in got] == [(n_, x) for _, _, n_, x in rows]
    k = df.select(F.transform("a", lambda x: l.kind_of(x, F.lit(True))).alias("k"), F.transform("a", lambda x: l.decorative(x, F.lit(True))).alias("d"), l.resolved_cids(F.col("h"), F.col("a")).alias("h")).collect()
    assert k[0].k == ["timesheet", "other", "approval_screenshot", "approval_screenshot"] and k[1].d == [True] and k[0].h == "<img src='file:scan.png'>"


def test_files_and_labels(spark):
    r = one(
        spark, a=l.sniffed(F.lit("x"), F.lit(b"%PDF-1.4")), b=l.sniffed(F.lit("r.csv"), F.unhex(F.lit("D0CF11E0A1B11AE1"))), c=l.sniffed(F.lit("n.eml"), F.lit(b"From: a")), d=l.sniffed(F.lit("n"), F.lit(b"zz")), e=l.sniffed(F.lit("q"), F.lit(b"PK\x03\x04 xl/workbook.xml")),
        m=l.media_type(F.lit("a.PDF"), F.lit("application/octet-stream")), k=l.media_type(F.lit("a"), F.lit("text/x")), s=l.size_label(F.lit(3 << 20)), f=l.folder_id(l.folder_label(F.lit("A/B: c"), F.lit(7))), j=l.loose_json(F.lit("no json")).cast("string"),
    )
    assert (r.a, r.b, r.c, r.d, r.e, r.m, r.k, r.s, r.f, r.j) == ("pdf", "xlsx", "eml", "unknown", "xlsx", "application/pdf", "text/x", "3.0 MB", "7", None)


def test_a_period_hint_looks_for_each_pattern_once(spark):
    d = spark.createDataFrame([("for may. 2024",), ("Sept 2024",), ("foo 2024",), ("13/2024 2024-05",), ("2024-13 5/2024",), ("7 2024",), (None,)], "h string").withColumn("p", l.period_hint(F.col("h")))
    assert [tuple(r.p) if r.p else None for r in d.collect()] == [(2024, 5), (2024, 9), None, (2024, 5), (2024, 5), None, None]
    said = d.select("p.year", "p.month")._jdf.queryExecution().optimizedPlan().toString()
    assert said.lower().count("regexp_extract") <= 12  # six groups, each for two fields at most


def test_a_tile_of_names_takes_little_and_loses_none():
    import tracemalloc

    import numpy as np

    words = ["".join(chr(97 + (k * 7 + 5 * i * i + k // 26 * i) % 26) for i in range(8)) for k in range(3000)]
    said = [f"{words[k]} {words[(k * 3 + 1) % 3000]} {words[(k * 5 + 2) % 3000]}" for k in range(2048)]
    n = similarity.Names(said + [s + "e" for s in said])
    i, j = np.arange(2048), np.arange(2048, 4096)
    tracemalloc.start()
    x, y = similarity.may_agree(n, i, j)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert set(zip(range(2048), range(2048))) <= set(zip(x.tolist(), y.tolist()))
    assert peak < 130 << 20  # five matrices of eight bytes a pair, as they were held at once, are 160 MB
    few = similarity.Names(["al b", "maria anna", "a b c", "o'neil smith"] * 5 + ["al", "anna maria", "ana mara", "smith", "x", "oneil smyth"])
    i, j = np.repeat(np.arange(20), 6), np.tile(np.arange(20, 26), 20)
    score = similarity.scores(few, i, j)
    alike = ~np.isnan(score) & (similarity.Pairs(few, i, j).sorted_words() >= similarity.TOKEN_RATIO)
    x, y = similarity.by_words(few, *(lambda p, q: (p, q + 20))(*similarity.may_agree(few, np.arange(20), np.arange(20, 26))))
    assert set(zip(i[alike].tolist(), j[alike].tolist())) <= set(zip(x.tolist(), y.tolist()))


def test_dates_and_attendance(spark):
    text = "2024-01-02 08:30 to 17:00, 3 Jan 2024 Weekend, January 4, 2024 sick, 2024-02-31 and 5/Feb/2024 9:00"
    r = one(spark, d=l.dates_in(F.lit(text)), a=l.attendance(F.lit(text)), none=l.dates_in(F.lit("none")))
    days = [x.day for x in r.d]
    assert days == ["2024-01-02", "2024-01-03", "2024-01-04", "2024-02-05"] and r.none == []
    assert all(text[x.start : x.end].strip() for x in r.d) and (r.a.present, r.a.weekend) == (["2024-01-02", "2024-02-05"], ["2024-01-03"])
    assert one(spark, j=l.loose_json(F.lit('```json\n{"a": "```"}\n```')).cast("string")).j == '{"a":"```"}'
    p = one(spark, a=l.period_hint(F.lit("for June 2026")), b=l.period_hint(F.lit("2026-06")), c=l.period_hint(F.lit("06/2026")), d=l.period_hint(F.lit("soon")), e=l.period_hint(F.lit("13/2026")))
    assert p.a == p.b == p.c and tuple(p.a) == (2026, 6) and p.d is None and p.e is None


BASE = "employee alpha worked on site from monday to friday with all hours signed by the client and sent on "


def loop_of_survivors(rows):
    """What a loop over each thread in order of arrival keeps and drops."""
    kept, by = {}, {}
    for r in sorted(rows, key=lambda r: (r["thread"], r["place"], r["key"])):
        by[r["key"]] = (r["key"], False)
        if (r["name"] or "").lower().startswith("email body"):
            continue
        number = re.search(r"emp id (\d{3,})|\((\d{3,})\)", r["name"] or "", re.I)
        r = {**r, "number": number and (number[1] or number[2]), "rank": (r["signal"], len(r["text"] or ""), r["place"], r["key"])}
        mine = kept.setdefault(r["thread"], [])
        for k, o in enumerate(mine):
            same = bool(r["digest"]) and r["digest"] == o["digest"]
            a, b = r["fingerprint"] or "", o["fingerprint"] or ""
            other = r["number"] and o["number"] and r["number"] != o["number"]
            close = not other and a and b and (a == b or min(len(a), len(b)) >= 40 and SequenceMatcher(None, a, b).ratio() >= 0.92)
            if same or close:
                best, worst = (r, o) if r["rank"] > o["rank"] else (o, r)
                by[worst["key"]] = (best["key"], same)
                mine[k] = best
                break
        else:
            mine.append(r)
    return by


def sheets_of(rng, n):
    rows, words = [], "alpha beta gamma delta annual sick remote monday tuesday hours client project kilo zulu quartz jazz 12 7 2024".split()
    bases = [" ".join(rng.choice(words) for _ in range(rng.choice((4, 12, 30, 60)))) for _ in range(12)]
    for k in range(n):
        text = list(rng.choice(bases))
        for _ in range(rng.choice((0, 0, 1, 2, 8, len(text) // 12))):
            text[rng.randrange(len(text))] = rng.choice("abcdefxyz 0189")
        text = "".join(text) + rng.choice(["", "", "\nApproved by: Ann", " signed by the line manager"])
        text = rng.choice([text] * 12 + [None, ""])
        name = rng.choice(["sheet.pdf", "sheet (12345).pdf", "Emp ID 777.pdf", "Email Body 1", None])
        rows.append({"thread": rng.choice("ab"), "key": k, "place": rng.randrange(3), "name": name, "text": text, "size": rng.randrange(9000), "digest": rng.choice([None, text and str(hash(text)), "d1"])})
    return rows


def test_survivors_against_a_loop(spark, monkeypatch):
    monkeypatch.setattr(near, "TILE", 16)
    rng, rows = random.Random(4), []
    for turn in range(3):
        rows += [{**r, "thread": f"{turn}{r['thread']}", "key": r["key"] + 1000 * turn} for r in sheets_of(rng, 150)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "thread string, key long, place long, name string, text string, size long, digest string").withColumn("fingerprint", x.fingerprint(F.col("text")))
    signal = l.signal(F.col("text"), F.col("place"), F.col("size"))
    full = [r.asDict() for r in df.withColumn("signal", signal).collect()]
    want = loop_of_survivors(full)
    got = {r.key: (r.kept_by, r.same_bytes) for r in near.survivors(df, signal).collect()}
    assert got == want and sum(k != v for k, (v, _) in want.items()) > 100
    assert near.survivors(df.limit(0), signal).count() == 0


def test_the_bound_of_grams_loses_no_near_pair():
    rng, checked, long = random.Random(9), 0, 0
    for k in range(4000):
        letters = "abcdefgh ijkl" * 9 + "qxz07"
        a = "".join(rng.choice(letters) for _ in range(rng.randrange(40, 160) if k % 4 else rng.randrange(200, 700)))
        b = list(a)
        for _ in range(rng.randrange(max(2, len(a) // 9 if len(a) < 200 else 12))):
            k = rng.randrange(len(b))
            b[k : k + rng.randrange(2)] = [rng.choice("abcdefgh xyz") for _ in range(rng.randrange(2))]
        b = "".join(b)
        if min(len(a), len(b)) >= 40 and SequenceMatcher(None, a, b).ratio() >= near.NEAR:
            g = near.grams([a, b])
            checked += 1
            long += len(b) >= 200
            assert abs(g[0] - g[1]).sum() <= near.bound(len(a), len(b), near.rare(b)) and min(len(a), len(b)) >= near.LEAST * max(len(a), len(b)) - 1e-9
    assert checked > 500 and long > 50, (checked, long)


def test_a_match_is_decided_as_the_matcher_does(monkeypatch):
    rng, said = random.Random(12), []
    for turn in range(1500):
        letters = rng.choice(["abcdefgh ijkl" * 9 + "qxz07", "ab ", "aaaaab"])
        a = "".join(rng.choice(letters) for _ in range(rng.randrange(40, 150) if turn % 3 else rng.randrange(190, 600)))
        b = list(a)
        for _ in range(rng.randrange(max(2, len(a) // 9))):
            k = rng.randrange(len(b))
            b[k : k + rng.randrange(2)] = [rng.choice("abcdefgh xyz") for _ in range(rng.randrange(2))]
        b = "".join(b)
        said.append(near.Learned(b).near(a))
        assert said[-1] == (SequenceMatcher(None, a, b).ratio() >= near.NEAR), (a, b)
    assert 300 < sum(said) < 1200


def test_long_texts_of_the_same_words_are_not_linked():
    """Five hundred counts of grams of long texts are much alike, whatever they say: all of them met in one part."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijklmnop" * 6 + "qrstuvwxyz") for _ in range(rng.randrange(2, 9))) for _ in range(900)]
    texts = [" ".join(rng.choice(words) for _ in range(1500)) for _ in range(12)]
    texts += [texts[0].replace(words[0], words[1]), texts[3][:-40]]
    sketch = [near.np.minimum(g, 65535).astype("uint16").tobytes() + near.np.uint32(near.rare(t)).tobytes() for g, t in zip(near.grams(texts), texts)]
    rows = near.pa.table({"id": list(range(len(texts))), "size": [len(t) for t in texts], "sketch": sketch, "text": texts})
    u, v = near.tile_links(rows, rows, True)
    assert {tuple(sorted(x)) for x in zip(u.tolist(), v.tolist())} == {(0, 12), (3, 13)}


def test_each_text_is_stored_once_however_many_tiles_it_meets(spark, monkeypatch):
    """Texts were shuffled once for each tile that they met. Long texts are told apart by bits of longer grams, which lose no near pair."""
    monkeypatch.setattr(near, "TILE", 8)
    folders = []
    monkeypatch.setattr(near, "folder", lambda spark, name: folders.append(near_folder(spark, name)) or folders[-1])
    rng, rows = random.Random(8), []
    words = ["".join(rng.choice("abcdefghijklmnop" * 6 + "qrstuvwxyz") for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    for _ in range(30):
        base = " ".join(rng.choice(words) for _ in range(rng.choice((8, 60, 70, 80, 450))))
        thread = rng.choice("aaab")
        for _ in range(rng.choice((1, 3, 4))):
            text = list(base)
            for _ in range(rng.randrange(1 + len(text) // 60)):
                text[rng.randrange(len(text))] = rng.choice("abcxyz 019")
            rows.append((thread, len(rows), "".join(text)))
    df = spark.createDataFrame(rows, "thread string, id long, text string").withColumn("size", F.char_length("text"))
    links = near.candidate_links(df, "thread")
    assert "CoGroup" not in links._jdf.queryExecution().executedPlan().toString()
    root = {r.id: r.root for r in near.parts(links).collect()}
    near_pairs = [(i, j) for g, i, a in rows for h, j, b in rows if g == h and i < j and SequenceMatcher(None, a, b).ratio() >= near.NEAR]
    assert len(near_pairs) > 15 and all(i in root and root[i] == root[j] for i, j in near_pairs)
    (path,) = folders
    several = spark.read.parquet(path)
    assert several.count() == several.select("id").distinct().count() > 20 and several.select("at").distinct().count() > 4


def test_parts_of_links(spark):
    links = [(5, 4), (4, 3), (3, 2), (9, 8), (7, 7), *((k, k + 1) for k in range(100, 140)), *((500, k) for k in range(501, 560))]
    got = {r.id: r.root for r in near.parts(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {5: 2, 4: 2, 3: 2, 2: 2, 9: 8, 8: 8} | dict.fromkeys(range(100, 141), 100) | dict.fromkeys(range(500, 560), 500)


def test_letter_pairs_lose_no_alike_names_and_plans_do_not_grow_with_tiles(spark):
    """The plan named every meeting of two tiles, on the driver; and a tile's names were held against all others by products."""
    rng = random.Random(2)
    vocabulary = ["".join(rng.choice("aeiourstlnm") for _ in range(rng.randint(1, 9))) for _ in range(120)] + ["".join(rng.choice("kqvxzjwbhgabcdef") for _ in range(8)) for _ in range(60)]

    def called():
        name = rng.choice([" ", "  ", " "]).join(rng.choice(vocabulary) for _ in range(rng.choice((1, 1, 2, 2, 3, 3, 4))))
        for _ in range(rng.choice((0, 0, 1, 2, 3))):
            k = rng.randrange(len(name) + 1)
            name = name[:k] + rng.choice(["", "x", "a", " "]) + name[k + rng.randrange(2) :]
        return name

    for _ in range(3):
        a = sorted({called() for _ in range(400)} | {"kqvxzjwb " * 40 + "a", "jkl " + "m" * 300})
        b = sorted({called() for _ in range(300)} | set(rng.sample(a, 60)) | {x[:-1] + "q" for x in a[::3]} | {" ".join(reversed(x.split())) for x in a[::5]})
        both, i, j = similarity.Names(a + b), np.arange(len(a)), np.arange(len(a), len(a) + len(b))
        x, y = similarity.by_words(both, np.repeat(i, len(b)), np.tile(j, len(a)))
        short = np.concatenate([similarity.Pairs(both, x[k : k + 5000], y[k : k + 5000]).short_forms() for k in range(0, len(x), 5000)])
        keep = ~np.isnan(similarity.scores(both, x, y)) & ~short & ~(both.raw.codes[x] == both.raw.codes[y]).all(1)
        alike = set(zip(x[keep].tolist(), y[keep].tolist()))
        p, q = similarity.may_be_alike(both, i, j)
        found = set(zip(i[p].tolist(), j[q].tolist()))
        assert len(found) == len(p) < len(a) * len(b) / 4 and len(alike) > 60 and not alike - found
    df = spark.createDataFrame([("ann lee", 5, 0)], "said string, kind int, tile int")
    keyed = n.keyed_pairs(df.select("said"), df.select(F.col("said").alias("name")))
    assert "Broadcast" not in keyed._jdf.queryExecution().executedPlan().toString() and keyed.count() == 1
    plans = [n._met(df, "said", {5: many, 6: many}, "a", "b")._jdf.queryExecution().analyzed().toString() for many in (3, 3000)]
    assert abs(len(plans[0]) - len(plans[1])) < 50
    assert n._met(df, "said", {4: 2, 6: 3, 9: 1}, "a", "b").count() == 5


def test_ordering(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 3, 9), (1, 5, 7), (1, 6, 8), (2, 1, 2)], "k int, s long, e long")
    assert sorted(map(tuple, ordering.spans_apart(df, "k", "s", "e").collect())) == [(1, 0, 5), (1, 5, 7), (2, 1, 2)]
    assert sorted((r.s, r.until) for r in ordering.segments(df.withColumn("n", F.lit(9)), "k", "s", "e", "n", 60).collect()) == [(0, 3), (1, 9), (3, 5), (5, 6), (6, 9)]
    w = spark.createDataFrame([("a", i, x) for i, x in enumerate((5, 8, 3, 20, 1))], "k string, i int, w int")
    assert [r.batch for r in sorted(ordering.weighted_batches(w, "k", "i", "w", 12).collect(), key=lambda r: r.i)] == [0, 1, 1, 2, 3]
    e = ordering.envelope(df, [F.asc("s")], 2, 1).collect()
    assert [(r.s, r.total, r.has_more) for r in e] == [(1, 5, True), (3, 5, True)]
    scope = spark.createDataFrame([("t/Ann/May-2024/a.pdf",), ("t/Bob/June-2023/b.pdf",), ("t/x.txt",), (None,)], "p string").coalesce(1)
    pick = lambda **k: [r[0] for r in scope.select(predicates.in_scope(F.col("p"), "t/", **k)).collect()]
    assert pick() == [True, True, True, False] and pick(year=2024) == [True, False, False, False] and pick(people=["Bob"]) == [False, True, False, False] and pick(month="Ma") == [True, False, False, False]


def test_updates(spark):
    at = F.lit(datetime.datetime(2024, 1, 1))
    kids = spark.createDataFrame([(1, "a", "ok", None), (2, None, "ok", []), (3, "b", "ok", [])], "id int, rec string, state string, events array<struct<what: string, at: timestamp>>")
    parents = spark.createDataFrame([("a",), ("b",)], "rec string")
    left, kids = updates.delete_cascade(parents, kids, parents.where("rec = 'a'"), "rec", "state", "events", at)
    assert [r.rec for r in left.collect()] == ["b"]
    assert {r.id: (r.rec, r.state, len(r.events)) for r in kids.collect()} == {1: (None, "failed", 1), 2: (None, "ok", 0), 3: ("b", "ok", 0)}
    rows = spark.createDataFrame([(1, "pending", "approve"), (2, "approved", "approve"), (3, "x", "fly"), (4, "x", None), (5, None, "verify")], "id int, s string, act string")
    got = {r.id: (r.s, r.error) for r in updates.moved(rows, "s", "act").collect()}
    assert got[1] == ("approved", None) and got[2][0] == "approved" and "can't" in got[2][1] and "unknown" in got[3][1] and got[4] == ("x", None) and got[5][1]
    m = one(spark, m=updates.remember(F.create_map(F.lit("a"), F.lit("real"), F.lit("b"), F.lit("none")), F.create_map(F.lit("a"), F.lit("none"), F.lit("b"), F.lit("x"), F.lit("c"), F.lit("none"))))
    assert m.m == {"a": "real", "b": "x", "c": "none"}
    old, new = (spark.createDataFrame([r], "k int, aco string, dco string, name string") for r in ((1, "A1", "D1", "x"), (1, "A2", None, " ")))
    c = updates.field_changes(old, new, "k", ["name"], ("aco", "dco")).first().changes
    assert [(x.field, x.old, x.new) for x in c] == [("aco", "A1", "A2"), ("dco", "D1", None)]


def test_sheet_rules(spark):
    from periodica.functions import sheets as s

    lists = {b: "array<string>" for b in s.ALL}
    schema = "id int, year int, month int, period_type string, missing_days array<string>, uncertain_days array<struct<date: string, reason: string>>, " + ", ".join(f"{k} {v}" for k, v in lists.items())
    blank = {b: None for b in s.ALL}
    rows = [
        {"id": 1, "year": 2024, "month": 6, "period_type": "full_month", "missing_days": ["31", "3", "x"], "uncertain_days": [{"date": "2024-06-05", "reason": "smudged"}, {"date": "2024-06-05", "reason": "other"}, {"date": "2024-06-01", "reason": "?"}],
         **blank, "annual": [" 2024-06-01", "2024-06-01", "6 June"], "sick": ["2024-06-01"], "remote": ["2024-06-03"], "working_days": ["2024-06-03", "2024-06-08", "2024-07-01"], "weekend_days": ["2024-06-08"]},
        {"id": 2, "year": None, "month": None, "period_type": None, "missing_days": ["31", "40"], "uncertain_days": None, **blank},
    ]
    df = spark.createDataFrame([tuple(r[c.split()[0]] for c in ["id", "year", "month", "period_type", "missing_days", "uncertain_days", *s.ALL]) for r in rows], schema)
    got = {r.id: r for r in s.normalise(df, F.array(F.lit("2024-06-08"), F.lit("2024-06-09"))).collect()}
    a = got[1]
    assert (a.annual, a.sick, a.remote, a.working_days, a.weekend_days) == (["2024-06-01"], [], ["2024-06-03"], ["2024-07-01"], ["2024-06-08"])
    assert a.missing_days == [3] and [tuple(u) for u in a.uncertain_days] == [("2024-06-05", "smudged")] and len(a.unaccounted) == 30 - 4
    assert len(a.issues) == 4 and any("6 June" in x for x in a.issues) and any("annual and sick" in x for x in a.issues) and any("uncertain" in x for x in a.issues) and any("outside" in x for x in a.issues)
    assert got[2].missing_days == [31] and got[2].unaccounted == [] and got[2].issues == []
    r = one(spark, d=s.duplicates(F.array(F.lit("a"), F.lit("b"), F.lit("a"), F.lit("a"))), g=s.gate(F.lit(0), F.lit(None).cast("boolean"), F.lit(True), F.lit(True), F.lit(True), F.lit(True)), v=s.valid_period(F.lit(None).cast("int"), F.lit(1)), f=s.focus_month(2023, F.lit(datetime.date(2024, 5, 1))), h=s.focus_month(2024, F.lit(datetime.date(2024, 5, 1))))
    assert (r.d, r.g.accepted, r.g.blockers, r.v, r.f, r.h) == (["a"], False, ["person matched"], False, 12, 5)


def test_labels_of_items(spark):
    from periodica.operators import matching as m

    items = spark.createDataFrame([(1, 1, "May sheet.pdf"), (1, 2, "june"), (2, 1, None)], "g int, place int, name string")
    labels = spark.createDataFrame([(1, "Item 2"), (1, "JUNE"), (1, "the june sheet"), (1, "zzz"), (2, "x"), (1, None)], "g int, label string")
    assert {r.label: r.item for r in m.labelled_items(labels, items, "g", "label", "name", "place").collect()} == {"Item 2": 2, "JUNE": 2, "the june sheet": 2, "zzz": None, "x": None, None: None}


def test_cid_references(spark):
    kind = "array<struct<filename: string, content_type: string, size: long, cid: string, is_inline: boolean>>"
    u = "0a1b2c3d-0a1b-0a1b-0a1b-0a1b2c3d4e5f"
    rows = [
        ("cid:image001.png@01D9", [("image001.png", None, None, None, None)], "file:image001.png"), ("cid:abc", [("x.png", None, None, "<ABC>", None)], "file:x.png"),
        (f"cid:{u}", [("y.png", None, None, None, None), (f"pic_{u.upper()}.png", None, None, None, None)], f"file:pic_{u.upper()}.png"), ("cid:zzz and cid:zzz", [("x.png", None, None, "c", None)], " and "), ("none", None, "none"),
    ]
    df = spark.createDataFrame([(h, a) for h, a, _ in rows], f"h string, a {kind}").coalesce(1)
    assert [r[0] for r in df.select(l.resolved_cids(F.col("h"), F.col("a"))).collect()][:4] == [w for _, _, w in rows][:4]
    from periodica.functions import sheets as s

    one_ = spark.createDataFrame([(["2024-01-01"], ["2024-01-02"], None)], "annual array<string>, sick array<string>, working_days array<string>")
    rest = {b: F.array().cast("array<string>") for b in s.ALL if b not in one_.columns}
    r = one_.withColumns(rest).select(s.sheet_summary(F.struct(*s.ALL)).alias("x")).first().x
    assert (r.leave, r.working, r.weekend) == (2, 0, 0)


def test_a_picture_marked_as_one_of_the_body_decorates(spark):
    """However large it is, if the mail has a document."""
    kind = "filename: string, content_type: string, size: long, cid: string, is_inline: boolean"
    rows = [("scan.jpg", "image/jpeg", 90000, None, True), ("scan.jpg", "image/jpeg", 90000, None, False), ("scan.jpg", "image/jpeg", 90000, None, None), ("scan.pdf", "application/pdf", 90000, None, True)]
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], f"k int, a struct<{kind}>").coalesce(1)
    got = df.select(l.decorative(F.col("a"), F.lit(True)), l.decorative(F.col("a"), F.lit(False))).collect()
    assert [tuple(r) for r in got] == [(True, False), (False, False), (False, False), (False, False)]


def test_words_end_at_letters_beyond_ascii(spark):
    """A closing and an approval as in the SQL: what is no ASCII letter, digit or underscore ends a word."""
    said = "A line that is long enough to stay, and more"
    cut = said + "\n\n[signature-redacted]"
    texts = {f"{said}\nBestä auf Deutsch": cut, f"{said}\nThanksé": cut, f"{said}\nBest_of": f"{said}\nBest_of", f"{said}\nBest2": f"{said}\nBest2", "Please see äapprovedä\nThanks": "Please see äapprovedä\nThanks", "Please see xapproved\nThanks": "Please see xapproved\n\n[signature-redacted]"}
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").coalesce(1)
    got = [r[0] for r in df.select(l.without_signature(F.col("t"))).collect()]
    assert got == list(texts.values())
    assert one(spark, p=x.fingerprint(F.lit("öpendingö Ann says xpending"))).p == "ann says xpending"


def test_lookups_by_priority_pair_no_rows(spark):
    """A badge that all have: the same matches as all pairs give, without them."""
    from periodica.operators import matching as m

    left = [(k, None if k % 3 == 0 else k % 7, None if k % 11 == 0 else k % 2) for k in range(60)]
    right = [(100 - k, None if k % 4 == 0 else k % 9 + 3, None if k % 5 == 0 else k % 2) for k in range(40)]
    a, b = spark.createDataFrame(left, "event int, pk int, k int"), spark.createDataFrame(right, "id int, pk int, k int")
    df = m.by_priority(a, b, "event", "id", ("pk", "pk"), ("badge", "k"), veto="pk")
    want = {}
    for e, pk, k in left:
        by_pk = [i for i, p, _ in right if pk is not None and p == pk]
        by_k = [i for i, p, q in right if k is not None and q == k and (p is None or pk is None or p == pk)]
        want[e] = (min(by_pk), "pk") if by_pk else (min(by_k), "badge") if by_k else (None, None)
    assert {r.event: (r.match, r.rule) for r in df.collect()} == want

    def rights(plan):
        found = [plan.right().nodeName()] if plan.nodeName() == "Join" else []
        return found + [x for k in range(plan.children().size()) for x in rights(plan.children().apply(k))]

    # what is joined has a row for each key
    assert set(rights(df._jdf.queryExecution().optimizedPlan())) == {"Aggregate"}
