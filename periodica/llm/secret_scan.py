"""Secret scans: assignment-aware lexing of source and configuration syntax.

Base kinds (``assign``, ``access``, ``hex``) are leftmost non-overlapping matches of fixed patterns. The lexer adds the
kind ``literal``: it walks the assignment operators of a text, parses ``name op expression`` around each (identifiers,
dotted names, quoted keys; strings in single, double or triple quotes with or without a prefix, templates, bare values, constants,
``+`` chains over lines, strings side by side in brackets, indented blocks, strings of lists and of maps, and of calls the arguments without
a name), takes elements and key-value attributes of markup, ``#define`` and name-value entries, keeps an environment of constants so that a literal reaches the names it is assigned to later, and scores every literal by the sensitivity of its target
name and by the look of the literal itself. Literals scoring ``min_score`` or more are reported where they are written.

Edge cases: null text counts as empty and has no spans; texts are scanned whole, in time linear in their length;
repeated rows are scanned one by one; an empty table gives no rows; other columns of the input are ignored by ``scan`` and kept by
``redact``.
Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

from pyspark.sql import DataFrame

from periodica.llm.common import map_rows, map_text, table

KINDS = ("assign", "access", "hex", "literal")

# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")

# Parts of names and what they say about the value.
SENSITIVE = {
    "password": 1.0, "passwords": 1.0, "secrets": 1.0, "tokens": 0.9, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "pass": 0.7, "secret": 1.0, "token": 0.9, "apikey": 1.0,
    "credential": 0.9, "credentials": 0.9, "auth": 0.6, "authorization": 0.8, "bearer": 0.8, "private": 0.6, "privatekey": 1.0,
    "accesskey": 1.0, "secretkey": 1.0, "signingkey": 0.9, "encryptionkey": 0.9, "connectionstring": 0.7, "cookie": 0.5,
}
KEY_OWNERS = {"api", "access", "private", "secret", "signing", "encryption", "auth", "account", "master", "ssh", "storage", "service"}
HARMLESS = {
    "public", "count", "counts", "length", "len", "size", "max", "min", "limit", "type", "name", "file", "path", "url", "uri", "field",
    "label", "hint", "policy", "expiry", "expires", "ttl", "id", "regex", "pattern", "format", "prompt", "reset", "example",
}
PLACEHOLDER = re.compile(r"(?i)^(x+|\*+|\.+|-+|changeme|change_me|your[_-].*|example.*|placeholder|none|null|nil|true|false|undefined|todo|test|dummy|redacted|<.*>|\$\{.*|%\(.*|\{\{.*)$")

OPERATOR = re.compile(r":=|=>|[:=]")
NAME_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_.-$")
PREFIX = re.compile(r"""[rbfuRBFU]{0,2}(?=["'`])""")
#: What a string may hold before it ends: triple-quoted ones and templates anything, others no end of a line.
BODIES = {q: re.compile(rf"(?:[^{q[0]}\\{'' if len(q) == 3 or q == '`' else chr(92) + 'n'}]|\\.|{q[0]}(?!{q[0]}{q[0]}))*+" if len(q) == 3 else rf"(?:[^{q}\\{'' if q == '`' else chr(92) + 'n'}]|\\.)*+", re.S) for q in ('"""', "'''", '"', "'", "`")}
BRACKETS = re.compile(r"""["'()\[\]{}]""")
CLOSERS = {")": "(", "]": "[", "}": "{"}
SPACE = re.compile(r"(?:[ \t]|\\\r?\n)*+")
ANY_SPACE = re.compile(r"(?:\s|\\\r?\n)*+")
BLOCK_MARK = re.compile(r"[|>][+-]?\d?[ \t]*\r?\n")
ELEMENT = re.compile(r"<([A-Za-z_][\w.:-]*)(?:\s[^<>]*)?>([^<>]+)</\1\s*>")
ATTRIBUTES = re.compile(r"""\b(?:key|name)\s*=\s*(["'])([\w.:-]+)\1\s+value\s*=\s*(["'])([^"'<>]*)\3""")
DEFINE = re.compile(r"""^[ \t]*#[ \t]*define[ \t]+(\w+)[ \t]+(?=["'])""", re.M)
ENTRY = re.compile(r"""\bname:[ \t]*["']?([A-Za-z_][\w.-]*)["']?[ \t]*\r?\n[ \t]*value:[ \t]*(?:"([^"\n]*)"|'([^'\n]*)'|([^\s"'#{]+))""")
VARIABLE = re.compile(r"[A-Z][A-Z0-9]*(_[A-Z0-9]+)*")
IDENTIFIER = re.compile(r"[A-Za-z_$][\w.$]*", re.A)
BARE = re.compile(r"[A-Za-z0-9+/_.~\-]+={0,2}")
PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


def name_score(name: str) -> float:
    """How sensitive the value of ``name`` is, from 0 to 1."""
    parts = [p.lower() for p in PARTS.findall(name)]
    whole = ["".join(parts[i : i + 2]) for i in range(len(parts) - 1)]
    score = max((SENSITIVE.get(p, 0.0) for p in parts + whole), default=0.0)
    if "key" in parts and KEY_OWNERS.intersection(parts):
        score = max(score, 0.9)
    return score * 0.3 if HARMLESS.intersection(parts) else score


def literal_score(value: str, quoted: bool) -> float:
    """How much ``value`` looks like a secret, from 0 to 1."""
    return look(len(value), Counter(value), value, quoted)


def look(n: float, counts: dict, sample: str, quoted: bool) -> float:
    """The score of a value of ``n`` characters with these counts; ``sample`` is the value, or what tells a placeholder in it."""
    if n < 6 or PLACEHOLDER.match(sample) or any(c.isspace() for c in counts):
        return 0.0
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values() if c / n)
    classes = sum(any(f(c) for c in counts) for f in (str.islower, str.isupper, str.isdigit)) + any(not c.isalnum() for c in counts)
    score = min(1.0, entropy / 3.5) * (0.6 + 0.2 * min(classes, 3))
    return score if quoted else (score if classes >= 2 and any(c.isdigit() for c in counts) else 0.0)


#: The mark of a call's argument: it must look like a secret on its own, as a bare value must.
CALLED = 2


class Constant:
    """The quoted literals of an assignment and, by reference, those of the constants that it names: never copied.

    ``sure`` and ``joined`` are the best (score, minus the assignment's number, name) of the names that it reaches: of the
    names alone, and with the look of all its literals as one.
    """

    __slots__ = ("own", "refs", "single", "whole", "sure", "joined")

    def __init__(self, own: list, refs: list[Constant]):
        self.own, self.refs, self.whole = own, refs, None
        self.single = len(own) + len(refs) == 1 and all(r.single for r in refs)
        self.sure = self.joined = (0.0, 0, "")

    def measure(self) -> tuple:
        """(characters, counts, the first 32 characters, the last one) of the literals as one; each constant is measured once."""
        waiting = [self]
        while waiting:
            if (c := waiting[-1]).whole is None and (todo := [r for r in c.refs if r.whole is None]):
                waiting += todo
                continue
            waiting.pop()
            if c.whole is None:
                n, counts, head, tail = 0, {}, "", ""
                for m, some, first, last in [*((len(x[0]), Counter(x[0]), x[0][:32], x[0][-1:]) for x in c.own), *(r.whole for r in c.refs)]:
                    n, tail = n + m, last or tail
                    head = (head + first)[:32] if len(head) < 32 else head
                    for k, v in some.items():
                        counts[k] = counts.get(k, 0) + v
                if n > 1e200:  # of constants that double themselves the shares of the characters are kept
                    n, counts = n * 1e-100, {k: v * 1e-100 for k, v in counts.items()}
                c.whole = n, counts, head, tail
        return self.whole

    def score(self) -> float:
        n, counts, head, tail = self.measure()
        # a placeholder is told by its beginning, its end and which characters it has
        return look(n, counts, head if n <= 32 else head + "".join(counts) + tail, True)


def _name_before(text: str, at: int, floor: int) -> str:
    """The name that ends before position ``at``, not reaching below ``floor``; '' if there is none."""
    j = at
    while j > floor and text[j - 1] in " \t":
        j -= 1
    if j > floor and text[j - 1] in "\"'])":
        j -= 1
        if j > floor and text[j - 1] in "\"'":
            j -= 1
    i = j
    while i > floor and text[i - 1] in NAME_CHARS:
        i -= 1
    return text[i:j].strip(".-$")


class Quotes:
    """The strings of a text. What didn't end for one quote is not read again for the next, so that any pattern takes linear time."""

    def __init__(self, text: str):
        self.text = text
        self.failed: dict[str, tuple[int, int]] = {}  # by kind of quote: between these places no string of that kind ends

    def match(self, at: int) -> tuple[int, int, int] | None:
        """(start of the value, its end, end of the string) of the string that begins at ``at``, with a prefix or without."""
        m = PREFIX.match(self.text, at)
        if not m:
            return None
        at = m.end()
        quote = self.text[at]
        for q in (quote * 3, quote) if quote != "`" else (quote,):
            if not self.text.startswith(q, at):
                continue
            first, last = self.failed.get(q, (0, -1))
            if first <= at < last:
                continue
            end = BODIES[q].match(self.text, at + len(q)).end()
            if self.text.startswith(q, end):
                return at + len(q), end, end + len(q)
            self.failed[q] = at, end
        return None


class Bracket:
    """Where a bracket closes, and the strings right inside it: those that no name is given to, and the values of its names.

    ``joined``: only white space stands between them, so that they are one string.
    """

    __slots__ = ("kind", "end", "bare", "valued", "joined", "seen")

    def __init__(self, kind: str, seen: int):
        self.kind, self.end, self.bare, self.valued, self.joined, self.seen = kind, -1, (), (), True, seen

    def add(self, valued: bool, value: str, start: int, end: int) -> None:
        if valued:
            self.valued = self.valued or []
            self.valued.append((value, start, end))
        else:
            self.bare = self.bare or []
            self.bare.append((value, start, end))


def brackets(text: str, quotes: Quotes) -> dict[int, Bracket]:
    """Every bracket that closes, by where it opens; one pass."""
    out: dict[int, Bracket] = {}
    open_: list[tuple[int, Bracket]] = []
    at = 0
    while m := BRACKETS.search(text, at):
        here, at = m.start(), m.end()
        c = m[0]
        if c in "([{":
            open_.append((here, Bracket(c, at)))
        elif c in CLOSERS:
            if open_ and open_[-1][1].kind == CLOSERS[c]:
                start, b = open_.pop()
                b.joined &= not text[b.seen : here].strip()
                b.end = at
                out[start] = b
                if open_:
                    open_[-1][1].joined = False
        elif q := quotes.match(here):
            at = q[2]
            if open_:
                b = open_[-1][1]
                k = here
                while k > b.seen and text[k - 1] in " \t\r\n":
                    k -= 1
                b.joined &= k == b.seen
                b.add(text[k - 1] in "=:>", text[q[0] : q[1]], q[0], q[1])
                b.seen = at
    return out


def _block(text: str, at: int, end: int) -> tuple[list, int]:
    """The lines of an indented block behind the mark at ``at``..``end``, those without white space in them, and where it ends."""
    line = text.rfind("\n", 0, at) + 1
    indent = len(text[line:at]) - len(text[line:at].lstrip(" -"))
    found, k = [], end
    while k < len(text):
        stop = text.find("\n", k)
        stop = len(text) if stop < 0 else stop
        own = text[k:stop].strip()
        if own and len(text[k:stop]) - len(text[k:stop].lstrip(" ")) <= indent:
            break
        if own and not any(c.isspace() for c in own):
            start = text.index(own, k)
            found.append((own, start, start + len(own), True))
        k = stop + 1
    return found, min(k, len(text))


def marked_values(text: str, quotes: Quotes) -> list[tuple]:
    """(place, name, value, start, end) of elements, of key and value attributes, of ``#define`` and of name and value entries."""
    out = []
    if "</" in text:
        out += [(m.start(), m[1], m[2], *m.span(2)) for m in ELEMENT.finditer(text)]
    if "value" in text:
        out += [(m.start(), m[2], m[4], *m.span(4)) for m in ATTRIBUTES.finditer(text)]
        out += [(m.start(), m[1], m[m.lastindex], *m.span(m.lastindex)) for m in ENTRY.finditer(text)]
    if "define" in text:
        out += [(m.start(), m[1], text[q[0] : q[1]], q[0], q[1]) for m in DEFINE.finditer(text) if (q := quotes.match(m.end()))]
    return sorted(out)


def assignments(text: str):
    """(name, [(value, start, end, quoted)], references) of every assignment, in text order; quoted: 1, of a call: 2."""
    quotes = Quotes(text)
    marked = marked_values(text, quotes)[::-1]
    inside = brackets(text, quotes) if any(c in text for c in "([{") else {}
    last = 0
    for m in OPERATOR.finditer(text):
        while marked and marked[-1][0] <= m.start():
            _, name, value, start, end = marked.pop()
            yield name.replace(":", "."), [(value, start, end, True)], []
        at, pos = m.span()
        if at < last:
            continue
        if pos < len(text) and text[pos] in "=:/" or at and text[at - 1] in "=!<>+-*/|&^%:":
            continue
        name = _name_before(text, at, last)
        if not name or not (name[0].isalpha() or name[0] == "_"):
            continue
        literals, refs, after = [], [], pos
        apart = []  # strings of a list or a map: each a value of its own
        while True:
            after = SPACE.match(text, after).end()
            if q := quotes.match(after):
                literals.append((text[q[0] : q[1]], q[0], q[1], True))
                after = q[2]
            elif not literals and (q := BLOCK_MARK.match(text, after)):
                literals, after = _block(text, at, q.end())
                break
            elif (b := inside.get(after)) and (b.bare or b.valued):
                if b.kind == "(" and b.joined:
                    literals += [(*x, True) for x in b.bare]
                elif b.kind != "(":
                    apart += [(*x, True) for x in (b.valued if b.kind == "{" else b.bare)]
                    break
                after = b.end
            elif (q := IDENTIFIER.match(text, after)) and text[q.end() : q.end() + 1] == "(" and q.end() in inside:
                # what stands in a call under a name of its own is an assignment of its own
                literals += [(*x, CALLED) for x in inside[q.end()].bare]
                after = inside[q.end()].end
                refs.append(q[0])
                break
            elif (q := IDENTIFIER.match(text, after)) and not literals and text[q.end() : q.end() + 1] not in ("+", "/", "=", "-", "~"):
                refs.append(q[0])
                literals.append((q[0], *q.span(), False))
                after = q.end()
            elif (q := IDENTIFIER.match(text, after)) and literals:
                refs.append(q[0])
                after = q.end()
            elif q := BARE.match(text, after):
                literals.append((q[0], *q.span(), False))
                after = q.end()
            else:
                break
            k = ANY_SPACE.match(text, after).end() if literals and literals[-1][3] is True else SPACE.match(text, after).end()
            if text[k : k + 1] != "+":
                break
            after = ANY_SPACE.match(text, k + 1).end()
        for x in apart:
            yield name, [x], []
        if literals or refs:
            yield name, literals, refs
            last = after if any(x[3] is True for x in literals) and not any(x[3] is CALLED for x in literals) else pos
    for _, name, value, start, end in reversed(marked):
        yield name.replace(":", "."), [(value, start, end, True)], []


def literals_of(text: str, min_score: float = 0.5) -> list[tuple[int, int, float, str]]:
    """(start, end, score, name) of the literals that reach a sensitive name, constants propagated."""
    if "=" not in text and ":" not in text and "</" not in text and "define" not in text:
        return []
    known: dict[str, Constant] = {}
    constants: list[Constant] = []
    best: dict[tuple[int, int], tuple[float, int, str]] = {}

    def offer(start, end, *found):
        if found[0] >= min_score and found > best.get((start, end), (0.0, 0, "")):
            best[start, end] = found

    for at, (name, literals, refs) in enumerate(assignments(text)):
        s = name_score(name)
        for value, start, end, q in literals:
            if s and (q is CALLED and not VARIABLE.fullmatch(value) or not q and value not in known):
                offer(start, end, s * literal_score(value, False), -at, name)
        own = [x for x in literals if x[3] is True]
        named = [c for r in refs if (c := known.get(r) or known.get(r.rsplit(".", 1)[-1]))]
        if own or named:
            # a name keeps the literals of its last assignment
            c = known[name] = known[name.rsplit(".", 1)[-1]] = Constant(own, named)
            constants.append(c)
            if s:
                c.sure = (s, -at, name)
                c.joined = (0.0, 0, "") if c.single else (s * c.score(), -at, name)
    # from the last constant to the first: what a constant reaches is reached by those that it names
    for c in reversed(constants):
        for r in c.refs:
            r.sure, r.joined = max(r.sure, c.sure), max(r.joined, c.joined)
        for value, start, end, q in c.own if c.sure[0] else ():
            offer(start, end, c.sure[0] * literal_score(value, q), *c.sure[1:])
            offer(start, end, *c.joined)
    return [(a, b, s, n) for (a, b), (s, _, n) in sorted(best.items())]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds, by start and then kind."""
    low = text.lower()
    spans = []
    if "password" in low or "passwd" in low or "secret" in low or "token" in low or "apikey" in low or "api_key" in low:
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def all_spans(text: str, min_score: float = 0.5) -> tuple[list, list, float]:
    """Base spans, all spans (base and added) and the best score of a literal."""
    base = base_spans(text)
    found = literals_of(text, min_score)
    # a literal inside a base span is known already; both are in order, so one pass is enough
    added, k, reach = [], 0, -1
    for a, b, _, _ in found:
        while k < len(base) and base[k][0] <= a:
            reach = max(reach, base[k][2])
            k += 1
        if b > reach:
            added.append((a, 3, b))
    return base, sorted(base + added), max((s for _, _, s, _ in found), default=0.0)


def show(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, n_literal long, base_sha256 string, spans string, best_score double"


def scan(docs: DataFrame, min_score: float = 0.5) -> DataFrame:
    """One row per row of ``docs`` (columns doc_id and text are read)."""

    def rows(ids, texts):
        out = {c.split()[0]: [] for c in SCHEMA.split(", ")}
        for i, t in zip(ids, texts):
            base, spans, best = all_spans(t or "", min_score)
            kinds = Counter(k for _, k, _ in spans)
            for c, v in zip(out, (i, kinds[0], kinds[1], kinds[2], kinds[3], hashlib.sha256(show(base).encode()).hexdigest(), show(spans), best)):
                out[c].append(v)
        return out

    return map_rows(docs.select("doc_id", "text"), rows, SCHEMA)


def redact(docs: DataFrame, min_score: float = 0.5, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span replaced by ``mark``; all columns stay, ``n_chars`` follows the text."""

    def clean(text):
        if text is None:
            return None
        out, last = [], 0
        for a, _, b in all_spans(text, min_score)[1]:
            if b > last:
                out += [text[last : max(a, last)], mark] if a >= last else []
                last = b
        return "".join([*out, text[last:]]) if last else text

    return map_text(docs, clean)


def op10_secret_scan(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
