"""HTML extraction by a recurrent block labeller.

A page becomes a sequence of leaf blocks: runs of text between block-level tags. Every block has a tag-path vector (tags
and class, id and role words of all its ancestors, hashed, and once more those of the nearest), a hashed-word vector and a few
figures (length, links, sentence ends). A bidirectional LSTM in numpy reads the whole sequence in both directions, so each
block is labelled in the context of the document, and the blocks labelled as the article's are joined. Pages of many blocks are
read a stretch at a time with the state carried on, so that a worker holds the vectors of ``CHUNK`` blocks and not of a page.

The labeller is trained here, on pages that ``pages_to_learn`` builds from a grammar of layouts with known labels; their
number (``N_PAGES``) and the passes over them are fixed parameters, so training takes seconds, once per driver.

Edge cases: a null or empty html, or one without the article's blocks, gives an empty text; broken tags, open comments
and open elements end with the page; whole pages are read, however long; repeated rows are extracted one by one; an empty
table gives no rows; other columns, such as a ``text`` or ``n_chars`` of the pages' own, are ignored. Text inside scripts, styles and
the like never becomes a block; a head ends at the first text or element that can't stand in it.
"""

from __future__ import annotations

import functools
import html as entities
import itertools
import random
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from periodica.llm.common import map_rows, table

# How HTML elements behave.
SILENT = frozenset("script style noscript template head title textarea select button svg math iframe object canvas audio video datalist".split())
RAW = frozenset("script style textarea title iframe".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img input".split()
)
HEAD = frozenset("base basefont bgsound head html link meta noscript script style template title".split())  # what may stand in a head
CLOSES = {
    "p": {"p"}, "li": {"p", "li"}, "dt": {"p", "dt", "dd"}, "dd": {"p", "dt", "dd"}, "tr": {"p", "td", "th", "tr"}, "td": {"p", "td", "th"},
    "th": {"p", "td", "th"}, "option": {"option"},
}
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
SCOPES = frozenset("table ul ol dl td th body html article section div aside nav footer header main form".split())

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:=\s*(?:"[^"]*"|'[^']*')|[^>])*)(?:>|\Z)""", re.S)
MARKS = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)""", re.I)
HIDDEN = re.compile(r"""\bhidden\b|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])|\Z", re.I) for name in RAW}
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
SENTENCE = re.compile(r"[.!?…][\"'”»)]*(?:\s|$)")

FAR_SIZE, NEAR_SIZE, NEAR, WORD_SIZE, FIGURES, HIDDEN_SIZE = 224, 128, 3, 64, 8, 20
PATH_SIZE = FAR_SIZE + NEAR_SIZE
CHUNK = 1 << 13  # blocks
N_PAGES, PASSES, SEED = 2400, 7, 11


class Block:
    """A leaf block: its path (the slots of its ancestors' words and of the nearest ones', as bits), text, and the text inside links."""

    __slots__ = ("path", "text", "linked", "label")

    def __init__(self, path, text, linked, label=None):
        self.path, self.text, self.linked, self.label = path, text, linked, label


def path_words(tag: str, attributes: str) -> tuple[str, ...]:
    """What an element adds to the path: its tag and the words of its class, id and role."""
    out = [f"<{tag}>"]
    if attributes:
        for m in MARKS.finditer(attributes):
            out += [p.lower() for p in PARTS.findall(m[1])]
        if HIDDEN.search(attributes):
            out.append("hidden")
    return tuple(out)


@functools.lru_cache(1 << 14)
def _bits(words: tuple[str, ...], size: int) -> int:
    return functools.reduce(lambda a, w: a | 1 << _slot(w, size), words, 0)


def blocks_of(page: str) -> list[Block]:
    """The leaf blocks of a page, in order."""
    out: list[Block] = []
    stack: list[tuple[str, int, int]] = []  # tag, bits of the whole path, bits of the element itself
    text: list[str] = []
    linked = links = silent = at = 0

    def flush():
        nonlocal linked
        if text:
            t = " ".join("".join(map(entities.unescape, text)).split())
            text.clear()
            if t:
                near = functools.reduce(lambda a, e: a | e[2], stack[-NEAR:], 0)
                out.append(Block((stack[-1][1] if stack else 0) | near << FAR_SIZE, t, min(linked, len(t))))
        linked = 0

    def pop(k):
        nonlocal links, silent
        for tag, _, _ in stack[k:]:
            links -= tag == "a"
            silent -= tag in SILENT
        del stack[k:]

    while m := TAG.search(page, at):
        a, b = m.span()
        if silent and stack[-1][0] == "head" and page[at:a].strip():
            pop(len(stack) - 1)
        if a > at and not silent:
            text.append(page[at:a])
            if links:
                linked += a - at
        at = b
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if silent and not m[1] and name not in HEAD and stack[-1][0] == "head":
            pop(len(stack) - 1)  # its end tag may be left out
        if name in INLINE and name != "a" or name == "br":
            if name == "br" and not silent:
                text.append(" ")
            continue
        if name not in INLINE:
            flush()
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    pop(k)
                    break
                if name in CLOSES and stack[k][0] in SCOPES:
                    break
            continue
        if name in VOID:
            continue
        closes = CLOSES.get(name) or ({"p"} if name in ENDS_P else ())
        for k in range(len(stack) - 1, -1, -1) if closes else ():
            if stack[k][0] in closes:
                pop(k)
            elif stack[k][0] in SCOPES:
                break
        if name == "a" and links:
            continue
        if m[3].rstrip().endswith("/") and name in ("svg", "math"):
            continue
        words = path_words(name, m[3])
        stack.append((name, (stack[-1][1] if stack else 0) | _bits(words, FAR_SIZE), _bits(words, NEAR_SIZE)))
        links += name == "a"
        silent += name in SILENT
        if name in RAW:
            at = RAW_END[name].search(page, at).start()
    if silent and stack[-1][0] == "head" and page[at:].strip():
        pop(len(stack) - 1)
    if at < len(page) and not silent:
        text.append(page[at:])
    flush()
    return out


def _slot(word: str, size: int) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % size


class _Slots(dict):
    """The slot of each word as it stands in a text; ``vectors`` bounds how many are remembered."""

    def __missing__(self, word: str) -> int:
        n = self[word] = _slot(word.strip(".,:;!?()©·|»"), WORD_SIZE)
        return n


_SLOTS = _Slots()


@functools.lru_cache(1 << 12)
def _path_vector(path: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(path.to_bytes(PATH_SIZE // 8, "little"), np.uint8), bitorder="little").astype(np.float32)


def vectors(blocks: list[Block], first: int = 0, whole: int | None = None) -> np.ndarray:
    """A row per block: tag path, hashed words, figures; ``blocks`` begin at the ``first`` of a page's ``whole`` number."""
    n = len(blocks)
    whole = n if whole is None else whole
    if len(_SLOTS) > 1 << 18:
        _SLOTS.clear()
    words = [b.text.lower().split() for b in blocks]
    sizes = np.array(list(map(len, words)))
    slots = np.fromiter(map(_SLOTS.__getitem__, itertools.chain.from_iterable(words)), np.int64, int(sizes.sum()))
    counts = np.bincount(slots + np.repeat(np.arange(n) * WORD_SIZE, sizes), minlength=n * WORD_SIZE).reshape(n, WORD_SIZE)
    figures = [
        (b.linked / len(b.text), sum(1 for _ in itertools.islice(SENTENCE.finditer(b.text), 3)) / 3, k == 0, k == whole - 1, "©" in b.text, k / whole)
        for k, b in enumerate(blocks, first)
    ]
    unit = counts / np.sqrt((counts * counts).sum(1, keepdims=True))
    return np.concatenate([np.stack([_path_vector(b.path) for b in blocks]), unit, np.log1p(sizes)[:, None] / 4, sizes[:, None] >= 15, figures], axis=1, dtype=np.float32)


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


class Labeller:
    """A bidirectional LSTM over block vectors, with one score for each block."""

    def __init__(self, rng: np.random.Generator):
        n, h = PATH_SIZE + WORD_SIZE + FIGURES, HIDDEN_SIZE
        draw = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {}
        for d in "fb":
            self.p[f"w{d}"], self.p[f"u{d}"], self.p[f"b{d}"] = draw(n, 4 * h), draw(h, 4 * h), np.zeros(4 * h, np.float32)
            self.p[f"b{d}"][h : 2 * h] = 1
        self.p["v"], self.p["s"], self.p["c"] = draw(2 * h), draw(n) * 0, np.zeros(1, np.float32)

    def _read(self, x, d, keep=None, start=None, last=None):
        """States after every step; x: (steps, pages, size). ``start``: (state, cell) to go on from; ``last`` is given those at the end."""
        h = HIDDEN_SIZE
        w, u, b = (self.p[k + d] for k in "wub")
        state = cell = np.zeros((x.shape[1], h), np.float32)
        if start:
            state, cell = start
        out = np.empty((*x.shape[:2], h), np.float32)
        for t in range(len(x)):
            g = x[t] @ w + state @ u + b
            i, f, o = (_sigmoid(g[:, k * h : k * h + h]) for k in (0, 1, 2))
            z = np.tanh(g[:, 3 * h :])
            before, cell = cell, f * cell + i * z
            tc = np.tanh(cell)
            if keep is not None:
                keep.append((i, f, o, z, before, tc, state))
            state = o * tc
            out[t] = state
        if last is not None:
            last[:] = [state, cell]
        return out

    def scores_of_long(self, blocks: list[Block], chunk: int = CHUNK) -> np.ndarray:
        """The scores of one page's blocks, read in stretches: forth, and then back."""
        h, n = HIDDEN_SIZE, len(blocks)
        out = np.full(n, self.p["c"][0], np.float32)
        stretches = [(a, min(n, a + chunk)) for a in range(0, n, chunk)]
        for d, v, way in (("f", self.p["v"][:h], 1), ("b", self.p["v"][h:], -1)):
            carried: list = []
            for a, z in stretches[::way]:
                x = vectors(blocks[a:z], a, n)
                states = self._read(x[::way, None, :], d, start=carried or None, last=carried)
                out[a:z] += (states[::way, 0] @ v) + (x @ self.p["s"] if way > 0 else 0)
        return out

    def scores(self, x: np.ndarray, lengths: np.ndarray, keep=None) -> np.ndarray:
        """Score of every block; x: (steps, pages, size), padded behind; a page's label depends on that page alone."""
        back = _reverse(x, lengths)
        kf, kb = ([], []) if keep is not None else (None, None)
        f, b = self._read(x, "f", kf), _reverse(self._read(back, "b", kb), lengths)
        if keep is not None:
            keep += [kf, kb, back, f, b]
        h = HIDDEN_SIZE
        return f @ self.p["v"][:h] + b @ self.p["v"][h:] + x @ self.p["s"] + self.p["c"]

    def _back(self, x, d, keep, ds, grads):
        """Adds the gradients of a direction, given those of its states."""
        h, u = HIDDEN_SIZE, self.p["u" + d]
        dw, du, db = (np.zeros_like(self.p[k + d]) for k in "wub")
        dstate, dcell = np.zeros_like(ds[0]), np.zeros_like(ds[0])
        for t in range(len(x) - 1, -1, -1):
            i, f, o, z, before, tc, state = keep[t]
            dstate = dstate + ds[t]
            dcell = dcell + dstate * o * (1 - tc * tc)
            g = np.concatenate([dcell * z * i * (1 - i), dcell * before * f * (1 - f), dstate * tc * o * (1 - o), dcell * i * (1 - z * z)], axis=1)
            dw += x[t].T @ g
            du += state.T @ g
            db += g.sum(0)
            dstate, dcell = g @ u.T, dcell * f
        grads |= {"w" + d: dw, "u" + d: du, "b" + d: db}

    def gradients(self, x, lengths, y, weight) -> dict:
        """Of the mean logistic loss over the blocks with weight."""
        keep: list = []
        s = self.scores(x, lengths, keep)
        kf, kb, back, f, b = keep
        d = ((_sigmoid(s) - y) * weight / weight.sum()).astype(np.float32)
        h, grads = HIDDEN_SIZE, {}
        grads["v"] = np.concatenate([np.tensordot(d, f, ([0, 1], [0, 1])), np.tensordot(d, b, ([0, 1], [0, 1]))])
        grads["s"], grads["c"] = np.tensordot(d, x, ([0, 1], [0, 1])), d.sum(keepdims=True).reshape(1)
        self._back(x, "f", kf, d[:, :, None] * self.p["v"][:h], grads)
        self._back(back, "b", kb, _reverse(d[:, :, None] * self.p["v"][h:], lengths), grads)
        return grads

    def label(self, pages: list[list[Block]], most: int = 1 << 14) -> list[np.ndarray]:
        """For each page a boolean per block: is it the article's? Pages of like length are read together."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        for k, blocks in enumerate(pages):
            if len(blocks) > CHUNK:
                out[k] = self.scores_of_long(blocks) > 0
        order = sorted((k for k in range(len(pages)) if 0 < len(pages[k]) <= CHUNK), key=lambda k: len(pages[k]))
        while order:
            some = [order.pop()]
            steps = len(pages[some[0]])
            while order and (len(some) + 1) * steps <= most:
                some.append(order.pop())
            x, lengths = _stack([vectors(pages[k]) for k in some])
            s = self.scores(x, lengths)
            for j, k in enumerate(some):
                out[k] = s[: lengths[j], j] > 0
        return out


def _stack(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(r) for r in rows])
    x = np.zeros((lengths.max(), len(rows), rows[0].shape[1]), np.float32)
    for j, r in enumerate(rows):
        x[: len(r), j] = r
    return x, lengths


def _reverse(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each page's steps the other way round, the padding left behind."""
    at = np.arange(len(x))[:, None]
    at = np.where(at < lengths, lengths - 1 - at, at)
    return np.take_along_axis(x, at.reshape(at.shape + (1,) * (x.ndim - 2)), axis=0)


def learn(pages: list[list[Block]], passes: int = PASSES, seed: int = SEED, batch: int = 24, rate: float = 0.012) -> Labeller:
    """A labeller trained on labelled pages (Adam; path words are dropped at random, so that it reads the context too)."""
    rng = np.random.default_rng(seed)
    net = Labeller(rng)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(x) for k, x in net.p.items()}
    xs, ys = [vectors(p) for p in pages], [np.array([b.label for b in p], np.float32) for p in pages]
    step, total = 0, passes * -(-len(pages) // batch)
    for _ in range(passes):
        order = rng.permutation(len(pages))
        order = np.concatenate([o[np.argsort([len(pages[k]) for k in o])] for o in np.array_split(order, max(1, len(order) // (8 * batch)))])
        for some in rng.permutation([order[k : k + batch].tolist() + [-1] * (batch - len(order[k : k + batch])) for k in range(0, len(order), batch)]):
            some = [k for k in some.tolist() if k >= 0]
            x, lengths = _stack([xs[k] for k in some])
            y, _ = _stack([ys[k][:, None] for k in some])
            x[:, :, :PATH_SIZE] *= rng.random((1, len(some), PATH_SIZE)) < 0.93
            x[:, :, PATH_SIZE : PATH_SIZE + WORD_SIZE] *= rng.random(x[:, :, PATH_SIZE : PATH_SIZE + WORD_SIZE].shape) < 0.7
            weight = (np.arange(len(x))[:, None] < lengths).astype(np.float32)
            step += 1
            for k, g in net.gradients(x, lengths, y[:, :, 0], weight).items():
                g = np.clip(g, -1, 1)
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.01 * (g * g - v[k])
                net.p[k] -= rate * (1 - 0.9 * step / total) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)
    return net


# What page templates call their parts, and what stands in them.
NAMES = {
    "nav": "nav navbar navigation menu main-menu topnav breadcrumb breadcrumbs toc links pagination pager skip-links nav-list tabs",
    "header": "header site-header masthead top-bar banner-top branding logo page-header",
    "footer": "footer site-footer page-footer colophon bottom copyright legal foot",
    "aside": "sidebar side-bar aside widget related related-posts recommended popular trending more-stories rail author-box newsletter tags share social",
    "notice": "cookie cookie-notice cookie-banner consent gdpr notice alert announcement banner popup modal overlay paywall promo-bar subscribe-banner warning message",
    "ad": "ad ads advert advertisement advertising sponsored sponsor promo promoted ad-slot ad-container adsbox banner-ad dfp",
    "form": "form search search-box login signup newsletter-form contact-form subscribe-form comment-form",
    "comments": "comments comment comment-list comment-body responses replies discussion disqus user-comments reader-comments feedback reply",
    "article": "article post entry content article-body post-content entry-content main-content story story-body text body-text news-article blog-post page-content",
}
NAMES = {k: v.split() for k, v in NAMES.items()}
NEUTRAL = "container wrapper row col inner block box section group page site layout grid clearfix module left right center item panel card dark light wide".split()
PHRASES = {
    "nav": ["Home", "About", "Contact", "News", "Next page", "Previous", "Categories", "Archive", "Login", "Skip to content", "Inicio", "Accueil", "Startseite", "Kontakt"],
    "header": ["The Daily", "Welcome to", "Your source for", "Search", "Sign in", "Menu"],
    "footer": ["© 2024", "© example.com ·", "All rights reserved.", "Copyright", "Privacy policy", "Terms of use", "Impressum", "Powered by", "Alle Rechte vorbehalten", "Tous droits réservés"],
    "aside": ["Related articles", "Read more", "Most popular", "About the author", "Share this", "Follow us", "Tags:", "You may also like", "Recommended for you"],
    "notice": ["We use cookies to improve your experience.", "Accept all", "This site uses cookies.", "Please enable JavaScript.", "Subscribe to continue reading.", "Breaking:", "Notice:"],
    "ad": ["Advertisement", "Sponsored", "Buy now", "Special offer", "Ad", "Anzeige", "Publicité", "Click here", "Limited time"],
    "form": ["Enter your email", "Sign up", "Your name", "Submit", "Search", "Password", "Send message", "Leave a reply"],
    "comments": ["Comments", "Reply", "says:", "3 responses", "Posted by", "Great post!", "I disagree.", "Thanks for sharing", "Leave a comment"],
}
SYLLABLES = "the an re in ti er ou st ing ed on or ly le que de eau ment tion é ais un ver sch keit ein ung lich ö ä be ich ge que ción ado os la el ño as mi ka lo ra su ne da wi po".split()


class _Writer:
    """Builds a page and, beside it, the label of every text that it writes."""

    def __init__(self, r: random.Random):
        self.r, self.out = r, []

    def word(self):
        return "".join(self.r.choice(SYLLABLES) for _ in range(self.r.choice((1, 1, 2, 2, 3))))

    def sentence(self, low=2, high=18):
        w = [self.word() for _ in range(self.r.randint(low, high))]
        mark = self.r.choice((".", ".", ".", "!", "?"))
        return " ".join(w).capitalize() + mark

    def prose(self, low=1, high=7):
        return " ".join(self.sentence() for _ in range(self.r.randint(low, high)))

    def story(self):
        """Text of an article: prose mostly, but anything may stand in it."""
        r = self.r
        x = r.random()
        if x < 0.68:
            return self.prose()
        if x < 0.76:
            return r.choice((" | ", " · ", " » ", ", ")).join(self.word() for _ in range(r.randint(2, 40)))
        if x < 0.82:
            return " ".join(self.word() + r.choice(("###", "***", "$$$", "&amp;&amp;", "%")) for _ in range(r.randint(2, 40)))
        if x < 0.90:
            said = r.choice(PHRASES[r.choice(list(PHRASES))])
            return r.choice((said, f"{said} {self.prose(1, 3)}", f"{self.prose(1, 3)} {said}"))
        if x < 0.95:
            return " ".join([self.word()] * r.randint(1, 30)) + " " + self.prose(1, 2)
        return self.word() if x < 0.98 else self.prose(20, 60)

    def name(self, kind):
        r = self.r
        if r.random() < 0.12:
            return ""
        names = [r.choice(NAMES[kind])] + ([r.choice(NEUTRAL)] if r.random() < 0.4 else [])
        return f' {r.choice(("class", "class", "id"))}="{" ".join(names)}"'

    def neutral(self):
        return f' class="{self.r.choice(NEUTRAL)}"' if self.r.random() < 0.6 else ""

    def put(self, text, main):
        self.out.append(f"{'M' if main else 'N'}\x00{text}\x01" if text.strip() else text)

    def tag(self, markup):
        self.out.append(markup)

    def short(self, kind):
        r = self.r
        x = r.random()
        if x < 0.35:
            return r.choice(PHRASES[kind])
        if x < 0.5:
            return r.choice(PHRASES[kind]) + " " + self.prose(1, 2)
        return self.prose(1, 3) if x < 0.85 else " ".join(self.word() for _ in range(r.randint(1, 6)))

    def links(self, kind):
        r = self.r
        lists = r.random() < 0.7
        if lists:
            self.tag("<ul" + (self.neutral() if r.random() < 0.3 else "") + ">")
        for _ in range(r.randint(2, 9)):
            w = r.choice(PHRASES["nav"]) if r.random() < 0.3 else " ".join(self.word() for _ in range(r.randint(1, 3)))
            self.tag("<li>" if lists else "")
            self.tag(f'<a href="/{r.randint(1, 99)}">')
            self.put(w, False)
            self.tag("</a>" + ("</li>" if lists else r.choice((" ", " | ", " · "))))
        if lists:
            self.tag("</ul>")

    def part(self, kind):
        """A part of the page that is not the article's text."""
        r = self.r
        tag = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}.get(kind, "div")
        if kind != "form" and (r.random() < 0.35 or tag == "div"):
            tag = r.choice(("div", "div", "section"))
        name = self.name(kind)
        if tag in ("div", "section") and not name:
            name = f' class="{r.choice(NAMES[kind])}"'
        self.tag(f"<{tag}{name}>")
        if r.random() < 0.3:
            self.tag(f"<div{self.neutral()}>")
        for _ in range(r.randint(1, 2)):
            x = r.random()
            if kind == "nav" or kind in ("header", "footer", "aside") and x < 0.35:
                self.links(kind)
            elif kind == "comments":
                if r.random() < 0.5:
                    self.tag("<h3>")
                    self.put(r.choice(PHRASES["comments"]), False)
                    self.tag("</h3>")
                if listed := r.random() < 0.4:
                    self.tag(f'<ol class="{r.choice(("commentlist", "comment-list", "comments-list", "replies"))}">')
                for _ in range(r.randint(1, 5)):
                    inner = "li" if listed else r.choice(("div", "li", "article", "section"))
                    self.tag(f"<{inner}{self.name('comments')}>")
                    if r.random() < 0.5:
                        self.tag("<span>" if r.random() < 0.5 else "<div>")
                        self.put(self.word() + " says:", False)
                        self.tag("")
                    self.tag("<p>")
                    self.put(self.prose(1, 5), False)
                    self.tag(f"</p></{inner}>")
                self.tag("</ol>" if listed else "")
            elif kind == "form":
                for _ in range(r.randint(1, 3)):
                    self.tag(r.choice(("<label>", "<p>", "<div>", "<fieldset>")))
                    self.put(self.short("form"), False)
                    self.tag('<input name="q">')
                self.tag("<button>go</button>")
            else:
                inner = r.choice(("", "", "p", "p", "div", "span", "h3", "small"))
                self.tag(f"<{inner}>" if inner else "")
                self.put(self.short(kind), False)
                self.tag(f"</{inner}>" if inner else "")
        self.tag(f"</{tag}>")

    def paragraph(self):
        r = self.r
        x = r.random()
        if x < 0.68:
            self.tag("<p" + (self.neutral() if r.random() < 0.1 else "") + ">")
            if r.random() < 0.15:
                self.tag("<b>")
            self.put(self.story(), True)
            self.tag(r.choice(("</p>", "</p>", "</p>", "<br>", "</b></p>", "")))
        elif x < 0.78:
            self.tag(h := f"<h{r.randint(2, 4)}>")
            self.put(self.sentence(1, 7).rstrip(".") if r.random() < 0.7 else self.sentence(1, 7), True)
            self.tag(h.replace("<", "</"))
        elif x < 0.86:
            self.tag(t := r.choice(("<ul>", "<ol>")))
            for _ in range(r.randint(2, 5)):
                self.tag("<li>")
                self.put(self.sentence(1, 12), True)
                self.tag("</li>" if r.random() < 0.8 else "")
            self.tag(t.replace("<", "</"))
        elif x < 0.92:
            self.tag(t := r.choice(("<blockquote>", "<pre>", "<figcaption>")))
            self.put(self.prose(1, 3), True)
            self.tag(t.replace("<", "</"))
        elif x < 0.96:
            self.tag("<table>")
            for _ in range(r.randint(1, 3)):
                self.tag("<tr>")
                for _ in range(2):
                    self.tag("<td>")
                    self.put(self.sentence(1, 4), True)
                    self.tag("</td>")
                self.tag("</tr>")
            self.tag("</table>")
        else:
            self.put(self.story(), True)

    def article(self):
        r = self.r
        tag = r.choice(("article", "article", "article", "main", "div", "section"))
        name = self.name("article") if tag in ("div", "section") or r.random() < 0.3 else ""
        if tag in ("div", "section") and not name:
            name = f' class="{r.choice(NAMES["article"])}"'
        self.tag(f"<{tag}{name}>")
        if inner := r.random() < 0.25:
            self.tag(f"<div{self.name('article') if r.random() < 0.5 else self.neutral()}>")
        if r.random() < 0.85:
            self.tag("<header>" if (head := r.random() < 0.12) else "")
            self.tag(h := r.choice(("<h1>", "<h1>", "<h1>", "<h2>")))
            self.put(self.sentence(2, 14).rstrip("."), True)
            self.tag(h.replace("<", "</") + ("</header>" if head else ""))
        many = r.choice((1, 2, 3, 5, 8, 14))
        for k in range(many):
            self.paragraph()
            if r.random() < 0.08 and k < many - 1:
                self.part(r.choice(("ad", "aside", "notice", "form")))
        self.tag("</div>" if inner else "")
        if r.random() < 0.1:
            self.part(r.choice(("aside", "comments", "ad")))
        self.tag(f"</{tag}>")

    def heading(self, tag=None):
        tag = tag or self.r.choice(("h1", "h1", "h2"))
        self.tag(f"<{tag}{self.name('article') if self.r.random() < 0.2 else ''}>")
        self.put(self.sentence(2, 10).rstrip("."), True)
        self.tag(f"</{tag}>")

    def body(self, low=1, high=9):
        for _ in range(self.r.randint(low, high)):
            self.paragraph()

    def small(self, kind, tag="p"):
        """A line that is not the article's."""
        self.tag(f"<{tag}>")
        self.put(self.r.choice(PHRASES[kind]) + (" " + self.prose(1, 1) if self.r.random() < 0.3 else ""), False)
        self.tag(f"</{tag}>")

    def of_tables(self):
        """Cells for the masthead, the menu, the text and the last line, as pages were once built."""
        r = self.r
        self.tag('<table width="100%"><tr><td colspan=2>')
        self.put(" ".join((r.choice(PHRASES["header"]), self.word())).title(), False)
        self.tag(f'</td></tr><tr><td{r.choice(("", " width=150", " class=menu"))}>')
        if r.random() < 0.5:
            self.links("nav")
        else:
            for _ in range(r.randint(2, 7)):
                self.tag(f'<a href="/{r.randint(1, 99)}">')
                self.put(r.choice((r.choice(PHRASES["nav"]), self.word())), False)
                self.tag(f"</a>{r.choice(('<br>', ' ', ' | '))}")
        self.tag("</td><td>")
        if r.random() < 0.8:
            self.heading()
        self.body()
        self.tag("</td>")
        if r.random() < 0.3:
            self.tag("<td>")
            self.links("aside")
            self.tag("</td>")
        self.tag("</tr><tr><td colspan=2>")
        self.put(r.choice(PHRASES["footer"]) + (f" {self.word()}" if r.random() < 0.5 else ""), False)
        self.tag("</td></tr></table>")

    def bare(self):
        """Text that stands in the body, with breaks, rules and paragraphs for all layout."""
        r = self.r
        if r.random() < 0.5:
            self.links("nav")
        if r.random() < 0.7:
            self.heading()
        for k in range(r.randint(1, 7)):
            if r.random() < 0.5:
                self.put(self.prose(1, 5), True)
                self.tag(r.choice(("<br><br>", "<p>", "<hr>", "<br/><br/>\n")))
            else:
                self.paragraph()
        if r.random() < 0.6:
            self.tag("<hr>")
            self.small("footer", r.choice(("p", "small", "address", "div")))

    def questions(self):
        """A question under its title, and answers to it; votes, names and remarks beside them."""
        r = self.r
        if r.random() < 0.6:
            self.part("notice")
        self.part(r.choice(("nav", "header")))
        self.tag('<div id="question-header">' if r.random() < 0.6 else "<div>")
        self.heading("h1")
        self.tag("</div>")
        for k in range(r.randint(2, 5)):
            box = "question" if k == 0 else "answer"
            self.tag(f'<div class="{box}">')
            if r.random() < 0.7:
                self.tag('<div class="vote">')
                self.put(str(r.randint(0, 300)), False)
                self.tag("</div>")
            self.tag(f'<div class="{r.choice(("post-text", "body", "text", "post-body", "prose"))}">')
            self.body(1, 3)
            self.tag(f'</div><div class="{r.choice(("user-info", "meta", "signature", "byline"))}">')
            self.put(f"{r.choice(('asked', 'answered', 'edited'))} {r.randint(1, 30)} {r.choice(('days ago', 'Jan', 'hours ago'))} {self.word()}", False)
            self.tag("</div>")
            if r.random() < 0.5:
                self.part("comments")
            self.tag("</div>")
        self.part(r.choice(("aside", "footer", "nav")))

    def manual(self):
        """A page of documentation: a tree of links, the text with notes and code, links to the next page."""
        r = self.r
        self.tag('<div class="document">' if r.random() < 0.5 else "<div>")
        if r.random() < 0.8:
            self.part("nav")
        self.tag(r.choice(('<div class="body" role="main">', '<main class="content">', '<div class="section" id="intro">', "<main>", '<div class="markdown-body">')))
        self.heading("h1")
        for k in range(r.randint(2, 9)):
            if r.random() < 0.35:
                kind = r.choice(("note", "warning", "tip", "important", "admonition"))
                self.tag(f'<div class="{r.choice(("admonition ", "", "callout "))}{kind}">')
                if r.random() < 0.7:
                    self.tag(f'<p class="{r.choice(("admonition-title", "title", "label"))}">')
                    self.put(kind.capitalize(), True)
                    self.tag("</p>")
                self.tag("<p>")
                self.put(self.prose(1, 2), True)
                self.tag("</p></div>")
            self.paragraph()
        self.tag("</main>" if r.random() < 0.5 else "</div>")
        if r.random() < 0.6:
            self.links("nav")
        self.part("footer")
        self.tag("</div>")

    def journal(self):
        """Divisions for all: a title, a line of date and name, the text, and what is beside it."""
        r = self.r
        self.tag(f'<div id="{r.choice(("page", "wrapper", "main", "container"))}">')
        for kind, p in (("header", 0.7), ("nav", 0.7), ("aside", 0.3)):
            if r.random() < p:
                self.part(kind)
        self.tag(f'<div class="{r.choice(("post", "entry", "hentry", "blog-post", "story", "single"))}">')
        title = r.choice(("title", "post-title", "entry-title", "headline", "post-header"))
        self.tag(f'<div class="{title}">')
        self.put(self.sentence(2, 10).rstrip("."), True)
        self.tag("</div>")
        if r.random() < 0.7:
            self.tag(f'<div class="{r.choice(("meta", "byline", "date", "post-meta", "info"))}">')
            self.put(f"{r.choice(('Posted by', 'By', 'Published'))} {self.word().title()} {r.choice(('on', '·', '|'))} {r.randint(1, 30)}.{r.randint(1, 12)}.{r.randint(1999, 2030)}", False)
            self.tag("</div>")
        self.tag(f'<div class="{r.choice(("body", "post-body", "text", "entry", "content", "copy"))}">')
        for _ in range(r.randint(1, 8)):
            if r.random() < 0.3:
                self.tag("<div>")
                self.put(self.prose(1, 5), True)
                self.tag("</div>")
            else:
                self.paragraph()
        self.tag("</div></div>")
        for kind, p in (("comments", 0.6), ("form", 0.3), ("aside", 0.5), ("footer", 0.8)):
            if r.random() < p:
                self.part(kind)
        self.tag("</div>")

    def page(self) -> str:
        r = self.r
        if r.random() < 0.5:
            self.tag(r.choice(("<!DOCTYPE html>", "")) + "<html><head><title>x</title></head><body>")
            r.choice((self.of_tables, self.bare, self.questions, self.manual, self.journal))()
            return "".join(self.out) + ("</body></html>" if r.random() < 0.9 else "")
        self.tag("<!DOCTYPE html><html><head><title>x</title><style>p{}</style></head><body>")
        outer = r.random() < 0.4
        if outer:
            self.tag(f"<div{self.neutral()}>")
        for kind, p in (("notice", 0.25), ("header", 0.4), ("nav", 0.85), ("form", 0.15), ("ad", 0.5), ("notice", 0.1), ("aside", 0.2)):
            if r.random() < p:
                self.part(kind)
        if r.random() < 0.97:
            if around := r.random() < 0.3:
                self.tag(r.choice(("<main>", '<div class="content">', f"<div{self.neutral()}>")))
            self.article()
            self.tag("</div>" if around else "")
        for kind, p in (("ad", 0.2), ("comments", 0.35), ("form", 0.2), ("aside", 0.35), ("nav", 0.15), ("ad", 0.1), ("footer", 0.85), ("notice", 0.15)):
            if r.random() < p:
                self.part(kind)
        return "".join(self.out) + ("</div>" if outer else "") + ("</body></html>" if r.random() < 0.9 else "")


_NAMED = re.compile(r' (?:class|id)="([^"]*)"')
_SPOKEN = re.compile(r"<(/?)(?:article|main|section|nav|header|footer|aside)(?=[\s>])")


def renamed(page: str, r: random.Random) -> str:
    """A marked page as it would be without telling names: some lose them, or get those of a style compiler; some have ``div`` for all."""
    way = r.random()
    if way < 0.1:
        page = _NAMED.sub("", page)
    elif way < 0.2:
        salt = str(r.random())
        page = _NAMED.sub(lambda m: f' class="{" ".join(f"css-{zlib.crc32((salt + w).encode()):x}"[:10] for w in m[1].split())}"', page)
    if r.random() < 0.15:
        page = _SPOKEN.sub(r"<\1div", page)
    if r.random() < 0.1 and len(re.findall(r"<p[ >]", page)) == page.count("</p>"):
        page = re.sub(r"<(/?)p(?=[ >])", r"<\1div", page)
    return page


def pages_to_learn(n: int, seed: int) -> list[tuple[str, list[Block]]]:
    """(html, labelled blocks) of ``n`` pages from the grammar of layouts."""
    r = random.Random(seed)
    out = []
    while len(out) < n:
        marked = renamed(_Writer(r).page(), r)
        blocks = blocks_of(marked)
        for b in blocks:
            b.label = "M\x00" in b.text
            b.text = re.sub("[MN]\x00|\x01", "", b.text).strip()
            b.linked = min(b.linked, len(b.text))
        blocks = [b for b in blocks if b.text]
        if blocks:
            out.append((re.sub("[MN]\x00|\x01", "", marked), blocks))
    return out


@functools.lru_cache(1)
def labeller(n_pages: int = N_PAGES, seed: int = SEED) -> Labeller:
    """The trained labeller; the same for the same parameters."""
    return learn([b for _, b in pages_to_learn(n_pages, seed)])


def main_texts(pages: list[str], net: Labeller) -> list[str]:
    found = [blocks_of(p) for p in pages]
    return ["\n".join(b.text for b, own in zip(bs, labels) if own) for bs, labels in zip(found, net.label(found))]


def extract(pages: DataFrame, net: Labeller | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages``."""
    known = pages.sparkSession.sparkContext.broadcast((net or labeller()).p)

    def rows(ids, texts):
        own = Labeller.__new__(Labeller)
        own.p = known.value
        found = main_texts([t or "" for t in texts], own)
        return {"key": ids, "text": found, "n_chars": list(map(len, found))}

    keyed = pages.select(F.struct(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).alias("key"), F.col("html").cast("string").alias("html"))
    return map_rows(keyed, rows, "key struct<page_id: bigint, url: string>, text string, n_chars long", 2 << 20).select("key.*", "text", "n_chars")


def op2_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
