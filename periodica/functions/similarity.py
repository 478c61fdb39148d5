"""Similarity of many pairs of names at once: numpy columns, no loop over pairs.

A name is prepared once: its characters, those of its sorted words, and its words. The longest common subsequence of a column of pairs
is found by bit vectors, 64 characters a word: every step takes one character of all pairs.
"""

from __future__ import annotations

import re

import numpy as np

# The thresholds of agreement, and what a short form of a name scores at least.
RATIO, TOKEN_RATIO, SUBSET = 82, 70, 93.0
#: Pairs that are read at once, and bytes of their bit masks at most.
PAIRS, MASK_BYTES = 1 << 14, 64 << 20

_WORD = re.compile(r"[a-z0-9]+")


class Strings:
    """A column of strings as a matrix of codes, padded with 0, and their lengths."""

    def __init__(self, codes: np.ndarray, sizes: np.ndarray):
        self.codes, self.sizes = codes, sizes

    @classmethod
    def of(cls, texts: list[str]) -> Strings:
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        width = max(1, int(sizes.max(initial=0)))
        codes = np.array(texts, dtype=f"U{width}").view(np.uint32).reshape(len(texts), width).astype(np.int64) if texts else np.zeros((0, width), np.int64)
        # a character of code 0 is told from the padding
        return cls(np.where(np.arange(width) < sizes[:, None], codes + 1, 0), sizes)

    def __getitem__(self, rows) -> Strings:
        sizes = self.sizes[rows]
        return Strings(self.codes[rows, : max(1, int(sizes.max(initial=0)))], sizes)


def common(a: Strings, b: Strings) -> np.ndarray:
    """The length of the longest common subsequence of each pair."""
    n = len(a.sizes)
    if not n:
        return np.zeros(0, np.int64)
    known, at = np.unique(np.concatenate([[0], a.codes.ravel(), b.codes.ravel()]), return_inverse=True)
    at = at[1:]
    x, y = at[: a.codes.size].reshape(a.codes.shape), at[a.codes.size :].reshape(b.codes.shape)
    words = -(-x.shape[1] // 64)
    step = max(1, MASK_BYTES // (8 * len(known) * words))
    return np.concatenate([_common(x[k : k + step], y[k : k + step], len(known), words) for k in range(0, n, step)])


def _common(x: np.ndarray, y: np.ndarray, n_codes: int, words: int) -> np.ndarray:
    n = len(x)
    row = np.arange(n)
    masks = np.zeros((n, n_codes, words), np.uint64)
    for i in range(x.shape[1]):
        masks[row, x[:, i], i >> 6] |= np.uint64(1 << (i & 63))
    masks[:, 0] = 0
    state = np.full((n, words), ~np.uint64(0))
    for j in range(y.shape[1]):
        hit = state & masks[row, y[:, j]]
        carry = np.zeros(n, np.uint64)
        for w in range(words):
            s, h = state[:, w], hit[:, w]
            up = s + h
            over = up < s
            both = up + carry
            carry = (over | (both < up)).astype(np.uint64)
            state[:, w] = both | (s - h)
    return np.bitwise_count(~state).sum(1).astype(np.int64)


def ratio(a: Strings, b: Strings) -> np.ndarray:
    """100 x twice the longest common subsequence over both lengths; 100 for two empty strings."""
    both = a.sizes + b.sizes
    return np.where(both == 0, 100.0, 200.0 * common(a, b) / np.maximum(both, 1))


def partial(a: Strings, b: Strings) -> np.ndarray:
    """The best ratio of the shorter string of each pair with a part of the longer one, of that length at most; 0 if it is empty."""
    n = len(a.sizes)
    width = max(a.codes.shape[1], b.codes.shape[1])
    wide = lambda s: np.pad(s.codes, ((0, 0), (0, width - s.codes.shape[1])))
    swap = a.sizes > b.sizes
    short, long = np.where(swap[:, None], wide(b), wide(a)), np.where(swap[:, None], wide(a), wide(b))
    ns, nl = np.minimum(a.sizes, b.sizes), np.maximum(a.sizes, b.sizes)
    out = np.zeros(n)
    some = np.flatnonzero(ns)
    counts = (ns + nl - 1)[some]
    ends = np.cumsum(counts)
    for first in range(0, len(some), 256):  # some forty windows a pair
        last = min(len(some), first + 256)
        rows = np.repeat(some[first:last], counts[first:last])
        k = np.arange(len(rows)) - np.repeat(ends[first:last] - counts[first:last] - (ends[first] - counts[first]), counts[first:last]) - ns[rows] + 1
        begin, end = np.maximum(k, 0), np.minimum(k + ns[rows], nl[rows])
        size = end - begin
        at = begin[:, None] + np.arange(int(size.max()))
        window = np.where(at < end[:, None], long[rows[:, None], np.minimum(at, width - 1)], 0)
        found = ratio(Strings(short[rows], ns[rows])[:], Strings(window, size))
        out[some[first:last]] = np.maximum.reduceat(found, np.concatenate([[0], np.cumsum(counts[first:last])[:-1]]))
    return out


class Names:
    """Distinct names, each prepared once: ``raw``, words ``sorted``, ``unique`` words, and ids of the words in order."""

    def __init__(self, names: list[str]):
        raw = [x.strip().lower() for x in names]
        split = [sorted(x.split()) for x in raw]
        once = [sorted(set(x)) for x in split]
        self.raw, self.sorted = Strings.of(raw), Strings.of([" ".join(x) for x in split])
        self.unique = Strings.of(["".join(w + " " for w in x) for x in once])  # each word with a space behind
        self.words, self.word_sizes, _ = _ids(once)
        # of every character of ``unique`` the place of its word
        space = self.unique.codes == ord(" ") + 1
        self.word_at = np.cumsum(space, 1) - space
        self.parts, self.part_sizes, self.part_texts = _ids([_WORD.findall(x) for x in raw])


def _ids(lists: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words as a matrix padded with 0, their lengths, and the words."""
    width = max(1, max(map(len, lists), default=0))
    texts = np.array([x + [""] * (width - len(x)) for x in lists], dtype=object).reshape(len(lists), width)
    known = {w: k for k, w in enumerate(dict.fromkeys(["", *(w for x in lists for w in x)]))}
    ids = np.array([[known[w] for w in x] for x in texts.tolist()], np.int64).reshape(texts.shape)
    sizes = np.array([[len(w) for w in x] for x in texts.tolist()], np.int64).reshape(texts.shape)
    return ids, sizes, texts


def _without(names: Names, rows: np.ndarray, shared: np.ndarray) -> Strings:
    """The unique words of ``rows`` joined by spaces, without those that are ``shared``."""
    codes, at = names.unique.codes[rows], names.word_at[rows]
    gone = np.take_along_axis(np.pad(shared, ((0, 0), (0, 1))), np.minimum(at, shared.shape[1]), 1)
    keep = (codes != 0) & ~gone
    order = np.argsort(~keep, axis=1, kind="stable")
    sizes = np.maximum(keep.sum(1) - 1, 0)  # less the last word's space
    codes = np.take_along_axis(np.where(keep, codes, 0), order, 1)
    return Strings(np.where(np.arange(codes.shape[1]) < sizes[:, None], codes, 0), sizes)


class Pairs:
    """Pairs (i, j) of names from ``a`` and ``b``, which must have been prepared together (one ``Names`` of both)."""

    def __init__(self, names: Names, i: np.ndarray, j: np.ndarray):
        self.names, self.i, self.j = names, i, j

    def __getitem__(self, rows) -> Pairs:
        return Pairs(self.names, self.i[rows], self.j[rows])

    def plain(self) -> np.ndarray:
        return ratio(self.names.raw[self.i], self.names.raw[self.j])

    def sorted_words(self, measure=ratio) -> np.ndarray:
        return measure(self.names.sorted[self.i], self.names.sorted[self.j])

    def word_sets(self, parts: bool = False) -> np.ndarray:
        """The best of: shared words against each side's words, and the two sides, shared words first; with ``parts`` of parts of them."""
        n = self.names
        x, y = n.words[self.i], n.words[self.j]
        same = (x[:, :, None] == y[:, None, :]) & (x != 0)[:, :, None]
        sx, sy = same.any(2), same.any(1)
        any_ = sx.any(1)
        size = np.where(any_, (n.word_sizes[self.i] * sx).sum(1) + sx.sum(1) - 1, 0)
        a, b = _without(n, self.i, sx), _without(n, self.j, sy)
        if parts:
            out = np.full(len(any_), 100.0)
            left = np.flatnonzero(~any_)
            out[left] = partial(a[left], b[left])
            return out
        whole = lambda rest: size + rest + (any_ & (rest > 0))
        left, right = whole(a.sizes), whole(b.sizes)
        # what both begin with is common, the space behind it too where both go on
        together = common(a, b) + size + (any_ & (a.sizes > 0) & (b.sizes > 0))
        empty = left + right == 0
        sides = np.where(empty, 100.0, 200.0 * together / np.maximum(left + right, 1))
        most = np.maximum(200.0 * size / np.maximum(size + left, 1), 200.0 * size / np.maximum(size + right, 1))
        return np.maximum(sides, np.where(any_, most, 0.0))

    def weighted(self) -> np.ndarray:
        """The best of the plain and, at a discount, the word ratios; of strings of unlike length, of parts of the longer one."""
        na, nb = self.names.raw.sizes[self.i], self.names.raw.sizes[self.j]
        out = np.zeros(len(na))
        both = (na > 0) & (nb > 0)
        unlike = np.maximum(na, nb) / np.maximum(np.minimum(na, nb), 1)
        k = np.flatnonzero(both & (unlike < 1.5))
        p = self[k]
        out[k] = np.maximum(p.plain(), 0.95 * np.maximum(p.sorted_words(), p.word_sets()))
        k = np.flatnonzero(both & (unlike >= 1.5))
        p, scale = self[k], np.where(unlike[k] < 8, 0.9, 0.6)
        inside = partial(p.names.raw[p.i], p.names.raw[p.j])
        out[k] = np.maximum(np.maximum(p.plain(), scale * inside), 0.95 * scale * np.maximum(p.sorted_words(partial), p.word_sets(True)))
        return out

    def short_forms(self) -> np.ndarray:
        """Whether each word of the shorter name matches another word of the longer one: equal, a prefix of three letters at least,
        or an initial. A single word must match the last one."""
        n = self.names
        turned = (n.parts[self.i] != 0).sum(1) > (n.parts[self.j] != 0).sum(1)
        s, t = np.where(turned, self.j, self.i), np.where(turned, self.i, self.j)
        a, b, na, nb = n.parts[s], n.parts[t], n.part_sizes[s], n.part_sizes[t]
        one = (a != 0)[:, :, None] & (b != 0)[:, None, :]
        la, lb = na[:, :, None], nb[:, None, :]
        match = one & (a[:, :, None] == b[:, None, :])
        maybe = np.nonzero(one & ~match & ((la == 1) | (lb == 1) | ((la > 2) & (lb > 2))))
        u, v = n.part_texts[s[maybe[0]], maybe[1]].astype(str), n.part_texts[t[maybe[0]], maybe[2]].astype(str)
        if len(u):
            match[maybe] = np.strings.startswith(u, v) | np.strings.startswith(v, u)
        words, last = (a != 0).sum(1), np.maximum((b != 0).sum(1) - 1, 0)
        used, fits = np.zeros(b.shape, bool), words > 0
        for x in range(a.shape[1]):
            free = match[:, x] & ~used
            first = free.argmax(1)
            hit = free.any(1)
            used[np.flatnonzero(hit), first[hit]] = True
            fits &= hit | (a[:, x] == 0)
        return fits & ((words > 1) | match[np.arange(len(s)), 0, last])


def scores(names: Names, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of each pair the score if the names agree, else nan: equal, alike by both ratios, or one a short form of the other."""
    out = np.full(len(i), np.nan)
    for k in range(0, len(i), PAIRS):
        p = Pairs(names, i[k : k + PAIRS], j[k : k + PAIRS])
        ok = (names.raw.sizes[p.i] > 0) & (names.raw.sizes[p.j] > 0)
        width = names.raw.codes[p.i] == names.raw.codes[p.j]
        short, equal = p.short_forms(), width.all(1)
        alike = np.zeros(len(ok), bool)
        alike[ok] = p[ok].sorted_words() >= TOKEN_RATIO
        rows = np.flatnonzero(ok & (short | equal | alike))
        found = p[rows].weighted()
        agree = short[rows] | equal[rows] | (found >= RATIO)
        out[k + rows[agree]] = np.maximum(found, np.where(short[rows], SUBSET, 0.0))[agree]
    return out


def by_words(names: Names, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs whose sorted words are as alike as names that are alike have them."""
    ok = [Pairs(names, i[k : k + PAIRS], j[k : k + PAIRS]).sorted_words() >= TOKEN_RATIO for k in range(0, len(i), PAIRS)]
    ok = np.concatenate([np.zeros(0, bool), *ok])
    return i[ok], j[ok]


# --- which pairs can agree by likeness ---

#: Classes that characters are put in, how many of a class are told apart, and pairs that are looked at once.
CLASSES, TIMES, HITS = 40, 3, 1 << 16
#: Pairs of which a product is made at once.
PRODUCT = 1 << 22
#: A key is frequent if one in so many names has it.
OFTEN = 16
#: The code of a blank, and how many common pairs of letters tell enough.
BLANK, TELLING = ord(" ") + 1, 4


def sketch(names: Names) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bags, rest, size): by class of character whether there is one, two, three; how many more there are; the length of the sorted words."""
    n = len(names.raw.sizes)
    codes = names.sorted.codes
    row, col = np.nonzero(codes)
    counts = np.bincount(row * CLASSES + codes[row, col] % CLASSES, minlength=n * CLASSES).reshape(n, CLASSES)
    bags = (counts[:, :, None] > np.arange(TIMES)).reshape(n, -1).astype(np.float32)
    return bags, np.maximum(counts - TIMES, 0).sum(1), names.sorted.sizes


def may_agree(names: Names, i: np.ndarray, j: np.ndarray, sketched: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of ``i`` x ``j`` that can be alike by both ratios, by matrix products of their sketches; none that are is lost.

    A common subsequence has no more characters than the bags have in common. Sorted words that are ``TOKEN_RATIO`` alike have
    0.35 of both lengths in common; and of names of like length either the plain or a sorted one is ``RATIO`` alike, with 0.41 of both
    lengths in common, or a word is shared.
    """
    bags, rest, size = sketched or sketch(names)
    raw = names.raw.sizes
    once = np.maximum(names.unique.sizes - 1, 0)
    a, b = raw[i], raw[j]
    unlike = max(a.max(initial=0), b.max(initial=0)) >= 1.5 * min(a.min(initial=1 << 30), b.min(initial=1 << 30))
    hit = np.zeros((len(i), len(j)), bool)
    if unlike:
        hit |= np.maximum(a[:, None], b) >= 1.5 * np.minimum(a[:, None], b)
    _mark_shared(hit, names.words[i], names.words[j])
    # one product gives what is in common less what is asked for, as the rest of the one side bounds what both rests share
    blanks = raw - size
    for need in (RATIO / 200 * raw - blanks, RATIO / 190 * once):
        more = (rest[i] - need[i])[:, None].astype(np.float32)
        left = np.concatenate([bags[i], more, np.ones_like(more)], 1)
        right = np.concatenate([bags[j], np.ones((len(j), 1), np.float32), -need[j][:, None].astype(np.float32)], 1)
        hit |= left @ right.T >= -1e-2
    x, y = np.nonzero(hit)
    keep = [np.zeros(0, np.int64)]
    for k in range(0, len(x), HITS):
        keep.append(k + np.flatnonzero(_passes(bags, rest, size, raw, once, names.words, i[x[k : k + HITS]], j[y[k : k + HITS]])))
    keep = np.concatenate(keep)
    return x[keep], y[keep]


# --- the same by counts of pairs of letters, without a product over all pairs ---


def _letter_pairs(of: Strings) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): of each row the pairs of neighbouring characters in its words; the second of equal ones has another key than the first."""
    codes = of.codes
    if codes.shape[1] < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    row, col = np.nonzero((codes[:, 1:] != 0) & (codes[:, 1:] != BLANK) & (codes[:, :-1] != BLANK))
    pair = (codes[row, col] << 21) | codes[row, col + 1]
    order = np.lexsort((pair, row))
    row, pair = row[order], pair[order]
    fresh = np.r_[True, (row[1:] != row[:-1]) | (pair[1:] != pair[:-1])] if len(row) else np.zeros(0, bool)
    at = np.arange(len(row))
    times = at - np.maximum.accumulate(np.where(fresh, at, 0))
    _, pair = np.unique(pair, return_inverse=True)
    return row, pair * (int(times.max(initial=0)) + 1) + times


class _Places:
    """For each row of one side the rows of the other that have a key in common, by a list of rows for each key."""

    def __init__(self, row: np.ndarray, key: np.ndarray, i: np.ndarray, j: np.ndarray, n: int):
        place = np.full(n, -1)
        place[j] = np.arange(len(j))
        known, key = np.unique(key, return_inverse=True)
        right = np.flatnonzero(place[row] >= 0)
        right = right[np.argsort(key[right], kind="stable")]
        self.rows, self.ends = place[row[right]], np.searchsorted(key[right], np.arange(len(known) + 1))
        order = np.argsort(row, kind="stable")
        self.keys, self.of = key[order], np.searchsorted(row[order], np.arange(n + 1))
        # what many rows have is a row of flags, which are added faster than places are
        many = np.flatnonzero(np.diff(self.ends) * OFTEN > max(1, len(j)))
        self.flags, self.at = np.zeros((len(many), len(j)), np.uint8), np.full(len(known), -1)
        self.at[many] = np.arange(len(many))
        for at, k in enumerate(many.tolist()):
            self.flags[at, self.rows[self.ends[k] : self.ends[k + 1]]] = 1

    def counts(self, i: int, out: np.ndarray) -> np.ndarray:
        """How many keys of row ``i`` each of the others has, in ``out``; 255 at most, for rows of no more keys."""
        out[:] = 0
        keys = self.keys[self.of[i] : self.of[i + 1]]
        for k, at in zip(keys.tolist(), self.at[keys].tolist()):
            if at >= 0:
                np.add(out, self.flags[at], out=out)
            else:
                out[self.rows[self.ends[k] : self.ends[k + 1]]] += 1
        return out

    def __getitem__(self, i: int) -> np.ndarray:
        found = [self.rows[self.ends[k] : self.ends[k + 1]] for k in self.keys[self.of[i] : self.of[i + 1]].tolist()]
        return np.concatenate(found) if found else np.zeros(0, np.int64)


def _least_shared(a: int, b: np.ndarray, ratio: float) -> np.ndarray:
    """How many pairs of neighbours strings of these lengths have in common at least, if they are ``ratio`` alike.

    What is left unmatched of both is known; it cuts what is matched in at most one more run than it has characters, and a
    run of so many characters has one pair less.
    """
    apart = np.floor((1 - ratio / 100) * (a + b) + 1e-9).astype(np.int64)
    apart -= (a + b - apart) % 2
    return (a + b - apart) // 2 - apart - 1


def may_be_alike(names: Names, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``i`` and ``j`` of all pairs that can be alike by both ratios, as ``may_agree`` gives them.

    Names of like length are alike by their characters or by those of their sorted words, and then have pairs of neighbours in common, or share a word.
    Pairs with a blank aside, both writings of a name have the same. Where that says little (names of unlike lengths or with a word twice, short
    ones of many words) it is left to ``may_agree``.
    """
    n = len(names.raw.sizes)
    raw, size, twice = names.raw.sizes, names.sorted.sizes, np.maximum(names.unique.sizes - 1, 0) != names.sorted.sizes
    letters = ((names.sorted.codes != 0) & (names.sorted.codes != BLANK)).sum(1)
    pairs = _Places(*_letter_pairs(names.sorted), i, j, n)
    row, col = np.nonzero(names.words)
    words = _Places(row, names.words[row, col], i, j, n)
    space, sketched = np.zeros(len(j), np.uint8), None
    x, y = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    # left names of the same lengths ask the same of all right ones
    _, kind = np.unique(np.stack([raw[i], size[i], letters[i], twice[i]]), axis=1, return_inverse=True)
    kind = kind.ravel()
    for k in range(int(kind.max(initial=-1)) + 1):
        rows = np.flatnonzero(kind == k)
        a, s = int(raw[i[rows[0]]]), int(size[i[rows[0]]])
        # each blank is in two pairs at most
        needs = ((a, raw, RATIO), (s, size, RATIO / 0.95))
        need = np.minimum(*(_least_shared(m, of[j], ratio) - 2 * np.minimum(m - letters[i[rows[0]]], of[j] - letters[j]) for m, of, ratio in needs))
        left = (np.maximum(a, raw[j]) >= 1.5 * np.minimum(a, raw[j])) | (need < TELLING) | twice[j] | bool(twice[i[rows[0]]]) | (np.maximum(a, raw[j]) > 255)
        need = np.clip(need, 0, 255).astype(np.uint8)
        other = np.flatnonzero(left)
        step = max(1, PRODUCT // max(1, len(other)))
        for lo in range(0, len(rows) if len(other) else 0, step):
            sketched = sketched or sketch(names)
            u, v = may_agree(names, i[rows[lo : lo + step]], j[other], sketched)
            x.append(rows[lo : lo + step][u])
            y.append(other[v])
        if len(other) == len(j):
            continue
        for r in rows.tolist():
            hit = pairs.counts(i[r], space) >= need
            hit[words[i[r]]] = True
            hit[other] = False
            found = np.flatnonzero(hit)
            x.append(np.full(len(found), r))
            y.append(found)
    return np.concatenate(x), np.concatenate(y)


def _mark_shared(hit: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Set where a row of ``x`` and one of ``y`` have a word in common."""
    def of(words):
        row, col = np.nonzero(words)
        ids = words[row, col]
        order = np.argsort(ids, kind="stable")
        known, first = np.unique(ids[order], return_index=True)
        return known, np.split(row[order], first[1:])

    (known_x, rows_x), (known_y, rows_y) = of(x), of(y)
    for p, q in zip(*np.intersect1d(known_x, known_y, assume_unique=True, return_indices=True)[1:]):
        hit[np.ix_(rows_x[p], rows_y[q])] = True


def _passes(bags, rest, size, raw, once, words, i, j) -> np.ndarray:
    """Of each pair whether it can agree."""
    held = np.einsum("ij,ij->i", bags[i], bags[j]) + np.minimum(rest[i], rest[j])
    a, b = raw[i], raw[j]
    ok = (a > 0) & (b > 0) & (held >= TOKEN_RATIO / 200 * (size[i] + size[j]) - 1e-3)
    unlike = np.maximum(a, b) >= 1.5 * np.minimum(a, b)
    blanks = (a - size[i]) + (b - size[j])
    near = (held + blanks >= RATIO / 200 * (a + b) - 1e-3) | (held >= RATIO / 190 * (once[i] + once[j]) - 1e-3)
    shared = np.zeros(len(i), bool)
    rows = np.flatnonzero(ok & ~unlike & ~near)
    shared[rows] = ((words[i[rows]][:, :, None] == words[j[rows]][:, None, :]) & (words[i[rows]] != 0)[:, :, None]).any((1, 2))
    return ok & (unlike | near | shared)
