"""Substring deduplication after prefix-free parsing.

Every byte covered by a string of ``LENGTH`` (200) bytes that starts at two places of the corpus or more is removed.

Parse. A rolling hash over ``GRAM`` bytes triggers phrases: in each window of ``LENGTH`` bytes the trigger is the
position with the least hash among the first ``REACH``, so every window has one, it depends on the window's bytes alone,
and consecutive windows share it: they form a phrase, a run of window starts with one trigger, about one per 70 bytes.

Dictionary. Two equal windows have equal triggers and share the ``LENGTH - REACH`` bytes after them. The dictionary counts
the distinct phrases by that inner string and by the whole string under their windows. An inner string that occurs once
makes its phrase's windows unique; a whole string that occurs twice makes all its windows repeated. Both are settled by
counts, whatever the number of occurrences.

Suffixes. What is left are phrases whose inner string repeats while the whole one does not, mostly at the edges of
repeated passages. Of each such group of dictionary entries, all suffixes of the phrases, continued by the parse to
window length, are brought into order, and equal neighbours are repeated windows. As only equality of the first 200
bytes counts, the order is that of hashes of (trigger offset, window), not lexicographic. Groups of up to ``group_rows``
entries are ordered within a task. Larger groups are counted in shuffles, so that no group has to fit anywhere, in two
steps: runs of ``RUN`` windows first, of which one that occurs twice is settled as a whole, then the single windows of the
other runs and of one run of each settled kind, unless the bytes that all windows of the run share occur once.

Strings are compared by 64-bit polynomial hashes over byte codes, pairwise with the inner string's, 128 bits in all.

Edge cases: null and empty texts have no bytes; texts under 200 bytes keep all; matches never cross rows; rows that
repeat, with or without their id, are each other's copies; rows without an id are told apart by their text; an empty
table gives no rows; other columns are ignored. Texts are taken whole, in segments that overlap by a window.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from periodica.llm.common import cut, pieces, table, text_or_empty

LENGTH, REACH, GRAM = 200, 144, 16
INNER = LENGTH - REACH
RUN = 16  # windows
SEGMENT = 1 << 18  # window starts at once

_U = np.uint64
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15


def mix(h: np.ndarray) -> np.ndarray:
    """The finalizer of a 64-bit hash."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> _U(33))
    h = h * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def _powers(base: int, n: int) -> np.ndarray:
    p = np.ones(n, np.uint64)
    m = 1
    while m < n:
        k = min(m, n - m)
        p[m : m + k] = p[:k] * _U(pow(base, m, 1 << 64))
        m += k
    return p


_CODES = mix(np.arange(1, 257, dtype=np.uint64) * _U(0xD1342543DE82EF95))
_UP = _powers(_BASE, SEGMENT + 2 * LENGTH)
_DOWN = _powers(pow(_BASE, -1, 1 << 64), SEGMENT + 2 * LENGTH)


def sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``hashes`` takes the hash of any substring."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_CODES[data] * _UP[: len(data)], out=out[1:])
    return out


def hashes(s: np.ndarray, start, end) -> np.ndarray:
    return mix((s[end] - s[start]) * _DOWN[start])


def triggers(s: np.ndarray) -> np.ndarray:
    """The trigger of every window of the data behind ``s``, the leftmost of equals."""
    n = len(s) - 1
    grams = n - GRAM + 1
    key = (mix((s[GRAM:] - s[:-GRAM]) * _DOWN[:grams]) & _U(_MASK ^ (1 << 20) - 1)) | np.arange(grams, dtype=np.uint64)
    windows = n - LENGTH + 1
    key = key[: windows + REACH - 1]
    blocks = np.concatenate([key, np.full(-len(key) % REACH, _MASK, np.uint64)]).reshape(-1, REACH)
    head = np.minimum.accumulate(blocks, axis=1).ravel()
    tail = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(tail[:windows], head[REACH - 1 : REACH - 1 + windows]) & _U((1 << 20) - 1)).astype(np.int64)


def phrases(data: np.ndarray):
    """(trigger, first window, last window, inner hash, whole hash) of all phrases, as arrays, a segment at a time."""
    windows = len(data) - LENGTH + 1
    for at in range(0, max(0, windows), SEGMENT):
        part = data[at : min(windows, at + SEGMENT) + LENGTH - 1]
        s = sums(part)
        t = triggers(s)
        edges = np.flatnonzero(np.diff(t)) + 1
        first, last = np.concatenate([[0], edges]), np.concatenate([edges - 1, [len(t) - 1]])
        t = t[first]
        shape = (t - first).astype(np.uint64) << _U(8) | (t - last).astype(np.uint64)
        yield t + at, first + at, last + at, hashes(s, t, t + INNER), mix(hashes(s, first, last + LENGTH) + shape)


def pack(trigger, first, last):
    """A phrase's place in one integer; ``unpack`` reverses it."""
    return trigger << 16 | (trigger - first) << 8 | (trigger - last)


def unpack(place):
    trigger = place >> 16
    return trigger, trigger - (place >> 8 & 255), trigger - (place & 255)


def _key(docs: DataFrame) -> DataFrame:
    """row_key, doc_id, text: the id where ids tell rows apart, else a hash of the row."""
    t = docs.select("doc_id", text_or_empty().alias("text"))
    unclear = t.groupBy("doc_id").count().where("doc_id is null or count > 1").limit(1).count()
    key = F.xxhash64("doc_id", "text") if unclear else F.col("doc_id").cast("long")
    return t.select(key.alias("row_key"), "doc_id", "text")


def parse(keyed: DataFrame) -> DataFrame:
    """The phrases of all rows: row_key, place, inner, whole."""

    def run(batches):
        for b in pieces(batches, 1):
            out = [[], [], [], []]
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for t, first, last, inner, whole in phrases(np.frombuffer(text.encode(), np.uint8)):
                    for o, v in zip(out, (np.full(len(t), key), pack(t, first, last), inner.view(np.int64), whole.view(np.int64))):
                        o.append(v)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], names=["row_key", "place", "inner", "whole"])

    return keyed.select("row_key", "text").mapInArrow(run, "row_key long, place long, inner long, whole long")


#: What is known of a phrase: all its windows repeat; open, to be ordered in a task; open, in a large group.
REPEATED, OPEN, OPEN_LARGE = 1, 2, 3
TASKS = "kind int, row_key long, place long, inner long, context binary, window long, ranges binary, left binary"
RANGES = "row_key long, first long, last long"


def _ranges(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of the runs of consecutive numbers in sorted ``starts``."""
    edges = np.flatnonzero(np.diff(starts) != 1)
    return starts[np.concatenate([[0], edges + 1])], starts[np.concatenate([edges, [len(starts) - 1]])]


def _ranges_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of the runs of equal ``values``."""
    edges = np.flatnonzero(np.diff(values)) + 1
    return np.concatenate([[0], edges]), np.concatenate([edges - 1, [len(values) - 1]])


def merge(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Byte ranges [start, end) covered by windows that start in first..last, merged, as two columns."""
    order = np.argsort(first, kind="stable")
    start, end = first[order], np.maximum.accumulate(last[order] + LENGTH)
    new = np.concatenate([[True], start[1:] > end[:-1]])
    return np.stack([start[new], end[np.concatenate([new[1:], [True]])]], axis=1)


def without(data: bytes, spans: np.ndarray) -> bytes:
    at, kept = 0, []
    for a, b in spans.tolist():
        kept.append(data[at:a])
        at = b
    return b"".join([*kept, data[at:]])


def _settle(docs: DataFrame) -> DataFrame:
    """Rows with their phrases: text as zstd, places, states, inners. Emits windows, contexts and what is final."""

    def run(batches):
        unzip = zstandard.ZstdDecompressor()
        zipped = zstandard.ZstdCompressor(3)
        for batch in batches:
            for b in pieces([batch], 1, 1 << 20):
                out: list[tuple] = []
                for key, text, found in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                    raw = unzip.decompress(text)
                    data = np.frombuffer(raw, np.uint8)
                    f = found.values
                    place, state, inner, n = (f.field(k).to_numpy() for k in range(4))
                    t, first, last = unpack(place)
                    done = (state == REPEATED) | (n > 1)
                    spans = merge(first[done], last[done]) if done.any() else np.zeros((0, 2), np.int64)
                    for k in np.flatnonzero(state == OPEN):
                        out.append((OPEN, key, place[k], inner[k], raw[first[k] : last[k] + LENGTH], None, None, None))
                    for k in np.flatnonzero(state == OPEN_LARGE):
                        part = data[first[k] : last[k] + LENGTH]
                        before = t[k] - np.arange(first[k], last[k] + 1)
                        a, b_ = _ranges_of(before // RUN)
                        same = mix(hashes(sums(part), a, b_ + LENGTH) + (before[a] << 8 | before[b_]).astype(np.uint64)).view(np.int64)
                        whole = before[0] - before[a] // RUN * RUN
                        core = mix(hashes(sums(part), whole, whole + LENGTH - RUN + 1) + (before[a] // RUN).astype(np.uint64))
                        for i, j, x, c in zip(a.tolist(), b_.tolist(), same.tolist(), core):
                            out.append((OPEN_LARGE, key, (first[k] + i) << 8 | before[i], inner[k], part[i : j + LENGTH].tobytes(), x, c.tobytes(), None))
                    final = not ((state != REPEATED) & (n == 1)).any()
                    out.append((REPEATED if final else 0, key, len(raw), None, None, int((spans[:, 1] - spans[:, 0]).sum()), spans.tobytes(), hashlib.sha256(without(raw, spans)).digest() if final else zipped.compress(without(raw, spans))))
                yield _tasks(out)

    return docs.mapInArrow(run, TASKS)


def _tasks(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=[x.split()[0] for x in TASKS.split(", ")])


def order_suffixes(inner: np.ndarray, place: np.ndarray, contexts: list[bytes]):
    """(entry, first window, last window) of the windows that two entries of a group have in common."""
    t, first, last = unpack(place)
    counts = last - first + 1
    key = np.empty(int(counts.sum()), np.uint64)
    at = 0
    for k, c in enumerate(contexts):
        n = int(counts[k])
        w = np.arange(n)
        key[at : at + n] = mix(hashes(sums(np.frombuffer(c, np.uint8)), w, w + LENGTH) + (t[k] - first[k] - w).astype(np.uint64))
        at += n
    group = np.repeat(inner.view(np.uint64), counts)
    order = np.lexsort((key, group))
    k, g = key[order], group[order]
    same = (k[1:] == k[:-1]) & (g[1:] == g[:-1])
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    entry = np.repeat(np.arange(len(place)), counts)
    start = np.repeat(first - (np.cumsum(counts) - counts), counts) + np.arange(len(key))
    edges = np.concatenate([[0], np.cumsum(counts)])
    for e in np.unique(entry[twice]):
        own = slice(edges[e], edges[e + 1])
        for a, b in zip(*_ranges(start[own][twice[own]])):
            yield e, a, b


def _order(entries: DataFrame) -> DataFrame:
    """Windows in common, of entries sorted by group within each partition."""

    def ranges(rows: pa.Table) -> pa.RecordBatch:
        key, place, inner = (rows.column(k).to_numpy() for k in ("row_key", "place", "inner"))
        found = list(order_suffixes(inner, place, rows.column("context").to_pylist()))
        e, a, b = zip(*found) if found else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(key[list(e)], pa.int64()), pa.array(list(a), pa.int64()), pa.array(list(b), pa.int64())], names=["row_key", "first", "last"])

    def run(batches):
        held = None
        for b in pieces(batches, 3, 4 << 20):
            rows = pa.Table.from_batches([b])
            rows = pa.concat_tables([held, rows]) if held is not None else rows
            inner = rows.column("inner").to_numpy()
            start = int(np.searchsorted(inner, inner[-1]))  # the last group may go on
            if start:
                yield ranges(rows.slice(0, start))
            held = rows.slice(start)
        if held is not None:
            yield ranges(held)

    return entries.mapInArrow(run, RANGES)


def _single(runs: DataFrame) -> DataFrame:
    """row_key, first, inner, window of the single windows of runs (row_key, place, inner, context)."""

    def run(batches):
        for b in pieces(batches, 3, 1 << 20):
            out = [[], [], [], []]
            for key, place, inner, context in zip(*(b.column(k).to_pylist() for k in range(4))):
                w = np.arange(len(context) - LENGTH + 1)
                h = mix(hashes(sums(np.frombuffer(context, np.uint8)), w, w + LENGTH) + ((place & 255) - w).astype(np.uint64))
                for o, v in zip(out, (np.full(len(w), key), (place >> 8) + w, np.full(len(w), inner), h.view(np.int64))):
                    o.append(v)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], names=["row_key", "first", "inner", "window"])

    return runs.mapInArrow(run, "row_key long, first long, inner long, window long")


def _finish(residues: DataFrame) -> DataFrame:
    """row_key, n_bytes, ranges so far, the text that they left, and the ranges found since."""

    def run(batches):
        unzip = zstandard.ZstdDecompressor()
        for b in batches:
            out = [[], [], [], [], []]
            for key, n, old, left, more in zip(*(b.column(k).to_pylist() for k in range(5))):
                spans = np.frombuffer(old, np.int64).reshape(-1, 2)
                left = unzip.decompress(left)
                if more:
                    new = np.array([(x["first"], x["last"]) for x in more], np.int64)
                    all_ = merge(np.concatenate([spans[:, 0], new[:, 0]]), np.concatenate([spans[:, 1] - LENGTH, new[:, 1]]))
                    whole = np.zeros(n, np.uint8)
                    gone = np.zeros(n + 1, np.int8)
                    np.add.at(gone, spans[:, 0], 1)
                    np.add.at(gone, spans[:, 1], -1)
                    whole[np.cumsum(gone[:n]) == 0] = np.frombuffer(left, np.uint8)
                    spans, left = all_, without(whole.tobytes(), all_)
                for o, v in zip(out, (key, n, int((spans[:, 1] - spans[:, 0]).sum()), len(spans), hashlib.sha256(left).hexdigest())):
                    o.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(o, pa.string() if k == 4 else pa.int64()) for k, o in enumerate(out)], names=["row_key", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return residues.mapInArrow(run, "row_key long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _squeeze(keyed: DataFrame) -> DataFrame:
    """row_key and the text as zstd, for the shuffle."""

    def run(batches):
        zipped = zstandard.ZstdCompressor(3)
        for b in pieces(batches, 1):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([zipped.compress(t.encode()) for t in b.column(1).to_pylist()], pa.binary())], names=["row_key", "zipped"])

    return keyed.select("row_key", "text").mapInArrow(run, "row_key long, zipped binary")


def remove_repeats(docs: DataFrame, group_rows: int = 2000) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of ``docs`` (columns doc_id and text are read)."""
    keyed = _key(docs)
    rows = parse(keyed)
    mark = F.xxhash64("row_key", "place")
    counted = rows.groupBy("inner", "whole").agg(F.count("*").alias("n"), F.min(mark).alias("shown"))
    counted = cut(counted, "dictionary")
    groups = counted.groupBy("inner").agg(F.count("*").alias("entries"), F.sum("n").alias("places")).where("places > 1")
    groups = cut(groups, "groups")
    single = F.when(F.col("entries") <= group_rows, OPEN).otherwise(OPEN_LARGE)
    dictionary = counted.join(groups, "inner").select("inner", "whole", "n", "shown", F.when(F.col("entries") == 1, REPEATED).otherwise(single).alias("state"))
    dictionary = cut(dictionary, "repeated")

    # a row per phrase whose inner string repeats; of an entry with many places in an open group, one place goes on
    open_ = (F.col("n") == 1) | (mark == F.col("shown"))
    state = F.when(F.col("state") == REPEATED, REPEATED).when(open_, F.col("state")).otherwise(REPEATED)
    known = rows.join(dictionary, ["inner", "whole"]).select("row_key", F.struct("place", state.cast("int").alias("state"), F.when(state == REPEATED, 0).otherwise(F.col("inner")).alias("inner"), "n").alias("p"))
    lists = known.groupBy("row_key").agg(F.collect_list("p").alias("found"))
    settled = cut(_settle(_squeeze(keyed).join(lists, "row_key").select("row_key", "zipped", "found")), "settled")

    small = settled.where(F.col("kind") == OPEN).select("row_key", "place", "inner", "context")
    shared = _order(small.repartition("inner").sortWithinPartitions("inner"))
    runs = settled.where(F.col("kind") == OPEN_LARGE).select("row_key", "place", "inner", "context", "window", F.col("ranges").alias("core"))
    cores = runs.groupBy("inner", "core").agg(F.count("*").alias("shared"))
    kinds = runs.groupBy("inner", "window").agg(F.count("*").alias("n"), F.min(F.struct("row_key", "place")).alias("one"))
    runs = cut(runs.join(kinds, ["inner", "window"]).join(cores, ["inner", "core"]), "runs")
    count = F.octet_length("context") - LENGTH
    start = F.shiftright("place", 8)
    shared = shared.unionAll(runs.where("n > 1").select("row_key", start.alias("first"), (start + count).alias("last")))
    single = (F.col("shared") > 1) & ((F.col("n") == 1) | (F.struct("row_key", "place") == F.col("one")))
    windows = _single(runs.where(single).select("row_key", "place", "inner", "context"))
    twice = windows.groupBy("inner", "window").agg(F.count("*").alias("n")).where("n > 1")
    shared = shared.unionAll(windows.join(twice, ["inner", "window"]).select("row_key", "first", F.col("first").alias("last")))
    more = shared.groupBy("row_key").agg(F.collect_list(F.struct("first", "last")).alias("more"))
    residues = settled.where(F.col("kind") == 0).select("row_key", F.col("place").alias("n_bytes"), "ranges", "left")
    finished = _finish(residues.join(more, "row_key", "left").select("row_key", "n_bytes", "ranges", "left", "more"))
    spans = F.length("ranges") / 16
    final = settled.where(F.col("kind") == REPEATED).select("row_key", F.col("place").alias("n_bytes"), F.col("window").alias("n_removed"), spans.cast("long").alias("n_spans"), F.lower(F.hex("left")).alias("kept_sha256"))
    changed = final.unionAll(finished).withColumnRenamed("n_bytes", "n_changed")
    untouched = keyed.select("row_key", "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    return untouched.join(changed.dropDuplicates(["row_key"]), "row_key", "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256")
    )


def op4_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
