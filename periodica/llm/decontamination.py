"""Benchmark decontamination by spaced seeds.

Words are runs of ASCII letters (lower-cased), digits and non-ASCII characters. A document is contaminated by a benchmark
item if ``WINDOW`` (13) consecutive words of the item stand in it with ``SUBSTITUTIONS`` (2) words replaced at most; a
shorter item must stand whole, and may have as many words replaced in proportion: one of 7 to 12, none of fewer.

Each of three fixed masks hashes seven of the words under it and ignores the others. Together they miss no window with two
substitutions, wherever those are. Items shorter than a mask are split into one part more than words may be replaced, of
which one must stand unchanged, and these parts are hashed. Test hashes are joined with training hashes; each carries the hashes of the words
around it, so that the overlap around a hit is verified on the joined row, with nothing to look up. Training hashes that
no test hash can equal are left out before the join by a Bloom filter of bounded size (32 MB), which changes no result.

Edge cases: null and empty texts have no words; items under ``min_words`` words can't be told from chance and match
nothing (the parameter is the contract: 1 takes every item with a word); items with wholly the same words count as the one
with the smallest id, or without an id if none has one, and items that share a passage are each found; documents that
repeat with id and text give one row in ``overlaps``, and ``decontaminate`` drops or keeps all of them; rows without an id
are found too; empty tables give no rows; other columns are ignored by ``overlaps`` and kept by ``decontaminate``. Texts
are searched whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from periodica.llm.common import cut, pieces, table, text_or_empty
from periodica.llm.suffix_dedup import _CODES, mix

WINDOW, SUBSTITUTIONS = 13, 2

# The word positions that each mask reads.
MASKS = ((0, 1, 2, 3, 5, 7, 8), (0, 1, 3, 4, 7, 8, 9), (0, 1, 5, 6, 7, 8, 10))
SPAN = 1 + max(m[-1] for m in MASKS)
AROUND = WINDOW - 1
WIDTH = AROUND + SPAN + AROUND

_U = np.uint64
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 0 for c in range(256))
_NO_TEST, _NO_TRAINING = 0xFFFFFFFF, 0xFFFFFFFE
MOST_BITS = 28


_FACTORS = mix(np.arange(1, SPAN + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)) | _U(1)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A hash per word of all texts, and the number of the first word of each text (one more at the end)."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join(raw).translate(_LETTERS) + b"\0", np.uint8)
    inside = np.concatenate([[False], data != 0])
    starts, ends = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
    at = np.cumsum([0, *(len(r) + 1 for r in raw)])
    firsts = np.searchsorted(starts, at)
    if not len(starts):
        return np.zeros(0, np.uint64), firsts
    first = int(starts[0])
    place = np.arange(first, len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
    powers = np.ones(1 + int((ends - starts).max()), np.uint64)
    np.cumprod(np.full(len(powers) - 1, 0x9E3779B97F4A7C15, np.uint64), out=powers[1:])
    data = data[first:]
    values = np.where(data != 0, _CODES[data] * powers[np.minimum(place, len(powers) - 1)], _U(0))
    return mix(np.add.reduceat(values, starts - first)), firsts


def replaceable(window: int) -> int:
    """Words that may be replaced in a window of so many."""
    return window * SUBSTITUTIONS // WINDOW


def parts(n: int) -> list[tuple[int, int]]:
    """(offset, length) of the parts of a short item, of which one must stand unchanged."""
    k = replaceable(n) + 1
    cuts = [n * i // k for i in range(k + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def seeds(words: np.ndarray, firsts: np.ndarray, lengths: list[int]):
    """(0, hashes, numbers of their first words) for each mask, and (n, ...) for runs of each n of ``lengths`` words."""
    row = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
    for k, mask in enumerate([*MASKS, *(tuple(range(n)) for n in lengths)]):
        run = len(mask) if k >= len(MASKS) else 0
        n = len(words) - mask[-1]
        if n <= 0:
            continue
        total = np.full(n, (100 + run if run else k + 1) * 0x632BE59BD9B4E019 & (1 << 64) - 1, np.uint64)
        for j, o in enumerate(mask):
            total += words[o : o + n] * _FACTORS[j]
        at = np.flatnonzero(row[:n] == row[mask[-1] :])
        yield run, mix(total[at]), at


def contexts(words: np.ndarray, firsts: np.ndarray, at: np.ndarray, row: np.ndarray, missing: int) -> list[bytes]:
    """The 32-bit hashes of the words from ``AROUND`` before each seed to ``AROUND`` after the longest one."""
    if not len(at):
        return []
    low = np.minimum((words >> _U(32)).astype(np.uint32), np.uint32(_NO_TRAINING - 1))
    places = at[:, None] + np.arange(-AROUND, SPAN + AROUND)
    ok = (places >= firsts[row][:, None]) & (places < firsts[row + 1][:, None])
    found = np.where(ok, low[np.clip(places, 0, len(low) - 1)], np.uint32(missing)).astype("<u4")
    return [r.tobytes() for r in found]


def verify(test: np.ndarray, training: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per pair of contexts: most equal words in a window that lies in both (-1: too few), and where it begins."""
    best, where = np.full(len(test), -1), np.zeros(len(test), np.int64)
    equal, both = test == training, (test != _NO_TEST) & (training != _NO_TRAINING)
    for w in np.unique(window).tolist():
        rows = np.flatnonzero(window == w)
        sums = [np.concatenate([np.zeros((len(rows), 1), np.int64), np.cumsum(x[rows], axis=1)], axis=1) for x in (equal & both, both)]
        same, whole = (s[:, w:] - s[:, :-w] for s in sums)
        same = np.where((whole == w) & (same >= w - replaceable(w)), same, -1)
        where[rows] = same.argmax(axis=1)
        best[rows] = same[np.arange(len(rows)), where[rows]]
    return best, where


def _items(benchmark: DataFrame, min_words: int) -> DataFrame:
    """The seeds of all items, of those with the same words of the smallest id: item_id, hash, test (context), item_word, window, run."""
    short = {n: parts(n) for n in range(min_words, SPAN)}
    runs = sorted({size for some in short.values() for _, size in some})

    def same(batches):
        for b in pieces(batches, 1, 1 << 20):
            words, firsts = word_hashes(b.column(1).to_pylist())
            keys = [xxhash.xxh64_intdigest(words[a:z].tobytes()) for a, z in zip(firsts[:-1].tolist(), firsts[1:].tolist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.array(keys, np.uint64).view(np.int64))], names=["item_id", "text", "same"])

    def emit(batches):
        for b in pieces(batches, 1, 1 << 20):
            words, firsts = word_hashes(b.column(1).to_pylist())
            counts = np.diff(firsts)
            row = np.repeat(np.arange(len(counts)), counts)
            # a run of words is a part of shorter items, the masks stand for the longer ones
            for run, h, at in seeds(words, firsts, runs):
                size, place = counts[row[at]], at - firsts[row[at]]
                use = size >= SPAN
                if run:
                    use = np.zeros(len(at), bool)
                    for n, some in short.items():
                        for offset, m in some:
                            use |= (size == n) & (place == offset) & (m == run)
                h, at = h[use], at[use]
                if len(h):
                    yield pa.RecordBatch.from_arrays(
                        [
                            b.column(0).take(pa.array(row[at])),
                            pa.array(h.view(np.int64)),
                            pa.array(contexts(words, firsts, at, row[at], _NO_TEST), pa.binary()),
                            pa.array(at - firsts[row[at]]),
                            pa.array(np.minimum(counts[row[at]], WINDOW)),
                            pa.array(np.full(len(at), run)),
                        ],
                        names=["item_id", "hash", "test", "item_word", "window", "run"],
                    )

    texts = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_or_empty().alias("text"))
    keyed = cut(texts.mapInArrow(same, "item_id long, text string, same long"), "items")
    firsts = keyed.groupBy("same").agg(F.min("item_id").alias("item_id"))
    first = (firsts.same == keyed.same) & firsts.item_id.eqNullSafe(keyed.item_id)
    return keyed.join(firsts, first, "left_semi").select("item_id", "text").mapInArrow(emit, "item_id long, hash long, test binary, item_word long, window long, run long")


#: Parts into which the hits of one hash are split.
SALTS = 8


def hash_join(hits: DataFrame, tests: DataFrame) -> DataFrame:
    """``hits`` with the tests of the same hash. A hash that many documents share meets its tests in ``SALTS`` tasks: the tests,
    a few for each word of the benchmark, are dealt to all of them, and never broadcast."""
    salt = F.pmod(F.xxhash64("row_key", "word"), F.lit(SALTS)).cast("int").alias("salt")
    each = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    return hits.select("*", salt).join(tests.select("*", each).hint("merge"), ["hash", "salt"]).drop("salt")


def _filter(hashes: DataFrame) -> np.ndarray:
    """A Bloom filter of two probes over ``hashes``, 1024 bits for each up to 32 MB in all."""
    distinct = hashes.distinct()
    n = distinct.count()
    bits = min(MOST_BITS, max(16, (1024 * n).bit_length()))

    def slots(batches):
        for b in batches:
            h = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            s = np.unique(np.concatenate([h & _U((1 << bits) - 1), h >> _U(32) & _U((1 << bits) - 1)]))
            yield pa.RecordBatch.from_arrays([pa.array((s >> _U(16)).astype(np.int64)), pa.array((s & _U(0xFFFF)).astype(np.int32))], names=["chunk", "slot"])

    def chunk(rows: pa.Table) -> pa.Table:
        out = np.zeros(1 << 16, bool)
        out[rows.column("slot").to_numpy()] = True
        return pa.table({"chunk": rows.column("chunk").slice(0, 1), "bits": pa.array([np.packbits(out, bitorder="little").tobytes()], pa.binary())})

    whole = np.zeros(1 << bits - 3, np.uint8)
    for r in distinct.mapInArrow(slots, "chunk long, slot int").groupBy("chunk").applyInArrow(chunk, "chunk long, bits binary").collect():
        whole[r["chunk"] << 13 : (r["chunk"] + 1) << 13] = np.frombuffer(r["bits"], np.uint8)
    return whole


def may_have(bloom: np.ndarray, h: np.ndarray) -> np.ndarray:
    mask = _U(8 * len(bloom) - 1)
    a = h & mask
    at = np.flatnonzero(bloom[(a >> _U(3)).astype(np.int64)] >> (a & _U(7)).astype(np.uint8) & 1)
    b = h[at] >> _U(32) & mask
    return at[np.flatnonzero(bloom[(b >> _U(3)).astype(np.int64)] >> (b & _U(7)).astype(np.uint8) & 1)]


def row_key() -> Column:
    """Tells rows apart by id and text."""
    return F.xxhash64("doc_id", text_or_empty())


def _verified(docs: DataFrame, benchmark: DataFrame, min_words: int) -> tuple[DataFrame, DataFrame]:
    """Verified hits (row_key, doc_id, seed, word, shift, equal, window) and the items (seed, item_id, item_word) of each seed.

    Items that share words share a seed, so that a hit is joined and verified once, whatever the number of its items.
    """
    spark = docs.sparkSession
    seeded = cut(_items(benchmark, min_words).withColumn("seed", F.xxhash64("hash", "test", "window")), "seeded")
    items = cut(seeded.groupBy("seed", "item_id").agg(F.min("item_word").alias("item_word")), "seed_items")
    tests = cut(seeded.select("hash", "test", "window", "seed", "run").distinct(), "seeds")
    lengths = sorted(r[0] for r in tests.where("run > 0").select("run").distinct().collect())
    bloom = spark.sparkContext.broadcast(_filter(tests.select("hash")))

    def training(batches):
        for b in pieces(batches, 2, 1 << 20):
            words, firsts = word_hashes(b.column(2).to_pylist())
            row = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
            for _, h, at in seeds(words, firsts, lengths):
                hit = may_have(bloom.value, h)
                h, at = h[hit], at[hit]
                for k in range(0, len(h), 50_000):
                    some, own = at[k : k + 50_000], row[at[k : k + 50_000]]
                    yield pa.RecordBatch.from_arrays(
                        [
                            b.column(0).take(pa.array(own)),
                            b.column(1).take(pa.array(own)),
                            pa.array(h[k : k + 50_000].view(np.int64)),
                            pa.array(some - firsts[own]),
                            pa.array(contexts(words, firsts, some, own, _NO_TRAINING), pa.binary()),
                        ],
                        names=["row_key", "doc_id", "hash", "word", "training"],
                    )

    hits = docs.select(row_key().alias("row_key"), F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(
        training, "row_key long, doc_id long, hash long, word long, training binary"
    )

    def check(batches):
        for b in batches:
            test, seen = (np.frombuffer(b"".join(b.column(k).to_pylist()), "<u4").reshape(-1, WIDTH) for k in (4, 3))
            window = b.column(5).to_numpy(zero_copy_only=False)
            equal, where = verify(test, seen, window)
            ok = np.flatnonzero(equal >= 0)
            shift = where[ok] - AROUND
            cols = [b.column(k).take(pa.array(ok)) for k in (0, 1)]
            word = b.column(2).to_numpy(zero_copy_only=False)[ok] + shift
            yield pa.RecordBatch.from_arrays(
                [*cols, b.column(6).take(pa.array(ok)), pa.array(word), pa.array(shift), pa.array(equal[ok]), pa.array(window[ok])],
                names=["row_key", "doc_id", "seed", "word", "shift", "equal", "window"],
            )

    pairs = hash_join(hits, tests).select("row_key", "doc_id", "word", "training", "test", "window", "seed")
    return pairs.mapInArrow(check, "row_key long, doc_id long, seed long, word long, shift long, equal long, window long"), items


def overlaps(docs: DataFrame, benchmark: DataFrame, min_words: int = 5) -> DataFrame:
    """row_key, doc_id, item_id, first_word, item_word, equal_words, window of every document and item that overlap.

    The first overlap with most equal words is reported, by its places among the words of both.
    """
    found, items = _verified(docs, benchmark, min_words)
    hit = F.min(F.struct((-F.col("equal")).alias("e"), "word", "shift", "window")).alias("h")
    hits = found.groupBy("row_key", "doc_id", "seed").agg(hit).join(items, "seed")
    place = F.struct("h.e", "h.word", (F.col("item_word") + F.col("h.shift")).alias("item_word"), "h.window")
    return hits.groupBy("row_key", "doc_id", "item_id").agg(F.min(place).alias("best")).select(
        "row_key", "doc_id", "item_id", F.col("best.word").alias("first_word"), "best.item_word", (-F.col("best.e")).alias("equal_words"), "best.window"
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, min_words: int = 5) -> DataFrame:
    """``docs`` without the rows that overlap an item."""
    bad = cut(_verified(docs, benchmark, min_words)[0].select(F.col("row_key").alias("bad_key")).distinct(), "leaks")
    return docs.join(bad, row_key() == F.col("bad_key"), "left_anti")


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row_key")
