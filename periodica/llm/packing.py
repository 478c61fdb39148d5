"""Packing: harmonic classes of documents' tokens in sequences of a fixed capacity.

A piece of length l belongs to class ``capacity // l``, and a bin of class k takes exactly k pieces, so every worker
fills its bins on its own, without looking at any other. Documents are cut where they fit: full sequences first, then
pieces of length ``capacity // k`` until the rest wastes at most ``slack`` of a bin of its class.

Bins that a worker could not complete are few (under k pieces per class, a bound that does not depend on the data);
their pieces go to the next round, where one worker fills bins from the rests of ``FAN_IN`` others, and so on; the
pieces that the last worker still has, no more than that same bound, share bins best fit, longest first.

Edge cases: null and empty texts have the end id only; texts are taken whole; documents that repeat are packed once
each; an empty table gives no pieces; other columns are ignored. Every id lies in one piece, offsets in a sequence are
gapless, and no sequence exceeds the capacity.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from periodica.llm.common import _arrow_schema, cut, pieces, table, text_or_empty

FAN_IN = 8
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, part long"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: Where a text's words can be brought to fewer forms: no letter can join a mark, no special token can appear, and every
#: comma or full stop before a space follows a plain Latin letter or a digit, so that it is no part of a longer run.
_MARKS = re.compile("[\u0300-\u036f]")
_RUNS = re.compile("[.,](?<![0-9A-Za-zÀ-ÖØ-öø-ÿ][.,]) ")
_PLAIN_WORD = re.compile("[a-zß-öø-ÿ]+").fullmatch


def chunks(text: str) -> list[str]:
    """Strings whose token ids, in a row, are those of ``text``.

    The tokenizer drops white space, never joins across it, lower-cases, and splits letters from punctuation.
    """
    t = text.replace("\n", " ").replace("\t", " ").replace("\r", " ")
    if "<|" not in t and (t.isascii() or not _MARKS.search(t)):
        t = t.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    if not _RUNS.search(t):
        t = t.replace(", ", " , ").replace(". ", " . ")
    return t.split(" ")


class _Index(dict):
    """Numbers of chunks in order of appearance; the unknown are numbered when they are asked for."""

    def __missing__(self, chunk: str) -> int:
        n = self[chunk] = len(self)
        self.new.append(chunk)
        return n


@functools.lru_cache(1)
def _byte_letters() -> list[str]:
    """The letter by which byte-level vocabularies write each byte: printable Latin-1 as it is, the rest above 255."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    at = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
    return [at[b] for b in range(256)]


class Encoder:
    """Token ids of texts, with the ids of their chunks remembered.

    ``remembered`` bounds the chunks kept from call to call and changes no result.
    """

    def __init__(self, path: str, remembered: int = 300_000):
        self.path, self.remembered = path, remembered
        self.clear()

    def clear(self) -> None:
        self.index = _Index()
        self.index.new = []
        self.starts, self.sizes, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def learn(self) -> None:
        """Token ids of the new chunks: a lower-case Latin word goes straight to the model, anything else the whole way."""
        new, self.index.new = self.index.new, []
        whole = _tokenizer(self.path)
        word, letters = whole.model.tokenize, _byte_letters()
        ids: list[list[int]] = [()] * len(new)
        other = []
        for k, c in enumerate(new):
            if _PLAIN_WORD(c):
                ids[k] = [t.id for t in word(c if c.isascii() else "".join([letters[b] for b in c.encode()]))]
            elif c:
                other.append(k)
        for k, e in zip(other, whole.encode_batch_fast([new[k] for k in other], add_special_tokens=False)):
            ids[k] = e.ids
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.flat = np.concatenate([self.flat, np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(sizes.sum()))])

    def __call__(self, texts: list[str], end: int) -> list[np.ndarray]:
        if len(self.index) > self.remembered:
            self.clear()
        number = self.index.__getitem__
        numbers = [list(map(number, chunks(t))) for t in texts]
        if self.index.new:
            self.learn()
        at = np.array(list(itertools.chain.from_iterable(numbers)), np.int64)
        sizes = self.sizes[at]
        before = np.cumsum(sizes) - sizes
        flat = self.flat[np.arange(int(sizes.sum())) + np.repeat(self.starts[at] - before, sizes)]
        edges = np.concatenate([before, [len(flat)]])[np.cumsum([0, *map(len, numbers)])]
        return [np.append(flat[a:b], np.uint32(end)) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]


def cuts(n: int, capacity: int, slack: float) -> list[int]:
    """Lengths of a document's pieces, in order."""
    out = [capacity] * (n // capacity)
    n %= capacity
    while n:
        k = capacity // n
        piece = n if capacity - k * n <= slack * capacity else capacity // (k + 1)
        out.append(piece)
        n -= piece
    return out


class Bins:
    """Open bins by class; ``add`` returns the rows of a bin that it completes."""

    def __init__(self, capacity: int, base: int):
        self.capacity, self.next, self.open = capacity, base, {}

    def add(self, row: list) -> list[list]:
        k = self.capacity // row[2]
        rows = self.open.setdefault(k, [])
        rows.append(row)
        if len(rows) < k:
            return []
        return self.close(self.open.pop(k))

    def close(self, rows: list[list]) -> list[list]:
        at = 0
        for r in rows:
            r[5], r[6], at = self.next, at, at + r[2]
        self.next += 1
        return rows

    def rest(self) -> list[list]:
        return [r for rows in self.open.values() for r in rows]


def _sequence_base(level: int, worker: int) -> int:
    """First sequence id of a worker: ids of levels and workers don't meet."""
    return level << 58 | worker << 32


def best_fit(rows: list[list], capacity: int) -> list[list[list]]:
    """Rows by bin, longest first into the fullest bin that takes them."""
    room: list[tuple[int, int]] = []
    bins: list[list[list]] = []
    for r in sorted(rows, key=lambda r: (-r[2], r[0] if r[0] is not None else -1, r[1])):
        k = bisect.bisect_left(room, (r[2], -1))
        left, b = room.pop(k) if k < len(room) else (capacity, len(bins))
        if b == len(bins):
            bins.append([])
        bins[b].append(r)
        if left > r[2]:
            bisect.insort(room, (left - r[2], b))
    return bins


def pack(docs: DataFrame, capacity: int = 4096, end: int = 2, tokenizer: str | None = None, slack: float = 1 / 64) -> DataFrame:
    """One row per piece (columns doc_id and text of ``docs`` are read)."""
    path = tokenizer or tokenizer_path()
    spark = docs.sparkSession
    arrow = _arrow_schema(spark, SCHEMA)

    def batch(rows: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(arrow)], schema=arrow)

    def first(batches):
        worker = TaskContext.get().partitionId()
        encoder, bins = Encoder(path), Bins(capacity, _sequence_base(0, worker))
        for b in pieces(batches, 1, 4 << 20):
            done = []
            for i, ids in zip(b.column(0).to_pylist(), encoder(b.column(1).to_pylist(), end)):
                start = 0
                for n in cuts(len(ids), capacity, slack):
                    crc = zlib.crc32(ids[start : start + n].astype("<u4").tobytes())
                    done += bins.add([i, start, n, crc, len(ids), None, None, worker])
                    start += n
            if done:
                yield batch(done)
        if rest := bins.rest():
            yield batch(rest)

    def later(level: int):
        def run(batches):
            bins, worker = None, None
            for b in batches:
                done = []
                for row in zip(*(c.to_pylist() for c in b.columns)):
                    if row[7] != worker:
                        if bins:
                            done += bins.rest()
                        worker, bins = row[7], Bins(capacity, _sequence_base(level, row[7]))
                    done += bins.add(list(row))
                if done:
                    yield batch(done)
            if bins and (rest := bins.rest()):
                yield batch(rest)

        return run

    def last(level: int):
        def run(batches):
            rows = [list(r) for b in batches for r in zip(*(c.to_pylist() for c in b.columns))]
            bins = Bins(capacity, _sequence_base(level, 0))
            if done := [r for one in best_fit(rows, capacity) for r in bins.close(one)]:
                yield batch(done)

        return run

    packed = cut(docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(first, SCHEMA), "packed")
    done, level = [packed.where("sequence_id is not null")], 1
    workers = packed.agg(F.max("part")).first()[0]
    while workers:  # each round leaves one worker where there were FAN_IN
        workers //= FAN_IN
        open_ = packed.where("sequence_id is null").withColumn("part", F.floor(F.col("part") / FAN_IN))
        dealt = open_.repartitionByRange(workers + 1, "part").sortWithinPartitions("part", "length", "doc_id", "start")
        packed = cut(dealt.mapInArrow(later(level), SCHEMA), "packed")
        done.append(packed.where("sequence_id is not null"))
        level += 1
    done.append(packed.where("sequence_id is null").repartition(1).mapInArrow(last(level), SCHEMA))
    out = done[0]
    for d in done[1:]:
        out = out.unionAll(d)
    return out.drop("part")


def op3_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
