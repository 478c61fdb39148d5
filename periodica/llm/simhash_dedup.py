"""SimHash near-duplicates by vantage-point trees.

Texts become 64-bit fingerprints over word shingles; equal fingerprints are one point. Points are dealt to shards, a number of
copies each that is the same for any number of points, and shards of over ``most`` points are dealt again. Each shard grows a
vantage-point tree over its points: they are split by their Hamming distance to a vantage point, a point also visits the side
that the triangle bound cannot rule out, and leaves are compared exactly. A shard returns the components of its pairs
instead of the pairs, and the components of all shards are joined to the final classes.

Links within ``max_bits`` of Hamming distance: the bits are cut into ``max_bits + 1`` blocks, of which one must be equal, so a
point goes to one shard per block, and no pair is lost. The points of a shard agree in the block; a shard of too many is dealt
again by the blocks of the other bits, until so few bits are free that it can't hold more than ``most``.

With ``similarity`` the fingerprints only find candidates: texts of equal shingle sets are one point, and a candidate pair is
linked if the Jaccard similarity of its distinct shingles reaches the bound. So similar texts differ in ten bits or more, where
no equal block is left, so shards come from ``bands`` sketches of ``rows`` least hashes each, equal with probability
``similarity ** rows``: of pairs at 0.8, 16 bands of 5 rows miss one in 570, of pairs at 0.85 one in 12,000. Pairs with an end
of few candidates are joined with both sets of shingles by id; points of many candidates are compared by groups, which need a
row a point, not a pair. A shard of over ``most`` points, such as a large group of near copies, is not read by one task: all
its points are compared with one of them (the pivot), and only those go on that may be linked to a point that it left
apart, by the triangle bound of the Jaccard distance.

Edge cases: null and empty texts have the fingerprint zero and are linked like any other; a text with fewer words than a
shingle has the whole sequence as its only one; rows that repeat share a point; rows without an id get the class of
their fingerprint; an empty table gives no rows; other columns, of whatever name, are ignored by ``classes`` and kept by
``dedup``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from periodica.llm.common import cut, map_rows, table
from periodica.llm.components import components
from periodica.llm.decontamination import _filter, may_have
from periodica.llm.suffix_dedup import mix

BLOCK = 1 << 21  # comparisons at once
LEAF = 32  # points of a tree's leaf
FEW = 8  # candidates of a point that are verified pair by pair
MOST = 1 << 12  # points of a shard that one task reads
SENT = 1 << 20  # keys (8 bytes each) up to which a list of shards is sent to every executor
PIVOTS = 6  # rounds of pivots before what is left of a shard is compared part by part

#: Near copies of five-word shingle similarity 0.8 or more: at 0.8 a pair differs in about 10 bits (deviation 2.9) of the
#: fingerprint of its distinct shingles, and in over 20 once in 3,000 times.
NEAR_COPIES = {"words": 5, "max_bits": 20, "similarity": 0.8, "bands": 16, "rows": 5}


def shingle_hashes(text: str | None, words: int, seed: int) -> list[int]:
    """XXH64 of every shingle of the lower-cased (A-Z) words."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return []
    joined, x = b" ".join(w), xxhash.xxh64_intdigest
    if len(w) <= words:
        return [x(joined, seed)]
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return [x(joined[a:b], seed) for a, b in zip(starts[: len(w) - words + 1].tolist(), ends[words - 1 :].tolist())]


def majority(hashes) -> int:
    """The fingerprint as a signed 64-bit integer: a bit is set if it is in over half of ``hashes``."""
    if not len(hashes):
        return 0
    h = np.array(hashes, "<u8")
    counts = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 16):
        counts += np.unpackbits(h[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id and fp."""

    def rows(ids, texts):
        return {"doc_id": ids, "fp": [majority(shingle_hashes(t, words, 42)) for t in texts]}

    return map_rows(docs.select("doc_id", "text"), rows, "doc_id long, fp long")


def sketches(hashes: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A key per band: the least of ``hashes`` under each of its ``rows`` multipliers."""
    factors = mix(np.arange(1, bands * rows + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)
    least = np.full(bands * rows, (1 << 64) - 1, np.uint64)
    for k in range(0, len(hashes), 4096):
        least = np.minimum(least, (hashes[k : k + 4096, None] * factors).min(0))
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for r in range(rows):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + least[r::rows])
    return key.view(np.int64)


def shingle_sets(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """doc_id, fingerprint of the distinct shingles, their number, their sorted hashes, a hash of these (node), and the sketches."""

    def read(ids, texts):
        sets = [np.unique(np.array(shingle_hashes(t, words, 42), np.uint64)) for t in texts]
        raw = [h.tobytes() for h in sets]
        node = np.array([xxhash.xxh64_intdigest(r) for r in raw], np.uint64).view(np.int64)
        return {"doc_id": ids, "fp": list(map(majority, sets)), "size": list(map(len, sets)), "node": node, "shingles": raw, "shards": [sketches(h, bands, rows) for h in sets]}

    return map_rows(docs.select("doc_id", "text"), read, "doc_id long, fp long, size long, node long, shingles binary, shards array<bigint>", 2 << 20)


def distance(a, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


class Union:
    """Components of the numbers below n."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        a, b = self.root[a], self.root[b]
        while (apart := a != b).any():
            a, b = a[apart], b[apart]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while (up := self.root[self.root]).tobytes() != self.root.tobytes():
                self.root = up
            a, b = self.root[a], self.root[b]


def search(own: np.ndarray, visiting: np.ndarray, fp: np.ndarray, reach: int, pairs, rng, levels: int = 40) -> None:
    """Calls ``pairs(i, j)`` with all i of ``visiting`` and j of ``own`` whose fingerprints differ in ``reach`` bits at most."""
    if not len(own) or not len(visiting):
        return
    if levels and len(own) > LEAF and len(visiting) > LEAF:
        v = fp[own[rng.integers(len(own))]]
        do, dv = distance(fp[own], v).astype(np.int64), distance(fp[visiting], v).astype(np.int64)
        mu = int(np.median(do))
        near, far = dv <= mu + reach, dv + reach > mu
        inner = do <= mu
        work = near.sum() * inner.sum() + far.sum() * (~inner).sum()
        if work < 0.9 * len(own) * len(visiting):
            search(own[inner], visiting[near], fp, reach, pairs, rng, levels - 1)
            search(own[~inner], visiting[far], fp, reach, pairs, rng, levels - 1)
            return
    step = max(1, BLOCK // len(own))
    for k in range(0, len(visiting), step):
        i, j = np.nonzero(distance(fp[visiting[k : k + step], None], fp[None, own]) <= reach)
        if len(i):
            pairs(visiting[k + i], own[j])


def near_pairs(shard: np.ndarray, fp: np.ndarray, reach: int, pairs) -> None:
    """Calls ``pairs(i, j)``, i < j, with all rows of one shard within ``reach``; ``shard`` is sorted."""
    edges = np.flatnonzero(np.concatenate([[True], np.diff(shard) != 0, [True]]))
    size = np.diff(edges)
    # shards of a leaf are compared all at once, row by row further down
    group = np.repeat(np.where(size <= LEAF, np.arange(len(size)), -1), size)
    for k in range(1, min(LEAF, int(size.max(initial=0)))):
        i = np.flatnonzero((group[:-k] == group[k:]) & (group[k:] >= 0))
        if not len(i):
            break
        i = i[distance(fp[i], fp[i + k]) <= reach]
        if len(i):
            pairs(i, i + k)

    def once(i, j):
        up = i < j
        pairs(i[up], j[up])

    for g in np.flatnonzero(size > LEAF):
        at = np.arange(edges[g], edges[g + 1])
        search(at, at, fp, reach, once, np.random.default_rng(1))


def by_shard(rows: DataFrame, find, schema: str) -> DataFrame:
    """``find`` over tables of whole shards, sorted; small shards come many at a time, and no shard is cut."""

    def run(batches):
        held = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = pa.concat_tables([held, t]) if held is not None else t
            shard = t.column("shard").to_numpy()
            if start := int(np.searchsorted(shard, shard[-1])):  # the last shard may go on
                yield from find(t.slice(0, start)).to_batches()
            held = t.slice(start)
        if held is not None and held.num_rows:
            yield from find(held).to_batches()

    return rows.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, schema)


def crowded(rows: DataFrame, most: int) -> DataFrame | None:
    """The shards of over ``most`` rows, or None."""
    found = cut(rows.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > most), "crowded")
    return found if found.limit(1).count() else None


def of_shards(rows: DataFrame, shards: DataFrame, how: str) -> DataFrame:
    shards = shards.select("shard")
    return rows.join(F.broadcast(shards) if shards.count() <= SENT else shards.hint("merge"), "shard", how)


def split_bits(rows: DataFrame, blocks: int) -> DataFrame:
    """Each row in one shard per block of its free bits (``width`` of them, in ``rest``), which then lie fixed."""

    def run(batches):
        for b in batches:
            shard, node, fp, rest, width = (b.column(k).to_numpy(zero_copy_only=False) for k in range(5))
            rest = rest.view(np.uint64)
            for w in np.unique(width).tolist():
                at = np.flatnonzero(width == w)
                r = rest[at]
                for j in range(blocks):
                    low, high = w * j // blocks, w * (j + 1) // blocks
                    one, below = np.uint64(1), np.uint64(low)
                    value = (r >> below) & np.uint64((1 << (high - low)) - 1)
                    left = (r & ((one << below) - one)) | ((r >> np.uint64(high) << below) if high < 64 else np.uint64(0))
                    key = mix(shard[at].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + mix(value * np.uint64(64) + np.uint64(j + 1)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key.view(np.int64)), pa.array(node[at]), pa.array(fp[at]), pa.array(left.view(np.int64)), pa.array(np.full(len(at), w - high + low, np.int32))],
                        names=["shard", "node", "fp", "rest", "width"],
                    )

    return rows.select("shard", "node", "fp", "rest", "width").mapInArrow(run, "shard long, node long, fp long, rest long, width int")


def bit_links(points: DataFrame, max_bits: int, most: int = MOST) -> DataFrame:
    """Links (u, v) that join the points (node, fp) within ``max_bits`` of each other: of every shard its components,
    each node with the smallest one."""
    blocks = max_bits + 1
    rows = cut(split_bits(points.select(F.lit(0).cast("long").alias("shard"), "node", "fp", F.col("fp").alias("rest"), F.lit(64).alias("width")), blocks), "dealt")
    dealt = []
    while hot := crowded(rows.where(F.col("width") > max(most, 1).bit_length() - 1), most):
        dealt.append(of_shards(rows, hot, "left_anti"))
        rows = cut(split_bits(of_shards(rows, hot, "left_semi"), blocks), "dealt")
    for some in dealt:
        rows = rows.unionAll(some)

    def find(t: pa.Table) -> pa.Table:
        node, fp = t.column("node").to_numpy(), t.column("fp").to_numpy().view(np.uint64)
        union = Union(len(fp))
        near_pairs(t.column("shard").to_numpy(), fp, max_bits, union.add)
        least = np.full(len(fp), np.iinfo(np.int64).max)
        np.minimum.at(least, union.root, node)
        least = least[union.root]
        far = least != node
        return pa.table({"u": node[far], "v": least[far]})

    return by_shard(rows.select("shard", "node", "fp"), find, "u long, v long")


def candidates(rows: DataFrame, max_bits: int, similarity: float) -> DataFrame:
    """(shard, u, v) of the points (shard, node, fp, size) of each shard that may be so similar: the pair itself where shard
    is null, else v belongs to group u of the shard. A pair is inside a group if both ends have over ``FEW`` candidates in
    the shard, so that a shard gives no more than ``FEW + 1`` rows a point."""

    def find(t: pa.Table) -> pa.Table:
        shard, node, size = (t.column(k).to_numpy() for k in ("shard", "node", "size"))
        fp = t.column("fp").to_numpy().view(np.uint64)
        degree, union, few = np.zeros(len(fp), np.int64), Union(len(fp)), [(np.zeros(0, np.int64),) * 2]

        def each(do):
            def alike_in_size(i, j):
                ok = np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j]) - 1e-9
                do(i[ok], j[ok])

            near_pairs(shard, fp, max_bits, alike_in_size)

        def count(i, j):
            np.add(degree, np.bincount(i, minlength=len(fp)) + np.bincount(j, minlength=len(fp)), out=degree)

        def split(i, j):
            low = np.minimum(degree[i], degree[j]) <= FEW
            few.append((i[low], j[low]))
            union.add(i[~low], j[~low])

        each(count)
        if degree.any():
            each(split)
        i, j = (np.concatenate([p[k] for p in few]) for k in (0, 1))
        group = np.flatnonzero(np.bincount(union.root, minlength=len(fp))[union.root] > 1)
        return pa.table(
            {
                "shard": pa.concat_arrays([pa.nulls(len(i), pa.int64()), pa.array(shard[group])]),
                "u": np.concatenate([np.minimum(node[i], node[j]), node[union.root[group]]]),
                "v": np.concatenate([np.maximum(node[i], node[j]), node[group]]),
            }
        )

    return by_shard(rows.select("shard", "node", "fp", "size"), find, "shard long, u long, v long")


def alike(common, a, b, similarity: float):
    """Whether sets of ``a`` and ``b`` elements with so many in common have at least that Jaccard similarity."""
    return common * (1 + similarity) >= similarity * (a + b) - 1e-9


def group_roots(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """The first member of each set's component, if sets of at least that similarity are linked; no set is empty."""
    size = np.array(list(map(len, sets)))
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(size)
    root, rest, flat, mark = np.arange(len(sets)), np.arange(len(sets)), codes, np.zeros(codes.max() + 1, bool)
    while len(rest):
        first, rest, flat = rest[0], rest[1:], flat[size[rest[0]] :]
        reached = [first]
        while reached and len(rest):
            v = reached.pop()
            own = codes[ends[v] - size[v] : ends[v]]
            mark[own] = True
            common = np.add.reduceat(mark[flat], np.cumsum(size[rest]) - size[rest], dtype=np.int64)
            mark[own] = False
            hit = alike(common, size[v], size[rest], similarity)
            if hit.any():
                root[rest[hit]] = first
                reached += rest[hit].tolist()
                rest, flat = rest[~hit], flat[np.repeat(~hit, size[rest])]
    return root


def common(a: bytes, b: bytes) -> tuple[int, int, int]:
    """How many elements two sets have in common, and their sizes."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    return len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)


def _group(similarity: float):
    """Links of the rows (node, shingles) of a group, read by one task."""

    def links(rows: pa.Table) -> pa.Table:
        node = rows.column("node").to_numpy()
        root = group_roots([np.frombuffer(r, np.uint64) for r in rows.column("shingles").to_pylist()], similarity)
        far = root != np.arange(len(root))
        return pa.table({"u": node[far], "v": node[root[far]]})

    return links


def verified(found: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (u, v) of the candidates (shard, u, v) whose sets of shingles have at least that similarity."""
    pairs = found.where("shard is null").select("u", "v").distinct()
    members = found.where("shard is not null").select("shard", F.col("u").alias("first"), F.col("v").alias("node"))

    def compare(batches):
        for b in batches:
            ok = [alike(*common(x, y), similarity) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield b.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))

    of = lambda end, name: sets.select(F.col("node").alias(end), F.col("shingles").alias(name)).hint("merge")
    both = pairs.join(of("u", "a"), "u").join(of("v", "b"), "v").select("u", "v", "a", "b")
    inside = members.join(sets.hint("merge"), "node").groupBy("shard", "first").applyInArrow(_group(similarity), "u long, v long")
    return both.mapInArrow(compare, "u long, v long").unionAll(inside)


def pivot_links(members: DataFrame, sets: DataFrame, similarity: float, most: int) -> DataFrame:
    """Links (u, v) that join the points of each crowded shard (shard, node) with sets of at least that similarity.

    In each round a shard's points are compared with its pivot. Points left apart go on to the next, and of those linked
    only the ones that are far enough from the pivot to be linked to one left apart. A shard with no more than ``most`` points
    to go on is read by a task; what is left after ``PIVOTS`` rounds is read in parts of ``most``, two parts to a task.
    """
    active, links = members, None

    def take(df):
        nonlocal links
        links = df if links is None else links.unionAll(df)

    for _ in range(PIVOTS):
        hot = crowded(active, most)
        small = of_shards(active, hot, "left_anti") if hot else active
        take(small.join(sets.hint("merge"), "node").select("shard", "node", "shingles").groupBy("shard").applyInArrow(_group(similarity), "u long, v long"))
        if not hot:
            return links
        active = of_shards(active, hot, "left_semi")
        pivots = active.groupBy("shard").agg(F.min_by("node", F.xxhash64("node")).alias("pivot"))
        pivots = cut(pivots.join(sets.select(F.col("node").alias("pivot"), F.col("shingles").alias("of_pivot")).hint("merge"), "pivot"), "pivots")

        def measure(batches):
            for b in batches:
                sizes = [common(x, y) for x, y in zip(b.column(3).to_pylist(), b.column(4).to_pylist())]
                apart = pa.array([1 - c / max(1, x + y - c) for c, x, y in sizes], pa.float64())
                yield pa.RecordBatch.from_arrays([*b.columns[:3], apart, pa.array([alike(*x, similarity) for x in sizes], pa.bool_())], names=["shard", "node", "pivot", "apart", "linked"])

        with_sets = active.join(sets.hint("merge"), "node").join(pivots.hint("merge"), "shard").select("shard", "node", "pivot", "shingles", "of_pivot")
        seen = cut(with_sets.mapInArrow(measure, "shard long, node long, pivot long, apart double, linked boolean"), "seen")
        take(seen.where("linked and node <> pivot").select(F.col("node").alias("u"), F.col("pivot").alias("v")))
        nearest = seen.where("not linked").groupBy("shard").agg(F.min("apart").alias("nearest"))
        goes_on = F.expr("node <> pivot") & (F.expr("not linked") | (F.col("apart") >= F.col("nearest") - (1 - similarity) - 1e-9))
        active = cut(seen.join(nearest, "shard").where(goes_on).select("shard", "node"), "active")

    # two parts at a time: every pair of points meets, and no task holds more than two parts
    parts = active.join(active.groupBy("shard").agg(F.ceil(F.count("*") / most).cast("int").alias("parts")), "shard")
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    met = parts.select("shard", "node", part.alias("a"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("b"))
    met = met.select("shard", "node", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    take(met.join(sets.hint("merge"), "node").select("shard", "a", "b", "node", "shingles").groupBy("shard", "a", "b").applyInArrow(_group(similarity), "u long, v long"))
    return links


def similar_links(prints: DataFrame, points: DataFrame, max_bits: int, similarity: float, most: int = MOST) -> DataFrame:
    """Links (u, v) that join the points of at least that similarity which share a sketch."""
    rows = cut(points.select(F.explode("shards").alias("shard"), "node", "fp", "size"), "dealt")
    hot = crowded(rows, most)
    cold = of_shards(rows, hot, "left_anti") if hot else rows
    found = cut(candidates(cold, max_bits, similarity), "candidates")
    asked = found.select("u").unionAll(found.select("v"))
    members = None
    if hot:
        members = cut(of_shards(rows, hot, "left_semi").select("shard", "node"), "members")
        asked = asked.unionAll(members.select("node"))
    bloom = prints.sparkSession.sparkContext.broadcast(_filter(asked.distinct()))

    def maybe(batches):
        for b in batches:
            yield b.take(pa.array(may_have(bloom.value, b.column(0).to_numpy(zero_copy_only=False).view(np.uint64))))

    # only sets of candidates are dealt out, one of each
    some = prints.select("node", "shingles").mapInArrow(maybe, "node long, shingles binary")
    sets = cut(some.dropDuplicates(["node"]), "sets")
    links = verified(found, sets, similarity)
    return links.unionAll(pivot_links(members, sets, similarity, most)) if hot else links


def classes(docs: DataFrame, words: int = 3, max_bits: int = 2, similarity: float | None = None, bands: int = 16, rows: int = 5, most: int = MOST) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id that its links reach) of every row of ``docs``.

    Links join fingerprints within ``max_bits``, or, with ``similarity``, texts whose distinct shingles are so similar.
    """
    if similarity is None:
        prints = cut(fingerprints(docs, words).select("doc_id", "fp", F.col("fp").alias("node")), "prints")
        points = cut(prints.groupBy("node").agg(F.first("fp").alias("fp"), F.min("doc_id").alias("rep")), "points")
        links = bit_links(points, max_bits, most)
    else:
        prints = cut(shingle_sets(docs, words, bands, rows), "prints")
        points = cut(prints.groupBy("node").agg(*(F.first(c).alias(c) for c in ("fp", "size", "shards")), F.min("doc_id").alias("rep")), "points")
        links = similar_links(prints, points, max_bits, similarity, most)
    roots = components(links)
    rooted = cut(points.select("node", "rep").join(roots, "node", "left").select("node", "rep", F.coalesce("root", "node").alias("root")), "rooted")
    ids = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = cut(rooted.join(cut(ids, "ids"), "root").select("node", "component_id"), "named")
    return prints.select("doc_id", "fp", "node").join(named, "node").select("doc_id", "fp", "component_id")


def dedup(docs: DataFrame, **params) -> DataFrame:
    """``docs`` with one row of each class: that of the smallest doc_id, and one only if it repeats.

    Rows without an id can't be told apart and stay.
    """
    found = classes(docs, **params)
    kept = cut(found.where(F.col("doc_id") == F.col("component_id")).groupBy("doc_id").agg(F.count("*").alias("copies")), "kept")
    # ids grow with the corpus, so they are never broadcast and the plan is the same at every size
    rows = docs.select("doc_id", F.struct(*docs.columns).alias("row")).join(kept.hint("merge"), "doc_id")
    once = rows.where("copies = 1").select("row.*")
    again = rows.where("copies > 1").select("row.*").dropDuplicates(["doc_id"])
    return once.unionAll(again).unionAll(docs.where("doc_id is null"))


def op8_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    found = classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
