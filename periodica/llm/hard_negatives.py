"""Hard negatives by blocked dense matrix products.

Anchors are numbered and taken in blocks of a bounded size; a block is broadcast, and every task multiplies it with blocks of its own
candidates. Products of whole numbers are exact: in float64 while no sum of products can reach 2^53, in 64-bit integers above, and a
vector whose products no long can hold is an error.

First pass: the best ``positives`` rows of an anchor's label, kept as a running list in each task and merged by anchor. Second pass: for
each positive of score p, the best ``negatives`` rows of other labels whose score n has ``low * p <= 100 * n <= high * p``, again as
running lists that are merged. Lists of all tasks meet by anchor, five or fifteen rows from each task, of which Spark keeps the first
ranks before they are shuffled. A block's lists are all that the driver ever holds.

Edge cases: rows without an id, label or vector, or with a null or non-finite component, take no part. Higher scores come first, ties by
smaller id. Rows of the anchor's own id are not its positives. Rows of one id and one score count once for an anchor, so repeated rows
change nothing; rows of one id and different vectors are candidates of their own. Components that one of two vectors lacks count as
zero. A positive without any row in its window has no row in the result. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from periodica.llm.common import cut, numbered, shared_dir, table

#: Anchors of a block and candidates multiplied at once; the matrix of their scores has 16 MB.
ANCHORS, CANDIDATES = 4096, 512
#: Bytes of a block's vectors at most.
BLOCK_BYTES = 16 << 20
#: Stands for "no row yet".
NONE = np.iinfo(np.int64).min


def matrix(vectors: pa.Array) -> np.ndarray:
    """Lists of whole numbers as rows of int64, shorter ones filled with zeros."""
    sizes = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    width = int(sizes.max(initial=0))
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def scores(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of the rows of ``a`` with those of ``c``, exact; float64 where that is exact."""
    k = min(a.shape[1], c.shape[1])
    a, c = a[:, :k], c[:, :k]
    most = k * max(map(int, (a.max(initial=0), -int(a.min(initial=0))))) * max(map(int, (c.max(initial=0), -int(c.min(initial=0)))))
    if most < 1 << 53:
        return a.astype(np.float64) @ c.astype(np.float64).T
    if most < 1 << 63:
        return a @ c.T
    raise OverflowError("an inner product may exceed a 64-bit integer")


def distinct_parts(ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> list[np.ndarray]:
    """Indices of the rows, repeated rows once, in parts that hold an id once and are ordered by it."""
    order = np.argsort(ids, kind="stable")
    if len(ids) < 2 or (np.diff(ids[order]) != 0).all():
        return [order]
    rows = np.column_stack([ids, labels, vectors])
    _, first = np.unique(rows, axis=0, return_index=True)
    first = first[np.argsort(ids[first], kind="stable")]
    kept = ids[first]
    nth = np.arange(len(kept)) - np.searchsorted(kept, kept)  # the number of the row among those of its id
    return [first[nth == n] for n in range(nth.max() + 1)]


def merged(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``k`` of each row's (score, id), higher scores first, equal pairs once."""
    order = np.lexsort((ids, ~score), axis=-1)
    score, ids = np.take_along_axis(score, order, -1), np.take_along_axis(ids, order, -1)
    same = (score[:, 1:] == score[:, :-1]) & (ids[:, 1:] == ids[:, :-1]) & (score[:, 1:] != NONE)
    if same.any():
        score[:, 1:][same] = NONE
        order = np.lexsort((ids, ~score), axis=-1)
        score, ids = np.take_along_axis(score, order, -1), np.take_along_axis(ids, order, -1)
    return score[:, :k], ids[:, :k]


class Lists:
    """For each of ``n`` rows the best ``k`` (score, id) so far."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score, self.ids = np.full((n, k), NONE), np.zeros((n, k), np.int64)

    def take(self, rows: np.ndarray, found: np.ndarray, allowed: np.ndarray, ids: np.ndarray) -> None:
        """``found``: scores of ``rows`` with candidates whose ids ascend; ``allowed``: which of them count."""
        allowed = allowed & (found >= self.score[rows, -1:])
        some = np.flatnonzero(allowed.any(1))
        if not len(some):
            return
        rows = rows[some]
        left = np.where(allowed[some], found[some].astype(np.int64), NONE)
        at, best, who = np.arange(len(some)), [], []
        for _ in range(min(self.k, left.shape[1])):
            j = left.argmax(1)  # the first of equal scores, so the smallest id
            best.append(left[at, j])
            who.append(ids[j])
            left[at, j] = NONE
        score = np.column_stack([self.score[rows], *best])
        self.score[rows], self.ids[rows] = merged(score, np.column_stack([self.ids[rows], *who]), self.k)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        r, c = np.nonzero(self.score != NONE)
        return r, self.ids[r, c], self.score[r, c]


def _candidates(batches):
    """(ids ascending, labels, vectors) of at most ``CANDIDATES`` rows, an id once in each."""
    for b in batches:
        for k in range(0, b.num_rows, CANDIDATES):
            s = b.slice(k, CANDIDATES)
            ids, labels, vectors = s.column(0).to_numpy(), s.column(1).to_numpy(), matrix(s.column(2))
            for part in distinct_parts(ids, labels, vectors):
                yield ids[part], labels[part], vectors[part]


SCHEMA = "row int, found_id long, score long"


def _out(lists: Lists):
    r, ids, score = lists.rows()
    yield pa.RecordBatch.from_arrays([pa.array(r.astype(np.int32)), pa.array(ids), pa.array(score)], names=["row", "found_id", "score"])


def _first(found: DataFrame, k: int) -> DataFrame:
    """Each row's first ``k``, equal pairs once, with their rank from 1."""
    order = Window.partitionBy("row").orderBy(F.col("score").desc(), "found_id")
    return found.withColumn("rank", F.dense_rank().over(order)).where(F.col("rank") <= k).distinct()


def best_positives(rows: DataFrame, anchors: tuple, k: int) -> DataFrame:
    """(row, found_id, score, rank): the first ``k`` rows of each anchor's label. ``anchors``: a broadcast (ids, labels, vectors)."""

    def run(batches):
        a_ids, a_labels, a_vectors = anchors.value
        lists, of = Lists(len(a_ids), k), {int(x): np.flatnonzero(a_labels == x) for x in np.unique(a_labels)}
        for ids, labels, vectors in _candidates(batches):
            for label in np.unique(labels):
                if (mine := of.get(int(label))) is not None:
                    same = labels == label
                    lists.take(mine, scores(a_vectors[mine], vectors[same]), ids[same] != a_ids[mine][:, None], ids[same])
        yield from _out(lists)

    return _first(rows.select("vec_id", "label", "vector").mapInArrow(run, SCHEMA), k)


def best_negatives(rows: DataFrame, anchors: tuple, windows: tuple, k: int) -> DataFrame:
    """The first ``k`` rows of other labels in each window. ``windows``: a broadcast (anchor's row, least score, largest score), an entry a row."""

    def run(batches):
        _, a_labels, a_vectors = anchors.value
        of, least, most = windows.value
        lists = Lists(len(of), k)
        nth = np.arange(len(of)) - np.searchsorted(of, of)  # windows of one anchor stand together
        turns = [np.flatnonzero(nth == n) for n in range(int(nth.max(initial=-1)) + 1)]
        for ids, labels, vectors in _candidates(batches):
            s = scores(a_vectors, vectors)
            other = a_labels[:, None] != labels
            for w in turns:
                found = s[of[w]] if len(w) < len(s) else s
                lists.take(w, found, other[of[w]] & (found >= least[w, None]) & (found <= most[w, None]), ids)
        yield from _out(lists)

    return _first(rows.select("vec_id", "label", "vector").mapInArrow(run, SCHEMA), k)


def block_rows(width: int, most: int = ANCHORS) -> int:
    return max(1, min(most, BLOCK_BYTES // (8 * max(1, width))))


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, block: int = ANCHORS) -> DataFrame:
    """``RESULT`` for ``rows`` (vec_id long, label long, vector array<long>); ``is_anchor`` says which of them are anchors."""
    spark = rows.sparkSession
    rows = cut(rows.where("vec_id is not null and label is not null and vector is not null"), "vectors")
    anchors = numbered(rows.where(is_anchor).distinct(), F.col("vec_id"), F.col("label"), F.col("vector"))
    width, n = anchors.agg(F.max(F.size("vector")), F.count("*")).first()
    if not n:
        return spark.createDataFrame([], RESULT)
    size = block_rows(width, block)
    anchors = cut(anchors.withColumn("block", F.floor(F.col("number") / size)), "anchors", ["block"])
    path = f"{shared_dir(spark)}/hard-{uuid.uuid4().hex}"
    for b in range(-(-n // size)):
        # one block, of `size` rows at most
        got = pa.Table.from_batches(anchors.where(F.col("block") == b).select("vec_id", "label", "vector").toArrow().to_batches()).combine_chunks()
        ids, labels = got.column(0).to_numpy(), got.column(1).to_numpy()
        sent = spark.sparkContext.broadcast((ids, labels, matrix(got.column(2).chunk(0))))
        near = sorted(tuple(r) for r in best_positives(rows, sent, positives).select("row", "rank", "found_id", "score").collect())
        if not near:
            continue
        of, _, found, score = (np.array(x, np.int64) for x in zip(*near))
        # exact bounds on whole scores: low * p <= 100 * n <= high * p
        least = np.array([-((-low * int(p)) // 100) for p in score], np.int64)
        most = np.array([(high * int(p)) // 100 for p in score], np.int64)
        windows = spark.sparkContext.broadcast((of, least, most))
        pairs = spark.createDataFrame(pa.table({"row": pa.array(np.arange(len(of)), pa.int32()), "anchor_id": ids[of], "positive_id": found, "positive_score": score}))
        hard = best_negatives(rows, sent, windows, negatives).join(F.broadcast(pairs), "row")  # at most `positives` rows an anchor of the block
        hard = hard.select("anchor_id", "positive_id", "rank", F.col("found_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        hard.write.mode("append").parquet(path)
        sent.destroy()
        windows.destroy()
    spark.createDataFrame([], RESULT).write.mode("append").parquet(path)  # so that there is a table without any result too
    return spark.read.schema(RESULT).parquet(path)


def whole_vectors(embeddings: DataFrame) -> DataFrame:
    """The rows that take part: 256 times each component, rounded down; where 7 divides the id, the next of ten labels."""
    fit = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("long")
    vector = F.transform("embedding", lambda x: F.floor(256 * x.cast("double")))
    return embeddings.where(fit & F.col("vec_id").isNotNull() & F.col("label").isNotNull()).select("vec_id", label.alias("label"), vector.alias("vector"))


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    return mine(whole_vectors(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 50 == 0)


#: All anchors with all rows, where that is small.
ORACLE = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS other_id, a.label = r.label AS same, list_dot_product(a.v, r.v)::BIGINT AS score
  FROM rows a JOIN rows r ON a.vec_id <> r.vec_id WHERE a.vec_id % 50 = 0
), positives AS (
  SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, p.other_id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY n.score DESC, n.other_id)::INTEGER AS rank,
  n.other_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
QUALIFY rank <= 3
"""
