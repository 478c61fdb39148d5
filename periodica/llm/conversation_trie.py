"""A trie of conversation prefixes with sums over subtrees, by heavy-path decomposition.

A node is a distinct sequence of first turns. It is named by its smallest conversation and its depth, so the nodes that one conversation
names are the last ones of its path. Sequences are told apart by 128 bits: the turns' hashes, each salted with its depth, united by
exclusive or along the conversation, in blocks of ``BLOCK`` turns so that a very long conversation is not one task's.

Sums over subtrees: every node's largest child (most members, then the smallest conversation) is its heavy child, and heavy edges form
paths. Runs of heavy edges within one conversation's nodes are found by a window, and the runs are linked to paths by pointer doubling.
As a child that isn't heavy has half of its parent's members at most, a path hangs under at most log2(conversations) others: the paths'
totals are handed to the parents of their tops in that many rounds. A suffix sum along each path, again in blocks, then gives every node
its subtree.

Edge cases: a conversation's turns are ordered by turn, null first, then by role and text; repeated rows are turns of their own. Null role
or text is empty. Rows without a conversation id take no part. An empty table gives no rows, not even a root. Other columns are
ignored. The digest of ended conversations is taken over a stream of sorted chunks, so a node in which very many end needs no memory.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from periodica.llm.common import cut, numbered, table

#: Turns of a conversation, or nodes of a path, that one window reads.
BLOCK = 4096
#: Conversation ids of a chunk of the digest.
CHUNK = 1024
BEFORE = (Window.unboundedPreceding, -1)


def _block(depth: str = "depth") -> Column:
    return F.floor(F.col(depth) / BLOCK)


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, a, b, n_bytes): every turn's place in its conversation from 1, two hashes of role and text, and the text's bytes."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    rows = rows.select("*", *(F.xxhash64(F.lit(s), "role", "text").alias(s) for s in "ab"), F.octet_length("text").cast("long").alias("n_bytes"))
    kept = numbered(rows, F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), keep=["conv_id", "a", "b", "n_bytes"])
    first = kept.groupBy("conv_id").agg(F.min("number").alias("first"))
    return kept.join(first, "conv_id").select("conv_id", (F.col("number") - F.col("first") + 1).alias("place"), "a", "b", "n_bytes")


def rebuilt(places: DataFrame, every: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin alike: the first h turns of conversation c - c % every, then c's own after its first h.

    h is the CRC-32 of c's digits modulo ``most``. Gives the paths (conv_id, depth, a, b, n_bytes) and all conversations (conv_id).
    A turn is copied to ``every`` conversations at most.
    """
    sizes = cut(places.groupBy("conv_id").agg(F.count("*").alias("n")), "sizes")
    base = F.col("conv_id") - F.col("conv_id") % every
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    led = sizes.select("conv_id", base.alias("base"), h.alias("h")).join(sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n")), "base", "left")
    led = led.select("conv_id", "base", "h", F.least("h", F.coalesce("base_n", F.lit(0))).alias("lead"))
    own = places.join(led, "conv_id").where("place > h").select("conv_id", (F.col("place") - F.col("h") + F.col("lead")).alias("depth"), "a", "b", "n_bytes")
    heads = places.where(F.col("place") < most).withColumnRenamed("conv_id", "base")
    lead = heads.join(led, "base").where("place <= h").select("conv_id", F.col("place").alias("depth"), "a", "b", "n_bytes")
    return own.unionAll(lead), sizes.select("conv_id")


def members(paths: DataFrame) -> DataFrame:
    """``paths`` with the 128 bits of the sequence up to each turn (x, y) and up to the turn before it (px, py)."""
    rows = paths.select("conv_id", "depth", _block().alias("block"), "n_bytes", *(F.xxhash64("depth", s).alias(s) for s in "ab"))
    inside = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    blocks = Window.partitionBy("conv_id").orderBy("block").rowsBetween(*BEFORE)
    sums = rows.groupBy("conv_id", "block").agg(*(F.bit_xor(s).alias(s) for s in "ab"))
    earlier = sums.select("conv_id", "block", *(F.coalesce(F.bit_xor(s).over(blocks), F.lit(0)).alias(f"{s}0") for s in "ab"))
    rows = rows.select("*", *(F.bit_xor(s).over(inside).alias(f"{s}1") for s in "ab")).join(earlier, ["conv_id", "block"])
    x, y = (F.col(f"{s}0").bitwiseXOR(F.col(f"{s}1")) for s in "ab")
    return rows.select("conv_id", "depth", "n_bytes", x.alias("x"), y.alias("y"), x.bitwiseXOR(F.col("a")).alias("px"), y.bitwiseXOR(F.col("b")).alias("py"))


def nodes_of(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, parent, n_convs, n_bytes, x, y), the root included, its parent null. ``conversations`` may have no turns."""
    zero = F.lit(0).cast("long")
    root = conversations.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(zero.alias("depth"), zero.alias("x"), zero.alias("y"), "conv_id", "n_convs", zero.alias("n_bytes"), zero.alias("px"), zero.alias("py"))
    made = rows.groupBy("depth", "x", "y").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), *(F.min(c).alias(c) for c in ("n_bytes", "px", "py")))
    found = cut(root.unionAll(made), "nodes")
    up = found.select((F.col("depth") + 1).alias("depth"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("conv_id").alias("parent"))
    return cut(found.join(up, ["depth", "px", "py"], "left").select("conv_id", "depth", "parent", "n_convs", "n_bytes", "x", "y"), "linked")


def heavy_paths(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``n_children`` and the path that each is on, named by its top (top, top_depth)."""
    largest = F.max_by("conv_id", F.struct("n_convs", -F.col("conv_id"))).alias("heavy")
    below = nodes.where("depth > 0").groupBy(F.col("parent").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"), largest)
    heavy = below.select(F.col("heavy").alias("conv_id"), (F.col("depth") + 1).alias("depth"), F.lit(True).alias("is_heavy"))
    known = nodes.join(below.drop("heavy"), ["conv_id", "depth"], "left").join(heavy, ["conv_id", "depth"], "left")
    known = known.withColumns({"n_children": F.coalesce("n_children", F.lit(0).cast("long")), "is_heavy": F.coalesce("is_heavy", F.lit(False))})
    # a run begins where the edge above is light, comes from another conversation's node, or begins a block
    begins = ~F.col("is_heavy") | (F.col("parent") != F.col("conv_id")) | (F.col("depth") % BLOCK == 0)
    inside = Window.partitionBy("conv_id", _block()).orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    known = cut(known.withColumn("run", F.max(F.when(begins, F.col("depth"))).over(inside)), "runs")
    starts = known.where("depth = run").select("conv_id", "run", "is_heavy", "parent")
    runs = starts.where("is_heavy").join(known.select(F.col("conv_id").alias("parent"), (F.col("depth") + 1).alias("run"), F.col("run").alias("to_run")), ["parent", "run"])
    tops = starts.where("not is_heavy").select("conv_id", "run", F.col("conv_id").alias("to"), F.col("run").alias("to_run"), F.lit(True).alias("done"))
    links = cut(tops.unionAll(runs.select("conv_id", "run", F.col("parent").alias("to"), "to_run", F.lit(False).alias("done"))), "links")
    while not (open_ := links.where("not done")).isEmpty():
        onward = links.select(F.col("conv_id").alias("to"), F.col("run").alias("to_run"), F.col("to").alias("next"), F.col("to_run").alias("next_run"), F.col("done").alias("next_done"))
        moved = open_.drop("done").join(onward, ["to", "to_run"]).select("conv_id", "run", F.col("next").alias("to"), F.col("next_run").alias("to_run"), F.col("next_done").alias("done"))
        links = cut(links.where("done").unionAll(moved), "links")
    top = links.select("conv_id", "run", F.col("to").alias("top"), F.col("to_run").alias("top_depth"))
    return cut(known.join(top, ["conv_id", "run"]).drop("run", "is_heavy"), "paths")


def subtree_sums(nodes: DataFrame, values: dict[str, Column]) -> DataFrame:
    """``nodes`` (with their paths) with each value's sum over the node's subtree, itself included."""
    names = list(values)
    valued = nodes.withColumns(values)
    sums = valued.groupBy("top", "top_depth").agg(*(F.sum(n).alias(n) for n in names))
    # the node that a path hangs under, and that node's path
    tops = nodes.where("conv_id = top and depth = top_depth").select("top", "top_depth", "parent")
    at = nodes.select(F.col("conv_id").alias("parent"), (F.col("depth") + 1).alias("top_depth"), F.col("top").alias("up"), F.col("top_depth").alias("up_depth"))
    hung = cut(tops.join(at, ["parent", "top_depth"], "left"), "hung")
    level = cut(sums, "sums")
    totals = level
    while True:
        up = level.join(hung.where("up is not null"), ["top", "top_depth"]).groupBy(F.col("up").alias("top"), F.col("up_depth").alias("top_depth"))
        level = cut(up.agg(*(F.sum(n).alias(n) for n in names)), "sums")
        if level.isEmpty():
            break
        totals = totals.unionAll(level)
    totals = totals.groupBy("top", "top_depth").agg(*(F.sum(n).alias(n) for n in names))
    light = hung.where("parent is not null").join(totals, ["top", "top_depth"]).groupBy(F.col("parent").alias("conv_id"), (F.col("top_depth") - 1).alias("depth"))
    valued = valued.join(light.agg(*(F.sum(n).alias(f"{n}_light") for n in names)), ["conv_id", "depth"], "left")
    valued = valued.withColumns({n: F.col(n) + F.coalesce(f"{n}_light", F.lit(0)) for n in names}).drop(*(f"{n}_light" for n in names)).withColumn("block", _block())
    path = ["top", "top_depth"]
    inside = Window.partitionBy(*path, "block").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
    blocks = Window.partitionBy(*path).orderBy(F.col("block").desc()).rowsBetween(*BEFORE)
    later = valued.groupBy(*path, "block").agg(*(F.sum(n).alias(n) for n in names))
    later = later.select(*path, "block", *(F.coalesce(F.sum(n).over(blocks), F.lit(0)).alias(f"{n}_later") for n in names))
    rows = valued.withColumns({n: F.sum(n).over(inside) for n in names}).join(later, [*path, "block"])
    return rows.withColumns({n: F.col(n) + F.col(f"{n}_later") for n in names}).drop("block", *(f"{n}_later" for n in names))


def ended(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """(depth, x, y, ends_sha256) of the nodes in which conversations end: the digest of their ids, ascending, joined by commas."""
    last = rows.groupBy("conv_id").agg(F.max_by(F.struct("depth", "x", "y"), "depth").alias("last"))
    zero = F.lit(0).cast("long")
    at = conversations.join(last, "conv_id", "left").select("conv_id", *(F.coalesce(f"last.{c}", zero).alias(c) for c in ("depth", "x", "y")))
    chunks = at.groupBy("depth", "x", "y", F.floor(F.col("conv_id") / CHUNK).alias("chunk")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids")  # CHUNK ids at most
    )
    schema = "depth long, x long, y long, ends_sha256 string"

    def run(batches):
        node, digest = None, None
        for b in batches:
            out = []
            for *key, ids in zip(*(b.column(i).to_pylist() for i in range(4))):
                if key == node:
                    digest.update(b"," + ids.encode())
                else:
                    if node:
                        out.append((*node, digest.hexdigest()))
                    node, digest = key, hashlib.sha256(ids.encode())
            if out:
                yield _batch(out)
        if node:
            yield _batch([(*node, digest.hexdigest())])

    def _batch(out):
        return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["depth", "x", "y", "ends_sha256"])

    key = ["depth", "x", "y"]
    return chunks.repartition(*key).sortWithinPartitions(*key, "chunk").select(*key, "ids").mapInArrow(run, schema)


def trie(paths: DataFrame, conversations: DataFrame) -> DataFrame:
    """The nodes of ``paths`` (conv_id, depth from 1, hashes a and b of the turn, n_bytes) and of ``conversations`` without any turn."""
    rows = cut(members(paths), "members")
    nodes = heavy_paths(nodes_of(rows, conversations))
    values = {"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("n_bytes")}
    none = F.lit(hashlib.sha256(b"").hexdigest())
    summed = subtree_sums(nodes, values).join(ended(rows, conversations), ["depth", "x", "y"], "left")
    return summed.select(
        "conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256")
    )


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations as they stand (columns conv_id, turn, role, text)."""
    places = cut(turns(conversations), "turns")
    return trie(places.withColumnRenamed("place", "depth"), places.select("conv_id").distinct())


def op13_conversation_trie(spark, sf_dir: str) -> DataFrame:
    return trie(*rebuilt(cut(turns(table(spark, sf_dir, "conversations")), "turns")))


#: The same nodes by whole prefixes as lists. CRC-32 bit by bit: a character, then seven zeros, are the eight steps of a byte.
ORACLE = """
WITH placed AS (
  SELECT conv_id, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS said,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL
), sizes AS (
  SELECT conv_id, count(*) AS n, conv_id - conv_id % 5 AS base,
    xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
      lambda a, e: xor(xor(a, e) >> 1, 3988292384 * (xor(a, e) & 1))), 4294967295) % 9 AS h
  FROM placed GROUP BY conv_id
), parts AS (
  SELECT s.conv_id, p.place, p.said FROM sizes s JOIN placed p ON p.conv_id = s.base AND p.place <= s.h
  UNION ALL
  SELECT s.conv_id, p.place + 100000, p.said FROM sizes s JOIN placed p ON p.conv_id = s.conv_id AND p.place > s.h
), whole AS (
  SELECT s.conv_id, coalesce(list(p.said ORDER BY p.place) FILTER (p.said IS NOT NULL), []) AS path FROM sizes s LEFT JOIN parts p USING (conv_id) GROUP BY s.conv_id
), members AS (
  SELECT conv_id, len(path) AS n, unnest(range(len(path) + 1)) AS depth, path FROM whole
), nodes AS (
  SELECT path[:depth] AS prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256
  FROM members GROUP BY ALL
), linked AS (
  SELECT c.*, p.conv_id AS parent_conv_id, CASE WHEN c.depth > 0 THEN (c.n_convs - 1) * strlen(c.prefix[c.depth].text) ELSE 0 END AS saved
  FROM nodes c LEFT JOIN nodes p ON p.depth = c.depth - 1 AND p.prefix = c.prefix[:c.depth - 1]
), children AS (
  SELECT depth - 1 AS depth, parent_conv_id AS conv_id, count(*) AS n_children FROM linked WHERE depth > 0 GROUP BY ALL
), counted AS (
  SELECT l.*, coalesce(c.n_children, 0) AS n_children FROM linked l LEFT JOIN children c USING (conv_id, depth)
), above AS (
  SELECT prefix, unnest(range(depth + 1)) AS up, saved, n_children FROM counted
), sums AS (
  SELECT prefix[:up] AS prefix, sum(saved)::BIGINT AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM above GROUP BY ALL
)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 FROM counted JOIN sums USING (prefix)
"""
