"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Whitespace of the word contracts, as a regular expression class.
WS = r"\x20\x09-\x0D"
WORD = rf"[^{WS}]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times inside ``body``.

    A lambda variable is evaluated a single time, whatever the optimizer does with projections.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def pieces(batches: Iterator[pa.RecordBatch], text: int | None = 1, max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slice Arrow batches so that each slice holds about ``max_bytes`` of the text column at most (one row at least)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        step = n if text is None else max(1, min(n, int(n * max_bytes / max(1, batch.column(text).nbytes))))
        for k in range(0, n, step):
            yield batch.slice(k, step)


def map_rows(df: DataFrame, rows: Callable[[list, list], dict[str, list]], schema: str, max_bytes: int = 8 << 20) -> DataFrame:
    """``mapInArrow`` over a frame of (key, text): ``rows(keys, texts)`` returns columns by name.

    Texts reach Python in slices of bounded bytes, so a worker's memory does not follow the batch size.
    """
    spark = SparkSession.getActiveSession()
    arrow = _arrow_schema(spark, schema)

    def run(batches):
        for b in pieces(batches, 1, max_bytes):
            out = rows(b.column(0).to_pylist(), b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def _arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is set (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        import tempfile

        folder = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def cut(df: DataFrame, name: str = "t", partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, *order: Column, keep: list[str] | None = None) -> DataFrame:
    """``df`` (or its columns ``keep``) with ``number``, from 0 in the order given, gapless.

    A range sort numbers the rows of each partition; the partitions' counts, one row each, are summed up and added. No task sees
    more than its range, whatever repeats.
    """
    at = F.monotonically_increasing_id()
    rows = cut(df.sort(*order).select(*(keep or df.columns), at.alias("_at")), "numbered")
    part = F.shiftright("_at", 33)
    sizes = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    # one row a partition of the sort: of a bounded size
    return rows.join(F.broadcast(before), part == F.col("_part")).withColumn("number", F.col("_before") + F.col("_at") - F.shiftleft("_part", 33)).drop("_at", "_part", "_before")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_text(df: DataFrame, change: Callable[[str | None], str | None], text: str = "text", max_bytes: int = 8 << 20) -> DataFrame:
    """``df`` with ``text`` changed value by value; every other column stays, but ``n_chars`` follows the text."""
    arrow = None
    names = df.columns
    at = names.index(text)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(df.schema)
    counts = names.index("n_chars") if "n_chars" in names else None

    def run(batches):
        for b in pieces(batches, at, max_bytes):
            values = [change(t) for t in b.column(at).to_pylist()]
            cols = list(b.columns)
            cols[at] = pa.array(values, arrow.field(at).type)
            if counts is not None:
                old = b.column(at).to_pylist()
                kept = b.column(counts).to_pylist()
                cols[counts] = pa.array([n if v == o else len(v) for n, v, o in zip(kept, values, old)], arrow.field(counts).type)
            yield pa.RecordBatch.from_arrays(cols, schema=arrow)

    return df.mapInArrow(run, df.schema)
