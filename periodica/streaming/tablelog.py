"""A keyed table as a log of batches: updates and deletes are rows, a manifest says what counts, compaction goes by bucket.

``append`` writes a batch's rows in buckets of their keys to a folder of its own and then publishes the batch's manifest, at once. A batch
that is written and not published is never read, and one that is published already is not written again, so a batch may run any number
of times. ``current`` reads the folders that count for the buckets it needs: the rest is neither listed nor opened. ``compact`` replaces the folders
of some buckets by one; readers of the old ones are left alone until ``vacuum``. One writer at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyarrow import fs as stores
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from periodica.sources import sinks
from periodica.streaming.ingest import latest

class TableLog:
    """A table at ``at`` with one row for each value of ``keys``, the newest by ``order``; of equals that of the later batch."""

    def __init__(self, spark: SparkSession, at: str, keys: list[str], order: str, buckets: int = 16):
        self.spark, self.at, self.keys, self.order, self.buckets = spark, at.rstrip("/"), keys, order, buckets
        self.store, self.root = sinks.opened(self.at)
        self.store.create_dir(f"{self.root}/_log", recursive=True)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*(F.col(k) for k in self.keys)), F.lit(self.buckets)).cast("int")

    def _path(self, n: int) -> str:
        return f"{self.root}/_log/{n:012}.json"

    def manifests(self) -> list[dict]:
        files = sorted(f.path for f in self.store.get_file_info(stores.FileSelector(f"{self.root}/_log")) if f.path.endswith(".json"))
        found = []
        for path in files:
            with self.store.open_input_stream(path) as f:
                found.append(json.loads(f.read()))
        return found

    def live(self) -> dict[int, list[str]]:
        """Of each bucket the folders that count, oldest first."""
        found: dict[int, list[str]] = {}
        for m in self.manifests():
            for b in m["replaces"]:
                found[b] = []
            for b in m["buckets"]:
                found.setdefault(b, []).append(m["folder"])
        return found

    def _write(self, rows: DataFrame, n: int, replaces: list[int]) -> None:
        folder = f"data-{uuid.uuid4().hex}"
        rows.withColumn("_bucket", self._bucket()).write.partitionBy("_bucket").parquet(f"{self.at}/{folder}")
        written = self.store.get_file_info(stores.FileSelector(f"{self.root}/{folder}"))
        buckets = sorted(int(f.base_name.split("=")[1]) for f in written if f.base_name.startswith("_bucket="))
        said = {"batch": n, "folder": folder, "buckets": buckets, "replaces": replaces, "schema": rows.schema.jsonValue(), "keys": self.keys, "of": self.buckets}
        sinks._publish(self.store, self._path(n), json.dumps(said).encode())

    def append(self, batch: DataFrame, n: int, deleted: Column | None = None) -> bool:
        """Publish batch ``n``; rows where ``deleted`` holds delete their key. False where the batch was published before."""
        if sinks._exists(self.store, self._path(n)):
            return False
        said = self.manifests()[:1]
        if said and (said[0]["of"], said[0]["keys"]) != (self.buckets, self.keys):
            raise ValueError("the table has other keys or buckets")
        if said:  # the first batch says what columns there are
            schema = [f for f in StructType.fromJson(said[0]["schema"]) if f.name not in ("_deleted", "_batch")]
            if more := set(batch.columns) - {f.name for f in schema}:
                raise ValueError(f"columns that the table doesn't have: {sorted(more)}")
            batch = batch.select(*((F.col(f.name) if f.name in batch.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))
        gone = F.lit(False) if deleted is None else F.coalesce(deleted, F.lit(False))
        rows = batch.withColumn("_deleted", gone).withColumn("_batch", F.lit(n).cast("long"))
        self._write(latest(rows, self.keys, F.struct(F.col(self.order), F.xxhash64(*batch.columns))), n, [])
        return True

    def sink(self, deleted: Column | None = None) -> Callable[[DataFrame, int], None]:
        """For ``foreachBatch``."""
        return lambda batch, n: self.append(batch, n, deleted) and None

    def _rows(self, buckets: list[int] | None = None) -> DataFrame | None:
        said = self.manifests()[:1]
        if not said:
            return None
        paths = [f"{self.at}/{folder}/_bucket={b}" for b, folders in self.live().items() if buckets is None or b in buckets for folder in folders]
        schema = StructType.fromJson(said[0]["schema"])
        rows = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        return latest(rows, self.keys, F.struct(F.col(self.order), F.col("_batch")))

    def current(self, of: DataFrame | None = None) -> DataFrame:
        """The table, or its rows for the keys of ``of``, for which only the buckets of these keys are read."""
        buckets = None
        if of is not None and (said := self.manifests()[:1]):
            types = StructType.fromJson(said[0]["schema"])
            of = of.select(*(F.col(k).cast(types[k].dataType).alias(k) for k in self.keys))  # a key's bucket depends on its type
            # at most as many values as there are buckets
            buckets = [r[0] for r in of.select(self._bucket()).distinct().collect()]
        rows = self._rows(buckets)
        if rows is None:
            raise ValueError(f"nothing was published at {self.at}")
        found = rows.where("not _deleted").drop("_deleted", "_batch")
        return found if of is None else found.join(of.select(*self.keys).distinct(), self.keys, "left_semi")

    def compact(self, n: int, buckets: list[int] | None = None, forget: Column | None = None) -> bool:
        """Publish, as batch ``n``, the newest row of each key in place of the folders of ``buckets`` (of all).

        Deletes stay as rows, so that what is late can't bring a key back; those where ``forget`` holds go.
        """
        if sinks._exists(self.store, self._path(n)):
            return False
        chosen = sorted(self.live() if buckets is None else buckets)
        rows = self._rows(chosen)
        if rows is None:
            return False
        if forget is not None:
            rows = rows.where(~(F.col("_deleted") & F.coalesce(forget, F.lit(False))))
        self._write(rows, n, chosen)
        return True

    def vacuum(self) -> int:
        """Delete the folders that count for no bucket, of compacted batches and of those never published; run by the writer between batches."""
        counts = {f for folders in self.live().values() for f in folders}
        gone = [f for f in self.store.get_file_info(stores.FileSelector(self.root)) if f.base_name.startswith("data-") and f.base_name not in counts]
        for f in gone:
            self.store.delete_dir(f.path)
        return len(gone)
