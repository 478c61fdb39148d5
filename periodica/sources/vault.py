"""Folders of files: listings, contents, sizes by scope, and what retention lets go (``sinks`` writes, archives and deletes)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _below(root: str) -> int:
    """Where, in a path without its scheme, the part below ``root`` begins (from 1)."""
    return len(re.sub(r"^[a-z]+:/*", "/", root).rstrip("/")) + 2


def listed(spark: SparkSession, root: str) -> DataFrame:
    """path (below ``root``), length and modificationTime of every file, without reading one; roots that begin with _ or . are hidden."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    below = F.regexp_replace("path", r"^[a-z]+:/*", "/")
    at = _below(root)
    return files.select(F.substring(below, at, 1 << 20).alias("path"), "length", "modificationTime").where(~F.col("path").rlike(r"^[_.]"))


def contents(spark: SparkSession, root: str) -> DataFrame:
    """The same with the content; Spark reads the files in as many tasks as there are, each task few at a time."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    at = _below(root)
    return files.select(F.substring(F.regexp_replace("path", r"^[a-z]+:/*", "/"), at, 1 << 20).alias("path"), "length", "content").where(~F.col("path").rlike(r"^[_.]"))


def children(files: DataFrame, path: str = "path") -> DataFrame:
    """level, folder, ``children`` and bytes: how many names stand right below each folder of a path of four levels."""
    part = F.split(path, "/")
    rows = files.select(F.explode(F.sequence(F.lit(0), F.size(part) - 2)).alias("level"), part.alias("p"), "length").where(F.size("p") > 1)
    folder = F.array_join(F.slice("p", F.lit(1), F.col("level") + 1), "/")
    return rows.groupBy("level", folder.alias("folder")).agg(F.count_distinct(F.get("p", F.col("level") + 1)).alias("children"), F.sum("length").alias("bytes"))


def by_year(files: DataFrame, path: str = "path") -> DataFrame:
    """year (of a folder Month-2026; null without), count and bytes, newest first."""
    year = F.nullif(F.regexp_extract(path, r"-(\d{4})(?:/|$)", 1), F.lit("")).try_cast("int")
    return files.groupBy(year.alias("year")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes")).orderBy(F.desc_nulls_last("year"))


def scope_size(files: DataFrame, scope: Column) -> DataFrame:
    return files.where(scope).agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("bytes"))


def expired(files: DataFrame, now: Column, days: int = 60) -> DataFrame:
    """Files older than ``days``: what a purge deletes."""
    return files.where(F.col("modificationTime") < now - F.make_interval(days=F.lit(days)))
