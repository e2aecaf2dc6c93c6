"""Directory trees and the cache entries in them as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import codecs


def tree(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """(path, size, modified[, content]) of all files below ``root``, listed in parallel by Spark's file source."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    keep = [F.col("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified")]
    return files.select(*keep, *([F.col("content")] if content else []))


def children(spark: SparkSession, folder: str) -> DataFrame:
    """(name, size, modified) of the files that lie directly in ``folder``."""
    files = spark.read.format("binaryFile").load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def enumerated(spark: SparkSession, folder: str) -> DataFrame:
    """(name, is_folder, size, modified) of what lies directly in ``folder``: its files, and folders with the sum of the sizes
    and the newest time of all files below them.  What Spark's file source passes over is left out: empty files,
    folders without a filled one, and hidden names (``_x``, ``.x``)."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    root = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toUri().getPath().rstrip("/")
    below = F.split(F.regexp_replace("path", "^[A-Za-z0-9+.-]+:(//[^/]*)?" + "".join("\\x{%x}" % ord(c) for c in root) + "/", ""), "/")
    found = tree(spark, folder).select(below[0].alias("name"), (F.size(below) > 1).alias("is_folder"), "size", "modified")
    return found.groupBy("name", "is_folder").agg(F.sum("size").alias("size"), F.max("modified").alias("modified"))


def entries(spark: SparkSession, root: str) -> DataFrame:
    """(path relative to ``root``, size, exit_code, stdout, stderr, files) of a cache's entry files; damaged ones have nulls."""
    found = tree(spark, root, content=True)
    return found.select(relative(F.col("path"), root).alias("path"), "size", codecs.unpack_entry("content").alias("e")).select("path", "size", "e.*")


def relative(path: Column, root: str) -> Column:
    return F.regexp_replace(path, "^.*?" + "\\Q" + root.rstrip("/") + "\\E/", "")


def stray(files: DataFrame, root: str, depth: int = 4) -> DataFrame:
    """Files that do not lie exactly ``depth`` levels below the root; they are reported, never deleted."""
    return files.where(F.size(F.split(relative(F.col("path"), root), "/")) != depth)


def compiler_dirs(paths: DataFrame, bundles: DataFrame) -> DataFrame:
    """Directories to search for compilers: given ones, ``<bundle>/bin`` and the numbered toolsets, first mention first."""
    numbered = paths.sparkSession.range(1, 100).select(F.concat(F.lit("/opt/rh/devtoolset-"), F.col("id").cast("string"), F.lit("/root/bin")).alias("directory"))
    every = paths.select("directory", F.lit(0).alias("rank")).union(bundles.select(F.concat("directory", F.lit("/bin")), F.lit(1))).union(numbered.select("directory", F.lit(2)))
    return every.groupBy("directory").agg(F.min("rank").alias("rank"))
