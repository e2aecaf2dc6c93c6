"""Helpers used by several operators: shared scratch tables, word hashing and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: ASCII white space, as Spark and DuckDB regular expressions spell it.
SPACES = r"[\x20\x09-\x0D]+"
_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)
#: Files of a table of few rows at least, and rows that make another file.
FILES, FILE_ROWS = 32, 50_000
_MADE: ContextVar[list | None] = ContextVar("made", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a session on one machine gets a temporary folder where none is set; on a cluster that is an error.
    """
    context = spark.sparkContext
    where = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not where:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="millrace-")
        context.setCheckpointDir(where)
    return where.rstrip("/")


class Scratch:
    """Tables written to the shared folder to cut lineage; ``drop`` removes those no longer read, ``passing`` all that are
    made inside."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        if _MADE.get() is not None:
            _MADE.get().append(self)

    def save(self, df: DataFrame, rows: int | None = None) -> DataFrame:
        """``df`` written and read again.  A table of at most ``rows`` rows gets as many files as these need, and no fewer than there
        are cores, instead of one for each shuffle partition: opening and closing files is most of the time of a small one."""
        if rows is not None:
            df = df.coalesce(max(FILES, self.spark.sparkContext.defaultParallelism, rows // FILE_ROWS))
        self._n += 1
        path = f"{self.root}/t{self._n}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        self._delete(*[t._scratch_path for t in tables])

    def _delete(self, *paths: str) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for p in paths:
            path = jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(conf).delete(path, True)


@contextmanager
def passing() -> Iterator[None]:
    """Removes every scratch table that operators make inside; results that are wanted later are written inside as well, by
    a ``Scratch`` made before."""
    made = []
    token = _MADE.set(made)
    try:
        yield
    finally:
        _MADE.reset(token)
        for scratch in made:
            scratch._delete(scratch.root)


def sample_labelled(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, per_class: int, max_chars: int, total_chars: int):
    """At most ``per_class`` texts and ``total_chars`` characters of each label 0 and 1, as rows (k, t, y), collected for training.

    The keys are chosen from the label table by their hash; that list is bounded by ``2 * per_class`` rows, so it is
    broadcast and one scan of the texts is enough.  Texts that are null, empty or over ``max_chars`` are left out.
    """
    marks = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(label).alias("y"))
    chosen = None
    for y in (0, 1):
        part = marks.where(F.col("y") == y).orderBy(F.xxhash64("k"), "k").limit(per_class)
        chosen = part if chosen is None else chosen.union(part)
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.length("t").between(1, max_chars))
    # the window orders the sample alone, which the keys and the longest text bound
    ahead = W.partitionBy("y").orderBy(F.xxhash64("k"), "k", "t")
    got = rows.join(F.broadcast(chosen), "k").withColumn("sum", F.sum(F.length("t")).over(ahead)).where(F.col("sum") <= total_chars)
    return sorted(got.select("k", "t", "y").collect(), key=lambda r: (xxhash.xxh64_intdigest(str(r.k)), r.y, r.t))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64, so that nearby inputs spread over all bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_hashes(words: list[bytes], seed: int = 0) -> np.ndarray:
    """One 64-bit hash per word; the same in every process."""
    digest = xxhash.xxh3_64_intdigest
    if seed:
        return np.fromiter((digest(w, seed) for w in words), dtype=np.uint64, count=len(words))
    return np.fromiter(map(digest, words), dtype=np.uint64, count=len(words))


class Segments:
    """Hashes of runs of consecutive entries of h, from differences of prefix sums."""

    def __init__(self, h: np.ndarray):
        n = len(h)
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n - 1, 0), _ODD, np.uint64)]), dtype=np.uint64)[:n]
        self._back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n - 1, 0), _INVERSE, np.uint64)]), dtype=np.uint64)[:n]
        self._total = np.concatenate([[np.uint64(0)], np.cumsum(h * power, dtype=np.uint64)])

    def at(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix64((self._total[stop] - self._total[start]) * self._back[start] + (stop - start).astype(np.uint64))


def connected_components(scratch: Scratch, edges: DataFrame, a: str, b: str, rows: int | None = None) -> DataFrame:
    """(id, component): smallest id reachable over undirected edges, for ids that have an edge.

    Alternates large-star and small-star steps (Kiveris et al., 2014) until every id has one edge, to an id that has none
    to a smaller one.  Minima are pre-aggregated and written, so that they are joined to the edges as two plain tables and
    Spark can split a hub with many links.  Every round is a written table; nothing is gathered on the driver.  ``rows`` is
    the number of edges, if that is known.
    """
    rows = None if rows is None else 2 * rows  # both ways
    cur = scratch.save(
        edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), rows
    )
    while True:
        both = cur.select("u", "v").union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = scratch.save(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), rows)
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.save(large.where("u != v"), rows)
        mins = scratch.save(large.groupBy("u").agg(F.min("v").alias("m")), rows)
        small = large.join(mins, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(mins.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        nxt = scratch.save(small, rows)
        scratch.drop(cur, low, large, mins)
        cur = nxt
        several = cur.groupBy("u").agg(F.count("*").alias("c")).where("c > 1")
        if several.isEmpty() and cur.select(F.col("v").alias("u")).distinct().join(cur, "u", "left_semi").isEmpty():
            break
    pairs = cur.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return pairs.union(cur.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()
