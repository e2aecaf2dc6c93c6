"""Running a stream over what is there now, and reading what it wrote."""

from __future__ import annotations

import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

#: State store that keyed state with timers needs.
_STORE, _ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STARTING = threading.Lock()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only on one machine, where none is configured."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="millrace-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def start(spark: SparkSession, writer: DataStreamWriter) -> StreamingQuery:
    """Start a stream with keyed state.  A stream takes the session's settings as it starts, so they are changed for that
    moment alone, by one thread at a time."""
    with _STARTING:
        before = spark.conf.get(_STORE, None)
        spark.conf.set(_STORE, _ROCKS)
        try:
            return writer.start()
        finally:
            spark.conf.set(_STORE, before) if before else spark.conf.unset(_STORE)


def available_now(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Write all available input through ``stream`` to Parquet in the shared folder and read it back; its state is removed."""
    spark = stream.sparkSession
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{root}/state").option("path", f"{root}/out")
    start(spark, writer.trigger(availableNow=True)).awaitTermination()
    state = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/state")
    state.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(state, True)
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table as a file stream."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(f"{sf_dir}/{name[:-1]}[{name[-1]}].parquet")
