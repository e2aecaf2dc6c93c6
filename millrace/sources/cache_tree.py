"""A cache's entries as a table that can be read by key and written as a whole, and the log of its new keys as a stream.

Entries lie at ``<batch>/<d0>/<d1>/<name>`` below a root in any file system that Arrow reaches.  A write makes one batch per
task, so that a commit is one rename for each task; of a key's entries the one of the newest batch counts.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage

#: Sub-directories on each of two levels.
WIDTH = 16
#: Milliseconds that an entry of the key log may come late, and that the log is kept.
SLACK, KEPT = 5_000, 3_600_000


def register(spark: SparkSession) -> None:
    """Make ``millrace_cache`` and ``millrace_key_log`` known to the session, with filters handed to the source."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CacheTree)
    spark.dataSource.register(KeyLog)


def place(key: str) -> tuple[str, str]:
    """The two sub-directories of a key, low digit first."""
    h = int(hashlib.md5(key.encode()).hexdigest()[:8], 16)
    return f"{h % WIDTH:x}", f"{h // WIDTH % WIDTH:x}"


def _open(path: str):
    """File system and path in it."""
    from pyarrow import fs  # starts threads, so only where files are touched

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def _below(at, folder: str) -> list:
    from pyarrow import fs

    return at.get_file_info(fs.FileSelector(folder, allow_not_found=True))


def _names(at, folder: str, files: bool = False) -> list[str]:
    return sorted(x.base_name for x in _below(at, folder) if x.is_file == files and not x.base_name.startswith("."))


class Part(InputPartition):
    def __init__(self, folders: tuple[str, str], keys: list[str] | None):
        self.folders, self.keys = folders, keys


class CacheTree(DataSource):
    """Options: ``path``, the root, and ``values`` (true), whether contents are read."""

    @classmethod
    def name(cls) -> str:
        return "millrace_cache"

    def schema(self) -> str:
        return "key string, size long, batch string, value binary"

    def reader(self, schema) -> DataSourceReader:
        return TreeReader(self.options["path"], self.options.get("values", "true").lower() == "true")

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return TreeWriter(self.options["path"], schema.names, overwrite)


class TreeReader(DataSourceReader):
    """One partition for each pair of sub-directories. Keys that a query asks for by name are looked up where they belong, and
    a prefix of keys is compared with names before any entry is opened."""

    def __init__(self, path: str, values: bool):
        self.path, self.values = path, values
        self.keys: set[str] | None = None
        self.prefix = ""

    def pushFilters(self, filters: list[Filter]):  # noqa: N802
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("key",):
                asked = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.keys = asked if self.keys is None else self.keys & asked
            elif isinstance(f, StringStartsWith) and f.attribute == ("key",) and (f.value.startswith(self.prefix) or not self.prefix):
                self.prefix = f.value
            elif isinstance(f, IsNotNull) and f.attribute == ("key",):
                continue  # every entry has a key
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        if self.keys is None:
            digits = [f"{d:x}" for d in range(WIDTH)]
            return [Part((a, b), None) for a in digits for b in digits]
        by_place: dict[tuple[str, str], list[str]] = {}
        for k in sorted(self.keys):
            if k.startswith(self.prefix):
                by_place.setdefault(place(k), []).append(k)
        return [Part(p, keys) for p, keys in by_place.items()] or [Part(("0", "0"), [])]

    def read(self, part: Part) -> Iterator[tuple]:
        at, root = _open(self.path)
        newest: dict[str, tuple[str, str]] = {}
        for batch in _names(at, root):
            folder = "/".join((root, batch, *part.folders))
            if part.keys is None:
                names = _names(at, folder, files=True)
            else:
                asked = [quote(k, safe="") for k in part.keys]
                names = [x.base_name for x in at.get_file_info([f"{folder}/{n}" for n in asked]) if x.is_file]
            for name in names:
                if unquote(name).startswith(self.prefix):
                    newest[unquote(name)] = (batch, f"{folder}/{name}")
        for key, (batch, path) in newest.items():
            if self.values:
                with at.open_input_file(path) as f:
                    value = f.read()
                yield key, len(value), batch, value
            else:
                yield key, at.get_file_info(path).size, batch, None


class Written(WriterCommitMessage):
    def __init__(self, folder: str):
        self.folder = folder


class TreeWriter(DataSourceWriter):
    """Writes rows (key, value, ...) to a hidden folder for each task; the commit renames these, an abort removes them.

    Rows without a key or a value are left out; of equal keys in a task the last one counts, across tasks any one does, so
    write one row for each key. ``overwrite`` removes all earlier batches once the new ones are in place."""

    def __init__(self, path: str, names: list[str], overwrite: bool):
        self.path, self.key, self.value, self.overwrite = path, names.index("key"), names.index("value"), overwrite
        self.batch = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"

    def write(self, rows: Iterator) -> Written:
        at, root = _open(self.path)
        task = TaskContext.get()
        folder = f"{root}/.{self.batch}-{task.partitionId():06d}-{task.taskAttemptId()}"
        made: set[str] = set()
        for r in rows:
            if r[self.key] is None or r[self.value] is None:
                continue
            below = "/".join((folder, *place(r[self.key])))
            if below not in made:
                at.create_dir(below)
                made.add(below)
            with at.open_output_stream(f"{below}/{quote(r[self.key], safe='')}") as f:
                f.write(bytes(r[self.value]))
        return Written(folder if made else "")

    def commit(self, messages: list[Written | None]) -> None:
        at, root = _open(self.path)
        before = _names(at, root) if self.overwrite else []
        for m in messages:
            if m and m.folder:
                hidden = m.folder.rpartition("/")[2]
                at.move(m.folder, f"{root}/{hidden[1:]}")
        for batch in before:
            at.delete_dir(f"{root}/{batch}")
        self._sweep(at, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._sweep(*_open(self.path))

    def _sweep(self, at, root: str) -> None:
        """Remove what this write's lost or failed tasks have left."""
        for x in _below(at, root):
            if x.base_name.startswith(f".{self.batch}-"):
                at.delete_dir(x.path)


def log_keys(path: str, keys: list[str], at_ms: int) -> str:
    """Append keys to the log as one segment; the name tells its time."""
    where, root = _open(path)
    where.create_dir(root)
    name = f"{at_ms:015d}-{uuid.uuid4().hex[:8]}"
    with where.open_output_stream(f"{root}/.{name}") as f:
        f.write(json.dumps(keys).encode())
    where.move(f"{root}/.{name}", f"{root}/{name}")
    return name


class KeyLog(DataSource):
    """Options: ``path``, the log's folder; ``slack`` and ``kept`` in milliseconds."""

    @classmethod
    def name(cls) -> str:
        return "millrace_key_log"

    def schema(self) -> str:
        return "key string, at_ms long, full boolean"

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return LogReader(self.options["path"], int(self.options.get("slack", SLACK)), int(self.options.get("kept", KEPT)))


class Segment(InputPartition):
    def __init__(self, name: str, full: bool):
        self.name, self.full = name, full


class LogReader(DataSourceStreamReader):
    """Fetches what is new since the last offset, or the whole log that is kept if that is longer ago than the log is kept.

    An offset is the newest segment's time and the names of the segments of the ``slack`` before it: a segment that comes late
    within it is fetched by the next batch, and none twice. ``full`` marks rows of a full fetch, which replace what is known."""

    def __init__(self, path: str, slack: int, kept: int):
        self.path, self.slack, self.kept = path, slack, kept

    def _segments(self) -> list[str]:
        return _names(*_open(self.path), files=True)

    def initialOffset(self) -> dict:  # noqa: N802
        return {"since": -1, "seen": []}

    def latestOffset(self) -> dict:  # noqa: N802
        names = self._segments()
        since = max((int(n[:15]) for n in names), default=-1)
        return {"since": since, "seen": [n for n in names if int(n[:15]) >= since - self.slack]}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        full = start["since"] < 0 or end["since"] - start["since"] > self.kept
        first = end["since"] - self.kept if full else start["since"] - self.slack
        out = []
        for n in self._segments():
            t = int(n[:15])
            known = n in end["seen"] or t < end["since"] - self.slack
            if t >= first and known and (full or n not in start["seen"]):
                out.append(Segment(n, full))
        return out

    def read(self, part: Segment) -> Iterator[tuple]:
        at, root = _open(self.path)
        with at.open_input_file(f"{root}/{part.name}") as f:
            for key in json.loads(f.read()):
                yield key, int(part.name[:15]), part.full

    def commit(self, end: dict) -> None:
        """Segments stay for other readers; the log's owner drops them once they are older than it is kept."""
