"""The shared folder of the cluster, tables cut out of a lineage, and files written by executors.

The shared folder is ``spark.checkpoint.dir``, read from the session.  Only where it is unset and
the master is local (tests, a laptop) a folder under the machine's temporary directory is
set; on a cluster without the setting nothing is written and an error says so.
Paths are URIs: ``file:`` and bare paths use the local file system, any other scheme
goes through ``pyarrow.fs``.
"""

from __future__ import annotations

import contextlib
import os
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not re.match(r"local(\[|$)", master):
            raise ValueError(f"spark.checkpoint.dir is not set: {master} has no folder that all executors share")
        found = f"file://{tempfile.gettempdir()}/checkpoints/{uuid.uuid4().hex}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Folders written inside each open ``scratch``, innermost last.
_SCRATCHES: list[list[str]] = []


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there and a
    lost executor costs no recomputation of what came before."""
    spark = df.sparkSession
    path = new_path(spark, name)
    for made in _SCRATCHES[-1:]:
        made.append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def gathered(manifest: DataFrame) -> DataFrame:
    """Run what ``manifest`` describes once and hold its rows, one a partition, on the driver: files
    have been written then, and reading the manifest again doesn't write them again."""
    return manifest.sparkSession.createDataFrame(manifest.collect(), manifest.schema)


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing reads any more."""
    for table in tables:
        remove(table.sparkSession, table.stored_at)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Deletes the tables materialised inside it at its end; take a path out of the list
    (or ``keep`` a table) to let it stay."""
    made: list[str] = []
    _SCRATCHES.append(made)
    try:
        yield made
    finally:
        _SCRATCHES.pop()
        for path in made:
            remove(spark, path)


def keep(made: list[str], table: DataFrame) -> DataFrame:
    """``table``, which outlives the ``scratch`` it was materialised in."""
    made.remove(table.stored_at)
    return table


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared directory once nothing reads it any more."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def free_name(name: str, *frames: DataFrame) -> str:
    """A column name that none of the tables has, whatever the case."""
    taken = {c.lower() for frame in frames for c in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _local(uri: str) -> str | None:
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return None if re.match(r"[A-Za-z][A-Za-z0-9+.-]*://", uri) else uri


class AtomicFile:
    """A file that appears under its name only when it is complete, so a task that is run
    again or killed half-way leaves either the whole file or none."""

    def __init__(self, uri: str):
        self.path = _local(uri)
        self.fs = None
        if self.path is None:
            from pyarrow import fs

            self.fs, self.path = fs.FileSystem.from_uri(uri)
        self.temporary = f"{self.path}.{uuid.uuid4().hex}.tmp"

    def __enter__(self):
        if self.fs is None:
            os.makedirs(os.path.dirname(self.path), exist_ok=True)
            self.handle = open(self.temporary, "wb")
        else:
            self.fs.create_dir(os.path.dirname(self.path), recursive=True)
            self.handle = self.fs.open_output_stream(self.temporary)
        return self.handle

    def __exit__(self, kind, *_):
        self.handle.close()
        if kind is not None:
            return
        if self.fs is None:
            os.replace(self.temporary, self.path)
        else:
            self.fs.move(self.temporary, self.path)


def open_input(uri: str):
    """A seekable binary file object."""
    path = _local(uri)
    if path is not None:
        return open(path, "rb")
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)
