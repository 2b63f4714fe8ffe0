"""The folder that driver and executors share, and tables or files kept in it.

The folder is the one named by ``spark.checkpoint.dir``. Where that is unset, local sessions (tests)
make a temporary folder once; on a cluster, where executors have disks of their own, that is an error.

What operators stage stays until its readers are done, which only the caller knows: `scratch` deletes on leaving what was
staged inside it, and `discard` all that a session has staged.
"""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def shared_folder(spark: SparkSession) -> str:
    """URI of the folder that every executor and the driver can reach."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="talkweave-")
        sc.setCheckpointDir(folder)
    return folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"


def bounded_batches(spark: SparkSession) -> None:
    """Limit Arrow batches by bytes: ten thousand whole texts, Spark's default, may be hundreds of megabytes in the JVM and in Python at once."""
    now = spark.conf.get(BATCH_SETTING).rstrip("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)


#: Folders that were made and not deleted yet.
_made: list[str] = []


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh subfolder URI for one run of an operator."""
    _made.append(f"{shared_folder(spark).rstrip('/')}/talkweave/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def discard(spark: SparkSession, folders: list[str] | None = None) -> None:
    """Delete folders from the shared one: all that were made, or those given. Nothing may read them any more."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in list(_made) if folders is None else folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
        if folder in _made:
            _made.remove(folder)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete on leaving what was staged inside, but for what was staged to be kept."""
    before = set(_made)
    try:
        yield
    finally:
        discard(spark, [f for f in _made if f not in before])


def staged(df: DataFrame, name: str, compression: str = "zstd", keep: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: later readers don't recompute it,
    and a lost executor costs a file read, not the lineage. `keep`: scratch() doesn't delete it."""
    spark = df.sparkSession
    folder = new_folder(spark, name)
    if keep:
        _made.remove(folder)
    df.write.option("compression", compression).parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI, on any store that Arrow can open."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def make_folder(uri: str) -> None:
    where, path = file_system(uri)
    where.create_dir(path, recursive=True)


def write_file(uri: str, parts) -> int:
    """Write byte strings to a file; its folder is made if need be. Returns the size."""
    where, path = file_system(uri)
    where.create_dir(os.path.dirname(path), recursive=True)
    size = 0
    with where.open_output_stream(path) as out:
        for part in parts:
            size += len(part)
            out.write(part)
    return size


def open_file(uri: str):
    """A seekable input for range reads."""
    where, path = file_system(uri)
    return where.open_input_file(path)
