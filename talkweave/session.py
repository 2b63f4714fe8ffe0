"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def importable_on_executors(spark: SparkSession) -> None:
    """Let Python workers import this package when the driver runs outside the repository
    (a deployed cluster has it installed or sent with --py-files)."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in parts:
        env["PYTHONPATH"] = os.pathsep.join([root, *parts])


#: Bytes of an Arrow batch that goes to a Python worker.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Limit Arrow batches by bytes, for the rest of the session, since plans run later than they are made: ten thousand rows, Spark's default, of
    whole texts or pictures may be hundreds of megabytes in a Python worker at once."""
    now = spark.conf.get(BATCH_SETTING).rstrip("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; local sessions without one get a temporary folder."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="talkweave-")
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def materialized(df: DataFrame) -> DataFrame:
    """Computed once, in the shared checkpoint folder, with its lineage cut."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(checkpoint_folder(df.sparkSession))
    return df.checkpoint()


#: Folders that queries have written to and that weren't deleted yet.
_made: list[str] = []


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared one, for files that a query writes and reads back."""
    _made.append(f"{checkpoint_folder(spark)}/talkweave/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def discard(spark: SparkSession) -> None:
    """Delete these folders and all checkpoints of this session. Nothing may read them any more."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path
    for folder in [*_made, *([sc.getCheckpointDir()] if sc.getCheckpointDir() else [])]:
        where = path(folder)
        fs = where.getFileSystem(sc._jsc.hadoopConfiguration())
        fs.delete(where, True)
        if folder in _made:
            _made.remove(folder)
        else:
            fs.mkdirs(where)  # later checkpoints go there too
