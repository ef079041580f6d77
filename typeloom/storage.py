"""Intermediate tables in the folder that all executors share.

Long or iterative plans cut their lineage by writing a Parquet table below ``spark.checkpoint.dir`` and reading it
again. Such a table survives the loss of any executor, carries column pruning and a known size (which is what lets
the planner decide about broadcasts), and an iteration's predecessor can be removed as soon as its successor is written.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_LOCAL_ONLY = "typeloom.local.checkpoint"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; only where it is unset (tests, local mode) a folder of its own."""
    conf = spark.sparkContext.getConf()
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    try:
        own = spark.conf.get(_LOCAL_ONLY)
    except Exception:  # noqa: BLE001 - unset
        own = None
    if not own:
        if not conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="typeloom-")
        spark.conf.set(_LOCAL_ONLY, own)
        spark.sparkContext.setCheckpointDir(own)
    return own


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def balanced(scan: DataFrame) -> DataFrame:
    """A scan with at least as many partitions as the cluster has cores, for costly work on each row.

    Only a plain scan may be passed: counting its partitions then runs nothing. Inputs of many files are left as they are;
    one small file is spread by a shuffle that costs little against the work that follows.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


def open_shared(path: str) -> pa.Table | None:
    """The rows of a small Parquet folder below the shared folder, read inside a task; None where there is none."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    files, at = (fs.LocalFileSystem(), path.removeprefix("file://").removeprefix("file:")) if path.startswith(("/", "file:")) else fs.FileSystem.from_uri(path)
    if files.get_file_info(at).type == fs.FileType.NotFound:
        return None
    parts = sorted(x.path for x in files.get_file_info(fs.FileSelector(at)) if x.path.endswith(".parquet"))
    return pa.concat_tables([pq.ParquetFile(files.open_input_file(x)).read() for x in parts]) if parts else None


def write_shared(path: str, rows: pa.Table) -> None:
    """Writes a small Parquet folder below the shared folder inside a task, for ``open_shared``; whole or not at all, the same again if a task is repeated."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    files, at = (fs.LocalFileSystem(), path.removeprefix("file://").removeprefix("file:")) if path.startswith(("/", "file:")) else fs.FileSystem.from_uri(path)
    files.create_dir(at)
    pq.write_table(rows, part := f"{at}/{uuid.uuid4().hex}.tmp", filesystem=files, use_dictionary=False, compression="none")
    files.move(part, f"{at}/rows.parquet")


class Stage:
    """The intermediate tables of one query. ``keep`` writes one, ``drop`` removes one that nothing reads any more.

    A ``tidy`` stage removes the shuffle files behind a table once it is written, instead of when the driver's garbage is
    next collected: what is read again is the table.
    """

    def __init__(self, spark: SparkSession, name: str, tidy: bool = False):
        self.spark = spark
        self.tidy = tidy
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}
        self._n = 0
        atexit.register(self.close)

    def path(self, label: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{label}"

    def keep(self, df: DataFrame, label: str) -> DataFrame:
        path = self.path(label)
        before = self.spark.conf.get(_CLEANUP, None)
        if self.tidy:
            self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            if self.tidy:
                self.spark.conf.unset(_CLEANUP) if before is None else self.spark.conf.set(_CLEANUP, before)
        again = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(again)] = path
        again._typeloom_path = path
        return again

    def drop(self, df: DataFrame | None) -> None:
        path = getattr(df, "_typeloom_path", None)
        if path:
            _delete(self.spark, path)

    def remove(self, path: str) -> None:
        """Removes what tasks wrote to ``path`` themselves."""
        _delete(self.spark, path)

    def close(self) -> None:
        """At exit; a session that has gone already leaves its folder to the cluster's own clean-up."""
        try:
            _delete(self.spark, self.root)
        except Exception:  # noqa: BLE001
            pass
