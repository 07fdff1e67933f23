"""The shared folder of a job: where intermediate tables and written files go.

Everything that must outlive a lost executor is written below
``spark.checkpoint.dir``. Only where that setting is unset and the session runs
in one process (tests) a folder of the local machine is taken.
"""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager, nullcontext

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """URI of the folder that driver and executors share."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="linienwerk-")
        spark.sparkContext.setCheckpointDir(_LOCAL[app])
    return _LOCAL[app]


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new, unused folder below the shared one."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI; a bare path is a local one."""
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def drop_dir(uri: str) -> None:
    system, path = open_fs(uri)
    if system.get_file_info(path).type != fs.FileType.NotFound:
        system.delete_dir(path)


#: Whether Spark drops a query's shuffle files at its end; else they stay until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Queries run inside leave no shuffle files."""
    old = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, old)


class Stash:
    """Tables written to the shared folder to cut a lineage.

    Unlike a local checkpoint they survive the executor that wrote them;
    unlike a cached table they are columnar files that later scans can prune.

    With ``merge`` their joins sort both sides. Columnar files look small, and
    loops would send them to the driver to broadcast them in every round.
    With ``tidy`` the shuffle files behind a table go once it is written.
    """

    def __init__(self, spark: SparkSession, name: str, merge: bool = False, tidy: bool = False):
        self.spark, self.root, self.n, self.merge, self.tidy = spark, fresh_dir(spark, name), 0, merge, tidy

    def put(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n:04d}"
        with shuffles_dropped(self.spark) if self.tidy else nullcontext():
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        return out.hint("merge") if self.merge else out

    def drop(self, df: DataFrame) -> None:
        """Delete what put() returned, once nothing reads it any more."""
        for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
            drop_dir(f)
