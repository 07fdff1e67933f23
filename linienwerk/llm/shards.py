"""Committing files that tasks write: temporary names, a manifest, then final names.

A task writes each file under a name of its own attempt and reports it. Only
the reports of attempts that Spark accepted reach the manifest, so files of
lost or doubled attempts are never renamed. Renaming can be repeated.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from linienwerk.shared import drop_dir, open_fs

#: What a task reports of each file that it has closed.
MANIFEST = "shard long, roll long, tmp string, name string, n_records long, n_bytes long, n_items long, extra string"


class AttemptFile:
    """A file under a temporary name; close() gives its row of the manifest."""

    def __init__(self, out_dir: str, shard: int, roll: int, name: str, extra: str = ""):
        self.system, root = open_fs(out_dir)
        self.tmp = f"_tmp/{name}.{uuid.uuid4().hex}"
        self.system.create_dir(posixpath.join(root, "_tmp"), recursive=True)
        self.stream = self.system.open_output_stream(posixpath.join(root, self.tmp), compression=None)
        self.row = {"shard": shard, "roll": roll, "tmp": self.tmp, "name": name, "n_records": 0, "n_bytes": 0, "n_items": 0, "extra": extra}

    def write(self, data: bytes, records: int = 1, items: int = 0) -> int:
        """Appends; returns the offset at which the data begin."""
        at = self.row["n_bytes"]
        self.stream.write(data)
        self.row["n_bytes"] += len(data)
        self.row["n_records"] += records
        self.row["n_items"] += items
        return at

    def close(self) -> dict:
        self.stream.close()
        return self.row


def commit(reports: DataFrame, out_dir: str) -> DataFrame:
    """Runs the writing job, keeps its reports as the manifest, renames the files, and returns the manifest."""
    spark = reports.sparkSession
    reports.write.parquet(f"{out_dir}/_reports")
    kept = spark.read.parquet(f"{out_dir}/_reports")

    def rename(batches: Iterator) -> Iterator:
        system, root = open_fs(out_dir)
        for pdf in batches:
            for tmp, name in zip(pdf.tmp, pdf.name, strict=True):
                src, dst = posixpath.join(root, tmp), posixpath.join(root, name)
                if system.get_file_info(src).type != fs.FileType.NotFound:
                    system.move(src, dst)
                elif system.get_file_info(dst).type == fs.FileType.NotFound:
                    raise FileNotFoundError(f"{name}: neither its temporary nor its final name exists")
            yield pdf

    kept.repartition(max(1, spark.sparkContext.defaultParallelism)).mapInPandas(rename, kept.schema).drop("tmp").write.parquet(f"{out_dir}/_manifest")
    drop_dir(f"{out_dir}/_tmp")  # what lost attempts left
    return spark.read.parquet(f"{out_dir}/_manifest").orderBy("shard", "roll")


def spread(manifest: DataFrame) -> DataFrame:
    """One file of the manifest for each task, as far as there are tasks."""
    spark = manifest.sparkSession
    return manifest.select("shard", "roll", "name", *[c for c in manifest.columns if c not in ("shard", "roll", "name")]).repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), F.col("name"))
