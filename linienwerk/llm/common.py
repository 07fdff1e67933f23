"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: The ASCII white space characters, fixed by the contracts.
SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text in order; none for null."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def n_words(text: Column) -> Column:
    """The number of words of a text; 0 for null."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, r"[\x20\x09-\x0D]+"))).cast("long")


def total_bytes(df: DataFrame, column: str) -> int:
    """Bytes of a text column, summed on the executors."""
    return int(df.agg(F.sum(F.octet_length(column))).first()[0] or 0)


def unused(df: DataFrame, name: str) -> str:
    """The name, with as many underscores as it takes to be none of the table's, told without case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def whole_groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Batches that are sorted by integer keys → tables in which no key is cut in two, and where each key begins."""
    held = None
    for b in _with_end(batches):
        t = held if b is None else pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
        if t is None or not len(t):
            continue
        k = np.stack([t.column(c).to_numpy().astype(np.int64) for c in keys])
        cuts = np.append(0, np.flatnonzero((k[:, 1:] != k[:, :-1]).any(0)) + 1)
        if b is None:
            yield t, cuts
        elif len(cuts) > 1:
            yield t.slice(0, int(cuts[-1])), cuts[:-1]
        held = t.slice(int(cuts[-1]))


def _with_end(batches: Iterator) -> Iterator:
    yield from batches
    yield None
