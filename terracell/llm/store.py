"""Intermediate results in the folder that all executors share, and input columns."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under ``spark.checkpoint.dir``, which the session must have set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    return os.path.join(base, f"{name}-{uuid.uuid4().hex}")


class Scratch:
    """Tables written inside a ``with`` block: all go at its end but those to ``keep``.

    What is kept belongs to the block around it, if there is one.  A lazy result must not
    leave the block with a table that goes: write it and keep that.
    """

    _open: list["Scratch"] = []

    def __init__(self):
        self.tables: dict[str, SparkSession] = {}

    def __enter__(self) -> "Scratch":
        Scratch._open.append(self)
        return self

    def keep(self, table: DataFrame) -> DataFrame:
        path = table._stored_at
        spark = self.tables.pop(path)
        outer = Scratch._open[-2] if len(Scratch._open) > 1 else None
        if outer is not None:
            outer.tables[path] = spark
        return table

    def __exit__(self, *_) -> None:
        Scratch._open.remove(self)
        for path, spark in self.tables.items():
            _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def free(table: DataFrame) -> None:
    """Removes a table of ``written`` whose successor is written; nothing may read it again."""
    path = table._stored_at
    for scratch in Scratch._open:
        scratch.tables.pop(path, None)
    _remove(table.sparkSession, path)


def checkpointed(df: DataFrame) -> DataFrame:
    """The same rows, read back from the shared folder; lost executors cost no recomputation."""
    return written(df, "checkpoint")


def columns(df: DataFrame, **kinds: str) -> DataFrame:
    """Only the named columns, in the types given; whatever else ``df`` holds stays out."""
    return df.select(*[F.col(f"`{name}`").cast(kind).alias(name) for name, kind in kinds.items()])


def shuffled(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the documents: never sent through the driver.

    Spark sizes a table in the shared folder by its files, which may be a tenth of its
    rows, and a broadcast takes several times the rows in the driver's memory.
    """
    return df.hint("merge")


def parts(df: DataFrame, rows: int | None = None) -> int:
    """Shuffle partitions of the session."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written once to a table in the shared folder and read from there."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._stored_at = path
    if Scratch._open:
        Scratch._open[-1].tables[path] = df.sparkSession
    return table


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for columns of one's own that ``df`` does not have, in any case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def same_columns(df: DataFrame) -> list:
    """All columns of ``df`` as they are, whatever is in their names."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]
