"""What the operators share: reading the tables and cutting lineage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir.  Where that setting is unset, a local
    session (as in tests) gets a temporary folder, a cluster, whose machines would not see it, an error."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir")
    if context.getCheckpointDir() is None:
        if named is None and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="keyloom-"))
    return named or context.getCheckpointDir()


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that is not needed any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, computed once and written to the shared folder, so that later jobs read
    them again even after executors are lost."""
    folder(df.sparkSession)
    return df.checkpoint()


def drop(*frames: DataFrame) -> None:
    """Removes what cut() has written for these frames; nothing may read them any more."""
    for df in frames:
        file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
        if file.isDefined():
            remove(df.sparkSession, file.get())


def kinds(df: DataFrame, *names: str) -> str:
    """DDL of the named columns, each followed by a comma."""
    return "".join(f"`{n}` {df.schema[n].dataType.simpleString()}, " for n in names)
