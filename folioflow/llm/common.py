"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session (tests) gets one; a cluster has to name its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors reach")
        found = "/tmp/folioflow-checkpoints"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: The folders that cut() wrote and nobody deleted yet, in order.
_made: list[str] = []


def cut(df: DataFrame, label: str, slim: bool = False) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: the plan starts anew there, and a lost executor costs only the tasks that it ran.

    slim: df has few and short rows for the number of shuffle partitions, so they are dealt
    to a sixteenth of that number of files; what computes them keeps all its tasks. The
    folder stays until sweep(), as the frame that is returned reads it.
    """
    return cut_into(folder(df.sparkSession, label), df, slim)


def folder(spark: SparkSession, label: str) -> str:
    """A new folder in the shared one that sweep() deletes with all it holds."""
    _made.append(path := f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}")
    return path


def cut_into(path: str, df: DataFrame, slim: bool = False) -> DataFrame:
    """cut() by a path of one's own, so that several tables can be read as one afterwards."""
    spark = df.sparkSession
    if slim:
        df = df.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 16))
    df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def mark() -> int:
    """A place for sweep()."""
    return len(_made)


def sweep(spark: SparkSession, since: int = 0) -> None:
    """Delete the folders that cut() wrote since a mark, once nothing reads them any more."""
    for path in _made[since:]:
        delete(spark, path)
    del _made[since:]


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def private(columns: Iterable[str], *names: str) -> dict[str, str]:
    """For each name a column name that none of columns has, whatever its case."""
    taken, out = {c.lower() for c in columns}, {}
    for name in names:
        own = f"__{name}"
        while own.lower() in taken:
            own += "_"
        taken.add(own.lower())
        out[name] = own
    return out


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def lower_hex_sha256(col: Column) -> Column:
    return F.sha2(col, 256)
