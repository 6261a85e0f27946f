"""Cutting lineage: tables written to the folder that every executor shares."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where it is unset on one machine, a folder of this process.

    On a cluster the setting must be there: a folder of the driver's machine is not one that executors share.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = getattr(shared_folder, "own", None) or tempfile.mkdtemp(prefix="fernsieve-")
        shared_folder.own = folder
    return folder.rstrip("/")


def let_workers_import(spark: SparkSession) -> None:
    """Python workers find this package wherever the session was started from."""
    home, environment = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    known = [x for x in environment.get("PYTHONPATH", "").split(os.pathsep) if x]
    if home not in known:
        environment["PYTHONPATH"] = os.pathsep.join([home, *known])


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and return what reads it back.

    The result survives the loss of any executor, because nothing upstream is computed again.
    """
    let_workers_import(df.sparkSession)
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._staged_at = path
    return table


def drop_staged(*tables: DataFrame | None) -> None:
    """Delete staged tables that nothing will read again; what else is given is left alone."""
    for table in tables:
        path = getattr(table, "_staged_at", None)
        if path:
            spark = table.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
            table._staged_at = None


#: Rows of a table of a few short columns that is sent to every executor rather than joined by a shuffle.
FEW_ROWS = 100_000


def sent_if_few(table: DataFrame, most: int = FEW_ROWS) -> DataFrame:
    """A staged table of short rows, marked for broadcast if it has at most ``most`` of them: a few MB."""
    return F.broadcast(table) if table.count() <= most else table
