"""What the operators of this subpackage ask of the session: tables, the shared folder, partition counts."""

from __future__ import annotations

import math
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where it is unset, the checkpoint folder of the context.
    A local session may do without both; on a cluster that is an error, as a local folder is not shared."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="sylvaframe-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """The DataFrame computed once, as a table written in the shared folder: later reads do not compute it again,
    also when an executor is lost."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def freeing(spark: SparkSession) -> Iterator[None]:
    """A query that ends inside gives back its shuffle files at once, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def packed(df: DataFrame) -> DataFrame:
    """The rows of ``df`` as one column ``row``, beside which any name is free; ``select("row.*")`` gives them back."""
    return df.select(F.struct("*").alias("row"))


def spread(df: DataFrame, bytes_each: int = 16 << 20) -> int:
    """How many parts to deal ``df`` into: one for each ``bytes_each`` of estimated input, and no fewer than
    ``spark.sql.shuffle.partitions``. The estimate comes from file sizes, so it costs no job."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    try:
        size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().toString())
    except Exception:  # a session without the JVM's plan object
        return least
    return max(least, min(math.ceil(size / bytes_each), 1 << 20))


def ready(spark: SparkSession, rows: int = 1000) -> None:
    """Gives the Python workers this package, and bounds the rows that one Arrow batch hands them; texts can be long."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    context = spark.sparkContext
    if getattr(context, "_sylvaframe_sent", False):
        return
    top = Path(__file__).resolve().parents[2]
    box = Path(tempfile.mkdtemp(prefix="sylvaframe-")) / "sylvaframe-workers.zip"
    with zipfile.ZipFile(box, "w") as z:
        for f in sorted((top / "sylvaframe").rglob("*.py")):
            z.write(f, f.relative_to(top))
    context.addPyFile(str(box))
    context._sylvaframe_sent = True
