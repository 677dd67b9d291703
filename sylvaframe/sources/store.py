"""The stored form of model output: Parquet in folders by simulation type, time resolution and variable, in each of them rows in the order of run and time.

One variable of all runs is a few folders; one run or one period of it a few row groups. Reading asks for both by plain comparisons, so that folders are
left out when the scan is planned and row groups when it runs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..schema import MODEL_LONG

FOLDERS = ("sim_type", "time_res", "variable")
ORDER = ("fid", "ts", "layer")


def scratch(spark: SparkSession) -> str:
    """A new folder that all workers share: below ``spark.checkpoint.dir``. Only a local session may do without."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(root or tempfile.mkdtemp(prefix='sylvaframe-')).rstrip('/')}/{uuid.uuid4().hex}"


def write_model(long: DataFrame, path: str, mode: str = "overwrite", rows_a_file: int = 20_000_000, group_bytes: int = 32 << 20) -> None:
    """Writes rows of ``schema.MODEL_LONG``. Rows are dealt by ranges of folder, run and time: a folder of any size is shared among as many tasks as its rows need,
    a file holds one range of runs and times, and its row groups are small enough to be told apart by them."""
    names = StructType.fromDDL(MODEL_LONG).fieldNames()
    # the writer keeps the order given here only if the folders' columns lead it as they are: not NULL (an empty one is the default folder too), and not constants,
    # which the optimizer would take out of the order
    held = lambda n: F.when(F.monotonically_increasing_id() >= 0, F.coalesce(F.col(n), F.lit(""))).otherwise("").alias(n)
    rows = long.select(*[held(n) if n in FOLDERS else F.col(n) for n in names])
    dealt = rows.repartitionByRange(*FOLDERS, *ORDER).sortWithinPartitions(*FOLDERS, *ORDER)
    dealt.write.mode(mode).option("maxRecordsPerFile", rows_a_file).option("parquet.block.size", group_bytes).partitionBy(*FOLDERS).parquet(path)


def read_model(spark: SparkSession, path: str, variables: list[str] | None = None, sim_type: str | None = None, time_res: str | None = None, fids: list[int] | None = None, begin: str | None = None, until: str | None = None) -> DataFrame:
    """Rows of ``schema.MODEL_LONG`` that have been written, of the variables, kinds, runs and times [begin, until) asked for. The schema is given, so that no
    file is opened to find it. Runs that lie far apart are asked for by their range too, which row groups can answer."""
    rows = spark.read.schema(MODEL_LONG).parquet(path)
    for column, wanted in (("variable", variables), ("sim_type", [sim_type] if sim_type else None), ("time_res", [time_res] if time_res else None), ("fid", fids)):
        if wanted is not None:
            rows = rows.filter(F.col(column).isin(*wanted) if wanted else F.lit(False))
    if fids:
        rows = rows.filter((F.col("fid") >= min(fids)) & (F.col("fid") <= max(fids)))
    if begin is not None:
        rows = rows.filter(F.col("ts") >= F.lit(begin).cast("timestamp_ntz"))
    return rows if until is None else rows.filter(F.col("ts") < F.lit(until).cast("timestamp_ntz"))


def write_scenarios(rows: DataFrame, root: str, labels: list[str]) -> None:
    """Writes the rows below ``root/<label>/<label>/.../``, in folders named by the labels alone, as runs of scenarios are kept. The folders are written
    as ``name=value`` and renamed, which copies nothing on a file system; labels are few, as there is a folder for each of them. A folder of any size is
    shared among as many tasks as its rows need: adaptive execution splits it."""
    rows.hint("rebalance", *labels).write.mode("overwrite").partitionBy(*labels).parquet(root)
    hadoop = rows.sparkSession.sparkContext._jvm.org.apache.hadoop.fs
    top = hadoop.Path(root)
    files = top.getFileSystem(rows.sparkSession.sparkContext._jsc.hadoopConfiguration())

    def rename(folder, level: int) -> None:
        for status in files.listStatus(folder):
            name = status.getPath().getName()
            if status.isDirectory() and name.startswith(f"{labels[level]}="):
                to = hadoop.Path(folder, name.split("=", 1)[1])
                files.rename(status.getPath(), to)
                if level + 1 < len(labels):
                    rename(to, level + 1)

    rename(top, 0)


def read_scenarios(spark: SparkSession, root: str, schema: str, labels: tuple[str, ...] = ("model", "pathway", "scenario")) -> DataFrame:
    """The Parquet files of all scenarios below ``root/<label>/<label>/.../``, as one scan: each row has its labels from the folders above its file. A filter on a label
    is one on the file's path, so other files are not read. Each row's path is cut at its slashes, from the end: a pattern would be tried anew from each letter of it."""
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(root)
    above = lambda k: F.substring_index(F.substring_index(F.col("_metadata.file_path"), "/", k - len(labels) - 1), "/", 1)
    return rows.select("*", *[above(k).alias(label) for k, label in enumerate(labels)])
