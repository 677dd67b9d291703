"""Structured Streaming twins of batch operators: each is a transformation of a streaming DataFrame, and gives the same result on
a batch. They run in update mode, so that only what changed is written, and results go to files. Watermarks need time-zone timestamps: stamps are cast, the session's zone is to be UTC."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import half_hour_bin
from . import state


def stream_scores(model: DataFrame, obs: DataFrame, threshold: float, ends: DataFrame | None = None, timeout: str = "30 days", late: str = "1 day") -> DataFrame:
    """(fid, n, rmse, rejected, closed_by): one verdict for each run, once it is over. A run is over when the stream's watermark (its latest stamp less ``late``)
    passes the run's end stamp in ``ends`` (fid, end; rows after it don't count), or ``timeout`` after the run's latest row, which also closes runs
    that never end. Until then only a count and a sum of squares are kept; what comes for a run that has been judged is left out.
    ``obs``: a static table (bin, o). On a batch, where nothing is left to come, every run is judged at once."""
    rows = model.withColumn("bin", half_hour_bin(F.col("ts"))).withColumn("_ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("_ts", late) if model.isStreaming else rows
    rows = rows.join(obs, "bin").filter(F.col("value").isNotNull() & F.col("o").isNotNull())
    if ends is None:
        rows = rows.withColumn("_end", F.lit(None).cast("timestamp"))
    else:
        rows = rows.join(ends.select("fid", F.col("end").cast("timestamp").alias("_end")), "fid", "left")
    rows = rows.select("fid", F.unix_millis("_ts").alias("at"), F.unix_millis("_end").alias("ends_at"), (F.col("value") - F.col("o")).alias("error"))
    if not model.isStreaming:
        rmse = F.sqrt(F.avg(F.col("error") * F.col("error")))
        closed = F.when(F.first("ends_at").isNotNull(), "end").otherwise("timeout").alias("closed_by")
        return rows.filter("ends_at IS NULL OR at <= ends_at").groupBy("fid").agg(F.count(F.lit(1)).alias("n"), rmse.alias("rmse"), (rmse > threshold).alias("rejected"), closed)
    state.rocksdb(model.sparkSession)
    wait = round(model.sparkSession.sql(f"SELECT INTERVAL '0' SECOND + INTERVAL {timeout} AS t").first().t.total_seconds() * 1000)
    schema = state.VERDICT.format(key=model.schema["fid"].dataType.simpleString())
    return rows.groupBy("fid").transformWithStateInPandas(state.verdicts(threshold, wait), schema, "Update", "EventTime")


#: Units of a fixed length: the window and the offset from the epoch, a Thursday, at which one begins.
FIXED_UNITS = {"minute": ("1 minute", "0 seconds"), "hour": ("1 hour", "0 seconds"), "day": ("1 day", "0 seconds"), "week": ("7 days", "4 days")}


def stream_monitor(model: DataFrame, unit: str = "month", late_days: int = 30) -> DataFrame:
    """Means by calendar unit of growing output, with the latest stamp. A row whose whole unit ended more than ``late_days`` before the latest
    stamp is left out, from the batch after the next on, and the state of such units is dropped (in update mode). Units of a fixed length are
    event-time windows; months, quarters and years are kept by a processor with a timer at the unit's end."""
    rows = model.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", f"{late_days} days") if model.isStreaming else rows
    sums = F.avg("value").alias("mean"), F.count("value").alias("n"), F.max("ts").alias("latest")
    if unit in FIXED_UNITS:
        length, begin = FIXED_UNITS[unit]
        return rows.groupBy("fid", "variable", F.window("ts", length, startTime=begin)).agg(*sums).select("fid", "variable", F.col("window.start").alias("bucket"), "mean", "n", "latest")
    bucket = F.date_trunc(unit, "ts").alias("bucket")
    if not model.isStreaming:
        return rows.groupBy("fid", "variable", bucket).agg(*sums)
    state.rocksdb(model.sparkSession)
    ends = F.date_trunc(unit, "ts") + F.expr({"quarter": "INTERVAL 3 MONTH"}.get(unit, f"INTERVAL 1 {unit}"))
    rows = rows.select("fid", "variable", bucket, F.unix_micros("ts").alias("at"), F.unix_millis(ends).alias("ends_at"), "value")
    schema = state.UNIT_MEANS.format(key=model.schema["fid"].dataType.simpleString())
    return rows.groupBy("fid", "variable", "bucket").transformWithStateInPandas(state.unit_means(), schema, "Update", "EventTime")


def stream_progress(log: DataFrame) -> DataFrame:
    """Count, failures, total duration and elapsed time of each job on each node, from an append-only log."""
    end = F.unix_seconds(F.col("ts").cast("timestamp"))
    return log.groupBy("job", "node").agg(F.count(F.lit(1)).alias("done"), F.sum(F.when(F.col("rc") != 0, 1).otherwise(0)).alias("failed"), F.sum("duration_s").alias("duration_s"), (F.max(end) - F.min(end - F.col("duration_s"))).alias("elapsed_s"))


def to_files(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True):
    """Starts a streaming query in update mode: each batch's changed rows become Parquet files below ``path/batch=N``, written by the
    executors; a batch that is repeated after a failure replaces its own. Nothing passes through the driver."""
    stream.sparkSession.createDataFrame([], stream.schema).write.mode("ignore").parquet(f"{path}/batch=-1")

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    writer = stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _numbers(spark, pattern: str) -> list[int]:
    """The numbers of the folders ``name=number`` that match the pattern and have been written to their end, ascending."""
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(f"{pattern}/_SUCCESS")
    found = at.getFileSystem(context._jsc.hadoopConfiguration()).globStatus(at)
    return sorted(int(x.getPath().getParent().getName().split("=")[1]) for x in found or [])


def current(spark, path: str, keys: list[str], upto: int | None = None, with_batch: bool = False) -> DataFrame:
    """The result of ``to_files`` so far (or up to a batch): the newest snapshot, if there is one, and the batches after it."""
    done = _numbers(spark, f"{path.rstrip('/')}-snapshots/upto=*")
    rows = spark.read.parquet(path).withColumn("batch", F.col("batch").cast("long"))
    rows = rows if upto is None else rows.filter(F.col("batch") <= upto)
    if done:
        rows = rows.filter(F.col("batch") > done[-1]).unionByName(spark.read.schema(rows.schema).parquet(f"{path.rstrip('/')}-snapshots/upto={done[-1]}"))
    rest = [c for c in rows.columns if c not in keys and (with_batch or c != "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_last")).select(*keys, "_last.*")


def snapshot(spark, path: str, keys: list[str], forget: bool = False) -> int | None:
    """Writes the result so far as one table, so that reading it no longer grows with the batches behind it; returns the last batch in it. A snapshot that failed
    is not complete and is never read. ``forget`` deletes the batches that it replaces; a batch which the stream then repeats is left out,
    as the snapshot has its rows."""
    folder = f"{path.rstrip('/')}-snapshots"
    done, batches = _numbers(spark, f"{folder}/upto=*"), _numbers(spark, f"{path.rstrip('/')}/batch=*")
    upto = max(batches, default=-1)
    if upto >= 0 and (not done or upto > done[-1]):
        current(spark, path, keys, upto, with_batch=True).write.mode("overwrite").parquet(f"{folder}/upto={upto}")
        done.append(upto)
    if forget and done:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        gone = [f"{path.rstrip('/')}/batch={n}" for n in batches if 0 <= n <= done[-1]] + [f"{folder}/upto={n}" for n in done[:-1]]
        for one in map(hadoop.Path, gone):
            one.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(one, True)
    return done[-1] if done else None


def drain(stream: DataFrame, keys: list[str], path: str, checkpoint: str) -> DataFrame:
    """Runs a streaming query over what is there, into files; its last result."""
    to_files(stream, path, checkpoint).awaitTermination()
    return current(stream.sparkSession, path, keys)
