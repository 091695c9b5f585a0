"""Structured Streaming over call events: windows, sessions, duplicates, latest status, admission to the answer cache.

The batch and the streaming form of each aggregation are the same function of a DataFrame with a timestamp column.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from citeweave.session import checkpoint_folder, is_folder, table

LATE = "2 hours"


def stream_table(spark: SparkSession, sf_dir: str, name: str, files_per_batch: int = 100) -> DataFrame:
    """The table as a file stream, with its batch schema."""
    path = f"{sf_dir}/{name}.parquet"
    reader = spark.readStream.schema(table(spark, sf_dir, name).schema).option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path) if is_folder(spark, path) else reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def timed(events: DataFrame) -> DataFrame:
    """events with ts as an instant: watermarks take no timestamps without a zone."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", LATE)


def tumbling(events: DataFrame) -> DataFrame:
    g = events.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return g.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")


def sliding(events: DataFrame) -> DataFrame:
    g = events.groupBy(F.window("ts", "1 day", "12 hours").alias("w")).agg(F.count("*").alias("n"))
    return g.select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("start"), "n")


def session_counts(events: DataFrame) -> DataFrame:
    g = events.groupBy(F.session_window("ts", "30 minutes").alias("w"), "user_id").agg(F.count("*").alias("n"))
    return g.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("began"), "n")


def once(events: DataFrame) -> DataFrame:
    """Each event once within the watermark, however often it is delivered."""
    return events.dropDuplicatesWithinWatermark(["event_id"])


def run_complete(df: DataFrame, spark: SparkSession) -> DataFrame:
    """Runs an aggregating stream over what is there now; the last complete result, written to the shared folder."""
    base = f"{checkpoint_folder(spark)}/stream-{uuid.uuid4().hex}"
    write = lambda b, _: b.write.mode("overwrite").parquet(f"{base}/out")
    df.writeStream.outputMode("complete").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return spark.read.parquet(f"{base}/out")


def run_append(df: DataFrame, spark: SparkSession) -> DataFrame:
    """Runs a stream that only adds rows over what is there now."""
    base = f"{checkpoint_folder(spark)}/stream-{uuid.uuid4().hex}"
    df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{base}/state").option("path", f"{base}/out").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{base}/out")


PARTS = 64


def upsert_latest(spark: SparkSession, folder: str, key: str, at: str, parts: int = PARTS):
    """A foreachBatch function that keeps the latest row of each key under `folder`, in `parts` hashed by key.

    A batch rewrites only the parts that its keys fall in: folder/part=i/v<epoch>. The newest version of a part holds;
    a repeated batch reads the versions before its own and writes the same again. Older versions are removed once the
    next but one is written.
    """

    def merge(batch: DataFrame, epoch: int) -> None:
        session = batch.sparkSession
        jvm = session.sparkContext._jvm
        path = lambda x: jvm.org.apache.hadoop.fs.Path(x)
        fs = path(folder).getFileSystem(session.sparkContext._jsc.hadoopConfiguration())
        keyed_ = batch.withColumn("part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")).persist()
        touched = [r["part"] for r in keyed_.select("part").distinct().collect()]  # at most `parts`
        old = {i: [v for v in _versions(session, f"{folder}/part={i}") if v < epoch] for i in touched}
        before = [f"{folder}/part={i}/v{v[-1]}" for i, v in old.items() if v]
        df = keyed_
        if before:
            df = session.read.option("basePath", folder).parquet(*before).withColumn("part", F.col("part").cast("int")).unionByName(keyed_)
        rest = [c for c in batch.columns if c != key]
        best = df.groupBy("part", key).agg(F.max_by(F.struct(*rest), F.struct(F.col(at).isNotNull(), *rest)).alias("_r"))
        out = best.select("part", key, *(F.col("_r")[c].alias(c) for c in rest))
        stage = f"{folder}/_stage-{epoch}"
        out.repartition("part").write.mode("overwrite").partitionBy("part").parquet(stage)
        for i in touched:
            to = path(f"{folder}/part={i}/v{epoch}")
            fs.mkdirs(to.getParent())
            fs.delete(to, True)
            fs.rename(path(f"{stage}/part={i}"), to)
            for v in old[i][:-1]:
                fs.delete(path(f"{folder}/part={i}/v{v}"), True)
        fs.delete(path(stage), True)
        keyed_.unpersist()

    return merge


def _versions(spark: SparkSession, folder: str) -> list[int]:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(int(x.getPath().getName()[1:]) for x in fs.listStatus(p)) if fs.exists(p) else []


def read_latest(spark: SparkSession, folder: str, schema, parts: int = PARTS) -> DataFrame:
    """The rows that upsert_latest keeps: the newest version of each part."""
    newest = [f"{folder}/part={i}/v{v[-1]}" for i in range(parts) for v in [_versions(spark, f"{folder}/part={i}")] if v]
    return spark.read.schema(schema).parquet(*newest) if newest else spark.createDataFrame([], schema)


def users_seen(events: DataFrame) -> DataFrame:
    """(user_id, n, best): running count and largest value per user, kept in state across batches."""

    def update(key, batches, state: GroupState):
        n, best = state.get if state.exists else (0, None)
        for b in batches:
            n, top = n + len(b), b["value"].max()
            best = best if pd.isna(top) else float(top) if best is None else max(best, float(top))
        state.update((n, best))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "best": [best]})

    return events.groupBy("user_id").applyInPandasWithState(update, "user_id long, n long, best double", "n long, best double", "update", GroupStateTimeout.NoTimeout)


def _complete(f):
    return lambda spark, d: run_complete(f(timed(stream_table(spark, d, "events"))), spark)


def _q_once(spark, d):
    e = timed(stream_table(spark, d, "events"))
    return run_append(once(e.unionByName(e)), spark).groupBy("event_type").agg(F.count("*").alias("n"))


def _q_status(spark, d):
    """The latest fetch status of each paper, merged batch by batch."""
    base = f"{checkpoint_folder(spark)}/stream-{uuid.uuid4().hex}"
    s = stream_table(spark, d, "fetch_status").select("arxiv_id", "updated_at", "status", "n_refs")
    s.writeStream.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(upsert_latest(spark, f"{base}/t", "arxiv_id", "updated_at")).start().awaitTermination()
    return read_latest(spark, f"{base}/t", s.schema).select("arxiv_id", "status", "n_refs")


def _q_users(spark, d):
    base = f"{checkpoint_folder(spark)}/stream-{uuid.uuid4().hex}"
    write = lambda b, _: b.write.mode("append").parquet(f"{base}/out")
    users_seen(timed(stream_table(spark, d, "events"))).writeStream.outputMode("update").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return spark.read.parquet(f"{base}/out").groupBy("user_id").agg(F.max("n").alias("n"), F.round(F.max("best"), 6).alias("best"))


QUERIES = {
    "stream_tumbling": _complete(tumbling),
    "stream_sliding": _complete(sliding),
    "stream_sessions": _complete(session_counts),
    "stream_once": _q_once,
    "stream_latest_status": _q_status,
    "stream_users": _q_users,
}
SQL = {
    "stream_tumbling": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2",
    "stream_sliding": "SELECT strftime(s, '%Y-%m-%d %H:%M') AS start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '2000-01-01'), time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '2000-01-01') - INTERVAL 12 HOUR]) AS s FROM events) GROUP BY 1",
    "stream_sessions": "WITH g AS (SELECT user_id, ts, sum(st) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS st FROM events)) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS began, count(*) AS n FROM g GROUP BY user_id, s",
    "stream_once": "SELECT event_type, count(*) AS n FROM events GROUP BY 1",
    "stream_latest_status": "SELECT arxiv_id, status, n_refs FROM fetch_status",
    "stream_users": "SELECT user_id, count(*) AS n, round(max(value), 6) AS best FROM events GROUP BY 1",
}
