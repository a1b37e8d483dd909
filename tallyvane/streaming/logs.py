"""Streams over append-only logs: windowed counts and the latest decision of every review item."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyvane.operators import operations
from tallyvane.sources import storage


def read_log(spark: SparkSession, folder: str, pattern: str, schema: T.StructType) -> DataFrame:
    """A stream of the files of a folder that match a pattern."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def settled(stream: DataFrame, name: str) -> DataFrame:
    """Run an aggregated stream over all that is there, and read its result. Every batch overwrites the whole result, so one
    that runs again after a failure changes nothing."""
    spark = stream.sparkSession
    path, state = storage.folder(spark, name), storage.folder(spark, f"{name}-state")

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    query = stream.writeStream.outputMode("complete").option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def windowed_counts(events: DataFrame, width: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Events and their value by tumbling window and type; events later than the watermark allows are dropped."""
    own = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return own.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value")).select(F.col("window.start").alias("start"), "event_type", "n", "value")


def latest_decisions(log: DataFrame) -> DataFrame:
    """item_id and the decision of its latest event, as a stream's state."""
    return log.groupBy("item_id").agg(F.max_by("decision", F.struct("at", "ord")).alias("decision"), F.max("at").alias("at"), F.count("*").alias("n"))


def appended(stream: DataFrame, path: str, state: str | None = None) -> DataFrame:
    """Run a stream over all that is there and append it to the log at `path`, a folder for each batch: a batch that runs again after a
    failure replaces its own. A stream that starts anew appends its events again; readers keep each event once. state: where it notes what
    it has read, if it is to go on from there."""
    spark = stream.sparkSession
    state = state or storage.folder(spark, "log-state")
    run = state.rstrip("/").rpartition("/")[2]

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/run={run}/batch={number}")

    stream.writeStream.option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def budgeted(calls: DataFrame, budget: float, by: str) -> DataFrame:
    """Priced calls (by, ord, cost) as a stream, with what operations.ledger() tells of them: what a user has spent is the stream's state. Calls of a
    batch stand in order; batches follow each other."""
    schema = T.StructType([*calls.schema.fields, T.StructField("spent", T.DoubleType()), T.StructField("affordable", T.BooleanType()), T.StructField("remaining", T.DoubleType())])

    def fold(_, parts, state):
        import pandas as pd

        rows = pd.concat(list(parts)).sort_values("ord", kind="stable")
        told = operations.afforded(rows["cost"].tolist(), state.get[0] if state.exists else 0.0, budget)
        rows[["spent", "affordable", "remaining"]] = pd.DataFrame(told, index=rows.index)
        spent, made, _ = told[-1]
        state.update((spent + float(rows["cost"].iloc[-1]) if made else spent,))
        yield rows

    return calls.groupBy(by).applyInPandasWithState(fold, schema, "spent double", "append", "NoTimeout")
