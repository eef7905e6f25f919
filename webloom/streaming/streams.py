"""Event streams. Functions take streaming or batch frames and drop late rows, or write a stream out (side_output keeps them)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from webloom.functions.text import FINAL_STATES, content_key, is_final
from webloom.operators.aggregates import dedup_records
from webloom.operators.filters import is_api, is_json, is_websocket
from webloom.sources.readers import RECORDING


def mutation_rate(mutations: DataFrame, key: str = "page_id", late: str = "10 seconds") -> DataFrame:
    """(key, start, rate) of (key, ts, n) rows: mutations a second in each window of four seconds."""
    windows = mutations.withWatermark("ts", late).groupBy(F.window("ts", "4 seconds"), key).agg(F.sum("n").alias("n"))
    return windows.select(key, F.col("window.start").alias("start"), (F.col("n") / 4).alias("rate"))


def network_counters(requests: DataFrame, size: str = "1 minute", late: str = "1 minute", salts: int = 1) -> DataFrame:
    """Requests, API calls, JSON responses and upgrades of each page and window.

    With `salts` a page's requests are counted in so many shares first, which spreads a hot page over as many tasks; two
    aggregations of a stream need append mode.
    """
    rows = requests.withWatermark("ts", late)
    counts = {
        "request_count": F.lit(True), "api_calls": is_api(F.col("url")), "json_responses": is_json(F.col("content_type")), "realtime": is_websocket(F.col("upgrade")),
    }
    if salts > 1:
        share = F.pmod(F.xxhash64(*requests.columns), F.lit(salts)).alias("share")
        shares = rows.groupBy(F.window("ts", size), "page_id", share).agg(*(F.count_if(test).alias(name) for name, test in counts.items()))
        out = shares.groupBy(F.window(F.window_time("window"), size), "page_id").agg(*(F.sum(name).alias(name) for name in counts))
    else:
        out = rows.groupBy(F.window("ts", size), "page_id").agg(*(F.count_if(test).alias(name) for name, test in counts.items()))
    return out.select("page_id", F.col("window.start").alias("start"), *counts)


def recording_tail(spark: SparkSession, path: str) -> DataFrame:
    """A recording folder as a stream, with event times."""
    rows = spark.readStream.schema(RECORDING).json(path)
    return rows.withColumn("ts", F.to_timestamp("timestamp"))


def sessions(events: DataFrame, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(key, start, end, events) of events that follow each other within `gap`."""
    out = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), key).agg(F.count("*").alias("events"))
    return out.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events")


def dedup(records: DataFrame, project: str, fields: list[str], late: str = "1 hour") -> DataFrame:
    """Records whose content has not come before within the watermark."""
    keyed = records.withColumn("content_key", content_key([F.col(f) for f in fields]))
    return keyed.withWatermark("ts", late).dropDuplicatesWithinWatermark([project, "content_key"])


def completions(states: DataFrame, key: str = "project_id", gap: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Sessions of state events with their last state, whether they ended and how long they took."""
    out = states.withWatermark("ts", late).groupBy(F.session_window("ts", gap), key).agg(
        F.max_by("state", F.struct("ts", "state")).alias("final_state"), F.min("ts").alias("first"), F.max("ts").alias("last")
    )
    seconds = lambda c: F.col(c).cast("timestamp").cast("double")
    took = F.round(seconds("last") - seconds("first"), 2)
    return out.select(key, "final_state", is_final(F.col("final_state")).alias("ended"), took.alias("duration_seconds"))


class _Sessions(StatefulProcessor):
    """A session of a key: its state grows with rows, and ends with a final state or when its timer runs out."""

    def __init__(self, key: str, gap_ms: int):
        self.key, self.gap = key, gap_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getValueState("session", "first long, last long, state string")

    def _row(self, key, session: tuple[int, int, str]) -> Row:
        first, last, state = session
        return Row(**{self.key: key[0]}, final_state=state, ended=state in FINAL_STATES, duration_seconds=(last - first + 5_000) // 10_000 / 100)  # hundredths, exactly

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803  names of the interface
        now = tuple(self.held.get()) if self.held.exists() else None
        for r in sorted(rows, key=lambda r: (r["at"], r["state"] or "")):
            at, state = r["at"], r["state"]
            if now and at - now[1] > 1000 * self.gap:
                yield self._row(key, now)
                now = None
            if now is None:
                now = (at, at, state)
            else:
                now = (min(now[0], at), max(now[1], at), state if at >= now[1] else now[2])
            if now[2] in FINAL_STATES:
                yield self._row(key, now)
                now = None
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if now is None:
            self.held.clear()
        else:
            self.held.update(now)
            self.handle.registerTimer(now[1] // 1000 + self.gap + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        if self.held.exists():
            yield self._row(key, tuple(self.held.get()))
            self.held.clear()

    def close(self) -> None:
        pass


def live_completions(states: DataFrame, key: str = "project_id", gap: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(key, final_state, ended, duration_seconds) of a stream of state events (key, ts, state), in append mode.

    A final state ends a session at once, without waiting for the watermark; a session without one ends by a timer when
    the watermark passes its last row by `gap`, which also frees its state. Rows that are late are dropped. The state
    store must be one that transformWithState supports (RocksDB).
    """
    rows = states.select(key, "ts", "state", F.unix_micros(F.col("ts").cast("timestamp")).alias("at")).withWatermark("ts", late)
    kind = states.schema[key].dataType
    out = T.StructType([T.StructField(key, kind), *T._parse_datatype_string("final_state string, ended boolean, duration_seconds double").fields])
    return rows.groupBy(key).transformWithState(_Sessions(key, round(1000 * _seconds(states, gap))), out, "Append", "EventTime")


def _seconds(df: DataFrame, interval: str) -> float:
    return df.sparkSession.range(1).select((F.expr(f"timestamp'1970-01-01 00:00:00Z' + INTERVAL {interval}").cast("double"))).first()[0]


def _written(spark: SparkSession, path: str, batch_id: int) -> DataFrame:
    """What earlier batches wrote to a table with a `batch` partition; the batch itself may have run before and be running again."""
    return spark.read.parquet(path).filter(F.col("batch") < batch_id)


def side_output(rows: DataFrame, path: str, ts: str = "ts", late: str = "1 hour") -> DataStreamWriter:
    """Writer of a stream to `path`, rows in time and late rows apart, so that late ones are kept and counted.

    A row is late if its time is before the highest of all earlier batches less `late`, as with a watermark. Each batch
    overwrites its own partitions, so a batch that runs again after a failure changes nothing. on_time() and late_rows()
    read the outputs.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = _written(spark, f"{path}/marks", batch_id).agg(F.max("high")).first()[0] if batch_id else None
        line = F.lit(before).cast(batch.schema[ts].dataType) - F.expr(f"INTERVAL {late}")
        split = batch.withColumns({"is_late": F.coalesce(F.col(ts) < line, F.lit(False)), "batch": F.lit(batch_id)})
        split.write.partitionBy("batch", "is_late").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{path}/rows")
        high = spark.read.schema(split.schema).parquet(f"{path}/rows").filter(F.col("batch") == batch_id).agg(F.max(ts).alias("high"))
        high.withColumn("batch", F.lit(batch_id)).write.partitionBy("batch").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{path}/marks")

    return rows.writeStream.foreachBatch(step).option("checkpointLocation", f"{path}/checkpoint")


def on_time(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/rows").filter(~F.col("is_late").cast("boolean")).drop("is_late", "batch")


def late_rows(spark: SparkSession, path: str) -> DataFrame:
    """The late rows of side_output(), with the batch they came in."""
    return spark.read.parquet(f"{path}/rows").filter(F.col("is_late").cast("boolean")).drop("is_late")


def dedup_for_good(records: DataFrame, path: str, project: str, order: list[str], fields: list[str], buckets: int = 64) -> DataStreamWriter:
    """Writer of a stream to `path`/records without content that has ever come before, however long ago.

    Keys seen lie in a table in buckets of their hash; a batch reads those of earlier batches, keeps the first record of
    each new key, and adds its keys. Each batch overwrites its own partitions, so it may run again after a failure.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        key = F.sha2(content_key([F.col(f) for f in fields]), 256)
        first = dedup_records(batch, project, order, fields).withColumns({"_key": key, "_bucket": F.pmod(F.xxhash64(project, key), F.lit(buckets)).cast("int")})
        if batch_id:
            known = _written(spark, f"{path}/keys", batch_id).select(F.col(project).alias("_project"), "_key", "_bucket")
            same = first[project].eqNullSafe(known["_project"]) & (first["_key"] == known["_key"]) & (first["_bucket"] == known["_bucket"])
            first = first.join(known, same, "left_anti")
        put = lambda df, name, by: df.withColumn("batch", F.lit(batch_id)).write.partitionBy(*by).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{path}/{name}")
        put(first, "records", ["batch"])
        kept = spark.read.parquet(f"{path}/records").filter(F.col("batch") == batch_id)
        put(kept.select(project, "_key", "_bucket").repartition("_bucket"), "keys", ["_bucket", "batch"])

    return records.writeStream.foreachBatch(step).option("checkpointLocation", f"{path}/checkpoint")


def first_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/records").drop("batch", "_key", "_bucket")
