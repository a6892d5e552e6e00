"""Streaming forms of the increments. Sinks and checkpoints live in the shared folder given by the caller."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from casegraph import fixed_values as fv
from casegraph.functions.urls import with_canonical_url
from casegraph.operators import attempts as att
from casegraph.plans.evidence import extracted, stage_by_kind
from casegraph.plans.registry import ExtractorRegistry
from casegraph.session import shared_folder


def _unique_per_batch(batches):
    """Thin out repeats inside each Arrow batch before the shuffle: a URL that makes up a third of the stream reaches
    its state partition about once per ten thousand rows. The stateful step behind it stays exact."""
    import numpy as np

    for batch in batches:
        keys = batch.column(batch.schema.names.index("url_key")).dictionary_encode().indices.to_numpy(zero_copy_only=False)
        first = np.sort(np.unique(keys, return_index=True)[1])
        yield batch if len(first) == batch.num_rows else batch.take(first)


def stream_import_urls(urls: DataFrame, out: str, checkpoint: str, within: str | None = None, event_time: str | None = None) -> StreamingQuery:
    """Stream of (url, ..) -> only canonical URLs never seen before (case ignored).

    State holds one key per URL. With `within` the state is bounded: duplicates inside that delay of event time are
    dropped and older keys expire."""
    keyed = (
        with_canonical_url(urls, "url", "canonical_url").filter(F.col("canonical_url").isNotNull())
        .withColumn("url_key", F.lower("canonical_url"))
    )
    if within:  # every row counts for the watermark, so none is thinned out
        fresh = keyed.withWatermark(event_time, within).dropDuplicatesWithinWatermark(["url_key"])
    else:
        fresh = keyed.mapInArrow(_unique_per_batch, keyed.schema).dropDuplicates(["url_key"])
    return (
        fresh.writeStream.format("parquet").outputMode("append").option("path", out)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def stream_attempt_windows(
    attempts: DataFrame, out: str, checkpoint: str, width: str = "1 hour", slide: str | None = None, delay: str = "10 minutes"
) -> StreamingQuery:
    """Attempts and failures per endpoint and window; a window is written once the watermark has passed it."""
    windowed = attempts.withWatermark("attempted_at", delay)
    span = F.window("attempted_at", width, slide) if slide else F.window("attempted_at", width)
    counts = windowed.groupBy("endpoint_id", span.alias("w")).agg(
        F.count(F.lit(1)).alias("attempts"), F.count_if(F.col("outcome") != "success").alias("failures"),
    ).select("endpoint_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "attempts", "failures")
    return (
        counts.writeStream.format("parquet").outputMode("append").option("path", out)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def stream_attempt_sessions(
    attempts: DataFrame, out: str, checkpoint: str, gap_seconds: int = fv.LEASE_TTL_SECONDS, delay: str = "10 minutes"
) -> StreamingQuery:
    """Session windows per session key with the lease lifetime as gap."""
    sessions = (
        attempts.withWatermark("attempted_at", delay)
        .groupBy("session_key", F.session_window("attempted_at", f"{gap_seconds} seconds").alias("w"))
        .agg(F.count(F.lit(1)).alias("attempts"), F.count_if(F.col("outcome") != "success").alias("failures"))
        .select("session_key", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "attempts", "failures")
    )
    return (
        sessions.writeStream.format("parquet").outputMode("append").option("path", out)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SUMMARY = (
    "success_count long, failure_count long, latency_sum double, first_latency double, tail_failures long, last_us long, "
    "last_outcome string, cooldown_us long"
)
SUMMARY_COLUMNS = [field.split()[0] for field in SUMMARY.split(", ")]


def _slice_summary(rows: Column) -> Column:
    """Fold of one time slice's attempts (array of structs in time order): the summary that slices are merged by."""
    empty = F.struct(
        F.lit(0).cast("long").alias("success_count"), F.lit(0).cast("long").alias("failure_count"), F.lit(0.0).alias("latency_sum"),
        F.lit(None).cast("double").alias("first_latency"), F.lit(0).cast("long").alias("tail_failures"),
        F.lit(None).cast("long").alias("last_us"), F.lit(None).cast("string").alias("last_outcome"), F.lit(None).cast("long").alias("cooldown_us"))

    def step(s: Column, r: Column) -> Column:
        latency = r["duration_ms"].cast("double")
        until = r["us"] + F.coalesce(r["retry"], F.lit(float(fv.COOLDOWN_SECONDS))).cast("decimal(18,6)") * 1_000_000
        good = F.struct(
            (s["success_count"] + 1).alias("success_count"), s["failure_count"].alias("failure_count"),
            (s["latency_sum"] * fv.EWMA_KEEP + F.coalesce(latency * fv.EWMA_NEW, F.lit(0.0))).alias("latency_sum"),
            F.when(s["success_count"] == 0, latency).otherwise(s["first_latency"]).alias("first_latency"),
            F.lit(0).cast("long").alias("tail_failures"), r["us"].alias("last_us"), r["outcome"].alias("last_outcome"),
            F.lit(None).cast("long").alias("cooldown_us"))
        bad = F.struct(
            s["success_count"].alias("success_count"), (s["failure_count"] + 1).alias("failure_count"), s["latency_sum"].alias("latency_sum"),
            s["first_latency"].alias("first_latency"), (s["tail_failures"] + 1).alias("tail_failures"), r["us"].alias("last_us"),
            r["outcome"].alias("last_outcome"),
            F.when(r["outcome"].isin(fv.ROTATING_OUTCOMES), until.cast("long")).otherwise(s["cooldown_us"]).alias("cooldown_us"))
        return F.when(r["outcome"] == "success", good).otherwise(bad)

    return F.aggregate(rows, empty, step)


def merged_summary(older: tuple | None, newer: tuple) -> tuple:
    """Two summaries of one endpoint, in time order, as one."""
    if older is None:
        return newer
    succeeded, failed, latency, first, tail, _, _, cooldown = older
    k = newer[0]
    return (
        succeeded + k, failed + newer[1], latency * fv.EWMA_KEEP ** k + newer[2], first if succeeded else newer[3],
        newer[4] if k else tail + newer[4], newer[5], newer[6], newer[7] if k or newer[7] is not None else cooldown)


class EndpointHealth(StatefulProcessor):
    """Keyed state: an endpoint's summary and the end of its newest slice. The slices of a batch all end after those of
    earlier batches, as an append-mode window is closed once by the watermark, so they are merged in order of their end.
    With `forget_seconds`, an event-time timer drops an endpoint that has been quiet for so long."""

    def __init__(self, forget_seconds: int | None):
        self.forget_ms = None if forget_seconds is None else forget_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.summary = handle.getValueState("summary", f"slice_us long, {SUMMARY}")

    def handleInputRows(self, key, rows, timerValues):
        stored = self.summary.get() if self.summary.exists() else None
        merged, end = (None, None) if stored is None else (tuple(stored[1:]), stored[0])
        before = end
        for row in sorted(rows, key=lambda r: r["slice_us"]):
            merged, end = merged_summary(merged, tuple(row[c] for c in SUMMARY_COLUMNS)), row["slice_us"]
        self.summary.update((end, *merged))
        if self.forget_ms is not None:
            if before is not None:
                self.handle.deleteTimer(before // 1000 + self.forget_ms)
            self.handle.registerTimer(end // 1000 + self.forget_ms)
        yield Row(endpoint_id=key[0], slice_us=end, **dict(zip(SUMMARY_COLUMNS, merged)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.summary.clear()
        return iter([])

    def close(self) -> None:
        pass


def stream_endpoint_health(
    attempts: DataFrame, out: str, checkpoint: str, delay: str = "0 seconds", slice_seconds: int = att.SLICE_SECONDS,
    forget_seconds: int | None = None,
) -> StreamingQuery:
    """Running endpoint health as a change log under `out`: one row per endpoint that a batch changed.

    Attempts wait in (endpoint, time slice) windows until the watermark (newest attempt less `delay`) has passed a slice;
    attempts behind the watermark are late and dropped. A busy endpoint is spread over its slices; what reaches its keyed
    state (RocksDB, one value per endpoint) is one summary a slice. Rows without an endpoint only move the watermark."""
    retry = F.col("retry_after_seconds").cast("double") if "retry_after_seconds" in attempts.columns else F.lit(None).cast("double")
    key = attempts.schema["endpoint_id"].dataType.simpleString()
    rows = F.struct(F.unix_micros("attempted_at").alias("us"), "id", "outcome", "duration_ms", retry.alias("retry"))
    slices = (
        attempts.withColumn("attempted_at", F.col("attempted_at").cast("timestamp")).withWatermark("attempted_at", delay)
        .groupBy("endpoint_id", F.window("attempted_at", f"{slice_seconds} seconds").alias("w"))
        .agg(F.sort_array(F.collect_list(rows)).alias("rows"), F.count("endpoint_id").alias("known"))
        .filter("known > 0")  # on a count: a test of the key would move below the watermark and hide the row from it
        .select("endpoint_id", F.window_time("w").alias("event_time"), F.unix_micros("w.end").alias("slice_us"), _slice_summary(F.col("rows")).alias("s"))
        .select("endpoint_id", "event_time", "slice_us", "s.*")
    )
    changes = slices.groupBy("endpoint_id").transformWithState(
        EndpointHealth(forget_seconds), f"endpoint_id {key}, slice_us long, {SUMMARY}", "Append", "EventTime")
    spark = attempts.sparkSession
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, ROCKSDB)   # keyed state variables need it; the query keeps a copy of the settings from its start
    try:
        return (
            changes.writeStream.format("parquet").outputMode("append").option("path", out)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
    finally:
        spark.conf.set(provider, before)


def latest_health(spark: SparkSession, out: str) -> DataFrame:
    """Newest health row of each endpoint in a change log."""
    newest = spark.read.parquet(out).groupBy("endpoint_id").agg(
        F.max_by(F.struct(*SUMMARY_COLUMNS), F.struct("slice_us", "success_count", "failure_count")).alias("s"))
    state = newest.select(
        "endpoint_id", "s.success_count", "s.failure_count", "s.latency_sum", "s.first_latency", "s.tail_failures",
        F.struct(F.timestamp_micros("s.last_us").alias("at")).alias("last_order"), "s.last_outcome",
        F.timestamp_micros("s.cooldown_us").alias("tail_cooldown"))
    return att.health_view(state)


def stream_analyze(
    spark: SparkSession, folder: str, out: str, checkpoint: str, registry: ExtractorRegistry | None = None,
    pattern: str | None = None,
) -> StreamingQuery:
    """New files -> observations exactly once.

    A batch is read once, into a table of its own by kind; which of its contents are new is decided on their hashes, and the
    extractors read that table. Its manifest, the hashes it added, is written last: a batch without one never happened,
    its replay overwrites what it left, and a batch with one changes nothing when it is replayed."""
    reader = spark.readStream.format("binaryFile").schema(
        "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    files = reader.load(folder).select(
        F.sha2("content", 256).alias("artifact_id"), F.col("path").alias("original_path"),
        F.col("length").alias("size"), F.col("modificationTime").alias("acquired_at"), "content",
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        staging = f"{out}/staging/batch={batch_id}"
        staged = stage_by_kind(batch, staging)
        # same bytes twice in one batch: keep one row, chosen by path; hashes and paths are read, not contents
        chosen = staged.groupBy("artifact_id").agg(F.min("original_path").alias("original_path"))
        if batch_id > 0:
            earlier = session.read.parquet(f"{out}/seen").filter(F.col("batch") < batch_id)
            chosen = chosen.join(earlier.select("artifact_id"), "artifact_id", "left_anti")
        chosen = chosen.checkpoint()
        unique = staged.join(chosen, ["artifact_id", "original_path"], "left_semi")
        observations, _ = extracted(unique, F.lit(None).cast("timestamp"), registry)
        observations.write.mode("overwrite").parquet(f"{out}/observations/batch={batch_id}")
        chosen.select("artifact_id").write.mode("overwrite").parquet(f"{out}/seen/batch={batch_id}")
        _delete(session, staging)

    shared_folder(spark)
    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _delete(spark: SparkSession, folder: str) -> None:
    """Remove a table that is no longer needed, on whatever file system holds it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
