"""Streams against a sequential fold: disorder, late rows, restarts, quiet keys."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from casegraph import fixed_values as fv
from casegraph.session import scratch_path
from casegraph.streaming import jobs

SCHEMA = "id long, endpoint_id string, attempted_at timestamp, outcome string, duration_ms double, retry_after_seconds double"
START = dt.datetime(2024, 1, 1)


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def folded(rows):
    """Health by endpoint, one attempt after another."""
    state = {}
    for _, endpoint, when, outcome, ms, retry in sorted(rows, key=lambda r: (r[2], r[0])):
        s = state.setdefault(endpoint, {"ok": 0, "bad": 0, "run": 0, "ewma": None, "until": None, "status": None})
        if outcome == "success":
            s.update(ok=s["ok"] + 1, run=0, until=None, status="healthy", ewma=ms if s["ewma"] is None else s["ewma"] * 0.8 + ms * 0.2)
        else:
            s.update(bad=s["bad"] + 1, run=s["run"] + 1, status="degraded")
            if outcome in fv.ROTATING_OUTCOMES:
                s.update(status="cooldown", until=when + dt.timedelta(seconds=120 if retry is None else retry))
    return {e: (s["ok"], s["bad"], s["run"], None if s["ewma"] is None else round(s["ewma"], 6), s["status"], s["until"]) for e, s in state.items()}


def result(spark, out):
    return {r.endpoint_id: (r.success_count, r.failure_count, r.consecutive_failures, None if r.ewma_latency_ms is None else round(r.ewma_latency_ms, 6), r.status, r.cooldown_until)
            for r in jobs.latest_health(spark, out).collect()}


@pytest.fixture
def feed(spark):
    """Send batches of rows through the job, each in a run of its own."""
    folder, out, checkpoint = (scratch_path(spark, n) for n in ("log", "health", "health-checkpoint"))

    def send(*batches, **options):
        for rows in batches:
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
            jobs.stream_endpoint_health(spark.readStream.schema(SCHEMA).parquet(folder), out, checkpoint, **options).awaitTermination()
        return out

    return send


def heartbeat(seconds):
    return [(None, None, at(seconds), None, None, None)]


def test_health_with_disorder_and_restarts(spark, feed):
    """A busy endpoint and others, shuffled within the delay, in three runs."""
    rng, rows = random.Random(5), []
    for k in range(900):
        endpoint = "busy" if rng.random() < 0.4 else f"e{rng.randrange(6)}"
        rows.append((k, endpoint, at(k * 2 + rng.random()), rng.choice(["success"] * 3 + ["rate_limited", "cancelled", "timeout"]), rng.random() * 100, rng.choice([None, 5.0, 0.25])))
    order = sorted(rows, key=lambda r: r[2] + dt.timedelta(seconds=rng.random() * 60))
    out = feed(order[:300], order[300:600], order[600:], heartbeat(10_000), delay="90 seconds", slice_seconds=30)
    assert result(spark, out) == folded(rows)
    logged = spark.read.parquet(out).groupBy("endpoint_id", "slice_us").count()
    assert logged.filter("count > 1").isEmpty()  # nothing is written again


def test_late_rows_are_dropped_by_the_watermark(spark, feed):
    rows = [(1, "a", at(0), "success", 10.0, None), (2, "a", at(500), "cancelled", 1.0, None)]
    late = [(3, "a", at(100), "success", 99.0, None), (4, "b", at(600), "success", 7.0, None)]
    out = feed(rows, late, heartbeat(5_000), delay="60 seconds")
    assert result(spark, out) == folded([*rows, late[1]])


def test_quiet_endpoints_are_forgotten(spark, feed):
    first = [(1, "a", at(0), "cancelled", 1.0, None), (2, "b", at(0), "cancelled", 1.0, None)]
    again = [(3, "a", at(10_000), "cancelled", 1.0, None)]
    out = feed(first, heartbeat(400), heartbeat(9_000), heartbeat(9_500), again, heartbeat(20_000), forget_seconds=3600)
    got = spark.read.parquet(out).filter("endpoint_id = 'a'").orderBy("slice_us").collect()
    assert [r.failure_count for r in got] == [1, 1]


def test_merging_is_associative():
    rng = random.Random(2)

    def one():
        ok = rng.random() < 0.5
        return (1, 0, 20.0 * rng.random(), rng.random(), 0, rng.randrange(9), "success", None) if ok else (0, 1, 0.0, None, 1, rng.randrange(9), "timeout", rng.choice([None, 5]))

    for _ in range(200):
        a, b, c = one(), one(), one()
        left, right = jobs.merged_summary(jobs.merged_summary(a, b), c), jobs.merged_summary(a, jobs.merged_summary(b, c))
        assert left[:2] == right[:2] and left[3:] == right[3:] and abs(left[2] - right[2]) < 1e-9


def test_bounded_import_forgets(spark):
    """A URL that comes again after its state has expired is new; before, it is not. IDN hosts are kept."""
    folder, out, checkpoint = (scratch_path(spark, n) for n in ("in", "urls", "urls-checkpoint"))
    schema = "url string, seen_at timestamp"
    for rows in ([("http://a.test/", at(0)), ("http://A.test", at(10))], [("http://a.test/", at(30)), ("http://bücher.test/", at(5000))], [("http://a.test/", at(5010))]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        jobs.stream_import_urls(spark.readStream.schema(schema).parquet(folder), out, checkpoint, within="1 minute", event_time="seen_at").awaitTermination()
    assert sorted(r.url_key for r in spark.read.parquet(out).collect()) == ["http://a.test/", "http://a.test/", "http://xn--bcher-kva.test/"]


def test_analysis_replays_a_batch_without_a_manifest(spark, tmp_path):
    """A batch that stopped before its manifest is done again; nothing is counted twice."""
    import os
    import shutil

    folder, out, checkpoint = tmp_path / "files", scratch_path(spark, "analysis"), scratch_path(spark, "analysis-checkpoint")
    folder.mkdir()
    run = lambda: jobs.stream_analyze(spark, str(folder), out, checkpoint, pattern="*.txt").awaitTermination()
    names = lambda: sorted(r.original_value for r in spark.read.parquet(f"{out}/observations").filter("category = 'username'").collect())
    (folder / "a.txt").write_text("username=ann\n")
    (folder / "same.txt").write_text("username=ann\n")
    run()
    (folder / "b.txt").write_text("username=bo\n")
    (folder / "again.txt").write_text("username=ann\n")
    run()
    assert names() == ["ann", "bo"] and not os.listdir(f"{out}/staging")
    # as if the second batch had failed before its manifest: neither it nor the commit of the batch exist
    shutil.rmtree(f"{out}/seen/batch=1")
    os.remove(f"{checkpoint}/commits/1")
    for crc in (f"{checkpoint}/commits/.1.crc",):
        if os.path.exists(crc):
            os.remove(crc)
    run()
    assert names() == ["ann", "bo"] and spark.read.parquet(f"{out}/seen").count() == 2


@pytest.mark.parametrize("name", ["stream_import_urls", "stream_import_urls_bounded"])
def test_streamed_table_may_be_a_folder(spark, tmp_path, name):
    """A table of several part files streams like a single file."""
    import __spark_entry__ as contract

    spark.read.parquet("/root/testdata/sf0.001/pages.parquet").limit(20).repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    want = spark.read.parquet(f"{tmp_path}/pages.parquet").select(F.lower("url")).distinct().count()
    assert contract.queries()[name](spark, str(tmp_path)).count() == want


def test_health_state_takes_rows():
    """Slices reach the state as plain rows, in any order; a data frame per endpoint cost more than the fold itself."""
    from pyspark.sql import Row

    class Value:
        held = None

        def exists(self):
            return self.held is not None

        def get(self):
            return self.held

        def update(self, value):
            self.held = value

    slice_of = lambda end, ok, bad: Row(endpoint_id="a", event_time=None, slice_us=end, **dict(zip(
        jobs.SUMMARY_COLUMNS, (ok, bad, 2.0 * ok, 10.0 if ok else None, bad, end - 1, "success" if ok else "timeout", None))))
    keyed = jobs.EndpointHealth(None)
    keyed.summary = Value()
    first = list(keyed.handleInputRows(("a",), iter([slice_of(120, 0, 1), slice_of(60, 1, 0)]), None))
    assert [(r.slice_us, r.success_count, r.failure_count, r.tail_failures, r.first_latency, r.last_us) for r in first] == [(120, 1, 1, 1, 10.0, 119)]
    second, = keyed.handleInputRows(("a",), iter([slice_of(180, 1, 0)]), None)
    assert (second.slice_us, second.success_count, second.tail_failures, second.last_outcome) == (180, 2, 0, "success")
