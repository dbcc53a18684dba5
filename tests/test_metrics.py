import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from paperloom.operators.metrics import (
    MICROS,
    endpoint_counts,
    hourly_limit,
    latency_last_n,
    metrics_snapshot,
    rate_limit_audit,
    run_report,
    ttl_dedupe,
)
from paperloom.streaming import cache
from paperloom.streaming.replay import replay, time_slices
from paperloom.streaming.metrics import latest_output, replay_latency, replay_rate_limits, replay_ttl_dedupe, start_ttl_dedupe


def requests(spark, rows):
    frame = spark.createDataFrame(rows, "request_id bigint, second bigint, endpoint string, status_code int, latency_ms double")
    return frame.withColumn("ts", F.timestamp_seconds("second")).drop("second")


def test_counts_and_snapshot(spark):
    log = requests(spark, [(1, 1, "search", 200, 10.0), (2, 2, "search", 500, None), (3, 3, "gaps", 404, 10.1)])
    assert {tuple(row) for row in endpoint_counts(log).collect()} == {("search", 2, 1), ("gaps", 1, 1)}
    values = {(row.metric, row.endpoint): row.value for row in metrics_snapshot(log).collect()}
    assert values[("llm_avg_latency_ms", None)] == 10.1 and values[("llm_calls_tracked", None)] == 2
    nothing = {row.metric: row.value for row in metrics_snapshot(log.where("false")).collect()}
    assert nothing == {"llm_avg_latency_ms": None, "llm_calls_tracked": 0}


def test_running_latency_over_block_borders(spark):
    """One model and one moment hold most of the calls."""
    draw = random.Random(5)
    rows = [(n, 7 if n % 3 else draw.randint(0, 9), "hot" if n % 4 else "cold", 200, draw.randint(0, 9999) / 100) for n in range(400)]
    calls = requests(spark, rows).withColumnRenamed("endpoint", "model")
    found = {row.request_id: row for row in latency_last_n(calls, window=7, block_rows=10).collect()}
    for model in ("hot", "cold"):
        history = sorted((second, key, latency) for key, second, name, _, latency in rows if name == model)
        for n, (_, key, _) in enumerate(history):
            last = history[max(0, n - 6) : n + 1]
            cents = sum(round(latency * 100) for _, _, latency in last)
            assert found[key].calls_tracked == len(last)
            assert found[key].avg_latency_ms == ((2 * cents + 10 * len(last)) // (20 * len(last))) / 10
    assert len(found) == 400


def test_rate_limits(spark):
    rows = [(n, 10 + n, "search", 200, 1.0) for n in range(32)] + [(99, 3700, "search", 200, 1.0)]
    log = requests(spark, rows).withColumn("client", F.lit("c"))
    batch = sorted((str(row.hour), row.requests, row.excess) for row in rate_limit_audit(log).collect())
    assert batch == [("1970-01-01 00:00:00", 32, 2), ("1970-01-01 01:00:00", 1, 0)]
    stream = replay_rate_limits(log).collect()
    assert sorted((str(row.hour), row.requests, row.excess) for row in stream) == batch


def test_run_report(spark):
    events = spark.createDataFrame(
        [("r", "running", 2, None), ("r", "queued", 1, None), ("f", "failed", 5, "boom")], "run_id string, status string, ts int, error string"
    )
    asked = spark.createDataFrame([("r",), ("f",), ("u",)], "run_id string")
    found = {row.run_id: (row.status, row.error) for row in run_report(events, asked).collect()}
    assert found == {"r": ("running", None), "f": ("failed", "boom"), "u": ("failed", "Unknown job_id")}


def passing(rows, ttl):
    result, open_from = set(), {}
    for key, at in sorted(rows):
        if at >= open_from.get(key, -1):
            result.add((key, at))
            open_from[key] = at + ttl
    return result


def searches(spark, seed):
    draw = random.Random(seed)
    rows = [("hot", draw.randint(0, 300 * MICROS)) for _ in range(2500)]
    rows += [(f"k{draw.randint(0, 30)}", draw.randint(0, 900) * MICROS) for _ in range(1500)]
    return rows, spark.createDataFrame(rows, "cache_key string, asked_us bigint")


@pytest.mark.parametrize("seed", [4096, 3])
def test_cache_replay_equals_the_walk(spark, seed):
    """With a tiny bound every session goes through pointer doubling."""
    rows, frame = searches(spark, seed)
    found = {tuple(row) for row in ttl_dedupe(frame, ttl_seconds=20).collect()}
    assert found == passing(rows, 20 * MICROS)


@pytest.mark.parametrize("parts", [1, 4])
def test_cache_replay_as_a_stream(spark, parts):
    """Parts have no order in time; every part but the first is taken up by a restarted query."""
    rows, frame = searches(spark, 1)
    found = [tuple(row) for row in replay_ttl_dedupe(frame, ttl_seconds=20, parts=parts).collect()]
    assert len(found) == len(set(found))
    assert set(found) == passing(rows, 20 * MICROS)


@pytest.mark.parametrize("keep", [None, "1000 seconds"])
def test_keys_of_a_group_share_calls_and_state(spark, monkeypatch, keep):
    """Two groups for all keys, a null one and an empty one among them: calls do not grow with the keys."""
    monkeypatch.setattr(cache, "KEY_GROUPS", 2)
    calls = spark.sparkContext.accumulator(0)

    class Counted(cache.PassingSearches):
        def handleInputRows(self, key, rows, timerValues):
            calls.add(1)
            return super().handleInputRows(key, rows, timerValues)

    monkeypatch.setattr(cache, "PassingSearches", Counted)
    rows = [row for row in searches(spark, 2)[0] if row[1]]
    frame = spark.createDataFrame(rows, "cache_key string, asked_us bigint")
    odd = [(None, 5 * MICROS), (None, 9 * MICROS), (None, 40 * MICROS), ("", 5 * MICROS)]
    frame = frame.union(spark.createDataFrame(odd, frame.schema))
    found = [tuple(row) for row in replay_ttl_dedupe(frame, ttl_seconds=20, parts=2, keep=keep).collect()]
    assert len(found) == len(set(found))
    known = passing(rows, 20 * MICROS) | {(None, 5 * MICROS), (None, 40 * MICROS), ("", 5 * MICROS)}
    assert set(found) == known
    assert 0 < calls.value <= 2 * 2


def test_a_late_search_takes_answers_back(spark, tmp_path):
    """Each part is one search; the answers after every part are those of the walk over all until then."""
    root = str(tmp_path)
    seen = set()
    for moments in ([100, 110, 121, 400], [95], [106, 89], [410]):
        seen |= {("k", at * MICROS) for at in moments}
        part = spark.createDataFrame([*[("k", at * MICROS) for at in moments], (None, 7), ("k", None)], "cache_key string, asked_us bigint")
        replay([part], f"{root}/landing", lambda stream: start_ttl_dedupe(stream, root, 10))
        found = latest_output(spark, root, ["cache_key", "asked_us"]).where("passes").select("cache_key", "asked_us")
        known = {tuple(row) for row in found.collect()}
        assert {row for row in known if row[0]} == passing(seen, 10 * MICROS)
    assert (None, 7) in known


def test_state_ends_behind_the_watermark(spark, tmp_path):
    """A request behind the watermark is left out; one within it still corrects the answers."""
    root = str(tmp_path)
    for moments in ([1_000], [1_100], [1_090, 5], [1_085]):
        part = spark.createDataFrame([("k", at * MICROS) for at in moments], "cache_key string, asked_us bigint")
        replay([part], f"{root}/landing", lambda stream: start_ttl_dedupe(stream, root, 10, "60 seconds"))
    found = latest_output(spark, root, ["cache_key", "asked_us"]).where("passes")
    assert {row.asked_us // MICROS for row in found.collect()} == {1_000, 1_085, 1_100}


def test_running_means_as_a_stream(spark):
    """Batches follow each other in time; the list of the last calls goes on from one to the next."""
    draw = random.Random(4)
    rows = [(draw.choice("aab"), draw.randrange(400), n, None if n % 9 == 0 else draw.randrange(1_000) / 4) for n in range(300)]
    calls = spark.createDataFrame(rows, "model string, second long, request_id long, latency_ms double").withColumn("ts", F.timestamp_seconds("second"))
    columns = ["model", "request_id", "avg_latency_ms", "calls_tracked"]
    want = latency_last_n(calls, window=7).select(columns).collect()
    assert sorted(map(tuple, replay_latency(calls, window=7).select(columns).collect())) == sorted(map(tuple, want))


def test_calls_without_a_latency_count_for_nothing(spark):
    calls = spark.createDataFrame(
        [("m", datetime(2024, 1, 1), 1, 10.0), ("m", datetime(2024, 1, 2), 2, None)], "model string, ts timestamp, request_id long, latency_ms double"
    )
    assert [(row.avg_latency_ms, row.calls_tracked) for row in latency_last_n(calls).collect()] == [(10.0, 1)]


def test_the_default_limit_knows_the_request_path(spark):
    paths = spark.createDataFrame([("/api/search",), ("search",), ("/api/papers",), (None,)], "endpoint string")
    assert [row[0] for row in paths.select(hourly_limit(F.col("endpoint"))).collect()] == [30, 30, 100, 100]


def test_rows_without_a_time_are_landed(spark, tmp_path):
    rows = spark.createDataFrame([(n, None if n % 4 == 0 else n) for n in range(20)], "id long, at long")
    batches = []

    def start(stream):
        return (
            stream.writeStream.foreachBatch(lambda batch, number: batches.append({row.at for row in batch.collect()}))
            .option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
        )

    replay(time_slices(rows.repartition(3), "at"), str(tmp_path / "landing"), start)
    assert spark.read.parquet(str(tmp_path / "landing")).count() == 20
    assert len(batches) == 3 and None in batches[0]
    assert max(batches[0] - {None}) < min(batches[1]) and max(batches[1]) < min(batches[2])
