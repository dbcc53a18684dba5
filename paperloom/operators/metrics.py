"""Request counts, latency, rate limits, run reports, replay of the search cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paperloom.schemas import CACHE_TTL_SECONDS, DEFAULT_LIMIT_PER_HOUR, LATENCY_WINDOW, SEARCH_LIMIT_PER_HOUR
from paperloom.session import cut_lineage

LATENCY_BLOCK = 65_536
MICROS = 1_000_000


def endpoint_counts(requests: DataFrame) -> DataFrame:
    """Requests and failures (status 400 and above) per endpoint; batch or stream."""
    return requests.groupBy("endpoint").agg(
        F.count("*").alias("requests"), F.count_if(F.col("status_code") >= 400).alias("failures")
    )


def mean_to_tenths(cents: Column, count: Column) -> Column:
    """Mean of ``count`` amounts summing to ``cents`` hundredths, rounded half up to one decimal in whole numbers."""
    tenths = F.floor((2 * cents + 10 * count) / (20 * count))
    return F.when(count > 0, tenths / F.lit(10.0))


def cents(latency: str) -> Column:
    return (F.col(latency).cast("decimal(18,2)") * 100).cast("bigint")


def metrics_snapshot(requests: DataFrame, window: int = LATENCY_WINDOW) -> DataFrame:
    """``(metric, endpoint, value)``: counts per endpoint, mean latency and number of the most recent calls.

    Only requests with a latency are calls.  The recent ones are a distributed top-k.
    """
    counts = endpoint_counts(requests)
    per_endpoint = counts.select(
        F.explode(
            F.array(
                F.struct(F.lit("request_count").alias("metric"), "endpoint", F.col("requests").alias("value")),
                F.struct(F.lit("failure_count").alias("metric"), "endpoint", F.col("failures").alias("value")),
            )
        ).alias("row")
    ).select("row.metric", "row.endpoint", F.col("row.value").cast("double").alias("value"))
    recent = (
        requests.where(F.col("latency_ms").isNotNull())
        .select("ts", "request_id", cents("latency_ms").alias("cents"))
        .orderBy(F.col("ts").desc(), F.col("request_id").desc())
        .limit(window)
        .agg(F.coalesce(F.sum("cents"), F.lit(0)).alias("cents"), F.count("*").alias("calls"))
    )
    no_endpoint = F.lit(None).cast("string").alias("endpoint")
    latency = recent.select(
        F.explode(
            F.array(
                F.struct(
                    F.lit("llm_avg_latency_ms").alias("metric"), mean_to_tenths(F.col("cents"), F.col("calls")).alias("value")
                ),
                F.struct(F.lit("llm_calls_tracked").alias("metric"), F.col("calls").cast("double").alias("value")),
            )
        ).alias("row")
    ).select("row.metric", no_endpoint, "row.value")
    return per_endpoint.unionByName(latency)


def latency_last_n(calls: DataFrame, window: int = LATENCY_WINDOW, block_rows: int = LATENCY_BLOCK) -> DataFrame:
    """Mean latency over the last ``window`` calls of a model as seen after every call; calls without one are left out.

    ``calls(model, ts, request_id, latency_ms)``.  A range partitioning on the full sort key gives every call its
    position in its model's history, whatever the share of one model or moment.  Fixed-length blocks of positions, each
    preceded by the ``window - 1`` calls before it, are then averaged independently.
    """
    if block_rows < window:
        raise ValueError("a block must be at least as long as the window")
    order = ["model", "ts", "request_id"]
    spread = cut_lineage(
        calls.where("latency_ms is not null").select(*order, cents("latency_ms").alias("cents"))
        .repartitionByRange(*order)
        .withColumn("part", F.spark_partition_id())
    )
    before = W.partitionBy("model").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = spread.groupBy("model", "part").agg(F.count("*").alias("rows")).select(
        "model", "part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start")
    )
    nth = F.row_number().over(W.partitionBy("model", "part").orderBy("ts", "request_id"))
    placed = spread.join(starts, ["model", "part"]).withColumn("position", F.col("start") + nth - 1)
    own = F.floor(F.col("position") / block_rows)
    needed_next = F.pmod("position", F.lit(block_rows)) > block_rows - window
    blocks = F.when(needed_next, F.array(own, own + 1)).otherwise(F.array(own))
    copies = placed.select(*order, "cents", "position", own.alias("own"), F.explode(blocks).alias("block"))
    # Running sums and their value one window ago, instead of summing the window again for every call.
    running = W.partitionBy("model", "block").orderBy("position")
    summed = copies.withColumn("total", F.sum("cents").over(running.rowsBetween(W.unboundedPreceding, 0)))
    last_sum = F.col("total") - F.coalesce(F.lag("total", window).over(running), F.lit(0))
    tracked = F.least(F.col("position") + 1, F.lit(window)).cast("bigint")
    means = summed.select(*order, "own", "block", last_sum.alias("sum"), tracked.alias("calls_tracked"))
    return means.where(F.col("own") == F.col("block")).select(
        *order, mean_to_tenths(F.col("sum"), F.col("calls_tracked")).alias("avg_latency_ms"), "calls_tracked"
    )


def hourly_limit(endpoint: Column) -> Column:
    """Searches have a limit of their own, whether the endpoint is logged by name or by request path."""
    return F.when(F.regexp_replace(endpoint, "^/(api/)?|/$", "") == "search", F.lit(SEARCH_LIMIT_PER_HOUR)).otherwise(F.lit(DEFAULT_LIMIT_PER_HOUR))


def rate_limit_audit(requests: DataFrame, limit: Column | None = None) -> DataFrame:
    """Requests per client, endpoint and clock hour, with how many exceed the limit; batch or watermarked stream."""
    limit = hourly_limit(F.col("endpoint")) if limit is None else limit
    counted = requests.groupBy(F.window("ts", "1 hour").alias("hour"), "client", "endpoint").agg(
        F.count("*").alias("requests")
    )
    return counted.select(
        F.col("hour.start").alias("hour"),
        "client",
        "endpoint",
        "requests",
        F.greatest(F.col("requests") - limit, F.lit(0)).cast("bigint").alias("excess"),
    )


def run_report(run_events: DataFrame, asked: DataFrame, order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """Latest status and error of every asked run; an unknown run counts as failed."""
    latest = run_events.groupBy("run_id").agg(
        F.max_by(F.struct("status", "error"), F.struct(*order)).alias("last"), F.count("*").alias("updates")
    )
    known = F.col("last").isNotNull()
    return asked.select("run_id").distinct().join(latest, "run_id", "left").select(
        "run_id",
        F.when(known, F.col("last.status")).otherwise(F.lit("failed")).alias("status"),
        F.when(known, F.col("last.error")).otherwise(F.lit("Unknown job_id")).alias("error"),
        F.coalesce("updates", F.lit(0)).alias("updates"),
    )


def ttl_dedupe(searches: DataFrame, ttl_seconds: int = CACHE_TTL_SECONDS) -> DataFrame:
    """Searches that reach the sources when results are cached for ``ttl_seconds``: ``(cache_key, asked_us)``.

    ``searches(cache_key, asked_us)`` with ``asked_us`` in microseconds.  The first search of a key passes and answers the same
    search until the time is over, then the next one passes.  A pause of the full time restarts a key, so its history
    falls apart into sessions.  Within a session every search points to the one that would pass next, and doubling the
    pointers marks all that are reached from the first in logarithmically many rounds.
    """
    ttl = ttl_seconds * MICROS
    moments = searches.select("cache_key", "asked_us").distinct().withColumn("slot", F.floor(F.col("asked_us") / ttl))
    slots = moments.groupBy("cache_key", "slot").agg(
        F.min("asked_us").alias("first_at"), F.max("asked_us").alias("last_at"), F.count("*").alias("rows")
    )
    history = W.partitionBy("cache_key").orderBy("slot")
    restart = F.coalesce(F.col("first_at") - F.lag("last_at").over(history) >= ttl, F.lit(True))
    numbered = slots.withColumn("restart", restart.cast("int")).withColumn("session", F.sum("restart").over(history))
    sessions = numbered.select("cache_key", "slot", "session")
    return _passing_by_doubling(cut_lineage(moments.join(sessions, ["cache_key", "slot"]).drop("slot")), ttl)


def _passing_by_doubling(moments: DataFrame, ttl: int) -> DataFrame:
    """Passing searches of every session by pointer doubling; all groups are single moments or short time slices."""
    steps = cut_lineage(_next_passing(moments, ttl))
    reached = cut_lineage(
        moments.groupBy("cache_key", "session").agg(F.min("asked_us").alias("asked_us")).select("cache_key", "session", "asked_us")
    )
    while not steps.isEmpty():
        onward = reached.join(steps, ["cache_key", "session", "asked_us"]).select(
            "cache_key", "session", F.col("next_us").alias("asked_us")
        )
        reached = cut_lineage(reached.unionByName(onward))
        following = steps.select("cache_key", "session", F.col("asked_us").alias("next_us"), F.col("next_us").alias("after"))
        steps = cut_lineage(
            steps.join(following, ["cache_key", "session", "next_us"]).select(
                "cache_key", "session", "asked_us", F.col("after").alias("next_us")
            )
        )
    return reached.select("cache_key", "asked_us")


def _next_passing(moments: DataFrame, ttl: int) -> DataFrame:
    """``(cache_key, session, asked_us, next_us)``: the first moment at least ``ttl`` later, where there is one.

    Probes at ``asked_us + ttl`` are sorted among the moments of their own short slice; a probe with nothing behind it in the
    slice takes the start of the next filled slice.
    """
    width = max(ttl // 64, 1)
    slot = F.floor(F.col("asked_us") / width)
    own = moments.select("cache_key", "session", slot.alias("slot"), "asked_us", F.lit(None).cast("bigint").alias("asker"))
    probes = moments.select("cache_key", "session", F.col("asked_us").alias("asker"), (F.col("asked_us") + ttl).alias("asked_us")).select(
        "cache_key", "session", slot.alias("slot"), "asked_us", "asker"
    )
    mixed = own.unionByName(probes)
    real = F.when(F.col("asker").isNull(), F.col("asked_us"))
    # Both look ahead, so they run backwards: a frame from the start of the partition grows by a row at a time.
    within = (
        W.partitionBy("cache_key", "session", "slot")
        .orderBy(F.col("asked_us").desc(), F.col("asker").desc_nulls_first())
        .rowsBetween(W.unboundedPreceding, 0)
    )
    beyond = W.partitionBy("cache_key", "session").orderBy(F.col("slot").desc()).rowsBetween(W.unboundedPreceding, -1)
    later = mixed.groupBy("cache_key", "session", "slot").agg(F.min(real).alias("first_at")).select(
        "cache_key", "session", "slot", F.last("first_at", ignorenulls=True).over(beyond).alias("later_at")
    )
    found = mixed.withColumn("next_us", F.last(real, ignorenulls=True).over(within)).where(F.col("asker").isNotNull())
    return (
        found.join(later, ["cache_key", "session", "slot"])
        .select("cache_key", "session", F.col("asker").alias("asked_us"), F.coalesce("next_us", "later_at").alias("next_us"))
        .where(F.col("next_us").isNotNull())
    )
