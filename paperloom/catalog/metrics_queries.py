"""Request metrics, rate limits, run reports, cache replay, and their streaming forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.catalog.fixtures import REQUEST_LOG, moment, request_log, table
from paperloom.catalog.registry import query
from paperloom.operators.metrics import (
    endpoint_counts,
    latency_last_n,
    metrics_snapshot,
    rate_limit_audit,
    run_report,
    ttl_dedupe,
)
from paperloom.streaming.runs import replay_run_report
from paperloom.streaming.metrics import replay_counts, replay_latency, replay_rate_limits, replay_ttl_dedupe

_COUNTS = """SELECT endpoint, count(*) AS requests, count(*) FILTER (WHERE status_code >= 400) AS failures
    FROM request_log GROUP BY endpoint"""
# Mean of cents as tenths, rounded half up in whole numbers.
_MEAN = "((2 * {cents} + 10 * {count}) // (20 * {count})) / 10.0"
_CENTS = "CAST(CAST(latency_ms AS DECIMAL(18, 2)) * 100 AS BIGINT)"


@query("endpoint_counts", f"WITH {REQUEST_LOG} {_COUNTS}")
def _endpoint_counts(spark, sf_dir):
    return endpoint_counts(request_log(spark, sf_dir))


@query("endpoint_counts_stream", f"WITH {REQUEST_LOG} {_COUNTS}")
def _endpoint_counts_stream(spark, sf_dir):
    return replay_counts(request_log(spark, sf_dir))


@query(
    "metrics_snapshot",
    f"""WITH {REQUEST_LOG}, counts AS ({_COUNTS}),
    recent AS (
        SELECT sum({_CENTS}) AS cents, count(*) AS calls
        FROM (SELECT * FROM request_log ORDER BY ts DESC, request_id DESC LIMIT 500))
    SELECT 'request_count' AS metric, endpoint, CAST(requests AS DOUBLE) AS value FROM counts
    UNION ALL SELECT 'failure_count', endpoint, failures FROM counts
    UNION ALL SELECT 'llm_avg_latency_ms', NULL, {_MEAN.format(cents="cents", count="calls")} FROM recent
    UNION ALL SELECT 'llm_calls_tracked', NULL, calls FROM recent""",
)
def _metrics_snapshot(spark, sf_dir):
    return metrics_snapshot(request_log(spark, sf_dir))


_LATENCY = f"""WITH {REQUEST_LOG}, sums AS (
        SELECT endpoint AS model, request_id, sum({_CENTS}) OVER w AS cents, count(*) OVER w AS calls_tracked
        FROM request_log
        WINDOW w AS (PARTITION BY endpoint ORDER BY ts, request_id ROWS BETWEEN 499 PRECEDING AND CURRENT ROW))
    SELECT model, request_id, calls_tracked,
           CAST({_MEAN.format(cents="cents", count="calls_tracked")} AS DOUBLE) AS avg_latency_ms FROM sums"""


@query("latency_last_n", _LATENCY)
def _latency_last_n(spark, sf_dir):
    calls = request_log(spark, sf_dir).withColumnRenamed("endpoint", "model")
    return latency_last_n(calls).select("model", "request_id", "calls_tracked", "avg_latency_ms")


@query("latency_stream", _LATENCY)
def _latency_stream(spark, sf_dir):
    return replay_latency(request_log(spark, sf_dir).withColumnRenamed("endpoint", "model"))


_AUDIT = """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S.%f') AS hour, endpoint AS client, endpoint,
    count(*) AS requests, greatest(count(*) - 3, 0) AS excess FROM request_log GROUP BY ALL"""


def _audited(log):
    """The endpoint stands in for the client, with a limit that some hours exceed."""
    return rate_limit_audit(log.withColumn("client", F.col("endpoint")), F.lit(3)).withColumn("hour", moment("hour"))


@query("rate_limit_audit", f"WITH {REQUEST_LOG} {_AUDIT}")
def _rate_limit_audit(spark, sf_dir):
    return _audited(request_log(spark, sf_dir))


@query(
    "rate_limit_default",
    f"""WITH {REQUEST_LOG}, hourly AS (
        SELECT date_trunc('hour', ts) AS hour, CASE endpoint WHEN 'click' THEN '/api/search/' ELSE endpoint END AS endpoint,
               count(*) AS requests FROM request_log GROUP BY ALL)
    SELECT strftime(hour, '%Y-%m-%d %H:%M:%S.%f') AS hour, 'all' AS client, endpoint, requests,
           greatest(requests - CASE endpoint WHEN '/api/search/' THEN 30 ELSE 100 END, 0) AS excess FROM hourly""",
)
def _rate_limit_default(spark, sf_dir):
    """The default limits, for one client who makes all requests; clicks stand in for searches, logged by their path."""
    log = request_log(spark, sf_dir).withColumn("client", F.lit("all"))
    named = F.when(F.col("endpoint") == "click", F.lit("/api/search/")).otherwise(F.col("endpoint"))
    return rate_limit_audit(log.withColumn("endpoint", named)).withColumn("hour", moment("hour"))


@query("rate_limit_stream", f"WITH {REQUEST_LOG} {_AUDIT}")
def _rate_limit_stream(spark, sf_dir):
    log = request_log(spark, sf_dir).withColumn("client", F.col("endpoint"))
    return replay_rate_limits(log, F.lit(3)).withColumn("hour", moment("hour"))


@query(
    "run_report",
    """WITH last AS (
        SELECT user_id, event_type, props, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n,
               count(*) OVER (PARTITION BY user_id) AS updates
        FROM events)
    SELECT c_custkey AS run_id,
           CASE WHEN user_id IS NULL THEN 'failed' WHEN event_type = 'error' THEN 'failed'
                WHEN event_type = 'purchase' THEN 'done' WHEN event_type = 'signup' THEN 'queued' ELSE 'running' END AS status,
           CASE WHEN user_id IS NULL THEN 'Unknown job_id' WHEN event_type = 'error' THEN props END AS error,
           coalesce(updates, 0) AS updates
    FROM customer LEFT JOIN last ON user_id = c_custkey AND n = 1""",
)
def _run_report(spark, sf_dir):
    """Events as status changes of runs, one run per user; customers ask, most for runs that do not exist."""
    asked = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("run_id"))
    return run_report(_run_events(spark, sf_dir), asked, order=("ts", "event_id"))


def _run_events(spark, sf_dir):
    kind = F.col("event_type")
    status = (
        F.when(kind == "error", F.lit("failed"))
        .when(kind == "purchase", F.lit("done"))
        .when(kind == "signup", F.lit("queued"))
        .otherwise(F.lit("running"))
    )
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run_id"),
        status.alias("status"),
        F.when(kind == "error", F.col("props")).alias("error"),
        F.col("ts").cast("timestamp").alias("ts"),
        "event_id",
    )


@query(
    "run_report_stream",
    """WITH asked AS (
        SELECT c_custkey AS run_id, TIMESTAMP '2024-01-05 00:00:00' + to_minutes(c_custkey * 7919 % 36000) AS asked_at FROM customer),
    last AS (
        SELECT run_id, asked_at, event_type, props, user_id,
               row_number() OVER (PARTITION BY run_id, asked_at ORDER BY ts DESC, event_id DESC) AS n,
               count(user_id) OVER (PARTITION BY run_id, asked_at) AS updates
        FROM asked LEFT JOIN events ON user_id = run_id AND ts <= asked_at AND ts > asked_at - INTERVAL 2 DAYS)
    SELECT run_id, strftime(asked_at, '%Y-%m-%d %H:%M:%S.%f') AS asked_at,
           CASE WHEN user_id IS NULL THEN 'failed' WHEN event_type = 'error' THEN 'failed'
                WHEN event_type = 'purchase' THEN 'done' WHEN event_type = 'signup' THEN 'queued' ELSE 'running' END AS status,
           CASE WHEN user_id IS NULL THEN 'Unknown job_id' WHEN event_type = 'error' THEN props END AS error, updates
    FROM last WHERE n = 1""",
)
def _run_report_stream(spark, sf_dir):
    """Customers ask at moments of their own; the last status of the two days before is the answer."""
    at = F.expr("TIMESTAMP '2024-01-05 00:00:00' + make_dt_interval(0, 0, CAST(c_custkey * 7919 % 36000 AS INT))")
    asked = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("run_id"), at.alias("asked_at"))
    return replay_run_report(_run_events(spark, sf_dir), asked, "2 days").withColumn("asked_at", moment("asked_at"))


def searches(spark, sf_dir):
    """Events as repeated searches: the user asks for the type of the event."""
    log = request_log(spark, sf_dir)
    return log.select(
        F.concat_ws("|", "endpoint", "client").alias("cache_key"), F.unix_micros("ts").alias("asked_us"), "ts"
    )


# The walk over a key's searches, one per step and all keys side by side.
_PASSING = """WITH RECURSIVE searches AS (
    SELECT DISTINCT event_type || '|user' || user_id AS cache_key, epoch_us(ts) AS asked_us FROM events),
numbered AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY cache_key ORDER BY asked_us) AS n FROM searches),
walk(cache_key, n, asked_us, passed, blocked_until) AS (
    SELECT cache_key, n, asked_us, TRUE, asked_us + {ttl}::BIGINT FROM numbered WHERE n = 1
    UNION ALL
    SELECT s.cache_key, s.n, s.asked_us, s.asked_us >= w.blocked_until,
           CASE WHEN s.asked_us >= w.blocked_until THEN s.asked_us + {ttl}::BIGINT ELSE w.blocked_until END
    FROM walk w JOIN numbered s ON s.cache_key = w.cache_key AND s.n = w.n + 1)
SELECT cache_key, asked_us FROM walk WHERE passed"""
# Three days, so that users do repeat themselves in time.
_TTL = 3 * 24 * 3600


@query("ttl_dedupe", _PASSING.format(ttl=_TTL * 1_000_000))
def _ttl_dedupe(spark, sf_dir):
    return ttl_dedupe(searches(spark, sf_dir), ttl_seconds=_TTL)


@query("ttl_dedupe_stream", _PASSING.format(ttl=_TTL * 1_000_000))
def _ttl_dedupe_stream(spark, sf_dir):
    return replay_ttl_dedupe(searches(spark, sf_dir).select("cache_key", "asked_us"), ttl_seconds=_TTL)
