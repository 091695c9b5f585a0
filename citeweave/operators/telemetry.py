"""Call telemetry: summaries, latency percentiles, sessions. Prices are left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeweave.functions.skew import running
from citeweave.session import table


def calls(events: DataFrame) -> DataFrame:
    """Events as calls: (event_id, ts, call_type, model, prompt_tokens, answer_tokens, latency_ms, cache_hit)."""
    k = F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0))
    return events.select("event_id", "ts", "user_id", F.col("event_type").alias("call_type"), k.alias("prompt_tokens"), (k % 10).alias("answer_tokens"), F.col("value").alias("latency_ms"), (F.col("event_type") == "click").alias("cache_hit"))


def percentile_at(df: DataFrame, value: str, rules: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """Order statistics: for each rule, an expression of the row count n giving a 0-based position, the value there.

    Counts per value are summed first and then run through in parts (see running), so that no task holds all values of
    a group. Nulls are left out.
    """
    by = by or []
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    run = running(counts, by, [F.col(value)], F.col("_c"), "_lo")
    total = counts.groupBy(*by).agg(F.sum("_c").alias("n"))
    at = {k: F.greatest(F.lit(0), F.least(p, F.col("n") - 1)) for k, p in rules.items()}
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by]
    both = run.alias("a").join(total.alias("b"), same).select(*(F.col(f"a.{c}") for c in run.columns), "n") if by else run.crossJoin(F.broadcast(total))  # one row
    return both.groupBy(*by).agg(*(F.max(F.when((F.col("_lo") <= p) & (F.col("_lo") + F.col("_c") > p), F.col(value))).alias(k) for k, p in at.items()))


def summary(calls_: DataFrame) -> DataFrame:
    """One row: counts, token sums, mean latency, hit rate in percent."""
    n = F.count("*")
    return calls_.agg(
        n.alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("answer_tokens").alias("answer_tokens"), F.round(F.avg("latency_ms"), 6).alias("latency"),
        F.count_if("cache_hit").alias("hits"), F.round(F.when(n > 0, 100.0 * F.count_if("cache_hit") / n).otherwise(0.0), 6).alias("hit_rate"),
    )


def sessions(events: DataFrame, gap_minutes: int = 30) -> DataFrame:
    """(user_id, session, began, ended, n): runs of a user's events with gaps of at most gap_minutes."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    start = F.coalesce((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp")) > gap_minutes * 60_000_000), F.lit(True))
    df = events.withColumn("session", F.sum(start.cast("int")).over(w))
    return df.groupBy("user_id", "session").agg(F.min("ts").alias("began"), F.max("ts").alias("ended"), F.count("*").alias("n"))


def _e(spark, d):
    return table(spark, d, "events")


def _q_summary(spark, d):
    return summary(calls(_e(spark, d)))


def _rules():
    n = F.col("n")
    return {"p50_index": F.floor(n * 0.5), "p95_index": F.floor(n * 0.95), "p50_floor": F.floor(n * 0.5) - 1, "p95_floor": F.floor(n * 0.95) - 1}


def _q_percentiles(spark, d):
    return percentile_at(_e(spark, d), "value", _rules())


def _q_latency_by_kind(spark, d):
    a = table(spark, d, "d_oos_full_answers").withColumn("kind", F.coalesce("kind", F.lit("unknown")))
    return percentile_at(a, "latency_ms", _rules(), ["kind"])


def _q_last(spark, d):
    return calls(_e(spark, d)).orderBy(F.desc("ts"), F.desc("event_id")).limit(10).select("event_id", "call_type", "latency_ms")


def _q_tumbling(spark, d):
    e = _e(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")


def _q_sliding(spark, d):
    e = _e(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy(F.window("ts", "1 day", "12 hours").alias("w")).agg(F.count("*").alias("n")).select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("start"), "n")


def _q_sessions(spark, d):
    return sessions(_e(spark, d)).groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


def _q_eta(spark, d):
    """Per user, the median of the last 30 latencies up to each event, times the events left."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    df = _e(spark, d).withColumn("last", F.array_sort(F.collect_list("value").over(w.rowsBetween(-29, 0))))
    left = F.count("*").over(Window.partitionBy("user_id")) - F.row_number().over(w)
    n = F.size("last")
    mid = (F.element_at("last", F.floor((n + 1) / 2).cast("int")) + F.element_at("last", F.floor((n + 2) / 2).cast("int"))) / 2
    return df.select("event_id", F.round(mid * left, 6).alias("eta"))


_CALLS = "k AS (SELECT *, coalesce((props->>'$.k')::BIGINT, 0) AS p, coalesce((props->>'$.k')::BIGINT, 0) % 10 AS a, event_type = 'click' AS hit FROM events)"
_PICK = "l[1 + greatest(0, least({p}, n - 1))]"
_PCT = ", ".join(f"{_PICK.format(p=p)} AS {k}" for k, p in {"p50_index": "floor(n * 0.5)::BIGINT", "p95_index": "floor(n * 0.95)::BIGINT", "p50_floor": "floor(n * 0.5)::BIGINT - 1", "p95_floor": "floor(n * 0.95)::BIGINT - 1"}.items())
QUERIES = {
    "agg7_telemetry_summary": _q_summary,
    "evl19_agg7_percentiles": _q_percentiles,
    "evl19_latency_by_kind": _q_latency_by_kind,
    "agg7_last_calls": _q_last,
    "stream_tumbling_batch": _q_tumbling,
    "stream_sliding_batch": _q_sliding,
    "stream_sessions_batch": _q_sessions,
    "win12_eta": _q_eta,
}
SQL = {
    "agg7_telemetry_summary": f"WITH {_CALLS} SELECT count(*) AS calls, sum(p)::BIGINT AS prompt_tokens, sum(a)::BIGINT AS answer_tokens, round(avg(value), 6) AS latency, count(*) FILTER (hit) AS hits, round(100.0::DOUBLE * count(*) FILTER (hit) / count(*), 6) AS hit_rate FROM k",
    "evl19_agg7_percentiles": f"WITH x AS (SELECT list_sort(list(value)) AS l, count(value) AS n FROM events WHERE value IS NOT NULL) SELECT {_PCT} FROM x",
    "evl19_latency_by_kind": f"WITH x AS (SELECT coalesce(kind, 'unknown') AS kind, list_sort(list(latency_ms)) AS l, count(*) AS n FROM d_oos_full_answers WHERE latency_ms IS NOT NULL GROUP BY 1) SELECT kind, {_PCT} FROM x",
    "agg7_last_calls": "SELECT event_id, event_type AS call_type, value AS latency_ms FROM events ORDER BY ts DESC, event_id DESC LIMIT 10",
    "stream_tumbling_batch": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2",
    "stream_sliding_batch": "SELECT strftime(s, '%Y-%m-%d %H:%M') AS start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '2000-01-01'), time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '2000-01-01') - INTERVAL 12 HOUR]) AS s FROM events) GROUP BY 1",
    "stream_sessions_batch": "WITH g AS (SELECT user_id, sum(st) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS st FROM events)), h AS (SELECT user_id, s, count(*) AS n FROM g GROUP BY 1, 2) SELECT user_id, count(*) AS sessions, max(n) AS longest FROM h GROUP BY 1",
    "win12_eta": "SELECT event_id, round(median(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) * (count(*) OVER (PARTITION BY user_id) - row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)), 6) AS eta FROM events",
}
