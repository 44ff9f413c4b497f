"""Runs, budgets, counters, metrics, checkpoints."""

from pyspark.sql import functions as F

from noviscan.catalog.base import query, table
from noviscan.catalog.inputs import CALLS_SQL, run_calls
from noviscan.catalog.sources import longs
from noviscan.config import DEFAULTS
from noviscan.operators import runs as R

# Saved runs: every event is a state of a source; the user is the source.
RUNS = {
    "run_id": "event_id",
    "source_key": "'s' || CAST(user_id AS STRING)",
    "updated_at": "ts",
    "completed": "event_type = 'purchase'",
    "suggestion_count": "CASE WHEN event_type = 'view' THEN 0 ELSE CAST(floor(value) AS BIGINT) END",
}
RUNS_SQL = "WITH runs AS (SELECT " + ", ".join(f"{v} AS {k}" for k, v in RUNS.items()) + """ FROM events),
 latest AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY source_key ORDER BY updated_at DESC, run_id DESC) = 1)
"""


def _runs(spark, sf):
    return table(spark, sf, "events").selectExpr(*[f"{v} AS {k}" for k, v in RUNS.items()])


@query("snk9_checkpoint_latest_per_source", RUNS_SQL + "SELECT source_key, run_id, suggestion_count FROM latest")
def latest(spark, sf):
    return R.latest_per_source(_runs(spark, sf)).select("source_key", "run_id", "suggestion_count")


@query("win9_latest_run_with_notes", RUNS_SQL + "SELECT source_key, run_id FROM latest WHERE suggestion_count > 0 ORDER BY updated_at DESC, source_key LIMIT 1")
def latest_with_notes(spark, sf):
    return R.latest_with_notes(_runs(spark, sf)).select("source_key", "run_id")


@query("win9_incomplete_runs", RUNS_SQL + "SELECT source_key, run_id, suggestion_count FROM latest WHERE NOT completed AND suggestion_count > 0")
def incomplete(spark, sf):
    return R.incomplete_runs(_runs(spark, sf)).select("source_key", "run_id", "suggestion_count")


@query(
    "snk9_checkpoint_import",
    RUNS_SQL + """, bundle AS (SELECT *, user_id % 3 AS k FROM (SELECT r.*, CAST(substr(source_key, 2) AS BIGINT) AS user_id FROM runs r)),
 ok AS (SELECT * FROM bundle WHERE k <> 2 QUALIFY row_number() OVER (PARTITION BY source_key ORDER BY updated_at DESC, run_id DESC) = 1)
SELECT source_key, count(*) AS states FROM (SELECT source_key, run_id FROM latest WHERE source_key NOT IN (SELECT source_key FROM ok) UNION ALL SELECT source_key, run_id FROM ok) GROUP BY source_key""",
)
def import_bundle(spark, sf):
    runs = _runs(spark, sf)
    bundle = runs.withColumn("user", F.substring("source_key", 2, 20).cast("long")).select(
        *runs.columns, F.lit("text").alias("source_type"), F.col("source_key").alias("source_ref"),
        F.when(F.col("user") % 3 == 2, F.array(F.lit("../up.md"))).otherwise(F.array(F.lit("a/b.md"))).alias("note_paths"),
    ).withColumn("source_key", F.when(F.col("run_id") % 8 == 0, "").otherwise(F.col("source_key")))
    merged, _ = R.import_runs(R.latest_per_source(runs).select(*runs.columns), bundle)
    return merged.groupBy("source_key").agg(F.count(F.lit(1)).alias("states"))


@query(
    "snk9_checkpoint_import_rejects",
    "SELECT 's' || user_id AS source_key, count(*) AS rejected FROM events WHERE user_id % 3 = 2 GROUP BY user_id",
)
def import_rejects(spark, sf):
    runs = _runs(spark, sf)
    bundle = runs.withColumn("user", F.substring("source_key", 2, 20).cast("long")).select(
        *runs.columns, F.lit("text").alias("source_type"), F.col("source_key").alias("source_ref"),
        F.when(F.col("user") % 3 == 2, F.array(F.lit("../up.md"))).otherwise(F.array(F.lit("a/b.md"))).alias("note_paths"),
    )
    return R.import_runs(runs, bundle)[1].groupBy("source_key").agg(F.count(F.lit(1)).alias("rejected"))


@query(
    "win10_failure_streak",
    f"""WITH c AS ({CALLS_SQL}), i AS (SELECT *, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY run_id ORDER BY seq) AS island FROM c),
 s AS (SELECT *, CASE WHEN failed THEN count(*) FILTER (failed) OVER (PARTITION BY run_id, island ORDER BY seq) ELSE 0 END AS streak FROM i)
SELECT run_id, seq, streak, coalesce(max(CASE WHEN streak >= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY seq), 0) = 1 AS disabled FROM s""",
)
def streaks(spark, sf):
    return longs(R.failure_streaks(run_calls(spark, sf)).select("run_id", "seq", "streak", "disabled"), "streak")


BUDGET = DEFAULTS.replace(budget_calls=30, budget_chars=60_000)


@query(
    "win11_budget_admission",
    f"""WITH c AS ({CALLS_SQL}), u AS (SELECT *, row_number() OVER w - 1 AS calls_before, CAST(sum(prompt_chars) OVER w - prompt_chars AS BIGINT) AS chars_before FROM c WINDOW w AS (PARTITION BY run_id ORDER BY seq))
SELECT run_id, seq, calls_before, chars_before, coalesce(max(CASE WHEN calls_before >= 30 OR chars_before + prompt_chars > 60000 THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY seq), 0) = 0 AS admitted FROM u""",
)
def admission(spark, sf):
    return R.admit_calls(run_calls(spark, sf), BUDGET).select("run_id", "seq", "calls_before", "chars_before", "admitted")


@query(
    "win11_adaptive_batches",
    f"""WITH c AS ({CALLS_SQL}), p AS (SELECT *, row_number() OVER w - 1 AS pos_in_run, sum(prompt_chars) OVER w AS total FROM c WINDOW w AS (PARTITION BY run_id ORDER BY seq)),
 f AS (SELECT *, CAST(floor(pos_in_run / 5) AS BIGINT) AS b, total + (CAST(floor(pos_in_run / 5) AS BIGINT) + 1) * 300 > 60000 OR floor(pos_in_run / 5) >= 30 AS over FROM p)
SELECT run_id, seq AS pos, CASE WHEN max(CASE WHEN over THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY seq) = 0 THEN b END AS batch FROM f""",
)
def batches(spark, sf):
    rows = run_calls(spark, sf).select("run_id", F.col("seq").alias("pos"), F.col("prompt_chars").alias("chars"))
    return R.shrink_batches(rows, 300, BUDGET).select("run_id", "pos", "batch")


@query(
    "agg22_usage_summary",
    """SELECT user_id AS run_id, count(*) AS calls, CAST(sum(CAST(floor(value * 100) AS BIGINT)) AS BIGINT) AS input_chars, CAST(floor(sum(CAST(floor(value * 100) AS BIGINT)) / 4) AS BIGINT) AS estimated_input_tokens,
 CAST(coalesce(sum(CASE WHEN event_type = 'view' THEN event_id % 50 END), 0) AS BIGINT) AS actual_input_tokens, count(*) FILTER (event_type IN ('view', 'click')) AS calls_with_usage FROM events GROUP BY user_id""",
)
def usage(spark, sf):
    calls = run_calls(spark, sf).join(table(spark, sf, "events").select(F.col("event_id").alias("seq"), "event_type"), "seq").select(
        "run_id", "prompt_chars", F.when(F.col("event_type") == "view", F.col("seq") % 50).alias("input_tokens"),
        F.when(F.col("event_type") == "click", F.lit(3).cast("long")).alias("output_tokens"),
    )
    return R.usage_summary(calls).select("run_id", "calls", "input_chars", "estimated_input_tokens", "actual_input_tokens", "calls_with_usage")


@query(
    "agg21_preflight_summary",
    """SELECT doc_id % 20 AS source_id, count(*) AS note_count, count(*) FILTER (doc_id % 3 = 0) AS novel_count, count(*) FILTER (doc_id % 3 <> 0) AS known_count, least(CAST(ceil(count(*) / 5) AS BIGINT), 50) AS estimated_rounds,
 'Up to ~' || (CAST(ceil(count(*) / 5) AS BIGINT) + 1) || ' LLM call(s) for this run (budget: 50 calls / 400,000 input chars).' AS message FROM documents GROUP BY 1""",
)
def preflight(spark, sf):
    topics = table(spark, sf, "documents").selectExpr("doc_id % 20 AS source_id", "doc_id % 3 = 0 AS is_novel")
    return R.preflight(topics, planning=True)


COUNTS = ("CASE WHEN event_type = 'view' THEN 1 ELSE 0 END", "CASE WHEN event_type = 'purchase' THEN CAST(floor(value) AS BIGINT) ELSE 0 END")


@query(
    "agg19_daily_counters",
    f"SELECT CAST(ts AS DATE) AS day, CAST(sum({COUNTS[0]}) AS BIGINT) AS analyzed_sources, CAST(sum({COUNTS[1]}) AS BIGINT) AS written_notes FROM events GROUP BY ROLLUP(CAST(ts AS DATE))",
)
def counters(spark, sf):
    return R.daily_counters(table(spark, sf, "events").selectExpr("ts", f"{COUNTS[0]} AS analyzed_sources", f"{COUNTS[1]} AS written_notes"))


@query(
    "agg20_run_metrics",
    """SELECT count(*) FILTER (user_id % 2 = 0) AS requests, count(*) FILTER (user_id % 2 = 0 AND event_type = 'error') AS request_errors, round(coalesce(avg(value) FILTER (user_id % 2 = 0), 0), 1) AS average_request_ms,
 count(*) FILTER (user_id % 2 = 1) AS analyze_runs, count(*) FILTER (user_id % 2 = 1 AND event_type = 'error') AS analyze_errors, round(coalesce(avg(value) FILTER (user_id % 2 = 1), 0), 1) AS average_analyze_ms,
 CAST(sum(event_id % 7) FILTER (user_id % 2 = 1) AS BIGINT) AS notes_drafted, CAST(sum(event_id % 3) FILTER (user_id % 2 = 1) AS BIGINT) AS llm_calls, CAST(sum(event_id % 2) FILTER (user_id % 2 = 1) AS BIGINT) AS cache_hits FROM events""",
)
def metrics(spark, sf):
    return R.metrics_snapshot(
        table(spark, sf, "events").selectExpr(
            "CASE WHEN user_id % 2 = 0 THEN 'request' ELSE 'analyze' END AS kind", "value AS duration_ms", "event_type = 'error' AS error",
            "event_id % 7 AS notes_drafted", "event_id % 3 AS llm_calls", "event_id % 2 AS cache_hits",
        )
    )


@query(
    "srt8_recent_logs",
    """SELECT event_id AS log_id, CASE WHEN event_type = 'error' THEN 'auth failed [redacted] for ' || user_id WHEN event_type = 'view' THEN 'sent [redacted], ok' ELSE event_type || ' ' || user_id END AS message FROM events ORDER BY ts DESC, event_id DESC LIMIT 150""",
)
def logs(spark, sf):
    rows = table(spark, sf, "events").selectExpr(
        "event_id AS log_id", "ts",
        "CASE WHEN event_type = 'error' THEN 'auth failed token= Bearer abc' || CAST(event_id AS STRING) || ' for ' || CAST(user_id AS STRING) WHEN event_type = 'view' THEN 'sent bearer xyz, ok' ELSE event_type || ' ' || CAST(user_id AS STRING) END AS message",
    )
    return R.recent_logs(rows, 150).select("log_id", "message")


@query(
    "flt16_second_pass_eligibility",
    "SELECT event_id FROM events WHERE event_type = 'click' AND value < 80 AND event_id % 5 >= 2",
)
def second_pass(spark, sf):
    e = table(spark, sf, "events")
    ok = R.second_pass_allowed(F.col("event_type") == "click", 1, F.col("value") >= 80, F.col("event_id") % 5)
    return e.filter(ok).select("event_id")
