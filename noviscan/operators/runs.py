"""Runs: checkpoints, budgets, failure streaks, counters, metrics, logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noviscan.config import DEFAULTS, EngineConfig
from noviscan.functions import text as X
from noviscan.functions.identity import source_key
from noviscan.operators.ordering import prefix_sums

# Fixed value: secrets in log lines.
SECRET = (
    r"(?i)(?:\b(api[_-]?key|authorization|token|password)\b\s*[:=]\s*(?:bearer\s+)?|"
    r"\bbearer\s+)[^\s&,]+"
)


def latest_per_source(runs: DataFrame) -> DataFrame:
    """One state per source key: the most recently updated one (run id breaks ties)."""
    rest = [c for c in runs.columns if c != "source_key"]
    return (
        runs.groupBy("source_key")
        .agg(F.max_by(F.struct(*rest), F.struct("updated_at", "run_id")).alias("r"))
        .select("source_key", "r.*")
    )


def upsert_runs(runs: DataFrame, fresh: DataFrame) -> DataFrame:
    return runs.join(fresh.select("source_key").distinct(), "source_key", "left_anti").unionByName(latest_per_source(fresh))


def latest_with_notes(runs: DataFrame) -> DataFrame:
    """The newest run that still has saved notes (empty newer runs are passed over)."""
    return latest_per_source(runs).filter("suggestion_count > 0").orderBy(F.desc("updated_at"), "source_key").limit(1)


def incomplete_runs(runs: DataFrame) -> DataFrame:
    return latest_per_source(runs).filter("NOT completed AND suggestion_count > 0").orderBy(F.desc("updated_at"), "source_key")


def import_runs(runs: DataFrame, bundle: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(merged runs, rejected rows): bundle rows need an identity and safe note paths; newest state wins.

    ``bundle`` has the columns of ``runs`` plus source_type, source_ref and note_paths.
    """
    from noviscan.operators.merge import path_problem

    key = F.coalesce(F.nullif(X.strip(F.coalesce("source_key", F.lit(""))), F.lit("")), source_key(F.col("source_type"), F.col("source_ref")))
    bad_path = F.exists(F.coalesce("note_paths", F.array().cast("array<string>")), lambda p: path_problem(p).isNotNull())
    reason = (
        F.when(key == "", "Checkpoint source identity is missing")
        .when(F.col("suggestion_count").isNull(), "Checkpoint requires source metadata and a suggestions list")
        .when(bad_path, "Checkpoint holds an unsafe note path")
    )
    checked = bundle.withColumn("source_key", key).withColumn("reason", reason)
    accepted = checked.filter(F.col("reason").isNull()).select(*runs.columns)
    return upsert_runs(runs, accepted), checked.filter(F.col("reason").isNotNull()).select("source_key", "reason")


def failure_streaks(calls: DataFrame, cfg: EngineConfig = DEFAULTS) -> DataFrame:
    """Consecutive failures up to each call and whether the model is switched off after it.

    ``calls``: run_id, seq (0-based integers), failed. Islands are numbered by a blocked count of successes.
    """
    marked = prefix_sums(calls, ["run_id"], "seq", {"__wins": F.when(F.col("failed"), 0).otherwise(1)})
    island = marked.withColumn("__island", F.col("__wins") + F.when(F.col("failed"), 0).otherwise(1))
    streaked = prefix_sums(island, ["run_id", "__island"], "seq", {"__before": F.col("failed").cast("int")})
    streak = F.when(F.col("failed"), F.col("__before") + 1).otherwise(0)
    rows = streaked.withColumn("streak", streak).drop("__wins", "__island", "__before")
    off = rows.filter(F.col("streak") >= cfg.disable_after_failures).groupBy("run_id").agg(F.min("seq").alias("__off"))
    return rows.join(off, "run_id", "left").withColumn("disabled", F.coalesce(F.col("seq") >= F.col("__off"), F.lit(False))).drop("__off")


def admit_calls(calls: DataFrame, cfg: EngineConfig = DEFAULTS) -> DataFrame:
    """Sticky budget over calls (run_id, seq, prompt_chars): usage before each call and its admission.

    Until the first refusal every call was admitted, so plain prefix sums tell where it happens.
    """
    used = prefix_sums(calls, ["run_id"], "seq", {"calls_before": F.lit(1), "chars_before": F.greatest(F.col("prompt_chars"), F.lit(0))})
    refused = F.lit(False)
    if cfg.budget_calls > 0:
        refused = refused | (F.col("calls_before") >= cfg.budget_calls)
    if cfg.budget_chars > 0:
        refused = refused | (F.col("chars_before") + F.col("prompt_chars") > cfg.budget_chars)
    first = used.filter(refused).groupBy("run_id").agg(F.min("seq").alias("__stop"))
    return used.join(first, "run_id", "left").withColumn("admitted", F.coalesce(F.col("seq") < F.col("__stop"), F.lit(True))).drop("__stop")


def shrink_batches(topics: DataFrame, overhead: int, cfg: EngineConfig = DEFAULTS) -> DataFrame:
    """Batch number per pending topic (run_id, pos, chars); null once the budget is exhausted.

    Batches are full until one does not fit; that one shrinks to the longest prefix that fits, and
    nothing after it can fit any more. So the whole schedule follows from prefix sums.
    """
    size = max(1, cfg.draft_batch)
    placed = prefix_sums(topics, ["run_id"], "pos", {"__at": F.lit(1), "__before": F.col("chars")})
    rows = placed.withColumn("batch", F.floor(F.col("__at") / size))
    # Characters spent when this topic is the last one taken: everything up to it plus one overhead per batch.
    spent = F.col("__before") + F.col("chars") + (F.col("batch") + 1) * overhead
    fits = F.lit(True)
    if cfg.budget_chars > 0:
        fits = fits & (spent <= cfg.budget_chars)
    if cfg.budget_calls > 0:
        fits = fits & (F.col("batch") < cfg.budget_calls)
    stop = rows.filter(~fits).groupBy("run_id").agg(F.min("pos").alias("__stop"))
    return (
        rows.join(stop, "run_id", "left")
        .withColumn("batch", F.when(F.coalesce(F.col("pos") < F.col("__stop"), F.lit(True)), F.col("batch")))
        .drop("__at", "__before", "__stop")
    )


def usage_summary(calls: DataFrame, cfg: EngineConfig = DEFAULTS, keys: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """Calls, characters, estimated and reported tokens (columns prompt_chars, input_tokens, output_tokens)."""
    reported = F.col("input_tokens").isNotNull() | F.col("output_tokens").isNotNull()
    chars = F.sum(F.greatest(F.col("prompt_chars"), F.lit(0)))
    return calls.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("calls"),
        chars.alias("input_chars"),
        F.floor(chars / 4).alias("estimated_input_tokens"),
        F.coalesce(F.sum(F.greatest(F.col("input_tokens"), F.lit(0))), F.lit(0)).alias("actual_input_tokens"),
        F.coalesce(F.sum(F.greatest(F.col("output_tokens"), F.lit(0))), F.lit(0)).alias("actual_output_tokens"),
        F.count_if(reported).alias("calls_with_usage"),
    )


def preflight(topics: DataFrame, cfg: EngineConfig = DEFAULTS, planning: bool = False) -> DataFrame:
    """Per source: notes, novel and known counts, capped completion rounds and a cost hint."""
    counts = topics.groupBy("source_id").agg(F.count(F.lit(1)).alias("note_count"), F.count_if("is_novel").alias("novel_count"))
    rounds = F.ceil(F.col("note_count") / max(1, cfg.draft_batch))
    capped = F.least(rounds, F.lit(cfg.budget_calls)) if cfg.budget_calls > 0 else rounds
    budget = "unlimited" if cfg.budget_calls == 0 and cfg.budget_chars == 0 else f"{cfg.budget_calls} calls / {cfg.budget_chars:,} input chars"
    return counts.select(
        "source_id", "note_count", "novel_count",
        (F.col("note_count") - F.col("novel_count")).alias("known_count"),
        capped.cast("long").alias("estimated_rounds"),
        F.concat(F.lit("Up to ~"), rounds + int(planning), F.lit(f" LLM call(s) for this run (budget: {budget}).")).alias("message"),
    )


def daily_counters(events: DataFrame) -> DataFrame:
    """analyzed_sources and written_notes per day, plus the all-time row (null day)."""
    return events.rollup(F.to_date("ts").alias("day")).agg(
        F.sum("analyzed_sources").alias("analyzed_sources"), F.sum("written_notes").alias("written_notes")
    )


def metrics_snapshot(events: DataFrame) -> DataFrame:
    """Totals and averages over run events (kind, duration_ms, error, notes_drafted, llm_calls, cache_hits)."""
    request, analyze = F.col("kind") == "request", F.col("kind") == "analyze"
    spent = F.greatest(F.col("duration_ms"), F.lit(0))

    def average(flag):
        return F.round(F.coalesce(F.avg(F.when(flag, spent)), F.lit(0.0)), 1)

    def total(name):
        return F.coalesce(F.sum(F.when(analyze, F.greatest(F.col(name), F.lit(0)))), F.lit(0)).cast("long").alias(name)

    return events.agg(
        F.count_if(request).alias("requests"),
        F.count_if(request & F.col("error")).alias("request_errors"),
        average(request).alias("average_request_ms"),
        F.count_if(analyze).alias("analyze_runs"),
        F.count_if(analyze & F.col("error")).alias("analyze_errors"),
        average(analyze).alias("average_analyze_ms"),
        total("notes_drafted"), total("llm_calls"), total("cache_hits"),
    )


def recent_logs(logs: DataFrame, limit: int = 100) -> DataFrame:
    """The newest ``limit`` log lines, secrets redacted after the cut."""
    newest = logs.orderBy(F.desc("ts"), F.desc("log_id")).limit(max(1, limit))
    return newest.withColumn("message", F.regexp_replace("message", SECRET, "[redacted]"))


def run_state(events: DataFrame) -> DataFrame:
    """Current state per run from its events (run_id, seq, type, stage, current, total, message)."""
    latest = F.max_by(F.struct("stage", "current", "total", "message"), F.when(F.col("type") == "progress", F.col("seq")))
    return (
        events.groupBy("run_id")
        .agg(
            latest.alias("p"),
            F.count_if(F.col("type") == "warning").alias("warnings"),
            F.bool_or(F.col("type") == "result").alias("finished"),
            F.bool_or(F.col("type") == "error").alias("failed"),
            F.max("seq").alias("last_seq"),
        )
        .select("run_id", "p.stage", "p.current", "p.total", "p.message", "warnings", "finished", "failed", "last_seq")
    )


def second_pass_allowed(is_novel: Column, batch: int, exhausted: Column, remaining_calls: Column, enabled: bool = True) -> Column:
    """A claims pass needs single drafting, a novel topic and room for two more calls."""
    if not enabled or batch > 1:
        return F.lit(False)
    return is_novel & ~exhausted & (remaining_calls >= 2)
