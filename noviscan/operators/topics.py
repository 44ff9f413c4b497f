"""Topics: split segments, reconcile with a plan, flag novelty, cap and de-duplicate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noviscan.config import DEFAULTS, EngineConfig
from noviscan.functions import text as X
from noviscan.operators import titles
from noviscan.operators.ordering import dense_index, keep_first, ordered_fold, settle
from noviscan.operators.relevance import boilerplate_title, keep_relevant, low_value
from noviscan.session import kept

STRINGS = "array<string>"
TOPIC_HEADING = r"(?mdU)^#{1,3}\s+(.+)$"  # fixed value
OPEN, CLOSE = "\x01", "\x02"


def _line_count(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit(""))) + 1


def heading_parts(text: Column) -> Column:
    """array<struct<hint, body>>: text under level 1-3 headings; the whole text when nothing is left."""

    def build(t):
        marked = F.regexp_replace(t, TOPIC_HEADING, f"{OPEN}$1{CLOSE}")
        rows = F.transform(
            F.split(marked, OPEN),
            lambda p, i: F.struct(
                F.when(i > 0, X.strip(F.substring_index(p, CLOSE, 1))).otherwise("").alias("hint"),
                X.strip(F.when(i > 0, F.substring_index(p, CLOSE, -1)).otherwise(p)).alias("body"),
            ),
        )
        whole = F.array(F.struct(F.lit("").alias("hint"), X.strip(t).alias("body")))
        return X.let(F.filter(rows, lambda r: r["body"] != ""), lambda r: F.when(F.size(r) > 0, r).otherwise(whole))

    return X.let(text, build)


def _greedy(parts: Column, weight, limit: int, separator: str, gap: int) -> Column:
    start = F.struct(F.array().cast(STRINGS).alias("done"), F.array().cast(STRINGS).alias("held"), F.lit(0).alias("used"))

    def flushed(acc):
        joined = F.array(X.strip(F.array_join(acc["held"], separator)))
        return F.when(F.size(acc["held"]) > 0, F.concat(acc["done"], joined)).otherwise(acc["done"])

    def step(acc, part):
        full = (F.size(acc["held"]) > 0) & (acc["used"] + weight(part) > limit)
        fresh = F.struct(flushed(acc).alias("done"), F.array(part).alias("held"), (weight(part) + gap).alias("used"))
        more = F.struct(
            acc["done"].alias("done"), F.concat(acc["held"], F.array(part)).alias("held"), (acc["used"] + weight(part) + gap).alias("used")
        )
        return F.when(full, fresh).otherwise(more)

    return F.aggregate(parts, start, step, flushed)


def split_oversized(body: Column, cfg: EngineConfig) -> Column:
    """Pieces of an oversized topic: by paragraph lines, else sentence characters, else halves."""
    lines = min(cfg.max_note_lines, cfg.atomic_line_limit)
    chars = cfg.atomic_char_limit

    def build(t):
        half = F.greatest(F.lit(1), F.floor(F.length(t) / 2).cast("int"))
        halves = X.nonempty(F.array(F.substring(t, F.lit(1), half), F.substring(t, half + 1, F.length(t))))
        by_sentence = X.let(
            X.sentences(t),
            lambda s: F.when(F.size(s) > 1, _greedy(s, F.length, chars, " ", 1)).otherwise(halves),
        )
        by_paragraph = X.let(
            X.paragraphs(t),
            lambda p: F.when(F.size(p) > 1, _greedy(p, _line_count, lines, "\n\n", 0)).otherwise(by_sentence),
        )
        fits = (_line_count(t) <= lines) & (F.length(t) <= chars)
        return F.when(fits, F.array(t)).otherwise(by_paragraph)

    return X.let(X.strip(body), build)


def structural_topics(segments: DataFrame, cfg: EngineConfig = DEFAULTS, **more: Column) -> DataFrame:
    """Topic rows of segments (source_id, segment_index, text): one per heading part, oversized ones split.

    Returns source_id, topic_pos, segment_index, title, text, summary and ``more`` columns made of a topic's text.
    """
    parts = segments.select("source_id", "segment_index", F.posexplode(heading_parts(F.col("text"))).alias("__part", "p")).select(
        "source_id", "segment_index", "__part", F.col("p.hint").alias("__h"), F.col("p.body").alias("__body")
    )
    cut_up = settle(parts, __cuts=split_oversized(F.col("__body"), cfg))
    # Pieces of an oversized part take the part's title as hint; others have no body to make one of.
    oversized = F.size("__cuts") > 1
    named = cut_up.withColumn("__body", F.when(oversized, F.col("__body")))
    based = titles.unstage(titles.refine_title(titles.stage_body(named, "__body"), "__body", "__h", "__base"))
    hinted = based.filter(F.size("__cuts") > 0).withColumn("__h", F.when(oversized, F.col("__base")).otherwise(F.col("__h")))
    pieces = hinted.select("source_id", "segment_index", "__part", "__h", F.posexplode("__cuts").alias("__piece", "text"))
    # Titles are costly and everything below reads them several times: make them once. Texts are read only where they are asked for.
    titled = titles.unstage(titles.refine_title(titles.stage_body(pieces, "text"), "text", "__h", "title"))
    titled = titles.bare_title(titled, "title")
    rows = kept(settle(titled, **more) if more else titled, "topics")
    placed = rows.withColumn(
        "__pos",
        F.col("segment_index").cast("long") * F.lit(1 << 30) + F.col("__part").cast("long") * F.lit(1 << 12) + F.col("__piece"),
    )
    ordered = dense_index(placed, ["source_id"], "__pos", "topic_pos")
    unique = titles.disambiguate(ordered, "source_id", "topic_pos", "title", "title2")
    topics = unique.select(
        "source_id", "topic_pos", "segment_index", F.col("title2").alias("title"), "text", X.truncate(F.col("text"), 500).alias("summary"), *more
    )
    return dedupe_topics(topics)


def dedupe_topics(topics: DataFrame) -> DataFrame:
    """Keep the first topic per (folded title, first segment) of a source."""
    return keep_first(topics, [F.col("source_id"), F.lower("title"), F.col("segment_index")], ["topic_pos"])


def planned_topics(plan: DataFrame, segments: DataFrame) -> DataFrame:
    """Planned rows (source_id, plan_pos, title, summary, segment_indices) joined to their segments.

    Unknown indices drop out, rows without segments vanish, missing summaries are filled from text.
    """
    wanted = plan.select("source_id", "plan_pos", F.posexplode("segment_indices").alias("__at", "segment_index"))
    found = (
        wanted.join(segments.select("source_id", "segment_index", "text"), ["source_id", "segment_index"])
        .groupBy("source_id", "plan_pos")
        .agg(
            F.transform(F.sort_array(F.collect_list(F.struct("__at", "segment_index"))), lambda s: s["segment_index"]).alias("segment_indices"),
            X.join_ordered(F.collect_list(F.struct("__at", X.strip(F.col("text")).alias("text"))), "\n\n").alias("text"),
        )
    )
    text = found.join(plan.select("source_id", "plan_pos", "title", "summary"), ["source_id", "plan_pos"])
    filled = F.coalesce(F.nullif(X.strip(F.coalesce("summary", F.lit(""))), F.lit("")), X.truncate(F.col("text"), 500))
    return text.withColumn("summary", filled)


def uncovered_segments(segments: DataFrame, planned: DataFrame) -> DataFrame:
    covered = planned.select("source_id", F.explode("segment_indices").alias("segment_index")).distinct()
    return segments.join(covered, ["source_id", "segment_index"], "left_anti")


def minimum_topics(segment_count: Column, structural_count: Column) -> Column:
    third = F.greatest(F.floor(segment_count / 3), F.lit(3))
    return F.when(segment_count <= 2, F.lit(1)).otherwise(F.greatest(F.lit(2), F.least(structural_count, third))).cast("long")


def reconcile(planned: DataFrame, structural: DataFrame, segments: DataFrame) -> DataFrame:
    """Plan plus structural fill for uncovered segments; too few topics falls back to structural ones.

    ``planned``: source_id, plan_pos, title, text, summary, segment_indices.
    ``structural``: source_id, topic_pos, title, text, summary, segment_index.
    """
    shape = structural.select(
        "source_id", F.col("topic_pos").alias("__at"), "title", "text", "summary",
        F.array("segment_index").alias("segment_indices"), F.lit("structural").alias("origin"),
    )
    covered = planned.select("source_id", F.explode("segment_indices").alias("segment_index")).distinct()
    fill = structural.join(covered, ["source_id", "segment_index"], "left_anti").select(
        "source_id", F.col("topic_pos").alias("__at"), "title", "text", "summary",
        F.array("segment_index").alias("segment_indices"), F.lit("fill").alias("origin"),
    )
    chosen = planned.select(
        "source_id", F.col("plan_pos").alias("__at"), "title", "text", "summary", "segment_indices", F.lit("plan").alias("origin")
    )
    combined = chosen.unionByName(fill)
    counts = (
        segments.groupBy("source_id").agg(F.count(F.lit(1)).alias("segments"))
        .join(structural.groupBy("source_id").agg(F.count(F.lit(1)).alias("structural")), "source_id", "left")
        .join(combined.groupBy("source_id").agg(F.count(F.lit(1)).alias("combined"), F.count_if(F.col("origin") == "plan").alias("planned")), "source_id", "left")
    )
    needed = minimum_topics(F.col("segments"), F.coalesce("structural", F.lit(0)))
    use = counts.select(
        "source_id", ((F.coalesce("planned", F.lit(0)) > 0) & (F.coalesce("combined", F.lit(0)) >= needed)).alias("use_plan")
    )
    rows = combined.join(use, "source_id").filter("use_plan").unionByName(shape.join(use, "source_id").filter("NOT use_plan"))
    first = F.array_min("segment_indices").cast("long")
    kind = F.when(F.col("origin") == "plan", 0).otherwise(1)
    return rows.drop("use_plan").withColumn("order_key", first * F.lit(1 << 32) + kind * F.lit(1 << 31) + F.col("__at")).drop("__at")


def topic_novelty(topics: DataFrame, scores: DataFrame) -> DataFrame:
    """A topic is novel when any of its reliable segments is; never without reliable segments."""
    keyed = topics.select("source_id", "topic_pos", F.explode("segment_indices").alias("segment_index"))
    flags = (
        keyed.join(scores.filter(~F.col("is_unknown")), ["source_id", "segment_index"])
        .groupBy("source_id", "topic_pos")
        .agg(F.bool_or("is_novel").alias("__novel"))
    )
    return topics.join(flags, ["source_id", "topic_pos"], "left").withColumn("is_novel", F.coalesce("__novel", F.lit(False))).drop("__novel")


def cap_topics(topics: DataFrame, cfg: EngineConfig = DEFAULTS) -> DataFrame:
    """At most ``max_notes_per_source`` topics, novel ones first (this cap is the feature); order kept in ``rank``."""
    tier = F.when(F.col("is_novel"), 0).otherwise(1) if cfg.draft_novel_first else F.lit(0)
    order = Window.partitionBy("source_id").orderBy(tier, "topic_pos")
    return topics.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= cfg.max_notes_per_source)


def drop_boilerplate_topics(topics: DataFrame, low: Column | None = None) -> DataFrame:
    """``low``: whether a topic's text is of low value, where that is known."""
    return keep_relevant(topics, boilerplate_title(F.col("title")) | (low_value(F.col("text")) if low is None else low))


def fallback_topics(sources: DataFrame, segments: DataFrame, topics: DataFrame) -> DataFrame:
    """One topic from the first segment, titled like the source, where planning left nothing."""
    empty = sources.join(topics.select("source_id").distinct(), "source_id", "left_anti")
    first = segments.groupBy("source_id").agg(F.min_by(F.struct("segment_index", "text"), "segment_index").alias("s"))
    return empty.join(first, "source_id").select(
        "source_id",
        F.lit(0).cast("long").alias("topic_pos"),
        "title",
        F.col("s.text").alias("text"),
        X.truncate(F.col("s.text"), 500).alias("summary"),
        F.array("s.segment_index").alias("segment_indices"),
    )


def plan_topics(
    sources: DataFrame, segments: DataFrame, scores: DataFrame, plan: DataFrame | None = None, cfg: EngineConfig = DEFAULTS
) -> DataFrame:
    """Topics per source: structural or planned, flagged, capped, de-duplicated, never empty."""
    flag = {"low": low_value(F.col("text"))} if cfg.filter_boilerplate and plan is None else {}
    structural = structural_topics(segments, cfg, **flag)
    if plan is None:
        rows = structural.select("source_id", "topic_pos", "title", "text", "summary", F.array("segment_index").alias("segment_indices"), *flag)
    else:
        merged = reconcile(planned_topics(plan, segments), structural, segments)
        rows = dense_index(merged, ["source_id"], "order_key", "topic_pos").drop("order_key", "origin")
    flagged = topic_novelty(rows, scores)
    capped = cap_topics(flagged, cfg).withColumn("segment_index", F.element_at("segment_indices", 1))
    unique = keep_first(capped, [F.col("source_id"), F.lower("title"), F.col("segment_index")], ["rank"])
    relevant = drop_boilerplate_topics(unique, *map(F.col, flag)) if cfg.filter_boilerplate else unique
    extra = fallback_topics(sources, segments, relevant).withColumn("is_novel", F.lit(False)).withColumn("rank", F.lit(1))
    shared = ["source_id", "topic_pos", "title", "text", "summary", "segment_indices", "is_novel", "rank"]
    return relevant.select(*shared).unionByName(extra.select(*shared))


def planning_windows(segments: DataFrame, cfg: EngineConfig = DEFAULTS) -> DataFrame:
    """Contiguous greedy bins of segments limited by count and characters: adds ``window_index``."""
    schema = T.StructType(
        [segments.schema["source_id"], segments.schema["segment_index"], T.StructField("window_index", T.LongType())]
    )
    limit, budget = max(1, cfg.planning_max_segments), cfg.planning_total_chars

    def step(state, row):
        source, index, chars = row
        window, count, used = state or (0, 0, 0)
        if count and (count >= limit or used + chars > budget):
            window, count, used = window + 1, 0, 0
        return (window, count + 1, used + chars), [(source, index, window)]

    rows = segments.select("source_id", "segment_index", F.least(F.length("text"), F.lit(cfg.planning_segment_chars)).alias("chars"))
    return ordered_fold(rows, ["source_id"], ["segment_index"], schema, step)


def merged_locations(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Span of several locations: smallest start and largest end of each kind."""
    out = []
    for start, end in (("page", "page_end"), ("chapter", "chapter_end"), ("line_start", "line_end"), ("ts_start", "ts_end")):
        stop = F.coalesce(F.when(F.col(end) != 0, F.col(end)), F.col(start))
        out += [F.min(start).alias(start), F.max(F.when(F.col(start).isNotNull(), stop)).alias(end)]
    return rows.groupBy(*keys).agg(*out)


def saved_plan_is_valid(plan: DataFrame, segments: DataFrame) -> DataFrame:
    """Per source whether every planned index still exists (a saved plan is used whole or not at all)."""
    wanted = plan.select("source_id", F.explode_outer("segment_indices").alias("segment_index"))
    have = segments.select("source_id", "segment_index").distinct().withColumn("__have", F.lit(True))
    return (
        wanted.join(have, ["source_id", "segment_index"], "left")
        .groupBy("source_id")
        .agg(F.bool_and(F.coalesce("__have", F.lit(False))).alias("plan_valid"))
    )


def note_identity(indices: Column, title: Column) -> Column:
    return F.struct(F.sort_array(indices).alias("indices"), F.lower(X.strip(title)).alias("title"))


def resume_split(topics: DataFrame, saved: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(reused, to_draft, orphans): planned topics with a saved note, without one, and saved notes left over."""
    t = topics.withColumn("__id", note_identity(F.col("segment_indices"), X.compose_title(F.col("title"))))
    s = saved.withColumn("__id", note_identity(F.col("segment_indices"), F.col("title")))
    on = ["source_id", "__id"]
    ids = s.select(*on).distinct()
    return (
        t.join(ids, on, "left_semi").drop("__id"),
        t.join(ids, on, "left_anti").drop("__id"),
        s.join(t.select(*on).distinct(), on, "left_anti").drop("__id"),
    )
