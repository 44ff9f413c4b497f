"""From matches to verdicts: classification, roll-ups, overlaps, calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noviscan.config import DEFAULTS, EngineConfig
from noviscan.functions import links as L
from noviscan.functions import text as X
from noviscan.functions import vectors as V
from noviscan.operators.ordering import one_row

NO_STRINGS = "array<string>"


def boosted_matches(matches: DataFrame, cfg: EngineConfig = DEFAULTS, query_tags: str = "query_tags", match_tags: str = "tags") -> DataFrame:
    """Re-rank the k raw matches of each query by tag-adjusted similarity (stable on raw rank)."""
    scored = matches.withColumn(
        "similarity", V.adjusted(F.col("base_similarity"), F.col(query_tags), F.col(match_tags), cfg)
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "raw_rank")  # at most k rows per query
    return scored.withColumn("rank", F.row_number().over(order))


def classify(base: Column, query_tags: Column, match_tags: Column, cfg: EngineConfig) -> tuple[Column, Column]:
    """(novel, known): novel looks at raw cosine only, known at the gray-zone boosted value."""
    return base < cfg.novel_threshold, V.for_verdict(base, query_tags, match_tags, cfg) >= cfg.known_threshold


def chunk_scores(queries: DataFrame, matches: DataFrame, cfg: EngineConfig = DEFAULTS) -> DataFrame:
    """One row per query chunk with its best match; chunks without matches score 0 and are novel.

    ``queries``: query_id, source_id, segment_index, query_tags. ``matches``: boosted matches.
    """
    best = matches.filter("rank = 1").select(
        "query_id", "chunk_id", "note_path", "base_similarity", F.col("tags").alias("match_tags")
    )
    joined = queries.join(best, "query_id", "left")
    base = F.coalesce("base_similarity", F.lit(0.0))
    is_novel, is_known = classify(base, F.col("query_tags"), F.col("match_tags"), cfg)
    return joined.select(
        *queries.columns,
        "chunk_id",
        "note_path",
        base.alias("best_similarity"),
        is_novel.alias("is_novel"),
        is_known.alias("is_known"),
    )


def verdict(novel: Column, known: Column, total: Column) -> Column:
    return (
        F.when(F.coalesce(total, F.lit(0)) == 0, F.lit("Novel"))
        .when(known / total >= 0.8, F.lit("Already known"))
        .when(novel / total >= 0.6, F.lit("Novel"))
        .otherwise(F.lit("Partially new"))
    )


def source_verdicts(scores: DataFrame, sources: DataFrame | None = None, unknown: Column | None = None) -> DataFrame:
    """Verdict and novelty score per source; unreliable chunks do not count."""
    reliable = ~unknown if unknown is not None else F.lit(True)
    stats = scores.groupBy("source_id").agg(
        F.count_if(reliable).alias("chunks"),
        F.count_if(reliable & F.col("is_novel")).alias("novel_chunks"),
        F.count_if(reliable & F.col("is_known")).alias("known_chunks"),
        F.avg(F.when(reliable, 1 - F.col("best_similarity"))).alias("gap"),
    )
    if sources is not None:
        stats = sources.select("source_id").join(stats, "source_id", "left")
    return stats.select(
        "source_id",
        verdict(F.col("novel_chunks"), F.col("known_chunks"), F.col("chunks")).alias("verdict"),
        F.round(F.coalesce("gap", F.lit(1.0)), 3).alias("novelty_score"),
        F.coalesce("chunks", F.lit(0)).alias("chunks"),
        F.coalesce("novel_chunks", F.lit(0)).alias("novel_chunks"),
        F.coalesce("known_chunks", F.lit(0)).alias("known_chunks"),
    )


def segment_scores(scores: DataFrame, segments: DataFrame | None = None, unknown: Column | None = None) -> DataFrame:
    """Per segment the least covered chunk; novel when any chunk is, unknown when none is reliable."""
    reliable = ~unknown if unknown is not None else F.lit(True)
    rolled = scores.groupBy("source_id", "segment_index").agg(
        F.min(F.when(reliable, F.col("best_similarity"))).alias("least"),
        F.coalesce(F.bool_or(F.when(reliable, F.col("is_novel"))), F.lit(False)).alias("any_novel"),
        F.count_if(reliable).alias("reliable"),
    )
    if segments is not None:
        rolled = segments.select("source_id", "segment_index").join(rolled, ["source_id", "segment_index"], "left")
    return rolled.select(
        "source_id",
        "segment_index",
        F.coalesce("least", F.lit(0.0)).alias("best_similarity"),
        F.coalesce("any_novel", F.lit(False)).alias("is_novel"),
        (F.coalesce("reliable", F.lit(0)) == 0).alias("is_unknown"),
    )


def overlaps(matches: DataFrame, queries: DataFrame, sample_chars: int = 300) -> DataFrame:
    """Per source and note the match with the highest boosted similarity; earliest query wins ties."""
    placed = matches.join(queries.select("query_id", "source_id", "query_pos"), "query_id")
    best = F.min_by(
        F.struct("similarity", "note_title", "text", "tags", "heading", "query_pos"),
        F.struct((-F.col("similarity")).alias("s"), "query_pos", "rank"),
    )
    return (
        placed.groupBy("source_id", "note_path")
        .agg(best.alias("m"))
        .select(
            "source_id",
            "note_path",
            F.col("m.note_title").alias("note_title"),
            F.col("m.similarity").alias("max_similarity"),
            F.substring("m.text", 1, sample_chars).alias("sample_text"),
            F.col("m.tags").alias("tags"),
            F.nullif(X.strip(F.coalesce("m.heading", F.lit(""))), F.lit("")).alias("sample_heading"),
        )
    )


def overlap_tags(overlap_rows: DataFrame) -> DataFrame:
    """Distinct tags over all overlapping notes of a source, sorted (one row per tag)."""
    return overlap_rows.select("source_id", F.explode("tags").alias("tag")).distinct()


def threshold_calibration(
    samples: DataFrame, matches: DataFrame, fallback: tuple[float, float], provider: str = "local"
) -> DataFrame:
    """Recommended thresholds from same-note and cross-note similarities (self matches included).

    ``samples``: query_id, sample_path. ``matches``: query_id, note_path, base_similarity.
    """
    pairs = matches.join(samples, "query_id").select(
        F.col("base_similarity").alias("s"), (F.col("note_path") == F.col("sample_path")).alias("same")
    )
    stats = pairs.agg(
        F.count_if("same").alias("same_note_samples"),
        F.count_if(~F.col("same")).alias("cross_note_samples"),
        F.expr("median(s) FILTER (WHERE same)").alias("same_median"),
        F.expr("median(s) FILTER (WHERE NOT same)").alias("cross_median"),
        F.expr("percentile(s, 0.60) FILTER (WHERE NOT same)").alias("cross_p60"),
        F.expr("percentile(s, 0.85) FILTER (WHERE NOT same)").alias("cross_p85"),
        F.expr("percentile(s, 0.25) FILTER (WHERE same)").alias("same_p25"),
    )
    size = samples.agg(F.count(F.lit(1)).alias("sample_size"))
    row = one_row(size, stats)
    usable = (F.col("sample_size") >= 10) & (F.col("cross_note_samples") > 0)
    raw_known = F.when(F.col("same_note_samples") > 0, F.greatest(F.col("cross_p60") + 0.05, F.col("same_p25"))).otherwise(
        F.col("cross_p85")
    )
    known = F.least(F.lit(0.98), F.greatest(raw_known, F.col("cross_p60") + 0.05))
    novel = F.greatest(F.lit(0.05), F.least(F.col("cross_p60"), known - 0.05))
    message = (
        F.when(F.col("sample_size") == 0, "no chunks: defaults")
        .when(F.col("sample_size") < 10, "fewer than 10 chunks: defaults")
        .when(F.col("cross_note_samples") == 0, "chunks of one note only: defaults")
        .otherwise("from sampled similarities")
    )
    enough = F.col("sample_size") >= 10
    return row.select(
        "sample_size",
        F.when(usable, F.round(novel, 3)).otherwise(fallback[0]).alias("recommended_novel_threshold"),
        F.when(usable, F.round(known, 3)).otherwise(fallback[1]).alias("recommended_known_threshold"),
        F.when(enough, F.col("same_note_samples")).otherwise(0).alias("same_note_samples"),
        F.when(enough, F.col("cross_note_samples")).otherwise(0).alias("cross_note_samples"),
        F.when(enough, F.round("same_median", 3)).alias("same_note_median"),
        F.when(usable, F.round("cross_median", 3)).alias("cross_note_median"),
        F.lit(provider).alias("provider"),
        (~usable).alias("fallback"),
        message.alias("message"),
    )


def sample_chunks(chunks: DataFrame, limit: int) -> DataFrame:
    """A repeatable sample: the ``limit`` chunks with the smallest id hash."""
    return chunks.withColumn("__h", F.md5(F.col("chunk_id").cast("string"))).orderBy("__h", "chunk_id").limit(limit).drop("__h")


# Recommended thresholds per provider and per model-name fragment, in lookup order.
PROVIDER_THRESHOLDS = {"local": (0.55, 0.75), "gemini": (0.65, 0.82)}
MODEL_THRESHOLDS = (
    ("all-minilm-l6-v2", 0.55, 0.75),
    ("all-minilm-l12-v2", 0.55, 0.75),
    ("all-mpnet-base-v2", 0.58, 0.78),
    ("bge-small-en-v1.5", 0.60, 0.80),
    ("bge-small-en", 0.60, 0.80),
)
# Input window of known models in tokens, and characters per token.
MODEL_TOKENS = {
    ("local", "all-minilm-l6-v2"): 256,
    ("local", "all-minilm-l12-v2"): 256,
    ("local", "sentence-transformers/all-minilm-l6-v2"): 256,
    ("local", "sentence-transformers/all-minilm-l12-v2"): 256,
    ("local", "all-mpnet-base-v2"): 384,
    ("local", "sentence-transformers/all-mpnet-base-v2"): 384,
    ("local", "bge-small-en-v1.5"): 512,
    ("local", "bge-small-en"): 512,
    ("local", "sentence-transformers/bge-small-en-v1.5"): 512,
    ("local", "baai/bge-small-en-v1.5"): 512,
    ("gemini", "gemini-embedding-001"): 2048,
    ("gemini", "text-embedding-004"): 2048,
    ("gemini", "models/gemini-embedding-001"): 2048,
    ("gemini", "models/text-embedding-004"): 2048,
}
CHARS_PER_TOKEN = 4


def recommended_thresholds(provider: Column, model: Column) -> Column:
    """struct<novel, known>: first model fragment found in the name, else the provider's pair."""

    def pair(n, k):
        return F.struct(F.lit(n).alias("novel"), F.lit(k).alias("known"))

    kind = F.lower(F.coalesce(provider, F.lit("local")))
    name = F.regexp_replace(F.lower(X.strip(F.coalesce(model, F.lit("")))), "^sentence-transformers/", "")
    choice = F.when(F.lit(False), pair(0.0, 0.0))
    for fragment, n, k in MODEL_THRESHOLDS:
        choice = choice.when((kind == "local") & name.contains(fragment), pair(n, k))
    for known_provider, (n, k) in PROVIDER_THRESHOLDS.items():
        choice = choice.when(kind == known_provider, pair(n, k))
    return choice.otherwise(pair(*PROVIDER_THRESHOLDS["local"]))


def threshold_warning(provider: Column, model: Column, novel: Column, known: Column) -> Column:
    """True where the configured thresholds are 0.15 or more away from the recommended ones."""
    return X.let(
        recommended_thresholds(provider, model),
        lambda r: (F.round(F.abs(novel - r["novel"]), 9) >= 0.15) | (F.round(F.abs(known - r["known"]), 9) >= 0.15),
    )


def input_window(provider: Column, model: Column) -> Column:
    """Characters a known model can embed; null for unknown models."""
    key = F.concat_ws("|", F.lower(provider), F.lower(model))
    window = F.when(F.lit(False), F.lit(None).cast("int"))
    for (kind, name), tokens in MODEL_TOKENS.items():
        window = window.when(key == f"{kind}|{name}", F.lit(tokens * CHARS_PER_TOKEN))
    return window


def append_targets(matches: DataFrame, cfg: EngineConfig = DEFAULTS) -> DataFrame:
    """Query -> append target when the best match is known, clear of the runner-up and shares a tag.

    ``matches``: boosted matches of rank 1 and 2 with query_tags.
    """
    two = matches.filter("rank <= 2").groupBy("query_id").agg(
        F.min_by(F.struct("note_path", "base_similarity", "heading", "tags", "query_tags"), "rank").alias("best"),
        F.max_by(F.struct("note_path", "base_similarity"), F.when(F.col("rank") == 2, 2)).alias("next"),
    )
    far = (
        F.col("next").isNull()
        | (F.col("next.note_path") == F.col("best.note_path"))
        | (F.round(F.col("best.base_similarity") - F.col("next.base_similarity"), 9) >= cfg.append_margin)
    )
    margin_ok = far if cfg.append_margin > 0 else F.lit(True)
    asked, have = V.folded(F.col("best.query_tags")), V.folded(F.col("best.tags"))
    tag_ok = (F.size(asked) == 0) | (F.size(have) == 0) | (F.size(F.array_intersect(asked, have)) > 0)
    accepted = (F.col("best.base_similarity") >= cfg.known_threshold) & margin_ok
    if cfg.append_require_tag_overlap:
        accepted = accepted & tag_ok
    return two.filter(accepted).select(
        "query_id",
        F.col("best.note_path").alias("append_target"),
        F.round("best.base_similarity", 3).alias("overlap_similarity"),
        F.col("best.heading").alias("append_heading"),
    )


def context_rows(matches: DataFrame, cfg: EngineConfig = DEFAULTS) -> DataFrame:
    """Grounding excerpts per query: matches above the floor, best chunk per note, clipped."""
    usable = matches.filter((F.col("base_similarity") >= cfg.novel_threshold) & (F.coalesce("note_path", F.lit("")) != ""))
    first = usable.groupBy("query_id", "note_path").agg(F.min_by(F.struct("*"), "rank").alias("m"))
    limit = max(80, cfg.context_chars)
    return first.select(
        "query_id",
        "note_path",
        F.col("m.rank").alias("rank"),
        F.coalesce(F.nullif(F.col("m.note_title"), F.lit("")), F.col("note_path")).alias("note_title"),
        F.col("m.heading").alias("heading"),
        X.clip_with_mark(X.squeeze(F.coalesce("m.text", F.lit(""))), limit).alias("excerpt"),
        F.round("m.base_similarity", 3).alias("similarity"),
    )


def related_links(topics: DataFrame, matches: DataFrame, fallback: DataFrame, indexed: bool, cfg: EngineConfig = DEFAULTS) -> DataFrame:
    """Links of each topic to notes above the floor; the source-level list only when nothing can be queried."""
    found = (
        matches.filter((F.col("base_similarity") >= cfg.novel_threshold) & (F.coalesce("note_path", F.lit("")) != ""))
        .groupBy("query_id", L.format_link(F.col("note_path")).alias("link"))
        .agg(F.min("rank").alias("rank"))
        .groupBy("query_id")  # at most related_links rows each
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "link"))), lambda s: s["link"]).alias("links"))
    )
    none = F.array().cast(NO_STRINGS)
    joined = topics.join(found, "query_id", "left").join(fallback, "source_id", "left")
    unqueryable = F.lit(not indexed) | X.is_blank(F.col("text"))
    return joined.select(
        "query_id",
        F.when(unqueryable, F.coalesce("fallback_links", none)).otherwise(F.coalesce("links", none)).alias("links"),
    )


def source_links(overlap_rows: DataFrame, cfg: EngineConfig = DEFAULTS) -> DataFrame:
    """Links to the strongest overlaps of a source, best first."""
    order = Window.partitionBy("source_id").orderBy(F.desc("max_similarity"), "note_path")
    top = overlap_rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= cfg.related_links)
    return top.groupBy("source_id").agg(
        F.array_distinct(
            F.transform(F.sort_array(F.collect_list(F.struct("rank", "note_path"))), lambda s: L.format_link(s["note_path"]))
        ).alias("fallback_links")
    )


def inferred_tags(topics: DataFrame, overlap_rows: DataFrame, matches: DataFrame, cfg: EngineConfig = DEFAULTS) -> DataFrame:
    """Default tags, then tags of the strongest overlaps, then tags of the nearest chunks; first ``auto_tag_max``."""
    k = cfg.auto_tag_top_k
    order = Window.partitionBy("source_id").orderBy(F.desc("max_similarity"), "note_path")
    strong = overlap_rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    from_notes = topics.select("query_id", "source_id").join(strong, "source_id").select(
        "query_id", F.lit(1).alias("tier"), "rank", F.posexplode("tags").alias("pos", "tag")
    )
    from_chunks = matches.filter(F.col("rank") <= k).select(
        "query_id", F.lit(2).alias("tier"), "rank", F.posexplode("tags").alias("pos", "tag")
    )
    defaults = topics.select(
        "query_id", F.lit(0).alias("tier"), F.lit(0).alias("rank"),
        F.posexplode(F.array(*[F.lit(t) for t in cfg.default_tags])).alias("pos", "tag"),
    )
    ranked = (
        defaults.unionByName(from_notes).unionByName(from_chunks)
        .filter(F.coalesce("tag", F.lit("")) != "")
        .groupBy("query_id", "tag")
        .agg(F.min(F.struct("tier", "rank", "pos")).alias("at"))
    )
    first = Window.partitionBy("query_id").orderBy("at")
    return (
        ranked.withColumn("tag_pos", F.row_number().over(first))
        .filter(F.col("tag_pos") <= cfg.auto_tag_max)
        .select("query_id", "tag_pos", "tag")
    )
