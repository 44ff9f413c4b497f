"""Vector and similarity expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from noviscan.config import EngineConfig
from noviscan.functions.text import let


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x
    )


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalize(a: Column) -> Column:
    return let(
        norm(a),
        lambda n: F.when(n == 0, a.cast("array<double>")).otherwise(F.transform(a, lambda x: x.cast("double") / n)),
    )


def cosine(a: Column, b: Column) -> Column:
    return let(norm(a) * norm(b), lambda n: F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n))


def folded(tags: Column) -> Column:
    """Distinct lower-case tags; null counts as no tags."""
    clean = F.filter(F.coalesce(tags, F.array().cast("array<string>")), lambda t: t.isNotNull() & (t != ""))
    return F.array_distinct(F.transform(clean, F.lower))


def shared_tags(a: Column, b: Column) -> Column:
    return F.array_intersect(folded(a), folded(b))


def tag_boost(a: Column, b: Column, cfg: EngineConfig) -> Column:
    if not cfg.tag_boost_enabled:
        return F.lit(0.0)
    return F.least(F.lit(cfg.tag_boost_max), F.size(shared_tags(a, b)) * F.lit(cfg.tag_boost_per_tag))


def adjusted(base: Column, a: Column, b: Column, cfg: EngineConfig) -> Column:
    """Ranking similarity: tags may lift it, 1.0 is the ceiling."""
    return F.least(F.lit(1.0), base + tag_boost(a, b, cfg))


def for_verdict(base: Column, a: Column, b: Column, cfg: EngineConfig) -> Column:
    """Similarity for the known test: the boost counts only at or above the novel threshold."""
    return F.when(base < cfg.novel_threshold, base).otherwise(adjusted(base, a, b, cfg))
