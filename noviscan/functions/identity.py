"""Stable identities: URLs, source keys, hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from noviscan.config import EngineConfig
from noviscan.functions import text as X

# URL forms that carry a video id, and query parameters that never change a page.
VIDEO_URLS = (
    r"(?i)(?:https?://)?(?:www\.)?youtube\.com/watch\?v=([\w-]+)",
    r"(?i)(?:https?://)?(?:www\.)?youtu\.be/([\w-]+)",
    r"(?i)(?:https?://)?(?:www\.)?youtube\.com/shorts/([\w-]+)",
    r"(?i)(?:https?://)?(?:www\.)?youtube\.com/embed/([\w-]+)",
)
TRACKING = r"(?i)^(utm_\w+|fbclid|gclid|yclid|mc_cid|mc_eid|ref)$"
URL_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def video_id_in_video_url(url: Column) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(url, p, 1), F.lit("")) for p in VIDEO_URLS])


def video_id(url: Column) -> Column:
    """Video id from a known URL form, else from any ``v=`` query parameter; null when there is none."""
    text = X.strip(url)
    query = F.regexp_extract(text, r"\?(?:[^#]*&)?v=([^&#]+)", 1)
    return F.coalesce(video_id_in_video_url(text), F.nullif(query, F.lit("")))


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host, no fragment, no tracking parameters, no trailing slash."""

    def form_quote(c):
        encoded = F.url_encode(F.coalesce(F.try_url_decode(c), c))
        return F.replace(F.replace(encoded, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))

    def build(u):
        scheme, host = F.lower(F.regexp_extract(u, URL_PARTS, 1)), F.lower(F.regexp_extract(u, URL_PARTS, 2))
        path, query = F.regexp_extract(u, URL_PARTS, 3), F.regexp_extract(u, URL_PARTS, 4)
        pairs = F.filter(
            F.transform(
                F.filter(F.split(query, "&"), lambda p: p != ""),
                lambda p: F.struct(
                    F.substring_index(p, "=", 1).alias("k"),
                    F.regexp_replace(p, "^[^=]*=?", "").alias("v"),
                ),
            ),
            lambda p: ~F.coalesce(F.try_url_decode(p["k"]), p["k"]).rlike(TRACKING),
        )
        kept = F.array_join(
            F.transform(pairs, lambda p: F.concat(form_quote(p["k"]), F.lit("="), form_quote(p["v"]))), "&"
        )
        return F.concat(
            F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""),
            F.when(host != "", F.concat(F.lit("//"), host)).otherwise(""),
            F.when(path == "/", path).otherwise(F.rtrim(path, F.lit("/"))),
            F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""),
        )

    return X.let(X.strip(F.coalesce(url, F.lit(""))), build)


def source_key(source_type: Column, source_ref: Column) -> Column:
    """``youtube:<id>``, ``web:<url>`` or the path itself."""
    ref = X.strip(F.coalesce(source_ref, F.lit("")))
    kind = F.lower(X.strip(F.coalesce(source_type, F.lit(""))))
    found = video_id(ref)
    return (
        F.when(found.isNotNull(), F.concat(F.lit("youtube:"), found))
        .when(kind == "youtube", F.concat(F.lit("youtube:"), ref))
        .when((kind == "web") | ref.rlike("(?i)^https?://"), F.concat(F.lit("web:"), canonical_url(ref)))
        .otherwise(ref)
    )


def upload_key(filename: Column, content: Column) -> Column:
    name = F.replace(F.element_at(F.split(F.coalesce(filename, F.lit("upload")), "/"), -1), F.lit(":"), F.lit("_"))
    return F.concat(F.lit("upload:sha256:"), F.sha2(content, 256), F.lit(":"), name)


def _flag(value: bool) -> str:
    return "True" if value else "False"


def note_hash(title: Column, aliases: Column, tags: Column, content: Column, cfg: EngineConfig) -> Column:
    """Hash of everything that decides a note's vectors."""
    head = (
        f"{cfg.chunk_size}:{cfg.chunk_overlap}:{cfg.provider}:{cfg.model}:rich={_flag(cfg.rich_embeddings)}:"
        f"transclude={cfg.transclude_depth}:{cfg.transclude_chars}:"
    )
    return F.sha2(
        F.concat(
            F.lit(head), F.concat_ws(":", title, F.array_join(aliases, ","), F.array_join(tags, ","), content)
        ),
        256,
    )


def analysis_fingerprint(text: Column, cfg: EngineConfig) -> Column:
    return F.sha2(F.concat(text, F.lit("\0"), F.lit(cfg.analysis_settings_json())), 256)


def vault_token(vault_path: Column) -> Column:
    return F.substring(F.sha2(vault_path, 256), 1, 12)


def space_suffix(provider: Column, model: Column) -> Column:
    return F.concat(provider, F.lit("_"), F.regexp_replace(model, "[^a-zA-Z0-9_-]+", "_"))


def text_key(text: Column) -> Column:
    """Cache key of a query text."""
    return F.sha1(text)
