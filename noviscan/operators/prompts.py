"""Prompt rows for an external completion step, and parsing of its replies."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from noviscan.config import DEFAULTS, EngineConfig
from noviscan.functions import text as X

# Fence around untrusted text, and everything that looks like it.
FENCE_OPEN, FENCE_CLOSE = "<<<UNTRUSTED_SOURCE>>>", "<<<END_UNTRUSTED_SOURCE>>>"
FENCE_LIKE = r"(?i)<<<\s*(?:/?UNTRUSTED_SOURCE|END_UNTRUSTED_SOURCE)\s*>>>"
REDACTED = "[untrusted-marker-redacted]"
NOTE_MARK = r"(?mid)^[ \t]*={2,}\s*NOTE\s*[:#]?\s*(\d+)\s*={2,}[ \t]*$"


def redact(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), FENCE_LIKE, REDACTED)


def fenced(label: str, text: Column) -> Column:
    return F.concat(F.lit(f"{FENCE_OPEN} {label}\n"), redact(text), F.lit(f"\n{FENCE_CLOSE}"))


def rule_lines(rules: DataFrame, domain: str) -> DataFrame:
    """One row with the bullet list of a named rule pack (domain, pos, rule); empty for unsafe names."""
    safe = bool(re.fullmatch(r"[a-z0-9_-]+", domain.strip().lower()))
    picked = rules.filter((F.col("domain") == domain.strip().lower()) & F.lit(safe)).filter(~X.is_blank(F.col("rule")))
    lines = F.collect_list(F.struct("pos", F.concat(F.lit("- "), X.strip(F.col("rule"))).alias("text")))
    return picked.agg(X.join_ordered(lines, "\n").alias("rules"))


def _rules(text: Column | None) -> Column:
    return F.concat(F.lit("\nRules:\n"), F.coalesce(text, F.lit(""))) if text is not None else F.lit("")


def planning_prompts(windows: DataFrame, sources: DataFrame, targets: DataFrame, rules: Column | None = None, cfg: EngineConfig = DEFAULTS) -> DataFrame:
    """One prompt per planning window.

    ``windows``: source_id, window_index, segment_index, where, text (at most ``planning_max_segments``
    rows and ``planning_total_chars`` characters per window). ``targets``: source_id, target_notes.
    """
    outline = F.struct(
        F.col("segment_index").alias("index"), F.col("where").alias("location"), X.truncate(F.col("text"), cfg.planning_segment_chars).alias("text")
    )
    grouped = windows.groupBy("source_id", "window_index").agg(
        F.count(F.lit(1)).alias("segments"), F.to_json(F.sort_array(F.collect_list(outline))).alias("outline")
    )
    rows = grouped.join(sources, "source_id").join(targets, "source_id")
    prompt = F.concat(
        F.lit("Plan atomic notes for the segments below, one per distinct concept.\nSource: "), redact(F.col("title")),
        F.lit("\nType: "), F.col("source_type"), F.lit("\nSegments: "), F.col("segments"),
        F.lit("\nVerdict: "), F.col("verdict"), F.lit("\nNotes wanted: at least "), F.col("target_notes"), F.lit("\n\n"),
        fenced("segments with location", F.col("outline")),
        F.lit('\n\nAnswer with a JSON array only; items carry "title", "segment_indices" and "summary".'), _rules(rules),
    )
    return rows.select("source_id", "window_index", prompt.alias("prompt"), F.length(prompt).alias("prompt_chars"))


def draft_prompt(title: Column, source_title: Column, source_type: Column, where: Column, evidence: Column, links: Column, context: Column, rules: Column | None = None, cfg: EngineConfig = DEFAULTS) -> Column:
    known = F.when(X.is_blank(F.coalesce(context, F.lit(""))), "").otherwise(
        F.concat(F.lit("\nExisting notes:\n"), fenced("vault excerpts", X.strip(context)), F.lit("\n"))
    )
    listed = F.when(F.size(links) > 0, F.array_join(links, ", ")).otherwise("none")
    return F.concat(
        F.lit("Write one atomic note about '"), redact(title), F.lit("'.\nSource: "), redact(source_title), F.lit(" ("), source_type,
        F.lit(")\nLocation: "), redact(where), F.lit("\nRelated notes: "), listed, F.lit("\n"), known, F.lit("\n"),
        fenced("source evidence", X.strip(evidence)),
        F.lit("\n\nBegin with '# "), redact(title), F.lit(f"' and stay under {cfg.max_note_lines} lines."), _rules(rules),
    )


def claims_prompt(title: Column, source_title: Column, where: Column, evidence: Column) -> Column:
    return F.concat(
        F.lit("List facts about '"), redact(title), F.lit("' that the evidence supports.\nSource: "), redact(source_title),
        F.lit("\nLocation: "), redact(where), F.lit("\n\n"), fenced("source evidence", evidence),
        F.lit('\n\nAnswer with one JSON object: "claims", "terms" and "caveats", each an array of strings under 200 characters.'),
    )


def batch_prompts(topics: DataFrame, rules: Column | None = None, cfg: EngineConfig = DEFAULTS) -> DataFrame:
    """One prompt per draft batch (run_id, batch) of at most ``draft_batch`` topics."""
    item = F.struct(F.col("pos"), F.col("slot").cast("string").alias("id"), "title", F.col("where").alias("location"), "evidence")
    rows = F.transform(F.sort_array(F.collect_list(item)), lambda s: s.dropFields("pos"))
    prompt = F.concat(
        F.lit("Write one atomic note per concept.\n\n"), fenced("concepts and evidence", F.to_json("items")),
        F.lit(f"\n\nAnswer only with blocks that start with a line '===NOTE <id>===' followed by '# <title>' and the body (under {min(30, cfg.max_note_lines)} lines each)."),
        _rules(rules),
    )
    return topics.groupBy("run_id", "batch").agg(rows.alias("items")).select("run_id", "batch", prompt.alias("prompt"))


# --- replies --------------------------------------------------------------------------------------


def without_fences(body: Column) -> Column:
    text = X.strip(body)
    bare = F.regexp_replace(F.regexp_replace(text, r"^```[a-zA-Z0-9]*\s*\n?", ""), r"\n?```\s*$", "")
    return X.strip(F.when(text.startswith("```"), bare).otherwise(text))


def delimited_notes(replies: DataFrame, reply: str = "reply", keys: tuple[str, ...] = ("reply_id",)) -> DataFrame:
    """note_id, body per ``===NOTE id===`` block; the first non-empty block of an id wins."""
    parts = F.split(F.regexp_replace(F.coalesce(F.col(reply), F.lit("")), NOTE_MARK, "\x01$1\x02"), "\x01")
    rows = replies.select(*keys, F.posexplode(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))).alias("at", "part"))
    blocks = rows.select(
        *keys, "at", F.substring_index("part", "\x02", 1).alias("note_id"), without_fences(F.substring_index("part", "\x02", -1)).alias("body")
    ).filter(F.col("body") != "")
    return blocks.groupBy(*keys, "note_id").agg(F.min_by("body", "at").alias("body"))


def match_replies(topics: DataFrame, bodies: DataFrame) -> DataFrame:
    """Topics (run_id, batch, slot, title) with their body: by id, else by folded composed title.

    ``bodies``: run_id, batch, at, note_id, title, body. The first body wins on either way.
    """
    usable = bodies.filter(~X.is_blank(F.coalesce("body", F.lit(""))))
    named = X.strip(F.coalesce("note_id", F.lit("")))
    by_id = usable.filter(named != "").groupBy("run_id", "batch", named.alias("slot_id")).agg(F.min_by("body", "at").alias("id_body"))
    by_title = (
        usable.filter(named == "")
        .groupBy("run_id", "batch", F.lower(X.strip(F.coalesce("title", F.lit("")))).alias("title_key"))
        .agg(F.min_by("body", "at").alias("title_body"))
    )
    keyed = topics.withColumn("slot_id", F.col("slot").cast("string")).withColumn("title_key", F.lower(X.compose_title(F.col("title"))))
    return (
        keyed.join(by_id, ["run_id", "batch", "slot_id"], "left")
        .join(by_title, ["run_id", "batch", "title_key"], "left")
        .withColumn("body", X.strip(F.coalesce("id_body", "title_body")))
        .drop("slot_id", "title_key", "id_body", "title_body")
    )


ITEM = "array<struct<id:string,title:string,body:string,summary:string,segment_indices:array<bigint>>>"
SMART = {0x201C: '"', 0x201D: '"', 0x201E: '"', 0x2018: "'", 0x2019: "'", 0x00AB: '"', 0x00BB: '"'}


@pandas_udf(T.StringType())
def _recovered(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Best JSON array of objects inside a damaged reply, as JSON text; null when there is none."""
    decoder = json.JSONDecoder(strict=False)

    def weight(items):
        keys = [set(i) for i in items]
        return sum(1 + 10 * ("title" in k) + 3 * ("id" in k) + 5 * bool(k & {"body", "segment_indices", "summary"}) for k in keys)

    def values(text, opener):
        at = text.find(opener)
        while at >= 0:
            try:
                value, end = decoder.raw_decode(text, at)
            except ValueError:
                value, end = None, at + 1
            if value is not None:
                yield value
            at = text.find(opener, end)

    def dicts(items):
        return [v for v in items if isinstance(v, dict)]

    def complete(text):
        """Arrays that decode whole, bare or as a value of an object; a wrapped one counts if it has objects."""
        yield from (dicts(v) for v in values(text, "[") if isinstance(v, list))
        wrapped = (v for o in values(text, "{") if isinstance(o, dict) for v in o.values() if isinstance(v, list))
        yield from filter(None, map(dicts, wrapped))

    def loose(text):
        yield [o for o in values(text, "{") if isinstance(o, dict) and {"title", "body", "segment_indices"} & set(o)]

    def recover(text):
        if text is None:
            return None
        repaired = re.sub(r",(\s*[\]}])", r"\1", text.translate(SMART))
        variants = list(dict.fromkeys((text, repaired)))
        for rank in (complete, loose):  # loose objects count only where no array decodes
            found = [items for variant in variants for items in rank(variant)]
            if found:
                best = max(found, key=weight)  # the first among equals
                return json.dumps(best, ensure_ascii=False) if best else None
        return None

    for series in batches:
        yield series.map(recover)


def reply_items(replies: DataFrame, reply: str = "reply", keys: tuple[str, ...] = ("reply_id",)) -> DataFrame:
    """Objects of the JSON array in each reply. Clean replies stay on the JVM; only the rest is repaired."""
    clean = without_fences(F.coalesce(F.col(reply), F.lit("")))
    staged = replies.select(*keys, clean.alias("__text")).withColumn(
        "__items", F.when(F.col("__text").rlike(r"(?s)^\[\s*\{.*\}\s*\]$"), F.from_json("__text", ITEM))
    )
    good = F.col("__items").isNotNull() & (F.size("__items") > 0) & ~F.exists("__items", lambda i: i.isNull())
    fast = staged.filter(F.coalesce(good, F.lit(False)))
    slow = staged.filter(~F.coalesce(good, F.lit(False))).withColumn("__items", F.from_json(_recovered("__text"), ITEM))
    return fast.unionByName(slow).select(*keys, F.posexplode("__items").alias("at", "i")).select(*keys, "at", "i.*")


CLAIMS = "struct<claims:array<string>,terms:array<string>,caveats:array<string>>"


def claims(reply: Column) -> Column:
    """struct<claims, terms, caveats> of a reply, each item at most 200 characters; null when unusable."""
    text = X.strip(F.coalesce(reply, F.lit("")))
    outer = F.regexp_extract(text, r"(?s)(\{.*\})", 1)

    def clean(items):
        return F.transform(X.nonempty(F.coalesce(items, F.array().cast("array<string>"))), lambda s: F.substring(s, 1, 200))

    def build(p):
        out = F.struct(clean(p["claims"]).alias("claims"), clean(p["terms"]).alias("terms"), clean(p["caveats"]).alias("caveats"))
        return X.let(out, lambda o: F.when((F.size(o["claims"]) + F.size(o["terms"]) + F.size(o["caveats"])) > 0, o))

    return X.let(F.from_json(outer, CLAIMS), lambda p: F.when(p.isNotNull(), build(p)))
