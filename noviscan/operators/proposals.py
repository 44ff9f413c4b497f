"""Note proposals: body, header, sections, quality, write mode, map of content."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from noviscan.config import DEFAULTS, EngineConfig
from noviscan.functions import links as L
from noviscan.functions import text as X
from noviscan.operators.evidence import DEFINITIONAL
from noviscan.operators.ordering import dense_index, keep_first, prefix_sums

STRINGS = "array<string>"
BULLET = r"(?U)^[-*]\s+(.*)$"
HEADING = r"(?U)^#{1,6}\s+\S"


# --- body -----------------------------------------------------------------------------------------


def refine_body(body: Column) -> Column:
    """Blank lines around headings, no empty or repeated bullets within a section, no blank runs.

    The text is cut at fenced blocks and headings; inside a section, repeats are dropped with array
    operations, so a long note costs no more than sorting its lines.
    """

    def bullet_key(line):
        return X.word_key(F.regexp_extract(line, BULLET, 1))

    def tidy_section(lines):
        marked = F.transform(
            lines,
            lambda s, i: F.struct(
                i.alias("i"),
                X.rstrip(s).alias("raw"),
                X.strip(s).rlike(BULLET).alias("is_bullet"),
                F.when(X.strip(s).rlike(BULLET), F.nullif(bullet_key(X.strip(s)), F.lit(""))).alias("key"),
            ),
        )

        def drop(rows):
            keyed = F.sort_array(
                F.transform(F.filter(rows, lambda r: r["key"].isNotNull()), lambda r: F.struct(r["key"].alias("key"), r["i"].alias("i")))
            )
            repeats = X.let(
                keyed,
                lambda k: F.transform(
                    F.filter(k, lambda r, j: (j > 0) & (F.get(k, j - 1)["key"] == r["key"])), lambda r: r["i"]
                ),
            )
            kept = X.let(
                repeats,
                lambda gone: F.filter(
                    rows,
                    lambda r: ~F.array_contains(gone, r["i"])
                    & ~(r["is_bullet"] & (X.strip(F.regexp_extract(X.strip(r["raw"]), BULLET, 1)) == "")),
                ),
            )
            return F.transform(
                kept,
                lambda r: F.when(
                    r["is_bullet"], F.concat(F.lit("- "), X.strip(F.regexp_extract(X.strip(r["raw"]), BULLET, 1)))
                ).otherwise(r["raw"]),
            )

        return F.array_join(X.let(marked, drop), "\n")

    def tidy_part(part):
        """One heading line (first, when present) with its section."""

        def build(lines):
            first = X.strip(F.get(lines, 0))
            headed = first.rlike(HEADING)
            rest = F.when(headed, F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))).otherwise(lines)
            return F.when(headed, F.concat(F.lit("\n\n"), first, F.lit("\n\n"), tidy_section(rest))).otherwise(tidy_section(lines))

        return X.let(F.split(part, "\n"), build)

    def tidy_text(piece):
        cut = F.split(F.regexp_replace(piece, r"(?mdU)^[^\S\n]*(#{1,6}[^\S\n]+\S)", "\x01$1"), "\n?\x01")
        joined = F.array_join(F.transform(F.filter(cut, lambda p: p != ""), tidy_part), "\n")
        return F.regexp_replace(F.regexp_replace(joined, r"(?U)\n[^\S\n]+(?=\n)", "\n"), r"\n{3,}", "\n\n")

    def piecewise(t):
        fence = r"(?mdU)^[^\S\n]*```[^\n]*(?:\n(?![^\S\n]*```)[^\n]*)*+(?:\n[^\S\n]*```[^\n]*)?"
        # a fence is one mark while the prose around it is tidied, so a section goes on behind it
        prose = F.split(tidy_text(F.regexp_replace(t, fence, "\x02")), "\x02")
        code = F.regexp_extract_all(t, F.lit(fence), F.lit(0))
        woven = F.transform(
            prose,
            lambda p, i: F.concat(
                F.when(i > 0, F.concat(F.lit("\n\n"), X.rstrip(F.coalesce(F.get(code, i - 1), F.lit(""))), F.lit("\n"))).otherwise(""),
                F.when(i > 0, F.regexp_replace(p, r"^\n", "")).otherwise(p),
            ),
        )
        return F.concat(X.strip(F.regexp_replace(F.array_join(woven, ""), r"\n{3,}", "\n\n")), F.lit("\n"))

    return X.let(F.replace(F.coalesce(body, F.lit("")), F.lit("\r\n"), F.lit("\n")), piecewise)


def with_heading(body: Column, title: Column) -> Column:
    """Body that starts with ``# title``: the first line is replaced when it is a level 1 heading."""
    concept = F.coalesce(F.nullif(X.strip(title), F.lit("")), F.lit("Untitled concept"))

    def build(t):
        own = t.rlike(r"(?U)^\s*#(?!#)")
        swapped = F.concat(F.lit("# "), concept, F.regexp_replace(t, r"(?dU)^\s*#[^\n]*", ""))
        added = F.concat(F.lit("# "), concept, F.lit("\n\n"), X.lstrip(t))
        text = F.when(X.is_blank(t), F.concat(F.lit("# "), concept)).when(own, swapped).otherwise(added)
        return F.concat(X.rstrip(text), F.lit("\n"))

    return X.let(F.ltrim(F.replace(F.coalesce(body, F.lit("")), F.lit("\r\n"), F.lit("\n")), F.lit("\n")), build)


def nucleus_bullet(sentence: Column) -> Column:
    """``- **Nucleus** — clause`` of one claim; the nucleus is its first content words."""

    def build(s):
        def named(n):
            lead = F.array_join(F.slice(n["all"], F.lit(1), F.size(F.split(n["name"], " "))), " ")
            cut = F.ltrim(F.substring(s, F.length(lead) + 1, F.length(s)), F.lit(" ,:—-–"))
            starts = (lead != "") & F.lower(s).startswith(F.lower(lead))
            clause = F.when(starts & (cut != ""), cut).otherwise(s)
            return X.let(
                clause,
                lambda c: F.when(
                    (c != "") & (F.lower(c) != F.lower(n["name"])), F.concat(F.lit("- **"), n["name"], F.lit("** — "), c)
                ).otherwise(F.concat(F.lit("- **"), n["name"], F.lit("**"))),
            )

        def name(w):
            count = F.least(F.lit(6), F.greatest(F.lit(2), F.floor(F.size(w["content"]) / 2).cast("int")))
            picked = F.array_join(
                F.transform(F.slice(w["content"], F.lit(1), count), lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, F.lit(2), F.length(x)))), " "
            )
            plain = F.array_join(F.slice(w["all"], 1, 6), " ")
            capital = F.concat(F.upper(F.substring(plain, 1, 1)), F.substring(plain, F.lit(2), F.length(plain)))
            text = F.when(F.size(w["content"]) > 0, picked).when(F.size(w["all"]) > 0, capital).otherwise("Point")
            return X.let(F.struct(text.alias("name"), w["all"].alias("all")), named)

        facts = F.struct(X.content_words(s).alias("content"), F.regexp_extract_all(s, F.lit(X.WORD), F.lit(0)).alias("all"))
        return X.let(facts, name)

    return X.let(X.strip(F.coalesce(sentence, F.lit(""))), build)


def draft_body(title: Column, l3: Column, l2: Column, l1: Column) -> Column:
    """Extractive note: heading, quoted summary, a definition line and key points."""
    definition = F.coalesce(F.try_element_at(F.filter(l2, lambda s: s.rlike(DEFINITIONAL)), F.lit(1)), F.try_element_at(l2, F.lit(1)))
    points = F.when(F.size(l2) > 0, l2).otherwise(l1)
    first_repeats = X.word_key(F.coalesce(F.try_element_at(points, F.lit(1)), F.lit(""))) == X.word_key(F.coalesce(definition, F.lit("")))
    shown = F.when(
        definition.isNotNull() & (F.size(points) > 0) & first_repeats,
        F.slice(points, F.lit(2), F.greatest(F.size(points) - 1, F.lit(0))),
    ).otherwise(points)
    quote = F.when(~X.is_blank(l3), F.concat(F.lit("> "), X.strip(l3), F.lit("\n\n"))).otherwise("")
    line = F.coalesce(F.concat(definition, F.lit("\n\n")), F.lit(""))
    listed = X.let(
        shown,
        lambda s: F.when(F.size(s) > 0, F.concat(F.lit("## Key points\n\n"), F.array_join(F.transform(s, nucleus_bullet), "\n"))).otherwise(""),
    )
    return refine_body(F.concat(F.lit("# "), X.compose_title(title), F.lit("\n\n"), quote, line, listed))


def without_source_section(body: Column) -> Column:
    return X.strip(F.regexp_replace(X.strip(body), r"(?iU)\n## Source\b[\s\S]*$", ""))


RELATED_SECTION = r"(?iU)\n#{1,6}[ \t]*Related notes\b[\s\S]*?(?=\n#{1,6}\s|\z)"


def without_related_section(body: Column) -> Column:
    return X.strip(F.regexp_replace(X.strip(body), RELATED_SECTION, "\n"))


def add_related_links(content: Column, extra: Column) -> Column:
    """Merge links into an existing related-notes list; ``none`` entries vanish."""
    block = r"(?i)#{1,6}[ \t]*Related notes[ \t]*\n+((?:[ \t]*-[ \t].*\n?)+)"
    body = F.regexp_extract(content, block, 1)
    have = F.transform(
        F.filter(F.transform(F.split(body, "\n"), X.strip), lambda s: s.startswith("- ")),
        lambda s: X.strip(F.substring(s, F.lit(3), F.length(s))),
    )
    merged = F.array_distinct(F.concat(F.filter(have, lambda s: (s != "") & (F.lower(s) != "none")), extra))
    lines = F.concat(F.array_join(F.transform(merged, lambda s: F.concat(F.lit("- "), s)), "\n"), F.lit("\n"))
    at = F.position(body, content)
    head = F.substring(content, F.lit(1), at - 1)
    tail = F.substring(content, at + F.length(body), F.length(content))
    return F.when((F.size(extra) == 0) | (body == ""), content).otherwise(F.concat(head, lines, tail))


# --- header and sections --------------------------------------------------------------------------


def _quoted(value: Column) -> Column:
    """YAML scalar: plain where that is safe, else single-quoted."""
    risky = (
        value.rlike(r"^[\s\-?:,\[\]{}#&*!|>'\"%@`]|^$|:\s|:$|\s#|\s$|[\x00-\x1f]")
        | value.rlike(r"(?i)^(?:true|false|yes|no|on|off|null|~|[-+]?[0-9][0-9_,.:eE+-]*)$")
    )
    return F.when(risky, F.concat(F.lit("'"), F.replace(value, F.lit("'"), F.lit("''")), F.lit("'"))).otherwise(value)


def header(
    concept: Column, source_type: Column, source_ref: Column, where: Column, created: Column, tags: Column,
    loc: dict[str, Column], cfg: EngineConfig = DEFAULTS,
) -> Column:
    """YAML header of a proposal; ``created`` is an input so that runs repeat."""

    def field(name, value):
        return F.concat(F.lit(f"{name}: "), value)

    tag_lines = F.when(
        F.size(tags) > 0, F.concat(F.lit("tags:\n"), F.array_join(F.transform(tags, lambda t: F.concat(F.lit("- "), _quoted(t))), "\n"))
    )
    line_end = F.coalesce(F.when(loc["line_end"] != 0, loc["line_end"]), loc["line_start"])
    ts_end = F.coalesce(F.when(loc["ts_end"] != 0, loc["ts_end"]), loc["ts_start"])
    lines = F.concat_ws(
        "\n",
        F.lit("---"),
        field("concept", _quoted(concept)),
        field("source_type", source_type),
        field("source_ref", _quoted(source_ref)),
        field("source", _quoted(source_ref)),
        field("source_location", _quoted(where)),
        field("created", F.concat(F.lit("'"), created, F.lit("'"))),
        F.lit(f"type: {cfg.frontmatter_type}") if cfg.frontmatter_type else F.lit(None).cast("string"),
        F.lit(f"status: {cfg.frontmatter_status}") if cfg.frontmatter_status else F.lit(None).cast("string"),
        tag_lines,
        F.when(loc["page"].isNotNull(), field("source_page", loc["page"])),
        F.when(loc["page"].isNotNull() & (loc["page_end"] != 0) & (loc["page_end"] != loc["page"]), field("source_page_end", loc["page_end"])),
        F.when(loc["line_start"].isNotNull(), field("source_line_start", loc["line_start"])),
        F.when(loc["line_start"].isNotNull(), field("source_line_end", line_end)),
        F.when(loc["ts_start"].isNotNull(), field("source_timestamp_start", F.round(loc["ts_start"], 3))),
        F.when(loc["ts_start"].isNotNull(), field("source_timestamp_end", F.round(ts_end, 3))),
        F.lit("---"),
    )
    return F.concat(lines, F.lit("\n"))


def source_section(source_type: Column, source_ref: Column, where: Column, ts_start: Column) -> Column:
    def two(label, ref, tail):
        return F.concat(F.lit(f"## Source\n\n- {label}: "), ref, tail, F.lit("\n"))

    ticked = F.concat(F.lit("`"), source_ref, F.lit("`"))
    at = F.concat(F.lit("\n- Location: "), where)
    clock = F.concat(F.lit("\n- Timestamp: "), where, F.lit(" (`t="), ts_start.cast("long"), F.lit("`)"))
    return (
        F.when((source_type == "youtube") & ts_start.isNotNull(), two("Video", source_ref, clock))
        .when(source_type == "pdf", two("Document", ticked, at))
        .when(source_type == "web", two("Article", source_ref, F.concat(at, F.lit(" (in extracted article text)"))))
        .when(source_type == "epub", two("Book", ticked, at))
        .otherwise(two("File", ticked, at))
    )


def assemble(body: Column, title: Column, media: Column, links: Column, source_text: Column, head: Column) -> Column:
    """Final note text: header, refined body under its title, media, related links, source."""
    core = with_heading(refine_body(without_source_section(body)), title)
    shown = F.coalesce(media, F.lit(""))
    with_media = F.when(
        (shown != "") & ~core.contains("## Tables & figures"), F.concat(X.rstrip(core), F.lit("\n\n"), shown)
    ).otherwise(core)
    bullets = F.when(
        F.size(links) > 0, F.array_join(F.transform(links, lambda s: F.concat(F.lit("- "), s)), "\n")
    ).otherwise("- none")
    related = F.concat(X.rstrip(without_related_section(with_media)), F.lit("\n\n## Related notes\n\n"), bullets)
    return F.concat(head, related, F.lit("\n\n"), source_text)


# Template tags that are understood besides ``{{key}}``.
TEMPLATER = (
    (r"<%\s*tp\.file\.title\s*%>", "{{title}}"),
    (r"<%\s*tp\.date\.now\([^)]*\)\s*%>", "{{date}}"),
    (r"<%\s*tp\.file\.creation_date\([^)]*\)\s*%>", "{{created}}"),
    (r"<%\s*tp\.frontmatter\.(\w+)\s*%>", "{{$1}}"),
)


def expand_template(template: str | Column, values: dict[str, Column], moment: Column) -> Column:
    text = F.lit(template) if isinstance(template, str) else template
    for pattern, mark in TEMPLATER:
        text = F.regexp_replace(text, pattern, mark.replace("{", "\\{").replace("}", "\\}") if "$" not in mark else mark)
    stamped = {**values, "date": F.date_format(moment, "yyyy-MM-dd"), "datetime": F.date_format(moment, "yyyy-MM-dd HH:mm")}
    for key, value in stamped.items():
        text = F.replace(text, F.lit("{{%s}}" % key), F.coalesce(value, F.lit("")))
    return text


# --- decisions ------------------------------------------------------------------------------------


def write_decisions(proposals: DataFrame, targets: DataFrame, nearest: DataFrame) -> DataFrame:
    """write/append per proposal.

    ``targets``: query_id, append_target, append_heading, overlap_similarity (the gate).
    ``nearest``: query_id, near_path, near_heading, near_similarity, update_type, update_reason.
    ``proposals`` may carry ``analysed_path``: the note being analysed in place.
    """
    p = proposals.join(targets, "query_id", "left").join(nearest, "query_id", "left")
    gate = F.nullif(L.append_target_path(F.col("append_target")), F.lit(""))
    from_update = F.when(F.col("update_type").isNotNull(), F.col("near_path"))
    target = F.coalesce(gate, from_update)
    heading = F.when(gate.isNotNull(), F.coalesce("append_heading", L.append_target_heading(F.col("append_target")))).otherwise(
        F.when(F.col("update_type").isNotNull(), F.col("near_heading"))
    )
    in_place = L.same_path(target, F.col("analysed_path")) if "analysed_path" in proposals.columns else F.lit(False)
    mode = F.when(F.col("update_type").isNotNull() & target.isNotNull(), "append").when(in_place, "append").otherwise("write")
    analysed = L.relative_path(F.col("analysed_path")) if "analysed_path" in proposals.columns else F.lit(None).cast("string")
    return p.select(
        "query_id",
        F.when(in_place, analysed).otherwise(F.col("note_path")).alias("note_path"),
        mode.alias("write_mode"),
        target.alias("append_target"),
        heading.alias("append_heading"),
        F.coalesce(
            F.when(gate.isNotNull(), F.col("overlap_similarity")),
            F.when(F.col("update_type").isNotNull(), F.round("near_similarity", 3)),
        ).alias("overlap_similarity"),
        "update_type",
        F.when(F.col("update_type").isNotNull(), F.col("near_path")).alias("update_target"),
        "update_reason",
    )


def free_paths(proposals: DataFrame, taken: DataFrame | None = None, pos: str = "pos") -> DataFrame:
    """Number repeated output paths ``-2``, ``-3`` …, skipping names that are taken.

    Repeats of one base path are ranked by a blocked count. A ranked name that collides with a taken
    or original path is moved behind the highest suffix seen for its base, in the same order, so
    names stay unique without walking a source row by row.
    """
    numbered = prefix_sums(proposals, ["source_id", "note_path"], pos, {"__n": F.lit(1)})
    base = F.regexp_replace("note_path", r"(?i)\.md$", "")
    reserved = proposals.select("source_id", "note_path")
    if taken is not None:
        reserved = reserved.unionByName(taken.select("source_id", "note_path"))
    suffixes = (
        reserved.select(
            "source_id",
            F.regexp_replace("note_path", r"(?i)-\d+\.md$", "").alias("__base"),
            F.regexp_extract("note_path", r"(?i)-(\d{1,9})\.md$", 1).alias("__s"),
        )
        .filter(F.col("__s") != "")
        .groupBy("source_id", "__base")
        .agg(F.max(F.col("__s").cast("long")).alias("__top"))
    )
    held = (
        taken.select("source_id", "note_path").distinct().withColumn("__held", F.lit(1))
        if taken is not None
        else None
    )
    rows = numbered.withColumn("__base", base)
    rows = rows.join(held, ["source_id", "note_path"], "left") if held is not None else rows.withColumn("__held", F.lit(None).cast("int"))
    rows = rows.join(suffixes, ["source_id", "__base"], "left")
    number = F.col("__n") + F.coalesce("__held", F.lit(0)) + 1
    shifted = F.when(F.col("__top").isNull(), number).otherwise(F.greatest(F.col("__top"), F.lit(1)) + number - 1)
    path = F.when(number == 1, F.col("note_path")).otherwise(F.concat("__base", F.lit("-"), shifted, F.lit(".md")))
    return rows.withColumn("free_path", path).drop("__n", "__base", "__held", "__top")


def content_maps(proposals: DataFrame, sources: DataFrame, cfg: EngineConfig = DEFAULTS) -> DataFrame:
    """One map-of-content note per source with enough proposals, unless its path is taken.

    ``proposals``: source_id, pos, note_path (at most ``max_notes_per_source`` per source).
    """
    links = keep_first(
        proposals.filter(F.coalesce("note_path", F.lit("")) != "").select("source_id", "pos", L.format_link(F.col("note_path")).alias("text")),
        [F.col("source_id"), F.col("text")],
        ["pos"],
    )
    listed = links.groupBy("source_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda s: F.concat(F.lit("- "), s["text"])).alias("lines")
    )
    counts = proposals.groupBy("source_id").agg(F.count(F.lit(1)).alias("notes")).filter(F.col("notes") >= cfg.moc_min_notes)
    body = F.concat(
        F.lit("# "), F.col("title"), F.lit(" — notes\n\nIndex of "), F.col("notes"),
        F.lit(" note(s) imported from this source.\n\n## Notes\n\n"), F.array_join("lines", "\n"), F.lit("\n"),
    )
    sample = L.output_path(
        F.col("title"), F.lit("index"), F.lit("text"), F.current_timestamp(), cfg.output_folder, cfg.output_layout
    )
    rows = counts.join(listed, "source_id").join(sources, "source_id").select(
        "source_id",
        F.concat("title", F.lit(" — index")).alias("concept_title"),
        L.moc_path(sample).alias("note_path"),
        body.alias("content"),
        F.col("notes").alias("note_count"),
    )
    return rows.join(proposals.select("source_id", "note_path"), ["source_id", "note_path"], "left_anti")


# --- quality --------------------------------------------------------------------------------------


def quality(title: Column, content: Column, cfg: EngineConfig = DEFAULTS) -> Column:
    """struct<quality_score, quality_flags>: six structural points of a drafted note."""

    def judge(n):
        body, name = n["body"], n["title"]
        titled = (n["h1"] != "") & (name != "") & (F.lower(n["h1"]) == F.lower(name))
        defined = F.length(n["para"]).between(40, 400)
        linked = n["related"].contains("[[")
        none = n["related"].rlike(r"(?i)-\s*none\b")
        points = (
            F.when(n["headed"], 1.0).otherwise(0.0)
            + F.when(titled, 1.0).otherwise(0.0)
            + F.when(defined, 1.0).otherwise(0.0)
            + F.when(n["bullets"].between(2, 12), 1.0).otherwise(0.0)
            + F.when(linked & none, 0.25).when(linked, 1.0).otherwise(0.0)
            + F.when(n["lines"].between(8, cfg.max_note_lines), 1.0).otherwise(0.0)
        )
        words = lambda c: F.array_distinct(X.content_words(c))
        flags = F.array_compact(
            F.array(
                F.when(~n["headed"], "missing_frontmatter"),
                F.when(~titled, "heading_mismatch"),
                F.when(~defined, "weak_definition"),
                F.when((name != "") & ~X.grounded(words(name), words(n["prose"])), "title_ungrounded"),
                F.when(n["bullets"] < 2, "few_bullets").when(n["bullets"] > 12, "too_many_bullets"),
                F.when(linked & none, "no_related_links").when(~linked, "missing_related_section"),
                F.when(n["lines"] < 8, "too_short").when(n["lines"] > cfg.max_note_lines, "too_long"),
            )
        )
        return F.struct(F.round(points / 6.0, 3).alias("quality_score"), flags.alias("quality_flags"))

    def facts(body):
        below = F.when(body.rlike(r"(?mdU)^#\s+.+$"), F.regexp_extract(body, r"(?sdU)(?m)^#\s+[^\n]+$(.*)\z", 1)).otherwise(body)
        prose = X.strip(F.regexp_replace(below, r"(?U)^---[\s\S]*?---\s*", ""))
        return X.let(
            prose,
            lambda p: X.let(
                F.struct(
                    body.alias("body"),
                    X.strip(F.coalesce(title, F.lit(""))).alias("title"),
                    X.lstrip(body).startswith("---").alias("headed"),
                    X.strip(F.regexp_extract(body, r"(?mdU)^#\s+(.+)$", 1)).alias("h1"),
                    p.alias("prose"),
                    F.coalesce(
                        F.try_element_at(F.filter(X.split_lines(p), lambda s: ~X.is_blank(s) & ~s.startswith("#")), F.lit(1)), F.lit("")
                    ).alias("para"),
                    F.regexp_count(body, F.lit(r"(?mdU)^[ \t]*[-*+]\s+\S")).alias("bullets"),
                    F.regexp_extract(body, r"(?iU)#{1,6}[ \t]*Related notes\b[\s\S]*?(?=\n#{1,6}\s|\z)", 0).alias("related"),
                    F.size(F.filter(X.split_lines(body), lambda s: ~X.is_blank(s))).alias("lines"),
                ),
                judge,
            ),
        )

    return X.let(F.coalesce(content, F.lit("")), facts)


# --- block ids ------------------------------------------------------------------------------------


def taggable_line(line: Column) -> Column:
    """Lines that may carry a block id: list items or at least 24 characters, no markup lines."""

    def test(s):
        markup = s.rlike(r"(?U)^#{1,6}\s+") | s.startswith("```") | s.startswith("|") | s.startswith("---") | s.startswith(">")
        return (
            (s != "") & ~markup & ~s.rlike(r"(?U)\s+\^[a-zA-Z0-9-]+$")
            & (s.rlike(r"(?U)^(?:[-*+]|\d+\.)\s+") | (F.length(s) >= 24))
        )

    return X.let(X.strip(line), test)


def with_block_ids(path: Column, content: Column) -> Column:
    """Append ``^id`` to eligible body lines; ids are hashes of path and line number, so they repeat."""

    def tag(body):
        return F.array_join(
            F.transform(
                F.split(body, "\n"),
                lambda s, i: F.when(
                    taggable_line(s),
                    F.concat(X.rstrip(s), F.lit(" ^"), F.substring(F.sha2(F.concat_ws("|", path, i), 256), 1, 8)),
                ).otherwise(s),
            ),
            "\n",
        )

    head = F.regexp_extract(content, r"(?s)^(\s*---.*?---)", 1)
    rest = F.ltrim(F.substring(content, F.length(head) + 1, F.length(content)), F.lit("\n"))
    return F.when(head != "", F.concat(head, F.lit("\n"), tag(rest))).otherwise(tag(content))


def report_value(value: Column, kind: str) -> Column:
    """Report text of a value: placeholder for empty, Yes/No, short decimals, JSON for nested values."""
    missing = F.lit("Not provided")
    if kind == "boolean":
        return F.when(value.isNull(), missing).when(value, "Yes").otherwise("No")
    if kind == "double":
        shown = F.regexp_replace(F.regexp_replace(F.format_string("%.3f", value), "0+$", ""), r"\.$", "")
        return F.when(value.isNull(), missing).otherwise(shown)
    if kind == "json":
        return F.coalesce(F.to_json(value), missing)
    text = value.cast("string")
    return F.when(F.coalesce(text, F.lit("")) == "", missing).otherwise(text)
