"""One report per source: markdown and HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noviscan.functions import text as X
from noviscan.operators.proposals import report_value

SECTIONS = ("Source", "Novelty", "Overlaps", "Suggestions")
NONE = "None reported"


def report_rows(sources: DataFrame, verdicts: DataFrame, overlap_rows: DataFrame, proposals: DataFrame) -> DataFrame:
    """source_id, section, pos, label, value: one row per report line.

    ``overlap_rows``: source_id, pos, note_path, note_title, max_similarity. ``proposals``: source_id,
    pos, concept_title, note_path, quality_score, duplicate_of.
    """

    def line(section: int, pos: Column, label: Column, value: Column) -> Column:
        return F.struct(F.lit(section).alias("section"), pos.cast("long").alias("pos"), label.alias("label"), value.alias("value"))

    base = sources.join(verdicts, "source_id", "left")
    fixed = base.select(
        "source_id",
        F.inline(
            F.array(
                line(0, F.lit(0), F.lit("Title"), report_value(F.col("title"), "string")),
                line(0, F.lit(1), F.lit("Type"), report_value(F.col("source_type"), "string")),
                line(0, F.lit(2), F.lit("Reference"), report_value(F.col("source_ref"), "string")),
                line(1, F.lit(0), F.lit("Verdict"), report_value(F.col("verdict"), "string")),
                line(1, F.lit(1), F.lit("Novelty score"), report_value(F.col("novelty_score"), "double")),
                line(1, F.lit(2), F.lit("Novel chunks"), report_value(F.col("novel_chunks"), "string")),
                line(1, F.lit(3), F.lit("Known chunks"), report_value(F.col("known_chunks"), "string")),
            )
        ),
    )
    detail = F.to_json(F.struct("note_path", "max_similarity"))
    found = overlap_rows.select("source_id", F.inline(F.array(line(2, F.col("pos"), F.coalesce("note_title", "note_path"), detail))))
    silent = sources.join(overlap_rows.select("source_id").distinct(), "source_id", "left_anti").select(
        "source_id", F.inline(F.array(line(2, F.lit(0), F.lit("Summary"), F.lit(NONE))))
    )
    made = proposals.select(
        "source_id",
        F.inline(F.array(line(3, F.col("pos"), F.coalesce("concept_title", F.lit("Suggestion")), F.to_json(F.struct("note_path", "quality_score"))))),
    )
    totals = sources.select("source_id").join(
        proposals.groupBy("source_id").agg(
            F.round(F.avg("quality_score"), 3).alias("q"), F.count_if(F.col("duplicate_of").isNotNull()).alias("d")
        ),
        "source_id", "left",
    ).select(
        "source_id",
        F.inline(
            F.array(
                line(3, F.lit(1 << 40), F.lit("Quality"), report_value(F.col("q"), "double")),
                line(3, F.lit((1 << 40) + 1), F.lit("Duplicates"), F.when(F.coalesce("d", F.lit(0)) > 0, F.col("d").cast("string")).otherwise(NONE)),
            )
        ),
    )
    return fixed.unionByName(found).unionByName(silent).unionByName(made).unionByName(totals)


def markdown_reports(rows: DataFrame, title: str = "Novelty report") -> DataFrame:
    """One markdown text per source (a report is one document; its lines are the source's findings)."""
    safe = F.replace(F.replace(F.col("value"), F.lit("\r"), F.lit("")), F.lit("\n"), F.lit("  \n"))
    item = F.struct("pos", F.concat(F.lit("- **"), F.col("label"), F.lit(":** "), safe).alias("text"))
    parts = rows.groupBy("source_id", "section").agg(X.join_ordered(F.collect_list(item), "\n").alias("body"))
    name = F.element_at(F.array(*[F.lit(s) for s in SECTIONS]), F.col("section") + 1)
    block = F.struct(F.col("section").alias("pos"), F.concat(F.lit("## "), name, F.lit("\n\n"), F.col("body")).alias("text"))
    return parts.groupBy("source_id").agg(
        F.concat(F.lit(f"# {title}\n\n"), X.join_ordered(F.collect_list(block), "\n\n"), F.lit("\n")).alias("report")
    )


def html_reports(rows: DataFrame, title: str = "Novelty report") -> DataFrame:
    item = F.struct(
        "pos",
        F.concat(
            F.lit("<dt>"), X.html_escape(F.col("label")), F.lit("</dt><dd>"),
            F.replace(X.html_escape(F.col("value")), F.lit("\n"), F.lit("<br>")), F.lit("</dd>"),
        ).alias("text"),
    )
    parts = rows.groupBy("source_id", "section").agg(X.join_ordered(F.collect_list(item), "").alias("body"))
    name = F.element_at(F.array(*[F.lit(s) for s in SECTIONS]), F.col("section") + 1)
    block = F.struct(
        F.col("section").alias("pos"),
        F.concat(F.lit("<section><h2>"), name, F.lit("</h2><dl>"), F.col("body"), F.lit("</dl></section>")).alias("text"),
    )
    head = f'<!doctype html><html lang="en"><head><meta charset="utf-8"><title>{title}</title></head><body><h1>{title}</h1>'
    return parts.groupBy("source_id").agg(
        F.concat(F.lit(head), X.join_ordered(F.collect_list(block), ""), F.lit("</body></html>")).alias("report")
    )
